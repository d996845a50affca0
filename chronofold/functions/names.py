"""Identifiers, placeholders, keys and the small text functions of statement building."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F


def quoted(name: Column) -> Column:
    """A name in backticks, with its own doubled."""
    return F.concat(F.lit("`"), F.replace(name, F.lit("`"), F.lit("``")), F.lit("`"))


def quoted_table(db: Column, tbl: Column) -> Column:
    return F.concat(quoted(db), F.lit("."), quoted(tbl))


def quote(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"


def placeholders(n: int, oracle: bool = False, first: int = 1) -> str:
    return ",".join(f":{i}" if oracle else "?" for i in range(first, first + n))


def placeholder_list(n: Column) -> Column:
    return F.array_join(F.array_repeat(F.lit("?"), n), ",")


def key_text(names: list[str], prefix: str = "") -> Column:
    """(name: value) of each column that is not null, one after another."""
    return F.concat(*[F.when(F.col(f"{prefix}{n}").isNotNull(), F.concat(F.lit(f"({n}: "), F.col(f"{prefix}{n}").cast("string"), F.lit(")"))).otherwise(F.lit("")) for n in names])


def hash_slot(key: Column, workers: int) -> Column:
    """IEEE crc32 of a key modulo the number of workers."""
    return F.crc32(key.cast("binary")) % workers


def relaxed_sql_mode(mode: Column) -> Column:
    """A list of modes without the strict one for transactional tables."""
    return F.array_join(F.filter(F.split(mode, ","), lambda x: x != "STRICT_TRANS_TABLES"), ",")


def node_id(text: Column) -> Column:
    """A node's id from a key's path, without the space around it."""
    return F.trim(F.substring_index(F.trim(text), "/", -1))


def shown(value: Column) -> Column:
    """A value as text for people: NULL where there is none."""
    return F.coalesce(value.cast("string"), F.lit("NULL"))


def _number(text: Column) -> Column:
    return text.try_cast("double")


def seconds_of(text: Column) -> Column:
    """Durations in a column: a bare integer counts days, else numbers with units; null where it is neither."""
    t = F.trim(text)
    parts = F.regexp_extract_all(t, F.lit(r"(\d+(?:\.\d+)?(?:ns|us|µs|ms|s|m|h))"), F.lit(1))
    units = F.create_map(*[F.lit(x) for pair in _UNITS.items() for x in (pair[0], float(pair[1]))])
    each = F.transform(parts, lambda p: _number(F.regexp_extract(p, r"^([0-9.]+)", 1)) * F.try_element_at(units, F.regexp_extract(p, r"([a-zµ]+)$", 1)))
    total = F.aggregate(each, F.lit(0.0), lambda a, x: a + x)
    whole = (F.size(parts) > 0) & (F.array_join(parts, "") == F.regexp_replace(t, r"^\+", ""))
    return F.when(t.rlike(r"^\d+$"), _number(t) * 86400).when(whole, total)


def bytes_of(text: Column) -> Column:
    """Sizes in a column, such as 10 GiB; null where it is none."""
    number, unit = F.regexp_extract(text, r"^\s*(\d+(?:\.\d+)?)\s*([a-zA-Z]*)\s*$", 1), F.lower(F.regexp_extract(text, r"^\s*(\d+(?:\.\d+)?)\s*([a-zA-Z]*)\s*$", 2))
    units = F.create_map(*[F.lit(x) for pair in _SIZES.items() for x in (pair[0], float(pair[1]))])
    return F.when(number != "", (_number(number) * F.try_element_at(units, unit)).cast("long"))


def zone_minutes(text: Column) -> Column:
    """Minutes of +hh:mm zones in a column; null for zones by name and for offsets out of range (-12:59 to +14:00)."""
    sign, h, m = (F.regexp_extract(text, r"^([+-])(\d{1,2}):(\d{2})$", k) for k in (1, 2, 3))
    minutes = F.when(sign == "-", -1).otherwise(1) * (h.try_cast("int") * 60 + m.try_cast("int"))
    return F.when((sign != "") & (m.try_cast("int") <= 59) & minutes.between(-779, 840), minutes)


_UNITS = {"ns": 1e-9, "us": 1e-6, "µs": 1e-6, "ms": 1e-3, "s": 1, "m": 60, "h": 3600}
_SIZES = {"b": 1, "kb": 10**3, "mb": 10**6, "gb": 10**9, "tb": 10**12, "kib": 1 << 10, "mib": 1 << 20, "gib": 1 << 30, "tib": 1 << 40, "": 1}


def seconds(text: str) -> float:
    """A duration: a bare integer counts days; else numbers with units, such as 1h30m."""
    text = text.strip()
    if re.fullmatch(r"\d+", text):
        return int(text) * 86400.0
    found = re.findall(r"(\d+(?:\.\d+)?)(ns|us|µs|ms|s|m|h)", text)
    if not found or "".join(a + b for a, b in found) != text.removeprefix("+"):
        raise ValueError(f"not a duration: {text!r}")
    return sum(float(a) * _UNITS[b] for a, b in found)


def size_bytes(text: str) -> int:
    """A size such as 10 GiB."""
    found = re.fullmatch(r"\s*(\d+(?:\.\d+)?)\s*([a-zA-Z]*)\s*", text)
    if not found or found[2].lower() not in _SIZES:
        raise ValueError(f"not a size: {text!r}")
    return int(float(found[1]) * _SIZES[found[2].lower()])


def zone_offset_minutes(text: str) -> int | None:
    """Minutes of a +hh:mm zone (-12:59 to +14:00); None for a zone by name. SYSTEM and Local are refused."""
    if text.lower() in ("system", "local", ""):
        raise ValueError(f"the zone must be named: {text!r}")
    found = re.fullmatch(r"([+-])(\d{1,2}):(\d{2})", text)
    if not found:
        return None
    minutes = int(found[2]) * 60 + int(found[3])
    minutes = -minutes if found[1] == "-" else minutes
    if int(found[3]) > 59 or not -779 <= minutes <= 840:
        raise ValueError(f"the zone's offset is out of range: {text!r}")
    return minutes
