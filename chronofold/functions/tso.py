"""Timestamps of the log: physical milliseconds shifted left by 18 bits, plus a logical counter."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

LOGICAL_BITS = 18
PER_MS = 1 << LOGICAL_BITS


def millis(column: str) -> Column:
    """Milliseconds since 1970 of a timestamp without zone, whatever the session's zone is."""
    return F.expr(f"timestampdiff(MICROSECOND, TIMESTAMP_NTZ'1970-01-01 00:00:00', cast({column} as timestamp_ntz)) div 1000")


def encode(ms: Column) -> Column:
    return F.shiftleft(ms.cast("long"), LOGICAL_BITS)


def physical(ts: Column) -> Column:
    """Milliseconds."""
    return F.shiftright(ts, LOGICAL_BITS)


def logical(ts: Column) -> Column:
    return ts.bitwiseAND(PER_MS - 1)


def rough_seconds(ts: Column) -> Column:
    return F.floor(physical(ts) / 1000).cast("long")


def advanced(ts: Column, seconds: Column | int) -> Column:
    """The timestamp some seconds later; 0 stays 0."""
    step = F.lit(seconds) if isinstance(seconds, int) else seconds
    return F.when(ts == 0, F.lit(0).cast("long")).otherwise(ts + encode(step * 1000))


def from_datetime(text: Column, zone: str = "UTC", pattern: str = "yyyy-MM-dd HH:mm:ss") -> Column:
    """Date and time in a zone, whatever the session's zone is; the logical part is 0."""
    return encode(F.unix_millis(F.to_timestamp(F.concat(text, F.lit(f" {zone}")), f"{pattern} VV")))


def is_heartbeat(start_ts: Column, commit_ts: Column) -> Column:
    return F.coalesce((start_ts == commit_ts) & (start_ts > 0), F.lit(False))


def unsigned(value: Column) -> Column:
    """A 64-bit pattern read as unsigned."""
    wide = value.cast("decimal(20,0)")
    return F.when(value < 0, (wide + F.lit("18446744073709551616").cast("decimal(20,0)")).cast("decimal(20,0)")).otherwise(wide)
