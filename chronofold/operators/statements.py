"""Statements and their arguments for downstream databases, as columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from chronofold.functions import names


def _values(columns: list[str], prefix: str) -> Column:
    return F.array(*[F.col(f"{prefix}{c}").cast("string") for c in columns])


def _where(columns: list[str], unique_keys: list[list[str]], prefix: str, oracle: bool, types: dict[str, str], used: Column | None = None) -> tuple[Column, Column]:
    """(condition, arguments): by the first unique key without nulls, else by all columns."""
    columns = sorted(columns)

    def empty(c: str) -> Column:
        v = F.col(f"{prefix}{c}")
        return (v.isNull() | (v.cast("string") == "")) if oracle else v.isNull()

    def name(c: str) -> str:
        return c if oracle else names.quote(c)

    def sided(c: str) -> str:
        return f"RTRIM({c})" if oracle and types.get(c, "").upper() in ("CHAR", "NCHAR") else name(c)

    def clause(own: list[str]) -> Column:
        parts, n = [], F.lit(0) if used is None else used
        for c in own:
            n = n + F.when(empty(c), 0).otherwise(1)
            bound = F.concat(F.lit(f"{sided(c)} = :"), n.cast("string")) if oracle else F.lit(f"{sided(c)} = ?")
            parts.append(F.when(empty(c), F.lit(f"{name(c)} IS NULL")).otherwise(bound))
        return F.concat_ws(" AND ", *parts)

    def arguments(own: list[str]) -> Column:
        return F.filter(F.array(*[F.when(~empty(c), F.col(f"{prefix}{c}").cast("string")) for c in own]), lambda x: x.isNotNull())

    text, args = clause(columns), arguments(columns)
    for key in reversed(unique_keys):
        whole = F.lit(True)
        for c in key:
            whole = whole & F.col(f"{prefix}{c}").isNotNull()
        text, args = F.when(whole, clause(key)).otherwise(text), F.when(whole, arguments(key)).otherwise(args)
    return text, args


def insert(table: Column, columns: list[str], verb: str = "INSERT", oracle: bool = False) -> Column:
    own = sorted(columns)
    listed = ",".join(own if oracle else map(names.quote, own))
    return F.struct(F.concat(F.lit(f"{verb} INTO "), table, F.lit(f"({listed}) VALUES({names.placeholders(len(own), oracle)})")).alias("sql"), _values(own, "").alias("args"))


def replace(table: Column, columns: list[str]) -> Column:
    return insert(table, columns, "REPLACE")


def update(table: Column, columns: list[str], unique_keys: list[list[str]], before: str = "old_", oracle: bool = False, types: dict[str, str] | None = None) -> Column:
    own = sorted(columns)
    sets = ",".join(f"{c} = :{i}" if oracle else f"{names.quote(c)} = ?" for i, c in enumerate(own, 1))
    where, args = _where(columns, unique_keys, before, oracle, types or {}, F.lit(len(own)) if oracle else None)
    end = " AND rownum <=1" if oracle else " LIMIT 1"
    return F.struct(F.concat(F.lit("UPDATE "), table, F.lit(f" SET {sets} WHERE "), where, F.lit(end)).alias("sql"), F.concat(_values(own, ""), args).alias("args"))


def delete(table: Column, columns: list[str], unique_keys: list[list[str]], image: str = "", oracle: bool = False, types: dict[str, str] | None = None) -> Column:
    """Delete by the row's values, or by those of another image (prefix), such as the new ones of an update."""
    where, args = _where(columns, unique_keys, image, oracle, types or {})
    end = " AND rownum <=1" if oracle else " LIMIT 1"
    return F.struct(F.concat(F.lit("DELETE FROM "), table, F.lit(" WHERE "), where, F.lit(end)).alias("sql"), args.alias("args"))


def printed(db: Column, tbl: Column, op: Column, fields: Column) -> Column:
    """Lines of a change for people: a head, then each field (name, type, value, changed); updates show both values."""
    kind = F.when(op == "I", "Insert").when(op == "U", "Update").otherwise("Delete")
    head = F.format_string("schema: %s; table: %s; type: %s", db, tbl, kind)

    def line(f):
        value, changed = F.coalesce(f["value"], F.lit("NULL")), F.coalesce(f["changed"], F.lit("NULL"))
        shown = F.concat(f["name"], F.lit("("), f["type"], F.lit("): "), value)
        return F.when(op == "U", F.concat(shown, F.lit(" => "), changed)).otherwise(shown)

    return F.concat(F.array(head), F.transform(fields, line))


def printed_ddl(sql: Column) -> Column:
    return F.concat(F.lit("DDL query: "), sql)
