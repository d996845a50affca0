"""What a DDL statement does and to which table, by patterns. An unknown statement has kind null."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

_NAME = r"(?:`((?:[^`]|``)+)`|([\w$]+))"
_TABLE = rf"{_NAME}(?:\s*\.\s*{_NAME})?"
_USE = rf"^\s*use\s+{_NAME}\s*;\s*"
_END = r"(?=[\s(;]|$)"

#: (kind, pattern before the name, whether the name is a database's)
STATEMENTS = [
    ("create database", r"create\s+(?:database|schema)\s+(?:if\s+not\s+exists\s+)?", True),
    ("drop database", r"drop\s+(?:database|schema)\s+(?:if\s+exists\s+)?", True),
    ("create table", r"create\s+(?:temporary\s+)?table\s+(?:if\s+not\s+exists\s+)?", False),
    ("drop table", r"drop\s+table\s+(?:if\s+exists\s+)?", False),
    ("alter table", r"alter\s+table\s+", False),
    ("rename table", r"rename\s+table\s+", False),
    ("truncate table", r"truncate\s+(?:table\s+)?", False),
    ("create index", r"create\s+(?:unique\s+|fulltext\s+|spatial\s+)?index\s+(?:if\s+not\s+exists\s+)?\S+\s+on\s+", False),
    ("drop index", r"drop\s+index\s+(?:if\s+exists\s+)?\S+\s+on\s+", False),
    ("create view", r"create\s+(?:or\s+replace\s+)?(?:algorithm\s*=\s*\w+\s+)?view\s+", False),
]


def without_use(sql: Column) -> Column:
    """The statement after a leading ``use db;``."""
    return F.regexp_replace(sql, "(?i)" + _USE, "")


def used_db(sql: Column) -> Column:
    return _name(sql, "(?i)" + _USE, 1)


def _name(sql: Column, pattern: str, group: int) -> Column:
    """A name of two forms: in backticks (``group``) or plain (the next group). Null if absent."""
    inside = F.replace(F.regexp_extract(sql, pattern, group), F.lit("``"), F.lit("`"))
    plain = F.regexp_extract(sql, pattern, group + 1)
    return F.when(inside != "", inside).when(plain != "", plain)


def kind(sql: Column) -> Column:
    bare, out = without_use(sql), F.lit(None).cast("string")
    for name, before, _ in reversed(STATEMENTS):
        out = F.when(bare.rlike(rf"(?is)^\s*{before}{_TABLE}{_END}"), F.lit(name)).otherwise(out)
    return out


def target(sql: Column, renamed: bool = False) -> Column:
    """struct(db, tbl), empty where not named. Of a rename the old table, or the new one if ``renamed``."""
    bare, db, tbl = without_use(sql), F.lit(None).cast("string"), F.lit(None).cast("string")
    for name, before, database in reversed(STATEMENTS):
        pattern = rf"(?is)^\s*{before}{_TABLE}{_END}"
        if renamed and name == "rename table":
            pattern = rf"(?is)^\s*{before}(?:`(?:[^`]|``)+`|[\w$]+)(?:\s*\.\s*(?:`(?:[^`]|``)+`|[\w$]+))?\s+to\s+{_TABLE}"
        first, second, fits = _name(bare, pattern, 1), _name(bare, pattern, 3), bare.rlike(pattern)
        db = F.when(fits, first if database else F.when(second.isNotNull(), first)).otherwise(db)
        tbl = F.when(fits, F.lit("") if database else F.coalesce(second, first)).otherwise(tbl)
    return F.struct(F.coalesce(db, used_db(sql), F.lit("")).alias("db"), F.coalesce(tbl, F.lit("")).alias("tbl"))


def problem(sql: Column) -> Column:
    """Why a statement's target cannot be told: it is of no known kind, or there are several; null where it can.

    The use of a database before it does not count. A semicolon inside quotes ends no statement.
    """
    bare = F.regexp_replace(F.regexp_replace(without_use(sql), r"('([^'\\\\]|\\\\.)*'|\"[^\"]*\"|`[^`]*`)", "q"), r"[;\s]+$", "")
    return F.when(bare.contains(";"), "several statements").when(kind(sql).isNull(), "unknown statement")


def checked_target(sql: Column, renamed: bool = False) -> Column:
    """target(), but a statement with a problem() is an error."""
    p = problem(sql)
    stop = F.raise_error(F.concat(p, F.lit(": "), sql))
    t = target(sql, renamed)
    return F.struct(F.when(p.isNotNull(), stop.cast("string")).otherwise(t["db"]).alias("db"), t["tbl"].alias("tbl"))


def is_create_database(sql: Column) -> Column:
    return F.coalesce(kind(sql) == "create database", F.lit(False))


def is_truncate(sql: Column) -> Column:
    return F.coalesce(kind(sql) == "truncate table", F.lit(False))


def is_replica_ddl(sql: Column) -> Column:
    """ALTER ... SET ... REPLICA statements, which only columnar replicas understand."""
    return sql.rlike(r"(?is)^\s*alter\s+(?:table|database)\s+.*\bset\s+\w+\s+replica\b")


def is_sequence_query(sql: Column) -> Column:
    """Statements that only advance a sequence."""
    return F.lower(F.ltrim(sql)).startswith("select setval")


def changes_columns(sql: Column) -> Column:
    """Whether columns or keys kept about the table must be read again."""
    return F.coalesce(kind(sql).isin("alter table", "rename table", "create index", "drop index", "truncate table", "drop table"), F.lit(False))


def without_placement(sql: Column) -> Column:
    """The statement without placement options, and with row expiry turned off."""
    out = F.regexp_replace(sql, r"(?i)\s*(?:/\*T!\[placement\]\s*)?placement\s+policy\s*=?\s*(?:`[^`]+`|[\w$]+)(?:\s*\*/)?", "")
    return F.regexp_replace(out, r"(?i)ttl_enable\s*=\s*'on'", "TTL_ENABLE='OFF'")


#: Errors that say the wanted state is there already. Error codes of the MySQL protocol for a database that
#: exists, cannot be dropped or does not exist, a table that exists, is unknown at a drop, a column that does not exist or
#: exists, a key's name that exists, a key or column that cannot be dropped, a table or key that does not exist, an index that exists.
IGNORABLE_CODES = [1007, 1008, 1049, 1050, 1051, 1054, 1060, 1061, 1091, 1146, 1176, 1831]


def ignorable_error(code: Column) -> Column:
    return F.coalesce(code.isin(IGNORABLE_CODES), F.lit(False))
