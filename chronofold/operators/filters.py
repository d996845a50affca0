"""Filters over tables, events and statements, as boolean columns."""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chronofold.functions import ddl


def any_of(conditions: list[Column]) -> Column:
    return reduce(lambda a, b: a | b, conditions, F.lit(False))


def pattern(rule: str) -> str:
    """A rule as a regular expression: after ``~`` it may match anywhere, else it must match the whole name."""
    return f"(?i){rule[1:]}" if rule.startswith("~") else f"(?i)^{rule}$"


def wildcard(rule: str) -> str:
    """A name with * and ? as a regular expression for the whole name."""
    special = {"*": ".*", "?": "."}
    return "(?i)^" + "".join(special.get(c) or (c if c.isalnum() or c == "_" else "\\" + c) for c in rule) + "$"


@dataclass(frozen=True)
class TableRules:
    """Allowed and blocked databases and (database, table) pairs. Blocked wins; without allowed ones all are."""

    do_dbs: list[str] = field(default_factory=list)
    do_tables: list[tuple[str, str]] = field(default_factory=list)
    ignore_dbs: list[str] = field(default_factory=list)
    ignore_tables: list[tuple[str, str]] = field(default_factory=list)

    def __post_init__(self):
        for db, tbl in [*self.do_tables, *self.ignore_tables]:
            if not db or not tbl:
                raise ValueError("a table rule names a database and a table")

    def passes(self, db: Column, tbl: Column) -> Column:
        db, tbl = F.lower(F.coalesce(db, F.lit(""))), F.lower(F.coalesce(tbl, F.lit("")))

        def listed(dbs, tables):
            return any_of([db.rlike(pattern(d)) for d in dbs] + [db.rlike(pattern(d)) & tbl.rlike(pattern(t)) for d, t in tables])

        allowed = listed(self.do_dbs, self.do_tables) if self.do_dbs or self.do_tables else F.lit(True)
        return allowed & ~listed(self.ignore_dbs, self.ignore_tables)


@dataclass(frozen=True)
class EventRule:
    """Events and statements to ignore in the tables that two wildcard names match."""

    schema: str
    table: str
    events: tuple[str, ...] = ()
    sql_patterns: tuple[str, ...] = ()

    def ignores(self, db: Column, tbl: Column, event: Column, sql: Column | None = None) -> Column:
        """``event`` may be null (a statement that no pattern knows): then only statements' patterns count."""
        here = db.rlike(wildcard(self.schema)) & (tbl.rlike(wildcard(self.table)) | (F.lit(self.table == "*")))
        hit = F.coalesce(event.isin(list(self.events)), F.lit(False)) if self.events else F.lit(False)
        if sql is not None:
            hit = hit | any_of([sql.rlike(f"(?i){p}") for p in self.sql_patterns])
        return here & hit


def ignored(rules: list[EventRule], db: Column, tbl: Column, event: Column, sql: Column | None = None) -> Column:
    return F.coalesce(any_of([r.ignores(db, tbl, event, sql) for r in rules]), F.lit(False))


def assembled(templates: dict[str, tuple[tuple[str, ...], tuple[str, ...]]], tables: list[tuple[str, str, list[str]]]) -> list[EventRule]:
    """Rules from named templates (events, statement patterns) and the tables that use them; an unknown name is refused."""
    out = []
    for schema, table, used in tables:
        for name in used:
            if name not in templates:
                raise ValueError(f"no filter template named {name!r}")
            out.append(EventRule(schema, table, *templates[name]))
    return out


def combined(rules: DataFrame) -> DataFrame:
    """Rules (rule_id, schema, table, events, sql_patterns) with those of one schema and table made one, in order."""
    parts = F.array_sort(F.collect_list(F.struct("rule_id", "events", "sql_patterns")))
    out = rules.groupBy("schema", "table").agg(parts.alias("p"))
    return out.select("schema", "table", F.flatten("p.events").alias("events"), F.flatten("p.sql_patterns").alias("sql_patterns"))


#: Kinds of jobs that are never passed on, as patterns for the log's own job names.
UNSUPPORTED_JOBS = (
    r"update \w+ replica status",
    r"(un)?lock table",
    r"alter (table )?(no ?)?cache( table)?",
    r"alter table (partition )?attributes",
    r"(create|alter|drop) placement policy",
    r"alter table (partition )?placement",
    r"modify schema default placement",
    r"(create|alter|drop) resource group",
)
#: Fixed value: table ids above it are those of the log's own job tables (48 bits, less a reserve of 1,000).
MAX_TABLE_ID = 0xFFFFFFFFFFFF - 1000


def supported_job(job_type: Column, unsupported: tuple[str, ...] = UNSUPPORTED_JOBS) -> Column:
    """Whether a job of this kind is passed on; a kind is compared whole and in any case."""
    return ~any_of([job_type.rlike(f"(?i)^{p}$") for p in unsupported])


def finished_job(state: Column, table_id: Column | None = None) -> Column:
    """Whether a job has come to its end, and is not one of the log's own job tables."""
    done = state.isin("synced", "done")
    return done if table_id is None else done & (table_id <= MAX_TABLE_ID)


def real_statement(sql: Column) -> Column:
    return ~ddl.is_sequence_query(sql)


def without_commits(log: DataFrame, skipped: list[int]) -> DataFrame:
    return log.filter(~F.col("commit_ts").isin(skipped)) if skipped else log


def without_truncated(changes: DataFrame, truncated: DataFrame) -> DataFrame:
    """Changes but those of table ids that a truncation replaced."""
    return changes.join(truncated.select("table_id").distinct(), "table_id", "left_anti")


def without_loop_backs(changes: DataFrame, channel_id: int, mark_db: str, mark_table: str) -> DataFrame:
    """Changes of transactions that do not hold a mark of our own channel."""
    marks = changes.filter((F.col("db") == mark_db) & (F.col("tbl") == mark_table) & (F.col("channel_id") == channel_id)).select("commit_ts").distinct()
    return changes.join(marks, "commit_ts", "left_anti")


def kept_transactions(changes: DataFrame, mutation_passes: Column, event_passes: Column) -> DataFrame:
    """commit_ts, mutations, events left of each transaction that is not ignored.

    A mutation whose rows are all filtered as events stays, empty; only a
    transaction without mutations is ignored.
    """
    rows = changes.filter(mutation_passes).withColumn("__e", F.when(event_passes, 1).otherwise(0))
    return rows.groupBy("commit_ts").agg(F.countDistinct("db", "tbl").alias("mutations"), F.sum("__e").alias("events"))


def in_range(ts: Column, start: int, stop: int) -> Column:
    """Inclusive on both ends; no stop if it is 0."""
    return (ts >= start) & (F.lit(stop == 0) | (ts <= stop))


def replayed(records: DataFrame, rules: TableRules) -> DataFrame:
    """Records (commit_ts, ddl_query, events) after the table filter: a DDL by its target, others by events that pass."""
    t = ddl.target(F.col("ddl_query"))
    is_ddl = F.col("ddl_query").isNotNull() & (F.col("ddl_query") != "")
    events = F.filter("events", lambda e: rules.passes(e["db"], e["tbl"]))
    out = records.withColumn("events", F.when(is_ddl, F.col("events")).otherwise(events))
    return out.filter(F.when(is_ddl, rules.passes(t["db"], t["tbl"])).otherwise(F.size("events") > 0))
