"""The catalog: versions of tables, and what a row's version says about its columns."""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: Versions of a table that are kept.
RETAINED = 2


def as_of(changes: DataFrame, versions: DataFrame, keys: list[str]) -> DataFrame:
    """Changes with ``version``: the smallest retained one of their table at or above the row's schema_version (null: none).

    Only the distinct (table, version) pairs of the changes meet the versions; the
    answer comes back by an equi-join, so rows are not multiplied on the way.
    """
    asked = changes.select(*keys, "schema_version").distinct()
    v = versions.select(*[F.col(k).alias(f"__{k}") for k in keys], "version")
    fits = F.col("version") >= F.col("schema_version")
    for k in keys:
        fits = fits & F.col(k).eqNullSafe(F.col(f"__{k}"))
    found = asked.join(v, fits, "left").groupBy(*keys, "schema_version").agg(F.min("version").alias("version"))
    found = found.select(*[F.col(k).alias(f"__{k}") for k in [*keys, "schema_version"]], "version")
    same = F.lit(True)
    for k in [*keys, "schema_version"]:
        same = same & F.col(k).eqNullSafe(F.col(f"__{k}"))
    return changes.join(found, same, "left").drop(*[f"__{k}" for k in [*keys, "schema_version"]])


def latest(versions: DataFrame, keys: list[str], upto: int) -> DataFrame:
    """The last version of each table applied by ``upto``: what rows are decoded with."""
    return versions.filter(F.col("version") <= upto).groupBy(*keys).agg(F.max("version").alias("version"))


def retained(versions: DataFrame, keys: list[str], n: int = RETAINED) -> DataFrame:
    """The newest versions of each table."""
    newest = Window.partitionBy(*keys).orderBy(F.desc("version"))
    return versions.withColumn("__n", F.row_number().over(newest)).filter(F.col("__n") <= n).drop("__n")


def named(changes: DataFrame, tables: DataFrame) -> DataFrame:
    """Changes with the names (db, tbl) of their table_id."""
    return changes.join(tables.select("table_id", "db", "tbl"), "table_id")


def with_jobs(log: DataFrame, jobs: DataFrame) -> DataFrame:
    """Records that a schema change made (job_id), with their job; those without one, or whose job is not known yet, are left out."""
    return log.filter("job_id > 0").join(jobs, "job_id")


def consumed_once(changes: DataFrame, versions: DataFrame) -> DataFrame:
    """The first change (by commit_ts) of each schema_version, with the table (db, tbl) that the version's statement changed.

    A version's entry is used up by its first change.
    """
    first = changes.groupBy("schema_version").agg(F.min("commit_ts").alias("commit_ts"))
    return first.join(versions.select(F.col("version").alias("schema_version"), "db", "tbl"), "schema_version")


def can_fill_default(dropping: Column, row_version: Column, last_ddl_version: Column) -> Column:
    """A missing column may take its default while it is being dropped, or if the row is older than the last DDL."""
    return F.coalesce(dropping | (row_version < last_ddl_version), F.lit(False))


def default_or_zero(value: Column, default: Column, nullable: Column, elements: Column, zero: Column) -> Column:
    """The value, or the column's default, or null if it may be, or its first element (enum), or zero of its type."""
    return F.coalesce(value, default, F.when(~nullable, F.coalesce(F.try_element_at(elements, F.lit(1)), zero)))


def enum_ordinal(elements: Column, name: Column) -> Column:
    """Place of an element, from 1; 0 if there is none."""
    return F.array_position(elements, name)


def enum_name(elements: Column, ordinal: Column) -> Column:
    return F.try_element_at(elements, ordinal)


def set_names(elements: Column, bits: Column) -> Column:
    """The elements whose bits are set."""
    return F.filter(elements, lambda x, i: F.expr("true") & (F.getbit(bits, i) == 1))


def snapshot_jobs(tables: DataFrame) -> DataFrame:
    """Jobs that make a catalog anew: one for each database, then one for each database that has tables, versions 1, 2, ..."""
    dbs = tables.select("db").distinct().withColumn("phase", F.lit(0)).withColumn("tables", F.lit(None).cast("array<string>"))
    made = tables.filter("tbl is not null").groupBy("db").agg(F.array_sort(F.collect_list("tbl")).alias("tables")).withColumn("phase", F.lit(1)).select("db", "phase", "tables")
    jobs = dbs.unionByName(made)
    # a catalog is small: its jobs are numbered in one task
    version = F.row_number().over(Window.orderBy("phase", "db")).cast("long")
    return jobs.select(version.alias("version"), F.when(F.col("phase") == 0, "create schema").otherwise("create tables").alias("job_type"), "db", "tables")


@dataclass
class Job:
    """One schema change. ``table`` holds its columns; ``old_table_id`` what a truncation replaces."""

    version: int
    job_type: str
    state: str = "synced"
    schema_id: int = 0
    db: str = ""
    table_id: int = 0
    tbl: str = ""
    columns: tuple[str, ...] = ()
    old_table_id: int = 0
    schema_state: str = "public"
    tables: tuple[tuple[int, str], ...] = ()


class CatalogError(ValueError):
    """A job that does not fit the catalog."""


@dataclass
class Catalog:
    """A fold over jobs by version. The volume of schema changes is small; rows meet its result as a DataFrame."""

    version: int = 0
    schemas: dict[int, str] = field(default_factory=dict)
    names: dict[int, tuple[int, str]] = field(default_factory=dict)
    kept: dict[int, list[tuple[int, tuple[str, ...]]]] = field(default_factory=dict)
    truncated: set[int] = field(default_factory=set)
    dropping: set[int] = field(default_factory=set)
    history: list[tuple] = field(default_factory=list)
    #: Schemas that exist from the start and may be created again.
    system: frozenset[str] = frozenset({"mysql"})

    def apply(self, jobs: Iterable[Job], upto: int | None = None) -> Catalog:
        """Apply the finished jobs above the present version, in order, up to ``upto``."""
        for job in sorted(jobs, key=lambda j: j.version):
            if job.version <= self.version or (upto is not None and job.version > upto) or job.state not in ("synced", "done"):
                continue
            if job.job_type == "drop column":
                (self.dropping.add if job.schema_state == "delete only" else self.dropping.discard)(job.table_id)
            self._one(job)
            self.version = job.version
        return self

    def _one(self, j: Job) -> None:
        if j.job_type == "create schema":
            if j.schema_id in self.schemas or (j.db in self.schemas.values() and j.db not in self.system):
                raise CatalogError(f"schema {j.db} exists")
            self.schemas[j.schema_id] = j.db
        elif j.job_type == "modify schema":
            self._schema(j)
        elif j.job_type == "drop schema":
            self._schema(j)
            del self.schemas[j.schema_id]
            for t in [t for t, (s, _) in self.names.items() if s == j.schema_id]:
                self._drop(t)
        elif j.job_type in ("create table", "create view", "create sequence", "recover table"):
            self._create(j, j.table_id, j.tbl)
        elif j.job_type == "create tables":
            for table_id, tbl in j.tables:
                self._create(j, table_id, tbl)
        elif j.job_type == "rename table":
            self._drop(j.table_id)
            self._create(j, j.table_id, j.tbl)
        elif j.job_type in ("drop table", "drop view", "drop sequence"):
            self._drop(j.table_id)
        elif j.job_type == "truncate table":
            self._drop(j.old_table_id)
            self.truncated.add(j.old_table_id)
            self._create(j, j.table_id, j.tbl)
        else:
            if j.table_id not in self.names:
                raise CatalogError(f"table {j.table_id} does not exist")
            self._keep(j, j.table_id, j.tbl or self.names[j.table_id][1])

    def _schema(self, j: Job) -> None:
        if j.schema_id not in self.schemas:
            raise CatalogError(f"schema {j.schema_id} does not exist")

    def _create(self, j: Job, table_id: int, tbl: str) -> None:
        self._schema(j)
        if table_id in self.names:
            raise CatalogError(f"table {table_id} exists")
        self.names[table_id] = (j.schema_id, tbl)
        self._keep(j, table_id, tbl)

    def _keep(self, j: Job, table_id: int, tbl: str) -> None:
        self.names[table_id] = (self.names[table_id][0], tbl)
        self.kept[table_id] = [*self.kept.get(table_id, []), (j.version, tuple(j.columns))][-RETAINED:]
        self.history.append((table_id, self.schemas[self.names[table_id][0]], tbl, j.version, list(j.columns)))

    def _drop(self, table_id: int) -> None:
        if table_id not in self.names:
            raise CatalogError(f"table {table_id} does not exist")
        del self.names[table_id]
        self.kept.pop(table_id, None)

    def versions(self, spark: SparkSession) -> DataFrame:
        """table_id, db, tbl, version, columns, valid_from, valid_to of every version applied."""
        rows = spark.createDataFrame(self.history, "table_id long, db string, tbl string, version long, columns array<string>")
        following = F.lead("version").over(Window.partitionBy("table_id").orderBy("version"))
        return rows.withColumn("valid_from", F.col("version")).withColumn("valid_to", following)
