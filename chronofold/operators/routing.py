"""Routing of tables to target names. The most specific rule wins: fewer wildcards first, then longer patterns."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from chronofold.operators.filters import wildcard


@dataclass(frozen=True)
class Route:
    schema: str
    table: str
    to_schema: str
    to_table: str = ""

    def rank(self) -> tuple:
        both = self.schema + self.table
        return (sum(both.count(c) for c in "*?"), -len(both), self.schema, self.table)


def routed(db: Column, tbl: Column, routes: list[Route]) -> Column:
    """struct(db, tbl) after routing; names that no rule matches stay."""
    to_db, to_tbl = db, tbl
    for r in sorted(routes, key=Route.rank, reverse=True):
        fits = db.rlike(wildcard(r.schema)) & (tbl.rlike(wildcard(r.table)) if r.table else F.lit(True))
        to_db = F.when(fits, F.lit(r.to_schema)).otherwise(to_db)
        to_tbl = F.when(fits, F.lit(r.to_table) if r.to_table else tbl).otherwise(to_tbl)
    return F.struct(to_db.alias("db"), to_tbl.alias("tbl"))
