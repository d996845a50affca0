"""All queries of the library outside the training-data package, with their SQL."""

from chronofold.plans import logs, more, queries, rows

assert more and logs and rows  # their queries register themselves
QUERIES: dict = queries.QUERIES
ORACLE_SQL: dict[str, str] = queries.SQL
FLAGSHIP = "a6_final_state"
