"""Ordered release of a stream from several sources.

A row may go once every source has passed its commit_ts. Per group (a table by
default) a stateful operator holds rows and the largest timestamp of each source;
what lies at or below the least of those is released in order, each timestamp once.
Late rows (at or below what was released) are dropped and counted.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from chronofold.shipping import ship

STATE = "seen_source array<long>, seen_ts array<long>, ts array<long>, source array<long>, payload array<string>, released long, dropped long"
OUT = "grp string, commit_ts long, source_id long, payload string, dropped long"


def fold(rows: list[tuple[int, int, str]], seen: dict[int, int], held: list[tuple[int, int, str]], released: int, sources: int) -> tuple[list, list, int, int]:
    """One step: (released rows, held rows, last released ts, dropped) after ``rows`` of (ts, source, payload). ``seen`` is updated."""
    dropped = 0
    for ts, source, payload in rows:
        seen[source] = max(seen.get(source, ts), ts)
        if ts <= released:
            dropped += 1
        elif payload is not None:  # a heartbeat moves its source on and carries nothing
            held.append((ts, source, payload))
    if len(seen) < sources:
        return [], held, released, dropped
    bound, out, keep = min(seen.values()), [], []
    for row in sorted(held, key=lambda r: r[:2]):
        if row[0] > bound:
            keep.append(row)
        elif out and out[-1][0] == row[0]:
            dropped += 1
        else:
            out.append(row)
    return out, keep, max(released, bound), dropped


def ordered(stream: DataFrame, sources: int, group=None) -> DataFrame:
    """Rows (grp, commit_ts, source_id, payload, dropped so far) in order within each group.

    ``stream``: commit_ts, source_id, payload (null for a heartbeat). ``group``: a
    column; a constant asks for one total order, which is one task's work.
    """
    ship(stream.sparkSession)

    def run(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.exists:
            s, t, ts, src, pay, released, dropped = state.get
            seen, held = dict(zip(s, t, strict=True)), list(zip(ts, src, pay, strict=True))
        else:
            seen, held, released, dropped = {}, [], -1, 0
        rows = [(int(a), int(b), c) for f in frames for a, b, c in zip(f["commit_ts"], f["source_id"], f["payload"].where(f["payload"].notna(), None), strict=True)]
        out, held, released, more = fold(rows, seen, held, released, sources)
        dropped += more
        columns = list(zip(*held, strict=True)) or [[], [], []]
        state.update((list(seen), list(seen.values()), list(columns[0]), list(columns[1]), list(columns[2]), released, dropped))
        if out:
            yield pd.DataFrame([(key[0], a, b, c, dropped) for a, b, c in out], columns=["grp", "commit_ts", "source_id", "payload", "dropped"])

    keyed = stream.withColumn("grp", (F.lit("all") if group is None else group).cast("string")).select("grp", "commit_ts", "source_id", "payload")
    return keyed.groupBy("grp").applyInPandasWithState(run, OUT, STATE, "append", GroupStateTimeout.NoTimeout)
