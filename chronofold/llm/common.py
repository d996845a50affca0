"""What the training-data operators share: words, hashes, settled tables, size checks."""

from __future__ import annotations

import atexit
import uuid

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chronofold.shipping import shared_folder, ship

#: Rows in an Arrow batch handed to Python. Texts may be long, so batches are short.
BATCH_ROWS = 256
#: A key column or a small table of at most so many rows may be broadcast.
BROADCAST_ROWS = 4_000_000

#: Characters of a plan's text that the driver keeps for each of its last thousand executions.
PLAN_CHARS = 4096

_settled: list[tuple[SparkSession, str]] = []


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def arrow_batches(spark: SparkSession, rows: int = BATCH_ROWS) -> None:
    """Before Python runs on executors: they get this package, and short Arrow batches, as a worker's memory follows the batch.

    All operators take batches of the same size, as a plan reads the setting when it runs, not when it is made.
    """
    ship(spark)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))


def _drop(spark: SparkSession, path: str) -> None:
    try:
        jvm = spark.sparkContext._jvm
        at = jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)
    except Exception:  # the session has ended; the folder's owner clears it
        pass


def _drop_all() -> None:
    while _settled:
        _drop(*_settled.pop())


atexit.register(_drop_all)


def fresh_path(spark: SparkSession, what: str) -> str:
    """A new path in the shared folder, removed when the driver ends."""
    path = f"{shared_folder(spark)}/{what}-{uuid.uuid4().hex}"
    _settled.append((spark, path))
    return path


def settle(df: DataFrame, what: str = "settled") -> DataFrame:
    """Write ``df`` as a table in the shared folder and read it: lineage ends there, and a lost executor loses nothing."""
    spark = df.sparkSession
    spark.conf.set("spark.sql.maxPlanStringLength", str(PLAN_CHARS))  # many small executions follow one another
    path = fresh_path(spark, what)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def unsettle(df: DataFrame) -> None:
    """Remove the files of a settled table that no later plan reads."""
    spark = df.sparkSession
    for f in {x.rpartition("/")[0] for x in df.inputFiles()}:
        for s, path in list(_settled):
            if f.split(":", 1)[-1].lstrip("/") == path.split(":", 1)[-1].lstrip("/"):
                _drop(s, path)
                _settled.remove((s, path))


def maybe_broadcast(df: DataFrame, rows: int, most: int = BROADCAST_ROWS) -> DataFrame:
    """``df`` marked for broadcast if it has few rows; else as it is, and the join shuffles."""
    return F.broadcast(df) if rows <= most else df


def free_name(df: DataFrame, name: str) -> str:
    """``name``, made longer until ``df`` has no column of that name."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def words_of(text: bytes | None) -> list[bytes]:
    """Words ``[^\\x20\\x09-\\x0D]+`` of the text with A-Z in lower case. bytes.split() and lower() know ASCII only."""
    return text.lower().split() if text else []


def hashed(words: list[bytes]) -> np.ndarray:
    """64-bit keyed hash of each word, the same on every machine."""
    if not words:
        return np.zeros(0, np.uint64)
    column = np.empty(len(words), object)
    column[:] = words
    return pd.util.hash_array(column, categorize=False)


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijective mixer of 64-bit values (the splitmix64 finaliser)."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def shingle_hashes(words: np.ndarray, width: int) -> np.ndarray:
    """Hash of each run of ``width`` words, in order; of the whole sequence if it is shorter; none without words."""
    n = len(words)
    if not n:
        return np.zeros(0, np.uint64)
    size = min(width, n)
    out = np.full(n - size + 1, size, np.uint64)
    for j in range(size):
        out = mixed(out * np.uint64(0x9E3779B97F4A7C15) + words[j : n - size + 1 + j])
    return out


def in_fold(column: str, modulus: int, remainder: int):
    """True where crc32 of the id as text leaves this remainder. A null id counts as in no fold."""
    return F.coalesce(F.crc32(F.col(column).cast("string").cast("binary")) % modulus == remainder, F.lit(False))
