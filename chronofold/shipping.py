"""What a session's driver and executors share: this package, and a folder."""

from __future__ import annotations

import os
import tempfile
import zipfile

from pyspark.sql import SparkSession

_shipped: set[str] = set()
_own: dict[str, str] = {}


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share: what spark.checkpoint.dir names, or the context's checkpoint folder.

    Where neither is set, a local session (tests) gets a folder of its own; on a cluster that is an error.
    """
    context = spark.sparkContext
    named = spark.conf.get("spark.checkpoint.dir", None) or context.getConf().get("spark.checkpoint.dir") or context.getCheckpointDir()
    if named:
        return named.rstrip("/")
    if not context.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
    if context.applicationId not in _own:
        _own[context.applicationId] = f"file://{tempfile.mkdtemp(prefix='shared-')}"
    return _own[context.applicationId]


def checkpoint_folder(spark: SparkSession) -> None:
    """Make sure that checkpoint() has a folder."""
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(shared_folder(spark))


def ship(spark: SparkSession) -> None:
    """Python workers import this package wherever they run, whether or not it is installed there."""
    context = spark.sparkContext
    if context.applicationId in _shipped:
        return
    root = os.path.dirname(os.path.abspath(__file__))
    path = os.path.join(tempfile.mkdtemp(prefix="package-"), "chronofold.zip")
    with zipfile.ZipFile(path, "w") as out:
        for folder, _, names in os.walk(root):
            for name in sorted(names):
                if name.endswith(".py"):
                    full = os.path.join(folder, name)
                    out.write(full, os.path.join("chronofold", os.path.relpath(full, root)))
    context.addPyFile(path)
    _shipped.add(context.applicationId)
