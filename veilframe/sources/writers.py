"""Writing results, with the number of rows written, and scratch space to write to."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F


def shared_folder(spark: SparkSession, purpose: str, base: str | None = None) -> str:
    """A fresh path under a folder that the whole cluster shares.

    ``base`` names the folder; else it is the setting ``spark.checkpoint.dir``, or the checkpoint
    folder of the context. Without any, executors would write to disks of their own, so this raises.
    """
    base = base or spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not base:
        raise ValueError("no shared folder: set spark.checkpoint.dir or name one")
    return f"{base.rstrip('/')}/{purpose}-{uuid.uuid4().hex}"


def write_with_count(
    df: DataFrame,
    path: str | None = None,
    table: str | None = None,
    fmt: str = "parquet",
    mode: str = "append",
    partition_by: tuple[str, ...] = (),
) -> int:
    """Write ``df`` and return the rows written, counted in the same pass."""
    if (path is None) == (table is None):
        raise ValueError("give either a path or a table")
    seen = Observation()
    writer = df.observe(seen, F.count(F.lit(1)).alias("rows")).write.mode(mode).format(fmt)
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    if path is not None:
        writer.save(path)
    else:
        writer.saveAsTable(table)
    return seen.get["rows"]
