"""Redaction of streams. It is stateless: a projection per micro-batch."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from ..operators.redact import redact
from ..plans.lineage import tag_columns
from ..policy import Policy


def redact_stream(
    stream: DataFrame,
    policy: Policy,
    table: str | None = None,
    reveal_columns: Iterable[str] = (),
    reveal_types: Iterable[str] = (),
) -> DataFrame:
    """Mask a streaming DataFrame; ``table`` ties its columns to the policy's rules."""
    if table is not None:
        stream = tag_columns(stream, policy.table_key(table))
    return redact(stream, policy, (), reveal_columns, reveal_types)


def write_stream(
    masked: DataFrame, path: str, checkpoint: str, fmt: str = "parquet"
) -> StreamingQuery:
    """Write what is available exactly once and stop; ``checkpoint`` must be shared storage."""
    return (
        masked.writeStream.format(fmt)
        .option("path", path)
        .option("checkpointLocation", checkpoint)
        .outputMode("append")
        .trigger(availableNow=True)
        .start()
    )
