"""As-of joins: for each row the last row of another table with the same key, up to its time.

Both sides meet in windows of one key and one slice of time, so a key that holds a large share of all
rows is spread over its slices. What a slice without an earlier row needs comes from the slices before:
one row for each key and slice is carried over, never the rows themselves.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T


def _slice_of(time: Column, dtype: T.DataType, width: float) -> Column:
    """The number of the slice that a time is in; widths of timestamps and dates are in seconds."""
    if isinstance(dtype, (T.TimestampType, T.TimestampNTZType)):
        return F.floor(F.unix_micros(time.cast("timestamp")) / (width * 1_000_000))
    if isinstance(dtype, T.DateType):
        return F.floor(F.unix_date(time) * 86_400 / width)
    return F.floor(time / width)


def asof_join(
    left: DataFrame,
    right: DataFrame,
    on: Sequence[str],
    time: str,
    take: Sequence[str],
    width: float,
    right_time: str | None = None,
    order: Sequence[str] = (),
    prefix: str = "",
) -> DataFrame:
    """``left`` with the columns ``take`` of the row of ``right`` that was the last up to ``time``.

    Rows match on equal ``on`` columns; of rows of one time the last by the columns ``order`` counts
    (else any). Left rows without a match have NULLs, as have those with a NULL key or time. Right rows
    with one are not looked at. ``width`` is the length of a slice of time, in seconds for timestamps and
    dates; the result does not depend on it. Taken columns are named with ``prefix`` and keep their
    metadata, lineage tags included.
    """
    right_time = right_time or time
    names = [f"{prefix}{c}" for c in take]
    clash = set(names) & set(left.columns)
    if clash:
        raise ValueError(f"columns would be there twice: {', '.join(sorted(clash))}; give a prefix")
    dtype = left.schema[time].dataType
    value = F.struct(*[right[c].alias(n) for c, n in zip(take, names, strict=True)])
    late = F.struct(right[right_time].alias("t"), *[right[c].alias(f"o{i}") for i, c in enumerate(order)])
    keys = [f"k{i}" for i in range(len(on))]
    known = right.where(right[right_time].isNotNull()).dropna(subset=list(on)).select(
        *[right[c].alias(k) for c, k in zip(on, keys, strict=True)],
        right[right_time].cast(dtype).alias("t"),
        F.lit(0).alias("side"),
        value.alias("v"),
        late.alias("late"),
    )
    asking = left.select(
        *[left[c].alias(k) for c, k in zip(on, keys, strict=True)],
        left[time].alias("t"),
        F.lit(1).alias("side"),
        F.struct(*[left[f"`{c}`"].alias(f"c{i}") for i, c in enumerate(left.columns)]).alias("row"),
    )
    both = known.unionByName(asking, allowMissingColumns=True).withColumn("slice", _slice_of(F.col("t"), dtype, width))
    # A right row comes before a left one of the same time.
    upto = Window.partitionBy(*keys, "slice").orderBy("t", "side", "late").rowsBetween(Window.unboundedPreceding, 0)
    within = both.withColumn("here", F.last("v", ignorenulls=True).over(upto)).where("side = 1")
    before = Window.partitionBy(*keys).orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)
    last = both.groupBy(*keys, "slice").agg(F.max_by("v", "late").alias("v"))
    carried = last.select(*keys, "slice", F.last("v", ignorenulls=True).over(before).alias("before"))
    same = [F.col(f"w.{c}").eqNullSafe(F.col(f"b.{c}")) for c in (*keys, "slice")]
    joined = within.alias("w").join(carried.where("before IS NOT NULL").alias("b"), same, "left")
    whole = F.coalesce(F.col("w.here"), F.col("b.before"))
    asked = F.col("w.row")
    no_match = F.col("w.slice").isNull()
    for k in keys:
        no_match = no_match | F.col(f"w.{k}").isNull()
    found = joined.select(asked.alias("row"), F.when(~no_match, whole).alias("found"))
    return found.select(
        *[F.col(f"row.c{i}").alias(c, metadata=left.schema[i].metadata) for i, c in enumerate(left.columns)],
        *[F.col(f"found.{n}").alias(n, metadata=right.schema[c].metadata) for c, n in zip(take, names, strict=True)],
    )
