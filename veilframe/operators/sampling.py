"""Distinct sample of every column, and the vote on what its values are.

The sample of a column is its ``limit`` distinct values with the smallest SHA-256,
so it does not depend on partitioning. Finding them must not sort or shuffle every
distinct value, which for text columns is the whole table:

1. per column, put the values of some of the rows into ``4 * limit`` buckets and keep
   the smallest SHA-256 of each. This is a fixed-width minimum, combined before the
   shuffle.
2. the ``limit``-th smallest of those minima bounds the sample from above: that many
   distinct values lie at or below it, whichever rows were looked at. One bound per
   column comes to the driver and goes into the plan as a literal.
3. every value of every row is compared with the bound, and those at or below it are
   made distinct and ranked: about ``10 * limit`` per column, however large or skewed
   the table is. A column with too few buckets in use has few distinct values among
   the rows looked at and gets no bound.

The bound only saves work: the sample is taken from all rows and is exact.
"""

from __future__ import annotations

from collections.abc import Iterable, Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import vocabulary as V
from ..functions.jsontext import looks_like_json
from ..functions.masks import is_blank
from ..functions.prose import DEFAULT_RECOGNIZERS, Recognizer, findings
from ..plans.lineage import quoted

_BUCKETS_PER_VALUE = 4
_ROWS_FOR_BOUND = 0.125


# Tables by key, each with the columns to look at.
Tables = Mapping[str, tuple[DataFrame, Sequence[str]]]


def _as_text(field: T.StructField) -> Column:
    value = F.col(quoted(field.name))
    return F.base64(value) if isinstance(field.dataType, T.BinaryType) else value.cast("string")


def _long_form(
    key: str, df: DataFrame, columns: Sequence[str], bounds: Mapping[tuple[str, str], str]
) -> DataFrame:
    """``(table_key, column_name, value)`` for every non-null value under its bound."""
    fields = {f.name: f for f in df.schema.fields}

    def text(name: str) -> Column:
        value = _as_text(fields[name])
        bound = bounds.get((key, name))
        return value if bound is None else F.when(F.sha2(value, 256) < bound, value)

    # The comparison stands before the unpivot, so that most values never become rows.
    return (
        df.select(*[text(name).alias(name) for name in columns])
        .unpivot([], [F.col(quoted(name)) for name in columns], "column_name", "value")
        .where("value is not null")
        .select(F.lit(key).alias("table_key"), "column_name", "value")
    )


def _all(parts: Iterable[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, parts)


def _bounds(tables: Tables, limit: int) -> dict[tuple[str, str], str]:
    """For each column, a text just above the digests its sample can have."""
    looked_at = _all(
        _long_form(key, df.sample(_ROWS_FOR_BOUND, seed=1), columns, {})
        for key, (df, columns) in tables.items()
    )
    # The first 60 bits of the digest as a number, which is ordered like the digest.
    head = F.conv(F.substring(F.sha2("value", 256), 1, 15), 16, 10).cast("bigint")
    minima = (
        looked_at.select("table_key", "column_name", head.alias("head"))
        .groupBy(
            "table_key", "column_name", (F.col("head") % (_BUCKETS_PER_VALUE * limit)).alias("bucket")
        )
        .agg(F.min("head").alias("head"))
    )
    nth = Window.partitionBy("table_key", "column_name").orderBy("head")
    rows = minima.withColumn("n", F.row_number().over(nth)).where(F.col("n") == limit).collect()
    # "g" sorts behind every hex digit.
    return {(r["table_key"], r["column_name"]): f"{r['head']:015x}g" for r in rows}


def sample_tables(tables: Tables, limit: int | None = 100) -> DataFrame:
    """``sample_columns`` over several tables at once, with their ``table_key``.

    The bounds are found by a job of its own when this is called.
    """
    tables = {key: (df, columns) for key, (df, columns) in tables.items() if columns}
    if limit is None:
        return _all(_long_form(key, df, columns, {}) for key, (df, columns) in tables.items()).where("value <> ''")
    bounds = _bounds(tables, limit)
    candidates = _all(
        _long_form(key, df, columns, bounds) for key, (df, columns) in tables.items()
    ).distinct()
    ranked = Window.partitionBy("table_key", "column_name").orderBy(F.sha2("value", 256))
    return (
        candidates.withColumn("n", F.row_number().over(ranked))
        .where((F.col("n") <= limit) & (F.col("value") != ""))
        .select("table_key", "column_name", "value")
    )


def sample_columns(
    df: DataFrame, columns: Sequence[str] | None = None, limit: int | None = 100
) -> DataFrame:
    """Up to ``limit`` distinct non-null values of each column, as text.

    Without a limit every value of every row that is not empty: a vote over it is one aggregate,
    combined before the shuffle.

    Columns: ``column_name, value``. As in sampling with a row limit, empty strings
    count towards the limit and are dropped afterwards.
    """
    names = list(columns if columns is not None else df.columns)
    return sample_tables({"": (df, names)}, limit).drop("table_key")


_FINDING = "struct<entity_type:string,value:string,score:double>"


def vote_columns(
    samples: DataFrame,
    keys: Sequence[str] = ("column_name",),
    recognizers: Sequence[Recognizer] = DEFAULT_RECOGNIZERS,
    share: float = V.VOTE_SHARE,
    json_share: float | None = None,
) -> DataFrame:
    """The entity type each column's sampled values vote for, if any.

    Every finding is one vote. The type with most votes wins (the earlier recogniser
    on a tie) if its votes reach ``share`` of the samples, blank ones included. The
    confidence is the mean score of its findings. With ``json_share``, a column of
    which that share is JSON objects or arrays is JSON, whatever is found inside.
    """
    value = F.col("value")

    def entry(entity: str | None, score: float) -> Column:
        made = F.struct(F.lit(entity), F.lit(""), F.lit(score))
        return F.array(made.cast(_FINDING))

    nothing = F.array().cast(f"array<{_FINDING}>")
    found = F.when(is_blank(value), nothing).otherwise(findings(value, recognizers))
    if json_share is not None:
        as_json = F.when(looks_like_json(value), entry(V.JSON_CONTAINER, V.JSON_CONFIDENCE))
        found = F.concat(F.coalesce(as_json, nothing), found)
    # One shuffle counts the samples (the entry without a type) and the votes.
    per_entity = (
        samples.select(*keys, F.explode(F.concat(entry(None, 0.0), found)).alias("f"))
        .groupBy(*keys, F.col("f.entity_type").alias("entity_type"))
        .agg(F.count(F.lit(1)).alias("votes"), F.avg("f.score").alias("confidence"))
    )
    entity = F.col("entity_type")
    is_container = entity == V.JSON_CONTAINER
    order = {r.entity: i for i, r in reversed(list(enumerate(recognizers)))}
    rank_of = F.create_map(*[F.lit(x) for pair in order.items() for x in pair])
    whole = Window.partitionBy(*keys)
    counted = per_entity.withColumn(
        "samples", F.max(F.when(entity.isNull(), F.col("votes"))).over(whole)
    )
    needed = F.when(is_container, F.lit(json_share or 0.0)).otherwise(F.lit(0.0))
    best = whole.orderBy(F.desc(is_container), F.desc("votes"), F.element_at(rank_of, entity))
    return (
        counted.where(entity.isNotNull() & (F.col("votes") >= F.col("samples") * needed))
        .withColumn("n", F.row_number().over(best))
        .where((F.col("n") == 1) & (F.col("votes") >= F.col("samples") * share))
        .select(*keys, "entity_type", "confidence", "votes", "samples")
    )


def vote_tables(
    tables: Tables,
    limit: int | None = 100,
    recognizers: Sequence[Recognizer] = DEFAULT_RECOGNIZERS,
    json_share: float | None = None,
) -> DataFrame | None:
    """``vote_columns`` over several tables; None if there is nothing to read."""
    if not any(columns for _, columns in tables.values()):
        return None
    samples = sample_tables(tables, limit)
    keys = ("table_key", "column_name")
    return vote_columns(samples, keys, recognizers, json_share=json_share)
