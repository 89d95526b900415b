"""Which columns are personal: by rule, by type, by name, and by a vote on values."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import vocabulary as V
from ..functions.jsontext import json_text_keys, looks_like_json
from ..functions.names import (
    JSON_CLASSIFICATION,
    Classification,
    classify_column_name,
    entity_of_key,
    name_classification,
)
from ..functions.nested import is_json_like
from ..policy import Policy
from ..sources.catalog import columns_of
from .sampling import sample_columns, vote_tables

INFO = ("entity_type", "confidence", "source", "is_free_text", "is_json")
DECISIONS_DDL = (
    "table_key string, column_key string, entity_type string, confidence double, "
    "source string, is_free_text boolean, is_json boolean, excluded boolean"
)
_JSON_TYPES = r"^(json|jsonb|variant|(array<)*(struct<|map<|variant))"


def decisions_from_rules(
    rules: DataFrame, default_schema: str = "public", order: str | None = None
) -> DataFrame:
    """Rules (``table, column, pii_type``) as decisions, one per column.

    As in a policy, of several rules for a column the last one holds: the one with the largest
    ``order``. Without such a column, rules that differ are an error when they are used.
    """
    table = F.lower("table")
    pii = F.col("pii_type")
    if order is None:
        differ = F.raise_error(F.concat(F.lit("rules differ for "), "table_key", F.lit("."), "column_key"))
        last = F.when(F.min(pii) == F.max(pii), F.min(pii)).otherwise(differ)
    else:
        last = F.max_by(pii, F.col("order"))
    return (
        rules.select(
            F.when(F.contains(table, F.lit(".")), table)
            .otherwise(F.concat(F.lit(f"{default_schema}."), table))
            .alias("table_key"),
            F.lower("column").alias("column_key"),
            "pii_type",
            F.col(order or "pii_type").alias("order"),
        )
        .groupBy("table_key", "column_key")
        .agg(last.alias("pii_type"))
        .select(
            "table_key",
            "column_key",
            F.nullif(pii, F.lit(V.NOT_PERSONAL)).alias("entity_type"),
            F.lit(V.MANUAL_CONFIDENCE).alias("confidence"),
            F.lit("manual").alias("source"),
            (pii == V.FREE_TEXT).alias("is_free_text"),
            (pii == V.JSON_CONTAINER).alias("is_json"),
            (pii == V.NOT_PERSONAL).alias("excluded"),
        )
    )


def decisions_from_policy(spark: SparkSession, policy: Policy) -> DataFrame:
    """What the policy has recorded, one row per column."""
    rows = []
    for (table, column), info in policy.entries.items():
        if isinstance(info, Classification):
            rows.append((table, column, *(getattr(info, name) for name in INFO), False))
        else:
            rows.append((table, column, None, None, "manual", False, False, True))
    return spark.createDataFrame(rows, DECISIONS_DDL)


def classify_columns(
    columns: DataFrame, decisions: DataFrame | None = None, auto_detect: bool = True
) -> DataFrame:
    """Add the classification of every column of a columns DataFrame.

    A decision wins over the type, the type over the name; without ``auto_detect`` only
    decisions count. ``excluded`` marks a column declared not personal. A projection,
    plus one join if there are decisions.
    """
    by_type = F.when(
        F.lower("data_type").rlike(_JSON_TYPES),
        F.struct(*[F.lit(getattr(JSON_CLASSIFICATION, name)).alias(name) for name in INFO]),
    )
    info = F.coalesce(by_type, classify_column_name(F.col("column_name")))
    if not auto_detect:
        info = F.when(F.lit(False), info)
    judged = columns.withColumn("info", info)
    if decisions is None:
        return judged.select(
            *columns.columns, *[F.col(f"info.{n}").alias(n) for n in INFO], F.lit(False).alias("excluded")
        )
    made = decisions.select("table_key", "column_key", F.struct(*INFO).alias("made"), "excluded")
    key = F.lower(F.concat_ws(".", "table_schema", "table_name"))
    joined = judged.join(
        made,
        (F.col("table_key") == key) & (F.col("column_key") == F.lower("column_name")),
        "left",
    )

    def pick(name: str) -> Column:
        return F.when(F.col("made").isNull(), F.col(f"info.{name}")).when(
            ~F.col("excluded"), F.col(f"made.{name}")
        )

    return joined.select(
        *columns.columns,
        *[pick(name).alias(name) for name in INFO],
        F.coalesce(F.col("excluded"), F.lit(False)).alias("excluded"),
    )


def json_keys(df: DataFrame, column: str) -> DataFrame:
    """Distinct keys of a JSON text column, at every depth, with the entity each names."""
    # Distinct first within the row, then before the shuffle: keys repeat in every row.
    keys = df.select(F.explode(json_text_keys(F.col(column))).alias("key")).distinct()
    return keys.select("key", entity_of_key(F.col("key")).alias("entity_type"))


def json_columns(
    df: DataFrame, columns: Sequence[str], limit: int = 100, share: float = 1.0
) -> DataFrame:
    """Text columns whose sampled values are JSON objects or arrays.

    Columns: ``column_name, samples, json_share``; only those reaching ``share``.
    """
    looks = looks_like_json(F.col("value"))
    return (
        sample_columns(df, columns, limit)
        .groupBy("column_name")
        .agg(
            F.count(F.lit(1)).alias("samples"),
            F.avg(looks.cast("double")).alias("json_share"),
        )
        .where(F.col("json_share") >= share)
    )


def scan_tables(
    spark: SparkSession,
    tables: Mapping[str, DataFrame],
    policy: Policy,
    json_share: float | None = None,
) -> DataFrame:
    """Classify every column of the tables, reading values only where a name is silent.

    Recorded entries are reused, then types and names are judged from the schemas.
    The columns left over are sampled and voted on, all tables together. With
    ``json_share``, text columns whose samples are JSON to that share are JSON too.
    Columns: those of ``columns_of`` plus the classification and ``excluded``.
    """
    silent = {}
    for key, df in tables.items():
        names = [
            f.name
            for f in df.schema.fields
            if policy.entry(key, f.name) is None
            and not is_json_like(f.dataType)
            and name_classification(f.name) is None
        ]
        silent[key] = (df, names)
    columns = columns_of(spark, tables)
    judged = classify_columns(columns, decisions_from_policy(spark, policy))
    votes = vote_tables(silent, policy.sample_size, policy.recognizers, json_share)
    if votes is None:
        return judged
    voted = votes.select(
        "table_key",
        F.col("column_name").alias("voted_column"),
        F.struct(
            "entity_type",
            "confidence",
            F.lit("values").alias("source"),
            F.lit(False).alias("is_free_text"),
            (F.col("entity_type") == V.JSON_CONTAINER).alias("is_json"),
        ).alias("vote"),
    )
    joined = judged.join(
        voted,
        (F.concat_ws(".", "table_schema", "table_name") == F.col("table_key"))
        & (F.col("column_name") == F.col("voted_column")),
        "left",
    )
    return joined.select(
        *columns.columns,
        *[
            F.when(F.col("vote").isNotNull(), F.col(f"vote.{n}")).otherwise(F.col(n)).alias(n)
            for n in INFO
        ],
        "excluded",
    )


def remember(policy: Policy, classified: DataFrame) -> Policy:
    """Record a scan in the policy: one entry per column of the scanned tables."""
    found = {}
    for row in classified.where("entity_type is not null").collect():
        info = Classification(*(row[name] for name in INFO))
        found[f"{row['table_schema']}.{row['table_name']}", row["column_name"]] = info
    return policy.with_classifications(found)
