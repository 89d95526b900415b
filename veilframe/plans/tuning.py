"""Session settings for masking: fast projections, recursion over tables of any size, and plans that keep the seed hidden."""

from __future__ import annotations

from pyspark.sql import SparkSession


_RECURSION_ROWS = "spark.sql.cteRecursionRowLimit"


def tune(spark: SparkSession) -> SparkSession:
    """Keep wide masking projections compiled, and let recursive tables grow with what they start from.

    Many masked columns in one projection make a generated method of more than 8000
    bytes, which HotSpot leaves interpreted: several times slower. With this limit
    Spark splits such a projection into small methods instead.

    A recursive table fails at a million rows unless the session says otherwise; the turns it may
    take stay limited.
    """
    spark.conf.set("spark.sql.codegen.hugeMethodLimit", "8000")
    if not spark.conf.get(_RECURSION_ROWS, None):
        spark.conf.set(_RECURSION_ROWS, "-1")
    return spark


_REDACTED_TEXT = "spark.sql.redaction.string.regex"


# How the salt of a hash stands in a plan: told by its shape, so that the setting does not hold it.
_SALT_OF_HASH = r"(?s)sha2\(cast\(concat\(.*?:, "


def hide_in_plans(spark: SparkSession) -> None:
    """Blank the seed of pseudonyms in EXPLAIN output and plan descriptions.

    The seed is a literal of the masking expressions; whoever reads it in a plan can look
    pseudonyms up.
    """
    before = spark.conf.get(_REDACTED_TEXT, None)
    if not before:
        spark.conf.set(_REDACTED_TEXT, _SALT_OF_HASH)
    elif _SALT_OF_HASH not in before:
        spark.conf.set(_REDACTED_TEXT, f"{before}|{_SALT_OF_HASH}")
