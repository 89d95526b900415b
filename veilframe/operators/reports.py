"""Reports on what is personal and how it is masked.

Each is a DataFrame. The text forms collect lines of catalog size, one per column.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import vocabulary as V
from ..policy import Policy

_STYLES_DDL = "style_table string, style_column string, own_style string"


def _percent(confidence: Column) -> Column:
    return F.format_string("%.0f%%", confidence * 100)


def _table_key() -> Column:
    return F.concat_ws(".", "table_schema", "table_name")


def pii_report(
    spark: SparkSession,
    classified: DataFrame,
    policy: Policy,
    table_filter: str | None = None,
) -> DataFrame:
    """One row per column with its classification and effective masking style.

    ``classified`` comes from ``classify_columns`` or ``scan_tables``. A column that is
    not personal has style ``none``; a secret is always masked in full.
    """
    if table_filter is not None:
        classified = classified.where(
            (F.col("table_name") == table_filter) | (_table_key() == table_filter)
        )
    rows = [(table, column, style) for (table, column), style in policy.styles.items()]
    styles = spark.createDataFrame(rows, _STYLES_DDL)
    joined = classified.join(
        styles,
        (F.col("style_table") == F.lower(_table_key()))
        & (F.col("style_column") == F.lower("column_name")),
        "left",
    )
    style = (
        F.when(F.col("entity_type").isNull(), F.lit("none"))
        .when(F.col("entity_type") == "SECRET", F.lit("full"))
        .otherwise(F.coalesce(F.col("own_style"), F.lit(policy.default_style)))
    )
    return joined.withColumn("masking_style", style).drop("style_table", "style_column", "own_style")


def schema_lines(report: DataFrame, show_pii: bool = True) -> DataFrame:
    """The report as text lines: ``table_key, position, line``; the heading is position 0."""
    heading = report.select(
        _table_key().alias("table_key"),
        F.lit(0).alias("position"),
        F.concat(F.lit(V.TABLE_HEADING), _table_key()).alias("line"),
    ).distinct()
    line = F.concat(F.lit("  "), F.col("column_name"), F.lit(": "), F.col("data_type"))
    if show_pii:
        mark = F.concat(
            F.lit(V.PII_MARK),
            F.col("entity_type"),
            F.lit(" ("),
            F.col("source"),
            F.lit(", "),
            _percent(F.col("confidence")),
            F.lit(V.STYLE_ARROW),
            F.col("masking_style"),
        )
        line = F.concat(line, F.coalesce(mark, F.lit("")))
    body = report.select(_table_key().alias("table_key"), "position", line.alias("line"))
    return heading.unionByName(body)


def schema_text(report: DataFrame, table_filter: str | None = None, show_pii: bool = True) -> str:
    """The schema as readable text, tables apart by a blank line."""
    lines = schema_lines(report, show_pii).orderBy("table_key", "position").collect()
    if not lines:
        return V.NO_SUCH_TABLE.format(table=table_filter) if table_filter else V.NO_TABLES
    out: list[str] = []
    for row in lines:
        if row["position"] == 0 and out:
            out.append("")
        out.append(row["line"])
    return "\n".join(out)


def rule_lines(report: DataFrame) -> DataFrame:
    """``rule_key, line`` for every classified or excluded column of a report."""
    key = F.concat_ws(".", "table_schema", "table_name", "column_name")
    classified = F.concat(
        F.lit("  "),
        key,
        F.lit(": "),
        F.col("entity_type"),
        F.lit(" ("),
        F.col("source"),
        F.lit(", "),
        _percent(F.col("confidence")),
        F.lit(V.STYLE_ARROW),
        F.col("masking_style"),
    )
    excluded = F.concat(F.lit("  "), key, F.lit(V.EXCLUDED_NOTE))
    return report.where("entity_type is not null or excluded").select(
        key.alias("rule_key"),
        F.when(F.col("excluded"), excluded).otherwise(classified).alias("line"),
    )


def rule_text(report: DataFrame) -> str:
    """The rule list as text, sorted by column."""
    lines = rule_lines(report).orderBy("rule_key").collect()
    if not lines:
        return V.NO_RULES
    return "\n".join([V.RULES_HEADING, "", *(row["line"] for row in lines)])


def findings_by(findings: DataFrame, *keys: str) -> DataFrame:
    """Findings counted by entity type and the given columns, with distinct values."""
    return findings.groupBy(*keys, "entity_type").agg(
        F.count(F.lit(1)).alias("findings"), F.countDistinct("value").alias("distinct_values")
    )


__all__ = [
    "findings_by",
    "pii_report",
    "rule_lines",
    "rule_text",
    "schema_lines",
    "schema_text",
]
