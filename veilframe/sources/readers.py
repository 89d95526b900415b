"""Where tables and rules come from."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ..plans.lineage import tagged_schema
from ..policy import Policy, Rule

RULES_DDL = "table string, column string, pii_type string, masking_style string"


def read_table(
    spark: SparkSession, path: str, fmt: str = "parquet", table_key: str | None = None, **options: str
) -> DataFrame:
    """Any file format Spark reads; with a table key, tagged down to nested fields."""
    reader = spark.read.format(fmt).options(**options)
    found = reader.load(path)
    if table_key is None:
        return found
    return reader.schema(tagged_schema(found.schema, table_key)).load(path)


def spread(df: DataFrame) -> DataFrame:
    """The rows of a table just read, dealt out over all cores.

    A small file, or one of a single row group, is read by one task, which then also does whatever is
    done with its rows. For work that is dear per row, such as masking JSON, dealing them out first pays.
    """
    tasks = 4 * df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(max(tasks, df.rdd.getNumPartitions()))


def read_jdbc(
    spark: SparkSession,
    url: str,
    table: str,
    partition_column: str | None = None,
    lower: int | None = None,
    upper: int | None = None,
    partitions: int = 64,
    fetch_size: int = 10_000,
    **properties: str,
) -> DataFrame:
    """A relational table; with a partition column, read by many executors at once."""
    reader = (
        spark.read.format("jdbc")
        .option("url", url)
        .option("dbtable", table)
        .option("fetchsize", fetch_size)
        .options(**properties)
    )
    if partition_column is not None:
        if lower is None or upper is None:
            raise ValueError("a partition column needs its lower and upper bound")
        reader = (
            reader.option("partitionColumn", partition_column)
            .option("lowerBound", lower)
            .option("upperBound", upper)
            .option("numPartitions", partitions)
        )
    return reader.load()


def read_rules(spark: SparkSession, path: str, fmt: str = "json") -> DataFrame:
    """Masking rules as a DataFrame; a missing style means partial."""
    reader = spark.read.schema(RULES_DDL)
    if fmt == "csv":
        reader = reader.option("header", True)
    return reader.format(fmt).load(path).fillna({"masking_style": "partial"})


def policy_from_rules(rules: DataFrame, **settings) -> Policy:
    """A policy from a rules DataFrame. Rules are settings, a few per column at most."""
    return Policy(rules=tuple(Rule(**row.asDict()) for row in rules.collect()), **settings)
