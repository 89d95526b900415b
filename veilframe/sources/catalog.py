"""Columns of tables as a DataFrame, from schemas or from the session catalog."""

from __future__ import annotations

from collections.abc import Iterable, Mapping

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

COLUMNS_DDL = (
    "table_schema string, table_name string, column_name string, "
    "position int, data_type string, is_nullable boolean"
)


def _rows(schema_name: str, table: str, schema: T.StructType) -> list[tuple]:
    return [
        (schema_name, table, f.name, i, f.dataType.simpleString(), f.nullable)
        for i, f in enumerate(schema.fields, 1)
    ]


def columns_of(spark: SparkSession, tables: Mapping[str, DataFrame]) -> DataFrame:
    """One row per column of the given tables, keyed ``schema.table``; metadata only."""
    rows = []
    for key, df in tables.items():
        schema_name, _, table = key.rpartition(".")
        rows += _rows(schema_name, table, df.schema)
    return spark.createDataFrame(rows, COLUMNS_DDL)


def catalog_columns(spark: SparkSession, schemas: Iterable[str]) -> DataFrame:
    """One row per column of every catalog table in ``schemas``, in table order."""
    rows = []
    for schema_name in schemas:
        for table in spark.catalog.listTables(schema_name):
            if not table.isTemporary:
                schema = spark.table(f"{schema_name}.{table.name}").schema
                rows += _rows(schema_name, table.name, schema)
    return spark.createDataFrame(rows, COLUMNS_DDL).orderBy(
        "table_schema", "table_name", "position"
    )


def table_list(columns: DataFrame) -> DataFrame:
    """Sorted ``schema.table`` names."""
    key = F.concat_ws(".", "table_schema", "table_name").alias("table_key")
    return columns.select(key).distinct().orderBy("table_key")
