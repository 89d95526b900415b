"""Work that is dear per row is dealt over all cores, however few pieces its table comes in."""

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as contract
from veilframe import mask_json_text
from veilframe.functions import jsontext
from veilframe.sources.readers import spread

SPREAD = ["secret_json_values", "mask_json_text", "json_or_prose", "redact_found_json", "json_column_by_rule", "mask_variant", "mask_json_text_pseudonymized"]


@pytest.fixture(scope="module")
def one_piece(spark, tmp_path_factory):
    folder = str(tmp_path_factory.mktemp("tables"))
    ids = spark.range(1, 401).withColumn("id", F.expr("nullif(id % 200, 7)"))  # keys that repeat or miss
    people = ids.selectExpr(
        "id AS c_custkey", "concat('Customer#', id) AS c_name", "cast(id % 25 AS int) AS c_nationkey",
        "id / 7D AS c_acctbal", "if(id % 9 = 0, NULL, 'BUILDING') AS c_mktsegment",
    )
    people.coalesce(1).write.parquet(f"{folder}/customer.parquet")
    return folder


def rows(df):
    return sorted(map(repr, df.collect()))


def test_rows_stay(spark, one_piece):
    table = spark.read.parquet(f"{one_piece}/customer.parquet")
    assert table.rdd.getNumPartitions() == 1
    dealt = spread(table)
    assert rows(dealt) == rows(table)
    sizes = dealt.groupBy(F.spark_partition_id()).count().collect()
    assert len(sizes) == 4 * spark.sparkContext.defaultParallelism
    assert spread(table.repartition(40)).rdd.getNumPartitions() == 40


@pytest.mark.parametrize("name", SPREAD)
def test_every_core_masks(spark, one_piece, name):
    out = contract.queries()[name](spark, one_piece)
    assert out.count() == 400
    assert out.select(F.spark_partition_id().alias("p")).distinct().count() >= spark.sparkContext.defaultParallelism


def test_a_text_with_secrets_is_rewritten_once(spark):
    texts = spark.createDataFrame([('{"otp_secret": [1, {"a": "b"}], "n": 2}',)], "j string")
    masked = texts.select(mask_json_text(F.col("j")).alias("j"))
    assert masked.first().j == '{"otp_secret": "[REDACTED]", "n": 2}'
    plan = masked._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count(jsontext._STEP) == 1
