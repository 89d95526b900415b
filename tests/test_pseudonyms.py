"""Pseudonyms that no two values share."""

import pytest
from pyspark.sql import functions as F

from veilframe.operators.pseudonyms import unique_pseudonyms


@pytest.fixture(scope="module", autouse=True)
def folder(spark, tmp_path_factory):
    if not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(str(tmp_path_factory.mktemp("shared")))


def test_as_many_as_values(spark):
    df = spark.range(150_000).select("id", F.lpad(F.col("id").cast("string"), 9, "0").alias("ssn"), F.format_string("(555) %07d", F.col("id") % 700).alias("phone"))
    out = unique_pseudonyms(df, {"ssn": "US_SSN", "phone": "PHONE_NUMBER"}, "s")
    pairs = df.join(out.withColumnsRenamed({"ssn": "s2", "phone": "p2"}), "id")
    counts = pairs.agg(*[F.count_distinct(*c) for c in (["ssn"], ["s2"], ["ssn", "s2"], ["phone"], ["p2"], ["phone", "p2"])], F.count("*")).first()
    assert tuple(counts) == (150_000, 150_000, 150_000, 700, 700, 700, 150_000)
    assert out.where(~F.col("ssn").rlike("^000-00-[0-9a-f]{4,}$") | ~F.col("phone").rlike("^555-000-[0-9a-f]{4}$")).count() == 0


def test_columns_of_one_type_share_numbers_and_odd_values_stay(spark):
    rows = [("a@b.c", "x@y.z", 1), ("x@y.z", None, 2), (" ", "a@b.c", 3), (None, "", 4)] + [("hot@b.c", "hot@b.c", 5)] * 3000
    df = spark.createDataFrame(rows, "`e.1` string, mail string, n int").withColumnRenamed("n", "mail2")
    got = unique_pseudonyms(df, {"e.1": "EMAIL_ADDRESS", "mail": "EMAIL_ADDRESS"}, "s").collect()
    assert len(got) == len(rows) and got[0].asDict().keys() == {"e.1", "mail", "mail2"}
    by = {r["mail2"]: r for r in got}
    assert by[1]["e.1"] == by[3]["mail"] and by[1]["mail"] == by[2]["e.1"] and by[5]["e.1"] == by[5]["mail"]
    assert len({by[1]["e.1"], by[2]["e.1"], by[5]["e.1"]}) == 3 and (by[2]["mail"], by[3]["e.1"], by[4]["e.1"], by[4]["mail"]) == (None, " ", None, "")
    assert unique_pseudonyms(df.limit(0), {"mail": "EMAIL_ADDRESS"}, "s").collect() == []


def test_a_store_keeps_numbers(spark, tmp_path):
    store = str(tmp_path / "numbers")
    first = spark.range(1000).select(F.concat(F.lit("user"), "id").alias("who"))
    names = {"who": "PERSON"}
    pairs = first.select("who", F.col("who").alias("was"))
    one = {r.was: r.who for r in unique_pseudonyms(pairs, names, "s", store).collect()}
    more = spark.range(500, 1500).select(F.concat(F.lit("user"), "id").alias("who")).select("who", F.col("who").alias("was"))
    two = {r.was: r.who for r in unique_pseudonyms(more, names, "s", store).collect()}
    assert all(one[w] == two[w] for w in one.keys() & two.keys()) and len(set(one.values()) | set(two.values())) == 1500
    kept = spark.read.parquet(store)
    assert kept.count() == 1500 and kept.agg(F.max("number")).first()[0] == 1499
    assert kept.where("key LIKE '%user%'").count() == 0


def test_numbers_do_not_depend_on_partitions(spark):
    df = spark.range(2000).select(F.col("id").cast("string").alias("v"), F.col("id"))
    one, many = ({r.id: r.v for r in unique_pseudonyms(df.repartition(n), {"v": "X"}, "s").collect()} for n in (1, 9))
    assert one == many and one[0].startswith("PSEUDO_")
