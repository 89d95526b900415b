"""Samples, votes and scans, against the plain definition."""

import hashlib
import random

import pytest
from pyspark.sql import functions as F

from veilframe import Policy, Rule, json_columns, json_keys, redact, sample_columns, scan_tables, vote_columns
from veilframe.operators.classify import classify_columns, decisions_from_rules, remember
from veilframe.operators.reports import pii_report
from veilframe.sources.catalog import catalog_columns, columns_of, table_list


def brute(values, limit):
    ranked = sorted({v for v in values if v is not None}, key=lambda v: hashlib.sha256(v.encode()).hexdigest())
    return sorted(v for v in ranked[:limit] if v)


@pytest.mark.parametrize("limit", [1, 5, 100])
def test_sample_is_the_smallest_hashes(spark, limit):
    rng = random.Random(1)
    hot = ["hot"] * 3000
    columns = {
        "few": [rng.choice(["a", "b", "", " ", None]) for _ in range(9000)],
        "many": [f"v{rng.randrange(6000)}" for _ in range(9000)],
        "skewed": hot + [f"s{i}" for i in range(6000)],
        "unique": [f"{i}" for i in range(9000)],
        "empty": [None] * 9000,
    }
    df = spark.createDataFrame(list(zip(*columns.values())), ", ".join(f"{c} string" for c in columns)).repartition(7)
    got = {}
    for r in sample_columns(df, limit=limit).collect():
        got.setdefault(r["column_name"], []).append(r["value"])
    for name, values in columns.items():
        assert sorted(got.get(name, [])) == brute(values, limit), name


def test_samples_are_text(spark):
    df = spark.createDataFrame([(1, 2.5, True, bytearray(b"hi"), None)], "i int, d double, b boolean, x binary, n string")
    assert {r[0]: r[1] for r in sample_columns(df).collect()} == {"i": "1", "d": "2.5", "b": "true", "x": "aGk="}


def votes(spark, samples):
    df = spark.createDataFrame([(c, v) for c, vs in samples.items() for v in vs], "column_name string, value string")
    return {r["column_name"]: (r["entity_type"], round(r["confidence"], 6), r["votes"], r["samples"]) for r in vote_columns(df).collect()}


def test_votes(spark):
    got = votes(
        spark,
        {
            "all": ["a@b.com", "c@d.com"],
            "fifth": ["a@b.com", "x", "y", "z", "  "],
            "below": ["a@b.com", "x", "y", "z", "  ", "w"],
            "several_in_one": ["a@b.com c@d.com", "x", "y", "z", "v", "w", "u", "t", "s", "r"],
            "tie": ["10.0.0.1", "a@b.com"],
            "majority": ["10.0.0.1 10.0.0.2", "a@b.com"],
            "nothing": ["x", "y"],
        },
    )
    assert got == {
        "all": ("EMAIL_ADDRESS", 1.0, 2, 2),
        "fifth": ("EMAIL_ADDRESS", 1.0, 1, 5),
        "several_in_one": ("EMAIL_ADDRESS", 1.0, 2, 10),
        "tie": ("EMAIL_ADDRESS", 1.0, 1, 2),
        "majority": ("IP_ADDRESS", 0.6, 2, 2),
    }


def test_votes_for_json(spark):
    samples = {
        "json": ['{"a": "x@y.org z@y.org"}', '["a@b.com"]', "x"],
        "mail": ['{"a": 1}', "a@b.com c@d.com", "d@e.com"],
        "plain": ["{a", "[", "z"],
    }
    df = spark.createDataFrame([(c, v) for c, vs in samples.items() for v in vs], "column_name string, value string")

    def winners(**kw):
        return {r["column_name"]: (r["entity_type"], r["votes"]) for r in vote_columns(df, **kw).collect()}

    assert winners(json_share=0.6) == {"json": ("JSON_CONTAINER", 2), "mail": ("EMAIL_ADDRESS", 3)}
    assert winners() == {"json": ("EMAIL_ADDRESS", 3), "mail": ("EMAIL_ADDRESS", 3)}


def test_scan_can_find_json_text(spark):
    df = spark.createDataFrame([('{"email": "a@b.com"}',)], "payload string")
    found = scan_tables(spark, {"public.t": df}, Policy(), json_share=0.9)
    policy = remember(Policy(), found)
    assert policy.entry("t", "payload").is_json
    assert redact(df, policy, ["t"]).first()[0] == '{"email": "a***@b***.com"}'


def test_scan_reads_only_silent_columns(spark):
    df = spark.createDataFrame(
        [(f"u{i}@x.org", "n", f"10.0.0.{i}", ("a",), "n@o.org") for i in range(30)],
        "a string, email string, host string, s struct<x:string>, shown string",
    )
    policy = Policy(rules=(Rule("t", "shown", "none"),))
    found = scan_tables(spark, {"public.t": df}, policy)
    rows = {r["column_name"]: (r["entity_type"], r["source"], r["confidence"], r["is_json"], r["excluded"]) for r in found.collect()}
    assert rows == {
        "a": ("EMAIL_ADDRESS", "values", 1.0, False, False),
        "email": ("EMAIL_ADDRESS", "heuristic", 0.9, False, False),
        "host": ("IP_ADDRESS", "values", 0.6, False, False),
        "s": ("JSON_CONTAINER", "heuristic", 1.0, True, False),
        "shown": (None, None, None, None, True),
    }
    known = remember(policy, found)
    assert known.entry("t", "host").source == "values"
    assert known.entry("t", "shown") == "excluded"


def test_rules_on_columns(spark):
    columns = columns_of(spark, {"public.users": spark.createDataFrame([], "Email string, custom string, notes string"),
                                 "web.users": spark.createDataFrame([], "email string")})
    rules = spark.createDataFrame(
        [("users", "email", "none"), ("USERS", "custom", "US_SSN"), ("web.users", "email", "PERSON"), ("users", "nope", "PERSON")],
        "table string, column string, pii_type string",
    )
    got = {
        (r["table_schema"], r["column_name"]): (r["entity_type"], r["source"], r["excluded"])
        for r in classify_columns(columns, decisions_from_rules(rules)).collect()
    }
    assert got == {
        ("public", "Email"): (None, None, True),
        ("public", "custom"): ("US_SSN", "manual", False),
        ("public", "notes"): ("FREE_TEXT", "heuristic", False),
        ("web", "email"): ("PERSON", "manual", False),
    }


def test_of_several_rules_the_last_holds(spark):
    from pyspark.errors import PySparkException

    given = [(1, "t", "a", "PERSON"), (2, "T", "A", "none"), (3, "public.t", "a", "US_SSN")]
    rules = spark.createDataFrame(given, "n int, table string, column string, pii_type string")
    assert decisions_from_rules(rules, order="n").first()["entity_type"] == "US_SSN"
    policy = Policy(rules=tuple(Rule(*r[1:]) for r in given))
    assert policy.entry("t", "a").entity_type == policy.rule("t", "a").pii_type == "US_SSN"
    with pytest.raises(PySparkException, match="rules differ"):
        decisions_from_rules(rules).collect()


def test_report_filter_and_styles(spark):
    policy = Policy(default_style="full", rules=(Rule("a.t", "email", "EMAIL_ADDRESS", "pseudonymize"),))
    columns = columns_of(spark, {"a.t": spark.createDataFrame([], "email string, id int"), "b.t": spark.createDataFrame([], "email string"), "b.u": spark.createDataFrame([], "x int")})
    classified = classify_columns(columns)

    def rows(table=None):
        report = pii_report(spark, classified, policy, table)
        return sorted((r["table_schema"], r["table_name"], r["column_name"], r["masking_style"]) for r in report.collect())

    assert rows() == [("a", "t", "email", "pseudonymize"), ("a", "t", "id", "none"), ("b", "t", "email", "full"), ("b", "u", "x", "none")]
    assert len(rows("t")) == 3 and len(rows("b.t")) == 1 and rows("z") == []


def test_catalog(spark):
    spark.sql("CREATE DATABASE IF NOT EXISTS shop")
    spark.sql("CREATE TABLE IF NOT EXISTS shop.users (id INT, email STRING, data STRUCT<a: STRING>) USING parquet")
    spark.sql("CREATE TABLE IF NOT EXISTS shop.basket (id INT) USING parquet")
    spark.range(1).createOrReplaceTempView("temporary_one")
    rows = [tuple(r) for r in catalog_columns(spark, ["shop"]).collect()]
    assert rows == [
        ("shop", "basket", "id", 1, "int", True),
        ("shop", "users", "id", 1, "int", True),
        ("shop", "users", "email", 2, "string", True),
        ("shop", "users", "data", 3, "struct<a:string>", True),
    ]
    assert [r[0] for r in table_list(catalog_columns(spark, ["shop"])).collect()] == ["shop.basket", "shop.users"]


def test_json_keys_and_columns(spark):
    df = spark.createDataFrame(
        [('{"email": 1, "notes": 2}', "a", "[1]"), ('{"email": [{"zip": 4, "e\\u006dail": "k\\": 1"}]}', "{b", "x"), ('not "json":', "c", "[2")],
        "j string, s string, half string",
    )
    assert {r[0]: r[1] for r in json_keys(df, "j").collect()} == {"email": "EMAIL_ADDRESS", "notes": None, "zip": "LOCATION"}
    found = {r["column_name"]: (r["samples"], round(r["json_share"], 2)) for r in json_columns(df, df.columns, share=0.3).collect()}
    assert found == {"j": (3, 0.67), "half": (3, 0.33)}


def test_the_sample_never_shuffles_all_values(spark):
    df = spark.range(50_000).select(F.concat(F.lit("v"), "id").alias("a"), (F.col("id") % 3).alias("b"))
    out = sample_columns(df, limit=10)
    out.collect()
    plan = out._jdf.queryExecution().executedPlan()
    text = plan.toString()
    assert "SortAggregate" not in text and "Python" not in text and "CartesianProduct" not in text
