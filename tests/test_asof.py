"""As-of joins against a search by hand."""

import datetime
import random

import pytest

from veilframe import MaskedSession, Policy, redact
from veilframe.operators.asof import asof_join


def by_hand(left, right):
    out = []
    for k, t, n in left:
        fit = [(rt, o, v) for rk, rt, o, v in right if k is not None and t is not None and rk == k and rt is not None and rt <= t]
        out.append((k, t, n, max(fit)[2] if fit else None))
    return sorted(out, key=str)


@pytest.mark.parametrize("width", [0.5, 7, 100, 10_000])
def test_numbers(spark, width):
    r = random.Random(3)
    left = [(r.choice([1, 1, 1, 2, 3, None]), r.choice([None, *range(200)]), n) for n in range(400)]
    right = [(r.choice([1, 1, 2, 4, None]), r.choice([None, *range(50, 150)]), o, f"v{o}") for o in range(120)]
    got = asof_join(
        spark.createDataFrame(left, "k int, t int, n int"), spark.createDataFrame(right, "k int, t int, o int, v string"), ["k"], "t", ["v"], width, order=["o"]
    )
    assert got.columns == ["k", "t", "n", "v"]
    assert sorted(map(tuple, got.collect()), key=str) == by_hand(left, right)


def test_times_and_names(spark):
    at = datetime.datetime(2024, 1, 1)
    left = spark.createDataFrame([(1, at, "a"), (1, at + datetime.timedelta(days=40), "b"), (2, at, "c")], "k int, ts timestamp, `x.y` string")
    right = spark.createDataFrame([(1, at, "p"), (1, at + datetime.timedelta(seconds=1), "q"), (2, at + datetime.timedelta(days=1), "r")], "k int, at timestamp, `x.y` string")
    right = right.withColumnRenamed("x.y", "xy")
    got = asof_join(left, right, ["k"], "ts", ["xy", "at"], 3600, right_time="at", prefix="last_")
    assert {r["x.y"]: r["last_xy"] for r in got.collect()} == {"a": "p", "b": "q", "c": None}
    with pytest.raises(ValueError, match="twice"):
        asof_join(left, right, ["k"], "ts", ["k"], 3600, right_time="at")
    assert asof_join(left.limit(0), right, ["k"], "ts", ["xy"], 60, right_time="at").collect() == []
    assert {r["xy"] for r in asof_join(left, right.limit(0), ["k"], "ts", ["xy"], 60, right_time="at").collect()} == {None}


def test_lineage_is_kept(spark):
    users = spark.createDataFrame([(1, 1, "john@example.com"), (1, 5, "jane@test.org")], "k int, t int, email string")
    MaskedSession(spark, Policy()).register("users", users)
    right = spark.table("users").withColumnRenamed("email", "who")
    got = redact(asof_join(spark.createDataFrame([(1, 3)], "k int, t int"), right, ["k"], "t", ["who"], 2), Policy())
    assert tuple(got.first()) == (1, 3, "j***@e***.com")
