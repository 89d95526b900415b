"""Whitening against exact fractions and numpy, and odd rows."""

from fractions import Fraction

import numpy as np
import pytest

from veilframe.llm import queries, whitening

SCHEMA = "vec_id long, embedding array<float>, label int, n int, component string"


def vectors(spark, rows):
    return spark.createDataFrame([(i, v, 0, 1, "c") for i, v in rows], SCHEMA)


def by_hand(rows):
    """(id, component) to (n, deviation, whitened, explained), by exact covariances."""
    x = [[int(np.floor(1024 * float(np.float32(c)))) + 100_000 for c in v] for _, v in rows]
    n, dims = len(x), len(x[0])
    sums = [sum(r[d] for r in x) for d in range(dims)]
    off = [[n * r[d] - sums[d] for d in range(dims)] for r in x]
    v = np.array([[float(Fraction(sum(r[i] * r[j] for r in off), n**3)) for j in range(dims)] for i in range(dims)])
    e, u = np.linalg.eigh(v)
    e, u = e[::-1], u[:, ::-1]
    out = []
    for (i, _), r in zip(rows, off, strict=True):
        for k in range(min(8, dims)):
            out.append((i, k + 1, n, sum(d * d for d in r), float(np.array(r, float) / n @ u[:, k] / np.sqrt(e[k])), e[k] / np.trace(v)))
    return out


def agree(got, want):
    assert len(got) == len(want)
    got = sorted((r.vec_id, r.component, r.n, int(r.deviation), r.whitened, r.explained) for r in got)
    want = sorted(want)
    assert [g[:4] for g in got] == [w[:4] for w in want]
    assert np.allclose([g[5] for g in got], [w[5] for w in want], rtol=1e-9)
    for k in {g[1] for g in got}:
        a, b = (np.array([r[4] for r in side if r[1] == k]) for side in (got, want))
        assert np.allclose(a, b, atol=1e-6) or np.allclose(a, -b, atol=1e-6)


@pytest.mark.parametrize("partitions", [1, 7])
def test_against_fractions(spark, partitions):
    random = np.random.default_rng(3)
    rows = [(k, v.tolist()) for k, v in enumerate(random.normal(size=(300, 12)) * np.arange(1, 13))]
    rows += [(500, rows[0][1])] * 200 + [(501, (np.ones(12) * 1000.5).tolist())]
    got = whitening.whiten(vectors(spark, rows).repartition(partitions)).collect()
    agree(got, by_hand(rows))
    assert len({r.identity_error for r in got}) == 1 and got[0].identity_error < 1e-9


def test_given_table(spark, data):
    rows = [(r.vec_id, list(r.embedding)) for r in spark.read.parquet(f"{data}/embeddings.parquet").collect()]
    agree(queries.op13_whitening(spark, data).collect(), by_hand(rows))


def test_very_wide_entries(spark):
    rows = [(0, [1e12, 0.0]), (1, [-1e12, 1e11]), (2, [3.0, 5e12]), (3, [7.0, -2.0]), (4, [1e10, 1.0])]
    agree(whitening.whiten(vectors(spark, rows)).collect(), by_hand(rows))


def test_cross_products_are_exact(spark):
    random = np.random.default_rng(4)
    v = random.normal(size=(9001, 5)).astype(np.float32)  # more than two chunks in one partition
    df = spark.createDataFrame([(r.tolist(),) for r in v], "vector array<double>").coalesce(1)
    x = np.floor(v.astype(float) * 1024).astype(np.int64) + 100_000
    n, sums, bounds = whitening.sums(df, 5)
    assert (n, sums) == (9001, x.sum(axis=0).tolist()) and bounds == list(zip(x.min(axis=0).tolist(), x.max(axis=0).tolist(), strict=True))
    y = x - x.min(axis=0)
    assert whitening.cross_products(df, 5, bounds) == {(i, j): int(y[:, i] @ y[:, j]) for i in range(5) for j in range(i, 5)}


def test_odd_rows(spark):
    nan, inf = float("nan"), float("inf")
    odd = [(1, None), (2, []), (3, [1.0, None]), (4, [nan, 1.0]), (5, [inf, 1.0]), (6, [1.0]), (7, [2.0**50, 0.0])]
    good = [(10, [0.5, 1.0]), (10, [0.5, 1.0]), (11, [0.25, -1.0]), (None, [1.0, 0.0])]
    got = whitening.whiten(vectors(spark, odd + good)).collect()
    assert sorted((r.vec_id or 0, r.component, r.n) for r in got) == sorted((i or 0, k, 4) for i, _ in good for k in (1, 2))
    assert whitening.whiten(vectors(spark, odd[:5])).collect() == []
    assert whitening.whiten(vectors(spark, [])).collect() == []


def test_without_differences(spark):
    got = whitening.whiten(vectors(spark, [(1, [0.5, 1.0, 2.0]), (2, [0.5, 1.0, 2.0])])).collect()
    assert [(r.component, r.whitened, r.explained, r.identity_error, int(r.deviation)) for r in got if r.vec_id == 1] == [(k, None, 0.0, None, 0) for k in (1, 2, 3)]
    got = whitening.whiten(vectors(spark, [(1, [0.5, 1.0]), (2, [0.75, 1.0])])).collect()
    assert sorted((r.vec_id, r.component, r.whitened is None, r.explained) for r in got) == [(1, 1, False, 1.0), (1, 2, True, 0.0), (2, 1, False, 1.0), (2, 2, True, 0.0)]
