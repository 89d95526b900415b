"""The quality model against a slow one in plain Python, and its independence of partitions."""

import collections
import math
import re
import zlib

import pytest
from pyspark.sql import functions as F

from veilframe.llm import quality


@pytest.fixture(scope="module")
def tables(spark, data):
    docs = spark.read.parquet(f"{data}/documents.parquet").select("doc_id", "text")
    return docs, spark.read.parquet(f"{data}/labels.parquet")


def shape(word):
    for pattern, letter in ((r"[^\W\d_A-ZÀ-ÖØ-Þ]+", "x"), (r"[A-ZÀ-ÖØ-Þ]+", "X"), (r"\d+", "0")):
        word = re.sub(pattern, letter, word)
    return word


def grams(text):
    """Shares, times 8, of words, pairs, shapes and pairs of shapes, which tell if a word repeats the one before."""
    words = re.findall(r"[^ \t\n\r\v\f]+", text or "")
    counts = collections.Counter()
    last, last_shape = None, None
    for word in words:
        own = (shape(word), word == last)
        # the first word of a text makes no pair, and counts as itself once more
        counts.update([("w", word), ("ww", last, word) if last else ("w", word), ("s", own), ("ss", last_shape, own) if last else ("s", own)])
        last, last_shape = word, own
    return {k: 8.0 * n / max(1, len(words)) for k, n in counts.items()}


def slow_fit(rows, alpha=0.3, beta=1.0, l1=0.05, l2=0.5, passes=3):
    z, n = collections.defaultdict(float), collections.defaultdict(float)

    def weight(k):
        return 0.0 if abs(z[k]) <= l1 else -(z[k] - math.copysign(l1, z[k])) / ((beta + math.sqrt(n[k])) / alpha + l2)

    bias = bias_n = 0.0
    for _ in range(passes):
        for found, label, share in rows:
            w = {k: weight(k) for k in found}
            miss = share * (1 / (1 + math.exp(-bias - sum(w[k] * x for k, x in found.items()))) - label)
            for k, x in found.items():
                grown = n[k] + (miss * x) ** 2
                z[k] += miss * x - (math.sqrt(grown) - math.sqrt(n[k])) / alpha * w[k]
                n[k] = grown
            bias_n += miss * miss
            bias -= alpha / (beta + math.sqrt(bias_n)) * miss
    return {k: weight(k) for k in list(z)}, bias


def test_against_a_slow_model(tables):
    docs, labels = tables
    of = {}
    for r in labels.collect():
        if zlib.crc32(str(r.doc_id).encode()) % 3 != 1:
            of[r.doc_id] = min(r.quality, of.get(r.doc_id, 1))
    places = docs.select("doc_id", "text", F.pmod(F.xxhash64("doc_id"), F.lit(4)).alias("shard"), F.xxhash64(F.lit(1), "doc_id", "text").alias("place"))
    rows = sorted((r for r in places.collect() if r.doc_id in of), key=lambda r: (r.shard, r.place))
    many = collections.Counter(of[r.doc_id] for r in rows)
    share = {label: len(rows) / (2 * n) for label, n in many.items()}
    models = [slow_fit([(grams(r.text), of[r.doc_id], share[of[r.doc_id]]) for r in rows if r.shard == s]) for s in range(4)]
    got = {r.doc_id: r for r in quality.score_quality(docs, labels).collect()}
    for doc_id, text in docs.collect():
        found = grams(text)
        dots = [bias + sum(w.get(k, 0.0) * x for k, x in found.items()) for w, bias in models]
        want = 1 / (1 + math.exp(-sum(dots) / 4))
        assert got[doc_id].score == pytest.approx(want, abs=0.02)  # hashed features may collide
        assert got[doc_id].held_out == (zlib.crc32(str(doc_id).encode()) % 3 == 1)


def test_partitions_make_no_difference(tables):
    docs, labels = tables
    one, many = (
        {r.doc_id: r.score for r in quality.score_quality(docs.repartition(n), labels.repartition(n)).collect()} for n in (1, 64)
    )
    assert one == many


def test_odd_labels(spark, make):
    docs = make(["good words here", "bad bad bad", None, ""], [1, 2, None, 4])
    labels = spark.createDataFrame([(1, 1, 0), (1, None, 0), (2, 0, 0), (None, 1, 0), (3, None, 0), (9, 1, 0)], "doc_id long, quality int, toxic int")
    got = {r.doc_id: r for r in quality.score_quality(docs, labels, folds=1, held=5).collect()}
    assert len(got) == 4 and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in got.values())
    assert got[None].score == got[4].score
