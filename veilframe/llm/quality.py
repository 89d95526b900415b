"""Quality of texts: logistic regression on hashed word n-grams, trained by following the regularised leader."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import mixed, part_of, prepare, slices, sums, whole_groups, words_of

#: Weights of the hashed features.
FEATURES = 1 << 18
#: Frequencies are multiplied by this.
SCALE = 8.0
_PAIR, _SHAPE, _AGAIN = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F), np.uint64(0x165667B19E3779F9)


def shapes(words: pa.Array) -> pa.Array:
    """Words with runs of small letters, capitals and digits written as x, X and 0."""
    for pattern, letter in ((r"[\p{Ll}\p{Lo}\p{Lm}]+", "x"), (r"[\p{Lu}\p{Lt}]+", "X"), (r"\p{N}+", "0")):
        words = pc.replace_substring_regex(words, pattern, letter)
    return words


def hashes(words: pa.Array) -> np.ndarray:
    return np.array([xxhash.xxh64_intdigest(w) for w in words.cast(pa.binary()).to_pylist()], np.uint64)


def features(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Hashed features (words x 4) and the number of words of each text.

    Of every word: itself, it and the word before, its shape, and its shape and the one before. A
    shape also tells whether the word repeats the one before.
    """
    words = words_of(texts)
    if not len(words.codes):
        return np.zeros((0, 4), np.int32), words.counts
    begins = np.zeros(len(words.codes), bool)
    begins[words.starts[words.counts > 0]] = True
    coded = shapes(words.distinct).dictionary_encode()
    word = hashes(words.distinct)[words.codes]
    shape = mixed(hashes(coded.dictionary)[coded.indices.to_numpy()] ^ _SHAPE)[words.codes]
    again = np.concatenate([[False], words.codes[1:] == words.codes[:-1]]) & ~begins
    shape = np.where(again, shape ^ _AGAIN, shape)
    columns = []
    for own in (word, shape):
        before = np.where(begins, np.uint64(0), np.concatenate([[np.uint64(0)], own[:-1]]))
        columns += [mixed(own), mixed(before * _PAIR + own)]
    return np.column_stack([(c % np.uint64(FEATURES)).astype(np.int32) for c in columns]), words.counts


def follow_leader(rows: list[tuple[np.ndarray, np.ndarray, float, float]], alpha: float, beta: float, l1: float, l2: float, passes: int) -> tuple[np.ndarray, float]:
    """Weights and bias after FTRL-proximal updates over (features, values, label, weight), row by row."""
    z, n, bias, bias_n = np.zeros(FEATURES), np.zeros(FEATURES), 0.0, 0.0

    def weights(k):
        return np.where(np.abs(z[k]) <= l1, 0.0, -(z[k] - np.sign(z[k]) * l1) / ((beta + np.sqrt(n[k])) / alpha + l2))

    for _ in range(passes):
        for k, x, label, share in rows:
            w = weights(k)
            miss = share * (1 / (1 + np.exp(-np.clip(bias + (w * x).sum(), -35, 35))) - label)
            g = miss * x
            grown = n[k] + g * g
            z[k] += g - (np.sqrt(grown) - np.sqrt(n[k])) / alpha * w
            n[k] = grown
            bias_n += miss * miss
            bias -= alpha / (beta + np.sqrt(bias_n)) * miss
    return weights(np.arange(FEATURES)), bias


def train(rows: DataFrame, shards: int = 4, alpha: float = 0.3, beta: float = 1.0, l1: float = 0.05, l2: float = 0.5, passes: int = 3) -> tuple[np.ndarray, float] | None:
    """Weights and bias from (``of``, ``text``, ``label``): every shard follows its own leader, and their weights are averaged.

    The shard of a row and its place in it depend on its id (``of``) and text alone, so the model is the
    same however the rows are dealt. Labels count alike, however many rows have them. What returns to
    the driver is ``shards`` arrays of fixed size. None where there are no rows.
    """
    counts = {r["label"]: r["count"] for r in rows.groupBy("label").count().collect()}
    if not counts:
        return None
    share = {label: sum(counts.values()) / (len(counts) * n) for label, n in counts.items()}

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for shard in whole_groups(batches, "shard"):
            examples = []
            for part in slices(shard.to_batches(), "text"):
                found, sizes = features(part.column("text"))
                ends = np.cumsum(sizes)
                for label, size, end in zip(part.column("label").to_pylist(), sizes.tolist(), ends.tolist(), strict=True):
                    k, times = np.unique(found[end - size : end], return_counts=True)
                    examples.append((k, SCALE * times / max(1, size), float(label), share[label]))
            weights, bias = follow_leader(examples, alpha, beta, l1, l2, passes)
            columns = [shard.column("shard").combine_chunks()[:1], pa.array([weights.astype(np.float32).tobytes()]), pa.array([bias])]
            yield pa.RecordBatch.from_arrays(columns, ["shard", "weights", "bias"])

    dealt = rows.select(F.pmod(F.xxhash64("of"), F.lit(shards)).alias("shard"), F.xxhash64(F.lit(1), "of", "text").alias("place"), "text", "label")
    dealt = dealt.repartition(shards, "shard").sortWithinPartitions("shard", "place", "text").drop("place")
    models = dealt.mapInArrow(run, "shard long, weights binary, bias double").collect()
    models.sort(key=lambda m: m["shard"])
    return np.mean([np.frombuffer(m["weights"], np.float32) for m in models], axis=0), float(np.mean([m["bias"] for m in models]))


def score_quality(
    df: DataFrame,
    labels: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    label_col: str = "quality",
    folds: int = 3,
    held: int = 1,
    sample_rows: int = 20_000,
) -> DataFrame:
    """id, ``held_out``, ``score`` (0 to 1) and ``predicted`` (1 from 0.5) of every row of ``df``.

    Learns from the labels of ids whose ``crc32(id) % folds`` is not ``held``, some ``sample_rows`` of
    them at most, picked by a hash; an id labelled more than once counts with its smallest label. A
    score reads the text alone: a null or empty text has the score of the bias. Without labels every
    score is 0.5. A null id counts as the empty text in the fold.
    """
    spark = prepare(df.sparkSession)
    usable = labels.where(labels[label_col].isNotNull() & labels[id_col].isNotNull() & (part_of(labels[id_col], folds) != held))
    usable = usable.groupBy(usable[id_col].alias("of")).agg(F.min(usable[label_col]).cast("int").alias("label"))
    many = usable.count()
    picked = usable.where(F.pmod(F.xxhash64("of"), F.lit(1 << 20)) < min(1.0, sample_rows / max(1, many)) * (1 << 20))
    # some sample_rows pairs of numbers at any size, so they may be broadcast
    rows = df.select(df[id_col].alias("of"), df[text_col].alias("text")).join(F.broadcast(picked), "of").select("of", "text", "label")
    shared = spark.sparkContext.broadcast(train(rows))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weights, bias = shared.value or (np.zeros(FEATURES), 0.0)
        for part in slices(batches, "text"):
            found, sizes = features(part.column("text"))
            dots = sums(weights[found].sum(axis=1), sizes) / np.maximum(sizes, 1)
            score = 1 / (1 + np.exp(-np.clip(bias + SCALE * dots, -35, 35)))
            predicted = pa.array((score >= 0.5).astype(np.int32))
            yield pa.RecordBatch.from_arrays([part.column("id"), part.column("held_out"), pa.array(score), predicted], ["id", "held_out", "score", "predicted"])

    given = df.select(df[id_col].alias("id"), (part_of(df[id_col], folds) == held).alias("held_out"), df[text_col].alias("text"))
    kind = given.schema["id"].dataType.simpleString()
    return given.mapInArrow(run, f"id {kind}, held_out boolean, score double, predicted int").withColumnRenamed("id", id_col)
