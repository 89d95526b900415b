"""Spelling variants: words one letter apart, found through pairs of trie nodes.

A word's prefixes are nodes of a trie, its suffixes nodes of the trie of reversed words. A word without
its letter at i is the pair (prefix before i, suffix after i); a word as it is, is the pair (prefix
before i, suffix from i) for every i. Two words that both give one pair by a skipped letter differ in
that letter; a word that gives by a skipped letter what another gives as it is, has one letter more.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, mixed, prepare, slices

# What a word is, and which letters are deleted.
LETTERS = r"[A-Za-zÀ-ÿ]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
DIVISOR = 199
_FORWARD, _BACKWARD = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)


def count_words(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", letters: str = LETTERS, divisor: int | None = DIVISOR) -> DataFrame:
    """``word`` and how often it occurs (``n``) in all texts, small letters for A to Z.

    Where ``divisor`` divides the crc32 of ``<id>:<word>``, the letter at that crc32 modulo the word's
    length is left out first. Counts are combined before the shuffle, so a frequent word is no load.
    A null id counts as the empty text.
    """
    runs = df.select(
        F.coalesce(df[id_col].cast("string"), F.lit("")).alias("id"),
        F.explode(F.regexp_extract_all(df[text_col].cast("string"), F.lit(letters), F.lit(0))).alias("run"),
    )
    low = runs.select("id", F.translate("run", UPPER, LOWER).alias("run"))
    if divisor is None:
        return low.groupBy(F.col("run").alias("word")).agg(F.count("*").alias("n"))
    low = low.select("run", F.crc32(F.concat("id", F.lit(":"), "run").cast("binary")).alias("h"))
    at = F.pmod("h", F.length("run")).cast("int")
    without = F.concat(F.substring(F.col("run"), F.lit(1), at), F.substring(F.col("run"), at + 2, F.length("run")))
    word = F.when(F.col("h") % divisor == 0, without).otherwise(F.col("run"))
    return low.groupBy(word.alias("word")).agg(F.count("*").alias("n"))


def nodes(letters: np.ndarray, lengths: np.ndarray, factor: np.uint64) -> np.ndarray:
    """The number of the trie node after each letter, words one after another.

    A node's number is its parent's plus the letter's, the latter times a power for the depth, so
    words that share a prefix share its numbers, wherever they are worked on.
    """
    depth = np.arange(len(letters)) - np.repeat(np.cumsum(lengths) - lengths, lengths)
    powers = np.concatenate([[np.uint64(1)], np.cumprod(np.full(int(lengths.max()), factor, np.uint64))])
    steps = mixed(letters.astype(np.uint64) + factor) * powers[depth]
    sums = np.cumsum(steps, dtype=np.uint64)
    before = np.concatenate([[np.uint64(0)], sums])[np.cumsum(lengths) - lengths]
    return sums - np.repeat(before, lengths)


def pairs(batch: pa.RecordBatch) -> pa.RecordBatch:
    """All pairs of nodes of the words of a batch (``word``, ``id``, ``n``).

    ``skips`` tells a pair made by leaving out a letter; ``first`` that the letter is the first of a
    run of equal ones, since leaving out any of a run gives the same word.
    """
    points = [np.frombuffer(w.encode("utf-32-le"), np.uint32) for w in batch.column("word").to_pylist()]
    lengths = np.array([len(p) for p in points], np.int64)
    letters = np.concatenate(points)
    starts = np.cumsum(lengths) - lengths
    word = np.repeat(np.arange(len(lengths)), lengths)
    place = np.arange(len(letters)) - starts[word]
    mirrored = starts[word] + lengths[word] - 1 - place
    after = nodes(letters, lengths, _FORWARD)  # the prefix that ends with this letter
    before = np.where(place > 0, np.concatenate([[np.uint64(0)], after[:-1]]), np.uint64(0))
    upto = nodes(letters[mirrored], lengths, _BACKWARD)[mirrored]  # the suffix that begins with this letter
    beyond = np.where(place < lengths[word] - 1, np.concatenate([upto[1:], [np.uint64(0)]]), np.uint64(0))
    first = (place == 0) | (letters != np.concatenate([[np.uint32(0)], letters[:-1]]))
    ends = np.arange(len(lengths))  # and the pair of the whole word and nothing
    last = after[starts + lengths - 1]
    made = [  # prefix, suffix, word, letters before, letters after, skips, first
        (before, beyond, word, place, lengths[word] - 1 - place, np.ones(len(word), bool), first),
        (before, upto, word, place, lengths[word] - place, np.zeros(len(word), bool), np.ones(len(word), bool)),
        (last, np.zeros(len(ends), np.uint64), ends, lengths, np.zeros(len(ends), np.int64), np.zeros(len(ends), bool), np.ones(len(ends), bool)),
    ]
    prefix, suffix, of, left, right, skips, firsts = (np.concatenate(c) for c in zip(*made, strict=True))
    of = pa.array(of)
    columns = [
        pa.array(prefix.view(np.int64)), pa.array(suffix.view(np.int64)), pa.array(left.astype(np.int32)), pa.array(right.astype(np.int32)),
        batch.column("id").take(of), batch.column("n").take(of), pa.array(skips), pa.array(firsts),
    ]
    return pa.RecordBatch.from_arrays(columns, ["prefix", "suffix", "n_before", "n_after", "id", "n", "skips", "first"])


_PAIR = "prefix long, suffix long, n_before int, n_after int, id long, n long, skips boolean, first boolean"


def neighbours(words: DataFrame) -> DataFrame:
    """``id``, the number of words one letter away (``n_near``) and the most frequent of them, for words that have one.

    ``words`` has ``word``, ``n`` and ``id``, ids in the order of the words. The rows of one pair of
    nodes are one word at most that has the pair as it is, and words that differ in one letter at one
    place: no more than there are letters. So each is told about the others inside its group; no pair
    of words becomes a row.
    """

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, "word", 1 << 18):
            if part.num_rows:
                yield pairs(part)

    rows = words.select("word", "id", "n").mapInArrow(run, _PAIR)
    member = F.struct((-F.col("n")).alias("m"), "id", "skips", "first")
    groups = rows.groupBy("prefix", "suffix", "n_before", "n_after").agg(F.collect_list(member).alias("all")).where(F.size("all") > 1)

    def others(one):
        # words of unequal length count where the longer one's letter is the first of its run
        longer, shorter = one["skips"] & one["first"], ~one["skips"]
        near = F.filter(
            "all", lambda o: (o["id"] != one["id"]) & F.when(o["skips"], one["skips"] | (shorter & o["first"])).otherwise(longer)
        )
        return F.struct(one["id"].alias("id"), F.size(near).cast("long").alias("many"), F.array_min(F.transform(near, lambda o: F.struct(o["m"], o["id"]))).alias("best"))

    told = groups.select(F.explode(F.transform("all", others)).alias("t")).select("t.*").where("many > 0")
    return told.groupBy("id").agg(F.sum("many").alias("n_near"), F.min("best").alias("best"))


def group_variants(
    df: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    min_chars: int = 6,
    min_count: int = 5,
    times: int = 5,
    letters: str = LETTERS,
    divisor: int | None = DIVISOR,
) -> DataFrame:
    """Per word: its form, the root that forms lead to, and how many words are one letter away.

    Words are the runs of ``letters`` of whole texts (``count_words``) of at least ``min_chars`` letters
    that occur ``min_count`` times or more. Near are words that differ by one letter inserted, deleted
    or replaced. A word's form is its near word of largest ``n`` (of equals the first in code-point
    order) if that is at least ``times`` the word's own, else null. Columns: ``word``, ``form``,
    ``root``, ``n``, ``n_near``, ``form_n``.

    Null and empty texts have no words; an empty table gives no rows; repeated rows count each time;
    other columns of ``df`` are not read.
    """
    if times < 2:
        raise ValueError("times has to be 2 or more, so that forms lead to an end")
    prepare(df.sparkSession)
    counted = count_words(df, id_col, text_col, letters, divisor)
    counted = counted.where((F.length("word") >= max(1, min_chars)) & (F.col("n") >= min_count))
    # Ranges in order of the words, numbered in that order: the smallest id is the first in code-point order.
    words = cut(counted.orderBy("word").withColumn("id", F.monotonically_increasing_id()))
    near = cut(neighbours(words))
    chosen = near.select("id", "n_near", (-F.col("best.m")).alias("best_n"), F.col("best.id").alias("best_id"))
    told = words.join(chosen, "id", "left")
    follows = F.col("best_n") >= F.col("n") * times
    told = cut(told.select("id", "word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.when(follows, F.col("best_id")).alias("to"), F.when(follows, F.col("best_n")).alias("form_n")))
    # Each round doubles the way followed; counts grow along it, so it ends after a logarithm of a logarithm of the counts.
    ways = told.where("to IS NOT NULL").select("id", "to")
    while True:
        step = ways.select(F.col("id").alias("to"), F.col("to").alias("next"))
        longer = cut(ways.join(step, "to", "left").select("id", F.coalesce("next", "to").alias("to"), F.col("next").isNotNull().alias("moved")))
        ways = longer.select("id", "to")
        if longer.where("moved").isEmpty():
            break
    names = words.select(F.col("id").alias("to"), F.col("word").alias("name"))
    forms = told.where("to IS NOT NULL").select("id", "to").join(names, "to").select("id", F.col("name").alias("form"))
    roots = ways.join(names, "to").select("id", F.col("name").alias("root"))
    out = told.drop("to").join(forms, "id", "left").join(roots, "id", "left")
    return out.select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
