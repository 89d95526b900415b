"""Packing token sequences by cutting-stock column generation.

A document of n tokens is cut by n alone: whole sequences, one body of a multiple of the quantum,
one tail below it. So there are few piece lengths, however many documents: a linear program over
the histogram of lengths finds patterns of lengths that fill a sequence, a knapsack priced by its
duals finds each next pattern, the rounded pattern counts become slots, and the documents of each
length, ranked, take the slots in order.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .bpe import encode, load
from .common import cut, prepare, slices

#: The documents of one length are ranked in buckets, whose ranks are then joined: one for so many
#: pieces, within bounds, so that the table of their counts stays small enough to broadcast.
RANK_ROWS, LEAST_BUCKETS, MOST_BUCKETS = 1 << 20, 64, 8192


def cuts(n: int, size: int, quantum: int) -> list[int]:
    """The lengths that a document of n tokens is cut into."""
    body = n % size // quantum * quantum
    return [size] * (n // size) + [x for x in (body, n % size - body) if x]


def knapsack(values: np.ndarray, lengths: np.ndarray, size: int) -> tuple[float, np.ndarray]:
    """The best value of pieces that fit into ``size``, and how many of each length (dynamic program)."""
    best, choice = np.zeros(size + 1), np.full(size + 1, -1)
    order = np.argsort(lengths)
    sorted_lengths, sorted_values = lengths[order], values[order]
    for room in range(1, size + 1):
        fits = int(np.searchsorted(sorted_lengths, room, side="right"))
        best[room] = best[room - 1]
        if fits:
            gains = best[room - sorted_lengths[:fits]] + sorted_values[:fits]
            top = int(np.argmax(gains))
            if gains[top] > best[room] + 1e-12:
                best[room], choice[room] = gains[top], order[top]
    counts, room = np.zeros(len(lengths), np.int64), size
    while room > 0:
        if choice[room] < 0:
            room -= 1
        else:
            counts[choice[room]] += 1
            room -= int(lengths[choice[room]])
    return float(best[size]), counts


def solve(histogram: dict[int, int], size: int, rounds: int = 300, gap: float = 2e-4) -> list[tuple[np.ndarray, int]]:
    """Patterns (pieces of each length, lengths ascending) and how often each is used.

    Column generation with a revised simplex: the basis has one column per length; the pattern that
    the knapsack prices best enters, the ratio test says which leaves. It ends when the program is
    within ``gap`` of a lower bound: the pieces' total length, or the program's value divided by
    that of the best pattern. Counts are rounded down, and
    what that leaves over is packed first fit, longest first; there are at most as many pieces
    left over as the patterns of one basis hold.
    """
    lengths = np.array(sorted(histogram), np.int64)
    need = np.array([histogram[x] for x in lengths.tolist()], float)
    basis = np.diag((size // lengths).astype(float))
    inverse, used = np.diag(1.0 / (size // lengths)), need / (size // lengths)
    bound = float((need * lengths).sum()) / size
    for turn in range(rounds):
        value, entering = knapsack(inverse.sum(axis=0), lengths, size)
        bound = max(bound, used.sum() / max(value, 1.0))
        if value <= 1 + 1e-9 or used.sum() <= bound * (1 + gap):
            break
        step = (inverse * entering).sum(axis=1)
        ratios = np.where(step > 1e-9, used / np.where(step > 1e-9, step, 1), np.inf)
        leaving = int(np.argmin(ratios))
        used = used - ratios[leaving] * step
        used[leaving] = ratios[leaving]
        basis[:, leaving] = entering
        row = inverse[leaving] / step[leaving]
        inverse = inverse - np.outer(step, row)
        inverse[leaving] = row
        used = np.maximum(used, 0)
    left = need.astype(np.int64)
    chosen: list[tuple[np.ndarray, int]] = []
    for pattern, times in zip(basis.T.round().astype(np.int64), used.tolist(), strict=True):
        times = int(min(times + 1e-6, *(left[pattern > 0] // pattern[pattern > 0])))
        if times > 0:
            chosen.append((pattern, times))
            left -= pattern * times
    while left.any():  # fill one sequence, longest pieces first, as often as the pieces last
        pattern, room = np.zeros(len(lengths), np.int64), size
        for k in range(len(lengths) - 1, -1, -1):
            pattern[k] = min(left[k], room // lengths[k])
            room -= int(pattern[k] * lengths[k])
        times = int(min(left[pattern > 0] // pattern[pattern > 0]))
        chosen.append((pattern, times))
        left -= pattern * times
    return chosen


def slots(histogram: dict[int, int], size: int) -> dict[int, tuple[np.ndarray, ...]]:
    """By length: ranks from which a pattern serves, its first sequence, its pieces of the length, their first offset."""
    lengths, rows, sequence = sorted(histogram), {}, 0
    rank = dict.fromkeys(lengths, 0)
    for pattern, times in solve(histogram, size) if histogram else []:
        offset = 0
        for length, count in zip(lengths, pattern.tolist(), strict=True):
            if count:
                rows.setdefault(length, []).append((rank[length], sequence, count, offset))
                rank[length] += count * times
                offset += count * length
        sequence += times
    return {length: tuple(np.array(x, np.int64) for x in zip(*r, strict=True)) for length, r in rows.items()}


def pieces_of(df: DataFrame, vocabulary_path: str, id_col: str, text_col: str, size: int, quantum: int, end_id: int) -> DataFrame:
    """One row per piece of each document: id, start, length, ids_crc32, doc_tokens."""
    shared = prepare(df.sparkSession).sparkContext.broadcast(load(vocabulary_path))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        closing = int(end_id).to_bytes(4, "little")
        for part in slices(batches, "text"):
            ids, counts = encode(part.column("text"), shared.value)
            view, ends = memoryview(ids.astype("<u4").view(np.uint8)), np.cumsum(counts)
            rows: list[tuple[int, int, int, int, int]] = []
            for k, (n, end) in enumerate(zip(counts.tolist(), ends.tolist(), strict=True)):
                start, first = 0, end - n
                for length in cuts(n + 1, size, quantum):
                    stop = start + length
                    crc = zlib.crc32(view[4 * (first + start) : 4 * (first + min(stop, n))])
                    rows.append((k, start, length, zlib.crc32(closing, crc) if stop > n else crc, n + 1))
                    start = stop
            owner, *values = np.array(rows, np.int64).reshape(-1, 5).T
            columns = [part.column("id").take(pa.array(owner)), *map(pa.array, values)]
            yield pa.RecordBatch.from_arrays(columns, ["id", "start", "length", "ids_crc32", "doc_tokens"])

    given = df.select(df[id_col].alias("id"), df[text_col].alias("text"))
    kind = given.schema["id"].dataType.simpleString()
    return given.mapInArrow(run, f"id {kind}, start long, length long, ids_crc32 long, doc_tokens long")


def ranked(pieces: DataFrame, total: int) -> DataFrame:
    """``pieces``, ``total`` of them, with ``rank``: 0, 1, ... among those of one length.

    Pieces are ranked within buckets of their length; the counts of the buckets before are added.
    """
    order = [F.col(c).asc_nulls_first() for c in ("id", "start", "ids_crc32", "doc_tokens")]
    buckets = min(max(total // RANK_ROWS, LEAST_BUCKETS), MOST_BUCKETS)
    bucketed = pieces.withColumn("bucket", F.pmod(F.xxhash64("id", "start"), F.lit(buckets)).cast("int"))
    counts = bucketed.groupBy("length", "bucket").agg(F.count(F.lit(1)).alias("n"))
    before = Window.partitionBy("length").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    base = counts.select("length", "bucket", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    within = F.row_number().over(Window.partitionBy("length", "bucket").orderBy(*order))
    numbered = bucketed.withColumn("within", within)
    # at most (lengths x buckets) rows: size / quantum + quantum lengths, 8192 buckets
    return numbered.join(F.broadcast(base), ["length", "bucket"]).withColumn("rank", F.col("within") - 1 + F.col("base")).drop("bucket", "within", "base")


def pack_documents(
    df: DataFrame,
    vocabulary_path: str,
    id_col: str = "doc_id",
    text_col: str = "text",
    size: int = 4096,
    quantum: int = 64,
    end_id: int = 2,
) -> DataFrame:
    """One row per piece: id, start, length, ids_crc32, doc_tokens, sequence_id, offset.

    A null text is empty: one piece, the end id alone. Rows with equal or null ids are packed each
    for itself. What reaches the driver is the histogram of piece lengths, ``size / quantum +
    quantum`` numbers at most.
    """
    pieces = cut(pieces_of(df, vocabulary_path, id_col, text_col, size, quantum, end_id))
    histogram = {r["length"]: r["n"] for r in pieces.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()}
    plan = df.sparkSession.sparkContext.broadcast(slots(histogram, size))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            length, rank = (batch.column(c).to_numpy() for c in ("length", "rank"))
            sequence, offset = np.zeros(len(rank), np.int64), np.zeros(len(rank), np.int64)
            for one in np.unique(length).tolist():
                mine = np.flatnonzero(length == one)
                starts, first, per, shift = plan.value[one]
                row = np.searchsorted(starts, rank[mine], side="right") - 1
                turn = rank[mine] - starts[row]
                sequence[mine] = first[row] + turn // per[row]
                offset[mine] = shift[row] + turn % per[row] * one
            columns = [batch.column(c) for c in ("id", "start", "length", "ids_crc32", "doc_tokens")]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(sequence), pa.array(offset)], names)

    names = ["id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]
    kind = pieces.schema["id"].dataType.simpleString()
    schema = f"id {kind}, " + ", ".join(f"{c} long" for c in names[1:])
    return ranked(pieces, sum(histogram.values())).select(*names[:5], "rank").mapInArrow(run, schema).withColumnRenamed("id", id_col)
