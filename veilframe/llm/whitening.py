"""Whitening of embeddings: exact integer cross-products by bit slices, then eigenvectors of the covariance."""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import prepare

# The integers that stand for the entries.
SCALE, SHIFT = 1024, 100_000
#: Entries from here on have no exact place among the integers of 64 bits, and count as not finite.
LIMIT = float(1 << 50)
#: Rows whose bit planes are packed at once.
CHUNK = 4096
WIDE = "decimal(38,0)"


@dataclass(frozen=True)
class Whitening:
    """``n`` vectors, the sums of their integers, and unit directions with their eigenvalues."""

    n: int
    sums: list[int]
    bounds: list[tuple[int, int]]
    directions: np.ndarray
    eigenvalues: np.ndarray
    trace: float
    identity_error: float | None


def integers(batch: pa.RecordBatch, dims: int) -> np.ndarray:
    """Rows of ``floor(1024 c) + 100000``, as 64-bit integers."""
    entries = batch.column("vector").flatten().to_numpy(zero_copy_only=False).reshape(-1, dims)
    return np.floor(entries * SCALE).astype(np.int64) + SHIFT


def usable(vector: Column) -> Column:
    """Whether a vector has entries, all of them numbers within the limit (NaN is above every number)."""
    fine = F.forall(vector, lambda c: F.coalesce(F.abs(c) < LIMIT, F.lit(False)))
    return vector.isNotNull() & (F.size(vector) > 0) & F.coalesce(fine, F.lit(False))


def total(values: np.ndarray) -> list[int]:
    """Exact column sums: the halves of each integer are added apart, so nothing overflows."""
    low, high = values & 0x7FFFFFFF, values >> 31
    return [(int(h) << 31) + int(lo) for h, lo in zip(high.sum(axis=0), low.sum(axis=0), strict=True)]


def sums(vectors: DataFrame, dims: int) -> tuple[int, list[int], list[tuple[int, int]]]:
    """How many vectors there are, and per dimension the sum, the least and the greatest integer.

    A partition makes one row per dimension, and one per dimension reaches the driver.
    """

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, added, least, most = 0, [0] * dims, None, None
        for batch in batches:
            if not batch.num_rows:
                continue
            x = integers(batch, dims)
            n += len(x)
            added = [a + b for a, b in zip(added, total(x), strict=True)]
            least = x.min(axis=0) if least is None else np.minimum(least, x.min(axis=0))
            most = x.max(axis=0) if most is None else np.maximum(most, x.max(axis=0))
        if n:
            columns = [pa.array(range(dims), pa.int32()), pa.array([n] * dims), pa.array(map(str, added)), pa.array(least), pa.array(most)]
            yield pa.RecordBatch.from_arrays(columns, ["dim", "n", "added", "least", "most"])

    parts = vectors.select("vector").mapInArrow(run, "dim int, n long, added string, least long, most long")
    whole = [F.sum("n").alias("n"), F.sum(F.col("added").cast(WIDE)).alias("added"), F.min("least").alias("least"), F.max("most").alias("most")]
    rows = sorted(parts.groupBy("dim").agg(*whole).collect(), key=lambda r: r["dim"])
    return rows[0]["n"], [int(r["added"]) for r in rows], [(r["least"], r["most"]) for r in rows]


def planes(x: np.ndarray, least: np.ndarray, bits: list[int]) -> np.ndarray:
    """Bit planes of all dimensions, less the least integer of each, packed across rows into 64-bit words."""
    rows = -(-len(x) // 64) * 64
    out = []
    for d, width in enumerate(bits):
        shifted = np.zeros(rows, np.uint64)
        shifted[: len(x)] = (x[:, d] - least[d]).astype(np.uint64)
        for b in range(width):
            out.append(np.packbits((shifted >> np.uint64(b)).astype(np.uint8) & 1).view(np.uint64))
    return np.array(out).reshape(len(out), rows // 64)


def cross_products(vectors: DataFrame, dims: int, bounds: list[tuple[int, int]]) -> dict[tuple[int, int], int]:
    """For dimensions i <= j, the exact sum over all vectors of the product of their shifted integers.

    The product of two integers is the sum over pairs of their bits of 2^(p+q), where both bits are
    set; over many rows that is 2^(p+q) times the bits set in both planes, counted words at a time.
    A partition adds its counts up and makes one row per pair of dimensions, which Spark adds up.
    """
    least = np.array([a for a, _ in bounds], np.int64)
    bits = [(b - a).bit_length() for a, b in bounds]
    dimension = np.repeat(np.arange(dims), bits)
    weights = [1 << b for width in bits for b in range(width)]
    first = np.cumsum([0, *bits])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts, any_rows = np.zeros((len(dimension), len(dimension)), np.int64), False
        for batch in batches:
            x = integers(batch, dims)
            for start in range(0, len(x), CHUNK):
                packed, any_rows = planes(x[start : start + CHUNK], least, bits), True
                for k in range(len(packed)):
                    counts[k, k:] += np.bitwise_count(packed[k] & packed[k:]).sum(axis=1, dtype=np.int64)
        if not any_rows or not len(dimension):
            return
        counts += np.triu(counts, 1).T
        # beyond 64 bits the weighted sums go on in Python's integers
        small = counts.max().item().bit_length() + 2 * max(bits) + 1 < 63
        w = np.array(weights, np.int64 if small else object)
        weighted = counts.astype(w.dtype) * w[:, None] * w[None, :]
        full = [d for d in range(dims) if bits[d]]
        by_row = np.add.reduceat(weighted, first[full], axis=0)
        by_pair = np.add.reduceat(by_row, first[full], axis=1)
        left, right = np.triu_indices(len(full))
        values = [str(v) for v in by_pair[left, right].tolist()]
        at = np.array(full, np.int32)
        yield pa.RecordBatch.from_arrays([pa.array(at[left]), pa.array(at[right]), pa.array(values)], ["i", "j", "cross"])

    parts = vectors.select("vector").mapInArrow(run, "i int, j int, cross string")
    rows = parts.groupBy("i", "j").agg(F.sum(F.col("cross").cast(WIDE)).alias("cross")).collect()
    return {(r["i"], r["j"]): int(r["cross"]) for r in rows}


def fit(vectors: DataFrame, dims: int, most: int) -> Whitening:
    """The ``most`` leading directions of all ``vectors``; only numbers of dimensions reach the driver."""
    n, added, bounds = sums(vectors, dims)
    crosses = cross_products(vectors, dims, bounds)
    shifted = [s - n * least for s, (least, _) in zip(added, bounds, strict=True)]
    v = np.zeros((dims, dims))
    for (i, j), cross in crosses.items():
        # centred as integers; the one division rounds correctly
        v[i, j] = v[j, i] = (n * cross - shifted[i] * shifted[j]) / (n * n)
    e, u = np.linalg.eigh(v)
    order = np.argsort(-e, kind="stable")[:most]
    e, u = e[order], u[:, order].T
    # of the two signs, the one whose largest entry is positive
    u = u * np.where(u[np.arange(len(u)), np.abs(u).argmax(axis=1)] < 0, -1.0, 1.0)[:, None]
    trace = float(np.trace(v))
    real = e > trace * dims * np.finfo(float).eps
    scaled = u[real] / np.sqrt(e[real])[:, None]
    error = float(np.abs(scaled @ v @ scaled.T - np.eye(len(scaled))).max()) if real.any() else None
    return Whitening(n, added, bounds, u, np.where(real, e, 0.0), trace, error)


def whiten(df: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", components: int = 8) -> DataFrame:
    """One row per vector and leading component (``components`` of them, or all dimensions if fewer).

    Columns: ``id_col``; ``component`` from 1; ``n``, the number of vectors; ``deviation``, the exact
    sum over dimensions of ``(n x - S)^2``, a decimal; ``whitened``; ``explained``; ``identity_error``.

    Dropped are vectors that are null or empty, that hold an entry that is null, not finite, or 2^50
    or more in size, and vectors of another length than most (of two lengths with as many vectors the
    greater is taken). Rows repeated, in id or vector, count each time; a null id is kept. A component
    along which the vectors don't differ has the explained share 0 and no whitened value (null);
    without any that differ, ``identity_error`` is null. An empty table gives no rows. Other columns
    of ``df`` are not read.
    """
    prepare(df.sparkSession)
    given = df.select(df[id_col].alias("id"), df[vector_col].cast("array<double>").alias("vector"))
    given = given.where(usable(F.col("vector")))
    kind = given.schema["id"].dataType.simpleString()
    schema = f"id {kind}, component int, n long, deviation {WIDE}, whitened double, explained double, identity_error double"
    lengths = given.groupBy(F.size("vector").alias("dims")).count()
    top = lengths.orderBy(F.desc("count"), F.desc("dims")).first()
    if top is None:
        return df.sparkSession.createDataFrame([], schema).withColumnRenamed("id", id_col)
    dims = top["dims"]
    given = given.where(F.size("vector") == dims)
    model = df.sparkSession.sparkContext.broadcast(fit(given, dims, components))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = model.value
        many = len(m.directions)
        real = m.eigenvalues > 0
        scale = np.where(real, 1 / np.sqrt(np.where(real, m.eigenvalues, 1.0)), 0.0)
        # the largest size of n x - S, to know whether 64 bits hold the squares' sum
        far = max(max(abs(m.n * a - s), abs(m.n * b - s)) for s, (a, b) in zip(m.sums, m.bounds, strict=True))
        kind_of = np.int64 if dims * far * far < 1 << 63 and m.n * max(max(abs(a), abs(b)) for a, b in m.bounds) < 1 << 62 else object
        added = np.array(m.sums, kind_of)
        for whole in batches:
            for start in range(0, whole.num_rows, CHUNK):
                batch = whole.slice(start, CHUNK)
                off = integers(batch, dims).astype(kind_of) * m.n - added
                deviation = (off * off).sum(axis=1).tolist()
                values = ((off.astype(float) / m.n) @ m.directions.T) * scale
                rows = len(values)
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column("id").take(pa.array(np.repeat(np.arange(rows), many))),
                        pa.array(np.tile(np.arange(1, many + 1, dtype=np.int32), rows)),
                        pa.array(np.full(rows * many, m.n, np.int64)),
                        pa.array([str(d) for d in deviation]).take(pa.array(np.repeat(np.arange(rows), many))),
                        pa.array(values.ravel(), mask=~np.tile(real, rows)),
                        pa.array(np.tile(m.eigenvalues / (m.trace or 1.0), rows)),
                        pa.array([m.identity_error] * (rows * many), pa.float64()),
                    ],
                    ["id", "component", "n", "deviation", "whitened", "explained", "identity_error"],
                )

    out = given.mapInArrow(run, schema.replace(f"deviation {WIDE}", "deviation string"))
    return out.withColumn("deviation", F.col("deviation").cast(WIDE)).withColumnRenamed("id", id_col)
