"""Near duplicates among embeddings by Euclidean p-stable hashing, checked by exact cosine.

Vectors are normalised and projected on random directions; the projections, shifted and cut into
steps, bucket them in several tables. What shares a bucket is compared exactly, in blocks, and a
pair that shares several counts in the first of them. Exact copies are one node throughout.
"""

from __future__ import annotations

import math
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import components, cut, mixed, parts, prepare, whole_groups

#: The step of a direction, for vectors of length one.
STEP = 2.0
#: Two linked vectors share no table with this probability at most; a vector meets so many unlike ones in a table.
MISSED, UNLIKE = 1e-6, 0.1
#: Vectors of a bucket that are compared in one block.
BLOCK = 1024


def agreement(distance: float) -> float:
    """How likely two vectors at a distance fall into one step of a random direction."""
    if distance <= 0:
        return 1.0
    r = STEP / distance
    return math.erf(r / math.sqrt(2)) - math.sqrt(2 / math.pi) / r * (1 - math.exp(-r * r / 2))


def layout(many: int, threshold: float) -> tuple[int, int]:
    """The number of tables, and of directions in each, for ``many`` vectors that are compared with each other.

    Directions grow with the logarithm of ``many``, so that vectors at right angles meet as seldom in a
    large table as in a small one; the tables then follow from the directions and what may be missed.
    """
    linked, unlike = agreement(math.sqrt(max(0.0, 2 - 2 * threshold))), agreement(math.sqrt(2))
    directions = max(4, math.ceil(math.log(max(2, many) / UNLIKE) / -math.log(unlike)))
    shared = linked**directions
    return (1 if shared >= 1 else max(1, math.ceil(math.log(MISSED) / math.log(1 - shared)))), directions


def usable(vector: Column) -> Column:
    """Whether a vector has a direction: not null or empty, finite numbers, not all zero."""
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.coalesce(vector.isNotNull() & finite & F.exists(vector, lambda x: x != 0), F.lit(False))


def table_keys(unit: np.ndarray, tables: int, directions: int) -> np.ndarray:
    """The bucket of each vector (rows) in each table."""
    random = np.random.default_rng([11, unit.shape[1]])
    along = random.normal(size=(unit.shape[1], tables * directions))
    steps = np.floor((unit @ along + random.random(tables * directions) * STEP) / STEP).astype(np.int64).view(np.uint64)
    keys = np.tile(mixed(np.arange(1, tables + 1)), (len(unit), 1))
    for k in range(directions):
        keys = mixed(keys ^ mixed(steps[:, k::directions]))
    return keys.view(np.int64)


def hashed(nodes: DataFrame, tables: int, directions: int) -> DataFrame:
    """``nodes`` (node, label, copies, vector) with ``unit``, its vector of length one, and ``keys``."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            vectors = batch.column("vector")
            sizes = vectors.value_lengths().to_numpy(zero_copy_only=False)
            for size in np.unique(sizes).tolist():  # only vectors of one length are compared
                mine = batch.take(pa.array(np.flatnonzero(sizes == size)))
                x = mine.column("vector").flatten().to_numpy().reshape(-1, size).astype(np.float64)
                x = x / np.abs(x).max(axis=1, keepdims=True)
                unit = x / np.sqrt((x * x).sum(axis=1, keepdims=True))
                label = mixed(mine.column("label").cast(pa.int64()).to_numpy()) ^ mixed(np.full(len(x), size))
                keys = mixed(table_keys(unit, tables, directions).view(np.uint64) ^ label[:, None]).view(np.int64)
                offsets = pa.array(np.arange(len(x) + 1, dtype=np.int32) * tables)
                columns = [mine.column("node"), mine.column("copies"), pa.array([u.tobytes() for u in unit], pa.binary())]
                yield pa.RecordBatch.from_arrays([*columns, pa.ListArray.from_arrays(offsets, pa.array(keys.reshape(-1)))], ["node", "copies", "unit", "keys"])

    return nodes.mapInArrow(run, "node long, copies long, unit binary, keys array<long>")


def linked(nodes: DataFrame, threshold: float, tables: int) -> DataFrame:
    """(``node``, ``first``, ``links``): per block, the vectors that a node links with and the least node it reaches there.

    Only keys and nodes are grouped by bucket; a vector is sent to the buckets in which it is not alone.
    """
    members = nodes.select("node", F.explode("keys").alias("bucket")).distinct()
    sizes = members.groupBy("bucket").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    blocks = F.ceil(F.col("n") / BLOCK).cast("int")
    rows = members.join(sizes, "bucket").select("bucket", "node", blocks.alias("blocks"), F.pmod(F.xxhash64("node"), blocks).cast("int").alias("block"))
    other = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other")
    dealt = rows.select("bucket", "node", "block", other)
    cell = F.xxhash64("bucket", F.least("block", "other"), F.greatest("block", "other")).alias("cell")
    dealt = dealt.select(cell, "bucket", "node", "block").join(nodes, "node")

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in whole_groups(batches, "cell"):
            cells, node, copies, block, bucket = (table.column(c).to_numpy() for c in ("cell", "node", "copies", "block", "bucket"))
            units, lists = table.column("unit").to_pylist(), table.column("keys").combine_chunks()
            keys = lists.flatten().to_numpy().reshape(-1, tables)
            out = []
            for start, stop in parts(cells):
                unit = np.frombuffer(b"".join(units[start:stop])).reshape(stop - start, -1)
                mine, here = keys[start:stop], slice(start, stop)
                table_no = int(np.flatnonzero(mine[0] == bucket[start])[0])
                fit = np.triu(unit @ unit.T >= threshold, 1)
                if block[here].min() != block[here].max():
                    fit &= block[here][:, None] != block[here][None, :]
                x, y = np.nonzero(fit)
                new = ~(mine[x, :table_no] == mine[y, :table_no]).any(axis=1)  # else an earlier table counts it
                x, y = x[new], y[new]
                if not len(x):
                    continue
                links = np.bincount(x, copies[here][y], stop - start) + np.bincount(y, copies[here][x], stop - start)
                least, ids = node[here].copy(), node[here]
                while True:  # the least node that each reaches within the block
                    low = np.minimum(least[x], least[y])
                    before = least.copy()
                    np.minimum.at(least, x, low)
                    np.minimum.at(least, y, low)
                    if (before == least).all():
                        break
                some = np.flatnonzero(links)
                out.append(np.column_stack([ids[some], least[some], links[some].astype(np.int64)]))
            found = np.concatenate([*out, np.zeros((0, 3), np.int64)])
            yield pa.RecordBatch.from_arrays([pa.array(found[:, k]) for k in range(3)], ["node", "first", "links"])

    together = dealt.repartition("cell").sortWithinPartitions("cell")
    return together.mapInArrow(run, "node long, first long, links long")


def near_vectors(df: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", threshold: float = 0.98) -> DataFrame:
    """Every row's id, ``n_links``, ``component_id`` (the least id reachable by links) and ``kept`` (whether that is its own).

    Vectors link if their labels are equal and not null and their cosine, in double precision, is
    ``threshold`` or more. Vectors that are null, empty, zero or hold null or non-finite numbers,
    vectors of different lengths, and rows of a null id link with nothing; the component of a null id
    is null, and it isn't kept. Ids are integers, as are labels; rows that repeat are vectors of
    their own that link with each other, and rows of one id share their component.
    """
    prepare(df.sparkSession)
    rows = df.select(df[id_col].cast("long").alias("id"), df[label_col].cast("long").alias("label"), df[vector_col].cast("array<double>").alias("vector"))
    fine = rows.where(F.col("id").isNotNull() & F.col("label").isNotNull() & usable(F.col("vector")))
    keyed = fine.withColumns({"h1": F.xxhash64("label", "vector"), "h2": F.xxhash64(F.lit(1), "label", "vector")})
    copies = keyed.groupBy("h1", "h2").agg(F.min("id").alias("node"), F.count(F.lit(1)).alias("copies"), F.first("label").alias("label"), F.first("vector").alias("vector"))
    copies = cut(copies)
    # an id with several vectors has several nodes; each gets a number of its own, and the id ties them
    numbered = copies.withColumn("rep", F.col("node")).withColumn("node", F.col("h1"))
    largest = copies.groupBy("label").count().agg(F.max("count")).first()[0] or 0
    tables, directions = layout(largest, threshold)
    nodes = cut(hashed(numbered.select("node", "label", "copies", "vector"), tables, directions))
    found = cut(linked(nodes, threshold, tables))
    classes = components(found.select(F.col("node").alias("a"), F.col("first").alias("b")))
    links = found.groupBy("node").agg(F.sum("links").alias("links"))
    of_node = numbered.select("h1", "h2", "node", "rep", "copies").join(links, "node", "left").join(classes, "node", "left")
    least = of_node.where("component IS NOT NULL").groupBy("component").agg(F.min("rep").alias("least"))
    of_node = of_node.join(least, "component", "left").select(
        "h1", "h2", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"), F.coalesce("least", "rep").alias("component_id")
    )
    result = rows.withColumn("fine", usable(F.col("vector")) & F.col("id").isNotNull() & F.col("label").isNotNull())
    hashes = {name: F.when(F.col("fine"), F.xxhash64(*([F.lit(1)] if name == "h2" else []), "label", "vector")) for name in ("h1", "h2")}
    result = result.select("id", *(c.alias(n) for n, c in hashes.items())).join(of_node, ["h1", "h2"], "left")
    component = F.coalesce("component_id", "id")
    return result.select(
        F.col("id").alias(id_col),
        F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"),
        component.alias("component_id"),
        F.coalesce(component == F.col("id"), F.lit(False)).alias("kept"),
    )
