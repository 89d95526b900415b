"""What the operators share: cut lineage, bounded slices of Arrow batches, words, components."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes of text that a Python worker handles at once; one longer text is handled alone.
SLICE_BYTES = 4 << 20


def prepare(spark: SparkSession) -> SparkSession:
    """Name the shared checkpoint folder, and bound Arrow batches by bytes as well as rows."""
    context = spark.sparkContext
    if not context.getCheckpointDir():
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if not folder:
            if not context.master.startswith("local"):
                raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
            folder = tempfile.mkdtemp(prefix="llm-")  # one machine, as in tests
        context.setCheckpointDir(folder)
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(SLICE_BYTES))
    return spark


def shared_path(spark: SparkSession, purpose: str) -> str:
    """A fresh path in the shared folder, which goes when the driver ends."""
    context = prepare(spark).sparkContext
    name = f"{context.getCheckpointDir()}/{purpose}-{uuid.uuid4().hex}"
    path = spark._jvm.org.apache.hadoop.fs.Path(name)
    path.getFileSystem(context._jsc.hadoopConfiguration()).deleteOnExit(path)
    return name


def cut(df: DataFrame) -> DataFrame:
    """``df`` computed once, written to the shared folder and read again.

    Later steps survive lost executors. (A checkpoint would do so too, but carries the constraints
    of its plan along, which grow without bound in loops of joins.)
    """
    path = shared_path(df.sparkSession, "cut")
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def slices(batches: Iterable[pa.RecordBatch], column: str, most: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """The rows of the batches in pieces whose texts take ``most`` bytes, or of one row."""
    for batch in batches:
        sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
        ends = np.cumsum(sizes, dtype=np.int64)
        start = 0
        while start < batch.num_rows:
            before = ends[start - 1] if start else 0
            stop = max(start + 1, int(np.searchsorted(ends, before + most, side="right")))
            yield batch.slice(start, stop - start)
            start = stop


def whole_groups(batches: Iterable[pa.RecordBatch], key: str) -> Iterator[pa.Table]:
    """Tables that hold every row of the keys in them, from batches in which equal keys are adjacent."""
    rest: list[pa.Table] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        table = pa.Table.from_batches([batch])
        keys = table.column(key).to_numpy()
        changes = np.flatnonzero(keys[1:] != keys[:-1])
        if rest and rest[-1].column(key)[-1].as_py() != keys[0]:
            yield pa.concat_tables(rest).combine_chunks()
            rest = []
        if len(changes):
            last = int(changes[-1]) + 1
            yield pa.concat_tables([*rest, table.slice(0, last)]).combine_chunks()
            rest = [table.slice(last)]
        else:
            rest.append(table)
    if rest:
        yield pa.concat_tables(rest).combine_chunks()


def parts(values: np.ndarray) -> list[tuple[int, int]]:
    """Start and end of each run of equal values."""
    if not len(values):
        return []
    edges = np.concatenate([[0], np.flatnonzero(values[1:] != values[:-1]) + 1, [len(values)]])
    return list(zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True))


class Words:
    """The words of some texts: ``codes`` into ``distinct``, of text i from ``ends[i - 1]`` to ``ends[i]``."""

    def __init__(self, codes: np.ndarray, counts: np.ndarray, distinct: pa.Array):
        self.codes, self.counts, self.distinct = codes, counts, distinct
        self.ends = np.cumsum(counts, dtype=np.int64)
        self.starts = self.ends - counts

    @property
    def text(self) -> np.ndarray:
        """The text that each word belongs to."""
        return np.repeat(np.arange(len(self.counts)), self.counts)

    def keep(self, wanted: np.ndarray) -> Words:
        """Without the distinct words that are not wanted."""
        stays = wanted[self.codes]
        counts = np.bincount(self.text[stays], minlength=len(self.counts))
        return Words(self.codes[stays], counts, self.distinct)


def words_of(texts: pa.Array, pattern: str | None = None) -> Words:
    """Words between runs of ASCII white space, or between single ``pattern``s; null texts have none."""
    texts = pc.fill_null(texts, "")
    lists = pc.ascii_split_whitespace(texts) if pattern is None else pc.split_pattern(texts, pattern)
    coded = lists.flatten().dictionary_encode()
    words = Words(
        coded.indices.to_numpy(zero_copy_only=False),
        pc.list_value_length(lists).to_numpy(zero_copy_only=False).astype(np.int64),
        coded.dictionary,
    )
    empty = coded.dictionary.index("").as_py()
    return words if empty < 0 else words.keep(np.arange(len(coded.dictionary)) != empty)


def mixed(values: np.ndarray) -> np.ndarray:
    """64-bit values scattered evenly (the finaliser of splitmix64)."""
    x = np.asarray(values).astype(np.uint64)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def sums(values: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Sums of consecutive stretches of ``counts`` values; 0 for empty ones."""
    out = np.zeros((len(counts), *values.shape[1:]))
    full = np.flatnonzero(counts)
    if len(full):
        starts = (np.cumsum(counts) - counts)[full]
        out[full] = np.add.reduceat(values, starts, axis=0)
    return out


def spread(values: np.ndarray, counts: np.ndarray, picks: np.ndarray) -> np.ndarray:
    """The stretches of ``values`` that ``picks`` names, one after another."""
    starts, many = (np.cumsum(counts) - counts)[picks], counts[picks]
    total = int(many.sum())
    return values[np.repeat(starts - (np.cumsum(many) - many), many) + np.arange(total)]


def part_of(column: Column, modulus: int) -> Column:
    """crc32 of an id as text, modulo ``modulus``; a null id counts as the empty text."""
    return F.crc32(F.coalesce(column.cast("string"), F.lit("")).cast("binary")) % modulus


def components(edges: DataFrame) -> DataFrame:
    """``node`` and the smallest node of its component, for the nodes of the edges (``a``, ``b``).

    Each round every node takes the neighbour that is first in a hashed order, and the graph is
    contracted by that; a constant share of the nodes goes each round, also along chains. Only
    minima are grouped, so a node with very many edges is combined before the shuffle.
    """
    edges = cut(edges.where("a <> b").select("a", "b").distinct())
    names = None
    turn = 0
    while not edges.isEmpty():
        both = edges.union(edges.select("b", "a"))
        first = F.min(F.struct(F.xxhash64(F.lit(turn), "b").alias("h"), F.col("b").alias("to"))).alias("m")
        own = F.struct(F.xxhash64(F.lit(turn), "a").alias("h"), F.col("a").alias("to"))
        chosen = cut(both.groupBy("a").agg(first).select(F.col("a").alias("node"), F.least("m", own)["to"].alias("to")))
        if names is None:
            names = chosen
        else:
            step = chosen.select(F.col("node").alias("to"), F.col("to").alias("next"))
            names = cut(names.join(step, "to", "left").select("node", F.coalesce("next", "to").alias("to")))
        moved = edges.join(chosen.select(F.col("node").alias("a"), F.col("to").alias("ra")), "a")
        moved = moved.join(chosen.select(F.col("node").alias("b"), F.col("to").alias("rb")), "b")
        pair = [F.least("ra", "rb").alias("a"), F.greatest("ra", "rb").alias("b")]
        edges = cut(moved.where("ra <> rb").select(*pair).distinct())
        turn += 1
    if names is None:
        return edges.select(F.col("a").alias("node"), F.col("b").alias("component"))
    least = names.groupBy("to").agg(F.min("node").alias("component"))
    return names.join(least, "to").select("node", "component")
