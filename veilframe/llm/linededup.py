"""Line dedup by a sharded minimal perfect hash that documents probe.

The keys of lines that repeat are placed by a minimal perfect hash, shard by shard; a key's place
indexes compact arrays: a 64-bit fingerprint, the number of documents and the largest document id.
Only 16 bytes of hash and an id travel per line; neither lines nor arrays pass the driver.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import cut, mixed, parts, slices, whole_groups

#: Keys of one shard: some 1.5 MB of arrays.
SHARD_KEYS = 1 << 16
#: Lines that probe one copy of a shard. A shard has as many copies as its lines ask for, so a line
#: that is in a third of all documents goes to more tasks the more there are.
PROBES = 1 << 18
_LEVELS = 40


def places(h1: np.ndarray, h2: np.ndarray, level: int, size: int) -> np.ndarray:
    """Where the keys fall in a level of ``size`` bits."""
    step = np.uint64((level + 1) * 0x9E3779B97F4A7C15 % 2**64)
    return (mixed(h1.view(np.uint64) + step) ^ mixed(h2.view(np.uint64) ^ step)) % np.uint64(size)


def build(h1: np.ndarray, h2: np.ndarray) -> tuple[list[int], np.ndarray, np.ndarray]:
    """A minimal perfect hash of distinct keys: sizes of its levels, its bits, and each key's place.

    In every level the keys that fall alone on a bit set it; the others go on to the next level.
    A key's place is the number of bits set before its own.
    """
    left, sizes, bits, spot = np.arange(len(h1)), [], [], np.zeros(len(h1), np.int64)
    offset = 0
    while len(left):
        if len(sizes) == _LEVELS:
            raise ValueError("keys repeat, so no perfect hash exists")
        size = 2 * len(left) + 1
        at = places(h1[left], h2[left], len(sizes), size).astype(np.int64)
        alone = np.bincount(at, minlength=size) == 1
        own = alone[at]
        spot[left[own]] = offset + at[own]
        sizes.append(size)
        bits.append(alone)
        left, offset = left[~own], offset + size
    whole = np.concatenate([*bits, np.zeros(0, bool)])
    return sizes, whole, (np.cumsum(whole) - 1)[spot]


def probe(h1: np.ndarray, h2: np.ndarray, sizes: list[int], bits: np.ndarray, ranks: np.ndarray) -> np.ndarray:
    """The place of each key, or of some other key where it isn't one of those placed; -1 for none."""
    place, left, offset = np.full(len(h1), -1, np.int64), np.arange(len(h1)), 0
    for level, size in enumerate(sizes):
        at = places(h1[left], h2[left], level, size).astype(np.int64) + offset
        hit = bits[at]
        place[left[hit]] = ranks[at[hit]]
        left, offset = left[~hit], offset + size
        if not len(left):
            break
    return place


def line_table(texts: pa.Array, min_chars: int) -> tuple[pa.Array, np.ndarray, np.ndarray, np.ndarray]:
    """All lines of the texts, the number per text, which are long enough, and their 128-bit keys (n x 2)."""
    lists = pc.split_pattern(pc.fill_null(texts, ""), "\n")
    lines = lists.flatten()
    keys = pc.ascii_lower(pc.ascii_trim_whitespace(lines))
    long = pc.greater_equal(pc.utf8_length(keys), min_chars).to_numpy(zero_copy_only=False)
    digests = b"".join(xxhash.xxh3_128_digest(k) for k in keys.filter(pa.array(long)).cast(pa.binary()).to_pylist())
    hashes = np.zeros((len(lines), 2), np.int64)
    hashes[long] = np.frombuffer(digests, np.int64).reshape(-1, 2)
    return lines, pc.list_value_length(lists).to_numpy(zero_copy_only=False).astype(np.int64), long, hashes


def line_keys(df: DataFrame, min_chars: int) -> DataFrame:
    """The distinct (``id``, ``h1``, ``h2``) of the lines of at least ``min_chars`` characters."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, "text"):
            _, counts, long, hashes = line_table(part.column("text"), min_chars)
            owner = np.repeat(np.arange(part.num_rows), counts)[long]
            rows = np.unique(np.column_stack([owner, hashes[long]]), axis=0) if len(owner) else np.zeros((0, 3), np.int64)
            ids = part.column("id").take(pa.array(rows[:, 0]))
            yield pa.RecordBatch.from_arrays([ids, pa.array(rows[:, 1]), pa.array(rows[:, 2])], ["id", "h1", "h2"])

    return df.select("id", "text").mapInArrow(run, "id long, h1 long, h2 long").distinct()


def build_index(keys: DataFrame, shards: int) -> DataFrame:
    """One row per shard of ``keys`` (h1, h2, n, last): the hash and the arrays that it indexes."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in whole_groups(batches, "shard"):
            shard = table.column("shard").to_numpy()
            h1, h2, n, last = (table.column(c).to_numpy() for c in ("h1", "h2", "n", "last"))
            for a, b in parts(shard):
                sizes, bits, place = build(h1[a:b], h2[a:b])
                order = np.argsort(place)
                arrays = [np.packbits(bits), h2[a:b][order], n[a:b][order].astype(np.int32), last[a:b][order]]
                row = [[int(shard[a])], [sizes], *([x.tobytes()] for x in arrays)]
                yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(row, kinds, strict=True)], names)

    names = ["shard", "sizes", "bits", "prints", "counts", "lasts"]
    kinds = [pa.int64(), pa.list_(pa.int32()), *[pa.binary()] * 4]
    schema = "shard long, sizes array<int>, bits binary, prints binary, counts binary, lasts binary"
    by_shard = keys.withColumn("shard", F.pmod("h1", F.lit(shards)))
    return by_shard.repartition("shard").sortWithinPartitions("shard").mapInArrow(run, schema)


def probe_index(lines: DataFrame, index: DataFrame, shards: int) -> DataFrame:
    """(``id``, ``h1``, ``h2``, ``n``) of the lines in the index, but for the largest id that holds each.

    A shard's arrays come first in their partition; its probes then pass by in batches.
    """

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, arrays = None, None
        for batch in batches:
            shard, salt = (batch.column(c).to_numpy() for c in ("shard", "salt"))
            kind = batch.column("kind").to_numpy()
            for a, b in parts((shard << 32) + salt):
                part, first = batch.slice(a, b - a), int(np.count_nonzero(kind[a:b] == 0))
                if first:
                    row = part.column("arrays")[0].as_py()
                    bits = np.unpackbits(np.frombuffer(row["bits"], np.uint8), count=sum(row["sizes"])).astype(bool)
                    prints, lasts = (np.frombuffer(row[c], np.int64) for c in ("prints", "lasts"))
                    now, arrays = (shard[a], salt[a]), (row["sizes"], bits, np.cumsum(bits) - 1, prints, lasts, np.frombuffer(row["counts"], np.int32))
                part = part.slice(first)
                if now != (shard[a], salt[a]) or not part.num_rows:
                    continue  # no key of this shard is frequent
                sizes, bits, ranks, prints, lasts, counts = arrays
                h1, h2 = (part.column(c).to_numpy(zero_copy_only=False) for c in ("h1", "h2"))
                place = probe(h1, h2, sizes, bits, ranks)
                known = (place >= 0) & (prints[place] == h2)
                ids = part.column("id")
                own = pc.fill_null(pc.equal(ids, pa.array(lasts[place])), False).to_numpy(zero_copy_only=False)
                drop = pa.array(known & ~own)
                found = pa.array(counts[place].astype(np.int64))
                yield pa.RecordBatch.from_arrays([x.filter(drop) for x in (ids, pa.array(h1), pa.array(h2), found)], ["id", "h1", "h2", "n"])

    arrays = F.struct("sizes", "bits", "prints", "counts", "lasts").alias("arrays")
    sharded = lines.withColumn("shard", F.pmod("h1", F.lit(shards)))
    many = F.ceil(F.count(F.lit(1)) / PROBES).cast("int").alias("salts")
    # a row of two numbers for each shard of SHARD_KEYS keys
    salts = cut(sharded.groupBy("shard").agg(many))
    each = F.explode(F.sequence(F.lit(0), F.col("salts") - 1)).alias("salt")
    copies = index.join(F.broadcast(salts), "shard").select("shard", each, F.lit(0).alias("kind"), arrays)
    salt = F.pmod(F.xxhash64("id"), F.col("salts")).cast("int").alias("salt")
    probes = sharded.join(F.broadcast(salts), "shard").select("shard", salt, F.lit(1).alias("kind"), "id", "h1", "h2")
    both = copies.unionByName(probes, allowMissingColumns=True)
    together = both.repartition("shard", "salt").sortWithinPartitions("shard", "salt", "kind")
    return together.mapInArrow(run, "id long, h1 long, h2 long, n long")


def drop_lines(df: DataFrame, drops: DataFrame, id_col: str, text_col: str, min_chars: int) -> DataFrame:
    """``df`` without the lines that ``drops`` (id, h1, h2) names, with n_lines and n_dropped."""
    others = [c for c in df.columns if c not in (text_col, "n_lines", "n_dropped")]
    by_id = drops.groupBy("id").agg(F.collect_list(F.struct("h1", "h2")).alias("drop"))
    given = df.select(F.struct(*(df[c] for c in others)).alias("rest"), df[id_col].cast("long").alias("id"), df[text_col].alias("text"))
    joined = given.join(by_id.withColumnRenamed("id", "of"), F.col("id").eqNullSafe(F.col("of")), "left")

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, "text"):
            lines, counts, long, hashes = line_table(part.column("text"), min_chars)
            kept, dropped, start, lines = [], [], 0, lines.to_pylist()
            for n, drop in zip(counts.tolist(), part.column("drop").to_pylist(), strict=True):
                stop, out = start + n, lines[start : start + n]
                if drop:
                    gone = {(x["h1"], x["h2"]) for x in drop}
                    keys = zip(long[start:stop].tolist(), map(tuple, hashes[start:stop].tolist()), strict=True)
                    out = [x for x, (is_long, key) in zip(out, keys, strict=True) if not (is_long and key in gone)]
                kept.append("\n".join(out))
                dropped.append(n - len(out))
                start = stop
            columns = [part.column("rest"), pa.array(kept, pa.string()), pa.array(counts), pa.array(dropped, pa.int64())]
            yield pa.RecordBatch.from_arrays(columns, ["rest", "text", "n_lines", "n_dropped"])

    fields = [T.StructField("rest", joined.schema["rest"].dataType), T.StructField("text", T.StringType())]
    schema = T.StructType([*fields, T.StructField("n_lines", T.LongType()), T.StructField("n_dropped", T.LongType())])
    done = joined.select("rest", "text", "drop").mapInArrow(run, schema)
    columns = [F.col("text").alias(c) if c == text_col else F.col("rest")[c].alias(c) for c in df.columns if c in (text_col, *others)]
    return done.select(*columns, "n_lines", "n_dropped")


def dedup_lines(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_docs: int = 3, min_chars: int = 20) -> DataFrame:
    """``df`` with repeated lines taken out of its texts, and the columns n_lines and n_dropped.

    A line's key is the line without ASCII white space at its ends, A-Z in lower case. A key of
    at least ``min_chars`` characters in at least ``min_docs`` documents loses all its lines but
    for those in the largest id that holds it. Null and empty texts are one empty line. Rows that
    share an id are one document when documents are counted, and each keeps or loses its own lines;
    a null id is one document, below all others. Ids are integers. Columns n_lines and n_dropped of
    ``df`` are replaced.
    """
    lines = cut(line_keys(df.select(df[id_col].cast("long").alias("id"), df[text_col].alias("text")), min_chars))
    frequent = cut(lines.groupBy("h1", "h2").agg(F.count(F.lit(1)).alias("n"), F.max("id").alias("last")).where(F.col("n") >= min_docs))
    shards = max(1, -(-frequent.count() // SHARD_KEYS))
    drops = probe_index(lines, build_index(frequent, shards), shards)
    return drop_lines(df, drops, id_col, text_col, min_chars)
