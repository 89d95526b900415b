"""Near duplicates by improved consistent weighted sampling over TF-IDF shingles.

A shingle weighs its count in the text times the mean inverse document frequency of its words.
(Document frequencies of the shingles themselves would make the members of a large group of near
copies unlike each other: what they share would be frequent, so light.) Samples are banded into
buckets; what shares a bucket is compared by its samples, then verified by the weighted Jaccard
similarity of whole texts. Exact copies are one node throughout.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import components, cut, mixed, parts, prepare, slices, whole_groups, words_of

SHINGLE = 5
#: 16 bands of 4 samples: two texts of similarity 0.8 share a bucket with probability 0.9998.
SAMPLES, BAND = 64, 4
#: Document frequencies are counted by a hash of the word: a table of fixed size, whatever the corpus.
WORD_BUCKETS, SLICE = 1 << 18, 1 << 12
#: Of a pair's samples at least this share must agree before texts are compared: 3.6 standard
#: deviations below a similarity of 0.8.
LEAST_AGREEMENT = 0.62
#: Members of a bucket that are compared in one block.
BLOCK = 512
PUNCTUATION = "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~«»“”„‘’…–—¿¡·"
_RANDOM_BITS = 16


def word_hashes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The hash of each word, lower case without punctuation at its ends, and the words of each text."""
    words = words_of(texts)
    bare = pc.utf8_trim(pc.utf8_lower(words.distinct), characters=PUNCTUATION)
    words = words.keep(pc.binary_length(bare).to_numpy(zero_copy_only=False) > 0)
    hashes = np.array([xxhash.xxh64_intdigest(w) for w in bare.cast(pa.binary()).to_pylist()], np.uint64)
    return hashes[words.codes] if len(words.codes) else np.zeros(0, np.uint64), words.counts


def document_frequencies(df: DataFrame) -> np.ndarray:
    """How many texts hold a word of each bucket; the last entry counts the texts."""

    def count(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = np.zeros(WORD_BUCKETS + SLICE, np.int64)
        for part in slices(batches, "text"):
            hashes, counts = word_hashes(part.column("text"))
            text = np.repeat(np.arange(len(counts)), counts)
            pairs = np.unique(text * WORD_BUCKETS + (hashes % np.uint64(WORD_BUCKETS)).astype(np.int64))
            found[:WORD_BUCKETS] += np.bincount(pairs % WORD_BUCKETS, minlength=WORD_BUCKETS)
            found[WORD_BUCKETS] += int((counts > 0).sum())
        yield from rows(found)

    def rows(found: np.ndarray) -> Iterator[pa.RecordBatch]:
        full = found.reshape(-1, SLICE)
        some = np.flatnonzero(full.any(axis=1))
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array([x.tobytes() for x in full[some]], pa.binary())], ["slice", "counts"])

    def add(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = np.zeros((WORD_BUCKETS // SLICE + 1, SLICE), np.int64)
        for batch in batches:
            for k, counts in zip(batch.column("slice").to_pylist(), batch.column("counts").to_pylist(), strict=True):
                found[k] += np.frombuffer(counts, np.int64)
        yield from rows(found.reshape(-1))

    schema = "slice long, counts binary"
    total = np.zeros((WORD_BUCKETS // SLICE + 1, SLICE), np.int64)
    for row in df.select("text").mapInArrow(count, schema).repartition(16, "slice").mapInArrow(add, schema).collect():
        total[row["slice"]] += np.frombuffer(row["counts"], np.int64)  # 65 rows of fixed size
    return total.reshape(-1)[: WORD_BUCKETS + 1]


def weights_of_words(frequencies: np.ndarray) -> np.ndarray:
    return np.log1p(max(int(frequencies[-1]), 1) / np.maximum(frequencies[:-1], 1)).astype(np.float32)


def shingles(hashes: np.ndarray, counts: np.ndarray, idf: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct shingles of each text (ascending), their weights, and how many each text has.

    A text of fewer than five words has one shingle of all of them.
    """
    if not len(hashes):
        return np.zeros(0, np.uint64), np.zeros(0, np.float32), np.zeros(len(counts), np.int64)
    per_word = idf[(hashes % np.uint64(WORD_BUCKETS)).astype(np.int64)]
    ends = np.cumsum(counts)
    left = np.repeat(ends, counts) - np.arange(len(hashes))  # words from here to the end of the text
    gram, weight, have = np.zeros(len(hashes), np.uint64), np.zeros(len(hashes), np.float32), np.minimum(left, SHINGLE)
    for k in range(SHINGLE):
        inside = left > k
        value = np.zeros(len(hashes), np.uint64)
        value[: len(hashes) - k] = hashes[k:]
        gram = np.where(inside, mixed(gram ^ value), gram)
        value = np.zeros(len(hashes), np.float32)
        value[: len(hashes) - k] = per_word[k:]
        weight += np.where(inside, value, np.float32(0))
    first = np.zeros(len(hashes), bool)
    first[(ends - counts)[counts > 0]] = True
    real = (left >= SHINGLE) | first
    text = np.repeat(np.arange(len(counts), dtype=np.uint64), counts)[real]
    gram, weight = gram[real] >> np.uint64(20), (weight / have)[real]
    key = text << np.uint64(44) | gram
    order = np.argsort(key)
    key = key[order]
    new = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
    times = np.diff(np.append(new, len(key))).astype(np.float32)
    many = np.bincount((key[new] >> np.uint64(44)).astype(np.int64), minlength=len(counts))
    return key[new] & np.uint64((1 << 44) - 1), weight[order][new] * times, many


def random_tables() -> tuple[np.ndarray, ...]:
    """Per random index: a gamma(2, 1) number, its reciprocal, the logarithm of another one, a uniform number."""
    random = np.random.default_rng(20)
    size = 1 << _RANDOM_BITS
    r = random.gamma(2.0, 1.0, size).astype(np.float32)
    return r, 1 / r, np.log(random.gamma(2.0, 1.0, size)).astype(np.float32), random.random(size).astype(np.float32)


def samples(grams: np.ndarray, weights: np.ndarray, counts: np.ndarray, tables) -> np.ndarray:
    """The consistent weighted samples of each text (texts x 64, 32 bits each); every text has a shingle.

    With r, c from gamma(2, 1) and b uniform for a shingle and a sample: t = floor(ln w / r + b), and the
    shingle of least ln c - r (t - b + 1) is drawn, with its t.
    """
    out = np.zeros((len(counts), SAMPLES), np.uint32)
    ends = np.cumsum(counts)
    odd = mixed(np.arange(1, SAMPLES + 1)) | np.uint64(1)
    at = 0
    while at < len(counts):  # some 32,000 shingles at once stay in the processor's cache
        before = ends[at - 1] if at else 0
        stop = max(at + 1, int(np.searchsorted(ends, before + (1 << 15), side="right")))
        mine, sizes = grams[before : ends[stop - 1]], counts[at:stop]
        logs, starts = np.log(weights[before : ends[stop - 1]]), np.cumsum(sizes) - sizes
        r, inverse, log_c, b = tables
        for k in range(SAMPLES):
            index = (mine * odd[k]) >> np.uint64(64 - _RANDOM_BITS)
            shift = b[index]
            t = np.floor(logs * inverse[index] + shift)
            value = log_c[index] - r[index] * (t - shift + 1)
            least = np.repeat(np.minimum.reduceat(value, starts), sizes)
            hits = np.flatnonzero(value == least)
            drawn = hits[np.searchsorted(hits, starts)]
            out[at:stop, k] = (mixed(mine[drawn] ^ mixed(t[drawn].astype(np.int64).view(np.uint64))) >> np.uint64(32)).astype(np.uint32)
        at = stop
    return out


def signatures(df: DataFrame, idf) -> DataFrame:
    """Per text with a word: id, a 128-bit key of its words (k1, k2), its samples, its band keys."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tables = random_tables()
        for part in slices(batches, "text"):
            hashes, counts = word_hashes(part.column("text"))
            full = np.flatnonzero(counts)
            grams, weights, many = shingles(hashes, counts, idf.value)
            drawn = samples(grams, weights, many[full], tables)
            bands = np.zeros((len(full), SAMPLES // BAND), np.uint64)
            for k in range(BAND):
                bands = mixed(bands ^ drawn[:, k::BAND].astype(np.uint64))
            bands = mixed(bands + np.arange(SAMPLES // BAND, dtype=np.uint64)).view(np.int64)
            view, ends = memoryview(hashes.view(np.uint8)), 8 * np.cumsum(counts)
            keys = b"".join(xxhash.xxh3_128_digest(view[ends[k] - 8 * counts[k] : ends[k]]) for k in full.tolist())
            keys = np.frombuffer(keys, np.int64).reshape(-1, 2)
            offsets = pa.array(np.arange(len(full) + 1, dtype=np.int32) * bands.shape[1])
            columns = [part.column("id").take(pa.array(full)), pa.array(keys[:, 0]), pa.array(keys[:, 1])]
            columns += [pa.array([x.tobytes() for x in drawn], pa.binary()), pa.ListArray.from_arrays(offsets, pa.array(bands.reshape(-1)))]
            yield pa.RecordBatch.from_arrays(columns, ["id", "k1", "k2", "drawn", "bands"])

    return df.select("id", "text").mapInArrow(run, "id long, k1 long, k2 long, drawn binary, bands array<long>")


def similarity(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> float:
    """The weighted Jaccard similarity of two sets of shingles (ascending) with weights."""
    _, x, y = np.intersect1d(a[0], b[0], assume_unique=True, return_indices=True)
    both = float(np.minimum(a[1][x], b[1][y]).sum())
    return both / max(float(a[1].sum()) + float(b[1].sum()) - both, 1e-30)


def links_between(members: DataFrame, nodes: DataFrame, texts: DataFrame, classes: DataFrame, idf, threshold: float) -> DataFrame:
    """Links (a, b) that join the classes which have any: found and verified bucket by bucket.

    In the first bucket that two nodes of different classes share they are compared, by their samples
    and then by their whole texts, the most alike first; once a link has joined two classes, other
    pairs of these are passed over there. So no pair of nodes becomes a row. Large buckets are
    compared block by block.
    """
    of = members.join(classes, "node")
    sizes = of.groupBy("bucket").agg(F.count(F.lit(1)).alias("n"), F.min("class").alias("lo"), F.max("class").alias("hi"))
    open_ = sizes.where("lo <> hi").select("bucket", F.ceil(F.col("n") / BLOCK).cast("int").alias("blocks"))
    rows = of.join(open_, "bucket").withColumn("block", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))
    other = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other")
    dealt = rows.select("bucket", "node", "class", "block", other)
    cell = F.xxhash64("bucket", F.least("block", "other"), F.greatest("block", "other")).alias("cell")
    held = nodes.select("node", "drawn", "bands").join(texts, "node")
    dealt = dealt.select(cell, "bucket", "node", "class", "block").join(held, "node")

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in whole_groups(batches, "cell"):
            cells, bucket, node, of, block = (table.column(c).to_numpy() for c in ("cell", "bucket", "node", "class", "block"))
            drawn = np.frombuffer(b"".join(table.column("drawn").to_pylist()), np.uint32).reshape(-1, SAMPLES)
            bands = table.column("bands").combine_chunks().flatten().to_numpy().reshape(len(node), -1)
            coded = table.column("text").combine_chunks().dictionary_encode()
            grams, weights, many = shingles(*word_hashes(coded.dictionary), idf.value)
            place, ends = coded.indices.to_numpy(), np.cumsum(many)
            found = []

            def shingles_of(row):
                part = slice(ends[place[row]] - many[place[row]], ends[place[row]])
                return grams[part], weights[part]

            for start, stop in parts(cells):
                pairs = _alike(drawn[start:stop], bands[start:stop], of[start:stop], block[start:stop], bucket[start])
                join: dict[int, int] = {}
                for x, y in (pairs + start).tolist():
                    a, b = _root(join, of[x]), _root(join, of[y])
                    if a != b and similarity(shingles_of(x), shingles_of(y)) >= threshold - 1e-6:
                        join[max(a, b)] = min(a, b)
                        found.append((node[x], node[y]))
            pairs = np.array(found, np.int64).reshape(-1, 2)
            yield pa.RecordBatch.from_arrays([pa.array(pairs[:, 0]), pa.array(pairs[:, 1])], ["a", "b"])

    together = dealt.repartition("cell").sortWithinPartitions("cell")
    return together.mapInArrow(run, "a long, b long")


def _root(join: dict[int, int], x: int) -> int:
    while x in join:
        x = join[x]
    return x


def _alike(drawn: np.ndarray, bands: np.ndarray, of: np.ndarray, block: np.ndarray, bucket: int) -> np.ndarray:
    """Pairs of rows of different classes that agree in enough samples and share no earlier bucket, most alike first."""
    band = int(np.flatnonzero(bands[0] == bucket)[0])
    across = block.min() != block.max()
    pairs, scores = [], []
    for at in range(0, len(of), 128):
        rows = np.arange(at, min(at + 128, len(of)))
        agree = np.zeros((len(rows), len(of)), np.uint8)
        for k in range(SAMPLES):
            agree += drawn[rows, k][:, None] == drawn[:, k][None, :]
        fit = (agree >= LEAST_AGREEMENT * SAMPLES) & (of[rows][:, None] != of[None, :]) & (rows[:, None] < np.arange(len(of))[None, :])
        if across:
            fit &= block[rows][:, None] != block[None, :]
        x, y = np.nonzero(fit)
        first = ~(bands[rows[x], :band] == bands[y, :band]).any(axis=1)
        pairs.append(np.column_stack([rows[x], y])[first])
        scores.append(agree[x, y][first])
    return np.concatenate(pairs)[np.argsort(-np.concatenate(scores).astype(np.int64), kind="stable")]


def merged(classes: DataFrame, links: DataFrame) -> DataFrame:
    """``classes`` (node, class) after the links (a, b) have joined some of them."""
    left = classes.select(F.col("node").alias("a"), F.col("class").alias("class_a"))
    right = classes.select(F.col("node").alias("b"), F.col("class").alias("class_b"))
    between = links.join(left, "a").join(right, "b").select(F.col("class_a").alias("a"), F.col("class_b").alias("b"))
    moved = components(between).withColumnRenamed("node", "class")
    return cut(classes.join(moved, "class", "left").select("node", F.coalesce("component", "class").alias("class")))


def verify(pairs: DataFrame, texts: DataFrame, idf, threshold: float) -> DataFrame:
    """The pairs whose texts have a weighted Jaccard similarity of ``threshold`` or more, with it."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, "text_b"):
            sides = []
            for name in ("text_a", "text_b"):
                coded = part.column(name).dictionary_encode()  # a node in many pairs is cut into shingles once
                grams, weights, many = shingles(*word_hashes(coded.dictionary), idf.value)
                ends = np.cumsum(many)
                sides.append((coded.indices.to_numpy(), grams, weights, ends - many, ends))
            (ia, ga, wa, sa, ea), (ib, gb, wb, sb, eb) = sides
            pairs = zip(ia.tolist(), ib.tolist(), strict=True)
            similar = [similarity((ga[sa[i] : ea[i]], wa[sa[i] : ea[i]]), (gb[sb[j] : eb[j]], wb[sb[j] : eb[j]])) for i, j in pairs]
            similar = np.array(similar, float)
            hit = pa.array(similar >= threshold - 1e-6)
            yield pa.RecordBatch.from_arrays([part.column("a").filter(hit), part.column("b").filter(hit), pa.array(similar).filter(hit)], ["a", "b", "similarity"])

    left = texts.select(F.col("node").alias("a"), F.col("text").alias("text_a"))
    right = texts.select(F.col("node").alias("b"), F.col("text").alias("text_b"))
    joined = pairs.join(left, "a").join(right, "b").select("a", "b", "text_a", "text_b")
    return joined.mapInArrow(run, "a long, b long, similarity double")


def near_duplicates(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = 0.8) -> DataFrame:
    """Every row's id, ``class_id`` (the smallest id of its near-duplicate class) and ``kept``.

    Texts are alike if their TF-IDF weighted five-word shingles have a Jaccard similarity of
    ``threshold`` or more, words being lower-cased and without punctuation at their ends; classes are
    what such links connect. First the member of each bucket that shares most buckets is compared
    with the others, then all pairs of different classes in the first bucket that they share: no
    link between classes is passed over.
    Null, empty and wordless texts are each their own class. Ids are integers; rows that share an id
    share its class; a null id stays alone, with a null class, and is kept.
    """
    spark = prepare(df.sparkSession)
    docs = df.select(df[id_col].cast("long").alias("id"), df[text_col].cast("string").alias("text"))
    idf = spark.sparkContext.broadcast(weights_of_words(document_frequencies(docs)))
    signed = cut(signatures(docs.where("id IS NOT NULL"), idf))
    nodes = cut(signed.groupBy("k1", "k2").agg(F.min("id").alias("node"), F.first("drawn").alias("drawn"), F.first("bands").alias("bands")))
    in_bands = nodes.select("node", F.explode("bands").alias("bucket")).distinct()
    shared = in_bands.groupBy("bucket").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    members = cut(in_bands.join(shared, "bucket"))
    mass = members.groupBy("node").agg(F.sum("n").alias("mass"))
    hubs = members.join(mass, "node").groupBy("bucket").agg(F.min(F.struct((-F.col("mass")).alias("mass"), "node"))["node"].alias("hub"))
    members = members.select("node", "bucket")
    pairs = members.join(hubs, "bucket").where("node <> hub").select(F.least("node", "hub").alias("a"), F.greatest("node", "hub").alias("b")).distinct()
    classes = cut(members.select("node").distinct().withColumn("class", F.col("node")))
    texts = docs.withColumnRenamed("id", "node").join(classes.select("node"), "node")
    texts = cut(texts.groupBy("node").agg(F.first("text").alias("text")) if _repeats(docs) else texts)
    classes = merged(classes, verify(pairs, texts, idf, threshold))
    classes = merged(classes, cut(links_between(members, nodes, texts, classes, idf, threshold)))
    of_node = nodes.select("k1", "k2", "node").join(classes, "node", "left").select("k1", "k2", F.coalesce("class", "node").alias("class"))
    of_id = signed.select("id", "k1", "k2").join(of_node, ["k1", "k2"]).groupBy("id").agg(F.min("class").alias("class"))
    ids = df.select(df[id_col].alias("id"))
    out = ids.join(of_id.withColumnRenamed("id", "of"), F.col("id") == F.col("of"), "left")
    class_id = F.coalesce("class", "id")
    return out.select(F.col("id").alias(id_col), class_id.alias("class_id"), F.coalesce(class_id == F.col("id"), F.lit(True)).alias("kept"))


def _repeats(docs: DataFrame) -> bool:
    """Whether an id stands in more than one row."""
    return not docs.where("id IS NOT NULL").groupBy("id").count().where("count > 1").isEmpty()


def keep_one(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One document of each class of near duplicates, the one of the smallest id; rows that share an id stay together."""
    name = "kept"
    while name.lower() in map(str.lower, df.columns):
        name += "_"
    judged = near_duplicates(df, id_col, text_col).where("kept").select(F.col(id_col).alias(name)).distinct()
    return df.join(judged, df[id_col].eqNullSafe(F.col(name)), "left_semi")
