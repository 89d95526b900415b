"""BPE encoding and decoding by batched numpy merge rounds.

The distinct chunks of a slice of texts are encoded once: the symbols of all their words lie in
one flat array, and each round looks the neighbouring pairs up by binary search over the sorted
pair keys of the vocabulary, then merges the pair of lowest rank in every word at once.

What is a letter or a number follows the Unicode version of the installed ``regex``; code points
that the tokenizers library knows no category of yet may be split otherwise than there.
"""

from __future__ import annotations

import hashlib
import json
import unicodedata
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame

from .common import prepare, slices, spread, words_of

#: Chunks, and words, whose ids a worker keeps from one slice of texts to the next.
MEMO_ENTRIES = 1 << 19
_NONE = np.iinfo(np.int32).max


def byte_letters() -> list[str]:
    """The character that stands for each byte in a byte-level vocabulary."""
    shown = {*range(33, 127), *range(161, 173), *range(174, 256)}
    spare = iter(range(256, 512))
    return [chr(b) if b in shown else chr(next(spare)) for b in range(256)]


def load(path: str) -> dict:
    """A tokenizer file (byte-level BPE with a word end, lower case) as arrays, read on the driver.

    Its size is that of the vocabulary alone, so it may be broadcast.
    """
    with open(path, encoding="utf-8") as file:
        whole = json.load(file)
    model = whole["model"]
    vocab, end = model["vocab"], model["end_of_word_suffix"]
    pairs = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"]]
    keys = np.array([vocab[a] << 32 | vocab[b] for a, b in pairs], np.uint64)
    merged = np.array([vocab[a + b] for a, b in pairs], np.int32)
    order = np.argsort(keys)
    special = {t["content"]: t["id"] for t in whole["added_tokens"]}
    names = {**{i: t for t, i in vocab.items()}, **{i: t for t, i in special.items()}}
    letters = byte_letters()
    return {
        "keys": keys[order],
        "ranks": order.astype(np.int32),
        "merged": merged[order],
        "inner": np.array([vocab[c] for c in letters], np.int32),
        "last": np.array([vocab[c + end] for c in letters], np.int32),
        "special": special,
        "tokens": pa.array([names.get(i, "") + " " for i in range(max(names) + 1)]),
        "pattern": next(p["pattern"]["Regex"] for p in whole["pre_tokenizer"]["pretokenizers"] if "pattern" in p),
    }


def merge(words: pa.Array, vocabulary: dict) -> tuple[np.ndarray, np.ndarray]:
    """The ids of all words in one array, and the number of ids of each word; words are not empty."""
    keys, ranks, merged = vocabulary["keys"], vocabulary["ranks"], vocabulary["merged"]
    sizes = pc.binary_length(words).to_numpy(zero_copy_only=False).astype(np.int64)
    data = np.frombuffer(b"".join(words.cast(pa.binary()).to_pylist()), np.uint8)
    ids = vocabulary["inner"][data]
    ends = np.cumsum(sizes)
    ids[ends - 1] = vocabulary["last"][data[ends - 1]]
    word = np.repeat(np.arange(len(sizes), dtype=np.int32), sizes)
    rank, at = np.full(len(ids), _NONE, np.int32), np.zeros(len(ids), np.int32)
    fresh = np.arange(len(ids))  # symbols whose pair with the next one is new
    out_ids, out_word = [], []
    while len(ids):
        rank[fresh] = _NONE
        fresh = fresh[fresh < len(ids) - 1]
        fresh = fresh[word[fresh] == word[fresh + 1]]
        key = ids[fresh].astype(np.uint64) << np.uint64(32) | ids[fresh + 1].astype(np.uint64)
        found = np.minimum(np.searchsorted(keys, key), len(keys) - 1)
        known = keys[found] == key
        at[fresh[known]] = found[known]
        rank[fresh[known]] = ranks[found[known]]
        starts = np.flatnonzero(np.concatenate([[True], word[1:] != word[:-1]]))
        lengths = np.diff(np.append(starts, len(ids)))
        lowest = np.repeat(np.minimum.reduceat(rank, starts), lengths)
        ready = lowest == _NONE
        out_ids.append(ids[ready])
        out_word.append(word[ready])
        hits = np.flatnonzero((rank == lowest) & ~ready)
        if len(hits):  # of overlapping pairs (a a a) every other one merges, from the left
            turn = np.arange(len(hits))
            begins = np.concatenate([[True], hits[1:] != hits[:-1] + 1])
            hits = hits[(turn - np.maximum.accumulate(np.where(begins, turn, 0))) % 2 == 0]
        ids[hits] = merged[at[hits]]
        stays = ~ready
        stays[hits + 1] = False
        new = np.cumsum(stays)[hits] - 1
        touched = np.zeros(int(stays.sum()), bool)
        touched[new] = touched[np.maximum(new - 1, 0)] = True
        fresh = np.flatnonzero(touched)
        ids, word, rank, at = ids[stays], word[stays], rank[stays], at[stays]
    ids, word = np.concatenate([*out_ids, np.zeros(0, np.int32)]), np.concatenate([*out_word, np.zeros(0, np.int32)])
    return ids[np.argsort(word, kind="stable")], np.bincount(word, minlength=len(sizes))


def remembered(kind: str, keys: pa.Array, work, vocabulary: dict) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Where each key stands among the entries kept, and the ids and lengths of all entries.

    ``work`` makes the ids of the keys that are new.
    """
    known, ids, lengths = vocabulary.get(kind) or (keys[:0], np.zeros(0, np.int32), np.zeros(0, np.int64))
    if len(known) > MEMO_ENTRIES:
        known, ids, lengths = known[:0], ids[:0], lengths[:0]
    place = pc.index_in(keys, known)
    new = keys.filter(pc.is_null(place))
    place = pc.fill_null(place, -1).to_numpy(zero_copy_only=False).copy()
    if len(new):
        place[place < 0] = np.arange(len(known), len(known) + len(new))
        new_ids, new_lengths = work(new, vocabulary)
        known, ids = pa.concat_arrays([known, new]), np.concatenate([ids, new_ids])
        lengths = np.concatenate([lengths, new_lengths])
        vocabulary[kind] = known, ids, lengths
    return place, ids, lengths


def split_chunks(chunks: str, vocabulary: dict) -> list[str]:
    """The words of all chunks, given one a line, with a line feed between those of two chunks.

    Special tokens are taken from the text as it stands, before it is normalised.
    """
    pattern = regex.compile(vocabulary["pattern"] + "|\n")
    special = regex.compile("(" + "|".join(map(regex.escape, vocabulary["special"])) + ")")
    words: list[str] = []
    for part in special.split(chunks):
        if part in vocabulary["special"]:
            words.append(part)
            continue
        part = unicodedata.normalize("NFC", part)  # lower case by character: no rule for the end of a word
        words += pattern.findall("".join(c.lower() for c in part) if "Σ" in part else part.lower())
    return words


def encode_chunks(chunks: pa.Array, vocabulary: dict) -> tuple[np.ndarray, np.ndarray]:
    """The ids of chunks without blanks or line feeds in one array, and the number of ids of each."""
    lines = pc.binary_join(pa.ListArray.from_arrays(pa.array([0, len(chunks)], pa.int32()), chunks), "\n")
    words = split_chunks(lines[0].as_py(), vocabulary)
    coded = pa.array([*words, "\n"], pa.string()).dictionary_encode()
    place, ids, lengths = remembered("words", coded.dictionary, merge, vocabulary)
    ids, lengths = spread(ids, lengths, place), lengths[place]
    for token, number in [*vocabulary["special"].items(), ("\n", None)]:
        place = coded.dictionary.index(token).as_py()
        if place >= 0:
            start = int(lengths[:place].sum())
            alone = [] if number is None else [number]
            ids = np.concatenate([ids[:start], alone, ids[start + lengths[place] :]]).astype(np.int32)
            lengths[place] = len(alone)
    codes = coded.indices.to_numpy(zero_copy_only=False)
    upto = np.cumsum(lengths[codes])[codes == coded.dictionary.index("\n").as_py()]
    return spread(ids, lengths, codes), np.diff(upto, prepend=0)


def encode(texts: pa.Array, vocabulary: dict) -> tuple[np.ndarray, np.ndarray]:
    """The ids of all texts in one array, and the number of ids of each; null is the empty text.

    Chunks and words met before are kept with the vocabulary, a bounded number of them.
    """
    blanks = pc.replace_substring(pc.replace_substring(texts, "\n", " "), "\t", " ")
    chunks = words_of(blanks, " ")
    if not len(chunks.codes):
        return np.zeros(0, np.int32), np.zeros(len(texts), np.int64)
    place, ids, lengths = remembered("chunks", chunks.distinct, encode_chunks, vocabulary)
    picks = place[chunks.codes]
    ends = np.concatenate([[0], np.cumsum(lengths[picks])])
    return spread(ids, lengths, picks), ends[chunks.ends] - ends[chunks.starts]


def decode(ids: np.ndarray, counts: np.ndarray, vocabulary: dict) -> list[memoryview]:
    """The tokens of each text joined by blanks, as UTF-8; ids beyond the vocabulary give nothing."""
    known = (ids >= 0) & (ids < len(vocabulary["tokens"]))
    if not known.all():
        ends = np.concatenate([[0], np.cumsum(known)])
        stops = np.cumsum(counts)
        counts, ids = ends[stops] - ends[stops - counts], ids[known]
    tokens = vocabulary["tokens"].cast(pa.large_string()).take(pa.array(ids))
    _, places, data = tokens.buffers()
    places = np.frombuffer(places, np.int64, len(ids) + 1)
    view, stops = memoryview(data if data is not None else b""), np.cumsum(counts)
    bounds = zip(places[stops - counts].tolist(), places[stops].tolist(), strict=True)
    return [view[a : max(a, b - 1)] for a, b in bounds]


def encode_documents(df: DataFrame, vocabulary_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``df``: its id, ``ids`` (array of int) and ``decoded`` (text).

    A null text counts as empty: no ids, an empty text. Rows with equal or null ids stay apart.
    """
    shared = prepare(df.sparkSession).sparkContext.broadcast(load(vocabulary_path))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, "text", 1 << 20):
            ids, counts = encode(part.column("text"), shared.value)
            offsets = np.concatenate([[0], np.cumsum(counts)]).astype(np.int32)
            decoded = [str(x, "utf-8") for x in decode(ids, counts, shared.value)]
            columns = [part.column("id"), pa.ListArray.from_arrays(pa.array(offsets), pa.array(ids)), pa.array(decoded, pa.string())]
            yield pa.RecordBatch.from_arrays(columns, ["id", "ids", "decoded"])

    given = df.select(df[id_col].alias("id"), df[text_col].alias("text"))
    kind = given.schema["id"].dataType.simpleString()
    return given.mapInArrow(run, f"id {kind}, ids array<int>, decoded string").withColumnRenamed("id", id_col)


def digest_documents(df: DataFrame, vocabulary_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``encode_documents`` as digests taken where the ids are made: n_tokens, ids_sha256, decoded_sha256."""
    shared = prepare(df.sparkSession).sparkContext.broadcast(load(vocabulary_path))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, "text"):
            ids, counts = encode(part.column("text"), shared.value)
            view, ends = memoryview(ids.astype("<u4").view(np.uint8)), 4 * np.cumsum(counts)
            hashed = [hashlib.sha256(view[b - 4 * n : b]).hexdigest() for b, n in zip(ends.tolist(), counts.tolist(), strict=True)]
            back = [hashlib.sha256(x).hexdigest() for x in decode(ids, counts, shared.value)]
            columns = [part.column("id"), pa.array(counts, pa.int64()), pa.array(hashed, pa.string()), pa.array(back, pa.string())]
            yield pa.RecordBatch.from_arrays(columns, ["id", "n_tokens", "ids_sha256", "decoded_sha256"])

    given = df.select(df[id_col].alias("id"), df[text_col].alias("text"))
    kind = given.schema["id"].dataType.simpleString()
    schema = f"id {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string"
    return given.mapInArrow(run, schema).withColumnRenamed("id", id_col)
