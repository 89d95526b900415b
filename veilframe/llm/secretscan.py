"""Secrets in texts: fixed patterns, and strings that a vocabulary needs too many tokens for.

A byte-pair vocabulary spells ordinary words with few tokens and random strings with many. What
has few characters per token is reported, unless it looks like a digest or an identifier.
"""

from __future__ import annotations

import base64
import re
from bisect import bisect_left
from collections.abc import Iterable, Iterator

import pyarrow as pa
import tiktoken
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import prepare, slices

# The patterns of the task.
ASSIGN = r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS, HEX = r"AKIA[A-Z0-9]+", r"[0-9a-f]+"
ASSIGN_CHARS, ACCESS_CHARS, HEX_CHARS = 12, 18, 16
KINDS = ("assign", "access", "hex", "random")
#: Lengths of MD5, SHA-1, SHA-224, SHA-256, SHA-384 and SHA-512 digests in hexadecimal.
DIGESTS = {32, 40, 56, 64, 96, 128}
UUID = r"[0-9A-Fa-f]{8}(-[0-9A-Fa-f]{4}){3}-[0-9A-Fa-f]{12}"
#: How a text is split before the merges of the rank files.
SPLIT = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Symbols that passwords hold between letters and digits.
SYMBOLS = "!@#$%^&*~"
#: What parts of a run lie between, step by step: names and values, paths, words.
MARKS = ("=", "=/", "=/+_-")

SPAN = T.StructType([T.StructField("kind", T.StringType()), T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType())])


def ranks(path: str) -> dict[bytes, int]:
    """A rank file of tiktoken, read on the driver; its size is that of the vocabulary."""
    with open(path, "rb") as file:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, file)}


def is_isbn(string: str) -> bool:
    """Whether a string is a book number with its check digit, its name before it or not."""
    digits = re.sub("(?i)^isbn(-1[03])?[-_=/]?", "", string).replace("-", "")
    if re.fullmatch("97[89][0-9]{10}", digits):
        return sum(int(d) * (1 + 2 * (i % 2)) for i, d in enumerate(digits)) % 10 == 0
    if re.fullmatch("[0-9]{9}[0-9Xx]", digits):
        return sum((10 if d in "Xx" else int(d)) * (10 - i) for i, d in enumerate(digits)) % 11 == 0
    return False


class Scanner:
    """Finds spans in one text."""

    def __init__(self, vocabulary: dict[bytes, int], min_chars: int, max_ratio: float):
        self.assign, self.access = re.compile(ASSIGN, re.A), re.compile(ACCESS)
        self.hex = re.compile(HEX[:-1] + "{%d,}" % HEX_CHARS)  # runs are maximal, so shorter ones may be passed over
        self.candidate = re.compile(r"(?<![A-Za-z0-9+/_=-])[A-Za-z0-9+/_=-]{%d,}" % min_chars)
        run = "A-Za-z0-9+/_=" + SYMBOLS + "-"
        self.symbolic = re.compile(r"(?<![%s])[%s]{%d,}" % (run, run, min_chars))
        self.symbol = re.compile("(?<=[A-Za-z0-9])[%s]+(?=[A-Za-z0-9])" % SYMBOLS)
        self.kinds = tuple(map(re.compile, ("[a-z]", "[A-Z]", "[0-9]")))
        # words, numbers, and words with a short number behind them, such as a year
        part = "([A-Z]?[a-z]*|[A-Z]+|[0-9]*|[A-Z]?[a-z]{3,}[0-9]{1,4})"
        self.plain = re.compile(part + "([+/_=-]+" + part + ")*")
        self.between = re.compile("[+/_=-]+")
        self.uuid, self.hexadecimal = re.compile(UUID), re.compile("[0-9a-f]+|[0-9A-F]+")
        self.encoding = tiktoken.Encoding("own", pat_str=SPLIT, mergeable_ranks=vocabulary, special_tokens={})
        self.min_chars, self.max_ratio = min_chars, max_ratio

    def base(self, text: str) -> list[tuple[int, int, int]]:
        """(start, kind, end) of the fixed patterns; each kind is looked for by itself."""
        found = []
        low = text.lower()
        if any(word in low for word in ("passw", "secret", "token", "api")):
            found += [(m.start(), 0, m.end()) for m in self.assign.finditer(text) if len(m[2]) >= ASSIGN_CHARS]
        if "AKIA" in text:
            found += [(m.start(), 1, m.end()) for m in self.access.finditer(text) if len(m[0]) >= ACCESS_CHARS]
        found += [(m.start(), 2, m.end()) for m in self.hex.finditer(text)]
        return found

    def random(self, string: str) -> bool:
        """Whether a string takes so many tokens that it must be random; digests and identifiers are not."""
        if self.uuid.fullmatch(string):
            return False
        if len(string) in DIGESTS and self.hexadecimal.fullmatch(string) or is_isbn(string):
            return False
        parts = [string]
        if self.plain.fullmatch(string):  # names, dates and paths of short words: what joins them does not count
            parts = [part for part in self.between.split(string) if part]
        return sum(map(len, parts)) < self.max_ratio * sum(len(self.encoding.encode_ordinary(part)) for part in parts)

    def spans(self, text: str) -> list[tuple[int, int, int]]:
        found = self.base(text)
        taken = sorted((a, b) for a, _, b in found)
        mixed = [(a, 3, b) for a, b in self.with_symbols(text, taken)]
        found += mixed
        taken = sorted(taken + [(a, b) for a, _, b in mixed])
        first = 0
        for m in self.candidate.finditer(text):
            while first < len(taken) and taken[first][1] <= m.start():
                first += 1
            for a, b in self.uncovered(*m.span(), taken, first):
                found += [(x, 3, y) for x, y in self.randoms(text, a, b)]
        return sorted(found)

    def with_symbols(self, text: str, taken: list[tuple[int, int]]) -> Iterator[tuple[int, int]]:
        """Random runs that hold small letters, capitals, digits and, between them, symbols, apart from fixed patterns."""
        for m in self.symbolic.finditer(text):
            string = m[0]
            if not (self.symbol.search(string) and all(kind.search(string) for kind in self.kinds)):
                continue
            at = bisect_left(taken, (m.start(), m.start()))
            clear = (at == len(taken) or taken[at][0] >= m.end()) and all(b <= m.start() for _, b in taken[max(0, at - 3) : at])
            if clear and self.random(string):
                yield m.span()

    def uncovered(self, start: int, end: int, taken: list[tuple[int, int]], first: int) -> Iterator[tuple[int, int]]:
        """The stretches of a run between the spans of the fixed patterns, which are sorted; those before ``first`` end earlier."""
        for k in range(first, len(taken)):
            if taken[k][0] >= end:
                break
            yield start, taken[k][0]
            start = max(start, taken[k][1])
        yield start, end

    def randoms(self, text: str, start: int, end: int, level: int = 0) -> Iterator[tuple[int, int]]:
        """The stretch if it is random, else what is so of its parts: between =, then /, then the other marks."""
        if end - start < self.min_chars:
            return
        string = text[start:end]
        if self.random(string):
            yield start, end
        elif level < len(MARKS) and not self.uuid.fullmatch(string):
            for part in re.finditer(f"[^{MARKS[level]}]+", string):
                yield from self.randoms(text, start + part.start(), start + part.end(), level + 1)


def scan_secrets(df: DataFrame, vocabulary_path: str, text_col: str = "text", min_chars: int = 16, max_ratio: float = 2.0) -> DataFrame:
    """``df`` with ``secrets``: spans (kind, start, end) in code points, by start, then kind.

    Kinds: assign, access and hex by pattern; random for strings of at least ``min_chars`` characters
    with fewer than ``max_ratio`` characters a token, where no pattern has matched: whole runs, or parts of them. A null or empty
    text has no spans. A column named secrets in ``df`` is replaced; other columns are kept.
    """
    shared = prepare(df.sparkSession).sparkContext.broadcast({"ranks": ranks(vocabulary_path)})

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = Scanner(shared.value["ranks"], min_chars, max_ratio)
        for part in slices(batches, "text"):
            spans = [
                [{"kind": KINDS[k], "start": a, "end": b} for a, k, b in scanner.spans(text)] if text else []
                for text in part.column("text").to_pylist()
            ]
            found = pa.array(spans, pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32())])))
            yield pa.RecordBatch.from_arrays([part.column("rest"), part.column("text"), found], ["rest", "text", "secrets"])

    others = [c for c in df.columns if c not in (text_col, "secrets")]
    rest = F.struct(*(df[c] for c in others), F.lit(0).alias("_")).alias("rest")
    given = df.select(rest, df[text_col].cast("string").alias("text"))
    schema = T.StructType([*given.schema.fields, T.StructField("secrets", T.ArrayType(SPAN))])
    done = given.mapInArrow(run, schema)
    columns = [F.col("text").alias(c) if c == text_col else F.col("rest")[c].alias(c) for c in df.columns if c in (text_col, *others)]
    return done.select(*columns, "secrets")


def redact_secrets(df: DataFrame, vocabulary_path: str, text_col: str = "text", mark: str = "[SECRET]") -> DataFrame:
    """``df`` with every span of ``scan_secrets`` replaced by ``mark``; overlapping spans become one mark."""
    merged = F.aggregate(
        "secrets",
        F.array().cast("array<struct<start:int,end:int>>"),
        lambda done, s: F.when(
            (F.size(done) > 0) & (F.element_at(done, -1)["end"] > s["start"]),
            F.concat(
                F.slice(done, 1, F.size(done) - 1),
                F.array(F.struct(F.element_at(done, -1)["start"].alias("start"), F.greatest(F.element_at(done, -1)["end"], s["end"]).alias("end"))),
            ),
        ).otherwise(F.concat(done, F.array(F.struct(s["start"].alias("start"), s["end"].alias("end"))))),
    )
    text = F.col(text_col)

    def cut_out(spans):
        last = F.coalesce(F.try_element_at(spans, F.lit(-1))["end"], F.lit(0))
        step = F.transform(
            spans,
            lambda s, i: F.concat(F.substring(text, F.when(i > 0, F.get(spans, i - 1)["end"]).otherwise(0) + 1, s["start"] - F.when(i > 0, F.get(spans, i - 1)["end"]).otherwise(0)), F.lit(mark)),
        )
        return F.concat(F.array_join(step, ""), F.substring(text, last + 1, F.length(text)))

    clean = F.get(F.transform(F.array(merged), cut_out), F.lit(0))
    out = scan_secrets(df, vocabulary_path, text_col)
    return out.withColumn(text_col, F.when(F.size("secrets") > 0, clean).otherwise(text)).drop("secrets")
