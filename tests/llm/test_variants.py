"""Spelling variants against a comparison of all words, and odd rows."""

import collections
import re
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from veilframe.llm import queries, variants


def counted(rows):
    counts = collections.Counter()
    low = str.maketrans(variants.UPPER, variants.LOWER)
    for doc_id, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = run.translate(low)
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
            at = h % len(run)
            counts[run[:at] + run[at + 1 :] if h % 199 == 0 else run] += 1
    return counts


def near(a, b):
    """One letter inserted, deleted or replaced, by comparing what two words share at both ends."""
    if a == b or abs(len(a) - len(b)) > 1:
        return False
    start = next((i for i, (x, y) in enumerate(zip(a, b, strict=False)) if x != y), min(len(a), len(b)))
    return a[start + 1 :] == b[start + 1 :] or a[start + 1 :] == b[start:] or a[start:] == b[start + 1 :]


def by_hand(counts, min_chars=6, min_count=5, times=5):
    words = {w: n for w, n in counts.items() if len(w) >= min_chars and n >= min_count}
    lengths = collections.defaultdict(list)
    for w in words:
        lengths[len(w)].append(w)
    form, n_near = {}, {}
    for w, n in words.items():
        close = [v for k in (-1, 0, 1) for v in lengths[len(w) + k] if near(w, v)]
        n_near[w] = len(close)
        best = min(close, key=lambda v: (-words[v], v), default=None)
        form[w] = best if best and words[best] >= times * n else None
    out = set()
    for w, n in words.items():
        root = w
        while form[root]:
            root = form[root]
        out.add((w, form[w], root, n, n_near[w], words.get(form[w])))
    return out


def found(df, **more):
    rows = variants.group_variants(df, **more).collect()
    got = {(r.word, r.form, r.root, r.n, r.n_near, r.form_n) for r in rows}
    assert len(got) == len(rows)
    return got


def test_given_table(spark, data):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{data}/documents.parquet").collect()]
    got = {(r.word, r.form, r.root, r.n, r.n_near, r.form_n) for r in queries.op12_variants(spark, data).collect()}
    want = by_hand(counted(rows))
    assert got == want and any(form for _, form, *_ in want)


def test_edits_runs_and_chains(spark, make):
    words = {
        "banana": 700, "bananna": 100, "banaana": 10, "bananaa": 10, "annana": 10, "banan": 900, "bonana": 10, "bonanna": 10,
        "aaaaaa": 50, "aaaaaaa": 10, "aaaaab": 9, "ÀÉÎÕÜß": 60, "ÀÉÎÕÜ": 30, "ÀéÎÕÜß": 7, "LETTER": 500, "leter": 100, "lettter": 20, "lettttter": 5,
        "zzzzzz": 4, "zzzzzy": 40,
    }
    texts = [" ".join([w] * n) for w, n in words.items()]
    df = make(texts)
    counts = collections.Counter({"".join(c.lower() if c in variants.UPPER else c for c in w): n for w, n in words.items()})
    got = found(df, divisor=None, min_chars=5)
    assert got == by_hand(counts, min_chars=5)
    roots = {w: root for w, _, root, *_ in got}
    assert roots["lettter"] == "letter" and roots["leter"] == "letter" and roots["bananna"] == "banana"


def test_random_words(spark, make):
    random = np.random.default_rng(1)
    words = ["".join(random.choice(list("ab"), int(random.integers(1, 9)))) for _ in range(3000)]
    df = make([" ".join(words[k::10]) for k in range(10)])
    for least in (1, 3):
        assert found(df, divisor=None, min_chars=1, min_count=least, times=2) == by_hand(collections.Counter(words), 1, least, 2)


@settings(max_examples=200, deadline=None)
@given(st.lists(st.text("abß", min_size=1, max_size=6), min_size=1, max_size=8))
def test_nodes_are_shared_by_prefixes(words):
    points = [np.frombuffer(w.encode("utf-32-le"), np.uint32) for w in words]
    numbers = variants.nodes(np.concatenate(points), np.array([len(p) for p in points]), np.uint64(12345678901234567))
    of = {}
    at = 0
    for w in words:
        for k in range(len(w)):
            assert of.setdefault(w[: k + 1], numbers[at]) == numbers[at]
            at += 1
    assert len(set(of.values())) == len(of)


def test_odd_rows(spark, make):
    long = "abcdefghij" * 20_000
    texts = [None, "", "12 34", "Straße " * 8 + "Strasse " * 5, "no", long + "x " + long + "y"] + [f"{long}x {long}y"] * 40
    ids = [None, 1, 2, 3, 4, *range(5, 45), 44]
    got = found(make(texts, ids))
    assert got == by_hand(counted(list(zip(ids, texts, strict=True))))
    assert found(make([])) == set()
    with pytest.raises(ValueError):
        variants.group_variants(make([]), times=1)
    assert found(make([None, ""])) == set()
