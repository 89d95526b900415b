"""Personal data: fixed patterns against plain expressions, the label model, the classifier, and odd rows."""

import hashlib
import re

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from veilframe.llm import personal, queries

PLAIN = (
    r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    r"[0-9]([\x20-]?[0-9])+",
    r"\+[0-9][\x20().0-9-]+[0-9]",
)


def luhn(digits):
    back = [int(d) for d in digits[::-1]]
    return (sum(back[::2]) + sum(sum(divmod(2 * d, 10)) for d in back[1::2])) % 10 == 0


def plain(text):
    found = []
    for kind, pattern in enumerate(PLAIN):
        for m in re.finditer(pattern, text):
            digits = re.sub("[^0-9]", "", m[0])
            if kind == 1 and any(int(p) > 255 for p in m[0].split(".")):
                continue
            if kind == 2 and not (12 <= len(digits) <= 19 and luhn(digits)):
                continue
            if kind == 3 and not 9 <= len(digits) <= 15:
                continue
            found.append((m.start(), kind, m.end()))
    return sorted(found)


@settings(max_examples=1500, deadline=None)
@given(st.text("a.@_-+1205 (49)", max_size=40))
def test_fixed_patterns(text):
    assert personal.Labelers(personal.GIVEN).base(text) == plain(text)


def test_fixed_patterns_in_the_given_table(spark, data):
    rows = {r.doc_id: r for r in queries.op11_personal(spark, data).collect()}
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{data}/documents.parquet").collect()}
    assert rows.keys() == texts.keys()
    for doc_id, text in texts.items():
        want, r = plain(text or ""), rows[doc_id]
        spelled = [f"{personal.BASE[k]}:{a}:{b}" for a, k, b in want]
        assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == [sum(k == kind for _, k, _ in want) for kind in range(4)]
        assert r.base_sha256 == hashlib.sha256(",".join(spelled).encode()).hexdigest()
        assert set(spelled) <= set(r.spans.split(",")) or not spelled


def test_reliabilities_are_recovered():
    random = np.random.default_rng(8)
    truth = random.random(40_000) < 0.3
    # the chance to abstain, and to be right when voting; the last labeler is no better than chance
    votes = []
    for silent, right in ((0.1, 0.95), (0.5, 0.9), (0.6, 0.8), (0.7, 0.85), (0.8, 0.9), (0.2, 0.5)):
        vote = np.where((random.random(truth.size) < right) == truth, 1, -1)
        votes.append(np.where(random.random(truth.size) < silent, 0, vote))
    patterns = np.array(["".join("-0+"[v + 1] for v in row) for row in np.array(votes).T])
    counts = dict(zip(*np.unique(patterns, return_counts=True), strict=True))
    likely = personal.reliabilities({str(p): int(n) for p, n in counts.items()})
    decided = np.array([likely[p] >= 0.5 for p in patterns])
    exact = {p: truth[patterns == p].mean() for p in counts if counts[p] > 400}
    assert np.mean(decided == truth) > 0.93
    assert all(abs(exact[p] - likely[p]) < 0.12 for p in exact)


def spans(df):
    return {r.doc_id: [(s.kind, s.start, s.end) for s in r.personal] for r in personal.find_personal(df).collect()}


PERSONAL = [
    ("write to jane.doe (at) example (dot) com please", "jane.doe (at) example (dot) com", "mail"),
    ("contact: bob at example dot org", "bob at example dot org", "mail"),
    ("phone: (555) 234-5678, thanks", "(555) 234-5678", "call"),
    ("call 212-555-0187 today", "212-555-0187", "call"),
    ("Telefon 030 1234567 bitte", "030 1234567", "call"),
    ("ssn 123-45-6789 on file", "123-45-6789", "number"),
    ("pay to iban GB82 WEST 1234 5698 7654 32 now", "GB82 WEST 1234 5698 7654 32", "number"),
    ("signed by Maria Garcia yesterday", "Maria Garcia", "name"),
    ("ask Thomas Miller about it", "Thomas Miller", "name"),
]
CLEAN = [
    "on 2024-01-15 10:30 the build", "version 10.20.30 was out", "order 1234567890123456 shipped", "isbn 978-3-16-148410-0 printed",
    "meet at noon dot the i", "The Golden Gate is a bridge", "it cost 1.250.000 in all", "New York is large", "scores 12-10 and 15-13",
    "Paris Street and Victoria Station", "random 6375986702482655 digits",
]


def test_method_finds_more_and_leaves_clean_texts(spark, make):
    sure = [f"mail user{k}@example.com or call +1 (555) 555-{k:04d}, card 4111111111111111" for k in range(60)]
    texts = sure + [t for t, _, _ in PERSONAL] + CLEAN
    got = spans(make(texts))
    for k, (text, span, kind) in enumerate(PERSONAL, len(sure)):
        assert (kind, text.index(span), text.index(span) + len(span)) in got[k], (text, got[k])
    assert [(texts[k], got[k]) for k in range(len(sure) + len(PERSONAL), len(texts)) if got[k]] == []
    assert all([kind for kind, *_ in got[k]] == ["email", "phone", "card"] for k in range(len(sure)))


@pytest.mark.parametrize("partitions", [1, 9])
def test_partitions_make_no_difference(spark, make, partitions):
    texts = [t for t, _, _ in PERSONAL] * 3 + CLEAN
    assert spans(make(texts).repartition(partitions)) == spans(make(texts))


def test_odd_rows(spark, make):
    texts = [None, "", "9" * 200_000, "a" * 200_000 + "@", "@" * 50_000, "300." * 50_000, "+" * 20_000, "x" * 100_000 + " a@b.cd", "😀 é a@b.cd"]
    got = spans(make(texts))
    assert [got[k] for k in range(7)] == [[]] * 7
    assert got[7] == [("email", 100_001, 100_007)] and got[8] == [("email", 4, 10)]
    assert personal.find_personal(make([])).collect() == []
    named = make(["a@b.cd"] * 3, [5, 5, None]).withColumnRenamed("rest", "personal").withColumnRenamed("secrets", "candidates")
    out = personal.find_personal(named)
    assert out.columns == [c for c in named.columns if c != "personal"] + ["personal"]
    assert [[s.kind for s in r.personal] for r in out.collect()] == [["email"]] * 3
