"""The distances and verdicts of the quality rules against plain Python."""

import math
import re
from collections import Counter, defaultdict

import pytest
import regex

from veilframe.llm import queries, rules


def plain_counts(text):
    text = text or ""
    words = [w for w in re.split(r"[ \t\n\x0b\x0c\r]+", text) if w]
    kinds = (r"[\p{Ll}\p{Lo}\p{Lm}\p{M}]", r"\p{Lu}", r"\p{N}", r"[ \t\n\x0b\x0c\r]", r"[#*$%&|<>]")
    classes = [len(regex.findall(k, text)) for k in kinds]
    found = Counter(w.strip(".,;:!?").lower() for w in words)
    common = [found[w] for w in rules.WORDS]
    return words, [*classes, len(text) - sum(classes)], [*common, len(words) - sum(common)]


def repeated(words):
    windows = [tuple(words[i : i + 8]) for i in range(len(words) - 7)]
    many = Counter(windows)
    return len({i + k for i, w in enumerate(windows) if many[w] > 1 for k in range(8)})


def shares(counts):
    return [c / max(1, sum(counts)) for c in counts]


def apart(p, q):
    """Jensen-Shannon distance by entropies."""

    def entropy(x):
        return -sum(v * math.log2(v) for v in x if v > 0)

    middle = [(a + b) / 2 for a, b in zip(p, q, strict=True)]
    return math.sqrt(max(0.0, entropy(middle) - (entropy(p) + entropy(q)) / 2))


def test_against_plain_python(spark, data):
    docs = {r.doc_id: r for r in spark.read.parquet(f"{data}/documents.parquet").collect()}
    measured = {i: plain_counts(r.text) for i, r in docs.items()}
    base = {i: len(w) < 20 or 100 * repeated(w) > 30 * len(w) for i, (w, _, _) in measured.items()}

    def excess(i, reference):
        words, classes, common = measured[i]
        a, b = apart(shares(classes), reference[0]), apart(shares(common), reference[1])
        long, many = sum(map(len, words)) >= 200, len(words) >= 100
        return max(a - 0.2 if long else -1.0, b - 0.24 if many else -1.0), a, b

    pooled = defaultdict(list)
    for i, r in docs.items():
        if r.lang in rules.COMMON and not base[i] and excess(i, rules.fixed(r.lang))[0] <= 0:
            pooled[r.lang].append([shares(c) for c in measured[i][1:]])
    references = {
        lang: [[(sum(d[k][j] for d in pooled[lang]) + 20 * v) / (len(pooled[lang]) + 20) for j, v in enumerate(known)] for k, known in enumerate(rules.fixed(lang))]
        for lang in rules.COMMON
    }
    rows = queries.op6_quality_rules(spark, data).collect()
    assert len(rows) == len(docs)
    for r in rows:
        want = min(excess(r.doc_id, references[lang]) for lang in rules.COMMON)
        assert (r.base_failed, r.kept) == (base[r.doc_id], not base[r.doc_id] and want[0] <= 0), r.doc_id
        assert (r.class_distance, r.common_distance) == pytest.approx(want[1:], abs=1e-6)
