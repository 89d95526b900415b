"""The pipeline against plain Python: every stage by hand over a small table with odd rows."""

import re
from collections import Counter, defaultdict
from math import log1p

import pytest
import tokenizers
from pyspark.sql import functions as F

import corpus_pipeline
from test_rule_distances import apart, plain_counts, repeated, shares
from test_token_operators import packed
from veilframe.llm import minhash, rules, secretscan

SPACE = " \t\n\x0b\x0c\r"


def good(docs):
    """Stage 1: ids that the quality rules keep."""
    measured = {i: plain_counts(t) for i, (t, _) in docs.items()}
    base = {i: len(w) < 20 or 100 * repeated(w) > 30 * len(w) for i, (w, _, _) in measured.items()}

    def excess(i, reference, both=True):
        words, classes, common = measured[i]
        far = apart(shares(classes), reference[0]) - 0.2 if sum(map(len, words)) >= 200 else -1.0
        return max(far, apart(shares(common), reference[1]) - 0.24 if both and len(words) >= 100 else -1.0)

    pooled = defaultdict(list)
    for i, (_, lang) in docs.items():
        if lang in rules.COMMON and not base[i] and excess(i, rules.fixed(lang)) <= 0:
            pooled[lang].append([shares(c) for c in measured[i][1:]])
    mean = {
        lang: [[(sum(d[k][j] for d in pooled[lang]) + 20 * v) / (len(pooled[lang]) + 20) for j, v in enumerate(known)] for k, known in enumerate(rules.fixed(lang))]
        for lang in rules.COMMON
    }
    return {i for i, (_, lang) in docs.items() if not base[i] and min(excess(i, r, lang is None or lang in rules.COMMON) for r in mean.values()) <= 0}


def without_lines(texts):
    """Stage 2: a line in three documents stays only in the last of them."""

    def key(line):
        return re.sub("[A-Z]", lambda m: m[0].lower(), line.strip(SPACE))

    holders = defaultdict(set)
    for i, text in texts.items():
        for line in (text or "").split("\n"):
            if len(key(line)) >= 20:
                holders[key(line)].add(-1 if i is None else i)
    gone = {k: max(v) for k, v in holders.items() if len(v) >= 3}
    return {
        i: "\n".join(line for line in (text or "").split("\n") if gone.get(key(line), -1 if i is None else i) == (-1 if i is None else i))
        for i, text in texts.items()
    }


def one_of_each(texts):
    """Stage 3: by all pairs, the weighted Jaccard similarity of five-word shingles, 0.8 or more."""
    words = {i: [w for w in (x.strip(minhash.PUNCTUATION) for x in re.split(f"[{SPACE}]+", t.lower())) if w] for i, t in texts.items()}
    holders = Counter(w for ws in words.values() for w in set(ws))
    many = sum(bool(ws) for ws in words.values())
    sets = {}
    for i, ws in words.items():
        grams = [tuple(ws[k : k + 5]) for k in range(max(1, len(ws) - 4))] if ws else []
        sets[i] = {g: n * sum(log1p(many / holders[w]) for w in g) / len(g) for g, n in Counter(grams).items()}
    ids = sorted((i for i in texts if i is not None and sets[i]))
    root = {i: i for i in ids}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, i in enumerate(ids):
        for j in ids[a + 1 :]:
            shared = sets[i].keys() & sets[j].keys()
            if shared:
                both = sum(min(sets[i][g], sets[j][g]) for g in shared)
                alike = both / (sum(sets[i].values()) + sum(sets[j].values()) - both)
                assert not 0.79999 < alike < 0.80001, "the fixture should leave no doubt"
                if alike >= 0.8:
                    x, y = find(i), find(j)
                    root[max(x, y)] = min(x, y)
    return {i for i in texts if i is None or not sets[i] or find(i) == i}


def without_secrets(text, scanner):
    """Stage 4: every character of a span goes, each stretch of them for one mark."""
    hidden = [False] * len(text)
    joins = set()
    for a, _, b in scanner.spans(text):
        joins.add(a)
        for k in range(a, b):
            if hidden[k]:
                joins.discard(a)
            hidden[k] = True
    starts = [k for k in range(len(text)) if hidden[k] and (k == 0 or not hidden[k - 1] or k in joins)]
    return "".join("[SECRET]" if k in starts else "" if hidden[k] else c for k, c in enumerate(text))


@pytest.fixture(scope="module")
def table(spark, data, tmp_path_factory):
    docs = spark.read.parquet(f"{data}/documents.parquet")
    rows = [tuple(r) for r in docs.collect()]
    clean = next(r for r in rows if r[2] == "en" and r[1] and 2000 < len(r[1]) < 4000 and "\n" in r[1])
    words = clean[1].split(" ")
    near = " ".join(w if k % 60 else f"changed{k}" for k, w in enumerate(words))
    secret = clean[1].replace(" ", ' password = "Zx9kQ2vLm8RtY7wBn4Jc" ', 1) + " key Pw0!aZ#9mKqT@27vLx done " + "own words of it " * 3
    odd = [None, "", " \n\n ", clean[1], near, secret, clean[1] + "\n" + "end of it all, " * 20, "x " * 50_000]
    last = max(r[0] for r in rows)
    rows += [(last + 1 + k, text, lang, "odd", None) for k, (text, lang) in enumerate((t, g) for t in odd for g in ("en", None, "el", "en-US"))]
    rows.append((None, "An own text without any number. " + " ".join(reversed(words)), "en", "odd", None))
    folder = str(tmp_path_factory.mktemp("tables"))
    # an extra column, of a name that a stage might use for itself
    spark.createDataFrame(rows, docs.schema).withColumn("kept", F.lit(1)).repartition(5).write.parquet(f"{folder}/documents.parquet")
    return folder, {r[0]: (r[1], r[2]) for r in rows}


def test_run(spark, table, ranks_path, words_path):
    folder, docs = table
    kept = good(docs)
    texts = without_lines({i: docs[i][0] for i in kept})
    left = one_of_each(texts)
    scanner = secretscan.Scanner(secretscan.ranks(ranks_path), 16, 2.0)
    clean = {i: without_secrets(texts[i], scanner) for i in left}
    assert len(docs) > len(kept) > len(left) and any("[SECRET]" in t for t in clean.values())
    rows = corpus_pipeline.run(spark, folder).collect()
    assert {r.doc_id for r in rows} == left
    packed(rows, clean, tokenizers.Tokenizer.from_file(words_path))


def test_stages_one_by_one(spark, table):
    """Every stage but the last keeps the columns, and what it keeps is the next one's input."""
    folder, docs = table
    stage = spark.read.parquet(f"{folder}/documents.parquet")
    columns = stage.columns
    for name, function in corpus_pipeline.STAGES[:-1]:
        stage = function(spark, stage, folder)
        assert stage.columns == columns, name
    assert all(r.n_chars == len(r.text) for r in stage.collect())


def test_empty_table(spark, table, tmp_path):
    folder, _ = table
    spark.read.parquet(f"{folder}/documents.parquet").limit(0).write.parquet(f"{tmp_path}/documents.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).collect() == []
