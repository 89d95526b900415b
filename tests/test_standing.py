"""Which of overlapping findings stand, and recognisers that run in Python."""

import random
import re

import pytest
from pyspark.sql import functions as F

from veilframe import DEFAULT_RECOGNIZERS, Recognizer
from veilframe.functions.spans import standing_spans
from veilframe.operators.recognise import Hook, find_standing, redact_standing

ACCOUNT = Recognizer("ACCOUNT", r"\b[0-9]{8,20}\b", 0.7, requires="[0-9]")
BADGE = Recognizer("BADGE", r"[A-Z]-[0-9 ]{3,}", 0.3, requires="-")
WITH_OWN = (*DEFAULT_RECOGNIZERS, ACCOUNT, BADGE)


def by_hand(spans, order):
    kept = []
    for s in sorted(spans, key=lambda s: (-s[1], s[2] - s[3], order.index(s[0]) if s[0] in order else len(order), s[0], s[2])):
        if s[3] > s[2] and all(s[2] >= k[3] or k[2] >= s[3] for k in kept):
            kept.append(s)
    return sorted(kept, key=lambda s: (s[2], s[3]))


def test_best_first(spark):
    r = random.Random(1)
    rows = [(i, [(r.choice("ABC"), "v", r.choice([0.3, 0.5, 0.9]), a, a + r.randrange(6)) for a in r.choices(range(30), k=r.randrange(9))]) for i in range(500)]
    df = spark.createDataFrame(rows, "i int, spans array<struct<entity_type:string,value:string,score:double,start:int,end:int>>")
    for i, got in df.select("i", standing_spans(F.col("spans"), ["B", "A"])).collect():
        want = by_hand([(e, s, a, b) for e, _, s, a, b in rows[i][1]], ["B", "A"])
        assert [(g.entity_type, g.score, g.start, g.end) for g in got] == want, rows[i]


def test_findings_that_overlap(spark):
    texts = ["card 4111 1111 1111 1111 and 4111111111111111", "A-555-123-4567 or 12345678@x.org", "10.0.0.1 B-10 20 30", "nothing", None, ""]
    df = spark.createDataFrame(list(enumerate(texts)), "id int, t string")
    got = {}
    for r in find_standing(df, "t", ["id"], WITH_OWN).collect():
        assert texts[r.id][r.start : r.end] == r.value
        got.setdefault(r.id, []).append((r.entity_type, r.value))
    assert got == {
        0: [("CREDIT_CARD", "4111 1111 1111 1111"), ("CREDIT_CARD", "4111111111111111")],
        1: [("PHONE_NUMBER", "555-123-4567"), ("EMAIL_ADDRESS", "12345678@x.org")],
        2: [("IP_ADDRESS", "10.0.0.1"), ("BADGE", "B-10 20 30")],
    }
    out = {r.id: r.t for r in redact_standing(df, "t", WITH_OWN).collect()}
    assert out[1] == "A-[PHONE NUMBER] or [EMAIL ADDRESS]" and (out[3], out[4], out[5]) == ("nothing", None, "")
    assert "ArrowEvalPython" not in redact_standing(df, "t", WITH_OWN)._jdf.queryExecution().executedPlan().toString()


def test_a_hook_sees_only_what_it_asks_for(spark):
    def names(texts):
        out = []
        for text in texts.to_pylist():
            assert "Dr" in text, text
            out.append([("PERSON", m.start(1), m.end(1), 0.8) for m in re.finditer(r"Dr ([A-Z]\w+)", text)] + [("PERSON", 0, 10_000, 1.0)])
        return out

    texts = ["😀 Dr Who at a@b.com", "Dr No-555-123-4567", "call 555-123-4567", None, "plain"]
    df = spark.createDataFrame(list(enumerate(texts)), "id int, t string")
    hook = Hook(names, r"\bDr\b", ("PERSON",))
    out = {r.id: r.t for r in redact_standing(df, "t", hook=hook).collect()}
    assert out == {0: "😀 Dr [PERSON] at [EMAIL ADDRESS]", 1: "Dr [PERSON]-[PHONE NUMBER]", 2: "call [PHONE NUMBER]", 3: None, 4: "plain"}
    found = {(r.id, r.entity_type, r.value) for r in find_standing(df, "t", ["id"], hook=hook).collect()}
    assert found == {(0, "PERSON", "Who"), (0, "EMAIL_ADDRESS", "a@b.com"), (1, "PERSON", "No"), (1, "PHONE_NUMBER", "555-123-4567"), (2, "PHONE_NUMBER", "555-123-4567")}


def test_pseudonyms(spark):
    df = spark.createDataFrame([("a@b.com, a@b.com",)], "t string")
    first, second = redact_standing(df, "t", style="pseudonymize", seed="s").first()[0].split(", ")
    assert first == second and first.startswith("user_")
    with pytest.raises(ValueError):
        redact_standing(df, "t", style="pseudonymize")
