"""Prose: what is found, what is replaced, and what is left alone."""

import hashlib
import re

from pyspark.sql import functions as F

from veilframe import Recognizer, find_pii, redact_text
from veilframe.functions import prose


def one(spark, text, expr):
    return spark.createDataFrame([(text,)], "t string").select(expr).first()[0]


def test_prefilter(spark):
    hits = ["john@example.com", "555-123-4567", "(555) 123-4567", "123-45-6789", "4111 1111 1111 1111"]
    misses = ["active", "confirmed", "2024-01-01", "10.0.0.1", "a@b", ""]
    df = spark.createDataFrame([(t,) for t in hits + misses], "t string")
    got = [r[0] for r in df.select(prose.contains_pii(F.col("t"))).collect()]
    assert got == [True] * len(hits) + [False] * len(misses)


def test_labels(spark):
    text = (
        "Write to john.doe@mail.example.com, call 555-123-4567 or (555) 123-4567; "
        "SSN 123-45-6789, card 4111-1111-1111-1111, host 10.0.0.1. Done."
    )
    want = (
        "Write to [EMAIL ADDRESS], call [PHONE NUMBER] or [PHONE NUMBER]; "
        "SSN [US SSN], card [CREDIT CARD], host [IP ADDRESS]. Done."
    )
    for style in ("partial", "full"):
        assert one(spark, text, redact_text(F.col("t"), style)) == want
    # Redacting twice changes nothing.
    assert one(spark, want, redact_text(F.col("t"))) == want


def test_pseudonyms_replace_each_finding_once(spark):
    text = "a@b.com and a@b.com then c@d.org"
    h = lambda v: hashlib.sha256(f"s:{v}".encode()).hexdigest()[:8]
    want = f"user_{h('a@b.com')}@masked.invalid and user_{h('a@b.com')}@masked.invalid then user_{h('c@d.org')}@masked.invalid"
    assert one(spark, text, redact_text(F.col("t"), "pseudonymize", "s")) == want


def test_null_blank_clean_and_revealed(spark):
    df = spark.createDataFrame([(None,), ("",), ("  ",), ("nothing here",)], "t string")
    assert [r[0] for r in df.select(redact_text(F.col("t"))).collect()] == [None, "", "  ", "nothing here"]
    text = "a@b.com 555-123-4567"
    assert one(spark, text, redact_text(F.col("t"), reveal_types=["EMAIL_ADDRESS"])) == "a@b.com [PHONE NUMBER]"
    everything = [r.entity for r in prose.DEFAULT_RECOGNIZERS]
    assert one(spark, text, redact_text(F.col("t"), reveal_types=everything)) == text


def test_email_matches_are_those_of_the_plain_pattern(spark):
    plain = re.compile(r"[a-zA-Z0-9._%+\-]+@[a-zA-Z0-9.\-]+\.[a-zA-Z]{2,}")
    texts = [
        "a@b.com_x@y.org", "x" * 5000 + "@", "x" * 5000 + "@y.io", "a@b.c1 d@e.fg", "a@@b.com",
        "é.a@b.com", "a@b.com.", "a@b.comé@c.de", "--@--.--.ab", "a@b.co@c.de", "%+@x.yz-",
    ]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    email = [r for r in prose.DEFAULT_RECOGNIZERS if r.entity == "EMAIL_ADDRESS"]
    rows = df.select("t", prose.findings(F.col("t"), email).alias("f")).collect()
    for r in rows:
        assert [f["value"] for f in r["f"]] == plain.findall(r["t"])


def test_positions_and_values(spark):
    text = "é 😀 a@b.com, 10.0.0.1 and a@b.com"
    df = spark.createDataFrame([(7, text), (8, "clean")], "id int, t string")
    rows = find_pii(df, "t", ["id"], positions=True).collect()
    assert [(r["id"], r["entity_type"], r["score"]) for r in rows] == [
        (7, "EMAIL_ADDRESS", 1.0), (7, "IP_ADDRESS", 0.6), (7, "EMAIL_ADDRESS", 1.0),
    ]
    assert all(text[r["start"] : r["end"]] == r["value"] for r in rows)
    plain = find_pii(df, "t", ["id"]).collect()
    assert [tuple(r) for r in plain] == [(r["id"], r["entity_type"], r["value"], r["score"]) for r in rows]


def test_checksum(spark):
    strict = (Recognizer("CREDIT_CARD", r"\b(?:\d{4}[\s\-]?){3}\d{4}\b", 0.8, check="luhn"),)
    text = "good 4111-1111-1111-1111 bad 4111-1111-1111-1112"
    assert one(spark, text, redact_text(F.col("t"), recognizers=strict)) == "good [CREDIT CARD] bad 4111-1111-1111-1112"
    df = spark.createDataFrame([(text,)], "t string")
    assert [r["value"] for r in find_pii(df, "t", recognizers=strict).collect()] == ["4111-1111-1111-1111"]
    assert [r["start"] for r in find_pii(df, "t", recognizers=strict, positions=True).collect()] == [5]


MORE = [
    ("DE89 3704 0044 0532 0130 00", "IBAN_CODE"), ("GB82WEST12345698765432", "IBAN_CODE"), ("GB83WEST12345698765432", None),
    ("2001:db8:0:0:0:ff00:42:8329", "IPV6_ADDRESS"), ("2001:db8::8a2e:370", "IPV6_ADDRESS"), ("12:30", None),
    ("https://example.org/a?b=c", "URL"), ("912-70-1234", "US_ITIN"), ("123-45-6789", "US_SSN"), ("C01234567", "US_PASSPORT"),
    ("D1234567", "US_DRIVER_LICENSE"), ("+44 20 7946 0958", "PHONE_NUMBER"), ("+1 (521) 555-6210", "PHONE_NUMBER"),
    ("5551234567", "PHONE_NUMBER"), ("378282246310005", "CREDIT_CARD"), ("378282246310006", None), ("10.0.0.1", "IP_ADDRESS"),
]


def test_more_recognizers(spark):
    df = spark.createDataFrame([(k, f"x {t} y") for k, (t, _) in enumerate(MORE)], "id int, t string")
    found = {r["id"]: (r["value"], r["entity_type"]) for r in find_pii(df, "t", ["id"], prose.EXTENDED_RECOGNIZERS).collect()}
    assert found == {k: (t, e) for k, (t, e) in enumerate(MORE) if e}


def test_custom_recognizer(spark):
    token = Recognizer("SECRET_TOKEN", r"\b[0-9a-f]{40}\b", 0.9)
    text = "t = " + "ab" * 20 + " a@b.com"
    got = one(spark, text, redact_text(F.col("t"), recognizers=(*prose.DEFAULT_RECOGNIZERS, token)))
    assert got == "t = [SECRET TOKEN] [EMAIL ADDRESS]"


def test_no_email_survives_on_data(spark, data):
    docs = spark.read.parquet(f"{data}/documents.parquet")
    masked = docs.select("doc_id", "text", redact_text(F.col("text")).alias("m"))
    assert masked.where(prose.has_findings(F.col("m"))).count() == 0
    assert masked.where(prose.has_findings(F.col("text"))).count() > 0
    assert masked.where(~prose.has_findings(F.col("text")) & (F.col("m") != F.col("text"))).count() == 0


def test_positions_over_many_findings(spark):
    text = "".join(f"x{'é' * (i % 5)} u{i}@h.org," for i in range(2500))
    df = spark.createDataFrame([(text,)], "t string")
    rows = find_pii(df, "t", positions=True).collect()
    assert [r["value"] for r in rows] == [f"u{i}@h.org" for i in range(2500)]
    assert all(text[r["start"] : r["end"]] == r["value"] for r in rows)
