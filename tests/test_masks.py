"""Every mask on the values that pin down its rule."""

import hashlib

import pytest
from pyspark.sql import functions as F

from veilframe.functions import masks

PARTIAL = [
    ("EMAIL_ADDRESS", "john@example.com", "j***@e***.com"),
    ("EMAIL_ADDRESS", "a@b.com", "a***@b***.com"),
    ("EMAIL_ADDRESS", "notanemail", "n*********"),
    ("EMAIL_ADDRESS", "user@mail.example.com", "u***@m***.com"),
    ("EMAIL_ADDRESS", "@", "***@***"),
    ("EMAIL_ADDRESS", "@x.com", "***@x***.com"),
    ("EMAIL_ADDRESS", "a@b", "a***@b***"),
    ("EMAIL_ADDRESS", "a@.com", "a***@***.com"),
    ("EMAIL_ADDRESS", "a@..com", "a***@.***.com"),
    ("EMAIL_ADDRESS", "a@b@c.de", "a***@b***.de"),
    ("EMAIL_ADDRESS", "a@b.", "a***@b***."),
    ("EMAIL_ADDRESS", "é@ü.de", "é***@ü***.de"),
    ("PHONE_NUMBER", "555-123-4567", "***-***-4567"),
    ("PHONE_NUMBER", "(555) 123-4567", "***-***-4567"),
    ("PHONE_NUMBER", "5551234567", "***-***-4567"),
    ("PHONE_NUMBER", "123", "***"),
    ("PHONE_NUMBER", "1234", "***-***-1234"),
    ("PHONE_NUMBER", "٥٥٥١٢٣٤", "***-***-١٢٣٤"),
    ("US_SSN", "123-45-6789", "***-**-6789"),
    ("US_SSN", "123456789", "***-**-6789"),
    ("US_SSN", "12", "***-**-****"),
    ("PERSON", "John Doe", "J*** D**"),
    ("PERSON", "Madonna", "M******"),
    ("PERSON", "John Q Public", "J*** Q*** P*****"),
    ("PERSON", "J", "J***"),
    ("PERSON", "  John \t Doe\n", "J*** D**"),
    ("PERSON", "John Doe", "J*** D**"),
    ("PERSON", "A B", "A*** B***"),
    ("PERSON", "* **", "**** **"),
    ("PERSON", "😀x 😀", "😀* 😀***"),
    ("CREDIT_CARD", "4111-1111-1111-1111", "****-****-****-1111"),
    ("CREDIT_CARD", "4111111111111111", "****-****-****-1111"),
    ("CREDIT_CARD", "411", "****-****-****-****"),
    ("IP_ADDRESS", "192.168.1.100", "***.***.***.100"),
    ("IP_ADDRESS", "127.0.0.1", "***.***.***.1"),
    ("IP_ADDRESS", "::1", "***.***.***. ***"),
    ("IP_ADDRESS", "1.2.3.4.5", "***.***.***. ***"),
    ("IP_ADDRESS", "a.b.c.", "***.***.***."),
    ("LOCATION", "123 Main St", "*** Main St"),
    ("LOCATION", "Main Street", "M**********"),
    ("LOCATION", "12", "***"),
    ("FINANCIAL", "123456789", "*****6789"),
    ("FINANCIAL", "12", "****"),
    ("FINANCIAL", "1234", "1234"),
    ("DATE_TIME", "something", "s********"),
    ("US_PASSPORT", "x", "***"),
    ("US_DRIVER_LICENSE", "D123", "D***"),
    ("ANYTHING", "ünï", "ü**"),
]


def run(spark, cases, build):
    df = spark.createDataFrame([(i, v) for i, (_, v, _) in enumerate(cases)], "i int, v string")
    out = {}
    for entity in {c[0] for c in cases}:
        rows = df.where(F.col("i").isin([i for i, c in enumerate(cases) if c[0] == entity]))
        out.update({r[0]: r[1] for r in rows.select("i", build(entity)).collect()})
    return [out[i] for i in range(len(cases))]


def test_partial_masks(spark):
    got = run(spark, PARTIAL, lambda e: masks.mask(F.col("v"), e))
    assert got == [c[2] for c in PARTIAL]


def test_mask_by_entity_agrees_with_mask(spark):
    df = spark.createDataFrame([(c[0], c[1], c[2]) for c in PARTIAL], "e string, v string, x string")
    for style in ("partial", "full", "pseudonymize"):
        dynamic = df.select("e", "v", masks.mask_by_entity(F.col("v"), F.col("e"), style, "s")).collect()
        static = run(spark, PARTIAL, lambda e: masks.mask(F.col("v"), e, style, "s"))
        assert [r[2] for r in dynamic] == static


@pytest.mark.parametrize("style", ["partial", "full", "pseudonymize", "none"])
def test_secret_is_redacted_in_every_style(spark, style):
    df = spark.createDataFrame([("supersecret",), (None,), (" ",)], "v string")
    got = [r[0] for r in df.select(masks.mask(F.col("v"), "SECRET", style, "s")).collect()]
    assert got == ["[REDACTED]", None, " "]


@pytest.mark.parametrize("style", ["partial", "full", "pseudonymize", "none", "unheard-of"])
def test_null_and_blank_stay(spark, style):
    values = [None, "", " ", "\t\n", " ", "\x1c"]
    df = spark.createDataFrame([(v,) for v in values], "v string")
    for entity in ("EMAIL_ADDRESS", "PERSON", "OTHER"):
        got = [r[0] for r in df.select(masks.mask(F.col("v"), entity, style, "s")).collect()]
        assert got == values


def test_full_label(spark):
    df = spark.createDataFrame([("john@test.com",)], "v string")
    assert df.select(masks.mask(F.col("v"), "EMAIL_ADDRESS", "full")).first()[0] == "[EMAIL ADDRESS]"
    assert df.select(masks.mask(F.col("v"), "us_ssn", "full")).first()[0] == "[US SSN]"


def test_none_keeps_value_and_type(spark):
    df = spark.createDataFrame([(42,)], "v int")
    out = df.select(masks.mask(F.col("v"), "EMAIL_ADDRESS", "none").alias("v"))
    assert out.first()[0] == 42


def test_unknown_style_masks_partially(spark):
    df = spark.createDataFrame([("123456789",)], "v string")
    assert df.select(masks.mask(F.col("v"), "FINANCIAL", "?")).first()[0] == "*****6789"


@pytest.mark.parametrize(
    "entity,form",
    [
        ("EMAIL_ADDRESS", "user_{0}@masked.invalid"),
        ("PHONE_NUMBER", "555-000-{0:.4}"),
        ("PERSON", "Person_{0:.6}"),
        ("LOCATION", "Location_{0:.6}"),
        ("US_SSN", "000-00-{0:.4}"),
        ("CREDIT_CARD", "0000-0000-0000-{0:.4}"),
        ("IP_ADDRESS", "PSEUDO_{0}"),
    ],
)
def test_pseudonyms(spark, entity, form):
    values = ["john@example.com", "jane@example.com", "ümlaut"]
    df = spark.createDataFrame([(v,) for v in values], "v string")
    got = [r[0] for r in df.select(masks.mask(F.col("v"), entity, "pseudonymize", "seed")).collect()]
    want = [form.format(hashlib.sha256(f"seed:{v}".encode()).hexdigest()[:8]) for v in values]
    assert got == want


def test_pseudonyms_need_a_seed(spark):
    with pytest.raises(ValueError):
        masks.mask(F.lit("x"), "PERSON", "pseudonymize")


def test_masks_run_without_python(spark):
    df = spark.range(3).select(F.concat(F.lit("u"), "id", F.lit("@x.com")).alias("email"))
    for entity in [*masks.PARTIAL_MASKS, "OTHER"]:
        out = df.select(masks.mask(F.col("email"), entity))
        plan = out._jdf.queryExecution().executedPlan().toString()
        assert "Python" not in plan
