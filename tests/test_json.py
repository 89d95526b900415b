"""JSON in text, in typed columns and in variants."""

import json

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from veilframe import DEFAULT_RECOGNIZERS, Recognizer
from veilframe.functions.jsontext import is_json, mask_json_text
from veilframe.functions.nested import NestedStyle, mask_nested


def masked(spark, text, **kw):
    return (
        spark.createDataFrame([(text,)], "j string").select(mask_json_text(F.col("j"), **kw)).first()[0]
    )


def tree(spark, value, **kw):
    return json.loads(masked(spark, json.dumps(value), **kw))


CASES = [
    ({"email": "john@example.com", "status": "active"}, {"email": "j***@e***.com", "status": "active"}),
    ({"phone": "555-123-4567", "tier": "gold"}, {"phone": "***-***-4567", "tier": "gold"}),
    ({"encrypted_password": "abc123", "name": "John"}, {"encrypted_password": "[REDACTED]", "name": "John"}),
    (
        {"contact": {"email": "john@example.com", "tier": "gold"}},
        {"contact": {"email": "j***@e***.com", "tier": "gold"}},
    ),
    ([{"email": "a@b.com"}, {"email": "c@d.com"}], [{"email": "a***@b***.com"}, {"email": "c***@d***.com"}]),
    (["hello", "john@example.com", "world"], ["hello", "[EMAIL ADDRESS]", "world"]),
    ({"count": 42, "active": True, "score": 3.14, "note": None}, {"count": 42, "active": True, "score": 3.14, "note": None}),
    ({}, {}),
    ([], []),
    ("mail a@b.com", "mail [EMAIL ADDRESS]"),
    ({"emails": ["a@b.com", "no mail"]}, {"emails": ["[EMAIL ADDRESS]", "no mail"]}),
    ({"email": {"home": "a@b.com"}}, {"email": {"home": "[EMAIL ADDRESS]"}}),
    ({"email": ["x", {"phone": "12345"}]}, {"email": ["x", {"phone": "***-***-2345"}]}),
    ({"email": "", "phone": "  "}, {"email": "", "phone": "  "}),
    ({'k"ey': 'v:"a@b.com"'}, {'k"ey': 'v:"[EMAIL ADDRESS]"'}),
    ({"first_name": 'Jo"n \\ Ünï\n'}, {"first_name": "J*** \\*** Ü**"}),
    ({"ssn": 123456789, "email": None}, {"ssn": 123456789, "email": None}),
    ({"a:b": "x", "c": "https://x.y", "d": "{\"email\": \"q\"}"}, {"a:b": "x", "c": "https://x.y", "d": "{\"email\": \"q\"}"}),
    ({"name": "10.0.0.1"}, {"name": "10.0.0.1"}),
    ({"email": "a\u0000b😀@x.com"}, {"email": "a***@x***.com"}),
]


def test_json_text(spark):
    for value, want in CASES:
        assert tree(spark, value) == want, value
        assert json.loads(masked(spark, json.dumps(value, ensure_ascii=False, indent=2))) == want, value


def test_escaped_keys_are_read(spark):
    assert json.loads(masked(spark, '{"e\\u006dail": "a@b.com", "n": 1.50}')) == {"email": "a***@b***.com", "n": 1.5}


def test_values_told_by_their_escapes_only(spark):
    for value in ("555\n123\n4567", "\n555-123-4567", "\t123-45-6789"):
        assert tree(spark, {"x": value})["x"].strip() in ("[PHONE NUMBER]", "[US SSN]")
    assert json.loads(masked(spark, '["a\\u0040b.com"]')) == ["[EMAIL ADDRESS]"]


def test_numbers_order_and_spacing_survive(spark):
    text = '{ "z" : 1.50, "email" :  "a@b.com","a":1e3 , "z2":[ ] }'
    assert masked(spark, text) == '{ "z" : 1.50, "email" :  "a***@b***.com","a":1e3 , "z2":[ ] }'


def test_repeated_keys_are_all_masked(spark):
    assert masked(spark, '{"email": "a@b.com", "email": "c@d.com"}') == '{"email": "a***@b***.com", "email": "c***@d***.com"}'


def test_styles_and_reveals(spark):
    value = {"email": "john@example.com", "phone": "555-123-4567", "encrypted_x": "s"}
    full = tree(spark, value, style="full")
    assert full == {"email": "[EMAIL ADDRESS]", "phone": "[PHONE NUMBER]", "encrypted_x": "[REDACTED]"}
    shown = tree(spark, value, reveal_types=["EMAIL_ADDRESS", "SECRET"])
    assert shown == {"email": "john@example.com", "phone": "***-***-4567", "encrypted_x": "[REDACTED]"}
    pseudo = tree(spark, value, style="pseudonymize", seed="s")
    assert pseudo["email"].endswith("@masked.invalid") and pseudo["phone"].startswith("555-000-")
    hidden = tree(spark, value, secrets_only=True)
    assert hidden == {"email": "john@example.com", "phone": "555-123-4567", "encrypted_x": "[REDACTED]"}


def test_scalars_on_request(spark):
    value = {"ssn": 123456789, "phone": -1.5e3, "email": True, "n": 4111111111111111, "city": None, "zip": [1]}
    assert tree(spark, value) == value
    assert tree(spark, value, mask_scalars=True) == {
        "ssn": "***-**-6789", "phone": "***-***-5000", "email": "t***", "n": 4111111111111111, "city": None, "zip": [1],
    }


def test_deep_values_are_masked(spark):
    node = {"email": "john@example.com"}
    for _ in range(40):
        node = {"child": [node]}
    assert "john@" not in masked(spark, json.dumps(node))


def test_text_that_is_no_json_is_prose(spark):
    assert masked(spark, "call 555-123-4567 now") == "call [PHONE NUMBER] now"
    assert masked(spark, '{"email": "a@b.com"} and c@d.com') == '{"email": "[EMAIL ADDRESS]"} and [EMAIL ADDRESS]'
    assert masked(spark, "{'email': 'a@b.com'}") == "{'email': '[EMAIL ADDRESS]'}"
    assert masked(spark, None) is None
    assert masked(spark, "") == ""
    assert masked(spark, "host 10.0.0.1") == "host [IP ADDRESS]"


def test_is_json(spark):
    cases = {
        "{}": True, "[]": True, '"s"': True, "12": True, " [1, 2] ": True, '{"a": NaN, "b": -Infinity}': True,
        '{"a":1,"a":2}': True, "": False, "x": False, "{'a':1}": False, "[1,]": False, "[1": False,
        '{"a":1} x': False, '{"a":1}{"b":2}': False, "1, 2": False, '{"a" "b"}': False, '{"it\'s": "o\'k"}': True,
    }
    df = spark.createDataFrame([(k,) for k in cases], "j string")
    assert {r[0]: r[1] for r in df.select("j", is_json(F.col("j"))).collect()} == cases


def test_long_strings_do_not_exhaust_the_stack(spark):
    value = {"email": "a@b.com", "x": "\n\"\\" * 100_000}
    assert tree(spark, value)["email"] == "a***@b***.com"


SCHEMA = (
    "id int, email string, prof struct<first_name:string,age:int,tags:array<string>,"
    "contact:struct<phone:string,otp_secret:string>>, attrs map<string,string>, "
    "list array<struct<ssn:string,note:string>>, deep map<string,array<map<string,string>>>"
)
ROW = (
    1,
    "a@b.com",
    ("Ann", 30, ["x", "mail c@d.com"], ("555-123-4567", "s3cret")),
    {"email": "q@w.com", "plain": "z", "free": "tel 555-123-4567", "unlock_token": "t"},
    [("123-45-6789", "n"), None],
    {"k": [{"city": "Rome", "x": "y"}]},
)


@pytest.mark.parametrize("as_text", [False, True])
def test_typed_and_text_agree(spark, as_text):
    df = spark.createDataFrame([ROW, (2, None, None, None, None, None)], SCHEMA)
    struct = df.select(F.struct(*[c for c in df.columns]).alias("v"))
    if as_text:
        options = {"ignoreNullFields": "false"}
        out = struct.select(mask_json_text(F.to_json("v", options)))
    else:
        how = NestedStyle()
        out = struct.select(
            F.to_json(mask_nested(F.col("v"), struct.schema["v"].dataType, how), {"ignoreNullFields": "false"})
        )
    first, second = [json.loads(r[0]) for r in out.collect()]
    assert first == {
        "id": 1,
        "email": "a***@b***.com",
        "prof": {
            "first_name": "A**", "age": 30, "tags": ["x", "mail [EMAIL ADDRESS]"],
            "contact": {"phone": "***-***-4567", "otp_secret": "[REDACTED]"},
        },
        "attrs": {"email": "q***@w***.com", "plain": "z", "free": "tel [PHONE NUMBER]", "unlock_token": "[REDACTED]"},
        "list": [{"ssn": "***-**-6789", "note": "n"}, None],
        "deep": {"k": [{"city": "R***", "x": "y"}]},
    }
    assert second == {"id": 2, "email": None, "prof": None, "attrs": None, "list": None, "deep": None}


def test_nested_reveal_scalars_and_secrets(spark):
    df = spark.createDataFrame([(("a@b.com", 123456789, "s"), {"phone": 5551234567})], "v struct<email:string,ssn:bigint,otp_secret:string>, m map<string,bigint>")
    v, m = df.schema["v"].dataType, df.schema["m"].dataType

    def run(how):
        return df.select(mask_nested(F.col("v"), v, how).alias("v"), mask_nested(F.col("m"), m, how).alias("m")).first()

    row = run(NestedStyle(reveal_types=frozenset({"EMAIL_ADDRESS", "SECRET"})))
    assert tuple(row["v"]) == ("a@b.com", 123456789, "[REDACTED]") and row["m"] == {"phone": 5551234567}
    row = run(NestedStyle(mask_scalars=True))
    assert tuple(row["v"]) == ("a***@b***.com", "***-**-6789", "[REDACTED]") and row["m"] == {"phone": "***-***-4567"}
    row = run(NestedStyle(secrets_only=True))
    assert tuple(row["v"]) == ("a@b.com", 123456789, "[REDACTED]")


def test_types_without_text_are_left_as_they_are(spark):
    df = spark.createDataFrame([((1, [2.0]),)], "v struct<email:int,b:array<double>>")
    value = F.col("v")
    assert mask_nested(value, df.schema["v"].dataType, NestedStyle()) is value


def test_variant(spark):
    df = spark.createDataFrame([('{"email": "a@b.com", "n": 1}',)], "j string").select(F.parse_json("j").alias("v"))
    out = df.select(mask_nested(F.col("v"), T.VariantType(), NestedStyle()).alias("v"))
    assert out.schema["v"].dataType == T.VariantType()
    assert json.loads(out.select(F.to_json("v")).first()[0]) == {"email": "a***@b***.com", "n": 1}


def test_own_recognizers_work_inside_json(spark):
    own = (*DEFAULT_RECOGNIZERS, Recognizer("BADGE", r"\bB-\d{2}\b", 0.9))
    assert tree(spark, {"x": "see B-12", "y": "B-1"}, recognizers=own) == {"x": "see [BADGE]", "y": "B-1"}
    df = spark.createDataFrame([(("see B-12",),)], "v struct<x:string>")
    how = NestedStyle(recognizers=own)
    assert df.select(mask_nested(F.col("v"), df.schema["v"].dataType, how).alias("v")).first()[0]["x"] == "see [BADGE]"


def nested(depth, leaf):
    for level in range(depth):
        leaf = [leaf] if level % 2 else {"child": leaf}
    return leaf


@pytest.mark.parametrize(
    "secret",
    [nested(40, {"d": 1}), list(range(10_000)), {f"k{i}": {"v": [i]} for i in range(600)}, {}, [], 5, -1.5e3, True, [[], {}], [{"otp_secret": [1]}]],
    ids=lambda v: str(v)[:12],
)
def test_what_stands_behind_a_secret_key_is_hidden_alone(spark, secret):
    """However deep or large it is, and however the key is spelled; the rest of the document stays."""
    for around in (lambda v: {"id": 7, "note": "keep me", "otp_secret": v, "z": [1, {"a": "b"}]}, lambda v: [[{"x": [1], "otp_secret": v}], {"y": "]}"}], lambda v: nested(40, {"otp_secret": v, "after": 1.5})):
        text = json.dumps(around(secret))
        for spelled in (text, text.replace('"otp_secret"', '"otp\\u005fsecret"'), json.dumps(around(secret), indent=1)):
            assert json.loads(masked(spark, spelled)) == around("[REDACTED]"), spelled[:80]
            assert json.loads(masked(spark, spelled, secrets_only=True)) == around("[REDACTED]")


def test_many_secrets_in_one_document(spark):
    value = [{"otp_secret": {"a": [i, "]"]}, "email": "john@example.com", "k": {"unlock_token": i, "n": i}} for i in range(500)]
    want = [{"otp_secret": "[REDACTED]", "email": "j***@e***.com", "k": {"unlock_token": "[REDACTED]", "n": i}} for i in range(500)]
    assert tree(spark, value) == want


def test_nothing_behind_a_secret_key_stays_so(spark):
    assert masked(spark, '{"otp_secret": null, "n" : 1 , "unlock_token" :[ 1 ] }') == '{"otp_secret": null, "n" : 1 , "unlock_token" :"[REDACTED]" }'
    assert json.loads(masked(spark, '{"unlock_token": NaN, "otp_secret": -Infinity}')) == {"unlock_token": "[REDACTED]", "otp_secret": "[REDACTED]"}
