"""Masks on many random values, against their definitions in plain Python."""

import json
import random
import re

import pytest
from pyspark.sql import functions as F

from veilframe import mask, mask_by_entity, mask_json_text, redact_text
from veilframe.functions import vocabulary as V
from veilframe.functions.names import key_entity
from veilframe.functions.prose import findings, has_findings

ALPHABET = list("ab1234567890@.- \t\n/()é😀٣Ⅷ*$\\'\"") + [" ", " ", "\x1c", "\x85", "ß", "\r\n", "user@mail.com", "555-123-4567"]


def some_text(rng, most=14):
    return "".join(rng.choice(ALPHABET) for _ in range(rng.randrange(most)))


def texts(n, seed=7):
    rng = random.Random(seed)
    return [some_text(rng) for _ in range(n)]


def generic(s):
    return "***" if len(s) < 2 else s[0] + "*" * (len(s) - 1)


def address(s):
    if "@" not in s:
        return generic(s)
    at = s.index("@")
    local, domain = s[:at], s[at + 1 :]
    dot = domain.rfind(".")
    name, ending = (domain, "") if dot < 0 else (domain[:dot], domain[dot:])
    return f"{local[:1]}***@{name[:1]}***{ending}"


def tail(before, short):
    def one(s):
        digits = "".join(c for c in s if c.isdecimal())
        return short if len(digits) < 4 else before + digits[-4:]

    return one


def financial(s):
    digits = "".join(c for c in s if c.isdecimal())
    return "****" if len(digits) < 4 else digits[-4:].rjust(len(digits), "*")


def name(s):
    return " ".join(w + "***" if len(w) == 1 else w[0] + "*" * (len(w) - 1) for w in s.split())


def ip(s):
    return "***.***.***." + s[s.rfind(".") + 1 :] if s.count(".") == 3 else "***.***.***. ***"


def place(s):
    leading = len(s) - len(re.sub(r"^\d+", "", s))
    return "***" + s[leading:] if leading else generic(s)


DEFINITIONS = {
    "EMAIL_ADDRESS": address,
    "PHONE_NUMBER": tail("***-***-", "***"),
    "US_SSN": tail("***-**-", "***-**-****"),
    "CREDIT_CARD": tail("****-****-****-", "****-****-****-****"),
    "PERSON": name,
    "IP_ADDRESS": ip,
    "LOCATION": place,
    "FINANCIAL": financial,
    "DATE_TIME": generic,
}


def defined(s, entity):
    if not s.strip():
        return s
    return V.REDACTED if entity == "SECRET" else DEFINITIONS.get(entity, generic)(s)


@pytest.mark.parametrize("entity", [*DEFINITIONS, "SECRET"])
def test_masks_follow_their_definitions(spark, entity):
    values = texts(1500)
    df = spark.createDataFrame([(i, v, entity) for i, v in enumerate(values)], "i int, v string, e string")
    rows = df.select("i", mask(F.col("v"), entity).alias("a"), mask_by_entity(F.col("v"), F.col("e")).alias("b")).collect()
    wrong = [(values[r["i"]], r["a"], r["b"]) for r in rows if not (r["a"] == r["b"] == defined(values[r["i"]], entity))]
    assert wrong == []


KEYS = ["email", "phone", "city", "k", "a b", "é", 'q"', "b\\", "otp_secret", "first_name", "ssn", "n:", "ip_addr"]


def some_json(rng, depth=0):
    pick = rng.random()
    if depth > 4 or pick < 0.4:
        plain = [None, True, 12, -1.5, 1e30, "", "x"]
        return rng.choice(plain) if rng.random() < 0.3 else some_text(rng, 8)
    if pick < 0.6:
        return [some_json(rng, depth + 1) for _ in range(rng.randrange(4))]
    return {rng.choice(KEYS): some_json(rng, depth + 1) for _ in range(rng.randrange(5))}


def is_secret(key):
    return key_entity(key) == "SECRET"


def strings_without_key(value, key=None):
    """Every string leaf that is masked by content, in document order; nothing behind a secret key is."""
    if isinstance(value, dict):
        for k, v in value.items():
            if not is_secret(k):
                yield from strings_without_key(v, k if isinstance(v, str) else None)
    elif isinstance(value, list):
        for v in value:
            yield from strings_without_key(v)
    elif isinstance(value, str) and (key is None or key_entity(key) is None):
        yield value


def walked(value, prose, key=None):
    if isinstance(value, dict):
        return {
            k: V.REDACTED if is_secret(k) and v is not None and not isinstance(v, str) else walked(v, prose, k if isinstance(v, str) else None)
            for k, v in value.items()
        }
    if isinstance(value, list):
        return [walked(v, prose) for v in value]
    if not isinstance(value, str):
        return value
    entity = key_entity(key) if key is not None else None
    return defined(value, entity) if entity else prose[value]


def test_json_masking_follows_the_walk(spark):
    rng = random.Random(11)
    values = [some_json(rng) for _ in range(600)]
    leaves = sorted({s for v in values for s in strings_without_key(v)})
    scanned = spark.createDataFrame([(s,) for s in leaves], "s string").select("s", redact_text(F.col("s")).alias("r"))
    # A neutral string is scanned only if it has the shape of personal data, IP apart;
    # nothing in the alphabet makes an IP address without a prefix of another kind.
    prose = {r["s"]: r["r"] for r in scanned.collect()}
    for ascii_only, indent in ((True, None), (False, 1)):
        rows = [(i, json.dumps(v, ensure_ascii=ascii_only, indent=indent)) for i, v in enumerate(values)]
        df = spark.createDataFrame(rows, "i int, j string")
        for i, got in df.select("i", mask_json_text(F.col("j"))).collect():
            assert json.loads(got) == walked(values[i], prose), values[i]


def test_redacting_twice_changes_nothing(spark):
    rng = random.Random(3)
    # Spaces keep the hits apart: one that touches another may have no word boundary
    # until its neighbour is replaced.
    pieces = ["user@mail.com", "555-123-4567", "(555) 123-4567", "4111 1111 1111 1111", "10.0.0.1", "123-45-6789"]
    values = [" ".join(rng.choice([some_text(rng, 6).replace("@", ""), rng.choice(pieces)]) for _ in range(8)) for _ in range(800)]
    df = spark.createDataFrame([(v,) for v in values], "v string")
    out = df.select("v", redact_text(F.col("v")).alias("r"))
    assert out.where(has_findings(F.col("v"))).count() > 700
    again = out.select("r", redact_text(F.col("r")).alias("again"))
    assert again.where("r <> again").collect() == []


def test_findings_are_the_matches_of_the_plain_patterns(spark):
    octet = r"(?:25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)"
    plain = re.compile(
        "|".join([V.EMAIL_SHAPE, V.PHONE_SHAPE, V.PHONE_PARENS_SHAPE, V.SSN_SHAPE, V.CARD_SHAPE, rf"\b(?:{octet}\.){{3}}{octet}\b"])
    )
    rng = random.Random(5)
    pieces = ["555-123-4567", "123-45-6789", "4111-1111", "10.0.0.1", "255.", "(555)", "a@b", ".co", "é", " ", "1234"]
    # Java does not count the separator controls as white space inside a pattern.
    letters = [c for c in ALPHABET if c != "\x1c"]
    values = ["".join(rng.choice([*letters, *pieces]) for _ in range(rng.randrange(30))) for _ in range(4000)]
    df = spark.createDataFrame([(v,) for v in values], "v string")
    rows = df.select("v", F.transform(findings(F.col("v")), lambda f: f["value"]).alias("f")).collect()
    assert [(r["v"], r["f"]) for r in rows if r["f"] != plain.findall(r["v"])] == []
    assert sum(len(r["f"]) for r in rows) > 1000
