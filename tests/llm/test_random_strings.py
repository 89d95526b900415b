"""Random strings of every alphabet, alone and inside longer runs."""

import random
import string

import pytest

from veilframe.llm import secretscan

WORDS = "internationalization an_identifier_of_several_words is_in_of_to_at_by_on_it MAX_RETRY_COUNT_LIMIT 2024-01-15-12-30-45 /usr/local/share/doc/python3"


@pytest.fixture(scope="module")
def scanner(ranks_path):
    return secretscan.Scanner(secretscan.ranks(ranks_path), 16, 2.0)


def covered(scanner, before, secret):
    text = f"see {before}{secret} end"
    start = 4 + len(before)
    return any(a <= start and start + len(secret) <= b for a, kind, b in scanner.spans(text) if kind == 3)


@pytest.mark.parametrize("letters", [string.ascii_lowercase, string.ascii_uppercase])
def test_strings_of_one_case(scanner, letters):
    r = random.Random(1)
    found = [covered(scanner, "", "".join(r.choices(letters, k=20))) for _ in range(500)]
    assert sum(found) > 0.85 * len(found)


def test_licence_keys_and_words(scanner):
    assert covered(scanner, "", "QXZJ-9283-KWVB-4471")
    assert not any(scanner.spans(word) for word in WORDS.split())


@pytest.mark.parametrize("before", ["session_identifier=", "authorization=", "/user/settings/reset-password/"])
def test_strings_behind_names(scanner, before):
    r = random.Random(2)
    found = [covered(scanner, before, "".join(r.choices(string.ascii_letters + string.digits, k=20))) for _ in range(500)]
    assert sum(found) > 0.99 * len(found)


def test_what_a_pattern_leaves_of_a_run(scanner):
    secret = "Zx9kQ2vLm8RtY7wBn4Jc6Hd3"
    assert scanner.spans(f"{secret}/{'0123456789abcdef' * 2}") == [(0, 3, 25), (25, 2, 57)]
    assert scanner.spans(f"{'0123456789abcdef' * 2}_{secret}") == [(0, 2, 32), (32, 3, 57)]


@pytest.mark.parametrize("length, least", [(16, 0.8), (24, 0.95), (32, 0.98)])
def test_strings_with_symbols(scanner, length, least):
    r = random.Random(length)
    alphabet = string.ascii_letters + string.digits + "!@#%^&*"
    found = []
    for _ in range(500):
        secret = "".join(r.choices(alphabet, k=length))
        spans = [(a, b) for a, kind, b in scanner.spans(f"see {secret} end") if kind == 3]
        found.append(sum(b - a for a, b in spans) >= 0.8 * length)
    assert sum(found) > least * len(found)


def test_identifiers_are_left(scanner):
    for word in ("ISBN-978-3-16-148410-0", "978-3-16-148410-0", "isbn-0-306-40615-2", "covid19-vaccine-2021-uk", "jane.doe22@mail2.Example.com", "user@Host1#section-3-of-Page", "C#-and-F#-in-2021-Release"):
        assert scanner.spans(f"see {word} now") == [], word
    assert not secretscan.is_isbn("978-3-16-148410-1") and not secretscan.is_isbn("9283-4471-0021-9930")


def test_clean_documents_hold_hardly_any(spark, scanner):
    """Precision on the documents labelled good: one word in some thousand documents at most."""
    folder = "/root/testdata/sf0.01"
    labels = spark.read.parquet(f"{folder}/labels.parquet").where("quality = 1").select("doc_id")
    texts = [r.text for r in spark.read.parquet(f"{folder}/documents.parquet").join(labels, "doc_id").collect() if r.text]
    assert len(texts) > 200 and sum(kind == 3 for t in texts for _, kind, _ in scanner.spans(t)) <= 1
