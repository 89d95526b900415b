"""Quality rules where the corpus holds more than the four listed languages."""

import random

import pytest
from pyspark.sql import functions as F

from veilframe.llm import rules

FOLDER = "/root/testdata/sf0.01"


def prose(seed, syllables, n_words=300):
    """Words of syllables, none of them listed, in sentences."""
    r = random.Random(seed)
    words = ["".join(r.choices(syllables, k=r.randint(2, 4))) for _ in range(n_words)]
    return ". ".join(" ".join(words[i : i + 9]).capitalize() for i in range(0, n_words, 9))


FIFTH = ["ka", "lo", "mi", "ru", "ten", "pa", "vos", "hil"]
GREEK = ["κα", "λο", "μι", "ρου", "τεν", "πα", "βος", "χιλ"]


@pytest.fixture(scope="module")
def given(spark):
    labels = spark.read.parquet(f"{FOLDER}/labels.parquet").select("doc_id", "quality")
    return spark.read.parquet(f"{FOLDER}/documents.parquet").join(labels, "doc_id", "left").select("doc_id", "text", "lang", "quality")


def kept(df):
    rows = rules.judge_quality(df).where("NOT base_failed").select("rest.*", "kept", "class_distance").collect()
    return {r.doc_id: r for r in rows}


def test_a_fifth_language_leaves_the_common_words_of_the_others(spark, given):
    junk = set(r.doc_id for r in given.where("quality = 0").collect())
    alone = kept(given)
    more = [(-1 - i, prose(i, FIFTH), "it", 1) for i in range(30)] + [(-99, "§ 1 " * 400_000, "it", 0)]
    both = kept(given.unionByName(spark.createDataFrame(more, given.schema)))
    assert all(both[i].kept for i in range(-30, 0))
    assert {i for i in junk if i in alone and alone[i].kept} == {i for i in junk if i in both and both[i].kept}
    assert sum(alone[i].kept for i in junk & alone.keys()) <= 0.2 * len(junk & alone.keys())


def test_junk_is_no_reference_of_its_own(spark, given):
    """Neither under a null language, nor as the only texts of a listed one."""
    texts = [prose(i, FIFTH) for i in range(30)]
    for lang in (None, "de"):
        rows = [(i, t, lang, 0) for i, t in enumerate(texts)]
        found = kept(spark.createDataFrame(rows, given.schema).unionByName(given.where("lang = 'en'").withColumn("doc_id", F.col("doc_id") + 1000)))
        assert not any(found[i].kept for i in range(30))


def test_languages_with_few_texts(spark, given):
    """A listed language has its trusted reference; another is held against all in its character classes."""
    rows = given.where("quality = 1 AND lang = 'fr' AND length(text) > 1000").limit(5)
    few = spark.createDataFrame([(-1, prose(1, GREEK), "el", 1)], given.schema).unionByName(rows)
    found = kept(few)
    assert len(found) == 6 and all(r.kept for r in found.values()) and found[-1].class_distance < 0.2


def test_every_language_is_served(spark, given):
    """However many they are: clean texts of scripts of their own stay, and what is unlike them goes."""
    rows = [(k * 100 + i, prose(k * 100 + i, FIFTH), f"l{k}", 1) for k in range(33) for i in range(20)]
    thai = ["".join(map(chr, range(0x0E01 + k, 0x0E04 + k))) for k in range(20)]
    rows += [(5_000 + i, prose(i, thai, 120), "th", 1) for i in range(20)]
    rows.append((9_999, " ".join(f"ÀÉ{i}% #" for i in range(200)), "th", 0))
    found = kept(spark.createDataFrame(rows, given.schema))
    assert len(found) == 681 and all(found[x[0]].kept for x in rows[:-1]) and not found[9_999].kept


@pytest.mark.parametrize("many", [5, 19, 20, 25])
def test_no_tag_and_no_number_decides(spark, given, many):
    """Random symbols go under any tag, however many they are; clean texts of another script stay."""
    r = random.Random(many)
    junk = [" ".join("".join(r.choices("#*$%&|<>{}[]=+~^0123456789", k=r.randint(2, 9))) for _ in range(200)) for _ in range(many)]
    tags = ["en", "en-US", "EN_gb", "zz", "el", "th", "", "und", None]
    rows = [(k * 1000 + i, t, tag, 0) for k, tag in enumerate(tags) for i, t in enumerate(junk)]
    rows += [(100_000 + i, prose(i, GREEK), "el", 1) for i in range(30)]
    found = kept(spark.createDataFrame(rows, given.schema))
    assert [i for i in found if i < 100_000 and found[i].kept] == []
    assert sum(found[i].kept for i in found if i >= 100_000) == 30


def test_tags_of_a_language_are_one(spark, given):
    clean = given.where("quality = 1 AND lang = 'en' AND length(text) > 1000").limit(20).collect()
    junk = [prose(i, FIFTH) for i in range(10)]
    for tag in ("en", "en-US", "EN"):
        rows = [(r.doc_id, r.text, tag, 1) for r in clean] + [(-1 - i, t, tag, 0) for i, t in enumerate(junk)]
        found = kept(spark.createDataFrame(rows, given.schema))
        assert all(r.kept == (i >= 0) for i, r in found.items())
