"""Personal data in whole documents, pages and conversations."""

from __future__ import annotations

from pyspark.sql import functions as F

from veilframe import MaskedSession, Policy, Recognizer, find_pii, redact_text, rows_with_pii
from veilframe.functions.prose import DEFAULT_RECOGNIZERS, EXTENDED_RECOGNIZERS
from veilframe.operators.gazetteer import redact_names
from veilframe.operators.recognise import find_standing
from veilframe.operators.reports import findings_by

from . import duck
from .inputs import SEED, table

QUERIES = {}
ORACLES = {}


def _text_query(name, source, key, column, **settings):
    def run(spark, sf_dir):
        text = redact_text(F.col(column), **settings)
        return table(spark, sf_dir, source).select(*key, text.alias(column))

    style, shown = settings.get("style"), settings.get("reveal_types", ())
    pattern = "|".join(p for e, p, _ in duck.RECOGNIZERS if e not in shown)
    replacement = duck.hit_pseudonym if style == "pseudonymize" else duck.label
    QUERIES[name] = run
    ORACLES[name] = (
        f"SELECT {', '.join(key)}, {duck.prose(column, replacement, pattern)} AS {column} FROM {source}"
    )


_text_query("redact_documents", "documents", ["doc_id"], "text")
_text_query(
    "redact_documents_pseudonymized", "documents", ["doc_id"], "text", style="pseudonymize", seed=SEED
)
_text_query(
    "redact_documents_revealing", "documents", ["doc_id"], "text",
    reveal_types=["EMAIL_ADDRESS", "IP_ADDRESS"],
)
_text_query("redact_pages", "pages", ["page_id"], "html")
_text_query("redact_conversations", "conversations", ["conv_id", "turn"], "text")


def redact_free_text_columns(spark, sf_dir):
    session = MaskedSession(spark, Policy(default_style="full"))
    session.register("posts", table(spark, sf_dir, "documents").withColumnRenamed("text", "body"))
    return session.sql("SELECT doc_id, lang, body AS b FROM posts")


QUERIES["redact_free_text_columns"] = redact_free_text_columns
ORACLES["redact_free_text_columns"] = (
    f"SELECT doc_id, lang, {duck.prose('text')} AS b FROM documents"
)

_SCORE = "CASE entity_type " + " ".join(
    f"WHEN '{e}' THEN {s}::double" for e, _, s in duck.RECOGNIZERS
) + " END"
_FOUND = f"""
SELECT doc_id, lang, {duck.entity('value')} AS entity_type, value
FROM (SELECT doc_id, lang, unnest(regexp_extract_all(text, '{duck.ANY}')) AS value FROM documents)
"""


def find_in_documents(spark, sf_dir):
    return find_pii(table(spark, sf_dir, "documents"), "text", ["doc_id", "lang"])


QUERIES["find_pii"] = find_in_documents
ORACLES["find_pii"] = f"SELECT *, {_SCORE} AS score FROM ({_FOUND})"


def find_positions(spark, sf_dir):
    found = find_pii(table(spark, sf_dir, "documents"), "text", ["doc_id"], positions=True)
    return found.withColumnRenamed("start", "first").withColumnRenamed("end", "past")


QUERIES["find_pii_positions"] = find_positions
ORACLES["find_pii_positions"] = f"""
WITH cut AS (
  SELECT doc_id, regexp_split_to_array(text, '{duck.ANY}') AS gaps, regexp_extract_all(text, '{duck.ANY}') AS hits
  FROM documents),
walked AS (
  SELECT doc_id, hits[i] AS value,
    (list_sum(list_transform(gaps[1:i], lambda g: length(g)))
     + coalesce(list_sum(list_transform(hits[1:i - 1], lambda h: length(h))), 0))::int AS first
  FROM (SELECT *, unnest(range(1, len(hits) + 1)) AS i FROM cut))
SELECT doc_id, entity_type, value, {_SCORE} AS score, first, (first + length(value))::int AS past
FROM (SELECT *, {duck.entity('value')} AS entity_type FROM walked)
"""

_CHECKED = tuple(
    Recognizer(r.entity, r.pattern, r.score, "luhn", r.lead, r.requires)
    if r.entity == "CREDIT_CARD"
    else r
    for r in DEFAULT_RECOGNIZERS
)


def find_checked_cards(spark, sf_dir):
    found = find_pii(table(spark, sf_dir, "documents"), "text", ["doc_id"], _CHECKED)
    return found.where("entity_type = 'CREDIT_CARD'").select("doc_id", "value")


# Every second digit from the right is doubled; nine is taken off what exceeds nine.
_LUHN = """list_sum(list_transform(range(1, length(d) + 1), lambda i:
  CASE WHEN i % 2 = 1 THEN substr(reverse(d), i, 1)::int
       WHEN substr(reverse(d), i, 1)::int > 4 THEN substr(reverse(d), i, 1)::int * 2 - 9
       ELSE substr(reverse(d), i, 1)::int * 2 END)) % 10 = 0"""
QUERIES["find_checked_cards"] = find_checked_cards
ORACLES["find_checked_cards"] = f"""
SELECT doc_id, value
FROM (SELECT *, regexp_replace(value, '[^0-9]', '', 'g') AS d FROM ({_FOUND}) WHERE entity_type = 'CREDIT_CARD')
WHERE {_LUHN}
"""


# The same patterns in RE2, which cannot look behind as the e-mail pattern does.
_MORE = [(r.entity, duck.EMAIL if r.entity == "EMAIL_ADDRESS" else r.pattern.replace("'", "''")) for r in EXTENDED_RECOGNIZERS]
_MORE_ENTITY = "CASE " + " ".join(f"WHEN regexp_full_match(value, '{p}') THEN '{e}'" for e, p in _MORE) + " END"
# Letters count from 10; the first four characters go last; 97 leaves a rest of 1.
_IBAN = """list_reduce(list_transform(string_split(array_to_string(list_transform(string_split(
  concat(substr(replace(value, ' ', ''), 5), left(value, 4)), ''),
  lambda c: CASE WHEN c >= 'A' THEN (ascii(c) - 55)::varchar ELSE c END), ''), ''), lambda c: c::int),
  lambda rest, c: (rest * 10 + c) % 97) = 1"""


def _find_more(source, key, column):
    def run(spark, sf_dir):
        more = "concat_ws(' ', {0}, concat('GB82 WEST 1234 5698 7654 ', {1} % 100), concat('2001:db8::', {1} % 10), concat('9', lpad(cast({1} % 100 AS string), 2, '0'), '-70-1234'), concat('C0', lpad(cast({1} % 1000 AS string), 7, '0')))"
        given = table(spark, sf_dir, source).withColumn(column, F.expr(more.format(column, key)))
        return find_pii(given, column, [key], EXTENDED_RECOGNIZERS)

    return run


def _find_more_sql(source, key, column):
    given = (
        f"concat_ws(' ', {column}, concat('GB82 WEST 1234 5698 7654 ', {key} % 100), concat('2001:db8::', {key} % 10), "
        f"concat('9', lpad(({key} % 100)::varchar, 2, '0'), '-70-1234'), concat('C0', lpad(({key} % 1000)::varchar, 7, '0')))"
    )
    pattern = "|".join(f"(?:{p})" for _, p in _MORE)
    scores = " ".join(f"WHEN '{r.entity}' THEN {r.score}::double" for r in EXTENDED_RECOGNIZERS)
    return f"""
    WITH hits AS (SELECT {key}, unnest(regexp_extract_all({given}, '{pattern}')) AS value FROM {source}),
    judged AS (SELECT *, {_MORE_ENTITY} AS entity_type, regexp_replace(value, '[^0-9]', '', 'g') AS d FROM hits)
    SELECT {key}, entity_type, value, CASE entity_type {scores} END AS score FROM judged
    WHERE CASE entity_type WHEN 'CREDIT_CARD' THEN {_LUHN} WHEN 'IBAN_CODE' THEN {_IBAN} ELSE true END"""


for _source, _key, _column in (("documents", "doc_id", "text"), ("pages", "page_id", "url")):
    QUERIES[f"find_more_in_{_source}"] = _find_more(_source, _key, _column)
    ORACLES[f"find_more_in_{_source}"] = _find_more_sql(_source, _key, _column)


def pii_prefilter(spark, sf_dir):
    return rows_with_pii(table(spark, sf_dir, "documents"), "text").select("doc_id", "source")


QUERIES["pii_prefilter"] = pii_prefilter
ORACLES["pii_prefilter"] = (
    f"SELECT doc_id, source FROM documents WHERE regexp_matches(text, '{duck.PREFILTER}')"
)


def pii_counts_by_lang(spark, sf_dir):
    return findings_by(find_pii(table(spark, sf_dir, "documents"), "text", ["lang"]), "lang")


QUERIES["pii_counts_by_lang"] = pii_counts_by_lang
ORACLES["pii_counts_by_lang"] = f"""
SELECT lang, entity_type, count(*) AS findings, count(DISTINCT value) AS distinct_values
FROM ({_FOUND}) GROUP BY 1, 2
"""

_TOKEN = r"\b[0-9a-f]{40}\b"
_WITH_TOKENS = (*DEFAULT_RECOGNIZERS, Recognizer("ACCESS_TOKEN", _TOKEN, 0.9))


def redact_access_tokens(spark, sf_dir):
    """A recogniser of one's own beside the built-in ones."""
    text = redact_text(F.col("text"), recognizers=_WITH_TOKENS)
    return table(spark, sf_dir, "documents").select("doc_id", text.alias("text"))


QUERIES["redact_access_tokens"] = redact_access_tokens
ORACLES["redact_access_tokens"] = f"""
SELECT doc_id, {duck.prose(
    'text',
    lambda hit: f"CASE WHEN regexp_full_match({hit}, '[0-9a-f]{{40}}') THEN '[ACCESS TOKEN]' ELSE {duck.label(hit)} END",
    f"{duck.ANY}|{_TOKEN}",
)} AS text
FROM documents
"""


def _listed_names(spark, sf_dir):
    """Longer words of the benchmark passages stand for names."""
    words = table(spark, sf_dir, "benchmark").select(
        F.explode(F.regexp_extract_all("text", F.lit("[A-Za-z]{7,}"), F.lit(0))).alias("name")
    )
    kind = F.when(F.length("name") % 2 == 0, F.lit("PERSON")).otherwise(F.lit("LOCATION"))
    return words.select("name", kind.alias("entity_type")).distinct()


def _redact_listed(how):
    def run(spark, sf_dir):
        docs = table(spark, sf_dir, "documents").select("doc_id", "text")
        # A row without a key and rows that repeat are redacted like any other.
        docs = docs.unionByName(docs.where("doc_id % 10 = 0")).withColumn("doc_id", F.expr("nullif(doc_id, 3)"))
        return redact_names(docs, "text", _listed_names(spark, sf_dir), how=how)

    return run


QUERIES["redact_listed_names"] = _redact_listed("inline")
QUERIES["redact_listed_names_joined"] = _redact_listed("join")
# RE2 knows no combining marks as part of a word unless they are named, as here.
_WORD = r"[\p{L}\p{M}]+"
ORACLES["redact_listed_names"] = f"""
WITH listed AS (
  SELECT list(DISTINCT name) AS names
  FROM (SELECT unnest(regexp_extract_all(text, '[A-Za-z]{{7,}}')) AS name FROM benchmark)),
cut AS (
  SELECT nullif(doc_id, 3) AS doc_id, regexp_split_to_array(text, '{_WORD}') AS gaps,
    regexp_extract_all(text, '{_WORD}') AS words
  FROM (FROM documents UNION ALL FROM documents WHERE doc_id % 10 = 0))
SELECT doc_id, array_to_string(list_transform(list_zip(gaps, words), lambda z: concat(z[1],
  CASE WHEN z[2] IS NULL THEN '' WHEN NOT list_contains(names, z[2]) THEN z[2]
       WHEN length(z[2]) % 2 = 0 THEN '[PERSON]' ELSE '[LOCATION]' END)), '') AS text
FROM cut, listed
"""
ORACLES["redact_listed_names_joined"] = ORACLES["redact_listed_names"]


# Recognisers that look at the same characters: the best score stands, then the longest span, then the first kind.
_OVERLAPPING = (
    *DEFAULT_RECOGNIZERS,
    Recognizer("ACCOUNT", r"\b[0-9]{4,20}\b", 0.7, requires="[0-9]"),
    Recognizer("HOST", r"[a-z0-9]+\.example\.com", 0.5, requires="[.]"),
    Recognizer("NUMBERED", r"[a-z]+ [0-9(+][0-9() +.-]{2,}", 0.65, requires="[0-9]"),
)
_OVERLAPPING_SQL = (*duck.RECOGNIZERS, *((r.entity, r.pattern, r.score) for r in _OVERLAPPING[-3:]))


def find_overlaps(spark, sf_dir):
    found = find_standing(table(spark, sf_dir, "documents"), "text", ["doc_id"], _OVERLAPPING)
    return found.withColumnRenamed("start", "first").withColumnRenamed("end", "past")


QUERIES["find_overlaps"] = find_overlaps
ORACLES["find_overlaps"] = """
WITH cut AS (""" + " UNION ALL ".join(
    f"""SELECT doc_id, {i} AS place, '{e}' AS entity_type, {s}::double AS score,
      regexp_split_to_array(text, '{p}') AS gaps, regexp_extract_all(text, '{p}') AS hits FROM documents WHERE regexp_matches(text, '{p}')"""
    for i, (e, p, s) in enumerate(_OVERLAPPING_SQL)
) + """),
one AS (SELECT doc_id, place, entity_type, score, gaps, hits, unnest(range(1, len(hits) + 1)) AS i FROM cut),
placed AS (SELECT doc_id, place, entity_type, score, hits[i] AS value,
  (list_sum(list_transform(gaps[1:i], lambda g: length(g))) + coalesce(list_sum(list_transform(hits[1:i - 1], lambda h: length(h))), 0))::int AS s FROM one),
ranked AS (SELECT doc_id, list({'entity_type': entity_type, 'value': value, 'score': score, 'first': s, 'past': (s + length(value))::int}
  ORDER BY score DESC, length(value) DESC, place, s) AS spans FROM placed GROUP BY doc_id),
taken AS (SELECT doc_id, unnest(list_reduce(list_transform(spans, lambda x: [x]), lambda kept, x:
  CASE WHEN len(list_filter(kept, lambda k: k.first < x[1].past AND x[1].first < k.past)) > 0 THEN kept ELSE list_concat(kept, x) END)) AS t FROM ranked)
SELECT doc_id, t.entity_type AS entity_type, t.value AS value, t.score AS score, t.first AS first, t.past AS past FROM taken"""
