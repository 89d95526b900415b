"""Classification of names: columns, words and JSON keys taken from the data."""

from __future__ import annotations

from pyspark.sql import functions as F

from veilframe.functions.names import entity_of_column_name
from veilframe.operators.classify import classify_columns, decisions_from_rules, json_keys

from . import duck
from .inputs import derived, table

QUERIES = {}
ORACLES = {}

_STEMS = (
    "email", "mailing_address", "ship_address", "phone", "cell", "fax_no", "ssn", "tax_id", "ein",
    "first_name", "holder_name", "nickname", "name", "username", "ip_addr", "sign_in_ip", "lat",
    "user_lat", "longitude", "city", "capacity", "state", "estate", "zip", "country", "dob", "adobe",
    "birth_date", "credit_card", "pan", "bank_account", "routing_number", "encrypted_password",
    "encrypted_message", "otp_secret", "unlock_token", "passport", "driver_license", "dl_num",
    "body", "nobody", "exchanges", "notes", "description", "id", "status", "amount", "text",
)

COLUMN_NAMES = f"""
SELECT 'public' AS table_schema, concat('t', c_nationkey) AS table_name,
  concat(CASE c_custkey % 5 WHEN 0 THEN 'rep_' WHEN 1 THEN 'c.' ELSE '' END,
    CASE WHEN c_custkey % 7 = 0 THEN upper(stem) ELSE stem END,
    CASE c_custkey % 3 WHEN 0 THEN '' WHEN 1 THEN concat('_', lower(c_mktsegment)) ELSE concat('-', c_custkey) END
  ) AS column_name,
  c_custkey AS position,
  CASE c_custkey % 11 WHEN 0 THEN 'json' WHEN 1 THEN 'struct<a:int>' WHEN 2 THEN 'array<string>' ELSE 'string' END
    AS data_type,
  true AS is_nullable
FROM (SELECT *, split_part('{"|".join(_STEMS)}', '|', cast(c_custkey % {len(_STEMS)} + 1 AS int)) AS stem FROM customer)
"""

_JUDGED = f"""
SELECT *, CASE WHEN data_type IN ('json', 'struct<a:int>') THEN 'JSON_CONTAINER'
  ELSE {duck.column_entity('column_name')} END AS entity_type
FROM ({COLUMN_NAMES})
"""

_CONFIDENCE = """CASE entity_type WHEN 'JSON_CONTAINER' THEN 1.0::double WHEN 'FREE_TEXT' THEN 0.8::double
  ELSE CASE WHEN entity_type IS NOT NULL THEN 0.9::double END END"""


def classify_names(spark, sf_dir):
    return classify_columns(derived(spark, sf_dir, COLUMN_NAMES))


QUERIES["classify_columns"] = classify_names
ORACLES["classify_columns"] = f"""
SELECT table_schema, table_name, column_name, position, data_type, is_nullable, entity_type,
  {_CONFIDENCE} AS confidence,
  CASE WHEN entity_type IS NOT NULL THEN 'heuristic' END AS source,
  CASE WHEN entity_type IS NOT NULL THEN entity_type = 'FREE_TEXT' END AS is_free_text,
  CASE WHEN entity_type IS NOT NULL THEN entity_type = 'JSON_CONTAINER' END AS is_json,
  false AS excluded
FROM ({_JUDGED})
"""

# Rules name some columns of every table, in other letter case than the columns have.
_RULES = f"""
SELECT CASE WHEN position % 2 = 0 THEN concat('PUBLIC.', upper(table_name)) ELSE table_name END AS "table",
  upper(column_name) AS "column",
  CASE position % 3 WHEN 0 THEN 'none' WHEN 1 THEN 'US_SSN' ELSE 'FREE_TEXT' END AS pii_type,
  position AS given
FROM ({COLUMN_NAMES}) WHERE column_name LIKE '%a%'
"""


def classify_with_rules(spark, sf_dir):
    columns = derived(spark, sf_dir, COLUMN_NAMES)
    rules = spark.sql(_RULES.replace('"', "`"))
    return classify_columns(columns, decisions_from_rules(rules, order="given")).select(
        "table_name", "column_name", "position", "entity_type", "confidence", "source",
        "is_free_text", "excluded",
    )


QUERIES["classify_with_rules"] = classify_with_rules
ORACLES["classify_with_rules"] = f"""
WITH decided AS (
  SELECT CASE WHEN contains("table", '.') THEN lower("table") ELSE concat('public.', lower("table")) END AS t,
    lower("column") AS c, arg_max(pii_type, given) AS pii_type
  FROM ({_RULES}) GROUP BY 1, 2)
SELECT table_name, column_name, position,
  CASE WHEN pii_type IS NULL THEN entity_type WHEN pii_type <> 'none' THEN pii_type END AS entity_type,
  CASE WHEN pii_type IS NULL THEN {_CONFIDENCE} WHEN pii_type <> 'none' THEN 1.0::double END AS confidence,
  CASE WHEN pii_type IS NULL THEN CASE WHEN entity_type IS NOT NULL THEN 'heuristic' END
    WHEN pii_type <> 'none' THEN 'manual' END AS source,
  CASE WHEN pii_type IS NULL THEN CASE WHEN entity_type IS NOT NULL THEN entity_type = 'FREE_TEXT' END
    WHEN pii_type <> 'none' THEN pii_type = 'FREE_TEXT' END AS is_free_text,
  coalesce(pii_type = 'none', false) AS excluded
FROM ({_JUDGED}) LEFT JOIN decided
  ON t = concat('public.', lower(table_name)) AND c = lower(column_name)
"""


def classify_words(spark, sf_dir):
    """Every word of every document judged as if it were a column name."""
    words = table(spark, sf_dir, "documents").select(
        F.explode(F.regexp_extract_all("text", F.lit("[A-Za-z_]+"), F.lit(0))).alias("word")
    )
    counted = words.groupBy("word").agg(F.count(F.lit(1)).alias("uses"))
    judged = counted.withColumn("entity_type", entity_of_column_name(F.col("word")))
    return judged.groupBy("entity_type").agg(
        F.count(F.lit(1)).alias("words"), F.sum("uses").alias("uses")
    )


QUERIES["classify_words"] = classify_words
ORACLES["classify_words"] = f"""
SELECT {duck.column_entity('word')} AS entity_type, count(*) AS words, sum(uses)::bigint AS uses
FROM (SELECT word, count(*) AS uses
      FROM (SELECT unnest(regexp_extract_all(text, '[A-Za-z_]+')) AS word FROM documents) GROUP BY 1)
GROUP BY 1
"""

_KEYED = f"""
SELECT c_custkey, concat('{{"', replace(column_name, '"', ''), '": 1, "email_body": "a: b", "k', c_custkey, '": null, "in": [{{"home_zip": {{"n": 1}}}}, "x:y"]}}') AS data
FROM (SELECT position AS c_custkey, column_name FROM ({COLUMN_NAMES}))
"""


def classify_json_keys(spark, sf_dir):
    return json_keys(derived(spark, sf_dir, _KEYED), "data")


QUERIES["classify_json_keys"] = classify_json_keys
ORACLES["classify_json_keys"] = f"""
SELECT key, {duck.key_entity('key')} AS entity_type
FROM (SELECT DISTINCT unnest(list_concat(json_keys(data), ['home_zip', 'n'])) AS key FROM ({_KEYED}))
"""

