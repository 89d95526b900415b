"""Samples of values, votes on what they are, and reports on the outcome."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veilframe import MaskedSession, Policy, Rule, json_columns, sample_columns, scan_tables, vote_columns
from veilframe.operators.classify import remember
from veilframe.operators.reports import pii_report, rule_lines, schema_lines

from veilframe.sources.catalog import catalog_columns, table_list

from . import duck
from .inputs import CONTACT_JSON, PEOPLE, VARIANTS, dealt, derived, table

QUERIES = {}
ORACLES = {}


def _duck_samples(source: str, columns: list[str], limit: int = 100) -> str:
    """The distinct values of each column with the smallest hash; empty text goes last."""
    parts = [
        f"""SELECT '{c}' AS column_name, value FROM (
          SELECT DISTINCT {c}::varchar AS value FROM {source} WHERE {c} IS NOT NULL)
        QUALIFY row_number() OVER (ORDER BY sha256(value)) <= {limit}"""
        for c in columns
    ]
    return "SELECT * FROM (" + " UNION ALL ".join(f"({p})" for p in parts) + ") WHERE value <> ''"


def _duck_votes(samples: str, keys: str = "column_name", share: float = 0.2) -> str:
    order = " ".join(f"WHEN '{e}' THEN {i}" for i, (e, _, _) in enumerate(duck.RECOGNIZERS))
    score = " ".join(f"WHEN '{e}' THEN {s}::double" for e, _, s in duck.RECOGNIZERS)
    return f"""
    WITH samples AS ({samples}),
    sizes AS (SELECT {keys}, count(*) AS samples FROM samples GROUP BY ALL),
    hits AS (SELECT {keys}, unnest(regexp_extract_all(value, '{duck.ANY}')) AS hit FROM samples),
    votes AS (SELECT {keys}, {duck.entity('hit')} AS entity_type, count(*) AS votes FROM hits GROUP BY ALL)
    SELECT {keys}, entity_type, CASE entity_type {score} END AS confidence, votes, samples
    FROM votes JOIN sizes USING ({keys}) WHERE votes >= samples * {share}::double
    QUALIFY row_number() OVER (PARTITION BY {keys} ORDER BY votes DESC, CASE entity_type {order} END) = 1
    """


def sample_documents(spark, sf_dir):
    return sample_columns(table(spark, sf_dir, "documents"), ["text", "lang", "source", "doc_id"])


QUERIES["sample_columns"] = sample_documents
ORACLES["sample_columns"] = _duck_samples("documents", ["text", "lang", "source", "doc_id"])


def sample_lineitem(spark, sf_dir):
    """One value in a third of the rows, millions of distinct ones, and dates."""
    return sample_columns(table(spark, sf_dir, "lineitem"), limit=50)


QUERIES["sample_wide"] = sample_lineitem
ORACLES["sample_wide"] = _duck_samples(
    "lineitem",
    ["l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_extendedprice", "l_discount", "l_tax",
     "l_returnflag", "l_linestatus", "l_shipdate"],
    50,
)

_VARIANT_COLUMNS = ["email", "digits", "person", "ip", "place"]


def vote_on_variants(spark, sf_dir):
    return vote_columns(sample_columns(derived(spark, sf_dir, VARIANTS), _VARIANT_COLUMNS))


QUERIES["vote_columns"] = vote_on_variants
ORACLES["vote_columns"] = _duck_votes(_duck_samples(f"({VARIANTS})", _VARIANT_COLUMNS))


def vote_all_values(spark, sf_dir):
    """A vote over every value of every row: one aggregate, no sample."""
    values = sample_columns(derived(spark, sf_dir, VARIANTS), _VARIANT_COLUMNS, limit=None)
    return vote_columns(values, share=0.01)


QUERIES["vote_all_values"] = vote_all_values
ORACLES["vote_all_values"] = _duck_votes(
    " UNION ALL ".join(
        f"SELECT '{c}' AS column_name, {c}::varchar AS value FROM ({VARIANTS}) WHERE {c}::varchar <> ''" for c in _VARIANT_COLUMNS
    ),
    share=0.01,
)


def vote_on_pages(spark, sf_dir):
    samples = sample_columns(table(spark, sf_dir, "pages"))
    return vote_columns(samples, share=0.01)


QUERIES["vote_pages"] = vote_on_pages
ORACLES["vote_pages"] = _duck_votes(_duck_samples("pages", ["page_id", "url", "html"]), share=0.01)


def redact_found_json(spark, sf_dir):
    """JSON text found by its values is masked by its keys afterwards."""
    tables = {"public.profiles": dealt(spark, sf_dir, CONTACT_JSON).withColumnRenamed("data", "d")}
    policy = remember(Policy(), scan_tables(spark, tables, Policy(), json_share=0.9))
    session = MaskedSession(spark, policy).register("profiles", tables["public.profiles"])
    out = session.sql("SELECT c_custkey, d AS anything FROM profiles")
    return out.select(
        "c_custkey",
        F.get_json_object("anything", "$.email").alias("email"),
        F.get_json_object("anything", "$.contact.otp_secret").alias("otp_secret"),
        F.get_json_object("anything", "$.tier").alias("tier"),
    )


QUERIES["redact_found_json"] = redact_found_json
ORACLES["redact_found_json"] = f"""
SELECT c_custkey, {duck.email('email')} AS email, '[REDACTED]' AS otp_secret, tier
FROM (SELECT c_custkey, json_extract_string(data, '$.email') AS email, json_extract_string(data, '$.tier') AS tier
      FROM ({CONTACT_JSON}))
"""

_JSON_COLUMNS = """SELECT data, cast(c_custkey AS string) AS k, 'x' AS word,
  CASE WHEN c_custkey % 2 = 0 THEN concat('[', c_custkey, ']') ELSE concat('[', c_custkey) END AS half
FROM (""" + CONTACT_JSON + ")"


def find_json_columns(spark, sf_dir):
    df = derived(spark, sf_dir, _JSON_COLUMNS)
    return json_columns(df, ["data", "k", "word", "half"], share=0.3)


QUERIES["json_columns"] = find_json_columns
ORACLES["json_columns"] = f"""
SELECT column_name, count(*) AS samples, avg((json_valid(value) AND value[1] IN ('[', '{{'))::int::double) AS json_share
FROM ({_duck_samples(f"({_JSON_COLUMNS})", ["data", "k", "word", "half"])}) GROUP BY 1
HAVING avg((json_valid(value) AND value[1] IN ('[', '{{'))::int::double) >= 0.3
"""

# Names that say nothing, so that only the values can tell.
_SILENT = """
SELECT c_custkey AS k, email AS a1, phone AS a2, concat('from ', ip_address, ' to ', ip_address) AS a3,
  card_number AS a4, c_mktsegment AS a5, full_name, ssn, address AS x_notes
FROM (""" + PEOPLE + ")"
_POLICY = Policy(
    rules=(
        Rule("contacts", "a5", "PERSON", "full"),
        Rule("contacts", "full_name", "none"),
        Rule("texts", "lang", "LOCATION"),
    )
)


def _tables(spark, sf_dir):
    return {
        "public.contacts": derived(spark, sf_dir, _SILENT),
        "public.texts": table(spark, sf_dir, "documents"),
        "web.pages": table(spark, sf_dir, "pages"),
    }


def scan(spark, sf_dir, only=None):
    """All tables, or the one that a report is about."""
    return scan_tables(spark, {k: df for k, df in _tables(spark, sf_dir).items() if only in (None, k)}, _POLICY)


_DECLARED = [
    # schema, table, column, position, type, entity by name or rule, confidence, source
    ("public", "contacts", "k", 1, "bigint", None, None, None),
    ("public", "contacts", "a1", 2, "string", None, None, None),
    ("public", "contacts", "a2", 3, "string", None, None, None),
    ("public", "contacts", "a3", 4, "string", None, None, None),
    ("public", "contacts", "a4", 5, "string", None, None, None),
    ("public", "contacts", "a5", 6, "string", "PERSON", 1.0, "manual"),
    ("public", "contacts", "full_name", 7, "string", None, None, None),
    ("public", "contacts", "ssn", 8, "string", "US_SSN", 0.9, "heuristic"),
    ("public", "contacts", "x_notes", 9, "string", "FREE_TEXT", 0.8, "heuristic"),
    ("public", "texts", "doc_id", 1, "bigint", None, None, None),
    ("public", "texts", "text", 2, "string", None, None, None),
    ("public", "texts", "lang", 3, "string", "LOCATION", 1.0, "manual"),
    ("public", "texts", "source", 4, "string", None, None, None),
    ("public", "texts", "n_chars", 5, "bigint", None, None, None),
    ("web", "pages", "page_id", 1, "bigint", None, None, None),
    ("web", "pages", "url", 2, "string", None, None, None),
    ("web", "pages", "html", 3, "string", None, None, None),
]


def _sql(value):
    if value is None:
        return "NULL"
    return f"'{value}'" if isinstance(value, str) else str(value)


_VALUES = ", ".join("(" + ", ".join(_sql(v) for v in row) + ")" for row in _DECLARED)
_SCANNED = f"""
WITH declared(table_schema, table_name, column_name, position, data_type, named, sure, said) AS (VALUES {_VALUES}),
voted AS (
  SELECT * FROM ({_duck_votes(
      f"SELECT 'public.contacts' AS table_key, * FROM ({_duck_samples(f'({_SILENT})', ['k', 'a1', 'a2', 'a3', 'a4'])}) "
      f"UNION ALL SELECT 'public.texts', * FROM ({_duck_samples('documents', ['doc_id', 'text', 'source', 'n_chars'])}) "
      f"UNION ALL SELECT 'web.pages', * FROM ({_duck_samples('pages', ['page_id', 'url', 'html'])})",
      "table_key, column_name",
  )}))
SELECT d.table_schema, d.table_name, d.column_name, position, data_type, true AS is_nullable,
  coalesce(named, v.entity_type) AS entity_type,
  coalesce(sure::double, v.confidence) AS confidence,
  coalesce(said, CASE WHEN v.entity_type IS NOT NULL THEN 'values' END) AS source,
  CASE WHEN coalesce(named, v.entity_type) IS NOT NULL THEN coalesce(named = 'FREE_TEXT', false) END AS is_free_text,
  CASE WHEN coalesce(named, v.entity_type) IS NOT NULL THEN false END AS is_json,
  d.column_name = 'full_name' AS excluded
FROM declared d LEFT JOIN voted v
  ON v.table_key = concat(d.table_schema, '.', d.table_name) AND v.column_name = d.column_name
"""
ORACLES["scan_tables"] = f"SELECT * EXCLUDE (is_nullable) FROM ({_SCANNED})"
QUERIES["scan_tables"] = lambda spark, sf_dir: scan(spark, sf_dir).drop("is_nullable")


def report(spark, sf_dir):
    return pii_report(spark, scan(spark, sf_dir), _POLICY).drop("is_nullable")


_STYLE = """CASE WHEN entity_type IS NULL THEN 'none' WHEN column_name = 'a5' THEN 'full' ELSE 'partial' END"""
QUERIES["pii_report"] = report
ORACLES["pii_report"] = f"SELECT * EXCLUDE (is_nullable), {_STYLE} AS masking_style FROM ({_SCANNED})"


def report_of_one_table(spark, sf_dir):
    return pii_report(spark, scan(spark, sf_dir, "web.pages"), _POLICY, "web.pages").select(
        "column_name", "entity_type", "masking_style"
    )


QUERIES["pii_report_one_table"] = report_of_one_table
ORACLES["pii_report_one_table"] = (
    f"SELECT column_name, entity_type, {_STYLE} AS masking_style FROM ({_SCANNED}) WHERE table_name = 'pages'"
)


def tables_with_personal_data(spark, sf_dir):
    return table_list(scan(spark, sf_dir).where("entity_type is not null"))


QUERIES["table_list"] = tables_with_personal_data
ORACLES["table_list"] = f"""
SELECT DISTINCT concat(table_schema, '.', table_name) AS table_key FROM ({_SCANNED}) WHERE entity_type IS NOT NULL
"""


def lines_of_schema(spark, sf_dir):
    return schema_lines(report(spark, sf_dir))


_KEY = "concat(table_schema, '.', table_name)"
_PERCENT = "concat(round(confidence * 100)::int, '%')"
QUERIES["schema_lines"] = lines_of_schema
ORACLES["schema_lines"] = f"""
SELECT {_KEY} AS table_key, position, concat('  ', column_name, ': ', data_type,
  CASE WHEN entity_type IS NULL THEN '' ELSE
    concat('  ⚠ PII:', entity_type, ' (', source, ', ', {_PERCENT}, ') → ', {_STYLE}) END) AS line
FROM ({_SCANNED})
UNION ALL SELECT DISTINCT {_KEY}, 0, concat('## ', {_KEY}) FROM ({_SCANNED})
"""


def lines_of_rules(spark, sf_dir):
    return rule_lines(report(spark, sf_dir))


QUERIES["rule_lines"] = lines_of_rules
ORACLES["rule_lines"] = f"""
SELECT concat({_KEY}, '.', column_name) AS rule_key,
  CASE WHEN excluded THEN concat('  ', {_KEY}, '.', column_name, ': NOT PII (manually excluded)')
  ELSE concat('  ', {_KEY}, '.', column_name, ': ', entity_type, ' (', source, ', ', {_PERCENT}, ') → ', {_STYLE}) END AS line
FROM ({_SCANNED}) WHERE entity_type IS NOT NULL OR excluded
"""


def redact_by_values(spark, sf_dir):
    """What the vote found is masked in the queries that follow."""
    tables = {"public.contacts": derived(spark, sf_dir, _SILENT)}
    policy = remember(_POLICY, scan_tables(spark, tables, _POLICY))
    session = MaskedSession(spark, policy)
    session.register("contacts", tables["public.contacts"])
    return session.sql("SELECT k, a1, a2 AS tel, a3, a4, full_name FROM contacts")


QUERIES["redact_by_values"] = redact_by_values
ORACLES["redact_by_values"] = f"""
SELECT k, {duck.email('a1')} AS a1, {duck.phone('a2')} AS tel, {duck.ip('a3')} AS a3,
  {duck.card('a4')} AS a4, full_name FROM ({_SILENT})
"""


_LISTED = {
    "customer": "c_custkey:bigint c_name:string c_nationkey:int c_acctbal:double c_mktsegment:string",
    "orders": "o_orderkey:bigint o_custkey:bigint o_orderstatus:string o_totalprice:double o_orderdate:timestamp_ntz o_orderpriority:string",
    "documents": "doc_id:bigint text:string lang:string source:string n_chars:bigint",
}


def columns_in_catalog(spark, sf_dir):
    """The columns of tables saved in the catalog, with how many rows of each have a value."""
    spark.sql("CREATE DATABASE IF NOT EXISTS listed")
    counts = []
    for name in _LISTED:
        spark.sql(f"DROP TABLE IF EXISTS listed.{name}")
        spark.sql(f"CREATE TABLE listed.{name} USING parquet LOCATION '{sf_dir}/{name}.parquet'")
        saved = spark.table(f"listed.{name}")
        filled = saved.agg(*[F.count(c).alias(c) for c in saved.columns]).unpivot([], saved.columns, "counted", "filled")
        counts.append(filled.withColumn("of_table", F.lit(name)))
    found = catalog_columns(spark, ["listed"]).where(F.col("table_name").isin(*_LISTED))
    filled = reduce(DataFrame.unionByName, counts)
    same = (F.col("table_name") == F.col("of_table")) & (F.col("column_name") == F.col("counted"))
    return found.join(filled, same).select("table_name", "column_name", "position", "data_type", "filled")


QUERIES["catalog_columns"] = columns_in_catalog
ORACLES["catalog_columns"] = " UNION ALL ".join(
    f"SELECT '{table}' AS table_name, '{name}' AS column_name, {i} AS position, '{kind}' AS data_type, count({name}) AS filled FROM {table}"
    for table, columns in _LISTED.items()
    for i, (name, kind) in enumerate((c.split(":") for c in columns.split()), 1)
)
