"""Result lines, writes, streams, and facts about SQL text."""

from __future__ import annotations

from pyspark.sql import functions as F

from veilframe import (
    MaskedSession,
    Policy,
    redact_stream,
    result_lines,
    table_hints,
    write_stream,
    write_with_count,
    refused_as,
    writes_data,
)
from . import duck
from .inputs import PEOPLE, SEED, derived, scratch, table

QUERIES = {}
ORACLES = {}

_CELL = (
    "CASE WHEN {0} IS NULL THEN 'NULL' WHEN length({0}::varchar) > 500 "
    "THEN concat(left({0}::varchar, 500), '... (truncated)') ELSE {0}::varchar END"
)


def _cells(*columns):
    return [_CELL.format(c) for c in columns]


def markdown_lines(spark, sf_dir):
    """Long documents are cut in the cell; labels that are missing show as NULL."""
    docs = table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels"), "doc_id", "left")
    return result_lines(docs.select("doc_id", "lang", "quality", "text"), max_cell_chars=500)


QUERIES["markdown_lines"] = markdown_lines
ORACLES["markdown_lines"] = f"""
SELECT concat('| ', concat_ws(' | ', {', '.join(_cells('doc_id', 'lang', 'quality', 'text'))}), ' |') AS line
FROM documents LEFT JOIN labels USING (doc_id)
"""


def markdown_lines_uncut(spark, sf_dir):
    """As a sink for whole tables: nothing is cut unless asked for, whatever the width."""
    docs = table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels"), "doc_id", "left")
    return result_lines(docs.select("doc_id", "lang", "quality", "text"), form="markdown")


QUERIES["markdown_lines_uncut"] = markdown_lines_uncut
ORACLES["markdown_lines_uncut"] = """
SELECT concat('| ', concat_ws(' | ', coalesce(doc_id::varchar, 'NULL'), coalesce(lang, 'NULL'),
  coalesce(quality::varchar, 'NULL'), coalesce(text, 'NULL')), ' |') AS line
FROM documents LEFT JOIN labels USING (doc_id)
"""


def tsv_lines(spark, sf_dir):
    session = MaskedSession(spark)
    session.register("people", derived(spark, sf_dir, PEOPLE))
    return result_lines(
        session.sql("SELECT c_custkey, c_nationkey, c_mktsegment, full_name, email, phone, ssn, ip_address, address FROM people")
    )


QUERIES["tsv_lines"] = tsv_lines
ORACLES["tsv_lines"] = f"""
SELECT concat_ws(chr(9), c_custkey, c_nationkey, c_mktsegment, {duck.name('full_name')}, {duck.email('email')},
  {duck.phone('phone')}, {duck.ssn('ssn')}, {duck.ip('ip_address')}, {duck.location('address')}) AS line
FROM ({PEOPLE})
"""


def write_masked(spark, sf_dir):
    """Masked rows written and read back, with the count the write returned."""
    session = MaskedSession(spark, Policy(read_only=False, default_style="pseudonymize", seed=SEED))
    session.register("people", derived(spark, sf_dir, PEOPLE))
    path = scratch(spark, "people")
    written = write_with_count(session.sql("SELECT c_custkey, email, full_name FROM people"), path)
    return spark.read.parquet(path).withColumn("rows_written", F.lit(written).cast("bigint"))


QUERIES["write_with_count"] = write_masked
ORACLES["write_with_count"] = f"""
SELECT c_custkey, {duck.pseudonym('email', 'EMAIL_ADDRESS')} AS email,
  {duck.pseudonym('full_name', 'PERSON')} AS full_name, (SELECT count(*) FROM customer) AS rows_written
FROM ({PEOPLE})
"""


def stream_documents(spark, sf_dir):
    """Documents read as a stream, redacted, written once, and read back."""
    schema = table(spark, sf_dir, "documents").schema
    stream = (
        spark.readStream.schema(schema)
        .parquet(f"{sf_dir}/documents.parquet*")  # one file or a folder of them
        .select("doc_id", F.col("text").alias("body"), F.concat(F.col("source"), F.lit("@x.org")).alias("email"))
    )
    out, checkpoint = scratch(spark, "stream"), scratch(spark, "stream-state")
    query = write_stream(redact_stream(stream, Policy(), "posts"), out, checkpoint)
    query.awaitTermination()
    return spark.read.parquet(out)


QUERIES["stream_documents"] = stream_documents
ORACLES["stream_documents"] = (
    f"""SELECT doc_id, {duck.prose('text')} AS body, {duck.email("concat(source, '@x.org')")} AS email FROM documents"""
)

# A query log made from the events: reads and writes, in every letter case, with
# joins, qualified names, subqueries and quoted words.
_LOG = """
SELECT event_id, CASE event_id % 9
  WHEN 0 THEN concat('SELECT * FROM ', event_type, ' WHERE id = ', user_id)
  WHEN 1 THEN concat('select a.x from Web.', event_type, '_', user_id, ' a join Users u on a.id = u.id JOIN users v ON 1=1')
  WHEN 2 THEN concat('INSERT INTO ', event_type, ' SELECT * FROM raw_', event_type)
  WHEN 3 THEN concat('update ', event_type, ' set v = ', user_id)
  WHEN 4 THEN concat('SELECT updated_at, created, deleted FROM (SELECT * FROM ', event_type, ') t')
  WHEN 5 THEN concat('WITH x AS (SELECT 1) SELECT * FROM x LEFT JOIN s', user_id, '.', event_type, ' ON true')
  WHEN 6 THEN concat('Drop Table ', event_type)
  WHEN 7 THEN concat('SELECT ''please delete'' FROM ', event_type, ' JOIN ', event_type, ' ON 1 = 1')
  ELSE 'SELECT 1' END AS statement
FROM events
"""


def flag_writes(spark, sf_dir):
    log = derived(spark, sf_dir, _LOG.replace("''please delete''", '"please delete"'), "events")
    return log.select("event_id", writes_data(F.col("statement")).alias("is_write"))


QUERIES["flag_writes"] = flag_writes
ORACLES["flag_writes"] = rf"""
SELECT event_id, regexp_matches(statement,
  '(?i)\b(INSERT|UPDATE|DELETE|DROP|ALTER|TRUNCATE|CREATE|GRANT|REVOKE|COPY)\b') AS is_write
FROM ({_LOG})
"""


def hints_of_log(spark, sf_dir):
    log = derived(spark, sf_dir, _LOG.replace("''please delete''", '"please delete"'), "events")
    hints = table_hints(F.col("statement"))
    return log.select(
        "event_id",
        F.size(hints).alias("tables"),
        F.array_join(F.array_sort(hints), ",").alias("sorted_tables"),
        F.get(hints, 0).alias("first_table"),
    )


_NAMED = r"(?i)\b(?:FROM|JOIN)\b\s+([a-zA-Z_][a-zA-Z0-9_]*(?:\.[a-zA-Z_][a-zA-Z0-9_]*)?)"
QUERIES["table_hints"] = hints_of_log
ORACLES["table_hints"] = f"""
SELECT event_id, len(list_distinct(named))::int AS tables,
  array_to_string(list_sort(list_distinct(named)), ',') AS sorted_tables, named[1] AS first_table
FROM (SELECT event_id, list_transform(regexp_extract_all(statement, '{_NAMED}', 1),
        lambda n: CASE WHEN contains(n, '.') THEN lower(n) ELSE concat('public.', lower(n)) END) AS named
      FROM ({_LOG}))
"""


def hot_tables(spark, sf_dir):
    """How often each table is read and written, over the whole log."""
    log = derived(spark, sf_dir, _LOG.replace("''please delete''", '"please delete"'), "events")
    used = log.select(
        writes_data(F.col("statement")).alias("is_write"),
        F.explode(table_hints(F.col("statement"))).alias("table_key"),
    )
    return used.groupBy("table_key", "is_write").agg(F.count(F.lit(1)).alias("statements"))


QUERIES["tables_in_log"] = hot_tables
ORACLES["tables_in_log"] = rf"""
SELECT table_key, is_write, count(*) AS statements
FROM (SELECT regexp_matches(statement,
        '(?i)\b(INSERT|UPDATE|DELETE|DROP|ALTER|TRUNCATE|CREATE|GRANT|REVOKE|COPY)\b') AS is_write,
      unnest(list_distinct(list_transform(regexp_extract_all(statement, '{_NAMED}', 1),
        lambda n: CASE WHEN contains(n, '.') THEN lower(n) ELSE concat('public.', lower(n)) END))) AS table_key
      FROM ({_LOG}))
GROUP BY 1, 2
"""


# Statements as a log might hold them: hidden behind comments and quotes, or only looking like writes.
_STATEMENTS = """
SELECT event_id, CASE event_id % 14
  WHEN 0 THEN concat('SELECT * FROM ', event_type, ' WHERE note = ~drop table ', user_id, '~')
  WHEN 1 THEN concat('/* delete ', user_id, ' */ SELECT `insert` FROM ', event_type)
  WHEN 2 THEN concat('with x as (select 1) insert into ', event_type, ' select * from x')
  WHEN 3 THEN concat('SELECT 1 FROM t', user_id, ' -- c', chr(10), '; drop table ', event_type)
  WHEN 4 THEN concat('FROM ', event_type, ' |> WHERE id > ', user_id)
  WHEN 5 THEN concat('SELECT java_method(~a~, ', user_id, ')')
  WHEN 6 THEN concat('SELECT IDENTIFIER(~ref~ || ~lect~)(~a~, ', user_id, ')')
  WHEN 7 THEN concat('SELECT 1; SELECT ', user_id)
  WHEN 8 THEN concat('SELECT * FROM ', event_type, ' /* open ', user_id)
  WHEN 9 THEN concat('SET x = ', user_id)
  WHEN 10 THEN concat('SELECT updated_at, created FROM ', event_type, ' ;')
  WHEN 11 THEN concat('SELECT `reflect`(', user_id, ')')
  WHEN 12 THEN concat('(VALUES (', user_id, '))')
  ELSE concat('select transform(v) using ~cat~ from ', event_type) END AS statement
FROM events
"""


def gate_log(spark, sf_dir):
    log = derived(spark, sf_dir, _STATEMENTS, "events").withColumn("statement", F.translate("statement", "~", "'"))
    return log.select("event_id", refused_as(F.col("statement")).alias("refused"))


QUERIES["gate_log"] = gate_log
ORACLES["gate_log"] = rf"""
WITH log AS (SELECT event_id, replace(statement, '~', chr(39)) AS s FROM ({_STATEMENTS})),
bare AS (SELECT event_id, s, regexp_replace(s, '--[^\r\n]*|/\*[^*]*\*+([^/*][^*]*\*+)*/|''[^'']*''|`[^`]*`', '#', 'g') AS b FROM log)
SELECT event_id, CASE
  WHEN regexp_matches(b, '(?i)\b(insert|update|delete|drop|alter|truncate|create|grant|revoke|copy|merge)\b') THEN 'write'
  WHEN regexp_matches(b, '(?i)\b(java_method|reflect)\s*\(|\btransform\b.*\busing\b|\bidentifier\s*\([^()]*\)\s*\(') OR contains(s, '`reflect`') THEN 'code'
  WHEN regexp_matches(b, ';\s*[^\s;]') THEN 'several'
  WHEN contains(b, '/*') THEN 'open'
  WHEN NOT regexp_matches(b, '(?i)^[\s(#]*(select|from|with|values|table|show|describe|desc|explain)\b') THEN 'other' END AS refused
FROM bare"""


def rendered_with_header(spark, sf_dir):
    """A result as text, line by line: what is masked, what is revealed, how many rows, then the rows up to the cap."""
    session = MaskedSession(spark, Policy(max_rows=200)).register("people", derived(spark, sf_dir, PEOPLE))
    sql = "SELECT c_custkey, email AS contact, phone, ssn, c_mktsegment FROM people ORDER BY c_custkey"
    lines = session.query(sql, reveal_types=["PHONE_NUMBER"]).split("\n")
    return spark.createDataFrame(list(enumerate(lines)), "place long, line string")


QUERIES["rendered_with_header"] = rendered_with_header
ORACLES["rendered_with_header"] = f"""
WITH people AS ({PEOPLE}), shown AS (
  SELECT row_number() OVER (ORDER BY c_custkey) AS n, c_custkey, email, phone, ssn, c_mktsegment FROM people),
heads(place, line) AS (SELECT 0, 'PII masked: contact (MASKED: EMAIL_ADDRESS), ssn (MASKED: US_SSN)'
  UNION ALL SELECT 1, 'Revealed: phone'
  UNION ALL SELECT 2, concat(least(count(*), 200), ' rows', CASE WHEN count(*) > 200 THEN ' (truncated)' ELSE '' END) FROM people
  UNION ALL SELECT 3, '' UNION ALL SELECT 4, '| c_custkey | contact | phone | ssn | c_mktsegment |'
  UNION ALL SELECT 5, '| --- | --- | --- | --- | --- |')
SELECT place::bigint AS place, line FROM heads
UNION ALL SELECT n + 5, concat('| ', c_custkey, ' | ', {duck.email('email')}, ' | ', phone, ' | ', {duck.ssn('ssn')}, ' | ', c_mktsegment, ' |')
FROM shown WHERE n <= 200
"""
