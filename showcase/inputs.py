"""Tables with personal columns, derived from the sample tables.

No sample table has a column with a personal name, so the inputs are derived with
SQL that Spark and DuckDB both run as it stands.
"""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame, SparkSession

from veilframe import tune
from veilframe.sources.readers import spread
from veilframe.sources.writers import shared_folder

SEED = "showcase"

PEOPLE = """
SELECT c_custkey, c_nationkey, c_acctbal, c_mktsegment,
  c_name AS full_name,
  concat('user', c_custkey, '@mail', c_nationkey, '.example.com') AS email,
  concat('(555) ', lpad(cast(c_custkey % 1000 AS string), 3, '0'), '-',
         lpad(cast(c_custkey AS string), 4, '0')) AS phone,
  lpad(cast(c_custkey AS string), 9, '0') AS ssn,
  lpad(cast(c_custkey AS string), 16, '0') AS card_number,
  lpad(cast(c_custkey AS string), 10, '0') AS account_number,
  concat('10.0.', c_nationkey, '.', c_custkey % 256) AS ip_address,
  concat(c_custkey, ' Main St') AS address,
  md5(c_name) AS encrypted_password
FROM customer
"""

# Every mask meets well-formed, odd, missing and blank values.
VARIANTS = """
SELECT c_custkey,
  CASE c_custkey % 9
    WHEN 0 THEN c_name
    WHEN 1 THEN concat('@host', c_nationkey, '.com')
    WHEN 2 THEN concat('a', c_custkey, '@b')
    WHEN 3 THEN concat('x', c_nationkey, '@.com')
    WHEN 4 THEN concat('first.last', c_custkey, '@sub.mail', c_nationkey, '.example.org')
    WHEN 5 THEN concat('two@at', c_nationkey, '@signs.net')
    WHEN 6 THEN NULL
    WHEN 7 THEN '   '
    ELSE '@' END AS email,
  CASE c_custkey % 7
    WHEN 0 THEN concat('555-', lpad(cast(c_custkey % 1000 AS string), 3, '0'), '-4567')
    WHEN 1 THEN concat('+1 (555) ', c_custkey)
    WHEN 2 THEN cast(c_custkey % 1000 AS string)
    WHEN 3 THEN concat('ext. ', c_nationkey)
    WHEN 4 THEN ''
    WHEN 5 THEN NULL
    ELSE cast(c_custkey * 7919 AS string) END AS digits,
  CASE c_custkey % 7
    WHEN 0 THEN c_name
    WHEN 1 THEN concat('Ann ', c_mktsegment, ' ', c_custkey)
    WHEN 2 THEN concat('  J  Q   ', c_mktsegment, ' ')
    WHEN 3 THEN 'X'
    WHEN 4 THEN concat('Zoë Ål', c_custkey)
    WHEN 5 THEN NULL
    ELSE ' ' END AS person,
  CASE c_custkey % 6
    WHEN 0 THEN concat('10.', c_nationkey, '.1.', c_custkey % 256)
    WHEN 1 THEN concat('1.2.3.4.', c_nationkey)
    WHEN 2 THEN concat('fe80::', c_custkey)
    WHEN 3 THEN 'a.b.c.'
    WHEN 4 THEN NULL
    ELSE '' END AS ip,
  CASE c_custkey % 5
    WHEN 0 THEN concat(c_custkey, ' Main St ', c_nationkey)
    WHEN 1 THEN concat(c_mktsegment, ' Street')
    WHEN 2 THEN cast(c_custkey AS string)
    WHEN 3 THEN NULL
    ELSE ' ' END AS place
FROM customer
"""

CONTACT_JSON = """
SELECT c_custkey,
  concat('{"email": "user', c_custkey, '@mail', c_nationkey, '.example.com", "tier": "', c_mktsegment,
    '", "contact": {"phone": "555-', lpad(cast(c_custkey % 1000 AS string), 3, '0'),
    '-4567", "first_name": "Ann ', c_mktsegment, '", "otp_secret": "s', c_custkey,
    '"}, "tags": ["vip ', c_nationkey, '", "write to t', c_custkey, '@x.org"], "ssn": ', c_custkey,
    ', "note": "call (555) 123-', lpad(cast(c_custkey % 10000 AS string), 4, '0'),
    '", "balance": ', c_nationkey, '.50, "ok": true, "none": null}') AS data
FROM customer
"""


def load(spark: SparkSession, sf_dir: str, *names: str) -> None:
    """Register sample tables as views."""
    for name in names:
        table(spark, sf_dir, name).createOrReplaceTempView(name)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A sample table."""
    return tune(spark).read.parquet(f"{sf_dir}/{name}.parquet")


def derived(spark: SparkSession, sf_dir: str, sql: str, *names: str) -> DataFrame:
    """A derived input; reads ``customer`` unless other tables are named."""
    load(spark, sf_dir, *(names or ("customer",)))
    return spark.sql(sql)


def dealt(spark: SparkSession, sf_dir: str, sql: str) -> DataFrame:
    """``derived`` from ``customer`` for masks that are dear per row: every core gets some of the rows."""
    spread(table(spark, sf_dir, "customer")).createOrReplaceTempView("customer")
    return spark.sql(sql)


def scratch(spark: SparkSession, purpose: str) -> str:
    """A fresh shared path; on one machine without a shared folder, a local one."""
    if spark.sparkContext.master.startswith("local") and not (
        spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    ):
        return shared_folder(spark, purpose, tempfile.mkdtemp(prefix="veilframe-"))
    return shared_folder(spark, purpose)
