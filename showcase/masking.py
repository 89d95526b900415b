"""Scalar masks over derived customer columns, and pseudonyms over the big tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from veilframe.functions import masks
from veilframe.operators.pseudonyms import unique_pseudonyms

from . import duck
from .inputs import PEOPLE, SEED, VARIANTS, derived, scratch, table

QUERIES = {}
ORACLES = {}

_SCALARS = {
    "mask_email": ("EMAIL_ADDRESS", "email", duck.email),
    "mask_phone": ("PHONE_NUMBER", "digits", duck.phone),
    "mask_ssn": ("US_SSN", "digits", duck.ssn),
    "mask_name": ("PERSON", "person", duck.name),
    "mask_card": ("CREDIT_CARD", "digits", duck.card),
    "mask_ip": ("IP_ADDRESS", "ip", duck.ip),
    "mask_location": ("LOCATION", "place", duck.location),
    "mask_financial": ("FINANCIAL", "digits", duck.financial),
    "mask_generic": ("DATE_TIME", "person", duck.generic),
}


def _scalar(entity, column):
    def run(spark, sf_dir):
        return derived(spark, sf_dir, VARIANTS).select(
            "c_custkey", masks.mask(F.col(column), entity).alias("masked")
        )

    return run


for _name, (_entity, _column, _sql) in _SCALARS.items():
    QUERIES[_name] = _scalar(_entity, _column)
    ORACLES[_name] = (
        f"SELECT c_custkey, {duck.keep(_column, _sql(_column))} AS masked FROM ({VARIANTS})"
    )

_TYPES = {
    "email": "EMAIL_ADDRESS",
    "phone": "PHONE_NUMBER",
    "ssn": "US_SSN",
    "full_name": "PERSON",
    "card_number": "CREDIT_CARD",
    "ip_address": "IP_ADDRESS",
    "address": "LOCATION",
    "account_number": "FINANCIAL",
}


def _all_types(style):
    def run(spark, sf_dir):
        people = derived(spark, sf_dir, PEOPLE)
        return people.select(
            "c_custkey",
            *[masks.mask(F.col(c), e, style, SEED).alias(c) for c, e in _TYPES.items()],
        )

    return run


QUERIES["mask_full"] = _all_types("full")
ORACLES["mask_full"] = (
    "SELECT c_custkey, "
    + ", ".join(f"'[{e.replace('_', ' ')}]' AS {c}" for c, e in _TYPES.items())
    + f" FROM ({PEOPLE})"
)
QUERIES["pseudonymize_all_types"] = _all_types("pseudonymize")
ORACLES["pseudonymize_all_types"] = (
    "SELECT c_custkey, "
    + ", ".join(f"{duck.pseudonym(c, e)} AS {c}" for c, e in _TYPES.items())
    + f" FROM ({PEOPLE})"
)

_STYLES = ("partial", "full", "pseudonymize", "none")


def mask_secret(spark, sf_dir):
    people = derived(spark, sf_dir, PEOPLE)
    value = F.when(F.col("c_custkey") % 3 > 0, F.col("encrypted_password"))
    return people.select(
        "c_custkey", *[masks.mask(value, "SECRET", s, SEED).alias(f"secret_{s}") for s in _STYLES]
    )


QUERIES["mask_secret"] = mask_secret
ORACLES["mask_secret"] = (
    "SELECT c_custkey, "
    + ", ".join(f"CASE WHEN c_custkey % 3 > 0 THEN '[REDACTED]' END AS secret_{s}" for s in _STYLES)
    + f" FROM ({PEOPLE})"
)

_SPARSE = """
SELECT c_custkey, CASE c_custkey % 4 WHEN 0 THEN NULL WHEN 1 THEN '' WHEN 2 THEN '    ' ELSE c_name END AS value
FROM customer
"""


def mask_null_blank(spark, sf_dir):
    value = F.col("value")
    return derived(spark, sf_dir, _SPARSE).select(
        "c_custkey",
        *[masks.mask(value, "PERSON", s, SEED).alias(f"person_{s}") for s in _STYLES],
        masks.mask(value, "SECRET").alias("secret"),
        masks.mask(value, "EMAIL_ADDRESS", "unheard_of").alias("unknown_style"),
    )


QUERIES["mask_null_blank"] = mask_null_blank
ORACLES["mask_null_blank"] = f"""
SELECT c_custkey, {duck.keep('value', duck.name('value'))} AS person_partial,
  {duck.keep('value', "'[PERSON]'")} AS person_full,
  {duck.keep('value', duck.pseudonym('value', 'PERSON'))} AS person_pseudonymize,
  value AS person_none, {duck.keep('value', "'[REDACTED]'")} AS secret,
  {duck.keep('value', duck.email('value'))} AS unknown_style
FROM ({_SPARSE})
"""

_KINDS = (
    ("EMAIL_ADDRESS", duck.email),
    ("PHONE_NUMBER", duck.phone),
    ("US_SSN", duck.ssn),
    ("PERSON", duck.name),
    ("CREDIT_CARD", duck.card),
    ("IP_ADDRESS", duck.ip),
    ("LOCATION", duck.location),
    ("FINANCIAL", duck.financial),
    ("US_PASSPORT", duck.generic),
    ("SECRET", lambda x: "'[REDACTED]'"),
)
_MIXED = (
    "SELECT o_orderkey, concat(o_orderkey, ' ', o_orderpriority, '@', o_orderstatus, '.', o_custkey) AS value, "
    "CASE o_orderkey % 10 "
    + " ".join(f"WHEN {i} THEN '{e}'" for i, (e, _) in enumerate(_KINDS))
    + " END AS kind FROM orders"
)


def mask_by_row_type(spark, sf_dir):
    mixed = derived(spark, sf_dir, _MIXED, "orders")
    value, kind = F.col("value"), F.col("kind")
    return mixed.select(
        "o_orderkey",
        "kind",
        masks.mask_by_entity(value, kind).alias("masked"),
        masks.mask_by_entity(value, kind, "full").alias("labelled"),
        masks.mask_by_entity(value, kind, "pseudonymize", SEED).alias("pseudonym"),
    )


def _case(build):
    return "CASE kind " + " ".join(f"WHEN '{e}' THEN {build(e, sql)}" for e, sql in _KINDS) + " END"


QUERIES["mask_by_row_type"] = mask_by_row_type
ORACLES["mask_by_row_type"] = (
    "SELECT o_orderkey, kind, "
    + _case(lambda e, sql: sql("value"))
    + " AS masked, "
    + _case(lambda e, _: "'[REDACTED]'" if e == "SECRET" else f"'[{e.replace('_', ' ')}]'")
    + " AS labelled, "
    + _case(lambda e, _: "'[REDACTED]'" if e == "SECRET" else duck.pseudonym("value", e))
    + f" AS pseudonym FROM ({_MIXED})"
)


def pseudonym_orders(spark, sf_dir):
    """Pseudonyms keep equality, so they group like the raw key."""
    orders = table(spark, sf_dir, "orders")
    who = masks.mask(F.col("o_custkey"), "PERSON_ID", "pseudonymize", SEED)
    return (
        orders.groupBy(who.alias("customer"))
        .agg(F.count(F.lit(1)).alias("orders"), F.max("o_orderkey").alias("last_order"))
    )


QUERIES["pseudonym_orders"] = pseudonym_orders
ORACLES["pseudonym_orders"] = f"""
SELECT {duck.pseudonym("o_custkey::varchar", "PERSON_ID")} AS customer, count(*) AS orders,
  max(o_orderkey) AS last_order
FROM orders GROUP BY 1
"""


def pseudonym_join(spark, sf_dir):
    """Two tables pseudonymised apart still join on the pseudonym, as far as it is unique."""
    people = table(spark, sf_dir, "customer").select(
        masks.mask(F.col("c_custkey"), "CUSTOMER", "pseudonymize", SEED).alias("who"), "c_mktsegment"
    )
    orders = table(spark, sf_dir, "orders").select(
        masks.mask(F.col("o_custkey"), "CUSTOMER", "pseudonymize", SEED).alias("who"), "o_orderkey"
    )
    joined = orders.join(people, "who")
    return joined.groupBy("c_mktsegment").agg(
        F.count(F.lit(1)).alias("orders"), F.countDistinct("who").alias("customers")
    )


QUERIES["pseudonym_join"] = pseudonym_join
ORACLES["pseudonym_join"] = f"""
SELECT c_mktsegment, count(*) AS orders, count(DISTINCT c.who) AS customers
FROM (SELECT {duck.pseudonym("o_custkey::varchar", "CUSTOMER")} AS who FROM orders) o
JOIN (SELECT c_mktsegment, {duck.pseudonym("c_custkey::varchar", "CUSTOMER")} AS who FROM customer) c
  ON o.who = c.who
GROUP BY 1
"""


def mask_words_of_documents(spark, sf_dir):
    """The name mask over whole documents, every word of them."""
    text = F.col("text")
    return table(spark, sf_dir, "documents").select(
        "doc_id",
        masks.mask(text, "PERSON").alias("words"),
        F.length(masks.mask(text, "OTHER")).cast("bigint").alias("generic_chars"),
    )


QUERIES["mask_words_of_documents"] = mask_words_of_documents
ORACLES["mask_words_of_documents"] = f"""
SELECT doc_id, {duck.keep('text', duck.name('text'))} AS words,
  length({duck.keep('text', duck.generic('text'))}) AS generic_chars
FROM documents
"""


_OWNED = """SELECT o_orderkey, lpad(cast(o_orderkey AS string), 9, '0') AS ssn,
  concat('555', lpad(cast(o_custkey AS string), 7, '0')) AS phone,
  CASE WHEN o_orderkey % 3 = 0 THEN 'desk@example.com' ELSE concat('u', o_custkey, '@example.com') END AS email
FROM orders"""
_UNIQUE = {"ssn": ("US_SSN", "000-00-", 4, ""), "phone": ("PHONE_NUMBER", "555-000-", 4, ""), "email": ("EMAIL_ADDRESS", "user_", 8, "@masked.invalid")}


def pseudonym_unique(spark, sf_dir):
    """One pseudonym for each value: more digits where four are too few, a third of all rows one address."""
    owned = derived(spark, sf_dir, _OWNED, "orders")
    return unique_pseudonyms(owned, {c: form[0] for c, form in _UNIQUE.items()}, SEED, folder=scratch(spark, "numbers"))


def _numbered(column):
    _, before, digits, after = _UNIQUE[column]
    number = f"dense_rank() OVER (ORDER BY sha256(concat('{SEED}:', {column}))) - 1"
    return f"concat('{before}', lpad(printf('%x', {number}), greatest({digits}, length(printf('%x', {number})))::int, '0'), '{after}') AS {column}"


QUERIES["pseudonym_unique"] = pseudonym_unique
ORACLES["pseudonym_unique"] = f"SELECT o_orderkey, {', '.join(map(_numbered, _UNIQUE))} FROM ({_OWNED})"


def pseudonym_unique_counts(spark, sf_dir):
    """As many different pseudonyms as values, and each pair of them once."""
    owned = derived(spark, sf_dir, _OWNED, "orders").withColumns({f"{c}_was": F.col(c) for c in _UNIQUE})
    new = unique_pseudonyms(owned, {c: form[0] for c, form in _UNIQUE.items()}, SEED, folder=scratch(spark, "numbers"))
    return new.agg(*[F.count_distinct(*columns).alias(name) for c in _UNIQUE for name, columns in ((c, [c]), (f"{c}_pairs", [c, f"{c}_was"]))])


QUERIES["pseudonym_unique_counts"] = pseudonym_unique_counts
ORACLES["pseudonym_unique_counts"] = f"SELECT {', '.join(f'count(DISTINCT {c}) AS {c}, count(DISTINCT {c}) AS {c}_pairs' for c in _UNIQUE)} FROM ({_OWNED})"
