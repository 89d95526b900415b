"""Structs, arrays, maps, variants and JSON text of unknown shape."""

from __future__ import annotations

from pyspark.sql import functions as F

from veilframe import MaskedSession, Policy, Rule, mask_json_text, redact, write_with_count
from veilframe.sources.readers import spread
from . import duck
from .inputs import CONTACT_JSON, PEOPLE, SEED, dealt, derived, scratch, table

QUERIES = {}
ORACLES = {}

_TYPED = """
SELECT c_custkey,
  named_struct('email', email, 'tier', c_mktsegment,
    'contact', named_struct('phone', phone, 'otp_secret', encrypted_password, 'balance', c_acctbal)) AS profile,
  map('ssn', ssn, 'note', concat('call ', phone, ' now'), 'segment', c_mktsegment, 'unlock_token', ssn) AS attrs,
  array(named_struct('full_name', full_name, 'address', address), named_struct('full_name', email, 'address', c_mktsegment)) AS history,
  array(email, c_mktsegment, concat('host ', ip_address, ', mail ', email)) AS tags
FROM people
"""


def _typed(spark, sf_dir):
    derived(spark, sf_dir, PEOPLE).createOrReplaceTempView("people")
    return spark.sql(_TYPED)


def mask_struct(spark, sf_dir):
    out = redact(_typed(spark, sf_dir).select("c_custkey", "profile"), Policy())
    return out.select("c_custkey", "profile.email", "profile.tier", "profile.contact.*")


QUERIES["mask_struct"] = mask_struct
ORACLES["mask_struct"] = f"""
SELECT c_custkey, {duck.email('email')} AS email, c_mktsegment AS tier, {duck.phone('phone')} AS phone,
  '[REDACTED]' AS otp_secret, c_acctbal AS balance FROM ({PEOPLE})
"""


def mask_struct_revealed(spark, sf_dir):
    """A revealed JSON-like column still hides the secrets inside it."""
    typed = _typed(spark, sf_dir).select("c_custkey", "profile")
    out = redact(typed, Policy(), reveal_columns=["profile"])
    return out.select("c_custkey", "profile.email", "profile.tier", "profile.contact.*")


QUERIES["mask_struct_revealed"] = mask_struct_revealed
ORACLES["mask_struct_revealed"] = f"""
SELECT c_custkey, email, c_mktsegment AS tier, phone, '[REDACTED]' AS otp_secret, c_acctbal AS balance
FROM ({PEOPLE})
"""


def mask_map(spark, sf_dir):
    out = redact(_typed(spark, sf_dir).select("c_custkey", "attrs"), Policy())
    return out.select("c_custkey", *[F.col("attrs")[k].alias(k) for k in ("ssn", "note", "segment", "unlock_token")])


QUERIES["mask_map"] = mask_map
ORACLES["mask_map"] = f"""
SELECT c_custkey, {duck.ssn('ssn')} AS ssn, 'call [PHONE NUMBER] now' AS note, c_mktsegment AS segment,
  '[REDACTED]' AS unlock_token FROM ({PEOPLE})
"""


def mask_array(spark, sf_dir):
    policy = Policy(rules=(Rule("people", "tags", "FREE_TEXT"),))
    out = redact(_typed(spark, sf_dir).select("c_custkey", "history", "tags"), policy, ["people"])
    return out.select(
        "c_custkey",
        F.posexplode("history").alias("i", "h"),
        "tags",
    ).select("c_custkey", "i", "h.full_name", "h.address", F.array_join("tags", "|").alias("tags"))


QUERIES["mask_array"] = mask_array
ORACLES["mask_array"] = f"""
SELECT c_custkey, i, {duck.name('n')} AS full_name, {duck.location('a')} AS address,
  concat('[EMAIL ADDRESS]|', c_mktsegment, '|host [IP ADDRESS], mail [EMAIL ADDRESS]') AS tags
FROM (SELECT *, 0 AS i, full_name AS n, address AS a FROM ({PEOPLE})
      UNION ALL SELECT *, 1 AS i, email AS n, c_mktsegment AS a FROM ({PEOPLE}))
"""

def nested_lineage(spark, sf_dir):
    """Fields taken out of structs under neutral names, from files tagged when read."""
    path = scratch(spark, "profiles")
    write_with_count(_typed(spark, sf_dir), path)
    policy = Policy(rules=(Rule("public.profiles.profile", "tier", "PERSON"),))
    session = MaskedSession(spark, policy).register_files("profiles", path)
    return session.sql(
        "SELECT c_custkey, profile.email AS a, profile.contact.phone AS b, profile.contact.otp_secret AS c, "
        "profile.tier AS d, h.address AS e FROM profiles LATERAL VIEW explode(history) v AS h"
    )


QUERIES["redact_nested_lineage"] = nested_lineage
ORACLES["redact_nested_lineage"] = f"""
SELECT c_custkey, {duck.email('email')} AS a, {duck.phone('phone')} AS b, '[REDACTED]' AS c,
  {duck.name('c_mktsegment')} AS d, {duck.location('h')} AS e
FROM (SELECT *, address AS h FROM ({PEOPLE}) UNION ALL SELECT *, c_mktsegment AS h FROM ({PEOPLE}))
"""

_PATHS = {
    "email": "$.email",
    "tier": "$.tier",
    "phone": "$.contact.phone",
    "first_name": "$.contact.first_name",
    "otp_secret": "$.contact.otp_secret",
    "tag0": "$.tags[0]",
    "tag1": "$.tags[1]",
    "ssn": "$.ssn",
    "note": "$.note",
    "ok": "$.ok",
    "none": "$.none",
}


def _leaves(df, column):
    return df.select(
        "c_custkey", *[F.get_json_object(column, p).alias(name) for name, p in _PATHS.items()]
    )


def _duck_leaves(wrap):
    raw = (
        "SELECT c_custkey, "
        + ", ".join(f"json_extract_string(data, '{p}') AS \"{n}\"" for n, p in _PATHS.items())
        + f" FROM ({CONTACT_JSON})"
    )
    shown = ", ".join(f'{wrap.get(n, n)} AS "{n}"' for n in _PATHS)
    return f"SELECT c_custkey, {shown} FROM ({raw})"


_MASKED = {
    "email": duck.email("email"),
    "phone": duck.phone("phone"),
    "first_name": duck.name("first_name"),
    "otp_secret": "'[REDACTED]'",
    "tag1": duck.prose("tag1"),
    "note": duck.prose("note"),
}


def json_text(spark, sf_dir):
    data = dealt(spark, sf_dir, CONTACT_JSON)
    return _leaves(data.select("c_custkey", mask_json_text(F.col("data")).alias("data")), "data")


QUERIES["mask_json_text"] = json_text
ORACLES["mask_json_text"] = _duck_leaves(_MASKED)


def json_text_pseudonymized(spark, sf_dir):
    masked = mask_json_text(
        F.col("data"), "pseudonymize", SEED, reveal_types=["PERSON"], mask_scalars=True
    )
    data = dealt(spark, sf_dir, CONTACT_JSON)
    return _leaves(data.select("c_custkey", masked.alias("data")), "data")


QUERIES["mask_json_text_pseudonymized"] = json_text_pseudonymized
ORACLES["mask_json_text_pseudonymized"] = _duck_leaves(
    {
        "email": duck.pseudonym("email", "EMAIL_ADDRESS"),
        "phone": duck.pseudonym("phone", "PHONE_NUMBER"),
        "otp_secret": "'[REDACTED]'",
        "tag1": duck.prose("tag1", duck.hit_pseudonym),
        "note": duck.prose("note", duck.hit_pseudonym),
        "ssn": duck.pseudonym("ssn", "US_SSN"),
    }
)


def json_column_by_rule(spark, sf_dir):
    """A JSON text column declared by rule, read through SQL."""
    session = MaskedSession(spark, Policy(rules=(Rule("profiles", "data", "JSON_CONTAINER"),)))
    session.register("profiles", dealt(spark, sf_dir, CONTACT_JSON))
    return _leaves(session.sql("SELECT c_custkey, data AS d FROM profiles"), "d")


QUERIES["json_column_by_rule"] = json_column_by_rule
ORACLES["json_column_by_rule"] = _duck_leaves(_MASKED)


def mask_variant(spark, sf_dir):
    data = dealt(spark, sf_dir, CONTACT_JSON).select("c_custkey", F.parse_json("data").alias("v"))
    out = redact(data, Policy())
    return out.select(
        "c_custkey",
        F.variant_get("v", "$.email", "string").alias("email"),
        F.variant_get("v", "$.contact.otp_secret", "string").alias("otp_secret"),
        F.variant_get("v", "$.tags[1]", "string").alias("tag1"),
        F.variant_get("v", "$.ssn", "bigint").alias("ssn"),
    )


QUERIES["mask_variant"] = mask_variant
ORACLES["mask_variant"] = f"""
SELECT c_custkey, email, otp_secret, tag1, ssn::bigint AS ssn FROM ({_duck_leaves(_MASKED)})
"""

# Some of it is JSON, some of it only looks like JSON, some is prose.
_MIXED = f"""
SELECT c_custkey, CASE c_custkey % 5 WHEN 0 THEN data WHEN 1 THEN concat(data, ' and ', data)
  WHEN 2 THEN concat('seen at 10.0.0.', c_custkey % 256, ', wrote to m', c_custkey, '@x.org')
  WHEN 3 THEN NULL ELSE '' END AS data FROM ({CONTACT_JSON})
"""


def json_or_prose(spark, sf_dir):
    data = dealt(spark, sf_dir, _MIXED).select("c_custkey", mask_json_text(F.col("data")).alias("d"))
    return data.select(
        "c_custkey",
        F.when(F.col("c_custkey") % 5 == 0, F.get_json_object("d", "$.email"))
        .otherwise(F.col("d"))
        .alias("shown"),
    )


QUERIES["json_or_prose"] = json_or_prose
ORACLES["json_or_prose"] = f"""
SELECT c_custkey, CASE WHEN c_custkey % 5 = 0 THEN {duck.email("json_extract_string(data, '$.email')")}
  ELSE {duck.prose('data')} END AS shown
FROM ({_MIXED})
"""


def json_events(spark, sf_dir):
    """Clean JSON passes untouched; keys come from the event type."""
    events = spread(table(spark, sf_dir, "events")).select(
        "event_id",
        "props",
        F.concat(
            F.lit('{"'), F.col("event_type"), F.lit('_email": "u'), F.col("user_id"),
            F.lit('@x.org", "props": '), F.col("props"), F.lit("}"),
        ).alias("payload"),
    )
    policy = Policy(rules=(Rule("events", "props", "JSON_CONTAINER"), Rule("events", "payload", "JSON_CONTAINER")))
    return redact(events, policy, ["events"])


QUERIES["mask_json_events"] = json_events
ORACLES["mask_json_events"] = """
SELECT event_id, props, concat('{"', event_type, '_email": "u***@x***.org", "props": ', props, '}') AS payload
FROM events
"""


def secret_containers(spark, sf_dir):
    """A rule or a name that says secret hides a struct, map or array as a whole."""
    derived(spark, sf_dir, PEOPLE).createOrReplaceTempView("people")
    more = ", map('a', ssn, 'b', c_mktsegment) AS otp_secret, array(ssn, NULL) AS unlock_token FROM people"
    typed = spark.sql(_TYPED.replace("FROM people", more))
    policy = Policy(rules=(Rule("people", "profile", "SECRET"), Rule("people", "attrs", "PERSON")))
    out = redact(typed, policy, ["people"])
    status = ",".join(f"{f.name}:{f.metadata.get('redaction', '')}" for f in out.schema.fields[1:])
    return out.select(
        "c_custkey", "profile", F.col("attrs")["segment"].alias("segment"), "otp_secret",
        F.array_join("unlock_token", "|", "-").alias("unlock_token"), F.lit(status).alias("status"),
    )


QUERIES["secret_containers"] = secret_containers
ORACLES["secret_containers"] = f"""
SELECT c_custkey, '[REDACTED]' AS profile, {duck.name('c_mktsegment')} AS segment, '[REDACTED]' AS otp_secret,
  '[REDACTED]|-' AS unlock_token,
  'profile:MASKED: SECRET,attrs:MASKED: PERSON,history:MASKED: JSON_CONTAINER,tags:,otp_secret:MASKED: SECRET,unlock_token:MASKED: SECRET' AS status
FROM ({PEOPLE})
"""

_SECRET_JSON = """
SELECT c_custkey, concat('{"otp_secret": [', c_custkey, ', {"a": "', ssn, '"}], "n": ', c_custkey,
  ', "unlock_token": ', c_custkey, ', "deep": {"encrypted_keys": {"k": "', ssn, '"}}, "tier": "', c_mktsegment, '"}') AS doc,
  c_mktsegment, ssn
FROM people
"""


def secret_json_values(spark, sf_dir):
    """Arrays, objects and numbers behind secret keys: in text, in a variant, in a typed struct."""
    dealt(spark, sf_dir, PEOPLE).createOrReplaceTempView("people")
    docs = spark.sql(_SECRET_JSON)
    typed = docs.select(
        "c_custkey",
        mask_json_text(F.col("doc")).alias("doc"),
        F.parse_json("doc").alias("v"),
        F.struct(F.array("ssn").alias("otp_secret"), F.col("c_custkey").alias("unlock_token"), F.col("c_mktsegment").alias("tier")).alias("s"),
        F.create_map(F.lit("reset_password_token"), F.array("c_custkey"), F.lit("n"), F.array("c_custkey")).alias("m"),
    )
    out = redact(typed, Policy())
    return out.select(
        "c_custkey", "doc", F.variant_get("v", "$.otp_secret", "string").alias("v_otp"),
        F.variant_get("v", "$.deep.encrypted_keys", "string").alias("v_keys"), F.variant_get("v", "$.n", "bigint").alias("v_n"),
        F.col("s.otp_secret")[0].alias("s_otp"), F.col("s.unlock_token").alias("s_token"), F.col("s.tier").alias("s_tier"),
        F.col("m")["reset_password_token"].isNull().alias("m_hidden"), F.col("m")["n"][0].alias("m_n"),
    )


QUERIES["secret_json_values"] = secret_json_values
ORACLES["secret_json_values"] = f"""
SELECT c_custkey, concat('{{"otp_secret": "[REDACTED]", "n": ', c_custkey, ', "unlock_token": "[REDACTED]", "deep": ',
    '{{"encrypted_keys": "[REDACTED]"}}, "tier": "', c_mktsegment, '"}}') AS doc,
  '[REDACTED]' AS v_otp, '[REDACTED]' AS v_keys, c_custkey AS v_n, '[REDACTED]' AS s_otp, NULL::bigint AS s_token,
  c_mktsegment AS s_tier, true AS m_hidden, c_custkey AS m_n
FROM ({PEOPLE})
"""
