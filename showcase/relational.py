"""Masked SQL: what redaction does to each family of queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from veilframe import MaskedSession, Policy, Rule, redact, write_with_count
from veilframe.operators.asof import asof_join
from veilframe.sources.readers import policy_from_rules, read_rules

from . import duck
from .inputs import PEOPLE, SEED, derived, scratch, table

QUERIES = {}
ORACLES = {}


def _session(spark, sf_dir, *names, policy=None, mask_at="output"):
    session = MaskedSession(spark, policy or Policy(), mask_at)
    session.register("people", derived(spark, sf_dir, PEOPLE))
    for name in names:
        session.register(name, table(spark, sf_dir, name))
    return session


def _add(name, sql, oracle, tables=(), policy=None, mask_at="output", **reveal):
    def run(spark, sf_dir):
        return _session(spark, sf_dir, *tables, policy=policy, mask_at=mask_at).sql(sql, **reveal)

    QUERIES[name] = run
    ORACLES[name] = f"WITH people AS ({PEOPLE}) {oracle}"


_add(
    "redact_projection",
    "SELECT c_custkey, full_name, email, c_acctbal FROM people",
    f"SELECT c_custkey, {duck.name('full_name')} AS full_name, {duck.email('email')} AS email, c_acctbal FROM people",
)

_add(
    "redact_all_columns",
    "SELECT * FROM people",
    f"""SELECT c_custkey, c_nationkey, c_acctbal, c_mktsegment, {duck.name('full_name')} AS full_name,
      {duck.email('email')} AS email, {duck.phone('phone')} AS phone, {duck.ssn('ssn')} AS ssn,
      {duck.card('card_number')} AS card_number, {duck.financial('account_number')} AS account_number,
      {duck.ip('ip_address')} AS ip_address, {duck.location('address')} AS address,
      '[REDACTED]' AS encrypted_password FROM people""",
)

# The tag follows a column through an alias with an innocent name.
_add(
    "redact_renamed",
    "SELECT c_custkey AS k, email AS x, phone AS y, upper(email) AS loud, upper(phone) AS phone_upper FROM people",
    f"""SELECT c_custkey AS k, {duck.email('email')} AS x, {duck.phone('phone')} AS y, {duck.email('upper(email)')} AS loud,
      {duck.phone('upper(phone)')} AS phone_upper FROM people""",
)

_JOIN = """FROM people p JOIN orders o ON p.c_custkey = o.o_custkey
JOIN nation n ON n.n_nationkey = p.c_nationkey"""
_add(
    "redact_join",
    f"SELECT o.o_orderkey, p.full_name, p.email AS contact, n.n_name, o.o_totalprice {_JOIN}",
    f"""SELECT o.o_orderkey, {duck.name('p.full_name')} AS full_name, {duck.email('p.email')} AS contact,
      n.n_name, o.o_totalprice {_JOIN}""",
    ("orders", "nation"),
)

_add(
    "redact_left_join",
    "SELECT p.c_custkey, o.o_orderkey, p.phone FROM people p LEFT JOIN orders o ON p.c_custkey = o.o_custkey AND o.o_orderstatus = 'F'",
    f"SELECT p.c_custkey, o.o_orderkey, {duck.phone('p.phone')} AS phone FROM people p LEFT JOIN orders o ON p.c_custkey = o.o_custkey AND o.o_orderstatus = 'F'",
    ("orders",),
)

_add(
    "redact_semi_join",
    "SELECT c_custkey, email FROM people WHERE c_custkey IN (SELECT o_custkey FROM orders WHERE o_totalprice > 100000)",
    f"SELECT c_custkey, {duck.email('email')} AS email FROM people WHERE c_custkey IN (SELECT o_custkey FROM orders WHERE o_totalprice > 100000)",
    ("orders",),
)

_add(
    "redact_anti_join",
    "SELECT c_custkey, ssn FROM people p WHERE NOT EXISTS (SELECT 1 FROM orders o WHERE o.o_custkey = p.c_custkey AND o.o_orderpriority = '1-URGENT' AND o.o_totalprice > 200000)",
    f"SELECT c_custkey, {duck.ssn('ssn')} AS ssn FROM people p WHERE NOT EXISTS (SELECT 1 FROM orders o WHERE o.o_custkey = p.c_custkey AND o.o_orderpriority = '1-URGENT' AND o.o_totalprice > 200000)",
    ("orders",),
)

_add(
    "redact_groupby",
    "SELECT address, c_mktsegment, count(*) AS n, max(email) AS email FROM people GROUP BY address, c_mktsegment",
    f"""SELECT {duck.location('address')} AS address, c_mktsegment, n, {duck.email('email')} AS email
      FROM (SELECT address, c_mktsegment, count(*) AS n, max(email) AS email FROM people GROUP BY address, c_mktsegment)""",
)

_add(
    "redact_rollup",
    "SELECT c_mktsegment, ip_address, count(*) AS n, count(DISTINCT ssn) AS people FROM people GROUP BY ROLLUP (c_mktsegment, ip_address)",
    f"""SELECT c_mktsegment, {duck.keep('ip_address', duck.ip('ip_address'))} AS ip_address, n, people
      FROM (SELECT c_mktsegment, ip_address, count(*) AS n, count(DISTINCT ssn) AS people FROM people
            GROUP BY ROLLUP (c_mktsegment, ip_address))""",
)

# The windows run over monthly totals, so their size does not grow with the orders.
_WINDOW = """SELECT c_nationkey, month, email, sum(n) OVER by_month AS orders_so_far,
  lag(phone) OVER by_month AS previous_phone
FROM (SELECT c_nationkey, {month} AS month, max(email) AS email, min(phone) AS phone, count(*) AS n
      FROM people JOIN orders ON c_custkey = o_custkey GROUP BY 1, 2)
WINDOW by_month AS (PARTITION BY c_nationkey ORDER BY month)"""
_add(
    "redact_window",
    _WINDOW.format(month="date_format(o_orderdate, 'yyyy-MM')"),
    f"""SELECT c_nationkey, month, {duck.email('email')} AS email, orders_so_far::bigint AS orders_so_far,
      {duck.keep('previous_phone', duck.phone('previous_phone'))} AS previous_phone
      FROM ({_WINDOW.format(month="strftime(o_orderdate, '%Y-%m')")})""",
    ("orders",),
)

_add(
    "redact_union",
    "SELECT email AS contact, c_custkey FROM people UNION ALL SELECT phone, c_custkey FROM people",
    # no mask is right for two types
    """SELECT '[PHONE NUMBER]' AS contact, c_custkey
      FROM (SELECT email AS contact, c_custkey FROM people UNION ALL SELECT phone, c_custkey FROM people)""",
)
_add(
    "redact_union_of_one_type",
    "SELECT email AS contact, c_custkey FROM people UNION ALL SELECT upper(email), c_custkey FROM people",
    f"""SELECT {duck.email('contact')} AS contact, c_custkey
      FROM (SELECT email AS contact, c_custkey FROM people UNION ALL SELECT upper(email), c_custkey FROM people)""",
)

_add(
    "redact_set_operations",
    "SELECT full_name FROM people WHERE c_acctbal > 0 INTERSECT SELECT full_name FROM people WHERE c_nationkey < 12 EXCEPT SELECT full_name FROM people WHERE c_mktsegment = 'BUILDING'",
    f"""SELECT {duck.name('full_name')} AS full_name FROM (SELECT full_name FROM people
      WHERE c_acctbal > 0 AND c_nationkey < 12 AND c_mktsegment <> 'BUILDING')""",
)

_TOPK = "SELECT c_custkey, account_number, c_acctbal FROM people ORDER BY c_acctbal DESC, c_custkey LIMIT 100"
_add(
    "redact_topk",
    _TOPK,
    f"SELECT c_custkey, {duck.financial('account_number')} AS account_number, c_acctbal FROM ({_TOPK})",
)

_add(
    "redact_distinct",
    "SELECT DISTINCT ip_address AS host FROM people",
    f"SELECT {duck.ip('ip_address')} AS host FROM (SELECT DISTINCT ip_address FROM people)",
)

_CTE = """best AS (SELECT o_custkey, max(o_totalprice) AS top FROM orders GROUP BY o_custkey),
named AS (SELECT c_custkey, email AS e, top FROM people JOIN best ON c_custkey = o_custkey)"""
_add(
    "redact_cte",
    f"WITH {_CTE} SELECT * FROM named",
    f", {_CTE} SELECT c_custkey, {duck.email('e')} AS e, top FROM named",
    ("orders",),
)

# Predicates compare raw values; only the output is masked.
_add(
    "redact_filter_on_raw",
    "SELECT c_custkey, email FROM people WHERE email LIKE 'user1%' AND phone LIKE '(555) 1%'",
    f"SELECT c_custkey, {duck.email('email')} AS email FROM people WHERE email LIKE 'user1%' AND phone LIKE '(555) 1%'",
)

_add(
    "redact_explode",
    "SELECT c_custkey, part AS email FROM people LATERAL VIEW explode(split(email, '@')) v AS part",
    # of pieces a partial mask could show all, so they are labelled
    "SELECT c_custkey, '[EMAIL ADDRESS]' AS email FROM (SELECT c_custkey, unnest(string_split(email, '@')) FROM people)",
)

_add(
    "redact_range_join",
    """SELECT p.c_custkey, p.ssn, e.event_id FROM people p JOIN events e
       ON e.user_id = p.c_custkey AND e.value BETWEEN p.c_nationkey AND p.c_nationkey + 10""",
    f"""SELECT p.c_custkey, {duck.ssn('p.ssn')} AS ssn, e.event_id FROM people p JOIN events e
       ON e.user_id = p.c_custkey AND e.value BETWEEN p.c_nationkey AND p.c_nationkey + 10""",
    ("events",),
)


def sql_parameters(spark, sf_dir):
    return _session(spark, sf_dir).sql(
        "SELECT c_custkey, email FROM people WHERE c_nationkey = :nation AND c_acctbal > :least",
        {"nation": 7, "least": 100.5},
    )


QUERIES["sql_parameters"] = sql_parameters
ORACLES["sql_parameters"] = f"""WITH people AS ({PEOPLE})
SELECT c_custkey, {duck.email('email')} AS email FROM people WHERE c_nationkey = 7 AND c_acctbal > 100.5"""

_SHOWN = "SELECT c_custkey, email, phone, full_name, encrypted_password FROM people"
_add(
    "reveal_columns",
    _SHOWN,
    f"""SELECT c_custkey, email, {duck.phone('phone')} AS phone, {duck.name('full_name')} AS full_name,
      '[REDACTED]' AS encrypted_password FROM people""",
    reveal_columns=["Email", "encrypted_password"],
)
_add(
    "reveal_types",
    _SHOWN,
    f"""SELECT c_custkey, {duck.email('email')} AS email, phone, full_name, '[REDACTED]' AS encrypted_password
      FROM people""",
    reveal_types=["PERSON", "PHONE_NUMBER", "SECRET"],
)
_add(
    "reveal_columns_and_types",
    _SHOWN,
    f"""SELECT c_custkey, email, {duck.phone('phone')} AS phone, full_name, '[REDACTED]' AS encrypted_password
      FROM people""",
    reveal_columns=["email"],
    reveal_types=["PERSON"],
)

_add(
    "style_full",
    "SELECT c_custkey, email, ssn, encrypted_password FROM people",
    "SELECT c_custkey, '[EMAIL ADDRESS]' AS email, '[US SSN]' AS ssn, '[REDACTED]' AS encrypted_password FROM people",
    policy=Policy(default_style="full"),
)
_add(
    "style_pseudonymize",
    "SELECT c_custkey, email, full_name FROM people",
    f"""SELECT c_custkey, {duck.pseudonym('email', 'EMAIL_ADDRESS')} AS email,
      {duck.pseudonym('full_name', 'PERSON')} AS full_name FROM people""",
    policy=Policy(default_style="pseudonymize", seed=SEED),
)

# The override belongs to the owning table, wherever it stands in the query.
_add(
    "style_override",
    "SELECT o.o_orderkey, p.email AS contact, p.phone FROM orders o JOIN people p ON p.c_custkey = o.o_custkey",
    f"""SELECT o.o_orderkey, '[EMAIL ADDRESS]' AS contact, {duck.phone('p.phone')} AS phone
      FROM orders o JOIN people p ON p.c_custkey = o.o_custkey""",
    ("orders",),
    policy=Policy(rules=(Rule("People", "EMAIL", "EMAIL_ADDRESS", "full"),)),
)
_add(
    "exclude_column",
    "SELECT c_custkey, email, email AS phone, ssn FROM people",
    f"SELECT c_custkey, email, email AS phone, {duck.ssn('ssn')} AS ssn FROM people",
    policy=Policy(rules=(Rule("people", "email", "none", "none"),)),
)
_add(
    "manual_rule",
    "SELECT c_custkey, c_mktsegment, email FROM people",
    f"SELECT c_custkey, '[REDACTED]' AS c_mktsegment, {duck.name('email')} AS email FROM people",
    policy=Policy(rules=(Rule("people", "c_mktsegment", "SECRET"), Rule("people", "email", "PERSON"))),
)

# Masked tables: joins and filters see masks, so nothing raw can be computed from.
_SOURCE = """SELECT upper(email) AS shout, c_mktsegment, count(*) AS n FROM people
WHERE ssn LIKE '***%' GROUP BY upper(email), c_mktsegment"""
_add(
    "mask_at_source",
    _SOURCE,
    f"""SELECT upper({duck.email('email')}) AS shout, c_mktsegment, count(*) AS n FROM people
      GROUP BY 1, 2""",
    mask_at="source",
)

# When each customer was last seen: an as-of lookup without a window over the events.
_LATEST = """SELECT p.c_custkey, p.email AS contact, {text} AS last_seen, count(e.event_id) AS events
FROM people p LEFT JOIN events e ON e.user_id = p.c_custkey AND e.value > p.c_nationkey
GROUP BY p.c_custkey, p.email"""
_add(
    "redact_latest_event",
    _LATEST.format(text="date_format(max(e.ts), 'yyyy-MM-dd HH:mm:ss')"),
    f"""SELECT c_custkey, {duck.email('contact')} AS contact, last_seen, events
      FROM ({_LATEST.format(text="strftime(max(e.ts), '%Y-%m-%d %H:%M:%S')")})""",
    ("events",),
)

_CUBE = """SELECT c_mktsegment, c_nationkey, count(*) AS n, min(full_name) AS nickname FROM people
GROUP BY CUBE (c_mktsegment, c_nationkey)"""
_add(
    "redact_cube",
    _CUBE,
    f"SELECT c_mktsegment, c_nationkey, n, {duck.name('nickname')} AS nickname FROM ({_CUBE})",
)

# What is computed from a personal column is masked like it, whatever its name.
_COMPUTED = """SELECT p.c_custkey, trim(p.ssn) AS a, coalesce(p.ssn, '') AS b,
  (SELECT max(ssn) FROM people) AS c, concat(p.c_mktsegment, p.email) AS d, length(p.ssn) AS e, p.ssn IS NULL AS f
FROM people p WHERE p.c_nationkey < 20
UNION ALL SELECT c_custkey, c_mktsegment, ssn, c_mktsegment, c_mktsegment, c_nationkey, true FROM people WHERE c_nationkey >= 20"""
_add(
    "redact_computed",
    _COMPUTED,
    f"""SELECT c_custkey, {duck.ssn('a')} AS a, {duck.ssn('b')} AS b, {duck.ssn('c')} AS c, {duck.email('d')} AS d, e, f
      FROM ({_COMPUTED})""",
)
_add(
    "redact_computed_lists",
    """WITH x AS (SELECT c_nationkey, upper(ssn) AS q FROM people)
      SELECT c_nationkey, count(q) AS n, array_join(sort_array(collect_list(q)), ',') AS l FROM x GROUP BY c_nationkey""",
    f"""SELECT c_nationkey, n, {duck.ssn('l')} AS l FROM (
      SELECT c_nationkey, count(*) AS n, string_agg(upper(ssn), ',' ORDER BY upper(ssn)) AS l FROM people GROUP BY c_nationkey)""",
)

# Pieces of a value are labelled, whole values among others keep their mask.
_add(
    "redact_pieces",
    """SELECT c_custkey, substr(ssn, 1, 4) AS a, split(email, '@')[1] AS b, reverse(phone) AS c, concat(c_mktsegment, ' ', ssn) AS d,
      least(ssn, '5') AS e, lag(ssn) OVER (PARTITION BY c_nationkey ORDER BY c_custkey) AS f FROM people""",
    f"""SELECT c_custkey, '[US SSN]' AS a, '[EMAIL ADDRESS]' AS b, '[PHONE NUMBER]' AS c, {duck.ssn('ssn')} AS d, {duck.ssn("least(ssn, '5')")} AS e,
      {duck.keep('before', duck.ssn('before'))} AS f
      FROM (SELECT *, lag(ssn) OVER (PARTITION BY c_nationkey ORDER BY c_custkey) AS before FROM people)""",
)

# The owner's decision holds for what is computed from it.
_add(
    "redact_computed_by_table",
    "SELECT c_nationkey, max(phone) AS top_line, max(ssn) AS neutral FROM people GROUP BY c_nationkey",
    f"""SELECT c_nationkey, {duck.phone('top_line')} AS top_line, {duck.ssn('neutral')} AS neutral
      FROM (SELECT c_nationkey, max(phone) AS top_line, max(ssn) AS neutral FROM people GROUP BY c_nationkey)""",
    policy=Policy(rules=(Rule("people", "top_line", "PHONE_NUMBER"),)),
)


# A lateral join puts out what it computes of the row on its left.
_add(
    "redact_lateral",
    """SELECT p.c_custkey, l.z, t.w, n.orders FROM people p, LATERAL (SELECT concat(p.ssn, '') AS z) l,
      LATERAL explode(array(upper(p.email), lower(p.email))) AS t(w),
      LATERAL (SELECT count(o.o_orderkey) AS orders FROM orders o WHERE o.o_custkey = p.c_custkey) n""",
    f"""SELECT c_custkey, {duck.ssn('ssn')} AS z, {duck.email('w')} AS w, coalesce(n, 0) AS orders
      FROM (SELECT c_custkey, ssn, unnest([upper(email), lower(email)]) AS w FROM people)
      LEFT JOIN (SELECT o_custkey, count(*) AS n FROM orders GROUP BY o_custkey) ON o_custkey = c_custkey""",
    ("orders",),
)

# A recursive table: managers by a chain of keys, with the mail address carried along.
_add(
    "redact_recursive",
    """WITH RECURSIVE up(start, at, way, hops) AS (
        SELECT c_custkey, c_custkey, email, 0 FROM people
        UNION ALL SELECT start, at DIV 2, way, hops + 1 FROM up WHERE at > 1)
      SELECT start, way, max(hops) AS hops FROM up GROUP BY start, way""",
    f"""SELECT c_custkey AS start, {duck.email('email')} AS way,
        CASE WHEN c_custkey <= 1 THEN 0 ELSE length(bin(c_custkey)) - 1 END::INTEGER AS hops FROM people""",
)

# What is made of several columns is as strict as the strictest of them, and a label if they are of several types.
_MIXED = """SELECT c_custkey, concat(phone, email) AS a, concat(c_mktsegment, ' ', ssn) AS b, email AS c, full_name AS d FROM people
UNION ALL SELECT c_custkey, phone, ssn, phone, ssn FROM people"""
_add(
    "redact_mixed_owners",
    _MIXED,
    f"""SELECT c_custkey, {duck.phone('a')} AS a, '[US SSN]' AS b, {duck.phone('c')} AS c, '[US SSN]' AS d FROM ({_MIXED})""",
    policy=Policy(rules=(Rule("people", "email", "none"), Rule("people", "c_mktsegment", "FREE_TEXT"))),
    reveal_types=["PERSON"],
)

# A computed column's own rule and name count beside what it is made of.
_add(
    "redact_own_rule_wins",
    "SELECT c_nationkey, max(email) AS top, min(email) AS otp_secret, max(phone) AS line, min(ssn) AS mail FROM people GROUP BY c_nationkey",
    """SELECT c_nationkey, '[REDACTED]' AS top, '[REDACTED]' AS otp_secret, '[PHONE NUMBER]' AS line, '[US SSN]' AS mail
      FROM people GROUP BY c_nationkey""",
    policy=Policy(rules=(Rule("people", "top", "SECRET"), Rule("people", "line", "PHONE_NUMBER", "full"))),
)


def row_cap(spark, sf_dir):
    """The cap sits above the masking projection; which rows come is left open."""
    policy = Policy(max_rows=700)
    capped = _session(spark, sf_dir, policy=policy).sql("SELECT c_custkey, email FROM people").limit(policy.max_rows)
    return capped.agg(
        F.count(F.lit(1)).alias("n"), F.sum(F.col("email").contains("***@m***").cast("bigint")).alias("masked")
    )


QUERIES["row_cap"] = row_cap
ORACLES["row_cap"] = "SELECT least(count(*), 700) AS n, least(count(*), 700) AS masked FROM customer"


def configure_override(spark, sf_dir):
    """Decisions changed in a running session hold for the queries that follow."""
    session = _session(spark, sf_dir)
    session.configure("people", "email", "full")
    session.configure("people", "c_mktsegment", "partial", "PERSON")
    session.configure("people", "phone", pii_type="none")
    return session.sql("SELECT c_custkey, email, c_mktsegment AS m, phone AS p, ssn FROM people")


QUERIES["configure_override"] = configure_override
ORACLES["configure_override"] = f"""WITH people AS ({PEOPLE})
SELECT c_custkey, '[EMAIL ADDRESS]' AS email, {duck.name('c_mktsegment')} AS m, phone AS p, {duck.ssn('ssn')} AS ssn FROM people"""


def rules_from_files(spark, sf_dir):
    """Rules derived from the data, written as JSON, read back, and applied."""
    path = scratch(spark, "rules")
    rules = """SELECT DISTINCT concat('PEOPLE') AS table, 'c_mktsegment' AS column, 'PERSON' AS pii_type, 'full' AS masking_style FROM people
      UNION ALL SELECT DISTINCT 'people', 'Email', 'none', NULL FROM people"""
    people = derived(spark, sf_dir, PEOPLE)
    people.createOrReplaceTempView("people")
    write_with_count(spark.sql(rules), path, fmt="json")
    policy = policy_from_rules(read_rules(spark, path))
    return MaskedSession(spark, policy).register("people", people).sql("SELECT c_custkey, c_mktsegment, email, phone FROM people")


QUERIES["rules_from_files"] = rules_from_files
ORACLES["rules_from_files"] = f"""WITH people AS ({PEOPLE})
SELECT c_custkey, '[PERSON]' AS c_mktsegment, email, {duck.phone('phone')} AS phone FROM people"""


# Each view of a page with the purchase before it: the last of the same customer up to that time.
_SIDES = """SELECT event_id, ts, user_id, concat('u', user_id, '@mail.example.com') AS email,
  concat('10.1.', user_id % 256, '.', event_id % 256) AS ip_address, event_id % 3 AS side FROM events"""


def redact_asof_join(spark, sf_dir):
    session = MaskedSession(spark, Policy(rules=(Rule("seen", "ip_address", "IP_ADDRESS", "full"),)))
    session.register("seen", derived(spark, sf_dir, _SIDES, "events"))
    views = spark.sql("SELECT event_id, ts, user_id, email FROM seen WHERE side <> 0")
    bought = spark.sql("SELECT event_id, ts, user_id, ip_address FROM seen WHERE side = 0")
    joined = asof_join(views, bought, ["user_id"], "ts", ["event_id", "ip_address"], 6 * 3600, order=["event_id"], prefix="before_")
    return redact(joined.select("event_id", "user_id", "email", "before_event_id", "before_ip_address"), session.policy)


QUERIES["redact_asof_join"] = redact_asof_join
ORACLES["redact_asof_join"] = f"""
WITH seen AS ({_SIDES}), views AS (SELECT * FROM seen WHERE side <> 0),
bought AS (SELECT * FROM seen WHERE side = 0 QUALIFY row_number() OVER (PARTITION BY user_id, ts ORDER BY event_id DESC) = 1)
SELECT v.event_id, v.user_id, {duck.email('v.email')} AS email, b.event_id AS before_event_id,
  CASE WHEN b.ip_address IS NOT NULL THEN '[IP ADDRESS]' END AS before_ip_address
FROM views v ASOF LEFT JOIN bought b ON v.user_id = b.user_id AND v.ts >= b.ts"""
