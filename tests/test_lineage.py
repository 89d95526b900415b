"""What computed columns show: lateral joins, outer scopes, recursion, and columns made of several."""

import pytest

from veilframe import MaskedSession, Policy, Rule

ROW = (1, "john@example.com", "555-123-4567", "call me", "123-45-6789")


@pytest.fixture(scope="module")
def users(spark):
    return spark.createDataFrame([ROW], "id int, email string, phone string, body string, ssn string")


def shown(spark, users, sql, *rules, **reveal):
    session = MaskedSession(spark, Policy(rules=tuple(Rule("users", *r) for r in rules))).register("users", users)
    return [tuple(r) for r in session.sql(sql, **reveal).collect()]


@pytest.mark.parametrize(
    "sql",
    [
        "SELECT l.z FROM users u, LATERAL (SELECT upper(u.ssn) AS z) l",
        "SELECT z FROM users u, LATERAL explode(split(u.ssn, '5')) AS t(z)",
        "SELECT z FROM users u LEFT JOIN LATERAL (SELECT concat(u.ssn, w.id) AS z FROM users w WHERE w.id = u.id) ON true",
        "SELECT l2.y FROM users u, LATERAL (SELECT u.ssn AS z) l1, LATERAL (SELECT reverse(l1.z) AS y) l2",
        "SELECT (SELECT max(w.ssn) FROM users w WHERE w.id = u.id) AS z FROM users u",
        "SELECT z FROM users u LATERAL VIEW explode(array(u.ssn)) t AS z",
        "SELECT z.a FROM (SELECT named_struct('a', ssn) AS z FROM users)",
        "WITH RECURSIVE r(n, z) AS (SELECT 1, ssn FROM users UNION ALL SELECT n + 1, z FROM r WHERE n < 3) SELECT z FROM r",
        "WITH RECURSIVE r(n, y, z) AS (SELECT 1, '', ssn FROM users UNION ALL SELECT n + 1, z, y FROM r WHERE n < 4) SELECT y FROM r",
        "SELECT m['k'] AS z FROM (SELECT map('k', ssn) AS m FROM users)",
        "SELECT one FROM (SELECT id, ssn FROM users) PIVOT (max(ssn) FOR id IN (1 AS one))",
        "SELECT v FROM (SELECT id, ssn, ssn AS other FROM users) UNPIVOT (v FOR k IN (ssn, other))",
        "SELECT transform(array(1), x -> ssn)[0] AS z FROM users",
    ],
)
def test_values_are_followed(spark, users, sql):
    rows = [row[0] for row in shown(spark, users, sql)]
    assert rows and all(not z or z.startswith("***-**-") or z == "[US SSN]" for z in rows), rows


def test_counts_pass(spark, users):
    sql = "SELECT l.n FROM users u, LATERAL (SELECT count(w.ssn) AS n FROM users w WHERE w.id = u.id) l"
    assert shown(spark, users, sql) == [(1,)]


def test_every_part_counts(spark, users):
    none = ("email", "none", "none")
    got = shown(spark, users, "SELECT concat(phone, email) AS x FROM users", none)
    assert got[0][0].startswith("***-***-") and "555" not in got[0][0]
    assert [r[0] for r in shown(spark, users, "SELECT email AS x FROM users UNION ALL SELECT phone FROM users", none)][1].startswith("***-***-")
    assert shown(spark, users, "SELECT concat(body, ' ', ssn) AS x FROM users") == [("[US SSN]",)]


def test_shown_only_if_every_part_is(spark, users):
    union = "SELECT email AS x FROM users UNION ALL SELECT ssn FROM users"
    assert shown(spark, users, union, reveal_types=["EMAIL_ADDRESS"]) == [("[US SSN]",)] * 2
    assert shown(spark, users, union, reveal_types=["EMAIL_ADDRESS", "US_SSN"]) == [(ROW[1],), (ROW[4],)]
    assert shown(spark, users, "SELECT max(email) AS x FROM users", reveal_types=["EMAIL_ADDRESS"]) == [(ROW[1],)]


def test_own_rule_and_name(spark, users):
    assert shown(spark, users, "SELECT max(email) AS top FROM users", ("top", "SECRET")) == [("[REDACTED]",)]
    assert shown(spark, users, "SELECT max(email) AS otp_secret FROM users") == [("[REDACTED]",)]
    assert shown(spark, users, "SELECT email AS otp_secret FROM users", reveal_columns=["otp_secret"]) == [("[REDACTED]",)]
    assert shown(spark, users, "SELECT max(email) AS top FROM users", ("top", "none")) == [("j***@e***.com",)]
    assert shown(spark, users, "SELECT max(email) AS top FROM users", ("email", "EMAIL_ADDRESS", "full")) == [("[EMAIL ADDRESS]",)]
    assert shown(spark, users, "SELECT max(email) AS top_mail FROM users", ("email", "none")) == [(ROW[1],)]


def test_types_that_differ_give_a_label(spark, users):
    assert shown(spark, users, "SELECT concat(email, ssn) AS x FROM users") == [("[US SSN]",)]
    assert shown(spark, users, "SELECT max(phone) AS top_mail FROM users") == [("[PHONE NUMBER]",)]
    assert shown(spark, users, "SELECT array(email, phone) AS x FROM users") == [(["[PHONE NUMBER]"] * 2,)]


@pytest.mark.parametrize(
    "what",
    ["substr(ssn, 1, 3)", "left(ssn, 4)", "split(ssn, '-')[0]", "regexp_extract(ssn, '([0-9]+)', 1)", "reverse(ssn)", "translate(ssn, '0123456789', 'abcdefghij')", "cast(replace(ssn, '-', '') AS bigint) + 1", "md5(ssn)", "max(substr(ssn, 1, 3)) OVER ()"],
)
def test_pieces_are_labelled(spark, users, what):
    assert shown(spark, users, f"SELECT {what} AS x FROM users") == [("[US SSN]",)]


def test_pieces_of_json_are_labelled(spark):
    rows = [(1, '{"first_name": "Ann", "otp_secret": "s1"}')]
    session = MaskedSession(spark, Policy(rules=(Rule("t", "data", "JSON_CONTAINER"),))).register("t", spark.createDataFrame(rows, "id int, data string"))
    out = session.sql("SELECT get_json_object(data, '$.otp_secret') AS a, get_json_object(data, '$.first_name') AS b, upper(data) AS c, data FROM t").first()
    assert tuple(out)[:2] == ("[JSON CONTAINER]", "[JSON CONTAINER]") and "S1" not in out["c"] and "s1" not in out["data"]


def test_whole_values_keep_their_mask(spark, users):
    for what in ("max(ssn)", "coalesce(max(ssn), '')", "first(trim(ssn))", "array_join(collect_list(upper(ssn)), ',')", "max(CASE WHEN id = 1 THEN ssn END)"):
        assert shown(spark, users, f"SELECT {what} AS x FROM users") == [("***-**-6789",)], what


def test_a_recursive_table_has_as_many_rows_as_it_needs(spark):
    """Spark ends one at a million rows, if the session does not say otherwise."""
    own = spark.newSession()
    many = own.range(0, 200_000, 1, 4).selectExpr("id", "concat('user', id, '@x.org') AS email")
    session = MaskedSession(own).register("many", many)
    sql = """WITH RECURSIVE r(n, way) AS (SELECT 1, email FROM many UNION ALL SELECT n + 1, way FROM r WHERE n < 6)
      SELECT way, count(*) AS n FROM r GROUP BY way"""
    shown = session.sql(sql).groupBy("way", "n").count().collect()
    assert [tuple(row) for row in shown] == [("u***@x***.org", 6, 200_000)]


def test_a_limit_of_ones_own_stays(spark):
    own = spark.newSession()
    own.conf.set("spark.sql.cteRecursionRowLimit", "1000")
    assert MaskedSession(own).spark.conf.get("spark.sql.cteRecursionRowLimit") == "1000"
