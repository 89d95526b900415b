"""The gate on analysed plans: what names stand for decides, not how they are spelled."""

import re

import pytest

from veilframe import MaskedSession, Policy, QueryError, ReadOnlyError
from veilframe.plans.gate import analysed_refusal

PROPERTY = "('java.lang.System', 'getProperty', 'user.home')"
RUNNING = [
    f"SELECT IDENTIFIER('ref' || 'lect'){PROPERTY}",
    f"SELECT IDENTIFIER('java_'||'method'){PROPERTY}",
    f"SELECT IDENTIFIER(:f){PROPERTY}",
    f"SELECT IDENTIFIER('`try_reflect`'){PROPERTY}",
    f"SELECT * FROM t LIMIT IDENTIFIER('java_' || 'method'){PROPERTY}",
    f"SELECT * FROM IDENTIFIER(upper(IDENTIFIER('java_method'){PROPERTY}))",
    f"SELECT * FROM IDENTIFIER(java_method{PROPERTY})",
    f"SELECT * FROM t, LATERAL (SELECT IDENTIFIER('reflect'){PROPERTY})",
    f"SELECT transform(array(1), x -> IDENTIFIER('reflect'){PROPERTY}) FROM t",
    f"SELECT max(id) OVER (ORDER BY IDENTIFIER('reflect'){PROPERTY}) FROM t",
    f"SELECT EXISTS (SELECT 1 WHERE IDENTIFIER('reflect'){PROPERTY} = '/')",
    f"EXPLAIN SELECT IDENTIFIER('reflect'){PROPERTY}",
    "SELECT own(id) FROM t",
    "SELECT * FROM own_rows(3)",
    "SELECT * FROM t |> WHERE own(id) > 1",
    "FROM t SELECT TRANSFORM (id) USING 'cat'",
    "FROM t MAP id USING 'cat'",
]
READING = [
    "FROM t |> SELECT id |> WHERE id > 0 |> AGGREGATE sum(id) AS s GROUP BY id",
    "FROM t SELECT id",
    "SELECT IDENTIFIER('up' || 'per')(IDENTIFIER(:c)) FROM IDENTIFIER('t')",
    "SELECT * FROM range(5) r JOIN t USING (id) ORDER BY id LIMIT 3 OFFSET 1",
    "WITH RECURSIVE r(n) AS (SELECT 1 UNION ALL SELECT n + 1 FROM r WHERE n < 3) SELECT * FROM r",
    "SELECT * FROM t TABLESAMPLE (50 PERCENT)",
    "SELECT * FROM VALUES (1, 2), (3, 4) AS v(a, b) PIVOT (sum(b) FOR a IN (1, 3))",
    "SELECT id, count(*) FROM t GROUP BY ROLLUP (id) HAVING count(*) > 0",
    "SELECT DISTINCT id FROM t EXCEPT SELECT 1 INTERSECT SELECT 2",
    "SELECT u.z FROM t, LATERAL explode(array(id, 2)) AS u(z)",
    "SELECT /*+ BROADCAST(a) */ a.id FROM t a SEMI JOIN t b ON a.id = b.id",
    "SELECT DATE '2024-01-01' + INTERVAL 1 DAY, try_divide(1, 0), url_encode('a b'), aes_encrypt('a', '0000111122223333') FROM t",
    "SELECT percentile_approx(id, 0.5), mode(id), listagg(cast(id AS string), ',') WITHIN GROUP (ORDER BY id) FROM t",
    "EXPLAIN FORMATTED SELECT 1",
    "SHOW TABLES",
    "DESCRIBE t",
]


@pytest.fixture(scope="module")
def session(spark):
    spark.udf.register("own", lambda x: x, "bigint")
    return MaskedSession(spark).register("t", spark.range(4))


@pytest.mark.parametrize("sql", RUNNING)
def test_what_runs_code_is_refused(session, sql):
    with pytest.raises((ReadOnlyError, QueryError)) as error:
        session.sql(sql, {"f": "reflect"} if ":f" in sql else None).collect()
    assert error.type is ReadOnlyError or "own_rows" in sql


@pytest.mark.parametrize("sql", READING)
def test_what_reads_passes(session, sql):
    session.sql(sql, {"c": "id"} if ":c" in sql else None).collect()


def test_functions_of_the_session_by_name(spark, session):
    with pytest.raises(ReadOnlyError):
        session.sql("SELECT own(id) FROM t")
    allowing = MaskedSession(spark, Policy.from_settings({"allowed_functions": ["Own"]})).register("t", spark.range(4))
    assert allowing.sql("SELECT max(own(id)) AS n FROM t").first()[0] == 3
    with pytest.raises(ReadOnlyError):
        allowing.sql(f"SELECT own(length(IDENTIFIER('reflect'){PROPERTY})) FROM t")
    made = spark.range(3).selectExpr("own(id) AS id")  # what a registered table is made of is its maker's affair
    assert MaskedSession(spark).register("made", made).sql("SELECT count(*) AS n FROM made").first()[0] == 3


def test_spark_s_own_functions_pass(spark):
    """Every example in Spark's own documentation, apart from those of functions that call code."""
    functions = spark._jvm.org.apache.spark.sql.catalyst.analysis.FunctionRegistry.expressions().iterator()
    state = spark._jsparkSession.sessionState()
    skip = spark._jvm.org.apache.spark.sql.execution.CommandExecutionMode.SKIP()
    refused, seen = set(), 0
    while functions.hasNext():
        entry = functions.next()
        for sql in re.findall(r"> (SELECT .*?);\n", entry._2()._1().getExamples()):
            try:
                plan = state.executePlan(state.sqlParser().parsePlan(sql), skip).analyzed()
            except Exception:
                continue  # an example that needs another setting
            seen += 1
            if analysed_refusal(plan) is not None:
                refused.add(entry._1())
    assert seen > 700
    assert refused == {"reflect", "java_method", "try_reflect"}
