"""SQL text, streams, result lines and written counts."""

from types import SimpleNamespace

import pytest

from pyspark.sql import functions as F

from veilframe import Policy, Rule, redact_stream, table_hints, write_stream, write_with_count, writes_data
from veilframe.functions.sqltext import tables_named
from veilframe.plans.results import result_lines
from veilframe.sources.writers import shared_folder

HINTS = {
    "SELECT * FROM users": ["public.users"],
    "SELECT * FROM public.users": ["public.users"],
    "SELECT u.id, o.data FROM users u JOIN orders o ON u.id = o.user_id": ["public.users", "public.orders"],
    "SELECT * FROM users LEFT JOIN profiles ON users.id = profiles.user_id": ["public.users", "public.profiles"],
    "SELECT * FROM users JOIN orders ON users.id = orders.user_id JOIN payments ON orders.id = payments.order_id": [
        "public.users", "public.orders", "public.payments",
    ],
    "SELECT * FROM (SELECT id FROM users) sub": ["public.users"],
    "select * from Users": ["public.users"],
    "SELECT * FROM users JOIN users ON users.id = users.manager_id": ["public.users"],
    "SELECT 1": [],
    "SELECT * FROM orders JOIN users ON orders.user_id = users.id": ["public.orders", "public.users"],
    "SELECT extract(year FROM born) FROM A.b": ["public.born", "a.b"],
}


def test_table_hints(spark):
    df = spark.createDataFrame([(q,) for q in HINTS], "q string")
    assert {r[0]: r[1] for r in df.select("q", table_hints(F.col("q"))).collect()} == HINTS
    assert {q: tables_named(q) for q in HINTS} == HINTS
    other = df.where("q = 'SELECT * FROM users'").select(table_hints(F.col("q"), "default")).first()[0]
    assert other == ["default.users"]


def test_write_words(spark):
    yes = [f"{w} something" for w in "INSERT UPDATE DELETE DROP ALTER TRUNCATE CREATE GRANT REVOKE COPY".split()]
    yes += ["insert into users values (1)", "Insert Into users Values (1)", "SELECT 'delete'"]
    no = [
        "SELECT * FROM users", "SELECT * FROM (SELECT id FROM users) t", "EXPLAIN SELECT * FROM users",
        "SELECT updated_at FROM users", "SELECT created_at FROM users", "SELECT deleted FROM users", "MERGE INTO x",
    ]
    df = spark.createDataFrame([(q,) for q in yes + no], "q string")
    assert [r[0] for r in df.select(writes_data(F.col("q"))).collect()] == [True] * len(yes) + [False] * len(no)


def test_stream(spark, data, tmp_path):
    schema = spark.read.parquet(f"{data}/documents.parquet").schema
    stream = (
        spark.readStream.schema(schema).option("pathGlobFilter", "documents.parquet").parquet(data)
        .select("doc_id", F.col("lang").alias("email"), F.col("text").alias("notes"), "source")
    )
    masked = redact_stream(stream, Policy(rules=(Rule("docs", "source", "PERSON", "full"),)), "docs")
    assert masked.isStreaming
    out, state = str(tmp_path / "out"), str(tmp_path / "state")
    write_stream(masked, out, state).awaitTermination()
    # Started again, there is nothing left to do.
    write_stream(masked, out, state).awaitTermination()
    rows = spark.read.parquet(out)
    assert rows.count() == spark.read.parquet(f"{data}/documents.parquet").count()
    assert {r[0] for r in rows.select("source").distinct().collect()} == {"[PERSON]"}
    assert {len(r[0]) for r in rows.select("email").distinct().collect()} == {2}


def test_write_with_count(spark, tmp_path):
    path = str(tmp_path / "t")
    assert write_with_count(spark.range(17), path) == 17
    assert write_with_count(spark.range(0), path) == 0
    assert write_with_count(spark.range(5).withColumn("p", F.col("id") % 2), str(tmp_path / "p"), partition_by=("p",)) == 5
    assert write_with_count(spark.range(3), table="counted", mode="overwrite") == 3
    assert spark.table("counted").count() == 3


def test_shared_folder_follows_the_session():
    # The setting is fixed when a session starts, so a stand-in names it here.
    def session(folder):
        conf = SimpleNamespace(get=lambda key, default: folder if key == "spark.checkpoint.dir" else default)
        context = SimpleNamespace(getCheckpointDir=lambda: None)
        return SimpleNamespace(conf=conf, sparkContext=context)

    first, second = (shared_folder(session("hdfs://nn/shared/"), "x") for _ in range(2))
    assert first != second and first.startswith("hdfs://nn/shared/x-")
    assert shared_folder(session(None), "x", "/shared").startswith("/shared/x-")
    with pytest.raises(ValueError, match="shared folder"):
        shared_folder(session(None), "x")


def test_result_lines(spark):
    df = spark.createDataFrame([(1, None, bytearray(b"hi"), [1, 2])], "a int, a2 string, b binary, l array<int>").toDF("a", "a", "b", "l")
    assert result_lines(df).first()[0] == "| 1 | NULL | aGk= | [1, 2] |"
    assert result_lines(df, "tsv").first()[0] == "1\tNULL\taGk=\t[1, 2]"
