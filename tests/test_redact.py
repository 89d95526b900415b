"""Redaction of results: which columns, how, and what may be shown."""

import pytest
from pyspark.sql import functions as F

from veilframe import Policy, Rule, redact
from veilframe.operators.redact import annotation_frame, annotations, plan_columns
from veilframe.plans.lineage import tag_columns


def frame(spark, columns, *rows):
    return spark.createDataFrame(list(rows), columns)


def values(df):
    return [tuple(r) for r in df.collect()]


def test_no_personal_columns(spark):
    df = frame(spark, "id int, amount double, status string", (1, 100.0, "active"), (2, 200.0, "inactive"))
    out = redact(df, Policy())
    assert values(out) == values(df)
    assert annotations(out) == []
    assert out.schema.simpleString() == df.schema.simpleString()


def test_masks_by_name(spark):
    df = frame(
        spark,
        "first_name string, email string, phone string, id int",
        ("John Doe", "john@example.com", "555-123-4567", 42),
        (None, None, None, None),
    )
    out = redact(df, Policy())
    assert values(out) == [("J*** D**", "j***@e***.com", "***-***-4567", 42), (None,) * 4]
    assert annotations(out) == [
        ("first_name", "MASKED: PERSON"), ("email", "MASKED: EMAIL_ADDRESS"), ("phone", "MASKED: PHONE_NUMBER"),
    ]


@pytest.mark.parametrize(
    "reveal", [{"reveal_columns": ["encrypted_password"]}, {"reveal_types": ["SECRET"]}, {}]
)
def test_secrets_are_never_shown(spark, reveal):
    df = frame(spark, "encrypted_password string", ("$2a$10$hash",))
    out = redact(df, Policy(default_style="none"), **reveal)
    assert values(out) == [("[REDACTED]",)]
    assert annotations(out) == [("encrypted_password", "MASKED: SECRET")]


def test_reveal(spark):
    df = frame(spark, "email string, phone string, first_name string", ("john@example.com", "555-123-4567", "John"))
    out = redact(df, Policy(), reveal_columns=["EMAIL"], reveal_types=["PERSON"])
    assert values(out) == [("john@example.com", "***-***-4567", "John")]
    assert annotations(out) == [("email", "UNMASKED"), ("phone", "MASKED: PHONE_NUMBER"), ("first_name", "UNMASKED")]


def test_styles(spark):
    df = frame(spark, "email string", ("john@example.com",), ("john@example.com",))
    assert values(redact(df, Policy(default_style="full"))) == [("[EMAIL ADDRESS]",)] * 2
    pseudo = values(redact(df, Policy(default_style="pseudonymize", seed="s")))
    assert pseudo[0] == pseudo[1] and "@masked.invalid" in pseudo[0][0]
    kept = redact(df, Policy(default_style="none"))
    assert values(kept) == values(df)
    with pytest.raises(ValueError):
        redact(df, Policy(default_style="pseudonymize"))


def test_table_hints_find_the_rule(spark):
    policy = Policy(rules=(Rule("users", "custom_field", "EMAIL_ADDRESS"), Rule("logs", "email", "none")))
    df = frame(spark, "custom_field string", ("john@example.com",))
    assert values(redact(df, policy, ["public.users"])) == [("j***@e***.com",)]
    assert values(redact(df, policy, ["orders", "users"])) == [("j***@e***.com",)]
    assert values(redact(df, policy)) == [("john@example.com",)]


def test_excluded_is_not_unknown(spark):
    policy = Policy(rules=(Rule("public.users", "email", "none", "none"),))
    df = frame(spark, "email string", ("john@example.com",))
    out = redact(df, policy, ["users"])
    assert values(out) == values(df) and annotations(out) == []
    assert values(redact(df, policy, ["other"])) == [("j***@e***.com",)]


def test_excluded_json_is_left_alone(spark):
    df = spark.createDataFrame([(("a@b.com",),)], "p struct<email:string>")
    policy = Policy(rules=(Rule("t", "p", "none"),))
    assert values(redact(df, policy, ["t"])) == [(("a@b.com",),)]
    assert values(redact(df, Policy(), ["t"])) == [(("a***@b***.com",),)]


def test_rule_beats_json_type(spark):
    df = spark.createDataFrame([(("a@b.com",),)], "p struct<email:string>")
    policy = Policy(rules=(Rule("t", "p", "JSON_CONTAINER", "full"),))
    assert values(redact(df, policy, ["t"])) == [(("[EMAIL ADDRESS]",),)]


def test_duplicate_names_are_told_apart(spark):
    one = tag_columns(frame(spark, "id int, email string", (1, "a@b.com")), "public.one")
    two = tag_columns(frame(spark, "id int, email string", (1, "c@d.com")), "public.two")
    joined = one.join(two, one["id"] == two["id"])
    policy = Policy(rules=(Rule("two", "email", "EMAIL_ADDRESS", "full"),))
    assert values(redact(joined, policy)) == [(1, "a***@b***.com", 1, "[EMAIL ADDRESS]")]


def test_odd_column_names(spark):
    df = spark.createDataFrame([("a@b.com", "x", "y")], "`my.email` string, `a``b` string, `` string")
    assert values(redact(tag_columns(df, "public.t"), Policy())) == [("a***@b***.com", "x", "y")]


def test_other_types_become_text(spark):
    df = spark.createDataFrame([(5551234567, ["a@b.com", None], bytearray(b"abc"))], "phone bigint, email array<string>, ssn binary")
    out = redact(df, Policy())
    assert out.schema.simpleString() == "struct<phone:string,email:array<string>,ssn:string>"
    assert values(out) == [("***-***-4567", ["a***@b***.com", None], "***-**-****")]


def test_free_text(spark):
    df = frame(spark, "notes string, email_body string", ("call 555-123-4567", "a@b.com"))
    assert values(redact(df, Policy())) == [("call [PHONE NUMBER]", "[EMAIL ADDRESS]")]
    shown = redact(df, Policy(), reveal_types=["EMAIL_ADDRESS"])
    assert values(shown) == [("call [PHONE NUMBER]", "a@b.com")]
    raw = redact(df, Policy(), reveal_types=["FREE_TEXT"])
    assert values(raw) == values(df)


def test_lineage_survives_and_is_lost(spark):
    base = tag_columns(frame(spark, "k int, u string", (1, "a@b.com"), (2, "c@d.com")), "public.t")
    policy = Policy(rules=(Rule("t", "u", "EMAIL_ADDRESS"),))
    other = frame(spark, "k int, z int", (1, 1))

    def is_masked(df, column="x"):
        return [name for name, _ in annotations(redact(df, policy))] == [column]

    base.createOrReplaceTempView("lineage_t")
    other.createOrReplaceTempView("lineage_o")
    kept = [
        "SELECT u AS x FROM lineage_t",
        "WITH c AS (SELECT u AS w FROM lineage_t) SELECT w AS x FROM c",
        "SELECT u AS x, count(*) AS n FROM lineage_t GROUP BY u",
        "SELECT DISTINCT u AS x FROM lineage_t",
        "SELECT u AS x FROM lineage_t ORDER BY k LIMIT 1",
        "SELECT u AS x, row_number() OVER (ORDER BY k) AS n FROM lineage_t",
        "SELECT t.u AS x FROM lineage_t t JOIN lineage_o o ON t.k = o.k",
        "SELECT t.u AS x FROM lineage_o o LEFT JOIN lineage_t t ON t.k = o.k",
        "SELECT u AS x FROM lineage_t UNION ALL SELECT cast(k AS string) FROM lineage_o",
    ]
    lost = [
        "SELECT upper(u) AS x FROM lineage_t",
        "SELECT max(u) AS x FROM lineage_t",
        "SELECT coalesce(u, '') AS x FROM lineage_t",
        "SELECT explode(array(u)) AS x FROM lineage_t",
        "SELECT cast(k AS string) AS x FROM lineage_o UNION ALL SELECT u FROM lineage_t",
    ]
    assert [is_masked(spark.sql(q)) for q in kept] == [True] * len(kept)
    assert [is_masked(spark.sql(q)) for q in lost] == [False] * len(lost)
    # A telling name still catches a computed column.
    assert is_masked(spark.sql("SELECT upper(u) AS email FROM lineage_t"), "email")


def test_plan_is_one_projection_without_python(spark, data):
    people = spark.read.parquet(f"{data}/customer.parquet").select(
        "c_custkey", F.col("c_name").alias("full_name"), "c_acctbal", F.col("c_mktsegment").alias("notes")
    )
    out = redact(people, Policy()).where("c_custkey > 5").select("full_name", "notes")
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Python" not in plan
    assert "GreaterThan(c_custkey,5)" in plan
    assert "c_acctbal" not in plan.split("ReadSchema")[1]


def test_annotation_frame(spark):
    df = frame(spark, "id int, email string, otp_secret string", (1, "a@b.com", "s"))
    plans = plan_columns(df.schema, Policy(), reveal_columns=["email"])
    assert values(annotation_frame(spark, plans)) == [
        (0, "id", None, None), (1, "email", "UNMASKED", "EMAIL_ADDRESS"), (2, "otp_secret", "MASKED: SECRET", "SECRET"),
    ]
