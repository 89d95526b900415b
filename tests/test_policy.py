"""Policies, rules, and where they come from."""

import json

import pytest

from veilframe import Classification, Policy, Rule
from veilframe.policy import EXCLUDED
from veilframe.sources.readers import policy_from_rules, read_rules


def test_defaults():
    p = Policy()
    assert (p.default_style, p.sample_size, p.auto_detect, p.read_only, p.max_rows) == ("partial", 100, True, True, 1000)
    assert p.allowed_schemas == ("public",) and p.rules == () and p.seed is None


def test_rules_and_lookups():
    p = Policy(rules=(Rule("users", "email", "EMAIL_ADDRESS"), Rule("Web.Users", "X", "US_SSN", "full"), Rule("users", "pub", "none", "none")))
    assert p.rule("users", "EMAIL").pii_type == "EMAIL_ADDRESS"
    assert p.rule("users", "nope") is None
    assert p.entry("public.users", "email") == Classification("EMAIL_ADDRESS", 1.0, "manual")
    assert p.entry("web.users", "x").entity_type == "US_SSN"
    assert p.entry("users", "pub") == EXCLUDED
    assert p.entry("users", "other") is None
    assert p.style("web.users", "x") == "full"
    assert p.style("users", "email") == "partial"
    assert p.style(None, "email") == "partial"


def test_overrides_return_a_new_policy():
    p = Policy(rules=(Rule("users", "email", "EMAIL_ADDRESS"),))
    q = p.with_rule("users", "email", "full", "none")
    assert p.entry("users", "email").entity_type == "EMAIL_ADDRESS"
    assert q.entry("users", "email") == EXCLUDED and q.style("users", "email") == "full"
    r = q.with_rule("users", "email", "partial", "PERSON").with_rule("users", "phone", "full")
    assert r.entry("users", "email").entity_type == "PERSON" and r.style("users", "email") == "partial"
    assert r.entry("users", "phone") is None and r.style("users", "phone") == "full"
    assert r.rule("users", "email").pii_type == "EMAIL_ADDRESS"


def test_found_classifications_do_not_replace_rules():
    p = Policy(rules=(Rule("t", "a", "none"),)).with_classifications(
        {("t", "a"): Classification("PERSON", 0.5, "values"), ("t", "b"): Classification("PERSON", 0.5, "values")}
    )
    assert p.entry("t", "a") == EXCLUDED and p.entry("t", "b").source == "values"


def test_resolve_order():
    p = Policy(rules=(Rule("b", "c", "PERSON"), Rule("a", "d", "none")))
    assert p.resolve("c", [("a", "c"), ("b", "c")])[0].entity_type == "PERSON"
    assert p.resolve("d", [("a", "d"), ("b", "d")])[0] is None
    assert p.resolve("x", [("a", "email")])[0].entity_type == "EMAIL_ADDRESS"
    assert p.resolve("email")[0].entity_type == "EMAIL_ADDRESS"
    assert p.resolve("email", [("a", "id")])[0].entity_type == "EMAIL_ADDRESS"
    assert p.resolve("id") == (None, None)


def test_settings():
    p = Policy.from_settings(
        {
            "connection_string": "x", "default_masking_style": "full", "max_rows": 5, "allowed_schemas": ["a", "b"],
            "column_rules": [{"table": "users", "column": "email", "pii_type": "EMAIL_ADDRESS", "masking_style": "partial"}],
        }
    )
    assert (p.default_style, p.max_rows, p.allowed_schemas) == ("full", 5, ("a", "b"))
    assert p.rules == (Rule("users", "email", "EMAIL_ADDRESS"),)
    with pytest.raises(TypeError):
        Policy.from_settings({"unheard_of": 1})


def test_rules_from_files(spark, tmp_path):
    js = tmp_path / "rules.json"
    js.write_text(json.dumps({"table": "users", "column": "email", "pii_type": "EMAIL_ADDRESS"}) + "\n"
                  + json.dumps({"table": "users", "column": "x", "pii_type": "none", "masking_style": "none"}))
    p = policy_from_rules(read_rules(spark, str(js)), max_rows=7)
    assert p.max_rows == 7
    assert p.rule("users", "email") == Rule("users", "email", "EMAIL_ADDRESS", "partial")
    assert p.entry("users", "x") == EXCLUDED
    csv = tmp_path / "rules.csv"
    csv.write_text("table,column,pii_type,masking_style\nusers,email,EMAIL_ADDRESS,full\n")
    assert policy_from_rules(read_rules(spark, str(csv), "csv")).style("users", "email") == "full"


def test_a_style_alone_applies_where_it_was_set():
    p = Policy().with_rule("orders", "email", "full")
    info, owner = p.resolve("email", [("users", "email"), ("orders", "email")])
    assert info.entity_type == "EMAIL_ADDRESS" and p.style(*owner) == "full"
