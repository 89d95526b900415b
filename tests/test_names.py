"""Names: the classified, the innocent, and the traps."""

import re._constants as sre
import re._parser as parser

from pyspark.sql import functions as F

from veilframe.functions import names
from veilframe.functions import vocabulary as V

EXPECTED = {
    "EMAIL_ADDRESS": ["e_mail_of_owner", "gmail", "work_mail", "MailingList", "email2", "snail_mailing_address"],
    "PHONE_NUMBER": ["office_phone", "Telephone", "automobile", "cell", "sim_cell", "telefax"],
    "PERSON": [
        "firstname", "Last.Name", "full_name_of_heir", "maiden_name", "nicknames", "card_holder_name", "prefname",
    ],
    "LOCATION": [
        "ship_to_address", "streetwise", "velocity", "real_estate", "zipper", "postal_box", "home_country",
        "lat", "lon", "latitudes", "max_longitude",
    ],
    "US_SSN": ["classname", "social_security_no", "taxid", "tax_id_of_firm", "ein", "cpf"],
    "DATE_TIME": ["adobe_version", "dob_text", "birthdate", "birth_dates"],
    "IP_ADDRESS": ["ipaddr", "ship_addr_x", "remote_addr_v6", "sign_in_ip_first"],
    "SECRET": ["encrypted_blob", "my_otp_secret", "encrypted_email_body", "confirmation_token_hash", "old_unlock_token"],
    "FREE_TEXT": ["messages", "somebody", "contented", "job_description", "keynotes", "comments", "metadata_2", "xchanges"],
    "CREDIT_CARD": ["creditcard", "card_numbers", "pan"],
    "FINANCIAL": ["routingnumber", "bank_accounts", "account_number_2"],
    "US_PASSPORT": ["passports", "driver-license", "driverslicense", "dl_number"],
    None: ["key", "made_at", "kind", "total", "span", "vein", "platform", "login", "surname_", "cells", "ipx", ""],
}


def test_column_names(spark):
    cases = [(entity, name) for entity, group in EXPECTED.items() for name in group]
    df = spark.createDataFrame([(n,) for _, n in cases], "n string")
    rows = df.select("n", names.classify_column_name(F.col("n")).alias("i")).collect()
    assert [(r["i"]["entity_type"] if r["i"] else None) for r in rows] == [e for e, _ in cases]
    for (entity, name), row in zip(cases, rows):
        driver = names.name_classification(name)
        assert (driver.entity_type if driver else None) == entity
        if driver:
            assert tuple(row["i"]) == (
                driver.entity_type, driver.confidence, driver.source, driver.is_free_text, driver.is_json
            )
            assert driver.confidence == (0.8 if entity == "FREE_TEXT" else 0.9)


def test_keys_are_never_free_text(spark):
    cases = {
        "description": None, "email_body": "EMAIL_ADDRESS", "notes": None, "EMAIL": "EMAIL_ADDRESS",
        "encrypted_message": "SECRET", "shipCity": "LOCATION", "": None,
    }
    df = spark.createDataFrame([(k,) for k in cases], "k string")
    got = {r[0]: r[1] for r in df.select("k", names.entity_of_key(F.col("k"))).collect()}
    assert got == cases
    assert {k: names.key_entity(k) for k in cases} == cases


def _examples(pattern):
    """Texts that a name pattern matches, one per way through it."""
    from itertools import product

    def ways(node):
        op, arg = node
        if op is sre.LITERAL:
            return [chr(arg)]
        if op is sre.ANY:
            return ["_"]
        if op is sre.AT:
            return [""]
        if op is sre.IN:
            return [chr(value) for _, value in arg]
        if op is sre.MAX_REPEAT:
            return [""] * (arg[0] == 0) + joined(arg[2])
        if op is sre.SUBPATTERN:
            return joined(arg[3])
        assert op is sre.BRANCH, op
        return [text for branch in arg[1] for text in joined(branch)]

    def joined(nodes):
        return ["".join(parts) for parts in product(*[ways(n) for n in nodes])]

    return joined(parser.parse(pattern))


def test_the_quick_test_knows_every_pattern(spark):
    texts = sorted({t for _, pattern in V.NAME_PATTERNS for t in _examples(pattern)})
    texts += [t.upper() for t in texts] + [f'{{"{t}": 1}}' for t in texts] + EXPECTED[None]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    quick = F.col("t").rlike(names.ANY_KEY_PATTERN)
    rows = df.select("t", quick.alias("q"), names.entity_of_key(F.col("t")).isNotNull().alias("e")).collect()
    assert [r["t"] for r in rows if r["q"] != r["e"]] == []
    assert sum(r["e"] for r in rows) > 150
