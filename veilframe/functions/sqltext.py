"""Facts about SQL text held in a column, such as a query log."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import vocabulary as V


def writes_data(sql: Column) -> Column:
    """True where a word that changes something occurs anywhere in the statement."""
    return sql.rlike(rf"(?iU)\b({V.WRITE_WORDS})\b")


# A comment that is no hint, or anything in quotes.
_APART = r"""--[^\r\n]*+|/\*(?!\+)(?:[^*]|\*(?!/))*+\*/|'(?:[^'\\]|\\.)*+'|"(?:[^"\\]|\\.)*+"|`[^`]*+`"""
_OPENING = r"(?i)\A(?:[\s(]|'')*+(?:SELECT|FROM|WITH|VALUES|TABLE|SHOW|DESCRIBE|DESC|EXPLAIN)\b"


def refused_as(sql: Column) -> Column:
    """Why a statement of a log is no plain query, judged by its text alone, or NULL.

    ``write`` for a word that changes something outside quotes and comments, ``code`` for a function
    or clause that runs code (quoted or spelled by an expression too), ``several`` for more than one
    statement, ``open`` for a quote or comment without end or inside another, ``other`` for what opens
    with none of the reading words. For whole logs: ``plans.gate`` judges one statement by its plans.
    """
    bare = F.regexp_replace(sql, f"(?s){_APART}", "''")
    code = r"(?iU)\b(?:java_method|reflect|try_reflect)\s*+(?:''|`)?\s*+\(|\bTRANSFORM\b[\s\S]*\bUSING\b|\bIDENTIFIER\s*+\([^()]*+\)\s*+\("
    quoted = r"(?i)`\s*+(?:java_method|reflect|try_reflect)\s*+`"
    return (
        F.when(bare.rlike(rf"(?iU)\b(?:{V.WRITE_WORDS}|MERGE)\b"), F.lit("write"))
        .when(bare.rlike(code) | sql.rlike(quoted), F.lit("code"))
        .when(bare.rlike(r";[\s\S]*[^\s;]"), F.lit("several"))
        .when(F.regexp_replace(bare, "''|/\\*\\+|\\*/", "").rlike(r"""['"`]|/\*""") | (F.regexp_count(bare, F.lit(r"/\*\+")) != F.regexp_count(bare, F.lit(r"\*/"))), F.lit("open"))
        .when(~bare.rlike(_OPENING), F.lit("other"))
    )


def table_hints(sql: Column, default_schema: str = "public") -> Column:
    """Tables named after FROM or JOIN: qualified, lower case, once each, in order."""
    names = F.regexp_extract_all(sql, F.lit(f"(?iU){V.TABLE_AFTER_FROM_OR_JOIN}"), F.lit(1))
    return F.array_distinct(
        F.transform(
            names,
            lambda n: F.when(F.contains(n, F.lit(".")), F.lower(n)).otherwise(
                F.concat(F.lit(f"{default_schema}."), F.lower(n))
            ),
        )
    )


def tables_named(sql: str, default_schema: str = "public") -> list[str]:
    """``table_hints`` for one statement on the driver."""
    names = re.findall(V.TABLE_AFTER_FROM_OR_JOIN, sql, re.IGNORECASE)
    keys = (n.lower() if "." in n else f"{default_schema}.{n.lower()}" for n in names)
    return list(dict.fromkeys(keys))
