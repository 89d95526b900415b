"""Classification of names: columns, and keys inside JSON."""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import vocabulary as V

CLASSIFICATION_DDL = (
    "struct<entity_type:string,confidence:double,source:string,"
    "is_free_text:boolean,is_json:boolean>"
)


@dataclass(frozen=True)
class Classification:
    """What one column holds, how sure we are, and who says so."""

    entity_type: str
    confidence: float
    source: str  # heuristic | values | manual
    is_free_text: bool = False
    is_json: bool = False


# Secrets are looked for first so that no other hit can expose one.
_KEY_ORDER = tuple(p for p in V.NAME_PATTERNS if p[0] == V.SECRET) + tuple(
    p for p in V.NAME_PATTERNS if p[0] != V.SECRET
)
_COLUMN_ORDER = (_KEY_ORDER[0], (V.FREE_TEXT, V.FREE_TEXT_NAMES)) + _KEY_ORDER[1:]

# Any text without one of these holds no classified key. Every name pattern starts with
# one of the letters looked for first, which spares the others the whole alternation.
_FIRST_LETTERS = "[a-fhilm-pr-uz]"
ANY_KEY_PATTERN = (
    f"(?iU)(?={_FIRST_LETTERS})(?:" + "|".join(pattern for _, pattern in V.NAME_PATTERNS) + ")"
)


def _first_match(name: Column, ordered: tuple[tuple[str, str], ...]) -> Column:
    chain = F.when(F.lit(False), F.lit(None).cast("string"))
    for entity, pattern in ordered:
        chain = chain.when(name.rlike(f"(?iU){pattern}"), F.lit(entity))
    return chain


def entity_of_key(key: Column) -> Column:
    """Entity type of a JSON or map key, or NULL. Keys are never free text.

    Most keys say nothing, and one pattern tells them from the others.
    """
    return F.when(key.rlike(ANY_KEY_PATTERN), _first_match(key, _KEY_ORDER))


def entity_of_column_name(name: Column) -> Column:
    """Entity type of a column name, ``FREE_TEXT`` included, or NULL."""
    return _first_match(name, _COLUMN_ORDER)


def classify_column_name(name: Column) -> Column:
    """The classification struct for a column name; NULL when it says nothing."""
    entity = entity_of_column_name(name)
    free = entity == V.FREE_TEXT
    info = F.struct(
        entity.alias("entity_type"),
        F.when(free, F.lit(V.FREE_TEXT_CONFIDENCE))
        .otherwise(F.lit(V.NAME_CONFIDENCE))
        .alias("confidence"),
        F.lit("heuristic").alias("source"),
        F.coalesce(free, F.lit(False)).alias("is_free_text"),
        F.lit(False).alias("is_json"),
    )
    return F.when(entity.isNotNull(), info).otherwise(F.lit(None).cast(CLASSIFICATION_DDL))


def key_entity(key: str) -> str | None:
    """``entity_of_key`` for a struct field name known on the driver."""
    return next((e for e, p in _KEY_ORDER if re.search(p, key, re.IGNORECASE)), None)


def name_classification(name: str) -> Classification | None:
    """``classify_column_name`` for a schema field known on the driver."""
    entity = next((e for e, p in _COLUMN_ORDER if re.search(p, name, re.IGNORECASE)), None)
    if entity is None:
        return None
    if entity == V.FREE_TEXT:
        return Classification(entity, V.FREE_TEXT_CONFIDENCE, "heuristic", is_free_text=True)
    return Classification(entity, V.NAME_CONFIDENCE, "heuristic")


JSON_CLASSIFICATION = Classification(
    V.JSON_CONTAINER, V.JSON_CONFIDENCE, "heuristic", is_json=True
)
