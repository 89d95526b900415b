"""Redaction of a whole DataFrame by policy: one projection, no shuffle.

The plan is made on the driver from the schema alone, before any row is read, and
becomes one ``select``. Filters and column pruning therefore still reach the scan.
"""

from __future__ import annotations

from collections.abc import Iterable, Sequence
from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import vocabulary as V
from ..functions.masks import mask
from ..functions.names import JSON_CLASSIFICATION, Classification, name_classification
from ..functions.nested import (
    NestedStyle,
    each_element,
    entity_by_name,
    is_json_like,
    json_text,
    mask_nested,
)
from ..functions.prose import redact_text
from ..plans.lineage import TAG, owner_of
from ..policy import EXCLUDED, Policy

STATUS = "redaction"
# Ways to know of a container what all in it is.
_GIVEN = ("manual", "lineage", "mixed")


@dataclass(frozen=True)
class ColumnPlan:
    """What happens to one output column."""

    position: int
    name: str
    info: Classification | None
    style: str
    revealed: bool

    @property
    def status(self) -> str | None:
        """``MASKED: TYPE``, ``UNMASKED`` or None for a column that is not personal."""
        if self.info is None:
            return None
        return "UNMASKED" if self.revealed else f"MASKED: {self.info.entity_type}"


# The stricter of two types comes first; types not listed stand between the listed ones and texts.
_STRICTEST = (
    V.SECRET, "US_SSN", "US_PASSPORT", "CREDIT_CARD", "FINANCIAL", "PHONE_NUMBER", "EMAIL_ADDRESS", "PERSON",
    "DATE_TIME", "LOCATION", "IP_ADDRESS",
)
_MILDEST = (V.JSON_CONTAINER, V.FREE_TEXT)
# Styles from the one that shows all to the one that shows nothing.
_STYLE_ORDER = ("none", "partial", "pseudonymize", "full")


def _strictness(info: Classification) -> tuple[int, str]:
    if info.entity_type in _STRICTEST:
        return _STRICTEST.index(info.entity_type), ""
    if info.entity_type in _MILDEST:
        return len(_STRICTEST) + 1 + _MILDEST.index(info.entity_type), ""
    return len(_STRICTEST), info.entity_type


@dataclass(frozen=True)
class _Part:
    """What one column that is in an output column asks for."""

    info: Classification
    style: str


def _parts(
    name: str, sources: Sequence[tuple[str, str]], policy: Policy, tables: Sequence[str]
) -> tuple[list[_Part], bool]:
    """What the sources of a computed column, its own rule and its name ask for; whether all sources are excluded.

    An exclusion speaks for its own column alone: it asks for nothing, and hides no other part.
    """
    parts = []
    for source in sources:
        info, _ = policy.resolve(source[1], [source])
        if info is not None:
            parts.append(_Part(replace(info, source="lineage"), policy.style(*source)))
    excluded = bool(sources) and all(policy.entry(*s) == EXCLUDED for s in sources)
    for table in tables:
        entry = policy.entry(table, name)
        if isinstance(entry, Classification):
            parts.append(_Part(entry, policy.style(table, name)))
    named = name_classification(name)
    if named is not None and (named.entity_type == V.SECRET or not excluded):
        style = next((policy.style(t, name) for t in tables if (policy.table_key(t), name.lower()) in policy.styles), policy.default_style)
        parts.append(_Part(named, style))
    return parts, excluded


def _joined(parts: Sequence[_Part]) -> _Part | None:
    """The least that is as strict as every part: its strictest type and style, a label where types differ."""
    if not parts:
        return None
    strictest = min(parts, key=lambda p: _strictness(p.info))
    style = max((p.style for p in parts), key=_STYLE_ORDER.index)
    if len({p.info.entity_type for p in parts}) > 1:
        # No mask is right for two types: each may show what the other hides.
        return _Part(replace(strictest.info, source="mixed", is_free_text=False, is_json=False), "full")
    return _Part(strictest.info, style)


def plan_columns(
    schema: T.StructType,
    policy: Policy,
    tables: Sequence[str] = (),
    reveal_columns: Iterable[str] = (),
    reveal_types: Iterable[str] = (),
    made_of: Sequence[Iterable[tuple[str, str]]] | None = None,
) -> list[ColumnPlan]:
    """Decide for every column; columns are told apart by position, not by name.

    A column's lineage tag names its owner, whose decision holds under any name but a secret one.
    ``made_of`` gives the base columns that a computed column is made of (``column_owners``). It is
    as strict as the strictest of them, of its own rule and of what its name tells, in type and in
    style; of several types it is a label, as it is where it may be a piece of a value. It is shown only if all of them may be shown. Without either,
    the tables given are asked in order. Secrets are never revealed.
    """
    shown = {name.lower() for name in reveal_columns}
    shown_types = set(reveal_types)
    plans = []
    for position, field in enumerate(schema.fields):
        tagged = owner_of(field)
        sources = sorted(made_of[position]) if made_of else []
        computed = bool(sources) and sources != [tagged]
        if computed:
            parts, excluded = _parts(field.name, sources, policy, tables)
            whole = _joined(parts)
            info, style = (whole.info, whole.style) if whole else (None, policy.default_style)
            cut = any(policy.resolve(s[1], [s])[0] for s in getattr(made_of[position], "pieces", ()))
            if info is not None and style == "partial" and cut and not info.is_free_text:
                style = "full"  # a piece may be so short that a partial mask shows it
                info = replace(info, source="mixed", is_json=False)
            types = {p.info.entity_type for p in parts}
        else:
            info, owner = policy.resolve(field.name, [tagged] if tagged else [(t, field.name) for t in tables])
            excluded = owner is not None and info is None and policy.entry(*owner) is not None
            style = policy.style(*owner) if owner else policy.default_style
            named = name_classification(field.name)
            if named is not None and named.entity_type == V.SECRET and not (excluded and owner[1].lower() == field.name.lower()):
                info = named
            types = {info.entity_type} if info else set()
        if is_json_like(field.dataType) and not (excluded and info is None):
            if info is None or (info.source not in _GIVEN and info.entity_type != V.SECRET):
                info = JSON_CLASSIFICATION
        if info is None:
            plans.append(ColumnPlan(position, field.name, None, "none", False))
            continue
        secret = info.entity_type == V.SECRET
        revealed = not secret and (field.name.lower() in shown or (types or {info.entity_type}) <= shown_types)
        plans.append(ColumnPlan(position, field.name, info, "full" if secret else style, revealed))
    return plans


def _nested_entity(field: T.StructField, policy: Policy) -> str | None:
    """A rule on a struct field counts if the field is tagged; else its name does."""
    owner = owner_of(field)
    entry = policy.entry(*owner) if owner else None
    if isinstance(entry, Classification):
        return entry.entity_type
    return entity_by_name(field) if entry is None else None


def _column(
    value: Column, dtype: T.DataType, plan: ColumnPlan, policy: Policy, reveal_types: frozenset[str]
) -> Column:
    info = plan.info
    if info is None:
        return value
    if info.entity_type == V.SECRET and is_json_like(dtype):
        return F.when(value.isNotNull(), F.lit(V.REDACTED))
    raw = plan.revealed or plan.style == "none"
    by_rule = info.source in _GIVEN and not (info.is_json or info.is_free_text)
    if info.is_json or is_json_like(dtype):
        # A JSON column that is shown still hides the secrets inside it.
        how = NestedStyle(
            "full" if raw else plan.style,
            policy.seed,
            reveal_types,
            policy.recognizers,
            policy.mask_json_scalars,
            secrets_only=raw,
            default=info.entity_type if by_rule else None,
            entity_of=lambda field: _nested_entity(field, policy),
        )
        if is_json_like(dtype):
            return mask_nested(value, dtype, how)
        return each_element(value, dtype, lambda v: json_text(v, how))
    if raw:
        return value
    if info.is_free_text:
        return each_element(
            value,
            dtype,
            lambda v: redact_text(v, plan.style, policy.seed, reveal_types, policy.recognizers),
        )
    return each_element(
        value, dtype, lambda v: mask(v, info.entity_type, plan.style, policy.seed)
    )


def redact(
    df: DataFrame,
    policy: Policy,
    tables: Sequence[str] = (),
    reveal_columns: Iterable[str] = (),
    reveal_types: Iterable[str] = (),
    made_of: Sequence[Iterable[tuple[str, str]]] | None = None,
) -> DataFrame:
    """Mask ``df`` by ``policy``; works on batch and streaming DataFrames alike.

    ``made_of`` is what ``column_owners`` tells of the columns of ``df``.

    Masked columns come out as text (JSON-like ones keep their type). Each output
    column carries its status in its metadata.
    """
    reveal_types = frozenset(reveal_types)
    plans = plan_columns(df.schema, policy, tables, reveal_columns, reveal_types, made_of)
    by_position = df.toDF(*[f"c{p.position}" for p in plans])
    out = []
    for plan, field in zip(plans, df.schema.fields):
        value = F.col(f"c{plan.position}")
        metadata = {k: v for k, v in (field.metadata or {}).items() if k == TAG}
        if plan.status:
            metadata[STATUS] = plan.status
        out.append(
            _column(value, field.dataType, plan, policy, reveal_types).alias(
                plan.name, metadata=metadata
            )
        )
    return by_position.select(*out)


def annotations(df: DataFrame) -> list[tuple[str, str]]:
    """``(column, status)`` of a redacted DataFrame, personal columns only."""
    return [(f.name, f.metadata[STATUS]) for f in df.schema.fields if STATUS in (f.metadata or {})]


def annotation_frame(spark: SparkSession, plans: Sequence[ColumnPlan]) -> DataFrame:
    """The plan as a small DataFrame: position, column, status, entity type."""
    rows = [(p.position, p.name, p.status, p.info.entity_type if p.info else None) for p in plans]
    return spark.createDataFrame(
        rows, "position int, column_name string, status string, entity_type string"
    )
