"""Findings that do not overlap, of patterns and of a recogniser of one's own that runs in Python."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.prose import DEFAULT_RECOGNIZERS, Recognizer, may_have_findings
from ..functions.spans import SPANS, candidate_spans, replace_spans, standing_spans

_FOUND = "array<struct<entity_type:string,start:int,end:int,score:double>>"
_ARROW = pa.list_(pa.struct([("entity_type", pa.string()), ("start", pa.int32()), ("end", pa.int32()), ("score", pa.float64())]))


@dataclass(frozen=True)
class Hook:
    """A recogniser that no pattern can be, such as a model: texts in, spans out.

    ``find`` takes an Arrow array of texts and returns for each a list of ``(entity_type, start, end,
    score)``, places in code points. It sees only texts that match ``requires``, so other texts never
    leave the JVM. ``entities`` names its kinds, after those of the patterns.
    """

    find: Callable[[pa.Array], Sequence[Sequence[tuple[str, int, int, float]]]]
    requires: str
    entities: tuple[str, ...] = ()


def _with_spans(df: DataFrame, column: str, recognizers: Sequence[Recognizer], hook: Hook | None, name: str) -> DataFrame:
    """``df`` with the spans that stand in a column ``name``; without a hook no Python runs."""
    text = F.col(column).cast("string")
    order = [r.entity for r in recognizers] + list(hook.entities if hook else ())
    plain = standing_spans(candidate_spans(text, recognizers), order)
    if hook is None:
        return df.withColumn(name, plain)

    find = hook.find

    @F.arrow_udf(_FOUND)
    def found(texts: pa.Array) -> pa.Array:
        keys = ("entity_type", "start", "end", "score")
        return pa.array([[dict(zip(keys, s, strict=True)) for s in spans or ()] for spans in find(texts)], _ARROW)

    seen = F.coalesce(text.rlike(hook.requires), F.lit(False))
    more = F.transform(
        F.filter("more", lambda s: (s["start"] >= 0) & (s["end"] <= F.length(text)) & (s["end"] > s["start"])),
        lambda s: F.struct(
            s["entity_type"].alias("entity_type"), F.substring(text, s["start"] + 1, s["end"] - s["start"]).alias("value"),
            s["score"].alias("score"), s["start"].alias("start"), s["end"].alias("end"),
        ),
    ).cast(SPANS)
    asked = df.where(seen).withColumn("more", found(text))
    both = asked.withColumn(name, standing_spans(F.concat(candidate_spans(text, recognizers), more), order)).drop("more")
    return df.where(~seen).withColumn(name, plain).unionByName(both)


def find_standing(
    df: DataFrame,
    column: str,
    keep: Sequence[str] = (),
    recognizers: Sequence[Recognizer] = DEFAULT_RECOGNIZERS,
    hook: Hook | None = None,
) -> DataFrame:
    """One row per finding that stands, with the ``keep`` columns, kind, value, score and place."""
    given = df if hook is not None else df.where(may_have_findings(F.col(column), recognizers))
    spans = _with_spans(given, column, recognizers, hook, "spans_found")
    return spans.select(*keep, F.explode("spans_found").alias("f")).select(*keep, "f.*")


def redact_standing(
    df: DataFrame,
    column: str,
    recognizers: Sequence[Recognizer] = DEFAULT_RECOGNIZERS,
    hook: Hook | None = None,
    style: str = "partial",
    seed: str | None = None,
) -> DataFrame:
    """``df`` with every finding that stands replaced in a text column."""
    spans = _with_spans(df, column, recognizers, hook, "spans_found")
    return spans.withColumn(column, replace_spans(F.col(column).cast("string"), F.col("spans_found"), style, seed)).select(*df.columns)
