"""Findings of several recognisers that may overlap, and which of them stand.

Each recogniser is looked for by itself, so a long number is an account to one and holds a telephone
number to another. Of spans that overlap the one with the best score stands, then the longest, then the
one whose kind is named first, then the leftmost.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from .masks import label_by_entity, pseudonym_by_entity
from .prose import DEFAULT_RECOGNIZERS, Recognizer, positioned_findings

SPANS = "array<struct<entity_type:string,value:string,score:double,start:int,end:int>>"


def _let(value: Column, use: Callable[[Column], Column]) -> Column:
    return F.get(F.transform(F.array(value), use), F.lit(0))


def candidate_spans(text: Column, recognizers: Sequence[Recognizer] = DEFAULT_RECOGNIZERS) -> Column:
    """The findings of every recogniser by itself, with places; empty for NULL."""
    found = [F.coalesce(positioned_findings(text, [r]), F.array().cast(SPANS)) for r in recognizers]
    return F.concat(*found).cast(SPANS)


def _overlap(a: Column, b: Column) -> Column:
    return (a["start"] < b["end"]) & (b["start"] < a["end"])


def standing_spans(spans: Column, order: Iterable[str] = ()) -> Column:
    """Of an array of spans those that stand, by place; ``order`` names kinds, of equal spans the first stands.

    Where nothing overlaps, which one look at neighbours tells, the spans are passed on. Else they are
    taken best first, each unless it overlaps one taken. Kinds that ``order`` does not name come last,
    by name. Spans without extent stand for nothing.
    """
    place = {entity: i for i, entity in reversed(list(enumerate(order)))}

    def by_place(all_spans: Column) -> Column:
        return F.transform(F.sort_array(F.transform(all_spans, lambda s: F.struct(s["start"], s["end"], s.alias("s")))), lambda x: x["s"])

    def ranked(all_spans: Column) -> Column:
        known = F.lit(len(place))
        if place:
            table = F.create_map(*[F.lit(x) for pair in place.items() for x in pair])

            def number(s: Column) -> Column:
                return F.coalesce(F.try_element_at(table, s["entity_type"]), known)
        else:

            def number(s: Column) -> Column:
                return known

        keyed = F.transform(
            all_spans,
            lambda s: F.struct((-s["score"]).alias("a"), (s["start"] - s["end"]).alias("b"), number(s).alias("c"), s["entity_type"].alias("d"), s["start"].alias("e"), s.alias("s")),
        )
        return F.transform(F.sort_array(keyed), lambda x: x["s"])

    def apart(sorted_spans: Column) -> Column:
        follows = F.transform(sorted_spans, lambda s, i: F.coalesce(F.get(sorted_spans, i + 1)["start"] >= s["end"], F.lit(True)))
        return F.forall(follows, lambda ok: ok)

    def taken(all_spans: Column) -> Column:
        def step(kept: Column, s: Column) -> Column:
            free = ~F.exists(kept, lambda k: _overlap(k, s))
            return F.when(free, F.concat(kept, F.array(s))).otherwise(kept)

        return F.aggregate(ranked(all_spans), F.array().cast(SPANS), step)

    real = F.filter(spans, lambda s: s["end"] > s["start"])
    return _let(_let(real, by_place), lambda ordered: F.when(apart(ordered), ordered).otherwise(by_place(taken(ordered))))


def replace_spans(text: Column, spans: Column, style: str = "partial", seed: str | None = None) -> Column:
    """``text`` with spans that stand, in order of place, replaced by their label or pseudonym."""

    def joined(found: Column) -> Column:
        def piece(s: Column, i: Column) -> Column:
            begin = F.when(i > 0, F.get(found, i - 1)["end"]).otherwise(0)
            new = pseudonym_by_entity(s["value"], s["entity_type"], seed) if style == "pseudonymize" else label_by_entity(s["entity_type"])
            return F.concat(F.substring(text, begin + 1, s["start"] - begin), new)

        rest = F.substring(text, F.element_at(found, -1)["end"] + 1, F.length(text))
        return F.concat(F.array_join(F.transform(found, piece), ""), rest)

    return F.when(F.size(spans) > 0, _let(spans, joined)).otherwise(text)
