"""Personal data inside prose: find it, label it, replace it.

All recognisers run as one alternation, leftmost match first and earlier
recognisers winning at the same place. One pass matters for pseudonyms: a
pseudonymous e-mail address is itself an e-mail address, so replacing type by
type would replace it twice. What ``findings`` lists is what ``redact_text``
replaces.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterable, Sequence
from dataclasses import dataclass
from functools import reduce
from itertools import groupby

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import vocabulary as V
from .masks import label_by_entity, pseudonym_by_entity


@dataclass(frozen=True)
class Recognizer:
    """One kind of personal data in prose.

    ``lead`` is a pattern that matches where every hit starts, such as a character class, and
    ``requires`` one that every text with a hit contains; both only save work. ``check`` drops hits that
    fail a checksum: ``luhn`` on the digits, or ``iban`` on digits and letters.
    """

    entity: str
    pattern: str
    score: float
    check: str | None = None
    lead: str | None = None
    requires: str | None = None


_DIGIT_LEAD = r"[\d(]"
_TWO_DIGITS = r"\d[\d.]"
_OCTET = r"(?:25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)"
_LOCAL = r"[a-zA-Z0-9._%+\-]"

# The e-mail shape, written so that a long run of word characters without an "@"
# is read once instead of once per character: a match can only start where a run
# starts, or right behind the previous match.
_EMAIL = rf"(?:\G|(?<!{_LOCAL})){_LOCAL}++" + V.EMAIL_SHAPE[V.EMAIL_SHAPE.index("@") :]

DEFAULT_RECOGNIZERS: tuple[Recognizer, ...] = (
    Recognizer("EMAIL_ADDRESS", _EMAIL, 1.0, requires="@"),
    Recognizer(
        "PHONE_NUMBER",
        f"{V.PHONE_SHAPE}|{V.PHONE_PARENS_SHAPE}",
        0.75,
        lead=_DIGIT_LEAD,
        requires=_TWO_DIGITS,
    ),
    Recognizer("US_SSN", V.SSN_SHAPE, 0.85, lead=_DIGIT_LEAD, requires=_TWO_DIGITS),
    Recognizer("CREDIT_CARD", V.CARD_SHAPE, 0.8, lead=_DIGIT_LEAD, requires=_TWO_DIGITS),
    Recognizer(
        "IP_ADDRESS",
        rf"\b(?:{_OCTET}\.){{3}}{_OCTET}\b",
        0.6,
        lead=_DIGIT_LEAD,
        requires=_TWO_DIGITS,
    ),
)

# Where a hit of the kinds below can start, telephone numbers apart: at the start of a word that has a
# capital, a digit or a colon early, or is the scheme of an address. Cheaper than their word boundaries.
_WORD_START = r"(?<![0-9A-Za-z_])(?:[A-Z]{1,2}[0-9]|[0-9]|https?:|[0-9a-fA-F]{1,4}:)"

# More kinds, for those who ask for them: they match more that is not personal. Of several
# that match at a place the first counts.
EXTENDED_RECOGNIZERS: tuple[Recognizer, ...] = (
    DEFAULT_RECOGNIZERS[0],
    Recognizer("URL", r"\bhttps?://[^\s<>\"']+", 0.6, lead=_WORD_START, requires="://"),
    Recognizer("IBAN_CODE", r"\b[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?\b", 0.9, check="iban", lead=_WORD_START, requires=r"[A-Z]{2}[0-9]{2}"),
    Recognizer("IPV6_ADDRESS", r"\b(?:[0-9a-fA-F]{1,4}:){7}[0-9a-fA-F]{1,4}\b|\b(?:[0-9a-fA-F]{1,4}:){1,6}(?::[0-9a-fA-F]{1,4}){1,6}\b", 0.6, lead=_WORD_START, requires="[0-9a-fA-F]:[0-9a-fA-F:]"),
    Recognizer("US_ITIN", r"\b9\d{2}-[5-9]\d-\d{4}\b", 0.85, lead=_WORD_START, requires=_TWO_DIGITS),
    DEFAULT_RECOGNIZERS[2],
    Recognizer("US_PASSPORT", r"\b[A-Z]\d{8}\b", 0.4, lead=_WORD_START, requires=_TWO_DIGITS),
    Recognizer("US_DRIVER_LICENSE", r"\b[A-Z]\d{7}\b", 0.3, lead=_WORD_START, requires=_TWO_DIGITS),
    DEFAULT_RECOGNIZERS[4],
    Recognizer("CREDIT_CARD", r"\b\d(?:[ \-]?\d){12,18}\b", 0.8, check="luhn", lead=_DIGIT_LEAD, requires=_TWO_DIGITS),
    Recognizer(
        "PHONE_NUMBER",
        rf"\+\d{{1,3}}[ .\-]?(?:\(\d{{1,4}}\)[ .\-]?)?\d(?:[ .\-]?\d){{6,11}}\b|{V.PHONE_SHAPE}|{V.PHONE_PARENS_SHAPE}|\b\d{{10}}\b",
        0.5,
        lead=r"[(+\d]",
        requires=_TWO_DIGITS,
    ),
)


def _alternation(recognizers: Sequence[Recognizer]) -> str:
    parts = []
    for lead, group in groupby(recognizers, key=lambda r: r.lead):
        body = "|".join(f"(?:{r.pattern})" for r in group)
        parts.append(f"(?={lead})(?:{body})" if lead else body)
    return "(?U)" + "|".join(parts)


def _contains(text: Column, needed: str) -> Column:
    if re.escape(needed) == needed:
        return F.contains(text, F.lit(needed))
    return text.rlike(f"(?U){needed}")


def has_findings(text: Column, recognizers: Sequence[Recognizer] = DEFAULT_RECOGNIZERS) -> Column:
    """True where a recogniser matches; cheap tests go first when there are any.

    The cheap tests stay apart: one pattern joining them would be read more slowly.
    """
    needing = [r for r in recognizers if r.requires is not None]
    found = may_have_findings(text, needing) & text.rlike(_alternation(needing)) if needing else F.lit(False)
    # A recogniser without a cheap test is looked for by itself, and spares the others nothing.
    other = [r for r in recognizers if r.requires is None]
    return found | text.rlike(_alternation(other)) if other else found


def may_have_findings(text: Column, recognizers: Sequence[Recognizer] = DEFAULT_RECOGNIZERS) -> Column:
    """The cheap tests alone: no text with a finding fails them."""
    needed = {r.requires for r in recognizers}
    if None in needed:
        return text.isNotNull()
    return reduce(Column.__or__, [_contains(text, n) for n in sorted(needed)])


# The value test applied to a string inside JSON before its prose is scanned.
_TELLING = ("EMAIL_ADDRESS", "PHONE_NUMBER", "US_SSN", "CREDIT_CARD")
PREFILTER = tuple(r for r in DEFAULT_RECOGNIZERS if r.entity in _TELLING)


def contains_pii(text: Column) -> Column:
    """True where the text holds something shaped like personal data."""
    return has_findings(text, PREFILTER)


def is_telling(text: Column, recognizers: Sequence[Recognizer]) -> Column:
    """``contains_pii``, extended by the recognisers that are not built in."""
    own = tuple(r for r in recognizers if r not in DEFAULT_RECOGNIZERS)
    return has_findings(text, PREFILTER + own)


def _entity_of_hit(hit: Column, recognizers: Sequence[Recognizer]) -> Column:
    chain = F.when(F.lit(False), F.lit(""))
    for r in recognizers[:-1]:
        chain = chain.when(hit.rlike(rf"(?U)\A(?:{r.pattern})\z"), F.lit(r.entity))
    return chain.otherwise(F.lit(recognizers[-1].entity))


def _is_iban(hit: Column) -> Column:
    """The first four characters go last, letters count from 10, and 97 leaves a rest of 1."""
    plain = F.replace(hit, F.lit(" "), F.lit(""))
    turned = F.split(F.concat(F.substr(plain, F.lit(5)), F.left(plain, F.lit(4))), "")

    def add(rest: Column, char: Column) -> Column:
        value = F.conv(char, 36, 10).cast("int")
        return (rest * F.when(value > 9, 100).otherwise(10) + value) % 97

    return F.aggregate(F.filter(turned, lambda c: c != ""), F.lit(0), add) == 1


_CHECKS: dict[str, Callable[[Column], Column]] = {
    "luhn": lambda hit: F.call_function("luhn_check", F.regexp_replace(hit, r"(?U)\D", "")),
    "iban": _is_iban,
}


def _passes_check(hit: Column, entity: Column, recognizers: Sequence[Recognizer]) -> Column | None:
    passed = None
    for r in recognizers:
        if r.check:
            fine = (entity != r.entity) | _CHECKS[r.check](hit)
            passed = fine if passed is None else passed & fine
    return passed


def _hits(text: Column, recognizers: Sequence[Recognizer]) -> Column:
    """Every match with its entity, in text order, checksum not yet applied."""
    raw = F.regexp_extract_all(text, F.lit(_alternation(recognizers)), F.lit(0))
    return F.transform(
        raw,
        lambda h: F.struct(h.alias("value"), _entity_of_hit(h, recognizers).alias("entity_type")),
    )


def findings(text: Column, recognizers: Sequence[Recognizer] = DEFAULT_RECOGNIZERS) -> Column:
    """Array of ``(entity_type, value, score)``, one per finding, in text order."""
    empty = F.array().cast("array<struct<entity_type:string,value:string,score:double>>")
    return F.when(has_findings(text, recognizers), all_findings(text, recognizers)).otherwise(empty)


def all_findings(text: Column, recognizers: Sequence[Recognizer] = DEFAULT_RECOGNIZERS) -> Column:
    """``findings`` without a test before, for texts that have most likely some; NULL for NULL."""
    scores = F.create_map(*[F.lit(x) for r in recognizers for x in (r.entity, float(r.score))])
    hits = _hits(text, recognizers)
    if any(r.check for r in recognizers):
        hits = F.filter(hits, lambda h: _passes_check(h["value"], h["entity_type"], recognizers))
    return F.transform(
        hits,
        lambda h: F.struct(
            h["entity_type"].alias("entity_type"),
            h["value"].alias("value"),
            F.element_at(scores, h["entity_type"]).alias("score"),
        ),
    )


# Positions are summed up in runs of this many findings, then across the runs, so
# that a text with very many findings stays linear.
_RUN = 100


def _let(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)``, with ``value`` worked out once however often it is used."""
    return F.element_at(F.transform(F.array(value), use), 1)


def positioned_findings(
    text: Column, recognizers: Sequence[Recognizer] = DEFAULT_RECOGNIZERS
) -> Column:
    """``findings`` with the zero-based start and end of each, in characters."""
    scores = F.create_map(*[F.lit(x) for r in recognizers for x in (r.entity, float(r.score))])
    empty = F.array().cast(
        "array<struct<entity_type:string,value:string,score:double,start:int,end:int>>"
    )

    def item(finding: Column, start: Column) -> Column:
        return F.struct(
            finding["entity_type"].alias("entity_type"),
            finding["value"].alias("value"),
            finding["score"].alias("score"),
            start.alias("start"),
            (start + F.length(finding["value"])).alias("end"),
        )

    def step(state: Column, span: Column) -> Column:
        found = F.struct(
            span["e"].alias("entity_type"),
            span["value"].alias("value"),
            F.element_at(scores, span["e"]).alias("score"),
        )
        start = state["past"] + span["gap"]
        return F.struct(
            (start + F.length(span["value"])).alias("past"),
            F.concat(state["found"], F.array(item(found, start))).alias("found"),
        )

    def run_of(spans: Column, first: Column) -> Column:
        nothing = F.struct(F.lit(0).alias("past"), empty.alias("found"))
        return F.aggregate(F.slice(spans, first, _RUN), nothing, step)

    def joined(runs: Column) -> Column:
        starts = F.aggregate(
            runs,
            F.array(F.lit(0)),
            lambda sums, run: F.concat(sums, F.array(F.element_at(sums, -1) + run["past"])),
        )
        return F.flatten(
            F.zip_with(
                runs,
                starts,
                lambda run, at: F.transform(
                    F.coalesce(run["found"], empty), lambda f: item(f, f["start"] + at)
                ),
            )
        )

    spans = F.zip_with(
        F.transform(F.split(text, _alternation(recognizers), -1), lambda p: F.length(p)),
        _hits(text, recognizers),
        lambda gap, h: F.struct(
            gap.alias("gap"), h["value"].alias("value"), h["entity_type"].alias("e")
        ),
    )
    walked = _let(
        F.filter(spans, lambda s: s["value"].isNotNull()),
        lambda closed: _let(
            F.transform(
                F.sequence(F.lit(1), F.greatest(F.size(closed), F.lit(1)), F.lit(_RUN)),
                lambda first: run_of(closed, first),
            ),
            joined,
        ),
    )
    if any(r.check for r in recognizers):
        walked = F.filter(walked, lambda h: _passes_check(h["value"], h["entity_type"], recognizers))
    return F.when(has_findings(text, recognizers), walked).otherwise(empty)


def redact_text(
    text: Column,
    style: str = "partial",
    seed: str | None = None,
    reveal_types: Iterable[str] = (),
    recognizers: Sequence[Recognizer] = DEFAULT_RECOGNIZERS,
) -> Column:
    """Replace every finding in ``text``; revealed types stay as they are.

    Style ``pseudonymize`` puts pseudonyms in place, every other style the label:
    a partial mask in running text would keep too much.
    """
    revealed = set(reveal_types)
    active = [r for r in recognizers if r.entity not in revealed]
    text = text.cast("string")
    if not active:
        return text

    def replacement(hit: Column) -> Column:
        value, entity = hit["value"], hit["entity_type"]
        if style == "pseudonymize":
            new = pseudonym_by_entity(value, entity, seed)
        else:
            new = label_by_entity(entity)
        passes = _passes_check(value, entity, active)
        return new if passes is None else F.when(passes, new).otherwise(value)

    rebuilt = F.zip_with(
        F.split(text, _alternation(active), -1),
        F.transform(_hits(text, active), replacement),
        lambda piece, new: F.concat(piece, F.coalesce(new, F.lit(""))),
    )
    return F.when(has_findings(text, active), F.array_join(rebuilt, "")).otherwise(text)


__all__ = [
    "DEFAULT_RECOGNIZERS",
    "Recognizer",
    "contains_pii",
    "findings",
    "has_findings",
    "is_telling",
    "positioned_findings",
    "redact_text",
]
