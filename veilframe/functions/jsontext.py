"""Masking of JSON held as text, of any shape, without parsing it into a tree.

The text is read as a row of tokens: a key if there is one, its string value (or a
bare string), and whatever follows up to the next quote. Brackets, commas and numbers
are passed through, so key order, number formatting and spacing survive. There is no
depth at which masking stops.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import vocabulary as V
from .masks import mask_by_entity
from .names import ANY_KEY_PATTERN, entity_of_key
from .prose import (
    DEFAULT_RECOGNIZERS,
    PREFILTER,
    Recognizer,
    has_findings,
    is_telling,
    redact_text,
)

_STRING = r'"[^"\\]*+(?:\\.[^"\\]*+)*+"'
_SCALAR = r"-?[0-9][0-9.eE+\-]*+|true|false"


def _token(literal: str) -> str:
    """Groups: the key with its colon (or nothing), the value (or nothing), the rest."""
    return rf'(?s)(?=")((?:{_STRING}\s*+:\s*+)?+)((?:{literal})?+)([^"]*+)'


_TOKEN = _token(_STRING)
_TOKEN_WITH_SCALARS = _token(f"{_STRING}|{_SCALAR}")


# One string, with colon and string value if it is a key, or one bracket; then what follows it.
_STEP = rf'(?s)(?:{_STRING}(?:\s*+:\s*+(?:{_STRING})?+)?+|[\[\]{{}}])[^"\[\]{{}}]*+'
_KEY_OF_OTHER = rf'(?s)\A{_STRING}\s*+:\s*+(?!")'
_ANY_SCALAR = rf"{_SCALAR}|NaN|-?Infinity"
_SCAN = "struct<at:int,depth:int,hidden:int,waiting:boolean,first:int,spans:array<struct<first:int,last:int>>>"


def _bind(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use`` of a value that is worked out once, however often it reads it."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def _hide_secrets(text: Column) -> Column:
    """A JSON text with the numbers, arrays and objects behind secret keys replaced, at any depth and size.

    The text is read as steps, each with one bracket at most. A scan over the steps counts how many
    brackets are open; a container behind a secret key ends where the count is back at what it was.
    """

    def kind_of(step: Column) -> Column:
        first = F.substring(step, 1, 1)
        other = step.rlike(_KEY_OF_OTHER) & (_entity_of(step) == V.SECRET)
        key = F.when(step.rlike(r":\s*+\z"), F.lit("key")).otherwise(F.lit("scalar"))
        return F.when(first.isin("[", "{"), F.lit("open")).when(first.isin("]", "}"), F.lit("close")).when(other, key)

    def scan(state: Column, kind: Column) -> Column:
        opens, closes = F.coalesce(kind == "open", F.lit(False)), F.coalesce(kind == "close", F.lit(False))
        starts = opens & state["waiting"] & (state["hidden"] < 0)
        ends = closes & (state["hidden"] == state["depth"] - 1)
        span = F.struct(state["first"].alias("first"), state["at"].alias("last"))
        return F.struct(
            (state["at"] + 1).alias("at"),
            (state["depth"] + F.when(opens, 1).when(closes, -1).otherwise(0)).alias("depth"),
            F.when(starts, state["depth"]).when(ends, F.lit(-1)).otherwise(state["hidden"]).alias("hidden"),
            F.coalesce(kind == "key", F.lit(False)).alias("waiting"),
            F.when(starts, state["at"]).otherwise(state["first"]).alias("first"),
            F.when(ends, F.concat(state["spans"], F.array(span))).otherwise(state["spans"]).alias("spans"),
        )

    def rebuilt(steps: Column, kinds: Column, spans: Column) -> Column:
        hide = rf'(?s)\A({_STRING}\s*+:\s*+)(?:{_ANY_SCALAR})'
        shown = F.zip_with(
            steps, kinds, lambda s, k: F.when(k == "scalar", F.regexp_replace(s, hide, f'$1"{V.REDACTED}"')).otherwise(s)
        )

        def joined(shown: Column) -> Column:
            def piece(span: Column, i: Column) -> Column:
                begin = F.when(i > 0, F.get(spans, i - 1)["last"] + 2).otherwise(1)
                before = F.slice(shown, begin, span["first"] + 1 - begin)
                return F.concat(F.array_join(before, ""), F.lit(f'"{V.REDACTED}"'), F.substr(F.get(steps, span["last"]), F.lit(2)))

            rest = F.when(F.size(spans) > 0, F.element_at(spans, -1)["last"] + 2).otherwise(1)
            tail = F.array_join(F.slice(shown, rest, F.size(shown)), "")
            return F.concat(F.array_join(F.transform(spans, piece), ""), tail)

        return _bind(shown, joined)

    start = F.struct(
        F.lit(0).alias("at"), F.lit(0).alias("depth"), F.lit(-1).alias("hidden"), F.lit(False).alias("waiting"),
        F.lit(0).alias("first"), F.array().cast("array<struct<first:int,last:int>>").alias("spans"),
    ).cast(_SCAN)

    def scanned(steps: Column) -> Column:
        def over(kinds: Column) -> Column:
            spans = F.aggregate(kinds, start, lambda s, k: scan(s, k).cast(_SCAN), lambda s: s["spans"])
            return _bind(spans, lambda found: rebuilt(steps, kinds, found))

        return _bind(F.transform(steps, kind_of), over)

    before = F.regexp_extract(text, r'\A[^"\[\]{}]*+', 0)
    return F.concat(before, _bind(F.regexp_extract_all(text, F.lit(_STEP), F.lit(0)), scanned))


def is_json(text: Column) -> Column:
    """True where the text is one JSON document.

    Strings are blanked first, so their content cannot upset the test, and NaN and
    Infinity count as numbers.
    """
    skeleton = F.regexp_replace(text, rf"(?s){_STRING}", '""')
    skeleton = F.regexp_replace(skeleton, r"-?\bInfinity\b|\bNaN\b", "0")
    alone = F.json_array_length(F.concat(F.lit("["), skeleton, F.lit("]"))) == 1
    return F.coalesce(alone, F.lit(False)) & ~F.contains(skeleton, F.lit("'"))


def looks_like_json(text: Column) -> Column:
    """True where the text is a JSON object or array."""
    return text.rlike(r"^\s*[\[{]") & is_json(text)


def _decoded(literal: Column) -> Column:
    return F.from_json(F.concat(F.lit("["), literal, F.lit("]")), "array<string>")[0]


def _unescape(literal: Column) -> Column:
    """Text of a JSON string literal; the raw characters if an escape is malformed."""
    raw = F.substr(literal, F.lit(2), F.length(literal) - 2)
    return F.when(
        F.contains(literal, F.lit("\\")), F.coalesce(_decoded(literal), raw)
    ).otherwise(raw)


def _entity_of(before: Column) -> Column:
    """Entity of a key as it stands in the text, quotes and colon included.

    The patterns search inside a name, so what surrounds it makes no difference; only
    an escaped key has to be decoded.
    """
    literal = F.regexp_extract(before, rf"(?s)\A({_STRING})", 1)
    escaped = F.contains(before, F.lit("\\"))
    return entity_of_key(F.when(escaped, _unescape(literal)).otherwise(before))


def _escape(text: Column) -> Column:
    """Text as a JSON string literal."""
    return F.regexp_extract(F.to_json(F.array(text)), r"(?s)\A\[(.*)\]\z", 1)


def json_text_keys(text: Column) -> Column:
    """Distinct keys of a JSON text, at every depth; none where the text is no JSON."""
    before = F.regexp_extract_all(text, F.lit(_TOKEN), F.lit(1))
    literals = F.transform(
        F.filter(before, lambda b: b != ""),
        lambda b: F.regexp_extract(b, rf"(?s)\A({_STRING})", 1),
    )
    distinct = F.array_distinct(F.transform(literals, _unescape))
    return F.when(is_json(text), distinct).otherwise(F.array().cast("array<string>"))


def mask_json_text(
    text: Column,
    style: str = "partial",
    seed: str | None = None,
    reveal_types: Iterable[str] = (),
    recognizers: Sequence[Recognizer] = DEFAULT_RECOGNIZERS,
    mask_scalars: bool = False,
    secrets_only: bool = False,
    default: str | None = None,
) -> Column:
    """Mask the strings of a JSON text by key, and by content where the key is neutral.

    Whatever stands behind a secret key is replaced: strings, numbers, arrays and objects. Strings
    that no key classifies are taken for a ``default`` type if one is given.

    Text that is no JSON is treated as prose. ``mask_scalars`` also masks numbers and
    booleans under a classified key. ``secrets_only`` serves a revealed column: all
    but secret keys pass.
    """
    revealed = sorted(set(reveal_types) - {V.SECRET})
    return _bind(
        text.cast("string"),
        lambda given: _masked(given, style, seed, revealed, recognizers, mask_scalars, secrets_only, default),
    )


def _masked(text, style, seed, revealed, recognizers, mask_scalars, secrets_only, default) -> Column:
    token = _TOKEN_WITH_SCALARS if mask_scalars else _TOKEN

    # Each step is a struct of its own, so that nothing is worked out twice.
    def read(before: Column, literal: Column) -> Column:
        return F.struct(
            before.alias("before"),
            literal.alias("literal"),
            F.when(literal.startswith('"'), _unescape(literal)).otherwise(literal).alias("value"),
            F.coalesce(
                F.when((before != "") & (literal != ""), _entity_of(before)),
                F.when(literal.startswith('"'), F.lit(default).cast("string")),
            ).alias("entity"),
        )

    def judged(part: Column) -> Column:
        literal, value, entity = part["literal"], part["value"], part["entity"]
        by_key = mask_by_entity(value, entity, style, seed)
        if secrets_only:
            new = F.when(entity == V.SECRET, by_key)
        else:
            in_prose = literal.startswith('"') & is_telling(value, recognizers)
            new = (
                F.when(entity.isin(revealed), value)
                .when(entity.isNotNull(), by_key)
                .when(in_prose, redact_text(value, style, seed, revealed, recognizers))
            )
        return F.struct(
            part["before"].alias("before"),
            literal.alias("literal"),
            value.alias("value"),
            new.alias("new"),
        )

    def rebuilt(part: Column, rest: Column) -> Column:
        # A value that does not change keeps the spelling it has.
        same = part["new"].isNull() | (part["new"] == part["value"])
        literal = F.when(same, part["literal"]).otherwise(_escape(part["new"]))
        return F.concat(part["before"], literal, rest)

    def tokens_of(text: Column) -> Column:
        return F.struct(*[F.regexp_extract_all(text, F.lit(token), F.lit(n)).alias(f"g{n}") for n in (1, 2, 3)])

    def joined(groups: Column) -> Column:
        parts = F.transform(F.zip_with(groups["g1"], groups["g2"], read), judged)
        return F.array_join(F.zip_with(parts, groups["g3"], rebuilt), "")

    def without_hidden(groups: Column) -> Column:
        # What stands behind a secret key and is no string is replaced first, and the tokens read again.
        other = F.zip_with(groups["g1"], groups["g2"], lambda b, v: (b != "") & (v == "") & (_entity_of(b) == V.SECRET))
        secret = F.exists(other, lambda o: F.coalesce(o, F.lit(False)))
        return _bind(F.when(secret, _bind(_hide_secrets(text), tokens_of)).otherwise(groups), joined)

    masked = F.concat(F.substring_index(text, '"', 1), _bind(tokens_of(text), without_hidden))
    # Text with no classified key and no telling value is left alone. Escapes hide either,
    # so a text with escapes is always read.
    suspect = text.rlike(ANY_KEY_PATTERN) | F.contains(text, F.lit("\\")) | F.lit(default is not None)
    if secrets_only:
        return F.when(suspect & is_json(text), masked).otherwise(text)
    anywhere = tuple(recognizers) + tuple(r for r in PREFILTER if r not in recognizers)
    suspect = suspect | has_findings(text, anywhere)
    as_prose = redact_text(text, style, seed, revealed, recognizers)
    return F.when(suspect, F.when(is_json(text), masked).otherwise(as_prose)).otherwise(text)
