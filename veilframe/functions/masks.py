"""Masks for one value, as Columns.

``mask`` serves a column whose entity type is known when the plan is built;
``mask_by_entity`` serves values whose type is itself a column (JSON keys, map
keys, findings in prose). Both are plain expressions: no Python runs on the
executors and no mask needs a shuffle.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import vocabulary as V

# Whitespace as Unicode has it, with the four separator controls that Java leaves out.
_SPACE = r"[\s\x1C-\x1F]"
_NON_BLANK = r"(?U)[^\s\x1C-\x1F]"


def is_blank(text: Column) -> Column:
    """True for empty or whitespace-only text."""
    return ~text.rlike(_NON_BLANK)


def partial_generic(text: Column) -> Column:
    """First character, then one star per remaining character."""
    return F.when(F.length(text) <= 1, F.lit("***")).otherwise(
        F.rpad(F.substring(text, 1, 1), F.length(text), "*")
    )


# An address: first character of the local part, then of the domain before its last
# dot (2, or 5 where there is no dot), and the last dot with what follows it (3 or 4).
_ADDRESS = r"(?s)\A([^@]?)[^@]*+@(?:(.).*(\.[^.]*)|(\.[^.]*)|(.?)[^.]*)\z"


def partial_email(text: Column) -> Column:
    """``john@example.com`` -> ``j***@e***.com``."""
    masked = F.regexp_replace(text, _ADDRESS, r"$1***@$2$5***$3$4")
    return F.when(F.contains(text, F.lit("@")), masked).otherwise(partial_generic(text))


# Masks that keep the last four digits: what goes before them, and what stands for a
# value with fewer. Each step below uses the one before it once, so that no regular
# expression runs twice.
_TAILS = {
    "PHONE_NUMBER": ("***-***-", "***"),
    "US_SSN": ("***-**-", "***-**-****"),
    "CREDIT_CARD": ("****-****-****-", "****-****-****-****"),
}


def _tail(text: Column, before: Column, too_short: Column) -> Column:
    digits = F.regexp_replace(text, r"(?U)\D+", "")
    kept = F.regexp_replace(
        digits, F.lit(r"(?U)\A\d*(\d{4})\z"), F.concat(before, F.lit("$1"))
    )
    return F.regexp_replace(kept, F.lit(r"(?U)\A\d{0,3}\z"), too_short)


def _tail_of(entity: str) -> Callable[[Column], Column]:
    before, too_short = _TAILS[entity]
    return lambda text: _tail(text, F.lit(before), F.lit(too_short))


partial_phone = _tail_of("PHONE_NUMBER")  # (555) 123-4567 -> ***-***-4567
partial_ssn = _tail_of("US_SSN")  # 123-45-6789 -> ***-**-6789
partial_card = _tail_of("CREDIT_CARD")  # 4111 1111 1111 1111 -> ****-****-****-1111


def partial_financial(text: Column) -> Column:
    """``123456789`` -> ``*****6789``."""
    digits = F.regexp_replace(text, r"(?U)\D+", "")
    long_enough = F.regexp_replace(digits, r"(?U)\A\d{0,3}\z", "****")
    return F.regexp_replace(long_enough, r"(?U)\d(?=\d{4})", "*")


def partial_name(text: Column) -> Column:
    """``John Q Doe`` -> ``J*** Q*** D**``."""
    words = F.split(F.trim(F.regexp_replace(text, rf"(?U){_SPACE}+", " ")), " ")

    def starred(word: Column) -> Column:
        first = F.left(word, F.lit(1))
        return F.when(F.length(word) == 1, F.concat(first, F.lit("***"))).otherwise(
            F.rpad(first, F.length(word), "*")
        )

    return F.array_join(F.transform(words, starred), " ")


def partial_ip(text: Column) -> Column:
    """``192.168.1.100`` -> ``***.***.***.100``."""
    dots = F.length(text) - F.length(F.replace(text, F.lit("."), F.lit("")))
    return F.when(
        dots == 3, F.concat(F.lit("***.***.***."), F.substring_index(text, ".", -1))
    ).otherwise(F.lit("***.***.***. ***"))


def _street_number_hidden(text: Column) -> Column:
    return F.regexp_replace(text, r"(?U)^\d+", "***")


def partial_location(text: Column) -> Column:
    """``123 Main St`` -> ``*** Main St``; generic when no street number leads."""
    return F.when(text.rlike(r"(?U)^\d"), _street_number_hidden(text)).otherwise(
        partial_generic(text)
    )


# Entity types that have a mask of their own; every other type is masked generically.
PARTIAL_MASKS: dict[str, Callable[[Column], Column]] = {
    "EMAIL_ADDRESS": partial_email,
    "PHONE_NUMBER": partial_phone,
    "US_SSN": partial_ssn,
    "PERSON": partial_name,
    "CREDIT_CARD": partial_card,
    "IP_ADDRESS": partial_ip,
    "LOCATION": partial_location,
    "FINANCIAL": partial_financial,
}


def _require_seed(seed: str | None) -> str:
    if seed is None:
        raise ValueError("the pseudonymize style needs a seed; pass one in the policy")
    return seed


def _hash(text: Column, seed: str | None) -> Column:
    return F.sha2(F.concat(F.lit(_require_seed(seed) + ":"), text), 256)


def _pseudonym(digest: Column, entity: str) -> Column:
    before, hex_digits, after = V.PSEUDONYM_FORMATS.get(entity, V.PSEUDONYM_DEFAULT)
    return F.concat(F.lit(before), F.substring(digest, 1, hex_digits), F.lit(after))


def _keep_null_and_blank(text: Column, masked: Column) -> Column:
    return F.when(text.isNull() | is_blank(text), text).otherwise(masked)


def mask(value: Column, entity: str, style: str = "partial", seed: str | None = None) -> Column:
    """Mask ``value``, known to hold ``entity``. NULL and blank text stay as they are.

    The output is text, except under style ``none``. An unknown style masks partially.
    """
    if style == "none" and entity != V.SECRET:
        return value
    text = value.cast("string")
    if entity == V.SECRET:
        masked = F.lit(V.REDACTED)
    elif style == "full":
        masked = F.lit(V.label(entity))
    elif style == "pseudonymize":
        masked = _pseudonym(_hash(text, seed), entity)
    else:
        masked = PARTIAL_MASKS.get(entity, partial_generic)(text)
    return _keep_null_and_blank(text, masked)


def pseudonym_by_entity(text: Column, entity: Column, seed: str | None) -> Column:
    """Pseudonym whose format follows the entity type in another column."""
    before, hex_digits, after = (F.lit(part) for part in V.PSEUDONYM_DEFAULT)
    for known, form in V.PSEUDONYM_FORMATS.items():
        here = entity == known
        before = F.when(here, F.lit(form[0])).otherwise(before)
        hex_digits = F.when(here, F.lit(form[1])).otherwise(hex_digits)
        after = F.when(here, F.lit(form[2])).otherwise(after)
    return F.concat(before, F.left(_hash(text, seed), hex_digits), after)


def label_by_entity(entity: Column) -> Column:
    """``US_SSN`` -> ``[US SSN]`` for a type held in a column."""
    spaced = F.replace(entity, F.lit("_"), F.lit(" "))
    return F.concat(F.lit("["), F.upper(spaced), F.lit("]"))


def _partial_by_entity(text: Column, entity: Column) -> Column:
    """The partial mask for a type held in a column.

    Types that share a mask share one expression, and everything that ends in the
    generic mask falls through to a single one: a chain of all masks would compile to
    a method too large for the JVM to optimise.
    """
    tails = list(_TAILS.items())
    before, too_short = F.lit(tails[-1][1][0]), F.lit(tails[-1][1][1])
    for known, (prefix, short) in tails[:-1]:
        before = F.when(entity == known, F.lit(prefix)).otherwise(before)
        too_short = F.when(entity == known, F.lit(short)).otherwise(too_short)
    address = F.regexp_replace(text, _ADDRESS, r"$1***@$2$5***$3$4")
    return (
        F.when(entity.isin(*_TAILS), _tail(text, before, too_short))
        .when((entity == "EMAIL_ADDRESS") & F.contains(text, F.lit("@")), address)
        .when(entity == "PERSON", partial_name(text))
        .when(entity == "IP_ADDRESS", partial_ip(text))
        .when(entity == "FINANCIAL", partial_financial(text))
        .when((entity == "LOCATION") & text.rlike(r"(?U)^\d"), _street_number_hidden(text))
        .otherwise(partial_generic(text))
    )


def mask_by_entity(
    value: Column, entity: Column, style: str = "partial", seed: str | None = None
) -> Column:
    """``mask`` for values whose entity type is itself a column."""
    text = value.cast("string")
    if style == "none":
        masked = text
    elif style == "full":
        masked = label_by_entity(entity)
    elif style == "pseudonymize":
        masked = pseudonym_by_entity(text, entity, seed)
    else:
        masked = _partial_by_entity(text, entity)
    masked = F.when(entity == V.SECRET, F.lit(V.REDACTED)).otherwise(masked)
    return _keep_null_and_blank(text, masked)
