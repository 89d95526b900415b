"""Quality rules: distances between a text's histograms and those of languages.

DataFrame and SQL functions only. A text's character classes and common words are counted, their shares
pooled into one reference per language, and compared by Jensen-Shannon distance.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut

# Common words of four languages.
COMMON = {
    "en": "the of and to in is that for with it",
    "fr": "de la le et les des en un une que",
    "de": "der die und in den von zu das mit sich",
    "es": "de la que el en y a los se del",
}
WORDS = sorted({w for words in COMMON.values() for w in words.split()})
#: Character classes, as regular expressions; what is in none of them is a class of its own. Letters of scripts
#: without capitals, and marks on letters, count with the small ones, so one reference serves all scripts.
CLASSES = {"small": r"[\p{Ll}\p{Lo}\p{Lm}\p{M}]+", "capital": r"\p{Lu}+", "digit": r"\p{N}+", "space": r"[\x20\x09-\x0D]+", "symbol": r"[#*$%&|<>]+"}
SPACE, SPACES = " \t\n\x0b\x0c\r", r"[\x20\x09-\x0D]+"
WINDOW = 8
#: Trusted references: shares per 10,000, of the character classes and of some words, as means over clean documents.
FIXED = {
    "en": ((7935, 146, 12, 1662, 0, 245), "the 642 of 366 and 270 to 204 a 155 in 140 is 119 that 105 it 97 for 86 with 66"),
    "fr": ((7928, 147, 19, 1662, 0, 244), "de 619 la 378 le 253 et 206 les 162 des 144 en 131 un 106 une 79 que 77"),
    "de": ((8092, 134, 8, 1545, 0, 221), "der 617 die 361 und 264 in 202 den 163 von 131 zu 110 das 108 mit 92 sich 82"),
    "es": ((7992, 144, 10, 1615, 0, 239), "de 631 la 355 que 257 el 197 en 163 y 136 los 115 se 99 del 88 un 81"),
}
#: Shares are summed as whole numbers of this unit, so that the sums do not depend on the order.
UNIT = 1 << 30


def let(value: Column, body) -> Column:
    """``body`` of ``value``, which is computed once."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def covered(hashes: Column) -> Column:
    """How many words the windows cover whose hash stands in ``hashes`` more than once."""

    def twice(pairs):
        def same(x, j):
            left, right = F.get(pairs, j - 1)["h"], F.get(pairs, j + 1)["h"]
            return F.coalesce(left == x["h"], F.lit(False)) | F.coalesce(right == x["h"], F.lit(False))

        return F.sort_array(F.transform(F.filter(pairs, same), lambda x: x["i"]))

    pairs = F.sort_array(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    start = F.struct(F.lit(0).alias("stop"), F.lit(0).alias("n"))

    def add(done, i):
        stop = i + WINDOW
        return F.struct(stop.alias("stop"), (done["n"] + stop - F.greatest(i, done["stop"])).alias("n"))

    return F.aggregate(let(pairs, twice), start, add, lambda done: done["n"])


def repeated_words(words: Column) -> Column:
    """Words inside windows of eight that the text holds twice or more, the first included."""

    def windows(hashes):
        return F.transform(F.sequence(F.lit(1), F.size(hashes) - (WINDOW - 1)), lambda i: F.xxhash64(F.slice(hashes, i, F.lit(WINDOW))))

    def count(hashes):
        return F.when(F.size(F.array_distinct(hashes)) < F.size(hashes), covered(hashes)).otherwise(0)

    long = F.when(F.size(words) > WINDOW, let(F.transform(words, lambda w: F.xxhash64(w)), lambda h: let(windows(h), count)))
    return F.coalesce(long, F.lit(0))


def measured(df: DataFrame, text_col: str = "text", carry: tuple[str, ...] = ()) -> DataFrame:
    """(``rest``, the columns of ``df`` or those to ``carry``, and what the rules read of each text); a null text has no words."""
    text = F.coalesce(df[text_col].cast("string"), F.lit(""))
    trimmed = F.btrim(text, F.lit(SPACE))
    words = F.when(trimmed == "", F.array().cast("array<string>")).otherwise(F.split(trimmed, SPACES))
    given = df.select(F.struct(*(carry or ["*"])).alias("rest"), text.alias("text"), words.alias("words"))
    full = F.filter(F.split("text", "\n"), lambda line: line.rlike(r"[^\x20\x09-\x0D]"))
    total = F.length("text")

    def of_class(pattern):
        return total - F.length(F.regexp_replace("text", pattern, ""))

    classes = [of_class(p).cast("double") for p in CLASSES.values()]
    common = F.filter(F.transform("words", lambda w: F.lower(F.btrim(w, F.lit(".,;:!?")))), lambda w: w.isin(WORDS))

    def times(one):
        return lambda w: w == one

    counts = let(common, lambda found: F.array(*(F.size(F.filter(found, times(one))).cast("double") for one in WORDS)))
    first = given.select(
        "rest",
        F.size("words").cast("long").alias("n_words"),
        total.cast("double").alias("n_chars"),
        F.array(*classes).alias("classes"),
        let(full, lambda lines: F.size(lines) - F.size(F.array_distinct(lines))).cast("long").alias("n_dup_lines"),
        repeated_words(F.col("words")).cast("long").alias("n_repeat_words"),
        counts.alias("common"),
    )
    place = list(CLASSES).index
    return first.select(
        "rest",
        "n_words",
        (F.col("n_chars") - F.get("classes", F.lit(place("space")))).cast("long").alias("word_chars"),
        F.get("classes", F.lit(place("symbol"))).cast("long").alias("n_symbols"),
        "n_dup_lines",
        "n_repeat_words",
        F.concat("classes", F.array(F.col("n_chars") - F.aggregate("classes", F.lit(0.0), lambda a, b: a + b))).alias("classes"),
        F.concat("common", F.array(F.col("n_words") - F.aggregate("common", F.lit(0.0), lambda a, b: a + b))).alias("common"),
    )


def fixed(lang: str) -> tuple[list[float], list[float]]:
    """The shares of FIXED: of the character classes, and of WORDS and the rest."""
    classes, given = FIXED[lang]
    words = given.split()
    of = dict(zip(words[::2], map(int, words[1::2]), strict=True))
    common = [of.get(w, 0) / 10_000 for w in WORDS]
    return [c / 10_000 for c in classes], [*common, 1 - sum(common)]


def primary(lang: Column) -> Column:
    """The language that a tag opens with, in small letters; null for what names none (empty, ``und``)."""
    first = F.lower(F.regexp_extract(lang.cast("string"), r"\A\s*([A-Za-z]*)", 1))
    return F.when(~first.isin("", "und"), first)


def references(measures: DataFrame, near: dict[str, Column], weight: float) -> dict[str, tuple[list[float], list[float]]]:
    """For each language of COMMON the mean shares of what is ``near`` its trusted reference, which counts as ``weight`` documents.

    Every document counts alike, however long. The sums are combined before the shuffle, and a row
    for each of the four languages reaches the driver.
    """
    sizes = {"classes": len(CLASSES) + 1, "common": len(WORDS) + 1}
    of = F.lit(None).cast("string")
    for lang, is_near in near.items():
        of = F.when(is_near, F.lit(lang)).otherwise(of)
    pooled = measures.where(~base_failed()).select(
        of.alias("of"), *(F.transform(shares(F.col(c)), lambda v: F.round(v * UNIT).cast("long")).alias(c) for c in sizes)
    )
    totals = [F.sum(F.get(c, F.lit(i))).alias(f"{c}{i}") for c, n in sizes.items() for i in range(n)]
    rows = pooled.where("of IS NOT NULL").groupBy("of").agg(F.count("*").alias("n"), *totals).collect()
    sums = {r["of"]: r for r in rows}
    out = {}
    for lang in COMMON:
        n = sums[lang]["n"] if lang in sums else 0
        out[lang] = tuple(
            [((sums[lang][f"{c}{i}"] / UNIT if n else 0.0) + weight * share) / (n + weight) for i, share in enumerate(known)]
            for c, known in zip(sizes, fixed(lang), strict=True)
        )
    return out


def base_failed() -> Column:
    """The base rules: too few words, or too many of them repeated."""
    return (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))


def shares(counts: Column) -> Column:
    return let(F.aggregate(counts, F.lit(0.0), lambda a, b: a + b), lambda n: F.transform(counts, lambda c: c / F.greatest(n, F.lit(1.0))))


def distance(counts: Column, reference: Column) -> Column:
    """Jensen-Shannon distance (0 to 1) between counts and the shares of a reference."""

    def part(p, m):
        return F.when(p > 0, p * F.log2(p / m)).otherwise(0.0)

    terms = F.zip_with(shares(counts), reference, lambda p, q: part(p, (p + q) / 2) + part(q, (p + q) / 2))
    return F.sqrt(F.greatest(F.aggregate(terms, F.lit(0.0), lambda a, b: a + b) / 2, F.lit(0.0)))


def judge_quality(
    df: DataFrame,
    text_col: str = "text",
    lang_col: str = "lang",
    max_class_distance: float = 0.2,
    max_common_distance: float = 0.24,
    min_chars: int = 200,
    min_words: int = 100,
    carry: tuple[str, ...] = (),
    trusted_documents: float = 20,
) -> DataFrame:
    """``rest`` (the columns of ``df``, or those to ``carry``, ``lang_col`` among them) with the measures, both distances, ``base_failed`` and ``kept``.

    A text is dropped if the base rules fail, or if there is no language of ``COMMON`` whose reference is
    near enough in both its character classes (texts of ``min_chars`` characters in words) and its common
    words (texts of ``min_words`` words). A reference is the mean of the shares of all documents of the
    language that are near enough to its trusted one (``FIXED``), which counts as ``trusted_documents``: no
    junk makes a reference, and no number of documents turns a test on or off.

    A text of another language by ``lang_col`` is held against the same references in its character classes,
    but not in its common words, since the listed ones are not its own; its ``common_distance`` is null. Of
    a tag, only the language it opens with is read (``en-US`` is ``en``); null, empty and ``und`` count as
    any of the four. Null and empty texts have no words, so the base rules drop them.
    """
    measures = cut(measured(df, text_col, carry))
    lang = primary(F.col("rest")[lang_col])

    def against(classes, common):
        """(excess, distance of classes, of common words, excess of classes): an excess is over 0 where the text is too far."""
        pair = F.struct(distance(F.col("classes"), classes).alias("classes"), distance(F.col("common"), common).alias("common"))
        over_classes = lambda d: F.when(F.col("word_chars") >= min_chars, d["classes"] - max_class_distance).otherwise(-1.0)
        over_common = lambda d: F.when(F.col("n_words") >= min_words, d["common"] - max_common_distance).otherwise(-1.0)
        return let(
            pair,
            lambda d: F.struct(
                F.greatest(over_classes(d), over_common(d)).alias("excess"), d["classes"].alias("classes"), d["common"].alias("common"), over_classes(d).alias("apart")
            ),
        )

    def held(reference):
        return against(*(F.array(*map(F.lit, part)) for part in reference))

    near = {c: (lang == c) & (held(fixed(c))["excess"] <= 0) for c in COMMON}
    ways = F.array(*map(held, references(measures, near, trusted_documents).values()))
    of_four = lang.isNull() | lang.isin(list(COMMON))
    by_class = F.transform(ways, lambda w: F.struct(w["apart"].alias("excess"), w["classes"].alias("classes"), F.lit(None).cast("double").alias("common")))
    by_both = F.transform(ways, lambda w: F.struct(w["excess"], w["classes"], w["common"]))
    counts = ["rest", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
    judged = measures.select(*counts, F.array_min(F.when(of_four, by_both).otherwise(by_class)).alias("nearest"))
    return judged.select(
        *counts, base_failed().alias("base_failed"), F.col("nearest.classes").alias("class_distance"), F.col("nearest.common").alias("common_distance"),
        (~base_failed() & ~(F.col("nearest.excess") > 0)).alias("kept"),
    )


def keep_good(df: DataFrame, text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """The rows of ``df`` that ``judge_quality`` keeps, unchanged."""
    judged = judge_quality(df, text_col, lang_col).where("kept")
    return judged.select(*(F.col("rest")[c].alias(c) for c in df.columns))
