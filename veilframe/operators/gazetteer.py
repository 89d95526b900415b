"""Names in prose that no pattern describes, found with a list of them.

The list is a DataFrame ``(name, entity_type)``; names are runs of letters, one word or several
with what stands between them. A list can travel inside the expression, so that texts are
rewritten in place without a shuffle, or be joined with the phrases of the texts. The caller says
which; both give the same result.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.masks import label_by_entity, pseudonym_by_entity

WORD = r"[\p{L}\p{M}]+"
_GAP = r"[^\p{L}\p{M}]+"

# Longest list that may be put into the expression: a few hundred kilobytes of text.
INLINE_NAMES = 20_000


def _one_type_per_name(gazetteer: DataFrame) -> DataFrame:
    """Names with their type and their number of words; what holds no letter names nothing."""
    words = F.size(F.regexp_extract_all(F.col("name"), F.lit(WORD), F.lit(0)))
    names = gazetteer.groupBy("name").agg(F.min("entity_type").alias("entity_type"))
    names = names.withColumn("words", words).withColumn("first", F.regexp_extract("name", WORD, 0))
    return names.where("words > 0 AND entity_type IS NOT NULL")


#: Bits of a filter for each name in it, and at most; beyond that more phrases pass in vain, none is lost.
BITS_OF_NAME, MOST_BITS = 16, 1 << 27
_PROBES = 4


def _bits(name: Column, size: int) -> list[Column]:
    """The places of a name in a filter of ``size`` bits, a power of two."""
    low, high = F.xxhash64(name).bitwiseAND(0xFFFFFFFF), F.shiftrightunsigned(F.xxhash64(name), 32)
    return [(low + i * high).bitwiseAND(size - 1) for i in range(_PROBES)]


def _filter(names: DataFrame, count: int) -> Callable[[Column], Column]:
    """A test that every name of a DataFrame (``name``) passes and few other strings do: a Bloom filter.

    It is built by a job and travels in the expression, as whole numbers of 64 bits; ``MOST_BITS`` bounds
    what passes the driver.
    """
    size = 1024
    while size < min(BITS_OF_NAME * count, MOST_BITS):
        size *= 2
    bits = names.select(F.explode(F.array(*_bits(F.col("name"), size))).alias("bit"))
    one = F.call_function("shiftleft", F.lit(1).cast("long"), F.col("bit").bitwiseAND(63).cast("int"))
    words = bits.groupBy(F.shiftright("bit", 6).alias("at")).agg(F.bit_or(one).alias("word")).toArrow()
    packed = np.zeros(size // 64, np.int64)
    packed[words.column("at").to_numpy()] = words.column("word").to_numpy()
    jvm, gateway = names.sparkSession._jvm, names.sparkSession.sparkContext._gateway
    array = gateway.new_array(gateway.jvm.long, len(packed))
    jvm.java.nio.ByteBuffer.wrap(packed.astype(">i8").tobytes()).asLongBuffer().get(array)
    literal = Column(jvm.org.apache.spark.sql.functions.lit(array))

    def passes(name: Column) -> Column:
        def is_set(bit: Column) -> Column:
            word = F.get(literal, F.shiftright(bit, 6).cast("int"))
            return F.call_function("shiftrightunsigned", word, bit.bitwiseAND(63).cast("int")).bitwiseAND(1) == 1

        def probed(hash: Column) -> Column:
            low, high = hash.bitwiseAND(0xFFFFFFFF), F.shiftrightunsigned(hash, 32)
            hit = is_set(low.bitwiseAND(size - 1))
            for i in range(1, _PROBES):
                hit = hit & is_set((low + i * high).bitwiseAND(size - 1))
            return hit

        return _let(F.xxhash64(name), probed)

    return passes


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is worked out once."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _tokens(text: Column) -> Column:
    """Gap, word, gap, word, ..., gap, nothing: word ``i`` is at ``2 * i + 1``. The text is read once."""
    runs, nothing = F.regexp_extract_all(text, F.lit(f"{WORD}|{_GAP}"), F.lit(0)), F.lit("")
    before = F.when(text.rlike(rf"\A{_GAP}"), F.array().cast("array<string>")).otherwise(F.array(nothing))
    ends_in_word = F.substring(text, -1, 1).rlike(WORD)
    return F.concat(before, runs, F.when(ends_in_word, F.array(nothing, nothing)).otherwise(F.array(nothing)))


def _phrase(tokens: Column, place: Column, words: int) -> Column:
    if words == 1:
        return F.get(tokens, place * 2 + 1)
    return F.array_join(F.slice(tokens, place * 2 + 2, F.lit(2 * words - 1)), "")


def _places(tokens: Column, words: int) -> Column:
    """Where a phrase of so many words can start."""
    last = F.floor(F.size(tokens) / 2).cast("int") - 1 - words
    nowhere = F.array().cast("array<int>")
    return F.when(last >= 0, F.sequence(F.lit(0), last)).otherwise(nowhere)


def _rewritten(
    text: Column,
    sizes: list[int],
    entity_of: Callable[[Column, int], Column],
    style: str,
    seed: str | None,
    may_start: Callable[[Column], Column] | None = None,
) -> Column:
    """The text with every listed phrase replaced: the leftmost first, of those the longest.

    ``may_start`` holds for every word that a listed phrase starts with; others are not looked up.
    """

    def found(tokens: Column, words: int) -> Column:
        def judged(place: Column) -> Column:
            return _let(
                _phrase(tokens, place, words),
                lambda phrase: F.struct(
                    place.alias("place"),
                    F.lit(-words).alias("rank"),
                    phrase.alias("phrase"),
                    entity_of(phrase, words).alias("entity"),
                ),
            )

        places = _places(tokens, words)
        if may_start is not None:
            places = F.filter(places, lambda place: may_start(F.get(tokens, place * 2 + 1)))
        return F.filter(F.transform(places, judged), lambda hit: hit["entity"].isNotNull())

    def chosen(hits: Column) -> Column:
        """Hits that start before the end of the one chosen before are passed over."""
        start = F.struct(F.lit(0).alias("stop"), F.slice(hits, 1, 0).alias("taken"))

        def step(done: Column, hit: Column) -> Column:
            takes = F.struct(
                (hit["place"] - hit["rank"]).alias("stop"),
                F.concat(done["taken"], F.array(hit)).alias("taken"),
            )
            return F.when(hit["place"] >= done["stop"], takes).otherwise(done)

        return F.aggregate(hits, start, step, lambda done: done["taken"])

    def stop_of(hit: Column) -> Column:
        return (hit["place"] - hit["rank"]) * 2

    def joined(tokens: Column, hits: Column) -> Column:
        def piece(hit: Column, i: Column) -> Column:
            begin = F.coalesce(stop_of(F.get(hits, i - 1)), F.lit(0))
            before = F.array_join(F.slice(tokens, begin + 1, hit["place"] * 2 + 1 - begin), "")
            if style == "pseudonymize":
                new = pseudonym_by_entity(hit["phrase"], hit["entity"], seed)
            else:
                new = label_by_entity(hit["entity"])
            return F.concat(before, new)

        end = stop_of(F.element_at(hits, -1))
        rest = F.array_join(F.slice(tokens, end + 1, F.size(tokens) - end), "")
        return F.concat(F.array_join(F.transform(hits, piece), ""), rest)

    def whole(tokens: Column) -> Column:
        hits = F.sort_array(F.concat(*(found(tokens, words) for words in sizes)))
        if len(sizes) > 1 or sizes != [1]:
            hits = _let(hits, chosen)
        return _let(hits, lambda taken: F.when(F.size(taken) > 0, joined(tokens, taken)).otherwise(text))

    return F.when(text.isNotNull(), _let(_tokens(text), whole))


def redact_names(
    df: DataFrame,
    column: str,
    gazetteer: DataFrame,
    style: str = "partial",
    seed: str | None = None,
    how: str = "inline",
) -> DataFrame:
    """Replace the listed names in a text column, whole words in the spelling listed.

    ``how="inline"`` puts the list into the expression; more than ``INLINE_NAMES`` names are an
    error. ``how="join"`` takes a list of any length: a filter over the names travels in the
    expression, texts without a word that passes it are left where they are, and of the others the
    phrases that pass are joined with the list, and the texts with what was found. A name listed under
    several types takes the alphabetically first; of overlapping names the leftmost, then the
    longest, is taken.
    """
    names = _one_type_per_name(gazetteer)
    if how == "inline":
        # One row more than fits is enough to know that the list is too long.
        listed = names.limit(INLINE_NAMES + 1).collect()
        if len(listed) > INLINE_NAMES:
            raise ValueError(f"more than {INLINE_NAMES} names: use how='join'")
        return _inline(df, column, listed, style, seed)
    if how == "join":
        return _joined(df, column, names, style, seed)
    raise ValueError("how is 'inline' or 'join'")


def _inline(df, column, listed, style, seed) -> DataFrame:
    if not listed:
        return df
    by_size: dict[int, dict[str, list[str]]] = {}
    for name, entity, words, _ in listed:
        by_size.setdefault(words, {}).setdefault(entity, []).append(name)

    def entity_of(phrase: Column, words: int) -> Column:
        chain = F.when(F.lit(False), F.lit(""))
        for entity in sorted(by_size[words]):
            chain = chain.when(phrase.isin(by_size[words][entity]), F.lit(entity))
        return chain

    text = F.col(column)
    first = sorted({name_first for *_, name_first in listed})
    # Most texts hold no word that a listed name starts with, and are left alone.
    starts = F.exists(F.regexp_extract_all(text, F.lit(WORD), F.lit(0)), lambda word: word.isin(first))
    new = _rewritten(text, sorted(by_size), entity_of, style, seed)
    return df.withColumn(column, F.when(starts, new).otherwise(text))


def _joined(df, column, names, style, seed) -> DataFrame:
    starts, names = names.select(F.col("first").alias("name")), names.select("name", "entity_type", "words")
    counts = {r["words"]: r["count"] for r in names.groupBy("words").count().collect()}
    sizes, count = sorted(counts), sum(counts.values())
    if not sizes:
        return df
    may_start = _filter(starts, count)
    may_be = may_start if sizes == [1] else _filter(names, count)
    text = F.col(column)
    each_word = F.regexp_extract_all(text, F.lit(WORD), F.lit(0))
    likely = F.exists(each_word, may_start)
    # Both hashes of equal texts are equal, and no two texts share them by any chance that matters.
    key = F.struct(F.xxhash64(text).alias("a"), F.xxhash64(F.lit(1), text).alias("b"))

    def phrases(tokens: Column) -> Column:
        def of_size(words: int) -> Column:
            starts = F.filter(_places(tokens, words), lambda place: may_start(F.get(tokens, place * 2 + 1)))
            found = F.transform(starts, lambda place: _phrase(tokens, place, words))
            return found if words == 1 else F.filter(found, may_be)

        return F.array_distinct(F.concat(*map(of_size, sizes)))

    # Single words need no tokens between them, and a text that is not likely holds no phrase that passes.
    single = F.filter(F.array_distinct(each_word), may_start)
    passing = single if sizes == [1] else _let(_tokens(text), phrases)

    # What a text holds depends on the text alone, so rows need no key; equal texts are one.
    held = df.select(key.alias("key"), F.explode(passing).alias("name")).distinct()
    pair = F.struct(F.col("name"), F.col("entity_type"))
    hits = held.join(names, "name").groupBy("key").agg(F.map_from_entries(F.collect_set(pair)).alias("hits"))

    def entity_of(phrase: Column, words: int) -> Column:
        return F.try_element_at(F.col("hits"), phrase)

    marked = df.where(likely).select(F.struct("*").alias("row"), key.alias("key")).join(hits, "key", "left")
    text = F.col("row")[column]
    new = F.when(F.col("hits").isNull(), text).otherwise(_rewritten(text, sizes, entity_of, style, seed, may_start))
    done = marked.select("row", new.alias("new"))
    done = done.select(*((F.col("new") if c == column else F.col("row")[c]).alias(c) for c in df.columns))
    return df.where(~F.coalesce(likely, F.lit(False))).unionAll(done)
