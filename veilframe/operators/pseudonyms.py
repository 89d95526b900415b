"""Pseudonyms that no two values share, from a table of numbers.

The pseudonyms of ``functions.masks`` hold a few digits of a hash and meet among many values. Here
every different value gets a number of its own: values are ordered by a keyed hash, which tells
nothing about them, and numbered in that order. The table of numbers can be kept, so that later
runs give the same pseudonyms and only new values get new numbers.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import vocabulary as V
from ..functions.masks import is_blank
from ..sources.writers import shared_folder

#: A value that takes more than one in so many places is looked up by a broadcast: there are fewer of them than this.
HEAVY = 1000
_NUMBERS = "scope string, key string, number long"


def _key(value: Column, seed: str) -> Column:
    """The keyed hash of a value; NULL for what stays as it is."""
    text = value.cast("string")
    return F.when(~is_blank(text), F.sha2(F.concat(F.lit(f"{seed}:"), text), 256))


def _spelled(number: Column, entity: str) -> Column:
    before, digits, after = V.PSEUDONYM_FORMATS.get(entity, V.PSEUDONYM_DEFAULT)
    written = F.lower(F.hex(number))
    padded = F.when(F.length(written) < digits, F.lpad(written, digits, "0")).otherwise(written)
    return F.concat(F.lit(before), padded, F.lit(after))


def _exists(spark: SparkSession, path: str) -> bool:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at)


def _written(df: DataFrame, path: str, mode: str = "errorifexists") -> DataFrame:
    df.write.mode(mode).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def _numbered(new: DataFrame, known: DataFrame, folder: str) -> DataFrame:
    """(``scope``, ``key``, ``number``) for new keys: in the order of the keys, after the numbers known.

    The keys are sorted in ranges. What a range adds to the numbers in it is a prefix sum over the
    counts of the ranges before: one row for each range, however many keys there are.
    """
    ordered = new.repartitionByRange("scope", "key").sortWithinPartitions("scope", "key")
    placed = _written(ordered.withColumn("place", F.monotonically_increasing_id()), f"{folder}/placed")
    placed = placed.withColumn("range", F.shiftright("place", 33))
    ranges = placed.groupBy("scope", "range").agg(F.min("place").alias("first"), F.count(F.lit(1)).alias("n"))
    before = Window.partitionBy("scope").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    last = known.groupBy("scope").agg((F.max("number") + 1).alias("start"))
    bases = ranges.select("scope", "range", "first", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    bases = bases.join(last, "scope", "left")
    # one row for each range of each scope, so it may be broadcast
    told = placed.join(F.broadcast(bases), ["scope", "range"])
    number = F.coalesce("start", F.lit(0)) + F.col("base") + F.col("place") - F.col("first")
    return told.select("scope", "key", number.cast("long").alias("number"))


def unique_pseudonyms(
    df: DataFrame, columns: Mapping[str, str], seed: str, store: str | None = None, folder: str | None = None
) -> DataFrame:
    """``df`` with the columns replaced by pseudonyms, equal where the values are and nowhere else.

    ``columns`` gives the entity type of each column to replace. Columns of one type share their
    numbers, so joins between them stay what they were. Null and blank values stay as they are.
    Pseudonyms have the usual form of their type, with more digits where there are more values.

    ``store`` names a folder that keeps the numbers between runs: values known there keep theirs,
    new ones are added. It holds keyed hashes, no values; one run at a time may add to it. Without
    it the numbers are those of this table alone. What is worked on is written below ``folder``, or
    the folder that the cluster shares.
    """
    spark = df.sparkSession
    folder = shared_folder(spark, "pseudonyms", folder)
    store = store or f"{folder}/numbers"
    entries = [F.struct(F.lit(entity).alias("scope"), _key(F.col(f"`{c}`"), seed).alias("key")) for c, entity in columns.items()]
    found = df.select(F.explode(F.array(*entries)).alias("e")).select("e.*").where("key IS NOT NULL")
    seen = _written(found.groupBy("scope", "key").agg(F.count(F.lit(1)).alias("n")), f"{folder}/seen")
    known = spark.read.schema(_NUMBERS).parquet(store) if _exists(spark, store) else spark.createDataFrame([], _NUMBERS)
    new = seen.select("scope", "key").join(known, ["scope", "key"], "left_anti")
    _numbered(new, known, folder).write.mode("append").parquet(store)
    numbers = spark.read.schema(_NUMBERS).parquet(store)
    places = seen.groupBy("scope").agg(F.sum("n").alias("places"))
    often = seen.join(F.broadcast(places), "scope").where(F.col("n") * HEAVY > F.col("places"))
    often = _written(often.join(numbers, ["scope", "key"]).select("scope", "key", "number"), f"{folder}/often")
    rest = numbers.join(often, ["scope", "key"], "left_anti")
    names = df.columns
    out = df.toDF(*[f"c{i}" for i in range(len(names))])
    for i, name in enumerate(names):
        if name not in columns:
            continue
        entity, value = columns[name], F.col(f"c{i}")
        keyed = out.withColumn("k", _key(value, seed))
        quick = often.where(F.col("scope") == entity).select(F.col("key").alias("k"), F.col("number").alias("quick"))
        keyed = keyed.join(F.broadcast(quick), "k", "left")
        # What has its number, or needs none, matches nothing below; it is dealt out by the whole row.
        dealt = F.when(F.col("k").isNull() | F.col("quick").isNotNull(), F.concat(F.lit("-"), F.xxhash64(*out.columns).cast("string")))
        keyed = keyed.withColumn("by", F.coalesce(dealt, F.col("k")))
        slow = rest.where(F.col("scope") == entity).select(F.col("key").alias("by"), F.col("number").alias("slow"))
        told = keyed.join(slow, "by", "left").withColumn("number", F.coalesce("quick", "slow"))
        replaced = F.when(F.col("number").isNull(), value.cast("string")).otherwise(_spelled(F.col("number"), entity))
        out = told.select(*[(replaced if c == f"c{i}" else F.col(c)).alias(c) for c in out.columns])
    return out.toDF(*names)
