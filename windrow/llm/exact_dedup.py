"""Exact duplicates by two-pass Bloom filtering, in DataFrame operations."""

from __future__ import annotations

import uuid
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import drop_since, mark, put_aside, shared_dir, written

#: Filter words of 64 bits: bounds on what is broadcast at once (a word has 16 bytes there).
LEAST_WORDS, MOST_WORDS = 1 << 14, 1 << 21
#: A group with at least this share of all rows gets its verdict by broadcast: there are no more than HOT such groups.
HOT = 1000
#: The characters of [\x20\x09-\x0D].
BLANKS = " \t\n\x0b\x0c\r"


def without(text: Column, chars: str) -> Column:
    """text without any of these characters."""
    return reduce(lambda t, c: F.replace(t, F.lit(c), F.lit("")), chars, text)


def _bits(key: Column, words: int) -> tuple[Column, Column]:
    """A key's word in the filter, and the mask of its two bits there."""
    h = F.xxhash64(key, F.lit(1))
    bit = lambda x: F.call_function("shiftleft", F.lit(1).cast("bigint"), F.pmod(x, F.lit(64)).cast("int"))
    return F.pmod(F.xxhash64(key, F.lit(0)), F.lit(words)), bit(h).bitwiseOR(bit(F.shiftright(h, 20)))


def repeated_filter(keys: DataFrame, words: int) -> DataFrame:
    """First pass: (word, bits) with the bits that two rows or more have set. keys: one column, `key`.

    Rows of a word are combined before they are shuffled: bits seen, and bits seen again. A word's rows are folded in any order: what two
    parts have both seen is seen again."""
    word, mask = _bits(F.col("key"), words)
    # equal masks first: a group is one row with the number of its keys, so that or-ing different masks counts each once
    masks = keys.select(word.alias("word"), mask.alias("mask")).groupBy("word", "mask").agg((F.count("*") > 1).alias("twice"))
    fold = """aggregate(collect_list(struct(mask, twice)), struct(0L AS seen, 0L AS again), (s, x) -> struct(
        s.seen | x.mask AS seen, s.again | (s.seen & x.mask) | CASE WHEN x.twice THEN x.mask ELSE 0L END AS again), s -> s.again)"""
    return masks.groupBy("word").agg(F.expr(fold).alias("bits")).where("bits <> 0")


def exact_dedup(df: DataFrame, text_col: str = "text", id_col: str = "doc_id", keep: list[str] | None = None, words: int | None = None) -> DataFrame:
    """df's rows with the columns `keep` (by default all), keep_id, group_size, kept and text_sha256.

    Texts are equal when identical after all of [\\x20\\x09-\\x0D] is deleted; null counts as empty. Of equal texts the row of
    the most code points in the original text, then the smallest id, stays (keep_id; null only if all ids are null).
    Of rows equal in id and length too, any one stays. Columns of df that have a result's name, in any case, are replaced; no
    other name clashes. Texts of any length. An empty table gives an empty one.

    Texts are hashed once, into a table with the columns to keep. First pass: which filter bits are set twice. Second pass: a row whose
    bits are not all among those is unique and passes straight through; the others, the truly repeated and a few false
    positives, are grouped exactly by SHA-256. A filter has 16 bits a row and `words` (MOST_WORDS) words at most; more rows than one can
    take are dealt to ranges of the hash, with a filter for each, one after another. A group's verdict is made from partial
    aggregates; those of large groups are broadcast (at most HOT, by their size), so no group's rows meet in one task.
    """
    spark = df.sparkSession
    aside, back = put_aside(df, ("keep_id", "group_size", "kept", "text_sha256"), keep)
    text = F.coalesce(df[f"`{text_col}`"], F.lit(""))
    n = df.select(F.lit(1)).count()
    most = words or MOST_WORDS
    ranges = max(1, -(-n // (4 * most)))
    per = min(most, max(1 if words else LEAST_WORDS, 1 << max(0, n // (4 * ranges) - 1).bit_length()))
    rows = df.select(*aside, df[f"`{id_col}`"].alias("id__"), F.sha2(without(text, BLANKS).cast("binary"), 256).alias("sha__"), F.char_length(text).cast("bigint").alias("length__"))
    rows = rows.withColumn("row__", F.monotonically_increasing_id()).withColumn("range__", F.pmod(F.xxhash64("sha__", F.lit(2)), F.lit(ranges)).cast("int"))
    rows = written(rows, "hashed", by="range__" if ranges > 1 else None)
    word, mask = _bits(F.col("sha__"), per)
    found = ("keep_id", "group_size", "kept")

    def told(part: DataFrame) -> DataFrame:
        seen = F.broadcast(repeated_filter(part.select(F.col("sha__").alias("key")), per).select(F.col("word").alias("word__"), F.col("bits").alias("seen__")))
        marked = part.withColumn("word__", word).join(seen, "word__", "left").withColumn("again__", F.coalesce(F.col("seen__").bitwiseAND(mask) == mask, F.lit(False)))
        alone = marked.where(~F.col("again__")).select(*back, F.col("id__").alias("keep_id"), F.lit(1).cast("bigint").alias("group_size"), F.lit(True).alias("kept"), F.col("sha__").alias("text_sha256"))
        again = marked.where("again__").drop("word__", "seen__", "again__")
        best = F.min(F.struct((-F.col("length__")).alias("n"), F.col("id__").isNull().alias("none"), F.col("id__").alias("id"), F.col("row__").alias("row"))).alias("best")
        groups = again.groupBy("sha__").agg(best, F.count("*").alias("group_size"))
        groups = written(groups.select("sha__", "group_size", F.col("best.id").alias("keep_id"), F.col("best.row").alias("first__")), "groups")
        hot = F.broadcast(groups.where(F.col("group_size") * HOT >= n))
        large = again.join(hot, "sha__")
        small = again.join(hot.select("sha__"), "sha__", "left_anti").join(groups.where(F.col("group_size") * HOT < n), "sha__")
        each = large.unionByName(small).withColumn("kept", F.col("row__") == F.col("first__"))
        return alone.unionByName(each.select(*back, *found, F.col("sha__").alias("text_sha256")))

    if ranges == 1:
        return told(rows)
    path = f"{shared_dir(spark)}/windrow-exact-{uuid.uuid4().hex}"
    for k in range(ranges):
        told(rows.where(F.col("range__") == k)).write.mode("append").parquet(path)
    return spark.read.parquet(path)
