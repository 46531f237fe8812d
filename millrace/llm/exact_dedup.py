"""Exact dedup (native): group by a 128-bit content hash, keep the smallest stable id, compare bytes inside groups.

One pass writes a narrow table (row, id, digest) to the shared folder. Only texts whose 128-bit hash occurs
twice or more are read again; they are grouped by hash AND bytes, with partial aggregation before the shuffle,
so a group of a billion copies leaves each task as one row and a hash collision splits into its texts.

Defined results: null text counts as empty; null ids come after all others; of rows that tie in text and id one
stays; an empty table gives an empty table; other columns of the input play no part.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.llm.base import SPACE, cut, fresh, join_checked, lookup, text_or_empty


def normalised(text: str = "text") -> Column:
    return F.regexp_replace(text_or_empty(text), SPACE, " ")


def hash128(text: Column) -> Column:
    """The first half of SHA-256, as 16 bytes."""
    return F.unhex(F.substring(F.sha2(text, 256), 1, 32))


def exact_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", content_hash: Callable[[Column], Column] = hash128) -> DataFrame:
    """One row per row of docs: id, keep_id, group_size, kept, text_sha256."""
    # only id and text go on, under names of our own: extra columns can't clash
    plain = docs.select(F.col(id_col).alias("id"), normalised(text_col).alias("norm"))
    rows = cut(plain.select("id", F.sha2("norm", 256).alias("sha"), content_hash(F.col("norm")).alias("h"), F.monotonically_increasing_id().alias("row")))
    total = rows.count()
    twice = rows.groupBy("h").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("h")
    again = join_checked(plain.withColumn("h", content_hash(F.col("norm"))), cut(twice), "h", "left_semi")
    same_bytes = again.groupBy("h", "norm").agg(F.count(F.lit(1)).alias("group_size")).select("h", F.sha2("norm", 256).alias("sha"), "group_size")
    first = rows.groupBy("h", "sha").agg(F.min(F.struct(F.col("id").isNull().alias("none"), F.col("id").alias("id"), F.col("row").alias("row"))).alias("first"))
    groups = cut(same_bytes.where("group_size > 1").join(first, ["h", "sha"]).select("h", "sha", "group_size", F.col("first.id").alias("keep_id"), F.col("first.row").alias("keep_row")))
    found = lookup(rows, groups, ["h", "sha"], "group_size", total)
    alone = F.col("group_size").isNull()
    return found.select(
        F.col("id").alias(id_col),
        F.when(alone, F.col("id")).otherwise(F.col("keep_id")).alias("keep_id"),
        F.coalesce("group_size", F.lit(1)).cast("long").alias("group_size"),
        (alone | (F.col("row") == F.col("keep_row"))).alias("kept"),
        F.col("sha").alias("text_sha256"),
    )


def drop_exact_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs without the rows that exact_duplicates drops, all columns as they were.

    The text isn't shuffled unless over BROADCAST_ROWS rows go. Of rows that tie in id and text any one stays.
    """
    own, sha, key, n = fresh(docs, "own_id", "own_sha", "key_sha", "times")
    found = exact_duplicates(docs, id_col, text_col).select(F.col(id_col).alias(own), F.col("text_sha256").alias(key), F.col("kept").alias("kept"))
    by_key = found.groupBy(own, key).agg(F.max("kept").alias("kept"), F.count(F.lit(1)).alias(n))
    by_key = cut(by_key.where(~F.col("kept") | (F.col(n) > 1)))
    keyed = docs.withColumn(sha, F.sha2(normalised(text_col), 256))
    on = F.col(id_col).eqNullSafe(F.col(own)) & (F.col(sha) == F.col(key))
    stay = join_checked(keyed, by_key.select(own, key), on, "left_anti").drop(sha)
    repeated = by_key.where("kept").select(own, key)
    if repeated.isEmpty():
        return stay
    tied = join_checked(keyed, repeated, on, "left_semi").dropDuplicates([id_col, sha]).drop(sha)
    return stay.unionByName(tied)
