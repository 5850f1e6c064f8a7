"""Exact dedup: 128-bit content hashes, the smallest id stays, bytes compared inside groups.

Only (hash, id) pairs are shuffled for the grouping, with counts combined
before the shuffle. Texts move only for rows whose hash occurs more than
once, to be compared byte by byte with the text of the row that stays; rows
that differ (hash collisions) are grouped again by their bytes.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import BROADCAST_BYTES, HOT_ROWS, SPACES, hex_sha256, join_groups
from tidemark.storage import stored


def normalised(text: Column) -> Column:
    """Null counts as empty; each run of white space becomes one space."""
    return F.regexp_replace(F.coalesce(text, F.lit("")), SPACES, " ")


def exact_dedup(docs: DataFrame, hash128: Column | None = None) -> DataFrame:
    """One row per row of docs: doc_id, keep_id, group_size, kept, text_sha256.

    docs needs doc_id and text; other columns are ignored, whatever their
    names. Null text equals empty text. A null doc_id is never smaller than an
    id, so it stays only in a group of null ids. Rows that repeat both id and
    text are each counted, and each is marked kept if its id is. An empty
    table gives an empty result. hash128 overrides the hash of the normalised
    text (column norm), for tests of collisions.
    """
    hash128 = F.md5(F.col("norm").cast("binary")) if hash128 is None else hash128
    base = docs.select("doc_id", normalised(F.col("text")).alias("norm"))
    hashed = stored(base.select("doc_id", F.unhex(hash128).alias("h"), F.unhex(hex_sha256(F.col("norm"))).alias("sha")))
    groups = stored(hashed.groupBy("h").agg(F.min("doc_id").alias("keep_id"), F.count(F.lit(1)).alias("n")).where("n > 1"))
    repeated = groups.select("h", F.col("keep_id").alias("first_id"), "n")
    # Bytes are compared only where a hash repeats. A large group is dealt to as many tasks as it needs, the text that stays to each.
    dealt = F.floor(F.rand(7) * (1 + F.floor(F.col("n") / HOT_ROWS))).cast("long")
    suspects = stored(join_groups(base.withColumn("h", F.unhex(hash128)), repeated, "h", limit=BROADCAST_BYTES).select("h", "doc_id", "first_id", "norm", "n", dealt.alias("deal")))
    keepers = suspects.where(F.col("doc_id").eqNullSafe(F.col("first_id"))).groupBy("h").agg(F.min("norm").alias("kept_norm"), F.max("n").alias("kept_n"))
    keepers = stored(keepers).select("h", "kept_norm", F.explode(F.sequence(F.lit(0).cast("long"), F.floor(F.col("kept_n") / HOT_ROWS).cast("long"))).alias("deal"))
    compared = suspects.join(keepers, ["h", "deal"]).select("h", "doc_id", "norm", (F.col("norm") == F.col("kept_norm")).alias("same"))
    other = stored(compared.where(~F.col("same")).select("h", "doc_id", F.unhex(hex_sha256(F.col("norm"))).alias("sha"), "norm"))
    if other.isEmpty():
        members = join_groups(hashed, groups, "h", "left").select("doc_id", "sha", F.when(F.col("n").isNull(), F.col("doc_id")).otherwise(F.col("keep_id")).alias("keep_id"), F.coalesce("n", F.lit(1)).alias("n"))
    else:
        # Collisions: (h, bytes) tell the groups apart, the rest of the group shrinks by as many rows.
        split = stored(other.groupBy("h", "norm").agg(F.min("doc_id").alias("keep_id"), F.count(F.lit(1)).alias("n"), F.first("sha").alias("sha"))).select("h", "sha", "keep_id", "n")
        odd = split.select("h", "sha", F.col("keep_id").alias("odd_keep"), F.col("n").alias("odd_n"))
        lost = split.groupBy("h").agg(F.sum("n").alias("lost"))
        members = join_groups(hashed, groups.join(lost, "h", "left"), "h", "left").join(odd, ["h", "sha"], "left").select(
            "doc_id",
            "sha",
            F.when(F.col("n").isNull(), F.col("doc_id")).otherwise(F.coalesce("odd_keep", F.when(F.col("odd_n").isNull(), F.col("keep_id")))).alias("keep_id"),
            F.coalesce("odd_n", F.col("n") - F.coalesce("lost", F.lit(0)), F.lit(1)).alias("n"),
        )
    return members.select(
        "doc_id",
        "keep_id",
        F.col("n").cast("long").alias("group_size"),
        F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"),
        F.lower(F.hex("sha")).alias("text_sha256"),
    )
