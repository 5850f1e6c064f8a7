"""Helpers that the corpus operators share."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Characters that count as white space in the contracts: \x20 and \x09-\x0D.
SPACES = r"[\x20\x09-\x0D]+"

#: A table of at most so many bytes may be broadcast; a larger one is joined by shuffle.
BROADCAST_BYTES = 32 << 20
#: The same for the groups of narrow rows, which cost little to shuffle.
NARROW_BYTES = 1 << 20

#: A key of more rows is never one task's.
HOT_ROWS = 100_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def join_sized(big: DataFrame, small: DataFrame, on: list[str], how: str, small_bytes: int) -> DataFrame:
    """Join, broadcasting small only if its measured size is within BROADCAST_BYTES."""
    if small_bytes <= BROADCAST_BYTES:
        return big.join(F.broadcast(small), on, how)
    return big.join(small.hint("merge"), on, how)


def join_groups(big: DataFrame, groups: DataFrame, on: str, how: str = "inner", limit: int = NARROW_BYTES) -> DataFrame:
    """big with its groups (one row a key; n: rows of big that have it): inner or left, no key in one task.

    Groups of a measured size within limit are broadcast (where big's rows are
    wide, up to BROADCAST_BYTES pay). Beyond it those of more than HOT_ROWS rows are,
    of which there is at most one for so many rows of big, and the others are
    joined by shuffle.
    """
    if groups.count() * 64 <= limit:
        return big.join(F.broadcast(groups), on, how)
    if groups.where(F.col("n") > HOT_ROWS).isEmpty():
        return big.join(groups.hint("merge"), on, how)
    hot, rest = groups.where(F.col("n") > HOT_ROWS), groups.where(F.col("n") <= HOT_ROWS)
    usual = big.join(F.broadcast(hot.select(on)), on, "left_anti").join(rest.hint("merge"), on, how)
    return usual.unionByName(big.join(F.broadcast(hot), on))


def hex_sha256(c: Column) -> Column:
    return F.sha2(c.cast("binary"), 256)
