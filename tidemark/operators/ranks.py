"""Ranks and running totals over a whole table, by ranges of its order: no window holds more than a range."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidemark.storage import stored

PART = "range_part"


def ranged(rows: DataFrame, order: list[Column]) -> DataFrame:
    """rows dealt by ranges of an order, stored, with the number of each row's range (PART); rows equal in it share one."""
    return stored(rows.repartitionByRange(*order).withColumn(PART, F.spark_partition_id()))


def totals_before(parts: DataFrame, group: list[str], sums: dict[str, Column]) -> DataFrame:
    """Per group and range the totals of the ranges before it: one row a group and range."""
    each = parts.groupBy(*group, PART).agg(*[c.alias(n) for n, c in sums.items()])
    before = Window.partitionBy(*group).orderBy(PART).rowsBetween(Window.unboundedPreceding, -1)
    return each.select(*group, PART, *[F.coalesce(F.sum(n).over(before), F.lit(0)).alias(n) for n in sums])


def numbered(rows: DataFrame, group: list[str], order: list[str | Column], name: str) -> DataFrame:
    """rows with ids 1, 2, ... within each group, in order; nulls first, rows equal in it in any order. An empty table gives no rows."""
    keys = [F.col(o) if isinstance(o, str) else o for o in order]
    parts = ranged(rows, [F.col(g) for g in group] + keys)
    before = totals_before(parts, group, {"rows_before": F.count(F.lit(1))})
    own = F.row_number().over(Window.partitionBy(*group, PART).orderBy(*keys))
    placed = parts.withColumn("row_in_range", own)
    same = placed[PART] == before[PART]
    for g in group:
        same = same & placed[g].eqNullSafe(before[g])
    return placed.join(before, same).select(*[placed[c] for c in rows.columns], (F.col("row_in_range") + F.col("rows_before")).cast("long").alias(name))
