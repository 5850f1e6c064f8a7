"""Joins by place, as equi joins on grid cells followed by the exact test.

A side's boxes are spread over the grid cells they cover. A pair is reported
in one cell only, that of the lower left corner of its intersection, so pairs
need no distinct. Sort-merge joins on cells keep memory bounded and let Spark split
crowded cells. They are asked for by name: Spark does not count the rows that spreading
makes, and would broadcast a side by its size before it. Nothing is compared across cells.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions.geometry import box_overlap

BOX = ("x1", "y1", "x2", "y2")


def _cell(c: Column, size: float) -> Column:
    return F.floor(c / size)


def distance_pairs(left: DataFrame, right: DataFrame, radius: float) -> DataFrame:
    """Pairs with centres (lx, ly) and (rx, ry) at most radius apart, both sides' columns and dist.

    left has lx, ly, right rx, ry, no other names in common. The right side is
    put in the 9 cells around its own; a null centre pairs with nothing.
    """
    near = F.explode(F.array(*[F.struct((_cell(F.col("rx"), radius) + dx).alias("gx"), (_cell(F.col("ry"), radius) + dy).alias("gy")) for dx in (-1, 0, 1) for dy in (-1, 0, 1)]))
    a = left.withColumns({"gx": _cell(F.col("lx"), radius), "gy": _cell(F.col("ly"), radius)})
    b = right.withColumn("g", near).select(*right.columns, "g.gx", "g.gy")
    dx, dy = F.col("rx") - F.col("lx"), F.col("ry") - F.col("ly")
    return a.join(b.hint("merge"), ["gx", "gy"]).drop("gx", "gy").withColumn("dist", F.sqrt(dx * dx + dy * dy)).where(F.col("dist") <= radius)


def _covered(df: DataFrame, box: list[str], size: float, grow: float) -> DataFrame:
    xs = F.sequence(_cell(F.col(box[0]) - grow, size), _cell(F.col(box[2]) + grow, size))
    ys = F.sequence(_cell(F.col(box[1]) - grow, size), _cell(F.col(box[3]) + grow, size))
    whole = df.where(F.greatest(*[F.col(c).isNull() for c in box]) == F.lit(False))
    return whole.withColumn("gx", F.explode(xs)).withColumn("gy", F.explode(ys))


def box_pairs(left: DataFrame, right: DataFrame, size: float, on: list[str] | None = None, grow: float = 0.0) -> DataFrame:
    """Pairs whose boxes meet, if left's is grown by so much on each side; touching counts.

    left has columns lx1..ly2, right rx1..ry2, and both the equal columns on;
    no other names in common. size is the grid's; a few times a usual box is
    right. A box with a null corner pairs with nothing.
    """
    on = on or []
    lb, rb = ["l" + c for c in BOX], ["r" + c for c in BOX]
    a, b = _covered(left, lb, size, grow), _covered(right, rb, size, 0.0)
    meet = [F.greatest(F.col(lb[k]) - grow, F.col(rb[k])) for k in (0, 1)]
    ends = [F.least(F.col(lb[k]) + grow, F.col(rb[k])) for k in (2, 3)]
    joined = a.join(b.hint("merge"), [*on, "gx", "gy"])
    own_cell = (F.col("gx") == _cell(meet[0], size)) & (F.col("gy") == _cell(meet[1], size))
    return joined.where((meet[0] <= ends[0]) & (meet[1] <= ends[1]) & own_cell).drop("gx", "gy")


def sides(df: DataFrame, side: str, keep: list[str], box: tuple[str, ...] = BOX) -> DataFrame:
    """A table as one side of box_pairs(): its box and the kept columns get the side's letter."""
    return df.select(*[F.col(c).alias(side + n) for c, n in zip(box, BOX)], *[F.col(c).alias(side + c) for c in keep])


def self_box_pairs(df: DataFrame, key: str, size: float, on: list[str] | None = None, carry: list[str] | None = None) -> DataFrame:
    """Each pair of rows whose boxes meet once, the smaller key on the left; columns as from sides()."""
    on, keep = on or [], [key, *(carry or [])]
    left, right = sides(df, "l", keep + on), sides(df, "r", keep + on)
    for c in on:
        left, right = left.withColumnRenamed("l" + c, c), right.withColumnRenamed("r" + c, c)
    return box_pairs(left, right, size, on).where(F.col("l" + key) < F.col("r" + key))


def overlap_of_pair() -> Column:
    return box_overlap(tuple(F.col("l" + c) for c in BOX), tuple(F.col("r" + c) for c in BOX))
