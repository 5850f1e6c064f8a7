"""Order-dependent selection of boxes: suppression, merging under a leader, nested objects."""

from __future__ import annotations

from collections.abc import Callable
from functools import partial, reduce

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions.geometry import box_area, box_iou, ring_area
from tidemark.operators import groups
from tidemark.operators.graph import greedy_select
from tidemark.operators.groups import large_groups, meeting, walked
from tidemark.operators.outlines import union_outlines
from tidemark.operators.overlap import ring_overlaps
from tidemark.operators.spatial import BOX, box_pairs, overlap_of_pair, self_box_pairs, sides
from tidemark.storage import stored

#: An object engulfs one that lies in it by this share and is smaller than this part of it.
INSIDE, RATIO = 0.5, 0.25


def _pair_boxes() -> tuple[tuple, tuple]:
    return tuple(F.col("l" + c) for c in BOX), tuple(F.col("r" + c) for c in BOX)


def _overlapping(objects: DataFrame, size: float, group: list[str]) -> DataFrame:
    """Each pair that overlaps once: lid, rid, overlap, iou, l_area, r_area; by the outlines if there is a column ring, else by the boxes."""
    if "ring" in objects.columns:
        side = lambda name: objects.select(*group, F.col("id").alias(name), "ring")
        return ring_overlaps(side("l_id"), side("r_id"), size, group, once=True).withColumnsRenamed({"l_id": "lid", "r_id": "rid"})
    (a, b) = _pair_boxes()
    pairs = self_box_pairs(objects, "id", size, group)
    return pairs.select("lid", "rid", overlap_of_pair().alias("overlap"), box_iou(a, b).alias("iou"), box_area(a).alias("l_area"), box_area(b).alias("r_area"))


def suppress(objects: DataFrame, size: float, iou: float = 0.4, near: float | None = None, group: list[str] | None = None) -> DataFrame:
    """objects (id, x1..y2, score) with leader and kept_from_n.

    Objects are visited by score, best first, ties by id, null scores as 0. A
    kept one suppresses those of its group whose overlap with it is iou or more
    or, if near is given, whose centre is within near. leader is the kept
    object that suppressed a row (itself if kept), kept_from_n how many rows it
    stands for. Boxes with null corners conflict with nothing. Objects with a
    column ring overlap by that outline; their boxes still give the centres.
    """
    group = group or []
    order = [-F.coalesce("score", F.lit(0.0)), F.col("id")]
    if group and near is None and iou > 0 and "ring" not in objects.columns:
        large = large_groups(objects, group, groups.LOCAL_BOXES)
        few = large.isEmpty()
        chosen = _walked(objects if few else objects.join(large, group, "left_anti"), group, order, partial(_suppressed, iou)).select("id", "leader")
        if not few:
            chosen = chosen.union(_greedy(objects.join(large, group, "left_semi"), size, iou, None, group, order))
        chosen = objects.select("id").join(chosen.hint("merge"), "id", "left").select("id", F.coalesce("leader", "id").alias("leader"))
    else:
        chosen = _greedy(objects, size, iou, near, group, order)
    counted = chosen.groupBy("leader").agg(F.count(F.lit(1)).alias("kept_from_n"))
    return objects.join(chosen, "id").join(counted, "leader").select(*objects.columns, "leader", "kept_from_n")


def _walked(objects: DataFrame, group: list[str], order: list[Column], walk: Callable) -> DataFrame:
    """id, leader, outer of objects whose group is walked inside a task."""
    keys = [c.alias(f"k{i}") for i, c in enumerate(order)]
    return walked(objects.select(*group, "id", *BOX, *keys), group, [f"k{i}" for i in range(len(keys))], walk, "id long, leader long, outer boolean")


def _suppressed(iou: float, rows: dict[str, np.ndarray]) -> tuple[np.ndarray, ...]:
    i, j, inter, area = _own_pairs(rows)
    hit = inter / (area[i] + area[j] - inter) >= iou
    return rows["id"], rows["id"][_leaders(len(area), i[hit], j[hit])], np.zeros(len(area), bool)


def _merged(overlap: float, min_ratio: float | None, nested: bool, rows: dict[str, np.ndarray]) -> tuple[np.ndarray, ...]:
    i, j, inter, area = _own_pairs(rows)
    small, large = np.minimum(area[i], area[j]), np.maximum(area[i], area[j])
    outer = np.zeros(len(area), bool)
    if nested:
        bad = (small < large) & (inter >= INSIDE * small) & (small / large < RATIO)
        outer[np.where(area[i] > area[j], i, j)[bad]] = True
    link = (inter > overlap * small) & ~outer[i] & ~outer[j]
    if min_ratio is not None:
        link &= small >= min_ratio * large
    return rows["id"], rows["id"][_leaders(len(area), i[link], j[link])], outer


def _own_pairs(rows: dict[str, np.ndarray]) -> tuple[np.ndarray, ...]:
    """Pairs i before j of a group's boxes that share some area, the area, and every box's."""
    box = tuple(rows[c] for c in BOX)
    i, j, inter = meeting(box, box)
    once = i < j
    return i[once], j[once], inter[once], (box[2] - box[0]) * (box[3] - box[1])


def _leaders(n: int, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """The first kept of n rows in order that conflicts with each (itself: it is kept), for conflicts i before j sorted by i."""
    leader = np.full(n, -1)
    ends = np.searchsorted(i, np.arange(n + 1))
    for k in range(n):
        if leader[k] < 0:
            leader[k] = k
            own = j[ends[k] : ends[k + 1]]
            own = own[leader[own] < 0]
            leader[own] = k
    return leader


def _greedy(objects: DataFrame, size: float, iou: float, near: float | None, group: list[str], order: list[Column]) -> DataFrame:
    """id, leader of suppress() by conflicts, whatever the size of a group."""
    pairs = _overlapping(objects, size, group).where(F.col("iou") >= iou).select(F.col("lid").alias("a"), F.col("rid").alias("b"))
    if near is not None:
        centres = objects.select("id", *group, ((F.col("x1") + F.col("x2")) / 2).alias("cx"), ((F.col("y1") + F.col("y2")) / 2).alias("cy"))
        dots = centres.select("id", *group, F.col("cx").alias("x1"), F.col("cy").alias("y1"), F.col("cx").alias("x2"), F.col("cy").alias("y2"))
        left, right = sides(dots, "l", ["id"]), sides(dots, "r", ["id"])
        dx, dy = F.col("lx1") - F.col("rx1"), F.col("ly1") - F.col("ry1")
        close = box_pairs(left, right, max(near, size), grow=near).where((F.col("lid") < F.col("rid")) & (F.sqrt(dx * dx + dy * dy) <= near))
        pairs = pairs.union(close.select("lid", "rid"))
    return greedy_select(objects, pairs, order)


def engulfing(objects: DataFrame, size: float, inside: float = INSIDE, ratio: float = RATIO, group: list[str] | None = None) -> DataFrame:
    """Ids of objects with a strictly smaller one that lies in them by the share inside or more and is smaller than ratio of them."""
    return _engulfing(_overlapping(objects, size, group or []), inside, ratio)


def _engulfing(pairs: DataFrame, inside: float = INSIDE, ratio: float = RATIO) -> DataFrame:
    left, right = F.col("l_area"), F.col("r_area")
    small, large = F.least(left, right), F.greatest(left, right)
    bad = pairs.where((small < large) & (F.col("overlap") >= inside * small) & (small / large < ratio))
    return bad.select(F.when(left > right, F.col("lid")).otherwise(F.col("rid")).alias("id")).distinct()


def merge_under_leaders(objects: DataFrame, size: float, overlap: float = 0.15, min_ratio: float | None = 0.25, min_group: int = 1, nested: bool = True, group: list[str] | None = None) -> DataFrame:
    """objects (id, x1..y2, score) to one row per merged object: leader, duplicate, score, x1..y2 of all members.

    The largest comes first (ties by id) and takes every remaining object that
    overlaps its own outline by more than overlap of the smaller of the two,
    if their areas differ by no more than min_ratio (None: whatever they are). nested drops engulfing
    objects first. Groups under min_group members are left out. Objects with a
    column ring overlap and are ordered by that outline, and what the members' outlines cover together is
    returned: outline (the outer ring of its largest part), holes, parts, union_area.
    """
    outlined = "ring" in objects.columns
    area = ring_area(F.col("ring")) if outlined else (F.col("x2") - F.col("x1")) * (F.col("y2") - F.col("y1"))

    def led(rows: DataFrame) -> DataFrame:
        """id, leader by conflicts, whatever the size of a group."""
        pairs = stored(_overlapping(rows, size, group or []))
        if nested:
            outer = stored(_engulfing(pairs))
            rows = rows.join(outer, "id", "left_anti")
            pairs = pairs.join(outer.withColumnRenamed("id", "lid"), "lid", "left_anti").join(outer.withColumnRenamed("id", "rid"), "rid", "left_anti")
        small, large = F.least("l_area", "r_area"), F.greatest("l_area", "r_area")
        linked = pairs.where(F.col("overlap") > overlap * small)
        if min_ratio is not None:
            linked = linked.where(small >= min_ratio * large)
        return greedy_select(rows.withColumn("area", area), linked.select(F.col("lid").alias("a"), F.col("rid").alias("b")), [-F.col("area"), F.col("id")])

    if group and overlap >= 0 and not outlined:
        large = large_groups(objects, group, groups.LOCAL_BOXES)
        few = large.isEmpty()
        found = _walked(objects if few else objects.join(large, group, "left_anti"), group, [-area, F.col("id")], partial(_merged, overlap, min_ratio, nested))
        # rows of no group stay by themselves
        none = reduce(lambda a, b: a | b, [F.col(c).isNull() for c in group])
        chosen = found.where(~F.col("outer")).select("id", "leader").union(objects.where(none).select("id", F.col("id").alias("leader")))
        if not few:
            chosen = chosen.union(led(objects.join(large, group, "left_semi")))
        joined = objects.join(chosen.hint("merge"), "id")
    else:
        joined = stored(objects.join(led(objects), "id"))
    merged = joined.groupBy("leader").agg(F.count(F.lit(1)).alias("duplicate"), F.max("score").alias("score"), F.min("x1").alias("x1"), F.min("y1").alias("y1"), F.max("x2").alias("x2"), F.max("y2").alias("y2"))
    merged = merged.where(F.col("duplicate") >= min_group)
    if not outlined:
        return merged
    together = union_outlines(joined, ["leader"]).groupBy("leader").agg(F.min_by("ring", "part").alias("outline"), F.min_by("holes", "part").alias("holes"), F.count(F.lit(1)).alias("parts"), F.sum("area").alias("union_area"))
    return merged.join(together, "leader")
