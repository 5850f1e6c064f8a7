"""The engine's functions for SQL: plain ones as SQL functions of a session, those on outlines in Arrow batches, and two table functions."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Row, SparkSession
from pyspark.sql import functions as F

from tidemark.functions import overlay
from tidemark.functions.geometry import VARIANTS

FUNCTIONS = {
    "box_overlap(ax1 DOUBLE, ay1 DOUBLE, ax2 DOUBLE, ay2 DOUBLE, bx1 DOUBLE, by1 DOUBLE, bx2 DOUBLE, by2 DOUBLE) RETURNS DOUBLE": "greatest(least(ax2, bx2) - greatest(ax1, bx1), 0D) * greatest(least(ay2, by2) - greatest(ay1, by1), 0D)",
    "box_iou(ax1 DOUBLE, ay1 DOUBLE, ax2 DOUBLE, ay2 DOUBLE, bx1 DOUBLE, by1 DOUBLE, bx2 DOUBLE, by2 DOUBLE) RETURNS DOUBLE": "CASE WHEN box_overlap(ax1, ay1, ax2, ay2, bx1, by1, bx2, by2) > 0 THEN box_overlap(ax1, ay1, ax2, ay2, bx1, by1, bx2, by2) / ((ax2 - ax1) * (ay2 - ay1) + (bx2 - bx1) * (by2 - by1) - box_overlap(ax1, ay1, ax2, ay2, bx1, by1, bx2, by2)) ELSE 0D END",
    "axial_diff(a DOUBLE, b DOUBLE) RETURNS DOUBLE": "least(pmod(a - b, 180D), 180D - pmod(a - b, 180D))",
    "poly_area(seg ARRAY<DOUBLE>) RETURNS DOUBLE": "CASE WHEN size(seg) < 6 THEN 0D ELSE abs(aggregate(sequence(0, size(seg) div 2 - 1), 0D, (s, i) -> s + seg[2 * i] * seg[pmod(2 * i + 3, size(seg))] - seg[pmod(2 * i + 2, size(seg))] * seg[2 * i + 1])) / 2 END",
    "pair_score(distance DOUBLE, radius DOUBLE, area_a DOUBLE, area_b DOUBLE, volume_a DOUBLE, volume_b DOUBLE, angle_a DOUBLE, angle_b DOUBLE) RETURNS DOUBLE": "0.3D * greatest(0D, 1 - distance / radius) + 0.25D * exp(-abs(ln((area_a + 1e-6D) / (area_b + 1e-6D)))) + 0.35D * CASE WHEN volume_a IS NULL OR volume_b IS NULL THEN 0.5D ELSE exp(-abs(ln((volume_a + 1e-6D) / (volume_b + 1e-6D)))) END + 0.1D * CASE WHEN angle_a IS NULL OR angle_b IS NULL THEN 0.5D ELSE greatest(0D, 1 - axial_diff(angle_a, angle_b) / 90) END",
    "dihedral_variants() RETURNS TABLE (variant STRING)": "SELECT explode(array('orig', 'hflip', 'vflip', 'rot90', 'rot180', 'rot270', 'transpose', 'antitranspose')) AS variant",
    "window_starts(len BIGINT, win BIGINT, step BIGINT) RETURNS TABLE (start BIGINT)": "SELECT explode(CASE WHEN len <= win THEN array(0L) ELSE array_union(sequence(0L, greatest(len - win, 0L), step), array(len - win)) END) AS start",
}




def _ring(seg) -> overlay.Ring:
    """[x0, y0, x1, y1, ...] as a ring; null or under three points: nothing."""
    flat = [] if seg is None else [float(v) for v in seg]
    return list(zip(flat[0::2], flat[1::2])) if len(flat) >= 6 else []


def _flat(ring: overlay.Ring) -> list[float]:
    return [v for p in ring for v in p]


def poly_iou(a: pd.Series, b: pd.Series) -> pd.Series:
    """Overlap over union of two outlines, read even-odd; 0 without any."""

    def one(x: overlay.Ring, y: overlay.Ring) -> float:
        shared = overlay.polygon_area(overlay.common([x], [y])) if x and y else 0.0
        return shared / (overlay.polygon_area(overlay.pieces([x])) + overlay.polygon_area(overlay.pieces([y])) - shared) if shared > 0 else 0.0

    return pd.Series([one(_ring(x), _ring(y)) for x, y in zip(a, b)], dtype="float64")


def clip_to_box(seg: pd.Series, x1: pd.Series, y1: pd.Series, x2: pd.Series, y2: pd.Series) -> pd.Series:
    """The outer rings of an outline's parts inside a box, largest first."""
    return pd.Series([[_flat(o) for o, _ in overlay.common([_ring(s)], [[(a, b), (c, b), (c, d), (a, d)]])] if _ring(s) else [] for s, a, b, c, d in zip(seg, x1, y1, x2, y2)])


def poly_union(segs: pd.Series) -> list[list[float]]:
    """The outer rings of the union of a group's outlines, largest first: an aggregate."""
    return [_flat(o) for o, _ in overlay.union([[_ring(s)] for s in segs if _ring(s)])]


def _starts(length: int, win: int, step: int) -> list[int]:
    """Starts of windows along a side: each step and one flush with the end."""
    return sorted({*range(0, max(length - win, 0) + 1, step), max(length - win, 0)})


class WindowGrid:
    """Windows of every image of a table (image_id, width, height): window_grid(TABLE(images), win, rate); they are rate * win apart."""

    def eval(self, row: Row, win: int, rate: float):
        step = max(1, round(win * float(rate)))
        for c0 in _starts(row["width"], win, step):
            for r0 in _starts(row["height"], win, step):
                yield row["image_id"], r0, min(r0 + win, row["height"]), c0, min(c0 + win, row["width"])


class DihedralVariants:
    """Every annotation (ann_id, seg, width, height) of a table in all turns and mirrors of its picture: dihedral_rings(TABLE(annotations))."""

    def eval(self, row: Row):
        w, h = float(row["width"]), float(row["height"])
        for name, turn in VARIANTS.items():
            yield row["ann_id"], name, [float(v) for p in _ring(row["seg"]) for v in turn(*p, w, h)]


def register(spark: SparkSession) -> None:
    """Make the functions known to this session's SQL."""
    for head, body in FUNCTIONS.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {head} RETURN {body}")
    outline = "array<double>"
    spark.udf.register("poly_iou", F.pandas_udf(poly_iou, "double"))
    spark.udf.register("clip_to_box", F.pandas_udf(clip_to_box, f"array<{outline}>"))
    spark.udf.register("poly_union", F.pandas_udf(poly_union, f"array<{outline}>"))
    spark.udtf.register("window_grid", F.udtf(WindowGrid, returnType="image_id long, r0 long, r1 long, c0 long, c1 long"))
    spark.udtf.register("dihedral_rings", F.udtf(DihedralVariants, returnType=f"ann_id long, variant string, seg {outline}"))
