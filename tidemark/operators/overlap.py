"""Exact areas covered by rings, each read even-odd: overlaps of pairs, unions of groups."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.functions.geometry import ring_box
from tidemark.functions.overlay import crosses_itself, shoelace
from tidemark.operators.groups import spread
from tidemark.operators.spatial import BOX, box_pairs

Ring = list[tuple[float, float]]
#: Edges of pairs that are compared many at once; numbers of a block of such pairs.
FEW, BLOCK = 32, 1 << 18


def covered_area(rings: list[Ring], at_least: int = 1) -> float:
    """Area inside at least so many of the rings (each by even and odd crossings): 1 is their union, all of them their intersection.

    The plane is cut into vertical slabs at every corner and crossing; within a
    slab edges do not cross, so every part is a trapezoid.
    """
    edges = []
    for k, ring in enumerate(rings):
        for p, q in zip(ring, ring[1:] + ring[:1]):
            if p[0] != q[0]:
                edges.append((*min(p, q), *max(p, q), k))
    if not edges:
        return 0.0
    e = np.array(edges, float)
    x1, y1, x2, y2 = e[:, 0], e[:, 1], e[:, 2], e[:, 3]
    slope = (y2 - y1) / (x2 - x1)
    base = y1 - slope * x1
    with np.errstate(divide="ignore", invalid="ignore"):
        cross = (base[None, :] - base[:, None]) / (slope[:, None] - slope[None, :])
    inside = np.isfinite(cross) & (cross > np.maximum(x1[:, None], x1[None, :])) & (cross < np.minimum(x2[:, None], x2[None, :]))
    cuts = np.unique(np.concatenate([x1, x2, cross[inside]]))
    total = 0.0
    for a, b in zip(cuts[:-1], cuts[1:]):
        mid = (a + b) / 2
        here = np.flatnonzero((x1 <= mid) & (mid < x2))
        order = here[np.argsort(slope[here] * mid + base[here], kind="stable")]
        within = [False] * len(rings)
        below = None
        for i in order:
            before = sum(within) >= at_least
            k = int(e[i, 4])
            within[k] = not within[k]
            now = sum(within) >= at_least
            if now and not before:
                below = i
            elif before and not now:
                total += (b - a) * ((slope[i] - slope[below]) * mid + base[i] - base[below])
    return float(total)


def _by_size(*rings: np.ndarray) -> Iterator[tuple[np.ndarray, list[np.ndarray]]]:
    """Rows whose rings (columns of numbers x, y, x, y, ...) have the same numbers of points: their places, and each column as rows of points."""
    sizes = np.array([[len(r) // 2 for r in column] for column in rings]).T
    kinds, kind = np.unique(sizes, axis=0, return_inverse=True)
    for k in range(len(kinds)):
        at = np.flatnonzero(kind.ravel() == k)
        yield at, [np.stack([np.asarray(r, float) for r in column[at]]).reshape(len(at), -1, 2) for column in rings]


def even_odd_areas(rings: np.ndarray) -> np.ndarray:
    """even_odd_area() of each; those of convex rings at once."""
    out = np.zeros(len(rings))
    for at, (p,) in _by_size(rings):
        if p.shape[1] < 3:
            continue
        d = np.roll(p, -1, axis=1) - p
        e = np.roll(d, -1, axis=1)
        turn = d[:, :, 0] * e[:, :, 1] - d[:, :, 1] * e[:, :, 0]
        # once round: the way in x changes twice (rings with an upright edge are looked at one by one)
        right = d[:, :, 0] > 0
        convex = ((turn > 0).all(axis=1) | (turn < 0).all(axis=1)) & (d[:, :, 0] != 0).all(axis=1) & ((right != np.roll(right, 1, axis=1)).sum(axis=1) <= 2)
        a, b = p - p[:, :1], np.roll(p, -1, axis=1) - p[:, :1]
        area = np.abs((a[:, :, 0] * b[:, :, 1] - b[:, :, 0] * a[:, :, 1]).sum(axis=1) / 2)
        for k in np.flatnonzero(~convex):
            area[k] = even_odd_area(list(map(tuple, p[k].tolist())))
        out[at] = area
    return out


def shared_areas(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """covered_area([x, y], 2) of each pair; those of up to FEW edges by the same slabs, many pairs at once."""
    out = np.zeros(len(left))
    for at, (p, r) in _by_size(left, right):
        n, edges = p.shape[1], p.shape[1] + r.shape[1]
        if not n or n == edges:
            continue
        if edges > FEW:
            for k, x, y in zip(at, p.tolist(), r.tolist()):
                out[k] = covered_area([list(map(tuple, x)), list(map(tuple, y))], 2)
            continue
        step = max(1, BLOCK // edges**2)
        for first in range(0, len(at), step):
            out[at[first : first + step]] = _shared(p[first : first + step], r[first : first + step])
    return out


def _shared(p: np.ndarray, r: np.ndarray) -> np.ndarray:
    n = p.shape[1]
    start, end = np.concatenate([p, r], axis=1), np.concatenate([np.roll(p, -1, axis=1), np.roll(r, -1, axis=1)], axis=1)
    swap = start[:, :, 0] > end[:, :, 0]
    x1, y1, x2, y2 = (np.where(swap, a, b) for a, b in ((end[:, :, 0], start[:, :, 0]), (end[:, :, 1], start[:, :, 1]), (start[:, :, 0], end[:, :, 0]), (start[:, :, 1], end[:, :, 1])))
    upright = x1 == x2
    with np.errstate(divide="ignore", invalid="ignore"):
        slope = np.where(upright, np.nan, (y2 - y1) / (x2 - x1))
        base = y1 - slope * x1
        i, j = np.triu_indices(slope.shape[1], 1)
        cross = (base[:, j] - base[:, i]) / (slope[:, i] - slope[:, j])
        inside = np.isfinite(cross) & (cross > np.maximum(x1[:, i], x1[:, j])) & (cross < np.minimum(x2[:, i], x2[:, j]))
    # slabs lie where both rings are
    low, high = np.maximum(x1[:, :n].min(axis=1), x1[:, n:].min(axis=1)), np.minimum(x2[:, :n].max(axis=1), x2[:, n:].max(axis=1))
    places = np.concatenate([x1, x2, np.where(inside, cross, low[:, None])], axis=1)
    cuts = np.sort(np.minimum(np.maximum(places, low[:, None]), high[:, None]), axis=1)
    pair, slab = np.nonzero((cuts[:, 1:] > cuts[:, :-1]) & (low < high)[:, None])
    a, b = cuts[pair, slab], cuts[pair, slab + 1]
    mid = ((a + b) / 2)[:, None]
    here = ~upright[pair] & (x1[pair] <= mid) & (mid < x2[pair])
    y = np.where(here, np.nan_to_num(slope[pair]) * mid + np.nan_to_num(base[pair]), np.inf)
    order = np.argsort(y, axis=1, kind="stable")
    y, here = np.take_along_axis(y, order, axis=1), np.take_along_axis(here, order, axis=1)
    both = (np.cumsum(here & (order < n), axis=1) % 2 == 1) & (np.cumsum(here & (order >= n), axis=1) % 2 == 1)
    with np.errstate(invalid="ignore"):
        tall = np.where(both[:, :-1] & here[:, 1:], y[:, 1:] - y[:, :-1], 0.0).sum(axis=1)
    return np.bincount(pair, (b - a) * tall, len(p))


def _points(ring) -> Ring:
    return [(p["x"], p["y"]) for p in ring]


def even_odd_area(ring: Ring) -> float:
    """What a ring covers, read like overlaps: of one that crosses itself the area in an odd number of turns."""
    return covered_area([ring]) if crosses_itself(ring) else abs(shoelace(ring)) if len(ring) > 2 else 0.0


def ring_overlaps(left: DataFrame, right: DataFrame, size: float, on: list[str] | None = None, once: bool = False) -> DataFrame:
    """left (l_id, ring) and right (r_id, ring) whose boxes meet: both ids, overlap, iou, over_smaller (overlap over the smaller area).

    Pairs without area in common are left out. Areas are even-odd like the overlaps, so a ring that crosses itself is like its copies. on: equal columns of both.
    once: only pairs whose left id is the smaller, for a table with itself.
    """
    on = on or []
    boxed = lambda df, key, side: df.withColumn("b", ring_box(F.col("ring"))).select(*on, key, F.flatten(F.transform("ring", lambda p: F.array(p["x"], p["y"]))).alias(side + "ring"), *[F.col(f"b.{c}").alias(side + c) for c in BOX])
    pairs = box_pairs(boxed(left, "l_id", "l"), boxed(right, "r_id", "r"), size, on).where(F.lit(not once) | (F.col("l_id") < F.col("r_id"))).select("l_id", "r_id", "lring", "rring")

    def run(batches):
        for b in batches:
            x, y = b["lring"].to_numpy(), b["rring"].to_numpy()
            yield pd.DataFrame({"l_id": b["l_id"], "r_id": b["r_id"], "la": even_odd_areas(x), "ra": even_odd_areas(y), "overlap": shared_areas(x, y)})

    got = spread(pairs, "l_id", "r_id").mapInPandas(run, "l_id long, r_id long, la double, ra double, overlap double").where("overlap > 0")
    o, a, b = F.col("overlap"), F.col("la"), F.col("ra")
    return got.select("l_id", "r_id", "overlap", (o / (a + b - o)).alias("iou"), (o / F.least(a, b)).alias("over_smaller"), F.col("la").alias("l_area"), F.col("ra").alias("r_area"))


def union_areas(rows: DataFrame, group: list[str]) -> DataFrame:
    """Area of the union of each group's rings (columns group and ring); a merged object's group is small."""
    schema = ", ".join(f"{c} {t}" for c, t in rows.select(*group).dtypes) + ", union_area double"

    def one(key: tuple, g: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame([(*key, covered_area([_points(r) for r in g["ring"]]))], columns=[*group, "union_area"])

    return rows.select(*group, "ring").groupBy(*group).applyInPandas(one, schema)
