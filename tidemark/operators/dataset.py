"""Labelled datasets: objects clipped to tiles, annotation policy, turned copies, splits from a pool."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidemark.functions.geometry import SWAPPING, VARIANTS, flat_to_ring, ring_area, ring_box, turned_ring
from tidemark.operators.lookups import stacked
from tidemark.operators.ranks import numbered  # noqa: F401
from tidemark.operators.spatial import BOX, box_pairs
from tidemark.sources.manifest import class_of, strip_variant  # noqa: F401
from tidemark.sources.readers import existing


@dataclass(frozen=True)
class Policy:
    """What becomes of deposits and small boulders: dropped, crowd, or (deposits) a class of their own."""

    deposits: str = "crowd"
    small: str = "drop"
    min_area: float = 0.0


def clip_boxes(objects: DataFrame, tiles: DataFrame) -> DataFrame:
    """Objects (object_id, year, class, box) by tiles (tile_id, year, box): the clipped box and its area, if any is left.

    Years must agree unless either is null.
    """
    left = objects.select(F.col("object_id"), F.col("year").alias("o_year"), "class", *[F.col(c).alias("l" + c) for c in BOX])
    right = tiles.select("tile_id", F.col("year").alias("t_year"), *[F.col(c).alias("r" + c) for c in BOX])
    pairs = box_pairs(left, right, 64.0).where("o_year IS NULL OR t_year IS NULL OR o_year = t_year")
    cut = {"x1": F.greatest("lx1", "rx1"), "y1": F.greatest("ly1", "ry1"), "x2": F.least("lx2", "rx2"), "y2": F.least("ly2", "ry2")}
    made = pairs.withColumn("whole_area", (F.col("lx2") - F.col("lx1")) * (F.col("ly2") - F.col("ly1"))).withColumns(cut)
    return made.withColumn("area", (F.col("x2") - F.col("x1")) * (F.col("y2") - F.col("y1"))).where("area > 0").select("object_id", "tile_id", "class", "whole_area", *BOX, "area")


def annotate(clipped: DataFrame, policy: Policy) -> DataFrame:
    """clipped with category_id, iscrowd, reason and outcome (kept, or what dropped it).

    Smallness goes by whole_area: the object's before tiles cut it, inside the region of interest if outlines.clip_to_tiles() had one.
    """
    deposit = F.col("class") == 1
    small = ~deposit & (F.col("whole_area") < policy.min_area)
    category = F.when(deposit & F.lit(policy.deposits == "class"), 2).otherwise(1)
    crowd = (deposit & F.lit(policy.deposits == "crowd")) | (small & F.lit(policy.small == "crowd"))
    outcome = F.when(deposit & F.lit(policy.deposits == "drop"), "dropped_deposit").when(small & F.lit(policy.small == "drop"), "dropped_small").when(deposit, "deposit").when(small, "crowd").otherwise("boulder")
    reason = F.when(crowd & deposit, "deposit").when(crowd & small, "small")
    return clipped.withColumns({"category_id": category, "iscrowd": crowd.cast("int"), "ignore_reason": reason, "outcome": outcome})


def clip_ring(ring: list[tuple[float, float]], box: tuple[float, float, float, float]) -> list[list[tuple[float, float]]]:
    """Parts of a simple ring inside a box, each a ring; a concave ring may leave several.

    The ring is cut along one line of the box at a time; a cut joins the
    crossings pairwise along the line, so that parts come apart.
    """
    parts = [ring]
    for axis, limit, sign in ((0, box[0], 1), (0, box[2], -1), (1, box[1], 1), (1, box[3], -1)):
        parts = [p for r in parts for p in _halved(r, axis, limit, sign)]
    return parts


def _halved(ring: list[tuple[float, float]], axis: int, limit: float, sign: int) -> list[list[tuple[float, float]]]:
    side = [sign * (p[axis] - limit) for p in ring]
    if min(side) >= 0:
        return [ring]
    if max(side) <= 0:
        return []
    n = len(ring)
    chains: list[list[tuple[float, float]]] = []
    start = next(k for k in range(n) if side[k] <= 0 and side[(k + 1) % n] > 0)
    chain: list[tuple[float, float]] = []
    for step in range(n):
        k, j = (start + step) % n, (start + step + 1) % n
        p, q = ring[k], ring[j]
        if (side[k] <= 0) != (side[j] <= 0):
            t = side[k] / (side[k] - side[j])
            cut = (p[0] + t * (q[0] - p[0]), p[1] + t * (q[1] - p[1]))
            cut = (limit, cut[1]) if axis == 0 else (cut[0], limit)
            chain.append(cut)
            if side[j] <= 0:
                chains.append(chain)
                chain = []
                continue
        if side[j] > 0:
            chain.append(q)
    # along the line, the inside lies between the first and second crossing, the third and fourth, ...
    along = 1 - axis
    ends = sorted((c[e][along], k, e) for k, c in enumerate(chains) for e in (0, -1))
    mate: dict[tuple[int, int], tuple[int, int]] = {}
    for a, b in zip(ends[::2], ends[1::2]):
        mate[a[1:]], mate[b[1:]] = b[1:], a[1:]
    out, left = [], set(range(len(chains)))
    while left:
        k = first = min(left)
        part: list[tuple[float, float]] = []
        while k in left:
            left.discard(k)
            part += chains[k]
            k = mate[(k, -1)][0]
        if k == first and len(part) >= 3:
            out.append(part)
    return out


def clip_rings(objects: DataFrame, tiles: DataFrame, size: float = 64.0) -> DataFrame:
    """Objects (object_id, ring) by tiles (tile_id, box): one row per part (part, ring, area), candidates by their boxes."""
    boxed = objects.withColumn("b", ring_box(F.col("ring"))).select("object_id", "ring", *[F.col(f"b.{c}").alias("l" + c) for c in BOX])
    pairs = box_pairs(boxed, tiles.select("tile_id", *[F.col(c).alias("r" + c) for c in BOX]), size)

    def run(batches):
        for b in batches:
            rows = []
            for r in b.itertuples(index=False):
                ring = [(p["x"], p["y"]) for p in r.ring]
                for k, part in enumerate(clip_ring(ring, (r.rx1, r.ry1, r.rx2, r.ry2))):
                    rows.append((r.object_id, r.tile_id, k, np.array(part).reshape(-1).tolist()))
            yield pd.DataFrame(rows, columns=["object_id", "tile_id", "part", "flat"])

    parts = pairs.select("object_id", "tile_id", "ring", *["r" + c for c in BOX]).mapInPandas(run, "object_id long, tile_id long, part int, flat array<double>")
    made = parts.withColumn("ring", flat_to_ring(F.col("flat"))).withColumn("area", ring_area(F.col("ring")))
    return made.where("area > 0").drop("flat")


def policy_counts(annotated: DataFrame, group: list[str]) -> DataFrame:
    """Counts per group of every outcome of the policy."""
    names = ("boulder", "crowd", "deposit", "dropped_small", "dropped_deposit")
    return annotated.groupBy(*group).agg(*[F.count_if(F.col("outcome") == n).alias(n) for n in names])


def pooled(layers: dict[str, DataFrame]) -> DataFrame:
    """All rows of named layers with column layer; columns that a layer lacks are null, ids are kept apart by (layer, id)."""
    rows = [df.withColumn("layer", F.lit(name)) for name, df in layers.items()]
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), rows)


def with_bands(images: DataFrame, listing: DataFrame, bands: DataFrame, names: list[str]) -> tuple[DataFrame, DataFrame]:
    """(images with path and a column of values for each named band, images whose file is missing).

    images (file_name), listing (path) of the files there are, bands (path, band, vals). A file that lacks a band raises
    when its row is read: a dataset of four bands has all of them.
    """
    found, missing = existing(images, listing)
    return found.join(stacked(bands.join(found.select("path").distinct(), "path", "left_semi"), names, ["path"]), "path", "left"), missing


def dataset_summary(annotated: DataFrame, images: DataFrame) -> DataFrame:
    """Per split: images, annotations, trainable (no crowd), crowd."""
    a = annotated.groupBy("split").agg(F.count(F.lit(1)).alias("annotations"), F.count_if(F.col("iscrowd") == 0).alias("trainable"), F.count_if(F.col("iscrowd") == 1).alias("crowd"))
    return images.groupBy("split").agg(F.count(F.lit(1)).alias("images")).join(a, "split", "left").na.fill(0)


def variants(annotations: DataFrame, images: DataFrame, names: list[str] | None = None) -> DataFrame:
    """Every annotation (image_id, ann_id, ring) under every variant of its image (image_id, file_name, width, height).

    Areas stay, boxes are found anew, width and height swap where the variant
    swaps them; the file becomes stem_variant. The list of variants is fixed and small.
    """
    spread = F.explode(F.array(*[F.lit(n) for n in names or list(VARIANTS)]))
    both = annotations.join(images, "image_id").withColumn("variant", spread)
    swap = F.col("variant").isin(list(SWAPPING))
    turned = both.withColumn("ring", turned_ring(F.col("ring"), F.col("variant"), F.col("width"), F.col("height"))).withColumn("box", ring_box(F.col("ring")))
    stem = F.regexp_replace("file_name", r"\.[^.]*$", "")
    named = F.when(F.col("variant") == "orig", F.col("file_name")).otherwise(F.concat(stem, F.lit("_"), "variant", F.regexp_extract("file_name", r"(\.[^.]*)$", 1)))
    return turned.withColumns({"new_width": F.when(swap, F.col("height")).otherwise(F.col("width")), "new_height": F.when(swap, F.col("width")).otherwise(F.col("height")), "file_name": named})


def materialise(pool: DataFrame, keys: DataFrame) -> DataFrame:
    """Pool images (file_name, ...) whose name without variant is in keys (stem, split), with the split; no copies are made."""
    stem = strip_variant(F.regexp_replace("file_name", r"\.[^.]*$", ""))
    return pool.withColumn("stem", stem).join(keys, "stem").drop("stem")
