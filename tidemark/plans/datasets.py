"""Queries that build labelled datasets from objects and tiles."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions import geometry as G
from tidemark.operators import dataset as D
from tidemark.plans.fixtures import load, with_tables
from tidemark.sources.manifest import canonical_tile

#: Sites lie side by side.
SITE_WIDTH = 512.0
POLICY = D.Policy(deposits="crowd", small="drop", min_area=0.5)


def _clipped(spark: SparkSession, sf_dir: str) -> DataFrame:
    before, tiles = load(spark, sf_dir, "survey_before", "tiles")
    half = F.col("side") / 2
    year = F.when(F.col("before_id") % 3 > 0, (24 + F.col("before_id") % 2).cast("int"))
    cls = D.class_of(F.when(F.col("before_id") % 9 == 0, "Deposit").when(F.col("before_id") % 4 == 0, "boulder"))
    objects = before.select(F.col("before_id").alias("object_id"), year.alias("year"), cls.alias("class"), (F.col("cx") - half).alias("x1"), (F.col("cy") - half).alias("y1"), (F.col("cx") + half).alias("x2"), (F.col("cy") + half).alias("y2"))
    return D.clip_boxes(objects, tiles.withColumns({x: F.col(x) + F.col("site") * SITE_WIDTH for x in ("x1", "x2")}))


def tile_clip(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = D.annotate(_clipped(spark, sf_dir), POLICY).where("outcome NOT LIKE 'dropped%'")
    return a.select("object_id", "tile_id", "category_id", "iscrowd", "x1", "y1", "x2", "y2", F.round("area", 6).alias("area"))


def dataset_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = D.annotate(_clipped(spark, sf_dir), POLICY).withColumn("split", F.when(F.col("tile_id") % 5 == 0, "valid").otherwise("train"))
    return D.policy_counts(a, ["split"])


def _pictures(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    (gt,) = load(spark, sf_dir, "gt_boxes")
    x1, y1, x2, y2 = F.col("x"), F.col("y"), F.col("x") + F.col("w"), F.col("y") + F.col("h")
    # a triangle: no variant of it looks like another
    ring = F.array(G.point(x1, y1), G.point(x2, y1), G.point(x1, y2))
    anns = gt.select("image_id", F.col("gt_id").alias("ann_id"), ring.alias("ring"))
    name = F.concat(canonical_tile(F.lit(24), F.floor(F.col("image_id") / 10), F.col("image_id") % 10), F.lit(".png"))
    images = gt.select("image_id").distinct().select("image_id", name.alias("file_name"), F.lit(1600.0).alias("width"), (1600.0 + F.col("image_id")).alias("height"))
    return anns, images


def dihedral_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = D.variants(*_pictures(spark, sf_dir))
    b = F.col("box")
    return v.select("ann_id", "variant", "file_name", "new_width", "new_height", b["x1"].alias("x1"), b["y1"].alias("y1"), b["x2"].alias("x2"), b["y2"].alias("y2"), G.ring_area(F.col("ring")).alias("area"), F.col("ring")[0]["x"].alias("px"), F.col("ring")[0]["y"].alias("py"))


def materialise_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    anns, images = _pictures(spark, sf_dir)
    pool = D.variants(anns, images).select("file_name", "ann_id")
    keys = images.select(F.regexp_replace("file_name", r"\.png$", "").alias("stem"), F.when(F.col("image_id") % 4 == 0, "test").otherwise("train").alias("split"))
    m = D.materialise(pool, keys.where("split = 'test'"))
    return m.groupBy("file_name", "split").agg(F.count(F.lit(1)).alias("n"))


def label_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many objects of each label, by detector score."""
    (b,) = load(spark, sf_dir, "survey_before")
    label = F.when(F.col("score") >= 0.75, "confirmed").when(F.col("score") >= 0.25, "unsure").otherwise("not")
    return b.select(label.alias("label")).groupBy("label").agg(F.count(F.lit(1)).alias("n"))


QUERIES = {f.__name__: f for f in (tile_clip, dataset_counts, dihedral_variants, materialise_split, label_counts)}

_CLIP = """
o AS (SELECT before_id AS object_id, CASE WHEN before_id % 3 > 0 THEN 24 + before_id % 2 END AS year, CASE WHEN before_id % 9 = 0 THEN 1 ELSE 0 END AS class, side * side AS whole,
  cx - side / 2 AS a1, cy - side / 2 AS b1, cx + side / 2 AS a2, cy + side / 2 AS b2 FROM survey_before),
k AS (SELECT object_id, tile_id, class, whole, greatest(a1, x1) AS x1, greatest(b1, y1) AS y1, least(a2, x2) AS x2, least(b2, y2) AS y2 FROM o JOIN (SELECT tile_id, year, x1 + site * 512 AS x1, y1, x2 + site * 512 AS x2, y2 FROM tiles) t ON (o.year IS NULL OR o.year = t.year) AND a1 < x2 AND x1 < a2 AND b1 < y2 AND y1 < b2),
p AS (SELECT *, (x2 - x1) * (y2 - y1) AS area, CASE WHEN class = 1 THEN 'deposit' WHEN whole < 0.5 THEN 'dropped_small' ELSE 'boulder' END AS outcome FROM k)"""
_TURN = """
i AS (SELECT gt_id AS ann_id, image_id, x, y, w, h, CAST(1600 AS DOUBLE) AS iw, CAST(1600 + image_id AS DOUBLE) AS ih, printf('24_%02d_%02d', image_id // 10, image_id % 10) AS stem FROM gt_boxes),
n(variant) AS (VALUES ('orig'), ('hflip'), ('vflip'), ('rot90'), ('rot180'), ('rot270'), ('transpose'), ('antitranspose')),
c AS (SELECT *, CASE WHEN variant IN ('orig', 'vflip') THEN x WHEN variant IN ('hflip', 'rot180') THEN iw - x WHEN variant IN ('rot270', 'transpose') THEN y ELSE ih - y END AS px,
  CASE WHEN variant IN ('orig', 'hflip') THEN y WHEN variant IN ('vflip', 'rot180') THEN ih - y WHEN variant IN ('rot270', 'antitranspose') THEN iw - x ELSE x END AS py,
  CASE WHEN variant IN ('orig', 'vflip') THEN x + w WHEN variant IN ('hflip', 'rot180') THEN iw - x - w WHEN variant IN ('rot270', 'transpose') THEN y + h ELSE ih - y - h END AS qx,
  CASE WHEN variant IN ('orig', 'hflip') THEN y + h WHEN variant IN ('vflip', 'rot180') THEN ih - y - h WHEN variant IN ('rot270', 'antitranspose') THEN iw - x - w ELSE x + w END AS qy,
  variant IN ('rot90', 'rot270', 'transpose', 'antitranspose') AS swap, CASE WHEN variant = 'orig' THEN stem ELSE stem || '_' || variant END || '.png' AS file_name FROM i, n)"""

ORACLES = {
    "tile_clip": with_tables(["survey_before", "tiles"], _CLIP + "\nSELECT object_id, tile_id, 1 AS category_id, CASE WHEN class = 1 THEN 1 ELSE 0 END AS iscrowd, x1, y1, x2, y2, round(area, 6) AS area FROM p WHERE outcome <> 'dropped_small'"),
    "dataset_counts": with_tables(["survey_before", "tiles"], _CLIP + """
SELECT CASE WHEN tile_id % 5 = 0 THEN 'valid' ELSE 'train' END AS split, count(*) FILTER (outcome = 'boulder') AS boulder, CAST(0 AS BIGINT) AS crowd, count(*) FILTER (outcome = 'deposit') AS deposit,
  count(*) FILTER (outcome = 'dropped_small') AS dropped_small, CAST(0 AS BIGINT) AS dropped_deposit FROM p GROUP BY 1"""),
    "dihedral_variants": with_tables(["gt_boxes"], _TURN + """
SELECT ann_id, variant, file_name, CASE WHEN swap THEN ih ELSE iw END AS new_width, CASE WHEN swap THEN iw ELSE ih END AS new_height, least(px, qx) AS x1, least(py, qy) AS y1, greatest(px, qx) AS x2, greatest(py, qy) AS y2, w * h / 2 AS area, px, py FROM c"""),
    "materialise_split": with_tables(["gt_boxes"], _TURN + "\nSELECT file_name, 'test' AS split, count(*) AS n FROM c WHERE image_id % 4 = 0 GROUP BY file_name"),
    "label_counts": with_tables(["survey_before"], "SELECT CASE WHEN score >= 0.75 THEN 'confirmed' WHEN score >= 0.25 THEN 'unsure' ELSE 'not' END AS label, count(*) AS n FROM survey_before GROUP BY 1"),
}
