"""Queries of the steps between layers."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidemark.functions import geometry as G
from tidemark.operators import layers as L
from tidemark.plans.fixtures import load, with_tables
from tidemark.sources.manifest import window_grid

BOUNDS = (-64.0, -32.0, 4096.0, 1024.0)
WIDTH, HEIGHT = 8192, 2048


def _triangles(rows: DataFrame) -> DataFrame:
    """Boxes x, y, w, h as the triangle of their upper left half."""
    x, y, w, h = (F.col(c) for c in "xywh")
    return rows.withColumn("ring", F.array(G.point(x, y), G.point(x + w, y), G.point(x, y + h)))


def tiles_to_whole(spark: SparkSession, sf_dir: str) -> DataFrame:
    (gt,) = load(spark, sf_dir, "gt_boxes")
    name = F.format_string("24_%02d_%02d.png", F.floor(F.col("image_id") / 10).cast("int"), (F.col("image_id") % 10).cast("int"))
    images = gt.select("image_id").distinct().select("image_id", name.alias("file_name"), F.lit(1600).alias("width"), F.lit(1200).alias("height"))
    moved = L.tiles_to_whole(_triangles(gt), images)
    return moved.select("gt_id", "image_id", "x", "y", F.col("ring")[1]["x"].alias("px"), F.col("ring")[2]["y"].alias("py"))


def outlines_to_annotations(spark: SparkSession, sf_dir: str) -> DataFrame:
    (before,) = load(spark, sf_dir, "survey_before")
    boxes = before.select("before_id", (F.col("cx") - F.col("side") / 2).alias("x"), (F.col("cy") - F.col("side") / 2).alias("y"), F.col("side").alias("w"), F.col("side").alias("h"))
    layer = _triangles(boxes).select(F.col("before_id").alias("ann_id"), (F.col("before_id") % 3 + 1).alias("category_id"), "ring")
    a = L.outlines_to_annotations(layer, BOUNDS, WIDTH, HEIGHT)
    return a.select("ann_id", "image_id", "category_id", "area", "x", "y", "w", "h", F.size("ring").cast("long").alias("points"), F.get("ring", F.lit(0))["x"].alias("px"), F.get("ring", F.lit(0))["y"].alias("py"))


def nearest_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    (before,) = load(spark, sf_dir, "survey_before")
    near = L.nearest_pairs(before.select(F.col("before_id").alias("id"), "cx", "cy"), 16.0, 5)
    return near.select("id", "other", F.round("distance", 6).alias("distance"), "place")


def nearest_others(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The four nearest other objects of each, however far."""
    (before,) = load(spark, sf_dir, "survey_before")
    near = L.nearest(before.select(F.col("before_id").alias("id"), "cx", "cy"), 4)
    return near.select("id", "other", F.round("distance", 6).alias("distance"), "place")


def column_means(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean size and volume of objects by whether a detector is sure of them; missing volumes are skipped."""
    (before,) = load(spark, sf_dir, "survey_before")
    m = L.column_means(before.withColumn("sure", (F.col("score") >= 0.5).cast("int")), ["side", "volume"], ["sure"])
    return m.select("sure", F.round("side", 6).alias("side"), F.round("volume", 6).alias("volume"))


def class_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    return L.class_list(spark.read.parquet(f"{sf_dir}/part.parquet").select(F.col("p_size").cast("long").alias("category_id"), F.concat(F.lit("size "), F.col("p_size")).alias("name")))


def segment_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    (tiles,) = load(spark, sf_dir, "tiles")
    return L.segment_counts(tiles.withColumn("segment", F.floor((F.col("y1") + F.col("y2")) / 128).cast("long")), ["year", "segment"])


def first_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of every picture, one an order, its first six windows: the limit is the feature."""
    images = spark.read.parquet(f"{sf_dir}/orders.parquet").select(F.col("o_orderkey").alias("image_id"), (600 + F.col("o_orderkey") % 700).alias("width"), (500 + F.col("o_orderkey") % 900).alias("height"))
    return L.first_windows(window_grid(images, 512, 0.5), 6)


def output_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Place of each object within its band of rows, in all six orders."""
    (before,) = load(spark, sf_dir, "survey_before")
    rows = before.withColumns({"area": F.col("side") * F.col("side"), "band": F.floor(F.col("cy") / 64).cast("long")})
    return rows.select("before_id", "band", *[F.row_number().over(Window.partitionBy("band").orderBy(*L.output_order(o, "before_id"))).cast("long").alias(o) for o in L.ORDERS])


QUERIES = {f.__name__: f for f in (tiles_to_whole, outlines_to_annotations, nearest_pairs, nearest_others, column_means, class_list, segment_counts, first_windows, output_orders)}

_PLACES = ", ".join(f"row_number() OVER (PARTITION BY floor(cy / 64) ORDER BY {by}, before_id) AS {name}" for name, by in {"large2small": "side DESC", "small2large": "side", "north2south": "cy", "south2north": "cy DESC", "west2east": "cx", "east2west": "cx DESC"}.items())

ORACLES = {
    "tiles_to_whole": with_tables(["gt_boxes"], """m AS (SELECT *, 1 + (image_id // 10 - 1) * 1200 AS dy, 1 + (image_id % 10 - 1) * 1600 AS dx FROM gt_boxes)
SELECT gt_id, CAST(1 AS BIGINT) AS image_id, x + dx AS x, y + dy AS y, x + w + dx AS px, y + h + dy AS py FROM m"""),
    "outlines_to_annotations": with_tables(["survey_before"], """m AS (SELECT before_id, side, cx - side / 2 AS x, cy - side / 2 AS y, side * side / 2 * (8192 / CAST(4160 AS DOUBLE)) * (2048 / CAST(1056 AS DOUBLE)) AS a FROM survey_before)
SELECT before_id AS ann_id, CAST(1 AS BIGINT) AS image_id, before_id % 3 + 1 AS category_id, round(a) AS area, round(x) AS x, round(y) AS y, round(side) AS w, round(side) AS h,
  CAST(CASE WHEN round(a) = 0 THEN 0 ELSE 3 END AS BIGINT) AS points, CASE WHEN round(a) > 0 THEN 1 + 8192 * (x + 64) / 4160 END AS px, CASE WHEN round(a) > 0 THEN 1 + 2048 * (1024 - y) / 1056 END AS py FROM m"""),
    "nearest_pairs": with_tables(["survey_before"], """p AS (SELECT a.before_id AS id, b.before_id AS other, sqrt((b.cx - a.cx) * (b.cx - a.cx) + (b.cy - a.cy) * (b.cy - a.cy)) AS d
  FROM survey_before a JOIN survey_before b ON a.before_id <> b.before_id AND abs(a.cx - b.cx) <= 16 AND abs(a.cy - b.cy) <= 16),
q AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY d, other) AS place FROM p WHERE d <= 16)
SELECT id, other, round(d, 6) AS distance, place FROM q WHERE place <= 5"""),
    "nearest_others": with_tables(["survey_before"], """p AS (SELECT a.before_id AS id, b.before_id AS other, sqrt((b.cx - a.cx) * (b.cx - a.cx) + (b.cy - a.cy) * (b.cy - a.cy)) AS d FROM survey_before a JOIN survey_before b ON a.before_id <> b.before_id),
q AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY d, other) AS place FROM p)
SELECT id, other, round(d, 6) AS distance, place FROM q WHERE place <= 4"""),
    "column_means": with_tables(["survey_before"], "SELECT CASE WHEN score >= 0.5 THEN 1 ELSE 0 END AS sure, round(avg(side), 6) AS side, round(avg(volume), 6) AS volume FROM survey_before GROUP BY 1"),
    "class_list": "SELECT DISTINCT CAST(p_size AS BIGINT) AS category_id, 'size ' || p_size AS name FROM part",
    "segment_counts": with_tables(["tiles"], "SELECT year, CAST(floor((y1 + y2) / 128) AS BIGINT) AS segment, count(*) AS n FROM tiles GROUP BY ALL"),
    "first_windows": """WITH i AS (SELECT o_orderkey AS image_id, 600 + o_orderkey % 700 AS width, 500 + o_orderkey % 900 AS height FROM orders),
s AS (SELECT image_id, width, height, unnest(CASE WHEN width <= 512 THEN [0] ELSE list_distinct(list_append(list_filter(range(0, width - 512 + 1, 256), lambda v: v <= width - 512), width - 512)) END) AS c0 FROM i),
t AS (SELECT *, unnest(CASE WHEN height <= 512 THEN [0] ELSE list_distinct(list_append(range(0, height - 512 + 1, 256), height - 512)) END) AS r0 FROM s),
k AS (SELECT *, row_number() OVER (PARTITION BY image_id ORDER BY c0, r0) AS place FROM t)
SELECT image_id, r0, least(r0 + 512, height) AS r1, c0, least(c0 + 512, width) AS c1 FROM k WHERE place <= 6""",
    "output_orders": with_tables(["survey_before"], f"SELECT before_id, CAST(floor(cy / 64) AS BIGINT) AS band, {_PLACES} FROM survey_before"),
}
