"""Queries that choose among overlapping boxes."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions import geometry as G
from tidemark.operators.overlap import ring_overlaps
from tidemark.operators.selection import engulfing, merge_under_leaders, suppress
from tidemark.plans.fixtures import load, with_tables


def boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    (d,) = load(spark, sf_dir, "detections")
    return d.select(F.col("det_id").alias("id"), "image_id", F.col("x").alias("x1"), F.col("y").alias("y1"), (F.col("x") + F.col("w")).alias("x2"), (F.col("y") + F.col("h")).alias("y2"), "score")


def box_nms(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = suppress(boxes(spark, sf_dir), 64.0, 0.4, group=["image_id"]).where("leader = id")
    return kept.select(F.col("id").alias("det_id"), "image_id", F.round("score", 6).alias("score"), F.col("kept_from_n").cast("long").alias("kept_from_n"))


def _layer(spark: SparkSession, sf_dir: str) -> DataFrame:
    before, after = load(spark, sf_dir, "match_before", "match_after")
    both = before.select((2 * F.col("before_id")).alias("id"), "cx", "cy", "side", "score").union(after.select(2 * F.col("after_id") + 1, "cx", "cy", "side", "score"))
    half = F.col("side") / 2
    return both.select("id", (F.col("cx") - half).alias("x1"), (F.col("cy") - half).alias("y1"), (F.col("cx") + half).alias("x2"), (F.col("cy") + half).alias("y2"), "score")


def polygon_dedupe(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = suppress(_layer(spark, sf_dir), 8.0, 0.4, 0.75).where("leader = id")
    return kept.select("id", F.round("score", 6).alias("score"), F.col("kept_from_n").cast("long").alias("kept_from_n"))


def nested_suppression(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = boxes(spark, sf_dir)
    return b.join(engulfing(b, 64.0, group=["image_id"]), "id", "left_semi").select(F.col("id").alias("det_id"), "image_id")


def _merged(b: DataFrame, **options) -> DataFrame:
    m = merge_under_leaders(b, 64.0, group=["image_id"], **options)
    return m.select("leader", F.col("duplicate").cast("long").alias("duplicate"), F.round("score", 6).alias("score"), "x1", "y1", "x2", "y2")


def leader_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _merged(boxes(spark, sf_dir))


def leader_merge_min_group(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _merged(boxes(spark, sf_dir), min_ratio=None, min_group=2, nested=False)


def _diamonds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The objects of both surveys as the diamonds inside their boxes: outlines and boxes overlap differently."""
    x, y = (F.col("x1") + F.col("x2")) / 2, (F.col("y1") + F.col("y2")) / 2
    ring = F.array(G.point(F.col("x2"), y), G.point(x, F.col("y2")), G.point(F.col("x1"), y), G.point(x, F.col("y1")))
    return _layer(spark, sf_dir).withColumn("ring", ring)


def outline_dedupe(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = suppress(_diamonds(spark, sf_dir), 8.0, 0.4, 0.75).where("leader = id")
    return kept.select("id", F.round("score", 6).alias("score"), F.col("kept_from_n").cast("long").alias("kept_from_n"))


def outline_overlaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of outlines by the area they share."""
    d = _diamonds(spark, sf_dir)
    pairs = ring_overlaps(d.select(F.col("id").alias("l_id"), "ring"), d.select(F.col("id").alias("r_id"), "ring"), 8.0, once=True).where("overlap > 1e-6")
    return pairs.select("l_id", "r_id", *[F.round(c, 6).alias(c) for c in ("overlap", "iou", "over_smaller")])


def outline_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = merge_under_leaders(_diamonds(spark, sf_dir), 8.0)
    return m.select("leader", F.col("duplicate").cast("long").alias("duplicate"), F.round("score", 6).alias("score"), "x1", "y1", "x2", "y2")


QUERIES = {f.__name__: f for f in (outline_dedupe, outline_overlaps, outline_merge, box_nms, polygon_dedupe, nested_suppression, leader_merge, leader_merge_min_group)}

BOXES = "b AS (SELECT det_id AS id, image_id AS g, x AS x1, y AS y1, x + w AS x2, y + h AS y2, w * h AS area, score FROM detections)"
_LAYER = """o AS (SELECT 2 * before_id AS id, cx, cy, side, score FROM match_before UNION ALL SELECT 2 * after_id + 1, cx, cy, side, score FROM match_after),
b AS (SELECT id, 0 AS g, cx, cy, cx - side / 2 AS x1, cy - side / 2 AS y1, cx + side / 2 AS x2, cy + side / 2 AS y2, side * side AS area, score FROM o)"""
PAIRS = """
p AS (SELECT a.id AS a, c.id AS c, a.area AS aa, c.area AS ca, greatest(least(a.x2, c.x2) - greatest(a.x1, c.x1), 0) * greatest(least(a.y2, c.y2) - greatest(a.y1, c.y1), 0) AS i
  FROM b a JOIN b c ON a.g = c.g AND a.id <> c.id AND a.x1 <= c.x2 AND c.x1 <= a.x2 AND a.y1 <= c.y2 AND c.y1 <= a.y2)"""
#: Diamonds are boxes of twice the area along the diagonals u = x + y, v = x - y.
DIAMONDS = """
p AS (SELECT a.id AS a, c.id AS c, a.area / 2 AS aa, c.area / 2 AS ca, greatest(least(a.u + a.h, c.u + c.h) - greatest(a.u - a.h, c.u - c.h), 0) * greatest(least(a.v + a.h, c.v + c.h) - greatest(a.v - a.h, c.v - c.h), 0) / 2 AS i
  FROM (SELECT *, cx + cy AS u, cx - cy AS v, (x2 - x1) / 2 AS h FROM b) a JOIN (SELECT *, cx + cy AS u, cx - cy AS v, (x2 - x1) / 2 AS h FROM b) c ON a.id <> c.id AND a.x1 <= c.x2 AND c.x1 <= a.x2 AND a.y1 <= c.y2 AND c.y1 <= a.y2)"""
#: Greedy choice in the order of ranked(id, g, k), by conflicts(a, c) both ways round: kept(g, ids).
GREEDY = """
early AS (SELECT r.id, r.g, r.k, coalesce(list(e.id ORDER BY e.k) FILTER (e.id IS NOT NULL), CAST([] AS BIGINT[])) AS seen
  FROM ranked r LEFT JOIN conflicts f ON f.a = r.id LEFT JOIN ranked e ON e.id = f.c AND e.k < r.k GROUP BY r.id, r.g, r.k),
walk(g, k, kept) AS (SELECT DISTINCT g, CAST(0 AS BIGINT), CAST([] AS BIGINT[]) FROM ranked
  UNION ALL SELECT w.g, w.k + 1, CASE WHEN list_has_any(w.kept, e.seen) THEN w.kept ELSE list_append(w.kept, e.id) END FROM walk w JOIN early e ON e.g = w.g AND e.k = w.k + 1),
kept AS (SELECT g, arg_max(kept, k) AS ids FROM walk GROUP BY g),
led AS (SELECT e.id, CASE WHEN list_contains(ids, e.id) THEN e.id ELSE list_filter(seen, lambda s: list_contains(ids, s))[1] END AS leader FROM early e JOIN kept ON kept.g = e.g)"""
_BY_SCORE = "ranked AS (SELECT id, g, row_number() OVER (PARTITION BY g ORDER BY score DESC, id) AS k FROM b)"
_NESTED = "nested AS (SELECT DISTINCT a AS id FROM p WHERE ca < aa AND i >= 0.5 * ca AND ca / aa < 0.25)"
_MERGED = "\nSELECT leader, count(*) AS duplicate, round(max(score), 6) AS score, min(x1) AS x1, min(y1) AS y1, max(x2) AS x2, max(y2) AS y2 FROM led JOIN b USING (id) GROUP BY leader"

ORACLES = {
    "box_nms": with_tables(["detections"], f"{BOXES},{PAIRS},\nconflicts AS (SELECT a, c FROM p WHERE i / (aa + ca - i) >= 0.4),\n{_BY_SCORE},{GREEDY}" + """
SELECT b.id AS det_id, b.g AS image_id, round(b.score, 6) AS score, n AS kept_from_n FROM b JOIN (SELECT leader, count(*) AS n FROM led GROUP BY leader) l ON l.leader = b.id"""),
    "polygon_dedupe": with_tables(["match_before", "match_after"], f"{_LAYER},{PAIRS}," + """
conflicts AS (SELECT a, c FROM p WHERE i / (aa + ca - i) >= 0.4 UNION SELECT a.id, c.id FROM b a JOIN b c ON a.id <> c.id AND abs(a.cx - c.cx) <= 0.75 AND sqrt((a.cx - c.cx) * (a.cx - c.cx) + (a.cy - c.cy) * (a.cy - c.cy)) <= 0.75),
""" + f"{_BY_SCORE},{GREEDY}" + """
SELECT b.id, round(b.score, 6) AS score, n AS kept_from_n FROM b JOIN (SELECT leader, count(*) AS n FROM led GROUP BY leader) l ON l.leader = b.id"""),
    "outline_dedupe": with_tables(["match_before", "match_after"], f"{_LAYER},{DIAMONDS}," + """
conflicts AS (SELECT a, c FROM p WHERE i / (aa + ca - i) >= 0.4 UNION SELECT a.id, c.id FROM b a JOIN b c ON a.id <> c.id AND abs(a.cx - c.cx) <= 0.75 AND sqrt((a.cx - c.cx) * (a.cx - c.cx) + (a.cy - c.cy) * (a.cy - c.cy)) <= 0.75),
""" + f"{_BY_SCORE},{GREEDY}" + """
SELECT b.id, round(b.score, 6) AS score, n AS kept_from_n FROM b JOIN (SELECT leader, count(*) AS n FROM led GROUP BY leader) l ON l.leader = b.id"""),
    "outline_overlaps": with_tables(["match_before", "match_after"], f"{_LAYER},{DIAMONDS}" + """
SELECT a AS l_id, c AS r_id, round(i, 6) AS overlap, round(i / (aa + ca - i), 6) AS iou, round(i / least(aa, ca), 6) AS over_smaller FROM p WHERE a < c AND i > 1e-6"""),
    "outline_merge": with_tables(["match_before", "match_after"], f"{_LAYER},{DIAMONDS},\n{_NESTED}," + """
conflicts AS (SELECT a, c FROM p WHERE i > 0.15 * least(aa, ca) AND least(aa, ca) >= 0.25 * greatest(aa, ca) AND a NOT IN (SELECT id FROM nested) AND c NOT IN (SELECT id FROM nested)),
ranked AS (SELECT id, g, row_number() OVER (PARTITION BY g ORDER BY area DESC, id) AS k FROM b WHERE id NOT IN (SELECT id FROM nested)),""" + GREEDY + _MERGED),
    "nested_suppression": with_tables(["detections"], f"{BOXES},{PAIRS},\n{_NESTED}\nSELECT b.id AS det_id, b.g AS image_id FROM b JOIN nested USING (id)"),
    "leader_merge": with_tables(["detections"], f"{BOXES},{PAIRS},\n{_NESTED}," + """
conflicts AS (SELECT a, c FROM p WHERE i > 0.15 * least(aa, ca) AND least(aa, ca) >= 0.25 * greatest(aa, ca) AND a NOT IN (SELECT id FROM nested) AND c NOT IN (SELECT id FROM nested)),
ranked AS (SELECT id, g, row_number() OVER (PARTITION BY g ORDER BY area DESC, id) AS k FROM b WHERE id NOT IN (SELECT id FROM nested)),""" + GREEDY + _MERGED),
    "leader_merge_min_group": with_tables(["detections"], f"{BOXES},{PAIRS}," + """
conflicts AS (SELECT a, c FROM p WHERE i > 0.15 * least(aa, ca)),
ranked AS (SELECT id, g, row_number() OVER (PARTITION BY g ORDER BY area DESC, id) AS k FROM b),""" + GREEDY + _MERGED + " HAVING count(*) >= 2"),
}
