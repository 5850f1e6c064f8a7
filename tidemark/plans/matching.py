"""Queries on surveys: measures, scores, matches and what follows from them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidemark.functions import geometry as G
from tidemark.operators import matching
from tidemark.operators.spatial import box_pairs, overlap_of_pair, sides
from tidemark.operators.layers import output_order
from tidemark.plans.fixtures import load, with_tables

SURVEY = ["match_before", "match_after"]


def _square(df: DataFrame) -> DataFrame:
    """A survey's footprints: x1, y1, x2, y2 and area beside its columns."""
    half = F.col("side") / 2
    return df.withColumns({"x1": F.col("cx") - half, "y1": F.col("cy") - half, "x2": F.col("cx") + half, "y2": F.col("cy") + half, "area": F.col("side") * F.col("side")})


def _ring() -> G.Column:
    return G.box_ring(*[F.col(c) for c in ("x1", "y1", "x2", "y2")])


def _surveys(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    return tuple(_square(d) for d in load(spark, sf_dir, *SURVEY))


def ring_measures(spark: SparkSession, sf_dir: str) -> DataFrame:
    (before,) = load(spark, sf_dir, "survey_before")
    ringed = _square(before).select("before_id", _ring().alias("ring"))
    c, b = G.ring_centroid(F.col("ring")), G.ring_box(F.col("ring"))
    six = lambda x: F.round(x, 6)
    return ringed.select(
        "before_id",
        six(G.ring_area(F.col("ring"))).alias("area"),
        six(G.ring_perimeter(F.col("ring"))).alias("perimeter"),
        six(c["x"]).alias("centroid_x"),
        six(c["y"]).alias("centroid_y"),
        b["x1"].alias("bbox_x"),
        b["y1"].alias("bbox_y"),
        (b["x2"] - b["x1"]).alias("bbox_w"),
        (b["y2"] - b["y1"]).alias("bbox_h"),
    )


def axes_moments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Axes of rectangles of side and twice the side: the ellipse of equal moments has axes 4/sqrt(12) of the sides."""
    (before,) = load(spark, sf_dir, "survey_before")
    ring = G.box_ring(F.col("cx") - F.col("side"), F.col("cy") - F.col("side") / 2, F.col("cx") + F.col("side"), F.col("cy") + F.col("side") / 2)
    m = G.ring_moments(F.col("ring"))
    return before.select("before_id", ring.alias("ring")).select("before_id", m.alias("m")).select("before_id", F.round("m.major", 4).alias("major"), F.round("m.minor", 4).alias("minor"), F.round("m.orientation", 3).alias("orientation"))


def pixel_world_six(spark: SparkSession, sf_dir: str) -> DataFrame:
    (before,) = load(spark, sf_dir, "survey_before")
    x, y, one = F.col("cx"), F.col("cy"), F.lit
    x0, ytop, px, py = one(16.0), one(4096.0), one(0.25), one(0.5)
    cells = {
        "corner": G.corner_to_world(x, y, x0, ytop, px, -py),
        "inverse": G.world_to_corner(x, y, x0, ytop, px, -py),
        "centre": G.centre_to_world(x, y, x0, ytop, px, -py),
        "half": G.half_pixel_to_world(x, y, x0, ytop, px, py),
        "whole": G.whole_pixel_to_world(x, y, x0, ytop, px, py),
        "ratio": G.world_to_ratio(x, y, (one(0.0), one(0.0), one(1024.0), one(512.0)), one(2048.0), one(256.0)),
        "pixel": G.world_to_half_pixel(x, y, x0, ytop, px, py),
    }
    made = before.select("before_id", *[c.alias(n) for n, c in cells.items()])
    return made.select("before_id", *[F.col(f"{n}.{a}").alias(f"{n}_{a}") for n in cells for a in "xy"])


def pair_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = matching.candidates(*_surveys(spark, sf_dir))
    return found.select("before_id", "after_id", F.round("dist", 6).alias("distance"), F.round("score", 6).alias("score"))


def _found(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    return matching.match(*_surveys(spark, sf_dir))


def assignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _found(spark, sf_dir)["matches"].select("before_id", "after_id", F.round("score", 6).alias("score"))


def movement_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = _found(spark, sf_dir)["matches"]
    return m.select("before_id", "after_id", "dx", "dy", F.round("distance", 6).alias("distance"), "rotation", "before_area", "after_area", "before_volume", "after_volume")


def survey_outcomes(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = matching.outcomes(_found(spark, sf_dir))
    return rows.groupBy("outcome").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("score"), 6).alias("mean_score"), F.round(F.max("distance"), 6).alias("max_distance"))


def outcome_accuracy(spark: SparkSession, sf_dir: str) -> DataFrame:
    before, after = _surveys(spark, sf_dir)
    ids = before.where("before_id >= 0").select("before_id")
    others = after.where("after_id >= 0 OR after_id % 2 = 0").select("after_id")
    key = ids.join(others, ids.before_id == others.after_id, "full")
    return matching.outcome_accuracy(matching.outcomes(_found(spark, sf_dir)), key)


def topk_matches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The feature is the limit: the 40 best matches for a reviewer."""
    m = _found(spark, sf_dir)["matches"].select("before_id", "after_id", F.round("score", 6).alias("score"))
    return m.orderBy(F.desc("score"), "before_id").limit(40)



def ordered_output(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Place of each object within its band of rows, largest first and west to east."""
    (before,) = load(spark, sf_dir, "survey_before")
    band = F.floor(F.col("cy") / 64).cast("long")
    by = lambda name: F.row_number().over(Window.partitionBy("band").orderBy(*output_order(name, "before_id"))).cast("long")
    return _square(before).withColumn("band", band).select("before_id", "band", by("large2small").alias("by_size"), by("west2east").alias("by_x"))


def next_unlabelled(spark: SparkSession, sf_dir: str) -> DataFrame:
    """From each of eight places the next object without a volume, round the end of the list."""
    (before,) = load(spark, sf_dir, "survey_before")
    n = before.count()
    starts = spark.range(8).select((F.col("id") * F.lit(n // 8)).alias("start"))
    open_items = before.where("volume IS NULL").select(F.col("before_id").alias("next_id"))
    gap = F.pmod(F.col("next_id") - F.col("start"), F.lit(n))
    return starts.join(F.broadcast(starts).withColumnRenamed("start", "s2"), F.col("start") == F.col("s2")).drop("s2").join(open_items).groupBy("start").agg(F.min_by("next_id", gap).alias("next_id"))


def annotation_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Manual annotations that touch each object: those of sufficient overlap, else all; the best by overlap."""
    before, manual = load(spark, sf_dir, "survey_before", "manual_ann")
    objects = _square(before)
    pairs = box_pairs(sides(objects, "l", ["before_id"]), sides(manual, "r", ["ann_fid"]), 8.0)
    iou = G.box_iou(tuple(F.col("l" + c) for c in ("x1", "y1", "x2", "y2")), tuple(F.col("r" + c) for c in ("x1", "y1", "x2", "y2")))
    hits = pairs.select(F.col("lbefore_id").alias("before_id"), F.col("rann_fid").alias("fid"), iou.alias("iou"))
    per = hits.groupBy("before_id").agg(
        F.sort_array(F.collect_list(F.when(F.col("iou") >= 0.05, F.struct((-F.col("iou")).alias("k"), "fid")))).alias("good"),
        F.sort_array(F.collect_list(F.struct((-F.col("iou")).alias("k"), "fid"))).alias("any"),
        F.max("iou").alias("best"),
        F.min_by("fid", F.struct((-F.col("iou")).alias("k"), F.col("fid"))).alias("first"),
    )
    fids = F.transform(F.when(F.size("good") > 0, F.col("good")).otherwise(F.col("any")), lambda h: h["fid"].cast("string"))
    done = objects.select("before_id").join(per, "before_id", "left")
    return done.select("before_id", F.coalesce(F.array_join(fids, ","), F.lit("")).alias("fids"), F.when(F.col("best") > 0, F.col("first")).alias("best_fid"), F.round(F.coalesce("best", F.lit(0.0)), 4).alias("best_iou"))


QUERIES = {f.__name__: f for f in (ring_measures, axes_moments, pixel_world_six, pair_scores, assignment, movement_vectors, survey_outcomes, outcome_accuracy, topk_matches, ordered_output, next_unlabelled, annotation_hits)}

_CAND = """
sq AS (SELECT b.before_id, a.after_id, a.cx - b.cx AS dx, a.cy - b.cy AS dy, sqrt((a.cx - b.cx) * (a.cx - b.cx) + (a.cy - b.cy) * (a.cy - b.cy)) AS dist,
    b.side * b.side AS ba, a.side * a.side AS aa, b.volume AS bv, a.volume AS av, b.orientation AS bo, a.orientation AS ao
  FROM match_before b JOIN match_after a ON abs(a.cx - b.cx) <= 5 AND abs(a.cy - b.cy) <= 5),
turned AS (SELECT *, ((ao - bo) % 180 + 180) % 180 AS t FROM sq WHERE dist <= 5),
cand AS (SELECT * FROM (SELECT before_id, after_id, dx, dy, dist, ba, aa, bv, av, least(t, 180 - t) AS rotation, round(
    CAST(0.3 AS DOUBLE) * greatest(0, 1 - dist / 5) + CAST(0.25 AS DOUBLE) * exp(-abs(ln((ba + 1e-6) / (aa + 1e-6))))
    + CAST(0.35 AS DOUBLE) * CASE WHEN bv IS NULL OR av IS NULL THEN 0.5 ELSE exp(-abs(ln((bv + 1e-6) / (av + 1e-6)))) END
    + CAST(0.1 AS DOUBLE) * CASE WHEN bo IS NULL OR ao IS NULL THEN 0.5 ELSE greatest(0, 1 - least(t, 180 - t) / 90) END, 9) AS score
  FROM turned) WHERE score >= 0.55)"""

_BEST = _CAND + """,
links AS (SELECT 2 * before_id AS u, 2 * after_id + 1 AS v FROM cand UNION SELECT 2 * after_id + 1, 2 * before_id FROM cand),
reach(n, m) AS (SELECT u, u FROM links UNION SELECT r.n, l.v FROM reach r JOIN links l ON r.m = l.u),
roots AS (SELECT n, min(m) AS root FROM reach GROUP BY n),
e AS (SELECT root, row_number() OVER (PARTITION BY root ORDER BY before_id, after_id) AS k, cand.* FROM cand JOIN roots ON n = 2 * before_id),
walk(root, k, sa, sb, n, total, ks) AS (
  SELECT DISTINCT root, CAST(0 AS BIGINT), CAST([] AS BIGINT[]), CAST([] AS BIGINT[]), 0, CAST(0 AS DOUBLE), CAST([] AS BIGINT[]) FROM e
  UNION ALL
  SELECT w.root, w.k + 1, CASE WHEN take THEN list_append(sa, before_id) ELSE sa END, CASE WHEN take THEN list_append(sb, after_id) ELSE sb END,
    n + CASE WHEN take THEN 1 ELSE 0 END, total + CASE WHEN take THEN score ELSE 0 END, CASE WHEN take THEN list_append(ks, e.k) ELSE ks END
  FROM walk w JOIN e ON e.root = w.root AND e.k = w.k + 1 CROSS JOIN (VALUES (true), (false)) t(take)
  WHERE NOT take OR NOT (list_contains(sa, before_id) OR list_contains(sb, after_id))),
best AS (SELECT root, ks FROM (SELECT w.*, row_number() OVER (PARTITION BY w.root ORDER BY n DESC, total DESC) AS place FROM walk w
  JOIN (SELECT root, max(k) AS last FROM e GROUP BY root) s ON s.root = w.root AND s.last = w.k) WHERE place = 1),
matched AS (SELECT e.* FROM e JOIN best ON e.root = best.root AND list_contains(ks, e.k))"""

_OUTCOME = _BEST + """,
outcome AS (SELECT 'match' AS outcome, before_id, after_id, score, dist FROM matched
  UNION ALL SELECT 'appeared', NULL, after_id, NULL, NULL FROM match_after WHERE after_id NOT IN (SELECT after_id FROM matched)
  UNION ALL SELECT 'disappeared', before_id, NULL, NULL, NULL FROM match_before WHERE before_id NOT IN (SELECT before_id FROM matched))"""

ORACLES = {
    "ring_measures": with_tables(["survey_before"], """SELECT before_id, round(side * side, 6) AS area, round(4 * side, 6) AS perimeter, round(cx, 6) AS centroid_x, round(cy, 6) AS centroid_y,
  cx - side / 2 AS bbox_x, cy - side / 2 AS bbox_y, side AS bbox_w, side AS bbox_h FROM survey_before"""),
    "axes_moments": with_tables(["survey_before"], """SELECT before_id, round(4 * 2 * side / sqrt(12), 4) AS major, round(4 * side / sqrt(12), 4) AS minor, CAST(0 AS DOUBLE) AS orientation FROM survey_before"""),
    "pixel_world_six": with_tables(["survey_before"], """SELECT before_id, 16 + cx * 0.25 AS corner_x, 4096 - cy * 0.5 AS corner_y, (cx - 16) / 0.25 AS inverse_x, (cy - 4096) / -0.5 AS inverse_y,
  16 + (cx + 0.5) * 0.25 AS centre_x, 4096 - (cy + 0.5) * 0.5 AS centre_y, 16 + (cx - 0.5) * 0.25 AS half_x, 4096 - (cy - 0.5) * 0.5 AS half_y,
  16 + (cx - 1) * 0.25 AS whole_x, 4096 - (cy - 1) * 0.5 AS whole_y, 1 + 2048 * cx / 1024 AS ratio_x, 1 + 256 * (512 - cy) / 512 AS ratio_y,
  1 + round_even(abs(cx - 16) / 0.25, 0) AS pixel_x, 1 + round_even(abs(cy - 4096) / 0.5, 0) AS pixel_y FROM survey_before"""),
    "pair_scores": with_tables(SURVEY, _CAND + "\nSELECT before_id, after_id, round(dist, 6) AS distance, round(score, 6) AS score FROM cand"),
    "assignment": with_tables(SURVEY, _BEST + "\nSELECT before_id, after_id, round(score, 6) AS score FROM matched"),
    "movement_vectors": with_tables(SURVEY, _BEST + """
SELECT before_id, after_id, dx, dy, round(dist, 6) AS distance, rotation, ba AS before_area, aa AS after_area, bv AS before_volume, av AS after_volume FROM matched"""),
    "survey_outcomes": with_tables(SURVEY, _OUTCOME + "\nSELECT outcome, count(*) AS n, round(avg(score), 6) AS mean_score, round(max(dist), 6) AS max_distance FROM outcome GROUP BY outcome"),
    "outcome_accuracy": with_tables(SURVEY, _BEST + """,
key AS (SELECT b.before_id, a.after_id FROM (SELECT before_id FROM match_before WHERE before_id >= 0) b FULL JOIN (SELECT after_id FROM match_after WHERE after_id >= 0 OR after_id % 2 = 0) a ON a.after_id = b.before_id)
SELECT expected, predicted, count(*) AS n FROM (
  SELECT CASE WHEN k.before_id IS NULL THEN 'appeared' WHEN k.after_id IS NULL THEN 'disappeared' ELSE 'match' END AS expected,
    CASE WHEN g.after_id = k.after_id THEN 'match' WHEN g.after_id IS NOT NULL OR r.before_id IS NOT NULL THEN 'wrong_match' WHEN k.before_id IS NOT NULL THEN 'disappeared' ELSE 'appeared' END AS predicted
  FROM key k LEFT JOIN matched g ON g.before_id = k.before_id LEFT JOIN matched r ON r.after_id = k.after_id) GROUP BY ALL"""),
    "topk_matches": with_tables(SURVEY, _BEST + "\nSELECT before_id, after_id, round(score, 6) AS score FROM matched ORDER BY round(score, 6) DESC, before_id LIMIT 40"),
    "ordered_output": with_tables(["survey_before"], """SELECT before_id, CAST(floor(cy / 64) AS BIGINT) AS band, row_number() OVER (PARTITION BY floor(cy / 64) ORDER BY side DESC, before_id) AS by_size,
  row_number() OVER (PARTITION BY floor(cy / 64) ORDER BY cx, before_id) AS by_x FROM survey_before"""),
    "next_unlabelled": with_tables(["survey_before"], """c AS (SELECT count(*) AS n FROM survey_before),
s AS (SELECT CAST(k * (n // 8) AS BIGINT) AS start, n FROM c, range(8) t(k))
SELECT start, arg_min(before_id, ((before_id - start) % n + n) % n) AS next_id FROM s, survey_before WHERE volume IS NULL GROUP BY start"""),
    "annotation_hits": with_tables(["survey_before", "manual_ann"], """o AS (SELECT before_id, cx - side / 2 AS a1, cy - side / 2 AS b1, cx + side / 2 AS a2, cy + side / 2 AS b2 FROM survey_before),
t AS (SELECT before_id, ann_fid AS fid, greatest(least(a2, x2) - greatest(a1, x1), 0) * greatest(least(b2, y2) - greatest(b1, y1), 0) AS i, (a2 - a1) * (b2 - b1) + (x2 - x1) * (y2 - y1) AS s
  FROM o JOIN manual_ann m ON a1 <= x2 AND x1 <= a2 AND b1 <= y2 AND y1 <= b2),
h AS (SELECT before_id, fid, CASE WHEN i > 0 THEN i / (s - i) ELSE CAST(0 AS DOUBLE) END AS iou FROM t),
g AS (SELECT before_id, string_agg(fid, ',' ORDER BY iou DESC, fid) FILTER (iou >= 0.05) AS good, string_agg(fid, ',' ORDER BY iou DESC, fid) AS every, max(iou) AS best,
  first(fid ORDER BY iou DESC, fid) AS f FROM h GROUP BY before_id)
SELECT o.before_id, coalesce(good, every, '') AS fids, CASE WHEN best > 0 THEN f END AS best_fid, round(coalesce(best, CAST(0 AS DOUBLE)), 4) AS best_iou FROM o LEFT JOIN g ON g.before_id = o.before_id"""),
}
