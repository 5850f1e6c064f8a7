"""Queries that score detections and compare runs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.operators import evaluation as E
from tidemark.plans.fixtures import load, with_tables

METRICS = ["bbox_ap50", "segm_ap50"]


def _sides(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Images, detections, ground truth, with corners."""
    d, g, pictures = load(spark, sf_dir, "detections", "gt_boxes", "pictures")
    corners = [F.col("x").alias("x1"), F.col("y").alias("y1"), (F.col("x") + F.col("w")).alias("x2"), (F.col("y") + F.col("h")).alias("y2")]
    return pictures, d.select("det_id", "image_id", "score", *corners), g.select("gt_id", "image_id", "iscrowd", *corners)


def greedy_pr_per_tile(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = E.precision_recall(*_sides(spark, sf_dir))
    return rows.select("image_id", "tp", "fp", "fn", *[F.round(c, 6).alias(c) for c in ("precision", "recall", "f1")])


def pr_micro_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return E.micro_totals(E.precision_recall(*_sides(spark, sf_dir)))


def coco_ap_ar_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    return E.coco_metrics(*_sides(spark, sf_dir)[1:], [])


def coco_ap_ar_per_tile(spark: SparkSession, sf_dir: str) -> DataFrame:
    return E.coco_metrics(*_sides(spark, sf_dir)[1:], ["image_id"])


def ignore_regions(spark: SparkSession, sf_dir: str) -> DataFrame:
    _, dets, truth = _sides(spark, sf_dir)
    labelled = dets.withColumn("label", (F.col("det_id") % 2).cast("int"))
    return E.mark_ignored(labelled, truth.where("iscrowd = 1")).select("det_id", "label")


def detection_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Detections of sufficient score and area, outside the excluded classes."""
    (d,) = load(spark, sf_dir, "detections")
    return d.where("score >= 0.4D and w * h >= 600 and image_id % 10 <> 3").groupBy("image_id").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("score"), 6).alias("total_score"))


def split_difficulty(spark: SparkSession, sf_dir: str) -> DataFrame:
    sides = _sides(spark, sf_dir)
    rows = E.precision_recall(*sides).select("image_id", "precision", "recall")
    setup = F.explode(F.array(*[F.struct(F.lit(f"setup{k}").alias("setup"), F.when(F.col("image_id") % (k + 3) == 0, "test").otherwise("train").alias("split")) for k in range(3)]))
    setups = sides[0].withColumn("s", setup).select("image_id", "s.*")
    out = E.difficulty(rows, setups, ["precision", "recall"], ["image_id"])
    return out.select("setup", "metric", "n", *[F.round(c, 6).alias(c) for c in ("mean", "std", "least", "most")])


def metric_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Precision as a grid of tile rows and columns; columns are named by their number."""
    rows = E.precision_recall(*_sides(spark, sf_dir)).select(F.floor(F.col("image_id") / 10).cast("long").alias("tile_row"), (F.col("image_id") % 10).alias("c"), F.round("precision", 6).alias("p"))
    wide = rows.groupBy("tile_row").pivot("c", list(range(10))).agg(F.first("p"))
    return wide.select("tile_row", *[F.col(f"`{k}`").alias(f"c{k}") for k in range(10)])


def run_compare(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last value of each metric of each run, ranked by the first metric."""
    (m,) = load(spark, sf_dir, "metric_events")
    from pyspark.sql.window import Window

    last = m.groupBy("run").agg(*[F.max_by(c, "iteration").alias(c) for c in METRICS])
    return last.withColumn("place", F.row_number().over(Window.orderBy(F.desc_nulls_last("bbox_ap50"), "run")).cast("long"))


def run_best(spark: SparkSession, sf_dir: str) -> DataFrame:
    (m,) = load(spark, sf_dir, "metric_events")
    long = m.select("run", "iteration", F.explode(F.array(*[F.struct(F.lit(c).alias("metric"), F.col(c).alias("value")) for c in METRICS])).alias("m")).select("run", "iteration", "m.*")
    return long.groupBy("metric").agg(F.max("value").alias("best"), F.max_by("run", F.struct("value", (-F.col("run")).alias("a"), (-F.col("iteration")).alias("b"))).alias("run"))


def early_stop(spark: SparkSession, sf_dir: str) -> DataFrame:
    (m,) = load(spark, sf_dir, "metric_events")
    return E.early_stop(m.select("run", "iteration", F.col("bbox_ap50").alias("value")), 4000)


QUERIES = {f.__name__: f for f in (greedy_pr_per_tile, pr_micro_totals, coco_ap_ar_split, coco_ap_ar_per_tile, ignore_regions, detection_filter, split_difficulty, metric_grid, run_compare, run_best, early_stop)}

_TABLES = ["detections", "gt_boxes", "pictures"]
_BOTH = """
d AS (SELECT det_id, image_id AS g, score, x AS x1, y AS y1, x + w AS x2, y + h AS y2, w * h AS area FROM detections),
t AS (SELECT gt_id, image_id AS g, iscrowd, x AS x1, y AS y1, x + w AS x2, y + h AS y2, w * h AS area FROM gt_boxes),
i AS (SELECT det_id, gt_id, d.g, iscrowd, d.area AS da, t.area AS ta, greatest(least(d.x2, t.x2) - greatest(d.x1, t.x1), 0) * greatest(least(d.y2, t.y2) - greatest(d.y1, t.y1), 0) AS inter
  FROM d JOIN t ON d.g = t.g AND d.x1 <= t.x2 AND t.x1 <= d.x2 AND d.y1 <= t.y2 AND t.y1 <= d.y2)"""
_PR = _BOTH + """,
c AS (SELECT det_id, list(gt_id ORDER BY inter / (da + ta - inter) DESC, gt_id) AS c FROM i WHERE iscrowd = 0 AND inter / (da + ta - inter) >= 0.5 GROUP BY det_id),
r AS (SELECT d.det_id, g, coalesce(c, CAST([] AS BIGINT[])) AS c, row_number() OVER (PARTITION BY g ORDER BY score DESC, d.det_id) AS k FROM d LEFT JOIN c ON c.det_id = d.det_id),
walk(g, k, used) AS (SELECT DISTINCT g, CAST(0 AS BIGINT), CAST([] AS BIGINT[]) FROM r
  UNION ALL SELECT w.g, w.k + 1, list_concat(w.used, list_filter(r.c, lambda x: NOT list_contains(w.used, x))[1:1]) FROM walk w JOIN r ON r.g = w.g AND r.k = w.k + 1),
tp AS (SELECT g, max(len(used)) AS tp, max(k) AS n FROM walk GROUP BY g),
n AS (SELECT g, count(*) AS n FROM t WHERE iscrowd = 0 GROUP BY g),
counts AS (SELECT CAST(m AS BIGINT) AS image_id, CAST(coalesce(tp.tp, 0) AS BIGINT) AS tp, coalesce(tp.n, 0) - coalesce(tp.tp, 0) AS fp, coalesce(n.n, 0) - coalesce(tp.tp, 0) AS fn FROM (SELECT image_id FROM pictures) x(m) LEFT JOIN tp ON tp.g = m LEFT JOIN n ON n.g = m),
pr AS (SELECT *, CASE WHEN tp + fp + fn = 0 THEN 1 WHEN tp + fp > 0 THEN tp / CAST(tp + fp AS DOUBLE) ELSE 0 END AS precision, CASE WHEN tp + fp + fn = 0 THEN 1 WHEN tp + fn > 0 THEN tp / CAST(tp + fn AS DOUBLE) ELSE 0 END AS recall FROM counts)"""


def _coco_sql(by: bool) -> str:
    g, eq = ("g, ", "f.g = z.g AND ") if by else ("", "")
    return _BOTH + f""",
z0(size, lo, hi) AS (VALUES ('all', CAST(0 AS DOUBLE), CAST(1e10 AS DOUBLE)), ('small', 0, 1024), ('medium', 1024, 9216), ('large', 9216, 1e10)),
z1 AS (SELECT size, lo, hi, CAST(k AS INT) AS t, 0.5 + CAST(0.05 AS DOUBLE) * k AS thr FROM z0, range(10) x(k)),
top AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY g ORDER BY score DESC, det_id) AS place FROM d) WHERE place <= 100),
io AS (SELECT i.*, CASE WHEN iscrowd = 1 THEN inter / da ELSE inter / (da + ta - inter) END AS iou FROM i WHERE inter > 0),
c AS (SELECT det_id, size, t, list(gt_id ORDER BY (iscrowd = 1 OR ta < lo OR ta > hi), iou DESC, gt_id DESC) AS c, list(gt_id) FILTER (iscrowd = 1) AS crowd, list(gt_id) FILTER (iscrowd = 1 OR ta < lo OR ta > hi) AS ig
  FROM io, z1 WHERE iou >= thr GROUP BY det_id, size, t),
r AS (SELECT top.g, top.det_id, top.score, place, z1.size, z1.t, coalesce(c, CAST([] AS BIGINT[])) AS c, coalesce(crowd, CAST([] AS BIGINT[])) AS crowd, coalesce(ig, CAST([] AS BIGINT[])) AS ig, (area < lo OR area > hi) AS outside
  FROM top CROSS JOIN z1 LEFT JOIN c ON c.det_id = top.det_id AND c.size = z1.size AND c.t = z1.t),
walk(g, size, t, k, used, pick) AS (SELECT DISTINCT g, size, t, CAST(0 AS BIGINT), CAST([] AS BIGINT[]), CAST([] AS BIGINT[]) FROM r
  UNION ALL SELECT w.g, w.size, w.t, w.k + 1, list_concat(w.used, list_filter(r.c, lambda x: list_contains(r.crowd, x) OR NOT list_contains(w.used, x))[1:1]), list_filter(r.c, lambda x: list_contains(r.crowd, x) OR NOT list_contains(w.used, x))[1:1]
  FROM walk w JOIN r ON r.g = w.g AND r.size = w.size AND r.t = w.t AND r.place = w.k + 1),
f AS (SELECT r.g, r.size, r.t, place, score, len(pick) > 0 AND NOT list_has_any(ig, pick) AS tp FROM walk w JOIN r ON r.g = w.g AND r.size = w.size AND r.t = w.t AND r.place = w.k
  WHERE NOT CASE WHEN len(pick) > 0 THEN list_has_any(ig, pick) ELSE outside END),
z AS (SELECT {g}size, count(*) AS npig FROM t, z0 WHERE iscrowd = 0 AND area >= lo AND area <= hi GROUP BY ALL),
curve AS (SELECT f.*, npig, sum(CASE WHEN tp THEN 1 ELSE 0 END) OVER o AS tps, count(*) OVER o AS n FROM f JOIN z ON {eq}f.size = z.size WINDOW o AS (PARTITION BY {'f.g, ' if by else ''}f.size, t ORDER BY score DESC, f.g, place)),
env AS (SELECT *, max(CAST(tps AS DOUBLE) / n) OVER (PARTITION BY {g}size, t ORDER BY score DESC, g, place ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS e, 100 * CAST(tps AS BIGINT) // npig + 1 AS steps FROM curve),
gain AS (SELECT *, e * (steps - lag(steps, 1, 0) OVER (PARTITION BY {g}size, t ORDER BY score DESC, g, place)) AS gain FROM env),
ap AS (SELECT {g}size, t, sum(gain) / 101 AS ap, count(*) FILTER (tp AND place <= 1) / CAST(max(npig) AS DOUBLE) AS ar1, count(*) FILTER (tp AND place <= 10) / CAST(max(npig) AS DOUBLE) AS ar10, count(*) FILTER (tp) / CAST(max(npig) AS DOUBLE) AS ar100 FROM gain GROUP BY ALL),
full_ap AS (SELECT {'z.g, ' if by else ''}z.size, CAST(k AS INT) AS t, coalesce(ap, 0) AS ap, coalesce(ar1, 0) AS ar1, coalesce(ar10, 0) AS ar10, coalesce(ar100, 0) AS ar100 FROM z CROSS JOIN range(10) x(k) LEFT JOIN ap ON {'ap.g = z.g AND ' if by else ''}ap.size = z.size AND ap.t = k)
SELECT {'g AS image_id, ' if by else ''}round(100 * avg(ap) FILTER (size = 'all'), 6) AS ap, round(100 * avg(ap) FILTER (size = 'all' AND t = 0), 6) AS ap50, round(100 * avg(ap) FILTER (size = 'all' AND t = 5), 6) AS ap75,
  round(100 * avg(ap) FILTER (size = 'small'), 6) AS aps, round(100 * avg(ap) FILTER (size = 'medium'), 6) AS apm, round(100 * avg(ap) FILTER (size = 'large'), 6) AS apl,
  round(100 * avg(ar1) FILTER (size = 'all'), 6) AS ar1, round(100 * avg(ar10) FILTER (size = 'all'), 6) AS ar10, round(100 * avg(ar100) FILTER (size = 'all'), 6) AS ar100,
  round(100 * avg(ar100) FILTER (size = 'small'), 6) AS ars, round(100 * avg(ar100) FILTER (size = 'medium'), 6) AS arm, round(100 * avg(ar100) FILTER (size = 'large'), 6) AS arl
FROM full_ap{' GROUP BY g' if by else ''}"""


ORACLES = {
    "greedy_pr_per_tile": with_tables(_TABLES, _PR + """
SELECT image_id, tp, fp, fn, round(precision, 6) AS precision, round(recall, 6) AS recall, round(CASE WHEN precision + recall > 0 THEN 2 * precision * recall / (precision + recall) ELSE 0 END, 6) AS f1 FROM pr"""),
    "pr_micro_totals": with_tables(_TABLES, _PR + """,
s AS (SELECT CAST(sum(tp) AS BIGINT) AS tp, CAST(sum(fp) AS BIGINT) AS fp, CAST(sum(fn) AS BIGINT) AS fn FROM pr)
SELECT tp, fp, fn, round(tp / CAST(tp + fp AS DOUBLE), 4) AS precision, round(tp / CAST(tp + fn AS DOUBLE), 4) AS recall, round(2 * tp / CAST(2 * tp + fp + fn AS DOUBLE), 4) AS f1 FROM s"""),
    "coco_ap_ar_split": with_tables(_TABLES, _coco_sql(False)),
    "coco_ap_ar_per_tile": with_tables(_TABLES, _coco_sql(True)),
    "ignore_regions": with_tables(_TABLES, _BOTH + """
SELECT d.det_id, CASE WHEN d.det_id % 2 = 0 AND m >= 0.5 THEN -1 ELSE CAST(d.det_id % 2 AS INT) END AS label
FROM d LEFT JOIN (SELECT det_id, max(inter / (da + ta - inter)) AS m FROM i WHERE iscrowd = 1 GROUP BY det_id) x ON x.det_id = d.det_id"""),
    "detection_filter": with_tables(["detections"], "SELECT image_id, count(*) AS n, round(sum(score), 6) AS total_score FROM detections WHERE score >= 0.4 AND w * h >= 600 AND image_id % 10 <> 3 GROUP BY image_id"),
    "split_difficulty": with_tables(_TABLES, _PR + """,
long AS (SELECT image_id, 'precision' AS metric, precision AS v FROM pr UNION ALL SELECT image_id, 'recall', recall FROM pr)
SELECT 'setup' || k AS setup, metric, count(*) AS n, round(avg(v), 6) AS mean, round(stddev_pop(v), 6) AS std, round(min(v), 6) AS least, round(max(v), 6) AS most FROM long, range(3) x(k) WHERE image_id % (k + 3) = 0 GROUP BY ALL"""),
    "metric_grid": with_tables(_TABLES, _PR + "\nSELECT image_id // 10 AS tile_row, " + ", ".join(f"max(round(precision, 6)) FILTER (image_id % 10 = {k}) AS c{k}" for k in range(10)) + " FROM pr GROUP BY 1"),
    "run_compare": with_tables(["metric_events"], """l AS (SELECT run, arg_max(bbox_ap50, iteration) AS bbox_ap50, arg_max(segm_ap50, iteration) AS segm_ap50 FROM metric_events GROUP BY run)
SELECT *, row_number() OVER (ORDER BY bbox_ap50 DESC NULLS LAST, run) AS place FROM l"""),
    "run_best": with_tables(["metric_events"], """l AS (SELECT run, iteration, 'bbox_ap50' AS metric, bbox_ap50 AS v FROM metric_events UNION ALL SELECT run, iteration, 'segm_ap50', segm_ap50 FROM metric_events)
SELECT metric, max(v) AS best, first(run ORDER BY v DESC, run, iteration) AS run FROM l GROUP BY metric"""),
    "early_stop": with_tables(["metric_events"], """b AS (SELECT run, iteration, bbox_ap50 AS v, max(bbox_ap50) OVER (PARTITION BY run ORDER BY iteration) AS top FROM metric_events),
c AS (SELECT x.run, x.iteration, min(y.iteration) AS best FROM b x JOIN b y ON x.run = y.run AND y.iteration <= x.iteration AND y.v = x.top GROUP BY x.run, x.iteration),
s AS (SELECT run, min(iteration) FILTER (iteration - best >= 4000) AS stop_iteration FROM c GROUP BY run)
SELECT c.run, arg_max(best, iteration) AS best_iteration, any_value(stop_iteration) AS stop_iteration FROM c JOIN s USING (run) WHERE stop_iteration IS NULL OR iteration <= stop_iteration GROUP BY c.run"""),
}
