"""Queries on elevation grids and on the objects that stand on them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions import geometry as G
from tidemark.operators import grids
from tidemark.operators import raster as R
from tidemark.plans.fixtures import load, with_tables
from tidemark.storage import stored

ROWS = 32
LOD, LEAST, STATIONARY = 0.1, 0.5, 0.35


def _cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    (cells,) = load(spark, sf_dir, "dsm_cells")
    return cells.withColumn("dz", F.col("z_after") - F.col("z_before"))


def _objects(cells: DataFrame, side: str | None = None) -> DataFrame:
    """On each raster the object before (object 0, columns 2 to 4) and after (object 1, columns 6 to 8)."""
    boxes = [(0, 2.0, 27.0, 5.0, 30.0), (1, 6.0, 27.0, 9.0, 30.0)]
    made = F.explode(F.array(*[F.struct(F.lit(i).cast("long").alias("object_id"), *[F.lit(v).alias(n) for n, v in zip(("x1", "y1", "x2", "y2"), b)]) for i, *b in boxes]))
    return cells.select("raster_id").distinct().withColumn("o", made).select("raster_id", "o.*")


def percentile_stretch(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.stretched(R.filled(_cells(spark, sf_dir), "z_before"), "z_before").select("raster_id", "r", "c", "byte")


def raster_align(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The grid after, on one shifted by a quarter cell down and half a cell left."""
    cells = _cells(spark, sf_dir)
    targets = cells.select("raster_id", "r", "c", (F.col("r") + 0.25).alias("sr"), (F.col("c") - 0.5).alias("sc"))
    return R.aligned(targets, cells, "z_after").select("raster_id", "r", "c", F.round("z_after", 6).alias("z"))


def dod_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    cells = _cells(spark, sf_dir)
    s = R.change_stats(_objects(cells), cells, ROWS, LOD)
    return s.select("raster_id", "object_id", "n", *[F.round(c, 6).alias(c) for c in ("mean_dz", "v_pos", "v_neg", "v_sum", "share_pos", "share_neg")])


def ring_volume(spark: SparkSession, sf_dir: str) -> DataFrame:
    cells = _cells(spark, sf_dir)
    v = R.ring_volumes(_objects(cells), cells, ROWS, "z_before")
    return v.select("raster_id", "object_id", *[F.round(c, 6).alias(c) for c in ("volume", "mean_height", "max_height")])


def _diamonds(cells: DataFrame) -> DataFrame:
    """On each raster two diamonds whose places and sizes differ from raster to raster."""
    i = F.col("raster_id")
    made = F.explode(F.array(*[F.struct(F.lit(k).cast("long").alias("object_id"), (3.5 + 4 * k + i % 3 / F.lit(4.0)).alias("cx"), (28.25 - i % 5 / F.lit(8.0)).alias("cy"), (2.125 + i % 4 / F.lit(2.0)).alias("s")) for k in (0, 1)]))
    o = cells.select("raster_id").distinct().withColumn("o", made).select("raster_id", "o.*")
    x, y, s = F.col("cx"), F.col("cy"), F.col("s")
    return o.select("raster_id", "object_id", F.array(G.point(x + s, y), G.point(x, y + s), G.point(x - s, y), G.point(x, y - s)).alias("ring"))


def outline_change(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Change in the cells that an outline touches."""
    cells = _cells(spark, sf_dir)
    s = R.change_stats(_diamonds(cells), cells, ROWS, LOD)
    return s.select("raster_id", "object_id", "n", *[F.round(c, 6).alias(c) for c in ("mean_dz", "v_pos", "v_neg", "v_sum", "share_pos", "share_neg")])


def outline_volume(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Volume inside an outline above the median of the cells within one cell around it."""
    cells = _cells(spark, sf_dir)
    v = R.ring_volumes(_diamonds(cells), cells, ROWS, "z_before", 1.0)
    return v.select("raster_id", "object_id", *[F.round(c, 6).alias(c) for c in ("volume", "mean_height", "max_height")])


def _qc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each raster's objects as a match (even rasters), or as a loss and a gain (odd ones)."""
    cells = _cells(spark, sf_dir)
    s = R.change_stats(_objects(cells), cells, ROWS, LOD).select("raster_id", "object_id", "v_neg", "v_pos")
    source, sink = s.where("object_id = 0"), s.where("object_id = 1")
    pairs = source.where("raster_id % 2 = 0").select("raster_id", "v_neg").join(sink.select("raster_id", "v_pos"), "raster_id")
    both = F.when((F.col("v_neg") > 0) & (F.col("v_pos") > 0), F.least("v_neg", "v_pos") / F.greatest("v_neg", "v_pos"))
    matched = pairs.select("raster_id", F.lit("matches").alias("layer"), R.match_label(F.col("v_neg"), F.col("v_pos"), F.lit(4.0), STATIONARY, LEAST).alias("label"), F.round(both, 6).alias("ratio"))
    none = F.lit(None).cast("double").alias("ratio")
    lost = source.where("raster_id % 2 = 1").select("raster_id", F.lit("disappeared").alias("layer"), R.loss_label(F.col("v_neg"), F.col("v_pos"), LEAST).alias("label"), none)
    new = sink.where("raster_id % 2 = 1").select("raster_id", F.lit("appeared").alias("layer"), R.gain_label(F.col("v_neg"), F.col("v_pos"), LEAST).alias("label"), none)
    return matched.union(lost).union(new)


def dod_qc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _qc(spark, sf_dir)


def qc_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _qc(spark, sf_dir).groupBy("layer", "label").agg(F.count(F.lit(1)).alias("n"))


def elevation_accept(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Objects by whether they rise from the ground: joined by id, never by position."""
    cells = _cells(spark, sf_dir)
    o = _objects(cells)
    v = R.ring_volumes(o, cells, ROWS, "z_before")
    return o.join(v, ["raster_id", "object_id"]).select("raster_id", "object_id", F.coalesce(F.col("max_height") > 0.3, F.lit(False)).cast("int").alias("accepted"))


def local_relief(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.local_relief(_cells(spark, sf_dir), "z_before", 1.0).select("raster_id", "r", "c", (F.round("relief", 6) + 0.0).alias("relief"))


def cubic_base_volume(spark: SparkSession, sf_dir: str) -> DataFrame:
    cells = _cells(spark, sf_dir)
    v = R.cubic_base_volumes(_objects(cells), cells, ROWS, "z_before")
    return v.select("raster_id", "object_id", *[F.round(c, 4).alias(c) for c in ("base_height", "rmse", "maxh", "meanh", "volume")])


def cross_section(spark: SparkSession, sf_dir: str) -> DataFrame:
    cells = _cells(spark, sf_dir)
    o = _objects(cells).select("raster_id", "object_id", ((F.col("x1") + F.col("x2")) / 2 + 0.5).alias("cx"), (ROWS - (F.col("y1") + F.col("y2")) / 2 + 0.5).alias("cy"), (F.col("raster_id") * 37 % 180).cast("double").alias("theta"))
    return R.sections(o, cells, "z_before").select("raster_id", "object_id", F.round("length", 6).alias("length"), F.round("area", 6).alias("area"))


#: Cells on a side of the chunks of the grids here, of which each has nine.
SIDE = 12


def _chunks(spark: SparkSession, sf_dir: str, value: str) -> DataFrame:
    (cells,) = load(spark, sf_dir, "dsm_cells")
    return grids.chunks(cells, value, SIDE)


def chunk_relief(spark: SparkSession, sf_dir: str) -> DataFrame:
    """local_relief on grids in chunks, which get their neighbours' borders."""
    made = grids.relief(_chunks(spark, sf_dir, "z_before"), 1.0, SIDE)
    return grids.cells_of(made, "relief").select("raster_id", "r", "c", (F.round("relief", 6) + 0.0).alias("relief"))


def chunk_median(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Elevations denoised by a median over three by three cells."""
    return grids.cells_of(grids.denoised(_chunks(spark, sf_dir, "z_after"), 3, SIDE)).select("raster_id", "r", "c", F.round("z", 6).alias("z"))


def window_read(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A window with a margin, cut off at the grid's edge, from stored chunks."""
    return grids.window(stored(_chunks(spark, sf_dir, "z_before")), (-3, 20, 9, 29), 2)


def grid_difference(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The grid after, shifted by a quarter cell down and half a cell left, less the grid before, in a window with a margin."""
    before, after = _chunks(spark, sf_dir, "z_before"), _chunks(spark, sf_dir, "z_after")
    rasters = before.select("raster_id").distinct()
    place = {"b_x0": 100.0, "b_y0": 50.0, "b_dx": 2.0, "b_dy": 2.0, "a_x0": 101.0, "a_y0": 49.5 + 1.0, "a_dx": 2.0, "a_dy": 2.0}
    windows = rasters.select("raster_id", F.lit(106.0).alias("x1"), F.lit(-20.0).alias("y1"), F.lit(150.0).alias("x2"), F.lit(46.0).alias("y2"))
    made = grids.difference(before, after, rasters.withColumns({n: F.lit(v) for n, v in place.items()}), windows, 4.0, SIDE)
    return grids.cells_of(made, "dz").select("raster_id", "r", "c", F.round("dz", 6).alias("dz"))


def _surveyed(cells: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Objects before and after, and matches with and without a distance: boxes on what was lost, on what was gained and on quiet ground."""
    lost, gained, quiet, aside = (2.0, 27.0, 5.0, 30.0), (6.0, 27.0, 9.0, 30.0), (18.0, 8.0, 21.0, 11.0), (25.0, 8.0, 28.0, 11.0)
    near = (2.25, 27.0, 5.25, 30.0)
    pairs = [(lost, gained), (lost, aside), (quiet, gained), (quiet, aside), (quiet, quiet), (lost, near)]
    alone = [(lost, None), (gained, None), (quiet, None), (None, gained), (None, lost), (None, quiet)]
    box = lambda b: F.struct(*[F.lit(v).alias(n) for n, v in zip(("x1", "y1", "x2", "y2"), b)]) if b else F.lit(None).cast("struct<x1:double,y1:double,x2:double,y2:double>")
    made = F.explode(F.array(*[F.struct(F.lit(k).cast("long").alias("k"), box(b).alias("b"), box(a).alias("a")) for k, (b, a) in enumerate(pairs + alone)]))
    rows = cells.select("raster_id").distinct().select("raster_id", made.alias("o")).select("raster_id", (12 * F.col("raster_id") + F.col("o.k")).alias("id"), "o.*")
    side = lambda s, key: rows.where(F.col(s).isNotNull()).select("raster_id", F.col("id").alias(key), f"{s}.*")
    # every second raster's matches have their distance, the others' follows from the boxes
    matched = rows.where(F.col("k") < len(pairs)).select(F.col("id").alias("before_id"), F.col("id").alias("after_id"), F.when(F.col("raster_id") % 2 == 0, F.hypot(F.col("a.x1") - F.col("b.x1"), F.col("a.y1") - F.col("b.y1"))).alias("distance"))
    return side("b", "before_id"), side("a", "after_id"), matched


def change_qc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every outcome of a match with what the difference of two grids says of it; the grid after begins a cell further east."""
    (cells,) = load(spark, sf_dir, "dsm_cells")
    before, after = grids.chunks(cells, "z_before", SIDE), grids.chunks(cells.withColumn("c", F.col("c") - 1).where("c >= 0"), "z_after", SIDE)
    place = {"b_x0": 0.0, "b_y0": 32.0, "b_dx": 1.0, "b_dy": 1.0, "a_x0": 1.0, "a_y0": 32.0, "a_dx": 1.0, "a_dy": 1.0}
    dz = grids.cells_of(grids.difference(before, after, cells.select("raster_id").distinct().withColumns({n: F.lit(v) for n, v in place.items()}), side=SIDE), "dz")
    labels = R.change_labels(*_surveyed(cells), dz.where("dz IS NOT NULL"), ROWS, LOD, LEAST, STATIONARY)
    return labels.select("layer", "before_id", "after_id", "label", *[F.round(c, 6).alias(c) for c in ("v_neg", "v_pos", "mean_before", "mean_after", "ratio")])


QUERIES = {f.__name__: f for f in (chunk_relief, chunk_median, window_read, grid_difference, change_qc, outline_change, outline_volume, percentile_stretch, raster_align, dod_stats, ring_volume, dod_qc, qc_summary, elevation_accept, local_relief, cubic_base_volume, cross_section)}

_T = ["dsm_cells"]
_OBJ = """o(object_id, x1, y1, x2, y2) AS (VALUES (CAST(0 AS BIGINT), 2, 27, 5, 30), (1, 6, 27, 9, 30)),
hit AS (SELECT raster_id, object_id, z_after - z_before AS dz FROM dsm_cells, o WHERE c <= x2 AND c + 1 >= x1 AND 32 - r - 1 <= y2 AND 32 - r >= y1),
st AS (SELECT raster_id, object_id, count(*) AS n, avg(dz) AS mean_dz, sum(CASE WHEN dz > 0.1 THEN dz ELSE 0 END) AS v_pos, sum(CASE WHEN dz < -0.1 THEN -dz ELSE 0 END) AS v_neg, sum(dz) AS v_sum,
  avg(CASE WHEN dz > 0.1 THEN 1 ELSE 0 END) AS share_pos, avg(CASE WHEN dz < -0.1 THEN 1 ELSE 0 END) AS share_neg FROM hit GROUP BY ALL)"""
_RING = """o(object_id, x1, y1, x2, y2) AS (VALUES (CAST(0 AS BIGINT), 2, 27, 5, 30), (1, 6, 27, 9, 30)),
k AS (SELECT raster_id, object_id, z_before AS z, sqrt(power(greatest(x1 - (c + 0.5), c + 0.5 - x2, 0), 2) + power(greatest(y1 - (31.5 - r), 31.5 - r - y2, 0), 2)) AS away FROM dsm_cells, o),
b AS (SELECT raster_id, object_id, median(z) AS base FROM k WHERE away > 0 AND away <= 0.5 GROUP BY ALL),
v AS (SELECT k.raster_id, k.object_id, sum(greatest(z - base, 0)) AS volume, coalesce(avg(z - base) FILTER (z > base), 0) AS mean_height, max(greatest(z - base, 0)) AS max_height FROM k JOIN b USING (raster_id, object_id) WHERE away = 0 GROUP BY ALL)"""
_DIAMOND = """d AS (SELECT raster_id, object_id, 3.5 + 4 * object_id + (raster_id % 3) / CAST(4 AS DOUBLE) AS cx, 28.25 - (raster_id % 5) / CAST(8 AS DOUBLE) AS cy, 2.125 + (raster_id % 4) / CAST(2 AS DOUBLE) AS s
  FROM (SELECT DISTINCT raster_id FROM dsm_cells), (VALUES (CAST(0 AS BIGINT)), (1)) v(object_id))"""
_DIAMOND_CHANGE = _DIAMOND + """,
hit AS (SELECT d.raster_id, object_id, z_after - z_before AS dz FROM d JOIN dsm_cells c ON c.raster_id = d.raster_id
  AND greatest(c - cx, cx - c - 1, 0) + greatest(31 - r - cy, cy - 32 + r, 0) <= s),
st AS (SELECT d.raster_id, d.object_id, count(dz) AS n, avg(dz) AS mean_dz, sum(CASE WHEN dz > 0.1 THEN dz ELSE 0 END) AS v_pos, sum(CASE WHEN dz < -0.1 THEN -dz ELSE 0 END) AS v_neg, sum(dz) AS v_sum,
  avg(CASE WHEN dz > 0.1 THEN 1 ELSE 0 END) AS share_pos, avg(CASE WHEN dz < -0.1 THEN 1 ELSE 0 END) AS share_neg FROM d JOIN hit USING (raster_id, object_id) GROUP BY ALL)
SELECT d.raster_id, d.object_id, coalesce(n, 0) AS n, round(mean_dz, 6) AS mean_dz, coalesce(round(v_pos, 6), 0) AS v_pos, coalesce(round(v_neg, 6), 0) AS v_neg, coalesce(round(v_sum, 6), 0) AS v_sum, coalesce(round(share_pos, 6), 0) AS share_pos, coalesce(round(share_neg, 6), 0) AS share_neg
FROM d LEFT JOIN st USING (raster_id, object_id)"""
_DIAMOND_VOLUME = _DIAMOND + """,
q AS (SELECT d.raster_id, object_id, z_before AS z, s, abs(c + 0.5 - cx) AS dx, abs(31.5 - r - cy) AS dy, greatest(0, least(1, ((dy - dx) / s + 1) / 2)) AS t FROM d JOIN dsm_cells c ON c.raster_id = d.raster_id),
b AS (SELECT raster_id, object_id, median(z) AS base FROM q WHERE dx + dy > s AND sqrt(power(dx - s * (1 - t), 2) + power(dy - s * t, 2)) <= 1 GROUP BY ALL),
v AS (SELECT q.raster_id, q.object_id, sum(greatest(z - base, 0)) AS volume, coalesce(avg(z - base) FILTER (z > base), 0) AS mean_height, max(greatest(z - base, 0)) AS max_height FROM q JOIN b USING (raster_id, object_id) WHERE dx + dy <= s GROUP BY ALL)
SELECT d.raster_id, d.object_id, round(volume, 6) AS volume, round(mean_height, 6) AS mean_height, round(max_height, 6) AS max_height FROM d LEFT JOIN v USING (raster_id, object_id)"""
_RELIEF = """w AS (SELECT k, exp(-0.5 * k * k) / sum(exp(-0.5 * k * k)) OVER () AS w FROM range(-4, 5) t(k)),
a AS (SELECT raster_id, r, t.k AS c, sum(w * z_before) AS s FROM dsm_cells, w, range(32) t(k) WHERE dsm_cells.c = CASE WHEN t.k + w.k < 0 THEN -1 - t.k - w.k WHEN t.k + w.k > 31 THEN 63 - t.k - w.k ELSE t.k + w.k END GROUP BY ALL),
b AS (SELECT raster_id, t.k AS r, c, sum(w * s) AS s FROM a, w, range(32) t(k) WHERE a.r = CASE WHEN t.k + w.k < 0 THEN -1 - t.k - w.k WHEN t.k + w.k > 31 THEN 63 - t.k - w.k ELSE t.k + w.k END GROUP BY ALL)
SELECT d.raster_id, d.r, d.c, round(z_before - s, 6) + 0.0 AS relief FROM dsm_cells d JOIN b ON b.raster_id = d.raster_id AND b.r = d.r AND b.c = d.c"""
_MEDIAN = """SELECT d.raster_id, d.r, d.c, round(median(n.z_after), 6) AS z FROM dsm_cells d, (VALUES (-1), (0), (1)) i(di), (VALUES (-1), (0), (1)) j(dj), dsm_cells n
WHERE n.raster_id = d.raster_id AND n.r = greatest(0, least(31, d.r + di)) AND n.c = greatest(0, least(31, d.c + dj)) GROUP BY ALL"""
_DIFFERENCE = """SELECT t.raster_id, t.r, t.c, round(0.75 * 0.5 * a.z_after + 0.75 * 0.5 * b.z_after + 0.25 * 0.5 * e.z_after + 0.25 * 0.5 * f.z_after - t.z_before, 6) AS dz FROM dsm_cells t
  LEFT JOIN dsm_cells a ON a.raster_id = t.raster_id AND a.r = t.r AND a.c = t.c - 1 LEFT JOIN dsm_cells b ON b.raster_id = t.raster_id AND b.r = t.r AND b.c = t.c
  LEFT JOIN dsm_cells e ON e.raster_id = t.raster_id AND e.r = t.r + 1 AND e.c = t.c - 1 LEFT JOIN dsm_cells f ON f.raster_id = t.raster_id AND f.r = t.r + 1 AND f.c = t.c
WHERE t.c >= 1 AND t.c < 27"""
_QC = """
x(k, b1, b2, b3, b4, a1, a2, a3, a4) AS (VALUES (0, 2::DOUBLE, 27::DOUBLE, 5::DOUBLE, 30::DOUBLE, 6::DOUBLE, 27::DOUBLE, 9::DOUBLE, 30::DOUBLE), (1, 2, 27, 5, 30, 25, 8, 28, 11), (2, 18, 8, 21, 11, 6, 27, 9, 30), (3, 18, 8, 21, 11, 25, 8, 28, 11), (4, 18, 8, 21, 11, 18, 8, 21, 11), (5, 2, 27, 5, 30, 2.25, 27, 5.25, 30),
  (6, 2, 27, 5, 30, NULL, NULL, NULL, NULL), (7, 6, 27, 9, 30, NULL, NULL, NULL, NULL), (8, 18, 8, 21, 11, NULL, NULL, NULL, NULL), (9, NULL, NULL, NULL, NULL, 6, 27, 9, 30), (10, NULL, NULL, NULL, NULL, 2, 27, 5, 30), (11, NULL, NULL, NULL, NULL, 18, 8, 21, 11)),
side AS (SELECT k, 'b' AS s, b1 AS x1, b2 AS y1, b3 AS x2, b4 AS y2 FROM x WHERE b1 IS NOT NULL UNION ALL SELECT k, 'a', a1, a2, a3, a4 FROM x WHERE a1 IS NOT NULL),
st AS (SELECT raster_id, k, s, avg(dz) AS mean, sum(CASE WHEN dz > 0.1 THEN dz ELSE 0 END) AS pos, sum(CASE WHEN dz < -0.1 THEN -dz ELSE 0 END) AS neg
  FROM (SELECT raster_id, r, c, z_after - z_before AS dz FROM dsm_cells WHERE c >= 1) d JOIN side ON c <= x2 AND c + 1 >= x1 AND 31 - r <= y2 AND 32 - r >= y1 GROUP BY ALL),
w AS (SELECT raster_id, x.*, 12 * raster_id + x.k AS id, b.mean AS mean_b, b.pos AS pos_b, b.neg AS neg_b, a.mean AS mean_a, a.pos AS pos_a, a.neg AS neg_a, sqrt(power(a1 - b1, 2) + power(a2 - b2, 2)) AS dist
  FROM (SELECT DISTINCT raster_id FROM dsm_cells) CROSS JOIN x LEFT JOIN (SELECT * FROM st WHERE s = 'b') b USING (raster_id, k) LEFT JOIN (SELECT * FROM st WHERE s = 'a') a USING (raster_id, k))
SELECT 'matches' AS layer, id AS before_id, id AS after_id, CASE WHEN dist <= 0.35 THEN CASE WHEN neg_b >= 0.5 OR pos_a >= 0.5 THEN 'stationary_dod_noise' ELSE 'stationary_ok' END
    WHEN neg_b >= 0.5 AND pos_a >= 0.5 THEN 'consistent_move' WHEN neg_b >= 0.5 THEN 'move_source_only' WHEN pos_a >= 0.5 THEN 'move_sink_only' ELSE 'move_weak_dod' END AS label,
  round(neg_b, 6) AS v_neg, round(pos_a, 6) AS v_pos, round(mean_b, 6) AS mean_before, round(mean_a, 6) AS mean_after, CASE WHEN neg_b > 0 AND pos_a > 0 THEN round(least(neg_b, pos_a) / greatest(neg_b, pos_a), 6) END AS ratio FROM w WHERE k < 6
UNION ALL SELECT 'disappeared', id, NULL, CASE WHEN neg_b >= 0.5 THEN 'likely_missed_mover_source' WHEN pos_b >= 0.5 THEN 'unexpected_deposition' ELSE 'weak_or_true_loss' END, round(neg_b, 6), round(pos_b, 6), round(mean_b, 6), NULL, NULL FROM w WHERE k BETWEEN 6 AND 8
UNION ALL SELECT 'appeared', NULL, id, CASE WHEN pos_a >= 0.5 THEN 'likely_missed_mover_sink' WHEN neg_a >= 0.5 THEN 'unexpected_depletion' ELSE 'weak_or_true_gain' END, round(neg_a, 6), round(pos_a, 6), NULL, round(mean_a, 6), NULL FROM w WHERE k > 8"""
#: The line of a profile: a step a column, or a row if it leaves through top and bottom.
_SECTION = """
o AS (SELECT raster_id, object_id, cx, cy, tan(radians(fmod(CAST(raster_id * 37 % 180 AS DOUBLE) - 90, 360))) AS slope FROM (SELECT DISTINCT raster_id FROM dsm_cells), (VALUES (CAST(0 AS BIGINT), 4.0::DOUBLE, 4.0::DOUBLE), (1, 8.0, 4.0)) v(object_id, cx, cy)),
l AS (SELECT *, cy - slope * cx AS lift FROM o),
m AS (SELECT *, (slope + lift < 1 AND 32 * slope + lift > 32) OR (32 * slope + lift < 1 AND slope + lift > 32) AS steep FROM l),
p AS (SELECT raster_id, object_id, k, CASE WHEN steep THEN (k - lift) / slope ELSE k END AS x, CASE WHEN steep THEN k ELSE k * slope + lift END AS y FROM m, range(1, 33) t(k)),
q AS (SELECT *, floor(x + 0.5) - 1 AS c, floor(y + 0.5) - 1 AS r FROM p WHERE floor(x + 0.5) BETWEEN 1 AND 32 AND floor(y + 0.5) BETWEEN 1 AND 32),
s AS (SELECT *, coalesce(sqrt(power(x - lag(x) OVER b, 2) + power(y - lag(y) OVER b, 2)), 0) AS step FROM q WINDOW b AS (PARTITION BY raster_id, object_id ORDER BY k)),
t AS (SELECT s.raster_id, s.object_id, coalesce(z_before, 0) AS z, step FROM s LEFT JOIN dsm_cells d ON d.raster_id = s.raster_id AND d.r = s.r AND d.c = s.c)
SELECT o.raster_id, o.object_id, round(coalesce(sum(CASE WHEN z <> 0 THEN step ELSE 0 END), 0), 6) AS length, round(coalesce(sum(z * step), 0), 6) AS area FROM o LEFT JOIN t USING (raster_id, object_id) GROUP BY ALL"""
_LABELS = _OBJ + """,
p AS (SELECT a.raster_id, a.v_neg AS neg, b.v_pos AS pos, a.v_pos AS pos0, b.v_neg AS neg1 FROM st a JOIN st b ON a.raster_id = b.raster_id AND a.object_id = 0 AND b.object_id = 1),
q AS (SELECT raster_id, 'matches' AS layer, CASE WHEN neg >= 0.5 AND pos >= 0.5 THEN 'consistent_move' WHEN neg >= 0.5 THEN 'move_source_only' WHEN pos >= 0.5 THEN 'move_sink_only' ELSE 'move_weak_dod' END AS label,
    CASE WHEN neg > 0 AND pos > 0 THEN round(least(neg, pos) / greatest(neg, pos), 6) END AS ratio FROM p WHERE raster_id % 2 = 0
  UNION ALL SELECT raster_id, 'disappeared', CASE WHEN neg >= 0.5 THEN 'likely_missed_mover_source' WHEN pos0 >= 0.5 THEN 'unexpected_deposition' ELSE 'weak_or_true_loss' END, NULL FROM p WHERE raster_id % 2 = 1
  UNION ALL SELECT raster_id, 'appeared', CASE WHEN pos >= 0.5 THEN 'likely_missed_mover_sink' WHEN neg1 >= 0.5 THEN 'unexpected_depletion' ELSE 'weak_or_true_gain' END, NULL FROM p WHERE raster_id % 2 = 1)"""

ORACLES = {
    "outline_change": with_tables(_T, _DIAMOND_CHANGE),
    "outline_volume": with_tables(_T, _DIAMOND_VOLUME),
    "percentile_stretch": with_tables(_T, """p AS (SELECT raster_id, quantile_cont(z_before, 0.02) AS lo, quantile_cont(z_before, 0.98) AS hi FROM dsm_cells GROUP BY raster_id)
SELECT d.raster_id, r, c, CAST(floor(greatest(0, least(1, (z_before - lo) / greatest(hi - lo, 1e-6))) * 255) AS INT) AS byte FROM dsm_cells d JOIN p ON p.raster_id = d.raster_id"""),
    "raster_align": with_tables(_T, """SELECT t.raster_id, t.r, t.c, round(0.75 * 0.5 * a.z_after + 0.75 * 0.5 * b.z_after + 0.25 * 0.5 * e.z_after + 0.25 * 0.5 * f.z_after, 6) AS z FROM dsm_cells t
  LEFT JOIN dsm_cells a ON a.raster_id = t.raster_id AND a.r = t.r AND a.c = t.c - 1 LEFT JOIN dsm_cells b ON b.raster_id = t.raster_id AND b.r = t.r AND b.c = t.c
  LEFT JOIN dsm_cells e ON e.raster_id = t.raster_id AND e.r = t.r + 1 AND e.c = t.c - 1 LEFT JOIN dsm_cells f ON f.raster_id = t.raster_id AND f.r = t.r + 1 AND f.c = t.c"""),
    "dod_stats": with_tables(_T, _OBJ + "\nSELECT raster_id, object_id, n, round(mean_dz, 6) AS mean_dz, round(v_pos, 6) AS v_pos, round(v_neg, 6) AS v_neg, round(v_sum, 6) AS v_sum, round(share_pos, 6) AS share_pos, round(share_neg, 6) AS share_neg FROM st"),
    "ring_volume": with_tables(_T, _RING + "\nSELECT raster_id, object_id, round(volume, 6) AS volume, round(mean_height, 6) AS mean_height, round(max_height, 6) AS max_height FROM v"),
    "dod_qc": with_tables(_T, _LABELS + "\nSELECT * FROM q"),
    "qc_summary": with_tables(_T, _LABELS + "\nSELECT layer, label, count(*) AS n FROM q GROUP BY ALL"),
    "elevation_accept": with_tables(_T, _RING + "\nSELECT raster_id, object_id, CASE WHEN max_height > 0.3 THEN 1 ELSE 0 END AS accepted FROM v"),
    "local_relief": with_tables(_T, _RELIEF),
    "chunk_relief": with_tables(_T, _RELIEF),
    "chunk_median": with_tables(_T, _MEDIAN),
    "window_read": with_tables(_T, "SELECT raster_id, r, c, z_before AS z FROM dsm_cells WHERE r < 11 AND c >= 18 AND c < 31"),
    "grid_difference": with_tables(_T, _DIFFERENCE),
    "change_qc": with_tables(_T, _QC),
    "cross_section": with_tables(_T, _SECTION),
}
