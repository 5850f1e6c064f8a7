"""Queries that design and check hold-outs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.operators import splits as S
from tidemark.plans.fixtures import load, with_tables
from tidemark.sources import manifest

SITE = ["site"]


def _segmented(spark: SparkSession, sf_dir: str) -> DataFrame:
    (t,) = load(spark, sf_dir, "tiles")
    return S.segments(S.axis_scores(t, SITE), SITE)


def pca_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _segmented(spark, sf_dir).select("site", "tile_id", F.round("score", 3).alias("score"), "segment")


VALID, TEST = [2, 8], [5, 11]


def block_setup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.block_setup(_segmented(spark, sf_dir), SITE, VALID, TEST).select("site", "tile_id", "segment", "split")


def ends_setup(spark: SparkSession, sf_dir: str) -> DataFrame:
    (t,) = load(spark, sf_dir, "tiles")
    return S.ends_setup(S.axis_scores(t, SITE), SITE).select("site", "tile_id", "split")


def _dealt(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A careless split by tile number, for the checks."""
    (t,) = load(spark, sf_dir, "tiles")
    k = F.col("tile_id") % 11
    return t.withColumn("split", F.when(k == 0, "valid").when(k.isin(1, 2), "test").when(k == 3, "excluded").otherwise("train"))


def buffer_tiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.buffer_tiles(_dealt(spark, sf_dir), SITE)


def leakage_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.leakage(_dealt(spark, sf_dir), SITE)


def cross_year_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    (t,) = load(spark, sf_dir, "tiles")
    return S.cross_year_pairs(t, SITE, 24, 25)


def tile_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each site's manifest, written out as text and parsed again."""
    (t,) = load(spark, sf_dir, "tiles")
    kept = t.where("(tile_row + tile_col + site) % 3 > 0")
    rows = kept.groupBy("site", "year", "tile_row").agg(F.sort_array(F.collect_list("tile_col")).alias("cols"))
    line = F.concat(F.col("tile_row"), F.lit(": "), F.array_join(F.transform("cols", lambda c: c.cast("string")), ", "))
    body = rows.select(F.col("site").alias("file"), (F.col("year") * 100 + F.col("tile_row") + 1).alias("line_no"), line.alias("text"))
    heads = rows.select(F.col("site").alias("file"), (F.col("year") * 100).alias("line_no"), F.concat(F.lit("Tiles used in 20"), F.col("year")).alias("text")).distinct()
    return manifest.parse_manifest(heads.union(body))


def window_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    (b,) = load(spark, sf_dir, "survey_before")
    images = b.select(F.col("before_id").alias("image_id"), (500 + F.col("before_id") % 1300).alias("width"), (300 + F.col("before_id") % 700).alias("height"))
    return manifest.window_grid(images, 512, 0.75)


def split_membership(spark: SparkSession, sf_dir: str) -> DataFrame:
    (t,) = load(spark, sf_dir, "tiles")
    a = t.where("tile_id % 7 = 0").select("tile_id", F.lit("valid").alias("split"))
    b = t.where("tile_id % 5 = 1 and tile_id % 7 <> 0").select("tile_id", F.lit("test").alias("split"))
    c = t.where("tile_id % 3 = 0").select("tile_id", F.lit("excluded").alias("split"))
    return S.membership(t, a.union(b).union(c), ["tile_id"]).groupBy("site", "year", "split").agg(F.count(F.lit(1)).alias("n"))


QUERIES = {f.__name__: f for f in (pca_segments, block_setup, ends_setup, buffer_tiles, leakage_pairs, cross_year_pairs, tile_manifest, window_grid, split_membership)}

_SCORED = """
c AS (SELECT *, (x1 + x2) / 2 AS cx, (y1 + y2) / 2 AS cy FROM tiles),
m AS (SELECT site, avg(cx) AS mx, avg(cy) AS my, coalesce(var_samp(cx), 0) AS vx, coalesce(var_samp(cy), 0) AS vy, coalesce(covar_samp(cx, cy), 0) AS vxy FROM c GROUP BY site),
a AS (SELECT *, cos(atan2(2 * vxy, vx - vy) / 2) AS ax, sin(atan2(2 * vxy, vx - vy) / 2) AS ay FROM m),
scored AS (SELECT c.*, round(CASE WHEN ax > 1e-12 OR (abs(ax) <= 1e-12 AND ay < 0) THEN -1 ELSE 1 END * ((cx - mx) * ax + (cy - my) * ay), 6) AS score FROM c JOIN a ON a.site = c.site),
seg AS (SELECT *, CAST(least(11, (row_number() OVER (PARTITION BY site ORDER BY score, tile_id) - 1) * 12 // count(*) OVER (PARTITION BY site)) AS INT) AS segment,
  row_number() OVER (PARTITION BY site ORDER BY score, tile_id) AS i, count(*) OVER (PARTITION BY site) AS n FROM scored)"""
_BUFFER = """,
near AS (SELECT DISTINCT f.tile_id FROM s f JOIN s h ON h.site = f.site AND f.split = 'train' AND h.split IN ('valid', 'test')
  AND greatest(least(f.x2 + 2, h.x2) - greatest(f.x1 - 2, h.x1), 0) * greatest(least(f.y2 + 2, h.y2) - greatest(f.y1 - 2, h.y1), 0) >= 0.01)"""
_DEALT = "s AS (SELECT *, CASE WHEN tile_id % 11 = 0 THEN 'valid' WHEN tile_id % 11 IN (1, 2) THEN 'test' WHEN tile_id % 11 = 3 THEN 'excluded' ELSE 'train' END AS split FROM tiles)"

ORACLES = {
    "pca_segments": with_tables(["tiles"], _SCORED + "\nSELECT site, tile_id, round(score, 3) AS score, segment FROM seg"),
    "block_setup": with_tables(["tiles"], _SCORED + ",\ns AS (SELECT *, CASE WHEN segment IN (2, 8) THEN 'valid' WHEN segment IN (5, 11) THEN 'test' ELSE 'train' END AS split FROM seg)" + _BUFFER + """
SELECT site, s.tile_id, segment, CASE WHEN near.tile_id IS NOT NULL THEN 'excluded' ELSE split END AS split FROM s LEFT JOIN near ON near.tile_id = s.tile_id"""),
    "ends_setup": with_tables(["tiles"], _SCORED + """,
s AS (SELECT *, CASE WHEN i <= greatest(1, round_even(n * 0.15, 0)) THEN 'valid' WHEN i > n - greatest(1, round_even(n * 0.25, 0)) THEN 'test' ELSE 'train' END AS split FROM seg)""" + _BUFFER + """
SELECT site, s.tile_id, CASE WHEN near.tile_id IS NOT NULL THEN 'excluded' ELSE split END AS split FROM s LEFT JOIN near ON near.tile_id = s.tile_id"""),
    "buffer_tiles": with_tables(["tiles"], _DEALT + _BUFFER + "\nSELECT tile_id FROM near"),
    "leakage_pairs": with_tables(["tiles"], _DEALT + """,
p AS (SELECT a.tile_id AS tile_a, b.tile_id AS tile_b, a.split AS split_a, b.split AS split_b, greatest(least(a.x2, b.x2) - greatest(a.x1, b.x1), 0) * greatest(least(a.y2, b.y2) - greatest(a.y1, b.y1), 0) AS area
  FROM s a JOIN s b ON a.site = b.site AND a.tile_id < b.tile_id AND a.split <> b.split AND a.split <> 'excluded' AND b.split <> 'excluded')
SELECT * FROM p WHERE area >= 1"""),
    "cross_year_pairs": with_tables(["tiles"], """
e AS (SELECT *, row_number() OVER (PARTITION BY site ORDER BY area DESC, tile_a, tile_b) AS k FROM (SELECT a.site, a.tile_id AS tile_a, b.tile_id AS tile_b,
  greatest(least(a.x2, b.x2) - greatest(a.x1, b.x1), 0) * greatest(least(a.y2, b.y2) - greatest(a.y1, b.y1), 0) AS area FROM tiles a JOIN tiles b ON a.site = b.site AND a.year = 24 AND b.year = 25) WHERE area >= 1),
walk(site, k, used, picks) AS (SELECT DISTINCT site, CAST(0 AS BIGINT), CAST([] AS BIGINT[]), CAST([] AS BIGINT[]) FROM e
  UNION ALL SELECT w.site, w.k + 1, CASE WHEN list_has_any(used, [tile_a, tile_b]) THEN used ELSE list_concat(used, [tile_a, tile_b]) END, CASE WHEN list_has_any(used, [tile_a, tile_b]) THEN picks ELSE list_append(picks, e.k) END
  FROM walk w JOIN e ON e.site = w.site AND e.k = w.k + 1),
last AS (SELECT site, arg_max(picks, k) AS picks FROM walk GROUP BY site)
SELECT tile_a, tile_b, area FROM e JOIN last ON last.site = e.site AND list_contains(picks, e.k)"""),
    "tile_manifest": with_tables(["tiles"], "SELECT site AS file, year, CAST(tile_row AS INT) AS tile_row, CAST(tile_col AS INT) AS tile_col FROM tiles WHERE (tile_row + tile_col + site) % 3 > 0"),
    "window_grid": with_tables(["survey_before"], """
i AS (SELECT before_id AS image_id, 500 + before_id % 1300 AS w, 300 + before_id % 700 AS h FROM survey_before),
c AS (SELECT DISTINCT image_id, w, c0 FROM (SELECT image_id, w, k * 384 AS c0 FROM i, range(4) x(k) WHERE k = 0 OR k * 384 <= w - 512 UNION ALL SELECT image_id, w, greatest(w - 512, 0) FROM i)),
r AS (SELECT DISTINCT image_id, h, r0 FROM (SELECT image_id, h, k * 384 AS r0 FROM i, range(4) x(k) WHERE k = 0 OR k * 384 <= h - 512 UNION ALL SELECT image_id, h, greatest(h - 512, 0) FROM i))
SELECT c.image_id, r0, least(r0 + 512, h) AS r1, c0, least(c0 + 512, w) AS c1 FROM c JOIN r ON c.image_id = r.image_id"""),
    "split_membership": with_tables(["tiles"], """
s AS (SELECT *, CASE WHEN tile_id % 3 = 0 THEN 'excluded' WHEN tile_id % 7 = 0 THEN 'valid' WHEN tile_id % 5 = 1 THEN 'test' ELSE 'train' END AS split FROM tiles)
SELECT site, year, split, count(*) AS n FROM s GROUP BY ALL"""),
}
