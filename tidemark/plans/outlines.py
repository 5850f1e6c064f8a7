"""Queries on outlines that are no boxes: unions, clips to tiles inside regions, repairs, rectangles, hits."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions import geometry as G
from tidemark.operators import dataset as D
from tidemark.operators import outlines as O
from tidemark.operators.matching import hits_by_outline
from tidemark.operators.selection import merge_under_leaders
from tidemark.plans.datasets import POLICY, SITE_WIDTH
from tidemark.plans.fixtures import load, with_tables
from tidemark.plans.selection import DIAMONDS, GREEDY, _LAYER, _NESTED, _diamonds


def outline_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Merged objects with the outline of all their members: its parts, area, length and box."""
    m = merge_under_leaders(_diamonds(spark, sf_dir), 8.0)
    length = F.aggregate("holes", G.ring_perimeter(F.col("outline")), lambda s, h: s + G.ring_perimeter(h))
    b = G.ring_box(F.col("outline"))
    return m.select("leader", F.col("parts").cast("long").alias("parts"), F.round("union_area", 6).alias("area"), F.round(length, 6).alias("length"), *[F.round(b[c], 6).alias(c) for c in ("x1", "y1", "x2", "y2")])


def _shapes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The objects as diamonds (even ids) and as boxes without a quarter (odd ids): a convex and a concave outline."""
    (before,) = load(spark, sf_dir, "survey_before")
    x, y, h = F.col("cx"), F.col("cy"), F.col("side")
    diamond = F.array(G.point(x + h, y), G.point(x, y + h), G.point(x - h, y), G.point(x, y - h))
    corner = F.array(G.point(x - h, y - h), G.point(x + h, y - h), G.point(x + h, y), G.point(x, y), G.point(x, y + h), G.point(x - h, y + h))
    year = F.when(F.col("before_id") % 3 > 0, (24 + F.col("before_id") % 2).cast("int"))
    cls = D.class_of(F.when(F.col("before_id") % 9 == 0, "Deposit").when(F.col("before_id") % 4 == 0, "boulder"))
    return before.select(F.col("before_id").alias("object_id"), year.alias("year"), cls.alias("class"), F.when(F.col("before_id") % 2 == 0, diamond).otherwise(corner).alias("ring"))


def _clipped(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Shapes by tiles, inside the region of each site: two overlapping boxes, as from two files."""
    (tiles,) = load(spark, sf_dir, "tiles")
    placed = tiles.withColumns({x: F.col(x) + F.col("site") * SITE_WIDTH for x in ("x1", "x2")})
    left = F.col("site") * SITE_WIDTH
    boxes = F.array(G.box_ring(left + 20.5, F.lit(16.25), left + 330.25, F.lit(400.5)), G.box_ring(left + 250.0, F.lit(200.75), left + 500.5, F.lit(505.25)))
    regions = tiles.select("site").distinct().select(F.explode(boxes).alias("ring"))
    return O.clip_to_tiles(_shapes(spark, sf_dir), placed, 64.0, regions)


#: Smallness of shapes, which are larger than the boxes of tile_clip.
SMALL = D.Policy(deposits=POLICY.deposits, small="crowd", min_area=2.0)


def tile_clip_rings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What each tile shows of each outline: its annotations' area, crowd by the area inside the region."""
    a = D.annotate(_clipped(spark, sf_dir), SMALL)
    return a.groupBy("object_id", "tile_id").agg(F.max("category_id").alias("category_id"), F.max("iscrowd").alias("iscrowd"), F.max("outcome").alias("outcome"), F.round(F.sum("area"), 6).alias("area")).where("area > 1e-5")


def ring_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rings of which most have a fault: what it is, and the simple parts and area that a repair leaves."""
    (before,) = load(spark, sf_dir, "survey_before")
    x, y, h, kind = F.col("cx"), F.col("cy"), F.col("side"), F.col("before_id") % 6
    at = lambda *steps: F.array(*[G.point(x + i * h, y + j * h) for i, j in steps])
    bow = at((-1, -1), (1, 1), (1, -1), (-1, 1))
    twice = at((0, 0), (4, 0), (4, 4), (1, 4), (1, 1), (3, 1), (3, 3), (0, 3))  # goes round its middle twice
    ring = F.when(kind == 0, at((-1, -1), (1, -1), (1, 1), (-1, 1), (-1, -1))).when(kind == 1, bow).when(kind == 2, at((0, 0), (1, 1), (0, 0))).when(kind == 3, twice).when(kind == 4, at((0, 0), (1, 1), (2, 2)))
    r = O.repaired(before.select("before_id", ring.alias("ring")), ["before_id"])
    return r.groupBy("before_id").agg(F.coalesce(F.max("problem"), F.lit("none")).alias("problem"), F.count("part").alias("parts"), F.round(F.coalesce(F.sum("area"), F.lit(0.0)), 6).alias("area"))


def axes_rectangle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Axes of turned rectangles with a notch: the notch changes the moments, not the rectangle."""
    (before,) = load(spark, sf_dir, "survey_before")
    a = F.radians(F.col("before_id") * 7 % 180)
    w, h = F.col("side") * (1 + F.col("before_id") % 3), F.col("side") * 2.5
    corner = lambda i, j: G.point(F.col("cx") + i * w * F.cos(a) - j * h * F.sin(a), F.col("cy") + i * w * F.sin(a) + j * h * F.cos(a))
    ring = F.array(*[corner(i, j) for i, j in ((-0.5, -0.5), (0.5, -0.5), (0.5, 0.5), (0.0, 0.1), (-0.5, 0.5))])
    r = O.rectangles(before.select("before_id", ring.alias("ring")), ["before_id"])
    return r.select("before_id", F.round("major", 6).alias("major"), F.round("minor", 6).alias("minor"), (F.round(F.pmod(F.round("orientation", 4), F.lit(180.0)), 4) + 0.0).alias("orientation"))


def outline_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Manual outlines that touch each object's outline: those of sufficient overlap, else all; the best by overlap."""
    before, manual = load(spark, sf_dir, "survey_before", "manual_ann")
    diamond = lambda x, y, h: F.array(G.point(x + h, y), G.point(x, y + h), G.point(x - h, y), G.point(x, y - h))
    x, y = (F.col("x1") + F.col("x2")) / 2, (F.col("y1") + F.col("y2")) / 2
    hits = hits_by_outline(before.select("before_id", diamond(F.col("cx"), F.col("cy"), F.col("side")).alias("ring")), manual.select("ann_fid", diamond(x, y, F.col("x2") - F.col("x1")).alias("ring")), "before_id", "ann_fid", 8.0)
    return hits.select("before_id", F.array_join(F.transform("fids", lambda f: f.cast("string")), ",").alias("fids"), "best_fid", F.round("best_iou", 4).alias("best_iou"))


QUERIES = {f.__name__: f for f in (outline_union, tile_clip_rings, ring_repair, axes_rectangle, outline_hits)}

#: Members in the coordinates u = x + y, v = x - y, where diamonds are boxes: the cells between all borders, covered or not.
_UNION = """,
w AS (SELECT leader, cx + cy - (x2 - x1) / 2 AS u1, cx + cy + (x2 - x1) / 2 AS u2, cx - cy - (x2 - x1) / 2 AS v1, cx - cy + (x2 - x1) / 2 AS v2, x1, y1, x2, y2 FROM led JOIN b USING (id)),
us AS (SELECT leader, u AS lo, lead(u) OVER (PARTITION BY leader ORDER BY u) AS hi, row_number() OVER (PARTITION BY leader ORDER BY u) AS k FROM (SELECT leader, u1 AS u FROM w UNION SELECT leader, u2 FROM w)),
vs AS (SELECT leader, v AS lo, lead(v) OVER (PARTITION BY leader ORDER BY v) AS hi, row_number() OVER (PARTITION BY leader ORDER BY v) AS k FROM (SELECT leader, v1 AS v FROM w UNION SELECT leader, v2 FROM w)),
cell AS (SELECT us.leader, us.k AS i, vs.k AS j, us.hi - us.lo AS du, vs.hi - vs.lo AS dv,
    CASE WHEN bool_or(w.u1 <= us.lo AND us.hi <= w.u2 AND w.v1 <= vs.lo AND vs.hi <= w.v2) THEN 1 ELSE 0 END AS has
  FROM us JOIN vs ON vs.leader = us.leader JOIN w ON w.leader = us.leader WHERE us.hi IS NOT NULL AND vs.hi IS NOT NULL GROUP BY ALL),
sums AS (SELECT leader, sum(has * du * dv) / 2 AS area, sum(CASE WHEN has = 1 THEN (CASE WHEN lu = 0 THEN dv ELSE 0 END) + (CASE WHEN ru = 0 THEN dv ELSE 0 END) + (CASE WHEN lv = 0 THEN du ELSE 0 END) + (CASE WHEN rv = 0 THEN du ELSE 0 END) ELSE 0 END) / sqrt(2) AS length
  FROM (SELECT *, coalesce(lag(has) OVER (PARTITION BY leader, j ORDER BY i), 0) AS lu, coalesce(lead(has) OVER (PARTITION BY leader, j ORDER BY i), 0) AS ru,
    coalesce(lag(has) OVER (PARTITION BY leader, i ORDER BY j), 0) AS lv, coalesce(lead(has) OVER (PARTITION BY leader, i ORDER BY j), 0) AS rv FROM cell) GROUP BY leader)
SELECT leader, CAST(1 AS BIGINT) AS parts, round(area, 6) AS area, round(length, 6) AS length, round(min(x1), 6) AS x1, round(min(y1), 6) AS y1, round(max(x2), 6) AS x2, round(max(y2), 6) AS y2 FROM sums JOIN w USING (leader) GROUP BY leader, area, length"""

#: The area of a shape in a box, exactly: a diamond's width in x is linear between the places where a border bends or
#: meets another; a box without a quarter is a box less a box. Regions count by inclusion and exclusion.
_SHAPES = """
s AS (SELECT before_id AS object_id, CASE WHEN before_id % 3 > 0 THEN 24 + before_id % 2 END AS year, CASE WHEN before_id % 9 = 0 THEN 1 ELSE 0 END AS class, cx, cy, side AS h, before_id % 2 = 0 AS diamond FROM survey_before),
r AS (SELECT DISTINCT site, k, sgn, site * 512 + p1 AS p1, q1, site * 512 + p2 AS p2, q2 FROM tiles, (VALUES (0, 1, 20.5::DOUBLE, 16.25::DOUBLE, 330.25::DOUBLE, 400.5::DOUBLE), (1, 1, 250, 200.75, 500.5, 505.25), (2, -1, 250, 200.75, 330.25, 400.5)) v(k, sgn, p1, q1, p2, q2)),
t AS (SELECT tile_id, year AS t_year, x1 + site * 512 AS x1, y1, x2 + site * 512 AS x2, y2 FROM tiles),
wins AS (SELECT s.*, CAST(NULL AS BIGINT) AS tile_id, site * 3 + k AS k, sgn, p1 AS a1, q1 AS b1, p2 AS a2, q2 AS b2 FROM s JOIN r ON cx + h > p1 AND cx - h < p2 AND cy + h > q1 AND cy - h < q2
  UNION ALL SELECT s.*, tile_id, site * 3 + k, sgn, greatest(p1, x1), greatest(q1, y1), least(p2, x2), least(q2, y2) FROM s
    JOIN t ON (s.year IS NULL OR s.year = t_year) AND cx + h > x1 AND cx - h < x2 AND cy + h > y1 AND cy - h < y2
    JOIN r ON greatest(p1, x1) < least(p2, x2) AND greatest(q1, y1) < least(q2, y2) AND cx + h > greatest(p1, x1) AND cx - h < least(p2, x2)),
d AS (SELECT object_id, tile_id, k, sgn, a1, b1, a2, b2, cx, cy, h, greatest(a1, cx - h) AS lo, least(a2, cx + h) AS hi FROM wins WHERE diamond),
cuts AS (SELECT DISTINCT * FROM (SELECT *, greatest(lo, least(hi, unnest([lo, hi, cx, cx + h - abs(b1 - cy), cx - h + abs(b1 - cy), cx + h - abs(b2 - cy), cx - h + abs(b2 - cy)]))) AS x FROM d WHERE lo < hi)),
f AS (SELECT *, greatest(0, least(b2, cy + h - abs(x - cx)) - greatest(b1, cy - h + abs(x - cx))) AS w FROM cuts),
areas AS (SELECT object_id, tile_id, sgn, k, sum((nx - x) * (w + nw) / 2) AS a FROM (SELECT *, lead(x) OVER p AS nx, lead(w) OVER p AS nw FROM f WINDOW p AS (PARTITION BY object_id, tile_id, k ORDER BY x)) WHERE nx IS NOT NULL GROUP BY object_id, tile_id, sgn, k
  UNION ALL SELECT object_id, tile_id, sgn, k, greatest(0, least(a2, cx + h) - greatest(a1, cx - h)) * greatest(0, least(b2, cy + h) - greatest(b1, cy - h)) - greatest(0, least(a2, cx + h) - greatest(a1, cx)) * greatest(0, least(b2, cy + h) - greatest(b1, cy)) FROM wins WHERE NOT diamond),
total AS (SELECT object_id, tile_id, sum(sgn * a) AS area FROM areas GROUP BY ALL)"""

ORACLES = {
    "outline_union": with_tables(["match_before", "match_after"], f"{_LAYER},{DIAMONDS},\n{_NESTED}," + """
conflicts AS (SELECT a, c FROM p WHERE i > 0.15 * least(aa, ca) AND least(aa, ca) >= 0.25 * greatest(aa, ca) AND a NOT IN (SELECT id FROM nested) AND c NOT IN (SELECT id FROM nested)),
ranked AS (SELECT id, g, row_number() OVER (PARTITION BY g ORDER BY area DESC, id) AS k FROM b WHERE id NOT IN (SELECT id FROM nested)),""" + GREEDY + _UNION),
    "tile_clip_rings": with_tables(["survey_before", "tiles"], _SHAPES + """
SELECT object_id, tile_id, 1 AS category_id, CASE WHEN class = 1 OR w.area < 2 THEN 1 ELSE 0 END AS iscrowd, CASE WHEN class = 1 THEN 'deposit' WHEN w.area < 2 THEN 'crowd' ELSE 'boulder' END AS outcome, round(c.area, 6) AS area
FROM total c JOIN s USING (object_id) JOIN (SELECT object_id, area FROM total WHERE tile_id IS NULL) w USING (object_id) WHERE c.tile_id IS NOT NULL AND round(c.area, 6) > 1e-5"""),
    "ring_repair": with_tables(["survey_before"], """
SELECT before_id, CASE before_id % 6 WHEN 0 THEN 'none' WHEN 1 THEN 'crossing' WHEN 2 THEN 'short' WHEN 3 THEN 'crossing' WHEN 4 THEN 'crossing' ELSE 'missing' END AS problem,
  CAST(CASE before_id % 6 WHEN 0 THEN 1 WHEN 1 THEN 2 WHEN 3 THEN 1 ELSE 0 END AS BIGINT) AS parts, round(side * side * CASE before_id % 6 WHEN 0 THEN 4 WHEN 1 THEN 2 WHEN 3 THEN 11 ELSE 0 END, 6) AS area FROM survey_before"""),
    "axes_rectangle": with_tables(["survey_before"], """
SELECT before_id, round(greatest(side * (1 + before_id % 3), side * 2.5), 6) AS major, round(least(side * (1 + before_id % 3), side * 2.5), 6) AS minor,
  CAST((before_id * 7 % 180 + CASE WHEN before_id % 3 < 2 THEN 90 ELSE 0 END) % 180 AS DOUBLE) AS orientation FROM survey_before"""),
    "outline_hits": with_tables(["survey_before", "manual_ann"], """o AS (SELECT before_id, cx + cy AS u, cx - cy AS v, side AS h FROM survey_before),
m AS (SELECT ann_fid AS fid, (x1 + x2) / 2 + (y1 + y2) / 2 AS u, (x1 + x2) / 2 - (y1 + y2) / 2 AS v, x2 - x1 AS h FROM manual_ann),
h AS (SELECT before_id, fid, i / (2 * o_h * o_h + 2 * m_h * m_h - i) AS iou FROM (SELECT before_id, fid, o.h AS o_h, m.h AS m_h, greatest(least(o.u + o.h, m.u + m.h) - greatest(o.u - o.h, m.u - m.h), 0) * greatest(least(o.v + o.h, m.v + m.h) - greatest(o.v - o.h, m.v - m.h), 0) / 2 AS i,
  abs(o.u - m.u) <= o.h + m.h AND abs(o.v - m.v) <= o.h + m.h AS meet FROM o JOIN m ON abs((o.u + o.v) - (m.u + m.v)) <= 2 * (o.h + m.h) AND abs((o.u - o.v) - (m.u - m.v)) <= 2 * (o.h + m.h)) WHERE meet),
g AS (SELECT before_id, string_agg(fid, ',' ORDER BY iou DESC, fid) FILTER (iou >= 0.05) AS good, string_agg(fid, ',' ORDER BY iou DESC, fid) AS every, max(iou) AS best, first(fid ORDER BY iou DESC, fid) AS f FROM h GROUP BY before_id)
SELECT o.before_id, coalesce(good, every, '') AS fids, CASE WHEN best > 0 THEN f END AS best_fid, round(coalesce(best, CAST(0 AS DOUBLE)), 4) AS best_iou FROM o LEFT JOIN g ON g.before_id = o.before_id"""),
}
