import random

import pytest
from pyspark.sql import functions as F

from tidemark.functions import sql
from tidemark.functions.geometry import RING
from tidemark.operators import lookups, overlap

SQUARE = [(0.0, 0.0), (2.0, 0.0), (2.0, 2.0), (0.0, 2.0)]
L_SHAPE = [(0.0, 0.0), (3.0, 0.0), (3.0, 1.0), (1.0, 1.0), (1.0, 3.0), (0.0, 3.0)]
COMB = [(0.0, 0.0), (7.0, 0.0), (7.0, 5.0), (6.0, 5.0), (6.0, 1.0), (4.0, 1.0), (4.0, 5.0), (3.0, 5.0), (3.0, 1.0), (1.0, 1.0), (1.0, 5.0), (0.0, 5.0)]
TRIANGLE = [(0.0, 0.0), (4.0, 0.0), (0.0, 4.0)]


def moved(ring, dx, dy):
    return [(x + dx, y + dy) for x, y in ring]


@pytest.mark.parametrize(
    "a,b,shared",
    [
        (SQUARE, SQUARE, 4), (SQUARE, moved(SQUARE, 1, 1), 1), (SQUARE, moved(SQUARE, 2, 0), 0), (SQUARE, moved(SQUARE, 9, 9), 0),
        (L_SHAPE, SQUARE, 3), (COMB, [(-1.0, 2.0), (8.0, 2.0), (8.0, 4.0), (-1.0, 4.0)], 6), (TRIANGLE, SQUARE, 4), (TRIANGLE, moved(SQUARE, 1, 1), 2), (TRIANGLE[::-1], SQUARE, 4),
    ],
)
def test_known_areas(a, b, shared):
    assert overlap.covered_area([a, b], 2) == pytest.approx(shared)
    area = lambda r: abs(sum(p[0] * q[1] - q[0] * p[1] for p, q in zip(r, r[1:] + r[:1]))) / 2
    assert overlap.covered_area([a, b]) == pytest.approx(area(a) + area(b) - shared)


def test_areas_against_counting_cells():
    rng = random.Random(4)
    for _ in range(20):
        boxes = [(rng.randint(0, 8), rng.randint(0, 8), rng.randint(1, 5), rng.randint(1, 5)) for _ in range(4)]
        rings = [[(float(x), float(y)), (float(x + w), float(y)), (float(x + w), float(y + h)), (float(x), float(y + h))] for x, y, w, h in boxes]
        count = [sum(x <= i < x + w and y <= j < y + h for x, y, w, h in boxes) for i in range(14) for j in range(14)]
        for k in (1, 2, 3):
            assert overlap.covered_area(rings, k) == pytest.approx(sum(c >= k for c in count))


def test_overlap_tables(spark):
    points = lambda r: [{"x": x, "y": y} for x, y in r]
    left = spark.createDataFrame([(1, points(L_SHAPE)), (2, points(moved(L_SHAPE, 50, 0)))], f"l_id long, ring {RING}")
    right = spark.createDataFrame([(7, points(SQUARE)), (8, points(moved(SQUARE, 3, 0)))], f"r_id long, ring {RING}")
    (r,) = overlap.ring_overlaps(left, right, 4.0).collect()
    assert (r.l_id, r.r_id, r.overlap, r.over_smaller) == (1, 7, pytest.approx(3), pytest.approx(0.75)) and r.iou == pytest.approx(3 / 6)
    both = left.select(F.lit(5).alias("g"), "ring").union(right.select(F.lit(5), "ring"))
    assert overlap.union_areas(both, ["g"]).first().union_area == pytest.approx(5 + 5 + 4 + 4 - 3)


def test_lookups(spark):
    anns = spark.createDataFrame([(1, 1), (2, 2)], "id long, category_id long")
    cats = spark.createDataFrame([(1, "boulder"), (2, "deposit")], "id long, name string")
    assert [r.id for r in lookups.without_categories(anns, cats, ["deposit"]).collect()] == [1]
    tiles = spark.createDataFrame([(5, 1, 0.0, 0.0, 9.0, 9.0), (6, 0, 20.0, 0.0, 29.0, 9.0), (7, 2, 5.0, 5.0, 9.0, 9.0)], "tile_id long, place int, x1 double, y1 double, x2 double, y2 double")
    points = spark.createDataFrame([(1, 6.0, 6.0), (2, 99.0, 99.0)], "point_id long, px double, py double")
    assert {r.point_id: r.tile_id for r in lookups.first_containing(points, tiles).collect()} == {1: 5, 2: 6}
    assert tuple(lookups.union_bounds(tiles, tiles.limit(0)).first()) == (0.0, 0.0, 29.0, 9.0)
    assert {tuple(r) for r in lookups.run_summary({"raw": tiles, "kept": tiles.limit(0)}).collect()} == {("raw", 3), ("kept", 0)}
    texts = spark.range(1).select(lookups.pair_key(F.lit(3), F.lit(7)), lookups.extent_text(*[F.lit(float(v)) for v in (10, 10, 20, 20)])).first()
    assert tuple(texts) == ("b3_a7", "5.000,5.000,25.000,25.000")
    bands = spark.createDataFrame([(1, "r", [1.0]), (1, "g", [2.0])], "k long, band string, vals array<double>")
    assert tuple(lookups.stacked(bands, ["r", "g"], ["k"]).first()) == (1, [1.0], [2.0])
    with pytest.raises(Exception, match="a band is missing"):
        lookups.stacked(bands, ["r", "dsm"], ["k"]).collect()
    assert lookups.next_item(spark.createDataFrame([(1,), (4,)], "pos long"), 5, 6).first().pos == 1
    assert lookups.latest(anns, ["category_id"], [F.desc("id")]).count() == 2


def test_sql_functions(spark):
    sql.register(spark)
    row = spark.sql("SELECT box_iou(0D, 0D, 2D, 2D, 1D, 1D, 3D, 3D), axial_diff(10D, 170D), poly_area(array(0D, 0D, 2D, 0D, 2D, 2D)), poly_area(array(0D, 0D)), pair_score(0D, 5D, 4D, 4D, NULL, 1D, 0D, 0D)").first()
    assert tuple(row) == pytest.approx((1 / 7, 20, 2, 0, 0.3 + 0.25 + 0.175 + 0.1))
    assert spark.sql("SELECT * FROM dihedral_variants()").count() == 8
    assert [r.start for r in spark.sql("SELECT * FROM window_starts(1000, 512, 384)").collect()] == [0, 384, 488]
