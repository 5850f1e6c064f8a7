import itertools
import math
import random

import numpy as np
import pandas as pd
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tidemark.functions import geometry as G
from tidemark.operators import assign, dataset, evaluation, graph, grids, matching, raster, selection, spatial

SURVEY = "id long, cx double, cy double, side double, volume double, orientation double"


def survey(spark, rows, key):
    df = spark.createDataFrame([(i, x, y, s, v, o) for i, (x, y, s, v, o) in enumerate(rows)], SURVEY)
    return df.withColumnRenamed("id", key).withColumn("area", F.col("side") * F.col("side"))


def matched(spark, before, after, **options):
    return matching.match(survey(spark, before, "before_id"), survey(spark, after, "after_id"), **options)


def value(spark, column):
    return spark.range(1).select(column.alias("v")).first()[0]


def test_scalar_terms(spark):
    lit = F.lit
    assert value(spark, G.log_ratio(lit(3.0), lit(3.0))) == 0
    assert value(spark, G.log_ratio(lit(2.0), lit(4.0))) == pytest.approx(value(spark, G.log_ratio(lit(4.0), lit(2.0))))
    assert value(spark, G.axial_difference(lit(10.0), lit(170.0))) == 20
    assert value(spark, G.axial_difference(lit(-350.0), lit(100.0))) == 90
    assert value(spark, G.finite(lit(float("nan")))) is None
    lonlat = value(spark, G.utm_to_lonlat(lit(500000.0), lit(0.0)))
    assert (lonlat.lon, lonlat.lat) == pytest.approx((-9.0, 0.0), abs=1e-9)
    # the meridian's arc from the equator to 45 degrees on this ellipsoid, scaled
    assert value(spark, G.utm_to_lonlat(lit(500000.0), lit(4984944.378 * 0.9996))).lat == pytest.approx(45.0, abs=1e-6)


def test_small_move_matches(spark):
    r = matched(spark, [(0.0, 0.0, 2.0, 1.0, None)], [(0.2, 0.1, 2.0, 1.0, None)])
    (m,) = r["matches"].collect()
    assert m.score > 0.8 and m.distance == pytest.approx(0.05**0.5)
    assert r["appeared"].count() == r["disappeared"].count() == 0


def test_far_objects_appear_and_vanish(spark):
    r = matched(spark, [(0.0, 0.0, 2.0, 1.0, None)], [(50.0, 0.0, 2.0, 1.0, None)])
    assert r["matches"].count() == 0 and r["appeared"].count() == 1 and r["disappeared"].count() == 1
    assert {o.outcome for o in matching.outcomes(r).collect()} == {"appeared", "disappeared"}


def test_min_score_and_neutral_volume(spark):
    r = matched(spark, [(0.0, 0.0, 1.0, None, None)], [(4.9, 0.0, 10.0, None, None)])
    assert r["matches"].count() == 0
    r = matched(spark, [(0.0, 0.0, 2.0, None, None)], [(0.0, 0.0, 2.0, None, None)])
    assert r["matches"].first().score == pytest.approx(0.3 + 0.25 + 0.175 + 0.05)


@pytest.mark.parametrize(
    "cand,pairs,total",
    [
        ([(1, 1, 0.9), (1, 2, 0.6), (2, 1, 0.6)], 2, 1.2),
        ([(0, 1, 0.55), (1, 1, 0.99), (1, 2, 0.55), (2, 2, 0.99), (2, 3, 0.55)], 3, 1.65),
        ([], 0, 0),
    ],
)
def test_most_pairs_come_before_score(spark, cand, pairs, total):
    got = assign.assign(spark.createDataFrame(cand, "a long, b long, score double")).collect()
    assert len(got) == pairs and sum(r.score for r in got) == pytest.approx(total)


@settings(max_examples=60, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 4), st.integers(0, 4), st.integers(55, 100)), max_size=10, unique_by=lambda t: t[:2]))
def test_one_component_against_all_matchings(edges):
    if not edges:
        return
    best = (0, 0)
    for k in range(len(edges) + 1):
        for pick in itertools.combinations(edges, k):
            if len({a for a, _, _ in pick}) == len({b for _, b, _ in pick}) == k:
                best = max(best, (k, sum(s for *_, s in pick)))
    got = assign.solve(pd.DataFrame([(a, b, s / 100) for a, b, s in edges], columns=["a", "b", "score"]))
    assert got["a"].is_unique and got["b"].is_unique
    assert (len(got), round(got["score"].sum() * 100)) == best


def test_components(spark):
    rng = random.Random(1)
    edges = [(rng.randrange(60), rng.randrange(60)) for _ in range(45)] + [(k, k + 1) for k in range(100, 140)]
    up = {x: x for e in edges for x in e}

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in edges:
        a, b = find(a), find(b)
        up[max(a, b)] = min(a, b)
    got = {r.node: r.root for r in graph.components(spark.createDataFrame(edges, "u long, v long")).collect()}
    tied = {x for a, b in edges if a != b for x in (a, b)}
    assert got == {x: find(x) for x in tied}


@pytest.mark.parametrize("parts", [1, 7])
def test_greedy_selection(spark, parts):
    rng = random.Random(2)
    rank = {i: rng.random() for i in range(50)}
    pairs = [(rng.randrange(50), rng.randrange(50)) for _ in range(80)]
    leader = {}
    for i in sorted(rank, key=lambda i: (rank[i], i)):
        first = [j for j in leader if leader[j] == j and ((i, j) in pairs or (j, i) in pairs)]
        leader[i] = min(first, key=lambda j: (rank[j], j)) if first else i
    nodes = spark.createDataFrame(list(rank.items()), "id long, k double").repartition(parts)
    got = graph.greedy_select(nodes, spark.createDataFrame(pairs, "a long, b long").repartition(parts), [F.col("k"), F.col("id")])
    assert {r.id: r.leader for r in got.collect()} == leader


def test_grid_joins_equal_nested_loops(spark):
    rng = random.Random(3)
    box = lambda: (x := rng.uniform(-20, 20), y := rng.uniform(-20, 20), x + rng.choice([0, 1, 7]), y + rng.choice([0, 2, 9]))
    a, b = [box() for _ in range(60)], [box() for _ in range(60)]
    left = spark.createDataFrame([(*r, k) for k, r in enumerate(a)], "lx1 double, ly1 double, lx2 double, ly2 double, l long")
    right = spark.createDataFrame([(*r, k) for k, r in enumerate(b)], "rx1 double, ry1 double, rx2 double, ry2 double, r long")
    for grow in (0.0, 1.5):
        got = sorted((r.l, r.r) for r in spatial.box_pairs(left, right, 4.0, grow=grow).collect())
        meet = lambda p, q: p[0] - grow <= q[2] and q[0] <= p[2] + grow and p[1] - grow <= q[3] and q[1] <= p[3] + grow  # noqa: B023, E731
        assert got == sorted((i, j) for i, p in enumerate(a) for j, q in enumerate(b) if meet(p, q))
    dots = [left.select("l", F.col("lx1").alias("lx"), F.col("ly1").alias("ly")), right.select("r", F.col("rx1").alias("rx"), F.col("ry1").alias("ry"))]
    got = sorted((r.l, r.r) for r in spatial.distance_pairs(*dots, 5.0).collect())
    assert got == sorted((i, j) for i, p in enumerate(a) for j, q in enumerate(b) if np.hypot(p[0] - q[0], p[1] - q[1]) <= 5)


def test_suppression(spark):
    rows = [(0, 0.0, 0.0, 2.0, 2.0, 0.6), (1, 0.1, 0.0, 2.1, 2.0, 0.95), (2, 50.0, 0.0, 52.0, 2.0, 0.4), (3, 90.0, 0.0, 90.1, 0.1, None), (4, 90.2, 0.0, 90.3, 0.1, 0.2)]
    df = spark.createDataFrame(rows, "id long, x1 double, y1 double, x2 double, y2 double, score double")
    got = {r.id: (r.leader, r.kept_from_n) for r in selection.suppress(df, 4.0, 0.4, 0.75).collect()}
    assert got == {0: (1, 2), 1: (1, 2), 2: (2, 1), 3: (4, 2), 4: (4, 2)}
    assert selection.suppress(df.limit(0), 4.0).count() == 0


def test_change_labels(spark):
    lab = lambda n, p, d: value(spark, raster.match_label(F.lit(n), F.lit(p), F.lit(d).cast("double"), 0.35, 0.1))
    assert lab(0.2, 0.2, 2.0) == "consistent_move"
    assert lab(0.2, 0.0, 2.0) == "move_source_only"
    assert lab(0.0, 0.2, 2.0) == "move_sink_only"
    assert lab(0.0, 0.0, 0.1) == "stationary_ok"
    assert lab(0.2, 0.0, None) == "stationary_dod_noise"
    assert value(spark, raster.loss_label(F.lit(0.2), F.lit(0.0), 0.1)) == "likely_missed_mover_source"
    assert value(spark, raster.gain_label(F.lit(0.0), F.lit(0.2), 0.1)) == "likely_missed_mover_sink"


def test_block_that_moves_east(spark):
    cells = []
    for r in range(10):
        for c in range(10):
            b = 6.5 if 2 <= r <= 4 and 2 <= c <= 4 else 5.0
            a = 6.5 if 2 <= r <= 4 and 6 <= c <= 8 else 5.0
            cells.append((0, r, c, a - b))
    df = spark.createDataFrame(cells, "raster_id long, r long, c long, dz double")
    boxes = spark.createDataFrame([(0, 0, 2.0, 5.0, 5.0, 8.0), (0, 1, 6.0, 5.0, 9.0, 8.0)], "raster_id long, object_id long, x1 double, y1 double, x2 double, y2 double")
    s = {x.object_id: x for x in raster.change_stats(boxes, df, 10, 0.1).collect()}
    assert s[0].v_neg > 0.5 and s[1].v_pos > 0.5


def test_raster_kernels(spark):
    x, y = np.meshgrid(np.arange(20.0), np.arange(20.0))
    z = 0.01 * x**3 - 0.02 * x * y + 3
    inside = (abs(x - 10) <= 1) & (abs(y - 10) <= 1)
    w = pd.DataFrame({"x": x.ravel(), "y": y.ravel(), "z": (z + inside).ravel(), "inside": inside.ravel(), "base": (~inside).ravel()})
    got = raster.cubic_base(w)
    assert got["volume"] == pytest.approx(9) and got["rmse"] < 1e-6 and got["maxh"] == pytest.approx(1)
    assert raster.cubic_base(w.head(5))["volume"] is None
    g = np.zeros((5, 5))
    g[2, 2], g[0, 0] = 9, np.nan
    assert (raster.median_filtered(g, 3) == 0).all()
    chunk = grids.chunks(spark.createDataFrame([(1, r, c, float(r * 10 + c)) for r in range(9) for c in range(7)], "raster_id long, r long, c long, z double"), "z", 4)
    back = sorted((r.r, r.c, r.z) for r in grids.cells_of(chunk).collect())
    assert back == [(r, c, float(r * 10 + c)) for r in range(9) for c in range(7)]
    assert len(grids.window(chunk, (2, 1, 4, 3), 1).collect()) == 16


def test_clipped_parts_of_a_comb(spark):
    comb = [(0, 0), (7, 0), (7, 5), (6, 5), (6, 1), (4, 1), (4, 5), (3, 5), (3, 1), (1, 1), (1, 5), (0, 5)]
    area = lambda r: abs(sum(p[0] * q[1] - q[0] * p[1] for p, q in zip(r, r[1:] + r[:1]))) / 2
    parts = dataset.clip_ring([(float(a), float(b)) for a, b in comb], (-1.0, 2.0, 8.0, 4.0))
    assert sorted(map(area, parts)) == [2, 2, 2]
    assert dataset.clip_ring([(float(a), float(b)) for a, b in comb], (1.5, 2.0, 2.5, 4.0)) == []
    (whole,) = dataset.clip_ring([(0.0, 0.0), (1.0, 0.0), (0.0, 1.0)], (-1.0, -1.0, 2.0, 2.0))
    assert area(whole) == 0.5
    objects = spark.createDataFrame([(1, [{"x": float(a), "y": float(b)} for a, b in comb])], f"object_id long, ring {G.RING}")
    tiles = spark.createDataFrame([(9, -1.0, 2.0, 8.0, 4.0)], "tile_id long, x1 double, y1 double, x2 double, y2 double")
    assert sorted(r.area for r in dataset.clip_rings(objects, tiles).collect()) == [2, 2, 2]


def test_class_words(spark):
    rows = [None, "", " Boulders ", "0", "1", "1.7", "2", "Deposit A", "x1", "other"]
    df = spark.createDataFrame([(r,) for r in rows], "raw string")
    assert [r[0] for r in df.select(dataset.class_of(F.col("raw"))).collect()] == [0, 0, 0, 0, 1, 1, 0, 1, 0, 0]


def test_empty_images_are_scored(spark):
    images = spark.createDataFrame([(1,), (2,)], "image_id long")
    dets = spark.createDataFrame([(5, 1, 0.0, 0.0, 1.0, 1.0, 0.9)], "det_id long, image_id long, x1 double, y1 double, x2 double, y2 double, score double")
    truth = spark.createDataFrame([], "gt_id long, image_id long, iscrowd int, x1 double, y1 double, x2 double, y2 double")
    got = {r.image_id: (r.tp, r.fp, r.fn, r.f1) for r in evaluation.precision_recall(images, dets, truth).collect()}
    assert got == {1: (0, 1, 0, 0.0), 2: (0, 0, 0, 1.0)}


def test_turns_move_corners_as_the_picture_turns(spark):
    """A picture 10 wide and 6 high; its point (2, 1) is near the upper left corner. Worked out by hand."""
    want = {"orig": (2, 1), "hflip": (8, 1), "vflip": (2, 5), "rot90": (5, 2), "rot180": (8, 5), "rot270": (1, 8), "transpose": (1, 2), "antitranspose": (5, 8)}
    anns = spark.sql("select 1L as image_id, 1L as ann_id, array(named_struct('x', 2D, 'y', 1D), named_struct('x', 3D, 'y', 1D), named_struct('x', 2D, 'y', 2D)) as ring")
    images = spark.sql("select 1L as image_id, '24_07_38.png' as file_name, 10D as width, 6D as height")
    got = {r.variant: r for r in dataset.variants(anns, images).collect()}
    assert {v: (r.ring[0].x, r.ring[0].y) for v, r in got.items()} == want
    assert {v: (r.new_width, r.new_height) for v, r in got.items()} == {v: (6, 10) if v in ("rot90", "rot270", "transpose", "antitranspose") else (10, 6) for v in want}
    assert got["hflip"].file_name == "24_07_38_hflip.png"


def test_cells_of_a_concave_outline(spark):
    ring = [(1.0, 1.0), (7.0, 1.0), (7.0, 7.0), (4.0, 2.5), (1.0, 7.0)]
    cells = spark.range(100).selectExpr("0L as raster_id", "id div 10 as r", "id % 10 as c", "0D as dz")
    objects = spark.createDataFrame([(0, 1, [{"x": x, "y": y} for x, y in ring])], "raster_id long, object_id long, ring array<struct<x:double,y:double>>")

    def inside(x, y):
        n = False
        for (ax, ay), (bx, by) in zip(ring, ring[1:] + ring[:1]):
            if (ay > y) != (by > y) and x < ax + (y - ay) * (bx - ax) / (by - ay):
                n = not n
        return n

    def away(x, y):
        out = 1e9
        for (ax, ay), (bx, by) in zip(ring, ring[1:] + ring[:1]):
            t = max(0, min(1, ((x - ax) * (bx - ax) + (y - ay) * (by - ay)) / ((bx - ax) ** 2 + (by - ay) ** 2)))
            out = min(out, math.hypot(x - ax - t * (bx - ax), y - ay - t * (by - ay)))
        return out

    centre = {(r, c) for r in range(10) for c in range(10) if inside(c + 0.5, 9.5 - r)}
    around = {(r, c) for r in range(10) for c in range(10) if (r, c) not in centre and away(c + 0.5, 9.5 - r) <= 1}
    fine = [k / 64 for k in range(65)]
    touched = {(r, c) for r in range(10) for c in range(10) if any(inside(c + u, 9 - r + v) or away(c + u, 9 - r + v) < 1e-9 for u in fine for v in fine)}
    of = lambda rule, grow=0.0: {(r.r, r.c) for r in raster.zonal(objects, cells, 10, rule, grow).collect()}
    assert of("centre") == centre and of("ring", 1.0) == around and of("touched") == touched


def test_ids_in_order_over_ranges(spark):
    rows = [(k % 3 if k % 7 else None, (k * 37) % 100 if k % 11 else None, k) for k in range(300)]
    df = spark.createDataFrame(rows, "g int, v int, part int").repartition(5)
    got = dataset.numbered(df, ["g"], ["v", "part"], "n").collect()
    assert len(got) == len(rows)
    key = lambda r: (r.v is not None, r.v or 0, r.part)
    for g in (None, 0, 1, 2):
        mine = sorted((r for r in got if r.g == g), key=key)
        assert [r.n for r in mine] == list(range(1, len(mine) + 1))
    assert dataset.numbered(df.limit(0), ["g"], ["v"], "n").count() == 0
    assert sorted(r.i for r in matching.with_ids(df, "part", "i").collect()) == list(range(300))


@pytest.mark.parametrize("smooth", [0, 3])
def test_cubic_volumes_against_a_plain_version(spark, smooth):
    rng = random.Random(4)
    z = {(r, c): 5 + 0.02 * r - 0.01 * c + rng.random() / 50 + (1.5 if 10 <= r < 14 and 8 <= c < 12 else 0) + (1 if 10 <= r < 13 and 17 <= c < 20 else 0) for r in range(24) for c in range(24)}
    cells = spark.createDataFrame([(0, r, c, v) for (r, c), v in z.items()], "raster_id long, r long, c long, z double")
    boxes = {1: (8.0, 10.0, 12.0, 14.0), 2: (17.0, 11.0, 20.0, 14.0)}
    objects = spark.createDataFrame([(0, k, *b, 4.0, 3.0) for k, b in boxes.items()], "raster_id long, object_id long, x1 double, y1 double, x2 double, y2 double, major double, minor double")
    away = lambda b, x, y: math.hypot(max(b[0] - x, x - b[2], 0), max(b[1] - y, y - b[3], 0))
    for got in raster.cubic_base_volumes(objects, cells, 24, "z", smooth=smooth).collect():
        box = boxes[got.object_id]
        window = {(r, c): v for (r, c), v in z.items() if away(box, c + 0.5, 23.5 - r) <= 6}
        if smooth:
            top, left = min(r for r, _ in window), min(c for _, c in window)
            bottom, right = max(r for r, _ in window), max(c for _, c in window)
            flip = lambda v, lo, hi: lo + (lo - v) - 1 if v < lo else hi - (v - hi) + 1 if v > hi else v
            around = lambda g, r, c: [g.get((flip(r + i, top, bottom), flip(c + j, left, right))) for i in (-1, 0, 1) for j in (-1, 0, 1)]
            whole = {(r, c): window[r, c] if (r, c) in window else (float(np.median(n)) if (n := [v for v in around(window, r, c) if v is not None]) else math.nan) for r in range(top, bottom + 1) for c in range(left, right + 1)}
            window = {k: float(np.median(around(whole, *k))) for k in window}
        base = [k for k in window if all(any((b[0] - 1 > k[1] + 0.5, k[1] + 0.5 > b[2] + 1, b[1] - 1 > 23.5 - k[0], 23.5 - k[0] > b[3] + 1)) for b in boxes.values())]
        inside = [k for k in window if away(box, k[1] + 0.5, 23.5 - k[0]) == 0]
        terms = lambda k: [((k[1] - 12) / 6) ** i * ((k[0] - 12) / 6) ** j for i in range(4) for j in range(4 - i)]
        a, zs = np.array([terms(k) for k in base]), np.array([window[k] for k in base])
        coef = np.linalg.solve(a.T @ a, a.T @ zs)
        heights = [max(0.0, window[k] - float(np.dot(terms(k), coef))) for k in inside]
        rmse = math.sqrt(float(((zs - a @ coef) ** 2).sum()) / (len(base) - 10))
        want = (rmse, max(heights), float(np.median([h for h in heights if h > 0])), sum(heights), 12 * max(heights))
        assert np.allclose((got.rmse, got.maxh, got.meanh, got.volume, got.abc), want, atol=1e-6), (got, want)
        assert got.is_boulder == 1 and abs(got.ellipsoid - math.pi / 6 * got.abc) < 1e-9
