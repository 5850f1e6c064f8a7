"""Overlays of outlines against areas by slabs, and greedy selection against a plain walk."""

import math
import random
import time

import pytest
from pyspark.sql import functions as F

from tidemark.functions import overlay as V
from tidemark.operators import graph, outlines
from tidemark.operators.graph import components, greedy_select
from tidemark.operators.matching import hits_by_outline
from tidemark.operators.overlap import covered_area, even_odd_area, ring_overlaps

RING = "array<struct<x:double,y:double>>"


def random_rings(rng, kind):
    if kind == "crossing":
        return [[(float(rng.randint(0, 6)), float(rng.randint(0, 6))) for _ in range(rng.randint(3, 7))] for _ in range(rng.randint(1, 4))]
    if kind == "boxes":
        made = [(rng.randint(0, 5), rng.randint(0, 5), rng.randint(1, 4), rng.randint(1, 4)) for _ in range(rng.randint(1, 5))]
        return [[(float(x), float(y)), (float(x + w), float(y)), (float(x + w), float(y + h)), (float(x), float(y + h))] for x, y, w, h in made]
    stars = []
    for _ in range(rng.randint(1, 5)):
        n, cx, cy, inner, outer = 2 * rng.randint(3, 8), rng.uniform(0, 3), rng.uniform(0, 3), rng.uniform(0.3, 1), rng.uniform(1, 2)
        stars.append([(cx + (inner if k % 2 else outer) * math.cos(2 * math.pi * k / n), cy + (inner if k % 2 else outer) * math.sin(2 * math.pi * k / n)) for k in range(n)])
    return stars


@pytest.mark.parametrize("kind", ["crossing", "boxes", "stars"])
def test_overlays_cover_what_slabs_count(kind):
    rng = random.Random(kind)
    for _ in range(120):
        rings = random_rings(rng, kind)
        near = lambda x: pytest.approx(x, abs=1e-8)
        whole = V.union([[r] for r in rings])
        assert V.polygon_area(whole) == near(covered_area(rings))
        assert V.polygon_area(V.pieces([rings[0]])) == near(covered_area(rings[:1])) == near(even_odd_area(rings[0]))
        for outer, holes in whole + V.pieces([rings[0]]):
            assert V.shoelace(outer) > 0 and not V.crosses_itself(outer) and all(V.shoelace(h) < 0 and not V.crosses_itself(h) for h in holes)
        if len(rings) > 1:
            both = covered_area(rings[:2], 2)
            assert V.polygon_area(V.common([rings[0]], [rings[1]])) == near(both)
            assert V.polygon_area(V.difference([rings[0]], [rings[1]])) == near(covered_area(rings[:1]) - both)
        if len(rings) == 4:
            assert V.polygon_area(V.overlay([rings[:2], rings[2:]], lambda c: c[0] ^ c[1])) == near(V.polygon_area(V.pieces(rings)))


def test_holes_touching_parts_and_large_coordinates():
    square = lambda x, y, s: [(x, y), (x + s, y), (x + s, y + s), (x, y + s)]
    ((outer, holes),) = V.difference([square(0.0, 0.0, 9.0)], [square(3.0, 3.0, 3.0)])
    assert len(outer) == 4 and len(holes) == 1 and V.shoelace(holes[0]) == -9
    apart = V.union([[square(0.0, 0.0, 1.0)], [square(1.0, 1.0, 1.0)]])  # they touch in a corner
    assert [len(o) for o, _ in apart] == [4, 4]
    far = V.union([[square(512345.25, 7654321.5, 2.0)], [square(512346.25, 7654322.5, 2.0)]])
    assert V.polygon_area(far) == pytest.approx(7) and len(far[0][0]) == 8
    assert V.union([]) == [] and V.union([[[(0.0, 0.0), (1.0, 1.0)]]]) == []
    assert V.polygon_area(V.common([square(0.0, 0.0, 2.0)], [square(2.0, 0.0, 2.0)])) == 0


def test_least_rectangles_against_all_angles():
    rng = random.Random(2)
    for _ in range(60):
        pts = [(rng.gauss(0, 3), rng.gauss(0, 1)) for _ in range(rng.randint(3, 20))]
        major, minor, turn = V.smallest_rectangle(pts)
        areas = []
        for k in range(1800):
            c, s = math.cos(math.pi * k / 1800), math.sin(math.pi * k / 1800)
            x, y = [a * c + b * s for a, b in pts], [b * c - a * s for a, b in pts]
            areas.append((max(x) - min(x)) * (max(y) - min(y)))
        c, s = math.cos(math.radians(turn)), math.sin(math.radians(turn))
        assert min(areas) * 0.98 < major * minor < min(areas) + 1e-9 and major >= minor
        assert max(a * c + b * s for a, b in pts) - min(a * c + b * s for a, b in pts) == pytest.approx(major)
    assert V.smallest_rectangle([]) is None and V.smallest_rectangle([(1.0, 1.0)]) == (0, 0, 0)


def ring_rows(spark, rows):
    return spark.createDataFrame([(k, None if r is None else [{"x": x, "y": y} for x, y in r]) for k, r in rows], f"id long, ring {RING}")


def test_repair_says_what_was_wrong(spark):
    bow = [(0.0, 0.0), (2.0, 2.0), (2.0, 0.0), (0.0, 2.0)]
    rows = [(1, [(0.0, 0.0), (1.0, 0.0), (0.0, 1.0), (0.0, 0.0)]), (2, bow), (3, None), (4, []), (5, [(0.0, 0.0), (1.0, 1.0), (0.0, 0.0)]), (6, [(0.0, 0.0), (math.nan, 1.0), (1.0, 0.0)]), (7, [(0.0, 0.0), (1.0, 1.0), (2.0, 2.0)])]
    got = outlines.repaired(ring_rows(spark, rows), ["id"]).orderBy("id", "part").collect()
    assert [(r.id, r.problem, r.part, r.area) for r in got] == [(1, None, 0, 0.5), (2, "crossing", 0, 1.0), (2, "crossing", 1, 1.0), (3, "missing", None, None), (4, "short", None, None), (5, "short", None, None), (6, "broken", None, None), (7, "crossing", None, None)]
    pair = ring_rows(spark, [(1, bow), (2, bow)])
    (same,) = ring_overlaps(pair.withColumnRenamed("id", "l_id"), pair.withColumnRenamed("id", "r_id"), 4.0, once=True).collect()
    assert same.iou == pytest.approx(1) and same.over_smaller == pytest.approx(1)


def test_clips_keep_holes_of_regions_and_count_parts(spark):
    box = lambda a, b, c, d: [(float(a), float(b)), (float(c), float(b)), (float(c), float(d)), (float(a), float(d))]
    objects = ring_rows(spark, [(1, box(0, 0, 10, 10)), (2, box(20, 0, 22, 2))]).withColumnRenamed("id", "object_id")
    # a frame of four bars that overlap at its corners
    regions = ring_rows(spark, [(k, b) for k, b in enumerate([box(1, 1, 9, 3), box(1, 7, 9, 9), box(1, 1, 3, 9), box(7, 1, 9, 9)])]).select("ring")
    (frame,) = outlines.clip_to_regions(objects, regions, 8.0).collect()
    assert frame.object_id == 1 and frame.area == pytest.approx(64 - 16) and len(frame.holes) == 1
    full = objects.withColumns({"year": F.lit(None).cast("int"), "class": F.lit(0)})
    tiles = spark.createDataFrame([(7, 24, 0.0, 4.0, 10.0, 6.0)], "tile_id long, year int, x1 double, y1 double, x2 double, y2 double")
    cut = outlines.clip_to_tiles(full, tiles, 8.0, regions).collect()
    assert sorted((r.part, round(r.area, 9), r.whole_area) for r in cut) == [(0, 4.0, 48.0), (1, 4.0, 48.0)]
    assert outlines.clip_to_tiles(full, tiles, 8.0).first().area == 20


def test_hits_that_only_touch_count_without_area(spark):
    tri = [(0.0, 0.0), (2.0, 0.0), (0.0, 2.0)]
    marks = ring_rows(spark, [(10, [(1.0, 1.0), (3.0, 1.0), (3.0, 3.0)]), (11, [(0.1, 0.1), (0.5, 0.1), (0.1, 0.5)]), (12, [(1.5, 1.5), (2.0, 1.5), (2.0, 2.0)])])
    got = hits_by_outline(ring_rows(spark, [(1, tri), (2, [(50.0, 50.0), (51.0, 50.0), (50.0, 51.0)])]), marks.withColumnRenamed("id", "mark"), "id", "mark", 4.0, 0.5)
    assert {r.id: (r.fids, r.best_fid, round(r.best_iou, 4)) for r in got.collect()} == {1: ([11, 10], 11, 0.04), 2: ([], None, 0.0)}


def plain_leaders(order, pairs):
    near = {}
    for a, b in pairs:
        near.setdefault(a, set()).add(b)
        near.setdefault(b, set()).add(a)
    leader = {}
    for x in order:
        kept = [y for y in order if y in near.get(x, ()) and leader.get(y) == y]
        leader[x] = kept[0] if kept else x
    return leader


@pytest.mark.parametrize("local", [100_000, 3])
def test_greedy_selection_is_a_walk_in_order(spark, monkeypatch, local):
    monkeypatch.setattr(graph, "LOCAL_PAIRS", local)
    rng = random.Random(local)
    n = 60
    score = {i: rng.randint(0, 5) for i in range(n)}
    pairs = [(rng.randrange(n), rng.randrange(n)) for _ in range(45)]
    nodes = spark.createDataFrame(list(score.items()), "id long, score int")
    got = greedy_select(nodes, spark.createDataFrame(pairs + pairs[:5], "a long, b long"), [-F.col("score"), F.col("id")])
    assert {r.id: r.leader for r in got.collect()} == plain_leaders(sorted(range(n), key=lambda i: (-score[i], i)), [p for p in pairs if p[0] != p[1]])


def test_a_long_chain_takes_no_rounds(spark):
    n = 10_000
    chain = spark.range(n - 1).select(F.col("id").alias("a"), (F.col("id") + 1).alias("b"))
    began = time.time()
    got = greedy_select(spark.range(n), chain, [F.col("id")])
    assert got.where("leader = id").count() == n // 2 and time.time() - began < 60


def test_components_by_rounds_and_in_one_task(spark, monkeypatch):
    rng = random.Random(9)
    pairs = [(rng.randrange(200), rng.randrange(200)) for _ in range(150)] + [(k, k + 1) for k in range(300, 340)]
    edges = spark.createDataFrame(pairs, "u long, v long").repartition(5)
    want = graph.Forest()
    for a, b in pairs:
        if a != b:
            want.join(a, b)
    want = {(x, want.root(x)) for x in list(want.up)}
    for few, held in ((1 << 19, 1 << 20), (0, 7)):
        monkeypatch.setattr(graph, "FEW_EDGES", few)
        monkeypatch.setattr(graph, "TASK_NODES", held)
        assert {tuple(r) for r in components(edges).collect()} == want
    assert components(edges.limit(0)).count() == 0
