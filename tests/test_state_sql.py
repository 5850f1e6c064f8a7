"""Streams with state against the batch operators, SQL functions, sparse matching, nearest objects, small files."""

import json
import random
import resource
import time
from datetime import datetime, timedelta

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tidemark.functions import sql
from tidemark.functions.geometry import axis_ends, expanded
from tidemark.operators import assign, dataset, evaluation, layers, splits
from tidemark.operators.selection import suppress
from tidemark.sources import readers
from tidemark.streaming import state


def drained(stream, tmp_path, mode, name):
    q = stream.writeStream.outputMode(mode).format("memory").queryName(name).option("checkpointLocation", str(tmp_path / f"c_{name}")).trigger(availableNow=True).start()
    try:
        q.processAllAvailable()
        q.awaitTermination(120)
        assert q.exception() is None
    finally:
        q.stop()


@pytest.mark.parametrize("order", [0, 1])
def test_stops_are_those_of_the_batch_in_any_order_of_files(spark, tmp_path, order):
    rng = random.Random(4)
    rows = [(f"r{k}", 100 * i, round(rng.random() * (1 - abs(i - 8) / 20), 3)) for k in range(3) for i in range(20)] + [("r1", 150, None)]
    shuffled = sorted(rows, key=lambda r: (hash((order, r[1] % 700)), str(r)))
    for k in range(4):
        (tmp_path / "in").mkdir(exist_ok=True)
        (tmp_path / "in" / f"{k}.json").write_text("\n".join(json.dumps(dict(zip(("run", "iteration", "value"), r))) for r in shuffled[k::4]))
    schema = "run string, iteration long, value double"
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).json(str(tmp_path / "in"))
    drained(state.early_stops(stream, 400), tmp_path, "update", f"stops{order}")
    out = spark.table(f"stops{order}").collect()
    last = {}
    for r in out:
        last[r.run] = (r.best_iteration, r.stop_iteration)
    want = {r.run: (r.best_iteration, r.stop_iteration) for r in evaluation.early_stop(spark.createDataFrame(rows, schema), 400).collect()}
    assert last == want and len(out) > 3


def test_tiles_are_suppressed_when_their_last_window_arrives(spark, tmp_path):
    rng = random.Random(6)
    start = datetime(2026, 1, 1)
    rows, det = [], 0
    for tile in range(4):
        for window in range(3):
            if tile == 3 and window == 2:
                continue  # never arrives
            when = start + timedelta(minutes=rng.randint(0, 5))
            rows.append((when, tile, 10 * tile + window, 3, None, None, None, None, None, None))
            for _ in range(rng.randint(0, 6)):
                x, y = rng.uniform(0, 20), rng.uniform(0, 20)
                rows.append((when, tile, 10 * tile + window, 3, det, x, y, x + 8, y + 8, round(rng.random(), 3)))
                det += 1
    names = ["arrived", "tile_id", "window_id", "n_windows", "det_id", "x1", "y1", "x2", "y2", "score"]
    whole = [[r for r in rows if r[2] % 10 == w] for w in (1, 0, 2)]
    whole.append([(start + timedelta(hours=h), 9, 90, 2, None, None, None, None, None, None) for h in (3,)])
    whole.append([(start + timedelta(hours=9), 9, 91, 2, None, None, None, None, None, None)])
    (tmp_path / "in").mkdir()
    for k, part in enumerate(whole):
        (tmp_path / "in" / f"{k}.json").write_text("\n".join(json.dumps(dict(zip(names, (r[0].isoformat(), *r[1:])))) for r in part))
        time.sleep(0.05)
    stream = spark.readStream.schema("arrived timestamp, tile_id long, window_id long, n_windows long, det_id long, x1 double, y1 double, x2 double, y2 double, score double").option("maxFilesPerTrigger", 1).json(str(tmp_path / "in"))
    drained(state.suppressed_tiles(stream), tmp_path, "append", "tiles")
    got = {(r.tile_id, r.det_id, r.kept_from_n, r.complete) for r in spark.table("tiles").collect()}
    boxes = spark.createDataFrame([(r[4], r[1], *r[5:]) for r in rows if r[4] is not None], "id long, tile_id long, x1 double, y1 double, x2 double, y2 double, score double")
    want = {(r.tile_id, r.id, r.kept_from_n, r.tile_id != 3) for r in suppress(boxes, 16.0, group=["tile_id"]).where("leader = id").collect()}
    assert got == want


def test_functions_for_sql(spark):
    sql.register(spark)
    one = lambda text: spark.sql(text).first()[0]
    assert one("SELECT poly_iou(array(0D,0D,2D,0D,2D,2D,0D,2D), array(1D,0D,3D,0D,3D,2D,1D,2D))") == pytest.approx(1 / 3)
    assert one("SELECT poly_iou(array(0D,0D,1D,1D), NULL)") == 0
    assert one("SELECT clip_to_box(array(0D,0D,4D,0D,0D,4D), 1D, 1D, 9D, 9D)") == [[1.0, 1.0, 3.0, 1.0, 1.0, 3.0]] or one("SELECT poly_area(clip_to_box(array(0D,0D,4D,0D,0D,4D), 1D, 1D, 9D, 9D)[0])") == 2
    spark.createDataFrame([(1, [0.0, 0.0, 2.0, 0.0, 2.0, 2.0, 0.0, 2.0]), (1, [1.0, 1.0, 3.0, 1.0, 3.0, 3.0, 1.0, 3.0]), (2, [0.0, 0.0, 1.0, 0.0, 0.0, 1.0]), (2, None)], "g int, seg array<double>").createOrReplaceTempView("outlines_in")
    got = spark.sql("SELECT g, size(poly_union(seg)) AS parts, poly_area(poly_union(seg)[0]) AS area FROM outlines_in GROUP BY g ORDER BY g").collect()
    assert [(r.g, r.parts, r.area) for r in got] == [(1, 1, 7.0), (2, 1, 0.5)]
    images = spark.createDataFrame([(1, 700, 500), (2, 300, 1200)], "image_id long, width long, height long")
    images.createOrReplaceTempView("images_in")
    from tidemark.sources.manifest import window_grid

    want = {tuple(r) for r in window_grid(images, 512, 0.5).collect()}
    assert {tuple(r) for r in spark.sql("SELECT image_id, r0, r1, c0, c1 FROM window_grid(TABLE(images_in), 512, 0.5D)").collect()} == want
    spark.createDataFrame([(5, [0.0, 0.0, 2.0, 0.0, 0.0, 1.0], 10.0, 20.0)], "ann_id long, seg array<double>, width double, height double").createOrReplaceTempView("anns_in")
    turned = {r.variant: r.seg for r in spark.sql("SELECT * FROM dihedral_rings(TABLE(anns_in))").collect()}
    assert len(turned) == 8 and turned["hflip"] == [10, 0, 8, 0, 10, 1] and turned["rot90"] == [20, 0, 20, 2, 19, 0]


def dense_best(pairs, n, m):
    """Most pairs, then the highest total, by trying all."""
    best = {}

    def go(i, used, count, total):
        if i == n:
            best["x"] = max(best.get("x", (0, 0.0)), (count, round(total, 9)))
            return
        go(i + 1, used, count, total)
        for j in range(m):
            if (i, j) in pairs and j not in used:
                go(i + 1, used | {j}, count + 1, total + pairs[i, j])

    go(0, frozenset(), 0, 0.0)
    return best["x"]


def test_sparse_matching_against_all_matchings():
    rng = random.Random(3)
    for _ in range(300):
        n, m = rng.randint(1, 6), rng.randint(1, 6)
        pairs = {(i, j): round(rng.uniform(0.55, 1), 3) for i in range(n) for j in range(m) if rng.random() < 0.45}
        if pairs:
            got = assign.solve(pd.DataFrame([(i, j, s) for (i, j), s in pairs.items()], columns=["a", "b", "score"]))
            assert got["a"].is_unique and got["b"].is_unique
            assert (len(got), round(got["score"].sum(), 9)) == dense_best(pairs, n, m)


def test_a_component_of_fifty_thousand_in_little_memory():
    rng = np.random.default_rng(5)
    n = 25_000
    a = np.repeat(np.arange(n), 3)
    b = np.clip(a + np.tile([0, 1, 2], n) + (rng.random(3 * n) < 0.1), 0, n - 1)
    pairs = pd.DataFrame({"a": a, "b": b, "score": np.round(rng.uniform(0.55, 1, 3 * n), 6)}).drop_duplicates(["a", "b"])
    before, began = resource.getrusage(resource.RUSAGE_SELF).ru_maxrss, time.time()
    got = assign.solve(pairs)
    assert got["a"].is_unique and got["b"].is_unique and len(got) > 24_900
    assert resource.getrusage(resource.RUSAGE_SELF).ru_maxrss - before < 1_000_000 and time.time() - began < 120


def test_nearest_objects_where_density_varies(spark):
    rng = random.Random(8)
    rows = [(i, rng.gauss(0, 0.01), rng.gauss(0, 0.01)) for i in range(60)] + [(100 + i, rng.uniform(-500, 500), rng.uniform(-500, 500)) for i in range(40)]
    rows += [(200 + i, 7.5, -3.25) for i in range(30)] + [(300, 90_000.0, 1.0), (301, None, 1.0), (302, float("inf"), 1.0)]
    got = layers.nearest(spark.createDataFrame(rows, "id long, cx double, cy double"), 5)
    usable = [r for r in rows if r[1] is not None and abs(r[1]) < 1e300]
    want = set()
    for i, x, y in usable:
        near = sorted((((u - x) * (u - x) + (v - y) * (v - y)) ** 0.5, j) for j, u, v in usable if j != i)[:5]
        want |= {(i, j, round(d, 9), k + 1) for k, (d, j) in enumerate(near)}
    assert {(r.id, r.other, round(r.distance, 9), r.place) for r in got.collect()} == want
    assert layers.nearest(spark.createDataFrame(rows[:3], "id long, cx double, cy double"), 5).count() == 6
    assert layers.nearest(spark.createDataFrame([], "id long, cx double, cy double"), 5).count() == 0


def test_regions_from_several_files_and_mended_layers(spark, tmp_path):
    box = lambda a, b, c, d: [[a, b], [c, b], [c, d], [a, d], [a, b]]
    bow = [[0, 0], [2, 2], [2, 0], [0, 2], [0, 0]]
    feature = lambda g: {"type": "Feature", "properties": {}, "geometry": g}
    (tmp_path / "a.geojson").write_text(json.dumps({"type": "FeatureCollection", "features": [feature({"type": "Polygon", "coordinates": [box(0, 0, 4, 4)]})]}))
    both = {"type": "GeometryCollection", "geometries": [{"type": "Polygon", "coordinates": [box(3, 0, 6, 4)]}, {"type": "Point", "coordinates": [1, 1]}, {"type": "MultiPolygon", "coordinates": [[bow]]}]}
    (tmp_path / "b.geojson").write_text(json.dumps({"type": "FeatureCollection", "features": [feature(both), feature({"type": "Point", "coordinates": [1, 1]})]}))
    paths = [str(tmp_path / "a.geojson"), str(tmp_path / "b.geojson")]
    region = readers.read_regions(spark, paths)
    assert region.count() == 4  # two boxes and the bow's two parts
    thing = spark.createDataFrame([(1, [{"x": 2.0, "y": 1.0}, {"x": 9.0, "y": 1.0}, {"x": 9.0, "y": 2.0}, {"x": 2.0, "y": 2.0}])], "id long, ring array<struct<x:double,y:double>>")
    assert layers.inside_region(thing, region, 4.0).first().inside_area == pytest.approx(4)
    kept, why = readers.clean_layer(readers.read_geojson(spark, paths[1]), repair=True, year=25)
    assert {r.reason: r.n for r in why.collect()} == {"crossing": 1} and kept.count() == 3 and {r.year for r in kept.collect()} == {25}
    assert readers.read_geojson(spark, str(tmp_path / "none.geojson")).count() == 0
    big = readers.largest_part(readers.read_geojson(spark, paths[1]), ["file", "feature_no"]).collect()
    assert len(big) == 1 and max(p.x for p in big[0].ring) == 6
    with pytest.raises(ValueError):
        readers.read_regions(spark, [str(tmp_path / "none.geojson")])


def test_small_functions_that_no_query_calls(spark):
    p = lambda x, y: F.struct(F.lit(float(x)).alias("x"), F.lit(float(y)).alias("y"))
    ends, grown = spark.range(1).select(axis_ends(p(1, 1), F.lit(2.0), F.lit(90.0)), expanded(F.array(p(0, 0), p(4, 0), p(4, 4), p(0, 4)), F.lit(2.0**0.5))).first()
    assert [(round(e.x, 9), round(e.y, 9)) for e in ends] == [(1, 0), (1, 2)]
    assert [(round(e.x, 9), round(e.y, 9)) for e in grown] == [(-1, -1), (5, -1), (5, 5), (-1, 5)]
    notes = spark.createDataFrame([("train", 0), ("train", 1), ("valid", 1)], "split string, iscrowd int")
    images = spark.createDataFrame([("train",), ("train",), ("test",), ("valid",)], "split string")
    assert {tuple(r) for r in dataset.dataset_summary(notes, images).collect()} == {("train", 2, 2, 1, 1), ("test", 1, 0, 0, 0), ("valid", 1, 1, 0, 1)}
    place = "year int, tile string"
    tiles = spark.createDataFrame([(24, "a"), (24, "b"), (25, "a")], place)
    config = spark.createDataFrame([(24, "a", "valid"), (24, "a", "test"), (25, "z", "test"), (25, "a", "excluded")], place + ", split string")
    faults = splits.config_faults(tiles, config, ["year", "tile"])
    assert {tuple(r) for r in faults.collect()} == {(25, "z", "not_in_manifest"), (24, "a", "valid_and_test")}
    assert splits.config_faults(tiles, config.where("split = 'excluded'"), ["year", "tile"]).count() == 0
    maps = splits.split_map(config.withColumn("setup", F.lit("s")), ["setup"]).first()
    assert maps.valid == {24: ["a"]} and maps.test == {24: ["a"], 25: ["z"]} and maps.excluded == {25: ["a"]}
    clusters = spark.createDataFrame([("g", k, k % 10) for k in range(60)], "g string, tile long, cluster long")
    dealt = splits.random_setup(clusters, ["g"], 42)
    again = {(r.cluster, r.split) for r in splits.random_setup(clusters, ["g"], 42).collect()}
    assert {(r.cluster, r.split) for r in dealt.collect()} == again and len(again) == 10
    assert sorted(s for _, s in again) == ["test"] * 2 + ["train"] * 6 + ["valid"] * 2
