"""Layers read for training and review, records of pairs, metrics on extents, configs, lineage, systems of reference."""

import json
import math

import pytest
from pyspark.sql import functions as F

from tidemark.functions import geometry as G
from tidemark.operators import dataset, lookups, outlines, raster, splits
from tidemark.operators.matching import hits_by_outline
from tidemark.sinks import writers
from tidemark.sources import readers

RING = "array<struct<x:double,y:double>>"


def ring(*points):
    return [{"x": float(x), "y": float(y)} for x, y in points]


def test_projection_is_undone_and_matches_known_places(spark):
    lonlat = [(-9.0, 0.0), (-9.0, 52.0), (-6.26, 53.35), (-11.9, 51.4), (-7.5, 60.0)]
    rows = spark.createDataFrame(lonlat, "lon double, lat double").withColumn("p", G.lonlat_to_utm(F.col("lon"), F.col("lat")))
    for r in rows.withColumn("b", G.utm_to_lonlat(F.col("p.x"), F.col("p.y"))).collect():
        assert (r.b.lon, r.b.lat) == pytest.approx((r.lon, r.lat), abs=1e-8)  # a millimetre
    first, second = rows.collect()[:2]
    assert (first.p.x, first.p.y) == pytest.approx((500000, 0), abs=1e-6)
    # on the meridian the northing is the arc from the equator, by quadrature, times 0.9996
    a, f = 6378137.0, 1 / 298.257222101
    e2, n = f * (2 - f), 20000
    arc = sum(a * (1 - e2) / (1 - e2 * math.sin(math.radians(52) * (k + 0.5) / n) ** 2) ** 1.5 for k in range(n)) * math.radians(52) / n
    assert second.p.y == pytest.approx(0.9996 * arc, abs=1e-3)


def test_annotations_in_degrees_are_mended_and_counted(spark, tmp_path):
    step = 1e-4
    square = [[-9 + i * step, 52 + j * step] for i, j in ((0, 0), (1, 0), (1, 1), (0, 1), (0, 0))]
    bow = [[-9 + i * step, 52 + j * step] for i, j in ((3, 0), (5, 2), (5, 0), (3, 2), (3, 0))]
    feature = lambda g, **p: {"type": "Feature", "properties": p, "geometry": g}
    doc = {"type": "FeatureCollection", "features": [feature({"type": "Polygon", "coordinates": [square]}, kind="Boulder Deposit"), feature({"type": "Polygon", "coordinates": [bow]}, kind="boulder1"), feature({"type": "Polygon", "coordinates": [[[0, 0], [1, 1], [0, 0]]]})]}
    path = str(tmp_path / "july_24.geojson")
    open(path, "w").write(json.dumps(doc))
    notes, why = readers.read_annotations(spark, path, "kind", 24, 4326)
    got = notes.withColumn("area", G.ring_area(F.col("ring"))).collect()
    assert sorted((r["class"], r.year) for r in got) == [(0, 24), (0, 24), (1, 24)]
    metre = {r["class"]: r.area for r in got}[1]
    assert metre == pytest.approx(math.radians(step) ** 2 * 6378137**2 * math.cos(math.radians(52)) * 0.9996**2, rel=0.01)
    assert {r.reason: r.n for r in why.collect()} == {"invalid": 1, "crossing": 1, "unknown_class": 1}
    manual = readers.read_manual(spark, path, 4326)
    assert sorted(r.ann_fid for r in manual.collect()) == [1, 2, 2]
    with pytest.raises(ValueError):
        readers.reprojected(manual, 3857)


def test_pair_records_hold_both_outlines_and_hits(spark):
    before = spark.createDataFrame([(1, ring((0, 0), (2, 0), (2, 2), (0, 2))), (2, ring((9, 9), (10, 9), (9, 10)))], f"before_id long, ring {RING}")
    after = spark.createDataFrame([(5, ring((1, 0), (3, 0), (3, 2), (1, 2)))], f"after_id long, ring {RING}")
    matches = spark.createDataFrame([(1, 5, 0.9, float("nan")), (2, 6, 0.6, 1.0)], "before_id long, after_id long, score double, distance double")
    marks = spark.createDataFrame([(77, ring((0, 0), (2, 0), (2, 2), (0, 2)))], f"ann_fid long, ring {RING}")
    hits = hits_by_outline(before, marks, "before_id", "ann_fid", 8.0)
    labels = spark.createDataFrame([("b1_a5", "yes", None, "t1"), ("b2_a6", None, "look", "t2")], "label_id string, label string, note string, labeled_at string")
    one, two = lookups.pair_records(matches, before, after, {"manual_24": hits}, labels).orderBy("before_id").collect()
    assert one.match_key == "b1_a5" and one.score == 0.9 and one.distance is None and one.labeled_at == "t1" and one.note == ""
    assert one.before.area_m2 == 4 and one.before.bbox == [0, 0, 2, 2] and one.before.wkt == "POLYGON ((0.0 0.0, 2.0 0.0, 2.0 2.0, 0.0 2.0, 0.0 0.0))"
    assert one.extent == "-5.000,-5.000,8.000,7.000 [EPSG:25829]" and one.manual_24.fids == [77] and one.manual_24.best_iou == 1
    assert two.after is None and two.before.area_m2 == 0.5 and two.labeled_at is None and two.note == "look" and not two.manual_24.intersects


def test_metrics_join_extents_and_later_rows_win(spark):
    extents = spark.createDataFrame([("24_01_01", 1.0), ("24_01_02", 2.0)], "year_key string, x1 double")
    rows = spark.createDataFrame([("24_01_01", 1, 10.0, float("nan"), 4, 5), ("24_01_01", 2, 30.0, float("inf"), 6, 7), (None, 3, 1.0, 1.0, 1, 1)], "year_key string, place int, ap double, ar double, gt_count long, pred_count long")
    got = {r.year_key: (r.ap, r.ar, r.gt_count, r.pred_count) for r in lookups.metrics_on_extents(extents, rows, ["ap", "ar"], [F.col("place")]).collect()}
    assert got == {"24_01_01": (30.0, None, 6, 7), "24_01_02": (None, None, None, None)}


def test_split_configs_come_back_as_written(spark, tmp_path):
    tiles = spark.createDataFrame([("s1", "valid", 24, "01_02"), ("s1", "test", 25, "03_04"), ("s1", "test", 25, "01_09"), ("s2", "excluded", 24, "05_06")], "setup string, split string, year int, tile string")
    writers.write_split_config(splits.split_map(tiles, ["setup"]), str(tmp_path / "configs"))
    back = readers.read_split_config(spark, str(tmp_path / "configs" / "setup=*" / "*.txt"))
    assert {(r.setup, r.split, r.year, r.tile_row, r.tile_col) for r in back.collect()} == {("s1", "valid", 24, 1, 2), ("s1", "test", 25, 3, 4), ("s1", "test", 25, 1, 9), ("s2", "excluded", 24, 5, 6)}


def test_long_lists_are_short_in_lineage(spark, tmp_path):
    table = str(tmp_path / "lineage")
    writers.append_lineage(spark, table, "d", "tiling", "tool", {"tiles": [f"t{k}" for k in range(9)], "few": [1, 2]})
    flags = writers.lineage_of(spark, table, "d").first().flags
    assert json.loads(flags["tiles"]) == {"count": 9, "first": ["t0", "t1", "t2", "t3", "t4"]} and json.loads(flags["few"]) == [1, 2]
    assert writers.flags_match(flags, {"tiles": [f"t{k}" for k in range(9)]}) and not writers.flags_match(flags, {"tiles": [f"t{k}" for k in range(8)]})


def test_pools_bands_and_elevation(spark):
    a, b = spark.createDataFrame([(1, "x")], "image_id long, file string"), spark.createDataFrame([(1, 2)], "image_id long, n int")
    assert {tuple(r) for r in dataset.pooled({"train": a, "valid": b}).select("layer", "image_id", "file", "n").collect()} == {("train", 1, "x", None), ("valid", 1, None, 2)}
    images = spark.createDataFrame([("24_01_01.tif",), ("24_09_09.tif",)], "file_name string")
    listing = spark.createDataFrame([("d/24_01_01.tif",)], "path string")
    bands = spark.createDataFrame([("d/24_01_01.tif", n, [float(k)]) for k, n in enumerate("rgbz")] + [("d/other.tif", "r", [9.0])], "path string, band string, vals array<double>")
    full, missing = dataset.with_bands(images, listing, bands, list("rgbz"))
    assert [(r.file_name, r.r, r.z) for r in full.collect()] == [("24_01_01.tif", [0.0], [3.0])] and missing.first().file_name == "24_09_09.tif"
    cells = [(0, r, c, 5.0 + 0.01 * c + (2.0 if 8 <= r < 11 and 8 <= c < 11 else 0.0) + (9.0 * ((r * 7 + c * 13) % 5) if r < 2 else 0.0)) for r in range(24) for c in range(24)]
    boxes = [(0, 0, 8.0, 13.0, 11.0, 16.0), (0, 1, 12.0, 20.0, 14.0, 22.0), (0, 2, 90.0, 90.0, 91.0, 91.0)]
    objects = spark.createDataFrame(boxes, "raster_id long, object_id long, x1 double, y1 double, x2 double, y2 double")
    volumes = raster.cubic_base_volumes(objects, spark.createDataFrame(cells, "raster_id long, r long, c long, z double"), 24, "z")
    yes, no = lookups.split_by_elevation(objects, volumes, ["raster_id", "object_id"])
    assert [r.object_id for r in yes.collect()] == [0] and sorted(r.object_id for r in no.collect()) == [1, 2]


def test_pixels_of_a_raster_in_degrees(spark):
    one = spark.range(1).select(G.whole_pixel_to_limits(*[F.lit(float(v)) for v in (3, 5, -10, 54, 0.5, 0.25)]).alias("p")).first().p
    assert (one.lon, one.lat) == (-9.0, 53.0)


def test_rectangles_of_nothing(spark):
    rows = spark.createDataFrame([(1, None), (2, []), (3, ring((0, 0), (4, 0), (4, 2), (0, 2)))], f"id long, ring {RING}")
    assert {r.id: (r.major, r.minor, r.orientation) for r in outlines.rectangles(rows, ["id"]).collect()} == {1: (None, None, None), 2: (None, None, None), 3: (4.0, 2.0, 0.0)}
