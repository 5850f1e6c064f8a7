"""Steps between layers, and the small files."""

import json

import pytest
from pyspark.sql import functions as F

from tidemark.functions import geometry as G
from tidemark.operators import layers
from tidemark.sinks import writers
from tidemark.sources import readers

RINGS = "id long, ring array<struct<x:double,y:double>>"


def ring(*points):
    return [{"x": float(x), "y": float(y)} for x, y in points]


def test_region_keeps_the_area_inside(spark):
    objects = spark.createDataFrame([(1, ring((0, 0), (4, 0), (0, 4))), (2, ring((20, 20), (21, 20), (21, 21))), (3, ring((9, 9), (11, 9), (11, 11), (9, 11)))], RINGS)
    region = spark.createDataFrame([(1, ring((0, 0), (2, 0), (2, 10), (0, 10))), (2, ring((10, 0), (30, 0), (30, 10), (10, 10)))], RINGS.replace("id ", "part_id ", 1))
    got = {r.id: round(r.inside_area, 9) for r in layers.inside_region(objects, region, 4.0).collect()}
    assert got == {1: 6.0, 3: 1.0}
    with pytest.raises(ValueError):
        layers.inside_region(objects, region.limit(0), 4.0)


def test_tiles_without_a_place_give_nulls(spark):
    anns = spark.createDataFrame([(1, 1.0, 2.0, ring((1, 2), (3, 4), (1, 4))), (2, 0.0, 0.0, None), (9, 0.0, 0.0, None)], "image_id long, x double, y double, ring array<struct<x:double,y:double>>")
    images = spark.createDataFrame([(1, "site_02_03.png", 100, 50), (2, "other.png", 10, 10)], "image_id long, file_name string, width int, height int")
    got = sorted((str(r.x), str(r.y), r.image_id) for r in layers.tiles_to_whole(anns, images).collect())
    assert got == [("202.0", "53.0", 1), ("None", "None", 1)]


def test_reference_systems():
    same = layers.same_horizontal
    assert same(25829, "25829") and same(None, 4326) and same("EPSG:25829", 25829)
    assert same("EPSG:25829", 'COMPD_CS["x",PROJCS["ETRS89 / UTM_zone_29N",PARAMETER["central_meridian", -9]]]')
    assert not same(25829, 4326) and not same("EPSG:25830", "EPSG:25829")


def test_source_specs():
    specs = layers.source_specs
    assert specs(None, [24], [("d", 24)]) == [("d", 24)]
    assert specs("a.gpkg:24, b.gpkg:25", [24, 25], []) == [("a.gpkg", 24), ("b.gpkg", 25)]
    assert specs("july13_24.gpkg,x/roi_25.gpkg", [25, 24], []) == [("july13_24.gpkg", 24), ("x/roi_25.gpkg", 25)]
    assert specs("a.gpkg,b.gpkg", [24, 25], []) == [("a.gpkg", 24), ("b.gpkg", 25)]
    assert specs("a.gpkg", [25], []) == [("a.gpkg", 25)] and specs("a.gpkg", [24, 25], []) == [("a.gpkg", None)]
    with pytest.raises(ValueError):
        specs("a.gpkg,b_24.gpkg", [24, 25], [])


def test_small_files(spark, tmp_path):
    rows = spark.createDataFrame([("r1", 1.234, None), ("r2", None, 3)], "run string, ap double, n int")
    writers.write_csv(rows, str(tmp_path / "c"), ["run", "ap", "run"])
    assert spark.read.option("header", True).csv(str(tmp_path / "c")).columns == ["run", "ap"]
    assert writers.markdown_table(rows, "Runs", [F.desc_nulls_last("ap")]) == ["# Runs", "", "| run | ap | n |", "| --- | --- | --- |", "| r1 | 1.23 |  |", "| r2 |  | 3 |"]
    counts = spark.createDataFrame([("matches", "ok", 2), ("matches", "noise", 1), ("appeared", "new", 4)], "layer string, label string, n long")
    got = json.loads(writers.summary_json(counts).first().value)
    assert got["matches"]["total"] == 3 and json.loads(got["matches"]["labels"]) == {"ok": 2, "noise": 1}
    line = spark.sql("select 'a' as name, l as layer, array(named_struct('lon', 1D, 'lat', 2D, 'elevation', 3D)) as line from values ('shape'), ('major') v(l)")
    text = writers.kml_document(writers.kml_placemarks(line)).first().value
    assert text.startswith("<?xml") and text.count("<Folder>") == 2 and text.index("major") < text.index("shape") and text.endswith("</kml>")
    labels = spark.createDataFrame([("b1_a3", 1, 3, "ok", None, "2025"), ("b1_a2", 1, 2, "not", None, "2025")], readers.LABEL.removeprefix("struct<").removesuffix(">"))
    assert {r.label: r.n for r in writers.save_labels(labels, str(tmp_path / "l")).collect()} == {"ok": 1, "not": 1}
    assert [r.label_id for r in spark.read.json(str(tmp_path / "l")).collect()] == ["b1_a2", "b1_a3"]


def test_an_outline_without_area_has_no_ring(spark):
    flat = spark.createDataFrame([(1, 7, ring((0, 0), (4, 0), (8, 0)))], "ann_id long, category_id long, ring array<struct<x:double,y:double>>")
    (r,) = layers.outlines_to_annotations(flat, (0.0, 0.0, 10.0, 10.0), 10, 10).collect()
    assert r.ring == [] and r.area == 0 and (r.x, r.w, r.category_id) == (0, 8, 7)
    assert G.RING.startswith("array")
