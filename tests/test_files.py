import json
import sqlite3
import struct

from pyspark.sql import functions as F

from tidemark.sinks import writers
from tidemark.sources import manifest, readers
from tidemark.streaming import feeds


def test_coco_round_trip(spark, tmp_path):
    ring = F.array(*[F.struct(F.lit(float(x)).alias("x"), F.lit(float(y)).alias("y")) for x, y in ((0, 0), (2, 0), (2, 1))])
    images = spark.range(3).select(F.lit("train").alias("split"), F.struct(F.col("id"), F.lit(10).alias("width"), F.lit(10).alias("height"), F.concat(F.lit("24_1_"), "id", F.lit(".png")).alias("file_name")).alias("image"))
    anns = spark.range(2).select(F.lit("train").alias("split"), writers.coco_annotation(F.col("id"), F.col("id"), F.lit(1), ring, F.lit(1.0), F.struct(F.lit(0.0).alias("x1"), F.lit(0.0).alias("y1"), F.lit(2.0).alias("x2"), F.lit(1.0).alias("y2")), F.lit(0)).alias("ann"))
    writers.write_coco(images, anns, [{"id": 1, "name": "boulder", "supercategory": ""}], str(tmp_path / "c"))
    back = readers.read_coco(spark, str(tmp_path / "c" / "split=train"))
    assert back["images"].count() == 3 and back["categories"].first().name == "boulder"
    assert back["annotations"].first().bbox == [0, 0, 2, 1] and back["annotations"].count() == 2
    assert writers.coco_lines(images, anns).count() == 3


def test_detections_of_both_formats(spark, tmp_path):
    (tmp_path / "a_inference_summary.json").write_text(json.dumps({"detections": [{"class_id": 0, "bbox": [1, 2, 3, 5]}]}))
    (tmp_path / "b_inference_summary.json").write_text(json.dumps({"detections": [{"class_id": 0, "bbox": [1, 2, 3, 5]}]}))
    (tmp_path / "b.json").write_text(json.dumps([{"category_id": 2, "bbox": [1, 2, 3, 5], "score": "0.5"}, {"bbox": None}]))
    dets = readers.read_detections(spark, str(tmp_path))
    got = {r.stem: tuple(r)[1:] for r in dets.collect()}
    assert got == {"a": (1, 1, 2, 3, 5, 1.0), "b": (2, 1, 2, 4, 7, 0.5)}
    images = spark.createDataFrame([(1, "24_a.png"), (2, "b.png"), (3, "c.png")], "image_id long, file_name string")
    assert {(r.image_id, r.score) for r in readers.with_predictions(images, dets).collect()} == {(1, 1.0), (2, 0.5), (3, None)}
    kept, missing = readers.existing(images, spark.createDataFrame([("/x/a.png",), ("/x/b.png",)], "path string"))
    assert kept.count() == 2 and [r.image_id for r in missing.collect()] == [3]


def test_geojson_layer(spark, tmp_path):
    doc = {"type": "FeatureCollection", "features": [
        {"type": "Feature", "properties": {"class": "deposit"}, "geometry": {"type": "MultiPolygon", "coordinates": [[[[0, 0], [1, 0], [1, 1], [0, 0]]], [[[5, 5], [6, 5], [6, 6], [5, 5]], [[5.1, 5.1], [5.2, 5.1], [5.2, 5.2], [5.1, 5.1]]]]}},
        {"type": "Feature", "properties": {}, "geometry": {"type": "Polygon", "coordinates": [[[0, 0], [1, 1], [0, 0]]]}},
        {"type": "Feature", "properties": {}, "geometry": None}]}
    (tmp_path / "l.geojson").write_text(json.dumps(doc))
    layer = readers.read_geojson(spark, str(tmp_path / "l.geojson"))
    good, bad = readers.clean_layer(layer)
    assert good.count() == 2 and {r.reason: r.n for r in bad.collect()} == {"invalid": 1}
    features = writers.geojson_features(good.withColumn("k", F.col("properties")["class"]), ["k", "part_no"])
    (one,) = writers.geojson_collection(features, 25829).collect()
    back = json.loads(one.value)
    assert len(back["features"]) == 2 and "25829" in one.value
    points = spark.createDataFrame([(1, None, None, 2.0, 3.0), (2, 4.0, 5.0, 2.0, 3.0), (3, None, None, None, None)], "id long, after_x double, after_y double, before_x double, before_y double")
    assert [json.loads(r.value)["geometry"]["coordinates"] for r in writers.point_features(points, ["id"]).collect()] == [[2, 3], [4, 5]]


def test_gpkg_layer(spark, tmp_path):
    wkb = lambda ring: struct.pack("<BIII", 1, 3, 1, len(ring)) + b"".join(struct.pack("<dd", *p) for p in ring)
    head = b"GP\x00\x01" + struct.pack("<i", 25829)
    db = sqlite3.connect(tmp_path / "x.gpkg")
    db.execute("CREATE TABLE gpkg_contents (table_name TEXT, data_type TEXT)")
    db.execute("CREATE TABLE gpkg_geometry_columns (table_name TEXT, column_name TEXT)")
    db.execute("CREATE TABLE l (name TEXT, geom BLOB)")
    db.execute("INSERT INTO gpkg_contents VALUES ('l', 'features')")
    db.execute("INSERT INTO gpkg_geometry_columns VALUES ('l', 'geom')")
    db.executemany("INSERT INTO l VALUES (?, ?)", [("a", head + wkb([(0, 0), (1, 0), (1, 1), (0, 0)])), ("b", None), ("c", b"junk")])
    db.commit()
    db.close()
    got = {r.properties["name"]: r.ring for r in readers.read_gpkg(spark, str(tmp_path / "x.gpkg")).collect()}
    assert len(got["a"]) == 4 and got["b"] is None and got["c"] is None


def test_configs_metrics_and_labels(spark, tmp_path):
    (tmp_path / "s.json").write_text(json.dumps({"leakage_check": "geographic", "valid": {"2024": ["1_2", "bad"]}, "test": {"25": ["25_03_04"]}}))
    got = {tuple(r) for r in readers.read_split_config(spark, str(tmp_path / "s.json")).collect()}
    assert got == {("s", "geographic", "valid", 24, 1, 2), ("s", "geographic", "test", 25, 3, 4)}
    run = tmp_path / "run1"
    run.mkdir()
    (run / "metrics_valid.json").write_text('{"bbox": {"AP": 1.5, "AP50": null}, "segm": {"AP": 2}, "time": 3}')
    assert {(r.run, r.metric, r.value) for r in readers.read_metrics(spark, str(run / "metrics_valid.json")).collect()} == {("run1", "bbox/AP", 1.5), ("run1", "segm/AP", 2.0)}
    (run / "log").mkdir()
    (run / "log" / "m.json").write_text('{"iteration": 5, "bbox/AP50": 3.0, "lr": 1}\n\nbroken\n{"bbox/AP50": "nan"}\n{"segm/AP50": 4}\n')
    assert {tuple(r) for r in readers.read_metric_log(spark, str(run / "log")).collect()} == {("log", 5, "bbox/AP50", 3.0), ("log", -1, "segm/AP50", 4.0)}
    (tmp_path / "labels.json").write_text(json.dumps({"labels": [{"label_id": "b1_a2", "label": "not", "labeled_at": "2024"}, {"label_id": "b1_a2", "label": "confirmed", "labeled_at": "2025"}, {"label": "unsure"}]}))
    assert [r.label for r in readers.read_labels(spark, str(tmp_path / "labels.json")).collect()] == ["confirmed"]


def test_tile_names(spark):
    names = ["24_01_02.tif", "x/25_3_4_rot90.png", "5_6", "other", "24_1_2_antitranspose", "24_Sites1and2_2024_Orthomosaic_07_38.tif", "25_25IniSouthOrt_05_31_hflip.png", "Sites1and2_2024_Orthomosaic_07_38.tif", "a/25IniSouthOrt_05_31.tif", "24_07_38_hflip.png", "24_07_38_vflip.png", "26_07_38.tif"]
    df = spark.createDataFrame([(n,) for n in names], "n string").select(manifest.tile_key(F.col("n")).alias("k"))
    assert [tuple(r.k) if r.k else None for r in df.collect()] == [(24, 1, 2), (25, 3, 4), (None, 5, 6), None, (24, 1, 2), (24, 7, 38), (25, 5, 31), (24, 7, 38), (25, 5, 31), (24, 7, 38), (24, 7, 38), None]
    tiles = spark.createDataFrame([(24, 1, 2), (25, 1, 2), (24, 9, 9)], "year int, tile_row int, tile_col int")
    listing = spark.createDataFrame([("/p/24_01_02.tif",), ("/p/1_2.tif",)], "path string")
    assert {(r.year, r.tile_row): r.path for r in readers.resolve_tiles(tiles, listing).collect()} == {(24, 1): "/p/24_01_02.tif", (25, 1): "/p/1_2.tif", (24, 9): None}


def test_kml(spark, tmp_path):
    rows = spark.sql("select 'a&b' as name, 'shape' as layer, array(named_struct('lon', 1D, 'lat', 2D, 'elevation', 3D), named_struct('lon', 4D, 'lat', 5D, 'elevation', 6D)) as line")
    (r,) = writers.kml_placemarks(rows).collect()
    assert "a&amp;b" in r.value and r.value.count("1.000000000000,2.000000000000,3.00") == 2
    writers.write_kml(rows, str(tmp_path / "k"))


def test_write_if_changed(spark, tmp_path):
    df, path, table = spark.range(3), str(tmp_path / "d"), str(tmp_path / "lineage")
    assert writers.write_if_changed(df, path, table, {"a": 1}, "t")
    assert not writers.write_if_changed(df, path, table, {"a": 1}, "t")
    assert writers.write_if_changed(df, path, table, {"a": 2}, "t")
    assert writers.write_if_changed(df, path, table, {"b": 2}, "t")
    assert writers.write_if_changed(df, path, table, {"b": 2}, "t", force=True)
    assert not writers.write_if_changed(df, path, str(tmp_path / "no"), {"a": 9}, "t")
    writers.append_lineage(spark, table, "child", "training", "t2", {}, parents=[path])
    assert writers.lineage_of(spark, table, "child").first().parents[0].tool == "t"


def test_streams(spark, tmp_path):
    (tmp_path / "in" / "r1").mkdir(parents=True)
    (tmp_path / "in" / "r1" / "a.json").write_text('{"iteration": 1, "bbox/AP50": 3.0}\n{"iteration": 2, "bbox/AP50": 5.0}\n{"iteration": 3, "bbox/AP50": 5.0}\n')
    best = feeds.best_so_far(feeds.metric_stream(spark, str(tmp_path / "in" / "*")))
    q = best.writeStream.format("memory").queryName("best").outputMode("complete").trigger(availableNow=True).option("checkpointLocation", str(tmp_path / "ck")).start()
    q.awaitTermination(120)
    assert [tuple(r) for r in spark.table("best").collect()] == [("r1", "bbox/AP50", 5.0, 2)]
    dets = spark.sql("select timestamp'2024-01-01 00:01:00' as arrived, 1L as window_id, 0D as x1, 0D as y1, 1D as x2, 1D as y2, 0.5D as score")
    dets.write.parquet(str(tmp_path / "d"))
    windows = spark.createDataFrame([(1, 7, 10, 20)], "window_id long, tile_id long, c0 long, r0 long")
    counts = feeds.tile_counts(spark.readStream.schema(dets.schema).parquet(str(tmp_path / "d")), windows)
    q = counts.writeStream.format("memory").queryName("counts").outputMode("complete").trigger(availableNow=True).option("checkpointLocation", str(tmp_path / "ck2")).start()
    q.awaitTermination(120)
    assert [(r.tile_id, r.n, r.best) for r in spark.table("counts").collect()] == [(7, 1, 0.5)]


def test_predictions_by_ends_of_names(spark):
    images = spark.createDataFrame([(1, "24_site_07_38.png"), (2, "24_site_07_39.png"), (3, "07_40.png"), (4, "25_only.png"), (5, "none.png")], "image_id long, file_name string")
    dets = spark.createDataFrame([("24_site_07_38", 0.1), ("site_07_38", 0.2), ("site_07_39", 0.3), ("run2_24_07_40", 0.4), ("run_only", 0.5)], "stem string, score double")
    got = {r.image_id: r.score for r in readers.with_predictions(images, dets).collect()}
    assert got == {1: 0.1, 2: 0.3, 3: 0.4, 4: 0.5, 5: None}


def test_windows_move_rings_and_count_border_pixels(spark):
    dets = spark.sql("select 1L as window_id, 2 as x1, 3 as y1, 5 as x2, 9 as y2, array(named_struct('x', 2D, 'y', 3D)) as ring")
    windows = spark.sql("select 1L as window_id, 100L as c0, 50L as r0")
    (r,) = manifest.stitch(dets, windows).collect()
    assert (r.x1, r.y1, r.x2, r.y2, r.w, r.h) == (102, 53, 105, 59, 4, 7) and tuple(r.ring[0]) == (102.0, 53.0)
