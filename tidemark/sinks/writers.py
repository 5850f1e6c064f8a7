"""Writers: COCO documents, GeoJSON, KML, lineage and writes that are skipped when nothing changed."""

from __future__ import annotations

import json

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidemark.functions.geometry import closed, ring_to_flat


def coco_annotation(ann_id: Column, image_id: Column, category_id: Column, ring: Column, area: Column, box: Column, iscrowd: Column) -> Column:
    return F.struct(
        ann_id.alias("id"),
        image_id.alias("image_id"),
        category_id.alias("category_id"),
        F.array(ring_to_flat(ring)).alias("segmentation"),
        area.alias("area"),
        F.array(box["x1"], box["y1"], box["x2"] - box["x1"], box["y2"] - box["y1"]).alias("bbox"),
        iscrowd.alias("iscrowd"),
    )


def coco_lines(images: DataFrame, annotations: DataFrame) -> DataFrame:
    """One row per image with its annotations as JSON: the form of a split that scales (split, value).

    images: split, image (struct with id); annotations: split, ann (struct from coco_annotation()).
    """
    anns = annotations.groupBy("split", F.col("ann.image_id").alias("image_id")).agg(F.sort_array(F.collect_list("ann")).alias("annotations"))
    both = images.withColumn("image_id", F.col("image.id")).join(anns, ["split", "image_id"], "left")
    return both.select("split", F.to_json(F.struct("image", "annotations")).alias("value"))


def write_coco(images: DataFrame, annotations: DataFrame, categories: list[dict], path: str) -> None:
    """One COCO document per split, split=<name>/part-*: for tools that want a single document; ids decide the order.

    A split's document is one string, so a split must fit in a task; larger ones are for coco_lines().
    """
    i = images.groupBy("split").agg(F.sort_array(F.collect_list("image")).alias("images"))
    a = annotations.groupBy("split").agg(F.sort_array(F.collect_list("ann")).alias("annotations"))
    kinds = F.from_json(F.lit(json.dumps(categories)), "array<struct<id:int,name:string,supercategory:string>>")
    docs = i.join(a, "split", "left").select("split", F.to_json(F.struct("images", F.coalesce("annotations", F.array().cast(dict(a.dtypes)["annotations"])).alias("annotations"), kinds.alias("categories"))).alias("value"))
    docs.write.partitionBy("split").mode("overwrite").text(path)


def geojson_features(rows: DataFrame, properties: list[str], ring: str = "ring") -> DataFrame:
    """One GeoJSON feature per row and line; rings are closed, rings of fewer than three points are left out."""
    points = F.transform(closed(F.col(ring)), lambda p: F.array(p["x"], p["y"]))
    geometry = F.struct(F.lit("Polygon").alias("type"), F.array(points).alias("coordinates"))
    ok = rows.where(F.size(ring) >= 3)
    return ok.select(F.to_json(F.struct(F.lit("Feature").alias("type"), F.struct(*properties).alias("properties"), geometry.alias("geometry"))).alias("value"))


def point_features(rows: DataFrame, properties: list[str]) -> DataFrame:
    """Label points: the place after, else the place before, else nothing (columns after_x, after_y, before_x, before_y)."""
    x, y = F.coalesce("after_x", "before_x"), F.coalesce("after_y", "before_y")
    geometry = F.struct(F.lit("Point").alias("type"), F.array(x, y).alias("coordinates"))
    return rows.where(x.isNotNull() & y.isNotNull()).select(F.to_json(F.struct(F.lit("Feature").alias("type"), F.struct(*properties).alias("properties"), geometry.alias("geometry"))).alias("value"))


def geojson_collection(features: DataFrame, srid: int) -> DataFrame:
    """A single FeatureCollection, for small layers: one string in one task."""
    head = f'{{"type":"FeatureCollection","crs":{{"type":"name","properties":{{"name":"urn:ogc:def:crs:EPSG::{srid}"}}}},"features":['
    return features.agg(F.concat(F.lit(head), F.array_join(F.sort_array(F.collect_list("value")), ","), F.lit("]}")).alias("value"))


def kml_placemarks(rows: DataFrame) -> DataFrame:
    """name, layer and line (array of struct lon, lat, elevation) to one placemark per row; the first point comes again at the end."""
    line = F.concat("line", F.slice("line", 1, 1))
    points = F.array_join(F.transform(line, lambda p: F.format_string("%.12f,%.12f,%.2f", p["lon"], p["lat"], p["elevation"])), " ")
    return rows.select("layer", F.concat(F.lit("<Placemark><name>"), F.replace(F.replace("name", F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit("</name><LineString><coordinates>"), points, F.lit("</coordinates></LineString></Placemark>")).alias("value"))


def write_kml(rows: DataFrame, path: str) -> None:
    """One folder per layer (shape, major, minor, ...): files of placemarks, to be put between kml tags by whoever joins them."""
    kml_placemarks(rows).write.partitionBy("layer").mode("overwrite").text(path)


LINEAGE = "path string, kind string, tool string, created_utc timestamp, command array<string>, flags map<string,string>, parents array<struct<path:string,kind:string,tool:string>>"


def read_lineage(spark: SparkSession, table: str) -> DataFrame:
    try:
        return spark.read.schema(LINEAGE).parquet(table)
    except AnalysisException:
        return spark.createDataFrame([], LINEAGE)


def append_lineage(spark: SparkSession, table: str, path: str, kind: str, tool: str, flags: dict, command: list[str] | None = None, parents: list[str] | None = None) -> None:
    """One more row of a lineage table; parents are looked up there; flag values are kept as JSON, of a long list its length and first five."""
    known = read_lineage(spark, table)
    found = [{"path": p, "kind": None, "tool": None} for p in parents or []]
    for f in found:
        got = known.where(F.col("path") == f["path"]).orderBy(F.desc("created_utc")).select("kind", "tool").first()
        if got:
            f["kind"], f["tool"] = got
    row = spark.createDataFrame([(path, kind, tool, command or [], {k: json.dumps(_short(v), sort_keys=True) for k, v in flags.items()}, [(f["path"], f["kind"], f["tool"]) for f in found])], "path string, kind string, tool string, command array<string>, flags map<string,string>, parents array<struct<path:string,kind:string,tool:string>>")
    row.withColumn("created_utc", F.date_trunc("second", F.current_timestamp())).select("path", "kind", "tool", "created_utc", "command", "flags", "parents").write.mode("append").parquet(table)


def _short(value):
    return {"count": len(value), "first": list(value[:5])} if isinstance(value, (list, tuple)) and len(value) > 5 else value


def lineage_of(spark: SparkSession, table: str, path: str) -> DataFrame:
    """The latest record of a path, a dataset's before a training's before a tiling's."""
    rank = F.when(F.col("kind") == "dataset", 0).when(F.col("kind") == "training", 1).otherwise(2)
    w = Window.partitionBy("path").orderBy(rank, F.desc("created_utc"))
    return read_lineage(spark, table).where(F.col("path") == path).withColumn("place", F.row_number().over(w)).where("place = 1").drop("place")


def flags_match(stored: dict | None, expected: dict) -> bool:
    """Every expected flag is stored with the same value; one that is missing differs."""
    return all(stored is not None and k in stored and stored[k] == json.dumps(_short(v), sort_keys=True) for k, v in expected.items())


def write_if_changed(df: DataFrame, path: str, table: str, flags: dict, tool: str, kind: str = "dataset", force: bool = False) -> bool:
    """Write df as Parquet unless path is there with the same flags, or without any record; says whether it wrote."""
    spark = df.sparkSession
    try:
        spark.read.parquet(path)
        there = True
    except AnalysisException:
        there = False
    record = lineage_of(spark, table, path).select("flags").first()
    if there and not force and (record is None or flags_match(record["flags"], flags)):
        return False
    df.write.mode("overwrite").parquet(path)
    append_lineage(spark, table, path, kind, tool, flags)
    return True


def write_csv(rows: DataFrame, path: str, columns: list[str] | None = None) -> None:
    """Columns of rows, each once, as CSV files with a header; nulls are empty."""
    once = list(dict.fromkeys(columns or rows.columns))
    rows.select(*once).write.mode("overwrite").option("header", True).csv(path)


def kml_document(placemarks: DataFrame) -> DataFrame:
    """kml_placemarks()'s rows as one document with a folder a layer, for small layers: one string in one task."""
    folders = placemarks.groupBy("layer").agg(F.array_join(F.sort_array(F.collect_list("value")), "").alias("marks"))
    parts = F.transform(F.sort_array(F.collect_list(F.struct("layer", "marks"))), lambda f: F.concat(F.lit("<Folder><name>"), f["layer"], F.lit("</name>"), f["marks"], F.lit("</Folder>")))
    head, tail = '<?xml version="1.0" encoding="UTF-8"?><kml xmlns="http://www.opengis.net/kml/2.2"><Document>', "</Document></kml>"
    return folders.agg(F.concat(F.lit(head), F.array_join(parts, ""), F.lit(tail)).alias("value"))


def summary_json(counts: DataFrame) -> DataFrame:
    """counts (layer, label, n) as one JSON text: of each layer its total and its labels' counts. Labels are few."""
    layers = counts.groupBy("layer").agg(F.sum("n").alias("total"), F.map_from_entries(F.sort_array(F.collect_list(F.struct("label", "n")))).alias("labels"))
    return layers.agg(F.to_json(F.map_from_entries(F.sort_array(F.collect_list(F.struct("layer", F.struct("total", F.to_json("labels").alias("labels"))))))).alias("value"))


def markdown_table(rows: DataFrame, title: str, order: list) -> list[str]:
    """The lines of a report of a small table (runs, labels): numbers rounded to two places, missing ones empty."""
    show = lambda v: "" if v is None else f"{round(v, 2):g}" if isinstance(v, float) else str(v)
    body = [f"| {' | '.join(show(v) for v in r)} |" for r in rows.orderBy(*order).collect()]
    return [f"# {title}", "", f"| {' | '.join(rows.columns)} |", "|" + " --- |" * len(rows.columns), *body]


def save_labels(labels: DataFrame, path: str) -> DataFrame:
    """Write label records in order of label_id as JSON lines; returns how many there are of each label."""
    labels.orderBy("label_id").write.mode("overwrite").json(path)
    return labels.groupBy("label").agg(F.count(F.lit(1)).alias("n"))


def write_split_config(maps: DataFrame, path: str) -> None:
    """Split configs (setup and a map from year to tiles for valid, test and excluded, as from splits.split_map()) as JSON documents under path/setup=<name>; readers.read_split_config() reads them back."""
    names = ("valid", "test", "excluded")
    keyed = {n: F.map_from_entries(F.transform(F.map_entries(n), lambda e: F.struct(e["key"].cast("string").alias("key"), e["value"].alias("value")))) for n in names}
    doc = F.to_json(F.struct(F.col("setup").alias("id"), *[F.coalesce(c, F.create_map().cast("map<string,array<string>>")).alias(n) for n, c in keyed.items()]))
    maps.select("setup", doc.alias("value")).write.partitionBy("setup").mode("overwrite").text(path)
