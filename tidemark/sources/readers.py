"""Readers: COCO and detection documents, polygon layers, metrics, labels, file listings.

Every document of a directory is read in parallel. Missing means null: NaN and
infinities are turned into nulls here.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import pandas as pd
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.window import Window

from tidemark.functions.geometry import RING, finite, lonlat_to_utm, normalised_box, ring_area, usable_ring
from tidemark.operators.outlines import repaired
from tidemark.sources.manifest import class_of, tile_key

COCO = """images array<struct<id:bigint,width:int,height:int,file_name:string>>,
annotations array<struct<id:bigint,image_id:bigint,category_id:int,segmentation:array<array<double>>,area:double,bbox:array<double>,iscrowd:int,score:string,attributes:map<string,string>>>,
categories array<struct<id:int,name:string,supercategory:string>>"""
DETECTION = "struct<image_id:bigint,category_id:int,class_id:int,class_name:string,bbox:array<double>,bbox_xyxy:array<double>,bbox_format:string,source:string,score:string,segmentation:array<array<double>>>"


def file_stem(c: Column) -> Column:
    return F.regexp_replace(F.substring_index(c, "/", -1), r"\.[^.]*$", "")


def read_coco(spark: SparkSession, path: str) -> dict[str, DataFrame]:
    """images, annotations and categories of every COCO document at path, each with its file; scores become numbers."""
    docs = spark.read.schema(COCO).option("multiLine", True).json(path).withColumn("file", F.col("_metadata.file_path"))
    parts = {n: docs.select("file", F.explode(n).alias("x")).select("file", "x.*") for n in ("images", "annotations", "categories")}
    parts["annotations"] = parts["annotations"].withColumn("score", finite(F.expr("try_cast(score AS DOUBLE)")))
    return parts


def read_detections(spark: SparkSession, path: str) -> DataFrame:
    """Detections of summary documents, COCO documents and COCO lists at path: stem, category_id, x1..y2, score.

    A summary's boxes are corners, its class ids start at 0 and its scores
    default to 1. A COCO file of an image beats its summary. Boxes that cannot
    be read are dropped.
    """
    raw = spark.read.text(path, wholetext=True).select("value", F.col("_metadata.file_path").alias("file"))
    name = F.substring_index("file", "/", -1)
    summary = name.endswith("_inference_summary.json")
    is_list = F.ltrim("value").startswith("[")
    listed = F.from_json("value", f"array<{DETECTION}>")
    doc = F.from_json("value", f"struct<annotations:array<{DETECTION}>,detections:array<{DETECTION}>,instances:array<{DETECTION}>>")
    dets = F.when(is_list, listed).otherwise(F.coalesce(doc["annotations"], doc["detections"], doc["instances"]))
    stem = F.regexp_replace(F.regexp_replace(name, r"_inference_summary\.json$", ""), r"(_coco)?\.json$", "")
    files = raw.select(stem.alias("stem"), summary.alias("summary"), dets.alias("ds"))
    best = files.withColumn("place", F.row_number().over(Window.partitionBy("stem").orderBy("summary"))).where("place = 1")
    rows = best.select("stem", "summary", F.explode("ds").alias("d"))
    given = F.when(F.col("summary"), F.struct(F.coalesce(F.col("d.bbox_xyxy"), F.col("d.bbox")).alias("bbox_xyxy"), F.col("d.bbox").alias("bbox"), F.col("d.bbox_format").alias("bbox_format"), F.col("d.source").alias("source"))).otherwise(F.struct("d.bbox_xyxy", "d.bbox", "d.bbox_format", "d.source"))
    box = normalised_box(given)
    score = F.coalesce(finite(F.expr("try_cast(d.score AS DOUBLE)")), F.when(F.col("summary"), 1.0))
    category = F.when(F.col("summary"), F.coalesce(F.col("d.class_id"), F.lit(0)) + 1).otherwise(F.col("d.category_id"))
    out = rows.select("stem", category.alias("category_id"), box.alias("b"), score.alias("score"))
    return out.select("stem", "category_id", "b.x1", "b.y1", "b.x2", "b.y2", "score").where("x2 IS NOT NULL AND y2 IS NOT NULL")


def with_predictions(images: DataFrame, detections: DataFrame) -> DataFrame:
    """images (image_id, file_name) with their detections; images without any keep one row of nulls.

    An image's detections are those of the stem that equals its name without
    suffix, else of one that ends with it or with which it ends, else of one that ends
    with it without its year in front; of several the longest, then the first by name.
    """
    i = images.select("image_id", file_stem(F.col("file_name")).alias("s"))
    stems = detections.select("stem").distinct()
    tails = lambda c: F.explode(F.transform(F.sequence(F.lit(1), F.greatest(F.length(c), F.lit(1))), lambda k: F.substring(F.col(c), k, F.length(c))))
    ends = stems.withColumn("t", tails("stem"))
    bare = i.select("image_id", F.regexp_extract("s", r"^2[45]_(.+)$", 1).alias("t")).where("t <> ''")
    pairs = (
        i.withColumn("t", tails("s")).join(stems, F.col("t") == F.col("stem")).select("image_id", "stem", F.when(F.col("s") == F.col("stem"), 0).otherwise(1).alias("rank"))
        .union(ends.join(i, F.col("t") == F.col("s")).select("image_id", "stem", F.lit(1)))
        .union(ends.join(bare, "t").select("image_id", "stem", F.lit(2)))
    )
    use = pairs.groupBy("image_id").agg(F.min_by("stem", F.struct("rank", (-F.length("stem")).alias("size"), "stem")).alias("use"))
    found = detections.withColumnRenamed("stem", "use")
    return i.select("image_id").join(use, "image_id", "left").join(found, "use", "left").drop("use")


def existing(wanted: DataFrame, listing: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(kept, missing) of wanted (file_name) by a listing of paths (path), year prefixes optional; the first directory wins."""
    names = listing.select(F.substring_index("path", "/", -1).alias("name"), "path").groupBy("name").agg(F.min("path").alias("path"))
    bare = F.regexp_replace("file_name", r"^2[45]_", "")
    n2 = names.select(F.col("name").alias("name2"), F.col("path").alias("path2"))
    found = wanted.join(names, wanted.file_name == names.name, "left").withColumn("bare", bare).join(n2, F.col("bare") == F.col("name2"), "left")
    found = found.withColumn("path", F.coalesce("path", "path2")).select(*wanted.columns, "path")
    return found.where("path IS NOT NULL"), found.where("path IS NULL").drop("path")


def list_files(spark: SparkSession, path: str, glob: str = "*") -> DataFrame:
    """path, length and modification time of the files under path; their content is not read."""
    return spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", glob).load(path).select("path", "length", "modificationTime")


def resolve_tiles(tiles: DataFrame, listing: DataFrame, how: str = "left") -> DataFrame:
    """tiles (year, tile_row, tile_col) with the path of their file: one that names the year before one that does not."""
    f = listing.withColumn("k", tile_key(F.col("path"))).select("path", F.col("k.year").alias("f_year"), F.col("k.tile_row").alias("f_row"), F.col("k.tile_col").alias("f_col")).where("f_row IS NOT NULL")
    pairs = tiles.join(f, (tiles.tile_row == f.f_row) & (tiles.tile_col == f.f_col) & (f.f_year.isNull() | (f.f_year == tiles.year)), how)
    rank = F.row_number().over(Window.partitionBy("year", "tile_row", "tile_col").orderBy(F.col("f_year").isNull(), "path"))
    return pairs.withColumn("rank", rank).where("rank = 1").select(*tiles.columns, "path")


def read_geojson(spark: SparkSession, path: str) -> DataFrame:
    """Features of the collections at path: file, feature_no, properties, part_no, ring (outer rings; holes are dropped).

    Polygons inside geometry collections, one level deep, are parts like those of multipolygons. A path without a file is a layer without rows.
    """
    schema = "features array<struct<properties:map<string,string>,geometry:string>>"
    try:
        docs = spark.read.schema(schema).option("multiLine", True).json(path).withColumn("file", F.col("_metadata.file_path"))
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], f"file string, feature_no int, properties map<string,string>, part_no int, ring {RING}")
    feats = docs.select("file", F.posexplode("features").alias("feature_no", "f")).select("file", "feature_no", "f.properties", "f.geometry")

    def outer(geometry: Column) -> Column:
        kind, text = F.get_json_object(geometry, "$.type"), F.get_json_object(geometry, "$.coordinates")
        one, many = F.from_json(text, "array<array<array<double>>>"), F.from_json(text, "array<array<array<array<double>>>>")
        return F.when(kind == "Polygon", F.array(one[0])).when(kind == "MultiPolygon", F.transform(many, lambda p: p[0])).otherwise(F.array().cast("array<array<array<double>>>"))

    members = F.from_json(F.get_json_object("geometry", "$.geometries"), "array<string>")
    several = feats.select("file", "feature_no", "properties", F.explode(F.when(members.isNotNull(), members).otherwise(F.array("geometry"))).alias("g")).select("file", "feature_no", "properties", outer(F.col("g")).alias("rings"))
    rings = several.groupBy("file", "feature_no").agg(F.first("properties").alias("properties"), F.flatten(F.collect_list("rings")).alias("rings"))
    parts = rings.select("file", "feature_no", "properties", F.posexplode("rings").alias("part_no", "flat"))
    return parts.select("file", "feature_no", "properties", "part_no", F.transform("flat", lambda p: F.struct(p[0].alias("x"), p[1].alias("y"))).cast(RING).alias("ring"))


def clean_layer(layer: DataFrame, repair: bool = False, year: int | None = None) -> tuple[DataFrame, DataFrame]:
    """(usable rows, counts of those dropped or mended by reason): rings without three points or without area go.

    repair: a ring that crosses itself gives way to its simple parts (a row each, reason crossing); without it such rings stay. year: a column year with
    it for every row.
    """
    reason = F.when(F.col("ring").isNull(), "null").when(F.size("ring") == 0, "empty").when(~usable_ring(F.col("ring")), "invalid")
    marked = layer.withColumn("reason", reason)
    if repair:
        # a ring that crosses itself may have turns that cancel out: no area by the shoelace, but parts
        mended = repaired(layer.withColumn("row_struct", F.struct(*layer.columns)), ["row_struct"])
        why = F.when(F.col("problem") == "missing", "null").when(F.size("row_struct.ring") == 0, "empty").when(F.col("part").isNull(), "invalid").when(F.col("problem") == "crossing", "crossing")
        marked = mended.withColumn("reason", why).select(*[F.col("ring") if c == "ring" else F.col(f"row_struct.{c}").alias(c) for c in layer.columns], "reason", F.coalesce("part", F.lit(0)).alias("clean_part"))
        counts = marked.where("reason IS NOT NULL AND clean_part = 0").groupBy("reason").agg(F.count(F.lit(1)).alias("n"))
        kept = marked.where("reason IS NULL OR reason = 'crossing'").drop("reason", "clean_part")
    else:
        counts = marked.where("reason IS NOT NULL").groupBy("reason").agg(F.count(F.lit(1)).alias("n"))
        kept = marked.where("reason IS NULL").drop("reason")
    return (kept if year is None else kept.withColumn("year", F.lit(year))), counts


#: Codes of systems in degrees whose datum is that of the working system, to what a map needs.
DEGREES = (4326, 4258)
WORKING = 25829


def reprojected(layer: DataFrame, srid: int | None) -> DataFrame:
    """layer with its ring in the working system (UTM zone 29 north): rings in degrees (longitude first) are projected, those of the system itself or of none stay."""
    if srid is None or srid == WORKING:
        return layer
    if srid not in DEGREES:
        raise ValueError(f"reference system {srid} is not known")
    return layer.withColumn("ring", F.transform("ring", lambda p: lonlat_to_utm(p["x"], p["y"])))


def read_annotations(spark: SparkSession, path: str, class_field: str, year: int | None = None, srid: int | None = None, layer: str = "") -> tuple[DataFrame, DataFrame]:
    """(annotations, counts by reason): a layer's outlines, mended and in the working system, with class (0 boulder, 1 deposit), year (null: any) and the feature's file and number.

    Reasons: null, empty, invalid (left out), crossing (mended), unknown_class (taken as 0).
    """
    raw = read_gpkg(spark, path, layer).withColumnRenamed("fid", "feature_no") if path.lower().endswith(".gpkg") else read_geojson(spark, path)
    kept, counts = clean_layer(reprojected(raw, srid), repair=True)
    kind = F.col("properties")[class_field]
    unknown = raw.where(kind.isNull()).select("file", "feature_no").distinct().agg(F.count(F.lit(1)).alias("n")).select(F.lit("unknown_class").alias("reason"), "n").where("n > 0")
    return kept.withColumns({"class": class_of(kind), "year": F.lit(year).cast("int")}), counts.union(unknown)


def read_manual(spark: SparkSession, path: str, srid: int | None = None) -> DataFrame:
    """Manual annotations: ann_fid, properties, part_no, ring (mended, in the working system). ann_fid is a GeoPackage's row id, else the feature's place in its file from 1 on; rows without an outline are left out."""
    if path.lower().endswith(".gpkg"):
        raw = read_gpkg(spark, path).withColumnRenamed("fid", "ann_fid")
    else:
        raw = read_geojson(spark, path).withColumn("ann_fid", (F.col("feature_no") + 1).cast("long"))
    return clean_layer(reprojected(raw, srid), repair=True)[0].select("ann_fid", "properties", "part_no", "ring")


def read_regions(spark: SparkSession, paths: list[str]) -> DataFrame:
    """The outlines of a region of interest that lies in any number of GeoJSON and GeoPackage files: path, ring (simple, repaired). None at all is an error."""
    layers = []
    for path in paths:
        layer = read_gpkg(spark, path) if path.lower().endswith(".gpkg") else read_geojson(spark, path)
        layers.append(layer.select(F.lit(path).alias("path"), "ring"))
    if not layers or (region := clean_layer(reduce(DataFrame.unionByName, layers), repair=True)[0]).isEmpty():
        raise ValueError(f"no outlines in {paths}")
    return region


def largest_part(layer: DataFrame, key: list[str]) -> DataFrame:
    """Of each feature (key) its part of the largest area, the first of equal ones; columns as given."""
    by = F.row_number().over(Window.partitionBy(*key).orderBy(F.desc(ring_area(F.col("ring"))), "part_no"))
    return layer.withColumn("largest_place", by).where("largest_place = 1").drop("largest_place")


class GpkgSource(DataSource):
    """GeoPackage layers: option path names one file or several, comma-separated, one task each; option layer a table.

    Files are opened where the task runs, so they must be on storage that every executor mounts.
    """

    @classmethod
    def name(cls) -> str:
        return "gpkg"

    def schema(self) -> str:
        return "file string, fid long, properties map<string,string>, geometry binary"

    def reader(self, schema) -> DataSourceReader:
        return GpkgReader(self.options)


class GpkgReader(DataSourceReader):
    def __init__(self, options):
        self.options = dict(options)

    def partitions(self):
        return [InputPartition(p) for p in self.options["path"].split(",")]

    def read(self, partition) -> Iterator[tuple]:
        import sqlite3

        base = sqlite3.connect(f"file:{partition.value}?mode=ro", uri=True)
        try:
            layer = self.options.get("layer") or base.execute("SELECT table_name FROM gpkg_contents WHERE data_type = 'features' ORDER BY table_name").fetchone()[0]
            (column,) = base.execute("SELECT column_name FROM gpkg_geometry_columns WHERE table_name = ?", (layer,)).fetchone()
            rows = base.execute('SELECT rowid AS "_fid_", * FROM "{}"'.format(layer.replace('"', '""')))
            names = [d[0] for d in rows.description]
            for row in rows:
                got = dict(zip(names, row))
                geometry = got.pop(column)
                fid = got.pop("_fid_")
                yield partition.value, fid, {k: str(v) for k, v in got.items() if v is not None}, wkb_of(geometry)
        finally:
            base.close()


def wkb_of(blob: bytes | None) -> bytes | None:
    """The WKB in a GeoPackage geometry: behind eight bytes and an envelope of a length its flags give."""
    if not blob or blob[:2] != b"GP":
        return blob
    return blob[8 + (0, 32, 48, 48, 64)[(blob[3] >> 1) & 7] :]


def wkb_rings(wkb: bytes | None) -> list[list[tuple[float, float]]]:
    """Outer rings of a polygon, multipolygon or collection in WKB; other kinds give none."""
    import struct

    def read(at: int) -> tuple[list, int]:
        order = "<" if wkb[at] else ">"
        (kind,) = struct.unpack_from(order + "I", wkb, at + 1)
        at += 5
        if kind & 0x20000000:
            at += 4
        dims = 2 + bool(kind & 0x80000000) + bool(kind & 0x40000000) + {0: 0, 1: 1, 2: 1, 3: 2}[(kind & 0xFFFF) // 1000]
        kind = (kind & 0xFFFF) % 1000
        if kind == 3:
            (n,) = struct.unpack_from(order + "I", wkb, at)
            at += 4
            outer: list = []
            for k in range(n):
                (m,) = struct.unpack_from(order + "I", wkb, at)
                flat = struct.unpack_from(f"{order}{m * dims}d", wkb, at + 4)
                at += 4 + 8 * m * dims
                if k == 0:
                    outer = [(flat[i * dims], flat[i * dims + 1]) for i in range(m)]
            return [outer] if outer else [], at
        if kind in (6, 7):
            (n,) = struct.unpack_from(order + "I", wkb, at)
            at, out = at + 4, []
            for _ in range(n):
                more, at = read(at)
                out += more
            return out, at
        raise ValueError("not a polygon")

    if not wkb:
        return []
    try:
        return read(0)[0]
    except (ValueError, KeyError, struct.error, IndexError):
        return []


def read_gpkg(spark: SparkSession, path: str, layer: str = "") -> DataFrame:
    """A layer's polygons: file, fid, properties, part_no, ring; unreadable geometry has a null ring."""
    spark.dataSource.register(GpkgSource)
    raw = spark.read.format("gpkg").option("path", path).option("layer", layer).load()

    @F.pandas_udf(f"array<{RING}>")
    def rings(geometry: pd.Series) -> pd.Series:
        return geometry.map(lambda g: [[{"x": x, "y": y} for x, y in r] for r in wkb_rings(bytes(g) if g else None)])

    return raw.select("file", "fid", "properties", F.posexplode_outer(rings("geometry")).alias("part_no", "ring"))


def read_split_config(spark: SparkSession, path: str) -> DataFrame:
    """JSON split configs at path, one row per tile: setup, leakage_check, split, year, tile (tile_row, tile_col)."""
    schema = "id string, description string, leakage_check string, valid map<string,array<string>>, test map<string,array<string>>, excluded map<string,array<string>>"
    docs = spark.read.schema(schema).option("multiLine", True).json(path)
    setup = F.coalesce("id", file_stem(F.col("_metadata.file_path")))
    wide = docs.select(setup.alias("setup"), F.coalesce("leakage_check", F.lit("geographic")).alias("leakage_check"), "valid", "test", "excluded")
    long = wide.select("setup", "leakage_check", F.explode(F.array(*[F.struct(F.lit(s).alias("split"), F.col(s).alias("m")) for s in ("valid", "test", "excluded")])).alias("s")).select("setup", "leakage_check", "s.split", F.explode("s.m").alias("y", "tiles"))
    year = F.col("y").cast("int") % 100
    tiles = long.select("setup", "leakage_check", "split", year.alias("year"), F.explode("tiles").alias("name")).withColumn("k", tile_key(F.col("name")))
    return tiles.where("k IS NOT NULL").select("setup", "leakage_check", "split", "year", F.col("k.tile_row").alias("tile_row"), F.col("k.tile_col").alias("tile_col"))


def read_metrics(spark: SparkSession, path: str, prefix: str = "") -> DataFrame:
    """Final metrics documents: run, metric (bbox/... or segm/...), value; other blocks and non-finite values are left out.

    The run is the name of the document's folder without prefix; folders of other names are left out.
    """
    docs = spark.read.schema("bbox map<string,double>, segm map<string,double>").option("multiLine", True).json(path).withColumn("file", F.col("_metadata.file_path"))
    run = F.substring(F.element_at(F.split("file", "/"), -2), F.lit(len(prefix) + 1), F.length("file"))
    docs = docs.where(F.element_at(F.split("file", "/"), -2).startswith(prefix))
    blocks = F.explode(F.array(*[F.struct(F.lit(b).alias("block"), F.coalesce(F.col(b), F.create_map().cast("map<string,double>")).alias("m")) for b in ("bbox", "segm")]))
    rows = docs.select(run.alias("run"), blocks.alias("b")).select("run", "b.block", F.explode("b.m").alias("key", "value"))
    return rows.select("run", F.concat_ws("/", "block", "key").alias("metric"), finite(F.col("value")).alias("value")).where("value IS NOT NULL")


def parse_metric_lines(lines: DataFrame) -> DataFrame:
    """Lines (run, value) of metric logs to run, iteration, metric, value; blank and broken lines give nothing.

    Works on a stream of lines as well. An event without an iteration has -1.
    """
    m = F.from_json("value", "map<string,string>")
    events = lines.select("run", m.alias("m")).where("m IS NOT NULL")
    it = F.coalesce(F.expr("try_cast(m['iteration'] AS BIGINT)"), F.lit(-1).cast("long"))
    rows = events.select("run", it.alias("iteration"), F.explode("m").alias("metric", "text")).where("metric LIKE 'bbox/%' OR metric LIKE 'segm/%'")
    return rows.select("run", "iteration", "metric", finite(F.expr("try_cast(text AS DOUBLE)")).alias("value")).where("value IS NOT NULL")


def read_metric_log(spark: SparkSession, path: str) -> DataFrame:
    lines = spark.read.text(path).select(F.element_at(F.split(F.col("_metadata.file_path"), "/"), -2).alias("run"), "value")
    return parse_metric_lines(lines)


LABEL = "struct<label_id:string,before_id:bigint,after_id:bigint,label:string,note:string,labeled_at:string>"


def read_labels(spark: SparkSession, path: str) -> DataFrame:
    """Label records of documents that are a list, or hold one under labels; without label_id none; the latest of an id wins."""
    raw = spark.read.text(path, wholetext=True).select("value", F.col("_metadata.file_path").alias("file"))
    listed = F.when(F.ltrim("value").startswith("["), F.from_json("value", f"array<{LABEL}>")).otherwise(F.from_json("value", f"struct<labels:array<{LABEL}>>")["labels"])
    rows = raw.select("file", F.posexplode(listed).alias("place", "x")).select("file", "place", "x.*").where("label_id IS NOT NULL")
    last = F.row_number().over(Window.partitionBy("label_id").orderBy(F.desc_nulls_last("labeled_at"), F.desc("file"), F.desc("place")))
    return rows.withColumn("last", last).where("last = 1").drop("last", "file", "place")
