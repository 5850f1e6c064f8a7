"""Small joins and summaries around the main operators."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidemark.functions.geometry import closed, finite, ring_area, ring_box, ring_centroid
from tidemark.operators.spatial import BOX, box_pairs


def without_categories(annotations: DataFrame, categories: DataFrame, names: list[str]) -> DataFrame:
    """annotations whose category_id is not one of the named categories (id, name)."""
    out = categories.where(F.col("name").isin(names)).select(F.col("id").alias("category_id"))
    return annotations.join(out, "category_id", "left_anti")


def first_containing(points: DataFrame, tiles: DataFrame) -> DataFrame:
    """points (point_id, px, py) with the tile_id of the first tile (tile_id, place, box) in list order that contains them, else the first of all."""
    dots = points.select("point_id", *[F.col(c).alias("l" + b) for b, c in zip(BOX, ("px", "py", "px", "py"))])
    boxes = tiles.select("tile_id", "place", *[F.col(c).alias("r" + c) for c in BOX])
    hit = box_pairs(dots, boxes, 64.0).groupBy("point_id").agg(F.min_by("tile_id", "place").alias("hit"))
    first = tiles.agg(F.min_by("tile_id", "place").alias("first"))  # one row
    return points.join(hit, "point_id", "left").join(F.broadcast(first)).withColumn("tile_id", F.coalesce("hit", "first")).drop("hit", "first")


def union_bounds(*layers: DataFrame) -> DataFrame:
    """One row x1..y2 around all boxes of the layers; nulls if there are none."""
    every = layers[0].select(*BOX)
    for other in layers[1:]:
        every = every.union(other.select(*BOX))
    return every.agg(F.min("x1").alias("x1"), F.min("y1").alias("y1"), F.max("x2").alias("x2"), F.max("y2").alias("y2"))


def run_summary(counts: dict[str, DataFrame]) -> DataFrame:
    """stage, n: how many rows each named stage of a run has."""
    rows = [df.agg(F.count(F.lit(1)).alias("n")).select(F.lit(name).alias("stage"), "n") for name, df in counts.items()]
    out = rows[0]
    for r in rows[1:]:
        out = out.union(r)
    return out


def pair_key(before_id: Column, after_id: Column) -> Column:
    """b<before>_a<after>, the key of a label record."""
    return F.format_string("b%d_a%d", before_id, after_id)


def extent_text(x1: Column, y1: Column, x2: Column, y2: Column, pad: float = 5.0) -> Column:
    """Padded extent as text, three decimals."""
    return F.format_string("%.3f,%.3f,%.3f,%.3f", x1 - pad, y1 - pad, x2 + pad, y2 + pad)


def outline_record(ring: Column, crs: str = "EPSG:25829") -> Column:
    """An outline as a record: centroid_x, centroid_y, bbox, area_m2, wkt, crs; null for a null or empty one."""
    b, c = ring_box(ring), ring_centroid(ring)
    text = F.array_join(F.transform(closed(ring), lambda p: F.concat_ws(" ", p["x"].cast("string"), p["y"].cast("string"))), ", ")
    record = F.struct(c["x"].alias("centroid_x"), c["y"].alias("centroid_y"), F.array(*[b[n] for n in BOX]).alias("bbox"), ring_area(ring).alias("area_m2"), F.concat(F.lit("POLYGON (("), text, F.lit("))")).alias("wkt"), F.lit(crs).alias("crs"))
    return F.when(F.size(ring) > 0, record)


def pair_records(matches: DataFrame, before: DataFrame, after: DataFrame, hits: dict[str, DataFrame], labels: DataFrame | None = None) -> DataFrame:
    """A review record for each match: key, ids, its numbers (NaN as null), both outlines, the box around them, its extent as text, manual hits, label.

    matches has before_id, after_id and any numbers; before (before_id, ring), after (after_id, ring); hits: for each name a table as from
    matching.hits_by_outline() of the objects before (before_id) or after (after_id); labels (label_id, label, note, labeled_at), of which labeled_at is kept with a label only.
    """
    numbers = [c for c, t in matches.dtypes if c not in ("before_id", "after_id") and t in ("double", "float", "int", "bigint")]
    rows = matches.select("before_id", "after_id", pair_key(F.col("before_id"), F.col("after_id")).alias("match_key"), *[finite(F.col(c)).alias(c) for c in numbers])
    rows = rows.join(before.select("before_id", F.col("ring").alias("before_ring")), "before_id", "left").join(after.select("after_id", F.col("ring").alias("after_ring")), "after_id", "left")
    both = F.concat(F.coalesce("before_ring", F.slice("after_ring", 1, 0)), F.coalesce("after_ring", F.slice("before_ring", 1, 0)))
    around = F.when(F.size(both) > 0, ring_box(both))
    rows = rows.withColumn("pair_box", around).withColumns({"before": outline_record(F.col("before_ring")), "after": outline_record(F.col("after_ring")), "extent": F.concat(extent_text(*[F.col(f"pair_box.{c}") for c in BOX]), F.lit(" [EPSG:25829]"))})
    for name, table in hits.items():
        key = "before_id" if "before_id" in table.columns else "after_id"
        found = table.select(key, F.struct((F.size("fids") > 0).alias("intersects"), "fids", "best_fid", F.round("best_iou", 4).alias("best_iou")).alias(name))
        rows = rows.join(found, key, "left")
    if labels is not None:
        said = labels.select(F.col("label_id").alias("match_key"), "label", F.coalesce("note", F.lit("")).alias("note"), F.when(F.col("label").isNotNull(), F.col("labeled_at")).alias("labeled_at"))
        rows = rows.join(said, "match_key", "left")
    return rows.drop("before_ring", "after_ring")


def metrics_on_extents(extents: DataFrame, rows: DataFrame, metrics: list[str], order: list[Column], key: str = "year_key") -> DataFrame:
    """Tile extents with their row's metrics, gt_count and pred_count; the last row of a key in order wins, values that are no finite numbers are null, extents without a row stay."""
    last = latest(rows.where(F.col(key).isNotNull()), [key], [o.desc() for o in order])
    return extents.join(last.select(key, *[finite(F.col(m)).alias(m) for m in metrics], "gt_count", "pred_count"), key, "left")


def split_by_elevation(objects: DataFrame, volumes: DataFrame, key: list[str]) -> tuple[DataFrame, DataFrame]:
    """(accepted, rejected) objects by is_boulder of raster.cubic_base_volumes(): joined by their ids, never by position; without a volume row an object is rejected."""
    marked = objects.join(volumes.select(*key, "is_boulder"), key, "left")
    yes = F.coalesce(F.col("is_boulder") == 1, F.lit(False))
    return marked.where(yes).drop("is_boulder"), marked.where(~yes).drop("is_boulder")


def stacked(bands: DataFrame, names: list[str], key: list[str]) -> DataFrame:
    """Chunks (key, band, vals) to one row per key with each named band; an incomplete key raises when it is read."""
    wide = bands.groupBy(*key).pivot("band", names).agg(F.first("vals"))
    lacking = F.greatest(*[F.col(n).isNull() for n in names])
    check = F.when(lacking, F.raise_error(F.concat_ws(" ", F.lit("a band is missing of"), *[F.col(k).cast("string") for k in key])).cast("boolean")).otherwise(F.lit(True))
    return wide.where(check)


def next_item(items: DataFrame, start: int, total: int) -> DataFrame:
    """The first open item (pos) at or after start, round the end."""
    return items.orderBy(F.pmod(F.col("pos") - start, F.lit(total)), "pos").limit(1)


def latest(rows: DataFrame, key: list[str], order: list[Column]) -> DataFrame:
    """The last row of each key in an order; for metrics joined to tile extents, where later rows win."""
    w = Window.partitionBy(*key).orderBy(*order)
    return rows.withColumn("place_", F.row_number().over(w)).where("place_ = 1").drop("place_")
