"""Small steps between layers: tiles to a whole picture, outlines to annotations, regions, counts, orders."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidemark.functions.geometry import finite, point, ring_area, ring_box, world_to_ratio
from tidemark.operators.outlines import clip_to_regions
from tidemark.operators.spatial import distance_pairs
from tidemark.storage import stored

#: Ids in one cell of nearest()'s first round.
CROWD = 1024
#: Orders of an output by name; ties by id.
ORDERS = {
    "large2small": ("area", False),
    "small2large": ("area", True),
    "north2south": ("cy", True),
    "south2north": ("cy", False),
    "west2east": ("cx", True),
    "east2west": ("cx", False),
}


def output_order(name: str, key: str) -> list[Column]:
    """Sort columns of a named order over area, cx, cy and the key; an unknown name leaves only the key."""
    if name not in ORDERS:
        return [F.col(key)]
    column, up = ORDERS[name]
    return [F.col(column).asc() if up else F.col(column).desc(), F.col(key)]


def tiles_to_whole(annotations: DataFrame, images: DataFrame) -> DataFrame:
    """Annotations of tiles (image_id, ring, x, y) in pixels of the whole picture they were cut from, all of image 1.

    Row and column, from 1, are the second and third part of the tile's file
    name between underscores and dots; a tile begins 1 + (row - 1) * height
    down and 1 + (column - 1) * width to the right. A name without them gives
    nulls; annotations without an image are left out.
    """
    part = lambda k: F.get(F.split("file_name", "[_.]"), F.lit(k)).try_cast("double")
    at = images.select("image_id", (1 + (part(1) - 1) * F.col("height")).alias("dy"), (1 + (part(2) - 1) * F.col("width")).alias("dx"))
    moved = annotations.join(at, "image_id")
    ring = F.transform("ring", lambda p: point(p["x"] + F.col("dx"), p["y"] + F.col("dy")))
    return moved.withColumns({"ring": ring, "x": F.col("x") + F.col("dx"), "y": F.col("y") + F.col("dy"), "image_id": F.lit(1).cast("long")}).select(*annotations.columns)


def outlines_to_annotations(layer: DataFrame, bounds: tuple[float, float, float, float], width: int, height: int) -> DataFrame:
    """layer (ann_id, category_id, ring in the world) as annotations of one picture with these bounds.

    Rings are in pixels, from 1, rows downwards; area is rounded, and without
    area there is no ring. The box stays in the world, rounded: x, y, w, h.
    Every outline keeps its own category, and the picture has one row.
    """
    ends = tuple(F.lit(float(b)) for b in bounds)
    shown = F.transform("ring", lambda p: world_to_ratio(p["x"], p["y"], ends, F.lit(float(width)), F.lit(float(height))))
    a = layer.withColumns({"box": ring_box(F.col("ring")), "shown": shown}).withColumn("area", F.round(ring_area(F.col("shown"))))
    box = {"x": F.col("box.x1"), "y": F.col("box.y1"), "w": F.col("box.x2") - F.col("box.x1"), "h": F.col("box.y2") - F.col("box.y1")}
    empty = F.slice("shown", 1, 0)
    return a.select("ann_id", F.lit(1).cast("long").alias("image_id"), "category_id", F.when(F.col("area") == 0, empty).otherwise(F.col("shown")).alias("ring"), "area", *[F.round(v).alias(n) for n, v in box.items()], F.lit(0).alias("iscrowd"))


def inside_region(objects: DataFrame, region: DataFrame, size: float) -> DataFrame:
    """objects (id, ring) with inside_area, the part of their area in a region's outlines (ring); those without any are left out.

    The region's parts may overlap one another. An empty region is an error: it would drop every object.
    """
    if region.isEmpty():
        raise ValueError("the region has no outlines")
    parts = clip_to_regions(objects.select(F.col("id").alias("object_id"), "ring"), region, size)
    return objects.join(parts.groupBy(F.col("object_id").alias("id")).agg(F.sum("area").alias("inside_area")), "id")


def nearest_pairs(objects: DataFrame, radius: float, k: int = 30) -> DataFrame:
    """Each object's k nearest others within radius (id, other, distance, place), ties by id: a cut of candidates.

    The radius bounds what an object meets; overlaps are found whole without this cut. nearest() needs no radius.
    """
    left = objects.select(F.col("id"), F.col("cx").alias("lx"), F.col("cy").alias("ly"))
    right = objects.select(F.col("id").alias("other"), F.col("cx").alias("rx"), F.col("cy").alias("ry"))
    near = distance_pairs(left, right, radius).where("id <> other").select("id", "other", F.col("dist").alias("distance"))
    place = F.row_number().over(Window.partitionBy("id").orderBy("distance", "other")).cast("long")
    return near.withColumn("place", place).where(F.col("place") <= k)


def nearest(objects: DataFrame, k: int = 30) -> DataFrame:
    """Each object's k nearest others, however far (id, other, distance, place), ties by id; all others if there are fewer.

    Objects (id, cx, cy) at one place are one site with its smallest ids, so piles do not multiply. Sites search in rings
    that double from round to round, starting where an id shares its cell with a few in the mean and no cell holds more than CROWD; a site is done
    when its ring holds enough ids, and all are when the ring spans the layer. Null or infinite places pair with nothing.
    """
    dots = objects.select("id", finite(F.col("cx")).alias("cx"), finite(F.col("cy")).alias("cy")).where("cx IS NOT NULL AND cy IS NOT NULL")
    few = dots.withColumn("at", F.row_number().over(Window.partitionBy("cx", "cy").orderBy("id"))).where(F.col("at") <= k + 1)
    sites = stored(few.groupBy("cx", "cy").agg(F.array_sort(F.collect_list("id")).alias("ids")).withColumn("site", F.col("ids")[0]))
    span = sites.agg(F.max("cx") - F.min("cx"), F.max("cy") - F.min("cy"), F.count(F.lit(1)), F.sum(F.size("ids"))).first()
    width = max(span[0] or 0.0, span[1] or 0.0)
    size = width or 1.0
    while size > width * 2.0**-40:
        cells = sites.groupBy(F.floor(F.col("cx") / size), F.floor(F.col("cy") / size)).agg(F.sum(F.size("ids")).alias("n"))
        crowd, met = cells.agg(F.max("n"), F.sum(F.col("n") * F.col("n"))).first()
        if not crowd or crowd <= max(CROWD, k + 1) and met <= 4 * (k + 1) * span[3]:
            break
        size /= 2
    open_sites, found = sites.select("site", "cx", "cy"), []
    while True:
        cell = lambda c: F.floor(F.col(c) / size)  # noqa: E731, B023
        around = F.explode(F.array(*[F.struct((cell("cx") + dx).alias("gx"), (cell("cy") + dy).alias("gy")) for dx in (-1, 0, 1) for dy in (-1, 0, 1)]))
        asks = open_sites.withColumn("g", around).select("site", "cx", "cy", "g.gx", "g.gy")
        there = sites.select(F.col("cx").alias("ox"), F.col("cy").alias("oy"), "ids", cell("cx").alias("gx"), cell("cy").alias("gy"))
        distance = F.sqrt((F.col("ox") - F.col("cx")) * (F.col("ox") - F.col("cx")) + (F.col("oy") - F.col("cy")) * (F.col("oy") - F.col("cy")))
        met = asks.join(there.hint("merge"), ["gx", "gy"]).select("site", distance.alias("distance"), F.explode("ids").alias("other"))
        last = size > width
        near = met if last else met.where(F.col("distance") <= size)
        place = F.row_number().over(Window.partitionBy("site").orderBy("distance", "other"))
        got = stored(near.withColumn("place", place).where(F.col("place") <= k + 1))
        if last:
            found.append(got)
            break
        done = got.groupBy("site").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > k).select("site")
        found.append(got.join(done.hint("merge"), "site", "left_semi"))
        open_sites = stored(open_sites.join(done.hint("merge"), "site", "left_anti"))
        if open_sites.isEmpty():
            break
        size *= 2
    lists = reduce(DataFrame.unionByName, found).select("site", "distance", "other")
    own = dots.join(sites.select("cx", "cy", "site").hint("merge"), ["cx", "cy"]).select("id", "site").join(lists.hint("merge"), "site").where("id <> other")
    place = F.row_number().over(Window.partitionBy("id").orderBy("distance", "other")).cast("long")
    return own.withColumn("place", place).where(F.col("place") <= k).select("id", "other", "distance", "place")


def column_means(rows: DataFrame, columns: list[str], group: list[str] | None = None) -> DataFrame:
    """Means of columns over rows (per group); nulls are skipped."""
    return rows.groupBy(*(group or [])).agg(*[F.avg(c).alias(c) for c in columns])


def class_list(annotations: DataFrame) -> DataFrame:
    """Distinct categories (category_id, name) in order of their ids."""
    return annotations.select("category_id", "name").where("category_id IS NOT NULL").distinct().orderBy("category_id", "name")


def segment_counts(rows: DataFrame, columns: list[str]) -> DataFrame:
    """How many rows each combination of columns has."""
    return rows.groupBy(*columns).agg(F.count(F.lit(1)).alias("n"))


def first_windows(windows: DataFrame, n: int) -> DataFrame:
    """The first n windows of each image, column by column; the limit is the feature."""
    place = F.row_number().over(Window.partitionBy("image_id").orderBy("c0", "r0"))
    return windows.withColumn("place", place).where(F.col("place") <= n).drop("place")


def same_horizontal(one: str | int | None, two: str | int | None) -> bool:
    """Whether two reference systems, as numbers or texts, agree in the plane; a missing one agrees with any.

    Zone 29 north (25829) also agrees with a compound system that names the zone
    or has its central meridian, heights apart.
    """
    if one is None or two is None or str(one) == str(two):
        return True
    codes = [m[-1] if (m := re.findall(r"(?:EPSG:+)?\b(\d{4,5})\b", str(c))) and len(str(c)) < 40 else None for c in (one, two)]
    if codes[0] and codes[0] == codes[1]:
        return True
    zone = lambda c: "25829" in str(c) or "UTM_zone_29" in str(c) or 'central_meridian",-9' in str(c).replace(" ", "")
    return ("25829" in str(one) and zone(two)) or ("25829" in str(two) and zone(one))


def source_specs(value: str | None, years: list[int], defaults: list[tuple[str, int | None]]) -> list[tuple[str, int | None]]:
    """Files and their years of a comma-separated parameter; None: the defaults.

    A year is the one after a colon (24 or 25), else that of the file's name,
    else, if no file has one, that at the same place of years; a single file may have none
    if there are several years. Anything else is an error.
    """
    if value is None:
        return list(defaults)
    found: list[tuple[str, int | None]] = []
    for spec in filter(None, map(str.strip, value.split(","))):
        told = re.fullmatch(r"(.+?)\s*:\s*(24|25)", spec)
        path = told[1] if told else spec
        found.append((path, int(told[2]) if told else year_of_name(path)))
    missing = [path for path, year in found if year is None]
    if not missing:
        return found
    if len(missing) == len(found) == len(years):
        return [(path, year) for (path, _), year in zip(found, years)]
    if len(found) == 1 and len(years) > 1:
        return found
    raise ValueError(f"no year for {', '.join(missing)}: name it after a colon, as in file.gpkg:24")


def year_of_name(path: str) -> int | None:
    """The one of 24 and 25 that the file's name holds; of both, the first that stands by itself between marks."""
    name = path.rsplit("/", 1)[-1].lower()
    held = [y for y in (24, 25) if str(y) in name]
    alone = [int(t) for t in re.split(r"[_.-]", name) if t in ("24", "25")]
    return held[0] if len(held) == 1 else min(alone, default=None)
