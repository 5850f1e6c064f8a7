"""Texts that name tiles: manifests, tile names, window grids."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def parse_manifest(lines: DataFrame) -> DataFrame:
    """lines (file, line_no, text) to (file, year, tile_row, tile_col).

    A line that names 2024 or 2025 and has the word tile sets the year of the
    lines after it; a line "row: a-b, c" lists columns, ranges with both ends.
    Other lines, and rows before any year, give nothing.
    """
    text = F.lower("text")
    header = F.when(text.contains("tile"), F.regexp_extract(text, "(2024|2025)", 1))
    after = Window.partitionBy("file").orderBy("line_no").rowsBetween(Window.unboundedPreceding, 0)
    year = F.last(F.when(F.length(header) > 0, (header.cast("int") - 2000)), ignorenulls=True).over(after)
    row = F.regexp_extract("text", r"^\s*(\d+)\s*:", 1)
    parts = F.explode(F.transform(F.split(F.regexp_replace("text", r"^\s*\d+\s*:", ""), ","), lambda p: F.trim(p)))
    spec = lines.withColumn("year", year).where((F.length(row) > 0) & F.col("year").isNotNull()).select("file", "year", row.cast("int").alias("tile_row"), parts.alias("part"))
    first, last = F.regexp_extract("part", r"^(\d+)", 1), F.regexp_extract("part", r"^\d+\s*-\s*(\d+)$", 1)
    whole = spec.where(F.col("part").rlike(r"^\d+(\s*-\s*\d+)?$"))
    low = first.cast("int")
    return whole.withColumn("low", low).withColumn("high", F.when(F.length(last) > 0, last.cast("int")).otherwise(low)).where("high >= low").select("file", "year", "tile_row", F.explode(F.sequence("low", "high")).alias("tile_col"))


#: Suffixes of turned pictures, in the order in which they are tried.
VARIANT_SUFFIXES = ["antitranspose", "transpose", "rot90", "rot180", "rot270", "hflip", "vflip"]
#: Forms of tile names with the year that each implies (0: its first group, null: none), in the order in which they are tried.
TILE_FORMS = [
    (r"^(24|25)_.+_(\d+)_(\d+)$", 0),
    (r"^(24|25)_(\d+)_(\d+)$", 0),
    (r"^Sites1and2_2024_Orthomosaic()_(\d+)_(\d+)$", 24),
    (r"^25IniSouthOrt()_(\d+)_(\d+)$", 25),
    (r"^()(\d+)_(\d+)$", None),
]


def strip_variant(name: Column) -> Column:
    """A picture's stem without its variant."""
    return F.regexp_replace(name, "_(" + "|".join(VARIANT_SUFFIXES) + ")$", "")


def tile_key(name: Column) -> Column:
    """struct<year,tile_row,tile_col> of a file or tile name in one of TILE_FORMS, with or without a variant; null if it is in none.

    YY_..._R_C and YY_R_C, the two orthomosaics' own names, and R_C, which has no year.
    """
    stem = strip_variant(F.regexp_replace(F.substring_index(name, "/", -1), r"\.[A-Za-z]+$", ""))
    out = None
    for form, year in TILE_FORMS:
        number = lambda k: F.regexp_extract(stem, form, k).try_cast("int")  # noqa: B023, E731
        key = F.struct((number(1) if year == 0 else F.lit(year).cast("int")).alias("year"), number(2).alias("tile_row"), number(3).alias("tile_col"))
        out = F.when(stem.rlike(form), key) if out is None else out.when(stem.rlike(form), key)
    return out


def class_of(raw: Column) -> Column:
    """0 boulder, 1 deposit: null is 0, a number 1 if its whole part is one, text 1 if it speaks of a deposit."""
    text = F.lower(F.trim(raw.cast("string")))
    number = text.try_cast("double").cast("int")
    by_text = F.when(text.isin("", "0", "boulder", "boulders"), 0).when(text.contains("deposit"), 1).otherwise(0)
    return F.when(raw.isNull(), 0).when(number.isNotNull(), (number == 1).cast("int")).otherwise(by_text)


def canonical_tile(year: Column, row: Column, col: Column) -> Column:
    """YY_RR_CC."""
    return F.format_string("%02d_%02d_%02d", year.cast("int"), row.cast("int"), col.cast("int"))


def window_starts(length: Column, window: int, step: int) -> Column:
    """Starts of windows along a side: 0 if it fits in one, else each step and one flush with the end."""
    last = length - window
    return F.when(last <= 0, F.array(F.lit(0).cast("long"))).otherwise(F.array_sort(F.array_union(F.sequence(F.lit(0).cast("long"), F.greatest(last, F.lit(0)).cast("long"), F.lit(step).cast("long")), F.array(last.cast("long")))))


def window_grid(images: DataFrame, window: int, rate: float) -> DataFrame:
    """images (image_id, width, height) to windows (image_id, r0, r1, c0, c1); step is max(1, round(window * rate))."""
    step = max(1, round(window * rate))
    rows = images.withColumn("r0", F.explode(window_starts(F.col("height"), window, step))).withColumn("c0", F.explode(window_starts(F.col("width"), window, step)))
    return rows.select("image_id", "r0", F.least(F.col("r0") + window, F.col("height")).alias("r1"), "c0", F.least(F.col("c0") + window, F.col("width")).alias("c1"))


def stitch(dets: DataFrame, windows: DataFrame) -> DataFrame:
    """Window-local boxes (window_id, x1..y2) moved to the whole picture by their window's origin (c0, r0).

    A column ring moves along. w and h count both border pixels: x2 - x1 + 1 and y2 - y1 + 1.
    """
    w = windows.select("window_id", *[c for c in windows.columns if c in ("image_id", "tile_id")], "c0", "r0")
    ring = {"ring": F.transform("ring", lambda p: F.struct((p["x"] + F.col("c0")).cast("double").alias("x"), (p["y"] + F.col("r0")).cast("double").alias("y")))} if "ring" in dets.columns else {}
    size = {"w": F.col("x2") - F.col("x1") + 1, "h": F.col("y2") - F.col("y1") + 1}
    return dets.join(w, "window_id").withColumns(ring | size | {"x1": F.col("x1") + F.col("c0"), "x2": F.col("x2") + F.col("c0"), "y1": F.col("y1") + F.col("r0"), "y2": F.col("y2") + F.col("r0")}).drop("c0", "r0")
