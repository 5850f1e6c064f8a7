"""Grids as tables of cells, and what is measured on them.

Cells have raster_id, r, c (0-based) and values; r grows southwards. Objects
have box corners in cell units of their raster, y from the bottom: cell (r, c)
covers x in [c, c + 1] and y in [rows - r - 1, rows - r].
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidemark.functions.geometry import edge_distance, edge_meets_box, in_ring, let, on_ring, ring_box, ring_edges
from tidemark.operators.spatial import BOX
from tidemark.storage import stored

#: Below this an elevation is missing.
LOWEST = -100.0
#: Columns of cells in a block.
COLUMNS = 32


def clean(z: Column) -> Column:
    """Nodata as null: NaN and anything below LOWEST."""
    return F.when(~F.isnan(z) & (z >= LOWEST), z)


def filled(cells: DataFrame, value: str) -> DataFrame:
    """Missing values replaced by the raster's median, or 0 where all are missing."""
    m = cells.groupBy("raster_id").agg(F.median(value).alias("fill"))
    return cells.join(m, "raster_id").withColumn(value, F.coalesce(value, "fill", F.lit(0.0))).drop("fill")


def stretched(cells: DataFrame, value: str, low: float = 0.02, high: float = 0.98) -> DataFrame:
    """cells with byte: the value between exact percentiles of its raster, on 0 to 255, cut off below the point."""
    p = cells.groupBy("raster_id").agg(F.percentile(value, F.array(F.lit(low), F.lit(high))).alias("p"))
    span = F.greatest(F.col("p")[1] - F.col("p")[0], F.lit(1e-6))
    return cells.join(p, "raster_id").withColumn("byte", F.floor(F.greatest(F.lit(0.0), F.least(F.lit(1.0), (F.col(value) - F.col("p")[0]) / span)) * 255).cast("int")).drop("p")


def aligned(targets: DataFrame, source: DataFrame, value: str, fill: float | None = None) -> DataFrame:
    """targets (raster_id, r, c, sr, sc: place in source cells) with the source's value there, bilinear.

    Where a needed neighbour lies outside the source the value is fill.
    """
    r0, c0 = F.floor("sr"), F.floor("sc")
    fr, fc = F.col("sr") - r0, F.col("sc") - c0
    taps = F.filter(F.array(*[F.struct((r0 + i).alias("r_"), (c0 + j).alias("c_"), ((fr if i else 1 - fr) * (fc if j else 1 - fc)).alias("w")) for i in (0, 1) for j in (0, 1)]), lambda t: t["w"] > 0)
    spread = targets.select("raster_id", "r", "c", F.explode(taps).alias("t")).select("raster_id", "r", "c", "t.*")
    values = source.select("raster_id", F.col("r").alias("r_"), F.col("c").alias("c_"), F.col(value).alias("v"))
    got = spread.join(values, ["raster_id", "r_", "c_"], "left").groupBy("raster_id", "r", "c")
    whole = got.agg(F.sum(F.col("w") * F.col("v")).alias("v"), F.count_if(F.col("v").isNull()).alias("lost"))
    return whole.select("raster_id", "r", "c", F.when(F.col("lost") == 0, F.col("v")).otherwise(F.lit(fill)).alias(value))


def zonal(objects: DataFrame, cells: DataFrame, rows: int, rule: str, grow: float = 0.0) -> DataFrame:
    """Each object (raster_id, object_id, box) with its cells.

    rule: centre (the cell's centre lies in the box or on its border), touched (they meet at
    all) or ring (the centre lies outside and within grow of the box). A centre on the border,
    at distance 0, is the object's on every side and never its ring's. Objects
    with a column ring are taken by that outline, the box being its own. An
    object is spread over the rows and blocks of columns it can reach, so the join is an equi join of near ones.
    """
    if "ring" in objects.columns:
        edges = objects.withColumns({"b": ring_box(F.col("ring")), "edges": ring_edges(F.col("ring"))})
        boxed = edges.select(*[c for c in objects.columns if c not in BOX], "edges", *[F.col(f"b.{c}").alias(c) for c in BOX])
        near = zonal(boxed.drop("ring"), cells, rows, "touched") if rule != "ring" else zonal(boxed.drop("ring").withColumns({"y1": F.col("y1") - grow, "y2": F.col("y2") + grow, "x1": F.col("x1") - grow, "x2": F.col("x2") + grow}), cells, rows, "touched")
        x, y = F.col("c") + 0.5, rows - F.col("r") - 0.5
        inside = on_ring(F.col("edges"), x, y) | in_ring(F.col("edges"), x, y)
        if rule == "touched":
            return near.where(inside | edge_meets_box(F.col("edges"), F.col("c").cast("double"), (rows - F.col("r") - 1).cast("double"), (F.col("c") + 1).cast("double"), (rows - F.col("r")).cast("double")))
        return near.where(inside) if rule == "centre" else near.where(~inside & (edge_distance(F.col("edges"), x, y) <= grow))
    reach = grow if rule == "ring" else 0.0
    first, last = F.floor(rows - F.col("y2") - reach) - 1, F.ceil(rows - F.col("y1") + reach)
    block = lambda c: F.floor(F.greatest(c, F.lit(0.0)) / COLUMNS).cast("long")
    o = objects.withColumn("r", F.explode(F.sequence(F.greatest(first, F.lit(0)).cast("long"), F.greatest(last, F.lit(0)).cast("long"))))
    o = o.withColumn("zonal_block", F.explode(F.sequence(block(F.col("x1") - reach - 1), block(F.col("x2") + reach + 1))))
    both = o.join(cells.withColumn("zonal_block", block(F.col("c"))), ["raster_id", "r", "zonal_block"]).drop("zonal_block")
    x, y = F.col("c") + 0.5, rows - F.col("r") - 0.5
    if rule == "touched":
        return both.where((F.col("c") <= F.col("x2")) & (F.col("c") + 1 >= F.col("x1")) & (rows - F.col("r") - 1 <= F.col("y2")) & (rows - F.col("r") >= F.col("y1")))
    dx = F.greatest(F.col("x1") - x, x - F.col("x2"), F.lit(0.0))
    dy = F.greatest(F.col("y1") - y, y - F.col("y2"), F.lit(0.0))
    away = F.sqrt(dx * dx + dy * dy)
    return both.where(away == 0) if rule == "centre" else both.where((away > 0) & (away <= grow))


def change_stats(objects: DataFrame, cells: DataFrame, rows: int, lod: float, cell_area: float = 1.0) -> DataFrame:
    """Change (dz) in the cells each object touches: n, mean_dz, v_pos, v_neg, v_sum, share_pos, share_neg; no cells: zeros and a null mean."""
    hit = zonal(objects, cells, rows, "touched")
    up, down = F.col("dz") > lod, F.col("dz") < -lod
    s = hit.groupBy("raster_id", "object_id").agg(F.count("dz").alias("n"), F.avg("dz").alias("mean_dz"), (F.sum(F.when(up, F.col("dz")).otherwise(0.0)) * cell_area).alias("v_pos"), (F.sum(F.when(down, -F.col("dz")).otherwise(0.0)) * cell_area).alias("v_neg"), (F.sum("dz") * cell_area).alias("v_sum"), F.avg(up.cast("double")).alias("share_pos"), F.avg(down.cast("double")).alias("share_neg"))
    return objects.select("raster_id", "object_id").join(s, ["raster_id", "object_id"], "left").na.fill(0, ["n", "v_pos", "v_neg", "v_sum", "share_pos", "share_neg"])


def ring_volumes(objects: DataFrame, cells: DataFrame, rows: int, value: str, ring: float = 0.5, cell_area: float = 1.0) -> DataFrame:
    """Volume above the median of the ring around each object: volume, mean_height, max_height; null without cells in either."""
    base = zonal(objects, cells, rows, "ring", ring).groupBy("raster_id", "object_id").agg(F.median(value).alias("base"))
    inside = zonal(objects, cells, rows, "centre").join(base, ["raster_id", "object_id"])
    height = F.when(F.col(value) > F.col("base"), F.col(value) - F.col("base"))
    got = inside.groupBy("raster_id", "object_id").agg((F.coalesce(F.sum(height), F.lit(0.0)) * cell_area).alias("volume"), F.coalesce(F.avg(height), F.lit(0.0)).alias("mean_height"), F.coalesce(F.max(height), F.lit(0.0)).alias("max_height"))
    return objects.select("raster_id", "object_id").join(got, ["raster_id", "object_id"], "left")


def match_label(v_neg: Column, v_pos: Column, distance: Column, stationary: float, least: float) -> Column:
    """What the change under both footprints says of a match; a missing distance counts as not moved."""
    moved = F.coalesce(distance > stationary, F.lit(False))
    source, sink = v_neg >= least, v_pos >= least
    still = F.when(source | sink, "stationary_dod_noise").otherwise("stationary_ok")
    return F.when(~moved, still).when(source & sink, "consistent_move").when(source, "move_source_only").when(sink, "move_sink_only").otherwise("move_weak_dod")


def loss_label(v_neg: Column, v_pos: Column, least: float) -> Column:
    return F.when(v_neg >= least, "likely_missed_mover_source").when(v_pos >= least, "unexpected_deposition").otherwise("weak_or_true_loss")


def gain_label(v_neg: Column, v_pos: Column, least: float) -> Column:
    return F.when(v_pos >= least, "likely_missed_mover_sink").when(v_neg >= least, "unexpected_depletion").otherwise("weak_or_true_gain")


def _kernel(sigma: float) -> list[float]:
    reach = int(4 * sigma + 0.5)
    w = [math.exp(-0.5 * (k / sigma) ** 2) for k in range(-reach, reach + 1)]
    return [x / sum(w) for x in w]


def _smoothed_line(line: Column, sigma: float) -> Column:
    """An array convolved with a Gaussian, mirrored at its ends (the end cell twice)."""
    weights = _kernel(sigma)
    reach = len(weights) // 2

    def at(i: Column) -> Column:
        n = F.size(line)
        mirrored = let(F.pmod(i, 2 * n), lambda k: F.least(k, 2 * n - 1 - k))
        return F.get(line, mirrored)

    w = F.array(*[F.lit(x) for x in weights])
    return F.transform(line, lambda _, i: F.aggregate(F.sequence(F.lit(0), F.lit(2 * reach)), F.lit(0.0), lambda a, k: a + F.get(w, k) * at(i + k - reach)))


def local_relief(cells: DataFrame, value: str, sigma: float) -> DataFrame:
    """cells with relief: the value minus its Gaussian mean, one pass along rows and one along columns.

    A line of cells of one raster is one array; lines are spread over tasks. Cells must be complete.
    """

    def along(df: DataFrame, line: str, place: str, v: str) -> DataFrame:
        rows = df.groupBy("raster_id", line).agg(F.sort_array(F.collect_list(F.struct(place, F.col(v).alias("v")))).alias("l"))
        rows = rows.select("raster_id", line, F.transform("l", lambda x: x[place]).alias("ps"), F.transform("l", lambda x: x["v"]).alias("vs"))
        made = rows.select("raster_id", line, F.explode(F.arrays_zip("ps", _smoothed_line(F.col("vs"), sigma).alias("s"))).alias("x"))
        return made.select("raster_id", line, F.col("x.ps").alias(place), F.col("x.s").alias("smooth"))

    once = along(cells, "r", "c", value)
    twice = along(once, "c", "r", "smooth")
    return cells.join(twice, ["raster_id", "r", "c"]).withColumn("relief", F.col(value) - F.col("smooth")).drop("smooth")


# measures of one object over its own window of cells, in numpy

def _cubic(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    return np.stack([x**i * y**j for i in range(4) for j in range(4 - i)], axis=1)


def cubic_base(window: pd.DataFrame, dof: bool = True) -> dict:
    """Heights over a cubic surface through the cells marked base: base, rmse, maxh, meanh, volume (of 1 by 1 cells).

    Coordinates are centred and scaled before the fit. Fewer than ten base
    cells: all null. A fit worse than 1 has no base height.
    """
    base, inside = window[window["base"]], window[window["inside"]]
    none = {k: None for k in ("base_height", "rmse", "maxh", "meanh", "volume")}
    if len(base) < 10 or inside.empty:
        return none
    mx, my = base["x"].mean(), base["y"].mean()
    scale = max(base["x"].std(ddof=0), base["y"].std(ddof=0), 1e-9)
    a = _cubic(((base["x"] - mx) / scale).to_numpy(), ((base["y"] - my) / scale).to_numpy())
    coef = np.linalg.lstsq(a, base["z"].to_numpy(), rcond=None)[0]
    left = base["z"].to_numpy() - a @ coef
    rmse = float(np.sqrt((left**2).sum() / max(len(left) - (10 if dof else 0), 1)))
    surface = _cubic(((inside["x"] - mx) / scale).to_numpy(), ((inside["y"] - my) / scale).to_numpy()) @ coef
    h = np.maximum(inside["z"].to_numpy() - surface, 0)
    maxh = float(h.max())
    return {
        "base_height": float(np.median(surface)) if rmse <= 1 else None,
        "rmse": rmse,
        "maxh": maxh,
        "meanh": float(np.median(h[h > 0])) if (h > 0).any() else 0.0,
        "volume": float(h.sum()) if 0.3 < maxh <= 20 else None,
    }


def median_filtered(grid: np.ndarray, window: int) -> np.ndarray:
    """Median over a square window, edges mirrored; missing cells take their window's median first."""
    reach = window // 2
    view = lambda g: np.lib.stride_tricks.sliding_window_view(np.pad(g, reach, mode="symmetric"), (2 * reach + 1, 2 * reach + 1)).reshape(*g.shape, -1)
    if np.isnan(grid).any():
        with np.errstate(all="ignore"):
            grid = np.where(np.isnan(grid), np.nanmedian(view(grid), axis=-1), grid)
    return np.median(view(grid), axis=-1)


def smoothed_window(window: pd.DataFrame, size: int) -> pd.DataFrame | None:
    """A window's cells (x, y, z) with z median-filtered over size cells a side; None if a filtered cell is exactly 0."""
    c, r = (window["x"] - window["x"].min()).astype(int).to_numpy(), (window["y"].max() - window["y"]).astype(int).to_numpy()
    grid = np.full((r.max() + 1, c.max() + 1), np.nan)
    grid[r, c] = window["z"]
    z = median_filtered(grid, size)[r, c]
    return None if (z == 0).any() else window.assign(z=z)


def cubic_base_volumes(objects: DataFrame, cells: DataFrame, rows: int, value: str, gap: float = 1.0, reach: float = 6.0, mask_neighbours: bool = True, smooth: int = 0, dof: bool = True) -> DataFrame:
    """cubic_base() of every object over the cells within reach of it.

    Base cells lie outside the object grown by gap and, with mask_neighbours,
    outside every other object so grown. smooth: side of a median filter over
    the window, in cells; an object with a filtered cell of exactly 0 is all
    null. Objects with columns major and minor also get abc (their product with
    the greatest height) and ellipsoid, the volume of such an ellipsoid.
    is_boulder is 1 unless the fit is worse than 1, null without a fit.
    """
    near = zonal(objects, cells, rows, "ring", reach).select("raster_id", "object_id", "r", "c", F.col(value).alias("z"), F.lit(False).alias("inside"))
    own = zonal(objects, cells, rows, "centre").select("raster_id", "object_id", "r", "c", F.col(value).alias("z"), F.lit(True).alias("inside"))
    grown = objects.select("raster_id", "object_id", *[(F.col(b) + (gap if b[1] == "2" else -gap)).alias(b) for b in BOX])
    blocked = zonal(grown, cells, rows, "centre").select("raster_id", "r", "c", F.col("object_id").alias("by"))
    if mask_neighbours:
        shut = blocked.select("raster_id", "r", "c").distinct().withColumn("shut", F.lit(True))
        joined = near.union(own).join(shut, ["raster_id", "r", "c"], "left")
    else:
        shut = blocked.withColumn("shut", F.lit(True)).withColumnRenamed("by", "object_id")
        joined = near.union(own).join(shut, ["raster_id", "object_id", "r", "c"], "left")
    cellrows = joined.select("raster_id", "object_id", F.col("c").cast("double").alias("x"), (-F.col("r")).cast("double").alias("y"), "z", "inside", (~F.col("inside") & F.col("shut").isNull()).alias("base"))

    def one(key: tuple, window: pd.DataFrame) -> pd.DataFrame:
        w = window.dropna(subset=["z"]).sort_values(["y", "x"])
        if smooth > 1 and len(w):
            w = smoothed_window(w, smooth)
        return pd.DataFrame([{"raster_id": key[0], "object_id": key[1], **cubic_base(cellless if w is None else w, dof)}])

    cellless = pd.DataFrame({"x": [], "y": [], "z": [], "inside": pd.Series([], dtype=bool), "base": pd.Series([], dtype=bool)})
    made = cellrows.groupBy("raster_id", "object_id").applyInPandas(one, "raster_id long, object_id long, base_height double, rmse double, maxh double, meanh double, volume double")
    made = made.withColumn("is_boulder", F.when(F.col("rmse").isNotNull(), (F.col("rmse") <= 1).cast("int")))
    if {"major", "minor"} <= set(objects.columns):
        made = made.join(objects.select("raster_id", "object_id", "major", "minor"), ["raster_id", "object_id"])
        made = made.withColumn("abc", F.col("major") * F.col("minor") * F.col("maxh")).withColumn("ellipsoid", F.lit(4 / 3 * math.pi) * F.col("abc") / 8)
    return made


def sections(objects: DataFrame, cells: DataFrame, value: str) -> DataFrame:
    """objects (raster_id, object_id, cx, cy, theta) to length and area of their profile: the nearest cells along the line through (cx, cy), 1-based, at theta - 90 degrees.

    The line takes a step a column, or a row if it leaves the grid through top and bottom. Missing
    cells are 0; the first point and zero cells have step 0. Steps outside the grid count nothing; an object whose line meets no cell has 0 and 0.
    """
    size = cells.groupBy("raster_id").agg((F.max("c") + 1).alias("n_cols"), (F.max("r") + 1).alias("n_rows"))
    slope = F.tan(F.radians((F.col("theta") - 90) % 360))
    line = objects.join(size, "raster_id").withColumn("slope", slope).withColumn("lift", F.col("cy") - F.col("slope") * F.col("cx"))
    first, last = 1 * F.col("slope") + F.col("lift"), F.col("n_cols") * F.col("slope") + F.col("lift")
    steep = ((first < 1) & (last > F.col("n_rows"))) | ((last < 1) & (first > F.col("n_rows")))
    line = line.withColumn("steep", steep).withColumn("k", F.explode(F.sequence(F.lit(1).cast("long"), F.when(steep, F.col("n_rows")).otherwise(F.col("n_cols")).cast("long"))))
    k = F.col("k").cast("double")
    line = line.withColumn("x", F.when(F.col("steep"), (k - F.col("lift")) / F.col("slope")).otherwise(k)).withColumn("y", F.when(F.col("steep"), k).otherwise(k * F.col("slope") + F.col("lift")))
    near = lambda v: F.floor(F.col(v) + 0.5)
    line = line.where((F.col("x").between(-1e9, 1e9)) & (F.col("y").between(-1e9, 1e9))).withColumns({"c": near("x") - 1, "r": near("y") - 1}).where("c >= 0 AND c < n_cols AND r >= 0 AND r < n_rows")
    before = Window.partitionBy("raster_id", "object_id").orderBy("k")
    stepped = line.withColumn("step", F.coalesce(F.hypot(F.col("x") - F.lag("x").over(before), F.col("y") - F.lag("y").over(before)), F.lit(0.0)))
    met = stepped.select("raster_id", "object_id", "r", "c", "step").join(cells.select("raster_id", "r", "c", F.col(value).alias("z")), ["raster_id", "r", "c"], "left")
    z = F.coalesce("z", F.lit(0.0))
    sums = met.groupBy("raster_id", "object_id").agg(F.sum(F.when(z != 0, F.col("step")).otherwise(0.0)).alias("length"), F.sum(z * F.col("step")).alias("area"))
    return objects.select("raster_id", "object_id").join(sums, ["raster_id", "object_id"], "left").na.fill(0.0, ["length", "area"])


def change_labels(before: DataFrame, after: DataFrame, matches: DataFrame, cells: DataFrame, rows: int, lod: float, least: float, stationary: float) -> DataFrame:
    """What elevation change (cells with dz) says of the outcomes of a match: layer, before_id, after_id, label, v_neg, v_pos, mean_before, mean_after, ratio.

    before (raster_id, before_id, box) and after (raster_id, after_id, box) are all objects;
    matches (before_id, after_id, distance), of which a null distance is that of the centres; ids are
    unique over the rasters. v_neg is the loss under the object before, v_pos the gain under the one after (of a loss or gain both are under the one object); ratio is the smaller
    over the larger if both are there.
    """
    under = lambda objects, key: change_stats(objects.withColumnRenamed(key, "object_id"), cells, rows, lod).select("object_id", "v_neg", "v_pos", "mean_dz")
    centre = lambda objects, key, s: objects.select(F.col(key).alias(f"{s}_id"), ((F.col("x1") + F.col("x2")) / 2).alias(f"{s}x"), ((F.col("y1") + F.col("y2")) / 2).alias(f"{s}y"))
    # each is read twice, and is much smaller than the cells
    cells = stored(cells)
    b, a = stored(under(before, "before_id")), stored(under(after, "after_id"))
    sources = b.select(F.col("object_id").alias("before_id"), "v_neg", F.col("v_pos").alias("b_pos"), F.col("mean_dz").alias("mean_before"))
    sinks = a.select(F.col("object_id").alias("after_id"), "v_pos", F.col("v_neg").alias("a_neg"), F.col("mean_dz").alias("mean_after"))
    placed = matches.join(centre(before, "before_id", "before"), "before_id").join(centre(after, "after_id", "after"), "after_id")
    distance = F.coalesce("distance", F.hypot(F.col("afterx") - F.col("beforex"), F.col("aftery") - F.col("beforey")))
    both = placed.select("before_id", "after_id", distance.alias("distance")).join(sources, "before_id").join(sinks, "after_id")
    ratio = F.when((F.col("v_neg") > 0) & (F.col("v_pos") > 0), F.least("v_neg", "v_pos") / F.greatest("v_neg", "v_pos"))
    none, no_id = F.lit(None).cast("double"), F.lit(None).cast("long")
    lost = sources.join(matches.select("before_id"), "before_id", "left_anti")
    new = sinks.join(matches.select("after_id"), "after_id", "left_anti")
    return (
        both.select(F.lit("matches").alias("layer"), "before_id", "after_id", match_label(F.col("v_neg"), F.col("v_pos"), F.col("distance"), stationary, least).alias("label"), "v_neg", "v_pos", "mean_before", "mean_after", ratio.alias("ratio"))
        .union(lost.select(F.lit("disappeared"), "before_id", no_id, loss_label(F.col("v_neg"), F.col("b_pos"), least), "v_neg", F.col("b_pos"), "mean_before", none, none))
        .union(new.select(F.lit("appeared"), no_id, "after_id", gain_label(F.col("a_neg"), F.col("v_pos"), least), F.col("a_neg"), "v_pos", none, "mean_after", none))
    )
