"""Rasters in chunks against whole grids; queries on rasters where there are several."""

import os

import duckdb
import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tests.test_queries import plain
from tidemark.operators import grids, raster
from tidemark.plans import rasters
from tidemark.storage import stored

LARGER = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in os.listdir(LARGER):
        con.execute(f"CREATE VIEW {t.split('.')[0]} AS SELECT * FROM '{LARGER}/{t}'")
    return con


@pytest.mark.parametrize("name", sorted(n for n in rasters.QUERIES if n in rasters.ORACLES))
def test_query_on_many_rasters(spark, duck, name):
    got = rasters.QUERIES[name](spark, LARGER).toPandas()
    pd.testing.assert_frame_equal(plain(got), plain(duck.execute(rasters.ORACLES[name]).fetch_df()))


def test_every_label_of_a_change_occurs(spark):
    labels = {r.label for r in rasters.change_qc(spark, LARGER).select("label").distinct().collect()}
    assert len(labels) == 12


def grid_rows(spark, grid, holes=()):
    rows = [(1, r, c, None if (r, c) in holes else float(v)) for (r, c), v in np.ndenumerate(grid)]
    return spark.createDataFrame(rows, "raster_id long, r long, c long, z double")


def as_grid(cells, shape):
    out = np.full(shape, np.nan)
    for r in cells.collect():
        out[r.r, r.c] = np.nan if r[3] is None else r[3]
    return out


@pytest.mark.parametrize("shape,side", [((20, 17), 6), ((9, 30), 4), ((3, 2), 8), ((11, 11), 3)])
def test_chunked_filters_are_those_of_the_whole_grid(spark, shape, side):
    rng = np.random.default_rng(side)
    grid = rng.normal(size=shape)
    cells = grid_rows(spark, grid)
    want = as_grid(raster.local_relief(cells, "z", 1.5).select("raster_id", "r", "c", "relief"), shape)
    got = as_grid(grids.cells_of(grids.relief(grids.chunks(cells, "z", side), 1.5, side)), shape)
    assert np.allclose(got, want, atol=1e-12)
    holes = {(1, 1), (2, 1), (0, 0)} & {(r, c) for r in range(shape[0]) for c in range(shape[1])}
    broken = grid.copy()
    for at in holes:
        broken[at] = np.nan
    for size in (3, 5):
        got = as_grid(grids.cells_of(grids.denoised(grids.chunks(grid_rows(spark, grid, holes), "z", side), size, side)), shape)
        assert np.allclose(got, raster.median_filtered(broken, size))


def test_windows_prune_stored_chunks_and_refuse_to_be_empty(spark):
    grid = np.arange(20 * 30.0).reshape(20, 30)
    chunk = stored(grids.chunks(grid_rows(spark, grid), "z", 5))
    assert {(r.r, r.c, r.z) for r in grids.window(chunk, (-4, 27, 2, 40), 1).collect()} == {(r, c, grid[r, c]) for r in range(3) for c in range(26, 30)}
    spark.conf.set("spark.sql.maxMetadataStringLength", "2000")
    plan = grids.window(chunk, (0, 0, 2, 2))._jdf.queryExecution().toString()
    spark.conf.unset("spark.sql.maxMetadataStringLength")
    pushed = plan[plan.index("PushedFilters") :]
    assert all(f in pushed[:600] for f in ("LessThan(r0,", "GreaterThan(r1,", "LessThan(c0,", "GreaterThan(c1,"))
    with pytest.raises(ValueError, match="does not meet"):
        grids.window(chunk, (20, 0, 25, 5))


def test_differences_of_grids_of_other_cells(spark):
    rng = np.random.default_rng(8)
    before, after = rng.normal(size=(13, 16)), rng.normal(size=(9, 11))
    place = {"b_x0": 10.0, "b_y0": 40.0, "b_dx": 0.5, "b_dy": 1.0, "a_x0": 10.3, "a_y0": 39.2, "a_dx": 0.8, "a_dy": 1.25}
    t = spark.createDataFrame([(1, *place.values())], "raster_id long, " + ", ".join(f"{k} double" for k in place))
    got = as_grid(grids.cells_of(grids.difference(grids.chunks(grid_rows(spark, before), "z", 4), grids.chunks(grid_rows(spark, after, {(2, 2)}), "z", 3), t, side=3)), before.shape)
    after[2, 2] = np.nan
    for r in range(13):
        for c in range(16):
            x, y = 10 + (c + 0.5) * 0.5, 40 - (r + 0.5)
            fc, fr = (x - 10.3) / 0.8 - 0.5, (39.2 - y) / 1.25 - 0.5
            i, j = int(np.floor(fr)), int(np.floor(fc))
            taps = [(i + a, j + b, (fr - i if a else 1 - fr + i) * (fc - j if b else 1 - fc + j)) for a in (0, 1) for b in (0, 1)]
            inside = all(0 <= p < 9 and 0 <= q < 11 for p, q, w in taps if w > 0)
            want = sum(w * after[p, q] for p, q, w in taps if w > 0) - before[r, c] if inside else np.nan
            assert got[r, c] == pytest.approx(want, nan_ok=True)


def test_a_cell_on_the_border_is_the_objects_on_every_side(spark):
    cells = grid_rows(spark, np.zeros((8, 8)))
    x, y, s = 4.5, 4.5, 2.0
    ring = [(x + s, y), (x, y + s), (x - s, y), (x, y - s)]
    o = spark.createDataFrame([(1, 0, [{"x": a, "y": b} for a, b in ring])], "raster_id long, object_id long, ring array<struct<x:double,y:double>>")
    of = lambda rule, grow=0.0: {(7 - r.r, r.c) for r in raster.zonal(o, cells, 8, rule, grow).select("r", "c").collect()}
    inside = {(r, c) for r in range(8) for c in range(8) if abs(r - 4) + abs(c - 4) <= 2}
    assert of("centre") == inside
    near = lambda r, c: (abs(r - 4) + abs(c - 4) - 2) / 2**0.5
    assert of("ring", 0.8) == {(r, c) for r in range(8) for c in range(8) if 0 < near(r, c) <= 0.8 and min(abs(r - 4), abs(c - 4)) > 0}


def test_profiles_against_a_walk_in_one_grid(spark):
    rng = np.random.default_rng(3)
    grid = np.where(rng.random((9, 14)) < 0.2, 0.0, rng.random((9, 14)))
    objects = [(1, k, float(rng.uniform(1, 14)), float(rng.uniform(1, 9)), float(rng.uniform(0, 360))) for k in range(40)] + [(1, 99, 500.0, 4.0, 0.0)]
    got = {r.object_id: (r.length, r.area) for r in raster.sections(spark.createDataFrame(objects, "raster_id long, object_id long, cx double, cy double, theta double"), grid_rows(spark, grid, {(0, 0)}), "z").collect()}
    grid[0, 0] = 0
    for _, k, cx, cy, theta in objects:
        slope = np.tan(np.radians(np.fmod(theta - 90, 360)))
        x = np.arange(1.0, 15)
        y = x * slope + (cy - slope * cx)
        if (y[0] < 1 and y[-1] > 9) or (y[-1] < 1 and y[0] > 9):
            y = np.arange(1.0, 10)
            x = (y - (cy - slope * cx)) / slope
        n = lambda v: np.floor(v + 0.5).astype(int)
        ok = (n(x) >= 1) & (n(x) <= 14) & (n(y) >= 1) & (n(y) <= 9)
        x, y = x[ok], y[ok]
        z = grid[n(y) - 1, n(x) - 1]
        step = np.r_[0.0, np.hypot(np.diff(x), np.diff(y))] if len(x) else x
        assert got[k] == pytest.approx((step[z != 0].sum(), (z * step).sum()))
