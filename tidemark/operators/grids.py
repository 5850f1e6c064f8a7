"""Rasters as tables of chunks: windows of them, filters with borders from neighbours, differences of two grids.

A chunk is a row: raster_id, chunk_r, chunk_c, its cells' bounds r0, c0, r1, c1
(ends out), and vals, their values row by row (missing cells null). Cells (r, c)
cover x0 + [c, c + 1] * dx and y0 - [r, r + 1] * dy of their raster's transform.
No step holds more than a chunk and what touches it.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from types import SimpleNamespace

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.operators.groups import spread, walked
from tidemark.operators.raster import _kernel, median_filtered

CHUNK = "raster_id long, chunk_r long, chunk_c long, r0 long, c0 long, r1 long, c1 long, vals array<double>"
KEY, BOUNDS = ["raster_id", "chunk_r", "chunk_c"], ["r0", "c0", "r1", "c1"]
#: Cells on a chunk's side.
SIDE = 256


def chunks(cells: DataFrame, value: str, side: int = SIDE) -> DataFrame:
    """The chunks of cells (raster_id, r, c, value); cells must be unique, a chunk's bounds are those of its cells."""
    placed = cells.select(F.col("raster_id").cast("long"), F.floor(F.col("r") / side).alias("chunk_r"), F.floor(F.col("c") / side).alias("chunk_c"), F.col("r").cast("long"), F.col("c").cast("long"), F.col(value).cast("double").alias("v"))
    key = lambda r, c: r * (1 << 20) + c
    rows = placed.groupBy(*KEY).agg(F.min("r").alias("r0"), F.min("c").alias("c0"), (F.max("r") + 1).alias("r1"), (F.max("c") + 1).alias("c1"), F.collect_list(F.struct(key(F.col("r"), F.col("c")).alias("k"), "v")).alias("have"))
    w = F.col("c1") - F.col("c0")
    places = F.transform(F.sequence(F.lit(0).cast("long"), (F.col("r1") - F.col("r0")) * w - 1), lambda i: key(F.col("r0") + F.floor(i / w), F.col("c0") + i % w))
    missing = F.transform(F.array_except(places, F.transform("have", lambda x: x["k"])), lambda k: F.struct(k.alias("k"), F.lit(None).cast("double").alias("v")))
    return rows.withColumn("vals", F.transform(F.sort_array(F.concat("have", missing)), lambda x: x["v"])).drop("have")


def cells_of(chunk: DataFrame, value: str = "z") -> DataFrame:
    """raster_id, r, c and the value of every cell."""
    w = F.col("c1") - F.col("c0")
    return chunk.select("raster_id", "r0", "c0", "c1", F.posexplode("vals").alias("i", value)).select("raster_id", (F.col("r0") + F.floor(F.col("i") / w)).alias("r"), (F.col("c0") + F.col("i") % w).alias("c"), value)


def window(chunk: DataFrame, bounds: tuple[int, int, int, int], pad: int = 0, value: str = "z") -> DataFrame:
    """Cells of a window (r0, c0, r1, c1, ends out) grown by pad and cut off at the raster: raster_id, r, c, value.

    Chunks outside are pruned by their bounds, in the scan if the chunks are files. A window without any cell is an error.
    """
    r0, c0, r1, c1 = bounds[0] - pad, bounds[1] - pad, bounds[2] + pad, bounds[3] + pad
    kept = chunk.where((F.col("r0") < r1) & (F.col("r1") > r0) & (F.col("c0") < c1) & (F.col("c1") > c0))
    inside = cells_of(kept, value).where((F.col("r") >= r0) & (F.col("r") < r1) & (F.col("c") >= c0) & (F.col("c") < c1))
    if inside.isEmpty():
        raise ValueError(f"the window {bounds} does not meet the raster")
    return inside


def _grid(r0: int, c0: int, r1: int, c1: int, vals) -> np.ndarray:
    return np.array(vals, dtype=float).reshape(r1 - r0, c1 - c0)


def _assembled(patches: list[tuple]) -> tuple[np.ndarray, int, int]:
    """One grid of all patches (r0, c0, r1, c1, vals), NaN between them, and its first row and column."""
    first, last = [min(p[k] for p in patches) for k in (0, 1)], [max(p[k] for p in patches) for k in (2, 3)]
    out = np.full((last[0] - first[0], last[1] - first[1]), np.nan)
    for p in patches:
        out[p[0] - first[0] : p[2] - first[0], p[1] - first[1] : p[3] - first[1]] = _grid(*p)
    return out, *first


def _patches(rows: dict[str, np.ndarray]) -> list[tuple]:
    return list(zip(*[rows[c].tolist() for c in BOUNDS], rows["vals"]))


def _chunks(rows: list[tuple]) -> tuple[np.ndarray, ...]:
    """The columns of chunks."""
    vals = np.empty(len(rows), object)
    for k, r in enumerate(rows):
        vals[k] = r[-1]
    return *(np.array([r[k] for r in rows], np.int64) for k in range(len(KEY) + len(BOUNDS))), vals


def filtered(chunk: DataFrame, reach: int, kernel: Callable[[np.ndarray], np.ndarray], side: int = SIDE) -> DataFrame:
    """Chunks with kernel(grid) for values: it gets a chunk with reach more cells on each side and returns the chunk's.

    Each chunk sends its neighbours the strips they need and only these. Beyond the raster's edges
    the grid is mirrored (the edge cell twice). Missing cells are NaN; NaN results are null.
    """
    ring = -(-reach // side)

    def send(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for p in b.itertuples(index=False):
                grid = _grid(p.r0, p.c0, p.r1, p.c1, p.vals)
                for tr in range(p.chunk_r - ring, p.chunk_r + ring + 1):
                    for tc in range(p.chunk_c - ring, p.chunk_c + ring + 1):
                        r0, r1 = max(p.r0, tr * side - reach), min(p.r1, (tr + 1) * side + reach)
                        c0, c1 = max(p.c0, tc * side - reach), min(p.c1, (tc + 1) * side + reach)
                        if r0 < r1 and c0 < c1:
                            out.append((p.raster_id, tr, tc, r0, c0, r1, c1, grid[r0 - p.r0 : r1 - p.r0, c0 - p.c0 : c1 - p.c0].ravel(), (tr, tc) == (p.chunk_r, p.chunk_c)))
            yield pd.DataFrame(out, columns=[*KEY, *BOUNDS, "vals", "own"])

    def one(rows: dict[str, np.ndarray]) -> tuple[np.ndarray, ...]:
        own = np.flatnonzero(rows["own"])
        if not len(own):  # a place next to a chunk where there is none
            return _chunks([])
        key, patches = [rows[c][0] for c in KEY], _patches(rows)
        pr0, pc0, pr1, pc1, _ = patches[own[0]]
        grid, r0, c0 = _assembled(patches)
        want = ((pr0 - reach, pr1 + reach), (pc0 - reach, pc1 + reach))
        have = ((r0, r0 + grid.shape[0]), (c0, c0 + grid.shape[1]))
        grid = np.pad(grid, [(max(0, h[0] - w[0]), max(0, w[1] - h[1])) for w, h in zip(want, have)], mode="symmetric")
        cut = [max(0, w[0] - h[0]) for w, h in zip(want, have)]
        grid = grid[cut[0] : cut[0] + want[0][1] - want[0][0], cut[1] : cut[1] + want[1][1] - want[1][0]]
        return _chunks([(*key, pr0, pc0, pr1, pc1, kernel(grid).ravel())])

    sent = spread(chunk.select(*KEY, *BOUNDS, "vals"), *KEY).mapInPandas(send, CHUNK + ", own boolean")
    made = walked(sent, KEY, ["own"], one, CHUNK)
    return made.withColumn("vals", F.transform("vals", lambda v: F.when(~F.isnan(v), v)))


def relief(chunk: DataFrame, sigma: float, side: int = SIDE) -> DataFrame:
    """Each cell's height over the Gaussian mean around it (to four sigma); next to missing cells null."""
    weights = np.array(_kernel(sigma))
    reach = len(weights) // 2

    def kernel(grid: np.ndarray) -> np.ndarray:
        lines = np.lib.stride_tricks.sliding_window_view(grid, len(weights), axis=1) @ weights
        return grid[reach : grid.shape[0] - reach, reach : grid.shape[1] - reach] - np.lib.stride_tricks.sliding_window_view(lines, len(weights), axis=0) @ weights

    return filtered(chunk, reach, kernel, side)


def denoised(chunk: DataFrame, size: int, side: int = SIDE) -> DataFrame:
    """The median over size by size cells; missing cells take their surroundings' median first."""
    reach = 2 * (size // 2)

    def kernel(grid: np.ndarray) -> np.ndarray:
        return median_filtered(grid, size)[reach : grid.shape[0] - reach, reach : grid.shape[1] - reach]

    return filtered(chunk, reach, kernel, side)


def difference(before: DataFrame, after: DataFrame, transforms: DataFrame, bounds: DataFrame | None = None, pad: float = 0.0, side: int = SIDE) -> DataFrame:
    """after minus before on the cells of before, after being taken at their centres (bilinear): chunks.

    transforms: raster_id and x0, y0, dx, dy of both (b_x0, ..., a_dy), one row a raster. bounds: raster_id, x1, y1, x2, y2, the
    window to be read, grown by pad and cut off at the raster; None: all of it. Where a cell
    that the mean needs is missing or outside, and where before is missing, the result is null. A chunk of before meets
    only the chunks of after that it covers.
    """
    own = before.select(*KEY, "r0", "c0", "r1", "c1", "vals").join(transforms, "raster_id")
    if bounds is not None:
        own = own.join(bounds.select("raster_id", *[F.col(c).alias(f"w_{c}") for c in ("x1", "y1", "x2", "y2")]), "raster_id")
        # whole cells that the grown window covers, to the nearest
        first = {"w_c0": F.round((F.col("w_x1") - pad - F.col("b_x0")) / F.col("b_dx")), "w_r0": F.round((F.col("b_y0") - F.col("w_y2") - pad) / F.col("b_dy"))}
        count = {"w_c1": F.round((F.col("w_x2") - F.col("w_x1") + 2 * pad) / F.col("b_dx")), "w_r1": F.round((F.col("w_y2") - F.col("w_y1") + 2 * pad) / F.col("b_dy"))}
        own = own.withColumns(first).withColumns({n: F.col(n.replace("1", "0")) + c for n, c in count.items()})
        own = own.where((F.col("r0") < F.col("w_r1")) & (F.col("r1") > F.col("w_r0")) & (F.col("c0") < F.col("w_c1")) & (F.col("c1") > F.col("w_c0")))
    else:
        own = own.withColumns({n: F.lit(v).cast("double") for n, v in (("w_c0", -1e18), ("w_r0", -1e18), ("w_c1", 1e18), ("w_r1", 1e18))})
    places = {"sr0": _place("b_y0", "b_dy", "a_y0", "a_dy", "r0", -1), "sr1": _place("b_y0", "b_dy", "a_y0", "a_dy", "r1", -1), "sc0": _place("b_x0", "b_dx", "a_x0", "a_dx", "c0", 1), "sc1": _place("b_x0", "b_dx", "a_x0", "a_dx", "c1", 1)}
    own = own.withColumns(places)
    steps = lambda a, b: F.sequence(F.floor((F.col(a) - 1) / side), F.floor((F.col(b) + 1) / side))
    asks = own.select(*KEY, F.explode(steps("sr0", "sr1")).alias("a_r"), "sc0", "sc1").select(*KEY, "a_r", F.explode(steps("sc0", "sc1")).alias("a_c"))
    given = after.select(F.col("raster_id"), F.col("chunk_r").alias("a_r"), F.col("chunk_c").alias("a_c"), "r0", "c0", "r1", "c1", "vals")
    patches = asks.join(given, ["raster_id", "a_r", "a_c"]).select(*[F.col(k).alias(f"of_{k}") for k in KEY], "r0", "c0", "r1", "c1", "vals")

    def one(rows: dict[str, np.ndarray]) -> tuple[np.ndarray, ...]:
        key, mine = [rows[c][0] for c in KEY], rows["own"].astype(bool)
        others = _patches({c: rows[c][~mine] for c in (*BOUNDS, "vals")})
        out = []
        for k in np.flatnonzero(mine):
            p = SimpleNamespace(**{c: v[k] for c, v in rows.items()})
            r0, r1 = int(max(p.r0, p.w_r0)), int(min(p.r1, p.w_r1))
            c0, c1 = int(max(p.c0, p.w_c0)), int(min(p.c1, p.w_c1))
            grid = _grid(p.r0, p.c0, p.r1, p.c1, p.vals)[r0 - p.r0 : r1 - p.r0, c0 - p.c0 : c1 - p.c0]
            y, x = p.b_y0 - (np.arange(r0, r1) + 0.5) * p.b_dy, p.b_x0 + (np.arange(c0, c1) + 0.5) * p.b_dx
            there = _bilinear(others, (p.a_y0 - y) / p.a_dy - 0.5, (x - p.a_x0) / p.a_dx - 0.5)
            out.append((*key, r0, c0, r1, c1, (there - grid).ravel()))
        return _chunks(out)

    # the chunks and what they ask for, as rows of one table
    place = [f"{s}_{c}" for s in "ba" for c in ("x0", "y0", "dx", "dy")] + ["w_r0", "w_c0", "w_r1", "w_c1"]
    asked = patches.select(*[F.col(f"of_{k}").alias(k) for k in KEY], *BOUNDS, "vals", *[F.lit(None).cast("double").alias(c) for c in place], F.lit(False).alias("own"))
    made = walked(own.select(*KEY, *BOUNDS, "vals", *[F.col(c).cast("double") for c in place], F.lit(True).alias("own")).union(asked), KEY, ["own"], one, CHUNK)
    return made.withColumn("vals", F.transform("vals", lambda v: F.when(~F.isnan(v), v)))


def _place(b0: str, bd: str, a0: str, ad: str, edge: str, way: int):
    """A cell edge of the one grid in cells of the other."""
    return ((F.col(b0) - F.col(a0)) * way + F.col(edge) * F.col(bd)) / F.col(ad)


def _bilinear(patches: list[tuple], rows: np.ndarray, cols: np.ndarray) -> np.ndarray:
    """Values at fractional places; NaN where a cell of weight is missing."""
    if not patches:
        return np.full((len(rows), len(cols)), np.nan)
    grid, r0, c0 = _assembled(patches)
    framed = np.pad(grid, 1, constant_values=np.nan)
    out = np.zeros((len(rows), len(cols)))
    fr, fc = rows - np.floor(rows), cols - np.floor(cols)
    at = lambda v, first, n: np.clip(np.floor(v).astype(int) - first + 1, 0, n + 1)
    for i in (0, 1):
        for j in (0, 1):
            weight = np.outer(fr if i else 1 - fr, fc if j else 1 - fc)
            value = framed[np.ix_(at(rows + i, r0, grid.shape[0]), at(cols + j, c0, grid.shape[1]))]
            out += np.where(weight > 0, weight * value, 0.0)
    return out
