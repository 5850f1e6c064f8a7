"""Streams that keep state by key: when a run would have stopped, and detections suppressed as a tile's windows arrive.

Results do not depend on the order in which files arrive. State is kept in RocksDB, so a key's state
is read by entry and an executor's loss restores it from the checkpoint folder.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor

STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def use_state_store(spark: SparkSession) -> None:
    """Have this session's streams keep their state in RocksDB, as state by key needs it."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", STORE)


def stopping_point(points: list[tuple[int, float]], patience: int) -> tuple[int, int | None]:
    """Best iteration and the first that is patience or more after it (None: never), of (iteration, value) in any order."""
    best, best_at = None, None
    for at, value in sorted(points):
        if best is None or value > best:
            best, best_at = value, at
        elif at - best_at >= patience:
            return best_at, at
    return best_at, None


class Stops(StatefulProcessor):
    """A run's evaluations by iteration; each trigger that brings some gives the run's row anew."""

    def __init__(self, patience: int):
        self.patience = patience

    def init(self, handle) -> None:
        self.points = handle.getMapState("points", "iteration long", "value double")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        for f in rows:
            for at, value in zip(f["iteration"], f["value"]):
                if pd.notna(value):
                    before = self.points.getValue((int(at),)) if self.points.containsKey((int(at),)) else None
                    self.points.updateValue((int(at),), (float(value) if before is None else max(before[0], float(value)),))
        held = [(k[0], v[0]) for k, v in self.points.iterator()]
        if held:
            best, stop = stopping_point(held, self.patience)
            yield pd.DataFrame({"run": [key[0]], "best_iteration": [best], "stop_iteration": pd.array([stop], "Int64")})

    def close(self) -> None:
        pass


def early_stops(metrics: DataFrame, patience: int) -> DataFrame:
    """A stream (run: string, iteration, value) to run, best_iteration, stop_iteration (null: not yet), in update mode: the last row of a run holds.

    As evaluation.early_stop() of all that has arrived; of two values of an iteration the larger counts.
    """
    use_state_store(metrics.sparkSession)
    return metrics.select("run", "iteration", "value").groupBy("run").transformWithStateInPandas(Stops(patience), "run string, best_iteration long, stop_iteration long", "Update", "None")


def kept_of(dets: pd.DataFrame, iou: float) -> pd.DataFrame:
    """det_id and kept_from_n of the boxes that are kept, best score first, ties by id."""
    d = dets.sort_values(["score", "det_id"], ascending=[False, True], kind="stable")
    x1, y1, x2, y2 = (d[c].to_numpy() for c in ("x1", "y1", "x2", "y2"))
    area = np.maximum(x2 - x1, 0) * np.maximum(y2 - y1, 0)
    leader = np.full(len(d), -1)
    for k in range(len(d)):
        if leader[k] < 0:
            w, h = np.minimum(x2[k], x2) - np.maximum(x1[k], x1), np.minimum(y2[k], y2) - np.maximum(y1[k], y1)
            shared = np.maximum(w, 0) * np.maximum(h, 0)
            with np.errstate(invalid="ignore", divide="ignore"):
                near = (shared > 0) & (shared / (area[k] + area - shared) >= iou)
            near[k] = True
            leader[near & (leader < 0)] = k
    kept, n = np.unique(leader, return_counts=True) if len(d) else (np.empty(0, int), np.empty(0, int))
    return pd.DataFrame({"det_id": d["det_id"].to_numpy()[kept], "kept_from_n": n})


class Suppression(StatefulProcessor):
    """A tile's detections until all its windows have arrived, or its time is over."""

    def __init__(self, iou: float, wait_ms: int):
        self.iou, self.wait = iou, wait_ms

    def init(self, handle) -> None:
        self.handle = handle
        self.windows = handle.getMapState("windows", "window_id long", "n long")
        self.found = handle.getMapState("found", "det_id long", "x1 double, y1 double, x2 double, y2 double, score double")
        self.over = handle.getValueState("over", "complete boolean")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        if self.over.exists():  # the tile's result is out
            for _ in rows:
                pass
            return
        expected, latest = 0, 0
        for f in rows:
            for r in f.itertuples(index=False):
                expected, latest = int(r.n_windows), max(latest, int(r.arrived.timestamp() * 1000))
                self.windows.updateValue((int(r.window_id),), (1,))
                if pd.notna(r.det_id):
                    self.found.updateValue((int(r.det_id),), (float(r.x1), float(r.y1), float(r.x2), float(r.y2), float(r.score)))
        if len(list(self.windows.keys())) >= expected:
            yield from self._out(key, True)
        elif timerValues.getCurrentWatermarkInMs() >= 0:
            for t in list(self.handle.listTimers()):
                self.handle.deleteTimer(t)
            self.handle.registerTimer(latest + self.wait)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        if not self.over.exists():
            yield from self._out(key, False)

    def _out(self, key, complete: bool) -> Iterator[pd.DataFrame]:
        rows = [(k[0], *v) for k, v in self.found.iterator()]
        self.over.update((complete,))
        self.windows.clear()
        self.found.clear()
        kept = kept_of(pd.DataFrame(rows, columns=["det_id", "x1", "y1", "x2", "y2", "score"]), self.iou)
        yield kept.assign(tile_id=key[0], complete=complete)[["tile_id", "det_id", "kept_from_n", "complete"]].astype({"det_id": "int64", "kept_from_n": "int64"})

    def close(self) -> None:
        pass


def suppressed_tiles(detections: DataFrame, iou: float = 0.4, late: str = "10 minutes", wait_seconds: int = 600) -> DataFrame:
    """A stream (arrived, tile_id, window_id, n_windows, det_id, x1..y2 in the tile's pixels, score) to tile_id, det_id, kept_from_n, complete.

    n_windows is how many windows the tile has; a window without detections is a row with a null det_id. A
    tile's boxes come out once: when its last window has arrived, or incomplete when the watermark passes the
    last arrival by wait_seconds. They are those that selection.suppress() keeps of the same rows. What comes later is left out.
    """
    use_state_store(detections.sparkSession)
    rows = detections.select(F.col("arrived").cast("timestamp"), F.col("tile_id").cast("long"), F.col("window_id").cast("long"), F.col("n_windows").cast("long"), F.col("det_id").cast("long"), *[F.col(c).cast("double") for c in ("x1", "y1", "x2", "y2", "score")])
    grouped = rows.withWatermark("arrived", late).groupBy("tile_id")
    return grouped.transformWithStateInPandas(Suppression(iou, wait_seconds * 1000), "tile_id long, det_id long, kept_from_n long, complete boolean", "Append", "EventTime")
