"""Groups walked whole inside tasks, many in each, and the boxes of a group that meet."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from tidemark.storage import stored

#: Boxes of a group that is walked inside a task: its pairs are compared in blocks and held as far as they meet.
LOCAL_BOXES, BLOCK = 4096, 1 << 20


def spread(rows: DataFrame, *keys: str | Column) -> DataFrame:
    """rows dealt by keys to twice as many tasks as there are cores, or more: by bytes alone Spark would put few rows into one task, however long each takes in Python."""
    spark = rows.sparkSession
    return rows.repartition(max(int(spark.conf.get("spark.sql.shuffle.partitions")), 2 * spark.sparkContext.defaultParallelism), *keys)


def large_groups(rows: DataFrame, group: list[str], most: int) -> DataFrame:
    """The groups of more than so many rows; a group with a null key is none."""
    return stored(rows.groupBy(*group).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > most).select(*group))


def walked(rows: DataFrame, group: list[str], order: list[str | Column], walk: Callable[[dict[str, np.ndarray]], tuple], schema: str) -> DataFrame:
    """walk(columns) of each group, its rows in order, whole in a task: it returns the columns of schema. Null keys are left out."""
    names = StructType.fromDDL(schema).names

    def done(frames: list[pd.DataFrame]) -> pd.DataFrame:
        every = pd.concat(frames) if len(frames) > 1 else frames[0]
        columns = {c: every[c].to_numpy() for c in every.columns}
        ends = [*_cuts(every, group).tolist(), len(every)]
        out = [walk({c: v[a:b] for c, v in columns.items()}) for a, b in zip([0, *ends], ends)]
        return pd.DataFrame({n: np.concatenate([o[k] for o in out]) for k, n in enumerate(names)})

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: list[pd.DataFrame] = []
        for b in batches:
            if b.empty:
                continue
            cuts = _cuts(b, group)
            at = cuts[-1] if len(cuts) else 0
            if not held or not len(cuts) and all(held[-1][c].iloc[-1] == b[c].iloc[0] for c in group):
                held.append(b)
                continue
            if at:
                held.append(b.iloc[:at])
            yield done(held)
            held = [b.iloc[at:]]
        if held:
            yield done(held)

    for c in group:
        rows = rows.where(F.col(c).isNotNull())
    return spread(rows, *group).sortWithinPartitions(*group, *order).mapInPandas(run, schema)


def _cuts(rows: pd.DataFrame, group: list[str]) -> np.ndarray:
    """Where another group begins than the row's before."""
    new = np.zeros(max(0, len(rows) - 1), bool)
    for c in group:
        v = rows[c].to_numpy()
        new |= v[1:] != v[:-1]
    return np.flatnonzero(new) + 1


def meeting(a: tuple[np.ndarray, ...], b: tuple[np.ndarray, ...]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Rows i of boxes a and j of boxes b (x1, y1, x2, y2 each) that share some area, and the area."""
    found = [(np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0))]
    step = max(1, BLOCK // max(1, len(b[0])))
    for at in range(0, len(a[0]), step):
        x1, y1, x2, y2 = (v[at : at + step, None] for v in a)
        w, h = np.minimum(x2, b[2]) - np.maximum(x1, b[0]), np.minimum(y2, b[3]) - np.maximum(y1, b[1])
        i, j = np.nonzero((w > 0) & (h > 0))
        found.append((i + at, j, w[i, j] * h[i, j]))
    return tuple(np.concatenate(v) for v in zip(*found))
