"""Optimal one-to-one assignment: most pairs first, then the highest total score.

Candidate pairs fall into connected components, which cannot influence each
other; each is solved by itself, in parallel, in memory that grows with its candidates.
"""

from __future__ import annotations

import heapq

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.operators.graph import components
from tidemark.operators.groups import walked


def cheapest(edges: list[list[tuple[int, float]]], columns: int, far: float) -> list[int]:
    """Column of each row (-1: none) of a least-cost assignment; edges: each row's (column, cost), far: the cost of a row without one.

    Shortest augmenting paths with prices. Every row starts at its cheapest column if that is free; each
    other row searches over its candidates, nearest first, for a free column or a row that is best left without.
    """
    row_price = [min((c for _, c in own), default=far) for own in edges]
    col_price = [0.0] * columns
    row_of, col_of = [-1] * columns, [-1] * len(edges)
    late = []
    for r, own in enumerate(edges):
        j = next((j for j, c in own if c == row_price[r] and row_of[j] < 0), -1)
        if j >= 0:
            row_of[j], col_of[r] = r, j
        else:
            late.append(r)
    for r in late:
        best: dict[int, float] = {}
        came: dict[int, int] = {}  # the row from which a column was reached
        done: dict[int, float] = {}
        queue: list[tuple[float, int]] = []
        i, so_far, bare, bare_row = r, 0.0, float("inf"), -1
        while True:
            if (d := so_far + far - row_price[i]) < bare:
                bare, bare_row = d, i
            for j, c in edges[i]:
                if j not in done and (d := so_far + c - row_price[i] - col_price[j]) < best.get(j, bare):
                    best[j], came[j] = d, i
                    heapq.heappush(queue, (d, j))
            while queue and (queue[0][1] in done or queue[0][0] > best[queue[0][1]]):
                heapq.heappop(queue)
            if not queue or queue[0][0] >= bare:
                length, j = bare, -1
                break
            so_far, j = heapq.heappop(queue)
            if row_of[j] < 0:
                length = so_far
                break
            done[j] = so_far
            i = row_of[j]
        row_price[r] += length
        for k, d in done.items():
            row_price[row_of[k]] += length - d
            col_price[k] -= length - d
        if j < 0:  # the row that is left without gives up its column
            i = bare_row
            j, col_of[i] = col_of[i], -1
            if i == r:
                continue
        while True:
            i = came[j]
            row_of[j] = i
            j, col_of[i] = col_of[i], j
            if i == r:
                break
    return col_of


def solve(pairs: pd.DataFrame) -> pd.DataFrame:
    """The chosen rows of one component's candidates (a, b, score)."""
    pairs = pairs.sort_values(["a", "b"], kind="stable")
    return pairs[_chosen(*[pairs[c].to_numpy() for c in ("a", "b", "score")])]


def _chosen(a: np.ndarray, b: np.ndarray, score: np.ndarray) -> np.ndarray:
    """Which candidates, in order of a and b, are chosen."""
    if len(a) == 1:
        return np.ones(1, bool)
    sides = [np.unique(s, return_inverse=True) for s in (a, b)]
    turned = len(sides[0][0]) > len(sides[1][0])
    (rows, ri), (cols, ci) = sides[::-1] if turned else sides
    edges: list[list[tuple[int, float]]] = [[] for _ in rows]
    for i, j, s in zip(ri.tolist(), ci.tolist(), score.tolist()):
        edges[i].append((j, 1.0 - s))
    # a row without a column costs more than all real costs together: pairs count before score
    return np.array(cheapest(edges, len(cols), float(len(rows) + 1) * 2))[ri] == ci


def _solved(rows: dict[str, np.ndarray]) -> tuple[np.ndarray, ...]:
    chosen = _chosen(rows["a"], rows["b"], rows["score"])
    return rows["a"][chosen], rows["b"][chosen], rows["score"][chosen]


def assign(candidates: DataFrame) -> DataFrame:
    """candidates (a, b: long, score: double; higher is better) to the pairs chosen, a, b, score.

    Pairs of equal optima are told apart by order of ids. No candidates give no pairs.
    """
    numbered = candidates.select((2 * F.col("a")).alias("u"), (2 * F.col("b") + 1).alias("v"))
    roots = components(numbered).select(F.col("node").alias("u"), "root")
    grouped = candidates.withColumn("u", 2 * F.col("a")).join(roots, "u").select("root", "a", "b", "score")
    return walked(grouped, ["root"], ["a", "b"], _solved, "a long, b long, score double")
