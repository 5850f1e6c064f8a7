"""Whitening of embeddings by shifted CholeskyQR.

Entries c become integers x = floor(64 * c) + 1000000. The fit list holds each
distinct vector of them once. Its centred rows A (each divided by the root of
their number) are never gathered: a pass adds up the Gram matrix of the rows
as orthogonalised so far, in parts that are summed by Spark; its Cholesky
factor, with a small multiple of the identity added so that it exists even for
rows that do not span all dimensions, orthogonalises the rows further by a
triangular solve and is multiplied onto R. When the Gram matrix is the identity
(on the space that the rows span) A = Q R, and the singular values and right
vectors of the small matrix R are those of A: the covariance itself, whose
small eigenvalues would drown in rounding, is never decomposed.

Rows whose vector is null, empty or holds a null or non-finite entry take no
part, nor does a vector of another length than the commonest or one with an
entry whose x is not under 2^53. Repeated rows and rows without an id each give their own
result, from one member of the fit list. A component whose variance is
rounding (rows that do not span it, or a single distinct vector) is not
returned. An empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.vectors import matrix, usable
from tidemark.storage import stored

#: Steps a unit and offset of the integer grid.
STEPS, OFFSET = 64, 1_000_000
COMPONENTS = 16
#: Passes end at once when no singular value of the rows is further from 0 and 1 than this.
ORTHOGONAL = 1e-12
PASSES = 10
#: What is added along directions without variance, once all others are orthogonal.
LIFT = 1e-10
#: A component under this share of the largest variance is rounding.
RANK = 1e-25
OUT = "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double"


def grid(v: Column) -> Column:
    """The integers of a vector."""
    return F.transform(v, lambda c: F.floor(STEPS * c.cast("double")).cast("long") + OFFSET)


class Centre:
    """n and the sums of the fit list: the exact n * x - S of rows, and the centred rows."""

    def __init__(self, n: int, sums: list[int]):
        self.n, self.sums = n, sums
        largest = max(map(abs, sums), default=0)
        self.narrow = largest < 1 << 61

    def scaled(self, x: np.ndarray) -> np.ndarray:
        """n * x - S, exact: in 64 bits where they hold it, else in Python's integers."""
        if self.narrow and (not x.size or int(np.abs(x).max()) * self.n < 1 << 61):
            return self.n * x - np.array(self.sums, np.int64)
        return self.n * x.astype(object) - np.array(self.sums, object)

    def centred(self, x: np.ndarray) -> np.ndarray:
        return self.scaled(x).astype(np.float64) / self.n

    def deviation(self, x: np.ndarray) -> list[int | None]:
        """The sum of (n * x - S)^2 by row, exact; None if a long cannot hold it."""
        d = self.scaled(x)
        if d.dtype != object and (not d.size or float(np.abs(d).max()) ** 2 * d.shape[1] < 2.0**62):
            return (d * d).sum(axis=1).tolist()
        return [t if t < 1 << 63 else None for t in (sum(int(e) ** 2 for e in row) for row in d)]


def _sums(rows: DataFrame, length: int) -> Centre:
    """n and the exact sums by dimension: 32-bit halves are summed as longs, so that no sum overflows."""
    low, high = F.expr("x & 4294967295L"), F.expr("shiftright(x, 32)")
    each = rows.select(F.posexplode("x").alias("place", "x")).groupBy("place").agg(F.count("x").alias("n"), F.sum(low).alias("low"), F.sum(high).alias("high")).orderBy("place").collect()
    return Centre(each[0]["n"] if each else 0, [(r["high"] << 32) + r["low"] for r in each])


def _gram(rows: DataFrame, length: int, project, width: int) -> np.ndarray:
    """The Gram matrix of project(rows): a part a task, added up by entry."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((width, width))
        for b in batches:
            a = project(matrix(b.column(0), length, np.int64))
            total += a.T @ a
        i, j = np.triu_indices(width)
        yield pa.RecordBatch.from_arrays([pa.array(i.astype(np.int32)), pa.array(j.astype(np.int32)), pa.array(total[i, j])], ["i", "j", "g"])

    out = np.zeros((width, width))
    for r in rows.select("x").mapInArrow(run, "i int, j int, g double").groupBy("i", "j").agg(F.sum("g").alias("g")).toLocalIterator():
        out[r["i"], r["j"]] = out[r["j"], r["i"]] = r["g"]
    return out


def solve_upper(rows: np.ndarray, factor: np.ndarray) -> np.ndarray:
    """rows times the inverse of an upper triangular factor, by substitution from its first column."""
    out = np.empty_like(rows)
    for k in range(factor.shape[0]):
        out[:, k] = (rows[:, k] - out[:, :k] @ factor[:k, k]) / factor[k, k]
    return out


def factorise(gram, length: int) -> np.ndarray:
    """R of the rows whose Gram matrix, after solves by given factors, is gram(factors)."""
    factors, r = [], np.eye(length)
    for _ in range(PASSES):
        g = gram(factors)
        values, ways = np.linalg.eigh(g)
        scale = max(values[-1], 0.0)
        if not scale:
            return np.zeros((length, length))
        if factors and np.minimum(abs(values), abs(values - 1)).max() < ORTHOGONAL:
            return np.sqrt(np.where(values < 0.5, 0, values))[:, None] * (ways.T @ r)  # nothing stays of ways that were only lifted
        flat = values < 1e-3
        if factors and (values[~flat] > 0.5).all():  # well conditioned but for ways that the rows do not span: lift only those
            shift = LIFT * ways[:, flat] @ ways[:, flat].T
        else:
            shift = 11 * length * (length + 1) * np.finfo(float).eps * scale * np.eye(length)
        factors.append(np.linalg.cholesky(g + shift).T)
        r = factors[-1] @ r
    return r


def whiten(rows: DataFrame, row_id: str = "vec_id", vector: str = "embedding", components: int = COMPONENTS) -> DataFrame:
    """For each row and component: vec_id, component, n, deviation, whitened, explained, identity_error; see the module.

    The driver holds matrices of the vectors' length squared, whatever the number of rows.
    """
    spark = rows.sparkSession
    kept, length = usable(rows, row_id, vector)
    # beyond 2^53 a double is no exact integer any more
    kept = kept.where(F.forall("v", lambda c: F.abs(STEPS * c.cast("double")) < 2.0**53)).select("id", grid(F.col("v")).alias("x"))
    fit = stored(kept.select("x").distinct())
    centre = _sums(fit, length)
    if not centre.n:
        return spark.createDataFrame([], OUT)
    root = np.sqrt(centre.n)

    def solved(factors: list[np.ndarray]):
        def project(x: np.ndarray) -> np.ndarray:
            a = centre.centred(x) / root
            for f in factors:
                a = solve_upper(a, f)
            return a

        return project

    r = factorise(lambda factors: _gram(fit, length, solved(factors), length), length)
    _, sigma, axes = np.linalg.svd(r)
    variance = sigma**2
    kept_axes = int((variance[:components] > RANK * max(variance[0], 1e-300)).sum())
    if not kept_axes:
        return spark.createDataFrame([], OUT)
    turn, explained = axes[:kept_axes].T / sigma[:kept_axes], variance[:kept_axes] / variance.sum()

    def extended(x: np.ndarray) -> np.ndarray:
        return np.hstack([np.ones((len(x), 1)), centre.centred(x) @ turn])

    moments = _gram(fit, length, extended, kept_axes + 1) / centre.n
    covariance = moments[1:, 1:] - np.outer(moments[0, 1:], moments[0, 1:])
    error = float(abs(covariance - np.eye(kept_axes)).max())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = matrix(b.column(1), length, np.int64)
            n = len(x)
            each = np.repeat(np.arange(n), kept_axes)
            yield pa.RecordBatch.from_arrays(
                [
                    b.column(0).take(pa.array(each)),
                    pa.array(np.tile(np.arange(1, kept_axes + 1, dtype=np.int32), n)),
                    pa.array(np.full(len(each), centre.n)),
                    pa.array(centre.deviation(x), pa.int64()).take(pa.array(each)),
                    pa.array((centre.centred(x) @ turn).ravel()),
                    pa.array(np.tile(explained, n)),
                    pa.array(np.full(len(each), error)),
                ],
                ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"],
            )

    return kept.mapInArrow(run, OUT)
