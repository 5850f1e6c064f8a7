"""Nearest neighbours by a learned partition of the vectors.

Fit, on a bounded sample of the distinct vectors (those of the smallest hashes, SAMPLE_VALUES
numbers at most): the graph of each sample vector's nearest ones is cut into
parts of equal size, halving again and again along the slowest mode of the
graph and exchanging vertices while that cuts fewer edges. A small network with one
hidden layer then learns which parts a vector's neighbours lie in. How many of the most
probable parts a query must visit is measured on sample vectors that the network
has not seen: the fewest that reach RECALL there.

Index: each distinct vector goes to its most probable part, with the smallest
ids of the rows that have it (as many as an answer can hold and one more, the query itself; a row
beyond them can be in no answer). Large parts are cut into blocks, so no part is
one task's whatever its size. Search: a query meets the blocks of the
parts it visits; exact inner products in double precision, summed in the order
of the dimensions, rank what they hold, and the best of all blocks are its answer.
A query visits further parts until those it visits hold enough vectors, so
that it gets fewer than asked only if there are no more rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidemark.llm.vectors import matrix, usable
from tidemark.storage import stored

NEAREST = 20
#: Numbers in the sample: 16,384 vectors of 64.
SAMPLE_VALUES = 1 << 20
#: Sample vectors for each part, and parts at most.
PART_SAMPLE, PARTS = 64, 64
#: Neighbours of a vertex in the graph, and hidden units of the network.
EDGES, HIDDEN = 20, 128
#: Share of the true neighbours that the calibration must find.
RECALL = 0.97
#: Numbers in a block of vectors (16,384 vectors of 64), and queries that meet it in one task.
BLOCK_VALUES, QUERY_ROWS = 1 << 20, 8192
OUT = "query_id long, rank int, vec_id long, score double"


def nearest_in_sample(spark, sample: np.ndarray, k: int) -> np.ndarray:
    """The k nearest sample vectors of each, nearest first: blocks of rows in tasks, against the sample as a broadcast."""
    n, step = len(sample), 512
    shared = spark.sparkContext.broadcast(sample)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for first in b.column(0).to_pylist():
                s = shared.value[first : first + step] @ shared.value.T
                s[np.arange(len(s)), np.arange(first, first + len(s))] = -np.inf
                best = np.argpartition(-s, min(k, n - 1) - 1, axis=1)[:, :k]
                best = np.take_along_axis(best, np.argsort(-np.take_along_axis(s, best, 1), axis=1), 1)
                yield pa.RecordBatch.from_arrays([pa.array(np.arange(first, first + len(s))), pa.array(list(best.astype(np.int64)), pa.list_(pa.int64()))], ["at", "best"])

    rows = spark.range(0, n, step, numPartitions=min(64, -(-n // step))).mapInArrow(run, "at long, best array<long>").collect()
    return np.array([r["best"] for r in sorted(rows, key=lambda r: r["at"])])


def halves(a: np.ndarray, b: np.ndarray, n: int, rng: np.random.Generator) -> np.ndarray:
    """Which of n vertices, joined by the edges a-b (each both ways), are in the second half: cut few edges, sizes equal."""
    degree = np.bincount(a, minlength=n) + 1e-9
    mode = rng.standard_normal(n)
    for _ in range(60):  # power steps of the lazy walk: its slowest mode but the constant
        mode -= (mode * degree).sum() / degree.sum()
        mode = (mode + np.bincount(a, mode[b], n) / degree) / 2
        mode /= np.abs(mode).max() + 1e-300
    side = np.zeros(n, bool)
    side[np.argsort(mode, kind="stable")[n // 2 :]] = True
    for _ in range(20):  # exchange the pairs that gain most, half of them at a time
        across = np.bincount(a, side[b] != side[a], n)
        gain = 2 * across - np.bincount(a, minlength=n)
        one, two = np.flatnonzero(side), np.flatnonzero(~side)
        one, two = one[np.argsort(-gain[one], kind="stable")], two[np.argsort(-gain[two], kind="stable")]
        m = min(len(one), len(two))
        better = int((gain[one[:m]] + gain[two[:m]] > 0).sum())
        if not better:
            break
        trial = side.copy()
        swap = (better + 1) // 2
        trial[one[:swap]], trial[two[:swap]] = False, True
        if (trial[a] != trial[b]).sum() >= (side[a] != side[b]).sum():
            break
        side = trial
    return side


def balanced_parts(nearest: np.ndarray, parts: int, seed: int = 11) -> np.ndarray:
    """The part of each vertex of the neighbour graph: parts (a power of two) of equal size."""
    n, k = nearest.shape
    a, b = np.repeat(np.arange(n), k), nearest.ravel()
    a, b = np.concatenate([a, b]), np.concatenate([b, a])
    part, rng = np.zeros(n, np.int64), np.random.default_rng(seed)
    while part.max() + 1 < parts:
        finer = np.zeros(n, np.int64)
        for p in range(part.max() + 1):
            own = np.flatnonzero(part == p)
            place = np.full(n, -1)
            place[own] = np.arange(len(own))
            inside = (place[a] >= 0) & (place[b] >= 0)
            finer[own] = 2 * p + halves(place[a[inside]], place[b[inside]], len(own), rng)
        part = finer
    return part


@dataclass
class Router:
    """The network: probabilities of the parts for vectors; visits: how many parts a query visits."""

    weights: list[np.ndarray]
    visits: int

    def probabilities(self, v: np.ndarray) -> np.ndarray:
        w1, b1, w2, b2 = self.weights
        hidden = np.maximum(_unit(v) @ w1 + b1, 0)
        z = hidden @ w2 + b2
        z = np.exp(z - z.max(axis=1, keepdims=True))
        return z / z.sum(axis=1, keepdims=True)


def _unit(v: np.ndarray) -> np.ndarray:
    """Directions: inner products with a query rank as the query's length leaves them."""
    scale = np.abs(v).max(axis=1, keepdims=True)
    v = v / np.where(scale > 0, scale, 1)
    return v / np.maximum(np.sqrt((v * v).sum(axis=1, keepdims=True)), 1e-300)


def train(v: np.ndarray, share: np.ndarray, seed: int = 5, rounds: int = 20, batch: int = 256, rate: float = 3e-3) -> list[np.ndarray]:
    """Weights that predict share (rows of probabilities) from v: cross entropy, Adam."""
    rng, v = np.random.default_rng(seed), _unit(v)
    d, k = v.shape[1], share.shape[1]
    w = [rng.standard_normal((d, HIDDEN)) * np.sqrt(2 / HIDDEN) * 2, np.zeros(HIDDEN), rng.standard_normal((HIDDEN, k)) / np.sqrt(HIDDEN), np.zeros(k)]
    first, second, t = [np.zeros_like(x) for x in w], [np.zeros_like(x) for x in w], 0
    total = rounds * -(-len(v) // batch)
    for _ in range(rounds):
        order = rng.permutation(len(v))
        for at in range(0, len(v), batch):
            x, y = v[order[at : at + batch]], share[order[at : at + batch]]
            h = np.maximum(x @ w[0] + w[1], 0)
            z = h @ w[2] + w[3]
            z = np.exp(z - z.max(axis=1, keepdims=True))
            off = (z / z.sum(axis=1, keepdims=True) - y) / len(x)
            back = (off @ w[2].T) * (h > 0)
            t += 1
            step = rate * (1 - t / (total + 1))
            for i, g in enumerate((x.T @ back, back.sum(axis=0), h.T @ off, off.sum(axis=0))):
                first[i] = 0.9 * first[i] + 0.1 * g
                second[i] = 0.999 * second[i] + 0.001 * g * g
                w[i] -= step * first[i] / (1 - 0.9**t) / (np.sqrt(second[i] / (1 - 0.999**t)) + 1e-8)
    return w


def fit(spark, sample: np.ndarray, recall: float = RECALL, parts: int = PARTS, part_sample: int = PART_SAMPLE) -> Router:
    """The router of a sample of distinct vectors (at least two of them).

    The graph is made by tasks. One task cuts it and trains: the sample is bounded, and a task's numpy keeps to its own core.
    """
    n = len(sample)
    parts = max(1, min(parts, 1 << max(0, (n // part_sample).bit_length() - 1)))
    nearest = nearest_in_sample(spark, sample, min(EDGES, n - 1))
    shared = spark.sparkContext.broadcast((sample, nearest))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                router = learn(*shared.value, parts, recall)
                flat = [w.ravel().tolist() for w in router.weights]
                yield pa.RecordBatch.from_arrays([pa.array([flat], pa.list_(pa.list_(pa.float64()))), pa.array([router.visits])], ["weights", "visits"])

    got = spark.range(1, numPartitions=1).mapInArrow(run, "weights array<array<double>>, visits long").first()
    shapes = [(sample.shape[1], HIDDEN), (HIDDEN,), (HIDDEN, parts), (parts,)]
    return Router([np.array(w).reshape(shape) for w, shape in zip(got["weights"], shapes)], got["visits"])


def learn(sample: np.ndarray, nearest: np.ndarray, parts: int, recall: float) -> Router:
    """Cut the graph, train the network on seven eighths of the sample, and measure on the rest how many parts to visit."""
    n = len(sample)
    part = balanced_parts(nearest, parts)
    share = np.zeros((n, parts))
    np.add.at(share, (np.arange(n), part), 1.0)
    np.add.at(share, (np.repeat(np.arange(n), nearest.shape[1]), part[nearest].ravel()), 1.0)
    share /= share.sum(axis=1, keepdims=True)
    seen = np.arange(n) % 8 != 7
    router = Router(train(sample[seen], share[seen]), parts)
    chance = router.probabilities(sample)
    held = np.flatnonzero(~seen) if n >= 8 else np.arange(n)
    # the neighbours lie where the index puts them: in their own most probable part
    place = np.argsort(np.argsort(-chance[held], axis=1, kind="stable"), axis=1, kind="stable")
    depth = np.take_along_axis(place, chance.argmax(axis=1)[nearest[held]], axis=1)
    found = [(depth <= m).mean() for m in range(parts)]
    router.visits = 1 + next(m for m, f in enumerate(found) if f >= min(recall, found[-1]))
    return router


def search(rows: DataFrame, row_id: str = "vec_id", vector: str = "embedding", every: int = 20, nearest: int = NEAREST, recall: float = RECALL, sample_values: int = SAMPLE_VALUES, block_values: int = BLOCK_VALUES, query_rows: int = QUERY_ROWS) -> DataFrame:
    """The nearest rows (largest inner product, ties to the smaller id) of each row whose id is divisible by every: query_id, rank, vec_id, score.

    Rows without an id, and rows whose vector is null, empty, zero, holds a null or non-finite
    entry or is not of the commonest length, take no part. Rows repeated in id and
    vector are one row; of rows that share an id and differ in their vectors each
    is a row of its own and a candidate of the others. An empty table gives no rows.
    """
    spark = rows.sparkSession
    kept, length = usable(rows, row_id, vector)
    kept = kept.where(F.col("id").isNotNull() & F.exists("v", lambda c: c != 0)).distinct()
    own = Window.partitionBy("v").orderBy("id")
    few = kept.withColumn("at", F.row_number().over(own)).where(F.col("at") <= nearest + 1)
    vectors = stored(few.groupBy("v").agg(F.array_sort(F.collect_list("id")).alias("ids")))
    top = vectors.select("v", F.xxhash64("v").alias("h")).orderBy("h", "v").limit(max(2, sample_values // max(length, 1))).select("v").collect()
    if not top:
        return spark.createDataFrame([], OUT)
    sample = np.array([r["v"] for r in top], np.float64)
    router = fit(spark, sample, recall) if len(sample) > 1 else Router([np.zeros((length, HIDDEN)), np.zeros(HIDDEN), np.zeros((HIDDEN, 1)), np.zeros(1)], 1)

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            part = router.probabilities(matrix(b.column(0), length)).argmax(axis=1).astype(np.int32)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(part)], ["v", "ids", "part"])

    kind = dict(vectors.dtypes)["v"]
    indexed = stored(vectors.mapInArrow(assign, f"v {kind}, ids array<long>, part int"))
    held = {r["part"]: r["count"] for r in indexed.groupBy("part").count().collect()}
    sizes = np.array([held.get(p, 0) for p in range(router.weights[3].size)])

    def route(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            order = np.argsort(-router.probabilities(matrix(b.column(1), length)), axis=1, kind="stable")
            before = np.cumsum(sizes[order], axis=1) - sizes[order]
            go = (np.arange(order.shape[1]) < router.visits) | (before <= nearest)
            at, column = np.nonzero(go & (sizes[order] > 0))
            picked = pa.array(at)
            yield pa.RecordBatch.from_arrays([b.column(0).take(picked), b.column(1).take(picked), b.column(2).take(picked), pa.array(order[at, column].astype(np.int32))], ["id", "v", "h", "part"])

    queries = stored(kept.where(F.col("id") % every == 0).select("id", "v", F.xxhash64("v").alias("h")).mapInArrow(route, f"id long, v {kind}, h long, part int"))
    asked = {r["part"]: r["count"] for r in queries.groupBy("part").count().collect()}
    block_rows = max(1, block_values // length)
    plan = spark.createDataFrame([(p, -(-n // block_rows), max(1, -(-asked.get(p, 0) // query_rows))) for p, n in held.items()], "part int, blocks int, groups int")
    left = indexed.join(F.broadcast(plan), "part").select("v", "ids", "part", F.pmod(F.xxhash64("v"), F.col("blocks")).alias("block"), F.explode(F.sequence(F.lit(0), F.col("groups") - 1)).alias("group"))
    right = queries.join(F.broadcast(plan), "part").select("id", "v", "h", "part", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks").cast("long") - 1)).alias("block"), F.pmod(F.xxhash64("id", "h"), F.col("groups")).cast("int").alias("group"))

    def meet(candidates: pa.Table, asking: pa.Table) -> pa.Table:
        qid, qh, vid, score = best_of(
            matrix(candidates["v"].combine_chunks(), length),
            candidates["ids"].combine_chunks(),
            matrix(asking["v"].combine_chunks(), length) if asking.num_rows else np.empty((0, length)),
            asking["id"].to_numpy(),
            asking["h"].to_numpy(),
            nearest,
        ) if candidates.num_rows else ([], [], [], [])
        return pa.table({"query_id": pa.array(qid, pa.int64()), "h": pa.array(qh, pa.int64()), "vec_id": pa.array(vid, pa.int64()), "score": pa.array(score, pa.float64())})

    key = ["part", "block", "group"]
    found = left.groupBy(*key).cogroup(right.groupBy(*key)).applyInArrow(meet, "query_id long, h long, vec_id long, score double")
    ranked = found.withColumn("rank", F.row_number().over(Window.partitionBy("query_id", "h").orderBy(F.desc("score"), "vec_id")))
    return ranked.where(F.col("rank") <= nearest).select("query_id", F.col("rank").cast("int"), "vec_id", "score")


def best_of(vectors: np.ndarray, ids: pa.ListArray, asking: np.ndarray, query_ids: np.ndarray, hashes: np.ndarray, nearest: int, step: int = 256) -> tuple:
    """For each query the nearest rows of a block: ids, hashes, rows' ids and scores.

    A matrix product finds each query's best vectors, with all that rounding may
    have put behind them; these are then summed again in a fixed order.
    """
    offsets, flat = ids.offsets.to_numpy(), ids.flatten().to_numpy()
    offsets = offsets - offsets[0]
    out = [[], [], [], []]
    reach = np.sqrt((vectors * vectors).sum(axis=1).max())
    for at in range(0, len(asking), step):
        q = asking[at : at + step]
        s = q @ vectors.T
        cut = min(nearest + 1, s.shape[1])
        worst = np.partition(s, s.shape[1] - cut, axis=1)[:, s.shape[1] - cut]
        least = worst - 1e-12 * np.sqrt((q * q).sum(axis=1)) * reach
        a, b = np.nonzero(s >= np.where(np.isnan(least), -np.inf, least)[:, None])
        exact = np.zeros(len(a))
        for k in range(vectors.shape[1]):
            exact += q[a, k] * vectors[b, k]
        count = offsets[b + 1] - offsets[b]
        each = np.repeat(np.arange(len(a)), count)
        row = flat[np.arange(len(each)) - np.repeat(np.cumsum(count) - count, count) + offsets[b][each]]
        who, score = at + a[each], exact[each]
        other = row != query_ids[who]
        same = np.flatnonzero(~other)
        other[same] = (q[a[each[same]]] != vectors[b[each[same]]]).any(axis=1)
        who, row, score = who[other], row[other], score[other]
        order = np.lexsort((row, -score, who))
        who, row, score = who[order], row[order], score[order]
        starts = np.searchsorted(who, who)
        keep = np.arange(len(who)) - starts < nearest
        for o, x in zip(out, (query_ids[who[keep]], hashes[who[keep]], row[keep], score[keep])):
            o.append(x)
    return tuple(np.concatenate(o) if o else o for o in out)
