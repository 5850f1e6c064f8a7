"""Connected components, and greedy selection in a given order: inside tasks where they are small, else as rounds of joins."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.storage import stored

#: Edges that one task joins to an end; nodes that a task holds before it passes its stars on.
FEW_EDGES, TASK_NODES = 1 << 18, 1 << 19
#: Conflicts of a component that is visited inside a task.
LOCAL_PAIRS = 100_000


def _stats(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())


class Forest:
    """Sets of joined nodes, each under its smallest."""

    def __init__(self):
        self.up: dict[int, int] = {}

    def root(self, x: int) -> int:
        up = self.up
        top = x
        while (over := up.get(top, top)) != top:
            top = over
        while x != top:
            up[x], x = top, up.get(x, x)
        return top

    def join(self, a: int, b: int) -> None:
        a, b = self.root(a), self.root(b)
        self.up.setdefault(a, a)
        self.up.setdefault(b, b)
        if a != b:
            self.up[max(a, b)] = min(a, b)


def _contracted(edges: DataFrame) -> DataFrame:
    """Each task's edges as the stars of its own components: of so many edges, one less than it has nodes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forest = Forest()
        for b in batches:
            for u, v in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                forest.join(u, v)
            if len(forest.up) > TASK_NODES:
                yield from stars(forest)
                forest = Forest()
        yield from stars(forest)

    def stars(forest: Forest) -> Iterator[pa.RecordBatch]:
        ties = [(x, r) for x in forest.up if (r := forest.root(x)) != x]
        for at in range(0, len(ties), 100_000):
            u, v = zip(*ties[at : at + 100_000])
            yield pa.RecordBatch.from_arrays([pa.array(u, pa.int64()), pa.array(v, pa.int64())], ["u", "v"])

    return edges.select(F.col("u").cast("long"), F.col("v").cast("long")).mapInArrow(run, "u long, v long")


def components(edges: DataFrame) -> DataFrame:
    """edges (u, v: long) to (node, root): root is the smallest node reachable.

    Nodes without an edge to another node are left out; no edges give no rows. Of more than FEW_EDGES edges each task first
    joins those it reads, in bounded memory. While more than FEW_EDGES are left, a round ties every
    node's larger neighbours to its smallest neighbour (large-star), then its
    smaller neighbours and itself to the smallest of them (small-star); rounds grow with the logarithm
    of a component's length, and the edge table is written out after each. What is then left fits one task, which ends it.
    """
    now = stored(edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
    seen = _stats(now)
    if seen[0] > FEW_EDGES:
        now = stored(_contracted(now).distinct())
        seen = _stats(now)
    while seen[0] > FEW_EDGES:
        both = stored(now.union(now.select(F.col("v").alias("u"), F.col("u").alias("v"))))
        least = stored(both.groupBy("u").agg(F.min("v").alias("m"))).select("u", F.least("u", "m").alias("m"))
        large = stored(both.where("v > u").join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct())
        least = stored(large.groupBy("u").agg(F.min("v").alias("m")))
        small = large.join(least, "u").select(F.when(F.col("v") == F.col("m"), F.col("u")).otherwise(F.col("v")).alias("u"), F.col("m").alias("v"))
        now = stored(small.where("u <> v").distinct())
        was, seen = seen, _stats(now)
        if was == seen:
            break
    if 0 < seen[0] <= FEW_EDGES:
        now = stored(_contracted(now.coalesce(1)))
    leaves = now.groupBy("u").agg(F.min("v").alias("root")).select(F.col("u").alias("node"), "root")
    return leaves.union(now.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())


def _scan(pairs: pd.DataFrame) -> pd.DataFrame:
    """Leaders of the nodes of whole components: pairs (u, v, ru, rv) with their places in order, u before v."""
    earlier: dict[int, list[int]] = {}
    rank: dict[int, tuple] = {}
    for u, v, ru, rv in zip(pairs["u"], pairs["v"], pairs["ru"], pairs["rv"]):
        earlier.setdefault(v, []).append(u)
        rank[u], rank[v] = tuple(ru.values()), tuple(rv.values())
    leader: dict[int, int] = {}
    for x in sorted(rank, key=rank.__getitem__):
        kept = [u for u in earlier.get(x, ()) if leader[u] == u]
        leader[x] = min(kept, key=rank.__getitem__) if kept else x
    fallen = [(x, k) for x, k in leader.items() if x != k]
    return pd.DataFrame(fallen, columns=["id", "leader"], dtype="int64")


def greedy_select(nodes: DataFrame, conflicts: DataFrame, order: list[Column]) -> DataFrame:
    """Visit nodes (id: long) in order; keep a node unless a kept one conflicts with it.

    conflicts (a, b): pairs of ids, either way round. Returns id, leader: the
    node itself if kept, else the first kept node in order that conflicts with
    it. order must be total (end with the id). Nodes without conflicts keep themselves. Components
    of at most LOCAL_PAIRS conflicts are visited in order inside tasks, many in
    each. Larger ones are decided in rounds of joins: every round keeps the nodes all of whose
    earlier neighbours are decided, so no such component is gathered, and there are as many rounds as its longest
    chain of conflicts in order has decisions.
    """
    rank = F.struct(*[c.alias(f"k{i}") for i, c in enumerate(order)])
    ranked = nodes.select("id", rank.alias("rank"))
    ends = conflicts.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    ends = ends.join(ranked.select(F.col("id").alias("a"), F.col("rank").alias("ra")), "a").join(ranked.select(F.col("id").alias("b"), F.col("rank").alias("rb")), "b")
    first = F.col("ra") < F.col("rb")
    pick = lambda x, y: F.when(first, F.col(x)).otherwise(F.col(y))
    # each pair from the node visited first to the other
    pairs = stored(ends.select(pick("a", "b").alias("u"), pick("b", "a").alias("v"), pick("ra", "rb").alias("ru"), pick("rb", "ra").alias("rv")))
    roots = components(pairs).select(F.col("node").alias("u"), "root")
    rooted = pairs.join(roots, "u")
    sizes = rooted.groupBy("root").agg(F.count(F.lit(1)).alias("n"))
    large = stored(sizes.where(F.col("n") > LOCAL_PAIRS))
    small = rooted
    if not large.isEmpty():
        small = rooted.join(large.select("root"), "root", "left_anti")

    def scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: list[pd.DataFrame] = []
        for b in batches:
            held.append(b)
            if sum(map(len, held)) >= LOCAL_PAIRS:
                every = pd.concat(held)
                whole = every["root"] != every["root"].iloc[-1]
                yield _scan(every[whole])
                held = [every[~whole]]
        if held:
            yield _scan(pd.concat(held))

    found = small.repartition("root").sortWithinPartitions("root").mapInPandas(scan, "id long, leader long")
    if not large.isEmpty():
        found = found.union(_by_rounds(stored(rooted.join(large.select("root"), "root", "left_semi").select("u", "v", "ru"))))
    return nodes.select("id").join(found, "id", "left").select("id", F.coalesce("leader", "id").alias("leader"))


def _by_rounds(pairs: DataFrame) -> DataFrame:
    """Leaders of the nodes that are not kept, for pairs (u before v, rank of u)."""
    open_pairs, lost = pairs, None
    while not open_pairs.isEmpty():
        heads = open_pairs.select(F.col("u").alias("id")).distinct().join(open_pairs.select(F.col("v").alias("id")).distinct(), "id", "left_anti")
        fallen = stored(open_pairs.join(heads.withColumnRenamed("id", "u"), "u", "left_semi").select(F.col("v").alias("id")).distinct())
        lost = fallen if lost is None else stored(lost.union(fallen))
        decided = stored(heads.union(fallen))
        rest = open_pairs.join(decided.withColumnRenamed("id", "u"), "u", "left_anti")
        open_pairs = stored(rest.join(fallen.withColumnRenamed("id", "v"), "v", "left_anti").select("u", "v", "ru"))
    kept_pairs = pairs.join(lost.withColumnRenamed("id", "v"), "v", "left_semi").join(lost.withColumnRenamed("id", "u"), "u", "left_anti")
    return kept_pairs.groupBy("v").agg(F.min_by("u", "ru").alias("leader")).select(F.col("v").alias("id"), "leader")
