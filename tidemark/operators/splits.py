"""Hold-out designs along a coast: main axis, segments, ends, buffers, leakage.

Tiles have tile_id, x1..y2 and the columns of a group (a site, a year, ...),
within which everything is done; groups are spread over tasks.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidemark.operators.graph import greedy_select
from tidemark.operators.spatial import BOX, box_pairs, overlap_of_pair, sides
from tidemark.storage import stored

TOUCH, TOUCH_AREA, LEAK_AREA = 2.0, 0.01, 1.0
#: Edges of a group that is paired inside a task.
LOCAL_EDGES = 100_000


def axis_scores(tiles: DataFrame, group: list[str]) -> DataFrame:
    """tiles with score: place along the group's main axis, the first eigenvector of the centres' covariance.

    The axis points to smaller x (or, upright, to larger y). A single tile scores 0.
    """
    t = tiles.withColumns({"cx": (F.col("x1") + F.col("x2")) / 2, "cy": (F.col("y1") + F.col("y2")) / 2})
    m = t.groupBy(*group).agg(F.avg("cx").alias("mx"), F.avg("cy").alias("my"), F.coalesce(F.var_samp("cx"), F.lit(0.0)).alias("vx"), F.coalesce(F.var_samp("cy"), F.lit(0.0)).alias("vy"), F.coalesce(F.covar_samp("cx", "cy"), F.lit(0.0)).alias("vxy"))
    # eigenvector of [[vx, vxy], [vxy, vy]] for the larger eigenvalue
    angle = F.atan2(2 * F.col("vxy"), F.col("vx") - F.col("vy")) / 2
    m = m.withColumn("ax", F.cos(angle)).withColumn("ay", F.sin(angle))
    sign = F.when((F.col("ax") > 1e-12) | ((F.abs(F.col("ax")) <= 1e-12) & (F.col("ay") < 0)), -1.0).otherwise(1.0)
    score = sign * ((F.col("cx") - F.col("mx")) * F.col("ax") + (F.col("cy") - F.col("my")) * F.col("ay"))
    return t.join(m, group).select(*tiles.columns, F.round(score, 6).alias("score"))


def segments(scored: DataFrame, group: list[str], n: int = 12) -> DataFrame:
    """Equal-count bins in order of (score, tile_id): min(n - 1, i * n / count), whole numbers."""
    w = Window.partitionBy(*group)
    i = F.row_number().over(w.orderBy("score", "tile_id")) - 1
    return scored.withColumn("segment", F.least(F.lit(n - 1), F.floor(i * n / F.count(F.lit(1)).over(w))).cast("int"))


def buffer_tiles(tiles: DataFrame, group: list[str]) -> DataFrame:
    """tile_id of tiles with split = 'train' that, grown by TOUCH, overlap a held-out tile of the group."""
    free = tiles.where("split = 'train'").select(*group, *[F.col(c).alias("l" + c) for c in (*BOX, "tile_id")])
    held = tiles.where("split IN ('valid', 'test')").select(*group, *[F.col(c).alias("r" + c) for c in BOX])
    near = box_pairs(free, held, 64.0, group, grow=TOUCH)
    # area of the grown tile with the held-out one
    w = F.least(F.col("lx2") + TOUCH, F.col("rx2")) - F.greatest(F.col("lx1") - TOUCH, F.col("rx1"))
    h = F.least(F.col("ly2") + TOUCH, F.col("ry2")) - F.greatest(F.col("ly1") - TOUCH, F.col("ry1"))
    return near.where(w * h >= TOUCH_AREA).select(F.col("ltile_id").alias("tile_id")).distinct()


def with_buffer(tiles: DataFrame, group: list[str]) -> DataFrame:
    """tiles with split 'excluded' where buffer_tiles() says so."""
    out = buffer_tiles(tiles, group).withColumn("near", F.lit(True))
    return tiles.join(out, "tile_id", "left").withColumn("split", F.when(F.col("near"), "excluded").otherwise(F.col("split"))).select(*tiles.columns)


def block_setup(segmented: DataFrame, group: list[str], valid: list[int], test: list[int]) -> DataFrame:
    if set(valid) & set(test):
        raise ValueError("a segment cannot be both valid and test")
    split = F.when(F.col("segment").isin(valid), "valid").when(F.col("segment").isin(test), "test").otherwise("train")
    return with_buffer(segmented.withColumn("split", split), group)


def ends_setup(scored: DataFrame, group: list[str], valid: float = 0.15, test: float = 0.25) -> DataFrame:
    """The low end valid, the high end test, at least one tile each and fewer together than all; neighbours excluded.

    Where the ends would meet, the larger of the two (valid among equals)
    shrinks, one tile at a time, down to one each.
    """
    w = Window.partitionBy(*group)
    n = F.count(F.lit(1)).over(w)
    # by how much both together are too large; taken off the larger first, then off both in turn
    rows = scored.withColumns({"n": n, "i": F.row_number().over(w.orderBy("score", "tile_id")), "nv": F.greatest(F.lit(1), F.bround(n * valid)), "nt": F.greatest(F.lit(1), F.bround(n * test))})
    over = F.greatest(F.lit(0), F.col("nv") + F.col("nt") - F.col("n") + 1)
    gap = F.col("nt") - F.col("nv")
    rows = rows.withColumn("over", F.least(over, F.col("nv") + F.col("nt") - 2))
    first = F.least(F.col("over"), F.abs(gap))
    rest = F.col("over") - first
    off_v = F.when(gap < 0, first).otherwise(0) + F.ceil(rest / 2)
    off_t = F.when(gap >= 0, first).otherwise(0) + F.floor(rest / 2)
    split = F.when(F.col("i") <= F.col("nv") - off_v, "valid").when(F.col("i") > F.col("n") - (F.col("nt") - off_t), "test").otherwise("train")
    return with_buffer(rows.withColumn("split", split).drop("n", "i", "nv", "nt", "over"), group)


def leakage(tiles: DataFrame, group: list[str]) -> DataFrame:
    """Pairs of tiles of different splits (excluded aside) whose footprints share LEAK_AREA or more; none expected."""
    used = tiles.where("split <> 'excluded'")
    left = used.select(*group, *[F.col(c).alias("l" + c) for c in (*BOX, "tile_id", "split")])
    right = used.select(*group, *[F.col(c).alias("r" + c) for c in (*BOX, "tile_id", "split")])
    pairs = box_pairs(left, right, 64.0, group).where("ltile_id < rtile_id and lsplit <> rsplit")
    return pairs.where(overlap_of_pair() >= LEAK_AREA).select(F.col("ltile_id").alias("tile_a"), F.col("rtile_id").alias("tile_b"), F.col("lsplit").alias("split_a"), F.col("rsplit").alias("split_b"), overlap_of_pair().alias("area"))


def cross_year_pairs(tiles: DataFrame, group: list[str], first: int, second: int) -> DataFrame:
    """Tiles of two years paired by overlap, the largest first, each tile once; ties by ids.

    Groups of at most LOCAL_EDGES edges are walked inside tasks, many in each. In a larger one
    an edge conflicts with the edges that share a tile with it, a handful.
    """
    a, b = (sides(tiles.where(F.col("year") == y), s, ["tile_id", *group]) for y, s in ((first, "l"), (second, "r")))
    for c in group:
        a, b = a.withColumnRenamed("l" + c, c), b.withColumnRenamed("r" + c, c)
    edges = box_pairs(a, b, 64.0, group).withColumn("area", overlap_of_pair()).where(F.col("area") >= LEAK_AREA)
    edges = stored(edges.select(F.xxhash64(*group).alias("g"), F.col("ltile_id").alias("tile_a"), F.col("rtile_id").alias("tile_b"), "area"))
    large = stored(edges.groupBy("g").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > LOCAL_EDGES).select("g"))
    if large.isEmpty():
        return _walked(edges)
    return _walked(edges.join(large, "g", "left_anti")).union(_selected(stored(edges.join(large, "g", "left_semi"))))


def _walked(edges: DataFrame) -> DataFrame:
    """Edges (g, tile_a, tile_b, area) taken in order within each g, whole in a task, as long as both tiles are free."""

    def walk(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        at, used = None, set()
        for rows in batches:
            kept = []
            for g, a, b in zip(rows["g"], rows["tile_a"], rows["tile_b"]):
                if g != at:
                    at, used = g, set()
                free = (1, a) not in used and (2, b) not in used
                if free:
                    used |= {(1, a), (2, b)}
                kept.append(free)
            yield rows.loc[kept, ["tile_a", "tile_b", "area"]]

    ordered = edges.repartition("g").sortWithinPartitions("g", F.desc("area"), "tile_a", "tile_b")
    return ordered.mapInPandas(walk, edges.select("tile_a", "tile_b", "area").schema)


def _selected(edges: DataFrame) -> DataFrame:
    """The same by conflicts of edges, whatever the size of a group."""
    edges = edges.select(F.xxhash64("tile_a", "tile_b").alias("id"), "tile_a", "tile_b", "area")
    other = edges.select(F.col("id").alias("other"), F.col("tile_a").alias("ta"), F.col("tile_b").alias("tb"))
    shared = edges.join(other.hint("merge"), F.col("tile_a") == F.col("ta")).select("id", "other").union(edges.join(other.hint("merge"), F.col("tile_b") == F.col("tb")).select("id", "other"))
    chosen = greedy_select(edges, shared.where("id < other").select(F.col("id").alias("a"), F.col("other").alias("b")), [-F.col("area"), F.col("tile_a"), F.col("tile_b")])
    return edges.join(chosen.where("leader = id"), "id").select("tile_a", "tile_b", "area")


def random_setup(clusters: DataFrame, group: list[str], seed: int, valid: float = 0.15, test: float = 0.25) -> DataFrame:
    """Whole clusters (cluster, ...) dealt by a seeded hash: first valid, then test, the rest train."""
    w = Window.partitionBy(*group).orderBy(F.xxhash64("cluster", F.lit(seed)), "cluster")
    n = F.count(F.lit(1)).over(Window.partitionBy(*group))
    one = clusters.select(*group, "cluster").distinct().withColumns({"i": F.row_number().over(w), "n": n})
    nv, nt = F.greatest(F.lit(1), F.bround(F.col("n") * valid)), F.greatest(F.lit(1), F.bround(F.col("n") * test))
    dealt = one.withColumn("split", F.when(F.col("i") <= nv, "valid").when(F.col("i") <= nv + nt, "test").otherwise("train"))
    return clusters.join(dealt.drop("i", "n"), [*group, "cluster"])


def membership(tiles: DataFrame, config: DataFrame, key: list[str]) -> DataFrame:
    """tiles with the split of a config (key, split rows): excluded before valid before test, the rest train."""
    rank = F.when(F.col("split") == "excluded", 0).when(F.col("split") == "valid", 1).otherwise(2)
    one = config.groupBy(*key).agg(F.min_by("split", rank).alias("split"))
    return tiles.join(one, key, "left").withColumn("split", F.coalesce("split", F.lit("train")))


def config_faults(tiles: DataFrame, config: DataFrame, key: list[str]) -> DataFrame:
    """What is wrong with a config: hold-outs that the manifest lacks, tiles both valid and test."""
    held = config.where("split IN ('valid', 'test')")
    lacking = held.join(tiles.select(*key).distinct(), key, "left_anti").select(*key, F.lit("not_in_manifest").alias("fault"))
    both = config.where("split = 'valid'").select(*key).intersect(config.where("split = 'test'").select(*key)).withColumn("fault", F.lit("valid_and_test"))
    return lacking.distinct().union(both)


def split_map(tiles: DataFrame, setup: list[str]) -> DataFrame:
    """One row per setup: for each split a map from year to its sorted tiles."""
    per = tiles.groupBy(*setup, "split", "year").agg(F.sort_array(F.collect_set("tile")).alias("tiles"))
    maps = per.groupBy(*setup, "split").agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct("year", "tiles")))).alias("m"))
    return maps.groupBy(*setup).agg(*[F.first(F.when(F.col("split") == s, F.col("m")), ignorenulls=True).alias(s) for s in ("valid", "test", "excluded")])
