"""Two surveys of the same objects: candidates, one-to-one matches, outcomes."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.functions.geometry import axial_difference, pair_score, ring_box
from tidemark.functions.overlay import edges_meet
from tidemark.operators.assign import assign
from tidemark.operators.outlines import points
from tidemark.operators.overlap import covered_area, even_odd_area
from tidemark.operators.ranks import numbered
from tidemark.operators.spatial import BOX, box_pairs, distance_pairs
from tidemark.storage import stored

RADIUS, MIN_SCORE = 5.0, 0.55
ATTRIBUTES = ("cx", "cy", "area", "volume", "orientation")


def with_ids(df: DataFrame, key: str, name: str) -> DataFrame:
    """Ids 0, 1, ... in the order of a key, for layers that come without."""
    return numbered(df, [], [key], name).withColumn(name, F.col(name) - 1)


def candidates(before: DataFrame, after: DataFrame, radius: float = RADIUS, min_score: float = MIN_SCORE) -> DataFrame:
    """Pairs within radius whose score, rounded to 9 decimals, reaches min_score; both bounds count.

    before has before_id, after after_id, and both cx, cy, area, volume,
    orientation. Returns ids, dist, score and both sides' attributes (b_..., a_...).
    """
    b = before.select("before_id", F.col("cx").alias("lx"), F.col("cy").alias("ly"), *[F.col(c).alias(f"b_{c}") for c in ATTRIBUTES])
    a = after.select("after_id", F.col("cx").alias("rx"), F.col("cy").alias("ry"), *[F.col(c).alias(f"a_{c}") for c in ATTRIBUTES])
    both = distance_pairs(b, a, radius)
    terms = [tuple(F.col(f"{s}_{c}") for s in "ba") for c in ("area", "volume", "orientation")]
    scored = both.withColumn("score", F.round(pair_score(F.col("dist"), *terms, radius), 9))
    return scored.where(F.col("score") >= min_score).drop("lx", "ly", "rx", "ry")


def match(before: DataFrame, after: DataFrame, radius: float = RADIUS, min_score: float = MIN_SCORE) -> dict[str, DataFrame]:
    """matches, appeared, disappeared and vectors.

    The matching has as many pairs as possible and, among those, the highest
    total score. Without candidates everything appears or disappears.
    """
    found = stored(candidates(before, after, radius, min_score))
    pairs = stored(assign(found.select(F.col("before_id").alias("a"), F.col("after_id").alias("b"), "score")))
    chosen = pairs.select(F.col("a").alias("before_id"), F.col("b").alias("after_id"))
    matches = found.join(chosen, ["before_id", "after_id"]).select(
        "before_id",
        "after_id",
        "score",
        (F.col("a_cx") - F.col("b_cx")).alias("dx"),
        (F.col("a_cy") - F.col("b_cy")).alias("dy"),
        F.col("dist").alias("distance"),
        axial_difference(F.col("a_orientation"), F.col("b_orientation")).alias("rotation"),
        F.col("b_area").alias("before_area"),
        F.col("a_area").alias("after_area"),
        F.col("b_volume").alias("before_volume"),
        F.col("a_volume").alias("after_volume"),
        "b_cx",
        "b_cy",
        "a_cx",
        "a_cy",
    )
    return {
        "matches": matches.drop("b_cx", "b_cy", "a_cx", "a_cy"),
        "appeared": after.join(chosen, "after_id", "left_anti"),
        "disappeared": before.join(chosen, "before_id", "left_anti"),
        "vectors": matches.select("before_id", "after_id", "distance", F.array(F.struct(F.col("b_cx").alias("x"), F.col("b_cy").alias("y")), F.struct(F.col("a_cx").alias("x"), F.col("a_cy").alias("y"))).alias("line")),
    }


def hits_by_outline(objects: DataFrame, marks: DataFrame, key: str, mark: str, size: float, min_iou: float = 0.05) -> DataFrame:
    """For each object (key, ring) the marks (mark, ring) whose outlines meet its own: fids, best_fid, best_iou.

    fids are those with an IoU of min_iou or more, or all that meet it if there are none, by IoU, then id. best_fid is the
    first with any area in common. Outlines that only touch count with an IoU of 0; objects without a mark have an empty list.
    """
    side = lambda df, k, s: df.withColumn("b", ring_box(F.col("ring"))).select(F.col(k).alias(s + "id"), F.col("ring").alias(s + "ring"), *[F.col(f"b.{c}").alias(s + c) for c in BOX])
    pairs = box_pairs(side(objects, key, "l"), side(marks, mark, "r"), size).select("lid", "rid", "lring", "rring")

    def run(batches):
        for b in batches:
            iou, meet = [], []
            for x, y in zip(b["lring"], b["rring"]):
                x, y = points(x), points(y)
                shared = covered_area([x, y], 2)
                iou.append(shared / (even_odd_area(x) + even_odd_area(y) - shared) if shared > 0 else 0.0)
                meet.append(shared > 0 or edges_meet(x, y))
            yield pd.DataFrame({"lid": b["lid"], "rid": b["rid"], "iou": iou})[meet]

    hits = pairs.mapInPandas(run, "lid long, rid long, iou double")
    best = F.struct((-F.col("iou")).alias("k"), F.col("rid").alias("fid"))
    per = hits.groupBy("lid").agg(F.sort_array(F.collect_list(F.when(F.col("iou") >= min_iou, best))).alias("good"), F.sort_array(F.collect_list(best)).alias("every"), F.max("iou").alias("iou"))
    some = F.when(F.size("good") > 0, F.col("good")).otherwise(F.col("every"))
    done = objects.select(key).join(per, F.col(key) == F.col("lid"), "left")
    fids = F.coalesce(F.transform(some, lambda h: h["fid"]), F.array().cast("array<long>"))
    return done.select(key, fids.alias("fids"), F.when(F.col("iou") > 0, F.col("every")[0]["fid"]).alias("best_fid"), F.coalesce("iou", F.lit(0.0)).alias("best_iou"))


def outcomes(found: dict[str, DataFrame]) -> DataFrame:
    """One row per object: outcome, before_id, after_id, score, distance."""
    none = F.lit(None).cast("double")
    return (
        found["matches"].select(F.lit("match").alias("outcome"), "before_id", "after_id", "score", "distance")
        .union(found["appeared"].select(F.lit("appeared"), F.lit(None).cast("long"), "after_id", none, none))
        .union(found["disappeared"].select(F.lit("disappeared"), "before_id", F.lit(None).cast("long"), none, none))
    )


def outcome_accuracy(outcome: DataFrame, key: DataFrame) -> DataFrame:
    """expected, predicted, n. key: before_id, after_id (null where absent) of each true object.

    A true pair matched with something else is a wrong match; an object
    unmatched on both sides counts as disappeared.
    """
    got = outcome.where("outcome = 'match'").select("before_id", F.col("after_id").alias("got_after"))
    rev = outcome.where("outcome = 'match'").select("after_id", F.col("before_id").alias("got_before"))
    both = key.join(got, "before_id", "left").join(rev, "after_id", "left")
    expected = F.when(F.col("before_id").isNull(), "appeared").when(F.col("after_id").isNull(), "disappeared").otherwise("match")
    predicted = (
        F.when(F.col("got_after").isNotNull() & (F.col("got_after") == F.col("after_id")), "match")
        .when(F.col("got_after").isNotNull() | F.col("got_before").isNotNull(), "wrong_match")
        .when(F.col("before_id").isNotNull(), "disappeared")
        .otherwise("appeared")
    )
    return both.select(expected.alias("expected"), predicted.alias("predicted")).groupBy("expected", "predicted").agg(F.count(F.lit(1)).alias("n"))
