"""The four jobs end to end, as compositions of the operators."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.operators import dataset, evaluation, matching, raster, selection, splits
from tidemark.operators.lookups import run_summary


def match_surveys(before: DataFrame, after: DataFrame, radius: float = matching.RADIUS, min_score: float = matching.MIN_SCORE, iou: float = 0.4, near: float | None = 0.75) -> dict[str, DataFrame]:
    """Deduplicate both layers (id, box, score, volume, orientation), match them, and count what each step kept.

    Returns matches, appeared, disappeared, vectors, outcomes and summary.
    """
    kept = {}
    for name, layer in (("before", before), ("after", after)):
        k = selection.suppress(layer, 8.0, iou, near).where("leader = id")
        w, h = F.col("x2") - F.col("x1"), F.col("y2") - F.col("y1")
        kept[name] = k.withColumns({"cx": F.col("x1") + w / 2, "cy": F.col("y1") + h / 2, "area": w * h}).withColumnRenamed("id", f"{name}_id")
    found = matching.match(kept["before"], kept["after"], radius, min_score)
    counts = {"before_raw": before, "before": kept["before"], "after_raw": after, "after": kept["after"], **{n: found[n] for n in ("matches", "appeared", "disappeared")}}
    return {**found, "outcomes": matching.outcomes(found), "summary": run_summary(counts)}


def check_change(objects: DataFrame, cells: DataFrame, rows: int, lod: float = 0.1) -> DataFrame:
    """Change in elevation (z_after - z_before of cells) under each object's footprint."""
    return raster.change_stats(objects, cells.withColumn("dz", raster.clean(F.col("z_after")) - raster.clean(F.col("z_before"))), rows, lod)


def build_dataset(objects: DataFrame, tiles: DataFrame, config: DataFrame, policy: dataset.Policy) -> dict[str, DataFrame]:
    """Tiles with their split (config: tile_id, split), annotations numbered within it, counts, and leaks between splits."""
    placed = splits.membership(tiles, config, ["tile_id"])
    annotated = dataset.annotate(dataset.clip_boxes(objects, tiles), policy).join(placed.select("tile_id", "split"), "tile_id")
    kept = dataset.numbered(annotated.where("outcome NOT LIKE 'dropped%' AND split <> 'excluded'"), ["split"], ["tile_id", "object_id"], "ann_id")
    return {"tiles": placed, "annotations": kept, "counts": dataset.policy_counts(annotated, ["split"]), "leaks": splits.leakage(placed, []) if "site" not in tiles.columns else splits.leakage(placed, ["site"])}


def evaluate_tiles(images: DataFrame, dets: DataFrame, truth: DataFrame, merge_iou: float | None = None, threshold: float = 0.5) -> DataFrame:
    """Precision, recall and COCO figures of every image; with merge_iou overlapping detections are suppressed first."""
    if merge_iou is not None:
        d = dets.withColumnRenamed("det_id", "id")
        dets = selection.suppress(d, 64.0, merge_iou, group=["image_id"]).where("leader = id").withColumnRenamed("id", "det_id").drop("leader", "kept_from_n")
    return evaluation.precision_recall(images, dets, truth, threshold).join(evaluation.coco_metrics(dets, truth, ["image_id"]), "image_id", "left")
