"""The two append-only sources as streams: metric logs and detections that arrive window by window."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.sources.manifest import stitch
from tidemark.sources.readers import parse_metric_lines


def metric_stream(spark: SparkSession, path: str) -> DataFrame:
    """run, iteration, metric, value of logs under path/<run>/, as they grow by files."""
    lines = spark.readStream.text(path).select(F.element_at(F.split(F.col("_metadata.file_path"), "/"), -2).alias("run"), "value")
    return parse_metric_lines(lines)


def best_so_far(metrics: DataFrame) -> DataFrame:
    """Best value of each run and metric and the first iteration that reached it; on a stream, a running state of a row each."""
    best = F.max(F.struct(F.col("value").alias("v"), (-F.col("iteration")).alias("i")))
    return metrics.groupBy("run", "metric").agg(best.alias("b")).select("run", "metric", F.col("b.v").alias("best"), (-F.col("b.i")).alias("iteration"))


def tile_counts(detections: DataFrame, windows: DataFrame, late: str = "10 minutes") -> DataFrame:
    """Detections (arrived, window_id, box, score) per tile and ten minutes of arrival; rows later than late are left out."""
    placed = stitch(detections.withWatermark("arrived", late), windows)
    return placed.groupBy(F.window("arrived", "10 minutes").alias("w"), "tile_id").agg(F.count(F.lit(1)).alias("n"), F.max("score").alias("best")).select(F.col("w.start").alias("start"), "tile_id", "n", "best")
