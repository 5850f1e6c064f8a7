"""Tables of objects, tiles, detections and cells derived from the given tables, in SQL that Spark and DuckDB share."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

#: Statements in order: each may use the given tables and those before it. Rows that
#: a statement adds have negative ids (odd and even ones where it adds twice), so that
#: ids are unique at any size. There are 97 pictures for each 15,000 orders, so that boxes a picture stay as many. A grid has 1,024 cells: the orders after the last whole grid make none.
STATEMENTS = {
    "survey_before": """
SELECT p_partkey AS before_id,
  CAST((p_partkey*7919 + p_partkey*p_partkey*31) % (n*4) AS DOUBLE)/16 AS cx,
  CAST((p_partkey*104729 + p_partkey*p_partkey*17) % 8192 AS DOUBLE)/16 AS cy,
  CAST(4 + p_size % 16 AS DOUBLE)/8 AS side,
  CASE WHEN p_partkey % 5 = 0 THEN NULL ELSE CAST(2 + p_size % 12 AS DOUBLE)/8 END AS volume,
  CAST((p_partkey*37) % 180 AS DOUBLE) AS orientation,
  CAST((p_partkey*7919) % 1000 AS DOUBLE)/1024 AS score
FROM part CROSS JOIN (SELECT COUNT(*) AS n FROM part) c""",
    "survey_after": """
SELECT before_id AS after_id,
  cx + CAST((before_id*31) % 65 - 32 AS DOUBLE)/16 AS cx,
  cy + CAST((before_id*17) % 65 - 32 AS DOUBLE)/16 AS cy,
  side + CAST((before_id*13) % 5 - 2 AS DOUBLE)/16 AS side,
  volume + CAST((before_id*7) % 5 - 2 AS DOUBLE)/32 AS volume,
  CAST((CAST(orientation AS BIGINT) + before_id % 23) % 180 AS DOUBLE) AS orientation,
  score
FROM survey_before WHERE before_id % 11 <> 0
UNION ALL
SELECT -2 * before_id - 2, cx + CAST(300 AS DOUBLE)/8, cy + CAST(170 AS DOUBLE)/8,
  side, volume, orientation, score
FROM survey_before WHERE before_id % 13 = 0""",
    "match_before": """
SELECT before_id, cx, cy, side, volume, orientation, score FROM survey_before
UNION ALL
SELECT -1 - (p_partkey*8 + v.i), CAST(p_partkey*8 AS DOUBLE) + v.dx, v.cy, CAST(1 AS DOUBLE), v.vol,
  CAST(90 AS DOUBLE), CAST(1 AS DOUBLE)/2
FROM part CROSS JOIN (SELECT 0 AS i, CAST(0 AS DOUBLE)/8 AS dx, CAST(16 AS DOUBLE)/8 AS vol, CAST(2000 AS DOUBLE) AS cy
  UNION ALL SELECT 1, CAST(28 AS DOUBLE)/8, CAST(16 AS DOUBLE)/8, CAST(2000 AS DOUBLE)
  UNION ALL SELECT 2, CAST(0 AS DOUBLE)/8, CAST(8 AS DOUBLE)/8, CAST(3000 AS DOUBLE)
  UNION ALL SELECT 3, CAST(40 AS DOUBLE)/8, CAST(12 AS DOUBLE)/8, CAST(3000 AS DOUBLE)
  UNION ALL SELECT 4, CAST(80 AS DOUBLE)/8, CAST(18 AS DOUBLE)/8, CAST(3000 AS DOUBLE)) v
WHERE p_partkey % 40 = 0""",
    "match_after": """
SELECT after_id, cx, cy, side, volume, orientation, score FROM survey_after
UNION ALL
SELECT -2 * (p_partkey*8 + v.i) - 1, CAST(p_partkey*8 AS DOUBLE) + v.dx, v.cy, CAST(1 AS DOUBLE), v.vol,
  CAST(90 AS DOUBLE), CAST(1 AS DOUBLE)/2
FROM part CROSS JOIN (SELECT 0 AS i, CAST(24 AS DOUBLE)/8 AS dx, CAST(16 AS DOUBLE)/8 AS vol, CAST(2000 AS DOUBLE) AS cy
  UNION ALL SELECT 1, CAST(52 AS DOUBLE)/8, CAST(16 AS DOUBLE)/8, CAST(2000 AS DOUBLE)
  UNION ALL SELECT 2, CAST(39 AS DOUBLE)/8, CAST(12 AS DOUBLE)/8, CAST(3000 AS DOUBLE)
  UNION ALL SELECT 3, CAST(79 AS DOUBLE)/8, CAST(18 AS DOUBLE)/8, CAST(3000 AS DOUBLE)
  UNION ALL SELECT 4, CAST(119 AS DOUBLE)/8, CAST(27 AS DOUBLE)/8, CAST(3000 AS DOUBLE)) v
WHERE p_partkey % 40 = 0""",
    "tiles": """
SELECT CAST((p_partkey - p_partkey % 64) / 64 AS BIGINT) AS site, y.yr AS year,
  CAST((p_partkey % 64 - p_partkey % 8) / 8 AS BIGINT) AS tile_row, p_partkey % 8 AS tile_col,
  CAST((p_partkey % 8)*64 - (p_partkey % 64 - p_partkey % 8)*2 + y.dx AS DOUBLE) AS x1,
  CAST((p_partkey % 64 - p_partkey % 8)*8 + y.dy AS DOUBLE) AS y1,
  CAST((p_partkey % 8)*64 - (p_partkey % 64 - p_partkey % 8)*2 + y.dx + 64 AS DOUBLE) AS x2,
  CAST((p_partkey % 64 - p_partkey % 8)*8 + y.dy + 64 AS DOUBLE) AS y2,
  2 * p_partkey + CASE WHEN y.yr = 25 THEN 1 ELSE 0 END AS tile_id
FROM part CROSS JOIN (SELECT 24 AS yr, 0 AS dx, 0 AS dy UNION ALL SELECT 25, 24, 10) y""",
    "pictures": """
SELECT o_orderkey AS image_id FROM orders CROSS JOIN (SELECT 97 * greatest(1, CAST((COUNT(*) - COUNT(*) % 15000) / 15000 AS BIGINT)) AS pictures FROM orders) c WHERE o_orderkey < c.pictures""",
    "gt_boxes": """
SELECT o_orderkey AS gt_id, o_orderkey % c.pictures AS image_id,
  CAST((o_orderkey*37 + o_orderkey*o_orderkey*11) % 1500 AS DOUBLE) AS x,
  CAST((o_orderkey*53 + o_orderkey*o_orderkey*7) % 1500 AS DOUBLE) AS y,
  CAST(20 + o_orderkey % 60 AS DOUBLE) AS w, CAST(20 + o_orderkey % 45 AS DOUBLE) AS h,
  CASE WHEN o_orderkey % 17 = 0 THEN 1 ELSE 0 END AS iscrowd
FROM orders CROSS JOIN (SELECT 97 * greatest(1, CAST((COUNT(*) - COUNT(*) % 15000) / 15000 AS BIGINT)) AS pictures FROM orders) c WHERE o_orderkey % 3 = 0""",
    "detections": """
SELECT gt_id*2 AS det_id, image_id, x + CAST(gt_id % 9 AS DOUBLE) AS x, y + CAST(gt_id % 7 AS DOUBLE) AS y,
  w, h, CAST((gt_id*7919) % 1000 AS DOUBLE)/1024 AS score
FROM gt_boxes WHERE gt_id % 7 <> 0
UNION ALL
SELECT gt_id*2 + 1, image_id, x + CAST(gt_id % 13 AS DOUBLE), y + 3, w + 4, h,
  CAST((gt_id*613) % 1000 AS DOUBLE)/1024
FROM gt_boxes WHERE gt_id % 5 = 0
UNION ALL
SELECT -1 - o_orderkey, o_orderkey % c.pictures, CAST((o_orderkey*71) % 1500 AS DOUBLE),
  CAST((o_orderkey*29) % 1500 AS DOUBLE), CAST(25 AS DOUBLE), CAST(30 AS DOUBLE),
  CAST((o_orderkey*331) % 1000 AS DOUBLE)/1024
FROM orders CROSS JOIN (SELECT 97 * greatest(1, CAST((COUNT(*) - COUNT(*) % 15000) / 15000 AS BIGINT)) AS pictures FROM orders) c WHERE o_orderkey % 33 = 1""",
    "metric_events": """
SELECT event_id % 5 AS run, CAST((event_id - event_id % 5) * 100 AS BIGINT) AS iteration,
  CAST((event_id*37 + event_id*event_id*5) % 1000 AS DOUBLE)/16 AS bbox_ap50,
  CAST((event_id*53 + event_id*event_id*3) % 1000 AS DOUBLE)/16 AS segm_ap50
FROM events""",
    "dsm_cells": """
SELECT CAST((o_orderkey - o_orderkey % 1024) / 1024 AS BIGINT) AS raster_id,
  CAST((o_orderkey % 1024 - o_orderkey % 32) / 32 AS BIGINT) AS r, o_orderkey % 32 AS c,
  5 + CAST((o_orderkey*13) % 5 AS DOUBLE)/128
    + CASE WHEN (o_orderkey % 1024 - o_orderkey % 32) BETWEEN 64 AND 159 AND o_orderkey % 32 BETWEEN 2 AND 4 THEN CAST(3 AS DOUBLE)/2 ELSE CAST(0 AS DOUBLE) END AS z_before,
  5 + CAST((o_orderkey*13 + 1) % 5 AS DOUBLE)/128
    + CASE WHEN (o_orderkey % 1024 - o_orderkey % 32) BETWEEN 64 AND 159 AND o_orderkey % 32 BETWEEN 6 AND 8 THEN CAST(3 AS DOUBLE)/2 ELSE CAST(0 AS DOUBLE) END AS z_after
FROM orders
WHERE o_orderkey < (SELECT COUNT(*) - COUNT(*) % 1024 FROM orders)""",
    "manual_ann": """
SELECT before_id AS ann_fid, cx - side/2 + CAST(before_id % 5 AS DOUBLE)/16 AS x1,
  cy - side/2 AS y1, cx + side/2 + CAST(before_id % 5 AS DOUBLE)/16 AS x2, cy + side/2 AS y2
FROM survey_before WHERE before_id % 2 = 0""",
}

#: Derived tables that a statement reads.
NEEDS = {
    "survey_after": ["survey_before"],
    "match_before": ["survey_before"],
    "match_after": ["survey_before", "survey_after"],
    "detections": ["gt_boxes"],
    "manual_ann": ["survey_before"],
}
SOURCES = ("part", "orders", "events")


def needed(names: list[str]) -> list[str]:
    """The named tables and all that they read, in order of the statements."""
    out = set(names)
    for n in names:
        out.update(NEEDS.get(n, []))
    return [n for n in STATEMENTS if n in out]


def load(spark: SparkSession, sf_dir: str, *names: str) -> list[DataFrame]:
    """Derived tables as DataFrames."""
    made = {s: spark.read.parquet(f"{sf_dir}/{s}.parquet") for s in SOURCES}
    for n in needed(list(names)):
        text = STATEMENTS[n]
        used = {}
        for t in sorted(made, key=len, reverse=True):
            # table names follow FROM or JOIN
            for word in ("FROM", "JOIN"):
                if f"{word} {t} " in text + " " or f"{word} {t})" in text or f"{word} {t}\n" in text + "\n":
                    used[t] = made[t]
                    for end in (" ", ")", "\n"):
                        text = (text + "\n").replace(f"{word} {t}{end}", f"{word} {{{t}}}{end}").rstrip("\n")
        made[n] = spark.sql(text, **used)
    return [made[n] for n in names]


def with_tables(names: list[str], body: str) -> str:
    """SQL with the named derived tables defined before it; body begins with further definitions or with select."""
    defs = ",\n".join(f"{n} AS ({STATEMENTS[n]})" for n in needed(names))
    return f"WITH RECURSIVE {defs}{',' if not body.lstrip().lower().startswith('select') else ''}\n{body}"
