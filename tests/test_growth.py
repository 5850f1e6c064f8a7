"""Steps that must not grow faster than the input, against the same steps in another way."""

import numpy as np
import pytest

from tests.conftest import SF
from tidemark.operators import assign, evaluation, grids, groups, layers, overlap, selection, spatial, splits
from tidemark.plans import fixtures, outlines, rasters


def _plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_joins_by_place_are_not_broadcast(spark):
    box = lambda s: [f"id * 1D AS {s}x1", f"id * 1D AS {s}y1", f"id + 900D AS {s}x2", f"id + 900D AS {s}y2", f"id AS {s}id"]
    left = spark.range(10).selectExpr(*box("l"))
    right = spark.range(10).selectExpr(*box("r"))
    assert "Broadcast" not in _plan(spatial.box_pairs(left, right, 8.0))
    dots = lambda s: spark.range(10).selectExpr(f"id * 1D AS {s}x", f"id * 2D AS {s}y", f"id AS {s}id")
    assert "Broadcast" not in _plan(spatial.distance_pairs(dots("l"), dots("r"), 1.0))


def test_nearest_broadcasts_nothing_and_finds_all(spark):
    points = [(i, float(i * i % 101), float(i * 37 % 89)) for i in range(300)] + [(1000 + i, 5.0, 5.0) for i in range(40)]
    got = layers.nearest(spark.createDataFrame(points, "id long, cx double, cy double"), 3)
    assert "Broadcast" not in _plan(got)
    rows = {}
    for r in got.collect():
        rows.setdefault(r.id, []).append((r.place, r.other))
    for i, x, y in points:
        near = sorted((((x - v) ** 2 + (y - w) ** 2) ** 0.5, j) for j, v, w in points if j != i)[:3]
        assert [o for _, o in sorted(rows[i])] == [j for _, j in near]


@pytest.mark.parametrize("edges", [100_000, 0])
def test_tiles_of_two_years_need_no_components(spark, monkeypatch, edges):
    (tiles,) = fixtures.load(spark, SF, "tiles")
    if edges:
        whole = {tuple(r) for r in splits.cross_year_pairs(tiles, ["site"], 24, 25).collect()}
        monkeypatch.setattr(splits, "LOCAL_EDGES", 0)
        assert whole == {tuple(r) for r in splits.cross_year_pairs(tiles, ["site"], 24, 25).collect()}
    else:
        monkeypatch.setattr(splits, "greedy_select", None)
        assert splits.cross_year_pairs(tiles, ["site"], 24, 25).count()


def _pictures(spark, n=60):
    """Two pictures with piles of boxes and ties, one without detections, one without objects."""
    at = lambda i: (i % 2, float(i % 5 * 40), float(i % 3 * 50))
    dets = [(i, *at(i), float(i % 7) / 8 if i % 11 else None) for i in range(n)] + [(1000, 3, 0.0, 0.0, 0.5)]
    truth = [(i, *at(i), int(i % 17 == 0)) for i in range(n)] + [(1000, 2, 0.0, 0.0, 0)]
    box = ["x AS x1", "y AS y1", "x + 20 + {0} % 4 AS x2", "y + 30 - {0} % 3 AS y2"]
    d = spark.createDataFrame(dets, "det_id long, image_id long, x double, y double, score double")
    t = spark.createDataFrame(truth, "gt_id long, image_id long, x double, y double, iscrowd int")
    return d.selectExpr("det_id", "image_id", "score", *[b.format("det_id") for b in box]), t.selectExpr("gt_id", "image_id", "iscrowd", *[b.format("gt_id") for b in box])


def _rows(df) -> list:
    return sorted(map(str, df.collect()))


def test_images_are_matched_without_components_and_large_ones_alike(spark, monkeypatch):
    dets, truth = _pictures(spark)
    with monkeypatch.context() as m:
        m.setattr(evaluation, "components", None)
        whole = _rows(evaluation.greedy_match(dets, truth))
    assert sum("gt_id=None" not in r for r in whole) > 40
    monkeypatch.setattr(groups, "LOCAL_BOXES", 2)
    assert _rows(evaluation.greedy_match(dets, truth)) == whole


def _piles(spark):
    """Boxes of three groups and of none, in piles, some nested, with ties and missing scores and corners."""
    rows = [(i, i % 3 if i % 29 else None, float(i % 5 * 30 + i % 4), float(i % 2 * 40), float(8 + i % 6 * 7), float(i * 7 % 10) / 8 if i % 13 else None) for i in range(240)]
    d = spark.createDataFrame(rows, "id long, g long, x1 double, y1 double, w double, score double")
    return d.selectExpr("id", "g", "CASE WHEN id % 37 > 0 THEN x1 END AS x1", "y1", "x1 + w AS x2", "y1 + w + id % 3 AS y2", "score")


def test_boxes_of_a_group_are_chosen_in_a_task_and_large_groups_alike(spark, monkeypatch):
    boxes = _piles(spark)
    chosen = lambda: [
        _rows(selection.suppress(boxes, 16.0, 0.4, group=["g"]).select("id", "leader", "kept_from_n")),
        _rows(selection.merge_under_leaders(boxes, 16.0, group=["g"])),
        _rows(selection.merge_under_leaders(boxes, 16.0, min_ratio=None, min_group=2, nested=False, group=["g"])),
    ]
    with monkeypatch.context() as m:
        m.setattr(selection, "greedy_select", None)
        whole = chosen()
    assert all(0 < len(rows) for rows in whole)
    monkeypatch.setattr(groups, "LOCAL_BOXES", 2)
    assert chosen() == whole


def test_pictures_are_compared_in_tasks_and_large_ones_alike(spark, monkeypatch):
    dets, truth = _pictures(spark)
    with monkeypatch.context() as m:
        m.setattr(evaluation, "overlaps", None)
        whole = _rows(evaluation.coco_matches(dets.where("score IS NOT NULL"), truth))
    assert any("tp=True" in r for r in whole) and any("ignored=True" in r for r in whole)
    monkeypatch.setattr(groups, "LOCAL_BOXES", 2)
    assert _rows(evaluation.coco_matches(dets.where("score IS NOT NULL"), truth)) == whole


def test_differences_are_computed_once(spark):
    assert "Pandas" not in _plan(rasters.change_qc(spark, SF))


@pytest.mark.parametrize("query", [rasters.chunk_relief, rasters.chunk_median, rasters.grid_difference])
def test_chunks_go_through_tasks_in_batches_and_to_all_cores(spark, query):
    plan = _plan(query(spark, SF))
    assert "GroupsInPandas" not in plan and "REPARTITION_BY_NUM" in plan and "map_from_entries" not in plan


def test_chunks_of_cells_in_any_order_with_gaps(spark):
    cells = [(0, r, c, float(r * 100 + c) if (r + c) % 5 else None) for r in range(40) for c in range(30) if (r * c) % 7 != 3]
    made = grids.chunks(spark.createDataFrame(cells[::-1], "raster_id long, r long, c long, z double"), "z", 16)
    got = {(x.r, x.c): x.z for x in grids.cells_of(made).collect()}
    given = {(r, c): z for _, r, c, z in cells}
    assert len(got) == 40 * 30 and all(given.get(k) == z for k, z in got.items())


@pytest.mark.parametrize("query", [outlines.outline_union, outlines.tile_clip_rings, outlines.ring_repair])
def test_outlines_go_through_tasks_in_batches_and_to_all_cores(spark, query):
    plan = _plan(query(spark, SF))
    assert "GroupsInPandas" not in plan and "REPARTITION_BY_NUM" in plan


def test_overlaps_of_many_pairs_are_those_of_each(spark, monkeypatch):
    rings = [[(float(i * k * 7 % 13), float((i + k * k * 5) % 11)) for k in range(3 + i % 4)] for i in range(60)]
    rings += [[(x + 2.0, y), (x, y + 2.0), (x - 2.0, y), (x, y - 2.0)] for x in (3.0, 4.5, 9.0) for y in (3.0, 5.0)]
    flat = np.empty(len(rings), object)
    for k, r in enumerate(rings):
        flat[k] = np.array(r).ravel()
    i, j = (v.ravel() for v in np.indices((len(rings), len(rings))))
    want = [overlap.covered_area([rings[a], rings[b]], 2) for a, b in zip(i, j)]
    assert overlap.shared_areas(flat[i], flat[j]) == pytest.approx(np.array(want))
    monkeypatch.setattr(overlap, "FEW", 0)
    assert overlap.shared_areas(flat[i], flat[j]) == pytest.approx(np.array(want))
    assert overlap.even_odd_areas(flat) == pytest.approx(np.array([overlap.even_odd_area(r) for r in rings]))


def test_components_are_assigned_in_batches_on_all_cores(spark):
    # pairs of their own, and squares in which the best pair must not be taken
    pairs = [(4 * k, 4 * k, 0.9) for k in range(30)] + [(4 * k + i, 4 * k + j, s) for k in range(30, 60) for i, j, s in ((1, 1, 0.9), (1, 2, 0.8), (2, 1, 0.8))]
    chosen = assign.assign(spark.createDataFrame(pairs, "a long, b long, score double"))
    assert "GroupsInPandas" not in _plan(chosen) and "REPARTITION_BY_NUM" in _plan(chosen)
    assert sorted((r.a, r.b) for r in chosen.collect()) == sorted([(4 * k, 4 * k) for k in range(30)] + [p for k in range(30, 60) for p in ((4 * k + 1, 4 * k + 2), (4 * k + 2, 4 * k + 1))])
