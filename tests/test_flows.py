from pyspark.sql import functions as F

from tests.conftest import SF
from tidemark.operators.dataset import Policy
from tidemark.plans import evaluation, flows, splits
from tidemark.plans.fixtures import load


def test_golden_scenario(spark):
    """Stayers and movers match, two vanish, two appear, a far mover does both, a doubled detection counts once."""
    before = {f"B{k}": (10.0 * k, 0.0, 2.0) for k in range(8)} | {"B9": (100.0, 50.0, 2.0), "B10": (120.0, 50.0, 2.0), "B13": (200.0, 0.0, 2.0)}
    after = {f"B{k}": (10.0 * k + 0.3 * k, 0.2, 2.0 if k else 1.8) for k in range(8)} | {"B11": (140.0, 50.0, 2.0), "B12": (160.0, 50.0, 2.0), "B13": (210.0, 0.0, 2.0)}
    ids = {n: i for i, n in enumerate(before | after)}

    def layer(objects, extra=()):
        rows = [(ids[n], x - s / 2, y - s / 2, x + s / 2, y + s / 2, 0.9, None, None) for n, (x, y, s) in objects.items()] + list(extra)
        return spark.createDataFrame(rows, "id long, x1 double, y1 double, x2 double, y2 double, score double, volume double, orientation double")

    r = flows.match_surveys(layer(before, [(99, -1.1, -1.0, 0.9, 1.0, 0.5, None, None)]), layer(after))
    assert {(m.before_id, m.after_id) for m in r["matches"].collect()} == {(ids[f"B{k}"],) * 2 for k in range(8)}
    assert {x.before_id for x in r["disappeared"].collect()} == {ids["B9"], ids["B10"], ids["B13"]}
    assert {x.after_id for x in r["appeared"].collect()} == {ids["B11"], ids["B12"], ids["B13"]}
    counts = {s.stage: s.n for s in r["summary"].collect()}
    assert counts["before_raw"] == 12 and counts["before"] == 11 and counts["matches"] == 8


def test_dataset_and_evaluation(spark):
    (tiles,) = load(spark, SF, "tiles")
    tiles = tiles.where("site = 0")
    objects = spark.createDataFrame([(1, None, 0, 1.0, 1.0, 3.0, 3.0), (2, 24, 1, 500.0, 1.0, 501.0, 2.0)], "object_id long, year int, class int, x1 double, y1 double, x2 double, y2 double")
    config = tiles.where("tile_id % 9 = 0").select("tile_id", F.lit("test").alias("split"))
    made = flows.build_dataset(objects, tiles, config, Policy())
    anns = made["annotations"].collect()
    assert sorted(a.ann_id for a in anns if a.split == anns[0].split)[0] == 1
    assert made["leaks"].count() > 0
    images, dets, truth = evaluation._sides(spark, SF)
    rows = flows.evaluate_tiles(images, dets, truth, 0.4)
    assert rows.count() == 97
    assert splits.leakage_pairs(spark, SF).count() > 0
