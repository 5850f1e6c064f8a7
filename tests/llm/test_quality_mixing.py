import zlib
from collections import Counter
from fractions import Fraction

import numpy as np
import pytest
from pyspark.sql import functions as F

from tests.conftest import SF
from tests.llm.cases import SCHEMA, documents
from tidemark.llm import mixing, quality, queries


def test_held_out_accuracy(spark):
    sf = "/root/testdata/sf0.01"
    rows = queries.op6_quality(spark, sf).join(spark.read.parquet(f"{sf}/labels.parquet"), "doc_id").where("held_out").collect()
    right = [r.predicted == r.quality for r in rows]
    assert np.mean(right) >= 0.93
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) for r in rows)


def test_votes_are_exact():
    texts = ["plain words in a row", "MORE!! NOISE!!", "other words here", "NOISE $$$ ###", "words and words"] * 3
    labels = [1, 0, 1, 0, 1] * 3
    space = quality.Space(quality.features(texts), labels, 4)
    asked = ["some words", "", "$$$ !!!", None, "x" * 100000]
    v = space.project(asked)
    want = []
    for row in v:
        near = sorted(((float(row @ u), l) for u, l in zip(space.vectors, labels)), reverse=True)[: quality.NEIGHBOURS]
        w = [max(s, 1e-3) ** quality.SHARPNESS for s, _ in near]
        want.append(sum(a * l for a, (_, l) in zip(w, near)) / sum(w))
    assert np.allclose(space.score(asked), want, atol=1e-3)
    assert (quality.Space(quality.features([]), []).score(asked) == 0.5).all()


def test_odd_rows_and_labels(spark):
    df = spark.createDataFrame(documents(), SCHEMA)
    labels = spark.createDataFrame([(1, 0, 9), (2, 1, 9), (2, 0, 9), (None, 1, 9), (5, None, 9), (7, 1, 9)], "doc_id long, quality int, text int")
    got = quality.score_quality(df, labels).collect()
    assert len(got) == len(documents())
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in got)
    none = quality.score_quality(df, labels.limit(0)).collect()
    assert {r.score for r in none} == {0.5}
    assert quality.score_quality(df.limit(0), labels).count() == 0
    assert quality.keep_good(df, labels.limit(0)).count() == len(documents())
    assert quality.keep_good(df, labels).columns == df.columns


def plain_pfair(shares, blocks):
    """Slot by slot over every block's window, from the definition: slot of each (source, block)."""
    left = {(s, j): (j / shares[s], (j + 1) / shares[s]) for s in shares for j in range(blocks.get(s, 0))}
    out, t = {}, 0
    while left:
        free = [(-(-d.numerator // d.denominator), s, j) for (s, j), (r, d) in left.items() if r.numerator // r.denominator <= t]
        if free:
            deadline, s, j = min(free)
            assert deadline > t
            del left[s, j]
            out[s, j] = t
        t += 1
    return out


def shares_of(weights):
    return {s: Fraction(w, mixing.PARTS) for s, w in mixing.whole(weights).items()}


@pytest.mark.parametrize("weights", [{"a": 1.0}, {"a": 1.0, "b": 2.0}, {"a": 3, "b": 2, "c": 1}, {"a": 17, "b": 1, "c": 1, "d": 5}, {"a": 5, "b": 5}, {"a": 0.37, "b": 0.11, "c": 2.9}])
def test_schedule_against_brute_force(weights):
    blocks = {s: 5 + 9 * k for k, s in enumerate(weights)} | {"other": 3}
    parts = mixing.whole(weights)
    got = list(mixing.schedule(parts, blocks))
    assert {(s, j): t for t, s, j in got} == plain_pfair(shares_of(weights), {s: n for s, n in blocks.items() if s in weights})
    again = []
    for slot, done, n in mixing.notes(parts, blocks, 7):
        again += list(zip(range(n), mixing.schedule(parts, blocks, dict(zip(parts, done)), slot)))
    assert [x for _, x in again] == got


@pytest.mark.parametrize("weights", [{"a": 1.0, "b": 2.0}, {"a": 0.9, "b": 0.05, "c": 0.03, "d": 0.02}, {f"s{k}": float(k % 7 + 1) ** 0.5 for k in range(20)}, {f"s{k}": 1.0 / (k + 1) for k in range(60)}, {"big": 500.0} | {f"t{k}": 1.0 for k in range(500)}])
def test_every_source_is_less_than_a_block_off_its_weight_at_every_slot(weights):
    total, slots = sum(map(Fraction, weights.values())), 20_000
    share = {s: float(Fraction(w) / total) for s, w in weights.items()}
    seen, worst = np.zeros(len(share)), 0.0
    place, want = {s: k for k, s in enumerate(share)}, np.array(list(share.values()))
    blocks = {s: int(slots * w) + 2 for s, w in share.items()}
    for t, (slot, s, j) in enumerate(mixing.schedule(mixing.whole(weights), blocks)):
        if t == slots - 10:
            break
        assert slot == t and j == seen[place[s]]
        seen[place[s]] += 1
        worst = max(worst, abs(seen - (t + 1) * want).max())
    assert worst < 1 + 1e-9


def brute_mix(rows, hashes, weights, block_chars):
    placed = []
    for s in {r[2] or "" for r in rows}:
        at = 0
        for _, i, n in sorted((hashes[r[0]] & (2**64 - 1), r[0], len(r[1] or "")) for r in rows if (r[2] or "") == s):
            placed.append((i, s, at // block_chars))
            at += n
        placed.append((None, s, at // block_chars))
    blocks = Counter()
    for _, s, block in placed:
        blocks[s] = max(blocks[s], block + 1)
    slots = plain_pfair(shares_of(weights), {s: n for s, n in blocks.items() if s in weights})
    return sorted((i, s, block, slots.get((s, block))) for i, s, block in placed if i is not None)


def test_mix_against_brute_force(spark):
    rows = [(i, t, f"s{i % 3}" if i % 4 else "hot", 1) for i, t, *_ in documents() if i is not None]
    rows += [(900, "x y", None, 1), (901, None, None, 1), (902, "late", "left out", 1)]
    rows = list({r[0]: r for r in rows}.values())
    df = spark.createDataFrame(rows, "doc_id long, text string, source string, n int").repartition(3)
    weights = {"hot": 4.0, "s0": 1.0, "s1": 2.0, "s2": 1.0, "": 0.5, "absent": 1.0}
    hashes = {r.doc_id: r.h for r in df.select("doc_id", F.xxhash64("doc_id", "text").alias("h")).collect()}
    got = mixing.mix(df, weights, 500)
    assert got.columns[:4] == df.columns
    have = sorted((r.doc_id, r.mix_source, r.mix_block, r.mix_slot if r.mix_slot < 1 << 61 else None) for r in got.collect())
    assert have == brute_mix(rows, hashes, weights, 500)
    assert mixing.mix(df.limit(0)).count() == 0


def test_rows_without_ids_or_with_one_id_all_stay_and_fill_their_blocks(spark):
    rows = [(None, "t" * (k % 9), "a", 5, "z") for k in range(60)] + [(7, "u" * (k % 13), "a", 5, "z") for k in range(80)] + [(7, "u", "b", 5, "z")] * 20
    df = spark.createDataFrame(rows, "doc_id long, text string, source string, mix_slot int, `mix_cut` string")
    got = mixing.mix(df, {"a": 1.0, "b": 1.0}, 10).toPandas()
    assert len(got) == len(rows) and got["mix_slot"].ne(5).any() and (got["mix_cut"] == "z").all()
    for s, own in got.groupby("mix_source"):
        at = 0
        for _, r in own.assign(u=own["mix_order"].astype("int64").to_numpy().view("uint64")).sort_values(["mix_block"]).iterrows():
            at += len(r["text"])
        assert own["mix_block"].max() <= at // 10
        starts = sorted(own["mix_block"])
        assert starts[0] == 0 and all(y - x <= 2 for x, y in zip(starts, starts[1:]))
    back = mixing.in_mixed_order(df, {"a": 1.0, "b": 1.0}, 10)
    assert back.columns == df.columns and sorted(map(str, back.collect())) == sorted(map(str, df.collect()))


def test_query_places_every_document(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    got = queries.op8_mixing(spark, SF).collect()
    assert sorted(r.doc_id for r in got) == sorted(r.doc_id for r in docs.collect())
    weights = mixing.smoothed_weights(docs)
    hashes = {r.doc_id: r.h for r in docs.select("doc_id", F.xxhash64("doc_id", "text").alias("h")).collect()}
    rows = [(r.doc_id, r.text, r.source) for r in docs.collect()]
    assert sorted((r.doc_id, r.source, r.block, r.slot) for r in got) == brute_mix(rows, hashes, weights, mixing.BLOCK_CHARS)


def test_mixed_order_of_rows(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    mixing.in_mixed_order(docs, block_chars=5000).write.parquet(str(tmp_path / "m"))
    back = spark.read.parquet(str(tmp_path / "m")).select("*", F.col("_metadata.file_name").alias("f"), F.col("_metadata.row_index").alias("k")).orderBy("f", "k").collect()
    slots = {r.doc_id: (r.mix_slot, r.mix_source, r.mix_order) for r in mixing.mix(docs, block_chars=5000).collect()}
    assert [r.doc_id for r in back] == sorted(slots, key=lambda i: slots[i])


def test_blocks_grow_so_that_the_driver_deals_a_bounded_number(spark, monkeypatch):
    monkeypatch.setattr(mixing, "BLOCKS", 50)
    monkeypatch.setattr(mixing, "BLOCK_CHARS", 20)
    rows = [(k, "x" * 20, "a" if k % 3 else "b") for k in range(3000)]
    got = mixing.mix(spark.createDataFrame(rows, "doc_id long, text string, source string")).toPandas()
    assert len(got) == 3000 and 50 <= len(got[["mix_source", "mix_block"]].drop_duplicates()) <= 52


def test_mix_keeps_to_the_weights(spark):
    rows = [(k, "x" * 20, "a" if k % 3 else "b") for k in range(12000)]
    got = mixing.mix(spark.createDataFrame(rows, "doc_id long, text string, source string"), {"a": 2.0, "b": 1.0}, 20).collect()
    assert len(got) == len(rows) == len({r.mix_slot for r in got})
    seen = Counter()
    for t, r in enumerate(sorted(got, key=lambda r: r.mix_slot), 1):
        seen[r.mix_source] += 1
        assert abs(seen["a"] - t * 2 / 3) < 1
