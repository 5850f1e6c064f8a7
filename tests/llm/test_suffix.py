import random
from collections import Counter
from hashlib import sha256

import numpy as np
import pytest

from tests.conftest import SF
from tests.llm.cases import SCHEMA, documents
from tidemark.llm import queries, suffix_dedup


def brute(rows, length):
    texts = [(t or "").encode() for _, t in rows]
    count = Counter(x[p : p + length] for x in texts for p in range(len(x) - length + 1))
    out = []
    for (d, _), x in zip(rows, texts):
        gone = bytearray(len(x))
        for p in range(len(x) - length + 1):
            if count[x[p : p + length]] > 1:
                gone[p : p + length] = b"\x01" * length
        spans = sum(1 for p in range(len(x)) if gone[p] and not (p and gone[p - 1]))
        out.append((d, len(x), sum(gone), spans, bytes(c for c, g in zip(x, gone) if not g)))
    return sorted(out, key=repr)


def rows_of(cut):
    return sorted(((r.doc_id, r.n_bytes, sum(s["last"] - s["first"] for s in r.removed), len(r.removed), bytes(r.kept)) for r in cut.collect()), key=repr)


def passages():
    rng = random.Random(5)
    say = lambda n: "".join(rng.choice("abcdefgh é") for _ in range(n))
    shared = [say(n) for n in (59, 60, 61, 80, 200)]
    rows = []
    for k in range(40):
        t = say(rng.randint(0, 90))
        for _ in range(rng.randint(0, 3)):
            s = rng.choice(shared)
            a = rng.randint(0, 5)
            t += s[a : len(s) - rng.randint(0, 5)] + say(rng.randint(0, 70))
        rows.append((k, t))
    rows += [(100, "a" * 400), (101, "ab" * 150), (102, say(61) * 3), (103, "a" * 59), (104, None), (105, "")]
    return rows


@pytest.mark.parametrize("batches,group,tasks", [(1, 4000, 500_000), (5, 4000, 100), (2, 2, 50)])
def test_repeats_against_brute_force(spark, batches, group, tasks):
    rows = passages()
    rows += [rows[3], rows[3], (None, rows[4][1]), (None, rows[5][1]), (None, rows[5][1])]
    df = spark.createDataFrame([(*r, 0, 1) for r in rows], "doc_id long, text string, k1 int, h int").repartition(3)
    assert rows_of(suffix_dedup.cut_repeats(df, 60, 16, batches, group, tasks, 40)) == brute(rows, 60)


def test_a_lying_fingerprint_is_settled_by_bytes(monkeypatch):
    rng = random.Random(1)
    say = lambda n: bytes(rng.choice(b"abc") for _ in range(n))
    core, left, right = say(30), say(40), say(40)
    contexts = [left[k:] + core + right[: 40 - k] for k in (0, 3, 9)] + [say(35) + core + right]
    h, hi = np.zeros(4, np.int64), np.array([40, 37, 31, 35])
    want = suffix_dedup._repeated_exactly(h, contexts, hi, 60)
    assert [list(x) for x in suffix_dedup.repeated_in(h, contexts, hi, suffix_dedup.Rolling(3), 60)] == [list(x) for x in want]
    monkeypatch.setattr(suffix_dedup.Rolling, "mixed", staticmethod(lambda x: x * np.uint64(0)))
    assert [list(x) for x in suffix_dedup.repeated_in(h, contexts, hi, suffix_dedup.Rolling(3), 60)] == [list(x) for x in want]


def test_odd_documents_against_brute_force(spark):
    rows = documents()
    got = rows_of(suffix_dedup.cut_repeats(spark.createDataFrame(rows, SCHEMA)))
    assert got == brute([r[:2] for r in rows], 400)


def test_query_against_brute_force(spark):
    got = sorted((tuple(r) for r in queries.op10_suffix_dedup(spark, SF).collect()), key=repr)
    rows = [tuple(r) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()]
    assert got == sorted(((*r[:4], sha256(r[4]).hexdigest()) for r in brute(rows, 400)), key=repr)
    assert any(r[2] for r in got)


def test_empty_table(spark):
    assert suffix_dedup.cut_repeats(spark.createDataFrame([], SCHEMA)).count() == 0


def test_levels_grow_geometrically(spark):
    family = suffix_dedup.Family(10)
    for k in range(6):
        family.add(spark.createDataFrame([(h, 0, k, 0, 0, 0, 0) for h in (k, 50, 60 + k // 2)], suffix_dedup.SUFFIX))
    assert [(rank, level.count()) for rank, level in family.levels] == [(2, 12), (1, 6)]
    met = {(r.h, r.k1) for r in family.found().collect()}
    assert met == {(50, k) for k in range(6)} | {(60 + k // 2, k) for k in range(6)}


def test_an_array_is_in_order_and_its_ranges_meet(spark):
    rows = [(h, c, k, k, 0, 0, 0) for k, (h, c) in enumerate([(5, 1)] * 40 + [(5, 2)] * 3 + [(6, 1)] + [(7, k) for k in range(9)] + [(8, 1)] * 2)]
    for tasks in (3, 60):
        array = suffix_dedup.array_of(spark.createDataFrame(rows, suffix_dedup.SUFFIX).repartition(4), tasks)
        assert array.count() == len(rows)
        met = {(r.h, r.c, r.k1): r.found for r in suffix_dedup.findings(array).collect()}
        assert {k for k, f in met.items() if f & suffix_dedup.REPEATED} == {(h, c, k) for h, c, k, *_ in rows if h in (5, 8)}
        assert {k[:2] for k, f in met.items() if f & suffix_dedup.SHARED} >= {(5, 1), (5, 2)} | {(7, r[1]) for r in rows if r[0] == 7}
        assert (6, 1) not in {k[:2] for k in met}


@pytest.mark.parametrize("letters", [4, 1, 2])
def test_every_string_is_of_one_suffix_that_its_bytes_fix(letters):
    rng = np.random.default_rng(0)
    data = rng.integers(97, 97 + letters, 3000).astype(np.uint8)
    data[2000:2300] = data[100:400]
    h, c, x, lo, hi = suffix_dedup.suffixes(data, suffix_dedup.Rolling(1), suffix_dedup.Rolling(2), 60, 16)
    of = {}
    for k in range(len(h)):
        for d in range(lo[k], hi[k] + 1):
            assert x[k] - d not in of
            of[int(x[k] - d)] = (int(h[k]), d)
    assert sorted(of) == list(range(len(data) - 60 + 1))
    by = {}
    for p, key in of.items():
        assert by.setdefault(data[p : p + 60].tobytes(), key) == key


def test_long_texts_are_anchored_in_stretches(monkeypatch):
    data = np.random.default_rng(0).integers(97, 99, 3000).astype(np.uint8)
    grams = suffix_dedup.Rolling(1)
    whole = suffix_dedup.anchored(grams.sums(data), grams, 60, 16)
    monkeypatch.setattr(suffix_dedup, "STRETCH", 100)
    parts = suffix_dedup.anchored(grams.sums(data), grams, 60, 16)
    each = lambda runs: np.repeat(runs[0], runs[2] - runs[1] + 1).tolist()
    assert each(whole) == each(parts)
