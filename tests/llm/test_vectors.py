"""Nearest neighbours and whitening against plain versions."""

import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tests.conftest import SF
from tidemark.llm import learned_index, queries, whitening

SCHEMA = "vec_id long, embedding array<float>, label int, id long, v long, x long, n long, part int, rank int, at int"


def odd_rows(seed=3, n=300, d=6):
    """Rows with nulls, zero and non-finite vectors, copies, repeated rows and ids, and a length of their own."""
    rng = np.random.default_rng(seed)
    vectors = np.round(rng.standard_normal((n, d)), 2).astype(np.float32)
    vectors[40:140] = vectors[40]  # a hot vector
    vectors[150:180, 1] = 0
    rows = [(i, [float(e) for e in v]) for i, v in enumerate(vectors)]
    rows += [(n, None), (n + 1, []), (n + 2, [0.0] * d), (n + 3, [1.0] * (d - 1) + [None]), (n + 4, [math.nan] * d), (n + 5, [math.inf] * d), (n + 6, [1.0] * (d + 1)), (None, [1.0] * d)]
    rows += [rows[0], rows[20], (20, rows[41][1]), (-20, [2.0] * d)]
    return [(i, v, 1, 2, 3, 4, 5, 6, 7, 8) for i, v in rows]


def plain_nearest(rows, k=20, every=20):
    ok = sorted({(i, tuple(v)) for i, v, *_ in rows if i is not None and v is not None and len(v) == 6 and all(e is not None and math.isfinite(e) for e in v) and any(v)})
    out = []
    for i, v in ok:
        if i % every == 0:
            score = {}
            for j, w in ok:
                if (i, v) != (j, w):
                    s = 0.0
                    for a, b in zip(v, w):
                        s += float(a) * float(b)
                    score[j, w] = s
            best = sorted(score, key=lambda c: (-score[c], c[0]))[:k]
            out += [(i, r + 1, c[0], score[c]) for r, c in enumerate(best)]
    return sorted(out)


@pytest.mark.parametrize("limits", [{}, {"block_values": 60, "query_rows": 3}])
def test_nearest_is_brute_force_where_every_part_is_visited(spark, limits):
    rows = odd_rows()
    got = learned_index.search(spark.createDataFrame(rows, SCHEMA), recall=1.1, **limits)
    assert sorted(map(tuple, got.collect())) == plain_nearest([(i, None if v is None else [None if e is None else float(np.float32(e)) for e in v]) for i, v, *_ in rows])


def test_fewer_candidates_than_asked_and_no_rows(spark):
    rows = spark.createDataFrame([(0, [1.0, 0.0]), (20, [0.5, 0.5]), (21, [0.5, 0.5])], "vec_id long, embedding array<double>")
    assert sorted(map(tuple, learned_index.search(rows).collect())) == [(0, 1, 20, 0.5), (0, 2, 21, 0.5), (20, 1, 0, 0.5), (20, 2, 21, 0.5)]
    assert learned_index.search(rows.where("vec_id = 0")).count() == 0
    assert learned_index.search(rows.where("false")).count() == 0


def test_recall_over_the_whole_table(spark):
    table = spark.read.parquet(SF.replace("sf0.001", "sf0.1") + "/embeddings.parquet")
    got = queries.op11_nearest_neighbours(spark, SF.replace("sf0.001", "sf0.1")).toPandas()
    rows = table.toPandas()
    v, ids = np.array(rows["embedding"].tolist(), float), rows["vec_id"].to_numpy()
    asked = np.flatnonzero(ids % 20 == 0)
    s = v[asked] @ v.T
    s[np.arange(len(asked)), asked] = -np.inf
    best = np.argsort(-s, axis=1)[:, :20]
    found = sum(len(set(ids[b]) & set(g)) for b, (_, g) in zip(best, got.sort_values("query_id").groupby("query_id")["vec_id"]))
    assert found / best.size >= 0.9 and (got.groupby("query_id").size() == 20).all()
    assert np.allclose(got["score"], (v[np.searchsorted(ids, got["query_id"])] * v[np.searchsorted(ids, got["vec_id"])]).sum(axis=1), rtol=1e-12, atol=1e-14)


def test_parts_are_balanced_and_cut_few_edges():
    rng = np.random.default_rng(1)
    v = np.concatenate([rng.standard_normal((128, 8)) * 0.1 + c for c in np.eye(8)[:4] * 5])
    s = -((v[:, None] - v[None]) ** 2).sum(axis=2)
    np.fill_diagonal(s, -np.inf)
    near = np.argsort(-s, axis=1)[:, :10]
    part = learned_index.balanced_parts(near, 4)
    assert (np.bincount(part) == 128).all() and (part[near] == part[:, None]).mean() > 0.99


def plain_white(x):
    fit = np.unique(x, axis=0)
    n, s = len(fit), fit.sum(axis=0)
    c = (n * fit - s) / n
    val, vec = np.linalg.eigh(c.T @ c / n)
    return n, s, val[::-1], vec[:, ::-1]


def check_white(got: pd.DataFrame, ids, x, components):
    n, s, val, vec = plain_white(x)
    want = ((n * x - s) / n) @ vec[:, :components] / np.sqrt(val[:components])
    for k in range(components):
        own = got[got["component"] == k + 1].set_index("vec_id")
        assert (own["n"] == n).all() and (own.loc[ids, "deviation"].to_numpy() == ((n * x - s) ** 2).sum(axis=1)).all()
        w = own.loc[ids, "whitened"].to_numpy()
        assert min(abs(w - want[:, k]).max(), abs(w + want[:, k]).max()) < 1e-8
        assert np.allclose(own["explained"], val[k] / val.sum(), rtol=1e-9)
    assert got["component"].max() == components and (got["identity_error"] < 1e-9).all() and got["identity_error"].nunique() == 1


def test_whitening_of_the_whole_table(spark):
    rows = spark.read.parquet(SF + "/embeddings.parquet").toPandas()
    x = np.floor(64 * np.array(rows["embedding"].tolist(), float)).astype(np.int64) + 1_000_000
    check_white(queries.op12_whitening(spark, SF).toPandas(), rows["vec_id"], x, 16)


def test_whitening_of_odd_rows_and_of_rows_that_do_not_span(spark):
    rows = odd_rows()
    got = whitening.whiten(spark.createDataFrame(rows, SCHEMA)).toPandas()
    assert len(got) == 6 * sum(v is not None and len(v) == 6 and all(e is not None and math.isfinite(e) for e in v) for _, v, *_ in rows)
    rng = np.random.default_rng(2)
    x = rng.integers(-9, 9, (80, 3)) @ np.array([[64, 64, 0, 128, 0], [0, 64, 64, 0, 64], [64, 0, 0, 0, 128]])
    plane = spark.createDataFrame([(i, (v / 64).tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    check_white(whitening.whiten(plane).toPandas(), np.arange(80), x + 1_000_000, 3)
    assert whitening.whiten(plane.where("vec_id = 3")).count() == 0
    assert whitening.whiten(plane.where("false")).count() == 0


def test_small_variances_keep_their_precision(spark):
    rng = np.random.default_rng(4)
    x = np.floor(rng.standard_normal((400, 6)) @ np.diag([1e9, 1e7, 1e5, 1e3, 1e2, 10.0])).astype(np.int64)
    got = whitening.whiten(spark.createDataFrame([(i, (v / 64).tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")).toPandas()
    assert got["component"].max() == 6 and (got["identity_error"] < 1e-4).all()
    one = got[got["vec_id"] == 0]["deviation"].iloc[0]
    shifted = x + 1_000_000
    n, s = len(np.unique(shifted, axis=0)), [int(t) for t in np.unique(shifted, axis=0).sum(axis=0)]
    want = sum((n * int(e) - t) ** 2 for e, t in zip(shifted[0], s))
    assert (pd.isna(one) and want >= 1 << 63) or one == want


def test_triangular_solves():
    rng = np.random.default_rng(0)
    r = np.triu(rng.standard_normal((5, 5))) + 3 * np.eye(5)
    a = rng.standard_normal((7, 5))
    assert np.allclose(whitening.solve_upper(a, r) @ r, a)
