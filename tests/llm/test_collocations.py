"""Collocations against plain counts; the filters against dictionaries."""

import random
import re
from collections import Counter

import duckdb
import numpy as np
import pandas as pd
import pytest

from tests.conftest import SF
from tests.llm.cases import SCHEMA, documents
from tidemark.llm import collocations, queries, quotient


def words_of(text):
    lowered = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    return [[w for w in re.split(r"[\x20\x09]+", p) if w] for p in re.split(r"[.,;:!?\x0A-\x0D]", lowered)]


def plain(rows, least, best):
    counts, n = {}, Counter()
    for text, lang in rows:
        lang = lang or "und"
        for words in words_of(text):
            n[lang] += len(words)
            for k in (1, 2, 3):
                for i in range(len(words) - k + 1):
                    counts.setdefault(lang, Counter())[tuple(words[i : i + k])] += 1
    out = []
    for lang, f in counts.items():
        frequent = {p: a for p, a in f.items() if len(p) > 1 and a >= least}
        kept = []
        for p, a in frequent.items():
            if any(len(q) > len(p) and any(q[i : i + len(p)] == p for i in range(len(q))) and 100 * b >= 50 * a for q, b in frequent.items()):
                continue
            score, _, left, right = min((1000000 * a * a // (f[p[:k]] * f[p[k:]]), k, f[p[:k]], f[p[k:]]) for k in range(1, len(p)))
            kept.append((-score, -a, " ".join(p).encode(), left, right))
        for rank, (s, a, p, left, right) in enumerate(sorted(kept)[:best]):
            out.append((lang, rank + 1, p.decode(), -a, left, right, n[lang], -s))
    return sorted(out)


def odd():
    rng = random.Random(5)
    rows = [(t, rng.choice(["en", "de", None])) for _, t, *_ in documents()]
    few = ["ab", "AB", "c", "dé", "\x01", "a!b", "x"]
    rows += [(" ".join(rng.choice(few) for _ in range(rng.randint(0, 60))), "en") for _ in range(40)]
    rows += [("New York\tcity of new york " * 30 + ". new york, New York", "de"), ("w" * 500 + " w " * 5, "fr")]
    return rows


@pytest.mark.parametrize("sizes", [{}, {"shard_bytes": 900, "stretch_bytes": 50, "bucket_keys": 1000}])
def test_collocations_are_brute_force(spark, sizes):
    rows = odd()
    docs = spark.createDataFrame([(t, lang, 1, "w", 2, 3, "p", 4) for t, lang in rows], "text string, lang string, n int, word string, f int, id int, phrase string, shard int")
    got = collocations.collocations(docs, least=4, best=50, rank_rows=20, **sizes).collect()
    assert sorted(map(tuple, got)) == plain(rows, 4, 50)


def test_no_rows(spark):
    assert collocations.collocations(spark.createDataFrame([(None, None), ("", "en"), (" . ", "en")], "text string, lang string")).count() == 0
    assert collocations.collocations(spark.createDataFrame([], SCHEMA + ", lang string")).count() == 0


def test_query_is_its_sql(spark):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{SF}/documents.parquet'")
    want = con.execute(queries.ORACLES["op13_collocations"]).fetch_df()
    got = queries.op13_collocations(spark, SF).toPandas()
    key = ["lang", "rank"]
    pd.testing.assert_frame_equal(got.sort_values(key).reset_index(drop=True), want[got.columns].sort_values(key).reset_index(drop=True), check_dtype=False)
    assert len(got) > 100


@pytest.mark.parametrize("n,width", [(2, 3), (3, 3), (2, 21), (3, 21), (3, 31), (2, 32), (3, 32)])
def test_filters_lose_nothing(n, width):
    rng = np.random.default_rng(width)
    ids = [rng.integers(0, min(1 << width, 50) if i else 1 << width, 4000) for i in range(n)]
    h = quotient.half_bits(n, width)
    left, right = quotient.pack(ids, width)
    there = quotient.permute(left, right, h)
    back = quotient.unpack(*quotient.restore(*there, h), n, width)
    assert all((a == b).all() for a, b in zip(back, ids)) and all(int(x.max()) < 1 << h for x in there)
    want = Counter(zip(*(i.tolist() for i in ids)))
    want = {k: c * 300 if c > 1 else c for k, c in want.items()}
    keys = quotient.permute(*quotient.pack([np.array(c) for c in zip(*want)], width), h)
    bits = min(2, h)
    merger = quotient.Merger(h)
    for part in np.array_split(np.arange(len(want)), 7):
        run = quotient.summed(keys[0][part], keys[1][part], np.array(list(want.values()))[part], h)
        bucket = run[0] >> np.uint64(h - bits)
        for b in np.unique(bucket):
            own = bucket == b
            data = quotient.encode(*(x[own] for x in run), h, bits)
            again = quotient.decode(data, h, bits, int(b))
            assert all((x[own] == y).all() for x, y in zip(run, again))
            merger.add(again)
            merger.add(again)
    got = merger.total()
    ids = quotient.unpack(*quotient.restore(got[0], got[1], h), n, width)
    assert dict(zip(zip(*(i.tolist() for i in ids)), got[2].tolist())) == {k: 2 * c for k, c in want.items()}


def test_stretches_give_each_word_once():
    text = "One two,three four five\tsix seven. eight nine ten eleven twelve\n\nthirteen" .encode()
    for size in (1, 3, 7, 11, 25, 200):
        order, again, names = collocations.tokens(list(collocations.stretches(text, size)))
        names = names.to_pylist()
        once = [names[o].decode() for o, r in zip(order, again) if o >= 0 and not r]
        assert once == "one two three four five six seven eight nine ten eleven twelve thirteen".split()
