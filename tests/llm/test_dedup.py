import hashlib
import re
from collections import defaultdict

import pytest
from pyspark.sql import functions as F
from xxhash import xxh64_intdigest

from tests.llm.cases import SCHEMA, documents
from tidemark.llm import exact_dedup, queries, simhash
from tests.conftest import SF


def brute_fingerprint(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m.group().lower(), text or ""))
    if not w:
        return 0
    grams = [" ".join(w[i : i + 3]) for i in range(max(1, len(w) - 2))]
    hs = [xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs))


def brute_components(rows):
    fps = [brute_fingerprint(t) for _, t in rows]
    up = list(range(len(rows)))

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= 3:
                up[find(i)] = find(j)
    least = {}
    for i, (d, _) in enumerate(rows):
        r = find(i)
        if d is not None:
            least[r] = min(least.get(r, d), d)
    return sorted(((d, f"{fps[i]:016x}", least.get(find(i))) for i, (d, _) in enumerate(rows)), key=repr)


def test_simhash_against_brute_force(spark):
    rows = documents()
    got = simhash.simhash_components(spark.createDataFrame(rows, SCHEMA)).collect()
    want = brute_components([r[:2] for r in rows])
    assert sorted((tuple(r) for r in got), key=repr) == want
    assert len({w[2] for w in want}) < len({w[1] for w in want})


def test_simhash_query_against_brute_force(spark):
    got = queries.op1_simhash_near_dedup(spark, SF).collect()
    rows = [tuple(r) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()]
    assert sorted((tuple(r) for r in got), key=repr) == brute_components(rows)


@pytest.mark.parametrize("posting_rows", [4096, 8])
def test_links_in_large_postings(spark, posting_rows):
    import random

    rng = random.Random(3)
    centres = [rng.getrandbits(64) for _ in range(4)]
    fps = {c for c in centres}
    for c in centres:
        for _ in range(60):
            x = c
            for _ in range(rng.randint(1, 4)):
                x ^= 1 << rng.randrange(64)
            fps.add(x)
    fps = sorted(fps)
    df = spark.createDataFrame([(i, simhash.signed(f)) for i, f in enumerate(fps)], "rep long, fp long")
    edges = simhash.link_edges(df, posting_rows=posting_rows).collect()
    up = list(range(len(fps)))
    two = list(range(len(fps)))

    def find(p, x):
        while p[x] != x:
            x = p[x]
        return x

    for e in edges:
        assert (fps[e.u] ^ fps[e.v]).bit_count() <= 3
        up[find(up, e.u)] = find(up, e.v)
    for i in range(len(fps)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= 3:
                two[find(two, i)] = find(two, j)
    parts = lambda p: sorted(map(sorted, _groups(p, find).values()))
    assert parts(up) == parts(two)


def _groups(p, find):
    out = defaultdict(list)
    for i in range(len(p)):
        out[find(p, i)].append(i)
    return out


def test_position_sets_cover_every_five():
    from itertools import combinations

    sets = simhash.position_sets()
    assert len(sets) == 14
    assert all(any(set(s) <= set(five) for s in sets) for five in combinations(range(8), 5))


def test_near_dedup_keeps_one(spark):
    df = spark.createDataFrame(documents(), SCHEMA)
    kept = simhash.near_dedup(df)
    assert kept.columns == df.columns
    comps = {r[2] for r in brute_components([r[:2] for r in documents()])}
    assert {r.doc_id for r in kept.collect() if r.doc_id is not None} == comps


def brute_exact(rows):
    norm = [re.sub(r"[\x20\x09-\x0D]+", " ", t or "") for _, t in rows]
    groups = defaultdict(list)
    for (d, _), t in zip(rows, norm):
        groups[t].append(d)
    out = []
    for (d, _), t in zip(rows, norm):
        ids = [x for x in groups[t] if x is not None]
        keep = min(ids) if ids else None
        out.append((d, keep, len(groups[t]), d == keep, hashlib.sha256(t.encode()).hexdigest()))
    return sorted(out, key=repr)


@pytest.mark.parametrize("colliding", [False, True])
def test_exact_dedup_against_brute_force(spark, colliding):
    rows = documents()
    hash128 = F.md5((F.length("norm") % 3).cast("string")) if colliding else None
    got = exact_dedup.exact_dedup(spark.createDataFrame(rows, SCHEMA), hash128).collect()
    assert sorted((tuple(r) for r in got), key=repr) == brute_exact([r[:2] for r in rows])


def test_empty_tables(spark):
    none = spark.createDataFrame([], SCHEMA)
    assert exact_dedup.exact_dedup(none).count() == 0
    assert simhash.simhash_components(none).count() == 0
    assert simhash.near_dedup(none).count() == 0


def test_near_dedup_keeps_a_unique_text_under_a_repeated_id(spark):
    rows = [(1, "one two three four five"), (2, "one two three four five"), (2, "nothing like the others at all"), (None, "one two three four five"), (None, "a text of its own")]
    kept = simhash.near_dedup(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted(map(tuple, kept), key=repr) == sorted([r for k, r in enumerate(rows) if k != 1], key=repr)
