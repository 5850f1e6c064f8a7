"""SimHash near-dedup through an inverted index of bytes at fixed positions.

Two 64-bit fingerprints that differ in at most 3 bits share at least 5 of
their 8 bytes at the same places. The index therefore posts each distinct
fingerprint under sets of byte positions with their values: 14 sets of four
positions, the Steiner system S(3, 4, 8), of which any five positions hold
one, so a linked pair always meets. Inside a posting the shared positional
bytes of each pair are tallied, pairs with fewer than the guaranteed 5 go,
and the rest are verified by their differing bits. A posting gives at most a
spanning forest of its links, never all pairs. A posting with more than
POSTING_ROWS fingerprints is posted anew under finer keys (a fifth byte and
half of the other half-bytes) of which each has at most 4,096 fingerprints.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import BROADCAST_BYTES, join_groups
from tidemark.operators.graph import components
from tidemark.storage import stored

BITS = 3
SHINGLE = 3
SEED = 42
POSTING_ROWS = 4096


def position_sets() -> list[tuple[int, ...]]:
    """The planes of the affine space of three bits: four places whose numbers cancel under xor."""
    return [s for s in combinations(range(8), 4) if s[0] ^ s[1] ^ s[2] ^ s[3] == 0]


def mask(places, width: int) -> int:
    """Bits of the given places, each width bits wide."""
    return sum(((1 << width) - 1) << (width * p) for p in places)


def signed(x: int) -> int:
    return x - (1 << 64) if x >= 1 << 63 else x


def fingerprint(text: str | None, shingle: int = SHINGLE) -> int:
    """SimHash of the word shingles; no words: 0."""
    from xxhash import xxh64_intdigest

    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return 0
    if len(words) < shingle:
        return xxh64_intdigest(b" ".join(words), SEED)
    n, ones = len(words) - shingle + 1, np.zeros(64, np.int64)
    step = 1 << 15
    for a in range(0, n, step):
        part = words[a : min(a + step, n) + shingle - 1]
        grams = map(b" ".join, zip(*(part[k:] for k in range(shingle))))
        h = np.fromiter((xxh64_intdigest(g, SEED) for g in grams), np.uint64, min(step, n - a))
        ones += np.unpackbits(h.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * ones > n, bitorder="little").tobytes(), "little")


def fingerprints(docs: DataFrame, shingle: int = SHINGLE) -> DataFrame:
    """doc_id, thash (xxhash64 of the text), fp (the fingerprint as a signed long), for each row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fp = np.array([fingerprint(t.as_py(), shingle) for t in b.column(2)], np.uint64)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(fp.view(np.int64))], ["doc_id", "thash", "fp"])

    return docs.select(F.col("doc_id").cast("long"), F.xxhash64("text").alias("thash"), "text").mapInArrow(run, "doc_id long, thash long, fp long")


def linked_forest(fps: np.ndarray, bits: int, block: int = 1024) -> tuple[list[int], list[int]]:
    """Links of a posting as a spanning forest of its own components: (from, to) positions."""
    n = len(fps)
    up = np.arange(n)

    def find(x: int) -> int:
        while up[x] != x:
            up[x] = up[up[x]]
            x = up[x]
        return x

    a_out, b_out = [], []
    as_bytes = fps.view(np.uint8).reshape(n, 8)
    for i in range(0, n, block):
        for j in range(i, n, block):
            tally = np.zeros((min(block, n - i), min(block, n - j)), np.uint8)
            for p in range(8):
                tally += as_bytes[i : i + block, p, None] == as_bytes[None, j : j + block, p]
            a, b = np.nonzero(tally >= 8 - bits)
            a, b = a + i, b + j
            near = (a < b) & (np.bitwise_count(fps[a] ^ fps[b]) <= bits)
            for x, y in zip(a[near].tolist(), b[near].tolist()):
                rx, ry = find(x), find(y)
                if rx != ry:
                    up[max(rx, ry)] = min(rx, ry)
                    a_out.append(x)
                    b_out.append(y)
    return a_out, b_out


def _links(posted: DataFrame, bits: int) -> DataFrame:
    """posted (key, part, rep, fp): the forest of each posting, as edges between reps."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []

        def links(rows: np.ndarray) -> Iterator[pa.RecordBatch]:
            cut = np.flatnonzero((rows[1:, 0] != rows[:-1, 0]) | (rows[1:, 1] != rows[:-1, 1])) + 1
            starts, ends = np.r_[0, cut], np.r_[cut, len(rows)]
            u, v = [], []
            size = ends - starts
            two = starts[size == 2]  # most postings that hold more than one
            apart = np.ascontiguousarray(rows[two, 3] ^ rows[two + 1, 3]).view(np.uint64)
            shared = (apart.view(np.uint8).reshape(-1, 8) == 0).sum(axis=1)
            two = two[(shared >= 8 - bits) & (np.bitwise_count(apart) <= bits)]
            u += rows[two, 2].tolist()
            v += rows[two + 1, 2].tolist()
            for s, e in zip(starts[size > 2].tolist(), ends[size > 2].tolist()):
                ids = rows[s:e, 2]
                a, b = linked_forest(np.ascontiguousarray(rows[s:e, 3]).view(np.uint64), bits)
                u += ids[a].tolist()
                v += ids[b].tolist()
            if u:
                yield pa.RecordBatch.from_arrays([pa.array(u, pa.int64()), pa.array(v, pa.int64())], ["u", "v"])

        for b in batches:
            rows = np.column_stack([b.column(k).to_numpy() for k in range(4)])
            if not len(rows):
                continue
            held.append(rows)
            if (rows[0, :2] != rows[-1, :2]).any():  # the last posting may go on in the next batch
                rows = np.concatenate(held)
                whole = np.flatnonzero((rows[:, 0] != rows[-1, 0]) | (rows[:, 1] != rows[-1, 1]))[-1] + 1
                yield from links(rows[:whole])
                held = [rows[whole:]]
        if held:
            yield from links(np.concatenate(held))

    return posted.repartition("key", "part").sortWithinPartitions("key", "part").select("key", "part", "rep", "fp").mapInArrow(run, "u long, v long")


def link_edges(reps: DataFrame, bits: int = BITS, posting_rows: int = POSTING_ROWS) -> DataFrame:
    """reps (rep, fp), fps distinct: edges (u, v) between reps that span the links of at most bits (3 at most) differing bits."""
    if not 0 <= bits <= 3:
        raise ValueError("the position sets guarantee links of at most 3 differing bits")
    sets = position_sets()
    post = F.explode(F.array(*[F.struct(F.lit(k).cast("long").alias("part"), F.col("fp").bitwiseAND(F.lit(signed(mask(s, 8)))).alias("key")) for k, s in enumerate(sets)]))
    posted = reps.select("rep", "fp", post.alias("p")).select("p.key", "p.part", "rep", "fp")
    sizes = stored(posted.groupBy("key", "part").agg(F.count(F.lit(1)).alias("n")).where("n > 1"))
    some = posted.join(sizes, ["key", "part"])
    edges = _links(some.where(F.col("n") <= posting_rows), bits)
    if sizes.where(F.col("n") > posting_rows).isEmpty():
        return edges
    # A large posting: its pairs also share one byte more, and all but three of the six half-bytes of the other three.
    finer = []
    for k, s in enumerate(sets):
        rest = [p for p in range(8) if p not in s]
        for more in rest:
            halves = [h for p in rest if p != more for h in (2 * p, 2 * p + 1)]
            for j, same in enumerate(combinations(halves, 3)):
                m = mask([*s, more], 8) | mask(same, 4)
                finer.append((k, more * 100 + j, signed(m)))
    big = some.where(F.col("n") > posting_rows)
    masks = reps.sparkSession.createDataFrame([(k, 1000 * (k + 1) + j, m) for k, j, m in finer], "part long, finer long, m long")
    again = big.join(F.broadcast(masks), "part").select(F.col("fp").bitwiseAND(F.col("m")).alias("key"), F.col("finer").alias("part"), "rep", "fp")
    return edges.union(_links(again, bits))


def simhash_components(docs: DataFrame, bits: int = BITS, shingle: int = SHINGLE) -> DataFrame:
    """One row per row of docs: doc_id, fingerprint (16 hex digits), component_id.

    docs needs doc_id and text; other columns are ignored. Null and empty texts
    and texts of white space have no words: fingerprint zero, linked like any
    other. Repeated rows are repeated in the result. A null doc_id gets the
    smallest id of its component, or null if the component has no id. An empty
    table gives no rows.
    """
    return _labelled(docs, bits, shingle).select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def _labelled(docs: DataFrame, bits: int, shingle: int) -> DataFrame:
    """fingerprints()'s rows with component_id."""
    fps = stored(fingerprints(docs, shingle))
    distinct = stored(fps.groupBy("fp").agg(F.min("doc_id").alias("first_id"), F.count(F.lit(1)).alias("rows")))
    roots = stored(components(link_edges(distinct.select(F.col("fp").alias("rep"), "fp"), bits)))
    named = stored(distinct.join(roots, distinct.fp == roots.node, "left").select("fp", "first_id", "rows", F.coalesce("root", "fp").alias("root")))
    least = stored(named.groupBy("root").agg(F.min("first_id").alias("component_id"), F.count(F.lit(1)).alias("n")))
    labels = stored(join_groups(named, least, "root").select("fp", "component_id", F.col("rows").alias("n")))
    return join_groups(fps, labels, "fp").drop("n")


def near_dedup(docs: DataFrame, bits: int = BITS, shingle: int = SHINGLE) -> DataFrame:
    """The rows of docs with one document of each component: that with the smallest doc_id.

    Of rows that repeat the kept id, all stay. Rows without an id stay. Rows
    that share an id are judged each by its own text. Null and empty texts are
    near copies of one another (fingerprint zero). Other columns stay as they
    are, whatever their names. An empty table gives no rows.
    """
    drop = stored(_labelled(docs, bits, shingle).where("doc_id <> component_id").select(F.col("doc_id").alias("drop_id"), F.col("thash").alias("drop_hash")).distinct())
    small = F.broadcast(drop) if drop.count() * 64 <= BROADCAST_BYTES else drop
    return docs.join(small, (docs["doc_id"] == drop["drop_id"]) & (F.xxhash64(docs["text"]) == drop["drop_hash"]), "left_anti")
