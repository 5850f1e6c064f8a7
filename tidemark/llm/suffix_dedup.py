"""Repeated byte strings through a logarithmic family of sparse suffix arrays.

A string of LENGTH bytes is repeated if it also starts anywhere else. Its
anchor is the leftmost GRAM-byte gram of least hash among its grams: the place
depends on the string alone, so equal strings have equal anchors at equal
distances. Neighbouring strings share their anchor; those of one half of the
distances share a core of over half their length. Each such run of strings is one
suffix of the index: it begins where its core begins, about one in 130 bytes.

Suffixes are in order of the first two bytes of their core, then of a
fingerprint of the whole core, then of a second fingerprint of the context (all
bytes of the run's strings). Corpora come in batches. A batch's suffix array is
merge-scanned against each level of the family: both are dealt by ranges of that
order, so that equal suffixes are neighbours wherever a frequent one is cut, and
levels of equal size merge geometrically in the pass that scans them. Levels
are tables in the shared folder.

Neighbours with equal contexts are repeated as a whole. Where different contexts
share a core, one of each goes on: their strings are compared by fingerprint and
then byte by byte, core by core; a core with more than GROUP different contexts
is not gathered, its strings become suffixes of their own and are scanned alike.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import join_sized
from tidemark.storage import discard, stored, written

LENGTH, GRAM = 400, 32
#: Batches into which a table is cut; suffixes and contexts of one task; contexts of one core in one task.
BATCHES, TASK_SUFFIXES, TASK_CONTEXTS, GROUP = 2, 500_000, 12_000, 500
#: Contexts compared at a time, strings of a text anchored at a time.
CHUNK, STRETCH = 1_000, 1 << 19

#: A suffix: its order (h, c), its row's 128-bit key, its anchor, and the least and largest distance of its strings from it.
SUFFIX = "h long, c long, k1 long, k2 long, x long, lo int, hi int"
NAMES = [f.split()[0] for f in SUFFIX.split(", ")]
TYPES = [pa.int64()] * 5 + [pa.int32()] * 2
ORDER = ["h", "c", "k1", "k2", "x"]
#: What a scan says of a suffix: its context is repeated, others share its core.
REPEATED, SHARED = 1, 2
MIX = np.uint64(0x9E3779B97F4A7C15)
SPAN = "k1 long, k2 long, first long, last long"


class Rolling:
    """Polynomial hashes modulo 2**64 of random byte values, for windows of any place."""

    def __init__(self, seed: int):
        rng = np.random.default_rng(seed)
        self.values = rng.integers(0, 1 << 64, 256, np.uint64)
        self.base = int(rng.integers(0, 1 << 63)) * 2 + 1
        self.inverse = pow(self.base, -1, 1 << 64)
        self.up = self.down = np.ones(1, np.uint64)

    def powers(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) < n:
            n = max(n, 2 * len(self.up), 4096)
            for name, b in (("up", self.base), ("down", self.inverse)):
                p = np.full(n, b, np.uint64)
                p[0] = 1
                setattr(self, name, np.multiply.accumulate(p))
        return self.up, self.down

    def sums(self, data: np.ndarray) -> np.ndarray:
        """Running sums of a row, or of each row of a matrix, from which windows of any width follow."""
        n = data.shape[-1]
        up, _ = self.powers(n + 1)
        out = np.zeros((*data.shape[:-1], n + 1), np.uint64)
        np.cumsum(self.values[data] * up[:n], axis=-1, out=out[..., 1:])
        return out

    def windows(self, sums: np.ndarray, width: int) -> np.ndarray:
        """Hashes of all windows of a width."""
        n = sums.shape[-1]
        return self.mixed((sums[..., width:] - sums[..., : n - width]) * self.down[: n - width])

    def between(self, sums: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """Hashes of the windows from starts to ends."""
        return self.mixed((sums[ends] - sums[starts]) * self.down[starts])

    @staticmethod
    def mixed(out: np.ndarray) -> np.ndarray:
        out ^= out >> np.uint64(29)
        out *= np.uint64(0xBF58476D1CE4E5B9)
        return out ^ (out >> np.uint64(32))


def sliding(x: np.ndarray, w: int) -> np.ndarray:
    """The least of each w neighbours, by running values from the borders of blocks of w."""
    n = len(x)
    rows = -(-n // w)
    padded = np.full(rows * w, (1 << 64) - 1, x.dtype)
    padded[:n] = x
    grid = padded.reshape(rows, w)
    ahead = np.minimum.accumulate(grid, axis=1).reshape(-1)
    back = np.minimum.accumulate(grid[:, ::-1], axis=1)[:, ::-1].reshape(-1)
    return np.minimum(back[: n - w + 1], ahead[w - 1 : n])


def anchored(sums: np.ndarray, grams: Rolling, length: int = LENGTH, gram: int = GRAM) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Runs of neighbouring strings with one anchor: anchor, first and last start."""
    n, w = len(sums) - length, length - gram + 1  # strings, grams of one
    runs: list[list[np.ndarray]] = [[np.zeros(0, np.int64)] for _ in range(3)]
    h = grams.windows(sums, gram) if n > 0 else None
    low = np.uint64((1 << 20) - 1)
    for a in range(0, max(n, 0), STRETCH):
        m = min(STRETCH, n - a)
        # hash and place in one number: of equal hashes the leftmost is the least
        keyed = (h[a : a + m + w - 1] & ~low) | np.arange(m + w - 1, dtype=np.uint64)
        at = (sliding(keyed, w) & low).astype(np.int64)
        first = np.flatnonzero(np.r_[True, at[1:] != at[:-1]])
        for out, v in zip(runs, (at[first] + a, first + a, np.r_[first[1:], m] - 1 + a)):
            out.append(v)
    return tuple(np.concatenate(r) for r in runs)


def suffixes(data: np.ndarray, grams: Rolling, whole: Rolling, length: int = LENGTH, gram: int = GRAM) -> tuple[np.ndarray, ...]:
    """A text's suffixes: h, c, x, lo, hi."""
    sums = grams.sums(data)
    x, first, last = anchored(sums, grams, length, gram)
    side = length - gram
    half = side // 2
    parts = []
    for least, most in ((half, side), (0, half - 1)):
        lo, hi = np.maximum(x - last, least), np.minimum(x - first, most)
        use = lo <= hi
        at, lo, hi = x[use], lo[use], hi[use]
        begin, stop = at - least, at - most + length  # the core: what all strings of the half hold
        key = grams.between(sums, begin, stop)
        lead = data[begin].astype(np.uint64) << np.uint64(56) | data[begin + 1].astype(np.uint64) << np.uint64(48)
        h = (lead | key >> np.uint64(16)) ^ np.uint64(1 << 63) ^ np.uint64(least > 0)
        parts.append((h, at, lo, hi))
    h, at, lo, hi = (np.concatenate(p) for p in zip(*parts))
    two = whole.sums(data)
    c = whole.between(two, at - hi, at - lo + length) ^ ((lo << 20) + hi).astype(np.uint64) * MIX
    return h.view(np.int64), c.view(np.int64), at, lo, hi


def array_of(rows: DataFrame, tasks: int) -> DataFrame:
    """The suffix array of rows, stored, with what its merge-scan found: found, and at a range's borders part and edge.

    A range's first and last run of equal suffixes have an open neighbour: edge
    is 1, 2, or 3 if they are one. The first suffix of a run is written when the run is over.
    """
    columns = [*NAMES, "found", "part", "edge"]
    types = [*TYPES, *[pa.int32()] * 3]

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()

        def out(rows: np.ndarray, found, edge) -> pa.RecordBatch:
            n = len(rows)
            more = [np.broadcast_to(found, n), np.full(n, part), np.broadcast_to(edge, n)]
            return pa.RecordBatch.from_arrays([pa.array(v.astype(np.int64)).cast(t) for v, t in zip([*rows.T, *more], types)], columns)

        head, size, shares, first = np.zeros((0, len(NAMES)), np.int64), 0, False, 1
        for b in batches:
            rows = np.column_stack([b.column(k).to_numpy().astype(np.int64) for k in range(len(NAMES))])
            if not len(rows):
                continue
            same = (rows[:, :2] == np.concatenate([head[:, :2] if len(head) else rows[:1, :2] ^ 1, rows[:-1, :2]])).all(axis=1)
            new = np.flatnonzero(~same)
            if same.any():
                yield out(rows[same], REPEATED, 0)
            if not len(new):
                size += len(rows)
                continue
            heads = np.concatenate([head, rows[new]])
            starts = np.r_[[-size] if len(head) else np.zeros(0, np.int64), new]
            near = heads[1:, 0] == heads[:-1, 0]  # a head shares its core with the next
            before = np.r_[shares, near]
            sizes = np.diff(np.r_[starts, len(rows)])
            if len(heads) > 1:
                found = np.where(sizes[:-1] > 1, REPEATED, 0) | np.where(before[:-1] | near, SHARED, 0)
                yield out(heads[:-1], found, np.r_[first, np.zeros(len(found) - 1, int)])
                first = 0
            head, size, shares = heads[-1:], int(sizes[-1]), bool(before[-1])
        if len(head):
            yield out(head, (REPEATED if size > 1 else 0) | (SHARED if shares else 0), first + 2)

    ranged = rows.repartitionByRange(tasks, *ORDER).sortWithinPartitions(*ORDER).select(*NAMES)
    return stored(ranged.mapInArrow(scan, f"{SUFFIX}, found int, part int, edge int"))


def findings(array: DataFrame) -> DataFrame:
    """The suffixes of a scanned array with found above 0; at most two a range come to the driver, to meet across its borders."""
    edges = sorted(array.where("edge > 0").collect(), key=lambda r: (r["part"], r["edge"] & 1 == 0))
    more: dict[tuple, int] = {}
    for one, two in zip(edges, edges[1:]):
        if one["part"] != two["part"] and one["h"] == two["h"]:
            for r in (one, two):
                key = tuple(r[n] for n in NAMES)
                more[key] = more.get(key, r["found"]) | (REPEATED if one["c"] == two["c"] else SHARED)
    inner = array.where("edge = 0 and found > 0").select(*NAMES, "found")
    for r in edges:
        more.setdefault(tuple(r[n] for n in NAMES), r["found"])
    rows = [(*key, found) for key, found in more.items() if found]
    return inner.union(array.sparkSession.createDataFrame(rows, f"{SUFFIX}, found int")) if rows else inner


class Family:
    """Suffix arrays of 1, 2, 4, ... batches; what was found when a batch was scanned against them."""

    def __init__(self, task_suffixes: int = TASK_SUFFIXES):
        self.task_suffixes, self.levels = task_suffixes, []
        self.across: list[DataFrame] = []

    def _scan(self, rows: list[DataFrame]) -> DataFrame:
        both = rows[0]
        for r in rows[1:]:
            both = both.union(r)
        least = int(both.sparkSession.conf.get("spark.sql.shuffle.partitions"))
        return array_of(both, max(least, -(-both.count() // self.task_suffixes)))

    def add(self, batch: DataFrame) -> None:
        """Scan a batch's suffixes against each level; levels of its size, and of the sum, merge with it."""
        path, rows = written(batch.select(*NAMES))
        rank, equal = 0, []
        while self.levels and self.levels[-1][0] == rank:
            equal.append(self.levels.pop()[1])
            rank += 1
        self.across += [self._scan([rows, level.select(*NAMES)]) for _, level in self.levels]
        self.levels.append((rank, self._scan([rows, *[e.select(*NAMES) for e in equal]])))
        if len(self.levels) == 1:
            self.across = []  # one level: its scan met every pair
        discard(rows.sparkSession, path)

    def found(self) -> DataFrame:
        """All suffixes that met another, once each."""
        out = findings(self.levels[0][1])
        for more in [*(level for _, level in self.levels[1:]), *self.across]:
            out = out.union(findings(more))
        if len(self.levels) + len(self.across) > 1:
            out = out.groupBy(*NAMES).agg(F.bit_or("found").alias("found"))
        return out


def _bytes(text) -> np.ndarray:
    return np.frombuffer(text.as_buffer() if text.is_valid else b"", np.uint8)


def _keyed(docs: DataFrame) -> DataFrame:
    """doc_id, text and a 128-bit key of both: rows with the same key are copies of one another."""
    d = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return d.select("doc_id", "text", F.xxhash64("doc_id", "text").alias("k1"), F.xxhash64(F.lit("second"), "doc_id", "text").alias("k2"))


def joined_ranges(spans: list[list[int]]) -> list[list[int]]:
    """Ranges (begin, end) in order, merged where they meet or overlap."""
    out: list[list[int]] = []
    for k, e in sorted(spans):
        if out and k <= out[-1][1]:
            out[-1][1] = max(out[-1][1], e)
        else:
            out.append([k, e])
    return out


def repeated_in(h: np.ndarray, contexts: list[bytes], hi: np.ndarray, whole: Rolling, length: int) -> tuple[np.ndarray, np.ndarray]:
    """First and last repeated string (by its place in the context; -1: none) of each context.

    h: the cores; hi: where the anchor stands in a context. Strings agree if
    their fingerprints do and the bytes of their contexts over all strings on
    which two contexts agree; a fingerprint that lies is settled byte by byte.
    """
    sizes = np.array([len(c) for c in contexts], np.int64)
    grid = np.zeros((len(contexts), max(length, int(sizes.max(initial=0)))), np.uint8)
    for k, c in enumerate(contexts):
        grid[k, : len(c)] = np.frombuffer(c, np.uint8)
    keys = whole.windows(whole.sums(grid), length)
    place = np.arange(keys.shape[1])
    keys ^= (h.view(np.uint64)[:, None] + (hi[:, None] - place).astype(np.uint64)) * MIX
    row, at = np.nonzero(place + length <= sizes[:, None])
    keys = keys[row, at]
    order = np.argsort(keys, kind="stable")
    again = np.r_[False, keys[order[1:]] == keys[order[:-1]]] if len(order) else np.zeros(0, bool)
    heads = order[np.maximum.accumulate(np.where(again, 0, np.arange(len(order))))][again] if len(order) else order
    others = order[again]
    first, last = np.full(len(contexts), 1 << 20), np.full(len(contexts), -1)
    # the strings of each pair of contexts, in order of place
    pair = row[heads] * len(contexts) + row[others]
    by = np.lexsort((at[others], pair))
    heads, others, pair = heads[by], others[by], pair[by]
    cuts = np.flatnonzero(np.r_[True, pair[1:] != pair[:-1]]) if len(pair) else np.zeros(0, np.int64)
    for a, b in zip(cuts.tolist(), np.r_[cuts[1:], len(pair)].tolist()):
        one, two = int(row[heads[a]]), int(row[others[a]])
        p, q = int(at[heads[a]]), int(at[others[a]])
        n = int(at[others[b - 1]]) - q + length
        if contexts[one][p : p + n] != contexts[two][q : q + n]:
            return _repeated_exactly(h, contexts, hi, length)
        for k, v, w in ((one, p, p + n - length), (two, q, q + n - length)):
            first[k], last[k] = min(first[k], v), max(last[k], w)
    return first, last


def _repeated_exactly(h: np.ndarray, contexts: list[bytes], hi: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """repeated_in() by the strings themselves."""
    seen: dict[tuple, tuple[int, int]] = {}
    first, last = np.full(len(contexts), 1 << 20), np.full(len(contexts), -1)
    for k, c in enumerate(contexts):
        for p in range(len(c) - length + 1):
            one = seen.setdefault((int(h[k]), int(hi[k]) - p, c[p : p + length]), (k, p))
            if one != (k, p):
                for j, v in (one, (k, p)):
                    first[j], last[j] = min(first[j], v), max(last[j], v)
    return first, last


def repeated_spans(docs: DataFrame, length: int = LENGTH, gram: int = GRAM, batches: int = BATCHES, group: int = GROUP, task_suffixes: int = TASK_SUFFIXES, task_contexts: int = TASK_CONTEXTS) -> DataFrame:
    """k1, k2 (the key of id and text), spans: byte ranges covered by repeated strings, per key that has any.

    Ranges may overlap; together they cover the bytes to remove, and nothing
    else. docs needs doc_id and text; other columns are ignored. Rows that
    repeat both id and text are each other's repeats. Texts shorter than length
    (null and empty ones too) hold no string of that length. batches, group and
    the sizes of tasks do not change the result.
    """
    spark = docs.sparkSession
    rows = _keyed(docs)

    def index(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        grams, whole = Rolling(1), Rolling(2)
        for b in parts:
            for a in range(0, b.num_rows, 256):
                part = b.slice(a, 256)
                found = [suffixes(_bytes(t), grams, whole, length, gram) if t.is_valid else None for t in part.column(0)]
                have = [(k, f) for k, f in enumerate(found) if f is not None and len(f[0])]
                if not have:
                    continue
                which = pa.array(np.repeat([k for k, _ in have], [len(f[0]) for _, f in have]))
                h, c, x, lo, hi = (np.concatenate([f[j] for _, f in have]) for j in range(5))
                out = [pa.array(h), pa.array(c), part.column(1).take(which), part.column(2).take(which), pa.array(x), pa.array(lo.astype(np.int32)), pa.array(hi.astype(np.int32))]
                yield pa.RecordBatch.from_arrays(out, NAMES)

    family = Family(task_suffixes)
    for k in range(batches):
        batch = rows.where(F.pmod("k1", F.lit(batches)) == k) if batches > 1 else rows
        family.add(batch.select("text", "k1", "k2").mapInArrow(index, SUFFIX))
    met = family.found()
    met = stored(met) if len(family.levels) + len(family.across) > 1 else met
    spans = met.where(F.col("found").bitwiseAND(REPEATED) > 0).select("k1", "k2", (F.col("x") - F.col("hi")).alias("first"), (F.col("x") - F.col("lo") + length).alias("last"))

    shared = stored(met.where(F.col("found").bitwiseAND(SHARED) > 0).select(*NAMES))
    n = shared.count()
    if n:
        crowded = stored(shared.groupBy("h").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > group).select("h", F.lit(True).alias("crowded")))
        n_crowded = crowded.count()
        marked = join_sized(shared, crowded, ["h"], "left", n_crowded * 64) if n_crowded else shared.withColumn("crowded", F.lit(None).cast("boolean"))
        lists = marked.groupBy("k1", "k2").agg(F.collect_list(F.struct("h", "x", "lo", "hi", F.coalesce("crowded", F.lit(False)).alias("crowded"))).alias("of"))

        def contexts(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in parts:
                for a in range(0, b.num_rows, 64):
                    part = b.slice(a, 64)
                    of = part.column(3)
                    counts = pa.compute.list_value_length(of).to_numpy()
                    which = np.repeat(np.arange(part.num_rows), counts)
                    flat = of.flatten()
                    h, x, lo, hi, crowded = (flat.field(k) for k in range(5))
                    raws = [t.as_buffer().to_pybytes() for t in part.column(0)]
                    begin, end = x.to_numpy() - hi.to_numpy(), x.to_numpy() - lo.to_numpy() + length
                    ctx = pa.array([raws[k][s:e] for k, s, e in zip(which.tolist(), begin.tolist(), end.tolist())], pa.binary())
                    take = pa.array(which)
                    yield pa.RecordBatch.from_arrays([h, part.column(1).take(take), part.column(2).take(take), x, hi, ctx, crowded], ["h", "k1", "k2", "x", "hi", "ctx", "crowded"])

        near = rows.join(lists.hint("merge"), ["k1", "k2"]).select("text", "k1", "k2", "of")
        cut = near.mapInArrow(contexts, "h long, k1 long, k2 long, x long, hi int, ctx binary, crowded boolean")
        cut = stored(cut) if n_crowded else cut

        def match(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            whole = Rolling(3)

            def done(b: pa.RecordBatch) -> pa.RecordBatch:
                first, last = repeated_in(b.column(0).to_numpy(), b.column(5).to_pylist(), b.column(4).to_numpy().astype(np.int64), whole, length)
                got = np.flatnonzero(last >= 0)
                start = b.column(3).to_numpy()[got] - b.column(4).to_numpy()[got]
                take = pa.array(got)
                return pa.RecordBatch.from_arrays([b.column(1).take(take), b.column(2).take(take), pa.array(start + first[got]), pa.array(start + last[got] + length)], ["k1", "k2", "first", "last"])

            held: list[pa.RecordBatch] = []
            for b in parts:
                held.append(b)
                if sum(x.num_rows for x in held) < CHUNK:
                    continue
                all_ = pa.concat_batches(held)
                h = all_.column(0).to_numpy()
                ends = np.flatnonzero(h[1:] != h[:-1]) + 1  # the last core may go on
                a = 0
                while len(ends) and ends[-1] - a >= 1:
                    e = ends[max(0, np.searchsorted(ends, a + CHUNK, side="right") - 1)]
                    e = e if e > a else ends[np.searchsorted(ends, a, side="right")]
                    yield done(all_.slice(a, e - a))
                    a = int(e)
                held = [all_.slice(a)]
            if held and sum(x.num_rows for x in held):
                yield done(pa.concat_batches(held))

        tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-n // task_contexts))
        usual = cut.where(~F.col("crowded")) if n_crowded else cut
        spans = spans.union(usual.repartition(tasks, "h").sortWithinPartitions("h").mapInArrow(match, SPAN))
        if n_crowded:

            def strings(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
                one, two = Rolling(4), Rolling(5)
                for b in parts:
                    for a in range(0, b.num_rows, 256):
                        part = b.slice(a, 256)
                        h, hi = part.column(0).to_numpy().view(np.uint64), part.column(4).to_numpy().astype(np.int64)
                        data = [np.frombuffer(c.as_buffer(), np.uint8) for c in part.column(5)]
                        counts = np.array([len(d) - length + 1 for d in data])
                        row = np.repeat(np.arange(len(data)), counts)
                        d = hi[row] - (np.arange(len(row)) - np.repeat(np.cumsum(counts) - counts, counts))
                        mix = (h[row] + d.astype(np.uint64)) * MIX
                        w, c = (np.concatenate([r.windows(r.sums(x), length) for x in data]) ^ mix for r in (one, two))
                        take = pa.array(row)
                        dist = pa.array(d.astype(np.int32))
                        yield pa.RecordBatch.from_arrays([pa.array(w.view(np.int64)), pa.array(c.view(np.int64)), part.column(1).take(take), part.column(2).take(take), part.column(3).take(take), dist, dist], NAMES)

            single = Family(task_suffixes)
            single.add(cut.where("crowded").mapInArrow(strings, SUFFIX))
            alike = single.found().where(F.col("found").bitwiseAND(REPEATED) > 0)
            spans = spans.union(alike.groupBy("k1", "k2", "x").agg(F.max("hi").alias("hi"), F.min("lo").alias("lo")).select("k1", "k2", (F.col("x") - F.col("hi")).alias("first"), (F.col("x") - F.col("lo") + length).alias("last")))
    return spans.groupBy("k1", "k2").agg(F.collect_list(F.struct("first", "last")).alias("spans"))


def cut_repeats(docs: DataFrame, length: int = LENGTH, gram: int = GRAM, batches: int = BATCHES, group: int = GROUP, task_suffixes: int = TASK_SUFFIXES, task_contexts: int = TASK_CONTEXTS) -> DataFrame:
    """One row per row of docs: doc_id, n_bytes, removed (maximal byte ranges), kept (the other bytes).

    Cases as for repeated_spans(); null text is empty, and its kept bytes too.
    An empty table gives no rows.
    """
    spans = repeated_spans(docs, length, gram, batches, group, task_suffixes, task_contexts)

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in parts:
            for a in range(0, b.num_rows, 256):
                part = b.slice(a, 256)
                sizes, removed, kept = [], [], []
                for text, spans in zip(part.column(1), part.column(2).to_pylist()):
                    raw = text.as_buffer().to_pybytes() if text.is_valid else b""
                    out = joined_ranges([[s["first"], s["last"]] for s in spans or []])
                    at, rest = 0, []
                    for s, e in out:
                        rest.append(raw[at:s])
                        at = e
                    sizes.append(len(raw))
                    removed.append([{"first": s, "last": e} for s, e in out])
                    kept.append(b"".join([*rest, raw[at:]]))
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(sizes, pa.int64()), pa.array(removed, pa.list_(pa.struct([("first", pa.int64()), ("last", pa.int64())]))), pa.array(kept, pa.binary())], ["doc_id", "n_bytes", "removed", "kept"])

    rows = _keyed(docs).join(spans.hint("merge"), ["k1", "k2"], "left")
    return rows.select("doc_id", "text", "spans").mapInArrow(run, "doc_id long, n_bytes long, removed array<struct<first:long,last:long>>, kept binary")
