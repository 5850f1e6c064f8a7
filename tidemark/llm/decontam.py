"""Benchmark decontamination: one Aho-Corasick automaton over normalised test texts.

Texts are normalised byte by byte (ASCII letters lowered, other ASCII marks
to spaces) and cut into words; each distinct word of the benchmark gets a code of
four letters, the first of which only begin codes, so that a 13-word window of an item
is a pattern of 52 letters over a small alphabet and a match stands on whole words.
A document is a string of four letters a word, words of no item being blanks that no
pattern holds; runs between blanks that are shorter than every pattern are
passed over. One pass of the automaton finds every occurrence of every window;
places are word numbers, which map to the original text.

The benchmark is sent to the executors in blocks of at most BLOCK_WINDOWS windows
(or one item), whatever its size, as the items' texts: workers build the
automaton, of some 2 KB a window. With one block (any usual benchmark) nothing is
shuffled, with more the hits of the blocks are combined by row.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from itertools import repeat

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import BROADCAST_BYTES
from tidemark.storage import stored

WINDOW = 13
#: Windows of a block: some 0.2 GB in a Python worker.
BLOCK_WINDOWS = 100_000
#: Letters of a word, and how many there are at each place: enough words for any block.
CODE, BASE = 4, 32
BLANK = "\x00" * CODE
#: Bytes of words stay (letters lowered); every other ASCII byte becomes a space.
_TABLE = bytes(c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else c + 32 if 65 <= c <= 90 else 32 for c in range(256))
#: A word in a text whose letters are not lowered.
WORD = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
SPANS = "array<struct<first:int,last:int>>"


def words(text: str | None) -> list[bytes]:
    # bytes.split() parts at ASCII white space; of that only spaces are left
    return (text or "").encode("utf-8", "surrogatepass").translate(_TABLE).split()


class Matcher:
    """The items of one block; builds its codes and automaton where and when it is first used."""

    def __init__(self, items: list[tuple[int, str]], window: int):
        self.items, self.window = items, window
        self.automaton = None

    def ready(self):
        if self.automaton is None:
            import ahocorasick

            self.automaton, self.codes = ahocorasick.Automaton(), {}
            shortest = self.window
            for item, text in self.items:
                found = words(text)
                for w in found:
                    if w not in self.codes:
                        self.codes[w] = code(len(self.codes))
                line = "".join(map(self.codes.get, found))
                shortest = min(shortest, len(found)) if found else shortest
                for k in range(max(1, len(found) - self.window + 1) if found else 0):
                    pattern = line[CODE * k : CODE * (k + self.window)]
                    n, ids = self.automaton.get(pattern, (len(pattern) // CODE, []))
                    if item not in ids:
                        ids.append(item)
                        self.automaton.add_word(pattern, (n, ids))
            self.runs = re.compile("[^\\x00]{%d,}" % (CODE * shortest))
            if len(self.automaton):
                self.automaton.make_automaton()
        return self.automaton

    def scan(self, found: list[bytes]) -> tuple[list[tuple[int, int]], set[int]]:
        """Word ranges (first, last; merged) inside occurrences of windows, and the items they are of."""
        automaton = self.ready()
        if not len(automaton) or not found:
            return [], set()
        spans, items = [], set()
        for run in self.runs.finditer("".join(map(self.codes.get, found, repeat(BLANK)))):
            for end, (n, ids) in automaton.iter(run.group()):
                last = (run.start() + end) // CODE
                spans.append((last - n + 1, last))
                items.update(ids)
        return merged(spans), items


def code(n: int) -> str:
    """The n-th word's letters: the first from @ on, the others from ` on."""
    if n >= BASE**CODE:
        raise ValueError("too many words in a block")
    return "".join(chr((0x60 if k else 0x40) + n // BASE ** (CODE - 1 - k) % BASE) for k in range(CODE))


def merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1] + 1:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def blocks(benchmark: DataFrame, window: int, block_windows: int) -> Iterator[Matcher]:
    """The benchmark in blocks of bounded size; rows reach the driver one partition at a time."""
    held: list[tuple[int, str]] = []
    size = 0
    # an item has no more windows than words
    for r in benchmark.select("item_id", F.coalesce("text", F.lit("")).alias("text")).toLocalIterator():
        n = len(words(r["text"]))
        if held and size + n > block_windows:
            yield Matcher(held, window)
            held, size = [], 0
        held.append((r["item_id"], r["text"]))
        size += n
    if held:
        yield Matcher(held, window)


def find_contamination(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, block_windows: int = BLOCK_WINDOWS) -> DataFrame:
    """One row per row of docs: doc_id, thash (xxhash64 of the text), n_words, hit_words (ranges of word numbers), items (ids, sorted).

    docs needs doc_id and text, benchmark item_id and text; other columns are
    ignored. Null and empty texts have no words and no hits; items without
    words have no windows; repeated rows are repeated in the result and
    repeated items count once by id. An empty benchmark hits nothing. Word
    numbers start at 0.
    """
    spark = docs.sparkSession
    schema = f"doc_id long, thash long, n_words long, hit_words {SPANS}, items array<long>"

    def scanner(sent, all_rows: bool):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            matcher = sent.value
            for b in batches:
                ids, hashes, n, hits, items = [], [], [], [], []
                for i, h, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2)):
                    w = words(t.as_py())
                    spans, of = matcher.scan(w)
                    if all_rows or spans:
                        ids.append(i)
                        hashes.append(h)
                        n.append(len(w))
                        hits.append([{"first": x, "last": y} for x, y in spans])
                        items.append(sorted(of))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(ids, pa.int64()), pa.array(hashes, pa.int64()), pa.array(n, pa.int64()), pa.array(hits, pa.list_(pa.struct([("first", pa.int32()), ("last", pa.int32())]))), pa.array(items, pa.list_(pa.int64()))],
                    ["doc_id", "thash", "n_words", "hit_words", "items"],
                )

        return run

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("thash"), "text")
    found: list[DataFrame] = []  # one scan a block
    for k, matcher in enumerate(blocks(benchmark, window, block_windows)):
        found.append(rows.mapInArrow(scanner(spark.sparkContext.broadcast(matcher), k == 0), schema))
        if k:
            found[-1] = stored(found[-1])
    if not found:
        found = [rows.mapInArrow(scanner(spark.sparkContext.broadcast(Matcher([], window)), True), schema)]
    if len(found) > 1:
        more = found[1]
        for f in found[2:]:
            more = more.union(f)
        # a row of equal id and text has equal hits
        more = more.dropDuplicates(["doc_id", "thash", "items", "hit_words"]).groupBy("doc_id", "thash").agg(F.flatten(F.collect_list("hit_words")).alias("h2"), F.flatten(F.collect_list("items")).alias("i2"))
        one = found[0]
        both = one.join(more, one.doc_id.eqNullSafe(more.doc_id) & (one.thash == more.thash), "left")
        return both.select(one.doc_id, one.thash, "n_words", _merge_ranges(F.concat("hit_words", F.coalesce("h2", F.array().cast(SPANS)))).alias("hit_words"), F.array_sort(F.array_distinct(F.concat("items", F.coalesce("i2", F.array().cast("array<long>"))))).alias("items"))
    return found[0].select("doc_id", "thash", "n_words", "hit_words", "items")


def _merge_ranges(c):
    """Ranges of word numbers, merged where they meet or overlap."""
    return F.aggregate(
        F.array_sort(c),
        F.array().cast(SPANS),
        lambda done, s: F.when(
            (F.size(done) > 0) & (F.element_at(done, -1)["last"] + 1 >= s["first"]),
            F.concat(
                F.slice(done, 1, F.greatest(F.size(done) - 1, F.lit(0))),
                F.array(F.struct(F.element_at(done, -1)["first"].alias("first"), F.greatest(F.element_at(done, -1)["last"], s["last"]).alias("last"))),
            ),
        ).otherwise(F.concat(done, F.array(s))),
    )


def judged(found: DataFrame) -> DataFrame:
    """find_contamination()'s rows with n_hit, n_items and contaminated (a twentieth of the words or more, and at least one)."""
    n_hit = F.aggregate("hit_words", F.lit(0).cast("long"), lambda a, s: a + s["last"] - s["first"] + 1)
    return (
        found.withColumn("n_hit", n_hit)
        .withColumn("n_items", F.size("items").cast("long"))
        .withColumn("contaminated", (F.col("n_hit") > 0) & (20 * F.col("n_hit") >= F.col("n_words")))
    )


def original_offsets(text: str | None, ranges: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Code points (start, end) in the original text of ranges of word numbers."""
    if not ranges:
        return []
    places = [m.span() for m in WORD.finditer(text or "")]
    return [(places[a][0], places[b][1]) for a, b in ranges]


def contaminated_spans(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """doc_id, spans (start, end in code points of the original text) of every row that has hits.

    docs needs doc_id and text; other columns are ignored. Null and empty texts
    have no hits. Rows that share an id, or have none, have the spans of their own
    text; repeated rows are repeated. No hits, or an empty table: no rows.
    """
    found = judged(find_contamination(docs, benchmark, window)).where("n_hit > 0").select("doc_id", "thash", "hit_words").distinct()

    def offsets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))
        for b in batches:
            spans = [[{"start": s, "end": e} for s, e in original_offsets(t.as_py(), [(r["first"], r["last"]) for r in hits])] for t, hits in zip(b.column(1), b.column(2).to_pylist())]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(spans, kind)], ["doc_id", "spans"])

    d = docs.select(F.col("doc_id").cast("long").alias("id"), "text", F.xxhash64("text").alias("h"))
    both = d.join(found, d.id.eqNullSafe(found.doc_id) & (d.h == found.thash))
    return both.select("doc_id", "text", "hit_words").mapInArrow(offsets, "doc_id long, spans array<struct<start:int,end:int>>")


def decontaminate(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """The rows of docs that are not contaminated, with all their columns.

    Rows that share an id, or have none, are judged each by its own text. Null
    and empty texts stay, repeated rows stay or go together, an empty benchmark
    keeps every row, an empty table gives no rows.
    """
    bad = stored(judged(find_contamination(docs, benchmark, window)).where("contaminated").select(F.col("doc_id").alias("bad_id"), F.col("thash").alias("bad_hash")).distinct())
    small = F.broadcast(bad) if bad.count() * 64 <= BROADCAST_BYTES else bad
    return docs.join(small, docs["doc_id"].eqNullSafe(bad["bad_id"]) & (F.xxhash64(docs["text"]) == bad["bad_hash"]), "left_anti")
