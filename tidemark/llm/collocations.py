"""Phrases whose words keep together, by exact counts in counting quotient filters.

Texts are cut into pieces at punctuation and line ends and pieces into words. A
task counts the words and the n-grams of some megabytes of text, a shard, under word numbers of
its own; words counted over all shards get numbers of the whole corpus if they
occur often enough for a candidate (a phrase is no more frequent than its
words). Each shard's filters are then written anew under these numbers,
in buckets of the permuted key, and the sorted filters of a bucket from all
shards are merged. No dictionary is broadcast, no task holds more
than a shard or a bucket, and a word, phrase or language however frequent is one counter a shard.

A phrase is scored by the cut that explains it best: floor(1000000 * a * a / (l * r)),
in exact decimals. Phrases inside a longer one that accounts for half of their
occurrences are dropped. The best of each language are ranked.

A text that is null, empty or has no words counts nothing; a null language is "und". Repeated rows count
each time. Other columns are left out. An empty table gives no rows.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidemark.llm import quotient
from tidemark.operators.ranks import numbered
from tidemark.storage import stored

LEAST = 10
BEST = 2000
SHARE = 50
#: Bytes of text in a shard, and of the stretches that a long text is read in.
SHARD_BYTES, STRETCH_BYTES = 16 << 20, 2 << 20
#: Words of a shard that three 21-bit numbers hold.
SHARD_WORDS = 1 << 21
#: Keys in a bucket, about.
BUCKET_KEYS = 1 << 21
#: Candidates of a language that are ranked in one task, about, and the least number of parts they are cut into first.
RANK_ROWS, SALTS = 50_000, 16
BREAK, RESUME = b"\n", b"\r"
#: A-Z lowered, tabs to spaces, and the marks that end a piece to line ends.
TABLE = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ\t.,;:!?\x0b\x0c\r", b"abcdefghijklmnopqrstuvwxyz \n\n\n\n\n\n\n\n\n")
COUNTED = "shard long, n int, lang string, word string, local int, f long, filter binary"


def stretches(text: bytes, size: int) -> Iterator[bytes]:
    """A text, lowered and with its piece ends marked, in stretches that end between words.

    A stretch that goes on inside a piece begins with the two words before it and a mark of its own.
    """
    text, at, before = text.translate(TABLE), 0, []
    while at < len(text):
        end = at + size
        if end < len(text):
            cut = max(text.rfind(b" ", at + 1, end), text.rfind(BREAK, at + 1, end))
            if cut < 0:
                after = [p for p in (text.find(b" ", end), text.find(BREAK, end)) if p >= 0]
                cut = min(after, default=len(text))
            end = cut
        part = text[at:end]
        yield b" ".join([*before, RESUME, part]) if before else part
        last = part.rpartition(BREAK)
        before = ((before if not last[1] else []) + last[2].split())[-2:]
        at = end


def tokens(parts: list[bytes]) -> tuple[np.ndarray, np.ndarray, pa.Array]:
    """Word numbers of stretches in a row (-1 between pieces), whether a word was counted in the stretch before, and the words."""
    line = b" \n ".join(parts).replace(BREAK, b" \n ")
    words = pc.split_pattern(pa.array([line], pa.large_binary()), " ").flatten()
    words = words.filter(pc.not_equal(pc.binary_length(words), 0)).dictionary_encode()
    names = words.dictionary
    marks = {code: pc.index(names, pa.scalar(mark, names.type)).as_py() for code, mark in ((-1, BREAK), (-2, RESUME))}
    number = np.ones(len(names), np.int64)
    number[[at for at in marks.values() if at >= 0]] = 0
    number = np.cumsum(number) - 1
    for code, at in marks.items():
        if at >= 0:
            number[at] = code
    order = number[words.indices.to_numpy()] if len(names) else np.empty(0, np.int64)
    resumed = np.flatnonzero(order == -2)
    again = np.zeros(len(order) + 2, bool)
    for back in (1, 2):
        again[resumed - back] = True
    again = again[: len(order)] & (order >= 0)
    keep = order != -2
    return order[keep], again[keep], names.filter(pa.array(number[: len(names)] >= 0) if len(names) else pa.array([], pa.bool_()))


def count_shard(langs: dict[str, list[bytes]], shard: Iterator[int]) -> Iterator[pa.RecordBatch]:
    """The words and filters of a shard as rows; a shard of more than SHARD_WORDS words is cut in two."""
    order, again, names, base, lang_of = [np.array([-1])], [np.zeros(1, bool)], [], 0, []
    for lang, parts in langs.items():
        o, a, w = tokens(parts)
        order += [np.where(o >= 0, o + base, -1), np.array([-1])]
        again += [a, np.zeros(1, bool)]
        names.append(w)
        lang_of += [(lang, len(w))]
        base += len(w)
    if base > SHARD_WORDS:
        flat = [(lang, p) for lang, parts in langs.items() for p in parts]
        if len(flat) == 1:
            raise ValueError("STRETCH_BYTES is too large for SHARD_WORDS")
        for half in (flat[: len(flat) // 2], flat[len(flat) // 2 :]):
            own = defaultdict(list)
            for lang, p in half:
                own[lang].append(p)
            yield from count_shard(own, shard)
        return
    order, again = np.concatenate(order), np.concatenate(again)
    number, width = next(shard), max(1, (base - 1).bit_length())
    f = np.bincount(order[(order >= 0) & ~again], minlength=base)
    langs_column = pa.concat_arrays([pa.repeat(pa.scalar(lang, pa.string()), n) for lang, n in lang_of]) if lang_of else pa.array([], pa.string())
    words = pa.concat_arrays(names).cast(pa.large_string()).cast(pa.string()) if names else pa.array([], pa.string())
    step = 100_000
    for at in range(0, base, step):
        m = min(step, base - at)
        yield _rows(number, m, n=pa.repeat(pa.scalar(1, pa.int32()), m), lang=langs_column[at : at + m], word=words[at : at + m], local=pa.array(np.arange(at, at + m, dtype=np.int32)), f=pa.array(f[at : at + m].astype(np.int64)))
    for n in (2, 3):
        grams = [order[k : len(order) - n + 1 + k] for k in range(n)]
        ok = ~again[n - 1 :]
        for g in grams:
            ok = ok & (g >= 0)
        left, right = quotient.pack([g[ok] for g in grams], width)
        h = quotient.half_bits(n, width)
        run = quotient.summed(*quotient.permute(left, right, h), np.ones(len(left), np.int64), h)
        yield _rows(number, 1, n=pa.array([n], pa.int32()), local=pa.array([width], pa.int32()), f=pa.array([len(run[0])], pa.int64()), filter=pa.array([quotient.encode(*run, h, 0)], pa.binary()))


def _rows(shard: int, m: int, **columns) -> pa.RecordBatch:
    kinds = {"shard": pa.int64(), "n": pa.int32(), "lang": pa.string(), "word": pa.string(), "local": pa.int32(), "f": pa.int64(), "filter": pa.binary()}
    columns["shard"] = pa.repeat(pa.scalar(shard, pa.int64()), m)
    return pa.RecordBatch.from_arrays([columns[k] if k in columns else pa.nulls(m, t) for k, t in kinds.items()], list(kinds))


def counted(docs: DataFrame, shard_bytes: int = SHARD_BYTES, stretch_bytes: int = STRETCH_BYTES) -> DataFrame:
    """Each shard's words (n 1: lang, word, its number there, f) and filters (n 2 and 3: local is the width of numbers, f the keys)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first = TaskContext.get().partitionId() << 32
        shard = iter(range(first, first + (1 << 32)))
        langs, size = defaultdict(list), 0
        for b in batches:
            for lang, text in zip(b.column(0).to_pylist(), b.column(1)):
                for part in stretches(text.as_py(), stretch_bytes):
                    langs[lang].append(part)
                    size += len(part)
                    if size >= shard_bytes:
                        yield from count_shard(langs, shard)
                        langs, size = defaultdict(list), 0
        if langs:
            yield from count_shard(langs, shard)

    texts = docs.select(F.coalesce(F.col("lang").cast("string"), F.lit("und")).alias("lang"), F.col("text").cast("string").cast("binary").alias("text"))
    return stored(texts.where(F.length("text") > 0).mapInArrow(run, COUNTED))


def renumbered(shards: DataFrame, words: DataFrame, width: int, bucket_bits: int) -> DataFrame:
    """The shards' filters under the numbers of words (lang, word, id), which drop n-grams with other words: n, bucket, filter."""
    own = shards.where("n = 1").select("shard", "lang", "word", "local").join(words.select("lang", "word", "id"), ["lang", "word"]).select("shard", "local", "id")

    def run(grams: pa.Table, numbers: pa.Table) -> pa.Table:
        out_n, out_bucket, out = [], [], []
        local, ids = numbers["number"].to_numpy(), numbers["word_id"].to_numpy()
        new = np.full(int(local.max()) + 1 if len(local) else 0, -1, np.int64)
        new[local] = ids
        for n, old, data in zip(grams["n"].to_pylist(), grams["width"].to_pylist(), grams["filter"]):
            h, bits = quotient.half_bits(n, old), bucket_bits
            left, right, counts = quotient.decode(data.as_py(), h, 0, 0)
            known = np.full(1 << max(1, old), -1, np.int64)
            known[: len(new)] = new
            grammed = [known[i.astype(np.int64)] for i in quotient.unpack(*quotient.restore(left, right, h), n, old)]
            ok = np.ones(len(left), bool)
            for g in grammed:
                ok &= g >= 0
            h = quotient.half_bits(n, width)
            bits = min(bits, h)
            left, right, counts = quotient.summed(*quotient.permute(*quotient.pack([g[ok] for g in grammed], width), h), counts[ok], h)
            bucket = (left >> np.uint64(h - bits)).astype(np.int64) if bits else np.zeros(len(left), np.int64)
            starts = np.flatnonzero(np.concatenate([[True], bucket[1:] != bucket[:-1]])) if len(bucket) else np.empty(0, np.int64)
            for a, b in zip(starts, [*starts[1:], len(bucket)]):
                out_n.append(n)
                out_bucket.append(bucket[a])
                out.append(quotient.encode(left[a:b], right[a:b], counts[a:b], h, bits))
        return pa.table({"n": pa.array(out_n, pa.int32()), "bucket": pa.array(out_bucket, pa.int64()), "filter": pa.array(out, pa.binary())})

    grams = shards.where("n > 1").select(F.col("shard").alias("of_shard"), "n", F.col("local").alias("width"), "filter")
    own = own.select(F.col("shard").alias("in_shard"), F.col("local").alias("number"), F.col("id").alias("word_id"))
    return grams.groupBy("of_shard").cogroup(own.groupBy("in_shard")).applyInArrow(run, "n int, bucket long, filter binary")


def merged(filters: DataFrame, width: int, bucket_bits: int, least: int) -> DataFrame:
    """n-grams of at least so many occurrences, from the merged filters of each bucket: n, i1, i2, i3, f."""

    def found(n: int, merger: quotient.Merger) -> pa.RecordBatch:
        left, right, counts = merger.total()
        ok = counts >= least
        ids = quotient.unpack(*quotient.restore(left[ok], right[ok], merger.h), n, width)
        ids = [pa.array(i.astype(np.int64)) for i in ids] + [pa.nulls(int(ok.sum()), pa.int64())]
        return pa.RecordBatch.from_arrays([pa.repeat(pa.scalar(n, pa.int32()), int(ok.sum())), *ids[:3], pa.array(counts[ok])], ["n", "i1", "i2", "i3", "f"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, merger = None, None
        for b in batches:
            for n, bucket, data in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2)):
                h = quotient.half_bits(n, width)
                if (n, bucket) != now:
                    if now:
                        yield found(now[0], merger)
                    now, merger = (n, bucket), quotient.Merger(h)
                merger.add(quotient.decode(data.as_py(), h, min(bucket_bits, h), bucket))
        if now:
            yield found(now[0], merger)

    dealt = filters.repartition(max(1, 2 << bucket_bits), "n", "bucket").sortWithinPartitions("n", "bucket")
    return dealt.mapInArrow(run, "n int, i1 long, i2 long, i3 long, f long")


def phrase_counts(docs: DataFrame, least: int = LEAST, shard_bytes: int = SHARD_BYTES, stretch_bytes: int = STRETCH_BYTES, bucket_keys: int = BUCKET_KEYS) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Exact counts: words (lang, word, id, f) and phrases of two or three word ids (n, i1, i2, i3, f) of at least so many occurrences, and all words of each lang (lang, n)."""
    shards = counted(docs, shard_bytes, stretch_bytes)
    all_words = shards.where("n = 1").groupBy("lang", "word").agg(F.sum("f").alias("f"))
    words = numbered(all_words.where(F.col("f") >= least), [], ["lang", "word"], "id")
    words = stored(words)
    size = shards.where("n > 1").agg(F.coalesce(F.sum("f"), F.lit(0)).alias("keys")).first()["keys"]
    width = max(1, (words.count()).bit_length())
    bucket_bits = max(0, int(size // (2 * bucket_keys)).bit_length())
    phrases = stored(merged(renumbered(shards, words, width, bucket_bits), width, bucket_bits, least))
    return words, phrases, shards.where("n = 1").groupBy("lang").agg(F.sum("f").alias("n"))


def score(a: Column, left: Column, right: Column) -> Column:
    """floor(1000000 * a * a / (l * r)), exact."""
    wide = lambda c: c.cast("decimal(19,0)")
    over = (F.lit(1_000_000).cast("decimal(7,0)") * wide(a)).cast("decimal(19,0)") * wide(a)
    return F.call_function("div", over.cast("decimal(38,0)"), (wide(left) * wide(right)).cast("decimal(38,0)"))


def collocations(docs: DataFrame, least: int = LEAST, best: int = BEST, share: int = SHARE, rank_rows: int = RANK_ROWS, **sizes) -> DataFrame:
    """The best phrases of each lang: lang, rank, phrase, a, l, r, n, score; see the module."""
    words, phrases, totals = phrase_counts(docs, least, **sizes)
    pairs = phrases.where("n = 2").select("i1", "i2", F.col("f").alias("a"))
    triples = phrases.where("n = 3").select("i1", "i2", "i3", F.col("f").alias("a"))

    def word(place: int) -> DataFrame:
        return words.select(F.col("id").alias(f"i{place}"), F.col("word").alias(f"w{place}"), F.col("f").alias(f"f{place}"), *([F.col("lang")] if place == 1 else []))

    def inner(first: str, second: str, name: str) -> DataFrame:
        return pairs.select(F.col("i1").alias(first), F.col("i2").alias(second), F.col("a").alias(name))

    inside = triples.select("i1", "i2", "a").unionByName(triples.select(F.col("i2").alias("i1"), F.col("i3").alias("i2"), "a")).groupBy("i1", "i2").agg(F.max("a").alias("longer"))
    own = pairs.join(inside, ["i1", "i2"], "left").where(F.col("longer").isNull() | (100 * F.col("longer") < share * F.col("a")))
    two = own.join(word(1), "i1").join(word(2), "i2").select("lang", F.concat_ws(" ", "w1", "w2").alias("phrase"), "a", F.col("f1").alias("l"), F.col("f2").alias("r"), score(F.col("a"), F.col("f1"), F.col("f2")).alias("score"))
    three = triples.join(inner("i1", "i2", "f12"), ["i1", "i2"]).join(inner("i2", "i3", "f23"), ["i2", "i3"]).join(word(1), "i1").join(word(2), "i2").join(word(3), "i3")
    early, late = score(F.col("a"), F.col("f1"), F.col("f23")), score(F.col("a"), F.col("f12"), F.col("f3"))
    three = three.withColumn("early", early).withColumn("late", late)
    at_one = F.col("early") <= F.col("late")
    three = three.select("lang", F.concat_ws(" ", "w1", "w2", "w3").alias("phrase"), "a", F.when(at_one, F.col("f1")).otherwise(F.col("f12")).alias("l"), F.when(at_one, F.col("f23")).otherwise(F.col("f3")).alias("r"), F.least("early", "late").alias("score"))
    scored = stored(two.unionByName(three))
    order = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    top, salts = scored, max(SALTS, -(-scored.count() // rank_rows))
    while salts:  # in ever fewer parts of a language, of which each keeps as many as the result may hold
        place = F.row_number().over(Window.partitionBy("lang", "salt").orderBy(*order))
        top = top.withColumn("salt", F.pmod(F.xxhash64("phrase"), F.lit(salts))).withColumn("rank", place).where(F.col("rank") <= best).drop("salt")
        salts = max(1, salts // SALTS) if salts > 1 else 0
    return top.join(totals, "lang").select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")
