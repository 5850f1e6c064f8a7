"""Token ids in a binary file format of shuffled byte planes.

A store is a table of segments, each a self-contained binary payload: a header,
a chunk index, then the chunks. A chunk holds BLOCK ids (the last may hold
fewer); its little-endian ids are transposed into byte planes (all first
bytes, all second bytes, ...), planes that are zero throughout are left out,
and each plane is compressed with zstandard. The chunk index says where each
plane begins, so one chunk can be read alone.

Segments hold whole documents in the order asked for; a segment's shard is its
range partition, and where a shard begins is the sum of the shards before it.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.storage import shared_dir

MAGIC = b"TIDEPL01"
#: Ids in a chunk, ids after which a segment closes, bytes of an id.
BLOCK, SEGMENT, WIDTH = 1 << 16, 1 << 20, 4
END_ID = 0
LEVEL = 3
#: Words whose ids a Python worker remembers, and the bytes of a remembered word at most: words beyond either are encoded anew.
CACHE_WORDS, CACHE_WORD_BYTES = 300_000, 64

#: White space other than the space and the line feed.
OTHER_SPACES = [c for c in map(chr, range(0x3001)) if c.isspace() and c not in " \n"]

SEGMENT_SCHEMA = "shard int, seq long, shard_start long, n_ids long, docs array<struct<doc_id:long,n_tokens:long>>, payload binary"


def pack(ids: np.ndarray, block: int = BLOCK, level: int = LEVEL) -> bytes:
    """Header, chunk index, planes."""
    import zstandard

    c = zstandard.ZstdCompressor(level=level, write_content_size=True)
    ids = np.ascontiguousarray(ids, dtype="<u4")
    index, body, at = [], [], 0
    for a in range(0, len(ids), block):
        part = ids[a : a + block]
        planes = np.ascontiguousarray(part.view(np.uint8).reshape(-1, WIDTH).T)
        sizes = []
        for p in planes:
            z = c.compress(p.tobytes()) if p.any() else b""
            sizes.append(len(z))
            body.append(z)
        index.append(struct.pack(f"<IQ{WIDTH}I", len(part), at, *sizes))
        at += sum(sizes)
    return MAGIC + struct.pack("<III", block, len(index), WIDTH) + b"".join(index) + b"".join(body)


def chunk_index(payload: bytes) -> list[tuple[int, int, tuple[int, ...]]]:
    """(ids, place in the body, plane sizes) of each chunk."""
    if payload[:8] != MAGIC:
        raise ValueError("not a token segment")
    _, n, width = struct.unpack_from("<III", payload, 8)
    fmt = f"<IQ{width}I"
    rows = [struct.unpack_from(fmt, payload, 20 + k * struct.calcsize(fmt)) for k in range(n)]
    return [(r[0], r[1], r[2:]) for r in rows]


def unpack(payload: bytes, chunk: int | None = None) -> np.ndarray:
    """All ids of a payload, or those of one chunk."""
    import zstandard

    d = zstandard.ZstdDecompressor()
    index = chunk_index(payload)
    body = 20 + len(index) * struct.calcsize(f"<IQ{WIDTH}I")
    out = []
    for n, at, sizes in index if chunk is None else index[chunk : chunk + 1]:
        planes = np.zeros((WIDTH, n), np.uint8)
        at += body
        for k, size in enumerate(sizes):
            if size:
                planes[k] = np.frombuffer(d.decompress(payload[at : at + size]), np.uint8)
            at += size
        out.append(np.ascontiguousarray(planes.T).reshape(-1).view("<u4"))
    return np.concatenate(out) if out else np.zeros(0, "<u4")


class Coder:
    """A byte-level BPE tokenizer file with a bounded memory of words.

    Pre-tokens of this tokenizer never span the border before a single space
    or around a single line feed, so a text's ids are those of its words, each
    with the space or line feed before it. New words of a batch are encoded in
    one string and told apart by the lengths of their tokens. Texts with any
    other white space, or with the string of a special token, are encoded whole.
    """

    def __init__(self, path: str, cache_words: int = CACHE_WORDS):
        self.path, self.cache_words, self.made = path, cache_words, None

    def ready(self):
        if self.made is None:
            import os

            os.environ["TOKENIZERS_PARALLELISM"] = "false"
            from tokenizers import Tokenizer

            t = Tokenizer.from_file(self.path)
            # In this vocabulary's alphabet one character stands for one byte.
            sizes = np.zeros(t.get_vocab_size(), np.int64)
            for token, i in t.get_vocab().items():
                sizes[i] = len(token)
            self.whole_if = [*OTHER_SPACES, *(a.content for a in t.get_added_tokens_decoder().values())]
            self.made = (t, sizes)
            self.known: dict[str, bytes] = {}
        return self.made

    def whole(self, text: str) -> np.ndarray:
        t, _ = self.ready()
        return np.array(t.encode_batch_fast([text], add_special_tokens=False)[0].ids, "<u4")

    def _new(self, words: list[str]) -> dict[str, bytes]:
        t, sizes = self.ready()
        out: dict[str, bytes] = {}
        for a in range(0, len(words), 4096):
            part = words[a : a + 4096]
            texts = [w if w[0] == "\n" else " " + w for w in part]
            ids = np.array(t.encode_batch_fast(["".join(texts)], add_special_tokens=False)[0].ids, "<u4")
            ends = np.cumsum([len(x.encode("utf-8")) for x in texts])
            cuts = np.searchsorted(np.cumsum(sizes[ids]), ends, side="right")
            raw = ids.tobytes()
            at = 0
            for w, c in zip(part, cuts.tolist()):
                out[w] = raw[4 * at : 4 * c]
                at = c
        return out

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        self.ready()
        known = self.known
        found: list[list[bytes | None] | None] = []
        split: list[list[str]] = []
        fresh: set[str] = set()
        for text in texts:
            words = text.replace("\n", " \n").split(" ")
            split.append(words)
            # No empty word, and no white space but single spaces and line feeds: every border is a plain one.
            plain = len(words) > 1 and "" not in words and "\n" not in words and words[0][0] != "\n"
            if not plain or any(map(text.__contains__, self.whole_if)):
                found.append(None)
                continue
            ids = list(map(known.get, words))
            ids[0] = b""  # the first word has no space before it
            found.append(ids)
            if None in ids:
                fresh.update(w for w, i in zip(words, ids) if i is None)
        now = self._new(list(fresh))
        if len(known) < self.cache_words:
            known.update((w, i) for w, i in now.items() if len(w) + len(i) <= CACHE_WORD_BYTES)
        out = []
        for text, words, ids in zip(texts, split, found):
            if ids is None:
                out.append(self.whole(text) if text else np.zeros(0, "<u4"))
                continue
            if None in ids:
                ids = [now[w] if i is None else i for w, i in zip(words, ids)]
            out.append(np.concatenate([self.whole(words[0]), np.frombuffer(b"".join(ids), "<u4")]))
        return out


def write_tokens(docs: DataFrame, tokenizer: str, path: str, order: list[str] | None = None, block: int = BLOCK, segment: int = SEGMENT) -> None:
    """Write the ids of docs' texts, an end id after each document, as a store at path.

    docs needs doc_id and text; other columns only matter if order names them.
    order: columns that give the documents' order, doc_id by default, nulls
    first; rows that tie stand in the order of their text's hash, so equal rows are
    interchangeable. Null text is empty: one end id. An empty table gives an
    empty store. Texts are shuffled once, by range; a document's ids are held
    whole, a segment holds at least one document.
    """
    by = order or ["doc_id"]
    sent = docs.sparkSession.sparkContext.broadcast(Coder(tokenizer))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder, shard = sent.value, TaskContext.get().partitionId()
        seq = start = size = 0
        held: list[np.ndarray] = []
        rows: list[dict] = []
        end = np.array([END_ID], "<u4")

        def close() -> pa.RecordBatch:
            ids = np.concatenate(held)
            return pa.RecordBatch.from_arrays(
                [pa.array([shard], pa.int32()), pa.array([seq], pa.int64()), pa.array([start], pa.int64()), pa.array([len(ids)], pa.int64()), pa.array([rows], pa.list_(pa.struct([("doc_id", pa.int64()), ("n_tokens", pa.int64())]))), pa.array([pack(ids, block)], pa.binary())],
                ["shard", "seq", "shard_start", "n_ids", "docs", "payload"],
            )

        for b in batches:
            for a in range(0, b.num_rows, 512):
                part = b.slice(a, 512)
                for i, ids in zip(part.column(0).to_pylist(), coder.encode(part.column(1).to_pylist())):
                    held += [ids, end]
                    rows.append({"doc_id": i, "n_tokens": len(ids) + 1})
                    size += len(ids) + 1
                    if size >= segment:
                        yield close()
                        seq, start, size, held, rows = seq + 1, start + size, 0, [], []
        if held:
            yield close()

    keys = [F.col(c).asc_nulls_first() for c in by] + [F.xxhash64("text")]
    ranged = docs.repartitionByRange(*keys).sortWithinPartitions(*keys)
    plain = ranged.select(F.col("doc_id").cast("long"), F.coalesce("text", F.lit("")).alias("text"))
    plain.mapInArrow(run, SEGMENT_SCHEMA).write.option("compression", "none").parquet(path)


def read_tokens(spark, path: str) -> DataFrame:
    """A store's documents: doc_id, start (ids before it in the store), n_tokens, ids_crc32, in no particular order.

    Every segment is decoded; shard totals, one number per range partition, are
    summed on the driver.
    """
    store = spark.read.schema(SEGMENT_SCHEMA).parquet(path)
    before, at = {}, 0
    for r in store.groupBy("shard").agg(F.sum("n_ids").alias("n")).orderBy("shard").collect():
        before[r["shard"]] = at
        at += r["n"]
    sent = spark.sparkContext.broadcast(before)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first = sent.value
        for b in batches:
            for r in range(b.num_rows):
                shard, _, shard_start, n_ids, docs, payload = (b.column(k)[r].as_py() for k in range(6))
                raw = memoryview(unpack(payload).tobytes())
                ids, starts, sizes, sums = [], [], [], []
                at = 0
                for d in docs:
                    ids.append(d["doc_id"])
                    starts.append(first[shard] + shard_start + at)
                    sizes.append(d["n_tokens"])
                    sums.append(zlib.crc32(raw[4 * at : 4 * (at + d["n_tokens"])]))
                    at += d["n_tokens"]
                if at != n_ids or 4 * at != len(raw):
                    raise ValueError(f"segment of shard {shard} does not hold what its index says")
                yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in (ids, starts, sizes, sums)], ["doc_id", "start", "n_tokens", "ids_crc32"])

    return store.mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long")


def token_output(docs: DataFrame, tokenizer: str, order: list[str] | None = None, path: str | None = None) -> DataFrame:
    """Write a store (in the shared folder, or at path) and read it back."""
    path = path or shared_dir(docs.sparkSession)
    write_tokens(docs, tokenizer, path, order)
    return read_tokens(docs.sparkSession, path)
