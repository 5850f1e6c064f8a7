"""Quality by a vote of nearest labelled neighbours in a latent-semantic space.

Features of a text are the counts of all pairs of neighbouring byte classes
over the whole text, damped and weighted by how rare a pair is; they follow
spelling, marks, case and layout in any language. A bounded sample of
labelled rows (SAMPLE says how many of each label, the smallest by a hash of the id) gives
the weights and, by a singular value decomposition, the latent space. Its
labelled vectors, of bounded size, are broadcast; for every document the exact
cosines with all of them are computed in blocks, and the labels of the NEIGHBOURS
closest are averaged, weighted by similarity.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Labelled rows that are learnt from, at most, by label; more rows in the table change nothing else.
SAMPLE = {0: 1500, 1: 4500}
DIMENSIONS, NEIGHBOURS, BLOCK = 48, 15, 512
#: Similarities count with this power.
SHARPNESS = 4


def _classes() -> np.ndarray:
    """Each byte's class: letters by themselves, case apart for vowels and others, marks by themselves."""
    out = np.zeros(256, np.int64)
    marks = " \n.,;:!?'\"-()|*#$%&@/<>=_+[]{}\\~^`"
    for k, c in enumerate(marks):
        out[ord(c)] = 1 + k
    n = 1 + len(marks)
    for c in range(26):
        out[97 + c] = n + c
    n += 26
    for c in "ABCDEFGHIJKLMNOPQRSTUVWXYZ":
        out[ord(c)] = n + (c in "AEIOU")
    n += 2
    for c in range(10):
        out[48 + c] = n
    out[9] = out[13] = n + 1
    for c in range(128, 256):
        out[c] = n + 2 + (c >= 192)
    return out


CLASSES = _classes()
WIDE = int(CLASSES.max()) + 1


#: Bytes that count as seen before a text begins: the shorter it is, the less its pairs say.
PRIOR = 40
#: Beside the pairs: share of words that are new, share of lines that are new, length, mean length of a word.
LAYOUT = 4


def features(texts: list[str | None]) -> np.ndarray:
    """Damped counts of class pairs and figures of layout, one row per text."""
    out = np.zeros((len(texts), WIDE * WIDE + LAYOUT), np.float32)
    for k, t in enumerate(texts):
        raw = (t or "").encode("utf-8", "surrogatepass")
        c = CLASSES[np.frombuffer(raw, np.uint8)]
        if len(c) > 1:
            n = np.bincount(c[:-1] * WIDE + c[1:], minlength=WIDE * WIDE)
            out[k, : WIDE * WIDE] = np.sqrt(n / (len(c) + PRIOR))
        words, lines = raw.lower().split(), raw.split(b"\n")
        # new words grow with the square root of their number in ordinary text
        fresh = len(set(words)) / max(len(words), 1) ** 0.75 if words else 1.0
        out[k, WIDE * WIDE :] = fresh, len(set(lines)) / len(lines), np.log1p(len(raw)) / 10, min(len(raw) / (len(words) + 1), 40) / 20
    return out


class Space:
    """Weights, latent axes and labelled vectors learnt from the features of a sample."""

    def __init__(self, x: np.ndarray, labels: list[int], dimensions: int = DIMENSIONS):
        self.weights = np.log((1 + len(x)) / (1 + (x > 0).sum(axis=0))).astype(np.float32) + 1
        x *= self.weights
        self.centre = x.mean(axis=0) if len(x) else np.zeros(x.shape[1], np.float32)
        x -= self.centre
        # The decomposition of a random sketch of the rows' span: a few times cheaper, the same leading axes.
        rng = np.random.default_rng(0)
        q = np.linalg.qr(x.T @ rng.standard_normal((len(x), min(len(x), 2 * dimensions))).astype(np.float32))[0] if len(x) else x.T
        for _ in range(2 if len(x) else 0):
            q = np.linalg.qr(x.T @ (x @ q))[0]
        self.axes = (q @ np.linalg.svd(x @ q, full_matrices=False)[2].T[:, :dimensions]).astype(np.float32) if len(x) else np.zeros((x.shape[1], 1), np.float32)
        self.vectors = unit(x @ self.axes)
        self.labels = np.array(labels, np.float32)

    def project(self, texts: list[str | None]) -> np.ndarray:
        x = features(texts)
        x *= self.weights
        x -= self.centre
        return unit(x @ self.axes)

    def score(self, texts: list[str | None], neighbours: int = NEIGHBOURS) -> np.ndarray:
        """Similarity-weighted share of label 1 among the nearest; without labelled rows 0.5."""
        if not len(self.labels):
            return np.full(len(texts), 0.5)
        near = self.project(texts) @ self.vectors.T
        k = min(neighbours, len(self.labels))
        top = np.argpartition(-near, k - 1, axis=1)[:, :k]
        w = np.maximum(np.take_along_axis(near, top, axis=1), 1e-3).astype(np.float64) ** SHARPNESS
        return (w * self.labels[top]).sum(axis=1) / w.sum(axis=1)


def unit(x: np.ndarray) -> np.ndarray:
    return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-9)


def held_out(doc_id):
    """Rows whose labels are never learnt from."""
    return F.crc32(doc_id.cast("string").cast("binary")) % 3 == 1


def learn(docs: DataFrame, labels: DataFrame, sample: dict[int, int] = SAMPLE) -> Space:
    """The space of at most sample[label] labelled rows of each label, none of them held out.

    Rows are taken by the smallest hash of their id. Null labels and null ids
    teach nothing; an id with several labels counts once for each, and of an id's
    rows the one whose text has the smallest hash teaches. Features are computed
    in tasks: vectors of fixed width come to the driver, 30 KB each.
    """
    usable = labels.select("doc_id", "quality").where(F.col("doc_id").isNotNull() & F.col("quality").isin(0, 1) & ~held_out(F.col("doc_id"))).distinct()
    order = [F.xxhash64("doc_id"), "doc_id"]
    picked = usable.where("quality = 0").orderBy(*order).limit(sample[0]).union(usable.where("quality = 1").orderBy(*order).limit(sample[1]))
    d = docs.select("doc_id", "text").where("doc_id is not null")
    wanted = d.join(F.broadcast(picked), "doc_id").select("doc_id", "quality", "text", F.xxhash64("text").alias("h"))
    first = wanted.groupBy("doc_id", "quality").agg(F.min_by("text", "h").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for a in range(0, b.num_rows, BLOCK):
                part = b.slice(a, BLOCK)
                x = [zlib.compress(v.tobytes(), 1) for v in features(part.column(2).to_pylist())]
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(x, pa.binary())], ["doc_id", "quality", "x"])

    typed = first.select(F.col("doc_id").cast("long"), F.col("quality").cast("int"), F.coalesce("text", F.lit("")).alias("text"))
    rows = typed.mapInArrow(run, "doc_id long, quality int, x binary").collect()
    rows.sort(key=lambda r: (r["doc_id"], r["quality"]))
    x = np.zeros((len(rows), WIDE * WIDE + LAYOUT), np.float32)
    for k, r in enumerate(rows):
        x[k] = np.frombuffer(zlib.decompress(r["x"]), np.float32)
    return Space(x, [r["quality"] for r in rows])


def score_quality(docs: DataFrame, labels: DataFrame, sample: dict[int, int] = SAMPLE) -> DataFrame:
    """One row per row of docs: doc_id, held_out, score, predicted.

    docs needs doc_id and text, labels doc_id and quality; other columns are
    ignored. Only text enters a score. Null, empty and one-byte texts have the
    zero vector before centring and are scored like any other. A null id counts
    as not held out. Without labelled rows every score is 0.5. Repeated rows
    are repeated; an empty table gives no rows.
    """
    sent = docs.sparkSession.sparkContext.broadcast(learn(docs, labels, sample))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        space = sent.value
        for b in batches:
            for a in range(0, len(b), BLOCK):
                part = b.iloc[a : a + BLOCK]
                yield pd.DataFrame({"doc_id": part["doc_id"], "held_out": part["held_out"], "score": space.score(part["text"].tolist())})

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(held_out(F.col("doc_id")), F.lit(False)).alias("held_out"), F.coalesce("text", F.lit("")).alias("text"))
    scored = rows.mapInPandas(run, "doc_id long, held_out boolean, score double")
    return scored.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))


def keep_good(docs: DataFrame, labels: DataFrame, sample: dict[int, int] = SAMPLE) -> DataFrame:
    """The rows of docs that are not rejected (score under 0.5), with all their columns, without a shuffle.

    Cases as for score_quality(): null and empty texts are scored like any
    other, repeated rows stay or go together, an empty table gives no rows, and
    without labelled rows all stay.
    """
    sent = docs.sparkSession.sparkContext.broadcast(learn(docs, labels, sample))

    @F.pandas_udf("double")
    def score(texts: pd.Series) -> pd.Series:
        out = [sent.value.score(texts.iloc[a : a + BLOCK].tolist()) for a in range(0, len(texts), BLOCK)]
        return pd.Series(np.concatenate(out) if out else np.zeros(0))

    return docs.where(score(F.coalesce(docs["text"], F.lit(""))) >= 0.5)
