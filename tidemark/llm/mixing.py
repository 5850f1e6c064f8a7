"""Mixing sources to target weights by Pfair scheduling.

A source's documents, in the order of a hash of their ids and texts, are cut into blocks
of BLOCK_CHARS characters. Time runs in slots of one block. Block j of a
source of weight w may run from slot floor(j / w) on and must run before slot
ceil((j + 1) / w), in whole numbers without rounding; the earliest deadline among the released
blocks runs. With weights that sum to one, every block meets its window, so that at any slot
each source that has blocks left is less than one block away from its weight's share, however long the corpus.

The state of a schedule is how many blocks each source has had. The driver runs it once and
notes this state every so many slots; tasks lay out the slots between two notes. To bound what the
driver does, blocks grow with the corpus beyond BLOCKS of them.
Slots of a source that has run out stay empty or take another's released block; nothing is dropped or repeated.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from itertools import islice

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidemark.llm.common import BROADCAST_BYTES
from tidemark.storage import stored

#: Characters in a block, blocks at most before they grow, blocks between two notes, exponent that smooths shares.
BLOCK_CHARS, BLOCKS, NOTED, EXPONENT = 1 << 16, 1 << 22, 4096, 0.5
#: Ranges of the hash into which a source is cut for counting: the least number of bits; more if a cut of 2**20 rows of all needs them.
CUT_BITS, CUT_ROWS = 10, 1 << 20
#: What mix() adds.
MIX_COLUMNS = ["mix_source", "mix_block", "mix_slot", "mix_order"]
#: Weights are whole multiples of one part in so many.
PARTS = 1 << 60


def whole(weights: dict[str, float]) -> dict[str, int]:
    """Weights as numbers of PARTS that sum to PARTS, at least one each; equal if all weights are zero."""
    total = sum(weights.values())
    out = {s: max(1, int(w / total * PARTS) if total else PARTS // len(weights)) for s, w in weights.items()}
    out[max(out, key=lambda s: (out[s], s))] += PARTS - sum(out.values())
    return out


def window(block: int, weight: int) -> tuple[int, int]:
    """First slot of a block's window and the slot it must come before."""
    return block * PARTS // weight, -(-(block + 1) * PARTS // weight)


def schedule(weights: dict[str, int], blocks: dict[str, int], done: dict[str, int] | None = None, slot: int = 0) -> Iterator[tuple[int, str, int]]:
    """(slot, source, block) in order, from a state on: earliest deadline first among released blocks, ties by source. Slots without one are left out."""
    waiting, ready = [], []  # (release, source, block), (deadline, source, block)
    for s in weights:
        if (j := (done or {}).get(s, 0)) < blocks.get(s, 0):
            waiting.append((window(j, weights[s])[0], s, j))
    heapq.heapify(waiting)
    while waiting or ready:
        if not ready:
            slot = max(slot, waiting[0][0])
        while waiting and waiting[0][0] <= slot:
            _, s, j = heapq.heappop(waiting)
            heapq.heappush(ready, (window(j, weights[s])[1], s, j))
        deadline, s, j = heapq.heappop(ready)
        if deadline <= slot:
            raise AssertionError("a block missed its deadline")
        yield slot, s, j
        if j + 1 < blocks[s]:
            heapq.heappush(waiting, (window(j + 1, weights[s])[0], s, j + 1))
        slot += 1


def smoothed_weights(docs: DataFrame, exponent: float = EXPONENT) -> dict[str, float]:
    """Each source's share of all characters to a power; one number per source comes to the driver.

    Null sources count as the empty one, null texts as empty, a source without characters as if it had one; an empty table has no weights.
    """
    rows = docs.groupBy(F.coalesce("source", F.lit("")).alias("s")).agg(F.sum(F.length(F.coalesce("text", F.lit("")))).alias("n")).collect()
    return {r["s"]: float(max(r["n"], 1)) ** exponent for r in rows}


def notes(weights: dict[str, int], blocks: dict[str, int], every: int = NOTED) -> Iterator[tuple[int, list[int], int]]:
    """The slot, the blocks done of each source of weights, and the blocks to come until the next note."""
    every = max(every, 16 * len(weights))
    total = sum(n for s, n in blocks.items() if s in weights)
    done = dict.fromkeys(weights, 0)
    for k, (slot, s, _) in enumerate(schedule(weights, blocks)):
        if k % every == 0:
            yield slot, list(done.values()), min(every, total - k)
        done[s] += 1


def mix(docs: DataFrame, weights: dict[str, float] | None = None, block_chars: int | None = None) -> DataFrame:
    """docs with its columns and mix_source, mix_block, mix_slot, mix_order.

    Documents in order of (mix_slot, mix_order) are the mix. docs needs doc_id,
    text and source. A null source counts as the empty one; sources that weights
    leave out come after all others; null text is empty; a document longer than
    a block takes the slot it starts in. Rows that tie in the hash stand in the order
    of their ids and their texts' lengths, equal rows are interchangeable; rows without an id
    go by their text. Columns of docs that bear one of the new names give
    way to them here and stay in in_mixed_order(). An empty table gives no rows. Blocks
    have block_chars characters; by default BLOCK_CHARS, or more if the corpus has over BLOCKS such blocks.
    """
    timed = _timed(docs, weights, block_chars)
    return timed.select(*[F.col(f"mix_c{k}").alias(c) for k, c in enumerate(docs.columns) if c.lower() not in MIX_COLUMNS], *MIX_COLUMNS)


def _timed(docs: DataFrame, weights: dict[str, float] | None, block_chars: int | None) -> DataFrame:
    """The columns of docs, as mix_c0, mix_c1, ..., mix_id (the doc_id) and MIX_COLUMNS."""
    spark = docs.sparkSession
    weights = smoothed_weights(docs) if weights is None else weights
    # of an id, however many rows have it, each text has a hash of its own
    hashed = F.xxhash64("doc_id", "text")
    bits = max(CUT_BITS, (docs.count() // CUT_ROWS).bit_length())
    rows = docs.select(
        *[docs[c].alias(f"mix_c{k}") for k, c in enumerate(docs.columns)],
        F.col("doc_id").alias("mix_id"),
        F.coalesce("source", F.lit("")).alias("mix_source"),
        hashed.alias("mix_order"),
        F.shiftrightunsigned(hashed, 64 - bits).alias("mix_cut"),
        F.length(F.coalesce("text", F.lit(""))).cast("long").alias("mix_chars"),
    )
    # Characters before each cut of a source: at most 2**bits rows a source.
    cuts = rows.groupBy("mix_source", "mix_cut").agg(F.sum("mix_chars").alias("n"))
    before = F.coalesce(F.sum("n").over(Window.partitionBy("mix_source").orderBy("mix_cut").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    cuts = stored(cuts.withColumn("mix_before", before).withColumnRenamed("n", "mix_own"))
    if block_chars is None:
        size = cuts.agg(F.sum("mix_own").alias("n")).first()["n"] or 0
        block_chars = max(BLOCK_CHARS, -(-size // BLOCKS))
    own = Window.partitionBy("mix_source", "mix_cut").orderBy("mix_order", "mix_id", "mix_chars").rowsBetween(Window.unboundedPreceding, -1)
    placed = rows.withColumn("mix_chars", F.coalesce(F.sum("mix_chars").over(own), F.lit(0)))
    placed = placed.join(cuts, ["mix_source", "mix_cut"]).drop("mix_own").withColumn("mix_block", F.floor((F.col("mix_before") + F.col("mix_chars")) / block_chars))
    ends = cuts.groupBy("mix_source").agg(F.max(F.col("mix_before") + F.col("mix_own")).alias("n")).collect()
    blocks = {r["mix_source"]: r["n"] // block_chars + 1 for r in ends}
    parts = whole(weights) if weights else {}
    plan = spark.createDataFrame(list(notes(parts, blocks)), "slot long, done array<long>, n long")

    def laid_out(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            for r in f.itertuples():
                there = islice(schedule(parts, blocks, dict(zip(parts, map(int, r.done))), int(r.slot)), int(r.n))
                yield pd.DataFrame([(s, j, t) for t, s, j in there], columns=["mix_source", "mix_block", "mix_slot"])

    times = plan.repartition("slot").mapInPandas(laid_out, "mix_source string, mix_block long, mix_slot long")
    small = sum(n for s, n in blocks.items() if s in weights) * 128 <= BROADCAST_BYTES
    timed = placed.join(F.broadcast(times) if small else times, ["mix_source", "mix_block"], "left")
    return timed.select(*[f"mix_c{k}" for k in range(len(docs.columns))], "mix_id", "mix_source", "mix_block", F.coalesce("mix_slot", F.lit((1 << 62)) + F.col("mix_block")).alias("mix_slot"), "mix_order")


def in_mixed_order(docs: DataFrame, weights: dict[str, float] | None = None, block_chars: int | None = None) -> DataFrame:
    """The rows and columns of docs, written out in the order of the mix: partition by partition, row by row.

    Every row stays, with its columns, whatever their names. Cases as for mix().
    """
    keys = ["mix_slot", "mix_source", "mix_order", "mix_id"]
    mixed = _timed(docs, weights, block_chars)
    return mixed.repartitionByRange(*keys).sortWithinPartitions(*keys).select(*[F.col(f"mix_c{k}").alias(c) for k, c in enumerate(docs.columns)])
