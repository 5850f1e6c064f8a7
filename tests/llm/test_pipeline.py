import zlib

import numpy as np

import corpus_pipeline
from tests.conftest import SF
from tests.llm.test_dedup import brute_components
from tests.llm.test_text import brute_contamination, reference_ids
from tidemark.llm import mixing, quality
from tidemark.llm.common import table
from tidemark.storage import stored


def test_every_stage_against_a_plain_version(spark):
    docs = table(spark, SF, "documents")
    columns = docs.columns
    texts = {r.doc_id: r.text or "" for r in docs.collect()}
    items = [(r.item_id, r.text) for r in table(spark, SF, "benchmark").collect()]
    kept = set(texts)
    space = quality.learn(docs, table(spark, SF, "labels"))
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = stored(stage(spark, docs, SF))
        assert docs.columns == columns, name
        if name == "quality":
            ids = sorted(kept)
            kept = {i for i, s in zip(ids, space.score([texts[i] for i in ids])) if s >= 0.5}
        elif name == "near_dedup":
            kept = {c for _, _, c in brute_components([(i, texts[i]) for i in kept])}
        elif name == "decontamination":
            bad = {i for i, n, h, _ in brute_contamination([(i, texts[i]) for i in kept], items, 13) if h and 20 * h >= n}
            assert bad
            kept -= bad
        else:
            order = [r.doc_id for r in docs.select("doc_id", "_metadata.file_name", "_metadata.row_index").orderBy("file_name", "row_index").collect()]
        assert {r.doc_id for r in docs.collect()} == kept, name
        before = docs
    slots = {r.doc_id: (r.mix_slot, r.mix_source, r.mix_order) for r in mixing.mix(before).collect()}
    assert order == sorted(slots, key=lambda i: slots[i])
    want, at = [], 0
    for i, ids in zip(order, reference_ids([texts[i] for i in order])):
        want.append((i, at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        at += len(ids)
    got = corpus_pipeline.STAGES[-1][1](spark, docs, SF).collect()
    assert sorted((tuple(r) for r in got), key=lambda r: r[1]) == want
    assert sorted((tuple(r) for r in corpus_pipeline.run(spark, SF).collect()), key=lambda r: r[1]) == want


def test_pipeline_of_no_documents(spark):
    docs = table(spark, SF, "documents").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        docs = stored(stage(spark, docs, SF))
    assert docs.count() == 0
