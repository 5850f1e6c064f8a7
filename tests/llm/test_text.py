import json
import re
import zlib
from hashlib import sha256

import numpy as np
import pytest
from pyspark.sql import functions as F

from tests.conftest import SF
from tests.llm.cases import SCHEMA, documents
from tidemark.llm import chat, decontam, queries, token_store

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def lower(t):
    return re.sub("[A-Z]", lambda m: m.group().lower(), t or "")


def brute_contamination(docs, items, window):
    wins = {}
    for i, t in items:
        w = WORD.findall(lower(t))
        for k in range(max(1, len(w) - window + 1) if w else 0):
            wins.setdefault(tuple(w[k : k + window]), set()).add(i)
    out = []
    for d, t in docs:
        w = WORD.findall(lower(t))
        hit, of = set(), set()
        for k in range(len(w)):
            for n in {len(x) for x in wins}:
                if tuple(w[k : k + n]) in wins and k + n <= len(w):
                    hit.update(range(k, k + n))
                    of |= wins[tuple(w[k : k + n])]
        out.append((d, len(w), len(hit), sorted(of)))
    return sorted(out, key=repr)


@pytest.mark.parametrize("block_windows", [1 << 20, 200])
def test_contamination_against_brute_force(spark, block_windows):
    rows = documents()
    items = [(k, r[1]) for k, r in enumerate(rows[5:25])] + [(90, None), (91, "..."), (92, "A b"), (92, "A b")]
    bench = spark.createDataFrame(items, "item_id long, text string")
    found = decontam.judged(decontam.find_contamination(spark.createDataFrame(rows, SCHEMA), bench, 4, block_windows))
    got = sorted(((r.doc_id, r.n_words, r.n_hit, r.items) for r in found.collect()), key=repr)
    assert got == brute_contamination([r[:2] for r in rows], items, 4)


def test_contaminated_spans_map_to_the_original(spark):
    text = "Xx, it -- was;  ONE two\nthree!! four yy"
    docs = spark.createDataFrame([(1, text, 0)], "doc_id long, text string, start int")
    bench = spark.createDataFrame([(5, "one TWO three, four")], "item_id long, text string")
    (row,) = decontam.contaminated_spans(docs, bench).collect()
    assert [text[s.start : s.end] for s in row.spans] == ["ONE two\nthree!! four"]
    again = docs.union(docs).unionByName(spark.createDataFrame([(1, "none of it", 0), (None, text, 1), (None, None, 2)], docs.schema)).withColumn("spans", F.lit(1)).withColumn("h", F.lit(2))
    assert sorted((str(r.doc_id), [text[s.start : s.end] for s in r.spans]) for r in decontam.contaminated_spans(again, bench).collect()) == [("1", ["ONE two\nthree!! four"])] * 2 + [("None", ["ONE two\nthree!! four"])]
    assert decontam.decontaminate(docs, bench).count() == 0
    assert decontam.decontaminate(docs, bench.limit(0)).count() == 1
    assert decontam.find_contamination(docs.limit(0), bench).count() == 0


def reference_ids(texts):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(queries.tokenizer_path())
    return [e.ids + [0] for e in t.encode_batch(texts, add_special_tokens=False)]


def check_tokens(got, rows):
    rows = sorted(((i, t or "") for i, t in rows), key=lambda r: (r[0] is not None, r[0] or 0))
    at, want = 0, []
    for (i, _), ids in zip(rows, reference_ids([t for _, t in rows])):
        want.append((i, at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        at += len(ids)
    assert sorted(((r.doc_id, r.start, r.n_tokens, r.ids_crc32) for r in got), key=lambda r: r[1]) == want


def test_tokens_of_the_documents(spark):
    got = queries.op3_token_output(spark, SF).collect()
    check_tokens(got, [tuple(r) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()])


def test_tokens_of_odd_texts(spark, tmp_path):
    odd = ["\n", "a\n", "\na", "a\n\nb", "a \nb", "a\n b", " a", "a ", "a  b", "a b c", "a b c", "it's I'll we've", "<|endoftext|> x <|endoftext|>", "x <|endoftext|> y", "a b<|endoftext|>c", "a <|endoftext| > b", "<|endoftext|>", "w" * 200 + " x", "1 22 333 ² Ⅷ", "a\tb", "!! ?? ", "\U0001f600 \U0001f600x"]
    rows = [(i, t) for i, t in enumerate(odd + [None, ""])] + [(1000 + i, r[1]) for i, r in enumerate(documents())]
    df = spark.createDataFrame([(i, t, 0) for i, t in rows], "doc_id long, text string, shard int").repartition(3)
    token_store.write_tokens(df, queries.tokenizer_path(), str(tmp_path / "a"), block=100, segment=1000)
    check_tokens(token_store.read_tokens(spark, str(tmp_path / "a")).collect(), rows)
    none = df.limit(0)
    assert token_store.token_output(none, queries.tokenizer_path()).count() == 0


def test_words_beyond_the_cache_are_encoded_too():
    coder = token_store.Coder(queries.tokenizer_path(), cache_words=0)
    texts = ["one two three", "two four\nfive six", "one"]
    assert [list(x) + [0] for x in coder.encode(texts)] == reference_ids(texts)
    # the library's own id of a special token, and no memory of long words
    kept = token_store.Coder(queries.tokenizer_path())
    texts = ["x <|endoftext|> y", "x " + "ab" * 500, "x " + "ab" * 500]
    assert [list(x) + [0] for x in kept.encode(texts)] == reference_ids(texts)
    assert 50256 in kept.encode(texts)[0] and not any(len(w) > token_store.CACHE_WORD_BYTES for w in kept.known)


def test_planes_round_trip():
    ids = np.arange(0, 300000, 7, dtype="<u4")
    packed = token_store.pack(ids, 1000)
    assert (token_store.unpack(packed) == ids).all()
    assert (token_store.unpack(packed, 3) == ids[3000:4000]).all()
    assert token_store.unpack(token_store.pack(np.zeros(0, "<u4"))).size == 0


def test_chat_round_trip_and_mask(spark):
    texts = ["</s>[INST] ok [/INST]", "\\l \\\\e < [ \\", "<|turn|><|end|>", None, "", "\U0001f600 é", "x" * 50000]
    rows = [(c, t, role, texts[(c + t) % len(texts)], 1, 2) for c in range(9) for t, role in enumerate(["system", "user", "assistant", None, "<|end|>", "assistant"])]
    rows += [(None, None, None, None, 1, 2), (0, 1, "user", "again", 1, 2), rows[0]]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, ms int, n_turns int").repartition(5)
    out = chat.format_chats(df.select("*", chat.text_parts(F.col("text")).alias("parts")))
    got = chat.parse_chats(out).withColumn("loss", chat.loss_text(F.col("formatted"), F.col("loss_spans"))).collect()
    want = {}
    for c, t, role, text, _, _ in rows:
        want.setdefault(c, []).append((t is not None, t or 0, role or "", text or ""))
    assert len(got) == len(want)
    for r in got:
        turns = sorted(want[r.conv_id], key=lambda x: (x[0], x[1], x[2], x[3].replace("\\", "\\e").replace("<", "\\l").replace("[", "\\b")))
        assert [(x.role, x.text) for x in r.turns] == [x[2:] for x in turns]
        assert r.loss == "".join(x[3] for x in turns if x[2] == "assistant")
        assert r.n_turns == len(turns)
    assert chat.format_chats(df.limit(0).select("*", chat.text_parts(F.col("text")).alias("parts"))).count() == 0


def test_chat_attachments(spark):
    parts = [("text", "see < ", None, None), ("image", None, "a.png", 64), ("text", "and", None, None), ("audio", None, "b.wav", 3), ("document", None, None, None), ("odd|>", None, "z", 1)]
    df = spark.createDataFrame([(1, 0, "user", parts), (1, 1, "assistant", None)], f"conv_id long, turn long, role string, parts array<{chat.PART}>")
    (row,) = chat.format_chats(df).collect()
    assert "see \\l <part:image<>and<part:audio<><part:document<>" in row.formatted
    assert [(a.ordinal, a.type, a.ref, a.tokens) for a in row.attachments] == [(0, "image", "a.png", 64), (1, "audio", "b.wav", 75), (2, "document", None, 512), (3, "odd|>", "z", 0)]
    assert row.attachment_tokens == 651


@pytest.mark.parametrize("kind", ["turn", "body", "end", "|turn|", "<|turn|>", "<>", "\\l", "", "[INST]"])
def test_part_types_forge_no_marks(spark, kind):
    parts = [("text", "a", None, None), (kind, None, "x", 1), ("text", "b", None, None)]
    df = spark.createDataFrame([(1, 0, "user", parts), (1, 1, "assistant", [("text", "yes", None, None)])], f"conv_id long, turn long, role string, parts array<{chat.PART}>")
    (row,) = chat.parse_chats(chat.format_chats(df)).withColumn("loss", chat.loss_text(F.col("formatted"), F.col("loss_spans"))).collect()
    assert [t.role for t in row.turns] == ["user", "assistant"] and row.loss == "yes"
    assert [a.type for a in row.attachments] == [kind]
    assert row.formatted.count(chat.TURN) == row.formatted.count(chat.BODY) == row.formatted.count(chat.END) == 2
    shown = row.formatted.split(chat.OPEN)[1].split(chat.CLOSE)[0]
    assert shown.replace("\\b", "[").replace("\\l", "<").replace("\\e", "\\") == kind


def test_queries_return_one_row_each(spark):
    n = spark.read.parquet(f"{SF}/documents.parquet").count()
    assert queries.op2_decontamination(spark, SF).count() == n
    assert json.dumps(sorted(queries.ORACLES))
    assert sha256(b"").hexdigest() in {r.items_sha256 for r in queries.op2_decontamination(spark, SF).collect()}


@pytest.mark.parametrize("i", [None, 4])
def test_rows_that_share_an_id_are_judged_by_their_own_texts(spark, i):
    docs = spark.createDataFrame([(i, "one two three four"), (i, "a clean text"), (i, None), (9, "one two three four"), (9, "clean too")], "doc_id long, text string")
    bench = spark.createDataFrame([(5, "one TWO three, four")], "item_id long, text string")
    kept = decontam.decontaminate(docs, bench).collect()
    assert sorted(map(tuple, kept), key=repr) == sorted([(i, "a clean text"), (i, None), (9, "clean too")], key=repr)
