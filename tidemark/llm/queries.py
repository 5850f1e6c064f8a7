"""The corpus operators as queries over the given tables, with their SQL where SQL can say it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm import chat, collocations, decontam, exact_dedup, learned_index, mixing, pii, quality, secret_scan, simhash, suffix_dedup, token_store, whitening
from tidemark.llm.common import hex_sha256, table
from tidemark.llm.spans import joined


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def op1_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.simhash_components(table(spark, sf_dir, "documents"))


def op2_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontam.judged(decontam.find_contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")))
    names = F.array_join(F.array_sort(F.transform("items", lambda i: i.cast("string"))), ",")
    return found.select("doc_id", "n_words", "n_hit", "n_items", hex_sha256(names).alias("items_sha256"), "contaminated")


def op3_token_output(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_store.token_output(table(spark, sf_dir, "documents"), tokenizer_path())


def _span_digests(found: DataFrame, kinds: list[str], counted: list[str]) -> DataFrame:
    counts = [F.size(F.filter("base", lambda s: s["kind"] == k)).cast("long").alias(f"n_{k}") for k in counted]  # noqa: B023
    return found.select("doc_id", *counts, hex_sha256(joined(F.col("base"), kinds)).alias("base_sha256"), joined(F.col("spans"), kinds).alias("spans"))


def op4_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _span_digests(pii.find_pii(table(spark, sf_dir, "documents")), pii.KINDS, pii.KINDS)


def op5_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _span_digests(secret_scan.find_secrets(table(spark, sf_dir, "documents")), secret_scan.KINDS, secret_scan.KINDS[:3])


def op6_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.score_quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op8_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents").select("doc_id", "source", "text")).select("doc_id", F.col("mix_source").alias("source"), F.col("mix_block").alias("block"), F.col("mix_slot").alias("slot"), F.col("mix_order").alias("order_in_slot"))


def op7_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_dedup(table(spark, sf_dir, "documents"))


def op9_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    said = "</s>[INST] ok [/INST]"
    extra = spark.sql(f"select -1L as conv_id, t as turn, r as role, '{said}' as text from values (0L, 'user'), (1L, 'assistant') as v(t, r)")
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(extra)
    out = chat.format_chats(rows.select("conv_id", "turn", "role", chat.text_parts(F.col("text")).alias("parts")))
    back = chat.parse_chats(out).withColumn("loss", chat.loss_text(F.col("formatted"), F.col("loss_spans")))
    said_all = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return back.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        hex_sha256(said_all).alias("turns_sha256"),
        F.length("loss").cast("long").alias("loss_chars"),
        hex_sha256(F.col("loss")).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
    )


def op10_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    cut = suffix_dedup.cut_repeats(table(spark, sf_dir, "documents"))
    n_removed = F.aggregate("removed", F.lit(0).cast("long"), lambda a, s: a + s["last"] - s["first"])
    return cut.select("doc_id", "n_bytes", n_removed.alias("n_removed"), F.size("removed").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))


def op11_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return learned_index.search(table(spark, sf_dir, "embeddings"))


def op12_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.whiten(table(spark, sf_dir, "embeddings"))


def op13_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations.collocations(table(spark, sf_dir, "documents"))


QUERIES = {
    f.__name__: f
    for f in (
        op1_simhash_near_dedup,
        op2_decontamination,
        op3_token_output,
        op4_pii,
        op5_secret_scan,
        op6_quality,
        op7_exact_dedup,
        op8_mixing,
        op9_chat_format,
        op10_suffix_dedup,
        op11_nearest_neighbours,
        op12_whitening,
        op13_collocations,
    )
}

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

ORACLES = {
    "op2_decontamination": rf"""
with words as (
  select doc_id, regexp_extract_all(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as w from documents),
items as (
  select item_id, regexp_extract_all(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as w from benchmark),
wins as (
  select distinct item_id, least(len(w), 13) as n, array_to_string(w[k:k + least(len(w), 13) - 1], ' ') as win
  from items, unnest(range(1, greatest(len(w) - 13, 0) + 2)) as u(k) where len(w) > 0),
sizes as (select distinct n from wins),
found as (
  select d.doc_id, d.k, s.n, x.item_id
  from (select doc_id, w, unnest(range(1, len(w) + 1)) as k from words) d
  join sizes s on d.k + s.n - 1 <= len(d.w)
  join wins x on x.n = s.n and x.win = array_to_string(d.w[d.k:d.k + s.n - 1], ' ')),
hits as (select doc_id, count(distinct k + j) as n_hit from found, unnest(range(0, n)) as u(j) group by doc_id),
of as (select doc_id, count(*) as n_items, string_agg(item_id, ',' order by item_id) as ids
  from (select distinct doc_id, cast(item_id as varchar) as item_id from found) group by doc_id)
select w.doc_id, cast(len(w.w) as bigint) as n_words, cast(coalesce(n_hit, 0) as bigint) as n_hit,
  cast(coalesce(n_items, 0) as bigint) as n_items, sha256(coalesce(ids, '')) as items_sha256,
  coalesce(n_hit, 0) > 0 and 20 * coalesce(n_hit, 0) >= len(w.w) as contaminated
from words w left join hits h using (doc_id) left join of o using (doc_id)""",
    "op7_exact_dedup": r"""
with n as (select doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') as t from documents)
select doc_id, min(doc_id) over (partition by t) as keep_id, count(*) over (partition by t) as group_size,
  doc_id = min(doc_id) over (partition by t) as kept, sha256(t) as text_sha256
from n""",
    "op9_chat_format": r"""
with m as (
  select conv_id, turn, coalesce(role, '') as role, coalesce(text, '') as text from conversations
  union all select -1, 0, 'user', '</s>[INST] ok [/INST]' union all select -1, 1, 'assistant', '</s>[INST] ok [/INST]'),
e as (select *, length(role) + length(text) + (length(role || text) - length(replace(replace(replace(role || text, '\', ''), '<', ''), '[', ''))) + length('<|turn|><|body|><|end|>') as n from m)
select conv_id, count(*) as n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' order by turn, role, text)) as turns_sha256,
  cast(coalesce(sum(length(text)) filter (role = 'assistant'), 0) as bigint) as loss_chars,
  sha256(coalesce(string_agg(text, '' order by turn, role, text) filter (role = 'assistant'), '')) as loss_sha256,
  cast(sum(n) as bigint) as formatted_chars
from e group by conv_id""",
    "op13_collocations": rf"""
with pieces as (
  select row_number() over () as p, lang, list_filter(regexp_split_to_array(piece, '[\x20\x09]+'), lambda w: w <> '') as w
  from (select coalesce(lang, 'und') as lang, unnest(regexp_split_to_array(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'), '[.,;:!?\x0A-\x0D]')) as piece from documents)),
grams as (
  select lang, k, array_to_string(w[i:i + k - 1], ' ') as phrase, w[i:i + k - 1] as ws, count(*) as f
  from (select lang, w, k, unnest(range(1, len(w) - k + 2)) as i from pieces, (values (1), (2), (3)) as s(k))
  group by all),
totals as (select lang, cast(sum(len(w)) as bigint) as n from pieces group by lang),
cuts as (
  select c.lang, c.k, c.phrase, c.ws, c.f as a, x.cut, l.f as l, r.f as r,
    cast(1000000::hugeint * c.f * c.f // (l.f::hugeint * r.f) as bigint) as score
  from grams c join (values (1), (2)) as x(cut) on x.cut < c.k
  join grams l on l.lang = c.lang and l.phrase = array_to_string(c.ws[1:x.cut], ' ')
  join grams r on r.lang = c.lang and r.phrase = array_to_string(c.ws[x.cut + 1:c.k], ' ')
  where c.k > 1 and c.f >= 10),
best as (select * from cuts qualify row_number() over (partition by lang, phrase order by score, cut) = 1),
longer as (
  select lang, phrase, max(f) as m from (
    select lang, array_to_string(ws[1:2], ' ') as phrase, f from grams where k = 3 and f >= 10
    union all select lang, array_to_string(ws[2:3], ' '), f from grams where k = 3 and f >= 10)
  group by lang, phrase),
kept as (select b.* from best b left join longer g on g.lang = b.lang and g.phrase = b.phrase and b.k = 2 where m is null or 100 * m < 50 * a)
select lang, rank, phrase, a, l, r, n, score from (
  select *, row_number() over (partition by lang order by score desc, a desc, phrase) as rank from kept) join totals using (lang)
where rank <= 2000""",
}
