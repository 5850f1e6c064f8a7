"""Chat formatting: typed content parts flattened to text with placeholders, and a loss mask.

A conversation becomes one string. Markers all begin with "<"; inside roles
and texts "<" and "[" are escaped (with the escape character itself), so no
control string of this template or of the common ones can occur in content,
and undoing the escape gives back the exact text.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

TURN, BODY, END = "<|turn|>", "<|body|>", "<|end|>"
#: A placeholder stands between these: no type makes it a mark of a turn, and its type is escaped like a text.
OPEN, CLOSE = "<part:", "<>"

#: Escape images: no image contains the escape character twice, so they are undone in any order but the escape's own, which is last.
ESCAPES = (("\\", "\\e"), ("<", "\\l"), ("[", "\\b"))

#: What an attachment expands to, in tokens per unit of its size: patches, seconds, pages.
TOKENS_PER_UNIT = {"image": 1, "audio": 25, "document": 512}

PART = "struct<type:string,text:string,ref:string,size:int>"


def escape(c: Column) -> Column:
    for plain, image in ESCAPES:
        c = F.replace(c, F.lit(plain), F.lit(image))
    return c


def unescape(c: Column) -> Column:
    for plain, image in ESCAPES[1:] + ESCAPES[:1]:
        c = F.replace(c, F.lit(image), F.lit(plain))
    return c


def _visit(part: Column) -> Column:
    """A part's flat form: its escaped text, or a placeholder that names its kind."""
    kind = F.coalesce(part["type"], F.lit("text"))
    return F.when(kind == "text", escape(F.coalesce(part["text"], F.lit("")))).otherwise(F.concat(F.lit(OPEN), escape(kind), F.lit(CLOSE)))


def _expanded(part: Column) -> Column:
    units = F.greatest(F.coalesce(part["size"], F.lit(1)), F.lit(1))
    tokens = F.lit(0)
    for kind, each in TOKENS_PER_UNIT.items():
        tokens = F.when(part["type"] == kind, units * each).otherwise(tokens)
    return tokens


def text_parts(text: Column) -> Column:
    """A plain text as the single part of a message."""
    return F.array(F.struct(F.lit("text").alias("type"), F.coalesce(text, F.lit("")).alias("text"), F.lit(None).cast("string").alias("ref"), F.lit(None).cast("int").alias("size")))


def format_chats(messages: DataFrame) -> DataFrame:
    """messages (conv_id, turn, role, parts array<PART>) to one row per conversation.

    Returns conv_id, n_turns, formatted, loss_spans (start and length in code
    points of each assistant body), attachments (ordinal, type, ref, tokens, in
    order of placeholders), attachment_tokens. Rows go by turn, ties by role and
    then by content, nulls first; repeated rows are repeated turns. Null roles,
    texts and parts are empty. A null conv_id is a conversation of its own. An
    empty table gives no rows. A conversation becomes one string, so its rows
    meet in one task; conversations are spread over tasks.
    """
    flat = messages.select(
        "conv_id",
        F.struct(
            F.col("turn"),
            F.coalesce("role", F.lit("")).alias("role"),
            F.array_join(F.transform(F.coalesce("parts", F.array().cast(f"array<{PART}>")), _visit), "").alias("body"),
            F.transform(
                F.filter(F.coalesce("parts", F.array().cast(f"array<{PART}>")), lambda p: F.coalesce(p["type"], F.lit("text")) != "text"),
                lambda p: F.struct(p["type"].alias("type"), p["ref"].alias("ref"), _expanded(p).alias("tokens")),
            ).alias("files"),
        ).alias("m"),
    )
    chats = flat.groupBy("conv_id").agg(F.sort_array(F.collect_list("m")).alias("ms"))
    # Each turn as text, the length before it, and the place of its body.
    turns = chats.withColumn("ts", F.transform("ms", lambda m: F.concat(F.lit(TURN), escape(m["role"]), F.lit(BODY), m["body"], F.lit(END))))
    places = turns.withColumn(
        "starts",
        F.aggregate(
            F.transform("ts", F.length),
            F.struct(F.lit(0).alias("at"), F.array().cast("array<int>").alias("all")),
            lambda a, n: F.struct((a["at"] + n).alias("at"), F.concat(a["all"], F.array(a["at"])).alias("all")),
            lambda a: a["all"],
        ),
    )
    spans = places.withColumn(
        "loss_spans",
        F.filter(
            F.transform(
                F.arrays_zip("ms", "starts"),
                lambda z: F.when(
                    z["ms"]["role"] == "assistant",
                    F.struct((z["starts"] + len(TURN) + F.length(escape(z["ms"]["role"])) + len(BODY)).alias("start"), F.length(z["ms"]["body"]).alias("length")),
                ),
            ),
            lambda s: s.isNotNull(),
        ),
    )
    files = spans.withColumn("fs", F.flatten(F.transform("ms", lambda m: m["files"])))
    return files.select(
        "conv_id",
        F.size("ms").cast("long").alias("n_turns"),
        F.array_join("ts", "").alias("formatted"),
        "loss_spans",
        F.transform("fs", lambda f, i: F.struct(i.alias("ordinal"), f["type"].alias("type"), f["ref"].alias("ref"), f["tokens"].alias("tokens"))).alias("attachments"),
        F.aggregate("fs", F.lit(0).cast("long"), lambda a, f: a + f["tokens"]).alias("attachment_tokens"),
    )


def parse_chats(formatted: DataFrame) -> DataFrame:
    """Read format_chats()'s output back: adds turns array<struct<role,text>>, texts unescaped."""
    pieces = F.slice(F.split("formatted", r"<\|turn\|>"), 2, 1 << 30)
    return formatted.withColumn(
        "turns",
        F.transform(
            pieces,
            lambda p: F.struct(
                unescape(F.substring_index(p, BODY, 1)).alias("role"),
                unescape(F.substring_index(F.substring_index(p, BODY, -1), END, 1)).alias("text"),
            ),
        ),
    )


def loss_text(formatted: Column, spans: Column) -> Column:
    """All text under the loss mask, unescaped, in order, nothing between."""
    return F.array_join(F.transform(spans, lambda s: unescape(F.substring(formatted, s["start"] + 1, s["length"]))), "")
