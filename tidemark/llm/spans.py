"""Places of regular-expression matches, with built-in functions only."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Elements summed one by one before a block's total is carried on.
_BLOCK = 512

MATCH = "struct<start:int,end:int,m:string,before:string>"


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value), with value computed once."""
    return F.transform(F.array(value), use)[0]


def empty(kind: str) -> Column:
    return F.array().cast(f"array<{kind}>")


def running(lens: Column) -> Column:
    """Exclusive running sums of an int array, in blocks so that the cost stays near linear."""

    def block(b: Column) -> Column:
        return F.aggregate(
            F.slice(lens, b * _BLOCK + 1, _BLOCK),
            F.struct(F.lit(0).alias("at"), empty("int").alias("all")),
            lambda a, n: F.struct((a["at"] + n).alias("at"), F.concat(a["all"], F.array(a["at"])).alias("all")),
        )

    blocks = F.transform(F.sequence(F.lit(0), F.floor((F.size(lens) - 1) / _BLOCK).cast("int")), block)
    joined = F.aggregate(
        blocks,
        F.struct(F.lit(0).alias("at"), empty("array<int>").alias("all")),
        lambda a, b: F.struct((a["at"] + b["at"]).alias("at"), F.concat(a["all"], F.array(F.transform(b["all"], lambda x: x + a["at"]))).alias("all")),
        lambda a: F.flatten(a["all"]),
    )
    return F.when(F.size(lens) > 0, joined).otherwise(empty("int"))


def matches(text: Column, pattern: str, context: int = 0) -> Column:
    """array<MATCH> of the leftmost, non-overlapping matches; places in code points, end exclusive.

    before: up to so many characters (context) between the match before and this one.
    """
    rx = F.lit(pattern)

    def place(ms: Column) -> Column:
        def with_gaps(gaps: Column) -> Column:
            lens = F.zip_with(ms, F.slice(gaps, 1, F.size(ms)), lambda m, g: F.length(m) + F.length(g))
            return let(
                running(lens),
                lambda at: F.transform(
                    ms,
                    lambda m, i: let(
                        at[i] + F.length(gaps[i]),
                        lambda s: F.struct(s.alias("start"), (s + F.length(m)).alias("end"), m.alias("m"), (F.right(gaps[i], F.lit(context)) if context else F.lit("")).alias("before")),
                    ),
                ),
            )

        return F.when(F.size(ms) > 0, let(F.split(text, pattern, -1), with_gaps)).otherwise(empty(MATCH))

    return let(F.regexp_extract_all(text, rx, F.lit(0)), place)


def joined(spans: Column, kinds: list[str]) -> Column:
    """kind:start:end, by start, then kind as listed, comma-joined; spans has kind, start, end."""
    rank = F.create_map(*[x for k, name in enumerate(kinds) for x in (F.lit(name), F.lit(k))])
    keyed = F.transform(spans, lambda s: F.struct(s["start"].alias("start"), rank[s["kind"]].alias("rank"), s["end"].alias("end"), s["kind"].alias("kind")))
    return F.array_join(F.transform(F.array_sort(keyed), lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def overlaps(a: Column, spans: Column) -> Column:
    return F.exists(spans, lambda s: (s["start"] < a["end"]) & (a["start"] < s["end"]))
