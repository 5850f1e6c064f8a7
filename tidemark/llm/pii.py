"""Personal data by boosted trees over candidate spans, with built-in functions only.

Generators of high recall propose overlapping spans. Each candidate gets a
vector of small whole numbers: its format and what surrounds it. Its weak label comes
from elsewhere: whether a base pattern passes its check there (checksum, octets,
number of digits), or a word of CUE announces it. Neither is among the
features, so that trees learn which formats and surroundings personal data has, and
not the label. One aggregation counts, for every vector that occurs in the corpus
and either half of the documents (by a hash of the text), the candidates with
and without the label; the number of vectors is bounded by the product of the
features' ranges, whatever the corpus. Trees are boosted on the counts of one half on the
driver; on those of the other the threshold of each kind is calibrated: from the highest
score down, each level must have a labelled share of PRECISION, with one failure
added; many sure candidates do not carry doubtful ones. Both return to the cluster as one SQL expression. Base spans are
always kept; candidates beyond them count if their score does.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.spans import MATCH, empty, joined, let, matches, overlaps
from tidemark.storage import stored

KINDS = ["email", "ip", "card", "phone"]
PRECISION = 0.9
ROUNDS, RATE, DEPTH = 32, 0.4, 3

#: Fixed patterns. Each is the contract's, with possessive repeats where no shorter repeat could match
#: and, for email, a start at the border of a run or where the match before ended.
BASE = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}

#: What the generators propose, and the kind a redaction of it would have (digits: by their number).
GENERATORS = {
    "mail": r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]++\x20?(?:@|\((?i:at)\)|\[(?i:at)\]|\x20(?i:at)\x20)\x20?[A-Za-z0-9-]++(?:\x20?(?:\.|\((?i:dot)\)|\[(?i:dot)\]|\x20(?i:dot)\x20)\x20?[A-Za-z0-9-]++)++",
    "digits": r"[+(]?[0-9](?:[\x20().\-/]{0,2}[0-9]){6,}+",
    "colons": r"(?<![0-9A-Fa-f:])(?:[0-9A-Fa-f]{0,4}:){3,7}[0-9A-Fa-f]{1,4}(?![0-9A-Fa-f:])",
}


def luhn(digits: Column) -> Column:
    """Whether a string of digits passes the checksum."""
    total = F.aggregate(
        F.sequence(F.lit(1), F.length(digits)),
        F.lit(0),
        lambda a, i: a
        + let(
            F.substring(digits, F.length(digits) + 1 - i, F.lit(1)).cast("int"),
            lambda d: F.when(i % 2 == 1, d).when(d > 4, 2 * d - 9).otherwise(2 * d),
        ),
    )
    return total % 10 == 0


def only_digits(m: Column) -> Column:
    return F.regexp_replace(m, "[^0-9]", "")


def _passes(kind: str, m: Column) -> Column:
    if kind == "ip":
        part = "0*(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[0-9]?[0-9])"
        return m.rlike(rf"^{part}(?:\.{part}){{3}}$")
    digits = only_digits(m)
    if kind == "card":
        return F.length(digits).between(14, 19) & F.coalesce(luhn(digits), F.lit(False))
    if kind == "phone":
        return F.length(digits).between(10, 15)
    return F.lit(True)


def _present(kind: str, text: Column) -> Column:
    """A cheap test that a text can hold a match."""
    return F.contains(text, F.lit({"email": "@", "phone": "+"}[kind])) if kind in ("email", "phone") else text.rlike("[0-9]")


def base_spans(text: Column) -> Column:
    """array<struct<kind,start,end>> of the base patterns' matches that pass their checks."""
    found = []
    for kind, pattern in BASE.items():
        kept = F.filter(matches(text, pattern), lambda s: _passes(kind, s["m"]))  # noqa: B023
        named = F.transform(kept, lambda s: F.struct(F.lit(kind).alias("kind"), s["start"], s["end"]))  # noqa: B023
        found.append(F.when(_present(kind, text), named).otherwise(empty("struct<kind:string,start:int,end:int>")))
    return F.concat(*found)


#: Features and their ranges, 0 to the number given.
FEATURES = {"generator": 2, "digits": 5, "groups": 4, "joint": 4, "opening": 2, "lead": 4, "evenness": 2}
#: A word before a candidate that announces personal data.
CUE = r"(?:mail|phone|tel|call|mobile|fax|card|visa|ip|addr|contact|kontakt|telefon)[^a-z]{0,4}$"


def _features(generator: str, s: Column) -> Column:
    m, digits = s["m"], only_digits(s["m"])
    n, groups = F.length(digits), F.size(F.split(m, "[^0-9A-Za-z]+"))
    number = {"mail": 0, "digits": 1, "colons": 2}[generator]
    joint = F.when(m.rlike("@"), 4).when(m.rlike(r"^[^ ]*[.:]"), 3).when(m.rlike("-"), 2).when(m.rlike(" "), 1).otherwise(0)
    before = s["before"]
    # what stands before it: nothing, a letter or digit, a mark, a space after a mark, any other space
    lead = F.when(before == "", 0).when(before.rlike(r"[0-9A-Za-z]$"), 1).when(before.rlike(r"[^\s]$"), 2).when(before.rlike(r"[:;,=#.]\s+$"), 3).otherwise(4)
    sizes = F.transform(F.split(m, "[^0-9A-Za-z]+"), F.length)
    return F.struct(
        F.lit(number).alias("generator"),
        F.when(n < 7, 0).when(n < 10, 1).when(n < 12, 2).when(n < 14, 3).when(n < 20, 4).otherwise(5).alias("digits"),
        F.least(groups - 1, F.lit(4)).alias("groups"),
        joint.alias("joint"),
        F.when(m.startswith("+"), 2).when(m.startswith("("), 1).otherwise(0).alias("opening"),
        lead.alias("lead"),
        F.when(F.array_max(sizes) - F.array_min(sizes) <= 1, 0).when(F.array_max(sizes) <= 4, 1).otherwise(2).alias("evenness"),
    )


def candidates(text: Column, base: Column) -> Column:
    """array<struct<kind,start,end,confirmed,label,f>>: the generators' proposals with their weak labels and features."""
    def proposal(name: str):
        def one(s: Column) -> Column:
            n = F.length(only_digits(s["m"]))
            by_digits = F.when(_passes("ip", s["m"]), "ip").when(n >= 14, "card").otherwise("phone")
            kind = {"mail": F.lit("email"), "colons": F.lit("ip"), "digits": by_digits}[name]
            cued = F.lower(s["before"]).rlike(CUE)
            return let(overlaps(s, base), lambda known: F.struct(kind.alias("kind"), s["start"].alias("start"), s["end"].alias("end"), known.alias("confirmed"), (known | cued).alias("label"), _features(name, s).alias("f")))

        return one

    near = {
        "mail": text.rlike("@|(?i)[(\\[\\x20]at[)\\]\\x20]"),
        "digits": text.rlike("[0-9]"),
        "colons": F.contains(text, F.lit(":")) & text.rlike("[0-9A-Fa-f]:[0-9A-Fa-f:]*:"),
    }
    none = empty(f"struct<kind:string,start:int,end:int,confirmed:boolean,label:boolean,f:struct<{','.join(f'{n}:int' for n in FEATURES)}>>")
    return F.concat(*[F.when(near[name], F.transform(matches(text, pattern, 16), proposal(name))).otherwise(none) for name, pattern in GENERATORS.items()])


Tree = tuple  # (feature, border, left, right) or (value,)


def boost(counts: list[tuple[tuple[int, ...], int, int]], rounds: int = ROUNDS, rate: float = RATE) -> tuple[float, list[Tree]]:
    """Trees of depth DEPTH for the log odds of the label, from counts of (vector, with it, without it)."""
    pos, neg = sum(c[1] for c in counts), sum(c[2] for c in counts)
    start = math.log((pos + 1) / (neg + 1))
    score = [start] * len(counts)
    trees: list[Tree] = []

    def sums(rows: list[int]) -> tuple[float, float]:
        g = h = 0.0
        for r in rows:
            p = 1 / (1 + math.exp(-score[r]))
            n = counts[r][1] + counts[r][2]
            g += counts[r][1] - n * p
            h += n * p * (1 - p)
        return g, h

    def grow(rows: list[int], depth: int) -> Tree:
        g, h = sums(rows)
        best, at = g * g / (h + 1) + 1e-6, None
        for f in range(len(FEATURES)) if depth else ():
            for border in sorted({counts[r][0][f] for r in rows})[:-1]:
                left = [r for r in rows if counts[r][0][f] <= border]
                right = [r for r in rows if counts[r][0][f] > border]
                (g1, h1), (g2, h2) = sums(left), sums(right)
                if (gain := g1 * g1 / (h1 + 1) + g2 * g2 / (h2 + 1)) > best:
                    best, at = gain, (f, border, left, right)
        if at is None:
            return (rate * g / (h + 1),)
        return (at[0], at[1], grow(at[2], depth - 1), grow(at[3], depth - 1))

    for _ in range(rounds):
        tree = grow(list(range(len(counts))), DEPTH) if counts else (0.0,)
        trees.append(tree)
        for r, c in enumerate(counts):
            score[r] += leaf(tree, c[0])
    return start, trees


def leaf(tree: Tree, vector: tuple[int, ...]) -> float:
    while len(tree) > 1:
        tree = tree[2] if vector[tree[0]] <= tree[1] else tree[3]
    return tree[0]


def threshold(counts: list[tuple[tuple[int, ...], int, int]], model: tuple[float, list[Tree]], precision: float = PRECISION) -> float:
    """The lowest score down to which the candidates of every level have the label often enough; none: infinity."""
    start, trees = model
    scored = sorted(((start + sum(leaf(t, v) for t in trees), p, n) for v, p, n in counts), reverse=True)
    best, pos, neg = math.inf, 0, 1  # of the level at hand
    for k, (s, p, n) in enumerate(scored):
        pos, neg = pos + p, neg + n
        if k + 1 == len(scored) or scored[k + 1][0] < s - 1e-9:
            if pos < precision * (pos + neg):
                break
            best, pos, neg = s - 1e-9, 0, 1  # sums in another order round differently
    return best


def score_sql(model: tuple[float, list[Tree]], f: Column) -> Column:
    names = list(FEATURES)

    def sql(t: Tree) -> Column:
        return F.lit(float(t[0])) if len(t) == 1 else F.when(f[names[t[0]]] <= t[1], sql(t[2])).otherwise(sql(t[3]))

    out = F.lit(float(model[0]))
    for t in model[1]:
        out = out + sql(t)
    return out


def find_pii(docs: DataFrame, precision: float = PRECISION) -> DataFrame:
    """One row per row of docs: doc_id, base, spans (array<struct<kind,start,end>>; spans holds base too) and thash (xxhash64 of the text).

    docs needs doc_id and text; other columns are ignored. Null text is empty;
    texts without matches have no spans; repeated rows are repeated; an empty
    table gives no rows. A kind without labelled candidates keeps its base spans only.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    half = F.pmod(F.crc32(text.cast("binary")), F.lit(2)).alias("half")
    found = stored(docs.select("doc_id", F.xxhash64("text").alias("thash"), half, let(base_spans(text), lambda b: F.struct(b.alias("base"), candidates(text, b).alias("more"))).alias("s")).select("doc_id", "thash", "half", "s.base", "s.more"))
    names = list(FEATURES)
    vectors = found.select("half", F.explode("more").alias("c")).groupBy("half", "c.kind", *[F.col(f"c.f.{n}").alias(n) for n in names]).agg(F.count_if("c.label").alias("pos"), F.count_if(~F.col("c.label")).alias("neg"))
    counts = sorted((r["half"], r["kind"], tuple(r[n] for n in names), r["pos"], r["neg"]) for r in vectors.collect())  # at most 8 times the product of the ranges
    model = boost([c[2:] for c in counts if c[0] == 0])
    least = F.create_map(*[x for k in KINDS for x in (F.lit(k), F.lit(threshold([c[2:] for c in counts if c[0] == 1 and c[1] == k], model, precision)))])
    extra = F.filter("more", lambda c: ~c["confirmed"] & (score_sql(model, c["f"]) >= least[c["kind"]]))
    return found.select("doc_id", "base", F.concat("base", F.transform(extra, lambda c: F.struct(c["kind"].alias("kind"), c["start"].alias("start"), c["end"].alias("end")))).alias("spans"), "thash")


def redact(docs: DataFrame, found: DataFrame) -> DataFrame:
    """doc_id and redacted: each found span, merged where they overlap, replaced by its kind in brackets.

    found is find_pii()'s result for docs: rows meet by id and text, so rows that
    share an id and differ in their texts keep apart; null ids pair with null ids. Null text is
    empty, texts without spans stay as they are.
    """
    order = F.array_sort(F.transform("spans", lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), s["kind"].alias("kind"))))

    def step(a: Column, s: Column) -> Column:
        cut = F.substring(a["text"], a["at"] + 1, F.greatest(s["start"] - a["at"], F.lit(0)))
        put = F.when(s["start"] >= a["at"], F.concat(cut, F.lit("["), s["kind"], F.lit("]"))).otherwise("")
        return F.struct(a["text"].alias("text"), F.greatest(a["at"], s["end"]).alias("at"), F.concat(a["done"], put).alias("done"))

    d = docs.select(F.col("doc_id").alias("id"), F.xxhash64("text").alias("hash"), F.coalesce("text", F.lit("")).alias("text"))
    once = found.groupBy("doc_id", "thash").agg(F.first("spans").alias("spans"))
    both = d.join(once, d["id"].eqNullSafe(once["doc_id"]) & (d["hash"] == once["thash"]))
    done = F.aggregate(order, F.struct(F.col("text").alias("text"), F.lit(0).alias("at"), F.lit("").alias("done")), step, lambda a: F.concat(a["done"], F.substring(a["text"], a["at"] + 1, F.length(a["text"]))))
    return both.select(F.col("id").alias("doc_id"), done.alias("redacted"))


__all__ = ["BASE", "KINDS", "MATCH", "find_pii", "joined", "redact"]
