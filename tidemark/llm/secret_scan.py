"""Secrets by a battery of randomness tests, with built-in functions only.

Tokens (runs of credential characters) get an inferred encoding, whose
alphabet gives each character a code. Three tests then say how far the token
departs from a random string of that alphabet: chi-squared uniformity of the
alphabet, runs of the upper and lower half of the codes, and lag-one serial
correlation. Their departures are put into fixed bins and counted over the
whole corpus by encoding and class of length (FINE for each doubling); the number of
counts is bounded. How random strings fall into the bins is known (a fixed
simulation). How text departs (mean and spread of each test) is learnt from the
counts of a class, as the other part of a mixture with random strings, starting
from guessed departures that weigh as much as PRIOR tokens. A token's score is its log ratio
of the two, the tests' ratios multiplied; a class reports the scores at which
the expected share of text among the reported is at most ALPHA.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.spans import empty, let, matches, overlaps
from tidemark.storage import stored

#: The contract's kinds, then the battery's own.
KINDS = ["assign", "access", "hex", "random"]
ALPHA = 0.01
SHORTEST = 20
#: Bins of a departure, in standard deviations of a random string: the least, width and number; the last ones are open.
LEAST, BIN, BINS = -2.0, 0.5, 28
#: Classes of length for each doubling.
FINE = 4
#: Guessed departures of text, where a class has little of it: excess coincidence, share of the runs, correlation.
EXCESS, RUNS, RHO = 0.7, 0.6, 0.5
#: Tokens that the guess weighs, its spread, the least spread, random strings simulated for a class, rounds of fitting.
PRIOR, SPREAD, NARROW, DRAWN, ROUNDS = 5.0, 2.0, 0.7, 4000, 200

CENTRES = LEAST + BIN * (np.arange(BINS) + 0.5)

#: Fixed patterns, the contract's with possessive repeats; short runs of hex digits are left out at once.
BASE = {
    "assign": r"""(?i:password|passwd|secret|token|api_?key)["']?+\x20*+[:=]\x20*+["']?+([A-Za-z0-9+/_.=-]++)""",
    "access": r"AKIA[A-Z0-9]++",
    "hex": r"(?<![0-9a-f])[0-9a-f]{24,}+",
}
TOKEN = rf"(?<![A-Za-z0-9+/_=-])[A-Za-z0-9+/_=-]{{{SHORTEST},}}+"

#: Encodings in order of preference: pattern, characters in order of their codes.
ENCODINGS = [
    ("hex", "^[0-9a-f]+$", "0123456789abcdef"),
    ("HEX", "^[0-9A-F]+$", "0123456789ABCDEF"),
    ("base32", "^[A-Z2-7]+$", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"),
    ("lower", "^[a-z0-9]+$", "abcdefghijklmnopqrstuvwxyz0123456789"),
    ("base62", "^[A-Za-z0-9]+$", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789"),
    ("base64", "", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/-_"),
]


def base_spans(text: Column) -> Column:
    """array<struct<kind,start,end>> of the base patterns' matches of sufficient length."""
    long_enough = {
        "assign": lambda s: F.length(F.regexp_extract(s["m"], BASE["assign"], 1)) >= 6,
        "access": lambda s: F.length(s["m"]) >= 20,
        "hex": lambda s: F.length(s["m"]) >= 24,
    }
    near = {"assign": text.rlike("[:=]"), "access": F.contains(text, F.lit("AKIA")), "hex": F.lit(True)}
    found = []
    for kind, pattern in BASE.items():
        kept = F.filter(matches(text, pattern), long_enough[kind])
        named = F.transform(kept, lambda s: F.struct(F.lit(kind).alias("kind"), s["start"].alias("start"), s["end"].alias("end")))  # noqa: B023
        found.append(F.when(near[kind], named).otherwise(empty("struct<kind:string,start:int,end:int>")))
    return F.concat(*found)


def encoding(token: Column) -> Column:
    """The number of the token's encoding."""
    which = F.lit(len(ENCODINGS) - 1)
    for k, (_, pattern, _) in reversed(list(enumerate(ENCODINGS[:-1]))):
        which = F.when(token.rlike(pattern), k).otherwise(which)
    return which


def departures(token: Column, which: Column) -> Column:
    """array<double>: departures of the three tests, in standard deviations of a random string."""
    alphabets = F.array(*[F.lit(a) for _, _, a in ENCODINGS])

    def tests(alphabet: Column, codes: Column) -> Column:
        size, n = F.length(alphabet).cast("double"), F.size(codes).cast("double")
        squares = F.aggregate(F.array_distinct(codes), F.lit(0.0), lambda a, c: a + let(F.size(F.filter(codes, lambda x: x == c)).cast("double"), lambda k: k * k))
        # chi-squared by its pairs of equal characters; roots of such counts have an even spread
        z_chi = 2 * (F.sqrt((squares - n) / 2) - F.sqrt(n * (n - 1) / 2 / size))
        walk = F.aggregate(
            codes,
            F.struct(F.lit(-1.0).alias("was"), *[F.lit(0.0).alias(x) for x in ("high", "changes", "s", "ss", "lag")]),
            lambda a, c: F.struct(
                c.alias("was"),
                (a["high"] + F.when(c * 2 > size, 1.0).otherwise(0.0)).alias("high"),
                (a["changes"] + F.when((a["was"] > 0) & ((c * 2 > size) != (a["was"] * 2 > size)), 1.0).otherwise(0.0)).alias("changes"),
                (a["s"] + c).alias("s"),
                (a["ss"] + c * c).alias("ss"),
                (a["lag"] + F.when(a["was"] > 0, c * a["was"]).otherwise(0.0)).alias("lag"),
            ),
        )

        def rest(w: Column) -> Column:
            # a random string changes halves at every second place
            z_runs = ((n - 1) / 2 - w["changes"]) / (F.sqrt(n - 1) / 2)
            mean = w["s"] / n
            rho = F.abs((w["lag"] / (n - 1) - mean * mean) / F.greatest(w["ss"] / n - mean * mean, F.lit(1e-9)))
            return F.array(z_chi, z_runs, rho * F.sqrt(n))

        return let(walk, rest)

    return let(alphabets[which], lambda a: let(F.transform(F.split(token, ""), lambda c: F.instr(a, c).cast("double")), lambda codes: tests(a, codes)))


def binned(z: Column) -> Column:
    return F.least(F.greatest(F.floor((z - LEAST) / BIN), F.lit(0)), F.lit(BINS - 1)).cast("int")


def random_shares(size: int, n: int) -> np.ndarray:
    """Shares of the bins (3, BINS) among random strings of n codes, by the formulas of departures()."""
    codes = np.random.default_rng(1).integers(1, size + 1, (min(DRAWN, max(200, (1 << 20) // n)), n)).astype(float)
    counts = np.stack([(codes == c).sum(axis=1) for c in range(1, size + 1)], axis=1).astype(float)
    high = codes * 2 > size
    mean = codes.mean(axis=1)
    spread = np.maximum((codes**2).mean(axis=1) - mean**2, 1e-9)
    rho = np.abs(((codes[:, 1:] * codes[:, :-1]).sum(axis=1) / (n - 1) - mean**2) / spread)
    z = [
        2 * (np.sqrt(((counts**2).sum(axis=1) - n) / 2) - np.sqrt(n * (n - 1) / 2 / size)),
        ((n - 1) / 2 - (high[:, 1:] != high[:, :-1]).sum(axis=1)) / (np.sqrt(n - 1) / 2),
        rho * np.sqrt(n),
    ]
    bins = np.clip(np.floor((np.array(z) - LEAST) / BIN), 0, BINS - 1).astype(int)
    out = np.stack([np.bincount(b, minlength=BINS) for b in bins]) + 0.5
    return out / out.sum(axis=1, keepdims=True)


def text_shares(mean: np.ndarray, spread: np.ndarray) -> np.ndarray:
    """Shares of the bins (3, BINS) among text whose departures have this mean and spread."""
    out = np.exp(-((CENTRES - mean[:, None]) ** 2) / (2 * spread[:, None] ** 2)) + 1e-4
    return out / out.sum(axis=1, keepdims=True)


def fitted(rows: list[tuple[tuple[int, int, int], int]], size: int, n: int, alpha: float = ALPHA) -> tuple[np.ndarray, float]:
    """Scores of the bins (3, BINS) and the least score that is reported, of a class: ((bins of the tests), count)."""
    at, count = np.array([b for b, _ in rows]), np.array([c for _, c in rows], float)
    known = np.log(random_shares(size, n))
    guess = np.minimum([2 * np.sqrt(n * (n - 1) / 2 / size) * (np.sqrt(1 + EXCESS) - 1), (1 - RUNS) * np.sqrt(n), RHO * np.sqrt(n)], CENTRES[-1])
    text, share = text_shares(guess, np.full(3, SPREAD)), 0.5
    each, z = np.arange(3), CENTRES[at]
    for _ in range(ROUNDS):
        ratio = (known - np.log(text))[each, at].sum(axis=1) + np.log(share / (1 - share))
        weight = count / (1 + np.exp(np.clip(ratio, -500, 500)))
        share = (1 + count.sum() - weight.sum()) / (2 + count.sum())
        mean = (weight @ z + PRIOR * guess) / (weight.sum() + PRIOR)
        spread = np.sqrt((weight @ (z - mean) ** 2 + PRIOR * (SPREAD**2 + (guess - mean) ** 2)) / (weight.sum() + PRIOR))
        text = text_shares(mean, np.maximum(spread, NARROW))
    score = known - np.log(text)
    of_rows = score[each, at].sum(axis=1)
    is_text = 1 / (1 + np.exp(np.clip(of_rows + np.log(share / (1 - share)), -500, 500)))
    order = np.argsort(-of_rows, kind="stable")
    right = np.flatnonzero((count * is_text)[order].cumsum() <= alpha * count[order].cumsum())
    return score, float(of_rows[order[right[-1]]]) - 1e-9 if len(right) else float("inf")


def find_secrets(docs: DataFrame, alpha: float = ALPHA) -> DataFrame:
    """One row per row of docs: doc_id, base and spans (array<struct<kind,start,end>>; spans holds base too).

    docs needs doc_id and text; other columns are ignored. Null text is empty;
    texts without matches have no spans; repeated rows are repeated; an empty
    table gives no rows. Tokens that overlap a base span are counted for the
    thresholds and not reported again.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    def token(s: Column, b: Column) -> Column:
        return let(
            encoding(s["m"]),
            lambda e: F.struct(
                s["start"].alias("start"),
                s["end"].alias("end"),
                F.concat_ws(":", e, F.floor(F.log2(s["end"] - s["start"]) * FINE)).alias("class"),
                F.transform(departures(s["m"], e), binned).alias("bins"),
                overlaps(s, b).alias("known"),
            ),
        )

    tokens = lambda b: F.transform(matches(text, TOKEN), lambda s: token(s, b))
    found = stored(docs.select("doc_id", let(base_spans(text), lambda b: F.struct(b.alias("base"), tokens(b).alias("tokens"))).alias("s")).select("doc_id", "s.base", "s.tokens"))
    # at most 6 encodings by 28 * FINE classes of BINS**3
    counts = found.select(F.explode("tokens").alias("t")).groupBy("t.class", "t.bins").agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("t.end") - F.col("t.start")).alias("chars")).collect()
    classes: dict[str, list] = {}
    for r in sorted(counts, key=lambda r: (r["class"], r["bins"])):
        classes.setdefault(r["class"], []).append(r)
    scores = []
    for name, rows in classes.items():
        size = len(ENCODINGS[int(name.split(":")[0])][2])
        typical = round(sum(r["chars"] for r in rows) / sum(r["n"] for r in rows))
        score, least = fitted([(tuple(r["bins"]), r["n"]) for r in rows], size, typical, alpha)
        if np.isfinite(least):
            scores += [F.lit(name), F.array(*[F.lit(float(x)) for x in [*score.ravel(), least]])]
    table = F.create_map(*scores) if scores else F.create_map().cast("map<string,array<double>>")

    def reported(t: Column) -> Column:
        total = lambda v: v[t["bins"][0]] + v[t["bins"][1] + BINS] + v[t["bins"][2] + 2 * BINS]
        return F.coalesce(let(F.try_element_at(table, t["class"]), lambda v: total(v) >= v[3 * BINS]), F.lit(False))

    extra = F.transform(F.filter("tokens", lambda t: ~t["known"] & reported(t)), lambda t: F.struct(F.lit("random").alias("kind"), t["start"].alias("start"), t["end"].alias("end")))
    return found.select("doc_id", "base", F.concat("base", extra).alias("spans"))
