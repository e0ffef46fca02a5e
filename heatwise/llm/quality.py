"""Quality by weak supervision, DataFrame functions only.

Rules vote good (1) or bad (0) on a text or abstain (-1).  Expectation-maximisation over the
counts of vote patterns (one grouped count over all texts; at most 3 ** len(RULES) patterns,
whatever the corpus size) estimates how often each rule is right on good and on bad texts,
with Beta priors.  The posterior probability of a
good text then replaces an all-rules-must-pass filter.  Abstaining carries no evidence.

Words are runs of characters other than blank and U+0009..U+000D.  Defined cases: a null
text counts as empty (no words, base_failed); repeated rows are judged alike; an empty
table gives no rows; existing columns of the names added here are replaced.
"""
from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, functions as F

from heatwise.llm.scratch import Scratch

BLANK = r"[\x20\x09-\x0D]+"
#: A word of letters with at most one mark behind it.
PLAIN = r"(?<![^\x20\x09-\x0D])\p{L}+[.,;:!?]?(?![^\x20\x09-\x0D])"
SYMBOLS = "#*$%&|<>"
#: Rule: (votes good, votes bad); it abstains between.
RULES: dict[str, tuple[str, str]] = {
    "length": ("n_words >= 40", "n_words < 15"),
    "word_length": ("word_chars between 3 * n_words and 9 * n_words",
                    "word_chars < 2 * n_words or word_chars > 14 * n_words"),
    "symbols": ("100 * n_symbols <= 2 * n_words", "100 * n_symbols > 20 * n_words"),
    "plain_words": ("100 * n_plain >= 85 * n_words", "100 * n_plain < 75 * n_words"),
    "punctuation": ("100 * n_punct <= 6 * word_chars", "n_words >= 30 and 100 * n_punct > 9 * word_chars"),
    "dup_lines": ("n_dup_lines = 0", "100 * n_dup_lines > 30 * n_lines"),
    "repeats": ("100 * n_repeat_words <= 5 * n_words", "100 * n_repeat_words > 15 * n_words"),
    "capitals": ("100 * n_capitals <= 10 * word_chars", "100 * n_capitals > 40 * word_chars"),
    "shouting": ("100 * n_marks <= 5 * n_words", "100 * n_marks > 30 * n_words"),
    "sentences": ("100 * n_stops between 2 * n_words and 40 * n_words", "n_stops = 0 and n_words >= 30"),
}
ITERATIONS = 200
#: Where EM starts, also the means of its Beta priors: good texts seldom trip a rule, and a
#: bad text trips only the rules for its kind of fault.
START = {"good": 0.8, "right_good": 0.99, "right_bad": 0.3}
PRIOR_SHARE = 0.01       # weight of each prior, as a share of the texts


def _count(text: Column, characters: str) -> Column:
    bare = text
    for c in characters:
        bare = F.replace(bare, F.lit(c), F.lit(""))
    return (F.length(text) - F.length(bare)).cast("long")


def with_measures(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """Add the word, symbol, line and repetition counts."""
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    one = docs.withColumn("__text", text)
    two = one.withColumns({
        "__words": F.transform(F.filter(F.split("__text", BLANK), lambda w: w != ""), lambda w: F.xxhash64(w)),
        "__lines": F.filter(F.split("__text", "\n"), lambda s: s.rlike(r"[^\x20\x09-\x0D]")),
        "word_chars": F.length(F.translate("__text", " \t\n\x0b\x0c\r", "")).cast("long"),
        "n_symbols": _count(F.col("__text"), SYMBOLS),
        "n_capitals": F.regexp_count("__text", F.lit(r"\p{Lu}")).cast("long"),
        "n_plain": F.regexp_count("__text", F.lit(PLAIN)).cast("long"),
        "n_punct": F.regexp_count("__text", F.lit(r"[^\p{L}\p{N}\x20\x09-\x0D]")).cast("long"),
        "n_marks": _count(F.col("__text"), "!"),
        "n_stops": _count(F.col("__text"), ".?!"),
    })
    w = F.col("__words")
    windows = F.when(F.size(w) >= 5, F.transform(
        F.sequence(F.lit(1), F.greatest(F.size(w) - 4, F.lit(1))),
        lambda i: F.xxhash64(*[F.element_at(w, i + k) for k in range(5)]))).otherwise(F.array().cast("array<bigint>"))
    three = two.withColumns({
        "n_words": F.size(w).cast("long"),
        "n_lines": F.size("__lines").cast("long"),
        "n_dup_lines": (F.size("__lines") - F.size(F.array_distinct("__lines"))).cast("long"),
        "__windows": windows,
    })
    win = F.col("__windows")
    repeated = F.size(F.array_distinct(win)) < F.size(win)
    four = three.withColumn("__sorted", F.when(repeated, F.sort_array(
        F.transform(win, lambda v, i: F.struct(v.alias("v"), i.alias("i"))))))
    s = F.col("__sorted")
    at = F.sort_array(F.transform(F.filter(
        F.transform(s, lambda x, i: F.struct(
            x["i"].alias("i"),
            (F.get(s, i - 1)["v"].eqNullSafe(x["v"]) | F.get(s, i + 1)["v"].eqNullSafe(x["v"])).alias("hit"))),
        lambda x: x["hit"]), lambda x: x["i"]))
    five = four.withColumn("__at", F.when(s.isNotNull(), at))
    a = F.col("__at")
    covered = F.aggregate(F.transform(a, lambda p, i: F.least(F.lit(5), F.coalesce(F.get(a, i + 1) - p, F.lit(5)))),
                          F.lit(0), lambda total, x: total + x)
    return (five.withColumn("n_repeat_words", F.coalesce(covered, F.lit(0)).cast("long"))
            .withColumn("base_failed", (F.col("n_words") < 10)
                        | (100 * F.col("n_repeat_words") > 20 * F.col("n_words")))
            .drop("__text", "__words", "__lines", "__windows", "__sorted", "__at"))


def votes() -> dict[str, Column]:
    return {name: F.when(F.expr(bad), 0).when(F.expr(good), 1).otherwise(-1) for name, (good, bad) in RULES.items()}


def fit(measured: DataFrame) -> dict:
    """{"good": share, "right_good": {...}, "right_bad": {...}} by EM over pattern counts."""
    names = list(RULES)
    rows = (measured.select(*[v.alias(n) for n, v in votes().items()]).groupBy(*names).count().collect())
    patterns = sorted((tuple(r[n] for n in names), r["count"]) for r in rows)
    size = max(sum(count for _, count in patterns), 1)
    model = {"good": START["good"], "right_good": dict.fromkeys(names, START["right_good"]),
             "right_bad": dict.fromkeys(names, START["right_bad"])}
    held = PRIOR_SHARE * size
    for _ in range(ITERATIONS):
        good = 0.0
        sums = {n: [0.0, 0.0, 0.0, 0.0] for n in names}     # right and all on good; right and all on bad
        for pattern, count in patterns:
            p = 1 / (1 + math.exp(-_log_odds(model, dict(zip(names, pattern)))))
            good += count * p
            for n, v in zip(names, pattern):
                if v >= 0:
                    s = sums[n]
                    s[0] += count * p * v
                    s[1] += count * p
                    s[2] += count * (1 - p) * (1 - v)
                    s[3] += count * (1 - p)
        new = {"good": (good + held * START["good"]) / (size + held),
               "right_good": {n: (s[0] + held * START["right_good"]) / (s[1] + held) for n, s in sums.items()},
               "right_bad": {n: (s[2] + held * START["right_bad"]) / (s[3] + held) for n, s in sums.items()}}
        change = max(abs(new[k][n] - model[k][n]) for k in ("right_good", "right_bad") for n in names)
        model = new
        if change < 1e-9:
            break
    return model


def _weights(model: dict, name: str) -> tuple[float, float]:
    """Log odds of good for a good and for a bad vote; a vote never speaks against itself."""
    g = min(max(model["right_good"][name], 1e-6), 1 - 1e-6)
    b = min(max(model["right_bad"][name], 1e-6), 1 - 1e-6)
    return max(math.log(g / (1 - b)), 0.0), min(math.log((1 - g) / b), 0.0)


def _log_odds(model: dict, vote: dict[str, int]) -> float:
    out = math.log(model["good"] / (1 - model["good"]))
    for name, v in vote.items():
        if v >= 0:
            out += _weights(model, name)[1 - v]
    return max(min(out, 500.0), -500.0)


def with_verdict(measured: DataFrame, model: dict) -> DataFrame:
    """Add quality (posterior probability of a good text) and kept."""
    odds = F.lit(math.log(model["good"] / (1 - model["good"])))
    for name, vote in votes().items():
        good, bad = _weights(model, name)
        odds = odds + F.when(vote == 1, good).when(vote == 0, bad).otherwise(0.0)
    quality = 1 / (1 + F.exp(-odds))
    return (measured.withColumn("quality", quality)
            .withColumn("kept", ~F.col("base_failed") & (F.col("quality") >= 0.5)))


def keep_good(docs: DataFrame, scratch: Scratch, text_col: str = "text") -> DataFrame:
    """The rows of docs that are kept, with just their columns.

    The measures are written beside the rows once: the model needs all of them before any
    verdict, and a filter must not be merged into the expressions that they come from.
    """
    rows = docs.select(F.struct(*docs.columns).alias("__row"), F.col(text_col).alias("__judged"))
    measured = scratch.keep(with_measures(rows, "__judged").drop("__judged"), "measured", "snappy")
    return with_verdict(measured, fit(measured)).where("kept").select("__row.*")
