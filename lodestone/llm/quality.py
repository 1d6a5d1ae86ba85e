"""Quality rules combined by weak supervision."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import GAP, let, table, without_gaps, words

SYMBOLS = "#*$%&|<>"
RULES = ("length", "word_length", "symbols", "lines", "repeats", "shouting")
#: Rates of votes (bad, abstained, good) that EM starts from and is smoothed towards, by class.
START = {1: {-1: 0.002, 0: 0.1, 1: 0.898}, 0: {-1: 0.3, 0: 0.1, 1: 0.6}}
#: A rule accuses no more than this share of the good documents.
FALSE_ALARMS = 0.003


def measures(text: Column) -> list[Column]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, upper and marks of one text."""
    t = F.coalesce(text, F.lit(""))
    w = words(t)
    lines = F.filter(F.split(t, "\n"), lambda x: without_gaps(x) != "")
    return [
        F.size(w).cast("long").alias("n_words"),
        F.length(without_gaps(t)).cast("long").alias("word_chars"),
        (F.length(t) - F.length(F.translate(t, SYMBOLS, ""))).cast("long").alias("n_symbols"),
        let(lines, lambda x: (F.size(x) - F.size(F.array_distinct(x))).cast("long")).alias("n_dup_lines"),
        let(w, repeated_words).alias("n_repeat_words"),
        (F.length(t) - F.length(F.translate(t, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", ""))).cast("long").alias("_upper"),
        (F.length(t) - F.length(F.translate(t, "!?", ""))).cast("long").alias("_marks"),
    ]


def repeated_words(w: Column) -> Column:
    """Words inside 3-word windows that occur twice or more in the array `w`.

    Each window is a struct of its words' 64-bit hash and its position, so that one
    sort brings equal windows together; neighbours of equal hashes count where
    their words are equal.
    """
    n = F.size(w)
    keys = F.sort_array(F.transform(F.sequence(F.lit(0), n - 3), lambda i: F.struct(F.xxhash64(F.get(w, i), F.get(w, i + 1), F.get(w, i + 2)).alias("h"), i.alias("p"))))

    def starts(a: Column) -> Column:
        def same(x: Column, j: Column) -> Column:
            y = F.get(a, j)
            alike = [F.get(w, x["p"] + k) == F.get(w, y["p"] + k) for k in range(3)]
            return F.coalesce((x["h"] == y["h"]) & alike[0] & alike[1] & alike[2], F.lit(False))

        twice = F.filter(a, lambda x, i: same(x, i - 1) | same(x, i + 1))
        return F.sort_array(F.transform(twice, lambda x: x["p"].cast("long")))

    def covered(s: Column) -> Column:
        gaps = F.transform(s, lambda x, i: F.least(F.lit(3).cast("long"), F.coalesce(F.get(s, i + 1) - x, F.lit(3).cast("long"))))
        return F.aggregate(gaps, F.lit(0).cast("long"), lambda acc, x: acc + x)

    return F.when(n >= 4, let(let(keys, starts), covered)).otherwise(F.lit(0).cast("long"))


def _vote(bad: Column, good: Column) -> Column:
    return F.when(bad, -1).when(good, 1).otherwise(0)


def votes() -> dict[str, Column]:
    """Each rule's vote from the measures: 1 good, -1 bad, 0 abstains. Texts without words are left to `length`."""
    n = F.greatest(F.col("n_words"), F.lit(1)).cast("double")
    mean, some = F.col("word_chars") / n, F.col("n_words") > 0
    rate = lambda c: F.col(c) / n
    return {
        "length": _vote(F.lit(False), F.col("n_words") >= 50),
        "word_length": _vote(some & ((mean > 12) | (mean < 2.5)), some & mean.between(3.5, 7.0)),
        "symbols": _vote(rate("n_symbols") > 0.1, some & (rate("n_symbols") < 0.02)),
        "lines": _vote(F.col("n_dup_lines") * 12 > F.col("n_words"), some & (F.col("n_dup_lines") == 0)),
        "repeats": _vote(rate("n_repeat_words") > 0.3, some & (rate("n_repeat_words") < 0.05)),
        "shouting": _vote((some & (F.col("_upper") > 0.3 * F.col("word_chars"))) | (rate("_marks") > 0.5), some & (F.col("_upper") < 0.15 * F.col("word_chars")) & (rate("_marks") < 0.1)),
    }


def fit(patterns: list[tuple[tuple[int, ...], int]], rounds: int = 60, prior: float = 0.85) -> dict:
    """EM for two classes of documents in which each rule votes with rates of its own per class.

    A rule's accuracy differs by what it says: a vote against a document can be
    sure while one for it says little, so each rule has its rates of good,
    and abstaining votes among good and among bad documents. `patterns` are vote
    vectors with their numbers of documents, at most 3 ** (number of rules) of
    them whatever the corpus. The start holds the rules to be mostly right;
    each step smooths the rates by one document, and the share of good documents
    stays in [0.05, 0.95]. Without documents the start values stay.

    `weights` are the log ratios of each rule's rates: what a vote adds to the
    log odds that a document is good. A vote never counts against what it says
    and abstaining counts nothing.
    """
    k, total = len(RULES), sum(n for _, n in patterns)
    rates = {c: [dict(START[c]) for _ in range(k)] for c in (0, 1)}
    good = prior
    for _ in range(rounds if total else 0):
        mass = {c: [dict(START[c]) for _ in range(k)] for c in (0, 1)}
        right = 0.0
        for v, n in patterns:
            odds = math.log(good / (1 - good)) + sum(math.log(rates[1][j][x] / rates[0][j][x]) for j, x in enumerate(v))
            p = 1 / (1 + math.exp(-max(-700.0, min(700.0, odds))))
            right += n * p
            for j, x in enumerate(v):
                mass[1][j][x] += n * p
                mass[0][j][x] += n * (1 - p)
        good = min(0.95, max(0.05, right / total))
        rates = {c: [{x: m / sum(r.values()) for x, m in r.items()} for r in mass[c]] for c in (0, 1)}
        for r in rates[1]:
            r[-1] = min(r[-1], FALSE_ALARMS)
    weights = {}
    for j, rule in enumerate(RULES):
        w = {x: math.log(rates[1][j][x] / rates[0][j][x]) for x in (-1, 1)}
        weights[rule] = {-1: min(0.0, w[-1]), 0: 0.0, 1: max(0.0, w[1])}
    return {"prior": good, "rates": rates, "weights": weights}


def quality(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep_at: float = 0.5, rounds: int = 60) -> DataFrame:
    """Measures, rule votes and the posterior probability that a document is good.

    Rules vote good, bad or abstain; expectation-maximisation on the counts of
    vote vectors over all documents (bounded by 3 ** rules, so the driver holds
    them) estimates how right each rule's votes are and the share of good documents; the
    posterior of a document decides. Returns `id_col`, the measures (longs),
    vote_<rule>, posterior, base_failed and kept (false if base_failed, else
    posterior >= `keep_at`).

    A null or empty text has zero words, so it fails the base rule and is not
    kept. Repeated rows are rows of their own with equal results; an empty table
    gives an empty result; other columns are ignored.
    """
    m = docs.select(F.col(id_col).alias("_id"), *measures(F.col(text_col)))
    m = m.withColumns({f"vote_{k}": c.cast("int") for k, c in votes().items()})
    m = table(m, "quality-measures")
    names = [f"vote_{k}" for k in RULES]
    counted = m.groupBy(*names).count().collect()
    model = fit(sorted((tuple(r[n] for n in names), r["count"]) for r in counted), rounds)
    logit = F.lit(math.log(model["prior"] / (1 - model["prior"])))
    for k in RULES:
        w = model["weights"][k]
        logit = logit + F.when(F.col(f"vote_{k}") < 0, w[-1]).when(F.col(f"vote_{k}") > 0, w[1]).otherwise(0.0)
    failed = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    m = m.withColumns({"posterior": 1 / (1 + F.exp(-logit)), "base_failed": failed})
    m = m.withColumn("kept", ~F.col("base_failed") & (F.col("posterior") >= keep_at))
    return m.withColumnRenamed("_id", id_col).drop("_upper", "_marks")


__all__ = ["GAP", "RULES", "fit", "measures", "quality", "repeated_words", "votes"]
