"""Toxicity by two class-conditional Kneser-Ney models."""

from __future__ import annotations

import math
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import ascii_lower, claim, py_lower, py_words, ship, table, words

#: Length-normalised log-likelihood ratios: of the whole text, of its strongest word, pair of neighbours, and three words.
FEATURES = ("text", "word", "pair", "three")
FOLDS = 4
_MARKS = ".,;:!?\"'()"


class KneserNey:
    """Interpolated Kneser-Ney over the characters of words, for two classes that share their backoff.

    Orders above `shared` have counts per class; those up to it are continuation
    counts of both classes together, each n-gram once, so that what one class has
    hardly seen is smoothed alike in both and says nothing by itself.

    Compiled: `ratios` has the log-likelihood ratio of each n-gram that a class has
    seen, `backoff` that of the weights with which a seen history passes on to the
    shorter n-gram. A ratio of any other n-gram is that of its longest seen end and
    the backoffs on the way, so nothing else needs to be kept.
    """

    def __init__(self, counted: dict[str, tuple[float, float]] | Iterator[tuple[str, tuple[float, float]]], order: int = 6, shared: int = 2, discount: float = 0.75):
        self.order, self.shared, self.discount = order, shared, discount
        raw: list[dict[int, dict[str, float]]] = [{k: defaultdict(float) for k in range(1, order + 1)} for _ in (0, 1)]
        for word, both in counted.items() if isinstance(counted, dict) else counted:
            w = f"\x02{word}\x03"
            grams = [w[max(0, i - order + 1) : i + 1] for i in range(1, len(w))]
            for c in (0, 1):
                if both[c]:
                    for g in grams:
                        raw[c][len(g)][g] += both[c]
        #: by class or pooled: count of each n-gram, and of each history its total and its number of followers
        self.count: list[dict[str, float]] = [{}, {}]
        self.pooled: dict[str, float] = {}
        above: list[dict[str, float]] = [{}, {}]
        for k in range(order, 0, -1):
            # an n-gram from a word's start is counted as it is; others by what stands before them
            level = [raw[c].pop(k) for c in (0, 1)]
            if k > shared:
                for c in (0, 1):
                    for g in above[c]:
                        level[c][g[1:]] += 1.0
                    self.count[c].update(level[c])
            else:
                for g, n in level[1].items():
                    level[0][g] += n
                for g in above[0].keys() | above[1].keys():
                    level[0][g[1:]] += 1.0
                self.pooled.update(level[0])
                level[1] = {}
            above = level
        self.history = [self._histories(self.count[c]) for c in (0, 1)]
        self.pooled_history = self._histories(self.pooled)
        self.letters = max(2, sum(len(g) == 1 for g in self.pooled) + 1)

    @staticmethod
    def _histories(counts: dict[str, float]) -> dict[str, tuple[float, int]]:
        out: dict[str, tuple[float, int]] = {}
        for g, n in counts.items():
            t, k = out.get(g[:-1], (0.0, 0))
            out[g[:-1]] = (t + n, k + 1)
        return out

    def prob(self, g: str, c: int, low: float | None = None) -> float:
        """Probability of the last character of `g` after the others in class c; `low` is that of the shorter n-gram, if known."""
        if low is None:
            low = self.prob(g[1:], c) if len(g) > 1 else 1.0 / self.letters
        pooled = len(g) <= self.shared
        seen = (self.pooled_history if pooled else self.history[c]).get(g[:-1])
        if not seen:
            return low
        n = (self.pooled if pooled else self.count[c]).get(g, 0.0)
        return (max(n - self.discount, 0.0) + self.discount * seen[1] * low) / seen[0]

    def compiled(self) -> Ratios:
        """What scoring needs; shorter n-grams first, so that each probability takes one step."""
        known: dict[str, tuple[float, float]] = {}
        ratios: dict[str, float] = {}
        for g in sorted(self.count[0].keys() | self.count[1].keys(), key=len):
            low = known.get(g[1:]) or (self.prob(g[1:], 0), self.prob(g[1:], 1))
            both = known[g] = (self.prob(g, 0, low[0]), self.prob(g, 1, low[1]))
            ratios[g] = math.log(both[1]) - math.log(both[0])
        del known
        backoff: dict[str, float] = {}
        for h in self.history[0].keys() | self.history[1].keys():
            t = [self.discount * s[1] / s[0] if (s := self.history[c].get(h)) else 1.0 for c in (0, 1)]
            backoff[h] = math.log(t[1]) - math.log(t[0])
        return Ratios(self.order, self.shared, ratios, backoff)


class Ratios:
    """log P(word | toxic) - log P(word | ordinary), from the compiled models."""

    def __init__(self, order: int, shared: int, ratios: dict[str, float], backoff: dict[str, float], most: int = 150_000):
        self.order, self.shared, self.ratios, self.backoff, self.most = order, shared, ratios, backoff, most
        self.memo: dict[str, float] = {}

    def gram(self, g: str) -> float:
        total = 0.0
        while len(g) > self.shared:
            x = self.ratios.get(g)
            if x is not None:
                return total + x
            total += self.backoff.get(g[:-1], 0.0)
            g = g[1:]
        return total  # pooled orders are alike in both classes

    def word(self, word: str) -> float:
        w, n = f"\x02{word}\x03", self.order
        return sum([self.gram(w[max(0, i - n + 1) : i + 1]) for i in range(1, len(w))])

    def words(self, w: list[str]) -> np.ndarray:
        """Ratios of words in order; marks around a word don't count. The memo holds `most` words at most."""
        memo = self.memo
        if len(memo) > self.most:
            memo.clear()
        for x in set(w).difference(memo):
            memo[x] = self.word(x.strip(_MARKS))
        return np.fromiter(map(memo.__getitem__, w), float, len(w))

    def features(self, text: str | None) -> list[float]:
        """Mean ratios a word: of the text, and of its strongest word, pair of neighbours, and three words (0 for those it lacks)."""
        w = py_words(py_lower(text or ""))
        if not w:
            return [0.0] * len(FEATURES)
        r = np.concatenate([self.words(w[i : i + 50_000]) for i in range(0, len(w), 50_000)])
        pair = (r[1:] + r[:-1]).max() / 2 if len(r) > 1 else r[0] / 2
        three = np.sort(np.r_[r, 0.0, 0.0] if len(r) < 3 else r[np.argpartition(r, len(r) - 3)[-3:]])[-3:]
        return [r.mean(), r.max(), pair, three.mean()]


def _regress(x: np.ndarray, y: np.ndarray, ridge: float = 0.02) -> np.ndarray:
    """Logistic regression by Newton's method; the constant is the last weight."""
    x = np.c_[x, np.ones(len(x))]
    w, penalty = np.zeros(x.shape[1]), ridge * np.r_[np.ones(x.shape[1] - 1), 1e-6]
    for _ in range(40):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + np.diag(penalty), x.T @ (y - p) - penalty * w)
        w += step
        if np.abs(step).max() < 1e-8:
            break
    return w


def _monotone(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Weights of a regression in which no sign of toxicity counts against it."""
    use = np.ones(x.shape[1], bool)
    while True:
        w = _regress(x[:, use], y)
        if (w[:-1] >= 0).all():
            out = np.zeros(x.shape[1] + 1)
            out[:-1][use], out[-1] = w[:-1], w[-1]
            return out
        use[np.flatnonzero(use)[w[:-1] < 0]] = False


def sample(docs: DataFrame, labels: DataFrame, fit_chars: int) -> DataFrame:
    """(y, fold, t): labelled texts of `docs` (_id, _t) for the fit, chosen by a hash of the id.

    Of each class, texts with about `fit_chars` characters in all, 20 more counted
    for each. So the chosen ids are at most fit_chars / 20 a class, about, and go
    to the documents as a broadcast; only ids and lengths are shuffled.
    """
    h = F.pmod(F.xxhash64(F.lit(3), F.col("_id")), F.lit(1_000_000)) / 1_000_000.0
    n = docs.select("_id", F.coalesce(F.length("_t"), F.lit(0)).alias("_n")).join(labels, F.col("_id") == F.col("_i"))
    n = table(n.where("_y in (0, 1)").select("_i", F.col("_y").alias("y"), h.alias("h"), (F.col("_n") + 20).alias("n")), "toxic-lengths")
    chars = {r.y: r.n for r in n.groupBy("y").agg(F.sum("n").alias("n")).collect()}
    share = F.when(F.col("y") == 1, fit_chars / max(1, chars.get(1) or 1)).otherwise(fit_chars / max(1, chars.get(0) or 1))
    chosen = table(n.where(F.col("h") < share).select("_i", "y").distinct(), "toxic-chosen")
    fold = F.pmod(F.xxhash64(F.lit(4), F.col("_id")), F.lit(FOLDS)).cast("int")
    t = docs.join(F.broadcast(chosen), F.col("_id") == F.col("_i"))
    return table(t.select("y", fold.alias("fold"), F.coalesce("_t", F.lit("")).alias("t")), "toxic-sample")


def iter_spent(d: dict) -> Iterator[tuple]:
    """The items of a dictionary, which is empty afterwards."""
    while d:
        yield d.popitem()


def fit(t: DataFrame) -> tuple[Ratios, np.ndarray, np.ndarray, np.ndarray]:
    """The model and the weights that turn its features into a score, from a sample (y, fold, t).

    Each of `FOLDS` parts of the sample is scored by a model of the others, and a
    logistic regression on these features sets the weights.
    """
    counted = t.select("y", "fold", F.explode(words(ascii_lower(F.col("t")))).alias("w")).groupBy("y", "fold", "w").count().toArrow()
    column = counted["w"].combine_chunks().dictionary_encode()
    names = column.dictionary.to_pylist()
    sums = np.zeros((FOLDS, 2, len(names)), np.float32)  # the driver holds a number for each word, class and part of a bounded sample
    np.add.at(sums, (counted["fold"].to_numpy(), counted["y"].to_numpy(), column.indices.to_numpy()), counted["count"].to_numpy())
    del counted, column

    def model(without: int | None) -> Ratios:
        both = sums.sum(axis=0) - (0 if without is None else sums[without])
        plain: dict[str, list[float]] = {}
        for w, a, b in zip(names, both[0].tolist(), both[1].tolist(), strict=True):
            if a or b:
                n = plain.setdefault(w.strip(_MARKS), [0.0, 0.0])
                n[0], n[1] = n[0] + a, n[1] + b
        return KneserNey(iter_spent(plain)).compiled()

    parts = []
    for k in range(FOLDS):  # one model at a time bounds the driver's memory
        shared = t.sparkSession.sparkContext.broadcast(model(k))

        def features(it: Iterator[pd.DataFrame], shared=shared) -> Iterator[pd.DataFrame]:
            claim("toxicity")
            for df in it:
                yield pd.DataFrame([[float(y), *shared.value.features(x)] for y, x in zip(df.y, df.t, strict=True)], columns=["y", *FEATURES])

        parts.append(t.where(F.col("fold") == k).mapInPandas(features, ", ".join(f"{c} double" for c in ("y", *FEATURES))).toPandas())
        shared.destroy()
    f, whole = pd.concat(parts), model(None)
    x, y = f[list(FEATURES)].to_numpy(float), f["y"].to_numpy(float)
    if not len(x) or y.min() == y.max():
        return whole, np.zeros(len(FEATURES)), np.ones(len(FEATURES)), np.r_[np.zeros(len(FEATURES)), -3.0]
    mean, scale = x.mean(axis=0), np.maximum(x.std(axis=0), 1e-9)
    return whole, mean, scale, _monotone((x - mean) / scale, y)


def toxicity(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", holdout: int | None = 1, threshold: float = 0.7, fit_chars: int = 2_500_000) -> DataFrame:
    """`docs` with what a classifier that learns from `labels` says of each whole text.

    Learns only from rows of `labels` whose crc32(id as text) mod 3 is not
    `holdout` (None: from all). Two Kneser-Ney models over the characters of
    words, one of toxic and one of ordinary texts with shared lower orders, give
    each word a ratio of log-likelihoods. Length-normalised ratios decide: that
    of the whole text, and those of its strongest word, pair of neighbours and
    three words, since a long text may hold few toxic expressions; a logistic
    regression on parts of the sample that the models have not seen calibrates
    them. Only the text is an input.

    Adds held_out (boolean), score (0 to 1) and predicted (1 if score >=
    `threshold`, else 0); columns of `docs` with these names give way to them.
    A null or empty text has neutral features and gets the score of a text
    without signs. Ids labelled more than once count as toxic if one row says so;
    null labels are left out; without labels of both classes every score is low
    (0.05). Repeated rows are scored each; null ids are scored and held out
    never; an empty table gives an empty result.
    """
    ship(docs)
    names = ("held_out", "score", "predicted")
    d = docs.drop(*[c for c in docs.columns if c.lower() in names])
    part = lambda c: F.pmod(F.crc32(F.coalesce(c.cast("string"), F.lit("")).cast("binary")), F.lit(3))
    y = labels.select(F.col(id_col).alias("_i"), F.col(label_col).cast("int").alias("_y")).where("_i is not null and _y is not null")
    if holdout is not None:
        y = y.where(part(F.col("_i")) != holdout)
    y = y.groupBy("_i").agg(F.max("_y").alias("_y"))
    texts = d.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_t"))
    model, mean, scale, weights = fit(sample(texts, y, fit_chars))
    shared = d.sparkSession.sparkContext.broadcast((model, mean, scale, weights))

    @F.pandas_udf("double")
    def score(it: Iterator[pd.Series]) -> Iterator[pd.Series]:
        claim("toxicity")
        model, mean, scale, weights = shared.value
        for texts in it:
            x = np.array([model.features(t) for t in texts]).reshape(-1, len(FEATURES))
            yield pd.Series(1 / (1 + np.exp(-np.clip(((x - mean) / scale) @ weights[:-1] + weights[-1], -30, 30))))

    held = (part(F.col(id_col)) == holdout) & F.col(id_col).isNotNull() if holdout is not None else F.lit(False)
    out = d.withColumn("held_out", held).withColumn("score", score(F.col(text_col)))
    return out.withColumn("predicted", (F.col("score") >= threshold).cast("int"))


__all__ = ["FEATURES", "KneserNey", "Ratios", "fit", "sample", "toxicity"]
