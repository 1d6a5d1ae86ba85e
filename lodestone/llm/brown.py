"""Language-model scores by a Brown class-based bigram model with exchange clustering."""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import claim, forget, py_lower, py_words, release, ship, table

_PART_CHARS = 6_000_000  # of the documents that are encoded together
_PAIRS = 1_000_000  # bigrams that a task holds before it adds them up

def _hash(w: str) -> int:
    h = xxhash.xxh3_64_intdigest(w.encode("utf-8", "surrogatepass"))
    return h - 2**64 if h >= 2**63 else h


def _tail(w: str, tails: int) -> int:
    """The unit that a word outside the most frequent ones belongs to: that of its last two characters."""
    return zlib.crc32(w[-2:].encode("utf-8", "surrogatepass")) % tails


def exchange(joint: np.ndarray, left: np.ndarray, right: np.ndarray, classes: np.ndarray, fixed: int) -> np.ndarray:
    """One sweep of the exchange algorithm: each unit in turn moves to the class that gives the bigrams most likelihood.

    `joint[a, b]` counts class bigrams; `right[u, c]` and `left[u, c]` count how
    often class c follows and precedes unit u. The likelihood of a class bigram
    model is, but for terms that no move changes, the sum of n log n over joint
    less that over the two margins. Unit `fixed` (the end) keeps its class alone.
    """
    joint, classes = joint.astype(float).copy(), classes.copy()
    f = lambda x: np.where(x > 0, x * np.log(np.maximum(x, 1e-300)), 0.0)
    order = np.argsort(-(left.sum(axis=1) + right.sum(axis=1)), kind="stable")
    for u in order:
        r, el, a = right[u].astype(float), left[u].astype(float), classes[u]
        if u == fixed or not (r.sum() + el.sum()):
            continue
        joint[a] -= r
        joint[:, a] -= el
        np.maximum(joint, 0.0, out=joint)
        rows, cols = joint.sum(axis=1), joint.sum(axis=0)
        # adding u to class b adds r to row b and el to column b
        gain = (f(joint + r[None, :]) - f(joint)).sum(axis=1) + (f(joint + el[:, None]) - f(joint)).sum(axis=0)
        gain -= f(rows + r.sum()) - f(rows) + f(cols + el.sum()) - f(cols)
        gain[classes[fixed]] = -np.inf
        b = int(np.argmax(gain))
        if gain[b] <= gain[a] + 1e-9 and a != classes[fixed]:
            b = a
        classes[u] = b
        joint[b] += r
        joint[:, b] += el
    return classes


def _gains(joint: np.ndarray, r: np.ndarray, el: np.ndarray) -> np.ndarray:
    """What the likelihood gains if a new word joins each class; `r` and `el` count the classes after and before it. Classes without words stay so."""
    f = lambda x: np.where(x > 0, x * np.log(np.maximum(x, 1e-300)), 0.0)
    rows, cols, i, k = joint.sum(axis=1), joint.sum(axis=0), np.flatnonzero(r), np.flatnonzero(el)
    gain = (f(joint[:, i] + r[i]) - f(joint[:, i])).sum(axis=1) + (f(joint[k] + el[k, None]) - f(joint[k])).sum(axis=0)
    gain -= f(rows + r.sum()) - f(rows) + f(cols + el.sum()) - f(cols)
    gain[rows + cols == 0] = -np.inf
    gain[0] = -np.inf  # the end is alone
    return gain


def likelihood(joint: np.ndarray) -> float:
    """Log-likelihood of class bigrams, but for what doesn't depend on the classes."""
    f = lambda x: np.where(x > 0, x * np.log(np.maximum(x, 1e-300)), 0.0).sum()
    return f(joint) - f(joint.sum(axis=0)) - f(joint.sum(axis=1))


class _Numbers(dict):
    """Numbers words in the order in which they come."""

    def __missing__(self, w: str) -> int:
        n = self[w] = len(self)
        return n


@dataclass
class _Part:
    """Documents that are encoded together, each word by its number in the part."""

    number: _Numbers = field(default_factory=_Numbers)
    texts: list = field(default_factory=list)
    held: list = field(default_factory=list)
    ids: list = field(default_factory=list)
    chars: int = 0

    def add(self, key: pa.Scalar, text: str, held: bool) -> None:
        w = py_words(py_lower(text))
        self.texts.append(np.fromiter(map(self.number.__getitem__, w), np.uint32, len(w)))
        self.held.append(held)
        self.ids.append(key)
        self.chars += len(text) + 64

    def full(self, most: int) -> bool:
        return self.chars >= most

    def batch(self, part: int, tails: int, schema: pa.Schema) -> pa.RecordBatch:
        w = list(self.number)
        train = [x for x, held in zip(self.texts, self.held, strict=True) if not held]
        n = np.bincount(np.concatenate(train), minlength=len(w)) if train else np.zeros(len(w), np.int64)
        wide = len(w) > 1 << 16
        seq = np.concatenate(self.texts).astype("<u4" if wide else "<u2").tobytes()
        one = lambda x, kind: pa.array([x], pa.list_(kind))
        columns = [
            pa.array([part], pa.int64()), pa.array([self.ids], schema.field("ids").type), one(self.held, pa.bool_()), one([len(x) for x in self.texts], pa.int64()), pa.array([wide]), pa.array([seq], pa.binary()),
            one([_hash(x) for x in w], pa.int64()), one([_tail(x, tails) for x in w], pa.int32()), one(n, pa.int64()),
        ]
        return pa.RecordBatch.from_arrays([c.cast(f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)


def encode(docs: DataFrame, tails: int, part_chars: int = _PART_CHARS) -> DataFrame:
    """One row per part of `docs` (_id, t, held): ids, held, lengths and word numbers of its documents; hash, tail and training count of its words."""
    ship(docs)
    kind = docs.schema["_id"].dataType.simpleString()
    form = f"part long, ids array<{kind}>, held array<boolean>, lens array<long>, wide boolean, seq binary, h array<long>, tail array<int>, n array<long>"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        claim("brown")
        task, count, part, schema = TaskContext.get().partitionId() << 32, 0, _Part(), None
        for b in batches:
            schema = schema or pa.schema([
                ("part", pa.int64()), ("ids", pa.list_(b.column(0).type)), ("held", pa.list_(pa.bool_())), ("lens", pa.list_(pa.int64())), ("wide", pa.bool_()), ("seq", pa.binary()),
                ("h", pa.list_(pa.int64())), ("tail", pa.list_(pa.int32())), ("n", pa.list_(pa.int64())),
            ])
            for key, text, held in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True):
                part.add(key, text, held)
                if part.full(part_chars):
                    yield part.batch(task + count, tails, schema)
                    count, part = count + 1, _Part()
        if part.texts:
            yield part.batch(task + count, tails, schema)

    return docs.select("_id", "t", "held").mapInArrow(run, form)


def _sequence(row, units: np.ndarray, end: int, held: bool | None = None) -> np.ndarray:
    """The units of a part's documents on end, an `end` before, between and after them; only training documents if `held` is False."""
    seq = units[np.frombuffer(row.seq, "<u4" if row.wide else "<u2")]
    lens, use = np.asarray(row.lens, np.int64), np.ones(len(row.lens), bool) if held is None else ~np.asarray(row.held, bool)
    seq, lens = seq[np.repeat(use, lens)], lens[use]
    out = np.full(len(seq) + len(lens) + 1, end, np.int64)
    out[np.arange(len(seq)) + 1 + np.repeat(np.arange(len(lens)), lens)] = seq
    return out if len(lens) else out[:0]


def _summed(codes: list[np.ndarray], counts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Each code once, with its counts added up."""
    code = np.concatenate(codes)
    by = np.argsort(code)
    code = code[by]
    first = np.flatnonzero(np.r_[True, code[1:] != code[:-1]][: len(code)])
    return code[first], np.add.reduceat(np.concatenate(counts)[by], first) if len(first) else code


def _dealt(h: np.ndarray, n_buckets: int, use: np.ndarray) -> list[tuple[int, np.ndarray]]:
    """The places of the words in `use`, by bucket of their hash, always in the same order."""
    own = np.flatnonzero(use)
    bucket = h[own] % n_buckets
    by = np.argsort(bucket, kind="stable")
    own, bucket = own[by], bucket[by]
    cuts = np.flatnonzero(np.r_[True, bucket[1:] != bucket[:-1]]) if len(own) else []
    return [(int(bucket[i]), own[i:j]) for i, j in zip(cuts, [*cuts[1:], len(own)], strict=True)]


@dataclass
class Model:
    """A class bigram model: `step[a, b]`, log10 P(class b | class a); of each class its tokens and its share for unseen words; training tokens and words."""

    step: np.ndarray
    after: np.ndarray
    unseen: np.ndarray
    total: int
    distinct: int
    n_docs: int

    def base(self, n: np.ndarray) -> np.ndarray:
        return np.log10((n + 0.5) / (self.total + 0.5 * (self.distinct + 1)))

    def emit(self, n: np.ndarray, c: np.ndarray) -> np.ndarray:
        """log10 P(word | class) of words with these counts and classes; all unseen words of a class count as one."""
        p = np.where(n > 0, (1 - self.unseen[c]) * n / np.maximum(self.after[c], 1.0), self.unseen[c])
        return np.log10(np.maximum(p, 1e-12))


def estimate(joint: np.ndarray, once: np.ndarray, open_: np.ndarray, total: int, distinct: int, n_docs: int) -> Model:
    """The model of class bigram counts `joint`; `once` counts each class's words seen once, `open_` tells which classes take unseen words.

    Transitions: absolute discounting towards class frequencies. A class without
    tokens and without unseen words has no probability.
    """
    before, after = joint.sum(axis=1), joint.sum(axis=0)
    unseen = np.where(open_, np.where(after > 0, (once + 0.5) / (after + 1.0), 1.0), 0.0)
    prior = np.where((after > 0) | open_, after + 0.1, 0.0)
    prior /= prior.sum()
    lower = np.minimum(joint, 0.75)
    p = np.where(before[:, None] > 0, (joint - lower + lower.sum(axis=1, keepdims=True) * prior) / np.maximum(before[:, None], 1.0), prior)
    with np.errstate(divide="ignore"):
        return Model(np.log10(p), after, unseen, total, distinct, n_docs)


def train(docs: DataFrame, classes: int = 64, frequent: int = 4096, tails: int = 512, rounds: int = 6, rare: int = 5, buckets: int = 64, part_chars: int = _PART_CHARS) -> tuple[DataFrame, DataFrame, Model]:
    """Word classes and model from `docs` (_id, t, held): the table of parts, that of each part's word classes and counts, and the model.

    Exchange clustering by counts of all training texts. The `frequent` most
    frequent words take turns on the driver, by their bigrams with one another,
    until few move; it holds words x classes numbers, whatever the corpus. Then
    every other word seen `rare` times or more joins the class that its neighbours
    among the frequent words make best, on the executors, `buckets` or more groups
    of words side by side. Rarer and unseen words go by their tail: words that
    share one of `tails` of them join a class together. The classes of single words
    stand if the training texts are likelier by them than by tails alone.
    """
    spark = docs.sparkSession
    parts = table(encode(docs, tails, part_chars), "brown-parts", group_rows=1)
    asked = parts.agg(F.coalesce(F.sum(F.size("h")), F.lit(0))).first()[0]
    n_buckets = max(buckets, int(asked) // 300_000)

    def count(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for df in it:
            for row in df.itertuples():
                h, n = np.asarray(row.h, np.int64), np.asarray(row.n, np.int64)
                yield pd.DataFrame([(b, h[at].tobytes(), n[at].tobytes()) for b, at in _dealt(h, n_buckets, n > 0)], columns=["bucket", "h", "n"])

    def tally(df: pd.DataFrame) -> pd.DataFrame:
        """A bucket's most frequent words; in the row without a word, its tokens and words."""
        h, n = _summed([np.frombuffer(b, np.int64) for b in df.h], [np.frombuffer(b, np.int64) for b in df.n])
        best = np.lexsort((h, -n))[:frequent]
        return pd.DataFrame({"h": pd.array([*h[best].tolist(), None], "Int64"), "n": [*n[best].tolist(), int(n.sum())], "words": [*[0] * len(best), len(h)]})

    counted = parts.select("h", "n").mapInPandas(count, "bucket int, h binary, n binary").groupBy("bucket").applyInPandas(tally, "h long, n long, words long")
    counted = table(counted, "brown-words")
    release(spark)
    n_docs = docs.where("not held").count()
    total, distinct = counted.where("h is null").agg(F.coalesce(F.sum("n"), F.lit(0)), F.coalesce(F.sum("words"), F.lit(0))).first()
    total, distinct = total + n_docs, distinct + (n_docs > 0)
    top = counted.where("h is not null").orderBy(F.desc("n"), "h").limit(frequent).collect()
    forget(counted)
    n_top, k = len(top), max(2, classes)
    n_units, end = n_top + tails + 1, n_top + tails
    by = sorted(range(n_top), key=lambda i: top[i].h)
    shared = spark.sparkContext.broadcast((np.array([top[i].h for i in by], np.int64), np.array(by, np.int64)))  # at most `frequent` words

    def units_of(row) -> np.ndarray:
        """The unit of each of a part's words."""
        hs, unit = shared.value
        h = np.asarray(row.h, np.int64)
        at = np.minimum(np.searchsorted(hs, h), max(0, len(hs) - 1))
        known = hs[at] == h if len(hs) else np.zeros(len(h), bool)
        return np.where(known, unit[at] if len(hs) else 0, n_top + np.asarray(row.tail, np.int64))

    def bigrams(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """Counts of bigrams with a frequent word or an end in them, summed over a task's parts as far as memory allows."""
        codes, counts, size = [], [], 0
        for df in it:
            for row in df.itertuples():
                seq = _sequence(row, units_of(row), end, False)
                core = (seq < n_top) | (seq == end)
                code, n = np.unique((seq[:-1] * n_units + seq[1:])[core[:-1] | core[1:]], return_counts=True)
                codes.append(code)
                counts.append(n)
                size += len(code)
                if size > _PAIRS:
                    code, n = _summed(codes, counts)
                    codes, counts, size = [code], [n], len(code)
                    if size > _PAIRS * 2 // 3:
                        yield pd.DataFrame({"c": code, "n": n})
                        codes, counts, size = [], [], 0
        if size:
            code, n = _summed(codes, counts)
            yield pd.DataFrame({"c": code, "n": n})

    inner = parts.select("held", "lens", "wide", "seq", "h", "tail")
    pairs = inner.mapInPandas(bigrams, "c long, n long").groupBy("c").agg(F.sum("n").alias("n"))
    pairs = table(pairs.select(F.expr(f"cast(c div {n_units} as int)").alias("a"), F.expr(f"cast(c % {n_units} as int)").alias("b"), "n"), "brown-bigrams")
    release(spark)
    cls = np.r_[np.arange(n_top) % (k - 1) + 1, np.arange(tails) % (k - 1) + 1, 0]

    core = np.r_[np.ones(n_top, bool), np.zeros(tails, bool), True]

    def profile(by: str, other: str, cls: np.ndarray) -> np.ndarray:
        """Of each unit the classes of its frequent neighbours: units x classes, whatever the size of the corpus."""
        named = spark.createDataFrame([(i, int(c)) for i, c in enumerate(cls) if core[i]], "u int, k int")
        rows = pairs.join(F.broadcast(named), F.col(other) == F.col("u")).groupBy(by, "k").agg(F.sum("n").alias("n")).toPandas()
        out = np.zeros((n_units, k))
        out[rows[by].to_numpy(int), rows["k"].to_numpy(int)] = rows["n"].to_numpy(float)
        return out

    def joint_of(right: np.ndarray, cls: np.ndarray) -> np.ndarray:
        out = np.zeros((k, k))
        np.add.at(out, cls[core], right[core])
        return out

    right = profile("a", "b", cls)
    for _ in range(rounds if total else 0):
        left = profile("b", "a", cls)
        new = exchange(joint_of(right, cls), left * core[:, None], right * core[:, None], cls, end)
        moved = int((new != cls).sum())
        cls = new
        right = profile("a", "b", cls)
        if moved * 200 < n_top:
            break
    joint, left = joint_of(right, cls), profile("b", "a", cls)
    for u in range(n_top, end):
        gain = _gains(joint, right[u], left[u])
        if right[u].sum() + left[u].sum() and np.isfinite(gain.max()):
            cls[u] = int(np.argmax(gain))
    forget(pairs)
    first = spark.sparkContext.broadcast((joint, cls))  # classes x classes, and one class a unit

    # each other word's frequent neighbours by class, gathered in buckets of words
    def neighbours(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        _, cls = first.value
        for df in it:
            for row in df.itertuples():
                units = units_of(row)
                seq = _sequence(row, np.arange(len(units)), len(units), False)
                c, near = np.r_[cls[units], 0][seq], np.r_[units < n_top, True][seq]
                at = np.flatnonzero(np.r_[units >= n_top, False][seq])
                before, after = at[near[at - 1]], at[near[at + 1]]
                code, m = np.unique(np.r_[seq[before] * (2 * k) + c[before - 1], seq[after] * (2 * k) + k + c[after + 1]], return_counts=True)
                h, tail, n = (np.asarray(x, np.int64) for x in (row.h, row.tail, row.n))
                starts = np.searchsorted(code, np.arange(len(units) + 1) * (2 * k))  # codes follow the words
                rows = []
                for b, own in _dealt(h, n_buckets, units >= n_top):
                    lens = starts[own + 1] - starts[own]
                    take = np.repeat(starts[own] - np.r_[0, np.cumsum(lens)[:-1]], lens) + np.arange(lens.sum())
                    rows.append((b, row.part, h[own].tobytes(), tail[own].astype("<i4").tobytes(), n[own].astype("<u4").tobytes(), lens.astype("<u2").tobytes(), (code[take] % (2 * k)).astype("<u2").tobytes(), m[take].astype("<u4").tobytes()))
                yield pd.DataFrame(rows, columns=["bucket", "part", "h", "tail", "n", "lens", "code", "m"])

    def move(df: pd.DataFrame) -> pd.DataFrame:
        """Class and count of each word that a part asked for, in its order; in the row without a part, each class's words seen once, by tails and by the words."""
        joint, cls = first.value
        read = lambda c, kind: [np.frombuffer(b, kind) for b in df[c]]
        asked = read("h", "<i8")
        words, at = np.unique(np.concatenate(asked), return_inverse=True)
        n = np.bincount(at, weights=np.concatenate(read("n", "<u4")), minlength=len(words)).astype(np.int64)
        c0 = np.zeros(len(words), np.int64)
        c0[at] = cls[n_top + np.concatenate(read("tail", "<i4"))]
        owner = np.repeat(at, np.concatenate(read("lens", "<u2")))
        use = n[owner] >= rare
        code, m, owner = np.concatenate(read("code", "<u2"))[use], np.concatenate(read("m", "<u4"))[use], owner[use]
        by = np.argsort(owner, kind="stable")
        code, m, owner = code[by], m[by], owner[by]
        c, cuts = c0.copy(), np.r_[np.flatnonzero(np.r_[True, owner[1:] != owner[:-1]]), len(owner)] if len(owner) else [0]
        for i, j in zip(cuts[:-1], cuts[1:], strict=True):
            mine = np.bincount(code[i:j], weights=m[i:j], minlength=2 * k)
            gain = _gains(joint, mine[k:], mine[:k])
            b = int(np.argmax(gain))
            if gain[b] > gain[c[owner[i]]]:
                c[owner[i]] = b
        out, upto = [(None, 0, np.r_[np.bincount(c0[n == 1], minlength=k), np.bincount(c[n == 1], minlength=k)].astype("<i8").tobytes(), b"")], 0
        for part, bucket, h in zip(df.part, df.bucket, asked, strict=True):
            mine = at[upto : upto + len(h)]
            upto += len(h)
            out.append((part, bucket, c[mine].astype("<u2").tobytes(), n[mine].tobytes()))
        part, bucket, c, n = zip(*out, strict=True)
        return pd.DataFrame({"part": pd.array(part, "Int64"), "bucket": bucket, "c": c, "n": n})

    sent = parts.select("part", "held", "lens", "wide", "seq", "h", "tail", "n").mapInPandas(neighbours, "bucket int, part long, h binary, tail binary, n binary, lens binary, code binary, m binary")
    moves = table(sent.groupBy("bucket").applyInPandas(move, "part long, bucket int, c binary, n binary"), "brown-moves")
    release(spark)

    def assemble(mine: pd.DataFrame, answers: pd.DataFrame) -> pd.DataFrame:
        """A part with classes and counts of all its words."""
        out = []
        for row in mine.itertuples():
            units = units_of(row)
            c0 = first.value[1][units]
            c, n = c0.copy(), np.r_[counts_of_top.value, np.zeros(1, np.int64)][np.minimum(units, n_top)]
            got = {b: (np.frombuffer(x, "<u2"), np.frombuffer(y, "<i8")) for b, x, y in zip(answers.bucket, answers.c, answers.n, strict=True)}
            for b, own in _dealt(np.asarray(row.h, np.int64), n_buckets, units >= n_top):
                c[own], n[own] = got[b]
            out.append((row.part, row.held, row.lens, row.wide, row.seq, c0.astype("<u2").tobytes(), c.astype("<u2").tobytes(), n.astype("<i8").tobytes()))
        return pd.DataFrame(out, columns=["part", "held", "lens", "wide", "seq", "c0", "c", "count_"])

    counts_of_top = spark.sparkContext.broadcast(np.array([r.n for r in top], np.int64))
    asking = parts.select("part", "held", "lens", "wide", "seq", "h", "tail").groupBy("part")
    mapped = asking.cogroup(moves.where("part is not null").groupBy("part")).applyInPandas(assemble, "part long, held array<boolean>, lens array<long>, wide boolean, seq binary, c0 binary, c binary, count_ binary")
    mapped = table(mapped, "brown-mapped", group_rows=1)
    release(spark)

    def joints(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sums = {}
        for df in it:
            for row in df.itertuples():
                for which in ("c0", "c"):
                    seq = _sequence(row, np.frombuffer(getattr(row, which), "<u2").astype(np.int64), 0, False)
                    sums[which] = sums.get(which, 0) + np.bincount(seq[:-1] * k + seq[1:], minlength=k * k)
        for which, n in sums.items():
            yield pd.DataFrame({"which": which, "code": np.arange(k * k), "n": n})

    rows = mapped.drop("count_").mapInPandas(joints, "which string, code int, n long").groupBy("which", "code").agg(F.sum("n").alias("n")).toPandas()
    found = {}
    for which in ("c0", "c"):
        r, j = rows[rows.which == which], np.zeros(k * k)
        j[r.code.to_numpy(int)] = r.n.to_numpy(float)
        found[which] = j.reshape(k, k)
    best = "c" if likelihood(found["c"]) >= likelihood(found["c0"]) else "c0"
    once = np.zeros(2 * k, np.int64)
    for i, r in enumerate(top):
        once[[cls[i], k + cls[i]]] += r.n == 1
    seen = moves.where("part is null").select(F.col("c")).toPandas()  # a row for each bucket of 300,000 words
    once = (once + sum(np.frombuffer(b, "<i8") for b in seen.c)).reshape(2, k)[int(best == "c")]
    open_ = np.zeros(k, bool)
    open_[cls[n_top:end]] = True
    model = estimate(found[best], once, open_, int(total), int(distinct), n_docs)
    forget(moves)
    return parts, mapped.select("part", "held", "lens", "wide", "seq", F.col(best).alias("c"), "count_"), model


def score_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", folds: int = 5, held_out: int = 1, **options) -> DataFrame:
    """log10 probability of every whole text under a class bigram model of the others.

    Learns from the documents whose crc32(id as text) mod `folds` is not
    `held_out`; `options` are those of `train`, which assigns each word a class.
    The model is P(word | before) = P(class | class before) P(word | class):
    transitions by absolute discounting towards class frequencies, emissions by
    relative frequency, with each class's share of words seen once set aside for
    unseen words, which count as one.

    Texts are read once and written as numbers, in parts of about `part_chars`;
    word counts and classes stay on the executors, and each part is joined with
    those of its own words.

    Returns `id_col`, held_out, n_tokens, n_known, train_tokens (long),
    base_score and score (double). A null or empty text is its end token alone;
    repeated rows are scored each; null ids count as an empty id text; an empty
    table gives an empty result; without training texts score equals base_score.
    """
    ident = F.coalesce(F.col(id_col).cast("string"), F.lit(""))
    d = docs.select(F.col(id_col).alias("_id"), F.coalesce(F.col(text_col), F.lit("")).alias("t"), (F.pmod(F.crc32(ident.cast("binary")), F.lit(folds)) == held_out).alias("held"))
    parts, mapped, model = train(d, **options)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def score(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        m = shared.value
        for df in it:
            for row in df.itertuples():
                n, c = np.r_[np.frombuffer(row.count_, "<i8").astype(float), float(m.n_docs)], np.r_[np.frombuffer(row.c, "<u2").astype(np.int64), 0]
                seq = _sequence(row, np.arange(len(n) - 1), len(n) - 1)
                base, known = m.base(n)[seq[1:]], (n > 0)[seq[1:]]
                logs = m.step[c[seq[:-1]], c[seq[1:]]] + m.emit(n, c)[seq[1:]] if m.total else base
                size = np.asarray(row.lens, np.int64) + 1
                starts = np.r_[0, np.cumsum(size)[:-1]]
                add = lambda x, starts=starts: np.add.reduceat(x, starts)
                yield pd.DataFrame({"part": row.part, "at": np.arange(len(size)), "n_tokens": size, "n_known": add(known.astype(np.int64)), "base_score": add(base), "score": add(logs)})

    found = mapped.mapInPandas(score, "part long, at int, n_tokens long, n_known long, base_score double, score double")
    ids = parts.select("part", F.posexplode(F.arrays_zip("ids", "held")).alias("at", "d"))
    found = found.join(ids, ["part", "at"])
    return found.select(F.col("d.ids").alias(id_col), F.col("d.held").alias("held_out"), "n_tokens", "n_known", F.lit(model.total).cast("long").alias("train_tokens"), "base_score", "score")


__all__ = ["Model", "encode", "estimate", "exchange", "likelihood", "score_documents", "train"]
