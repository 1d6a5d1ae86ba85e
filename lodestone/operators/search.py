"""Full-text search: tokenizers, indexes, queries, BM25, marks, vocabulary; rank fusion; spatial boxes."""

from __future__ import annotations

import functools
import re
import unicodedata
from dataclasses import dataclass, field, replace

from pyspark.sql import Column as Col
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.arrow import stem, stem_words

_COLUMN = 1 << 32  # a place is the column's number times this, plus the token's position
CATEGORIES = "L* N* Co"


@functools.cache
def _bare(most_marks: int) -> tuple[str, str]:
    """Letters with up to `most_marks` marks, the marks themselves, and the plain letters: what `translate` takes."""
    found = {}
    for c in map(chr, range(0x80, 0x2000)):
        d = unicodedata.normalize("NFD", c)
        if 1 < len(d) <= 1 + most_marks and all(unicodedata.category(x) == "Mn" for x in d[1:]):
            found[c] = d[0]
    marks = "".join(chr(c) for c in range(0x300, 0x370))
    return "".join(found) + marks, "".join(found.values())


@dataclass(frozen=True)
class Tokenizer:
    """How text becomes terms.

    kind unicode61: lower-case runs of characters of `categories`; remove_diacritics
    0 keeps marks, 1 takes single ones from letters, 2 all. ascii: runs of ASCII
    letters and digits and of all other characters beyond ASCII, A-Z lowered.
    trigram: every three characters, lowered unless `case_sensitive`. `tokenchars`
    are added to the characters of terms and `separators` taken from them.
    `porter` stems the terms of the others.
    """

    kind: str = "unicode61"
    remove_diacritics: int = 1
    categories: str = CATEGORIES
    tokenchars: str = ""
    separators: str = ""
    porter: bool = False
    case_sensitive: bool = False

    def _split(self) -> str:
        if self.kind == "ascii":
            inside = "A-Za-z0-9\\x{80}-\\x{10FFFF}"
        else:
            inside = "".join(f"\\p{{{c.rstrip('*')}}}" for c in self.categories.split())
        quoted = lambda x: "".join(f"\\x{{{ord(c):X}}}" for c in x)
        inside += quoted(self.tokenchars)
        return f"[^{inside}]+" if not self.separators else f"(?:[^{inside}]|[{quoted(self.separators)}])+"

    def _plain(self, text: Col) -> Col:
        if self.kind == "trigram":
            t = text if self.case_sensitive else F.lower(text)
            n = F.length(t) - 2
            chars = F.split(t, "")  # once, so that each place is found at once
            made = F.transform(F.array(chars), lambda c: F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.concat(F.get(c, i), F.get(c, i + 1), F.get(c, i + 2))))[0]
            return F.when(n > 0, made).otherwise(F.array().cast("array<string>"))
        if self.kind == "ascii":
            t = F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
        elif self.kind == "unicode61":
            t = F.lower(text)
            if self.remove_diacritics:
                t = F.translate(t, *_bare(1 if self.remove_diacritics == 1 else 9))
        else:
            raise ValueError(f"tokenizer {self.kind!r} isn't known")
        return F.filter(F.split(t, self._split()), lambda w: w != "")

    def __call__(self, text: Col) -> Col:
        """The terms of a text as an array, JVM-side but for stemming."""
        words = self._plain(text)
        return stem_words(words) if self.porter else words

    def terms(self, spark: SparkSession, text: str) -> list[str]:
        """The same for a query's text."""
        words = spark.sql("select 1").select(self._plain(F.lit(text))).first()[0]
        return [stem(w) for w in words] if self.porter else words


def tokens(text: Col, fold_accents=None, trigram: bool = False) -> Col:
    """Terms by plain settings: marks kept unless `fold_accents` takes them."""
    return Tokenizer("trigram" if trigram else "unicode61", remove_diacritics=0)(fold_accents(text) if fold_accents else text)


@dataclass
class Index:
    """An index of `columns`: token arrays by document (doc, w0, w1, ..; for trigrams the texts too, t0, t1, ..) or, once saved, postings too.

    `detail` full keeps positions, column only columns, none neither: phrases, NEAR
    and initial tokens need full, column filters full or column.
    """

    docs: DataFrame
    columns: list[str]
    tokenizer: Tokenizer
    detail: str = "full"
    inverted: DataFrame | None = None

    @property
    def spark(self) -> SparkSession:
        return self.docs.sparkSession

    def postings(self) -> DataFrame:
        """(doc, col, pos, term)."""
        if self.inverted is not None:
            return self.inverted
        once = lambda i: self.docs.select("doc", F.explode(F.array(F.struct(f"w{i}"))).alias("_w"))  # noqa: E731 - see `places`; what explodes is also asked for its size first
        per = [once(i).select("doc", F.lit(c).alias("col"), F.posexplode(f"_w.w{i}").alias("pos", "term")) for i, c in enumerate(self.columns)]
        return functools.reduce(DataFrame.union, per)

    def lengths(self) -> DataFrame:
        """(doc, len): terms of all columns."""
        size = functools.reduce(lambda a, b: a + b, [F.coalesce(F.size(f"w{i}"), F.lit(0)) for i in range(len(self.columns))])
        return self.docs.select("doc", size.cast("long").alias("len"))

    def save(self, path: str) -> Index:
        """Writes token arrays and postings, these in order of terms, so that a query's terms are all that is read of them."""
        self.docs.write.mode("overwrite").parquet(f"{path}/docs")
        Index(self.spark.read.parquet(f"{path}/docs"), self.columns, self.tokenizer).postings().repartitionByRange("term", "doc").sortWithinPartitions("term", "doc").write.mode("overwrite").parquet(f"{path}/postings")
        return load(self.spark, path, self.columns, self.tokenizer, self.detail)

    def places(self, leaves: list[Leaf], together: list[list[Leaf]] | None = None) -> DataFrame:
        """(doc, p0, p1, ..): the sorted places of each leaf's term in each document that has one of them, at least.

        `together` has the leaves of each phrase: a document may lack a leaf's places
        if it lacks another leaf of every phrase with it. A document's terms are made
        once, and so are places: rows of a generator are values, while a column of a
        projection would be put in wherever the condition names it, in its loops too.
        """
        number = {c: i for i, c in enumerate(self.columns)}
        if self.inverted is None:
            columns = range(len(self.columns))

            def there(leaf: Leaf) -> Col:
                has = lambda w: F.exists(w, leaf.fits) if leaf.prefix else F.array_contains(w, leaf.term)
                return functools.reduce(lambda a, b: a | b, [F.coalesce(has(F.col(f"_w.w{i}")), F.lit(False)) for i in columns])

            def of(leaf: Leaf) -> Col:
                per = [_hits(f"_w.w{i}", leaf, i) for i in columns]
                phrases = [x for x in together or [[leaf]] if leaf in x]
                wanted = functools.reduce(lambda a, b: a | b, [functools.reduce(lambda a, b: a & b, map(there, dict.fromkeys(x))) for x in phrases])
                return F.when(wanted, F.flatten(F.array(*per)) if len(per) > 1 else per[0]).otherwise(F.array().cast("array<bigint>"))

            docs = self.docs
            if "t0" in docs.columns and leaves:  # trigrams side by side are a part of the text
                part = lambda x: x[0].term + "".join(y.term[-1] for y in x[1:])
                docs = docs.where(functools.reduce(lambda a, b: a | b, [F.contains(F.col(f"t{i}"), F.lit(part(x))) for x in together or [[x] for x in leaves] if x for i in columns]))
            made = docs.select("doc", F.explode(F.array(F.struct(*[F.col(f"w{i}") for i in columns]))).alias("_w"))
            if not leaves:
                return made.select("doc")
            return made.select("doc", F.explode(F.array(F.struct(*[of(x).alias(f"p{i}") for i, x in enumerate(leaves)]))).alias("_p")).select("doc", "_p.*")
        p = self.inverted.where(functools.reduce(lambda a, b: a | b, [x.fits(F.col("term")) for x in leaves]))
        col = functools.reduce(lambda acc, c: acc.when(F.col("col") == c, number[c]), self.columns, F.when(F.lit(False), 0))
        place = col * F.lit(_COLUMN) + F.col("pos")
        return p.groupBy("doc").agg(*[F.array_sort(F.collect_list(F.when(x.fits(F.col("term")), place))).alias(f"p{i}") for i, x in enumerate(leaves)])


def _hits(name: str, leaf: Leaf, number: int) -> Col:
    w = F.coalesce(F.col(name), F.array().cast("array<string>"))
    return F.filter(F.transform(w, lambda x, k: F.when(leaf.fits(x), F.lit(number * _COLUMN) + k)), lambda x: x.isNotNull())


def index(df: DataFrame, key: str, columns: list[str], tokenize=None, detail: str = "full") -> Index:
    """An index over `columns` of `df`; columns left out stay unindexed. `tokenize` is a `Tokenizer` or a function from Column to an array of terms."""
    tokenize = tokenize or Tokenizer()
    if detail not in ("full", "column", "none"):
        raise ValueError(f"detail {detail!r} isn't known")
    docs = df.select(F.col(key).alias("doc"), *[tokenize(F.col(c)).alias(f"w{i}") for i, c in enumerate(columns)])
    if isinstance(tokenize, Tokenizer) and tokenize.kind == "trigram" and not tokenize.porter:
        docs = df.select(F.col(key).alias("doc"), *[tokenize(F.col(c)).alias(f"w{i}") for i, c in enumerate(columns)], *[(F.col(c) if tokenize.case_sensitive else F.lower(c)).alias(f"t{i}") for i, c in enumerate(columns)])
    return Index(docs, list(columns), tokenize if isinstance(tokenize, Tokenizer) else Custom(tokenize), detail)


@dataclass(frozen=True)
class Custom(Tokenizer):
    """A tokenizer of one's own: a function from Column to an array of terms."""

    make: object = None

    def __init__(self, make):
        object.__setattr__(self, "make", make)

    def __call__(self, text: Col) -> Col:
        return self.make(text)

    def terms(self, spark: SparkSession, text: str) -> list[str]:
        return spark.sql("select 1").select(self.make(F.lit(text))).first()[0]


def load(spark: SparkSession, path: str, columns: list[str], tokenizer: Tokenizer | None = None, detail: str = "full") -> Index:
    """An index that `save` wrote."""
    return Index(spark.read.parquet(f"{path}/docs"), columns, tokenizer or Tokenizer(), detail, spark.read.parquet(f"{path}/postings"))


# --- queries -------------------------------------------------------------

@dataclass(frozen=True)
class Leaf:
    """A term, or with `prefix` the start of terms."""

    term: str
    prefix: bool = False

    def fits(self, c: Col) -> Col:
        return c.startswith(self.term) if self.prefix else c == self.term


@dataclass
class Plan:
    """A query over an index: the leaves it looks up, its condition on their places, and the places of the phrases that rank it."""

    ix: Index
    leaves: list[Leaf] = field(default_factory=list)
    phrases: list[tuple[Col, int]] = field(default_factory=list)
    together: list[list[Leaf]] = field(default_factory=list)
    columns: frozenset[str] | None = None

    def leaf(self, x: Leaf) -> Col:
        """Places of a leaf within the columns in force."""
        if x not in self.leaves:
            self.leaves.append(x)
        p = F.col(f"p{self.leaves.index(x)}")
        if self.columns is None:
            return p
        if self.ix.detail == "none":
            raise ValueError("an index without columns takes no column filter")
        wanted = [i for i, c in enumerate(self.ix.columns) if c in self.columns]
        return F.filter(p, lambda v: F.floor(v / _COLUMN).isin(wanted))

    def phrase(self, leaves: list[Leaf], initial: bool = False) -> Col:
        """Places where the leaves stand side by side; noted for ranking."""
        if (len(leaves) > 1 or initial) and self.ix.detail != "full":
            raise ValueError("an index without positions has no phrases, NEAR or initial tokens")
        if not leaves:
            at = F.array().cast("array<bigint>")
        else:
            parts = [_moved(self.leaf(x), i) for i, x in enumerate(leaves)]
            at = functools.reduce(F.array_intersect, parts)
        if initial:
            at = F.filter(at, lambda v: v % _COLUMN == 0)
        self.phrases.append((at, len(leaves)))
        self.together.append(leaves)
        return at

    def within(self, columns: list[str]) -> Plan:
        unknown = set(columns) - set(self.ix.columns)
        if unknown:
            raise ValueError(f"no such column: {sorted(unknown)}")
        return replace(self, columns=frozenset(columns) if self.columns is None else self.columns & frozenset(columns))


def _moved(p: Col, by: int) -> Col:
    return F.transform(p, lambda v: v - by) if by else p


class Query:
    """What a document must hold."""

    def match(self, plan: Plan) -> Col:
        raise NotImplementedError

    def docs(self, ix: Index) -> DataFrame:
        """(doc) of the documents that match."""
        plan = Plan(ix)
        hit = self.match(plan)
        return ix.places(plan.leaves, plan.together).where(hit).select("doc")


def _leaves(plan: Plan, text: str, prefix: bool = False) -> list[Leaf]:
    words = plan.ix.tokenizer.terms(plan.ix.spark, text)
    return [Leaf(w, prefix and i == len(words) - 1) for i, w in enumerate(words)]


@dataclass
class Phrase(Query):
    """Terms side by side; the text goes through the index's tokenizer."""

    text: str
    column: str | None = None
    prefix: bool = False
    initial: bool = False

    def match(self, plan):
        plan = plan if self.column is None else plan.within([self.column])
        return F.size(plan.phrase(_leaves(plan, self.text, self.prefix), self.initial)) > 0


class Term(Phrase):
    """One term; text of several terms is a phrase."""


class Prefix(Phrase):
    """Terms that start so."""

    def __init__(self, text: str, column: str | None = None):
        super().__init__(text, column, prefix=True)


class InitialToken(Phrase):
    """A term that a column starts with."""

    def __init__(self, text: str, column: str | None = None):
        super().__init__(text, column, initial=True)


@dataclass
class And(Query):
    parts: list[Query]

    def match(self, plan):
        return functools.reduce(lambda a, b: a & b, [p.match(plan) for p in self.parts])


@dataclass
class Or(And):
    def match(self, plan):
        return functools.reduce(lambda a, b: a | b, [p.match(plan) for p in self.parts])


class Not(Query):
    """The first, and none of the others."""

    def __init__(self, yes: Query, *no: Query):
        self.yes, self.no = yes, no

    def match(self, plan):
        return functools.reduce(lambda a, b: a & ~b, [n.match(plan) for n in self.no], self.yes.match(plan))


class Near(Query):
    """Phrases in any order in one column, with at most `distance` tokens (10 if it is 0) between the end of the first and the start of the last."""

    def __init__(self, distance: int, *texts: str):
        self.distance, self.texts = distance or 10, texts

    def match(self, plan):
        leaves = [_leaves(plan, t) for t in self.texts]
        at = [plan.phrase(x) for x in leaves]
        each = functools.reduce(lambda a, b: a & b, [F.size(p) > 0 for p in at])
        return each & _meet(at, [len(x) for x in leaves], self.distance) if len(at) > 1 else each


def _meet(at: list[Col], lengths: list[int], distance: int) -> Col:
    """Whether from a place of one phrase on, all others start within its length and `distance`: one sweep from the last place to the first, which keeps each phrase's next place."""
    n = range(len(at))
    marked = lambda k: F.transform(at[k], lambda v: F.struct((-v).alias("v"), F.lit(k).alias("k")))
    state = lambda ahead, hit: F.struct(*[c.alias(f"n{k}") for k, c in enumerate(ahead)], hit.alias("hit"))

    def step(acc: Col, x: Col) -> Col:
        v = -x["v"]
        ahead = [F.when(x["k"] == k, v).otherwise(acc[f"n{k}"]) for k in n]
        here = F.greatest(*[F.when(c == v, lengths[k]).otherwise(0) for k, c in enumerate(ahead)])  # the longest phrase reaches furthest
        return state(ahead, acc["hit"] | (F.greatest(*ahead) <= v + here + distance))

    none = state([F.lit(1 << 62).cast("long")] * len(at), F.lit(False))
    return F.aggregate(F.array_sort(F.concat(*map(marked, n))), none, step, lambda acc: acc["hit"])


class ColumnSet(Query):
    """A query within some columns."""

    def __init__(self, columns: list[str], query: Query):
        self.columns, self.query = columns, query

    def match(self, plan):
        return self.query.match(plan.within(self.columns))


class InColumn(ColumnSet):
    """A query within one column."""

    def __init__(self, column: str, query: Query):
        super().__init__([column], query)


class Raw(Query):
    """A query in the usual match syntax: words, "phrases", + between parts of one, prefix*, ^first, AND, OR, NOT, parentheses, NEAR(a b, n), column: and {columns}:."""

    _TOKEN = re.compile(r'\s*("(?:[^"]|"")*"|NEAR\s*\(|[(){}:*^,+\-]|[^\s"(){}:*^,+\-]+)')

    def __init__(self, text: str):
        self.words = [m[0].strip() for m in self._TOKEN.finditer(text)]
        if not self.words or self._TOKEN.sub("", text).strip():
            raise ValueError(f"query {text!r} can't be read")
        self.query = self._or()
        if self.words:
            raise ValueError(f"query {text!r} can't be read from {self.words[0]!r} on")

    def match(self, plan):
        return self.query.match(plan)

    def _next(self, *wanted: str) -> str | None:
        return self.words.pop(0) if self.words and self.words[0] in wanted else None

    def _need(self, wanted: str) -> None:
        if not self._next(wanted):
            raise ValueError(f"query: {wanted!r} is missing")

    def _or(self) -> Query:
        parts = [self._and()]
        while self._next("OR"):
            parts.append(self._and())
        return Or(parts) if len(parts) > 1 else parts[0]

    def _and(self) -> Query:
        parts = [self._not()]
        while self._next("AND") or (self.words and self.words[0] not in ("OR", "NOT", ")", "AND")):
            parts.append(self._not())
        return And(parts) if len(parts) > 1 else parts[0]

    def _not(self) -> Query:
        q = self._one()
        while self._next("NOT"):
            q = Not(q, self._one())
        return q

    @staticmethod
    def _text(w: str) -> str:
        return w[1:-1].replace('""', '"') if w.startswith('"') else w

    def _one(self) -> Query:
        if not self.words:
            raise ValueError("query: a term is missing")
        if self._next("{"):
            columns = []
            while not self._next("}"):
                if not self.words:
                    raise ValueError("query: '}' is missing")
                columns.append(self._text(self.words.pop(0)))
            self._need(":")
            return ColumnSet(columns, self._one())
        if self._next("("):
            q = self._or()
            self._need(")")
            return q
        w = self.words.pop(0)
        if re.fullmatch(r"NEAR\s*\(", w):
            texts, distance = [], 10
            while not self._next(")"):
                if self._next(","):
                    distance = int(self.words.pop(0))
                elif self.words:
                    texts.append(self._text(self.words.pop(0)))
                else:
                    raise ValueError("query: ')' is missing")
            return Near(distance, *texts)
        if self._next(":"):
            return ColumnSet([self._text(w)], self._one())
        initial = w == "^"
        text = self._text(self.words.pop(0) if initial and self.words else w)
        while self._next("+"):
            text += " " + self._text(self.words.pop(0))
        return Phrase(text, prefix=bool(self._next("*")), initial=initial)


def bm25(ix: Index, query: Query, weights: dict[str, float] | None = None, k1: float = 1.2, b: float = 0.75) -> DataFrame:
    """(doc, rank) of the matching documents; smaller is better.

    Each phrase of the query, be it a term, a prefix or several terms, ranks by its
    own occurrences and documents: idf = max(1e-6, ln((N - df + 0.5) / (df + 0.5))).
    An occurrence counts as its column's weight (1 if not given).
    """
    plan = Plan(ix)
    hit = query.match(plan)
    weight = [float((weights or {}).get(c, 1.0)) for c in ix.columns]
    if set(weight) == {1.0}:
        tf = lambda p: F.size(p).cast("double")
    else:
        tf = lambda p: F.aggregate(p, F.lit(0.0), lambda acc, v: acc + F.element_at(F.array(*map(F.lit, weight)), F.floor(v / _COLUMN).cast("int") + 1))
    n = range(len(plan.phrases))
    found = ix.places(plan.leaves, plan.together).select("doc", hit.alias("hit"), *[tf(p).alias(f"t{i}") for i, (p, _) in enumerate(plan.phrases)])
    found = found.join(ix.lengths(), "doc")
    size = ix.lengths().agg(F.count("*").alias("n"), F.avg("len").alias("avg"))
    df = found.agg(*[F.sum((F.col(f"t{i}") > 0).cast("long")).alias(f"d{i}") for i in n])
    stats = size.crossJoin(df)  # one row
    part = lambda i: F.greatest(F.lit(1e-6), F.log((F.col("n") - F.col(f"d{i}") + 0.5) / (F.col(f"d{i}") + 0.5))) * F.col(f"t{i}") * (k1 + 1) / (F.col(f"t{i}") + k1 * (1 - b + b * F.col("len") / F.col("avg")))
    return found.where("hit").join(F.broadcast(stats)).select("doc", (-functools.reduce(lambda x, y: x + y, map(part, n), F.lit(0.0))).alias("rank"))


def vocabulary(ix: Index, form: str = "row") -> DataFrame:
    """row: (term, doc, cnt); col: also per column; instance: (term, doc, col, offset)."""
    if form == "instance":
        return ix.postings().select("term", "doc", "col", F.col("pos").cast("long").alias("offset"))
    by = ["term"] if form == "row" else ["term", "col"]
    return ix.postings().groupBy(*by, "doc").agg(F.count("*").alias("_n")).groupBy(*by).agg(F.count("*").alias("doc"), F.sum("_n").alias("cnt"))


def highlight(text: Col, terms: list[str], start: str = "<b>", end: str = "</b>") -> Col:
    """Marks whole-word occurrences of `terms` in any case."""
    p = "(?iu)(?<![\\p{L}\\p{N}])(" + "|".join(re.escape(t) for t in terms) + ")(?![\\p{L}\\p{N}])"
    return F.regexp_replace(text, p, f"{start}$1{end}")


def snippet(text: Col, terms: list[str], size: int = 10, start: str = "<b>", end: str = "</b>", dots: str = "...") -> Col:
    """The window of `size` words with the most marked terms (the first of equals), marked."""
    w = F.split(text, r"\s+")
    hit = F.transform(w, lambda x: F.lower(F.regexp_replace(x, r"[^\p{L}\p{N}]", "")).isin([t.lower() for t in terms]).cast("int"))

    def best(h: Col) -> Col:
        starts = F.sequence(F.lit(0), F.greatest(F.size(h) - size, F.lit(0)))
        score = lambda i: F.aggregate(F.slice(h, i + 1, size), F.lit(0), lambda a, x: a + x)
        return F.array_max(F.transform(starts, lambda i: F.struct(score(i).alias("n"), (-i).alias("i"))))["i"]

    at = -F.transform(F.array(hit), best)[0]
    body = F.array_join(F.slice(w, at + 1, size), " ")
    return F.concat(F.when(at > 0, dots).otherwise(""), highlight(body, terms, start, end), F.when(at + size < F.size(w), dots).otherwise(""))


def rrf(lists: list[DataFrame], weights: list[float] | None = None, k: float = 60, limit: int | None = None) -> DataFrame:
    """Reciprocal-rank fusion of lists (key, rank from 1): score = sum of w / (k + rank); ties by the key's text."""
    weights = [1.0] * len(lists) if weights is None else weights
    if len(weights) != len(lists):
        raise ValueError("rrf: one weight per list")
    k = k if k > 0 else 60
    parts = [d.select("key", (F.lit(float(w)) / (F.lit(float(k)) + F.col("rank"))).alias("s")) for d, w in zip(lists, weights, strict=True)]
    out = functools.reduce(DataFrame.union, parts).groupBy("key").agg(F.sum("s").alias("score")).orderBy(F.desc("score"), F.col("key").cast("string"))
    return out if limit is None else out.limit(limit)


def box_overlaps(df: DataFrame, dims: list[tuple[str, str]], box: list[tuple[float, float]]) -> DataFrame:
    """Rows whose boxes (min and max column per dimension, 1 to 5) meet `box`."""
    if not 1 <= len(dims) <= 5 or len(dims) != len(box):
        raise ValueError("boxes have 1 to 5 dimensions")
    return df.where(functools.reduce(lambda a, b: a & b, [(F.col(hi) >= lo_q) & (F.col(lo) <= hi_q) for (lo, hi), (lo_q, hi_q) in zip(dims, box, strict=True)]))


def box_circle(df: DataFrame, dims: list[tuple[str, str]], centre: list[float], radius: float) -> DataFrame:
    """Rows whose box comes within `radius` of `centre`."""
    gap = [F.lit(c) - F.greatest(F.col(lo), F.least(F.col(hi), F.lit(c))) for (lo, hi), c in zip(dims, centre, strict=True)]
    return df.where(functools.reduce(lambda a, b: a + b, [g * g for g in gap]) <= radius * radius)


def box_custom(df: DataFrame, dims: list[tuple[str, str]], within) -> DataFrame:
    """Rows whose box `within`, a function of the (low, high) Columns of each dimension, accepts."""
    return df.where(within(*[(F.col(lo), F.col(hi)) for lo, hi in dims]))
