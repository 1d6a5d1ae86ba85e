"""Line dedup by content-defined chunks of lines, in DataFrame functions; `linemodel` has the same rules in Python."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import forget, fresh, shuffles_spent, table, word_count
from .linemodel import _WANT, EVERY, GAPS, LAST, LONG, Chunks, Lines, Sides, lines, merged, without

__all__ = ["_WANT", "Chunks", "Lines", "Sides", "dedup_lines", "lines", "merged", "without"]

_MARK, _ESCAPE = "\x01", "\x02"
_GAP = r"[\x20\x09-\x0D]"
_INNER = r"[\x20\x09\x0B-\x0D]"  # a gap without a line feed
_HOT = 50_000  # occurrences of a chunk that are compared in one task


def let(value: Column, body) -> Column:
    """`body(value)` with `value` computed once per row, as `common.let`, but without a copy of what `body` gives."""
    return F.aggregate(F.array(), value, lambda acc, _: acc, body)


def _raw(x: Column) -> Column:
    """What `_escaped` was made from."""
    return F.replace(F.replace(x, F.lit(_ESCAPE + "a"), F.lit(_MARK)), F.lit(_ESCAPE + "b"), F.lit(_ESCAPE))


def _part(xs: Column, a: Column, b: Column, back: bool = False) -> Column:
    """Elements a to b (exclusive, above a) of an array, last first if `back`; unlike `slice`, which turns the whole array into a list, it costs what it returns."""
    places = F.sequence(b - 1, a, F.lit(-1)) if back else F.sequence(a, b - 1, F.lit(1))
    return F.transform(places, lambda i: F.get(xs, i))


def _same(x: Column) -> Column:
    return x


def _escaped(x: Column) -> Column:
    """A text without the mark."""
    return F.replace(F.replace(x, F.lit(_ESCAPE), F.lit(_ESCAPE + "b")), F.lit(_MARK), F.lit(_ESCAPE + "a"))


def _cut_words(xs: Column, gaps: bool) -> Column:
    """`_cut_long` for lines of words with single spaces between: `gaps` tells whether lines end with their gap, else a line feed may stand before one."""

    ends = lambda w: F.xxhash64(w).bitwiseAND(F.lit(EVERY - 1)) == 0

    def marked(x: Column) -> Column:
        """Words with marks after those that end a piece, but for the last."""
        cut, gap = (f" {_MARK}", " ") if gaps else (_MARK, " ")
        whole = F.array_join(F.transform(F.split(x, " "), lambda w: F.concat(w, F.when(ends(w), F.lit(cut)).otherwise(F.lit(gap)))), "")
        return F.rtrim(whole, F.lit(f" {_MARK}")) if gaps else F.rtrim(whole)

    def pieces(x: Column) -> Column:
        if gaps:
            body = marked(F.substring(x, F.lit(1), F.length(x) - 1))
            t = F.when(F.endswith(x, F.lit(" ")), F.concat(body, F.lit(" "))).when(F.endswith(x, F.lit("\n")), F.concat(body, F.lit("\n"))).otherwise(marked(x))
        else:
            t = F.when(F.startswith(x, F.lit("\n")), F.concat(F.lit("\n"), marked(F.substring(x, 2, 2**31 - 1)))).otherwise(marked(x))
        return F.filter(F.split(t, _MARK, -1), lambda y: y != "")

    def short(x: Column) -> Column:
        size = F.octet_length(x)
        beside = F.endswith(x, F.lit(" ")) | F.endswith(x, F.lit("\n")) if gaps else F.startswith(x, F.lit("\n"))
        return (size <= LONG) | (size == LONG + 1) & beside

    return F.flatten(F.transform(xs, lambda x: F.when(short(x), F.array(x)).otherwise(pieces(x))))


def _cut_long(xs: Column, raw, gaps: bool) -> Column:
    """Lines with those of over `LONG` bytes cut after words whose hash says so."""

    def word(w: Column) -> Column:
        bare = F.rtrim(w, F.lit(GAPS))
        ends = F.xxhash64(F.ltrim(raw(bare), F.lit("\n"))).bitwiseAND(F.lit(EVERY - 1)) == 0
        return F.when(ends, F.concat(w if gaps else bare, F.lit(_MARK))).otherwise(w)

    def pieces(x: Column) -> Column:
        marked = F.array_join(F.transform(F.split(x, rf"(?<={_INNER})(?!{_GAP})"), word), "")
        return F.filter(F.split(marked, _MARK, -1), lambda y: y != "")

    def size(x: Column) -> Column:
        return F.octet_length(F.rtrim(raw(x), F.lit(GAPS)) if gaps else F.ltrim(raw(x), F.lit("\n")))

    cut = lambda xs: F.flatten(F.transform(xs, lambda x: F.when(F.octet_length(x) <= LONG, F.array(x)).when(size(x) <= LONG, F.array(x)).otherwise(pieces(x))))
    return let(xs, lambda xs: F.when(F.exists(xs, lambda x: F.octet_length(x) > LONG), cut(xs)).otherwise(xs))


def _unmarked(text: Column, cut) -> Column:
    """`cut(text, raw)`, an array; texts that hold the mark go through it escaped."""
    odd = lambda t: F.transform(let(_escaped(t), lambda e: cut(e, _raw)), _raw)
    return let(text, lambda t: F.when(~F.contains(t, F.lit(_MARK)), cut(t, _same)).otherwise(odd(t)))


def _usual(t: Column) -> Column:
    """Whether all gaps of a text are single spaces and line feeds."""
    return ~F.rlike(t, F.lit(r"[\t-\r ](?:(?<=[\t\x0B-\r])|[ \n])"))


def _replaced(t: Column, pairs) -> Column:
    """A text with these replaced, one after the other."""
    return reduce(lambda x, p: F.replace(x, F.lit(p[0]), F.lit(p[1])), pairs, t)


def plain_lines(text: Column) -> Column:
    """The lines of a text without what separates them; one that starts a paragraph has a line feed before it."""

    def cut(t: Column, raw) -> Column:
        odd = F.split(F.regexp_replace(t, rf"{_GAP}*\n{_GAP}*", _MARK + "\n"), rf"(?<=[{LAST}]){_INNER}+|{_MARK}", -1)
        some = lambda xs: F.filter(xs, lambda x: (x != "") & (x != "\n"))
        odd = _cut_long(some(odd), raw, False)
        if raw is not _same:
            return odd
        usual = F.split(F.replace(t, F.lit("\n"), F.lit(" \n")), rf" (?:(?=\n)|(?<=[{LAST}] ))", -1)
        return F.when(_usual(t), _cut_words(some(usual), False)).otherwise(odd)

    ended = lambda t: F.when(F.endswith(t, F.lit("\n")), t).otherwise(F.concat(t, F.lit("\n")))
    return _unmarked(let(F.ltrim(text, F.lit(GAPS)), ended), cut)


def whole_lines(text: Column) -> Column:
    """The lines of a text with their gaps: joined, they are the text but for blanks at its start."""

    def cut(t: Column, raw) -> Column:
        some = lambda x: F.filter(F.split(x, _MARK, -1), lambda x: x != "")
        odd = _cut_long(some(F.regexp_replace(t, rf"(?:[{LAST}]{_GAP}|\n){_GAP}*", f"$0{_MARK}")), raw, True)
        if raw is not _same:
            return odd
        usual = F.regexp_replace(t, rf"[ \n](?<=[{LAST}] |\n)", f"$0{_MARK}")
        return F.when(_usual(t), _cut_words(some(usual), True)).otherwise(odd)

    return _unmarked(F.ltrim(text, F.lit(GAPS)), cut)


def _parsed(text: Column, body) -> Column:
    """`body(lines, their hashes, chunks)` of a text, each made once; the chunks (s, e, ch) are those of several lines, from line s to e (exclusive).

    A chunk starts where the rolling hash of two lines on end falls, and where a
    paragraph starts, if it is not a line away from the next.
    """
    opens = lambda xs, i: F.startswith(F.get(xs, i), F.lit("\n"))

    def begins(xs: Column, rolled: Column) -> Column:
        begin = lambda i: (i == 0) | (F.get(rolled, i) < F.get(rolled, i - 1)) | (opens(xs, i) & ~F.coalesce(opens(xs, i + 1), F.lit(True)))
        return F.when(F.size(xs) > 0, F.filter(F.sequence(F.lit(0), F.size(xs) - 1), begin)).otherwise(F.expr("cast(array() as array<int>)"))

    def chunks(h: Column, starts: Column) -> Column:
        def code(s: Column, e: Column) -> Column:
            few = [F.xxhash64(*(F.get(h, s + i) for i in range(n))) for n in (2, 3)]  # as of an array of them
            return F.when(e - s == 2, few[0]).when(e - s == 3, few[1]).otherwise(F.xxhash64(_part(h, s, e)))

        def one(s: Column, k: Column) -> Column:
            return let(F.coalesce(F.get(starts, k + 1), F.size(h)), lambda e: F.when(e - s > 1, F.struct(s.alias("s"), e.alias("e"), code(s, e).alias("ch"))))

        return F.filter(F.transform(starts, one), lambda c: c.isNotNull())

    def of(xs: Column) -> Column:
        bare = F.transform(xs, lambda x: F.when(F.startswith(x, F.lit("\n")), F.substring(x, 2, 2**31 - 1)).otherwise(x))
        rolled = lambda h: F.transform(h, lambda x, i: F.xxhash64(F.get(h, i - 1), x))
        with_h = lambda u, h: let(begins_of(xs, h), lambda starts: let(chunks(h, starts), lambda c: body(u, h, c)))
        begins_of = lambda xs, h: let(rolled(h), lambda r: begins(xs, r))
        return let(bare, lambda u: let(F.transform(u, lambda x: F.xxhash64(x)), lambda h: with_h(u, h)))

    return let(plain_lines(text), of)


def _want(k: Column, salts: Column, first: Column) -> Column:
    """A wanted chunk as a number: its place among the chunks of several lines, how many tasks compare it, whether it is the first of its kind."""
    return F.shiftleft(k.cast("long"), 24) + F.shiftleft(salts, 1) + first.cast("long")


def pieces(text: Column, wanted: Column, rid: Column) -> Column:
    """What is compared of a text, as structs (key, k, side, at, lines, x): each of the sorted chunks `wanted`, and at the ends of a run of them the lines beside it.

    Side 0 is the chunk itself, under its hash, from line `at` on. Sides -1 and 1 are
    the lines before it, last first, and after it, away from line `at`, under a
    hash of the chunk and the nearest line, so that only passages that go on alike
    are compared. They reach over the next chunk of several lines, and before the
    chunk one line more: no passage that begins or ends there goes further, as
    boundaries from its third line on are its own. `x` has the lines with line feeds
    between, which none holds. A hot chunk is dealt to several
    keys, its first place to each.
    """

    def of(u: Column, h: Column, c: Column, wanted: Column) -> Column:
        part = lambda a, b, back=False: F.array_join(_part(u, a, b, back), "\n")  # noqa: E731  # no line holds a line feed
        number = lambda v: F.shiftright(v, 24).cast("int")

        def row(k: Column, side: int, key: Column, at: Column, n: Column, x: Column) -> Column:
            return F.struct(key.alias("key"), k.alias("k"), F.lit(side).alias("side"), at.alias("at"), n.alias("lines"), x.alias("x"))

        def beside(v: Column, i: Column) -> Column:
            return let(number(v), lambda k: let(F.get(c, k), lambda me: let(F.get(c, k - 1), lambda back: let(F.get(c, k + 1), lambda ahead: rows(v, i, k, me, back, ahead)))))

        def rows(v: Column, i: Column, k: Column, me: Column, back: Column, ahead: Column) -> Column:
            alone = lambda j, meets: ~F.coalesce((number(F.get(wanted, j)) == k + (j - i)) & meets, F.lit(False))
            low = F.greatest(F.coalesce(back["s"] - 1, F.lit(0)), F.lit(0))
            high = F.coalesce(ahead["e"], F.size(h))
            before = F.when((me["s"] > 0) & alone(i - 1, back["e"] == me["s"]), row(k, -1, F.xxhash64(me["ch"], F.get(h, me["s"] - 1), F.lit(-1).cast("long")), me["s"], me["s"] - low, part(low, me["s"], True)))
            after = F.when((me["e"] < F.size(h)) & alone(i + 1, ahead["s"] == me["e"]), row(k, 1, F.xxhash64(me["ch"], F.get(h, me["e"]), F.lit(1).cast("long")), me["e"], high - me["e"], part(me["e"], high)))
            own = lambda key: row(k, 0, key, me["s"], me["e"] - me["s"], part(me["s"], me["e"]))
            salts = F.shiftright(v, 1).bitwiseAND(F.lit((1 << 23) - 1))
            dealt = F.when(v.bitwiseAND(F.lit(1)) == 1, F.transform(F.sequence(F.lit(0).cast("long"), salts - 1), lambda t: own(F.xxhash64(me["ch"], t)))).otherwise(F.array(own(F.xxhash64(me["ch"], F.pmod(rid, salts)))))
            mine = F.when(salts == 1, F.array(own(me["ch"]), before, after)).otherwise(F.concat(dealt, F.array(before, after)))
            return F.filter(mine, lambda x: x.isNotNull())

        return F.flatten(F.transform(wanted, beside))

    return let(F.array_sort(wanted), lambda w: _parsed(text, lambda u, h, c: of(u, h, c, w)))


def alike(x: Column, y: Column) -> Column:
    """How many of their first lines two passages share."""
    both = F.zip_with(F.split(x, "\n", -1), F.split(y, "\n", -1), lambda a, b: a.eqNullSafe(b) & a.isNotNull())
    return let(both, lambda same: F.coalesce(F.nullif(F.array_position(same, F.lit(False)), F.lit(0)) - 1, F.size(same)).cast("int"))


def _most_words(x: Column) -> Column:
    """At least the number of words of a text: one more than its gaps have characters."""
    gone = lambda gaps: F.octet_length(x) - F.octet_length(_replaced(x, [(g, "") for g in gaps]))
    odd = reduce(lambda a, b: a | b, [F.contains(x, F.lit(g)) for g in "\t\r\x0b\x0c"])
    return F.when(odd, gone(GAPS)).otherwise(gone(" \n")) + 1


def joined(hit: DataFrame, min_words: int) -> DataFrame:
    """Runs (a, b), b exclusive, of the lines that any span (a, b, words) of a document covers, in order, as (_rid, _runs).

    Runs whose spans have fewer than `min_words` words in all can't lose any and are left out.
    """
    before = Window.partitionBy("_rid").orderBy("a", "b")
    met = F.coalesce(F.col("a") <= F.max("b").over(before.rowsBetween(Window.unboundedPreceding, -1)), F.lit(False))
    run = hit.select("_rid", "a", "b", "words", F.when(met, 0).otherwise(1).alias("begins"))
    run = run.withColumn("run", F.sum("begins").over(before.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    run = run.groupBy("_rid", "run").agg(F.min("a").alias("a"), F.max("b").alias("b"), F.sum("words").alias("words")).where(F.col("words") >= min_words)
    return run.groupBy("_rid").agg(F.array_sort(F.collect_list(F.struct("a", "b"))).alias("_runs"))


def _without(text: Column, runs: Column, min_words: int) -> Column:
    """(t, n): a text without the runs of its lines that have `min_words` words or more, and how many words went."""

    def of(us: Column) -> Column:
        words = lambda x: word_count(F.array_join(_part(us, x["a"], x["b"]), ""))
        counted = F.transform(runs, lambda x: F.struct(x["a"].alias("a"), x["b"].alias("b"), words(x).alias("n")))

        def cut(g: Column) -> Column:
            upto = lambda i: F.coalesce(F.get(g, i)["a"], F.size(us))
            kept = F.transform(F.sequence(F.lit(0), F.size(g)), lambda i: let(F.coalesce(F.get(g, i - 1)["b"], F.lit(0)), lambda b: F.when(upto(i) > b, F.array_join(_part(us, b, upto(i)), "")).otherwise("")))
            lead = F.when(F.get(g, 0)["a"] == 0, F.lit("")).otherwise(F.substring(text, F.lit(1), F.length(text) - F.length(F.ltrim(text, F.lit(GAPS)))))  # blanks before the first line are its
            return F.struct(F.concat(lead, F.array_join(kept, "")).alias("t"), F.aggregate(g, F.lit(0).cast("long"), lambda acc, x: acc + x["n"]).alias("n"))

        return let(F.filter(counted, lambda x: x["n"] >= min_words), lambda g: F.when(F.size(g) > 0, cut(g)))

    return let(whole_lines(text), of)


def dedup_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_words: int = 30, bucket_bytes: int = 6_000_000) -> DataFrame:
    """`docs` without passages of several lines that occur before, in the same or an earlier document.

    Lines end at line feeds, sentences and words with some last letters, and long
    ones are cut at words by their hash (see `plain_lines`). Where the rolling hash of two
    lines on end falls, and where a paragraph starts, a chunk starts; so chunks
    follow the content and not the place. Chunks of two lines or more
    whose hash occurs twice are compared with their first occurrence, by document id
    and place, and where the lines are the same bytes but for blanks and line ends
    around them, the later one goes. The lines beside a run of repeated chunks are
    compared with those of the first document that goes on alike from the same
    chunk, so that the parts of a passage that form no whole chunk go too; where
    that document repeats more than this one does they may stay. What goes in one
    piece has at least `min_words` words: shorter repeats are phrases. One line over
    and over has no boundary: it is a single chunk.

    Only DataFrame functions are used. What is dealt by hashes goes to as many
    tasks as the texts have `bucket_bytes` bytes, and a chunk of over `_HOT`
    occurrences is compared by several tasks, each of which gets its first place.

    Adds removed_words (long) and changes `text_col`; a column of that name gives
    way. Ids are integers. A null text stays null; an empty text stays. Identical
    rows (id and text) are one document: both keep or lose the same. Null ids come
    first. A document that loses every word keeps its row with the words' rest, at
    most white space. An empty table gives an empty result. Other columns pass.
    """
    spark = docs.sparkSession
    docs = docs.drop(*[c for c in docs.columns if c.lower() == "removed_words"])
    rid = F.xxhash64(F.coalesce(F.col(id_col).cast("string"), F.lit("\x00")), F.coalesce(F.col(text_col), F.lit("\x00")))
    d = docs.select(rid.alias("_rid"), F.coalesce(F.col(id_col).cast("long"), F.lit(-(2**63))).alias("_id"), F.coalesce(F.col(text_col), F.lit("")).alias("_t"))
    size = d.agg(F.coalesce(F.sum(F.octet_length("_t")), F.lit(0))).first()[0]
    n_buckets = max(16, min(1 << 20, int(size) // bucket_bytes))

    found = d.select("_id", "_rid", F.posexplode(_parsed(F.col("_t"), lambda u, h, c: F.transform(c, lambda x: x["ch"]))).alias("k", "ch"))
    place = Window.partitionBy("ch").orderBy("_id", "_rid", "k").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    ends = {f"{name}{c}": f(c).over(place) for c in ("_rid", "k") for name, f in (("first", F.first), ("last", F.last))}
    found = found.repartition(n_buckets, "ch").withColumns(ends | {"n": F.count("*").over(place)}).where("first_rid <> last_rid or firstk <> lastk")
    salts = F.floor(F.col("n") / _HOT) + 1
    want = found.select("_rid", _want(F.col("k"), salts, F.expr("_rid = first_rid and k = firstk")).alias("w"))
    want = want.repartition(n_buckets, "_rid").groupBy("_rid").agg(F.collect_set("w").alias("_w"))
    with shuffles_spent(spark):
        want = table(want, "lines-repeated")

    near = d.repartition(n_buckets, "_rid").join(want.repartition(n_buckets, "_rid").hint("shuffle_hash"), "_rid")
    near = near.select("_id", "_rid", F.explode(pieces(F.col("_t"), F.col("_w"), F.col("_rid"))).alias("c")).select("_id", "_rid", "c.*")
    order = Window.partitionBy("key").orderBy("_id", "_rid", "k")
    near = near.repartition(n_buckets, "key").withColumns({f"first{c}": F.first(c).over(order) for c in ("_rid", "k", "x")})
    hit = near.where("_rid <> first_rid or k <> firstk")
    hit = hit.withColumn("n", F.when(F.col("x") == F.col("firstx"), F.col("lines")).when(F.col("side") != 0, alike(F.col("x"), F.col("firstx"))).otherwise(0)).where("n > 0")
    a = F.when(F.col("side") < 0, F.col("at") - F.col("n")).otherwise(F.col("at"))
    spans = hit.select("_rid", a.alias("a"), (a + F.col("n")).alias("b"), _most_words(F.col("x")).cast("long").alias("words"))
    rid_col, cuts_col, done_col = (fresh(docs, c) for c in ("_rid", "_cuts", "_done"))
    cuts = joined(spans.repartition(n_buckets, "_rid"), min_words)
    with shuffles_spent(spark):
        cuts = table(cuts.select(F.col("_rid").alias(rid_col), F.col("_runs").alias(cuts_col)), "lines-cuts")
    forget(want)

    out = docs.withColumn(rid_col, rid).repartition(n_buckets, rid_col).join(cuts.repartition(n_buckets, rid_col).hint("shuffle_hash"), rid_col, "left")
    out = out.withColumn(done_col, F.when(F.col(cuts_col).isNotNull(), _without(F.col(text_col), F.col(cuts_col), min_words)))
    n = F.coalesce(F.col(done_col)["n"], F.lit(0)).cast("long")
    text = F.when(n > 0, F.col(done_col)["t"]).otherwise(F.col(text_col))
    return out.withColumn(text_col, text).withColumn("removed_words", n).drop(rid_col, cuts_col, done_col)
