"""Secret scans: fixed patterns and sliding-window entropy over candidate strings."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import let

#: kind -> (pattern, shortest accepted match). `assign` is judged by its value instead.
ASSIGN = r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]{14,}"  # 18 or more characters in all
HEX = r"[0-9a-f]{16,}"
ASSIGN_VALUE = 12

#: Strings whose windows are measured: long runs of the base-64 alphabets.
CANDIDATE = r"[A-Za-z0-9+/_=-]{20,}"
ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_=-"
#: Candidates that are never secrets: words, also joined ones; numbers and dates; UUIDs; digests announced as such.
ALLOW = r"^(?:[A-Za-z]+|(?!.*[A-Za-z][A-Z])[A-Z]?[a-z][A-Za-z_/+=-]*|[0-9/_=+-]+|[0-9a-fA-F]{8}(?:-[0-9a-fA-F]{4}){3}-[0-9a-fA-F]{12}|sha(?:1|256|512)-.*)$"
#: What marks a sample key, in a span or within a window's width of it.
SAMPLES = r"(?i)example|sample|dummy|placeholder|xxxx"
_NONE = "cast(array() as array<struct<s:int,e:int,m:string>>)"
_PAIRS = "cast(array() as array<struct<a:int,z:int>>)"
_BITS, _PER_LONG = 5, 12  # a count takes 5 bits, so a window has up to 31 characters
_BLOCK = 64  # windows that are counted on from one start


def running(x: Column) -> Column:
    """The sum of the numbers before each place of array `x`: of the blocks before, and within the block."""
    block = 128
    add = lambda a: F.aggregate(a, F.lit(0), lambda acc, v: acc + v)
    sums = F.transform(F.sequence(F.lit(0), F.floor(F.size(x) / block).cast("int")), lambda k: add(F.slice(x, k * block + 1, block)))
    upto = lambda b: F.transform(b, lambda _, k: add(F.slice(b, F.lit(1), k)))
    each = lambda u: F.transform(x, lambda _, i: F.get(u, F.floor(i / block).cast("int")) + add(F.slice(x, i - i % block + 1, i % block)))
    return let(let(sums, upto), each)


def matches(t: Column, pattern: str) -> Column:
    """Leftmost non-overlapping matches of `t` as structs (s, e, m): code points, end exclusive.

    The pieces between the matches and the matches themselves give the places.
    """

    def place(m: Column) -> Column:
        def located(pieces: Column) -> Column:
            steps = F.transform(m, lambda x, i: F.length(F.get(pieces, i)) + F.length(x))

            def hit(x: Column, i: Column, at: Column) -> Column:
                s = F.get(at, i) + F.length(F.get(pieces, i))
                return F.struct(s.alias("s"), (s + F.length(x)).alias("e"), x.alias("m"))

            return let(let(steps, running), lambda at: F.transform(m, lambda x, i: hit(x, i, at)))

        return let(F.split(t, pattern, -1), located)

    return let(F.regexp_extract_all(t, F.lit(pattern), F.lit(0)), lambda m: F.when(F.size(m) > 0, place(m)).otherwise(F.expr(_NONE)))


def blanked(t: Column, found: Column, pattern: str, keep=lambda m: F.lit(False)) -> Column:
    """`t` with spaces in place of its matches `found` of `pattern`, but for those that `keep` holds true for."""
    fill = lambda m: F.when(keep(m), m).otherwise(F.repeat(F.lit(" "), F.length(m)))
    joined = lambda pieces: F.array_join(F.transform(pieces, lambda x, i: F.concat(x, F.coalesce(fill(F.get(found, i)["m"]), F.lit("")))), "")
    return F.when(F.size(found) > 0, let(F.split(t, pattern, -1), joined)).otherwise(t)


def blank_all(t: Column, pattern: str) -> Column:
    """`t` with spaces in place of all matches of `pattern`."""
    found = lambda x: F.transform(F.regexp_extract_all(x, F.lit(pattern), F.lit(0)), lambda m: F.struct(m.alias("m")))
    return let(t, lambda x: let(found(x), lambda m: blanked(x, m, pattern)))


def hot_spans(s: Column, width: int, levels: dict[str, float]) -> Column:
    """The maximal parts of string `s` that its high-entropy windows cover, as structs (a, z).

    A window of `width` (31 at most) characters slides over `s`. Counts per
    character change by one in and one out, and with them the sum of n * log2(n);
    the entropy is log2(width) - sum / width. The level depends on the character
    class of the whole string: hex, lower (letters of one case with digits) or mixed.

    Counts are packed, `_PER_LONG` to a long. Every `_BLOCK` windows they start
    anew, so that a list never grows long while it is made and the work follows
    the length of `s`; parts that meet are joined afterwards.
    """
    if not 1 < width < 1 << _BITS:
        raise ValueError(f"a window has 2 to {(1 << _BITS) - 1} characters")
    level = (
        F.when(s.rlike("^[0-9a-fA-F_-]+$"), levels["hex"])
        .when(s.rlike("^[a-z0-9_=+/-]+$") | s.rlike("^[A-Z0-9_=+/-]+$"), levels["lower"])
        .otherwise(levels["mixed"])
    )
    n_longs = -(-len(ALPHABET) // _PER_LONG)
    weights = F.array(*[F.lit(n * math.log2(n) if n else 0.0) for n in range(width + 1)])
    long_of, shift_of = (lambda code: F.floor((code - 1) / _PER_LONG).cast("int")), (lambda code: (code - 1) % _PER_LONG * _BITS)

    def shift(acc: Column, code: Column, by: int) -> Column:
        """acc with one more or one less of the character `code`; code 0 changes nothing."""
        old = F.call_function("shiftright", F.get(acc["c"], long_of(code)), shift_of(code)).bitwiseAND(F.lit((1 << _BITS) - 1)).cast("int")
        one = F.call_function("shiftleft", F.lit(by).cast("long"), shift_of(code))
        counts = F.transform(acc["c"], lambda v, k: F.when(k == long_of(code), v + one).otherwise(v))
        changed = F.struct(counts.alias("c"), (acc["t"] + F.get(weights, old + by) - F.get(weights, old)).alias("t"), acc["out"].alias("out"))
        return F.when(code > 0, changed).otherwise(acc)

    def block(codes: Column, first: Column, level: Column) -> Column:
        """Parts covered by the hot ones among the `_BLOCK` windows from place `first` on."""
        start = F.struct(F.array_repeat(F.lit(0).cast("long"), n_longs).alias("c"), F.lit(0.0).alias("t"), F.expr(_PAIRS).alias("out"))

        def step(acc: Column, i: Column) -> Column:
            gone = F.when(i >= first + width, F.get(codes, i - width)).otherwise(0)
            return let(shift(acc, gone, -1), lambda x: let(shift(x, F.get(codes, i), 1), lambda y: judge(y, i)))

        def judge(x: Column, i: Column) -> Column:
            hot = (i >= first + width - 1) & (F.lit(math.log2(width)) - x["t"] / width >= level)
            last, a, z = F.get(x["out"], F.size(x["out"]) - 1), i - width + 1, i + 1
            longer = F.concat(F.slice(x["out"], F.lit(1), F.size(x["out"]) - 1), F.array(F.struct(last["a"].alias("a"), z.alias("z"))))
            more = F.when(last["z"] >= a, longer).otherwise(F.concat(x["out"], F.array(F.struct(a.alias("a"), z.alias("z")))))
            return F.when(hot, F.struct(x["c"].alias("c"), x["t"].alias("t"), more.alias("out"))).otherwise(x)

        upto = F.least(F.size(codes), first + width - 1 + _BLOCK) - 1
        return F.aggregate(F.sequence(first, upto), start, step, lambda acc: acc["out"])

    def joined(parts: Column) -> Column:
        """Parts that meet, joined: where one begins and where one ends."""
        begins = F.filter(parts, lambda x, i: (i == 0) | (F.get(parts, i - 1)["z"] < x["a"]))
        ends = F.filter(parts, lambda x, i: (i == F.size(parts) - 1) | (F.get(parts, i + 1)["a"] > x["z"]))
        return F.zip_with(begins, ends, lambda x, y: F.struct(x["a"].alias("a"), y["z"].alias("z")))

    def parts(codes: Column) -> Column:
        firsts = F.sequence(F.lit(0), F.size(codes) - width, F.lit(_BLOCK))
        return let(F.flatten(let(level, lambda v: F.transform(firsts, lambda f: block(codes, f, v)))), joined)

    codes = F.transform(F.split(s, ""), lambda x: F.instr(F.lit(ALPHABET), x))
    return F.when(F.length(s) >= width, let(codes, parts)).otherwise(F.expr(_PAIRS))


def scan(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    width: int = 20,
    levels: dict[str, float] | None = None,
    allow: str = ALLOW,
    samples: str = SAMPLES,
) -> DataFrame:
    """Secrets in every text: fixed patterns first, then what entropy adds.

    `base` holds structs (s, k, kind, e) of the three patterns by start and kind order
    (assign, access, hex); `added` those of kind entropy: of each candidate string
    outside the base spans that `allow` doesn't match, the maximal parts that
    windows of `width` characters with an entropy of at least the level of its
    character class cover, but for those with `samples` in them or within `width`
    characters of them. Levels are in bits, log2(20) = 4.32 at most. Adds nothing
    else; returns `id_col`, base, added.

    A null or empty text has no spans. Repeated rows are scanned each; an empty
    table gives an empty result; other columns are ignored. Texts are scanned
    whole, and the work follows their length: no list grows by copies of itself.
    """
    levels = {"hex": 3.1, "lower": 3.6, "mixed": 3.9} | (levels or {})
    t = F.coalesce(F.col(text_col), F.lit(""))

    def spans(found: Column, kind: str, k: int) -> Column:
        return F.transform(found, lambda x: F.struct(x["s"].alias("s"), F.lit(k).alias("k"), F.lit(kind).alias("kind"), x["e"].alias("e")))

    enough = lambda m: F.length(F.regexp_extract(m, ASSIGN, 2)) >= ASSIGN_VALUE
    d = docs.select(F.col(id_col).alias("_id"), t.alias("_t"), matches(t, ASSIGN).alias("_assign"), matches(t, ACCESS).alias("_access"), matches(t, HEX).alias("_hex"))
    # what the patterns took is measured no more; cut by an assignment, the other kinds' spans are found anew in what is left
    left = blanked(F.col("_t"), F.col("_assign"), ASSIGN, lambda m: ~enough(m))
    for pattern in (ACCESS, HEX):
        left = blank_all(left, pattern)
    cand = F.filter(matches(F.col("_left"), CANDIDATE), lambda x: ~x["m"].rlike(allow))
    d = d.withColumn("_left", left).withColumn("_cand", cand).withColumn("_assign", F.filter("_assign", lambda x: enough(x["m"])))
    kinds = ("_assign", "_access", "_hex")

    def hot(x: Column) -> Column:
        def part(h: Column) -> Column:
            around = F.substring(x["m"], F.greatest(h["a"] - width, F.lit(0)) + 1, h["z"] - h["a"] + 2 * width)
            return F.when(~around.rlike(samples), F.struct((x["s"] + h["a"]).alias("s"), F.lit(3).alias("k"), F.lit("entropy").alias("kind"), (x["s"] + h["z"]).alias("e")))

        return F.filter(F.transform(hot_spans(x["m"], width, levels), part), lambda x: x.isNotNull())

    base = F.array_sort(F.concat(*[spans(F.col(c), c[1:], k) for k, c in enumerate(kinds)]))
    added = F.when(F.size("_cand") > 0, F.flatten(F.transform("_cand", hot))).otherwise(F.expr("cast(array() as array<struct<s:int,k:int,kind:string,e:int>>)"))
    return d.select(F.col("_id").alias(id_col), base.alias("base"), added.alias("added"))


def digest(spans: Column) -> Column:
    """kind:start:end of each span, comma-joined."""
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", x["kind"], x["s"].cast("string"), x["e"].cast("string"))), ",")
