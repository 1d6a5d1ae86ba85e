"""Membership filters and spelling lookup."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.arrow import osa
from ..functions.scalar import soundex


def bloom_shape(size: int, p: float) -> tuple[int, int]:
    """Bits (64 at least) and number of hashes for `size` words at false-positive rate `p`."""
    return max(64, math.ceil(-size * math.log(p) / math.log(2) ** 2)), max(1, round(-math.log2(p)))


def _bits(word, bits: int, k: int):
    a, b = F.xxhash64(F.lit(1), word), F.xxhash64(F.lit(2), word).bitwiseOR(F.lit(1).cast("long"))
    half = lambda x: F.pmod(x, F.lit(1 << 31))
    return F.array_distinct(F.array(*[F.pmod(half(a) + F.lit(i) * half(b), F.lit(bits)) for i in range(k)]))


def bloom_build(words: DataFrame, column: str, size: int, p: float = 0.01) -> DataFrame:
    """The filter as rows (slot, mask) of 64 bits each; empty words are left out."""
    bits, k = bloom_shape(size, p)
    b = words.where(F.col(column) != "").select(F.explode(_bits(F.col(column), bits, k)).alias("b"))
    return b.groupBy(F.expr("b div 64").alias("slot")).agg(F.bit_or(F.expr("shiftleft(1L, cast(b % 64 as int))")).alias("mask"))


def bloom_contains(filter_: DataFrame, words: DataFrame, column: str, size: int, p: float = 0.01) -> DataFrame:
    """The rows of `words` that may be in the filter: no false negatives."""
    bits, k = bloom_shape(size, p)
    w = words.where(F.col(column) != "").select(F.col(column).alias("_w")).distinct()
    w = w.select("_w", F.explode(_bits(F.col("_w"), bits, k)).alias("b"))
    hit = w.join(filter_, F.expr("b div 64") == F.col("slot")).where("mask & shiftleft(1L, cast(b % 64 as int)) <> 0")
    all_ = w.groupBy("_w").agg(F.count("*").alias("_n"))
    yes = hit.groupBy("_w").agg(F.count("*").alias("_h")).join(all_, "_w").where("_h = _n").select("_w")
    return words.join(yes, F.col(column) == F.col("_w"), "left_semi")


def spell(vocabulary: DataFrame, words: DataFrame, scope: int = 4, top: int = 20) -> DataFrame:
    """(word, match, distance, score): vocabulary (word, rank) with an equal phonetic code or the same first two letters, within `scope` edits."""
    distance = F.udf(lambda a, b: osa(a.encode(), b.encode()), "long", useArrow=True)
    keys = lambda c: F.array_distinct(F.array(F.concat(F.lit("s"), soundex(c)), F.concat(F.lit("p"), F.lower(F.substring(c, 1, 2)))))
    v = vocabulary.dropDuplicates(["word"]).select(F.col("word").alias("match"), "rank", F.explode(keys(F.col("word"))).alias("key"))
    w = words.select("word").distinct().withColumn("key", F.explode(keys(F.col("word"))))
    c = w.join(v, "key").select("word", "match", "rank").distinct()
    # an edit changes the length by one at most
    c = c.where(F.abs(F.octet_length("word") - F.octet_length("match")) <= scope).withColumn("distance", distance("word", "match")).where(F.col("distance") <= scope)
    c = c.withColumn("score", F.col("distance") * 1024 - F.col("rank"))
    r = F.row_number().over(Window.partitionBy("word").orderBy("score", "match"))
    return c.withColumn("_r", r).where(F.col("_r") <= top).select("word", "match", "distance", "score")
