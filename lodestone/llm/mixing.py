"""Mixing sources to target weights by Sainte-Lague apportionment."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import table, word_count

_STEP = 2654435761  # a prime above any number of blocks of a shard, so that it permutes them


def source_targets(sources: DataFrame, weights: tuple[float, ...], share: float, max_epochs: int) -> DataFrame:
    """Water-filling: min(cap, level * weight) with the level that spends `share` of all words.

    `sources` has one row per source: src_key, source, source_size. The level is
    the largest of (rest of the words) / (rest of the weights) over the sources
    in the order in which they reach their caps. That is where resharing the
    excess by weight ends.
    """
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    s = sources.withColumn("_i", F.row_number().over(by_name) - 1)
    s = s.withColumn("_w", F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.col("_i") % len(weights) + 1).cast("int")))
    s = s.withColumn("_cap", F.col("source_size") * F.lit(float(max_epochs)))
    all_, before = Window.partitionBy(), Window.orderBy(F.col("_cap") / F.col("_w"), "_i").rowsBetween(Window.unboundedPreceding, -1)
    left = F.sum("source_size").over(all_) * F.lit(float(share)) - F.coalesce(F.sum("_cap").over(before), F.lit(0.0))
    heavy = F.sum("_w").over(all_) - F.coalesce(F.sum("_w").over(before), F.lit(0.0))
    s = s.withColumn("_l", left / heavy)
    s = s.withColumn("target", F.least(F.col("_cap"), F.max("_l").over(all_) * F.col("_w")))
    return s.drop("_i", "_w", "_cap", "_l")


def sainte_lague(units: DataFrame, group: list[str], unit: str, weight: str, seats: str, out: str) -> DataFrame:
    """Apportion `seats` (one value per group) to the group's units by highest quotients weight / (2k + 1).

    Starts at the rounded shares, which the method of divisors gives for the
    divisor weight sum / seats, and hands out or takes back the few seats that
    remain in the order of the quotients; ties go to the smaller unit. Units
    without weight get none. Work and memory follow the number of units, not
    of seats.
    """
    g = Window.partitionBy(*group)
    u = units.withColumn("_sum", F.sum(weight).over(g))
    share = F.when(F.col("_sum") > 0, F.col(seats) * F.col(weight) / F.col("_sum")).otherwise(0.0)
    u = u.withColumn("_q", F.floor(share + 0.5).cast("long"))
    u = u.withColumn("_d", F.when(F.col("_sum") > 0, F.col(seats)).otherwise(0) - F.sum("_q").over(g))
    more = F.ceil(F.when(F.col("_sum") > 0, 2.0 * F.abs("_d") * F.col(weight) / F.col("_sum")).otherwise(0.0)).cast("int") + 2
    e = u.withColumn("_k", F.explode(F.sequence(F.lit(1), F.when(F.col("_d") == 0, 1).otherwise(more))))
    up = F.col(weight) / (2 * (F.col("_q") + F.col("_k") - 1) + 1)
    nth = F.col("_q") - F.col("_k") + 1  # the seat taken back
    down = F.when(nth >= 1, F.col(weight) / (2 * nth - 1))
    quotient = F.when(F.col("_d") >= 0, -up).otherwise(F.coalesce(down, F.lit(float("inf"))))
    ranked = Window.partitionBy(*group).orderBy(quotient, F.when(F.col("_d") >= 0, F.col(unit)), F.col(unit).desc(), "_k")
    e = e.withColumn("_r", F.row_number().over(ranked))
    changed = F.when((F.col("_r") <= F.abs("_d")) & (F.col(weight) > 0), F.signum("_d")).otherwise(0).cast("long")
    kept = [c for c in units.columns if c not in {*group, unit}]
    return e.groupBy(*group, unit).agg(*[F.first(c).alias(c) for c in kept], (F.first("_q") + F.sum(changed)).alias(out))


def _hash(c: Column, seed: int) -> Column:
    return F.xxhash64(F.lit(seed), c)


def mix_sources(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
    weights: tuple[float, ...] = (5.0, 2.0, 1.0),
    share: float = 1.5,
    max_epochs: int = 2,
    block_words: int = 256,
    shard_rows: int = 4000,
    seed: int = 17,
) -> DataFrame:
    """How many words of each document a weighted mixture takes.

    Sources in code-point order (null last) weigh `weights`, repeating, and
    share `share` times all words; a target stops at `max_epochs` times its
    source's size and the excess is reshared by weight. The mixture is cut into
    blocks of `block_words` words. Highest quotients give each source an
    integer quota of blocks, and then each shard of a source its part of that
    quota. A shard holds about `shard_rows` documents, dealt by a hash of id and
    text, so that no id, null neither, is hot, in the order of a seeded hash; its words form blocks, and a seeded
    permutation of them says which are taken once more than the rest.

    Returns `id_col`, source, size, source_size, target, taken (long). A null
    text has size 0 and is never taken; null ids are one id; repeated rows count
    each; a null source is a source of its own; an empty table gives an empty
    result. No document is taken more than `max_epochs` times. Hot sources are
    split into shards, so no task gathers a source.
    """
    key = F.coalesce(F.concat(F.lit("s"), F.col("source")), F.lit("n"))
    d = docs.select(F.col(id_col).alias("_id"), F.col(source_col).cast("string").alias("source"), word_count(F.col(text_col)).alias("size"), F.xxhash64(text_col).alias("_text"))
    d = table(d.withColumn("src_key", key), "mix-sizes")
    sources = d.groupBy("src_key").agg(F.first("source").alias("source"), F.sum("size").alias("source_size"), F.count("*").alias("_n"))
    sources = source_targets(sources, weights, share, max_epochs)
    sources = sources.withColumn("_all", F.lit(0)).withColumn("_seats", F.round(F.sum("target").over(Window.partitionBy()) / block_words).cast("long"))
    sources = sainte_lague(sources, ["_all"], "src_key", "target", "_seats", "_quota")
    sources = sources.withColumn("_shards", F.ceil(F.col("_n") / shard_rows).cast("long"))
    sources = table(sources.select("src_key", "source_size", "target", "_quota", "_shards"), "mix-sources")
    d = d.join(sources, "src_key").withColumn("_shard", F.pmod(F.xxhash64(F.lit(seed), "_id", "_text"), F.col("_shards")))
    shards = d.groupBy("src_key", "_shard").agg(F.sum("size").alias("_words"), F.first("_quota").alias("_quota"))
    shards = sainte_lague(shards, ["src_key"], "_shard", "_words", "_quota", "_blocks")
    d = d.drop("_quota", "_shards").join(shards.select("src_key", "_shard", "_words", "_blocks"), ["src_key", "_shard"])
    order = Window.partitionBy("src_key", "_shard").orderBy(_hash(F.col("_id"), seed + 1), "_id", "_text", "size")
    d = d.withColumn("_end", F.sum("size").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    size, start, n = F.col("size"), F.col("_end") - F.col("size"), F.greatest(F.ceil(F.col("_words") / block_words).cast("long"), F.lit(1))
    quota = F.least(F.col("_blocks"), n * max_epochs)
    turn = F.pmod(_hash(F.concat_ws("/", "src_key", F.col("_shard").cast("string")), seed + 2), n)
    d = d.select("_id", "source", "size", "source_size", "target", "_end", start.alias("_start"), n.alias("_n"), F.floor(quota / n).cast("long").alias("_each"), F.pmod(quota, n).alias("_extra"), turn.alias("_turn"))

    def part(acc: Column, b: Column) -> Column:
        words = F.least(F.col("_end"), (b + 1) * block_words) - F.greatest(F.col("_start"), b * block_words)
        chosen = F.pmod(b * F.lit(_STEP) + F.col("_turn"), F.col("_n")) < F.col("_extra")
        return acc + words * (F.col("_each") + chosen.cast("long"))

    blocks = F.sequence(F.floor(F.col("_start") / block_words), F.floor((F.col("_end") - 1) / block_words))
    taken = F.when(size > 0, F.aggregate(blocks, F.lit(0).cast("long"), part)).otherwise(F.lit(0).cast("long"))
    return d.select(F.col("_id").alias(id_col), "source", "size", "source_size", "target", taken.alias("taken"))
