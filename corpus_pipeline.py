"""The corpus pipeline: five stages over `documents`, each one operator of the corpus subpackage.

Counted as part of that subpackage. Each stage takes (spark, docs, sf_dir), works on
all that the stage before it kept, and returns the columns of documents; the
last returns packed pieces.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lodestone.llm import jaccard, linededup, mixing, packing, toxicity
from lodestone.llm.common import fresh, table

#: Below this score a document stays.
TOXIC_AT = 0.7


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity models, fitted on all labels, don't reject."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    scored = toxicity.toxicity(docs, labels, holdout=None, threshold=TOXIC_AT)
    return scored.where("predicted = 0").select(*docs.columns)


def drop_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without passages of an earlier one; those of which no word is left were copies, and go."""
    out = linededup.dedup_lines(docs)
    emptied = (F.col("removed_words") > 0) & (F.trim(F.translate("text", "\t\n\r\x0b\x0c", "")) == "")
    out = out.where(~emptied)
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.when(F.col("removed_words") > 0, F.length("text").cast("long")).otherwise(F.col("n_chars")))
    return out.select(*docs.columns)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of linked ones: that with the smallest id."""
    found = jaccard.near_duplicates(docs)
    name = fresh(docs, "_gone")
    gone = found.where("doc_id <> component_id").select(F.col("doc_id").alias(name)).distinct()
    return docs.join(gone, F.col("doc_id") == F.col(name), "left_anti").select(*docs.columns)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mixture takes it, up to twice, so that each source's words come to what is taken of them.

    Whole documents carry the mixture on: one taken for n words of s is due n / s
    times. Within a shard of a source, by size and then in seeded order, what
    rounding leaves is carried to the next document, so a shard's words differ
    from those taken by its longest document at most. Rows with a null id are kept
    and counted as others; rows alike in id, text and source share what they are
    due. Texts without words have no share and go.
    """
    one, shard_rows, seed = 1 << 20, 4000, 29
    columns, (key, row, rows, times, nth, copy) = docs.columns, (fresh(docs, f"_mix_{x}") for x in ("key", "row", "rows", "times", "nth", "copy"))
    docs = docs.withColumn(key, F.xxhash64(F.coalesce(F.col("doc_id").cast("string"), F.lit("\x00")), F.coalesce("text", F.lit("\x00")), F.coalesce("source", F.lit("\x00"))))
    taken = mixing.mix_sources(docs.select("text", "source", F.struct("doc_id", F.col(key).alias("key")).alias(row)), id_col=row).where("size > 0")
    source = F.coalesce(F.concat(F.lit("s"), F.col("source")), F.lit("n"))
    due = taken.groupBy(F.col(row)["key"].alias("key"), source.alias("src")).agg(F.max("size").alias("size"), F.count("*").alias("rows"), F.sum("taken").alias("taken"))
    due = table(due.withColumn("due", F.round(F.col("taken") * one / F.col("size")).cast("long")), "pipeline-due")
    shards = due.groupBy("src").agg(F.ceil(F.count("*") / shard_rows).cast("long").alias("shards"))
    due = due.join(shards, "src")
    due = due.withColumn("shard", F.pmod(F.xxhash64(F.lit(seed), "key"), F.col("shards"))).repartition("src", "shard")  # else a source may be one task
    order = Window.partitionBy("src", "shard").orderBy("size", F.xxhash64(F.lit(seed + 1), "key"), "key")
    turn = F.pmod(F.xxhash64(F.lit(seed + 2), "src", "shard"), F.lit(one))
    due = due.withColumn("upto", turn + F.sum("due").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    due = due.withColumn("times", F.floor(F.col("upto") / one) - F.floor((F.col("upto") - F.col("due")) / one))
    due = table(due.where("times > 0").select(F.col("key").alias(key), F.col("rows").alias(rows), F.col("times").alias(times)), "pipeline-mix")
    out = docs.join(due, key)
    number = F.row_number().over(Window.partitionBy(key).orderBy(F.xxhash64(*columns)))
    n = F.floor(F.col(times) / F.col(rows)) + (number <= F.col(times) % F.col(rows)).cast("int")
    out = out.withColumn(nth, n.cast("int")).where(F.col(nth) > 0)
    return out.withColumn(copy, F.explode(F.sequence(F.lit(1), F.col(nth)))).select(*columns)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Packed pieces of the mixture, sequences of at most 4096 tokens."""
    import public_tokenizers

    return packing.pack(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [
    ("toxicity", drop_toxic),
    ("line_dedup", drop_repeated_lines),
    ("jaccard_join", drop_near_copies),
    ("mixing", mix),
    ("packing", pack),
]

#: Tokenizers and fitted models are beyond SQL; the tests hold each stage against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of `sf_dir`."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = stage(spark, docs, sf_dir)
        if name != STAGES[-1][0]:
            docs = table(docs, f"pipeline-{name}")
    return docs
