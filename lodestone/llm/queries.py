"""The corpus operators as registered queries, over whole tables with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def _read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _vocabulary(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_brown_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .brown import score_documents

    return score_documents(_read(spark, sf_dir, "documents"))


def op2_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .linededup import dedup_lines

    d = dedup_lines(_read(spark, sf_dir, "documents"))
    return d.select("doc_id", F.length("text").cast("long").alias("kept_chars"), "removed_words", F.md5(F.col("text").cast("binary")).alias("text_md5"), "text")


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .toxicity import toxicity

    t = toxicity(_read(spark, sf_dir, "documents"), _read(spark, sf_dir, "labels"))
    return t.select("doc_id", "held_out", "score", "predicted")


def op4_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .tokencount import token_counts

    return token_counts(_read(spark, sf_dir, "documents"), _vocabulary("piece_bpe_32k.model"))


def op5_metric_range_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .metricjoin import near_duplicates

    return near_duplicates(_read(spark, sf_dir, "embeddings"))


def op6_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .secrets import digest, scan

    s = scan(_read(spark, sf_dir, "documents"))
    n = lambda kind: F.size(F.filter("base", lambda x: x["kind"] == kind)).cast("long").alias(f"n_{kind}")
    spans = F.array_sort(F.concat("base", "added"))
    return s.select("doc_id", n("assign"), n("access"), n("hex"), F.sha2(digest(F.col("base")), 256).alias("base_sha256"), digest(spans).alias("spans"))


def op7_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .quality import quality

    q = quality(_read(spark, sf_dir, "documents"))
    return q.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "posterior")


def op8_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .packing import pack

    return pack(_read(spark, sf_dir, "documents"), _vocabulary("word_bpe_49k.json"))


def op9_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .jaccard import near_duplicates

    return near_duplicates(_read(spark, sf_dir, "documents"))


def op10_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .mixing import mix_sources

    return mix_sources(_read(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_brown_scores": op1_brown_scores,
    "op2_line_dedup": op2_line_dedup,
    "op3_toxicity": op3_toxicity,
    "op4_token_counts": op4_token_counts,
    "op5_metric_range_join": op5_metric_range_join,
    "op6_secret_scan": op6_secret_scan,
    "op7_quality_rules": op7_quality_rules,
    "op8_packing": op8_packing,
    "op9_jaccard_join": op9_jaccard_join,
    "op10_source_mixing": op10_source_mixing,
}

#: smallest id reachable by the links (a, b), both ways
_REACHED = "reached as (select i as id, i as c from ids union select l.b, r.c from reached r join (select a, b from links union all select b, a from links) l on l.a = r.id), components as (select id, min(c) as component_id from reached group by 1)"

ORACLES: dict[str, str] = {
    "op5_metric_range_join": f"""
with recursive v as (
  select vec_id, label, embedding::double[] as x from embeddings
  where label is not null and embedding is not null and len(list_filter(embedding, lambda c: c is null or not isfinite(c))) = 0 and len(list_filter(embedding, lambda c: c <> 0)) > 0
), links as (
  select p.vec_id as a, q.vec_id as b from v p join v q on p.label = q.label and p.vec_id < q.vec_id and len(p.x) = len(q.x) where list_cosine_similarity(p.x, q.x) >= 0.98
), ids as (select vec_id as i from embeddings), {_REACHED}, n as (select id, count(*) as n_links from (select a as id from links union all select b from links) group by 1)
select i as vec_id, coalesce(n_links, 0)::bigint as n_links, component_id, component_id = i as kept from ids join components on components.id = i left join n on n.id = i""",
    "op9_jaccard_join": f"""
with recursive t as (
  select doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') as w from documents
), s as (
  select doc_id, case when len(w) = 0 then [] when len(w) < 5 then [array_to_string(w, ' ')] else list_distinct([array_to_string(w[j:j + 4], ' ') for j in range(1, len(w) - 3)]) end as s from t
), h as (select doc_id, unnest(s) as h from s), n as (select doc_id, len(s)::bigint as n from s), common as (
  select p.doc_id as a, q.doc_id as b, count(*) as c from h p join h q on p.h = q.h and p.doc_id < q.doc_id group by 1, 2
), links as (
  select a, b from common join n x on x.doc_id = a join n y on y.doc_id = b where 100 * c >= 75 * (x.n + y.n - c)
), ids as (select doc_id as i from documents), {_REACHED}
select doc_id, n as n_shingles, component_id from n join components on components.id = doc_id""",
}
