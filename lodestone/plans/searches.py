"""Vector, full-text, fusion, spatial and store queries."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import search as X
from ..operators import stores as B
from ..operators import vector as V
from .registry import Tables, query

C = F.col
_L = {"l2": "list_distance(e.embedding::double[], q.v)", "cosine": "1 - list_cosine_similarity(e.embedding::double[], q.v)", "l1": "list_sum([abs(e.embedding[i]::double - q.v[i]) for i in range(1, 65)])"}


def _first(t: Tables) -> list[float]:
    return [float(x) for x in t.embeddings.where("vec_id = 0").first().embedding]


for _m, _e in _L.items():
    query(f"knn_{_m}", f"with q as (select embedding::double[] as v from embeddings where vec_id = 0) select vec_id, round({_e}, 6) as distance from embeddings e, q order by {_e}, vec_id limit 10")(lambda t, m=_m: V.knn(t.embeddings, "embedding", "vec_id", _first(t), 10, m).select("vec_id", F.round("distance", 6).alias("distance")))
query("knn_filtered", f"with q as (select embedding::double[] as v from embeddings where vec_id = 0) select vec_id, round({_L['l2']}, 6) as distance from embeddings e, q where label = 3 order by {_L['l2']}, vec_id limit 5")(lambda t: V.knn(t.embeddings, "embedding", "vec_id", _first(t), 5, "l2", C("label") == 3).select("vec_id", F.round("distance", 6).alias("distance")))
query("knn_hamming", "with b as (select vec_id, [(x > 0)::int for x in embedding] as s from embeddings), q as (select s from b where vec_id = 0) select vec_id, list_sum([abs(b.s[i] - q.s[i]) for i in range(1, 65)])::bigint as distance from b, q")(lambda t: _bits(t))


def _bits(t: Tables) -> DataFrame:
    b = t.embeddings.select("vec_id", V.quantize_binary(C("embedding")).alias("s"))
    q = b.where("vec_id = 0").select(C("s").alias("q"))
    return b.join(F.broadcast(q)).select("vec_id", V.distance(C("s"), C("q"), "hamming").alias("distance"))


query("knn_batch", f"with q as (select vec_id as query_id, embedding::double[] as v from embeddings where vec_id % 100 = 0) select query_id, vec_id, round({_L['l2']}, 6) as distance from embeddings e, q qualify row_number() over (partition by query_id order by {_L['l2']}, vec_id) <= 5")(lambda t: V.knn_batch(t.embeddings, "embedding", "vec_id", t.embeddings.where("vec_id % 100 = 0").select(C("vec_id").alias("query_id"), C("embedding").alias("query")), 5).select("query_id", "vec_id", F.round("distance", 6).alias("distance")))
query("vec_funcs", "select vec_id, len(embedding)::bigint as n, round(embedding[2]::double / sqrt(list_sum([x::double * x for x in embedding])), 6) as unit, round(embedding[3]::double, 6) as third, round(embedding[1]::double + embedding[64]::double, 6) as added, 0.0::double as gone from embeddings")(lambda t: t.embeddings.select("vec_id", F.size("embedding").cast("long").alias("n"), F.round(V.normalize(C("embedding"))[1], 6).alias("unit"), F.round(V.vec_slice(C("embedding"), 2, 3)[0].cast("double"), 6).alias("third"), F.round(V.vec_add(C("embedding"), F.reverse("embedding"))[0], 6).alias("added"), F.array_max(V.vec_sub(C("embedding"), C("embedding"))).alias("gone")))
query("vec_encode", "select vec_id, round(embedding[7]::double, 5) as j, embedding[7]::double as b, 256::bigint as n from embeddings")(lambda t: t.embeddings.select("vec_id", F.round(V.from_json(V.encode(C("embedding")))[6].cast("double"), 5).alias("j"), V.from_f32_blob(V.encode(C("embedding"), "binary"))[6].cast("double").alias("b"), F.octet_length(V.to_f32_blob(C("embedding"))).cast("long").alias("n")))
query("vec_joined", f"with q as (select embedding::double[] as v from embeddings where vec_id = 0), k as (select vec_id from embeddings e, q order by {_L['l2']}, vec_id limit 10) select vec_id, o_totalprice from k join orders on vec_id = o_orderkey")(lambda t: V.knn_joined(t.embeddings, "embedding", "vec_id", _first(t), 10, join=(t.orders, "o_orderkey"), select=["vec_id", "o_totalprice"], order=["o_totalprice"]))
query("vec_partition", f"with q as (select embedding::double[] as v from embeddings where vec_id = 0) select label, vec_id from embeddings e, q qualify row_number() over (partition by label order by {_L['l2']}, vec_id) <= 3")(lambda t: V.knn_by_partition(t.embeddings, "embedding", "vec_id", "label", _first(t), 3).select("label", "vec_id"))
query("vec_quantize", "select vec_id, greatest(-128, least(127, floor((embedding[1]::double + 1) / (2.0::double / 255) + 0.5)::int - 128)) as q from embeddings")(lambda t: t.embeddings.select("vec_id", V.quantize_int8(C("embedding"))[0].alias("q")))
query("vec_each", "select vec_id, count(*) as n, round(sum(x::double), 5) as s from (select vec_id, unnest(embedding) as x from embeddings) group by 1")(lambda t: t.embeddings.select("vec_id", F.posexplode("embedding")).groupBy("vec_id").agg(F.count("*").alias("n"), F.round(F.sum(C("col").cast("double")), 5).alias("s")))
query("search_join", f"with q as (select embedding::double[] as v from embeddings where vec_id = 0), k as (select vec_id, label from embeddings e, q order by {_L['l2']}, vec_id limit 10) select k.vec_id, r_name from k join region on k.label % 5 = r_regionkey")(lambda t: V.knn(t.embeddings, "embedding", "vec_id", _first(t), 10).join(t.region, C("label") % 5 == C("r_regionkey")).select("vec_id", "r_name"))

# --- full text -----------------------------------------------------------
def _words(text: str, split: str) -> str:
    return f"list_filter(regexp_split_to_array({text}, '{split}'), lambda w: w <> '')"


_LETTERS = r"[^\p{L}\p{N}\p{Co}]+"
_TOK = _words("strip_accents(lower(text))", _LETTERS)


def _postings(tokens: str) -> str:
    return f"with w as (select doc_id, {tokens} as w from documents), p as (select doc_id, unnest(w) as term, generate_subscripts(w, 1) - 1 as pos from w)"


_P = _postings(_TOK)
_KEPT = _postings(_words("lower(text)", _LETTERS))


def _ix(t: Tables, tokenizer=None, columns=("text",)) -> X.Index:
    return X.index(t.documents, "doc_id", list(columns), tokenizer)


def _found(key: str, make, where: str, columns=("text",), head: str = _P, tokenizer=None) -> None:
    query(key, f"{head} {where}")(lambda t: make().docs(_ix(t, tokenizer, columns)).select(C("doc").alias("doc_id")))


def _counted(key: str, tokenizer, tokens: str) -> None:
    """Terms and distinct terms of each document."""
    query(key, f"{_postings(tokens)} select doc_id, count(*) as n, count(distinct term) as d from p group by 1")(
        lambda t: _ix(t, tokenizer).docs.select(C("doc").alias("doc_id"), F.size("w0").cast("long").alias("n"), F.size(F.array_distinct("w0")).cast("long").alias("d")).where("n > 0")
    )


_ASCII = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_counted("fts_tokenize", X.Tokenizer(remove_diacritics=0), _words("lower(text)", _LETTERS))
_counted("fts_tokenize_plain", X.Tokenizer(), _TOK)
_counted("fts_ascii", X.Tokenizer("ascii"), _words(_ASCII.format("text"), r"[\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+"))
_counted("fts_tokenchars", X.Tokenizer(tokenchars="-.", separators="e"), _words("strip_accents(lower(text))", r"(?:[^\p{L}\p{N}\p{Co}.\-]|e)+"))
_counted("fts_categories", X.Tokenizer(categories="N*"), _words("text", r"[^\p{N}]+"))
query("fts_porter")(lambda t: X.vocabulary(_ix(t, X.Tokenizer(porter=True))))
query("fts_trigram", "select doc_id, greatest(length(text) - 2, 0)::bigint as n, substr(lower(text), 1, 3) as first from documents where length(text) > 2")(lambda t: t.documents.where("length(text) > 2").select("doc_id", X.Tokenizer("trigram")(C("text")).alias("w")).select("doc_id", F.size("w").cast("long").alias("n"), C("w")[0].alias("first")))
_found("fts_substring", lambda: X.Phrase("ation.\n"), "select doc_id from documents where contains(lower(text), 'ation.' || chr(10))", head="", tokenizer=X.Tokenizer("trigram"))
_found("fts_term", lambda: X.Term("able"), "select distinct doc_id from p where term = 'able'")
_found("fts_prefix", lambda: X.Prefix("abl"), "select distinct doc_id from p where term like 'abl%'")
_found("fts_accents", lambda: X.Or([X.Term("DÉ"), X.Prefix("etré")]), "select distinct doc_id from p where term = 'de' or term like 'etre%'")
_found("fts_phrase", lambda: X.Phrase("of the"), "select distinct a.doc_id from p a join p b on a.doc_id = b.doc_id and b.pos = a.pos + 1 where a.term = 'of' and b.term = 'the'")
_found("fts_phrase_prefix", lambda: X.Raw("of + an *"), "select distinct a.doc_id from p a join p b on a.doc_id = b.doc_id and b.pos = a.pos + 1 where a.term = 'of' and b.term like 'an%'")
_found("fts_and_or", lambda: X.And([X.Term("the"), X.Or([X.Term("able"), X.Term("ation")])]), "select doc_id from p where term = 'the' intersect select doc_id from p where term in ('able', 'ation')")
_found("fts_not", lambda: X.Not(X.Term("the"), X.Term("of"), X.Term("der")), "select doc_id from p where term = 'the' except select doc_id from p where term in ('of', 'der')")
_found("fts_near", lambda: X.Near(3, "idiot", "the"), "select distinct a.doc_id from p a join p b using (doc_id) where a.term = 'idiot' and b.term = 'the' and abs(a.pos - b.pos) - 1 <= 3")
_found("fts_near_many", lambda: X.Near(4, "with", "from", "or"), "select distinct a.doc_id from p a join p b on b.doc_id = a.doc_id and b.pos between a.pos - 9 and a.pos + 9 join p c on c.doc_id = a.doc_id and c.pos between a.pos - 9 and a.pos + 9 where a.term = 'with' and b.term = 'from' and c.term = 'or' and greatest(a.pos, b.pos, c.pos) - least(a.pos, b.pos, c.pos) - 1 <= 4")
_found("fts_initial", lambda: X.InitialToken("the"), "select distinct doc_id from p where term = 'the' and pos = 0")
_BOTH = ("text", "source")
_found("fts_column", lambda: X.InColumn("source", X.Term("src3")), "select doc_id from documents where source = 'src3'", _BOTH, "")
_found("fts_column_set", lambda: X.And([X.ColumnSet(["source", "text"], X.Term("the")), X.ColumnSet(["source"], X.Prefix("src1"))]), "select doc_id from p where term = 'the' intersect select doc_id from documents where source like 'src1%'", _BOTH)
_found("fts_raw", lambda: X.Raw('(able OR "of the") NOT {source} : src1* '), "(select doc_id from p where term = 'able' union select a.doc_id from p a join p b on a.doc_id = b.doc_id and b.pos = a.pos + 1 where a.term = 'of' and b.term = 'the') except select doc_id from documents where source like 'src1%'", _BOTH)


def _ranked(key: str, make, tf: str, columns=("text",), weights=None) -> None:
    """tf gives (doc_id, unit, tf): occurrences of each phrase of the query."""
    length = "len(w)" if columns == ("text",) else "len(w) + 1"  # a source is one term
    query(key, f"""{_P}, n as (select doc_id, {length} as len from w), s as (select count(*) as n, avg(len) as avg from n), tf as ({tf}),
 df as (select unit, count(*) as df from tf group by 1) select doc_id, round(-sum(greatest(1e-6, ln((s.n - df + 0.5) / (df + 0.5))) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * len / s.avg))), 6) as rank
 from tf join df using (unit) join n using (doc_id), s group by 1""")(lambda t: X.bm25(_ix(t, None, columns), make(), weights).select(C("doc").alias("doc_id"), F.round("rank", 6).alias("rank")))


_ranked("bm25", lambda: X.Or([X.Term("able"), X.Term("ation")]), "select doc_id, term as unit, count(*) as tf from p where term in ('able', 'ation') group by 1, 2")
_ranked("bm25_phrase", lambda: X.Phrase("of the"), "select a.doc_id, 1 as unit, count(*) as tf from p a join p b on a.doc_id = b.doc_id and b.pos = a.pos + 1 where a.term = 'of' and b.term = 'the' group by 1")
_ranked("bm25_prefix", lambda: X.Or([X.Prefix("abl"), X.Term("der")]), "select doc_id, case when term = 'der' then 1 else 0 end as unit, count(*) as tf from p where term = 'der' or term like 'abl%' group by 1, 2")
_ranked("bm25_weights", lambda: X.Or([X.Term("src3"), X.Term("able")]), "select doc_id, 0 as unit, 5.0::double as tf from documents where source = 'src3' union all select doc_id, 1, count(*)::double * 0.5 from p where term = 'able' group by 1", _BOTH, {"source": 5.0, "text": 0.5})
query("fts_highlight", r"select doc_id, array_to_string(list_transform(regexp_extract_all(text, '[\p{L}\p{N}]+|[^\p{L}\p{N}]+'), lambda x: case when lower(x) in ('the', 'der') then '<b>' || x || '</b>' else x end), '') as h from documents")(lambda t: t.documents.select("doc_id", X.highlight(C("text"), ["the", "der"]).alias("h")))
query("fts_snippet")(lambda t: t.documents.select("doc_id", X.snippet(C("text"), ["the", "of"], 8).alias("s")))
query("fts_vocab", f"{_P} select term, count(distinct doc_id) as doc, count(*) as cnt from p group by 1")(lambda t: X.vocabulary(_ix(t)))
query("fts_vocab_col", f"{_P} select term, 'text' as col, count(distinct doc_id) as doc, count(*) as cnt from p group by 1 union all select source, 'source', count(*), count(*) from documents group by 1")(lambda t: X.vocabulary(_ix(t, None, _BOTH), "col"))
query("fts_vocab_instance", f"{_P} select term, doc_id as doc, 'text' as col, pos::bigint as \"offset\" from p")(lambda t: X.vocabulary(_ix(t), "instance"))
query("fts_top_terms", f"{_P} select term, count(*) as cnt from p group by 1 order by cnt desc, term limit 25")(lambda t: X.vocabulary(_ix(t)).orderBy(F.desc("cnt"), "term").limit(25).select("term", "cnt"))


@query("fts_saved", f"{_P} select distinct a.doc_id from p a join p b on a.doc_id = b.doc_id and b.pos = a.pos + 1 where a.term = 'of' and b.term = 'the'")
def fts_saved(t: Tables) -> DataFrame:
    """A saved index: the scan of its postings takes the query's terms alone. Without a shared folder the index in memory answers."""
    at = t.spark.conf.get("spark.checkpoint.dir", None)
    ix = _ix(t)
    if at:
        ix = ix.save(f"{at.rstrip('/')}/lodestone/fts-{uuid.uuid4().hex}")
    return X.Phrase("of the").docs(ix).select(C("doc").alias("doc_id"))


# --- fusion and space ----------------------------------------------------
_R = "row_number() over (order by value, event_id)"


def _rrf(t: Tables) -> DataFrame:
    from pyspark.sql import Window

    a = t.events.where("event_type = 'click'").select(C("user_id").alias("key"), F.row_number().over(Window.partitionBy("event_type").orderBy("value", "event_id")).alias("rank"))
    b = t.events.where("event_type = 'view'").select(C("user_id").alias("key"), F.row_number().over(Window.partitionBy("event_type").orderBy("value", "event_id")).alias("rank"))
    return X.rrf([a, b], [1.0, 0.5]).select("key", F.round("score", 8).alias("score"))


query("rrf", f"with a as (select user_id as key, {_R} as r, 1.0 as w from events where event_type = 'click' union all select user_id, {_R}, 0.5 from events where event_type = 'view') select key, round(sum(w::double / (60 + r)), 8) as score from a group by 1")(_rrf)


def _boxes(t: Tables) -> DataFrame:
    return t.orders.select("o_orderkey", C("o_totalprice").alias("x0"), (C("o_totalprice") + 100).alias("x1"), C("o_custkey").cast("double").alias("y0"), (C("o_custkey") + 5.0).alias("y1"))


_D = [("x0", "x1"), ("y0", "y1")]
query("rtree_search", "select o_orderkey from orders where o_totalprice + 100 >= 1000 and o_totalprice <= 60000 and o_custkey + 5 >= 100 and o_custkey <= 300")(lambda t: X.box_overlaps(_boxes(t), _D, [(1000.0, 60000.0), (100.0, 300.0)]).select("o_orderkey"))
query("rtree_circle", "select o_orderkey from (select o_orderkey, 50000.0 - greatest(o_totalprice, least(o_totalprice + 100, 50000.0)) as dx, 500.0 - greatest(o_custkey, least(o_custkey + 5, 500.0)) as dy from orders) where dx * dx + dy * dy <= 4000000")(lambda t: X.box_circle(_boxes(t), _D, [50000.0, 500.0], 2000.0).select("o_orderkey"))


@query("bloom", "select true as all_members, true as few_others")
def bloom(t: Tables) -> DataFrame:
    """Every member is found, and of the other words no more than three times the rate asked for."""
    words = t.part.select("p_partkey", F.concat_ws("-", "p_brand", C("p_partkey").cast("string")).alias("word"))
    n = 200_000
    hit = B.bloom_contains(B.bloom_build(words.where("p_partkey % 2 = 0"), "word", n), words, "word", n)
    count = lambda d, what: d.where(what).agg(F.count("*").alias("n"))
    found, there, wrong, other = count(hit, "p_partkey % 2 = 0"), count(words, "p_partkey % 2 = 0"), count(hit, "p_partkey % 2 = 1"), count(words, "p_partkey % 2 = 1")
    row = found.toDF("a").crossJoin(there.toDF("b")).crossJoin(wrong.toDF("c")).crossJoin(other.toDF("d"))  # four counts
    return row.select((C("a") == C("b")).alias("all_members"), (C("c") <= 0.03 * C("d") + 3).alias("few_others"))


query("rtree_custom", "select o_orderkey from orders where o_totalprice + 100 - o_custkey > 50000 and (o_custkey + 5) * 100 < o_totalprice")(lambda t: X.box_custom(_boxes(t), _D, lambda x, y: (x[1] - y[0] > 50000) & (y[1] * 100 < x[0])).select("o_orderkey"))


@query("spellfix")
def spellfix(t: Tables) -> DataFrame:
    vocabulary = t.nation.select(F.lower("n_name").alias("word"), F.lit(0).cast("long").alias("rank"))
    return B.spell(vocabulary, t.nation.select(F.regexp_replace(F.lower("n_name"), "(.)(.)$", "$2$1").alias("word")), scope=3)
