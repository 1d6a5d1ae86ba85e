"""What only larger tables than the smallest, or odd ones, bring out."""

import random

import duckdb
import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.parquet as pq

from lodestone import catalog
from lodestone.functions import arrow
from lodestone.operators import search, vector


def same_as_sql(spark, folder, key, table, data):
    """A query over a table written to `folder` gives what its SQL gives."""
    pq.write_table(pa.table(data), f"{folder}/{table}.parquet")
    con = duckdb.connect()
    con.execute(f"create view {table} as select * from '{folder}/{table}.parquet'")
    want = con.execute(catalog.ORACLES[key])
    names = [d[0] for d in want.description]
    got = [tuple(r) for r in catalog.QUERIES[key](spark, str(folder)).select(*names).collect()]
    assert sorted(got, key=repr) == sorted(want.fetchall(), key=repr)
    return got


def test_zorder_of_keys_beyond_16_bits(spark, tmp_path):
    same_as_sql(spark, tmp_path, "zorder", "customer", {"c_custkey": pa.array([1, 65535, 65536, 899_999]), "c_nationkey": pa.array([3, 24, 5, 0], pa.int32())})


def test_searches_make_terms_once(spark, tmp_path):
    """Not once more for every place of a term, and trigrams not of texts without the phrase."""
    texts = ["an idiot the one", "the way of the idiot, an", "the\nidiot a b c the", None, "", "xation.\n", "with a or b from", "or or or with with"]
    pq.write_table(pa.table({"doc_id": range(len(texts)), "text": texts}), f"{tmp_path}/documents.parquet")
    for key in ("fts_near", "fts_near_many", "fts_phrase", "fts_substring"):
        plan = catalog.QUERIES[key](spark, str(tmp_path))._jdf.queryExecution().optimizedPlan().toString()
        assert plan.count("split(") == 1, plan
    assert "Contains(lower(text" in plan
    plan = catalog.QUERIES["fts_porter"](spark, str(tmp_path))._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("split(") == 1 and plan.count("ArrowEvalPython") == 1, plan


def test_near_against_brute_force(spark):
    rng = random.Random(5)
    texts = [" ".join(rng.choice("a b c x y z w v".split()) for _ in range(rng.randrange(40))) for _ in range(60)]
    ix = search.index(spark.createDataFrame(list(enumerate(texts)), "key long, value string"), "key", ["value"])
    for distance, *phrases in ((2, "a", "b"), (1, "a b", "c"), (3, "a", "b", "c"), (1, "a", "a b", "x"), (2, "a", "a")):
        def near(words):
            at = [[i for i in range(len(words)) if words[i : i + len(p.split())] == p.split()] for p in phrases]
            return any(all(any(s <= q <= s + len(p.split()) + distance for q in at[k]) for k in range(len(at)) if k != j) for j, p in enumerate(phrases) for s in at[j])

        assert {r.doc for r in search.Near(distance, *phrases).docs(ix).collect()} == {i for i, t in enumerate(texts) if near(t.split())}


def test_knn_batch_takes_any_number_of_queries(spark):
    rng = np.random.default_rng(3)
    v, q = rng.integers(0, 6, (40, 3)).astype(float), rng.integers(0, 6, (10_001, 3)).astype(float)
    df = spark.createDataFrame(pd.DataFrame({"key": range(40), "v": v.tolist()}))
    out = vector.knn_batch(df, "v", "key", spark.createDataFrame(pd.DataFrame({"query_id": range(len(q)), "query": q.tolist()})), 4).toPandas().sort_values(["query_id", "rank"])
    d = np.sqrt(((q[:, None] - v) ** 2).sum(2))
    near = np.argsort(d, axis=1, kind="stable")[:, :4]
    assert out.key.tolist() == near.ravel().tolist() and out.distance.tolist() == np.take_along_axis(d, near, 1).ravel().tolist()


def test_udaf_shuffles_ends_only(spark, tmp_path):
    data = {"l_returnflag": ["A", "N", None, "A", "N", None, "R"], "l_quantity": pa.array([1.0, 5.0, 2.0, 7.0, None, 2.5, None])}
    same_as_sql(spark, tmp_path, "udaf", "lineitem", data)
    assert "MapInPandas" in catalog.QUERIES["udaf"](spark, str(tmp_path))._jdf.queryExecution().optimizedPlan().toString()


def test_register_window_with_nulls(spark, tmp_path):
    n = 12
    data = {"o_orderkey": range(n), "o_custkey": [i % 2 for i in range(n)], "o_totalprice": pa.array([None if i % 5 < 3 else i + 0.5 for i in range(n)]), "o_orderdate": range(n), "o_orderstatus": ["F"] * n}
    same_as_sql(spark, tmp_path, "register_window", "orders", data)


def test_text_functions_take_parts_of_batches():
    texts = ["é" * (i % 7) + "a" for i in range(1000)] + [None]
    out = arrow.unaccent.func(pa.array(texts))
    assert out.to_pylist() == ["e" * (i % 7) + "a" for i in range(1000)] + [None]
