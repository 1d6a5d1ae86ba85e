"""Near-duplicate joins and components against brute force."""

import itertools
import random

import duckdb
import numpy as np
import pytest

from lodestone.llm import components, jaccard, metricjoin, queries


class Sets:
    def __init__(self, ids):
        self.up = {i: i for i in ids}

    def find(self, i):
        while self.up[i] != i:
            i = self.up[i]
        return i

    def join(self, a, b):
        a, b = self.find(a), self.find(b)
        self.up[max(a, b)] = min(a, b)


def test_components(spark):
    rng = random.Random(1)
    edges = [(i, i + 1) for i in range(0, 60)] + [(1000, 1000 + i) for i in range(1, 300)] + [(rng.randint(2000, 2300), rng.randint(2000, 2300)) for _ in range(200)] + [(7, 7), (5, 4), (5, 4)]
    s = Sets({i for e in edges for i in e})
    for a, b in edges:
        s.join(a, b)
    df = spark.createDataFrame([*edges, (None, 3)], "a long, b long")
    got = {r.id: r.component for r in components.components(df).collect()}
    assert got == {i: s.find(i) for e in edges if e[0] != e[1] for i in e}
    assert components.components(spark.createDataFrame([], "a long, b long")).count() == 0


def shingle_set(t, k=5):
    import re

    w = re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in t or ""))
    return frozenset([tuple(w)] if 0 < len(w) < k else [tuple(w[i : i + k]) for i in range(len(w) - k + 1)])


def brute_jaccard(rows):
    sets = [(i, shingle_set(t)) for i, t in rows if i is not None]
    s = Sets({i for i, _ in sets})
    for (a, x), (b, y) in itertools.combinations(sets, 2):
        if x and y and 100 * len(x & y) >= 75 * len(x | y):
            s.join(a, b)
    return sorted((str(i), len(shingle_set(t)), str(None if i is None else s.find(i))) for i, t in rows)


def run_jaccard(spark, rows, **options):
    df = spark.createDataFrame([(i, t, 5, "x") for i, t in rows], "doc_id long, text string, n int, head string").repartition(4)
    sig = jaccard.table(jaccard.signatures(df, "doc_id", "text", 5, 75), "t")
    if options:
        edges = jaccard.linked(sig, 75, **options)
        found = {r.id: r.component for r in components.components(edges).collect()}
        return sorted((str(r.id), r.n, str(found.get(r.id, r.id))) for r in sig.collect())
    return sorted((str(r.doc_id), r.n_shingles, str(r.component_id)) for r in jaccard.near_duplicates(df).collect())


def edited(rng, words, n):
    w = list(words)
    for _ in range(n):
        w[rng.randrange(len(w))] = f"e{rng.randrange(10**6)}"
    return w


def corpus():
    rng, rows, i = random.Random(2), [], 0
    passage = [f"p{j}" for j in range(60)]
    for _ in range(25):
        base = [f"w{rng.randrange(5000)}" for _ in range(rng.randint(3, 150))]
        for _ in range(rng.randint(1, 7)):
            w = edited(rng, base, rng.randint(0, 1 + len(base) // 30))
            if rng.random() < 0.4:
                w = w + passage
            rows.append((i, " ".join(w)))
            i += 1
    hot = [f"h{j}" for j in range(90)]
    rows += [(i + j, " ".join(edited(rng, hot, rng.randint(0, 3)))) for j in range(120)]
    rows += [(9000, None), (9001, ""), (9002, " \n"), (9003, "One two THREE"), (9004, "one\ttwo three"), (9005, "é É x y"), (9006, "É é x y"), (None, "one two three"), (None, "one two three"), (3, rows[3][1]), (4, "quite another text under a known id")]
    rows += [(9010, " ".join(f"l{j}" for j in range(40_000))), (9011, " ".join(f"l{j}" for j in range(39_000)))]
    rng.shuffle(rows)
    return rows


def test_jaccard_join(spark):
    rows = corpus()
    want = brute_jaccard(rows)
    assert run_jaccard(spark, rows) == want
    assert run_jaccard(spark, rows, block_bytes=9_000) == want
    assert run_jaccard(spark, []) == []


def test_jaccard_join_on_documents(spark):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text").collect()]
    assert run_jaccard(spark, rows) == brute_jaccard(rows)


def brute_metric(rows, cosine=0.98):
    ok = [(i, label, np.array(v, float)) for i, v, label in rows if i is not None and label is not None and v and all(x is not None and np.isfinite(x) for x in v) and any(v)]
    links, s = {}, Sets({r[0] for r in rows if r[0] is not None})
    for (i, li, x), (j, lj, y) in itertools.combinations(ok, 2):
        if li == lj and len(x) == len(y) and x @ y / np.sqrt((x @ x) * (y @ y)) >= cosine:
            links[i] = links.get(i, 0) + 1
            links[j] = links.get(j, 0) + 1
            s.join(i, j)
    return sorted((str(i), links.get(i, 0), str(c := None if i is None else s.find(i)), c == i) for i, _, _ in rows)


def vectors():
    rng = np.random.default_rng(3)
    rows, i = [], 0
    for label in (0, 1, 2):
        for _ in range(20):
            c = rng.normal(size=16)
            for _ in range(rng.integers(1, 6)):
                rows.append((i, [float(np.float32(x)) for x in c + rng.normal(size=16) * rng.choice([0.0, 0.1, 0.2, 0.3])], label))
                i += 1
    hot = rng.normal(size=16)
    rows += [(500 + j, [float(np.float32(x)) for x in hot + rng.normal(size=16) * 0.12], 1) for j in range(150)]
    rows += [(700 + j, [float(np.float32(x)) for x in hot], 1) for j in range(20)]
    rows += [(800, None, 1), (801, [0.0] * 16, 1), (802, [None] * 16, 1), (803, [float("nan")] * 16, 1), (804, [float("inf")] * 16, 1), (805, rows[0][1], None), (806, [], 0), (None, rows[0][1], 0), (807, [1.0, 2.0], 0), (808, [2.0, 4.0], 0), (809, [3.0e38] * 16, 2), (810, [1e-30] * 16, 2)]
    return rows


def test_metric_join(spark):
    rows = vectors()
    df = spark.createDataFrame([(i, v, label, "a", 1) for i, v, label in rows], "vec_id long, embedding array<float>, label int, rep string, n int")
    want = brute_metric([(r.vec_id, r.embedding, r.label) for r in df.collect()])
    for options in ({}, {"cell_rows": 20, "block": 30}, {"cell_rows": 5}):
        got = metricjoin.near_duplicates(df, **options).collect()
        assert sorted((str(r.vec_id), r.n_links, str(r.component_id), r.kept) for r in got) == want
    assert metricjoin.near_duplicates(df.limit(0)).count() == 0


def test_metric_join_on_embeddings(spark, sf):
    df = spark.read.parquet(f"{sf}/embeddings.parquet")
    want = brute_metric([(r.vec_id, r.embedding, r.label) for r in df.collect()])
    got = metricjoin.near_duplicates(df, cell_rows=50).collect()
    assert sorted((str(r.vec_id), r.n_links, str(r.component_id), r.kept) for r in got) == want


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_queries_against_sql(spark, name):
    sf = "/root/testdata/sf0.01"
    con = duckdb.connect()
    for t in ("documents", "embeddings"):
        con.execute(f"create view {t} as select * from '{sf}/{t}.parquet'")
    want = con.execute(queries.ORACLES[name])
    columns = [c[0] for c in want.description]
    got = queries.QUERIES[name](spark, sf)
    assert got.columns == columns and sorted(map(tuple, got.collect())) == sorted(want.fetchall())
