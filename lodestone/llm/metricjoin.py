"""Embedding near-duplicates by an exact metric range join."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import fresh, ship, table
from .components import Forest, components

_SLACK = 1e-6  # widens the pruning radius against rounding; the test of a pair itself is exact


def _unit(v: np.ndarray) -> np.ndarray:
    return v / np.sqrt((v * v).sum(axis=1, keepdims=True))


def range_links(
    vectors: DataFrame,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
    label_col: str = "label",
    cosine: float = 0.98,
    cell_rows: int = 2000,
    pivot_bytes: int = 32_000_000,
    block: int = 1024,
) -> tuple[DataFrame, DataFrame]:
    """Links between vectors of equal label with a cosine of at least `cosine`, without listing them.

    Equal vectors of a label are one representative with a count. One vector in
    `cell_rows`, chosen by hash, is a pivot, up to `pivot_bytes` of them, which is what
    is broadcast: 62,500 of 64 components, enough for 125 million vectors; beyond
    that cells grow, and with them the number of their blocks. A vector's home cell is that
    of its nearest pivot of its label. It is replicated to another cell only if
    the cell can hold a partner: on unit vectors, `cosine` is a distance of at
    most r = sqrt(2 - 2 * cosine); the triangle inequality asks for
    d(v, p) <= radius(p) + r, and the plane midway between the two pivots for
    (d(v, p)^2 - d(v, home)^2) / (2 d(p, home)) <= r. All partners of a vector
    are then in its home cell. Cells join independently, in blocks of home
    vectors against blocks of all the cell's vectors, so that memory is
    bounded by `block` squared and a hot cell is many tasks.

    Returns (links, edges): per representative `rep` (smallest id of equal
    vectors), n_links (other vectors linked to it, copies counted); and
    edges (a, b) that connect what is linked: per pair of blocks a spanning
    forest, not all pairs.

    Vectors that are null, zero or hold null or non-finite components, and rows
    with null labels or null ids, take no part.
    """
    ship(vectors)
    spark = vectors.sparkSession
    x = F.transform(F.col(vector_col), lambda v: v.cast("double"))
    ok = F.col(id_col).isNotNull() & F.col(label_col).isNotNull() & F.col(vector_col).isNotNull() & (F.size(F.col(vector_col)) > 0)
    ok &= ~F.exists(x, lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf"))) & F.exists(x, lambda v: v != 0)
    text = F.concat_ws(",", F.transform(x, lambda v: (v + 0.0).cast("string")))
    key = F.md5(text.cast("binary"))  # equal vectors share 128 bits; unequal ones don't, but for a chance of 1 in 10^20 among 10^9
    good = vectors.where(ok).select(F.col(id_col).alias("id"), F.col(label_col).cast("string").alias("label"), x.alias("x"), key.alias("k"))
    # norms can over- or underflow in the square; scaling by the largest component is harmless
    top = F.array_max(F.transform(F.col("x"), F.abs))
    good = good.withColumn("x", F.transform("x", lambda v: v / top))
    reps = table(good.groupBy("label", "k").agg(F.min("id").alias("rep"), F.count("*").alias("n"), F.first("x").alias("x")), "metric-reps")

    r = math.sqrt(max(0.0, 2 - 2 * cosine)) + _SLACK
    total = reps.count()
    width = reps.agg(F.max(F.size("x"))).first()[0] or 1
    want = max(1, min(pivot_bytes // (8 * width), total // cell_rows))
    step = max(1, 4_000_000 // want)  # rows whose distances to all pivots are held at once
    chosen = reps.orderBy(F.xxhash64("rep", F.lit(5)), "rep").limit(want).select("label", "x").collect()
    by_label: dict[str, np.ndarray] = {}
    for p in chosen:
        by_label.setdefault(p.label, []).append(p.x)
    pivots = {k: {len(p): _unit(np.array([q for q in v if len(q) == len(p)])) for p in v} for k, v in by_label.items()}
    shared = spark.sparkContext.broadcast(pivots)  # at most `pivot_bytes`

    def distances(label: str, m: np.ndarray) -> tuple[np.ndarray, np.ndarray] | None:
        p = shared.value.get(label, {}).get(m.shape[1])
        if p is None:
            return None
        return np.sqrt(np.maximum(0.0, 2 - 2 * m @ p.T)), p

    def batches(it: Iterator[pd.DataFrame]):
        for df in it:
            for (label, dim), whole in df.groupby(["label", df.x.map(len)], sort=False):
                for i in range(0, len(whole), step):
                    part = whole.iloc[i : i + step]
                    yield label, dim, part, _unit(np.array(part.x.tolist(), np.float64))

    def home(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for label, dim, part, m in batches(it):
            d = distances(label, m)
            at = np.zeros(len(part), int) if d is None else d[0].argmin(axis=1)
            far = np.zeros(len(part)) if d is None else d[0][np.arange(len(part)), at]
            yield pd.DataFrame({"rep": part.rep, "label": label, "dim": dim, "cell": at, "far": far})

    homes = reps.select("rep", "label", "x").mapInPandas(home, "rep long, label string, dim int, cell int, far double")
    sizes = homes.groupBy("label", "dim", "cell").agg(F.max("far").alias("radius"), F.count("*").alias("n"))
    cells = {(c.label, c.dim, c.cell): (c.radius, c.n) for c in sizes.where("label is not null").collect() if c.label in pivots}
    radii = spark.sparkContext.broadcast(cells)  # one entry per pivot at most

    def deal(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for label, dim, part, m in batches(it):
            d = distances(label, m)
            if d is None:
                rows, cols, own = np.arange(len(part)), np.zeros(len(part), int), np.ones(len(part), bool)
            else:
                dist, p = d
                at = dist.argmin(axis=1)
                near = dist[np.arange(len(part)), at]
                between = np.sqrt(np.maximum(0.0, 2 - 2 * p @ p.T))[at]
                radius = np.array([radii.value.get((label, dim, c), (-9.0, 0))[0] for c in range(len(p))])
                with np.errstate(divide="ignore", invalid="ignore"):
                    plane = np.where(between > 1e-9, (dist**2 - near[:, None] ** 2) / (2 * between), 0.0)
                into = (dist <= radius + r) & (plane <= r)
                into[np.arange(len(part)), at] = True
                rows, cols = np.nonzero(into)
                own = cols == at[rows]
            sub = part.iloc[rows]
            yield pd.DataFrame({"rep": sub.rep.values, "label": label, "dim": dim, "cell": cols, "own": own, "n": sub.n.values, "x": list(m[rows])})

    dealt = reps.select("rep", "label", "n", "x").mapInPandas(deal, "rep long, label string, dim int, cell int, own boolean, n long, x array<double>")
    dealt = table(dealt, "metric-cells")
    parts = dealt.groupBy("label", "dim", "cell").agg(F.count("*").alias("_all"), F.sum(F.col("own").cast("long")).alias("_own"))
    n_of = lambda c: F.ceil(F.col(c) / block).cast("int")
    parts = parts.select("label", "dim", "cell", F.greatest(n_of("_own"), F.lit(1)).alias("na"), n_of("_all").alias("nb"))
    d = dealt.join(parts, ["label", "dim", "cell"])
    a, b = F.pmod(F.xxhash64("rep"), F.col("na")).cast("int"), F.pmod(F.xxhash64("rep", F.lit(1)), F.col("nb")).cast("int")
    cols = ["label", "dim", "cell", "rep", "n", "x"]
    left = d.where("own").select(*cols, a.alias("a"), F.explode(F.sequence(F.lit(0), F.col("nb") - 1)).alias("b"), F.lit(True).alias("query"))
    right = d.select(*cols, F.explode(F.sequence(F.lit(0), F.col("na") - 1)).alias("a"), b.alias("b"), F.lit(False).alias("query"))

    def compare(df: pd.DataFrame) -> pd.DataFrame:
        q, t = df[df["query"]], df[~df["query"]]
        out = {"rep": q.rep.to_numpy(), "n_links": np.zeros(len(q), np.int64), "to": q.rep.to_numpy().copy()}
        extra_a, extra_b = [], []
        if len(q) and len(t):
            ids, counts, ours = t.rep.to_numpy(), t.n.to_numpy(), q.rep.to_numpy()
            m, tx = np.array(q.x.tolist()), np.array(t.x.tolist()).T
            forest = Forest(np.concatenate([ours, ids]))
            at = forest.places(ids)
            for lo in range(0, len(q), 512):
                hit = m[lo : lo + 512] @ tx >= cosine
                for k in range(hit.shape[0]):
                    me = ours[lo + k]
                    row = np.flatnonzero(hit[k] & (ids != me))
                    out["n_links"][lo + k] = counts[row].sum()
                    for other in forest.join(me, at[row]):
                        extra_a.append(me)
                        extra_b.append(other)
        rows = pd.DataFrame(out)
        if extra_a:
            rows = pd.concat([rows, pd.DataFrame({"rep": extra_a, "n_links": 0, "to": extra_b})])
        return rows

    found = left.union(right).groupBy("label", "dim", "cell", "a", "b").applyInPandas(compare, "rep long, n_links long, to long")
    found = table(found, "metric-links")
    links = found.groupBy("rep").agg(F.sum("n_links").alias("_l")).join(reps.select("rep", "n"), "rep")
    links = links.select("rep", (F.col("_l") + F.col("n") - 1).alias("n_links"))
    members = good.select("label", "k", "id").join(reps.select("label", "k", "rep"), ["label", "k"]).select("id", "rep")
    return members.join(links, "rep"), found.where("rep <> to").select(F.col("rep").alias("a"), F.col("to").alias("b"))


def near_duplicates(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", cosine: float = 0.98, **options) -> DataFrame:
    """One row per vector: `id_col`, n_links, component_id, kept.

    component_id is the smallest id reachable by links; kept tells whether it is
    the vector's own. Rows that take no part (see `range_links`) have no links
    and are their own component; a null id has a null component and is kept.
    Ids are integers. Repeated ids are vectors of their own that share a row's id: their links
    count each copy. An empty table gives an empty result; other columns are
    ignored.
    """
    members, edges = range_links(vectors, id_col, vector_col, label_col, cosine, **options)
    label = components(edges).withColumnRenamed("id", "rep")
    found = members.join(label, "rep", "left").groupBy("id").agg(F.max("n_links").alias("n_links"), F.min(F.coalesce("component", "rep")).alias("component_id"))
    v, key = vectors.select(F.col(id_col)), fresh(vectors, "_ls_id")
    out = v.join(found.withColumnRenamed("id", key), F.col(id_col) == F.col(key), "left")
    out = out.select(F.col(id_col), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), F.coalesce("component_id", F.col(id_col)).alias("component_id"))
    return out.withColumn("kept", F.col(id_col).eqNullSafe(F.col("component_id")))
