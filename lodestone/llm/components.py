"""Connected components of an undirected graph, on the executors."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import table


def components(edges: DataFrame, a: str = "a", b: str = "b", most_rounds: int = 60) -> DataFrame:
    """(id, component): the smallest id reachable from each id that has an edge.

    Alternates two steps that hang every node below its smallest neighbour, then
    shortens what is left, until nothing changes; rounds grow with the logarithm
    of the longest path. Each step is a grouped minimum, which is combined before
    the shuffle, and an equi-join that adaptive execution can split, so that a
    node with very many edges needs no task of its own. Each round is a table in
    the shared folder. Self-loops and repeated edges do no harm; rows with a
    null end are left out; without edges the result is empty.
    """
    e = edges.select(F.col(a).alias("u"), F.col(b).alias("v")).where("u is not null and v is not null and u <> v")
    e = table(e.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "cc")
    for _ in range(most_rounds):
        both = e.union(e.select(F.col("v"), F.col("u"))).toDF("u", "v")
        low = both.groupBy("u").agg(F.min("v").alias("_m")).select("u", F.least("u", "_m").alias("m"))
        # every larger neighbour of u, and u, hangs below the smallest of them
        star = both.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        star = star.union(low.select("u", F.col("m").alias("v"))).where("u <> v").distinct()
        low = star.groupBy("u").agg(F.min("v").alias("m"))
        small = star.join(low, "u")
        small = small.select(F.col("v").alias("u"), F.col("m").alias("v")).union(low.select("u", F.col("m").alias("v"))).where("u <> v").distinct()
        new = table(small.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "cc")
        same = new.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        before = e.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        e = new
        if same == before:
            break
    else:
        raise RuntimeError(f"components did not settle in {most_rounds} rounds")
    labels = e.select(F.col("u").alias("id"), F.col("v").alias("component"))
    return labels.union(e.select(F.col("v").alias("id"), F.col("v").alias("component")).distinct())


class Forest:
    """Which of a block's ids are connected so far; gives the few links that connect more."""

    def __init__(self, ids: np.ndarray):
        self.ids = np.unique(ids)
        self.label = np.arange(len(self.ids))

    def places(self, ids: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.ids, ids)

    def join(self, me, others: np.ndarray) -> list:
        """Link id `me` to the ids at places `others`; returns one of them for each tree that this adds."""
        if not len(others):
            return []
        trees, first = np.unique(self.label[others], return_index=True)
        mine = self.label[np.searchsorted(self.ids, me)]
        new = trees != mine
        if new.any():
            self.label[np.isin(self.label, trees[new])] = mine
        return [self.ids[i] for i in others[first[new]]]
