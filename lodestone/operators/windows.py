"""Window forms that Spark SQL lacks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def groups_frame(df: DataFrame, partition: list[str], order: str, before: int, after: int, agg, out: str) -> DataFrame:
    """agg over the frame GROUPS BETWEEN `before` PRECEDING AND `after` FOLLOWING."""
    w = Window.partitionBy(*partition).orderBy(order)
    g = df.withColumn("_g", F.dense_rank().over(w))
    frame = Window.partitionBy(*partition).orderBy("_g").rangeBetween(-before, after)
    return g.withColumn(out, agg.over(frame)).drop("_g")


def sum_excluding_current(x: Column, w) -> Column:
    """sum(x) OVER (w EXCLUDE CURRENT ROW) for a frame that holds the current row."""
    others = F.count(x).over(w) - x.isNotNull().cast("int")
    return F.when(others > 0, F.sum(x).over(w) - F.coalesce(x, F.lit(0)))


def sum_excluding(df: DataFrame, x: str, partition: list[str], order: list[str], what: str, out: str) -> DataFrame:
    """sum(x) over the whole partition, EXCLUDE CURRENT ROW, GROUP (the row and its peers) or TIES (its peers)."""
    whole, peers = Window.partitionBy(*partition), Window.partitionBy(*partition, *order)
    own, mine = F.col(x).isNotNull().cast("int"), F.coalesce(F.col(x), F.lit(0))
    gone = {"current row": (own, mine), "group": (F.count(x).over(peers), F.coalesce(F.sum(x).over(peers), F.lit(0)))}
    gone["ties"] = (gone["group"][0] - own, gone["group"][1] - mine)
    if what not in gone:
        raise ValueError(f"exclude {what!r} isn't known")
    n, s = gone[what]
    return df.withColumn(out, F.when(F.count(x).over(whole) - n > 0, F.sum(x).over(whole) - s))


def filter_over(agg, condition: Column, x: Column, w) -> Column:
    """agg(x) FILTER (WHERE condition) OVER w."""
    return agg(F.when(condition, x)).over(w)


def sliding_percentile(x: Column, p: float, w) -> Column:
    """Continuous percentile over a frame."""
    def at(a: Column) -> Column:
        pos = F.lit(p) * (F.size(a) - 1)
        lo, hi = F.get(a, F.floor(pos).cast("int")), F.get(a, F.ceil(pos).cast("int"))
        return F.when(F.size(a) > 0, lo + (hi - lo) * (pos - F.floor(pos)))

    return F.transform(F.array(F.array_sort(F.collect_list(x).over(w))), at)[0]
