"""Operators over whole relations: series, closure, pivot, statements, upserts and change sets."""

from __future__ import annotations

import functools
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def series(spark: SparkSession, start: int, stop: int, step: int = 1) -> DataFrame:
    """start, start + step, .. up to stop, as `value`; a step of the wrong sign gives nothing, 0 is an error."""
    if step == 0:
        raise ValueError("series: step is 0")
    n = max(0, (stop - start) // step + 1)
    return spark.range(n).select((F.lit(start).cast("long") + F.col("id") * F.lit(step)).alias("value"))


def _written(df: DataFrame) -> DataFrame:
    """`df` cut off from its lineage: in the session's checkpoint folder, or cached where there is none."""
    spark = df.sparkSession
    at = spark.conf.get("spark.checkpoint.dir", None)
    if not at:
        return df.cache()
    path = f"{at.rstrip('/')}/lodestone/closure-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def closure(edges: DataFrame, roots: DataFrame, id_col: str, parent_col: str, max_depth: int | None = None, exact_depth: int | None = None, reverse: bool = False) -> DataFrame:
    """(root, id, depth): what hangs below each root, with its shortest depth; the root itself at 0.

    Breadth-first by frontier joins against what has been visited, so cycles end.
    `reverse` follows parents instead of children. Stops at `max_depth`;
    `exact_depth` wins over it and keeps that depth alone.
    """
    a, b = (id_col, parent_col) if reverse else (parent_col, id_col)
    e = edges.select(F.col(a).alias("_from"), F.col(b).alias("_to")).where("_from is not null and _to is not null").distinct()
    e = _written(e)
    seen = _written(roots.toDF("root").distinct().select("root", F.col("root").alias("id"), F.lit(0).cast("long").alias("depth")))
    frontier, depth, limit = seen, 0, exact_depth if exact_depth is not None else max_depth
    levels = [seen]
    while limit is None or depth < limit:
        depth += 1
        step = frontier.join(e, frontier.id == e["_from"]).select("root", F.col("_to").alias("id")).distinct()
        visited = functools.reduce(DataFrame.union, levels).select("root", "id")
        frontier = _written(step.join(visited, ["root", "id"], "left_anti").withColumn("depth", F.lit(depth).cast("long")))
        if frontier.isEmpty():
            break
        levels.append(frontier)
    out = functools.reduce(DataFrame.union, levels)
    return out.where(F.col("depth") == exact_depth) if exact_depth is not None else out


def recursive_union(base: DataFrame, step, most: int = 1000) -> DataFrame:
    """WITH RECURSIVE base UNION step(new rows): rows are kept once; ends when nothing is new."""
    frontier = _written(base.distinct())
    levels = [frontier]
    for _ in range(most):
        made = step(frontier).distinct()
        seen = functools.reduce(DataFrame.union, levels)  # written levels only, so plans grow by a scan each
        frontier = _written(made.join(seen, [made[c].eqNullSafe(seen[c]) for c in seen.columns], "left_anti"))
        if frontier.isEmpty():
            return functools.reduce(DataFrame.union, levels)
        levels.append(frontier)
    raise RuntimeError("recursive_union: no end")


def pivot(rows: DataFrame, keys: list[str], names: str, values: list, cell: Column) -> DataFrame:
    """One column per value of `names`; empty cells are NULL."""
    if not values:
        raise ValueError("pivot: no columns")
    return rows.groupBy(*keys).pivot(names, values).agg(cell)


def statement(spark: SparkSession, sql: str, **args) -> DataFrame:
    """A parametrised view: SQL with :name parameters, each of which must be given."""
    return spark.sql(sql, args=args)


def eval_sql(spark: SparkSession, sql: str, sep: str = "") -> str | None:
    """All cells of a small result, row by row, joined; NULL is ''; no rows give None."""
    rows = spark.sql(sql).collect()
    return sep.join("" if v is None else str(v) for r in rows for v in r) if rows else None


def upsert(target: DataFrame, source: DataFrame, keys: list[str], update: dict[str, Column] | None, where: Column | None = None) -> DataFrame:
    """INSERT .. ON CONFLICT: `update` maps columns to expressions over `old` and `new`; None does nothing on conflict."""
    t, s = target.alias("old"), source.dropDuplicates(keys).alias("new")
    on = functools.reduce(lambda a, b: a & b, [F.col(f"old.{k}") == F.col(f"new.{k}") for k in keys])
    j = t.join(s, on, "full_outer")
    is_old, both = F.col(f"old.{keys[0]}").isNotNull(), F.col(f"old.{keys[0]}").isNotNull() & F.col(f"new.{keys[0]}").isNotNull()
    change = both & where if where is not None else both
    out = []
    for c in target.columns:
        kept = F.when(is_old, F.col(f"old.{c}")).otherwise(F.col(f"new.{c}"))
        out.append((F.when(change, update[c]).otherwise(kept) if update and c in update else kept).alias(c))
    return j.select(*out)


def diff(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """The change set that turns `old` into `new`: op (insert, update, delete), keys, old and new as structs."""
    rest = [c for c in old.columns if c not in keys]
    o, n = (d.select(*keys, F.struct(*rest).alias(name)) for d, name in ((old, "old"), (new, "new")))
    j = o.join(n, keys, "full_outer")
    same = functools.reduce(lambda a, b: a & b, [F.col(f"old.{c}").eqNullSafe(F.col(f"new.{c}")) for c in rest], F.lit(True))
    op = F.when(F.col("old").isNull(), "insert").when(F.col("new").isNull(), "delete").when(~same, "update")
    return j.withColumn("op", op).where("op is not null").select("op", *keys, "old", "new")


def invert(changes: DataFrame) -> DataFrame:
    """The change set that undoes `changes`."""
    op = F.when(F.col("op") == "insert", "delete").when(F.col("op") == "delete", "insert").otherwise("update")
    keys = [c for c in changes.columns if c not in ("op", "old", "new")]
    return changes.select(op.alias("op"), *keys, F.col("new").alias("old"), F.col("old").alias("new"))


def apply_changes(table: DataFrame, changes: DataFrame, keys: list[str], conflict: str = "abort") -> DataFrame:
    """`table` after `changes`. A change conflicts if the row isn't as its old side says.

    omit leaves the row, replace takes the new side all the same, abort is an error.
    """
    rest = [c for c in table.columns if c not in keys]
    t = table.select(*keys, F.struct(*rest).alias("_row"))
    j = t.join(changes.select("op", *keys, "old", "new"), keys, "full_outer")
    as_said = functools.reduce(lambda a, b: a & b, [F.col(f"_row.{c}").eqNullSafe(F.col(f"old.{c}")) for c in rest], F.lit(True))
    fits = F.when(F.col("op") == "insert", F.col("_row").isNull()).otherwise(F.col("_row").isNotNull() & as_said)
    after = F.when(F.col("op") == "delete", F.lit(None)).otherwise(F.col("new"))
    wrong = {"omit": F.col("_row"), "replace": after, "abort": F.when(F.raise_error(F.lit("change conflicts")).isNull(), after)}[conflict]
    row = F.when(F.col("op").isNull(), F.col("_row")).when(fits, after).otherwise(wrong)
    j = j.select(*keys, row.alias("_row")).where("_row is not null")
    return j.select(*[F.col(c) if c in keys else F.col(f"_row.{c}").alias(c) for c in table.columns])


def concat_changes(first: DataFrame, second: DataFrame, keys: list[str]) -> DataFrame:
    """One change set for two in turn."""
    a = first.select(*keys, F.col("op").alias("_a"), F.col("old").alias("_ao"), F.col("new").alias("_an"))
    b = second.select(*keys, F.col("op").alias("_b"), F.col("old").alias("_bo"), F.col("new").alias("_bn"))
    j = a.join(b, keys, "full_outer")
    had = F.when(F.col("_a").isNotNull(), F.col("_a") != "insert").otherwise(F.col("_b") != "insert")
    has = F.when(F.col("_b").isNotNull(), F.col("_b") != "delete").otherwise(F.col("_a") != "delete")
    op = F.when(had & has, "update").when(had, "delete").when(has, "insert")
    old = F.when(F.col("_a").isNotNull(), F.col("_ao")).otherwise(F.col("_bo"))
    new = F.when(F.col("_b").isNotNull(), F.col("_bn")).otherwise(F.col("_an"))
    return j.select(op.alias("op"), *keys, old.alias("old"), new.alias("new")).where("op is not null")
