"""User functions by name for SQL: scalar, aggregate and window ones, sort keys, and the library's own."""

from __future__ import annotations

import inspect
from collections.abc import Callable

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.functions import ArrowUDFType

from . import arrow


def _type(kind: str | T.DataType) -> T.DataType:
    return kind if isinstance(kind, T.DataType) else T.DataType.fromDDL(kind)


def register_function(spark: SparkSession, name: str, f: Callable, returns: str | T.DataType, pure: bool = True):
    """A scalar function of one row, in Arrow batches. `pure` ones may be folded and reordered."""
    made = F.udf(f, _type(returns), useArrow=True)
    return spark.udf.register(name, made if pure else made.asNondeterministic())


def _grouped(make: Callable, finish: str, returns: str | T.DataType):
    """A grouped Arrow function that steps a state through the rows it is given, NULL as None; a part of them at a time is Python's."""

    def over(*columns: pa.Array):
        state = make()
        for low in range(0, len(columns[0]), 4096):
            for row in zip(*[c.slice(low, 4096).to_pylist() for c in columns], strict=True):
                state.step(*row)
        return getattr(state, finish)()

    forms = {1: lambda a: over(a), 2: lambda a, b: over(a, b), 3: lambda a, b, c: over(a, b, c)}
    n = len(inspect.signature(make().step).parameters)
    if n not in forms:
        raise ValueError("step takes one to three values")
    call = forms[n]
    return F.arrow_udf(call, _type(returns), ArrowUDFType.GROUPED_AGG)


def aggregate_in_parts(df: DataFrame, by: str, value: str, part: Callable, whole: Callable, returns: str, name: str) -> DataFrame:
    """A grouped aggregate of one's own that needs no group in one task.

    `part` makes of a batch's values of a group the few that stand for them, before
    the shuffle; `whole` makes the result of all of those (None if there are none).
    """
    kinds = {c: df.schema[c].dataType for c in (by, value)}

    def parts(batches):
        for b in batches:
            rows = [(k, x) for k, v in b.groupby(by, dropna=False)[value] for x in part(v)]
            yield pd.DataFrame({by: pd.Series([None if pd.isna(k) else k for k, _ in rows], dtype=object), value: [x for _, x in rows]})

    def done(v: pd.Series) -> object:
        return whole(v)

    few = df.select(by, value).mapInPandas(parts, T.StructType([T.StructField(c, t) for c, t in kinds.items()]))
    made = F.pandas_udf(done, _type(returns), F.PandasUDFType.GROUPED_AGG)
    return few.groupBy(by).agg(made(F.col(value)).alias(name))


def register_aggregate(spark: SparkSession, name: str, make: Callable, returns: str | T.DataType):
    """An aggregate from a class with step(value, ..) and done(); in SQL also a window function over any frame.

    A group's values meet in one task: built-in aggregates are for large groups.
    """
    return spark.udf.register(name, _grouped(make, "done", returns))


def register_window(spark: SparkSession, name: str, make: Callable, returns: str | T.DataType):
    """A window function from a class with step(..), inverse(..) and value().

    Each row's frame is given whole and stepped through; inverse, which takes a row
    out again, is for engines that slide.
    """
    return spark.udf.register(name, _grouped(make, "value", returns))


def order_by_key(df: DataFrame, column: str, key: Callable[[str], object], returns: str = "string", ascending: bool = True, then: list[str] | None = None) -> DataFrame:
    """Rows ordered by a collation of one's own: a function that gives each text its sort key."""
    made = F.udf(lambda s: None if s is None else key(s), _type(returns), useArrow=True)(F.col(column))
    return df.orderBy(made.asc_nulls_first() if ascending else made.desc_nulls_last(), *(then or []))


def collated(c: Column, locale: str) -> Column:
    """A text that compares and sorts as a language's rules say, such as sv or de_CI_AI."""
    return F.collate(c, locale)


#: name in SQL -> function of the library
LIBRARY = {
    "damerau_levenshtein": arrow.damerau_levenshtein, "jaro": arrow.jaro, "jaro_winkler": arrow.jaro_winkler, "casefold": arrow.casefold, "unaccent": arrow.unaccent, "normalize": arrow.normalize,
    "encode_as": arrow.encode, "decode_as": arrow.decode, "digest": arrow.digest, "xxh64": arrow.xxh64, "uuid3": arrow.uuid3, "uuid5": arrow.uuid5, "uuid2": arrow.uuid2, "ipcontains": arrow.ipcontains,
    "ipoverlaps": arrow.ipoverlaps, "iphost": arrow.iphost, "ipnetwork": arrow.ipnetwork, "decimal_add": arrow.decimal_add, "decimal_sub": arrow.decimal_sub, "decimal_mul": arrow.decimal_mul,
    "decimal_div": arrow.decimal_div, "decimal_round": arrow.decimal_round, "money_mul": arrow.money_mul,
}


def register_all(spark: SparkSession) -> list[str]:
    """Makes the library's functions known to the session's SQL; gives their names."""
    for name, f in LIBRARY.items():
        spark.udf.register(name, f)
    for name, args, returns, body in (
        ("time_now", "", "string", "date_format(to_utc_timestamp(current_timestamp(), current_timezone()), \"yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'\")"),
        ("time_unix", "t timestamp", "bigint", "unix_seconds(t)"),
        ("time_from_unix", "n bigint", "string", "date_format(to_utc_timestamp(timestamp_seconds(n), current_timezone()), \"yyyy-MM-dd'T'HH:mm:ss'Z'\")"),
        ("money_add", "a string, b string", "string", "cast(round(cast(a as decimal(38,6)) + cast(b as decimal(38,6)), 2) as decimal(36,2))"),
        ("money_sub", "a string, b string", "string", "cast(round(cast(a as decimal(38,6)) - cast(b as decimal(38,6)), 2) as decimal(36,2))"),
        ("like_unicode", "s string, p string", "boolean", "s ilike p"),
    ):
        spark.sql(f"create or replace temporary function {name}({args}) returns {returns} return {body}")
    return [*LIBRARY, "time_now", "time_unix", "time_from_unix", "money_add", "money_sub", "like_unicode"]
