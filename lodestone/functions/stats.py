"""Statistical aggregates with the edge cases settled: Column in, aggregate Column out."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F



def total(x: Column) -> Column:
    """Sum as a double; 0.0 of nothing."""
    return F.coalesce(F.sum(x.cast("double")), F.lit(0.0))


def skewness_pop(x: Column) -> Column:
    return F.when(F.count(x) > 1, F.skewness(x))


def skewness_samp(x: Column) -> Column:
    n = F.count(x).cast("double")
    return F.when(n > 2, F.skewness(x) * F.sqrt(n * (n - 1)) / F.nullif(n - 2, F.lit(0.0)))


def kurtosis_pop(x: Column) -> Column:
    """Excess."""
    return F.when(F.count(x) > 1, F.kurtosis(x))


def kurtosis_samp(x: Column) -> Column:
    n = F.count(x).cast("double")
    raw = F.kurtosis(x) + 3
    return F.when(n > 3, ((n + 1) * raw + 3 - 3 * n) * (n - 1) / F.nullif((n - 2) * (n - 3), F.lit(0.0)))


def corr(y: Column, x: Column) -> Column:
    """NULL for fewer than two pairs or a constant side."""
    both = x.isNotNull() & y.isNotNull()
    a, b = F.when(both, y.cast("double")), F.when(both, x.cast("double"))
    spread = F.stddev_pop(a) * F.stddev_pop(b)
    return F.when(F.count(F.when(both, 1)) > 1, F.covar_pop(a, b) / F.nullif(spread, F.lit(0.0)))


def regr_r2(y: Column, x: Column) -> Column:
    """NULL for a constant x or a constant y."""
    r = corr(y, x)
    return r * r


def percentile_disc(x: Column, p: float) -> Column:
    """The element at floor(p * (n - 1)) of the sorted values."""
    return F.transform(F.array(F.array_sort(F.collect_list(x))), lambda a: F.when(F.size(a) > 0, F.get(a, F.floor(F.lit(p) * (F.size(a) - 1)).cast("int"))))[0]


def mode(x: Column) -> Column:
    """The most frequent value, the smallest of equals."""
    return F.mode(x, True)


def regr_json(y: Column, x: Column) -> Column:
    """All regression measures as one JSON object."""
    parts = {
        "count": F.regr_count(y, x), "avgy": F.regr_avgy(y, x), "avgx": F.regr_avgx(y, x), "syy": F.regr_syy(y, x), "sxx": F.regr_sxx(y, x),
        "sxy": F.regr_sxy(y, x), "slope": F.regr_slope(y, x), "intercept": F.regr_intercept(y, x), "r2": regr_r2(y, x),
    }
    return F.to_json(F.struct(*[c.alias(k) for k, c in parts.items()]), {"ignoreNullFields": "false"})


def decimal_sum(x: Column, scale: int = 6) -> Column:
    """Exact sum of decimal text within 38 digits, as plain text; '0' of nothing."""
    from .scalar import plain

    return F.coalesce(plain(F.sum(x.cast(f"decimal(28,{scale})"))), F.lit("0"))


def json_group_array(x: Column) -> Column:
    """A JSON array of the values in ascending order."""
    return F.to_json(F.array_sort(F.collect_list(x)))


def json_group_object(k: Column, v: Column) -> Column:
    return F.to_json(F.map_from_entries(F.array_sort(F.collect_list(F.struct(k, v)))))


