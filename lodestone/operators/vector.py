"""Exact nearest neighbours and vector helpers."""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

BLOCK = 2_048  # vectors, or queries, that meet at a time


def _doubles(v: Column) -> Column:
    return F.transform(v, lambda x: x.cast("double"))


def _sum(v: Column) -> Column:
    return F.aggregate(v, F.lit(0.0), lambda a, x: a + x)


def distance(a: Column, b: Column, metric: str = "l2") -> Column:
    """l2 (Euclidean), cosine (1 - cos; NULL for a zero vector), l1 (also called dot) in doubles; hamming counts bits of binaries."""
    if metric == "hamming":
        byte = lambda v, i: F.conv(F.hex(F.substring(v, i, F.lit(1))), 16, 10).cast("long")
        at = F.sequence(F.lit(1), F.octet_length(a))
        return F.aggregate(at, F.lit(0).cast("long"), lambda acc, i: acc + F.bit_count(byte(a, i).bitwiseXOR(byte(b, i))))
    x, y = _doubles(a), _doubles(b)
    if metric == "l2":
        return F.sqrt(_sum(F.zip_with(x, y, lambda p, q: (p - q) * (p - q))))
    if metric in ("l1", "dot"):
        return _sum(F.zip_with(x, y, lambda p, q: F.abs(p - q)))
    if metric == "cosine":
        dot, nx, ny = _sum(F.zip_with(x, y, lambda p, q: p * q)), _sum(F.transform(x, lambda p: p * p)), _sum(F.transform(y, lambda p: p * p))
        return 1 - dot / F.nullif(F.sqrt(nx) * F.sqrt(ny), F.lit(0.0))
    raise ValueError(f"metric {metric!r} isn't known")


def knn(df: DataFrame, vector: str, key: str, query: list[float], k: int, metric: str = "l2", where: Column | None = None) -> DataFrame:
    """The k rows nearest to `query`, ties by key, with `distance`. `where` filters first. k <= 0 gives nothing."""
    d = df if where is None else df.where(where)
    d = d.where(F.size(vector) == len(query)).withColumn("distance", distance(F.col(vector), F.array(*[F.lit(float(x)) for x in query]), metric))
    return d.orderBy("distance", key).limit(max(0, k))


def knn_batch(df: DataFrame, vector: str, key: str, queries: DataFrame, k: int, metric: str = "l2") -> DataFrame:
    """(query_id, key, distance, rank) for a query set (query_id, query) of any size.

    Queries stand in blocks of about `BLOCK`; each block meets the vectors in batches,
    so a task holds one of either, and keeps the k nearest per query before the shuffle.
    For l2 a matrix product leaves out what is surely further than the kth, and
    distances are `distance`'s own; other metrics are evaluated pair by pair.
    """
    if metric != "l2":
        q = df.select(key, vector).crossJoin(queries.select("query_id", "query"))
        q = q.select("query_id", key, distance(F.col(vector), F.col("query"), metric).alias("distance"), F.spark_partition_id().alias("_p"))
        near = Window.partitionBy("query_id", "_p").orderBy("distance", key)
        q = q.withColumn("_r", F.row_number().over(near)).where(F.col("_r") <= k)
    else:
        q = _nearest(df, vector, key, queries, k)
    w = Window.partitionBy("query_id").orderBy("distance", key)
    return q.withColumn("rank", F.row_number().over(w).cast("long")).where(F.col("rank") <= k).select("query_id", key, "distance", "rank")


def _packed(df: DataFrame, ident: str, vector: str, rows: int) -> DataFrame:
    """(ids, vecs): blocks of up to `rows` rows of a partition whose vectors are there."""
    at = F.floor(F.monotonically_increasing_id() / rows)  # starts anew in each partition, whose number is in the upper bits
    return df.select(F.col(ident).alias("id"), F.transform(vector, lambda x: x.cast("double")).alias("v")).where(F.col("v").isNotNull()).select("id", "v", at.alias("_b")).groupBy("_b").agg(F.collect_list(F.struct("id", "v")).alias("rows")).select("rows.id", F.col("rows.v").alias("v")).toDF("ids", "vecs")


def _nearest(df: DataFrame, vector: str, key: str, queries: DataFrame, k: int) -> DataFrame:
    """(query_id, key, distance): at least the k nearest of each query among all rows of `df`, from each pair of blocks its k nearest."""
    kinds = df.select(key).schema[0].dataType.simpleString(), queries.select("query_id").schema[0].dataType.simpleString()
    pairs = _packed(df, key, vector, BLOCK).crossJoin(_packed(queries, "query_id", "query", BLOCK).toDF("qids", "qvecs"))

    def near(ids: list, vecs: np.ndarray, qids: list, qvecs: np.ndarray):
        order = np.array(sorted(range(len(ids)), key=ids.__getitem__), int)  # ties by key
        vecs, keep = vecs[order], min(k, len(ids))
        norms, qnorms = (vecs * vecs).sum(1), (qvecs * qvecs).sum(1)
        slack = 1e-9 * (norms.max(initial=0.0) + qnorms)
        for low in range(0, len(qids), 256):
            part = qvecs[low : low + 256]
            rough = qnorms[low : low + 256, None] + norms - 2 * (part @ vecs.T)
            bound = np.partition(rough, keep - 1, axis=1)[:, keep - 1] + slack[low : low + 256]
            for i in range(len(part)):
                some = np.flatnonzero(~(rough[i] > bound[i]))
                total = np.zeros(len(some))
                for c in ((vecs[some] - part[i]) ** 2).T:  # added up in the order of `distance`
                    total += c
                d = np.sqrt(total)
                for j in np.argsort(d, kind="stable")[:keep]:
                    yield qids[low + i], ids[order[some[j]]], float(d[j])

    def met(batches):
        for b in batches:
            for r in range(b.num_rows):  # a pair of blocks at a time
                ids, qids = b.column(0)[r].as_py(), b.column(2)[r].as_py()
                split = [x[r].values for x in (b.column(1), b.column(3))]
                sizes = [np.diff(x.offsets.to_numpy()) for x in split]
                flat = [x.flatten().to_numpy(zero_copy_only=False) for x in split]
                out = []
                for n in np.intersect1d(*sizes):  # vectors of different sizes have no distance
                    got = []
                    for part, f, names in zip(sizes, flat, (ids, qids), strict=True):
                        where = np.flatnonzero(part == n)
                        starts = np.concatenate([[0], np.cumsum(part)])[where]
                        got += [[names[i] for i in where], f[starts[:, None] + np.arange(n)]]
                    out += near(*got)
                if out and k > 0:
                    q, i, d = zip(*out, strict=True)
                    yield pa.record_batch([pa.array(q, b.schema.field(2).type.value_type), pa.array(i, b.schema.field(0).type.value_type), pa.array(d, pa.float64())], ["query_id", key, "distance"])

    return pairs.mapInArrow(met, f"query_id {kinds[1]}, `{key}` {kinds[0]}, distance double")


def knn_by_partition(df: DataFrame, vector: str, key: str, partition: str, query: list[float], k: int, metric: str = "l2") -> DataFrame:
    """The k rows nearest to `query` of each value of a partition column, with `distance`; each scan task sends its k nearest a value."""
    d = df.where(F.size(vector) == len(query)).withColumn("distance", distance(F.col(vector), F.array(*[F.lit(float(x)) for x in query]), metric)).withColumn("_p", F.spark_partition_id())
    for by in (["_p", partition], [partition]):
        d = d.withColumn("_r", F.row_number().over(Window.partitionBy(*by).orderBy("distance", key))).where(F.col("_r") <= k)
    return d.drop("_r", "_p")


def normalize(v: Column) -> Column:
    """Unit length."""
    n = F.sqrt(_sum(F.transform(_doubles(v), lambda x: x * x)))
    return F.transform(_doubles(v), lambda x: x / F.nullif(n, F.lit(0.0)))


def quantize_int8(v: Column, low: float = -1.0, high: float = 1.0) -> Column:
    """Steps of (high - low) / 255 from -128; values outside saturate."""
    step = (high - low) / 255
    return F.transform(_doubles(v), lambda x: F.greatest(F.lit(-128), F.least(F.lit(127), F.floor((x - low) / step + 0.5).cast("int") - 128)))


def quantize_binary(v: Column) -> Column:
    """One bit per component, set if it is above 0; the first component is the lowest bit of the first byte."""
    n = F.ceil(F.size(v) / 8).cast("int")
    byte = lambda i: F.aggregate(F.sequence(F.lit(0), F.lit(7)), F.lit(0), lambda acc, b: acc + F.when(F.get(v, i * 8 + b) > 0, F.call_function("shiftleft", F.lit(1), b)).otherwise(0))
    return F.unhex(F.array_join(F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.lpad(F.hex(byte(i)), 2, "0")), ""))


def vec_slice(v: Column, start: int, end: int) -> Column:
    """Components [start, end)."""
    return F.slice(v, start + 1, end - start)


def from_json(text: Column) -> Column:
    """A vector from a JSON array."""
    return F.from_json(text, "array<float>")


def to_json(v: Column) -> Column:
    return F.to_json(v)


def vec_add(a: Column, b: Column) -> Column:
    return F.zip_with(_doubles(a), _doubles(b), lambda x, y: x + y)


def vec_sub(a: Column, b: Column) -> Column:
    return F.zip_with(_doubles(a), _doubles(b), lambda x, y: x - y)


def to_f32_blob(v: Column) -> Column:
    """Little-endian float32, as used by binary encodings."""

    def pack(batch: pd.Series) -> pd.Series:
        return batch.map(lambda x: None if x is None else np.asarray(x, "<f4").tobytes())

    return F.pandas_udf(pack, "binary")(v)


def from_f32_blob(b: Column) -> Column:
    """A vector from little-endian float32."""

    def unpack(batch: pd.Series) -> pd.Series:
        return batch.map(lambda x: None if x is None else np.frombuffer(x, "<f4"))

    return F.pandas_udf(unpack, "array<float>")(b)


def encode(v: Column, encoding: str = "json") -> Column:
    """A vector as json, binary, int8 or bit."""
    made = {"json": to_json, "binary": to_f32_blob, "int8": quantize_int8, "bit": quantize_binary}
    if encoding.lower() not in made:
        raise ValueError(f"encoding {encoding!r} isn't known")
    return made[encoding.lower()](v)


def knn_joined(df: DataFrame, vector: str, key: str, query: list[float], k: int, metric: str = "l2", where: Column | None = None, join: tuple[DataFrame, str] | None = None, select: list[str] | None = None, order: list[str] | None = None) -> DataFrame:
    """The k nearest (see `knn`) with columns of another table on its key, some columns only, in another order."""
    d = knn(df, vector, key, query, k, metric, where)
    if join is not None:
        other, on = join
        d = d.join(other, d[key] == other[on])
    d = d.orderBy(*order) if order else d
    return d.select(*select) if select else d
