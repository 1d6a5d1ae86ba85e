"""How queries are registered: SQL over the tables by name, or functions of the tables."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


class Tables:
    """The tables of a folder, read when asked for: t.orders, t["orders"]."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir

    def __getattr__(self, name: str) -> DataFrame:
        if name not in TABLES:
            raise AttributeError(name)
        return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")

    __getitem__ = __getattr__


def sql(key: str, text: str, oracle: str | None = None) -> None:
    """A query in SQL both engines share, or with DuckDB's own text; tables stand by name."""
    used = [t for t in TABLES if re.search(rf"\b{t}\b", text)]

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        t = Tables(spark, sf_dir)
        for name in used:
            t[name].createOrReplaceTempView(name)
        return spark.sql(text)

    QUERIES[key] = run
    ORACLES[key] = oracle or text


def query(key: str, oracle: str | None = None):
    """Registers f(t), t giving the tables and the session."""

    def add(f: Callable[[Tables], DataFrame]):
        QUERIES[key] = lambda spark, sf_dir: f(Tables(spark, sf_dir))
        if oracle:
            ORACLES[key] = oracle
        return f

    return add
