"""Shared pieces of the corpus operators: shared-storage tables and word rules."""

from __future__ import annotations

import atexit
import ctypes
import gc
import os
import shutil
import tempfile
import time
import uuid
import zipfile
from collections.abc import Callable, Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A word is a run of characters other than space and the ASCII controls 9-13.
WORD = r"[^\x20\x09-\x0D]+"
GAP = r"[\x20\x09-\x0D]+"
_GAP_CHARS = " \t\n\x0b\x0c\r"
BATCH_BYTES = 8 << 20
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def shared_dir(spark: SparkSession) -> str:
    """The folder every executor shares, as the session names it.

    Where `spark.checkpoint.dir` is unset on a single machine (tests) a temporary
    folder is made, set in the session and removed at exit; on a cluster that is
    an error, since executors would not see each other's files.
    """
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local["):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        own = tempfile.mkdtemp(prefix="lodestone-")
        atexit.register(shutil.rmtree, own, True)
        found = f"file://{own}"
        spark.conf.set("spark.checkpoint.dir", found)
        spark.sparkContext.setCheckpointDir(found)
    return found.rstrip("/")


def ship(df: DataFrame) -> None:
    """Make this package importable in the session's Python workers, once per context.

    They unpickle its functions by name, so each executor needs its files; they
    travel as Spark's own file downloads do. Batches that go to them are held to
    `BATCH_BYTES`, so that long texts don't add up in a worker.
    """
    sc = df.sparkSession.sparkContext
    df.sparkSession.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))
    if getattr(sc, "_lodestone_shipped", False):
        return
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    target = os.path.join(tempfile.mkdtemp(prefix="lodestone-code-"), "lodestone_code.zip")
    with zipfile.ZipFile(target, "w") as z:
        for folder, _, names in os.walk(root):
            for n in names:
                if n.endswith(".py"):
                    full = os.path.join(folder, n)
                    z.write(full, os.path.relpath(full, os.path.dirname(root)))
    sc.addPyFile(target)
    atexit.register(shutil.rmtree, os.path.dirname(target), True)
    sc._lodestone_shipped = True


def table(df: DataFrame, name: str, group_rows: int | None = None) -> DataFrame:
    """Write `df` as Parquet into the shared folder and read it again.

    Cuts the lineage: what follows survives the loss of any executor without
    running `df` a second time. Rows of some MB need `group_rows`, the most rows
    of a row group: a task writes and reads a whole group at once, and Parquet
    looks at sizes only every 100 rows.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/lodestone/{name}-{uuid.uuid4().hex}"
    df.write.options(**({"parquet.block.row.count.limit": group_rows} if group_rows else {})).parquet(path)
    made = spark.read.schema(df.schema).parquet(path)
    made._lodestone_path = path
    return made


def forget(*tables: DataFrame) -> None:
    """Delete what `table()` wrote for these, once nothing that is still to run reads them."""
    for df in tables:
        spark = df.sparkSession
        path = spark._jvm.org.apache.hadoop.fs.Path(df._lodestone_path)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


_kept: dict[str, Callable[[], None]] = {}


def claim(owner: str, clear: Callable[[], None] | None = None) -> None:
    """In a Python worker: free what other operators keep there between tasks; `clear` frees what `owner` is about to keep.

    Freed memory goes back to the machine, since workers outlive operators and an
    executor's memory counts all that they hold.
    """
    others = [k for k in _kept if k != owner]
    for k in others:
        _kept.pop(k)()
    if clear:
        _kept[owner] = clear
    if others:
        gc.collect()
    trim()


def trim() -> None:
    """Give memory that is free within this process back to the machine, as far as its allocators can."""
    import pyarrow as pa

    pa.default_memory_pool().release_unused()
    trimmer = getattr(ctypes.CDLL(None), "malloc_trim", None)  # of the GNU library
    if trimmer:
        trimmer(0)


def release(spark: SparkSession) -> None:
    """Let Spark drop the shuffle files of finished steps now, not when the driver next collects garbage."""
    for _ in range(2):
        gc.collect()
        spark.sparkContext._jvm.System.gc()
        time.sleep(0.3)


@contextmanager
def shuffles_spent(spark: SparkSession) -> Iterator[None]:
    """What is written within this gives up its shuffle files as soon as it is written, without waiting for garbage collection."""
    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    was = spark.conf.get(key, None)
    spark.conf.set(key, "true")
    try:
        yield
    finally:
        spark.conf.unset(key) if was is None else spark.conf.set(key, was)


def fresh(df: DataFrame, stem: str) -> str:
    """A column name that `df` does not use, whatever its case."""
    taken = {c.lower() for c in df.columns}
    name, k = stem, 0
    while name.lower() in taken:
        k += 1
        name = f"{stem}_{k}"
    return name


def ascii_lower(c: Column) -> Column:
    """Lower-case A-Z and nothing else."""
    return F.translate(c, UPPER, LOWER)


def words(c: Column) -> Column:
    """The words of a text as an array; null gives an empty array."""
    return F.filter(F.split(F.coalesce(c, F.lit("")), GAP), lambda w: w != "")


def word_count(c: Column) -> Column:
    """The number of words of a text as a long; null gives 0."""
    return F.coalesce(F.regexp_count(c, F.lit(WORD)), F.lit(0)).cast("long")


def without_gaps(c: Column) -> Column:
    return F.translate(c, _GAP_CHARS, "")


def let(value: Column, body) -> Column:
    """`body(value)` with `value` computed once per row, also inside lambdas."""
    return F.transform(F.array(value), body)[0]


def py_words(text: str | None) -> list[str]:
    """`words()` in Python: split on the six ASCII gaps only."""
    if not text:
        return []
    if not _odd_gap(text):
        return text.split()
    return [w for w in _gap_split(text) if w]


def _make():
    import re

    # characters that str.split() takes as white space beyond the six
    odd = re.compile("[\x1c-\x1f\x85\xa0  -     　]").search
    return odd, re.compile(GAP).split


_odd_gap, _gap_split = _make()
_FOLD = str.maketrans(UPPER, LOWER)


def py_lower(text: str) -> str:
    """Lower-case A-Z and nothing else."""
    return text.lower() if text.isascii() else text.translate(_FOLD)
