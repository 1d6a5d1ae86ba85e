"""File and inline sources."""

from __future__ import annotations

import csv as _csv
import io

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.scalar import lsmode  # noqa: F401

_AFFINITY = {"INT": T.LongType(), "CHAR": T.StringType(), "CLOB": T.StringType(), "TEXT": T.StringType(), "REAL": T.DoubleType(), "FLOA": T.DoubleType(), "DOUB": T.DoubleType()}


def _typed(schema: str) -> list[tuple[str, T.DataType]]:
    out = []
    for part in schema.split(","):
        name, _, kind = part.strip().partition(" ")
        out.append((name.strip('"'), next((t for k, t in _AFFINITY.items() if k in kind.upper()), T.StringType())))
    return out


def csv_scan(spark: SparkSession, filename: str | None = None, data: str | None = None, header: bool = False, columns: int | None = None, comma: str = ",", comment: str | None = None, skip: int = 0, schema: str | None = None) -> DataFrame:
    """Delimited text from a file or a string.

    Columns are text named by the header or c1, c2, ..; `schema` ('a INTEGER, b
    TEXT') types them: what isn't a number becomes NULL, as does an empty cell of a column that isn't
    text. Short rows are filled with NULL, long ones cut. `skip` leaves out
    leading lines. Exactly one of `filename` and `data` is given.
    """
    if (filename is None) == (data is None):
        raise ValueError("csv: give a filename or data")
    if len(comma) != 1 or (comment is not None and len(comment) != 1):
        raise ValueError("csv: comma and comment are one character")
    if data is not None:
        head = data.lstrip("﻿").split("\n")
    else:
        head = [r.value.lstrip("﻿") for r in spark.read.text(filename).limit(skip + 1 + 100).collect()]
    body = [x for x in head[skip:] if x and not (comment and x.startswith(comment))]
    first = next(_csv.reader(io.StringIO("\n".join(body)), delimiter=comma), []) if body else []
    kinds = _typed(schema) if schema else [(n if header else f"c{i + 1}", T.StringType()) for i, n in enumerate(first if columns is None else [*first, *[f"c{j + 1}" for j in range(len(first), columns)]][:columns])]
    text = T.StructType([T.StructField(n, T.StringType()) for n, _ in kinds])
    if not kinds:
        return spark.createDataFrame([], T.StructType([]))
    if data is not None:
        lines = "\n".join(head[skip:])
        rows = [r for r in _csv.reader(io.StringIO("\n".join(x for x in lines.split("\n") if not (comment and x.startswith(comment)))), delimiter=comma) if r]
        rows = rows[1:] if header else rows
        df = spark.createDataFrame([tuple([*r, *[None] * len(kinds)][: len(kinds)]) for r in rows], text)
    else:
        options = {"sep": comma, "multiLine": True, "mode": "PERMISSIVE", "escape": '"', "enforceSchema": True, "nullValue": "\x00"} | ({"comment": comment} if comment else {})
        if skip:
            numbered = lines_scan(spark, filename).where(F.col("lineno") > skip + bool(header)).orderBy("lineno").select("line")
            df = spark.read.schema(text).options(**options | {"multiLine": False}).csv(numbered.rdd.map(lambda r: r.line))
        else:
            df = spark.read.schema(text).options(**options, header=header).csv(filename)
    typed = [F.when(F.col(f"`{n}`") != "", F.col(f"`{n}`").try_cast(t)).alias(n) if not isinstance(t, T.StringType) else F.col(f"`{n}`") for n, t in kinds]
    return df.select(*typed)


def csv_table(spark: SparkSession, name: str, **options) -> None:
    """A table `name` of the session that reads delimited text, by the options of `csv_scan`."""
    csv_scan(spark, **options).createOrReplaceTempView(name)


def vacuum_into(tables: dict[str, DataFrame], path: str) -> None:
    """Writes a compact copy of each table below `path`, which must be new."""
    for name, df in tables.items():
        df.write.mode("errorifexists").parquet(f"{path}/{name}")


def lines_scan(spark: SparkSession, filename: str | None = None, data: str | None = None) -> DataFrame:
    """(lineno, line) from 1; a byte-order mark is left out; an empty input has no lines."""
    if (filename is None) == (data is None):
        raise ValueError("lines: give a filename or data")
    if data is not None:
        text = data.lstrip("﻿")
        text = text[:-1] if text.endswith("\n") else text
        rows = [(i, x.rstrip("\r")) for i, x in enumerate(text.split("\n"), 1)] if data else []
        return spark.createDataFrame(rows, "lineno long, line string")
    # order within a file is that of its blocks, which zipWithIndex keeps
    numbered = spark.read.text(filename).rdd.zipWithIndex().map(lambda x: (x[1] + 1, x[0][0]))
    return spark.createDataFrame(numbered, "lineno long, line string").withColumn("line", F.regexp_replace("line", "^﻿", ""))


def from_array(spark: SparkSession, values: list, kind: str | None = None) -> DataFrame:
    """One row per item, as `value`."""
    return spark.createDataFrame([(v,) for v in values], f"value {kind}" if kind else ["value"])


def fsdir(spark: SparkSession, root: str, depth: int | None = None) -> DataFrame:
    """(name, mode, mtime, size, data, level): `root` at level 0 and the directories and files below it.

    mode is the permission text with the kind of entry, mtime nanoseconds since the
    epoch, data a file's bytes (NULL for a directory). Names come from the file
    system's listing, which the driver holds; bytes are read on the executors.
    """
    sc = spark.sparkContext
    path = sc._jvm.org.apache.hadoop.fs.Path(root)
    fs = path.getFileSystem(sc._jsc.hadoopConfiguration())
    rows, todo = [], [(fs.getFileStatus(path), 0)]
    while todo:
        st, level = todo.pop()
        at = st.getPath()
        kind = "d" if st.isDirectory() else "l" if st.isSymlink() else "-"
        rows.append((at.toString(), at.toUri().getPath(), kind + str(st.getPermission().toString())[:9], st.getModificationTime() * 1_000_000, 0 if st.isDirectory() else st.getLen(), level))
        if st.isDirectory() and (depth is None or level < depth):
            todo += [(x, level + 1) for x in fs.listStatus(at)]
    listed = spark.createDataFrame(rows, "_path string, name string, mode string, mtime long, size long, level long")
    files = [r[0] for r in rows if r[2][0] == "-"]
    if not files:
        return listed.drop("_path").withColumn("data", F.lit(None).cast("binary")).select("name", "mode", "mtime", "size", "data", "level")
    data = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root).select(F.regexp_replace("path", r"^\w+:/*", "/").alias("_name"), F.col("content").alias("data"))
    out = listed.join(data, F.regexp_replace(listed["_path"], r"^\w+:/*", "/") == data["_name"], "left")
    return out.select("name", "mode", "mtime", "size", "data", "level")


def readfile(spark: SparkSession, path: str) -> bytes | None:
    """A file's bytes; None if it is missing."""
    try:
        r = spark.read.format("binaryFile").load(path).select("content").first()
    except Exception as e:  # noqa: BLE001
        if "PATH_NOT_FOUND" in str(e):
            return None
        raise
    return bytes(r.content) if r else None


def readblob(c, offset: int, n: int):
    """`n` bytes from `offset`; past the end is an error."""
    return F.when(F.octet_length(c) >= offset + n, F.substring(c, offset + 1, n)).when(c.isNotNull(), F.raise_error(F.lit("readblob: past the end")).cast("binary"))
