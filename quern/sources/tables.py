"""Tables of the warehouse, and files in other formats."""

from __future__ import annotations

import csv
import io
from collections.abc import Iterator
from itertools import islice

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.functions.text import normal
from quern.sources.scratch import written


def read(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def stamp(spark: SparkSession, folder: str, name: str) -> int:
    """When a table's files last changed: what is derived from it and stored goes by this."""
    context = spark.sparkContext
    at = context._jvm.org.apache.hadoop.fs.Path(f"{folder}/{name}.parquet")
    files = at.getFileSystem(context._jsc.hadoopConfiguration())
    return max([files.getFileStatus(at).getModificationTime(), *(f.getModificationTime() for f in files.listStatus(at))])


#: Tried in this order (fixed values).
ENCODINGS = ("UTF-8", "GB18030", "GBK", "ISO-8859-1")
PYTHON_ENCODINGS = ("utf-8-sig", "utf-8", "gb18030", "gbk", "latin-1")


def read_csv(spark: SparkSession, path: str, encodings: tuple[str, ...] = ENCODINGS) -> DataFrame:
    """The CSV by the first encoding that reads all its text: no replacement characters in the header or any value.

    Lines with more or fewer fields than the header are malformed and left out.  A file with a header alone is an
    empty table in the first encoding that reads the header; a byte-order mark is no part of the first name.
    """
    spark.conf.set("spark.sql.legacy.javaCharsets", "true")  # Spark 4 reads Chinese encodings only with this
    for encoding in encodings:
        df = spark.read.csv(path, header=True, encoding=encoding, mode="DROPMALFORMED", multiLine=True)
        named = df.toDF(*(c.lstrip("﻿") for c in df.columns))
        if not named.columns or any("�" in c for c in named.columns):
            continue
        broken = F.lit(False)
        for c in named.columns:
            broken = broken | F.coalesce(F.col(f"`{c}`").contains("�"), F.lit(False))
        if not named.where(broken).limit(1).count():
            return named
    raise ValueError(f"no encoding of {encodings} reads {path}")


def read_mixed_csv(spark: SparkSession, path: str, encodings: tuple[str, ...] = PYTHON_ENCODINGS) -> tuple[DataFrame, DataFrame]:
    """(rows, bad) of a folder whose CSV files have encodings, and orders of columns, of their own.

    rows: all columns of all headers as strings (null where a file lacks one), with `_file` and `_encoding`, the first one that reads the whole
    file.  bad: (_file, line, text) of lines with more or fewer fields than their file's header, counted from 1, header included.  A file is
    read once, by one task, as a quoted field may hold line ends; no encoding at all is an error.
    """

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, content in zip(batch.column("path").to_pylist(), batch.column("content"), strict=True):
                text, encoding = decoded(content.as_py(), encodings)
                lines = csv.reader(io.StringIO(text, newline=""))
                header = [h.strip() for h in next(lines, [])]
                while some := [(lines.line_num, x) for x in islice(lines, 5000) if x]:
                    good = [len(x) == len(header) for _, x in some]
                    cells = [list(zip(header, x)) if g else None for g, (_, x) in zip(good, some, strict=True)]
                    bad = [None if g else ",".join(x) for g, (_, x) in zip(good, some, strict=True)]
                    n = len(some)
                    yield pa.record_batch([pa.array([name] * n), pa.array([encoding] * n), pa.array([i for i, _ in some], pa.int64()), pa.array(cells, pa.map_(pa.string(), pa.string())), pa.array(bad, pa.string())], ["_file", "_encoding", "line", "cells", "text"])

    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "*.csv").load(path).select("path", "content")
    parsed = written(files.mapInArrow(parse, "_file string, _encoding string, line long, cells map<string,string>, text string"))
    good = parsed.where("cells is not null")
    names = sorted(r[0] for r in good.select(F.explode(F.map_keys("cells"))).distinct().collect())  # as many as columns
    return good.select(*(F.col("cells")[n].alias(n) for n in names), "_file", "_encoding"), parsed.where("text is not null").select("_file", "line", "text")


def decoded(content: bytes, encodings: tuple[str, ...]) -> tuple[str, str]:
    """(text, encoding) by the first encoding that reads all bytes."""
    for encoding in encodings:
        try:
            return content.decode(encoding), encoding
        except UnicodeDecodeError:
            continue
    raise ValueError(f"no encoding of {encodings} reads it")


def read_json(spark: SparkSession, path: str, schema: str | None = None) -> DataFrame:
    """JSON lines, or whole files that hold an array or one object."""
    reader = spark.read.schema(schema) if schema else spark.read
    return reader.json(path, multiLine=True)


def read_files(spark: SparkSession, path: str, glob: str) -> DataFrame:
    """(path, length, sha256) of all files below `path` whose name fits `glob`; contents are hashed where they are read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", glob).load(path)
    return files.select("path", "length", F.sha2("content", 256).alias("sha256"))


def compact(name: str) -> str:
    """A column's name without spaces (wide ones too)."""
    return name.strip().replace(" ", "").replace("　", "")


def find_column(columns: list[str], candidates: list[str], last: bool = False) -> str | None:
    """The column of the first candidate whose compacted name is there; else the last column if asked for, or None."""
    there = {compact(c): c for c in columns}
    for c in candidates:
        if compact(c) in there:
            return there[compact(c)]
    return columns[-1] if last and columns else None


def first_filled(columns: list[str], candidates: list[str], fallback: str = "") -> Column:
    """Row by row, the first candidate column with text after cleaning: exact names first, then compacted ones."""
    there = {compact(c): c for c in columns}
    exact = [c for c in candidates if c in columns]
    alike = [there[compact(c)] for c in candidates if compact(c) in there]
    values = [F.nullif(normal(F.col(f"`{c}`").cast("string")), F.lit("")) for c in [*exact, *alike]]
    return F.coalesce(*values, F.lit(fallback))
