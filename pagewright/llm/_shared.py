"""Helpers that the operators of this subpackage have in common."""

from __future__ import annotations

import ctypes
import re
import uuid
from collections.abc import Iterable, Iterator
from contextlib import contextmanager, nullcontext

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

#: Used only where the session names no shared folder and has one machine only, as in tests.
OWN_CHECKPOINTS = "/tmp/checkpoints"
#: Rows of one key from which on the key is hot: there are at most rows / HOT such keys.
HOT = 1_000_000
#: Rows of whole texts that go to a Python worker at once; Spark's own 10,000 are held by the JVM, outside its heap, and by the worker.
TEXTS = 1000
_open: list[list[str]] = []


def shared_dir(spark: SparkSession) -> str:
    """The folder that the driver and all executors share, by ``spark.checkpoint.dir``."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    if not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
        raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    return f"file://{OWN_CHECKPOINTS}"


def _file_system(spark: SparkSession, path: str):
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()), at


@contextmanager
def _batches(spark: SparkSession, rows: int):
    """Within it, Python workers get at most so many rows at once."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key)
    spark.conf.set(key, str(rows if int(before) <= 0 else min(rows, int(before))))
    try:
        yield
    finally:
        spark.conf.set(key, before)


def materialise(df: DataFrame, name: str, keep: bool = False, texts: bool = False, **options: str) -> DataFrame:
    """Write ``df`` as Parquet into the shared folder and read it back.

    The result has no lineage: a lost executor costs only the tasks that were
    running on it, and a table that is read twice is computed once. What a session
    has written goes when the driver ends, or with the ``scratch`` it was written in,
    unless ``keep`` is set. With ``texts``, Python workers get at most ``TEXTS`` rows
    at once. ``options`` are those of the writer.
    """
    spark = df.sparkSession
    folder = f"{shared_dir(spark)}/{spark.sparkContext.applicationId}"
    path = f"{folder}/{name}-{uuid.uuid4().hex}"
    with _batches(spark, TEXTS) if texts else nullcontext():
        df.write.options(**options).parquet(path)
    system, at = _file_system(spark, folder)
    system.deleteOnExit(at)
    if _open and not keep:
        _open[-1].append(path)
    return spark.read.schema(df.schema).parquet(path)


@contextmanager
def scratch(spark: SparkSession):
    """Deletes at its end the tables written within; what was made of them must have been written before."""
    _open.append([])
    try:
        yield
    finally:
        for path in _open.pop():
            system, at = _file_system(spark, path)
            system.delete(at, True)


def superseded(df: DataFrame) -> None:
    """Deletes a table that ``materialise`` wrote and that no other is computed from any more."""
    for file in df.inputFiles()[:1]:
        folder = file.rpartition("/")[0]
        system, at = _file_system(df.sparkSession, folder)
        system.delete(at, True)


def met(rows: DataFrame, found: DataFrame, key: str, count: str, hot: int | None = None) -> DataFrame:
    """``rows`` joined with ``found``, a written table of one row for each key, whose ``count`` is that of the key's rows.

    Rows of hot keys meet a broadcast, so that no task gathers them; there are at most
    rows / ``hot`` hot keys. The others meet in a join by key. ``count`` isn't in the result.
    """
    most = HOT if hot is None else hot
    large = found.where(F.col(count) > most).drop(count)
    if large.isEmpty():
        return rows.join(found.drop(count), key)
    large = F.broadcast(large)
    others = rows.join(F.broadcast(large.select(key)), key, "left_anti").join(found.where(F.col(count) <= most).drop(count), key)
    return rows.join(large, key).unionByName(others)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def named(column: str) -> Column:
    """A column by its whole name, whatever signs it holds."""
    return F.col(f"`{column.replace('`', '``')}`")


def slices(batches: Iterable[pa.RecordBatch], rows: int = 256) -> Iterator[pa.RecordBatch]:
    """The batches in parts of some rows, so that few texts are Python strings at a time."""
    for b in batches:
        for k in range(0, b.num_rows, rows):
            yield b.slice(k, rows)


def released() -> None:
    """Gives freed memory back to the system; workers are used again, and would keep what a former stage took."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):
        pass  # not the C library that has it


def arrow_rows(rows: list[tuple], arrow: pa.Schema) -> pa.RecordBatch:
    """A record batch of rows given as tuples."""
    columns = zip(*rows) if rows else [[] for _ in arrow]
    return pa.RecordBatch.from_arrays([pa.array(list(c), f.type) for c, f in zip(columns, arrow)], schema=arrow)


def map_rows(df: DataFrame, ddl: str | T.StructType, make, batch: int = 4096) -> DataFrame:
    """``df`` through ``make()``, which gives a function from one row (a tuple) to rows.

    ``make`` runs once for each task, so that what it prepares is not sent along.
    """
    out = T.StructType.fromDDL(ddl) if isinstance(ddl, str) else ddl
    arrow = to_arrow_schema(out)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        each, held = make(), []
        for b in slices(batches):
            for row in zip(*(c.to_pylist() for c in b.columns)):
                held.extend(each(*row))
                if len(held) >= batch:
                    yield arrow_rows(held, arrow)
                    held = []
        if held:
            yield arrow_rows(held, arrow)

    return df.mapInArrow(run, out)
