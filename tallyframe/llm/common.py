"""Shared helpers: folders that every executor sees, cutting lineage with written tables, and Python over batches."""

from __future__ import annotations

import ctypes
import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, DataFrameWriter, SparkSession
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

#: Bytes of a batch that a Python worker turns into objects at once; one row may have more.
BATCH_BYTES = 2 << 20
#: Settings while a table is written: its shuffle files go when it is done, and Python workers get small batches.
try:
    _LIBC = ctypes.CDLL("libc.so.6") if hasattr(ctypes.CDLL("libc.so.6"), "malloc_trim") else None
except OSError:  # another C library
    _LIBC = None
_WHILE_WRITING = {"spark.sql.classic.shuffleDependency.fileCleanup.enabled": "true", "spark.sql.execution.arrow.maxBytesPerBatch": str(BATCH_BYTES)}


def scratch(spark: SparkSession, name: str) -> str:
    """A fresh path in the folder that driver and executors share, ``spark.checkpoint.dir``.

    Where that is unset, a temporary folder takes its place in local mode; on a cluster it is an error.
    """
    root = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("tallyframe.scratch.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local") or "cluster" in spark.sparkContext.master:
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        root = "file://" + tempfile.mkdtemp(prefix="tallyframe-")
        spark.conf.set("tallyframe.scratch.dir", root)
    return f"{root.rstrip('/')}/{name}-{uuid.uuid4().hex}"


@contextmanager
def _settings(spark: SparkSession, values: dict[str, str]) -> Iterator[None]:
    before = {name: spark.conf.get(name, None) for name in values}
    try:
        for name, value in values.items():
            spark.conf.set(name, value)
        yield
    finally:
        for name, value in before.items():
            spark.conf.unset(name) if value is None else spark.conf.set(name, value)


def written(spark: SparkSession, writer: DataFrameWriter, kind: str, path: str) -> None:
    """Write to ``path`` in a format, with settings that hold for this write alone."""
    with _settings(spark, _WHILE_WRITING):
        writer.format(kind).save(path)


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: lineage is cut and survives lost executors."""
    path, spark = scratch(df.sparkSession, name), df.sparkSession
    written(spark, df.write, "parquet", path)
    back = spark.read.schema(df.schema).parquet(path)
    back.stored_at = path
    return back


def discard(*tables: DataFrame) -> None:
    """Delete tables of ``stored`` that nothing will read again."""
    for t in tables:
        spark = t.sparkSession
        path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(t.stored_at)
        path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def slices(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """The batch in parts of BATCH_BYTES at most, or of one row."""
    n = batch.num_rows
    if n > 1 and batch.nbytes > BATCH_BYTES:
        yield from slices(batch.slice(0, n // 2))
        yield from slices(batch.slice(n // 2))
    elif n:
        yield batch


def released() -> None:
    """Gives freed memory back to the machine: Spark keeps Python workers, and what they hold, from task to task."""
    pa.default_memory_pool().release_unused()
    if _LIBC is not None:
        _LIBC.malloc_trim(0)


def frames(df: DataFrame, run: Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]], schema: str | StructType) -> DataFrame:
    """``df`` through ``run``, as ``mapInPandas``, but over batches of bounded bytes and with exact integers.

    A column of integers with nulls keeps them as integers and None, where pandas would take floating-point numbers.
    """
    types = StructType.fromDDL(schema) if isinstance(schema, str) else schema

    def go(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made = to_arrow_schema(types)
        for pdf in run(part.to_pandas(integer_object_nulls=True) for b in batches for part in slices(b)):
            yield pa.RecordBatch.from_pandas(pdf, schema=made, preserve_index=False)
        released()

    return df.mapInArrow(go, types)


def extended(df: DataFrame, new: dict[str, str], run: Callable[[list[list]], dict[str, list]], inputs: list[str], drop: list[str] = ()) -> DataFrame:
    """``df`` with columns ``new`` (name: type) that ``run`` makes of the values of ``inputs``, batch by batch, for each row.

    Other columns pass through Arrow untouched, whatever their type; columns named like a new
    one are replaced and columns of ``drop`` left out.
    """
    rest = [f for f in df.schema.fields if f.name not in {*new, *drop}]
    added = StructType.fromDDL(", ".join(f"`{c}` {t}" for c, t in new.items()))
    names = list(dict.fromkeys([*[f.name for f in rest], *inputs]))
    chosen = df.select(*[f"`{c}`" for c in names])

    def go(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        types = to_arrow_schema(added)
        for b in batches:
            for part in slices(b):
                got = run([part.column(names.index(c)).to_pylist() for c in inputs])
                fields = [part.schema.field(names.index(f.name)) for f in rest]
                columns = [part.column(names.index(f.name)) for f in rest] + [pa.array(got[f.name], f.type) for f in types]
                yield pa.RecordBatch.from_arrays(columns, schema=pa.schema([*fields, *types]))
        released()

    return chosen.mapInArrow(go, StructType([*rest, *added.fields]))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
