"""Shared pieces of the training-data operators: tables, shared folder, Arrow plumbing."""

from __future__ import annotations

import contextlib
import ctypes
import gc
import uuid

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows that tasks hand to Python at once; long texts make large batches.
ROWS_AT_ONCE = 1000
#: Bytes that a task gathers before it writes a row group: the default of 128 MB, twice, is much of a small executor.
ROW_GROUP = 16 << 20
#: Files of a stored table for each core.
FILES = 6
#: A key with more than one in so many of all rows is frequent: there are no more than so many, whatever the input.
FREQUENT = 1000
_BATCH = "spark.sql.execution.arrow.maxRecordsPerBatch"


def small_batches(spark: SparkSession) -> None:
    """Have the session hand ROWS_AT_ONCE rows to Python at once, unless it is set to fewer: rows here hold whole texts."""
    if not 0 < int(spark.conf.get(_BATCH)) <= ROWS_AT_ONCE:
        spark.conf.set(_BATCH, str(ROWS_AT_ONCE))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    small_batches(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """A fresh folder below spark.checkpoint.dir, which every executor sees.

    Where the session names none, a local test run gets a folder in the warehouse; on a cluster that is an error.
    """
    small_batches(spark)
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not root:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        spark.sparkContext.setCheckpointDir(f"{spark.conf.get('spark.sql.warehouse.dir')}/lodestone")
        root = spark.sparkContext.getCheckpointDir()
    return f"{root.rstrip('/')}/lodestone-{uuid.uuid4().hex}"


def stored(df: DataFrame, path: str, rows: int = ROWS_AT_ONCE, files: int | None = None) -> DataFrame:
    """Write df as a table in the shared folder and read it back: lineage ends here. Python gets ``rows`` rows at once.

    The table has FILES files for each core at most, or ``files``, however many partitions df has (0: one for each).
    """
    spark = df.sparkSession
    small_batches(spark)
    files = FILES * spark.sparkContext.defaultParallelism if files is None else files
    before = spark.conf.get(_BATCH)
    spark.conf.set(_BATCH, str(min(rows, int(before))))
    try:
        (df.coalesce(files) if files else df).write.mode("overwrite").option("parquet.block.size", str(ROW_GROUP)).parquet(path)
    finally:
        spark.conf.set(_BATCH, before)
    return spark.read.schema(df.schema).parquet(path)


def drop(spark: SparkSession, *paths: str) -> None:
    """Delete tables of the shared folder that nothing reads any more."""
    for p in paths:
        path = spark._jvm.org.apache.hadoop.fs.Path(p)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def beside(rows: DataFrame, values: DataFrame, key: str, total: int) -> DataFrame:
    """Inner join of rows with values (one row a key: key, n rows of that key, others); ``total`` is no less than the rows.

    The values of frequent keys, FREQUENT at most, are broadcast, so that the rows of a large group never
    meet in one task; of the rows that are exchanged no key has more than one in FREQUENT.
    """
    others = [c for c in values.columns if c not in (key, "n")]
    often = F.col("n") * FREQUENT > total
    marked = rows.join(F.broadcast(values.where(often).select(key, F.struct(*others).alias("__often"))), key, "left")
    met = marked.where("__often is not null").select(*rows.columns, *(F.col(f"__often.{c}").alias(c) for c in others))
    rare = marked.where("__often is null").select(*rows.columns).join(values.where(~often).select(key, *others), key)
    return met.union(rare.select(*rows.columns, *others))


def sweep(spark: SparkSession) -> None:
    """Have the driver and the executors drop what is no longer referred to.

    Spark then deletes the shuffle files of tables that are done, and an executor's heap makes room for
    its Python workers. A few short tasks; where none of them runs on some executor, nothing is lost.
    """
    gc.collect()
    spark.sparkContext._jvm.System.gc()
    n = 2 * spark.sparkContext.defaultParallelism
    spark.range(0, n, 1, n).select(F.expr("reflect('java.lang.System', 'gc')").alias("done")).agg(F.count("done")).collect()


def let(value: Column, body) -> Column:
    """Evaluate ``value`` once per row and hand it to ``body`` as a bound variable.

    A plain column reference inside a lambda may be inlined and evaluated for every element.
    """
    return F.transform(F.array(value), body).getItem(0)


def tidied(run, keep: bool = False):
    """A function for mapInArrow that sees ROWS_AT_ONCE rows at most at once, as texts may be long, and
    gives its worker's memory back when a task ends, as idle workers stay for a while. With ``keep``
    what may serve the worker's next task stays until a task without it comes."""

    def go(batches):
        task_begins(keep)
        try:
            yield from run(b.slice(at, ROWS_AT_ONCE) for b in batches for at in range(0, b.num_rows, ROWS_AT_ONCE))
        finally:
            task_ends(keep)

    return go


#: What else is released when a task starts and ends: of the worker's modules, so only module functions may call it.
_releases: list = []


def task_begins(keep: bool) -> None:
    pa.set_memory_pool(pa.system_memory_pool())  # what malloc_trim() reaches
    if not keep:
        _release()


def task_ends(keep: bool) -> None:
    if not keep:
        _release()
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):
        ctypes.CDLL("libc.so.6").malloc_trim(0)


def _release() -> None:
    for release in _releases:
        release()
    gc.collect()  # what is released may hold itself in cycles


def batch(schema: pa.Schema, columns: list) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c, f.type) for c, f in zip(columns, schema)], schema=schema)


def utf8(column: pa.Array) -> list[bytes]:
    """UTF-8 bytes of a string column, null as empty."""
    return [x or b"" for x in column.cast(pa.large_binary() if pa.types.is_large_string(column.type) else pa.binary()).to_pylist()]
