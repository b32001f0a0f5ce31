"""Shared plumbing of the training-data operators: shared-folder tables and table access."""

from __future__ import annotations

import contextlib
import ctypes
import gc
import re
import tempfile
import uuid

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: The white space that separates words in every operator here: space, and U+0009 to U+000D.
WORD = r"[^\x20\x09-\x0D]+"

#: Rows of an Arrow batch that goes to Python while a table is written.
BATCH_ROWS = 1024


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_root(spark: SparkSession) -> str:
    """The folder that all executors share: spark.checkpoint.dir. Where it is unset, a session on one machine gets one of its own; a cluster is an error."""
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not root:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        root = "file://" + tempfile.mkdtemp(prefix="corvid-shared-")
        spark.conf.set("spark.checkpoint.dir", root)
    return root.rstrip("/")


def shared_path(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder."""
    return f"{shared_root(spark)}/corvid/{name}-{uuid.uuid4().hex}"


@contextlib.contextmanager
def small_batches(spark: SparkSession):
    """Arrow batches of BATCH_ROWS rows at most while it lasts: whole texts of thousands of rows at once would not fit beside a sort."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    was = spark.conf.get(key)
    spark.conf.set(key, str(min(BATCH_ROWS, int(was)) if int(was) > 0 else BATCH_ROWS))
    try:
        yield
    finally:
        spark.conf.set(key, was)


def materialise(df: DataFrame, name: str, codec: str = "zstd") -> DataFrame:
    """Write df to the shared folder and read it back: its lineage is cut and it outlives lost executors."""
    spark = df.sparkSession
    path = shared_path(spark, name)
    with small_batches(spark):
        df.write.option("compression", codec).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def discard(df: DataFrame) -> None:
    """Delete the files of a table made by materialise(), once nothing reads it any more."""
    spark = df.sparkSession
    jvm = spark._jvm
    for parent in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        path = jvm.org.apache.hadoop.fs.Path(parent)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def _give_back() -> None:
    """Return this process's garbage to the system."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # glibc keeps freed memory of small objects otherwise
        ctypes.CDLL(None).malloc_trim(0)


def release(spark: SparkSession) -> None:
    """Let Spark drop the shuffle files of plans that nothing refers to any more; it does so when the driver collects garbage."""
    _give_back()
    spark._jvm.System.gc()


_held: dict[str, object] = {}


def claim(owner: str, forget=None) -> None:
    """Called in a Python worker by the operator that it works for: what another one remembered there is forgotten.

    Workers live on from stage to stage, and an executor has room for one operator's memory only.
    """
    others = [k for k in _held if k != owner]
    if others or owner not in _held:
        for k in others:
            if (f := _held.pop(k)) is not None:
                f()
        _held[owner] = forget
        _give_back()


def text_or_empty(column: str = "text"):
    return F.coalesce(F.col(column), F.lit(""))


def row_beside(df: DataFrame, columns: list[str], added: str, value: Column, kind: str) -> tuple[DataFrame, T.StructType]:
    """(row: a struct of the columns, added: value), in which no column's name can clash, and the schema of row beside the fields of kind, which a task returns."""
    row = F.struct(*(F.col(f"`{c}`") for c in columns)) if columns else F.lit(None).cast("struct<none: int>")
    held = df.select(row.alias("row"), value.alias(added))
    return held, T.StructType([held.schema["row"], *T.StructType.fromDDL(kind).fields])
