"""What the operators of this subpackage share: table reading, shared storage, hash splits and Arrow helpers."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Hashable, Iterator
from typing import Any

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows that one Arrow batch holds at most. Texts can have hundreds of kilobytes, so batches are kept short.
BATCH_ROWS = 256

#: What this Python worker remembers from task to task.
_REMEMBERED: dict[Hashable, Any] = {}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def short_batches(spark: SparkSession, rows: int = BATCH_ROWS) -> None:
    """Bounds the memory of a Python worker: few rows in each Arrow batch. Their bytes are bounded by Spark's own
    spark.sql.execution.arrow.maxBytesPerBatch."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))


def _scratch_root(spark: SparkSession) -> str:
    base = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.wayfowl.checkpoint.dir", "")
    if not base:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        base = f"file://{tempfile.mkdtemp(prefix='spark-wayfowl-')}"  # one machine: tests
        spark.conf.set("spark.wayfowl.checkpoint.dir", base)
    return f"{base.rstrip('/')}/wayfowl-{spark.sparkContext.applicationId}"


def shared_folder(spark: SparkSession) -> str:
    """A new folder below spark.checkpoint.dir, which all executors see. Where that is unset, a cluster is refused; a session on one
    machine takes a folder of its own."""
    return f"{_scratch_root(spark)}/{uuid.uuid4().hex}"


def remove_written(spark: SparkSession) -> None:
    """Deletes all that this application has written between its steps. DataFrames that come from it can't be read any more."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(_scratch_root(spark))
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def written(df: DataFrame) -> DataFrame:
    """Writes df to the shared folder and reads it again: cuts the lineage, outlives lost executors. It stays until
    remove_written(), since what is returned is read only later."""
    path = shared_folder(df.sparkSession)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def id_bucket(id_col: str, modulus: int) -> Column:
    """crc32 of the id as text, modulo modulus. Null ids fall in bucket 0."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string")) % modulus, F.lit(0))


def text_bytes(batch: pa.RecordBatch, column: str) -> list[bytes]:
    """A text column as UTF-8; null counts as empty."""
    return [x or b"" for x in batch.column(column).cast(pa.binary()).to_pylist()]


def remembered(key: Hashable, make: Callable[[], Any]):
    """What make() gives, kept in this Python worker for later tasks that ask for the same key. What was kept for another key goes."""
    if key not in _REMEMBERED:
        forget()
        _REMEMBERED[key] = make()
    return _REMEMBERED[key]


def forget() -> None:
    """Frees what this Python worker remembers. Spark gives a worker one operator's tasks after the other's, so tasks that remember
    nothing begin with this: else they would run beside the memory of an operator that is through."""
    _REMEMBERED.clear()
    pa.default_memory_pool().release_unused()


def per_text(make: Callable[[], Callable[[bytes], tuple]], schema: pa.Schema, keep: tuple[str, ...] = ("doc_id",), text: str = "text"):
    """A function for mapInArrow: the kept columns, then what make()'s function gives for each text. make() runs once a task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forget()
        f = make()
        for batch in batches:
            if batch.num_rows:
                found = list(zip(*map(f, text_bytes(batch, text)), strict=True))
                yield pa.RecordBatch.from_arrays([batch.column(k) for k in keep] + [pa.array(v, schema.field(len(keep) + i).type) for i, v in enumerate(found)], schema=schema)

    return run
