"""What the operators of this subpackage share: reading tables and Arrow batches."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

#: Rows in an Arrow batch. With Spark's own limit in bytes (64 MB) it bounds a worker's memory.
BATCH_ROWS = 1000
#: Characters that a vectorised step takes at once.
RUN_CHARS = 500_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A driver table; the batch size holds for the Python operators over it."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def checkpoint_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share. Where it is unset, a temporary one does on a local master (tests); on a cluster that raises."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not found:
        held = spark.sparkContext._jsc.sc().getCheckpointDir()
        if held.isDefined():
            found = held.get()
        elif re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
            found = tempfile.mkdtemp(prefix="checkpoint-")
        else:
            raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    if not spark.sparkContext._jsc.sc().getCheckpointDir().isDefined():
        spark.sparkContext.setCheckpointDir(found)
    return found


def shared_path(spark: SparkSession, label: str) -> str:
    """A new path in the shared folder."""
    return f"{checkpoint_dir(spark).rstrip('/')}/{label}-{uuid.uuid4().hex}"


def remove(spark: SparkSession, path: str) -> None:
    """Deletes a table that nothing reads any more."""
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


def strings(batch: pa.RecordBatch, name: str) -> list[str]:
    """A text column with null as the empty text."""
    return [x or "" for x in batch.column(name).to_pylist()]


def runs(texts: list[str], most: int = RUN_CHARS) -> Iterator[slice]:
    """Neighbouring texts with at most so many characters together, a longer one alone; they bound what a vectorised step holds."""
    begin = size = 0
    for k, text in enumerate(texts):
        if k > begin and size + len(text) > most:
            yield slice(begin, k)
            begin, size = k, 0
        size += len(text) + 1
    if begin < len(texts):
        yield slice(begin, len(texts))


def rows(schema: pa.Schema, columns: list, size: int = 20_000) -> Iterator[pa.RecordBatch]:
    """Columns as batches of a bounded number of rows."""
    arrays = [c if isinstance(c, pa.Array) else pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)]
    whole = pa.RecordBatch.from_arrays(arrays, schema=schema)
    for at in range(0, whole.num_rows, size):
        yield whole.slice(at, size)
