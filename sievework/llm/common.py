"""What the operators share: tables, the shared folder, written intermediates, checked broadcasts."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

CHECKPOINT = "spark.checkpoint.dir"
#: Rows of a table of a few longs that a broadcast may carry (about 32 MB); larger sides are shuffled.
BROADCAST_ROWS = 1_000_000


#: Rows and bytes of an Arrow batch: texts are long, and a batch is held by the JVM and by Python.
BATCH_ROWS, BATCH_BYTES = 1000, 8 << 20


def bound_batches(spark: SparkSession, most_bytes: int = BATCH_BYTES) -> None:
    """Bounds the session's Arrow batches, where they are not smaller already. Plans take the bounds when they run, so they
    stay set; call it for DataFrames that did not come from table()."""
    for name, most in (("maxRecordsPerBatch", BATCH_ROWS), ("maxBytesPerBatch", most_bytes)):
        now = spark.conf.get(f"spark.sql.execution.arrow.{name}").rstrip("b")
        if not now.isdigit() or not 0 < int(now) <= most:
            spark.conf.set(f"spark.sql.execution.arrow.{name}", str(most))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    bound_batches(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share. Where the cluster names none, a local session gets one of its own (driver and
    executors are one process there); any other must name it."""
    base = spark.conf.get(CHECKPOINT, None)
    if not base:
        if not spark.sparkContext.master.startswith("local") or "cluster" in spark.sparkContext.master:
            raise RuntimeError(f"set {CHECKPOINT} to a folder that the driver and all executors share")
        base = "file://" + tempfile.mkdtemp(prefix="sievework-")
        spark.conf.set(CHECKPOINT, base)
    return base.rstrip("/")


def shared_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str) -> DataFrame:
    """The rows as a table in the shared folder: computed once, and not lost with an executor."""
    spark = df.sparkSession
    path = shared_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def remove(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def remove_table(df: DataFrame) -> None:
    """Drops what written() made, once nothing reads it any more."""
    files = df.inputFiles()
    if files:
        remove(df.sparkSession, files[0].rsplit("/", 1)[0])


def small(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """Marks a narrow table for broadcast if it has at most `rows` rows; otherwise the join shuffles."""
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df


def release() -> None:
    """Gives memory that this process has freed back to the system; workers are used again, and keep it otherwise."""
    import ctypes
    import sys

    import pyarrow as pa

    pa.default_memory_pool().release_unused()
    if sys.platform == "linux" and hasattr(libc := ctypes.CDLL(None), "malloc_trim"):
        libc.malloc_trim(0)


def arrow_map(df: DataFrame, run, schema) -> DataFrame:
    """df.mapInArrow, after which a worker keeps no memory of the task."""

    def freed(batches):
        try:
            yield from run(batches)
        finally:
            release()

    return df.mapInArrow(freed, schema)


def store(uri: str):
    """The file system of a folder in the shared folder, and the folder's path there; for use on executors."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri)


def put(fs, path: str, data: bytes) -> None:
    """Writes a file whole: a second attempt of a task replaces it by the same bytes."""
    tmp = f"{path}.{uuid.uuid4().hex}.tmp"
    with fs.open_output_stream(tmp) as out:
        out.write(data)
    try:
        fs.move(tmp, path)
    except OSError:  # stores whose move does not replace
        fs.delete_file(path)
        fs.move(tmp, path)
