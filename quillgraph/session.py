"""Session settings and scratch tables that outlive lost executors."""

from __future__ import annotations

import atexit
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

_left: list[tuple[SparkSession, str]] = []


def build_session(app: str = "quillgraph", master: str | None = None, **conf: str) -> SparkSession:
    """A session with adaptive planning and UTC; further settings by keyword with dots as `__`."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    settings = {
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.session.timeZone": "UTC",
        "spark.ui.enabled": "false",
    } | {k.replace("__", "."): v for k, v in conf.items()}
    for key, value in settings.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: spark.checkpoint.dir, or a temporary one where it is unset (tests)."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        known = spark.sparkContext._jsc.sc().getCheckpointDir()
        folder = known.get() if known.isDefined() else tempfile.mkdtemp(prefix="quillgraph-")
        if not known.isDefined():
            spark.sparkContext.setCheckpointDir(folder)
    return folder.rstrip("/")


def _remove(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    hadoop = jvm.org.apache.hadoop.fs.Path(path)
    hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(hadoop, True)


@contextmanager
def arrow_rows(spark: SparkSession, rows: int | None) -> Iterator[None]:
    """Inside, at most so many rows cross to Python at a time: for wide rows that bounds a worker's memory."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    was = spark.conf.get(key)
    if rows:
        spark.conf.set(key, rows)
    try:
        yield
    finally:
        spark.conf.set(key, was)


def bound_batches(spark: SparkSession, rows: int = 1000, megabytes: int = 8) -> None:
    """Lets at most so much cross to Python at a time in this session; smaller settings stay.

    Arrow's buffers are pooled, so an executor keeps what its largest batches took, beside the heap. Parquet's reader is held
    to as many rows at a time: its column vectors double until a batch of whole texts fits, in single blocks of the heap.
    """
    conf = spark.conf
    if int(conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")) > rows:
        conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", rows)
    conf.set("spark.sql.execution.arrow.maxBytesPerBatch", f"{megabytes}m")
    if int(conf.get("spark.sql.parquet.columnarReaderBatchSize")) > rows:
        conf.set("spark.sql.parquet.columnarReaderBatchSize", rows)


def materialize(df: DataFrame, label: str = "t", rows: int | None = None, shrink: int = 1) -> DataFrame:
    """Writes df as Parquet in the shared folder and reads it back: lineage ends there.

    The table goes when the Python process ends, or earlier with release(). rows: see arrow_rows(). shrink: for tables far
    smaller than what they are made from, so many times fewer files than there are shuffle partitions (4 at least).
    """
    spark = df.sparkSession
    if shrink > 1:
        df = df.coalesce(max(4, int(spark.conf.get("spark.sql.shuffle.partitions")) // shrink))
    path = f"{shared_dir(spark)}/quillgraph-{label}-{uuid.uuid4().hex}"
    with arrow_rows(spark, rows):
        # Small row groups keep the writers' buffers small beside the Python workers. No _SUCCESS file: nothing reads it, and
        # Hadoop's local file system forks the driver's JVM for each file that it makes.
        df.write.option("parquet.block.size", 32 << 20).option("mapreduce.fileoutputcommitter.marksuccessfuljobs", "false").parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._quill_path = path
    _left.append((spark, path))
    return out


def release(df: DataFrame) -> None:
    """Deletes a materialized table that nothing reads any more."""
    path = getattr(df, "_quill_path", None)
    if path:
        _remove(df.sparkSession, path)
        _left[:] = [x for x in _left if x[1] != path]


@atexit.register
def _tidy() -> None:
    for spark, path in _left:
        try:
            _remove(spark, path)
        except Exception:  # the session may have ended before
            return
