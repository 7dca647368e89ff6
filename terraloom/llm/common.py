"""Shared helpers: inputs, shared-folder tables and whitespace words."""

from __future__ import annotations

import contextlib
import ctypes
import tempfile
import uuid

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

#: Words everywhere in this subpackage: runs of anything but ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"

#: Rows an Arrow batch may hold; long texts make larger batches costly.
ARROW_ROWS = 1000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tune(spark: SparkSession) -> None:
    """Bound Arrow batches so that a Python worker's memory stays bounded."""
    if int(spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch", "10000")) > ARROW_ROWS:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(ARROW_ROWS))


def tidy() -> None:
    """Give memory that a worker has freed back to the system: workers live on for other tasks."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # where there is such a call
        ctypes.CDLL(None).malloc_trim(0)


_local_shared: str | None = None

#: Whether Spark removes what a job has shuffled once it ends.
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share, from ``spark.checkpoint.dir``.

    Only where the session names none and runs on one machine a temporary
    folder is made and set; on a cluster that is an error, as executors would
    each write to their own disk.
    """
    global _local_shared
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    if _local_shared is None:
        _local_shared = tempfile.mkdtemp(prefix="terraloom-")
        spark.sparkContext.setCheckpointDir(_local_shared)
    return _local_shared


def store(df: DataFrame, label: str, compression: str | None = None) -> DataFrame:
    """Write ``df`` as a table in the shared folder and read it again.

    This cuts the lineage; a lost executor costs nothing that was stored. The
    tables lie under terraloom/ in that folder, for its owner to clear between
    jobs: a lazy result may still read them after the call that wrote them.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/terraloom/{label}-{uuid.uuid4().hex}"
    before = spark.conf.get(_CLEANUP, None)
    spark.conf.set(_CLEANUP, "true")  # nothing reads again what this job has shuffled
    try:
        df.write.parquet(path, compression=compression)
    finally:
        spark.conf.unset(_CLEANUP) if before is None else spark.conf.set(_CLEANUP, before)
    return spark.read.schema(df.schema).parquet(path)


def spread(df: DataFrame, columns: list[str]) -> DataFrame:
    """``columns`` of ``df``; clashing or extra columns are left behind."""
    return df.select(*[F.col(f"`{c}`") for c in columns])
