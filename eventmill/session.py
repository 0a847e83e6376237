"""Session settings the operators rely on, and the shared folder they may write to."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import SparkSession

# JSON with a repeated key keeps the last value, at the top level and below it.
# Timestamps without zone are compared as UTC.
RUNTIME_CONF = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.mapKeyDedupPolicy": "LAST_WIN",
    "spark.sql.variant.allowDuplicateKeys": "true",
}

#: Bytes of an Arrow batch that goes to Python, about: the row that passes it still is in the batch.
BATCH_BYTES = 2**20

# Files are read in the thread of the task; a page is measured every few rows.
BUFFER_CONF = {
    "parquet.hadoop.vectored.io.enabled": "false",
    "parquet.page.size.check.estimate": "false",
    "parquet.page.size.row.check.min": "16",
}

# The folder of a local session that names none, by application.
_LOCAL: dict[str, str] = {}


def configure(spark: SparkSession) -> SparkSession:
    """Set the run-time options the record operators need; leaves all sizing to the deployment."""
    for key, value in RUNTIME_CONF.items():
        if spark.conf.get(key, None) != value:
            spark.conf.set(key, value)
    # Python workers import this library from where the driver has it, unless it is installed there.
    root, environment = os.path.dirname(os.path.dirname(os.path.abspath(__file__))), spark.sparkContext.environment
    paths = [p for p in environment.get("PYTHONPATH", "").split(os.pathsep) if p]
    if root not in paths:
        environment["PYTHONPATH"] = os.pathsep.join([*paths, root])
    return spark


def bound_batches(spark: SparkSession) -> None:
    """Cut Arrow batches by bytes, unless the deployment has set how; by default they are cut by rows only.

    Ten thousand whole texts are tens of MB. Each running task holds several copies of a batch outside the heap and in its
    worker, and what they once took is not given back.
    """
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    if spark.conf.get(key, None) is None:
        spark.conf.set(key, str(BATCH_BYTES))


def bound_buffers(spark: SparkSession) -> None:
    """Bound what Parquet keeps outside the heap while whole texts are read and written, unless the deployment has set how.

    By default local files are read by further threads, which live as long as the executor. Each keeps the buffers that it has
    read into, as large as whole columns of texts. And a page is cut where it is guessed to be full from the rows before:
    where texts become longer it grows to tens of MB, and so do the buffers that pack and unpack it, which are kept as well.
    """
    for key, value in BUFFER_CONF.items():
        if all(spark.conf.get(k, None) is None for k in (key, f"spark.hadoop.{key}")):
            spark.conf.set(key, value)


def shared_dir(spark: SparkSession) -> str:
    """Folder every executor can reach: `spark.checkpoint.dir`, or a temporary one in local mode."""
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if shared:
        return shared.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder all executors can reach")
    application = spark.sparkContext.applicationId
    if application not in _LOCAL:
        _LOCAL[application] = tempfile.mkdtemp(prefix="eventmill-")
    return _LOCAL[application]


def ensure_checkpoints(spark: SparkSession) -> None:
    """Make `DataFrame.checkpoint()` usable."""
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(shared_dir(spark))


def scratch_path(spark: SparkSession, label: str) -> str:
    """A fresh path below the shared folder."""
    return f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"
