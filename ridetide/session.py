"""Session defaults and the shared folder for checkpoints and written tables."""

from __future__ import annotations

import itertools
import tempfile
import time
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, DataFrameWriter, SparkSession

CHECKPOINT_DIR = "spark.checkpoint.dir"

# What the streaming jobs rely on. transformWithState needs the RocksDB provider; with changelog
# checkpointing a commit uploads only what a micro-batch changed, whatever the size of the state.
# Of several watermarks the slowest counts, and a watermark that moves without new input still
# fires windows.
STREAM_CONF = {
    "spark.sql.streaming.stateStore.providerClass": (
        "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
    ),
    "spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled": "true",
    "spark.sql.streaming.multipleWatermarkPolicy": "min",
    "spark.sql.streaming.noDataMicroBatches.enabled": "true",
}


def local_session(cpus: str = "8", shuffle_partitions: int = 8, app: str = "ridetide") -> SparkSession:
    """A session for tests and benches; a cluster brings its own."""
    return (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "8g")
        .config("spark.ui.enabled", "false")
        .config("spark.python.sql.dataFrameDebugging.enabled", "false")
        .getOrCreate()
    )


def shared_dir(spark: SparkSession, name: str) -> str:
    """A new folder path under the cluster's shared folder.

    Only a local master may fall back to a temporary folder of this machine.
    """
    root = spark.conf.get(CHECKPOINT_DIR, None) or spark.sparkContext.getConf().get(CHECKPOINT_DIR)
    if root:
        return f"{root.rstrip('/')}/ridetide/{name}-{uuid.uuid4().hex}"
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError(f"set {CHECKPOINT_DIR} to a folder that all executors share")
    return tempfile.mkdtemp(prefix=f"ridetide-{name}-")


_runs = itertools.count()


def new_run() -> int:
    """A run number greater than all that were taken before: the second of now, and never twice in a process."""
    global _runs
    run = max(int(time.time()), next(_runs))
    _runs = itertools.count(run + 1)
    return run


def batch_folder(rows: DataFrame, run: int, batch_id: int) -> str:
    """Where a streaming query stores a micro-batch: below its run and its own id, which is that of its
    checkpoint. So no query finds the folder of another one complete, whatever its run."""
    query = rows.sparkSession.sparkContext.getLocalProperty("sql.streaming.queryId") or "none"
    return f"run={run}/query={query}/batch_id={batch_id}"


def is_complete(spark: SparkSession, folder: str) -> bool:
    """True when a write to the folder has been committed."""
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{folder}/_SUCCESS")
    return path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path)


def write_once(rows: DataFrame, folder: str, write: Callable[[DataFrameWriter, str], None]) -> None:
    """Write a micro-batch to its folder, unless that is complete: a reader may have listed it.

    The rows are computed either way, since the state of a stream advances only when they are.
    """
    if is_complete(rows.sparkSession, folder):
        rows.write.format("noop").mode("overwrite").save()
    else:
        write(rows.write.mode("overwrite"), folder)


@contextmanager
def session_conf(spark: SparkSession, settings: dict[str, str]) -> Iterator[None]:
    """Apply settings while a streaming query is started, then put the old ones back."""
    before = {key: spark.conf.get(key, None) for key in settings}
    for key, value in settings.items():
        spark.conf.set(key, value)
    try:
        yield
    finally:
        for key, value in before.items():
            if value is None:
                spark.conf.unset(key)
            else:
                spark.conf.set(key, value)
