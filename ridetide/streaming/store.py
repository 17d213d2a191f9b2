"""Update log: the stored form of the history and snapshot tables.

Every micro-batch of price updates is one folder of Parquet files, named by run, streaming query and
micro-batch. The two tables are views over the log: last arrival per key. ``rewrite`` is a batch job
that makes them a table partitioned by day.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, DataFrameWriter, SparkSession
from pyspark.sql import functions as F

from ridetide.operators.latest import HISTORY_COLUMNS, history_of_log, last_versions, snapshot_of_log
from ridetide.schemas import UPDATE_LOG, column_names
from ridetide.session import batch_folder, write_once

_FOLDERS = f"{UPDATE_LOG}, run BIGINT, query STRING, batch_id BIGINT"


class UpdateLog:
    def __init__(self, spark: SparkSession, path: str) -> None:
        self._spark = spark
        self._path = path.rstrip("/")

    def append(self, updates: DataFrame, batch_id: int, run: int) -> None:
        """Store one micro-batch; storing it again in the same run changes nothing.

        ``run`` orders the starts of jobs: a later one has a greater number, of at most ten digits.
        """
        rows = updates.select(*column_names(UPDATE_LOG))
        write_once(rows, f"{self._path}/{batch_folder(updates, run, batch_id)}", DataFrameWriter.parquet)

    def rows(self) -> DataFrame:
        """All stored rows with their run and micro-batch."""
        return self._spark.read.schema(_FOLDERS).parquet(self._path)

    def history(self) -> DataFrame:
        return history_of_log(self.rows())

    def snapshot(self, by_event_time: bool = False) -> DataFrame:
        return snapshot_of_log(self.rows(), by_event_time)

    def rewrite(self, folder: str) -> DataFrame:
        """Write the last versions of all windows as a table in a fresh folder, and return it.

        Partitioned by day and cut by range of zone and window, so that a hot zone is many files and a
        range query reads few of them.
        """
        layout = (F.col("day"), F.col("zone_id"), F.col("window_start"))
        last = last_versions(self.rows()).withColumn("day", F.to_date("window_start"))
        by_range = last.repartitionByRange(*layout).sortWithinPartitions(*layout)
        by_range.select(*HISTORY_COLUMNS, "day").write.partitionBy("day").parquet(folder)
        return self._spark.read.schema(by_range.select(*HISTORY_COLUMNS, "day").schema).parquet(folder)
