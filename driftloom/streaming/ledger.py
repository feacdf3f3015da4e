"""Exactly-once appends: a stream's micro-batches as folders with a ledger of those that are whole.

A batch is written to the folder of its id, over whatever an earlier try has left there, and then
entered in the ledger. Reading takes what the ledger lists, so a batch that was cut between both writes
is not seen until it is tried again, and a batch that is replayed replaces itself.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from driftloom.operators.ingest import new_versions


class Ledger:
    """Rows of ``schema`` under a shared folder."""

    def __init__(self, spark: SparkSession, path: str, schema: str):
        self.spark, self.path, self.schema = spark, path, schema
        spark.createDataFrame([], f"{schema}, batch long").write.mode("ignore").parquet(f"{path}/rows/batch_id=-1")
        spark.createDataFrame([], "batch long").write.mode("ignore").parquet(f"{path}/ledger/batch_id=-1")

    def _read(self, name: str, schema: str) -> DataFrame:
        return self.spark.read.schema(f"{schema}, batch_id long").parquet(f"{self.path}/{name}")

    def rows(self, before: int | None = None) -> DataFrame:
        """Rows of whole batches, or of those before one."""
        whole = self._read("ledger", "batch long").select("batch_id").distinct()
        rows = self._read("rows", f"{self.schema}, batch long")
        if before is not None:
            rows = rows.filter(F.col("batch_id") < before)
        return rows.join(whole, "batch_id", "left_semi").drop("batch_id", "batch")

    def write_rows(self, rows: DataFrame, batch: int) -> None:
        rows.withColumn("batch", F.lit(batch).cast("long")).write.mode("overwrite").parquet(f"{self.path}/rows/batch_id={batch}")

    def enter(self, batch: int) -> None:
        self.spark.createDataFrame([(batch,)], "batch long").write.mode("overwrite").parquet(f"{self.path}/ledger/batch_id={batch}")

    def sink(self, keys: list[str], stamp: str) -> Callable[[DataFrame, int], None]:
        """For ``foreachBatch``: append the rows whose keys and stamp are not held; null stamps are equal."""

        def append(rows: DataFrame, batch: int) -> None:
            fresh = rows.groupBy(*keys, stamp).agg(*[F.min(c).alias(c) for c in rows.columns if c not in (*keys, stamp)]).select(*rows.columns)
            self.write_rows(new_versions(self.rows(before=batch), fresh, keys, stamp), batch)
            self.enter(batch)

        return append
