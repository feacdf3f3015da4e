"""Helpers of the corpus operators: tables, scratch tables, and word patterns."""

from __future__ import annotations

import gc
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from driftloom.session import shared_folder

#: White space that separates words, as a character class of Java and Python patterns.
WORD_GAP = r"[\x20\x09-\x0D]"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One table of a data folder."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def free_name(df: DataFrame, name: str) -> str:
    """A column name that ``df`` does not have, whatever the case."""
    taken = {c.lower() for c in df.columns}
    while name in taken:
        name = f"_{name}"
    return name


def whole_row(df: DataFrame) -> Column:
    """All columns as one struct, whatever their names."""
    return F.struct(*[F.col("`" + c.replace("`", "``") + "`") for c in df.columns])


class Scratch:
    """Written tables of one run; each is durable when an executor is lost.

    ``cut`` writes a DataFrame and returns the reread table, so its lineage ends there.
    ``drop`` removes a table that nothing reads any more. The rest goes when the session ends.
    """

    def __init__(self, spark: SparkSession, name: str):
        self.spark = spark
        self.path = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
        jvm = spark.sparkContext._jvm
        self._at = jvm.org.apache.hadoop.fs.Path(self.path)
        self._fs = self._at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        self._fs.mkdirs(self._at)
        self._fs.deleteOnExit(self._at)

    def cut(self, df: DataFrame, name: str, release: bool = False) -> DataFrame:
        """``release`` lets Spark's cleaner drop the shuffle files that only this write needed.

        The cleaner follows the driver's garbage collection, which may be hours away.
        """
        at = f"{self.path}/{name}"
        df.write.mode("overwrite").parquet(at)
        if release:
            gc.collect()
            self.spark.sparkContext._jvm.System.gc()
        return self.spark.read.schema(df.schema).parquet(at)

    def drop(self, name: str) -> None:
        self._fs.delete(self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}"), True)
