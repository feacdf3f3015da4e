"""A store of snapshots that can be written again safely, its mirror, and the check of both.

A run's bodies come first, then its observations, then the fold of all keys, then the run's entry: what
is not entered is not read. A run that is repeated writes over its own folders and looks only at runs
entered before it, so it changes nothing.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

OBSERVATIONS = "key long, obs_id long, at timestamp, sha string"
BLOBS = "sha string, body string"
SERVERS = "key long, first_seen timestamp, last_seen timestamp, sha string, observations long"
RUNS = "run long"
TABLES = {"blobs": BLOBS, "observations": OBSERVATIONS, "servers": SERVERS, "runs": RUNS}
#: Snapshots that a mirror keeps.
RETAINED = 14


class Store:
    """Tables of runs under one folder, each run's rows in a folder of its own."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        for name, schema in TABLES.items():
            spark.createDataFrame([], schema).write.mode("ignore").parquet(f"{self.path}/{name}/of_run=-1")

    def _all(self, name: str) -> DataFrame:
        return self.spark.read.schema(f"{TABLES[name]}, of_run long").parquet(f"{self.path}/{name}")

    def runs(self) -> DataFrame:
        """(run) of whole runs."""
        return self._all("runs").select("run").distinct()

    def read(self, name: str, before: int | None = None) -> DataFrame:
        """Rows of whole runs (``of_run``), or of those before one."""
        rows = self._all(name).join(self.runs().withColumnRenamed("run", "of_run"), "of_run", "left_semi")
        return rows if before is None else rows.filter(F.col("of_run") < before)

    def servers(self, before: int | None = None) -> DataFrame:
        """One row a key: the last fold."""
        folds = self.read("servers", before)
        last = folds.agg(F.max("of_run").alias("of_run"))
        return folds.join(F.broadcast(last), "of_run", "left_semi").drop("of_run")  # one row

    def _write(self, rows: DataFrame, name: str, run: int) -> None:
        rows.write.mode("overwrite").parquet(f"{self.path}/{name}/of_run={run}")

    def write_run(self, run: int, rows: DataFrame) -> None:
        """Append a snapshot (key, obs_id, at, body): new bodies by digest, an observation for each changed state, the fold.

        A state equal to the key's last one widens the key's interval and adds no observation. Of
        a key's rows in one run the last by (at, obs_id) is its state. Null bodies are a state of their own.
        """
        named = rows.select("key", "obs_id", "at", F.sha2("body", 256).alias("sha"), "body")
        state = named.groupBy("key").agg(F.max_by(F.struct("obs_id", "at", "sha"), F.struct("at", "obs_id")).alias("s")).select("key", "s.*")
        held = self.servers(before=run)
        bodies = named.filter("sha is not null").join(self.read("blobs", before=run).select("sha"), "sha", "left_anti").groupBy("sha").agg(F.min("body").alias("body"))
        self._write(bodies, "blobs", run)
        old = held.select("key", "first_seen", "last_seen", F.col("sha").alias("old"), "observations")
        both = state.join(old, "key", "full_outer")
        new = F.col("obs_id").isNotNull() & (F.col("observations").isNull() | ~F.col("sha").eqNullSafe(F.col("old")))
        self._write(both.filter(new).select("key", "obs_id", "at", "sha"), "observations", run)
        fold = both.select(
            "key", F.least("first_seen", "at").alias("first_seen"), F.greatest("last_seen", "at").alias("last_seen"),
            F.when(F.col("obs_id").isNotNull(), F.col("sha")).otherwise(F.col("old")).alias("sha"), (F.coalesce("observations", F.lit(0)) + new.cast("long")).alias("observations"),
        )
        self._write(fold, "servers", run)
        self._write(self.spark.createDataFrame([(run,)], RUNS), "runs", run)

    def damage(self) -> DataFrame:
        """(sha, fault): bodies that do not hash to their name, and digests of observations without a body."""
        blobs = self.read("blobs").select("sha", "body")
        bad = blobs.filter(~F.sha2("body", 256).eqNullSafe(F.col("sha"))).select("sha", F.lit("damaged").alias("fault"))
        named = self.read("observations").filter("sha is not null").select("sha").distinct()
        return bad.unionByName(named.join(blobs, "sha", "left_anti").select("sha", F.lit("missing").alias("fault")))


def is_empty_folder(spark: SparkSession, path: str) -> bool:
    """Whether nothing lies in a folder, as the file system that holds it says."""
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    fs = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    return not fs.exists(at) or len(fs.listStatus(at)) == 0


def mirror(source: Store, target: Store) -> int:
    """Copy the runs that a mirror lacks, bodies before what names them, a run's entry last; how many.

    Runs do not change, so what is entered in the mirror is not read again; a run that was cut short
    is written over.
    """
    lacking = sorted(r.run for r in source.runs().join(target.runs(), "run", "left_anti").collect())  # one row a run
    for run in lacking:
        for name in TABLES:
            target._write(source._all(name).filter(F.col("of_run") == run).drop("of_run"), name, run)
    return len(lacking)


def retained(snapshots: DataFrame, by: str, most: int = RETAINED) -> DataFrame:
    """The newest ``most`` snapshots: the rest may be removed."""
    return snapshots.orderBy(F.desc(by)).limit(most)


def restore(spark: SparkSession, source: Store, path: str) -> Store:
    """A copy of a store in a folder that must be empty."""
    if not is_empty_folder(spark, path):
        raise ValueError(f"{path} is not empty")
    target = Store(spark, path)
    mirror(source, target)
    return target
