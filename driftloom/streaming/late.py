"""The chain walk as a stream whose facts come late or out of order.

Each fact is a group of its own in an aggregation of Spark's streams: it waits in the state until the
watermark has passed it, as until then an earlier fact may come. Released facts are walked, so the
verdicts are those of the ordered history. Facts behind the watermark are too late: Spark drops them and
counts them, one that comes twice in a batch once.

State is dealt by fact, so a key with a third of all facts is no task of its own, and lies in RocksDB,
whose memory is bounded. The walk divides a key by time (``part``): what a part needs of the parts
before it is joined, from one row a part.
"""

from __future__ import annotations

from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from driftloom.session import own_folder

STATE_STORE = {
    "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    "spark.sql.streaming.stateStore.rocksdb.boundedMemoryUsage": "true",
    "spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled": "true",
}


@contextmanager
def _settings(spark: SparkSession, values: dict[str, str]):
    """Settings for a stream that starts inside; it keeps them, the session gets its own back."""
    was = {k: spark.conf.get(k, None) for k in values}
    for k, v in values.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in was.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def released(steps: DataFrame, delay: str, part: str = "day") -> DataFrame:
    """Steps (key, obs_id, at, content, absent) of a stream, each once the watermark has passed it, with their part.

    ``place`` tells facts of the same key, time and id apart.
    """
    facts = steps.withWatermark("at", delay).groupBy("key", "obs_id", "at").agg(F.collect_list(F.struct("content", "absent")).alias("said"))
    told = facts.select("key", F.date_trunc(part, "at").alias("part"), "obs_id", "at", F.posexplode("said").alias("place", "step"))
    return told.select("key", "part", "obs_id", "at", "step.content", "step.absent", "place")


def landed(spark: SparkSession, source: DataFrame, delay: str, part: str = "day") -> tuple[DataFrame, int]:
    """(steps released so far, facts that came too late) of all input that is there now.

    Steps still within ``delay`` of the latest fact wait in the state for the next run.
    """
    at = own_folder(spark, "late")
    out = released(source, delay, part)
    with _settings(spark, STATE_STORE):
        query = out.writeStream.format("parquet").option("path", f"{at}/rows").option("checkpointLocation", f"{at}/state").outputMode("append").trigger(availableNow=True).start()
        query.awaitTermination()
    dropped = sum(int(s.numRowsDroppedByWatermark) for p in query.recentProgress for s in p.stateOperators)
    return spark.read.schema(out.schema).parquet(f"{at}/rows"), dropped


def verdicts(steps: DataFrame) -> DataFrame:
    """(key, obs_id, verdict) of released steps: each part is walked by itself, from the state that the parts before it leave."""
    order = Window.partitionBy("key", "part").orderBy("at", "obs_id", "place")
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    there = ~F.col("absent")
    last = F.struct("at", "obs_id", "place")
    ends = steps.groupBy("key", "part").agg(F.max_by(F.when(there, F.struct("content")), F.when(there, last)).alias("state"), F.max_by("absent", last).alias("gone"))
    parts = Window.partitionBy("key").orderBy("part")
    carried = ends.select(
        "key", "part", F.last("state", ignorenulls=True).over(parts.rowsBetween(Window.unboundedPreceding, -1)).alias("came"), F.lag("gone").over(parts).alias("was_gone"),
    )
    own = steps.withColumns({"own": F.last(F.when(there, F.struct("content")), ignorenulls=True).over(before), "lag": F.lag("absent").over(order)})
    walked = own.join(carried, ["key", "part"]).withColumns({"state": F.coalesce("own", "came"), "gone": F.coalesce("lag", "was_gone", F.lit(False))})
    had = F.col("state").isNotNull()
    verdict = (
        F.when(F.col("absent") & had & ~F.col("gone"), "disappeared").when(F.col("absent"), None).when(~had, "new").when(F.col("gone"), "returned")
        .when(~F.col("state.content").eqNullSafe(F.col("content")), "mutated")
    )
    return walked.select("key", "obs_id", verdict.alias("verdict")).filter("verdict is not null")
