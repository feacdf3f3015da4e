"""The chain walk as a stream: state per key, in-order input, same verdicts as in batch."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from driftloom.session import own_folder

OUTPUT = "key long, obs_id long, verdict string"
STATE = "content string, seen boolean, gone boolean"


def _walk(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    content, seen, gone = state.get if state.exists else (None, False, False)
    rows = pd.concat(list(batches)).sort_values(["at", "obs_id"])
    out = []
    for r in rows.itertuples():
        if r.absent:
            if seen and not gone:
                out.append((key[0], r.obs_id, "disappeared"))
            gone = True
            continue
        verdict = "new" if not seen else "returned" if gone else "mutated" if r.content != content else None
        if verdict:
            out.append((key[0], r.obs_id, verdict))
        content, seen, gone = r.content, True, False
    state.update((content, seen, gone))
    yield pd.DataFrame(out, columns=["key", "obs_id", "verdict"])


def stream_verdicts(steps: DataFrame) -> DataFrame:
    """Verdicts of a stream of steps (key, obs_id, at, content, absent) that comes in order."""
    return steps.groupBy("key").applyInPandasWithState(_walk, OUTPUT, STATE, "append", GroupStateTimeout.NoTimeout)


def landed(spark: SparkSession, stream: DataFrame) -> DataFrame:
    """What a stream gives for all input that is there now, as a table in the shared folder.

    The sink and its checkpoint are there too, so a query that is stopped goes on where it was.
    """
    at = own_folder(spark, "stream")
    query = stream.writeStream.format("parquet").option("path", f"{at}/rows").option("checkpointLocation", f"{at}/state").outputMode("append").trigger(availableNow=True).start()
    query.awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{at}/rows")
