"""Appending snapshots: what is new, what is absent, folds of current state, high-water marks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def new_versions(held: DataFrame, incoming: DataFrame, keys: list[str], stamp: str) -> DataFrame:
    """Rows of ``incoming`` that ``held`` lacks; a null stamp equals a null stamp."""
    left, right = incoming.alias("l"), held.select(*keys, stamp).alias("r")
    same = F.col(f"l.{stamp}").eqNullSafe(F.col(f"r.{stamp}"))
    for k in keys:
        same &= F.col(f"l.{k}") == F.col(f"r.{k}")
    return left.join(right, same, "left_anti")


def restatements(held: DataFrame, fresh: DataFrame, key: str, stamp: str) -> DataFrame:
    """New rows whose (key, stamp) is known with another content."""
    return fresh.join(held.select(key, stamp).distinct(), [key, stamp], "left_semi")


def absent_keys(known: DataFrame, seen: DataFrame, key: str) -> DataFrame:
    """Known keys that a complete run did not see."""
    return known.join(seen.select(key), key, "left_anti")


def fold_servers(rows: DataFrame, key: str, identity: list[str], at: str, seq: str) -> DataFrame:
    """One row a key: first and last time seen, identity of the last row."""
    return rows.groupBy(key).agg(
        F.min(at).alias("first_seen"),
        F.max(at).alias("last_seen"),
        *[F.max_by(c, F.struct(at, seq)).alias(c) for c in identity],
    )


def first_identities(rows: DataFrame, columns: list[str], at: str, seq: str) -> DataFrame:
    """The first row of each distinct identity; null fields equal an empty one."""
    folded = [F.coalesce(F.col(c).cast("string"), F.lit("")) for c in columns]
    w = Window.partitionBy(*folded).orderBy(at, seq)
    return rows.withColumn("_n", F.row_number().over(w)).filter("_n = 1").drop("_n")


def water_mark(runs: DataFrame, complete: Column, overlap_s: int) -> DataFrame:
    """Start of the last complete run less the overlap; one row, null if there is no such run."""
    start = F.max(F.when(complete, F.col("started_at")))
    return runs.agg((start - F.make_dt_interval(secs=F.lit(overlap_s))).alias("mark"))


def reconcile(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    """One observation for each double probe (columns key, status, hash on both sides).

    The second probe's failure stands; a first failure leaves a note; differing hashes make the
    row nondeterministic; else it is ok.
    """
    both = a.select(key, F.col("status").alias("a_status"), F.col("hash").alias("a_hash")).join(
        b.select(key, F.col("status").alias("b_status"), F.col("hash").alias("b_hash")), key
    )
    b_failed, a_failed = F.col("b_status") != "ok", F.col("a_status") != "ok"
    differ = ~F.col("a_hash").eqNullSafe(F.col("b_hash"))
    return both.withColumns({
        "status": F.when(b_failed, F.col("b_status")).when(~a_failed & differ, "nondeterministic").otherwise("ok"),
        "note": F.when(b_failed & (F.col("a_status") != F.col("b_status")), F.concat(F.lit("first probe: "), "a_status")).when(~b_failed & a_failed, "determinism_unverified"),
        "hash": F.when(~b_failed, F.col("b_hash")),
        "first_hash": F.when(~b_failed & ~a_failed & differ, F.col("a_hash")),
    }).select(key, "status", "note", "hash", "first_hash")
