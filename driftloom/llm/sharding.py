"""Sharding (operator 3).

Method: balanced label propagation. Documents that share a hub (here: an equal text) are linked;
in each round a join gives every unit of linked documents the shard that most of its neighbours
are in, and moves are admitted under quotas of the shards' capacity, so sizes stay even while cut
edges fall. Law: ``rows``, the shards' row counts differ by one at most.

A unit is the documents of one hub that started in one shard: they have the same neighbours, so
they move together and the iteration runs over pre-aggregated counts. A hub with more documents
than half a shard is split by a hash of doc_id into parts that find shards of their own; at most
two such hubs a shard exist, so their list is bounded by the number of shards.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from driftloom.llm.shared import Scratch, table

SHARDS, ROUNDS = 40, 6
#: Rows that one task numbers (about).
BUCKET_ROWS = 50_000
#: Bytes that each document counts beside its text.
OVERHEAD = 16


def _uniform(*cols: str) -> Column:
    """A number in [0, 1) by a hash of columns."""
    return F.pmod(F.xxhash64(*cols), F.lit(1 << 30)) / F.lit(float(1 << 30))


def propagate(units: DataFrame, shards: int, rows: int, scratch: Scratch, rounds: int = ROUNDS) -> DataFrame:
    """Labels of units (hub, part, origin, n, shard) after balanced label propagation.

    ``n`` counts documents; ``rows`` counts all documents, linked or not. In each round a unit
    wishes to join the shard with most documents of its (hub, part). The wishes for a shard are
    admitted in the share that its room allows: its capacity less its linked documents that stay.
    """
    units, capacity = scratch.cut(units, "units-0"), rows / shards
    for k in range(rounds):
        size = units.groupBy("hub", "part", "shard").agg(F.sum("n").alias("n"))
        # Ties fall by a hash, so they spread over the shards.
        best = F.struct("n", F.xxhash64("hub", "part", "shard").alias("tie"))
        wish = size.groupBy("hub", "part").agg(F.max_by("shard", best).alias("wish"))
        asked = scratch.cut(units.join(wish, ["hub", "part"]), f"asked-{k}")
        flow = asked.groupBy("shard", "wish").agg(F.sum("n").alias("n")).collect()  # shards squared at most
        moving = sum(r.n for r in flow if r.shard != r.wish)
        if not moving:
            return units
        stay = {s: sum(r.n for r in flow if r.shard == r.wish == s) for s in range(shards)}
        wanted = {s: sum(r.n for r in flow if r.wish == s != r.shard) for s in range(shards)}
        share = [min(1.0, max(0.0, capacity - stay[s]) / wanted[s]) if wanted[s] else 0.0 for s in range(shards)]
        admitted = F.col("wish") != F.col("shard")
        admitted &= _uniform("hub", "part", "origin", "shard") < F.get(F.array(*map(F.lit, share)), F.col("wish"))
        units = scratch.cut(asked.withColumn("shard", F.when(admitted, F.col("wish")).otherwise(F.col("shard"))).drop("wish"), f"units-{k + 1}")
        scratch.drop(f"asked-{k}")
        scratch.drop(f"units-{k}")
    return units


def _numbered(docs: DataFrame, shards: int, rows: int) -> DataFrame:
    """Add ``rank``: places in the order of (label, side), gapless from 0.

    Linked rows stand between two halves of the rows without links, so that evening out shard
    borders moves the latter. Rows are numbered in hashed buckets of bounded size; bucket counts give each its start.
    """
    buckets = max(1, -(-rows // (shards * BUCKET_ROWS)))
    keyed = docs.withColumn("bucket", F.pmod(F.xxhash64("hub", "part", "origin", "linked"), F.lit(buckets)).cast("int"))
    key = ["label", "side", "bucket"]
    counts = keyed.groupBy(key).agg(F.count("*").alias("n"))
    before = Window.partitionBy("label").orderBy("side", "bucket").rowsBetween(Window.unboundedPreceding, -1)
    inside = counts.withColumn("before", F.coalesce(F.sum("n").over(before), F.lit(0)))
    totals = {r.label: r.n for r in counts.groupBy("label").agg(F.sum("n").alias("n")).collect()}  # one row a shard
    starts = [sum(totals.get(s, 0) for s in range(k)) for k in range(shards)]
    start = F.get(F.array(*[F.lit(s).cast("long") for s in starts]), F.col("label"))
    order = Window.partitionBy(*key).orderBy("hub", "part", "doc_id", "text_crc32", "size")
    numbered = keyed.withColumn("at", F.row_number().over(order).cast("long") - 1)
    return numbered.join(inside.drop("n"), key).withColumn("rank", start + F.col("before") + F.col("at"))


def balanced_shards(docs: DataFrame, scratch: Scratch, hub: Column, shards: int = SHARDS, rounds: int = ROUNDS) -> DataFrame:
    """(doc_id, size, text_crc32, shard, slot) for every row of ``docs`` (doc_id, text).

    Rows with the same ``hub`` are linked; a null hub has no links. Size is the text's UTF-8
    bytes (null: none) plus OVERHEAD. Slots count from 0 in each shard. Row counts of shards
    differ by one at most; with fewer rows than shards, the last shards are empty. Repeated rows
    and ids are rows of their own; an empty table gives no rows.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    base = docs.select(
        "doc_id",
        (F.octet_length(text) + OVERHEAD).cast("long").alias("size"),
        F.crc32(text).alias("text_crc32"),
        hub.alias("hub"),
    ).withColumn("origin", F.pmod(F.xxhash64("doc_id", "text_crc32"), F.lit(shards)).cast("int"))
    base = scratch.cut(base, "rows")
    rows = base.count()
    half = max(1, rows // (2 * shards))
    sizes = base.filter("hub is not null").groupBy("hub").agg(F.count("*").alias("n")).filter("n > 1")
    sizes = scratch.cut(sizes, "hubs")
    large = {r.hub: -(-r.n // half) for r in sizes.filter(F.col("n") > half).collect()}  # two a shard at most
    part = F.lit(0)
    for h, parts in large.items():
        part = F.when(F.col("hub") == h, F.pmod(F.xxhash64("doc_id", F.lit(17)), F.lit(parts)).cast("int")).otherwise(part)
    split = base.withColumn("part", part)
    counted = split.filter("hub is not null").groupBy("hub", "part", "origin").agg(F.count("*").alias("n"))
    linked = counted.join(sizes.select("hub"), "hub", "left_semi").withColumn("shard", F.col("origin"))
    units = propagate(linked, shards, rows, scratch, rounds).select("hub", "part", "origin", F.col("shard").alias("to"))
    labelled = split.join(units, ["hub", "part", "origin"], "left").select(
        "*", F.coalesce("to", "origin").alias("label"), F.when(F.col("to").isNull(), F.pmod(F.xxhash64("doc_id", F.lit(5)), F.lit(2)) * 2).otherwise(1).cast("int").alias("side"),
        F.when(F.col("to").isNull(), F.xxhash64("doc_id")).alias("linked"),
    )
    ranked = _numbered(scratch.cut(labelled.drop("to"), "labelled"), shards, rows)
    # Shards are even slices of the order: the first rows % shards have one row more.
    low, more = divmod(rows, shards)
    rank, cut = F.col("rank"), more * (low + 1)
    late = more + F.floor((rank - cut) / F.lit(max(1, low)))
    shard = F.when(rank < cut, F.floor(rank / F.lit(low + 1))).otherwise(late).cast("int")
    first = F.when(F.col("shard") < more, F.col("shard").cast("long") * (low + 1)).otherwise(cut + (F.col("shard").cast("long") - more) * low)
    return ranked.withColumn("shard", shard).select("doc_id", "size", "text_crc32", "shard", (rank - first).alias("slot"))


def op3_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Operator 3 over all of ``documents``: equal texts are linked, 40 shards of even row counts."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = balanced_shards(docs, Scratch(spark, "sharding"), F.when(F.col("text").isNotNull(), F.xxhash64("text")))
    return found.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


QUERIES = {"op3_sharding": op3_sharding}
ORACLES: dict[str, str] = {}
