"""Sharding: the law, gapless slots, sizes, and that copies stay together as far as they fit."""

import zlib
from collections import Counter, defaultdict

from pyspark.sql import functions as F

from driftloom.llm import sharding as S
from driftloom.llm.shared import Scratch


def check_law(rows, n, shards=S.SHARDS):
    assert len(rows) == n
    counts = Counter(r.shard for r in rows)
    assert set(counts) <= set(range(shards))
    per = [counts.get(s, 0) for s in range(shards)]
    assert max(per) - min(per) <= 1
    slots = defaultdict(list)
    for r in rows:
        slots[r.shard].append(r.slot)
    assert all(sorted(x) == list(range(len(x))) for x in slots.values())


def test_documents(spark):
    d = "/root/testdata/sf0.01"
    docs = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{d}/documents.parquet").collect()}
    rows = S.op3_sharding(spark, d).collect()
    check_law(rows, len(docs))
    assert all(r.size == len(docs[r.doc_id].encode()) + 16 and r.text_crc32 == zlib.crc32(docs[r.doc_id].encode()) for r in rows)
    where = defaultdict(list)
    for r in rows:
        where[docs[r.doc_id]].append(r.shard)
    pairs = [len(set(x)) for x in where.values() if 1 < len(x) <= 5]
    assert sum(p == 1 for p in pairs) >= 0.9 * len(pairs)


def test_hot_group_nulls_and_repeats(spark):
    rows = [(i, "hot") for i in range(300)] + [(1000 + i, f"text {i}") for i in range(500)] + [(i, None) for i in range(40)] + [(7, "same")] * 30 + [(None, "no id")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = S.balanced_shards(docs, Scratch(spark, "t"), F.when(F.col("text").isNotNull(), F.xxhash64("text")), 8).collect()
    check_law(got, len(rows), 8)


def test_few_rows_and_none(spark):
    docs = spark.createDataFrame([(1, "a"), (2, "a"), (3, None)], "doc_id long, text string")
    check_law(S.balanced_shards(docs, Scratch(spark, "t"), F.xxhash64("text")).collect(), 3)
    assert S.balanced_shards(docs.limit(0), Scratch(spark, "t"), F.xxhash64("text")).count() == 0


def test_propagation_lowers_the_cut(spark):
    units = spark.createDataFrame([(h, 0, s, 1 + (h + s) % 3, s) for h in range(200) for s in (h % 8, (h * 3 + 1) % 8)], "hub long, part int, origin int, n long, shard int").distinct()
    after = S.propagate(units, 8, 2000, Scratch(spark, "t"))
    spread = lambda df: df.groupBy("hub").agg(F.countDistinct("shard").alias("k")).agg(F.sum("k")).first()[0]
    assert spread(after) < spread(units) and after.count() == units.count()
