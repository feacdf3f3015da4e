"""Operators whose inputs the driver's tables don't have, on small fixtures."""

import random
import json

import pytest
from pyspark.sql import functions as F

from driftloom.functions import canonical as C
from driftloom.functions import text as X
from driftloom.operators import changes, divergence, ingest, severity
from driftloom.sources import landed
from driftloom.streaming import walk


def test_canonical_form():
    a = {"tools": [{"name": "b", "x": 1}, {"name": "a"}], "requestId": 5, "schema": {"properties": {"timestamp": {"default": {"nonce": 1}}}, "required": ["z", "a"]}, "list": [2, 1]}
    out = C.canonical(a)
    assert [t["name"] for t in out["tools"]] == ["a", "b"] and "requestId" not in out
    assert out["schema"] == {"properties": {"timestamp": {"default": {"nonce": 1}}}, "required": ["a", "z"]}
    assert out["list"] == [2, 1]
    assert C.dumps(C.canonical({"é": 1.0})) == '{"é":1.0}'
    with pytest.raises(ValueError):
        C.canonical({"é": 1, "é": 2})


def test_canonical_hash_ignores_key_order(spark):
    docs = [json.dumps({"b": [1, {"z": 1, "a": None}], "a": "x"}), json.dumps({"a": "x", "b": [1, {"a": None, "z": 1}]}), "no json", None]
    got = [r[0] for r in spark.createDataFrame([(d,) for d in docs], "d string").select(C.canonical_hash(F.col("d"))).collect()]
    assert got[0] == got[1] and got[2:] == [None, None]


def test_token_diff_and_names(spark):
    df = spark.createDataFrame([("a b c", "a x c, d"), (None, None)], "b string, a string")
    got = [r[0] for r in df.select(X.token_diff(F.col("b"), F.col("a"))).collect()]
    assert (got[0].added, got[0].removed) == (["x", ",", "d"], ["b"]) and got[1].similarity == 1.0
    assert spark.range(1).select(X.split_name(F.lit("getUser_name-x.y"))).first()[0] == "get User name x y"


def test_reconcile(spark):
    a = spark.createDataFrame([(1, "ok", "h"), (2, "ok", "h"), (3, "timeout", None), (4, "ok", "h")], "key int, status string, hash string")
    b = spark.createDataFrame([(1, "ok", "h"), (2, "ok", "i"), (3, "ok", "h"), (4, "unreachable", None)], "key int, status string, hash string")
    got = {r.key: (r.status, r.note) for r in ingest.reconcile(a, b, "key").collect()}
    assert got == {1: ("ok", None), 2: ("nondeterministic", None), 3: ("ok", "determinism_unverified"), 4: ("unreachable", "first probe: ok")}


def test_flags_and_rules(spark):
    rows = [("c", "schema_param_added", "callbackUrl", None, "where"), ("c", "tool_added", "t", None, "You MUST call this"), ("d", "tool_description_changed", "t", "ab", "abcd"), ("e", "version_bumped", "v", "1", "2")]
    df = spark.createDataFrame(rows, "change_id string, kind string, name string, before string, after string")
    got = {r.change_id: r.flags for r in severity.flags(df).collect()}
    assert got == {"c": ["network_param_added", "imperative_language_added", "tool_count_grew"], "d": ["description_grew_sharply"], "e": []}


def test_traces_windows_and_undeclared(spark, tmp_path):
    lines = ["[pid 7] 10.5 connect(3, {sa_family=AF_INET, ...}) = 0", '11.0 openat(AT_FDCWD, "/home/u/.ssh/id", O_RDONLY) = 3', '12 9.5 execve("/bin/sh") = 0', "noise", '11.2 openat(AT_FDCWD, "/lib/x", O_RDONLY) = 3']
    (tmp_path / "t.txt").write_text("\n".join(lines))
    events = landed.trace_events(spark, f"file://{tmp_path}/t.txt").withColumn("s", F.lit(1))
    windows = spark.createDataFrame([(1, 10.0, 11.5, "fetch")], "s int, start double, end double, tool string")
    seen = divergence.in_windows(events, windows, "s").select("tool", divergence.observed(F.col("call"), F.col("args")).alias("capability"), F.col("args").alias("evidence")).filter("capability is not null")
    said = spark.createDataFrame([("fetch", "fetch a url")], "tool string, d string").select("tool", F.inline(divergence.declared(F.col("d"))))
    assert {r.capability for r in seen.collect()} == {"network", "credential_access"}
    assert [r.capability for r in divergence.undeclared(seen, said, ["tool"]).collect()] == ["credential_access"]


def test_event_frames_and_blobs(spark):
    body = 'event: x\ndata: {"a":\ndata: 1}\n\ndata: nope\n\ndata: [2]\n\n'
    assert spark.createDataFrame([(body,)], "b string").select(landed.event_frames(F.col("b"))).first()[0] == ['{"a":\n1}', "[2]"]
    held = spark.createDataFrame([("x",)], "body string").select(F.sha2("body", 256).alias("sha"), "body")
    assert [r.body for r in landed.new_blobs(held, spark.createDataFrame([("x",), ("y",), ("y",)], "body string")).collect()] == ["y"]
    assert landed.damaged_blobs(held.withColumn("body", F.lit("z"))).count() == 1 and landed.damaged_blobs(held).count() == 0


def test_quotas(spark):
    from tests.quotas import settled

    schema = "s string, k long"
    assert settled({"a": 100, "b": 50, "c": 3}, 30) == {"a": 17, "b": 10, "c": 3}
    rng = random.Random(4)
    cases = [({"a": 100, "b": 50, "c": 3}, 30), ({"a": 1000, "b": 10, "c": 10}, 40), ({"a": 2, "b": 3}, 40), ({"a": 50, "b": 50, "c": 50}, 3), ({}, 10)]
    cases += [({f"s{i}": rng.choice([1, 4, 5, 6, 30, 31, 500]) for i in range(9)}, rng.choice([10, 60, 300])) for _ in range(6)]
    for sizes, total in cases:
        got = changes.quotas(spark.createDataFrame(list(sizes.items()), schema), "s", "k", total).collect()
        assert {r.s: r.quota for r in got} == settled(sizes, total), (sizes, total)


def test_stream_equals_batch(spark, sf, tmp_path):
    from driftloom.operators import chain
    from driftloom.plans.catalog import event_steps

    steps = event_steps(spark, sf)
    steps.coalesce(1).write.parquet(f"file://{tmp_path}/in")
    stream = walk.stream_verdicts(spark.readStream.schema(steps.schema).parquet(f"file://{tmp_path}/in"))
    q = stream.writeStream.format("memory").queryName("walked").outputMode("append").option("checkpointLocation", f"file://{tmp_path}/c").trigger(availableNow=True).start()
    q.awaitTermination(120)
    want = sorted((r.key, r.obs_id, r.verdict) for r in chain.verdicts(steps).collect())
    assert sorted((r.key, r.obs_id, r.verdict) for r in spark.sql("select * from walked").collect()) == want
