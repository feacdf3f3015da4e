"""Operators that make no pairs and rank in parts, against plain loops; draws against a seeded order."""

import hashlib
import json
import random
from datetime import datetime, timedelta

from pyspark.sql import functions as F

from driftloom.functions import canonical
from driftloom.operators import changes, divergence, documents, exercise, listings, records, stats
from tests.quotas import settled

BASE = datetime(2024, 1, 1)


def test_predecessors(spark):
    rng = random.Random(5)
    rows = []
    for k in range(300):
        a = BASE + timedelta(days=rng.randrange(120))
        b = a + timedelta(days=rng.choice([0, 0, 1, 5, 40]))
        rows.append((k, rng.choice(["r1", "r2", None]), rng.choice(["e1", "e2", None]), a, b))
    got = {r.key: r.predecessor for r in changes.predecessors(spark.createDataFrame(rows, "key long, repo string, endpoint string, first_seen timestamp, last_seen timestamp")).collect()}
    want = {}
    for key, repo, end, first, _ in rows:
        for col, own in ((1, repo), (2, end)):
            old = [r[0] for r in rows if own is not None and r[col] == own and r[0] != key and r[4] <= first]
            if old and key not in want:
                want[key] = min(old)
    assert got == want


def test_counts_in_windows(spark):
    rng = random.Random(6)
    events = [(rng.randrange(3), BASE + timedelta(minutes=30 * rng.randrange(300))) for _ in range(400)]
    windows = [(s, k, a, a + timedelta(hours=rng.choice([0, 1, 30]))) for k, (s, a) in enumerate(events[::3])]
    got = divergence.counts_in_windows(
        spark.createDataFrame(windows, "user long, call long, start timestamp, end timestamp"), spark.createDataFrame(events, "user long, at timestamp"), "user", "call")
    assert {r.call: r.n for r in got.collect()} == {k: n for s, k, a, b in windows if (n := sum(u == s and a <= t <= b for u, t in events))}


def test_stratified_draw_in_seeded_order(spark, monkeypatch):
    monkeypatch.setattr(changes, "RANK_PARTS", 7)
    rows = [(k, "abc"[min(2, k % 11 // 4)]) for k in range(400)]
    got = changes.stratified(spark.createDataFrame(rows, "key long, s string"), "s", "key", 60, 9).collect()
    sizes = {s: sum(x == s for _, x in rows) for s in "abc"}
    want = set()
    for s, quota in settled(sizes, 60).items():
        order = sorted((hashlib.md5(f"9|{k}".encode()).hexdigest(), k) for k, x in rows if x == s)
        want |= {(k, s) for _, k in order[:quota]}
    assert {(r.key, r.s) for r in got} == want and len(got) == 60


def test_medians(spark):
    for values in ([3.0], [1.0, 2.0], [5.0, 1.0, 1.0, 9.0, 2.0], [None, 4.0, 8.0]):
        df = spark.createDataFrame([(v,) for v in values], "x double")
        known = sorted(v for v in values if v is not None)
        assert stats.median(df, "x").first()[0] == (known[(len(known) - 1) // 2] + known[len(known) // 2]) / 2
    assert stats.median(spark.createDataFrame([], "x double"), "x").first()[0] is None


def test_renames_need_parameters_or_descriptions(spark):
    def doc(*tools):
        return json.dumps({"tools": [dict(name=n, **t) for n, t in tools]})

    same = {"inputSchema": {"properties": {"q": {"type": "string"}}}}
    cases = [
        (1, doc(("x", {}), ("p", {})), doc(("y", {}), ("q", {}))),
        (2, doc(("x", {"inputSchema": {"properties": {}}})), doc(("y", {"inputSchema": {"properties": {}}}))),
        (3, doc(("x", same)), doc(("y", same))),
        (4, doc(("x", {"description": "one two three"})), doc(("y", {"description": "one two four"}))),
    ]
    df = spark.createDataFrame(cases, "k long, b string, a string")
    b, a = (documents.members(df, ["k"], c, "tools", "name") for c in "ba")
    assert sorted((r.transition, r.old, r.new) for r in documents.renames(b, a, "k").collect()) == [("3", "x", "y"), ("4", "x", "y")]


def test_first_parameter_of_a_tool(spark):
    was, now = ({"tools": [{"name": " t\u00a0", "inputSchema": {"properties": p, "required": list(p)}}]} for p in ({}, {"token": {}}))
    df = spark.createDataFrame([(1, json.dumps(was), json.dumps(now))], "k long, b string, a string")
    b, a = (documents.members(df, ["k"], c, "tools", "name") for c in "ba")
    found = documents.parameter_changes(documents.parameters(b, ["k"]), documents.parameters(a, ["k"]), ["k"], tools=(b, a))
    assert sorted(r.kind for r in found.collect()) == ["param_became_required", "schema_param_added"] and a.first()["name"] == "t"


def test_secrets_are_true_and_named(spark):
    doc = {"server": {"packages": [{"environmentVariables": [{"isSecret": True}, {"name": "A", "isSecret": "true"}, {"name": "B", "isSecret": False}, {"name": "C", "isSecret": True}]}],
                      "remotes": [{"url": "u", "headers": [{"name": "H", "isSecret": True}]}, {"url": "u"}]}}
    df = spark.createDataFrame([(json.dumps(doc),)], "d string")
    r = df.select(listings.secret_inputs(F.col("d")).alias("s"), listings.endpoints(F.col("d")).alias("l"), listings.endpoints(F.col("d"), distinct=True).alias("e")).first()
    assert (r.s, r.l, r.e) == (["env:C", "header:H"], ["u", "u"], ["u"])


def test_canonical_form_never_fails_a_task(spark):
    docs = ['"\\ud800"', "[" * 5000 + "]" * 5000, '{"a":1}', '{"a":NaN}']
    df = spark.createDataFrame([(d,) for d in docs], "d string")
    assert [r[0] for r in df.select(canonical.canonical_json(F.col("d"))).collect()] == [None, None, '{"a":1}', None]
    policy = canonical.Policy(volatile_paths=frozenset({("tools", "[]", "_meta", "*")}))
    assert canonical.canonical({"tools": [{"name": "a", "_meta": {"x": 1}}], "etag": 2}, policy) == {"tools": [{"name": "a", "_meta": {}}], "etag": 2}


def test_arguments_of_nested_schemas(spark):
    deep = {"type": "object", "required": ["x"], "properties": {"x": None}}
    for _ in range(6):
        deep = {"type": "object", "required": ["x"], "properties": {"x": deep}}
    schemas = [
        {"required": ["a", "b", "c"], "properties": {"a": {"enum": [3]}, "b": {"type": "array", "minItems": 1, "items": {"type": "boolean"}}, "c": {"const": None}}},
        deep, None, {"required": ["p", "e"], "properties": {"p": {"type": "string", "minLength": 30}, "e": {"format": "email"}}},
    ]
    df = spark.createDataFrame([(None if s is None else json.dumps(s),) for s in schemas], "s string")
    got = [r[0] for r in df.select(exercise.arguments(F.col("s"))).collect()]
    assert json.loads(got[0].arguments) == {"a": 3, "b": [False], "c": None}
    assert got[1].arguments is None and "deeper" in got[1].problem and got[2].arguments == "{}"
    assert json.loads(got[3].arguments) == {"p": "driftloom-probe-value".ljust(30, "x"), "e": "driftloom-probe@driftloom-synthetic.invalid"}


def test_runs_and_failures(spark):
    rows = spark.createDataFrame([(1, "ok"), (2, "timeout"), (3, None)], "k long, status string")
    assert [r.k for r in records.failures(rows, "status").collect()] == [2]
    latest = spark.createDataFrame([(1, True), (2, False), (3, None)], "k long, latest boolean")
    assert sorted(r.k for r in records.current_only(latest, "latest").collect()) == [1, 3]
