import random
from datetime import datetime, timedelta

import pytest

from driftloom.operators import divergence, records
from driftloom.operators.snapshots import Store, mirror, restore
from pyspark.sql import functions as F

ROWS = "key long, obs_id long, at timestamp, body string"
BASE = datetime(2024, 1, 1)


def runs(n=3):
    rng = random.Random(4)
    at = iter(range(1000))
    return [[(k, (i := next(at)), BASE + timedelta(hours=i), rng.choice(["a", "b", "c", None])) for k in range(8) if rng.random() < 0.8] for _ in range(n)]


def state(store):
    return [sorted(map(str, store.read(t).drop("of_run").collect())) for t in ("blobs", "observations")] + [sorted(map(str, store.servers().collect()))]


def test_runs_that_are_written_again_change_nothing(spark, tmp_path):
    store, all_runs = Store(spark, str(tmp_path / "s")), runs()
    want, observations = {}, 0
    for k, rows in enumerate(all_runs):
        store.write_run(k, spark.createDataFrame(rows, ROWS))
        once = state(store)
        store.write_run(k, spark.createDataFrame(rows, ROWS))
        assert state(store) == once
        for key, _, at, body in rows:
            fresh = key not in want or want[key][2] != body
            first = want[key][0] if key in want else at
            want[key] = (first, at, body, (want[key][3] if key in want else 0) + fresh)
            observations += fresh
    assert store.read("observations").count() == observations
    bodies = {r.sha: r.body for r in store.read("blobs").collect()}
    assert {r.key: (r.first_seen, r.last_seen, bodies.get(r.sha), r.observations) for r in store.servers().collect()} == want
    assert store.read("blobs").count() == len(bodies)


def test_a_run_that_was_cut_is_not_read(spark, tmp_path):
    store = Store(spark, str(tmp_path / "s"))
    store.write_run(0, spark.createDataFrame([(1, 1, BASE, "a")], ROWS))
    once = state(store)
    store._write(spark.createDataFrame([("x", "y")], "sha string, body string"), "blobs", 1)
    assert state(store) == once
    store.write_run(1, spark.createDataFrame([], ROWS))
    assert state(store) == once and store.damage().collect() == []


def test_mirror_damage_and_restore(spark, tmp_path):
    source, copy = Store(spark, str(tmp_path / "s")), Store(spark, str(tmp_path / "c"))
    for k, rows in enumerate(runs(2)):
        source.write_run(k, spark.createDataFrame(rows, ROWS))
    assert [mirror(source, copy), mirror(source, copy)] == [2, 0] and state(copy) == state(source)
    first = [(r.sha, "changed" if r.body == "a" else r.body) for r in copy.read("blobs").filter("of_run = 0").collect() if r.body != "b"]
    copy._write(spark.createDataFrame(first, "sha string, body string"), "blobs", 0)
    assert sorted(r.fault for r in copy.damage().collect()) == ["damaged", "missing"]
    again = restore(spark, source, str(tmp_path / "r"))
    assert state(again) == state(source)
    with pytest.raises(ValueError):
        restore(spark, source, str(tmp_path / "r"))


def test_events_of_windows_and_the_report(spark):
    rng = random.Random(8)
    events = [(rng.choice([0, 0, 0, 1]), rng.randrange(4000) / 4, f"e{k}") for k in range(600)]
    windows = [(s, a, a + rng.choice([0, 0.75, 3, 300]), f"w{k}") for k, (s, a, _) in enumerate(events[::7])] + [(1, 5.0, 4.0, "backwards")]
    e, w = spark.createDataFrame(events, "session long, at double, id string"), spark.createDataFrame(windows, "session long, start double, end double, call string")
    want = sorted((c, i) for s, a, b, c in windows for t, at, i in events if s == t and a <= at <= b)
    for width in (None, 0.5, 100.0, 1e6):
        assert sorted((r.call, r.id) for r in divergence.in_windows(e, w, "session", width).collect()) == want
    calls = divergence.call_windows(spark.createDataFrame([(1.0, 2.0), (3.0, None)], "start double, end double"))
    assert sorted((r.start, r.end) for r in calls.collect()) == [(1.0, 2.75), (3.0, 3.75)]

    tools = spark.createDataFrame([(1, "a"), (1, "b"), (2, "a"), (2, "c")], "server long, tool string")
    seen = spark.createDataFrame([(1, "a", "network", f"x{k}") for k in range(9)] + [(1, "a", "subprocess", "y"), (2, "a", "network", "z"), (9, "q", "network", "never ran")], "server long, tool string, capability string, evidence string")
    said = spark.createDataFrame([(1, "a", "subprocess"), (1, "b", "network")], "server long, tool string, capability string")
    told = {r["class"]: r for r in divergence.report(tools, seen, said, records.divergence_class(F.col("capability")), ["server", "tool"]).collect()}
    assert {c: (r.tools, r.exercised, r.rate) for c, r in told.items()} == {"all": (2, 4, 0.5), "undeclared_network": (2, 4, 0.5)}
    assert (round(told["all"].low, 4), round(told["all"].high, 4)) == (0.15, 0.85)
    found = {(r.server, r.tool): r.evidence for r in divergence.undeclared(seen, said, ["server", "tool"]).collect()}
    assert found[(1, "a")] == ["x0", "x1", "x2"]
    none = divergence.report(tools.limit(0), seen, said, records.divergence_class(F.col("capability")), ["server", "tool"]).collect()
    assert [(r["class"], r.tools, r.rate, r.low, r.high) for r in none] == [("all", 0, 0.0, 0.0, 0.0)]
