import os
import random
from datetime import datetime, timedelta

import pytest

from driftloom.operators import chain
from driftloom.sources.tail import tail
from driftloom.streaming import late
from driftloom.streaming.ledger import Ledger

BASE = datetime(2024, 1, 1)
STEPS = "key long, obs_id long, at timestamp, content string, absent boolean"


def history(n, seed=3):
    rng = random.Random(seed)
    # Key 0 holds half of all steps.
    return [(rng.choice([0, 0, 0, 1, 2, 3]), k, BASE + timedelta(minutes=rng.randrange(60 * 24 * 20)), rng.choice(["a", "b", None]), rng.random() < 0.2) for k in range(n)]


def test_a_walk_in_parts_is_the_walk(spark):
    steps = spark.createDataFrame(history(900), STEPS)
    pick = lambda df: sorted((r.key, r.obs_id, r.verdict, r.from_obs, str(r.from_at), str(r.from_content), r.change_id) for r in df.collect())
    for more in ({}, {"unchanged": True}):
        assert pick(chain.verdicts(steps, part="day", **more)) == pick(chain.verdicts(steps, **more))


def test_late_facts_give_the_ordered_walk(spark, tmp_path):
    rows = history(400)
    end = max(r[2] for r in rows)
    rng = random.Random(1)
    waves = {}
    for r in rows:
        waves.setdefault((r[2] + timedelta(hours=rng.randrange(48)) - BASE).days // 3, []).append(r)
    for k in sorted(waves):
        part = waves[k][:]
        rng.shuffle(part)
        spark.createDataFrame(part, STEPS).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema(STEPS).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
    out, dropped = late.landed(spark, stream, "48 hours")
    mark = end - timedelta(hours=48)
    got = sorted((r.key, r.obs_id, r.verdict) for r in late.verdicts(out.filter(f"at < timestamp'{mark}'")).collect())
    want = sorted((r.key, r.obs_id, r.verdict) for r in chain.verdicts(spark.createDataFrame(rows, STEPS)).filter(f"at < timestamp'{mark}'").collect())
    assert dropped == 0 and got == want and len(got) > 100


def test_what_is_too_late_is_counted(spark, tmp_path):
    waves = [[(1, 1, BASE, "a", False), (1, 2, BASE + timedelta(days=9), "b", False)], [(2, 3, BASE + timedelta(days=9), "c", False)], [(1, 4, BASE + timedelta(days=1), "late", False), (1, 5, BASE + timedelta(days=20), "d", False)]]
    for w in waves:
        spark.createDataFrame(w, STEPS).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    out, dropped = late.landed(spark, spark.readStream.schema(STEPS).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in"), "1 day")
    assert dropped == 1 and sorted(r.obs_id for r in out.collect()) == [1, 2, 3]


def test_a_batch_that_is_replayed_or_cut_adds_nothing(spark, tmp_path):
    kept = Ledger(spark, str(tmp_path / "l"), "k long, stamp string, v string")
    sink = kept.sink(["k"], "stamp")
    rows = lambda *r: spark.createDataFrame(list(r), "k long, stamp string, v string")
    sink(rows((1, "a", "x"), (1, None, "y"), (1, None, "y"), (2, "a", "z")), 0)
    sink(rows((1, None, "again"), (3, "b", "w")), 1)
    first = sorted(map(str, kept.rows().collect()))
    assert len(first) == 4
    sink(rows((1, "a", "x"), (1, None, "y"), (1, None, "y"), (2, "a", "z")), 0)
    kept.write_rows(rows((9, "c", "cut")), 2)
    assert sorted(map(str, kept.rows().collect())) == first
    sink(rows((9, "c", "whole"), (3, "b", "w")), 2)
    assert sorted(map(str, kept.rows().collect())) == sorted([*first, str(rows((9, "c", "whole")).first())])


def test_files_are_read_on_from_their_mark(spark, tmp_path):
    a, b = tmp_path / "a.log", tmp_path / "b.log"
    a.write_bytes("one\ntwo é\nthr".encode())
    b.write_bytes(b"")
    lines, marks = tail(spark, str(tmp_path))
    assert [r.line for r in lines.orderBy("at").collect()] == ["one", "two é"]
    seen, held = [], spark.createDataFrame(marks.collect(), marks.schema)
    with open(a, "ab") as f:
        f.write(b"ee\n\nfour\npart")
    b.write_bytes(b"x\n")
    lines, marks = tail(spark, str(tmp_path), held)
    seen = sorted((os.path.basename(r.path), r["at"], r.line) for r in lines.collect())
    assert seen == [("a.log", 0, "three"), ("a.log", 1, ""), ("a.log", 2, "four"), ("b.log", 0, "x")]
    held = spark.createDataFrame(marks.collect(), marks.schema)
    lines, marks = tail(spark, str(tmp_path), held)
    assert lines.collect() == [] and sorted(map(tuple, marks.collect())) == sorted(map(tuple, held.collect()))
    a.write_bytes(b"anew\n")
    lines, _ = tail(spark, str(tmp_path), held)
    assert [r.line for r in lines.collect()] == ["anew"]


@pytest.mark.parametrize("most,want", [(1000, ["aaa", "bbb", "ccc"]), (9, ["bbb", "ccc"]), (8, ["ccc"]), (2, [])])
def test_the_tail_of_a_trace_drops_the_line_it_cuts(spark, tmp_path, most, want):
    (tmp_path / "t.log").write_bytes(b"aaa\nbbb\nccc\n")
    lines, _ = tail(spark, str(tmp_path), most=most)
    assert [r.line for r in lines.orderBy("at").collect()] == want


def test_late_facts_wait_in_native_state(spark, tmp_path):
    rows = [(1, 1, BASE, "a", False), (1, 1, BASE, "b", False), (2, 1, BASE, None, True), (1, 2, BASE + timedelta(days=9), "c", False)]
    spark.createDataFrame(rows, STEPS).coalesce(1).write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema(STEPS).parquet(f"{tmp_path}/in")
    assert "Pandas" not in late.released(stream, "1 day")._jdf.queryExecution().analyzed().toString()
    before = {k: spark.conf.get(k, None) for k in late.STATE_STORE}
    out, dropped = late.landed(spark, stream, "1 day")
    assert dropped == 0 and sorted((r.key, r.content or "", r.place) for r in out.collect()) == [(1, "a", 0), (1, "b", 1), (2, "", 0)]
    assert before == {k: spark.conf.get(k, None) for k in late.STATE_STORE}
