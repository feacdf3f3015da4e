import numpy as np
from pyspark.sql import functions as F

from driftloom.llm import neighbours
from driftloom.llm.shared import Scratch, table

KIND = "vec_id long, embedding array<float>, u string, v int"


def brute(rows, most=neighbours.NEAREST, every=20):
    wide = max((len(v) for _, v in rows), default=0)
    ids = np.array([i for i, _ in rows])
    x = np.array([[*v, *[0.0] * (wide - len(v))] for _, v in rows], float)
    out = {}
    for k in np.flatnonzero(ids % every == 0):
        score = np.array([(x[j] * x[k]).sum() for j in range(len(ids))])
        order = [j for j in np.lexsort((ids, -score)) if ids[j] != ids[k]][:most]
        out[int(ids[k])] = [(int(ids[j]), float(score[j])) for j in order]
    return out


def recall(found, want):
    by = {}
    for r in found:
        by.setdefault(r.query_id, []).append((r["rank"], r.vec_id, r.score))
    assert set(by) == set(want)
    share = []
    for q, rows in by.items():
        rows.sort()
        assert [r[0] for r in rows] == list(range(1, len(rows) + 1)) and len(rows) == len(want[q])
        assert [(-s, i) for _, i, s in rows] == sorted((-s, i) for _, i, s in rows)
        share.append(len({i for _, i, _ in rows} & {i for i, _ in want[q]}) / max(1, len(rows)))
    return np.mean(share)


def test_query_recall_and_scores(spark, sf):
    rows = [(r.vec_id, r.embedding) for r in table(spark, sf, "embeddings").collect()]
    found = neighbours.op11_neighbours(spark, sf).collect()
    assert recall(found, brute(rows)) >= 0.9
    at = {i: np.array(v, float) for i, v in rows}
    assert max(abs(r.score - at[r.query_id] @ at[r.vec_id]) for r in found) < 1e-12


def test_lengths_that_differ_and_a_large_group_of_copies(spark):
    rng = np.random.default_rng(2)
    x = rng.standard_normal((700, 12)) * rng.lognormal(0, 0.7, (700, 1))
    x[200:430] = x[200]
    rows = [(k, v) for k, v in enumerate(x.astype(np.float32).tolist())]
    df = spark.createDataFrame([(*r, "", 0) for r in rows], KIND).repartition(5)
    found = neighbours.nearest(df, F.col("id") % 20 == 0, Scratch(spark, "t")).collect()
    want = brute(rows)
    assert recall(found, want) >= 0.9
    ties = [r.vec_id for r in sorted((r for r in found if r.query_id == 220), key=lambda r: r["rank"])]
    assert ties == [i for i, _ in want[220]]


def test_odd_rows(spark):
    nan, inf = float("nan"), float("inf")
    rows = [
        (0, [1.0, 0.0], "", 0), (1, [1.0, 0.0], "", 0), (1, [1.0, 0.0], "", 0), (2, [0.5], "", 1), (3, None, "", 0), (4, [nan, 1.0], "", 0), (5, [inf, 1.0], "", 0),
        (6, [None, 1.0], "", 0), (7, [0.0, 0.0], "", 0), (8, [], "", 0), (None, [1.0, 1.0], "", 0), (20, [-1.0, 0.0], "", 0), (20, [0.0, 2.0], "", 0), (40, None, "", 0),
    ]
    found = neighbours.nearest(spark.createDataFrame(rows, KIND), F.col("id") % 20 == 0, Scratch(spark, "t")).collect()
    of = lambda q: sorted((r["rank"], r.vec_id, r.score) for r in found if r.query_id == q)
    assert of(0) == [(1, 1, 1.0), (2, 2, 0.5), (3, 20, 0.0), (4, 20, -1.0)]
    assert {r.query_id for r in found} == {0, 20} and len(of(20)) == 6
    for few in ([], [(20, [1.0], "", 0)], [(20, None, "", 0)]):
        assert neighbours.nearest(spark.createDataFrame(few, KIND), F.col("id") % 20 == 0, Scratch(spark, "t")).collect() == []
