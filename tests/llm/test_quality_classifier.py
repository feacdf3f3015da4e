"""The quality classifier by held-out accuracy, isotonic steps and empty inputs."""

import zlib

import numpy as np
from pyspark.sql import functions as F

from driftloom.llm import quality_classifier as C
from driftloom.llm.shared import Scratch


def test_held_out_accuracy(spark):
    d = "/root/testdata/sf0.01"
    got = C.op9_quality(spark, d)
    labels = spark.read.parquet(f"{d}/labels.parquet")
    rows = got.filter("held_out").join(labels, "doc_id").collect()
    assert len(rows) > 50
    assert sum(r.predicted == r.quality for r in rows) / len(rows) > 0.9
    good, bad = [[r.score for r in rows if r.quality == q] for q in (1, 0)]
    assert np.mean([(a > b) + 0.5 * (a == b) for a in good for b in bad]) > 0.92
    assert all(0 <= r.score <= 1 for r in rows)


def test_isotonic_is_rising_and_keeps_the_mean():
    rng = np.random.default_rng(3)
    rows = rng.integers(1, 20, 50).astype(float)
    good = np.minimum(rows, rng.integers(0, 20, 50))
    fit = C.isotonic(good, rows)
    assert len(fit) == 50 and (np.diff(fit) >= -1e-12).all() and ((fit >= 0) & (fit <= 1)).all()


def test_partial_sums_are_the_whole_sum(spark):
    rng = np.random.default_rng(1)
    x = rng.normal(size=(500, len(C.STATISTICS)))
    y = (x[:, 0] + 0.5 * x[:, 1] ** 2 > 0.3).astype(float)
    table = spark.createDataFrame([(r.tolist(), float(v)) for r, v in zip(x, y)], "stats array<double>, y double").repartition(7)
    model = C.learn(table)
    assert ((model.score(x) >= 0.5) == (y == 1)).mean() > 0.93


def test_nulls_empties_and_no_labels(spark):
    docs = spark.createDataFrame([(1, None), (2, ""), (2, ""), (None, "some text here"), (4, "x" * 200_000)], "doc_id long, text string")
    none = spark.createDataFrame([], "doc_id long, quality int")
    got = C.score_documents(docs, none, Scratch(spark, "t")).collect()
    assert len(got) == 5 and {r.score for r in got} == {0.5}
    some = spark.createDataFrame([(1, 1), (2, 0), (4, None), (None, 1), (7, 1)], "doc_id long, quality int")
    got = C.score_documents(docs, some, Scratch(spark, "t")).collect()
    assert len(got) == 5 and all(0 <= r.score <= 1 for r in got)
    assert C.score_documents(docs.limit(0), some, Scratch(spark, "t")).count() == 0


def test_scores_against_plain_numpy(spark, sf):
    """The whole fit again on one machine: standardised statistics, cosine features, ridge by least squares, pooled steps."""
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text")
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    stats = {r.doc_id: np.array(r.s) for r in docs.select("doc_id", C.statistics_column(F.col("text")).alias("s")).collect()}
    train = [i for i in stats if labels.get(i) is not None and zlib.crc32(str(i).encode()) % 5]
    x, y = np.array([stats[i] for i in train]), np.array([float(labels[i] == 1) for i in train])
    mean, scale = x.mean(axis=0), np.maximum(x.std(axis=0), 1e-6)
    rng = np.random.default_rng(C.SEED)
    waves, phase = rng.normal(0, 1 / C.WIDTH, (x.shape[1], C.N_FEATURES)), rng.uniform(0, 2 * np.pi, C.N_FEATURES)

    def features(v):
        z = np.clip((v - mean) / scale, -8, 8)
        return np.concatenate([np.sqrt(2 / C.N_FEATURES) * np.cos(z @ waves + phase), z, np.ones((len(z), 1))], axis=1)

    f = features(x)
    wide = np.concatenate([f, np.sqrt(C.PENALTY * len(x)) * np.eye(f.shape[1])])
    weights = np.linalg.lstsq(wide, np.concatenate([y, np.zeros(f.shape[1])]), rcond=None)[0]
    at = lambda v: np.clip(np.floor((features(v) @ weights + 0.5) / 2 * C.BINS), 0, C.BINS - 1).astype(int)
    good, n = np.bincount(at(x), y, C.BINS), np.bincount(at(x), minlength=C.BINS)
    there = np.flatnonzero(n)
    # Rising shares by minima of maxima of means, the closed form of isotonic regression.
    g, m = np.r_[0, np.cumsum(good[there])], np.r_[0, np.cumsum(n[there])]
    k = len(there)
    level = [max(min((g[b] - g[a]) / (m[b] - m[a]) for b in range(i + 1, k + 1)) for a in range(i + 1)) for i in range(k)]
    block = {v: ([i for i in range(k) if abs(level[i] - v) < 1e-12]) for v in level}
    steps = [(sum(good[there[i]] for i in block[v]) + C.PRIOR_ROWS * y.mean()) / (sum(n[there[i]] for i in block[v]) + C.PRIOR_ROWS) for v in level]
    got = {r.doc_id: r.score for r in C.op9_quality(spark, sf).collect()}
    ids = sorted(stats)
    place = at(np.array([stats[i] for i in ids]))
    want = [steps[max(0, int(np.searchsorted(there, p, side="right")) - 1)] for p in place]
    off = [i for i, w in zip(ids, want) if abs(got[i] - w) > 1e-6]
    assert set(got) == set(ids) and len(off) <= len(ids) // 100  # rows at the very edge of a bin
