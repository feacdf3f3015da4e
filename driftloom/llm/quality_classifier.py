"""Quality classifier (operator 9).

Method: random Fourier features approximate a Gaussian kernel over document statistics. Every
partition sums its share of the normal equations, Spark adds the shares, and the driver solves a
ridge system of fixed size. Isotonic regression over score bins calibrates the scores.

All labelled rows count: what reaches the driver is a matrix and a histogram of fixed size.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from driftloom.llm.shared import Scratch, table

#: Random features, kernel width in standard deviations, ridge penalty per row, score bins, seed.
N_FEATURES, WIDTH, PENALTY, BINS, SEED = 192, 2.5, 1e-4, 2048, 11
#: Pseudo-rows of the base rate in each isotonic block.
PRIOR_ROWS = 2.0
LIMIT = 0.3
STATISTICS = ["log_words", "mean_bytes", "sd_bytes", "distinct", "symbols", "digits", "upper", "shout", "stops", "dup_lines", "line_words", "same_next", "non_ascii"]

_CLASS = np.zeros(256, np.int64)
for _k, _set in enumerate((b"#*$%&|<>", b"0123456789", bytes(range(65, 91)), b"!?", b".,;:", bytes(range(128, 256))), 1):
    _CLASS[list(_set)] = _k


def statistics(text: bytes) -> list[float]:
    """STATISTICS of one whole text in UTF-8; an empty text has zeros."""
    words = text.split()
    if not words:
        return [0.0] * len(STATISTICS)
    n = len(words)
    size = np.fromiter(map(len, words), np.int64, n)
    _, symbols, digits, upper, shout, stops, high = np.bincount(_CLASS[np.frombuffer(text, np.uint8)], minlength=7)
    lines = [x for x in text.split(b"\n") if x.strip()]
    same = sum(map(bytes.__eq__, words, words[1:]))
    return [
        float(np.log1p(n)), float(size.mean()), float(size.std()), len(set(words)) / n ** 0.9,
        symbols / n, digits / n, upper / len(text), shout / n, stops / n,
        1 - len(set(lines)) / len(lines), float(np.log1p(n / len(lines))), same / n, high / len(text),
    ]


def statistics_column(text: Column) -> Column:
    """``array<double>`` of STATISTICS; null counts as empty."""

    def stats(texts: pa.Array) -> pa.Array:
        rows = [statistics(t.as_py() or b"") for t in texts.cast(pa.large_binary())]
        flat = pa.array(np.array(rows, np.float64).ravel() if rows else np.empty(0))
        return pa.ListArray.from_arrays(pa.array(np.arange(len(rows) + 1) * len(STATISTICS), pa.int32()), flat)

    return F.arrow_udf(stats, "array<double>")(text)


@dataclass
class Kernel:
    """Random Fourier features of standardised statistics."""

    mean: np.ndarray
    scale: np.ndarray

    def __post_init__(self):
        rng = np.random.default_rng(SEED)
        self.waves = rng.normal(0, 1 / WIDTH, (len(self.mean), N_FEATURES))
        self.phase = rng.uniform(0, 2 * np.pi, N_FEATURES)

    def features(self, x: np.ndarray) -> np.ndarray:
        z = np.clip((x - self.mean) / self.scale, -8, 8)
        return np.c_[np.sqrt(2 / N_FEATURES) * np.cos(z @ self.waves + self.phase), z, np.ones(len(z))]


@dataclass
class Model:
    """Ridge weights and the isotonic steps: a score from ``edges[k]`` on has ``levels[k]``."""

    kernel: Kernel
    weights: np.ndarray
    edges: np.ndarray
    levels: np.ndarray

    def raw(self, x: np.ndarray) -> np.ndarray:
        return self.kernel.features(x) @ self.weights

    def score(self, x: np.ndarray) -> np.ndarray:
        return self.levels[np.clip(np.searchsorted(self.edges, self.raw(x), side="right") - 1, 0, len(self.levels) - 1)]


def _array(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy().reshape(-1, len(STATISTICS))


def _partial_sums(kernel: Kernel):
    """A task's share of the normal equations, a row of the matrix at a time."""

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for b in batches:
            if b.num_rows:
                z = kernel.features(_array(b.column(0)))
                part = z.T @ np.c_[z, b.column(1).to_numpy()]
                total = part if total is None else total + part
        if total is not None:
            yield pa.RecordBatch.from_arrays([pa.array(range(len(total)), pa.int32()), pa.array(list(total), pa.list_(pa.float64()))], ["i", "sums"])

    return sums


def isotonic(good: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """Rising shares of good rows that fit best, by pooling adjacent violators."""
    blocks: list[list[float]] = []
    for g, n in zip(good, rows):
        blocks.append([g, n, 1])
        while len(blocks) > 1 and blocks[-2][0] * blocks[-1][1] >= blocks[-1][0] * blocks[-2][1]:
            g2, n2, k2 = blocks.pop()
            blocks[-1] = [blocks[-1][0] + g2, blocks[-1][1] + n2, blocks[-1][2] + k2]
    base = sum(good) / max(1, sum(rows))
    return np.concatenate([np.full(k, (g + PRIOR_ROWS * base) / (n + PRIOR_ROWS)) for g, n, k in blocks])


def learn(labelled: DataFrame) -> Model | None:
    """Fit a model from rows (stats array<double>, y double 0 or 1); None without rows.

    ``labelled`` is scanned three times, so pass a written table.
    """
    spark = labelled.sparkSession
    moments = labelled.select("y", F.posexplode("stats").alias("i", "x")).groupBy("i").agg(F.avg("x").alias("m"), F.stddev_pop("x").alias("s")).orderBy("i").collect()
    if not moments:
        return None
    kernel = Kernel(np.array([r.m for r in moments]), np.array([max(r.s, 1e-6) for r in moments]))
    parts = labelled.select("stats", "y").mapInArrow(_partial_sums(kernel), "i int, sums array<double>")
    summed = parts.select("i", F.posexplode("sums").alias("j", "x")).groupBy("i", "j").agg(F.sum("x").alias("x")).collect()
    n = 1 + max(r.i for r in summed)
    system = np.zeros((n, n + 1))
    for r in summed:
        system[r.i, r.j] = r.x
    rows = system[n - 1, n - 1]
    weights = np.linalg.solve(system[:, :n] + PENALTY * max(rows, 1.0) * np.eye(n), system[:, n])
    model = Model(kernel, weights, np.zeros(1), np.zeros(1))
    sent = spark.sparkContext.broadcast(model)

    def raw(stats: pa.Array) -> pa.Array:
        return pa.array(sent.value.raw(_array(stats)))

    low, high = -0.5, 1.5
    at = F.greatest(F.lit(0), F.least(F.lit(BINS - 1), F.floor((F.arrow_udf(raw, "double")("stats") - low) / (high - low) * BINS)))
    counts = labelled.select(at.cast("int").alias("bin"), "y").groupBy("bin").agg(F.sum("y").alias("good"), F.count("*").alias("n")).orderBy("bin").collect()
    model.edges = low + (high - low) * np.array([r.bin for r in counts]) / BINS
    model.levels = isotonic(np.array([r.good for r in counts], float), np.array([r.n for r in counts], float))
    return model


def with_score(docs: DataFrame, model: Model | None, stats_col: str = "stats") -> DataFrame:
    """Add ``score``, the chance of label 1 between 0 and 1; 0.5 where nothing was learned."""
    if model is None:
        return docs.withColumn("score", F.lit(0.5))
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def score(stats: pa.Array) -> pa.Array:
        return pa.array(sent.value.score(_array(stats)) if len(stats) else np.empty(0))

    return docs.withColumn("score", F.arrow_udf(score, "double")(stats_col))


def score_documents(docs: DataFrame, labels: DataFrame, scratch: Scratch) -> DataFrame:
    """(doc_id, held_out, score, predicted) for every row of ``docs`` (doc_id, text).

    Labels are learned from rows whose CRC32 of doc_id is no multiple of 5. Null and empty texts
    have statistics of zero and are scored like any other; a null id has no label and is not
    held out. Rows that share an id share its labels; rows with a null label are left out.
    """
    held = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 5 == 0, F.lit(False))
    stats = scratch.cut(docs.select("doc_id", held.alias("held_out"), statistics_column(F.col("text")).alias("stats")), "statistics")
    marks = labels.filter(F.col("quality").isNotNull()).select("doc_id", (F.col("quality") == 1).cast("double").alias("y"))
    model = learn(scratch.cut(stats.filter(~F.col("held_out")).join(marks, "doc_id").select("stats", "y"), "labelled"))
    return with_score(stats, model).select("doc_id", "held_out", "score", (F.col("score") >= LIMIT).cast("int").alias("predicted"))


def op9_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Operator 9 over all of ``documents``."""
    return score_documents(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "labels"), Scratch(spark, "quality"))


QUERIES = {"op9_quality": op9_quality}
ORACLES: dict[str, str] = {}
