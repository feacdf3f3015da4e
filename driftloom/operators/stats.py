"""Summaries: histograms with empty buckets, nearest-rank quantiles, agreement, intervals."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from driftloom.session import own_folder

#: 97.5th percentile of the normal distribution, for 95 % intervals.
Z95 = 1.959963984540054


def histogram(rows: DataFrame, value: Column, ceilings: list[tuple[str, float | None]]) -> DataFrame:
    """Counts by the first ceiling that a value does not exceed; every bucket has a row."""
    bucket = F.lit(len(ceilings) - 1)
    for k in range(len(ceilings) - 1, -1, -1):
        if ceilings[k][1] is not None:
            bucket = F.when(value <= ceilings[k][1], F.lit(k)).otherwise(bucket)
    counts = rows.filter(value.isNotNull()).groupBy(bucket.alias("k")).agg(F.count("*").alias("n"))
    names = rows.sparkSession.createDataFrame([(k, n) for k, (n, _) in enumerate(ceilings)], "k int, bucket string")
    return names.join(counts, "k", "left").select("bucket", F.coalesce("n", F.lit(0)).cast("long").alias("n"))


def elements_at(rows: DataFrame, value: str, places) -> DataFrame:
    """(fraction, value): elements of the sorted values; ``places`` gives (fraction, place) pairs for their number.

    Values are counted first and the counts written for the three passes over them: edges of ranges,
    totals of ranges, and the running count inside a range. No task sorts more than a range.
    """
    counts, at = rows.filter(F.col(value).isNotNull()).groupBy(F.col(value).alias("v")).agg(F.count("*").alias("c")), own_folder(rows.sparkSession, "counts")
    counts.write.mode("overwrite").parquet(at)
    counts = rows.sparkSession.read.schema(counts.schema).parquet(at)
    edges = counts.stat.approxQuantile("v", [k / 64 for k in range(1, 64)], 0.01)
    part = reduce(lambda a, e: a + (F.col("v") > F.lit(e)).cast("int"), sorted(set(edges)), F.lit(0))
    ranged = counts.withColumn("part", part)
    before, total = {}, 0
    for r in ranged.groupBy("part").agg(F.sum("c").alias("c")).orderBy("part").collect():
        before[r.part], total = total, total + r.c
    if not total:
        return rows.sparkSession.createDataFrame([], f"fraction double, {value} double")
    start = F.element_at(F.create_map(*[F.lit(x).cast("long") for kv in before.items() for x in kv]), F.col("part").cast("long"))
    upto = F.sum("c").over(Window.partitionBy("part").orderBy("v")) + start
    wanted = F.explode(F.array(*[F.struct(F.lit(float(f)).alias("fraction"), F.lit(p).cast("long").alias("place")) for f, p in places(total)]))
    placed = ranged.withColumns({"to": upto}).select("v", "c", "to", wanted.alias("w"))
    return placed.filter((F.col("w.place") < F.col("to")) & (F.col("w.place") >= F.col("to") - F.col("c"))).select(F.col("w.fraction").alias("fraction"), F.col("v").cast("double").alias(value))


def nearest_rank(rows: DataFrame, value: str, fractions: list[float]) -> DataFrame:
    """(fraction, value): the element at min(n - 1, floor(f * n)) of the sorted values."""
    return elements_at(rows, value, lambda n: [(f, min(n - 1, int(f * n))) for f in fractions])


def median(rows: DataFrame, value: str) -> DataFrame:
    """One row: the mean of the two middle values, which are one for an odd number; null without values."""
    middle = elements_at(rows, value, lambda n: [(0, (n - 1) // 2), (1, n // 2)])
    return middle.agg(F.avg(value).alias(f"median_{value}"))


def kappa(pairs: DataFrame, a: str, b: str, by: list[str] | None = None) -> DataFrame:
    """Cohen's kappa of two raters' labels: n, observed, expected, kappa (null if expected is 1)."""
    by = by or []
    cells = pairs.filter(F.col(a).isNotNull() & F.col(b).isNotNull()).groupBy(*by, F.col(a).alias("a"), F.col(b).alias("b")).agg(F.count("*").alias("n"))
    margins_a = cells.groupBy(*by, F.col("a").alias("_label")).agg(F.sum("n").alias("na"))
    margins_b = cells.groupBy(*by, F.col("b").alias("_label")).agg(F.sum("n").alias("nb"))
    chance = margins_a.join(margins_b, [*by, "_label"]).groupBy(*by).agg(F.sum(F.col("na") * F.col("nb")).alias("both"))
    seen = cells.groupBy(*by).agg(F.sum("n").alias("n"), F.sum(F.when(F.col("a") == F.col("b"), F.col("n")).otherwise(0)).alias("agree"))
    joined = seen.join(chance, by, "left") if by else seen.crossJoin(F.broadcast(chance))  # one row each
    observed = F.col("agree") / F.col("n")
    expected = F.coalesce(F.col("both"), F.lit(0)) / (F.col("n").cast("double") * F.col("n"))
    return joined.filter("n > 0").select(
        *by, "n", observed.alias("observed"), expected.alias("expected"),
        F.when(expected < 1, (observed - expected) / (1 - expected)).alias("kappa"),
    )


def rater_pairs(opinions: DataFrame, item: str, rater: str, label: str) -> DataFrame:
    """(first, second, a, b): labels of each two raters, by name, of the same item; an item joins with its few raters."""
    side = lambda who, what: opinions.filter(F.col(label).isNotNull()).select(item, F.col(rater).alias(who), F.col(label).alias(what))
    return side("first", "a").join(side("second", "b"), item).filter("first < second")


def kappa_gate(pairs: DataFrame, least: float, items: int) -> DataFrame:
    """(first, second, n, kappa, passes): whether two raters agree well enough on enough items."""
    told = kappa(pairs, "a", "b", ["first", "second"])
    return told.select("first", "second", "n", "kappa", F.coalesce((F.col("n") >= items) & (F.col("kappa") >= least), F.lit(False)).alias("passes"))


def wilson(hits: Column, n: Column, z: float = Z95) -> tuple[Column, Column]:
    """Bounds of the Wilson interval; (0, 0) without trials."""
    p = hits / n
    scale = 1 + z * z / n
    centre = (p + z * z / (2 * n)) / scale
    half = z / scale * F.sqrt(p * (1 - p) / n + z * z / (4 * n * n))
    low, high = F.greatest(F.lit(0.0), centre - half), F.least(F.lit(1.0), centre + half)
    return F.when(n > 0, low).otherwise(0.0), F.when(n > 0, high).otherwise(0.0)
