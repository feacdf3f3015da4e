"""Quality rules (operator 7), native: only DataFrame functions.

Method: learned decision lists. Sequential covering grows conjunctions of threshold conditions
on text statistics from labelled rows, prunes them on rows held back, and emits an ordered
Spark conditional expression. All counts are Spark aggregates over every labelled row; only
histograms of a fixed size (features x buckets) reach the driver.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from driftloom.llm.shared import WORD_GAP, Scratch, table, whole_row

#: Limits of the contract: at least so many words, at most so many percent of them repeated.
MIN_WORDS, MAX_REPEAT_PERCENT = 10, 20
#: Words of a window that is looked for again in the same text.
WINDOW = 5
#: Learning: quantile buckets of a feature, rules, conditions of a rule.
BUCKETS, MAX_RULES, MAX_CONDITIONS = 48, 8, 3
#: A rule stays if, on the rows held back, so much of what it rejects is labelled bad, and if
#: it covers so much of the bad rows (and so many).
MIN_PRECISION, MIN_COVER, MIN_ROWS = 0.98, 0.005, 5

BASE = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
FEATURES = ["words", "mean_chars", "symbol_rate", "dup_line_rate", "repeat_rate", "upper_rate", "distinct_rate", "shout_rate"]


def with_statistics(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """Add the statistics ``BASE`` and ``FEATURES`` of each whole text.

    Words are runs of characters other than ASCII white space. A null text has none, so all its
    counts are 0. Windows are compared by XXH64 of their words' XXH64 within one text. Input
    columns with these names (or starting with ``_q_``) are replaced.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    words = F.array_remove(F.split(text, WORD_GAP + "+"), "")
    lines = F.filter(F.split(text, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    d = docs.withColumns({"_q_words": words, "_q_lines": lines})
    d = d.withColumns({
        "n_words": F.size("_q_words").cast("long"),
        "word_chars": F.length(F.array_join("_q_words", "")).cast("long"),
        "n_symbols": (F.length(text) - F.length(F.regexp_replace(text, r"[#*$%&|<>]", ""))).cast("long"),
        "_q_n_lines": F.size("_q_lines"),
        "n_dup_lines": (F.size("_q_lines") - F.size(F.array_distinct("_q_lines"))).cast("long"),
        "_q_upper": F.length(text) - F.length(F.regexp_replace(text, r"\p{Lu}", "")),
        "_q_shout": F.length(text) - F.length(F.regexp_replace(text, "[!?]", "")),
        "_q_distinct": F.size(F.array_distinct("_q_words")),
        "_q_hash": F.transform("_q_words", lambda w: F.xxhash64(w)),
    })
    at = lambda i, k: F.get(F.col("_q_hash"), i + k)
    starts = F.when(F.col("n_words") >= WINDOW, F.sequence(F.lit(0), (F.col("n_words") - WINDOW).cast("int"))).otherwise(F.array().cast("array<int>"))
    d = d.withColumn("_q_windows", F.transform(starts, lambda i: F.xxhash64(*[at(i, k) for k in range(WINDOW)])))
    # Most texts repeat no window; only the others are sorted.
    repeats = F.size(F.array_distinct("_q_windows")) < F.size("_q_windows")
    ordered = F.array_sort(F.transform("_q_windows", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    d = d.withColumn("_q_sorted", F.when(repeats, ordered).otherwise(F.array().cast("array<struct<h:bigint,i:int>>")))
    same = lambda x, i: F.coalesce(F.get(F.col("_q_sorted"), i)["h"] == x["h"], F.lit(False))
    twice = F.filter("_q_sorted", lambda x, i: same(x, i - 1) | same(x, i + 1))
    d = d.withColumn("_q_starts", F.array_sort(F.transform(twice, lambda x: x["i"])))
    gap = F.transform("_q_starts", lambda s, i: F.least(F.lit(WINDOW), F.coalesce(F.get(F.col("_q_starts"), i + 1) - s, F.lit(WINDOW))))
    d = d.withColumn("n_repeat_words", F.aggregate(gap, F.lit(0).cast("long"), lambda a, x: a + x))
    per = lambda x, n: F.coalesce(F.try_divide(F.col(x).cast("double"), F.col(n)), F.lit(0.0))
    d = d.withColumns({
        "words": F.col("n_words").cast("double"),
        "mean_chars": per("word_chars", "n_words"),
        "symbol_rate": per("n_symbols", "n_words"),
        "dup_line_rate": per("n_dup_lines", "_q_n_lines"),
        "repeat_rate": per("n_repeat_words", "n_words"),
        "upper_rate": per("_q_upper", "word_chars"),
        "distinct_rate": per("_q_distinct", "n_words"),
        "shout_rate": per("_q_shout", "n_words"),
    })
    return d.drop(*[c for c in d.columns if c.startswith("_q_")])


def base_failed() -> Column:
    """The contract's two fixed limits."""
    return (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words"))


@dataclass(frozen=True)
class Condition:
    """``feature > limit`` or ``feature <= limit``."""

    feature: str
    above: bool
    limit: float

    def column(self) -> Column:
        c = F.col(self.feature)
        return c > F.lit(self.limit) if self.above else c <= F.lit(self.limit)

    def __str__(self) -> str:
        return f"{self.feature} {'>' if self.above else '<='} {self.limit:.6g}"


def all_of(conditions: list[Condition] | tuple[Condition, ...]) -> Column:
    out = F.lit(True)
    for c in conditions:
        out = out & c.column()
    return out


@dataclass(frozen=True)
class DecisionList:
    """Ordered rules; the first that holds rejects, and a row that none covers is kept."""

    rules: tuple[tuple[Condition, ...], ...]

    def verdict(self) -> Column:
        if not self.rules:
            return F.lit(True)
        out = F.when(all_of(self.rules[0]), F.lit(False))
        for rule in self.rules[1:]:
            out = out.when(all_of(rule), F.lit(False))
        return out.otherwise(F.lit(True))

    def rule_number(self) -> Column:
        """Number of the rule that decides, from 1; 0 where none does."""
        out = F.lit(0)
        for k in range(len(self.rules), 0, -1):
            out = F.when(all_of(self.rules[k - 1]), F.lit(k)).otherwise(out)
        return out


def _gain(p0: int, n0: int, p1: int, n1: int) -> float:
    """FOIL's information gain of narrowing (p0 bad, n0 good) to (p1, n1)."""
    if not p1:
        return 0.0
    return p1 * (math.log2(p1 / (p1 + n1)) - math.log2(p0 / (p0 + n0)))


def _bucketed(rows: DataFrame, edges: dict[str, list[float]]) -> DataFrame:
    """Add ``buckets``: for each feature, how many of its edges its value exceeds."""
    count = lambda f: F.size(F.filter(F.array(*map(F.lit, edges[f])), lambda e: F.col(f) > e))
    return rows.withColumn("buckets", F.array(*map(count, FEATURES)))


def _best(rows: DataFrame, edges: dict[str, list[float]]) -> Condition | None:
    """The condition with the largest gain over ``rows`` (columns: features, ``bad``, ``buckets``)."""
    counts = rows.select("bad", F.posexplode("buckets").alias("f", "b")).groupBy("f", "b").agg(F.count_if("bad").alias("p"), F.count_if(~F.col("bad")).alias("n")).collect()
    found, best = None, 1e-9
    for k, f in enumerate(FEATURES):
        mine = {r.b: (r.p, r.n) for r in counts if r.f == k}
        p0, n0 = sum(p for p, _ in mine.values()), sum(n for _, n in mine.values())
        p1 = n1 = 0
        for b, edge in enumerate(edges[f]):
            p, n = mine.get(b, (0, 0))
            p1, n1 = p1 + p, n1 + n
            for above, (pp, nn) in ((False, (p1, n1)), (True, (p0 - p1, n0 - n1))):
                if (g := _gain(p0, n0, pp, nn)) > best:
                    found, best = Condition(f, above, edge), g
    return found


def _relaxed(rows: DataFrame, rule: list[Condition]) -> list[Condition]:
    """Move each limit to the middle of the gap between what it admits and the good rows beyond.

    Quantile edges sit on values of one class; the middle leaves unseen good rows more room.
    """
    def ends(k: int, c: Condition) -> Column:
        rest, v = all_of(rule[:k] + rule[k + 1 :]), F.col(c.feature)
        side = lambda bad, above: rest & (F.col("bad") == bad) & ((v > c.limit) if above else (v <= c.limit))
        if c.above:
            return F.struct(F.min(F.when(side(True, True), v)).alias("near"), F.max(F.when(side(False, False), v)).alias("far"))
        return F.struct(F.max(F.when(side(True, False), v)).alias("near"), F.min(F.when(side(False, True), v)).alias("far"))

    found = rows.agg(*[ends(k, c).alias(f"c{k}") for k, c in enumerate(rule)]).first()
    return [
        Condition(c.feature, c.above, (x.near + x.far) / 2) if x.near is not None and x.far is not None else c
        for c, x in zip(rule, found)
    ]


def learn(labelled: DataFrame) -> DecisionList:
    """Learn a decision list from rows with ``FEATURES``, ``doc_id`` and boolean ``bad``.

    ``labelled`` is scanned some tens of times, so pass a written table. Two thirds of the rows,
    by a hash of ``doc_id``, grow rules; the others prune and judge them. No labelled rows, or
    rows of one class only, give the empty list, which keeps everything.
    """
    third = F.pmod(F.xxhash64("doc_id"), F.lit(3))
    rows = labelled.withColumn("held", third == 0)
    quantiles = [k / BUCKETS for k in range(1, BUCKETS)]
    first = rows.agg(
        F.count_if("bad").alias("p"),
        F.count_if(~F.col("bad")).alias("n"),
        *[F.percentile_approx(F.when(F.col("bad"), F.col(f)), quantiles, 2000).alias(f"p_{f}") for f in FEATURES],
        *[F.percentile_approx(F.when(~F.col("bad"), F.col(f)), quantiles, 2000).alias(f"n_{f}") for f in FEATURES],
    ).first()
    if not first.p or not first.n:
        return DecisionList(())
    edges = {f: sorted({*first[f"p_{f}"], *first[f"n_{f}"]}) for f in FEATURES}
    least = max(MIN_ROWS, MIN_COVER * first.p)
    rules: list[tuple[Condition, ...]] = []
    left = _bucketed(rows, edges)
    while len(rules) < MAX_RULES:
        rule: list[Condition] = []
        grow = left.filter(~F.col("held"))
        while len(rule) < MAX_CONDITIONS and (c := _best(grow, edges)):
            rule.append(c)
            grow = grow.filter(c.column())
        if not rule:
            break
        ends = [all_of(rule[: k + 1]) for k in range(len(rule))]
        judged = left.filter("held").agg(*[
            F.struct(F.count_if(F.col("bad") & e).alias("p"), F.count_if(~F.col("bad") & e).alias("n")).alias(f"c{k}") for k, e in enumerate(ends)
        ]).first()
        worth = [(x.p - x.n) / (x.p + x.n) if x.p + x.n else -1.0 for x in judged]
        keep = worth.index(max(worth))
        p, n = judged[keep].p, judged[keep].n
        if not p or p / (p + n) < MIN_PRECISION or p < least / 3:
            break
        rule = _relaxed(left, rule[: keep + 1])
        rules.append(tuple(rule))
        left = left.filter(~all_of(rule))
    return DecisionList(tuple(rules))


def labelled_rows(statistics: DataFrame, labels: DataFrame) -> DataFrame:
    """Rows to learn from: statistics of labelled documents, ``bad`` where ``quality`` is 0.

    A document counts once for each of its labels, so contradictory ones pull both ways; null ids and
    null labels teach nothing.
    """
    marks = labels.filter(F.col("doc_id").isNotNull() & F.col("quality").isNotNull()).select("doc_id", (F.col("quality") == 0).alias("bad"))
    return statistics.select("doc_id", *FEATURES).join(marks, "doc_id")


def learn_for(docs: DataFrame, labels: DataFrame, scratch: Scratch) -> DecisionList:
    """Learn from the labelled rows of ``docs``.

    Statistics are computed before the join with the labels, so no text is shuffled.
    """
    rows = with_statistics(docs.select("doc_id", "text")).select("doc_id", *FEATURES)
    return learn(scratch.cut(labelled_rows(scratch.cut(rows, "statistics"), labels), "labelled"))


def verdicts(statistics: DataFrame, rules: DecisionList) -> DataFrame:
    """Add ``base_failed``, ``rule`` (number of the learned rule that holds, else 0) and ``kept``."""
    return statistics.withColumns({
        "base_failed": base_failed(),
        "rule": rules.rule_number(),
        "kept": ~base_failed() & rules.verdict(),
    })


def kept_rows(docs: DataFrame, rules: DecisionList) -> DataFrame:
    """Rows of ``docs`` that are kept, with the same columns."""
    row = docs.select(whole_row(docs).alias("_row"), F.col("text").alias("_text"))
    # A filter moves below deterministic projections and takes copies of their expressions along,
    # here one inside another; a row number keeps it above them.
    judged = verdicts(with_statistics(row, "_text"), rules).withColumn("_row_no", F.monotonically_increasing_id())
    return judged.filter(F.col("kept") & (F.col("_row_no") >= 0)).select("_row.*")


def op7_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Operator 7 over all of ``documents``: statistics once, rules learned from them, verdicts."""
    scratch = Scratch(spark, "quality-rules")
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    stats = scratch.cut(with_statistics(docs).drop("text"), "statistics")
    rules = learn(scratch.cut(labelled_rows(stats, table(spark, sf_dir, "labels")), "labelled"))
    return verdicts(stats, rules).select("doc_id", *BASE, "base_failed", "kept", "rule")


QUERIES = {"op7_quality_rules": op7_quality_rules}
ORACLES: dict[str, str] = {}
