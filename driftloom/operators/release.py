"""What is published: policy outcomes, concentration, consensus, spans, draws and what may be shown."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from driftloom.functions.fixed import HIGH_SIGNAL_FLAGS

# Pinning policies and the kinds of change that pass without approval.
POLICIES = [
    ("whole_manifest", []),
    ("per_tool", ["tool_added"]),
    ("description_exempt", ["tool_description_changed", "server_description_changed"]),
    ("additive_exempt", ["tool_added", "schema_param_added"]),
    ("permissive", ["tool_added", "schema_param_added", "tool_description_changed", "server_description_changed"]),
]
#: Share of a policy's blocks from which one namespace is reported as concentrated.
CONCENTRATED = 0.2


def policy_table(like: DataFrame) -> DataFrame:
    return like.sparkSession.createDataFrame(POLICIES, "policy string, exempt array<string>")


def _replayed(changes: DataFrame, keys: list[str], policies: DataFrame) -> DataFrame:
    """Counts of change sets by kinds and flags first, then each policy over these few sets."""
    sets = changes.groupBy(*keys, F.array_sort(F.array_distinct("kinds")).alias("kinds"), F.array_sort(F.array_distinct("flags")).alias("flags")).agg(F.count("*").alias("n"))
    crossed = sets.join(F.broadcast(policies))  # a literal table of five rows
    high = F.arrays_overlap("flags", F.array(*map(F.lit, HIGH_SIGNAL_FLAGS)))
    return crossed.withColumns({"blocked": F.exists("kinds", lambda k: ~F.array_contains("exempt", k)), "flagged": F.size("flags") > 0, "high": high})


def _count(test: Column) -> Column:
    return F.sum(F.when(test, F.col("n")).otherwise(0)).cast("long")


def outcomes(changes: DataFrame, policies: DataFrame) -> DataFrame:
    """Outcome of each policy over change sets (kinds, flags): two bounds of the benefit, and friction.

    ``caught`` counts blocked sets with any flag, ``caught_high`` those with a high-signal flag.
    """
    out = _replayed(changes, [], policies).groupBy("policy").agg(
        _count(F.col("blocked")).alias("blocked"), _count(~F.col("blocked")).alias("passed"), _count(F.col("blocked") & F.col("flagged")).alias("caught"),
        _count(F.col("blocked") & F.col("high")).alias("caught_high"), _count(~F.col("blocked") & F.col("flagged")).alias("missed"),
    )
    return out.withColumn("friction", friction(F.col("blocked"), F.col("caught")))


def friction(blocked: Column, caught: Column) -> Column:
    return F.when(caught > 0, (blocked - caught) / caught)


def caught_by_flag(changes: DataFrame, policies: DataFrame) -> DataFrame:
    """(policy, flag, n): blocked change sets that carry each flag."""
    rows = _replayed(changes, [], policies).filter("blocked").select("policy", F.explode("flags").alias("flag"), "n")
    return rows.groupBy("policy", "flag").agg(F.sum("n").alias("n"))


def concentration(changes: DataFrame, policies: DataFrame, namespace: str) -> DataFrame:
    """For each policy the namespace with the most blocks, its share, and the friction without it.

    Of equal ones the least name is the top. ``concentrated`` warns from a share of ``CONCENTRATED`` on.
    """
    each = _replayed(changes, [namespace], policies).groupBy("policy", namespace).agg(_count(F.col("blocked")).alias("blocked"), _count(F.col("blocked") & F.col("flagged")).alias("caught"))
    top = F.min(F.struct((-F.col("blocked")).alias("less"), F.col(namespace).alias("name"), F.col("caught").alias("caught"))).alias("top")
    all_ = each.groupBy("policy").agg(F.sum("blocked").alias("blocked"), F.sum("caught").alias("caught"), top)
    n = -F.col("top.less")
    share = F.when(F.col("blocked") > 0, n / F.col("blocked"))
    return all_.select(
        "policy", F.col("top.name").alias("top"), n.alias("top_blocked"), share.alias("share"),
        friction(F.col("blocked") - n, F.col("caught") - F.col("top.caught")).alias("friction_without"), F.coalesce(share >= CONCENTRATED, F.lit(False)).alias("concentrated"),
    )


def identical_outcomes(found: DataFrame) -> DataFrame:
    """One row: whether all policies have the same numbers, which makes their comparison empty."""
    return found.agg((F.countDistinct(F.struct("blocked", "passed", "caught", "missed")) == 1).alias("identical"))


def layer_metrics(rows: DataFrame) -> DataFrame:
    """One row over change sets (key, changes: how many, flags, quarantined).

    Every server with a change set counts as tracked. Quarantined sets count as transitions only;
    ``flagged_rate`` is of changed transitions.
    """
    counts = (~F.col("quarantined")) & (F.col("changes") > 0)
    out = rows.agg(
        F.count("*").alias("transitions"), F.countDistinct("key").alias("servers"), F.count_if(F.col("quarantined")).alias("quarantined_transitions"),
        F.count_if(counts).alias("changed"), F.countDistinct(F.when(counts, F.col("key"))).alias("servers_changed"), F.count_if(counts & (F.size("flags") > 0)).alias("flagged"),
    )
    rate = lambda a, b: F.when(F.col(b) > 0, F.col(a) / F.col(b)).otherwise(0.0)
    return out.withColumns({"mutation_rate": rate("servers_changed", "servers"), "flagged_rate": rate("flagged", "changed")})


def consensus(opinions: DataFrame, item: str, label: str) -> DataFrame:
    """(item, label) of items that have one distinct label among those who gave one; one rater is enough."""
    seen = opinions.filter(F.col(label).isNotNull()).groupBy(item).agg(F.min(label).alias("low"), F.max(label).alias("high"))
    return seen.filter("low = high").select(item, F.col("low").alias(label))


def precision(machine: DataFrame, truth: DataFrame, item: str, label: str, deferred: str = "deferred") -> DataFrame:
    """(label, hits, right, precision) of machine labels against the consensus; deferred ones are left out first."""
    joined = machine.filter(F.col(label) != deferred).select(item, F.col(label).alias("said")).join(truth.select(item, F.col(label).alias("true")), item)
    out = joined.groupBy(F.col("said").alias(label)).agg(F.count("*").alias("hits"), F.count_if(F.col("said") == F.col("true")).alias("right"))
    return out.withColumn("precision", F.col("right") / F.col("hits"))


def spans(rows: DataFrame, by: str, observed: str, effective: str, now: Column) -> DataFrame:
    """Days that each ``by`` was collected for (first observed until now), and days that its records span."""
    days = lambda a, b: (F.unix_micros(b.cast("timestamp")) - F.unix_micros(a.cast("timestamp"))) / F.lit(86_400_000_000.0)
    return rows.groupBy(by).agg(days(F.min(observed), now).alias("collected_days"), days(F.min(effective), F.max(effective)).alias("span_days"))


def top(rows: DataFrame, name: str, k: int) -> DataFrame:
    """The ``k`` most frequent names by (-count, name): a report."""
    return rows.groupBy(name).agg(F.count("*").alias("n")).orderBy(F.desc("n"), name).limit(k)


def seeded(key: Column, seed: int) -> Column:
    """A fixed order of keys for a seed, the same in every engine."""
    return F.md5(F.concat_ws("|", F.lit(str(seed)), key.cast("string")))


def calibration_draw(pool: DataFrame, key: str, flagged: str, total: int, seed: int, held: DataFrame | None = None) -> DataFrame:
    """Half of ``total`` from flagged rows, the rest from plain ones, in seeded order; (pool row, stratum).

    Items that are ``held`` stay as they are: they are not drawn again. The least of each stratum
    are found in parts of the stratum first, so no task ranks a whole stratum.
    """
    if held is not None:
        pool = pool.join(held.select(key), key, "left_anti")
    rows = pool.withColumns({"_order": seeded(F.col(key), seed), "stratum": F.when(F.col(flagged), "flagged").otherwise("plain")})
    half = total // 2
    quota = F.when(F.col("stratum") == "flagged", half).otherwise(total - half)
    part = Window.partitionBy("stratum", F.substring("_order", 1, 2)).orderBy("_order", key)
    few = rows.withColumn("_n", F.row_number().over(part)).filter(F.col("_n") <= max(half, total - half))
    whole = Window.partitionBy("stratum").orderBy("_order", key)
    return few.withColumn("_n", F.row_number().over(whole)).filter(F.col("_n") <= quota).drop("_n", "_order")


def published(found: DataFrame, allowed: list[str], masked: dict[str, str]) -> DataFrame:
    """Only the allowed columns, the masked ones overwritten by a fixed text."""
    return found.select(*[F.when(F.col(c).isNotNull(), F.lit(masked[c])).alias(c) if c in masked else F.col(c) for c in allowed])
