"""Set and map differences between two states, renames, policies, sampling, selection."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from driftloom.functions.typed import changed_members


def named_diff(before: DataFrame, after: DataFrame, keys: list[str], name: str, value: str) -> DataFrame:
    """Members by name: ``added``, ``removed``, ``changed`` or ``same``, with both values."""
    b = before.select(*keys, name, F.col(value).alias("before"), F.lit(True).alias("in_before"))
    a = after.select(*keys, name, F.col(value).alias("after"), F.lit(True).alias("in_after"))
    status = (
        F.when(F.col("in_before").isNull(), "added")
        .when(F.col("in_after").isNull(), "removed")
        .when(~F.col("before").eqNullSafe(F.col("after")), "changed")
        .otherwise("same")
    )
    return b.join(a, [*keys, name], "full_outer").select(*keys, name, status.alias("status"), "before", "after")


def json_keys_changed(before: Column, after: Column) -> Column:
    """Sorted top-level keys whose values differ between two JSON objects as Python compares; null is absent."""
    return changed_members(before, after, "python")


def predecessors(identities: DataFrame) -> DataFrame:
    """(key, predecessor): another key that ended before this one began, by repository, else endpoint.

    The repository wins, then the least key. No pairs are made: the ends and beginnings of an
    identity are one sequence in time, and what counts at a beginning is the least key that has
    ended. A month of an identity is one sequence; the months before it come as their minimum.
    """
    found = None
    for rank, col in enumerate(("repo", "endpoint")):
        best = _least_ended(identities.select(F.col(col).alias("id"), "key", "first_seen", "last_seen").filter("id is not null"))
        best = best.select("key", F.lit(rank).alias("rank"), "old")
        found = best if found is None else found.unionByName(best)
    return found.groupBy("key").agg(F.min_by("old", "rank").alias("predecessor"))


def _least_ended(spans: DataFrame) -> DataFrame:
    """(key, old): the least other key of the same ``id`` that ended at or before the key's beginning."""
    event = lambda t, begins: F.struct(F.col(t).alias("t"), F.lit(begins).alias("begins"))
    events = spans.select("id", "key", F.inline(F.array(event("last_seen", 0), event("first_seen", 1)))).withColumn("part", F.date_trunc("month", F.col("t").cast("timestamp")))
    ended = F.when(F.col("begins") == 0, F.col("key"))
    order = Window.partitionBy("id", "part").orderBy("t", "begins", "key")
    upto, past = order.rowsBetween(Window.unboundedPreceding, 0), order.rowsBetween(Window.unboundedPreceding, -1)
    following = F.when((F.lead("begins").over(order) == 0) & (F.lead("t").over(order) == F.col("t")), F.lead("key").over(order))
    # A key can end at its own beginning; if it is the least, the next least is beside its end.
    seen = events.withColumns({"least": F.min(ended).over(upto), "others": F.least(F.min(ended).over(past), following)})
    parts = events.groupBy("id", "part").agg(F.min(ended).alias("own"))
    earlier = Window.partitionBy("id").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    before = parts.select("id", "part", F.min("own").over(earlier).alias("before"))
    joined = seen.join(before, ["id", "part"])
    at = joined.groupBy("key").agg(
        F.max(F.when(F.col("begins") == 1, F.least("least", "before"))).alias("least"), F.max(F.when(F.col("begins") == 0, F.least("others", "before"))).alias("others")
    )
    old = F.when(F.col("least") != F.col("key"), F.col("least")).otherwise(F.col("others"))
    return at.filter("least is not null").select("key", old.alias("old")).filter("old is not null")


#: Parts of a group that are ranked by themselves before the few that are left are ranked together.
RANK_PARTS = 64


def first_of(rows: DataFrame, group: str, order: list[Column | str], k: Column | int, most: int) -> tuple[DataFrame, DataFrame]:
    """Rows split in (the first ``k`` of each group by ``order``, the rest), where ``k`` is ``most`` at most.

    Parts of a group rank first, so a task never sorts a whole group.
    """
    part = F.pmod(F.xxhash64(*order), F.lit(RANK_PARTS))
    near = rows.withColumn("_part", part).withColumn("_n", F.row_number().over(Window.partitionBy(group, "_part").orderBy(*order))).drop("_part")
    few = near.filter(F.col("_n") <= most).withColumn("_n", F.row_number().over(Window.partitionBy(group).orderBy(*order)))
    rest = near.filter(F.col("_n") > most).unionByName(few.filter(F.col("_n") > k))
    return few.filter(F.col("_n") <= k).drop("_n"), rest.drop("_n")


def budgeted(rows: DataFrame, group: str, order: str, allowed: Column, budget: int) -> DataFrame:
    """``outcome`` of each row: the first ``budget`` allowed rows of a group are chosen, the others have a reason."""
    chosen, over = first_of(rows.filter(allowed), group, [F.col(order)], budget, budget)
    refused = rows.filter(~F.coalesce(allowed, F.lit(False)))
    told = lambda df, outcome: df.withColumn("outcome", F.lit(outcome))
    return told(chosen, "chosen").unionByName(told(over, "over_budget")).unionByName(told(refused, "not_allowed"))


def quotas(sizes: DataFrame, stratum: str, size: str, total: int, floor: int = 5) -> DataFrame:
    """(stratum, size, quota): quotas by proportion, with a floor and capped by size, that add up to ``total`` where they can.

    What proportions give too much is taken from the largest strata, down to the floor; what is missing
    goes to the smallest, up to their size. Each stratum gives what those before it leave over, so the room
    before it, a running sum, tells its share. Strata of equal size go by name.
    """
    count = F.sum(size).over(Window.partitionBy())
    share = F.rint(F.lit(total) * F.col(size) / count).cast("long")
    start = F.least(F.col(size), F.greatest(F.lit(floor), share)).cast("long")
    told = sizes.filter(F.col(size) > 0).select(stratum, F.col(size).cast("long").alias("size"), start.alias("start"))
    told = told.withColumns({
        "drift": F.lit(total) - F.sum("start").over(Window.partitionBy()),
        "above": F.greatest(F.col("start") - floor, F.lit(0)), "below": F.col("size") - F.col("start"),
    })

    def moved(room: str, need: Column, order: Column) -> Column:
        past = Window.orderBy(order, stratum).rowsBetween(Window.unboundedPreceding, -1)
        return F.least(F.col(room), F.greatest(need - F.coalesce(F.sum(room).over(past), F.lit(0)), F.lit(0)))

    less, more = moved("above", -F.col("drift"), F.desc("size")), moved("below", F.col("drift"), F.asc("size"))
    return told.select(stratum, "size", (F.col("start") - less + more).alias("quota"))


def stratified(rows: DataFrame, stratum: str, key: str, total: int, seed: int, floor: int = 5) -> DataFrame:
    """A fixed-size draw from each stratum in the order of a seeded hash of the key.

    Strata are few: their sizes and quotas are a row each.
    """
    own = quotas(rows.groupBy(stratum).agg(F.count("*").alias("size")), stratum, "size", total, floor)
    order = F.md5(F.concat_ws("|", F.lit(str(seed)), F.col(key).cast("string")))
    drawn = first_of(rows.join(own.select(stratum, F.col("quota").alias("_quota")), stratum), stratum, [order, F.col(key)], F.col("_quota"), total)[0]
    return drawn.select(*rows.columns)


def replay(changes: DataFrame, policies: DataFrame) -> DataFrame:
    """Outcome of each policy over all changes (kinds array, flagged, namespace).

    A policy blocks a change with a kind that it doesn't exempt. Changes are counted by their
    kinds first, so the cross with the few policies is of distinct kind sets, not of changes.
    """
    kinds = F.array_sort(F.array_distinct("kinds"))
    sets = changes.groupBy(kinds.alias("kinds"), "flagged").agg(F.count("*").alias("n"))
    crossed = sets.join(F.broadcast(policies))  # policies are a literal table of five rows
    blocked = F.exists("kinds", lambda k: ~F.array_contains("exempt", k))
    count = lambda c: F.sum(F.when(c, F.col("n")).otherwise(0)).cast("long")
    out = crossed.groupBy("policy").agg(
        count(blocked).alias("blocked"), count(~blocked).alias("passed"),
        count(blocked & F.col("flagged")).alias("caught"), count(~blocked & F.col("flagged")).alias("missed"),
    )
    return out.withColumn("friction", F.when(F.col("caught") > 0, (F.col("blocked") - F.col("caught")) / F.col("caught")))
