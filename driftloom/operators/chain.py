"""Ordered histories: a key's steps, verdicts between consecutive states, transitions, intervals.

A step has ``key``, ``obs_id``, ``at`` (when the state was true), ``content`` and ``absent``.
Steps are ordered by (at, obs_id); one shuffle by key serves all operators here.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window, WindowSpec

VERDICTS = ("new", "mutated", "replaced", "renamed", "disappeared", "returned")


def in_order() -> WindowSpec:
    return Window.partitionBy("key").orderBy("at", "obs_id")


def verdicts(steps: DataFrame, since: Column | None = None, until: Column | None = None, unchanged: bool = False, identity: list[str] | None = None, part: str | None = None) -> DataFrame:
    """Emitted steps with ``verdict``, ``from_obs``, ``from_at``, ``from_content`` and ``change_id``.

    The previous state is the last present one, however many absences lie between. ``until`` cuts
    the history before the walk; ``since`` only cuts what is emitted, so that the state before it
    is still known. An absence before any presence, a repeated absence, and an equal state emit
    nothing; a return is emitted even if the state is the same. ``identity`` columns of the
    previous state come back as ``from_<name>``.

    With ``part`` (a unit of ``date_trunc``) a key's history is walked in parts of time, each from the
    state that the parts before it leave, which is one row a part: so no task holds a long history whole.
    """
    if until is not None:
        steps = steps.filter(F.col("at") < until)
    before = in_order().rowsBetween(Window.unboundedPreceding, -1)
    state = F.when(~F.col("absent"), F.struct("obs_id", "at", "content", *(identity or [])))
    if part is None:
        walked = steps.withColumns({
            "previous": F.last(state, ignorenulls=True).over(before),
            "gone": F.coalesce(F.lag("absent").over(in_order()), F.lit(False)),
        })
    else:
        walked = _walked_in_parts(steps, state, part)
    had = F.col("previous").isNotNull()
    same = F.col("previous.content").eqNullSafe(F.col("content"))
    verdict = (
        F.when(F.col("absent") & had & ~F.col("gone"), "disappeared")
        .when(F.col("absent"), None)
        .when(~had, "new")
        .when(F.col("gone"), "returned")
        .when(~same, "mutated")
    )
    if unchanged:
        verdict = F.coalesce(verdict, F.when(~F.col("absent"), "unchanged"))
    out = walked.withColumn("verdict", verdict).filter("verdict is not null")
    if since is not None:
        out = out.filter(F.col("at") >= since)
    fresh = F.col("verdict") == "new"
    out = out.withColumns({
        "from_obs": F.when(~fresh, F.col("previous.obs_id")),
        "from_at": F.when(~fresh, F.col("previous.at")),
        "from_content": F.when(~fresh, F.col("previous.content")),
        **{f"from_{c}": F.when(~fresh, F.col(f"previous.{c}")) for c in identity or []},
    })
    return out.withColumn("change_id", change_id(F.col("key"), F.col("from_obs"), F.col("obs_id"))).drop("previous", "gone")


def _walked_in_parts(steps: DataFrame, state: Column, part: str) -> DataFrame:
    """Steps with ``previous`` and ``gone``; equal to one window over the key."""
    cut = steps.withColumn("_part", F.date_trunc(part, F.col("at").cast("timestamp")))
    order = Window.partitionBy("key", "_part").orderBy("at", "obs_id")
    place = F.struct("at", "obs_id")
    ends = cut.groupBy("key", "_part").agg(
        F.max_by(state, F.when(~F.col("absent"), place)).alias("_last"), F.max_by("absent", place).alias("_gone"),
    )
    parts = Window.partitionBy("key").orderBy("_part")
    carried = ends.select("key", "_part", F.last("_last", ignorenulls=True).over(parts.rowsBetween(Window.unboundedPreceding, -1)).alias("_came"), F.lag("_gone").over(parts).alias("_was"))
    own = cut.withColumns({"_own": F.last(state, ignorenulls=True).over(order.rowsBetween(Window.unboundedPreceding, -1)), "_lag": F.lag("absent").over(order)})
    both = own.join(carried, own["key"].eqNullSafe(carried["key"]) & own["_part"].eqNullSafe(carried["_part"])).drop(carried["key"], carried["_part"])
    return both.withColumns({"previous": F.coalesce("_own", "_came"), "gone": F.coalesce("_lag", "_was", F.lit(False))}).drop("_part", "_own", "_came", "_lag", "_was")


def with_identity(found: DataFrame, predecessors: DataFrame, identity: list[str]) -> DataFrame:
    """Verdicts with ``replaced`` and ``renamed``.

    A mutation is a replacement if an identity column is set on both sides and differs; gaining or
    losing one is not. A new key with a predecessor (key, predecessor) was renamed.
    """
    moved = F.exists(F.array(*[F.coalesce(F.col(c) != F.col(f"from_{c}"), F.lit(False)) for c in identity]), lambda x: x)
    joined = found.join(predecessors.select("key", "predecessor"), "key", "left")
    verdict = (
        F.when((F.col("verdict") == "mutated") & moved, "replaced")
        .when((F.col("verdict") == "new") & F.col("predecessor").isNotNull(), "renamed")
        .otherwise(F.col("verdict"))
    )
    return joined.withColumn("verdict", verdict)


def change_id(key: Column, from_obs: Column, to_obs: Column) -> Column:
    """Sixteen hex digits that name a change by its key and both observations."""
    text = F.concat_ws("|", key.cast("string"), F.coalesce(from_obs.cast("string"), F.lit("-")), to_obs.cast("string"))
    return F.substring(F.sha2(text, 256), 1, 16)


def transitions(steps: DataFrame) -> DataFrame:
    """Consecutive pairs of steps: ``was``, ``content``, ``gap_days``; equal stamps are restatements."""
    w = in_order()
    paired = steps.withColumns({"was_at": F.lag("at").over(w), "was": F.lag("content").over(w), "n_before": F.row_number().over(w) - 1})
    gap = (F.unix_micros("at") - F.unix_micros("was_at")) / F.lit(86_400_000_000.0)
    return paired.filter("n_before > 0").withColumns({"restated": F.col("was_at") == F.col("at"), "gap_days": gap})


def quarantined(steps: DataFrame, unstable: Column) -> DataFrame:
    """Mark every step of a key that was ever unstable."""
    return steps.withColumn("quarantined", F.coalesce(F.max(unstable.cast("int")).over(Window.partitionBy("key")) == 1, F.lit(False)))


def latest(rows: DataFrame, keys: list[str], order: list[str], columns: list[str]) -> DataFrame:
    """The last row of each key by ``order``, by one partially aggregated maximum."""
    best = F.max_by(F.struct(*columns), F.struct(*order)).alias("_last")
    return rows.groupBy(*keys).agg(best).select(*keys, "_last.*")


def changed_since_last(rows: DataFrame, content: str) -> DataFrame:
    """Whether each step's content differs from the one before; the first has changed."""
    w = in_order()
    return rows.withColumn("changed", (F.row_number().over(w) == 1) | ~F.lag(content).over(w).eqNullSafe(F.col(content)))
