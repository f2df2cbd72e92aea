"""Decisions on conflicts, as expressions over joined rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

POLICIES = ("none", "source", "target", "newest", "oldest", "largest", "both")


def complexity(source: Column, target: Column) -> Column:
    """'complex' for a missing or empty side; else by the change of size: under 5 % simple, under 30 % moderate."""
    a, b = F.octet_length(source), F.octet_length(target)
    change = F.abs(b - a) * 100 / F.greatest(a, b)
    empty = F.coalesce((a == 0) | (b == 0), F.lit(True))
    return F.when(empty, "complex").when(change < 5, "simple").when(change < 30, "moderate").otherwise("complex")


def auto_decision(policy: str, source: Column, target: Column, source_time: Column, target_time: Column) -> Column:
    """'source', 'target', 'both', 'delete_both', or 'pending' for the policy 'none'.

    A side that is null is deleted. Under 'source' and 'target' a deleted winner deletes both; the other
    policies compare alone. Times: a missing time is oldest, a tie goes to the target. Sizes: a tie goes
    to the source.
    """
    if policy not in POLICIES:
        raise ValueError(policy)
    oldest = F.lit("0001-01-01").cast("timestamp")
    s, t = F.coalesce(source_time, oldest), F.coalesce(target_time, oldest)
    size = lambda c: F.coalesce(F.octet_length(c), F.lit(0))
    side = lambda first: F.when(first, "source").otherwise("target")
    return {
        "none": F.lit("pending"), "both": F.lit("both"), "source": F.when(source.isNull(), "delete_both").otherwise("source"), "target": F.when(target.isNull(), "delete_both").otherwise("target"),
        "newest": side(s > t), "oldest": side(s < t), "largest": side(size(source) >= size(target)),
    }[policy]


def may_resolve(prompt: str, complexity_: Column, deletes: Column) -> Column:
    """Whether a conflict may be decided without asking; prompt is 'never', 'always', 'complex' or 'delete'."""
    return {"never": F.lit(True), "always": F.lit(False), "complex": complexity_ != "complex", "delete": ~deletes}[prompt]


#: What is decided where the policy may not or does not decide.
FALLBACKS = ("defer", "skip", "use_default", "abort")


def handle_conflicts(diff: DataFrame, policy: str, prompt: str = "never", fallback: str = "defer", default: str = "source") -> DataFrame:
    """mapping_id, id, complexity, decision, resolved_by of each conflict of a diff.

    What may not be decided gets the fallback: 'defer' leaves it pending, 'skip' skips it, 'use_default'
    takes the default decision ('pending' skips), 'abort' aborts. resolved_by tells 'policy', 'fallback' or null.
    """
    if fallback not in FALLBACKS:
        raise ValueError(fallback)
    rows = diff.where("op = 'conflict'")
    level = complexity(F.col("s_data"), F.col("t_data"))
    decided = auto_decision(policy, F.col("s_data"), F.col("t_data"), F.col("s_last_modified"), F.col("t_last_modified"))
    free = may_resolve(prompt, level, F.col("s_data").isNull() | F.col("t_data").isNull()) & (decided != "pending")
    other = {"use_default": "skip" if default == "pending" else default}.get(fallback, fallback)
    by = F.when(free, "policy").when(F.lit(fallback != "defer"), "fallback")
    return rows.select("mapping_id", "id", level.alias("complexity"), F.when(free, decided).otherwise(other).alias("decision"), by.alias("resolved_by"))


def hold_unresolved(plan: DataFrame, conflicts: DataFrame) -> DataFrame:
    """The plan without the writes of mappings that have an undecided conflict (conflicts: mapping_id, decision), or one that aborts."""
    waiting = conflicts.where("decision in ('defer', 'ask', 'abort')").select("mapping_id").distinct()
    return plan.join(waiting, "mapping_id", "left_anti")


def classify_writes(merged: DataFrame, destination: DataFrame) -> DataFrame:
    """merged (mapping_id, id, deleted) with action: deletes by flag; what the destination has is an update, else a create."""
    there = destination.select("mapping_id", "id", F.lit(True).alias("__there"))
    action = F.when(F.col("deleted"), "delete").when(F.col("__there"), "update").otherwise("create")
    return merged.join(there, ["mapping_id", "id"], "left").withColumn("action", action).drop("__there")


def limit_auto(decided: DataFrame, n: int) -> DataFrame:
    """At most n decisions a mapping, by id; 0 is no limit. The feature is off by default."""
    if not n:
        return decided
    rank = F.row_number().over(Window.partitionBy("mapping_id").orderBy("id"))
    return decided.withColumn("__rank", rank).where(F.col("__rank") <= n).drop("__rank")


def property_diff(source: DataFrame, target: DataFrame, baseline: DataFrame) -> DataFrame:
    """uid, property, state of property rows (uid, property, value) that the sides don't share.

    States: only_source, only_target, use_source (the target is as agreed), use_target, both_changed, both_different (nothing agreed).
    """
    side = lambda df, name: df.select("uid", "property", F.col("value").alias(name))
    rows = side(source, "s").join(side(target, "t"), ["uid", "property"], "full").join(side(baseline, "b"), ["uid", "property"], "left")
    s, t, b = F.col("s"), F.col("t"), F.col("b")
    state = (
        F.when(s.eqNullSafe(t), None).when(t.isNull(), "only_source").when(s.isNull(), "only_target")
        .when(b.isNull(), "both_different").when(s == b, "use_target").when(t == b, "use_source").otherwise("both_changed")
    )
    return rows.select("uid", "property", state.alias("state")).where("state is not null")


def map_diff(source: DataFrame, target: DataFrame, baseline: DataFrame) -> DataFrame:
    """uid, property, outcome of property rows: 'to_target', 'to_source' or 'conflict'; equal sides are left out."""
    side = lambda df, name: df.select("uid", "property", F.col("value").alias(name))
    rows = side(source, "s").join(side(target, "t"), ["uid", "property"], "full").join(side(baseline, "b"), ["uid", "property"], "full")
    s, t, b = F.col("s"), F.col("t"), F.col("b")
    outcome = F.when(s.eqNullSafe(t), None).when(t.eqNullSafe(b), "to_target").when(s.eqNullSafe(b), "to_source").otherwise("conflict")
    return rows.select("uid", "property", outcome.alias("outcome")).where("outcome is not null")
