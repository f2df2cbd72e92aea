"""Synchronising many mappings over shared collections until nothing moves, in a bounded number of passes."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from accord.operators.aliases import next_pass
from accord.operators.reconcile import ADOPTED, adopted, coded, differences, resolve_records
from accord.sources.shared import written

#: Fixed value: passes of one run at most.
PASSES = 3
_RECORD = ["data", "hash", "last_modified"]


def _sides(state: DataFrame, mappings: DataFrame) -> list[DataFrame]:
    """Each mapping's source and target records (mapping_id, id, data, hash, last_modified)."""
    of = lambda end: state.join(mappings.select("mapping_id", F.col(end).alias("endpoint")), "endpoint").select("mapping_id", "id", *_RECORD)
    return [of("source"), of("target")]


def _laid_over(base: DataFrame, changes: DataFrame | None, keys: list[str]) -> DataFrame:
    """base with changes (its columns, and gone) in place of the rows of their keys."""
    if changes is None:
        return base
    return base.join(changes.select(keys), keys, "left_anti").unionByName(changes.where("not gone").select(base.columns))


def _newest(older: DataFrame | None, newer: DataFrame, keys: list[str]) -> DataFrame:
    return newer if older is None else newer.unionByName(older.join(newer.select(keys), keys, "left_anti"))


def converge(state: DataFrame, baselines: DataFrame, mappings: DataFrame, policy: str = "source", mode: str = "two_way", passes: int = PASSES) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The collections and baselines after one run, and its results: pass, mapping_id, side, created, updated, deleted, conflicts.

    state: endpoint, id (text), data, last_modified; baselines: mapping_id, id, source_hash, target_hash, data; mappings:
    mapping_id, source, target (endpoints), enabled. A record's hash is its data's SHA-256 on every side.

    The first pass takes all enabled mappings on the state as it is: differences against the baselines, conflicts by
    policy, writes to either endpoint, of several writes to one record that of the greatest mapping_id. Each next pass takes
    the mappings with an endpoint that another mapping wrote, and there only the records that were written, as the
    others are settled; at most `passes` passes, so a chain longer than that goes on in the next run. Open conflicts
    ('ask', 'skip') are counted once (side 'open') and write nothing. A run over what a run has settled does nothing and has
    no results. What each pass writes is a table of its own, laid over the given ones, which are never written anew.
    """
    base = state.select("endpoint", F.col("id").cast("string").alias("id"), "data", F.sha2("data", 256).alias("hash"), "last_modified")
    agreed = baselines.select("mapping_id", F.col("id").cast("string").alias("id"), "source_hash", "target_hash", "data")
    enabled = written(mappings.where("enabled").select("mapping_id", "source", "target"))
    active, touched, changes, settled, results = enabled, None, None, None, None
    ends = F.when(F.col("side") == "source", F.col("source")).otherwise(F.col("target"))
    for number in range(1, passes + 1):
        now, known = _laid_over(base, changes, ["endpoint", "id"]), _laid_over(agreed, settled, ["mapping_id", "id"]).join(active, "mapping_id", "left_semi")
        if touched is not None:
            met = active.select("mapping_id", F.explode(F.array("source", "target")).alias("endpoint")).join(touched.select("endpoint", "id"), "endpoint").select("mapping_id", "id").distinct()
            open_ = written(met)
            source, target = (df.join(open_, ["mapping_id", "id"], "left_semi") for df in _sides(now, active))
            known = known.join(open_, ["mapping_id", "id"], "left_semi")
        else:
            source, target = _sides(now, active)
        sides = (source, target, known)
        met = written(coded(*sides).where(f"code is not null or {ADOPTED}"))  # both the differences and what is adopted come from here
        writes = written(resolve_records(differences(met), policy, mode).join(active, "mapping_id").withColumn("endpoint", ends))
        counts = writes.groupBy("mapping_id", "side").agg(*(F.count_if(F.col("action") == a).alias(f"{a}d") for a in ("create", "update")), F.count_if(F.col("action") == "delete").alias("deleted"), F.sum("conflict").alias("conflicts"))
        counts = counts.select(F.lit(number).alias("pass"), "mapping_id", "side", "created", "updated", "deleted", "conflicts")
        results = counts if results is None else results.unionByName(counts)
        done = writes.where("side <> 'open'")
        last = done.groupBy("endpoint", "id").agg(F.max_by(F.struct("data", "action"), "mapping_id").alias("w"))
        gone = F.col("w.action") == "delete"
        touched = written(last.select("endpoint", "id", "w.data", F.sha2("w.data", 256).alias("hash"), F.lit(None).cast("timestamp").alias("last_modified"), gone.alias("gone")))
        both = F.sha2("data", 256)
        kept = done.groupBy("mapping_id", "id").agg(F.max_by("data", F.col("baseline").cast("int")).alias("data"), F.bool_and(F.col("action") == "delete").alias("gone"))
        kept = kept.select("mapping_id", "id", both.alias("source_hash"), both.alias("target_hash"), "data", "gone")
        agreeing = adopted(met).withColumns({"data": F.lit(None).cast("string"), "gone": F.lit(False)})
        fresh = written(kept.unionByName(agreeing))
        changes, settled = _newest(changes, touched, ["endpoint", "id"]), _newest(settled, fresh, ["mapping_id", "id"])
        dirty = done.select("mapping_id", "endpoint").distinct()
        active = written(enabled.join(next_pass(enabled, dirty), "mapping_id", "left_semi"))
        if active.isEmpty():
            break
    return _laid_over(base, changes, ["endpoint", "id"]).drop("hash"), _laid_over(agreed, settled, ["mapping_id", "id"]), results
