"""Conflict rows kept between runs, id mappings, skip marks, collection properties, outcomes of writes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from accord.operators.conflicts import map_diff

#: conflicts: id, mapping_id, uid, s_hash, t_hash, detected_at, decision, resolved_at, applied_at
OPEN = "resolved_at is null"


def record_conflicts(store: DataFrame, new: DataFrame) -> DataFrame:
    """The store with new conflicts: an unresolved row of the same mapping and uid is refreshed and keeps its id.

    A null mapping equals itself. A new row's id is a digest of mapping, uid and time, so reruns agree.
    Of several new conflicts on one record the latest counts.
    """
    keys = ["mapping_id", "uid"]
    rest = [c for c in new.columns if c not in keys]
    last = new.groupBy(*keys).agg(F.max_by(F.struct(*rest), "detected_at").alias("x")).select(*keys, "x.*")
    s, n = store.alias("s"), last.alias("n")
    on = F.col("s.mapping_id").eqNullSafe(F.col("n.mapping_id")) & (F.col("s.uid") == F.col("n.uid")) & F.col("s.resolved_at").isNull()
    met = s.join(n, on, "full")
    given = F.col("n.uid").isNotNull()
    fresh = F.substring(F.sha2(F.concat_ws("|", "n.mapping_id", "n.uid", F.col("n.detected_at").cast("string")), 256), 1, 32)
    taken = [F.when(given, F.col(f"n.{c}")).otherwise(F.col(f"s.{c}")).alias(c) if c in new.columns else F.col(f"s.{c}").alias(c) for c in store.columns if c != "id"]
    return met.select(F.coalesce("s.id", fresh).alias("id"), *taken).select(store.columns)


def pending(store: DataFrame, mapping: str | None = None) -> DataFrame:
    """Unresolved conflicts, of one mapping or of all."""
    rows = store.where(OPEN)
    return rows if mapping is None else rows.where(F.col("mapping_id") == mapping)


def pending_conflicts(store: DataFrame) -> DataFrame:
    """Unresolved conflicts, the newest first."""
    return pending(store).orderBy(F.desc("detected_at"), "id")


def unapplied(store: DataFrame) -> DataFrame:
    """Resolved conflicts whose decision was not applied yet."""
    return store.where("resolved_at is not null and applied_at is null")


def _set(store: DataFrame, where: Column, **values: Column) -> DataFrame:
    return store.withColumns({c: F.when(where, v.cast(store.schema[c].dataType)).otherwise(F.col(c)) for c, v in values.items()})


def resolve_one(store: DataFrame, id_: str, decision: str, at: Column) -> DataFrame:
    return _set(store, (F.col("id") == id_) & F.expr(OPEN), decision=F.lit(decision), resolved_at=at)


def resolve_all(store: DataFrame, decision: str, at: Column, mapping: str | None = None) -> DataFrame:
    """All unresolved conflicts, of one mapping or of all, get the decision."""
    own = F.lit(True) if mapping is None else F.col("mapping_id") == mapping
    return _set(store, own & F.expr(OPEN), decision=F.lit(decision), resolved_at=at)


def mark_applied(store: DataFrame, ids: DataFrame, at: Column) -> DataFrame:
    """The conflicts of the given ids (id) as applied."""
    done = ids.select("id", F.lit(True).alias("__done")).distinct()
    met = store.join(done, "id", "left")
    return _set(met, F.coalesce("__done", F.lit(False)), applied_at=at).select(store.columns)


def reset(store: DataFrame, ids: DataFrame) -> DataFrame:
    """The conflicts of the given ids as unresolved again."""
    met = store.join(ids.select("id", F.lit(True).alias("__back")).distinct(), "id", "left")
    none = F.lit(None)
    return _set(met, F.coalesce("__back", F.lit(False)), decision=none, resolved_at=none, applied_at=none).select(store.columns)


def drop_applied(store: DataFrame) -> DataFrame:
    return store.where("applied_at is null")


def consume(store: DataFrame, at: Column) -> tuple[DataFrame, DataFrame]:
    """The decisions to apply now, and the store in which they count as applied, so that none is taken twice."""
    due = unapplied(store)
    return due, _set(store, F.expr("resolved_at is not null and applied_at is null"), applied_at=at)


def unresolved_count(store: DataFrame) -> DataFrame:
    """mapping_id, unresolved: by mapping, with the total where mapping_id is null and total is true."""
    rows = store.where(OPEN).rollup("mapping_id").agg(F.count("*").alias("unresolved"), F.grouping("mapping_id").cast("boolean").alias("total"))
    return rows.select("mapping_id", "unresolved", "total")


def target_id_for(records: DataFrame, mappings: DataFrame) -> DataFrame:
    """records (backend, uid, recurrence_id) with remote_id by (backend, local_uid, recurrence_id); null without a mapping."""
    known = mappings.select(F.col("backend").alias("__b"), F.col("local_uid").alias("__u"), F.col("recurrence_id").alias("__r"), "remote_id")
    on = (records["backend"] == F.col("__b")) & (records["uid"] == F.col("__u")) & records["recurrence_id"].eqNullSafe(F.col("__r"))
    return records.join(known, on, "left").drop("__b", "__u", "__r")


def source_uid_for(remote: DataFrame, mappings: DataFrame) -> DataFrame:
    """remote (backend, remote_id) with local_uid; of several the smallest."""
    known = mappings.groupBy("backend", "remote_id").agg(F.min("local_uid").alias("local_uid"))
    return remote.join(known, ["backend", "remote_id"], "left")


def invalidate_skips(skips: DataFrame, mappings: DataFrame, written: DataFrame) -> DataFrame:
    """skips (mapping_id, skip) where a mapping with an endpoint just written is no longer skipped.

    mappings: mapping_id, source, target; written: endpoint.
    """
    ends = mappings.select("mapping_id", F.explode(F.array("source", "target")).alias("endpoint"))
    hit = ends.join(written.select("endpoint").distinct(), "endpoint", "left_semi").select("mapping_id", F.lit(True).alias("__hit")).distinct()
    return skips.join(hit, "mapping_id", "left").select("mapping_id", (F.col("skip") & F.col("__hit").isNull()).alias("skip"))


def property_phase(source: DataFrame, target: DataFrame, baseline: DataFrame, mappings: DataFrame) -> DataFrame:
    """uid, property, side, value: writes of collection properties (uid, property, value; uid is the mapping's).

    mappings: uid, mode, policy. Changes to the source are written in two-way mode alone. A conflict under
    policy 'ask' fails the mapping: its only row has the side 'failed'. Under 'target' the target wins,
    under every other policy the source.
    """
    rows = map_diff(source, target, baseline).join(mappings, "uid")
    failed = rows.where("outcome = 'conflict' and policy = 'ask'").select("uid").distinct()
    wins = F.when(F.col("policy") == "target", "source").otherwise("target")
    side = F.when(F.col("outcome") == "to_target", "target").when(F.col("outcome") == "to_source", "source").otherwise(wins)
    planned = rows.withColumn("side", side).where("side = 'target' or mode = 'two_way'").join(failed, "uid", "left_anti")
    value = lambda df, name: df.select("uid", "property", F.col("value").alias(name))
    met = planned.join(value(source, "__s"), ["uid", "property"], "left").join(value(target, "__t"), ["uid", "property"], "left")
    out = met.select("uid", "property", "side", F.when(F.col("side") == "target", F.col("__s")).otherwise(F.col("__t")).alias("value"))
    none = F.lit(None).cast("string")
    return out.unionByName(failed.select("uid", none.alias("property"), F.lit("failed").alias("side"), none.alias("value")))


def apply_outcome(plan: DataFrame, results: DataFrame) -> DataFrame:
    """mapping_id, created, updated, deleted, errors, ok of a plan (mapping_id, id, side, action) and its results (mapping_id, id, side, success).

    Each planned row counts once, as its action or as an error; a row without a result is an error. ok only without errors.
    """
    met = plan.join(results.select("mapping_id", "id", "side", "success"), ["mapping_id", "id", "side"], "left")
    good = F.coalesce("success", F.lit(False))
    of = lambda action, name: F.count_if(good & (F.col("action") == action)).alias(name)
    return met.groupBy("mapping_id").agg(of("create", "created"), of("update", "updated"), of("delete", "deleted"), F.count_if(~good).alias("errors"), F.bool_and(good).alias("ok"))


def baselines_after(plan_baselines: DataFrame, outcomes: DataFrame) -> DataFrame:
    """The baselines to write: those of mappings whose writes all succeeded."""
    return plan_baselines.join(outcomes.where("ok").select("mapping_id"), "mapping_id", "left_semi")
