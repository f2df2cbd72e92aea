"""Id aliases, baselines that collapse on one id, state tables keyed by primary key."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from accord.sources.shared import written


def resolve_ids(records: DataFrame, aliases: DataFrame, scope: str, key: str) -> DataFrame:
    """records with key replaced by its alias's canonical id within scope; ids without an alias stay."""
    known = aliases.select(scope, F.col("native_id").alias("__native"), F.col("canonical_id").alias("__canonical"))
    met = records.withColumnRenamed(key, "__native").join(known, [scope, "__native"], "left")
    return met.withColumn(key, F.coalesce("__canonical", "__native")).select(records.columns)


def heal_aliases(aliases: DataFrame, scope: str) -> DataFrame:
    """scope, native_id, canonical_id: every native id and the end of its chain of aliases; of several aliases of an id the smallest counts.

    Chains that run into a cycle end at the cycle's smallest id, by pointer jumping: each round doubles the steps that a
    pointer has taken. A pointer that has come to the end of its chain is not moved again. An id that has met itself, and none
    smaller, is the smallest of a cycle, which ends there for all that have met it. So rounds grow with the logarithm of
    the longest chain or cycle.
    """
    links = aliases.where("native_id <> canonical_id").groupBy(scope, "native_id").agg(F.min("canonical_id").alias("far"))
    moving, ended = written(links.select(scope, F.col("native_id").alias("id"), "far", F.col("far").alias("later"))), None  # later: the smallest id met
    while True:
        ahead = moving.select(scope, F.col("id").alias("far"), F.col("far").alias("farther"), F.col("later").alias("lower"), F.lit(False).alias("stays"))
        if ended is not None:
            ahead = ahead.unionByName(ended.select(scope, F.col("id").alias("far"), F.col("far").alias("farther"), F.lit(None).alias("lower"), F.lit(True).alias("stays")))
        met = moving.join(ahead, [scope, "far"], "left")
        moved = written(met.select(scope, "id", F.coalesce("farther", "far").alias("far"), F.least("later", "lower").alias("later"), F.coalesce("stays", F.lit(True)).alias("ended")))
        done, moving = moved.where("ended").select(scope, "id", "far"), moved.where("not ended").drop("ended")
        rings = moving.where("later = id").select(scope, F.col("id").alias("low"), F.lit(True).alias("ring"))
        if not rings.isEmpty():
            closed = written(moving.withColumn("low", F.least("id", "later")).join(rings, [scope, "low"], "left"))
            done = done.unionByName(closed.where("ring").select(scope, "id", F.col("low").alias("far")))
            moving = closed.where("ring is null").drop("low", "ring")
        ended = done if ended is None else ended.unionByName(done)
        if moving.isEmpty():
            return ended.select(scope, F.col("id").alias("native_id"), F.col("far").alias("canonical_id"))


def dedupe_baselines(baselines: DataFrame, aliases: DataFrame, source: DataFrame, target: DataFrame, scope: str) -> DataFrame:
    """One baseline row for each canonical id: one whose hashes both sides still have, else one side, else the smallest native id.

    baselines: scope, id, source_hash, target_hash; aliases healed; source, target: scope, id (canonical), hash.
    """
    moved = resolve_ids(baselines.withColumn("native", F.col("id")), aliases, scope, "id")
    side = lambda df, name: df.select(scope, "id", F.col("hash").alias(name), F.lit(True).alias(f"{name}_now")).dropDuplicates([scope, "id", name])
    met = moved.join(side(source, "source_hash"), [scope, "id", "source_hash"], "left").join(side(target, "target_hash"), [scope, "id", "target_hash"], "left")
    current = F.coalesce(F.col("source_hash_now").cast("int"), F.lit(0)) + F.coalesce(F.col("target_hash_now").cast("int"), F.lit(0))
    best = met.groupBy(scope, "id").agg(F.min_by(F.struct("source_hash", "target_hash"), F.struct(-current, "native")).alias("r"))
    return best.select(scope, "id", "r.*")


def identity_conflicts(creates_source: DataFrame, creates_target: DataFrame, scope: str) -> DataFrame:
    """scope, source_id, target_id, digest of creates towards both sides with equal content: an equi-join on the digest.

    Repeated content is grouped first: a digest gives its smallest id on each side.
    """
    one = lambda df, name: df.groupBy(scope, "digest").agg(F.min("id").alias(name))
    return one(creates_source, "source_id").join(one(creates_target, "target_id"), [scope, "digest"])


def identity_conflict_members(creates_source: DataFrame, creates_target: DataFrame, scope: str) -> DataFrame:
    """scope, digest, side, id: every create whose content is created towards the other side too.

    The members of each conflict, a row each and no pairs, so content that is repeated many times does no harm.
    """
    of = lambda df, side, other: df.join(other.select(scope, "digest").distinct(), [scope, "digest"], "left_semi").select(scope, "digest", F.lit(side).alias("side"), "id")
    return of(creates_source, "source", creates_target).unionByName(of(creates_target, "target", creates_source))


def harvest_baselines(source: DataFrame, target: DataFrame, aliases: DataFrame, scope: str) -> DataFrame:
    """scope, id, source_hash, target_hash after a first sync: the target's row by alias, its hash falling back to the source's."""
    there = target.select(scope, F.col("id").alias("at"), F.col("hash").alias("target_hash"))
    named = aliases.select(scope, F.col("canonical_id").alias("id"), F.col("native_id").alias("alias")).groupBy(scope, "id").agg(F.min("alias").alias("alias"))
    rows = source.select(scope, "id", F.col("hash").alias("source_hash")).join(named, [scope, "id"], "left").withColumn("at", F.coalesce("alias", "id"))
    return rows.join(there, [scope, "at"], "left").select(scope, "id", "source_hash", F.coalesce("target_hash", "source_hash").alias("target_hash"))


def upsert(current: DataFrame, changes: DataFrame, keys: list[str], order: str | None = None) -> DataFrame:
    """current with changes put in by key; a key's change replaces its row, the last one by order (else the greatest row) if there are several."""
    rest = F.struct(*(c for c in current.columns if c not in keys))
    last = F.max_by(rest, F.struct(order, rest)) if order else F.max(rest)
    new = changes.groupBy(*keys).agg(last.alias("__row")).select(*keys, "__row.*") if len(keys) < len(current.columns) else changes.select(keys).distinct()
    return current.join(new.select(keys), keys, "left_anti").unionByName(new.select(current.columns))


def delete_keys(current: DataFrame, gone: DataFrame, keys: list[str]) -> DataFrame:
    """current without the rows of the given keys; with fewer keys, a whole scope goes."""
    return current.join(gone.select(keys).distinct(), keys, "left_anti")


def latest_resolutions(conflicts: DataFrame) -> DataFrame:
    """The newest decision on each (mapping_id, id); 'skip' and 'ask' decide nothing."""
    rank = F.row_number().over(Window.partitionBy("mapping_id", "id").orderBy(F.desc("resolved_at"), F.desc("seq")))
    decided = conflicts.where(F.col("decision").isNotNull() & ~F.col("decision").isin("skip", "ask"))
    return decided.withColumn("__rank", rank).where("__rank = 1").drop("__rank")


def replay_resolutions(conflicts: DataFrame, pending: DataFrame) -> DataFrame:
    """mapping_id, id, verdict: 'replay' where both sides' times still agree to the second, else 'stale'; 'open' without a decision."""
    kept = pending.select("mapping_id", "id", "decision", F.col("s_last_modified").alias("__s"), F.col("t_last_modified").alias("__t"))
    same = lambda a, b: F.date_trunc("second", a).eqNullSafe(F.date_trunc("second", b))
    fresh = same(F.col("s_last_modified"), F.col("__s")) & same(F.col("t_last_modified"), F.col("__t"))
    verdict = F.when(F.col("decision").isNull(), "open").when(fresh, "replay").otherwise("stale")
    return conflicts.join(kept, ["mapping_id", "id"], "left").select("mapping_id", "id", verdict.alias("verdict"))


def skip_unchanged(mappings: DataFrame, fresh: DataFrame, stored: DataFrame) -> DataFrame:
    """mapping_id, skip: both endpoints' fresh tokens are there and equal the stored ones.

    mappings: mapping_id, source, target (endpoints); fresh: endpoint, token; stored: mapping_id, side, token.
    """
    ends = mappings.select("mapping_id", F.explode(F.array(F.struct(F.lit("source").alias("side"), F.col("source").alias("endpoint")), F.struct(F.lit("target").alias("side"), F.col("target").alias("endpoint")))).alias("e")).select("mapping_id", "e.*")
    met = ends.join(fresh.withColumnRenamed("token", "now"), "endpoint", "left").join(stored, ["mapping_id", "side"], "left")
    ok = F.coalesce((F.col("now") != "") & (F.col("now") == F.col("token")), F.lit(False))
    return met.groupBy("mapping_id").agg(F.bool_and(ok).alias("skip"))


def next_pass(mappings: DataFrame, writes: DataFrame) -> DataFrame:
    """mapping_id of those with an endpoint that another mapping wrote. writes: mapping_id, endpoint.

    Each endpoint needs only its smallest and its largest writer, so hot endpoints give no pairs.
    """
    by = writes.groupBy("endpoint").agg(F.min("mapping_id").alias("first"), F.max("mapping_id").alias("last"))
    ends = mappings.select("mapping_id", F.explode(F.array("source", "target")).alias("endpoint"))
    return ends.join(by, "endpoint").where("first <> mapping_id or last <> mapping_id").select("mapping_id").distinct()
