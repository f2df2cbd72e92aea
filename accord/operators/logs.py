"""Multi-writer operation logs: latest states, compaction, activity, merges; families of records."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def newest(log: DataFrame, *keys: str) -> DataFrame:
    """The newest entry of each key; among equal times the first writer's, then the first entry."""
    order = (F.desc("datetime"), F.asc("app_id"), F.asc("seq"))
    return log.withColumn("__rank", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where("__rank = 1").drop("__rank")


def latest_state(log: DataFrame) -> DataFrame:
    """The newest entry of each uid over all writers; uids whose newest entry is a tombstone are gone."""
    return newest(log, "uid").where(F.col("value").isNotNull())


def latest_per_writer(log: DataFrame) -> DataFrame:
    """The newest entry of each uid and writer, tombstones kept."""
    return newest(log, "app_id", "uid")


def merge_writers(log: DataFrame, baseline: DataFrame) -> DataFrame:
    """uid, outcome, value from the writers' newest entries against the agreed value (baseline: uid, value).

    A tombstone counts only if no writer is live; then a known uid is a deletion and others are no
    row. One live writer, no baseline or no change: the newest value, unchanged. One changed value
    is merged; several are a conflict, which the newest of them wins.
    """
    known = baseline.select(F.col("uid"), F.col("value").alias("agreed"), F.lit(True).alias("known"))
    rows = latest_per_writer(log).join(known, "uid", "left")
    live, changed = F.col("value").isNotNull(), F.col("value").isNotNull() & ~F.col("value").eqNullSafe(F.col("agreed"))
    place = F.row_number().over(Window.partitionBy("uid").orderBy(F.desc("datetime"), F.asc("app_id"), F.asc("seq")))
    rows, order = rows.withColumn("place", place), -F.col("place")
    folded = rows.groupBy("uid").agg(
        F.count_if(live).alias("writers"), F.count_distinct(F.when(changed, F.col("value"))).alias("changes"), F.max("known").alias("known"),
        F.max_by("value", F.when(live, order)).alias("newest"), F.max_by("value", F.when(changed, order)).alias("newest_change"),
    )
    outcome = F.when(F.col("writers") == 0, F.when(F.col("known"), "deletion")).when((F.col("writers") == 1) | F.col("known").isNull() | (F.col("changes") == 0), "unchanged").when(F.col("changes") == 1, "merged").otherwise("conflict")
    value = F.when(F.col("outcome").isin("merged", "conflict"), F.col("newest_change")).when(F.col("outcome") == "unchanged", F.col("newest"))
    return folded.withColumn("outcome", outcome).where(F.col("outcome").isNotNull()).select("uid", "outcome", value.alias("value"))


#: Properties that merge_properties never compares; they come with the newest record.
IGNORED = ("PRODID", "DTSTAMP", "CREATED", "LAST-MODIFIED", "SEQUENCE", "UID")


def _property_changes(log: DataFrame, baseline: DataFrame, ignored: tuple[str, ...]) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The writers' newest entries (a row a property), the live ones with their place by age, and what these change against the baseline."""
    entry = Window.partitionBy("app_id", "uid").orderBy(F.desc("datetime"), F.asc("seq"))
    last = log.withColumn("__rank", F.rank().over(entry)).where("__rank = 1")
    order = Window.partitionBy("uid").orderBy(F.desc("datetime"), F.asc("app_id"), F.asc("seq"))
    live = last.where("property is not null").withColumn("place", F.dense_rank().over(order)).select("uid", "app_id", "datetime", "place", "property", "value")
    agreed = baseline.where("property is not null").select("uid", "property", F.col("value").alias("agreed"))
    absent = live.select("uid", "app_id", "datetime", "place").distinct().join(agreed.select("uid", "property"), "uid").withColumn("value", F.lit(None).cast("string"))
    held = live.unionByName(absent).groupBy("uid", "app_id", "datetime", "place", "property").agg(F.coalesce(F.max("value"), F.lit("")).alias("value"))
    compared = held.where(~F.col("property").isin(*ignored)).join(agreed, ["uid", "property"], "left")
    return last, live, compared.where(F.col("value") != F.coalesce("agreed", F.lit(""))).drop("agreed")


def merge_properties(log: DataFrame, baseline: DataFrame, ignored: tuple[str, ...] = IGNORED, on_conflict: str = "property") -> DataFrame:
    """uid, outcome, property, value: the writers' newest entries merged property by property.

    log: uid, app_id, datetime, seq, property, value, a row for each property of an entry; a tombstone
    is one row of null property. baseline: uid, property, value, likewise. A property that a record lacks
    has the empty value. One changed value of a property is taken; of several the newest wins and the uid
    is a conflict. Winners replace the values of the newest live entry, empty ones remove them. Outcomes
    are those of merge_writers; a deletion, or a record without properties, is one row of null property.
    on_conflict='record': a uid in conflict has the whole record of the writer who won the last conflicting property by name.
    """
    if on_conflict not in ("property", "record"):
        raise ValueError(on_conflict)
    last, live, changed = _property_changes(log, baseline, ignored)
    won = changed.groupBy("uid", "property").agg(F.count_distinct("value").alias("changes"), F.min_by("value", "place").alias("won"), F.min_by("app_id", "place").alias("by"))
    writers = last.groupBy("uid").agg(F.count_distinct(F.when(F.col("property").isNotNull(), F.col("app_id"))).alias("writers"))
    known = baseline.select("uid", F.lit(True).alias("known")).distinct()
    folded = writers.join(known, "uid", "left").join(won.groupBy("uid").agg(F.max("changes").alias("changes")), "uid", "left")
    outcome = F.when(F.col("writers") == 0, F.when(F.col("known"), "deletion")).when((F.col("writers") == 1) | F.col("known").isNull() | F.col("changes").isNull(), "unchanged").when(F.col("changes") == 1, "merged").otherwise("conflict")
    outcomes = folded.select("uid", outcome.alias("outcome")).where("outcome is not null")
    winners = won.join(outcomes.where("outcome in ('merged', 'conflict')"), "uid", "left_semi").select("uid", "property", "won")
    rows = live.where("place = 1").select("uid", "property", "value").join(winners, ["uid", "property"], "full")
    rows = rows.select("uid", "property", F.coalesce("won", "value").alias("value")).where("value <> ''")
    if on_conflict == "record":
        clash = won.where("changes > 1").groupBy("uid").agg(F.max_by("by", "property").alias("app_id"))
        clash = clash.join(outcomes.where("outcome = 'conflict'"), "uid", "left_semi")
        rows = rows.join(clash, "uid", "left_anti").unionByName(live.join(clash, ["uid", "app_id"]).select("uid", "property", "value").where("value <> ''"))
    return outcomes.join(rows, "uid", "left").select("uid", "outcome", "property", "value")


def compact_log(log: DataFrame, written_at: DataFrame) -> DataFrame:
    """The newest entry of each writer and uid, without those older than the uid's baseline (uid, written_at)."""
    rows = latest_per_writer(log).join(written_at, "uid", "left")
    return rows.where("written_at is null or written_at <= datetime").drop("written_at")


def app_activity(log: DataFrame, cutoff) -> DataFrame:
    """app_id, last_seen, entries, inactive."""
    seen = log.groupBy("app_id").agg(F.max("datetime").alias("last_seen"), F.count("*").alias("entries"))
    return seen.withColumn("inactive", F.col("last_seen") < F.lit(cutoff).cast("timestamp"))


def latest_info(log: DataFrame) -> DataFrame:
    """key, value: the newest value of each key over all writers (log: key, value, app_id, datetime, seq)."""
    return newest(log, "key").select("key", "value")


def conflict_winners(log: DataFrame, baseline: DataFrame, ignored: tuple[str, ...] = IGNORED) -> DataFrame:
    """uid, property, winner, winner_app, loser, loser_app of properties that writers changed to several values.

    log and baseline as in merge_properties. Only values that differ from the agreed one take part, an absent
    property being the empty value; a uid without a baseline has no conflict. The two newest changes win and
    lose, which can hold the same value if a third one differs. Equal times: by value, then writer.
    """
    _, _, changed = _property_changes(log, baseline, ignored)
    changed = changed.join(baseline.select("uid").distinct(), "uid", "left_semi")
    key = Window.partitionBy("uid", "property")
    ranked = changed.withColumn("__rank", F.row_number().over(key.orderBy(F.desc("datetime"), "value", "app_id"))).withColumn("__low", F.min("value").over(key)).withColumn("__high", F.max("value").over(key))
    at = lambda k, c: F.max(F.when(F.col("__rank") == k, F.col(c)))
    rows = ranked.where("__low <> __high and __rank <= 2").groupBy("uid", "property")
    return rows.agg(at(1, "value").alias("winner"), at(1, "app_id").alias("winner_app"), at(2, "value").alias("loser"), at(2, "app_id").alias("loser_app"))


def inactive_apps(log: DataFrame, cutoff) -> DataFrame:
    """app_id of writers last seen before the cutoff."""
    return app_activity(log, cutoff).where("inactive").select("app_id")


def new_apps(log: DataFrame, known: DataFrame) -> DataFrame:
    """app_id of writers in the log that are not known."""
    return log.select("app_id").distinct().join(known.select("app_id"), "app_id", "left_anti")


def purge_dead(log: DataFrame, cutoff) -> DataFrame:
    """The log without the entries of inactive writers."""
    return log.join(inactive_apps(log, cutoff), "app_id", "left_anti")


def onboarding_snapshot(baselines: DataFrame, deletions: DataFrame) -> DataFrame:
    """uid, datetime, value for a new writer: every baseline live, every logged deletion as a null value."""
    gone = deletions.select("uid", "datetime", F.lit(None).cast(baselines.schema["value"].dataType).alias("value"))
    return baselines.select("uid", F.col("written_at").alias("datetime"), "value").unionByName(gone)


def shrunk_buckets(before: DataFrame, after: DataFrame, sequences: DataFrame) -> DataFrame:
    """app_id, bucket, sequence: the bucket's sequence, one higher where compaction left fewer entries."""
    count = lambda df, name: df.groupBy("app_id", "bucket").agg(F.count("*").alias(name))
    met = sequences.join(count(before, "was"), ["app_id", "bucket"], "left").join(count(after, "now"), ["app_id", "bucket"], "left")
    fewer = F.coalesce("now", F.lit(0)) < F.coalesce("was", F.lit(0))
    return met.select("app_id", "bucket", (F.col("sequence") + fewer.cast("long")).alias("sequence"))


def new_entries(log: DataFrame, tracked: DataFrame, own_app: str) -> DataFrame:
    """The entries of other writers beyond the tracked sequence of their bucket (tracked: app_id, bucket, sequence)."""
    at = tracked.select("app_id", "bucket", F.col("sequence").alias("__at"))
    met = log.where(F.col("app_id") != own_app).join(at, ["app_id", "bucket"], "left")
    return met.where("__at is null or sequence > __at").drop("__at")


def apply_skeletons(feed: DataFrame) -> DataFrame:
    """id, property, value: each record's present properties, skeleton rows laid over the last full row before them.

    feed: id, seq, kind ('full', 'skeleton', 'gone'), held (map<string,string>). A full row or a tombstone
    ends what came before; of a property the newest presence counts, a null value too.
    """
    since = F.max(F.when(F.col("kind") != "skeleton", F.col("seq"))).over(Window.partitionBy("id"))
    rows = feed.withColumn("__since", since).where("__since is null or seq >= __since").where("kind <> 'gone'")
    each = rows.select("id", "seq", F.explode("held").alias("property", "value"))
    return each.groupBy("id", "property").agg(F.max_by(F.struct("value"), "seq").alias("v")).select("id", "property", "v.value")


def first_occurrences(rows: DataFrame, group: str, value: str, position: str) -> DataFrame:
    """The rows of each group without repeats of a value, compared without case: the first by position stays, empty ones go."""
    rank = F.row_number().over(Window.partitionBy(group, F.lower(value)).orderBy(position))
    return rows.where(F.coalesce(F.col(value), F.lit("")) != "").withColumn("__rank", rank).where("__rank = 1").drop("__rank")


def merge_families(existing: DataFrame, staged: DataFrame) -> DataFrame:
    """uid, slot, data, position: the later row wins its slot; the master (slot '') comes first."""
    rows = existing.unionByName(staged)
    last = rows.withColumn("__rank", F.row_number().over(Window.partitionBy("uid", "slot").orderBy(F.desc("seq")))).where("__rank = 1")
    return last.select("uid", "slot", "data", F.row_number().over(Window.partitionBy("uid").orderBy("slot")).alias("position"))
