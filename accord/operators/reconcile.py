"""Three-way and two-way reconciliation of keyed collections."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

KEYS = ["mapping_id", "id"]


def _side(df: DataFrame, prefix: str) -> DataFrame:
    renamed = {c: f"{prefix}_{c}" for c in df.columns if c not in KEYS}
    return df.withColumnsRenamed(renamed).withColumn(prefix, F.lit(True))


def meet(source: DataFrame, target: DataFrame, baseline: DataFrame) -> DataFrame:
    """The three collections side by side, one row a key: they are stacked, dealt by key and grouped there, so rows are shuffled and sorted once.

    Columns come prefixed s_, t_, b_; s, t, b tell which sides hold the key. A side's repeated key gives one of its rows.
    """
    sides = {"s": source, "t": target, "b": baseline}
    held = {p: [c for c in df.columns if c not in KEYS] for p, df in sides.items()}
    shape = {p: F.struct(*(F.col(c) for c in held[p])) if held[p] else F.struct(F.lit(True).alias("there")) for p in sides}
    types = {p: sides[p].select(shape[p].alias("x")).schema["x"].dataType for p in sides}
    stacked = None
    for p, df in sides.items():
        own = df.select(*KEYS, *((shape[p] if q == p else F.lit(None).cast(types[q])).alias(q) for q in sides))
        stacked = own if stacked is None else stacked.unionByName(own)
    rows = stacked.repartition(*KEYS).groupBy(*KEYS).agg(*(F.first(p, ignorenulls=True).alias(f"__{p}") for p in sides))
    there = [F.col(f"__{p}").isNotNull().alias(p) for p in sides]
    return rows.select(*KEYS, *there, *(F.col(f"__{p}")[c].alias(f"{p}_{c}") for p in sides for c in held[p]))


def _changed(side: str, agreed: str) -> Column:
    """A side without a hash counts as changed; hashes are compared with the side's own baseline only."""
    empty = lambda c: F.coalesce(F.col(c), F.lit("")) == ""
    return empty(f"{side}_hash") | empty(agreed) | (F.col(f"{side}_hash") != F.col(agreed))


def coded(source: DataFrame, target: DataFrame, baseline: DataFrame) -> DataFrame:
    """The sides met, with code '<direction>:<op>'; null for what is unchanged, or in the baseline alone."""
    s, t, b = F.col("s"), F.col("t"), F.col("b")
    sc, tc = _changed("s", "b_source_hash"), _changed("t", "b_target_hash")
    code = (
        F.when(s & t & b, F.when(sc & tc, "to_target:conflict").when(sc, "to_target:update").when(tc, "to_source:update"))
        .when(~s & t & b, F.when(tc, "to_target:conflict").otherwise("to_target:delete"))
        .when(s & ~t & b, F.when(sc, "to_target:conflict").otherwise("to_source:delete"))
        .when(s & ~t, "to_target:create")
        .when(~s & t, "to_source:create")
        .when(s & t & ~F.col("s_data").eqNullSafe(F.col("t_data")), "to_target:conflict")
    )
    return meet(source, target, baseline).withColumn("code", code)


def three_way_diff(source: DataFrame, target: DataFrame, baseline: DataFrame) -> DataFrame:
    """mapping_id, id, direction, op and both sides' columns; unchanged and baseline-only keys are left out."""
    return differences(coded(source, target, baseline))


def differences(rows: DataFrame) -> DataFrame:
    """three_way_diff of rows that coded gives."""
    return rows.where(F.col("code").isNotNull()).withColumns({"direction": F.split("code", ":")[0], "op": F.split("code", ":")[1]}).drop("code")


def adopt_baselines(source: DataFrame, target: DataFrame, baseline: DataFrame) -> DataFrame:
    """mapping_id, id, source_hash, target_hash of keys that both sides hold equally without a baseline."""
    return adopted(meet(source, target, baseline))


#: Rows that adopt_baselines takes.
ADOPTED = "s and t and not b and s_data <=> t_data"


def adopted(rows: DataFrame) -> DataFrame:
    """adopt_baselines of rows that meet or coded gives."""
    return rows.where(ADOPTED).select(*KEYS, F.col("s_hash").alias("source_hash"), F.col("t_hash").alias("target_hash"))


#: Directions that a mapping's mode lets changes flow in.
MODES = {"two_way": ("target", "source"), "upload": ("target",), "download": ("source",), "disabled": ()}


def sync_diff(source: DataFrame, target: DataFrame, baseline: DataFrame, mode: str = "two_way") -> DataFrame:
    """mapping_id, id, outcome of the semantic diff: equal changes on both sides are unchanged.

    One-way modes ('upload', 'download') keep their direction's changes and all conflicts; what they drop
    is unchanged; a disabled mapping gives no rows.
    """
    s, t, b = (F.when(F.col(p), F.struct(F.col(f"{p}_data"))) for p in "stb")  # a record without data is still there
    sc, tc = ~s.eqNullSafe(b), ~t.eqNullSafe(b)
    kind = F.when(~F.col("b"), "both_created").when(~F.col("s") | ~F.col("t"), "modify_delete").otherwise("both_modified")
    towards = lambda there, here: F.when(~F.col(here), "delete").when(~F.col(there), "create").otherwise("update")
    flows = lambda side, change: F.concat(change, F.lit(f"_{side}")) if side in MODES[mode] else F.lit("unchanged")
    outcome = F.when(s.eqNullSafe(t) | (~sc & ~tc), "unchanged").when(sc & tc, F.concat(F.lit("conflict_"), kind)).when(sc, flows("target", towards("t", "s"))).otherwise(flows("source", towards("s", "t")))
    rows = meet(source, target, baseline).select(*KEYS, outcome.alias("outcome"))
    return rows if MODES[mode] else rows.limit(0)


def quick_diff(source: DataFrame, target: DataFrame, mode: str = "two_way") -> DataFrame:
    """mapping_id, id, outcome of the diff without a baseline: two different sides are a conflict; modes as in sync_diff."""
    rows = _side(source, "s").join(_side(target, "t"), KEYS, "full")
    flows = lambda side: f"create_{side}" if side in MODES[mode] else "unchanged"
    outcome = F.when(F.col("t").isNull(), flows("target")).when(F.col("s").isNull(), flows("source")).when(F.col("s_data").eqNullSafe(F.col("t_data")), "unchanged").otherwise("conflict_both_created")
    rows = rows.select(*KEYS, outcome.alias("outcome"))
    return rows if MODES[mode] else rows.limit(0)


def first_sync_plan(source: DataFrame, target: DataFrame) -> DataFrame:
    """mapping_id, id, action of the first mirror: create what lacks, update what differs, delete what is extra."""
    rows = _side(source, "s").join(_side(target, "t"), KEYS, "full")
    action = F.when(F.col("t").isNull(), "create").when(F.col("s").isNull(), "delete").when(~F.col("s_hash").eqNullSafe(F.col("t_hash")), "update")
    return rows.select(*KEYS, action.alias("action")).where(F.col("action").isNotNull())


def mirror_a_to_b(diff: DataFrame) -> DataFrame:
    """mapping_id, id, action on the target: its own creates are undone, its other changes ignored."""
    to_target = F.col("direction") == "to_target"
    action = F.when(to_target & (F.col("op") == "conflict"), F.when(F.col("s"), "update").otherwise("delete")).when(to_target, F.col("op")).when(F.col("op") == "create", "delete")
    return diff.select(*KEYS, action.alias("action")).where(F.col("action").isNotNull())


def mirror_b_to_a(diff: DataFrame) -> DataFrame:
    """mapping_id, id, action on the source: its own creates and updates are undone, its deletes ignored; conflicts take the target."""
    to_source = F.col("direction") == "to_source"
    undone = F.when(F.col("op") == "create", "delete").when(F.col("op") == "update", "update").when(F.col("op") == "conflict", F.when(F.col("t"), "update").otherwise("delete"))
    return diff.select(*KEYS, F.when(to_source, F.col("op")).otherwise(undone).alias("action")).where(F.col("action").isNotNull())


def mirror(diff: DataFrame, way: str) -> DataFrame:
    """The mirror plan 'a_to_b' or 'b_to_a'."""
    return {"a_to_b": mirror_a_to_b, "b_to_a": mirror_b_to_a}[way](diff)


def clobber_plan(source: DataFrame, target: DataFrame) -> DataFrame:
    """mapping_id, id, action of a full push over a wiped target: everything is a create, nothing a delete, no guard is asked."""
    return source.select(*KEYS, F.lit("create").alias("action"))


def withhold(plan: DataFrame, mappings: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The plan with column status ('withheld' towards a target that is read-only, else 'planned'), and warnings (mapping_id, warning)."""
    met = plan.join(mappings.select("mapping_id", F.col("writable").alias("__w")), "mapping_id", "left")
    held = (F.col("side") == "target") & ~F.coalesce("__w", F.lit(True))
    out = met.withColumn("status", F.when(held, "withheld").otherwise("planned")).drop("__w")
    return out, out.where("status = 'withheld'").select("mapping_id", F.concat(F.lit("target-readonly:"), "mapping_id").alias("warning")).distinct()


def prefers_source(source_time: Column, target_time: Column, tie: str = "target", on_null: str = "oldest") -> Column:
    """Last write wins: the source only if strictly newer; a missing time is oldest; ties go to the target.

    tie='source' gives ties to the source; on_null='source' gives it what lacks either time.
    """
    oldest = F.lit("0001-01-01").cast("timestamp")
    s, t = F.coalesce(source_time, oldest), F.coalesce(target_time, oldest)
    newer = s >= t if tie == "source" else s > t
    return F.when(source_time.isNull() | target_time.isNull(), True).otherwise(newer) if on_null == "source" else newer


#: How conflicts are resolved; 'ask' and 'skip' leave them open.
POLICIES = ("source", "target", "newest", "duplicate", "merge", "skip", "ask")


def resolve_records(diff: DataFrame, policy: str, mode: str = "two_way", merged: Column | None = None) -> DataFrame:
    """mapping_id, id, side, action, data, hash, baseline, conflict: every write of a diff, a row each.

    Columns of diff: those of three_way_diff. Other changes than conflicts flow as the mode lets them.
    'source', 'target', 'newest': the winner goes to the other side, a winner that was deleted deletes there.
    'duplicate': the side that is left goes to the other; if both are, the source's goes to the target and a
    clone of the target's, named <id>-dup-<digest>, to both, its uid in the payload ('UID:<id>') renamed too. 'merge': `merged`, an expression over diff, goes
    to both sides. 'skip' and 'ask': no write; the conflict's row has the side 'open'. baseline tells whether
    the written record becomes the agreed one; of several rows of an id it is told once.
    """
    if policy not in POLICIES or policy == "merge" and merged is None:
        raise ValueError(policy)
    s, t, conflict = F.col("s"), F.col("t"), F.col("op") == "conflict"
    text = F.col("id").cast("string")
    write = lambda side, action, data, hash_, id_=text, base=True, n=0: F.struct(F.lit(side).alias("side"), action.alias("action"), data.alias("data"), hash_.alias("hash"), id_.alias("id"), F.lit(base).alias("baseline"), F.lit(n).alias("conflicts"))
    none = F.lit(None).cast("string")
    src, tgt = (F.col("s_data").cast("string"), F.col("s_hash")), (F.col("t_data").cast("string"), F.col("t_hash"))
    put = lambda there: F.when(there, "update").otherwise("create")
    gone = lambda side: write(side, F.lit("delete"), none, none, base=False, n=1)
    to_target = F.array(F.when(s, write("target", put(t), *src, n=1)).otherwise(gone("target")))
    to_source = F.array(F.when(t, write("source", put(s), *tgt, n=1)).otherwise(gone("source")))
    if policy in ("source", "target", "newest"):
        wins = {"source": F.lit(True), "target": F.lit(False), "newest": prefers_source(F.col("s_last_modified"), F.col("t_last_modified"))}[policy]
        decided = F.when(wins, to_target).otherwise(to_source)
    elif policy == "duplicate":
        clone = F.concat(text, F.lit("-dup-"), F.substring(F.sha2(F.concat_ws("|", "mapping_id", "id", "t_hash"), 256), 1, 32))
        renamed = (F.replace(tgt[0], F.concat(F.lit("UID:"), text), F.concat(F.lit("UID:"), clone)), tgt[1])
        both = F.array(write("target", F.lit("update"), *src, n=1), write("target", F.lit("create"), *renamed, clone), write("source", F.lit("create"), *renamed, clone, base=False))
        decided = F.when(~s, to_source).when(~t, to_target).otherwise(both)
    elif policy == "merge":
        hash_ = F.sha2(merged, 256)
        decided = F.array(write("target", put(t), merged, hash_, n=1), write("source", put(s), merged, hash_, base=False))
    else:
        decided = F.array(write("open", F.lit(policy), none, none, base=False, n=1))
    is_delete = F.col("op") == "delete"
    data = lambda own, side: F.array(write(side, F.col("op"), F.when(is_delete, none).otherwise(own[0]), F.when(is_delete, none).otherwise(own[1])))
    flows = MODES[mode]
    plain = F.when((F.col("direction") == "to_target") & F.lit("target" in flows), data(src, "target")).when((F.col("direction") == "to_source") & F.lit("source" in flows), data(tgt, "source"))
    rows = diff.select("mapping_id", F.explode(F.when(conflict, decided).otherwise(plain)).alias("w"))
    return rows.select("mapping_id", "w.id", "w.side", "w.action", "w.data", "w.hash", (F.col("w.baseline") & (F.col("w.action") != "delete")).alias("baseline"), F.col("w.conflicts").alias("conflict"))


def conflict_counters(writes: DataFrame) -> DataFrame:
    """mapping_id, resolved, deferred: conflicts of resolve_records that were written and those left open."""
    n = lambda where, name: F.sum(F.when(where, F.col("conflict")).otherwise(0)).alias(name)
    return writes.groupBy("mapping_id").agg(n(F.col("side") != "open", "resolved"), n(F.col("side") == "open", "deferred"))


def resolve(diff: DataFrame, policy: str) -> DataFrame:
    """mapping_id, id, side, action: the writes of a diff; conflicts by policy ('source', 'target', 'newest', 'skip').

    A winning side that lacks the record deletes it on the other.
    """
    if policy not in ("source", "target", "newest", "skip"):
        raise ValueError(policy)
    wins = {"source": F.lit(True), "target": F.lit(False), "newest": prefers_source(F.col("s_last_modified"), F.col("t_last_modified")), "skip": F.lit(None).cast("boolean")}[policy]
    conflict = F.col("op") == "conflict"
    side = F.when(~conflict, F.regexp_replace("direction", "to_", "")).when(wins, "target").when(~wins, "source")
    winner, loser = F.when(F.col("w"), F.col("s")).otherwise(F.col("t")), F.when(F.col("w"), F.col("t")).otherwise(F.col("s"))
    action = F.when(~conflict, F.col("op")).when(~winner, "delete").when(~loser, "create").otherwise("update")
    return diff.withColumn("w", wins).select(*KEYS, side.alias("side"), action.alias("action")).where(F.col("side").isNotNull())


def apply_plan(destination: DataFrame, plan: DataFrame, records: DataFrame) -> DataFrame:
    """The destination after a plan (mapping_id, id, action): planned rows go, creates and updates come from records."""
    kept = destination.join(plan.select(*KEYS), KEYS, "left_anti")
    return kept.unionByName(records.join(plan.where("action <> 'delete'").select(*KEYS), KEYS, "left_semi").select(destination.columns))


def sync_stats(plan: DataFrame) -> DataFrame:
    """mapping_id, side, created, updated, deleted per mapping and side, with totals where these are null."""
    of = lambda action, name: F.count_if(F.col("action") == action).alias(name)
    return plan.rollup("mapping_id", "side").agg(of("create", "created"), of("update", "updated"), of("delete", "deleted"))


def run_stats(source: DataFrame, target: DataFrame, baseline: DataFrame, plan: DataFrame, results: DataFrame | None = None) -> DataFrame:
    """mapping_id, side, created, updated, deleted, unchanged, conflicts, errors of a run, with totals where mapping or side is null.

    plan: mapping_id, id, side, action. Without results all of it counts as done; with them (mapping_id, id, side,
    success) a write that failed or has no result is an error and nothing else. Unchanged keys count on both sides, a
    conflict on the side that its difference points to.
    """
    code = coded(source, target, baseline).select("mapping_id", "s", "t", "code")
    same = code.where("s and t and code is null").select("mapping_id", F.explode(F.array(F.lit("source"), F.lit("target"))).alias("side"), F.lit("unchanged").alias("what"))
    open_ = code.where("code like '%:conflict'").select("mapping_id", F.regexp_extract("code", "to_(.*):", 1).alias("side"), F.lit("conflicts").alias("what"))
    done = plan.select("mapping_id", "id", "side", "action")
    if results is not None:
        done = done.join(results.select("mapping_id", "id", "side", "success"), ["mapping_id", "id", "side"], "left").withColumn("action", F.when(F.coalesce("success", F.lit(False)), F.col("action")).otherwise("errors"))
    name = F.when(F.col("action") == "errors", "errors").when(F.col("action") == "delete", "deleted").otherwise(F.concat("action", F.lit("d")))
    rows = done.select("mapping_id", "side", name.alias("what")).unionByName(same).unionByName(open_)
    kinds = ("created", "updated", "deleted", "unchanged", "conflicts", "errors")
    return rows.rollup("mapping_id", "side").agg(*(F.count_if(F.col("what") == k).alias(k) for k in kinds)).where(F.col("mapping_id").isNotNull() | F.col("side").isNull())


def mass_delete_guard(plan: DataFrame, baseline: DataFrame, absolute: int = 10, percent: int = 25) -> DataFrame:
    """mapping_id, deletes, baselines, tripped: too many deletes, in number or as a share of the baseline."""
    deletes = plan.groupBy("mapping_id").agg(F.count_if(F.col("action") == "delete").alias("deletes"))
    known = baseline.groupBy("mapping_id").agg(F.count("*").alias("baselines"))
    rows = deletes.join(known, "mapping_id", "left").withColumn("baselines", F.coalesce("baselines", F.lit(0)))
    share = F.floor(F.col("deletes") * 100 / F.greatest("baselines", F.lit(1)))
    return rows.withColumn("tripped", (F.col("deletes") > absolute) | ((F.col("baselines") > 0) & (share > percent)))


def stats_summary(stats: DataFrame) -> DataFrame:
    """stats (created, updated, deleted, conflicts, errors) with a line '+c ~u -d =n !k Ee' (unchanged, conflicts and errors where given)."""
    of = lambda name: F.coalesce(F.col(name), F.lit(0)) if name in stats.columns else F.lit(0)
    return stats.withColumn("summary", F.format_string("+%d ~%d -%d =%d !%d E%d", *(of(c) for c in ("created", "updated", "deleted", "unchanged", "conflicts", "errors"))))


def guarded(plan: DataFrame, guard: DataFrame, allowed: DataFrame | None = None) -> DataFrame:
    """The plan without the deletes of mappings whose guard tripped and that were not allowed (mapping_id); other writes stay."""
    denied = guard.where("tripped").select("mapping_id")
    if allowed is not None:
        denied = denied.join(allowed.select("mapping_id"), "mapping_id", "left_anti")
    met = plan.join(denied.withColumn("__denied", F.lit(True)), "mapping_id", "left")
    return met.where("__denied is null or action <> 'delete'").drop("__denied")


def revision_digest(records: DataFrame) -> DataFrame:
    """mapping_id, digest: SHA-256 over id:rev; in numeric order of ids. For collections as in collection_digest."""
    rows = records.groupBy("mapping_id").agg(F.array_sort(F.collect_list(F.struct(F.col("id").cast("long").alias("id"), "rev"))).alias("rows"))
    return rows.select("mapping_id", F.sha2(F.array_join(F.transform("rows", lambda r: F.concat(r["id"].cast("string"), F.lit(":"), r["rev"].cast("string"), F.lit(";"))), ""), 256).alias("digest"))


def fingerprint(files: DataFrame) -> DataFrame:
    """folder, digest: SHA-256 over lines name|mtime|size in order of names. For folders as collections in collection_digest."""
    line = F.concat_ws("|", "name", F.col("mtime").cast("string"), F.col("size").cast("string"))
    rows = files.groupBy("folder").agg(F.array_sort(F.collect_list(F.struct("name", line.alias("line")))).alias("rows"))
    return rows.select("folder", F.sha2(F.array_join(F.transform("rows", lambda r: r["line"]), "\n"), 256).alias("digest"))


def collection_digest(records: DataFrame) -> DataFrame:
    """mapping_id, digest: SHA-256 over id, unit separator, hash, record separator in id order. One row a collection.

    A whole collection becomes one value in one task: for up to about 1,000,000 records each. Larger
    ones have bucketed_digest.
    """
    row = F.struct(F.col("id").cast("string").alias("id"), "hash")
    text = F.array_join(F.transform("rows", lambda r: F.concat(r["id"], F.lit("\x1f"), F.coalesce(r["hash"], F.lit("")), F.lit("\x1e"))), "")
    return records.groupBy("mapping_id").agg(F.array_sort(F.collect_list(row)).alias("rows")).select("mapping_id", F.sha2(text, 256).alias("digest"))


def bucketed_digest(records: DataFrame) -> DataFrame:
    """mapping_id, digest: SHA-256 over bucket, unit separator, bucket digest, record separator in bucket order.

    A record's bucket is the first four hex digits of its id's SHA-256, and a bucket's digest is that of
    collection_digest over its records, so the result depends on the records alone and a task holds a
    65,536th of a collection, or the digests of its buckets (at most 4.6 MB). Empty buckets are left out.
    """
    bucket = F.substring(F.sha2(F.col("id").cast("string"), 256), 1, 4)
    key = F.struct("mapping_id", bucket.alias("id"))
    leaves = collection_digest(records.select(key.alias("mapping_id"), "id", "hash"))
    return collection_digest(leaves.select("mapping_id.mapping_id", "mapping_id.id", F.col("digest").alias("hash")))


def bucketed_revision_digest(records: DataFrame) -> DataFrame:
    """mapping_id, digest of a collection's revisions (id, rev) by the buckets of bucketed_digest, for collections of any size."""
    return bucketed_digest(records.select("mapping_id", "id", F.col("rev").cast("string").alias("hash")))


def bucketed_fingerprint(files: DataFrame) -> DataFrame:
    """folder, digest of a folder's files (name, mtime, size) by the buckets of bucketed_digest, for folders of any size."""
    line = F.concat_ws("|", F.col("mtime").cast("string"), F.col("size").cast("string"))
    return bucketed_digest(files.select(F.col("folder").alias("mapping_id"), F.col("name").alias("id"), line.alias("hash"))).withColumnRenamed("mapping_id", "folder")


def dedupe_last(df: DataFrame, keys: list[str], seq: str) -> DataFrame:
    """The last row of each key by seq; rows with a null or empty key are dropped."""
    for key in keys:
        df = df.where(F.coalesce(F.col(key).cast("string"), F.lit("")) != "")
    return df.withColumn("__rank", F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc(seq)))).where("__rank = 1").drop("__rank")
