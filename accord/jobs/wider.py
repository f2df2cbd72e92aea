"""Queries on views, loss, stores, calendars, logs and texts over the derived collections, and the same in SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from accord.functions import ical, text, vendor
from accord.operators import aliases, canon, conflicts, identity, logs, loss, reconcile, store, topology, views
from accord.sources import derived, records
from accord.sources.shared import written

def _diff(spark, d):
    return reconcile.three_way_diff(*derived.collections(spark, d))


def _orders(spark, d):
    return derived.table(spark, d, "orders")


def _events(spark, d):
    return derived.table(spark, d, "events")


def _file_names(spark, d):
    p = derived.table(spark, d, "pages")
    kind = F.element_at(F.array(*map(F.lit, ("memos", "contacts", "calendar", "todos", "other"))), (F.col("page_id") % 5 + 1).cast("int"))
    name = F.when(F.col("page_id") % 7 == 0, "").otherwise(F.substring("html", 60, 40))
    return p.select("page_id", records.file_name(kind, name, F.col("url")).alias("name"))


def _oplog(spark, d):
    e, k = _events(spark, d), F.col("event_id")
    entry = F.concat(F.lit('[["feeds","f'), F.col("user_id"), F.lit('"],"t'), k, F.lit('","k'), k % 10, F.lit('",'), F.when(k % 6 == 0, "null").otherwise(F.concat(F.lit('{"b":1,"a":"'), "event_type", F.lit('"}'))), F.lit("]"))
    line = F.when(k % 13 == 0, "[1,2").when(k % 11 == 0, '["no path","t","k",1]').otherwise(entry)
    lines = e.select(F.concat(F.lit("app"), k % 4).alias("app_id"), F.lit("00").alias("bucket"), k.alias("line"), line.alias("text"))
    out = records.oplog_entries(lines)
    return out.select("app_id", "line", F.array_join("path", "/").alias("path"), "datetime", "key", "value", text.path_bucket(F.col("path")).alias("bucket"))


def _journal(spark, d):
    e, k = _events(spark, d), F.col("event_id")
    line = F.when(k % 9 == 0, "{").otherwise(F.format_string('{"op":"%s","uid":"u%d","data":"d%d"}', "event_type", "user_id", k))
    return e.select((F.col("user_id") % 10).alias("entity"), k.alias("seq"), line.alias("text"))


def _unacknowledged(spark, d):
    journal = _journal(spark, d)
    return records.discard_prefix(journal, journal.select("entity").distinct().where("entity < 5").withColumn("n", F.col("entity") * 3)).select("entity", "seq")


def _stamped(spark, d):
    rows = canon.stamp_filter(canon.stamp_filter(derived.tasks(spark, d), "categories", "contains", "c1"), "status", "equals", '"Z"')
    return rows.select("id", F.get_json_object("data", "$.categories").alias("categories"), F.get_json_object("data", "$.status").alias("status"), F.when(F.col("id") % 17 == 0, F.col("data")).alias("broken"))


def _lost(spark, d):
    rows = [("status", "dropped", ['"F"']), ("priority", "simplified", None), ("uid", "reversible", None), ("location", "dropped", None)]
    edges = spark.createDataFrame(rows, "property string, loss_kind string, lossless array<string>")
    return loss.materialized_loss(derived.tasks(spark, d), edges)


def _loss_verdicts(spark, d):
    m = derived.tasks(spark, d).select("mapping_id").distinct()
    policies = m.withColumn("policy", F.element_at(F.array(*map(F.lit, loss.POLICIES)), (F.substring("mapping_id", 2, 1).cast("int") % 3 + 1)))
    return loss.apply_loss_policy(_lost(spark, d), policies)


def _edges(spark, d):
    """Edges of conversions by part: their kind of loss, and the values that survive."""
    p, k = derived.table(spark, d, "part"), F.col("p_partkey")
    kind = F.element_at(F.array(*map(F.lit, loss.SEVERITY)), (k % 4 + 1).cast("int"))
    values = F.when(k % 3 != 0, F.array(F.concat(F.lit("v"), k % 2), F.lit("v2")))
    return p.select(F.concat(F.lit("e"), k % 10).alias("edge"), F.concat(F.lit("p"), F.floor(k / 10) % 7).alias("property"), kind.alias("loss_kind"), values.alias("lossless"), k.alias("k"))


def _composed(spark, d):
    rows = loss.compose_loss(_edges(spark, d).withColumnRenamed("edge", "path"))
    return rows.select("path", "property", "loss_kind", F.array_join("lossless", ",").alias("lossless"))


def _canon_json(spark, d):
    o, k = _orders(spark, d), F.col("o_orderkey")
    make = lambda status, priority, extra, kind: F.format_string('{"_canon":{"domain":"todo","kind":"%s","v":1},"uid":"o%d","status":"%s","priority":"%s","providerExtras":{"e":"%s"}}', kind, k, status, priority, extra)
    s, p = F.col("o_orderstatus"), F.col("o_orderpriority")
    one = lambda when, value, other: F.when(when, value).otherwise(other)
    side = lambda data: o.select(k.alias("uid"), data.alias("data"))
    source = side(make(one(k % 7 == 0, "S", s), p, F.lit("s"), one(k % 50 == 0, "note", F.lit("task"))))
    target = side(make(one(k % 5 == 0, "T", s), one(k % 3 == 0, "low", p), F.lit("t"), F.lit("task")))
    return source, target, side(make(s, p, F.lit("b"), F.lit("task"))).where("uid % 11 <> 0")


def _merged_json(spark, d):
    rows = canon.merge_records(*_canon_json(spark, d), ["status", "priority"], "target")
    read = F.from_json("data", "struct<status:string,priority:string,providerExtras:struct<e:string>,_canon:struct<kind:string>>")
    rows = rows.withColumn("x", read)
    return rows.select("uid", "x.status", "x.priority", F.col("x.providerExtras.e").alias("extras"), "x._canon.kind", F.array_join("changed_source", ",").alias("changed_source"), F.array_join("changed_target", ",").alias("changed_target"), "kind_mismatch")


def _canon_diff(spark, d):
    s, t, _ = _canon_json(spark, d)
    met = s.join(t.withColumnRenamed("data", "other"), "uid")
    return met.select("uid", F.array_join(canon.differing(F.col("data"), F.col("other"), ["status", "priority"]), ",").alias("changed"))


def _notes(spark, d):
    s, t, b = derived.canon(spark, d)
    side = lambda df, p: df.select("uid", *(F.col(c).alias(f"{p}_{c}") for c in ("body", "category")))
    met = side(s, "s").join(side(t, "t"), "uid").join(side(b, "b"), "uid")
    of = lambda p, time: {"body": F.col(f"{p}_body"), "categories": F.col(f"{p}_category"), "modified": time}
    m = canon.note_merge(of("s", F.lit("2024-01-02")), of("t", F.lit("2024-01-02")), of("b", F.lit("")), "newest")
    whole = canon.whole_merge(F.col("s_body"), F.col("t_body"), F.col("b_body"), "target")
    contact = canon.contact_merge(of("s", F.lit("")), of("t", F.lit("")), of("b", F.lit("")), F.col("uid") % 2 == 0, ["body", "categories"], "target")
    return met.select("uid", F.sha2(m["body"], 256).alias("body"), m["categories"].alias("category"), m["conflict"].alias("conflict"), F.sha2(whole, 256).alias("whole"), F.sha2(contact["body"], 256).alias("contact_body"), contact["categories"].alias("contact_category"))


def _writes(policy, mode="two_way"):
    columns = ["mapping_id", "id", "side", "action", "data", "baseline"]
    return lambda s, d: reconcile.resolve_records(_diff(s, d), policy, mode, F.concat_ws("+", "s_data", "t_data")).select(columns)


def _outcome(spark, d):
    plan = reconcile.resolve(_diff(spark, d), "newest")
    results = plan.where("id % 23 <> 1").select("mapping_id", "id", "side", (F.col("id") % 29 != 2).alias("success"))
    return store.apply_outcome(plan, results)


def _guarded(spark, d):
    plan, (_, _, baseline) = reconcile.resolve(_diff(spark, d), "newest"), derived.collections(spark, d)
    allowed = plan.select("mapping_id").distinct().where("mapping_id = 'm2'")
    return reconcile.guarded(plan, reconcile.mass_delete_guard(plan, baseline), allowed)


def _withheld(spark, d):
    plan = reconcile.resolve(_diff(spark, d), "newest")
    return reconcile.withhold(plan, plan.select("mapping_id", (F.col("mapping_id") != "m3").alias("writable")).distinct())[0]


def _baselines(spark, d):
    """Baselines under native ids, two of which collapse on one canonical id, and healed aliases."""
    s, t, b = derived.collections(spark, d)
    b = b.where("id % 16 < 8")
    native = b.select("mapping_id", "id", "source_hash", "target_hash").unionByName(b.select("mapping_id", (F.col("id") + 8).alias("id"), F.lit("stale").alias("source_hash"), "target_hash"))
    known = b.select("mapping_id", (F.col("id") + 8).alias("native_id"), F.col("id").alias("canonical_id"))
    return aliases.dedupe_baselines(native, known, s, t, "mapping_id"), aliases.harvest_baselines(s, t, known.select("mapping_id", "native_id", "canonical_id"), "mapping_id")


def _replayed(spark, d):
    rows = _diff(spark, d).where("op = 'conflict'").select("mapping_id", "id", "s_last_modified", "t_last_modified")
    held = rows.where("id % 3 <> 0").withColumn("decision", F.lit("source")).withColumn("s_last_modified", F.when(F.col("id") % 4 == 0, F.col("s_last_modified") + F.expr("interval 1 hour")).otherwise(F.col("s_last_modified") + F.expr("interval 1 millisecond")))
    return aliases.replay_resolutions(rows, held)


def _skips(spark, d):
    s, k = derived.table(spark, d, "supplier"), F.col("s_suppkey")
    m = s.select(k.alias("mapping_id"), F.col("s_nationkey").cast("long").alias("source"), (k % 40 + 100).alias("target"))
    ends = m.select(F.explode(F.array("source", "target")).alias("endpoint")).distinct()
    fresh = ends.select("endpoint", F.when(F.col("endpoint") % 10 == 0, "").otherwise(F.concat(F.lit("t"), "endpoint")).alias("token"))
    side = lambda name: m.select("mapping_id", F.lit(name).alias("side"), F.concat(F.when(F.col("mapping_id") % 3 == 0, "old").otherwise("t"), name).alias("token"))
    stored = side("source").unionByName(side("target"))
    skips = aliases.skip_unchanged(m, fresh, stored)
    return store.invalidate_skips(skips, m, ends.where("endpoint % 7 = 0"))


def _resolutions(spark, d):
    e, k = _events(spark, d), F.col("event_id")
    rows = e.select((F.col("user_id") % 5).alias("mapping_id"), F.col("user_id").alias("id"), F.when(k % 7 == 0, "skip").when(k % 5 == 0, "ask").otherwise(F.concat(F.lit("d"), k % 3)).alias("decision"), F.date_trunc("day", "ts").alias("resolved_at"), k.alias("seq"))
    return aliases.latest_resolutions(rows).select("mapping_id", "id", "decision", "seq")


def _phase(spark, d):
    s, t, b = (df.select(F.col("id").alias("uid"), F.lit("color").alias("property"), F.col("data").alias("value")) for df in derived.collections(spark, d))
    k = F.col("o_orderkey")
    m = _orders(spark, d).select(k.alias("uid"), F.when(k % 3 == 0, "download").otherwise("two_way").alias("mode"), F.when(k % 4 == 0, "ask").when(k % 4 == 1, "target").otherwise("newest").alias("policy"))
    return store.property_phase(s, t, b, m)


def _remote_ids(spark, d):
    k = F.col("o_orderkey")
    rows = _orders(spark, d).select((k % 4).alias("backend"), k.alias("uid"), F.when(k % 3 == 0, F.col("o_orderdate")).alias("recurrence_id"))
    maps = _orders(spark, d).where("o_orderkey % 5 <> 0").select((k % 4).alias("backend"), k.alias("local_uid"), F.when(k % 3 == 0, F.col("o_orderdate")).alias("recurrence_id"), F.concat(F.lit("r"), F.floor(k / 2)).alias("remote_id"))
    ahead = store.target_id_for(rows, maps).select("backend", "uid", "remote_id")
    return store.source_uid_for(ahead, maps)


def _incidences(spark, d):
    k = F.substring("uid", 2, 20).cast("long")
    rows = written(ical.ical_properties(derived.calendar(spark, d)).where("property in ('SUMMARY', 'STATUS', 'TRIGGER')"))
    a = rows.withColumn("value", F.when((k % 7 == 0) & (F.col("property") == "STATUS"), "A").otherwise(F.col("value")))
    b = rows.where(~((k % 6 == 0) & (F.col("property") == "SUMMARY"))).withColumn("value", F.when((k % 5 == 0) & (F.col("property") == "STATUS"), "B").otherwise(F.col("value")))
    return a, b, rows


def _resolved_incidences(spark, d):
    a, b, base = _incidences(spark, d)
    return ical.apply_resolutions(base, ical.incidence_diff(a, b, base))


def _exceptions(spark, d):
    a, b, _ = _incidences(spark, d)
    return ical.exception_changes(a, b.withColumn("recurrence_id", F.lit("r1")))


def _reabsorbed(spark, d):
    k, start = F.col("o_orderkey"), F.col("o_orderdate")
    rows = _orders(spark, d)
    held = lambda status: F.create_map(F.lit("STATUS"), status)
    masters = rows.select(k.alias("uid"), start.alias("start"), (start + F.expr("interval 1 hour")).alias("end"), held(F.col("o_orderstatus")).alias("held"))
    at = start + F.make_interval(days=F.lit(7), hours=F.when(k % 5 == 0, 1).otherwise(0))
    exceptions = rows.select(k.alias("uid"), F.lit("r").alias("recurrence_id"), at.alias("start"), (at + F.make_interval(hours=F.when(k % 3 == 0, 2).otherwise(1))).alias("end"), (start + F.expr("interval 7 days")).alias("occurrence"), (k % 10 == 0).alias("all_day"), held(F.when(k % 7 == 0, "X").otherwise(F.col("o_orderstatus"))).alias("held"))
    return ical.reabsorbable(masters, exceptions)


def _recurrences(spark, d):
    rows = derived.calendar(spark, d).select("uid", ical.recurrence_lines(F.col("data"), "VEVENT").alias("lines"))
    lines = F.array(F.concat(F.lit("RRULE:FREQ=HOURLY;INTERVAL=2;UNTIL="), "uid"))
    return rows.select("uid", F.array_join("lines", " ").alias("lines"), text.is_complex_recurrence(F.col("lines")).alias("complex"), text.simplify_recurrence(F.col("lines")).alias("simple"), text.simplify_recurrence(lines).alias("hourly"))


def _semantic(spark, d):
    k = F.col("o_orderkey")
    fields = {"UID": k, "TYPE": F.lit("0"), "SUMMARY": F.col("o_orderstatus"), "CATEGORIES": F.array(F.concat(F.lit("c"), k % 7), F.concat(F.lit("c"), k % 5)), "ORGANIZER": F.when(k % 2 == 0, "ann@x")}
    return _orders(spark, d).select("o_orderkey", ical.semantic_hash(fields).alias("digest"))


def _formats(spark, d):
    p, k = derived.table(spark, d, "part"), F.col("p_partkey")
    line = F.format_string("x (%s) %s due:2024-05-%02d +home @c%d", F.chr(k % 26 + 65), "p_name", k % 28 + 1, k % 9)
    t = text.parse_todotxt(line)
    md = text.to_markdown(F.concat(F.lit("title: "), "p_name", F.lit("\n")), F.concat(F.lit("n"), k), F.concat("p_type", F.lit("\n\n\n")))
    note = text.parse_markdown(md)
    again = text.to_todotxt(t["done"], t["priority"], t["due"], t["categories"], t["summary"])
    return p.select("p_partkey", t["summary"].alias("summary"), F.array_join(t["categories"], ",").alias("categories"), again.alias("line"), md.alias("note"), note["id"].alias("note_id"), note["body"].alias("body"), text.property_from_carrier(text.carrier_key(F.lit("busyStatus"), "x-"), "x-").alias("carrier"))


def _vendor_tasks(spark, d):
    p, k = derived.spread(derived.table(spark, d, "part").select("p_partkey", "p_name")), F.col("p_partkey")
    task = F.format_string('{"id":"t%d","title":"%s","due":"2024-05-%02dT00:00:00Z","etag":"e%d","links":[%d]}', k, "p_name", k % 28 + 1, k, k % 3)
    field = lambda path: F.get_json_object("task", path)
    event = vendor.google_event_to_canon(F.format_string('{"id":"e%d","summary":"%s","status":"CONFIRMED","locked":true,"sequence":%d,"start":{"date":"2024-01-01"},"created":"2024-01-01T10:00:00+02:00","attendees":[{"email":"a@x","displayName":"A"},{"displayName":"B"}]}', k, "p_name", k % 5))
    of = lambda path: F.get_json_object("event", path)
    contact = F.format_string('{"emailAddresses":[{"address":"a%d@x","name":"A"},{"address":""}],"primaryEmailAddress":{"address":"%s"},"homePhones":["1",""],"mobilePhone":"%d"}', k, F.when(k % 2 == 0, F.concat(F.lit("a"), k, F.lit("@x"))).otherwise("main@x"), k)
    mails = F.array_join(F.transform(vendor.ms_contact_emails(contact), lambda e: F.concat(e["value"], F.when(e["primary"], "*").otherwise(""))), ",")
    phones = F.array_join(F.transform(vendor.ms_contact_phones(contact), lambda e: F.concat_ws(":", e["type"], e["value"])), ",")
    # converted in a projection of its own, so that no field converts its text anew
    p = p.select("p_partkey", vendor.google_task_to_canon(task).alias("task"), event.alias("event"), mails.alias("mails"), phones.alias("phones"))
    return p.select("p_partkey", field("$.uid").alias("uid"), field("$.summary").alias("summary"), field("$.due.date").alias("due"), field("$.providerExtras.google.links").alias("links"), field("$.providerExtrasDigest").alias("digest"), of("$.uid").alias("event"), of("$.status").alias("status"), of("$.created").alias("created"), of("$.allDay").alias("all_day"), of("$.locked").alias("locked"), of("$.attendees").alias("attendees"), of("$.sequence").alias("sequence"), "mails", "phones")


def _flat(spark, d):
    rows = derived.tasks(spark, d).where("id % 17 <> 0")
    return vendor.flatten_json(rows, "id", "data")


def _discovered(spark, d):
    s, k = derived.table(spark, d, "supplier"), F.col("s_suppkey")
    return topology.auto_match(
        s.select((F.col("s_nationkey") % 3).alias("backend"), k.alias("calendar"), F.concat(F.lit(" Cal"), k % 12, F.when(k % 2 == 0, " ").otherwise("")).alias("name"), k.alias("seq"), (k % 5 != 0).alias("events"), (k % 12 == 3).alias("todos"), F.when(k % 4 == 3, F.concat(F.lit("#"), k)).alias("color")),
        [0, 1, 2, 3], s.select(F.lit("CAL5").alias("name")).limit(1),
    )


def _winners(spark, d):
    log = derived.property_log(spark, d)
    old = log.where(F.col("datetime") < F.lit("2024-01-10").cast("timestamp")).withColumn("place", F.rank().over(identity.Window.partitionBy("uid").orderBy(F.desc("datetime"), F.asc("app_id"), F.asc("seq")))).where("place = 1")
    return logs.conflict_winners(log, old.select("uid", "property", "value"))


def _skeletons(spark, d):
    e, k = _events(spark, d), F.col("event_id")
    kind = F.when(k % 8 == 0, "full").when(k % 50 == 1, "gone").otherwise("skeleton")
    held = F.map_from_entries(F.array_compact(F.array(F.struct(F.lit("type").alias("key"), F.when(k % 6 != 0, F.col("event_type")).alias("value")), F.when(k % 3 == 0, F.struct(F.lit("k").alias("key"), k.cast("string").alias("value"))))))
    return logs.apply_skeletons(e.select(F.col("user_id").alias("id"), k.alias("seq"), kind.alias("kind"), held.alias("held")))


def _promoted(spark, d):
    b = derived.bindings(spark, d)
    chosen = b.groupBy("calendar").agg(F.max("backend").alias("backend")).where("calendar % 2 = 0")
    return topology.promote_primary(b, chosen).select("calendar", "backend", "role", "position")


def _pseudonyms(spark, d):
    rows = _events(spark, d).select("event_id", F.concat(F.lit("u"), "user_id", F.lit("@x")).alias("email"))
    return vendor.pseudonymise(rows, "event_id", {"email": "person"})


def _new_entries(spark, d):
    k = F.col("seq")
    log = derived.log(spark, d).select("uid", "app_id", F.lpad(F.conv(F.col("uid").cast("string"), 10, 16), 2, "0").alias("bucket"), k.alias("sequence"))
    tracked = log.where("uid % 3 = 0").groupBy("app_id", "bucket").agg(F.floor(F.avg("sequence")).alias("sequence"))
    return logs.new_entries(log, tracked, "app1").select("app_id", "uid", "sequence")


def _compacted_buckets(spark, d):
    log = derived.log(spark, d).withColumn("bucket", F.col("uid") % 200)
    sequences = log.select("app_id", "bucket").distinct().withColumn("sequence", F.lit(5).cast("long"))
    return logs.shrunk_buckets(log, logs.latest_per_writer(log), sequences)


QUERIES = {
    "s3_hub_ids": lambda s, d: derived.collections(s, d)[0].select(records.decode_id(records.encode_id(F.col("mapping_id"), F.concat(F.col("id").cast("string"), F.lit("\x01x")))).alias("x")).select("x.*"),
    "s4_file_names": _file_names,
    "s5_oplog_entries": _oplog,
    "s6_replay_journal": lambda s, d: records.replay_journal(_journal(s, d)).drop("recurrence_id"),
    "s6_discard_prefix": _unacknowledged,
    "s8_delete_keys": lambda s, d: aliases.delete_keys(derived.collections(s, d)[2].select("mapping_id", "id"), derived.collections(s, d)[0].where("id % 4 = 0"), ["mapping_id", "id"]),
    "s10_readonly_target": _withheld,
    "p3_contains_view": lambda s, d: canon.filtered_view(derived.tasks(s, d), "categories", "contains", "c1").select("id"),
    "p3_equals_view": lambda s, d: canon.filtered_view(derived.tasks(s, d), "status", "equals", ' "F"').select("id"),
    "p4_stamp_filter": _stamped,
    "p5_demux": lambda s, d: views.demux(derived.calendar(s, d), ["VEVENT", "VTODO"]).select("uid", "kind"),
    "p6_modified_since": lambda s, d: views.modified_since(derived.tasks(s, d), F.lit("1999-01-01").cast("timestamp"), inclusive=False).select("id"),
    "p7_feed_window": lambda s, d: views.feed_window(derived.tasks(s, d), F.lit("1998-06-15").cast("date"), "last_modified").select("id"),
    "p10_materialized_loss": lambda s, d: _lost(s, d).select("mapping_id", "id", F.array_join("lost", ",").alias("lost")),
    "p11_loss_policy": _loss_verdicts,
    "p12_emptied": lambda s, d: views.failed_by_emptying(derived.tasks(s, d).select("mapping_id", F.col("data").alias("before"), F.when((F.col("id") % 64 == 3), "").otherwise(F.col("data")).alias("after"))),
    "j2_sync_upload": lambda s, d: reconcile.sync_diff(*derived.collections(s, d), "upload"),
    "j2_sync_download": lambda s, d: reconcile.sync_diff(*derived.collections(s, d), "download"),
    "j3_quick_upload": lambda s, d: reconcile.quick_diff(*derived.collections(s, d)[:2], "upload"),
    "j8_dedupe_baselines": lambda s, d: _baselines(s, d)[0],
    "j10_harvest_baselines": lambda s, d: _baselines(s, d)[1],
    "j11_mirror_b_to_a": lambda s, d: reconcile.mirror(_diff(s, d), "b_to_a"),
    "j14_replay": _replayed,
    "j16_invalidate_skips": _skips,
    "j19_property_phase": _phase,
    "j20_remote_ids": _remote_ids,
    "j22_exception_changes": _exceptions,
    "j23_reabsorbable": _reabsorbed,
    "c1_records_newest": _writes("newest"),
    "c1_records_source_download": _writes("source", "download"),
    "c1_records_merge": _writes("merge"),
    "c3_duplicate": _writes("duplicate"),
    "c1_counters": lambda s, d: reconcile.conflict_counters(reconcile.resolve_records(_diff(s, d), "ask")),
    "c4_hold_unresolved": lambda s, d: conflicts.hold_unresolved(reconcile.resolve(_diff(s, d), "newest"), conflicts.handle_conflicts(_diff(s, d).where("mapping_id < 'm4'"), "newest", "delete")),
    "c6_canon_diff": _canon_diff,
    "c7_canon_merge_json": _merged_json,
    "c8_typed_merges": _notes,
    "c12_incidence_diff": lambda s, d: ical.incidence_diff(*_incidences(s, d)),
    "c14_apply_resolutions": _resolved_incidences,
    "c19_resolve_all": lambda s, d: store.resolve_all(derived.conflict_store(s, d)[0], "target", F.lit("2024-02-01").cast("timestamp"), "m1").select("id", "decision", F.col("resolved_at").isNotNull().alias("resolved")),
    "c19_consume": lambda s, d: store.consume(derived.conflict_store(s, d)[0], F.lit("2024-02-01").cast("timestamp"))[0].select("id", "decision"),
    "c20_record_conflicts": lambda s, d: store.record_conflicts(*derived.conflict_store(s, d)).select(F.when(F.col("id").startswith("x"), F.col("id")).alias("id"), "mapping_id", "uid", "detected_at", "decision"),
    "o1_pending_conflicts": lambda s, d: store.pending_conflicts(derived.conflict_store(s, d)[0]).select("id", "detected_at"),
    "a6_unresolved_count": lambda s, d: store.unresolved_count(derived.conflict_store(s, d)[0]),
    "a1_summary": lambda s, d: reconcile.stats_summary(reconcile.sync_stats(reconcile.resolve(_diff(s, d), "newest"))).select("mapping_id", "side", "summary"),
    "a1b_apply_outcome": _outcome,
    "a3_revision_digest": lambda s, d: reconcile.revision_digest(_orders(s, d).select((F.col("o_orderkey") % 400).alias("mapping_id"), F.col("o_orderkey").alias("id"), (F.col("o_custkey") % 10).alias("rev"))),
    "a4_fingerprint": lambda s, d: reconcile.fingerprint(derived.table(s, d, "pages").select((F.col("page_id") % 20).alias("folder"), F.col("url").alias("name"), (F.col("page_id") * 7).alias("mtime"), F.octet_length("html").alias("size"))),
    "a5_guarded_plan": _guarded,
    "a7_compose_loss": _composed,
    "a8_loss_summary": lambda s, d: loss.loss_summary(_edges(s, d)),
    "a9_bucket_sequences": _compacted_buckets,
    "a10_new_apps": lambda s, d: logs.new_apps(derived.log(s, d), derived.log(s, d).where("app_id < 'app2'")),
    "a10_purge_dead": lambda s, d: logs.purge_dead(derived.log(s, d).where("app_id <> 'app3' or seq < 500"), "2024-01-20").select("app_id", "seq"),
    "a11_onboarding": lambda s, d: logs.onboarding_snapshot(logs.newest(derived.log(s, d), "uid").where("value is not null").select("uid", "value", F.col("datetime").alias("written_at")), logs.newest(derived.log(s, d), "uid").where("value is null")),
    "a13_auto_match": _discovered,
    "a15_unlink": lambda s, d: identity.unlink(*(lambda e: (e.select(F.lit("contacts").alias("domain"), "record", F.floor(F.col("record") / 10).alias("entity")).distinct(), e.select(F.floor(F.col("record") / 10).alias("entity"), "email").distinct(), e.where("record % 10 > 4 or record % 70 < 10").select(F.lit("contacts").alias("domain"), "record").distinct()))(derived.contacts(s, d)))[1],
    "a16_validate": lambda s, d: topology.validate_bindings(derived.bindings(s, d)),
    "a17_promote": _promoted,
    "u4_star_bindings": lambda s, d: topology.generate_mappings(derived.bindings(s, d), "star"),
    "u4_mirror_bindings": lambda s, d: topology.generate_mappings(derived.bindings(s, d), "mirror"),
    "u4_chain_bindings": lambda s, d: topology.generate_mappings(derived.bindings(s, d), "chain"),
    "w3_latest_info": lambda s, d: logs.latest_info(derived.log(s, d).withColumn("key", F.col("uid") % 13)),
    "w4_latest_resolutions": _resolutions,
    "w8_conflict_winners": _winners,
    "w9_skeletons": _skeletons,
    "t3_new_entries": _new_entries,
    "o4_limit_auto": lambda s, d: conflicts.limit_auto(conflicts.handle_conflicts(_diff(s, d), "oldest"), 3).select("mapping_id", "id", "decision"),
    "c16_oldest": lambda s, d: conflicts.handle_conflicts(_diff(s, d), "oldest").select("mapping_id", "id", "decision"),
    "c16_source": lambda s, d: conflicts.handle_conflicts(_diff(s, d), "source", "delete", "use_default", "pending").select("mapping_id", "id", "decision", "resolved_by"),
    "f2_semantic_hash": _semantic,
    "f4_extras_digest": lambda s, d: derived.tasks(s, d).select("id", canon.extras_digest(F.col("data")).alias("digest")),
    "f5_envelope": lambda s, d: derived.tasks(s, d).where("id % 17 <> 0 and id % 19 <> 0").select("id", canon.stamp_envelope(F.col("data"), "todo", F.concat(F.lit("z"), "id"), F.lit("task")).alias("c")).select("id", canon.read_uid(F.col("c")).alias("uid"), canon.read_kind(F.col("c")).alias("kind"), F.get_json_object("c", "$._canon.domain").alias("domain")),
    "f8_ical_properties": lambda s, d: ical.ical_properties(derived.calendar(s, d)),
    "f9_recurrence_lines": _recurrences,
    "f14_text_formats": _formats,
    "f16_vendor_json": _vendor_tasks,
    "f19_calendar_id": lambda s, d: derived.table(s, d, "part").select("p_partkey", text.calendar_id(F.concat(F.lit("É_"), "p_name", F.lit(" #!"), F.col("p_size"))).alias("calendar")),
    "f20_properties_hash": lambda s, d: derived.table(s, d, "part").select("p_partkey", text.properties_hash(F.when(F.col("p_partkey") % 3 != 0, "#FF00AA11"), F.when(F.col("p_partkey") % 2 == 0, F.col("p_name")).otherwise("")).alias("digest")),
    "f22_flatten_json": _flat,
    "f24_pseudonyms": _pseudonyms,
}
