"""Rules of reconciliation on hand-written records: each case shows what a simpler rule would get wrong."""

import json

import pytest
from pyspark.sql import functions as F

from accord.functions import ical
from accord.functions.vendor import google_event_to_canon, google_task_to_canon
from accord.operators import aliases, canon, conflicts, identity, logs, reconcile, topology
from accord.sources import records
from accord.streaming import feed

BINDINGS = "calendar string, backend string, remote string, role string, enabled boolean, position int"


def mappings(spark, rows, topology_, calendars=None):
    return sorted((r.first, r.second, r.id) for r in topology.generate_mappings(spark.createDataFrame(rows, BINDINGS), topology_, calendars).collect())


def test_only_enabled_bindings_are_mapped(spark):
    rows = [("c", "p", "r0", "primary", True, 0), ("c", "a", "r1", "sync1", False, 1), ("c", "b", "r2", "sync2", True, 3), ("c", "d", "r3", "readonly", True, 2), ("c", "e", "r4", "sync3", True, 2), ("c", "p", "r0", "sync4", True, 4)]
    assert mappings(spark, rows, "star") == [("p", "b", "auto_c_sync2"), ("p", "e", "auto_c_sync3")]
    assert mappings(spark, rows, "chain") == [("e", "b", "auto_c_chain_e_b"), ("p", "e", "auto_c_chain_p_e")]
    assert len(mappings(spark, rows, "mirror")) == 3
    off = [("c", "p", "r0", "primary", False, 0), *rows[1:]]
    assert mappings(spark, off, "star") == [] and mappings(spark, [("c", "p", "", "primary", True, 0), *rows[1:]], "star") == []
    with pytest.raises(ValueError, match="ring"):
        topology.generate_mappings(spark.createDataFrame(rows, BINDINGS), "ring")


def test_a_calendars_policy_goes_before_the_topology(spark):
    rows = [(c, b, "r", r, True, k) for c in ("hub", "mesh", "chain", "manual", "other", "off") for k, (b, r) in enumerate([("p", "primary"), ("a", "sync1"), ("b", "sync2")])]
    calendars = spark.createDataFrame([(c, None if c == "other" else "hub" if c == "off" else c, c != "off") for c in ("hub", "mesh", "chain", "manual", "other", "off")], "calendar string, policy string, sync_enabled boolean")
    got = [i for *_, i in mappings(spark, rows, "star", calendars)]
    assert sorted(got) == ["auto_chain_chain_a_b", "auto_chain_chain_p_a", "auto_hub_sync1", "auto_hub_sync2", "auto_mesh_mirror_a_b", "auto_mesh_mirror_p_a", "auto_mesh_mirror_p_b", "auto_other_sync1", "auto_other_sync2"]


LOG, AGREED = "uid string, app_id string, datetime string, seq long, property string, value string", "uid string, property string, value string"


def winners(spark, entries, agreed=(("u", "p", "old"),)):
    log = spark.createDataFrame([("u", app, time, 1, "p", value) for app, time, value in entries], LOG)
    return [tuple(r) for r in logs.conflict_winners(log, spark.createDataFrame(list(agreed), AGREED)).collect()]


def test_only_changes_can_win(spark):
    assert winners(spark, [("a", "1", "x"), ("b", "2", "y"), ("c", "3", "old")]) == [("u", "p", "y", "b", "x", "a")]
    assert winners(spark, [("a", "1", "y"), ("b", "2", "x"), ("c", "3", "x")]) == [("u", "p", "x", "c", "x", "b")]
    assert winners(spark, [("a", "1", "x"), ("b", "2", "x"), ("c", "3", "old")]) == [] == winners(spark, [("a", "1", "x"), ("b", "2", "y")], [("v", "p", "old")])
    assert winners(spark, [("a", "1", "x"), ("b", "2", "")]) == [("u", "p", "", "b", "x", "a")]


def test_clones_are_named_in_their_payload(spark):
    side = lambda text, h: spark.createDataFrame([("m", "u1", text, h, None)], "mapping_id string, id string, data string, hash string, last_modified timestamp")
    base = spark.createDataFrame([("m", "u1", "b", "b", "x")], "mapping_id string, id string, source_hash string, target_hash string, data string")
    writes = reconcile.resolve_records(reconcile.three_way_diff(side("UID:u1 mine", "s"), side("BEGIN UID:u1 theirs", "t"), base), "duplicate").collect()
    clone = {r.id for r in writes} - {"u1"}
    (name,) = clone
    assert sorted((r.side, r.id, r.data) for r in writes) == sorted([("target", "u1", "UID:u1 mine"), ("target", name, f"BEGIN UID:{name} theirs"), ("source", name, f"BEGIN UID:{name} theirs")])


def test_json_keeps_control_characters_and_the_last_of_repeated_keys(spark):
    one = lambda c: spark.range(1).select(c.alias("x")).first().x
    uid = "u\x01\t\"\\\n2024"
    stamped = one(canon.stamp_envelope(F.lit('{"a\\tb":1}'), "todo", F.lit(uid)))
    assert json.loads(stamped) == {"_canon": {"domain": "todo", "v": 1}, "a\tb": 1, "uid": uid} and one(canon.read_uid(F.lit(stamped))) == uid
    assert one(canon.properties(F.lit('{"a":1,"b":2,"a":"x"}'))) == {"a": '"x"', "b": "2"} and one(canon.properties(F.lit("[1]"))) == {}
    assert one(canon.matches(F.lit('{"a.b":["x\\t1"]}'), "a.b", "contains", "x\t1")) and not one(canon.matches(F.lit('{"a":{"b":["x"]}}'), "a.b", "contains", "x"))
    assert one(canon.matches(F.lit('{"a.b":{"c":1}}'), "a.b", "equals", '{"c": 1}'))
    assert json.loads(one(canon.stamped(F.lit('{"a.b":["x"]}'), "a.b", "contains", "y"))) == {"a.b": ["x", "y"]}


def test_nulls_in_plans(spark):
    side = lambda *rows: spark.createDataFrame([("m", *r) for r in rows], "mapping_id string, id string, data string, hash string")
    got = reconcile.first_sync_plan(side(("a", "x", None), ("b", "x", None), ("c", "x", "h")), side(("a", "y", "h"), ("b", "x", None), ("c", "x", "h")))
    assert [(r.id, r.action) for r in got.collect()] == [("a", "update")]
    diff = reconcile.sync_diff(side(("a", None, "h")), side(("b", "v", "h")).limit(0), side(("a", "v", "h")).limit(0))
    assert [(r.id, r.outcome) for r in diff.collect()] == [("a", "create_target")]


def test_a_clobber_creates_everything_and_deletes_nothing(spark):
    rows = spark.createDataFrame([("m", k) for k in "abc"], "mapping_id string, id string")
    plan = reconcile.clobber_plan(rows, rows.where("id = 'c'"))
    assert sorted((r.id, r.action) for r in plan.collect()) == [("a", "create"), ("b", "create"), ("c", "create")] and reconcile.clobber_plan(rows.limit(0), rows).count() == 0


def test_upserts_take_the_last_change(spark):
    now = spark.createDataFrame([("a", 1, "old"), ("b", 1, "kept")], "k string, n int, v string")
    changes = spark.createDataFrame([("a", 3, "new"), ("a", 2, "between"), ("c", 1, "x"), ("c", 1, "x")], "k string, n int, v string")
    assert sorted(tuple(r) for r in aliases.upsert(now, changes, ["k"], "n").collect()) == [("a", 3, "new"), ("b", 1, "kept"), ("c", 1, "x")]
    assert sorted(tuple(r) for r in aliases.upsert(now, changes, ["k"]).collect()) == [("a", 3, "new"), ("b", 1, "kept"), ("c", 1, "x")]


def test_repeated_aliases_stay_single(spark):
    rows = [("m", "a", "b"), ("m", "a", "b"), ("m", "b", "c"), ("m", "b", "c"), ("m", "x", "c")]
    got = aliases.heal_aliases(spark.createDataFrame(rows, "m string, native_id string, canonical_id string"), "m").collect()
    assert sorted((r.native_id, r.canonical_id) for r in got) == [("a", "c"), ("b", "c"), ("x", "c")]


def test_an_abort_holds_its_mapping(spark):
    plan = spark.createDataFrame([("m1", 1), ("m2", 2), ("m3", 3)], "mapping_id string, id int")
    open_ = spark.createDataFrame([("m1", "abort"), ("m2", "source")], "mapping_id string, decision string")
    assert sorted(r.mapping_id for r in conflicts.hold_unresolved(plan, open_).collect()) == ["m2", "m3"]


def test_large_and_odd_vendor_numbers(spark):
    event = lambda more: json.loads(spark.range(1).select(google_event_to_canon(F.lit('{"id":"e","start":{"dateTime":"2024-01-01T10:00:00Z"},%s}' % more)).alias("x")).first().x)
    assert "sequence" not in event('"sequence":1e400') and "sequence" not in event('"sequence":99999999999999999999999') and event('"sequence":7.0')["sequence"] == 7
    assert event('"attendees":[{"email":"a@x","displayName":"q\\"\\u0001"},{"displayName":"B"},7]')["attendees"] == [{"email": "a@x", "name": 'q"\x01'}]
    assert spark.range(1).select(google_event_to_canon(F.lit("[]")).alias("x"), google_task_to_canon(F.lit("no")).alias("y")).first() == (None, None)


def test_display_formats(spark):
    cases = {
        ("STATUS", "IN-PROCESS"): "In Process", ("PRIORITY", "0"): "None", ("PRIORITY", "2"): "2 (High)", ("PRIORITY", "5"): "5 (Medium)", ("PRIORITY", "9"): "9 (Low)", ("PRIORITY", "x"): "x",
        ("RRULE", "FREQ=DAILY"): "Daily", ("RRULE", "RRULE:FREQ=WEEKLY;INTERVAL=2"): "Weekly, every 2", ("DTSTART", "20240102T030405Z"): "2024-01-02 03:04", ("DTSTART", "TZID=Europe/Paris:20240102"): "2024-01-02", ("SUMMARY", "text"): "text",
    }
    for (name, value), want in cases.items():
        assert spark.range(1).select(ical.format_property(name, F.lit(value)).alias("x")).first().x == want, (name, value)


def test_entities_in_order(spark):
    links = spark.createDataFrame([("notes", "b", "e1"), ("contacts", "z", "e1"), ("contacts", "a", "e1"), ("contacts", "q", "e0")], "domain string, record string, entity string")
    assert [tuple(r) for r in identity.records_for_entity(links).collect()] == [("e0", "contacts", "q"), ("e1", "contacts", "a"), ("e1", "contacts", "z"), ("e1", "notes", "b")]
    index = spark.createDataFrame([("B@x", "e1"), ("b@x", "e1"), ("a@x", "e1")], "email string, entity string")
    assert [tuple(r) for r in identity.emails_for_entity(index).collect()] == [("e1", "a@x"), ("e1", "b@x")]


def test_first_occurrences_and_members(spark):
    people = spark.createDataFrame([("e", 2, "A@x"), ("e", 1, "a@X"), ("e", 3, ""), ("e", 4, None), ("f", 9, "a@x")], "event string, position int, email string")
    assert sorted((r.event, r.position) for r in logs.first_occurrences(people, "event", "email", "position").collect()) == [("e", 1), ("f", 9)]
    creates = lambda *rows: spark.createDataFrame([("m", *r) for r in rows], "m string, id string, digest string")
    got = aliases.identity_conflict_members(creates(("a", "1"), ("b", "1"), ("c", "2")), creates(("x", "1"), ("y", "3")), "m")
    assert sorted((r.side, r.id) for r in got.collect()) == [("source", "a"), ("source", "b"), ("target", "x")]


def test_entries_without_a_time_never_win(spark, tmp_path):
    source = str(tmp_path / "in")
    query_of = lambda schema: feed.lww_stream(spark.readStream.schema(schema).json(source), "k", "t", "v")
    rows = [{"k": "a", "t": None, "v": "none"}, {"k": "a", "t": 2, "v": "two"}, {"k": "b", "t": None, "v": "only"}]
    (tmp_path / "in").mkdir()
    (tmp_path / "in/1.json").write_text("\n".join(map(json.dumps, rows)))
    for kind in ("long", "string"):
        name = f"lww_{kind}"
        q = query_of(f"k string, t {kind}, v string").writeStream.format("memory").queryName(name).outputMode("update").option("checkpointLocation", str(tmp_path / name)).trigger(availableNow=True).start()
        q.awaitTermination(120)
        assert [(r.k, str(r.t), r.v) for r in spark.table(name).collect()] == [("a", "2", "two")]


def test_a_new_checkpoint_does_not_write_over_a_state(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in/1.json").write_text('{"id":"a","seq":1,"deleted":false}')
    stream = lambda: spark.readStream.schema("id string, seq long, deleted boolean").json(str(tmp_path / "in"))
    state = str(tmp_path / "state")
    feed.apply_feed(stream(), state, str(tmp_path / "one"), "id", "seq").awaitTermination(120)
    with pytest.raises(ValueError, match="another checkpoint"):
        feed.apply_feed(stream(), state, str(tmp_path / "two"), "id", "seq")
    (tmp_path / "in/2.json").write_text('{"id":"b","seq":2,"deleted":false}')
    feed.apply_feed(stream(), state, str(tmp_path / "one"), "id", "seq").awaitTermination(120)
    schema = stream().schema
    assert sorted(r.id for r in feed.read_state(spark, state, schema, "id", "seq").collect()) == ["a", "b"]
    feed.apply_feed(stream(), state, str(tmp_path / "three"), "id", "seq", full_refresh=True).awaitTermination(120)
    assert sorted(r.id for r in feed.read_state(spark, state, schema, "id", "seq").collect()) == ["a", "b"]


def test_old_versions_of_a_feed_go(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(feed, "COMPACT", 2)
    (tmp_path / "in").mkdir()
    state, check = str(tmp_path / "state"), str(tmp_path / "check")
    for k in range(7):
        (tmp_path / f"in/{k}.json").write_text(json.dumps({"id": f"r{k % 3}", "seq": k, "deleted": k == 5}))
        feed.apply_feed(spark.readStream.schema("id string, seq long, deleted boolean").json(str(tmp_path / "in")), state, check, "id", "seq").awaitTermination(120)
    left = sorted(p.name for p in (tmp_path / "state").iterdir() if p.name.startswith("v="))
    assert left == ["v=1", "v=2", "v=3", "v=4", "v=5", "v=6"]
    schema = spark.read.json(str(tmp_path / "in")).select("id", "seq", "deleted").schema
    assert sorted((r.id, r.seq, r.deleted) for r in feed.read_state(spark, state, schema, "id", "seq").collect()) == [("r0", 6, False), ("r1", 4, False), ("r2", 5, True)]


def test_hub_names_survive(spark):
    x = spark.range(1).select(records.decode_id(records.encode_id(F.lit("my pc-App"), F.lit("u\x01v"))).alias("x")).first().x
    assert (x.collection, x.id) == ("my pc-App", "u\x01v")


def test_scopes_drop_their_tables(spark):
    import os

    from accord.sources.shared import scratch, written

    where = lambda df: {f.rpartition("/")[0].removeprefix("file://").removeprefix("file:") for f in df.inputFiles()}
    outside = written(spark.range(3))
    with scratch(spark) as outer:
        first = written(spark.range(4))
        with scratch(spark) as inner:
            second = written(spark.range(5))
            held = inner(second.where("id > 1"))
            gone = where(second)
        assert held.count() == 3 and not any(map(os.path.exists, gone)) and all(map(os.path.exists, where(held)))
        last, dropped = outer(held.unionByName(first)), where(held) | where(first)
    assert last.count() == 7 and not any(map(os.path.exists, dropped)) and outside.count() == 3
    with pytest.raises(RuntimeError, match="stop"), scratch(spark):
        lost = where(written(spark.range(2)))
        raise RuntimeError("stop")
    assert not any(map(os.path.exists, lost))
