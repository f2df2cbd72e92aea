"""Splitting series, flattening JSON, joint pseudonyms, on hand-written records."""

import json

import pytest
from pyspark.sql import functions as F

from accord.functions import vendor
from accord.operators import series

AT = "2026-06-01T09:00:00Z"


def master(rule="RRULE:FREQ=WEEKLY;BYDAY=MO", **fields):
    return json.dumps({"_canon": {"domain": "todo", "v": 1}, "uid": "w", "summary": "Weekly", "recurrence": [rule], "start": {"dateTime": "2026-01-05T09:00:00Z", "tz": "UTC", "floating": False}, **fields})


def exception(time, **fields):
    return json.dumps({"uid": "w", "recurrenceId": {"dateTime": time}, **fields})


def cut(spark, data, exceptions=(), at=AT):
    masters = spark.createDataFrame([("w", data)], "uid string, data string")
    splits = spark.createDataFrame([("w", at)], "uid string, at string").withColumn("at", F.to_timestamp("at"))
    rows = series.split_series(masters, splits, spark.createDataFrame([("w", e) for e in exceptions], "uid string, data string")).collect()
    parts = {r.part: json.loads(r.data) for r in rows if r.part in ("old", "new")}
    return parts, [json.loads(r.data) for r in rows if r.part == "exception"], [r.error for r in rows if r.part == "error"]


@pytest.mark.parametrize(("rule", "old"), [
    ("RRULE:FREQ=WEEKLY;BYDAY=MO", "RRULE:FREQ=WEEKLY;BYDAY=MO;UNTIL=20260601T085959Z"),
    ("RRULE:FREQ=DAILY;UNTIL=20260801T000000Z", "RRULE:FREQ=DAILY;UNTIL=20260601T085959Z"),
    ("RRULE:FREQ=DAILY;UNTIL=20260501T000000Z", "RRULE:FREQ=DAILY;UNTIL=20260501T000000Z"),
    ("RRULE:FREQ=DAILY;UNTIL=20990101;INTERVAL=2", "RRULE:FREQ=DAILY;UNTIL=20260531;INTERVAL=2"),
    ("RRULE:FREQ=DAILY;UNTIL=20260301", "RRULE:FREQ=DAILY;UNTIL=20260301"),
])
def test_rules_are_tightened_in_place(spark, rule, old):
    parts, _, errors = cut(spark, master(rule, recurrence=[rule, "EXDATE:20260301T090000Z"]))
    assert parts["old"]["recurrence"] == [old, "EXDATE:20260301T090000Z"] and parts["old"]["uid"] == "w" and not errors
    new = parts["new"]
    assert new["recurrence"] == [rule] and new["uid"] == "w-split-20260601T090000Z" and new["seriesSplitOf"] == "w"
    assert new["start"] == {"dateTime": AT, "tz": "UTC", "floating": False} and "due" not in new and new["summary"] == "Weekly"


def test_all_day_series(spark):
    parts, _, _ = cut(spark, master(start={"date": "2026-01-05", "allDay": True}, due={"date": "2026-01-06"}, recurrenceRange="x"))
    assert parts["old"]["recurrence"] == ["RRULE:FREQ=WEEKLY;BYDAY=MO;UNTIL=20260531"]
    assert parts["new"]["start"] == {"date": "2026-06-01", "allDay": True} and parts["new"]["due"] == {"date": "2026-06-01"} and "recurrenceRange" not in parts["new"]


def test_exceptions_at_or_after_the_instant_are_rebased(spark):
    given = [exception("2026-05-25T09:00:00Z"), exception(AT, x="\u0001\t"), exception("2026-06-08T11:00:00+02:00"), exception("never"), json.dumps({"uid": "w"})]
    _, kept, _ = cut(spark, master(), given)
    assert sorted((e["uid"], e.get("recurrenceId", {}).get("dateTime")) for e in kept if "recurrenceId" in e) == [("w", "2026-05-25T09:00:00Z"), ("w", "never"), ("w-split-20260601T090000Z", AT), ("w-split-20260601T090000Z", "2026-06-08T11:00:00+02:00")]
    assert {"uid": "w"} in kept and "\u0001\t" in [e.get("x") for e in kept]


@pytest.mark.parametrize(("data", "at", "error"), [
    (master("RRULE:FREQ=DAILY;COUNT=10"), AT, "count-bounded"), (master("EXDATE:20260101"), AT, "no rule"), (master(recurrenceId={"dateTime": AT}), AT, "an exception, no master"),
    (master(), None, "no instant"), (json.dumps({"recurrence": ["RRULE:FREQ=DAILY"]}), AT, "no uid"), ("no json", AT, "no uid"),
])
def test_what_cannot_be_cut(spark, data, at, error):
    parts, kept, errors = cut(spark, data, [exception(AT)], at)
    assert not parts and errors == [error] and [e["uid"] for e in kept] == ["w"]


def test_second_split_and_unknown_uid(spark):
    masters = spark.createDataFrame([("w", master())], "uid string, data string")
    splits = spark.sql("SELECT * FROM VALUES ('w', timestamp '2026-06-01'), ('w', timestamp '2026-06-01'), ('w', timestamp '2026-07-01'), ('v', timestamp '2026-06-01') AS t(uid, at)")
    rows = series.split_series(masters, splits, masters.limit(0)).collect()
    assert sorted((r.part, r.error or "") for r in rows) == [("error", "another split"), ("error", "no master"), ("new", ""), ("old", "")]


def test_flatten_at_any_depth(spark):
    deep = value = {}
    for k in range(12):
        value["k"] = [{"leaf": k}] if k % 3 == 2 else {"leaf": k}
        value = value["k"][0] if k % 3 == 2 else value["k"]
    rows = [(1, json.dumps(deep)), (2, '{"a.b":[],"c":{},"d":null,"e":[1,[2,"x"]]}'), (3, "7"), (4, "broken"), (5, None)]
    got = {(r.id, r.path): r.value for r in vendor.flatten_json(spark.createDataFrame(rows, "id int, data string"), "id", "data").collect()}

    def walk(v, path):
        if isinstance(v, dict) and v:
            return {p: x for k, w in v.items() for p, x in walk(w, f"{path}.{k}").items()}
        if isinstance(v, list) and v:
            return {p: x for k, w in enumerate(v) for p, x in walk(w, f"{path}[{k}]").items()}
        return {path: json.dumps(v, separators=(",", ":"))}

    assert got == {(i, p): x for i, text in rows[:3] for p, x in walk(json.loads(text), "$").items()}
    assert max(path.count(".") for _, path in got) == 13


def test_one_name_everywhere(spark):
    a = spark.createDataFrame([(1, "a@x", "b@x"), (2, "b@x", None), (3, "c@x", "a@x")], "k int, organizer string, attendee string")
    b = spark.createDataFrame([(9, "d@x"), (10, "b@x")], "n int, mail string")
    got = [tuple(r) for r in vendor.pseudonymise(a, "k", {"organizer": "p", "attendee": "p"}).orderBy("k").collect()]
    assert got == [(1, "p1", "p2"), (2, "p2", None), (3, "p3", "p1")]
    names = vendor.pseudonym_dictionary([(a, "k", {"organizer": "p", "attendee": "p"}), (b, "n", {"mail": "p"})])
    assert {r.value: r.name for r in names.collect()} == {"a@x": "p1", "b@x": "p2", "c@x": "p3", "d@x": "p4"}
    there = vendor.pseudonymise(b, "n", {"mail": "p"}, names, {"mail": "{}@example.com"}).orderBy("n").collect()
    assert [r.mail for r in there] == ["p4@example.com", "p2@example.com"]
