"""Recurrence lines and vendor patterns on hand-written rules."""

import json

import pytest
from pyspark.sql import functions as F

from accord.functions import recurrence, text

NO_END = {"type": "noEnd", "startDate": "2026-01-01"}


def pattern(type_, range_=NO_END, **fields):
    return {"pattern": {"type": type_, "interval": 1, **fields}, "range": range_}


TO_LINES = [
    (pattern("daily", interval=2), "FREQ=DAILY;INTERVAL=2"),
    (pattern("weekly", daysOfWeek=["thursday"], firstDayOfWeek="monday", index="first"), "FREQ=WEEKLY;INTERVAL=1;BYDAY=TH;WKST=MO"),
    (pattern("weekly", interval=2, daysOfWeek=["monday", "wednesday", "friday", "monday", "holiday"]), "FREQ=WEEKLY;INTERVAL=2;BYDAY=MO,WE,FR"),
    (pattern("absoluteMonthly", {"type": "numbered", "startDate": "2026-01-15", "numberOfOccurrences": 6, "endDate": "0001-01-01"}, interval=3, dayOfMonth=15), "FREQ=MONTHLY;INTERVAL=3;BYMONTHDAY=15;COUNT=6"),
    (pattern("absoluteMonthly", dayOfMonth=7, index="last"), "FREQ=MONTHLY;INTERVAL=1;BYMONTHDAY=7"),
    (pattern("relativeMonthly", daysOfWeek=["thursday"], index="fourth"), "FREQ=MONTHLY;INTERVAL=1;BYDAY=TH;BYSETPOS=4"),
    (pattern("absoluteYearly", month=8, dayOfMonth=23), "FREQ=YEARLY;INTERVAL=1;BYMONTH=8;BYMONTHDAY=23"),
    (pattern("absoluteYearly", {"type": "noEnd", "startDate": "2026-08-23"}, month=0, dayOfMonth=0, interval=0), "FREQ=YEARLY;INTERVAL=1;BYMONTH=8;BYMONTHDAY=23"),
    (pattern("relativeYearly", month=9, daysOfWeek=["monday"], index="last"), "FREQ=YEARLY;INTERVAL=1;BYMONTH=9;BYDAY=MO;BYSETPOS=-1"),
    (pattern("daily", {"type": "endDate", "startDate": "2026-01-01", "endDate": "2026-12-31", "numberOfOccurrences": 3}), "FREQ=DAILY;INTERVAL=1;UNTIL=20261231T235959Z"),
    (pattern("moonly"), None), ({}, None), ({"range": NO_END}, None),
]


def test_patterns_become_lines(spark):
    rows = spark.createDataFrame([(k, json.dumps(p)) for k, (p, _) in enumerate(TO_LINES)] + [(98, "no json"), (99, None)], "k int, p string")
    got = {r.k: r.x for r in rows.select("k", recurrence.pattern_to_lines(F.col("p")).alias("x")).collect()}
    for k, (_, want) in enumerate(TO_LINES):
        assert got[k].lines == ([f"RRULE:{want}"] if want else []), TO_LINES[k]
    assert got[98].lines == got[99].lines == []


def test_cancelled_occurrences(spark):
    times = F.array(F.lit("2026-08-27T07:00:00Z"), F.lit("2026-09-10T09:00:00+02:00"), F.lit("OE9AMBase64Blob=="), F.lit("2026"))
    x = spark.range(1).select(recurrence.pattern_to_lines(F.lit(json.dumps(pattern("daily"))), times).alias("x")).first().x
    assert x.lines[1] == "EXDATE:20260827T070000Z,20260910T070000Z" and x.unparsed == ["OE9AMBase64Blob==", "2026"]


CARRIED = [
    "RRULE:FREQ=HOURLY;INTERVAL=6", "RRULE:FREQ=MINUTELY;INTERVAL=30", "RRULE:FREQ=SECONDLY;INTERVAL=15", "RRULE:FREQ=YEARLY;BYWEEKNO=20;BYDAY=MO", "RRULE:FREQ=YEARLY;BYYEARDAY=140",
    "RRULE:FREQ=MONTHLY;BYDAY=FR;BYMONTHDAY=13", "RRULE:FREQ=MONTHLY;BYMONTHDAY=1,15", "RRULE:FREQ=YEARLY;BYMONTH=3,9;BYMONTHDAY=5", "RRULE:FREQ=MONTHLY;BYDAY=2MO",
    "RRULE:FREQ=MONTHLY;INTERVAL=1;BYDAY=MO;WKST=SU", "RRULE:FREQ=MONTHLY;BYDAY=MO", "RRULE:FREQ=MONTHLY;BYDAY=MO,TU;BYSETPOS=1,2", "RRULE:INTERVAL=2",
]
#: lines, start, pattern, range, carried, cancelled
TO_PATTERN = [
    (["RRULE:FREQ=DAILY;COUNT=10"], "2026-06-01T13:00:00Z", {"interval": 1, "type": "daily"}, {"numberOfOccurrences": 10, "startDate": "2026-06-01", "type": "numbered"}, [], []),
    (["RRULE:FREQ=WEEKLY;INTERVAL=2;BYDAY=TU,TH;WKST=SU"], "", {"daysOfWeek": ["tuesday", "thursday"], "firstDayOfWeek": "sunday", "interval": 2, "type": "weekly"}, {"startDate": "1970-01-01", "type": "noEnd"}, [], []),
    (["RRULE:FREQ=DAILY;UNTIL=20261231T235959Z"], "2026-06-01", {"interval": 1, "type": "daily"}, {"endDate": "2026-12-31", "startDate": "2026-06-01", "type": "endDate"}, [], []),
    (["RRULE:FREQ=DAILY;UNTIL=soon;COUNT=3"], "2026-06-01", {"interval": 1, "type": "daily"}, {"startDate": "2026-06-01", "type": "noEnd"}, [], []),
    (["RRULE:FREQ=MONTHLY;BYDAY=TH;BYSETPOS=-1"], "2026-01-01", {"daysOfWeek": ["thursday"], "index": "last", "interval": 1, "type": "relativeMonthly"}, NO_END, [], []),
    (["RRULE:FREQ=MONTHLY;BYDAY=TH;BYSETPOS=7"], "2026-01-01", {"daysOfWeek": ["thursday"], "interval": 1, "type": "relativeMonthly"}, NO_END, [], []),
    (["RRULE:FREQ=MONTHLY"], "2026-01-31T09:00:00Z", {"dayOfMonth": 31, "interval": 1, "type": "absoluteMonthly"}, {"startDate": "2026-01-31", "type": "noEnd"}, [], []),
    (["RRULE:FREQ=YEARLY;BYDAY=MO;BYSETPOS=2"], "2026-05-31", {"daysOfWeek": ["monday"], "index": "second", "interval": 1, "month": 5, "type": "relativeYearly"}, {"startDate": "2026-05-31", "type": "noEnd"}, [], []),
    (["rrule:FREQ=YEARLY;FREQ=DAILY;COUNT=2;count=4"], "2026-01-01", {"interval": 1, "type": "daily"}, {"numberOfOccurrences": 4, "startDate": "2026-01-01", "type": "numbered"}, [], []),
    (["RRULE:FREQ=MONTHLY;BYDAY=MO"], "2026-01-01", {"daysOfWeek": ["monday"], "index": "first", "interval": 1, "type": "relativeMonthly"}, NO_END, ["RRULE:FREQ=MONTHLY;BYDAY=MO"], []),
    (["RRULE:FREQ=YEARLY;BYMONTH=3,9;BYMONTHDAY=5"], "2026-01-01", {"dayOfMonth": 5, "interval": 1, "month": 3, "type": "absoluteYearly"}, NO_END, ["RRULE:FREQ=YEARLY;BYMONTH=3,9;BYMONTHDAY=5"], []),
    (["RRULE:FREQ=DAILY", "RRULE:FREQ=WEEKLY;BYDAY=MO", "EXRULE:FREQ=WEEKLY", "RDATE:20260704T090000Z", "EXDATE:20260101T090000Z,20260102", "EXDATE;VALUE=DATE:"], "2026-01-01", {"interval": 1, "type": "daily"}, NO_END,
     ["RRULE:FREQ=DAILY", "RRULE:FREQ=WEEKLY;BYDAY=MO", "EXRULE:FREQ=WEEKLY", "RDATE:20260704T090000Z"], ["2026-01-01T09:00:00Z", "20260102"]),
    (["EXDATE:20260102", "RDATE:20260704"], "2026-01-01", None, None, ["RDATE:20260704"], ["20260102"]),
    ([], None, None, None, [], []), (None, None, None, None, [], []),
]


def test_lines_become_patterns(spark):
    rows = spark.createDataFrame([(k, x[0], x[1]) for k, x in enumerate(TO_PATTERN)], "k int, lines array<string>, start string")
    for r in rows.select("k", recurrence.lines_to_pattern(F.col("lines"), F.col("start")).alias("x")).collect():
        _, _, want, range_, carried, cancelled = TO_PATTERN[r.k]
        assert r.x.pattern == (json.dumps({"pattern": want, "range": dict(sorted(range_.items()))}, separators=(",", ":")) if want else None)
        assert (r.x.carried, r.x.cancelled) == (carried, cancelled)


def test_what_is_reduced_is_carried(spark):
    rows = spark.createDataFrame([(c,) for c in CARRIED], "line string")
    assert all(r.x.carried == [r.line] and r.x.pattern for r in rows.select("line", recurrence.lines_to_pattern(F.array("line"), F.lit("2026-01-01T09:00:00Z")).alias("x")).collect())


@pytest.mark.parametrize("given", [
    pattern("daily", interval=3), pattern("weekly", interval=2, daysOfWeek=["monday", "tuesday"], firstDayOfWeek="monday"), pattern("absoluteMonthly", {"type": "numbered", "startDate": "2026-01-31", "numberOfOccurrences": 4}, dayOfMonth=31),
    pattern("relativeMonthly", daysOfWeek=["friday"], index="first"), pattern("absoluteYearly", {"type": "noEnd", "startDate": "2026-12-24"}, month=12, dayOfMonth=24), pattern("relativeYearly", {"type": "noEnd", "startDate": "2026-11-01"}, month=11, daysOfWeek=["thursday"], index="fourth"),
])
def test_there_and_back(spark, given):
    start = given["range"]["startDate"]
    back = spark.range(1).select(recurrence.lines_to_pattern(recurrence.pattern_to_lines(F.lit(json.dumps(given)))["lines"], F.lit(start)).alias("x")).first().x
    assert back.carried == [] and json.loads(back.pattern) == given


def test_repeated_parts_keep_the_last(spark):
    got = spark.range(1).select(text.rrule_parts(F.lit("RRULE:FREQ=DAILY;freq=WEEKLY;COUNT=1;COUNT=2;;X")).alias("p")).first().p
    assert got == {"FREQ": "WEEKLY", "COUNT": "2"}
