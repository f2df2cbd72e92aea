"""Recurrence rules (lines of RRULE, EXDATE and the like) and a vendor's pattern and range objects, each from the other."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from accord.functions.text import once, rrule_parts

#: A vendor's names of days and of places within a month, and the codes of rules.
DAYS = {"monday": "MO", "tuesday": "TU", "wednesday": "WE", "thursday": "TH", "friday": "FR", "saturday": "SA", "sunday": "SU"}
PLACES = {"first": "1", "second": "2", "third": "3", "fourth": "4", "last": "-1"}
TYPES = {"daily": "DAILY", "weekly": "WEEKLY", "absoluteMonthly": "MONTHLY", "relativeMonthly": "MONTHLY", "absoluteYearly": "YEARLY", "relativeYearly": "YEARLY"}
#: The end date that stands for none, and the start of a series whose start is not known.
NO_END, NO_START = "0001-01-01", "1970-01-01"

_SHAPE = """struct<pattern: struct<dayOfMonth: int, daysOfWeek: array<string>, firstDayOfWeek: string, index: string, interval: int, month: int, type: string>,
  range: struct<endDate: string, numberOfOccurrences: int, startDate: string, type: string>>"""


def _known(names: dict[str, str], value: Column) -> Column:
    return F.try_element_at(F.create_map(*(F.lit(x) for pair in names.items() for x in pair)), value)


def _day(text: Column, form: str) -> Column:
    return F.try_to_timestamp(text, F.lit(form)).cast("date")


def _iso_day(text: Column) -> Column:
    """The day of an ISO date or date-time text; null without a valid one."""
    return F.when(text.rlike(r"^\d{4}-\d{2}-\d{2}"), _day(F.substring(text, 1, 10), "yyyy-MM-dd"))


def _utc(time: Column, form: str) -> Column:
    return F.date_format(F.to_utc_timestamp(time, F.current_timezone()), form)


def _whole(text: Column) -> Column:
    return F.coalesce(text.try_cast("int"), F.lit(0))


def pattern_to_lines(json: Column, cancelled: Column | None = None) -> Column:
    """struct(lines, unparsed) of a vendor's {pattern, range} text and its cancelled occurrences (array of ISO times).

    Zero numbers count as absent, and a missing month or day of the month is the start's. The index counts in
    relative patterns alone. An end date wins over a count. Cancelled times become one EXDATE line in UTC;
    those that can't be read are unparsed. No pattern, or one of unknown type: no lines.
    """
    given = F.coalesce(cancelled, F.array().cast("array<string>")) if cancelled is not None else F.array().cast("array<string>")
    read = lambda x: F.when(x.rlike(r"^\d{4}-\d{2}-\d{2}"), F.try_to_timestamp(x))

    def lines(both: Column) -> Column:
        p, r = both["pattern"], both["range"]
        kind, start = p["type"], _iso_day(r["startDate"])
        above = lambda n, other=None: F.when(n > 0, n) if other is None else F.coalesce(F.when(n > 0, n), other)
        codes = F.array_distinct(F.array_compact(F.transform(F.coalesce(p["daysOfWeek"], F.array().cast("array<string>")), lambda d: _known(DAYS, d))))
        part = lambda name, value: F.concat(F.lit(f"{name}="), value.cast("string"))
        days = F.when(~kind.startswith("absolute") & (kind != "daily") & (F.size(codes) > 0), part("BYDAY", F.array_join(codes, ",")))
        week = F.when(kind == "weekly", part("WKST", _known(DAYS, p["firstDayOfWeek"])))
        month = F.when(kind.endswith("Yearly"), part("BYMONTH", above(p["month"], F.month(start))))
        dom = F.when(kind.startswith("absolute"), part("BYMONTHDAY", above(p["dayOfMonth"], F.dayofmonth(start))))
        place = F.when(kind.startswith("relative"), part("BYSETPOS", _known(PLACES, p["index"])))
        end = F.when(F.substring(r["endDate"], 1, 10) != NO_END, _iso_day(r["endDate"]))
        bound = F.coalesce(part("UNTIL", F.date_format(end, "yyyyMMdd'T235959Z'")), part("COUNT", above(r["numberOfOccurrences"])))
        rule = F.concat(F.lit("RRULE:"), F.concat_ws(";", part("FREQ", _known(TYPES, kind)), part("INTERVAL", F.greatest(F.coalesce(p["interval"], F.lit(1)), F.lit(1))), month, days, week, dom, place, bound))
        times = F.array_compact(F.transform(given, lambda x: _utc(read(x), "yyyyMMdd'T'HHmmss'Z'")))
        gone = F.when(F.size(times) > 0, F.concat(F.lit("EXDATE:"), F.array_join(times, ",")))
        return F.when(_known(TYPES, kind).isNotNull(), F.array_compact(F.array(rule, gone))).otherwise(F.array().cast("array<string>"))

    parsed = F.from_json(json, _SHAPE)
    found = F.coalesce(once(parsed, lines), F.array().cast("array<string>"))
    return F.struct(found.alias("lines"), F.when(F.size(found) > 0, F.filter(given, lambda x: read(x).isNull())).otherwise(F.array().cast("array<string>")).alias("unparsed"))


def lines_to_pattern(lines: Column, start: Column | None = None) -> Column:
    """struct(pattern, carried, cancelled): a vendor's {pattern, range} text of recurrence lines (array of text) and the series' start.

    The first RRULE makes the pattern; null without one. What the pattern can't hold is reduced to the nearest
    that it can: an hourly rule to a daily one, several months or days of the month to the first, weekdays of a
    month without a place to the first of them; then the first line is carried as it is. Carried too are
    further rules, with the first of them, and all other lines but EXDATE, whose times are cancelled
    (ISO in UTC, or as they are if they can't be read).
    """
    none = F.array().cast("array<string>")
    is_ = lambda x, name: F.upper(x).startswith(name)
    list_ = lambda parts, name: F.filter(F.split(F.coalesce(F.try_element_at(parts, F.lit(name)), F.lit("")), ","), lambda x: x != "")
    one = lambda value: F.coalesce(F.get(value, F.lit(0)), F.lit(""))

    def known(held: Column) -> Column:
        """Of struct(parts, day): the pattern's fields, the range's, and whether the rule was reduced."""
        parts, day = held["parts"], held["day"]
        at = lambda name: F.try_element_at(parts, F.lit(name))
        freq, days, months, doms, places = at("FREQ"), list_(parts, "BYDAY"), list_(parts, "BYMONTH"), list_(parts, "BYMONTHDAY"), list_(parts, "BYSETPOS")
        plain = F.coalesce(freq.isin(*set(TYPES.values())), F.lit(False))
        weekly = F.coalesce(freq == "WEEKLY", F.lit(False))
        some = lambda x: F.size(x) > 0
        reduced = ~plain | at("BYWEEKNO").isNotNull() | at("BYYEARDAY").isNotNull() | (F.size(places) > 1) | (F.size(doms) > 1) | (F.size(months) > 1)
        reduced = reduced | (~weekly & ((some(doms) & some(days)) | (some(days) & ~some(places)) | at("WKST").isNotNull()))
        relative = F.when(freq == "MONTHLY", ~some(doms) & some(days)).when(freq == "YEARLY", some(days) & (F.size(places) == 1)).otherwise(F.lit(False))
        kind = F.when(~plain | (freq == "DAILY"), "daily").when(weekly, "weekly").otherwise(F.concat(F.when(relative, "relative").otherwise("absolute"), F.initcap(freq)))
        first = lambda values: _whole(one(values))
        whole_year = some(months) & some(doms)
        dom = F.when(kind == "absoluteMonthly", F.when(some(doms), first(doms)).otherwise(F.dayofmonth(day))).when(kind == "absoluteYearly", F.when(whole_year, first(doms)).otherwise(F.dayofmonth(day)))
        month = F.when(kind == "absoluteYearly", F.when(whole_year, first(months)).otherwise(F.month(day))).when(kind == "relativeYearly", F.when(some(months), first(months)).otherwise(F.month(day)))
        names = {v: k for k, v in DAYS.items()}
        named = F.array_compact(F.transform(days, lambda d: _known(names, F.right(d, F.lit(2)))))
        place = _known({v: k for k, v in PLACES.items()}, one(places))
        index = F.when(relative, F.when((F.size(places) == 1) & (freq == "MONTHLY"), place).otherwise(F.coalesce(F.when(F.size(places) == 1, place), F.lit("first"))))
        interval = F.greatest(F.lit(1), _whole(at("INTERVAL")))
        pattern = F.struct(
            dom.alias("dayOfMonth"), F.when(relative | (weekly & some(named)), named).alias("daysOfWeek"), F.when(weekly, _known(names, at("WKST"))).alias("firstDayOfWeek"), index.alias("index"),
            interval.alias("interval"), month.alias("month"), kind.alias("type"),
        )
        until = F.when(F.length(at("UNTIL")) >= 8, _day(F.substring(at("UNTIL"), 1, 8), "yyyyMMdd"))
        bounded, count = F.coalesce(at("UNTIL"), F.lit("")) != "", _whole(at("COUNT"))
        ends = F.when(bounded, F.when(until.isNotNull(), "endDate").otherwise("noEnd")).when(count > 0, "numbered").otherwise("noEnd")
        range_ = F.struct(F.when(bounded, F.date_format(until, "yyyy-MM-dd")).alias("endDate"), F.when(ends == "numbered", count).alias("numberOfOccurrences"), held["start"].alias("startDate"), ends.alias("type"))
        return F.struct(F.to_json(F.struct(pattern.alias("pattern"), range_.alias("range"))).alias("pattern"), reduced.alias("reduced"))

    def split(all_: Column) -> Column:
        rules = F.filter(all_, lambda x: is_(x, "RRULE"))
        at = F.when(F.coalesce(start, F.lit("")) == "", NO_START).otherwise(start) if start is not None else F.lit(NO_START)
        at = F.when(F.length(at) >= 10, F.substring(at, 1, 10)).otherwise(at)
        held = F.struct(rrule_parts(F.get(rules, F.lit(0))).alias("parts"), _iso_day(at).alias("day"), at.alias("start"))
        first_at = F.array_position(F.transform(all_, lambda x: is_(x, "RRULE")), F.lit(True))
        others = F.filter(all_, lambda x, i: (i + 1 != first_at) & ~is_(x, "EXDATE"))
        times = F.flatten(F.transform(F.filter(all_, lambda x: is_(x, "EXDATE") & (F.locate(":", x) > 1)), lambda x: F.filter(F.split(F.substr(x, F.locate(":", x) + 1), ","), lambda v: v != "")))
        read = lambda v: F.when(v.rlike(r"^\d{8}T\d{6}Z$"), F.date_format(F.try_to_timestamp(F.rtrim(v, F.lit("Z")), F.lit("yyyyMMdd'T'HHmmss")), "yyyy-MM-dd'T'HH:mm:ss'Z'"))
        cancelled = F.transform(times, lambda v: F.coalesce(read(v), v))

        def out(k: Column) -> Column:
            ahead = F.when(F.coalesce(k["reduced"], F.lit(False)) | ((F.size(rules) > 1) & ~F.array_contains(others, all_[0])), F.slice(all_, 1, 1)).otherwise(none)
            return F.struct(k["pattern"].alias("pattern"), F.concat(ahead, others).alias("carried"), cancelled.alias("cancelled"))

        return once(F.when(F.size(rules) > 0, once(held, known)), out)

    return once(F.filter(F.coalesce(lines, none), lambda x: x.isNotNull()), split)
