"""Calendar texts as rows and property maps, in built-in expressions; differences of incidences and exceptions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from accord.functions.text import rrule_parts, sha256_hex

#: Component kinds that hold properties, properties of several values, those that no diff compares.
COMPONENTS = ("VEVENT", "VTODO", "VJOURNAL")
LISTED = ("EXDATE", "RDATE", "ATTENDEE")
VOLATILE = ("DTSTAMP", "LAST-MODIFIED", "SEQUENCE", "CREATED")
#: Categories of properties, and their places in a sorted diff (others 99).
CATEGORIES = {
    "essential": ("SUMMARY", "DTSTART", "DTEND", "DUE"), "datetime": ("RRULE", "RDATE", "EXDATE", "DURATION", "RECURRENCE-ID"),
    "descriptive": ("DESCRIPTION", "LOCATION", "URL", "CATEGORIES", "COMMENT", "GEO"), "status": ("STATUS", "PRIORITY", "PERCENT-COMPLETE", "COMPLETED", "CLASS"),
    "organizational": ("ORGANIZER", "ATTENDEE", "RELATED-TO", "CONTACT"),
}
PRIORITIES = {
    "SUMMARY": 0, "DTSTART": 1, "DTEND": 2, "DUE": 3, "LOCATION": 10, "DESCRIPTION": 11, "CATEGORIES": 12, "RRULE": 20, "EXDATE": 21, "STATUS": 30, "PRIORITY": 31, "PERCENT-COMPLETE": 32,
    "COMPLETED": 33, "ORGANIZER": 40, "ATTENDEE": 41, "RELATED-TO": 42, "URL": 50, "COMMENT": 51, "UID": 100, "DTSTAMP": 101, "CREATED": 102, "LAST-MODIFIED": 103, "SEQUENCE": 104,
}
#: Properties in which an exception differs from its master anyway, and those that must agree for it to be taken back.
INHERENT = ("UID", "RECURRENCE-ID", "RELATED-TO", "EXDATE", "RRULE", "RDATE", "DTSTART", "DTEND", "DUE", "DTSTAMP", "LAST-MODIFIED", "SEQUENCE", "CREATED")
COMPARED = ("SUMMARY", "DESCRIPTION", "LOCATION", "CATEGORIES", "URL", "STATUS", "PRIORITY", "CLASS", "GEO", "TRANSP", "PERCENT-COMPLETE")


def blocks(text: Column) -> Column:
    """array<string>: the bodies of all components that hold properties, unfolded, nested components included."""
    unfolded = F.regexp_replace(F.regexp_replace(text, r"\r?\n[ \t]", ""), r"\r\n", "\n")
    return F.regexp_extract_all(unfolded, F.lit(rf"(?s)(?<=^|\n)BEGIN:({'|'.join(COMPONENTS)})[^\n]*\n(.*?)(?<=\n)END:\1"), 2)


def _lines(bodies: Column) -> Column:
    """array<struct<name, value>> of property lines; lines that begin or end nested components are none, their properties are."""
    lines = F.filter(F.flatten(F.transform(bodies, lambda b: F.split(b, "\n"))), lambda x: (F.locate(":", x) > 1) & ~x.rlike("^(BEGIN|END):"))

    def parts(line: Column) -> Column:
        head, value = F.substring_index(line, ":", 1), F.substr(line, F.locate(":", line) + 1)
        zone = F.when(F.contains(head, F.lit(";TZID=")), F.regexp_extract(head, r";TZID=([^;:]+)", 1)).otherwise("")
        return F.struct(F.upper(F.substring_index(head, ";", 1)).alias("name"), F.when(zone != "", F.concat(F.lit("TZID="), zone, F.lit(":"), value)).otherwise(value).alias("value"))

    return F.transform(lines, parts)


def ical_map(text: Column) -> Column:
    """map<property, value> of a calendar text: listed properties joined by commas in order, of others the last."""

    def fold(lines: Column) -> Column:
        def value(name: Column) -> Column:
            own = F.transform(F.filter(lines, lambda x: x["name"] == name), lambda x: x["value"])
            return F.struct(name.alias("name"), F.when(name.isin(*LISTED), F.array_join(own, ",")).otherwise(F.element_at(own, -1)).alias("value"))

        return F.map_from_entries(F.transform(F.array_distinct(F.transform(lines, lambda x: x["name"])), value))

    return F.get(F.transform(F.array(_lines(blocks(text))), fold), F.lit(0))


def ical_properties(records: DataFrame) -> DataFrame:
    """uid, property, value: a row for each property of calendar records (uid, data)."""
    return records.select("uid", F.explode(ical_map(F.col("data"))).alias("property", "value"))


def recurrence_lines(text: Column, kind: str, recurrence_id: Column | None = None) -> Column:
    """array<string>: RRULE, RDATE, EXDATE and EXRULE lines of one component of the kind.

    The one with that recurrence id, else the master (without one), else the first; alarms and time zones do not count.
    """
    plain = F.regexp_replace(F.regexp_replace(F.regexp_replace(text, r"\r?\n[ \t]", ""), r"\r\n", "\n"), r"(?s)BEGIN:(VALARM|VTIMEZONE).*?END:\1\n?", "")
    bodies = F.regexp_extract_all(plain, F.lit(rf"(?s)(?<=^|\n)BEGIN:{kind}\n(.*?)(?<=\n)END:{kind}"), 1)
    own = lambda b: F.regexp_extract(b, r"(?m)^RECURRENCE-ID[^:\n]*:(.*)$", 1)
    master = F.get(F.filter(bodies, lambda b: own(b) == ""), F.lit(0))
    chosen = F.coalesce(master, F.get(bodies, F.lit(0))) if recurrence_id is None else F.get(F.filter(bodies, lambda b: own(b) == recurrence_id), F.lit(0))
    return F.filter(F.split(F.coalesce(chosen, F.lit("")), "\n"), lambda x: x.rlike("^(RRULE|RDATE|EXDATE|EXRULE)[;:]"))


def semantic_hash(fields: dict[str, Column]) -> Column:
    """SHA-256 over an incidence's meaning: parts 'KEY:value' sorted and joined by line feeds.

    fields: columns by key, texts or arrays of texts (sorted here). UID, TYPE, SUMMARY, DESCRIPTION, LOCATION, STATUS,
    SECRECY, PRIORITY and CATEGORIES always take part, empty when missing; others only where they are set.
    """
    always = ("UID", "TYPE", "SUMMARY", "DESCRIPTION", "LOCATION", "STATUS", "SECRECY", "PRIORITY", "CATEGORIES")
    listed = {"CATEGORIES": ",", "EXDATE": ",", "EXDATETIME": ",", "ALARMS": ";", "ATTENDEES": ";"}
    parts = []
    for key, given in (dict.fromkeys(always) | fields).items():
        value = F.lit("") if given is None else F.array_join(F.array_sort(given), listed[key]) if key in listed else given.cast("string")
        parts.append(F.concat(F.lit(f"{key}:"), F.coalesce(value, F.lit("")) if key in always else F.nullif(value, F.lit(""))))
    return sha256_hex(F.array_join(F.array_sort(F.array_compact(F.array(*parts))), "\n"))


def property_category(name: Column) -> Column:
    out = F.lit("other")
    for category, names in CATEGORIES.items():
        out = F.when(F.upper(name).isin(*names), category).otherwise(out)
    return out


def property_priority(name: Column) -> Column:
    return F.coalesce(F.try_element_at(F.create_map(*(F.lit(x) for pair in PRIORITIES.items() for x in pair)), F.upper(name)), F.lit(99))


def incidence_diff(a: DataFrame, b: DataFrame, baseline: DataFrame | None = None, everything: bool = False) -> DataFrame:
    """uid, property, a, b, state, resolution, category, priority of property rows (uid, property, value), ordered by priority.

    States: identical (only with everything=True), only_in_a, only_in_b, a_matches_baseline (use b),
    b_matches_baseline (use a), both_changed, both_different without a baseline. Volatile properties are left out.
    """
    side = lambda df, name: df.where(~F.upper("property").isin(*VOLATILE)).select("uid", "property", F.col("value").alias(name))
    rows = side(a, "a").join(side(b, "b"), ["uid", "property"], "full")
    rows = rows.withColumn("base", F.lit(None).cast("string")) if baseline is None else rows.join(side(baseline, "base"), ["uid", "property"], "left")
    x, y, base = F.col("a"), F.col("b"), F.col("base")
    state = F.when(x == y, "identical").when(y.isNull(), "only_in_a").when(x.isNull(), "only_in_b").when(base.isNull(), "both_different").when(x == base, "a_matches_baseline").when(y == base, "b_matches_baseline").otherwise("both_changed")
    resolution = F.when(F.col("state") == "a_matches_baseline", "use_b").when(F.col("state") == "b_matches_baseline", "use_a")
    out = rows.withColumn("state", state).select("uid", "property", "a", "b", "state", resolution.alias("resolution"), property_category(F.col("property")).alias("category"), property_priority(F.col("property")).alias("priority"))
    return (out if everything else out.where("state <> 'identical'")).orderBy("uid", "priority", "property")


def apply_resolutions(base: DataFrame, diffs: DataFrame) -> DataFrame:
    """uid, property, value: base rows with each diff's choice (resolution use_a, use_b, remove) put in; others stay."""
    chosen = diffs.where("resolution is not null").select("uid", "property", F.col("a").alias("__a"), F.col("b").alias("__b"), "resolution")
    met = base.select("uid", "property", "value").join(chosen, ["uid", "property"], "full")
    value = F.when(F.col("resolution") == "use_a", F.col("__a")).when(F.col("resolution") == "use_b", F.col("__b")).when(F.col("resolution").isNull(), F.col("value"))
    return met.select("uid", "property", value.alias("value")).where("value is not null")


def exception_changes(masters: DataFrame, exceptions: DataFrame) -> DataFrame:
    """uid, recurrence_id, property, master, exception: what an exception changes, without what differs anyway.

    masters: uid, property, value; exceptions: uid, recurrence_id, property, value.
    """
    keys = exceptions.select("uid", "recurrence_id").distinct()
    m = masters.where(~F.col("property").isin(*INHERENT)).join(keys, "uid").select("uid", "recurrence_id", "property", F.col("value").alias("master"))
    known = masters.select("uid").distinct()
    e = exceptions.where(~F.col("property").isin(*INHERENT)).join(known, "uid", "left_semi").select("uid", "recurrence_id", "property", F.col("value").alias("exception"))
    return m.join(e, ["uid", "recurrence_id", "property"], "full").where("not (master <=> exception)")


def reabsorbable(masters: DataFrame, exceptions: DataFrame) -> DataFrame:
    """uid, recurrence_id, same: whether an exception equals its master's occurrence and can be taken back.

    masters: uid, start, end, held; exceptions: uid, recurrence_id, start, end, occurrence, all_day, held; held is the
    property map. The day is the occurrence's, the time of day the master's unless all day, the length the
    master's, and the compared properties agree (missing ones are empty).
    """
    m = masters.select("uid", F.col("start").alias("m_start"), F.col("end").alias("m_end"), F.col("held").alias("m_held"))
    met = exceptions.join(m, "uid")
    seconds = lambda a, b: F.unix_timestamp(b) - F.unix_timestamp(a)
    day = F.to_date("start") == F.to_date("occurrence")
    time = F.col("all_day") | (F.date_format("start", "HH:mm:ss") == F.date_format("m_start", "HH:mm:ss"))
    length = seconds(F.col("start"), F.col("end")).eqNullSafe(seconds(F.col("m_start"), F.col("m_end")))
    value = lambda held, p: F.coalesce(F.try_element_at(held, F.lit(p)), F.lit(""))
    same = day & time & length
    for p in COMPARED:
        same = same & (value(F.col("held"), p) == value(F.col("m_held"), p))
    return met.select("uid", "recurrence_id", F.coalesce(same, F.lit(False)).alias("same"))


def format_property(name: str, value: Column) -> Column:
    """A property's value for display: status in words, priority with its level, a rule in short, dates with dashes."""
    if name == "STATUS":
        return F.initcap(F.replace(F.lower(value), F.lit("-"), F.lit(" ")))
    if name == "PRIORITY":
        n = F.try_to_number(value, F.lit("9")).cast("int")
        return F.when(n == 0, "None").when(n < 5, F.concat(value, F.lit(" (High)"))).when(n == 5, "5 (Medium)").when(n > 5, F.concat(value, F.lit(" (Low)"))).otherwise(value)
    if name == "RRULE":
        part = rrule_parts(value)
        every = F.coalesce(F.try_element_at(part, F.lit("INTERVAL")), F.lit("1"))
        return F.when(every == "1", F.initcap(F.element_at(part, F.lit("FREQ")))).otherwise(F.concat(F.initcap(F.element_at(part, F.lit("FREQ"))), F.lit(", every "), every))
    plain = F.regexp_replace(value, "^TZID=[^:]*:", "")
    time = F.try_to_timestamp(F.regexp_replace(plain, "Z$", ""), F.lit("yyyyMMdd'T'HHmmss"))
    return F.coalesce(F.date_format(time, "yyyy-MM-dd HH:mm"), F.date_format(F.try_to_timestamp(plain, F.lit("yyyyMMdd")), "yyyy-MM-dd"), value)
