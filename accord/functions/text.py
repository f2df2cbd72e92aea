"""Column functions on record texts: calendar lines, todo.txt, Markdown, carriers, colours, path buckets."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def sha256_hex(text: Column) -> Column:
    """SHA-256 in hex; the empty text gives the empty text."""
    return F.when(text == "", "").otherwise(F.sha2(text, 256))


def compose_identity(uid: Column, recurrence: Column) -> Column:
    """uid, or uid, \\x01 and the recurrence time in UTC ISO form."""
    return F.when(recurrence.isNull(), uid).otherwise(F.concat(uid, F.lit("\x01"), F.date_format(recurrence, "yyyy-MM-dd'T'HH:mm:ss'Z'")))


def decompose_identity(identity: Column) -> Column:
    """struct(uid, recurrence); text with a malformed time gives an empty uid."""
    parts = F.split(identity, "\x01", 2)
    time = F.try_to_timestamp(F.get(parts, F.lit(1)), F.lit("yyyy-MM-dd'T'HH:mm:ssX"))
    bad = (F.size(parts) == 2) & time.isNull()
    return F.struct(F.when(bad, "").otherwise(parts[0]).alias("uid"), time.alias("recurrence"))


def ical_literal(text: Column, name: str) -> Column:
    """The value of the first line of that property; null without one."""
    found = F.regexp_extract(text, rf"(?mi)^{name}(?:;[^:\r\n]*)?:([^\r\n]*)", 1)
    return F.when(found != "", found)


def ical_timestamp(text: Column) -> Column:
    """LAST-MODIFIED, else DTSTAMP, else CREATED, else null; never the present time."""
    time = lambda name: F.try_to_timestamp(F.regexp_replace(ical_literal(text, name), "Z$", ""), F.lit("yyyyMMdd'T'HHmmss"))
    return F.coalesce(time("LAST-MODIFIED"), time("DTSTAMP"), time("CREATED"))


def strip_line(text: Column, name: str) -> Column:
    """The text without that property's lines."""
    return F.regexp_replace(text, rf"(?mi)^{name}[;:][^\r\n]*\r?\n?", "")


def once(value: Column, body) -> Column:
    """body(value) with value computed once a row, however often body names it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def last_of_each(entries: Column) -> Column:
    """A map of array<struct<key, value>> in which the last entry of a repeated key counts."""
    last = F.filter(entries, lambda e, i: ~F.exists(F.slice(entries, i + 2, F.size(entries)), lambda x: x["key"] == e["key"]))
    repeats = F.size(F.array_distinct(F.transform(entries, lambda e: e["key"]))) < F.size(entries)
    return F.map_from_entries(F.when(repeats, last).otherwise(entries))


def rrule_parts(rule: Column) -> Column:
    """Map of a recurrence rule's parts, keys in upper case; of a repeated key the last counts, a part without '=' is none."""
    parts = F.filter(F.split(F.regexp_replace(rule, "(?i)^RRULE[^:]*:", ""), ";"), lambda x: F.locate("=", x) > 1)
    entry = lambda x: F.struct(F.upper(F.substring_index(x, "=", 1)).alias("key"), F.substr(x, F.locate("=", x) + 1).alias("value"))
    return once(F.transform(parts, entry), last_of_each)


def is_complex_recurrence(lines: Column) -> Column:
    """More than one rule, any BY part, or added or excluded dates."""
    starts = lambda p: F.filter(lines, lambda x: F.upper(x).startswith(p))
    by = F.exists(starts("RRULE"), lambda x: F.upper(x).rlike("[:;]BY[A-Z]+="))
    return (F.size(starts("RRULE")) > 1) | by | (F.size(starts("RDATE")) > 0) | (F.size(starts("EXDATE")) > 0)


def simplify_recurrence(lines: Column) -> Column:
    """One plain rule of the first one's frequency, interval and bound; minute and hour rules become daily ones; null without a rule."""
    rule = F.get(F.filter(lines, lambda x: F.upper(x).startswith("RRULE")), F.lit(0))
    part = lambda name: F.try_element_at(rrule_parts(rule), F.lit(name))
    kept = F.upper(part("FREQ")).isin("DAILY", "WEEKLY", "MONTHLY", "YEARLY")
    every = F.when(kept & (F.coalesce(part("INTERVAL"), F.lit("1")) != "1"), F.concat(F.lit("INTERVAL="), part("INTERVAL")))
    bound = F.when(part("COUNT").isNotNull(), F.concat(F.lit("COUNT="), part("COUNT"))).otherwise(F.concat(F.lit("UNTIL="), part("UNTIL")))
    freq = F.concat(F.lit("RRULE:FREQ="), F.when(kept, F.upper(part("FREQ"))).otherwise("DAILY"))
    return F.when(rule.isNotNull(), F.concat_ws(";", freq, every, bound))


def parse_todotxt(line: Column) -> Column:
    """struct(done, priority, due, categories, summary) of a todo.txt line; categories keep their + or @."""
    whole = F.trim(line)
    done = whole.startswith("x ")
    body = F.trim(F.regexp_replace(whole, "^x ", ""))
    rest = F.trim(F.regexp_replace(body, r"^\([A-Z]\)\s+", ""))
    due = F.regexp_extract(rest, r"\bdue:(\d{4}-\d{2}-\d{2})\b", 1)
    plain = F.regexp_replace(rest, r"^(.*?)\bdue:\d{4}-\d{2}-\d{2}\b", "$1")  # the first one alone
    text_or_null = lambda c: F.when(c != "", c)
    return F.struct(
        done.alias("done"), text_or_null(F.regexp_extract(body, r"^\(([A-Z])\)\s+", 1)).alias("priority"), text_or_null(due).alias("due"),
        F.regexp_extract_all(plain, F.lit(r"\s([+@]\S+)"), 1).alias("categories"), F.trim(F.regexp_replace(plain, r"\s[+@]\S+", "")).alias("summary"),
    )


def to_todotxt(done: Column, priority: Column, due: Column, categories: Column, summary: Column) -> Column:
    """A todo.txt line: summary, due date, then the first category alone, with + unless it has its own sign."""
    first = F.get(categories, F.lit(0))
    tag = F.when(first.rlike("^[+@]"), first).otherwise(F.concat(F.lit("+"), first))
    return F.concat_ws(" ", F.when(done, "x"), F.concat(F.lit("("), priority, F.lit(")")), summary, F.concat(F.lit("due:"), due), tag)


def parse_markdown(text: Column) -> Column:
    """struct(front, id, body); an unterminated fence belongs to the body; newlines at the end become one."""
    fence = r"(?s)\A---\n(.*?\n)?---\n?(.*)\z"
    fenced = text.rlike(fence)
    front = F.when(fenced, F.regexp_extract(text, fence, 1)).otherwise("")
    body = F.when(fenced, F.regexp_extract(text, fence, 2)).otherwise(text)
    own = F.regexp_extract(front, r"(?m)^id:[ \t]*(\S+)", 1)
    trimmed = F.regexp_replace(body, r"\n+\z", "")
    return F.struct(front.alias("front"), F.when(own != "", own).alias("id"), F.when(trimmed == "", "").otherwise(F.concat(trimmed, F.lit("\n"))).alias("body"))


def to_markdown(front: Column, id_: Column, body: Column) -> Column:
    """Front matter with its id line, then the body, ended by one line feed; without id and front matter, the body alone."""
    kept = F.regexp_replace(F.coalesce(front, F.lit("")), r"(?m)^id:.*\n?", "")
    head = F.concat(F.coalesce(F.concat(F.lit("id: "), id_, F.lit("\n")), F.lit("")), kept)
    trimmed = F.regexp_replace(body, r"\n+\z", "")
    text = F.when(trimmed == "", "").otherwise(F.concat(trimmed, F.lit("\n")))
    return F.when(head == "", text).otherwise(F.concat(F.lit("---\n"), head, F.lit("---\n"), text))


def carrier_key(name: Column, prefix: str) -> Column:
    """A camel-case property as a kebab-case key with a prefix."""
    return F.concat(F.lit(prefix), F.lower(F.regexp_replace(name, "([A-Z])", "-$1")))


def property_from_carrier(key: Column, prefix: str) -> Column:
    """The property of such a key; null for keys with another prefix."""
    words = F.split(F.substr(key, F.lit(len(prefix) + 1)), "-")
    name = F.concat(words[0], F.array_join(F.transform(F.slice(words, 2, F.greatest(F.size(words) - 1, F.lit(0))), F.initcap), ""))
    return F.when(key.startswith(prefix), name)


def css_to_argb(color: Column) -> Column:
    """#RRGGBB or #RRGGBBAA as #AARRGGBB, upper case; null for other text."""
    c = F.upper(color)
    alpha = F.when(F.length(c) == 9, F.substring(c, 8, 2)).otherwise("FF")
    return F.when(c.rlike("^#([0-9A-F]{6}|[0-9A-F]{8})$"), F.concat(F.lit("#"), alpha, F.substring(c, 2, 6)))


def argb_to_css(color: Column) -> Column:
    """#AARRGGBB as #RRGGBBAA, upper case; null for other text."""
    c = F.upper(color)
    return F.when(c.rlike("^#[0-9A-F]{8}$"), F.concat(F.lit("#"), F.substring(c, 4, 6), F.substring(c, 2, 2)))


def properties_hash(color: Column, description: Column) -> Column:
    """SHA-256 over the set properties of a collection, sorted: COLOR (#aarrggbb) and DESCRIPTION."""
    parts = F.array(F.concat(F.lit("COLOR:"), F.lower(color)), F.when(description != "", F.concat(F.lit("DESCRIPTION:"), description)))
    return F.sha2(F.array_join(F.array_sort(F.array_compact(parts)), "\n"), 256)


def calendar_id(name: Column) -> Column:
    """A name in lower case, spaces as hyphens, other characters than letters, digits, hyphens and underscores dropped; 'calendar' for nothing."""
    kept = F.regexp_replace(F.replace(F.lower(name), F.lit(" "), F.lit("-")), r"[^\p{L}\p{N}_-]", "")
    return F.when(kept == "", "calendar").otherwise(kept)


def slug(text: Column) -> Column:
    """Letters and digits in lower case; '-', '_' and ' ' as a hyphen each; other characters dropped; 'record' for nothing."""
    kept = F.regexp_replace(F.regexp_replace(F.lower(text), "[-_ ]", "-"), r"[^\p{L}\p{N}-]", "")
    return F.when(kept == "", "record").otherwise(kept)


def dav_slug(url: Column) -> Column:
    """The last path segment that isn't empty, decoded; empty for a URL without a path."""
    path = F.regexp_replace(F.regexp_replace(url, r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*", ""), r"[?#].*$", "")
    last = F.element_at(F.split(F.regexp_replace(path, "/+$", ""), "/"), -1)
    return F.try_url_decode(F.replace(last, F.lit("+"), F.lit("%2B")))


#: Factors of the path hash for a string's bytes and for a path's strings, and its number of buckets.
STRING_FACTOR, PATH_FACTOR, BUCKETS = 19, 199, 256


def path_bucket(path: Column) -> Column:
    """The log bucket of a path (array of strings): 'info' for that path alone, else a polynomial hash in two hex digits."""
    step = lambda factor: lambda h, x: F.pmod(h * factor + x, F.lit(BUCKETS))
    byte = lambda text: lambda i: F.conv(F.substr(F.hex(F.encode(text, "UTF-8")), i * 2 + 1, F.lit(2)), 16, 10).cast("int")
    signed = lambda x: F.when(x > 127, x - 256).otherwise(x)
    places = lambda text: F.when(F.octet_length(text) > 0, F.sequence(F.lit(0), F.octet_length(text) - 1)).otherwise(F.array().cast("array<int>"))
    of_text = lambda text: F.aggregate(F.transform(F.transform(places(text), byte(text)), signed), F.lit(0), step(STRING_FACTOR))
    total = F.aggregate(F.transform(path, of_text), F.lit(0), step(PATH_FACTOR))
    return F.when((F.size(path) == 1) & (path[0] == "info"), "info").otherwise(F.lower(F.lpad(F.hex(total), 2, "0")))


def alarm_form(row: Column) -> Column:
    """'absolute', 'end_relative', 'start_relative' or 'malformed', by the keys of a canon alarm row (JSON text)."""
    has = lambda key: F.try_variant_get(F.try_parse_json(row), f"$.{key}", "variant").isNotNull()
    end = F.try_variant_get(F.try_parse_json(row), "$.related", "string") == "end"
    return F.when(has("at"), "absolute").when(has("offset") & end, "end_relative").when(has("offset"), "start_relative").otherwise("malformed")


def component_kind(text: Column) -> Column:
    """The first component's kind after the calendar's head, time zones left out; null without one."""
    plain = F.regexp_replace(F.regexp_replace(text, r"\r?\n[ \t]", ""), r"(?is)BEGIN:VTIMEZONE.*?END:VTIMEZONE", "")
    found = F.upper(F.regexp_extract(plain, r"(?mi)^BEGIN:(?!VCALENDAR)([A-Z-]+)", 1))
    return F.when(found != "", found)
