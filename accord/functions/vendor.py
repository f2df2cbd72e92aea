"""Vendor JSON to canon JSON, in built-in expressions; JSON flattened to paths; pseudonyms."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from accord.functions.text import once
from accord.operators.canon import ENVELOPE, EXTRAS, VERSION, digest_without, from_properties, properties
from accord.sources.shared import written

#: Task fields and their canon names; the other fields are extras.
TASK_FIELDS = {"title": "summary", "notes": "description", "status": "status", "completed": "completed", "updated": "lastModified", "parent": "parentUid", "position": "sortOrder"}
#: Event texts and their canon names, and flags that stay as they are.
EVENT_TEXTS = {"summary": "summary", "description": "description", "location": "location", "visibility": "classification", "transparency": "timeTransparency", "colorId": "color", "eventType": "eventType"}
EVENT_FLAGS = ("guestsCanModify", "guestsCanInviteOthers", "guestsCanSeeOtherGuests", "locked", "privateCopy")


def _text(json: Column) -> Column:
    """The text of a JSON value, if it is one and isn't empty; null for other types."""

    def text(x: Column) -> Column:
        escaped = F.get(F.from_json(F.concat(F.lit("["), x, F.lit("]")), "array<string>"), F.lit(0))
        return F.nullif(F.when(F.contains(x, F.lit("\\")), escaped).otherwise(F.substr(x, F.lit(2), F.length(x) - 2)), F.lit(""))

    return once(json, lambda x: F.when(x.startswith('"'), text(x)))


def _json(text: Column) -> Column:
    """A text as a JSON value."""
    return once(text, lambda t: F.when(t.isNotNull(), once(F.to_json(F.array(t)), lambda array: F.substr(array, F.lit(2), F.length(array) - 2))))


def _object(**fields: Column) -> Column:
    """A JSON object of JSON values, null ones left out; null without any."""
    held = F.map_filter(F.create_map(*(x for k, v in fields.items() for x in (F.lit(k), v))), lambda _, v: v.isNotNull())
    return once(held, lambda x: F.when(F.size(x) > 0, from_properties(x)))


def _utc(text: Column) -> Column:
    return F.date_format(F.try_to_timestamp(text), "yyyy-MM-dd'T'HH:mm:ss'Z'")


def _envelope(domain: str, uid: Column) -> dict[str, Column]:
    return {ENVELOPE: F.lit(f'{{"domain":"{domain}","v":{VERSION}}}'), "uid": _json(F.coalesce(uid, F.lit("")))}


def _at(held: Column, key: str) -> Column:
    return F.try_element_at(held, F.lit(key))


def google_task_to_canon(task: Column) -> Column:
    """A task in canon form: renamed texts, the due day, the rest as extras with a digest without etag; null for no JSON object."""

    def canon(held: Column) -> Column:
        day = F.regexp_extract(F.coalesce(_text(_at(held, "due")), F.lit("")), r"^(\d{4}-\d{2}-\d{2})", 1)
        fields = {canon: _json(_text(_at(held, own))) for own, canon in TASK_FIELDS.items()}
        fields["due"] = once(day, lambda due: F.when(due != "", F.concat(F.lit('{"allDay":true,"date":'), _json(due), F.lit("}"))))
        left = from_properties(F.map_filter(held, lambda k, _: ~k.isin("id", "due", *TASK_FIELDS)))
        extras = once(left, lambda x: F.struct(F.when(x != "{}", F.concat(F.lit('{"google":'), x, F.lit("}"))).alias("extras"), _json(digest_without(x, ("etag",))).alias("digest")))
        return once(extras, lambda x: _object(**fields, **{EXTRAS: x["extras"], "providerExtrasDigest": x["digest"]}, **_envelope("todo", _text(_at(held, "id")))))

    return once(properties(task), lambda held: F.when(F.size(held) > 0, canon(held)))


def google_time(json: Column) -> Column:
    """{date, allDay} or {dateTime (UTC), floating, tz} of a vendor time (JSON text); null without a valid one."""

    def time(held: Column) -> Column:
        timed = once(_utc(_text(_at(held, "dateTime"))), lambda utc: F.when(utc.isNotNull(), _object(dateTime=_json(utc), floating=F.lit("false"), tz=_json(_text(_at(held, "timeZone"))))))
        return once(_text(_at(held, "date")), lambda date: F.when(date.isNotNull(), F.concat(F.lit('{"allDay":true,"date":'), _json(date), F.lit("}"))).otherwise(timed))

    return once(properties(json), time)


def google_event_to_canon(event: Column) -> Column:
    """An event's core fields in canon form; null for text that is no JSON object. The text is parsed once into its properties."""
    person = lambda v: once(properties(v), lambda p: _object(email=_json(_text(_at(p, "email"))), name=_json(_text(_at(p, "displayName")))))

    def canon(held: Column) -> Column:
        at = lambda key: _at(held, key)
        fields = {canon: _json(_text(at(own))) for own, canon in EVENT_TEXTS.items()}
        fields |= {key: F.when(at(key).isin("true", "false"), at(key)) for key in EVENT_FLAGS}
        fields |= {"status": _json(F.lower(_text(at("status")))), "created": _json(_utc(_text(at("created")))), "lastModified": _json(_utc(_text(at("updated"))))}
        fields |= {"sequence": F.when(at("sequence").rlike(r"^-?\d+(\.\d+)?$"), at("sequence").try_cast("double").try_cast("long").cast("string"))}
        start = google_time(at("start"))
        fields |= {"start": start, "allDay": F.when(once(properties(at("start")), lambda p: _text(_at(p, "date")).isNotNull()), F.lit("true")), "end": google_time(at("end")), "recurrenceId": google_time(at("originalStartTime"))}
        fields |= {"recurrence": F.when(at("recurrence").rlike(r"^\[.+\]$"), at("recurrence")), "organizer": F.when(at("organizer").isNotNull(), person(at("organizer")))}
        guests = F.when(at("attendees").startswith("["), F.from_json(at("attendees"), "array<string>"))
        named = F.filter(F.transform(guests, person), lambda v: F.coalesce(F.contains(v, F.lit('"email":')), F.lit(False)))
        fields["attendees"] = once(named, lambda x: F.when(F.size(x) > 0, F.concat(F.lit("["), F.array_join(x, ","), F.lit("]"))))
        return _object(**fields, **_envelope("calendar", F.coalesce(_text(at("iCalUID")), _text(at("id")))))

    return once(properties(event), lambda held: F.when(F.size(held) > 0, canon(held)))


def ms_contact_emails(contact: Column) -> Column:
    """array<struct<value, name, primary>>: addresses in order, the primary one flagged, or put last if it is not among them."""
    row = "struct<address:string,name:string>"
    entry = lambda r, primary: F.struct(r["address"].alias("value"), F.nullif(r["name"], F.lit("")).alias("name"), primary.alias("primary"))

    def mails(e: Column) -> Column:
        first = F.nullif(e["primaryEmailAddress"]["address"], F.lit(""))
        given = F.filter(F.coalesce(e["emailAddresses"], F.array().cast(f"array<{row}>")), lambda r: F.coalesce(r["address"], F.lit("")) != "")
        listed = F.transform(given, lambda r: entry(r, F.coalesce(r["address"] == first, F.lit(False))))
        lacks = first.isNotNull() & ~F.exists(given, lambda r: r["address"] == first)
        return F.when(lacks, F.concat(listed, F.array(entry(e["primaryEmailAddress"], F.lit(True))))).otherwise(listed)

    return once(F.from_json(contact, f"struct<emailAddresses:array<{row}>,primaryEmailAddress:{row}>"), mails)


def ms_contact_phones(contact: Column) -> Column:
    """array<struct<value, type>>: home, work and mobile numbers."""
    none = F.array().cast("array<string>")
    typed = lambda numbers, kind: F.transform(F.filter(F.coalesce(numbers, none), lambda v: F.coalesce(v, F.lit("")) != ""), lambda v: F.struct(v.alias("value"), F.lit(kind).alias("type")))
    phones = lambda e: F.concat(typed(e["homePhones"], "home"), typed(e["businessPhones"], "work"), typed(F.array(e["mobilePhone"]), "mobile"))
    return once(F.from_json(contact, "struct<homePhones:array<string>,businessPhones:array<string>,mobilePhone:string>"), phones)


def flatten_json(df: DataFrame, id_: str, column: str) -> DataFrame:
    """id, path, value (JSON text) of every leaf of a JSON column, at any depth; text that is no JSON gives no row.

    Each level of nesting is a written table, exploded once into the next; the input is read once. Empty objects and
    arrays are leaves.
    """
    level = written(df.select(F.col(id_).alias("__id"), F.lit("$").alias("path"), F.try_parse_json(column).alias("v")).where("v is not null"))
    spark, out = df.sparkSession, None
    while True:
        kind = F.schema_of_variant("v")
        nested = (kind.startswith("OBJECT<") & (kind != "OBJECT<>")) | (kind.startswith("ARRAY<") & (F.to_json("v") != "[]"))
        marked = level.withColumn("__nested", nested)
        leaves = marked.where("not __nested").select(F.col("__id").alias(id_), "path", F.to_json("v").alias("value"))
        out = leaves if out is None else out.unionByName(leaves)
        inner = written(spark.sql("""SELECT l.__id, concat(l.path, CASE WHEN t.key IS NULL THEN concat('[', t.pos, ']') ELSE concat('.', t.key) END) AS path, t.value AS v
          FROM {level} l, LATERAL variant_explode(l.v) t WHERE l.__nested""", level=marked))
        if inner.isEmpty():
            return out
        level = inner


def undeclared_differences(a: DataFrame, b: DataFrame, id_: str, patterns: list[str]) -> DataFrame:
    """id, path, a, b of flattened rows that differ and whose path matches none of the declared patterns."""
    x, y = a.withColumnRenamed("value", "a"), b.withColumnRenamed("value", "b")
    met = x.join(y, [id_, "path"], "full").where("not (a <=> b)")
    for pattern in patterns:
        met = met.where(~F.col("path").rlike(pattern))
    return met


def pseudonym_dictionary(tables: list[tuple[DataFrame, str, dict[str, str]]]) -> DataFrame:
    """word, value, name ('<word><number>') over several tables (rows, order column, {column: word}).

    A value has one name for its word wherever it is found; numbers go by the first place: the table's, then the
    order's, then the column's, among all values of the word. Null has none. Values are ranged by first place and
    each range's numbers go on from those before it.
    """
    found = None
    for k, (df, order, columns) in enumerate(tables):
        given = F.array(*(F.struct(F.lit(word).alias("word"), F.col(c).cast("string").alias("value"), F.lit(i).alias("c")) for i, (c, word) in enumerate(columns.items())))
        one = df.select(F.lit(k).alias("t"), F.col(order).alias("at"), F.explode(given).alias("x")).select("x.word", "x.value", F.struct("t", F.col("at"), "x.c").alias("place")).where("value is not null")
        found = one if found is None else found.unionByName(one)
    first = found.groupBy("word", "value").agg(F.min("place").alias("place"))
    ranged = written(first.repartitionByRange("word", "place", "value").withColumn("__part", F.spark_partition_id()))
    own = F.row_number().over(Window.partitionBy("__part", "word").orderBy("place", "value"))
    counts = ranged.groupBy("__part", "word").agg(F.count("*").alias("__n"))
    before = Window.partitionBy("word").orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select("__part", "word", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__start"))
    return ranged.withColumn("__k", own).join(starts, ["__part", "word"]).select("word", "value", F.concat("word", (F.col("__start") + F.col("__k")).cast("string")).alias("name"))


#: Forms that a value is found in and its name is put into: '{}' stands for the name.
PLAIN = "{}"


def pseudonymise(df: DataFrame, order: str, columns: dict[str, str], names: DataFrame | None = None, forms: dict[str, str] | None = None) -> DataFrame:
    """df with each named column's values replaced by their names '<word><number>'; null stays null.

    names: a dictionary made over more tables; else one over these columns, so that columns of one word share
    their numbering and equal values have equal names in all of them. forms: by column, a text in which '{}' stands for the name,
    so that an address stays an address ('{}@example.com').
    """
    names = written(pseudonym_dictionary([(df, order, columns)]) if names is None else names)
    for column, word in columns.items():
        of = names.where(F.col("word") == word).select(F.col("value").alias("__v"), F.replace(F.lit((forms or {}).get(column, PLAIN)), F.lit("{}"), F.col("name")).alias("__name"))
        df = df.join(of, df[column].cast("string") == F.col("__v"), "left").withColumn(column, F.col("__name")).drop("__v", "__name")
    return df
