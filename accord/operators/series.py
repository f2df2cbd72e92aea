"""Recurring series as canon records: a master cut in two at an instant, with its exceptions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from accord.functions.text import once, rrule_parts
from accord.operators.canon import from_properties, properties
from accord.sources.shared import written


def _utc(time: Column, form: str) -> Column:
    return F.date_format(F.to_utc_timestamp(time, F.current_timezone()), form)


def _text(json: Column) -> Column:
    """A JSON text value; null for other types."""
    return once(F.try_parse_json(json), lambda value: F.when(F.schema_of_variant(value) == "STRING", F.try_variant_get(value, "$", "string")))


def _json(text: Column) -> Column:
    return once(F.to_json(F.array(text)), lambda array: F.substr(array, F.lit(2), F.length(array) - 2))


def _with(held: Column, **fields: Column) -> Column:
    """A property map with fields (JSON texts) put in; null ones go."""
    rest = F.map_filter(held, lambda k, _: ~k.isin(*fields))
    return F.map_filter(F.map_concat(rest, F.create_map(*(x for k, v in fields.items() for x in (F.lit(k), v)))), lambda _, v: v.isNotNull())


def _retimed(json: Column, at: Column) -> Column:
    """A canon time moved to an instant in its own shape, a date or a date-time; other fields stay, null stays null."""
    day, time = _json(_utc(at, "yyyy-MM-dd")), _json(_utc(at, "yyyy-MM-dd'T'HH:mm:ss'Z'"))

    def moved(held: Column) -> Column:
        has = lambda key: F.array_contains(F.map_keys(held), key)
        return from_properties(F.when(has("date"), _with(held, date=day)).when(has("dateTime"), _with(held, dateTime=time)).otherwise(held))

    return F.when(json.isNotNull(), once(properties(json), moved))


def tightened(rule: Column, at: Column, all_day: Column) -> Column:
    """A rule line whose UNTIL lies before an instant, in place, never later than it was; all other bytes stay.

    An UNTIL that is a date stays one: the day before. Without one, all_day tells whether a date is written.
    """
    until = F.try_element_at(rrule_parts(rule), F.lit("UNTIL"))
    is_day = F.when(until.isNotNull(), until.rlike(r"^\d{8}$")).otherwise(all_day)
    day = F.least(F.date_sub(F.to_utc_timestamp(at, F.current_timezone()).cast("date"), 1), F.try_to_timestamp(until, F.lit("yyyyMMdd")).cast("date"))
    own = F.regexp_extract(until, r"^(\d{8}T\d{6})Z?$", 1)
    new = F.least(_utc(at - F.expr("interval 1 second"), "yyyyMMdd'T'HHmmss"), F.when(F.try_to_timestamp(own, F.lit("yyyyMMdd'T'HHmmss")).isNotNull(), own))
    token = F.concat(F.lit(";UNTIL="), F.when(is_day, F.date_format(day, "yyyyMMdd")).otherwise(F.concat(new, F.lit("Z"))))
    return F.when(F.contains(rule, F.lit("UNTIL=")), F.regexp_replace(rule, F.lit(";UNTIL=[^;]*"), token)).otherwise(F.concat(rule, token))


def split_series(masters: DataFrame, splits: DataFrame, exceptions: DataFrame) -> DataFrame:
    """uid, part, data, error: masters (uid, data: canon JSON) cut at instants (uid, at), and all exceptions (uid, data).

    part 'old': the master with its rule tightened; 'new': its continuation, uid <uid>-split-<instant>, with the rule
    as it was, start and due moved to the instant in their own shape, and seriesSplitOf the old uid; 'exception':
    those whose recurrenceId lies at or after the instant have the new uid, the others stay as they are;
    'error': what can't be cut, with the reason: no uid, an exception in place of a master, no instant, no rule, a rule with
    COUNT, a split beyond the first of one uid, an unknown uid. uid is always that of the given row.
    """
    rank = F.row_number().over(Window.partitionBy("uid").orderBy(F.col("at").asc_nulls_last()))
    asked = splits.select("uid", "at").distinct().withColumn("__nth", rank)
    at, none = F.col("at"), F.lit(None).cast("string")
    is_rule = lambda x: F.coalesce(F.upper(x).startswith("RRULE") & F.contains(x, F.lit(":")), F.lit(False))
    of = lambda held, key: F.try_element_at(held, F.lit(key))
    has = lambda held, key: F.array_contains(F.map_keys(held), key)

    def opened(held: Column) -> Column:
        lines = F.coalesce(F.from_json(of(held, "recurrence"), "array<string>"), F.array().cast("array<string>"))
        return once(F.struct(lines.alias("lines"), _text(of(held, "uid")).alias("uid")), lambda own: once(F.array_position(F.transform(own["lines"], is_rule), F.lit(True)), lambda place: ruled(held, own, place)))

    def ruled(held: Column, own: Column, place: Column) -> Column:
        rule = F.get(own["lines"], place - 1)
        error = (
            F.when(F.col("__known").isNull(), "no master").when(F.coalesce(own["uid"], F.lit("")) == "", "no uid").when(has(held, "recurrenceId"), "an exception, no master")
            .when(at.isNull(), "no instant").when(rule.isNull(), "no rule").when(has(rrule_parts(rule), "COUNT"), "count-bounded").when(F.col("__nth") > 1, "another split")
        )
        name = F.concat(own["uid"], F.lit("-split-"), F.regexp_replace(_utc(at, "yyyy-MM-dd'T'HH:mm:ss'Z'"), "[^A-Za-z0-9]", ""))
        good = once(F.struct(rule.alias("rule"), name.alias("name")), lambda x: parted(held, own, place, x["rule"], x["name"]))
        empty = F.struct(*(none.alias(c) for c in ("name", "old", "new")))
        return once(error, lambda e: F.struct(e.alias("error"), F.when(e.isNull(), good).otherwise(empty).alias("made")))

    def parted(held: Column, own: Column, place: Column, rule: Column, name: Column) -> Column:
        dated = lambda field, key: once(properties(of(held, field)), lambda x: has(x, key))
        all_day = F.when(dated("start", "date"), True).when(dated("start", "dateTime"), False).otherwise(dated("due", "date"))
        tight = once(tightened(rule, at, all_day), lambda t: F.transform(own["lines"], lambda x, i: F.when(i == place - 1, t).otherwise(x)))
        moved = {k: _retimed(of(held, k), at) for k in ("start", "due")}
        new = _with(held, uid=_json(name), recurrence=F.to_json(F.array(rule)), seriesSplitOf=_json(own["uid"]), recurrenceId=none, recurrenceRange=none, **moved)
        return F.struct(name.alias("name"), from_properties(_with(held, recurrence=F.to_json(tight))).alias("old"), from_properties(new).alias("new"))

    # each master is opened once a row and cut once; parts, errors and exceptions read what was made
    met = asked.join(masters.select("uid", "data", F.lit(True).alias("__known")), "uid", "left")
    made = written(met.select("uid", "at", once(properties(F.col("data")), opened).alias("x")).select("uid", "at", "x.error", "x.made.*"))
    good = made.where("error is null")
    parts = good.select("uid", F.explode(F.array(F.struct(F.lit("old").alias("part"), F.col("old").alias("data")), F.struct(F.lit("new").alias("part"), F.col("new").alias("data")))).alias("p")).select("uid", "p.*", none.alias("error"))

    def rebased(held: Column) -> Column:
        recurrence = _text(of(properties(of(held, "recurrenceId")), "dateTime"))
        when = once(recurrence, lambda r: F.when(r.rlike(r"^\d{4}-\d{2}-\d{2}"), F.try_to_timestamp(r)))
        return F.when(when >= F.col("__cut"), from_properties(_with(held, uid=_json(F.col("__new"))))).otherwise(F.col("data"))

    kept = exceptions.select("uid", "data").join(good.select("uid", at.alias("__cut"), F.col("name").alias("__new")), "uid", "left")
    kept = kept.select("uid", F.lit("exception").alias("part"), F.when(F.col("__new").isNotNull(), once(properties(F.col("data")), rebased)).otherwise(F.col("data")).alias("data"), none.alias("error"))
    return parts.unionByName(kept).unionByName(made.where("error is not null").select("uid", F.lit("error").alias("part"), none.alias("data"), "error"))
