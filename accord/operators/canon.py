"""Canon records: JSON objects by property, their filters, digests, differences and merges."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from accord.functions.text import last_of_each, once

#: Keys of the envelope; the differ does not look at them.
ENVELOPE, EXTRAS = "_canon", "providerExtras"
#: Version of the envelope.
VERSION = 1
STRATEGIES = ("source", "target")


def variants(json: Column) -> Column:
    """map<property, variant>; text that is no JSON object gives an empty map. Of a repeated property the last counts."""
    last = lambda held: F.when(F.size(F.array_distinct(F.map_keys(held))) < F.size(held), last_of_each(F.map_entries(held))).otherwise(held)
    return F.coalesce(once(F.from_json(json, "map<string,variant>"), last), F.from_json(F.lit("{}"), "map<string,variant>"))


def properties(json: Column) -> Column:
    """map<property, value as JSON text with sorted keys>; text that is no JSON object gives an empty map.

    A JSON null is the text null, so it differs from a property that is not there. Of a repeated property the last counts.
    """
    return F.transform_values(variants(json), lambda _, v: F.to_json(v))


def _quoted(text: Column) -> Column:
    """A text as a JSON value, control characters escaped; most texts need no escape and cost no JSON writer."""
    escaped = lambda t: once(F.to_json(F.array(t)), lambda array: F.substr(array, F.lit(2), F.length(array) - 2))
    return once(text, lambda t: F.when(t.rlike(r'["\\\x00-\x1f]'), escaped(t)).otherwise(F.concat(F.lit('"'), t, F.lit('"'))))


def _object(entries: Column) -> Column:
    """The JSON object of array<struct<key, value>>, keys sorted; null values are left out."""
    held = F.sort_array(F.filter(entries, lambda e: e["value"].isNotNull()))
    text = F.array_join(F.transform(held, lambda e: F.concat(_quoted(e["key"]), F.lit(":"), e["value"])), ",")
    return F.concat(F.lit("{"), text, F.lit("}"))


def from_properties(held: Column) -> Column:
    """The JSON object of such a map, keys sorted; null values are left out."""
    return _object(F.map_entries(held))


def canonical(json: Column) -> Column:
    """JSON text with sorted keys and plain numbers; null for text that is no JSON."""
    return F.to_json(F.try_parse_json(json))


def digest_without(json: Column, volatile: tuple[str, ...]) -> Column:
    """SHA-256 of a JSON object without the volatile keys; null if nothing is left."""
    left = F.map_filter(properties(json), lambda k, _: ~k.isin(*volatile))
    return once(left, lambda x: F.when(F.size(x) > 0, F.sha2(from_properties(x), 256)))


def extras_digest(json: Column, volatile: tuple[str, ...] = ("etag",)) -> Column:
    """digest_without of a record's provider extras."""
    return digest_without(F.element_at(properties(json), EXTRAS), volatile)


def stamp_envelope(json: Column, domain: str, uid: Column, kind: Column | None = None) -> Column:
    """The object with envelope and uid put in; a null kind is left out."""
    head = [F.lit(f'"domain":"{domain}"'), F.lit(f'"v":{VERSION}')]
    if kind is not None:
        head.insert(1, F.concat(F.lit('"kind":'), _quoted(kind)))
    stamped = F.create_map(F.lit(ENVELOPE), F.concat(F.lit("{"), F.concat_ws(",", *head), F.lit("}")), F.lit("uid"), _quoted(uid))
    rest = F.map_filter(properties(json), lambda k, _: ~k.isin(ENVELOPE, "uid"))
    return from_properties(F.map_concat(rest, stamped))


def read_uid(json: Column) -> Column:
    return F.try_variant_get(F.try_parse_json(F.try_element_at(properties(json), F.lit("uid"))), "$", "string")


def read_kind(json: Column) -> Column:
    return kind_of(properties(json))


def kind_of(held: Column) -> Column:
    """read_kind of a property map."""
    return F.try_variant_get(F.try_parse_json(F.try_element_at(held, F.lit(ENVELOPE))), "$.kind", "string")


def matches(json: Column, name: str, test: str, value: str) -> Column:
    """Whether property `name` is an array that holds the text value ('contains'), or equals the JSON value ('equals').

    Anything missing, of another type or no JSON does not match.
    """
    if test == "contains":
        listed = F.try_variant_get(F.try_parse_json(F.try_element_at(properties(json), F.lit(name))), "$", "array<variant>")
        found = F.exists(listed, lambda v: F.to_json(v) == _quoted(F.lit(value)))
    elif test == "equals":
        found = F.try_element_at(properties(json), F.lit(name)) == canonical(F.lit(value))
    else:
        raise ValueError(test)
    return F.coalesce(found, F.lit(False))


def filtered_view(records: DataFrame, name: str, test: str, value: str) -> DataFrame:
    """The records of a parent collection that match."""
    return records.where(matches(F.col("data"), name, test, value))


def stamped(json: Column, name: str, test: str, value: str) -> Column:
    """The record changed so that it matches: the value is appended if it lacks, or put in place.

    A payload that is no JSON object stays; a property that is no array becomes one of the value alone.
    """
    held = properties(json)
    if test == "contains":
        one = F.transform(F.array(F.lit(value)), _quoted)
        listed = F.coalesce(F.transform(F.try_variant_get(F.try_parse_json(F.try_element_at(held, F.lit(name))), "$", "array<variant>"), lambda v: F.to_json(v)), F.array().cast("array<string>"))
        put = F.concat(F.lit("["), F.array_join(F.when(F.array_contains(listed, one[0]), listed).otherwise(F.concat(listed, one)), ","), F.lit("]"))
    elif test == "equals":
        put = canonical(F.lit(value))
    else:
        raise ValueError(test)
    rest = F.map_filter(held, lambda k, _: k != name)
    is_object = F.try_variant_get(F.try_parse_json(json), "$", "map<string,variant>").isNotNull()
    return F.when(is_object, from_properties(F.map_concat(rest, F.create_map(F.lit(name), put)))).otherwise(json)


def stamp_filter(records: DataFrame, name: str, test: str, value: str) -> DataFrame:
    """records with the filter's value stamped on each payload (column data)."""
    return records.withColumn("data", stamped(F.col("data"), name, test, value))


def _differing(x: Column, y: Column, names: list[str]) -> Column:
    """differing of property maps."""
    return F.filter(F.array(*map(F.lit, names)), lambda p: ~F.try_element_at(x, p).eqNullSafe(F.try_element_at(y, p)))


def differing(a: Column, b: Column, names: list[str]) -> Column:
    """The catalogue properties whose values differ, in catalogue order; envelope and extras never count."""
    return once(F.struct(properties(a).alias("x"), properties(b).alias("y")), lambda held: _differing(held["x"], held["y"], names))


def _choice(source_changed: Column, target_changed: Column, strategy: str) -> Column:
    """Whether the source's value is taken: changed there alone, or on both if the strategy says so."""
    if strategy not in STRATEGIES:
        raise ValueError(strategy)
    return source_changed if strategy == "source" else source_changed & ~target_changed


def merged(source: Column, target: Column, baseline: Column, names: list[str], strategy: str = "source") -> Column:
    """struct(data, changed_source, changed_target, kind_mismatch): three-way merge of canon objects.

    The merge starts from the target; a property changed on the source alone is the source's, on both
    that of the strategy. Provider extras follow the source if any property came from there. The uid and
    the kind are the target's unless it has none. A missing baseline counts as an empty object.
    """

    fixed = ("uid", ENVELOPE, EXTRAS)
    text = lambda held, p: F.to_json(F.try_element_at(held, p))
    kind = lambda held: F.nullif(F.try_variant_get(F.try_element_at(held, F.lit(ENVELOPE)), "$.kind", "string"), F.lit(""))

    def merge(held: Column) -> Column:
        # JSON text is made of the target's values and of what the other sides' are compared or taken by
        s, t, b = held["s"], held["t"], held["b"]
        return once(F.transform_values(t, lambda _, v: F.to_json(v)), lambda own: once(F.transform(F.array(*map(F.lit, names)), lambda p: compared(p, s, own, b)), lambda c: decided(s, t, own, c)))

    def compared(p: Column, s: Column, own: Column, b: Column) -> Column:
        values = F.struct(text(s, p).alias("s"), F.try_element_at(own, p).alias("t"), text(b, p).alias("b"))
        return once(values, lambda v: F.struct(p.alias("key"), v["s"].alias("value"), (~v["s"].eqNullSafe(v["b"])).alias("source"), (~v["t"].eqNullSafe(v["b"])).alias("target")))

    def decided(s: Column, t: Column, own: Column, c: Column) -> Column:
        taken = F.transform(F.filter(c, lambda x: _choice(x["source"], x["target"], strategy)), lambda x: F.struct(x["key"], x["value"]))
        return once(F.struct(taken.alias("taken"), kind(t).alias("t"), kind(s).alias("s")), lambda x: put(s, own, c, x["taken"], x["t"], x["s"]))

    def put(s: Column, own: Column, c: Column, taken: Column, own_kind: Column, other_kind: Column) -> Column:
        mine, other = (lambda p: F.try_element_at(own, F.lit(p))), (lambda p: text(s, F.lit(p)))
        extras = F.when(F.size(taken) > 0, other(EXTRAS)).otherwise(mine(EXTRAS))
        envelope = F.coalesce(F.when(own_kind.isNotNull(), mine(ENVELOPE)), F.when(other_kind.isNotNull(), other(ENVELOPE)), mine(ENVELOPE), other(ENVELOPE))
        heads = zip(fixed, (F.coalesce(mine("uid"), other("uid")), envelope, extras), strict=True)
        kept = F.filter(F.map_entries(own), lambda e: ~e["key"].isin(*fixed) & ~F.exists(taken, lambda x: x["key"] == e["key"]))
        entries = F.concat(kept, F.filter(taken, lambda x: ~x["key"].isin(*fixed)), F.array(*(F.struct(F.lit(k).alias("key"), v.alias("value")) for k, v in heads)))
        changed = lambda side: F.transform(F.filter(c, lambda x: x[side]), lambda x: x["key"])
        mismatch = F.coalesce(own_kind != other_kind, F.lit(False))
        return F.struct(_object(entries).alias("data"), changed("source").alias("changed_source"), changed("target").alias("changed_target"), mismatch.alias("kind_mismatch"))

    return once(F.struct(variants(source).alias("s"), variants(target).alias("t"), variants(baseline).alias("b")), merge)


def merge_records(source: DataFrame, target: DataFrame, baseline: DataFrame, names: list[str], strategy: str = "source") -> DataFrame:
    """uid, data, changed_source, changed_target, kind_mismatch for uids that both sides hold (uid, data each).

    A merge costs far more than its join, so rows are dealt by uid over all cores first; the joins keep to that dealing.
    """
    side = lambda df, p: df.select("uid", F.col("data").alias(p))
    spark = source.sparkSession
    parts = max(4 * spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))
    rows = side(source, "s").repartition(parts, "uid").join(side(target, "t"), "uid").join(side(baseline, "b"), "uid", "left")
    return rows.select("uid", merged(F.col("s"), F.col("t"), F.col("b"), names, strategy).alias("m")).select("uid", "m.*")


def note_merge(source: dict[str, Column], target: dict[str, Column], baseline: dict[str, Column], strategy: str = "source") -> Column:
    """struct(body, categories, conflict) of notes given as body, categories and modified (text times).

    Body and categories are merged apart. If both changed a field to different values the strategy
    decides on the whole field: 'source', 'target' or 'newest', where equal times go to the source.
    """
    later = F.coalesce(source["modified"], F.lit("")) >= F.coalesce(target["modified"], F.lit(""))
    wins = {"source": F.lit(True), "target": F.lit(False), "newest": later}[strategy]

    def pick(name: str) -> tuple[Column, Column]:
        s, t, b = source[name], target[name], baseline[name]
        sc, tc = ~s.eqNullSafe(b), ~t.eqNullSafe(b)
        clash = sc & tc & ~s.eqNullSafe(t)
        return F.when(clash, F.when(wins, s).otherwise(t)).when(sc, s).otherwise(t), clash

    (body, x), (categories, y) = pick("body"), pick("categories")
    return F.struct(body.alias("body"), categories.alias("categories"), (x | y).alias("conflict"))


def whole_merge(source: Column, target: Column, baseline: Column, strategy: str = "source") -> Column:
    """Whole-record merge of outlines and opaque payloads: the target only if it alone changed, or both did and it is preferred."""
    sc, tc = ~source.eqNullSafe(baseline), ~target.eqNullSafe(baseline)
    return F.when(tc & (~sc | F.lit(strategy == "target")), target).otherwise(source)


def contact_merge(source: dict[str, Column], target: dict[str, Column], baseline: dict[str, Column], known: Column, fields: list[str], strategy: str = "source") -> Column:
    """struct of the fields, merged one by one: the target's where it alone changed, or both did and it is preferred.

    known: whether there is a baseline; without one all fields are the preferred side's.
    """

    def pick(name: str) -> Column:
        s, t, b = source[name], target[name], baseline[name]
        sc, tc = ~s.eqNullSafe(b), ~t.eqNullSafe(b)
        preferred = t if strategy == "target" else s
        return F.when(~known, preferred).when(sc & tc, preferred).when(tc, t).otherwise(s).alias(name)

    return F.struct(*map(pick, fields))
