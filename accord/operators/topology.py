"""Logical calendars: discovered collections by name, validation, promotion, mappings between bindings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from accord.functions.text import calendar_id


def _named(name: Column) -> Column:
    return F.lower(F.trim(name))


def auto_match(discovered: DataFrame, order: list, existing: DataFrame | None = None) -> DataFrame:
    """name, display_name, type, color, bindings (backends, joined) of discovered collections, a row for each name.

    discovered: backend, calendar, name, seq, events, todos, color; names are compared trimmed and without
    case, existing ones (name) are left out. type: 'events' or 'todos' if all support it alone, else
    'hybrid'. The first collection by seq gives the display name, the first one with a colour the colour.
    Bindings follow the order of the backends, a handful; one without the collection is pending
    ('?' after its name).
    """
    rows = discovered.withColumn("key", _named(F.col("name")))
    if existing is not None:
        rows = rows.join(existing.select(_named(F.col("name")).alias("key")).distinct(), "key", "left_anti")
    all_events, all_todos = F.bool_and("events"), F.bool_and("todos")
    kind = F.when(all_events & ~all_todos, "events").when(all_todos & ~all_events, "todos").otherwise("hybrid")
    color = F.min_by("color", F.when(F.col("color").isNotNull(), F.col("seq")))
    named = rows.groupBy("key").agg(F.min_by("name", "seq").alias("display_name"), kind.alias("type"), color.alias("color"), F.collect_set("backend").alias("held"))
    bound = [F.when(F.array_contains("held", backend), str(backend)).otherwise(f"{backend}?") for backend in order]
    return named.select(F.col("key").alias("name"), "display_name", "type", "color", F.concat_ws(",", *bound).alias("bindings"))


def logical_calendars(discovered: DataFrame, primary: str | None, order: list, existing: DataFrame | None = None) -> DataFrame:
    """calendar (its name's key), display_name, type, color, sync_enabled, bindings of discovered collections, as auto_match names them.

    bindings: array<struct<backend, remote, role, position, enabled, pending>>: the primary backend first, then those of
    `order` as sync1, sync2 and so on. Each is bound to its first collection of the name by seq; where it has none the
    binding is pending, its remote id made from the display name. A calendar is synchronised if it has more than a
    primary. Backends are texts, a handful.
    """
    named = auto_match(discovered, [], existing).drop("bindings")
    first = discovered.select(_named(F.col("name")).alias("name"), F.col("backend").cast("string").alias("backend"), F.col("calendar").cast("string").alias("remote"), "seq")
    held = first.groupBy("name", "backend").agg(F.min_by("remote", "seq").alias("remote")).groupBy("name").agg(F.map_from_entries(F.collect_list(F.struct("backend", "remote"))).alias("held"))
    others = [b for b in dict.fromkeys(order) if b != primary]
    roles = [*([(primary, "primary")] if primary else []), *((b, f"sync{k}") for k, b in enumerate(others, 1))]

    def bound(k: int, backend: str, role: str) -> Column:
        own = F.try_element_at("held", F.lit(str(backend)))
        return F.struct(F.lit(str(backend)).alias("backend"), F.coalesce(own, calendar_id(F.col("display_name"))).alias("remote"), F.lit(role).alias("role"), F.lit(k).alias("position"), F.lit(True).alias("enabled"), own.isNull().alias("pending"))

    bindings = F.array(*(bound(k, b, role) for k, (b, role) in enumerate(roles)))
    return named.join(held, "name").select(F.col("name").alias("calendar"), "display_name", "type", "color", F.lit(len(others) > 0).alias("sync_enabled"), bindings.alias("bindings"))


def binding_rows(calendars: DataFrame) -> DataFrame:
    """calendar, display_name and the columns of its bindings, a row each, as validate_bindings and generate_mappings take them."""
    return calendars.select("calendar", "display_name", F.inline("bindings"))


def validate_bindings(bindings: DataFrame) -> DataFrame:
    """calendar, problem: missing id or name, other than one enabled primary, a backend's calendar bound twice.

    bindings: calendar, display_name, backend, remote, role, enabled; an empty display_name is a missing one.
    """
    primaries = F.count_if((F.col("role") == "primary") & F.col("enabled"))
    per = bindings.groupBy("calendar").agg(F.max(F.coalesce("display_name", F.lit(""))).alias("name"), primaries.alias("primaries"))
    twice = bindings.groupBy("calendar", "backend", "remote").agg(F.count("*").alias("n")).where("n > 1").select("calendar").distinct()
    problem = F.array_compact(F.array(F.when(F.coalesce(F.col("calendar").cast("string"), F.lit("")) == "", "no id"), F.when(F.col("name") == "", "no name"), F.when(F.col("primaries") == 0, "no primary"), F.when(F.col("primaries") > 1, "several primaries")))
    return per.select("calendar", F.explode(problem).alias("problem")).unionByName(twice.select("calendar", F.lit("duplicate binding").alias("problem")))


def promote_primary(bindings: DataFrame, chosen: DataFrame) -> DataFrame:
    """bindings with the chosen one (calendar, backend) as primary; the former enabled primary becomes sync1, of position 1 at least."""
    met = bindings.join(chosen.select("calendar", F.col("backend").alias("__to")), "calendar", "left")
    ups = (F.col("backend") == F.col("__to")) & F.col("__to").isNotNull()
    downs = F.col("__to").isNotNull() & ~ups & (F.col("role") == "primary") & F.col("enabled")
    there = F.max(ups.cast("int")).over(Window.partitionBy("calendar")) == 1
    role = F.when(there & ups, "primary").when(there & downs, "sync1").otherwise(F.col("role"))
    position = F.when(there & downs, F.greatest("position", F.lit(1))).otherwise(F.col("position"))
    return met.withColumns({"role": role, "position": position}).select(bindings.columns)


#: Fixed value: firsts that one group of pairs holds at most.
BLOCK = 512

#: The topology that each policy of a calendar stands for; 'manual' calendars have no generated mappings, others the given one.
POLICIES = {"hub": "star", "mesh": "mirror", "chain": "chain"}


def generate_mappings(bindings: DataFrame, topology: str, calendars: DataFrame | None = None) -> DataFrame:
    """id, calendar, first, second (backends) of bindings (calendar, backend, role, position; enabled, remote) as 'star', 'mirror' or 'chain'.

    The first enabled primary comes first, then the other enabled bindings by position, one by one as first
    and second; read-only ones, and those of the primary's own backend and remote, are left out. A calendar without
    an enabled primary (with a remote, where that is given) or without others has no mapping. calendars
    (calendar, policy, sync_enabled): their own policy, if any, goes before the topology, and only those that are
    synchronised have mappings. Backends are a handful a calendar.
    """
    if topology not in ("star", "mirror", "chain"):
        raise ValueError(topology)
    rows = bindings.where("enabled") if "enabled" in bindings.columns else bindings
    remote = F.col("remote").cast("string") if "remote" in bindings.columns else F.lit("-")
    calendar = Window.partitionBy("calendar")
    rows = rows.where("role <> 'readonly'").withColumn("__remote", remote)
    rank = F.row_number().over(calendar.orderBy((F.col("role") == "primary").desc(), "position", "backend"))
    rows = rows.withColumn("__front", (rank == 1) & (F.col("role") == "primary"))
    head = F.max(F.when(F.col("__front"), F.struct("backend", "__remote"))).over(calendar)
    rows = rows.withColumn("__head", head).where(F.coalesce(F.col("__head.__remote"), F.lit("")) != "")
    rows = rows.where(F.col("__front") | (F.col("backend") != F.col("__head.backend")) | ~F.col("__remote").eqNullSafe(F.col("__head.__remote")))
    ranked = rows.withColumn("place", F.row_number().over(calendar.orderBy(F.desc("__front"), "position", "backend"))).withColumn("wiring", F.lit(topology))
    if calendars is not None:
        own = F.coalesce(F.try_element_at(F.create_map(*(F.lit(x) for pair in POLICIES.items() for x in pair)), F.col("policy")), F.lit(topology))
        wired = calendars.where("sync_enabled and not (policy <=> 'manual')").select("calendar", own.alias("wiring"))
        ranked = ranked.drop("wiring").join(wired, "calendar")
    star, mirror = F.col("wiring") == "star", F.col("wiring") == "mirror"
    block = lambda place: F.floor((place - 1) / BLOCK)
    a = ranked.select("calendar", F.col("backend").alias("first"), F.col("place").alias("p"), block(F.col("place")).alias("__block"))
    # of a large calendar each block of firsts is met apart, in tasks of their own: the pairs of a mirror are as many as its answer
    q = F.col("place")
    blocks = F.when(star, F.array(block(F.lit(1)))).when(mirror, F.sequence(block(F.lit(1)), block(q))).otherwise(F.array(block(F.greatest(q - 1, F.lit(1)))))
    b = ranked.select("calendar", F.col("backend").alias("second"), q.alias("q"), "role", "wiring", F.explode(blocks).alias("__block"))
    b = b.repartition(4 * bindings.sparkSession.sparkContext.defaultParallelism, "calendar", "__block")
    met = a.join(b, ["calendar", "__block"]).where("p < q").where(F.when(star, F.col("p") == 1).when(mirror, F.lit(True)).otherwise(F.col("q") == F.col("p") + 1))
    parts = [F.lit("auto"), F.col("calendar").cast("string"), F.when(star, F.col("role")).otherwise(F.col("wiring")), F.when(~star, F.col("first")), F.when(~star, F.col("second"))]
    return met.select(F.concat_ws("_", *parts).alias("id"), "calendar", "first", "second")
