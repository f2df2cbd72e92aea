"""Loss of conversions: what a record really loses, profiles along a pipeline, the ledger of edges, conversion paths."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from accord.functions.text import once
from accord.operators.canon import kind_of, properties

#: Kinds of loss by severity, and the words that sum them up, in the order of a summary.
SEVERITY = {"reversible": 0, "degraded": 1, "simplified": 2, "dropped": 3}
VERBS = {"dropped": "drops", "simplified": "simplifies", "reversible": "stashes", "degraded": "degrades"}
POLICIES = ("abort", "warn", "proceed")


def _severity(kind: Column) -> Column:
    return F.element_at(F.create_map(*(F.lit(x) for pair in SEVERITY.items() for x in pair)), kind)


def materialized_loss(records: DataFrame, loss: DataFrame) -> DataFrame:
    """mapping_id, id, lost (sorted properties): what each record (data: canon JSON) holds and its conversion loses.

    loss: property, loss_kind, lossless (array of JSON texts that survive, or null); with a column kind, rows of a
    kind hold for records of that kind (in their envelope) alone, and those of null kind for records whose kind has
    none of its own; a row of null property declares a kind that loses nothing. Reversible loss does not count,
    nor do values that are null, empty or in the lossless set. Records that lose nothing: no row.
    """
    kind = F.coalesce("kind", F.lit("")) if "kind" in loss.columns else F.lit("")
    counts = F.when((F.col("loss_kind") != "reversible") & F.col("property").isNotNull(), F.struct(F.col("property").alias("key"), "lossless"))
    # a profile is a kind's properties, a few: it is met whole, and the record keeps to its own row
    profiles = loss.select(kind.alias("kind"), counts.alias("x")).groupBy("kind").agg(F.collect_set("x").alias("own"))
    default = profiles.where("kind = ''").agg(F.flatten(F.collect_list("own")).alias("default"))
    held = records.select("mapping_id", "id", properties(F.col("data")).alias("held"))
    of = F.coalesce(kind_of(F.col("held")), F.lit("")) if "kind" in loss.columns else F.lit("")
    met = held.select("mapping_id", "id", "held", of.alias("kind")).join(F.broadcast(profiles), "kind", "left").crossJoin(F.broadcast(default))
    blank = lambda value: value.isin("null", '""', "[]", "{}")
    loses = lambda row, value: ~blank(value) & ~F.coalesce(F.array_contains(row["lossless"], value), F.lit(False))
    found = F.filter(F.coalesce("own", "default"), lambda row: F.coalesce(loses(row, F.try_element_at("held", row["key"])), F.lit(False)))
    lost = met.select("mapping_id", "id", F.array_distinct(F.transform(found, lambda row: row["key"])).alias("lost")).where(F.size("lost") > 0)
    return lost.groupBy("mapping_id", "id").agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list("lost")))).alias("lost"))


def apply_loss_policy(lost: DataFrame, policies: DataFrame) -> DataFrame:
    """mapping_id, lossy (records), verdict: 'abort', 'warn' or 'proceed' by the mapping's policy, 'proceed' without loss."""
    count = lost.groupBy("mapping_id").agg(F.count("*").alias("lossy"))
    rows = policies.join(count, "mapping_id", "left").withColumn("lossy", F.coalesce("lossy", F.lit(0)))
    return rows.select("mapping_id", "lossy", F.when(F.col("lossy") > 0, F.col("policy")).otherwise("proceed").alias("verdict"))


def compose_loss(edges: DataFrame, by: str = "path") -> DataFrame:
    """path, property, loss_kind, lossless: each path's edges (path, property, loss_kind, lossless) composed.

    The most severe kind counts; of the sets of lossless values, those that are there are intersected.
    """
    kinds = F.max_by("loss_kind", _severity(F.col("loss_kind")))
    sets = F.collect_list("lossless")  # a set for each hop of a path: a few
    both = F.aggregate(F.slice(F.col("sets"), 2, F.greatest(F.size("sets") - 1, F.lit(0))), F.get("sets", F.lit(0)), lambda a, b: F.array_intersect(a, b))
    rows = edges.groupBy(by, "property").agg(kinds.alias("loss_kind"), sets.alias("sets"))
    return rows.select(by, "property", "loss_kind", F.when(F.size("sets") > 0, F.array_sort(both)).alias("lossless"))


def loss_matrix(edges: DataFrame) -> DataFrame:
    """edge, property, loss_kind: the ledger, in order."""
    return edges.select("edge", "property", "loss_kind").orderBy("edge", "property")


def loss_summary(edges: DataFrame, by: str = "edge") -> DataFrame:
    """edge, summary: 'drops a, b; simplifies c; stashes d; degrades e'; 'lossless' for an edge with null properties only."""
    of = lambda kind: F.array_sort(F.collect_set(F.when(F.col("loss_kind") == kind, F.col("property"))))
    rows = edges.groupBy(by).agg(*(of(kind).alias(kind) for kind in VERBS))
    part = [F.when(F.size(kind) > 0, F.concat(F.lit(f"{verb} "), F.array_join(kind, ", "))) for kind, verb in VERBS.items()]
    text = F.concat_ws("; ", *part)
    return rows.select(by, F.when(text == "", "lossless").otherwise(text).alias("summary"))


def loss_ledger(edges: DataFrame) -> DataFrame:
    """domain, text: the ledger of a domain's declared losses, the same to the byte whenever it is made anew.

    edges: domain, source, target (encodings), kind (null: the default profile), property (null: nothing is lost),
    loss_kind. Lists the edges, lossy ones and those with profiles by kind marked, then a table for each profile that
    loses something, the default one before the kinds. A domain's edges and their properties are a few hundred rows.
    """
    title = F.concat("source", F.lit(" -> "), "target")
    one = edges.withColumn("edge", title).groupBy("domain", "edge").agg(F.array_sort(F.collect_set(F.col("kind"))).alias("kinds"), F.count("property").alias("lost"))
    tags = F.array_compact(F.array(F.when(F.col("lost") > 0, "lossy"), F.when(F.size("kinds") > 0, F.concat(F.lit("by kind: default, "), F.array_join("kinds", ", ")))))
    line = F.concat(F.lit("- "), "edge", F.when(F.size(tags) > 0, F.concat(F.lit(" ("), F.array_join(tags, "; "), F.lit(")"))).otherwise(""))
    inventory = one.groupBy("domain").agg(F.array_join(F.array_sort(F.collect_list(line)), "\n").alias("inventory"))
    scoped = edges.withColumn("edge", title).join(one.select("domain", "edge", F.size("kinds").alias("n")), ["domain", "edge"])
    rows = scoped.where("property is not null").groupBy("domain", "edge", "kind", "n").agg(F.array_sort(F.collect_set(F.concat(F.lit("| "), "property", F.lit(" | "), "loss_kind", F.lit(" |")))).alias("rows"))
    head = F.concat(F.lit("### "), "edge", F.when(F.col("n") > 0, F.concat(F.lit(" ("), F.coalesce("kind", F.lit("default")), F.lit(")"))).otherwise(""))
    part = F.concat(head, F.lit("\n\n| property | loss |\n|---|---|\n"), F.array_join("rows", "\n"))
    parts = rows.groupBy("domain").agg(F.array_sort(F.collect_list(F.struct("edge", F.coalesce("kind", F.lit("")).alias("kind"), part.alias("part")))).alias("parts"))
    body = F.coalesce(F.array_join(F.transform("parts", lambda x: x["part"]), "\n\n"), F.lit("No declared losses."))
    return inventory.join(parts, "domain", "left").select("domain", F.concat(F.lit("## "), "domain", F.lit("\n\n"), "inventory", F.lit("\n\n"), body, F.lit("\n")).alias("text"))


#: A shape is a domain and an encoding; ANY takes whatever is there.
Shape = tuple[str, str]
ANY = "any"


@dataclass(frozen=True)
class Edge:
    """A conversion: from one shape to another of its domain, by a column expression, with its loss (property, loss_kind, lossless values or None)."""

    source: Shape
    target: Shape
    convert: Callable[[Column], Column]
    loss: tuple[tuple[str, str, tuple[str, ...] | None], ...] = ()


def conversion_plan(edges: list[Edge], spines: dict[str, list[Shape]], source: Shape, target: Shape) -> list[Edge] | None:
    """The edges from source to target over the domain's spine, its canonical shapes in order; [] where nothing is to do, None without a way.

    A shape off the spine is led to the first spine shape that it has an edge to, or reached from the first that has one
    to it; between the two the way goes along the spine, step by step. Any target takes the source as it is; an
    unknown source ('any') and another domain have no way.
    """
    if target[1] == ANY:
        return []
    if source[1] == ANY:
        return None
    if source == target:
        return []
    spine = spines.get(source[0], []) if source[0] == target[0] else []
    by = {(e.source, e.target): e for e in reversed(edges)}
    lead = tail = None
    if source not in spine:
        lead = next((e for node in spine if (e := by.get((source, node)))), None)
        if lead is None:
            return None
    if target not in spine:
        tail = next((e for node in spine if (e := by.get((node, target)))), None)
        if tail is None:
            return None
    begin, end = spine.index(lead.target if lead else source), spine.index(tail.source if tail else target)
    step = 1 if begin < end else -1
    walk = [by.get((spine[k], spine[k + step])) for k in range(begin, end, step)]
    return None if None in walk else [e for e in (lead, *walk, tail) if e is not None]


def converted(df: DataFrame, plan: list[Edge], column: str = "data") -> DataFrame:
    """df with a column taken through all steps of a plan, as one chained expression that makes each step's value once."""
    return df.withColumn(column, reduce(lambda value, edge: once(value, edge.convert), plan, F.col(column)))


def plan_loss(spark: SparkSession, plan: list[Edge], path: str = "path") -> DataFrame:
    """path, property, loss_kind, lossless: the composed loss of a plan's steps."""
    rows = [(path, p, kind, list(values) if values is not None else None) for e in plan for p, kind, values in e.loss]
    return compose_loss(spark.createDataFrame(rows, "path string, property string, loss_kind string, lossless array<string>"))


def conversion_path(edges: list[Edge], spines: dict[str, list[Shape]], source: Shape, target: Shape) -> list[str] | None:
    """The encodings that a plan goes through, from the source's on; None without a way."""
    plan = conversion_plan(edges, spines, source, target)
    return None if plan is None else [source[1], *(e.target[1] for e in plan)]
