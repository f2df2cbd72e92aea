"""Entities linked by shared addresses, rosters, canon records."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from accord.operators.aliases import upsert
from accord.operators.graph import components
from accord.sources.shared import written


def link_entities(edges: DataFrame) -> DataFrame:
    """record, entity from record-email edges: records that share an address, directly or not, are one entity.

    The entity is the smallest record. Links go from each address's smallest record to its others,
    so an address of many records gives as many links, not their pairs.
    """
    low = edges.groupBy(F.lower("email").alias("address")).agg(F.min("record").alias("hub"))
    met = edges.select("record", F.lower("email").alias("address")).join(low, "address")
    found = components(met.select(F.col("record").alias("a"), F.col("hub").alias("b")))
    records = edges.select("record").distinct()
    return records.join(found, records["record"] == found["node"], "left").select("record", F.coalesce("component", "record").alias("entity"))


def event_roster(people: DataFrame, edges: DataFrame, entities: DataFrame, names: DataFrame | None = None) -> DataFrame:
    """event, position, email, entity of people (event, position, email): once each, in order, numbered from 0.

    The organizer has the first position. Addresses are compared without case, and the first spelling
    stays; empty ones are left out; strangers have no entity. With names (domain, record, name) a column
    name is added: that of the entity's first record by domain and record that has one.
    """
    address = F.lower("email")
    rows = people.where("email <> ''").groupBy("event", address.alias("address")).agg(F.min(F.struct("position", "email")).alias("first"))
    order = Window.partitionBy("event").orderBy("first.position", "address")
    rows = rows.select("event", "address", F.col("first.email").alias("email"), (F.row_number().over(order) - 1).alias("position"))
    index = edges.join(entities, "record").groupBy(address.alias("address")).agg(F.min("entity").alias("entity"))
    met = rows.join(index, "address", "left").select("event", "position", "email", "entity")
    if names is None:
        return met
    named = entities.join(names.where("name <> ''"), "record").groupBy("entity").agg(F.min_by("name", F.struct("domain", "record")).alias("name"))
    return met.join(named, "entity", "left").select("event", "position", "email", "entity", "name")


def canon_merge(source: DataFrame, target: DataFrame, baseline: DataFrame, properties: list[str], strategy: str = "source") -> DataFrame:
    """uid, changed_source, changed_target (properties, joined) and the merged properties.

    A property changed on the source alone is the source's; on both, that of the strategy ('source',
    'target'); otherwise the target's. A record without a baseline is merged against an empty one. If
    both sides have a column extras, it follows the source where any property came from there, else the
    target. If both have kind, the target's stays unless empty, and kind_mismatch tells that they differ.
    """
    if strategy not in ("source", "target"):
        raise ValueError(strategy)
    more = [c for c in ("extras", "kind") if c in source.columns and c in target.columns]
    as_ = lambda df, p, cs: df.select("uid", *(F.col(c).alias(f"{p}_{c}") for c in cs))
    rows = as_(source, "s", properties + more).join(as_(target, "t", properties + more), "uid").join(as_(baseline, "b", properties), "uid", "left")
    differs = lambda side, c: ~F.col(f"{side}_{c}").eqNullSafe(F.col(f"b_{c}"))
    listed = lambda side: F.concat_ws(",", *(F.when(differs(side, c), c) for c in properties))
    taken = {c: differs("s", c) if strategy == "source" else differs("s", c) & ~differs("t", c) for c in properties}
    merged = [F.when(taken[c], F.col(f"s_{c}")).otherwise(F.col(f"t_{c}")).alias(c) for c in properties]
    if "extras" in more:
        merged.append(F.when(F.array_contains(F.array(*taken.values()), True), F.col("s_extras")).otherwise(F.col("t_extras")).alias("extras"))
    if "kind" in more:
        s, t = (F.nullif(F.col(c), F.lit("")) for c in ("s_kind", "t_kind"))
        merged += [F.coalesce(t, s).alias("kind"), F.coalesce(s != t, F.lit(False)).alias("kind_mismatch")]
    return rows.select("uid", listed("s").alias("changed_source"), listed("t").alias("changed_target"), *merged)


def canonical_digest(json: Column) -> Column:
    """SHA-256 of a JSON value with sorted keys; null for text that is no JSON."""
    return F.sha2(F.to_json(F.try_parse_json(json)), 256)


def records_for_entity(links: DataFrame) -> DataFrame:
    """entity, domain, record in order (links: domain, record, entity)."""
    return links.select("entity", "domain", "record").orderBy("entity", "domain", "record")


def emails_for_entity(index: DataFrame) -> DataFrame:
    """entity, email in order (index: email, entity)."""
    return index.select("entity", F.lower("email").alias("email")).distinct().orderBy("entity", "email")


def unlink(links: DataFrame, index: DataFrame, gone: DataFrame) -> tuple[DataFrame, DataFrame]:
    """links without the given records (domain, record), and the index without the addresses of entities left empty."""
    left = links.join(gone.select("domain", "record"), ["domain", "record"], "left_anti")
    return left, index.join(left.select("entity").distinct(), "entity", "left_semi")


def _fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Arrivals sorted by component and order, each linked in turn; what is remembered is one component's addresses and records."""
    component, index, held = None, {}, {}
    names = ["seq", "domain", "record", "entity", "name", "addresses"]
    for batch in batches:
        out: dict[str, list] = {c: [] for c in names}
        for r in batch.to_pylist():
            if r["component"] != component:
                component, index, held = r["component"], {}, {}
            key, known = (r["domain"], r["record"]), {x["address"]: x["entity"] for x in r["known"] if x["entity"] is not None}
            entity, name = held.get(key, (r["linked"], r["linked_name"]))
            entity = next((e for a in r["addresses"] if (e := index.get(a, known.get(a)))), entity) or r["fresh"]
            name = r["name"] or name
            held[key] = (entity, name)
            index.update(dict.fromkeys(r["addresses"], entity))
            for c, v in zip(names, (r["seq"], *key, entity, name, r["addresses"]), strict=True):
                out[c].append(v)
        kinds = [pa.int64(), *[pa.string()] * 4, pa.list_(pa.string())]
        yield pa.RecordBatch.from_arrays([pa.array(out[c], k) for c, k in zip(names, kinds, strict=True)], names=names)


def link_arrivals(arrivals: DataFrame, links: DataFrame, index: DataFrame, run: str = "") -> tuple[DataFrame, DataFrame, DataFrame]:
    """Records linked one after another to stored entities: (seq, domain, record, entity) of the arrivals, the new links, the new index.

    arrivals: seq (unique), domain, record, emails (array), name; links: domain, record, entity, name; index: email, entity.
    In order of seq each arrival takes the entity of its first address, in sorted order, that has one; else
    the one it is linked to already; else a new one, named by a digest of run, domain, record and seq. All its addresses
    then belong to that entity, taken from another if need be; two entities are never merged. An empty name does not
    replace one that is stored. Arrivals without domain or record are passed over.

    Arrivals that share no address and no record, directly or over others, can't touch each other: they are cut into components, and each is
    folded in order as its rows stream by, so components run apart and none is held as a whole.
    """
    address = lambda e: F.array_distinct(F.transform(F.array_sort(F.array_distinct(F.filter(e, lambda x: F.coalesce(x, F.lit("")) != ""))), F.lower))
    rows = arrivals.where("coalesce(domain, '') <> '' and coalesce(record, '') <> ''").select("seq", "domain", "record", F.coalesce(F.nullif(F.col("name"), F.lit("")), F.lit(None).cast("string")).alias("name"), address(F.coalesce("emails", F.array().cast("array<string>"))).alias("addresses"))
    rows = written(rows)
    keys = F.concat(F.array(F.concat(F.lit("r"), F.octet_length("domain").cast("string"), F.lit(":"), "domain", "record")), F.transform("addresses", lambda a: F.concat(F.lit("a"), a)))
    each = rows.select(F.col("seq").alias("a"), F.explode(keys).alias("key"))
    hubs = each.groupBy("key").agg(F.min("a").alias("b"))
    found = components(each.join(hubs, "key").select("a", "b"))
    stored = index.groupBy(F.lower("email").alias("address")).agg(F.min("entity").alias("entity"))
    known = rows.select("seq", F.explode("addresses").alias("address")).join(stored, "address").groupBy("seq").agg(F.collect_list(F.struct("address", "entity")).alias("known"))  # a record's own addresses
    linked = links.select("domain", "record", F.col("entity").alias("linked"), F.col("name").alias("linked_name"))
    fresh = F.concat(F.lit("ent-"), F.substring(F.sha2(F.concat_ws("\x01", F.lit(run), "domain", "record", F.col("seq").cast("string")), 256), 1, 32))
    met = rows.join(found.select(F.col("node").alias("seq"), "component"), "seq", "left").join(known, "seq", "left").join(linked, ["domain", "record"], "left")
    none = F.array().cast("array<struct<address: string, entity: string>>")
    ready = met.select(F.coalesce("component", "seq").alias("component"), "seq", "domain", "record", "name", "addresses", F.coalesce("known", none).alias("known"), "linked", "linked_name", fresh.alias("fresh"))
    folded = ready.repartition("component").sortWithinPartitions("component", "seq").mapInArrow(_fold, "seq long, domain string, record string, entity string, name string, addresses array<string>")
    folded = written(folded)
    new_links = upsert(links.select("domain", "record", "entity", "name"), folded.select("domain", "record", "entity", "name", "seq"), ["domain", "record"], "seq")
    emails = folded.select("seq", "entity", F.explode("addresses").alias("email"))
    new_index = upsert(index.select(F.lower("email").alias("email"), "entity"), emails, ["email"], "seq")
    return folded.select("seq", "domain", "record", "entity"), new_links, new_index
