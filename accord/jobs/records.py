"""Queries on aliases, state tables, decisions and text functions over the derived collections, and the same in SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from accord.functions import text
from accord.operators import aliases, conflicts, reconcile
from accord.sources import derived


def _diff(spark, d):
    return reconcile.three_way_diff(*derived.collections(spark, d))


def _identity_conflicts(spark, d):
    """Creates towards both sides whose payloads agree but for their uid."""
    creates = _diff(spark, d).where("op = 'create'")
    side = lambda direction, data: creates.where(F.col("direction") == direction).select("mapping_id", "id", F.sha2(F.regexp_extract(data, "STATUS:(.*)", 1), 256).alias("digest"))
    return aliases.identity_conflicts(side("to_target", "s_data"), side("to_source", "t_data"), "mapping_id")


def _resolved(spark, d):
    source = derived.collections(spark, d)[0].select("mapping_id", "id", "data")
    known = source.where("id % 3 = 0").select("mapping_id", F.col("id").alias("native_id"), (F.col("id") + 8).alias("canonical_id"))
    return aliases.resolve_ids(source, known, "mapping_id", "id")


def _healed(spark, d):
    """Chains of ten ids; those of every tenth block run in a circle."""
    k = F.col("o_orderkey")
    ring = F.when(F.floor(k / 10) % 10 == 0, k - 9)
    rows = derived.table(spark, d, "orders").select(F.lit("m").alias("mapping_id"), k.alias("native_id"), F.when(k % 10 == 9, ring).otherwise(k + 1).alias("canonical_id"))
    return aliases.heal_aliases(rows.where("canonical_id is not null"), "mapping_id").select("native_id", "canonical_id")


def _upserted(spark, d):
    source, _, baseline = derived.collections(spark, d)
    return aliases.upsert(baseline.select("mapping_id", "id", "data"), source.where("id % 7 = 0"), ["mapping_id", "id"])


def _classified(spark, d):
    source, target, _ = derived.collections(spark, d)
    return conflicts.classify_writes(source.select("mapping_id", "id", (F.col("id") % 9 == 0).alias("deleted")), target).select("mapping_id", "id", "action")


def _next_pass(spark, d):
    m = derived.table(spark, d, "supplier").select(F.col("s_suppkey").alias("mapping_id"), F.col("s_nationkey").cast("long").alias("source"), (F.col("s_suppkey") % 40 + 100).cast("long").alias("target"))
    return aliases.next_pass(m, m.where("mapping_id % 4 = 0").select("mapping_id", F.col("target").alias("endpoint")))


def _properties(spark, d):
    return [df.select(F.col("id").alias("uid"), F.lit("data").alias("property"), F.col("data").alias("value")) for df in derived.collections(spark, d)]


QUERIES = {
    "j4_identity_conflicts": _identity_conflicts,
    "j6_resolve_ids": _resolved,
    "j7_heal_aliases": _healed,
    "s7_upsert": _upserted,
    "j12_classify_writes": _classified,
    "j17_next_pass": _next_pass,
    "c16_handle_conflicts": lambda s, d: conflicts.handle_conflicts(_diff(s, d), "newest", "delete").drop("resolved_by"),
    "c12_property_diff": lambda s, d: conflicts.property_diff(*_properties(s, d)),
    "j18_map_diff": lambda s, d: conflicts.map_diff(*_properties(s, d)),
    "f20_css_to_argb": lambda s, d: derived.table(s, d, "customer").select("c_custkey", text.css_to_argb(F.format_string("#%06x", F.col("c_custkey") * 7919 % 16777216)).alias("argb")),
    "f6_record_identity": lambda s, d: derived.table(s, d, "events").select("event_id", text.compose_identity(F.col("user_id").cast("string"), F.col("ts")).alias("identity")),
    "f19_dav_slug": lambda s, d: derived.table(s, d, "pages").select("page_id", text.dav_slug(F.col("url")).alias("slug")),
}


def sql(collections: str) -> dict[str, str]:
    """The queries in SQL; collections begins those on the derived collections."""
    return {
        "j4_identity_conflicts": collections + """, cs AS (SELECT mapping_id, sha256(split_part(sd, 'STATUS:', 2)) AS digest, min(id) AS source_id FROM diff WHERE op = 'create' AND direction = 'to_target' GROUP BY 1, 2),
          ct AS (SELECT mapping_id, sha256(split_part(td, 'STATUS:', 2)) AS digest, min(id) AS target_id FROM diff WHERE op = 'create' AND direction = 'to_source' GROUP BY 1, 2)
          SELECT mapping_id, digest, source_id, target_id FROM cs JOIN ct USING (mapping_id, digest)""",
        "j6_resolve_ids": collections + "SELECT mapping_id, CASE WHEN id % 3 = 0 THEN id + 8 ELSE id END AS id, data FROM source",
        "j7_heal_aliases": """WITH k AS (SELECT o_orderkey AS k, o_orderkey // 10 AS b, max(o_orderkey) OVER () AS m FROM orders)
          SELECT k AS native_id, CASE WHEN b % 10 = 0 AND b * 10 + 9 <= m THEN b * 10 ELSE least(b * 10 + 9, m + 1) END AS canonical_id FROM k WHERE k % 10 <> 9 OR b % 10 = 0""",
        "s7_upsert": collections + "SELECT mapping_id, id, data FROM baseline WHERE id NOT IN (SELECT id FROM source WHERE id % 7 = 0) UNION ALL SELECT mapping_id, id, data FROM source WHERE id % 7 = 0",
        "j12_classify_writes": collections + "SELECT mapping_id, id, CASE WHEN id % 9 = 0 THEN 'delete' WHEN id IN (SELECT id FROM target) THEN 'update' ELSE 'create' END AS action FROM source",
        "j17_next_pass": """WITH m AS (SELECT s_suppkey AS mapping_id, s_nationkey AS source, s_suppkey % 40 + 100 AS target FROM supplier)
          SELECT DISTINCT m.mapping_id FROM m JOIN m w ON w.target IN (m.source, m.target) AND w.mapping_id <> m.mapping_id WHERE w.mapping_id % 4 = 0""",
        "c16_handle_conflicts": collections + """SELECT mapping_id, id, CASE WHEN sd IS NULL OR td IS NULL THEN 'complex' ELSE 'simple' END AS complexity,
          CASE WHEN sd IS NULL OR td IS NULL THEN 'defer' WHEN slm > tlm THEN 'source' ELSE 'target' END AS decision FROM diff WHERE op = 'conflict'""",
        "c12_property_diff": collections + """SELECT id AS uid, 'data' AS property, CASE WHEN td IS NULL THEN 'only_source' WHEN sd IS NULL THEN 'only_target' WHEN bd IS NULL THEN 'both_different'
          WHEN sd = bd THEN 'use_target' WHEN td = bd THEN 'use_source' ELSE 'both_changed' END AS state FROM j WHERE sd IS DISTINCT FROM td""",
        "j18_map_diff": collections + """SELECT id AS uid, 'data' AS property, CASE WHEN td IS NOT DISTINCT FROM bd THEN 'to_target' WHEN sd IS NOT DISTINCT FROM bd THEN 'to_source' ELSE 'conflict' END AS outcome
          FROM j WHERE sd IS DISTINCT FROM td""",
        "f20_css_to_argb": "SELECT c_custkey, '#FF' || printf('%06X', CAST(c_custkey * 7919 % 16777216 AS BIGINT)) AS argb FROM customer",
        "f6_record_identity": "SELECT event_id, user_id || chr(1) || strftime(ts, '%Y-%m-%dT%H:%M:%SZ') AS identity FROM events",
        "f19_dav_slug": "SELECT page_id, url_decode(regexp_extract(regexp_replace(regexp_replace(regexp_replace(url, '^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*', ''), '[?#].*$', ''), '/+$', ''), '[^/]*$')) AS slug FROM pages",
    }
