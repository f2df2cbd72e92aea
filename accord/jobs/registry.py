"""The registered queries over the derived collections, and the same in SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from accord.functions import text
from accord.jobs import deeper, records, wider, wider_sql
from accord.operators import identity, logs, reconcile, topology
from accord.sources import derived


def _diff(spark, d):
    return reconcile.three_way_diff(*derived.collections(spark, d))


def _plan(spark, d, policy="newest"):
    return reconcile.resolve(_diff(spark, d), policy)


def _baseline_log(spark, d):
    old = derived.log(spark, d).where(F.col("datetime") < F.lit("2024-01-10").cast("timestamp"))
    return logs.newest(old, "uid").select("uid", "value", F.col("datetime").alias("written_at"))


def _merged_properties(spark, d):
    log = derived.property_log(spark, d)
    order = identity.Window.partitionBy("uid").orderBy(F.desc("datetime"), F.asc("app_id"), F.asc("seq"))
    old = log.where(F.col("datetime") < F.lit("2024-01-10").cast("timestamp")).withColumn("place", F.rank().over(order)).where("place = 1")
    return logs.merge_properties(log, old.select("uid", "property", "value"))


def _applied(spark, d):
    source, target, _ = derived.collections(spark, d)
    plan = _plan(spark, d, "source").where("side = 'target'")
    return reconcile.apply_plan(target, plan, source).select("mapping_id", "id", "data")


def _bindings(spark, d):
    s = derived.table(spark, d, "supplier")
    rows = s.select(F.col("s_nationkey").alias("calendar"), F.col("s_suppkey").alias("backend")).withColumn("position", F.row_number().over(identity.Window.partitionBy("calendar").orderBy("backend")) - 1)
    return rows.withColumn("role", F.when(F.col("position") == 0, "primary").otherwise("sync1"))


QUERIES = {
    "j1_three_way_diff": lambda s, d: _diff(s, d).select("mapping_id", "id", "direction", "op"),
    "j2_sync_diff": lambda s, d: reconcile.sync_diff(*derived.collections(s, d)),
    "j3_quick_diff": lambda s, d: reconcile.quick_diff(*derived.collections(s, d)[:2]),
    "j5_adopt_baselines": lambda s, d: reconcile.adopt_baselines(*derived.collections(s, d)),
    "j9_first_sync_plan": lambda s, d: reconcile.first_sync_plan(*derived.collections(s, d)[:2]),
    "j11_mirror_a_to_b": lambda s, d: reconcile.mirror_a_to_b(_diff(s, d)),
    "j13_apply_plan": _applied,
    "c1_resolve_newest": lambda s, d: _plan(s, d),
    "a1_sync_stats": lambda s, d: reconcile.sync_stats(_plan(s, d)),
    "a2_collection_digest": lambda s, d: reconcile.collection_digest(derived.collections(s, d)[0]),
    "a2_bucketed_digest": lambda s, d: reconcile.bucketed_digest(derived.collections(s, d)[0]),
    "a5_mass_delete_guard": lambda s, d: reconcile.mass_delete_guard(_plan(s, d), derived.collections(s, d)[2]),
    "a9_compact_log": lambda s, d: logs.compact_log(derived.log(s, d), _baseline_log(s, d).select("uid", "written_at")),
    "a10_app_activity": lambda s, d: logs.app_activity(derived.log(s, d), "2024-01-20"),
    "a12_merge_writers": lambda s, d: logs.merge_writers(derived.log(s, d), _baseline_log(s, d)),
    "a12_merge_properties": _merged_properties,
    "a14_link_entities": lambda s, d: identity.link_entities(derived.contacts(s, d)),
    "j21_event_roster": lambda s, d: identity.event_roster(derived.people(s, d), e := derived.contacts(s, d), identity.link_entities(e)),
    "c7_canon_merge": lambda s, d: identity.canon_merge(*derived.canon(s, d), ["body", "category"]),
    "c7_canon_merge_whole": lambda s, d: identity.canon_merge(*derived.canon(s, d), ["body", "category"], "target"),
    "w1_latest_state": lambda s, d: logs.latest_state(derived.log(s, d)),
    "w2_latest_per_writer": lambda s, d: logs.latest_per_writer(derived.log(s, d)),
    "w5_merge_families": lambda s, d: logs.merge_families(*derived.families(s, d)),
    "p8_dedupe_last": lambda s, d: reconcile.dedupe_last(derived.log(s, d), ["uid"], "seq"),
    "f19_slug": lambda s, d: derived.table(s, d, "pages").select("page_id", text.slug(F.col("url")).alias("slug")),
    "f3_canonical_digest": lambda s, d: derived.table(s, d, "events").select("event_id", identity.canonical_digest(F.col("props")).alias("digest")),
    "u4_star_mappings": lambda s, d: topology.generate_mappings(_bindings(s, d), "star").drop("id"),
    "u4_mirror_mappings": lambda s, d: topology.generate_mappings(_bindings(s, d), "mirror").drop("id"),
    "w6_chain_mappings": lambda s, d: topology.generate_mappings(_bindings(s, d), "chain").drop("id"),
    **records.QUERIES,
    **wider.QUERIES,
    **deeper.QUERIES,
}

_COLLECTIONS = """
WITH o AS (SELECT *, CASE WHEN o_orderkey % 7 = 0 THEN 'S' ELSE o_orderstatus END AS st, CASE WHEN o_orderkey % 5 = 0 THEN 'T' ELSE o_orderstatus END AS tt FROM orders),
source AS (SELECT 'm' || (o_orderkey % 8) AS mapping_id, o_orderkey AS id, 'UID:' || o_orderkey || ';STATUS:' || st AS data, sha256(o_orderkey || '|' || st || '|' || o_orderpriority) AS hash,
  o_orderdate + to_days(CASE WHEN o_orderkey % 7 = 0 THEN 2 ELSE 0 END) AS lm FROM o WHERE o_orderkey % 11 <> 0),
target AS (SELECT 'm' || (o_orderkey % 8) AS mapping_id, o_orderkey AS id, 'UID:' || o_orderkey || ';STATUS:' || tt AS data, sha256(o_orderpriority || '|' || tt || '|' || o_orderkey) AS hash,
  o_orderdate + to_days(CASE WHEN o_orderkey % 5 = 0 THEN CAST(o_orderkey % 3 AS INTEGER) ELSE 0 END) AS lm FROM o WHERE o_orderkey % 13 <> 0),
baseline AS (SELECT 'm' || (o_orderkey % 8) AS mapping_id, o_orderkey AS id, 'UID:' || o_orderkey || ';STATUS:' || o_orderstatus AS data, sha256(o_orderkey || '|' || o_orderstatus || '|' || o_orderpriority) AS sh,
  sha256(o_orderpriority || '|' || o_orderstatus || '|' || o_orderkey) AS th FROM o WHERE o_orderkey % 10 <> 9),
j AS (SELECT coalesce(s.mapping_id, t.mapping_id, b.mapping_id) AS mapping_id, coalesce(s.id, t.id, b.id) AS id, s.id IS NOT NULL AS s, t.id IS NOT NULL AS t, b.id IS NOT NULL AS b,
  s.data AS sd, t.data AS td, b.data AS bd, s.hash AS shash, t.hash AS thash, s.lm AS slm, t.lm AS tlm, coalesce(s.hash <> b.sh, true) AS sc, coalesce(t.hash <> b.th, true) AS tc
  FROM source s FULL JOIN target t ON s.id = t.id FULL JOIN baseline b ON b.id = coalesce(s.id, t.id)),
diff AS (SELECT *, CASE
  WHEN s AND t AND b THEN CASE WHEN sc AND tc THEN 'conflict' WHEN sc OR tc THEN 'update' END
  WHEN t AND b THEN CASE WHEN tc THEN 'conflict' ELSE 'delete' END
  WHEN s AND b THEN CASE WHEN sc THEN 'conflict' ELSE 'delete' END
  WHEN s AND NOT t THEN 'create' WHEN t AND NOT s THEN 'create' WHEN s AND t AND sd <> td THEN 'conflict' END AS op,
  CASE WHEN s AND t AND b AND tc AND NOT sc THEN 'to_source' WHEN s AND b AND NOT t AND NOT sc THEN 'to_source' WHEN t AND NOT s AND NOT b THEN 'to_source' ELSE 'to_target' END AS direction FROM j),
plan AS (SELECT mapping_id, id, CASE WHEN op <> 'conflict' THEN replace(direction, 'to_', '') WHEN w THEN 'target' ELSE 'source' END AS side,
  CASE WHEN op <> 'conflict' THEN op WHEN NOT (CASE WHEN w THEN s ELSE t END) THEN 'delete' WHEN NOT (CASE WHEN w THEN t ELSE s END) THEN 'create' ELSE 'update' END AS action
  FROM (SELECT *, coalesce(slm, TIMESTAMP '0001-01-01') > coalesce(tlm, TIMESTAMP '0001-01-01') AS w FROM diff WHERE op IS NOT NULL))
"""
_LOG = """
WITH log AS (SELECT user_id AS uid, 'app' || (event_id % 4) AS app_id, ts AS datetime, event_id AS seq,
  CASE WHEN event_type = 'error' OR user_id % 25 = 0 THEN NULL ELSE event_type END AS value FROM events
  WHERE NOT (user_id % 25 = 1 AND event_id % 4 <> 0)),
per AS (SELECT * FROM log QUALIFY row_number() OVER (PARTITION BY app_id, uid ORDER BY datetime DESC, app_id, seq) = 1),
base AS (SELECT uid, value, datetime AS written_at FROM log WHERE datetime < TIMESTAMP '2024-01-10' QUALIFY row_number() OVER (PARTITION BY uid ORDER BY datetime DESC, app_id, seq) = 1)
"""
_CONTACTS = """
WITH RECURSIVE edges AS (SELECT DISTINCT c_custkey AS record, 'c' || n || '@example.com' AS email FROM (
  SELECT c_custkey, c_custkey AS n FROM customer UNION ALL SELECT c_custkey, c_custkey - 1 FROM customer WHERE c_custkey % 10 = 1 OR c_custkey % 50 = 2
  UNION ALL SELECT c_custkey, c_custkey - 2 FROM customer WHERE c_custkey % 50 = 2)),
links AS (SELECT DISTINCT a.record AS a, b.record AS b FROM edges a JOIN edges b USING (email)),
reach AS (SELECT a, b FROM links UNION SELECT r.a, l.b FROM reach r JOIN links l ON r.b = l.a),
entities AS (SELECT a AS record, min(b) AS entity FROM reach GROUP BY a)
"""
_BINDINGS = "WITH b AS (SELECT s_nationkey AS calendar, s_suppkey AS backend, row_number() OVER (PARTITION BY s_nationkey ORDER BY s_suppkey) - 1 AS position FROM supplier) "

SQL = {
    "j1_three_way_diff": _COLLECTIONS + "SELECT mapping_id, id, direction, op FROM diff WHERE op IS NOT NULL",
    "j2_sync_diff": _COLLECTIONS + """SELECT mapping_id, id, CASE WHEN sd IS NOT DISTINCT FROM td OR (sd IS NOT DISTINCT FROM bd AND td IS NOT DISTINCT FROM bd) THEN 'unchanged'
      WHEN sd IS DISTINCT FROM bd AND td IS DISTINCT FROM bd THEN 'conflict_' || CASE WHEN NOT b THEN 'both_created' WHEN NOT s OR NOT t THEN 'modify_delete' ELSE 'both_modified' END
      WHEN sd IS DISTINCT FROM bd THEN CASE WHEN NOT s THEN 'delete' WHEN NOT t THEN 'create' ELSE 'update' END || '_target'
      ELSE CASE WHEN NOT t THEN 'delete' WHEN NOT s THEN 'create' ELSE 'update' END || '_source' END AS outcome FROM j""",
    "j3_quick_diff": _COLLECTIONS + "SELECT mapping_id, id, CASE WHEN NOT t THEN 'create_target' WHEN NOT s THEN 'create_source' WHEN sd = td THEN 'unchanged' ELSE 'conflict_both_created' END AS outcome FROM j WHERE s OR t",
    "j5_adopt_baselines": _COLLECTIONS + "SELECT mapping_id, id, shash AS source_hash, thash AS target_hash FROM j WHERE s AND t AND NOT b AND sd = td",
    "j9_first_sync_plan": _COLLECTIONS + "SELECT mapping_id, id, CASE WHEN NOT t THEN 'create' WHEN NOT s THEN 'delete' ELSE 'update' END AS action FROM j WHERE (s OR t) AND (NOT s OR NOT t OR shash <> thash)",
    "j11_mirror_a_to_b": _COLLECTIONS + """SELECT * FROM (SELECT mapping_id, id, CASE WHEN direction = 'to_target' AND op = 'conflict' THEN CASE WHEN s THEN 'update' ELSE 'delete' END
      WHEN direction = 'to_target' THEN op WHEN op = 'create' THEN 'delete' END AS action FROM diff) WHERE action IS NOT NULL""",
    "j13_apply_plan": _COLLECTIONS + """, p AS (SELECT id, CASE WHEN op <> 'conflict' THEN op WHEN NOT s THEN 'delete' ELSE 'write' END AS action FROM diff WHERE op IS NOT NULL AND (op = 'conflict' OR direction = 'to_target'))
      SELECT mapping_id, id, data FROM target WHERE id NOT IN (SELECT id FROM p) UNION ALL SELECT mapping_id, id, data FROM source WHERE id IN (SELECT id FROM p WHERE action <> 'delete')""",
    "c1_resolve_newest": _COLLECTIONS + "SELECT mapping_id, id, side, action FROM plan",
    "a1_sync_stats": _COLLECTIONS + "SELECT mapping_id, side, count(*) FILTER (action = 'create') AS created, count(*) FILTER (action = 'update') AS updated, count(*) FILTER (action = 'delete') AS deleted FROM plan GROUP BY ROLLUP (mapping_id, side)",
    "a2_collection_digest": _COLLECTIONS + "SELECT mapping_id, sha256(string_agg(id || chr(31) || hash || chr(30), '' ORDER BY CAST(id AS VARCHAR))) AS digest FROM source GROUP BY mapping_id",
    "a2_bucketed_digest": _COLLECTIONS + """, leaves AS (SELECT mapping_id, left(sha256(CAST(id AS VARCHAR)), 4) AS bucket, sha256(string_agg(id || chr(31) || hash || chr(30), '' ORDER BY CAST(id AS VARCHAR))) AS digest FROM source GROUP BY 1, 2)
      SELECT mapping_id, sha256(string_agg(bucket || chr(31) || digest || chr(30), '' ORDER BY bucket)) AS digest FROM leaves GROUP BY mapping_id""",
    "a5_mass_delete_guard": _COLLECTIONS + """SELECT mapping_id, deletes, baselines, deletes > 10 OR (baselines > 0 AND deletes * 100 // baselines > 25) AS tripped
      FROM (SELECT mapping_id, count(*) FILTER (action = 'delete') AS deletes FROM plan GROUP BY 1) JOIN (SELECT mapping_id, count(*) AS baselines FROM baseline GROUP BY 1) USING (mapping_id)""",
    "a9_compact_log": _LOG + "SELECT uid, app_id, datetime, seq, per.value AS value FROM per LEFT JOIN base USING (uid) WHERE written_at IS NULL OR written_at <= datetime",
    "a10_app_activity": _LOG + "SELECT app_id, max(datetime) AS last_seen, count(*) AS entries, max(datetime) < TIMESTAMP '2024-01-20' AS inactive FROM log GROUP BY app_id",
    "a12_merge_writers": _LOG + """, f AS (SELECT per.uid, count(per.value) AS writers, count(DISTINCT per.value) FILTER (per.value IS DISTINCT FROM base.value) AS changes, bool_or(base.uid IS NOT NULL) AS known,
      first(per.value ORDER BY datetime DESC, app_id, seq) FILTER (per.value IS NOT NULL) AS newest,
      first(per.value ORDER BY datetime DESC, app_id, seq) FILTER (per.value IS NOT NULL AND per.value IS DISTINCT FROM base.value) AS newest_change FROM per LEFT JOIN base USING (uid) GROUP BY per.uid),
      g AS (SELECT *, CASE WHEN writers = 0 THEN CASE WHEN known THEN 'deletion' END WHEN writers = 1 OR NOT known OR changes = 0 THEN 'unchanged' WHEN changes = 1 THEN 'merged' ELSE 'conflict' END AS outcome FROM f)
      SELECT uid, outcome, CASE outcome WHEN 'deletion' THEN NULL WHEN 'unchanged' THEN newest ELSE newest_change END AS value FROM g WHERE outcome IS NOT NULL""",
    "a12_merge_properties": _LOG + """, old AS (SELECT * FROM log WHERE datetime < TIMESTAMP '2024-01-10' QUALIFY row_number() OVER (PARTITION BY uid ORDER BY datetime DESC, app_id, seq) = 1),
      live AS (SELECT *, row_number() OVER (PARTITION BY uid ORDER BY datetime DESC, app_id, seq) AS place FROM per WHERE value IS NOT NULL),
      p AS (SELECT uid, place, 'kind' AS property, value FROM live UNION ALL SELECT uid, place, 'place', 'room' || (seq % 3) FROM live UNION ALL SELECT uid, place, 'note', 'n' || app_id FROM live WHERE seq % 5 = 0),
      b AS (SELECT uid, 'kind' AS property, value FROM old WHERE value IS NOT NULL UNION ALL SELECT uid, 'place', 'room' || (seq % 3) FROM old WHERE value IS NOT NULL UNION ALL SELECT uid, 'note', 'n' || app_id FROM old WHERE value IS NOT NULL AND seq % 5 = 0),
      k AS (SELECT uid, property FROM p UNION SELECT uid, property FROM b),
      c AS (SELECT live.uid, k.property, live.place, coalesce(p.value, '') AS v FROM live JOIN k ON k.uid = live.uid LEFT JOIN p ON p.uid = live.uid AND p.place = live.place AND p.property = k.property
        LEFT JOIN b ON b.uid = k.uid AND b.property = k.property WHERE coalesce(p.value, '') <> coalesce(b.value, '')),
      w AS (SELECT uid, property, count(DISTINCT v) AS changes, arg_min(v, place) AS v FROM c GROUP BY 1, 2),
      o AS (SELECT u.uid, CASE WHEN n.writers IS NULL THEN CASE WHEN old.uid IS NOT NULL THEN 'deletion' END WHEN n.writers = 1 OR old.uid IS NULL OR m.most IS NULL THEN 'unchanged' WHEN m.most = 1 THEN 'merged' ELSE 'conflict' END AS outcome
        FROM (SELECT DISTINCT uid FROM per) u LEFT JOIN (SELECT uid, count(*) AS writers FROM live GROUP BY 1) n ON n.uid = u.uid LEFT JOIN old ON old.uid = u.uid LEFT JOIN (SELECT uid, max(changes) AS most FROM w GROUP BY 1) m ON m.uid = u.uid),
      r AS (SELECT k.uid, k.property, CASE WHEN o.outcome <> 'unchanged' AND w.uid IS NOT NULL THEN w.v ELSE p.value END AS value FROM k JOIN o ON o.uid = k.uid
        LEFT JOIN w ON w.uid = k.uid AND w.property = k.property LEFT JOIN p ON p.uid = k.uid AND p.property = k.property AND p.place = 1 WHERE o.outcome <> 'deletion')
      SELECT o.uid, o.outcome, r.property, r.value FROM o LEFT JOIN (SELECT * FROM r WHERE value <> '') r ON r.uid = o.uid WHERE o.outcome IS NOT NULL""",
    "a14_link_entities": _CONTACTS + "SELECT record, entity FROM entities",
    "j21_event_roster": _CONTACTS + """, people AS (SELECT o_orderkey AS event, unnest([0, 1, 2]) AS position, unnest(['c' || o_custkey || '@example.com', 'c' || (o_custkey + 1) || '@example.com', 'x' || o_custkey || '@example.com']) AS email FROM orders)
      SELECT event, CAST(position AS INTEGER) AS position, email, i.entity AS entity FROM people LEFT JOIN (SELECT email, min(entity) AS entity FROM edges JOIN entities USING (record) GROUP BY email) i USING (email)""",
    "c7_canon_merge": """WITH x AS (SELECT doc_id AS uid, text AS body, lang AS category, doc_id % 7 = 0 AS s, doc_id % 5 = 0 AND lang <> 'changed' AS tc, doc_id % 35 = 0 AS tb FROM documents)
      SELECT uid, CASE WHEN s THEN 'body' ELSE '' END AS changed_source, concat_ws(',', CASE WHEN tb THEN 'body' END, CASE WHEN tc THEN 'category' END) AS changed_target,
      CASE WHEN s THEN 's' || body WHEN tb THEN 't' || body ELSE body END AS body, CASE WHEN tc THEN 'changed' ELSE category END AS category FROM x""",
    "c7_canon_merge_whole": """WITH x AS (SELECT doc_id AS uid, text AS body, lang AS category, doc_id % 7 = 0 AS s, doc_id % 5 = 0 AND lang <> 'changed' AS tc, doc_id % 35 = 0 AS tb FROM documents)
      SELECT uid, CASE WHEN s THEN 'body' ELSE '' END AS changed_source, concat_ws(',', CASE WHEN tb THEN 'body' END, CASE WHEN tc THEN 'category' END) AS changed_target,
      CASE WHEN tb THEN 't' || body WHEN s THEN 's' || body ELSE body END AS body, CASE WHEN tc THEN 'changed' ELSE category END AS category FROM x""",
    "w1_latest_state": _LOG + "SELECT * FROM (SELECT * FROM log QUALIFY row_number() OVER (PARTITION BY uid ORDER BY datetime DESC, app_id, seq) = 1) WHERE value IS NOT NULL",
    "w2_latest_per_writer": _LOG + "SELECT * FROM per",
    "w5_merge_families": """WITH r AS (SELECT conv_id AS uid, CASE WHEN turn = 0 THEN '' ELSE lpad(CAST(turn AS VARCHAR), 6, '0') END AS slot, CASE WHEN conv_id % 3 = 0 AND turn % 2 = 1 THEN 'staged-' || role ELSE role END AS data FROM conversations)
      SELECT uid, slot, data, CAST(row_number() OVER (PARTITION BY uid ORDER BY slot) AS INTEGER) AS position FROM r""",
    "p8_dedupe_last": _LOG + "SELECT * FROM log QUALIFY row_number() OVER (PARTITION BY uid ORDER BY seq DESC) = 1",
    "f19_slug": "SELECT page_id, regexp_replace(regexp_replace(lower(url), '[-_ ]', '-', 'g'), '[^\\p{L}\\p{N}-]', '', 'g') AS slug FROM pages",
    "f3_canonical_digest": "SELECT event_id, sha256(replace(props, ' ', '')) AS digest FROM events",
    "u4_star_mappings": _BINDINGS + "SELECT x.calendar, x.backend AS first, y.backend AS second FROM b x JOIN b y USING (calendar) WHERE x.position = 0 AND y.position > 0",
    "u4_mirror_mappings": _BINDINGS + "SELECT x.calendar, x.backend AS first, y.backend AS second FROM b x JOIN b y USING (calendar) WHERE x.position < y.position",
    "w6_chain_mappings": _BINDINGS + "SELECT x.calendar, x.backend AS first, y.backend AS second FROM b x JOIN b y USING (calendar) WHERE x.position + 1 = y.position",
    **records.sql(_COLLECTIONS),
    **wider_sql.sql(_COLLECTIONS, _LOG, _CONTACTS),
    **deeper.sql(_COLLECTIONS, _LOG),
}
