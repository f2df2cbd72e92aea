"""The queries of wider.py in SQL."""

from __future__ import annotations

_TASKS = """WITH t AS (SELECT o_orderkey AS id, 'm' || (o_orderkey % 8) AS mapping_id, o_orderstatus AS st, o_orderpriority AS pr, o_orderdate AS lm,
  o_orderkey % 17 <> 0 AND o_orderkey % 19 <> 0 AS ok FROM orders) """
_CALENDAR = "WITH k AS (SELECT o_orderkey AS k, 'o' || o_orderkey AS uid, o_orderstatus AS st, strftime(o_orderdate, '%Y%m%d') AS day FROM orders) "
_INCIDENCES = _CALENDAR + """, x AS (SELECT uid, k, 'STATUS' AS property, CASE WHEN k % 7 = 0 THEN 'A' ELSE st END AS a, CASE WHEN k % 5 = 0 THEN 'B' ELSE st END AS b, st AS base FROM k WHERE k % 4 <> 2
  UNION ALL SELECT uid, k, 'SUMMARY', 'Order ' || k || ' folded', CASE WHEN k % 6 <> 0 THEN 'Order ' || k || ' folded' END, 'Order ' || k || ' folded' FROM k WHERE k % 4 <> 2
  UNION ALL SELECT uid, k, 'TRIGGER', '-PT15M', '-PT15M', '-PT15M' FROM k WHERE k % 4 <> 2) """
_STORE = """WITH st AS (SELECT event_id AS k, 'x' || event_id AS id, CASE WHEN event_id % 15 <> 0 THEN 'm' || (event_id % 4) END AS mapping_id, 'u' || event_id AS uid, ts AS detected_at,
  CASE WHEN event_id % 10 = 0 THEN 'source' END AS decision, event_id % 10 = 0 AS resolved, event_id % 20 = 0 AS applied FROM events WHERE event_id % 5 = 0) """
BINDINGS = """WITH b0 AS (SELECT s_nationkey AS calendar, s_suppkey AS backend, s_suppkey % 2 AS remote, CASE WHEN s_nationkey % 6 <> 0 THEN 'n' || s_nationkey ELSE '' END AS name, s_suppkey % 4 <> 0 AS enabled, CAST(s_suppkey AS INTEGER) AS position,
  CASE WHEN s_suppkey % 9 = 0 THEN 'primary' WHEN s_suppkey % 5 = 0 THEN 'readonly' ELSE 'sync' || (s_suppkey % 7) END AS role FROM supplier),
b AS (SELECT * FROM b0 UNION ALL SELECT calendar, backend, remote, name, enabled, position + 1000, 'sync9' FROM b0 WHERE backend % 3 = 0),
q0 AS (SELECT *, role = 'primary' AND row_number() OVER (PARTITION BY calendar ORDER BY role = 'primary' DESC, position, backend) = 1 AS front FROM b WHERE enabled AND role <> 'readonly'),
q AS (SELECT q0.* FROM q0 LEFT JOIN (SELECT calendar AS c, backend AS p, remote AS r FROM q0 WHERE front) ON c = calendar WHERE front OR p IS NULL OR backend <> p OR remote <> r),
m AS (SELECT *, row_number() OVER (PARTITION BY calendar ORDER BY front DESC, position, backend) AS place FROM q WHERE calendar IN (SELECT calendar FROM q WHERE front)) """
_EDGES = """WITH e AS (SELECT p_partkey AS k, 'e' || (p_partkey % 10) AS edge, 'p' || (p_partkey // 10 % 7) AS property, p_partkey % 4 AS severity FROM part) """
_WRITES = """, w AS (SELECT *, coalesce(slm, TIMESTAMP '0001-01-01') > coalesce(tlm, TIMESTAMP '0001-01-01') AS newer FROM diff WHERE op IS NOT NULL),
  plain AS (SELECT mapping_id, CAST(id AS VARCHAR) AS id, replace(direction, 'to_', '') AS side, op AS action, CASE WHEN op <> 'delete' THEN CASE WHEN direction = 'to_target' THEN sd ELSE td END END AS data, op <> 'delete' AS baseline FROM w WHERE op <> 'conflict') """
_NEWER = """SELECT mapping_id, CAST(id AS VARCHAR) AS id, CASE WHEN wins THEN 'target' ELSE 'source' END AS side,
  CASE WHEN NOT (CASE WHEN wins THEN s ELSE t END) THEN 'delete' WHEN CASE WHEN wins THEN t ELSE s END THEN 'update' ELSE 'create' END AS action,
  CASE WHEN wins THEN sd ELSE td END AS data, CASE WHEN wins THEN s ELSE t END AS baseline FROM (SELECT *, {wins} AS wins FROM w WHERE op = 'conflict')"""


def sql(collections: str, log: str, contacts: str) -> dict[str, str]:
    """The queries; the arguments begin those on collections, on the log and on contacts."""
    return {
        "s3_hub_ids": collections + "SELECT mapping_id AS collection, id || chr(1) || 'x' AS id FROM source",
        "s4_file_names": """WITH x AS (SELECT page_id, url, coalesce(nullif(CASE WHEN page_id % 7 = 0 THEN '' ELSE substr(html, 60, 40) END, ''), url) AS base FROM pages),
          y AS (SELECT *, regexp_replace(regexp_replace(lower(base), '[-_ ]', '-', 'g'), '[^\\p{L}\\p{N}-]', '', 'g') AS slug FROM x)
          SELECT page_id, CASE WHEN slug = '' THEN 'record' ELSE slug END || '-' || left(sha256(url), 8) || ['.md', '.vcf', '.ics', '.ics', '.bin'][page_id % 5 + 1] AS name FROM y""",
        "s5_oplog_entries": """WITH x AS (SELECT event_id AS k, event_type, 'f' || user_id AS f FROM events WHERE event_id % 13 <> 0 AND event_id % 11 <> 0),
          h AS (SELECT *, list_reduce([CAST(0 AS BIGINT)] || [CAST(ascii(c) AS BIGINT) FOR c IN string_split('feeds', '')], lambda a, b: (a * 19 + b) % 256) AS h1,
            list_reduce([CAST(0 AS BIGINT)] || [CAST(ascii(c) AS BIGINT) FOR c IN string_split(f, '')], lambda a, b: (a * 19 + b) % 256) AS h2 FROM x)
          SELECT 'app' || (k % 4) AS app_id, k AS line, 'feeds/' || f AS path, 't' || k AS datetime, '"k' || (k % 10) || '"' AS key, CASE WHEN k % 6 <> 0 THEN '{"a":"' || event_type || '","b":1}' END AS value, printf('%02x', (h1 * 199 + h2) % 256) AS bucket FROM h""",
        "s6_replay_journal": """SELECT user_id % 10 AS entity, 'u' || user_id AS uid, event_type AS op, 'd' || event_id AS data FROM events WHERE event_id % 9 <> 0
          QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) = 1""",
        "s6_discard_prefix": """SELECT entity, seq FROM (SELECT user_id % 10 AS entity, event_id AS seq, row_number() OVER (PARTITION BY user_id % 10 ORDER BY event_id) AS n FROM events) WHERE entity >= 5 OR n > entity * 3""",
        "s8_delete_keys": collections + "SELECT mapping_id, id FROM baseline WHERE NOT (id % 4 = 0 AND id IN (SELECT id FROM source))",
        "s10_readonly_target": collections + "SELECT mapping_id, id, side, action, CASE WHEN mapping_id = 'm3' AND side = 'target' THEN 'withheld' ELSE 'planned' END AS status FROM plan",
        "p3_contains_view": _TASKS + "SELECT id FROM t WHERE ok AND (id % 3 = 1 OR id % 5 = 1)",
        "p3_equals_view": _TASKS + "SELECT id FROM t WHERE ok AND st = 'F'",
        "p4_stamp_filter": _TASKS + """SELECT id, CASE WHEN ok THEN '["c' || (id % 3) || '","c' || (id % 5) || '"' || CASE WHEN id % 3 = 1 OR id % 5 = 1 THEN '' ELSE ',"c1"' END || ']' END AS categories,
          CASE WHEN ok THEN 'Z' END AS status, CASE WHEN id % 17 = 0 THEN '{broken' END AS broken FROM t""",
        "p5_demux": _CALENDAR + "SELECT uid, CASE WHEN k % 4 = 0 THEN 'VEVENT' ELSE 'VTODO' END AS kind FROM k WHERE k % 4 < 2",
        "p6_modified_since": "SELECT o_orderkey AS id FROM orders WHERE o_orderdate > TIMESTAMP '1999-01-01'",
        "p7_feed_window": "SELECT o_orderkey AS id FROM orders WHERE CAST(o_orderdate AS DATE) BETWEEN DATE '1997-06-15' AND DATE '2000-06-15'",
        "p10_materialized_loss": _TASKS + "SELECT mapping_id, id, CASE WHEN st = 'F' THEN 'priority' ELSE 'priority,status' END AS lost FROM t WHERE ok",
        "p11_loss_policy": _TASKS + "SELECT mapping_id, count(*) FILTER (ok) AS lossy, CASE WHEN count(*) FILTER (ok) > 0 THEN ['abort', 'warn', 'proceed'][CAST(substr(mapping_id, 2, 1) AS INTEGER) % 3 + 1] ELSE 'proceed' END AS verdict FROM t GROUP BY mapping_id",
        "p12_emptied": _TASKS + "SELECT mapping_id, bool_or(id % 64 = 3) AS failed FROM t GROUP BY mapping_id",
        "j2_sync_upload": collections + """SELECT mapping_id, id, CASE WHEN sd IS NOT DISTINCT FROM td OR (sd IS NOT DISTINCT FROM bd AND td IS NOT DISTINCT FROM bd) THEN 'unchanged'
          WHEN sd IS DISTINCT FROM bd AND td IS DISTINCT FROM bd THEN 'conflict_' || CASE WHEN NOT b THEN 'both_created' WHEN NOT s OR NOT t THEN 'modify_delete' ELSE 'both_modified' END
          WHEN sd IS DISTINCT FROM bd THEN CASE WHEN NOT s THEN 'delete' WHEN NOT t THEN 'create' ELSE 'update' END || '_target' ELSE 'unchanged' END AS outcome FROM j""",
        "j2_sync_download": collections + """SELECT mapping_id, id, CASE WHEN sd IS NOT DISTINCT FROM td OR (sd IS NOT DISTINCT FROM bd AND td IS NOT DISTINCT FROM bd) THEN 'unchanged'
          WHEN sd IS DISTINCT FROM bd AND td IS DISTINCT FROM bd THEN 'conflict_' || CASE WHEN NOT b THEN 'both_created' WHEN NOT s OR NOT t THEN 'modify_delete' ELSE 'both_modified' END
          WHEN sd IS DISTINCT FROM bd THEN 'unchanged' ELSE CASE WHEN NOT t THEN 'delete' WHEN NOT s THEN 'create' ELSE 'update' END || '_source' END AS outcome FROM j""",
        "j3_quick_upload": collections + "SELECT mapping_id, id, CASE WHEN NOT t THEN 'create_target' WHEN NOT s OR sd = td THEN 'unchanged' ELSE 'conflict_both_created' END AS outcome FROM j WHERE s OR t",
        "j8_dedupe_baselines": collections + "SELECT mapping_id, id, sh AS source_hash, th AS target_hash FROM baseline WHERE id % 16 < 8",
        "j10_harvest_baselines": collections + """SELECT s.mapping_id, s.id, s.hash AS source_hash, coalesce(t.hash, s.hash) AS target_hash FROM source s LEFT JOIN baseline b ON b.id = s.id AND b.id % 16 < 8
          LEFT JOIN target t ON t.id = CASE WHEN b.id IS NULL THEN s.id ELSE s.id + 8 END""",
        "j11_mirror_b_to_a": collections + """SELECT * FROM (SELECT mapping_id, id, CASE WHEN direction = 'to_source' THEN op WHEN op = 'create' THEN 'delete' WHEN op = 'update' THEN 'update'
          WHEN op = 'conflict' THEN CASE WHEN t THEN 'update' ELSE 'delete' END END AS action FROM diff WHERE op IS NOT NULL) WHERE action IS NOT NULL""",
        "j14_replay": collections + "SELECT mapping_id, id, CASE WHEN id % 3 = 0 THEN 'open' WHEN id % 4 = 0 AND slm IS NOT NULL THEN 'stale' ELSE 'replay' END AS verdict FROM diff WHERE op = 'conflict'",
        "j16_invalidate_skips": """WITH m AS (SELECT s_suppkey AS mapping_id, s_nationkey AS a, s_suppkey % 40 + 100 AS b FROM supplier)
          SELECT mapping_id, mapping_id % 3 <> 0 AND a % 10 <> 0 AND b % 10 <> 0 AND a % 7 <> 0 AND b % 7 <> 0 AS skip FROM m""",
        "j19_property_phase": collections + """, x AS (SELECT id AS uid, sd, td, CASE WHEN td IS NOT DISTINCT FROM bd THEN 'target' WHEN sd IS NOT DISTINCT FROM bd THEN 'source' ELSE 'conflict' END AS o, id % 4 AS p, id % 3 <> 0 AS two FROM j WHERE sd IS DISTINCT FROM td),
          y AS (SELECT *, CASE WHEN o <> 'conflict' THEN o WHEN p = 1 THEN 'source' ELSE 'target' END AS side FROM x WHERE NOT (o = 'conflict' AND p = 0))
          SELECT uid, 'color' AS property, side, CASE WHEN side = 'target' THEN sd ELSE td END AS value FROM y WHERE side = 'target' OR two UNION ALL SELECT uid, NULL, 'failed', NULL FROM x WHERE o = 'conflict' AND p = 0""",
        "j20_remote_ids": "SELECT o_orderkey % 4 AS backend, o_orderkey AS uid, CASE WHEN o_orderkey % 5 <> 0 THEN 'r' || (o_orderkey // 2) END AS remote_id, CASE WHEN o_orderkey % 5 <> 0 THEN o_orderkey END AS local_uid FROM orders",
        "j22_exception_changes": _INCIDENCES + "SELECT uid, 'r1' AS recurrence_id, property, a AS master, b AS exception FROM x WHERE a IS DISTINCT FROM b",
        "j23_reabsorbable": "SELECT o_orderkey AS uid, 'r' AS recurrence_id, (o_orderkey % 10 = 0 OR o_orderkey % 5 <> 0) AND o_orderkey % 3 <> 0 AND o_orderkey % 7 <> 0 AS same FROM orders",
        "c1_records_newest": collections + _WRITES + "SELECT * FROM plain UNION ALL " + _NEWER.format(wins="newer"),
        "c1_records_source_download": collections + _WRITES + "SELECT * FROM plain WHERE side = 'source' UNION ALL " + _NEWER.format(wins="true"),
        "c1_records_merge": collections + _WRITES + """SELECT * FROM plain UNION ALL SELECT mapping_id, CAST(id AS VARCHAR), 'target', CASE WHEN t THEN 'update' ELSE 'create' END, concat_ws('+', sd, td), true FROM w WHERE op = 'conflict'
          UNION ALL SELECT mapping_id, CAST(id AS VARCHAR), 'source', CASE WHEN s THEN 'update' ELSE 'create' END, concat_ws('+', sd, td), false FROM w WHERE op = 'conflict'""",
        "c3_duplicate": collections + _WRITES + """, c AS (SELECT *, id || '-dup-' || left(sha256(concat_ws('|', mapping_id, id, thash)), 32) AS clone FROM w WHERE op = 'conflict')
          SELECT * FROM plain UNION ALL SELECT mapping_id, CAST(id AS VARCHAR), 'source', 'create', td, true FROM c WHERE NOT s UNION ALL SELECT mapping_id, CAST(id AS VARCHAR), 'target', 'create', sd, true FROM c WHERE NOT t
          UNION ALL SELECT mapping_id, CAST(id AS VARCHAR), 'target', 'update', sd, true FROM c WHERE s AND t UNION ALL SELECT mapping_id, clone, 'target', 'create', replace(td, 'UID:' || id, 'UID:' || clone), true FROM c WHERE s AND t UNION ALL SELECT mapping_id, clone, 'source', 'create', replace(td, 'UID:' || id, 'UID:' || clone), false FROM c WHERE s AND t""",
        "c1_counters": collections + "SELECT mapping_id, CAST(0 AS BIGINT) AS resolved, count(*) FILTER (op = 'conflict') AS deferred FROM diff WHERE op IS NOT NULL GROUP BY mapping_id",
        "c4_hold_unresolved": collections + """, held AS MATERIALIZED (SELECT DISTINCT mapping_id AS h FROM diff WHERE op = 'conflict' AND mapping_id < 'm4' AND (sd IS NULL OR td IS NULL))
          SELECT mapping_id, id, side, action FROM plan LEFT JOIN held ON h = mapping_id WHERE h IS NULL""",
        "c6_canon_diff": "SELECT o_orderkey AS uid, concat_ws(',', CASE WHEN o_orderkey % 7 = 0 OR o_orderkey % 5 = 0 THEN 'status' END, CASE WHEN o_orderkey % 3 = 0 THEN 'priority' END) AS changed FROM orders",
        "c7_canon_merge_json": """WITH x AS (SELECT o_orderkey AS uid, o_orderstatus AS st, o_orderpriority AS pr, o_orderkey % 11 = 0 AS bare, o_orderkey % 7 = 0 AS s, o_orderkey % 5 = 0 AS t, o_orderkey % 3 = 0 AS l FROM orders)
          SELECT uid, CASE WHEN s AND NOT t AND NOT bare THEN 'S' WHEN t THEN 'T' ELSE st END AS status, CASE WHEN l THEN 'low' ELSE pr END AS priority, CASE WHEN s AND NOT t AND NOT bare THEN 's' ELSE 't' END AS extras, 'task' AS kind,
          CASE WHEN bare THEN 'status,priority' WHEN s THEN 'status' ELSE '' END AS changed_source, CASE WHEN bare THEN 'status,priority' ELSE concat_ws(',', CASE WHEN t THEN 'status' END, CASE WHEN l THEN 'priority' END) END AS changed_target, uid % 50 = 0 AS kind_mismatch FROM x""",
        "c8_typed_merges": """WITH x AS (SELECT doc_id AS uid, text, lang, doc_id % 7 = 0 AS s, doc_id % 35 = 0 AS t, doc_id % 5 = 0 AS c FROM documents)
          SELECT uid, sha256(CASE WHEN s THEN 's' || text ELSE text END) AS body, CASE WHEN c THEN 'changed' ELSE lang END AS category, t AND text IS NOT NULL AS conflict, sha256(CASE WHEN t THEN 't' || text WHEN s THEN 's' || text ELSE text END) AS whole,
          sha256(CASE WHEN t THEN 't' || text WHEN s AND uid % 2 = 0 THEN 's' || text ELSE text END) AS contact_body, CASE WHEN c THEN 'changed' ELSE lang END AS contact_category FROM x""",
        "c12_incidence_diff": _INCIDENCES + """SELECT uid, property, a, b, CASE WHEN b IS NULL THEN 'only_in_a' WHEN a = base THEN 'a_matches_baseline' WHEN b = base THEN 'b_matches_baseline' ELSE 'both_changed' END AS state,
          CASE WHEN b IS NULL THEN NULL WHEN a = base THEN 'use_b' WHEN b = base THEN 'use_a' END AS resolution, CASE WHEN property = 'SUMMARY' THEN 'essential' ELSE 'status' END AS category, CASE WHEN property = 'SUMMARY' THEN 0 ELSE 30 END AS priority FROM x WHERE a IS DISTINCT FROM b""",
        "c14_apply_resolutions": _INCIDENCES + "SELECT uid, property, CASE WHEN b IS NULL OR a = b THEN base WHEN a = base THEN b WHEN b = base THEN a ELSE base END AS value FROM x",
        "c19_resolve_all": _STORE + "SELECT id, CASE WHEN NOT resolved AND mapping_id = 'm1' THEN 'target' ELSE decision END AS decision, resolved OR coalesce(mapping_id = 'm1', false) AS resolved FROM st",
        "c19_consume": _STORE + "SELECT id, decision FROM st WHERE resolved AND NOT applied",
        "c20_record_conflicts": _STORE + """SELECT id, mapping_id, uid, CASE WHEN k % 25 = 0 AND NOT resolved THEN detected_at + INTERVAL 1 DAY ELSE detected_at END AS detected_at, decision FROM st
          UNION ALL SELECT NULL, mapping_id, uid, detected_at + INTERVAL 1 DAY, NULL FROM st WHERE k % 25 = 0 AND resolved""",
        "o1_pending_conflicts": _STORE + "SELECT id, detected_at FROM st WHERE NOT resolved",
        "a6_unresolved_count": _STORE + "SELECT mapping_id, count(*) AS unresolved, false AS total FROM st WHERE NOT resolved GROUP BY mapping_id UNION ALL SELECT NULL, count(*), true FROM st WHERE NOT resolved",
        "a1_summary": collections + "SELECT mapping_id, side, '+' || count(*) FILTER (action = 'create') || ' ~' || count(*) FILTER (action = 'update') || ' -' || count(*) FILTER (action = 'delete') || ' =0 !0 E0' AS summary FROM plan GROUP BY ROLLUP (mapping_id, side)",
        "a1b_apply_outcome": collections + """, x AS (SELECT *, id % 23 <> 1 AND id % 29 <> 2 AS good FROM plan) SELECT mapping_id, count(*) FILTER (good AND action = 'create') AS created, count(*) FILTER (good AND action = 'update') AS updated,
          count(*) FILTER (good AND action = 'delete') AS deleted, count(*) FILTER (NOT good) AS errors, bool_and(good) AS ok FROM x GROUP BY mapping_id""",
        "a3_revision_digest": "SELECT o_orderkey % 400 AS mapping_id, sha256(string_agg(o_orderkey || ':' || (o_custkey % 10) || ';', '' ORDER BY o_orderkey)) AS digest FROM orders GROUP BY 1",
        "a4_fingerprint": "SELECT folder, sha256(string_agg(line, chr(10) ORDER BY url, line)) AS digest FROM (SELECT page_id % 20 AS folder, url, url || '|' || (page_id * 7) || '|' || strlen(html) AS line FROM pages) GROUP BY folder",
        "a5_guarded_plan": collections + """, g AS (SELECT mapping_id FROM (SELECT mapping_id, count(*) FILTER (action = 'delete') AS d FROM plan GROUP BY 1) JOIN (SELECT mapping_id, count(*) AS n FROM baseline GROUP BY 1) USING (mapping_id) WHERE (d > 10 OR d * 100 // n > 25) AND mapping_id <> 'm2')
          SELECT mapping_id, id, side, action FROM plan WHERE action <> 'delete' OR mapping_id NOT IN (SELECT mapping_id FROM g)""",
        "a7_compose_loss": _EDGES + """SELECT edge AS path, property, ['reversible', 'degraded', 'simplified', 'dropped'][max(severity) + 1] AS loss_kind,
          CASE WHEN count(*) FILTER (k % 3 <> 0) > 0 THEN concat_ws(',', CASE WHEN bool_and(k % 2 = 0) FILTER (k % 3 <> 0) THEN 'v0' END, CASE WHEN bool_and(k % 2 = 1) FILTER (k % 3 <> 0) THEN 'v1' END, 'v2') END AS lossless FROM e GROUP BY edge, property""",
        "a8_loss_summary": _EDGES + """, d AS (SELECT DISTINCT edge, property, severity FROM e), x AS (SELECT edge, severity, string_agg(property, ', ' ORDER BY property) AS ps FROM d GROUP BY 1, 2)
          SELECT edge, string_agg(CASE severity WHEN 3 THEN 'drops ' WHEN 2 THEN 'simplifies ' WHEN 0 THEN 'stashes ' ELSE 'degrades ' END || ps, '; ' ORDER BY CASE severity WHEN 3 THEN 0 WHEN 2 THEN 1 WHEN 0 THEN 2 ELSE 3 END) AS summary FROM x GROUP BY edge""",
        "a9_bucket_sequences": log + "SELECT app_id, uid % 200 AS bucket, CASE WHEN count(*) > count(DISTINCT uid) THEN 6 ELSE 5 END AS sequence FROM log GROUP BY 1, 2",
        "a10_new_apps": log + "SELECT DISTINCT app_id FROM log WHERE app_id >= 'app2'",
        "a10_purge_dead": log + ", l AS (SELECT * FROM log WHERE app_id <> 'app3' OR seq < 500) SELECT app_id, seq FROM l WHERE app_id IN (SELECT app_id FROM l GROUP BY 1 HAVING max(datetime) >= TIMESTAMP '2024-01-20')",
        "a11_onboarding": log + "SELECT uid, datetime, value FROM log QUALIFY row_number() OVER (PARTITION BY uid ORDER BY datetime DESC, app_id, seq) = 1",
        "a13_auto_match": """WITH x AS (SELECT s_suppkey AS k, s_nationkey % 3 AS backend, s_suppkey % 12 AS c, ' Cal' || (s_suppkey % 12) || CASE WHEN s_suppkey % 2 = 0 THEN ' ' ELSE '' END AS name FROM supplier)
          SELECT 'cal' || c AS name, arg_min(name, k) AS display_name, CASE WHEN bool_and(k % 5 <> 0) AND c <> 3 THEN 'events' WHEN c = 3 AND NOT bool_and(k % 5 <> 0) THEN 'todos' ELSE 'hybrid' END AS type,
          '#' || min(k) FILTER (k % 4 = 3) AS color, concat_ws(',', CASE WHEN bool_or(backend = 0) THEN '0' ELSE '0?' END, CASE WHEN bool_or(backend = 1) THEN '1' ELSE '1?' END, CASE WHEN bool_or(backend = 2) THEN '2' ELSE '2?' END, '3?') AS bindings FROM x WHERE c <> 5 GROUP BY c""",
        "a15_unlink": contacts + "SELECT DISTINCT record // 10 AS entity, email FROM edges WHERE record // 10 % 7 <> 0",
        "a16_validate": BINDINGS + """, p AS (SELECT calendar, max(name) AS name, count(*) FILTER (role = 'primary' AND enabled) AS n FROM b GROUP BY 1)
          SELECT calendar, 'no name' AS problem FROM p WHERE name = '' UNION ALL SELECT calendar, 'no primary' FROM p WHERE n = 0 UNION ALL SELECT calendar, 'several primaries' FROM p WHERE n > 1
          UNION ALL SELECT DISTINCT calendar, 'duplicate binding' FROM (SELECT calendar FROM b GROUP BY calendar, backend, remote HAVING count(*) > 1)""",
        "a17_promote": BINDINGS + """SELECT calendar, backend, CASE WHEN calendar % 2 = 0 AND backend = top THEN 'primary' WHEN calendar % 2 = 0 AND role = 'primary' AND enabled THEN 'sync1' ELSE role END AS role,
          CASE WHEN calendar % 2 = 0 AND backend <> top AND role = 'primary' AND enabled THEN greatest(position, 1) ELSE position END AS position FROM (SELECT *, max(backend) OVER (PARTITION BY calendar) AS top FROM b)""",
        "u4_star_bindings": BINDINGS + "SELECT 'auto_' || x.calendar || '_' || y.role AS id, x.calendar, x.backend AS first, y.backend AS second FROM m x JOIN m y USING (calendar) WHERE x.place = 1 AND y.place > 1",
        "u4_mirror_bindings": BINDINGS + "SELECT 'auto_' || x.calendar || '_mirror_' || x.backend || '_' || y.backend AS id, x.calendar, x.backend AS first, y.backend AS second FROM m x JOIN m y USING (calendar) WHERE x.place < y.place",
        "u4_chain_bindings": BINDINGS + "SELECT 'auto_' || x.calendar || '_chain_' || x.backend || '_' || y.backend AS id, x.calendar, x.backend AS first, y.backend AS second FROM m x JOIN m y USING (calendar) WHERE x.place + 1 = y.place",
        "w3_latest_info": log + "SELECT uid % 13 AS key, value FROM log QUALIFY row_number() OVER (PARTITION BY uid % 13 ORDER BY datetime DESC, app_id, seq) = 1",
        "w4_latest_resolutions": """SELECT user_id % 5 AS mapping_id, user_id AS id, 'd' || (event_id % 3) AS decision, event_id AS seq FROM events WHERE event_id % 7 <> 0 AND event_id % 5 <> 0
          QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY date_trunc('day', ts) DESC, event_id DESC) = 1""",
        "w8_conflict_winners": log + """, old AS (SELECT * FROM log WHERE datetime < TIMESTAMP '2024-01-10' QUALIFY row_number() OVER (PARTITION BY uid ORDER BY datetime DESC, app_id, seq) = 1),
          p AS (SELECT uid, app_id, 'kind' AS property, value FROM per WHERE value IS NOT NULL UNION ALL SELECT uid, app_id, 'place', 'room' || (seq % 3) FROM per WHERE value IS NOT NULL
            UNION ALL SELECT uid, app_id, 'note', 'n' || app_id FROM per WHERE value IS NOT NULL AND seq % 5 = 0),
          b AS (SELECT uid, 'kind' AS property, value FROM old WHERE value IS NOT NULL UNION ALL SELECT uid, 'place', 'room' || (seq % 3) FROM old WHERE value IS NOT NULL UNION ALL SELECT uid, 'note', 'n' || app_id FROM old WHERE value IS NOT NULL AND seq % 5 = 0),
          every AS (SELECT l.uid, l.app_id, l.datetime, k.property, coalesce(p.value, '') AS value, coalesce(b.value, '') AS agreed FROM per l JOIN old ON old.uid = l.uid CROSS JOIN (SELECT unnest(['kind', 'place', 'note']) AS property) k
            LEFT JOIN p ON p.uid = l.uid AND p.app_id = l.app_id AND p.property = k.property LEFT JOIN b ON b.uid = l.uid AND b.property = k.property WHERE l.value IS NOT NULL),
          changed AS (SELECT *, row_number() OVER (PARTITION BY uid, property ORDER BY datetime DESC, value, app_id) AS k FROM every WHERE value <> agreed)
          SELECT uid, property, max(value) FILTER (k = 1) AS winner, max(app_id) FILTER (k = 1) AS winner_app, max(value) FILTER (k = 2) AS loser, max(app_id) FILTER (k = 2) AS loser_app FROM changed GROUP BY uid, property HAVING count(DISTINCT value) > 1""",
        "w9_skeletons": """WITH f AS (SELECT user_id AS id, event_id AS k, event_type, max(CASE WHEN event_id % 8 = 0 OR event_id % 50 = 1 THEN event_id END) OVER (PARTITION BY user_id) AS since FROM events),
          r AS (SELECT * FROM f WHERE (since IS NULL OR k >= since) AND NOT (k % 50 = 1 AND k % 8 <> 0)), p AS (SELECT id, k, 'type' AS property, CASE WHEN k % 6 <> 0 THEN event_type END AS value FROM r UNION ALL SELECT id, k, 'k', CAST(k AS VARCHAR) FROM r WHERE k % 3 = 0)
          SELECT id, property, value FROM p QUALIFY row_number() OVER (PARTITION BY id, property ORDER BY k DESC) = 1""",
        "t3_new_entries": log + """, l AS (SELECT uid, app_id, lpad(printf('%X', uid), 2, '0') AS bucket, seq AS sequence FROM log), t AS (SELECT app_id, bucket, floor(avg(sequence)) AS seen FROM l WHERE uid % 3 = 0 GROUP BY 1, 2)
          SELECT app_id, uid, sequence FROM l LEFT JOIN t USING (app_id, bucket) WHERE app_id <> 'app1' AND (seen IS NULL OR sequence > seen)""",
        "o4_limit_auto": collections + "SELECT mapping_id, id, CASE WHEN coalesce(slm, TIMESTAMP '0001-01-01') < coalesce(tlm, TIMESTAMP '0001-01-01') THEN 'source' ELSE 'target' END AS decision FROM diff WHERE op = 'conflict' QUALIFY row_number() OVER (PARTITION BY mapping_id ORDER BY id) <= 3",
        "c16_oldest": collections + "SELECT mapping_id, id, CASE WHEN coalesce(slm, TIMESTAMP '0001-01-01') < coalesce(tlm, TIMESTAMP '0001-01-01') THEN 'source' ELSE 'target' END AS decision FROM diff WHERE op = 'conflict'",
        "c16_source": collections + "SELECT mapping_id, id, CASE WHEN sd IS NULL OR td IS NULL THEN 'skip' ELSE 'source' END AS decision, CASE WHEN sd IS NULL OR td IS NULL THEN 'fallback' ELSE 'policy' END AS resolved_by FROM diff WHERE op = 'conflict'",
        "f2_semantic_hash": """SELECT o_orderkey, sha256(concat_ws(chr(10), 'CATEGORIES:c' || least(o_orderkey % 7, o_orderkey % 5) || ',c' || greatest(o_orderkey % 7, o_orderkey % 5), 'DESCRIPTION:', 'LOCATION:', CASE WHEN o_orderkey % 2 = 0 THEN 'ORGANIZER:ann@x' END,
          'PRIORITY:', 'SECRECY:', 'STATUS:', 'SUMMARY:' || o_orderstatus, 'TYPE:0', 'UID:' || o_orderkey)) AS digest FROM orders""",
        "f4_extras_digest": _TASKS + """SELECT id, CASE WHEN ok THEN sha256('{"tag":"t' || (id % 4) || '"}') END AS digest FROM t""",
        "f5_envelope": _TASKS + "SELECT id, 'z' || id AS uid, 'task' AS kind, 'todo' AS domain FROM t WHERE ok",
        "f8_ical_properties": _CALENDAR + """SELECT uid, p.name AS property, p.v AS value FROM (SELECT uid, unnest([{'name': 'UID', 'v': uid}, {'name': 'SUMMARY', 'v': 'Order ' || k || ' folded'}, {'name': 'DTSTART', 'v': 'TZID=Europe/Paris:' || day || 'T080000'}, {'name': 'STATUS', 'v': st},
          {'name': 'RRULE', 'v': 'FREQ=DAILY;COUNT=3'}, {'name': 'EXDATE', 'v': '20240101,20240102'}, {'name': 'TRIGGER', 'v': '-PT15M'}]) AS p FROM k WHERE k % 4 <> 2)""",
        "f9_recurrence_lines": _CALENDAR + """SELECT uid, CASE WHEN k % 4 = 0 THEN 'RRULE:FREQ=DAILY;COUNT=3 EXDATE:20240101 EXDATE:20240102' ELSE '' END AS lines, k % 4 = 0 AS complex, CASE WHEN k % 4 = 0 THEN 'RRULE:FREQ=DAILY;COUNT=3' END AS simple, 'RRULE:FREQ=DAILY;UNTIL=' || uid AS hourly FROM k""",
        "f14_text_formats": """SELECT p_partkey, p_name AS summary, '+home,@c' || (p_partkey % 9) AS categories, 'x (' || chr(CAST(p_partkey % 26 + 65 AS INTEGER)) || ') ' || p_name || ' due:2024-05-' || lpad(CAST(p_partkey % 28 + 1 AS VARCHAR), 2, '0') || ' +home' AS line,
          '---' || chr(10) || 'id: n' || p_partkey || chr(10) || 'title: ' || p_name || chr(10) || '---' || chr(10) || p_type || chr(10) AS note, 'n' || p_partkey AS note_id, p_type || chr(10) AS body, 'busyStatus' AS carrier FROM part""",
        "f16_vendor_json": """SELECT p_partkey, 't' || p_partkey AS uid, p_name AS summary, '2024-05-' || lpad(CAST(p_partkey % 28 + 1 AS VARCHAR), 2, '0') AS due, '[' || (p_partkey % 3) || ']' AS links, sha256('{"links":[' || (p_partkey % 3) || ']}') AS digest, 'e' || p_partkey AS event,
          'confirmed' AS status, '2024-01-01T08:00:00Z' AS created, 'true' AS all_day, 'true' AS locked, '[{"email":"a@x","name":"A"}]' AS attendees, CAST(p_partkey % 5 AS VARCHAR) AS sequence,
          'a' || p_partkey || '@x' || CASE WHEN p_partkey % 2 = 0 THEN '*' ELSE ',main@x*' END AS mails, 'home:1,mobile:' || p_partkey AS phones FROM part""",
        "f19_calendar_id": "SELECT p_partkey, 'é_' || replace(lower(p_name), ' ', '-') || '-' || p_size AS calendar FROM part",
        "f20_properties_hash": "SELECT p_partkey, sha256(concat_ws(chr(10), CASE WHEN p_partkey % 3 <> 0 THEN 'COLOR:#ff00aa11' END, CASE WHEN p_partkey % 2 = 0 THEN 'DESCRIPTION:' || p_name END)) AS digest FROM part",
        "f22_flatten_json": _TASKS + """SELECT id, p.path AS path, p.v AS value FROM (SELECT id, unnest([{'path': '$.uid', 'v': '"o' || id || '"'}, {'path': '$.status', 'v': '"' || st || '"'}, {'path': '$.priority', 'v': '"' || pr || '"'}, {'path': '$.categories[0]', 'v': '"c' || (id % 3) || '"'},
          {'path': '$.categories[1]', 'v': '"c' || (id % 5) || '"'}, {'path': '$.providerExtras.etag', 'v': '"e' || id || '"'}, {'path': '$.providerExtras.tag', 'v': '"t' || (id % 4) || '"'}]) AS p FROM t WHERE ok)
          UNION ALL SELECT id, '$[0]', '1' FROM t WHERE id % 19 = 0 AND id % 17 <> 0""",
        "f24_pseudonyms": "WITH f AS (SELECT user_id, row_number() OVER (ORDER BY min(event_id)) AS n FROM events GROUP BY 1) SELECT event_id, 'person' || n AS email FROM events JOIN f USING (user_id)",
    }
