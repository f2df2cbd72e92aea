"""Queries on recurrence patterns, series, runs over many mappings, linking in order, loss by kind and conversions, and the same in SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from accord.functions import recurrence, text, vendor
from accord.jobs.wider_sql import BINDINGS
from accord.operators import aliases, converge, identity, logs, loss, reconcile, series, topology
from accord.operators.loss import Edge
from accord.sources import derived
from accord.sources.shared import written


def _pick(values, index):
    return F.element_at(F.array(*map(F.lit, values)), (index + 1).cast("int"))


def _patterns(spark, d):
    k = F.col("p_partkey")
    json = F.format_string(
        '{"pattern":{"type":"%s","interval":%d,"dayOfMonth":%d,"month":%d,"daysOfWeek":%s,"index":"%s","firstDayOfWeek":"%s"},"range":{"type":"x","startDate":"2024-%02d-%02d","endDate":"%s","numberOfOccurrences":%d}}',
        _pick([*recurrence.TYPES, "odd"], k % 7), k % 4, k % 31, k % 13, _pick(["[]", '["monday","monday"]', '["tuesday","holiday","friday"]'], k % 3), _pick([*recurrence.PLACES, ""], k % 6), F.when(k % 2 == 0, "sunday").otherwise(""),
        k % 12 + 1, k % 28 + 1, F.when(k % 11 == 0, "2025-06-30").otherwise("0001-01-01"), k % 5,
    )
    cancelled = F.when(k % 9 == 0, F.array(F.lit("2024-05-01T08:00:00Z"), F.lit("blob"), F.concat(F.lit("2024-05-02T0"), k % 10, F.lit(":00:00Z"))))
    x = recurrence.pattern_to_lines(json, cancelled)
    return derived.spread(derived.table(spark, d, "part").select("p_partkey")).select("p_partkey", x.alias("x")).select("p_partkey", F.array_join("x.lines", "|").alias("lines"), F.array_join("x.unparsed", "|").alias("unparsed"))


def _rules(spark, d):
    k = F.col("p_partkey")
    part = lambda when, value: F.when(when, value).otherwise("")
    rule = F.concat(
        F.lit("RRULE:FREQ="), _pick(["DAILY", "WEEKLY", "MONTHLY", "YEARLY", "HOURLY"], k % 5), part(k % 4 > 0, F.concat(F.lit(";INTERVAL="), k % 4)), _pick(["", ";BYDAY=MO", ";BYDAY=TU,2FR"], k % 3),
        part(k % 7 == 0, ";BYSETPOS=-1"), part(k % 11 == 0, ";BYMONTHDAY=5,9"), part(k % 13 == 0, ";BYMONTH=3"), part(k % 6 == 0, ";COUNT=4"), part(k % 6 == 1, ";UNTIL=20250630T000000Z"),
    )
    lines = F.array_compact(F.array(rule, F.when(k % 8 == 0, "EXDATE:20240501T080000Z,20240502"), F.when(k % 10 == 0, "RDATE:20240601")))
    x = recurrence.lines_to_pattern(lines, F.format_string("2024-02-%02dT09:00:00Z", k % 28 + 1))
    rows = derived.spread(derived.table(spark, d, "part").select("p_partkey")).select("p_partkey", x.alias("x"))
    return rows.select("p_partkey", "x.pattern", F.array_join("x.carried", "|").alias("carried"), F.array_join("x.cancelled", "|").alias("cancelled"))


def _split(spark, d):
    k, start = F.col("o_orderkey"), F.col("o_orderdate")
    orders = derived.table(spark, d, "orders").select(k, start)
    rule = F.when(k % 5 == 0, "RRULE:FREQ=DAILY;COUNT=9").when(k % 7 == 0, "EXDATE:20240101").when(k % 3 == 0, F.concat(F.lit("RRULE:FREQ=DAILY;UNTIL="), F.when(k % 2 == 0, "19000101").otherwise("20990101"), F.lit(";INTERVAL=2"))).when(k % 4 == 0, "RRULE:FREQ=DAILY;UNTIL=20990101T000000Z").otherwise("RRULE:FREQ=DAILY")
    day, stamp = F.date_format(start, "yyyy-MM-dd"), F.date_format(start, "yyyy-MM-dd'T'HH:mm:ss'Z'")
    begin = F.when(k % 8 == 1, F.concat(F.lit('{"allDay":true,"date":"'), day, F.lit('"}'))).otherwise(F.concat(F.lit('{"dateTime":"'), stamp, F.lit('","tz":"Europe/Paris"}')))
    uid = F.concat(F.lit("o"), k)
    masters = orders.where("o_orderkey % 11 <> 0").select(uid.alias("uid"), F.concat(F.lit('{"recurrence":["'), rule, F.lit('","RDATE:20240102"],"start":'), begin, F.lit(',"uid":"'), uid, F.lit('"}')).alias("data"))
    at = F.format_string('{"recurrenceId":{"dateTime":"%s"},"uid":"o%d"}', F.date_format(start + F.make_interval(days=(k % 20).cast("int")), "yyyy-MM-dd'T'HH:mm:ss'Z'"), k)
    return series.split_series(masters, orders.select(uid.alias("uid"), (start + F.expr("interval 10 days")).alias("at")), orders.select(uid.alias("uid"), at.alias("data")))


def _arrivals(spark, d, run):
    """Contacts: each with an address of its own, and in every ten one that bridges two others and one that shares an address then."""
    k = F.col("c_custkey")
    mail = lambda n: F.concat(F.lit("C"), n, F.lit("@x"))
    emails = F.when(k % 10 == 5, F.array(mail(k), mail(k - 1), mail(k - 2))).when(k % 10 == 6, F.array(mail(k), mail(k - 2))).otherwise(F.array(mail(k)))
    rows = derived.table(spark, d, "customer").select(k.alias("seq"), F.lit("contacts").alias("domain"), F.concat(F.lit("p"), k).alias("record"), emails.alias("emails"), F.when((k % 20 == 4) & F.lit(run == "two"), "").otherwise(F.concat(F.lit(f"{run}-"), k)).alias("name"))
    return rows if run == "one" else rows.where("seq % 10 = 4")


def _linked(spark, d):
    links, index = spark.createDataFrame([], "domain string, record string, entity string, name string"), spark.createDataFrame([], "email string, entity string")
    for run in ("one", "two"):
        _, links, index = identity.link_arrivals(_arrivals(spark, d, run), links, index, run)
    return links, index


def _runs(spark, d):
    """Collections A and B of orders, and C, in a chain; a disabled mapping to D."""
    k = F.col("o_orderkey")
    o = derived.table(spark, d, "orders").select(k.cast("string").alias("id"), k, F.col("o_orderstatus").alias("data"), F.col("o_orderdate").alias("last_modified"))
    a = o.where("o_orderkey % 2 = 0").select(F.lit("A").alias("endpoint"), "id", "data", "last_modified")
    b = o.where("o_orderkey % 3 = 0").select(F.lit("B").alias("endpoint"), "id", F.concat("data", F.when(k % 5 == 0, "!").otherwise("")).alias("data"), "last_modified")
    mappings = spark.createDataFrame([("m1", "B", "C", True), ("m2", "A", "B", True), ("m3", "C", "D", False)], "mapping_id string, source string, target string, enabled boolean")
    none = spark.createDataFrame([], "mapping_id string, id string, source_hash string, target_hash string, data string")
    return a.unionByName(b), none, mappings


def _converged(spark, d):
    return converge.converge(*_runs(spark, d))[0].select("endpoint", "id", "data")


def _pass_results(spark, d):
    return converge.converge(*_runs(spark, d))[2]


def _second_run(spark, d):
    """What a second run over what the first has left does, but for what was edited and deleted in between."""
    state, none, mappings = _runs(spark, d)
    after, agreed, _ = converge.converge(state, none, mappings)
    after = written(after)
    k = F.col("id").cast("long")
    edited = after.where(~((F.col("endpoint") == "A") & (k % 7 == 0))).withColumn("data", F.when((F.col("endpoint") == "C") & (k % 11 == 0), "edited").otherwise(F.col("data")))
    return converge.converge(edited, written(agreed), mappings)[2]


def _loss_by_kind(spark, d):
    k = F.col("id")
    tasks = derived.tasks(spark, d)
    kind = F.when(k % 3 == 0, '"_canon":{"kind":"task"},').when(k % 3 == 1, '"_canon":{"kind":"note"},').otherwise("")
    rows = tasks.withColumn("data", F.when(F.col("data").startswith('{"uid"'), F.concat(F.lit("{"), kind, F.substr("data", F.lit(2)))).otherwise(F.col("data")))
    edges = spark.createDataFrame([(None, "status", "dropped", None), ("task", "priority", "simplified", ['"5-LOW"']), ("note", None, None, None)], "kind string, property string, loss_kind string, lossless array<string>")
    return loss.materialized_loss(rows, edges).select("mapping_id", "id", F.array_join("lost", ",").alias("lost"))


def _ledger(spark, d):
    p, k = derived.table(spark, d, "part"), F.col("p_partkey")
    kind = F.when(k % 5 == 0, "task").when(k % 5 == 1, "note")
    rows = p.select(F.concat(F.lit("d"), k % 4).alias("domain"), F.lit("canon").alias("source"), F.concat(F.lit("e"), F.floor(k / 4) % 3).alias("target"), F.when(k % 4 != 3, kind).alias("kind"), F.when(k % 4 != 3, F.concat(F.lit("p"), F.floor(k / 12) % 5)).alias("property"), F.when(k % 4 != 3, _pick(loss.SEVERITY, F.floor(k / 12) % 4)).alias("loss_kind"))
    return loss.loss_ledger(rows)


def _converted(spark, d):
    """Tasks of a vendor as todo.txt lines, over their canonical form: the path is searched, converted and its loss told."""
    canon_line = lambda c: text.to_todotxt(F.get_json_object(c, "$.status") == "completed", F.lit(None).cast("string"), F.get_json_object(c, "$.due.date"), F.array(F.lit("+home")), F.get_json_object(c, "$.summary"))
    edges = [
        Edge(("todo", "google"), ("todo", "canon"), vendor.google_task_to_canon, (("links", "reversible", None),)),
        Edge(("todo", "canon"), ("todo", "txt"), canon_line, (("description", "dropped", None), ("status", "simplified", ('"completed"', '"needsAction"')), ("links", "dropped", None))),
    ]
    plan = loss.conversion_plan(edges, {"todo": [("todo", "canon")]}, ("todo", "google"), ("todo", "txt"))
    k = F.col("p_partkey")
    task = F.format_string('{"id":"t%d","title":"%s","due":"2024-05-%02dT00:00:00Z","status":"%s","etag":"e"}', k, "p_name", k % 28 + 1, F.when(k % 3 == 0, "completed").otherwise("needsAction"))
    lost = loss.plan_loss(spark, plan, "google>txt").agg(F.array_join(F.array_sort(F.collect_list(F.concat_ws(":", "property", "loss_kind"))), ",").alias("lost"))
    told = lost.first()[0]  # a handful of properties
    return loss.converted(derived.spread(derived.table(spark, d, "part").select("p_partkey", "p_name")).select("p_partkey", task.alias("data")), plan).withColumn("lost", F.lit(told))


def _policies(spark, d):
    b = derived.bindings(spark, d)
    calendars = b.select("calendar").distinct().select("calendar", _pick(["manual", "hub", "mesh", "chain", "default"], F.col("calendar") % 5).alias("policy"), (F.col("calendar") % 7 != 3).alias("sync_enabled"))
    return topology.generate_mappings(b, "chain", calendars)


def _joint_names(spark, d):
    """Clerks' and customers' addresses of orders and customers by one numbering."""
    o, c = derived.table(spark, d, "orders"), derived.table(spark, d, "customer")
    mail = lambda n: F.concat(F.lit("c"), n, F.lit("@mail.org"))
    orders = o.select("o_orderkey", mail(F.col("o_custkey")).alias("customer"), mail(F.col("o_custkey") % 50 + 1).alias("clerk"))
    people = c.select("c_custkey", mail(F.col("c_custkey")).alias("mail"))
    names = written(vendor.pseudonym_dictionary([(orders, "o_orderkey", {"customer": "p", "clerk": "p"}), (people, "c_custkey", {"mail": "p"})]))
    forms = dict.fromkeys(("customer", "clerk", "mail"), "{}@example.com")
    a = vendor.pseudonymise(orders, "o_orderkey", {"customer": "p", "clerk": "p"}, names, forms).select(F.lit("order").alias("of"), F.col("o_orderkey").alias("k"), "customer", "clerk")
    b = vendor.pseudonymise(people, "c_custkey", {"mail": "p"}, names, forms).select(F.lit("customer").alias("of"), F.col("c_custkey").alias("k"), F.col("mail").alias("customer"), F.lit(None).cast("string").alias("clerk"))
    return a.unionByName(b)


def _run_stats(spark, d):
    sides = derived.collections(spark, d)
    plan = reconcile.resolve(reconcile.three_way_diff(*sides), "newest")
    results = plan.where("id % 23 <> 1").select("mapping_id", "id", "side", (F.col("id") % 29 != 2).alias("success"))
    return reconcile.stats_summary(reconcile.run_stats(*sides, plan, results))


def _occurrences(spark, d):
    """Turns of conversations as occurrences of one record: keys are composed of both."""
    c = derived.table(spark, d, "conversations")
    when = F.when(F.col("turn") > 0, F.lit("2024-01-01").cast("timestamp") + F.make_interval(days=F.col("turn").cast("int")))
    rows = c.select(F.concat(F.lit("m"), F.col("conv_id") % 4).alias("mapping_id"), text.compose_identity(F.col("conv_id").cast("string"), when).alias("id"), "conv_id", "turn", "role", F.when((F.col("conv_id") + F.col("turn")) % 9 != 5, F.concat("role", F.lit(" "), "turn")).alias("data"))
    side = lambda df, data: df.select("mapping_id", "id", data.alias("data"))
    source = side(rows.where("turn % 5 <> 4"), F.when(F.col("conv_id") % 7 == 0, "new").otherwise(F.col("data")))
    target = side(rows.where("(conv_id + turn) % 6 <> 1"), F.when(F.col("conv_id") % 5 == 0, F.concat(F.lit("t"), F.col("conv_id") % 2)).otherwise(F.col("data")))
    return reconcile.sync_diff(source, target, side(rows.where("turn <> 2"), F.col("data")))


def _conflict_members(spark, d):
    creates = reconcile.three_way_diff(*derived.collections(spark, d)).where("op = 'create'")
    side = lambda direction, data: creates.where(F.col("direction") == direction).select("mapping_id", "id", F.sha2(F.regexp_extract(data, "STATUS:(.*)", 1), 256).alias("digest"))
    return aliases.identity_conflict_members(side("to_target", F.col("s_data")), side("to_source", F.col("t_data")), "mapping_id")


def _record_merge(spark, d):
    log = derived.property_log(spark, d)
    place = F.rank().over(identity.Window.partitionBy("uid").orderBy(F.desc("datetime"), F.asc("app_id"), F.asc("seq")))
    old = log.where(F.col("datetime") < F.lit("2024-01-10").cast("timestamp")).withColumn("place", place).where("place = 1")
    return logs.merge_properties(log, old.select("uid", "property", "value"), on_conflict="record")


def _calendars(spark, d):
    s, k = derived.table(spark, d, "supplier"), F.col("s_suppkey")
    discovered = s.select(
        F.concat(F.lit("b"), F.col("s_nationkey") % 4).alias("backend"), F.concat(F.lit("r"), k).alias("calendar"), F.concat(F.lit(" My Cal "), k % 17, F.when(k % 2 == 0, " ").otherwise("")).alias("name"), k.alias("seq"),
        (k % 3 != 0).alias("events"), (k % 17 == 3).alias("todos"), F.when(k % 4 == 3, F.concat(F.lit("#"), k)).alias("color"),
    )
    return topology.logical_calendars(discovered, "b1", ["b0", "b1", "b2", "b9"], spark.createDataFrame([("MY CAL 5",)], "name string"))


def _wired(spark, d):
    return topology.generate_mappings(topology.binding_rows(_calendars(spark, d)), "star")


QUERIES = {
    "a1_run_stats": _run_stats,
    "a3_bucketed_revisions": lambda s, d: reconcile.bucketed_revision_digest(derived.table(s, d, "orders").select((F.col("o_orderkey") % 40).alias("mapping_id"), F.col("o_orderkey").alias("id"), (F.col("o_custkey") % 10).alias("rev"))),
    "a4_bucketed_fingerprint": lambda s, d: reconcile.bucketed_fingerprint(derived.table(s, d, "pages").select((F.col("page_id") % 20).alias("folder"), F.col("url").alias("name"), (F.col("page_id") * 7).alias("mtime"), F.octet_length("html").alias("size"))),
    "a12_record_merge": _record_merge,
    "a13_calendar_bindings": lambda s, d: topology.binding_rows(_calendars(s, d)),
    "u4_discovered": _wired,
    "j2_occurrences": _occurrences,
    "j4_conflict_members": _conflict_members,
    "w7_first_addresses": lambda s, d: logs.first_occurrences(derived.people(s, d), "event", "email", "position"),
    "f11_patterns": _patterns,
    "f11_rules": _rules,
    "f12_split_series": _split,
    "f18_converted": _converted,
    "f24_joint_names": _joint_names,
    "a8_ledger": _ledger,
    "p10_loss_by_kind": _loss_by_kind,
    "a14_links_in_order": lambda s, d: _linked(s, d)[0],
    "a14_index_in_order": lambda s, d: _linked(s, d)[1],
    "j17_converged": _converged,
    "j17_pass_results": _pass_results,
    "j17_second_run": _second_run,
    "u4_policies": _policies,
}

_RULE = """'RRULE:FREQ=' || ['DAILY', 'WEEKLY', 'MONTHLY', 'YEARLY', 'HOURLY'][k % 5 + 1] || CASE WHEN k % 4 > 0 THEN ';INTERVAL=' || (k % 4) ELSE '' END || ['', ';BYDAY=MO', ';BYDAY=TU,2FR'][k % 3 + 1]
  || CASE WHEN k % 7 = 0 THEN ';BYSETPOS=-1' ELSE '' END || CASE WHEN k % 11 = 0 THEN ';BYMONTHDAY=5,9' ELSE '' END || CASE WHEN k % 13 = 0 THEN ';BYMONTH=3' ELSE '' END || CASE WHEN k % 6 = 0 THEN ';COUNT=4' ELSE '' END || CASE WHEN k % 6 = 1 THEN ';UNTIL=20250630T000000Z' ELSE '' END"""

_CHAIN = """WITH a AS (SELECT o_orderkey AS k, o_orderstatus AS v FROM orders WHERE o_orderkey % 2 = 0), b AS (SELECT o_orderkey AS k, o_orderstatus || CASE WHEN o_orderkey % 5 = 0 THEN '!' ELSE '' END AS v FROM orders WHERE o_orderkey % 3 = 0),
  u AS (SELECT k, coalesce(a.v, b.v) AS v, a.k IS NOT NULL AS in_a, b.k IS NOT NULL AS in_b, a.v AS av, b.v AS bv FROM a FULL JOIN b USING (k))"""

_ENTITY = "'ent-' || left(sha256(concat_ws(chr(1), 'one', 'contacts', 'p' || {0}, CAST({0} AS VARCHAR))), 32)"

_CALENDARS = """WITH x AS (SELECT s_suppkey AS k, 'b' || (s_nationkey % 4) AS backend, 'r' || s_suppkey AS remote, ' My Cal ' || (s_suppkey % 17) || CASE WHEN s_suppkey % 2 = 0 THEN ' ' ELSE '' END AS name, 'my cal ' || (s_suppkey % 17) AS calendar FROM supplier WHERE s_suppkey % 17 <> 5),
  n AS (SELECT calendar, arg_min(name, k) AS display_name FROM x GROUP BY 1), h AS (SELECT calendar, backend, arg_min(remote, k) AS remote FROM x GROUP BY 1, 2),
  o AS (SELECT unnest(['b1', 'b0', 'b2', 'b9']) AS backend, unnest(['primary', 'sync1', 'sync2', 'sync3']) AS role, unnest([0, 1, 2, 3]) AS position),
  b AS (SELECT n.calendar, display_name, o.backend, coalesce(h.remote, replace(lower(display_name), ' ', '-')) AS remote, role, position, true AS enabled, h.remote IS NULL AS pending FROM n CROSS JOIN o LEFT JOIN h ON h.calendar = n.calendar AND h.backend = o.backend)"""


def sql(collections: str, log: str) -> dict[str, str]:
    """The queries; the arguments begin those on collections and on the log."""
    return {
        "f11_patterns": """WITH x AS (SELECT p_partkey AS k, ['daily', 'weekly', 'absoluteMonthly', 'relativeMonthly', 'absoluteYearly', 'relativeYearly', 'odd'][p_partkey % 7 + 1] AS t, p_partkey % 31 AS dom, p_partkey % 13 AS m, p_partkey % 12 + 1 AS sm, p_partkey % 28 + 1 AS sd,
      ['', 'MO', 'TU,FR'][p_partkey % 3 + 1] AS days, ['1', '2', '3', '4', '-1', ''][p_partkey % 6 + 1] AS pos FROM part),
      y AS (SELECT *, 'RRULE:FREQ=' || CASE WHEN t = 'daily' THEN 'DAILY' WHEN t = 'weekly' THEN 'WEEKLY' WHEN t LIKE '%Monthly' THEN 'MONTHLY' ELSE 'YEARLY' END || ';INTERVAL=' || greatest(k % 4, 1)
        || CASE WHEN t LIKE '%Yearly' THEN ';BYMONTH=' || CASE WHEN m > 0 THEN m ELSE sm END ELSE '' END || CASE WHEN (t = 'weekly' OR t LIKE 'relative%') AND days <> '' THEN ';BYDAY=' || days ELSE '' END || CASE WHEN t = 'weekly' AND k % 2 = 0 THEN ';WKST=SU' ELSE '' END
        || CASE WHEN t LIKE 'absolute%' THEN ';BYMONTHDAY=' || CASE WHEN dom > 0 THEN dom ELSE sd END ELSE '' END || CASE WHEN t LIKE 'relative%' AND pos <> '' THEN ';BYSETPOS=' || pos ELSE '' END
        || CASE WHEN k % 11 = 0 THEN ';UNTIL=20250630T235959Z' WHEN k % 5 > 0 THEN ';COUNT=' || (k % 5) ELSE '' END AS rule FROM x)
      SELECT k AS p_partkey, CASE WHEN t = 'odd' THEN '' ELSE rule || CASE WHEN k % 9 = 0 THEN '|EXDATE:20240501T080000Z,20240502T0' || (k % 10) || '0000Z' ELSE '' END END AS lines, CASE WHEN t <> 'odd' AND k % 9 = 0 THEN 'blob' ELSE '' END AS unparsed FROM y""",
        "f11_rules": """WITH x AS (SELECT p_partkey AS k, ['DAILY', 'WEEKLY', 'MONTHLY', 'YEARLY', 'HOURLY'][p_partkey % 5 + 1] AS f, p_partkey % 28 + 1 AS sd, ['', '"monday"', '"tuesday","friday"'][p_partkey % 3 + 1] AS days, p_partkey % 7 = 0 AS pos, p_partkey % 11 = 0 AS doms, p_partkey % 13 = 0 AS mon FROM part),
      y AS (SELECT *, CASE WHEN f IN ('DAILY', 'HOURLY') THEN 'daily' WHEN f = 'WEEKLY' THEN 'weekly' WHEN f = 'MONTHLY' THEN CASE WHEN NOT doms AND days <> '' THEN 'relativeMonthly' ELSE 'absoluteMonthly' END WHEN days <> '' AND pos THEN 'relativeYearly' ELSE 'absoluteYearly' END AS t,
        f = 'HOURLY' OR doms OR (f <> 'WEEKLY' AND days <> '' AND NOT pos) AS reduced FROM x),
      z AS (SELECT *, concat_ws(',', CASE WHEN t = 'absoluteMonthly' THEN '"dayOfMonth":' || CASE WHEN doms THEN 5 ELSE sd END WHEN t = 'absoluteYearly' THEN '"dayOfMonth":' || CASE WHEN doms AND mon THEN 5 ELSE sd END END,
          CASE WHEN t LIKE 'relative%' OR (t = 'weekly' AND days <> '') THEN '"daysOfWeek":[' || days || ']' END, CASE WHEN t LIKE 'relative%' THEN '"index":"' || CASE WHEN pos THEN 'last' ELSE 'first' END || '"' END, '"interval":' || greatest(k % 4, 1),
          CASE WHEN t = 'absoluteYearly' THEN '"month":' || CASE WHEN doms AND mon THEN 3 ELSE 2 END WHEN t = 'relativeYearly' THEN '"month":' || CASE WHEN mon THEN 3 ELSE 2 END END, '"type":"' || t || '"') AS p,
        concat_ws(',', CASE WHEN k % 6 = 1 THEN '"endDate":"2025-06-30"' END, CASE WHEN k % 6 = 0 THEN '"numberOfOccurrences":4' END, '"startDate":"2024-02-' || lpad(CAST(sd AS VARCHAR), 2, '0') || '"', '"type":"' || CASE k % 6 WHEN 0 THEN 'numbered' WHEN 1 THEN 'endDate' ELSE 'noEnd' END || '"') AS r FROM y)
      SELECT k AS p_partkey, '{"pattern":{' || p || '},"range":{' || r || '}}' AS pattern, concat_ws('|', CASE WHEN reduced THEN """ + _RULE + """ END, CASE WHEN k % 10 = 0 THEN 'RDATE:20240601' END) AS carried, CASE WHEN k % 8 = 0 THEN '2024-05-01T08:00:00Z|20240502' ELSE '' END AS cancelled FROM z""",
        "f12_split_series": """WITH x AS (SELECT o_orderkey AS k, 'o' || o_orderkey AS uid, o_orderdate AS s, o_orderdate + INTERVAL 10 DAY AS cut, o_orderdate + to_days(CAST(o_orderkey % 20 AS INTEGER)) AS rid, strftime(o_orderdate + INTERVAL 10 DAY, '%Y%m%dT%H%M%SZ') AS stamp,
        CASE WHEN o_orderkey % 11 = 0 THEN 'no master' WHEN o_orderkey % 5 = 0 THEN 'count-bounded' WHEN o_orderkey % 7 = 0 THEN 'no rule' END AS error FROM orders),
      y AS (SELECT *, CASE WHEN k % 3 = 0 THEN 'RRULE:FREQ=DAILY;UNTIL=' || CASE WHEN k % 2 = 0 THEN '19000101' ELSE '20990101' END || ';INTERVAL=2' WHEN k % 4 = 0 THEN 'RRULE:FREQ=DAILY;UNTIL=20990101T000000Z' ELSE 'RRULE:FREQ=DAILY' END AS rule,
        CASE WHEN k % 3 = 0 THEN 'RRULE:FREQ=DAILY;UNTIL=' || CASE WHEN k % 2 = 0 THEN '19000101' ELSE strftime(cut - INTERVAL 1 DAY, '%Y%m%d') END || ';INTERVAL=2' WHEN k % 8 = 1 THEN 'RRULE:FREQ=DAILY;UNTIL=' || strftime(cut - INTERVAL 1 DAY, '%Y%m%d') ELSE 'RRULE:FREQ=DAILY;UNTIL=' || strftime(cut - INTERVAL 1 SECOND, '%Y%m%dT%H%M%SZ') END AS tight FROM x),
      w AS (SELECT *, CASE WHEN k % 8 = 1 THEN '{"allDay":true,"date":"' || strftime(s, '%Y-%m-%d') || '"}' ELSE '{"dateTime":"' || strftime(s, '%Y-%m-%dT%H:%M:%SZ') || '","tz":"Europe/Paris"}' END AS begun,
        CASE WHEN k % 8 = 1 THEN '{"allDay":true,"date":"' || strftime(cut, '%Y-%m-%d') || '"}' ELSE '{"dateTime":"' || strftime(cut, '%Y-%m-%dT%H:%M:%SZ') || '","tz":"Europe/Paris"}' END AS moved FROM y)
      SELECT uid, 'old' AS part, '{"recurrence":["' || tight || '","RDATE:20240102"],"start":' || begun || ',"uid":"' || uid || '"}' AS data, CAST(NULL AS VARCHAR) AS error FROM w WHERE error IS NULL
      UNION ALL SELECT uid, 'new', '{"recurrence":["' || rule || '"],"seriesSplitOf":"' || uid || '","start":' || moved || ',"uid":"' || uid || '-split-' || stamp || '"}', NULL FROM w WHERE error IS NULL
      UNION ALL SELECT uid, 'exception', '{"recurrenceId":{"dateTime":"' || strftime(rid, '%Y-%m-%dT%H:%M:%SZ') || '"},"uid":"' || uid || CASE WHEN error IS NULL AND rid >= cut THEN '-split-' || stamp ELSE '' END || '"}', NULL FROM w
      UNION ALL SELECT uid, 'error', NULL, error FROM w WHERE error IS NOT NULL""",
        "f18_converted": """SELECT p_partkey, CASE WHEN p_partkey % 3 = 0 THEN 'x ' ELSE '' END || p_name || ' due:2024-05-' || lpad(CAST(p_partkey % 28 + 1 AS VARCHAR), 2, '0') || ' +home' AS data, 'description:dropped,links:dropped,status:simplified' AS lost FROM part""",
        "f24_joint_names": """WITH o AS (SELECT o_orderkey AS k, 'c' || o_custkey AS customer, 'c' || (o_custkey % 50 + 1) AS clerk FROM orders),
      f AS (SELECT 0 AS t, k, 0 AS c, customer AS v FROM o UNION ALL SELECT 0, k, 1, clerk FROM o UNION ALL SELECT 1, c_custkey, 0, 'c' || c_custkey FROM customer),
      n AS (SELECT v, 'p' || row_number() OVER (ORDER BY min((t, k, c)), v) || '@example.com' AS name FROM f GROUP BY v)
      SELECT 'order' AS of, k, x.name AS customer, y.name AS clerk FROM o JOIN n x ON x.v = customer JOIN n y ON y.v = clerk UNION ALL SELECT 'customer', c_custkey, name, NULL FROM customer JOIN n ON v = 'c' || c_custkey""",
        "a8_ledger": """WITH e AS (SELECT 'd' || (p_partkey % 4) AS domain, 'canon -> e' || (p_partkey // 4 % 3) AS edge, CASE WHEN p_partkey % 4 <> 3 THEN CASE p_partkey % 5 WHEN 0 THEN 'task' WHEN 1 THEN 'note' END END AS kind,
        CASE WHEN p_partkey % 4 <> 3 THEN 'p' || (p_partkey // 12 % 5) END AS property, ['reversible', 'degraded', 'simplified', 'dropped'][p_partkey // 12 % 4 + 1] AS loss FROM part),
      i AS (SELECT domain, edge, string_agg(DISTINCT kind, ', ' ORDER BY kind) AS kinds, count(property) AS lost FROM e GROUP BY 1, 2),
      inv AS (SELECT domain, string_agg('- ' || edge || CASE WHEN lost > 0 OR kinds IS NOT NULL THEN ' (' || concat_ws('; ', CASE WHEN lost > 0 THEN 'lossy' END, 'by kind: default, ' || kinds) || ')' ELSE '' END, chr(10) ORDER BY edge) AS lines FROM i GROUP BY 1),
      r AS (SELECT e.domain, e.edge, e.kind, '### ' || e.edge || CASE WHEN max(kinds) IS NOT NULL THEN ' (' || coalesce(e.kind, 'default') || ')' ELSE '' END || chr(10) || chr(10) || '| property | loss |' || chr(10) || '|---|---|' || chr(10)
        || string_agg(DISTINCT '| ' || property || ' | ' || loss || ' |', chr(10) ORDER BY '| ' || property || ' | ' || loss || ' |') AS part FROM e JOIN i ON i.domain = e.domain AND i.edge = e.edge WHERE property IS NOT NULL GROUP BY e.domain, e.edge, e.kind),
      b AS (SELECT domain, string_agg(part, chr(10) || chr(10) ORDER BY edge, coalesce(kind, '')) AS body FROM r GROUP BY 1)
      SELECT inv.domain, '## ' || inv.domain || chr(10) || chr(10) || lines || chr(10) || chr(10) || coalesce(body, 'No declared losses.') || chr(10) AS text FROM inv LEFT JOIN b ON b.domain = inv.domain""",
        "p10_loss_by_kind": """SELECT 'm' || (o_orderkey % 8) AS mapping_id, o_orderkey AS id, CASE WHEN o_orderkey % 3 = 0 THEN 'priority' ELSE 'status' END AS lost FROM orders
      WHERE o_orderkey % 17 <> 0 AND o_orderkey % 19 <> 0 AND ((o_orderkey % 3 = 0 AND o_orderpriority <> '5-LOW') OR o_orderkey % 3 = 2)""",
        "a14_links_in_order": f"""SELECT 'contacts' AS domain, 'p' || k AS record, CASE WHEN k % 10 IN (4, 5, 6) AND bridged THEN {_ENTITY.format('CAST(k // 10 * 10 + 3 AS BIGINT)')} ELSE {_ENTITY.format('k')} END AS entity,
      CASE WHEN k % 10 <> 4 OR k % 20 = 4 THEN 'one-' || k ELSE 'two-' || k END AS name
      FROM (SELECT c_custkey AS k, c_custkey // 10 * 10 + 5 <= (SELECT max(c_custkey) FROM customer) AS bridged FROM customer)""",
        "a14_index_in_order": f"""SELECT 'c' || k || '@x' AS email, CASE WHEN k % 10 IN (4, 5, 6) AND bridged THEN {_ENTITY.format('CAST(k // 10 * 10 + 3 AS BIGINT)')} ELSE {_ENTITY.format('k')} END AS entity
      FROM (SELECT c_custkey AS k, c_custkey // 10 * 10 + 5 <= (SELECT max(c_custkey) FROM customer) AS bridged FROM customer)""",
        "j17_converged": _CHAIN + " SELECT e.endpoint, CAST(k AS VARCHAR) AS id, v AS data FROM u CROSS JOIN (SELECT unnest(['A', 'B', 'C']) AS endpoint) e",
        "j17_pass_results": _CHAIN + """, w AS (SELECT 1 AS pass, 'm1' AS mapping_id, 'target' AS side, 'create' AS a, 0 AS c FROM u WHERE in_b UNION ALL SELECT 1, 'm2', 'target', 'create', 0 FROM u WHERE NOT in_b UNION ALL SELECT 1, 'm2', 'source', 'create', 0 FROM u WHERE NOT in_a
        UNION ALL SELECT 1, 'm2', 'target', 'update', 1 FROM u WHERE in_a AND in_b AND av <> bv UNION ALL SELECT 2, 'm1', 'target', 'create', 0 FROM u WHERE NOT in_b UNION ALL SELECT 2, 'm1', 'target', 'update', 0 FROM u WHERE in_a AND in_b AND av <> bv)
      SELECT pass, mapping_id, side, count(*) FILTER (a = 'create') AS created, count(*) FILTER (a = 'update') AS updated, CAST(0 AS BIGINT) AS deleted, CAST(sum(c) AS BIGINT) AS conflicts FROM w GROUP BY ALL""",
        "j17_second_run": _CHAIN + """, x AS (SELECT k, k % 7 = 0 AS gone, k % 11 = 0 AND v <> 'edited' AS edited FROM u),
      w AS (SELECT 1 AS pass, 'm2' AS mapping_id, 'target' AS side, 'delete' AS a FROM x WHERE gone UNION ALL SELECT 1, 'm1', 'source', 'update' FROM x WHERE edited
        UNION ALL SELECT 2, 'm2', 'source', 'update' FROM x WHERE edited AND NOT gone UNION ALL SELECT 2, 'm1', 'target', 'delete' FROM x WHERE gone)
      SELECT pass, mapping_id, side, count(*) FILTER (a = 'create') AS created, count(*) FILTER (a = 'update') AS updated, count(*) FILTER (a = 'delete') AS deleted, CAST(0 AS BIGINT) AS conflicts FROM w GROUP BY ALL""",
        "u4_policies": BINDINGS + """, w AS (SELECT *, ['manual', 'star', 'mirror', 'chain', 'chain'][calendar % 5 + 1] AS wiring FROM m WHERE calendar % 7 <> 3)
      SELECT 'auto_' || x.calendar || '_' || CASE x.wiring WHEN 'star' THEN y.role ELSE x.wiring || '_' || x.backend || '_' || y.backend END AS id, x.calendar, x.backend AS first, y.backend AS second FROM w x JOIN w y ON x.calendar = y.calendar
      WHERE CASE x.wiring WHEN 'star' THEN x.place = 1 AND y.place > 1 WHEN 'mirror' THEN x.place < y.place WHEN 'chain' THEN y.place = x.place + 1 ELSE false END""",
        "a1_run_stats": collections + """, x AS (SELECT *, id % 23 <> 1 AND id % 29 <> 2 AS good FROM plan),
          r AS (SELECT mapping_id, side, CASE WHEN NOT good THEN 'errors' ELSE action END AS what FROM x UNION ALL SELECT mapping_id, unnest(['source', 'target']), 'same' FROM diff WHERE s AND t AND op IS NULL
            UNION ALL SELECT mapping_id, replace(direction, 'to_', ''), 'conflict' FROM diff WHERE op = 'conflict'),
          c AS (SELECT mapping_id, side, count(*) FILTER (what = 'create') AS created, count(*) FILTER (what = 'update') AS updated, count(*) FILTER (what = 'delete') AS deleted, count(*) FILTER (what = 'same') AS unchanged,
            count(*) FILTER (what = 'conflict') AS conflicts, count(*) FILTER (what = 'errors') AS errors FROM r GROUP BY ROLLUP (mapping_id, side))
          SELECT *, '+' || created || ' ~' || updated || ' -' || deleted || ' =' || unchanged || ' !' || conflicts || ' E' || errors AS summary FROM c""",
        "a3_bucketed_revisions": """WITH leaves AS (SELECT o_orderkey % 40 AS mapping_id, left(sha256(CAST(o_orderkey AS VARCHAR)), 4) AS bucket, sha256(string_agg(o_orderkey || chr(31) || (o_custkey % 10) || chr(30), '' ORDER BY CAST(o_orderkey AS VARCHAR))) AS digest FROM orders GROUP BY 1, 2)
          SELECT mapping_id, sha256(string_agg(bucket || chr(31) || digest || chr(30), '' ORDER BY bucket)) AS digest FROM leaves GROUP BY 1""",
        "a4_bucketed_fingerprint": """WITH f AS (SELECT page_id % 20 AS folder, url, (page_id * 7) || '|' || strlen(html) AS line FROM pages),
          leaves AS (SELECT folder, left(sha256(url), 4) AS bucket, sha256(string_agg(url || chr(31) || line || chr(30), '' ORDER BY url, line)) AS digest FROM f GROUP BY 1, 2)
          SELECT folder, sha256(string_agg(bucket || chr(31) || digest || chr(30), '' ORDER BY bucket)) AS digest FROM leaves GROUP BY 1""",
        "a12_record_merge": log + """, old AS (SELECT * FROM log WHERE datetime < TIMESTAMP '2024-01-10' QUALIFY row_number() OVER (PARTITION BY uid ORDER BY datetime DESC, app_id, seq) = 1),
          live AS (SELECT *, row_number() OVER (PARTITION BY uid ORDER BY datetime DESC, app_id, seq) AS place FROM per WHERE value IS NOT NULL),
          p AS (SELECT uid, place, 'kind' AS property, value FROM live UNION ALL SELECT uid, place, 'place', 'room' || (seq % 3) FROM live UNION ALL SELECT uid, place, 'note', 'n' || app_id FROM live WHERE seq % 5 = 0),
          b AS (SELECT uid, 'kind' AS property, value FROM old WHERE value IS NOT NULL UNION ALL SELECT uid, 'place', 'room' || (seq % 3) FROM old WHERE value IS NOT NULL UNION ALL SELECT uid, 'note', 'n' || app_id FROM old WHERE value IS NOT NULL AND seq % 5 = 0),
          c AS (SELECT l.uid, k.property, l.place, coalesce(p.value, '') AS v FROM live l CROSS JOIN (SELECT unnest(['kind', 'place', 'note']) AS property) k LEFT JOIN p ON p.uid = l.uid AND p.place = l.place AND p.property = k.property
            LEFT JOIN b ON b.uid = l.uid AND b.property = k.property WHERE coalesce(p.value, '') <> coalesce(b.value, '')),
          w AS (SELECT uid, property, count(DISTINCT v) AS changes, arg_min(v, place) AS v, min(place) AS place FROM c GROUP BY 1, 2),
          m AS (SELECT uid, max(changes) AS most, arg_max(place, property) FILTER (changes > 1) AS place FROM w GROUP BY 1),
          o AS (SELECT u.uid, CASE WHEN n.writers IS NULL THEN CASE WHEN old.uid IS NOT NULL THEN 'deletion' END WHEN n.writers = 1 OR old.uid IS NULL OR m.most IS NULL THEN 'unchanged' WHEN m.most = 1 THEN 'merged' ELSE 'conflict' END AS outcome, m.place
            FROM (SELECT DISTINCT uid FROM per) u LEFT JOIN (SELECT uid, count(*) AS writers FROM live GROUP BY 1) n ON n.uid = u.uid LEFT JOIN old ON old.uid = u.uid LEFT JOIN m ON m.uid = u.uid),
          k AS (SELECT uid, property FROM p UNION SELECT uid, property FROM b),
          r AS (SELECT k.uid, k.property, CASE WHEN o.outcome = 'merged' AND w.uid IS NOT NULL THEN w.v ELSE p.value END AS value FROM k JOIN o ON o.uid = k.uid LEFT JOIN w ON w.uid = k.uid AND w.property = k.property
            LEFT JOIN p ON p.uid = k.uid AND p.property = k.property AND p.place = CASE WHEN o.outcome = 'conflict' THEN o.place ELSE 1 END WHERE o.outcome <> 'deletion')
          SELECT o.uid, o.outcome, r.property, r.value FROM o LEFT JOIN (SELECT * FROM r WHERE value <> '') r ON r.uid = o.uid WHERE o.outcome IS NOT NULL""",
        "a13_calendar_bindings": _CALENDARS + " SELECT calendar, display_name, backend, remote, role, CAST(position AS INTEGER) AS position, enabled, pending FROM b",
        "u4_discovered": _CALENDARS + " SELECT 'auto_' || calendar || '_' || role AS id, calendar, 'b1' AS first, backend AS second FROM b WHERE position > 0",
        "j2_occurrences": """WITH x AS (SELECT 'm' || (conv_id % 4) AS mapping_id, conv_id || CASE WHEN turn > 0 THEN chr(1) || strftime(TIMESTAMP '2024-01-01' + to_days(CAST(turn AS INTEGER)), '%Y-%m-%dT%H:%M:%SZ') ELSE '' END AS id, conv_id AS c, turn AS t,
            turn % 5 <> 4 AS s, (conv_id + turn) % 6 <> 1 AS g, turn <> 2 AS b, CASE WHEN (conv_id + turn) % 9 <> 5 THEN role || ' ' || turn END AS v FROM conversations),
          y AS (SELECT *, CASE WHEN s THEN {'v': CASE WHEN c % 7 = 0 THEN 'new' ELSE v END} END AS sv, CASE WHEN g THEN {'v': CASE WHEN c % 5 = 0 THEN 't' || (c % 2) ELSE v END} END AS tv, CASE WHEN b THEN {'v': v} END AS bv FROM x WHERE s OR g OR b)
          SELECT mapping_id, id, CASE WHEN sv IS NOT DISTINCT FROM tv OR (sv IS NOT DISTINCT FROM bv AND tv IS NOT DISTINCT FROM bv) THEN 'unchanged'
            WHEN sv IS DISTINCT FROM bv AND tv IS DISTINCT FROM bv THEN 'conflict_' || CASE WHEN NOT b THEN 'both_created' WHEN NOT s OR NOT g THEN 'modify_delete' ELSE 'both_modified' END
            WHEN sv IS DISTINCT FROM bv THEN CASE WHEN NOT s THEN 'delete' WHEN NOT g THEN 'create' ELSE 'update' END || '_target' ELSE CASE WHEN NOT g THEN 'delete' WHEN NOT s THEN 'create' ELSE 'update' END || '_source' END AS outcome FROM y""",
        "j4_conflict_members": collections + """, x AS (SELECT mapping_id, CASE direction WHEN 'to_target' THEN 'source' ELSE 'target' END AS side, id, sha256(split_part(CASE direction WHEN 'to_target' THEN sd ELSE td END, 'STATUS:', 2)) AS digest FROM diff WHERE op = 'create')
          SELECT x.mapping_id, digest, side, id FROM x WHERE EXISTS (SELECT 1 FROM x y WHERE y.mapping_id = x.mapping_id AND y.digest = x.digest AND y.side <> x.side)""",
        "w7_first_addresses": """SELECT o_orderkey AS event, CAST(unnest([0, 2, 3]) AS INTEGER) AS position, unnest(['c' || o_custkey || '@example.com', 'c' || (o_custkey + 1) || '@example.com', 'x' || o_custkey || '@example.com']) AS email FROM orders""",
    }
