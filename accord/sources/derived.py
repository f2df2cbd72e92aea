"""Collections, logs and canon records derived from the star-schema tables, for the registered queries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread(df: DataFrame) -> DataFrame:
    """df dealt over all cores, where rows cost much: a scan has a task for each 128 MB of a file, so one or a few for tables of short rows."""
    return df.repartition(4 * df.sparkSession.sparkContext.defaultParallelism)


def _payload(status: Column) -> Column:
    return F.concat(F.lit("UID:"), "o_orderkey", F.lit(";STATUS:"), status)


def _record(orders: DataFrame, status: Column, payload: Column, modified: Column) -> DataFrame:
    mapping = F.concat(F.lit("m"), F.col("o_orderkey") % 8)
    return orders.select(mapping.alias("mapping_id"), F.col("o_orderkey").alias("id"), _payload(status).alias("data"), F.sha2(payload, 256).alias("hash"), modified.alias("last_modified"))


def collections(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """source, target: mapping_id, id, data, hash, last_modified; baseline: mapping_id, id, source_hash, target_hash, data."""
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus", "o_orderpriority", "o_orderdate")
    k = F.col("o_orderkey")
    days = lambda n: F.col("o_orderdate") + F.make_interval(days=n)
    own = lambda status: F.concat_ws("|", k, status, "o_orderpriority")
    other = lambda status: F.concat_ws("|", "o_orderpriority", status, k)
    s = F.when(k % 7 == 0, "S").otherwise(F.col("o_orderstatus"))
    t = F.when(k % 5 == 0, "T").otherwise(F.col("o_orderstatus"))
    source = _record(orders.where(k % 11 != 0), s, own(s), days(F.when(k % 7 == 0, 2).otherwise(0)))
    target = _record(orders.where(k % 13 != 0), t, other(t), days(F.when(k % 5 == 0, (k % 3).cast("int")).otherwise(0)))
    agreed = F.col("o_orderstatus")
    baseline = orders.where(k % 10 != 9).select(F.concat(F.lit("m"), k % 8).alias("mapping_id"), k.alias("id"), F.sha2(own(agreed), 256).alias("source_hash"), F.sha2(other(agreed), 256).alias("target_hash"), _payload(agreed).alias("data"))
    return source, target, baseline


def log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """uid, app_id, datetime, seq, value: an operation log; a null value is a tombstone."""
    e = table(spark, sf_dir, "events")
    app = F.concat(F.lit("app"), F.col("event_id") % 4)
    dead = (F.col("event_type") == "error") | (F.col("user_id") % 25 == 0)
    rows = e.select(F.col("user_id").alias("uid"), app.alias("app_id"), F.col("ts").alias("datetime"), F.col("event_id").alias("seq"), F.when(~dead, F.col("event_type")).alias("value"))
    return rows.where(~((F.col("uid") % 25 == 1) & (F.col("app_id") != "app0")))


def property_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """uid, app_id, datetime, seq, property, value: the log with records of two or three properties."""
    pair = lambda name, value: F.struct(F.lit(name).alias("property"), value.alias("value"))
    note = F.when(F.col("seq") % 5 == 0, pair("note", F.concat(F.lit("n"), "app_id")))
    own = F.array_compact(F.array(pair("kind", F.col("value")), pair("place", F.concat(F.lit("room"), F.col("seq") % 3)), note))
    dead = F.array(pair(None, F.col("value")))
    return log(spark, sf_dir).withColumn("p", F.explode(F.when(F.col("value").isNull(), dead).otherwise(own))).select("uid", "app_id", "datetime", "seq", "p.*")


def contacts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """record, email: address edges of contacts."""
    k = F.col("c_custkey")
    shared = F.array_compact(F.array(k, F.when(k % 10 == 1, k - 1), F.when(k % 50 == 2, k - 1), F.when(k % 50 == 2, k - 2)))
    rows = table(spark, sf_dir, "customer").select(k.alias("record"), F.explode(F.array_distinct(shared)).alias("n"))
    return rows.select("record", F.concat(F.lit("c"), "n", F.lit("@example.com")).alias("email"))


def people(spark: SparkSession, sf_dir: str) -> DataFrame:
    """event, position, email: the organizer and the attendees of events, some of them twice."""
    k = F.col("o_custkey")
    address = lambda n: F.concat(F.lit("c"), n, F.lit("@example.com"))
    listed = F.array(address(k), F.upper(address(k)), address(k + 1), F.concat(F.lit("x"), k, F.lit("@example.com")))
    return table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("event"), F.posexplode(listed).alias("position", "email"))


def families(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """existing and staged rows: uid, slot ('' is the master), seq, data."""
    c = table(spark, sf_dir, "conversations")
    slot = F.when(F.col("turn") == 0, "").otherwise(F.lpad(F.col("turn").cast("string"), 6, "0"))
    rows = c.select(F.col("conv_id").alias("uid"), slot.alias("slot"), F.col("turn").cast("long").alias("seq"), F.col("role").alias("data"))
    staged = rows.where("uid % 3 = 0 and seq % 2 = 1").withColumns({"data": F.concat(F.lit("staged-"), "data"), "seq": F.col("seq") + 1_000_000})
    return rows, staged


def canon(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """source, target, baseline: uid, body, category of canon notes, bodies whole."""
    d = table(spark, sf_dir, "documents")
    k, body, category = F.col("doc_id"), F.col("text"), F.col("lang")
    source = d.select(k.alias("uid"), F.when(k % 7 == 0, F.concat(F.lit("s"), body)).otherwise(body).alias("body"), category.alias("category"))
    target = d.select(k.alias("uid"), F.when(k % 35 == 0, F.concat(F.lit("t"), body)).otherwise(body).alias("body"), F.when(k % 5 == 0, "changed").otherwise(category).alias("category"))
    return source, target, d.select(k.alias("uid"), body.alias("body"), category.alias("category"))


def tasks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """mapping_id, id, last_modified, data: canon JSON of tasks; some payloads are no JSON, or no object."""
    o, k = spread(table(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus", "o_orderpriority", "o_orderdate")), F.col("o_orderkey")
    text = F.format_string(
        '{"uid":"o%d","status":"%s","priority":"%s","categories":["c%d","c%d"],"providerExtras":{"etag":"e%d","tag":"t%d"}}',
        k, "o_orderstatus", "o_orderpriority", k % 3, k % 5, k, k % 4,
    )
    data = F.when(k % 17 == 0, "{broken").when(k % 19 == 0, "[1]").otherwise(text)
    return o.select(F.concat(F.lit("m"), k % 8).alias("mapping_id"), k.alias("id"), F.col("o_orderdate").alias("last_modified"), data.alias("data"))


def calendar(spark: SparkSession, sf_dir: str) -> DataFrame:
    """uid, data: calendar texts with time zones, folded lines, repeated properties and nested alarms."""
    o, k = spread(table(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus", "o_orderdate")), F.col("o_orderkey")
    kind = F.element_at(F.array(F.lit("VEVENT"), F.lit("VTODO"), F.lit("VFREEBUSY"), F.lit("VJOURNAL")), (k % 4 + 1).cast("int"))
    zone = F.when(k % 2 == 0, "BEGIN:VTIMEZONE\r\nTZID:Europe/Paris\r\nRRULE:FREQ=YEARLY\r\nEND:VTIMEZONE\r\n").otherwise("")
    own = F.format_string("UID:o%d\r\nSUMMARY;LANGUAGE=en:Order %d fol\r\n ded\r\nDTSTART;TZID=Europe/Paris:%sT080000\r\nSTATUS:%s\r\n", k, k, F.date_format("o_orderdate", "yyyyMMdd"), "o_orderstatus")
    rest = F.lit("RRULE:FREQ=DAILY;COUNT=3\r\nEXDATE:20240101\r\nEXDATE:20240102\r\nBEGIN:VALARM\r\nTRIGGER:-PT15M\r\nEND:VALARM\r\n")
    text = F.concat(F.lit("BEGIN:VCALENDAR\r\n"), zone, F.lit("BEGIN:"), kind, F.lit("\r\n"), own, rest, F.lit("END:"), kind, F.lit("\r\nEND:VCALENDAR\r\n"))
    return o.select(F.concat(F.lit("o"), k).alias("uid"), text.alias("data"))


def conflict_store(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """A store of conflicts (id, mapping_id, uid, detected_at, decision, resolved_at, applied_at), and new ones (mapping_id, uid, detected_at)."""
    e, k = table(spark, sf_dir, "events").where("event_id % 5 = 0"), F.col("event_id")
    mapping = F.when(k % 15 != 0, F.concat(F.lit("m"), k % 4))
    done, applied = k % 10 == 0, k % 20 == 0
    store = e.select(
        F.concat(F.lit("x"), k).alias("id"), mapping.alias("mapping_id"), F.concat(F.lit("u"), k).alias("uid"), F.col("ts").alias("detected_at"),
        F.when(done, "source").alias("decision"), F.when(done, F.col("ts")).alias("resolved_at"), F.when(applied, F.col("ts")).alias("applied_at"),
    )
    new = e.where("event_id % 25 = 0").select(mapping.alias("mapping_id"), F.concat(F.lit("u"), k).alias("uid"), (F.col("ts") + F.expr("interval 1 day")).alias("detected_at"))
    return store, new


def bindings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """calendar, display_name, backend, remote, role, enabled, position: calendars bound to suppliers, some of them twice."""
    s = table(spark, sf_dir, "supplier")
    k = F.col("s_suppkey")
    role = F.when(k % 9 == 0, "primary").when(k % 5 == 0, "readonly").otherwise(F.concat(F.lit("sync"), k % 7))
    rows = s.select(F.col("s_nationkey").alias("calendar"), F.when(F.col("s_nationkey") % 6 != 0, F.concat(F.lit("n"), "s_nationkey")).otherwise("").alias("display_name"), k.alias("backend"), (k % 2).alias("remote"), role.alias("role"), (k % 4 != 0).alias("enabled"), k.cast("int").alias("position"))
    again = rows.where("backend % 3 = 0").withColumns({"role": F.lit("sync9"), "position": F.col("position") + 1000})
    return rows.unionByName(again)
