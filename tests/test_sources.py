"""Readers and sinks on files, feeds and logs as streams, guards and paths on hand-written cases."""

import hashlib

import pytest
from pyspark.sql import functions as F

from accord.operators import loss, reconcile, store, topology, views
from accord.sources import records
from accord.streaming import feed


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def test_records_are_read_with_hashes(spark, tmp_path):
    (tmp_path / "notes").mkdir()
    (tmp_path / "notes" / "a.md").write_text("Body")
    got = records.read_records(spark, str(tmp_path / "notes"), "files").first()
    assert (got.id, got.data, got.content_hash, got.display_name, got.is_deleted) == ("a.md", "Body", sha("Body"), "a.md", False)
    spark.createDataFrame([("1", "x", ""), ("2", "y", "h")], "id string, data string, content_hash string").write.parquet(str(tmp_path / "p"))
    assert {(r.id, r.content_hash) for r in records.read_records(spark, str(tmp_path / "p")).collect()} == {("1", sha("x")), ("2", "h")}
    with pytest.raises(Exception, match="PATH_NOT_FOUND"):
        records.read_records(spark, str(tmp_path / "missing"))
    with pytest.raises(ValueError, match="empty"):
        records.require_nonempty(spark.createDataFrame([], "id string"))


def test_hub_keeps_shapes_apart(spark, tmp_path):
    rows = [("c1", "a\x01b", "todo", "canon", "x"), ("c2", "a", "note", "canon", "y")]
    df = spark.createDataFrame(rows, "collection_id string, id string, domain string, encoding string, data string")
    df = df.withColumns({"content_hash": F.sha2("data", 256), "last_modified": F.lit(None).cast("timestamp")})
    records.write_hub(df, str(tmp_path / "hub"))
    records.write_hub(df.where("domain = 'note'").withColumn("data", F.lit("z")), str(tmp_path / "hub"))
    read = lambda domain: [(r.collection_id, r.id, r.data) for r in records.read_hub(spark, str(tmp_path / "hub"), domain, "canon").collect()]
    assert read("todo") == [("c1", "a\x01b", "x")] and read("note") == [("c2", "a", "z")]


def test_operation_log_files(spark, tmp_path):
    folder = tmp_path / "log" / "app-x"
    folder.mkdir(parents=True)
    lines = ['[["feeds","a"],"2024-01-01T00:00:00","k",{"b":1,"a":2}]', "broken", '[["feeds"],"t",1,null]', '["x","t","k",1]', '[["p"],"t","k"]']
    (folder / "3f").write_text("\n".join(lines) + "\n")
    got = sorted((r.app_id, r.bucket, r.line, tuple(r.path), r.datetime, r.key, r.value) for r in records.read_oplog(spark, str(tmp_path / "log")).collect())
    assert got == [("app-x", "3f", 0, ("feeds", "a"), "2024-01-01T00:00:00", '"k"', '{"a":2,"b":1}'), ("app-x", "3f", 2, ("feeds",), "t", "1", None)]
    line = spark.range(1).select(records.oplog_line(F.array(F.lit("a"), F.lit('q"')), F.lit("t"), F.lit('"k"'), F.lit(None).cast("string")).alias("x")).first().x
    assert line == '[["a","q\\""],"t","k",null]'


def batches(spark, path, rows):
    """One more file for a file stream."""
    spark.createDataFrame(rows, "id string, seq int, deleted boolean, data string").coalesce(1).write.mode("append").parquet(path)


def test_feed_keeps_tombstones(spark, tmp_path):
    source, state, check = (str(tmp_path / n) for n in ("in", "state", "check"))
    schema = "id string, seq int, deleted boolean, data string"

    def run():
        feed.apply_feed(spark.readStream.schema(schema).parquet(source), state, check, "id", "seq").awaitTermination()
        held = feed.read_state(spark, state, spark.createDataFrame([], schema).schema, "id", "seq")
        return sorted((r.id, r.seq, r.data) for r in feed.view(held).collect())

    batches(spark, source, [("a", 1, False, "a1"), ("b", 1, False, "b1"), ("b", 2, False, "b2")])
    assert run() == [("a", 1, "a1"), ("b", 2, "b2")]
    batches(spark, source, [("a", 11, True, None)])
    assert run() == [("b", 2, "b2")]
    batches(spark, source, [("a", 5, False, "late"), ("b", 1, False, "older")])
    assert run() == [("b", 2, "b2")]
    assert run() == [("b", 2, "b2")]  # nothing new: the token stays


def test_full_refresh_forgets(spark, tmp_path):
    source, state = str(tmp_path / "in"), str(tmp_path / "state")
    batches(spark, source, [("a", 1, False, "a1")])
    stream = lambda: spark.readStream.schema("id string, seq int, deleted boolean, data string").parquet(source)
    feed.apply_feed(stream(), state, str(tmp_path / "c1"), "id", "seq").awaitTermination()
    feed.apply_feed(stream().where("id <> 'a'"), state, str(tmp_path / "c2"), "id", "seq", full_refresh=True).awaitTermination()
    held = feed.read_state(spark, state, spark.createDataFrame([], "id string, seq int, deleted boolean, data string").schema, "id", "seq")
    assert held.count() == 0


def test_merge_feed_ties(spark):
    make = lambda rows: spark.createDataFrame(rows, "id string, seq int, deleted boolean, data string")
    got = feed.merge_feed(make([("a", 1, False, "x"), ("n", None, False, "x")]), make([("a", 1, True, None), ("n", 1, False, "y")]), "id", "seq").collect()
    assert sorted((r.id, r.deleted, r.data) for r in got) == [("a", True, None), ("n", False, "y")]


def test_latest_state_stream(spark, tmp_path):
    source = str(tmp_path / "in")
    seen = []

    def run():
        stream = feed.lww_stream(spark.readStream.schema("id string, seq int, deleted boolean, data string").parquet(source), "id", "seq", "data")
        stream.writeStream.outputMode("update").foreachBatch(lambda df, _: seen.append(sorted(map(tuple, df.collect())))).option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start().awaitTermination()

    batches(spark, source, [("a", 3, False, "a3"), ("a", 2, False, "a2"), ("b", 1, False, "b1")])
    run()
    batches(spark, source, [("a", 1, False, "late"), ("b", 4, False, "b4")])
    run()
    assert [x for x in seen if x] == [[("a", 3, "a3"), ("b", 1, "b1")], [("b", 4, "b4")]]


def test_tokens_advance_after_success(spark):
    make = lambda rows: spark.createDataFrame(rows, "mapping_id string, side string, token string")
    stored, fetched = make([("m1", "source", "s0"), ("m2", "source", "s0")]), make([("m1", "source", "s1"), ("m2", "source", "s1"), ("m1", "target", "t1")])
    done = spark.createDataFrame([("m1", True), ("m2", False)], "mapping_id string, ok boolean")
    got = {tuple(r) for r in feed.advance_tokens(stored, fetched, make([("m1", "target", "t2")]), done).collect()}
    assert got == {("m1", "source", "s1"), ("m2", "source", "s0"), ("m1", "target", "t2")}


def test_catalogue_schema():
    got = views.catalogue_schema([("uid", "String", False), ("tags", "StringList", True)])
    assert got.simpleString() == "struct<uid:string,tags:array<string>>" and [f.nullable for f in got] == [False, True]


def test_feed_rows_modified_since(spark):
    df = spark.createDataFrame([(1, "2024-01-01"), (2, "2024-01-02")], "id int, d string").select("id", F.to_timestamp("d").alias("last_modified"))
    since = F.lit("2024-01-02").cast("timestamp")
    assert views.modified_since(df, since).count() == 1 and views.modified_since(df, since, False).count() == 0
    assert views.modified_since(df, F.lit(None).cast("timestamp")).count() == 2


def test_last_write_wins_variants(spark):
    time = lambda x: F.lit(x).cast("timestamp")
    one, two, none = time("2024-01-01"), time("2024-01-02"), time(None)
    cases = [(two, one, {}, True), (one, one, {}, False), (one, none, {}, True), (none, one, {}, False), (one, one, {"tie": "source"}, True), (none, one, {"on_null": "source"}, True)]
    row = spark.range(1).select(*(reconcile.prefers_source(a, b, **k).alias(str(i)) for i, (a, b, k, _) in enumerate(cases))).first()
    assert list(row) == [want for *_, want in cases]


def test_conflict_store_life(spark):
    columns = "id string, mapping_id string, uid string, detected_at timestamp, decision string, resolved_at timestamp, applied_at timestamp"
    now, rows = F.lit("2024-02-01").cast("timestamp"), spark.createDataFrame([("x1", "m", "u1", None, None, None, None), ("x2", None, "u2", None, None, None, None)], columns)
    new = spark.createDataFrame([(None, "u2"), ("m", "u3"), ("m", "u3")], "mapping_id string, uid string").withColumn("detected_at", now)
    held = store.record_conflicts(rows, new)
    assert sorted((r.uid, r.id if r.uid != "u3" else len(r.id)) for r in held.collect()) == [("u1", "x1"), ("u2", "x2"), ("u3", 32)]
    assert held.exceptAll(store.record_conflicts(rows, new)).count() == 0
    held = store.resolve_one(held, "x1", "source", now)
    due, after = store.consume(held, now)
    assert [r.id for r in due.collect()] == ["x1"] and store.unapplied(after).count() == 0
    assert store.drop_applied(after).count() == 2 and store.pending(after, "m").count() == 1
    back = store.reset(after, spark.createDataFrame([("x1",)], "id string"))
    assert store.pending(back).count() == 3
    assert store.unapplied(store.mark_applied(held, spark.createDataFrame([("x1",)], "id string"), now)).count() == 0


def test_star_names(spark):
    rows = [("c", 1, "sync1", 2), ("c", 2, "primary", 9), ("c", 3, "readonly", 0), ("d", 1, "sync1", 0)]
    got = topology.generate_mappings(spark.createDataFrame(rows, "calendar string, backend int, role string, position int"), "star").collect()
    assert [tuple(r) for r in got] == [("auto_c_sync1", "c", 2, 1)]


def test_identity_of_digest_with_null_hash(spark):
    make = lambda rows: spark.createDataFrame(rows, "mapping_id string, id string, hash string")
    digest = lambda rows: reconcile.collection_digest(make(rows)).first().digest
    assert digest([("m", "1", None)]) == sha("1\x1f\x1e") != digest([("m", "1", None), ("m", "2", None)])
    assert reconcile.dedupe_last(make([("m", "", "x"), ("m", "1", "y")]), ["id"], "hash").count() == 1
