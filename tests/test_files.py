"""Sinks and sources of files: written, read back, and run again."""

import json
import os

import pytest
from pyspark.sql import functions as F

from accord.sources import files, records

RECORDS = "id string, type string, display_name string, data string"


def shown(path):
    return {n: open(f"{path}/{n}", encoding="utf8").read() for n in os.listdir(path) if not n.startswith(".")}


def test_one_file_a_record(spark, tmp_path):
    path = str(tmp_path / "box")
    rows = spark.createDataFrame([("u1", "memos", "My Note", "körper\n"), ("u2", "calendar", "", "BEGIN"), ("u3", "odd", None, None), ("u1", "memos", "My Note", "Older")], RECORDS)
    files.write_record_files(rows, path)
    named = {r.id: r.name for r in rows.select("id", records.file_name(F.col("type"), F.col("display_name"), F.col("id")).alias("name")).collect()}
    assert shown(path) == {named["u1"]: "körper\n", named["u2"]: "BEGIN", named["u3"]: ""} and named["u1"].startswith("my-note-") and named["u2"].endswith(".ics")
    back = {r.id: r.data for r in records.read_records(spark, path, "files").collect()}
    assert back == {named["u1"]: "körper\n", named["u2"]: "BEGIN"}  # Spark passes over files without bytes
    files.write_record_files(spark.createDataFrame([("u2", "calendar", "", "NEW")], RECORDS), path)
    assert len(shown(path)) == 3 and shown(path)[named["u2"]] == "NEW"
    files.write_record_files(spark.createDataFrame([("u2", "calendar", "", "LAST")], RECORDS), path, overwrite=True)
    assert shown(path) == {named["u2"]: "LAST"}
    assert not os.path.exists(f"{path}/{files.PENDING}")


def test_a_write_that_fails_leaves_nothing(spark, tmp_path):
    path = str(tmp_path / "box")
    files.write_record_files(spark.createDataFrame([("u1", "memos", "a", "kept")], RECORDS), path)
    before = shown(path)
    spark.dataSource.register(files.RecordFiles)
    bad = spark.createDataFrame([(f"n{k}" if k != 50 else "a/b", b"x") for k in range(100)], "name string, data binary").repartition(4)
    with pytest.raises(Exception, match="no file name"):
        bad.write.format("record_files").option("path", path).mode("append").save()
    assert shown(path) == before  # what tasks that were being stopped still wrote is in a hidden folder
    assert records.read_records(spark, path, "files").count() == 1


def test_journal_batches_add_nothing_twice(spark, tmp_path):
    path, schema = str(tmp_path / "journal"), "entity string, seq long, op string, uid string, data string, recurrence_id string"
    one = spark.createDataFrame([("a", 1, "create", "u", "d1", None), ("a", 2, "edit", "u", "d2", None), ("b", 1, "create", "v", None, "r")], schema)
    for batch, rows in ((0, one), (0, one), (1, spark.createDataFrame([("a", 1, "delete", "u", None, None)], schema))):
        files.append_journal(rows, path, batch)
    journal = files.read_journal(spark, path)
    assert journal.count() == 4
    last = {(r.entity, r.uid): (r.recurrence_id, r.op, r.data) for r in records.replay_journal(journal).collect()}
    assert last == {("a", "u"): (None, "delete", None), ("b", "v"): ("r", "create", None)}
    rest = records.discard_prefix(journal, spark.createDataFrame([("a", 2)], "entity string, n long"))
    assert sorted((r.entity, json.loads(r.text)["op"]) for r in rest.collect()) == [("a", "delete"), ("b", "create")]
    assert {r.entity for r in files.truncate_journal(spark, path, "a").collect()} == {"b"}


LOG = "bucket string, seq long, path array<string>, datetime string, key string, value string"


def entry(bucket, seq, uid, time, value='"x"'):
    return (bucket, seq, ["resources", uid], time, "null", value)


def test_log_stream_goes_on_from_its_sequences(spark, tmp_path):
    path, out, point = str(tmp_path / "log dir+1"), str(tmp_path / "out"), str(tmp_path / "point")
    put = lambda app, *rows: {r.bucket: r.sequence for r in files.append_oplog(spark.createDataFrame(list(rows), LOG), path, app).collect()}

    def drained():
        query = files.oplog_stream(spark, path, "own").writeStream.format("parquet").option("path", out).option("checkpointLocation", point).trigger(availableNow=True).start()
        query.awaitTermination(120)
        return sorted((r.app_id, r.bucket, r.path[1], r.datetime) for r in spark.read.parquet(out).collect())

    assert put("my pc-App", entry("0a", 1, "u1", "t1"), entry("0a", 2, "u2", "t2", None), entry("info", 1, "i", "t1")) == {"0a": 2, "info": 1}
    put("own", entry("0a", 1, "mine", "t1"))
    first = [("my pc-App", "0a", "u1", "t1"), ("my pc-App", "0a", "u2", "t2"), ("my pc-App", "info", "i", "t1")]
    assert drained() == first
    assert drained() == first  # nothing new: a restart reads nothing
    # a bucket that was not there before, from a writer that comes late, and a bucket that grew
    put("tablet", entry("ff", 1, "u9", "t9"))
    assert put("my pc-App", entry("info", 1, "j", "t3")) == {"info": 2}
    assert drained() == sorted([*first, ("tablet", "ff", "u9", "t9"), ("my pc-App", "info", "i", "t1"), ("my pc-App", "info", "j", "t3")])
    # the batch reader sees the same files, folder names with blanks and signs as they are
    whole = records.read_oplog(spark, f"{path}/v2").where("bucket <> 'sequences'")
    assert sorted({(r.app_id, r.bucket) for r in whole.collect()}) == [("my pc-App", "0a"), ("my pc-App", "info"), ("own", "0a"), ("tablet", "ff")]


def test_appending_again_puts_no_line_twice(spark, tmp_path):
    path, rows = str(tmp_path), [entry("0a", 1, "u1", "t1"), entry("0a", 2, "u2", "t2")]
    for _ in range(2):
        files.append_oplog(spark.createDataFrame(rows, LOG), path, "app")
    assert len((tmp_path / "v2/app/0a").read_text().splitlines()) == 2
