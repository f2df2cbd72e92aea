"""Sinks and sources of files: one file a record, edit journals, and writers' logs as a stream.

The formats open files by pyarrow's file systems, so a path is a folder of a store that driver and executors share.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterator
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass

from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, DataSourceWriter, InputPartition, WriterCommitMessage
from pyspark.sql.types import StructType

from accord.sources.records import file_name, oplog_entries, oplog_line

#: The folder within a collection's where files wait until the write is committed.
PENDING = ".pending"


def _store(path: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), path)


def _text(store: fs.FileSystem, path: str) -> str:
    with store.open_input_stream(path) as f:
        return f.read().decode()


def _names(store: fs.FileSystem, path: str, kind: fs.FileType) -> list[str]:
    found = store.get_file_info(fs.FileSelector(path, allow_not_found=True))
    return sorted(x.base_name for x in found if x.type == kind)


@dataclass
class Written(WriterCommitMessage):
    folder: str
    files: int


class RecordFilesWriter(DataSourceWriter):
    """Tasks write to folders of their own; commit moves the files to their place, abort drops them.

    What a task writes while it is being stopped can outlive the abort, in the hidden folder that no reader looks into.
    """

    def __init__(self, path: str, overwrite: bool) -> None:
        self.path, self.overwrite, self.run = path.rstrip("/"), overwrite, uuid.uuid4().hex

    def write(self, iterator: Iterator) -> Written:
        store, path = _store(self.path)
        folder, n = f"{path}/{PENDING}/{self.run}/{uuid.uuid4().hex}", 0  # a task that runs again has another
        store.create_dir(folder, recursive=True)
        for row in iterator:
            if "/" in row["name"] or row["name"] in ("", ".", ".."):
                raise ValueError(f"no file name: {row['name']!r}")
            with store.open_output_stream(f"{folder}/{row['name']}") as f:
                f.write(bytes(row["data"]))
            n += 1
        return Written(folder, n)

    def commit(self, messages: list[Written | None]) -> None:
        store, path = _store(self.path)
        done = [m for m in messages if m is not None]
        kept: set[str] = set()
        with ThreadPoolExecutor(16) as pool:
            for m in done:  # the names of one task at a time
                names = _names(store, m.folder, fs.FileType.File)
                list(pool.map(lambda name, folder=m.folder: store.move(f"{folder}/{name}", f"{path}/{name}"), names))
                if self.overwrite:
                    kept.update(names)
            if self.overwrite:
                list(pool.map(lambda name: store.delete_file(f"{path}/{name}"), [x for x in _names(store, path, fs.FileType.File) if x not in kept]))
        store.delete_dir(f"{path}/{PENDING}/{self.run}")
        if not store.get_file_info(fs.FileSelector(f"{path}/{PENDING}")):
            store.delete_dir(f"{path}/{PENDING}")

    def abort(self, messages: list[Written | None]) -> None:
        store, path = _store(self.path)
        if store.get_file_info(f"{path}/{PENDING}/{self.run}").type == fs.FileType.Directory:
            store.delete_dir(f"{path}/{PENDING}/{self.run}")


class RecordFiles(DataSource):
    """The format 'record_files': rows of name and data, a file each in the folder `path`."""

    @classmethod
    def name(cls) -> str:
        return "record_files"

    def writer(self, schema: StructType, overwrite: bool) -> DataSourceWriter:
        return RecordFilesWriter(self.options["path"], overwrite)


def write_record_files(records: DataFrame, path: str, overwrite: bool = False) -> None:
    """Writes records (id, type, display_name, data) to one file each, named by file_name, and all of them or none.

    A record's file is replaced; with overwrite, files of other records go. Of rows of one id that of the greatest data is
    written; null data is an empty file. The names of a collection pass through the driver as they are moved
    into place, so this is for collections that are kept as files; larger ones are Parquet tables.
    """
    records.sparkSession.dataSource.register(RecordFiles)
    rows = records.groupBy("id").agg(F.max_by(F.struct("type", "display_name", "data"), F.coalesce(F.col("data").cast("string"), F.lit(""))).alias("r"))
    named = rows.select(file_name(F.col("r.type"), F.col("r.display_name"), F.col("id")).alias("name"), F.coalesce(F.col("r.data").cast("binary"), F.lit(b"")).alias("data"))
    named.write.format("record_files").option("path", path).mode("overwrite" if overwrite else "append").save()


def append_journal(edits: DataFrame, path: str, batch: int) -> None:
    """Appends edits (entity, seq, op, uid, data, recurrence_id) to a journal, as JSON lines by entity.

    A batch has a folder of its own number, written anew when the batch runs again, so that nothing is there twice. A
    null recurrence_id or data is left out of its line.
    """
    line = F.to_json(F.struct("op", "uid", "data", F.col("recurrence_id").alias("recurrenceId")))
    rows = edits.select("entity", F.lit(batch).cast("long").alias("batch"), "seq", line.alias("text"))
    rows.drop("batch").write.mode("overwrite").parquet(f"{path}/batch={batch}")


def read_journal(spark: SparkSession, path: str) -> DataFrame:
    """entity, seq, text of all batches; seq counts batches first: struct(batch, seq)."""
    rows = spark.read.option("basePath", path).parquet(path)
    return rows.select("entity", F.struct(F.col("batch").cast("long").alias("batch"), "seq").alias("seq"), "text")


def truncate_journal(spark: SparkSession, path: str, entity) -> DataFrame:
    """The journal without an entity's lines."""
    return read_journal(spark, path).where(F.col("entity") != F.lit(entity))


def append_oplog(entries: DataFrame, path: str, app: str) -> DataFrame:
    """Appends entries (bucket, seq, path, datetime, key, value) to a writer's log <path>/v2/<app>/<bucket>, and raises its sequences.

    Gives bucket, sequence of the buckets that were written. A bucket is one file and is written whole by one task, next to its old one and
    then moved; the file of sequences, with a number for each bucket, is written last, so a reader that goes by it never misses
    an entry. A run that is repeated after a failure appends what the bucket lacks: lines that it ends with already are not put twice.
    """
    target = f"{path}/v2/{app}"
    line = oplog_line(F.col("path"), F.col("datetime"), F.col("key"), F.col("value"))

    def put(groups: Iterator) -> Iterator:
        import pandas as pd

        store, base = _store(target)
        for part in groups:
            for bucket, rows in part.groupby("bucket", sort=True):
                lines, at = rows.sort_values("seq")["line"].tolist(), f"{base}/{bucket}"
                old = _text(store, at) if store.get_file_info(at).type == fs.FileType.File else ""
                new = "".join(f"{x}\n" for x in lines)
                if not old.endswith(new):
                    with store.open_output_stream(f"{base}/.{bucket}") as f:
                        f.write((old + new).encode())
                    store.move(f"{base}/.{bucket}", at)
                yield pd.DataFrame({"bucket": [bucket], "lines": [len((old if old.endswith(new) else old + new).splitlines())]})

    store, base = _store(target)
    store.create_dir(base, recursive=True)
    rows = entries.select("bucket", "seq", line.alias("line"))
    packed = rows.groupBy("bucket").applyInPandas(lambda pdf: next(put(iter([pdf]))), "bucket string, lines long").collect()  # at most 257 buckets
    held = json.loads(_text(store, f"{base}/sequences")) if store.get_file_info(f"{base}/sequences").type == fs.FileType.File else {}
    held |= {r["bucket"]: max(r["lines"], held.get(r["bucket"], 0) + 1) for r in packed}
    with store.open_output_stream(f"{base}/.sequences") as f:
        f.write(json.dumps(dict(sorted(held.items()))).encode())
    store.move(f"{base}/.sequences", f"{base}/sequences")
    return entries.sparkSession.createDataFrame([(r["bucket"], held[r["bucket"]]) for r in packed], "bucket string, sequence long")


@dataclass
class Bucket(InputPartition):
    app: str
    bucket: str
    sequence: int


class OplogReader(DataSourceStreamReader):
    """Offsets are the sequences of all buckets of all other writers; a bucket whose sequence has risen is read anew, as one task."""

    def __init__(self, options: dict) -> None:
        self.path, self.own = f"{options['path'].rstrip('/')}/v2", options.get("app", "")

    def initialOffset(self) -> dict:
        return {}

    def latestOffset(self) -> dict:
        store, path = _store(self.path)
        found = {}
        for app in _names(store, path, fs.FileType.Directory):
            at = f"{path}/{app}/sequences"
            if app != self.own and store.get_file_info(at).type == fs.FileType.File:
                found[app] = json.dumps(dict(sorted(json.loads(_text(store, at)).items())))
        return found

    def partitions(self, start: dict, end: dict) -> list[Bucket]:
        known = {app: json.loads(x) for app, x in start.items()}
        return [Bucket(app, bucket, n) for app, x in sorted(end.items()) for bucket, n in json.loads(x).items() if n > known.get(app, {}).get(bucket, 0)]

    def read(self, partition: Bucket) -> Iterator[tuple]:
        store, path = _store(self.path)
        at = f"{path}/{partition.app}/{partition.bucket}"
        if store.get_file_info(at).type != fs.FileType.File:
            return
        for k, line in enumerate(_text(store, at).split("\n")):
            if line.strip():
                yield partition.app, partition.bucket, partition.sequence, k, line

    def commit(self, end: dict) -> None:
        """The engine's checkpoint holds the offsets; nothing else is kept."""


class Oplog(DataSource):
    """The format 'oplog': the lines of other writers' logs, bucket by bucket as their sequences rise."""

    @classmethod
    def name(cls) -> str:
        return "oplog"

    def schema(self) -> str:
        return "app_id string, bucket string, sequence long, line long, text string"

    def streamReader(self, schema: StructType) -> DataSourceStreamReader:
        return OplogReader(self.options)


def oplog_stream(spark: SparkSession, path: str, own_app: str = "") -> DataFrame:
    """A stream of new log entries of all writers but own_app: app_id, bucket, line, path, datetime, key, value.

    A bucket is read whole each time its sequence rises, as its entries carry no number of their own: entries that were
    seen before come again, which a merge by newest time does not mind. Restarts go on from the checkpoint's sequences.
    """
    spark.dataSource.register(Oplog)
    return oplog_entries(spark.readStream.format("oplog").option("path", path).option("app", own_app).load())


def record_paths(records: DataFrame, path: str) -> Column:
    """The file that each record of write_record_files is in."""
    return F.concat(F.lit(f"{path.rstrip('/')}/"), file_name(F.col("type"), F.col("display_name"), F.col("id")))
