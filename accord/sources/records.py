"""Reading and writing records: collections, hub tables, files a record, operation logs, edit journals."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from accord.functions.text import slug
from accord.operators.ranks import numbered

SEPARATOR = "\x01"
#: The file extensions of collection types; others have .bin.
EXTENSIONS = {"memos": ".md", "contacts": ".vcf", "calendar": ".ics", "todos": ".ics"}
_FIELDS = {"collection_id": "string", "id": "string", "type": "string", "display_name": "string", "data": "string", "content_hash": "string", "last_modified": "timestamp", "is_deleted": "boolean"}


def as_records(df: DataFrame) -> DataFrame:
    """The record columns, missing ones null; a missing or empty hash is the payload's SHA-256, a missing name the id."""
    found = {c: F.col(c).cast(t) if c in df.columns else F.lit(None).cast(t) for c, t in _FIELDS.items()}
    found["content_hash"] = F.coalesce(F.nullif(found["content_hash"], F.lit("")), F.sha2(found["data"], 256))
    found["display_name"] = F.coalesce(F.nullif(found["display_name"], F.lit("")), found["id"])
    found["is_deleted"] = F.coalesce(found["is_deleted"], F.lit(False))
    return df.select(*(v.alias(c) for c, v in found.items()))


def read_records(spark: SparkSession, path: str, fmt: str = "parquet") -> DataFrame:
    """A collection's records from Parquet, JSON lines, or a folder of files (fmt 'files': id is the file's name).

    A path that can't be read raises; it is never an empty collection. Files without a byte hold no record.
    """
    if fmt == "files":
        files = spark.read.format("binaryFile").load(path)
        name = F.element_at(F.split("path", "/"), -1)
        return as_records(files.select(name.alias("id"), F.col("content").cast("string").alias("data"), F.sha2("content", 256).alias("content_hash"), F.col("modificationTime").alias("last_modified")))
    return as_records(spark.read.format(fmt).load(path))


def require_nonempty(records: DataFrame, what: str = "collection") -> DataFrame:
    """The records; raises where there are none, for callers to whom an empty load means a failed one."""
    if not records.limit(1).count():
        raise ValueError(f"{what} is empty")
    return records


def encode_id(collection: Column, id_: Column) -> Column:
    return F.concat(collection, F.lit(SEPARATOR), id_)


def decode_id(encoded: Column) -> Column:
    """struct(collection, id): cut at the first separator; without one the collection is empty."""
    at = F.locate(SEPARATOR, encoded)
    return F.struct(F.when(at > 0, F.substr(encoded, F.lit(1), at - 1)).otherwise("").alias("collection"), F.when(at > 0, F.substr(encoded, at + 1)).otherwise(encoded).alias("id"))


def write_hub(records: DataFrame, path: str) -> None:
    """Rows record_id, data, content_hash, last_modified by domain and encoding; ids are named by their collection."""
    rows = records.select("domain", "encoding", encode_id(F.col("collection_id"), F.col("id")).alias("record_id"), "data", "content_hash", "last_modified")
    rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("domain", "encoding").parquet(path)


def read_hub(spark: SparkSession, path: str, domain: str, encoding: str) -> DataFrame:
    """The hub's records of one shape, ids and collections apart again; only that shape's folder is read."""
    rows = spark.read.parquet(path).where((F.col("domain") == domain) & (F.col("encoding") == encoding))
    of = decode_id(F.col("record_id"))
    return rows.select(of["collection"].alias("collection_id"), of["id"].alias("id"), "data", "content_hash", "last_modified")


def file_name(type_: Column, display_name: Column, id_: Column) -> Column:
    """<slug of the name or id>-<first 8 hex digits of the id's SHA-256><extension of the type>."""
    named = F.coalesce(F.nullif(display_name, F.lit("")), id_)
    ending = F.coalesce(F.try_element_at(F.create_map(*(F.lit(x) for pair in EXTENSIONS.items() for x in pair)), type_), F.lit(".bin"))
    return F.concat(slug(named), F.lit("-"), F.substring(F.sha2(id_, 256), 1, 8), ending)


def oplog_entries(lines: DataFrame) -> DataFrame:
    """app_id, bucket, line, path, datetime, key, value of log lines (app_id, bucket, line, text).

    A line is a JSON array of path (array), time, key and value; other lines are dropped. key and value are
    JSON texts, value null for a JSON null.
    """
    parsed = F.try_parse_json(F.trim("text"))
    entry = F.try_variant_get(parsed, "$", "array<variant>")
    path = F.try_variant_get(parsed, "$[0]", "array<string>")
    rows = lines.withColumn("e", entry).withColumn("path", path).where("size(e) = 4 and path is not null")
    value = F.to_json(F.col("e")[3])
    return rows.select("app_id", "bucket", "line", "path", F.coalesce(F.try_variant_get(F.try_parse_json("text"), "$[1]", "string"), F.lit("")).alias("datetime"), F.to_json(F.col("e")[2]).alias("key"), F.when(value != "null", value).alias("value"))


def read_oplog(spark: SparkSession, path: str) -> DataFrame:
    """oplog_entries of files <path>/<app_id>/<bucket>; a line's number is its place in its file, so a file (one bucket of one writer) is one split."""
    texts = spark.read.text(path, wholetext=True, recursiveFileLookup=True).select(F.col("_metadata.file_path").alias("file"), "value")
    # the path is percent-encoded, but a plus sign stands for itself
    parts = F.transform(F.split("file", "/"), lambda x: F.url_decode(F.replace(x, F.lit("+"), F.lit("%2B"))))
    rows = texts.select(F.element_at(parts, -2).alias("app_id"), F.element_at(parts, -1).alias("bucket"), F.posexplode(F.split("value", "\n")).alias("line", "text"))
    return oplog_entries(rows.where("trim(text) <> ''"))


def oplog_line(path: Column, datetime: Column, key: Column, value: Column) -> Column:
    """The log line of an entry; key and value are JSON texts."""
    time = F.to_json(F.array(datetime))
    text = F.substr(time, F.lit(2), F.length(time) - 2)
    return F.concat(F.lit("["), F.to_json(path), F.lit(","), text, F.lit(","), key, F.lit(","), F.coalesce(value, F.lit("null")), F.lit("]"))


def replay_journal(lines: DataFrame) -> DataFrame:
    """entity, uid, recurrence_id, op, data: the last edit of each record in a journal (entity, seq, text: JSON objects).

    Malformed lines, and those without op or uid, are skipped.
    """
    parsed = F.from_json("text", "op string, uid string, data string, recurrenceId string")
    rows = lines.withColumn("e", parsed).where("e.op is not null and e.uid <> ''")
    rank = F.row_number().over(Window.partitionBy("entity", "e.uid", F.coalesce("e.recurrenceId", F.lit(""))).orderBy(F.desc("seq")))
    last = rows.withColumn("rank", rank).where("rank = 1")
    return last.select("entity", F.col("e.uid").alias("uid"), F.col("e.recurrenceId").alias("recurrence_id"), F.col("e.op").alias("op"), F.col("e.data").alias("data"))


def discard_prefix(lines: DataFrame, acknowledged: DataFrame) -> DataFrame:
    """A journal without the first n lines of each entity that were acknowledged (entity, n).

    Only entities with an acknowledgement are numbered, by ranges of (entity, seq), so a long journal is not one task's.
    """
    known = acknowledged.where("n > 0").select(F.col("entity").alias("__entity"), F.col("n").cast("long").alias("__n"))
    rest = lines.join(known, lines["entity"] == F.col("__entity"), "left_anti")
    packed = lines.join(known, lines["entity"] == F.col("__entity")).select(F.col("entity").cast("string").alias("__key"), F.col("seq").alias("__seq"), "__n", F.struct(*lines.columns).alias("__line"))
    left = numbered(packed, "__key", ["__seq"]).where("pos >= __n").select("__line.*")
    return rest.unionByName(left)
