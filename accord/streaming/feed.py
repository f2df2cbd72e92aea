"""Delta feeds and logs on Structured Streaming: views kept up to date by upserts and tombstones, latest states."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout
from pyspark.sql.utils import AnalysisException

#: Every so many batches the state is written anew as one version; in between only changes are.
COMPACT = 20


def merge_feed(state: DataFrame, delta: DataFrame, key: str, order: str) -> DataFrame:
    """The state (delta's columns, deleted among them) after a delta: a key's newest row stays, tombstones too.

    So an older row that comes late never brings back what was deleted. Of equal orders a tombstone, then the
    greatest row, counts; null orders are oldest.
    """
    rows = state.unionByName(delta)
    rest = [c for c in rows.columns if c != key]
    low = F.coalesce(F.col(order), F.lit(None).cast(rows.schema[order].dataType))
    packed = rows.groupBy(key).agg(F.max_by(F.struct(*rest), F.struct(low, "deleted", *(c for c in rest if c not in (order, "deleted")))).alias("r"))
    return packed.select(key, "r.*").select(rows.columns)


def view(state: DataFrame) -> DataFrame:
    """What a state shows: its rows without tombstones."""
    return state.where("not deleted").drop("deleted")


def _parts(spark: SparkSession, path: str, schema) -> DataFrame:
    try:
        return spark.read.schema(f"{schema.simpleString()[7:-1].replace(':', ' ')}, v long, whole boolean").parquet(path)
    except AnalysisException:  # nothing was written yet
        return spark.createDataFrame([], schema).withColumns({"v": F.lit(0).cast("long"), "whole": F.lit(False)})


def _there(spark: SparkSession, path: str) -> bool:
    found = spark._jvm.org.apache.hadoop.fs.Path(path)
    return found.getFileSystem(spark._jsc.hadoopConfiguration()).exists(found)


def _forget(spark: SparkSession, path: str, number: int) -> None:
    """Drops the versions before the last but one whole one below a number: no state needs them, and readers of the last keep theirs."""
    root = spark._jvm.org.apache.hadoop.fs.Path(path)
    store = root.getFileSystem(spark._jsc.hadoopConfiguration())
    if not store.exists(root):
        return
    found = sorted(int(x.getPath().getName()[2:]) for x in store.listStatus(root) if x.getPath().getName().startswith("v="))
    whole = [v for v in found if v < number and store.exists(spark._jvm.org.apache.hadoop.fs.Path(f"{path}/v={v}/whole=true"))]
    for v in found:
        if len(whole) > 1 and v < whole[-2]:
            store.delete(spark._jvm.org.apache.hadoop.fs.Path(f"{path}/v={v}"), True)


def read_state(spark: SparkSession, path: str, schema, key: str, order: str, before: int | None = None) -> DataFrame:
    """The state of all batches (or those before a number): the last whole version and the changes after it, merged."""
    rows = _parts(spark, path, schema)
    if before is not None:
        rows = rows.where(F.col("v") < before)
    start = rows.where("whole").agg(F.max("v")).first()[0]
    held = rows.where(F.col("v") >= start) if start is not None else rows
    return merge_feed(held.drop("v", "whole"), spark.createDataFrame([], schema), key, order)


def apply_feed(stream: DataFrame, path: str, checkpoint: str, key: str, order: str, full_refresh: bool = False, trigger: dict | None = None):
    """Starts a query that keeps a feed's state under path (columns of stream, deleted among them).

    Each batch writes its newest row a key to a folder of its own number, v=<batch>, so a batch that runs again
    writes the same rows to the same place; every COMPACT batches the whole state is written in one. The batch
    number is the feed's token: the engine commits it to the checkpoint only after the batch was written. Versions before
    the last but one whole one are dropped, so what a reader lists doesn't grow with the feed's age.
    With full_refresh the first batch is the whole feed again and what was held before it does not count. A new
    checkpoint over a state that is there already raises otherwise, as its batches would take the places of others.
    """
    schema, spark = stream.schema, stream.sparkSession
    begun = _there(spark, f"{checkpoint}/offsets")
    if not begun and not full_refresh and not _parts(spark, path, schema).isEmpty():
        raise ValueError(f"{path} holds a state of another checkpoint: go on with that one, or ask for a full refresh")

    def batch(delta: DataFrame, number: int) -> None:
        spark = delta.sparkSession
        none = spark.createDataFrame([], schema)
        first = full_refresh and number == 0
        whole = first or number % COMPACT == COMPACT - 1
        base = none if first or not whole else read_state(spark, path, schema, key, order, before=number)
        out = merge_feed(base, delta, key, order)
        if first:  # everything under path goes
            out.withColumns({"v": F.lit(0).cast("long"), "whole": F.lit(True)}).write.mode("overwrite").option("partitionOverwriteMode", "static").partitionBy("v", "whole").parquet(path)
        else:
            out.write.mode("overwrite").parquet(f"{path}/v={number}/whole={'true' if whole else 'false'}")
            if whole:
                _forget(spark, path, number)

    return stream.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()


def lww_stream(stream: DataFrame, key: str, ts: str, value: str, ttl: str | None = None) -> DataFrame:
    """key, ts, value: a row whenever a key's newest entry changes; older entries that come late are ignored.

    State is one row a key and has no expiry. With ttl (as '10 days', an extension) a key's state goes after that time
    without entries, and older entries may then come back. Of equal times the first that was seen stays; entries
    without a time are passed over.
    """
    types = {f.name: f.dataType.simpleString() for f in stream.schema}
    schema = f"{key} {types[key]}, {ts} {types[ts]}, {value} {types[value]}"
    state = f"{ts} {types[ts]}"

    def newest(keys: tuple, frames: Iterator[pd.DataFrame], held: GroupState) -> Iterator[pd.DataFrame]:
        if held.hasTimedOut:
            held.remove()
            return
        before = held.getOption[0] if held.exists else None
        last, found = before, None
        for frame in frames:
            timed = frame[frame[ts].notna()]  # an entry without a time is never the newest
            if len(timed) and (last is None or timed[ts].max() > last):
                newer = timed.loc[timed[ts].idxmax()]  # the first of equal times
                last, found = newer[ts], newer[value]
        if last is not None and last != before:
            held.update((last,))
            yield pd.DataFrame([(keys[0], last, found)], columns=[key, ts, value])
        if ttl is not None:
            held.setTimeoutDuration(int(pd.Timedelta(ttl).total_seconds() * 1000))

    timeout = GroupStateTimeout.NoTimeout if ttl is None else GroupStateTimeout.ProcessingTimeTimeout
    return stream.select(key, ts, value).groupBy(key).applyInPandasWithState(newest, schema, state, "update", timeout)


def advance_tokens(stored: DataFrame, fetched: DataFrame, written: DataFrame, outcomes: DataFrame) -> DataFrame:
    """mapping_id, side, token to store: only for mappings that succeeded (outcomes: mapping_id, ok); others keep theirs.

    A token taken after the writes (written) counts before the one taken with the fetch.
    """
    token = lambda df, name: df.select("mapping_id", "side", F.col("token").alias(name))
    met = token(stored, "old").join(token(fetched, "fetched"), ["mapping_id", "side"], "full").join(token(written, "written"), ["mapping_id", "side"], "full")
    met = met.join(outcomes.select("mapping_id", "ok"), "mapping_id", "left")
    new = F.coalesce("written", "fetched", "old")
    return met.select("mapping_id", "side", F.when(F.coalesce("ok", F.lit(False)), new).otherwise(F.col("old")).alias("token")).where("token is not null")
