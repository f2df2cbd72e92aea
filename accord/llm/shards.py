"""Training order: token sequences in fixed-stride shards by a keyed permutation.

A Feistel network over the sequences' dense numbers, walked along its cycles until it lands below
their count, gives every sequence its own global slot without sorting or a table. Range partitions
write the slots' shards; a reader starts at any slot by arithmetic.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from accord.llm.bpe import ROWS, library
from accord.llm.common import documents, written
from accord.llm.shingles import mixed

#: Rows of the table of tasks' counts (one a task) up to which it is broadcast: 16 MB.
MOST_TASKS = 1_000_000
#: Tokens of a sequence, sequences of a shard, the number that fills up a last sequence.
TOKENS, PER_SHARD, PAD = 256, 2048, 50_256
#: Shards that one range partition writes, and the most partitions; beyond it each writes more shards.
SHARDS_A_TASK, MOST_PARTITIONS = 16, 100_000
KEY, FEISTEL_ROUNDS = 0x5EED, 4


def slots(numbers: np.ndarray, count: int, key: int = KEY) -> np.ndarray:
    """The permuted place of each number, for numbers below count."""
    half = max(1, (max(2, count) - 1).bit_length() + 1 >> 1)
    mask = np.uint64((1 << half) - 1)
    keys = mixed(np.arange(1, FEISTEL_ROUNDS + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(key))

    def once(x: np.ndarray) -> np.ndarray:
        left, right = x >> np.uint64(half), x & mask
        for k in keys:
            left, right = right, left ^ (mixed(right + k) & mask)
        return left << np.uint64(half) | right

    out = once(numbers.astype(np.uint64))
    while (outside := out >= np.uint64(count)).any():
        out[outside] = once(out[outside])
    return out.astype(np.int64)


def id_type(vocabulary: str, pattern: str) -> np.dtype:
    """How ids are stored: little-endian, two bytes wide if all ids and PAD fit, else four."""
    return np.dtype("<u2" if max(library(vocabulary, pattern).max_token_value, PAD) < 1 << 16 else "<u4")


def sequences(docs: DataFrame, vocabulary: str, pattern: str) -> DataFrame:
    """part, k, doc_id, seq, n_tokens, tokens: documents cut into sequences, numbered within each task."""
    kind = id_type(vocabulary, pattern)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, part, k, width = library(vocabulary, pattern).encode_ordinary, TaskContext.get().partitionId(), 0, TOKENS * kind.itemsize
        for whole in batches:
            for start in range(0, whole.num_rows, ROWS):
                batch = whole.slice(start, ROWS)
                packed = [np.array(encode(text), kind).tobytes() for text in batch.column(1).to_pylist()]
                length = np.array([len(x) for x in packed], np.int64)
                count = -(-length // width)
                first, total = np.cumsum(count) - count, int(count.sum())
                seq = np.arange(total) - np.repeat(first, count)
                held = np.minimum(width, np.repeat(length, count) - seq * width) // kind.itemsize
                doc = batch.column(0).take(pa.array(np.repeat(np.arange(len(count)), count)))
                tokens = pa.array([x[at : at + width] for x in packed for at in range(0, len(x), width)], pa.binary())
                columns = [pa.array(np.full(total, part, np.int32)), pa.array(np.arange(k, k + total)), doc, pa.array(seq), pa.array(held.astype(np.int32)), tokens]
                k += total
                yield pa.RecordBatch.from_arrays(columns, names=["part", "k", "doc_id", "seq", "n_tokens", "tokens"])

    return documents(docs).mapInArrow(scan, "part int, k long, doc_id long, seq long, n_tokens int, tokens binary")


def _numbers(cut: DataFrame) -> tuple[DataFrame, int]:
    """Written sequences with their dense number, and how many there are."""
    counts = written(cut.groupBy("part").agg(F.count("*").alias("n")))  # a row for each task
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select(F.col("part").alias("of"), F.coalesce(F.sum("n").over(before), F.lit(0)).alias("first"))
    tasks, total = counts.agg(F.count("*"), F.sum("n")).first()
    if tasks <= MOST_TASKS:
        starts = F.broadcast(starts)
    return cut.join(starts, F.col("part") == F.col("of")).withColumn("number", F.col("first") + F.col("k")), total or 0


def _placed(cut: DataFrame, key: int) -> tuple[DataFrame, int]:
    """slot, doc_id, seq, n_tokens, tokens of written sequences, the same whenever computed again; and their count."""
    numbered, total = _numbers(cut)
    columns = ["doc_id", "seq", "n_tokens", "tokens"]

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            slot = pa.array(slots(np.asarray(batch.column(0)), total, key))
            yield pa.RecordBatch.from_arrays([slot, *batch.columns[1:]], names=["slot", *columns])

    return numbered.select("number", *columns).mapInArrow(place, "slot long, doc_id long, seq long, n_tokens int, tokens binary"), total


def ordered(docs: DataFrame, vocabulary: str, pattern: str, key: int = KEY) -> DataFrame:
    """slot, doc_id, seq, n_tokens, tokens: every sequence with its global slot, 0 to their count - 1.

    Null and empty texts have no sequence; repeated rows have sequences of their own; other columns of
    docs are not read; empty tables give no rows. The sequences are written before they are numbered, so
    a task that runs again can't number them otherwise.
    """
    return _placed(written(sequences(docs, vocabulary, pattern)), key)[0]


def _packed(placed: DataFrame, total: int, kind: np.dtype) -> DataFrame:
    """The shards of placed sequences. Slots are dense, so a range partition is found by arithmetic and none is hot."""
    pad = np.full(TOKENS, PAD, kind).tobytes()

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []

        def out() -> pa.RecordBatch:
            table = pa.Table.from_batches(held)
            first = table.column("slot")[0].as_py()
            payload = b"".join([x if len(x) == len(pad) else x + pad[len(x) :] for x in table.column("tokens").to_pylist()])
            lists = [pa.array([np.asarray(table.column(c)).astype(np.int64)], pa.list_(pa.int64())) for c in ("doc_id", "seq", "n_tokens")]
            digest = hashlib.sha256(payload).hexdigest()
            return pa.RecordBatch.from_arrays([pa.array([first // PER_SHARD]), pa.array([first]), pa.array([table.num_rows], pa.int32()), pa.array([payload], pa.binary()), pa.array([digest]), *lists], names=names)

        for batch in batches:
            shard = np.asarray(batch.column(0)) // PER_SHARD
            cuts = [0, *(np.flatnonzero(np.diff(shard)) + 1).tolist(), len(shard)]
            for a, b in zip(cuts, cuts[1:], strict=False):
                if held and held[0].column(0)[0].as_py() // PER_SHARD != shard[a]:
                    yield out()
                    held = []
                if b > a:
                    held.append(batch.slice(a, b - a))
        if held:
            yield out()

    names = ["shard", "first_slot", "n_sequences", "payload", "sha256", "doc_ids", "seqs", "counts"]
    shards = -(-total // PER_SHARD)
    each = max(SHARDS_A_TASK, -(-shards // MOST_PARTITIONS))
    ranged = placed.repartitionById(max(1, -(-shards // each)), F.floor(F.col("slot") / (PER_SHARD * each)).cast("int")).sortWithinPartitions("slot")
    return ranged.mapInArrow(pack, "shard long, first_slot long, n_sequences int, payload binary, sha256 string, doc_ids array<long>, seqs array<long>, counts array<long>")


def write_shards(docs: DataFrame, vocabulary: str, pattern: str, path: str | None = None, key: int = KEY) -> DataFrame:
    """Writes shard, first_slot, n_sequences, payload, sha256, doc_ids, seqs, counts rows and gives them as read again.

    A payload is its sequences in slot order, TOKENS ids of id_type each, the last one of a document
    filled up with PAD: sequence s is at byte (s - first_slot) * TOKENS * the type's width. The lists hold
    each sequence's document, place in it and token count. Null and empty texts, repeated rows, other columns and
    empty tables are as in ordered.
    """
    placed, total = _placed(written(sequences(docs, vocabulary, pattern)), key)
    shards = _packed(placed, total, id_type(vocabulary, pattern))
    if path is None:
        return written(shards)
    shards.write.parquet(path)
    return docs.sparkSession.read.parquet(path)


def read_from(spark: SparkSession, path: str, slot: int) -> DataFrame:
    """slot, tokens (array of int) from the given slot on: the shards before it aren't read."""

    def unpack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, payload, count in zip(*(batch.column(k).to_pylist() for k in range(3)), strict=True):
                rows = np.frombuffer(payload, np.dtype(f"<u{len(payload) // (count * TOKENS)}")).reshape(count, TOKENS)
                numbers = np.arange(first, first + count)
                yield pa.RecordBatch.from_arrays([pa.array(numbers), pa.array(list(rows.astype(np.int32)), pa.list_(pa.int32()))], names=["slot", "tokens"])

    shards = spark.read.parquet(path).where(F.col("shard") >= slot // PER_SHARD).select("first_slot", "payload", "n_sequences")
    return shards.mapInArrow(unpack, "slot long, tokens array<int>").where(F.col("slot") >= slot)


def manifest(docs: DataFrame, vocabulary: str, pattern: str) -> DataFrame:
    """doc_id, seq, slot, shard, byte_offset, n_tokens, shard_sha256 of every sequence, after writing the shards.

    Null and empty texts have no sequence and so no row; repeated rows have their own; empty input gives no rows.
    """
    width = TOKENS * id_type(vocabulary, pattern).itemsize
    shards = write_shards(docs, vocabulary, pattern).select("shard", "first_slot", "sha256", F.posexplode(F.arrays_zip("doc_ids", "seqs", "counts")).alias("at", "x"))
    return shards.select(
        F.col("x.doc_ids").alias("doc_id"), F.col("x.seqs").alias("seq"), (F.col("first_slot") + F.col("at")).alias("slot"), "shard",
        (F.col("at").cast("long") * width).alias("byte_offset"), F.col("x.counts").alias("n_tokens"), F.col("sha256").alias("shard_sha256"),
    )
