"""Exact top-k search by inner product with a pivot table.

Distances of a vector to many pivots fix its projection on the pivots' span and the length of the rest,
so for a query and a vector the inner product is at most that of the projections plus the product of the
two rests: the maximum lower bound on their distance. Bounds of a block of queries with a strip of
vectors are one matrix product; what they leave open is evaluated in steps, best bounds first, and each
step raises the queries' thresholds. First thresholds come from a bounded sample of vectors; large tables
are met in rounds, each four times as far as the one before and with its thresholds.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from accord.llm.common import scratch, written

#: Pivots, chosen far apart in a sample of so many vectors; fewer where vectors have fewer components.
PIVOTS, SAMPLE = 48, 2048
#: Vectors of a packed row at most, queries that are searched together, and vectors whose bounds are made at once.
BLOCK, QUERIES, STRIP = 4096, 512, 1024
#: A task holds one chunk of the vectors: so many components at most, and so many chunks where blocks suffice. With fewer there is one round.
COMPONENTS, CHUNKS = 1 << 23, 64
#: Where more than one pair in so many is open, the best-bounded quarter is evaluated first; so many pairs at a time, which stay in the cache.
OPEN, PIECE = 8, 4096
#: No score, no id.
NONE, LAST = np.iinfo(np.int64).min, np.iinfo(np.int64).max


def quantised(vectors: DataFrame) -> DataFrame:
    """vec_id, dims, kind, v: components as floor(256 * x), in the smallest integers that hold all of a vector's.

    Vectors empty, null or holding null or non-finite components take no part, nor those without an id.
    """

    def fine(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column("x")
            size, values = np.asarray(lists.value_lengths()).astype(np.int64), np.asarray(lists.flatten().fill_null(np.nan))
            start, ids = np.cumsum(size) - size, np.asarray(batch.column("vec_id"))
            for dims in np.unique(size):
                at = np.flatnonzero(size == dims)
                x = values.reshape(-1, dims) if len(at) == len(size) else values[start[at][:, None] + np.arange(dims)]
                good = np.isfinite(x).all(1)
                at, whole = at[good], np.floor(256 * x[good])
                v = np.where(whole < 2.0**63, np.maximum(whole, -(2.0**63)), 0).astype(np.int64)
                v[whole >= 2.0**63] = LAST
                most = np.maximum(v.max(1), -1 - v.min(1))
                kinds = np.searchsorted([1 << 7, 1 << 15, 1 << 31], most, "right")
                for kind in np.unique(kinds):
                    rows = np.flatnonzero(kinds == kind)
                    name = ("|i1", "<i2", "<i4", "<i8")[kind]
                    data = v[rows].astype(name)
                    ends = np.arange(len(rows) + 1, dtype=np.int32) * data.itemsize * int(dims)
                    packed = pa.Array.from_buffers(pa.binary(), len(rows), [None, pa.py_buffer(ends.astype(np.int32)), pa.py_buffer(data.tobytes())])
                    yield pa.RecordBatch.from_arrays([pa.array(ids[at[rows]]), pa.array(np.full(len(rows), dims, np.int32)), pa.array([name] * len(rows)), packed], names=["vec_id", "dims", "kind", "v"])

    x = F.col("embedding")
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), x.cast("array<double>").alias("x")).where(F.col("vec_id").isNotNull() & F.col("x").isNotNull() & (F.size("x") > 0))
    return rows.mapInArrow(fine, "vec_id long, dims int, kind string, v binary")


def _largest(x: np.ndarray) -> float:
    return max(float(x.max(initial=0)), -float(x.min(initial=0)))


def _exact(largest_q: float, largest_x: float, dims: int) -> type:
    """The fastest type in which no sum of so many products can lose a bit; beyond all, 64-bit integers."""
    most = largest_q * largest_x * dims
    return np.float32 if most < 2**24 else np.float64 if most < 2**52 else np.int64


def _products(q: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Exact integer inner products."""
    kind = _exact(_largest(q), _largest(x), q.shape[1])
    return (q.astype(kind) @ x.T.astype(kind)).astype(np.int64)


def _distances(x: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    y, p = x.astype(np.float64), pivots.astype(np.float64)
    return np.sqrt(np.maximum((y * y).sum(1)[:, None] + (p * p).sum(1)[None, :] - 2 * y @ p.T, 0))


def choose_pivots(sample: np.ndarray, count: int) -> np.ndarray:
    """Vectors of the sample, each the farthest from the span of those before it; fewer if the sample spans less."""
    rest, chosen = sample.astype(np.float64), []
    least = 1e-3 * np.sqrt((rest * rest).sum(1).max(initial=0))
    while len(chosen) < count:
        length = np.sqrt((rest * rest).sum(1))
        at = int(np.argmax(length)) if len(length) else 0
        if not len(length) or length[at] <= least:
            break
        chosen.append(at)
        axis = rest[at] / length[at]
        rest = rest - np.outer(rest @ axis, axis)
    return sample[chosen]


def projections(table: np.ndarray, lengths: np.ndarray, pivots: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Coordinates in the pivots' span and the length of the rest, from distances to the pivots and squared lengths."""
    p = pivots.astype(np.float64)
    products = (lengths[:, None] + (p * p).sum(1)[None, :] - table * table) / 2
    inside = np.linalg.solve(np.linalg.qr(p.T)[1].T, products.T).T if len(p) else np.zeros((len(table), 0))
    return inside, np.sqrt(np.maximum(lengths - (inside * inside).sum(1), 0))


class Chunk:
    """Vectors of equal length with their coordinates in the pivots' span, to be searched by many blocks of queries."""

    def __init__(self, ids: np.ndarray, x: np.ndarray, pivots: np.ndarray, table: np.ndarray | None = None) -> None:
        self.ids, self.x, self.pivots, self.largest, self._as = ids, x, pivots, _largest(x), {}
        self.reach = np.sqrt((pivots.astype(np.float64) ** 2).sum(1).max(initial=0))
        parts, longest = [], 0.0
        for at in range(0, len(x), BLOCK):
            part = x[at : at + BLOCK]
            inside, rest, length = self.spanned(part, None if table is None else table[at : at + BLOCK])
            parts, longest = [*parts, np.column_stack((inside, rest)).astype(np.float32)], max(longest, length.max(initial=0))
        self.longest = longest or 1.0
        self.sides = np.concatenate(parts) / np.float32(self.longest) if parts else np.zeros((0, len(pivots) + 1), np.float32)

    def spanned(self, x: np.ndarray, table: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Coordinates in the span, length of the rest, length."""
        squares = (x.astype(np.float64) ** 2).sum(1)
        return *projections(_distances(x, self.pivots) if table is None else table, squares, self.pivots), np.sqrt(squares)

    def slack(self, length: np.ndarray) -> np.ndarray:
        """More than what bounds lose by rounding, as a share of the length: single precision, distances to pivots, and the root of what they leave."""
        off = 1e-11 * np.maximum(self.reach, length)
        return 1e-5 + (off + np.sqrt(2 * length * off)) / length

    def typed(self, kind: type) -> np.ndarray:
        if kind not in self._as:
            self._as[kind] = self.x.astype(kind)
        return self._as[kind]

    def nearest(self, q_ids: np.ndarray, q: np.ndarray, floor: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
        """query's place, vec_id, score: each query's k best of the chunk (ties to the smaller id) that may be among its k best of all; and how many pairs were evaluated.

        floor: for each query a score that k other vectors are known to reach; candidates below it are left out.
        """
        inside, rest, length = self.spanned(q)
        length = np.where(length > 0, length, 1.0)
        own = (np.column_stack((inside, rest)) / length[:, None]).astype(np.float32)
        slack, unit = self.slack(length) + self.slack(np.array([self.longest])), length * self.longest
        bound = lambda f, i: np.where(f == NONE, -np.inf, f / unit[i] - slack[i]).astype(np.float32)
        kind = _exact(_largest(q), self.largest, q.shape[1])
        fine, x = q.astype(kind), self.typed(kind)
        floor = floor.copy()
        low = bound(floor, np.arange(len(q)))
        score, ids = np.full((len(q), k), NONE), np.full((len(q), k), LAST)
        known, evaluated = np.zeros(len(q), np.int64), 0
        bounds, opened = np.empty(len(q) * STRIP, np.float32), np.empty(len(q) * STRIP, bool)
        for at in range(0, len(x), STRIP):
            width = min(STRIP, len(x) - at)
            upper = np.matmul(own, self.sides[at : at + width].T, out=bounds[: len(q) * width].reshape(-1, width))
            open_ = _places(np.greater_equal(upper, low[:, None], out=opened[: len(q) * width].reshape(-1, width)))
            while len(open_):
                taken, open_ = open_, open_[:0]
                if len(taken) > max(PIECE, upper.size // OPEN):
                    over = low[taken // width] - upper.ravel()[taken]
                    taken, open_ = np.split(taken[np.argpartition(over, len(taken) // 4)], [len(taken) // 4])
                i = taken // width
                j = at + taken - i * width
                got = np.concatenate([np.einsum("ij,ij->i", fine.take(i[t : t + PIECE], 0), x.take(j[t : t + PIECE], 0)) for t in range(0, len(i), PIECE)]).astype(np.int64)
                evaluated += len(i)
                enough = np.flatnonzero(got >= floor.take(i))
                i, j, got = i[enough], j[enough], got[enough]
                other = q_ids[i] != self.ids[j]
                i, j, got = i[other], j[other], got[other]
                if len(i):
                    rows = np.unique(i)
                    who = np.concatenate((np.repeat(rows, k), i))
                    what, which = np.concatenate((score[rows].ravel(), got)), np.concatenate((ids[rows].ravel(), self.ids[j]))
                    order = np.lexsort((which, ~what, who))  # ~ turns the order around without overflow
                    who, what, which = who[order], what[order], which[order]
                    place = np.arange(len(who)) - np.searchsorted(who, who)
                    best = place < k
                    score[rows], ids[rows] = what[best].reshape(-1, k), which[best].reshape(-1, k)
                    known[rows] = np.minimum(k, known[rows] + np.bincount(i, minlength=len(q))[rows])
                    full = rows[known[rows] == k]
                    floor[full] = np.maximum(floor[full], score[full, k - 1])
                    low[full] = bound(floor[full], full)
                if len(open_):
                    open_ = open_[upper.ravel()[open_] >= low[open_ // width]]
        there = np.arange(k) < known[:, None]
        return np.nonzero(there)[0], ids[there], score[there], evaluated


def _places(open_: np.ndarray) -> np.ndarray:
    """Flat places of the true cells, of which there are few: eight cells are passed over at a time."""
    cells = open_.ravel()
    if len(cells) % 8:
        return np.flatnonzero(cells)
    eights = np.flatnonzero(cells.view(np.uint64) != 0)
    within = np.flatnonzero(cells.reshape(-1, 8).take(eights, 0))
    return eights.take(within >> 3) * 8 + (within & 7)


def block_top(q_ids: np.ndarray, q: np.ndarray, floor: np.ndarray, ids: np.ndarray, x: np.ndarray, table: np.ndarray, pivots: np.ndarray, k: int) -> tuple[list, list, list, int]:
    """query_id, vec_id and score of Chunk.nearest for one block of queries, from the vectors' distances to the pivots."""
    at, found, score, evaluated = Chunk(ids, x, pivots, table).nearest(q_ids, q, floor, k)
    return q_ids[at].tolist(), found.tolist(), score.tolist(), evaluated


def first_floor(q_ids: np.ndarray, q: np.ndarray, sample_ids: np.ndarray, sample: np.ndarray, k: int) -> np.ndarray:
    """Each query's k-th best score among the sample's vectors, one a distinct id and never its own; none: the least number."""
    if len(sample) <= k:
        return np.full(len(q), NONE)
    scores = _products(q, sample)
    scores[q_ids[:, None] == sample_ids[None, :]] = NONE
    return np.partition(scores, len(sample) - k, axis=1)[:, len(sample) - k]


def _rows(values: pa.BinaryArray, kind: str) -> np.ndarray:
    """Binaries of equal length as rows of a matrix."""
    ends = np.frombuffer(values.buffers()[1], np.int32)[values.offset : values.offset + len(values) + 1]
    return np.frombuffer(values.buffers()[2], np.uint8)[ends[0] : ends[-1]].view(kind).reshape(len(values), -1)


def _packed(rows: DataFrame, most: int, k: int, first: Broadcast | None = None) -> DataFrame:
    """part, dims, kind, ids, data, floor (binary): up to `most` rows of one part, length and type in one.

    rows: part, vec_id, dims, kind, v, floor. first: the sample, for queries; a null floor is taken from it.
    """
    schema = pa.schema({"part": pa.int32(), "dims": pa.int32(), "kind": pa.string(), "ids": pa.binary(), "data": pa.binary(), "floor": pa.binary()})

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            part, dims, kind, ids = (np.asarray(batch.column(c)) for c in ("part", "dims", "kind", "vec_id"))
            order = np.lexsort((kind.astype(str), dims, part))
            part, dims, kind, ids, out = part[order], dims[order], kind[order], ids[order], []
            new = np.flatnonzero((part[1:] != part[:-1]) | (dims[1:] != dims[:-1]) | (kind[1:] != kind[:-1])) + 1
            for begin, end in zip((0, *new), (*new, len(order)), strict=True):
                for at in range(begin, end, most):
                    to = min(end, at + most)
                    x, floor = _rows(batch.column("v").take(pa.array(order[at:to])), kind[at]), b""
                    if first is not None:
                        sample_ids, sample, _ = first.value
                        given = batch.column("floor").take(pa.array(order[at:to]))
                        floor, blank = np.array(given.fill_null(NONE)), np.flatnonzero(np.asarray(given.is_null()))
                        if len(blank) and sample.shape[1] == dims[at]:
                            floor[blank] = first_floor(ids[at:to][blank], x[blank], sample_ids, sample, k)
                        floor = floor.tobytes()
                    out.append({"part": int(part[at]), "dims": int(dims[at]), "kind": kind[at], "ids": ids[at:to].tobytes(), "data": x.tobytes(), "floor": floor})
            yield pa.RecordBatch.from_pylist(out, schema)

    return rows.select("part", "vec_id", "dims", "kind", "v", "floor").mapInArrow(pack, "part int, dims int, kind string, ids binary, data binary, floor binary")


def _meet(chunks: DataFrame, asked: DataFrame, tasks: int, k: int, shared: Broadcast) -> DataFrame:
    """query_id, vec_id, score: each task holds its rows of chunks, then streams its rows of asked over them. Both are packed, with their task."""

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        _, sample, pivots = shared.value
        held, chunk, waiting = defaultdict(list), {}, defaultdict(list)

        def answer(dims: int) -> pa.RecordBatch:
            q_ids, q, floor = (np.concatenate(c) for c in zip(*waiting.pop(dims), strict=True))
            at, ids, score, _ = chunk[dims].nearest(q_ids, q.astype(np.int64), floor, k)
            return pa.RecordBatch.from_arrays([pa.array(q_ids[at]), pa.array(ids), pa.array(score)], names=["query_id", "vec_id", "score"])

        for batch in batches:
            for r in range(batch.num_rows):
                row = {c: batch.column(c)[r].as_py() for c in ("query", "dims", "ids", "kind", "data", "floor")}
                dims, ids = row["dims"], np.frombuffer(row["ids"], np.int64)
                x = np.frombuffer(row["data"], row["kind"]).reshape(-1, dims)
                if not row["query"]:
                    held[dims].append((ids, x))
                    continue
                if dims in held:
                    own, xs = zip(*held.pop(dims), strict=True)
                    chunk[dims] = Chunk(np.concatenate(own), np.concatenate(xs), pivots if sample.shape[1] == dims else np.zeros((0, dims), np.int64))
                if dims in chunk:
                    waiting[dims].append((ids, x, np.frombuffer(row["floor"], np.int64)))
                    if sum(len(w[0]) for w in waiting[dims]) >= QUERIES:
                        yield answer(dims)
        for dims in list(waiting):
            yield answer(dims)

    both = chunks.withColumn("query", F.lit(False)).unionByName(asked.withColumn("query", F.lit(True)))
    return both.repartitionById(tasks, "task").sortWithinPartitions("query").mapInArrow(search, "query_id long, vec_id long, score long")


def _best(found: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def top_k(vectors: DataFrame, queries: DataFrame, k: int = 5) -> DataFrame:
    """query_id, rank (from 1), vec_id, score: the k vectors of highest integer inner product with each query.

    vectors, queries: vec_id, embedding. Ties go to the smaller vec_id; a query's own id is no
    candidate; only vectors of a query's length are. Fewer candidates give fewer rows; empty vectors
    (no components) take no part. Rows of a repeated id count once each. Scores are exact while
    sums stay within 64 bits. Of equal vectors the k + 1 smallest ids are candidates: no query has
    another among its k best. A task holds one chunk of the vectors, and queries pass by.
    """
    spark = vectors.sparkSession
    with scratch(spark) as kept:
        rows, asked = written(quantised(vectors)), written(quantised(queries))
        n, components = rows.agg(F.count("*"), F.coalesce(F.sum("dims"), F.lit(0))).first()
        picked = rows.orderBy(F.xxhash64("vec_id"), "vec_id").limit(SAMPLE).collect()  # a fixed number
        dims = max((r["dims"] for r in picked), default=0)
        distinct = {r["vec_id"]: np.frombuffer(r["v"], r["kind"]).astype(np.int64) for r in picked if r["dims"] == dims}
        sample_ids, sample = np.array(list(distinct), np.int64), np.array(list(distinct.values()), np.int64).reshape(len(distinct), dims)
        pivots = choose_pivots(sample, min(PIVOTS, max(1, 3 * dims // 4)))
        shared = spark.sparkContext.broadcast((sample_ids, sample, pivots))  # SAMPLE vectors at most
        count = max(1, -(-components // COMPONENTS), min(CHUNKS, -(-n // BLOCK)))
        equal = Window.partitionBy("h", "dims", "kind", "v").orderBy("vec_id")
        apart = rows.withColumn("h", F.xxhash64("v")).withColumn("place", F.dense_rank().over(equal)).where(F.col("place") <= k + 1)
        no_floor = F.lit(None).cast("long").alias("floor")
        stored = written(_packed(apart.select(F.pmod(F.xxhash64("h"), F.lit(count)).cast("int").alias("part"), "vec_id", "dims", "kind", "v", no_floor), BLOCK, k))
        begin, found = 0, None
        while begin < count:  # where there are 64 chunks: up to 1, 4, 16 and 64
            end = count if count < CHUNKS else min(count, max(-(-count // 64), 4 * begin))
            wide = end - begin
            parts = max(1, CHUNKS // (2 * wide)) if count >= CHUNKS else 1
            floors = None if found is None else _best(found, k).where(F.col("rank") == k).select(F.col("query_id").alias("vec_id"), F.col("score").alias("floor"))
            known = asked.withColumn("floor", F.lit(None).cast("long")) if floors is None else asked.join(floors, "vec_id", "left")
            ask = _packed(known.withColumn("part", F.pmod(F.xxhash64("vec_id"), F.lit(parts)).cast("int")), QUERIES, k, shared)
            task = lambda chunk, part, parts=parts: (F.col(chunk) * parts + F.col(part)).cast("int")
            upto = lambda m: F.explode(F.sequence(F.lit(0), F.lit(m - 1)))
            here = stored.where(f"part >= {begin} AND part < {end}").withColumn("chunk", F.col("part") - begin).withColumn("side", upto(parts)).withColumn("task", task("chunk", "side"))
            sent = ask.withColumn("chunk", upto(wide)).withColumn("side", F.col("part")).withColumn("task", task("chunk", "side"))
            met = _meet(here, sent, wide * parts, k, shared)
            met = met if end == count else written(met)
            found, begin = met if found is None else found.unionByName(met), end
        return kept(_best(found, k).select("query_id", "rank", "vec_id", "score"))
