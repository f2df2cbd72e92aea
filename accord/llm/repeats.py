"""Exact repeats of long byte strings, by a sparse suffix order.

Every LENGTH-byte window holds one anchor, the GRAM-byte string of least hash in it, and equal
windows have their anchor at the same place. So only suffixes that start at anchors are ordered,
and only those whose anchors' strings are equal need ordering among each other. Anchors whose whole
surroundings (all windows that have it as anchor) occur twice are settled by counting; the suffixes of
the rest are sorted deep-shallow: multikey quicksort to a shallow depth, blind tries for groups
with longer common prefixes. Neighbours' common prefixes, to the right and to the left of the
anchor, say which windows occur again. A string with very many differing surroundings is first
dealt by keys that go deeper: the bytes that STEP neighbouring windows have in common, and, where a
crowd shares even those, the windows themselves. So no task holds a crowd.

A passage of over 50 words can have fewer than LENGTH bytes. Passages of PASSAGE words that different
documents share are found likewise, by anchors among their LINK-word strings: surroundings that two
documents have are settled by counting, and of the rest the single windows are counted by their hashes.
"""

from __future__ import annotations

import hashlib
import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from accord.llm.common import written
from accord.llm.shingles import _INVERSE, _powers, chunks, mixed, word_hashes

LENGTH = 400
GRAM = 128
#: Depth at which multikey quicksort gives over to blind tries.
SHALLOW = 64
#: Groups up to this size are compared pair by pair along the order.
FEW = 12
#: Differing surroundings of one anchor string from which they are dealt by longer common strings, STEP offsets to a string.
CROWD, STEP = 4096, 16
#: Words of the passages that are told if different documents share them, and of the strings that are their anchors.
PASSAGE, LINK = 51, 8
AROUND = ("row_hash", "gram", "low", "at", "single", "bytes")


def common_prefix(a: bytes, b: bytes) -> int:
    low, high = 0, min(len(a), len(b))
    if a[:high] == b[:high]:
        return high
    while high - low > 1:
        middle = (low + high) // 2
        if a[low:middle] == b[low:middle]:
            low = middle
        else:
            high = middle
    return low


class _Node:
    """A branch of a blind trie: the depth at which its strings first differ, and a child by each byte (-1: end)."""

    __slots__ = ("children", "depth")

    def __init__(self, depth: int):
        self.depth, self.children = depth, {}


def blind_trie_order(strings: list[bytes], ids: list[int]) -> list[int]:
    """ids ordered by their strings. Searches look at branching bytes only, then compare once."""
    byte = lambda i, d: strings[i][d] if d < len(strings[i]) else -1
    root: _Node | list[int] = [ids[0]]
    for i in ids[1:]:
        at = root
        while isinstance(at, _Node):  # down, blindly
            at = at.children.get(byte(i, at.depth)) or next(iter(at.children.values()))
        same = common_prefix(strings[i], strings[at[0]])
        if same == len(strings[i]) == len(strings[at[0]]):
            at.append(i)
            continue
        above, at = None, root
        while isinstance(at, _Node) and at.depth < same:
            above, at = at, at.children[byte(i, at.depth)]
        if isinstance(at, _Node) and at.depth == same:
            at.children[byte(i, same)] = [i]
            continue
        leaf = at
        while isinstance(leaf, _Node):
            leaf = next(iter(leaf.children.values()))
        node = _Node(same)
        node.children = {byte(leaf[0], same): at, byte(i, same): [i]}
        if above is None:
            root = node
        else:
            above.children[byte(i, above.depth)] = node
    out, stack = [], [root]
    while stack:
        at = stack.pop()
        if isinstance(at, _Node):
            stack += [at.children[b] for b in sorted(at.children, reverse=True)]
        else:
            out += at
    return out


def deep_shallow_order(strings: list[bytes]) -> list[int]:
    """Indices in the order of the strings; of equal strings, the smaller index first."""
    out: list[int] = []
    stack: list[tuple[list[int], int]] = [(list(range(len(strings))), 0)]
    while stack:
        ids, depth = stack.pop()
        if len(ids) < 2:
            out += ids
        elif depth >= SHALLOW:
            out += blind_trie_order(strings, ids)
        else:
            keys = [strings[i][depth : depth + 8] for i in ids]
            pivot = keys[len(keys) // 2]
            less = [i for i, k in zip(ids, keys, strict=True) if k < pivot]
            equal = [i for i, k in zip(ids, keys, strict=True) if k == pivot]
            more = [i for i, k in zip(ids, keys, strict=True) if k > pivot]
            stack.append((more, depth))
            if len(pivot) < 8:  # the strings end here, so they are equal
                stack += [([i], depth) for i in reversed(equal)]
            else:
                stack.append((equal, depth + 8))
            stack.append((less, depth))
    return out


def repeated_offsets(left: list[bytes], right: list[bytes]) -> list[list[tuple[int, int]]]:
    """For each member the runs [low, high] of offsets o such that another member has the same window.

    Member i has left[i] before its anchor (read backwards) and right[i] from it on; its window of
    offset o is the last o bytes before the anchor and the LENGTH - o bytes from it on.
    """
    size = len(left)
    order = deep_shallow_order(right)
    lcp = [0] + [common_prefix(right[a], right[b]) for a, b in zip(order, order[1:], strict=False)]
    runs: list[list[tuple[int, int]]] = [[] for _ in range(size)]
    if size <= FEW:
        for x in range(size):
            shared = LENGTH
            for y in range(x + 1, size):
                shared = min(shared, lcp[y])
                if shared < GRAM:
                    break
                i, j = order[x], order[y]
                low, high = LENGTH - shared, common_prefix(left[i], left[j])
                if low <= high:
                    runs[i].append((low, high))
                    runs[j].append((low, high))
        return runs
    back = deep_shallow_order(left)
    back_lcp = np.array([0] + [common_prefix(left[a], left[b]) for a, b in zip(back, back[1:], strict=False)])
    lcp_, ahead, behind = np.array(lcp), np.empty(size, np.int64), np.empty(size, np.int64)
    n_left, n_right = np.array([len(x) for x in left]), np.array([len(x) for x in right])
    opened: dict[int, int] = {}
    for o in range(0, LENGTH - GRAM + 2):
        flagged: set[int] = set()
        can = np.flatnonzero((n_left >= o) & (n_right >= LENGTH - o)) if o <= LENGTH - GRAM else np.zeros(0, np.int64)
        if len(can) > 1:
            ahead[order] = np.cumsum(lcp_ < LENGTH - o)
            behind[back] = np.cumsum(back_lcp < o)
            _, inverse, count = np.unique(ahead[can] * (size + 1) + behind[can], return_inverse=True, return_counts=True)
            flagged = set(can[count[inverse] > 1].tolist())
        for i in flagged - opened.keys():
            opened[i] = o
        for i in opened.keys() - flagged:
            runs[i].append((opened.pop(i), o - 1))
    return runs


def _anchors_of(grams: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Anchors, and first and last window start of each, in a text of one window of `width` grams or more."""
    m = len(grams)
    mask = np.uint64((1 << m.bit_length()) - 1)
    packed = (grams & ~mask) | np.arange(m, dtype=np.uint64)
    padded = np.full(-(-m // width) * width, np.uint64(2**64 - 1))
    padded[:m] = packed
    blocks = padded.reshape(-1, width)
    ahead = np.minimum.accumulate(blocks, axis=1).reshape(-1)
    behind = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].reshape(-1)
    least = (np.minimum(behind[: m - width + 1], ahead[width - 1 : m]) & mask).astype(np.int64)
    first = np.flatnonzero(np.concatenate(([True], least[1:] != least[:-1])))
    return least[first], first, np.append(first[1:], len(least)) - 1


def _runs(grams: np.ndarray, own: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First and last of each run of anchors with the same string and surroundings, as a short period makes them."""
    first = np.flatnonzero(np.concatenate(([True], (grams[1:] != grams[:-1]) | (own[1:] != own[:-1]))))
    return first, np.append(first[1:], len(grams)) - 1


def _anchors(rows: DataFrame) -> DataFrame:
    """row_hash, gram, context (hashes), low, high (window starts), at (the anchor), last of every anchor of every text.

    Neighbours with the same string and surroundings are one row, that of the first; last is the last's high.
    """

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            row_hash = np.asarray(batch.column(1))
            for first, offsets, data in chunks(batch.column(0)):
                found = []
                power, inverse = _powers(len(data) + 1)
                sums = np.zeros(len(data) + 1, np.uint64)
                np.cumsum((data.astype(np.uint64) + np.uint64(1)) * power[: len(data)], out=sums[1:])
                for k in range(len(offsets) - 1):
                    a, b = offsets[k], offsets[k + 1]
                    if b - a < LENGTH:
                        continue
                    grams = mixed((sums[a + GRAM : b + 1] - sums[a : b - GRAM + 1]) * inverse[a : b - GRAM + 1])
                    at, low, high = _anchors_of(grams, LENGTH - GRAM + 1)
                    own = mixed((sums[a + high + LENGTH] - sums[a + low]) * inverse[a + low])
                    own = mixed(own * np.uint64(_INVERSE) + ((at - low) * 1024 + (high - low)).astype(np.uint64))
                    one, end = _runs(grams[at], own)
                    found.append((np.full(len(one), row_hash[first + k]), grams[at[one]].view(np.int64), own[one].view(np.int64), low[one], high[one], at[one], high[end]))
                if found:
                    yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in zip(*found, strict=True)], names=names)

    names = ["row_hash", "gram", "context", "low", "high", "at", "last"]
    return rows.select("text", "row_hash").mapInArrow(scan, "row_hash long, gram long, context long, low long, high long, at long, last long")


def _met(rows: DataFrame, by_row: DataFrame, how: str = "inner") -> DataFrame:
    """rows with the columns of by_row, by row_hash = of. All columns of rows are kept, so that texts are exchanged once for all such joins of a plan."""
    return rows.join(by_row, F.col("row_hash") == F.col("of"), how).select(*rows.columns, *(c for c in by_row.columns if c != "of"))


def _surroundings(rows: DataFrame, asked: DataFrame) -> DataFrame:
    """row_hash, gram, low, at, single, bytes for the asked anchors; each text is met once."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                text, items = batch.column("text")[k].as_py().encode(), batch.column("asked")[k].as_py()
                columns = {c: [x[c] for x in items] for c in ("gram", "low", "at", "single")}
                columns["bytes"] = [text[x["low"] : x["high"] + LENGTH] for x in items]
                columns = {"row_hash": [batch.column("row_hash")[k].as_py()] * len(items)} | columns
                yield pa.RecordBatch.from_pydict(columns, schema)

    schema = pa.schema([("row_hash", pa.int64()), ("gram", pa.int64()), ("low", pa.int64()), ("at", pa.int64()), ("single", pa.bool_()), ("bytes", pa.binary())])
    by_row = asked.groupBy(F.col("row_hash").alias("of")).agg(F.collect_list(F.struct("gram", "low", "high", "at", "single")).alias("asked"))
    return _met(rows, by_row).mapInArrow(cut, "row_hash long, gram long, low long, at long, single boolean, bytes binary")


def _compared(around: DataFrame) -> DataFrame:
    """row_hash, start, end: bytes covered by windows that another surrounding of the same anchor string has."""

    def settle(group: list[tuple]) -> Iterator[tuple[int, int, int]]:
        group = list({(g[0], g[2], g[3]): g for g in group}.values())
        left = [data[: at - low][::-1] for _, _, low, at, _, data in group]
        right = [data[at - low :] for _, _, low, at, _, data in group]
        for (row, _, low, at, single, data), runs in zip(group, repeated_offsets(left, right), strict=True):
            if single:
                least, most = max(0, at - (low + len(data) - LENGTH)), at - low
                for a, b in runs:
                    if max(a, least) <= min(b, most):
                        yield row, at - min(b, most), at - max(a, least) + LENGTH

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group: list[tuple] = []
        for batch in batches:
            out = []
            for item in zip(*(batch.column(c).to_pylist() for c in names), strict=True):
                if group and group[0][1] != item[1]:
                    out += settle(group) if len(group) > 1 else ()
                    group = []
                group.append(item)
            yield pa.RecordBatch.from_pydict({c: [x[k] for x in out] for k, c in enumerate(("row_hash", "start", "end"))}, schema)
        if len(group) > 1:
            out = list(settle(group))
            yield pa.RecordBatch.from_pydict({c: [x[k] for x in out] for k, c in enumerate(("row_hash", "start", "end"))}, schema)

    names = list(AROUND)
    schema = pa.schema([("row_hash", pa.int64()), ("start", pa.int64()), ("end", pa.int64())])
    return around.select(*names).repartition("gram").sortWithinPartitions("gram").mapInArrow(scan, "row_hash long, start long, end long")


def _cores(around: DataFrame, step: int) -> DataFrame:
    """row_hash, at, low, single, run, core: for each run of `step` offsets of each surrounding, a hash of what its windows share."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[tuple] = []
            for row, gram, low, at, single, data in zip(*(batch.column(c).to_pylist() for c in AROUND), strict=True):
                before = at - low
                for run in range(max(0, before - len(data) + LENGTH) // step, before // step + 1):
                    begin = before - run * step
                    core = hashlib.blake2b(struct.pack("<qq", gram, run) + data[begin : begin - step + 1 + LENGTH], digest_size=8).digest()
                    out.append((row, at, low, single, run, int.from_bytes(core, "little", signed=True)))
            yield pa.RecordBatch.from_pydict({c: [x[k] for x in out] for k, c in enumerate(schema.names)}, schema)

    schema = pa.schema([(c, pa.bool_() if c == "single" else pa.int64()) for c in ("row_hash", "at", "low", "single", "run", "core")])
    return around.mapInArrow(scan, "row_hash long, at long, low long, single boolean, run long, core long")


def _shared_cores(cores: DataFrame) -> DataFrame:
    """The cores that occur more than once, with n, the number of surroundings that hold each. Counted within each task first."""
    return cores.join(written(cores.groupBy("core").agg(F.count("*").alias("n")).where("n > 1")), "core")


def _dealt(around: DataFrame, step: int) -> DataFrame:
    """The columns of around and crowd: a row for each run of offsets whose core others hold, with the core for gram."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[tuple] = []
            for row, _, low, at, single, data, runs in zip(*(batch.column(c).to_pylist() for c in (*AROUND, "runs")), strict=True):
                least, most = max(0, at - low - len(data) + LENGTH), at - low
                for x in runs:
                    first, last = max(x["run"] * step, least), min(x["run"] * step + step - 1, most)
                    out.append((row, x["core"], at - last, at, single, data[most - last : most - first + LENGTH], x["crowd"]))
            yield pa.RecordBatch.from_pydict({c: [x[k] for x in out] for k, c in enumerate(schema.names)}, schema)

    kinds = {"single": pa.bool_(), "crowd": pa.bool_(), "bytes": pa.binary()}
    schema = pa.schema([(c, kinds.get(c, pa.int64())) for c in (*AROUND, "crowd")])
    shared = _shared_cores(written(_cores(around, step)))
    runs = shared.groupBy("row_hash", "at", "low").agg(F.collect_list(F.struct("run", "core", (F.col("n") > CROWD).alias("crowd"))).alias("runs"))
    met = around.join(runs, ["row_hash", "at", "low"]).select(*AROUND, "runs")
    return met.mapInArrow(cut, "row_hash long, gram long, low long, at long, single boolean, bytes binary, crowd boolean")


def _settled(rows: DataFrame, asked: DataFrame) -> DataFrame:
    """row_hash, start, end: bytes covered by windows of the asked surroundings that other asked ones have."""
    around = _surroundings(rows, asked.where("not crowd"))
    if not asked.where("crowd").limit(1).count():
        return _compared(around)
    crowds = written(_surroundings(rows, asked.where("crowd")).dropDuplicates(["row_hash", "at", "low"]))
    dealt = written(_dealt(crowds, STEP))
    # where a crowd shares even the longer string, keys of the windows' whole depth leave equal ones together, to be counted
    last = _shared_cores(written(_cores(dealt.where("crowd").drop("crowd"), 1))).where("single")
    last = last.select("row_hash", (F.col("at") - F.col("run")).alias("start"), (F.col("at") - F.col("run") + LENGTH).alias("end"))
    return _compared(around.unionByName(dealt.where("not crowd").drop("crowd"))).unionByName(last)


def _word_sums(words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Running sums of word hashes by place, and the factors that take a place out again."""
    power, inverse = _powers(len(words) + 1)
    sums = np.zeros(len(words) + 1, np.uint64)
    np.cumsum(words * power[: len(words)], out=sums[1:])
    return sums, inverse


def _word_anchors(rows: DataFrame) -> DataFrame:
    """row_hash, gram, context (hashes), low, high (window starts, in words) of every anchor of PASSAGE-word windows.

    Neighbours with the same string and surroundings are one row, from the first's low to the last's high.
    """

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            row_hash = np.asarray(batch.column(1))
            for first, offsets, data in chunks(batch.column(0)):
                by_row, words = word_hashes(offsets, data)
                sums, inverse = _word_sums(words)
                found = []
                for k in np.flatnonzero(np.diff(by_row) >= PASSAGE):
                    a, b = by_row[k], by_row[k + 1]
                    grams = mixed((sums[a + LINK : b + 1] - sums[a : b - LINK + 1]) * inverse[a : b - LINK + 1])
                    at, low, high = _anchors_of(grams, PASSAGE - LINK + 1)
                    own = mixed((sums[a + high + PASSAGE] - sums[a + low]) * inverse[a + low])
                    own = mixed(own * np.uint64(_INVERSE) + ((at - low) * 1024 + (high - low)).astype(np.uint64))
                    one, end = _runs(grams[at], own)
                    found.append((np.full(len(one), row_hash[first + k]), grams[at[one]].view(np.int64), own[one].view(np.int64), low[one].astype(np.int32), high[end].astype(np.int32)))
                if found:
                    yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in zip(*found, strict=True)], names=names)

    names = ["row_hash", "gram", "context", "low", "high"]
    return rows.select("text", "row_hash").mapInArrow(scan, "row_hash long, gram long, context long, low int, high int")


def _windows(rows: DataFrame, asked: DataFrame) -> DataFrame:
    """row_hash, start, key (its hash), sure of each PASSAGE-word window of the asked runs of window starts."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            row_hash, runs, found = np.asarray(batch.column("row_hash")), batch.column("asked"), []
            for first, offsets, data in chunks(batch.column("text")):
                by_row, words = word_hashes(offsets, data)
                sums, inverse = _word_sums(words)
                for k in range(len(offsets) - 1):
                    own = runs[first + k].values
                    low, n = np.asarray(own.field("low")).astype(np.int64), np.asarray(own.field("n")).astype(np.int64)
                    start = np.repeat(low - np.cumsum(n) + n, n) + np.arange(n.sum())
                    at = by_row[k] + start
                    key = mixed((sums[at + PASSAGE] - sums[at]) * inverse[at])
                    sure = np.repeat(own.field("sure").to_numpy(zero_copy_only=False), n)
                    found.append((np.full(len(at), row_hash[first + k]), start.astype(np.int32), key.view(np.int64), sure))
            if found:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in zip(*found, strict=True)], names=["row_hash", "start", "key", "sure"])

    run = F.struct("low", (F.col("high") - F.col("low") + 1).alias("n"), "sure")
    by_row = asked.groupBy(F.col("row_hash").alias("of")).agg(F.collect_list(run).alias("asked"))
    return _met(rows, by_row).mapInArrow(cut, "row_hash long, start int, key long, sure boolean")


def _passages(rows: DataFrame) -> DataFrame:
    """row_hash, start, end (in words): runs of words covered by PASSAGE-word windows that a row of another id or text has."""
    every = written(_word_anchors(rows))
    apart = F.min("row_hash") < F.max("row_hash")
    shared = written(every.groupBy("gram").agg(apart.alias("apart")).where("apart").select("gram"))
    anchors = written(every.join(shared, "gram", "left_semi"))
    contexts = written(anchors.groupBy("gram", "context").agg(apart.alias("sure"), F.min(F.struct("row_hash", "low", "high")).alias("place")))
    # a string whose every surroundings two documents have, or that has one surroundings alone, has nothing open
    open_ = written(contexts.groupBy("gram").agg(F.count("*").alias("k"), F.every("sure").alias("each")).where("k > 1 and not each").select("gram", F.lit(True).alias("open")))
    known = contexts.join(open_, "gram", "left").where("sure or open").select(F.col("gram").alias("of"), F.col("context").alias("again"), "sure")
    placed = written(anchors.join(known, (F.col("gram") == F.col("of")) & (F.col("context") == F.col("again"))).select("row_hash", "low", "high", "sure"))
    settled = placed.where("sure").select("row_hash", F.col("low").alias("start"), (F.col("high") + PASSAGE).alias("end"))
    asked = placed.where("not sure").unionByName(contexts.where("sure").join(open_, "gram", "left_semi").select("place.*", "sure"))
    windows = _windows(rows, asked)
    met = windows.groupBy("key").agg(apart.alias("apart"), F.max("sure").alias("one"), F.min("sure").alias("each")).where("(apart or one) and not each").select(F.col("key").alias("again"))
    found = windows.where("not sure").join(met, F.col("key") == F.col("again"), "left_semi")
    return settled.unionByName(found.select("row_hash", "start", (F.col("start") + PASSAGE).alias("end")))


def repeats(docs: DataFrame) -> DataFrame:
    """doc_id, text, spans, passages: each input row with the byte runs covered by a LENGTH-byte string found elsewhere.

    spans: array<struct<start, end>>, overlaps included, ends exclusive; null or empty where nothing repeats.
    Elsewhere is another place of the same text or any other row, repeated rows included. Texts are
    judged as given. Null texts count as empty; texts shorter than LENGTH bytes have no spans.
    passages: likewise, in words, the runs covered by PASSAGE words in a row that a row of another id or
    text has too, whatever separates them.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text"), F.xxhash64(F.col("doc_id").cast("long"), text).alias("row_hash"))
    every = written(_anchors(rows))
    # written, so that the join is of two plain exchanges and a hot string's anchors are split over tasks
    times = F.sum(F.when(F.col("last") > F.col("high"), 2).otherwise(1)).alias("n")  # 2 stands for 2 or more
    shared = written(every.groupBy("gram").agg(times).where("n > 1").select("gram"))
    anchors = written(every.join(shared, "gram", "left_semi"))  # most anchors' strings occur once
    place = F.struct("row_hash", "low", "high", "at")
    contexts = written(anchors.groupBy("gram", "context").agg(times, F.min(place).alias("place")))
    twice = contexts.where("n > 1").select(F.col("context").alias("again"), F.col("gram").alias("of"))
    settled = anchors.join(twice, (F.col("context") == F.col("again")) & (F.col("gram") == F.col("of")), "left_semi")
    settled = settled.select("row_hash", F.col("low").alias("start"), (F.col("last") + LENGTH).alias("end"))
    open_ = written(contexts.groupBy("gram").agg(F.count("*").alias("k"), F.min("n").alias("least")).where("k > 1 and least = 1").select("gram", (F.col("k") > CROWD).alias("crowd")))
    asked = contexts.join(open_, "gram").select("gram", "place.*", (F.col("n") == 1).alias("single"), "crowd")
    found = settled.unionByName(_settled(rows, asked)).withColumn("words", F.lit(False))
    found = found.unionByName(_passages(rows).withColumn("words", F.lit(True)))
    run = F.struct("start", "end")
    spans = found.groupBy(F.col("row_hash").alias("of")).agg(F.collect_set(F.when(~F.col("words"), run)).alias("spans"), F.collect_set(F.when(F.col("words"), run)).alias("passages"))
    return _met(rows, spans, "left").select("doc_id", "text", "spans", "passages")


def _covered(spans: list[dict] | None) -> int:
    """How many places the spans cover, overlaps counted once."""
    n, at = 0, 0
    for a, b in sorted((s["start"], s["end"]) for s in spans or ()):
        n += max(0, b - max(a, at))
        at = max(at, b)
    return n


def remove_repeats(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans (maximal removed runs), kept (binary), n_passage_words of each input row."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, 500):
                part = batch.slice(start, 500)
                out = []
                for text, spans, passages in zip(*(part.column(c).to_pylist() for c in ("text", "spans", "passages")), strict=True):
                    data, kept, at, runs, gone = text.encode(), [], 0, 0, 0
                    for a, b in sorted((s["start"], s["end"]) for s in spans or ()):
                        if a > at or not runs:
                            kept.append(data[at:a])
                            runs += 1
                            gone += b - a
                            at = b
                        elif b > at:
                            gone += b - at
                            at = b
                    out.append((len(data), gone, runs, b"".join(kept) + data[at:], _covered(passages)))
                columns = [pa.array([x[k] for x in out], kind) for k, kind in enumerate((pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.int64()))]
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), *columns], names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept", "n_passage_words"])

    return repeats(docs).mapInArrow(cut, "doc_id long, n_bytes long, n_removed long, n_spans long, kept binary, n_passage_words long")


def digest(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256, n_passage_words of every input row.

    Null texts count as empty: nothing removed, the hash of no bytes. Repeated rows repeat each
    other, so from LENGTH bytes on they are removed whole, each of them. n_passage_words: the
    words in passages of PASSAGE words or more that a row of another id or text has too; they are told, and
    removed only as far as LENGTH bytes repeat. Other columns are not read; empty input gives no rows.
    """
    return remove_repeats(docs).select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"), "n_passage_words")
