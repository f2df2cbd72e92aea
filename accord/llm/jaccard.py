"""Near-duplicates by exact Jaccard similarity of word shingles, with vertical partitioning.

All shingles stand in one global order: rare ones first, by hash, then those that a first count over
prefixes found in many sets, then those in hot buckets by frequency. The order is cut into fragments,
hot buckets by their counts. A fragment sees only its own part of every document's
prefix (the rarest quarter of its shingles) and counts, per pair, the overlap within the fragment;
the counts are summed per pair, and a bound on the whole overlap discards most pairs. What is left
is verified on whole sets, read once a class. Documents of equal sets are one class throughout. Lists longer than LONG give links to a few hub members at first; members that are
still in different components afterwards are compared with each other, under the same bound, block
by block in tasks apart, so no link is lost.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from accord.llm.common import scratch, written
from accord.llm.shingles import mixed, set_digest, shingle_sets
from accord.operators.graph import components

WIDTH = 5
#: Buckets of the frequency table that orders shingles: one byte each is broadcast, and the runs of hot ones.
BUCKET_BITS = 22
#: Parts in which bucket counts are summed.
PARTS = 16
#: Postings of a fragment, on average.
FRAGMENT = 200_000
#: Hashes that a task gathers before it counts them or cuts them into fragments.
GATHER = 300_000
#: Classes that a task remembers so as not to send them twice; what comes twice all the same is dropped later.
REMEMBER = 200_000
#: Lists up to this length give all their pairs at once.
LONG = 8
#: Turns in which open lists are linked through so many further hubs, before the rest is compared pair by pair.
TURNS, HUBS = 1, 4
#: Bits of the filters on classes that need verifying and on common shingles, at most (16 MB each); false hits only cost time.
FILTER_BITS = 27
#: Members of a list in one block, on average; a task compares two blocks.
MEMBERS = 2048
#: Members that are compared at once with as many others, over so many lists at once.
BLOCK, COLUMNS = 1024, 8192
#: Sizes of a list that are compared at once with all others.
ROWS = 256


def prefix_length(n):
    """Shingles of a set of n, first in the global order, of which a similar set must hold one."""
    return n - (3 * n + 3) // 4 + 1


def _remember(seen: set, key: tuple) -> None:
    if len(seen) >= REMEMBER:
        seen.clear()
    seen.add(key)


def _dealt(rows: DataFrame, *keys: str) -> DataFrame:
    """rows dealt by keys over all shuffle partitions: what costs time here is small in bytes, which Spark would merge."""
    return rows.repartition(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), *keys)


def _unlike(*keys: np.ndarray) -> np.ndarray:
    """Whether each row of sorted keys differs from the one before."""
    new = np.ones(len(keys[0]), bool)
    new[1:] = False
    for k in keys:
        new[1:] |= k[1:] != k[:-1]
    return new


def keyed(docs: DataFrame) -> DataFrame:
    text = F.coalesce(F.col("text"), F.lit(""))
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text"), F.xxhash64(F.col("doc_id").cast("long"), text).alias("row_hash"))


def _classes(rows: DataFrame) -> DataFrame:
    """doc_id, row_hash, n, cls of each row; and, with part not null, the task's bucket counts."""

    def add(counts: np.ndarray, hashes: list[np.ndarray]) -> None:
        if hashes:
            bucket = np.sort((np.concatenate(hashes) >> np.uint64(64 - BUCKET_BITS)).astype(np.int32))
            first = np.flatnonzero(np.concatenate((np.ones(min(1, len(bucket)), bool), bucket[1:] != bucket[:-1])))
            counts[bucket[first]] += np.diff(np.append(first, len(bucket))).astype(np.uint32)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts, held, size = np.zeros(1 << BUCKET_BITS, np.uint32), [], 0
        for batch in batches:
            n, cls = np.zeros(batch.num_rows, np.int64), np.zeros(batch.num_rows, np.int64)
            for row, hashes in shingle_sets(batch.column(1), WIDTH):
                n[row], cls[row] = len(hashes), set_digest(hashes)
                held.append(hashes)
                size += len(hashes)
                if size > GATHER:
                    add(counts, held)
                    held, size = [], 0
            none = pa.nulls(batch.num_rows)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(n), pa.array(cls), none.cast(pa.int32()), none.cast(pa.binary())], names=names)
        add(counts, held)
        for part, own in enumerate(np.split(counts.astype("<u4"), PARTS)):
            empty = [pa.nulls(1, pa.int64())] * 4
            yield pa.RecordBatch.from_arrays([*empty, pa.array([part], pa.int32()), pa.array([zlib.compress(own.tobytes(), 1)], pa.binary())], names=names)

    names = ["doc_id", "row_hash", "n", "cls", "part", "counts"]
    return rows.select("doc_id", "text", "row_hash").mapInArrow(scan, "doc_id long, row_hash long, n long, cls long, part int, counts binary")


def _levels(scanned: DataFrame, shingles: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each bucket 0, or how much hotter than the mean it is (log2), in 2 ** BUCKET_BITS bytes; and _ranges."""
    mean = max(8.0, shingles / (1 << BUCKET_BITS))

    def add(key: tuple, table: pa.Table) -> pa.Table:
        total = np.zeros((1 << BUCKET_BITS) // PARTS, np.int64)
        for blob in table.column("counts").to_pylist():
            total += np.frombuffer(zlib.decompress(blob), "<u4")
        level = np.where(total >= 8 * mean, np.log2(np.maximum(total, 1) / mean), 0).astype(np.uint8)
        hot = total[level > 0]
        return pa.table({"part": pa.array([key[0].as_py()], pa.int32()), "level": pa.array([level.tobytes()], pa.binary()), "hot": pa.array([hot.tobytes()], pa.binary())})

    # a bucket is hot from 8 times the mean on, so at most an eighth of them sends its count
    got = scanned.where("part is not null").select("part", "counts").groupBy("part").applyInArrow(add, "part int, level binary, hot binary").collect()
    out, hot = np.zeros(1 << BUCKET_BITS, np.uint8).reshape(PARTS, -1), [b""] * PARTS
    for row in got:
        out[row["part"]], hot[row["part"]] = np.frombuffer(row["level"], np.uint8), bytes(row["hot"])
    level = out.reshape(-1)
    bucket = np.flatnonzero(level)
    return (level, *_ranges(level[bucket].astype(np.int64) << BUCKET_BITS | bucket, np.frombuffer(b"".join(hot), np.int64)))


def _ranges(keys: np.ndarray, totals: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts of runs of the hot buckets (level, bucket) in order, and the number of fragments of each run.

    Runs hold under 2 * FRAGMENT postings and end with their level. A bucket of more is a run of its
    own, whose classes are dealt over as many fragments as it needs.
    """
    order = np.argsort(keys)
    keys, totals = keys[order], totals[order]
    run, wide, level = (np.cumsum(totals) - totals) // FRAGMENT, totals > FRAGMENT, keys >> BUCKET_BITS
    new = np.ones(len(keys), bool)
    new[1:] = (run[1:] != run[:-1]) | wide[1:] | wide[:-1] | (level[1:] != level[:-1])
    return keys[new], np.where(wide[new], -(-totals[new] // FRAGMENT), 1)


def _flagged(bits: np.ndarray, keys: np.ndarray) -> np.ndarray:
    """Whether the filter holds each of keys (or seems to)."""
    at = mixed(keys) >> np.uint64(64 - (8 * len(bits)).bit_length() + 1)
    return (bits[(at >> np.uint64(3)).astype(np.int64)] >> (at & np.uint64(7)).astype(np.uint8) & 1).astype(bool)


def _common(rows: DataFrame, levels, fragments: int) -> DataFrame:
    """h: shingles, cut to 48 bits, that more than LONG prefixes hold, those in hot buckets aside.

    Prefixes are cut by the levels alone here. Equal sets of different tasks count again: the result
    only puts shingles later in the global order, which any function of the shingle may do.
    """

    def blobs(held: list[np.ndarray]) -> pa.RecordBatch:
        h = np.sort(np.concatenate(held))
        fragment = ((h >> np.uint64(40)) * np.uint64(fragments) >> np.uint64(24)).astype(np.int32)
        cut = np.flatnonzero(_unlike(fragment)) if len(h) else np.zeros(0, np.int64)
        short = (h >> np.uint64(16)).astype("<u8").view(np.uint8).reshape(-1, 8)[:, :6]
        return pa.RecordBatch.from_arrays([pa.array(fragment[cut]), pa.array([short[a:b].tobytes() for a, b in zip(cut, [*cut[1:], len(h)], strict=True)], pa.binary())], names=["fragment", "hashes"])

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        (level_of, *_), seen, held, size = levels.value, set(), [], 0
        for batch in batches:
            for _, own in shingle_sets(batch.column(0), WIDTH):
                if not len(own) or (key := (set_digest(own), len(own))) in seen:
                    continue
                _remember(seen, key)
                rare = own[level_of[(own >> np.uint64(64 - BUCKET_BITS)).astype(np.int64)] == 0]
                held.append(rare[: prefix_length(len(own))])
                size += len(held[-1])
                if size > GATHER:
                    yield blobs(held)
                    held, size = [], 0
        if held:
            yield blobs(held)

    def count(table: pa.Table) -> pa.Table:
        parts = [np.frombuffer(x, np.uint8).reshape(-1, 6) for x in table.column("hashes").to_pylist()]
        wide = np.zeros((sum(len(x) for x in parts), 8), np.uint8)
        wide[:, :6] = np.concatenate(parts)
        h = np.sort(wide.view("<u8").reshape(-1))
        first = np.flatnonzero(_unlike(h))
        return pa.table({"h": h[first][np.diff(np.append(first, len(h))) > LONG].view(np.int64)})

    return rows.select("text").mapInArrow(scan, "fragment int, hashes binary").groupBy("fragment").applyInArrow(count, "h long")


def _postings(rows: DataFrame, levels, common, fragments: int) -> DataFrame:
    """fragment, hashes, owners, classes, sizes (binary): the prefixes' shingles, many to a row, cut by fragment.

    Hashes are cut to 48 bits here: a chance meeting only adds a pair to be verified. owners are numbers
    into the row's table of classes and sizes. The runs of hot buckets follow the fragments of the others;
    a fragment that holds only some classes of its bucket has a negative number.
    """

    def blobs(hashes: list, classes: list, sizes: list, tables: tuple) -> pa.RecordBatch:
        level_of, starts, parts = tables
        h = np.concatenate(hashes)
        count = [len(x) for x in hashes]
        owner = np.repeat(np.arange(len(count), dtype=np.uint32), count)
        table = np.array(classes, np.int64), np.array(sizes, np.uint32)
        bucket = (h >> np.uint64(64 - BUCKET_BITS)).astype(np.int64)
        level = level_of[bucket].astype(np.int64)
        fragment = ((h >> np.uint64(40)) * np.uint64(fragments) >> np.uint64(24)).astype(np.int64)
        if len(hot := np.flatnonzero(level)):
            run = np.searchsorted(starts, level[hot] << BUCKET_BITS | bucket[hot], "right") - 1
            salt = (mixed(table[0].view(np.uint64))[owner[hot]] % parts[run].astype(np.uint64)).astype(np.int64)
            number = fragments + (np.cumsum(parts) - parts)[run] + salt
            fragment[hot] = np.where(parts[run] > 1, -number, number)
        order = np.argsort(fragment, kind="stable")
        fragment, owner = fragment[order], owner[order]
        short = (h[order] >> np.uint64(16)).astype("<u8").view(np.uint8).reshape(-1, 8)[:, :6]
        cut = np.flatnonzero(np.concatenate(([True], fragment[1:] != fragment[:-1])))
        rows: list[list[bytes]] = [[], [], [], []]
        for a, b in zip(cut, [*cut[1:], len(h)], strict=True):
            used, place = np.unique(owner[a:b], return_inverse=True)
            for column, x in zip(rows, (short[a:b], place.astype(np.uint32 if len(used) > 65536 else np.uint16), table[0][used], table[1][used]), strict=True):
                column.append(x.tobytes())
        return pa.RecordBatch.from_arrays([pa.array(fragment[cut], pa.int32()), *(pa.array(x, pa.binary()) for x in rows)], names=names)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        (level_of, *_), flags, seen = levels.value, common.value, set()
        hashes, classes, sizes, held = [], [], [], 0
        for batch in batches:
            for _, own in shingle_sets(batch.column(0), WIDTH):
                if not len(own) or (key := (set_digest(own), len(own))) in seen:
                    continue
                _remember(seen, key)
                level = np.maximum(level_of[(own >> np.uint64(64 - BUCKET_BITS)).astype(np.int64)], _flagged(flags, own >> np.uint64(16)))
                if level.any():
                    own = own[np.argsort(level, kind="stable")]
                hashes.append(own[: prefix_length(len(own))])
                classes.append(key[0])
                sizes.append(key[1])
                held += len(hashes[-1])
                if held > GATHER:
                    yield blobs(hashes, classes, sizes, levels.value)
                    hashes, classes, sizes, held = [], [], [], 0
        if held:
            yield blobs(hashes, classes, sizes, levels.value)

    names = ["fragment", "hashes", "owners", "classes", "sizes"]
    return rows.select("text").mapInArrow(scan, "fragment int, hashes binary, owners binary, classes binary, sizes binary")


def _meets(postings: DataFrame) -> DataFrame:
    """Rows a, b, na, nb, shared of pairs (shared -1: from a long list), and with b null the members a of list `shared`.

    Lists of a fragment of negative number have members elsewhere too, so all of them count as long.
    """

    def meet(table: pa.Table) -> pa.Table:
        apart = table.column("fragment")[0].as_py() < 0
        parts: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        for hashes, owners, classes, sizes in zip(*(table.column(x).to_pylist() for x in ("hashes", "owners", "classes", "sizes")), strict=True):
            wide = np.zeros((len(hashes) // 6, 8), np.uint8)
            wide[:, :6] = np.frombuffer(hashes, np.uint8).reshape(-1, 6)
            place = np.frombuffer(owners, np.uint16 if len(owners) == 2 * len(wide) else np.uint32)
            parts.append((wide.view("<u8").reshape(-1), np.frombuffer(classes, np.int64)[place], np.frombuffer(sizes, np.uint32)[place].astype(np.int64)))
        h, c, n = (np.concatenate(x) for x in zip(*parts, strict=True))
        order = np.lexsort((n, c, h))
        h, c, n = h[order], c[order], n[order]
        new = _unlike(h, c, n)
        h, c, n = h[new], c[new], n[new]
        # a shingle of one class has no meeting; a class with members elsewhere has
        first = np.flatnonzero(_unlike(h))
        if not apart:
            length = np.diff(np.append(first, len(h)))
            met = np.repeat(length > 1, length)
            h, c, n = h[met], c[met], n[met]
            first = np.flatnonzero(_unlike(h))
        length = np.diff(np.append(first, len(h)))
        size, head = np.repeat(length, length), np.repeat(first, length)
        fits = lambda i, j: 4 * np.minimum(n[i], n[j]) >= 3 * np.maximum(n[i], n[j])
        short = (size > 1) & (size <= LONG) & (not apart)
        pairs = []
        i, stop = np.flatnonzero(short), head + size
        for gap in range(1, LONG):
            i = i[i + gap < stop[i]]
            ok = fits(i, i + gap)
            pairs.append(np.stack((i[ok], i[ok] + gap)))
        i, j = np.concatenate(pairs, axis=1)
        # the overlap of each pair within this fragment
        order = np.lexsort((n[j], c[j], n[i], c[i]))
        i, j = i[order], j[order]
        at = np.flatnonzero(_unlike(c[i], n[i], c[j], n[j]))
        shared = np.diff(np.append(at, len(i)))
        i, j = i[at], j[at]
        in_long = np.flatnonzero((size > LONG) | apart)
        star = in_long[head[in_long] != in_long]
        hub = head[star]
        star, hub = star[ok := fits(star, hub)], hub[ok]
        order = np.lexsort((c[star], c[hub]))
        star, hub = star[order], hub[order]
        once = _unlike(c[hub], c[star])
        star, hub = star[once], hub[once]
        a, b = np.concatenate((i, hub, in_long)), np.concatenate((j, star, in_long))
        count = np.concatenate((shared, np.full(len(hub), -1), h[in_long].view(np.int64)))
        lists = np.arange(len(a)) >= len(a) - len(in_long)
        return pa.table({"a": c[a], "b": pa.array(c[b], mask=lists), "na": n[a], "nb": n[b], "shared": count})

    return postings.groupBy("fragment").applyInArrow(meet, "a long, b long, na long, nb long, shared long")


def _filter(classes: DataFrame) -> np.ndarray:
    """A bitmap on which the bit of every row's first column is set: about 16 bits a row, 2 ** FILTER_BITS at most.

    Each task sets the bits of its own rows; words of 64 bits are OR-ed in tasks, then by word over all.
    """
    width = min(FILTER_BITS, max(16, (16 * classes.count()).bit_length()))

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = np.zeros((1 << width) // 8, np.uint8)
        for batch in batches:
            at = mixed(np.asarray(batch.column(0)).astype(np.int64).view(np.uint64)) >> np.uint64(64 - width)
            np.bitwise_or.at(bits, (at >> np.uint64(3)).astype(np.int64), np.uint8(1) << (at & np.uint64(7)).astype(np.uint8))
        words = bits.view(np.int64)
        used = np.flatnonzero(words)
        yield pa.RecordBatch.from_arrays([pa.array(used.astype(np.int32)), pa.array(words[used])], names=["word", "bits"])

    words = classes.mapInArrow(scan, "word int, bits long").groupBy("word").agg(F.bit_or("bits").alias("bits")).toArrow()  # 2 ** FILTER_BITS / 64 rows at most
    out = np.zeros((1 << width) // 64, np.int64)
    out[np.asarray(words.column("word"))] = np.asarray(words.column("bits"))
    return out.view(np.uint8)


def _whole_sets(rows: DataFrame, wanted: DataFrame) -> DataFrame:
    """cls, n, own: the shingles of each wanted class, once a class."""
    bits = rows.sparkSession.sparkContext.broadcast(_filter(wanted.select("cls")))

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        flags, seen = bits.value, set()
        width = (8 * len(flags)).bit_length() - 1
        for batch in batches:
            out: list[tuple[int, int, np.ndarray]] = []
            for _, own in shingle_sets(batch.column(0), WIDTH):
                if not len(own) or (key := (set_digest(own), len(own))) in seen:
                    continue
                _remember(seen, key)
                at = int(mixed(np.array([key[0]], np.int64).view(np.uint64))[0]) >> (64 - width)
                if flags[at >> 3] >> (at & 7) & 1:
                    out.append((*key, own.view(np.int64)))
            if out:
                ends = np.concatenate(([0], np.cumsum([len(x[2]) for x in out])))
                lists = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.concatenate([x[2] for x in out])))
                yield pa.RecordBatch.from_arrays([pa.array([x[k] for x in out], pa.int64()) for k in range(2)] + [lists], names=["cls", "n", "own"])

    sets = rows.select("text").mapInArrow(scan, "cls long, n long, own array<long>").join(wanted, ["cls", "n"], "left_semi")
    return written(sets.groupBy("cls", "n").agg(F.first("own").alias("own")))


def _verified(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """a, na, b, nb of the pairs that link."""
    left = sets.select(F.col("cls").alias("a"), F.col("n").alias("na"), F.col("own").alias("own_a"))
    right = sets.select(F.col("cls").alias("b"), F.col("n").alias("nb"), F.col("own").alias("own_b"))
    met = pairs.select("a", "na", "b", "nb").join(left, ["a", "na"]).join(right, ["b", "nb"])
    return met.where(7 * F.size(F.array_intersect("own_a", "own_b")).cast("long") >= 3 * (F.col("na") + F.col("nb"))).select("a", "na", "b", "nb")


def _node(cls: str, n: str) -> Column:
    return F.struct(F.col(cls).alias("cls"), F.col(n).alias("n"))


def _components(links: DataFrame) -> DataFrame:
    """cls, n, root of all linked classes."""
    found = components(links.select(_node("a", "na").alias("a"), _node("b", "nb").alias("b")))
    return written(found.select(F.col("node.cls").alias("cls"), F.col("node.n").alias("n"), F.col("component").alias("root")))


def _open_lists(lists: DataFrame, found: DataFrame) -> DataFrame:
    """h, cls, n, root: the members of long lists that hold more than one component as yet."""
    placed = lists.join(found, ["cls", "n"], "left").withColumn("root", F.coalesce("root", _node("cls", "n")))
    open_ = placed.groupBy("h").agg(F.min("root").alias("low"), F.max("root").alias("high")).where("low <> high").select("h")
    return written(placed.join(open_, "h", "left_semi"))


def _hub_pairs(placed: DataFrame, turn: int) -> DataFrame:
    """a, na, b, nb: every member of a list with the list's hubs of another component. Linear in the lists."""
    member = F.struct("cls", "n", "root")
    hubs = [F.min_by(member, F.xxhash64("cls", "n", F.lit(turn * HUBS + k))).alias(f"hub{k}") for k in range(HUBS)]
    chosen = placed.groupBy("h").agg(*hubs).select("h", F.explode(F.array_distinct(F.array(*(f"hub{k}" for k in range(HUBS))))).alias("hub"))
    met = placed.join(chosen, "h").where("root <> hub.root and 4 * least(n, hub.n) >= 3 * greatest(n, hub.n)")
    low, high = F.least(_node("cls", "n"), F.struct("hub.cls", "hub.n")), F.greatest(_node("cls", "n"), F.struct("hub.cls", "hub.n"))
    return met.select(low.alias("x"), high.alias("y")).select(F.col("x.cls").alias("a"), F.col("x.n").alias("na"), F.col("y.cls").alias("b"), F.col("y.n").alias("nb")).distinct()


def _needed(na, nb):
    """Shingles that the prefixes of two sets must share, at least, for the sets to link."""
    return -(-3 * (na + nb) // 7) - np.maximum((3 * na + 3) // 4, (3 * nb + 3) // 4) + 1


def _viable(placed: DataFrame) -> DataFrame:
    """placed without members that no other member of the list can link with over long lists alone.

    Two members share at most as many lists as the one in fewer of them is in; their sizes say how
    many they need. A pair that shares enough stays in all lists that it shares, so none is lost,
    and pairs that share short lists as well were counted before.
    Members come to no task: of each list and size the most lists a member is in, and the most in
    another component, give the number of lists that a member of any size needs.
    """

    def needs(table: pa.Table) -> pa.Table:
        column = lambda name, none=0: np.asarray(table.column(name).combine_chunks().fill_null(none))
        order = np.argsort(column("n"), kind="stable")
        n, most, root, other = (x[order] for x in (column("n"), column("most"), column("root_hash"), column("other", -1)))
        never = np.iinfo(np.int64).max
        least, own, own_least = np.full(len(n), never), np.zeros(len(n), np.int64), np.full(len(n), never)
        low, high = np.searchsorted(n, -(-3 * n // 4)), np.searchsorted(n, 4 * n // 3, "right")
        for i in range(0, len(n), ROWS):
            x, y = slice(i, i + ROWS), slice(low[i], high[min(i + ROWS, len(n)) - 1])
            small, large = np.minimum.outer(n[x], n[y]), np.maximum.outer(n[x], n[y])
            need = np.where(4 * small >= 3 * large, _needed(small, large), never)
            any_ = np.where(most[y] >= need, need, never)
            at = np.argmin(any_, axis=1)
            # only the component of the best partner can need more than the others do
            least[x], own[x] = any_[np.arange(len(at)), at], root[y][at]
            own_least[x] = np.where(np.where(root[y] == own[x][:, None], other[y], most[y]) >= need, need, never).min(axis=1)
        return pa.table({"h": table.column("h").take(pa.array(order)), "n": n, "least": least, "own": own, "own_least": own_least})

    count = placed.groupBy("cls", "n").agg(F.count("*").alias("lists"))
    rows = placed.join(count, ["cls", "n"]).select("h", "cls", "n", "root", "lists", F.xxhash64("root").alias("root_hash"))
    per = rows.groupBy("h", "n", "root_hash").agg(F.max("lists").alias("most"))
    rank = F.row_number().over(Window.partitionBy("h", "n").orderBy(F.desc("most"), "root_hash"))
    best = per.withColumn("rank", rank).where("rank <= 2").groupBy("h", "n").agg(
        F.max(F.when(F.col("rank") == 1, F.col("most"))).alias("most"), F.max(F.when(F.col("rank") == 1, F.col("root_hash"))).alias("root_hash"), F.max(F.when(F.col("rank") == 2, F.col("most"))).alias("other"),
    )
    found = _dealt(best, "h").groupBy("h").applyInArrow(needs, "h long, n long, least long, own long, own_least long")
    kept = rows.join(found, ["h", "n"]).where("lists >= if(root_hash = own, own_least, least)")
    return written(kept.select("h", "cls", "n", "root"))


def _paired(placed: DataFrame) -> DataFrame:
    """placed with xb, xs, yb, ys, side: the pairs of blocks of its list that a member is compared in, a row each.

    A list of more than MEMBERS is cut into bands of size and each band into blocks by hash; blocks
    meet within a band and with the next one, as sets of other bands are too different in size. Side
    is 0 or 1 for the two blocks, 2 in a block that meets itself.
    """
    band = F.floor(F.log(F.col("n").cast("double")) / math.log(1.34)).cast("int")  # above log(4/3): rounding skips no band
    of = placed.groupBy("h", band.alias("band")).agg(F.count("*").alias("members"))
    entry = F.struct("band", F.ceil(F.col("members") / MEMBERS).cast("int").alias("blocks"))
    shape = of.groupBy("h").agg((F.sum("members") > MEMBERS).alias("cut"), F.map_from_entries(F.collect_list(entry)).alias("blocks"))
    rows = placed.join(shape, "h").withColumn("band", F.when(F.col("cut"), band).otherwise(0))
    blocks = lambda step: F.when(F.col("cut"), F.coalesce(F.try_element_at("blocks", F.col("band") + step), F.lit(0))).otherwise(1 if step == 0 else 0)
    rows = rows.withColumn("block", F.pmod(F.xxhash64("cls", "n"), blocks(0)).cast("int"))
    mine, at, none = F.col("block"), F.col("band"), F.array().cast("array<int>")
    others = lambda step: F.when(blocks(step) > 0, F.sequence(F.lit(0), blocks(step) - 1)).otherwise(none)
    pair = lambda xb, xs, yb, ys, side: F.struct(xb.alias("xb"), xs.alias("xs"), yb.alias("yb"), ys.alias("ys"), side.cast("int").alias("side"))
    same = F.transform(others(0), lambda j: pair(at, F.least(j, mine), at, F.greatest(j, mine), F.when(j == mine, 2).when(mine < j, 0).otherwise(1)))
    above = F.transform(others(1), lambda j: pair(at, mine, at + 1, j, F.lit(0)))
    below = F.transform(others(-1), lambda j: pair(at - 1, j, at, mine, F.lit(1)))
    met = rows.withColumn("pair", F.explode(F.concat(same, above, below)))
    return met.select(*placed.columns, "pair.*")


def _cross_pairs(placed: DataFrame) -> DataFrame:
    """a, na, b, nb: pairs of different components that share enough long lists. Pairs are counted, not sent.

    Lists whose member of lowest hash is the same make one bundle, as lists of a group of near copies
    do, so that a member is sent once a bundle. Every member brings the lists that it is in, so a task
    of two blocks of a bundle knows each pair's overlap over all lists; a pair is given by the first
    bundle in which it shares a list. Overlaps are summed over COLUMNS lists at a time for BLOCK
    members by BLOCK, so the lists of all members set no bound.
    """

    def compare(table: pa.Table) -> pa.Table:
        table = table.take(pa.array(np.argsort(np.asarray(table.column("side").combine_chunks()), kind="stable")))
        column = lambda name: np.asarray(table.column(name).combine_chunks())
        cls, n, root, side, here = column("cls"), column("n"), column("root"), column("side"), table.column("h")[0].as_py()
        own, turn = side[0] == 2, len(side) if side[0] == 2 else int(np.searchsorted(side, 1))
        lists = table.column("lists").combine_chunks()
        flat, count = lists.flatten(), np.diff(np.asarray(lists.offsets))
        order = np.lexsort((np.asarray(flat.field("list")), np.asarray(flat.field("h"))))
        bundle, of = (np.asarray(flat.field(x))[order] for x in ("h", "list"))
        new = _unlike(bundle, of)
        place = np.empty(len(order), np.int64)
        place[order] = np.cumsum(new) - 1
        known, members = bundle[new], np.diff(np.append(np.flatnonzero(new), len(order)))
        # lists of one member here are shared by none
        shared = members > 1
        inside = shared[place]
        member, place, known = np.repeat(np.arange(len(cls)), count)[inside], (np.cumsum(shared) - 1)[place[inside]], known[shared]
        first, last = int(np.searchsorted(known, here)), int(np.searchsorted(known, here, "right"))
        cuts = sorted({0, first, last, len(known), *range(0, len(known), COLUMNS)})

        def block(x: slice, low: int, high: int) -> np.ndarray:
            a, b = np.searchsorted(member, (x.start, x.stop))
            chosen = np.flatnonzero((place[a:b] >= low) & (place[a:b] < high)) + a
            held = np.zeros((x.stop - x.start, high - low), np.float32)
            held[member[chosen] - x.start, place[chosen] - low] = 1
            return held

        out = []
        for i in range(0, turn if first < last else 0, BLOCK):
            x = slice(i, min(i + BLOCK, turn))
            for j in range(i if own else turn, len(cls), BLOCK):
                y = slice(j, min(j + BLOCK, len(cls)))
                small, large = np.minimum.outer(n[x], n[y]), np.maximum.outer(n[x], n[y])
                ok = (root[x][:, None] != root[y][None, :]) & (4 * small >= 3 * large)
                if not ok.any():
                    continue
                overlap = np.zeros(ok.shape, np.float32)
                for low, high in zip(cuts, cuts[1:], strict=False):
                    if low == first:
                        ok &= overlap == 0
                    overlap += block(x, low, high) @ block(y, low, high).T
                    if high == last:
                        ok &= overlap > 0
                p, q = np.nonzero(ok & (overlap >= _needed(small, large)))
                if own and i == j:
                    p, q = p[keep := p < q], q[keep]
                out.append(np.stack((p + i, q + j)))
        p, q = np.concatenate(out, axis=1) if out else np.zeros((2, 0), np.int64)
        swap = (cls[p] > cls[q]) | ((cls[p] == cls[q]) & (n[p] > n[q]))
        p, q = np.where(swap, q, p), np.where(swap, p, q)
        return pa.table({"a": cls[p], "na": n[p], "b": cls[q], "nb": n[q]})

    bundle = placed.groupBy("h").agg(F.min(F.xxhash64("cls", "n")).alias("bundle"))
    rows = placed.join(bundle, "h").select(F.col("bundle").alias("h"), F.col("h").alias("list"), "cls", "n", "root")
    held = rows.groupBy("cls", "n").agg(F.collect_set(F.struct("h", "list")).alias("lists"))
    rows = _paired(rows.select("h", "cls", "n", "root").distinct()).join(held, ["cls", "n"]).select("h", "xb", "xs", "yb", "ys", "side", "cls", "n", F.xxhash64("root").alias("root"), "lists")
    keys = ["h", "xb", "xs", "yb", "ys"]
    return _dealt(rows, *keys).groupBy(*keys).applyInArrow(compare, "a long, na long, b long, nb long")


def _bounded(pairs: DataFrame, held: DataFrame, summed: DataFrame) -> DataFrame:
    """The pairs whose prefixes share enough: long lists that hold both, and short ones counted before."""
    x = held.select(F.col("cls").alias("a"), F.col("n").alias("na"), F.col("lists").alias("la"))
    y = held.select(F.col("cls").alias("b"), F.col("n").alias("nb"), F.col("lists").alias("lb"))
    short = summed.select("a", "na", "b", "nb", F.col("shared").alias("apart"))
    met = pairs.join(short, ["a", "na", "b", "nb"], "left").join(x, ["a", "na"], "left").join(y, ["b", "nb"], "left")
    both = F.coalesce(F.size(F.array_intersect("la", "lb")), F.lit(0))
    return met.where(both + F.coalesce("apart", F.lit(0)) >= _need()).select("a", "na", "b", "nb")


def _ends(pairs: DataFrame) -> DataFrame:
    return pairs.select(F.col("a").alias("cls"), F.col("na").alias("n")).unionByName(pairs.select(F.col("b").alias("cls"), F.col("nb").alias("n"))).distinct()


def _linked(rows: DataFrame, pairs: DataFrame) -> DataFrame:
    """a, na, b, nb of the pairs that link; texts are read again only if there are any, and give these pairs' sets alone."""
    if not _any(pairs):
        return pairs
    return written(_verified(pairs, _whole_sets(rows, written(_ends(pairs)))))


def _need() -> Column:
    na, nb = F.col("na"), F.col("nb")
    return F.ceil(3 * (na + nb) / 7) - F.greatest(F.ceil(0.75 * na), F.ceil(0.75 * nb)) + 1


def _first_pairs(summed: DataFrame) -> DataFrame:
    """The pairs that share a short list, and each member of long lists with the hub that it meets most often."""
    hub = F.max_by(F.struct("a", "na"), F.struct("hubs", -F.col("a"), -F.col("na")))
    stars = summed.where("shared = 0").groupBy("b", "nb").agg(hub.alias("x")).select("x.a", "x.na", "b", "nb")
    return summed.where("shared > 0").select("a", "na", "b", "nb").unionByName(stars)


def _any(df: DataFrame) -> bool:
    return df.limit(1).count() > 0


def near_duplicates(docs: DataFrame) -> DataFrame:
    """doc_id, row_hash, n_shingles, component_id of every row of docs.

    component_id is the smallest doc_id reachable over links of Jaccard similarity 0.75 or more;
    rows without words are linked with nothing, not even with each other. Equal rows get equal
    results. Null texts count as empty; empty input gives no rows; other columns are not read.
    """
    rows = keyed(docs)
    scanned = written(_classes(rows))
    own = scanned.where("part is null").drop("part", "counts")
    shingles = own.agg(F.sum("n")).first()[0] or 0
    levels = docs.sparkSession.sparkContext.broadcast(_levels(scanned, shingles))
    fragments = max(6, -(-shingles // (4 * FRAGMENT)))
    common = docs.sparkSession.sparkContext.broadcast(_filter(written(_common(rows, levels, fragments))))
    met = written(_meets(_postings(rows, levels, common, fragments)))
    pairs = met.where("b is not null")
    lists = met.where("b is null").select(F.col("shared").alias("h"), F.col("a").alias("cls"), F.col("na").alias("n"))
    summed = written(pairs.groupBy("a", "na", "b", "nb").agg(F.sum(F.greatest("shared", F.lit(0))).alias("shared"), F.count_if(F.col("shared") < 0).alias("hubs")))
    held = written(lists.groupBy("cls", "n").agg(F.collect_set("h").alias("lists")))
    tested = written(_bounded(_first_pairs(summed), held, summed))
    links = _linked(rows, tested)
    found = _components(links)
    # every pair that shares a short list is tested now; what follows looks for links over long lists alone
    for turn in range(TURNS + 1):
        placed = _open_lists(lists, found)
        if not _any(placed) or not _any(placed := _viable(placed)):
            break
        pairs = _hub_pairs(placed, turn) if turn < TURNS else _cross_pairs(placed).distinct()
        pairs = pairs.join(tested, ["a", "na", "b", "nb"], "left_anti")
        pairs = written(_bounded(pairs, held, summed) if turn < TURNS else pairs)
        if not _any(pairs):
            continue
        tested, late = tested.unionByName(pairs), _linked(rows, pairs)
        if _any(late):
            links = links.unionByName(late)
            found = _components(links)
    classes = own.where("n > 0").groupBy("cls", "n").agg(F.min("doc_id").alias("low"))
    placed = classes.join(found, ["cls", "n"], "left")
    placed = placed.withColumn("root", F.coalesce("root", _node("cls", "n")))
    lowest = placed.groupBy("root").agg(F.min("low").alias("component_id"))
    of_class = placed.join(lowest, "root").select("cls", "n", "component_id")
    return own.join(of_class, ["cls", "n"], "left").select("doc_id", "row_hash", F.col("n").alias("n_shingles"), F.coalesce("component_id", "doc_id").alias("component_id"))


def digest(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles, component_id of every row of docs, as near_duplicates has them."""
    with scratch(docs.sparkSession) as put:
        return put(near_duplicates(docs).select("doc_id", "n_shingles", "component_id"))


def _surplus(found: DataFrame) -> DataFrame:
    """doc_id, row_hash, gone, rows of what keep_one has to look at: rows that go, and rows that are there several times."""
    gone = found.groupBy("doc_id", "row_hash").agg(F.max(F.coalesce(F.col("doc_id") != F.col("component_id"), F.lit(False))).alias("gone"), F.count("*").alias("rows"))
    return gone.where("gone or rows > 1")


def keep_one(docs: DataFrame) -> DataFrame:
    """One document of each group, the one of smallest id; columns as given. Of repeated rows one stays.

    Rows without words are all kept. Null texts stay null; empty input gives no rows.
    """
    with scratch(docs.sparkSession) as put:
        gone = put(_surplus(near_duplicates(docs)))
    keyed_docs = docs.withColumn("__id", F.col("doc_id").cast("long")).withColumn("__hash", F.xxhash64("__id", F.coalesce(F.col("text"), F.lit(""))))
    drop = gone.select(F.col("doc_id").alias("__doc"), F.col("row_hash").alias("__row"))
    same = lambda of: (F.col("__hash") == of["__row"]) & F.col("__id").eqNullSafe(of["__doc"])
    kept = keyed_docs.join(drop, same(drop), "left_anti")
    repeated = gone.where("not gone and rows > 1").select(F.col("doc_id").alias("__doc"), F.col("row_hash").alias("__row"))
    if _any(repeated):
        again = keyed_docs.join(repeated, same(repeated), "left_semi").dropDuplicates(["__id", "__hash"])
        kept = kept.unionByName(again)
    return kept.select(*docs.columns)
