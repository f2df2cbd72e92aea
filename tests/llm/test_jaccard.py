"""The Jaccard join's parts: hot buckets, long lists in blocks, members that no other can link with."""

import random
from collections import Counter, defaultdict

import numpy as np
import pytest

from accord.llm import jaccard


def near_copies(count, length=120, seed=6):
    rng = random.Random(seed)
    base = [f"w{k}" for k in range(length)]
    rows = []
    for k in range(count):
        words = list(base)
        for _ in range(rng.randrange(1, 5)):
            words[rng.randrange(length)] = f"n{k}-{rng.random()}"
        rows.append((k, " ".join(words)))
    return rows


def lowest_linked(rows):
    words = [t.split() for _, t in rows]
    sets = [{tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} for w in words]
    low = list(range(len(sets)))
    links = [(a, b) for a in low for b in low if a < b and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b])]
    for _ in sets:
        for a, b in links:
            low[a] = low[b] = min(low[a], low[b])
    return low


def test_hot_buckets_are_cut_by_their_counts(spark, monkeypatch):
    rows, sizes, size, meets = near_copies(100), [], 30, jaccard._meets

    def spied(postings):
        held = Counter()
        for r in postings.collect():
            held[r.fragment] += len(r.hashes) // 6
        sizes.extend(held.values())
        return meets(postings)

    monkeypatch.setattr(jaccard, "FRAGMENT", size)
    monkeypatch.setattr(jaccard, "_meets", spied)
    got = {r.doc_id: r.component_id for r in jaccard.digest(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert [got[k] for k in range(len(rows))] == lowest_linked(rows)
    assert sum(sizes) > 20 * size and max(sizes) <= 4 * size


def test_runs_of_hot_buckets(monkeypatch):
    monkeypatch.setattr(jaccard, "FRAGMENT", 100)
    keys = np.array([3, 4, 5, 6, 7]) << jaccard.BUCKET_BITS | np.array([9, 1, 2, 3, 4])
    keys[1:4] = (3 << jaccard.BUCKET_BITS) + np.array([10, 11, 12])
    starts, parts = jaccard._ranges(keys, np.array([60, 30, 20, 350, 50]))
    assert starts.tolist() == keys[[0, 3, 4]].tolist() and parts.tolist() == [1, 4, 1]


@pytest.fixture(scope="module")
def members(spark):
    rng = random.Random(9)
    rows = []
    for k in range(150):
        n = rng.choice([12, 15, 16, 20, 21, 28, 40])
        rows += [(h, k, n, (k // 20 if k % 3 else k, 1)) for h in {-7, *(rng.randrange(1, 9) for _ in range(rng.randrange(1, 9)))}]
    return rows, spark.createDataFrame(rows, "h long, cls long, n long, root struct<cls:long,n:long>").cache()


def able(x, y, shared):
    (_, n, r), (_, m, s) = x, y
    return r != s and 4 * min(n, m) >= 3 * max(n, m) and shared >= jaccard._needed(min(n, m), max(n, m))


def test_long_lists_are_compared_in_blocks(members, monkeypatch):
    monkeypatch.setattr(jaccard, "MEMBERS", 10)
    rows, placed = members
    lists = defaultdict(set)
    for h, *who in rows:
        lists[tuple(who)].add(h)
    want = {tuple(sorted((x[:2], y[:2]))) for x in lists for y in lists if x[0] < y[0] and lists[x] & lists[y] and able(x, y, len(lists[x] & lists[y]))}
    got = [tuple(sorted(((r.a, r.na), (r.b, r.nb)))) for r in jaccard._cross_pairs(placed).collect()]
    assert len(got) == len(set(got)) and set(got) == want and want
    tasks = Counter((r.h, r.xb, r.xs, r.yb, r.ys) for r in jaccard._paired(placed).collect())
    assert max(tasks.values()) <= 60 and max(Counter(h for h, *_ in rows).values()) == 150


def test_viable_members(members):
    rows, placed = members
    rows = [(h, (k, n, r)) for h, k, n, r in rows]
    count = Counter(who for _, who in rows)
    rows = [(h, x) for h, x in rows if any(g == h and able(x, y, min(count[x], count[y])) for g, y in rows)]
    assert sorted((r.h, (r.cls, r.n, tuple(r.root))) for r in jaccard._viable(placed).collect()) == sorted(rows) and rows


def test_shingles_of_many_prefixes_come_late(spark, monkeypatch):
    from pyspark.sql import functions as F

    rng = random.Random(11)
    passage = " ".join(f"p{k}" for k in range(40))
    rows = [(k, " ".join([*(f"u{k}x{j}" for j in range(rng.randrange(20, 80))), passage, *(f"v{k}x{j}" for j in range(20))])) for k in range(40)]
    rows += [(40 + k, t) for k, t in near_copies(30, 60, seed=4)] + [(70, ""), (71, None), (72, rows[0][1])]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    seen = []
    plain = jaccard._common
    monkeypatch.setattr(jaccard, "_common", lambda *a: seen.append(plain(*a)) or seen[-1])
    got = {r.doc_id: r.component_id for r in jaccard.digest(docs).collect()}
    want = lowest_linked([(k, t or f"none{k}") for k, t in rows])  # rows without words link with nothing
    assert [got[k] for k in range(73)] == want and want[72] == 0
    common = {r.h for r in seen[0].collect()}
    counts = Counter(int(x) >> 16 for _, own in jaccard.shingle_sets(docs.select(F.coalesce("text", F.lit(""))).toArrow().column(0).combine_chunks(), 5) for x in own)
    assert common and all(counts[h] > jaccard.LONG for h in common)
    assert [r for r in plain(jaccard.keyed(docs.limit(0)), spark.sparkContext.broadcast((np.zeros(1 << jaccard.BUCKET_BITS, np.uint8),)), 6).collect()] == []
