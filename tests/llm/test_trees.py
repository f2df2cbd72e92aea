"""Manifest, trie and factorisation machine against plain Python, with nulls, ties, repeats, extra columns and empty tables."""

import hashlib
import random
import zlib
from collections import Counter, defaultdict
from itertools import product

import numpy as np
import pyarrow as pa
import pytest

from accord.llm import common, factors, manifest, trie

DOCS = "doc_id long, text string, lang string, source string, n_chars long, pos long, key string, root string, n long"
TURNS = "conv_id long, turn long, role string, text string, depth long, pos long, n string"


def h(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def item(value):
    return "-" if value is None else f"{len(str(value).encode())}:{value}"


def tree(digests):
    """The root over digests and each one's path: (left, right) siblings by level."""
    paths, own = [[] for _ in digests], [[i] for i in range(len(digests))]
    while len(digests) > 1:
        runs = range(0, len(digests), 3)
        for a in runs:
            run = digests[a : a + 3]
            for k in range(len(run)):
                for i in own[a + k]:
                    paths[i].append((run[:k], run[k + 1 :]))
        digests, own = [h(*digests[a : a + 3]) for a in runs], [sum(own[a : a + 3], []) for a in runs]
    return digests[0], paths


def manifest_rows(rows):
    leaf = lambda r, text: h(*map(item, (r[0], r[3], r[2], r[4], text)))
    by = defaultdict(list)
    for r in rows:
        by[r[3]].append((r[0] is not None, r[0] or 0, leaf(r, r[1]), r))
    order, out = sorted(by, key=lambda s: (s is not None, (s or "").encode())), Counter()
    subs = {s: tree([x[2] for x in sorted(by[s], key=lambda x: x[:3])]) for s in order}
    root, over = tree([subs[s][0] for s in order]) if order else (None, [])
    for s, top in zip(order, over, strict=True):
        for (_, _, digest, r), path in zip(sorted(by[s], key=lambda x: x[:3]), subs[s][1], strict=True):
            whole = path + top
            even = r[0] is not None and zlib.crc32(str(r[0]).encode()) % 2 == 0
            at = leaf(r, r[1].replace("\n", "") if even and r[1] is not None else r[1])
            for left, right in whole:
                at = h(*left, at, *right)
            out[r[0], digest, subs[s][0], root, h(*(x for pair in whole for side in pair for x in side)), at, at == root] += 1
    return out


def given_documents(count, sources, seed=1):
    rng = random.Random(seed)
    rows = [(k, rng.choice(["a\nb", "plain", "é\n\n日本", "", None]), rng.choice(["en", None]), rng.choice(sources), rng.choice([3, None]), 7, "x", "y", 9) for k in range(count)]
    return [*rows, rows[3], rows[3], (None, "no id\n", "en", sources[0], 1, 7, "x", "y", 9), (-5, "x\n" * 50_000, "en", sources[0], 1, 7, "x", "y", 9)]


@pytest.mark.parametrize(("levels", "count"), [(5, 40), (5, 700), (1, 60), (2, 90)])
def test_manifest(spark, monkeypatch, levels, count):
    monkeypatch.setattr(manifest, "LEVELS", levels)
    monkeypatch.setattr(manifest, "BLOCK", 3**levels)
    rows = given_documents(count, ["hot", "hot", "hot", None, "", "é", "z", "lone"])
    rows.append((10_000, "one", None, "only", 1, 7, "x", "y", 9))
    got = manifest.digest(spark.createDataFrame(rows, DOCS)).collect()
    assert Counter(map(tuple, got)) == manifest_rows(rows)
    assert {r.verified for r in got} == {True, False}


def test_manifest_of_one_and_of_nothing(spark):
    assert manifest.digest(spark.createDataFrame([], DOCS)).count() == 0
    (one,) = manifest.digest(spark.createDataFrame([(1, "t", "en", None, 1, 7, "x", "y", 9)], DOCS)).collect()
    assert one.leaf == one.subroot == one.root == one.folded_root and one.proof_sha256 == h() and one.verified


def test_numbered_runs_over_many_tasks(spark):
    rows = [(k % 2 and "a" or "b", k // 5, k * k % 97) for k in range(300)]
    got = common.numbered(spark.createDataFrame(rows, "key string, at long, x long").repartition(7), "key", ["at", "x"], {"sums": ("sum", "x"), "bits": ("bit_xor", "x")}).collect()
    for key in "ab":
        own = sorted((r for r in got if r.key == key), key=lambda r: r.pos)
        assert [(r.at, r.x) for r in own] == sorted((at, x) for k, at, x in rows if k == key) and {r.n for r in own} == {150} and [r.pos for r in own] == list(range(150))
        total, bits = 0, 0
        for r in own:
            total, bits = total + r.x, bits ^ r.x
            assert (r.sums, r.bits) == (total, bits)


def trie_rows(rows):
    held = defaultdict(list)
    for c, turn, role, text, *_ in rows:
        if c is not None:
            role, text = role or "", text or ""
            held[c].append((turn is not None, turn or 0, h(str(len(role.encode())), ":", role, text)[:32], (role, text)))
    turns = {c: [x[3] for x in sorted(v)] for c, v in held.items()}
    base = lambda c: turns.get(c - int(np.fmod(c, 100)), [])
    given = lambda c: zlib.crc32(str(c).encode()) % 6
    whole = {c: base(c)[: given(c)] + t[given(c) :] for c, t in turns.items()}
    members = defaultdict(list)
    for c, t in whole.items():
        for d in range(len(t) + 1):
            members[tuple(t[:d])].append(c)
    children = Counter(p[:-1] for p in members if p)
    leaves, saved = Counter(), Counter()
    for p, m in members.items():
        for d in range(len(p) + 1):
            leaves[p[:d]] += not children[p]
            saved[p[:d]] += (len(m) - 1) * len(p[-1][1]) if p else 0
    ends = lambda p, m: h(",".join(map(str, sorted(c for c in m if len(whole[c]) == len(p)))))
    return Counter((min(m), len(p), min(members[p[:-1]]) if p else None, len(m), children[p], leaves[p], saved[p], ends(p, m)) for p, m in members.items())


def given_turns():
    rng, rows = random.Random(4), []
    for c in [*range(60), 100, 107, 230, 231, 400, -3]:
        for t in range(rng.choice([1, 2, 3, 4, 5, 8, 9, 13])):
            rows.append((c, t, rng.choice(["user", "assistant", None]), f"turn {t} " + "é" * rng.choice([0, 1, 1]), 1, 2, "n"))
    for c in range(500, 540):  # copies, long and of a common beginning
        rows += [(c, t, "user", f"same {t}" if t < 40 or c % 4 else f"own {c}", 1, 2, "n") for t in range(43)]
    rows += [(3, None, "user", "first of all", 1, 2, "n"), (3, None, "user", None, 1, 2, "n"), (None, 1, "user", "of none", 1, 2, "n"), rows[5], rows[5], (7, 2, "a", "b", 1, 2, "n"), (7, 2, "ab", "", 1, 2, "n")]
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize(("turns", "chunk"), [(4, 4096), (1, 10), (3, 1), (64, 4096)])
def test_trie(spark, monkeypatch, turns, chunk):
    monkeypatch.setattr(trie, "TURNS", turns)
    monkeypatch.setattr(trie, "CHUNK", chunk)
    rows = given_turns()
    got = trie.digest(spark.createDataFrame(rows, TURNS))
    assert Counter(map(tuple, got.collect())) == trie_rows(rows)


def test_trie_of_little(spark):
    assert trie.digest(spark.createDataFrame([], TURNS)).count() == 0
    for rows in ([(1, 0, "u", "t", 1, 2, "n")], [(c, 0, None, None, 1, 2, "n") for c in range(9)]):
        assert Counter(map(tuple, trie.digest(spark.createDataFrame(rows, TURNS)).collect())) == trie_rows(rows)


def test_square_identity_equals_all_pairs():
    rng = np.random.default_rng(1)
    model = factors.Model(rng.normal(size=factors.WIDTH), rng.normal(size=(factors.WIDTH, factors.RANK)), 0.5)
    rows = list(factors.features(pa.array(["three words here", "", "zwölf 日本\n! 12"]), pa.array([16, None, 3], pa.int64())))
    for row, got in zip(rows, model.logits(rows), strict=True):
        words = max(1, len(row) - len(factors.STATISTICS))
        x = np.where(row < factors.WORDS, 1 / np.sqrt(words), 1.0)
        pairs = sum(model.vectors[i] @ model.vectors[j] * a * b for (k, (i, a)), (m, (j, b)) in product(enumerate(zip(row, x, strict=True)), repeat=2) if k < m)
        assert abs(got - (0.5 + model.weights[row] @ x + pairs)) < 1e-6


def test_factors_learn_an_interaction():
    """Two marks that only together tell: no linear model can, their product does."""
    rng = random.Random(2)
    rows, labels = [], []
    for _ in range(1500):
        a, b = rng.random() < 0.5, rng.random() < 0.5
        rows.append(" ".join([rng.choice(["left", "leaf"][a : a + 1]), rng.choice(["right", "root"][b : b + 1]), *(f"w{rng.randrange(50)}" for _ in range(4))]))
        labels.append(float(a == b))
    found = list(factors.features(pa.array(rows), pa.array([None] * len(rows), pa.int64())))
    model = factors.fit(found[:1200], np.array(labels[:1200]), epochs=40)
    right = (model.score(found[1200:]) > 0.5) == (np.array(labels[1200:]) > 0.5)
    assert right.mean() > 0.95


def test_quality_on_held_out_rows(spark):
    rng = random.Random(3)
    good = lambda: " ".join(rng.choice(["river", "stone", "over", "walks", "Été", "long"]) + rng.choice(["", ".", ","]) for _ in range(80))
    junk = lambda: " ".join(rng.choice(["$$", "###", "BUY", "1234", "now!!"]) for _ in range(60))
    rows = [(k, junk() if k % 5 == 1 else good(), "en", f"s{k}", 10, 1, "k", "r", 2) for k in range(600)]
    rows += [(1000, None, "en", None, None, 1, "k", "r", 2), (1001, "", "en", None, None, 1, "k", "r", 2), (1002, "long " * 200_000, "en", None, 1, 1, "k", "r", 2), rows[0], (None, rows[0][1], "de", "other", 10, 1, "k", "r", 2)]
    docs = spark.createDataFrame(rows, DOCS)
    labels = spark.createDataFrame([*((k, int(k % 5 != 1)) for k in range(600)), (3, None), (None, 1), (5, 1)], "doc_id long, quality int")
    got = factors.digest(docs, labels).collect()
    assert Counter(r.doc_id for r in got) == Counter(r[0] for r in rows)
    assert all(r.held_out == (r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 5 == 0) and r.predicted == int(r.score >= 0.3) and 0 <= r.score <= 1 for r in got)
    held = [r for r in got if r.held_out and r.doc_id < 600]
    assert len(held) > 60 and all(r.predicted == int(r.doc_id % 5 != 1) for r in held)
    assert len({r.score for r in got if r.doc_id in (0, None)}) == 1 and len({r.score for r in got if r.doc_id in (1000, 1001)}) == 1
    # labels of held-out rows play no part, and a reader of `sample` rows reads no more
    turned = spark.createDataFrame([(k, int(k % 5 != 1) if zlib.crc32(str(k).encode()) % 5 else 0) for k in range(600)], "doc_id long, quality int")
    assert sorted((r.score, str(r.doc_id)) for r in factors.digest(docs.where("doc_id < 600"), turned).collect()) == sorted((r.score, str(r.doc_id)) for r in got if r.doc_id is not None and r.doc_id < 600)
    assert factors.learn(docs, labels, sample=10).bias != factors.learn(docs, labels).bias


def test_quality_without_labels_or_rows(spark):
    docs, none = spark.createDataFrame([(1, "t", "en", "s", 1, 1, "k", "r", 2)], DOCS), spark.createDataFrame([], "doc_id long, quality int")
    assert [r.score for r in factors.digest(docs, none).collect()] == [0.5]
    assert factors.digest(docs.limit(0), none).count() == 0
