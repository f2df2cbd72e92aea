"""Operators on the cases that the derived collections can't show, and inputs that are held whole."""

import hashlib
import os
from collections import defaultdict

import pytest

from accord.operators import identity, logs, reconcile
from accord.sources import derived

DIR = "/root/testdata/sf0.001"


@pytest.mark.skipif(not os.path.isdir(DIR), reason="needs the given tables")
def test_canon_bodies_are_whole(spark):
    texts = {r.doc_id: r.text for r in derived.table(spark, DIR, "documents").collect()}
    _, _, baseline = derived.canon(spark, DIR)
    assert {r.uid: r.body for r in baseline.collect()} == texts and max(len(t) for t in texts.values() if t) > 200


def test_bucketed_digest(spark):
    rows = [(m, k, f"h{k % 7}") for m in "ab" for k in range(500)]
    sha = lambda text: hashlib.sha256(text.encode()).hexdigest()
    leaves = defaultdict(list)
    for _, k, h in rows[:500]:
        leaves[sha(str(k))[:4]].append((str(k), h))
    over = lambda pairs: sha("".join(f"{a}\x1f{b}\x1e" for a, b in sorted(pairs)))
    digests = lambda given: {r.mapping_id: r.digest for r in reconcile.bucketed_digest(spark.createDataFrame(given, "mapping_id string, id long, hash string")).collect()}
    got = digests(rows[::-1])
    assert got == dict.fromkeys("ab", over((b, over(of)) for b, of in leaves.items()))
    assert digests([*rows[:-1], ("b", 499, "other")])["b"] != got["b"]


def test_writers_merge_by_property(spark):
    entries = [
        ("both", "app2", 2, {"title": "new", "place": "old", "SEQUENCE": "2"}), ("both", "app1", 1, {"title": "old", "place": "there", "SEQUENCE": "1"}),
        ("clash", "app1", 1, {"title": "x", "place": "old"}), ("clash", "app2", 2, {"title": "y"}), ("gone", "app1", 1, None),
        ("one", "app1", 1, {"title": "z"}), ("new", "app1", 1, {"title": "a"}), ("new", "app2", 2, {"title": "b"}), ("stale", "app1", 0, {"title": "x"}), ("stale", "app1", 1, None), ("stale", "app2", 1, {"title": "old", "place": "old"}),
    ]
    log = [(u, a, f"2024-01-0{t + 1}", t, k, v) for u, a, t, p in entries for k, v in (p or {None: None}).items()]
    base = [(u, k, "old") for u in ("both", "clash", "gone", "one", "stale") for k in ("title", "place")]
    got = logs.merge_properties(spark.createDataFrame(log, "uid string, app_id string, datetime string, seq int, property string, value string"), spark.createDataFrame(base, "uid string, property string, value string"))
    assert {tuple(r) for r in got.collect()} == {
        ("both", "merged", "title", "new"), ("both", "merged", "place", "there"), ("both", "merged", "SEQUENCE", "2"), ("clash", "conflict", "title", "y"), ("gone", "deletion", None, None),
        ("one", "unchanged", "title", "z"), ("new", "unchanged", "title", "b"), ("stale", "unchanged", "title", "old"), ("stale", "unchanged", "place", "old"),
    }


def test_canon_merge_without_baseline(spark):
    make = lambda rows, columns: spark.createDataFrame(rows, columns)
    columns = "uid int, body string, category string, extras string, kind string"
    source = make([(1, "s", None, "es", "todo"), (2, "b", "c", "es", ""), (3, "s", "c", "es", "event")], columns)
    target = make([(1, "t", None, "et", "event"), (2, "b", "d", "et", "event"), (3, "b", "d", "et", None)], columns)
    baseline = make([(2, "b", "c"), (3, "b", "c")], "uid int, body string, category string")
    merged = lambda strategy: {tuple(r) for r in identity.canon_merge(source, target, baseline, ["body", "category"], strategy).collect()}
    same = {(2, "", "category", "b", "d", "et", "event", False), (3, "body", "category", "s", "d", "es", "event", False)}
    assert merged("source") == same | {(1, "body", "body", "s", None, "es", "event", True)}
    assert merged("target") == same | {(1, "body", "body", "t", None, "et", "event", True)}


def test_event_roster_takes_lists_and_names(spark):
    people = spark.createDataFrame([(1, 0, "Ann@x"), (1, 1, ""), (1, 2, "ann@X"), (1, 3, "who@x"), (1, 4, "bob@x")], "event int, position int, email string")
    edges = spark.createDataFrame([(7, "ann@x"), (8, "ann@x"), (9, "Bob@x")], "record int, email string")
    names = spark.createDataFrame([("b", 7, "Late"), ("a", 8, "Ann"), ("a", 7, "")], "domain string, record int, name string")
    got = identity.event_roster(people, edges, identity.link_entities(edges), names)
    assert sorted(tuple(r) for r in got.collect()) == [(1, 0, "Ann@x", 7, "Ann"), (1, 1, "who@x", None, None), (1, 2, "bob@x", 9, None)]
