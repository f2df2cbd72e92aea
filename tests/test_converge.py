"""Runs over several mappings, and entities linked one after another, on hand-written records."""

from accord.operators import converge, identity

STATE = "endpoint string, id string, data string, last_modified timestamp"
BASE = "mapping_id string, id string, source_hash string, target_hash string, data string"


def run(spark, state, baselines, mappings, **more):
    m = spark.createDataFrame([(*x, True) if len(x) == 3 else x for x in mappings], "mapping_id string, source string, target string, enabled boolean")
    after, agreed, results = converge.converge(state, baselines, m, **more)
    return after, agreed, sorted(tuple(r) for r in results.collect())


def held(state):
    return sorted((r.endpoint, r.id, r.data) for r in state.collect())


def test_a_chain_in_hostile_order_converges_in_one_run(spark):
    state, none = spark.createDataFrame([("A", "new", "x", None)], STATE), spark.createDataFrame([], BASE)
    chain = [("m1", "B", "C"), ("m2", "A", "B")]
    after, agreed, results = run(spark, state, none, chain)
    assert held(after) == [(e, "new", "x") for e in "ABC"]
    assert results == [(1, "m2", "target", 1, 0, 0, 0), (2, "m1", "target", 1, 0, 0, 0)]
    again, _, quiet = run(spark, after, agreed, chain)
    assert held(again) == held(after) and quiet == []


def test_passes_are_bounded_and_the_next_run_goes_on(spark):
    state, none = spark.createDataFrame([("0", "r", "x", None)], STATE), spark.createDataFrame([], BASE)
    chain = [(f"m{k}", str(k), str(k + 1)) for k in range(5)]
    after, agreed, results = run(spark, state, none, chain)
    assert {e for e, *_ in held(after)} == {"0", "1", "2", "3"} and max(r[0] for r in results) == 3
    done, _, _ = run(spark, after, agreed, chain)
    assert {e for e, *_ in held(done)} == {str(k) for k in range(6)}


def test_edits_deletes_and_conflicts_travel(spark):
    none = spark.createDataFrame([], BASE)
    chain = [("m1", "A", "B"), ("m2", "B", "C")]
    first = spark.createDataFrame([("A", k, k, None) for k in "abcd"] + [("B", "b", "other", None), ("C", "e", "e", None)], STATE)
    after, agreed, results = run(spark, first, none, chain)
    assert held(after) == [(x, k, k) for x in "ABC" for k in "abcde"] and (1, "m1", "target", 3, 1, 0, 1) in results
    edited = spark.createDataFrame([r for r in [tuple(r) for r in after.collect()] if r[:2] not in (("A", "a"), ("C", "c"))], STATE)
    edited = edited.where("not (endpoint = 'A' and id = 'd')").unionByName(spark.createDataFrame([("A", "d", "D", None)], STATE))
    last, agreed, _ = run(spark, edited, agreed, chain)
    assert held(last) == [(x, k, "D" if k == "d" else k) for x in "ABC" for k in "bde"]
    assert run(spark, last, agreed, chain)[2] == []


def test_disabled_mappings_and_open_conflicts(spark):
    none = spark.createDataFrame([], BASE)
    state = spark.createDataFrame([("A", "r", "x", None), ("B", "r", "y", None)], STATE)
    after, _, results = run(spark, state, none, [("m1", "A", "B"), ("m2", "B", "C", False)], policy="ask")
    assert held(after) == [("A", "r", "x"), ("B", "r", "y")] and results == [(1, "m1", "open", 0, 0, 0, 1)]
    assert run(spark, state.limit(0), none, [("m1", "A", "B")])[2] == []


LINKS, INDEX = "domain string, record string, entity string, name string", "email string, entity string"
ARRIVALS = "seq long, domain string, record string, emails array<string>, name string"


def by_hand(arrivals, links, index):
    """The rule as it is told, one arrival after another; new entities are numbered by their arrival."""
    links, index, out = {(d, r): (e, n) for d, r, e, n in links}, dict(index), {}
    for seq, domain, record, emails, name in sorted(arrivals):
        if not domain or not record:
            continue
        own = sorted({e for e in emails or [] if e})
        old, old_name = links.get((domain, record), (None, None))
        entity = next((index[e.lower()] for e in own if e.lower() in index), old) or f"new{seq}"
        links[domain, record] = (entity, name or old_name)
        index.update({e.lower(): entity for e in own})
        out[seq] = entity
    return out, links, index


def test_arrivals_are_linked_in_order_over_two_runs(spark):
    first = [
        (1, "contacts", "c111", ["alice@example.com"], "Alice"), (2, "calendar", "e1", [], None), (3, "contacts", "c222", ["carol@example.com", "ALICE@example.com"], "Carol"), (4, "contacts", "d1", ["dave@example.com"], ""),
        (5, "contacts", "e1", ["erin@example.com"], "Erin"), (6, "contacts", "c111", ["alice@example.com"], ""), (7, "", "x", ["y@x"], "n"), (8, "contacts", None, ["y@x"], "n"), (9, "contacts", "lone", None, "n"),
        (10, "contacts", "bridge", ["erin@example.com", "dave@example.com", "", None], "B"), (11, "contacts", "late", ["erin@example.com"], "L"),
    ]
    second = [(1, "contacts", "c111", ["new@example.com"], ""), (2, "contacts", "e1", ["erin@example.com"], None), (3, "contacts", "c333", ["NEW@example.com"], "Three"), (4, "contacts", "lone", ["lone@x"], None), (5, "contacts", "d1", [], "Dave")]
    links, index = spark.createDataFrame([], LINKS), spark.createDataFrame([], INDEX)
    want_links, want_index = [], {}
    names = {}
    for run_, rows in (("one", first), ("two", second)):
        out, links, index = identity.link_arrivals(spark.createDataFrame(rows, ARRIVALS), links, index, run_)
        got = {r.seq: r.entity for r in out.collect()}
        want, held_links, want_index = by_hand(rows, want_links, want_index)
        # new entities are told by a digest: each stands for one by hand, and no two for the same
        names |= {want[s]: got[s] for s in sorted(got) if want[s].startswith("new") and want[s] not in names}
        rename = lambda e: names.get(e, e)
        assert got == {s: rename(e) for s, e in want.items()} and len(set(names.values())) == len(names)
        assert {(r.domain, r.record): (r.entity, r.name) for r in links.collect()} == {k: (rename(e), n) for k, (e, n) in held_links.items()}
        assert {r.email: r.entity for r in index.collect()} == {k: rename(e) for k, e in want_index.items()}
        want_links, want_index, names = [(*k, rename(e), n) for k, (e, n) in held_links.items()], {k: rename(e) for k, e in want_index.items()}, {}
    out, again, same = identity.link_arrivals(spark.createDataFrame(second, ARRIVALS), links, index, "three")
    assert {tuple(r) for r in again.collect()} == {tuple(r) for r in links.collect()} and {tuple(r) for r in same.collect()} == {tuple(r) for r in index.collect()}
