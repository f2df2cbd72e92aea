"""The operators against brute force on small inputs, with nulls, empty and long texts, ties, repeats and extra columns."""

import hashlib
import math
import random
import re
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
import tiktoken

from accord.llm import bpe, jaccard, knn, mixing, pii, quality, repeats, shards, tokens, toxicity
from accord.llm.queries import VOCABULARY

PATH, PATTERN = public_tokenizers.path(VOCABULARY), public_tokenizers.PATTERN
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, n_tokens long, spans string"
WORDS = re.compile(r"[^\x20\x09-\x0D]+")


def texts():
    rng = random.Random(5)
    words = ["the", "and", "naïve", "12", "x@y.org", "Été", "loser", "a-b", "4111111111111111", "+1 555 123 4567", "10.0.0.1", "日本"]
    base = [" ".join(rng.choice(words) + rng.choice(["", ".", ",", "\n"]) for _ in range(rng.randrange(1, 160))) for _ in range(14)]
    near = [t + " tail" for t in base[:4]]
    return [None, "", " \n", "a", "a", *base, *near, base[0], "ab" * 600, "z" * 401, "w " * 3000]


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(k, t, "en", f"s{k % 3}" if k % 7 else None, 0, 9, "x") for k, t in enumerate(texts())]
    return spark.createDataFrame([*rows, rows[8]], SCHEMA)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def held(docs):
    return [(r.doc_id, r.text or "") for r in docs.select("doc_id", "text").collect()]


def test_bpe_equals_tiktoken_and_round_trips(docs, empty):
    library = tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=bpe.load_ranks(PATH), special_tokens={})
    got = sorted((r.doc_id, r.n_tokens, bytes(r.ids), bytes(r.decoded)) for r in bpe.encode_documents(docs, PATH, PATTERN, decode=True).collect())
    want = sorted((k, len(i := library.encode_ordinary(t)), np.array(i, "<u4").tobytes(), t.encode()) for k, t in held(docs))
    assert got == want
    assert bpe.encode_documents(empty, PATH, PATTERN).count() == 0


def test_bpe_appends_and_edits():
    encoder, split, _ = bpe.tools(PATH, PATTERN)
    rng = random.Random(2)
    whole = "It's the naïve  re'l\n\n  word" * 3
    for _ in range(20):
        cut = rng.randrange(len(whole))
        text = bpe.Text(encoder, split, whole[:cut])
        text.append(whole[cut:])
        assert text.ids() == [i for p in split(whole) for i in encoder.encode(p.encode())]
        data = bytes(rng.choice(b"abctheing") for _ in range(120))
        last = encoder.extend(data, [])
        new, fresh, redone = encoder.replace(data, last, 30, 33, b"ing")
        assert fresh == encoder.extend(new, []) and redone <= len(new)


def test_section_tokens(docs, empty):
    library = tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=bpe.load_ranks(PATH), special_tokens={})
    for rule in tokens.RULES:
        want = Counter()
        for k, text in held(docs):
            bounds, at, owner = [], 0, []
            for s, line in enumerate(re.findall("[^\n]*\n|[^\n]+", text)):
                bounds.append((at, at + len(line)))
                at += len(line)
                owner += [s] * len(line.encode())
            count, crossing, byte = Counter(), Counter(), 0
            for token in map(library.decode_single_token_bytes, library.encode_ordinary(text)):
                held_by = Counter(owner[byte : byte + len(token)])
                byte += len(token)
                s = {"first": min(held_by), "last": max(held_by), "largest": min(held_by, key=lambda s: (-held_by[s], s))}[rule]
                count[s] += 1
                crossing[s] += len(held_by) > 1
            want.update((k, s, a, b, count[s], crossing[s]) for s, (a, b) in enumerate(bounds))
        got = tokens.section_tokens(docs, PATH, PATTERN, rule).collect()
        assert Counter((r.doc_id, r.section, r.char_start, r.char_end, r.n_tokens, r.n_crossing) for r in got) == want
    assert tokens.section_tokens(empty, PATH, PATTERN).count() == 0
    ends, bounds = np.array([3, 7, 9]), np.array([0, 4, 6])
    assert tokens.allocate(ends, bounds, "first")[0].tolist() == [0, 0, 2]
    assert tokens.allocate(ends, bounds, "last")[0].tolist() == [0, 2, 2]
    assert tokens.allocate(ends, bounds, "largest")[0].tolist() == [0, 1, 2]


def test_statistics(docs, empty):
    for r in quality.text_statistics(docs).collect():
        text = dict(held(docs))[r.doc_id]
        words, at = WORDS.findall(text), defaultdict(list)
        for i in range(len(words) - 2):
            at[tuple(words[i : i + 3])].append(i)
        covered = {j for v in at.values() if len(v) > 1 for i in v for j in (i, i + 1, i + 2)}
        lines = [x for x in text.split("\n") if WORDS.search(x)]
        assert (r.n_words, r.word_chars, r.n_repeat_words, r.n_dup_lines) == (len(words), sum(map(len, words)), len(covered), len(lines) - len(set(lines)))
    assert quality.text_statistics(empty).count() == 0


def test_rules_are_learned(spark, empty):
    rng = random.Random(3)
    rows = [(k, " ".join(("JUNK!" if k % 3 == 0 else "word") + str(rng.randrange(999)) for _ in range(60))) for k in range(300)]
    docs, labels = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame([(k, int(k % 3 > 0)) for k in range(300)], "doc_id long, quality int")
    kept = {r.doc_id for r in quality.judge(docs, labels).where("kept").collect()}
    assert kept == {k for k in range(300) if k % 3}
    none = labels.limit(0)
    assert quality.keep_good(docs, none).count() == 300
    assert quality.judge(empty, none).count() == 0


def test_personal_data(docs, empty):
    for r in pii.digest(docs).collect():
        text = dict(held(docs))[r.doc_id]
        assert r.n_email == len(re.findall(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+", text))
    assert pii.digest(empty).count() == 0
    out = pii.redact_documents(docs)
    assert out.columns == docs.columns and out.count() == docs.count() and out.where("text like '%x@y.org%'").count() == 0


def test_disclosing_terms(spark):
    rows = [(k, f"report {k} mentions zanzibar and boss@corp.com near note{k}") for k in range(3)] + [(k, f"report {k} mentions and near nothing at all") for k in range(3, 200)]
    got = pii.digest(spark.createDataFrame(rows, "doc_id long, text string")).where("n_terms > 0").collect()
    assert {r.doc_id for r in got} == {0, 1, 2} and all("removed" in r.spans for r in got)


def disclosed(rows):
    """spans of terms by row, from the formula, counted by hand over every pair of term and entity."""
    spans = lambda t: [(m.start(), m.end(), "email:" + m.group().lower()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+", t)]
    words = lambda t: [m for m in re.finditer(r"[^\W_]+(?:['-][^\W_]+)*", t) if len(m.group()) > 2]
    entities, terms = [{e for *_, e in spans(t)} for t in rows], [{m.group().lower() for m in words(t)} for t in rows]
    n_e, n_t, both, n = Counter(e for x in entities for e in x), Counter(t for x in terms for t in x), Counter(), len(rows)
    for es, ts in zip(entities, terms, strict=True):
        both.update((e, t) for e in es for t in ts)
    out = []
    for text, es in zip(rows, entities, strict=True):
        best, got = {}, []
        for e in es:
            for t in {m.group().lower() for m in words(text)}:
                k = both[e, t]
                d = np.log2(n * k / (n_e[e] * n_t[t])) / np.log2(n / n_e[e]) * k / (k + 0.5) if n_e[e] < n else 0
                best[t] = max(best.get(t, 0), d)
        for m in words(text):
            d = best.get(m.group().lower(), 0)
            if d >= 0.6 - 1e-12 and not any(a < m.end() and m.start() < b for a, b, _ in spans(text)):
                got.append(("removed" if d >= 0.8 - 1e-12 else "generalised", m.start(), m.end()))
        out.append(sorted(got))
    return out


def test_disclosure_equals_brute_force(spark):
    rng = random.Random(8)
    rows = []
    for _ in range(240):
        words = [rng.choice(["the", "river", "of", "été"]) if rng.random() < 0.6 else f"w{rng.randrange(500)}" for _ in range(rng.randrange(2, 60))]
        for _ in range(rng.choice([0, 0, 1, 3])):
            k = int(rng.expovariate(0.2))
            words[rng.randrange(len(words)) :] = [f"user{k}@corp.com", f"Nick-{k}", rng.choice(["The", "w7"])]
        rows.append(" ".join(words))
    rows += [rows[0], "", "all@corp.com", " ".join(f"t{k} a{k}@b.org" for k in range(300))]
    got = {r.doc_id: [tuple((x.split(":")[0], *map(int, x.split(":")[1:]))) for x in r.spans.split(",") if x[:7] in ("removed", "general")] for r in pii.digest(spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string")).collect()}
    want = disclosed(rows)
    assert [got[k] for k in range(len(rows))] == want and {k for x in want for k, *_ in x} == {"removed", "generalised"}


def test_long_texts_place_their_matches(spark):
    text = " ".join(f"word{k % 977} é{k}@x.org" if k % 5 == 0 else f"word{k % 977}" for k in range(20_000))
    (r,) = pii.digest(spark.createDataFrame([(1, text)], "doc_id long, text string")).collect()
    want = [f"email:{m.start()}:{m.end()}" for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text)]
    assert r.n_email == 4000 and r.base_sha256 == hashlib.sha256(",".join(want).encode()).hexdigest()


def test_top_k_is_exact(spark):
    rng = np.random.default_rng(1)
    x = rng.normal(0, 0.2, (400, 16)).astype(np.float32)
    x[50:60] = x[0]
    rows = [(k, v.tolist()) for k, v in enumerate(x)] + [(1000, None), (1001, [None] * 16), (1002, [float("nan")] * 16)]
    vectors = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    got = sorted((r.query_id, r["rank"], r.vec_id, r.score) for r in knn.top_k(vectors, vectors.where("vec_id % 50 = 0")).collect())
    v, want = np.floor(256 * x.astype(float)).astype(int), []
    for q in range(0, 400, 50):
        best = sorted((-int(v[q] @ v[i]), i) for i in range(400) if i != q)[:5]
        want += [(q, k + 1, i, -s) for k, (s, i) in enumerate(best)]
    assert got == sorted(want)
    assert knn.top_k(vectors.limit(0), vectors.limit(0)).count() == 0


def test_top_k_deals_chunks_over_tasks_in_rounds(spark, monkeypatch):
    """Equal vectors, repeated ids, lengths and magnitudes mixed; chunks of vectors have tasks of their own."""
    monkeypatch.setattr(knn, "BLOCK", 16)
    rng = np.random.default_rng(9)
    unit = lambda n, dims: (lambda v: v / np.linalg.norm(v, axis=1)[:, None])(rng.normal(size=(n, dims))).tolist()
    rows = list(enumerate(unit(1000, 16) + unit(150, 8)))
    rows += [(2000 + k, rows[50][1]) for k in range(300)] + [(3000 + k, [0.0] * 16) for k in range(60)]
    rows += [(4000 + k, (np.array(v) * 10.0 ** (k % 7)).tolist()) for k, v in enumerate(unit(100, 16))]
    rows += [(50, rows[50][1]), (50, rows[51][1]), (7, rows[100][1]), (7, rows[100][1]), (100, [0.5] * 8), (5000, []), (5050, [1.0, None])]
    vectors = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    spark.sparkContext.setJobGroup("rounds", "top_k")
    try:
        got = sorted((r.query_id, r["rank"], r.vec_id, r.score) for r in knn.top_k(vectors, vectors.where("vec_id % 50 = 0")).collect())
    finally:
        spark.sparkContext._jsc.clearJobGroup()
    fine = [(k, [math.floor(256 * c) for c in v]) for k, v in rows if v and None not in v]
    want = []
    for own in sorted({k for k, _ in fine if k % 50 == 0}):
        scored = [(-sum(a * b for a, b in zip(q, x, strict=True)), k) for i, q in fine if i == own for k, x in fine if k != own and len(x) == len(q)]
        want += [(own, place + 1, k, -s) for place, (s, k) in enumerate(sorted(scored)[:5])]
    assert got == want
    status = spark.sparkContext.statusTracker()
    tasks = [status.getStageInfo(s).numTasks for j in status.getJobIdsForGroup("rounds") for s in status.getJobInfo(j).stageIds if status.getStageInfo(s)]
    assert max(tasks) >= 24


def test_pivots_eliminate():
    rng = np.random.default_rng(3)
    x = np.floor(256 * (lambda v: v / np.linalg.norm(v, axis=1)[:, None])(rng.normal(size=(3000, 64)))).astype(np.int64)
    q, ids = x[:40], np.arange(3000)
    pivots = knn.choose_pivots(x[:2048], knn.PIVOTS)
    floor = knn.first_floor(ids[:40], q, ids[:2048], x[:2048], 5)
    got = knn.block_top(ids[:40], q, floor, ids, x, knn._distances(x, pivots), pivots, 5)
    scores = q @ x.T
    want = [sorted((-int(scores[i, j]), j) for j in range(3000) if j != i)[:5] for i in range(40)]
    assert list(zip(*got[:3], strict=True)) == [(i, j, -s) for i, best in enumerate(want) for s, j in best]
    assert got[3] < 0.25 * 40 * 3000
    # bounds hold for vectors within the pivots' span, and without any pivot
    flat = np.repeat(x[:3], 4, axis=0)
    few = knn.choose_pivots(flat, 48)
    assert len(few) == 3 and knn.block_top(ids[:2], q[:2], floor[:2] * 0 - 10**9, ids[:12], flat, knn._distances(flat, few), few, 5)[3] > 0


def test_suffix_order_and_offsets():
    rng = random.Random(4)
    for size in (2, 5, 40):
        base = [bytes(rng.choice(b"ab") for _ in range(150))] * 3
        strings = [rng.choice(base)[: rng.randrange(150)] + bytes(rng.choice(b"ab") for _ in range(rng.randrange(5))) for _ in range(size)]
        assert [strings[i] for i in repeats.deep_shallow_order(strings)] == sorted(strings)
    middle = bytes(range(128))
    for size in (6, 30):
        make = lambda n: bytes(rng.choice(b"a" * 200 + b"b") for _ in range(n))
        left, right = [make(rng.randrange(280)) for _ in range(size)], [middle + make(rng.randrange(280)) for _ in range(size)]
        got = [{o for a, b in runs for o in range(a, b + 1)} for runs in repeats.repeated_offsets(left, right)]
        for i in range(size):
            window = lambda k, o: (left[k][:o], right[k][: 400 - o]) if len(left[k]) >= o and len(right[k]) >= 400 - o else None
            want = {o for o in range(273) if window(i, o) and any(window(i, o) == window(k, o) for k in range(size) if k != i)}
            assert got[i] == want


def test_crowds_of_surroundings(spark, docs, monkeypatch):
    monkeypatch.setattr(repeats, "CROWD", 3)
    rng = random.Random(9)
    make = lambda n: "".join(rng.choice("abcdefgh ") for _ in range(n))
    passage, rows = make(520), []
    for k in range(60):
        cut, end = rng.randrange(60), 520 - rng.randrange(60)
        rows.append((k, make(rng.randrange(300)) + rng.choice(["", "xy", "xz"]) + passage[cut:end] + make(rng.randrange(300))))
    rows += [(60, rows[0][1]), (60, rows[0][1]), (61, passage), (62, passage[:399])]
    check_repeats(spark.createDataFrame(rows, "doc_id long, text string"))
    check_repeats(docs)


def test_repeats(docs, empty):
    check_repeats(docs)
    assert repeats.digest(empty).count() == 0


def check_repeats(docs):
    rows = [(k, t.encode()) for k, t in held(docs)]
    seen = Counter(t[i : i + 400] for _, t in rows for i in range(len(t) - 399))
    for r in repeats.digest(docs).collect():
        t = dict(rows)[r.doc_id]
        gone = bytearray(len(t))
        for i in range(len(t) - 399):
            if seen[t[i : i + 400]] > 1:
                gone[i : i + 400] = b"\1" * 400
        assert (r.n_removed, r.kept_sha256) == (sum(gone), hashlib.sha256(bytes(b for b, g in zip(t, gone, strict=True) if not g)).hexdigest())


def test_short_periods_are_few_anchors(spark):
    periods = ["the " * 900, "a line of seven words, repeated\n" * 120, "x" * 3000]
    rows = [(k, f"{k} " * k + t) for k, t in enumerate(periods * 2)] + [(9, "only here " * 300), (10, "q" * 401)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    check_repeats(docs)
    check_passages(repeats.digest(docs).collect(), rows)
    hashed = docs.selectExpr("text", "doc_id row_hash")
    assert repeats._anchors(hashed).groupBy("row_hash").count().agg({"count": "max"}).first()[0] < 60
    assert repeats._word_anchors(hashed).groupBy("row_hash").count().agg({"count": "max"}).first()[0] < 60


def test_passages_of_over_50_words(spark, docs):
    rng = random.Random(11)
    make = lambda n: [rng.choice("abcdefgh") * rng.randrange(1, 5) for _ in range(n)]
    planted, edges, mine = make(55), make(50), make(60)  # all under 400 bytes
    rows = [(k, " ".join(make(rng.randrange(30)) + planted + make(rng.randrange(80)))) for k in range(12)]
    rows += [(20 + k, " ".join(make(70) + edges + make(9))) for k in range(4)]  # one word too few
    rows += [(30, " ".join(mine + make(3) + mine)), (30, " ".join(mine + make(3) + mine)), (31, "\n".join(planted)), (32, None), (33, "")]
    rows += [(40, t := " ".join(make(90))), (40, t), (41, t + " more")]
    check_passages(repeats.digest(spark.createDataFrame(rows, "doc_id long, text string")).collect(), [(k, t or "") for k, t in rows])
    check_passages(repeats.digest(docs).collect(), held(docs))


def check_passages(got, rows):
    words, homes = [WORDS.findall(t) for _, t in rows], defaultdict(set)
    for row, own in zip(rows, words, strict=True):
        for i in range(len(own) - 50):
            homes[tuple(own[i : i + 51])].add(row)
    want = []
    for (k, _), own in zip(rows, words, strict=True):
        told = {j for i in range(len(own) - 50) if len(homes[tuple(own[i : i + 51])]) > 1 for j in range(i, i + 51)}
        want.append((k, len(told)))
    assert sorted((r.doc_id, r.n_passage_words) for r in got) == sorted(want)
    assert any(n for _, n in want)


def test_near_duplicates(docs, empty):
    lower = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    sets = {}
    for k, t in held(docs):
        w = WORDS.findall(t.translate(lower))
        sets[k] = {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) > 4 else {tuple(w)} if w else set()
    low = {k: k for k in sets}
    for _ in sets:
        for a in sets:
            for b in sets:
                both = len(sets[a] & sets[b])
                if sets[a] and sets[b] and 100 * both >= 75 * (len(sets[a]) + len(sets[b]) - both):
                    low[a] = low[b] = min(low[a], low[b])
    assert {(r.doc_id, r.n_shingles, r.component_id) for r in jaccard.digest(docs).collect()} == {(k, len(s), low[k]) for k, s in sets.items()}
    one = jaccard.keep_one(docs)
    assert sorted(r.doc_id for r in one.collect()) == sorted(k for k in sets if low[k] == k) and one.columns == docs.columns
    assert jaccard.digest(empty).count() == 0


def test_long_lists_lose_no_link(spark):
    rng = random.Random(6)
    base = [f"w{k}" for k in range(120)]
    rows = []
    for k in range(40):
        words = list(base)
        for _ in range(rng.randrange(1, 5)):
            words[rng.randrange(120)] = f"n{k}-{rng.random()}"
        rows.append((k, " ".join(words)))
    sets = [{tuple(t.split()[i : i + 5]) for i in range(116)} for _, t in rows]
    low = list(range(40))
    for _ in range(40):
        for a in range(40):
            for b in range(40):
                both = len(sets[a] & sets[b])
                if 100 * both >= 75 * (len(sets[a] | sets[b])):
                    low[a] = low[b] = min(low[a], low[b])
    got = {r.doc_id: r.component_id for r in jaccard.digest(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert [got[k] for k in range(40)] == low


def test_toxicity_on_held_out_rows(spark, empty):
    rng = random.Random(8)
    rows = [(k, " ".join(rng.choice(["tree", "house", "river", "stone"]) for _ in range(30)) + (" scum vermin" if k % 5 == 0 else "")) for k in range(600)]
    docs, labels = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame([(k, int(k % 5 == 0)) for k in range(600)], "doc_id long, toxic int")
    got = toxicity.digest(docs, labels).where("held_out").collect()
    assert got and all(r.predicted == int(r.doc_id % 5 == 0) and 0 <= r.score <= 1 for r in got)
    assert toxicity.digest(empty, labels.limit(0)).count() == 0


def test_training_order(spark, docs, empty, tmp_path, monkeypatch):
    monkeypatch.setattr(shards, "PER_SHARD", 8)
    monkeypatch.setattr(shards, "SHARDS_A_TASK", 2)
    for n in (1, 2, 3, 1000):
        assert sorted(shards.slots(np.arange(n), n).tolist()) == list(range(n))
    placed = shards.ordered(docs, PATH, PATTERN).collect()
    want = {r.slot: np.frombuffer(bytes(r.tokens), np.uint16).tolist() for r in placed}
    assert sorted(want) == list(range(len(want))) and len(want) > 24
    library = tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=bpe.load_ranks(PATH), special_tokens={})
    cut = Counter((k, s, tuple(ids[a : a + shards.TOKENS])) for k, t in held(docs) for ids in [library.encode_ordinary(t)] for s, a in enumerate(range(0, len(ids), shards.TOKENS)))
    assert cut == Counter((r.doc_id, r.seq, tuple(want[r.slot])) for r in placed)
    written = shards.write_shards(docs, PATH, PATTERN, str(tmp_path / "shards")).collect()
    got = {r.slot: list(r.tokens) for r in shards.read_from(spark, str(tmp_path / "shards"), 3).collect()}
    padded = {k: (v + [shards.PAD] * shards.TOKENS)[: shards.TOKENS] for k, v in want.items()}
    assert got == {k: v for k, v in padded.items() if k >= 3}
    whole = {r.shard: np.array([padded[k] for k in range(r.first_slot, r.first_slot + r.n_sequences)], "<u2").tobytes() for r in written}
    assert {r.shard: bytes(r.payload) for r in written} == whole and sum(r.n_sequences for r in written) == len(want)
    of = {(r.doc_id, r.seq, r.slot): r.n_tokens for r in placed}
    rows = shards.manifest(docs, PATH, PATTERN).collect()
    assert {(r.doc_id, r.seq, r.slot): r.n_tokens for r in rows} == of and len(rows) == len(of)
    assert all(r.shard == r.slot // 8 and r.byte_offset == r.slot % 8 * 512 and r.shard_sha256 == hashlib.sha256(whole[r.shard]).hexdigest() for r in rows)
    assert shards.manifest(empty, PATH, PATTERN).count() == 0


def test_mixing(docs, empty):
    rows = mixing.digest(docs).collect()
    assert len(rows) == docs.count() and all(0 <= r.taken <= 2 * r.size for r in rows)
    by = defaultdict(lambda: [0, 0, 0.0])
    for r in rows:
        by[r.source_size, r.target][0] += r.taken
    assert all(abs(v[0] - t) <= 3001 for (_, t), v in by.items())
    assert sorted(map(tuple, rows)) == sorted(map(tuple, mixing.digest(docs).collect()))
    assert mixing.digest(empty).count() == 0
    assert mixing.mix_documents(docs).columns == docs.columns
