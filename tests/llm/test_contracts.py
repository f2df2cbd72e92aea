"""Whole contract columns against plain Python, and the pipeline against its stages."""

import hashlib
import random
import re
import zlib
from collections import Counter

import public_tokenizers
import pytest
import tiktoken

import corpus_pipeline
from accord.llm import bpe, jaccard, mixing, pii, quality, toxicity
from accord.llm.queries import VOCABULARY

WORDS = re.compile(r"[^\x20\x09-\x0D]+")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, n_words long, spans string, row_hash string, size string"
#: Fixed values of the contract.
PATTERNS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


@pytest.fixture(scope="module")
def docs(spark):
    rng = random.Random(11)
    words = ["the", "river", "naïve", "a@b.co", "x.y@", "1.2.3.4", "999.1.1.1", "1.2.3.4.5", "4111 1111 1111 1111", "4111111111111112", "+1 (555) 123-4567", "+12", "#tag|", "日本", "$5&<>"]
    texts = [None, "", " \n", *(" ".join((rng.choice(words) if rng.random() < 0.3 else f"w{rng.randrange(400)}") + rng.choice(["", "", "", "\n", "\nsame line\n"]) for _ in range(rng.randrange(1, 200))) for _ in range(40))]
    texts += [texts[5], texts[5] + " tail", "three same words " * 40, "word " * 49, "w" * 5000]
    rows = [(k, t, "en", [None, "b", "a", "c"][k % 4], len(t or ""), 1, "x", "y", "z") for k, t in enumerate(texts)]
    return spark.createDataFrame([*rows, rows[6], rows[6]], SCHEMA)


def held(docs):
    return [(r.doc_id, r.text or "", r.source) for r in docs.collect()]


def luhn(digits):
    total = 0
    for i, d in enumerate(map(int, reversed(digits))):
        total += d if i % 2 == 0 else sum(divmod(2 * d, 10))
    return total % 10 == 0


def valid(kind, value):
    digits = re.sub("[^0-9]", "", value)
    return {"email": True, "ip": kind == "ip" and all(int(p) <= 255 for p in value.split(".")), "card": 16 <= len(digits) <= 19 and luhn(digits or "1"), "phone": 8 <= len(digits) <= 15}[kind]


def test_base_spans(docs):
    want = Counter()
    for k, text, _ in held(docs):
        found = [(kind, m.start(), m.end()) for kind, p in PATTERNS.items() for m in re.finditer(p, text) if valid(kind, m.group())]
        joined = ",".join(f"{a}:{b}:{c}" for a, b, c in found)
        count = Counter(kind for kind, *_ in found)
        want[k, *(count[kind] for kind in PATTERNS), hashlib.sha256(joined.encode()).hexdigest()] += 1
    got = pii.digest(docs).collect()
    assert Counter((r.doc_id, r.n_email, r.n_ip, r.n_card, r.n_phone, r.base_sha256) for r in got) == want


def test_statistics_and_base_rule(docs, spark):
    labels = spark.createDataFrame([], "doc_id long, quality int")
    want = Counter()
    for k, text, _ in held(docs):
        words, at = WORDS.findall(text), {}
        for i in range(len(words) - 2):
            at.setdefault(tuple(words[i : i + 3]), []).append(i)
        repeat = len({j for v in at.values() if len(v) > 1 for i in v for j in (i, i + 1, i + 2)})
        lines = [x for x in text.split("\n") if WORDS.search(x)]
        failed = len(words) < 50 or 100 * repeat > 50 * len(words)
        want[k, len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), repeat, failed, not failed] += 1
    got = quality.digest(docs, labels).collect()
    assert Counter((r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed, r.kept) for r in got) == want


def shares(by):
    """Targets by shares of 150 % by weight, capped at twice the source, the excess shared anew."""
    order = sorted(by, key=lambda s: (s is None, s or ""))
    weight = {s: (3, 1, 2)[i % 3] for i, s in enumerate(order)}
    left, free, out = 1.5 * sum(by.values()), set(order), {}
    while free:
        total = sum(weight[s] for s in free)
        over = {s for s in free if left * weight[s] / total > 2 * by[s] + 1e-9}
        if not over:
            return out | {s: left * weight[s] / total for s in free}
        out |= {s: 2.0 * by[s] for s in over}
        left -= sum(out[s] for s in over)
        free -= over
    return out


def test_mixing_targets(docs):
    rows, by = held(docs), Counter()
    for _, text, source in rows:
        by[source] += len(WORDS.findall(text))
    target, got = shares(by), mixing.digest(docs).collect()
    source = {k: s for k, _, s in rows}
    size = {k: len(WORDS.findall(t)) for k, t, _ in rows}
    assert Counter(r.doc_id for r in got) == Counter(k for k, *_ in rows)
    taken = Counter()
    for r in got:
        assert (r.size, r.source_size) == (size[r.doc_id], by[source[r.doc_id]]) and abs(r.target - target[source[r.doc_id]]) < 1e-6 and r.taken <= 2 * r.size
        taken[source[r.doc_id]] += r.taken
    largest = {s: max(size[k] for k in source if source[k] == s) for s in by}
    assert all(abs(taken[s] - target[s]) <= largest[s] + 1e-6 for s in by)


def test_held_out_rows(docs, spark):
    labels = spark.createDataFrame([(k, k % 2) for k in range(40)], "doc_id long, toxic int")
    got = toxicity.digest(docs, labels).collect()
    assert len(got) == docs.count() and all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) and r.predicted == int(r.score >= 0.3) for r in got)


def test_pipeline_equals_its_stages(spark, docs, tmp_path):
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(k, 1) for k in range(30)], "doc_id long, quality int").write.parquet(str(tmp_path / "labels.parquet"))
    given = spark.read.parquet(str(tmp_path / "documents.parquet"))
    good = corpus_pipeline.quality_rules(spark, given, str(tmp_path))
    assert good.columns == docs.columns
    bad = {k for k, t, _ in held(docs) if len(WORDS.findall(t)) < 50}
    assert {r.doc_id for r in good.collect()}.isdisjoint(bad) and good.count() > 10
    one = corpus_pipeline.near_duplicates(spark, good, str(tmp_path))
    of = {r.doc_id: r.component_id for r in jaccard.digest(good).collect()}
    assert sorted(r.doc_id for r in one.collect()) == sorted(k for k in of if of[k] == k) and one.columns == docs.columns
    clean = corpus_pipeline.personal_data(spark, one, str(tmp_path))
    assert clean.count() == one.count() and not any(re.search(PATTERNS["email"], r.text) for r in clean.collect()) and clean.columns == docs.columns
    mixed = corpus_pipeline.source_mixing(spark, clean, str(tmp_path))
    copies = Counter(r.doc_id for r in mixed.collect())
    assert mixed.columns == docs.columns and set(copies) <= set(of) and max(copies.values()) <= 2
    library = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=bpe.load_ranks(public_tokenizers.path(VOCABULARY)), special_tokens={})
    want = Counter((r.doc_id, len(library.encode_ordinary(r.text)), hashlib.sha256(r.text.encode()).hexdigest()) for r in mixed.collect())
    assert Counter((r.doc_id, r.n_tokens, r.decoded_sha256) for r in corpus_pipeline.run(spark, str(tmp_path)).collect()) == want


def test_pipeline_on_nothing(spark, docs, tmp_path):
    docs.limit(0).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([], "doc_id long, quality int").write.parquet(str(tmp_path / "labels.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
