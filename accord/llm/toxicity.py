"""Toxicity by weak supervision.

Many weak voters (words of a mined lexicon, patterns) vote on documents. A generative model of the
votes estimates each voter's accuracy and the voters' correlations by expectation maximisation;
its posterior labels train a linear classifier over words, which scores every document.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from accord.llm.common import documents, written
from accord.llm.shingles import prefix_sets, string_hash

#: Labelled rows that are learned from, about; they are drawn by a share of the hashes of ids.
SAMPLE = 24_000
#: Words the classifier weighs, and those among them that vote, at most.
WORDS, VOTERS = 4_000, 300
#: Beginnings of longer words, in characters, that count as features too: they hold for inflected forms.
PREFIXES = (4, 5, 6)
#: A word is a run of letters and digits; the separators of the byte scan say the same for ASCII.
NOT_WORD = r"[^A-Za-z0-9\x{80}-\x{10FFFF}]+"
SEPARATORS = np.array([not (48 <= b <= 57 or 65 <= b <= 90 or 97 <= b <= 122 or b >= 128) for b in range(256)])


def held_out(doc_id: Column) -> Column:
    return F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2


def patterns(text: str) -> list[int]:
    """Votes of the pattern voters: 1 for a sign of abuse, 0 for none."""
    n = max(1, len(text))
    return [int(text.count("!") * 100 > n), int(text.count("?") * 100 > n), int(text.isupper()), int("!!" in text or "??" in text), int("***" in text or "@#" in text), int(n < 60)]


@dataclass
class Model:
    """hashes: sorted word hashes; weights: theirs, then the patterns', then the bias."""

    hashes: np.ndarray
    weights: np.ndarray

    def score(self, found: list[np.ndarray], votes: np.ndarray) -> np.ndarray:
        k = len(self.hashes)
        out = votes @ self.weights[k:-1] + self.weights[-1]
        if k:
            for i, own in enumerate(found):
                at = np.minimum(np.searchsorted(self.hashes, own), k - 1)
                out[i] += self.weights[at[self.hashes[at] == own]].sum()
        return 1 / (1 + np.exp(-np.clip(out, -30, 30)))


def word_hashes(words: list[str]) -> np.ndarray:
    """Of lexicon entries: words, or beginnings of words marked by a star."""
    return np.array([string_hash(w.rstrip("*").encode(), len(w) - 1 if w.endswith("*") else 0) for w in words], np.uint64)


def label_model(votes: np.ndarray, labels: np.ndarray, rounds: int = 8, trust: float = 3.0) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Posterior of label 1 for each row, voters' log odds of a vote (accuracy), and their correlations.

    Expectation maximisation over votes (rows x voters, 0 or 1), with the labels as a prior on the rates
    of equal weight and as one more voter whose vote has the log odds `trust`. Voters that vote together beyond what the label explains share their weight.
    """
    prior = float(np.clip(labels.mean() if len(labels) else 0.1, 0.01, 0.99))
    rates = lambda q: np.stack(((q @ votes + 0.5) / (q.sum() + 5), ((1 - q) @ votes + 0.5) / ((1 - q).sum() + 5)))
    known = rates(labels.astype(float))
    current, share, together = known, np.ones(votes.shape[1]), np.eye(votes.shape[1])
    posterior = labels.astype(float)
    for _ in range(rounds):
        on = np.log(current[0] / current[1]) * share
        off = np.log((1 - current[0]) / (1 - current[1])) * share
        logit = np.log(prior / (1 - prior)) + votes @ on + (1 - votes) @ off + trust * (2 * labels - 1)
        posterior = 1 / (1 + np.exp(-np.clip(logit, -30, 30)))
        current = (rates(posterior) + known) / 2
        rest = votes - posterior[:, None] * current[0] - (1 - posterior[:, None]) * current[1]
        spread = np.sqrt((rest**2).mean(0)) + 1e-9
        together = (rest.T @ rest) / max(1, len(rest)) / np.outer(spread, spread)
        share = 1 / np.maximum(1, np.where(together > 0.2, together, 0).sum(1))
    return posterior, np.log(current[0] / current[1]), together


def linear_classifier(rows: list[np.ndarray], width: int, target: np.ndarray, epochs: int = 40, rate: float = 1.0, decay: float = 1e-5) -> np.ndarray:
    """Logistic weights (and a bias) for rows given as arrays of feature numbers, by AdaGrad on soft targets."""
    weights, squares = np.zeros(width + 1), np.full(width + 1, 1e-6)
    rng = np.random.default_rng(7)
    for _ in range(epochs):
        order = rng.permutation(len(rows))
        for start in range(0, len(order), 256):
            part = order[start : start + 256]
            count = np.array([len(rows[i]) for i in part])
            flat = np.concatenate([rows[i] for i in part]) if len(part) else np.zeros(0, np.int64)
            owner = np.repeat(np.arange(len(part)), count)
            logit = np.bincount(owner, weights[flat], len(part)) + weights[-1]
            error = 1 / (1 + np.exp(-np.clip(logit, -30, 30))) - target[part]
            step = np.bincount(flat, error[owner], width + 1)
            step[-1] = error.sum()
            step = step / len(part) + decay * weights
            squares += step**2
            weights -= rate * step / np.sqrt(squares)
    return weights


def _longer(k: int):
    return lambda w: F.length(w) > k


def _beginning(k: int):
    return lambda w: F.concat(F.substring(w, 1, k), F.lit("*"))


def learn(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Model:
    """The classifier, from labelled rows outside the held-out quarter, `sample` of them at most."""
    known = labels.where(F.col("toxic").isNotNull() & ~held_out(F.col("doc_id").cast("long"))).groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max("toxic").cast("int").alias("toxic"))
    share = min(1.0, sample / max(1, known.count()))
    known = known.where(F.pmod(F.xxhash64("doc_id"), F.lit(1_000_000)) < int(share * 1_000_000))
    rows = written(documents(docs).join(known, "doc_id").select("doc_id", "text", "toxic"))
    total = rows.agg(F.count("*").alias("n"), F.sum("toxic").alias("pos")).first()
    n, pos = total["n"], total["pos"] or 0
    if not pos or pos == n:
        return Model(np.zeros(0, np.uint64), np.array([0.0] * len(patterns("")) + [-3.0 if not pos else 3.0]))
    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    words = F.filter(F.array_distinct(F.split(F.translate("text", upper, lower), NOT_WORD)), lambda w: F.length(w) > 1)
    beginnings = [F.transform(F.filter(words, _longer(k)), _beginning(k)) for k in PREFIXES]
    words = F.array_distinct(F.concat(words, *beginnings))
    counted = rows.select("toxic", F.explode(words).alias("word")).groupBy("word").agg(F.sum("toxic").alias("p"), F.count("*").alias("c")).where("c >= 3")
    odds = F.log((F.col("p") + 0.1) * (n - pos) / ((F.col("c") - F.col("p") + 0.1 * (n - pos) / pos) * pos))
    # twice the log likelihood ratio against the base rate; words that speak for toxicity alone, as most others are noise
    part = lambda k, rate: F.when(k > 0, k * F.log(k / (F.col("c") * rate))).otherwise(0.0)
    weight = 2 * (part(F.col("p"), pos / n) + part(F.col("c") - F.col("p"), 1 - pos / n))
    best = counted.select("word", odds.alias("odds"), weight.alias("weight")).where("odds > 1 and weight > 10").orderBy(F.desc("weight"), "word").limit(WORDS).collect()  # a fixed number
    lexicon = [r["word"] for r in best[:VOTERS]]
    if not best:
        return Model(np.zeros(0, np.uint64), np.array([0.0] * len(patterns("")) + [float(np.log(pos / (n - pos)))]))
    hashes = np.unique(word_hashes([r["word"] for r in best]))
    voters = word_hashes(lexicon)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, found = batch.column(0).to_pylist(), [np.zeros(0, np.int64)] * batch.num_rows
            for i, own in prefix_sets(batch.column(0), SEPARATORS, PREFIXES):
                at = np.minimum(np.searchsorted(hashes, own), len(hashes) - 1)
                found[i] = at[hashes[at] == own]
            yield pa.RecordBatch.from_arrays([batch.column(1), pa.array([x.astype(np.int32).tobytes() for x in found], pa.binary()), pa.array([bytes(patterns(t)) for t in texts], pa.binary()), batch.column(2)], names=["toxic", "found", "patterns", "doc_id"])

    got = rows.select("text", "toxic", "doc_id").mapInArrow(scan, "toxic int, found binary, patterns binary, doc_id long").orderBy("doc_id").collect()  # `sample` rows at most
    features = [np.frombuffer(r["found"], np.int32).astype(np.int64) for r in got]
    signs = np.array([list(r["patterns"]) for r in got], float)
    votes = np.zeros((len(got), len(voters)))
    column = {int(np.searchsorted(hashes, v)): j for j, v in enumerate(voters)}
    for i, own in enumerate(features):
        votes[i, [column[f] for f in own.tolist() if f in column]] = 1
    posterior, _, _ = label_model(np.hstack((votes, signs)), np.array([r["toxic"] for r in got]))
    width = len(hashes) + signs.shape[1]
    rows_ = [np.concatenate((own, len(hashes) + np.flatnonzero(sign))) for own, sign in zip(features, signs, strict=True)]
    return Model(hashes, linear_classifier(rows_, width, posterior))


def score_documents(docs: DataFrame, model: Model, threshold: float = 0.3) -> DataFrame:
    """doc_id, score (0 to 1), predicted (1 from the threshold on) of every input row; null texts count as empty."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # WORDS numbers at most

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [np.zeros(0, np.uint64)] * batch.num_rows
            for i, own in prefix_sets(batch.column(1), SEPARATORS, PREFIXES):
                found[i] = own
            votes = np.array([patterns(t) for t in batch.column(1).to_pylist()], float).reshape(batch.num_rows, -1)
            score = shared.value.score(found, votes)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(score), pa.array((score >= threshold).astype(np.int32))], names=["doc_id", "score", "predicted"])

    return documents(docs).mapInArrow(scan, "doc_id long, score double, predicted int")


def digest(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score, predicted of every input row.

    Null texts count as empty and are scored by their patterns and the bias; equal texts have equal
    scores, so repeated rows have equal results. A row without doc_id is not held out. Other columns
    are not read; empty input gives no rows.
    """
    scored = score_documents(docs, learn(docs, labels))
    return scored.select("doc_id", F.coalesce(held_out(F.col("doc_id")), F.lit(False)).alias("held_out"), "score", "predicted")
