"""A quality classifier: a factorisation machine over hashed words, structure statistics and metadata.

Every feature has a weight and a short vector; a pair of features counts by the product of their vectors. The sum over
all pairs is half of (square of the sum less sum of the squares), so a text is scored in time linear in
its features. The model is fitted on a bounded sample of labelled rows and scores all rows where they lie.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from accord.llm.common import written
from accord.llm.shingles import buffers, prefix_sets, shingle_sets

#: Labelled rows that are learned from at most, those of smallest id hash.
SAMPLE = 24_000
#: Numbers that words are hashed to, length of a feature's vector, bins of a statistic.
WORDS, RANK, BINS = 1 << 16, 8, 32
EPOCHS, RATE, DECAY = 12, 0.1, 1e-4
#: Words are runs of letters and digits here; all bytes beyond ASCII count as letters.
SEPARATORS = np.array([not (48 <= b <= 57 or 65 <= b <= 90 or 97 <= b <= 122 or b >= 128) for b in range(256)])
#: Kinds of bytes that the statistics count.
LETTER, UPPER, DIGIT, SPACE, SYMBOL, MARK, WITHIN = range(1, 8)
KINDS = np.zeros(256, np.uint8)
KINDS[97:123], KINDS[65:91], KINDS[48:58], KINDS[0xC0:], KINDS[0x80:0xC0] = LETTER, UPPER, DIGIT, LETTER, WITHIN
KINDS[[9, 10, 11, 12, 13, 32]] = SPACE
KINDS[list(b"#*$%&|<>@^~=+_\\/{}[]")], KINDS[list(b"!?")] = SYMBOL, MARK
#: Features in all: words, and the bins of the statistics below.
STATISTICS = ("words", "word_length", "distinct_share", "repeat_share", "dup_line_share", "line_words", "upper_share", "digit_share", "symbol_share", "mark_share", "stated_chars", "stated_rightly")
WIDTH = WORDS + BINS * len(STATISTICS)


def held_out(doc_id: Column) -> Column:
    return F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0


def _statistics(text: str, data: np.ndarray, distinct: int, windows: int, stated: int | None) -> list[float]:
    """Each statistic as a number of bins from 0: shares in 30ths, sizes in steps of the square root of 2."""
    count = np.bincount(KINDS[data], minlength=8)
    chars, n = len(data) - int(count[WITHIN]), len(text.split())
    lines = [x for x in text.split("\n") if x and not x.isspace()]
    shown, log = max(1, chars - int(count[SPACE])), lambda x: 2 * np.log2(1 + x)
    share = lambda part, whole: 30 * part / max(1, whole)
    found = [log(n), 2 * shown / max(1, n), share(distinct, n), share(max(0, n - 2 - windows), n - 2), share(len(lines) - len(set(lines)), len(lines)), log(n / max(1, len(lines)))]
    found += [share(int(count[k]), shown) for k in (UPPER, DIGIT)] + [5 * share(int(count[k]), shown) for k in (SYMBOL, MARK)]
    return [*found, 0.0 if stated is None else 1 + log(max(0, stated)), 0.0 if stated is None else 1.0 + (stated == chars)]


def features(texts: pa.Array, stated: pa.Array) -> Iterator[np.ndarray]:
    """The numbers of each text's features: its distinct words', then one bin of each statistic."""
    offsets, data = buffers(texts)
    first = WORDS + BINS * np.arange(len(STATISTICS))
    rows = zip(texts.to_pylist(), stated.to_pylist(), prefix_sets(texts, SEPARATORS, ()), shingle_sets(texts, 3), strict=True)
    for i, (text, size, (_, words), (_, windows)) in enumerate(rows):
        found = _statistics(text, data[offsets[i] : offsets[i + 1]], len(words), len(windows), size)
        bins = np.minimum(np.array(found), BINS - 1).astype(np.int64)
        yield np.concatenate((np.unique(words % np.uint64(WORDS)).astype(np.int64), first + bins))


def _values(rows: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """All rows' features, their owners and values: words share a length of one, statistics have one each."""
    count = np.array([len(r) for r in rows])
    flat, owner = np.concatenate(rows), np.repeat(np.arange(len(rows)), count)
    value = np.where(flat < WORDS, 1 / np.sqrt(np.maximum(1, count - len(STATISTICS)))[owner], 1.0)
    return flat, owner, value


@dataclass
class Model:
    """weights: one a feature; vectors: RANK a feature; bias."""

    weights: np.ndarray
    vectors: np.ndarray
    bias: float

    def logits(self, rows: list[np.ndarray]) -> np.ndarray:
        if not rows:
            return np.zeros(0)
        flat, owner, value = _values(rows)
        out = self.bias + np.bincount(owner, self.weights[flat] * value, len(rows))
        for column in self.vectors.T:
            part = column[flat] * value
            out += (np.bincount(owner, part, len(rows)) ** 2 - np.bincount(owner, part**2, len(rows))) / 2
        return out

    def score(self, rows: list[np.ndarray]) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.logits(rows), -30, 30)))


def fit(rows: list[np.ndarray], labels: np.ndarray, epochs: int = EPOCHS, seed: int = 7) -> Model:
    """The machine of least logistic loss by AdaGrad over batches of 128 rows; the same rows in the same order give the same model."""
    rng = np.random.default_rng(seed)
    table = np.zeros((WIDTH, RANK + 1))
    table[:, :RANK] = rng.normal(0, 0.05, (WIDTH, RANK))
    squares, rate = np.full((WIDTH, RANK + 1), 1e-3), float(np.clip(labels.mean(), 0.01, 0.99))
    bias, bias_squares = float(np.log(rate / (1 - rate))), 1e-3
    for _ in range(epochs):
        order = rng.permutation(len(rows))
        for start in range(0, len(order), 128):
            batch = order[start : start + 128]
            flat, owner, value = _values([rows[i] for i in batch])
            used, at = np.unique(flat, return_inverse=True)
            held = table[used]
            part = held[at, :RANK] * value[:, None]
            sums = np.stack([np.bincount(owner, part[:, k], len(batch)) for k in range(RANK)], 1)
            logit = bias + np.bincount(owner, held[at, RANK] * value, len(batch)) + (sums**2 - np.stack([np.bincount(owner, part[:, k] ** 2, len(batch)) for k in range(RANK)], 1)).sum(1) / 2
            error = (1 / (1 + np.exp(-np.clip(logit, -30, 30))) - labels[batch]) / len(batch)
            each = error[owner] * value
            step = np.empty_like(held)
            for k in range(RANK):
                step[:, k] = np.bincount(at, each * (sums[owner, k] - part[:, k]), len(used))
            step[:, RANK] = np.bincount(at, each, len(used))
            step += DECAY * held
            squares[used] += step**2
            table[used] -= RATE * step / np.sqrt(squares[used])
            bias_squares += error.sum() ** 2
            bias -= RATE * error.sum() / np.sqrt(bias_squares)
    return Model(table[:, RANK].astype(np.float32), table[:, :RANK].astype(np.float32), float(bias))


def _read(docs: DataFrame) -> DataFrame:
    """doc_id, text and the number of characters that the metadata state (stated; null where they don't)."""
    stated = F.col("n_chars").cast("long") if "n_chars" in docs.columns else F.lit(None).cast("long")
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text"), F.lit("")).alias("text"), stated.alias("stated"))


def learn(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Model:
    """The model, from labelled rows outside the held-out fifth, `sample` of them at most; none: all scores are 1/2, one label alone: that label's rate."""
    known = labels.where(F.col("quality").isNotNull() & ~held_out(F.col("doc_id").cast("long"))).groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.min("quality").cast("int").alias("quality"))
    order = [F.xxhash64("doc_id"), F.col("doc_id")]
    chosen = written(known.orderBy(*order).limit(sample))
    rows = _read(docs).join(chosen, "doc_id").select("text", "stated", "quality", "doc_id")

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = pa.array([x.astype(np.int32).tobytes() for x in features(batch.column(0), batch.column(1))], pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column(3), batch.column(2), found], names=["doc_id", "quality", "found"])

    got = rows.mapInArrow(scan, "doc_id long, quality int, found binary").orderBy("doc_id", "found").limit(sample).collect()  # at most `sample` rows of at most WIDTH numbers
    if not got:
        return Model(np.zeros(WIDTH, np.float32), np.zeros((WIDTH, RANK), np.float32), 0.0)
    return fit([np.frombuffer(r["found"], np.int32).astype(np.int64) for r in got], np.array([r["quality"] for r in got], float))


def score_documents(docs: DataFrame, model: Model, threshold: float = 0.3) -> DataFrame:
    """doc_id, score (0 to 1), predicted (1 from the threshold on) of every input row; null texts count as empty."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # WIDTH times RANK + 1 numbers

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for start in range(0, whole.num_rows, 256):
                batch = whole.slice(start, 256)
                score = shared.value.score(list(features(batch.column(1), batch.column(2))))
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(score), pa.array((score >= threshold).astype(np.int32))], names=["doc_id", "score", "predicted"])

    return _read(docs).mapInArrow(scan, "doc_id long, score double, predicted int")


def digest(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score, predicted of every input row.

    Whole texts and the stated number of characters alone are scored: rows equal in both have equal scores. Null texts
    count as empty; a null n_chars, or none, is a case of its own. A row without doc_id is not held out. Other columns are not
    read; empty tables give no rows, and without labels every score is 1/2.
    """
    scored = score_documents(docs, learn(docs, labels))
    return scored.select("doc_id", F.coalesce(held_out(F.col("doc_id")), F.lit(False)).alias("held_out"), "score", "predicted")
