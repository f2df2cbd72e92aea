"""Quality rules: text statistics by built-in expressions, and a learned decision list over them.

The list is learned by sequential covering: a conjunction of thresholds is grown on two thirds of
the labelled rows by information gain, pruned on the last third, kept if it is precise enough,
and its rows are set aside before the next is grown. Each step is one small aggregation; what is
emitted is an ordered CASE over the statistics.
"""

from __future__ import annotations

import math
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from accord.llm.common import SEPARATORS, documents, let, scratch, written

#: Labelled rows that a list is learned from at most, chosen by a hash of their id.
SAMPLE = 60_000
BINS = 40


def _repeated(words: Column, n: Column) -> Column:
    """Words that lie in a 3-word window found twice or more in the text.

    Windows are hashed, and each hash's low bits give way to the window's place, so that one sort
    of longs brings equal windows together; neighbours count only if their words are equal too.
    """
    window = lambda i: F.xxhash64(F.get(words, i), F.get(words, i + 1), F.get(words, i + 2))
    same = lambda i, j: (F.get(words, i) == F.get(words, j)) & (F.get(words, i + 1) == F.get(words, j + 1)) & (F.get(words, i + 2) == F.get(words, j + 2))

    def covered(hashes: Column) -> Column:
        mask = F.call_function("shiftleft", F.lit(1).cast("long"), F.length(F.bin(n))) - 1

        def places(packed: Column, mask: Column) -> Column:
            at = lambda x: x.bitwiseAND(mask).cast("int")
            high = lambda x: x.bitwiseAND(F.bitwise_not(mask))
            meets = lambda x, y: (high(x) == high(y)) & same(at(x), at(y))
            twice = F.filter(packed, lambda x, k: meets(x, F.get(packed, k - 1)) | meets(x, F.get(packed, k + 1)))
            starts = F.sort_array(F.transform(twice, at))
            zero = F.struct(F.lit(-3).alias("last"), F.lit(0).cast("long").alias("sum"))
            add = lambda s, x: F.struct(x.alias("last"), (s["sum"] + F.least(F.lit(3), x - s["last"])).alias("sum"))
            return F.aggregate(starts, zero, add)["sum"]

        pack = lambda m: F.sort_array(F.transform(hashes, lambda h, i: h.bitwiseAND(F.bitwise_not(m)).bitwiseOR(i.cast("long"))))
        found = let(mask, lambda m: let(pack(m), lambda packed: places(packed, m)))
        return F.when(F.size(F.array_distinct(hashes)) == F.size(hashes), F.lit(0).cast("long")).otherwise(found)

    hashes = F.transform(F.sequence(F.lit(0), n - 3), window)
    return F.when(n < 4, F.lit(0).cast("long")).otherwise(let(hashes, covered))


def text_statistics(docs: DataFrame) -> DataFrame:
    """doc_id, n_words, word_chars, n_symbols, n_lines, n_dup_lines, n_repeat_words, n_upper, n_marks (long).

    One row an input row; null texts count as empty and have zeros. Whole texts, no shuffle, no
    Python: everything is one projection. n_lines: lines with a word; n_dup_lines: those equal to an
    earlier line; n_upper: upper-case letters; n_marks: exclamation marks.
    """
    text, long = F.col("text"), "long"

    def from_words(words: Column) -> Column:
        n = F.size(words)
        return F.struct(n.cast(long).alias("n_words"), F.length(F.array_join(words, "")).cast(long).alias("word_chars"), _repeated(words, n).alias("n_repeat_words"))

    def from_lines(lines: Column) -> Column:
        return F.struct(F.size(lines).cast(long).alias("n_lines"), (F.size(lines) - F.size(F.array_distinct(lines))).cast(long).alias("n_dup_lines"))

    words = F.array_remove(F.split(text, SEPARATORS), "")
    lines = F.filter(F.split(text, "\n"), lambda line: line.rlike(r"[^\x20\x09-\x0D]"))
    only = lambda kept: F.length(F.regexp_replace(text, f"[^{kept}]+", "")).cast(long)
    found = documents(docs).select("doc_id", let(words, from_words).alias("w"), let(lines, from_lines).alias("l"), only("#*$%&|<>").alias("n_symbols"), only(r"\p{Lu}").alias("n_upper"), only("!").alias("n_marks"))
    return found.select("doc_id", "w.n_words", "w.word_chars", "n_symbols", "l.n_lines", "l.n_dup_lines", "w.n_repeat_words", "n_upper", "n_marks")


def measures() -> dict[str, Column]:
    """The statistics that rules may use, as expressions over the columns of text_statistics."""
    words, chars = F.greatest("n_words", F.lit(1)), F.greatest("word_chars", F.lit(1))
    return {
        "n_words": F.col("n_words").cast("double"),
        "word_length": F.col("word_chars") / words,
        "symbol_share": F.col("n_symbols") / words,
        "dup_line_share": F.col("n_dup_lines") / F.greatest("n_lines", F.lit(1)),
        "repeat_share": F.col("n_repeat_words") / words,
        "upper_share": F.col("n_upper") / chars,
        "mark_share": F.col("n_marks") / words,
    }


def base_failed() -> Column:
    """The fixed rule: too short, or mostly repeated windows."""
    return (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))


@dataclass(frozen=True)
class Condition:
    measure: str
    above: bool
    threshold: float

    def column(self) -> Column:
        return F.col(self.measure) > self.threshold if self.above else F.col(self.measure) <= self.threshold

    def __str__(self) -> str:
        return f"{self.measure} {'>' if self.above else '<='} {self.threshold:g}"


Rule = tuple[Condition, ...]


def _all(rule: Rule) -> Column:
    return reduce(lambda a, b: a & b, (c.column() for c in rule), F.lit(True))


def _any(rules: list[Rule]) -> Column:
    return reduce(lambda a, b: a | b, map(_all, rules), F.lit(False))


def _gain(pos: int, neg: int, pos0: int, neg0: int) -> float:
    if not pos:
        return 0.0
    return pos * (math.log2(pos / (pos + neg)) - math.log2(pos0 / (pos0 + neg0)))


def _grow(rows: DataFrame, cuts: dict[str, list[float]], longest: int) -> Rule:
    """Adds the condition of greatest gain until no good row is covered or no condition helps."""
    rule: Rule = ()
    bins = [F.struct(F.lit(m).alias("m"), reduce(lambda a, b: a + b, (F.when(F.col(m) > cut, 1).otherwise(0) for cut in cuts[m])).alias("bin")) for m in cuts if cuts[m]]
    while len(rule) < longest and bins:
        counted = rows.where(_all(rule)).select("bad", F.explode(F.array(*bins)).alias("b")).groupBy("b.m", "b.bin").agg(F.sum("bad").alias("pos"), F.sum(1 - F.col("bad")).alias("neg")).collect()
        tally = {(r["m"], r["bin"]): (r["pos"], r["neg"]) for r in counted}  # measures x bins at most
        best, chosen = 0.0, None
        for m, at in cuts.items():
            got = [tally.get((m, k), (0, 0)) for k in range(len(at) + 1)]
            pos0, neg0 = sum(p for p, _ in got), sum(n for _, n in got)
            if not pos0 or not neg0:
                continue
            pos = neg = 0
            for k, cut in enumerate(at):
                pos, neg = pos + got[k][0], neg + got[k][1]
                for above, p, n in ((False, pos, neg), (True, pos0 - pos, neg0 - neg)):
                    if (gain := _gain(p, n, pos0, neg0)) > best + 1e-9:
                        best, chosen = gain, Condition(m, above, cut)
        if chosen is None:
            break
        rule += (chosen,)
    return rule


def _prune(rows: DataFrame, rule: Rule) -> tuple[Rule, int, int]:
    """The beginning of the rule with the best (bad - good) / (bad + good) on the pruning rows."""
    heads = [rule[: k + 1] for k in range(len(rule))]
    sums = [x for k, h in enumerate(heads) for x in (F.sum(F.when(_all(h), F.col("bad")).otherwise(0)).alias(f"p{k}"), F.sum(F.when(_all(h), 1 - F.col("bad")).otherwise(0)).alias(f"n{k}"))]
    got = rows.agg(*sums).first()
    scored = [((p - n) / (p + n) if p + n else -1.0, -k, p, n) for k in range(len(heads)) for p, n in [(got[f"p{k}"] or 0, got[f"n{k}"] or 0)]]
    _, k, p, n = max(scored)
    return heads[-k], p, n


def learn(statistics: DataFrame, labels: DataFrame, sample: int = SAMPLE, precision: float = 0.95, support: int = 3, longest: int = 4, most_rules: int = 10) -> list[Rule]:
    """The ordered rules that mark rows as bad (labels.quality = 0), learned from labelled statistics.

    labels: doc_id, quality; rows without a label, repeated labels of one id beyond the smallest, and
    null values take no part. At most about `sample` labelled rows are used, those of smallest id
    hash. A rule is kept while its precision on the pruning rows is `precision` or more and it covers
    `support` bad rows there; so few clean documents are lost. Nothing to learn from: no rules.
    """
    known = labels.where(F.col("quality").isNotNull()).groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg((1 - F.min("quality")).cast("int").alias("bad"))
    rows = statistics.join(known, "doc_id").where(~base_failed())
    share = min(1.0, sample / max(1, known.count()))
    chosen = F.pmod(F.xxhash64("doc_id"), F.lit(1_000_000)) < int(share * 1_000_000)
    rows = written(rows.where(chosen).select("doc_id", "bad", *(e.alias(m) for m, e in measures().items())))
    points = [(k + 0.5) / BINS for k in range(BINS)] + [0.0, 0.005, 0.995]
    got = rows.agg(*(F.percentile(m, F.array(*map(F.lit, points))).alias(m) for m in measures())).first()
    cuts = {m: sorted(set(got[m] or ())) for m in measures()}
    part = F.pmod(F.xxhash64("doc_id", F.lit("part")), F.lit(3))
    grow_on, prune_on, rules = rows.where(part != 0), rows.where(part == 0), []
    while len(rules) < most_rules:
        open_ = ~_any(rules)
        rule = _grow(grow_on.where(open_), cuts, longest)
        if not rule:
            break
        rule, pos, neg = _prune(prune_on.where(open_), rule)
        if pos < support or pos < precision * (pos + neg):
            break
        rules.append(rule)
    return rules


def verdict(rules: list[Rule]) -> Column:
    """The rules as one ordered conditional expression over the statistics: true for documents to keep."""
    of, out = measures(), F.lit(True)
    for rule in reversed(rules):
        out = F.when(reduce(lambda a, b: a & b, ((of[c.measure] > c.threshold) if c.above else (of[c.measure] <= c.threshold) for c in rule)), F.lit(False)).otherwise(out)
    return out


def judge(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Every input row's statistics, base_failed and kept. Texts are read once; the rest is narrow.

    Null and empty texts have no words and so fail the base rule; repeated rows have equal results; a row
    without doc_id is judged like any other. Other columns are not read; empty input gives no rows, and without
    labels the base rule alone decides.
    """
    statistics = written(text_statistics(docs))
    rules = learn(statistics, labels)
    return statistics.withColumn("base_failed", base_failed()).withColumn("kept", ~F.col("base_failed") & verdict(rules))


def digest(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept of every input row, as judge has them."""
    return judge(docs, labels).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def keep_good(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The documents kept, columns as given. Rejected ids are few and narrow; texts meet them by id.

    Rows of one id share a fate if any of them is kept, as an id's rows can't be told apart.
    """
    with scratch(docs.sparkSession) as kept:
        bad = kept(judge(docs, labels).groupBy("doc_id").agg(F.max("kept").alias("kept")).where(~F.col("kept")).select(F.col("doc_id").alias("__doc")))
    return docs.join(bad, F.col("doc_id").cast("long").eqNullSafe(F.col("__doc")), "left_anti")
