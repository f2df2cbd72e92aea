"""Mixing sources to target weights by pivotal dependent rounding, in built-in expressions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from accord.llm.common import WORD, let, scratch, written

#: Fixed values of the contract: weights by rank of the source, the mix's share, the cap on a source.
WEIGHTS, SHARE, CAP = (3, 1, 2), 1.5, 2.0
#: Documents of one source that meet in a group of the reduction tree, on average.
FAN = 48


def sizes(docs: DataFrame) -> DataFrame:
    """doc_id, source, size (words) and a hash of the row, which orders rows of equal id."""
    return docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"),
        F.coalesce(F.regexp_count(F.col("text"), F.lit(f"({WORD})")), F.lit(0)).cast("long").alias("size"),
        F.xxhash64(F.col("doc_id").cast("long"), "text").alias("row_hash"),
    )


def targets(sized: DataFrame) -> DataFrame:
    """source, source_size, n, target: shares of 150 % of all words by weight, a source's capped at twice its own.

    A row for each source: the excess of capped sources is shared anew among the others by weight
    until none is above. The sources whose cap is smallest for their weight are capped first, so
    running sums over the sources in that order find the level. Empty input: no rows.
    """
    by = sized.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("n"))
    order = Window.orderBy(F.col("source").asc_nulls_last())
    by = by.withColumn("w", F.element_at(F.array(*map(F.lit, WEIGHTS)), (F.row_number().over(order) - 1) % len(WEIGHTS) + 1).cast("double"))
    up = Window.orderBy(F.col("cap") / F.col("w"), F.col("source").asc_nulls_last())
    before, rest = up.rowsBetween(Window.unboundedPreceding, -1), up.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    everything = Window.partitionBy()
    by = by.withColumn("cap", F.col("source_size") * CAP).withColumn("mix", F.sum("source_size").over(everything) * SHARE)
    by = by.withColumn("left", F.col("mix") - F.coalesce(F.sum("cap").over(before), F.lit(0.0))).withColumn("w_left", F.sum("w").over(rest))
    # at the first source whose share is within its cap, left and w_left give the level for it and all after it
    fits = F.col("left") * F.col("w") <= F.col("cap") * F.col("w_left")
    level = F.min_by(F.struct("left", "w_left"), F.when(fits, F.struct(F.col("cap") / F.col("w"), F.coalesce(F.col("source"), F.lit("\U0010ffff"))))).over(everything)
    by = by.withColumn("level", level)
    share = F.coalesce(F.col("level.left") * F.col("w") / F.col("level.w_left"), F.col("cap"))
    return by.select("source", "source_size", "n", F.least("cap", share).alias("target"))


def _draw(*of: Column) -> Column:
    """A number in [0, 1) that depends on the columns alone."""
    return F.pmod(F.xxhash64(*of), F.lit(1 << 52)).cast("double") / float(1 << 52)


def _meet(carry: Column, other: Column, level: Column) -> Column:
    """Two documents with fractional p: mass moves at random until one is integral; size-weighted mass is kept.

    Gives struct(done, carry): the document that became integral, and the one that goes on.
    """
    a, b = carry["size"].cast("double"), other["size"].cast("double")
    up = F.least(1 - carry["p"], other["p"] * b / a)
    down = F.least(carry["p"], (1 - other["p"]) * b / a)
    rises = _draw(carry["row_hash"], other["row_hash"], level) * (up + down) < down
    shift = F.when(rises, up).otherwise(-down)
    p, q = carry["p"] + shift, other["p"] - shift * a / b
    # of the two moves' ends one is integral by construction; which one follows from the smaller bound
    first = F.when(rises, (1 - carry["p"]) <= other["p"] * b / a).otherwise(carry["p"] <= (1 - other["p"]) * b / a)
    with_p = lambda doc, x: F.struct(*(doc[c].alias(c) for c in FIELDS), x.alias("p"))
    inside = lambda x: F.least(F.greatest(x, F.lit(0.0)), F.lit(1.0))
    done = F.when(first, with_p(carry, F.when(rises, 1.0).otherwise(0.0))).otherwise(with_p(other, F.when(rises, 0.0).otherwise(1.0)))
    return F.struct(done.alias("done"), F.when(first, with_p(other, inside(q))).otherwise(with_p(carry, inside(p))).alias("carry"))


FIELDS = ("row_hash", "doc_id", "size", "whole")


def mix(sized: DataFrame, fan: int = FAN, seed: int = 0) -> DataFrame:
    """doc_id, source, size, row_hash, source_size, target, copies: how often the mix takes each row.

    Each row's expected copies are target / source_size, so at most 2. The whole part is certain;
    the fractional parts of a source are rounded by a reduction tree: rows meet in groups of about
    `fan`, each group leaves one fractional row, and those meet again until every source has one,
    which a last draw rounds. Moves keep the sum of size times probability, so a source misses its
    target by about one document. No group grows with the source: their number does. Draws depend
    on row hashes, so reruns agree. Rows without words get no copies. Repeated rows are rounded on
    their own. Empty input gives no rows.
    """
    shares = targets(sized)
    # a row for each source: far fewer than documents, joined by key without a forced broadcast
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    shares = shares.withColumn("rate", rate).select(F.col("source").alias("of"), "source_size", "target", "rate", "n")
    rows = sized.join(shares, sized["source"].eqNullSafe(F.col("of"))).drop("of")
    rows = written(rows.withColumn("whole", F.floor("rate").cast("long")).withColumn("p", F.col("rate") - F.floor("rate")))
    open_ = (F.col("size") > 0) & (F.col("p") > 0)
    done = rows.where(~open_).select("source", *FIELDS, F.lit(0.0).alias("p"))
    level, left = 0, rows.where(open_).select("source", *FIELDS, "p")
    parts, most = [done], rows.where(open_).groupBy("source").count().agg(F.max("count")).first()[0] or 0
    while most > 1:
        groups = -(-most // fan)
        # the number of groups follows the largest source; smaller ones just end sooner
        keyed = left.withColumn("bucket", F.pmod(F.xxhash64("row_hash", "doc_id", F.lit(seed + level)), F.lit(groups)))
        members = keyed.groupBy("source", "bucket").agg(F.sort_array(F.collect_list(F.struct(*FIELDS, "p"))).alias("docs"))
        key = F.lit(seed + level)
        start = F.struct(F.get("docs", F.lit(0)).alias("carry"), F.slice("docs", 1, 0).alias("done"))

        def step(state: Column, other: Column) -> Column:
            none_left = (state["carry"]["p"] <= 0) | (state["carry"]["p"] >= 1)
            settled = F.struct(state["carry"].alias("done"), other.alias("carry"))
            return let(
                F.when(none_left, settled).otherwise(_meet(state["carry"], other, key)),
                lambda m: F.struct(m["carry"].alias("carry"), F.concat(state["done"], F.array(m["done"])).alias("done")),
            )

        folded = members.select("source", F.aggregate(F.slice("docs", F.lit(2), F.greatest(F.size("docs") - 1, F.lit(0))), start, step).alias("s"))
        folded = written(folded)
        parts.append(folded.select("source", F.inline("s.done")))
        left = folded.select("source", "s.carry.*")
        most = left.groupBy("source").count().agg(F.max("count")).first()[0] or 0
        level += 1
    last = F.when(_draw(F.col("row_hash"), F.col("doc_id"), F.lit(seed - 1)) < F.col("p"), 1.0).otherwise(0.0)
    parts.append(left.withColumn("p", last))
    rounded = parts[0]
    for part in parts[1:]:
        rounded = rounded.unionByName(part)
    copies = (F.col("whole") + F.round("p").cast("long")).alias("copies")
    return rounded.join(shares, rounded["source"].eqNullSafe(F.col("of"))).select("doc_id", "source", "size", "row_hash", "source_size", "target", copies)


def mix_documents(docs: DataFrame) -> DataFrame:
    """The documents of the mix, a row for each copy, columns as given.

    Rows of equal id and text are decided one by one but can't be told apart afterwards: their
    copies are dealt out evenly among them.
    """
    with scratch(docs.sparkSession) as kept:
        decided = kept(mix(written(sizes(docs))).groupBy("doc_id", "row_hash").agg(F.sum("copies").alias("__sum"), F.count("*").alias("__rows")))
    repeats = decided.where(F.col("__rows") > 1).limit(1).count() > 0
    decided = decided.where(F.col("__sum") > 0).withColumnsRenamed({"doc_id": "__doc", "row_hash": "__row"})
    keyed = docs.withColumn("__id", F.col("doc_id").cast("long")).withColumn("__hash", F.xxhash64("__id", "text"))
    met = keyed.join(decided, keyed["__id"].eqNullSafe(F.col("__doc")) & (F.col("__hash") == F.col("__row")))
    number = F.row_number().over(Window.partitionBy("__id", "__hash").orderBy("__row")) if repeats else F.lit(1)
    met = met.withColumn("__k", number)
    dealt = F.floor(F.col("__sum") * F.col("__k") / F.col("__rows")) - F.floor(F.col("__sum") * (F.col("__k") - 1) / F.col("__rows"))
    met = met.withColumn("__n", dealt.cast("int")).where(F.col("__n") > 0)
    return met.withColumn("__copy", F.explode(F.sequence(F.lit(1), F.col("__n")))).select(*docs.columns)


def digest(docs: DataFrame) -> DataFrame:
    """doc_id, size, source_size, target, taken of every input row, repeated rows each on their own.

    Null texts have size 0, and nothing is taken of them; a null source is one source, the last.
    Other columns are not read; empty input gives no rows.
    """
    return mix(written(sizes(docs))).select("doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"))
