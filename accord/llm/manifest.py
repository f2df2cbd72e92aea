"""A Merkle manifest of a dataset: a tree over each source's rows and one over the sources, with a proof for every row.

Rows stand in order, and a level's nodes are runs of three. Columns shifted by fixed offsets (lag and
lead), masked by a node's slot in its run and by the run's length, hold its siblings; the first
child of a run hashes the parent and stands for it on the next level. A window covers a block of
rows whose levels all lie within it, so that a source of any size is cut into blocks; the blocks' tops
are the next rows, until one is left.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from accord.llm.common import numbered, written

#: Nodes of a run, levels that a block holds, and so its rows.
ARITY, LEVELS = 3, 5
BLOCK = ARITY**LEVELS


def item(value: Column) -> Column:
    """UTF-8 byte count, colon, value; '-' for null."""
    return F.coalesce(F.concat(F.octet_length(value).cast("string"), F.lit(":"), value), F.lit("-"))


def leaf(text: Column) -> Column:
    """The digest of a documents row with the given text, lowercase hex."""
    fields = [F.col("doc_id").cast("long").cast("string"), F.col("source").cast("string"), F.col("lang").cast("string"), F.col("n_chars").cast("long").cast("string"), text]
    return F.sha2(F.concat(*map(item, fields)), 256)


def group_key(source: Column) -> Column:
    """A text that is never null and sorts as sources do, null first."""
    return F.coalesce(F.concat(F.lit("="), source.cast("string")), F.lit("-"))


def _hex(digest: Column) -> Column:
    return F.lower(F.hex(digest))


def _within(nodes: DataFrame) -> DataFrame:
    """nodes with block, path and top: siblings level by level within the block, and what the block becomes.

    A node of level k is held by its first row alone, pos being a multiple of 3 ** k; the rows under it
    take its siblings from there. A key with one node left has come to its root and is carried on.
    """
    rows = nodes.withColumn("block", F.floor(F.col("pos") / BLOCK)).withColumn("h0", _hex(F.col("digest")))
    window = Window.partitionBy("key", "block").orderBy("pos")
    nothing = F.lit("")
    for level in range(LEVELS):
        step, h = ARITY**level, F.col(f"h{level}")
        slot = F.floor(F.col("pos") / step) % ARITY
        rows = rows.withColumns({f"__{name}": at.over(window) for name, at in {"lag2": F.lag(h, 2 * step), "lag1": F.lag(h, step), "lead1": F.lead(h, step), "lead2": F.lead(h, 2 * step)}.items()})
        left = F.concat(F.when(slot == 2, F.col("__lag2")).otherwise(nothing), F.when(slot >= 1, F.col("__lag1")).otherwise(nothing))
        right = F.concat(F.coalesce(F.when(slot <= 1, F.col("__lead1")), nothing), F.coalesce(F.when(slot == 0, F.col("__lead2")), nothing))
        held = (F.col("pos") % step == 0) & (F.col("n") > step)
        first = F.col("pos") % (step * ARITY) == 0
        parent = F.when(first, F.when(F.col("n") > step, F.sha2(F.concat(h, right), 256)).otherwise(h))
        rows = rows.withColumns({f"s{level}": F.when(held, F.struct(left.alias("left"), right.alias("right"))), f"h{level + 1}": parent})
    upto = window.rowsBetween(Window.unboundedPreceding, 0)
    own = [F.last(f"s{level}", ignorenulls=True).over(upto) for level in range(LEVELS)]
    path = F.array(*(F.when(F.col("n") > ARITY**level, s) for level, s in enumerate(own)))
    return rows.select(*nodes.columns, "block", F.array_compact(path).alias("path"), F.last(f"h{LEVELS}", ignorenulls=True).over(upto).alias("top"), (F.col("pos") % BLOCK == 0).alias("__heads"))


def proofs(nodes: DataFrame) -> DataFrame:
    """nodes (key, pos, n, digest, others) with path and root: the siblings of each level up to its key's root.

    path: array<struct<left, right>> in hex, from the row upwards; a level without siblings is an entry too,
    as its node is hashed alone. Every stage takes LEVELS levels, so a key of N rows needs log(N) / log(BLOCK) stages.
    """
    largest = nodes.agg(F.max("n")).first()[0] or 0
    rows = _within(nodes)
    if largest <= BLOCK:
        return rows.withColumnRenamed("top", "root").drop("block", "__heads")
    heads = rows.where(F.col("__heads") & (F.col("n") > BLOCK)).select("key", F.col("block").alias("pos"), F.ceil(F.col("n") / BLOCK).alias("n"), F.unhex("top").alias("digest"))
    upper = proofs(written(heads)).select("key", F.col("pos").alias("block"), F.col("path").alias("__up"), F.col("root").alias("__root"))
    met = rows.join(upper, ["key", "block"], "left")
    path = F.when(F.col("__up").isNull(), F.col("path")).otherwise(F.concat("path", "__up"))
    return met.select(*nodes.columns, path.alias("path"), F.coalesce("__root", "top").alias("root"))


def manifest(leaves: DataFrame) -> DataFrame:
    """leaves (doc_id, source, leaf in hex, others) with subroot, root and path, which leads from the leaf to root.

    Leaves of a source ascend by doc_id, null first, and among equal ids by leaf; sources by UTF-8 bytes, null
    first. Rows that are repeated are leaves of their own. Empty input gives no rows.
    """
    others = [c for c in leaves.columns if c not in ("source", "leaf")]
    given = leaves.select(group_key(F.col("source")).alias("key"), F.unhex("leaf").alias("digest"), *others)
    rows = numbered(given, "key", ["doc_id", "digest"])
    proved = proofs(rows)
    subroots = written(proved.where("pos = 0").select(F.lit(0).alias("key"), F.col("key").alias("source"), F.unhex("root").alias("digest")))
    over = proofs(numbered(subroots, "key", ["source"])).select(F.col("source").alias("__source"), F.col("root").alias("__root"), F.col("path").alias("__over"))
    met = proved.join(written(over), F.col("key") == F.col("__source"))
    source = F.when(F.col("key") != "-", F.expr("substring(key, 2)"))
    return met.select(*others, source.alias("source"), _hex(F.col("digest")).alias("leaf"), F.col("root").alias("subroot"), F.col("__root").alias("root"), F.concat("path", "__over").alias("path"))


def proof_digest(path: Column) -> Column:
    """SHA-256 over all siblings of a path, in its order."""
    return F.sha2(F.array_join(F.transform(path, lambda s: F.concat(s["left"], s["right"])), ""), 256)


def folded(digest: Column, path: Column) -> Column:
    """The root that a leaf comes to by the siblings of a path."""
    return F.aggregate(path, digest, lambda acc, s: F.sha2(F.concat(s["left"], acc, s["right"]), 256))


def tampered() -> Column:
    """Which rows the check of the manifest changes: those whose id has an even CRC-32."""
    return F.crc32(F.col("doc_id").cast("long").cast("string").cast("binary")) % 2 == 0


def digest(docs: DataFrame) -> DataFrame:
    """doc_id, leaf, subroot, root, proof_sha256, folded_root, verified of every row, some texts changed after the manifest was made.

    Where `tampered` holds, line feeds are deleted before the row is folded with its original siblings. Nulls
    are values of their own ('-') in every column and can't be changed by that; a row without doc_id is not
    tampered with and comes first in its source. Repeated rows have proofs of their own; other columns are
    not read; empty input gives no rows. Whole texts are read once and leave their task as digests only.
    """
    changed = F.when(tampered() & F.contains(F.col("text"), F.lit("\n")), leaf(F.replace(F.col("text"), F.lit("\n"), F.lit(""))))
    leaves = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "source", leaf(F.col("text")).alias("leaf"), F.unhex(changed).alias("changed"))
    rows = manifest(leaves).withColumn("folded_root", folded(F.coalesce(_hex(F.col("changed")), F.col("leaf")), F.col("path")))
    return rows.select("doc_id", "leaf", "subroot", "root", proof_digest(F.col("path")).alias("proof_sha256"), "folded_root", (F.col("folded_root") == F.col("root")).alias("verified"))
