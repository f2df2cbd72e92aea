"""The prefix trie of conversations: every distinct beginning is a node, with its members, children and what sharing it saves.

Conversations are grouped by the digests of successive blocks of turns. Where all members of a
beginning go on with the same block, the turns inside it have the block's members and need nothing more;
only where sibling blocks diverge are the turn boundaries inside refined, over the distinct blocks rather than
over the conversations. What is summed over a subtree is summed over its members instead: a node belongs
to its smallest member, and each member knows from which turn on the nodes are its own.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from accord.llm.common import numbered, written

#: Turns of a block.
TURNS = 4
#: Fixed values of the contract: conversations whose ids differ below this share a base, and take fewer turns of it than SHARED.
FAMILY, SHARED = 100, 6
#: Bytes of joined ids that are handed on as one row.
CHUNK = 4096
KEY = ["depth", "d1", "d2"]


def _digest(lane: int, block: Column, turns: Column) -> Column:
    """One of two independent 64-bit digests of the first turns of a block."""
    return F.xxhash64(F.lit(lane), block, F.transform(turns, lambda t: t["digest"]))


def placed_turns(conversations: DataFrame) -> DataFrame:
    """conv_id, pos (from 0, by turn, null first), n, digest and size (code points) of every turn; rows without conv_id are left out.

    Null roles and texts count as empty. Equal turn numbers go by the digest of role and text.
    """
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("role", "text"))
    digest = F.unhex(F.substring(F.sha2(F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text), 256), 1, 32))
    rows = conversations.where("conv_id is not null").select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), digest.alias("digest"), F.length(text).cast("long").alias("size"))
    return numbered(rows, "conv_id", ["turn", "digest"]).select("conv_id", "pos", "n", "digest", "size")


def rebuilt(placed: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Turns (conv_id, at, digest, size) and conversations (conv_id, length) after each has taken over its base's first turns.

    The base of c is c - c % FAMILY; crc32(c) % SHARED turns are taken over, fewer if it has fewer, none if there
    is none, in place of as many turns of c's own. A conversation's length can be 0.
    """
    head = F.array_sort(F.collect_list(F.when(F.col("pos") < SHARED - 1, F.struct("pos", "digest", "size"))))
    convs = written(placed.groupBy("conv_id").agg(F.max("n").alias("n"), head.alias("head")))
    bases = convs.select(F.col("conv_id").alias("base"), F.col("head").alias("lent"))
    given = F.crc32(F.col("conv_id").cast("string").cast("binary")) % SHARED
    met = convs.select("conv_id", "n", given.alias("given"), (F.col("conv_id") - F.col("conv_id") % FAMILY).alias("base")).join(bases, "base", "left")
    lent = F.coalesce(F.slice("lent", F.lit(1), F.col("given").cast("int")), F.array().cast(bases.schema["lent"].dataType))
    plan = written(met.select("conv_id", "given", lent.alias("lent"), (F.size(lent) + F.greatest(F.col("n") - F.col("given"), F.lit(0))).cast("long").alias("length")))
    own = placed.join(plan.select("conv_id", "given", F.size("lent").alias("taken")), "conv_id").where("pos >= given")
    own = own.select("conv_id", (F.col("pos") - F.col("given") + F.col("taken")).alias("at"), "digest", "size")
    return own.unionByName(plan.select("conv_id", F.inline("lent")).withColumnRenamed("pos", "at")), plan.select("conv_id", "length")


def _boundaries(blocks: DataFrame, *extra: str) -> DataFrame:
    """blocks with a row for each turn: depth, d1, d2 (the node), q1, q2 (its parent), before (code points before the turn), size, last."""
    lanes = lambda k: [F.when(k == 0, F.col(p)).otherwise(F.col(p).bitwiseXOR(_digest(lane, F.col("pos"), F.slice("turns", F.lit(1), k)))) for lane, p in ((1, "p1"), (2, "p2"))]
    rows = blocks.withColumn("t", F.explode(F.sequence(F.lit(1), F.size("turns"))))
    upto = F.aggregate(F.slice("turns", F.lit(1), F.col("t") - 1), F.col("chars") - F.col("size"), lambda s, x: s + x["size"])
    (d1, d2), (q1, q2) = lanes(F.col("t")), lanes(F.col("t") - 1)
    return rows.select((F.col("pos") * TURNS + F.col("t")).alias("depth"), d1.alias("d1"), d2.alias("d2"), q1.alias("q1"), q2.alias("q2"), upto.alias("before"), F.element_at("turns", F.col("t"))["size"].alias("size"), (F.col("t") == F.size("turns")).alias("last"), "chars", "alone", *extra)


def _refined(rows: DataFrame, *sums: Column) -> DataFrame:
    """rows by node: those of blocks without siblings are nodes as they are, the others are grouped. sums name their columns."""
    names = [c for c in rows.groupBy(*KEY).agg(*sums).columns if c not in KEY]
    return rows.where("alone").select(*KEY, *names).unionByName(rows.where(~F.col("alone")).groupBy(*KEY).agg(*sums))


def _ends(members: DataFrame) -> DataFrame:
    """depth, d1, d2, ends_sha256: the SHA-256 of the ids (conv_id) that end at a node, ascending and comma-joined.

    Sorted ranges of ids are joined to texts of CHUNK bytes, many tasks to a node; a digest is then taken in
    one pass over a node's texts, which are never held together. A SHA-256 has no parts that could be taken apart.
    """
    long = pa.int64()

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        open_, ids, width = None, [], 0
        out: list[tuple] = []
        for batch in batches:
            for *node, conv in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if ids and (node != open_ or width > CHUNK):
                    out.append((*open_, ids[0], ",".join(map(str, ids))))
                    ids, width = [], 0
                open_ = node
                ids.append(conv)
                width += len(str(conv)) + 1
            yield packed(out, ["depth", "d1", "d2", "first", "ids"], [long] * 4 + [pa.string()])
            out = []
        if ids:
            yield packed([(*open_, ids[0], ",".join(map(str, ids)))], ["depth", "d1", "d2", "first", "ids"], [long] * 4 + [pa.string()])

    def packed(rows: list[tuple], names: list[str], types: list) -> pa.RecordBatch:
        columns = zip(*rows, strict=True) if rows else [[]] * len(names)
        return pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(columns, types, strict=True)], names=names)

    def hash_(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        open_, state, out = None, hashlib.sha256(), []
        for batch in batches:
            for *node, ids in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if node == open_:
                    state.update(b",")
                else:
                    if open_ is not None:
                        out.append((*open_, state.hexdigest()))
                    open_, state = node, hashlib.sha256()
                state.update(ids.encode())
            yield packed(out, [*KEY, "ends_sha256"], [long] * 3 + [pa.string()])
            out = []
        if open_ is not None:
            yield packed([(*open_, state.hexdigest())], [*KEY, "ends_sha256"], [long] * 3 + [pa.string()])

    order = [*map(F.col, KEY), F.col("conv_id")]
    texts = members.select(*order).repartitionByRange(*order).sortWithinPartitions(*order).mapInArrow(join, "depth long, d1 long, d2 long, first long, ids string")
    return texts.repartition(*KEY).sortWithinPartitions(*KEY, "first").select(*KEY, "ids").mapInArrow(hash_, "depth long, d1 long, d2 long, ends_sha256 string")


def prefix_trie(turns: DataFrame, convs: DataFrame) -> DataFrame:
    """The nodes of turns (conv_id, at, digest, size) of conversations (conv_id, length; the length can be 0).

    conv_id (smallest member), depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256; a row for
    each distinct beginning and one for the root. Nodes are told apart by 128 bits of digest. No conversations: no rows.
    """
    block = F.floor(F.col("at") / TURNS)
    held = turns.groupBy("conv_id", block.alias("block")).agg(F.array_sort(F.collect_list(F.struct("at", "digest", "size"))).alias("turns"), F.sum("size").alias("size"))
    held = held.select("conv_id", "block", "turns", "size", *(_digest(lane, F.col("block"), F.col("turns")).alias(f"b{lane}") for lane in (1, 2)))
    blocks = numbered(held, "conv_id", ["block"], {"x1": ("bit_xor", "b1"), "x2": ("bit_xor", "b2"), "chars": ("sum", "size")})
    blocks = written(blocks)
    of = ["pos", "x1", "x2"]
    ends_here = F.col("pos") == F.col("n") - 1
    before = [F.col(f"x{k}").bitwiseXOR(F.col(f"b{k}")) for k in (1, 2)]
    distinct = blocks.withColumns({"p1": before[0], "p2": before[1]}).groupBy(*of).agg(
        F.count("*").alias("n_convs"), F.min("conv_id").alias("owner"), F.count_if(ends_here).alias("ends"), *(F.first(c).alias(c) for c in ("turns", "size", "chars", "p1", "p2"))
    )
    distinct = written(distinct)
    alone = distinct.groupBy("pos", "p1", "p2").agg(F.count("*").alias("blocks"), F.min("x1").alias("x1"), F.min("x2").alias("x2")).where("blocks = 1")
    distinct = written(distinct.join(alone.select(*of, F.lit(True).alias("alone")), of, "left").withColumn("alone", F.coalesce("alone", F.lit(False))))

    inside = _boundaries(distinct, "n_convs", "owner", F.when(F.col("t") == F.size("turns"), F.col("ends")).otherwise(0).alias("ends"))
    nodes = _refined(inside, F.sum("n_convs").alias("n_convs"), F.min("owner").alias("owner"), F.sum("ends").alias("ends"), *(F.first(c).alias(c) for c in ("q1", "q2", "before")))
    zero, none = F.lit(0).cast("long"), F.lit(None).cast("long")
    root = convs.agg(F.count("*").alias("n_convs"), F.min("conv_id").alias("owner"), F.count_if(F.col("length") == 0).alias("ends")).where("n_convs > 0")
    root = root.select(zero.alias("depth"), zero.alias("d1"), zero.alias("d2"), "n_convs", "owner", "ends", none.alias("q1"), none.alias("q2"), zero.alias("before"))
    nodes = written(nodes.unionByName(root))

    # own: code points of a conversation's turns before the first node that belongs to it; leaf: whether its last node is its own and childless
    chains = nodes.groupBy("owner").agg(F.min_by("before", "depth").alias("own"), F.max((F.col("n_convs") == F.col("ends")).cast("long")).alias("leaf"))
    totals = convs.select("conv_id", zero.alias("chars")).unionByName(blocks.where(ends_here).select("conv_id", "chars")).groupBy("conv_id").agg(F.max("chars").alias("total"))
    members = totals.join(chains, totals["conv_id"] == chains["owner"], "left")
    members = written(members.select("conv_id", F.coalesce("own", "total").alias("own"), F.coalesce("leaf", zero).alias("leaf")))
    spare = F.greatest(F.col("own") - F.col("chars"), zero)
    later = blocks.select("conv_id", *of, "chars").join(members, "conv_id").groupBy(*of).agg(F.sum(spare).alias("rest"), F.sum("leaf").alias("n_leaves"), F.min_by("own", "conv_id").alias("own"))
    inside = _boundaries(distinct.join(later, of), "n_convs", "n_leaves", "rest", "own")
    left = F.col("chars") - F.col("before")
    saved = F.col("rest") + (F.col("n_convs") - 1) * left + F.least(F.greatest(F.col("own") - F.col("before"), zero), left)
    sums = _refined(inside.withColumn("saved_tokens", saved), F.sum("saved_tokens").alias("saved_tokens"), F.sum("n_leaves").alias("n_leaves"))
    top = members.agg(F.sum("own").alias("saved_tokens"), F.sum("leaf").alias("n_leaves")).select(zero.alias("depth"), zero.alias("d1"), zero.alias("d2"), "saved_tokens", "n_leaves").where("n_leaves is not null")

    children = nodes.where("depth > 0").select((F.col("depth") - 1).alias("depth"), F.col("q1").alias("d1"), F.col("q2").alias("d2"), F.lit(1).cast("long").alias("n_children"))
    last = blocks.where(ends_here).select("conv_id", (F.col("pos") * TURNS + F.size("turns")).alias("depth"), F.col("x1").alias("d1"), F.col("x2").alias("d2"))
    last = last.unionByName(convs.where("length = 0").select("conv_id", zero.alias("depth"), zero.alias("d1"), zero.alias("d2")))
    stacked = nodes.select(*KEY, "owner", "n_convs", "q1", "q2")
    for part in (sums, top, children, _ends(last)):
        stacked = stacked.unionByName(part, allowMissingColumns=True)
    once = [F.max(c).alias(c) for c in ("owner", "n_convs", "q1", "q2", "saved_tokens", "n_leaves", "ends_sha256")]
    full = written(stacked.groupBy(*KEY).agg(*once, F.coalesce(F.sum("n_children"), zero).alias("n_children")))
    parents = nodes.select((F.col("depth") + 1).alias("depth"), F.col("d1").alias("q1"), F.col("d2").alias("q2"), F.col("owner").alias("parent_conv_id"))
    met = full.join(parents, ["depth", "q1", "q2"], "left")
    return met.select(F.col("owner").alias("conv_id"), "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", F.coalesce("ends_sha256", F.lit(hashlib.sha256(b"").hexdigest())).alias("ends_sha256"))


def digest(conversations: DataFrame) -> DataFrame:
    """The trie of the rebuilt conversations, a row for each node.

    Rows without conv_id form no conversation; null turns come first, null roles and texts are empty. Repeated rows are
    turns of their own. Other columns are not read; an empty table gives no rows, not even a root. Whole texts count.
    """
    turns, convs = rebuilt(written(placed_turns(conversations)))
    return prefix_trie(turns, convs)
