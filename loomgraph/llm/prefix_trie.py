"""Conversations as a trie of shared beginnings, with totals for every subtree.

Nodes are digests of the first turns of a conversation; each row of a conversation names its own node and the node
above it, so the tree comes about as digest-keyed parent edges. Totals rise by pointer jumping: in round k every node
adds what the nodes exactly 2^k below it have gathered, and its pointer moves on to its pointer's pointer, so a trie
of depth n takes log2(n) rounds.

Digests of beginnings are built block by block (BLOCK turns at a time, then blocks of blocks), positions by counts of
key ranges, and lists of conversations that end at a node are hashed as a stream of sorted pieces: a conversation
or node that holds a third of all rows is many tasks, and no task holds it whole. Digests are 128 bits of SHA-256.

Defined results: rows with a null conv_id take no part; a null role or text is empty; a null turn comes first; turns
of equal number are ordered by the digest of role and text, so repeated rows are turns one after another; an empty
table gives an empty result; further columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F

from ..session import forget, keep, small_batches
from .common import tidy

BLOCK = 64
HEAD, FAMILY = 9, 5
ROOT = "root"
#: Conversation ids in one piece of a node's list.
PIECE = 512


def _digest(value: Column) -> Column:
    return F.substring(F.sha2(value, 256), 1, 32)


def numbered(turns: DataFrame) -> DataFrame:
    """conv_id, pos (from 1), turn_digest, n_bytes and n_turns of each turn in its conversation's order; kept.

    Turns are cut into ranges of (conversation, turn), so that a long conversation is many ranges; counts by range say
    where each begins.
    """
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    told = _digest(F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text))
    rows = turns.where("conv_id is not null").select(
        F.col("conv_id").cast("long").alias("conv_id"), "turn", told.alias("turn_digest"), F.octet_length(text).cast("long").alias("n_bytes"), F.monotonically_increasing_id().alias("_row")
    )
    ranged = keep(rows.repartitionByRange("conv_id", "turn", "turn_digest", "_row").withColumn("_range", F.spark_partition_id()))
    whole = Window.partitionBy("conv_id")
    earlier = whole.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    counts = ranged.groupBy("conv_id", "_range").agg(F.count(F.lit(1)).alias("_n"))
    counts = counts.select("conv_id", "_range", F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_before"), F.sum("_n").over(whole).alias("n_turns"))
    inside = Window.partitionBy("conv_id", "_range").orderBy(F.col("turn").asc_nulls_first(), "turn_digest", "_row")
    placed = ranged.withColumn("_nth", F.row_number().over(inside)).join(counts, ["conv_id", "_range"])
    out = keep(placed.select("conv_id", (F.col("_before") + F.col("_nth")).cast("long").alias("pos"), "turn_digest", "n_bytes", "n_turns"))
    forget(ranged)
    return out


def rebuilt(turns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Conversations of numbered turns that begin as the first of their family does: rows(conv_id, i, turn_digest,
    n_bytes, last) and lengths(conv_id, length); both kept.

    Conversation c takes the first h turns of c - c % FAMILY, h = crc32(c) % HEAD, and goes on with its own after h.
    """
    own = turns.groupBy("conv_id").agg(F.max("n_turns").alias("n_turns"))
    h = F.crc32(F.col("conv_id").cast("string").cast("binary")) % HEAD
    convs = own.select("conv_id", "n_turns", (F.col("conv_id") - F.col("conv_id") % FAMILY).alias("base"), h.alias("h"))
    known = own.select(F.col("conv_id").alias("base"), F.col("n_turns").alias("_there"))
    convs = convs.join(known, "base", "left").withColumn("head", F.least("h", F.coalesce("_there", F.lit(0)))).drop("_there")
    convs = keep(convs.withColumn("length", F.col("head") + F.greatest(F.lit(0), F.col("n_turns") - F.col("h"))))
    begins = turns.where(F.col("pos") < HEAD).select(F.col("conv_id").alias("base"), "pos", "turn_digest", "n_bytes")
    heads = convs.where("head > 0").select("conv_id", "base", "head", "length").join(begins, "base").where("pos <= head")
    tails = turns.drop("n_turns").join(convs.select("conv_id", "h", "head", "length"), "conv_id").where("pos > h")
    rows = heads.select("conv_id", F.col("pos").alias("i"), "turn_digest", "n_bytes", "length").union(
        tails.select("conv_id", (F.col("pos") - F.col("h") + F.col("head")).alias("i"), "turn_digest", "n_bytes", "length"))
    rows = keep(rows.select("conv_id", "i", "turn_digest", "n_bytes", (F.col("i") == F.col("length")).alias("last")))
    return rows, convs


def beginnings(rows: DataFrame, deepest: int) -> DataFrame:
    """rows(conv_id, i, turn_digest, ...) with node and parent: digests of the first i and i - 1 turns.

    A block's digests are those of its first 1, 2, ... turns; what comes before a block is the digest of the blocks
    before, found in the same way over one row a block.
    """
    extra = [c for c in rows.columns if c not in ("conv_id", "i", "turn_digest")]
    blocks = rows.groupBy("conv_id", F.expr(f"(i - 1) div {BLOCK}").alias("_b")).agg(F.array_sort(F.collect_list(F.struct("i", "turn_digest", *extra))).alias("_items"))
    told = F.transform("_items", lambda x: x["turn_digest"])
    inner = F.transform("_items", lambda x, k: _digest(F.array_join(F.slice(told, 1, k + 1), "")))
    blocks = blocks.withColumn("_inner", inner)
    if deepest <= BLOCK:
        blocks = blocks.withColumns({"_whole": F.lit(None).cast("string"), "_start": F.lit(ROOT)})
    else:
        blocks = keep(blocks)
        totals = blocks.select("conv_id", (F.col("_b") + 1).alias("i"), F.element_at("_inner", -1).alias("turn_digest"))
        above = beginnings(totals, -(-deepest // BLOCK)).select("conv_id", (F.col("i") - 1).alias("_b"), F.col("node").alias("_whole"), F.col("parent").alias("_start"))
        blocks = blocks.join(above, ["conv_id", "_b"])
    at_start = F.when(F.col("_start") == ROOT, F.lit(ROOT)).otherwise(_digest(F.concat("_start", F.lit("/"))))
    full = F.when(F.col("_whole").isNotNull(), _digest(F.concat("_whole", F.lit("/"))))
    nodes = F.transform("_inner", lambda x, k: F.coalesce(F.when(k == BLOCK - 1, full), _digest(F.concat("_start", x))))
    out = blocks.select("conv_id", nodes.alias("_nodes"), at_start.alias("_at"), F.posexplode("_items").alias("_k", "_item"))
    node, parent = F.get("_nodes", F.col("_k")), F.coalesce(F.get("_nodes", F.col("_k") - 1), "_at")
    return out.select("conv_id", "_item.i", "_item.turn_digest", *[f"_item.{c}" for c in extra], node.alias("node"), parent.alias("parent"))


def ends(members: DataFrame) -> DataFrame:
    """node, ends_sha256 of members(node, conv_id): SHA-256 of each node's ids, ascending, joined by commas.

    Ids are range-partitioned by (node, id) and joined in pieces there; then a node's pieces go through one running
    hash in order, a batch at a time.
    """

    def join(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            ids, nodes = batch["conv_id"].to_numpy(), batch["node"].to_numpy()
            cuts = [0, *(k for k in range(1, len(ids)) if nodes[k] != nodes[k - 1]), len(ids)]
            rows = [(nodes[a], ids[k], ",".join(map(str, ids[k : min(k + PIECE, b)]))) for a, b in zip(cuts, cuts[1:]) if a < b for k in range(a, b, PIECE)]
            yield pd.DataFrame(rows, columns=["node", "low", "ids"]).astype({"low": "int64"})

    def hashed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        node = state = None
        for batch in batches:
            out = []
            for name, ids in zip(batch["node"], batch["ids"]):
                if name == node:
                    state.update(b"," + ids.encode())
                    continue
                if state is not None:
                    out.append((node, state.hexdigest()))
                node, state = name, hashlib.sha256(ids.encode())
            yield pd.DataFrame(out, columns=["node", "ends_sha256"])
        if state is not None:
            yield pd.DataFrame([(node, state.hexdigest())], columns=["node", "ends_sha256"])
        tidy()

    pieces = members.repartitionByRange("node", "conv_id").sortWithinPartitions("node", "conv_id").mapInPandas(join, "node string, low long, ids string")
    with small_batches(members.sparkSession, 2000):
        return keep(pieces.repartition("node").sortWithinPartitions("node", "low").mapInPandas(hashed, "node string, ends_sha256 string"))


def rollup(tree: DataFrame, deepest: int, *amounts: str) -> DataFrame:
    """node (and up, where its pointer ended) with its amounts summed over its subtree, of tree(node, parent, amounts...), by pointer jumping; kept.

    After round k a node holds what lies less than 2^k below it, and points 2^k up. Sums by pointer are partial
    before they move; the join that moves pointers has one row a node on its other side, so Spark may split it.
    """
    now = keep(tree.select("node", F.col("parent").alias("up"), *amounts))
    reach = 1
    while reach <= deepest:
        below = now.where("up is not null").groupBy(F.col("up").alias("node")).agg(*[F.sum(a).alias(f"_{a}") for a in amounts])
        added = now.join(below, "node", "left").select("node", "up", *[(F.col(a) + F.coalesce(f"_{a}", F.lit(0))).alias(a) for a in amounts])
        reach *= 2
        if reach <= deepest:
            far = now.select(F.col("node").alias("up"), F.col("up").alias("_far"))
            added = added.join(far, "up", "left").select("node", F.col("_far").alias("up"), *amounts)
        fresh = keep(added)
        forget(now)
        now = fresh
    return now


def trie(conversations: DataFrame) -> DataFrame:
    """A row per node of the rebuilt conversations' trie: conv_id (smallest member), depth, parent_conv_id, n_convs,
    n_children, n_leaves, saved_tokens, ends_sha256."""
    turns = numbered(conversations)
    rows, convs = rebuilt(turns)
    forget(turns)
    deepest = convs.agg(F.max("length")).first()[0]
    told = keep(beginnings(rows, deepest or 1).drop("turn_digest"))
    forget(rows)
    grown = told.groupBy("node").agg(F.min("conv_id").alias("conv_id"), F.max("i").alias("depth"), F.count(F.lit(1)).alias("n_convs"), F.max("parent").alias("parent"), F.max("n_bytes").alias("n_bytes"))
    top = convs.agg(F.min("conv_id").alias("conv_id"), F.count(F.lit(1)).alias("n_convs")).where("n_convs > 0")
    top = top.select(F.lit(ROOT).alias("node"), "conv_id", F.lit(0).cast("long").alias("depth"), "n_convs", F.lit(None).cast("string").alias("parent"), F.lit(0).cast("long").alias("n_bytes"))
    nodes = keep(grown.unionByName(top))
    children = nodes.where("parent is not null").groupBy(F.col("parent").alias("node")).agg(F.count(F.lit(1)).alias("n_children"))
    tree = keep(nodes.join(children, "node", "left").withColumn("n_children", F.coalesce("n_children", F.lit(0))))
    forget(nodes)
    own = tree.select("node", "parent", (F.col("n_children") == 0).cast("long").alias("n_leaves"), ((F.col("n_convs") - 1) * F.col("n_bytes")).alias("saved_tokens"))
    totals = rollup(own, deepest or 0, "n_leaves", "saved_tokens")
    over = tree.select(F.col("node").alias("parent"), F.col("conv_id").alias("parent_conv_id"))
    finish = told.where("last").select("node", "conv_id").union(convs.where("length = 0").select(F.lit(ROOT), "conv_id"))
    lists = ends(finish)
    forget(told)
    found = tree.join(totals.drop("up"), "node").join(lists, "node", "left").join(over, "parent", "left")
    out = keep(found.select(
        "conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens",
        F.coalesce("ends_sha256", F.lit(hashlib.sha256(b"").hexdigest())).alias("ends_sha256"),
    ))
    forget(convs, tree, totals, lists)
    return out
