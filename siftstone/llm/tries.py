"""Conversation prefix trie by ROLLUP over positional turn columns.

A conversation is laid out in blocks of ``block`` columns, each the id of one turn. ``GROUP BY <path before the block>,
ROLLUP(t0, t1, …)`` with ``grouping_id()`` aggregates the prefixes of all lengths together; a long conversation goes on in
further rows, whose key is the path of the block before. A path is the exclusive or of its turns' ids, mixed with their
positions, so that it can be put together from blocks and no conversation has to lie in one task.

The smallest member of a node *owns* it. A conversation owns the end of its path, so that (owner, depth) names a node,
and what lies in a subtree follows from sums over its members: a leaf counts with its owner, and a member other than the
node's owner saves the tokens of the path that it shares with smaller conversations. Two rollups do it all: the first finds
the owners, the second sums.
"""

from __future__ import annotations

import hashlib

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..operators.ordered import cut_points, with_bucket
from .common import join_spread, partitions_for, stored, tidy

#: Turns per block of columns.
BLOCK = 8
#: Every conversation's first turns come from the first one of its group of ``GROUP`` ids, up to ``MOST_LENT`` of them.
GROUP, MOST_LENT = 5, 8
#: Blocks whose running path one window carries, before it goes on from window to window.
CHAIN = 256
#: Ids are put into strings of up to ``1 << SPAN_BITS`` neighbouring ids before they are hashed.
SPAN_BITS = 9
#: Conversations whose ends one task hashes, about.
ENDS_PER_TASK = 5_000_000

_ID = "struct<a: bigint, b: bigint, bytes: bigint>"


def turn_ids(conversations: DataFrame) -> DataFrame:
    """``conv_id, place, a, b, bytes``: the turns in order (from 1), each with a 128-bit id of role and text.

    Turns are ordered by ``turn``, null first, then by role and text. Null roles and texts are empty; rows without a
    ``conv_id`` belong to no conversation.
    """
    turns = conversations.filter(F.col("conv_id").isNotNull()).select(
        F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"),
        F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"),
    )
    tied = turns.groupBy("conv_id", "turn").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
    ties = [] if tied.isEmpty() else ["role", "text"]  # texts travel only where they decide the order
    ids = turns.select(
        "conv_id", "turn", *ties, F.xxhash64(F.lit(1), "role", "text").alias("a"), F.xxhash64(F.lit(2), "role", "text").alias("b"),
        F.octet_length("text").cast("long").alias("bytes"), F.coalesce(F.col("turn"), F.lit(-(2**63))).alias("_turn"),
    )
    # a conversation of any length: numbered inside ranges of turns, then by what lies in earlier ranges
    ids = with_bucket(ids, "_turn", cut_points(ids, "_turn", ids.count()), "_range")
    inside = Window.partitionBy("conv_id", "_range").orderBy(F.col("turn").asc_nulls_first(), *ties)
    local = ids.withColumn("place", F.row_number().over(inside).cast("long"))
    before = Window.partitionBy("conv_id").orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    counts = ids.groupBy("conv_id", "_range").agg(F.count(F.lit(1)).alias("_n")).select(
        "conv_id", "_range", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before")
    )
    return local.join(counts.filter("_before > 0"), ["conv_id", "_range"], "left").select(
        "conv_id", (F.col("place") + F.coalesce("_before", F.lit(0))).alias("place"), "a", "b", "bytes"
    )


def rebuilt(turns: DataFrame) -> DataFrame:
    """``conv_id, length, place, a, b, bytes``: turns of the rebuilt conversations; a turnless one has a row without place.

    Conversation ``c`` gets the first ``h`` turns of conversation ``c - c % GROUP`` (all, if it has fewer; none, if it is
    absent), then its own after its first ``h``; ``h`` is the CRC-32 of the id's decimal form modulo ``MOST_LENT + 1``.
    """
    lengths = turns.groupBy("conv_id").agg(F.count(F.lit(1)).alias("own"))
    lenders = lengths.select(F.col("conv_id").alias("lender"), F.col("own").alias("lent"))
    plan = lengths.withColumn("lender", F.col("conv_id") - F.col("conv_id") % GROUP).join(lenders, "lender", "left").select(
        "conv_id", "lender", "own", (F.crc32(F.col("conv_id").cast("string").cast("binary")) % (MOST_LENT + 1)).alias("h"),
        F.coalesce("lent", F.lit(0)).alias("lent"),
    )
    head = F.least("h", "lent")
    plan = stored(plan.select("*", head.alias("head"), (head + F.greatest(F.col("own") - F.col("h"), F.lit(0))).alias("length")), "trie-plan")
    borrowed = turns.filter(F.col("place") <= MOST_LENT).withColumnRenamed("conv_id", "lender").join(plan, "lender").filter("place <= h")
    kept = join_spread(turns, plan.select("conv_id", "own", "h", "head", "length"), ["conv_id"], "own").filter("place > h")
    columns = ["conv_id", "length", "place", "a", "b", "bytes"]
    none = plan.filter("length = 0").select("conv_id", "length", *[F.lit(None).cast("long").alias(c) for c in columns[2:]])
    return borrowed.select(*columns).unionByName(kept.withColumn("place", F.expr("place - h + head")).select(*columns)).unionByName(none)


def blocks(turns: DataFrame, size: int = BLOCK) -> DataFrame:
    """``conv_id, length, block, a, b, above, t0, t1, …``: the turn columns of each block, with path and bytes of what comes before."""
    at = F.coalesce(F.col("place") - 1, F.lit(0))
    mixed = turns.select(
        "conv_id", "length", F.floor(at / size).alias("block") if size > 1 else at.alias("block"), (at % size).alias("slot"), "bytes",
        # a path is an exclusive or, so an id has to tell its place
        F.when(F.col("place").isNotNull(), F.xxhash64("place", "a")).alias("a"), F.when(F.col("place").isNotNull(), F.xxhash64("place", "b")).alias("b"),
    )
    wide = mixed.groupBy("conv_id", "length", "block").agg(
        *[F.max(F.when(F.col("slot") == i, F.col(c))).alias(f"{c}{i}") for i in range(size) for c in ("a", "b", "bytes")],
        F.coalesce(F.bit_xor("a"), F.lit(0)).alias("xa"), F.coalesce(F.bit_xor("b"), F.lit(0)).alias("xb"), F.coalesce(F.sum("bytes"), F.lit(0)).alias("sum"),
    )
    ids = [
        F.when(F.col(f"a{i}").isNotNull(), F.struct(F.col(f"a{i}").alias("a"), F.col(f"b{i}").alias("b"), F.col(f"bytes{i}").alias("bytes"))).cast(_ID).alias(f"t{i}")
        for i in range(size)
    ]
    wide = stored(wide.select("conv_id", "length", F.col("block").cast("long").alias("block"), "xa", "xb", "sum", *ids), "trie-wide")
    zero = F.lit(0).cast("long")
    names = ["conv_id", "length", "block", "a", "b", "above", *[f"t{i}" for i in range(size)]]
    short = wide.filter(F.col("length") <= size).withColumns({"a": zero, "b": zero, "above": zero})
    long = wide.filter(F.col("length") > size).withColumn("chain", F.floor(F.col("block") / CHAIN))
    chains = long.groupBy("conv_id", "chain").agg(F.bit_xor("xa").alias("ca"), F.bit_xor("xb").alias("cb"), F.sum("sum").alias("cs"))
    earlier = Window.partitionBy("conv_id").orderBy("chain").rowsBetween(Window.unboundedPreceding, -1)
    chains = chains.select("conv_id", "chain", *_running(earlier, ca="pa", cb="pb", cs="ps"))
    inside = Window.partitionBy("conv_id", "chain").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    long = long.select("*", *_running(inside, xa="ia", xb="ib", sum="is")).join(chains, ["conv_id", "chain"]).withColumns({
        "a": F.col("pa").bitwiseXOR(F.col("ia")), "b": F.col("pb").bitwiseXOR(F.col("ib")), "above": F.col("ps") + F.col("is"),
    })
    return short.select(*names).unionByName(long.select(*names))


def _running(window, **names) -> list[Column]:
    """Exclusive or of two columns and sum of the third over the rows before."""
    (a, to_a), (b, to_b), (s, to_s) = names.items()
    return [
        F.coalesce(F.bit_xor(a).over(window), F.lit(0)).alias(to_a), F.coalesce(F.bit_xor(b).over(window), F.lit(0)).alias(to_b),
        F.coalesce(F.sum(s).over(window), F.lit(0)).alias(to_s),
    ]


def _rollup(laid: DataFrame, size: int, sums: str) -> DataFrame:
    """One row per node: ``conv_id`` (its smallest member), depth, n_convs, path (a, b), parent's path (up_a, up_b), above, and ``sums``.

    ``above`` counts the bytes of the path without its last turn. A row whose conversation ended before the level is no node;
    level 0 of a later block is the last node of the block before.
    """
    ids = [f"t{i}" for i in range(size)]
    there = " + ".join(f"int({t} IS NOT NULL)" for t in ids)
    path = {c: f"{c} ^ " + " ^ ".join(f"coalesce({t}.{c}, 0L)" for t in ids) for c in ("a", "b")}
    last = f"coalesce({', '.join(reversed(ids))})"
    grouped = laid.sparkSession.sql(
        f"""
        SELECT block, a, b, {", ".join(ids)}, {size} - bit_count(grouping_id()) AS level, min(conv_id) AS conv_id, count(*) AS n_convs, min(above) AS base, {sums}
        FROM {{laid}} GROUP BY block, a, b, ROLLUP({", ".join(ids)})
        """,
        laid=laid,
    )
    return grouped.filter(f"{there} = level AND (level > 0 OR block = 0)").selectExpr(
        "conv_id", f"block * {size} + level AS depth", "n_convs", f"{path['a']} AS a", f"{path['b']} AS b",
        f"{path['a']} ^ {last}.a AS up_a", f"{path['b']} ^ {last}.b AS up_b",
        "base + " + " + ".join(f"coalesce({t}.bytes, 0L)" for t in ids) + f" - coalesce({last}.bytes, 0L) AS above",
        *[s.rsplit(" AS ", 1)[1] for s in sums.split(", ")],
    )


def prefix_trie(conversations: DataFrame, block: int = BLOCK) -> DataFrame:
    """The trie of the rebuilt conversations, one row per node: ``conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256``.

    A node is a sequence of first turns (role, text), named by its smallest member and its depth; the root has depth 0.
    ``n_leaves`` counts the childless nodes of its subtree, ``saved_tokens`` what sharing saves there: each node's
    (n_convs - 1) times the bytes of its last text. ``ends_sha256`` hashes the ids of the members that end at the node.

    Null roles and texts are empty; a null turn comes first, equal turns are ordered by role and text (so exact repeats
    of a row are further turns); rows without ``conv_id`` take no part; an empty table has no nodes, as a node needs a member. Texts of any length
    count by their ids. Further columns are ignored.
    """
    laid = stored(blocks(rebuilt(stored(turn_ids(conversations), "trie-turns")), block), "trie-blocks")
    nodes = stored(_rollup(laid, block, "count(*) AS members"), "trie-owners")
    children = nodes.filter("depth > 0").groupBy(F.col("up_a").alias("a"), F.col("up_b").alias("b")).agg(F.count(F.lit(1)).alias("n_children"))
    nodes = stored(nodes.join(children, ["a", "b"], "left").fillna(0, ["n_children"]), "trie-nodes")
    members = stored(_members(laid, nodes, block), "trie-members")
    placed = join_spread(laid, members.select("conv_id", "leaf", "shared", F.ceil((F.col("length") + 1) / block).alias("rows")), ["conv_id"], "rows")
    sums = stored(_rollup(placed, block, "sum(shared) AS all_shared, sum(leaf) AS n_leaves").drop("a", "b", "up_a", "up_b"), "trie-sums")
    owners = members.select("conv_id", "first", "host", "shared", F.greatest(F.expr("length - first + 1"), F.lit(0)).alias("owned"))
    return (
        join_spread(sums, owners, ["conv_id"], "owned")
        .join(nodes.select("conv_id", "depth", "n_children"), ["conv_id", "depth"])
        .join(_ends(members), ["conv_id", "depth"], "left")
        .select(
            "conv_id", "depth", F.expr("CASE WHEN depth = 0 THEN NULL WHEN first < depth THEN conv_id ELSE host END").alias("parent_conv_id"),
            "n_convs", "n_children", "n_leaves", F.expr("all_shared - shared - (n_convs - 1) * above").alias("saved_tokens"),
            F.coalesce("ends_sha256", F.lit(hashlib.sha256(b"").hexdigest())).alias("ends_sha256"),
        )
    )


def _members(laid: DataFrame, nodes: DataFrame, size: int) -> DataFrame:
    """Per conversation: length, depth of the first node that it owns (beyond its length: none), ``host`` (owner of the node above that),
    ``shared`` (bytes of the path down to the host's node) and ``leaf`` (1 if it owns a childless node)."""
    tops = nodes.groupBy("conv_id").agg(
        F.min(F.struct("depth", "up_a", "up_b", "above")).alias("top"), F.max(F.when(F.col("n_children") == 0, 1).otherwise(0)).cast("long").alias("leaf")
    )
    ids = [f"t{i}" for i in range(size)]
    ends = laid.filter(f"block = floor(greatest(length - 1, 0) / {size})").selectExpr(
        "conv_id", "length", *[f"{c} ^ " + " ^ ".join(f"coalesce({t}.{c}, 0L)" for t in ids) + f" AS end_{c}" for c in ("a", "b")],
        "above + " + " + ".join(f"coalesce({t}.bytes, 0L)" for t in ids) + " AS total",
    )
    found = ends.join(tops, "conv_id", "left").selectExpr(
        "conv_id", "length", "coalesce(top.depth, length + 1) AS first", "coalesce(leaf, 0L) AS leaf", "IF(top IS NULL, total, top.above) AS shared",
        "IF(top IS NULL, end_a, top.up_a) AS a", "IF(top IS NULL, end_b, top.up_b) AS b",
    )
    hosts = nodes.select("a", "b", F.col("conv_id").alias("host"), F.col("n_convs").alias("members"))
    return join_spread(stored(found, "trie-ends"), hosts, ["a", "b"], "members").drop("a", "b")


def _ends(members: DataFrame) -> DataFrame:
    """``conv_id, depth, ends_sha256`` of every node where conversations end.

    Ids are first joined to strings by spans of neighbouring ids, in any number of tasks; what is left for one task are a
    node's strings, hashed as they stream by.
    """
    ended = members.select(F.expr("IF(first <= length, conv_id, host)").alias("node"), F.col("length").alias("depth"), "conv_id")
    strings = ended.groupBy("node", "depth", F.shiftright("conv_id", SPAN_BITS).alias("span")).agg(
        F.array_join(F.sort_array(F.collect_list("conv_id")), ",").alias("ids")
    )

    def run(batches):
        key, state = None, None
        for batch in batches:
            done = []
            for node, depth, ids in zip(*(batch.column(i).to_pylist() for i in (0, 1, 3))):
                if (node, depth) != key:
                    if key is not None:
                        done.append((*key, state.hexdigest()))
                    key, state = (node, depth), hashlib.sha256()
                else:
                    state.update(b",")
                state.update(ids.encode())
            yield _digests(done)
        if key is not None:
            yield _digests([(*key, state.hexdigest())])

    dealt = strings.repartition(partitions_for(members.count(), ENDS_PER_TASK, members), "node", "depth").sortWithinPartitions("node", "depth", "span")
    return dealt.mapInArrow(tidy(run), "conv_id long, depth long, ends_sha256 string")


def _digests(rows):
    columns = list(zip(*rows)) or [(), (), ()]
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.int64(), pa.string()))], names=["conv_id", "depth", "ends_sha256"])
