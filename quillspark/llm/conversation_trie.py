"""The trie of conversations: what prefixes they share, and what sharing them saves.

A node is a distinct sequence of first turns (role, text), known by a digest of 128
bits. Digests of all prefixes, and then the sums over all subtrees, come by doubling:
in round k a turn's digest takes in the 2^k turns before it, and a node sends its sums
to its ancestor 2^k levels up and points on to that one's ancestor. Rounds are as
many as the deepest conversation's length has bits, and rows that are done leave them.

No conversation and no node is held as a whole: turns are numbered over a range
partitioning that cuts long conversations, only keys that are unique, or sums, meet in
joins and aggregates, but for pointers to a common ancestor, whose side the adaptive
join splits; ids of a node's members are joined to blocks first, and one task then
digests these one after another.

Turns are ordered by their number, null first, then by the digest of role and text. A
null role or text counts as empty. Rows without a conversation's id belong to none and
are left out; repeated rows are turns of their own. Other columns don't matter, an
empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialise

#: Conversations whose first turns are shared, and one more than the turns shared at most.
GROUP, CYCLE = 100, 6
#: Ids of members that a block holds.
BLOCK = 8192
ROOT = bytes(16)
NO_ENDS = hashlib.sha256(b"").hexdigest()


def _digest(value: Column) -> Column:
    return F.unhex(F.substring(F.sha2(value, 256), 1, 32))


# -- turns in their places ----------------------------------------------------


def _numbered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by conversation with their task and their number among the task's rows of the conversation."""
    part, last, n = TaskContext.get().partitionId(), None, 0
    for batch in batches:
        ids = batch.column(0).to_numpy()
        if not len(ids):
            continue
        starts = np.flatnonzero(np.r_[True, ids[1:] != ids[:-1]])
        sizes = np.diff(np.r_[starts, len(ids)])
        local = np.arange(1, len(ids) + 1) - np.repeat(starts, sizes)
        if ids[0] == last:
            local[: sizes[0]] += n
        last, n = ids[-1], int(local[-1])
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(np.full(len(ids), part), pa.int32()), pa.array(local, pa.int64())], ["conv_id", "digest", "chars", "part", "local"])


def turns(df: DataFrame) -> DataFrame:
    """A materialised table of conv_id, digest, chars (code points of the text), part, local; pos is the turn's number.

    Of each task's rows only the first and last conversation can go on in another
    task, so what must be added to a number follows from one row a task.
    """
    role, text = (F.coalesce(F.col(c), F.lit("")) for c in ("role", "text"))
    digest = _digest(F.concat(F.length(role).cast("string"), F.lit(":"), role, text))
    rows = df.filter("conv_id IS NOT NULL").select(F.col("conv_id").cast("long"), F.col("turn"), digest.alias("digest"), F.length(text).cast("long").alias("chars"), F.monotonically_increasing_id().alias("row"))
    order = [F.col("conv_id"), F.col("turn").asc_nulls_first(), F.col("digest"), F.col("row")]
    dealt = rows.repartitionByRange(*order).sortWithinPartitions(*order).select("conv_id", "digest", "chars")
    held = materialise(dealt.mapInArrow(_numbered, "conv_id long, digest binary, chars long, part int, local long"), "trie-turns")
    ends = held.groupBy("part").agg(F.min("conv_id").alias("first"), F.max(F.struct("conv_id", "local")).alias("last")).orderBy("part").collect()
    before, last, n = [], None, 0
    for r in ends:
        earlier = n if r["first"] == last else 0
        if earlier:
            before.append((r["part"], r["first"], earlier))
        last, n = r["last"]["conv_id"], r["last"]["local"] + (earlier if r["last"]["conv_id"] == r["first"] else 0)
    added = F.broadcast(df.sparkSession.createDataFrame(before, "part int, conv_id long, earlier long"))  # a row a task at most
    return held.join(added, ["part", "conv_id"], "left").select("*", (F.col("local") + F.coalesce("earlier", F.lit(0))).alias("pos"))


def plain(df: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Conversations as they stand: rows of turns, and conversations with their length."""
    placed = turns(df)
    sizes = placed.groupBy("conv_id").agg(F.max("pos").alias("length"))
    firsts = placed.filter("local = 1").select("part", "conv_id").join(sizes, "conv_id")
    rows = placed.join(firsts, ["part", "conv_id"]).select("conv_id", F.col("pos").alias("depth"), "digest", "chars", "length")
    return materialise(rows, "trie-rows"), materialise(sizes, "trie-conversations")


def rebuilt(df: DataFrame, group: int = GROUP, cycle: int = CYCLE) -> tuple[DataFrame, DataFrame]:
    """Conversations that begin with h turns of the first of their group, in place of their own first h.

    h is the id's checksum modulo ``cycle``; of a group's first conversation
    that has fewer turns all are taken, of one that isn't there none.
    """
    placed = turns(df)
    heads = placed.filter((F.col("conv_id") % group == 0) & (F.col("pos") < cycle)).select(F.col("conv_id").alias("base"), F.col("pos").alias("depth"), "digest", "chars")
    h, base = F.crc32(F.col("conv_id").cast("string")) % cycle, F.col("conv_id") - F.col("conv_id") % group
    sizes = placed.groupBy("conv_id").agg(F.max("pos").alias("own")).select("conv_id", "own", h.alias("h"), base.alias("base"))
    given = F.least("h", F.coalesce("there", F.lit(0)))
    convs = sizes.join(heads.groupBy("base").agg(F.max("depth").alias("there")), "base", "left").withColumn("given", given)
    convs = materialise(convs.withColumn("length", F.col("given") + F.greatest(F.col("own") - F.col("h"), F.lit(0))).drop("there"), "trie-conversations")
    taken = convs.filter("given > 0").join(heads, "base").filter("depth <= given").select("conv_id", "depth", "digest", "chars", "length")
    # A task has one first row of each of its conversations, so no key here is frequent.
    firsts = placed.filter("local = 1").select("part", "conv_id").join(convs, "conv_id")
    kept = placed.join(firsts, ["part", "conv_id"]).filter("pos > h").select("conv_id", (F.col("pos") - F.col("h") + F.col("given")).alias("depth"), "digest", "chars", "length")
    return materialise(taken.union(kept), "trie-rows"), convs.select("conv_id", "length")


# -- nodes ---------------------------------------------------------------------


def prefixes(rows: DataFrame, deepest: int) -> DataFrame:
    """``rows`` with the digest of all turns up to each, in place of its own."""
    done, reach = [rows.filter("length <= 1")], 1
    while reach < deepest:
        live = rows.filter(F.col("length") > reach)
        earlier = live.select("conv_id", (F.col("depth") + reach).alias("depth"), F.col("digest").alias("earlier"))
        longer = F.when(F.col("earlier").isNull(), F.col("digest")).otherwise(_digest(F.concat("earlier", "digest")))
        rows = materialise(live.join(earlier, ["conv_id", "depth"], "left").select("conv_id", "depth", longer.alias("digest"), "chars", "length"), "trie-prefixes")
        reach *= 2
        done.append(rows.filter(F.col("length") <= reach))
    for part in done[1:]:
        done[0] = done[0].union(part)
    return done[0]


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Members of a node, sorted, joined in blocks of BLOCK ids."""
    node, ids = None, []
    rows: list[tuple[bytes, int, str]] = []
    for batch in batches:
        for d, c in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            if d != node or len(ids) == BLOCK:
                if ids:
                    rows.append((node, ids[0], ",".join(map(str, ids))))
                node, ids = d, []
            ids.append(c)
        if len(rows) >= 1024:
            yield _as_batch(rows)
            rows = []
    if ids:
        rows.append((node, ids[0], ",".join(map(str, ids))))
    if rows:
        yield _as_batch(rows)


def _as_batch(rows: list[tuple[bytes, int, str]]) -> pa.RecordBatch:
    d, first, text = zip(*rows, strict=True)
    return pa.RecordBatch.from_arrays([pa.array(d, pa.binary()), pa.array(first, pa.int64()), pa.array(text, pa.string())], ["digest", "first", "ids"])


def _hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The digest of each node's blocks, which follow one another."""
    node, state = None, hashlib.sha256()
    for batch in batches:
        found: list[tuple[bytes, str]] = []
        for d, text in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist(), strict=True):
            if d != node:
                if node is not None:
                    found.append((node, state.hexdigest()))
                node, state = d, hashlib.sha256(text.encode())
            else:
                state.update(f",{text}".encode())
        yield pa.RecordBatch.from_arrays([pa.array([d for d, _ in found], pa.binary()), pa.array([x for _, x in found], pa.string())], ["digest", "ends_sha256"])
    if node is not None:
        yield pa.RecordBatch.from_arrays([pa.array([node], pa.binary()), pa.array([state.hexdigest()], pa.string())], ["digest", "ends_sha256"])


def ends(found: DataFrame, convs: DataFrame) -> DataFrame:
    """(digest, ends_sha256) of the nodes that conversations end at: their ids, ascending, joined by commas."""
    last = found.filter("depth = length").select("digest", "conv_id").union(convs.filter("length = 0").select(F.lit(ROOT), "conv_id"))
    blocks = last.repartitionByRange("digest", "conv_id").sortWithinPartitions("digest", "conv_id").mapInArrow(_blocks, "digest binary, first long, ids string")
    return blocks.repartition("digest").sortWithinPartitions("digest", "first").mapInArrow(_hashed, "digest binary, ends_sha256 string")


def nodes(found: DataFrame, convs: DataFrame) -> DataFrame:
    """A materialised table of all nodes: digest, up (the parent's digest, null above the root), depth, conv_id, parent_conv_id, n_convs, n_children, n_leaves (1 if childless) and saved_tokens of the node alone."""
    each = found.groupBy("digest", "depth").agg(F.min("conv_id").alias("conv_id"), F.count("*").alias("n_convs"), F.max("chars").alias("chars"))
    above = found.select("conv_id", (F.col("depth") + 1).alias("depth"), F.col("digest").alias("up"))
    linked = each.filter("depth > 1").join(above, ["conv_id", "depth"]).select("digest", "up", "depth", "conv_id", "n_convs", "chars")
    first = each.filter("depth = 1").select("digest", F.lit(ROOT).alias("up"), "depth", "conv_id", "n_convs", "chars")
    root = convs.agg(F.min("conv_id").alias("conv_id"), F.count("*").alias("n_convs")).filter("n_convs > 0")
    root = root.select(F.lit(ROOT).alias("digest"), F.lit(None).cast("binary").alias("up"), F.lit(0).cast("long").alias("depth"), "conv_id", "n_convs", F.lit(0).cast("long").alias("chars"))
    known = materialise(linked.union(first).union(root), "trie-edges")
    children = known.filter("up IS NOT NULL").groupBy(F.col("up").alias("digest")).agg(F.count("*").alias("n_children"))
    parents = known.select(F.col("digest").alias("up"), F.col("conv_id").alias("parent_conv_id"))
    # All first turns point to the root: its one id is a value, not a side of a join.
    top = known.filter("depth = 0").first()
    least = F.lit(top["conv_id"] if top else None).cast("long")
    by_depth = (known.filter("depth > 1").join(parents, "up"), known.filter("depth = 1").withColumn("parent_conv_id", least), known.filter("depth = 0").withColumn("parent_conv_id", F.lit(None).cast("long")))
    both = by_depth[0].unionByName(by_depth[1]).unionByName(by_depth[2]).join(children, "digest", "left")
    count = F.coalesce("n_children", F.lit(0))
    return materialise(both.select("digest", "up", "depth", "conv_id", "parent_conv_id", "n_convs", count.alias("n_children"), (count == 0).cast("long").alias("n_leaves"), ((F.col("n_convs") - 1) * F.col("chars")).alias("saved_tokens")), "trie-nodes")


def rolled_up(state: DataFrame, deepest: int) -> DataFrame:
    """``state`` (of ``nodes``) with n_leaves and saved_tokens summed over each node's subtree.

    Before the round of reach r, a node's sums are those of descendants less than r
    levels below, and up points r levels up. A node that no one is r levels below, and
    that is less than 2r levels deep, gets and gives nothing more.
    """
    done, reach = [], 1
    while reach <= deepest:
        sums = state.filter("up IS NOT NULL").groupBy(F.col("up").alias("digest")).agg(F.sum("n_leaves").alias("leaves"), F.sum("saved_tokens").alias("saved"))
        summed = state.join(sums, "digest", "left").withColumns({
            "n_leaves": F.col("n_leaves") + F.coalesce("leaves", F.lit(0)),
            "saved_tokens": F.col("saved_tokens") + F.coalesce("saved", F.lit(0)),
            "live": F.col("leaves").isNotNull() | (F.col("depth") >= 2 * reach),
        }).drop("leaves", "saved")
        ancestors = state.filter(F.col("depth") > reach).select(F.col("digest").alias("up"), F.col("up").alias("next"))
        far = summed.filter(F.col("depth") > 2 * reach).join(ancestors, "up")
        near = summed.filter(F.col("depth") <= 2 * reach).withColumn("next", F.when(F.col("depth") == 2 * reach, F.lit(ROOT)))
        fresh = far.unionByName(near).withColumn("up", F.col("next")).drop("next")
        fresh = materialise(fresh, "trie-sums")
        done.append(fresh.filter("NOT live").drop("live"))
        state = fresh.filter("live").drop("live")
        reach *= 2
    for part in done:
        state = state.unionByName(part)
    return state


def trie(rows: DataFrame, convs: DataFrame) -> DataFrame:
    """A row for each node of the conversations ``convs`` (conv_id, length) with turns ``rows``.

    conv_id (the smallest member), depth, parent_conv_id, n_convs, n_children,
    n_leaves, saved_tokens and ends_sha256, the digest of the members that end there.
    """
    deepest = convs.agg(F.max("length")).first()[0] or 0
    found = prefixes(rows, deepest)
    ended = materialise(ends(found, convs), "trie-ends")
    known = rolled_up(nodes(found, convs), deepest)
    out = known.join(ended, "digest", "left")
    return out.select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", F.coalesce("ends_sha256", F.lit(NO_ENDS)).alias("ends_sha256"))


def rebuilt_trie(df: DataFrame) -> DataFrame:
    """The trie of the rebuilt conversations."""
    return trie(*rebuilt(df))


def conversation_trie(df: DataFrame) -> DataFrame:
    """The trie of the conversations as they stand."""
    return trie(*plain(df))
