"""Prefix trie of conversations from padded matrices of turn ids.

A turn's id is 128 bits of SHA-256 over role and text, so matrices hold no text. Conversations
of equal turns are folded into one with its count first (a map task sends each once). The trie is
built a strip of depths at a time, each strip twice as wide as the one above: conversations of a
group, a node with several different sequences below it, are cut to the strip, equal cuts are
folded, and what is left is range-partitioned by group and ids into shards of bounded cells. A
shard is one padded matrix: numpy sorts it lexically; a column's change mask, OR-accumulated from
the left, marks where that depth's nodes start; reduceat over those starts sums every depth.
The last row of the shard before and the first of the one after, one row a shard, tell which
nodes go on across the border; only those are summed again, by a hash of their path. A sequence
that shares its prefix with no other is a plain chain from there on and enters no matrix. Strips
are worked off from the deepest, so that each hands the sums of its subtrees to the one above.

A task holds a matrix of bounded size, whatever repeats and however long a conversation is;
positions come from a global sort. Two things are done in one task for one node, streaming: the
digest of the ids that end at it, as SHA-256 reads them in order, and running sums along the chain
of a conversation that occurs more than once.

Defined results: rows without conv_id take no part; a NULL turn comes first, rows of one turn go
by their turn id, so do repeated rows, which are all kept; NULL role or text is empty; an empty
table has no nodes, not even a root; other columns are ignored, whatever their names.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from weft.operators.graph import with_dense_id
from weft.session import materialize, release

FIRST_WIDTH = 16
CELLS = 1 << 19  # of a shard's matrix
EMPTY_SHA = hashlib.sha256(b"").hexdigest()


def number_turns(conversations: DataFrame, id_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> tuple[DataFrame, DataFrame]:
    """Turns (conv, pos from 0, key, chars) in order and conversations (conv, length)."""
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in (role_col, text_col))
    key = F.unhex(F.substring(F.sha2(F.concat(F.length(role).cast("string"), F.lit(":"), role, text), 256), 1, 32))
    slim = conversations.select(F.col(id_col).cast("long").alias("conv"), F.col(turn_col).alias("turn"), key.alias("key"), F.length(text).cast("long").alias("chars"))
    # The last part of the order deals repeated rows, which are all alike.
    slim = slim.where("conv IS NOT NULL").withColumn("m", F.monotonically_increasing_id())
    placed = with_dense_id(slim, "g", "conv", F.col("turn").asc_nulls_first(), "key", "m")
    convs = materialize(placed.groupBy("conv").agg(F.min("g").alias("g0"), F.count(F.lit(1)).alias("length")))
    turns = placed.join(convs, "conv").select("conv", (F.col("g") - F.col("g0")).alias("pos"), "key", "chars")
    return materialize(turns), convs.select("conv", "length")


def graft_heads(turns: DataFrame, convs: DataFrame, every: int = 100, most: int = 6) -> tuple[DataFrame, DataFrame]:
    """Each conversation c with the first h turns of conversation c - c % every for its own first h; h is crc32(c) % most.

    Rows (conv, depth from 1, key, chars) and (conv, length), turnless conversations among the latter.
    """
    base = F.col("conv") - F.col("conv") % every
    h = F.crc32(F.col("conv").cast("string").cast("binary")) % most
    donors = convs.select(F.col("conv").alias("base"), F.col("length").alias("has"))
    plan = convs.withColumns({"base": base, "h": h}).join(donors, "base", "left")
    plan = plan.withColumn("k", F.least("h", F.coalesce("has", F.lit(0)))).withColumn("rest", F.greatest(F.col("length") - F.col("h"), F.lit(0)))
    plan = materialize(plan.select("conv", "base", "h", "k", (F.col("k") + F.col("rest")).alias("length")))
    own = turns.join(plan, "conv").where("pos >= h").select("conv", (F.col("pos") - F.col("h") + F.col("k") + 1).alias("depth"), "key", "chars")
    heads = turns.where((F.col("conv") % every == 0) & (F.col("pos") < most)).select(F.col("conv").alias("base"), "pos", "key", "chars")
    lent = plan.where("k > 0").join(heads, "base").where("pos < k").select("conv", (F.col("pos") + 1).alias("depth"), "key", "chars")
    return own.unionByName(lent), plan.select("conv", "length")


def _end_digests(members: DataFrame) -> DataFrame:
    """(rep, sha): SHA-256 of the ids (conv) of each rep, ascending, joined by commas."""

    def run(batches):
        rep, state, done = None, None, []
        for batch in batches:
            reps, ids = (np.asarray(c) for c in batch.columns)
            cuts = [0, *(np.flatnonzero(np.diff(reps)) + 1).tolist(), len(reps)]
            for a, b in zip(cuts[:-1], cuts[1:], strict=True):
                if b > a:
                    if reps[a] != rep:
                        if rep is not None:
                            done.append((rep, state.hexdigest()))
                        rep, state = int(reps[a]), hashlib.sha256()
                    else:
                        state.update(b",")
                    state.update(",".join(map(str, ids[a:b].tolist())).encode())
            if len(done) >= 10_000:
                yield out(done)
                done = []
        if rep is not None:
            yield out([*done, (rep, state.hexdigest())])

    def out(rows):
        return pa.RecordBatch.from_arrays([pa.array([r for r, _ in rows], pa.int64()), pa.array([s for _, s in rows])], ["rep", "sha"])

    alone = members.where("w = 1").select("rep", F.sha2(F.col("conv").cast("string").cast("binary"), 256).alias("sha"))
    several = members.where("w > 1").select("rep", "conv").repartition("rep").sortWithinPartitions("rep", "conv")
    return alone.unionByName(several.mapInArrow(run, "rep bigint, sha string"))


NODE = "depth bigint, conv bigint, parent bigint, gid bigint, n bigint, children bigint, leaves bigint, saved bigint, ender bigint, path binary, parent_path binary"


def _ids(keys: list[bytes]) -> np.ndarray:
    return np.frombuffer(b"".join(keys), ">u8").astype(np.uint64).reshape(-1, 2)


def strip_nodes(lo: int, gid, sizes, ids, chars, w, first, ender, below, before=None, after=None) -> list[np.ndarray]:
    """Columns of ``NODE`` for a shard of cut sequences, in any order.

    ``ids`` and ``chars`` are flat, ``sizes`` of each row; ``ender`` is -1 or the place in ``first``-like
    ids of the sequence that ends with the cut (masked array); ``below`` holds children, leaves and
    saved tokens under the cut's last node. ``before`` and ``after`` are the (gid, keys) of the
    neighbouring shards' nearest rows. Node column 0 is the group itself, without its own turn.
    """
    n, width = len(sizes), int(sizes.max())
    row = np.repeat(np.arange(n), sizes)
    col = np.arange(len(ids)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    matrix, length = np.zeros((n, width, 2), np.uint64), np.zeros((n, width), np.int64)
    matrix[row, col], length[row, col] = ids, chars
    order = np.lexsort([matrix[:, j, side] for j in range(width - 1, -1, -1) for side in (1, 0)] + [gid])
    matrix, length, gid, sizes, w, first = matrix[order], length[order], gid[order], sizes[order], w[order], first[order]
    ender, below = ender[order], [x[order] for x in below]

    def changed(g1, a, g2, b):
        """Where a node column differs between rows, OR-accumulated from the left."""
        diff = np.concatenate(((g1 != g2)[:, None], (a != b).any(2)), axis=1)
        return np.logical_or.accumulate(diff, axis=1)

    def against(other, at):
        if other is None:
            return np.ones(width + 1, bool)
        padded = np.zeros((1, width, 2), np.uint64)
        theirs = _ids(other[1])[:width]
        padded[0, : len(theirs)] = theirs
        return changed(np.array([other[0]]), padded, gid[at : at + 1], matrix[at : at + 1])[0]

    inner = changed(gid[1:], matrix[1:], gid[:-1], matrix[:-1])
    starts = np.concatenate((np.ones((1, width + 1), bool), inner))  # here
    fresh = np.concatenate((against(before, 0)[None], inner))  # in all shards
    last = against(after, n - 1)
    following = np.concatenate((inner, last[None]))
    longer = np.concatenate((sizes[1:], [len(after[1]) if after else 0])) > sizes
    extended = ~following[np.arange(n), sizes] & longer
    leaves = np.where(below[0] > 0, below[1], ~extended)
    left = np.concatenate((np.cumsum(length[:, ::-1], axis=1)[:, ::-1], np.zeros((n, 1), np.int64)), axis=1)
    new = np.where(fresh[:, 1:].any(1), fresh[:, 1:].argmax(1), width) if width else np.zeros(n, np.int64)

    def paths(at):
        h = hashlib.blake2b(int(gid[at]).to_bytes(8, "big", signed=True), digest_size=16)
        yield h.digest()
        for j in range(sizes[at]):
            h.update(matrix[at, j].tobytes())
            yield h.copy().digest()

    firsts, lasts = list(paths(0)), list(paths(n - 1))
    out, up, up_first, up_path = [], None, None, None
    for j in range(width + 1):
        at = np.flatnonzero(starts[:, j])
        t = max(j - 1, 0)
        told = w * left[:, t] - left[np.arange(n), np.maximum(t, new)] + below[2]
        kids = np.where(sizes == j, below[0], 0) if j == width else (fresh[:, j + 1] & (sizes > j)) + np.where(sizes == j, below[0], 0)
        sums = [np.add.reduceat(x.astype(np.int64), at) for x in (w, kids, leaves, told)]
        least = np.minimum.reduceat(first, at)
        path = np.full(len(at), None, object)
        if not fresh[0, j] and sizes[0] >= j:
            path[0] = firsts[j]
        if not last[j] and sizes[-1] >= j:
            path[-1] = lasts[j]
        real = sizes[at] >= j
        own = np.where((sizes[at] == j) & (j > 0), ender[at], None)
        parent, parent_path = (gid[at], np.full(len(at), None, object)) if j == 0 else (up_first[up[at]], up_path[up[at]])
        columns = [np.full(len(at), lo + j), least, parent, gid[at], *sums, own, path, parent_path]
        out.append([c[real] for c in columns])
        up, up_first, up_path = np.cumsum(starts[:, j]) - 1, least, path
    return [np.concatenate(c) for c in zip(*out, strict=True)]


def _strip(rows: DataFrame, lo: int, width: int) -> DataFrame:
    """Nodes of a strip from rows (gid, keys, chars, w, first, ender, children, leaves, saved), recombined across shards."""
    n, longest = rows.agg(F.count(F.lit(1)), F.max(F.size("keys"))).first()
    shards = max(1, -(-n * (longest or 0) // CELLS))
    dealt = materialize(rows.repartitionByRange(shards, "gid", "keys").withColumn("shard", F.spark_partition_id()))
    ends = dealt.groupBy("shard").agg(F.min(F.struct("gid", "keys")).alias("low"), F.max(F.struct("gid", "keys")).alias("high"))
    w = Window.orderBy("shard")  # one row a shard
    ends = ends.select("shard", F.lag("high").over(w).alias("before"), F.lead("low").over(w).alias("after"))
    kinds = {"bigint": pa.int64(), "binary": pa.binary()}
    names, types = zip(*(x.split() for x in NODE.split(", ")), strict=True)

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        keys, chars = left["keys"].combine_chunks(), left["chars"].combine_chunks()
        number = lambda c: left[c].combine_chunks().to_numpy(zero_copy_only=False)
        ender = np.array(left["ender"].to_pylist(), object)
        near = [right[c][0].as_py() for c in ("before", "after")]
        before, after = ((x["gid"], x["keys"]) if x else None for x in near)
        columns = strip_nodes(
            lo, number("gid"), np.diff(np.asarray(keys.offsets)), _ids(keys.flatten().to_pylist()), np.asarray(chars.flatten()),
            number("w"), number("first"), ender, [number(c) for c in ("children", "leaves", "saved")], before, after,
        )
        return pa.table([pa.array(c.tolist(), kinds[k]) for c, k in zip(columns, types, strict=True)], names=list(names))

    parts = materialize(dealt.groupBy("shard").cogroup(ends.groupBy("shard")).applyInArrow(run, NODE))
    release(dealt)
    across = parts.where("path IS NOT NULL").groupBy("depth", "path").agg(
        F.min("conv").alias("conv"), F.min("parent").alias("parent"), F.min("gid").alias("gid"),
        *[F.sum(c).alias(c) for c in ("n", "children", "leaves", "saved")], F.min("ender").alias("ender"), F.min("parent_path").alias("parent_path"),
    )
    across = materialize(across)
    whole = parts.where("path IS NULL").unionByName(across)
    named = across.select(F.col("path").alias("parent_path"), (F.col("depth") + 1).alias("depth"), F.col("conv").alias("_conv"))
    under = whole.where("parent_path IS NOT NULL").join(named, ["parent_path", "depth"]).withColumn("parent", F.col("_conv")).drop("_conv")
    out = materialize(whole.where("parent_path IS NULL").unionByName(under).drop("path", "parent_path"))
    release(parts, across)
    return out


def trie(turns: DataFrame, convs: DataFrame, first_width: int = FIRST_WIDTH) -> DataFrame:
    """A row per node (conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256).

    ``turns``: (conv, depth from 1, key, chars); ``convs``: (conv, length), turnless ones too. A node is
    named by the smallest conversation that starts with it. ``saved_tokens`` counts code points.
    """
    spark = turns.sparkSession
    turns = materialize(turns.select("conv", F.col("depth").cast("long").alias("depth"), "key", "chars"))
    marks = turns.groupBy("conv").agg(F.bit_xor(F.xxhash64("depth", "key")).alias("a"), F.bit_xor(F.xxhash64("key", "depth", F.lit(1))).alias("b"))
    named = materialize(convs.join(marks, "conv", "left").select("conv", "length", F.coalesce("a", F.lit(0)).alias("a"), F.coalesce("b", F.lit(0)).alias("b")))
    same = ["length", "a", "b"]
    groups = materialize(named.groupBy(*same).agg(F.min("conv").alias("rep"), F.count(F.lit(1)).alias("w")))
    ends = materialize(_end_digests(named.join(groups, same).select("rep", "w", "conv")))
    total = groups.agg(F.sum("w"), F.min("rep"), F.min(F.when(F.col("length") == 0, F.col("rep")))).first()
    if total[0] is None:
        return spark.createDataFrame([], "conv_id bigint, depth bigint, parent_conv_id bigint, n_convs bigint, n_children bigint, n_leaves bigint, saved_tokens bigint, ends_sha256 string")
    turns = turns.withColumnRenamed("conv", "rep")
    alive = groups.where("length > 0").select("rep", "w", "length", F.lit(0).cast("long").alias("gid"))
    chains, levels, lo, width = [], [], 0, first_width
    while alive.limit(1).count():
        hi = lo + width
        here = turns.where((F.col("depth") > lo) & (F.col("depth") <= hi)).join(alive, "rep")
        cut = here.groupBy("rep", "w", "length", "gid").agg(F.array_sort(F.collect_list(F.struct("depth", "key", "chars"))).alias("s"))
        cut = cut.select("rep", "w", "length", "gid", F.col("s.key").alias("keys"), F.col("s.chars").alias("chars"))
        cut = materialize(cut.withColumns({"a": F.xxhash64("keys"), "b": F.xxhash64(F.lit(1), "keys")}))
        same = ["gid", "a", "b"]
        folded = materialize(
            cut.groupBy(*same).agg(
                F.sum("w").alias("w"), F.min("rep").alias("first"), F.count(F.lit(1)).alias("different"), F.max("length").alias("longest"),
                F.min(F.when(F.col("length") <= hi, F.col("rep"))).alias("ender"), F.first("keys").alias("keys"), F.first("chars").alias("chars"),
            )
        )
        on = cut.where(F.col("length") > hi).select("rep", "w", "length", *same).join(folded.select(*same, "first", "different"), same)
        alone = materialize(on.where("different = 1").select("rep", "w", "length"))
        alive = materialize(on.where("different > 1").select("rep", "w", "length", F.col("first").alias("gid")))
        release(cut)
        chains.append((alone, hi))
        levels.append((folded, lo, hi))
        lo, width = hi, 2 * width

    found, below = [], None
    for (folded, lo, hi), (alone, _) in zip(reversed(levels), reversed(chains), strict=True):
        tail = turns.where(F.col("depth") > hi).join(alone.where("w > 1"), "rep").groupBy("rep").agg(F.sum((F.col("w") - 1) * F.col("chars")).alias("saved"))
        sums = alone.join(tail, "rep", "left").select(F.col("rep").alias("first"), F.lit(1).cast("long").alias("children"), F.lit(1).cast("long").alias("leaves"), F.coalesce("saved", F.lit(0)).alias("saved"))
        if below is not None:
            sums = sums.unionByName(below)
        rows = folded.join(sums, "first", "left").fillna(0, ["children", "leaves", "saved"])
        nodes = _strip(rows.select("gid", "keys", "chars", "w", "first", "ender", "children", "leaves", "saved"), lo, hi - lo)
        at_group = F.col("depth") == lo
        below = nodes.where(at_group).select(F.col("gid").alias("first"), "children", "leaves", "saved")
        top = F.lit(total[1]) if lo == 0 else F.col("gid")
        found.append(nodes.where(~at_group).withColumn("parent", F.when(F.col("depth") == lo + 1, top).otherwise(F.col("parent"))).drop("gid"))
    for alone, hi in chains:
        chain = turns.where(F.col("depth") > hi).join(alone, "rep")
        running = Window.partitionBy("rep").orderBy(F.desc("depth"))
        once = chain.where("w = 1").withColumn("saved", F.lit(0).cast("long"))
        often = chain.where("w > 1").withColumn("saved", (F.col("w") - 1) * F.sum("chars").over(running))
        for part in (once, often):
            found.append(part.select(
                "depth", F.col("rep").alias("conv"), F.col("rep").alias("parent"), F.col("w").alias("n"), (F.col("depth") < F.col("length")).cast("long").alias("children"),
                F.lit(1).cast("long").alias("leaves"), "saved", F.when(F.col("depth") == F.col("length"), F.col("rep")).alias("ender"),
            ))
    n, smallest, turnless = total
    root = spark.createDataFrame([(0, smallest, None, n, turnless)], "depth bigint, conv bigint, parent bigint, n bigint, ender bigint")
    sums = (below if below is not None else spark.createDataFrame([], "first bigint, children bigint, leaves bigint, saved bigint")).drop("first")
    root = root.join(F.broadcast(sums), F.lit(True), "left").select("depth", "conv", "parent", "n", F.coalesce("children", F.lit(0)).alias("children"), F.coalesce("leaves", F.lit(1)).alias("leaves"), F.coalesce("saved", F.lit(0)).alias("saved"), "ender")
    nodes = root
    for part in found:
        nodes = nodes.unionByName(part)
    ended = nodes.where("ender IS NOT NULL").join(ends, F.col("ender") == F.col("rep")).drop("rep")
    nodes = nodes.where("ender IS NULL").withColumn("sha", F.lit(EMPTY_SHA)).unionByName(ended)
    return nodes.select(
        F.col("conv").alias("conv_id"), "depth", F.col("parent").alias("parent_conv_id"), F.col("n").alias("n_convs"), F.col("children").alias("n_children"),
        F.col("leaves").alias("n_leaves"), F.col("saved").alias("saved_tokens"), F.col("sha").alias("ends_sha256"),
    )
