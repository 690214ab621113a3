"""The prefix trie of conversations, with sums over subtrees by heavy-path decomposition.

Turns are numbered in their conversation (by turn, null first; equal turns by role, then by SHA-256 of role and text), and a running
127-bit hash over the turns names the node that each conversation reaches with each turn; the empty root is named by zeros. Of a node's
children the one with most members is heavy (ties: the smallest conv_id), the others are light and begin paths of their own, so a walk
from the root meets at most log2(members) light nodes. A walk along each conversation gives every node its path, where that path hangs,
and its level (light nodes above). Path totals go up level by level: each round sums up the paths of one level and adds them to the paths
they hang on, whatever their number. At last one suffix sum along each path, with what hangs on it, gives the sums of every subtree.

Conversations, paths and the members that end at a node may be of any size: running values go along ranges of sorted rows (scan.running),
and groups are summed before they are shuffled. Null role or text is empty; rows with a null conv_id belong to no conversation and have no
node; repeated rows are turns of their own; other columns are ignored. A table without conversations has no node, not even a root.
"""

from __future__ import annotations

import hashlib

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut
from .scan import running

ROOT = bytes(16)
_P, _R = (1 << 127) - 1, 0x5851F42D4C957F2D14057B7EF767814F
#: Bytes of conv_ids in one row of members that end at a node.
BLOB = 1 << 16


def _count(value, row):
    return value + 1


def numbered(conversations: DataFrame) -> DataFrame:
    """conv_id, pos (from 1), key (SHA-256 of role and text), size (UTF-8 bytes of the text) of every turn."""
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("role", "text"))
    key = F.unhex(F.sha2(F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text).cast("binary"), 256))
    turns = conversations.where("conv_id is not null").select(F.col("conv_id").cast("long").alias("conv_id"), "turn", role.alias("role"), key.alias("key"), F.octet_length(text).cast("long").alias("size"))
    give = lambda before, after, row: (row[0], after, row[3], row[4])
    return cut(running(turns, ["conv_id"], [F.col("turn").asc_nulls_first(), F.col("role"), F.col("key")], 0, _count, lambda a, b: a + b, give, "conv_id long, pos long, key binary, size long"))


def opening(conv_id, longest: int) -> F.Column:
    return F.crc32(conv_id.cast("string").cast("binary")) % longest


def rebuilt(turns: DataFrame, every: int = 5, longest: int = 9) -> DataFrame:
    """conv_id, part, pos, key, size, origin: each conversation c with the first h turns of conversation c - c % every in place of its own first h.

    h is crc32(c) % longest; without that other conversation there is no opening. The order is by part, then pos.
    """
    convs = turns.select("conv_id").distinct()
    heads = convs.select(F.col("conv_id").alias("c"), (F.col("conv_id") - F.col("conv_id") % every).alias("conv_id"), opening(F.col("conv_id"), longest).alias("h"))
    shared = turns.where(F.col("pos") < longest).join(heads, "conv_id").where("pos <= h").select(F.col("c").alias("conv_id"), F.lit(0).alias("part"), "pos", "key", "size", F.col("conv_id").alias("origin"))
    own = turns.where(F.col("pos") > opening(F.col("conv_id"), longest)).select("conv_id", F.lit(1).alias("part"), "pos", "key", "size", F.col("conv_id").alias("origin"))
    return shared.union(own)


def _reach(value, row):
    return value[0] + 1, (value[1] * _R + int.from_bytes(row[3][:16], "big")) % _P


def _reach_on(a, b):
    return a[0] + b[0], (a[1] * pow(_R, b[0], _P) + b[1]) % _P


def _walk(value, row):
    """value: path, the path and depth it hangs at, light nodes so far, the last node's conv_id; row: conv_id, depth, node, heavy, owner."""
    path, up, at, level, _ = value
    return (path, up, at, level, row[4]) if row[3] else (row[2], path, row[1] - 1, level + 1, row[4])


def _walk_on(a, b):
    level = a[3] + b[3]
    if not b[3]:
        return (*a[:3], level, b[4] if b[4] is not None else a[4])
    return (b[0], a[0] if b[3] == 1 else b[1], b[2], level, b[4])


def prefix_trie(turns: DataFrame, convs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Nodes and the members that end at them, from turns (conv_id, part, pos, key, size, origin) and all conv_ids.

    Nodes: node, conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, and the turn (origin, pos) its last text is
    found at; ends: node, conv_id.
    """
    convs = convs.select("conv_id").where("conv_id is not null").distinct()
    name = lambda h: h.to_bytes(16, "big")
    give = lambda before, after, row: (row[0], after[0], name(after[1]), name(before[1]), row[4], row[5], row[2])
    rows = running(turns.select("conv_id", "part", "pos", "key", "size", "origin"), ["conv_id"], [F.col("part"), F.col("pos")], (0, 0), _reach, _reach_on, give, "conv_id long, depth long, node binary, parent binary, size long, origin long, pos long")
    rows = cut(rows)
    root = convs.agg(F.min("conv_id").alias("conv_id"), F.count("*").alias("n_convs")).where("n_convs > 0")
    first = F.min(F.struct("conv_id", "origin", "pos"))
    nodes = rows.groupBy("node").agg(first.alias("f"), F.count("*").alias("n_convs"), F.min("depth").alias("depth"), F.min("parent").alias("parent"), F.min("size").alias("size"))
    nodes = nodes.select("node", "f.conv_id", "f.origin", "f.pos", "n_convs", "depth", "parent", "size")
    nodes = cut(nodes.union(root.select(F.lit(ROOT), "conv_id", F.lit(None).cast("long"), F.lit(None).cast("long"), "n_convs", F.lit(0), F.lit(None).cast("binary"), F.lit(0))))
    kids = nodes.where("parent is not null").groupBy("parent").agg(F.count("*").alias("n_children"), F.max(F.struct("n_convs", -F.col("conv_id"), "node")).alias("most")).select("parent", "n_children", "most.node")
    marks = kids.select(F.col("parent").alias("node"), "n_children", F.lit(None).cast("boolean").alias("heavy")).union(kids.select("node", F.lit(None).cast("long"), F.lit(True)))
    none = lambda *cs: [F.lit(None).cast(nodes.schema[c].dataType).alias(c) for c in cs]
    others = [c for c in nodes.columns if c != "node"]
    every = nodes.select("node", *others, F.lit(None).cast("long").alias("n_children"), F.lit(None).cast("boolean").alias("heavy")).union(marks.select("node", *none(*others), "n_children", "heavy"))
    nodes = cut(every.groupBy("node").agg(*(F.max(c).alias(c) for c in (*others, "n_children", "heavy"))))

    seen = rows.select("conv_id", "depth", "node").join(nodes.select("node", F.col("heavy").isNotNull().alias("heavy"), F.col("conv_id").alias("owner")), "node").select("conv_id", "depth", "node", "heavy", "owner")
    give = lambda before, after, row: (row[2], *after[:4], before[4]) if row[0] == row[4] else None
    placed = running(seen, ["conv_id"], [F.col("depth")], (ROOT, b"", -1, 0, None), _walk, _walk_on, give, "node binary, path binary, up binary, up_depth long, level long, parent_conv_id long")
    top = root.select(F.lit(ROOT).alias("node"), F.lit(ROOT).alias("path"), F.lit(b"").alias("up"), F.lit(-1).cast("long").alias("up_depth"), F.lit(0).cast("long").alias("level"), F.lit(None).cast("long").alias("parent_conv_id"))
    least = root.select("conv_id").first()
    tree = placed.union(top).join(nodes.drop("heavy", "parent"), "node").withColumn("parent_conv_id", F.when(F.col("depth") > 0, F.coalesce("parent_conv_id", F.lit(least["conv_id"] if least else None).cast("long"))))
    tree = tree.withColumn("n_children", F.coalesce("n_children", F.lit(0))).withColumn("leaves", (F.col("n_children") == 0).cast("long")).withColumn("saved", (F.col("n_convs") - 1) * F.col("size"))
    tree = cut(tree)

    # totals of paths, from the deepest level to the root's path
    head = F.max(F.when(F.col("node") == F.col("path"), F.struct("level", "up", "up_depth")))
    sums = lambda: (F.sum("leaves").alias("leaves"), F.sum("saved").alias("saved"))
    paths = cut(tree.groupBy("path").agg(head.alias("h"), *sums()).select("path", "h.level", "h.up", "h.up_depth", "leaves", "saved"))
    deepest = paths.agg(F.max("level").alias("m")).first()["m"] or 0
    hung, from_below = None, None
    for level in range(deepest, 0, -1):
        now = paths.where(F.col("level") == level).select("path", "up", "up_depth", "leaves", "saved")
        if from_below is not None:
            now = now.unionByName(from_below.select("path", F.lit(None).cast("binary").alias("up"), F.lit(None).cast("long").alias("up_depth"), "leaves", "saved")).groupBy("path").agg(F.max("up").alias("up"), F.max("up_depth").alias("up_depth"), *sums())
        here = cut(now.groupBy(F.col("up").alias("path"), F.col("up_depth").alias("depth")).agg(*sums()))
        from_below = here.select("path", "leaves", "saved")
        hung = here if hung is None else hung.union(here)
    places = tree.select("path", "depth", "leaves", "saved", "node", "conv_id", "parent_conv_id", "n_convs", "n_children", "origin", "pos")
    if hung is not None:
        places = places.join(hung.select("path", "depth", F.col("leaves").alias("l"), F.col("saved").alias("s")), ["path", "depth"], "left")
        places = places.withColumn("leaves", F.col("leaves") + F.coalesce("l", F.lit(0))).withColumn("saved", F.col("saved") + F.coalesce("s", F.lit(0))).drop("l", "s")
    give = lambda before, after, r: (r[4], r[5], r[1], r[6], r[7], r[8], after[0], after[1], r[9], r[10])
    schema = "node binary, conv_id long, depth long, parent_conv_id long, n_convs long, n_children long, n_leaves long, saved_tokens long, origin long, pos long"
    out = running(places, ["path"], [F.col("depth").desc()], (0, 0), lambda v, r: (v[0] + r[2], v[1] + r[3]), lambda a, b: (a[0] + b[0], a[1] + b[1]), give, schema)

    last = rows.groupBy("conv_id").agg(F.max(F.struct("depth", "node")).alias("l")).select("conv_id", "l.node").union(convs.select("conv_id", F.lit(None).cast("binary")))
    ends = last.groupBy("conv_id").agg(F.coalesce(F.max("node"), F.lit(ROOT)).alias("node")).select("node", "conv_id")
    return out, ends


def ends_digest(ends: DataFrame) -> DataFrame:
    """node, ends_sha256: SHA-256 of the decimal conv_ids that end at a node, ascending and comma-joined.

    Ranges of a node's conv_ids are joined to pieces of at most BLOB bytes first, so what is hashed in order is a few rows, read one by one.
    """

    def join(batches):
        node, first, parts, size = None, 0, [], 0
        done: list = []

        def close():
            if parts:
                done.append((node, first, ",".join(parts)))

        for b in batches:
            for n, c in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                if n != node or size > BLOB:
                    close()
                    node, first, parts, size = n, c, [], 0
                parts.append(str(c))
                size += len(parts[-1]) + 1
            yield give(done)
            done.clear()
        close()
        yield give(done)

    def give(done):
        return pa.RecordBatch.from_arrays([pa.array([d[0] for d in done], pa.binary()), pa.array([d[1] for d in done], pa.int64()), pa.array([d[2] for d in done], pa.string())], names=["node", "first", "ids"])

    def digest(batches):
        node, state, done = None, None, []
        for b in batches:
            for n, ids in zip(b.column(0).to_pylist(), b.column(2).to_pylist()):
                if n == node:
                    state.update(b",")
                else:
                    if node is not None:
                        done.append((node, state.hexdigest()))
                    node, state = n, hashlib.sha256()
                state.update(ids.encode())
            yield pa.RecordBatch.from_arrays([pa.array([d[0] for d in done], pa.binary()), pa.array([d[1] for d in done], pa.string())], names=["node", "ends_sha256"])
            done = []
        if node is not None:
            yield pa.RecordBatch.from_arrays([pa.array([node], pa.binary()), pa.array([state.hexdigest()], pa.string())], names=["node", "ends_sha256"])

    pieces = ends.select("node", "conv_id").repartitionByRange("node", "conv_id").sortWithinPartitions("node", "conv_id").mapInArrow(join, "node binary, first long, ids string")
    return pieces.repartition("node").sortWithinPartitions("node", "first").mapInArrow(digest, "node binary, ends_sha256 string")


def last_turns(nodes: DataFrame, conversations: DataFrame) -> DataFrame:
    """Nodes with the role and text of their last turn (null at the root)."""
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("role", "text"))
    key = F.unhex(F.sha2(F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text).cast("binary"), 256))
    texts = conversations.where("conv_id is not null").select(F.col("conv_id").cast("long").alias("origin"), key.alias("key"), role.alias("role"), text.alias("text")).distinct()
    keys = numbered(conversations).select(F.col("conv_id").alias("origin"), "pos", "key")
    return nodes.join(keys, ["origin", "pos"], "left").join(texts, ["origin", "key"], "left").drop("key", "origin", "pos")
