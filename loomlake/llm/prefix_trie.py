"""Prefix trie of conversations: double arrays for shards of prefixes, merged by prefix hash.

A conversation is cut into segments of consecutive turns. A segment lies under the node where it begins; equal segments under
one node are one row with sums over their conversations. Segments go to shards by that node and their first turn,
and those of very frequent beginnings to several shards. A shard packs its segments into a double array: turns get
dense ids, a node's children lie at BASE[node] + id, and CHECK tells whose child a cell is. A pass over the segments
sums their weights into the cells, and the cells are the nodes. A node is named by its depth and a 128-bit hash that extends
its parent's, so the nodes that several shards share, those above their prefixes, meet again in one global sum.

Sums over subtrees need no walk up the trie. All members of a node begin alike, so what they hold below it is their total less
the same prefix for each; and a node belongs to its least member, whose own nodes are the end of its path, so
sums over different nodes are sums over members too. The second pass has these weights.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window, functions as F

from loomlake.llm.common import small_side
from loomlake.llm.runs import arrow_schema, blocks, map_stream, ranged
from loomlake.session import materialize

#: Turns in a segment, and turns that a shard holds about: bounds of a task's memory.
SEGMENT, SHARD = 64, 2048


# ---------------------------------------------------------------- the double array of a shard


def pack(paths: list[np.ndarray], symbols: int) -> tuple[np.ndarray, np.ndarray]:
    """(BASE, CHECK) of a trie over ``paths``, sorted and different, of ids from 1 to ``symbols``. Cell 0 is the root.

    Nodes are placed level by level; the children of one go to the first base at which all their cells are free.
    """
    size = sum(map(len, paths)) + 2 * symbols + 2
    base, check = np.zeros(size, np.int64), np.full(size, -1, np.int64)
    check[0] = 0
    free = 1  # all cells before it are taken
    level = [(0, 0, len(paths), 0)]
    while level:
        below = []
        for node, lo, hi, depth in level:
            while lo < hi and len(paths[lo]) == depth:
                lo += 1
            if lo == hi:
                continue
            heads = np.fromiter((paths[i][depth] for i in range(lo, hi)), np.int64, hi - lo)
            starts = np.flatnonzero(np.append(True, heads[1:] != heads[:-1]))
            ids = heads[starts]
            while check[free] >= 0:
                free += 1
            at = free - int(ids[0])  # a base may be negative, its cells are not
            while True:
                if at + int(ids[-1]) >= len(check):
                    base, check = np.append(base, np.zeros(len(base), np.int64)), np.append(check, np.full(len(check), -1, np.int64))
                if (check[at + ids] < 0).all():
                    break
                at += 1
            base[node], check[at + ids] = at, node
            for k, a, z in zip(ids.tolist(), starts.tolist(), np.append(starts[1:], len(heads)).tolist()):
                below.append((at + k, lo + a, lo + z, depth + 1))
        level = below
    return base, check


def walk(base: np.ndarray, check: np.ndarray, path: np.ndarray) -> list[int]:
    """The cells of the nodes on ``path``, without the root."""
    node, out = 0, []
    for k in path.tolist():
        cell = int(base[node]) + k
        if cell < 1 or cell >= len(check) or check[cell] != node:
            raise KeyError(k)
        out.append(cell)
        node = cell
    return out


_NODE = "depth long, k1 long, k2 long, p1 long, p2 long, words long, before long, least long, sums array<long>"


def _shard(table: pa.Table, out: pa.Schema) -> pa.Table:
    """The nodes of a shard's segments (depth, k1, k2, before, turns, h1, h2, words, least, sums), with weights summed over the segments through them."""
    rows = list(zip(*(table[c].to_pylist() for c in ("depth", "k1", "k2", "before", "turns", "h1", "h2", "words", "least", "sums"))))
    # the segment's upper node is the first step of its path, as several of these meet in a shard
    names = {x: k for k, x in enumerate(dict.fromkeys([(r[0], r[1], r[2]) for r in rows] + [t for r in rows for t in r[4]]), 1)}
    paths = [np.array([names[r[:3]], *(names[t] for t in r[4])], np.int64) for r in rows]
    order = sorted(range(len(rows)), key=lambda i: paths[i].tolist())
    base, check = pack([paths[i] for i in order], len(names))
    width, nodes = len(rows[0][9]), {}
    for r, path in zip(rows, paths):
        p1, p2, before = r[1:4]
        for i, cell in enumerate(walk(base, check, path)[1:]):
            k1, k2 = p1 ^ r[5][i], p2 ^ r[6][i]
            node = nodes.get(cell)
            if node is None:
                nodes[cell] = [r[0] + i + 1, k1, k2, p1, p2, r[7][i], before, r[8], list(r[9])]
            else:
                node[7] = min(node[7], r[8])
                for j in range(width):
                    node[8][j] += r[9][j]
            p1, p2, before = k1, k2, before + r[7][i]
    return pa.Table.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*nodes.values()), out)], schema=out)


# ---------------------------------------------------------------- turns, segments, ends


def _numbered(rows: Iterator[tuple]) -> Iterator[tuple]:
    """Rows (conv, said, words) in order, with their place in the part of the conversation that lies in this partition."""
    task, conv, at = TaskContext.get().partitionId(), None, 0
    for c, said, words in rows:
        conv, at = c, at + 1 if c == conv else 0
        yield c, task, at, said, words


def turns_of(conversations: DataFrame) -> DataFrame:
    """(conv, pos, said, words): turns numbered from 0 by turn (nulls first), role and text, said being a digest of role and text.

    Range partitions number their rows; of a conversation in several of them the counts of those before are added.
    """
    text = [F.coalesce(F.col(c), F.lit("")).alias(c) for c in ("role", "text")]
    rows = conversations.where("conv_id is not null").select(F.col("conv_id").cast("long").alias("conv"), F.col("turn").cast("long").alias("turn"), *text)
    told = ranged(rows, "conv", "turn", "role", "text").select("conv", F.md5(F.concat(F.length("role"), F.lit(":"), "role", "text")).alias("said"), F.regexp_count("text", F.lit(r"[^\x20\x09-\x0D]+")).cast("long").alias("words"))
    told = materialize(map_stream(told, _numbered, "conv long, part int, at long, said string, words long"), "trie-numbered")
    sizes = told.groupBy("conv", "part").agg(F.count(F.lit(1)).alias("n"))
    # in every partition only the first conversation can have begun earlier: a row or two for each partition
    before = F.sum("n").over(Window.partitionBy("conv").orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    later = materialize(sizes.select("conv", "part", before.alias("earlier")).where("earlier is not null"), "trie-earlier")
    return told.join(small_side(later), ["conv", "part"], "left").select("conv", (F.col("at") + F.coalesce("earlier", F.lit(0))).alias("pos"), "said", "words")


def rebuilt(conversations: DataFrame, every: int = 20, heads: int = 4) -> tuple[DataFrame, DataFrame]:
    """(conversations (conv), turns (conv, depth, said, words)): the first h turns come from conversation conv - conv % ``every``.

    h = crc32(conv) % ``heads``; all turns of the other if it has fewer, none if it is absent; then follow conv's own turns after its first h.
    """
    turns = materialize(turns_of(conversations), "trie-turns")
    h = F.crc32(F.col("conv").cast("string").cast("binary")) % heads
    sizes = materialize(turns.groupBy("conv").agg(F.count(F.lit(1)).alias("n")), "trie-sizes")
    convs = sizes.select("conv", h.alias("h"), (F.col("conv") - F.col("conv") % every).alias("from"))
    convs = convs.join(sizes.select(F.col("conv").alias("from"), F.col("n").alias("given")), "from", "left").withColumn("taken", F.least("h", F.coalesce("given", F.lit(0))))
    convs = materialize(convs, "trie-convs")
    head = turns.where((F.col("conv") % every == 0) & (F.col("pos") < heads - 1)).withColumnRenamed("conv", "from")
    first = convs.join(head, "from").where("pos < h").select("conv", (F.col("pos") + 1).alias("depth"), "said", "words")
    own = turns.join(small_side(convs.select("conv", "h", "taken")), "conv").where("pos >= h").select("conv", (F.col("taken") + F.col("pos") - F.col("h") + 1).alias("depth"), "said", "words")
    turns = first.union(own)
    # a turn's part of a prefix hash: these are joined by exclusive or, in any grouping
    return convs.select("conv"), materialize(turns.withColumns({"h1": F.xxhash64("said", "depth"), "h2": F.xxhash64("depth", "said", F.lit(7))}), "trie-rebuilt")


def segments(turns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(segments, uses): different segments under their upper node, and (conv, seg) for each conversation's segments."""
    of = turns.withColumn("band", F.expr(f"(depth - 1) div {SEGMENT}"))
    each = of.groupBy("conv", "band").agg(F.sort_array(F.collect_list(F.struct("depth", "said", "words", "h1", "h2"))).alias("x"), F.bit_xor("h1").alias("e1"), F.bit_xor("h2").alias("e2"), F.sum("words").alias("w"))
    # longer conversations: a row for each segment, with the hash and words of those before
    w = Window.partitionBy("conv").orderBy("band").rowsBetween(Window.unboundedPreceding, -1)
    long = turns.where(f"depth > {SEGMENT}").select("conv").distinct()
    sums = of.join(long, "conv", "left_semi").groupBy("conv", "band").agg(F.bit_xor("h1").alias("e1"), F.bit_xor("h2").alias("e2"), F.sum("words").alias("w"))
    upper = materialize(sums.select("conv", "band", F.bit_xor("e1").over(w).alias("k1"), F.bit_xor("e2").over(w).alias("k2"), F.sum("w").over(w).alias("before")).where("before is not null"), "trie-upper")
    each = each.join(small_side(upper), ["conv", "band"], "left")
    zero = lambda c: F.coalesce(F.col(c), F.lit(0).cast("long")).alias(c)
    each = each.select("conv", (F.col("band") * SEGMENT).alias("depth"), zero("k1"), zero("k2"), zero("before"), "e1", "e2", F.col("x.said").alias("turns"), F.col("x.h1").alias("h1"), F.col("x.h2").alias("h2"), F.col("x.words").alias("words"))
    each = materialize(each.withColumn("seg", F.concat_ws("/", "depth", "k1", "k2", "e1", "e2", F.size("turns"))), "trie-segments")
    different = each.groupBy("seg").agg(*[F.first(c).alias(c) for c in ("depth", "k1", "k2", "before", "turns", "h1", "h2", "words")])
    # a shard takes the segments of one upper node and first turn; of many such segments, a share
    head = F.xxhash64("depth", "k1", "k2", F.element_at("turns", 1))
    different = materialize(different.withColumn("head", head), "trie-different")
    total = different.agg(F.coalesce(F.sum(F.size("turns")), F.lit(0))).first()[0]
    shards = -(-total // SHARD) or 1
    large = different.groupBy("head").agg(F.sum(F.size("turns")).alias("size")).where(f"size > {SHARD}").select("head", F.ceil(F.col("size") / SHARD).alias("shares"))
    share = F.pmod(F.xxhash64("seg"), F.coalesce("shares", F.lit(1)))
    placed = different.join(small_side(materialize(large, "trie-large")), "head", "left").withColumn("shard", F.pmod(F.xxhash64("head", share), F.lit(shards))).drop("shares", "head")
    return materialize(placed, "trie-placed"), each.select("conv", "seg")


_END = "depth long, k1 long, k2 long, hash string"


def _ends(rows: Iterator[tuple]) -> Iterator[tuple]:
    """Of sorted (depth, k1, k2, conv): the hash of a node's ids, or where others may have more of them, pieces of the list."""
    task = TaskContext.get().partitionId() << 32
    for at, (key, held, begins, ends) in enumerate(blocks(rows, 4096, 3)):
        ids = ",".join(str(r[3]) for r in held)
        yield (*key, hashlib.sha256(ids.encode()).hexdigest(), None, None) if begins and ends else (*key, None, task + at, ids)


def _end_pieces(rows: Iterator[tuple]) -> Iterator[tuple]:
    key, h = None, hashlib.sha256()
    for *k, _, ids in rows:
        if k == key:
            h.update(b",")
        else:
            if key is not None:
                yield *key, h.hexdigest()
            key, h = k, hashlib.sha256()
        h.update(ids.encode())
    if key is not None:
        yield *key, h.hexdigest()


def end_hashes(paths: DataFrame) -> DataFrame:
    """(depth, k1, k2, ends): SHA-256 of the ascending ids of the conversations that end in a node (conv, depth, k1, k2)."""
    order = ("depth", "k1", "k2", "conv")
    found = materialize(map_stream(ranged(paths.select(*order), *order), _ends, f"{_END}, at long, ids string", 256), "trie-ends")
    pieces = found.where("at is not null").select(*order[:3], "at", "ids").repartition(*order[:3]).sortWithinPartitions(*order[:3], "at")
    return found.where("at is null").select(*order[:3], "hash").union(map_stream(pieces, _end_pieces, _END, 16)).withColumnRenamed("hash", "ends")


# ---------------------------------------------------------------- the whole trie


def _pass(different: DataFrame, uses: DataFrame, weights: DataFrame, sums: list[str]) -> DataFrame:
    """Nodes with the sums over their members of the columns ``sums`` of ``weights`` (conv, ...), and the least member."""
    of = uses.join(weights, "conv").groupBy("seg").agg(F.min("conv").alias("least"), F.array(*[F.sum(c) for c in sums]).alias("sums"))
    out = arrow_schema(_NODE)
    nodes = different.join(of, "seg").drop("seg").groupBy("shard").applyInArrow(lambda rows: _shard(rows, out), _NODE)
    each = [F.sum(F.col("sums")[i]).alias(c) for i, c in enumerate(sums)]
    return nodes.groupBy("depth", "k1", "k2").agg(F.min("least").alias("least"), *[F.first(c).alias(c) for c in ("p1", "p2", "words", "before")], *each)


def prefix_trie(conversations: DataFrame, every: int = 20, heads: int = 4) -> DataFrame:
    """One row for each node of the trie over rebuilt conversations: conv_id (least member), depth, parent_conv_id, n_convs,
    n_children, n_leaves, saved_tokens, ends_sha256.

    Turns are taken by turn, nulls first; turns of equal number by role, then text; repeated rows are turns of their own. Null
    role and text are empty; rows without conv_id belong to no conversation. Columns other than conv_id, turn, role and
    text are not read. Without a conversation there is no node.
    """
    convs, turns = rebuilt(conversations, every, heads)
    different, uses = segments(turns)
    paths = turns.groupBy("conv").agg(F.count(F.lit(1)).alias("depth"), F.bit_xor("h1").alias("k1"), F.bit_xor("h2").alias("k2"), F.sum("words").alias("total"))
    paths = materialize(convs.join(paths, "conv", "left").fillna(0, ["depth", "k1", "k2", "total"]), "trie-paths")
    one = paths.select("conv", F.lit(1).cast("long").alias("n"), "total")
    root = one.agg(F.min("conv").alias("least"), F.sum("n").alias("n"), F.sum("total").alias("total")).where("n is not null")
    root = root.select(*[F.lit(0).cast("long").alias(c) for c in ("depth", "k1", "k2")], "least", *[F.lit(None).cast("long").alias(c) for c in ("p1", "p2")], *[F.lit(0).cast("long").alias(c) for c in ("words", "before")], "n", "total")
    nodes = materialize(_pass(different, uses, one, ["n", "total"]).union(root), "trie-nodes")
    # children by parent; a node without any is a leaf
    up = [F.col("depth") - 1, F.col("p1"), F.col("p2")]
    children = nodes.where("depth > 0").groupBy(*[x.alias(c) for x, c in zip(up, ("depth", "k1", "k2"))]).agg(F.count(F.lit(1)).alias("n_children"))
    nodes = materialize(nodes.join(children, ["depth", "k1", "k2"], "left").fillna(0, ["n_children"]), "trie-with-children")
    # nodes belong to their least member: from its first own node on, all of its path does
    own = nodes.groupBy("least").agg(F.min(F.struct("depth", "before")).alias("first"), F.max((F.col("n_children") == 0).cast("long")).alias("leaf"))
    own = materialize(own.select(F.col("least").alias("conv"), F.col("first.before").alias("skipped"), "leaf"), "trie-owners")
    weights = paths.select("conv", "total").join(own, "conv").select("conv", (F.col("total") - F.col("skipped")).alias("different"), "leaf")
    below = _pass(different, uses, weights, ["different", "leaf"]).select("depth", "k1", "k2", "different", "leaf")
    below = below.union(weights.agg(F.sum("different").alias("different"), F.sum("leaf").alias("leaf")).where("leaf is not null").select(*[F.lit(0).cast("long").alias(c) for c in ("depth", "k1", "k2")], "different", "leaf"))
    parents = nodes.select((F.col("depth") + 1).alias("depth"), F.col("k1").alias("p1"), F.col("k2").alias("p2"), F.col("least").alias("parent_conv_id"))
    out = nodes.join(below, ["depth", "k1", "k2"]).join(own.select(F.col("conv").alias("least"), "skipped"), "least")
    out = out.join(end_hashes(paths), ["depth", "k1", "k2"], "left").join(parents, ["depth", "p1", "p2"], "left")
    # each member's words from this node on, less those of the different nodes among them
    saved = F.col("total") - F.col("n") * F.col("before") - (F.col("different") - (F.col("before") - F.col("skipped")))
    return out.select(F.col("least").alias("conv_id"), "depth", "parent_conv_id", F.col("n").alias("n_convs"), "n_children", F.col("leaf").alias("n_leaves"), saved.alias("saved_tokens"), F.coalesce("ends", F.sha2(F.lit(""), 256)).alias("ends_sha256"))
