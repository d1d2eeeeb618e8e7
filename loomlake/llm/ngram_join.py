"""Near-duplicate documents: n-gram Jaccard self-join with token-combination prefixes.

A document is its set of word shingles. All sets follow one order of shingles: rare ones first, frequent
ones (a merged count-min sketch tells) last. Of two sets similar enough, each one's prefix (as many
shingles as the other may lack, and one more) holds a shared shingle. A rare shingle is a signature on its
own. Frequent shingles are dealt to classes; two of the same class make a signature together, and a
class of c shingles then counts as c - 1 towards the prefix, which is extended accordingly. Sets that share
a signature are compared by parity bitmaps first, of about a bit for each shingle: bits that differ are a
lower bound of the shingles that differ, so no link is lost. What is left is verified exactly.

Equal sets are one node from the start. In a group of mutually similar sets most pairs are told by
transitivity: each round verifies only links to one hub of a signature, joins what is linked, and drops
signatures whose sets all are in one component; the pairs left are then verified one by one.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from loomlake.llm.common import LOWER, U64, Bits, distinct, log2_at_least, merged_sketch, mix, small_side, window_hashes, word_hashes
from loomlake.session import materialize

#: Hub rounds before the remaining pairs are verified one by one; fewer if these pairs are few, or the last of two and more finds few links.
ROUNDS = 4


def shingles(data: bytes, width: int = 5) -> np.ndarray:
    """Sorted distinct hashes of the ``width``-word shingles; the whole sequence where there are fewer words."""
    words = word_hashes(data.translate(LOWER))
    return distinct(window_hashes(words, min(width, len(words)))) if len(words) else np.empty(0, U64)


def band(n: int, percent: int) -> int:
    """Sizes from 1 in bands, each 100 / percent times as wide as the one before."""
    b, low = 0, 1.0
    while low * 100 / percent <= n:
        low, b = low * 100 / percent, b + 1
    return b


def signatures(some: np.ndarray, bits: Bits, percent: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes that this set and any other set of at least ``percent`` % Jaccard similarity have one of in common.

    With each: -1 for that of a rare shingle, else the number of the set's rare shingles, all of which are
    signatures too. Sets that meet in frequent shingles only have no rare one in common, see ``_close``.
    """
    n = len(some)
    need = n - -(-percent * n // 100) + 1  # one more than the shingles that the other may lack
    frequent = bits.reached(some)
    rare = some[~frequent][:need]
    single, out = mix(rare + U64(1)), []
    if len(rare) < need and n > 1:
        rest = some[frequent]
        for b in range(band(-(-percent * n // 100), percent), band(n, percent) + 1):
            # classes: an eighth of the least size in the band, so the prefix always suffices
            classes = max(1, int((100 / percent) ** b) // 8)
            of = mix(rest + U64(b + 2)) % U64(classes)
            _, first = np.unique(of, return_index=True)
            again = np.ones(len(rest), bool)
            again[first] = False  # the first shingle of a class adds nothing
            upto = np.searchsorted(np.cumsum(again), need - len(rare)) + 1
            token, group = rest[:upto], of[:upto]
            order = np.argsort(group, kind="stable")
            token, group = token[order], group[order]
            step = 1
            with np.errstate(over="ignore"):
                while step < len(token):
                    same = group[step:] == group[:-step]
                    if not same.any():
                        break
                    out.append(mix(token[:-step][same] * U64(0x9E3779B97F4A7C15) + token[step:][same] + U64(b + 2)))
                    step += 1
    pairs = distinct(np.concatenate(out)) if out else np.empty(0, U64)
    return np.concatenate((single, pairs)), np.concatenate((np.full(len(single), -1), np.full(len(pairs), len(rare))))


def parity(some: np.ndarray) -> bytes:
    """A bitmap of at least as many cells as shingles, a power of two: each bit tells whether its cell holds an odd number."""
    cells = 1 << max(6, (len(some) - 1).bit_length())
    odd = np.bincount((some & U64(cells - 1)).astype(np.int64), minlength=cells) & 1
    return np.packbits(odd.astype(bool)).tobytes()


def parity_distance(x: bytes, y: bytes) -> int:
    """At most the number of shingles that only one of two sets has. The longer bitmap is folded onto the shorter."""
    a, b = np.frombuffer(x, np.uint8), np.frombuffer(y, np.uint8)
    if len(a) > len(b):
        a, b = b, a
    return int(np.bitwise_count(a ^ np.bitwise_xor.reduce(b.reshape(-1, len(a)), 0)).sum())


#: Columns with the parities of 256 cells, to compare sets inside a join.
PARITIES = ["p0", "p1", "p2", "p3"]


def _sets(docs: DataFrame, width: int) -> DataFrame:
    """(id, tag, n, h1, h2, map, p0 to p3): each row's shingle set with its size, 128-bit hash and parities."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                n, h1, h2, maps, few = [], [], [], [], []
                for text in part.column(1):
                    s = shingles((text.as_py() or "").encode(), width)
                    n.append(len(s))
                    maps.append(parity(s) if len(s) else None)
                    odd = np.bincount((s & U64(255)).astype(np.int64), minlength=256) & 1
                    few.append(np.packbits(odd.astype(bool)).view(np.int64))
                    for out, salt in ((h1, 11), (h2, 12)):
                        out.append(int(mix(s + U64(salt)).sum(dtype=U64).view(np.int64)))
                cols = {"id": part.column(0), "tag": part.column(2), "n": pa.array(n, pa.int64()), "h1": pa.array(h1, pa.int64()), "h2": pa.array(h2, pa.int64()), "map": pa.array(maps, pa.binary())}
                yield pa.RecordBatch.from_pydict(cols | dict(zip(PARITIES, np.stack(few, 1))))

    return docs.select("id", "text", "tag").mapInArrow(run, "id long, tag long, n long, h1 long, h2 long, map binary, p0 long, p1 long, p2 long, p3 long")


def _postings(docs: DataFrame, bits, width: int, percent: int) -> DataFrame:
    """(sig, node, n, r) of signatures that at least two nodes have: one shuffle, then a pass over sorted rows.

    A set has hundreds of signatures, all different, so even one that all sets have is a small part of all rows.
    """

    def give(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cells = bits.value
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                cols: tuple[list, ...] = ([], [], [], [])
                for i, text in zip(part.column(0).to_pylist(), part.column(1)):
                    s = shingles((text.as_py() or "").encode(), width)
                    if len(s):
                        sig, rare = signatures(s, cells, percent)
                        for c, v in zip(cols, (sig.view(np.int64), np.full(len(sig), i), np.full(len(sig), len(s)), rare)):
                            c.append(v)
                if cols[0]:
                    yield pa.RecordBatch.from_pydict({k: pa.array(np.concatenate(c)) for k, c in zip(names, cols)})

    def shared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last = None  # the row before, and whether it is in a run
        for batch in batches:
            if not batch.num_rows:
                continue
            cols = [batch.column(i).to_numpy() for i in range(4)]
            if last is not None:
                cols = [np.concatenate((a[-1:], b)) for a, b in zip(last[0], cols)]
            new = np.append(True, np.any([np.diff(c) != 0 for c in cols], 0))
            cols = [c[new] for c in cols]
            after = np.concatenate((cols[0][1:] == cols[0][:-1], [False]))
            before = np.concatenate(([last[1] if last is not None else False], after[:-1]))
            keep = after | before
            last = ([c[-1:] for c in cols], bool(keep[-1]))
            keep[-1] = False  # told by the next batch
            if keep.any():
                yield pa.RecordBatch.from_pydict({k: pa.array(c[keep]) for k, c in zip(names, cols)})
        if last is not None and last[1]:
            yield pa.RecordBatch.from_pydict({k: pa.array(c) for k, c in zip(names, last[0])})

    names, schema = ("sig", "node", "n", "r"), "sig long, node long, n long, r long"
    every = docs.select("id", "text").mapInArrow(give, schema)
    return every.repartition("sig").sortWithinPartitions("sig", "node", "n", "r").mapInArrow(shared, schema)


def _hashes(docs: DataFrame, width: int) -> DataFrame:
    """(node, hashes): the sorted 64-bit hashes of each row's shingles."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                data = [shingles((t.as_py() or "").encode(), width).tobytes() for t in part.column(1)]
                yield pa.RecordBatch.from_pydict({"node": part.column(0), "hashes": pa.array(data, pa.binary())})

    return docs.select("id", "text").mapInArrow(run, "node long, hashes binary")


def _near(pairs: DataFrame, maps: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) that their bitmaps do not rule out: sets differ in (n + m) * (100 - percent) / (100 + percent) shingles at most."""
    left = maps.select(F.col("node").alias("a"), F.col("n").alias("na"), F.col("map").alias("ma"))
    right = maps.select(F.col("node").alias("b"), F.col("n").alias("nb"), F.col("map").alias("mb"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = batch.column(2).to_numpy() + batch.column(3).to_numpy()
            far = np.array([parity_distance(x.as_py(), y.as_py()) for x, y in zip(batch.column(4), batch.column(5))], np.int64)
            keep = pa.array(far * (100 + percent) <= n * (100 - percent))
            yield pa.RecordBatch.from_arrays([batch.column(0).filter(keep), batch.column(1).filter(keep)], ["a", "b"])

    return pairs.join(left, "a").join(right, "b").select("a", "b", "na", "nb", "ma", "mb").mapInArrow(run, "a long, b long").distinct()


def _verified(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) whose sets are similar enough."""
    left = sets.select(F.col("node").alias("a"), F.col("hashes").alias("da"))
    right = sets.select(F.col("node").alias("b"), F.col("hashes").alias("db"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ok = []
            for x, y in zip(batch.column(2), batch.column(3)):
                x, y = np.frombuffer(x.as_py(), U64), np.frombuffer(y.as_py(), U64)
                if len(x) > len(y):
                    x, y = y, x
                at = np.minimum(np.searchsorted(y, x), len(y) - 1)
                both = int((y[at] == x).sum())
                ok.append(100 * both >= percent * (len(x) + len(y) - both))
            keep = pa.array(ok, pa.bool_())
            yield pa.RecordBatch.from_arrays([batch.column(0).filter(keep), batch.column(1).filter(keep)], ["a", "b"])

    return pairs.join(left, "a").join(right, "b").select("a", "b", "da", "db").mapInArrow(run, "a long, b long")


def components(edges: DataFrame) -> DataFrame:
    """(node, comp) for all ends of ``edges`` (a, b): comp is the least node of the connected component.

    Each round hooks every root to its least neighbour, follows these pointers to their ends by doubling, and
    maps the edges to the new roots. All tables stay on the cluster; each step is written, so lineage is short.
    """
    labels = None
    left = materialize(edges.select("a", "b").where("a <> b").distinct(), "edges")
    nodes = left.select(F.col("a").alias("node")).union(left.select("b")).distinct()
    while not left.isEmpty():
        both = left.union(left.select("b", "a"))
        to = both.groupBy("a").agg(F.min("b").alias("m")).where("m < a").select(F.col("a").alias("node"), F.col("m").alias("to"))
        to = materialize(to, "hooks")
        while True:  # pointer doubling
            next_to = to.select(F.col("node").alias("to"), F.col("to").alias("next"))
            hop = materialize(to.join(next_to, "to", "left").select("node", F.coalesce("next", "to").alias("to"), F.col("next").isNotNull().alias("moved")), "hops")
            to = hop.select("node", "to")
            if hop.where("moved").isEmpty():
                break
        base = nodes.withColumn("comp", F.col("node")) if labels is None else labels
        root = to.select(F.col("node").alias("comp"), F.col("to").alias("new"))
        labels = materialize(base.join(root, "comp", "left").select("node", F.coalesce("new", "comp").alias("comp")), "labels")
        a, b = (to.select(F.col("node").alias(c), F.col("to").alias(f"{c}2")) for c in "ab")
        left = left.join(a, "a", "left").join(b, "b", "left").select(F.coalesce("a2", "a").alias("a"), F.coalesce("b2", "b").alias("b")).where("a <> b").distinct()
        left = materialize(left, "edges")
    return nodes.withColumn("comp", F.col("node")) if labels is None else labels


def joined(labels: DataFrame | None, links: DataFrame) -> DataFrame:
    """``labels`` (node, comp) after more links: only these, between the components of before, are worked through."""
    if labels is None:
        return components(links)
    for end in "ab":
        to = labels.select(F.col("node").alias(end), "comp")
        links = links.join(to, end, "left").withColumn(end, F.coalesce("comp", end)).drop("comp")
    named = components(links)
    new = named.select(F.col("node").alias("comp"), F.col("comp").alias("new"))
    known = labels.join(new, "comp", "left").select("node", F.coalesce("new", "comp").alias("comp"))
    return materialize(known.union(named.join(labels, "node", "left_anti").select("node", "comp")), "joined")


def _close(percent: int):
    """Whether sets of n and m shingles, r and q of them rare, can be similar enough if they share a signature.

    One of a rare shingle (r is -1) leaves only the sizes to go by. Sets that share no rare shingle have all r + q
    of them apart, and at most the lesser number of frequent ones in common.
    """
    n, m, r, q = (F.col(c) for c in ("n", "m", "r", "q"))
    sizes = (n * 100 >= m * percent) & (m * 100 >= n * percent)
    return F.when(r < 0, sizes).otherwise(F.least(n - r, m - q) * 100 >= (F.greatest(n - r, m - q) + r + q) * percent)


def _alike(percent: int):
    """Whether the parities p0 to p3 and q0 to q3 of sets of n and m shingles leave them a chance to be similar enough."""
    apart = sum((F.bit_count(F.col(p).bitwiseXOR(F.col(p.replace("p", "q")))) for p in PARITIES), F.lit(0))
    return apart * (100 + percent) <= (F.col("n") + F.col("m")) * (100 - percent)


def _links(postings: DataFrame, maps: DataFrame, sets: Callable[[DataFrame], DataFrame], percent: int, rounds: int) -> DataFrame:
    """(node, comp) of the nodes that are linked to any other. ``sets`` gives the shingles of a table of nodes.

    A node is heavy at a signature of frequent shingles if its rare ones are so many that, by ``_close``,
    it can only link to nodes with fewer: two heavy nodes are no candidates, and are never paired.
    """
    heavy = (F.col("r") * 2 * percent > (F.col("n") - F.col("r")) * (100 - percent)).cast("int")
    postings = postings.withColumn("heavy", heavy)
    tested, labels = None, None

    def add(pairs: DataFrame) -> bool:
        """Verifies pairs. Whether so many were links that another hub round pays."""
        nonlocal tested, labels
        if tested is not None:
            pairs = pairs.join(tested, ["a", "b"], "left_anti")
        pairs = materialize(pairs, "pairs")
        near = materialize(_near(pairs, maps, percent), "near")
        ends = materialize(near.select(F.col("a").alias("node")).union(near.select("b")).distinct(), "ends")
        found = materialize(_verified(near, materialize(sets(ends), "packed"), percent), "links")
        tested = pairs if tested is None else tested.union(pairs)
        labels = joined(labels, found)
        return found.count() * 50 > pairs.count()

    more = True
    for turn in range(rounds + 1):
        if labels is not None:
            named = postings.drop("comp").join(labels, "node", "left").withColumn("comp", F.coalesce("comp", "node"))
        else:
            named = postings.withColumn("comp", F.col("node"))
        # of each signature: candidate pairs (of different components, not both heavy), and a hub that is not heavy if
        # there is such a node. Every other round it is one with few shingles of its own, as the middle of a group of near
        # copies has; four choices for the signatures of a group, so that one bad hub does not spoil a round
        place = F.struct("heavy", (F.lit(0) if turn % 2 else F.col("r")).cast("long").alias("own"), F.xxhash64("node", F.pmod("sig", F.lit(4)), F.lit(turn)).alias("place"), "node", "n", "r", "comp")
        each = named.groupBy("sig", "comp").agg(F.count(F.lit(1)).alias("k"), F.sum("heavy").alias("h"), F.min(place).alias("hub"))
        each = each.groupBy("sig").agg(*[F.sum(c).alias(c) for c in "kh"], *[F.sum(F.col(c) * F.col(c)).alias(f"{c}2") for c in "kh"], F.min("hub").alias("hub"))
        each = each.withColumn("pairs", (F.col("k") * F.col("k") - F.col("k2") - F.col("h") * F.col("h") + F.col("h2")) / 2).where("pairs > 0")
        each = materialize(each.select("sig", "k", "pairs", F.col("hub.node").alias("hub"), F.col("hub.n").alias("m"), F.col("hub.r").alias("q"), F.col("hub.comp").alias("comp2")), "mixed")
        rows, pairs = each.agg(F.coalesce(F.sum("k"), F.lit(0)), F.coalesce(F.sum("pairs"), F.lit(0))).first()
        if not pairs:
            break
        postings = materialize(named.join(each.drop("k", "pairs"), "sig").select("sig", "node", "n", "r", "heavy", "comp", "hub", "m", "q", "comp2"), "postings")
        if turn < rounds and (more or turn < 2) and pairs > 2 * rows:
            star = postings.where((F.col("comp") != F.col("comp2")) & _close(percent))
            more = add(star.select(F.least("node", "hub").alias("a"), F.greatest("node", "hub").alias("b")).distinct())
            # the hub was held against all others there
            postings = postings.where("not (node = hub and n = m and r = q)").select("sig", "node", "n", "r", "heavy")
            continue
        # parities keep nearly all pairs that are no links out of the join's rows; and of the many signatures where a
        # pair meets, those just behind another one are passed over (rare shingles come first, as they say more)
        order = Window.partitionBy("node", "n").orderBy(F.col("r") >= 0, "sig")
        told = postings.withColumn("before", F.array_compact(F.array(*[F.lag("sig", k).over(order) for k in range(1, 5)])))
        own = maps.select("node", "n", *PARITIES, F.count(F.lit(1)).over(Window.partitionBy("node")).alias("texts"))
        told = told.join(own, ["node", "n"])
        # an id with several texts is compared wherever it meets another
        told = told.withColumn("before", F.when(F.col("texts") == 1, F.col("before")).otherwise(F.array().cast("array<long>")))
        light = told.where("heavy = 0").select("sig", F.col("node").alias("x"), "n", "r", F.col("comp").alias("cx"), F.col("before").alias("bx"), *PARITIES)
        other = told.select("sig", F.col("node").alias("y"), F.col("n").alias("m"), F.col("r").alias("q"), F.col("comp").alias("cy"), F.col("before").alias("by"), "heavy", *[F.col(p).alias(p.replace("p", "q")) for p in PARITIES])
        both = light.join(other, (light["sig"] == other["sig"]) & (F.col("cx") != F.col("cy")) & ((F.col("heavy") == 1) | (F.col("x") < F.col("y"))) & _close(percent) & _alike(percent) & ~F.arrays_overlap("bx", "by"))
        add(both.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct())
        break
    return labels


def similar_groups(docs: DataFrame, percent: int = 75, width: int = 5, id_col: str = "doc_id", text_col: str = "text", rounds: int = ROUNDS) -> DataFrame:
    """One row per document: id, n_shingles, component_id.

    Two documents link when 100 * shared shingles >= ``percent`` * all their shingles; ``component_id`` is the
    least id that links lead to, itself included. Null and empty texts, and texts without a word, have no
    shingles and link with nothing. A row with a null id gets the component of the
    documents with an equal set, null if there are none. An id with several texts links as each of them
    does. Ids are whole numbers; ``percent`` is over 50.
    """
    spark = docs.sparkSession
    kind = docs.schema[id_col].dataType.simpleString()
    source = docs.select(F.col(f"`{id_col}`").cast("long").alias("id"), F.col(f"`{text_col}`").alias("text"), F.xxhash64(F.col(f"`{text_col}`")).alias("tag"))
    each = materialize(_sets(source, width), "sets")
    nodes = materialize(each.where("n > 0").groupBy("n", "h1", "h2").agg(F.min("id").alias("node"), F.max("id").alias("last")), "nodes")
    placed = each.select("id", "n", "h1", "h2").join(nodes.select("n", "h1", "h2", "node"), ["n", "h1", "h2"], "left")
    several = nodes.where("node < last").select("n", "h1", "h2", "node")
    copies = materialize(each.where("n > 0").select("id", "tag", "n", "h1", "h2").join(several, ["n", "h1", "h2"]).where("id > node").select("id", "tag").distinct(), "copies")
    alone = source.where("id is not null and text is not null").join(small_side(copies), ["id", "tag"], "left_anti")
    total = each.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    log2 = log2_at_least(total / 4, 16, 27)
    often = min(250, 16 + int(3 * total / (1 << log2)))
    bits = spark.sparkContext.broadcast(merged_sketch(alone.select("text"), lambda data: shingles(data, width), log2, 1, often))
    postings = materialize(_postings(alone, bits, width, percent), "postings")
    linked = materialize(postings.select("node").distinct(), "linked")
    maps = each.where("n > 0").join(small_side(copies), ["id", "tag"], "left_anti").select(F.col("id").alias("node"), "n", "map", *PARITIES)
    maps = materialize(maps.join(small_side(linked), "node", "left_semi"), "maps")

    def sets(ends: DataFrame) -> DataFrame:
        return _hashes(alone.join(small_side(ends), alone["id"] == ends["node"], "left_semi"), width)

    labels = _links(postings, maps, sets, percent, rounds)
    out = placed.join(labels, "node", "left") if labels is not None else placed.withColumn("comp", F.lit(None).cast("long"))
    return out.select(F.col("id").cast(kind).alias(id_col), F.col("n").alias("n_shingles"), F.coalesce("comp", "node", "id").cast(kind).alias("component_id"))
