"""Exact top-k by inner product: columnar branch-and-bound over dimensions.

Vectors are whole numbers and lie in vertical layout, one row of an array for each dimension. For a query, dimensions
come in the order of its own magnitude. After each block of them a candidate's score is known in part, and the rest is
at most the product of the remaining masses (Cauchy-Schwarz). Candidates whose bound is under the k-th best score
so far go, and what survives is compacted, so later dimensions touch few columns.

Rows with equal vectors are one candidate and one query: all have the same scores, so only the k + 1 least ids of
a group can be among anyone's first k. Blocks of queries meet blocks of candidates on the cluster; a task holds one of each.
"""

from __future__ import annotations

import heapq

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from loomlake.llm.runs import arrow_schema
from loomlake.session import materialize

#: Different vectors in a block of queries and of candidates: bounds of a task's memory, not of results.
QUERY_BLOCK, CANDIDATE_BLOCK = 1024, 8192
#: Dimensions between two compactions, and candidates that are scored whole to get a first threshold.
STEP, FIRST = 16, 512


def vertical(vectors: list, dims: int) -> np.ndarray:
    """(dimension, row) with numbers in which sums of products are exact: floats, doubles, longs, or Python's integers."""
    flat = np.asarray(vectors, np.int64).reshape(len(vectors), dims)
    mass = float(np.abs(flat.astype(float)).max(initial=0)) ** 2 * max(1, dims)
    kind = np.float32 if mass < 1 << 24 else np.float64 if mass < 1 << 52 else np.int64 if mass < 1 << 62 else object
    return np.ascontiguousarray(flat.astype(kind).T)


def best(query: np.ndarray, columns: np.ndarray, squares: np.ndarray, masses: np.ndarray, k: int, floor: float) -> tuple[np.ndarray, np.ndarray]:
    """(candidates, scores) of all that reach ``floor``, a score that at least k candidates reach, and the k-th best bound below.

    ``columns`` are the candidates in vertical layout, ``squares`` those of their components, ``masses`` the sums of these.
    """
    order = np.argsort(-np.abs(query), kind="stable")
    alive, score, rest = None, np.zeros(columns.shape[1], columns.dtype), masses
    for at in range(0, len(order), STEP):
        dims, later = order[at : at + STEP], query[order[at + STEP :]]
        part = columns[dims] if alive is None else columns[np.ix_(dims, alive)]
        score = score + query[dims] @ part
        if not len(later):
            break
        done = squares[dims] if alive is None else squares[np.ix_(dims, alive)]
        rest = rest - done.sum(0)
        known, own = score.astype(float), float((later * later).sum())
        slack = np.sqrt(np.maximum(rest.astype(float), 0) * own) * (1 + 1e-9) + (1e-3 + 1e-12 * (abs(floor) if floor > -np.inf else 0) + 1e-12 * np.abs(known).max(initial=0))
        if len(score) > k:
            floor = max(floor, float(np.partition(known - slack, -k)[-k]))
        keep = known + slack >= floor
        if keep.sum() < 0.8 * len(keep):
            score, rest = score[keep], rest[keep]
            alive = np.flatnonzero(keep) if alive is None else alive[keep]
    return np.arange(columns.shape[1]) if alive is None else alive, score


def _search(k: int, dims: int):
    out = arrow_schema("node string, ids array<long>, scores array<long>")

    def run(queries: pa.Table, rows: pa.Table) -> pa.Table:
        found: tuple[list, list, list] = ([], [], [])
        if queries.num_rows and rows.num_rows:
            wanted = vertical(queries["wanted"].to_pylist(), dims).T
            columns, ids = vertical(rows["vector"].to_pylist(), dims), rows["ids"].to_pylist()
            if wanted.dtype != columns.dtype:
                kind = object  # one of them may be too large for the other's numbers
                wanted, columns = wanted.astype(np.int64).astype(kind), columns.astype(np.int64).astype(kind)
            squares, first = columns * columns, np.ascontiguousarray(columns[:, :FIRST])
            masses = squares.sum(0)
            for node, query in zip(queries["node"].to_pylist(), wanted):
                seed = (query @ first).astype(float)
                floor = float(np.partition(seed, -k)[-k]) if len(seed) >= k else -np.inf
                at, score = best(query, columns, squares, masses, k, floor)
                score = np.array([min(max(int(s), -(1 << 63)), (1 << 63) - 1) for s in score], np.int64)
                if len(score) > k:
                    keep = score >= np.partition(score, -k)[-k]
                    at, score = at[keep], score[keep]
                top = heapq.nsmallest(k, ((-int(s), i) for a, s in zip(at.tolist(), score) for i in ids[a]))
                for c, v in zip(found, (node, [i for _, i in top], [-s for s, _ in top])):
                    c.append(v)
        return pa.Table.from_arrays([pa.array(c, f.type) for c, f in zip(found, out)], schema=out)

    return run


def top_k(rows: DataFrame, k: int = 20, every: int = 20, scale: int = 64, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(query_id, rank, vec_id, score): of each row whose id is divisible by ``every``, the k rows of highest inner product.

    Components become floor(scale * component). Ties go to the smaller id; with fewer rows than k + 1 all are given.
    Rows take no part if their id or vector is null, or a component null or not finite. Shorter vectors count as filled up with
    zeros. Repeated rows of the same id and vector count once; an id never is its own result; an id with several
    vectors is a query, and a candidate, with each of them. Scores that leave a long become the nearest long.
    """
    v = F.col(f"`{vector_col}`")
    finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x.cast("double")) & (F.abs(x.cast("double")) < float("inf")))
    whole = F.transform(v, lambda x: F.floor(x.cast("double") * scale))
    each = rows.where(F.col(f"`{id_col}`").isNotNull() & v.isNotNull() & finite).select(F.col(f"`{id_col}`").cast("long").alias("id"), whole.alias("vector"))
    dims = each.agg(F.max(F.size("vector"))).first()[0] or 1
    each = each.withColumn("vector", F.concat("vector", F.array_repeat(F.lit(0).cast("long"), F.lit(dims) - F.size("vector"))))
    each = each.withColumn("node", F.md5(F.array_join(F.col("vector").cast("array<string>"), ",")))
    # a group of equal vectors keeps its k + 1 least ids; Spark limits the groups of such a window before its shuffle
    each = each.dropDuplicates(["node", "id"])
    least = each.withColumn("place", F.row_number().over(Window.partitionBy("node").orderBy("id"))).where(F.col("place") <= k + 1)
    groups = materialize(least.groupBy("node").agg(F.sort_array(F.collect_list("id")).alias("ids"), F.first("vector").alias("vector")), "vector-groups")
    wanted = materialize(each.where(F.col("id") % every == 0).select("node", "id"), "vector-queries")
    asked = groups.join(wanted.select("node").distinct(), "node", "left_semi")
    across, down = -(-groups.count() // CANDIDATE_BLOCK) or 1, -(-asked.count() // QUERY_BLOCK) or 1
    place = lambda n: F.pmod(F.xxhash64("node"), F.lit(n)).cast("int")
    asked = asked.select("node", F.col("vector").alias("wanted"), place(down).alias("q"), F.explode(F.sequence(F.lit(0), F.lit(across - 1))).alias("c"))
    others = groups.select("ids", "vector", place(across).alias("c"), F.explode(F.sequence(F.lit(0), F.lit(down - 1))).alias("q"))
    found = asked.groupBy("q", "c").cogroup(others.groupBy("q", "c")).applyInArrow(_search(k + 1, dims), "node string, ids array<long>, scores array<long>")
    hits = found.select("node", F.inline(F.arrays_zip(F.col("scores").alias("score"), F.col("ids").alias("vec_id"))))
    order = Window.partitionBy("node").orderBy(F.desc("score"), "vec_id")
    hits = hits.withColumn("place", F.row_number().over(order)).where(F.col("place") <= k + 1)
    top = hits.groupBy("node").agg(F.sort_array(F.collect_list(F.struct("place", "vec_id", "score"))).alias("top"))
    first = F.slice(F.filter("top", lambda x: x["vec_id"] != F.col("query_id")), 1, k)
    each_query = wanted.select(F.col("id").alias("query_id"), "node").join(top, "node").select("query_id", F.posexplode(first).alias("at", "hit"))
    return each_query.select("query_id", (F.col("at") + 1).alias("rank"), F.col("hit.vec_id").alias("vec_id"), F.col("hit.score").alias("score"))
