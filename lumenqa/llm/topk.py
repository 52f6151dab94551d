"""Exact top-k inner-product search by a three-phase uniform threshold.

The dimensions are dealt into ``lists`` groups; a query's *local list* in a group holds the
partial scores of all vectors there, and a score is the sum of the partial scores.

1. Gather: of a hashed slice of the vectors, each block gathers the local lists and reports the k best
   entries of their sum.  The k-th best score seen for a query is a safe cutoff whatever the slice: the
   true k-th best can't be below it.
2. The cutoff travels with the queries, and blocks of all vectors read their lists in turn.  A list
   can add no more to a score than the product of the two norms there, so an entry goes unread in
   the other lists once its sum and what they can add stay below the cutoff, or once no list has, or
   can have, the uniform share cutoff / lists (some list of a sufficient entry must).
3. The remaining partial scores of the few entries left are resolved one by one, and what reaches the
   cutoff goes to the final top-k, k entries a block at most.

Queries meet vectors in blocks: each query block is paired with each vector block by their numbers.
Neither side is broadcast, a task holds one pair of blocks, and no pair of rows is shuffled.  A query
block is read against all vectors, so the work of an exact search grows as queries times vectors; the
blocks keep what is shuffled to a 4096th of that.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import written

SCALE = 256
#: Rows and queries of a block, and queries scored at a time.
BLOCK_ROWS, BLOCK_QUERIES, SCORED_QUERIES = 2048, 4096, 256
#: The first phase gathers from one vector in so many.
SLICE = 16
#: Lists are read as whole matrices until fewer than this share of the entries is left.
FEW = 0.25
_EXACT = float(1 << 53)


def quantised(vector: Column, scale: int = SCALE) -> Column:
    """floor(scale * x) of each component, x as double, still as double."""
    return F.transform(vector, lambda x: F.floor(x.cast("double") * scale).cast("double"))


def usable(vector: Column) -> Column:
    """Neither null nor holding a null, NaN or infinite component."""
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x.cast("double")) < F.lit(float("inf"))))
    return F.coalesce(vector.isNotNull() & finite, F.lit(False))


def _exact_dot(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Integer products of the rows of a with those of b: doubles while exact, else Python integers."""
    bound = float(np.abs(a).max(initial=0)) * float(np.abs(b).max(initial=0)) * max(1, a.shape[1])
    if bound < _EXACT:
        return a @ b.T
    return np.array([[int(x) for x in row] for row in a], object).reshape(a.shape) @ np.array([[int(x) for x in row] for row in b], object).reshape(b.shape).T


def _best(scores: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Positions of the k best, ties to smaller ids; scores of one query."""
    if len(scores) > 4 * k:
        floor = np.partition(scores, len(scores) - k)[len(scores) - k]
        at = np.flatnonzero(scores >= floor)
    else:
        at = np.arange(len(scores))
    return at[np.lexsort((ids[at], -scores[at]))][:k]


def _edges(dim: int, lists: int) -> list[tuple[int, int]]:
    return [(dim * i // lists, dim * (i + 1) // lists) for i in range(lists)]


def gathered(q: np.ndarray, v: np.ndarray, ids: np.ndarray, other: np.ndarray, k: int, lists: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """Phase 1: the k best entries of each query by the sum of its local lists; ``other`` marks what may be found."""
    total = sum(_exact_dot(q[:, a:b], v[:, a:b]) for a, b in _edges(q.shape[1], lists))
    out = []
    for i in range(len(q)):
        own = np.flatnonzero(other[i])
        seen = own[_best(total[i][own], ids[own], k)]
        out.append((seen, total[i][seen]))
    return out


def sufficient(q: np.ndarray, v: np.ndarray, cutoff: np.ndarray, other: np.ndarray, lists: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
    """Phases 2 and 3: (query, vector, score) positions and scores of what reaches the cutoff, and how many entries of lists were read.

    Inputs are whole numbers whose products are exact as doubles; ``cutoff`` may be minus infinity.
    """
    edges, share = _edges(q.shape[1], lists), cutoff / lists
    norms = [(np.linalg.norm(q[:, a:b], axis=1), np.linalg.norm(v[:, a:b], axis=1)) for a, b in edges]
    # What lists g, g + 1, ... can add: the norms over their dimensions, a little rounded up.
    ahead = [(np.sqrt(sum(x * x for x, _ in norms[g:])) * (1 + 1e-9), np.sqrt(sum(y * y for _, y in norms[g:])) * (1 + 1e-9)) for g in range(lists)]
    total, best, read, g = np.zeros((len(q), len(v))), np.full((len(q), len(v)), -np.inf), 0, 0
    left = other
    while g < lists:
        a, b = edges[g]
        part = q[:, a:b] @ v[:, a:b].T
        read += part.size
        total += part
        np.maximum(best, part, out=best)
        g += 1
        if g == lists:
            left = left & (total >= cutoff[:, None])
            break
        left = left & (total + np.outer(*ahead[g]) + 1 >= cutoff[:, None])
        if np.count_nonzero(left) < FEW * left.size:
            break
    i, j = np.nonzero(left)
    score, best = total[i, j], best[i, j]
    while g < lists and len(i):
        most = np.max([x[i] * y[j] for x, y in norms[g:]], axis=0) * (1 + 1e-9) + 1
        able = np.flatnonzero(((best >= share[i]) | (most >= share[i])) & (score + ahead[g][0][i] * ahead[g][1][j] + 1 >= cutoff[i]))
        i, j, score, best = i[able], j[able], score[able], best[able]
        a, b = edges[g]
        part = np.einsum("nd,nd->n", q[i, a:b], v[j, a:b])
        read += len(i)
        score, best, g = score + part, np.maximum(best, part), g + 1
    enough = score >= cutoff[i]
    return i[enough], j[enough], score[enough], read


def _local(queries: pd.DataFrame, vectors: pd.DataFrame, k: int, lists: int) -> list[tuple[int, int, int, int]]:
    """(query_row, query_id, vec_id, score) that one block of vectors adds; with a cutoff phases 2 and 3, else 1."""
    out = []
    v_rows, v_ids = vectors["row_id"].to_numpy(np.int64), vectors["vec_id"].to_numpy(np.int64)
    v_dims = vectors["vector"].map(len).to_numpy()
    q_dims = queries["wanted"].map(len).to_numpy()
    top = (1 << 63) - 1
    for dim in np.unique(q_dims):  # vectors of different lengths have no inner product
        of = queries[q_dims == dim]
        at = np.flatnonzero(v_dims == dim)
        if not len(at):
            continue
        q = np.stack([np.asarray(x, float) for x in of["wanted"]]).reshape(len(of), dim)
        v = np.stack([np.asarray(x, float) for x in vectors["vector"].iloc[at]]).reshape(len(at), dim)
        ids, q_rows = v_ids[at], of["query_row"].to_numpy(np.int64)
        other = q_rows[:, None] != v_rows[at][None, :]
        first = of["cutoff"].isna().all()
        if first or float(np.abs(q).max(initial=0)) * float(np.abs(v).max(initial=0)) * max(1, dim) >= _EXACT:
            found = gathered(q, v, ids, other, k, lists)  # with a cutoff: too large for doubles, so every entry is read
        else:
            cutoff = of["cutoff"].to_numpy(np.int64)
            i, j, score, _ = sufficient(q, v, np.where(cutoff == -top - 1, -np.inf, cutoff.astype(float)), other, lists)
            ends = np.searchsorted(i, np.arange(len(q) + 1))
            found = [(j[a:b], score[a:b]) for a, b in zip(ends, ends[1:], strict=False)]
        for row, query, (seen, score) in zip(q_rows, of["query_id"], found, strict=True):
            if len(seen):
                out += [(int(row), int(query), int(ids[seen[n]]), max(-top - 1, min(top, int(score[n])))) for n in _best(np.asarray(score), ids[seen], k)]
    return out


def _phase(queries: DataFrame, vectors: DataFrame, blocks: int, query_blocks: int, k: int, lists: int) -> DataFrame:
    """The entries of all pairs of a query block and a vector block; a task holds one pair at a time."""

    def every(n: int, name: str) -> Column:
        return F.explode(F.sequence(F.lit(0), F.lit(n - 1))).alias(name)

    left = queries.select("*", every(blocks, "block")).groupBy("block", "query_block")
    right = vectors.select("*", every(query_blocks, "query_block")).groupBy("block", "query_block")

    def run(of: pd.DataFrame, block: pd.DataFrame) -> pd.DataFrame:
        out: list[tuple[int, int, int, int]] = []
        if len(of) and len(block):
            for a in range(0, len(of), SCORED_QUERIES):
                out += _local(of.iloc[a : a + SCORED_QUERIES], block, k, lists)
        return pd.DataFrame(out, columns=["query_row", "query_id", "vec_id", "score"], dtype="int64")

    return left.cogroup(right).applyInPandas(run, "query_row long, query_id long, vec_id long, score long")


def _ranked(entries: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("query_row").orderBy(F.desc("score"), "vec_id")
    return entries.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


def search(vectors: DataFrame, is_query: Column, k: int = 5, lists: int = 4, id_col: str = "vec_id", vector_col: str = "embedding", label: str = "topk") -> DataFrame:
    """query_id, rank, vec_id, score: the k best of all other rows for each query row.

    Ties go to the smaller id; a query with fewer than k candidates has them all.  Rows with a null
    id or an unusable vector take no part.  Every other row is a candidate, also one that repeats the
    query's id, and rows that repeat each other each take a rank.  Vectors of different lengths have
    no score.  Scores beyond a long are held at its ends.  An empty table gives an empty result.
    """
    rows = vectors.filter(usable(F.col(vector_col)) & F.col(id_col).isNotNull()).select(
        F.col(id_col).cast("long").alias("vec_id"), quantised(F.col(vector_col)).alias("vector"), F.coalesce(is_query, F.lit(False)).alias("is_query")
    )
    rows = written(rows.withColumn("row_id", F.monotonically_increasing_id()), label)
    n, n_queries = rows.agg(F.count(F.lit(1)), F.count_if("is_query")).first()
    query_blocks = max(1, -(-n_queries // BLOCK_QUERIES))

    def dealt(n_blocks: int, salt: int) -> Column:
        return F.pmod(F.xxhash64("row_id", F.lit(salt)), F.lit(n_blocks)).cast("int")

    def corpus(of: DataFrame, size: int) -> tuple[DataFrame, int]:
        blocks = max(1, -(-size // BLOCK_ROWS))
        return of.select("row_id", "vec_id", "vector", dealt(blocks, 1).alias("block")), blocks

    queries = rows.filter("is_query").select(
        F.col("row_id").alias("query_row"), F.col("vec_id").alias("query_id"), F.col("vector").alias("wanted"), dealt(query_blocks, 2).alias("query_block")
    )
    some, blocks = corpus(rows.filter(F.pmod(F.xxhash64("row_id", F.lit(3)), F.lit(SLICE)) == 0), -(-n // SLICE))
    seen = _phase(queries.withColumn("cutoff", F.lit(None).cast("long")), some, blocks, query_blocks, k, lists)
    cutoffs = _ranked(seen, k).filter(F.col("rank") == k).select(F.col("query_row").alias("__q"), F.col("score").alias("__cutoff"))
    least = F.coalesce(F.col("__cutoff"), F.lit(-(1 << 63)))  # fewer than k candidates seen: every entry is sufficient
    cutoffs = written(cutoffs, label)
    ready = queries.join(cutoffs, queries["query_row"] == F.col("__q"), "left").select("query_row", "query_id", "wanted", "query_block", least.alias("cutoff"))
    every, blocks = corpus(rows, n)
    found = _phase(ready, every, blocks, query_blocks, k, lists)
    return _ranked(found, k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
