"""Exact nearest neighbours by cosine, and what is built on them."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from terraloom.functions import vectors as v


def knn(vectors: DataFrame, query: DataFrame, k: int = 8) -> DataFrame:
    """(vec_id, score): the ``k`` nearest to the one vector of ``query``. One row is broadcast; top-k needs no sort of all."""
    one = query.select(F.col("embedding").alias("_q")).limit(1)
    rows = vectors.join(F.broadcast(one)).select("vec_id", F.round(v.dot(F.col("embedding"), F.col("_q")), 5).alias("score"))
    return rows.orderBy(F.desc("score"), "vec_id").limit(k)


BLOCK = 4096  #: vectors, or queries, in one product
CHUNK = 256  #: queries judged at a time
DIGITS = 1e-5  #: scores are rounded to this, so two within it may tie


def _nearest(ids: np.ndarray, m: np.ndarray, asked: np.ndarray, q: np.ndarray, k: int):
    """(query, vec_id, score) of what can be among the ``k`` nearest in a block, scores summed in the order of the plain expression."""
    out = []
    for start in range(0, len(q), CHUNK):
        some = q[start : start + CHUNK]
        near = some @ m.T
        slack = 1.1 * DIGITS + 1e-12 * np.abs(some).sum(1, keepdims=True) * np.abs(m).max()
        least = np.partition(near, len(m) - k, axis=1)[:, len(m) - k, None] - slack if len(m) > k else np.full((len(some), 1), -np.inf)
        i, j = np.nonzero(near >= least)
        exact = np.zeros(len(i))
        for d in range(m.shape[1]):
            exact += m[j, d] * some[i, d]
        order = np.lexsort((ids[j], -exact, i))
        i, j, exact = i[order], j[order], exact[order]
        # Of equal scores the first k ids are enough.
        new = np.r_[True, (i[1:] != i[:-1]) | (exact[1:] != exact[:-1])]
        at = np.arange(len(i)) - np.maximum.accumulate(np.where(new, np.arange(len(i)), 0))
        kept = at < k
        out.append((asked[start : start + CHUNK][i[kept]], ids[j[kept]], exact[kept]))
    return [np.concatenate(x) for x in zip(*out)]


def knn_batch(vectors: DataFrame, queries: DataFrame, k: int = 8) -> DataFrame:
    """(query_id, rank, vec_id, score) for a stated set of queries (query_id, embedding), against all rows.

    Blocks of vectors meet blocks of queries in one product each, and only what
    can be among the ``k`` nearest of a block is exchanged. Vectors that are
    null, of another length or not finite are scored by the plain expression.
    """
    v0, q0 = vectors.select("vec_id", "embedding"), queries.select("query_id", F.col("embedding").alias("_q"))
    n, dim = v0.agg(F.count(F.lit(1)), F.max(F.size("embedding"))).first()
    asked = q0.count()
    number = lambda rows, least: max(least, -(-rows // BLOCK))
    many, few = number(n, min(n // (8 * k) + 1, 3 * vectors.sparkSession.sparkContext.defaultParallelism)), number(asked, 1)
    plain = lambda c: F.coalesce((F.size(c) == int(dim or 0)) & F.forall(c, lambda x: x.isNotNull() & (F.abs(x) < 1e100)), F.lit(False))
    every = lambda count: F.explode(F.sequence(F.lit(0), F.lit(count - 1)))
    left = v0.where(plain(F.col("embedding"))).withColumn("_v", F.pmod(F.hash("vec_id"), F.lit(many))).withColumn("_b", every(few))
    right = q0.where(plain(F.col("_q"))).withColumn("_b", F.pmod(F.hash("query_id"), F.lit(few))).withColumn("_v", every(many))
    kinds = {"query_id": q0.schema["query_id"].dataType.simpleString(), "vec_id": v0.schema["vec_id"].dataType.simpleString()}

    def block(a: pa.Table, b: pa.Table) -> pa.Table:
        dense = lambda c: c.combine_chunks().flatten().to_numpy(zero_copy_only=False).astype(float).reshape(len(c), -1)
        found = [b["query_id"].to_numpy()[:0], a["vec_id"].to_numpy()[:0], np.empty(0)]
        if len(a) and len(b):
            found = _nearest(a["vec_id"].to_numpy(), dense(a["embedding"]), b["query_id"].to_numpy(), dense(b["_q"]), k)
        return pa.table({"query_id": pa.array(found[0], b["query_id"].type), "vec_id": pa.array(found[1], a["vec_id"].type), "_s": pa.array(found[2], pa.float64())})

    near = left.groupBy("_v", "_b").cogroup(right.groupBy("_v", "_b")).applyInArrow(block, f"query_id {kinds['query_id']}, vec_id {kinds['vec_id']}, _s double")
    by_hand = lambda rows: rows.select("query_id", "vec_id", v.dot(F.col("embedding"), F.col("_q")).alias("_s"))
    odd, odd_q = v0.where(~plain(F.col("embedding"))), q0.where(~plain(F.col("_q")))
    rest = by_hand(odd.crossJoin(q0)).union(by_hand(v0.where(plain(F.col("embedding"))).crossJoin(odd_q)))
    rows = near.union(rest).select("query_id", "vec_id", F.round("_s", 5).alias("score"))
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return rows.select("query_id", rank.alias("rank"), "vec_id", "score").where(F.col("rank") <= k)


def max_pool(hits: DataFrame, by: str) -> DataFrame:
    """(id, score): the best score of each source."""
    return hits.groupBy(F.col(by).alias("id")).agg(F.max("score").alias("score"))
