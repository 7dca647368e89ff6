"""Reciprocal rank fusion with provenance, and hybrid retrieval on top of it."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

K = 60


def ranked(scores: DataFrame, source: str) -> DataFrame:
    """(source, id, score, rank) of scores (id, score), best first, ties by id."""
    rows = scores.select(F.lit(source).alias("source"), F.col("id").cast("string").alias("id"), F.col("score").cast("double").alias("score"))
    return rows.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("score"), "id")))


def rrf(rankings: DataFrame, weights: dict[str, float] | None = None, k: int = K, top: int | None = None) -> DataFrame:
    """(id, score, sources) from rankings (source, id, score, rank): the sum of w / (k + rank).

    A source without a weight has 1; no weights at all means equal ones.
    """
    w = F.lit(1.0)
    for name, value in (weights or {}).items():
        w = F.when(F.col("source") == name, float(value)).otherwise(w)
    rows = rankings.withColumn("weight", w)
    entry = F.struct("source", F.struct("rank", "score", "weight"))
    out = rows.groupBy("id").agg(F.sum(F.col("weight") / (k + F.col("rank"))).alias("score"), F.map_from_entries(F.array_sort(F.collect_list(entry))).alias("sources"))
    return out if top is None else out.orderBy(F.desc("score"), "id").limit(top)


def rank_of(rankings: DataFrame, source: str, ident: str) -> DataFrame:
    return rankings.where((F.col("source") == source) & (F.col("id") == ident)).select("rank")


def anchored(edges: DataFrame, anchors: DataFrame, hop: int = 6) -> DataFrame:
    """(id, score, matches, d): features met from anchors (id, repeats kept) and one hop on.

    ``edges`` (src, dst, d) hold both directions. From each feature met, its
    ``hop`` nearest count at d + 0.5; an anchor never counts for itself; per
    anchor the nearest way counts.
    """
    seats = anchors.select(F.col("id").alias("anchor"), F.monotonically_increasing_id().alias("seat"))
    first = seats.join(edges, seats["anchor"] == edges["src"]).select("seat", "anchor", F.col("dst").alias("id"), "d")
    nth = F.row_number().over(Window.partitionBy("src").orderBy("d", "dst"))
    near = edges.withColumn("_n", nth).where(F.col("_n") <= hop).select(F.col("src").alias("id"), F.col("dst").alias("id2"), F.col("d").alias("d2"))
    second = first.join(near, "id").select("seat", "anchor", F.col("id2").alias("id"), (F.col("d2") + 0.5).alias("d"))
    best = first.union(second).where(F.col("id") != F.col("anchor")).groupBy("seat", "id").agg(F.min("d").alias("d"))
    out = best.groupBy("id").agg(F.count(F.lit(1)).alias("matches"), F.min("d").alias("d"))
    return out.select("id", (1 / (1 + F.col("d"))).alias("score"), "matches", "d")
