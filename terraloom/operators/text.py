"""Chunk tables, hashed embeddings and lexical ranking."""

from __future__ import annotations

import hashlib
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F, types as T

from terraloom.functions import text as t
from terraloom.sources.store import stored

DIM = 1536
PART = 2 << 20  #: bytes of stored text to a task, where each text makes many rows
SLICE = 256  #: texts embedded at a time at most,
CHARS = 1 << 18  #: and characters, unless one text has more


def chunk_table(docs: DataFrame, size: int = t.CHUNK) -> DataFrame:
    """(chunk_id, doc_id, pos, text) of ``docs`` (doc_id, text)."""
    rows = docs.select("doc_id", F.posexplode(t.chunks(F.col("text"), size)).alias("pos", "text"))
    return rows.select(F.concat(F.col("doc_id").cast("string"), F.format_string("#c%02d", "pos")).alias("chunk_id"), "doc_id", "pos", "text")


def dealt(docs: DataFrame, key: str) -> DataFrame:
    """``docs`` dealt by ``key`` over all cores: a stored text is small beside the work on it, and one file may be one task."""
    size = int(str(docs._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    parts = size // PART if size < 1 << 50 else int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))  # rows that aren't files have no known size
    return docs.repartition(max(3 * docs.sparkSession.sparkContext.defaultParallelism, min(parts, 10_000)), key)


def feature_rows(docs: DataFrame) -> DataFrame:
    """(doc_id, f, n, w): the features of ``t.features`` per document, how often each occurs and their summed weight.

    Documents are dealt by id once, in parts of few texts, so that no feature
    is exchanged; words and pairs are summed first, and a word's trigrams are
    made once for all its places.
    """
    rows = dealt(docs.select("doc_id", "text"), "doc_id").select("doc_id", F.posexplode(t.with_next(t.tokens(F.col("text")))).alias("i", "p")).select("doc_id", "i", "p.t", "p.next")
    soft = F.when(F.col("t").isin(*t.STOPWORDS), 0.35).otherwise(1.0)
    one = F.struct(F.concat(F.lit("w:"), "t").alias("f"), (2.0 / F.sqrt(1 + F.log1p((F.col("i") + 1).cast("double"))) * soft).alias("w"))
    both = F.struct(F.concat(F.lit("b:"), "t", F.lit("_"), "next").alias("f"), (0.7 * soft).alias("w"))
    whole = rows.select("doc_id", F.explode(F.array(one, both)).alias("e")).where(F.col("e.f").isNotNull()).groupBy("doc_id", "e.f").agg(F.count(F.lit(1)).alias("n"), F.sum("e.w").alias("w"))
    word, padded = F.substring("f", 3, 2**31 - 1), F.concat(F.lit("^"), F.substring("f", 3, 2**31 - 1), F.lit("$"))
    weight = F.when(word.isin(*t.STOPWORDS), 0.18 * 0.35).otherwise(0.18) * F.col("n")
    spelt = whole.where(F.col("f").startswith("w:")).select("doc_id", "n", weight.alias("w"), padded.alias("_p"), F.explode(F.sequence(F.lit(1), F.length("f") - 2)).alias("j"))
    grams = spelt.select("doc_id", F.concat(F.lit("c:"), F.substring(F.col("_p"), F.col("j"), F.lit(3))).alias("f"), "n", "w").groupBy("doc_id", "f").agg(F.sum("n").alias("n"), F.sum("w").alias("w"))
    return whole.union(grams)


def embed_md5(docs: DataFrame, dim: int = DIM) -> DataFrame:
    """Sparse hashed embeddings (doc_id, idx, v) of unit length, by md5: all in the JVM, each feature of a document hashed once."""
    rows = feature_rows(docs).select("doc_id", "w", F.md5("f").alias("m"))
    h = F.conv(F.substring("m", 1, 12), 16, 10).cast("long")
    sign = F.when(F.substring("m", 13, 1) >= "8", 1.0).otherwise(-1.0)
    sums = rows.groupBy("doc_id", (h % dim).alias("idx")).agg(F.sum(F.col("w") * sign).alias("v"))
    length = F.sqrt(F.sum(F.col("v") * F.col("v")).over(Window.partitionBy("doc_id")))
    return sums.select("doc_id", "idx", (F.col("v") / F.nullif(length, F.lit(0.0))).alias("v"))


def blake_embed(texts: list[str], dim: int = DIM) -> np.ndarray:
    """Unit hashed embeddings by BLAKE2b, 8 bytes little-endian: index modulo ``dim``, sign from the top bit."""
    import math
    import re

    stop = frozenset(t.STOPWORDS)
    rows: list[int] = []
    names: list[str] = []
    weights: list[float] = []
    for row, text in enumerate(texts):
        toks = re.findall("[a-z0-9]+", (text or "").lower())
        soft = [0.35 if tok in stop else 1.0 for tok in toks]
        here = [f"w:{tok}" for tok in toks] + [f"b:{x}_{y}" for x, y in zip(toks, toks[1:])]
        w = [2 / math.sqrt(1 + math.log1p(i + 1)) * s for i, s in enumerate(soft)] + [0.7 * s for s in soft[: max(0, len(toks) - 1)]]
        for tok, s in zip(toks, soft):
            edge = f"^{tok}$"
            here += [f"c:{edge[j : j + 3]}" for j in range(len(edge) - 2)]
            w += [0.18 * s] * (len(edge) - 2)
        names += here
        weights += w
        rows += [row] * len(here)
    # Each distinct feature is hashed once.
    known: dict[str, int] = {}
    at = np.fromiter((known.setdefault(n, len(known)) for n in names), np.int64, len(names))
    h = np.array([int.from_bytes(hashlib.blake2b(n.encode(), digest_size=8).digest(), "little") for n in known], np.uint64)
    sign = np.where(h >> np.uint64(63), 1.0, -1.0)
    spot = np.array(rows, np.int64) * dim + (h % np.uint64(dim)).astype(np.int64)[at] if names else np.empty(0, np.int64)
    out = np.bincount(spot, np.array(weights) * sign[at], len(texts) * dim).reshape(len(texts), dim).astype(np.float32) if names else np.zeros((len(texts), dim), np.float32)
    length = np.linalg.norm(out, axis=1, keepdims=True)
    return np.divide(out, length, out=out, where=length > 0)


def slices(texts: list[str], rows: int = SLICE, chars: int = CHARS):
    """(start, length) of runs of texts that are bounded in number and characters; a longer text stands alone."""
    start = held = 0
    for i, text in enumerate(texts):
        if i > start and (i - start >= rows or held + len(text or "") > chars):
            yield start, i - start
            start, held = i, 0
        held += len(text or "")
    if len(texts) > start:
        yield start, len(texts) - start


def embed_blake2b(docs: DataFrame, dim: int = DIM) -> DataFrame:
    """Dense hashed embeddings (doc_id, embedding) by BLAKE2b, which Spark lacks: Arrow batches."""

    def run(batches):
        for batch in batches:
            texts = batch.column(1).to_pylist()
            for start, n in slices(texts):
                m = blake_embed(texts[start : start + n], dim)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(start, n), pa.array(list(m), pa.list_(pa.float32()))], names=["doc_id", "embedding"])

    return dealt(docs.select("doc_id", "text"), "doc_id").mapInArrow(run, "doc_id long, embedding array<float>")


def bm25(docs: DataFrame, query: str, columns: tuple[str, ...] = ("text",), key: str = "doc_id", k1: float = 1.2, b: float = 0.75) -> DataFrame:
    """(key, score) of rows that hold any query word; repeated words count again, rare ones at least 1e-6."""
    terms = [t.bare(w) for w in t.query_terms(query)]
    low = [F.lower(F.coalesce(F.col(c), F.lit(""))) for c in columns]
    # Texts are read once; the words of the query are found by one pattern, and no other word becomes a value.
    hits = F.concat(*[t.occurrences(c, terms) for c in low])
    length = sum((t.word_count(c) for c in low[1:]), t.word_count(low[0])).cast("double")
    return scored(stored(dealt(docs.select(key, *columns), key).select(key, length.alias("dl"), hits.alias("hits"))), terms, key, k1, b)


def scored(rows: DataFrame, terms: list[str], key: str, k1: float = 1.2, b: float = 0.75) -> DataFrame:
    """(key, score) of rows (key, dl, hits): a text's length in words and the words in it that match the query's."""
    stats = rows.agg(F.count(F.lit(1)).cast("double").alias("nd"), F.avg("dl").alias("avgdl"))
    which = F.coalesce(*[F.when(t.matches(F.col("word"), w), w) for w in sorted(set(terms))], F.lit(None).cast("string"))
    found = rows.where(F.size("hits") > 0).select(key, "dl", F.explode("hits").alias("word")).select(key, "dl", which.alias("term")).where(F.col("term").isNotNull())
    tf = found.groupBy(key, "dl", "term").agg(F.count(F.lit(1)).cast("double").alias("f"))
    return weighed(tf, stats, terms, key, k1, b)


def weighed(tf: DataFrame, stats: DataFrame, terms: list[str], key: str, k1: float, b: float) -> DataFrame:
    """BM25 of (key, dl, term, f) with one row of stats (nd, avgdl)."""
    df = tf.groupBy("term").agg(F.count(F.lit(1)).cast("double").alias("n"))  # at most as many rows as query words
    times = F.element_at(F.create_map(*[x for w in sorted(set(terms)) for x in (F.lit(w), F.lit(float(terms.count(w))))]), F.col("term"))
    rows = tf.join(F.broadcast(df), "term").join(F.broadcast(stats))
    idf = F.greatest(F.log((F.col("nd") - F.col("n") + 0.5) / (F.col("n") + 0.5)), F.lit(1e-6))
    part = idf * F.col("f") * (k1 + 1) / (F.col("f") + k1 * (1 - b + b * F.col("dl") / F.col("avgdl")))
    return rows.groupBy(key).agg(F.sum(part * times).alias("score"))


SHARDS = 64  #: of an index, by word


def build_index(docs: DataFrame, path: str, columns: tuple[str, ...] = ("text",), key: str = "doc_id") -> None:
    """A full-text index under ``path``: postings (word, key, f) by shard of the word, and lengths (key, dl)."""
    toks = F.concat(*[t.words(F.coalesce(F.col(c), F.lit(""))) for c in columns])
    rows = docs.select(F.col(key).alias("key"), toks.alias("toks"))
    rows.select("key", F.size("toks").cast("double").alias("dl")).write.mode("overwrite").parquet(f"{path}/lengths")
    words = rows.select("key", F.explode("toks").alias("word")).groupBy("word", "key").agg(F.count(F.lit(1)).cast("double").alias("f"))
    # A word's shard goes by its plain form, so that accents don't part it.
    words.withColumn("shard", F.pmod(F.crc32(F.substring("word", 1, 1).cast("binary")), F.lit(SHARDS)).cast("int")).repartition("shard", "word").sortWithinPartitions("word").write.mode("overwrite").partitionBy("shard").parquet(f"{path}/postings")


def search_index(spark, path: str, query: str, key: str = "doc_id", k1: float = 1.2, b: float = 0.75) -> DataFrame:
    """(key, score) like ``bm25``, from a stored index: only the shards of the query's first letters are read."""
    import zlib

    terms = [t.bare(w) for w in t.query_terms(query)]
    firsts = {c for w in terms for c in t._accented().get(w[:1], w[:1])}
    shards = sorted({zlib.crc32(c.encode()) % SHARDS for c in firsts})
    post = spark.read.parquet(f"{path}/postings").where(F.col("shard").isin(shards))
    which = F.coalesce(*[F.when(t.matches(F.col("word"), w), w) for w in sorted(set(terms))], F.lit(None).cast("string"))
    found = post.select("key", which.alias("term"), "f").where(F.col("term").isNotNull())
    lengths = spark.read.parquet(f"{path}/lengths")
    tf = found.groupBy("key", "term").agg(F.sum("f").alias("f")).join(lengths, "key")
    return weighed(tf.withColumnRenamed("key", key), lengths.agg(F.count(F.lit(1)).cast("double").alias("nd"), F.avg("dl").alias("avgdl")), terms, key, k1, b)


#: Embedders by name: texts and a width to unit vectors. Those behind a network need a client that isn't here.
EMBEDDERS = {"local": blake_embed}


def embedder(name: str = "local", dim: int = DIM):
    """A function of texts to vectors."""
    if name not in EMBEDDERS:
        raise ValueError(f"embedder {name!r} isn't available; one of {', '.join(EMBEDDERS)}")
    return partial(EMBEDDERS[name], dim=dim)


def embedded(rows: DataFrame, embed, text: str = "text") -> DataFrame:
    """``rows`` with the embedding of their ``text``."""
    kept = [f for f in rows.schema.fields if f.name != "embedding"]
    at = [f.name for f in kept].index(text)

    def run(batches):
        for batch in batches:
            texts = [x or "" for x in batch.column(at).to_pylist()]
            for start, n in slices(texts):
                m = embed(texts[start : start + n])
                yield pa.RecordBatch.from_arrays([*batch.slice(start, n).columns, pa.array(list(m), pa.list_(pa.float32()))], names=[f.name for f in kept] + ["embedding"])

    return rows.select(*[f.name for f in kept]).mapInArrow(run, T.StructType([*kept, T.StructField("embedding", T.ArrayType(T.FloatType()))]))


def top(ranking: DataFrame, k: int, key: str = "doc_id") -> DataFrame:
    return ranking.orderBy(F.desc("score"), key).limit(k)
