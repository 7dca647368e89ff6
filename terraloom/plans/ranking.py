"""Text, vector and fusion queries and the SQL they are held against."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from terraloom.functions import props, text as t
from terraloom.operators import fusion, text, vector
from terraloom.plans.catalog import query
from terraloom.sources.fixtures import table

_SENTENCES = r"""SELECT doc_id, text, list_filter(list_transform(string_split(regexp_replace(replace(text,chr(10),' '),'([.!?])\s+','\1'||chr(1),'g'),chr(1)),lambda x: trim(x)),lambda x: x<>'') ss FROM documents"""
CHUNKS_SQL = f"""WITH sn AS ({_SENTENCES}),
fo AS (SELECT doc_id, text, list_reduce(list_prepend({{'done':[]::varchar[],'buf':''}}, list_transform(ss, lambda x: {{'done':[]::varchar[],'buf':x}})),
     lambda a,x: CASE WHEN a.buf<>'' AND length(a.buf)+1+length(x.buf)>220 THEN {{'done':list_append(a.done,a.buf),'buf':x.buf}} ELSE {{'done':a.done,'buf':trim(a.buf||' '||x.buf)}} END) r FROM sn),
ch AS (SELECT doc_id, text, CASE WHEN r.buf='' THEN r.done ELSE list_append(r.done,r.buf) END c FROM fo),
cc AS (SELECT doc_id, CASE WHEN len(c)>0 THEN c ELSE [substr(text,1,220)] END c FROM ch)"""
_TOKS = "regexp_extract_all(lower({}),'[a-z0-9]+')"


def _docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", "text")


@query("chunk_text", CHUNKS_SQL + " SELECT printf('%d#c%02d', doc_id, i-1) chunk_id, doc_id, CAST(i-1 AS int) pos, c[i] AS text FROM cc, range(1, 100000) q(i) WHERE i <= len(c)")
def chunk_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return text.chunk_table(_docs(spark, sf_dir))


@query("tokenize", f"SELECT doc_id, w, count(*) n FROM (SELECT doc_id, unnest({_TOKS.format('text')}) w FROM documents) GROUP BY doc_id, w")
def tokenize(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _docs(spark, sf_dir).select("doc_id", F.explode(t.tokens(F.col("text"))).alias("w"))
    return rows.groupBy("doc_id", "w").agg(F.count(F.lit(1)).alias("n"))


_STOP = "(" + ",".join(f"'{w}'" for w in t.STOPWORDS) + ")"
FEATURES_SQL = f"""WITH tk AS (SELECT doc_id, {_TOKS.format('text')} ts FROM documents),
tt AS (SELECT doc_id, i, ts[i] tok, ts[i+1] nxt FROM (SELECT doc_id, ts, unnest(range(1, len(ts)+1)) i FROM tk)),
sw AS (SELECT *, CASE WHEN tok IN {_STOP} THEN CAST(0.35 AS double) ELSE CAST(1 AS double) END soft FROM tt),
ft AS (SELECT doc_id, 'w:'||tok f, 2/sqrt(1+ln(CAST(1+i AS double)))*soft w FROM sw
       UNION ALL SELECT doc_id, 'b:'||tok||'_'||nxt, CAST(0.7 AS double)*soft FROM sw WHERE nxt IS NOT NULL
       UNION ALL SELECT doc_id, 'c:'||substr('^'||tok||'$', j, 3), CAST(0.18 AS double)*soft FROM (SELECT *, unnest(range(1, length(tok)+1)) j FROM sw))"""


@query("ngram_features", FEATURES_SQL + " SELECT doc_id, f, count(*) n, round(sum(w),6) w FROM ft GROUP BY doc_id, f")
def ngram_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    return text.feature_rows(_docs(spark, sf_dir)).withColumn("w", F.round("w", 6))


@query(
    "embed_hash_md5",
    FEATURES_SQL
    + """, hs AS (SELECT doc_id, CAST(('0x'||substr(md5(f),1,12)) AS bigint) % 1536 idx, CASE WHEN substr(md5(f),13,1) >= '8' THEN w ELSE -w END w FROM ft),
sm AS (SELECT doc_id, idx, sum(w) v FROM hs GROUP BY doc_id, idx) SELECT doc_id, idx, round(v/sqrt(sum(v*v) OVER (PARTITION BY doc_id)),5)+0.0 v FROM sm""",
)
def embed_hash_md5(spark: SparkSession, sf_dir: str) -> DataFrame:
    return text.embed_md5(_docs(spark, sf_dir)).select("doc_id", "idx", (F.round("v", 5) + F.lit(0.0)).alias("v"))


@query("embed_hash_blake2b")
def embed_hash_blake2b(spark: SparkSession, sf_dir: str) -> DataFrame:
    return text.embed_blake2b(_docs(spark, sf_dir))


_PROPS = "SELECT s_suppkey id, CAST(s_suppkey*37 % 6000 AS double) elevation_m, CAST(s_suppkey*11 % 10 AS double) hardness, CASE WHEN s_suppkey % 3 = 0 THEN CAST(s_suppkey*13 % 4000 AS double) END transmissivity, CASE WHEN s_suppkey % 2 = 0 THEN CAST(s_suppkey*7 % 2000 AS double) END permeability, CASE WHEN s_suppkey % 5 > 0 THEN CAST(s_suppkey*17 % 9000 AS double) END vp FROM supplier"
_BACK = "coalesce(permeability,0)"


@query(
    "props_vector",
    f"WITH p AS ({_PROPS}) SELECT id, round(least(greatest(elevation_m/6000,0),2),6) elevation_m, round(least(greatest({_BACK}/3500,0),2),6) relief_m, round(least(greatest(hardness/10,0),2),6) hardness, round(least(greatest({_BACK}/1200,0),2),6) rainfall_mm, round(least(greatest({_BACK}/8,0),2),6) uplift_mm_yr, round(least(greatest({_BACK},0),2),6) roughness, round(least(greatest(coalesce(vp,permeability,0)/7000,0),2),6) vp_ms, round(least(greatest(coalesce(transmissivity,permeability,0)/1500,0),2),6) perm_mD FROM p",
)
def props_vector(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All eight scaled properties; a missing one falls back on permeability."""
    table(spark, sf_dir, "supplier").createOrReplaceTempView("supplier")
    names = {"elevation_m": "elevation_m", "hardness": "hardness", "transmissivity_mDm": "transmissivity", "permeability_mD": "permeability", "vp_ms": "vp"}
    held = F.create_map(*[x for k, c in names.items() for x in (F.lit(k), F.col(c))])
    rows = spark.sql(_PROPS).select("id", props.vector(held).alias("v"))
    return rows.select("id", *[F.round(F.col("v")[i], 6).alias(k) for i, k in enumerate(props.PROP_KEYS)])


QUERY = "the on le the"
BM25_SQL = r"""WITH tk AS (SELECT doc_id, list_transform(regexp_extract_all(lower(text),'[\p{L}\p{M}\p{N}]+'), lambda x: strip_accents(x)) ts FROM documents),
nm AS (SELECT CAST(count(*) AS double) nd, avg(CAST(len(ts) AS double)) avgdl FROM tk),
tf AS (SELECT doc_id, dl, term, CAST(count(*) AS double) f FROM (SELECT doc_id, CAST(len(ts) AS double) dl, unnest(ts) term FROM tk) WHERE term IN ('the','on','le') GROUP BY ALL),
df AS (SELECT term, CAST(count(*) AS double) n FROM tf GROUP BY term),
bm AS (SELECT doc_id, round(sum(greatest(ln((nd-n+CAST(0.5 AS double))/(n+CAST(0.5 AS double))),CAST(1e-6 AS double))*f*CAST(2.2 AS double)/(f+CAST(1.2 AS double)*(CAST(0.25 AS double)+CAST(0.75 AS double)*dl/avgdl))*CASE WHEN term='the' THEN 2 ELSE 1 END),6) score FROM tf JOIN df USING(term), nm GROUP BY doc_id)"""


def _bm25(spark: SparkSession, sf_dir: str) -> DataFrame:
    return text.bm25(_docs(spark, sf_dir), QUERY).withColumn("score", F.round("score", 6))


@query("fulltext_bm25", BM25_SQL + " SELECT doc_id, score FROM bm ORDER BY score DESC, doc_id LIMIT 20")
def fulltext_bm25(spark: SparkSession, sf_dir: str) -> DataFrame:
    return text.top(_bm25(spark, sf_dir), 20)


_COS = "round(list_inner_product(e.embedding::double[], q.embedding::double[]),5)"
KNN_SQL = f"SELECT e.vec_id, {_COS} score FROM embeddings e, (SELECT embedding FROM embeddings WHERE vec_id=0) q ORDER BY score DESC, vec_id"


def _vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings")


@query("knn_exact", KNN_SQL + " LIMIT 20")
def knn_exact(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = _vectors(spark, sf_dir)
    return vector.knn(e, e.where("vec_id = 0"), 20)


@query(
    "knn_batch",
    f"SELECT query_id, CAST(rank AS int) rank, vec_id, score FROM (SELECT q.vec_id query_id, e.vec_id, {_COS} score, row_number() OVER (PARTITION BY q.vec_id ORDER BY {_COS} DESC, e.vec_id) rank FROM embeddings e, embeddings q WHERE q.vec_id % 50 = 0) WHERE rank <= 8",
)
def knn_batch(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every fiftieth vector is a query against all rows."""
    e = _vectors(spark, sf_dir)
    return vector.knn_batch(e, e.where("vec_id % 50 = 0").select(F.col("vec_id").alias("query_id"), "embedding"))


@query("source_maxpool", f"SELECT label id, max(score) score FROM (SELECT label, {_COS} score FROM embeddings e, (SELECT embedding FROM embeddings WHERE vec_id=0) q) GROUP BY label")
def source_maxpool(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = _vectors(spark, sf_dir)
    one = e.where("vec_id = 0").select(F.col("embedding").alias("q"))
    from terraloom.functions.vectors import dot

    return vector.max_pool(e.join(F.broadcast(one)).select("label", F.round(dot(F.col("embedding"), F.col("q")), 5).alias("score")), "label")


RRF_SQL = (
    BM25_SQL
    + f""", kn AS ({KNN_SQL} LIMIT 50), lx AS (SELECT doc_id, score FROM bm ORDER BY score DESC, doc_id LIMIT 50),
rk AS (SELECT 'vector' source, CAST(vec_id AS varchar) id, score, CAST(row_number() OVER (ORDER BY score DESC, CAST(vec_id AS varchar)) AS int) rank, CAST(1 AS double) w FROM kn
       UNION ALL SELECT 'lexical', CAST(doc_id AS varchar), score, CAST(row_number() OVER (ORDER BY score DESC, CAST(doc_id AS varchar)) AS int), CAST(0.5 AS double) FROM lx)"""
)


def _rankings(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = _vectors(spark, sf_dir)
    near = vector.knn(e, e.where("vec_id = 0"), 50).select(F.col("vec_id").alias("id"), "score")
    words = text.top(_bm25(spark, sf_dir), 50).select(F.col("doc_id").alias("id"), "score")
    return fusion.ranked(near, "vector").union(fusion.ranked(words, "lexical"))


@query("rrf_fuse", RRF_SQL + " SELECT id, round(sum(w/(60+rank)),9) score FROM rk GROUP BY id ORDER BY score DESC, id LIMIT 20")
def rrf_fuse(spark: SparkSession, sf_dir: str) -> DataFrame:
    fused = fusion.rrf(_rankings(spark, sf_dir), {"vector": 1.0, "lexical": 0.5}).select("id", F.round("score", 9).alias("score"))
    return fused.orderBy(F.desc("score"), "id").limit(20)


@query("rrf_provenance", RRF_SQL + " SELECT id, source, rank, score, w weight FROM rk")
def rrf_provenance(spark: SparkSession, sf_dir: str) -> DataFrame:
    fused = fusion.rrf(_rankings(spark, sf_dir), {"vector": 1.0, "lexical": 0.5})
    return fused.select("id", F.explode("sources").alias("source", "p")).select("id", "source", "p.rank", "p.score", "p.weight")


@query("rank_of", RRF_SQL + " SELECT rank FROM rk WHERE source='vector' AND id='0'")
def rank_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fusion.rank_of(_rankings(spark, sf_dir), "vector", "0")
