"""The grounding pass: chunks by vector, features by space, nodes by graph, fused and enriched.

Everything is lazy DataFrames. Work starts from the few chunks found: space is
joined from their sources outwards, and of the graph's ranking only the ranks
that can count are computed, by one pass over the scores.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from terraloom.functions import props as p
from terraloom.operators import fusion, graph, spatial, text, vector
from terraloom.settings import Settings
from terraloom.sources.store import stored

ANCHORS = 5
CONTENT = 64  #: coordinates of a node that come from its text


def budget(top_k: int) -> int:
    """How many chunks are looked at for ``top_k`` results."""
    return max(3 * top_k, 12)


def ranks(scores: DataFrame, some: DataFrame) -> DataFrame:
    """(id, score, rank) of the ids in ``some`` among all of ``scores`` (id, score), best first, ties by id.

    ``some`` is small (results and their neighbours): every score is compared
    with those, counted on the spot, and nothing is sorted.
    """
    few = scores.join(some.select("id").distinct(), "id", "left_semi").select(F.col("id").alias("_id"), F.col("score").alias("_score"))
    before = (F.col("score") > F.col("_score")) | ((F.col("score") == F.col("_score")) & (F.col("id") < F.col("_id")))
    counted = scores.join(few, before).groupBy("_id").agg(F.count(F.lit(1)).alias("n"))
    return few.join(counted, "_id", "left").select(F.col("_id").alias("id"), F.col("_score").alias("score"), (F.coalesce("n", F.lit(0)) + 1).cast("int").alias("rank"))


@dataclass
class Grounding:
    """What a pass gives: evidence chunks, the rankings (source, id, score, rank), and the fused, enriched results."""

    evidence: DataFrame
    rankings: DataFrame
    fused: DataFrame


def retrieve(features: DataFrame, hits: DataFrame, nodes: DataFrame, top_k: int = 8, weights: dict[str, float] | None = None, k: int = fusion.K, digits: int | None = None) -> Grounding:
    """The pass over ``hits`` (chunk_id, source_id, score; more columns follow into the evidence), the nearest chunks.

    ``features`` (id, name, kind, geom, ...) and ``nodes`` (id, score), the
    graph's scores for the query. ``digits`` rounds distances in metres, and
    fused scores to six more.
    """
    rounded = lambda c: c if digits is None else F.round(c, digits)
    nth = F.row_number().over(Window.orderBy(F.desc("score"), "chunk_id"))  # over the few hits
    hits = stored(hits.withColumn("_nth", nth))
    by_vector = fusion.ranked(vector.max_pool(hits, "source_id"), "vector")
    anchors = hits.where(F.col("_nth") <= ANCHORS).select(F.col("source_id").alias("id"))
    first = stored(spatial.near(features, anchors))
    beyond = first.select(F.col("dst").alias("id")).distinct().join(anchors.distinct(), "id", "left_anti")
    second = stored(spatial.near(features, beyond))
    met = stored(fusion.anchored(first.union(second).withColumn("d", rounded(F.col("d"))), anchors))
    order = F.row_number().over(Window.orderBy(F.desc("matches"), "d", "id"))  # over what five anchors met
    by_space = met.select(F.lit("spatial").alias("source"), "id", "score", order.alias("rank"))
    nodes = stored(nodes)
    best = nodes.orderBy(F.desc("score"), "id").limit(top_k).select("id")
    by_graph = ranks(nodes, by_vector.select("id").union(by_space.select("id")).union(best)).select(F.lit("gnn").alias("source"), "id", "score", "rank")
    rankings = by_vector.union(by_space).union(by_graph)
    fused = fusion.rrf(rankings, weights, k)
    if digits is not None:
        fused = fused.withColumn("score", F.round("score", digits + 6))
    fused = fused.orderBy(F.desc("score"), "id").limit(top_k)
    known = features.drop("text").join(fused.select("id"), "id", "left_semi")
    fused = fused.join(known, "id", "left").withColumn("name", F.coalesce("name", "id")).withColumn("kind", F.coalesce("kind", F.lit("unknown"))).orderBy(F.desc("score"), "id")
    return Grounding(hits.where(F.col("_nth") <= 2 * top_k).drop("_nth"), rankings, fused)


@dataclass
class KnowledgeGraph:
    """Features (id, name, kind, geom, props, text) and edges (src, dst, rel, weight) with node vectors."""

    features: DataFrame
    edges: DataFrame
    embed: Callable[[list[str]], np.ndarray]
    settings: Settings = field(default_factory=Settings)

    def __post_init__(self):
        rng = np.random.default_rng(self.settings.gnn_seed + 1)
        #: Orthonormal directions that take text vectors to ``CONTENT`` coordinates.
        self.projection = np.linalg.qr(rng.standard_normal((self.settings.embedding_dim, CONTENT)))[0].astype(np.float32)

    def node_features(self) -> DataFrame:
        """(id, h): projected text and scaled properties."""
        embed, projection = self.embed, self.projection

        def run(batches):
            for batch in batches:
                content = np.asarray(embed(batch.column(1).to_pylist()), np.float32) @ projection if batch.num_rows else np.empty((0, CONTENT), np.float32)
                own = np.asarray(batch.column(2).flatten()).reshape(-1, len(p.PROP_KEYS))
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(list(np.hstack([content, own]).astype(float)), pa.list_(pa.float64()))], names=["id", "h"])

        spoken = F.coalesce(F.nullif(F.col("text"), F.lit("")), F.col("name"), F.lit(""))
        return self.features.select("id", spoken.alias("text"), p.vector(F.col("props")).alias("p")).mapInArrow(run, "id string, h array<double>")

    def embeddings(self) -> DataFrame:
        """(id, h) after message passing, of unit length."""
        links = graph.load_edges(self.edges, self.features)
        return graph.propagate_wide(self.node_features(), links, CONTENT + len(p.PROP_KEYS), self.settings.gnn_layers, self.settings.gnn_seed)

    def rank_query(self, query: np.ndarray, embedded: DataFrame | None = None) -> DataFrame:
        """(id, score) of all nodes for a text vector."""
        return graph.rank_query(self.embeddings() if embedded is None else embedded, (np.asarray(query, np.float32).reshape(-1) @ self.projection).tolist())

    def neighbours_of(self, node: str, hops: int = 1) -> DataFrame:
        return graph.k_hop(self.edges, node, hops).select("id")

    def counts(self) -> DataFrame:
        """One row: node_count, edge_count."""
        links = graph.load_edges(self.edges, self.features)
        return self.features.agg(F.count(F.lit(1)).alias("node_count")).join(links.agg(F.count(F.lit(1)).alias("edge_count")))

    def payload(self) -> DataFrame:
        return graph.payload(self.features, self.edges)


@dataclass
class Repository:
    """Everything the grounding pass needs: the graph, and chunks (chunk_id, source_id, source_name, text, embedding)."""

    graph: KnowledgeGraph
    chunks: DataFrame
    settings: Settings = field(default_factory=Settings)

    def retrieve(self, query: str, top_k: int | None = None, embedded: DataFrame | None = None) -> Grounding:
        """The pass for a text; ``embedded`` are stored node vectors, so that they aren't made again."""
        k = top_k or self.settings.top_k
        q = np.asarray(self.graph.embed([query]))[0]
        one = self.chunks.sparkSession.createDataFrame([(q.astype(float).tolist(),)], "embedding array<double>")
        found = vector.knn(self.chunks.withColumnRenamed("chunk_id", "vec_id"), one, budget(k)).withColumnRenamed("vec_id", "chunk_id")
        hits = found.join(self.chunks.drop("embedding"), "chunk_id").withColumn("text", F.substring("text", 1, 240))
        return retrieve(self.graph.features, hits, self.graph.rank_query(q, embedded), k, self.settings.weights(), self.settings.rrf_k)


def seed(features: DataFrame, reports: DataFrame, settings: Settings | None = None) -> Repository:
    """A repository from features (id, name, kind, geojson, props) and reports (id, name, box as "x0,y0,x1,y1", text).

    Reports become features of their own with their box as geometry; edges are
    spatial, mentions and similar words; report texts are chunked and embedded.
    """
    from terraloom.functions import geometry as g

    settings = settings or Settings()
    embed = text.embedder(settings.embedder, settings.embedding_dim)
    own = features.select("id", "name", "kind", g.from_geojson(F.col("geojson")).alias("geom"), "props", p.feature_text(F.col("name"), F.col("kind"), F.col("props")).alias("text"))
    none = F.lit(None).cast(features.schema["props"].dataType)
    told = reports.select("id", "name", F.lit("report").alias("kind"), g.from_box(g.box_from_csv(F.col("box"))).alias("geom"), none.alias("props"), "text")
    every = own.unionByName(told)
    edges = spatial.build_spatial_edges(every, ("ST_Intersects", "ST_Contains", "ST_Touches"))
    edges = edges.unionByName(graph.mentions(told.select("id", "text"), own.select("id", "name"))).unionByName(graph.similar(own.select("id", "text")))
    chunks = text.chunk_table(reports.select(F.col("id").alias("doc_id"), "text"), settings.chunk_size)
    chunks = chunks.join(reports.select(F.col("id").alias("doc_id"), F.col("name").alias("source_name"), "box"), "doc_id")
    chunks = text.embedded(chunks.select("chunk_id", F.col("doc_id").alias("source_id"), "source_name", "text", "box"), embed)
    return Repository(KnowledgeGraph(every, edges, embed, settings), chunks, settings)
