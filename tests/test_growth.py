"""Steps whose time or memory once grew faster than their input: the same results by brute force, and the shape of their plans."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from terraloom.functions import text as t, vectors as v
from terraloom.operators import graph, text, vector


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_similar_texts_by_brute_force(spark):
    rng = np.random.default_rng(3)
    words = [a + b + "xyzw" for a in "abcdef" for b in "ghijkl"]
    texts = [(i, " ".join(rng.choice(words, rng.integers(0, 9)))) for i in range(120)]
    sets = [set(x.split()) for _, x in texts]
    want = {(a, b): min(1.0, len(sets[a] & sets[b]) / 8) for a in range(120) for b in range(a + 1, 120) if len(sets[a] & sets[b]) >= 3}
    edges = graph.similar(spark.createDataFrame(texts, "id long, text string"))
    assert want and {(r["src"], r["dst"]): r["weight"] for r in edges.collect()} == want
    assert "bit_count" in _plan(edges)


def test_knn_batch_by_brute_force(spark):
    rng = np.random.default_rng(4)
    m = rng.normal(size=(90, 6)).astype(np.float32)
    m[40:70] = m[3]  # copies: ties by id
    rows = [(i, x.tolist()) for i, x in enumerate(m)] + [(90, None), (91, [1.0, None, 0.0, 0.0, 0.0, 0.0]), (92, [float("inf")] + [0.0] * 5)]
    e = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    asked = e.where("vec_id % 10 = 0").select(F.col("vec_id").alias("query_id"), "embedding")
    scored = e.crossJoin(asked.withColumnRenamed("embedding", "q")).select("query_id", "vec_id", F.round(v.dot(F.col("embedding"), F.col("q")), 5).alias("score")).collect()
    want = []
    for q in {r["query_id"] for r in scored}:
        mine = sorted((r for r in scored if r["query_id"] == q), key=lambda r: (r["score"] is None, 0 if r["score"] is None else -r["score"] if r["score"] == r["score"] else -np.inf, r["vec_id"]))
        want += [(q, n + 1, r["vec_id"]) for n, r in enumerate(mine[:8])]
    found = vector.knn_batch(e, asked)
    assert sorted((r["query_id"], r["rank"], r["vec_id"]) for r in found.where("query_id < 90").collect()) == sorted(x for x in want if x[0] < 90)
    assert "FlatMapCoGroupsInArrow" in _plan(found)


def test_slices_bound_rows_and_characters():
    texts = ["a" * 30] * 10 + ["b" * 500] + [None, "c"]
    parts = list(text.slices(texts, rows=4, chars=100))
    assert [i for s, n in parts for i in range(s, s + n)] == list(range(len(texts)))
    assert all(n <= 4 and (n == 1 or sum(len(x or "") for x in texts[s : s + n]) <= 100) for s, n in parts)


def test_feature_rows_are_the_features(spark):
    docs = spark.createDataFrame([(1, "The river and the fault, the river."), (2, ""), (3, None), (4, "a"), (1, "river bed")], "doc_id long, text string")
    got = text.feature_rows(docs)
    want = docs.select("doc_id", F.explode(t.features(F.col("text"))).alias("e")).groupBy("doc_id", "e.f").agg(F.count(F.lit(1)).alias("n"), F.sum("e.w").alias("w")).collect()
    mine = {(r["doc_id"], r["f"]): (r["n"], r["w"]) for r in got.collect()}
    assert set(mine) == {(r["doc_id"], r["f"]) for r in want} and len(mine) == got.count()
    assert all(mine[r["doc_id"], r["f"]] == (r["n"], pytest.approx(r["w"], abs=1e-12)) for r in want)


def test_occurrences_are_the_matching_words(spark):
    texts = ["The thé other bathe THE, the_end 3the", "on-on le.Le lé", "", "no hit"]
    low = F.lower("s")
    got = spark.createDataFrame([(x,) for x in texts], "s string").select(t.occurrences(low, ["the", "le"]).alias("o"), t.word_count(low).alias("n"), F.size(t.words(F.col("s"))).alias("w"), F.filter(t.words(F.col("s")), lambda x: t.matches(x, "the") | t.matches(x, "le")).alias("m")).collect()
    assert [r["o"] for r in got] == [r["m"] for r in got] and [r["n"] for r in got] == [r["w"] for r in got]
    assert got[0]["o"] == ["the", "thé", "the", "the"]


def test_distance_draws_no_root_for_each_pair_of_samples(spark):
    from terraloom.functions import geometry as g

    rows = spark.createDataFrame([(1, [(0.0, 0.0), (1.0, 0.0)], [(3.0, 1.0)])], "d int, p array<struct<x:double,y:double>>, q array<struct<x:double,y:double>>")
    pair = rows.select(g.st_distance(g.geometry(F.col("d"), F.col("p")), g.geometry(F.lit(0), F.col("q"))).alias("m"))
    assert "hypot" not in _plan(pair).lower()
    east = np.radians(2) * np.cos(np.radians(0.5)) * g.EARTH_M
    assert pair.first()[0] == pytest.approx(np.hypot(east, np.radians(1) * g.EARTH_M))
