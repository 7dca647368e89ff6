"""Properties and hand cases of the operators."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from terraloom.functions import geometry as g, text as t
from terraloom.operators import field, fusion, graph, mesh, raster, spatial, text
from terraloom.plans import fields
from terraloom.sources import store
from terraloom.streaming.ingest import upsert_stream

SQUARE = [(0, 0), (2, 0), (2, 2), (0, 2)]


def _features(spark, shapes):
    rows = [(i, d, [(float(x), float(y)) for x, y in p]) for i, (d, p) in enumerate(shapes)]
    raw = spark.createDataFrame(rows, "id int, dim int, pts array<struct<x:double,y:double>>")
    return raw.select("id", g.geometry(F.col("dim"), F.col("pts")).alias("geom"))


@pytest.mark.parametrize(
    "a, b, want",
    [
        ((2, SQUARE), (0, [(1, 1)]), "intersects contains"),
        ((2, SQUARE), (0, [(2, 1)]), "intersects contains"),
        ((2, SQUARE), (0, [(3, 1)]), ""),
        ((2, SQUARE), (1, [(-1, 1), (3, 1)]), "intersects touches"),
        ((2, SQUARE), (2, [(1, 1), (3, 1), (3, 3), (1, 3)]), "intersects overlaps"),
        ((2, SQUARE), (2, [(2, 0), (4, 0), (4, 2), (2, 2)]), "intersects overlaps"),
        ((0, [(1, 1)]), (2, SQUARE), "intersects within"),
        ((1, [(0, 0), (2, 2)]), (1, [(0, 2), (2, 0)]), "intersects touches"),
        ((1, [(0, 0), (1, 0)]), (0, [(0.5, 0)]), "intersects touches"),
    ],
)
def test_predicates(spark, a, b, want):
    f = _features(spark, [a, b])
    pair = f.where("id=0").select(F.col("geom").alias("a")).join(f.where("id=1").select(F.col("geom").alias("b")))
    got = pair.select(*[p(F.col("a"), F.col("b")).alias(n[3:].lower()) for n, p in g.PREDICATES.items()]).first().asDict()
    assert {k for k, v in got.items() if v} == set(want.split())


def test_a_first_vertex_on_the_wide_boundary_is_inside(spark):
    f = _features(spark, [(1, [(2 + 2e-13, 1), (1, 1)]), (2, SQUARE)])
    pair = f.where("id=0").select(F.col("geom").alias("a")).join(f.where("id=1").select(F.col("geom").alias("b")))
    assert pair.select(g.st_intersects(F.col("a"), F.col("b")), g.st_touches(F.col("a"), F.col("b"))).first() == (True, False)


def test_null_geometry_gives_null(spark):
    f = _features(spark, [(0, [(1, 1)])]).select("geom", F.when(F.lit(False), F.col("geom")).alias("none"))
    assert f.select(g.st_intersects(F.col("geom"), F.col("none"))).first()[0] is None


def test_unknown_predicate():
    with pytest.raises(ValueError):
        g.predicate("1=1) OR (1")


def test_spatial_join_is_an_equi_join(spark):
    f = _features(spark, [(2, SQUARE), (0, [(1, 1)])])
    plan = spatial.spatial_join(f, f, "ST_Intersects")._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "CartesianProduct" not in plan


def test_lines_are_judged_apart(spark):
    rng = np.random.default_rng(5)
    lines = [(1, np.cumsum(np.vstack([rng.uniform(0, 3, 2), rng.uniform(-0.2, 0.4, (3, 2))]), 0)) for _ in range(60)]
    f = _features(spark, [(2, SQUARE), (0, [(1, 1)]), (1, [(-1, 1), (3, 1)]), *lines])
    every = f.select(F.struct("*").alias("a")).crossJoin(f.select(F.struct("*").alias("b"))).where("a.id <> b.id")
    other = F.col("a.id") != F.col("b.id")
    for name in ("ST_Intersects", "ST_Touches", "ST_Contains"):
        joined = spatial.spatial_join(f, f, name, other)
        want = sorted(map(tuple, every.where(g.predicate(name)(F.col("a.geom"), F.col("b.geom"))).select("a.id", "b.id").collect()))
        assert want and sorted(map(tuple, joined.select("a.id", "b.id").collect())) == want
        assert name == "ST_Contains" or "explode(_s" in joined._jdf.queryExecution().executedPlan().toString()


def test_chunks(spark):
    got = spark.createDataFrame([("One. Two! Three?",), ("",), ("x" * 300,)], "s string").select(t.chunks(F.col("s"), 10).alias("c")).collect()
    assert [r["c"] for r in got] == [["One. Two!", "Three?"], [""], ["x" * 300]]


def test_chunks_keep_digits_at_the_ends_of_sentences(spark):
    got = spark.createDataFrame([("0997 is a number. 1 more  . No 2",), ("  spaced  ",)], "s string").select(t.chunks(F.col("s"), 10).alias("c")).collect()
    assert [r["c"] for r in got] == [["0997 is a number.", "1 more  .", "No 2"], ["spaced"]]


def test_hashed_embeddings_have_unit_length():
    m = text.blake_embed(["a river and a fault", ""], 64)
    assert np.linalg.norm(m[0]) == pytest.approx(1, abs=1e-6) and not m[1].any()


def test_rrf(spark):
    rows = spark.createDataFrame([("a", "x", 1.0, 1), ("a", "y", 0.5, 2), ("b", "y", 3.0, 1)], "source string, id string, score double, rank int")
    got = {r["id"]: r for r in fusion.rrf(rows, {"b": 2.0}).collect()}
    assert got["y"]["score"] == pytest.approx(1 / 62 + 2 / 61) and got["y"]["sources"]["b"]["weight"] == 2.0


def test_message_passing_matches_numpy(spark):
    rng = np.random.default_rng(0)
    h = rng.normal(size=(6, 4))
    nodes = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(h)], "id int, h array<double>")
    links = [(0, 1, "similar"), (2, 1, "abuts"), (3, 4, "mentions"), (1, 0, "similar")]
    between, own = graph.weights(4, 2, 5)
    want = h.copy()
    for w, s in zip(between, own):
        agg, n = np.zeros_like(want), np.zeros((6, 1))
        for a, b, r in links:
            agg[b] += want[a] @ w[r]
            n[b] += 1
        want = want + 0.45 * np.tanh((agg / np.maximum(n, 1) + want @ s) / math.sqrt(2))
    edges = spark.createDataFrame(links, "src int, dst int, rel string")
    got = {r["id"]: r["h"] for r in graph.propagate(nodes, edges, between, own).collect()}
    wide = {r["id"]: r["h"] for r in graph.propagate_wide(nodes, edges, 4, 2, 5).collect()}
    for i in range(6):
        assert got[i] == pytest.approx(want[i].tolist(), abs=1e-6)
        assert wide[i] == pytest.approx((want[i] / np.linalg.norm(want[i])).tolist(), abs=1e-6)


def test_harmonics_are_orthonormal(spark):
    x, w = np.polynomial.legendre.leggauss(12)
    rows = [(float(np.arccos(c)), 2 * math.pi * k / 24, float(v) * 2 * math.pi / 24) for c, v in zip(x, w) for k in range(24)]
    d = spark.createDataFrame(rows, "th double, ph double, w double")
    y = list(raster.harmonics(F.col("th"), F.col("ph"), 3).values())
    got = d.select(*[c.alias(f"y{k}") for k, c in enumerate(y)], "w").toPandas()
    m = got[[f"y{k}" for k in range(len(y))]].to_numpy()
    assert np.allclose(m.T @ (m * got["w"].to_numpy()[:, None]), np.eye(len(y)), atol=1e-10)


def test_rounding_is_that_of_the_sql(spark):
    duckdb = pytest.importorskip("duckdb")
    values = [0.5158035, -0.5158035, 0.0000005, -0.0000004, 1.0000015, 2.5, None]  # 0.5158035 * 1e6 lies below its half
    got = [r[0] for r in spark.createDataFrame([(v,) for v in values], "v double").select(fields._rounded("v")).collect()]
    assert got == [duckdb.execute("SELECT round(CAST(? AS double), 6) + 0.0", [v]).fetchone()[0] for v in values]
    assert got[0] == 0.515803


def test_water_is_kept():
    h = np.random.default_rng(1).normal(size=(12, 12))
    for compat in (False, True):
        assert field._flow(h, 0.02, 5, compat).sum() == pytest.approx(0.02 * 144 * 5)


def test_thermal_creep_keeps_mass_and_lowers_peaks():
    h = np.zeros((9, 9))
    h[4, 4] = 1
    out = field.thermal(h, 3)
    assert out.sum() == pytest.approx(1) and out[4, 4] < 1 and field.thermal(h, 1, compat=True)[4, 4] > 1


def test_tetrahedra_close_a_sphere():
    x = np.stack(np.meshgrid(*[np.arange(12)] * 3, indexing="ij"), -1) - 5.5
    f = np.linalg.norm(x, axis=-1) - 3.7
    v, t_ = mesh.tetrahedra(f)
    p = v[t_]
    volume = np.einsum("ij,ij->i", p[:, 0], np.cross(p[:, 1], p[:, 2])).sum() / 6
    sides = np.concatenate([t_[:, [0, 1]], t_[:, [1, 2]], t_[:, [2, 0]]])
    assert len(np.unique(sides, axis=0)) == len(sides) and volume == pytest.approx(4 / 3 * math.pi * 3.7**3, rel=0.05)


def test_upserts(spark):
    old = spark.createDataFrame([("a", "old", "1"), ("b", "old", "1")], "id string, payload string, created_at string")
    new = spark.createDataFrame([("a", "new", "2"), ("c", "new", "2")], "id string, payload string, created_at string")
    got = {r["id"]: (r["payload"], r["created_at"]) for r in store.upsert_scenes(old, new).collect()}
    assert got == {"a": ("new", "1"), "b": ("old", "1"), "c": ("new", "2")}


def test_stream_upsert(spark, tmp_path):
    schema = "id string, name string, seq long"
    for n, rows in enumerate(([("a", "1", 1), ("b", "1", 1)], [("a", "2", 2)])):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        upsert_stream(spark.readStream.schema(schema).parquet(str(tmp_path / "in")), str(tmp_path / "out"), str(tmp_path / "cp"), ["id"], "seq").awaitTermination()
    last = sorted(p for p in (tmp_path / "out").iterdir() if p.name.startswith("v"))[-1]
    assert {(r["id"], r["name"]) for r in spark.read.parquet(str(last)).collect()} == {("a", "2"), ("b", "1")}
