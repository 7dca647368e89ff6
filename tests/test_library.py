"""The composed parts of the library on small cases: SQL names, seeding and retrieval, index, stores, operator network, terrain."""

import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from terraloom.functions import geometry as g, props, sql
from terraloom.operators import field, mesh, neural, raster, retrieval, spatial, text
from terraloom.settings import Settings

SQUARE = {"type": "Polygon", "coordinates": [[[0, 0], [2, 0], [2, 2], [0, 2], [0, 0]]]}


def test_sql_names(spark):
    assert set(sql.register(spark)) >= {"ST_Intersects", "ST_Contains", "ST_Within", "ST_Touches", "ST_Overlaps", "ST_Distance", "ST_Area", "ST_Length", "ST_Centroid"}
    rows = [("sq", json.dumps(SQUARE)), ("bare", json.dumps({"type": "Polygon", "coordinates": SQUARE["coordinates"][0]})), ("pt", '{"type":"Point","coordinates":[1, 1]}'), ("far", '{"type":"Point","coordinates":[9, 9]}'), ("ln", '{"type":"LineString","coordinates":[[-1,1],[3,1]]}'), ("bad", "{"), ("odd", '{"type":"MultiPoint","coordinates":[[1,1]]}'), ("none", None)]
    spark.createDataFrame(rows, "id string, js string").createOrReplaceTempView("shapes")
    spark.sql("SELECT id, ST_GeomFromGeoJSON(js) geom FROM shapes").createOrReplaceTempView("geoms")
    met = spark.sql("SELECT b.id, ST_Intersects(a.geom, b.geom) i, ST_Contains(a.geom, b.geom) c, ST_Within(b.geom, a.geom) w, ST_Touches(a.geom, b.geom) t, ST_Distance(a.geom, b.geom) d FROM geoms a JOIN geoms b ON a.id = 'sq'")
    got = {r["id"]: r for r in met.collect()}
    assert (got["pt"]["i"], got["pt"]["c"], got["pt"]["w"]) == (True, True, True) and not got["far"]["i"] and got["ln"]["i"] and got["ln"]["t"]
    assert got["bare"]["i"] and got["bare"]["c"] and all(got[k]["i"] is None for k in ("bad", "odd", "none"))
    one = spark.sql("SELECT ST_Area(geom) a, ST_Length(geom) l, ST_Centroid(geom).x x FROM geoms WHERE id = 'sq'").first()
    assert one["a"] == pytest.approx(4 * 111195.08**2 * np.cos(np.radians(1)), rel=1e-4) and one["l"] == 0 and one["x"] == pytest.approx(0.8)
    back = spark.table("geoms").where("id = 'ln'").select(g.to_geojson(F.col("geom")).alias("j")).first()["j"]
    assert json.loads(back) == {"type": "LineString", "coordinates": [[-1.0, 1.0], [3.0, 1.0]]}


def test_empty_geometries(spark):
    pts = "array<struct<x:double,y:double>>"
    rows = spark.createDataFrame([(d, e, [] if e else ([(1.0, 1.0)] if d == 0 else [(0.0, 0.0), (2.0, 0.0), (2.0, 2.0)])) for d in (0, 1, 2) for e in (True, False)], f"dim int, empty boolean, pts {pts}")
    f = rows.select("dim", "empty", F.concat("dim", "empty").alias("id"), g.geometry(F.col("dim"), F.col("pts")).alias("geom"))
    pair = f.alias("a").join(f.alias("b"))
    for name, p in g.PREDICATES.items():
        got = pair.select((F.col("a.empty") | F.col("b.empty")).alias("e"), p(F.col("a.geom"), F.col("b.geom")).alias("v"), g.st_distance(F.col("a.geom"), F.col("b.geom")).alias("d")).collect()
        assert all(r["v"] is False and r["d"] == float("inf") for r in got if r["e"]), name
    f.select(g.st_area(F.col("geom")), g.st_length(F.col("geom")), g.st_centroid(F.col("geom")), g.st_buffer(F.col("geom"), 5.0)).collect()
    assert spatial.spatial_join(f, f, "ST_Intersects").where("a.empty OR b.empty").count() == 0


def test_cells_of_all_levels_find_every_pair(spark):
    rng = np.random.default_rng(3)
    boxes = [(i, float(x), float(y), float(x + w), float(y + w / 2)) for i, (x, y, w) in enumerate(zip(rng.uniform(-5, 5, 120), rng.uniform(-5, 5, 120), 10 ** rng.uniform(-3, 1, 120)))]
    b = F.struct("x0", "y0", "x1", "y1")
    f = spark.createDataFrame(boxes, "id int, x0 double, y0 double, x1 double, y1 double").select("id", g.from_box(b).alias("geom"))
    got = {(r["a"]["id"], r["b"]["id"]) for r in spatial.candidate_pairs(f, f).collect()}
    want = {(p[0], q[0]) for p in boxes for q in boxes if p[3] >= q[1] and q[3] >= p[1] and p[4] >= q[2] and q[4] >= p[2]}
    assert got == want and spatial.candidate_pairs(f, f).count() == len(want)


def test_boxes_as_text(spark):
    d = spark.createDataFrame([("1,2,3.5,4",), ("1,2,3",), ("a,b,c,d",), (None,)], "s string").select(g.box_from_csv(F.col("s")).alias("b"))
    got = d.select("b", g.box_to_csv(F.col("b")).alias("t")).collect()
    assert tuple(got[0]["b"]) == (1, 2, 3.5, 4) and got[0]["t"] == "1.0,2.0,3.5,4.0" and all(r["b"] is None for r in got[1:])


def test_property_vectors(spark):
    d = spark.createDataFrame([({"elevation_m": "3000", "permeability_mD": "700", "kind": "x"},), ({"perm_mD": "150", "vp_ms": "70000"},), (None,)], "p map<string,string>")
    got = [r["v"] for r in d.select(props.vector(F.col("p")).alias("v")).collect()]
    assert got[0] == pytest.approx([0.5, 0.2, 2, 700 / 1200, 2, 2, 0.1, 700 / 1500]) and got[1] == pytest.approx([0, 0, 0, 0, 0, 0, 2, 0.1]) and got[2] == [0] * 8


def test_seed_and_retrieve(spark):
    shapes = [("reg-1", "Lower Basin", "region", json.dumps(SQUARE), {"elevation_m": "900"}), ("flt-1", "Long Fault", "fault", '{"type":"LineString","coordinates":[[-1,1],[3,1]]}', {}), ("bor-1", "Well Nine", "borehole", '{"type":"Point","coordinates":[1,1]}', {"depth_m": "90"}), ("bor-2", "Far Well", "borehole", '{"type":"Point","coordinates":[8,8]}', {"depth_m": "9"})]
    told = [("rep-1", "Survey", "0,0,1.5,1.5", "The Lower Basin was mapped in spring. Water seeps along the Long Fault. Nothing else moved."), ("rep-2", "Other", "7,7,9,9", "A dry place. Far Well gave no water.")]
    repo = retrieval.seed(spark.createDataFrame(shapes, "id string, name string, kind string, geojson string, props map<string,string>"), spark.createDataFrame(told, "id string, name string, box string, text string"), Settings(embedding_dim=64))
    edges = {(r["src"], r["dst"], r["rel"]) for r in repo.graph.edges.collect()}
    assert {("rep-1", "reg-1", "intersects"), ("flt-1", "reg-1", "abuts"), ("rep-1", "flt-1", "mentions"), ("rep-2", "bor-2", "mentions"), ("reg-1", "bor-1", "intersects")} <= edges
    assert tuple(repo.graph.counts().first())[0] == 6 and repo.chunks.count() == 2
    assert {r["id"] for r in repo.graph.neighbours_of("bor-1").collect()} >= {"reg-1", "rep-1"}
    out = repo.retrieve("water along the fault", 3)
    fused = out.fused.collect()
    assert len(fused) == 3 and next(r["kind"] for r in fused if r["id"] == "rep-1") == "report" and set(next(r["sources"] for r in fused if r["id"] == "rep-1")) >= {"vector", "gnn"}
    assert [r["score"] for r in fused] == sorted((r["score"] for r in fused), reverse=True)
    whole = [(r["id"], r["score"]) for r in repo.graph.rank_query(np.asarray(repo.graph.embed(["water along the fault"]))[0]).collect()]
    place = {i: n + 1 for n, (i, _) in enumerate(sorted(whole, key=lambda x: (-x[1], x[0])))}
    assert all(place[r["id"]] == r["rank"] for r in out.rankings.where("source = 'gnn'").collect())
    assert {r["chunk_id"] for r in out.evidence.collect()} == {"rep-1#c00", "rep-2#c00"}


def test_full_text_over_accents_and_index(spark, tmp_path):
    rows = [(1, "Un café noir"), (2, "CAFE au lait, café"), (3, "élève"), (4, None), (5, "the cafeteria")]
    d = spark.createDataFrame(rows, "doc_id long, text string")
    text.build_index(d, str(tmp_path / "ix"))
    for query, want in (("café", {1, 2}), ("cafe", {1, 2}), ("ÉLÈVE", {3}), ("eleve noir", {1, 3}), ("nothing", set()), ("", set())):
        a = {r["doc_id"]: r["score"] for r in text.bm25(d, query).collect()} if query else {}
        b = {r["doc_id"]: r["score"] for r in text.search_index(spark, str(tmp_path / "ix"), query).collect()} if query else {}
        assert set(a) == want and a == pytest.approx(b), query


def test_settings():
    s = Settings.from_env({"TERRALOOM_TOP_K": "5", "TERRALOOM_RRF_WEIGHTS": "vector=1.5, gnn=0.5", "TERRALOOM_EMBEDDER": " "})
    assert s.top_k == 5 and s.weights() == {"vector": 1.5, "gnn": 0.5} and s.embedder == "local" and Settings().weights() is None
    with pytest.raises(ValueError):
        text.embedder("elsewhere")


def test_spline_resampling():
    """Through the samples, exact for what mirrors into a cosine of the grid, and with corners kept."""
    h = np.random.default_rng(0).normal(size=(9, 7))
    big = field.upsample(h, 17, 13)
    assert np.allclose(big[::2, ::2], h) and np.allclose(field.upsample(h, 9, 7), h) and np.allclose(field.upsample(np.full((4, 4), 3.0), 9, 5), 3)
    n = 65
    x = np.linspace(0, np.pi, n)
    assert np.abs(field.upsample(np.cos(x)[:, None] * np.ones((1, 3)), 2 * n - 1, 3)[:, 1] - np.cos(np.linspace(0, np.pi, 2 * n - 1))).max() < 1e-6


def test_operator_gradients_and_training(spark, tmp_path):
    net = neural.Operator.seeded(modes=3, width=4, layers=2, seed=1, dtype=np.float64)
    rng = np.random.default_rng(2)
    x, y = rng.normal(size=(2, 3, 8, 8)), rng.normal(size=(2, 1, 8, 8))
    loss, grads = net.loss_and_gradients(x, y)
    for name, w in net.weights.items():
        at = tuple(int(rng.integers(0, n)) for n in w.shape)
        for part in (1, 1j) if np.iscomplexobj(w) else (1,):
            old = w[at]
            w[at] = old + 1e-6 * part
            up = net.loss_and_gradients(x, y)[0]
            w[at] = old
            slope = (up - loss) / 1e-6
            mine = grads[name][at].real if part == 1 else grads[name][at].imag
            assert slope == pytest.approx(mine, abs=2e-4), (name, part)
    assert net.run(rng.normal(size=(1, 3, 4, 4))).shape == (1, 1, 4, 4)  # fewer frequencies than modes
    net, info = neural.train(spark, steps=25, n=6, size=16, modes=4, width=6, layers=2)
    assert info["loss_last"] < info["loss_first"] and info["weights"] == net.size()
    neural.save(spark, net, str(tmp_path / "net"), info)
    again, told = neural.load(spark, str(tmp_path / "net"))
    h = neural.terrain(16, rng)
    assert np.array_equal(again.rollout(h, 2), net.rollout(h, 2)) and told["steps"] == 25 and 0 <= h.min() and h.max() == pytest.approx(1)
    assert set(neural.benchmark(net, h, 2, repeats=1)) >= {"solver_ms", "operator_ms", "relative_error"}


def test_hardness_reaches_the_solver(spark):
    h = np.random.default_rng(5).normal(size=(8, 8))
    rows = [(0, y, x, float(h[y, x]), 0.3 + 0.05 * x) for y in range(8) for x in range(8)]
    got = field.solve(spark.createDataFrame(rows, "scene_id int, y int, x int, h double, hardness double"), "hydraulic", 3).orderBy("y", "x").toPandas()["h"].to_numpy().reshape(8, 8)
    assert np.allclose(got, field.hydraulic(h, 3, hardness=np.tile(0.3 + 0.05 * np.arange(8), (8, 1))))


def test_conditioning(spark):
    items = spark.createDataFrame([(0.5, 0.0, 0.0, 2.0, 2.0, 800.0), (0.25, 1.0, 1.0, 3.0, 4.0, 1600.0)], "score double, x0 double, y0 double, x1 double, y1 double, elevation_m double")
    items = items.select("score", g.from_box(F.struct("x0", "y0", "x1", "y1")).alias("geom"), "elevation_m", *[F.lit(None).cast("double").alias(k) for k in list(raster.DEFAULTS)[1:]])
    grid, about = raster.conditioning(items, 8, 2)
    rows = grid.orderBy("cy", "cx").toPandas()
    assert grid.columns == ["cy", "cx", *raster.CHANNELS] and len(rows) == 64 and about["shape"] == (7, 8, 8) and len(about["sh_coeffs"]) == 9
    assert about["attrs"]["elevation_m"] == pytest.approx((0.5 * 800 + 0.25 * 1600) / 0.75) and about["attrs"]["influence_weight"] == pytest.approx(rows["weight"].mean())
    assert rows["elevation"].between(500, 2500).all() and (rows["relief"] <= 1400.001).all()


def test_terrain_mesh(spark):
    spark.sparkContext.setCheckpointDir("/tmp/terraloom-test-checkpoints")
    y, x = np.mgrid[:12, :12]
    h = 30 * np.sin(x / 3) + 20 * np.cos(y / 4)
    rng = np.random.default_rng(1).normal(size=(12, 12)) * 40
    rows = [(k, int(a), int(b), float(f[a, b])) for k, f in ((1, h), (2, rng)) for a in range(12) for b in range(12)]
    v, f, audit = mesh.terrain(spark.createDataFrame(rows, "mesh_id int, y int, x int, h double"), {1: (71.0, 32.0, 71.5, 32.4), 2: (71.0, 32.0, 71.5, 32.4)}, levels=14)
    audits = {r["mesh_id"]: r for r in audit.collect()}
    assert audits[1]["watertight"] and audits[1]["method"] == "surface_nets" and audits[2]["watertight"]
    assert all(r["volume"] > 0 for r in mesh.signed_volume(f, v.select("mesh_id", "vid", "x", "y", "z")).collect())
    ends = v.groupBy("mesh_id").agg(F.min("x").alias("a"), F.max("x").alias("b")).collect()
    assert all(abs(r["a"]) < 10 and abs(r["b"] - 100) < 10 for r in ends)
    assert v.where(F.abs(F.col("nx") ** 2 + F.col("ny") ** 2 + F.col("nz") ** 2 - 1) > 1e-6).count() == 0
