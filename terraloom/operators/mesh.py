"""Iso-surfaces of scalar fields (mesh_id, i, j, k, f), negative inside, and audits of triangle meshes.

Surface nets and all audits are relational. Marching tetrahedra, the fallback
whose result is always a manifold, runs on one mesh's array per task.
"""

from __future__ import annotations

from itertools import permutations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F

AXES = ("i", "j", "k")


def directed_edges(faces: DataFrame) -> DataFrame:
    """(mesh_id, s, t) of the three sides of every face (mesh_id, a, b, c)."""
    sides = F.array(*[F.struct(F.col(p).alias("s"), F.col(q).alias("t")) for p, q in ("ab", "bc", "ca")])
    return faces.select("mesh_id", F.explode(sides).alias("e")).select("mesh_id", "e.s", "e.t")


def topology(faces: DataFrame) -> DataFrame:
    """Per mesh: edges, edges not in two faces, sides not run once each way, and whether that makes it watertight."""
    e = directed_edges(faces).groupBy("mesh_id", F.least("s", "t").alias("lo"), F.greatest("s", "t").alias("hi")).agg(F.count(F.lit(1)).alias("n"), F.sum((F.col("s") < F.col("t")).cast("int")).alias("up"))
    down = F.col("n") - F.col("up")
    odd = (F.col("up") > 1).cast("long") + (down > 1).cast("long")
    out = e.groupBy("mesh_id").agg(F.count(F.lit(1)).alias("edge_count"), F.sum((F.col("n") != 2).cast("long")).alias("non_manifold_edges"), F.sum(odd).alias("inconsistent_directed_edges"))
    return out.withColumn("watertight", (F.col("non_manifold_edges") == 0) & (F.col("inconsistent_directed_edges") == 0))


def _corners(faces: DataFrame, vertices: DataFrame) -> DataFrame:
    """Faces with the places pa, pb, pc of their corners."""
    out = faces
    for c in "abc":
        v = vertices.select("mesh_id", F.col("vid").alias(c), F.struct("x", "y", "z").alias(f"p{c}"))
        out = out.join(v, ["mesh_id", c])
    return out


def _cross(u: list[Column], v: list[Column]) -> list[Column]:
    return [u[1] * v[2] - u[2] * v[1], u[2] * v[0] - u[0] * v[2], u[0] * v[1] - u[1] * v[0]]


def _place(c: str) -> list[Column]:
    return [F.col(f"p{c}.{a}") for a in "xyz"]


def signed_volume(faces: DataFrame, vertices: DataFrame) -> DataFrame:
    n = _cross(_place("b"), _place("c"))
    six = sum((p * q for p, q in zip(_place("a"), n)), F.lit(0.0))
    return _corners(faces, vertices).groupBy("mesh_id").agg((F.sum(six) / 6).alias("volume"))


def vertex_normals(faces: DataFrame, vertices: DataFrame) -> DataFrame:
    """(mesh_id, vid, nx, ny, nz): the normalised sum of the normals of a vertex's faces."""
    a, b, c = (_place(x) for x in "abc")
    n = _cross([q - p for p, q in zip(a, b)], [q - p for p, q in zip(a, c)])
    rows = _corners(faces, vertices).select("mesh_id", F.explode(F.array("a", "b", "c")).alias("vid"), *[x.alias(f"n{k}") for k, x in zip("xyz", n)])
    sums = rows.groupBy("mesh_id", "vid").agg(*[F.sum(f"n{k}").alias(f"n{k}") for k in "xyz"])
    long = F.greatest(F.sqrt(F.col("nx") * F.col("nx") + F.col("ny") * F.col("ny") + F.col("nz") * F.col("nz")), F.lit(1e-12))
    return sums.select("mesh_id", "vid", *[(F.col(f"n{k}") / long).alias(f"n{k}") for k in "xyz"])


def sdf_slab(field: DataFrame, levels: int, slab: float = 0.35) -> DataFrame:
    """(mesh_id, i, j, k, f): a height field (mesh_id, y, x, h) as a slab, two samples of outside on every side."""
    span = field.groupBy("mesh_id").agg(F.min("h").alias("lo"), F.max("h").alias("hi"), F.max("x").alias("nx"), F.max("y").alias("ny"))
    span = span.withColumn("zb", F.col("lo") - F.greatest(F.greatest(F.col("hi") - F.col("lo"), F.lit(1e-6)) * slab, F.lit(0.5)))
    span = span.withColumn("dz", (F.col("hi") - F.col("zb")) / max(levels - 1, 2))
    seq = lambda n: F.sequence(F.lit(0), n)
    grid = span.select("*", F.explode(seq(F.col("nx") + 4)).alias("i")).select("*", F.explode(seq(F.col("ny") + 4)).alias("j")).select("*", F.explode(seq(F.lit(levels + 3))).alias("k"))
    rows = grid.join(field.select("mesh_id", (F.col("x") + 2).alias("i"), (F.col("y") + 2).alias("j"), "h"), ["mesh_id", "i", "j"], "left")
    z = F.col("zb") + F.col("dz") * (F.col("k") - 1.5)
    inner = F.col("h").isNotNull() & F.col("k").between(2, levels + 1)
    return rows.select("mesh_id", "i", "j", "k", F.when(inner, F.greatest(z - F.col("h"), F.col("zb") - z)).otherwise(1.0).alias("f"))


def _changes(sdf: DataFrame) -> DataFrame:
    """Grid edges whose ends differ in sign: axis, lower end (i, j, k), place t along it, and whether the lower end is inside."""
    out = None
    for n, axis in enumerate(AXES):
        w = Window.partitionBy("mesh_id", *[a for a in AXES if a != axis]).orderBy(axis)
        rows = sdf.withColumn("_next", F.lead("f").over(w)).where(F.col("_next").isNotNull() & ((F.col("f") < 0) != (F.col("_next") < 0)))
        rows = rows.select("mesh_id", F.lit(n).alias("axis"), *AXES, (F.col("f") / (F.col("f") - F.col("_next"))).alias("t"), (F.col("f") < 0).alias("inside"))
        out = rows if out is None else out.union(rows)
    return out


def _cells(changes: DataFrame) -> DataFrame:
    """The four cells round each edge, in order, as struct columns c0 to c3."""
    rows = changes
    for n, (db, dc) in enumerate(((-1, -1), (0, -1), (0, 0), (-1, 0))):
        at = []
        for a, name in enumerate(AXES):
            first = (F.col("axis") + 1) % 3 == a
            second = (F.col("axis") + 2) % 3 == a
            at.append((F.col(name) + F.when(first, db).when(second, dc).otherwise(0)).alias(name))
        rows = rows.withColumn(f"c{n}", F.struct(*at))
    return rows


def surface_nets_vertices(sdf: DataFrame) -> DataFrame:
    """(mesh_id, cell, x, y, z): one vertex per cell with a change of sign, at the mean of its edges' crossings."""
    rows = _cells(_changes(sdf))
    place = [F.col(a) + F.when(F.col("axis") == n, F.col("t")).otherwise(0.0) for n, a in enumerate(AXES)]
    hits = rows.select("mesh_id", F.explode(F.array("c0", "c1", "c2", "c3")).alias("cell"), *[p.alias(c) for p, c in zip(place, "xyz")])
    last = sdf.groupBy("mesh_id").agg(*[F.max(a).alias(f"_{a}") for a in AXES])
    hits = hits.join(last, "mesh_id").where(" AND ".join(f"cell.{a} BETWEEN 0 AND _{a} - 1" for a in AXES))
    return hits.groupBy("mesh_id", "cell").agg(*[F.avg(c).alias(c) for c in "xyz"])


def surface_nets(sdf: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Vertices (mesh_id, vid, x, y, z) and outward faces (mesh_id, a, b, c); vid is the cell's number in the grid."""
    last = sdf.groupBy("mesh_id").agg(*[F.max(a).cast("long").alias(f"_{a}") for a in AXES])
    number = lambda c: (F.col(f"{c}.i") * (F.col("_j") + 1) + F.col(f"{c}.j")) * (F.col("_k") + 1) + F.col(f"{c}.k")
    vertices = surface_nets_vertices(sdf).join(last, "mesh_id").select("mesh_id", number("cell").alias("vid"), "x", "y", "z")
    rows = _cells(_changes(sdf)).join(last, "mesh_id")
    for n in range(4):
        rows = rows.where(" AND ".join(f"c{n}.{a} BETWEEN 0 AND _{a} - 1" for a in AXES))
    q = [number(f"c{n}") for n in range(4)]
    tri = lambda a, b, c: F.struct(a.alias("a"), b.alias("b"), c.alias("c"))
    out, back = F.array(tri(q[0], q[1], q[2]), tri(q[0], q[2], q[3])), F.array(tri(q[0], q[2], q[1]), tri(q[0], q[3], q[2]))
    faces = rows.select("mesh_id", F.explode(F.when(F.col("inside"), out).otherwise(back)).alias("f")).select("mesh_id", "f.a", "f.b", "f.c")
    return vertices, faces


def tetrahedra(f: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Vertices and outward faces of the surface where ``f`` changes sign; each cube is cut into the six paths along its axes."""
    shape, unit = np.array(f.shape), np.eye(3, dtype=np.int64)
    base = np.stack(np.meshgrid(*[np.arange(n - 1) for n in shape], indexing="ij"), -1).reshape(-1, 3)
    flat = lambda p: (p[..., 0] * shape[1] + p[..., 1]) * shape[2] + p[..., 2]
    values, tris = f.ravel(), []
    for order in permutations(range(3)):
        corner = np.cumsum([np.zeros(3, np.int64), *[unit[a] for a in order]], 0)
        tet = flat(base[:, None] + corner[None])
        inside = values[tet] < 0
        for n_in in (1, 2, 3):
            some = np.flatnonzero(inside.sum(1) == n_in)
            if not len(some):
                continue
            sort = np.argsort(~inside[some], axis=1, kind="stable")
            t = np.take_along_axis(tet[some], sort, 1)  # corners inside come first
            edge = lambda a, b: np.stack([t[:, a], t[:, b]], -1)  # noqa: B023, E731
            if n_in == 1:
                made = [(edge(0, 1), edge(0, 2), edge(0, 3))]
            elif n_in == 3:
                made = [(edge(0, 3), edge(1, 3), edge(2, 3))]
            else:
                made = [(edge(0, 2), edge(0, 3), edge(1, 3)), (edge(0, 2), edge(1, 3), edge(1, 2))]
            tris += [np.stack(m, 1) for m in made]
    if not tris:
        return np.empty((0, 3)), np.empty((0, 3), np.int64)
    ends = np.concatenate(tris)  # (triangles, 3 corners, inside end and outside end)
    edges, number = np.unique(ends.reshape(-1, 2), axis=0, return_inverse=True)
    at = np.stack(np.unravel_index(edges, f.shape), -1).astype(float)
    share = values[edges[:, 0]] / (values[edges[:, 0]] - values[edges[:, 1]])
    vertices = at[:, 0] + share[:, None] * (at[:, 1] - at[:, 0])
    faces = number.reshape(-1, 3)
    p = vertices[faces]
    ends_at = np.stack(np.unravel_index(ends, f.shape), -1).astype(float)
    outward = (ends_at[:, :, 1] - ends_at[:, :, 0]).sum(1)
    turned = np.einsum("ij,ij->i", np.cross(p[:, 1] - p[:, 0], p[:, 2] - p[:, 0]), outward) < 0
    faces[turned] = faces[turned][:, [0, 2, 1]]
    return vertices, faces


def marching_tetrahedra(sdf: DataFrame) -> DataFrame:
    """(mesh_id, face, corner, vid, x, y, z) of every mesh."""

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        size = rows[list(AXES)].max().to_numpy() + 1
        f = np.ones(size)
        f[tuple(rows[a].to_numpy() for a in AXES)] = rows["f"]
        v, t = tetrahedra(f)
        p = v[t.ravel()]
        return pd.DataFrame({"mesh_id": rows["mesh_id"].iloc[0], "face": np.repeat(np.arange(len(t)), 3), "corner": np.tile(np.arange(3), len(t)).astype(np.int32), "vid": t.ravel(), "x": p[:, 0], "y": p[:, 1], "z": p[:, 2]})

    return sdf.groupBy("mesh_id").applyInPandas(run, f"mesh_id {sdf.schema['mesh_id'].dataType.simpleString()}, face long, corner int, vid long, x double, y double, z double")


def terrain(field: DataFrame, extents: dict, world: float = 100.0, exaggeration: float = 10.0, slab: float = 0.35, levels: int = 30) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Height fields (mesh_id, y, x, h) as closed meshes in world space: vertices (mesh_id, vid, x, y, z, and normals nx, ny, nz), faces, audit.

    X points east, Y up and Z south. ``extents`` gives each mesh_id its box
    (lon0, lat0, lon1, lat1) in degrees: a row per mesh, as the meshes asked
    for. A surface that isn't watertight is taken again with three more levels,
    and if that isn't either, by marching tetrahedra.
    """
    from terraloom.functions.geometry import EARTH_M
    from terraloom.sources.store import stored

    spark = field.sparkSession
    kind = field.schema["mesh_id"].dataType.simpleString()
    boxes = spark.createDataFrame([(k, *map(float, v)) for k, v in extents.items()], f"mesh_id {kind}, lon0 double, lat0 double, lon1 double, lat1 double")
    sizes = field.groupBy("mesh_id").agg(F.min("h").alias("lo"), F.max("h").alias("hi"), (F.max("x") + 1).alias("nx"), (F.max("y") + 1).alias("ny")).join(boxes, "mesh_id")
    tried = []
    left = field
    for method, n in (("surface_nets", levels), ("surface_nets", levels + 3), ("marching_tets", levels)):
        if method == "surface_nets":
            v, f = surface_nets(stored(sdf_slab(left, n, slab)))
        else:
            c = stored(marching_tetrahedra(sdf_slab(left, n, slab)))
            f = c.groupBy("mesh_id", "face").agg(*[F.max(F.when(F.col("corner") == i, F.col("vid"))).alias(a) for i, a in enumerate("abc")])
            v = c.groupBy("mesh_id", "vid").agg(*[F.first(a).alias(a) for a in "xyz"])
        v, f = stored(v.select("mesh_id", "vid", "x", "y", "z")), stored(f.select("mesh_id", "a", "b", "c"))
        audit = stored(topology(f).withColumn("method", F.lit(method)).withColumn("levels", F.lit(n)))
        good = audit if method == "marching_tets" else audit.where("watertight")
        done = good.select("mesh_id")
        tried.append((v.join(done, "mesh_id", "left_semi"), f.join(done, "mesh_id", "left_semi"), good))
        left = left.join(done, "mesh_id", "left_anti")
        if left.isEmpty():
            break
    v, f, audit = (_together([t[i] for t in tried]) for i in range(3))
    wide = F.greatest(F.radians(F.col("lon1") - F.col("lon0")) * EARTH_M * F.cos(F.radians((F.col("lat0") + F.col("lat1")) / 2)), F.lit(1.0))
    deep = F.greatest(F.radians(F.col("lat1") - F.col("lat0")) * EARTH_M, F.lit(1.0))
    scale = F.lit(world) / wide
    bottom = F.col("lo") - F.greatest(F.greatest(F.col("hi") - F.col("lo"), F.lit(1e-6)) * slab, F.lit(0.5))
    dz = (F.col("hi") - bottom) / F.greatest(F.col("levels") - 1, F.lit(2))
    up = (bottom + 0.5 * dz + (F.col("z") - 2) * dz - 0.5 * (F.col("lo") + F.col("hi"))) * scale * exaggeration
    rows = v.join(sizes, "mesh_id").join(audit.select("mesh_id", "levels"), "mesh_id")
    east = (F.col("x") - 2) * (F.lit(world) / F.greatest(F.col("nx") - 1, F.lit(1)))
    south = (F.col("ny") - 1 - (F.col("y") - 2)) * (deep * scale / F.greatest(F.col("ny") - 1, F.lit(1)))
    placed = stored(rows.select("mesh_id", "vid", east.alias("x"), up.alias("y"), south.alias("z")))
    return placed.join(vertex_normals(f, placed), ["mesh_id", "vid"]), f, audit


def _together(parts: list[DataFrame]) -> DataFrame:
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out
