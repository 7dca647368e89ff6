"""Planar predicates and measures as Column expressions; no Python runs in the row path.

A geometry is ``STRUCT<dim, pts, segs, box>``: dimension 0, 1 or 2, its
vertices (a polygon's ring closed), its segments and its bounding box, all
built once when a feature is read. Boundaries count as inside, within
``EPS``. Null geometries give null. An empty one (no vertices) has a box of
nulls: predicates with it are false, its distance is infinite, its measures 0.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, functions as F

EARTH_M = 6_371_008.8
EPS = 1e-12
_RAD = math.pi / 180.0


def point(x: Column, y: Column) -> Column:
    return F.struct(x.cast("double").alias("x"), y.cast("double").alias("y"))


def let(value: Column, body) -> Column:
    """``body`` of a value that is computed once."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _closed(dim: Column, pts: Column) -> Column:
    return F.when((dim == 2) & (F.size(pts) > 0) & (F.get(pts, F.lit(0)) != F.get(pts, F.size(pts) - 1)), F.concat(pts, F.slice(pts, 1, 1))).otherwise(pts)


def _segments(ring: Column) -> Column:
    n = F.greatest(F.size(ring) - 1, F.lit(0))
    return F.zip_with(F.slice(ring, 1, n), F.slice(ring, 2, n), lambda p, q: F.struct(p["x"].alias("x1"), p["y"].alias("y1"), q["x"].alias("x2"), q["y"].alias("y2")))


def geometry(dim: Column, pts: Column) -> Column:
    """A geometry of ``dim`` from its vertices; open rings are closed."""

    def whole(ring: Column) -> Column:
        xs, ys = F.transform(ring, lambda p: p["x"]), F.transform(ring, lambda p: p["y"])
        box = F.struct(F.array_min(xs).alias("x0"), F.array_min(ys).alias("y0"), F.array_max(xs).alias("x1"), F.array_max(ys).alias("y1"))
        return F.struct(dim.cast("int").alias("dim"), ring.alias("pts"), _segments(ring).alias("segs"), box.alias("box"))

    return let(_closed(dim, pts), whole)


def boxes_meet(a: Column, b: Column) -> Column:
    p, q = a["box"], b["box"]
    met = (p["x1"] >= q["x0"]) & (q["x1"] >= p["x0"]) & (p["y1"] >= q["y0"]) & (q["y1"] >= p["y0"])
    return F.when(a.isNotNull() & b.isNotNull(), F.coalesce(met, F.lit(False)))


def _turn(ax, ay, bx, by, cx, cy) -> Column:
    return (bx - ax) * (cy - ay) - (by - ay) * (cx - ax)


def _near_segment(s: Column, x: Column, y: Column) -> Column:
    """Whether a point lies in the widened box of a segment."""
    return x.between(F.least(s["x1"], s["x2"]) - EPS, F.greatest(s["x1"], s["x2"]) + EPS) & y.between(F.least(s["y1"], s["y2"]) - EPS, F.greatest(s["y1"], s["y2"]) + EPS)


def on_segment(s: Column, x: Column, y: Column) -> Column:
    return _near_segment(s, x, y) & (F.abs(_turn(s["x1"], s["y1"], s["x2"], s["y2"], x, y)) <= EPS)


def in_ring(segs: Column, x: Column, y: Column) -> Column:
    """Even-odd rule along the ray to the right; the boundary is inside."""

    def crosses(s: Column) -> Column:
        at = (s["x2"] - s["x1"]) * (y - s["y1"]) / F.nullif(s["y2"] - s["y1"], F.lit(0.0)) + s["x1"]
        return ((s["y1"] > y) != (s["y2"] > y)) & (x < at)

    def rim(s: Column) -> Column:
        return _near_segment(s, x, y) & (F.abs(_turn(s["x1"], s["y1"], s["x2"], s["y2"], x, y)) < EPS)

    odd = F.size(F.filter(segs, lambda s: F.coalesce(crosses(s), F.lit(False)))) % 2 == 1
    return F.exists(segs, rim) | odd


def turns(s, t) -> dict[str, Column]:
    """On which side of either segment the ends of the other lie; segments as structs or as dicts of columns."""
    return {
        "o1": _turn(s["x1"], s["y1"], s["x2"], s["y2"], t["x1"], t["y1"]), "o2": _turn(s["x1"], s["y1"], s["x2"], s["y2"], t["x2"], t["y2"]),
        "o3": _turn(t["x1"], t["y1"], t["x2"], t["y2"], s["x1"], s["y1"]), "o4": _turn(t["x1"], t["y1"], t["x2"], t["y2"], s["x2"], s["y2"]),
    }


def turned(o, s, t) -> Column:
    """Whether segments meet, by their ``turns``."""
    apart = ((o["o1"] > 0) != (o["o2"] > 0)) & ((o["o3"] > 0) != (o["o4"] > 0))
    flat = lambda k, r, x, y: (F.abs(o[k]) < EPS) & _near_segment(r, x, y)
    return apart | flat("o1", s, t["x1"], t["y1"]) | flat("o2", s, t["x2"], t["y2"]) | flat("o3", t, s["x1"], s["y1"]) | flat("o4", t, s["x2"], s["y2"])


def segments_meet(s: Column, t: Column) -> Column:
    return let(F.struct(*[v.alias(k) for k, v in turns(s, t).items()]), lambda o: turned(o, s, t))


def _any_vertex_in(a: Column, ring: Column) -> Column:
    return F.exists(a["pts"], lambda p: in_ring(ring["segs"], p["x"], p["y"]))


def _any_crossing(a: Column, b: Column) -> Column:
    return F.exists(a["segs"], lambda s: F.exists(b["segs"], lambda t: segments_meet(s, t)))


def st_intersects(a: Column, b: Column) -> Column:
    lower = a["dim"] <= b["dim"]
    ordered = F.struct(F.when(lower, a).otherwise(b).alias("low"), F.when(lower, b).otherwise(a).alias("high"))

    def exact(pair: Column) -> Column:
        low, high = pair["low"], pair["high"]
        x, y = F.get(low["pts"], F.lit(0))["x"], F.get(low["pts"], F.lit(0))["y"]
        other = F.get(high["pts"], F.lit(0))
        same = (F.abs(x - other["x"]) < EPS) & (F.abs(y - other["y"]) < EPS)
        inside = (high["dim"] == 2) & _any_vertex_in(low, high)
        return (
            F.when(high["dim"] == 0, same)
            .when((low["dim"] == 0) & (high["dim"] == 1), F.exists(high["segs"], lambda s: on_segment(s, x, y)))
            .when(low["dim"] == 2, inside | _any_vertex_in(high, low) | _any_crossing(low, high))
            .otherwise(inside | _any_crossing(low, high))
        )

    return boxes_meet(a, b) & let(ordered, exact)


def st_contains(a: Column, b: Column) -> Column:
    """All vertices of ``b``, and a polygon's edge midpoints, lie in the polygon ``a``."""
    vertices = F.forall(b["pts"], lambda p: in_ring(a["segs"], p["x"], p["y"]))
    middles = F.forall(b["segs"], lambda s: in_ring(a["segs"], (s["x1"] + s["x2"]) / 2, (s["y1"] + s["y2"]) / 2))
    return (a["dim"] == 2) & boxes_meet(a, b) & vertices & ((b["dim"] < 2) | middles)


def st_within(a: Column, b: Column) -> Column:
    return st_contains(b, a)


def _share_inside(a: Column, b: Column) -> Column:
    """The heuristic on which ``st_touches`` rests: argument order matters.

    The first vertex of ``a`` isn't held against the box of ``b``: a boundary is ``EPS`` wide and reaches out of it.
    """
    first = F.get(a["pts"], F.lit(0))
    return (
        F.when((a["dim"] == 2) & (b["dim"] == 2), _any_vertex_in(a, b) | _any_vertex_in(b, a))
        .when(a["dim"] == 0, st_contains(b, a))
        .when(b["dim"] == 0, st_contains(a, b))
        .otherwise((b["dim"] == 2) & in_ring(b["segs"], first["x"], first["y"]))
    )


def st_touches(a: Column, b: Column) -> Column:
    return st_intersects(a, b) & ~_share_inside(a, b)


def st_overlaps(a: Column, b: Column) -> Column:
    return (a["dim"] == 2) & (b["dim"] == 2) & st_intersects(a, b) & ~st_contains(a, b) & ~st_contains(b, a)


def _samples(g: Column) -> Column:
    """Vertices, and midpoints of segments."""
    middle = F.transform(g["segs"], lambda s: F.struct(((s["x1"] + s["x2"]) / 2).alias("x"), ((s["y1"] + s["y2"]) / 2).alias("y")))
    return F.concat(g["pts"], middle)


def st_distance(a: Column, b: Column) -> Column:
    """Metres between the nearest samples of both, on an equirectangular plane at the mean latitude of the boxes."""
    lat = (a["box"]["y0"] + a["box"]["y1"] + b["box"]["y0"] + b["box"]["y1"]) / 4 * _RAD
    east, north = F.cos(lat) * (_RAD * EARTH_M), F.lit(_RAD * EARTH_M)
    # Samples and scales are made once for each pair; squares are compared and one root is drawn.
    square = lambda dx, dy: dx * dx + dy * dy
    each = lambda s: F.transform(s["a"], lambda p: F.array_min(F.transform(s["b"], lambda q: square((p["x"] - q["x"]) * s["east"], (p["y"] - q["y"]) * north))))
    nearest = let(F.struct(_samples(a).alias("a"), _samples(b).alias("b"), east.alias("east")), lambda s: F.array_min(each(s)))
    return F.when(a.isNotNull() & b.isNotNull(), F.coalesce(F.sqrt(nearest), F.lit(float("inf"))))


def st_area(g: Column) -> Column:
    """Square metres of a polygon, 0 for others."""
    metre = EARTH_M * _RAD
    scale = F.cos((g["box"]["y0"] + g["box"]["y1"]) / 2 * _RAD) * metre * metre
    twice = F.aggregate(g["segs"], F.lit(0.0), lambda acc, s: acc + (s["x1"] * s["y2"] - s["x2"] * s["y1"]))
    return F.when(g["dim"] == 2, F.abs(twice) / 2 * scale).otherwise(F.lit(0.0))


def st_length(g: Column) -> Column:
    """Metres along a line, 0 for others."""

    def metres(s: Column) -> Column:
        east = (s["x2"] - s["x1"]) * _RAD * F.cos((s["y1"] + s["y2"]) / 2 * _RAD)
        return F.hypot(east, (s["y2"] - s["y1"]) * _RAD) * EARTH_M

    return F.when(g["dim"] == 1, F.aggregate(g["segs"], F.lit(0.0), lambda acc, s: acc + metres(s))).otherwise(F.lit(0.0))


def st_centroid(g: Column) -> Column:
    """The mean of the vertices; a ring's closing vertex counts again."""
    mean = lambda k: F.aggregate(g["pts"], F.lit(0.0), lambda acc, p: acc + p[k]) / F.nullif(F.size(g["pts"]), F.lit(0))
    return F.struct(mean("x").alias("x"), mean("y").alias("y"))


def st_buffer(g: Column, metres: float, quad_segs: int = 16) -> Column:
    """A polygon's vertices pushed away from their mean; an ellipse round the centroid of anything else."""
    north = math.degrees(metres / EARTH_M)
    east = F.lit(north) / F.greatest(F.cos(g["box"]["y0"] * _RAD), F.lit(1e-6))
    c = st_centroid(g)

    def pushed(p: Column) -> Column:
        dx, dy = p["x"] - c["x"], p["y"] - c["y"]
        n = F.hypot(dx, dy)
        n = F.when(n == 0, 1.0).otherwise(n)
        return F.struct((p["x"] + dx / n * east).alias("x"), (p["y"] + dy / n * north).alias("y"))

    angle = lambda i: i * (math.pi / quad_segs)
    around = F.transform(F.sequence(F.lit(0), F.lit(2 * quad_segs - 1)), lambda i: F.struct((c["x"] + F.cos(angle(i)) * east).alias("x"), (c["y"] + F.sin(angle(i)) * north).alias("y")))
    ring = F.when(g["dim"] == 2, F.transform(g["pts"], pushed)).otherwise(around)
    return geometry(F.lit(2), F.concat(ring, F.slice(ring, 1, 1)))


GEOJSON = "type string, coordinates string"


def from_geojson(text: Column) -> Column:
    """A geometry from GeoJSON of a Point, LineString or Polygon; a polygon's ring may be bare or nested, only the first counts.

    Null, malformed and other texts give null.
    """
    made = F.from_json(text, GEOJSON)
    kind, raw = made["type"], F.regexp_replace(made["coordinates"], r"\s", "")
    bare = F.when(raw.startswith("[[["), F.regexp_extract(raw, r"^\[(\[\[.*?\]\])", 1)).when(raw.startswith("[["), raw).otherwise(F.concat(F.lit("["), raw, F.lit("]")))
    pts = F.transform(F.from_json(F.when(raw == "[]", F.lit("[]")).otherwise(bare), "array<array<double>>"), lambda p: point(F.get(p, F.lit(0)), F.get(p, F.lit(1))))
    dim = F.when(kind == "Point", 0).when(kind == "LineString", 1).when(kind == "Polygon", 2)
    return F.when(dim.isNotNull() & pts.isNotNull(), geometry(dim, pts))


def to_geojson(g: Column) -> Column:
    """GeoJSON of a geometry, a polygon's ring nested."""
    kind = F.element_at(F.array(F.lit("Point"), F.lit("LineString"), F.lit("Polygon")), g["dim"] + 1)
    each = F.transform(g["pts"], lambda p: F.concat(F.lit("["), p["x"].cast("string"), F.lit(","), p["y"].cast("string"), F.lit("]")))
    row = F.concat(F.lit("["), F.array_join(each, ","), F.lit("]"))
    inner = F.when(g["dim"] == 0, F.get(each, F.lit(0))).when(g["dim"] == 1, row).otherwise(F.concat(F.lit("["), row, F.lit("]")))
    return F.concat(F.lit('{"type":"'), kind, F.lit('","coordinates":'), inner, F.lit("}"))


def box_from_csv(text: Column) -> Column:
    """A box from "x0,y0,x1,y1"; null unless there are four numbers."""
    v = F.transform(F.split(text, ","), lambda x: x.try_cast("double"))
    ok = (F.size(v) == 4) & F.forall(v, lambda x: x.isNotNull())
    return F.when(ok, F.struct(*[F.get(v, F.lit(i)).alias(n) for i, n in enumerate(("x0", "y0", "x1", "y1"))]))


def box_to_csv(box: Column) -> Column:
    return F.concat_ws(",", *[box[n].cast("string") for n in ("x0", "y0", "x1", "y1")])


def from_box(box: Column) -> Column:
    """A box as a polygon of five vertices."""
    corners = (("x0", "y0"), ("x1", "y0"), ("x1", "y1"), ("x0", "y1"), ("x0", "y0"))
    return geometry(F.lit(2), F.array(*[point(box[x], box[y]) for x, y in corners]))


PREDICATES = {"ST_Intersects": st_intersects, "ST_Contains": st_contains, "ST_Within": st_within, "ST_Touches": st_touches, "ST_Overlaps": st_overlaps}


def predicate(name: str):
    """A predicate by its SQL name."""
    if name not in PREDICATES:
        raise ValueError(f"unknown predicate {name!r}; one of {', '.join(PREDICATES)}")
    return PREDICATES[name]
