"""Reference-shaped relations derived from the star-schema tables by key arithmetic."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from terraloom.functions import geometry as g
from terraloom.sources.store import stored


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _milli(key: str, times: int, modulo: int):
    return (F.col(key).cast("long") * times % modulo).cast("double") / 1000


def _milli_of(value, modulo: int):
    return (value.cast("long") % modulo).cast("double") / 1000


def _points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Boreholes from suppliers: id, name, kind, geom."""
    x, y = 71 + _milli("s_suppkey", 7919, 6000), 31 + _milli("s_suppkey", 104729, 5000)
    return table(spark, sf_dir, "supplier").select(F.concat(F.lit("sup-"), F.col("s_suppkey").cast("string")).alias("id"), F.col("s_name").alias("name"), F.lit("borehole").alias("kind"), F.lit(0).alias("dim"), F.array(g.point(x, y)).alias("pts"))


def _hexagon(cx, cy, hw, hh):
    corners = ((1.0, 0.0), (0.5, 1.0), (-0.5, 1.0), (-1.0, 0.0), (-0.5, -1.0), (0.5, -1.0), (1.0, 0.0))
    return F.transform(F.array(*[g.point(F.lit(ox), F.lit(oy)) for ox, oy in corners]), lambda p: F.struct((cx + hw * p["x"]).alias("x"), (cy + hh * p["y"]).alias("y")))


def _polygons(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Units from nations, as hexagons."""
    cx, cy = 71.5 + _milli("n_nationkey", 1777, 5000), 31.5 + _milli("n_nationkey", 2999, 4000)
    hw, hh = 0.3 + (F.col("n_nationkey") % 5).cast("double") / 10, 0.3 + (F.col("n_nationkey") % 3).cast("double") / 10
    return table(spark, sf_dir, "nation").select(F.concat(F.lit("nat-"), F.col("n_nationkey").cast("string")).alias("id"), F.col("n_name").alias("name"), F.lit("unit").alias("kind"), F.lit(2).alias("dim"), _hexagon(cx, cy, hw, hh).alias("pts"))


def _regions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Regions, as large hexagons."""
    cx, cy = 72.0 + F.col("r_regionkey").cast("double"), 32.5 + F.col("r_regionkey").cast("double") / 2
    return table(spark, sf_dir, "region").select(F.concat(F.lit("reg-"), F.col("r_regionkey").cast("string")).alias("id"), F.col("r_name").alias("name"), F.lit("region").alias("kind"), F.lit(2).alias("dim"), _hexagon(cx, cy, F.lit(1.25), F.lit(1.0)).alias("pts"))


def _lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Faults from parts: five of them in a row are the vertices of a line."""
    p, k = F.col("p_partkey"), F.col("p_partkey") % 5
    f = (p - k) / 5
    x = 71 + _milli_of(f * 389, 5500) + k * F.lit(0.1) + _milli_of(p * 53, 100)
    y = 31 + _milli_of(f * 577, 4500) + _milli_of(p * 71, 300) - F.lit(0.15)
    rows = table(spark, sf_dir, "part").select(F.expr("p_partkey div 5").alias("f"), "p_name", k.alias("k"), g.point(x, y).alias("p"))
    lines = rows.groupBy("f").agg(F.min_by("p_name", "k").alias("name"), F.array_sort(F.collect_list(F.struct("k", "p"))).alias("v"))  # five at most
    return lines.select(F.concat(F.lit("flt-"), F.col("f").cast("string")).alias("id"), "name", F.lit("fault").alias("kind"), F.lit(1).alias("dim"), F.transform("v", lambda v: v["p"]).alias("pts"))


_KINDS = {"borehole": _points, "unit": _polygons, "region": _regions, "fault": _lines}


def features(spark: SparkSession, sf_dir: str, *kinds: str) -> DataFrame:
    """Features (id, name, kind, geom), of all kinds or those named, stored: geometries are built once."""
    rows = None
    for kind in kinds or _KINDS:
        part = _KINDS[kind](spark, sf_dir)
        rows = part if rows is None else rows.union(part)
    return stored(rows.select("id", "name", "kind", g.geometry(F.col("dim"), F.col("pts")).alias("geom")))


#: The same relations as vertices, for DuckDB: v(id, kind, dim, k, x, y).
VERTICES_SQL = """
v AS (
  SELECT concat('sup-', CAST(s_suppkey AS varchar)) id, 'borehole' kind, 0 dim, 0 k,
         71 + CAST(s_suppkey*7919 % 6000 AS double)/1000 x, 31 + CAST(s_suppkey*104729 % 5000 AS double)/1000 y FROM supplier
  UNION ALL
  SELECT concat('flt-', CAST(f AS varchar)), 'fault', 1, CAST(p % 5 AS int),
         71 + CAST(f*389 % 5500 AS double)/1000 + (p % 5)*CAST(0.1 AS double) + CAST(p*53 % 100 AS double)/1000,
         31 + CAST(f*577 % 4500 AS double)/1000 + CAST(p*71 % 300 AS double)/1000 - CAST(0.15 AS double)
  FROM (SELECT p_partkey p, p_partkey // 5 f FROM part) q
  UNION ALL
  SELECT r.id, r.kind, 2, c.k, cx + hw*c.ox, cy + hh*c.oy
  FROM (SELECT concat('nat-', CAST(n_nationkey AS varchar)) id, 'unit' kind,
               CAST(71.5 AS double) + CAST(CAST(n_nationkey AS bigint)*1777 % 5000 AS double)/1000 cx, CAST(31.5 AS double) + CAST(CAST(n_nationkey AS bigint)*2999 % 4000 AS double)/1000 cy,
               CAST(0.3 AS double) + CAST(n_nationkey % 5 AS double)/10 hw, CAST(0.3 AS double) + CAST(n_nationkey % 3 AS double)/10 hh FROM nation
        UNION ALL
        SELECT concat('reg-', CAST(r_regionkey AS varchar)), 'region', 72 + CAST(r_regionkey AS double), CAST(32.5 AS double) + CAST(r_regionkey AS double)/2, CAST(1.25 AS double), CAST(1 AS double) FROM region) r
       CROSS JOIN (SELECT k, CAST(ox AS double) ox, CAST(oy AS double) oy FROM (VALUES (0,1.0,0.0),(1,0.5,1.0),(2,-0.5,1.0),(3,-1.0,0.0),(4,-0.5,-1.0),(5,0.5,-1.0),(6,1.0,0.0)) t(k,ox,oy)) c
),
bb AS (SELECT id, min(kind) kind, min(dim) dim, min(x) x0, min(y) y0, max(x) x1, max(y) y1 FROM v GROUP BY id),
s AS (SELECT a.id, a.dim, a.k, a.x x1, a.y y1, b.x x2, b.y y2 FROM v a JOIN v b ON a.id=b.id AND b.k=a.k+1)"""
