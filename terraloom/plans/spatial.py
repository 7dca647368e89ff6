"""Spatial queries and the SQL they are held against."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from terraloom.functions import geometry as g
from terraloom.operators import spatial
from terraloom.plans.catalog import query
from terraloom.sources import fixtures
from terraloom.sources.fixtures import VERTICES_SQL

ANCHOR = "nat-7"

#: Relations between pairs of features whose boxes meet: px (vertex or midpoint in ring), sx (segments meet), inter, cont.
RELATED_SQL = (
    "WITH "
    + VERTICES_SQL
    + """,
pair AS (SELECT a.id ai, b.id bi, a.dim ad, b.dim bd, a.kind ak, b.kind bk, a.id < b.id AS lt FROM bb a JOIN bb b
         ON a.id <> b.id AND a.x1 >= b.x0 AND b.x1 >= a.x0 AND a.y1 >= b.y0 AND b.y1 >= a.y0),
pt AS (SELECT id, k, x, y, 0 mid FROM v UNION ALL SELECT id, k, (x1+x2)/2, (y1+y2)/2, 1 FROM s WHERE dim = 2),
pin AS (SELECT p.ai, p.bi, pt.k, pt.mid,
          bool_or(pt.x BETWEEN least(e.x1,e.x2)-1e-12 AND greatest(e.x1,e.x2)+1e-12 AND pt.y BETWEEN least(e.y1,e.y2)-1e-12 AND greatest(e.y1,e.y2)+1e-12
                  AND abs((e.x2-e.x1)*(pt.y-e.y1)-(e.y2-e.y1)*(pt.x-e.x1)) < 1e-12)
          OR sum(CASE WHEN (e.y1>pt.y)<>(e.y2>pt.y) AND pt.x < (e.x2-e.x1)*(pt.y-e.y1)/(CASE WHEN e.y2=e.y1 THEN 1 ELSE e.y2-e.y1 END)+e.x1 THEN 1 ELSE 0 END) % 2 = 1 AS inside
        FROM pair p JOIN pt ON pt.id = p.ai JOIN s e ON e.id = p.bi WHERE p.bd = 2 GROUP BY ALL),
px AS (SELECT ai, bi, bool_or(inside) FILTER (mid = 0) any_in, bool_and(inside) all_in, bool_or(inside) FILTER (mid = 0 AND k = 0) first_in FROM pin GROUP BY ALL),
sx AS (SELECT p.ai, p.bi, bool_or(
          ((o1>0)<>(o2>0) AND (o3>0)<>(o4>0))
          OR (abs(o1)<1e-12 AND u.x1 BETWEEN least(t.x1,t.x2)-1e-12 AND greatest(t.x1,t.x2)+1e-12 AND u.y1 BETWEEN least(t.y1,t.y2)-1e-12 AND greatest(t.y1,t.y2)+1e-12)
          OR (abs(o2)<1e-12 AND u.x2 BETWEEN least(t.x1,t.x2)-1e-12 AND greatest(t.x1,t.x2)+1e-12 AND u.y2 BETWEEN least(t.y1,t.y2)-1e-12 AND greatest(t.y1,t.y2)+1e-12)
          OR (abs(o3)<1e-12 AND t.x1 BETWEEN least(u.x1,u.x2)-1e-12 AND greatest(u.x1,u.x2)+1e-12 AND t.y1 BETWEEN least(u.y1,u.y2)-1e-12 AND greatest(u.y1,u.y2)+1e-12)
          OR (abs(o4)<1e-12 AND t.x2 BETWEEN least(u.x1,u.x2)-1e-12 AND greatest(u.x1,u.x2)+1e-12 AND t.y2 BETWEEN least(u.y1,u.y2)-1e-12 AND greatest(u.y1,u.y2)+1e-12)) meet
        FROM pair p JOIN s t ON t.id = p.ai JOIN s u ON u.id = p.bi,
        LATERAL (SELECT (t.x2-t.x1)*(u.y1-t.y1)-(t.y2-t.y1)*(u.x1-t.x1) o1, (t.x2-t.x1)*(u.y2-t.y1)-(t.y2-t.y1)*(u.x2-t.x1) o2,
                        (u.x2-u.x1)*(t.y1-u.y1)-(u.y2-u.y1)*(t.x1-u.x1) o3, (u.x2-u.x1)*(t.y2-u.y1)-(u.y2-u.y1)*(t.x2-u.x1) o4) o
        GROUP BY ALL),
pp AS (SELECT p.ai, p.bi, bool_or(CASE WHEN p.bd=0 THEN abs(a.x-b.x)<1e-12 AND abs(a.y-b.y)<1e-12
            ELSE abs((e.x2-e.x1)*(a.y-e.y1)-(e.y2-e.y1)*(a.x-e.x1)) <= 1e-12 AND a.x BETWEEN least(e.x1,e.x2)-1e-12 AND greatest(e.x1,e.x2)+1e-12
                 AND a.y BETWEEN least(e.y1,e.y2)-1e-12 AND greatest(e.y1,e.y2)+1e-12 END) hit
       FROM pair p JOIN v a ON a.id=p.ai LEFT JOIN v b ON b.id=p.bi AND p.bd=0 LEFT JOIN s e ON e.id=p.bi AND p.bd=1 WHERE p.ad=0 AND p.bd<2 GROUP BY ALL),
f AS (SELECT p.*, coalesce(x.any_in,false) ain, coalesce(y.any_in,false) bin, coalesce(x.all_in,false) within_, coalesce(y.all_in,false) cont,
             coalesce(x.first_in,false) a1in, coalesce(m.meet,false) OR coalesce(q.hit,false) OR coalesce(r.hit,false) OR coalesce(x.any_in,false) OR coalesce(y.any_in,false) inter
      FROM pair p LEFT JOIN px x ON x.ai=p.ai AND x.bi=p.bi LEFT JOIN px y ON y.ai=p.bi AND y.bi=p.ai
           LEFT JOIN sx m ON m.ai=p.ai AND m.bi=p.bi LEFT JOIN pp q ON q.ai=p.ai AND q.bi=p.bi LEFT JOIN pp r ON r.ai=p.bi AND r.bi=p.ai),
rel AS (SELECT *, inter AND NOT (CASE WHEN ad=2 AND bd=2 THEN ain OR bin WHEN ad=0 THEN within_ WHEN bd=0 THEN cont ELSE bd=2 AND a1in END) touch,
               ad=2 AND bd=2 AND inter AND NOT cont AND NOT within_ AS overl FROM f)
"""
)

#: Metres between the samples of features a and b.
DISTANCE_SQL = """,
sm AS (SELECT id, x, y FROM v UNION ALL SELECT id, (x1+x2)/2, (y1+y2)/2 FROM s)"""

_METRES = "round(min(6371008.8*sqrt(power(radians(p.x-q.x)*cos(radians((a.y0+a.y1+b.y0+b.y1)/4)),2)+power(radians(p.y-q.y),2))),3) d"


@query("spatial_neighbors", RELATED_SQL + DISTANCE_SQL + f" SELECT b.id, {_METRES} FROM rel JOIN bb a ON a.id=ai JOIN bb b ON b.id=bi JOIN sm p ON p.id=a.id JOIN sm q ON q.id=b.id WHERE ai='{ANCHOR}' AND inter GROUP BY b.id")
def spatial_neighbors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spatial.neighbors(fixtures.features(spark, sf_dir), ANCHOR).withColumn("d", F.round("d", 3))


@query(
    "st_distance",
    "WITH " + VERTICES_SQL + DISTANCE_SQL + f" SELECT a.id a, b.id b, {_METRES} FROM bb a JOIN bb b ON a.kind='unit' AND b.kind IN ('region','fault') JOIN sm p ON p.id=a.id JOIN sm q ON q.id=b.id GROUP BY a.id, b.id",
)
def st_distance(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All units against regions and faults: the small side, one row per nation, is joined by broadcast."""
    units = fixtures.features(spark, sf_dir, "unit").select(F.col("id").alias("a"), F.col("geom").alias("ga"))
    others = fixtures.features(spark, sf_dir, "region", "fault").select(F.col("id").alias("b"), F.col("geom").alias("gb"))
    return others.repartition(spatial.tasks(others)).join(F.broadcast(units)).select("a", "b", F.round(g.st_distance(F.col("ga"), F.col("gb")), 3).alias("d"))


@query(
    "st_area",
    "WITH " + VERTICES_SQL + " SELECT bb.id, round(coalesce(abs(sum(s.x1*s.y2-s.x2*s.y1)) FILTER (s.dim=2)/2*cos(radians((min(bb.y0)+max(bb.y1))/2))*power(6371008.8*pi()/180,2),0)/1e6,3) area FROM bb LEFT JOIN s ON s.id=bb.id GROUP BY bb.id".replace(
        "abs(sum(s.x1*s.y2-s.x2*s.y1)) FILTER (s.dim=2)", "abs(sum(s.x1*s.y2-s.x2*s.y1) FILTER (s.dim=2))"
    ),
)
def st_area(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Square kilometres."""
    return fixtures.features(spark, sf_dir).select("id", F.round(g.st_area(F.col("geom")) / 1e6, 3).alias("area"))


@query(
    "st_length",
    "WITH " + VERTICES_SQL + " SELECT bb.id, round(coalesce(sum(6371008.8*sqrt(power(radians(s.x2-s.x1)*cos(radians((s.y1+s.y2)/2)),2)+power(radians(s.y2-s.y1),2))) FILTER (s.dim=1),0),3) length FROM bb LEFT JOIN s ON s.id=bb.id GROUP BY bb.id",
)
def st_length(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fixtures.features(spark, sf_dir).select("id", F.round(g.st_length(F.col("geom")), 3).alias("length"))


@query("st_centroid", "WITH " + VERTICES_SQL + " SELECT id, round(avg(x),6) x, round(avg(y),6) y FROM v GROUP BY id")
def st_centroid(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = g.st_centroid(F.col("geom"))
    return fixtures.features(spark, sf_dir).select("id", F.round(c["x"], 6).alias("x"), F.round(c["y"], 6).alias("y"))


@query("geom_bbox", "WITH " + VERTICES_SQL + " SELECT id, round(x0,6) x0, round(y0,6) y0, round(x1,6) x1, round(y1,6) y1 FROM bb")
def geom_bbox(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fixtures.features(spark, sf_dir).select("id", *[F.round(f"geom.box.{c}", 6).alias(c) for c in ("x0", "y0", "x1", "y1")])


@query("bbox_candidates", "WITH " + VERTICES_SQL + " SELECT id FROM bb WHERE x1 >= 72.5 AND x0 <= 74.5 AND y1 >= 32 AND y0 <= 34")
def bbox_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spatial.bbox_candidates(fixtures.features(spark, sf_dir), 72.5, 32.0, 74.5, 34.0).select("id")


@query(
    "geom_buffer",
    "WITH "
    + VERTICES_SQL
    + """, c AS (SELECT v.id, avg(x) cx, avg(y) cy, degrees(5000/6371008.8) dy, degrees(5000/6371008.8)/greatest(cos(radians(min(y))),1e-6) dx FROM v GROUP BY id),
r AS (SELECT v.id, v.k, x + (x-cx)/n*dx x, y + (y-cy)/n*dy y FROM v JOIN c ON c.id=v.id, LATERAL (SELECT CASE WHEN x=cx AND y=cy THEN 1 ELSE sqrt((x-cx)*(x-cx)+(y-cy)*(y-cy)) END n) WHERE dim=2
      UNION ALL SELECT bb.id, i, cx + cos(i*pi()/16)*dx, cy + sin(i*pi()/16)*dy FROM bb JOIN c ON c.id=bb.id, range(32) t(i) WHERE dim<2)
SELECT r.id, CAST(count(*) + 1 AS bigint) n, round(min(x),6) x0, round(max(x),6) x1, round(min(y),6) y0, round(max(y),6) y1 FROM r GROUP BY r.id""",
)
def geom_buffer(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Buffers of 5 km: how many vertices they have, and their boxes."""
    rows = fixtures.features(spark, sf_dir).select("id", g.st_buffer(F.col("geom"), 5000.0).alias("b"))
    return rows.select("id", F.size("b.pts").cast("long").alias("n"), *[F.round(f"b.box.{c}", 6).alias(c) for c in ("x0", "x1", "y0", "y1")])


def _pairs(name: str):
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        f = fixtures.features(spark, sf_dir).select("id", "geom")
        return spatial.spatial_join(f, f, name, F.col("a.id") != F.col("b.id"), [F.col("a.id").alias("a"), F.col("b.id").alias("b")])

    return run


for _name, _flag in (("intersects", "inter"), ("contains", "ad=2 AND cont"), ("within", "bd=2 AND within_"), ("touches", "touch"), ("overlaps", "overl")):
    query(f"st_{_name}_join", RELATED_SQL + f" SELECT ai a, bi b FROM rel WHERE {_flag}")(_pairs("ST_" + _name.capitalize()))


@query("abuts_edges", RELATED_SQL + " SELECT ai src, bi dst, 'abuts' rel, CAST(1 AS double) weight FROM rel WHERE ak IN ('fault','unit') AND bk='region' AND inter")
def abuts_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spatial.abuts_edges(fixtures.features(spark, sf_dir))


@query(
    "build_spatial_edges",
    RELATED_SQL
    + """, e AS (SELECT ai s, bi t, 'intersects' rel FROM rel WHERE lt AND inter UNION ALL SELECT ai, bi, 'contains' FROM rel WHERE lt AND ad=2 AND cont UNION ALL SELECT ai, bi, 'abuts' FROM rel WHERE lt AND touch)
SELECT DISTINCT src, dst, rel, CAST(1 AS double) weight FROM (SELECT s src, t dst, rel FROM e UNION ALL SELECT t, s, rel FROM e UNION ALL SELECT ai, bi, 'abuts' FROM rel WHERE ak IN ('fault','unit') AND bk='region' AND inter)""",
)
def build_spatial_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spatial.build_spatial_edges(fixtures.features(spark, sf_dir), ("ST_Intersects", "ST_Contains", "ST_Touches"))
