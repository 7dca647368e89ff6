"""Raster, latent, field and mesh queries and the SQL they are held against."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from terraloom.operators import field, mesh, neural, raster
from terraloom.plans.catalog import query
from terraloom.sources import fixtures
from terraloom.sources.fixtures import VERTICES_SQL, table

N = 32
D = "CAST({} AS double)".format
_H = f"SELECT sid scene_id, CAST(y AS int) y, CAST(x AS int) x, round(sin({D(0.3)}*x)+cos({D(0.2)}*y)+CAST((x*31+y*17+sid*7)%11 AS double)/20,6) h FROM range({N}) a(y), range({N}) b(x), (SELECT r_regionkey sid FROM region)"


def heights(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Height fields (scene_id, y, x, h), one per region."""
    s = table(spark, sf_dir, "region").select(F.col("r_regionkey").alias("scene_id"))
    rows = s.select("scene_id", F.explode(F.sequence(F.lit(0), F.lit(N - 1))).alias("y")).select("scene_id", "y", F.explode(F.sequence(F.lit(0), F.lit(N - 1))).alias("x"))
    bump = ((F.col("x") * 31 + F.col("y") * 17 + F.col("scene_id") * 7) % 11).cast("double") / 20
    return rows.withColumn("h", F.round(F.sin(F.lit(0.3) * F.col("x")) + F.cos(F.lit(0.2) * F.col("y")) + bump, 6))


# Items of a retrieval: the units, with scores and properties from their keys; odd ones are weak.
_ITEMS = "SELECT n_nationkey k, 'nat-' || CAST(n_nationkey AS varchar) id, 1/CAST(61+n_nationkey AS double) score, CASE WHEN n_nationkey%2=0 THEN CAST(n_nationkey*97%3000 AS double) END elevation_m, CASE WHEN n_nationkey%2=0 THEN CAST(n_nationkey*53%1500 AS double) END relief_m, CAST(n_nationkey%9 AS double) hardness, CASE WHEN n_nationkey%3=0 THEN CAST(n_nationkey*11%900 AS double) END rainfall_mm, CAST(NULL AS double) uplift_mm_yr, CAST(n_nationkey%4 AS double)/4 roughness FROM nation"
_DEF = {"elevation_m": 1800, "relief_m": 1400, "hardness": 5, "rainfall_mm": 520, "uplift_mm_yr": 4, "roughness": 0.55}
_PHYS = "(elevation_m IS NOT NULL OR relief_m IS NOT NULL)"
ATTRS_SQL = "att AS (SELECT " + ", ".join(f"coalesce(nullif(sum(CASE WHEN {_PHYS} THEN score ELSE 0 END*coalesce({k},0))/nullif(sum(CASE WHEN {_PHYS} THEN score ELSE 0 END),0),0),{D(d)}) {k}" for k, d in _DEF.items()) + " FROM it)"
EXTENT_SQL = f"bx AS (SELECT min(x0) x0, min(y0) y0, max(x1) x1, max(y1) y1 FROM bb WHERE kind='unit'), ex AS (SELECT x0-greatest((x1-x0)*{D(0.08)},{D(0.05)}) x0, y0-greatest((y1-y0)*{D(0.08)},{D(0.05)}) y0, x1+greatest((x1-x0)*{D(0.08)},{D(0.05)}) x1, y1+greatest((y1-y0)*{D(0.08)},{D(0.05)}) y1 FROM bx)"
G = 16
RASTER_SQL = f"""WITH {VERTICES_SQL}, it AS ({_ITEMS}), {ATTRS_SQL}, {EXTENT_SQL},
gr AS (SELECT CAST(j AS int) cy, CAST(i AS int) cx, x0+(x1-x0)*i/{G - 1} px, y0+(y1-y0)*j/{G - 1} py FROM ex, range({G}) q(j), range({G}) p(i)),
sd AS (SELECT s.id, cy, cx, min(sqrt(power(px-(s.x1+t*dx),2)+power(py-(s.y1+t*dy),2))) d, sum(CASE WHEN (s.y1>py)<>(s.y2>py) AND px < dx*(py-s.y1)/(CASE WHEN dy=0 THEN 1 ELSE dy END)+s.x1 THEN 1 ELSE 0 END) % 2 odd
       FROM s JOIN it ON it.id=s.id, gr, LATERAL (SELECT s.x2-s.x1 dx, s.y2-s.y1 dy) a, LATERAL (SELECT least(greatest(((px-s.x1)*dx+(py-s.y1)*dy)/CASE WHEN dx*dx+dy*dy=0 THEN 1e-12 ELSE dx*dx+dy*dy END,0),1) t) b GROUP BY ALL),
kn AS (SELECT cy, cx, it.*, greatest(score*CASE WHEN {_PHYS} THEN 1 ELSE {D(0.15)} END,{D("1e-4")})*exp(-power(CASE WHEN odd=1 THEN 0 ELSE d END/greatest({D(0.18)},sqrt(power(bb.x1-bb.x0,2)+power(bb.y1-bb.y0,2))*{D(0.55)}),2)) w FROM sd JOIN it USING(id) JOIN bb USING(id)),
ra AS (SELECT cy, cx, sum(w) w, {", ".join(f"sum(w*coalesce({k},0)) {k}" for k in _DEF)} FROM kn GROUP BY cy, cx)"""


def items(spark: SparkSession, sf_dir: str) -> DataFrame:
    table(spark, sf_dir, "nation").createOrReplaceTempView("nation")
    return spark.sql(_ITEMS.replace("varchar", "string")).drop("k").join(fixtures.features(spark, sf_dir, "unit").select("id", "geom"), "id")


@query("weighted_attrs", f"WITH it AS ({_ITEMS}), {ATTRS_SQL} SELECT " + ", ".join(f"round({k},6) {k}" for k in _DEF) + " FROM att")
def weighted_attrs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return raster.weighted_attrs(items(spark, sf_dir)).select(*[F.round(k, 6).alias(k) for k in _DEF])


@query("extent_pad", f"WITH {VERTICES_SQL}, {EXTENT_SQL} SELECT round(x0,6) x0, round(y0,6) y0, round(x1,6) x1, round(y1,6) y1 FROM ex")
def extent_pad(spark: SparkSession, sf_dir: str) -> DataFrame:
    return raster.extent(items(spark, sf_dir)).select(*[F.round(c, 6).alias(c) for c in ("x0", "y0", "x1", "y1")])


@query("influence_raster", RASTER_SQL + " SELECT cy, cx, round(w,8) w, round(elevation_m,5) elevation_m, round(hardness,6) hardness FROM ra")
def influence_raster(spark: SparkSession, sf_dir: str) -> DataFrame:
    return raster.influence(items(spark, sf_dir), G).select("cy", "cx", F.round("w", 8).alias("w"), F.round("elevation_m", 5).alias("elevation_m"), F.round("hardness", 6).alias("hardness"))


@query(
    "condition_blend",
    RASTER_SQL
    + ", mx AS (SELECT greatest(max(w),1e-9) m FROM ra) SELECT cy, cx, round(w/m,6) weight, "
    + ", ".join(f"round(CASE WHEN w>1e-9 THEN ra.{k}/greatest(w,1e-9) ELSE att.{k} END*w/m + att.{k}*(1-w/m),4) {k}" for k in ("elevation_m", "rainfall_mm", "uplift_mm_yr"))
    + " FROM ra, att, mx",
)
def condition_blend(spark: SparkSession, sf_dir: str) -> DataFrame:
    it = items(spark, sf_dir)
    out = raster.blend(raster.influence(it, G), raster.weighted_attrs(it))
    return out.select("cy", "cx", F.round("weight", 6).alias("weight"), *[F.round(k, 4).alias(k) for k in ("elevation_m", "rainfall_mm", "uplift_mm_yr")])


_DIRS = "SELECT id, acos(2*CAST(id*37%101 AS double)/100-1) th, CAST(id*53%97 AS double)/97*2*pi() ph FROM (SELECT s_suppkey id FROM supplier)"


def _directions(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("s_suppkey")
    return table(spark, sf_dir, "supplier").select(k.alias("id"), F.acos(2 * (k * 37 % 101).cast("double") / 100 - 1).alias("th"), ((k * 53 % 97).cast("double") / 97 * 2 * math.pi).alias("ph"))


@query(
    "sh_design",
    f"WITH d AS ({_DIRS}) SELECT id, round(sqrt(1/(4*pi())),6) y00, round(sqrt(3/(4*pi()))*cos(th),6)+0.0 y10, round(-sqrt(3/(4*pi()))*sin(th)*cos(ph),6)+0.0 y11, round(sqrt(5/(16*pi()))*(3*cos(th)*cos(th)-1),6)+0.0 y20, round(-sqrt(15/(4*pi()))*sin(th)*cos(th)*sin(ph),6)+0.0 y2m1, round(sqrt(15/(16*pi()))*sin(th)*sin(th)*cos(2*ph),6)+0.0 y22 FROM d",
)
def sh_design(spark: SparkSession, sf_dir: str) -> DataFrame:
    y = raster.harmonics(F.col("th"), F.col("ph"), 4)
    names = {"y00": (0, 0), "y10": (1, 0), "y11": (1, 1), "y20": (2, 0), "y2m1": (2, -1), "y22": (2, 2)}
    return _directions(spark, sf_dir).select("id", *[(F.round(y[lm], 6) + F.lit(0.0)).alias(n) for n, lm in names.items()])


@query("sh_fit")
def sh_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Harmonics of degree 2 fitted to a field over directions, and the fitted values."""
    y = raster.harmonics(F.col("th"), F.col("ph"), 2)
    names = [f"y_{k}" for k in range(len(y))]
    rows = _directions(spark, sf_dir).select("id", "th", "ph", *[c.alias(n) for n, c in zip(names, y.values())], (F.cos("th") * 2 + F.sin("ph")).alias("value"))
    c = raster.fit(rows, names, "value")
    return rows.select("id", "value", sum((F.col(n) * float(x) for n, x in zip(names, c)), F.lit(0.0)).alias("fitted"))


@query("spectral_tilt", f"SELECT CAST(u AS int) u, CAST(v AS int) v, round(1/(1+power(6*sqrt(power(u/{D(8)},2)+power(v/{D(8)},2)),{D(1.2)})),6) tilt FROM range(8) a(u), range(8) b(v)")
def spectral_tilt(spark: SparkSession, sf_dir: str) -> DataFrame:
    grid = raster.cells(spark, 8).select(F.col("cy").alias("u"), F.col("cx").alias("v"))
    return grid.select("u", "v", F.round(raster.spectral_tilt(F.col("u"), F.col("v"), 8, 1.2), 6).alias("tilt"))


_PRIOR_IN = f"SELECT id, coalesce(elevation_m,1800) elevation_m, coalesce(relief_m,1400) relief_m, hardness, coalesce(rainfall_mm,520) rainfall_mm, roughness FROM ({_ITEMS})"


def _prior(spark: SparkSession, sf_dir: str) -> DataFrame:
    known = {k: F.coalesce(k, F.lit(raster.DEFAULTS[k])).alias(k) for k in ("elevation_m", "relief_m", "rainfall_mm")}
    return raster.prior(items(spark, sf_dir).select("id", *known.values(), "hardness", "roughness"))


@query(
    "build_prior",
    f"WITH a AS ({_PRIOR_IN}) SELECT id, CAST(u AS int) u, CAST(v AS int) v, round(CASE WHEN u=0 AND v=0 THEN elevation_m/6000*{D(9.6)} ELSE 0 END,6) mean, round(relief_m/3500/(1+power(6*sqrt(power(u/{D(8)},2)+power(v/{D(8)},2)),least(greatest({D(1.9)}-{D(1.1)}*(hardness/10)-{D(0.4)}*(rainfall_mm/1200),{D(0.4)}),{D(2.2)})))*({D(0.55)}+roughness)+{D(0.001)},6) std FROM a, range(8) p(u), range(8) q(v)",
)
def build_prior(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _prior(spark, sf_dir).select("id", "u", "v", F.round("mean", 6).alias("mean"), F.round("std", 6).alias("std"))


@query("diffusion_sample", f"WITH a AS ({_PRIOR_IN}) SELECT id, CAST(u AS int) u, CAST(v AS int) v, round(CASE WHEN u=0 AND v=0 THEN elevation_m/6000*{D(9.6)} ELSE 0 END,6)+0.0 z FROM a, range(8) p(u), range(8) q(v)")
def diffusion_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The chain ends at the prior's mean, whatever the seed."""
    return raster.sample(_prior(spark, sf_dir)).select("id", "u", "v", (F.round("z", 6) + F.lit(0.0)).alias("z"))


_W = "(CASE WHEN {0}=0 THEN sqrt(CAST(1 AS double)/32) ELSE sqrt(CAST(2 AS double)/32) END*cos((2*{1}+1)*{0}*pi()/64))"
DCT_SQL = f"WITH f AS ({_H}), c AS (SELECT scene_id, CAST(u AS int) u, CAST(v AS int) v, sum(h*{_W.format('u', 'y')}*{_W.format('v', 'x')}) c FROM f, range(8) p(u), range(8) q(v) GROUP BY ALL)"


@query("dct_encode", DCT_SQL + " SELECT scene_id, u, v, round(c,6)+0.0 c FROM c")
def dct_encode(spark: SparkSession, sf_dir: str) -> DataFrame:
    return raster.dct_encode(heights(spark, sf_dir), N, 8).select("scene_id", "u", "v", (F.round("c", 6) + F.lit(0.0)).alias("c"))


@query("dct_decode", DCT_SQL + f" SELECT scene_id, CAST(y AS int) y, CAST(x AS int) x, round(sum(c*{_W.format('u', 'y')}*{_W.format('v', 'x')}),6)+0.0 h FROM c, range(32) p(y), range(32) q(x) GROUP BY ALL")
def dct_decode(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = raster.dct_decode(raster.dct_encode(heights(spark, sf_dir), N, 8), N)
    return out.select("scene_id", "y", "x", (F.round("h", 6) + F.lit(0.0)).alias("h"))


_NB = f"""WITH f AS ({_H}), n AS (SELECT *, lag(h) OVER r l, lead(h) OVER r e, lag(h) OVER c u, lead(h) OVER c d FROM f WINDOW r AS (PARTITION BY scene_id, y ORDER BY x), c AS (PARTITION BY scene_id, x ORDER BY y)),
g AS (SELECT *, sqrt(power(CASE WHEN l IS NULL THEN e-h WHEN e IS NULL THEN h-l ELSE (e-l)/2 END,2)+power(CASE WHEN u IS NULL THEN d-h WHEN d IS NULL THEN h-u ELSE (d-u)/2 END,2)) slope FROM n),
wr AS (SELECT a.*, p.h wl, q.h we, s.h wu, t.h wd FROM g a JOIN f p ON p.scene_id=a.scene_id AND p.y=a.y AND p.x=(a.x+31)%32 JOIN f q ON q.scene_id=a.scene_id AND q.y=a.y AND q.x=(a.x+1)%32
       JOIN f s ON s.scene_id=a.scene_id AND s.x=a.x AND s.y=(a.y+31)%32 JOIN f t ON t.scene_id=a.scene_id AND t.x=a.x AND t.y=(a.y+1)%32)"""


@query("slope_magnitude", _NB + " SELECT scene_id, y, x, round(slope,6) slope FROM g")
def slope_magnitude(spark: SparkSession, sf_dir: str) -> DataFrame:
    return field.slope_magnitude(heights(spark, sf_dir)).select("scene_id", "y", "x", F.round("slope", 6).alias("slope"))


_FLOW = """, o(dy, dx, i) AS (VALUES (-1,0,0),(1,0,1),(0,1,2),(0,-1,3),(-1,1,4),(-1,-1,5),(1,1,6),(1,-1,7)),
dr AS (SELECT a.scene_id, a.y, a.x, o.dy, o.dx, a.h-b.h dp FROM f a, o JOIN f b ON b.scene_id=a.scene_id AND b.y=a.y+o.dy AND b.x=a.x+o.dx QUALIFY row_number() OVER (PARTITION BY a.scene_id,a.y,a.x ORDER BY a.h-b.h DESC, o.i)=1),
rc AS (SELECT scene_id, CASE WHEN dp>0 THEN y+dy ELSE y END y, CASE WHEN dp>0 THEN x+dx ELSE x END x, count(*)*CAST(0.02 AS double) q FROM dr GROUP BY ALL),
fl AS (SELECT f.scene_id, f.y, f.x, coalesce(q,0) q FROM f LEFT JOIN rc USING(scene_id,y,x))"""


@query("flow_accumulation_step", _NB + _FLOW + " SELECT scene_id, y, x, round(q,6) q FROM fl")
def flow_accumulation_step(spark: SparkSession, sf_dir: str) -> DataFrame:
    return field.flow_step(heights(spark, sf_dir), 0.02).select("scene_id", "y", "x", F.round("q", 6).alias("q"))


@query("hydraulic_step", _NB + _FLOW + f" SELECT scene_id, y, x, round(h+{D(0.35)}*least(greatest(-{D(0.2)}*q*slope+{D(0.288)}*(wl+we+wu+wd-4*h),{D(-0.35)}),{D(0.35)}),6)+0.0 h FROM wr JOIN fl USING(scene_id,y,x)")
def hydraulic_step(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = field.hydraulic_step(field.flow_step(heights(spark, sf_dir), 0.02))
    return out.select("scene_id", "y", "x", (F.round("h", 6) + F.lit(0.0)).alias("h"))


_TAN = D(math.tan(math.radians(34.0)))
_GIVE = "coalesce(CASE WHEN {0}>" + _TAN + " THEN ({0}-" + _TAN + f")*{D(0.125)} ELSE 0 END,0)"


@query(
    "thermal_step",
    _NB + f" SELECT scene_id, y, x, round(h+{D(0.25)}*least(greatest(" + "+".join(_GIVE.format(f"({n}-h)") for n in "leud") + "-" + "-".join(_GIVE.format(f"(h-{n})") for n in "leud") + f",{D(-0.3)}),{D(0.3)}),6)+0.0 h FROM n",
)
def thermal_step(spark: SparkSession, sf_dir: str) -> DataFrame:
    return field.thermal_step(heights(spark, sf_dir)).select("scene_id", "y", "x", (F.round("h", 6) + F.lit(0.0)).alias("h"))


def _rounded(c: str) -> Column:
    """Six places as SQL rounds them: in double precision. Spark rounds the decimal digits, which differs where these end in a 5."""
    return F.round(F.col(c) * 1e6) / 1e6 + F.lit(0.0)


@query("seismic_step", _NB + f", s AS (SELECT *, (0+(wl+we+wu+wd-4*h))*{D(0.996)} v FROM wr) SELECT scene_id, y, x, round(CASE WHEN y IN (0,31) OR x IN (0,31) THEN 0 ELSE h+{D(0.25)}*v END,6)+0.0 h, round(v,6)+0.0 v FROM s")
def seismic_step(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = field.seismic_step(heights(spark, sf_dir).withColumn("v", F.lit(0.0)))
    return out.select("scene_id", "y", "x", *[_rounded(c).alias(c) for c in "hv"])


def _solved(name: str, steps: int):
    return lambda spark, sf_dir: field.solve(heights(spark, sf_dir), name, steps)


for _name, _steps in (("hydraulic", 24), ("thermal", 24), ("seismic", 24), ("diffusion", 10)):
    query({"diffusion": "diffusion_spectral"}.get(_name, f"solve_{_name}"))(_solved(_name, _steps))


@query("upsample")
def upsample(spark: SparkSession, sf_dir: str) -> DataFrame:
    return field.per_scene(heights(spark, sf_dir), lambda h: field.upsample(h, 64, 64))


@query("fno_rollout")
def fno_rollout(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neural.rollout(heights(spark, sf_dir), neural.Operator.seeded(), 2)


# An octahedron per region, its size and place from the key, and for odd keys without its last face.
_V = "SELECT CAST(r_regionkey AS int) mesh_id, CAST(c.vid AS bigint) vid, (r_regionkey+1)*CAST(c.x AS double)+r_regionkey x, (r_regionkey+1)*CAST(c.y AS double) y, (r_regionkey+1)*CAST(c.z AS double) z FROM region CROSS JOIN (VALUES (0,1,0,0),(1,-1,0,0),(2,0,1,0),(3,0,-1,0),(4,0,0,1),(5,0,0,-1)) c(vid,x,y,z)"
_F = "SELECT CAST(r_regionkey AS int) mesh_id, CAST(t.a AS bigint) a, CAST(t.b AS bigint) b, CAST(t.c AS bigint) c FROM region CROSS JOIN (VALUES (0,0,2,4),(1,2,1,4),(2,1,3,4),(3,3,0,4),(4,2,0,5),(5,1,2,5),(6,3,1,5),(7,0,3,5)) t(n,a,b,c) WHERE t.n < 7 OR r_regionkey % 2 = 0"


def _mesh(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    table(spark, sf_dir, "region").createOrReplaceTempView("region")
    return spark.sql(_V), spark.sql(_F)


@query(
    "mesh_topology",
    f"WITH f AS ({_F}), d AS (SELECT mesh_id, a s, b t FROM f UNION ALL SELECT mesh_id, b, c FROM f UNION ALL SELECT mesh_id, c, a FROM f), u AS (SELECT mesh_id, count(*) n FROM d GROUP BY mesh_id, least(s,t), greatest(s,t)), w AS (SELECT mesh_id, count(*) n FROM d GROUP BY mesh_id, s, t), a AS (SELECT mesh_id, count(*) edge_count, CAST(sum(CASE WHEN n<>2 THEN 1 ELSE 0 END) AS bigint) non_manifold_edges FROM u GROUP BY mesh_id), b AS (SELECT mesh_id, CAST(sum(CASE WHEN n<>1 THEN 1 ELSE 0 END) AS bigint) inconsistent_directed_edges FROM w GROUP BY mesh_id) SELECT *, non_manifold_edges=0 AND inconsistent_directed_edges=0 watertight FROM a JOIN b USING(mesh_id)",
)
def mesh_topology(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mesh.topology(_mesh(spark, sf_dir)[1])


_CORNERS = f"WITH v AS ({_V}), f AS ({_F}), t AS (SELECT f.*, p.x ax, p.y ay, p.z az, q.x bx, q.y by_, q.z bz, r.x cx, r.y cy, r.z cz FROM f JOIN v p ON p.mesh_id=f.mesh_id AND p.vid=a JOIN v q ON q.mesh_id=f.mesh_id AND q.vid=b JOIN v r ON r.mesh_id=f.mesh_id AND r.vid=c)"


@query("signed_volume", _CORNERS + " SELECT mesh_id, round(sum(ax*(by_*cz-bz*cy)+ay*(bz*cx-bx*cz)+az*(bx*cy-by_*cx))/6,6) volume FROM t GROUP BY mesh_id")
def signed_volume(spark: SparkSession, sf_dir: str) -> DataFrame:
    v, f = _mesh(spark, sf_dir)
    return mesh.signed_volume(f, v).select("mesh_id", F.round("volume", 6).alias("volume"))


@query(
    "vertex_normals",
    _CORNERS
    + ", n AS (SELECT mesh_id, unnest([a,b,c]) vid, (by_-ay)*(cz-az)-(bz-az)*(cy-ay) nx, (bz-az)*(cx-ax)-(bx-ax)*(cz-az) ny, (bx-ax)*(cy-ay)-(by_-ay)*(cx-ax) nz FROM t), s AS (SELECT mesh_id, vid, sum(nx) nx, sum(ny) ny, sum(nz) nz FROM n GROUP BY ALL) SELECT mesh_id, vid, round(nx/l,6)+0.0 nx, round(ny/l,6)+0.0 ny, round(nz/l,6)+0.0 nz FROM (SELECT *, greatest(sqrt(nx*nx+ny*ny+nz*nz),1e-12) l FROM s)",
)
def vertex_normals(spark: SparkSession, sf_dir: str) -> DataFrame:
    v, f = _mesh(spark, sf_dir)
    return mesh.vertex_normals(f, v).select("mesh_id", "vid", *[(F.round(c, 6) + F.lit(0.0)).alias(c) for c in ("nx", "ny", "nz")])


LEVELS = 12
SDF_SQL = f"""WITH f AS (SELECT scene_id mesh_id, y, x, h FROM ({_H})), sp AS (SELECT mesh_id, max(h) hi, min(h)-greatest(greatest(max(h)-min(h),1e-6)*{D(0.35)},0.5) zb FROM f GROUP BY mesh_id),
sd AS (SELECT mesh_id, CAST(i AS int) i, CAST(j AS int) j, CAST(k AS int) k, CASE WHEN h IS NOT NULL AND k BETWEEN 2 AND {LEVELS + 1} THEN greatest(z-h, zb-z) ELSE 1 END f
       FROM sp, range(36) a(i), range(36) b(j), range({LEVELS + 4}) c(k) LEFT JOIN f ON f.mesh_id=sp.mesh_id AND f.x=i-2 AND f.y=j-2, LATERAL (SELECT zb+(hi-zb)/{LEVELS - 1}*(k-{D(1.5)}) z) q)""".replace("SELECT mesh_id, CAST(i", "SELECT sp.mesh_id, CAST(i")


def _sdf(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mesh.sdf_slab(heights(spark, sf_dir).withColumnRenamed("scene_id", "mesh_id"), LEVELS)


@query("sdf_slab", SDF_SQL + " SELECT mesh_id, i, j, k, round(f,6)+0.0 f FROM sd")
def sdf_slab(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _sdf(spark, sf_dir).select("mesh_id", "i", "j", "k", (F.round("f", 6) + F.lit(0.0)).alias("f"))


@query(
    "surface_nets_vertices",
    SDF_SQL
    + """, o(a,di,dj,dk) AS (VALUES (0,1,0,0),(1,0,1,0),(2,0,0,1)),
ch AS (SELECT p.mesh_id, a, p.i, p.j, p.k, p.i+di*t x, p.j+dj*t y, p.k+dk*t z FROM sd p, o JOIN sd q ON q.mesh_id=p.mesh_id AND q.i=p.i+di AND q.j=p.j+dj AND q.k=p.k+dk, LATERAL (SELECT p.f/nullif(p.f-q.f,0) t) l WHERE (p.f<0)<>(q.f<0)),
cl AS (SELECT mesh_id, i-CASE WHEN a=0 THEN 0 WHEN a=2 THEN m ELSE n END ci, j-CASE WHEN a=1 THEN 0 WHEN a=0 THEN m ELSE n END cj, k-CASE WHEN a=2 THEN 0 WHEN a=1 THEN m ELSE n END ck, x, y, z FROM ch, range(2) u(m), range(2) w(n))
SELECT mesh_id, CAST(ci AS int) i, CAST(cj AS int) j, CAST(ck AS int) k, round(avg(x),5) x, round(avg(y),5) y, round(avg(z),5) z FROM cl WHERE ci>=0 AND cj>=0 AND ck>=0 GROUP BY ALL""",
)
def surface_nets_vertices(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mesh.surface_nets_vertices(_sdf(spark, sf_dir)).select("mesh_id", "cell.i", "cell.j", "cell.k", *[F.round(c, 5).alias(c) for c in "xyz"])


@query("surface_nets")
def surface_nets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The audit of the extracted meshes, with their volume in grid units."""
    v, f = mesh.surface_nets(_sdf(spark, sf_dir))
    return mesh.topology(f).join(mesh.signed_volume(f, v), "mesh_id")


@query("marching_tets")
def marching_tets(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = mesh.marching_tetrahedra(_sdf(spark, sf_dir))
    f = c.groupBy("mesh_id", "face").agg(*[F.max(F.when(F.col("corner") == n, F.col("vid"))).alias(a) for n, a in enumerate("abc")])
    v = c.groupBy("mesh_id", "vid").agg(*[F.first(a).alias(a) for a in "xyz"])
    return mesh.topology(f).join(mesh.signed_volume(f, v), "mesh_id")
