"""Spatial joins over features (id, kind, geom, ...), planned as equi-joins on grid cells.

Cells come in levels, each twice as wide as the one before. A feature is at
home on the level where its box covers at most two cells a side, and goes to
the cells it covers there and on every coarser level that some feature is at
home on; a pair meets on the coarser home of the two. So a long line is a few
cells, a point doesn't meet all points of a region's cell, and how many rows a
feature makes doesn't depend on the others' size. A pair that shares several
cells counts in the first only, so no distinct is needed. The box comparison
stands before the exact predicates. Hot cells are left to adaptive execution,
which splits them: no side of these joins needs a cell in one piece.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from terraloom.functions import geometry as g

CELL = 1 / 16  #: degrees, on level 0
LEVELS = 14  #: the coarsest level has cells wider than the globe

#: Relation names by predicate; any other predicate gives its own name in lower case.
RELATIONS = {"ST_Intersects": "intersects", "ST_Contains": "contains", "ST_Within": "overlies", "ST_Touches": "abuts"}


def _size(level: Column) -> Column:
    return F.pow(F.lit(2.0), level) * CELL


def home(box: Column) -> Column:
    """The level on which a box covers at most two cells a side."""
    wide = F.greatest(box["x1"] - box["x0"], box["y1"] - box["y0"]) / CELL
    return F.least(F.greatest(F.ceil(F.log2(F.greatest(wide, F.lit(1.0)))), F.lit(0)), F.lit(LEVELS)).cast("int")


def with_cells(features: DataFrame, levels: Column | None = None) -> DataFrame:
    """A row per level, home and coarser (or those in ``levels``), and cell that a feature's box covers: level, cx, cy, home.

    Features without a box (null or empty geometries) have none.
    """
    b = F.col("geom.box")
    above = F.sequence(F.col("home"), F.lit(LEVELS))
    rows = features.where(F.col("geom.box.x0").isNotNull()).withColumn("home", home(b))
    rows = rows.withColumn("level", F.explode(above if levels is None else F.array_intersect(above, levels)))
    size = _size(F.col("level"))
    across = F.explode(F.sequence(F.floor(b["x0"] / size), F.floor(b["x1"] / size))).alias("cx")
    up = F.explode(F.sequence(F.floor(b["y0"] / size), F.floor(b["y1"] / size))).alias("cy")
    return rows.select("*", across).select("*", up)


def candidate_pairs(left: DataFrame, right: DataFrame) -> DataFrame:
    """Pairs (a, b) of rows, as structs, whose boxes meet.

    On the level a pair meets on, one of the two is at home: rows on their way
    up are joined with those at home only. The left rows are dealt over all
    cores, as the work grows with pairs and not with bytes.
    """
    used = [r[0] for r in left.select("geom").union(right.select("geom")).where(F.col("geom.box.x0").isNotNull()).select(home(F.col("geom.box")).alias("home")).distinct().collect()]  # at most LEVELS + 1
    levels = F.array(*[F.lit(int(x)) for x in sorted(used)]).cast("array<int>")
    side = lambda rows, name: with_cells(rows, levels).select("level", "cx", "cy", F.col("home").alias(f"_{name}"), F.struct(*rows.columns).alias(name))
    p, q, size = F.col("a.geom.box"), F.col("b.geom.box"), _size(F.col("level"))
    met = (F.col("cx") == F.floor(F.greatest(p["x0"], q["x0"]) / size)) & (F.col("cy") == F.floor(F.greatest(p["y0"], q["y0"]) / size))
    a, b = side(left.repartition(tasks(left)), "a"), side(right, "b")
    at_home, above = a.where(F.col("_a") == F.col("level")), a.where(F.col("_a") < F.col("level"))
    cell = ["level", "cx", "cy"]
    rows = at_home.join(b, cell).union(above.join(b.where(F.col("_b") == F.col("level")), cell))
    return rows.where(met & g.boxes_meet(F.col("a.geom"), F.col("b.geom"))).select("a", "b")


def tasks(rows: DataFrame) -> int:
    """Tasks for work that grows with pairs: some for each core."""
    return 3 * rows.sparkSession.sparkContext.defaultParallelism


def _lines_that_meet(pairs: DataFrame, columns: list[Column]) -> DataFrame:
    """``columns`` of pairs (a, b) of lines with segments that meet: a row per pair of segments, judged by plain columns.

    The number a pair gets lives within its task only, up to the exchange.
    """
    ends = ("x1", "y1", "x2", "y2")
    names = [f"_c{i}" for i in range(len(columns))]
    rows = pairs.select(*[c.alias(n) for c, n in zip(columns, names)], F.col("a.geom.segs").alias("_s"), F.col("b.geom.segs").alias("_t")).withColumn("_p", F.monotonically_increasing_id())
    rows = rows.withColumn("_s", F.explode("_s")).withColumn("_t", F.explode("_t"))
    s, t = ({k: F.col(f"{v}.{k}") for k in ends} for v in ("_s", "_t"))
    turns = {f"_{k}": v for k, v in g.turns(s, t).items()}
    met = rows.withColumns(turns).where(g.turned({k[1:]: F.col(k) for k in turns}, s, t))
    kept = met.select("_p", *names).dropDuplicates(["_p"])
    return kept.select(*[F.col(n).alias(o) for n, o in zip(names, pairs.select(*columns).columns)])


def spatial_join(left: DataFrame, right: DataFrame, name: str, extra: Column | None = None, columns: list[Column] | None = None) -> DataFrame:
    """Pairs (a, b) of rows, as structs, for which the predicate holds; or ``columns`` of them.

    Lines have no inside: two of them intersect, and touch, where segments
    meet, and hold no other predicate. They are by far the most pairs and are
    judged apart.
    """
    rows = candidate_pairs(left, right)
    if extra is not None:
        rows = rows.where(extra)
    columns = columns or [F.col("a"), F.col("b")]
    judge = g.predicate(name)(F.col("a.geom"), F.col("b.geom"))
    lines = F.coalesce((F.col("a.geom.dim") == 1) & (F.col("b.geom.dim") == 1), F.lit(False))
    found = rows.where(~lines).where(judge).select(*columns)
    return found.union(_lines_that_meet(rows.where(lines), columns)) if name in ("ST_Intersects", "ST_Touches") else found


def neighbors(features: DataFrame, fid: str, name: str = "ST_Intersects", exclude_self: bool = True) -> DataFrame:
    """(id, d) of features for which the predicate holds with feature ``fid``, nearest first.

    The anchor is one row by its key; it is broadcast.
    """
    anchor = features.where(F.col("id") == fid).select(F.col("geom").alias("_anchor")).limit(1)
    rows = features.join(F.broadcast(anchor), g.boxes_meet(F.col("geom"), F.col("_anchor")))
    if exclude_self:
        rows = rows.where(F.col("id") != fid)
    rows = rows.where(g.predicate(name)(F.col("_anchor"), F.col("geom")))
    return rows.select("id", g.st_distance(F.col("_anchor"), F.col("geom")).alias("d")).orderBy("d", "id")


def near(features: DataFrame, some: DataFrame, name: str = "ST_Intersects") -> DataFrame:
    """(src, dst, d) from the features named in ``some`` (id) to all others for which the predicate holds."""
    slim = features.select("id", "geom")
    pairs = spatial_join(slim.join(some.select("id").distinct(), "id", "left_semi"), slim, name, F.col("a.id") != F.col("b.id"))
    return pairs.select(F.col("a.id").alias("src"), F.col("b.id").alias("dst"), g.st_distance(F.col("a.geom"), F.col("b.geom")).alias("d"))


def bbox_candidates(features: DataFrame, x0: float, y0: float, x1: float, y1: float) -> DataFrame:
    """Features whose box meets the given one: plain comparisons, pushed to the scan where boxes are stored."""
    b = F.col("geom.box")
    return features.where((b["x1"] >= x0) & (b["x0"] <= x1) & (b["y1"] >= y0) & (b["y0"] <= y1))


def abuts_edges(features: DataFrame) -> DataFrame:
    """One-way abuts edges from faults and units to the regions they meet."""
    low = features.where(F.col("kind").isin("fault", "unit"))
    rows = spatial_join(low, features.where(F.col("kind") == "region"), "ST_Intersects")
    return rows.select(F.col("a.id").alias("src"), F.col("b.id").alias("dst"), F.lit("abuts").alias("rel"), F.lit(1.0).alias("weight"))


def build_spatial_edges(features: DataFrame, predicates: tuple[str, ...] = ("ST_Intersects", "ST_Contains")) -> DataFrame:
    """Edges in both directions for pairs a.id < b.id per predicate, and the abuts edges; one row per (src, dst, rel).

    Pairs are joined once and every predicate is judged on the pair.
    """
    a, b = F.col("a.geom"), F.col("b.geom")
    slim = features.select("id", "kind", "geom")
    pairs = candidate_pairs(slim, slim).where(F.col("a.id") < F.col("b.id"))
    edge = lambda s, t, rel: F.struct(F.col(s).alias("src"), F.col(t).alias("dst"), F.lit(rel).alias("rel"))
    none = F.array().cast("array<struct<src:string,dst:string,rel:string>>")
    found = []
    for name in predicates:
        rel = RELATIONS.get(name, name.lower())
        found.append(F.when(g.predicate(name)(a, b), F.array(edge("a.id", "b.id", rel), edge("b.id", "a.id", rel))).otherwise(none))
    for low, high in ("ab", "ba"):
        rests = F.col(f"{low}.kind").isin("fault", "unit") & (F.col(f"{high}.kind") == "region")
        found.append(F.when(rests & g.st_intersects(F.col(f"{low}.geom"), F.col(f"{high}.geom")), F.array(edge(f"{low}.id", f"{high}.id", "abuts"))).otherwise(none))
    return pairs.select(F.explode(F.array_distinct(F.concat(*found))).alias("e")).select("e.src", "e.dst", "e.rel", F.lit(1.0).alias("weight"))
