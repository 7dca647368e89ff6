"""The geometry functions under their SQL names, for ``spark.sql``.

Each is a temporary SQL function whose body is the text of the Column
expression, so the optimizer sees plain expressions and no Python runs.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, SparkSession, functions as F

from terraloom.functions import geometry as g

POINT = "STRUCT<x: DOUBLE, y: DOUBLE>"
GEOMETRY = f"STRUCT<dim: INT, pts: ARRAY<{POINT}>, segs: ARRAY<STRUCT<x1: DOUBLE, y1: DOUBLE, x2: DOUBLE, y2: DOUBLE>>, box: STRUCT<x0: DOUBLE, y0: DOUBLE, x1: DOUBLE, y1: DOUBLE>>"
#: Operators that the text of an expression shows as functions.
_OPERATOR = re.compile(r"(?<![\w`'])(<=>|<=|>=|<>|!=|==|[-+*/%<>=!]|and|or|not)\(")

FUNCTIONS = {name: (f, 2, "BOOLEAN") for name, f in g.PREDICATES.items()} | {
    "ST_Distance": (g.st_distance, 2, "DOUBLE"), "ST_Area": (g.st_area, 1, "DOUBLE"), "ST_Length": (g.st_length, 1, "DOUBLE"), "ST_Centroid": (g.st_centroid, 1, POINT),
}


def text_of(c: Column) -> str:
    """SQL that parses to the expression."""
    found = _OPERATOR.sub(r"`\1`(", c._jc.node().sql())
    found = re.sub(r"\bInfinity\b", "CAST('Infinity' AS DOUBLE)", found)
    return re.sub(r"(?<![\w.'])(\d+\.\d+)(?![\w.])", r"\1D", found)  # else they would be decimals


def register(spark: SparkSession) -> list[str]:
    """Make the functions known to ``spark.sql``, with ST_GeomFromGeoJSON for text; their names."""
    for name, (f, n, kind) in FUNCTIONS.items():
        body = text_of(f(*[F.col(p) for p in "ab"[:n]]))
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}({', '.join(f'{p} {GEOMETRY}' for p in 'ab'[:n])}) RETURNS {kind} RETURN {body}")
    spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION ST_GeomFromGeoJSON(a STRING) RETURNS {GEOMETRY} RETURN {text_of(g.from_geojson(F.col('a')))}")
    return [*FUNCTIONS, "ST_GeomFromGeoJSON"]
