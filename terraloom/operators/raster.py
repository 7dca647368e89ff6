"""Rasters of weighted influences, and harmonic and cosine transforms, over long-form cells."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, functions as F



#: Attributes and what stands in where nothing is known.
DEFAULTS = {"elevation_m": 1800.0, "relief_m": 1400.0, "hardness": 5.0, "rainfall_mm": 520.0, "uplift_mm_yr": 4.0, "roughness": 0.55}
FALLBACK = (71.0, 32.2, 77.0, 36.2)


def physical(item: DataFrame) -> Column:
    """Whether an item has a terrain property of its own; columns that are absent count as null."""
    known = [F.col(c).isNotNull() for c in ("elevation_m", "relief_m", "thickness_m", "depth_m") if c in item.columns]
    out = F.lit(False)
    for k in known:
        out = out | k
    return out


def weighted_attrs(items: DataFrame) -> DataFrame:
    """One row of attributes: the score-weighted mean over physical items; a missing value dilutes, zero means the default."""
    w = F.when(physical(items), F.col("score")).otherwise(0.0)
    rows = items.withColumn("_w", w)
    mean = lambda k: F.sum(F.col("_w") * F.coalesce(F.col(k), F.lit(0.0))) / F.nullif(F.sum("_w"), F.lit(0.0))
    return rows.agg(*[F.coalesce(F.nullif(mean(k), F.lit(0.0)), F.lit(v)).alias(k) for k, v in DEFAULTS.items()])


def extent(items: DataFrame) -> DataFrame:
    """The box of all items' boxes, widened by 8 % (0.05 degrees at least) on each side."""
    b = "geom.box."
    rows = items.agg(*[F.coalesce(f(b + c), F.lit(d)).alias(c) for f, c, d in zip((F.min, F.min, F.max, F.max), ("x0", "y0", "x1", "y1"), FALLBACK)])
    px, py = F.greatest((F.col("x1") - F.col("x0")) * 0.08, F.lit(0.05)), F.greatest((F.col("y1") - F.col("y0")) * 0.08, F.lit(0.05))
    return rows.select((F.col("x0") - px).alias("x0"), (F.col("y0") - py).alias("y0"), (F.col("x1") + px).alias("x1"), (F.col("y1") + py).alias("y1"))


def cells(spark: SparkSession, n: int) -> DataFrame:
    """Indices (cy, cx) of an n by n grid."""
    return spark.range(n * n).select(F.floor(F.col("id") / n).cast("int").alias("cy"), (F.col("id") % n).cast("int").alias("cx"))


def distance_to(geom: Column, x: Column, y: Column) -> Column:
    """Planar degrees from a place to a geometry, 0 inside a polygon."""

    def to_segment(s: Column) -> Column:
        dx, dy = s["x2"] - s["x1"], s["y2"] - s["y1"]
        long = dx * dx + dy * dy
        t = ((x - s["x1"]) * dx + (y - s["y1"]) * dy) / F.when(long == 0, 1e-12).otherwise(long)
        t = F.least(F.greatest(t, F.lit(0.0)), F.lit(1.0))
        return F.hypot(x - (s["x1"] + t * dx), y - (s["y1"] + t * dy))

    crossed = F.size(F.filter(geom["segs"], lambda s: ((s["y1"] > y) != (s["y2"] > y)) & (x < (s["x2"] - s["x1"]) * (y - s["y1"]) / F.when(s["y2"] == s["y1"], 1e-12).otherwise(s["y2"] - s["y1"]) + s["x1"])))
    nearest = F.array_min(F.transform(geom["segs"], to_segment))
    return F.when(geom["dim"] == 0, F.hypot(x - geom["pts"][0]["x"], y - geom["pts"][0]["y"])).when((geom["dim"] == 2) & (crossed % 2 == 1), 0.0).otherwise(nearest)


def radius(geom: Column) -> Column:
    b = geom["box"]
    return F.when(geom["dim"] == 0, 0.45).otherwise(F.greatest(F.lit(0.18), F.hypot(b["x1"] - b["x0"], b["y1"] - b["y0"]) * 0.55))


def influence(items: DataFrame, n: int, channels: tuple[str, ...] = tuple(DEFAULTS)) -> DataFrame:
    """(cy, cx, w, and per channel the weighted sum): every item acts on every cell of an n by n grid.

    ``items`` (geom, score, channels) are the few results of a retrieval; the
    grid is as large as asked for, so cells are the distributed side.
    """
    frame = extent(items)
    weight = F.greatest(F.col("score") * F.when(physical(items), 1.0).otherwise(0.15), F.lit(1e-4))
    acts = items.select("geom", weight.alias("_w"), radius(F.col("geom")).alias("_r"), *channels)
    grid = cells(items.sparkSession, n).join(F.broadcast(frame))
    step = max(n - 1, 1)
    grid = grid.select("cy", "cx", (F.col("x0") + (F.col("x1") - F.col("x0")) * F.col("cx") / step).alias("_x"), (F.col("y0") + (F.col("y1") - F.col("y0")) * F.col("cy") / step).alias("_y"))
    met = grid.join(acts)  # items stay whole; Spark sends them round if they are small
    d = distance_to(F.col("geom"), F.col("_x"), F.col("_y")) / F.col("_r")
    met = met.withColumn("_k", F.col("_w") * F.exp(-(d * d)))
    return met.groupBy("cy", "cx").agg(F.sum("_k").alias("w"), *[F.sum(F.col("_k") * F.coalesce(F.col(c), F.lit(0.0))).alias(c) for c in channels])


def blend(raster: DataFrame, attrs: DataFrame, channels: tuple[str, ...] = tuple(DEFAULTS)) -> DataFrame:
    """Local means where influence is strong, the overall attributes elsewhere; weight is the influence over its largest."""
    most = raster.agg(F.greatest(F.max("w"), F.lit(1e-9)).alias("_m"))
    rows = raster.join(F.broadcast(most)).join(F.broadcast(attrs.select(*[F.col(c).alias(f"_{c}") for c in channels])))
    share = F.least(F.greatest(F.col("w") / F.col("_m"), F.lit(0.0)), F.lit(1.0))
    local = lambda c: F.when(F.col("w") > 1e-9, F.col(c) / F.greatest(F.col("w"), F.lit(1e-9))).otherwise(F.col(f"_{c}"))
    return rows.select("cy", "cx", *[(local(c) * share + F.col(f"_{c}") * (1 - share)).alias(c) for c in channels], share.alias("weight"))


CHANNELS = ("elevation", "relief", "hardness", "rainfall", "uplift", "roughness", "weight")


def angles(lon: Column, lat: Column) -> tuple[Column, Column]:
    """Polar and azimuthal angle of the direction that lies ``lon`` and ``lat`` degrees from the middle of a map."""
    dlon, dlat = F.radians(lon), F.radians(lat)
    return direction_angles(F.cos(dlat) * F.sin(dlon), -F.cos(dlat) * F.cos(dlon), F.sin(dlat))


def direction_angles(x: Column, y: Column, z: Column) -> tuple[Column, Column]:
    """Polar and azimuthal angle of a direction of any length but zero."""
    length = F.sqrt(x * x + y * y + z * z)
    return F.acos(F.least(F.greatest(z / length, F.lit(-1.0)), F.lit(1.0))), F.atan2(y, x)


def conditioning(items: DataFrame, n: int = 32, degree: int = 4) -> tuple[DataFrame, dict]:
    """What retrieved ``items`` (score, geom, attributes) say of a terrain: a raster of ``CHANNELS`` by (cy, cx), and its description.

    The elevation channel is what spherical harmonics up to ``degree``, fitted
    by least squares around the middle of the extent, make of it.
    """
    attrs = weighted_attrs(items)
    grid = blend(influence(items, n), attrs)
    frame = extent(items)
    x0, y0, x1, y1 = frame.first()  # one row
    step = max(n - 1, 1)
    theta, phi = angles((F.col("cx") / step - 0.5) * (x1 - x0), (F.col("cy") / step - 0.5) * (y1 - y0))
    names = [f"_y{k}" for k in range((degree + 1) ** 2)]
    rows = grid.select("*", *[c.alias(k) for k, c in zip(names, harmonics(theta, phi, degree).values())])
    coefficients = fit(rows, names, "elevation_m")
    smooth = sum((F.col(k) * float(c) for k, c in zip(names, coefficients)), F.lit(0.0))
    own = [F.col(c) for c in DEFAULTS][1:]
    out = rows.select("cy", "cx", smooth.alias("elevation"), *[c.alias(k) for c, k in zip(own, CHANNELS[1:])], "weight")
    known = attrs.join(grid.agg(F.avg("weight").alias("influence_weight"))).first().asDict()
    return out, {"attrs": known, "extent": (x0, y0, x1, y1), "shape": (len(CHANNELS), n, n), "channels": CHANNELS, "sh_degree": degree, "sh_coeffs": coefficients.tolist(), "influences": items.count()}


def harmonics(theta: Column, phi: Column, degree: int) -> dict[tuple[int, int], Column]:
    """Real orthonormal spherical harmonics by (l, m), Condon-Shortley phase included."""
    x, s = F.cos(theta), F.abs(F.sin(theta))
    p: dict[tuple[int, int], Column] = {(0, 0): F.lit(1.0)}
    for m in range(1, degree + 1):
        p[m, m] = F.pow(s, F.lit(float(m))) * float((-1) ** m * math.prod(range(1, 2 * m, 2)))
    for m in range(degree + 1):
        for l in range(m + 1, degree + 1):  # noqa: E741
            before = p[l - 2, m] * float(l + m - 1) if l - 2 >= m else F.lit(0.0)
            p[l, m] = (x * p[l - 1, m] * float(2 * l - 1) - before) / float(l - m)
    out = {}
    for l in range(degree + 1):  # noqa: E741
        for m in range(-l, l + 1):
            k = abs(m)
            scale = math.sqrt((2 * l + 1) / (4 * math.pi) * math.factorial(l - k) / math.factorial(l + k))
            turn = F.lit(1.0) if m == 0 else (F.cos(phi * k) if m > 0 else F.sin(phi * k)) * math.sqrt(2)
            out[l, m] = p[l, k] * turn * scale
    return out


def fit(rows: DataFrame, columns: list[str], value: str) -> np.ndarray:
    """Least squares by normal equations: one aggregation of k * (k + 1) sums, solved where the query is built."""
    k = len(columns)
    sums = [F.sum(F.col(a) * F.col(b)) for a in columns for b in columns] + [F.sum(F.col(a) * F.col(value)) for a in columns]
    got = np.array(rows.agg(*[s.alias(f"_{i}") for i, s in enumerate(sums)]).first(), float)
    return np.linalg.lstsq(got[: k * k].reshape(k, k), got[k * k :], rcond=None)[0]


def _axis(u: Column, i: Column, n: int) -> Column:
    return F.when(u == 0, math.sqrt(1 / n)).otherwise(math.sqrt(2 / n)) * F.cos((2 * i + 1) * u * (math.pi / (2 * n)))


def dct_encode(field: DataFrame, n: int, k: int) -> DataFrame:
    """(scene_id, u, v, c): the lowest k by k cosine coefficients of n by n fields (scene_id, y, x, h), axis by axis."""
    us = F.explode(F.sequence(F.lit(0), F.lit(k - 1)))
    rows = field.select("scene_id", "y", "x", "h", us.alias("v"))
    half = rows.groupBy("scene_id", "y", "v").agg(F.sum(F.col("h") * _axis(F.col("v"), F.col("x"), n)).alias("c"))
    return half.select("scene_id", "y", "v", "c", us.alias("u")).groupBy("scene_id", "u", "v").agg(F.sum(F.col("c") * _axis(F.col("u"), F.col("y"), n)).alias("c"))


def dct_decode(coeffs: DataFrame, n: int) -> DataFrame:
    """(scene_id, y, x, h) from cosine coefficients (scene_id, u, v, c)."""
    at = F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    half = coeffs.select("scene_id", "u", "v", "c", at.alias("x")).groupBy("scene_id", "u", "x").agg(F.sum(F.col("c") * _axis(F.col("v"), F.col("x"), n)).alias("c"))
    return half.select("scene_id", "u", "x", "c", at.alias("y")).groupBy("scene_id", "y", "x").agg(F.sum(F.col("c") * _axis(F.col("u"), F.col("y"), n)).alias("h"))


def spectral_tilt(u: Column, v: Column, n: int, pinkness: Column | float) -> Column:
    r = F.sqrt(F.pow(u / n, F.lit(2.0)) + F.pow(v / n, F.lit(2.0))) * 6.0
    return 1 / (1 + F.pow(r, pinkness if isinstance(pinkness, Column) else F.lit(float(pinkness))))


def prior(attrs: DataFrame, n: int = 8) -> DataFrame:
    """(id, u, v, mean, std): a diagonal Gaussian in cosine space from physical attributes."""
    hard, rain = F.col("hardness") / 10, F.col("rainfall_mm") / 1200
    pink = F.least(F.greatest(1.9 - 1.1 * hard - 0.4 * rain, F.lit(0.4)), F.lit(2.2))
    index = F.explode(F.sequence(F.lit(0), F.lit(n * n - 1)))
    rows = attrs.select("*", index.alias("i")).withColumn("u", F.floor(F.col("i") / n).cast("int")).withColumn("v", (F.col("i") % n).cast("int"))
    std = F.col("relief_m") / 3500 * spectral_tilt(F.col("u"), F.col("v"), n, pink) * (0.55 + F.col("roughness")) + 1e-3
    return rows.select("id", "u", "v", F.when(F.col("i") == 0, F.col("elevation_m") / 6000 * (n * n * 0.15)).otherwise(0.0).alias("mean"), std.alias("std"))


def sample(priors: DataFrame, steps: int = 48, seed: int = 42, first: float = 1e-4, last: float = 0.02) -> DataFrame:
    """(id, u, v, z) by the reverse diffusion chain of each prior, one per id; the chain ends at the mean."""

    def chain(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["u", "v"])
        mean, std = rows["mean"].to_numpy(), rows["std"].to_numpy()
        rng = np.random.default_rng(seed)
        beta = np.linspace(first, last, steps)
        kept = np.cumprod(1 - beta)
        z = np.sqrt(kept[-1]) * (mean + std * rng.normal(size=len(mean))) + np.sqrt(1 - kept[-1]) * rng.normal(size=len(mean))
        for t in reversed(range(steps)):
            before = kept[t - 1] if t else 1.0
            pull = np.sqrt(before) * beta[t] / (1 - kept[t])
            z = np.sqrt(1 - beta[t]) * (1 - before) / (1 - kept[t]) * z + pull * mean
            if t:
                z = z + np.sqrt((pull * std) ** 2 + beta[t] * (1 - before) / (1 - kept[t])) * rng.normal(size=len(mean))
        return rows.assign(z=z)[["id", "u", "v", "z"]]

    return priors.groupBy("id").applyInPandas(chain, f"id {priors.schema['id'].dataType.simpleString()}, u int, v int, z double")


