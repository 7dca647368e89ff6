"""Height fields (scene_id, y, x, h): relational stencils for single steps, grouped NumPy for long runs.

A step over rows and columns is a window per row and per column of a scene.
``solve`` runs many steps of one scene in one task and many scenes at once.
Routing of water and creep of material go downhill by default; ``compat``
keeps the opposite signs that older results were made with.
"""

from __future__ import annotations

import math
from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F

# Solver names and, below, the default coefficients of each.
SOLVERS = ("hydraulic", "thermal", "seismic", "diffusion")
#: The eight neighbours (dy, dx), in the order in which equal drops are tried.
AROUND = ((-1, 0), (1, 0), (0, 1), (0, -1), (-1, 1), (-1, -1), (1, 1), (1, -1))


def _row() -> Window:
    return Window.partitionBy("scene_id", "y").orderBy("x")


def _column() -> Window:
    return Window.partitionBy("scene_id", "x").orderBy("y")


def _slope(c: str, w) -> Column:
    left, right, here = F.lag(c).over(w), F.lead(c).over(w), F.col(c)
    return F.when(left.isNull(), right - here).when(right.isNull(), here - left).otherwise((right - left) / 2)


def slope_magnitude(field: DataFrame) -> DataFrame:
    rows = field.withColumn("_gx", _slope("h", _row())).withColumn("_gy", _slope("h", _column()))
    return rows.withColumn("slope", F.hypot("_gx", "_gy")).drop("_gx", "_gy")


def flow_step(field: DataFrame, rainfall: float, compat: bool = False) -> DataFrame:
    """(scene_id, y, x, h, q) after rain and one move of all water to the steepest lower neighbour; sinks keep theirs.

    The neighbours come from two windows, not from eight joins.
    """
    sides = field.withColumn("_w", F.lag("h").over(_row())).withColumn("_e", F.lead("h").over(_row()))
    trio = F.struct("_w", "h", "_e")
    rows = sides.withColumn("_n", F.lag(trio).over(_column())).withColumn("_s", F.lead(trio).over(_column()))
    get = {(-1, 0): "_n.h", (1, 0): "_s.h", (0, 1): "_e", (0, -1): "_w", (-1, 1): "_n._e", (-1, -1): "_n._w", (1, 1): "_s._e", (1, -1): "_s._w"}
    drops = [F.struct((F.col("h") - F.col(get[d])).alias("drop"), F.lit(-i).alias("first"), F.lit(d[0]).alias("dy"), F.lit(d[1]).alias("dx")) for i, d in enumerate(AROUND)]
    best = F.array_max(F.filter(F.array(*drops), lambda s: s["drop"].isNotNull()))
    rows = rows.withColumn("_b", best).withColumn("_q", F.coalesce(F.col("q") if "q" in field.columns else F.lit(0.0), F.lit(0.0)) + rainfall)
    moves, sign = F.col("_b.drop") > 0, -1 if compat else 1
    ty = F.col("y") + F.when(moves, F.col("_b.dy") * sign).otherwise(0)
    tx = F.col("x") + F.when(moves, F.col("_b.dx") * sign).otherwise(0)
    got = rows.select("scene_id", ty.alias("y"), tx.alias("x"), "_q").groupBy("scene_id", "y", "x").agg(F.sum("_q").alias("q"))
    return field.select("scene_id", "y", "x", "h").join(got, ["scene_id", "y", "x"], "left").select("scene_id", "y", "x", "h", F.coalesce("q", F.lit(0.0)).alias("q"))


def _around(field: DataFrame, c: str = "h", wrap: bool = False) -> DataFrame:
    """_l, _r, _u, _d: the four neighbours of a cell, null or wrapped past the edge."""
    out = field
    for name, f, w in (("_l", F.lag, _row()), ("_r", F.lead, _row()), ("_u", F.lag, _column()), ("_d", F.lead, _column())):
        edge = (F.last if f is F.lag else F.first)(c).over(w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
        out = out.withColumn(name, F.coalesce(f(c).over(w), edge) if wrap else f(c).over(w))
    return out


def thermal_step(field: DataFrame, talus_deg: float = 34.0, rate: float = 0.5, dt: float = 0.25, compat: bool = False) -> DataFrame:
    """Creep between neighbours steeper than the angle of repose, at most 0.3 a step before dt."""
    t = math.tan(math.radians(talus_deg))
    give = lambda d: F.when(d > t, (d - t) * (rate * 0.25)).otherwise(0.0)
    names = ("_l", "_r", "_u", "_d")
    move = sum((F.coalesce(give(F.col(n) - F.col("h")), F.lit(0.0)) - F.coalesce(give(F.col("h") - F.col(n)), F.lit(0.0)) for n in names), F.lit(0.0))
    move = F.least(F.greatest(-move if compat else move, F.lit(-0.3)), F.lit(0.3))
    return _around(field).withColumn("h", F.col("h") + move * dt).drop(*names)


def hydraulic_step(field: DataFrame, rainfall: float = 0.02, capacity: float = 0.4, deposition: float = 0.3, diffusion: float = 0.12, dt: float = 0.35) -> DataFrame:
    """One step from fields with discharge q: incision by q and slope, hillslope diffusion (wrapping), at most 0.35 before dt."""
    rows = _around(slope_magnitude(field), wrap=True)
    lap = F.col("_l") + F.col("_r") + F.col("_u") + F.col("_d") - 4 * F.col("h")
    dh = -(capacity * max(rainfall, 1e-6) * 25.0) * F.col("q") * F.col("slope") + deposition * diffusion * 8.0 * lap
    dh = F.least(F.greatest(dh, F.lit(-0.35)), F.lit(0.35))
    return rows.select("scene_id", "y", "x", (F.col("h") + dt * dh).alias("h"))


def seismic_step(field: DataFrame, speed: float = 2.0, damping: float = 0.004, dt: float = 0.25) -> DataFrame:
    """(scene_id, y, x, h, v) of a damped wave after one leap; the rim is held at 0."""
    rows = _around(field, wrap=True)
    lap = F.col("_l") + F.col("_r") + F.col("_u") + F.col("_d") - 4 * F.col("h")
    v = (F.col("v") + dt * speed**2 * lap) * (1 - damping)
    rim = lambda c, w: F.lag(c).over(w).isNull() | F.lead(c).over(w).isNull()
    rows = rows.withColumn("_rim", rim("h", _row()) | rim("h", _column())).withColumn("_v", v)
    return rows.select("scene_id", "y", "x", F.when(F.col("_rim"), 0.0).otherwise(F.nanvl(F.col("h") + dt * F.col("_v"), F.lit(0.0))).alias("h"), F.col("_v").alias("v"))


def _flow(h: np.ndarray, rain: float, sweeps: int, compat: bool) -> np.ndarray:
    rows, cols = h.shape
    edge = np.pad(h, 1, constant_values=np.inf)
    drop = np.stack([h - edge[1 + dy : 1 + dy + rows, 1 + dx : 1 + dx + cols] for dy, dx in AROUND])
    best = drop.argmax(0)
    moves = drop.max(0) > 0
    step = np.array(AROUND) * (-1 if compat else 1)
    y, x = np.mgrid[:rows, :cols]
    target = (np.where(moves, y + step[best, 0], y) % rows) * cols + np.where(moves, x + step[best, 1], x) % cols
    q = np.zeros_like(h)
    for _ in range(sweeps):
        q = np.bincount(target.ravel(), (q + rain).ravel(), rows * cols).reshape(rows, cols)
    return q


def _lap(u: np.ndarray) -> np.ndarray:
    return np.roll(u, 1, 0) + np.roll(u, -1, 0) + np.roll(u, 1, 1) + np.roll(u, -1, 1) - 4 * u


def hydraulic(h: np.ndarray, steps: int, rainfall: float = 0.02, capacity: float = 0.4, deposition: float = 0.3, uplift: float = 0.0, hardness: np.ndarray | None = None, compat: bool = False) -> np.ndarray:
    k = capacity * max(rainfall, 1e-6) * 25 / (1.0 if hardness is None or hardness.shape != h.shape else np.clip(hardness, 0.05, 1))
    for _ in range(steps):
        gy, gx = np.gradient(h)
        dh = -k * _flow(h, rainfall, 5, compat) * np.hypot(gx, gy) + deposition * 0.12 * 8 * _lap(h) + uplift
        h = np.pad((h + 0.35 * np.clip(dh, -0.35, 0.35))[1:-1, 1:-1], 1, mode="edge")  # open boundaries
    return h


def thermal(h: np.ndarray, steps: int, talus_deg: float = 34.0, rate: float = 0.5, compat: bool = False) -> np.ndarray:
    t = math.tan(math.radians(talus_deg))
    for _ in range(steps):
        move = np.zeros_like(h)
        for axis in (0, 1):
            d = np.diff(h, axis=axis)
            give = np.sign(d) * np.maximum(np.abs(d) - t, 0) * rate * 0.25  # towards the lower index
            move += np.insert(give, d.shape[axis], 0, axis) - np.insert(give, 0, 0, axis)
        h = h + np.clip(-move if compat else move, -0.3, 0.3) * 0.25
    return h


def seismic(h: np.ndarray, steps: int, wave_speed: float = 2.0, damping: float = 0.004, impulse: float = 1.0) -> np.ndarray:
    v = np.zeros_like(h)
    v[h.shape[0] // 2, h.shape[1] // 2] = impulse
    for _ in range(steps):
        v = (v + 0.25 * wave_speed**2 * _lap(h)) * (1 - damping)
        h = np.pad((h + 0.25 * v)[1:-1, 1:-1], 1)
        h = np.nan_to_num(h, nan=0.0, posinf=0.0, neginf=0.0)
    return h


def diffusion(h: np.ndarray, steps: int, nu: float = 0.08) -> np.ndarray:
    """The periodic heat kernel, exact, over a time of 0.1 a step."""
    ky, kx = (np.fft.fftfreq(n) * 2 * np.pi for n in h.shape)
    return np.fft.ifft2(np.exp(-nu * 0.1 * steps * (ky[:, None] ** 2 + kx[None] ** 2)) * np.fft.fft2(h)).real


def _spline(a: np.ndarray) -> np.ndarray:
    """Coefficients of the cubic B-spline through the rows of ``a``, mirrored at both ends."""
    n = len(a)
    if n == 1:
        return a
    m = np.diag(np.full(n, 4.0)) + np.diag(np.ones(n - 1), 1) + np.diag(np.ones(n - 1), -1)
    m[0, 1] = m[-1, -2] = 2.0
    return np.linalg.solve(m / 6, a)


def upsample(h: np.ndarray, rows: int, cols: int) -> np.ndarray:
    """Resampling to (rows, cols) by the interpolating cubic spline, corners kept."""

    def along(a: np.ndarray, n: int) -> np.ndarray:
        m = len(a)
        if m == n:
            return a
        c = _spline(a)
        at = np.linspace(0, m - 1, n)
        i = np.clip(at.astype(int), 0, max(m - 2, 0))
        t = (at - i)[:, None]
        # The four B-splines that reach a place between i and i + 1.
        weight = ((1 - t) ** 3 / 6, (3 * t**3 - 6 * t**2 + 4) / 6, (-3 * t**3 + 3 * t**2 + 3 * t + 1) / 6, t**3 / 6)
        mirrored = lambda k: np.where(k < 0, -k, np.where(k > m - 1, 2 * (m - 1) - k, k)) if m > 1 else np.zeros_like(k)
        return sum(w * c[mirrored(i + k)] for w, k in zip(weight, (-1, 0, 1, 2)))

    return along(along(h, rows).T, cols).T


def per_scene(field: DataFrame, f: Callable[..., np.ndarray], *more: str) -> DataFrame:
    """``f`` of every scene's array of h (and of the columns ``more``), scenes in parallel."""

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        # One place for each cell: sorting rows is cheaper than pivoting them.
        rows = rows.sort_values(["y", "x"])
        shape = rows["y"].nunique(), rows["x"].nunique()
        out = f(*[rows[c].to_numpy(float).reshape(shape) for c in ("h", *more)])
        y, x = np.mgrid[: out.shape[0], : out.shape[1]]
        return pd.DataFrame({"scene_id": rows["scene_id"].iloc[0], "y": y.ravel(), "x": x.ravel(), "h": out.ravel()})

    return field.select("scene_id", "y", "x", "h", *more).groupBy("scene_id").applyInPandas(run, f"scene_id {field.schema['scene_id'].dataType.simpleString()}, y int, x int, h double")


def solve(field: DataFrame, name: str, steps: int, **params: float) -> DataFrame:
    """Run a solver by name on every scene; a column ``hardness`` of ``field`` goes to the hydraulic one."""
    if name not in SOLVERS:
        raise ValueError(f"unknown solver {name!r}; one of {', '.join(SOLVERS)}")
    f = {"hydraulic": hydraulic, "thermal": thermal, "seismic": seismic, "diffusion": diffusion}[name]
    if name == "hydraulic" and "hardness" in field.columns:
        return per_scene(field, lambda h, hard: f(h, steps, hardness=hard, **params), "hardness")
    return per_scene(field, lambda h: f(h, steps, **params))
