"""A Fourier neural operator on fields: what one step of water does to a height field, learned from the solver.

Inputs are three channels: the field less its mean over its deviation, the
hardness, and the rain times ``RAIN``; the output is the change times
``TARGET``. Training is small (a few dozen 32 by 32 fields) and runs where it
is called; its samples are made, and scenes are rolled forward, in parallel.
"""

from __future__ import annotations

import io
import json
import time
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from terraloom.operators import field

TARGET = 100.0
RAIN = 20.0
_C = np.sqrt(2 / np.pi)


def _gelu(z: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The activation and its slope."""
    t = np.tanh(_C * (z + 0.044715 * z**3))
    return 0.5 * z * (1 + t), 0.5 * (1 + t) + 0.5 * z * (1 - t * t) * _C * (1 + 3 * 0.044715 * z * z)


def modes_of(size: int, modes: int) -> np.ndarray:
    """The lowest frequencies of both signs; no more than the field has."""
    m = min(modes, size // 2)
    return np.r_[0:m, size - m : size]


@dataclass
class Operator:
    """Channels in, width, layers and modes; weights by name."""

    weights: dict[str, np.ndarray]
    modes: int = 8
    layers: int = 4

    @classmethod
    def seeded(cls, modes: int = 8, width: int = 16, layers: int = 4, seed: int = 7, channels: int = 3, dtype=np.float32) -> "Operator":
        rng = np.random.default_rng(seed)
        kind = np.complex64 if dtype == np.float32 else np.complex128
        draw = lambda *shape: rng.standard_normal(shape)
        w = {"lift_w": (draw(width, channels) / np.sqrt(channels)).astype(dtype), "lift_b": np.zeros(width, dtype)}
        for k in range(layers):
            shape = (width, width, 2 * modes, 2 * modes)
            real = draw(*shape)
            w[f"spectral{k}"] = ((real + 1j * draw(*shape)) / np.sqrt(width)).astype(kind)
            w[f"point{k}_w"] = (draw(width, width) / np.sqrt(width)).astype(dtype)
            w[f"point{k}_b"] = np.zeros(width, dtype)
        return cls(w | {"out_w": (draw(1, width) / np.sqrt(width)).astype(dtype), "out_b": np.zeros(1, dtype)}, modes, layers)

    def size(self) -> int:
        return sum(x.size for x in self.weights.values())

    def _spectral(self, k: int, rows: int, cols: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """A layer's weights for the frequencies that a field of this size has."""
        y, x = modes_of(rows, self.modes), modes_of(cols, self.modes)
        own = self.weights[f"spectral{k}"]
        return y, x, own[:, :, np.r_[0 : len(y) // 2, own.shape[2] - len(y) // 2 : own.shape[2]]][:, :, :, np.r_[0 : len(x) // 2, own.shape[3] - len(x) // 2 : own.shape[3]]]

    def run(self, x: np.ndarray, keep: list | None = None) -> np.ndarray:
        """(batch, 1, rows, cols) of (batch, channels, rows, cols); ``keep`` gets what ``gradients`` needs."""
        w = self.weights
        a = np.einsum("oc,bcyx->boyx", w["lift_w"], x.astype(w["lift_w"].dtype)) + w["lift_b"][:, None, None]
        for k in range(self.layers):
            y, xs, own = self._spectral(k, *a.shape[2:])
            f = np.fft.fft2(a)[:, :, y[:, None], xs]
            full = np.zeros(a.shape, f.dtype)
            full[:, :, y[:, None], xs] = np.einsum("oiyx,biyx->boyx", own, f, optimize=True)
            z = np.fft.ifft2(full).real + np.einsum("oi,biyx->boyx", w[f"point{k}_w"], a) + w[f"point{k}_b"][:, None, None]
            out, slope = _gelu(z.astype(a.dtype))
            if keep is not None:
                keep.append((a, f, slope))
            a = out
        if keep is not None:
            keep.append((a,))
        return np.einsum("oi,biyx->boyx", w["out_w"], a) + w["out_b"][:, None, None]

    def loss_and_gradients(self, x: np.ndarray, want: np.ndarray) -> tuple[float, dict[str, np.ndarray]]:
        """Mean squared error and its slope by every weight (for complex ones, by real and imaginary part)."""
        keep: list = []
        off = self.run(x, keep) - want
        w, g = self.weights, {}
        d = 2 * off / off.size
        a = keep[-1][0]
        g["out_w"], g["out_b"] = np.einsum("boyx,biyx->oi", d, a), d.sum((0, 2, 3))
        d = np.einsum("oi,boyx->biyx", w["out_w"], d)
        n = a.shape[2] * a.shape[3]
        for k in range(self.layers - 1, -1, -1):
            a, f, slope = keep[k]
            d = d * slope
            y, xs, own = self._spectral(k, *a.shape[2:])
            back = np.fft.fft2(d)[:, :, y[:, None], xs] / n
            part = np.einsum("boyx,biyx->oiyx", back, np.conj(f), optimize=True)
            whole = np.zeros_like(w[f"spectral{k}"])
            i, j = np.r_[0 : len(y) // 2, whole.shape[2] - len(y) // 2 : whole.shape[2]], np.r_[0 : len(xs) // 2, whole.shape[3] - len(xs) // 2 : whole.shape[3]]
            whole[:, :, i[:, None], j] = part
            g[f"spectral{k}"], g[f"point{k}_w"], g[f"point{k}_b"] = whole, np.einsum("boyx,biyx->oi", d, a), d.sum((0, 2, 3))
            full = np.zeros(a.shape, complex)
            full[:, :, y[:, None], xs] = np.einsum("oiyx,boyx->biyx", np.conj(own), back, optimize=True)
            d = np.fft.ifft2(full).real * n + np.einsum("oi,boyx->biyx", w[f"point{k}_w"], d)
        g["lift_w"], g["lift_b"] = np.einsum("boyx,bcyx->oc", d, x), d.sum((0, 2, 3))
        return float((off**2).mean()), {k: v.astype(w[k].dtype) for k, v in g.items()}

    def step(self, h: np.ndarray, hardness: np.ndarray | None = None, rain: float = 0.02) -> np.ndarray:
        """A field one step on."""
        return h + self.run(inputs(h, hardness, rain)[None])[0, 0] / TARGET

    def rollout(self, h: np.ndarray, steps: int, hardness: np.ndarray | None = None, rain: float = 0.02) -> np.ndarray:
        h = h.astype(float)
        for _ in range(steps):
            h = self.step(h, hardness, rain)
        return h

    def to_bytes(self, info: dict | None = None) -> bytes:
        out = io.BytesIO()
        np.savez_compressed(out, **self.weights, about=np.array(json.dumps({"modes": self.modes, "layers": self.layers, "info": info or {}})))
        return out.getvalue()

    @classmethod
    def from_bytes(cls, raw: bytes) -> tuple["Operator", dict]:
        got = dict(np.load(io.BytesIO(raw), allow_pickle=False))
        about = json.loads(str(got.pop("about")))
        return cls(got, about["modes"], about["layers"]), about["info"]


def inputs(h: np.ndarray, hardness: np.ndarray | None, rain: float) -> np.ndarray:
    hard = np.ones_like(h) if hardness is None else np.clip(hardness, 0.05, 1.0)
    return np.stack([(h - h.mean()) / (h.std() + 1e-9), hard, np.full_like(h, rain * RAIN)])


def _blur(a: np.ndarray, sigma: float) -> np.ndarray:
    """A Gaussian blur with mirrored edges, cut at four deviations."""
    r = int(4 * sigma + 0.5)
    k = np.exp(-0.5 * (np.arange(-r, r + 1) / sigma) ** 2)
    k /= k.sum()
    for _ in range(2):
        n = len(a)
        at = np.abs((np.arange(-r, n + r) + n) % (2 * n) - n + 0.5).astype(int) if n else np.arange(0)
        padded = a[np.where(at > n - 1, 2 * n - 1 - at, at)]
        a = sum(w * padded[i : i + n] for i, w in enumerate(k)).T
    return a


def terrain(size: int, rng: np.random.Generator, octaves: int = 4) -> np.ndarray:
    """A smooth random field between 0 and 1: blurred noise, each octave finer and weaker."""
    out = np.zeros((size, size))
    for o in range(octaves):
        layer = _blur(rng.standard_normal((size, size)), max(size / (3 * 2**o), 0.8))
        out += 0.55**o * layer / max(layer.std(), 1e-9)
    out -= out.min()
    return out / max(out.max(), 1e-9)


def samples(spark: SparkSession, n: int = 48, size: int = 32, seed: int = 18) -> DataFrame:
    """(sample, x, y): inputs and targets of ``n`` random fields, flat, made in parallel; a sample depends on seed and number alone."""

    def run(batches):
        for batch in batches:
            xs, ys = [], []
            for k in batch.column(0).to_pylist():
                rng = np.random.default_rng([seed, k])
                h = terrain(size, rng)
                hard, rain = rng.uniform(0.3, 1.0, (size, size)), float(rng.uniform(0.01, 0.05))
                after = field.hydraulic(h, 1, rainfall=rain, hardness=hard)
                xs.append(inputs(h, hard, rain).ravel())
                ys.append(((after - h) * TARGET).ravel())
            kind = pa.list_(pa.float64())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(xs, kind), pa.array(ys, kind)], names=["sample", "x", "y"])

    return spark.range(n).select(F.col("id").alias("sample")).mapInArrow(run, "sample long, x array<double>, y array<double>")


def train(spark: SparkSession, steps: int = 300, n: int = 48, batch: int = 8, rate: float = 2e-3, size: int = 32, seed: int = 7, **shape: int) -> tuple[Operator, dict]:
    """An operator fitted to ``samples`` by Adam, and how it went. The driver holds the samples: ``n`` fields of ``size`` squared."""
    began = time.perf_counter()
    got = samples(spark, n, size, seed + 11).orderBy("sample").toArrow()
    xs = np.array(got.column("x").to_pylist(), np.float32).reshape(n, 3, size, size)
    ys = np.array(got.column("y").to_pylist(), np.float32).reshape(n, 1, size, size)
    net, rng = Operator.seeded(seed=seed, **shape), np.random.default_rng(seed + 23)
    mean, square, losses = {}, {}, []
    for t in range(1, steps + 1):
        some = rng.integers(0, n, min(batch, n))
        loss, grads = net.loss_and_gradients(xs[some], ys[some])
        losses.append(loss)
        for k, g in grads.items():
            mean[k] = 0.9 * mean.get(k, 0) + 0.1 * g
            # As the published rule has it, the plain square, also of complex slopes.
            square[k] = 0.999 * square.get(k, 0) + 0.001 * g * g
            net.weights[k] = (net.weights[k] - rate * (mean[k] / (1 - 0.9**t)) / (np.sqrt(square[k] / (1 - 0.999**t)) + 1e-8)).astype(net.weights[k].dtype)
    return net, {"steps": steps, "samples": n, "weights": net.size(), "loss_first": losses[0], "loss_last": losses[-1], "loss_least": min(losses), "seconds": time.perf_counter() - began}


def save(spark: SparkSession, net: Operator, path: str, info: dict | None = None) -> None:
    """The operator as one row of a table, so any file system serves."""
    spark.createDataFrame([(bytearray(net.to_bytes(info)),)], "operator binary").coalesce(1).write.mode("overwrite").parquet(path)


def load(spark: SparkSession, path: str) -> tuple[Operator, dict]:
    return Operator.from_bytes(bytes(spark.read.parquet(path).first()[0]))


def rollout(fields: DataFrame, net: Operator, steps: int = 1, rain: float = 0.02) -> DataFrame:
    """Every scene (scene_id, y, x, h and perhaps hardness) rolled forward."""
    more = ["hardness"] if "hardness" in fields.columns else []
    return field.per_scene(fields, lambda h, *hard: net.rollout(h, steps, *hard, rain=rain), *more)


def benchmark(net: Operator, h: np.ndarray, steps: int = 4, rain: float = 0.02, repeats: int = 3) -> dict:
    """Milliseconds of solver and operator for the same field, and how far they are apart."""

    def timed(f):
        began = time.perf_counter()
        for _ in range(repeats):
            out = f()
        return out, (time.perf_counter() - began) * 1000 / repeats

    want, solver_ms = timed(lambda: field.hydraulic(h, steps, rainfall=rain))
    got, operator_ms = timed(lambda: net.rollout(h, steps, rain=rain))
    return {"steps": steps, "solver_ms": solver_ms, "operator_ms": operator_ms, "speedup": solver_ms / max(operator_ms, 1e-6), "relative_error": float(np.linalg.norm(got - want) / max(np.linalg.norm(want), 1e-12))}
