"""Toxicity: a linear classifier on character n-grams scaled by naive Bayes log-count ratios.

Lower-cased whole texts give distinct character n-grams (``SIZES``), hashed
to ``BUCKETS``. On labelled rows outside the held-out fold every bucket gets
its naive Bayes log-count ratio; the ``FEATURES`` buckets whose ratio is
surest carry it as their value, and a logistic regression is fitted on them.
Scores read the text alone.

The model is fitted on at most ``SAMPLE`` labelled rows, chosen by hash of
doc_id; this bound, and that of ``features`` n-grams, are documented
parameters. Counting runs on the executors, and so does the fit, in one task
that holds the sample's feature lists (``sample * features`` numbers of 16
bits at most, ``features`` below 65,536). The driver sees ``features`` ratios
and weights.

A worker holds ``ARROW_ROWS`` texts and the n-grams of one at a time, 16 bytes
or so for each of its characters.

Defined results: null and empty texts score as a text without features (the
intercept); a null doc_id is never held out and never learned from; repeated rows score alike; a doc_id labelled more than once
counts as toxic if any label says so, null labels are ignored; without
labels of both kinds every score is the share of toxic labels, or 0; an
empty table gives an empty result; extra columns pass through ``score``
unless they carry an output name.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F, types as T

from terraloom.llm.common import store, tidy, tune

SIZES = (3, 4, 5, 6)
BUCKETS = 1 << 20
FEATURES = 2_000
SAMPLE = 12_000
FOLDS = 5
SMOOTH = 1.0
RIDGE = 0.1


def buckets(text: str | None) -> np.ndarray:
    """The hashed n-grams of a text, with repeats."""
    points = np.frombuffer(f" {(text or '').lower()} ".encode("utf-32-le", "surrogatepass"), np.uint32)
    out, h = [], points * np.uint32(0x9E3779B1)
    for n in range(2, max(SIZES) + 1):
        if len(points) < n:
            break
        h = (h[:-1] ^ (h[:-1] >> np.uint32(15))) * np.uint32(0x85EBCA6B) + points[n - 1 :] * np.uint32(0xC2B2AE35)
        if n in SIZES:
            m = h ^ (h >> np.uint32(13))
            out.append((m * np.uint32(0x27D4EB2F)) >> np.uint32(12))
    return np.concatenate(out) if out else np.empty(0, np.uint32)


@dataclass
class Model:
    bucket: np.ndarray  #: sorted
    weight: np.ndarray
    bias: float

    def __post_init__(self):
        self.wanted = np.zeros(BUCKETS, bool)
        self.wanted[self.bucket] = True

    def features(self, text: str | None) -> np.ndarray:
        """Positions, in ``bucket``, of the distinct features of a text."""
        h = buckets(text)
        return np.searchsorted(self.bucket, np.unique(h[self.wanted[h]]))

    def score(self, text: str | None) -> float:
        z = self.bias + float(self.weight[self.features(text)].sum())
        return float(1 / (1 + np.exp(-np.clip(z, -700, 700))))


def logistic(rows: list[np.ndarray], y: np.ndarray, scale: np.ndarray, ridge: float = RIDGE, steps: int = 25) -> tuple[np.ndarray, float]:
    """Weights (scale included) and intercept, by Newton's method with conjugate gradients."""
    n = np.fromiter((len(r) for r in rows), np.int64, len(rows))
    row, col = np.repeat(np.arange(len(rows)), n), np.concatenate(rows) if len(rows) else np.empty(0, np.int64)
    value = scale[col]
    k = len(scale)

    def forward(w):
        return np.bincount(row, value * w[col], len(rows)) + w[k]

    def back(g):
        return np.append(np.bincount(col, value * g[row], k), g.sum())

    pull = np.append(np.full(k, ridge), 1e-6)
    w = np.zeros(k + 1)
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(forward(w), -30, 30)))
        grad = back(p - y) + pull * w
        curve = np.maximum(p * (1 - p), 1e-9)
        step, r = np.zeros(k + 1), -grad
        d, rr = r.copy(), float(r @ r)
        for _ in range(40):
            if rr < 1e-8:
                break
            hd = back(curve * forward(d)) + pull * d
            a = rr / float(d @ hd)
            step, r = step + a * d, r - a * hd
            rr, old = float(r @ r), rr
            d = r + rr / old * d
        w = w + step
        if float(np.abs(step).max()) < 1e-4:
            break
    return w[:k] * scale, float(w[k])


def train(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, features: int = FEATURES, held_out: int = 0) -> Model:
    """Fit on ``docs`` (doc_id, text) by ``labels`` (doc_id, toxic) outside fold ``held_out``."""
    fold = F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(FOLDS))
    known = labels.where(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic"))
    chosen = store(known.where(fold != held_out).orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample), "toxic-labels")
    # At most ``sample`` rows of a few bytes: small whatever the corpus.
    rows = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id")
    # Repeated doc_ids may bring more rows than were chosen; equal rows are taken in one order, so reruns agree.
    rows = store(rows.orderBy(F.xxhash64("doc_id"), "doc_id", F.xxhash64("text")).limit(sample).select("text", "toxic"), "toxic-sample")
    total = {r["toxic"]: r["n"] for r in rows.groupBy("toxic").agg(F.count(F.lit(1)).alias("n")).collect()}
    pos, neg = total.get(1, 0), sum(n for k, n in total.items() if k != 1)
    if not pos or not neg:
        share = pos / (pos + neg) if pos + neg else 0.0
        bias = -700.0 if not share else float(np.log(share / max(1 - share, 1e-12)))
        return Model(np.empty(0, np.int64), np.empty(0), bias)

    def count(batches):
        seen = np.zeros((2, BUCKETS), np.int32)
        for batch in batches:
            for text, toxic in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                seen[int(toxic == 1), np.unique(buckets(text))] += 1
        at = np.flatnonzero(seen.any(0))
        yield pa.RecordBatch.from_pydict({"bucket": pa.array(at), "neg": pa.array(seen[0, at].astype(np.int64)), "pos": pa.array(seen[1, at].astype(np.int64))})

    counted = rows.mapInArrow(count, "bucket long, neg long, pos long").groupBy("bucket").agg(F.sum("neg").alias("neg"), F.sum("pos").alias("pos"))
    p, n = F.col("pos") + SMOOTH, F.col("neg") + SMOOTH
    ratio = F.log(p / (pos + 2 * SMOOTH)) - F.log(n / (neg + 2 * SMOOTH))
    surest = counted.select("bucket", ratio.alias("ratio"), F.abs(ratio / F.sqrt(1 / p + 1 / n)).alias("sure")).orderBy(F.desc("sure"), "bucket").limit(features)
    top = sorted((r["bucket"], r["ratio"]) for r in surest.collect())
    draft = Model(np.array([b for b, _ in top], np.int64), np.zeros(len(top)), 0.0)

    def lists(batches):
        for batch in batches:
            found = [draft.features(t).astype(np.uint16).tobytes() for t in batch.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(1), pa.array(found, pa.binary())], names=["toxic", "found"])

    def fitted(batches):
        toxic, found = [], []
        for batch in batches:
            toxic += batch.column(0).to_pylist()
            found += [np.frombuffer(x, np.uint16).astype(np.int64) for x in batch.column(1).to_pylist()]
        weight, bias = logistic(found, (np.array(toxic) == 1).astype(float), np.array([r for _, r in top]))
        yield pa.RecordBatch.from_pydict({"at": pa.array(range(len(weight) + 1), pa.int64()), "weight": pa.array(np.append(weight, bias))})

    # One task for the bounded sample; in one order, so that sums agree from run to run.
    got = rows.mapInArrow(lists, "toxic int, found binary").repartition(1).sortWithinPartitions("toxic", "found").mapInArrow(fitted, "at long, weight double").toArrow()
    weight = got.sort_by("at").column("weight").to_numpy()
    return Model(draft.bucket, weight[:-1], float(weight[-1]))


def score(docs: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """``docs`` with score (0 to 1) and predicted (1 if score >= 0.5)."""
    tune(docs.sparkSession)
    kept = [c for c in docs.columns if c not in ("score", "predicted")]
    where = kept.index(text)

    def run(batches):
        for batch in batches:
            s = np.array([model.score(t) for t in batch.column(where).to_pylist()], float)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(s), pa.array((s >= 0.5).astype(np.int32))], names=kept + ["score", "predicted"])
        tidy()

    fields = [T.StructField(f.name, f.dataType) for f in docs.select(*kept).schema.fields] + [T.StructField("score", T.DoubleType()), T.StructField("predicted", T.IntegerType())]
    return docs.select(*kept).mapInArrow(run, T.StructType(fields))


def held_out(doc_id: Column) -> Column:
    """Whether a document is in the fold that training leaves out."""
    return F.coalesce(F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(FOLDS)) == 0, F.lit(False))
