"""Approximate nearest neighbours by shifted space-filling curves.

Largest inner products become smallest distances by one added coordinate
that brings every vector to the norm of the longest (queries get none).
``CURVES`` times the vectors are projected to ``DIMS`` random orthonormal
directions, shifted at random and put in the order of a Hilbert curve, by a
range partitioning on (curve, key). Each partition runs through its order in
blocks of a third of a window; the queries of a block meet that block and its
two neighbours. The best of every window, by products of components rounded to
8 bits, are merged over the curves and scored in double precision from the
original vectors.

Many curves with short windows find more for the same work than few with long
ones. A window has ``SPAN * n ** GROWTH`` rows: as the table grows, a query
meets more rows, but a falling share of them. Nothing but the random directions
and the table's size is known beforehand: no bounds, no rows on the driver.

Equal vectors collapse to one point that carries its ``k + 1`` smallest ids;
no answer needs more of them, so a vector that fills a third of the table is
searched once.

Defined results: vectors that are null, zero, or hold null or non-finite
components, or whose length isn't that of most, take no part; rows with a
null id neither; rows with equal ids count once (the smallest vector stays);
ties go to the smaller vec_id; fewer than k candidates are all returned; an
empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from terraloom.llm.common import store

CURVES = 64
DIMS = 16
BITS = 3
SPAN, GROWTH = 0.1, 0.77
HELD = 1 << 16  #: rows of a partition in memory at once
SPARE = 12  #: candidates kept beyond k, as rounded products may swap ranks


def hilbert_key(cells: np.ndarray, bits: int) -> np.ndarray:
    """The place on a Hilbert curve of integer points (n, dims), each coordinate of ``bits`` bits."""
    x = [cells[:, i].astype(np.int64) for i in range(cells.shape[1])]
    n = len(x)
    for q in (1 << b for b in range(bits - 1, 0, -1)):  # undo the turns of each level, coarse to fine
        low = q - 1
        for i in range(n):
            turned = (x[i] & q) != 0
            swap = (x[0] ^ x[i]) & low
            first = np.where(turned, x[0] ^ low, x[0] ^ swap)
            if i:
                x[i] = np.where(turned, x[i], x[i] ^ swap)
            x[0] = first
    for i in range(1, n):
        x[i] = x[i] ^ x[i - 1]
    flip = np.zeros_like(x[0])
    for q in (1 << b for b in range(bits - 1, 0, -1)):
        flip = np.where((x[n - 1] & q) != 0, flip ^ (q - 1), flip)
    key = np.zeros_like(x[0])
    for b in range(bits - 1, -1, -1):
        for i in range(n):
            key = key << 1 | ((x[i] ^ flip) >> b & 1)
    return key


class Curves:
    """The projections, shifts and grids of all curves, from a seed."""

    def __init__(self, width: int, longest: float, curves: int = CURVES, dims: int = DIMS, bits: int = BITS, seed: int = 11):
        rng = np.random.default_rng(seed)
        dims = min(dims, width + 1)
        self.longest, self.bits = longest, bits
        self.frames = [np.linalg.qr(rng.normal(size=(width + 1, dims)))[0] for _ in range(curves)]
        self.shifts = [rng.uniform(-0.5, 0.5, dims) for _ in range(curves)]

    def keys(self, vectors: np.ndarray, query: bool) -> list[np.ndarray]:
        norm = np.linalg.norm(vectors, axis=1)
        unit = vectors / (norm[:, None] if query else self.longest)
        rest = np.zeros(len(unit)) if query else np.sqrt(np.maximum(0, 1 - (norm / self.longest) ** 2))
        full = np.column_stack([unit, rest])
        out = []
        cells = 1 << self.bits
        for frame, shift in zip(self.frames, self.shifts):
            # Components of spread vectors have a deviation of 1 / sqrt(width); cells cover 2.5 of them on either side.
            grid = ((full @ frame) * np.sqrt(full.shape[1]) / 5 + 0.5) * cells + shift
            out.append(hilbert_key(np.clip(np.floor(grid).astype(np.int64), 0, cells - 1), self.bits))
        return out


def _matrix(column: pa.ChunkedArray | pa.Array, width: int) -> np.ndarray:
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return np.asarray(column.flatten()).reshape(-1, width).astype(np.float64)


def points(vectors: DataFrame, k: int, every: int) -> DataFrame:
    """Distinct usable vectors: point (their smallest id), ids (the k + 1 smallest), asks (a query is among them)."""
    v = F.col("embedding")
    usable = F.col("vec_id").isNotNull() & v.isNotNull() & (F.size(v) > 0)
    usable = usable & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists(v, lambda x: x != 0)
    rows = vectors.select("vec_id", F.col("embedding").cast("array<double>").alias("embedding")).where(usable)
    rows = rows.groupBy("vec_id").agg(F.min("embedding").alias("embedding"))
    rows = rows.withColumn("embedding", F.transform("embedding", lambda x: x + F.lit(0.0)))  # -0.0 is 0.0
    rows = rows.select("vec_id", "embedding", F.xxhash64("embedding").alias("p1"), F.xxhash64(F.lit(1), "embedding").alias("p2"))
    nth = F.row_number().over(Window.partitionBy("p1", "p2").orderBy("vec_id"))
    few = rows.withColumn("_nth", nth).where(F.col("_nth") <= k + 1)
    few = few.groupBy("p1", "p2").agg(F.min("vec_id").alias("point"), F.array_sort(F.collect_list("vec_id")).alias("ids"), F.first("embedding").alias("embedding"))
    asks = rows.where(F.col("vec_id") % every == 0).select("vec_id", "p1", "p2")
    asked = asks.select(F.col("p1").alias("_1"), F.col("p2").alias("_2")).distinct()
    out = few.join(asked, (few["p1"] == asked["_1"]) & (few["p2"] == asked["_2"]), "left").select("p1", "p2", "point", "ids", "embedding", F.col("_1").isNotNull().alias("asks"))
    return out, asks


def window_rows(n: int, span: float = SPAN, growth: float = GROWTH) -> int:
    """Rows of a window in a table of ``n``; a multiple of three."""
    return 3 * max(1, round(span * n**growth / 3))


def search(vectors: DataFrame, k: int = 20, every: int = 20, curves: int = CURVES, span: float = SPAN) -> DataFrame:
    """query_id, rank, vec_id, score: the ``k`` nearest found of every row whose vec_id ``every`` divides."""
    spark = vectors.sparkSession
    schema = "query_id long, rank int, vec_id long, score double"
    found, asks = points(vectors, k, every)
    found = store(found, "ann-points")
    widths = found.groupBy(F.size("embedding").alias("w")).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "w").first()
    if widths is None:
        return spark.createDataFrame([], schema)
    width, n = widths["w"], widths["n"]
    found = found.where(F.size("embedding") == width)
    longest = found.agg(F.max(F.sqrt(F.aggregate("embedding", F.lit(0.0), lambda a, x: a + x * x)))).first()[0]
    order, keep = Curves(width, longest, curves), k + SPARE
    block = max(window_rows(n, span) // 3, -(-(k + 1) // 3))  # a window shows k candidates at least, if there are as many

    def keyed(batches):
        for batch in batches:
            m = _matrix(batch.column(1), width)
            if not len(m):
                continue
            asked = batch.column(2).to_numpy(zero_copy_only=False)
            most = np.abs(m).max(1, keepdims=True)
            codes = pa.FixedSizeBinaryArray.from_buffers(pa.binary(width + 8), len(m), [None, pa.py_buffer(np.hstack([np.rint(m / most * 127).astype(np.int8).view(np.uint8), most.view(np.uint8).reshape(len(m), 8)]).tobytes())]).cast(pa.binary())
            for c, (key, as_query) in enumerate(zip(order.keys(m, False), order.keys(m[asked], True) if asked.any() else [None] * curves)):
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(m), c, np.int32)), pa.array(key), batch.column(0), pa.array(np.zeros(len(m), bool)), codes], names=["curve", "key", "point", "asks", "code"])
                if as_query is not None:
                    who = pa.array(np.flatnonzero(asked))
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(who), c, np.int32)), pa.array(as_query), batch.column(0).take(who), pa.array(np.ones(len(who), bool)), codes.take(who)], names=["curve", "key", "point", "asks", "code"])

    def windows(batches):
        kinds = ["query", "point", "near"]

        def unpacked(t: pa.Table) -> list[np.ndarray]:
            raw = np.frombuffer(b"".join(t.column("code").to_pylist()), np.uint8).reshape(len(t), width + 8)
            m = raw[:, :width].view(np.int8).astype(np.float32) * (np.ascontiguousarray(raw[:, width:]).view(np.float64) / 127).astype(np.float32)
            return [m, t.column("point").to_numpy(), t.column("asks").to_numpy(), t.column("curve").to_numpy()]

        held: list[np.ndarray] | None = None
        done = 0

        def run(stop: int):
            """The queries of held rows up to ``stop``."""
            m, ids, who, _ = held
            # Queries stand among the rows only to find their place; they are no candidates.
            rows = np.flatnonzero(~who)
            place = np.searchsorted(rows, np.flatnonzero(who[done:stop]) + done)
            queries = np.flatnonzero(who[done:stop]) + done
            data, names = m[rows], ids[rows]
            if not len(queries) or not len(rows):
                return None
            out = []
            cut = np.minimum(place, len(rows) - 1) // block
            for b in np.unique(cut):
                mine = queries[cut == b]
                lo = int(max(0, min((b - 1) * block, len(rows) - 3 * block)))
                near = slice(lo, lo + 3 * block)
                s = m[mine] @ data[near].T
                few = min(keep, s.shape[1])
                top = np.argpartition(-s, few - 1, axis=1)[:, :few]
                out.append((np.repeat(ids[mine], few), names[near][top.ravel()], np.take_along_axis(s, top, 1).ravel()))
            return pa.RecordBatch.from_arrays([pa.array(np.concatenate([x[i] for x in out])) for i in range(3)], names=kinds)

        for batch in batches:
            fresh = unpacked(pa.Table.from_batches([batch]))
            for c in np.unique(fresh[3]):
                mine = [x[fresh[3] == c] for x in fresh]
                if held is not None and held[3][0] != c:
                    if (got := run(len(held[3]))) is not None:
                        yield got
                    held, done = None, 0
                held = mine if held is None else [np.concatenate([x, y]) for x, y in zip(held, mine)]
                if len(held[3]) >= HELD + 8 * block:
                    stop = len(held[3]) - 4 * block
                    if (got := run(stop)) is not None:
                        yield got
                    drop = max(0, stop - 4 * block)
                    held, done = [x[drop:] for x in held], stop - drop
        if held is not None and (got := run(len(held[3]))) is not None:
            yield got

    rows = found.select("point", "embedding", "asks").mapInArrow(keyed, "curve int, key long, point long, asks boolean, code binary")
    met = rows.repartitionByRange("curve", "key").sortWithinPartitions("curve", "key", "point").mapInArrow(windows, "query long, point long, near float")
    met = met.groupBy("query", "point").agg(F.max("near").alias("near"))
    nth = F.row_number().over(Window.partitionBy("query").orderBy(F.desc("near"), "point"))
    met = met.withColumn("_nth", nth).where(F.col("_nth") <= keep).select("query", "point")
    # Scored from the original vectors, so that a pair has one score whatever window it met in.
    whole = found.select("point", "ids", "embedding")
    met = met.join(whole, "point").join(whole.select(F.col("point").alias("query"), F.col("embedding").alias("_q")), "query")
    rows = met.select("query", F.explode("ids").alias("vec_id"), F.aggregate(F.zip_with("embedding", "_q", lambda x, y: x * y), F.lit(0.0), lambda a, x: a + x).alias("score"))
    mine = asks.join(found.select("p1", "p2", F.col("point").alias("query")), ["p1", "p2"]).select("query", F.col("vec_id").alias("query_id"))
    rows = rows.join(mine, "query").where(F.col("vec_id") != F.col("query_id"))
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return rows.select("query_id", rank.alias("rank"), "vec_id", "score").where(F.col("rank") <= k)
