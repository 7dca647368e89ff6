"""Best-fit packing after Martello-Toth dominance reduction.

Documents become pieces of at most ``capacity`` ids (only longer ones are
cut, the first piece takes what is over). Packing depends on lengths alone,
so it is solved on the table of counts by length, at most ``capacity`` rows
whatever the input:

* reduction: for the largest piece, sets of one, two or three pieces that
  dominate every other way to fill its sequence are fixed for good, as often
  as the counts allow, and leave the instance;
* best fit: what remains goes, longest first, into the fullest sequence that
  still takes it.

The plan says which ranks within a length go to which sequences. Ranks are
dealt out in Spark per (length, slice of documents); no group is brought
into one task, and every piece finds its place in the broadcast plan, whose
size is bounded by the capacity.

Defined results: null text counts as empty (the end id alone); repeated rows
are packed each for itself; an empty table gives an empty result; extra
columns are ignored; ties between equal lengths follow doc_id and piece.
"""

from __future__ import annotations

import zlib
from collections import defaultdict

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from terraloom.llm.common import store, tune
from terraloom.llm.tokens import Encoder, gathered

CAPACITY = 1024
SLICE = 100_000  #: pieces that one (length, slice) holds, about
ROWS = 500  #: texts tokenized at once: memory of a worker follows them


def cuts(n: int, capacity: int = CAPACITY) -> list[tuple[int, int]]:
    """(start, length) of the pieces of a document of ``n`` ids."""
    if n <= capacity:
        return [(0, n)]
    first = n % capacity or capacity
    return [(0, first)] + [(s, capacity) for s in range(first, n, capacity)]


def pieces(docs: DataFrame, vocabulary: str, end: int = 2, capacity: int = CAPACITY, with_ids: bool = True) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32 (and ids, 32-bit little-endian) of ``docs`` (doc_id, text)."""
    tune(docs.sparkSession)
    last = np.array([end], "<u4").tobytes()

    def run(batches):
        encoder = Encoder.of(vocabulary)
        for batch in (part.slice(k, ROWS) for part in gathered(batches, 1) for k in range(0, part.num_rows, ROWS)):
            rows = []
            for doc, raw in zip(batch.column(0).to_pylist(), encoder.ids(batch.column(1))):
                raw += last
                for k, (start, n) in enumerate(cuts(len(raw) // 4, capacity)):
                    ids = raw[4 * start : 4 * (start + n)]
                    rows.append((doc, k, start, n, zlib.crc32(ids), ids)[: 6 if with_ids else 5])
            columns = list(zip(*rows)) if rows else [[]] * (6 if with_ids else 5)
            kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.binary()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds)], names=["doc_id", "piece", "start", "length", "ids_crc32", "ids"][: len(columns)])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, piece int, start long, length long, ids_crc32 long" + (", ids binary" if with_ids else ""))


def reduce(counts: np.ndarray, capacity: int) -> list[tuple[tuple[int, ...], int]]:
    """Fix dominating sets; ``counts`` (by length) loses them. (lengths of a set, how often)."""
    fixed = []
    a = capacity
    while a > 0:
        if not counts[a]:
            a -= 1
            continue
        room = capacity - a
        counts[a] -= 1  # the piece itself can't be its own partner
        have = np.flatnonzero(counts)
        fits = have[have <= room]
        chosen: tuple[int, ...] | None = None
        if not len(fits):
            chosen = ()
        else:
            b = int(fits[-1])
            small = np.repeat(fits[:3], np.minimum(counts[fits[:3]], 3))[:3]
            if b == room or small[:2].sum() > room or len(small) < 2:
                chosen = (b,)
            elif small.sum() > room or len(small) < 3:  # at most two partners
                counts[b] -= 1
                left = np.flatnonzero(counts)
                c = left[left <= room - b]
                counts[b] += 1
                half = int(fits[fits <= room // 2][-1])
                if not len(c):
                    if _best_pair(fits, counts, room) <= b:
                        chosen = (b,)
                elif int(c[-1]) >= half:
                    chosen = (b, int(c[-1]))
        counts[a] += 1
        if chosen is None:
            a -= 1
            continue
        members = (a, *chosen)
        times = min(int(counts[m]) // members.count(m) for m in set(members))
        for m in members:
            counts[m] -= times
        fixed.append((members, times))
    return fixed


def _best_pair(fits: np.ndarray, counts: np.ndarray, room: int) -> int:
    """The largest sum, within ``room``, of two of the lengths."""
    best, i, j = 0, 0, len(fits) - 1
    while i <= j:
        total = int(fits[i] + fits[j])
        if total > room or (i == j and counts[fits[i]] < 2):
            j -= 1
            continue
        best, i = max(best, total), i + 1
    return best


def plan(counts: np.ndarray, capacity: int) -> tuple[np.ndarray, int]:
    """Segments (length, first rank, how many, first sequence, offset), and the number of sequences."""
    counts = counts.astype(np.int64).copy()
    used = np.zeros(capacity + 1, np.int64)
    segments: list[tuple[int, int, int, int, int]] = []
    bins = 0
    open_: dict[int, list[tuple[int, int]]] = defaultdict(list)  # room left: (first sequence, how many)

    def put(length: int, n: int, first: int, offset: int) -> None:
        segments.append((length, int(used[length]), n, first, offset))
        used[length] += n

    for members, n in reduce(counts, capacity):
        at = 0
        for m in members:
            put(m, n, bins, at)
            at += m
        bins += n
    for s in range(capacity, 0, -1):
        left = int(counts[s])
        room = s
        while left:
            while room <= capacity and not open_.get(room):
                room += 1
            if room > capacity:
                open_[capacity].append((bins, max(1, -(-left // (capacity // s)))))
                bins += open_[capacity][-1][1]
                room = capacity
            first, n = open_[room].pop()
            each = room // s
            full = min(n, left // each)
            for j in range(each if full else 0):
                put(s, full, first, capacity - room + j * s)
            left -= full * each
            if full:
                open_[room - each * s].append((first, full))
            if full < n:
                some = min(left, each)
                for j in range(some):
                    put(s, 1, first + full, capacity - room + j * s)
                left -= some
                if some:
                    open_[room - some * s].append((first + full, 1))
                if n - full - bool(some):
                    open_[room].append((first + full + bool(some), n - full - bool(some)))
            room = s
    return np.array(segments, np.int64).reshape(-1, 5), bins


def place(cut: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """``cut`` (pieces, stored) with sequence_id and offset; other columns than those of a piece are left out."""
    spark = cut.sparkSession
    counts = np.zeros(capacity + 1, np.int64)
    for length, n in cut.groupBy("length").agg(F.count(F.lit(1))).collect():  # at most ``capacity`` rows
        counts[length] = n
    segments, _ = plan(counts, capacity)
    order = np.lexsort((segments[:, 1], segments[:, 0]))
    segments = segments[order]
    key = segments[:, 0] << 48 | segments[:, 1]
    shared = spark.sparkContext.broadcast((key, segments))

    slices = max(1, -(-int(counts.sum()) // SLICE))
    names = ["doc_id", "piece", "start", "length", "ids_crc32"]
    dealt = cut.select(*names).withColumn("_slice", F.pmod(F.xxhash64("doc_id"), F.lit(slices)))
    per = dealt.groupBy("length", "_slice").agg(F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy("length").orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    per = per.select("length", "_slice", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_base"))
    nth = F.row_number().over(Window.partitionBy("length", "_slice").orderBy("doc_id", "piece", "ids_crc32"))
    ranked = dealt.withColumn("_nth", nth).join(per, ["length", "_slice"]).select(*names, (F.col("_base") + F.col("_nth") - 1).alias("_rank"))

    def run(batches):
        key, segments = shared.value
        for batch in batches:
            length, rank = batch.column(3).to_numpy(), batch.column(5).to_numpy()
            at = np.searchsorted(key, length << 48 | rank, "right") - 1
            yield pa.RecordBatch.from_arrays([*batch.columns[:5], pa.array(segments[at, 3] + rank - segments[at, 1]), pa.array(segments[at, 4])], names=names + ["sequence_id", "offset"])

    return ranked.mapInArrow(run, "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")


def pack(docs: DataFrame, vocabulary: str, end: int = 2, capacity: int = CAPACITY) -> DataFrame:
    """A row per piece of ``docs`` (doc_id, text): doc_id, piece, start, length, ids_crc32, sequence_id, offset."""
    return place(store(pieces(docs, vocabulary, end, capacity, with_ids=False), "pieces"), capacity)


def sequences(docs: DataFrame, placed: DataFrame, vocabulary: str, end: int = 2, capacity: int = CAPACITY) -> DataFrame:
    """sequence_id and ids: the packed sequences themselves, each of at most ``capacity`` ids.

    Documents need unique doc_ids here; ``placed`` is what ``pack`` gave.
    """
    cut = pieces(docs, vocabulary, end, capacity).select("doc_id", "piece", "ids")
    rows = placed.select("doc_id", "piece", "sequence_id", "offset").join(cut, ["doc_id", "piece"])
    parts = F.array_sort(F.collect_list(F.struct("offset", "ids")))
    joined = F.aggregate(parts, F.lit(b"").cast("binary"), lambda acc, x: F.concat(acc, x["ids"]))
    return rows.groupBy("sequence_id").agg(joined.alias("ids"))
