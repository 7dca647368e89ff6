"""Token ids in grammar-compressed shard files (Re-Pair), read back at random.

``write_shards`` encodes documents in ascending doc_id order, appends the end
id to each and packs runs of documents into shards. A shard's ids are
compressed by Re-Pair: in each round the most frequent pairs of symbols are
replaced by new nonterminals, until no pair is left that occurs ``LEAST``
times. The file holds the rules, every nonterminal's
expansion length, the symbols, and where each document's symbols and ids
begin, so a document or a range of ids is decoded without the rest. No rule
crosses a document's end.

Shards are written through Spark as rows of (part, shard, ..., blob), so any
file system serves and a lost executor only repeats its own part.

Defined results: null text counts as empty and gives the end id alone; null
doc_ids come first; repeated doc_ids keep rows apart, ordered by text; an
empty table gives no shards; extra columns are ignored; a document longer
than a shard stays whole in a shard of its own.
"""

from __future__ import annotations

import struct
import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window, functions as F

from terraloom.llm.common import store, tune
from terraloom.llm.tokens import Encoder, gathered

SHARD = 1 << 20  #: ids after which a shard is closed
RULES = 1 << 15  #: at most so many new rules a round; the rest waits for the next
LEAST = 8  #: a pair must occur so often to be replaced
BATCH, KEPT = 8 << 20, 1_000_000  #: bytes of text tokenized at once, pieces kept; some 250 MB of a worker
MAGIC = b"TLRP1\0\0\0"


def _frequent(a: np.ndarray, b: np.ndarray, last: np.ndarray, rules: int, least: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The most frequent pairs, most frequent first, as (n, 2); the positions that hold one, and which.

    Pairs are counted by hashed slot; a frequent slot stands for one of its
    pairs, whose own count then decides. A pair hidden by another in its slot
    waits for a later round.
    """
    slots = 1 << 18
    slot = ((a * np.uint32(0x9E3779B1) + b * np.uint32(0x85EBCA77)) >> np.uint32(14)).astype(np.intp)
    slot[last] = slots  # nothing is joined to what ends a document
    counts = np.bincount(slot, minlength=slots + 1)
    counts[slots] = 0
    often = counts >= least
    if int(often.sum()) > rules:
        often = counts >= max(least, int(np.partition(counts, slots + 1 - rules)[slots + 1 - rules]))
    at = np.flatnonzero(often[slot])
    mine, key = slot[at], a[at].astype(np.uint64) << np.uint64(32) | b[at]
    stands = np.zeros(slots + 1, np.uint64)
    stands[mine[::-1]] = key[::-1]
    same = stands[mine] == key
    at, mine = at[same], mine[same]
    n = np.bincount(mine, minlength=slots + 1)
    order = np.flatnonzero(n >= least)
    order = order[np.argsort(-n[order], kind="stable")][:rules]
    place = np.full(slots + 1, -1, np.int32)
    place[order] = np.arange(len(order), dtype=np.int32)
    rank = place[mine]
    pairs = np.stack([stands[order] >> np.uint64(32), stands[order] & np.uint64(0xFFFFFFFF)], 1).astype(np.uint32)
    return pairs, at[rank >= 0], rank[rank >= 0]


def compress(ids: np.ndarray, end: int, rules: int = RULES, least: int = LEAST) -> tuple[np.ndarray, list[np.ndarray], int]:
    """(symbols, rules of each round as (n, 2) arrays, number of terminals), when no pair is left that occurs ``least`` times."""
    terminals = int(ids.max(initial=end)) + 1
    seq = ids.astype(np.uint32)
    ends = np.zeros(terminals, bool)
    ends[end] = True
    made: list[np.ndarray] = []
    nxt = terminals
    while len(seq) > 1:
        pairs, at, rank = _frequent(seq[:-1], seq[1:], np.flatnonzero(ends[seq[:-1]]), rules, least)
        if not len(pairs):
            break
        # Matches that overlap: of each run of adjacent matches every second is taken, from the left.
        start = np.diff(at, prepend=-2) > 1
        first = np.maximum.accumulate(np.where(start, at, 0))
        take = (at - first) % 2 == 0
        at, rank = at[take], rank[take]
        seq[at] = rank.astype(np.uint32) + np.uint32(nxt)
        keep = np.ones(len(seq), bool)
        keep[at + 1] = False
        seq = seq[keep]
        made.append(pairs)
        ends = np.concatenate([ends, ends[pairs[:, 1]]])
        nxt += len(pairs)
    return seq, made, terminals


def lengths_of(made: list[np.ndarray], terminals: int) -> np.ndarray:
    """The expansion length of every symbol."""
    n = np.ones(terminals, np.uint32)
    for pairs in made:
        n = np.concatenate([n, n[pairs[:, 0]] + n[pairs[:, 1]]])
    return n


def expand(seq: np.ndarray, made: list[np.ndarray], terminals: int) -> np.ndarray:
    low = terminals + sum(map(len, made))
    for pairs in reversed(made):
        low -= len(pairs)
        is_rule = seq >= low
        at = np.cumsum(is_rule) - is_rule + np.arange(len(seq))
        out = np.empty(len(seq) + int(is_rule.sum()), np.uint32)
        out[at[~is_rule]] = seq[~is_rule]
        out[at[is_rule]] = pairs[seq[is_rule] - low, 0]
        out[at[is_rule] + 1] = pairs[seq[is_rule] - low, 1]
        seq = out
    return seq


def to_blob(doc_ids: list[int | None], parts: list[np.ndarray], end: int) -> bytes:
    """A shard file."""
    ids = np.concatenate(parts)
    seq, made, terminals = compress(ids, end)
    size = lengths_of(made, terminals)
    token_at = np.concatenate([[0], np.cumsum([len(p) for p in parts])]).astype(np.uint64)
    upto = np.concatenate([[0], np.cumsum(size[seq], dtype=np.uint64)])
    symbol_at = np.searchsorted(upto, token_at).astype(np.uint64)
    wide = np.uint16 if terminals + sum(map(len, made)) <= 1 << 16 else np.uint32
    known = np.array([d is not None for d in doc_ids], np.uint8)
    named = np.array([d or 0 for d in doc_ids], "<i8")
    rules = np.concatenate(made).astype("<u4") if made else np.empty((0, 2), "<u4")
    head = struct.pack("<8sIIIIQQ", MAGIC, len(doc_ids), terminals, len(made), np.dtype(wide).itemsize, len(seq), len(ids))
    body = [np.array([len(m) for m in made], "<u4"), rules, size[terminals:].astype("<u4"), known, named, token_at.astype("<u8"), symbol_at.astype("<u8"), seq.astype(np.dtype(wide).newbyteorder("<"))]
    return head + b"".join(x.tobytes() for x in body)


class Shard:
    """A shard file opened for reading."""

    def __init__(self, blob: bytes):
        magic, self.n_docs, self.terminals, rounds, wide, symbols, self.n_tokens = struct.unpack_from("<8sIIIIQQ", blob)
        if magic != MAGIC:
            raise ValueError("not a shard file")
        self._at = struct.calcsize("<8sIIIIQQ")

        def take(kind: str, n: int) -> np.ndarray:
            out = np.frombuffer(blob, kind, n, self._at)
            self._at += out.nbytes
            return out

        each = take("<u4", rounds)
        rules = take("<u4", 2 * int(each.sum())).reshape(-1, 2)
        self.made = np.split(rules, np.cumsum(each)[:-1]) if rounds else []
        self.sizes = np.concatenate([np.ones(self.terminals, np.uint32), take("<u4", len(rules))])
        known, named = take("u1", self.n_docs), take("<i8", self.n_docs)
        self.doc_ids = [int(d) if k else None for d, k in zip(named, known)]
        self.token_at, self.symbol_at = take("<u8", self.n_docs + 1), take("<u8", self.n_docs + 1)
        self.seq = take(f"<u{wide}", symbols)

    def doc(self, i: int) -> np.ndarray:
        """The ids of document ``i``, decoded alone."""
        return expand(self.seq[int(self.symbol_at[i]) : int(self.symbol_at[i + 1])].astype(np.uint32), self.made, self.terminals)

    def slice(self, start: int, stop: int) -> np.ndarray:
        """Ids ``start`` to ``stop`` of the shard: only the symbols that hold them are expanded."""
        upto = np.concatenate([[0], np.cumsum(self.sizes[self.seq], dtype=np.int64)])
        lo = int(np.searchsorted(upto, start, "right")) - 1
        hi = int(np.searchsorted(upto, stop, "left"))
        return expand(self.seq[lo:hi].astype(np.uint32), self.made, self.terminals)[start - int(upto[lo]) :][: stop - start]

    def all(self) -> np.ndarray:
        return expand(self.seq.astype(np.uint32), self.made, self.terminals)


SHARDS = "part int, shard int, n_docs long, n_tokens long, n_symbols long, blob binary"


def write_shards(docs: DataFrame, vocabulary: str, end: int = 1, shard: int = SHARD) -> DataFrame:
    """The shard files of ``docs`` (doc_id, text) as stored rows, in ascending doc_id order by (part, shard)."""
    tune(docs.sparkSession)

    def run(batches):
        encoder, part = Encoder.of(vocabulary), TaskContext.get().partitionId()
        encoder.most = KEPT
        names, parts, full, number = [], [], 0, 0

        def close():
            blob = to_blob(names, parts, end)
            return pa.RecordBatch.from_pydict({"part": pa.array([part], pa.int32()), "shard": pa.array([number], pa.int32()), "n_docs": [len(names)], "n_tokens": [full], "n_symbols": [Shard(blob).seq.size], "blob": pa.array([blob], pa.binary())})

        last = np.array([end], np.uint32)
        for batch in gathered(batches, 1, BATCH):
            flat, at = encoder.flat(batch.column(1))
            for doc, a, b in zip(batch.column(0).to_pylist(), at.tolist(), at[1:].tolist()):
                ids = np.concatenate([flat[a:b], last])
                if parts and full + len(ids) > shard:
                    yield close()
                    names, parts, full, number = [], [], 0, number + 1
                names.append(doc)
                parts.append(ids)
                full += len(ids)
        if parts:
            yield close()

    ordered = docs.select("doc_id", "text").repartitionByRange(F.col("doc_id").asc_nulls_first()).sortWithinPartitions(F.col("doc_id").asc_nulls_first(), "text")
    return store(ordered.mapInArrow(run, SHARDS), "shards")


def with_base(shards: DataFrame) -> DataFrame:
    """``shards`` with base: the ids of all shards before. The one ordered pass spans a row per part."""
    heads = shards.select("part", "shard", "n_tokens")
    parts = heads.groupBy("part").agg(F.sum("n_tokens").alias("_n"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.select("part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_base"))
    inside = Window.partitionBy("part").orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    heads = heads.withColumn("_in", F.coalesce(F.sum("n_tokens").over(inside), F.lit(0))).join(parts, "part")
    # A row of three numbers a shard; stored, so Spark knows its size and, while it is small, leaves the blobs where they are.
    heads = store(heads.select("part", "shard", (F.col("_base") + F.col("_in")).alias("base")), "shard-bases")
    return shards.join(heads, ["part", "shard"])


def read_docs(shards: DataFrame, with_ids: bool = False) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 (and ids) of every document, from the files."""

    def run(batches):
        for batch in batches:
            for base, blob in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                s = Shard(blob)
                raw, at = s.all().astype("<u4").tobytes(), s.token_at.astype(np.int64)
                cut = [raw[4 * a : 4 * b] for a, b in zip(at, at[1:])]
                out = {"doc_id": pa.array(s.doc_ids, pa.int64()), "start": pa.array(at[:-1] + base), "n_tokens": pa.array(np.diff(at)), "ids_crc32": pa.array([zlib.crc32(c) for c in cut], pa.int64())}
                if with_ids:
                    out["ids"] = pa.array(cut, pa.binary())
                yield pa.RecordBatch.from_pydict(out)

    return with_base(shards).select("base", "blob").mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long" + (", ids binary" if with_ids else ""))
