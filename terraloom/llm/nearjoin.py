"""N-gram Jaccard join in metric space, exact, by pivots and Voronoi regions.

Documents are sets of 5-word shingles; 1 - Jaccard is a metric. Documents
with equal sets collapse to one point first. The join then works in rounds:

1. Neighbourhoods. Shingles are ordered by the number of sets that hold
   them, rarest first. Two sets within ``radius`` share one of the first
   ``floor(radius * n) + 1`` shingles of either in that order, so a shingle
   that stands there in two sets or more is a cell; sets that share no cell
   are farther apart than ``radius`` and need no distance.
2. Pivots. Each open cell gets its most central point and, if it is large,
   about ``PIVOTS`` more, drawn by hash. A pivot gets its exact distance to
   every point of the cell that could be near; for the others sizes and
   sketches (512 parity bits a set) bound it from below.
3. Voronoi regions of large cells. A point goes to the region of its nearest
   pivot, if it is within twice the radius; points far from all pivots stay
   together.
4. Windows. By the triangle inequality a point outside a region can be linked
   with one inside only if its distance to the pivot is at most the region's
   own radius plus ``radius``: such points are copied into the region. Points
   within ``radius`` of the pivot go on only as far as a point beyond that
   radius may reach them.
5. Components of the links so far are the points' homes. A cell or region of
   one home is done; in all others the points outside the commonest home are
   compared with every point of another home, in blocks of bounded size. Sizes,
   places and sketches decide in the join itself, so only pairs that are linked
   or nearly so leave it.

No group of near copies is expanded into its pairs: what a pivot connects is
one home. Connected components over the links come from alternating large-star
and small-star steps, in DataFrames.

Counts of shingles (step 1) never leave the executors as rows: each task
sorts the 32-bit shingle codes of its documents by range of codes, ranges
count, and the counts return to the task's documents as blocks.

Defined results: null or empty texts, and texts of white space, have an
empty set and are linked with nothing; fewer than ``words`` words make one
shingle of the whole sequence; repeated rows and ties are equal sets and
share a component; a null doc_id takes no part in components; an empty table
gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, functions as F

from terraloom.llm.common import store, tidy, tune

WORDS = 5
#: Similarity as a fraction: linked if DEN * both >= NUM * either.
NUM, DEN = 75, 100
RANGES = 64
PIVOTS = 4  #: drawn in a large cell in the first round, beside the central one
DIRECT = 256  #: points of a cell, or of a block of one, that are compared with each other
LEVELS = 1  #: rounds of regions; what these leave whole is compared by blocks
SKETCH = 8  #: 64-bit words of a set's sketch
SKETCHED = [f"s{k}" for k in range(SKETCH)]
UNIT_DOCS = 1 << 14  #: documents whose shingles a task sorts at once
UNIT_SHINGLES = 1 << 21
BITS = 1 << 23  #: of the filter that spares texts no pair needs
COMMON = 128  #: a code in so many documents of a unit travels without them

_M1, _M2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_BYTE = np.random.default_rng(7).integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BASE = np.uint64(0x9E3779B97F4A7C15)
_powers: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * _M1
    x = (x ^ (x >> np.uint64(27))) * _M2
    return x ^ (x >> np.uint64(31))


def _power(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first powers of the base and of its inverse, modulo 2**64."""
    size = 1 << max(12, int(n).bit_length())
    if size not in _powers:
        _powers.clear()
        inverse = np.uint64(pow(int(_BASE), -1, 1 << 64))
        up = np.cumprod(np.full(size, _BASE, np.uint64))
        down = np.cumprod(np.full(size, inverse, np.uint64))
        _powers[size] = up, down
    return _powers[size]


def word_codes(text: str | None) -> np.ndarray:
    """A 64-bit code of each word, A-Z lower-cased, words cut at ASCII white space."""
    raw = _LOWER[np.frombuffer((text or "").encode("utf-8", "surrogatepass"), np.uint8)]
    gap = np.concatenate(([True], _SPACE[raw], [True]))
    edge = np.flatnonzero(gap[1:] != gap[:-1])
    start, stop = edge[0::2], edge[1::2]
    if not len(start):
        return np.empty(0, np.uint64)
    up, down = _power(len(raw) + 1)
    total = np.concatenate((np.zeros(1, np.uint64), np.cumsum(_BYTE[raw] * up[: len(raw)])))
    return _mixed((total[stop] - total[start]) * down[start] + (stop - start).astype(np.uint64))


def shingle_codes(text: str | None, words: int = WORDS) -> np.ndarray:
    """The sorted distinct 64-bit shingle codes of a text."""
    w = word_codes(text)
    if not len(w):
        return w
    n = min(words, len(w))
    h = np.full(len(w) - n + 1, n, np.uint64)
    for k in range(n):
        h = _mixed(h * _M1 + w[k : len(w) - n + 1 + k])
    return np.unique(h)


def print_of(codes: np.ndarray) -> tuple[int, int]:
    """Two 63-bit codes of a set."""
    a = np.bitwise_xor.reduce(_mixed(codes + _M2), initial=np.uint64(len(codes)))
    b = np.add.reduce(_mixed(codes ^ _M1), dtype=np.uint64)
    return int(a >> np.uint64(1)), int(b >> np.uint64(1))


def sketch(codes: np.ndarray) -> np.ndarray:
    """Whether an odd number of codes falls into each bit: no more bits differ between two sets than codes."""
    odd = np.bincount((codes & np.uint64(64 * SKETCH - 1)).astype(np.int64), minlength=64 * SKETCH) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little").view("<i8")


def sets(docs: DataFrame, words: int = WORDS) -> DataFrame:
    """doc_id, n_shingles, and p1, p2 that are equal for equal sets (null for empty ones)."""
    tune(docs.sparkSession)

    def run(batches):
        for batch in batches:
            rows = []
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                codes = shingle_codes(text, words)
                rows.append((doc, len(codes), *(print_of(codes) if len(codes) else (None, None))))
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in (zip(*rows) if rows else [[]] * 4)], names=["doc_id", "n_shingles", "p1", "p2"])
        tidy()

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, n_shingles long, p1 long, p2 long")


def reach(n: np.ndarray | int, num: int = NUM, den: int = DEN):
    """How many first shingles a set of ``n`` must show: n - ceil(n * num / den) + 1."""
    return n - -(-n * num // den) + 1


def _planes(x: np.ndarray) -> bytes:
    """Little-endian integers as byte planes, which compress better."""
    return x.view(np.uint8).reshape(-1, x.itemsize).T.tobytes()


def _unplanes(raw: bytes, at: int, n: int, kind: str) -> tuple[np.ndarray, int]:
    size = np.dtype(kind).itemsize
    out = np.frombuffer(raw, np.uint8, n * size, at).reshape(size, n).T.copy().view(kind).reshape(n)
    return out, at + n * size


def _block(code: np.ndarray, doc: np.ndarray) -> tuple[bytes, list[tuple[np.ndarray, np.ndarray]]]:
    """Sorted postings of a range as distinct codes, counts and, unless a code is common here, its documents."""
    start = np.flatnonzero(np.concatenate(([True], code[1:] != code[:-1])))
    n = np.diff(np.append(start, len(code)))
    uniq = code[start]
    common = n >= COMMON
    rare = np.repeat(~common, n)
    raw = np.array([len(uniq)], "<u4").tobytes() + _planes(np.diff(uniq, prepend=np.uint32(0)).astype("<u4")) + _planes(np.minimum(n, COMMON).astype("<u2")) + _planes(doc[rare].astype("<u2"))
    return raw, [(uniq[k], doc[start[k] : start[k] + n[k]]) for k in np.flatnonzero(common)]


def _unblock(raw: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    n = int(np.frombuffer(raw, "<u4", 1)[0])
    step, at = _unplanes(raw, 4, n, "<u4")
    counts, at = _unplanes(raw, at, n, "<u2")
    held = int(counts[counts < COMMON].sum())
    doc, _ = _unplanes(raw, at, held, "<u2")
    return np.cumsum(step, dtype=np.uint32), counts, doc


def cells(docs: DataFrame, shingles: int, num: int = NUM, den: int = DEN, words: int = WORDS) -> DataFrame:
    """(cell, id, n, at) of the first shingles of ``docs`` (doc_id, text) that stand in two sets or more.

    ``at`` is the shingle's place in its set, rarest first.

    ``shingles`` is their number in all and sets how many ranges count.
    """
    tune(docs.sparkSession)
    ranges = max(RANGES, shingles // UNIT_SHINGLES)
    bounds = (np.arange(ranges + 1, dtype=np.uint64) << np.uint64(32)) // np.uint64(ranges)

    def out_of(rows: list[tuple[int, int, bytes]]) -> pa.RecordBatch:
        units, ranges_, blocks = zip(*rows) if rows else ((), (), ())
        return pa.RecordBatch.from_arrays([pa.array(units, pa.int64()), pa.array(ranges_, pa.int32()), pa.array(blocks, pa.binary())], names=["unit", "range", "block"])

    def codes_of(batches):
        part = TaskContext.get().partitionId() << 24
        texts, ids, total, number = [], [], 0, 0

        def close():
            lens = np.array([len(t) for t in texts], "<i8")
            code = (np.concatenate(texts) >> np.uint64(32)).astype(np.uint32)
            doc = np.repeat(np.arange(len(texts), dtype=np.uint16), lens)
            order = np.argsort(code, kind="stable")
            code, doc = code[order], doc[order]
            cut = np.searchsorted(code.astype(np.uint64), bounds)
            rows, common = [], []
            for r, (a, b) in enumerate(zip(cut, cut[1:])):
                if b > a:
                    raw, held = _block(code[a:b], doc[a:b])
                    rows.append((part + number, r, raw))
                    common += held
            head = np.array([len(texts), len(common)], "<u4").tobytes() + np.array(ids, "<i8").tobytes() + lens.tobytes()
            head += b"".join(np.array([c, len(d)], "<u4").tobytes() + d.astype("<u2").tobytes() for c, d in common)
            return out_of([(part + number, -1, head), *rows])

        for batch in batches:
            for ident, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                codes = shingle_codes(text, words)
                if ident is None or not len(codes):
                    continue
                if texts and (len(texts) >= UNIT_DOCS or total + len(codes) > UNIT_SHINGLES):
                    yield close()
                    texts, ids, total, number = [], [], 0, number + 1
                texts.append(codes)
                ids.append(ident)
                total += len(codes)
        if texts:
            yield close()
        texts.clear()
        tidy()

    def counted(table: pa.Table) -> pa.Table:
        """How many sets hold each code of a range, back to the units that asked."""
        units = table.column("unit").to_pylist()
        if table.column("range")[0].as_py() < 0:
            return table
        parts = [_unblock(x) for x in table.column("block").to_pylist()]
        code = np.concatenate([c for c, _, _ in parts])
        n = np.concatenate([k for _, k, _ in parts])
        _, where = np.unique(code, return_inverse=True)
        df = np.bincount(where, n)[where].astype(np.uint32)
        rows, at = [], 0
        for unit, (c, k, d) in zip(units, parts):
            mine = df[at : at + len(c)]
            at += len(c)
            keep, rare = mine > 1, k < COMMON
            docs_ = d[np.repeat(keep[rare], k[rare])]
            head = np.array([int(keep.sum())], "<u4").tobytes()
            rows.append((unit, 0, head + _planes(np.diff(c[keep], prepend=np.uint32(0)).astype("<u4")) + _planes(k[keep].astype("<u2")) + _planes(mine[keep].astype("<u4")) + _planes(docs_.astype("<u2"))))
        return pa.Table.from_batches([out_of(rows)])

    def firsts(table: pa.Table) -> pa.Table:
        """The cells of a unit's documents."""
        codes, dfs, owners, head = [], [], [], b""
        for r, raw in zip(table.column("range").to_pylist(), table.column("block").to_pylist()):
            if r < 0:
                head = raw
                continue
            n = int(np.frombuffer(raw, "<u4", 1)[0])
            step, at = _unplanes(raw, 4, n, "<u4")
            k, at = _unplanes(raw, at, n, "<u2")
            df, at = _unplanes(raw, at, n, "<u4")
            c, rare = np.cumsum(step, dtype=np.uint32), k < COMMON
            held, _ = _unplanes(raw, at, int(k[rare].sum()), "<u2")
            codes.append(np.repeat(c[rare], k[rare]))
            dfs.append(np.repeat(df[rare], k[rare]))
            owners.append(held)
            if not rare.all():
                common_df = dict(zip(c[~rare].tolist(), df[~rare].tolist()))
                dfs.append(common_df)  # joined below, once the head is known
                codes.append(None)
                owners.append(None)
        n_docs, n_common = np.frombuffer(head, "<u4", 2)
        ids = np.frombuffer(head, "<i8", n_docs, 8)
        lens = np.frombuffer(head, "<i8", n_docs, 8 + 8 * int(n_docs))
        at = 8 + 16 * int(n_docs)
        shared = {}
        for c, d in zip(codes, dfs):
            if c is None:
                shared |= d
        flat = [(c, d, o) for c, d, o in zip(codes, dfs, owners) if c is not None]
        for _ in range(int(n_common)):
            c, k = np.frombuffer(head, "<u4", 2, at)
            d = np.frombuffer(head, "<u2", int(k), at + 8)
            at += 8 + 2 * int(k)
            flat.append((np.full(int(k), c, np.uint32), np.full(int(k), shared[int(c)], np.uint32), d))
        code, df, doc = (np.concatenate([x[i] for x in flat]) if flat else np.empty(0, np.uint32) for i in range(3))
        order = np.lexsort((code, df, doc))
        code, doc = code[order], doc[order].astype(np.int64)
        have = np.bincount(doc, minlength=len(ids))
        place = np.arange(len(doc)) - (np.cumsum(have) - have)[doc]
        # Shingles no other set holds come first; they make no cell.
        place += (lens - have)[doc]
        keep = place < reach(lens, num, den)[doc]
        return pa.table({"cell": pa.array(code[keep].astype(np.int64)), "id": pa.array(ids[doc[keep]]), "n": pa.array(lens[doc[keep]]), "at": pa.array(place[keep])})

    kind = "unit long, range int, block binary"
    blocks = docs.select("doc_id", "text").mapInArrow(codes_of, kind)
    # A unit's head needs no counting: it gets a range of its own.
    spot = F.when(F.col("range") < 0, -1 - F.col("unit")).otherwise(F.col("range")).alias("spot")
    back = blocks.select("unit", "range", "block", spot).groupBy("spot").applyInArrow(lambda t: counted(t.select(["unit", "range", "block"])), kind)
    return back.groupBy("unit").applyInArrow(firsts, "cell long, id long, n long, at long").groupBy("cell", "id").agg(F.max("n").alias("n"), F.min("at").alias("at"))


def set_table(docs: DataFrame, ids: DataFrame, words: int = WORDS) -> DataFrame:
    """(id, codes, sketch): the sorted shingle codes, as bytes, of the documents in ``ids`` (id), stored."""
    bits = ids.select(F.pmod(F.xxhash64("id"), F.lit(BITS)).alias("spot"))
    found = bits.groupBy(F.expr("spot div 64").alias("word")).agg(F.expr("bit_or(shiftleft(1L, cast(spot % 64 as int)))").alias("bits"))
    table = np.zeros(BITS // 64, np.int64)
    got = found.toArrow()  # at most BITS / 64 rows
    table[got.column("word").to_numpy()] = got.column("bits").to_numpy()
    asked = docs.sparkSession.sparkContext.broadcast(table)
    tune(docs.sparkSession)

    def coded(batches):
        for batch in batches:
            spot = batch.column(2).to_numpy(zero_copy_only=False)
            some = pa.array(np.flatnonzero(asked.value[spot >> 6] >> (spot & 63) & 1))
            codes = [shingle_codes(t, words) for t in batch.column(1).take(some).to_pylist()]
            sketches = np.array([sketch(c) for c in codes], np.int64).reshape(-1, SKETCH)
            yield pa.RecordBatch.from_arrays([batch.column(0).take(some), pa.array([c.tobytes() for c in codes], pa.binary()), *[pa.array(x) for x in sketches.T]], names=["id", "codes", *SKETCHED])

    rows = docs.where(F.col("doc_id").isNotNull()).select("doc_id", "text", F.pmod(F.xxhash64("doc_id"), F.lit(BITS)).alias("spot"))
    rows = rows.mapInArrow(coded, ", ".join(["id long", "codes binary", *[f"{c} long" for c in SKETCHED]]))
    return store(rows.join(ids.select("id").distinct(), "id", "left_semi").dropDuplicates(["id"]), "near-sets")


def distances(known: DataFrame, pairs: DataFrame) -> DataFrame:
    """``pairs`` (a, b) with na, nb and both, the size of the sets' intersection.

    The larger group is on ``a``: it meets its codes while rows are short, and
    each pair then goes to its own ``b``.
    """
    side = lambda x: known.select(F.col("id").alias(x), F.col("codes").alias(f"codes_{x}"))
    rows = pairs.join(side("a"), "a").join(side("b"), "b")

    def meet(batches):
        for batch in batches:
            ca, cb = batch.column(2).to_pylist(), batch.column(3).to_pylist()
            both = [len(np.intersect1d(np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64), assume_unique=True)) for x, y in zip(ca, cb)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array([len(x) // 8 for x in ca], pa.int64()), pa.array([len(x) // 8 for x in cb], pa.int64()), pa.array(both, pa.int64())], names=["a", "b", "na", "nb", "both"])

    return rows.select("a", "b", "codes_a", "codes_b").mapInArrow(meet, "a long, b long, na long, nb long, both long")


def merged(cut: DataFrame) -> DataFrame:
    """``cut`` without cells of one set, and with one cell for all that hold the same sets.

    Such cells would show the same pairs; the earliest place stands for all.
    """
    per = cut.groupBy("cell").agg(F.count(F.lit(1)).alias("_c"), F.bit_xor(F.xxhash64("id")).alias("_x"), F.bit_xor(F.xxhash64(F.lit(1), "id")).alias("_y"))
    per = per.where(F.col("_c") > 1)
    chosen = per.groupBy("_c", "_x", "_y").agg(F.min("cell").alias("_cell"))
    per = per.join(chosen, ["_c", "_x", "_y"]).select("cell", "_cell")
    return cut.join(per, "cell").groupBy(F.col("_cell").alias("cell"), "id").agg(F.max("n").alias("n"), F.min("at").alias("at"))


def _bound(x: str, y: str) -> Column:
    """At least so many shingles stand in one of two sets only."""
    return sum((F.bit_count(F.col(x + c).bitwiseXOR(F.col(y + c))) for c in SKETCHED), F.lit(0))


def links(docs: DataFrame, cut: DataFrame, num: int = NUM, den: int = DEN, words: int = WORDS, trace: list[dict] | None = None) -> DataFrame:
    """Edges (a, b) whose components are those of all links, by rounds over ``cut`` (cell, id, n, at).

    The central point of a cell is the one with the fewest shingles of its own
    before the cell's. Measured are only pairs of different homes (components
    so far) that may be linked: by their sizes, by their sketches, and by
    their shingles from the cell's on (the first shingle that two sets share
    bounds their overlap). Bounds on distances, which regions need, come from
    sizes and sketches alone. ``trace`` gets what each round did.
    """
    radius = 1 - num / den
    slack = 1e-9
    similar = (F.col("na") + F.col("nb")) * num <= F.col("both") * (num + den)
    apart = 1 - F.col("both") / (F.col("na") + F.col("nb") - F.col("both"))
    n, at, pn, pat = F.col("n"), F.col("at"), F.col("pn"), F.col("pat")
    most = F.least(n - at, pn - pat)  # of common shingles, if the cell's is the first
    sized = F.least(n, pn) * den >= F.greatest(n, pn) * num
    sketched = _bound("", "p") * (den + num) <= (n + pn) * (den - num)
    possible = (F.col("home") != F.col("phome")) & sized & (most * (num + den) >= (n + pn) * num) & sketched
    least_apart = F.greatest(1 - F.least(n, pn) / F.greatest(n, pn), 2 * _bound("", "p") / (n + pn + _bound("", "p")))
    point = ["id", "n", "at", "home", *SKETCHED]
    as_pivot = [F.col(c).alias(f"p{c}") for c in ("n", "at", "home", *SKETCHED)]
    later = F.col("id") != F.col("pivot")

    known = set_table(docs, cut, words)
    state = store(cut.join(known.select("id", *SKETCHED), "id").select("cell", "id", "n", "at", F.col("id").alias("home"), *SKETCHED), "near-state")
    edges = state.select(F.col("id").alias("a"), F.col("id").alias("b")).limit(0)
    level = 0
    while True:
        central = F.min(F.struct((F.col("at") / F.col("n")).alias("draw"), "id"))
        # Per cell its size, its commonest home, its central point; a cell of one home is done.
        homes = state.groupBy("cell", "home").agg(F.count(F.lit(1)).alias("_n"), central.alias("_first"))
        per = homes.groupBy("cell").agg(F.sum("_n").alias("size"), F.count(F.lit(1)).alias("_homes"), F.max(F.struct("_n", "home"))["home"].alias("main"), F.min("_first")["id"].alias("first"))
        big = F.col("size") > DIRECT
        direct = F.lit(False) if not level else ~big | F.lit(level >= LEVELS)
        per = store(per.where(F.col("_homes") > 1).select("cell", "size", "main", "first", big.alias("big"), direct.alias("direct")), "near-open")
        if per.isEmpty():
            break
        rows = state.join(per, "cell")
        asked = []
        if level:
            # All pairs of two homes of a cell, in blocks of about DIRECT points.
            blocks = F.ceil(F.col("size") / DIRECT).cast("int")
            ends = rows.where("direct").withColumn("block", F.pmod(F.xxhash64("id"), blocks).cast("int"))
            asks = rows.where(F.col("direct") & (F.col("home") != F.col("main"))).select("cell", F.col("id").alias("pivot"), *as_pivot, F.explode(F.sequence(F.lit(0), blocks - 1)).alias("block"))
            once = (F.col("home") == F.col("main")) | (F.col("id") < F.col("pivot"))
            asked.append(ends.join(asks, ["cell", "block"]).where(once & possible).select(F.col("pivot").alias("a"), F.col("id").alias("b")))
        drawn = F.pmod(F.xxhash64("id", F.lit(level)), F.lit(1 << 30)) / float(1 << 30) < F.lit(float(PIVOTS << 2 * level)) / F.col("size")
        pivots = rows.where(~F.col("direct") & ((F.col("id") == F.col("first")) | (F.col("big") & drawn)))
        pivots = store(pivots.select("cell", F.col("id").alias("pivot"), *as_pivot, "big"), "near-pivots")
        asked.append(state.join(pivots.where(~F.col("big")), "cell").where(later & possible).select(F.col("pivot").alias("a"), F.col("id").alias("b")))
        wide_cells = not pivots.where("big").isEmpty()
        if wide_cells:
            met = state.join(pivots.where("big"), "cell").where(later).withColumn("may", possible).withColumn("least", least_apart)
            met = store(met.select("cell", *point, "pivot", "may", "least"), "near-met")
            asked.append(met.where("may").select(F.col("pivot").alias("a"), F.col("id").alias("b")))
        pairs = asked[0]
        for more in asked[1:]:
            pairs = pairs.union(more)
        found = store(distances(known, pairs.distinct()), "near-distances")
        edges = edges.union(found.where(similar).select("a", "b"))
        # Cells of three points and more that were not split go on as they are.
        left = state.join(per.where(~F.col("direct") & ~F.col("big") & (F.col("size") > 2)).select("cell"), "cell", "left_semi").select("cell", *point)
        if wide_cells:
            far = found.select(F.col("a").alias("pivot"), F.col("b").alias("id"), apart.alias("apart"), similar.alias("linked"))
            judged = met.join(far, ["pivot", "id"], "left").join(pivots.where("big").select("cell", F.col("pivot").alias("id")), ["cell", "id"], "left_anti")
            judged = judged.withColumn("linked", F.coalesce("linked", F.lit(False))).withColumn("d", F.coalesce("apart", "least"))
            # The nearest pivot of each point among those whose distance is known.
            nearest = F.min(F.when(F.col("apart") <= 2 * radius, F.struct("apart", "pivot")))["pivot"]
            of_point = [F.min(c).alias(c) for c in point[1:]]
            regions = store(judged.groupBy("cell", "id").agg(nearest.alias("region"), *of_point), "near-regions")
            judged = judged.select("cell", *point, "pivot", "linked", "d").join(regions.select("cell", "id", "region"), ["cell", "id"])
            judged = store(judged, "near-judged")
            wide = judged.where(F.col("region") == F.col("pivot")).groupBy("cell", "pivot").agg(F.max("d").alias("_wide"))
            held = judged.join(wide, ["cell", "pivot"]).withColumn("inner", F.coalesce(F.col("region") == F.col("pivot"), F.lit(False)))
            held = held.where(F.col("inner") | (F.col("d") <= F.col("_wide") + radius + slack))
            # Regions of one pivot go on as one: what shared one still does.
            held = held.groupBy("pivot", "id").agg(*of_point, F.max("linked").alias("linked"), F.min("d").alias("d"), F.max("inner").alias("inner"))
            held = store(held, "near-windows")
            outside = held.where(~F.col("linked")).groupBy("pivot").agg(F.min("d").alias("_out"))
            kept = held.join(outside, "pivot").where(~F.col("linked") | (F.col("d") >= F.col("_out") - radius - slack))
            left = left.union(kept.select(F.xxhash64(F.lit(level), "pivot").alias("cell"), *point))
            left = left.union(regions.where(F.col("region").isNull()).select(F.xxhash64(F.lit(-1), "cell").alias("cell"), *point))
        if trace is not None:
            split = {"regions": held.where("inner").select("pivot").distinct().count(), "inside": held.where("inner").count(), "copied": held.where(~F.col("inner")).count()} if wide_cells else {}
            trace.append({"cells": per.count(), "pivots": pivots.count(), "pairs": found.count(), **split})
        if left.isEmpty():
            break
        parts = components(edges).withColumnRenamed("component", "_home")
        left = left.join(parts, "id", "left").select("cell", "id", "n", "at", F.coalesce("_home", "home").alias("home"), *SKETCHED)
        state = store(left, "near-state")
        level += 1
    return store(edges.distinct(), "near-links")


def components(edges: DataFrame) -> DataFrame:
    """(id, component) of every end of ``edges`` (a, b): the smallest id reachable, by alternating stars."""
    pairs = store(edges.where(F.col("a") != F.col("b")).select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "stars")
    before: tuple | None = None
    while True:
        both = pairs.union(pairs.select("v", "u"))
        least = both.groupBy("u").agg(F.min("v").alias("_m")).select("u", F.least("_m", "u").alias("m"))
        large = both.join(least, "u").where(F.col("v") > F.col("u")).select(F.col("v").alias("u"), F.col("m").alias("v")).where(F.col("u") != F.col("v")).distinct()
        large = store(large, "stars")
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        hang = large.join(least, "u").where(F.col("v") != F.col("m")).select(F.col("v").alias("u"), F.col("m").alias("v"))
        pairs = store(hang.union(least.select("u", F.col("m").alias("v"))).distinct(), "stars")
        now = tuple(pairs.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v") % F.lit(1 << 31))).first())
        if now == before:
            break
        before = now
    roots = pairs.select(F.col("v").alias("id"), F.col("v").alias("component")).distinct()
    return pairs.select(F.col("u").alias("id"), F.col("v").alias("component")).union(roots)


def join(docs: DataFrame, num: int = NUM, den: int = DEN, words: int = WORDS) -> DataFrame:
    """doc_id, n_shingles, class_id (smallest doc_id with an equal set) and component_id of ``docs`` (doc_id, text)."""
    every = store(sets(docs, words), "near-points")
    classes = every.where(F.col("p1").isNotNull()).groupBy("p1", "p2").agg(F.min("doc_id").alias("class_id"), F.max("n_shingles").alias("n"))
    classes = store(classes, "near-classes")
    total = every.agg(F.sum("n_shingles")).first()[0] or 0
    cut = cells(docs, total, num, den, words).join(classes.select(F.col("class_id").alias("id")), "id", "left_semi")
    cut = merged(store(cut.select("cell", "id", "n", "at"), "near-cells"))
    parts = components(links(docs, cut, num, den, words))
    classes = classes.join(parts, classes["class_id"] == parts["id"], "left").select("p1", "p2", "class_id", F.coalesce("component", "class_id").alias("component_id"))
    out = every.join(classes, ["p1", "p2"], "left")
    return out.select("doc_id", "n_shingles", F.coalesce("class_id", "doc_id").alias("class_id"), F.coalesce("component_id", "doc_id").alias("component_id"))


def keep_one(docs: DataFrame, **options) -> DataFrame:
    """``docs`` with one document of each group: that with the smallest doc_id; all columns stay.

    Rows repeated under one doc_id with one text count once; rows without a
    doc_id stay, as they are in no group.
    """
    found = join(docs, **options)
    later = found.where(F.col("doc_id") != F.col("component_id")).select("doc_id").distinct()
    left = docs.join(later, "doc_id", "left_anti").select(*docs.columns)
    return left.where(F.col("doc_id").isNotNull()).dropDuplicates(["doc_id", "text"]).union(left.where(F.col("doc_id").isNull()))
