"""The training-data operators against brute force, and their defined results for odd rows."""

import hashlib
import itertools
import math
import os
import re
import subprocess
import sys
import time
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from terraloom.llm import hilbert, linededup, matroska, mixing, nearjoin, packing, repair, template, tokens, toxicity, warc

DOCS = "doc_id long, text string, source string, score double"
BASE = "the river runs below the old fault and the aquifer feeds it slowly every year until the dry season ends again in may".split()


def near(k: int) -> str:
    """The same sentence with one word of its own."""
    w = list(BASE)
    w[k % len(w)] = f"word{k}"
    return " ".join(w)


ODD = [
    (1, None, None, 0.0), (2, "", "a", 0.0), (3, " \n\t ", "a", 0.0), (4, "one", "b", 0.0), (5, "One", "b", 0.0), (6, near(20), "a", 0.0), (7, near(21), "a", 0.0),
    (8, "x y z\n" + " ".join(BASE) + "\nq", None, 0.0), (9, " ".join(f"w{i}" for i in range(30_000)), "b", 0.0), (9, " ".join(f"w{i}" for i in range(30_000)), "b", 0.0), (10, "é ß 漢字   <|endoftext|> it's", "c", 0.0),
]


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame(ODD, DOCS)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], DOCS)


def shingles(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return frozenset(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))) if w else frozenset()


# 1
def test_toxicity_learns_and_scores_odd_rows(spark, odd, empty):
    rng = np.random.default_rng(0)
    plain = ["stone", "water", "layer", "sand", "ridge", "basin"]
    rows = [(i, " ".join(rng.choice(plain, 12)) + (f" vilespeak{rng.choice(['er', 'ing', 'ed'])}" if i % 4 == 0 else ""), int(i % 4 == 0)) for i in range(600)]
    d = spark.createDataFrame(rows, "doc_id long, text string, toxic int")
    model = toxicity.train(d, d.select("doc_id", "toxic"), sample=500)
    got = toxicity.score(d, model).where(toxicity.held_out(F.col("doc_id"))).toPandas()
    assert (got["predicted"] == got["toxic"]).mean() > 0.97
    scored = toxicity.score(odd, model).toPandas()
    assert len(scored) == len(ODD) and scored["score"].between(0, 1).all()
    assert toxicity.score(empty, model).count() == 0
    assert toxicity.train(d, spark.createDataFrame([], "doc_id long, toxic int")).score("x") < 1e-9


def test_toxicity_on_held_out_rows(spark):
    """The registered query on whole tables: most toxic rows that training didn't see are caught, and few others."""
    from terraloom.llm import queries

    sf = "/root/testdata/sf0.1"
    got = queries.op1_toxicity(spark, sf).where("held_out").join(spark.read.parquet(f"{sf}/labels.parquet"), "doc_id").toPandas()
    toxic = got["toxic"] == 1
    assert toxic.sum() > 50 and got[toxic]["predicted"].mean() > 0.8 and got[~toxic]["predicted"].mean() < 0.02


def test_held_out_fold(spark):
    assert not spark.range(1).select(toxicity.held_out(F.lit(None).cast("long"))).first()[0]
    got = spark.range(50).select("id", toxicity.held_out(F.col("id")).alias("h")).collect()
    assert all(r["h"] == (zlib.crc32(str(r["id"]).encode()) % 5 == 0) for r in got)


# 2
@pytest.mark.parametrize("lacing", matroska.LACINGS)
@pytest.mark.parametrize("n", [0, 1, 192, 193, 40_000])
def test_matroska_round_trip(lacing, n):
    payload = matroska.pad(np.random.default_rng(n).bytes(n))
    stored = matroska.encode(payload, lacing)
    media = matroska.packets(stored)
    assert b"".join(stored[a : a + k] for _, _, a, k in media.packets) == payload
    assert [c[2] for c in media.cues] == media.clusters and [p[1] for p in media.packets] == [24 * i for i in range(len(payload) // 192)]


def test_matroska_reads_unequal_lacing_groups_and_unknown_sizes():
    frames = [b"a" * 5, b"b" * 300, b"c" * 260, b"d" * 7]
    for how in ("xiph", "ebml"):
        body = matroska.uint(matroska.CLUSTER_TIME, 7) + matroska.block(2, 3, frames, how, simple=False)
        head = matroska.element(matroska.EBML, b"")
        open_ = lambda ident, b: ident.to_bytes(4, "big") + b"\x01" + b"\xff" * 7 + b
        data = head + open_(matroska.SEGMENT, open_(matroska.CLUSTER, body) + matroska.element(matroska.CLUSTER, body))
        got = matroska.packets(data)
        assert [data[a : a + n] for _, _, a, n in got.packets] == frames * 2 and got.packets[0][:2] == (2, 10)
    with pytest.raises(ValueError):
        matroska.packets(b"\x00\x01")


def test_media_columns(odd, empty):
    got = {r["doc_id"]: r for r in matroska.add_media(odd).collect()}
    assert got[1]["payload_sha256"] == got[2]["payload_sha256"] and got[1]["n_bytes"] == 0 and got[1]["payload_bytes"] == 192
    assert got[4]["tail_crc32"] == zlib.crc32(b" " * 16) and "score" in got[4]
    assert matroska.add_media(empty).count() == 0


def test_media_query_against_plain_python(spark):
    """Every column but feature recomputed from the text; the packets of the stored files cover the padded payload."""
    from terraloom.llm import queries

    sf = "/root/testdata/sf0.001"
    texts = {r["doc_id"]: (r["text"] or "").encode() for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    out = queries.op2_matroska(spark, sf)
    assert out.columns[:8] == ["doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"]
    got = {r["doc_id"]: r for r in out.collect()}
    assert set(got) == set(texts)
    for i, raw in texts.items():
        want = raw + b" " * (max(192, -(-len(raw) // 192) * 192) - len(raw))
        r = got[i]
        assert (r["n_bytes"], r["payload_bytes"], r["payload_sha256"], r["tail_crc32"]) == (len(raw), len(want), hashlib.sha256(want).hexdigest(), zlib.crc32(want[-16:]))
        assert f"packets={len(want) // 192};" in r["feature"] and r["media_bytes"] > len(want)
    files = matroska.store_media(spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text"))
    table = matroska.packet_table(files).groupBy("doc_id").agg(F.count("*").alias("n"), F.sum("length").alias("b"), F.max("timestamp").alias("t")).collect()
    assert all(r["b"] == got[r["doc_id"]]["payload_bytes"] and r["t"] == 24 * (r["n"] - 1) for r in table)


# 3
def brute_targets(sizes, weights):
    total, open_, out = sum(sizes), set(range(len(sizes))), {}
    while True:
        w = sum(weights[i] for i in open_)
        share = {i: (total - sum(out.values())) * weights[i] / w for i in open_}
        over = [i for i in open_ if share[i] > 3 * sizes[i]]
        if not over:
            return [out.get(i, share.get(i)) for i in range(len(sizes))]
        for i in over:
            out[i] = 3.0 * sizes[i]
            open_.discard(i)


def test_mixing_targets(spark):
    sizes = [1000, 10, 900, 5, 2000, 40, 0]
    rows = spark.createDataFrame([(chr(97 + i) if i < 6 else None, n) for i, n in enumerate(sizes)], "source string, size long")
    got = {r["source"]: r["target"] for r in mixing.targets(rows).collect()}
    want = brute_targets(sizes, [1, 2, 3, 1, 2, 3, 1])
    for i, t in enumerate(want):
        assert got[chr(97 + i) if i < 6 else None] == pytest.approx(t)


def test_mix_comes_near_and_agrees(spark, odd, empty):
    rng = np.random.default_rng(3)
    rows = [(i, " ".join(["w"] * int(rng.integers(0, 60))), f"s{i % 5}" if i % 5 else None, 0.0) for i in range(800)]
    d = spark.createDataFrame(rows, DOCS)
    got = mixing.mix(d).toPandas()
    again = mixing.mix(d.repartition(7), slim=True).toPandas()
    assert len(got) == 800 and got["size"].tolist() == [len(t.split()) for t in got["text"]]
    per = got.groupby("source", dropna=False).agg(target=("target", "first"), taken=("taken", "sum"))
    assert ((per["taken"] - per["target"]).abs() <= 2).all() and (got["taken"] <= 3 * got["size"]).all()
    assert got.sort_values("doc_id")["taken"].tolist() == again.sort_values("doc_id")["taken"].tolist()
    assert mixing.mix(odd).count() == len(ODD) and mixing.mix(empty).count() == 0
    assert mixing.mixed_rows(d).columns == d.columns


def test_mix_fills_the_gap_before_a_long_document(spark):
    """All later ranks that fit are taken, far more than FILL, when a long document doesn't fit."""
    rng = np.random.default_rng(4)
    sizes = {i: int(rng.integers(3, 8)) for i in range(1, 601)} | {0: 2000}
    total = sum(sizes.values()) // 2 * 2
    sizes[600] -= sum(sizes.values()) - total
    left = total // 2  # the other source holds as much again as half of this one, so half of each is left to draw

    def order(seed):
        return sorted(sizes, key=lambda i: int(hashlib.md5(f"{seed}{i}".encode()).hexdigest()[:13], 16))

    def greedy(seed):
        gap, took, at_long = left, set(), None
        for i in order(seed):
            if sizes[i] <= gap:
                gap, took = gap - sizes[i], took | {i}
            elif i == 0:
                at_long = gap
        return took, gap, at_long

    seed = next(s for s in (f"mix{k}" for k in range(1000)) if (greedy(s)[2] or 0) > 1000)
    took, gap, _ = greedy(seed)
    rows = [(i, " ".join(["w"] * n), "a") for i, n in sizes.items()] + [(9999, " ".join(["w"] * left), "b")]
    got = mixing.mix(spark.createDataFrame(rows, "doc_id long, text string, source string"), seed=seed, slim=True).where("source = 'a'").toPandas()
    assert got["target"].iloc[0] == pytest.approx(left)
    drawn = set(got[got["copies"] > 0]["doc_id"])
    assert took <= drawn and len(drawn - took) <= 1
    assert abs(got["taken"].sum() - left) <= gap


def test_mix_by_unequal_odds(spark):
    """Expected copies follow the odds up to the limit; certain copies are whole; words come near the target."""
    rng = np.random.default_rng(8)
    rows = [(i, " ".join(["w"] * int(rng.integers(1, 30))), "abc"[i % 3], float((1, 2, 8)[i % 7 % 3])) for i in range(1500)]
    got = mixing.mix(spark.createDataFrame(rows, DOCS), odds="score").toPandas()
    for _, g in got.groupby("source"):
        target = g["target"].iloc[0]
        lo, hi = 0.0, 1e6
        for _ in range(200):  # the factor by bisection
            mid = (lo + hi) / 2
            lo, hi = (mid, hi) if (np.minimum(3, mid * g["score"]) * g["size"]).sum() < target else (lo, mid)
        want = np.minimum(3, hi * g["score"])
        assert (g["copies"] >= np.floor(want - 1e-6)).all() and (g["copies"] <= np.ceil(want + 1e-6)).all()
        assert abs(g["taken"].sum() - target) <= 2
        for w in (1.0, 2.0, 8.0):
            mine = g["score"] == w
            assert g[mine]["copies"].mean() == pytest.approx(want[mine].mean(), abs=0.12)
    assert got[got["score"] == 8]["copies"].min() >= 1


def test_mix_of_repeated_rows(spark):
    """Rows alike are drawn together, and the target is met as nearly as they allow."""
    rows = [(i, " ".join(["w"] * (5 + i % 9)), "ab"[i % 2], 0.0) for i in range(80) for _ in range(10)]
    got = mixing.mix(spark.createDataFrame(rows, DOCS)).toPandas()
    assert (got.groupby("doc_id")["copies"].nunique() == 1).all()
    for _, g in got.groupby("source"):
        assert abs(g["taken"].sum() - g["target"].iloc[0]) <= 10 * 13 / 2 + 1


# 4
def brute_components(texts):
    sets, root = {i: shingles(t) for i, t in texts}, {i: i for i, _ in texts}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for a, b in itertools.combinations(sorted(sets), 2):
        if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b]):
            x, y = find(a), find(b)
            root[max(x, y)] = min(x, y)
    return {i: find(i) for i in sets}, sets


@pytest.mark.parametrize("pivots", [1, 8])
def test_jaccard_join(spark, odd, pivots, monkeypatch):
    monkeypatch.setattr(nearjoin, "PIVOTS", pivots)
    rng = np.random.default_rng(5)
    words = [f"t{i}" for i in range(400)]
    seeds = [list(rng.choice(words, 60)) for _ in range(6)]
    rows = list(ODD)
    for i in range(120):
        w = list(seeds[i % 6])
        for _ in range(int(rng.integers(0, 5))):
            w[int(rng.integers(0, 60))] = f"own{rng.integers(0, 9)}"
        rows.append((100 + i, " ".join(w), "a", 0.0))
    got = {r["doc_id"]: r for r in nearjoin.join(spark.createDataFrame(rows, DOCS)).collect()}
    want, sets = brute_components([r[:2] for r in rows])
    for i, c in want.items():
        assert (got[i]["component_id"], got[i]["n_shingles"]) == (c, len(sets[i])), i


def test_regions_bridged_by_one_link_are_one_component(spark):
    """Two groups, each closed around its pivot, whose only link runs between their boundaries."""
    size = 70

    def swapped(k: int, own: int) -> str:
        """The first k words of the template swapped, and, if not 0, the last one."""
        w = [f"u{i}" if i < k else f"t{i}" for i in range(size)]
        return " ".join([*w[:-1], f"own{own}"] if own else w)

    # Pivots 0 and 100, 17 swaps apart; y1 = 50 and y2 = 150 are 6 swaps from their pivot, 5 from each other.
    texts = {0: swapped(0, 0), 50: swapped(6, 0), 100: swapped(17, 0), 150: swapped(11, 0)}
    texts |= {k: swapped(0, k) for k in range(1, 31)} | {k: swapped(17, k) for k in range(101, 131)}
    sets = {k: set(t.split()) for k, t in texts.items()}
    linked = [(a, b) for a, b in itertools.combinations(sorted(sets), 2) if 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b])]
    assert {(a, b) for a, b in linked if a < 100 <= b} == {(50, 150)}
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    cut = spark.createDataFrame([(1, k, size, 0) for k in texts], "cell long, id long, n long, at long")
    parts = {r["id"]: r["component"] for r in nearjoin.components(nearjoin.links(docs, cut, words=1)).collect()}
    assert parts == dict.fromkeys(texts, 0)


@pytest.mark.parametrize(("large", "levels"), [(4, 0), (4, 1), (4, 3), (256, 1)])
def test_links_of_crowded_cells(spark, large, levels, monkeypatch):
    """Cells split into regions, or left whole and compared by blocks, connect what is linked; a core's pairs aren't expanded."""
    monkeypatch.setattr(nearjoin, "DIRECT", large)
    monkeypatch.setattr(nearjoin, "LEVELS", levels)
    rng = np.random.default_rng(11)
    texts = {}
    for k in range(150):  # from copies close to a template to such as are linked with little or nothing
        w = [f"t{i}" for i in range(60)]
        for i in rng.choice(60, int(rng.integers(0, 5 if k < 110 else 14)), replace=False):
            w[i] = f"own{k}_{i}" if k % 3 else f"own{i}"
        texts[k] = " ".join(w)
    want, sets = brute_components(list(texts.items()))
    assert len(set(want.values())) > 5
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    total = sum(map(len, sets.values()))
    cut = nearjoin.merged(nearjoin.cells(docs, total))
    trace = []
    parts = {r["id"]: r["component"] for r in nearjoin.components(nearjoin.links(docs, cut, trace=trace)).collect()}
    assert {i: parts.get(i, i) for i in texts} == want
    if large > len(texts):
        assert sum(t["pairs"] for t in trace) < len(texts) * 30 / 2  # of 11175


def test_sketch_bounds_the_difference():
    rng = np.random.default_rng(3)
    for n in (1, 40, 3000):
        a, b = (np.unique(np.concatenate([rng.integers(0, 1 << 62, k, dtype=np.uint64), np.arange(n, dtype=np.uint64)])) for k in (5, 90))
        bits = sum(int(x).bit_count() for x in (nearjoin.sketch(a) ^ nearjoin.sketch(b)).view(np.uint64))
        assert bits <= len(np.setxor1d(a, b))


def test_jaccard_join_of_nothing(empty):
    assert nearjoin.join(empty).count() == 0


# 5
def test_shards_round_trip_and_random_access():
    rng = np.random.default_rng(0)
    for n in (1, 3, 40_000):
        parts = [np.append(rng.zipf(1.4, min(n, 700)) % 49_000 + 2, 1).astype(np.uint32) for _ in range(max(1, n // 700))]
        s = repair.Shard(repair.to_blob([None, *range(1, len(parts))], parts, 1))
        ids = np.concatenate(parts)
        assert (s.all() == ids).all() and all((s.doc(i) == p).all() for i, p in enumerate(parts)) and s.doc_ids[0] is None
        for lo, hi in ((0, 1), (len(ids) // 3, len(ids) // 2 + 1), (0, len(ids))):
            assert (s.slice(lo, hi) == ids[lo:hi]).all()
    assert s.seq.size < len(ids)
    with pytest.raises(ValueError):
        repair.Shard(b"x" * 64)


def test_encoder_agrees_with_the_library():
    rng = np.random.default_rng(2)
    texts = ["".join(rng.choice(list("aB1 \n\té,ß.!%*|'"), rng.integers(0, 30))) for _ in range(1500)] + [t for _, t, *_ in ODD if t]
    for name in ("word_bpe_49k.json", "byte_bpe_50k.json"):
        e = tokens.Encoder.of(tokens.vocabulary_path(name))
        whole = [np.array(x.ids, "<u4").tobytes() for x in e.tokenizer.encode_batch(texts, add_special_tokens=False)]
        assert e.ids(texts) == whole


def test_words_of_the_last_batch_stay_known():
    e = tokens.Encoder(tokens.vocabulary_path("word_bpe_49k.json"))
    library, given, e.most = e.tokenizer, [], 2

    class Counted:
        def encode_batch_fast(self, texts, **more):
            given.extend(texts)
            return library.encode_batch_fast(texts, **more)

    e.tokenizer, texts = Counted(), ["one two, three", "two three? 4", "", None]
    first = e.ids(texts)
    given.clear()
    assert e.ids(texts) == first and not given


def test_memory_of_a_packing_worker():
    """Of new words alone, of which nothing is found again."""
    code = """
import resource, sys
import numpy as np, pyarrow as pa
from terraloom.llm import packing, tokens

class Docs:
    sparkSession = type("S", (), {"conf": type("C", (), {"get": lambda *a: "1000"})()})
    select = lambda self, *names: self
    mapInArrow = lambda self, run, schema: run

run = packing.pieces(Docs(), path := tokens.vocabulary_path("byte_bpe_50k.json"), with_ids=False)
tokens.Encoder.of(path)
rng = np.random.default_rng(0)
texts = [" ".join(bytes(w).decode() for w in rng.integers(97, 123, (400, 7), np.uint8)) for _ in range(3000)]
batches = [pa.RecordBatch.from_arrays([pa.array(range(1000)), pa.array(texts[k : k + 1000])], names=["doc_id", "text"]) for k in (0, 1000, 2000)]
before = resource.getrusage(resource.RUSAGE_SELF).ru_maxrss
assert sum(b.num_rows for b in run(iter(batches))) >= 3000
print("MB", (resource.getrusage(resource.RUSAGE_SELF).ru_maxrss - before) / 1024)
"""
    said = subprocess.run([sys.executable, "-c", code], cwd=os.path.dirname(packing.__file__) + "/../..", capture_output=True, text=True, timeout=300)
    assert said.returncode == 0, said.stderr
    assert float(said.stdout.split()[-1]) < 200, said.stdout  # 411 with a table of Python's and batches of 1,000 texts


def test_shard_files(odd, empty):
    path = tokens.vocabulary_path("word_bpe_49k.json")
    got = sorted(repair.read_docs(repair.write_shards(odd, path, shard=500), with_ids=True).collect(), key=lambda r: r["start"])
    assert [r["doc_id"] for r in got] == sorted(r[0] for r in ODD)
    e, at = tokens.Encoder.of(path), 0
    for r, t in zip(got, sorted(ODD, key=lambda r: r[0])):
        ids = e.ids([t[1]])[0] + np.array([1], "<u4").tobytes()
        assert (r["start"], r["n_tokens"], r["ids_crc32"]) == (at, len(ids) // 4, zlib.crc32(ids)) and bytes(r["ids"]) == ids
        at += len(ids) // 4
    assert repair.read_docs(repair.write_shards(empty, path)).count() == 0


# 6
def test_hilbert_keys_are_a_walk():
    for d, b in ((2, 3), (3, 2)):
        pts = np.array(list(itertools.product(range(1 << b), repeat=d)))
        order = pts[np.argsort(hilbert.hilbert_key(pts, b))]
        assert (np.abs(np.diff(order, axis=0)).sum(1) == 1).all()


def test_neighbours(spark):
    rng = np.random.default_rng(1)
    x = rng.normal(size=(3000, 16))
    x[100:700] = x[7]  # a vector that fills a fifth of the table
    rows = [(i, v.tolist(), i % 3) for i, v in enumerate(x)] + [(5001, None, 0), (5002, [0.0] * 16, 0), (5003, [float("nan")] * 16, 0), (5020, [1.0, None] * 8, 0), (None, [1.0] * 16, 0)]
    v = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")
    got = hilbert.search(v).toPandas()
    hit = 0
    for i in range(0, 3000, 20):
        s = x @ x[i]
        s[i] = -np.inf
        want = np.lexsort((np.arange(3000), -s.round(9)))[:20]
        mine = got[got.query_id == i].sort_values("rank")
        assert mine["rank"].tolist() == list(range(1, 21)) and i not in mine["vec_id"].tolist()
        hit += len(set(want) & set(mine["vec_id"]))
    assert hit / 3000 >= 0.9 and set(got["query_id"]) == set(range(0, 3000, 20))
    assert hilbert.search(v.where("vec_id < 5")).count() == 4 and hilbert.search(v.where("vec_id > 9000")).count() == 0


def test_windows_beat_chance(spark):
    """Far fewer pairs than all, and far better than windows of the same size over random orders would find."""
    rng = np.random.default_rng(2)
    n = 6000
    x = rng.normal(size=(n, 32))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    got = hilbert.search(spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")).toPandas()
    hit = 0
    for i in range(0, n, 20):
        s = x @ x[i]
        s[i] = -np.inf
        hit += len(set(np.argsort(-s)[:20]) & set(got[got.query_id == i]["vec_id"]))
    shown = hilbert.CURVES * hilbert.window_rows(n) / n
    assert shown < 1 and hit / n >= 0.93 > 1 - np.exp(-shown) + 0.2


# 7
PAGE = """<html><head><title>t</title><script>var a="<p>no</p>"</script></head><body><div class="menu"><a href=/>Home</a></div><header>Site</header>
<div><p>Site of %d hosts</p><h1>Story &amp; %d</h1><p>First  line<br>goes <b>on %d<p>Second&nbsp;line %d</div>
<div id="comments"><p>I disagree</p></div><form><p>Name</p></form><div class="cookie-notice">ok?</div><footer>&copy; us</footer>"""


def test_template_extraction(spark, empty):
    rows = [(i, f"http://a.example/{i}", PAGE % (5, i, i, i)) for i in range(6)] + [(7, "http://b.example/", "<article><p>Only</p></article><p>Aside</p>"), (8, None, None), (9, "x", "")]
    got = {r["page_id"]: r["text"] for r in template.main_texts(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    for i in range(6):
        assert got[i] == f"Story & {i}\n\nFirst line goes on {i}\n\nSecond line {i}"
    assert (got[7], got[8], got[9]) == ("Only", "", "")
    none = spark.createDataFrame([], "page_id long, url string, html string")
    assert template.main_texts(none).count() == 0


def brute_main(page, boilerplate):
    """Of pages as written below: the article's blocks, but for what the host repeats and reader comments."""
    inner = re.search(r"<(article|div class=.body.)>(.*?)</(article|div)>", page, re.S)[2]
    inner = re.sub(r"<section class=.comments.>.*?</section>", "", inner, flags=re.S)
    blocks = [" ".join(re.sub(r"<[^>]*>", "", b.replace("<br>", " ")).split()) for b in re.split(r"</?(?:p|h1|h2)[^>]*>", inner)]
    return "\n\n".join(b.replace("&amp;", "&") for b in blocks if b and b not in boilerplate)


def test_template_decides(spark):
    """Pages shaped like real ones: the template, and not tag names, finds the content of a host whose articles are plain divs."""
    again = "Share this story with your friends today"
    made = []
    for h in range(3):
        box = "article" if h == 0 else "div class='body'"
        for i in range(8):
            paragraphs = "".join(f"<p>Paragraph {k} of page {i} on host {h} &amp; <b>some</b><br>more words {i * k}</p>" for k in range(3 + i % 3))
            notes = "<section class='comments'><p>I disagree with number %d</p></section>" % i if i % 4 == 0 else ""
            html = f"<html><head><title>x</title></head><body><nav><a href=/>Home</a></nav><div class='x7'>Buy now {i}</div><{box}><h1>Title {i} of {h}</h1>{paragraphs}<p>{again}</p>{notes}</{box.split()[0]}><footer>c</footer></body></html>"
            made.append((len(made), f"http://h{h}.example/{i}", html))
    got = {r["page_id"]: r["text"] for r in template.main_texts(spark.createDataFrame(made, "page_id long, url string, html string")).collect()}
    for k, _, html in made:
        assert got[k] == brute_main(html, {again})
        assert template.extract(html) != got[k] and again in template.extract(html)  # without the host's template


def test_template_on_odd_markup():
    assert template.extract("<p title=it's>Hello</p><p>World</p>") == "Hello\n\nWorld"
    assert template.extract("<div class='article social-news'><h1>T</h1><p>Body</p></div>") == "T\n\nBody"
    assert template.extract("<article><h2 class='header'>H</h2><p class='notice'>N</p></article>") == "H\n\nN"
    assert template.extract("<article>Teaser</article><div><h1>Title</h1><p>%s</p></div>" % ("body " * 30)).startswith("Title\n\nbody")
    began = time.time()
    template.extract('<a title="' * 20_000)
    template.extract("<div>" * 20_000 + "</x>" * 20_000)
    assert time.time() - began < 2


# 8
def brute_lines(rows):
    lines = [((i, k), frozenset(x for x in re.split(r"[ \t\r\x0b\x0c]", line.lower()) if x)) for i, t in rows if t is not None for k, line in enumerate(t.split("\n"))]
    gone = set()
    for a, (pa, sa) in enumerate(lines):
        for pb, sb in lines:
            if sa and sb and pb < pa and len(sa & sb) * 18 >= (len(sa) + len(sb)) * 8:
                gone.add(pa)
                break
    return gone


def test_line_dedup(spark, odd, empty):
    rng = np.random.default_rng(8)
    words = [f"k{i}" for i in range(60)]
    rows = []
    for i in range(60):
        lines = [" ".join(rng.choice(words, rng.integers(1, 12))) for _ in range(4)] + [near(i), "Common footer", ""]
        rows.append((i, "\n".join(lines)))
    d = spark.createDataFrame([(*r, "a", 0.0) for r in rows], DOCS)
    got = {(r["doc_id"], k) for r in linededup.report(d).collect() for k in r["removed_lines"]}
    assert got == brute_lines(rows)
    kept = {r["doc_id"]: r["text"] for r in linededup.dedup_lines(d).collect()}
    for i, t in kept.items():
        assert t == "\n".join(x for k, x in enumerate(rows[i][1].split("\n")) if (i, k) not in got)
    assert linededup.dedup_lines(odd).where("doc_id IN (1, 2, 3)").count() == 3 and linededup.dedup_lines(empty).count() == 0
    plan = linededup.report(d)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan


def test_short_lines_match_one_word_longer_ones(spark):
    """Four words of five are 8/10; three of four aren't."""
    d = spark.createDataFrame([(1, "a b c d e\nx y z q"), (2, "d c b a\nz y x"), (3, "a b c d e f")], "doc_id long, text string")
    got = {r["doc_id"]: r["removed_lines"] for r in linededup.report(d).collect()}
    assert got == {1: [], 2: [0], 3: [0]}


def test_lines_of_a_crowd_are_not_expanded(spark, monkeypatch):
    """Variants of one line, most linked with many but not with the earliest: brute force's result, without a row per pair."""
    rng = np.random.default_rng(2)
    lines = []
    for k in range(260):
        w = [f"w{i}" for i in range(30)]
        for i in rng.choice(30, 3, replace=False):
            w[i] = f"w{i}x{rng.integers(0, 3)}"
        lines.append(" ".join(w))
    rows = [(k, line, "a", 0.0) for k, line in enumerate(lines)]
    sets = [set(x.split()) for x in lines]
    match = lambda a, b: 10 * len(a & b) >= 8 * len(a | b)
    want = {k for k in range(len(sets)) if any(match(sets[k], sets[j]) for j in range(k))}
    stored, keep = {}, linededup.store
    monkeypatch.setattr(linededup, "store", lambda df, label, *a: stored.setdefault(label, []).append(keep(df, label, *a)) or stored[label][-1])
    got = {r["doc_id"] for r in linededup.report(spark.createDataFrame(rows, DOCS)).collect() if r["removed_lines"]}
    assert got == want and 0 < len(want) < len(sets)
    assert sum(t.count() for t in stored["line-pairs"]) <= 4 * len(sets)  # a pair per shown code, at most

def test_line_dedup_deals_shown_codes_once(spark, monkeypatch):
    """Both sides of the join of all shown codes are one exchange, and no plan or its text holds a large constant."""
    rng = np.random.default_rng(4)
    rows = [(i, "\n".join(" ".join(rng.choice([f"k{j}" for j in range(80)], 9)) for _ in range(3)) + "\n" + near(i)) for i in range(60)]
    plans, keep = [], linededup.store

    def stored(df, label, *a):
        plans.append((label, df._jdf.queryExecution().executedPlan().toString()))
        return keep(df, label, *a)

    monkeypatch.setattr(linededup, "store", stored)
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        got = {(r["doc_id"], k) for r in linededup.report(spark.createDataFrame([(*r, "a", 0.0) for r in rows], DOCS)).collect() for k in r["removed_lines"]}
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
        spark.conf.unset("spark.sql.adaptive.enabled")
    assert got == brute_lines(rows)
    assert len(plans) <= 14 and sum(len(p) for _, p in plans) < 2_000_000
    passes = [p for label, p in plans if label == "line-met"]
    assert passes and all("ReusedExchange" in p for p in passes)



def test_lines_of_a_middle_length_are_told_apart_where_they_meet(spark, monkeypatch):
    """Unrelated lines just under and over ``WIDE`` words that show common codes: none is looked up again but those of a match."""
    rng = np.random.default_rng(7)
    words = [f"v{i}" for i in range(900)]
    rows = [(i, " ".join(rng.choice(words, linededup.WIDE + (-5 if i % 2 else 5), replace=False))) for i in range(40)]
    rows += [(40, rows[0][1] + " one more"), (41, " ".join(rows[1][1].split()[4:])), (42, "\n".join([rows[2][1] + " x", "short one here now"])), (43, "here now short one too")]
    stored, keep = {}, linededup.store
    monkeypatch.setattr(linededup, "store", lambda df, label, *a: stored.setdefault(label, []).append(keep(df, label, *a)) or stored[label][-1])
    got = {(r["doc_id"], k) for r in linededup.report(spark.createDataFrame([(*r, "a", 0.0) for r in rows], DOCS)).collect() for k in r["removed_lines"]}
    assert got == brute_lines(rows) == {(40, 0), (41, 0), (42, 0), (43, 0)}
    assert stored["line-ends"][0].count() == 8  # two of each match


def test_repeated_rows_and_null_ids_keep_their_places(spark):
    """Rows given twice, two texts of one doc_id and documents without one: matches are found by the places of their sets."""
    line = "a b c d e f g h i j"
    rows = [(None, line), (1, line + " k"), (1, line + " k"), (2, "x1 x2 x3 x4 x5 x6 x7 x8"), (2, "y\nx1 x2 x3 x4 x5 x6 x7"), (3, "b c d e f g h i j k")]
    got = sorted((r["doc_id"] or 0, r["n_lines"], *r["removed_lines"]) for r in linededup.report(spark.createDataFrame(rows, "doc_id long, text string")).collect())
    assert got == [(0, 1), (1, 1, 0), (1, 1, 0), (2, 1), (2, 2, 1), (3, 1, 0)]


# 9
def test_fixity_audit(spark):
    rows = [(i, f"u{i}", f"page {i} " * (i % 7)) for i in range(300)] + [(None, None, None), (5, "u5", "again")]
    a = spark.createDataFrame(rows, "page_id long, url string, html string")
    b = a.withColumn("html", F.when(F.col("page_id").isin(17, 200), F.concat(F.lit("#"), F.substring("html", 2, 999))).otherwise(F.col("html")))
    got = warc.audit_pages(a, b, records=40)
    assert {r["page_id"] for r in got.where("damaged").collect()} == {17, 200} and got.count() == len(rows)
    assert warc.audit_pages(a, a, records=40).where("damaged").count() == 0
    # A record that is lost, or added, is one damaged record, whichever side it is on.
    fewer = a.where(~F.coalesce(F.col("page_id").isin(17, 120), F.lit(False)))
    for x, y, null in ((a, fewer, "their_digest"), (fewer, a, "digest")):
        bad = warc.audit_pages(x, y, records=40).where("damaged").collect()
        assert {r["page_id"] for r in bad} == {17, 120} and len(bad) == 2 and all(r[null] is None for r in bad)
    twice = a.union(a.where("page_id = 9"))
    assert [r["page_id"] for r in warc.audit_pages(a, twice, records=40).where("damaged").collect()] == [9]
    none = spark.createDataFrame([], "page_id long, url string, html string")
    assert warc.audit_pages(none, none).count() == 0 and warc.audit_pages(none, a).where("damaged").count() == len(rows)
    one = got.where("page_id = 3").first()
    raw = b"WARC/1.1\r\nWARC-Type: response\r\nWARC-Record-ID: <urn:page:3>\r\nWARC-Target-URI: u3\r\nContent-Type: text/html\r\nContent-Length: 21\r\n\r\n" + b"page 3 " * 3 + b"\r\n\r\n"
    import hashlib

    assert one["digest"] == hashlib.sha256(raw).hexdigest() and one["length"] == len(raw)


# 10
def best(items, capacity):
    """The fewest bins, by search."""
    items, most = sorted(items, reverse=True), [len(items)]

    def go(k, bins):
        if len(bins) >= most[0]:
            return
        if k == len(items):
            most[0] = len(bins)
            return
        for i in {b: i for i, b in enumerate(bins) if b + items[k] <= capacity}.values():
            bins[i] += items[k]
            go(k + 1, bins)
            bins[i] -= items[k]
        go(k + 1, [*bins, items[k]])

    go(0, [])
    return most[0]


def test_reduction_keeps_the_optimum():
    rng = np.random.default_rng(4)
    for _ in range(150):
        capacity = int(rng.integers(6, 30))
        items = rng.integers(1, capacity + 1, int(rng.integers(1, 9)))
        counts = np.bincount(items, minlength=capacity + 1)
        fixed = packing.reduce(counts, capacity)
        rest = np.repeat(np.arange(capacity + 1), counts).tolist()
        assert all(sum(m) <= capacity for m, _ in fixed)
        assert sum(n for _, n in fixed) + (best(rest, capacity) if rest else 0) == best(items.tolist(), capacity)


def test_plan_places_everything_gapless():
    rng = np.random.default_rng(6)
    for _ in range(60):
        capacity = int(rng.integers(4, 50))
        items = rng.integers(1, capacity + 1, int(rng.integers(1, 90)))
        segments, bins = packing.plan(np.bincount(items, minlength=capacity + 1), capacity)
        fill, seen = np.zeros((bins, capacity), int), set()
        for length, rank, n, first, offset in segments:
            for k in range(n):
                seen.add((length, rank + k))
                fill[first + k, offset : offset + length] += 1
        assert len(seen) == len(items) and fill.max() <= 1 and fill.sum() == items.sum()
        assert all((np.diff(f) <= 0).all() for f in fill) and bins <= math.ceil(1.5 * items.sum() / capacity) + 1


def test_packing(odd, empty):
    path = tokens.vocabulary_path("byte_bpe_50k.json")
    got = packing.pack(odd, path, capacity=1024).toPandas()
    n = {i: len(tokens.Encoder.of(path).ids([t])[0]) // 4 + 1 for i, t, *_ in ODD}
    assert got[got.doc_id != 9].groupby("doc_id")["length"].sum().to_dict() == {i: v for i, v in n.items() if i != 9}
    assert got[got.doc_id == 9]["length"].sum() == 2 * n[9] and (got[(got.doc_id == 9) & (got.piece > 0)]["length"] == 1024).all()
    for _, s in got.sort_values("offset").groupby("sequence_id"):
        assert s["offset"].tolist() == [0, *s["length"].cumsum().tolist()[:-1]] and s["length"].sum() <= 1024
    once = odd.where("doc_id <> 9")
    made = packing.sequences(once, packing.pack(once, path), path).collect()
    assert sum(len(r["ids"]) // 4 for r in made) == sum(v for i, v in n.items() if i != 9)
    assert packing.pack(empty, path).count() == 0


def test_pipeline_stages(spark):
    """Each stage against plain Python on its own input: what it keeps, drops, repeats and packs."""
    import corpus_pipeline
    from terraloom.llm.common import store

    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    odd = spark.createDataFrame([(9001, None, "en", None, None), (9002, "", "en", "web", 0), (9003, "same words here", "en", "web", 15), (9003, "same words here", "en", "web", 15), (None, "no id at all", "de", "web", 12)], docs.schema)
    docs, names, seen = store(docs.union(odd), "test-docs"), docs.columns, []
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        out = store(stage(spark, docs, sf), "test-stage")
        if k < 4:
            assert out.columns == names
        seen.append(([tuple(r) for r in docs.collect()], [tuple(r) if k < 4 else r for r in out.collect()]))
        docs = out
    (before, kept), (_, lined), (_, alone), (_, mixed), (_, packed) = seen
    labels = {r["doc_id"]: r["toxic"] for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    lost = [r for r in before if r not in kept]
    assert set(kept) <= set(before) and all(labels.get(r[0], 1) for r in lost)
    # Lines: what is left is what brute force leaves; rows alike are the same lines.
    gone = brute_lines(sorted({(r[0], r[1]) for r in kept if r[0] is not None}, key=lambda r: r[0]) + [(10**9, r[1]) for r in kept if r[0] is None])
    for r in kept:
        if r[0] is None or r[1] is None:
            continue
        cut = [line for i, line in enumerate(r[1].split("\n")) if (r[0], i) not in gone]
        if len(cut) == len(r[1].split("\n")):
            assert r in lined
        elif any(line.strip(" ") for line in cut):
            assert any(x[0] == r[0] and x[1] == "\n".join(cut) and x[4] == len(x[1]) for x in lined)
        else:
            assert all(x[0] != r[0] for x in lined)
    want, _ = brute_components([(r[0], r[1]) for r in lined if r[0] is not None])
    assert {r[0] for r in alone} - {None} == {i for i in want if want[i] == i}
    assert len([r for r in alone if r[0] == 9003]) == 1
    copies = Counter(mixed)
    assert set(copies) <= set(alone) and max(copies.values()) <= 3
    assert Counter(r["doc_id"] for r in packed if r["piece"] == 0) == Counter(r[0] for r in mixed)
    full = Counter()
    for r in packed:
        full[r["sequence_id"]] += r["length"]
    assert max(full.values()) <= 1024
    none = spark.createDataFrame([], spark.read.parquet(f"{sf}/documents.parquet").schema)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, none, sf).count() == 0
