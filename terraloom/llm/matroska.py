"""Media columns: Matroska files written and parsed element by element.

``encode`` stores a payload as 8-bit PCM samples in a Matroska file: EBML
header, Segment with Info, Tracks, Clusters of laced SimpleBlocks and Cues.
``packets`` parses any such file (known and unknown sizes, SimpleBlock and
BlockGroup, no, Xiph, fixed-size and EBML lacing) into a packet table with
track, timestamp and byte range. ``store_media`` writes the files of a text
column as a media column of a stored table, ``packet_table`` gives a row per
packet of it, and ``read_media`` what reading the stored bytes back shows.

A worker holds a batch of at most ``ARROW_ROWS`` rows and the files of one
batch; of a file's size there is no bound but Spark's own on a row.

Defined results: a null text counts as empty and gives one frame of padding;
equal texts give equal files; rows are independent, so ties, repeated rows,
empty tables and extra columns need no rule (extra columns pass through
unless they carry an output name, in which case the output replaces them).
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, types as T

from terraloom.llm.common import store, tune

FRAME = 192  #: samples in a frame: 24 ms at 8 kHz
RATE = 8000
FRAME_MS = FRAME * 1000 // RATE
BLOCK_FRAMES = 8  #: frames laced into a block
CLUSTER_BLOCKS = 16
LACINGS = ("none", "xiph", "fixed", "ebml")

# Element ids of the Matroska specification.
EBML, SEGMENT, INFO, TRACKS, CLUSTER, CUES = 0x1A45DFA3, 0x18538067, 0x1549A966, 0x1654AE6B, 0x1F43B675, 0x1C53BB6B
EBML_VERSION, EBML_READ_VERSION, EBML_MAX_ID, EBML_MAX_SIZE = 0x4286, 0x42F7, 0x42F2, 0x42F3
DOC_TYPE, DOC_VERSION, DOC_READ_VERSION = 0x4282, 0x4287, 0x4285
TIMESTAMP_SCALE, DURATION, MUXING_APP, WRITING_APP = 0x2AD7B1, 0x4489, 0x4D80, 0x5741
TRACK_ENTRY, TRACK_NUMBER, TRACK_UID, TRACK_TYPE, CODEC_ID, DEFAULT_DURATION, FLAG_LACING = 0xAE, 0xD7, 0x73C5, 0x83, 0x86, 0x23E383, 0x9C
AUDIO, SAMPLING, CHANNELS, BIT_DEPTH = 0xE1, 0xB5, 0x9F, 0x6264
CLUSTER_TIME, SIMPLE_BLOCK, BLOCK_GROUP, BLOCK = 0xE7, 0xA3, 0xA0, 0xA1
CUE_POINT, CUE_TIME, CUE_POSITIONS, CUE_TRACK, CUE_CLUSTER = 0xBB, 0xB3, 0xB7, 0xF7, 0xF1
MASTERS = frozenset({SEGMENT, INFO, TRACKS, TRACK_ENTRY, AUDIO, CLUSTER, BLOCK_GROUP, CUES, CUE_POINT, CUE_POSITIONS})
TOP_LEVEL = frozenset({INFO, TRACKS, CLUSTER, CUES})


def size_vint(n: int, width: int = 0) -> bytes:
    """A length as a variable-length integer; all ones means unknown."""
    width = width or next(w for w in range(1, 9) if n < (1 << 7 * w) - 1)
    return (n | 1 << 7 * width).to_bytes(width, "big")


def element(ident: int, body: bytes) -> bytes:
    return ident.to_bytes((ident.bit_length() + 7) // 8, "big") + size_vint(len(body)) + body


def uint(ident: int, n: int) -> bytes:
    return element(ident, n.to_bytes(max(1, (n.bit_length() + 7) // 8), "big"))


def lace(frames: list[bytes], how: str) -> tuple[int, bytes]:
    """The lacing bits of a block's flags, and the laced body."""
    if how == "none" or len(frames) == 1:
        if len(frames) != 1:
            raise ValueError("a block without lacing holds one frame")
        return 0, frames[0]
    sizes, head = [len(f) for f in frames], bytes([len(frames) - 1])
    if how == "fixed":
        if len(set(sizes)) != 1:
            raise ValueError("fixed-size lacing needs equal frames")
        return 0x04, head + b"".join(frames)
    if how == "xiph":
        return 0x02, head + b"".join(b"\xff" * (n // 255) + bytes([n % 255]) for n in sizes[:-1]) + b"".join(frames)
    if how != "ebml":
        raise ValueError(f"unknown lacing {how!r}")
    coded = [size_vint(sizes[0])]
    for a, b in zip(sizes, sizes[1:-1]):
        d = b - a
        width = next(w for w in range(1, 9) if abs(d) < (1 << 7 * w - 1) - 1)
        coded.append(size_vint(d + (1 << 7 * width - 1) - 1, width))
    return 0x06, head + b"".join(coded) + b"".join(frames)


def block(track: int, relative: int, frames: list[bytes], how: str, simple: bool = True) -> bytes:
    bits, body = lace(frames, how)
    raw = size_vint(track) + struct.pack(">hB", relative, bits | (0x80 if simple else 0)) + body
    return element(SIMPLE_BLOCK, raw) if simple else element(BLOCK_GROUP, element(BLOCK, raw))


def pad(payload: bytes) -> bytes:
    """Spaces up to a positive multiple of a frame."""
    return payload.ljust(max(FRAME, -(-len(payload) // FRAME) * FRAME), b" ")


def encode(payload: bytes, lacing: str = "ebml") -> bytes:
    """A Matroska file whose only track holds ``payload`` (whole frames) as samples."""
    frames = [payload[i : i + FRAME] for i in range(0, len(payload), FRAME)]
    if not frames or len(payload) % FRAME:
        raise ValueError("the payload must fill whole frames")
    per = 1 if lacing == "none" else BLOCK_FRAMES
    head = element(EBML, b"".join((uint(EBML_VERSION, 1), uint(EBML_READ_VERSION, 1), uint(EBML_MAX_ID, 4), uint(EBML_MAX_SIZE, 8), element(DOC_TYPE, b"matroska"), uint(DOC_VERSION, 4), uint(DOC_READ_VERSION, 2))))
    info = element(INFO, b"".join((uint(TIMESTAMP_SCALE, 1_000_000), element(DURATION, struct.pack(">d", len(frames) * FRAME_MS)), element(MUXING_APP, b"terraloom"), element(WRITING_APP, b"terraloom"))))
    audio = element(AUDIO, element(SAMPLING, struct.pack(">d", float(RATE))) + uint(CHANNELS, 1) + uint(BIT_DEPTH, 8))
    tracks = element(TRACKS, element(TRACK_ENTRY, b"".join((uint(TRACK_NUMBER, 1), uint(TRACK_UID, 1), uint(TRACK_TYPE, 2), uint(FLAG_LACING, 1), uint(DEFAULT_DURATION, FRAME_MS * 1_000_000), element(CODEC_ID, b"A_PCM/INT/LIT"), audio))))
    body, cues, at = [info, tracks], [], len(info) + len(tracks)
    step = per * CLUSTER_BLOCKS
    for first in range(0, len(frames), step):
        time = first * FRAME_MS
        blocks = [block(1, (i - first) * FRAME_MS, frames[i : min(i + per, first + step)], lacing) for i in range(first, min(first + step, len(frames)), per)]
        cluster = element(CLUSTER, uint(CLUSTER_TIME, time) + b"".join(blocks))
        cues.append(element(CUE_POINT, uint(CUE_TIME, time) + element(CUE_POSITIONS, uint(CUE_TRACK, 1) + uint(CUE_CLUSTER, at))))
        body.append(cluster)
        at += len(cluster)
    body.append(element(CUES, b"".join(cues)))
    return head + element(SEGMENT, b"".join(body))


def read_vint(data: bytes, at: int, end: int, marker: bool = False) -> tuple[int, int]:
    """(value, next position); ``marker`` keeps the length bit, as ids do. Unknown sizes give -1."""
    if at >= end or not data[at]:
        raise ValueError(f"no variable-length integer at byte {at}")
    width = 9 - data[at].bit_length()
    if at + width > end:
        raise ValueError(f"cut integer at byte {at}")
    n = int.from_bytes(data[at : at + width], "big")
    if marker:
        return n, at + width
    n &= (1 << 7 * width) - 1
    return (-1 if n == (1 << 7 * width) - 1 else n), at + width


def elements(data: bytes, at: int, end: int, parent: int = 0):
    """(id, first byte, first body byte, end) of each element of a body."""
    while at < end:
        first = at
        ident, at = read_vint(data, at, end, marker=True)
        size, at = read_vint(data, at, end)
        if size < 0:  # an unknown size ends where a sibling of its level begins
            stop = end
            if ident == CLUSTER:
                p = at
                while p < end:
                    inner, q = read_vint(data, p, end, marker=True)
                    if inner in TOP_LEVEL:
                        stop = p
                        break
                    n, q = read_vint(data, q, end)
                    p = q + n
            yield ident, first, at, stop
            at = stop
            continue
        if at + size > end:
            raise ValueError(f"element {ident:x} at byte {first} runs past its parent")
        yield ident, first, at, at + size
        at += size


@dataclass
class Media:
    packets: list[tuple[int, int, int, int]]  #: track, timestamp in ms, first byte, length
    cues: list[tuple[int, int, int]]  #: timestamp, track, cluster position
    clusters: list[int]  #: positions in the Segment
    tracks: dict[int, dict]
    duration: float


def frames_of(data: bytes, at: int, end: int) -> tuple[int, int, list[tuple[int, int]]]:
    """Track, relative time and byte ranges of a block's frames."""
    track, at = read_vint(data, at, end)
    relative, flags = struct.unpack_from(">hB", data, at)
    at += 3
    how = flags & 0x06
    if not how:
        return track, relative, [(at, end - at)]
    count = data[at] + 1
    at += 1
    sizes: list[int] = []
    if how == 0x02:
        for _ in range(count - 1):
            n = 0
            while data[at] == 255:
                n, at = n + 255, at + 1
            sizes.append(n + data[at])
            at += 1
    elif how == 0x06 and count > 1:
        n, at = read_vint(data, at, end)
        sizes.append(n)
        for _ in range(count - 2):
            start = at
            d, at = read_vint(data, at, end)
            sizes.append(sizes[-1] + d - ((1 << 7 * (at - start) - 1) - 1))
    elif how == 0x04:
        if (end - at) % count:
            raise ValueError("fixed-size lacing doesn't divide its block")
        sizes = [(end - at) // count] * (count - 1)
    sizes.append(end - at - sum(sizes))
    if min(sizes) < 0:
        raise ValueError("laced frames run past their block")
    out = []
    for n in sizes:
        out.append((at, n))
        at += n
    return track, relative, out


def packets(data: bytes) -> Media:
    """The packet table, cues and tracks of a Matroska file."""
    media = Media([], [], [], {}, 0.0)
    number = lambda a, b: int.from_bytes(data[a:b], "big")
    scale = 1_000_000
    default: dict[int, float] = {}
    top = list(elements(data, 0, len(data)))
    if not top or top[0][0] != EBML:
        raise ValueError("no EBML header")
    for ident, _, base, stop in top:
        if ident != SEGMENT:
            continue
        for ident, first, a, b in elements(data, base, stop):
            if ident == INFO:
                for i, _, x, y in elements(data, a, b):
                    if i == TIMESTAMP_SCALE:
                        scale = number(x, y)
                    elif i == DURATION:
                        media.duration = struct.unpack(">d" if y - x == 8 else ">f", data[x:y])[0]
            elif ident == TRACKS:
                for i, _, x, y in elements(data, a, b):
                    if i == TRACK_ENTRY:
                        got = {j: data[p:q] for j, _, p, q in elements(data, x, y)}
                        n = int.from_bytes(got[TRACK_NUMBER], "big")
                        default[n] = int.from_bytes(got.get(DEFAULT_DURATION, b""), "big") / scale
                        media.tracks[n] = {"codec": got.get(CODEC_ID, b"").decode(), "type": int.from_bytes(got.get(TRACK_TYPE, b""), "big")}
            elif ident == CLUSTER:
                media.clusters.append(first - base)
                time = 0
                for i, _, x, y in elements(data, a, b):
                    if i == CLUSTER_TIME:
                        time = number(x, y)
                        continue
                    inner = [(x, y)] if i == SIMPLE_BLOCK else [(p, q) for j, _, p, q in elements(data, x, y) if j == BLOCK] if i == BLOCK_GROUP else []
                    for p, q in inner:
                        track, relative, ranges = frames_of(data, p, q)
                        for k, (start, n) in enumerate(ranges):
                            media.packets.append((track, round((time + relative + k * default.get(track, 0)) * scale / 1e6), start, n))
            elif ident == CUES:
                for i, _, x, y in elements(data, a, b):
                    if i == CUE_POINT:
                        got = {j: (p, q) for j, _, p, q in elements(data, x, y)}
                        pos = {j: number(p, q) for j, _, p, q in elements(data, *got[CUE_POSITIONS])}
                        media.cues.append((number(*got[CUE_TIME]), pos[CUE_TRACK], pos[CUE_CLUSTER]))
    return media


def feature(samples: np.ndarray, media: Media) -> str:
    """Counts, level, zero crossings and spectral centre of 8-bit samples (integers only, so alike everywhere)."""
    x = samples.astype(np.int64) - 128
    crossings = int(np.count_nonzero((x[1:] < 0) != (x[:-1] < 0)))
    level = int((x * x).sum()) * 1000 // len(x)
    change = int(np.abs(np.diff(x)).sum()) * 1000 // max(1, len(x) - 1)
    return f"packets={len(media.packets)};clusters={len(media.clusters)};cues={len(media.cues)};ms={media.packets[-1][1] + FRAME_MS};power={level};change={change};crossings={crossings};peak={int(np.abs(x).max())}"


#: What reading back gives.
FIELDS = [
    T.StructField("payload_bytes", T.LongType()), T.StructField("payload_sha256", T.StringType()), T.StructField("tail_crc32", T.LongType()),
    T.StructField("media_bytes", T.LongType()), T.StructField("media_sha256", T.StringType()), T.StructField("feature", T.StringType()),
    T.StructField("n_packets", T.LongType()), T.StructField("n_clusters", T.LongType()),
]
_ARROW = {"string": pa.string(), "bigint": pa.int64(), "int": pa.int32(), "binary": pa.binary()}


def describe(stored: bytes) -> tuple:
    """``FIELDS`` of a file, from its bytes alone."""
    media = packets(stored)
    back = b"".join(stored[a : a + n] for _, _, a, n in media.packets)
    return len(back), hashlib.sha256(back).hexdigest(), zlib.crc32(back[-16:]), len(stored), hashlib.sha256(stored).hexdigest(), feature(np.frombuffer(back, np.uint8), media), len(media.packets), len(media.clusters)


def _mapped(rows: DataFrame, source: str, fields: list[T.StructField], make, keep_source: bool = False) -> DataFrame:
    """``rows`` with ``fields``, made from one column by ``make``, in place of it (or beside it)."""
    tune(rows.sparkSession)
    names = [f.name for f in fields]
    kept = [f for f in rows.schema.fields if (keep_source or f.name != source) and f.name not in names]

    def run(batches):
        for batch in batches:
            got = [make(x) for x in batch.column(batch.schema.get_field_index(source)).to_pylist()]
            columns = list(zip(*got)) if got else [[] for _ in names]
            arrays = [batch.column(batch.schema.get_field_index(f.name)) for f in kept]
            yield pa.RecordBatch.from_arrays(arrays + [pa.array(c, _ARROW[f.dataType.simpleString()]) for c, f in zip(columns, fields)], names=[f.name for f in kept] + names)

    return rows.select(*[f.name for f in kept if f.name != source], source).mapInArrow(run, T.StructType(kept + fields))


def store_media(docs: DataFrame, text: str = "text", lacing: str = "ebml") -> DataFrame:
    """``docs`` as a stored table with n_bytes and media, the file of ``text``, in place of ``text``."""

    def make(value: str | None) -> tuple:
        raw = (value or "").encode("utf-8", "surrogatepass")
        return len(raw), encode(pad(raw), lacing)

    return store(_mapped(docs, text, [T.StructField("n_bytes", T.LongType()), T.StructField("media", T.BinaryType())], make), "media", "zstd")


def read_media(files: DataFrame, keep_media: bool = False) -> DataFrame:
    """``files`` (media) with ``FIELDS``, read back from the stored bytes."""
    return _mapped(files, "media", FIELDS, describe, keep_media)


def packet_table(files: DataFrame, key: str = "doc_id") -> DataFrame:
    """(key, packet, track, timestamp in ms, offset, length) of every packet of ``files`` (key, media)."""
    kind = files.schema[key].dataType.simpleString()

    def run(batches):
        for batch in batches:
            rows = [(k, i, *p) for k, data in enumerate(batch.column(1).to_pylist()) for i, p in enumerate(packets(data).packets)]
            who, *columns = zip(*rows) if rows else [[]] * 6
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(who, pa.int64()))] + [pa.array(c, pa.int64()) for c in columns], names=[key, "packet", "track", "timestamp", "offset", "length"])

    return files.select(key, "media").mapInArrow(run, f"{key} {kind}, packet long, track long, timestamp long, offset long, length long")


def add_media(docs: DataFrame, text: str = "text", lacing: str = "ebml", keep_media: bool = True) -> DataFrame:
    """``docs`` with the stored form of ``text`` and what reading it back gives; ``text`` itself is dropped."""
    return read_media(store_media(docs, text, lacing), keep_media)
