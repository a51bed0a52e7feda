"""Media columns: Matroska files to packet tables, and byte payloads to Matroska files.

The reader walks EBML elements of any size coding (unknown sizes included),
clusters, simple blocks and block groups with every kind of lacing, and cues. The
writer stores bytes as 8-bit PCM samples. Elements not needed for packets are
stepped over by their size. One file is one row, so files are spread like rows.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import shared_dir, text_of, text_slices

# Element ids of the container format.
EBML, DOC_TYPE, SEGMENT, INFO, SCALE, DURATION = 0x1A45DFA3, 0x4282, 0x18538067, 0x1549A966, 0x2AD7B1, 0x4489
TRACKS, TRACK, TRACK_NUMBER, TRACK_UID, TRACK_TYPE, CODEC, AUDIO, FREQUENCY, CHANNELS, DEPTH, DEFAULT_DURATION, LACING = (
    0x1654AE6B, 0xAE, 0xD7, 0x73C5, 0x83, 0x86, 0xE1, 0xB5, 0x9F, 0x6264, 0x23E383, 0x9C,
)
CLUSTER, TIMESTAMP, SIMPLE_BLOCK, BLOCK_GROUP, BLOCK, REFERENCE = 0x1F43B675, 0xE7, 0xA3, 0xA0, 0xA1, 0xFB
CUES, CUE_POINT, CUE_TIME, CUE_POSITIONS, CUE_TRACK, CUE_CLUSTER = 0x1C53BB6B, 0xBB, 0xB3, 0xB7, 0xF7, 0xF1
#: Elements that end a cluster or segment of unknown size.
TOP_LEVEL = {INFO, TRACKS, CLUSTER, CUES, 0x114D9B74, 0x1941A469, 0x1043A770, 0x1254C367}

FRAME, RATE, FRAMES_A_BLOCK, BLOCKS_A_CLUSTER = 576, 8000, 8, 32
PACKETS = "array<struct<track:int,timestamp:long,offset:long,size:long,keyframe:boolean,lacing:string,cluster:int>>"


class Broken(ValueError):
    """The bytes aren't a file of this format."""


def _id(data: bytes, at: int) -> tuple[int, int]:
    if at >= len(data) or not data[at]:
        raise Broken(f"no element id at byte {at}")
    n = 9 - data[at].bit_length()
    if n > 4 or at + n > len(data):
        raise Broken(f"no element id at byte {at}")
    return int.from_bytes(data[at : at + n], "big"), at + n


def _vint(data: bytes, at: int) -> tuple[int | None, int]:
    """A number of 1 to 8 bytes; None for the one that means unknown."""
    if at >= len(data) or not data[at]:
        raise Broken(f"no size at byte {at}")
    n = 9 - data[at].bit_length()
    if at + n > len(data):
        raise Broken(f"cut off at byte {at}")
    value = int.from_bytes(data[at : at + n], "big") & ((1 << 7 * n) - 1)
    return (None if value == (1 << 7 * n) - 1 else value), at + n


def _children(data: bytes, at: int, end: int, closing: set[int] = frozenset()) -> Iterator[tuple[int, int, int]]:
    """(id, begin, end) of the content of each element in a range; stops before an element that closes it."""
    while at < end:
        kind, body = _id(data, at)
        if kind in closing:
            return
        size, body = _vint(data, body)
        stop = end if size is None else body + size
        if stop > end:
            raise Broken(f"element {kind:x} at byte {at} is longer than what holds it")
        if size is None:  # it reaches to the next element of its level
            stop = body
            for _, _, stop in _children(data, body, end, TOP_LEVEL if kind == CLUSTER else frozenset()):
                pass
        yield kind, body, stop
        at = stop


def _number(data: bytes, a: int, b: int) -> int:
    return int.from_bytes(data[a:b], "big")


def _laced(data: bytes, at: int, end: int, flags: int) -> tuple[str, list[tuple[int, int]]]:
    """The kind of lacing and (offset, size) of each frame of a block whose header ends at `at`."""
    kind = flags >> 1 & 3
    if not kind:
        return "none", [(at, end - at)]
    n, at = data[at] + 1, at + 1
    sizes: list[int] = []
    if kind == 1:
        for _ in range(n - 1):
            size = 0
            while data[at] == 255:
                size, at = size + 255, at + 1
            sizes.append(size + data[at])
            at += 1
    elif kind == 3:
        for k in range(n - 1):
            begin = at
            value, at = _vint(data, at)
            if value is None:
                value = (1 << 7 * (at - begin)) - 1
            sizes.append(value if not k else sizes[-1] + value - ((1 << 7 * (at - begin) - 1) - 1))
    else:
        if (end - at) % n:
            raise Broken(f"fixed lacing of {end - at} bytes in {n}")
        sizes = [(end - at) // n] * (n - 1)
    sizes.append(end - at - sum(sizes))
    if min(sizes) < 0:
        raise Broken("frames longer than their block")
    out = []
    for size in sizes:
        out.append((at, size))
        at += size
    return ("none", "xiph", "fixed", "ebml")[kind], out


def parse(data: bytes) -> dict:
    """Tracks, packets (in file order), cues and clusters of a file; timestamps in nanoseconds."""
    scale, tracks, packets, cues, clusters, seen = 1_000_000, {}, [], [], [], False

    def block(a: int, b: int, base: int, key: bool | None) -> None:
        track, at = _vint(data, a)
        relative, flags = struct.unpack_from(">hB", data, at)
        lacing, frames = _laced(data, at + 3, b, flags)
        step = tracks.get(track, {}).get("default_duration", 0)
        for k, (offset, size) in enumerate(frames):
            packets.append((track, (base + relative) * scale + k * step, offset, size, bool(flags & 0x80) if key is None else key, lacing, len(clusters) - 1))

    for kind, a, b in _children(data, 0, len(data)):
        if kind != SEGMENT:
            continue
        seen = True
        for part, c, d in _children(data, a, b):
            if part == INFO:
                for x, e, f in _children(data, c, d):
                    scale = _number(data, e, f) if x == SCALE else scale
            elif part == TRACKS:
                for x, e, f in _children(data, c, d):
                    if x == TRACK:
                        got = {y: (g, h) for y, g, h in _children(data, e, f)}
                        number = _number(data, *got[TRACK_NUMBER])
                        tracks[number] = {"codec": data[slice(*got[CODEC])].decode() if CODEC in got else "", "type": _number(data, *got[TRACK_TYPE]) if TRACK_TYPE in got else 0}
                        if DEFAULT_DURATION in got:
                            tracks[number]["default_duration"] = _number(data, *got[DEFAULT_DURATION])
            elif part == CLUSTER:
                clusters.append(c - a)
                base = 0
                for x, e, f in _children(data, c, d, TOP_LEVEL):
                    if x == TIMESTAMP:
                        base = _number(data, e, f)
                    elif x == SIMPLE_BLOCK:
                        block(e, f, base, None)
                    elif x == BLOCK_GROUP:
                        got = list(_children(data, e, f))
                        for y, g, h in got:
                            if y == BLOCK:
                                block(g, h, base, all(z != REFERENCE for z, _, _ in got))
            elif part == CUES:
                for x, e, f in _children(data, c, d):
                    got = {y: (g, h) for y, g, h in _children(data, e, f)}
                    for y, g, h in _children(data, e, f):
                        if y == CUE_POSITIONS:
                            at = {z: _number(data, i, j) for z, i, j in _children(data, g, h)}
                            cues.append((_number(data, *got[CUE_TIME]) * scale, at.get(CUE_TRACK, 0), at.get(CUE_CLUSTER, 0)))
    if not seen:
        raise Broken("no segment")
    return {"tracks": tracks, "packets": packets, "cues": cues, "clusters": clusters}


def _element(kind: int, body: bytes) -> bytes:
    n = len(body)
    size = next(k for k in range(1, 9) if n < (1 << 7 * k) - 1)
    return kind.to_bytes((kind.bit_length() + 7) // 8, "big") + (n | 1 << 7 * size).to_bytes(size, "big") + body


def _unsigned(kind: int, value: int) -> bytes:
    return _element(kind, value.to_bytes(max(1, (value.bit_length() + 7) // 8), "big"))


def write(payload: bytes) -> bytes:
    """A file with one track of unsigned 8-bit samples at 8 kHz: frames of 576 bytes, eight to a block.

    payload is a positive multiple of 576 bytes long. Each cluster has a cue.
    """
    head = _element(EBML, _unsigned(0x4286, 1) + _unsigned(0x42F7, 1) + _unsigned(0x42F2, 4) + _unsigned(0x42F3, 8) + _element(DOC_TYPE, b"matroska") + _unsigned(0x4287, 4) + _unsigned(0x4285, 2))
    step = FRAME * 1_000_000_000 // RATE
    frames = len(payload) // FRAME
    info = _element(INFO, _unsigned(SCALE, 1_000_000) + _element(DURATION, struct.pack(">d", frames * step / 1e6)))
    audio = _element(AUDIO, _element(FREQUENCY, struct.pack(">d", RATE)) + _unsigned(CHANNELS, 1) + _unsigned(DEPTH, 8))
    track = _unsigned(TRACK_NUMBER, 1) + _unsigned(TRACK_UID, 1) + _unsigned(TRACK_TYPE, 2) + _element(CODEC, b"A_PCM/INT/LIT") + _unsigned(DEFAULT_DURATION, step) + _unsigned(LACING, 1) + audio
    parts, cues = [info, _element(TRACKS, _element(TRACK, track))], []
    at = sum(map(len, parts))
    for first in range(0, frames, FRAMES_A_BLOCK * BLOCKS_A_CLUSTER):
        base = first * step // 1_000_000
        blocks = [_unsigned(TIMESTAMP, base)]
        for k in range(first, min(frames, first + FRAMES_A_BLOCK * BLOCKS_A_CLUSTER), FRAMES_A_BLOCK):
            n = min(FRAMES_A_BLOCK, frames - k)
            header = b"\x81" + struct.pack(">hB", k * step // 1_000_000 - base, 0x80 | (0x04 if n > 1 else 0)) + (bytes([n - 1]) if n > 1 else b"")
            blocks.append(_element(SIMPLE_BLOCK, header + payload[k * FRAME : (k + n) * FRAME]))
        cues.append(_element(CUE_POINT, _unsigned(CUE_TIME, base) + _element(CUE_POSITIONS, _unsigned(CUE_TRACK, 1) + _unsigned(CUE_CLUSTER, at))))
        parts.append(_element(CLUSTER, b"".join(blocks)))
        at += len(parts[-1])
    return head + _element(SEGMENT, b"".join(parts) + _element(CUES, b"".join(cues)))


def mux(docs: DataFrame) -> DataFrame:
    """docs with media: each text (null: empty) as UTF-8, padded with 255 to whole frames, in a file of its own; and n_bytes."""

    def written(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in text_slices(batch, "text", 16_000_000):
                sizes, media = [], []
                for text in part.column("text").cast(pa.binary()).to_pylist():
                    sizes.append(len(text))
                    media.append(write(text + b"\xff" * (max(FRAME, -(-len(text) // FRAME) * FRAME) - len(text))))
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(sizes, pa.int64()), pa.array(media, pa.binary())], names=["doc_id", "n_bytes", "media"])

    return docs.select("doc_id", text_of().alias("text")).mapInArrow(written, f"doc_id {dict(docs.dtypes)['doc_id']}, n_bytes long, media binary")


def packets(files: DataFrame, key: str, media: str = "media") -> DataFrame:
    """One row a packet of each file (key, media): key, nr, track, timestamp, offset, size, keyframe, lacing, cluster, error.

    A file that can't be read, a null one included, has one row with the error and no packet.
    """

    def parsed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["nr", "track", "timestamp", "offset", "size", "keyframe", "lacing", "cluster", "error"]
        kinds = [pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.bool_(), pa.string(), pa.int32(), pa.string()]
        for batch in batches:
            which, rows = [], []
            for k, data in enumerate(batch.column("media").to_pylist()):
                try:
                    found = [(nr, *x, None) for nr, x in enumerate(parse(data or b"")["packets"])]
                except (Broken, IndexError, KeyError, struct.error) as e:
                    found = [(*[None] * 8, str(e) or type(e).__name__)]
                which += [k] * len(found)
                rows += found
            columns = zip(*rows) if rows else [[]] * len(names)
            yield pa.RecordBatch.from_arrays([batch.column("key").take(pa.array(which, pa.int32())), *(pa.array(list(x), t) for x, t in zip(columns, kinds))], names=["key", *names])

    schema = f"key {dict(files.dtypes)[key]}, nr int, track int, timestamp long, offset long, size long, keyframe boolean, lacing string, cluster int, error string"
    return files.select(F.col(key).alias("key"), F.col(media).alias("media")).mapInArrow(parsed, schema).withColumnRenamed("key", key)


def features(data: bytes) -> tuple[bytes, str]:
    """The track's bytes by the packets' ranges, and numbers that tell files apart."""
    found = parse(data)
    payload = b"".join(data[p[2] : p[2] + p[3]] for p in found["packets"])
    samples = np.frombuffer(payload, np.uint8)
    # cues must point at clusters, or seeking by them would fail
    reached = sum(any(abs(c[2] - at) <= 12 for at in found["clusters"]) for c in found["cues"])
    last = found["packets"][-1]
    said = f"tracks={len(found['tracks'])};clusters={len(found['clusters'])};cues={len(found['cues'])};reached={reached};packets={len(found['packets'])}"
    return payload, f"{said};last_ms={last[1] // 1_000_000};sum={int(samples.sum(dtype=np.int64))};peak={int(samples.max())};turns={int(np.count_nonzero(np.diff(samples)))}"


def media_report(docs: DataFrame) -> DataFrame:
    """What is read back of each row's file; see the contract of op8.

    A null or empty text is a file of 576 bytes 255. Equal texts give equal values;
    repeated rows and rows that share a doc_id (null ones too) have a row each.
    Columns other than doc_id and text are not read. No rows give no rows.
    """
    path = shared_dir(docs.sparkSession)
    mux(docs).write.option("compression", "zstd").parquet(path)
    stored = docs.sparkSession.read.parquet(path)

    def read_back(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for data in batch.column("media").to_pylist():
                payload, said = features(data)
                rows.append((len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-32:]), len(data), hashlib.sha256(data).hexdigest(), said))
            names = ["payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"]
            kinds = [pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()]
            columns = zip(*rows) if rows else [[]] * len(names)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("n_bytes"), *(pa.array(list(x), t) for x, t in zip(columns, kinds))], names=["doc_id", "n_bytes", *names])

    schema = f"doc_id {dict(docs.dtypes)['doc_id']}, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"
    return stored.mapInArrow(read_back, schema)
