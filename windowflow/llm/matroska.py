"""Media columns in Matroska.

A payload is stored as 8-bit mono PCM samples: 1024 samples a frame, up to eight frames laced in a
SimpleBlock, blocks in clusters of about four seconds, a cue for every cluster. The reader parses any
file of EBML elements with variable-length ids and sizes (unknown sizes too), clusters, SimpleBlocks and
BlockGroups with Xiph, EBML, fixed-size or no lacing, and cues into a table of packets with
timestamps, tracks and byte ranges. Timestamps are milliseconds, whatever the file's TimestampScale.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, StringType, StructField, StructType

from .bpe import slices
from .common import in_arrow

# fixed values: element ids of EBML and Matroska
EBML, SEGMENT, INFO, TRACKS, CLUSTER, CUES = 0x1A45DFA3, 0x18538067, 0x1549A966, 0x1654AE6B, 0x1F43B675, 0x1C53BB6B
EBML_VERSION, EBML_READ_VERSION, MAX_ID, MAX_SIZE, DOC_TYPE, DOC_VERSION, DOC_READ_VERSION = 0x4286, 0x42F7, 0x42F2, 0x42F3, 0x4282, 0x4287, 0x4285
TIMESTAMP_SCALE, DURATION, MUXER, WRITER = 0x2AD7B1, 0x4489, 0x4D80, 0x5741
DEFAULT_DURATION, BLOCK_DURATION = 0x23E383, 0x9B
TRACK_ENTRY, TRACK_NUMBER, TRACK_UID, TRACK_TYPE, LACING, CODEC, AUDIO, RATE, CHANNELS, DEPTH = 0xAE, 0xD7, 0x73C5, 0x83, 0x9C, 0x86, 0xE1, 0xB5, 0x9F, 0x6264
TIMESTAMP, SIMPLE_BLOCK, BLOCK_GROUP, BLOCK = 0xE7, 0xA3, 0xA0, 0xA1
CUE_POINT, CUE_TIME, CUE_POSITIONS, CUE_TRACK, CUE_CLUSTER = 0xBB, 0xB3, 0xB7, 0xF7, 0xF1
_MASTERS = {SEGMENT, CLUSTER, BLOCK_GROUP, TRACKS, TRACK_ENTRY, AUDIO, CUES, CUE_POINT, CUE_POSITIONS, INFO, EBML}
_TOP = {INFO, TRACKS, CLUSTER, CUES, SEGMENT, EBML}

FRAME, LACED, BLOCKS, SAMPLE_RATE = 1024, 8, 4, 8000
FRAME_MS = FRAME * 1000 // SAMPLE_RATE


class Packet(NamedTuple):
    track: int
    timestamp: int
    start: int
    length: int
    cluster: int
    lacing: int


def _size(n: int) -> bytes:
    k = 1
    while n >= (1 << 7 * k) - 1:
        k += 1
    return (n | 1 << 7 * k).to_bytes(k, "big")


def _element(ident: int, body: bytes) -> bytes:
    return ident.to_bytes((ident.bit_length() + 7) // 8, "big") + _size(len(body)) + body


def _uint(ident: int, n: int) -> bytes:
    return _element(ident, n.to_bytes(max(1, (n.bit_length() + 7) // 8), "big"))


def _block(at: int, frames: list[bytes]) -> bytes:
    """A SimpleBlock of track 1, ``at`` ms into its cluster: fixed-size lacing for equal frames, else EBML."""
    head = struct.pack(">Bh", 0x81, at)
    if len(frames) == 1:
        return _element(SIMPLE_BLOCK, head + b"\x80" + frames[0])
    if len({len(f) for f in frames}) == 1:
        return _element(SIMPLE_BLOCK, head + b"\x84" + bytes([len(frames) - 1]) + b"".join(frames))
    sizes = _size(len(frames[0]))
    for a, b in zip(frames, frames[1:-1], strict=False):  # signed differences; the last size follows from the rest
        k = 1
        while not -(1 << 7 * k - 1) < len(b) - len(a) < 1 << 7 * k - 1:
            k += 1
        sizes += (len(b) - len(a) + (1 << 7 * k - 1) - 1 | 1 << 7 * k).to_bytes(k, "big")
    return _element(SIMPLE_BLOCK, head + b"\x86" + bytes([len(frames) - 1]) + sizes + b"".join(frames))


_HEADER = _element(
    EBML,
    _uint(EBML_VERSION, 1) + _uint(EBML_READ_VERSION, 1) + _uint(MAX_ID, 4) + _uint(MAX_SIZE, 8) + _element(DOC_TYPE, b"matroska") + _uint(DOC_VERSION, 4) + _uint(DOC_READ_VERSION, 2),
)
_TRACKS = _element(
    TRACKS,
    _element(
        TRACK_ENTRY,
        _uint(TRACK_NUMBER, 1) + _uint(TRACK_UID, 1) + _uint(TRACK_TYPE, 2) + _uint(LACING, 1) + _element(CODEC, b"A_PCM/INT/LIT")
        + _element(AUDIO, _element(RATE, struct.pack(">d", SAMPLE_RATE)) + _uint(CHANNELS, 1) + _uint(DEPTH, 8)),
    ),
)


def write(payload: bytes) -> bytes:
    frames = [payload[i : i + FRAME] for i in range(0, len(payload), FRAME)]
    info = _element(
        INFO,
        _uint(TIMESTAMP_SCALE, 1_000_000) + _element(MUXER, b"windowflow") + _element(WRITER, b"windowflow")
        + _element(DURATION, struct.pack(">d", len(payload) * 1000 / SAMPLE_RATE)),
    )
    parts, at, cues = [info, _TRACKS], len(info) + len(_TRACKS), b""
    for i in range(0, len(frames), LACED * BLOCKS):
        own = frames[i : i + LACED * BLOCKS]
        blocks = b"".join(_block(k * FRAME_MS, own[k : k + LACED]) for k in range(0, len(own), LACED))
        cluster = _element(CLUSTER, _uint(TIMESTAMP, i * FRAME_MS) + blocks)
        cues += _element(CUE_POINT, _uint(CUE_TIME, i * FRAME_MS) + _element(CUE_POSITIONS, _uint(CUE_TRACK, 1) + _uint(CUE_CLUSTER, at)))
        parts.append(cluster)
        at += len(cluster)
    parts.append(_element(CUES, cues))
    return _HEADER + _element(SEGMENT, b"".join(parts))


def _vint(data: bytes, at: int, marker: bool) -> tuple[int, int]:
    """A variable-length number and the place after it; -1 for a size that says "unknown"."""
    first = data[at]
    if not first:
        raise ValueError(f"no variable-length number at byte {at}")
    k = 9 - first.bit_length()
    if at + k > len(data):
        raise ValueError(f"the file ends in a number at byte {at}")
    n = int.from_bytes(data[at : at + k], "big")
    if marker:
        return n, at + k
    n ^= 1 << 7 * k
    return (-1 if n == (1 << 7 * k) - 1 else n), at + k


def _elements(data: bytes, at: int, end: int) -> Iterator[tuple[int, int, int]]:
    """(id, start, end of the body) of the elements between two places."""
    while at < end:
        ident, at = _vint(data, at, True)
        n, at = _vint(data, at, False)
        if n < 0:
            if ident not in (SEGMENT, CLUSTER):
                raise ValueError(f"element {ident:x} of unknown size")
            stop = end if ident == SEGMENT else _cluster_end(data, at, end)
        else:
            stop = at + n
            if stop > end:
                raise ValueError(f"element {ident:x} ends behind its parent")
        yield ident, at, stop
        at = stop


def _cluster_end(data: bytes, at: int, end: int) -> int:
    while at < end:
        ident, body = _vint(data, at, True)
        if ident in _TOP:
            return at
        n, body = _vint(data, body, False)
        if n < 0 or body + n > end:
            raise ValueError(f"element {ident:x} ends behind its parent")
        at = body + n
    return end


def _frames(data: bytes, at: int, end: int) -> tuple[int, int, int, list[tuple[int, int]]]:
    """Track, relative timestamp, lacing and the frames' byte ranges of a block's body."""
    track, at = _vint(data, at, False)
    relative, flags = struct.unpack_from(">hB", data, at)
    at += 3
    lacing = flags >> 1 & 3
    if not lacing:
        return track, relative, 0, [(at, end - at)]
    n = data[at] + 1
    at += 1
    sizes: list[int] = []
    if lacing == 1:
        for _ in range(n - 1):
            size = 0
            while data[at] == 255:
                size += 255
                at += 1
            sizes.append(size + data[at])
            at += 1
    elif lacing == 3:
        for i in range(n - 1):
            before = at
            x, at = _vint(data, at, False)
            sizes.append(x if not i else sizes[-1] + x - ((1 << 7 * (at - before) - 1) - 1))
    else:
        each, rest = divmod(end - at, n)
        if rest:
            raise ValueError("fixed-size lacing of unequal frames")
        sizes = [each] * (n - 1)
    sizes.append(end - at - sum(sizes))
    if min(sizes) < 0:
        raise ValueError("laced frames are longer than their block")
    out = []
    for size in sizes:
        out.append((at, size))
        at += size
    return track, relative, lacing, out


class Media(NamedTuple):
    """Packets; cues (timestamp, track, place of the cluster); tracks (number, type, codec); duration; all times in ms."""

    packets: list[Packet]
    cues: list[tuple[int, int, int]]
    tracks: list[tuple[int, int, str]]
    duration: float


class _Track(NamedTuple):
    number: int
    kind: int
    codec: str
    frame_ms: float | None
    bytes_per_ms: float | None

    def lasts(self, length: int) -> float:
        """Milliseconds of a frame of that many bytes; 0 if the track doesn't say."""
        if self.frame_ms is not None:
            return self.frame_ms
        return length / self.bytes_per_ms if self.bytes_per_ms else 0.0


def _number(data: bytes, at: tuple[int, int]) -> int:
    return int.from_bytes(data[at[0] : at[1]], "big")


def _float(data: bytes, at: tuple[int, int]) -> float:
    """Floats have four or eight bytes, or none for 0."""
    raw = data[at[0] : at[1]]
    if len(raw) not in (0, 4, 8):
        raise ValueError(f"a float of {len(raw)} bytes")
    return struct.unpack(">d" if len(raw) == 8 else ">f", raw)[0] if raw else 0.0


def _fields(data: bytes, at: tuple[int, int]) -> dict[int, tuple[int, int]]:
    """The last element of each id."""
    return {k: (a, b) for k, a, b in _elements(data, *at)}


def _track(data: bytes, at: tuple[int, int]) -> _Track:
    own = _fields(data, at)
    codec = data[slice(*own[CODEC])].rstrip(b"\0").decode()
    each = _number(data, own[DEFAULT_DURATION]) / 1e6 if DEFAULT_DURATION in own else None
    rate = None
    if AUDIO in own and codec.startswith("A_PCM"):
        audio = _fields(data, own[AUDIO])
        depth = _number(data, audio[DEPTH]) if DEPTH in audio else 8
        rate = (_float(data, audio[RATE]) if RATE in audio else 8000.0) * (_number(data, audio[CHANNELS]) if CHANNELS in audio else 1) * depth / 8000
    return _Track(_number(data, own[TRACK_NUMBER]), _number(data, own[TRACK_TYPE]), codec, each, rate)


def read(data: bytes) -> Media:
    """Everything that the reader knows about a file.

    Frames of a lace share the block's timestamp; those that follow add the frames' time, as the block's own
    duration, the track's default duration or the rate of plain samples tells it, in this order. Raises ValueError for
    whatever doesn't follow the format, and for a cue to no cluster.
    """
    try:
        return _read(data)
    except (IndexError, KeyError, StopIteration, UnicodeDecodeError, struct.error) as e:
        raise ValueError(f"damaged file: {type(e).__name__} {e}") from e


def _read(data: bytes) -> Media:
    packets: list[Packet] = []
    cues: list[tuple[int, int, int]] = []
    tracks: list[_Track] = []
    duration = 0.0
    for top, s0, e0 in _elements(data, 0, len(data)):
        if top != SEGMENT:
            continue
        scale, by_number, clusters, place = 1.0, {}, set(), s0  # scale: ms of a tick
        own_cues = []
        for ident, s, e in _elements(data, s0, e0):
            if ident == INFO:
                info = _fields(data, (s, e))
                scale = _number(data, info[TIMESTAMP_SCALE]) / 1e6 if TIMESTAMP_SCALE in info else 1.0
                duration = _float(data, info[DURATION]) * scale if DURATION in info else 0.0
            elif ident == TRACKS:
                found = [_track(data, (a, b)) for i, a, b in _elements(data, s, e) if i == TRACK_ENTRY]
                tracks += found
                by_number |= {t.number: t for t in found}
            elif ident == CLUSTER:
                clusters.add(place - s0)
                packets += _cluster(data, s, e, place - s0, scale, by_number)
            elif ident == CUES:
                for _, a, b in (x for x in _elements(data, s, e) if x[0] == CUE_POINT):
                    own = list(_elements(data, a, b))
                    when = next(_number(data, (x, y)) for k, x, y in own if k == CUE_TIME)
                    for where in (_fields(data, (x, y)) for k, x, y in own if k == CUE_POSITIONS):
                        own_cues.append((round(when * scale), _number(data, where[CUE_TRACK]), _number(data, where[CUE_CLUSTER])))
            place = e
        if any(c not in clusters for _, _, c in own_cues):
            raise ValueError("a cue points to no cluster")
        cues += own_cues
    return Media(packets, cues, [t[:3] for t in tracks], duration)


def _cluster(data: bytes, s: int, e: int, place: int, scale: float, tracks: dict[int, _Track]) -> Iterator[Packet]:
    at = 0
    for ident, a, b in _elements(data, s, e):
        if ident == TIMESTAMP:
            at = _number(data, (a, b))
        if ident not in (SIMPLE_BLOCK, BLOCK_GROUP):
            continue
        own = _fields(data, (a, b)) if ident == BLOCK_GROUP else {BLOCK: (a, b)}
        if BLOCK not in own:
            continue
        track, relative, lacing, ranges = _frames(data, *own[BLOCK])
        when = (at + relative) * scale
        each = _number(data, own[BLOCK_DURATION]) * scale / len(ranges) if BLOCK_DURATION in own else None
        for start, length in ranges:
            yield Packet(track, round(when), start, length, place, lacing)
            when += each if each is not None else tracks[track].lasts(length) if track in tracks else 0.0


def payload_of(data: bytes, media: Media, track: int = 1) -> bytes:
    return b"".join([data[p.start : p.start + p.length] for p in media.packets if p.track == track])


def features(payload: bytes, media: Media) -> str:
    """What the samples and packets say, as text."""
    samples = np.frombuffer(payload, np.uint8)
    share = np.bincount(samples, minlength=256) / max(1, len(samples))
    share = share[share > 0]
    entropy = float(-(share * np.log2(share)).sum())
    return (
        f"packets={len(media.packets)};clusters={len({p.cluster for p in media.packets})};cues={len(media.cues)};"
        f"laced={sum(p.lacing > 0 for p in media.packets)};ms={round(media.duration)};mean={samples.mean() if len(samples) else 0:.4f};"
        f"std={samples.std() if len(samples) else 0:.4f};entropy={entropy:.4f}"
    )


def store_media(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_bytes, media (binary): each text as UTF-8, padded with zeros to a positive multiple of 64.

    A null text counts as empty and becomes 64 zeros; null and repeated ids are returned as they are; no
    rows give no rows; other columns are not looked at.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch):
                raw = [(t or "").encode("utf-8", "surrogatepass") for t in part.column(1).to_pylist()]
                media = [write(x + bytes(-len(x) % 64 or (0 if x else 64))) for x in raw]
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), pa.array([len(x) for x in raw], pa.int64()), pa.array(media, pa.binary())], ["doc_id", "n_bytes", "media"]
                )

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).transform(
        in_arrow, run, "doc_id long, n_bytes long, media binary"
    )


def read_media(stored: DataFrame, media_col: str = "media") -> DataFrame:
    """``stored`` with payload (binary) and feature (string) read from its media; null media give nulls.

    A damaged file gives a null payload and the feature ``damaged: `` with the reason; it doesn't end the job. A file without
    packets of track 1 gives an empty payload. No rows give no rows; other columns are kept.
    """
    at = stored.columns.index(media_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch):
                payloads, said = [], []
                for data in part.column(at).to_pylist():
                    payload = feature = None
                    if data is not None:
                        try:
                            media = read(data)
                            payload = payload_of(data, media)
                            feature = features(payload, media)
                        except ValueError as e:
                            feature = f"damaged: {e}"
                    payloads.append(payload)
                    said.append(feature)
                yield pa.RecordBatch.from_arrays(
                    [*part.columns, pa.array(payloads, pa.binary()), pa.array(said, pa.string())], [*part.schema.names, "payload", "feature"]
                )

    schema = StructType([*stored.schema.fields, StructField("payload", BinaryType()), StructField("feature", StringType())])
    return stored.transform(in_arrow, run, schema)


def packet_table(stored: DataFrame, id_col: str = "doc_id", media_col: str = "media") -> DataFrame:
    """One row per packet: id, packet, track, timestamp (ms), start, length (bytes of the file), cluster, lacing.

    Null, empty and damaged media have no packets; ``read_media`` says what is wrong with a damaged file.
    """

    def packets(data: bytes | None) -> list[Packet]:
        try:
            return [] if data is None else read(data).packets
        except ValueError:
            return []

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, 64):
                rows = [(i, k, *p) for i, data in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), strict=True) for k, p in enumerate(packets(data))]
                columns = list(zip(*rows, strict=True)) or [[]] * 8
                yield pa.RecordBatch.from_arrays([pa.array(list(c), pa.int64()) for c in columns], names)

    names = ["doc_id", "packet", "track", "timestamp", "start", "length", "cluster", "lacing"]
    return stored.select(F.col(id_col).cast("long"), media_col).transform(in_arrow, run, ", ".join(f"{x} long" for x in names))
