"""Media columns: baseline JPEG written and read in numpy, many images at a time.

``encode_frames`` stores bytes as the luminance of 8x8 blocks: a block's DC coefficient is the
byte less 128 under a quantiser of 8, all its AC coefficients are zero, so the DC-only
thumbnail of the image is the payload itself. ``thumbnails`` parses the markers of any
baseline JPEG, Huffman-decodes its scans and keeps the luminance DCs. Restart intervals are
independent, so the intervals of all images of a batch are decoded in step.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections import defaultdict
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lateview.llm.common import slices, table

#: Blocks in a row of an image, blocks in a restart interval, rows at most (65,535 pixels).
WIDTH, INTERVAL, ROWS = 576, 64, 8191

# The DC luminance table of the JPEG standard, annex K.3.1 (codes of each length, symbols),
# and a table with the end-of-block symbol alone.
DC_COUNTS, DC_SYMBOLS = (0, 1, 5, 1, 1, 1, 1, 1, 1, 0, 0, 0, 0, 0, 0, 0), tuple(range(12))
AC_COUNTS, AC_SYMBOLS = (1, 0, 0, 0, 0, 0, 0, 0, 0, 0, 0, 0, 0, 0, 0, 0), (0,)


def _codes(counts: tuple, symbols: tuple) -> dict[int, tuple[int, int]]:
    """Symbol to (code, length) of a canonical Huffman table."""
    out, code, at = {}, 0, 0
    for length, n in enumerate(counts, 1):
        for s in symbols[at : at + n]:
            out[s] = (code, length)
            code += 1
        at += n
        code <<= 1
    return out


@lru_cache(1)
def _words() -> tuple[np.ndarray, np.ndarray]:
    """Bits and length of a whole block for each DC difference from -255 to 255."""
    dc, (eob, eob_len) = _codes(DC_COUNTS, DC_SYMBOLS), _codes(AC_COUNTS, AC_SYMBOLS)[0]
    bits, length = np.zeros(511, np.uint32), np.zeros(511, np.int64)
    for d in range(-255, 256):
        size = abs(d).bit_length()
        code, n = dc[size]
        extra = d if d >= 0 else d + (1 << size) - 1
        bits[d + 255] = ((code << size | extra) << eob_len) | eob
        length[d + 255] = n + size + eob_len
    return bits, length


def _segment(marker: int, body: bytes) -> bytes:
    return struct.pack(">BBH", 0xFF, marker, len(body) + 2) + body


def _header(rows: int) -> bytes:
    return b"".join(
        [
            b"\xff\xd8",
            _segment(0xDB, b"\x00" + b"\x08" * 64),
            _segment(0xC0, struct.pack(">BHHBBBB", 8, rows * 8, WIDTH * 8, 1, 1, 0x11, 0)),
            _segment(0xC4, b"\x00" + bytes(DC_COUNTS) + bytes(DC_SYMBOLS)),
            _segment(0xC4, b"\x10" + bytes(AC_COUNTS) + bytes(AC_SYMBOLS)),
            _segment(0xDD, struct.pack(">H", INTERVAL)),
            _segment(0xDA, b"\x01\x01\x00\x00\x3f\x00"),
        ]
    )


def encode_frames(payloads: list[bytes]) -> list[bytes]:
    """A JPEG (several one after another, if it is long) for each payload of a positive multiple of 576 bytes."""
    bits, length = _words()
    data = np.frombuffer(b"".join(payloads), np.uint8).reshape(-1, INTERVAL).T
    lanes = data.shape[1]
    room = (15 * INTERVAL + 7) // 8 + 3
    packed = np.zeros(lanes * room, np.uint8)
    base = np.arange(lanes, dtype=np.int64) * room
    at = np.zeros(lanes, np.int64)
    before = np.full(lanes, 128, np.int16)
    for row in data:
        now = row.astype(np.int16)
        which = now - before + 255
        before = now
        n = length[which]
        word = bits[which] << (24 - (at & 7) - n).astype(np.uint32)
        to = base + (at >> 3)
        packed[to] |= (word >> np.uint32(16)).astype(np.uint8)
        packed[to + 1] |= (word >> np.uint32(8)).astype(np.uint8)
        packed[to + 2] |= word.astype(np.uint8)
        at += n
    packed[base + (at >> 3)] |= ((1 << (-at & 7)) - 1).astype(np.uint8) * ((at & 7) != 0)
    size = ((at + 7) >> 3).tolist()
    raw = packed.tobytes()
    restart = [bytes((0xFF, 0xD0 + i)) for i in range(8)]
    out, lane = [], 0
    for p in payloads:
        frames = []
        for s in range(0, len(p), WIDTH * ROWS):
            rows = min(len(p) - s, WIDTH * ROWS) // WIDTH
            frames.append(_header(rows))
            n = rows * WIDTH // INTERVAL
            for i in range(n):
                k = lane * room
                frames.append(raw[k : k + size[lane]].replace(b"\xff", b"\xff\x00"))
                lane += 1
                if i < n - 1:
                    frames.append(restart[i & 7])
            frames.append(b"\xff\xd9")
        out.append(b"".join(frames))
    return out


class Unreadable(ValueError):
    """Bytes that are no baseline JPEG."""


class Frame:
    """One parsed image: size, tables, and the entropy-coded intervals of the scan that holds luminance."""

    def __init__(self) -> None:
        self.width = self.height = self.restart = 0
        self.quant: dict[int, tuple] = {}
        self.parts: list[tuple[int, int, int, int]] = []  # id, h, v, quantiser
        self.tables: dict[int, tuple] = {}
        self.layout: tuple = ()  # of the blocks of an MCU: part, DC table, AC table
        self.intervals: list[bytes] = []
        self.mcus = self.across = 0


def parse(data: bytes) -> list[Frame]:
    """The images that stand one after another in ``data``."""
    frames: list[Frame] = []
    frame: Frame | None = None
    at = 0
    while at < len(data):
        if data[at] != 0xFF or at + 1 >= len(data):
            raise Unreadable(f"no marker at byte {at}")
        marker = data[at + 1]
        at += 2
        if marker == 0xFF:
            at -= 1
            continue
        if marker == 0xD8:
            frame = Frame()
            continue
        if frame is None:
            raise Unreadable("no start of image")
        if marker == 0xD9:
            if not frame.intervals:
                raise Unreadable("no scan with luminance")
            frames.append(frame)
            frame = None
            continue
        if at + 2 > len(data):
            raise Unreadable("cut short")
        n = int.from_bytes(data[at : at + 2], "big")
        body = data[at + 2 : at + n]
        if n < 2 or len(body) != n - 2:
            raise Unreadable("cut short")
        at += n
        if marker == 0xDB:
            while body:
                wide, t = body[0] >> 4, body[0] & 15
                step = 128 if wide else 64
                frame.quant[t] = struct.unpack(">64H" if wide else "64B", body[1 : step + 1])
                body = body[step + 1 :]
        elif marker in (0xC0, 0xC1):
            bits, frame.height, frame.width, n = struct.unpack(">BHHB", body[:6])
            if bits != 8 or not frame.width or not frame.height:
                raise Unreadable("only 8-bit images of known size")
            frame.parts = [(body[i], body[i + 1] >> 4, body[i + 1] & 15, body[i + 2]) for i in range(6, 6 + 3 * n, 3)]
        elif 0xC2 <= marker <= 0xCF and marker not in (0xC4, 0xC8, 0xCC):
            raise Unreadable("not baseline")
        elif marker == 0xC4:
            while body:
                counts = tuple(body[1:17])
                total = sum(counts)
                frame.tables[body[0]] = (counts, tuple(body[17 : 17 + total]))
                body = body[17 + total :]
        elif marker == 0xDD:
            frame.restart = int.from_bytes(body[:2], "big")
        elif marker == 0xDA:
            stop = at
            while True:
                stop = data.find(b"\xff", stop)
                if stop < 0 or stop + 1 >= len(data):
                    raise Unreadable("a scan without end")
                if data[stop + 1] == 0 or 0xD0 <= data[stop + 1] <= 0xD7:
                    stop += 2
                else:
                    break
            _scan(frame, body, data[at:stop])
            at = stop
    if frame is not None or not frames:
        raise Unreadable("no end of image")
    return frames


def _scan(frame: Frame, body: bytes, data: bytes) -> None:
    chosen = {body[1 + 2 * i]: body[2 + 2 * i] for i in range(body[0])}
    if not frame.parts:
        raise Unreadable("a scan before the frame")
    first = frame.parts[0]
    if first[0] not in chosen:
        return  # colour alone
    high, wide = max(p[2] for p in frame.parts), max(p[1] for p in frame.parts)
    if len(chosen) == 1:
        frame.layout = ((0, chosen[first[0]] >> 4, chosen[first[0]] & 15),)
        frame.across = -(-frame.width * first[1] // (8 * wide))
        frame.mcus = frame.across * -(-frame.height * first[2] // (8 * high))
    else:
        frame.layout = tuple(
            (i, chosen[p[0]] >> 4, chosen[p[0]] & 15) for i, p in enumerate(frame.parts) if p[0] in chosen for _ in range(p[1] * p[2])
        )
        frame.across = -(-frame.width // (8 * wide))
        frame.mcus = frame.across * -(-frame.height // (8 * high))
    parts = _split(data) if frame.restart else [data]
    frame.intervals = [x.replace(b"\xff\x00", b"\xff") for x in parts]
    if frame.restart and len(frame.intervals) != -(-frame.mcus // frame.restart):
        raise Unreadable("restart intervals are missing")


def _split(data: bytes) -> list[bytes]:
    """The restart intervals of a scan."""
    found = np.frombuffer(data, np.uint8)
    at = np.flatnonzero((found[:-1] == 0xFF) & (found[1:] >= 0xD0) & (found[1:] <= 0xD7)).tolist()
    return [data[a:b] for a, b in zip([0, *(x + 2 for x in at)], [*at, len(data)])]


@lru_cache(64)
def _lookup(table: tuple) -> tuple[np.ndarray, np.ndarray]:
    """Length and symbol of the code that each 16 bits begin with; length 0: none."""
    length, symbol = np.zeros(1 << 16, np.int64), np.zeros(1 << 16, np.int64)
    for s, (code, n) in _codes(*table).items():
        length[code << (16 - n) : (code + 1) << (16 - n)] = n
        symbol[code << (16 - n) : (code + 1) << (16 - n)] = s
    return length, symbol


def _extend(extra: np.ndarray, size: np.ndarray) -> np.ndarray:
    return np.where(extra < (1 << np.maximum(size - 1, 0)), extra - (1 << size) + 1, extra) * (size > 0)


@lru_cache(64)
def _block_lookup(dc: tuple, ac: tuple) -> np.ndarray:
    """For each 16 bits that hold a DC code, its extra bits and an end of block: difference << 8 | bits; else 0."""
    word = np.arange(1 << 16)
    n, size = _lookup(dc)[0], _lookup(dc)[1]
    used = n + size
    fits = (n > 0) & (used <= 16)
    extra = (word >> np.where(fits, 16 - used, 0)) & ((1 << size) - 1)
    diff = _extend(extra, size)
    rest = (word << np.where(fits, used, 0)) & 0xFFFF
    m, symbol = _lookup(ac)[0][rest], _lookup(ac)[1][rest]
    fits &= (m > 0) & (symbol == 0) & (used + m <= 16)
    return np.where(fits, diff << 8 | (used + m), 0)


def _decode(lanes: list[bytes], mcus: np.ndarray, layout: tuple, tables: dict) -> np.ndarray:
    """The luminance DCs of all lanes in step: ``[lane, block]``; lanes come with the longest first."""
    data = np.frombuffer(b"".join(x + b"\xff\xff\xff\xff" for x in lanes) + b"\xff" * 8, np.uint8).astype(np.uint32)
    window = data[:-3] << 24 | data[1:-2] << 16 | data[2:-1] << 8 | data[3:]
    sizes = np.array([len(x) + 4 for x in lanes], np.int64)
    stops = np.cumsum(sizes) * 8
    pos = stops - sizes * 8
    luma = [i for i, (part, _, _) in enumerate(layout) if part == 0]
    out = np.zeros((len(luma) * int(mcus[0]), len(lanes)), np.int32)
    before = {part: np.zeros(len(lanes), np.int64) for part, _, _ in layout}

    def peek(p: np.ndarray) -> np.ndarray:
        return (window[p >> 3] >> (16 - (p & 7)).astype(np.uint32)) & 0xFFFF

    def slow(p: np.ndarray, dc: tuple, ac: tuple) -> tuple[np.ndarray, np.ndarray]:
        word = peek(p)
        n, size = _lookup(dc)[0][word], _lookup(dc)[1][word]
        if not n.all():
            raise Unreadable("no such Huffman code")
        p = p + n
        diff = _extend((peek(p) >> (16 - size).astype(np.uint32)).astype(np.int64), size)
        p = p + size
        k, rest = np.ones(len(p), np.int64), np.arange(len(p))
        while len(rest):
            word = peek(p[rest])
            n, symbol = _lookup(ac)[0][word], _lookup(ac)[1][word]
            if not n.all():
                raise Unreadable("no such Huffman code")
            p[rest] += n + (symbol & 15)
            k[rest] += (symbol >> 4) + 1
            if (p[rest] > stops[-1]).any():
                raise Unreadable("a scan that is cut short")
            rest = rest[(symbol != 0) & (k[rest] < 64)]
        return diff, p

    n = len(lanes)
    for m in range(int(mcus[0])):
        n = int(np.searchsorted(-mcus, -m, "left")) if mcus[n - 1] <= m else n
        for i, (part, d, a) in enumerate(layout):
            dc, ac = tables[d], tables[16 + a]
            p = pos[:n]
            got = _block_lookup(dc, ac)[peek(p)]
            if got.all():
                diff, pos[:n] = got >> 8, p + (got & 255)
            else:
                diff, to = got >> 8, p + (got & 255)
                other = np.flatnonzero(got == 0)
                diff[other], to[other] = slow(p[other], dc, ac)
                pos[:n] = to
            before[part][:n] += diff
            if part == 0:
                out[m * len(luma) + luma.index(i), :n] = before[part][:n]
    if (pos > stops).any():
        raise Unreadable("a scan that is cut short")
    return out.T


def thumbnails(media: list[bytes]) -> list[list[tuple[Frame, np.ndarray]]]:
    """For each value its images, each with its DC-only luminance thumbnail (one sample a block)."""
    frames = [parse(x) for x in media]
    alike = defaultdict(list)
    for f in (f for fs in frames for f in fs):
        tables = {k: f.tables[k] for _, d, a in f.layout for k in (d, 16 + a) if k in f.tables}
        if any(k not in tables for _, d, a in f.layout for k in (d, 16 + a)):
            raise Unreadable("a Huffman table is missing")
        alike[f.layout, tuple(sorted(tables.items()))].append(f)
    image: dict[int, np.ndarray] = {}
    for (layout, tables), group in alike.items():
        lanes, mcus, of = [], [], []
        for k, f in enumerate(group):
            each = f.restart or f.mcus
            lanes += f.intervals
            mcus += [min(each, f.mcus - i * each) for i in range(len(f.intervals))]
            of += [k] * len(f.intervals)
        order = np.argsort(-np.array(mcus), kind="stable")
        got = _decode([lanes[i] for i in order], np.array(mcus)[order], layout, dict(tables))
        back = np.empty_like(order)
        back[order] = np.arange(len(order))
        got, at = got[back], 0
        blocks = sum(part == 0 for part, _, _ in layout)
        for f in group:
            mine = got[at : at + len(f.intervals)]
            at += len(f.intervals)
            each = (f.restart or f.mcus) * blocks
            image[id(f)] = _picture(f, mine[:, :each].reshape(-1)[: f.mcus * blocks], blocks)
    return [[(f, image[id(f)]) for f in fs] for fs in frames]


def _picture(f: Frame, dc: np.ndarray, blocks: int) -> np.ndarray:
    _, h, v, q = f.parts[0]
    if q not in f.quant:
        raise Unreadable("a quantiser is missing")
    if blocks == 1 or len(f.layout) == 1:
        grid = dc.reshape(-1, f.across)
    else:
        grid = dc.reshape(-1, f.across, v, h).transpose(0, 2, 1, 3).reshape(-1, f.across * h)
    wide, high = max(p[1] for p in f.parts), max(p[2] for p in f.parts)
    grid = grid[: -(-f.height * v // (8 * high)), : -(-f.width * h // (8 * wide))]
    return np.clip(np.rint(grid * f.quant[q][0] / 8 + 128), 0, 255).astype(np.uint8)


def thumbnail_hash(thumb: np.ndarray) -> int:
    """64-bit difference hash: the thumbnail in 8 rows of 9 means, each against its right neighbour."""

    def pooled(x: np.ndarray, n: int) -> np.ndarray:
        edge = np.arange(n + 1) * len(x) // n
        total = np.vstack([np.zeros_like(x[:1]), np.cumsum(x, axis=0)])
        edge[1:] = np.maximum(edge[1:], np.minimum(edge[:-1] + 1, len(x)))
        low = np.minimum(edge[:-1], len(x) - 1)
        high = np.maximum(edge[1:], low + 1)
        return (total[high] - total[low]) / (high - low)[:, None]

    grid = pooled(pooled(thumb.astype(np.int64), 8).T, 9).T
    return int(np.packbits(grid[:, :-1] < grid[:, 1:]).view(">u8")[0])


def payload_of(text: bytes | None) -> bytes:
    """The text's bytes, and bytes 255 up to a positive multiple of 576 (255 occurs in no UTF-8)."""
    text = text or b""
    return text + b"\xff" * (-len(text) % WIDTH or (WIDTH if not text else 0))


def store_texts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, media``: every text as a JPEG column value.

    Null and empty texts make one row of padding; a payload of more lines than one image may have makes several images, one after another. Null ids
    and repeated rows stay, equal texts have equal values, other columns are not read, an empty table gives no rows.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, 1, 1 << 20):
            media = encode_frames([payload_of(t.as_py()) for t in b.column(1)])
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(media, pa.binary())], ["doc_id", "media"])

    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("binary").alias("text"))
    return rows.mapInArrow(run, f"doc_id {docs.schema[id_col].dataType.simpleString()}, media binary")


def media_features(media: DataFrame) -> DataFrame:
    """What a column ``media`` of baseline JPEGs holds, read from its bytes.

    Returns ``doc_id``; ``width, height`` in pixels (of several images one above another);
    ``media_bytes, media_sha256`` of the value; ``samples, samples_sha256`` of the luminance
    thumbnail in rows; ``filled``, its samples without those of 255 at the end; ``tail_crc32`` of
    its last 32; ``feature``, its size and difference hash. A null value, or bytes that are no
    baseline JPEG, give nulls. Repeated rows stay; an empty table gives no rows.
    """

    types = {
        "width": pa.int64(), "height": pa.int64(), "media_bytes": pa.int64(), "media_sha256": pa.string(),
        "samples": pa.int64(), "samples_sha256": pa.string(), "filled": pa.int64(), "tail_crc32": pa.int64(),
        "feature": pa.string(),
    }

    def describe(value: bytes, images: list[tuple[Frame, np.ndarray]]) -> tuple:
        thumbs = [t for _, t in images]
        wide = max(t.shape[1] for t in thumbs)
        whole = np.vstack([np.pad(t, ((0, 0), (0, wide - t.shape[1]))) for t in thumbs]) if len(thumbs) > 1 else thumbs[0]
        raw = whole.tobytes()
        width, height = max(f.width for f, _ in images), sum(f.height for f, _ in images)
        return (
            width, height, len(value), hashlib.sha256(value).hexdigest(), len(raw), hashlib.sha256(raw).hexdigest(),
            len(raw.rstrip(b"\xff")), zlib.crc32(raw[-32:]), f"{width}x{height}:{thumbnail_hash(whole):016x}",
        )

    def read(values: list[bytes | None]) -> list[tuple]:
        try:
            found = iter(thumbnails([v for v in values if v is not None]))
        except (Unreadable, struct.error, IndexError):
            if len(values) == 1:
                return [(None,) * len(types)]
            return [x for v in values for x in read([v])]
        return [(None,) * len(types) if v is None else describe(v, next(found)) for v in values]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, 1, 1 << 20):
            columns = zip(*read(b.column(1).to_pylist()))
            arrays = [pa.array(x, t) for x, t in zip(columns, types.values())]
            yield pa.RecordBatch.from_arrays([b.column(0), *arrays], ["doc_id", *types])

    names = ", ".join(f"{k} {'string' if t == pa.string() else 'long'}" for k, t in types.items())
    return media.select("doc_id", "media").mapInArrow(run, f"doc_id {media.schema['doc_id'].dataType.simpleString()}, {names}")


def op3_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's text stored as JPEG and read back: digests of payload and file, and the feature."""
    read = media_features(store_texts(table(spark, sf_dir, "documents")))
    return read.select(
        "doc_id",
        F.col("filled").alias("n_bytes"),  # padding is the only 255 in a payload
        F.col("samples").alias("payload_bytes"),
        F.col("samples_sha256").alias("payload_sha256"),
        "tail_crc32",
        "media_bytes",
        "media_sha256",
        "feature",
        "width",
        "height",
    )
