"""Baseline JPEG media columns, in numpy.

``encode`` stores bytes losslessly: each byte is the DC level of one flat 8 x 8 luminance block
(quantiser 8, so the coefficient is the sample itself less 128), 192 blocks to a row and to a
restart interval; a payload of more rows than a frame can have continues in a further frame of
the same stream. ``decode`` parses the markers of any baseline stream with interleaved scans,
Huffman-decodes all restart intervals of a batch in step, and keeps the DC terms: the luminance
thumbnail at one eighth of the size. Of a stream from ``encode`` the thumbnail is the payload.

Null texts count as empty; the empty text becomes one row of blanks. ``decode`` raises ValueError on
a damaged stream; a column of streams has nulls and the reason in its place. Repeated texts give repeated results; an
empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

import hashlib
import zlib
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from driftwell.llm.common import map_texts, table

ROW = 192  # samples in a row of blocks
ROWS = 8191  # rows in a frame at most: 65,528 pixels
BLANK = 32
LANES = 8192  # restart intervals that are worked on at once

# Own Huffman tables: code lengths for the DC size categories, after the differences between
# neighbouring bytes of prose; the AC table has the end of block alone.
_DC_LENGTHS = {7: 2, 4: 2, 3: 2, 2: 3, 1: 4, 5: 5, 0: 6, 6: 7, 8: 8}
_AC_LENGTHS = {0: 1}


def _canonical(lengths: dict[int, int]) -> tuple[bytes, bytes, dict[int, tuple[int, int]]]:
    """Counts for each length, symbols, and (code, length) of each symbol."""
    counts, symbols, codes, code, last = [0] * 16, [], {}, 0, 0
    for symbol, n in sorted(lengths.items(), key=lambda x: x[1]):
        code <<= n - last
        codes[symbol], last = (code, n), n
        code += 1
        counts[n - 1] += 1
        symbols.append(symbol)
    return bytes(counts), bytes(symbols), codes


def _segment(marker: int, body: bytes) -> bytes:
    return bytes((0xFF, marker)) + (len(body) + 2).to_bytes(2, "big") + body


_DC_COUNTS, _DC_SYMBOLS, _DC_CODES = _canonical(_DC_LENGTHS)
_AC_COUNTS, _AC_SYMBOLS, _AC_CODES = _canonical(_AC_LENGTHS)
_BEFORE = b"\xff\xd8" + _segment(0xE0, b"JFIF\0\1\1\0\0\1\0\1\0\0") + _segment(0xDB, b"\0" + b"\x08" * 64)
_AFTER = _segment(0xC4, b"\x00" + _DC_COUNTS + _DC_SYMBOLS) + _segment(0xC4, b"\x10" + _AC_COUNTS + _AC_SYMBOLS) + _segment(0xDD, ROW.to_bytes(2, "big")) + _segment(0xDA, b"\1\1\0\0\x3f\0")


def _difference_codes() -> tuple[np.ndarray, np.ndarray]:
    """For each difference plus 255: DC code, amplitude bits and end of block as one code, and its length."""
    codes, lengths = np.zeros(511, np.uint32), np.zeros(511, np.int64)
    for d in range(-255, 256):
        size = abs(d).bit_length()
        code, n = _DC_CODES[size]
        amplitude = d if d >= 0 else d + (1 << size) - 1
        codes[d + 255] = ((code << size | amplitude) << _AC_CODES[0][1]) | _AC_CODES[0][0]
        lengths[d + 255] = n + size + _AC_CODES[0][1]
    return codes, lengths


_CODES, _LENGTHS = _difference_codes()


def padded(data: bytes) -> bytes:
    return data + bytes([BLANK]) * (-len(data) % ROW if data else ROW)


def _scans(rows: np.ndarray, place: np.ndarray, last: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Entropy-coded bytes of rows x ROW samples with a marker after each; the end of each in them.

    ``place``: the row's index in its frame; ``last``: whether it ends the frame.
    """
    diff = np.diff(rows.astype(np.int16), axis=1, prepend=np.int16(128)) + 255
    size = _LENGTHS[diff]
    ends = size.cumsum(1)
    bits = ends[:, -1]
    n_bytes = (bits + 7) >> 3
    starts = np.concatenate(([0], n_bytes.cumsum()))
    at = (starts[:-1, None] * 8 + ends - size).ravel()
    shift = (32 - (at & 7) - size.ravel()).astype(np.uint32)
    value = _CODES[diff].ravel() << shift
    slot, total = at >> 3, int(starts[-1]) + 3
    packed = np.zeros(total)
    for i, down in enumerate((24, 16, 8)):
        packed += np.bincount(slot + i, (value >> np.uint32(down)) & np.uint32(255), total)
    packed = packed[: starts[-1]].astype(np.uint8)
    packed[starts[1:] - 1] |= ((1 << (-bits % 8)) - 1).astype(np.uint8)  # fill with ones
    full = packed == 0xFF
    lane = np.repeat(np.arange(len(rows)), n_bytes)
    where = np.arange(len(packed)) + np.concatenate(([0], full.cumsum()[:-1])) + 2 * lane
    out = np.zeros(len(packed) + int(full.sum()) + 2 * len(rows), np.uint8)
    out[where] = packed
    tail = where[starts[1:] - 1] + full[starts[1:] - 1] + 1
    out[tail] = 0xFF
    out[tail + 1] = np.where(last, 0xD9, 0xD0 + place % 8)
    return out, tail + 2


def encode(payloads: list[bytes]) -> list[bytes]:
    """One stream for each payload; their lengths are positive multiples of ROW."""
    if not payloads:
        return []
    if any(not p or len(p) % ROW for p in payloads):
        raise ValueError(f"a payload's length must be a positive multiple of {ROW}")
    rows = np.frombuffer(b"".join(payloads), np.uint8).reshape(-1, ROW)
    counts = np.array([len(p) // ROW for p in payloads])
    place = (np.arange(len(rows)) - np.repeat(counts.cumsum() - counts, counts)) % ROWS
    last = np.append(place[1:] == 0, True)
    parts, tails, done = [], [], 0
    for i in range(0, len(rows), LANES):  # bounds the working arrays
        data, tail = _scans(rows[i : i + LANES], place[i : i + LANES], last[i : i + LANES])
        parts.append(data)
        tails.append(tail + done)
        done += len(data)
    data, ends = np.concatenate(parts), np.concatenate(tails)
    stops, heads = ends[last], np.flatnonzero(last)
    frames, begin = [], 0
    for stop, row in zip(stops.tolist(), heads.tolist()):
        height = 8 * (int(place[row]) + 1)
        frames.append(_BEFORE + _segment(0xC0, b"\x08" + height.to_bytes(2, "big") + (8 * ROW).to_bytes(2, "big") + b"\1\1\x11\0") + _AFTER + data[begin:stop].tobytes())
        begin = stop
    out, k = [], 0
    for n in counts:
        m = -(-int(n) // ROWS)
        out.append(b"".join(frames[k : k + m]))
        k += m
    return out


@dataclass
class Frame:
    width: int = 0
    height: int = 0
    components: list = field(default_factory=list)  # (id, h, v, quantiser)
    quantisers: dict = field(default_factory=dict)
    tables: dict = field(default_factory=dict)  # (class, id) -> DHT body
    interval: int = 0
    scan: list = field(default_factory=list)  # (component, dc table, ac table)
    begin: int = 0
    thumbnail: np.ndarray | None = None


def _header(data: bytes, at: int, carried: Frame | None) -> Frame:
    """Markers from SOI to SOS."""
    f = Frame()
    if carried:
        f.quantisers, f.tables = dict(carried.quantisers), dict(carried.tables)
    if data[at : at + 2] != b"\xff\xd8":
        raise ValueError("no start of image")
    at += 2
    while True:
        if at + 4 > len(data) or data[at] != 0xFF:
            raise ValueError("a marker is missing")
        marker = data[at + 1]
        if marker == 0xFF:
            at += 1
            continue
        size = int.from_bytes(data[at + 2 : at + 4], "big")
        body = data[at + 4 : at + 2 + size]
        if len(body) != size - 2:
            raise ValueError("a segment is cut off")
        at += 2 + size
        if marker == 0xDB:
            while body:
                wide = body[0] >> 4
                n = 64 * (1 + wide)
                f.quantisers[body[0] & 15] = int.from_bytes(body[1 : 2 + wide], "big")
                body = body[1 + n :]
        elif marker == 0xC4:
            while body:
                n = 17 + sum(body[1:17])
                f.tables[body[0] >> 4, body[0] & 15] = body[1:n]
                body = body[n:]
        elif marker == 0xC0:
            if body[0] != 8:
                raise ValueError("samples must have 8 bits")
            f.height, f.width = int.from_bytes(body[1:3], "big"), int.from_bytes(body[3:5], "big")
            f.components = [(body[6 + 3 * i], body[7 + 3 * i] >> 4, body[7 + 3 * i] & 15, body[8 + 3 * i]) for i in range(body[5])]
        elif 0xC1 <= marker <= 0xCF and marker not in (0xC8, 0xCC):
            raise ValueError("not a baseline stream")
        elif marker == 0xDD:
            f.interval = int.from_bytes(body, "big")
        elif marker == 0xDA:
            index = {c[0]: i for i, c in enumerate(f.components)}
            f.scan = [(index[body[1 + 2 * i]], body[2 + 2 * i] >> 4, body[2 + 2 * i] & 15) for i in range(body[0])]
            if not f.width or not f.height or len(f.scan) != len(f.components):
                raise ValueError("one scan must hold all components of a sized frame")
            f.begin = at
            return f


_lookups: dict[bytes, np.ndarray] = {}


def _lookup(body: bytes) -> np.ndarray:
    """length << 8 | symbol for each 16 bits that may follow; 0: no code."""
    if body not in _lookups:
        if len(_lookups) > 64:
            _lookups.clear()
        out, code, k = np.zeros(65536, np.uint16), 0, 16
        for n in range(1, 17):
            for _ in range(body[n - 1]):
                out[code << (16 - n) : (code + 1) << (16 - n)] = n << 8 | body[k]
                code += 1
                k += 1
            code <<= 1
        _lookups[body] = out
    return _lookups[body]


def _decode_lanes(window: np.ndarray, at: np.ndarray, blocks: np.ndarray, pattern: list[tuple[int, np.ndarray, np.ndarray]]) -> np.ndarray:
    """DC levels, lanes x blocks. All lanes go block by block in step; those that are done drop out.

    ``window``: 64 bits from each byte on. ``at``: first bit of each lane. ``pattern``: component,
    DC and AC lookups of each block of an MCU.
    """
    order = np.argsort(-blocks, kind="stable")
    at, left = at[order].copy(), blocks[order]
    most = int(left[0]) if len(left) else 0
    levels = np.zeros((most, len(at)), np.int32)
    before = np.zeros((1 + max(c for c, _, _ in pattern), len(at)), np.int64)
    active = np.searchsorted(-left, -np.arange(most), side="left")  # lanes that have block i
    half = np.concatenate(([0], 1 << np.arange(16))).astype(np.int64)
    one, top = np.uint64(1), np.uint64(48)
    for i in range(most):
        n = int(active[i])
        component, dc, ac = pattern[i % len(pattern)]
        pos = at[:n]
        bits = window[pos >> 3] << (pos & 7).astype(np.uint64)
        entry = dc[bits >> top]
        used, size = (entry >> 8).astype(np.uint64), (entry & 255).astype(np.uint64)
        if not used.all():
            raise ValueError("no such code")
        bits <<= used
        value = ((bits >> one) >> (np.uint64(63) - size)).astype(np.int64)
        small = size.astype(np.int64)
        value -= np.where(value < half[small], (1 << small) - 1, 0)
        before[component, :n] += value
        levels[i, :n] = before[component, :n]
        bits <<= size
        entry = ac[bits >> top]
        pos += (used + size).astype(np.int64) + (entry >> 8)
        if (entry & 255).any() or not entry.all():
            _skip(window, pos, entry, ac)
    out = np.empty_like(levels)
    out[:, order] = levels
    return out.T


def _skip(window: np.ndarray, pos: np.ndarray, entry: np.ndarray, ac: np.ndarray) -> None:
    """Move ``pos``, which stands after each lane's first AC code, past the rest of its block."""
    rows, k = np.arange(len(pos)), np.ones(len(pos), np.int64)
    while True:
        if not entry.all():
            raise ValueError("no such code")
        symbol = (entry & 255).astype(np.int64)
        pos[rows] += symbol & 15
        k = np.where(symbol == 0, 64, k + (symbol >> 4) + 1)
        rest = k < 64
        rows, k = rows[rest], k[rest]
        if not len(rows):
            return
        own = pos[rows]
        entry = ac[(window[own >> 3] << (own & 7).astype(np.uint64)) >> np.uint64(48)]
        pos[rows] += entry >> 8


def decode(streams: list[bytes]) -> list[list[Frame]]:
    """The frames of each stream, with luminance thumbnails (uint8, one sample for 8 x 8 pixels)."""
    joined = b"".join(streams)
    raw = np.frombuffer(joined, np.uint8)
    ff = np.flatnonzero(raw[:-1] == 0xFF)
    follow = raw[ff + 1]
    marks = ff[(follow != 0) & (follow != 0xFF)]
    kinds = raw[marks + 1]
    stops = np.flatnonzero((kinds < 0xD0) | (kinds > 0xD7))  # markers that end a scan
    frames: list[list[Frame]] = []
    lanes: dict[tuple, list] = {}
    start = 0
    for stream in streams:
        own, at, carried = [], start, None
        end = start + len(stream)
        while at < end:
            f = carried = _header(joined, at, carried)
            k = int(np.searchsorted(marks, f.begin))
            s = int(np.searchsorted(stops, k))
            if s == len(stops) or kinds[stops[s]] != 0xD9:
                raise ValueError("the scan does not end the image")
            k2 = int(stops[s])
            begins = np.concatenate(([f.begin], marks[k:k2] + 2))
            ends = marks[k : k2 + 1]
            try:
                key = tuple((c, f.components[c][1] * f.components[c][2] if len(f.scan) > 1 else 1, f.tables[0, d], f.tables[1, a]) for c, d, a in f.scan)
            except KeyError:
                raise ValueError("a Huffman table is missing") from None
            h, v = (max(c[i] for c in f.components) for i in (1, 2)) if len(f.scan) > 1 else (1, 1)
            mcus = -(-f.width // (8 * h)) * -(-f.height // (8 * v))
            step = f.interval or mcus
            counts = np.minimum(step, mcus - step * np.arange(-(-mcus // step)))
            if len(counts) != len(begins):
                raise ValueError("the restart intervals do not match the frame")
            lanes.setdefault(key, []).append((f, begins, ends, counts))
            own.append(f)
            at = int(ends[-1]) + 2
        frames.append(own)
        start = end
    for key, group in lanes.items():
        _fill(raw, key, group)
    return frames


def _fill(raw: np.ndarray, key: tuple, group: list) -> None:
    """Decode the restart intervals of frames that share their tables, and set their thumbnails."""
    begins, ends = np.concatenate([g[1] for g in group]), np.concatenate([g[2] for g in group])
    counts = np.concatenate([g[3] for g in group])
    pattern = [(c, _lookup(d), _lookup(a)) for c, times, d, a in key for _ in range(times)]
    flats = []
    for i in range(0, len(begins), LANES):
        own = counts[i : i + LANES] * len(pattern)
        levels = _decode_lanes(*_windows(raw, begins[i : i + LANES], ends[i : i + LANES]), own, pattern)
        flats.append(levels[np.arange(levels.shape[1]) < own[:, None]])
    flat = np.concatenate(flats)
    at = 0
    for f, _, _, own in group:
        n = int(own.sum()) * len(pattern)
        f.thumbnail = _thumbnail(f, flat[at : at + n].reshape(-1, len(pattern)), key)
        at += n


def _windows(raw: np.ndarray, begins: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The 64 bits from each byte of the intervals on, without stuffed bytes, and each interval's first bit."""
    sizes = ends - begins
    first = sizes.cumsum() - sizes
    data = raw[np.arange(int(sizes.sum())) + np.repeat(begins - first, sizes)]
    stuffed = np.zeros(len(data), bool)
    stuffed[1:] = (data[1:] == 0) & (data[:-1] == 0xFF)
    stuffed[first[sizes > 0]] = False
    gone = np.concatenate(([0], stuffed.cumsum()))
    wide = np.concatenate((data[~stuffed], np.full(64, 0xFF, np.uint8))).astype(np.uint64)
    window = wide[:-7] << np.uint64(56)
    for i in range(1, 8):
        window |= wide[i : len(wide) - 7 + i] << np.uint64(56 - 8 * i)
    return window, (first - gone[first]) * 8


def _thumbnail(f: Frame, mcus: np.ndarray, key: tuple) -> np.ndarray:
    """Luminance DC levels in their places, scaled to samples."""
    at = next(sum(k[1] for k in key[:i]) for i, k in enumerate(key) if k[0] == 0)
    _, h, v, quantiser = f.components[0]
    if len(key) == 1:
        h = v = 1
        across = -(-f.width // 8)
    else:
        across = -(-f.width // (8 * max(c[1] for c in f.components)))
    own = mcus[:, at : at + h * v].reshape(-1, across, v, h)
    grid = own.transpose(0, 2, 1, 3).reshape(own.shape[0] * v, across * h)
    scale_w = max(c[1] for c in f.components) // f.components[0][1] if len(key) > 1 else 1
    scale_h = max(c[2] for c in f.components) // f.components[0][2] if len(key) > 1 else 1
    grid = grid[: -(-f.height // (8 * scale_h)), : -(-f.width // (8 * scale_w))]
    return np.clip((grid * f.quantisers[quantiser] + 4 >> 3) + 128, 0, 255).astype(np.uint8)


def feature(frames: list[Frame]) -> str:
    """Width x height of all frames, a 64-bit gradient hash of the thumbnail, and the thumbnail's CRC."""
    thumbs = [f.thumbnail for f in frames]
    whole = thumbs[0] if len(thumbs) == 1 else np.concatenate(thumbs)
    rows, columns = (np.arange(n + 1) * size // n for n, size in ((8, whole.shape[0]), (9, whole.shape[1])))
    sums = np.zeros((whole.shape[0] + 1, whole.shape[1] + 1))
    sums[1:, 1:] = whole.cumsum(0, dtype=np.float64).cumsum(1)
    top, bottom = rows[:-1], np.maximum(rows[1:], rows[:-1] + 1).clip(max=whole.shape[0])
    left, right = columns[:-1], np.maximum(columns[1:], columns[:-1] + 1).clip(max=whole.shape[1])
    top, left = np.minimum(top, bottom - 1), np.minimum(left, right - 1)
    area = (bottom - top)[:, None] * (right - left)[None, :]
    means = (sums[bottom][:, right] - sums[top][:, right] - sums[bottom][:, left] + sums[top][:, left]) / area
    bits = np.packbits(means[:, 1:] > means[:, :-1]).tobytes()
    return f"{frames[0].width}x{sum(f.height for f in frames)}:{bits.hex()}:{zlib.crc32(np.ascontiguousarray(whole).tobytes()):08x}"


def store(docs: DataFrame) -> DataFrame:
    """doc_id, the bytes of its text without padding, and its text as a media column."""

    def run(part, texts):
        raw = [t.encode("utf-8", "surrogatepass") for t in texts]
        return {"doc_id": part.column("doc_id"), "n_bytes": [len(r) for r in raw], "media": pa.array(encode([padded(r) for r in raw]), pa.binary())}

    kind = docs.schema["doc_id"].dataType.simpleString()
    return map_texts(docs.select("doc_id", "text"), run, f"doc_id {kind}, n_bytes long, media binary", limit=1_000_000)


def thumbnails(media: DataFrame) -> DataFrame:
    """The rows of ``media`` (doc_id, n_bytes, media) with dimensions, thumbnail samples and hashes.

    A stream that is no baseline JPEG, or is damaged or missing, has nulls and the reason in ``error``; other rows of its batch are read.
    """

    def read(streams: list[bytes]) -> list[tuple[list[Frame] | None, str | None]]:
        try:
            return [(f, None) if f else (None, "ValueError: no frame") for f in decode(streams)]
        except (ValueError, IndexError, KeyError, OverflowError) as fault:
            if len(streams) == 1:
                return [(None, f"{type(fault).__name__}: {fault}")]
            half = len(streams) // 2
            return read(streams[:half]) + read(streams[half:])

    def run(part, streams):
        found = read([bytes(s or b"") for s in streams])
        each = lambda f: [None if x is None else f(x) for x, _ in found]
        return {
            "doc_id": part.column("doc_id"), "n_bytes": part.column("n_bytes"), "media": part.column("media"),
            "width": each(lambda f: f[0].width), "height": each(lambda f: sum(x.height for x in f)),
            "samples": pa.array(each(lambda f: b"".join(x.thumbnail.tobytes() for x in f)), pa.binary()), "feature": each(feature), "error": [e for _, e in found],
        }

    kind = media.schema["doc_id"].dataType.simpleString()
    return map_texts(media, run, f"doc_id {kind}, n_bytes long, media binary, width long, height long, samples binary, feature string, error string", column="media", limit=1_000_000)


def op10_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    read = thumbnails(store(table(spark, sf_dir, "documents")))
    return read.select(
        "doc_id", "n_bytes", F.octet_length("samples").cast("long").alias("payload_bytes"), F.sha2("samples", 256).alias("payload_sha256"),
        F.crc32(F.substring("samples", -16, 16)).alias("tail_crc32"), F.octet_length("media").cast("long").alias("media_bytes"), F.sha2("media", 256).alias("media_sha256"), "feature",
    )
