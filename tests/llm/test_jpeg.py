import hashlib
import random
import zlib

import numpy as np
import pytest

from driftwell.llm import jpeg
from tests.llm.helpers import EDGES, documents, folder


def test_round_trip(monkeypatch):
    rng = random.Random(1)
    raw = [jpeg.padded(x) for x in (b"", b"a", b"b" * 192, b"c" * 193, bytes(range(256)) * 9, bytes(rng.randrange(256) for _ in range(5000)), "é日😀".encode() * 400)]
    back = jpeg.decode(jpeg.encode(raw))
    assert [b"".join(f.thumbnail.tobytes() for f in s) for s in back] == raw
    monkeypatch.setattr(jpeg, "ROWS", 3)  # several frames to a stream
    monkeypatch.setattr(jpeg, "LANES", 2)
    streams = jpeg.encode(raw)
    assert [b"".join(f.thumbnail.tobytes() for f in s) for s in jpeg.decode(streams)] == raw and len(jpeg.decode(streams)[4]) == 4


def colour_stream():
    """A 32 x 16 picture in three components, 4:2:0, with AC terms, written bit by bit."""
    dc = {0: 2, 1: 2, 2: 3, 3: 3, 4: 3, 5: 4, 6: 5, 7: 6}
    ac = {0x00: 1, 0x01: 2, 0xF0: 3, 0x21: 4}
    table = lambda lengths: jpeg._canonical(lengths)
    (c0, s0, dcodes), (c1, s1, acodes) = table(dc), table(ac)
    bits = ""

    def value(v, size):
        return "" if not size else format(v if v >= 0 else v + (1 << size) - 1, f"0{size}b")

    rng = random.Random(5)
    before, luma = [0, 0, 0], {}
    for mcu in range(2):
        for component, blocks in ((0, 4), (1, 1), (2, 1)):
            for k in range(blocks):
                level = rng.randint(-60, 60)
                d = level - before[component]
                before[component] = level
                size = abs(d).bit_length()
                code, n = dcodes[size]
                bits += format(code, f"0{n}b") + value(d, size)
                for symbol in rng.choice(([0x00], [0x01, 0x00], [0x21, 0xF0, 0x01, 0x00], [0xF0, 0xF0, 0xF0] + [0x01] * 15)):
                    code, n = acodes[symbol]
                    bits += format(code, f"0{n}b") + value(rng.choice((-1, 1)) if symbol & 15 else 0, symbol & 15)
                if component == 0:
                    luma[k // 2, 2 * mcu + k % 2] = level
    bits += "1" * (-len(bits) % 8)
    scan = b"".join(b"\xff\x00" if b == 255 else bytes((b,)) for b in (int(bits[i : i + 8], 2) for i in range(0, len(bits), 8)))
    seg = jpeg._segment
    frame = b"\x08" + (16).to_bytes(2, "big") + (32).to_bytes(2, "big") + b"\x03\x01\x22\x00\x02\x11\x00\x03\x11\x00"
    head = b"\xff\xd8" + seg(0xFE, b"note") + seg(0xDB, b"\0" + b"\x10" * 64) + seg(0xC0, frame) + seg(0xC4, b"\x00" + c0 + s0 + b"\x10" + c1 + s1)
    return head + seg(0xDA, b"\3\1\0\2\0\3\0\0\x3f\0") + scan + b"\xff\xd9", np.array([[luma[r, c] for c in range(4)] for r in range(2)])


def test_colour_with_ac_terms():
    stream, luma = colour_stream()
    frame = jpeg.decode([stream, jpeg.encode([jpeg.padded(b"x")])[0]])[0][0]
    assert (frame.width, frame.height) == (32, 16)
    assert (frame.thumbnail == np.clip((luma * 16 + 4 >> 3) + 128, 0, 255)).all()


def test_damage_is_an_error():
    good = jpeg.encode([jpeg.padded(b"some text" * 50)])[0]
    for bad in (b"", b"no picture", good[:-2], good[:40], good.replace(b"\xff\xc0", b"\xff\xc2")):
        with pytest.raises(ValueError):
            if not jpeg.decode([bad])[0]:
                raise ValueError("empty")


def test_table(spark, tmp_path):
    rows = jpeg.op10_media(spark, folder(tmp_path, documents=documents(spark, EDGES))).collect()
    want = {}
    for i, t in EDGES:
        raw = (t or "").encode()
        p = jpeg.padded(raw)
        want[i] = (len(raw), len(p), hashlib.sha256(p).hexdigest(), zlib.crc32(p[-16:]))
    assert len(rows) == len(EDGES) and all((r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == want[r.doc_id] for r in rows)
    by_payload = {}
    for r in rows:
        assert by_payload.setdefault(r.payload_sha256, (r.media_sha256, r.feature)) == (r.media_sha256, r.feature)
    assert len({r.feature for r in rows}) == len(by_payload)
    assert jpeg.op10_media(spark, folder(tmp_path / "none", documents=documents(spark, EDGES).limit(0))).count() == 0


def test_a_damaged_stream_stops_no_other(spark):
    good = [jpeg.encode([jpeg.padded(f"text {i}".encode() * 30)])[0] for i in range(6)]
    bad = [None, b"", b"no picture", good[1][:-2], good[2][:40]]
    rows = [(i, 1, None if s is None else bytearray(s)) for i, s in enumerate([*good[:3], *bad, *good[3:]])]
    got = {r.doc_id: r for r in jpeg.thumbnails(spark.createDataFrame(rows, "doc_id long, n_bytes long, media binary")).collect()}
    assert {i for i, r in got.items() if r.error} == {3, 4, 5, 6, 7} and all(r.samples is None and r.feature is None and r.width is None for r in got.values() if r.error)
    assert all(bytes(got[i if i < 3 else i + 5].samples) == jpeg.padded(f"text {i}".encode() * 30) for i in range(6))
