import hashlib
import zlib

import numpy as np
import pytest

from tarnhelm.llm import jpeg, media


def test_round_trip():
    rng = np.random.default_rng(1)
    payloads = [bytes(range(192)), b"\xff" * 192, b"\0" * 384, rng.integers(0, 256, 192 * 37).astype(np.uint8).tobytes(), b" " * 192]
    files = jpeg.write(payloads)
    for p, (head, c) in zip(payloads, jpeg.read(files)):
        assert jpeg.payload_of(head, c) == p
    for p, f in zip(payloads, files):
        (head, c), = jpeg.read([f])
        assert jpeg.payload_of(head, c) == p


def _bits(pairs):
    s = "".join(f"{v:0{n}b}" for v, n in pairs)
    s += "1" * (-len(s) % 8)
    return bytes(int(s[i : i + 8], 2) for i in range(0, len(s), 8)).replace(b"\xff", b"\xff\0")


def test_runs_end_of_block_and_no_restart_markers():
    """A hand-made grey file of two blocks: zero runs, sixteen zeros, end of block, DC prediction across blocks."""
    dc, ac = ((0, 2), (3, 2), (2, 2)), ((0x00, 2), (0x01, 2), (0x21, 3), (0xF0, 3))
    code = lambda t: {s: (c, b) for s, c, b in jpeg._codes(list(jpeg._dht(t, 0, 0)[1:17]), list(jpeg._dht(t, 0, 0)[17:]))}
    d, a = code(dc), code(ac)
    scan = [d[3], (5, 3), a[0x01], (1, 1), a[0xF0], a[0x21], (0, 1), a[0x00], d[2], (1, 2), a[0x00]]
    data = b"\xff\xd8" + jpeg._segment(0xDB, b"\0" + b"\2" * 64) + jpeg._segment(0xC0, bytes([8, 0, 8, 0, 16, 1, 1, 0x11, 0]))
    data += jpeg._segment(0xC4, jpeg._dht(dc, 0, 0) + jpeg._dht(ac, 1, 0)) + jpeg._segment(0xDA, bytes([1, 1, 0, 0, 63, 0])) + _bits(scan) + b"\xff\xd9"
    (head, c), = jpeg.read([data])
    first = np.zeros(64, int)
    first[0], first[1], first[20] = 5, 1, -1
    second = np.zeros(64, int)
    second[0] = 5 - 2
    assert (head.width, head.height) == (16, 8) and (c[0, 0] == first).all() and (c[1, 0] == second).all()
    assert jpeg.thumbnail(head, c).tolist() == [[128 + 10 // 8, 128 + 6 // 8]]


def test_damage_is_told():
    good = jpeg.write([b"x" * 192])[0]
    for bad in (b"", b"\xff\xd8\xff\xd9", good[:-20], b"GIF89a" + good):
        with pytest.raises(jpeg.JpegError):
            jpeg.read([bad])


def test_columns(spark, odd):
    rows = media.features(media.store(odd)).collect()
    assert len(rows) == odd.count()
    texts = {r.doc_id: r.text for r in odd.collect()}
    for r in rows:
        raw = (texts[r.doc_id] or "").encode()
        payload = raw + b" " * (max(192, -(-len(raw) // 192) * 192) - len(raw))
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(raw), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-16:]))
    same = [tuple(r)[1:] for r in rows if r.doc_id in (1, 2)]
    assert same[0] == same[1]
    assert media.features(media.store(odd.limit(0))).count() == 0
