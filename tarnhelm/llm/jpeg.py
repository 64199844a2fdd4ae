"""Baseline JPEG in numpy: marker parsing, Huffman coding of many scans at once, DC thumbnails.

The decoder reads any baseline sequential file (8 bits, Huffman, any sampling factors, with or
without restart markers).  All restart intervals of all given files are lanes that decode
one symbol a step together, so no Python loop runs over symbols.

The writer stores a payload losslessly in the format's own units, its quantised coefficients:
each payload byte becomes one nonzero coefficient, 64 a block, three blocks (Y, Cb, Cr) an MCU,
so an MCU holds 192 bytes.  Every MCU is a restart interval.
"""

from __future__ import annotations

import hashlib
import struct

import numpy as np

UNIT = 192
#: MCUs decoded or encoded together at most: bounds the arrays.
LANES = 1 << 14

#: The zigzag order of an 8x8 block.
ZIGZAG = np.array([
    0, 1, 8, 16, 9, 2, 3, 10, 17, 24, 32, 25, 18, 11, 4, 5, 12, 19, 26, 33, 40, 48, 41, 34, 27, 20, 13, 6, 7, 14, 21, 28,
    35, 42, 49, 56, 57, 50, 43, 36, 29, 22, 15, 23, 30, 37, 44, 51, 58, 59, 52, 45, 38, 31, 39, 46, 53, 60, 61, 54, 47, 55, 62, 63,
])

#: Code lengths of the writer's tables: (symbol, bits).  Text bytes are mostly of sizes 5, 7 and 4.
DC_CODES = ((7, 2), (6, 2), (8, 3), (5, 3), (4, 4), (9, 5), (3, 6), (2, 7), (1, 8), (0, 9))
AC_CODES = ((5, 1), (7, 2), (4, 3), (6, 4), (8, 5), (3, 6), (2, 7), (1, 8))


class JpegError(ValueError):
    """The file isn't a baseline JPEG that this decoder reads."""


def _dht(codes, kind: int, number: int) -> bytes:
    counts, symbols = [0] * 16, []
    for symbol, bits in sorted(codes, key=lambda c: c[1]):
        counts[bits - 1] += 1
        symbols.append(symbol)
    return bytes([kind << 4 | number, *counts, *symbols])


def _codes(counts: list[int], symbols: list[int]) -> list[tuple[int, int, int]]:
    """(symbol, code, bits) in canonical order."""
    out, code, at = [], 0, 0
    for bits, n in enumerate(counts, 1):
        for _ in range(n):
            out.append((symbols[at], code, bits))
            code, at = code + 1, at + 1
        code <<= 1
    return out


def _lookup(counts: list[int], symbols: list[int]) -> np.ndarray:
    """For each 16 bits ahead: bits << 8 | symbol; 0 where no code matches."""
    table = np.zeros(1 << 16, np.int32)
    for symbol, code, bits in _codes(counts, symbols):
        low = code << (16 - bits)
        table[low : low + (1 << (16 - bits))] = bits << 8 | symbol
    return table


def _encode_table(spec: bytes) -> tuple[np.ndarray, np.ndarray]:
    code, size = np.zeros(256, np.int64), np.zeros(256, np.int64)
    for symbol, c, bits in _codes(list(spec[1:17]), list(spec[17:])):
        code[symbol], size[symbol] = c, bits
    return code, size


_DC, _AC = _dht(DC_CODES, 0, 0), _dht(AC_CODES, 1, 0)


def _byte_words(spec: bytes) -> tuple[np.ndarray, np.ndarray]:
    """For each payload byte: the code and value bits of its coefficient, and how many.

    Bytes under 128 become -128 .. -1, the others 1 .. 128: never zero, so a block has
    neither runs nor an end mark.
    """
    code, size = _encode_table(spec)
    v = np.arange(256) - 128
    v += v >= 0
    s = np.floor(np.log2(np.abs(v))).astype(np.int64) + 1
    return (code[s] << s | np.where(v < 0, v + (1 << s) - 1, v)).astype(np.uint64), (size[s] + s).astype(np.uint64)


_DC_WORDS, _AC_WORDS = _byte_words(_DC), _byte_words(_AC)


def _segment(marker: int, body: bytes) -> bytes:
    return struct.pack(">HH", 0xFF00 | marker, len(body) + 2) + body


def _scans(payload: np.ndarray) -> list[bytes]:
    """Entropy-coded bytes of each MCU of 192 payload bytes (a multiple of them).

    A word has 13 bits at most, so four neighbours fit 64 bits and are joined first; what is
    left is ORed into 64-bit places, several words a place.
    """
    p = payload.reshape(-1, UNIT)
    word, n = _AC_WORDS[0][p], _AC_WORDS[1][p]
    for c in (0, 64, 128):  # each component's prediction is 0 at the start of an interval
        word[:, c], n[:, c] = _DC_WORDS[0][p[:, c]], _DC_WORDS[1][p[:, c]]
    one = np.uint64(1)
    total = n.sum(1)
    pad = (np.uint64(8) - (total & np.uint64(7))) & np.uint64(7)  # filled up with ones
    word[:, -1] = word[:, -1] << pad | ((one << pad) - one)
    n[:, -1] += pad
    for _ in range(2):
        word, n = word[:, ::2] << n[:, 1::2] | word[:, 1::2], n[:, ::2] + n[:, 1::2]
    word, n = word.ravel(), n.ravel()
    ends = np.cumsum(n)
    at = ends - n
    place = (at >> np.uint64(6)).astype(np.int64)
    end = (at & np.uint64(63)) + n
    limit = np.uint64(64)
    over = end > limit
    high = np.where(over, word >> np.where(over, end - limit, np.uint64(0)), word << np.where(over, np.uint64(0), limit - end))
    out = np.zeros(int(place[-1]) + 2, np.uint64)
    starts = np.concatenate([[0], np.flatnonzero(np.diff(place)) + 1])
    out[place[starts]] = np.bitwise_or.reduceat(high, starts)
    out[place[over] + 1] |= word[over] << (np.uint64(128) - end[over])  # one word at most runs over each place's end
    data = out.astype(">u8").tobytes()
    cuts = np.concatenate([[0], np.cumsum((total + pad) >> np.uint64(3)).astype(np.int64)]).tolist()
    return [data[a:b] for a, b in zip(cuts, cuts[1:])]


def _grid(n: int) -> tuple[int, int]:
    """Width and height in MCUs: about square, with as few MCUs to spare as nearby widths allow."""
    root = int(np.ceil(np.sqrt(n)))
    wide = min(range(max(1, root * 2 // 3), root + 1), key=lambda w: (w * -(-n // w), -w))
    return wide, -(-n // wide)


def write(payloads: list[bytes]) -> list[bytes]:
    """A JPEG for each payload; their lengths are positive multiples of 192."""
    grids, blocks = [], []
    for p in payloads:
        n = len(p) // UNIT
        if not n or len(p) % UNIT:
            raise ValueError("the payload is a positive multiple of 192 bytes")
        grids.append(_grid(n))
        if max(grids[-1]) * 8 > 65535:
            raise ValueError("the payload is larger than the format's largest image")
        blocks += [p, b" " * (grids[-1][0] * grids[-1][1] * UNIT - len(p))]
    data = np.frombuffer(b"".join(blocks), np.uint8)
    scans: list[bytes] = []
    for at in range(0, len(data), LANES * UNIT):
        scans += _scans(data[at : at + LANES * UNIT])
    marks = [bytes([0xFF, 0xD0 + i]) for i in range(8)]
    out, first = [], 0
    for p, (wide, high) in zip(payloads, grids):
        parts = [
            b"\xff\xd8", _segment(0xFE, b"payload %d" % len(p)), _segment(0xDB, b"\0" + b"\1" * 64),
            _segment(0xC0, struct.pack(">BHHB", 8, high * 8, wide * 8, 3) + bytes([1, 0x11, 0, 2, 0x11, 0, 3, 0x11, 0])),
            _segment(0xC4, _DC + _AC), _segment(0xDD, struct.pack(">H", 1)), _segment(0xDA, bytes([3, 1, 0, 2, 0, 3, 0, 0, 63, 0])),
        ]
        for m, scan in enumerate(scans[first : first + wide * high]):
            if m:
                parts.append(marks[(m - 1) % 8])
            parts.append(scan.replace(b"\xff", b"\xff\0"))
        first += wide * high
        out.append(b"".join([*parts, b"\xff\xd9"]))
    return out


class Header:
    """What the markers before the scan say."""

    def __init__(self, data: bytes):
        if data[:2] != b"\xff\xd8":
            raise JpegError("no start of image")
        self.quant: dict[int, np.ndarray] = {}
        self.huffman: dict[int, tuple] = {}
        self.interval, self.comment, self.parts = 0, b"", []
        at = 2
        while True:
            if at + 4 > len(data):
                raise JpegError("no scan")
            if data[at] != 0xFF:
                raise JpegError("no marker where one was due")
            marker = data[at + 1]
            if marker == 0xFF:
                at += 1
                continue
            size = struct.unpack_from(">H", data, at + 2)[0]
            body = data[at + 4 : at + 2 + size]
            at += 2 + size
            if marker == 0xDB:
                self._tables(body)
            elif marker == 0xC4:
                k = 0
                while k < len(body):
                    n = sum(body[k + 1 : k + 17])
                    self.huffman[body[k]] = (tuple(body[k + 1 : k + 17]), tuple(body[k + 17 : k + 17 + n]))
                    k += 17 + n
            elif marker == 0xC0:
                bits, self.height, self.width, n = struct.unpack_from(">BHHB", body)
                if bits != 8:
                    raise JpegError("not 8 bits a sample")
                self.parts = [(body[6 + 3 * i], body[7 + 3 * i] >> 4, body[7 + 3 * i] & 15, body[8 + 3 * i]) for i in range(n)]
            elif 0xC1 <= marker <= 0xCF and marker != 0xC8 and marker != 0xCC:
                raise JpegError("not baseline sequential")
            elif marker == 0xDD:
                self.interval = struct.unpack(">H", body[:2])[0]
            elif marker == 0xFE:
                self.comment = body
            elif marker == 0xDA:
                tables = {body[1 + 2 * i]: body[2 + 2 * i] for i in range(body[0])}
                break
        if not self.parts or set(tables) != {p[0] for p in self.parts}:
            raise JpegError("the scan doesn't hold all components")
        self.scan = at
        high, wide = max(p[2] for p in self.parts), max(p[1] for p in self.parts)
        single = len(self.parts) == 1
        unit = (8, 8) if single else (8 * wide, 8 * high)
        self.across, self.down = -(-self.width // unit[0]), -(-self.height // unit[1])
        #: Blocks of an MCU in coding order: component and its two Huffman tables.
        self.blocks = [
            (c, tables[p[0]] >> 4, tables[p[0]] & 15 | 16) for c, p in enumerate(self.parts) for _ in range(1 if single else p[1] * p[2])
        ]
        self.luma = (1, 1) if single else self.parts[0][1:3]

    def _tables(self, body: bytes) -> None:
        k = 0
        while k < len(body):
            wide = body[k] >> 4
            values = np.frombuffer(body, ">u2" if wide else np.uint8, 64, k + 1)
            table = np.zeros(64, np.int64)
            table[ZIGZAG] = values
            self.quant[body[k] & 15] = table
            k += 65 + 64 * wide


def _unstuff(scan: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The scan's data bytes, and where each restart interval starts among them."""
    ff = np.flatnonzero(scan[:-1] == 0xFF)
    after = scan[ff + 1]
    ends = ff[(after != 0) & ((after < 0xD0) | (after > 0xD7)) & (after != 0xFF)]
    if len(ends):
        scan = scan[: ends[0]]
        ff = ff[ff < ends[0]]
        after = after[: len(ff)]
    keep = np.ones(len(scan), bool)
    keep[ff[after == 0] + 1] = False
    marks = ff[(after >= 0xD0) & (after <= 0xD7)]
    keep[marks] = keep[marks + 1] = False
    new = np.cumsum(keep)
    return scan[keep], np.concatenate([[0], new[marks]])


_TABLES: dict[tuple, tuple[np.ndarray, np.ndarray]] = {}


def _table(spec: tuple) -> tuple[np.ndarray, np.ndarray]:
    """A table's lookups, kept for the next file that has the same one."""
    if spec not in _TABLES:
        if len(_TABLES) > 64:
            _TABLES.clear()
        full = _lookup(list(spec[0]), list(spec[1]))
        _TABLES[spec] = full, _short(full)
    return _TABLES[spec]


def read(files: list[bytes]) -> list[tuple[Header, np.ndarray]]:
    """Each file's header and quantised coefficients (MCUs, blocks an MCU, 64) in zigzag order."""
    heads = [Header(f) for f in files]
    out = [np.zeros((h.across * h.down, len(h.blocks), 64), np.int16) for h in heads]
    by_layout: dict[tuple, list[int]] = {}
    for i, h in enumerate(heads):
        by_layout.setdefault((tuple(h.blocks), tuple(sorted(h.huffman.items()))), []).append(i)
    for (blocks, huffman), group in by_layout.items():
        specs = dict(huffman)
        used = sorted({t for b in blocks for t in b[1:]})
        if any(t not in specs for t in used):
            raise JpegError("a Huffman table is missing")
        tables = [_table(specs[t]) for t in used]
        lanes: list[tuple[int, int, int, int, int]] = []  # file, first MCU, MCUs, first byte, bytes
        data, base = [], 0
        for i in group:
            h = heads[i]
            body, starts = _unstuff(np.frombuffer(files[i], np.uint8, offset=h.scan))
            total, step = h.across * h.down, h.interval or h.across * h.down
            ends = [*starts[1:].tolist(), len(body)]
            if len(starts) != -(-total // step):
                raise JpegError("restart markers don't fit")
            for k, (a, b) in enumerate(zip(starts.tolist(), ends)):
                lanes.append((i, k * step, min(step, total - k * step), base + a, base + b))
            data.append(body)
            base += len(body)
        stream = np.concatenate([*data, np.full(16, 255, np.uint8)])
        for at in range(0, len(lanes), LANES):
            _decode(lanes[at : at + LANES], stream, blocks, used, tables, out)
    return list(zip(heads, out))


def _short(table: np.ndarray) -> np.ndarray:
    """Of 16 bits ahead, where they hold a code without a run and all of its value's bits: value << 8 | bits; else 0."""
    bits, symbol = table >> 8, table & 255
    s = symbol & 15
    whole = (bits > 0) & (symbol >> 4 == 0) & (bits + s <= 16)
    look = np.arange(1 << 16)
    value = (look >> np.maximum(16 - bits - s, 0)) & ((1 << s) - 1)
    value = np.where((s > 0) & (value < (1 << np.maximum(s - 1, 0))), value - (1 << s) + 1, value)
    return np.where(whole, value * 256 + bits + s, 0).astype(np.int32)


def _decode(lanes, stream, blocks, used, tables, out) -> None:
    """One symbol of every lane a step, until all lanes are through."""
    n, nb = len(lanes), len(blocks)
    info = np.array(lanes, np.int64)
    most = int(info[:, 2].max())
    got = np.zeros((most * nb, 64, n), np.int16)
    component = np.array([b[0] for b in blocks])
    dc, ac = np.array([used.index(b[1]) for b in blocks]), np.array([used.index(b[2]) for b in blocks])
    low, high = int(info[:, 3].min()), int(info[:, 4].max())
    stream = stream[low : high + 16].astype(np.uint32)
    pos, last = (info[:, 3] - low) * 8, (info[:, 4] - low) * 8
    todo = info[:, 2] * nb
    block, k = np.zeros(n, np.int64), np.zeros(n, np.int64)
    pred = np.zeros((n, component.max() + 1), np.int64)
    # 32 bits from each byte on, so that a symbol (16) and its value (11) come from two looks.
    ahead = ((stream[:-3] << 24) | (stream[1:-2] << 16) | (stream[2:-1] << 8) | stream[3:]).astype(np.int64)
    top = len(ahead) - 1
    # While every lane is at the same coefficient and none has a run, a step is one look each.
    short = [t[1] for t in tables]
    b0, k0 = 0, 0
    while b0 < int(todo.min()):
        t = (dc if k0 == 0 else ac)[b0 % nb]
        hit = short[t][(ahead[np.minimum(pos >> 3, top)] >> (16 - (pos & 7))) & 0xFFFF]
        if not hit.all() or (k0 and (hit >> 8 == 0).any()):
            break
        value = hit >> 8
        if k0 == 0:
            c = component[b0 % nb]
            value = pred[:, c] = pred[:, c] + value
        got[b0, k0] = value
        pos = pos + (hit & 255)
        b0, k0 = (b0 + 1, 0) if k0 == 63 else (b0, k0 + 1)
    if (pos > last + 7).any():
        raise JpegError("the scan is damaged")
    block[:], k[:] = b0, k0
    tables = np.stack([t[0] for t in tables])
    live = np.flatnonzero(block < todo)
    while len(live):
        p, kk, b = pos[live], k[live], block[live]
        in_mcu = b % nb
        first = kk == 0
        look = (ahead[np.minimum(p >> 3, top)] >> (16 - (p & 7))) & 0xFFFF
        hit = tables[np.where(first, dc[in_mcu], ac[in_mcu]), look]
        bits, symbol = hit >> 8, hit & 255
        if not bits.all():
            raise JpegError("a code that no table has")
        p = p + bits
        s = symbol & 15
        run = np.where(first, 0, symbol >> 4)
        value = (ahead[np.minimum(p >> 3, top)] >> (32 - (p & 7) - s)) & ((1 << s) - 1)
        value = np.where((s > 0) & (value < (1 << np.maximum(s - 1, 0))), value - (1 << s) + 1, value)
        p = p + s
        c = component[in_mcu]
        value = np.where(first, pred[live, c] + value, value)
        pred[live[first], c[first]] = value[first]
        at = kk + run
        store = first | (s > 0)
        if (at[store] > 63).any() or (p > last[live] + 7).any():
            raise JpegError("the scan is damaged")
        got[b[store], at[store], live[store]] = value[store]
        # End of block (run 0), sixteen zeros (run 15), or on to the next coefficient.
        nxt = np.where(~first & (s == 0) & (run != 15), 64, at + 1)
        over = nxt >= 64
        k[live] = np.where(over, 0, nxt)
        block[live] = b + over
        pos[live] = p
        if over.any():
            live = live[block[live] < todo[live]]
    got = np.ascontiguousarray(got.transpose(2, 0, 1))
    runs = np.flatnonzero(np.diff(info[:, 0], prepend=-1)).tolist() + [n]
    for a, b in zip(runs, runs[1:]):  # lanes of one file
        i = lanes[a][0]
        if b - a == 1 or (info[a:b, 2] == most).all():
            m = int(info[a:b, 2].sum())
            out[i][lanes[a][1] : lanes[a][1] + m] = got[a:b, : (m if b - a == 1 else most) * nb].reshape(m, nb, 64)
        else:
            for j in range(a, b):
                m = lanes[j][2]
                out[i][lanes[j][1] : lanes[j][1] + m] = got[j, : m * nb].reshape(m, nb, 64)


def payload_of(head: Header, coefficients: np.ndarray) -> bytes:
    """The payload that :func:`write` stored."""
    word, _, size = head.comment.partition(b" ")
    if word != b"payload" or not size.isdigit():
        raise JpegError("not written by this writer")
    v = coefficients.reshape(-1).astype(np.int64)
    return np.where(v < 0, v + 128, v + 127).astype(np.uint8).tobytes()[: int(size)]


def thumbnail(head: Header, coefficients: np.ndarray) -> np.ndarray:
    """The luminance at an eighth of the size, from DC coefficients alone: a sample is DC * q / 8 + 128."""
    h, v = head.luma
    n = h * v
    dc = coefficients[:, :n, 0].astype(np.int64) * int(head.quant[head.parts[0][3]][0])
    grid = dc.reshape(head.down, head.across, v, h).transpose(0, 2, 1, 3).reshape(head.down * v, head.across * h)
    grid = grid[: -(-head.height // 8), : -(-head.width // 8)]
    return np.clip((grid >> 3) + 128, 0, 255).astype(np.uint8)


def thumbnail_hash(thumb: np.ndarray, side: int = 8) -> str:
    """Average hash: the thumbnail's mean over side x side cells, each bit whether a cell is above the cells' mean."""
    rows = np.arange(side + 1) * thumb.shape[0] // side
    cols = np.arange(side + 1) * thumb.shape[1] // side
    total = np.zeros((thumb.shape[0] + 1, thumb.shape[1] + 1), np.int64)
    total[1:, 1:] = thumb.astype(np.int64).cumsum(0).cumsum(1)
    r0, r1 = np.minimum(rows[:-1], thumb.shape[0] - 1), np.maximum(rows[1:], np.minimum(rows[:-1], thumb.shape[0] - 1) + 1)
    c0, c1 = np.minimum(cols[:-1], thumb.shape[1] - 1), np.maximum(cols[1:], np.minimum(cols[:-1], thumb.shape[1] - 1) + 1)
    cell = total[r1][:, c1] - total[r0][:, c1] - total[r1][:, c0] + total[r0][:, c0]
    mean = cell / ((r1 - r0)[:, None] * (c1 - c0)[None, :])
    return np.packbits(mean.ravel() > mean.mean()).tobytes().hex()


def digest(thumb: np.ndarray) -> str:
    return hashlib.sha256(thumb.tobytes()).hexdigest()[:16]
