"""Progressive JPEG in numpy: scans accumulate into coefficient arrays, which become RGB tensors.

The decoder takes progressive files (SOF2, Huffman, any scans and tables, sampling factors 1 and 2): DC and AC scans,
first passes and refinements. Scans whose codes make every value the same number of bits are read at once as arrays;
all others bit by bit.

The encoder stores a payload of bytes losslessly in the quantised coefficients, 64 a block: byte 0 of a block is the
DC value itself, the others become AC values of magnitude 2 or more (below 128: byte - 130; else byte - 126), so that
each has a non-zero first approximation. With code lengths of 8 minus the value's size, every value of a first scan
takes one byte, and a block of a refinement 64 bits.
"""

from __future__ import annotations

import struct
from functools import lru_cache

import numpy as np

#: Fixed values of the format: the order of coefficients in a block.
ZIGZAG = np.array([
    0, 1, 8, 16, 9, 2, 3, 10, 17, 24, 32, 25, 18, 11, 4, 5, 12, 19, 26, 33, 40, 48, 41, 34, 27, 20, 13, 6, 7, 14, 21, 28,
    35, 42, 49, 56, 57, 50, 43, 36, 29, 22, 15, 23, 30, 37, 44, 51, 58, 59, 52, 45, 38, 31, 39, 46, 53, 60, 61, 54, 47, 55, 62, 63,
])

MCU_WIDTH = 32  # 16 x 16 pixel units in a row of an encoded payload


def _basis() -> np.ndarray:
    """(64 zigzag coefficients) @ basis = 64 pixels."""
    x = np.arange(8)
    c = np.cos((2 * x[None, :] + 1) * x[:, None] * np.pi / 16) * np.where(x == 0, np.sqrt(1 / 8), 0.5)[:, None]
    full = np.einsum("vy,ux->vuyx", c, c).reshape(64, 64)
    return full[ZIGZAG].astype(np.float32)


BASIS = _basis()


# --- Huffman tables -----------------------------------------------------------------------------------------------


def canonical(counts: bytes, symbols: bytes) -> dict[int, tuple[int, int]]:
    """symbol -> (code, length)."""
    out, code, at = {}, 0, 0
    for length in range(1, 17):
        for _ in range(counts[length - 1]):
            out[symbols[at]] = (code, length)
            code, at = code + 1, at + 1
        code <<= 1
    return out


def _value(size: int, bits: int) -> int:
    return bits if size == 0 or bits >> (size - 1) else bits - (1 << size) + 1


@lru_cache(256)
def byte_values(counts: bytes, symbols: bytes, ac: bool) -> np.ndarray | None:
    """If every code and its extra bits are 8 bits together (and, for AC, every symbol is a value without a run):
    the value of each byte; bytes that no code begins are -32768. Else None."""
    table = canonical(counts, symbols)
    if not table or any(length + (s & 15) != 8 or (ac and (s >> 4 or not s & 15)) for s, (_, length) in table.items()):
        return None
    out = np.full(256, -32768, np.int32)
    for s, (code, length) in table.items():
        for bits in range(1 << (8 - length)):
            out[code << (8 - length) | bits] = _value(s & 15, bits)
    return out


def _table(lengths: dict[int, int]) -> tuple[bytes, bytes]:
    """(counts, symbols) of a table with these symbols' code lengths."""
    order = sorted(lengths, key=lambda s: (lengths[s], s))
    return bytes(sum(n == k for n in lengths.values()) for k in range(1, 17)), bytes(order)


# --- encoder ------------------------------------------------------------------------------------------------------

_DC_FIRST = _table({s: 8 - s for s in range(8)})
_AC_FIRST = _table({s: 8 - s for s in range(1, 8)})
_AC_REFINE = _table({0: 1, 1: 2})


def _coded(value: int, table: dict[int, tuple[int, int]]) -> int:
    size = abs(value).bit_length()
    return table[size][0] << size | (value if value >= 0 else value + (1 << size) - 1)


_AC_OF_BYTE = np.where(np.arange(256) < 128, np.arange(256) - 130, np.arange(256) - 126)
_AC_BYTE = np.array([_coded((abs(int(v)) >> 1) * (1 if v > 0 else -1), canonical(*_AC_FIRST)) for v in _AC_OF_BYTE], np.uint8)
_AC_LOW = (np.abs(_AC_OF_BYTE) & 1).astype(np.uint8)
_DC_BYTE = np.array([_coded(d, canonical(*_DC_FIRST)) for d in range(-127, 128)], np.uint8)


def _segment(marker: int, body: bytes) -> bytes:
    return struct.pack(">BBH", 0xFF, marker, len(body) + 2) + body


def _scan(component: int, tables: int, ss: int, se: int, ah: int, al: int, data: bytes) -> bytes:
    return _segment(0xDA, bytes([1, component, tables, ss, se, ah << 4 | al])) + data


_HEAD = _segment(0xDB, b"\0" + b"\1" * 64)
_TABLES = _segment(0xC4, b"\x00" + b"".join(_DC_FIRST)) + _segment(0xC4, b"\x10" + b"".join(_AC_FIRST)) + _segment(0xC4, b"\x11" + b"".join(_AC_REFINE))


def encode_payload(payload: bytes, note: bytes = b"") -> bytes:
    """A progressive 4:2:0 file whose coefficients hold payload (a multiple of 64 bytes); note is its comment."""
    blocks = len(payload) // 64
    units = max(1, -(-blocks // 6))
    wide = min(units, MCU_WIDTH)
    high = -(-units // wide)
    if high * 16 > 65535:
        wide = min(4095, -(-units // 4095))
        high = -(-units // wide)
    if high > 4095:
        raise ValueError("payload too large for one file of this format")
    units = wide * high
    b = np.zeros((units * 6, 64), np.uint8)
    b.reshape(-1)[: len(payload)] = np.frombuffer(payload, np.uint8)
    parts = (b[: units * 4], b[units * 4 : units * 5], b[units * 5 :])
    frame = struct.pack(">BHHB", 8, high * 16, wide * 16, 3) + bytes([1, 0x22, 0, 2, 0x11, 0, 3, 0x11, 0])
    out = [b"\xff\xd8", _segment(0xFE, note) if note else b"", _HEAD, _segment(0xC2, frame), _TABLES]
    low = [_AC_LOW[p] for p in parts]
    for c, p in enumerate(parts, 1):
        high_bits = p[:, 0].astype(np.int64) >> 1
        out.append(_scan(c, 0x00, 0, 0, 0, 1, _DC_BYTE[np.diff(high_bits, prepend=0) + 127].tobytes()))
    for ss, se in ((1, 5), (6, 63)):
        for c, p in enumerate(parts, 1):
            out.append(_scan(c, 0x00, ss, se, 0, 1, _AC_BYTE[p[:, ss : se + 1]].tobytes()))
    for c, p in enumerate(parts, 1):
        bits = p[:, 0] & 1
        pad = np.ones(-len(bits) % 8, np.uint8)
        out.append(_scan(c, 0x00, 0, 0, 1, 0, np.packbits(np.concatenate([bits, pad])).tobytes().replace(b"\xff", b"\xff\0")))
    for c, x in enumerate(low, 1):
        x[:, 0] = 0  # one zero bit: the block's end-of-band code
        out.append(_scan(c, 0x01, 1, 63, 1, 0, np.packbits(x, axis=None).tobytes().replace(b"\xff", b"\xff\0")))
    return b"".join(out) + b"\xff\xd9"


def coefficients_to_payload(image: Progressive) -> bytes:
    """The bytes that encode_payload stored."""
    c = np.concatenate([x.reshape(-1, 64) for x in image.coefficients])
    out = np.where(c < 0, c + 130, c + 126).astype(np.uint8)
    out[:, 0] = c[:, 0]
    return out.tobytes()


# --- decoder ------------------------------------------------------------------------------------------------------


class _Bits:
    def __init__(self, data: bytes):
        self.bits = np.unpackbits(np.frombuffer(data, np.uint8)).tolist()
        self.at = 0

    def take(self, n: int) -> int:
        v = 0
        for _ in range(n):
            if self.at >= len(self.bits):
                raise ValueError("the scan ends too early")
            v = v << 1 | self.bits[self.at]
            self.at += 1
        return v

    def symbol(self, codes: dict[tuple[int, int], int]) -> int:
        code = 0
        for length in range(1, 17):
            code = code << 1 | self.take(1)
            if (length, code) in codes:
                return codes[length, code]
        raise ValueError("a code that no table has")


class Progressive:
    """A decoded progressive file: coefficients[c] has the shape (block rows, block columns, 64), in zigzag order."""

    def __init__(self, data: bytes, max_pixels: int = 1 << 25):
        if data[:2] != b"\xff\xd8":
            raise ValueError("no file of this format")
        self.max_pixels = max_pixels
        raw = np.frombuffer(data, np.uint8)
        nxt = raw[1:]
        marks = np.flatnonzero((raw[:-1] == 255) & (nxt != 0) & (nxt != 255) & ((nxt < 0xD0) | (nxt > 0xD7)))
        self.note, self.quant, self.tables, self.restart = b"", {}, {}, 0
        at = 2
        while data[at + 1] != 0xD9:
            marker, size = data[at + 1], int.from_bytes(data[at + 2 : at + 4], "big")
            if data[at] != 0xFF or size < 2:
                raise ValueError("a segment that is none")
            body, at = data[at + 4 : at + 2 + size], at + 2 + size
            if marker == 0xFE:
                self.note = body
            elif marker == 0xDB:
                self._quantisers(body)
            elif marker == 0xC4:
                self._huffman(body)
            elif marker == 0xDD:
                self.restart = int.from_bytes(body[:2], "big")
            elif marker == 0xC2:
                self._frame(body)
            elif 0xC0 <= marker <= 0xCF and marker not in (0xC8, 0xCC):
                raise ValueError("not a progressive Huffman file")
            elif marker == 0xDA:
                end = int(marks[np.searchsorted(marks, at)])
                self._scan(body, data[at:end])
                at = end

    def _quantisers(self, body: bytes) -> None:
        while body:
            wide, key = body[0] >> 4, body[0] & 15
            n = 128 if wide else 64
            self.quant[key] = np.frombuffer(body[1 : 1 + n], ">u2" if wide else np.uint8).astype(np.int32)
            body = body[1 + n :]

    def _huffman(self, body: bytes) -> None:
        while body:
            n = sum(body[1:17])
            self.tables[body[0]] = (body[1:17], body[17 : 17 + n])
            body = body[17 + n :]

    def _frame(self, body: bytes) -> None:
        depth, self.height, self.width, n = struct.unpack(">BHHB", body[:6])
        if depth != 8 or n not in (1, 3) or not 0 < self.height * self.width <= self.max_pixels:
            raise ValueError("a frame that is not read")
        self.parts = [(body[6 + 3 * i], body[7 + 3 * i] >> 4, body[7 + 3 * i] & 15, body[8 + 3 * i]) for i in range(n)]
        if any(h not in (1, 2) or v not in (1, 2) for _, h, v, _ in self.parts):
            raise ValueError("a sampling factor that is not read")
        self.h, self.v = max(p[1] for p in self.parts), max(p[2] for p in self.parts)
        self.units = -(-self.height // (8 * self.v)), -(-self.width // (8 * self.h))
        self.coefficients = [np.zeros((self.units[0] * v, self.units[1] * h, 64), np.int32) for _, h, v, _ in self.parts]

    def _scan(self, head: bytes, data: bytes) -> None:
        n = head[0]
        which = [(next(i for i, p in enumerate(self.parts) if p[0] == head[1 + 2 * j]), head[2 + 2 * j]) for j in range(n)]
        ss, se, ah, al = head[1 + 2 * n], head[2 + 2 * n], head[3 + 2 * n] >> 4, head[3 + 2 * n] & 15
        if se > 63 or ss > se or (ss == 0) != (se == 0) or ss and n > 1 or al > 13:
            raise ValueError("a scan that no progressive file has")
        clean = data.replace(b"\xff\0", b"\xff")
        if n == 1 and not self.restart and self._at_once(which[0][0], which[0][1], ss, se, ah, al, clean):
            return
        pieces = [clean]
        if self.restart:
            raw, pieces, cut = data, [], 0
            for i in range(len(raw) - 1):
                if raw[i] == 255 and 0xD0 <= raw[i + 1] <= 0xD7:
                    pieces.append(raw[cut:i].replace(b"\xff\0", b"\xff"))
                    cut = i + 2
            pieces.append(raw[cut:].replace(b"\xff\0", b"\xff"))
        self._by_bits(which, ss, se, ah, al, pieces)

    def _grid(self, c: int) -> np.ndarray:
        """A view of the blocks that a scan of component c alone has."""
        _, h, v, _ = self.parts[c]
        rows = -(-(-(-self.height * v // self.v)) // 8)
        cols = -(-(-(-self.width * h // self.h)) // 8)
        return self.coefficients[c][:rows, :cols]

    def _at_once(self, c: int, tables: int, ss: int, se: int, ah: int, al: int, data: bytes) -> bool:
        grid = self._grid(c)
        blocks, x = grid.shape[0] * grid.shape[1], np.frombuffer(data, np.uint8)
        if ss == 0 and ah:
            if len(x) < -(-blocks // 8):
                return False
            grid[:, :, 0] |= (np.unpackbits(x)[:blocks].astype(np.int32) << al).reshape(grid.shape[:2])
            return True
        if ah == 0:
            key = tables >> 4 if ss == 0 else 16 | tables & 15
            values = byte_values(*self.tables[key], ss > 0)
            if values is None or len(x) != blocks * (se - ss + 1):
                return False
            v = values[x]
            if (v == -32768).any():
                return False
            if ss == 0:
                grid[:, :, 0] = (np.cumsum(v) << al).reshape(grid.shape[:2])
            else:
                grid[:, :, ss : se + 1] = (v << al).reshape(*grid.shape[:2], se - ss + 1)
            return True
        code, length = canonical(*self.tables[16 | tables & 15]).get(0, (0, 99))
        n = se - ss + 1
        band = grid[:, :, ss : se + 1]
        if length > 16 or len(x) != -(-blocks * (length + n) // 8) or not band.all():
            return False
        bits = np.unpackbits(x)[: blocks * (length + n)].reshape(blocks, length + n)
        if (bits[:, :length] != [code >> (length - 1 - i) & 1 for i in range(length)]).any():
            return False
        more = bits[:, length:].reshape(band.shape).astype(np.int32) << al
        band += np.where(band < 0, -more, more)
        return True

    def _by_bits(self, which: list[tuple[int, int]], ss: int, se: int, ah: int, al: int, pieces: list[bytes]) -> None:
        if len(which) == 1:
            grid = self._grid(which[0][0])
            order = [[(which[0][0], which[0][1], r, q)] for r in range(grid.shape[0]) for q in range(grid.shape[1])]
        else:
            order = [[(c, t, r * self.parts[c][2] + y, q * self.parts[c][1] + x) for c, t in which for y in range(self.parts[c][2]) for x in range(self.parts[c][1])] for r in range(self.units[0]) for q in range(self.units[1])]
        codes = {k: {(n, code): s for s, (code, n) in canonical(*t).items()} for k, t in self.tables.items()}
        step = self.restart or len(order)
        for p, piece in enumerate(pieces):
            bits, last, run = _Bits(piece), dict.fromkeys((c for c, _ in which), 0), 0
            for unit in order[p * step : (p + 1) * step]:
                for c, t, r, q in unit:
                    block = self.coefficients[c][r, q]
                    if ss == 0 and ah:
                        block[0] |= bits.take(1) << al
                    elif ss == 0:
                        size = bits.symbol(codes[t >> 4])
                        last[c] += _value(size, bits.take(size))
                        block[0] = last[c] << al
                    elif ah == 0:
                        run = self._first(block, bits, codes[16 | t & 15], ss, se, al, run)
                    else:
                        run = self._refine(block, bits, codes[16 | t & 15], ss, se, al, run)

    @staticmethod
    def _first(block: np.ndarray, bits: _Bits, codes: dict, ss: int, se: int, al: int, run: int) -> int:
        if run:
            return run - 1
        k = ss
        while k <= se:
            s = bits.symbol(codes)
            skip, size = s >> 4, s & 15
            if not size and skip < 15:
                return (1 << skip) + bits.take(skip) - 1
            k += skip
            if size:
                v = _value(size, bits.take(size))
                block[k] = v << al if v > 0 else -(-v << al)
            k += 1
        return 0

    @staticmethod
    def _refine(block: np.ndarray, bits: _Bits, codes: dict, ss: int, se: int, al: int, run: int) -> int:
        def correct(k: int) -> None:
            if bits.take(1):
                block[k] += (1 << al) if block[k] > 0 else -(1 << al)

        k = ss
        if not run:
            while k <= se:
                s = bits.symbol(codes)
                skip, size, new = s >> 4, s & 15, 0
                if size:
                    new = (1 << al) if bits.take(1) else -(1 << al)
                elif skip < 15:
                    run = (1 << skip) + bits.take(skip)
                    break
                while k <= se:
                    if block[k]:
                        correct(k)
                    elif skip == 0:
                        block[k] = new
                        k += 1
                        break
                    else:
                        skip -= 1
                    k += 1
        if run:
            while k <= se:
                if block[k]:
                    correct(k)
                k += 1
            run -= 1
        return run

    def planes(self) -> list[np.ndarray]:
        """Inverse transform of each component, 0 to 255."""
        out = []
        for (_, _, _, q), c in zip(self.parts, self.coefficients, strict=True):
            rows, cols, _ = c.shape
            pix = (c.reshape(-1, 64) * self.quant[q]).astype(np.float32) @ BASIS
            pix = pix.reshape(rows, cols, 8, 8).swapaxes(1, 2).reshape(rows * 8, cols * 8)
            out.append(np.clip(pix + 128, 0, 255))
        return out

    def rgb(self) -> np.ndarray:
        """(height, width, 3) uint8; chroma repeated to full resolution."""
        full = [np.repeat(np.repeat(p, self.v // v, 0) if self.v > v else p, self.h // h, 1) if self.h > h else p for p, (_, h, v, _) in zip(self.planes(), self.parts, strict=True)]
        full = [p[: self.height, : self.width] for p in full]
        if len(full) == 1:
            return np.rint(np.repeat(full[0][:, :, None], 3, 2)).astype(np.uint8)
        y, cb, cr = full[0], full[1] - 128, full[2] - 128
        out = np.empty((self.height, self.width, 3), np.uint8)
        for i, p in enumerate((y + np.float32(1.402) * cr, y - np.float32(0.344136) * cb - np.float32(0.714136) * cr, y + np.float32(1.772) * cb)):
            out[:, :, i] = np.rint(np.clip(p, 0, 255))
        return out
