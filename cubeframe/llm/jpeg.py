"""Progressive JPEG in numpy: scans of coefficients, read and written in lock step.

Every restart interval is a lane; all lanes of a scan, of many images, are decoded at once, one
symbol of each per step. Scans accumulate into coefficient arrays by spectral selection and
successive approximation; the arrays are inverse-transformed, chroma is upsampled, and RGB comes
out at full resolution.
"""

from __future__ import annotations

import re
import struct
from dataclasses import dataclass, field
from functools import lru_cache

import numpy as np

ZIGZAG = np.array(sorted(range(64), key=lambda i: (i // 8 + i % 8, i // 8 if (i // 8 + i % 8) % 2 else i % 8)))
"""Row-major place of each coefficient in scan order: along diagonals, alternating in direction."""

_FIX = 13
_n = np.arange(8)
#: Inverse transform in fixed point: exact in doubles, so no result depends on the order of sums.
BASIS = np.rint(np.where(_n[:, None] == 0, np.sqrt(0.125), 0.5) * np.cos((2 * _n[None, :] + 1) * _n[:, None] * np.pi / 16) * (1 << _FIX))

#: Blocks of one component coded together at most, which bounds memory; a multiple of 8.
LANES = 1 << 14


# --- Huffman tables ---------------------------------------------------------


def code_lengths(counts: np.ndarray) -> np.ndarray:
    """Lengths (at most 16) of a prefix code for symbol counts, leaving the code of all ones free."""
    symbols = np.flatnonzero(counts)
    lengths = np.zeros(len(counts), np.int64)
    nodes = [(int(counts[s]), [int(s)]) for s in symbols] + [(0, [-1])]
    if len(nodes) == 1:
        return lengths
    while len(nodes) > 1:
        nodes.sort(key=lambda x: (x[0], -len(x[1])), reverse=True)
        (a, xs), (b, ys) = nodes.pop(), nodes.pop()
        for s in xs + ys:
            if s >= 0:
                lengths[s] += 1
        nodes.append((a + b, xs + ys))
    while lengths.max() > 16 or np.sum(2.0 ** -lengths[lengths > 0]) > 1 - 2.0**-16:
        if lengths.max() > 16:
            lengths = np.minimum(lengths, 16)
        if np.sum(2.0 ** -lengths[lengths > 0]) > 1 - 2.0**-16:
            short = np.flatnonzero((lengths > 0) & (lengths < 16))
            lengths[short[lengths[short].argmax()]] += 1
    return lengths


@dataclass
class Huffman:
    """A canonical code: symbols in order of length, then value."""

    bits: list[int]
    values: list[int]
    code: np.ndarray = field(init=False)
    size: np.ndarray = field(init=False)
    table: np.ndarray = field(init=False)

    def __post_init__(self) -> None:
        self.code, self.size = np.zeros(256, np.uint64), np.zeros(256, np.int64)
        self.table = np.zeros(1 << 16, np.uint16)  # by the next 16 bits: length << 8 | symbol
        code, k = 0, 0
        for length, n in enumerate(self.bits, 1):
            for _ in range(n):
                symbol = self.values[k]
                self.code[symbol], self.size[symbol] = code, length
                self.table[code << (16 - length) : (code + 1) << (16 - length)] = length << 8 | symbol
                code, k = code + 1, k + 1
            code <<= 1

    @classmethod
    def fit(cls, symbols: np.ndarray) -> Huffman:
        lengths = code_lengths(np.bincount(symbols, minlength=256))
        used = sorted(np.flatnonzero(lengths).tolist(), key=lambda s: (lengths[s], s))
        return cls([int((lengths == n).sum()) for n in range(1, 17)], used)


# --- Structure ---------------------------------------------------------------


@dataclass
class Component:
    ident: int
    h: int
    v: int
    quant: int


@dataclass
class Frame:
    width: int
    height: int
    components: list[Component]

    @property
    def h_max(self) -> int:
        return max(c.h for c in self.components)

    @property
    def v_max(self) -> int:
        return max(c.v for c in self.components)

    def mcus(self) -> tuple[int, int]:
        return -(-self.height // (8 * self.v_max)), -(-self.width // (8 * self.h_max))

    def blocks(self, c: Component) -> tuple[int, int]:
        """Block rows and columns of a component, without padding to whole MCUs."""
        return -(-(-(-self.height * c.v // self.v_max)) // 8), -(-(-(-self.width * c.h // self.h_max)) // 8)

    def padded(self, c: Component) -> tuple[int, int]:
        rows, cols = self.mcus()
        return rows * c.v, cols * c.h

    def order(self, which: list[int]) -> list[tuple[int, np.ndarray]]:
        """For a scan of components: blocks of each MCU, as (component, block index of every MCU)."""
        if len(which) == 1:
            c = self.components[which[0]]
            rows, cols = self.blocks(c)
            return [(which[0], (np.arange(rows)[:, None] * self.padded(c)[1] + np.arange(cols)).ravel())]
        rows, cols = self.mcus()
        y, x = (a.ravel() for a in np.mgrid[:rows, :cols])
        return [(i, (y * c.v + dy) * self.padded(c)[1] + x * c.h + dx) for i in which for c in [self.components[i]] for dy in range(c.v) for dx in range(c.h)]


@dataclass
class Scan:
    which: list[int]
    start: int
    end: int
    high: int
    low: int
    dc: dict[int, Huffman] = field(default_factory=dict)
    ac: Huffman | None = None
    interval: int = 0
    data: bytes = b""


@dataclass
class Image:
    frame: Frame
    quant: dict[int, np.ndarray]
    coefficients: list[np.ndarray]  # of each component: (padded blocks, 64) in scan order


# --- Bits ----------------------------------------------------------------------


def _lanes(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A scan's bytes without stuffing and markers, and the first bit of each restart interval."""
    marked = np.flatnonzero((data[:-1] == 0xFF) & (data[1:] >= 0xD0) & (data[1:] <= 0xD7))
    stuffed = np.flatnonzero((data[:-1] == 0xFF) & (data[1:] == 0))
    gone = np.zeros(len(data), bool)
    gone[stuffed + 1] = True
    gone[marked] = gone[marked + 1] = True
    before = np.cumsum(gone) - gone
    clean = data[~gone]
    cut = marked - before[marked]
    return clean, np.append(0, cut) * 8


class Reader:
    """Bit positions of many lanes over one byte array."""

    def __init__(self, clean: np.ndarray, at: np.ndarray):
        padded = np.concatenate([clean, np.full(16, 0xFF, np.uint8)]).astype(np.uint64)
        word = padded[:-7].copy()
        for k in range(1, 8):
            word <<= np.uint64(8)
            word |= padded[k : len(padded) - 7 + k]
        self.word, self.at = word, at.astype(np.int64)

    def look(self, lanes: np.ndarray | slice) -> np.ndarray:
        """The next bits of lanes, at least 57, from the top."""
        at = self.at[lanes]
        return self.word[np.minimum(at >> 3, len(self.word) - 1)] << (at & 7).astype(np.uint64)


def _extend(value: np.ndarray, size: np.ndarray) -> np.ndarray:
    low = value < (np.int64(1) << np.maximum(size - 1, 0))
    return np.where(low & (size > 0), value - (np.int64(1) << size) + 1, value)


class Writer:
    """Gathers (lane, bits, count) in order and packs them to bytes with stuffing and restart markers."""

    def __init__(self) -> None:
        self.parts: list[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]] = []

    def add(self, lane: np.ndarray, key: np.ndarray, value: np.ndarray, count: np.ndarray) -> None:
        self.parts.append((lane, key, value.astype(np.uint64), count.astype(np.int64)))

    def pack(self, n_lanes: int) -> list[np.ndarray]:
        """Bytes of each lane, padded with ones and stuffed; concatenated, with the ends of lanes."""
        lane, key, value, count = (np.concatenate(x) for x in zip(*self.parts, strict=True)) if self.parts else (np.empty(0, np.int64),) * 4
        if len(self.parts) > 1:
            order = np.lexsort((key, lane))
            lane, value, count = lane[order], value[order], count[order]
        bits = np.bincount(lane, count, n_lanes).astype(np.int64)
        room = (bits + 7) >> 3
        first = np.cumsum(room) - room
        at = np.cumsum(count) - count
        lead = np.cumsum(bits) - bits
        at = at - lead[lane] + first[lane] * 8
        total = int(room.sum())
        # each value has at most 32 bits and touches two 32-bit words
        word, shift = at >> 5, 64 - (at & 31) - count
        spread = value << shift.astype(np.uint64)
        n = (total >> 2) + 2
        both = np.bincount(word, (spread >> np.uint64(32)).astype(np.float64), n) + np.bincount(word + 1, (spread & np.uint64(0xFFFFFFFF)).astype(np.float64), n)[:n]
        out = both.astype(np.uint64).astype(">u4").view(np.uint8)[:total].copy()
        last = first[room > 0] + room[room > 0] - 1
        out[last] |= ((1 << ((-bits[room > 0]) & 7)) - 1).astype(np.uint8)
        return [out, first + room]


def _joined(out: np.ndarray, ends: np.ndarray, lanes_of: np.ndarray, n: int) -> list[bytes]:
    """Scan data of each image: stuffing after FF bytes, restart markers between its lanes."""
    starts = np.append(0, ends[:-1])
    ff = out == 0xFF
    # restart markers follow each lane but an image's last
    last = np.append(lanes_of[1:] != lanes_of[:-1], True)
    number = np.arange(len(ends)) - np.searchsorted(lanes_of, lanes_of)
    size = np.bincount(np.searchsorted(ends, np.flatnonzero(ff), side="right"), minlength=len(ends)) + (ends - starts) + np.where(last, 0, 2)
    place = np.cumsum(size) - size
    made = np.zeros(int(size.sum()), np.uint8)
    before = np.cumsum(ff) - ff
    lane = np.repeat(np.arange(len(ends)), ends - starts)
    seen = np.append(before, before[-1] + ff[-1] if len(ff) else 0)[starts]
    made[place[lane] + (np.arange(len(out)) - starts[lane]) + (before - seen[lane])] = out
    tail = place + size - 2
    made[tail[~last]] = 0xFF
    made[tail[~last] + 1] = 0xD0 + (number[~last] & 7)
    edges = np.searchsorted(lanes_of, np.arange(n + 1))
    cut = np.append(place, len(made))[edges]
    return [made[a:b].tobytes() for a, b in zip(cut[:-1], cut[1:], strict=True)]


# --- Scans ------------------------------------------------------------------------


def _dc_first(reader: Reader, lanes: np.ndarray, table: Huffman, last: np.ndarray) -> np.ndarray:
    bits = reader.look(lanes)
    entry = table.table[(bits >> np.uint64(48)).astype(np.int64)].astype(np.int64)
    length, size = entry >> 8, entry & 255
    value = np.where(size > 0, ((bits << length.astype(np.uint64)) >> (np.uint64(64) - np.maximum(size, 1).astype(np.uint64))).astype(np.int64), 0)
    reader.at[lanes] += length + size
    return last + _extend(value, size)


def decode_scan(scan: Scan, order: list[tuple[int, np.ndarray]], coefficients: list[np.ndarray]) -> None:
    """Add a scan to the coefficient arrays; ``order`` has the blocks of its MCUs."""
    clean, starts = _lanes(np.frombuffer(scan.data, np.uint8)) if scan.data else (np.empty(0, np.uint8), np.zeros(1, np.int64))
    mcus = len(order[0][1])
    interval = scan.interval or mcus
    lanes = np.arange(-(-mcus // interval))
    if len(starts) < len(lanes):
        raise ValueError(f"{len(starts)} restart intervals for {len(lanes)}")
    reader = Reader(clean, starts[: len(lanes)])
    if scan.start == 0:
        last = {i: np.zeros(len(lanes), np.int64) for i in scan.which}
        for step in range(interval):
            mcu = lanes * interval + step
            live = np.flatnonzero(mcu < mcus)
            for i, blocks in order:
                target = blocks[mcu[live]]
                if scan.high:
                    bit = (reader.look(live) >> np.uint64(63)).astype(np.int64)
                    reader.at[live] += 1
                    coefficients[i][target, 0] |= (bit << scan.low).astype(np.int16)
                else:
                    last[i][live] = _dc_first(reader, live, scan.dc[i], last[i][live])
                    coefficients[i][target, 0] = last[i][live] << scan.low
        return
    i, blocks = order[0]
    skip = np.zeros(len(lanes), np.int64)
    for step in range(interval):
        mcu = lanes * interval + step
        live = np.flatnonzero(mcu < mcus)
        resting = live[skip[live] > 0]
        active = live[skip[live] == 0]
        if scan.high:
            _ac_refine(reader, active, resting, blocks, mcu, coefficients[i], scan, skip)
        else:
            skip[resting] -= 1
            _ac_first(reader, active, blocks[mcu[active]], coefficients[i], scan, skip)


def _ac_first(reader: Reader, lanes: np.ndarray, target: np.ndarray, out: np.ndarray, scan: Scan, skip: np.ndarray) -> None:
    table, flat, width = scan.ac.table, out.reshape(-1), out.shape[1]
    k = np.full(len(lanes), scan.start)
    base, word, top = target * width, reader.word, len(reader.word) - 1
    at = reader.at[lanes]
    while len(lanes):
        bits = word[np.minimum(at >> 3, top)] << (at & 7).view(np.uint64)
        entry = table[(bits >> np.uint64(48)).view(np.int64)].astype(np.int64)
        length, run, size = entry >> 8, entry >> 4 & 15, entry & 15
        bits <<= length.view(np.uint64)
        value = (bits >> np.uint64(1) >> (63 - size).view(np.uint64)).view(np.int64)
        at += length + size
        if (plain := size > 0).all():
            k += run
            value += np.where(bits >> np.uint64(63), 0, 1 - (1 << size))
            flat[base + k] = value << scan.low
            k += 1
        else:
            k += np.where(plain | (run == 15), run, 0)
            some = np.flatnonzero(plain)
            flat[base[some] + k[some]] = _extend(value[some], size[some]) << scan.low
            ends = np.flatnonzero(~plain & (run < 15))
            if len(ends):
                extra = np.where(run[ends] > 0, (bits[ends] >> np.uint64(1) >> (63 - run[ends]).astype(np.uint64)).astype(np.int64), 0)
                at[ends] += run[ends]
                skip[lanes[ends]] = (np.int64(1) << run[ends]) + extra - 1
                k[ends] = 64
            k += 1
        if (over := k > scan.end).any():
            reader.at[lanes[over]] = at[over]
            keep = ~over
            lanes, base, k, at = lanes[keep], base[keep], k[keep], at[keep]


def _ac_refine(reader: Reader, active: np.ndarray, resting: np.ndarray, blocks: np.ndarray, mcu: np.ndarray, out: np.ndarray, scan: Scan, skip: np.ndarray) -> None:
    """One correction bit for each coefficient that is not zero, new ones of size 1 at run places.

    Each lane goes coefficient by coefficient: it reads a symbol when it has none pending.
    """
    lanes = np.concatenate([active, resting])
    if not len(lanes):
        return
    one = np.int16(1 << scan.low)
    target = blocks[mcu[lanes]]
    run = np.full(len(lanes), -1, np.int64)  # zeros still to pass; -1: read a symbol; -2: end of band, corrections only
    run[len(active) :] = -2
    fresh = np.zeros(len(lanes), np.int16)
    table = scan.ac.table
    for k in range(scan.start, scan.end + 1):
        need = np.flatnonzero(run == -1)
        if len(need):
            own = lanes[need]
            bits = reader.look(own)
            entry = table[(bits >> np.uint64(48)).astype(np.int64)].astype(np.int64)
            length, r, size = entry >> 8, entry >> 4 & 15, entry & 15
            bits = bits << length.astype(np.uint64)
            ends = (size == 0) & (r < 15)
            extra = np.where(ends & (r > 0), (bits >> np.uint64(1) >> (63 - r).astype(np.uint64)).astype(np.int64), 0)
            reader.at[own] += length + np.where(ends, r, (size > 0).astype(np.int64))
            fresh[need] = np.where(size > 0, np.where(bits >> np.uint64(63), one, -one), 0)
            run[need] = np.where(ends, -2, r)
            stop = need[ends]
            skip[lanes[stop]] = (np.int64(1) << r[ends]) + extra[ends]
        value = out[target, k]
        nonzero = value != 0
        fix = np.flatnonzero(nonzero)
        if len(fix):
            own = lanes[fix]
            bit = (reader.look(own) >> np.uint64(63)).astype(bool)
            reader.at[own] += 1
            change = bit & ((np.abs(value[fix]) & one) == 0)
            out[target[fix], k] = value[fix] + np.where(change, np.sign(value[fix]) * one, 0).astype(np.int16)
        zero = np.flatnonzero(~nonzero & (run >= 0))
        if len(zero):
            here = zero[run[zero] == 0]
            out[target[here], k] = fresh[here]
            run[zero] -= 1  # 0 becomes -1: a symbol is due
    skip[lanes[run == -2]] -= 1


# --- Files --------------------------------------------------------------------------


_MARKER = re.compile(rb"\xff[^\x00\xd0-\xd7]")


@lru_cache(maxsize=64)
def _huffman(spec: bytes) -> Huffman:
    return Huffman(list(spec[:16]), list(spec[16:]))


def parse(data: bytes) -> tuple[Frame, dict[int, np.ndarray], list[Scan]]:
    """Frame, quantisation tables and scans of a progressive (or sequential Huffman) file."""
    if data[:2] != b"\xff\xd8":
        raise ValueError("no JPEG")
    at, quant, dc, ac, scans, frame, interval = 2, {}, {}, {}, [], None, 0
    while at < len(data):
        if data[at] != 0xFF:
            raise ValueError(f"no marker at {at}")
        kind = data[at + 1]
        if kind == 0xFF:
            at += 1
            continue
        if kind == 0xD9:
            break
        size = struct.unpack_from(">H", data, at + 2)[0]
        body = data[at + 4 : at + 2 + size]
        at += 2 + size
        if kind == 0xDB:
            while body:
                wide, ident = body[0] >> 4, body[0] & 15
                n = 128 if wide else 64
                quant[ident] = np.frombuffer(body[1 : 1 + n], ">u2" if wide else "u1").astype(np.int32)
                body = body[1 + n :]
        elif kind == 0xC4:
            while body:
                stop = 17 + sum(body[1:17])
                (ac if body[0] >> 4 else dc)[body[0] & 15] = _huffman(body[1:stop])
                body = body[stop:]
        elif kind == 0xC2:
            _, height, width, n = struct.unpack_from(">BHHB", body)
            frame = Frame(width, height, [Component(body[6 + 3 * i], body[7 + 3 * i] >> 4, body[7 + 3 * i] & 15, body[8 + 3 * i]) for i in range(n)])
        elif kind in (0xC0, 0xC1, 0xC3, *range(0xC5, 0xC8), *range(0xC9, 0xCC), *range(0xCD, 0xD0)):
            raise ValueError(f"frame type {kind:x} is not progressive")
        elif kind == 0xDD:
            interval = struct.unpack(">H", body)[0]
        elif kind == 0xDA:
            n = body[0]
            idents = [c.ident for c in frame.components]
            which = [idents.index(body[1 + 2 * i]) for i in range(n)]
            start, end, bits = body[1 + 2 * n : 4 + 2 * n]
            scan = Scan(which, start, end, bits >> 4, bits & 15, interval=interval)
            tables = [body[2 + 2 * i] for i in range(n)]
            if start == 0 and not scan.high:
                scan.dc = {i: dc[t >> 4] for i, t in zip(which, tables, strict=True)}
            elif start:
                scan.ac = ac[tables[0] & 15]
            stop = _MARKER.search(data, at).start()
            scan.data = data[at:stop]
            scans.append(scan)
            at = stop
    return frame, quant, scans


def decode_coefficients(data: bytes) -> Image:
    frame, quant, scans = parse(data)
    held = [np.zeros((int(np.prod(frame.padded(c))), 64), np.int16) for c in frame.components]
    for scan in scans:
        decode_scan(scan, frame.order(scan.which), held)
    return Image(frame, quant, held)


_INVERSE = np.kron(BASIS, BASIS)[ZIGZAG]


def samples(coefficients: np.ndarray, quant: np.ndarray) -> np.ndarray:
    """(blocks, 64) samples 0..255, row-major, of blocks in scan order: an exact fixed-point product."""
    out = (coefficients * quant.astype(np.float64)) @ _INVERSE
    return np.clip(np.floor(out / (1 << 2 * _FIX) + 0.5) + 128, 0, 255).astype(np.uint8)


def plane(coefficients: np.ndarray, quant: np.ndarray, rows: int, cols: int) -> np.ndarray:
    out = samples(coefficients, quant)
    return out.reshape(rows, cols, 8, 8).swapaxes(1, 2).reshape(rows * 8, cols * 8)


def to_rgb(image: Image) -> np.ndarray:
    """(height, width, 3) bytes at full resolution; subsampled components are repeated."""
    frame, full = image.frame, []
    for c, held in zip(frame.components, image.coefficients, strict=True):
        own = plane(held, image.quant[c.quant], *frame.padded(c))
        own = own.repeat(frame.v_max // c.v, axis=0).repeat(frame.h_max // c.h, axis=1)
        full.append(own[: frame.height, : frame.width])
    if len(full) == 1:
        return np.repeat(full[0][:, :, None], 3, axis=2)
    return rgb(*full[:3])


def rgb(y: np.ndarray, cb: np.ndarray, cr: np.ndarray) -> np.ndarray:
    """Red, green and blue bytes, on a last axis, of samples of equal shapes."""
    y, cb, cr = y.astype(np.int32), cb.astype(np.int32) - 128, cr.astype(np.int32) - 128
    half = 1 << 15  # 16-bit fixed point of the usual matrix
    r = y + ((91881 * cr + half) >> 16)
    g = y + ((-22554 * cb - 46802 * cr + half) >> 16)
    b = y + ((116130 * cb + half) >> 16)
    return np.clip(np.stack([r, g, b], axis=-1), 0, 255).astype(np.uint8)


# --- Writing -------------------------------------------------------------------------


_SIZES = np.array([i.bit_length() for i in range(1 << 12)], np.int64)


def _magnitude(value: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(size, bits) of values, as entropy-coded."""
    size = _SIZES[np.abs(value)]
    return size, np.where(value < 0, value + (np.int64(1) << size) - 1, value)


def _shifted(value: np.ndarray, low: int) -> np.ndarray:
    """Toward zero, as AC coefficients are cut."""
    return np.sign(value) * (np.abs(value) >> low) if low else value


def _segment(kind: int, body: bytes) -> bytes:
    return struct.pack(">BBH", 0xFF, kind, len(body) + 2) + body


def _dht(kind: int, table: Huffman, ident: int = 0) -> bytes:
    return _segment(0xC4, bytes([kind << 4 | ident, *table.bits, *table.values]))


def encode_scan(blocks: np.ndarray, lanes_of: np.ndarray, n: int, start: int, end: int, high: int, low: int, table: Huffman | None = None) -> tuple[Huffman | None, list[bytes]]:
    """One scan of single-component images, a restart interval per block: (table, data of each image).
    Without a table one is fitted.

    ``blocks`` (all images' blocks, 64) in scan order, ``lanes_of`` the image of each block.
    """
    out, lane = Writer(), np.arange(len(blocks))
    if start == 0:
        value = blocks[:, 0].astype(np.int64)
        if high:
            out.add(lane, lane * 0, value >> low & 1, np.ones(len(lane)))
            return None, _joined(*out.pack(len(blocks)), lanes_of, n)
        size, bits = _magnitude(value >> low)
        table = table or Huffman.fit(size)
        out.add(lane, lane * 0, table.code[size] << size.astype(np.uint64) | bits.astype(np.uint64), table.size[size] + size)
        return table, _joined(*out.pack(len(blocks)), lanes_of, n)
    band = _shifted(blocks[:, start : end + 1].astype(np.int64), low)
    if high:
        return _encode_refine(band, lanes_of, n, table)
    row, col = np.nonzero(band)
    value = band[row, col]
    before = np.where(np.append(True, row[1:] != row[:-1])[: len(row)], -1, np.append(-1, col[:-1])[: len(row)])
    run = col - before - 1
    size, bits = _magnitude(value)
    symbol = (run & 15) << 4 | size
    last = np.full(len(blocks), -1)
    last[row] = col  # the largest stays, as columns ascend
    open_end = np.flatnonzero(last < band.shape[1] - 1)
    skips = run >> 4
    long = np.flatnonzero(skips)
    zrl = np.full(int(skips.sum()), 0xF0)
    table = table or Huffman.fit(np.concatenate([symbol, zrl, np.zeros(len(open_end), np.int64)]))
    key = col * 8
    out.add(row, key, table.code[symbol] << size.astype(np.uint64) | bits.astype(np.uint64), table.size[symbol] + size)
    if len(long):
        own = np.repeat(long, skips[long])
        out.add(row[own], key[own] - 1, table.code[zrl], table.size[zrl])
    if len(open_end):
        zero = np.zeros(len(open_end), np.int64)
        out.add(open_end, zero + 64 * 8, table.code[zero], table.size[zero])
    return table, _joined(*out.pack(len(blocks)), lanes_of, n)


def _encode_refine(band: np.ndarray, lanes_of: np.ndarray, n: int, table: Huffman | None) -> tuple[Huffman, list[bytes]]:
    """Refinement of a band cut at its new bit: old coefficients give a correction bit each, behind
    the symbol that passes them; new ones (now of size 1) a symbol with the run of zeros before."""
    out = Writer()
    size = np.abs(band)
    old, new, zero = size > 1, size == 1, size == 0
    zeros = np.cumsum(zero, axis=1)
    row, col = np.nonzero(new)
    first = np.append(True, row[1:] != row[:-1])[: len(row)]
    passed = zeros[row, col]
    run = passed - np.where(first, 0, np.append(0, passed[:-1])[: len(row)])
    last = np.full(len(band), -1)
    last[row] = col
    # without runs of 16 zeros in one symbol: a skip of 16 goes out as its own symbol at its 16th zero
    skips, short = run >> 4, run & 15
    start_of = np.where(first, -1, np.append(-1, col[:-1])[: len(row)])
    symbol = short << 4 | 1
    long = np.flatnonzero(skips)
    open_end = np.flatnonzero(last < band.shape[1] - 1)
    table = table or Huffman.fit(np.concatenate([symbol, np.full(int(skips.sum()), 0xF0), np.zeros(len(open_end), np.int64)]))
    key_of = lambda c, part: c * 8 + part
    # symbols stand before the correction bits of the coefficients that they pass
    begin = start_of.copy()
    if len(long):
        own = np.repeat(long, skips[long])
        nth = np.arange(len(own)) - np.repeat(np.cumsum(skips[long]) - skips[long], skips[long])
        base = np.where(first[own], 0, zeros[row[own], np.maximum(start_of[own], 0)] * (start_of[own] >= 0))
        padded = zeros[row[own]]
        sixteenth = np.array([np.searchsorted(z, b + 16 * (k + 1)) for z, b, k in zip(padded, base, nth, strict=True)])
        came = np.array([np.searchsorted(z, b + 16 * k) if k else -2 for z, b, k in zip(padded, base, nth, strict=True)])
        came = np.where(nth > 0, came, start_of[own])
        out.add(row[own], key_of(came + 1, 0), table.code[np.full(len(own), 0xF0)], table.size[np.full(len(own), 0xF0)])
        begin[own] = np.maximum(begin[own], sixteenth)
        np.maximum.at(begin, own, sixteenth)
    out.add(row, key_of(begin + 1, 1), table.code[symbol] << np.uint64(1) | (band[row, col] > 0).astype(np.uint64), table.size[symbol] + 1)
    if len(open_end):
        zero_symbol = np.zeros(len(open_end), np.int64)
        out.add(open_end, key_of(last[open_end] + 1, 2), table.code[zero_symbol], table.size[zero_symbol])
    r, c = np.nonzero(old)
    out.add(r, key_of(c, 4), size[r, c] & 1, np.ones(len(r)))
    return table, _joined(*out.pack(len(band)), lanes_of, n)


#: Scans of one component: (start, end, high, low).
SCRIPT = ((0, 0, 0, 1), (1, 5, 0, 1), (6, 63, 0, 0), (1, 5, 1, 0), (0, 0, 1, 0))


def _frame(frame: Frame) -> bytes:
    return _segment(0xC2, struct.pack(">BHHB", 8, frame.height, frame.width, len(frame.components)) + b"".join(bytes([c.ident, c.h << 4 | c.v, c.quant]) for c in frame.components))


def general_table(refine: bool = False, dc: bool = False) -> Huffman:
    """A table for any data of 8-bit coefficients, from a rule: long runs are rare, middle sizes common."""
    counts = np.zeros(256, np.int64)
    if dc:
        counts[:12] = [1 << (12 - abs(s - 5)) for s in range(12)]
    else:
        for run in range(16):
            for size in range(1, 2 if refine else 11):
                counts[run << 4 | size] = max(1, (1 << (22 - abs(size - 5))) >> 2 * run)
        counts[0x00] = counts[0xF0] = 1 << 10
        if refine:
            counts[0x00] = 1 << 26
    lengths = code_lengths(counts)
    used = sorted(np.flatnonzero(lengths).tolist(), key=lambda s: (lengths[s], s))
    return Huffman([int((lengths == n).sum()) for n in range(1, 17)], used)


GENERAL = {"dc": general_table(dc=True), "first": general_table(), "refine": general_table(refine=True)}


def _table(start: int, high: int) -> Huffman | None:
    return GENERAL["refine" if high else "first"] if start else None if high else GENERAL["dc"]


def encode_planar(blocks: np.ndarray, frames: list[Frame], quant: np.ndarray, comments: list[bytes]) -> list[bytes]:
    """Progressive files whose scans hold one component each: ``blocks`` in scan order, one
    component after the other, one image after the other. Every block is a restart interval. The
    tables are fixed, so a file depends on its image alone. Components of more than LANES blocks
    are coded in parts."""
    many = [int(np.prod(f.padded(c))) for f in frames for c in f.components]
    parts = [min(LANES, n - at) for n in many for at in range(0, n, LANES)]
    plane_of = [i for i, n in enumerate(many) for _ in range(0, n, LANES)]
    ends = np.cumsum(parts)
    coded: list[list[list[bytes]]] = []  # of each scan, plane and part
    for start, end, high, low in SCRIPT:
        table = _table(start, high)
        data: list[list[bytes]] = [[] for _ in many]
        at = 0
        while at < len(parts):  # as many parts as fit into LANES
            upto = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + LANES, side="right")))
            lo = int(ends[at - 1]) if at else 0
            _, own = encode_scan(blocks[lo : ends[upto - 1]], np.repeat(np.arange(upto - at), parts[at:upto]), upto - at, start, end, high, low, table)
            for i, x in zip(plane_of[at:upto], own, strict=True):
                data[i].append(x)
            at = upto
        coded.append(data)
    tables = _segment(0xDB, bytes([0]) + quant.astype(np.uint8).tobytes()) + _dht(0, GENERAL["dc"]) + _dht(1, GENERAL["first"]) + _dht(1, GENERAL["refine"], 1) + _segment(0xDD, struct.pack(">H", 1))
    out, first = [], 0
    for frame, note in zip(frames, comments, strict=True):
        made = [b"\xff\xd8", _segment(0xFE, note), _frame(frame), tables]
        for (start, end, high, low), data in zip(SCRIPT, coded, strict=True):
            for k, c in enumerate(frame.components):
                # a part ends with an interval whose number is 7
                made += (_segment(0xDA, bytes([1, c.ident, 1 if start and high else 0, start, end, high << 4 | low])), b"\xff\xd7".join(data[first + k]))
        first += len(frame.components)
        out.append(b"".join([*made, b"\xff\xd9"]))
    return out


def decode_planar(files: list[bytes]) -> tuple[list[tuple[Frame, dict[int, np.ndarray]]], np.ndarray, np.ndarray]:
    """(frame and tables of each, all blocks' coefficients, block counts of all components) of files.

    Components whose scans are their own, agree in band, bits and tables and restart after every
    block are decoded together, in groups of at most LANES blocks (a larger one in parts); files
    with others one by one.
    """
    parsed = [parse(f) for f in files]
    counts = np.array([int(np.prod(frame.padded(c))) for frame, _, _ in parsed for c in frame.components], np.int64)
    held = np.zeros((int(counts.sum()), 64), np.int16)
    first = np.cumsum(counts) - counts
    alike: dict[tuple, list[tuple[int, list[Scan]]]] = {}
    plane = 0
    for frame, _, scans in parsed:
        n = len(frame.components)
        if all(s.interval == 1 and len(s.which) == 1 for s in scans) and all(frame.blocks(c) == frame.padded(c) for c in frame.components):
            for k in range(n):
                own = [s for s in scans if s.which == [k]]
                key = tuple((s.start, s.end, s.high, s.low, id(s.ac), *map(id, s.dc.values())) for s in own)
                alike.setdefault(key, []).append((plane + k, own))
        else:
            into = [held[first[i] : first[i] + counts[i]] for i in range(plane, plane + n)]
            for scan in scans:
                decode_scan(scan, frame.order(scan.which), into)
        plane += n
    for key, members in alike.items():
        for k in range(len(key)):
            one, data, blocks, room = members[0][1][k], [], [], 0

            def flush(one=one) -> None:
                if data:
                    dc = {0: t for t in one.dc.values()}
                    decode_scan(Scan([0], one.start, one.end, one.high, one.low, dc, one.ac, 1, b"\xff\xd0".join(data)), [(0, np.concatenate(blocks))], [held])
                    data.clear()
                    blocks.clear()

            for i, scans in members:
                for part, lo, n in _cut(scans[k].data, int(counts[i])):
                    if room + n > LANES:
                        flush()
                        room = 0
                    data.append(part)
                    blocks.append(np.arange(first[i] + lo, first[i] + lo + n))
                    room += n
            flush()
    return [(frame, quant) for frame, quant, _ in parsed], held, counts


def _cut(data: bytes, n: int) -> list[tuple[bytes, int, int]]:
    """A scan's data in parts of at most LANES restart intervals of a block: (bytes, first, intervals)."""
    if n <= LANES:
        return [(data, 0, n)]
    x = np.frombuffer(data, np.uint8)
    marks = np.flatnonzero((x[:-1] == 0xFF) & (x[1:] >= 0xD0) & (x[1:] <= 0xD7))
    edges = [0, *(int(m) for m in marks[LANES - 1 :: LANES]), len(data) + 0]
    return [(data[a + (2 if a else 0) : b], i * LANES, min(LANES, n - i * LANES)) for i, (a, b) in enumerate(zip(edges, edges[1:]))]


def encode_color(coefficients: list[np.ndarray], frame: Frame, quant: dict[int, np.ndarray], low: int = 1) -> bytes:
    """A progressive file of several components: an interleaved DC scan and its refinement, AC
    scans of each component by spectral selection and successive approximation."""
    out = [b"\xff\xd8"]
    out += [_segment(0xDB, bytes([k]) + q.astype(np.uint8).tobytes()) for k, q in sorted(quant.items())]
    out.append(_frame(frame))
    out.append(_segment(0xDD, struct.pack(">H", 1)))
    everyone = list(range(len(frame.components)))
    order = frame.order(everyone)
    lanes = np.arange(len(order[0][1]))
    for high in (0, low):
        bits, last = Writer(), {i: np.zeros(len(lanes), np.int64) for i in everyone}
        for k, (i, blocks) in enumerate(order):
            value = coefficients[i][blocks, 0].astype(np.int64)
            if high:
                bits.add(lanes, lanes * 0 + k, value >> 0 & 1, np.ones(len(lanes)))
                continue
            size, own = _magnitude((value >> low) - last[i])
            last[i] = value >> low
            bits.add(lanes, lanes * 0 + k, GENERAL["dc"].code[size] << size.astype(np.uint64) | own.astype(np.uint64), GENERAL["dc"].size[size] + size)
        head = b"" if high else _dht(0, GENERAL["dc"])
        spec = b"".join(bytes([frame.components[i].ident, 0]) for i in everyone)
        out += [head, _segment(0xDA, bytes([len(everyone)]) + spec + bytes([0, 0, high << 4 | (0 if high else low)])), _joined(*bits.pack(len(lanes)), np.zeros(len(lanes), np.int64), 1)[0]]
        if not high:
            for start, end, up, down in ((1, 5, 0, 0), (6, 63, 0, low), (6, 63, low, 0)):
                for i in everyone:
                    blocks = coefficients[i][frame.order([i])[0][1]]
                    table = _table(start, up)
                    own = encode_scan(blocks, np.zeros(len(blocks), np.int64), 1, start, end, up, down, table)[1][0]
                    out += [_dht(1, table), _segment(0xDA, bytes([1, frame.components[i].ident, 0, start, end, up << 4 | down])), own]
    return b"".join([*out, b"\xff\xd9"])
