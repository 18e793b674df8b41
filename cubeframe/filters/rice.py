"""SZIP: the extended Rice coder of the CCSDS 121.0 recommendation, in Python on strings of bits.

Slow: a chunk of 64 KiB takes about a tenth of a second. Blocks are coded as zero runs of one
block, second extension, split samples, or uncompressed, whichever is shortest.
"""

from __future__ import annotations

import struct
from collections.abc import Sequence

import numpy as np

from cubeframe.errors import InvalidData

MSB, NEAREST, RAW = 16, 32, 128


def _setup(params: Sequence[int]) -> tuple[int, int, int, int, bool, bool]:
    """(bits of a sample, bytes of it, interleaved bytes, block, big-endian, preprocessed), and blocks of a segment in the caller."""
    options, bits = params[0] if params else NEAREST, params[1] if len(params) > 1 else 8
    block = params[2] if len(params) > 2 else 32
    planes = bits // 8 if bits in (32, 64) and not options & RAW else 1
    bits = 8 if planes > 1 else bits
    width = 1 if bits <= 8 else 2 if bits <= 16 else 4
    return bits, width, planes, block, bool(options & MSB), bool(options & NEAREST)


def _samples(data: bytes, width: int, big: bool) -> np.ndarray:
    return np.frombuffer(data, f"{'>' if big else '<'}u{width}").astype(np.int64)


def _id_bits(bits: int) -> int:
    return 5 if bits > 16 else 4 if bits > 8 else 3


def _lines(params: Sequence[int], block: int) -> tuple[int, int]:
    """(samples of a scanline, the same padded to whole blocks)."""
    line = params[3] if len(params) > 3 else 256
    return line, -(-line // block) * block


def encode(data: bytes, params: Sequence[int], size: int = 0) -> bytes:
    bits, width, planes, block, big, near = _setup(params)
    if planes > 1:
        n = len(data) // planes * planes
        data = np.frombuffer(data[:n], np.uint8).reshape(-1, planes).T.tobytes() + data[n:]
    x = _samples(data + bytes(-len(data) % width), width, big)
    if bits < 64 and len(x) and int(x.max()) >> bits:
        raise InvalidData(f"a sample beyond {bits} bits")
    line, full = _lines(params, block)
    rows = -(-len(x) // line)
    padded = np.concatenate([x, np.full(rows * line - len(x), x[-1] if len(x) else 0)]).reshape(rows, line)
    padded = np.concatenate([padded, np.repeat(padded[:, -1:], full - line, axis=1)], axis=1)
    top, out, ids = (1 << bits) - 1, [], _id_bits(bits)
    for row in padded:
        if near:
            before = np.concatenate([row[:1], row[:-1]])
            delta, room = row - before, np.minimum(before, top - before)
            size_ = np.abs(delta)
            coded = np.where(size_ > room, room + size_, np.where(delta >= 0, 2 * delta, 2 * size_ - 1))
        else:
            coded = row
        for at in range(0, full, block):
            first = near and at == 0
            head = f"{row[0]:0{bits}b}" if first else ""
            values = coded[at + first : at + block]
            best = "1" * ids + head + "".join(f"{v:0{bits}b}" for v in (values if near else row[at : at + block]).tolist())
            if not values.any():
                best = "0" * ids + "0" + head + "1"
            else:
                every = ([0] if first else []) + values.tolist()
                pairs = [(a + b) * (a + b + 1) // 2 + b for a, b in zip(every[::2], every[1::2])]
                if sum(pairs) + len(pairs) + ids + 1 + len(head) < len(best) and max(pairs) < 90:
                    best = "0" * ids + "1" + head + "".join("0" * m + "1" for m in pairs)
                for k in range(min(bits, (1 << ids) - 2)):
                    if k + 1 >= (1 << ids) - 1:
                        break
                    n = int((values >> k).sum()) + (k + 1) * len(values) + ids + len(head)
                    if n < len(best):
                        low = "".join(f"{v & (1 << k) - 1:0{k}b}" for v in values.tolist()) if k else ""
                        best = f"{k + 1:0{ids}b}" + head + "".join("0" * (v >> k) + "1" for v in values.tolist()) + low
            out.append(best)
    text = "".join(out)
    text += "0" * (-len(text) % 8)
    return int(text, 2).to_bytes(len(text) // 8, "big") if text else b""


def decode(data: bytes, params: Sequence[int], size: int = 0) -> bytes:
    """Four parameters: the data starts with its decoded size in four bytes; five: that is the last one."""
    bits, width, planes, block, big, near = _setup(params)
    if len(params) > 4:
        total = params[4] or size
    else:
        if len(data) < 4:
            raise InvalidData("szip: no size")
        (total,), data = struct.unpack_from("<I", data), data[4:]
    total = size or total
    line, full = _lines(params, block)
    n = -(-total // width)
    text = format(int.from_bytes(b"\1" + data, "big"), "b")[1:]
    ids, top, at, rows = _id_bits(bits), (1 << bits) - 1, 0, []

    def unary() -> int:
        nonlocal at
        stop = text.find("1", at)
        if stop < 0:
            raise InvalidData("szip: truncated")
        at, zeros = stop + 1, stop - at
        return zeros

    def field(k: int) -> int:
        nonlocal at
        if at + k > len(text):
            raise InvalidData("szip: truncated")
        at += k
        return int(text[at - k : at], 2) if k else 0

    while sum(map(len, rows)) < n:
        coded, start, blocks = [], None, full // block
        while len(coded) < full:
            first = near and not coded
            kind = field(ids)
            if kind == (1 << ids) - 1:
                got = [field(bits) for _ in range(block)]
                if first:
                    start, got[0] = got[0], 0
                coded += got
                continue
            second = field(1) if kind == 0 else 0
            if first:
                start = field(bits)
            if kind == 0 and not second:
                run = unary() + 1
                done = len(coded) // block
                if run == 5:
                    run = min(blocks, (done // 64 + 1) * 64) - done
                elif run > 5:
                    run -= 1
                coded += [0] * (run * block)
            elif kind == 0:
                got = []
                while len(got) < block:
                    m = unary()
                    s = int((np.sqrt(8 * m + 1) - 1) // 2)
                    b = m - s * (s + 1) // 2
                    got += [s - b, b]
                coded += got
            else:
                k, count = kind - 1, block - first
                high = [unary() for _ in range(count)]
                coded += ([0] if first else []) + [h << k | field(k) for h in high]
        if near:
            row, value = [start], start
            for d in coded[1:full]:
                room = min(value, top - value)
                if d > 2 * room:
                    value += (d - room) if value < top - value else room - d
                else:
                    value += -((d + 1) >> 1) if d & 1 else d >> 1
                row.append(value)
        else:
            row = coded[:full]
        rows.append(row[:line])
    flat = np.array([v for r in rows for v in r][:n], np.int64)
    out = flat.astype(f"{'>' if big else '<'}u{width}").tobytes()[:total]
    if planes > 1:
        m = total // planes * planes
        out = np.frombuffer(out[:m], np.uint8).reshape(planes, -1).T.tobytes() + out[m:]
    return out
