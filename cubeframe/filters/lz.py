"""LZ77 byte codes in pure Python: LZF and BloscLZ, both ways. Slow; prefer lz4 or zstd."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

from cubeframe.errors import InvalidData


def _copy(out: bytearray, distance: int, n: int) -> None:
    """Append ``n`` bytes from ``distance`` back; source and target may overlap."""
    start = len(out) - distance
    if start < 0:
        raise InvalidData("a reference before the start")
    if distance >= n:
        out += out[start : start + n]
    else:
        piece = bytes(out[start:])
        out += (piece * (n // distance + 1))[:n]


def _matches(data: bytes, reach: int, longest: int, near: int) -> Iterator[tuple[int, int, int, int]]:
    """(start, end, distance, length): literals data[start:end], then a reference; of the last one the length is 0.

    Greedy, by the last place of each three bytes; references beyond ``near`` are of six bytes at least.
    """
    seen: dict[bytes, int] = {}
    at, start, n = 0, 0, len(data)
    while at + 2 < n:
        key = data[at : at + 3]
        before = seen.get(key, -1)
        seen[key] = at
        length = 0
        if before >= 0 and at - before <= reach:
            length = 3
            while length < longest and at + length < n and data[before + length] == data[at + length]:
                length += 1
        if length < (6 if at - before > near else 3):
            at += 1
            continue
        yield start, at, at - before, length
        at += length
        start = at
    yield start, n, 0, 0


def lzf_encode(data: bytes, params: Sequence[int] = (), size: int = 0) -> bytes:
    """Literal runs of up to 32 bytes and references of 3 to 264 bytes within 8 KiB.

    Output of the input's size or more is still valid and kept: the decoder needs no other mark.
    """
    out = bytearray()
    for start, end, distance, length in _matches(data, 8192, 264, 8192):
        for a in range(start, end, 32):
            part = data[a : min(a + 32, end)]
            out.append(len(part) - 1)
            out += part
        if length:
            code = length - 2
            out += bytes([min(code, 7) << 5 | (distance - 1) >> 8, *([code - 7] if code >= 7 else []), (distance - 1) & 255])
    return bytes(out)


def lzf_decode(data: bytes, params: Sequence[int] = (), size: int = 0) -> bytes:
    out, at = bytearray(), 0
    try:
        while at < len(data):
            code = data[at]
            at += 1
            if code < 32:
                if at + code + 1 > len(data):
                    raise InvalidData("lzf: truncated")
                out += data[at : at + code + 1]
                at += code + 1
                continue
            length = code >> 5
            if length == 7:
                length += data[at]
                at += 1
            _copy(out, ((code & 31) << 8 | data[at]) + 1, length + 2)
            at += 1
    except IndexError:
        raise InvalidData("lzf: truncated") from None
    return bytes(out)


def blosclz_encode(data: bytes) -> bytes:
    """What ``blosclz_decode`` reads: literals first, the format's mark in the first byte."""
    out = bytearray()
    for start, end, distance, length in _matches(data, 8192 + 65535, 1 << 16, 8191):
        for a in range(start, end, 32):
            part = data[a : min(a + 32, end)]
            out.append(len(part) - 1)
            out += part
        if length:
            far = distance - 8192  # below zero: 13 bits hold the distance
            high, low = ((distance - 1) >> 8, [(distance - 1) & 255]) if far < 0 else (31, [255, far >> 8, far & 255])
            code = length - 2
            out.append(min(code, 7) << 5 | high)
            if code >= 7:
                out += b"\xff" * ((code - 7) // 255) + bytes([(code - 7) % 255])
            out += bytes(low)
    if out:
        out[0] |= 32
    return bytes(out)


def blosclz_decode(data: bytes, size: int) -> bytes:
    """Runs of up to 32 literals; references whose length goes on in bytes of 255, and whose distance
    may have 16 more bits behind the marks 31 and 255."""
    out, at = bytearray(), 1
    if not data:
        return b""
    code = data[0] & 31
    try:
        while True:
            if code < 32:
                out += data[at : at + code + 1]
                at += code + 1
            else:
                length, distance = (code >> 5) - 1, (code & 31) << 8
                if length == 6:
                    while True:
                        more = data[at]
                        at += 1
                        length += more
                        if more != 255:
                            break
                low = data[at]
                at += 1
                if low == 255 and distance == 31 << 8:
                    distance = (data[at] << 8 | data[at + 1]) + 8191
                    at += 2
                else:
                    distance += low
                _copy(out, distance + 1, length + 3)
            if at >= len(data):
                break
            code = data[at]
            at += 1
    except IndexError:
        raise InvalidData("blosclz: truncated") from None
    if len(out) != size:
        raise InvalidData(f"blosclz: {len(out)} bytes for {size}")
    return bytes(out)
