"""Checksums: Bob Jenkins' lookup3 (hashlittle) and Fletcher-32."""

from __future__ import annotations

import struct

import numpy as np

_M = 0xFFFFFFFF


def lookup3(data: bytes, seed: int = 0) -> int:
    """hashlittle over bytes, as published by its author in the public domain."""
    n = len(data)
    a = b = c = (0xDEADBEEF + n + seed) & _M
    if n == 0:
        return c
    full = (n - 1) // 12
    words = struct.unpack_from(f"<{3 * full}I", data)
    for i in range(0, 3 * full, 3):
        a, b, c = a + words[i] & _M, b + words[i + 1] & _M, c + words[i + 2] & _M
        # each step: one word loses another, is stirred with its rotation, and the third joins in
        for shift in (4, 6, 8, 16, 19, 4):
            a = (a - c) & _M
            a ^= (c << shift | c >> (32 - shift)) & _M
            c = c + b & _M
            a, b, c = b, c, a
    a, b, c = (x + y & _M for x, y in zip((a, b, c), struct.unpack("<3I", data[12 * full :].ljust(12, b"\0")), strict=True))
    for shift in (14, 11, 25, 16, 4, 14, 24):
        c ^= b
        c = (c - (b << shift | b >> (32 - shift))) & _M
        a, b, c = b, c, a
    return b


def fletcher32(data: bytes) -> int:
    """Over big-endian 16-bit words; an odd last byte is the high half of a word."""
    if len(data) % 2:
        data += b"\0"
    words = np.frombuffer(data, ">u2").astype(np.uint64)
    n = len(words)
    if n == 0:
        return 0
    one = int(words.sum())
    two = int((words * ((n - np.arange(n, dtype=np.uint64)) % np.uint64(65535))).sum() % np.uint64(65535)) if n < 1 << 31 else sum(int(w) * (n - i) for i, w in enumerate(words)) % 65535
    # ones' complement sums: once a word isn't zero, neither sum is, and multiples of 65535 are 65535
    fold = lambda x: (x - 1) % 65535 + 1 if one else 0
    return fold(two) << 16 | fold(one)
