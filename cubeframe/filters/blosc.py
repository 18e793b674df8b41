"""Blosc 1 frames: a header of 16 bytes, byte shuffle, and one of several compressors.

Written as one block without block table, stored if it doesn't shrink. Frames with a block table
and split blocks, as other writers make them, are read too.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Sequence

import numpy as np
import pyarrow as pa

from cubeframe.errors import InvalidData, UnsupportedFeature
from cubeframe.filters import lz

#: Numbers of compressors in a filter's parameters.
BLOSCLZ, LZ4, LZ4HC, SNAPPY, ZLIB, ZSTD = range(6)
_SHUFFLED, _STORED, _WHOLE = 1, 2, 16
_ARROW = {LZ4: "lz4_raw", LZ4HC: "lz4_raw", SNAPPY: "snappy", ZSTD: "zstd"}


def _transposed(data: bytes, width: int, back: bool) -> bytes:
    n = len(data) // width * width
    x = np.frombuffer(data[:n], np.uint8).reshape((width, -1) if back else (-1, width))
    return x.T.tobytes() + data[n:]


def _unpack(codec: int, data: bytes, size: int) -> bytes:
    try:
        if codec == BLOSCLZ:
            return lz.blosclz_decode(data, size)
        if codec == ZLIB:
            return zlib.decompress(data)
        return pa.decompress(data, size, _ARROW[codec], asbytes=True)
    except (OSError, zlib.error, pa.ArrowException) as e:
        raise InvalidData(f"blosc: {e}") from e
    except KeyError:
        raise UnsupportedFeature(f"blosc compressor {codec}") from None


def encode(data: bytes, params: Sequence[int], size: int = 0) -> bytes:
    """params: [2] element bytes, [5] shuffle, [6] compressor."""
    width = params[2] if len(params) > 2 else 1
    shuffled = (params[5] if len(params) > 5 else 1) == 1
    codec = params[6] if len(params) > 6 else LZ4
    body = _transposed(data, width, False) if shuffled and width > 1 else data
    if codec == ZLIB:
        packed = zlib.compress(body)
    elif codec == BLOSCLZ:
        packed = lz.blosclz_encode(body)
    elif codec in _ARROW:
        packed = pa.compress(body, _ARROW[codec], asbytes=True)
    else:
        raise UnsupportedFeature(f"blosc compressor {codec}")
    flags = _SHUFFLED if shuffled else 0
    if len(packed) >= len(data):
        packed, flags = body, flags | _STORED
    return struct.pack("<BBBBIII", 2, 1, flags, width, len(data), len(data), 16 + len(packed)) + packed


def decode(data: bytes, params: Sequence[int], size: int = 0) -> bytes:
    if len(data) < 16:
        raise InvalidData("blosc: no header")
    _, _, flags, width, total, block, _ = struct.unpack_from("<BBBBIII", data)
    codec = params[6] if len(params) > 6 else LZ4
    shuffled = flags & _SHUFFLED and width > 1
    if flags & _STORED:
        body = data[16 : 16 + total]
        if len(body) != total:
            raise InvalidData("blosc: truncated")
        # a stored frame of one of our writers was shuffled before; others store what they were given
        return _transposed(body, width, True) if shuffled else body
    blocks = -(-total // block) if block else 0
    table = struct.unpack_from(f"<{blocks}I", data, 16) if blocks and len(data) >= 16 + 4 * blocks else ()
    if not table or min(table) != 16 + 4 * blocks:
        body = _unpack(codec, data[16:], total)
        return _transposed(body, width, True) if shuffled else body
    codec = {0: BLOSCLZ, 1: LZ4, 2: SNAPPY, 3: ZLIB, 4: ZSTD}.get(flags >> 5, codec)
    out = []
    for k, at in enumerate(table):
        n = min(block, total - k * block)
        split = width if not flags & _WHOLE and n == block and 1 < width <= 16 and block // width >= 128 else 1
        parts = []
        for _ in range(split):
            (small,) = struct.unpack_from("<i", data, at)
            piece = data[at + 4 : at + 4 + small]
            parts.append(piece if small == n // split else _unpack(codec, piece, n // split))
            at += 4 + small
        body = b"".join(parts)
        out.append(_transposed(body, width, True) if shuffled else body)
    return b"".join(out)
