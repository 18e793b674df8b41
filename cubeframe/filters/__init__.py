"""Per-chunk byte transforms by filter id, and pipelines of them.

A filter is ``encode(data, params, size)`` and ``decode(data, params, size)``; ``size`` is the
number of bytes before encoding. Register further ones with ``register``.
"""

from __future__ import annotations

import bz2
import struct
import zlib
from collections.abc import Callable, Sequence
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa

from cubeframe.codec.checksum import fletcher32
from cubeframe.errors import ChecksumMismatch, InvalidData, UnsupportedFeature
from cubeframe.filters import blosc, lz, rice

DEFLATE, SHUFFLE, FLETCHER32, SZIP, NBIT, SCALEOFFSET = 1, 2, 3, 4, 5, 6
BZIP2, LZF, BLOSC, LZ4, BITSHUFFLE, ZSTD, BITGROOM, BITROUND = 307, 32000, 32001, 32004, 32008, 32015, 32022, 32023
NAMES = {"deflate": DEFLATE, "gzip": DEFLATE, "shuffle": SHUFFLE, "fletcher32": FLETCHER32, "szip": SZIP, "bzip2": BZIP2, "lzf": LZF, "blosc": BLOSC, "lz4": LZ4, "bitshuffle": BITSHUFFLE, "zstd": ZSTD, "bitgroom": BITGROOM, "bitround": BITROUND}

Codec = Callable[[bytes, Sequence[int], int], bytes]
_CODECS: dict[int, tuple[Codec, Codec]] = {}


def register(ident: int, encode: Codec, decode: Codec) -> None:
    _CODECS[ident] = (encode, decode)


def _at(params: Sequence[int], i: int, default: int) -> int:
    return params[i] if len(params) > i else default


# --- bytes ---------------------------------------------------------------------


def shuffle(data: bytes, params: Sequence[int], size: int = 0) -> bytes:
    """All first bytes of the elements, then all second ones, ...; a rest shorter than an element stays last."""
    width = _at(params, 0, 1)
    n = len(data) // width * width
    return np.frombuffer(data[:n], np.uint8).reshape(-1, width).T.tobytes() + data[n:] if width > 1 else data


def unshuffle(data: bytes, params: Sequence[int], size: int = 0) -> bytes:
    width = _at(params, 0, 1)
    n = len(data) // width * width
    return np.frombuffer(data[:n], np.uint8).reshape(width, -1).T.tobytes() + data[n:] if width > 1 else data


def _fletcher_on(data: bytes, params: Sequence[int], size: int) -> bytes:
    return data + struct.pack(">I", fletcher32(data))


def _fletcher_off(data: bytes, params: Sequence[int], size: int) -> bytes:
    """Verified in either byte order, and with 0 for 65535 in either half; writers differ in both."""
    if len(data) < 4:
        raise InvalidData("no room for a checksum")
    want = fletcher32(data[:-4])
    halves = lambda x: ((x >> 16) % 65535, (x & 65535) % 65535)
    if halves(want) not in [halves(struct.unpack(order, data[-4:])[0]) for order in (">I", "<I")]:
        raise ChecksumMismatch(f"Fletcher-32 {data[-4:].hex()} for {want:08x}")
    return data[:-4]


# --- entropy coders ---------------------------------------------------------------


def _inflate(data: bytes, params: Sequence[int], size: int) -> bytes:
    try:
        return zlib.decompress(data)
    except zlib.error as e:
        raise InvalidData(f"deflate: {e}") from e


def _bunzip(data: bytes, params: Sequence[int], size: int) -> bytes:
    try:
        return bz2.decompress(data)
    except (OSError, ValueError) as e:
        raise InvalidData(f"bzip2: {e}") from e


def _zstd(data: bytes, params: Sequence[int], size: int) -> bytes:
    return pa.Codec("zstd", compression_level=_at(params, 0, 3)).compress(data, asbytes=True)


def _unzstd(data: bytes, params: Sequence[int], size: int) -> bytes:
    try:
        return pa.decompress(data, size, "zstd", asbytes=True)
    except (OSError, pa.ArrowException) as e:
        raise InvalidData(f"zstd: {e}") from e


def _lz4(data: bytes, params: Sequence[int], size: int) -> bytes:
    """Big-endian total and block size, then each block with its size; a block as large as before is stored."""
    block = _at(params, 0, 0) or 1 << 30
    block = min(block, max(1, len(data)))
    out = [struct.pack(">QI", len(data), block)]
    for at in range(0, len(data), block):
        part = data[at : at + block]
        packed = pa.compress(part, "lz4_raw", asbytes=True)
        packed = part if len(packed) >= len(part) else packed
        out += [struct.pack(">I", len(packed)), packed]
    return b"".join(out)


def _unlz4(data: bytes, params: Sequence[int], size: int) -> bytes:
    try:
        total, block = struct.unpack_from(">QI", data)
        out, at, left = [], 12, total
        while left:
            want = min(block, left)
            (n,) = struct.unpack_from(">I", data, at)
            part = data[at + 4 : at + 4 + n]
            if len(part) != n:
                raise InvalidData("lz4: truncated")
            out.append(part if n == want else pa.decompress(part, want, "lz4_raw", asbytes=True))
            at, left = at + 4 + n, left - want
    except (struct.error, OSError, pa.ArrowException) as e:
        raise InvalidData(f"lz4: {e}") from e
    return b"".join(out)


# --- bit transposition ----------------------------------------------------------------


def _bit_block(data: bytes, width: int, back: bool, order: str) -> bytes:
    """Bits of elements (a multiple of 8 of them) by significance: first all lowest bits of the first byte."""
    n = len(data) // width
    x = np.frombuffer(data, np.uint8)
    if back:
        planes = np.unpackbits(x.reshape(width, 8, n // 8), axis=2, bitorder=order)
        return np.packbits(planes.transpose(2, 0, 1), axis=2, bitorder="little").tobytes()
    bits = np.unpackbits(x.reshape(n, width, 1), axis=2, bitorder="little")
    return np.packbits(bits.transpose(1, 2, 0), axis=2, bitorder=order).tobytes()


def _bit_geometry(params: Sequence[int]) -> tuple[int, int, bool, str]:
    """(element bytes, elements of a block, LZ4?, order of bits in packed bytes): a sixth value of 1 means least first."""
    width = max(1, _at(params, 2, 1))
    block = _at(params, 3, 0) or max(128, 8192 // width)
    return width, max(8, block // 8 * 8), _at(params, 4, 0) == 2, "little" if _at(params, 5, 0) == 1 else "big"


def bitshuffle(data: bytes, params: Sequence[int], size: int = 0) -> bytes:
    width, block, packed, order = _bit_geometry(params)
    step = block * width
    out = [struct.pack(">QI", len(data), step)] if packed else []
    whole = len(data) // (8 * width) * 8 * width
    for at in range(0, whole, step):
        part = _bit_block(data[at : min(at + step, whole)], width, False, order)
        if packed:
            small = pa.compress(part, "lz4_raw", asbytes=True)
            small = part if len(small) >= len(part) else small
            out.append(struct.pack(">I", len(small)))
            part = small
        out.append(part)
    return b"".join([*out, data[whole:]])


def bitunshuffle(data: bytes, params: Sequence[int], size: int = 0) -> bytes:
    width, block, packed, order = _bit_geometry(params)
    at, total, step, out, done = 0, len(data), block * width, [], 0
    try:
        if packed:
            total, step = struct.unpack_from(">QI", data)
            at = 12
        whole = total // (8 * width) * 8 * width
        while done < whole:
            want = n = min(step, whole - done)
            if packed:
                (n,) = struct.unpack_from(">I", data, at)
                at += 4
            part = data[at : at + n]
            part = part if n == want else pa.decompress(part, want, "lz4_raw", asbytes=True)
            out.append(_bit_block(part, width, True, order))
            at, done = at + n, done + want
    except (struct.error, ValueError, OSError, pa.ArrowException) as e:
        raise InvalidData(f"bitshuffle: {e}") from e
    return b"".join([*out, data[at : at + total - whole]])


# --- lossy quantisation -------------------------------------------------------------------

_LOG2_10 = np.log2(10.0)


def _floats(data: bytes, params: Sequence[int]) -> tuple[np.ndarray, np.ndarray, int]:
    width = _at(params, 1, 4)
    if width not in (4, 8):
        raise InvalidData(f"floats of {width} bytes")
    bits = np.frombuffer(data, f"<u{width}").copy()
    return bits, bits.view(f"<f{width}"), 23 if width == 4 else 52


def bitgroom(data: bytes, params: Sequence[int], size: int = 0) -> bytes:
    """Low mantissa bits beyond ``params[0]`` significant digits cleared and set in turn; zeros, the
    missing value (``params[2]`` set: the float of bits ``params[3]``) and what isn't finite stay."""
    bits, values, mantissa = _floats(data, params)
    spare = mantissa - (int(np.ceil(_at(params, 0, 3) * _LOG2_10)) + 1)
    if spare <= 0:
        return data
    low = bits.dtype.type((1 << spare) - 1)
    live = np.isfinite(values) & (values != 0)
    if _at(params, 2, 0):
        missing = np.array([_at(params, 3, 0)], "<u4").view("<f4")[0]
        live &= values != missing
    even = np.arange(len(bits)) % 2 == 0
    return np.where(live, np.where(even, bits & ~low, bits | low), bits).astype(bits.dtype).tobytes()


def bitround(data: bytes, params: Sequence[int], size: int = 0) -> bytes:
    """Each value rounded to as few mantissa bits as keep ``params[0]`` significant digits of it."""
    bits, values, mantissa = _floats(data, params)
    live = np.isfinite(values) & (values != 0)
    fraction, exponent = np.frexp(np.where(live, values, 1).astype(np.float64))
    log = np.log10(np.abs(fraction))
    digits = np.floor(exponent / _LOG2_10 + log).astype(np.int64) + 1
    quantum = np.floor((digits - _at(params, 0, 3)) * _LOG2_10).astype(np.int64)
    need = np.maximum(np.abs(np.floor(exponent - _LOG2_10 * log).astype(np.int64) - quantum) - 1, 0)
    live &= need < mantissa
    spare = np.where(live, mantissa - need, 1).astype(bits.dtype)
    one = bits.dtype.type(1)
    made = (bits + (one << (spare - one))) & ~((one << spare) - one)
    return np.where(live, made, bits).astype(bits.dtype).tobytes()


_same: Codec = lambda data, params, size: data

register(DEFLATE, lambda d, p, s: zlib.compress(d, _at(p, 0, 6)), _inflate)
register(SHUFFLE, shuffle, unshuffle)
register(FLETCHER32, _fletcher_on, _fletcher_off)
register(SZIP, rice.encode, rice.decode)
register(BZIP2, lambda d, p, s: bz2.compress(d, max(1, _at(p, 0, 9))), _bunzip)
register(LZF, lz.lzf_encode, lz.lzf_decode)
register(BLOSC, blosc.encode, blosc.decode)
register(LZ4, _lz4, _unlz4)
register(BITSHUFFLE, bitshuffle, bitunshuffle)
register(ZSTD, _zstd, _unzstd)
register(BITGROOM, bitgroom, _same)
register(BITROUND, bitround, _same)


@dataclass(frozen=True)
class Filter:
    ident: int
    params: tuple[int, ...] = ()
    flags: int = 0
    name: str = ""


@dataclass(frozen=True)
class Pipeline:
    """Filters in the order of writing; a chunk's mask has bit k set if filter k was skipped for it."""

    filters: tuple[Filter, ...] = field(default=())

    def __bool__(self) -> bool:
        return bool(self.filters)

    def encode(self, data: bytes) -> bytes:
        for f in self.filters:
            data = _codec(f)[0](data, f.params, len(data))
        return data

    def decode(self, data: bytes, size: int, mask: int = 0) -> bytes:
        sizes, n = [], size
        for k, f in enumerate(self.filters):
            sizes.append(n)
            n += 4 * (f.ident == FLETCHER32 and not mask >> k & 1)
        for k in range(len(self.filters) - 1, -1, -1):
            if not mask >> k & 1:
                data = _codec(self.filters[k])[1](data, self.filters[k].params, sizes[k])
        if len(data) != size:
            raise InvalidData(f"a chunk of {len(data)} bytes for {size}")
        return data


def _codec(f: Filter) -> tuple[Codec, Codec]:
    if (found := _CODECS.get(f.ident)) is None:
        raise UnsupportedFeature(f"filter {f.ident}{f' ({f.name})' if f.name else ''}")
    return found


def pipeline(text: str, element: int, chunk_bytes: int = 0) -> Pipeline:
    """From text such as ``shuffle,deflate:6``: names with values behind colons. Element and chunk
    sizes are filled in where a filter needs them."""
    made = []
    for item in filter(None, (x.strip() for x in text.split(","))):
        name, *values = item.split(":")
        if name not in NAMES:
            raise UnsupportedFeature(f"no filter named {name}")
        v = [int(x) for x in values]
        defaults = {
            "shuffle": (element,), "deflate": (6,), "gzip": (6,), "zstd": (3,), "bzip2": (9,), "lz4": (0,), "fletcher32": (), "lzf": (4, 0, chunk_bytes),
            "szip": (32 | 8, 8 * element, 8, 256, chunk_bytes), "bitgroom": (3, element), "bitround": (3, element),
            "bitshuffle": (0, 0, element, 0, 2), "blosc": (2, 2, element, chunk_bytes, 5, 1, 1),
        }[name]
        if name == "bitshuffle":
            params = (0, 0, element, v[1] if len(v) > 1 else 0, v[0] if v else 2)
        elif name == "blosc":
            params = (2, 2, element, chunk_bytes, 5, v[1] if len(v) > 1 else 1, v[0] if v else 1)
        elif name == "szip":
            params = (32 | 8, 8 * element, v[0] if v else 8, v[1] if len(v) > 1 else 256, chunk_bytes)
        else:
            params = (*v, *defaults[len(v) :])
        made.append(Filter(NAMES[name], tuple(params)))
    return Pipeline(tuple(made))
