"""Round trips of all filters, published streams, and errors."""

import struct

import numpy as np
import pytest

from cubeframe import errors, filters
from cubeframe.filters import lz, rice

RNG = np.random.default_rng(0)
F32 = np.arange(256, dtype="<f4").tobytes()
F64 = (np.arange(128) * 0.5).astype("<f8").tobytes()
INPUTS = [(F32, 4), (F64, 8), (RNG.integers(0, 256, 4099).astype(np.uint8).tobytes(), 1), (b"abcabcabcabd" * 300, 1), (np.cumsum(RNG.integers(-2, 3, 3000)).astype("<i4").tobytes(), 4), (b"", 4), (b"x", 1), (bytes(1000), 2)]


@pytest.mark.parametrize("text", ["shuffle", "deflate:6", "fletcher32", "szip", "bzip2", "lzf", *[f"blosc:{k}" for k in range(6)], "blosc:1:0", "lz4", "lz4:100", "bitshuffle", "bitshuffle:0", "bitshuffle:0:64", "zstd", "shuffle,deflate:6", "shuffle,zstd:3,fletcher32", "bitshuffle,fletcher32"])
def test_round_trip(text):
    for data, element in INPUTS:
        pipe = filters.pipeline(text, element, len(data))
        assert pipe.decode(pipe.encode(data), len(data)) == data


@pytest.mark.parametrize("bits", [8, 16, 32, 64])
@pytest.mark.parametrize("options", [32, 0, 48])
def test_rice(bits, options):
    for values in (np.zeros(500), np.full(500, 7), RNG.integers(0, 200, 777), np.arange(300) % 251):
        data = values.astype(f"<u{bits // 8}").tobytes()
        for block, line in ((8, 256), (16, 100), (32, 32)):
            params = (options, bits, block, line, len(data))
            assert rice.decode(rice.encode(data, params), params, len(data)) == data


def test_published_blosclz():
    assert lz.blosclz_decode(bytes.fromhex("2342424242e0fff203014242"), 512) == b"B" * 512
    assert lz.blosclz_decode(bytes.fromhex("2f000102030405060708090a0b0c0d0e0fe0ffffffe80f010e0f"), 1024) == bytes(i % 16 for i in range(1024))


def test_lossy():
    for made, kind, digits, bound in ((filters.bitgroom, "<f4", 3, 0.01), (filters.bitround, "<f8", 4, 0.001), (filters.bitround, "<f4", 3, 0.01)):
        x = np.concatenate([RNG.normal(size=500) * 10.0 ** RNG.integers(-8, 8, 500), [0, np.inf, -np.inf, np.nan]]).astype(kind)
        y = np.frombuffer(made(x.tobytes(), (digits, x.itemsize)), kind)
        assert (np.abs(y[:500] - x[:500]) <= bound * np.abs(x[:500])).all()
        assert y[500:].tobytes() == x[500:].tobytes()


def test_fletcher():
    data = filters.pipeline("fletcher32", 1).encode(b"hello world")
    assert len(data) == 15
    assert filters.pipeline("fletcher32", 1).decode(data[:11] + data[:10:-1], 11) == b"hello world"
    with pytest.raises(errors.ChecksumMismatch):
        filters.pipeline("fletcher32", 1).decode(b"j" + data[1:], 11)


@pytest.mark.parametrize(("data", "want"), [(b"00119999", (65535, 54227)), (b"\xff\xff", (65535, 65535)), (b"\xff\xff\0\0", (65535, 65535)), (bytes(8), (0, 0)), (b"", (0, 0))])
def test_fletcher_multiples(data, want):
    """A sum that is a multiple of 65535 is 65535 unless all is zero; readers take 0 for it as well."""
    from cubeframe.codec.checksum import fletcher32

    two, one = 0, 0
    for k in range(0, len(data), 2):  # the published loop, folded at every word
        one += int.from_bytes(data[k : k + 2], "big")
        one = (one & 0xFFFF) + (one >> 16)
        two += one
        two = (two & 0xFFFF) + (two >> 16)
    assert (fletcher32(data) >> 16, fletcher32(data) & 0xFFFF) == (two, one) == want
    pipe = filters.pipeline("fletcher32", 1)
    for order in (">", "<"):
        for made in ((two, one), (two % 65535, one % 65535)):
            assert pipe.decode(data + struct.pack(f"{order}I", made[0] << 16 | made[1]), len(data)) == data


def test_masks_and_errors():
    pipe = filters.pipeline("shuffle,deflate:6", 4)
    assert pipe.decode(filters.shuffle(F32, (4,)), len(F32), mask=2) == F32
    assert pipe.decode(F32, len(F32), mask=3) == F32
    for text in ("deflate", "bzip2", "zstd", "lz4", "lzf", "bitshuffle", "szip", "blosc"):
        with pytest.raises(errors.FormatError):
            filters.pipeline(text, 4, 1024).decode(b"\xff\x01\x02\x03", 1024)
    with pytest.raises(errors.UnsupportedFeature):
        filters.Pipeline((filters.Filter(6),)).decode(b"", 0)
    with pytest.raises(errors.UnsupportedFeature):
        filters.pipeline("nothing", 4)


@pytest.mark.parametrize("near", [True, False])
def test_blosclz(near):
    for data, _ in INPUTS:
        assert lz.blosclz_decode(lz.blosclz_encode(data), len(data)) == data
    noise = RNG.integers(0, 256, 8190 if near else 60000).astype(np.uint8).tobytes()
    for gap in (0, 1, 2, 3):  # on both sides of the distance that 13 bits hold
        data = noise + bytes(gap) + noise
        packed = lz.blosclz_encode(data)
        assert len(packed) < 0.6 * len(data) and lz.blosclz_decode(packed, len(data)) == data
    for n in (9, 10, 262, 263, 264, 265, 519, 520, 5000):  # lengths around those that take one more byte
        assert lz.blosclz_decode(lz.blosclz_encode(b"ab" + b"x" * n), n + 2) == b"ab" + b"x" * n
