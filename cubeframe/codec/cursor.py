"""Reading and writing of little-endian fields with the container's address and length widths."""

from __future__ import annotations

from cubeframe.errors import BufferTooShort, ChecksumMismatch, InvalidSignature, InvalidVersion
from cubeframe.codec.checksum import lookup3

UNDEF = (1 << 64) - 1


class Cursor:
    def __init__(self, data: bytes, at: int = 0, addr: int = 8, length: int = 8):
        self.data, self.at, self.a, self.l = data, at, addr, length

    def take(self, n: int) -> bytes:
        if n < 0 or self.at + n > len(self.data):
            raise BufferTooShort(f"{n} bytes at {self.at} of {len(self.data)}")
        self.at += n
        return self.data[self.at - n : self.at]

    def uint(self, n: int) -> int:
        return int.from_bytes(self.take(n), "little")

    def u8(self) -> int:
        return self.uint(1)

    def u16(self) -> int:
        return self.uint(2)

    def u32(self) -> int:
        return self.uint(4)

    def address(self) -> int | None:
        """None for the undefined address, all ones in its width."""
        value = self.uint(self.a)
        return None if value == (1 << 8 * self.a) - 1 else value

    def size(self) -> int | None:
        value = self.uint(self.l)
        return None if value == (1 << 8 * self.l) - 1 else value

    def sign(self, mark: bytes) -> None:
        if (got := self.take(len(mark))) != mark:
            raise InvalidSignature(f"{got!r} for {mark!r}")

    def version(self, *known: int) -> int:
        if (got := self.u8()) not in known:
            raise InvalidVersion(f"{got}, known: {known}")
        return got

    def align(self, n: int, base: int = 0) -> None:
        self.take(-(self.at - base) % n)

    def text(self, stop: bytes = b"\0") -> str:
        end = self.data.find(stop, self.at)
        if end < 0:
            raise BufferTooShort("no end of text")
        return self.take(end + 1 - self.at)[:-1].decode("utf-8", "replace")

    def check(self, start: int) -> None:
        """The checksum of all bytes from ``start`` on."""
        want = lookup3(self.data[start : self.at])
        if (got := self.u32()) != want:
            raise ChecksumMismatch(f"{got:08x} for {want:08x}")


class Bytes(bytearray):
    """A buffer that is written field by field."""

    a = l = 8

    def uint(self, value: int, n: int) -> Bytes:
        self += value.to_bytes(n, "little")
        return self

    def address(self, value: int | None) -> Bytes:
        return self.uint(UNDEF if value is None else value, self.a)

    def size(self, value: int | None) -> Bytes:
        return self.uint(UNDEF if value is None else value, self.l)

    def sealed(self) -> bytes:
        return bytes(self) + lookup3(bytes(self)).to_bytes(4, "little")
