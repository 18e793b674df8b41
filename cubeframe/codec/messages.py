"""Object headers and their messages."""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np

from cubeframe.codec import datatype as dt
from cubeframe.codec.cursor import Bytes, Cursor
from cubeframe.errors import BufferTooShort, InvalidData, UnsupportedFeature
from cubeframe.filters import Filter, Pipeline

NIL, DATASPACE, LINK_INFO, DATATYPE, FILL_OLD, FILL, LINK, LAYOUT = 0, 1, 2, 3, 4, 5, 6, 8
GROUP_INFO, FILTERS, ATTRIBUTE, CONTINUATION, SYMBOL_TABLE, ATTRIBUTE_INFO = 10, 11, 12, 16, 17, 21

#: Chunk index kinds of layout version 4, and B-trees of version 1 in layout version 3.
SINGLE, IMPLICIT, FIXED, EXTENSIBLE, BTREE2, BTREE1 = 1, 2, 3, 4, 5, -1


@dataclass
class Layout:
    kind: str  # contiguous, compact or chunked
    address: int | None = None
    size: int = 0
    data: bytes = b""
    chunk: tuple[int, ...] = ()
    index: int = 0
    params: tuple[int, ...] = ()  # of an extensible array: element bits, index elements, pointers, block elements, page bits
    single: tuple[int, int] | None = None  # stored size and mask of a filtered single chunk


@dataclass
class Attribute:
    name: str
    type: dt.DType
    shape: tuple[int, ...]
    raw: bytes


@dataclass
class Header:
    """All messages of an object, in order."""

    messages: list[tuple[int, bytes]] = field(default_factory=list)
    address: int | None = None

    def all(self, kind: int) -> list[bytes]:
        return [body for k, body in self.messages if k == kind]

    def first(self, kind: int) -> bytes | None:
        return next(iter(self.all(kind)), None)


# --- dataspace -------------------------------------------------------------------


def decode_space(c: Cursor) -> tuple[tuple[int, ...], tuple[int | None, ...]]:
    """(shape, largest shape); None stands for unlimited. A null space has the shape (0,)."""
    version = c.version(1, 2)
    rank, flags = c.u8(), c.u8()
    kind = c.u8() if version == 2 else (c.take(5), 1)[1]
    if kind == 2:
        return (0,), (0,)
    shape = tuple(c.size() or 0 for _ in range(rank))
    most = tuple(c.size() for _ in range(rank)) if flags & 1 else shape
    return shape, most


def encode_space(shape: tuple[int, ...], most: tuple[int | None, ...] | None = None) -> bytes:
    out = Bytes().uint(2, 1).uint(len(shape), 1).uint(most is not None and tuple(most) != tuple(shape), 1).uint(bool(shape), 1)
    for n in shape:
        out.size(n)
    if out[2]:
        for n in most:
            out.size(n)
    return bytes(out)


# --- layout --------------------------------------------------------------------------


def decode_layout(c: Cursor) -> Layout:
    version = c.version(1, 2, 3, 4)
    if version < 3:
        rank, kind = c.u8(), c.u8()
        c.take(5)
        address = c.address() if kind else None
        dims = [c.u32() for _ in range(rank)]
        if kind == 0:
            return Layout("compact", data=c.take(c.u32()))
        if kind == 1:
            return Layout("contiguous", address, int(np.prod(dims)))
        return Layout("chunked", address, chunk=tuple(dims[:-1]), index=BTREE1)
    kind = c.u8()
    if kind == 0:
        return Layout("compact", data=c.take(c.u16()))
    if kind == 1:
        address = c.address()
        return Layout("contiguous", address, c.size() or 0)
    if kind != 2:
        raise UnsupportedFeature(f"layout class {kind}")
    if version == 3:
        rank = c.u8()
        address = c.address()
        return Layout("chunked", address, chunk=tuple(c.u32() for _ in range(rank))[:-1], index=BTREE1)
    flags, rank, width = c.u8(), c.u8(), c.u8()
    chunk = tuple(c.uint(width) for _ in range(rank))[:-1]
    index, params, single = c.u8(), (), None
    if index == SINGLE:
        if flags & 2:
            single = (c.size(), c.u32())
    elif index == FIXED:
        params = (c.u8(),)
    elif index == EXTENSIBLE:
        params = tuple(c.u8() for _ in range(5))
    elif index == BTREE2:
        # node size, split and merge shares; a shorter dialect leaves them out
        if len(c.data) - c.at >= 6 + c.a:
            params = (c.u32(), c.u8(), c.u8())
    elif index != IMPLICIT:
        raise UnsupportedFeature(f"chunk index {index}")
    return Layout("chunked", c.address(), chunk=chunk, index=index, params=params, single=single)


def encode_layout(layout: Layout, element: int) -> bytes:
    out = Bytes()
    if layout.kind == "compact":
        if len(layout.data) > 65000:
            raise InvalidData("compact data beyond 65,000 bytes")
        return bytes(out.uint(3, 1).uint(0, 1).uint(len(layout.data), 2) + layout.data)
    if layout.kind == "contiguous":
        return bytes(out.uint(3, 1).uint(1, 1).address(layout.address).size(layout.size))
    dims = (*layout.chunk, element)
    width = max((max(d, 1).bit_length() + 7) // 8 for d in dims)
    out.uint(4, 1).uint(2, 1).uint(2 if layout.single else 0, 1).uint(len(dims), 1).uint(width, 1)
    for d in dims:
        out.uint(d, width)
    out.uint(layout.index, 1)
    if layout.single:
        out.size(layout.single[0]).uint(layout.single[1], 4)
    if layout.index == BTREE2:
        out.uint(layout.params[0], 4).uint(layout.params[1], 1).uint(layout.params[2], 1)
    else:
        for p in layout.params:
            out.uint(p, 1)
    return bytes(out.address(layout.address))


# --- filters ----------------------------------------------------------------------------


def decode_filters(c: Cursor) -> Pipeline:
    version, n = c.version(1, 2), c.u8()
    if version == 1:
        c.take(6)
    made = []
    for _ in range(n):
        ident = c.u16()
        name_len = c.u16() if version == 1 or ident >= 256 else 0
        flags, count = c.u16(), c.u16()
        name = c.take(name_len + (-name_len % 8 if version == 1 else 0)).split(b"\0")[0].decode("utf-8", "replace")
        params = tuple(c.u32() for _ in range(count))
        if version == 1 and count % 2:
            c.take(4)
        made.append(Filter(ident, params, flags, name))
    return Pipeline(tuple(made))


def encode_filters(p: Pipeline) -> bytes:
    out = Bytes().uint(2, 1).uint(len(p.filters), 1)
    for f in p.filters:
        out.uint(f.ident, 2)
        if f.ident >= 256:
            out.uint(0, 2)
        out.uint(f.flags, 2).uint(len(f.params), 2)
        for v in f.params:
            out.uint(v & 0xFFFFFFFF, 4)
    return bytes(out)


# --- attributes, links, fill values ---------------------------------------------------------


def decode_attribute(c: Cursor) -> Attribute:
    version = c.version(1, 2, 3)
    c.take(1)
    n_name, n_type, n_space = c.u16(), c.u16(), c.u16()
    if version == 3:
        c.take(1)
    pad = (lambda n: n + -n % 8) if version == 1 else (lambda n: n)
    name = c.take(pad(n_name)).split(b"\0")[0].decode("utf-8", "replace")
    kind = dt.decode(Cursor(c.take(pad(n_type)), addr=c.a, length=c.l))
    shape, _ = decode_space(Cursor(c.take(pad(n_space)), addr=c.a, length=c.l))
    return Attribute(name, kind, shape, c.take(min(len(c.data) - c.at, kind.size * int(np.prod(shape, dtype=np.int64)))))


def encode_attribute(a: Attribute) -> bytes:
    name, kind, space = a.name.encode() + b"\0", dt.encode(a.type), encode_space(a.shape)
    if max(map(len, (name, kind, space))) > 65535 or len(a.raw) > 65000:
        raise InvalidData(f"attribute {a.name} is too large for a message")
    return bytes(Bytes().uint(3, 1).uint(0, 1).uint(len(name), 2).uint(len(kind), 2).uint(len(space), 2).uint(1, 1) + name + kind + space + a.raw)


def string_attribute(name: str, value: str) -> Attribute:
    raw = value.encode() + b"\0"
    return Attribute(name, dt.DType("string", len(raw)), (), raw)


def number_attribute(name: str, value: float | int, kind: dt.DType | None = None) -> Attribute:
    kind = kind or (dt.real(8) if isinstance(value, float) else dt.integer(8))
    return Attribute(name, kind, (), np.array(value).astype(dt.np_dtype(kind)).tobytes())


def decode_link(c: Cursor) -> tuple[str, str, int | str | None]:
    """(name, hard soft or external, address or target)."""
    c.version(1)
    flags = c.u8()
    kind = c.u8() if flags & 8 else 0
    if flags & 4:
        c.take(8)
    if flags & 16:
        c.take(1)
    name = c.take(c.uint(1 << (flags & 3))).decode("utf-8", "replace")
    if kind == 0:
        return name, "hard", c.address()
    target = c.take(c.u16())
    return (name, "soft", target.decode("utf-8", "replace")) if kind == 1 else (name, "external", target[1:].split(b"\0")[0].decode("utf-8", "replace"))


def encode_link(name: str, target: int | str) -> bytes:
    raw = name.encode()
    size = 0 if len(raw) < 256 else 1
    out = Bytes().uint(1, 1).uint(0x18 | size, 1).uint(isinstance(target, str), 1).uint(1, 1).uint(len(raw), 1 << size)
    out += raw
    if isinstance(target, str):
        out.uint(len(target.encode()), 2)
        out += target.encode()
    else:
        out.address(target)
    return bytes(out)


def encode_fill(early: bool, value: bytes = b"") -> bytes:
    """The bytes of a cell that isn't written; none: zeros. Space is taken at once or chunk by chunk."""
    out = Bytes().uint(3, 1).uint((1 if early else 3) | (32 if value else 0), 1)
    if value:
        out.uint(len(value), 4)
        out += value
    return bytes(out)


def decode_fill(c: Cursor) -> bytes:
    """The bytes of a cell that isn't written; empty where the default, zero, holds or none is defined."""
    version = c.u8()
    if version == 3:
        return c.take(c.u32()) if c.u8() & 32 else b""
    if version not in (1, 2):
        raise UnsupportedFeature(f"fill value version {version}")
    c.take(2)
    if not c.u8() and version == 2:
        return b""
    return c.take(c.u32())


# --- object headers ---------------------------------------------------------------------------


def encode_header(messages: list[tuple[int, bytes]]) -> bytes:
    body = Bytes()
    for kind, data in messages:
        if len(data) > 65535:
            raise InvalidData(f"a message of {len(data)} bytes")
        body.uint(kind, 1).uint(len(data), 2).uint(0, 1)
        body += data
    out = Bytes(b"OHDR")
    out.uint(2, 1).uint(2, 1).uint(len(body), 4)
    out += body
    return out.sealed()


def read_header(read, address: int, a: int, l: int) -> Header:
    """Of either version, with its continuations; ``read(address, size)`` gives bytes."""
    out = Header(address=address)
    start = read(address, 16)
    if start[:4] == b"OHDR":
        flags = start[5]
        at = 6 + (16 if flags & 32 else 0) + (4 if flags & 16 else 0)
        width = 1 << (flags & 3)
        size = int.from_bytes(read(address + at, width), "little")
        c = Cursor(read(address, at + width + size + 4), addr=a, length=l)
        if start[4] != 2:
            raise InvalidData(f"object header version {start[4]}")
        c.take(at + width)
        blocks = [(c, c.at + size, 0)]
        while blocks:
            c, end, begin = blocks.pop(0)
            while c.at + 4 + (2 if flags & 4 else 0) <= end:
                kind, n, _ = c.u8(), c.u16(), c.u8()
                if flags & 4:
                    c.take(2)
                body = c.take(n)
                if kind == CONTINUATION:
                    more = Cursor(body, addr=a, length=l)
                    where, many = more.address(), more.size()
                    block = Cursor(read(where, many), addr=a, length=l)
                    block.sign(b"OCHK")
                    blocks.append((block, many - 4, 0))
                elif kind != NIL:
                    out.messages.append((kind, body))
            c.at = end
            c.check(begin)
        return out
    if start[0] != 1:
        raise InvalidData(f"no object header at {address}")
    n_messages, size = int.from_bytes(start[2:4], "little"), int.from_bytes(start[8:12], "little")
    blocks = [(address + 16, size)]
    while blocks and n_messages > 0:
        where, many = blocks.pop(0)
        c = Cursor(read(where, many), addr=a, length=l)
        while c.at + 8 <= many and n_messages > 0:
            kind, n, flags = c.u16(), c.u16(), c.u8()
            c.take(3)
            try:
                body = c.take(n)
            except BufferTooShort:
                break
            n_messages -= 1
            if kind == CONTINUATION:
                more = Cursor(body, addr=a, length=l)
                blocks.append((more.address(), more.size()))
            elif kind != NIL:
                if flags & 2:
                    raise UnsupportedFeature("shared messages")
                out.messages.append((kind, body))
    return out

