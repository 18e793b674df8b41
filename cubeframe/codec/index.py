"""Chunk indices: fixed arrays, extensible arrays, B-trees; reading and writing.

Entries are (address or None, stored bytes, mask) by linear chunk number for arrays, and by
chunk coordinates for trees.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

from cubeframe.codec.cursor import Bytes, Cursor
from cubeframe.errors import InvalidData, UnsupportedFeature

Read = Callable[[int, int], bytes]
Entry = tuple[int | None, int, int]

#: Of extensible arrays that are written: bits of a number, elements in the index block, least
#: pointers of a super block, least elements of a data block, bits of a page.
EA_PARAMS = (32, 4, 4, 16, 10)
FA_PAGE_BITS = 10
BT2_NODE, BT2_SPLIT, BT2_MERGE = 4096, 100, 40


def size_width(chunk_bytes: int) -> int:
    """Bytes of a filtered chunk's stored size."""
    return min(8, 1 + (max(chunk_bytes, 1).bit_length() - 1 + 8) // 8)


class Elements:
    """How array elements are stored: an address, or with filters also size and mask."""

    def __init__(self, filtered: bool, chunk_bytes: int):
        self.filtered, self.chunk_bytes = filtered, chunk_bytes
        self.width = size_width(chunk_bytes)

    @property
    def size(self) -> int:
        return 8 + (self.width + 4 if self.filtered else 0)

    def read(self, c: Cursor) -> Entry:
        address = c.address()
        return (address, c.uint(self.width), c.u32()) if self.filtered else (address, self.chunk_bytes, 0)

    def write(self, out: Bytes, e: Entry) -> None:
        out.address(e[0])
        if self.filtered:
            out.uint(e[1] if e[0] is not None else 0, self.width).uint(e[2], 4)


NONE: Entry = (None, 0, 0)

# --- fixed array ------------------------------------------------------------------------


def read_fixed(read: Read, address: int, a: int, l: int, chunk_bytes: int) -> Iterator[tuple[int, Entry]]:
    c = Cursor(read(address, 4 + 4 + l + a + 4), addr=a, length=l)
    c.sign(b"FAHD")
    c.version(0)
    client, element, page_bits, n, block = c.u8(), c.u8(), c.u8(), c.size(), c.address()
    c.check(0)
    if block is None:
        return
    e = Elements(client == 1, chunk_bytes)
    e.width = element - a - 4 if client == 1 else e.width
    page = 1 << page_bits
    paged = bool(page_bits) and n > page
    pages = -(-n // page) if paged else 0
    head = 4 + 2 + a + (-(-pages // 8) if paged else 0)
    if not paged:
        c = Cursor(read(block, head + n * element + 4), addr=a, length=l)
        c.sign(b"FADB")
        c.take(head - 4)
        for i in range(n):
            yield i, e.read(c)
        c.check(0)
        return
    c = Cursor(read(block, head + 4), addr=a, length=l)
    c.sign(b"FADB")
    c.take(2 + a)
    there = c.take(-(-pages // 8))
    c.check(0)
    at = block + head + 4
    for k in range(pages):
        many = min(page, n - k * page)
        if there[k // 8] & 0x80 >> k % 8:
            c = Cursor(read(at, many * element + 4), addr=a, length=l)
            for i in range(many):
                yield k * page + i, e.read(c)
            c.check(0)
        at += page * element + 4


def write_fixed(put: Callable[[bytes], int], reserve: Callable[[int], int], poke: Callable[[int, bytes], None], entries: list[Entry], filtered: bool, chunk_bytes: int) -> int:
    e, n, page = Elements(filtered, chunk_bytes), len(entries), 1 << FA_PAGE_BITS
    header = reserve(4 + 4 + 8 + 8 + 4)
    out = Bytes(b"FADB")
    out.uint(0, 1).uint(filtered, 1).address(header)
    if n <= page:
        for x in entries:
            e.write(out, x)
        block = put(out.sealed())
    else:
        pages = -(-n // page)
        bits = bytearray(-(-pages // 8))
        for k in range(pages):
            bits[k // 8] |= 0x80 >> k % 8
        out += bits
        parts = [out.sealed()]
        for k in range(pages):
            own = Bytes()
            for x in entries[k * page : (k + 1) * page]:
                e.write(own, x)
            parts.append(own.sealed())
        block = put(b"".join(parts))
    head = Bytes(b"FAHD")
    head.uint(0, 1).uint(filtered, 1).uint(e.size, 1).uint(FA_PAGE_BITS, 1).size(n).address(block)
    poke(header, head.sealed())
    return header


# --- extensible array ----------------------------------------------------------------------


class Geometry:
    """Where elements stand: a few in the index block, then data blocks that double in turn in
    number and size, of which the first are pointed to by the index block and the others by super blocks."""

    def __init__(self, params: tuple[int, ...], paired: bool = False):
        self.bits, self.first, pointers, self.least, page_bits = params
        self.page = 1 << page_bits if page_bits else 1 << 62
        self.offset_width = (self.bits + 7) // 8
        self.direct = 2 * (pointers - 1)
        self.direct_supers = 2 * (pointers.bit_length() - 1)
        supers = 1 + self.bits - (self.least.bit_length() - 1)
        self.n_supers = supers - self.direct_supers
        self.supers: list[tuple[int, int, int]] = []  # (first element, blocks, elements of a block)
        at = 0
        for s in range(supers):
            blocks, size = 1 << s // 2, self.least << (s + 1) // 2
            self.supers.append((at, blocks, size))
            at += blocks * size
        if paired:  # a dialect: direct blocks in pairs of one size, nothing beyond them
            self.supers = [(0, self.direct, 0)]
            self.n_supers_paired = True
        self.paired = paired

    def direct_blocks(self) -> list[tuple[int, int]]:
        """(first element after the index block's own, elements) of the blocks that the index block points to."""
        out, at = [], 0
        if self.paired:
            for k in range(self.direct):
                size = self.least << k // 2
                out.append((at, size))
                at += size
            return out
        for start, blocks, size in self.supers[: self.direct_supers]:
            out += [(start + b * size, size) for b in range(blocks)]
        return out


def read_extensible(read: Read, address: int, a: int, l: int, chunk_bytes: int, paired: bool = False) -> Iterator[tuple[int, Entry]]:
    """``paired`` reads files whose direct data blocks come in pairs of 16, 32 and 64 elements."""
    c = Cursor(read(address, 4 + 8 + 6 * l + a + 4), addr=a, length=l)
    c.sign(b"EAHD")
    c.version(0)
    client, element = c.u8(), c.u8()
    bits, first, least, pointers, page_bits = (c.u8() for _ in range(5))
    stats = [c.size() for _ in range(6)]
    block = c.address()
    c.check(0)
    if block is None:
        return
    g = Geometry((bits, first, pointers, least, page_bits), paired)
    e = Elements(client == 1, chunk_bytes)
    e.width = element - a - 4 if client == 1 else e.width
    direct = g.direct_blocks()
    tail = g.n_supers
    c = Cursor(read(block, 6 + a + first * element + (len(direct) + tail) * a + 4), addr=a, length=l)
    c.sign(b"EAIB")
    c.take(2 + a)
    for i in range(first):
        yield i, e.read(c)
    blocks = [c.address() for _ in direct]
    supers = [c.address() for _ in range(tail)]
    c.check(0)
    most = stats[4]

    def data(where: int, start: int, n: int, bitmap: bytes | None) -> Iterator[tuple[int, Entry]]:
        head = 6 + a + g.offset_width
        if n <= g.page:
            c = Cursor(read(where, head + n * element + 4), addr=a, length=l)
            c.sign(b"EADB")
            c.take(head - 4)
            for i in range(n):
                yield first + start + i, e.read(c)
            c.check(0)
            return
        c = Cursor(read(where, head + 4), addr=a, length=l)
        c.sign(b"EADB")
        c.take(head - 4)
        c.check(0)
        at = where + head + 4
        for k in range(n // g.page):
            if bitmap is None or bitmap[k // 8] & 0x80 >> k % 8:
                c = Cursor(read(at, g.page * element + 4), addr=a, length=l)
                for i in range(g.page):
                    yield first + start + k * g.page + i, e.read(c)
                c.check(0)
            at += g.page * element + 4

    for where, (start, n) in zip(blocks, direct, strict=True):
        if where is not None:
            yield from data(where, start, n, None)
    if paired:
        if most is not None and most > first + sum(n for _, n in direct):
            raise UnsupportedFeature("a paired extensible array beyond its direct blocks")
        return
    for where, (start, many, n) in zip(supers, g.supers[g.direct_supers :], strict=True):
        if where is None:
            continue
        pages = n // g.page if n > g.page else 0
        each = -(-pages // 8)
        c = Cursor(read(where, 6 + a + g.offset_width + many * each + many * a + 4), addr=a, length=l)
        c.sign(b"EASB")
        c.take(2 + a + g.offset_width)
        maps = [c.take(each) for _ in range(many)]
        found = [c.address() for _ in range(many)]
        c.check(0)
        for k, (at, bitmap) in enumerate(zip(found, maps, strict=True)):
            if at is not None:
                yield from data(at, start + k * n, n, bitmap if pages else None)


def write_extensible(put: Callable[[bytes], int], reserve: Callable[[int], int], poke: Callable[[int, bytes], None], entries: list[Entry], filtered: bool, chunk_bytes: int) -> int:
    """All blocks up to the last entry; entries that aren't there have no address."""
    g, e = Geometry(EA_PARAMS), Elements(filtered, chunk_bytes)
    header = reserve(4 + 8 + 6 * 8 + 8 + 4)
    n_super = n_data = super_bytes = data_bytes = 0

    def data(start: int, n: int) -> int | None:
        nonlocal n_data, data_bytes
        at = g.first + start
        if at >= len(entries):
            return None
        own = entries[at : at + n]
        own = own + [NONE] * (n - len(own))
        out = Bytes(b"EADB")
        out.uint(0, 1).uint(filtered, 1).address(header).uint(start, g.offset_width)
        if n <= g.page:
            for x in own:
                e.write(out, x)
            raw = out.sealed()
        else:
            parts = [out.sealed()]
            for k in range(0, n, g.page):
                page = Bytes()
                for x in own[k : k + g.page]:
                    e.write(page, x)
                parts.append(page.sealed())
            raw = b"".join(parts)
        n_data, data_bytes = n_data + 1, data_bytes + len(raw)
        return put(raw)

    index = Bytes(b"EAIB")
    index.uint(0, 1).uint(filtered, 1).address(header)
    for x in (entries[: g.first] + [NONE] * g.first)[: g.first]:
        e.write(index, x)
    for start, n in g.direct_blocks():
        index.address(data(start, n))
    for start, many, n in g.supers[g.direct_supers :]:
        if g.first + start >= len(entries):
            index.address(None)
            continue
        blocks = [data(start + k * n, n) for k in range(many)]
        out = Bytes(b"EASB")
        out.uint(0, 1).uint(filtered, 1).address(header).uint(start, g.offset_width)
        if n > g.page:
            for where in blocks:
                bits = bytearray(-(-(n // g.page) // 8))
                for k in range(n // g.page if where is not None else 0):
                    bits[k // 8] |= 0x80 >> k % 8
                out += bits
        for where in blocks:
            out.address(where)
        raw = out.sealed()
        n_super, super_bytes = n_super + 1, super_bytes + len(raw)
        index.address(put(raw))
    block = put(index.sealed())
    realized = g.first + sum(n for start, n in g.direct_blocks() if g.first + start < len(entries)) + sum(many * n for start, many, n in g.supers[g.direct_supers :] if g.first + start < len(entries))
    head = Bytes(b"EAHD")
    head.uint(0, 1).uint(filtered, 1).uint(e.size, 1)
    bits, first, pointers, least, page_bits = EA_PARAMS
    for v in (bits, first, least, pointers, page_bits):
        head.uint(v, 1)
    for v in (n_super, super_bytes, n_data, data_bytes, len(entries), realized):
        head.size(v)
    poke(header, head.address(block).sealed())
    return header


# --- B-tree version 2 -----------------------------------------------------------------------


def _ranks(node: int, record: int, depth: int, a: int) -> list[tuple[int, int, int]]:
    """By level: (most records of a node, most records of its subtree, bytes of that count)."""
    width = lambda n: max(1, (n.bit_length() + 7) // 8)
    leaf = (node - 10) // record
    out = [(leaf, leaf, 0)]
    for level in range(1, depth + 1):
        pointer = a + width(leaf) + (out[level - 1][2] if level > 1 else 0)
        most = (node - 10 - pointer) // (record + pointer)
        total = (most + 1) * out[-1][1] + most
        out.append((most, total, width(total)))
    return out


def read_btree2(read: Read, address: int, a: int, l: int, rank: int, chunk_bytes: int, paired: bool = False) -> Iterator[tuple[tuple[int, ...], Entry]]:
    """``paired`` is a dialect whose records put the coordinates before the address."""
    c = Cursor(read(address, 4 + 2 + 4 + 2 + 2 + 2 + a + 2 + l + 4), addr=a, length=l)
    c.sign(b"BTHD")
    c.version(0)
    kind, node, record, depth = c.u8(), c.u32(), c.u16(), c.u16()
    c.take(2)
    root, n_root, _ = c.address(), c.u16(), c.size()
    c.check(0)
    if kind not in (10, 11):
        raise InvalidData(f"tree of kind {kind}")
    if root is None or n_root == 0:
        return
    width = record - a - 8 * rank - (4 if kind == 11 else 0)
    ranks = _ranks(node, record, depth, a)
    bytes_of = lambda n: max(1, (n.bit_length() + 7) // 8)

    def one(c: Cursor) -> tuple[tuple[int, ...], Entry]:
        at = tuple(c.uint(8) for _ in range(rank)) if paired else ()
        where = c.address()
        size, mask = (c.uint(width), c.u32()) if kind == 11 else (chunk_bytes, 0)
        return at or tuple(c.uint(8) for _ in range(rank)), (where, size, mask)

    def walk(where: int, n: int, level: int) -> Iterator[tuple[tuple[int, ...], Entry]]:
        if level == 0:
            c = Cursor(read(where, 6 + n * record + 4), addr=a, length=l)
            c.sign(b"BTLF")
            c.take(2)
            yield from [one(c) for _ in range(n)]
            c.check(0)
            return
        small, large = bytes_of(ranks[0][0]), ranks[level - 1][2] if level > 1 else 0
        c = Cursor(read(where, 6 + n * record + (n + 1) * (a + small + large) + 4), addr=a, length=l)
        c.sign(b"BTIN")
        c.take(2)
        own = [one(c) for _ in range(n)]
        below = []
        for _ in range(n + 1):
            below.append((c.address(), c.uint(small)))
            c.take(large)
        c.check(0)
        for k, (child, many) in enumerate(below):
            yield from walk(child, many, level - 1)
            if k < n:
                yield own[k]

    yield from walk(root, n_root, depth)


def write_btree2(put: Callable[[bytes], int], entries: list[tuple[tuple[int, ...], Entry]], rank: int, filtered: bool, chunk_bytes: int) -> int:
    """A tree filled from its sorted records, leaves first."""
    e = Elements(filtered, chunk_bytes)
    record, kind = e.size + 8 * rank, 11 if filtered else 10
    entries = sorted(entries)
    depth = 0
    while (ranks := _ranks(BT2_NODE, record, depth, 8))[-1][1] < len(entries):
        depth += 1
    bytes_of = lambda n: max(1, (n.bit_length() + 7) // 8)

    def raw(x: tuple[tuple[int, ...], Entry]) -> bytes:
        out = Bytes()
        e.write(out, x[1])
        for v in x[0]:
            out.uint(v, 8)
        return bytes(out)

    def build(own: list, level: int) -> tuple[int, int, int]:
        """(address, records of the node, of all below)."""
        if level == 0:
            out = Bytes(b"BTLF")
            out.uint(0, 1).uint(kind, 1)
            out += b"".join(map(raw, own))
            return put(out.sealed()), len(own), len(own)
        capacity = ranks[level - 1][1]
        children = max(2, -(-(len(own) + 1) // (capacity + 1)))
        # evenly filled children with one record between each two
        cuts = [k * (len(own) + 1) // children for k in range(children + 1)]
        parts = [own[a : b - 1] for a, b in zip(cuts, cuts[1:])]
        keys = [own[b - 1] for b in cuts[1:-1]]
        small, large = bytes_of(ranks[0][0]), ranks[level - 1][2] if level > 1 else 0
        out = Bytes(b"BTIN")
        out.uint(0, 1).uint(kind, 1)
        out += b"".join(map(raw, keys))
        total = len(keys)
        for part in parts:
            where, n, below = build(part, level - 1)
            out.address(where).uint(n, small)
            if large:
                out.uint(below, large)
            total += below
        return put(out.sealed()), len(keys), total

    root, n_root, _ = build(entries, depth) if entries else (None, 0, 0)
    head = Bytes(b"BTHD")
    head.uint(0, 1).uint(kind, 1).uint(BT2_NODE, 4).uint(record, 2).uint(depth, 2).uint(BT2_SPLIT, 1).uint(BT2_MERGE, 1).address(root).uint(n_root, 2).size(len(entries))
    return put(head.sealed())


# --- B-tree version 1 ----------------------------------------------------------------------------


def read_btree1(read: Read, address: int | None, a: int, l: int, rank: int) -> Iterator[tuple[tuple[int, ...], Entry]]:
    """Chunk offsets in elements, as version 3 layouts have them."""
    if address is None:
        return
    c = Cursor(read(address, 8 + 2 * a), addr=a, length=l)
    c.sign(b"TREE")
    if c.u8() != 1:
        raise InvalidData("not a tree of chunks")
    level, n = c.u8(), c.u16()
    key = 8 + 8 * (rank + 1)
    c = Cursor(read(address + 8 + 2 * a, n * (key + a)), addr=a, length=l)
    for _ in range(n):
        size, mask = c.u32(), c.u32()
        at = tuple(c.uint(8) for _ in range(rank + 1))[:-1]
        child = c.address()
        if level:
            yield from read_btree1(read, child, a, l, rank)
        else:
            yield at, (child, size, mask)
