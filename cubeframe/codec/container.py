"""Opening containers: discovery of groups, datasets, attributes and links, and reading of their bytes."""

from __future__ import annotations

import itertools
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np

from cubeframe.codec import datatype as dt
from cubeframe.codec import index as ix
from cubeframe.codec import messages as ms
from cubeframe.codec.cursor import Cursor
from cubeframe.errors import BufferTooShort, FormatError, InvalidData, InvalidSignature, NotFound, OutOfBounds, UnsupportedFeature
from cubeframe.filters import Pipeline

SIGNATURE = b"\x89HDF\r\n\x1a\n"
#: Bits of a superblock's flags: open for writing, and for streaming.
WRITING, STREAMING = 1, 4
#: Bytes of heap collections that are kept at most, but for a single larger one.
HEAPS_BYTES = 8 << 20


class File:
    """Positioned reads of a local file or of a URI that Arrow's file systems know."""

    def __init__(self, path: str):
        self.path, self._file = path, None

    def __getstate__(self) -> dict:
        return {"path": self.path, "_file": None}

    def read(self, at: int, n: int) -> bytes:
        if self._file is None:
            if "://" in self.path and not self.path.startswith("file:"):
                from pyarrow import fs

                system, inner = fs.FileSystem.from_uri(self.path)
                self._file = system.open_input_file(inner)
            else:
                self._file = open(local(self.path), "rb", buffering=0)  # noqa: SIM115
        self._file.seek(at)
        data = self._file.read(n)
        while 0 < len(data) < n and (more := self._file.read(n - len(data))):
            data += more
        if len(data) < n:
            raise BufferTooShort(f"{n} bytes at {at} of {self.path}: {len(data)} there")
        return data

    def close(self) -> None:
        if self._file is not None:
            self._file.close()
            self._file = None


def local(path: str) -> str:
    """The path in a mounted file system; containers are written in place, which object stores can't do."""
    if path.startswith("file:"):
        return path[5:].replace("///", "/", 1)
    if "://" in path:
        raise UnsupportedFeature(f"writing to {path}: a mounted folder is needed")
    return path


@dataclass
class Dataset:
    path: str
    address: int
    type: dt.DType
    shape: tuple[int, ...]
    max_shape: tuple[int | None, ...]
    layout: ms.Layout
    filters: Pipeline
    attributes: list[ms.Attribute] = field(default_factory=list)
    fill: bytes = b""  # of a cell that isn't written; empty: zeros

    @property
    def rank(self) -> int:
        return len(self.shape)

    @property
    def size(self) -> int:
        return int(np.prod(self.shape, dtype=object)) if self.shape else 1

    @property
    def chunk(self) -> tuple[int, ...]:
        return self.layout.chunk

    @property
    def grid(self) -> tuple[int, ...]:
        """Chunks along each axis."""
        return tuple(-(-n // c) for n, c in zip(self.shape, self.chunk, strict=True))

    @property
    def chunk_bytes(self) -> int:
        return int(np.prod(self.chunk, dtype=object)) * self.type.size

    def unwritten(self, cells: int) -> bytes:
        return self.fill * cells if self.fill else bytes(cells * self.type.size)


@dataclass
class Container:
    """What a file holds, and reading from it. ``paired`` reads a dialect of chunk indices."""

    file: File
    base: int
    a: int
    l: int
    root: int | None
    version: int
    flags: int = 0
    eof: int | None = None
    paired: bool = False
    datasets: dict[str, Dataset] = field(default_factory=dict)
    groups: dict[str, int] = field(default_factory=dict)
    group_attributes: dict[str, list[ms.Attribute]] = field(default_factory=dict)
    links: list[tuple[str, str, str]] = field(default_factory=list)  # path, kind, target
    skipped: dict[str, str] = field(default_factory=dict)  # path: why it isn't readable
    _heaps: dict[int, Heap] = field(default_factory=dict, repr=False)

    def read(self, at: int, n: int) -> bytes:
        return self.file.read(self.base + at, n)

    def cursor(self, data: bytes) -> Cursor:
        return Cursor(data, addr=self.a, length=self.l)

    def dataset(self, path: str) -> Dataset:
        path = path.strip("/")
        if path in self.datasets:
            return self.datasets[path]
        if path in self.skipped:
            raise UnsupportedFeature(f"{path}: {self.skipped[path]}")
        raise NotFound(f"no dataset {path} in {self.file.path}")

    # --- discovery

    def discover(self) -> None:
        seen: set[int] = set()
        self._object("", self.root, seen, None)

    def _object(self, path: str, address: int, seen: set[int], scratch: tuple[int, int] | None) -> None:
        if address in seen:
            return
        header = ms.read_header(self.read_some, address, self.a, self.l)
        if header.first(ms.LAYOUT) is not None:
            try:
                self.datasets[path] = self._dataset(path, header)
            except FormatError as e:
                self.skipped[path] = f"{type(e).__name__}: {e}"
            return
        seen.add(address)
        self.groups[path] = address
        self.group_attributes[path] = self._attributes(header)
        join = f"{path}/" if path else ""
        for body in header.all(ms.LINK):
            name, kind, target = ms.decode_link(self.cursor(body))
            if kind == "hard":
                self._object(join + name, target, seen, None)
            else:
                self.links.append((join + name, kind, target))
        info = header.first(ms.LINK_INFO)
        if info is not None:
            c = self.cursor(info)
            c.version(0)
            flags = c.u8()
            c.take(8 if flags & 1 else 0)
            if c.address() is not None:
                self.skipped[path or "/"] = "links in a fractal heap"
        table = header.first(ms.SYMBOL_TABLE)
        if table is not None:
            c = self.cursor(table)
            self._symbols(join, c.address(), c.address(), seen)

    def read_some(self, at: int, n: int) -> bytes:
        return self.read(at, n)

    def _symbols(self, join: str, tree: int, heap: int, seen: set[int]) -> None:
        c = self.cursor(self.read(heap, 8 + 2 * self.l + self.a))
        c.sign(b"HEAP")
        c.version(0)
        c.take(3)
        size, _, where = c.size(), c.size(), c.address()
        names = self.read(where, size)

        def nodes(at: int) -> Iterator[int]:
            c = self.cursor(self.read(at, 8 + 2 * self.a))
            c.sign(b"TREE")
            if c.u8() != 0:
                raise InvalidData("not a tree of symbols")
            level, n = c.u8(), c.u16()
            c = self.cursor(self.read(at + 8 + 2 * self.a, n * (self.l + self.a) + self.l))
            for _ in range(n):
                c.take(self.l)
                child = c.address()
                if level:
                    yield from nodes(child)
                else:
                    yield child

        for node in nodes(tree):
            c = self.cursor(self.read(node, 8))
            c.sign(b"SNOD")
            c.version(1)
            c.take(1)
            n = c.u16()
            entry = self.l + self.a + 4 + 4 + 16
            c = self.cursor(self.read(node + 8, n * entry))
            for _ in range(n):
                at, address, kind = c.uint(self.l), c.address(), c.u32()
                c.take(4)
                scratch = c.take(16)
                name = names[at : names.index(b"\0", at)].decode("utf-8", "replace")
                if kind == 2:
                    target = int.from_bytes(scratch[:4], "little")
                    self.links.append((join + name, "soft", names[target : names.index(b"\0", target)].decode("utf-8", "replace")))
                else:
                    self._object(join + name, address, seen, None)

    def _attributes(self, header: ms.Header) -> list[ms.Attribute]:
        out: dict[str, ms.Attribute] = {}
        for body in header.all(ms.ATTRIBUTE):
            try:
                one = ms.decode_attribute(self.cursor(body))
                out[one.name] = one  # of several of one name the last counts
            except FormatError:
                continue
        return list(out.values())

    def _dataset(self, path: str, header: ms.Header) -> Dataset:
        kind, space = header.first(ms.DATATYPE), header.first(ms.DATASPACE)
        if kind is None or space is None:
            raise InvalidData("no type or no shape")
        shape, most = ms.decode_space(self.cursor(space))
        layout = ms.decode_layout(self.cursor(header.first(ms.LAYOUT)))
        pipeline = header.first(ms.FILTERS)
        filters = ms.decode_filters(self.cursor(pipeline)) if pipeline is not None else Pipeline()
        made, fill = dt.decode(self.cursor(kind)), b""
        if (body := header.first(ms.FILL)) is not None:
            fill = ms.decode_fill(self.cursor(body))
        elif (body := header.first(ms.FILL_OLD)) is not None:
            fill = body[4 : 4 + int.from_bytes(body[:4], "little")]
        if fill and len(fill) != made.size:
            raise InvalidData(f"a fill value of {len(fill)} bytes for cells of {made.size}")
        return Dataset(path, header.address, made, shape, most, layout, filters, self._attributes(header), fill)

    # --- chunks

    def chunk_entries(self, d: Dataset) -> dict[tuple[int, ...], ix.Entry]:
        """Stored chunks by coordinates: (address, stored bytes, mask)."""
        lay, rank, grid = d.layout, d.rank, d.grid
        if lay.address is None:
            return {}
        raw = d.chunk_bytes
        if lay.index == ms.SINGLE:
            size, mask = lay.single or (raw, 0)
            return {(0,) * rank: (lay.address, size, mask)}
        if lay.index == ms.IMPLICIT:
            return {at: (lay.address + k * raw, raw, 0) for k, at in enumerate(itertools.product(*map(range, grid)))}
        if lay.index == ms.BTREE2:
            return {at: e for at, e in ix.read_btree2(self.read, lay.address, self.a, self.l, rank, raw, self.paired) if e[0] is not None}
        if lay.index == ms.BTREE1:
            return {tuple(o // c for o, c in zip(at, d.chunk, strict=True)): e for at, e in ix.read_btree1(self.read, lay.address, self.a, self.l, rank) if e[0] is not None}
        if lay.index == ms.FIXED:
            # chunks of the largest shape count, where it is bounded
            full = tuple(-(-n // c) for n, c in zip(d.max_shape, d.chunk, strict=True)) if None not in d.max_shape else grid
            found = ix.read_fixed(self.read, lay.address, self.a, self.l, raw)
            return {tuple(map(int, np.unravel_index(k, full))): e for k, e in found if e[0] is not None}
        order = self.array_axes(d)
        full = tuple(grid[i] if d.max_shape[i] is None else -(-d.max_shape[i] // d.chunk[i]) for i in order)
        inner = full[1:]
        step = int(np.prod(inner, dtype=object)) if inner else 1
        out = {}
        for k, e in ix.read_extensible(self.read, lay.address, self.a, self.l, raw, self.paired):
            if e[0] is not None:
                first, rest = divmod(k, step)
                own = (first, *map(int, np.unravel_index(rest, inner))) if inner else (first,)
                at = [0] * rank
                for i, v in zip(order, own, strict=True):
                    at[i] = v
                out[tuple(at)] = e
        return out

    @staticmethod
    def array_axes(d: Dataset) -> tuple[int, ...]:
        """Axes in the order of an extensible array: the unlimited one first."""
        open_ = next((i for i, n in enumerate(d.max_shape) if n is None), 0)
        return (open_, *(i for i in range(d.rank) if i != open_))

    def decode_chunk(self, d: Dataset, entry: ix.Entry | None) -> np.ndarray:
        """A whole chunk; one that isn't stored has the fill value."""
        kind = dt.np_dtype(d.type)
        n = int(np.prod(d.chunk, dtype=object))
        if entry is None or entry[0] is None:
            return np.frombuffer(d.unwritten(n), _flat(kind)).reshape(d.chunk + _inner(kind))
        raw = d.filters.decode(self.read(entry[0], entry[1]), d.chunk_bytes, entry[2]) if d.filters else self.read(entry[0], d.chunk_bytes)
        return np.frombuffer(raw, _flat(kind)).reshape(d.chunk + _inner(kind))

    def read_rows(self, d: Dataset, start: int, count: int) -> np.ndarray:
        """Rows of the first axis of a contiguous or compact dataset; a scalar is one row of rank 0."""
        kind = dt.np_dtype(d.type)
        row = int(np.prod(d.shape[1:], dtype=object)) if d.shape else 1
        shape = ((count, *d.shape[1:]) if d.shape else ()) + _inner(kind)
        at, n = start * row * d.type.size, count * row * d.type.size
        if d.layout.kind == "compact":
            raw = d.layout.data[at : at + n]
        elif d.layout.address is None:
            raw = d.unwritten(count * row)
        else:
            raw = self.read(d.layout.address + at, n)
        if len(raw) < n:
            raise BufferTooShort(f"{d.path}: {len(raw)} bytes for {n}")
        return np.frombuffer(raw, _flat(kind)).reshape(shape)

    def box(self, d: Dataset, starts: tuple[int, ...], counts: tuple[int, ...]) -> np.ndarray:
        """A sub-box as an array, reading no chunk that it doesn't touch."""
        if len(starts) != d.rank or len(counts) != d.rank:
            raise OutOfBounds(f"a box of rank {len(starts)} in {d.path} of rank {d.rank}")
        if any(s < 0 or c < 0 or s + c > n for s, c, n in zip(starts, counts, d.shape, strict=True)):
            raise OutOfBounds(f"{starts} + {counts} beyond {d.shape} of {d.path}")
        if d.rank == 0:
            return self.read_rows(d, 0, 1)
        cut = tuple(slice(s, s + c) for s, c in zip(starts, counts, strict=True))
        if d.layout.kind != "chunked":
            return self.read_rows(d, starts[0], counts[0])[(slice(None), *cut[1:])]
        kind = dt.np_dtype(d.type)
        out = np.frombuffer(bytearray(d.unwritten(int(np.prod(counts, dtype=object)))), _flat(kind)).reshape(counts + _inner(kind))
        entries = self.chunk_entries(d)
        ranges = [range(s // c, -(-(s + n) // c)) if n else range(0) for s, n, c in zip(starts, counts, d.chunk, strict=True)]
        for at in itertools.product(*ranges):
            if (e := entries.get(at)) is None:
                continue
            low = [max(s, a * c) for s, a, c in zip(starts, at, d.chunk, strict=True)]
            high = [min(s + n, (a + 1) * c) for s, n, a, c in zip(starts, counts, at, d.chunk, strict=True)]
            own = tuple(slice(x - a * c, y - a * c) for x, y, a, c in zip(low, high, at, d.chunk, strict=True))
            out[tuple(slice(x - s, y - s) for x, y, s in zip(low, high, starts, strict=True))] = self.decode_chunk(d, e)[own]
        return out

    # --- variable-length strings

    def strings(self, cells: list[bytes]) -> list[str]:
        """References of 12 bytes (collection, number) or 16 (length before them); undefined ones are empty."""
        if not cells:
            return []
        raw = np.frombuffer(b"".join(cells), np.uint8).reshape(len(cells), -1)
        raw = raw[:, 4 if raw.shape[1] >= 8 + self.a else 0 :]
        if raw.shape[1] < self.a + 4:
            raise BufferTooShort(f"{raw.shape[1]} bytes of a reference")
        where, number = _uints(raw[:, : self.a]), _uints(raw[:, self.a : self.a + 4])
        where[where == (1 << 8 * self.a) - 1] = 0
        out = [""] * len(cells)
        order = np.argsort(where, kind="stable")
        for own in np.split(order, np.flatnonzero(np.diff(where[order])) + 1):
            if at := int(where[own[0]]):
                heap = self._heap(at)
                for i, (start, end) in zip(own.tolist(), heap.spans(number[own]), strict=True):
                    out[i] = heap.data[start:end].decode("utf-8", "replace")
        return out

    def _heap(self, at: int) -> Heap:
        if at not in self._heaps:
            c = self.cursor(self.read(at, 8 + self.l))
            c.sign(b"GCOL")
            c.version(1)
            c.take(3)
            size = c.size()
            found = Heap.of(self.read(at, size), self.l)
            while self._heaps and found.held + sum(h.held for h in self._heaps.values()) > HEAPS_BYTES:
                self._heaps.pop(next(iter(self._heaps)))
            self._heaps[at] = found
        return self._heaps[at]


@dataclass
class Heap:
    """A collection of strings: its bytes, and where the string of each number is in them."""

    data: bytes
    starts: np.ndarray
    ends: np.ndarray

    @classmethod
    def of(cls, data: bytes, l: int) -> Heap:
        at, size, numbers, places, lengths = 8 + l, len(data), [], [], []
        while at + 8 + l <= size:
            number, n = int.from_bytes(data[at : at + 2], "little"), int.from_bytes(data[at + 8 : at + 8 + l], "little")
            if number == 0:
                break
            at += 8 + l
            if at + n > size:
                raise BufferTooShort(f"{n} bytes at {at} of {size}")
            numbers.append(number)
            places.append(at)
            lengths.append(n)
            at = min(size, at + n + -n % 8)
        made = np.zeros((2, max(numbers, default=0) + 1), np.int64)
        made[0, numbers], made[1, numbers] = places, lengths
        return cls(data, made[0], made[0] + made[1])

    @property
    def held(self) -> int:
        return len(self.data) + self.starts.nbytes + self.ends.nbytes

    def spans(self, numbers: np.ndarray) -> Iterator[tuple[int, int]]:
        """Start and end of each; of a number that isn't there, an empty span."""
        known = np.where(numbers < len(self.starts), numbers, 0).astype(np.int64)
        return zip(self.starts[known].tolist(), self.ends[known].tolist(), strict=True)


def _uints(raw: np.ndarray) -> np.ndarray:
    """Little-endian numbers of up to 8 bytes, one a row."""
    made = np.zeros((len(raw), 8), np.uint8)
    made[:, : raw.shape[1]] = raw
    return made.view("<u8")[:, 0]


def _flat(kind: np.dtype) -> np.dtype:
    return kind.base


def _inner(kind: np.dtype) -> tuple[int, ...]:
    return kind.shape


def open_container(path: str, paired: bool = False) -> Container:
    file = File(path)
    base = 0
    while True:  # a user block of 512 bytes, or twice that again and again, may come first
        try:
            head = file.read(base, 8)
        except BufferTooShort:
            raise InvalidSignature(f"{path} is no container") from None
        if head == SIGNATURE:
            break
        base = base * 2 or 512
    version = file.read(base + 8, 1)[0]
    if version in (2, 3):
        a, l, flags = file.read(base + 9, 3)
        c = Cursor(file.read(base, 12 + 4 * a + 4), addr=a, length=l)
        c.take(12)
        at, _, eof, root = c.address(), c.address(), c.address(), c.address()
        c.check(0)
        made = Container(file, base + (at or 0) - base if at else base, a, l, root, version, flags, eof, paired)
        made.discover()
        return made
    if version not in (0, 1):
        raise UnsupportedFeature(f"superblock version {version}")
    a, l = file.read(base + 13, 2)
    c = Cursor(file.read(base, 24 + 4 + 4 * a + l + a + 24), addr=a, length=l)
    c.take(24 if version == 0 else 28)
    c.address(), c.address()
    eof = c.address()
    c.address()
    c.take(l)
    root = c.address()
    made = Container(file, base, a, l, root, version, 0, eof, paired)
    made.discover()
    return made
