"""Writing containers: blocks are appended, and a superblock written last makes them visible.

Nothing that a reader may be using is overwritten but the superblock itself, in one write after
all else is on disk, so a reader sees the state before or after, and a crash loses only the new.
"""

from __future__ import annotations

import os
from collections.abc import Callable, Iterable
from dataclasses import dataclass, field, replace

import numpy as np

from cubeframe.codec import datatype as dt
from cubeframe.codec import index as ix
from cubeframe.codec import messages as ms
from cubeframe.codec.container import SIGNATURE, Container, Dataset, local, open_container
from cubeframe.codec.cursor import Bytes
from cubeframe.errors import InvalidState, NotFound
from cubeframe.filters import Pipeline

#: Bytes of a heap collection, but for single larger strings, and objects in it. Readers take whole
#: collections, and tasks write chunks that aren't neighbours, so one should hold few chunks' strings.
HEAP_BYTES, HEAP_OBJECTS = 1 << 15, 60_000


#: A reference to a string: its length, the address of its collection, its number there (from 1).
REF = np.dtype([("n", "<u4"), ("at", "<u8"), ("k", "<u4")])


class Heap:
    """Collections of strings, one after the other; each goes to ``write`` when full, so one is held."""

    def __init__(self, write: Callable[[bytes], object]):
        self.write = write
        self.body, self.count, self.start = Bytes(), 0, 0

    def add(self, texts: Iterable[bytes]) -> np.ndarray:
        """References with addresses counted from the first collection."""
        refs = []
        for raw in texts:
            if self.count and (len(self.body) + len(raw) > HEAP_BYTES or self.count >= HEAP_OBJECTS):
                self.close()
            self.count += 1
            self.body.uint(self.count, 2).uint(1, 2).uint(0, 4).size(len(raw))
            self.body += raw + bytes(-len(raw) % 8)
            refs.append((len(raw), self.start, self.count))
        made = np.zeros(len(refs), REF)
        if refs:
            made["n"], made["at"], made["k"] = zip(*refs, strict=True)
        return made

    def close(self) -> None:
        """Write the collection that is held; more may follow."""
        if not self.count:
            return
        size = max(4096, 16 + len(self.body) + 16)
        out = Bytes(b"GCOL")
        out.uint(1, 1).uint(0, 3).size(size)
        out += self.body
        left = size - 16 - len(self.body)
        out += (Bytes().uint(0, 2).uint(0, 2).uint(0, 4).size(left) + bytes(left - 16)) if left >= 16 else bytes(left)
        out += bytes(-len(out) % 8)
        self.write(out)
        self.body, self.count, self.start = Bytes(), 0, self.start + len(out)


def heap_collections(texts: Iterable[bytes]) -> tuple[bytes, np.ndarray]:
    """(collections one after the other, references with addresses counted from their start)."""
    out = bytearray()
    heap = Heap(out.extend)
    refs = heap.add(texts)
    heap.close()
    return bytes(out), refs


@dataclass
class Spec:
    """A dataset to write."""

    path: str
    type: dt.DType
    shape: tuple[int, ...]
    max_shape: tuple[int | None, ...] | None = None
    chunk: tuple[int, ...] = ()
    filters: Pipeline = Pipeline()
    index: str = ""  # single, fixed, extensible or btree2; chosen by the largest shape if empty
    attributes: list[ms.Attribute] = field(default_factory=list)
    fill: bytes = b""  # of a cell that isn't written; empty: zeros

    def index_kind(self) -> int:
        most = self.max_shape or self.shape
        unlimited = sum(n is None for n in most)
        if self.index:
            kind = {"single": ms.SINGLE, "implicit": ms.IMPLICIT, "fixed": ms.FIXED, "extensible": ms.EXTENSIBLE, "btree2": ms.BTREE2}[self.index]
        else:
            kind = ms.BTREE2 if unlimited > 1 else ms.EXTENSIBLE if unlimited else ms.FIXED
        if kind == ms.FIXED and unlimited or kind == ms.EXTENSIBLE and unlimited > 1:
            raise InvalidState(f"{self.path}: this index can't have {unlimited} unlimited axes")
        if kind == ms.SINGLE and any(c < n for c, n in zip(self.chunk, self.shape, strict=True)):
            raise InvalidState(f"{self.path}: more than one chunk")
        return kind


class Builder:
    """An open container. ``append`` keeps what an existing one holds."""

    def __init__(self, path: str, append: bool = False):
        self.path = local(path)
        self.old: Container | None = open_container(self.path) if append and os.path.exists(self.path) else None
        if self.old and (self.old.base or (self.old.a, self.old.l) != (8, 8)):
            raise InvalidState("only containers with 8-byte addresses and no user block can be appended to")
        self.file = open(self.path, "r+b" if self.old else "w+b")  # noqa: SIM115
        self.version = 3
        self.end = 48 if not self.old else os.path.getsize(self.path)
        if not self.old:
            self.file.write(bytes(48))
        self.objects: dict[str, int] = {}
        self.groups: dict[str, list[ms.Attribute]] = {"": []}
        self.links: dict[str, str] = {}
        if self.old:
            self.objects = {p: d.address for p, d in self.old.datasets.items()}
            self.groups |= {p: list(a) for p, a in self.old.group_attributes.items()}
            self.links = {p: t for p, kind, t in self.old.links if kind == "soft"}
            if self.old.skipped:
                raise InvalidState(f"parts that can't be read would be lost: {sorted(self.old.skipped)}")

    # --- space

    def reserve(self, n: int) -> int:
        self.end += -self.end % 8
        at = self.end
        self.end += n
        return at

    def poke(self, at: int, data: bytes) -> None:
        self.file.seek(at)
        self.file.write(data)

    def put(self, data: bytes) -> int:
        at = self.reserve(len(data))
        self.poke(at, data)
        return at

    # --- objects

    def group(self, path: str, attributes: Iterable[ms.Attribute] = ()) -> None:
        """Create a group, and those above it; attributes replace ones of their names."""
        path = path.strip("/")
        if path in self.objects:
            raise InvalidState(f"{path} is a dataset")
        parts = path.split("/") if path else []
        for k in range(1, len(parts) + 1):
            self.groups.setdefault("/".join(parts[:k]), [])
        have = {a.name: a for a in self.groups[path]}
        have |= {a.name: a for a in attributes}
        self.groups[path] = list(have.values())

    def _claim(self, path: str, replace_: bool) -> str:
        path = path.strip("/")
        if not path:
            raise InvalidState("a dataset needs a name")
        if path in self.groups or path in self.objects and not replace_:
            raise InvalidState(f"{path} exists")
        if "/" in path:
            self.group(path.rpartition("/")[0])
        return path

    def contiguous(self, spec: Spec, address: int | None, replace_: bool = False) -> None:
        path = self._claim(spec.path, replace_)
        size = (int(np.prod(spec.shape, dtype=object)) if spec.shape else 1) * spec.type.size
        self._header(replace(spec, path=path), ms.Layout("contiguous", address if size else None, size), True)

    def compact(self, spec: Spec, data: bytes, replace_: bool = False) -> None:
        self._header(replace(spec, path=self._claim(spec.path, replace_)), ms.Layout("compact", data=data), True)

    def chunked(self, spec: Spec, entries: dict[tuple[int, ...], ix.Entry], replace_: bool = False) -> None:
        """Index chunks that are stored already, by their coordinates."""
        path = self._claim(spec.path, replace_)
        kind, filtered = spec.index_kind(), bool(spec.filters)
        raw = int(np.prod(spec.chunk, dtype=object)) * spec.type.size
        most = spec.max_shape or spec.shape
        layout = ms.Layout("chunked", None, chunk=spec.chunk, index=kind)
        if kind == ms.SINGLE:
            one = entries.get((0,) * len(spec.shape))
            layout.address = one[0] if one else None
            layout.single = (one[1], one[2]) if one and filtered else None
        elif kind == ms.IMPLICIT:
            full = tuple(-(-n // c) for n, c in zip(spec.shape, spec.chunk, strict=True))
            if filtered:
                raise InvalidState("an implicit index has no filters")
            many = int(np.prod(full, dtype=object))
            layout.address = self.reserve(many * raw)
            self.file.truncate(self.end)
            for at, e in entries.items():
                self.file.seek(e[0])
                data = self.file.read(raw)
                self.poke(layout.address + int(np.ravel_multi_index(at, full)) * raw, data)
        elif kind == ms.BTREE2:
            layout.params = (ix.BT2_NODE, ix.BT2_SPLIT, ix.BT2_MERGE)
            layout.address = ix.write_btree2(self.put, list(entries.items()), len(spec.shape), filtered, raw)
        else:
            fake = Dataset(path, 0, spec.type, spec.shape, most, layout, spec.filters)
            order = Container.array_axes(fake) if kind == ms.EXTENSIBLE else tuple(range(len(spec.shape)))
            full = tuple(-(-(spec.shape[i] if most[i] is None else most[i]) // spec.chunk[i]) for i in order)
            inner = full[1:]
            step = int(np.prod(inner, dtype=object)) if inner else 1
            by: dict[int, ix.Entry] = {}
            for at, e in entries.items():
                own = [at[i] for i in order]
                by[own[0] * step + (int(np.ravel_multi_index(own[1:], inner)) if inner else 0)] = e
            n = max(by, default=-1) + 1 if kind == ms.EXTENSIBLE else int(np.prod(full, dtype=object))
            flat = [by.get(k, ix.NONE) for k in range(n)]
            layout.params = ix.EA_PARAMS if kind == ms.EXTENSIBLE else (ix.FA_PAGE_BITS,)
            write = ix.write_extensible if kind == ms.EXTENSIBLE else ix.write_fixed
            layout.address = write(self.put, self.reserve, self.poke, flat, filtered, raw) if n else None
            if kind == ms.EXTENSIBLE and layout.address is None:
                layout.address = ix.write_extensible(self.put, self.reserve, self.poke, [], filtered, raw)
        self._header(replace(spec, path=path), layout, False)

    def _header(self, spec: Spec, layout: ms.Layout, early: bool) -> None:
        out = [(ms.DATASPACE, ms.encode_space(spec.shape, spec.max_shape)), (ms.DATATYPE, dt.encode(spec.type)), (ms.FILL, ms.encode_fill(early, spec.fill))]
        if spec.filters and layout.kind == "chunked":
            out.append((ms.FILTERS, ms.encode_filters(spec.filters)))
        out.append((ms.LAYOUT, ms.encode_layout(layout, spec.type.size)))
        out += [(ms.ATTRIBUTE, ms.encode_attribute(a)) for a in {a.name: a for a in spec.attributes}.values()]
        self.objects[spec.path] = self.put(ms.encode_header(out))

    def spec_of(self, path: str) -> tuple[Spec, Dataset]:
        """How an existing dataset is written anew."""
        if self.old is None:
            raise NotFound(path)
        d = self.old.dataset(path)
        return Spec(d.path, d.type, d.shape, d.max_shape, d.chunk, d.filters, {ms.SINGLE: "single", ms.IMPLICIT: "implicit", ms.FIXED: "fixed", ms.EXTENSIBLE: "extensible", ms.BTREE2: "btree2"}.get(d.layout.index, ""), list(d.attributes), d.fill), d

    # --- end

    def finish(self, flags: int = 0) -> None:
        """Groups from the deepest up, then the superblock."""
        children: dict[str, list[tuple[str, int | str]]] = {g: [] for g in self.groups}
        for path, address in self.objects.items():
            parent, _, name = path.rpartition("/")
            children[parent].append((name, address))
        for path, target in self.links.items():
            parent, _, name = path.rpartition("/")
            children.setdefault(parent, []).append((name, target))
        root = 0
        for path in sorted(self.groups, key=lambda p: (-p.count("/") - bool(p), p)):
            info = Bytes().uint(0, 1).uint(0, 1).address(None).address(None)
            out = [(ms.LINK_INFO, bytes(info)), (ms.GROUP_INFO, bytes(2))]
            out += [(ms.LINK, ms.encode_link(n, a)) for n, a in sorted(children[path], key=lambda x: x[0])]
            out += [(ms.ATTRIBUTE, ms.encode_attribute(a)) for a in self.groups[path]]
            root = self.put(ms.encode_header(out))
            if path:
                parent, _, name = path.rpartition("/")
                children[parent].append((name, root))
        self.file.truncate(self.end)
        self.file.flush()
        os.fsync(self.file.fileno())
        self.poke(0, superblock(self.end, root, flags))
        self.file.flush()
        os.fsync(self.file.fileno())
        self.file.close()

    def abandon(self) -> None:
        self.file.close()


def superblock(end: int, root: int, flags: int = 0) -> bytes:
    head = Bytes(SIGNATURE)
    head.uint(3, 1).uint(8, 1).uint(8, 1).uint(flags, 1).address(0).address(None).address(end).address(root)
    return head.sealed()
