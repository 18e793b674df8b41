"""Handles for direct use without Spark: files, groups, datasets, attributes, streams, as numpy arrays.

A file is open for reading or for writing, never both. What is written becomes visible at
``close`` (or leaving a ``with``) or ``flush``.
"""

from __future__ import annotations

import itertools
import os
from collections.abc import Iterable, Sequence
from concurrent.futures import ThreadPoolExecutor

import numpy as np

from cubeframe.codec import builder as bd
from cubeframe.codec import datatype as dt
from cubeframe.codec import index as ix
from cubeframe.codec import messages as ms
from cubeframe.codec.container import STREAMING, WRITING, Container, Dataset, local, open_container
from cubeframe.errors import InvalidState, NotFound, OutOfBounds, TypeMismatch
from cubeframe.filters import Pipeline, pipeline


def _attribute(name: str, value: str | int | float, kind: str | None = None) -> ms.Attribute:
    return ms.string_attribute(name, value) if isinstance(value, str) else ms.number_attribute(name, value, dt.named(kind) if kind else None)


def _value(c: Container, a: ms.Attribute) -> str | int | float | bytes:
    if a.type.kind in ("string", "vstring"):
        return dt.to_arrow(np.frombuffer(a.raw[: a.type.size], dt.np_dtype(a.type)), a.type, c.strings).to_pylist()[0]
    if a.type.kind in ("int", "uint", "float"):
        return np.frombuffer(a.raw[: a.type.size], dt.np_dtype(a.type))[0].item()
    return a.raw


class ArrayFile:
    """``create`` truncates, ``open`` reads, ``open_rw`` appends to what is there."""

    def __init__(self, path: str, container: Container | None, builder: bd.Builder | None):
        self.path, self._c, self._b = path, container, builder
        self._open: dict[str, ArrayDataset] = {}

    @classmethod
    def create(cls, path: str) -> ArrayFile:
        return cls(path, None, bd.Builder(path))

    @classmethod
    def open(cls, path: str) -> ArrayFile:
        return cls(path, open_container(path), None)

    @classmethod
    def open_rw(cls, path: str) -> ArrayFile:
        if not os.path.exists(local(path)):
            raise NotFound(path)
        return cls(path, None, bd.Builder(path, append=True))

    def __enter__(self) -> ArrayFile:
        return self

    def __exit__(self, kind: object, *_: object) -> None:
        if kind is None:
            self.close()
        elif self._b:
            self._b.abandon()

    @property
    def is_writable(self) -> bool:
        return self._b is not None

    def _writer(self) -> bd.Builder:
        if self._b is None:
            raise InvalidState(f"{self.path} is not open for writing")
        return self._b

    def _reader(self) -> Container:
        if self._c is None:
            raise InvalidState(f"{self.path} is not open for reading")
        return self._c

    def root_group(self) -> ArrayGroup:
        return ArrayGroup(self, "")

    def create_group(self, path: str) -> ArrayGroup:
        return self.root_group().create_group(path)

    def group(self, path: str) -> ArrayGroup:
        return self.root_group().group(path)

    def new_dataset(self, kind: str | dt.DType) -> DatasetBuilder:
        return DatasetBuilder(self, "", kind)

    def dataset(self, path: str) -> ArrayDataset:
        path = path.strip("/")
        if path in self._open:
            return self._open[path]
        if self._c is not None:
            return ArrayDataset(self, None, self._c.dataset(path))
        spec, d = self._writer().spec_of(path)
        made = ArrayDataset(self, spec, d)
        made.entries = self._b.old.chunk_entries(d) if d.layout.kind == "chunked" else {}
        made.address = d.layout.address
        self._open[path] = made
        return made

    def dataset_names(self) -> list[str]:
        return sorted(self._c.datasets) if self._c else sorted({*self._writer().objects, *self._open})

    def set_attr(self, name: str, value: str | int | float, kind: str | None = None) -> None:
        self._writer().group("", [_attribute(name, value, kind)])

    def attr_names(self) -> list[str]:
        return [a.name for a in self._reader().group_attributes[""]]

    def attr(self, name: str) -> str | int | float | bytes:
        return self.root_group().attr(name)

    def write_strings(self, path: str, texts: Sequence[str]) -> None:
        b = self._writer()
        body, refs = bd.heap_collections([t.encode() for t in texts])
        refs["at"] += b.put(body) if texts else 0
        b.contiguous(bd.Spec(path, dt.VSTRING, (len(texts),)), b.put(refs.tobytes()) if texts else None)

    def flush(self, flags: int = 0) -> None:
        """Make what is written so far visible, and go on."""
        b = self._writer()
        keep = {p: d for p, d in self._open.items()}
        self._store()
        b.finish(flags)
        self._b = bd.Builder(self.path, append=True)
        self._open = keep

    def _store(self) -> None:
        for path, d in self._open.items():
            if d.dirty:
                spec, replace = d.spec, path in self._b.objects
                if spec.chunk:
                    self._b.chunked(spec, d.entries, replace_=replace)
                else:
                    self._b.contiguous(spec, d.address, replace_=replace)
                d.dirty = False

    def close(self) -> None:
        if self._b is not None:
            self._store()
            self._b.finish()
        if self._c is not None:
            self._c.file.close()
        self._b = self._c = None


class ArrayGroup:
    def __init__(self, file: ArrayFile, path: str):
        self.file, self.path = file, path

    @property
    def name(self) -> str:
        return f"/{self.path}"

    def _join(self, name: str) -> str:
        return f"{self.path}/{name.strip('/')}" if self.path else name.strip("/")

    def create_group(self, name: str) -> ArrayGroup:
        path = self._join(name)
        b = self.file._writer()
        if path in b.groups:
            raise InvalidState(f"{path} exists")
        if path.rpartition("/")[0] not in b.groups:
            raise NotFound(path.rpartition("/")[0])
        b.group(path)
        return ArrayGroup(self.file, path)

    def group(self, name: str) -> ArrayGroup:
        path = self._join(name)
        if path not in (self.file._c.groups if self.file._c else self.file._writer().groups):
            raise NotFound(path)
        return ArrayGroup(self.file, path)

    def new_dataset(self, kind: str | dt.DType) -> DatasetBuilder:
        return DatasetBuilder(self.file, self.path, kind)

    def write_strings(self, name: str, texts: Sequence[str]) -> None:
        self.file.write_strings(self._join(name), texts)

    def _children(self, paths: Iterable[str]) -> list[str]:
        prefix = f"{self.path}/" if self.path else ""
        return sorted(p[len(prefix) :] for p in paths if p and p.startswith(prefix) and "/" not in p[len(prefix) :])

    def dataset_names(self) -> list[str]:
        return self._children(self.file.dataset_names())

    def group_names(self) -> list[str]:
        return self._children(self.file._c.groups if self.file._c else self.file._writer().groups)

    def set_attr(self, name: str, value: str | int | float, kind: str | None = None) -> None:
        self.file._writer().group(self.path, [_attribute(name, value, kind)])

    def attr(self, name: str) -> str | int | float | bytes:
        c = self.file._reader()
        for a in c.group_attributes[self.path]:
            if a.name == name:
                return _value(c, a)
        raise NotFound(f"attribute {name} of {self.name}")


class DatasetBuilder:
    """Shape, chunks and filters by chained calls, then ``create``."""

    def __init__(self, file: ArrayFile, group: str, kind: str | dt.DType):
        self.file, self.prefix = file, group
        self.kind = dt.named(kind) if isinstance(kind, str) else kind
        self._shape: tuple[int, ...] | None = None
        self._chunk: tuple[int, ...] = ()
        self._most: tuple[int | None, ...] | None = None
        self._filters: str | Pipeline = ""
        self._index = ""

    def shape(self, dims: Sequence[int]) -> DatasetBuilder:
        self._shape = tuple(dims)
        return self

    def scalar(self) -> DatasetBuilder:
        return self.shape(())

    def chunk(self, dims: Sequence[int]) -> DatasetBuilder:
        self._chunk = tuple(dims)
        return self

    def resizable(self) -> DatasetBuilder:
        return self.max_shape([None] * len(self._shape or ()))

    def max_shape(self, dims: Sequence[int | None]) -> DatasetBuilder:
        self._most = tuple(dims)
        return self

    def filters(self, text: str | Pipeline) -> DatasetBuilder:
        self._filters = text
        return self

    def deflate(self, level: int = 6) -> DatasetBuilder:
        return self.filters(f"deflate:{level}")

    def shuffle_deflate(self, level: int = 6) -> DatasetBuilder:
        return self.filters(f"shuffle,deflate:{level}")

    def zstd(self, level: int = 3) -> DatasetBuilder:
        return self.filters(f"zstd:{level}")

    def index(self, name: str) -> DatasetBuilder:
        self._index = name
        return self

    def create(self, name: str) -> ArrayDataset:
        b = self.file._writer()
        if self._shape is None:
            raise InvalidState("a dataset needs a shape")
        path = f"{self.prefix}/{name.strip('/')}" if self.prefix else name.strip("/")
        if path in b.objects or path in b.groups or path in self.file._open:
            raise InvalidState(f"{path} exists")
        if self._filters and not self._chunk:
            raise InvalidState("filters need chunks")
        if self._chunk and len(self._chunk) != len(self._shape):
            raise InvalidState("chunks of another rank than the shape")
        size = int(np.prod(self._chunk, dtype=object)) * self.kind.size if self._chunk else 0
        pipe = pipeline(self._filters, self.kind.size, size) if isinstance(self._filters, str) else self._filters
        spec = bd.Spec(path, self.kind, self._shape, self._most, self._chunk, pipe, self._index)
        if self._chunk:
            spec.index_kind()
        made = ArrayDataset(self.file, spec, None)
        if not self._chunk and (n := (int(np.prod(self._shape, dtype=object)) if self._shape else 1) * self.kind.size):
            made.address = b.reserve(n)
            b.file.truncate(b.end)
        made.dirty = True
        self.file._open[path] = made
        return made


class ArrayDataset:
    def __init__(self, file: ArrayFile, spec: bd.Spec | None, old: Dataset | None):
        self.file, self.spec, self.old = file, spec, old
        self.entries: dict[tuple[int, ...], ix.Entry] = {}
        self.address: int | None = None
        self.dirty = False

    @property
    def _now(self) -> bd.Spec | Dataset:
        return self.spec or self.old

    @property
    def name(self) -> str:
        return self._now.path

    @property
    def shape(self) -> tuple[int, ...]:
        return tuple(self._now.shape)

    @property
    def ndims(self) -> int:
        return len(self.shape)

    @property
    def total_elements(self) -> int:
        return int(np.prod(self.shape, dtype=object)) if self.shape else 1

    @property
    def dtype(self) -> np.dtype:
        return dt.np_dtype(self._now.type)

    @property
    def element_size(self) -> int:
        return self._now.type.size

    @property
    def chunk_dims(self) -> tuple[int, ...] | None:
        return tuple(self._now.chunk) or None if not isinstance(self._now, Dataset) or self._now.layout.kind == "chunked" else None

    @property
    def is_chunked(self) -> bool:
        return self.chunk_dims is not None

    # --- reading

    def read_raw(self, reinterpret: str | None = None) -> np.ndarray:
        return self.read_slice((0,) * self.ndims, self.shape, reinterpret)

    def read_slice(self, starts: Sequence[int], counts: Sequence[int], reinterpret: str | None = None) -> np.ndarray:
        """A box; ``reinterpret`` names another type of the same size for the same bytes."""
        x = self.file._reader().box(self.old, tuple(starts), tuple(counts))
        if reinterpret is None:
            return x
        kind = dt.np_dtype(dt.named(reinterpret))
        if kind.itemsize != self.element_size:
            raise TypeMismatch(f"{kind} for elements of {self.element_size} bytes")
        return np.ascontiguousarray(x).view(kind)

    def memmap(self) -> np.ndarray:
        """A contiguous dataset as a read-only view of the file, without copying."""
        c, d = self.file._reader(), self.old
        if d.layout.kind != "contiguous" or d.layout.address is None or dt.np_dtype(d.type).shape:
            raise InvalidState(f"{self.name} can't be mapped")
        return np.memmap(local(c.file.path), self.dtype, "r", c.base + d.layout.address, self.shape)

    def read_strings(self) -> list[str]:
        c = self.file._reader()
        return dt.to_arrow(self.read_raw().reshape(-1), self.old.type, c.strings).to_pylist()

    def attr_names(self) -> list[str]:
        self.file._reader()
        return [a.name for a in self.old.attributes]

    def attr(self, name: str) -> str | int | float | bytes:
        c = self.file._reader()
        for a in self.old.attributes:
            if a.name == name:
                return _value(c, a)
        raise NotFound(f"attribute {name} of {self.name}")

    # --- writing

    def _values(self, values: np.ndarray, shape: Sequence[int]) -> np.ndarray:
        self.file._writer()
        x = np.asarray(values)
        kind = self.dtype
        if x.dtype != kind:
            if x.dtype.kind not in "iufb" or kind.kind not in "iuf":
                raise TypeMismatch(f"{x.dtype} for {kind}")
            made = x.astype(kind)
            if kind.kind in "iu" and not np.array_equal(made, x):
                raise TypeMismatch(f"a value does not fit {kind}")
            x = made
        if x.size != (int(np.prod(shape, dtype=object)) if len(shape) else 1):
            raise InvalidState(f"{x.size} values for {tuple(shape)}")
        return np.ascontiguousarray(x).reshape(tuple(shape))

    def write_raw(self, values: np.ndarray) -> None:
        x = self._values(values, self.shape)
        if not self.spec.chunk:
            if x.size:
                self.file._b.poke(self.address, x.tobytes())
            return
        for at in itertools.product(*[range(-(-n // c)) for n, c in zip(self.shape, self.spec.chunk, strict=True)]):
            self._put(at, x[tuple(slice(a * c, (a + 1) * c) for a, c in zip(at, self.spec.chunk, strict=True))])

    def _blank(self) -> np.ndarray:
        """A chunk of cells that aren't written."""
        cells = int(np.prod(self.spec.chunk, dtype=object))
        raw = bytearray(self.spec.fill * cells if self.spec.fill else cells * self.element_size)
        return np.frombuffer(raw, self.dtype).reshape(self.spec.chunk)

    def _put(self, at: tuple[int, ...], part: np.ndarray) -> None:
        cell = self._blank()
        cell[tuple(slice(0, n) for n in part.shape)] = part
        self._store(at, self.spec.filters.encode(cell.tobytes()))

    def _store(self, at: tuple[int, ...], raw: bytes) -> None:
        self.entries[at] = (self.file._b.put(raw), len(raw), 0)
        self.dirty = True

    def _place(self, at: int | Sequence[int]) -> tuple[int, ...]:
        if not self.is_chunked:
            raise InvalidState(f"{self.name} is not chunked")
        most = self.spec.max_shape or self.shape
        if isinstance(at, int | np.integer):
            order = [next((i for i, n in enumerate(most) if n is None), 0)]
            order += [i for i in range(self.ndims) if i not in order]
            inner = [-(-self.shape[i] // self.spec.chunk[i]) for i in order[1:]]
            first, rest = divmod(int(at), int(np.prod(inner, dtype=object)) if inner else 1)
            own = (first, *map(int, np.unravel_index(rest, inner))) if inner else (first,)
            made = [0] * self.ndims
            for i, v in zip(order, own, strict=True):
                made[i] = v
            at = made
        for a, c, n in zip(at, self.spec.chunk, most, strict=True):
            if a < 0 or n is not None and a * c >= n:
                raise OutOfBounds(f"chunk {tuple(at)} of {self.name}")
        return tuple(at)

    def write_chunk(self, at: int | Sequence[int], values: np.ndarray | bytes) -> None:
        """By linear number or coordinates; writing it again replaces it."""
        self.write_chunks([(at, values)])

    def write_chunks(self, chunks: Iterable[tuple[int | Sequence[int], np.ndarray | bytes]]) -> None:
        """Many at once: encoded in threads, stored in order."""
        self.file._writer()
        todo = []
        for at, values in chunks:
            raw = values if isinstance(values, bytes | bytearray | memoryview) else self._values(values, self.spec.chunk).tobytes()
            if len(raw) != int(np.prod(self.spec.chunk, dtype=object)) * self.element_size:
                raise InvalidState(f"{len(raw)} bytes for a chunk {self.spec.chunk}")
            todo.append((self._place(at), bytes(raw)))
        with ThreadPoolExecutor() as pool:
            for (at, _), packed in zip(todo, pool.map(lambda x: self.spec.filters.encode(x[1]), todo), strict=True):
                self._store(at, packed)

    def write_encoded_chunk(self, at: int | Sequence[int], raw: bytes) -> None:
        """Bytes that went through the filters already."""
        self.file._writer()
        self._store(self._place(at), raw)

    def write_slice(self, starts: Sequence[int], counts: Sequence[int], values: np.ndarray) -> None:
        """Overwrite a box, checked against the shape; chunks it touches are written anew."""
        if len(starts) != self.ndims or len(counts) != self.ndims or any(s < 0 or n < 0 or s + n > m for s, n, m in zip(starts, counts, self.shape, strict=True)):
            raise OutOfBounds(f"{tuple(starts)} + {tuple(counts)} beyond {self.shape}")
        x = self._values(values, counts)
        if not x.size:
            return
        if not self.spec.chunk:
            row = int(counts[-1]) if self.ndims else 1
            steps = [int(np.prod(self.shape[i + 1 :], dtype=object)) for i in range(self.ndims)]
            flat = x.reshape(-1, row)
            for k, lead in enumerate(itertools.product(*map(range, counts[:-1]))):
                at = sum((s + i) * step for s, i, step in zip(starts, (*lead, 0), steps, strict=True)) if self.ndims else 0
                self.file._b.poke(self.address + at * self.element_size, flat[k].tobytes())
            return
        ranges = [range(s // c, -(-(s + n) // c)) for s, n, c in zip(starts, counts, self.spec.chunk, strict=True)]
        for at in itertools.product(*ranges):
            cell = self._chunk(at)
            low = [max(s, a * c) for s, a, c in zip(starts, at, self.spec.chunk, strict=True)]
            high = [min(s + n, (a + 1) * c) for s, n, a, c in zip(starts, counts, at, self.spec.chunk, strict=True)]
            own = tuple(slice(p - a * c, q - a * c) for p, q, a, c in zip(low, high, at, self.spec.chunk, strict=True))
            cell[own] = x[tuple(slice(p - s, q - s) for p, q, s in zip(low, high, starts, strict=True))]
            self._store(at, self.spec.filters.encode(cell.tobytes()))

    def _chunk(self, at: tuple[int, ...]) -> np.ndarray:
        size = int(np.prod(self.spec.chunk, dtype=object)) * self.element_size
        if at not in self.entries:
            return self._blank()
        where, n, mask = self.entries[at]
        self.file._b.file.seek(where)
        return np.frombuffer(self.spec.filters.decode(self.file._b.file.read(n), size, mask), self.dtype).reshape(self.spec.chunk).copy()

    def extend(self, shape: Sequence[int]) -> None:
        """New extents, larger or smaller, within the largest shape; cells that come are zero."""
        self.file._writer()
        if not self.is_chunked:
            raise InvalidState(f"{self.name} is not chunked")
        if any(m is not None and n > m for n, m in zip(shape, self.spec.max_shape or self.shape, strict=True)):
            raise OutOfBounds(f"{tuple(shape)} beyond {self.spec.max_shape or self.shape}")
        grid = [-(-n // c) for n, c in zip(shape, self.spec.chunk, strict=True)]
        old = self.spec.shape
        self.spec.shape = tuple(shape)
        self.entries = {at: e for at, e in self.entries.items() if all(a < g for a, g in zip(at, grid, strict=True))}
        if any(n < o for n, o in zip(shape, old, strict=True)):
            for at in list(self.entries):  # what lies beyond the new edge must not come back
                inside = tuple(slice(0, n - a * c) for n, a, c in zip(shape, at, self.spec.chunk, strict=True))
                kept = self._blank()
                kept[inside] = self._chunk(at)[inside]
                self._store(at, self.spec.filters.encode(kept.tobytes()))
        self.dirty = True

    def set_attr(self, name: str, value: str | int | float, kind: str | None = None) -> None:
        self.file._writer()
        self.spec.attributes = [a for a in self.spec.attributes if a.name != name] + [_attribute(name, value, kind)]
        self.dirty = True

    def flush(self) -> None:
        self.file.flush()


class StreamWriter:
    """Frames appended one by one; ``flush`` makes them visible to readers at once and in order."""

    def __init__(self, path: str):
        self.file = ArrayFile.create(path)

    def create_streaming_dataset(self, name: str, kind: str, frame: Sequence[int], filters: str = "") -> ArrayDataset:
        return self.file.new_dataset(kind).shape((0, *frame)).max_shape((None, *frame)).chunk((1, *frame)).filters(filters).create(name)

    def append_frame(self, name: str, values: np.ndarray | bytes) -> None:
        d = self.file.dataset(name)
        n = d.shape[0]
        d.spec.shape = (n + 1, *d.shape[1:])
        try:
            d.write_chunk((n, *(0,) * (d.ndims - 1)), values)
        except BaseException:
            d.spec.shape = (n, *d.shape[1:])
            raise

    def flush(self) -> None:
        """The superblock says that a writer is at work until ``close``; readers need not care."""
        self.file.flush(WRITING | STREAMING)

    def close(self) -> None:
        self.file.close()


class StreamReader:
    """What a writer has flushed; ``refresh`` looks again."""

    def __init__(self, path: str):
        self.path = path
        self.refresh()

    def refresh(self) -> None:
        self.file = ArrayFile.open(self.path)

    def dataset_names(self) -> list[str]:
        return self.file.dataset_names()

    def dataset_shape(self, name: str) -> tuple[int, ...]:
        return self.file.dataset(name).shape

    def read_dataset(self, name: str, first: int = 0) -> np.ndarray:
        """Frames from ``first`` on."""
        d = self.file.dataset(name)
        return d.read_slice((first, *(0,) * (d.ndims - 1)), (d.shape[0] - first, *d.shape[1:]))
