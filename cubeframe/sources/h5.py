"""The ``h5`` data source: batch reading with chunk pruning, two-phase writing, streams.

Read options: ``path``, ``dataset``, ``form`` (long, frame or chunk), ``u64`` (decimal or long),
``enums`` (name or code), ``flatten``, ``fields`` (compound members, by commas), ``paired``,
``target_bytes`` (of a partition), ``box`` (``low:high`` of each axis, by commas: only chunks that
touch it are planned and only its cells returned), ``pushdown`` (true: comparisons of d* with
constants make the box; Spark keeps what was pushed with the loaded relation, so a DataFrame read
so must not be scanned twice with different filters in one query).

Write options: ``path``, ``dataset``, ``shape``, ``chunk``, ``max_shape`` (``*`` is unlimited),
``filters``, ``index``, ``dtype``, ``null_value``, ``attr.<name>`` (a string) and
``num.<name>`` (a number), ``extend`` (append cells to a dataset that exists). Mode overwrite
makes a new container, append adds to one.
"""

from __future__ import annotations

import itertools
import json
import os
import shutil
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, DataSourceStreamArrowWriter, DataSourceStreamReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, In, InputPartition, LessThan, LessThanOrEqual, WriterCommitMessage

from cubeframe.codec import builder as bd
from cubeframe.codec import datatype as dt
from cubeframe.codec import messages as ms
from cubeframe.codec.container import Container, Dataset, local, open_container
from cubeframe.errors import ArrayError, InvalidState, NotFound, TypeMismatch
from cubeframe.filters import Pipeline, pipeline
from cubeframe.sources.layout import Rows, cells_of, schema_of

TARGET_BYTES = 16 << 20


def numbers(text: str | None) -> tuple[int, ...]:
    return tuple(int(x) for x in text.split(",") if x.strip()) if text else ()


def limits(text: str | None, rank: int) -> tuple[int | None, ...] | None:
    return tuple(None if x.strip() in ("*", "-1") else int(x) for x in text.split(",")) if text else None


class H5DataSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "h5"

    def _open(self) -> tuple[Container, Dataset]:
        if "path" not in self.options or "dataset" not in self.options:
            raise NotFound("the options path and dataset are needed")
        c = open_container(self.options["path"], self.options.get("paired", "false") == "true")
        return c, c.dataset(self.options["dataset"])

    def _how(self) -> dict:
        o = self.options
        return {"form": o.get("form", "long"), "u64": o.get("u64", "decimal"), "enums": o.get("enums", "name")}

    def schema(self) -> T.StructType:
        c, d = self._open()
        c.file.close()
        return schema_of(d, **self._how(), flatten=self.options.get("flatten", "false") == "true", fields=tuple(filter(None, self.options.get("fields", "").split(","))))

    def reader(self, schema: T.StructType) -> BoxReader:
        return BoxReader(self.options, schema, self._how())

    def streamReader(self, schema: T.StructType) -> FrameStream:  # noqa: N802
        return FrameStream(self.options, schema, self._how())

    def writer(self, schema: T.StructType, overwrite: bool) -> ArrayWriter:
        return ArrayWriter(self.options, schema, overwrite)

    def streamWriter(self, schema: T.StructType, overwrite: bool) -> FrameSink:  # noqa: N802
        return FrameSink(self.options, schema)


# --- reading ---------------------------------------------------------------------------------


@dataclass
class Piece(InputPartition):
    """Chunks (with where they are stored) or rows that one task reads, cut to a box."""

    chunks: list[tuple[tuple[int, ...], tuple[int, int, int] | None]]
    rows: tuple[int, int] | None
    low: tuple[int, ...]
    high: tuple[int, ...]


class BoxReader(DataSourceReader):
    """Comparisons of d* with constants become a box; only chunks that touch it are planned."""

    def __init__(self, options: dict, schema: T.StructType, how: dict):
        self.options, self.schema, self.how = dict(options), schema, how
        self.bounds: dict[str, list[int | None]] = {}
        for i, span in enumerate(filter(None, self.options.get("box", "").split(","))):
            self.bounds[f"d{i}"] = [int(x) if x.strip() else None for x in span.split(":")]

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:  # noqa: N802
        for f in filters:
            name = f.attribute[0] if hasattr(f, "attribute") and len(f.attribute) == 1 else ""
            if self.options.get("pushdown", "false") == "true" and name[:1] == "d" and name[1:].isdigit():
                low, high = self.bounds.setdefault(name, [None, None])
                if isinstance(f, In):
                    values = [v for v in f.value if v is not None]
                    span = (min(values), max(values) + 1) if values else (0, 0)
                elif isinstance(f, EqualTo):
                    span = (f.value, f.value + 1)
                elif isinstance(f, GreaterThan | GreaterThanOrEqual):
                    span = (f.value + isinstance(f, GreaterThan), None)
                elif isinstance(f, LessThan | LessThanOrEqual):
                    span = (None, f.value + isinstance(f, LessThanOrEqual))
                else:
                    span = (None, None)
                a, b = span
                self.bounds[name] = [a if low is None else low if a is None else max(low, a), b if high is None else high if b is None else min(high, b)]
            yield f  # Spark filters the rows of the box itself

    def _open(self) -> tuple[Container, Dataset]:
        c = open_container(self.options["path"], self.options.get("paired", "false") == "true")
        return c, c.dataset(self.options["dataset"])

    def partitions(self) -> list[Piece]:
        c, d = self._open()
        low, high = [], []
        for i, n in enumerate(d.shape):
            a, b = self.bounds.get(f"d{i}", (None, None))
            low.append(min(n, max(0, int(a or 0))))
            high.append(n if b is None else max(low[-1], min(n, int(b))))
        return plan(c, d, tuple(low), tuple(high), int(self.options.get("target_bytes", TARGET_BYTES)), self.how["form"] == "frame")

    def read(self, piece: Piece) -> Iterator[pa.RecordBatch]:
        c, d = self._open()
        yield from read_piece(c, d, piece, Rows(c, d, self.schema, **self.how))


def plan(c: Container, d: Dataset, low: tuple[int, ...], high: tuple[int, ...], target: int, frames: bool = False) -> list[Piece]:
    """Partitions of about ``target`` bytes over a box; ``frames`` keeps all chunks of a row together. Spark wants one at least.
    Strings are elsewhere in the file, so rows and chunks that refer to some count as their share of it."""
    if any(b <= a for a, b in zip(low, high, strict=True)):
        return [Piece([], None, low, high)]
    whole = (c.eof or 0) if dt.string_offsets(d.type) else 0
    if d.layout.kind != "chunked":
        if d.rank == 0:
            return [Piece([], (0, 1), low, high)]
        row = max(1, int(np.prod(d.shape[1:], dtype=object)) * d.type.size, whole // d.shape[0])
        step = max(1, target // row)
        return [Piece([], (at, min(step, high[0] - at)), low, high) for at in range(low[0], high[0], step)]
    entries = c.chunk_entries(d)
    grid = [range(a // k, -(-b // k)) for a, b, k in zip(low, high, d.chunk, strict=True)]
    per = max(1, target // max(1, d.chunk_bytes, whole // max(1, len(entries))))
    out, held = [], []
    for at in itertools.product(*grid):
        if len(held) >= per and (not frames or at[0] != held[-1][0][0]):
            out.append(Piece(held, None, low, high))
            held = []
        held.append((at, entries.get(at)))
    return out + ([Piece(held, None, low, high)] if held else [])


def read_piece(c: Container, d: Dataset, piece: Piece, rows: Rows) -> Iterator[pa.RecordBatch]:
    low, high = piece.low, piece.high
    if piece.rows:
        start, n = piece.rows
        x = c.read_rows(d, start, n)
        x = x[(slice(None), *(slice(a, b) for a, b in zip(low[1:], high[1:], strict=True)))] if d.rank else x
        yield from rows.emit(np.ascontiguousarray(x), (start, *low[1:]) if d.rank else (), (start,) if d.rank else ())
        return
    whole = rows.form == "chunk"
    gathered: dict[int, list[tuple[tuple[int, ...], np.ndarray]]] = {}
    for at, entry in piece.chunks:
        offset = tuple(a * k for a, k in zip(at, d.chunk, strict=True))
        first = offset if whole else tuple(max(o, a) for o, a in zip(offset, low, strict=True))
        last = tuple(min(o + k, n if whole else b) for o, k, n, b in zip(offset, d.chunk, d.shape, high, strict=True))
        x = c.decode_chunk(d, entry)[tuple(slice(a - o, b - o) for a, b, o in zip(first, last, offset, strict=True))]
        if rows.form == "frame" and d.rank > 1:
            gathered.setdefault(at[0], []).append((first, x))
        else:
            yield from rows.emit(np.ascontiguousarray(x), first, at)
    for parts in gathered.values():
        yield from _frames(d, piece, parts, rows)


def _frames(d: Dataset, piece: Piece, parts: list[tuple[tuple[int, ...], np.ndarray]], rows: Rows) -> Iterator[pa.RecordBatch]:
    """Frames of one row of chunks."""
    first = parts[0][0][0]
    n = parts[0][1].shape[0]
    out = np.zeros((n, *d.shape[1:]) + parts[0][1].shape[d.rank :], parts[0][1].dtype)
    for offset, x in parts:
        out[(slice(None), *(slice(o, o + k) for o, k in zip(offset[1:], x.shape[1 : d.rank], strict=True)))] = x
    yield from rows.emit(out, (first, *(0,) * (d.rank - 1)))


# --- writing -------------------------------------------------------------------------------------


@dataclass
class Written(WriterCommitMessage):
    """What a task wrote: stored pieces of chunks, the part file, and the largest coordinates seen."""

    part: str
    pieces: list[tuple[tuple[int, ...], int, int, bytes]]  # chunk, place, bytes, cells present (empty: all)
    most: tuple[int, ...]
    heap: int = 0  # bytes of its strings, in a file of their own


@dataclass
class Target:
    """A dataset to be written, as far as options and schema tell."""

    path: str
    dataset: str
    type: dt.DType
    rank: int
    chunk: tuple[int, ...]
    chunked: bool
    shape: tuple[int, ...] | None
    max_shape: tuple[int | None, ...] | None
    filters: Pipeline
    index: str
    attributes: list[ms.Attribute]
    form: str
    null_value: str | None
    extend: bool


def target_of(options: dict, schema: T.StructType) -> Target:
    o = {k.lower(): v for k, v in dict(options).items()}
    if "path" not in o or "dataset" not in o:
        raise NotFound("the options path and dataset are needed")
    names = [f.name for f in schema.fields]
    axes = [n for n in names if n[:1] == "d" and n[1:].isdigit()]
    form = "chunk" if "chunk_coord" in names else "long"
    if form == "chunk":
        kind = schema["data"].dataType.elementType
        rank = len(numbers(o.get("chunk")))
        if not rank:
            raise InvalidState("rows of chunks need the option chunk")
    else:
        rest = [f for f in schema.fields if f.name not in axes]
        kind = rest[0].dataType if [f.name for f in rest] == ["value"] else T.StructType(rest)
        rank = len(axes)
        named = o.get("dtype")
        while isinstance(kind, T.ArrayType):
            kind, rank = kind.elementType, rank + 1
        if sorted(axes) != sorted(f"d{i}" for i in range(len(axes))):
            raise InvalidState(f"axes {axes} are not d0, d1, ...")
    named = o.get("dtype")
    element = dt.named(named) if named else dt.of_spark(kind)
    shape = numbers(o["shape"]) if "shape" in o else (() if rank == 0 else None)
    if shape is not None and len(shape) != rank:
        raise InvalidState(f"a shape of rank {len(shape)} for rows of rank {rank}")
    chunk = numbers(o.get("chunk"))
    chunked = bool(chunk)
    if not chunked:
        if o.get("filters"):
            raise InvalidState("filters need the option chunk")
        if o.get("max_shape"):
            raise InvalidState("a largest shape needs the option chunk")
        if rank > 1 and shape is None:
            raise InvalidState("contiguous arrays of more than one axis need the option shape")
        inner = shape[1:] if shape else ()
        row = max(1, int(np.prod(inner, dtype=object)) * element.size)
        chunk = (max(1, (1 << (16 if dt.string_offsets(element) else 20)) // row), *(max(1, n) for n in inner)) if rank else ()
    if len(chunk) != rank:
        raise InvalidState(f"chunks of rank {len(chunk)} for rows of rank {rank}")
    attributes = [ms.string_attribute(k[5:], v) for k, v in o.items() if k.startswith("attr.")]
    attributes += [ms.number_attribute(k[4:], float(v) if any(c in v for c in ".einf") else int(v)) for k, v in o.items() if k.startswith("num.")]
    size = int(np.prod(chunk, dtype=object)) * element.size if chunk else element.size
    return Target(o["path"], o["dataset"].strip("/"), element, rank, chunk, chunked, shape, limits(o.get("max_shape"), rank), pipeline(o.get("filters", ""), element.size, size), o.get("index", ""), attributes, form, o.get("null_value"), o.get("extend", "false") == "true")


class Part:
    """One task's part file: chunks in the order of arrival, each written when the next begins.
    Strings go to a file beside it as they come, so a chunk and a heap collection are held."""

    def __init__(self, t: Target, folder: str):
        self.t = t
        os.makedirs(folder, exist_ok=True)
        self.path = f"{folder}/{uuid.uuid4().hex}"
        self.file = open(self.path, "wb")  # noqa: SIM115
        self.at = 0
        self.pieces: list[tuple[tuple[int, ...], int, int, bytes]] = []
        self.most = np.zeros(t.rank, np.int64)
        self.open: tuple[int, ...] | None = None
        self.cells = int(np.prod(t.chunk, dtype=object)) if t.chunk else 1
        self.kind = dt.np_dtype(t.type)
        self.texts = None
        self.heap = bd.Heap(self._text)
        self.data = self.seen = None

    def strings(self, texts: list[bytes]) -> bytes:
        """Provisional references, with addresses in this part's heap; its place is added when it is laid out."""
        return self.heap.add(texts).tobytes()

    def _text(self, collection: bytes) -> None:
        if self.texts is None:
            self.texts = open(f"{self.path}.heap", "wb")  # noqa: SIM115
        self.texts.write(collection)

    def _start(self, at: tuple[int, ...]) -> None:
        self.flush()
        self.open = at
        self.data = np.zeros((self.cells, self.t.type.size), np.uint8)
        self.seen = np.zeros(self.cells, bool)

    def add(self, batch: pa.RecordBatch) -> None:
        t = self.t
        if t.null_value is not None:
            batch = _filled(batch, t)
        if t.form == "chunk":
            return self._chunks(batch)
        coords, values = cells_of(batch, t.type, self.strings)
        if not len(values):
            return None
        raw = np.frombuffer(np.ascontiguousarray(values).tobytes(), np.uint8).reshape(len(values), t.type.size)
        if t.rank == 0:
            self._place((), np.zeros(len(raw), np.int64), raw)
            return None
        if (coords < 0).any() or (t.shape is not None and (coords >= np.array(t.shape)).any()):
            raise InvalidState("a coordinate outside of the shape")
        self.most = np.maximum(self.most, coords.max(axis=0) + 1)
        shape = np.array(t.chunk)
        number, local_ = coords // shape, coords % shape
        change = np.flatnonzero((number[1:] != number[:-1]).any(axis=1)) + 1
        steps = np.append(np.cumprod(shape[::-1])[::-1][1:], 1)
        flat = local_ @ steps
        for a, b in zip(np.append(0, change), np.append(change, len(number)), strict=True):
            self._place(tuple(map(int, number[a])), flat[a:b], raw[a:b])
        return None

    def _chunks(self, batch: pa.RecordBatch) -> None:
        t = self.t
        for row in range(batch.num_rows):
            one = batch.slice(row, 1)
            col = lambda n, one=one: one.column(one.schema.names.index(n))
            at = tuple(col("chunk_coord").to_pylist()[0])
            shape = tuple(col("chunk_shape").to_pylist()[0])
            values = dt.from_arrow(col("data").flatten(), t.type, self.strings)
            raw = np.frombuffer(np.ascontiguousarray(values).tobytes(), np.uint8).reshape(-1, t.type.size)
            where = np.ravel_multi_index(np.indices(shape).reshape(len(shape), -1), t.chunk)
            self.most = np.maximum(self.most, np.array(at) * np.array(t.chunk) + np.array(shape))
            self._place(at, where, raw)

    def _place(self, at: tuple[int, ...], where: np.ndarray, raw: np.ndarray) -> None:
        if self.open != at:
            self._start(at)
        if self.seen[where].any() or len(np.unique(where)) < len(where):
            raise InvalidState(f"a cell of chunk {at} is given twice")
        self.data[where] = raw
        self.seen[where] = True

    def flush(self) -> None:
        if self.open is None:
            return
        raw = self.data.tobytes()
        late = not self.t.chunked or bool(dt.string_offsets(self.t.type))
        packed = raw if late else self.t.filters.encode(raw)
        self.file.write(packed)
        self.pieces.append((self.open, self.at, len(packed), b"" if self.seen.all() else np.packbits(self.seen).tobytes()))
        self.at += len(packed)
        self.open = None

    def close(self) -> Written:
        self.flush()
        self.heap.close()
        for f in filter(None, (self.file, self.texts)):
            f.flush()
            os.fsync(f.fileno())
            f.close()
        return Written(self.path, self.pieces, tuple(int(x) for x in self.most), self.heap.start)


def _filled(batch: pa.RecordBatch, t: Target) -> pa.RecordBatch:
    cols = []
    for name, col in zip(batch.schema.names, batch.columns, strict=True):
        if col.null_count and not (name[:1] == "d" and name[1:].isdigit()):
            value = t.null_value if pa.types.is_string(col.type) else json.loads(t.null_value)
            col = col.fill_null(pa.scalar(value, col.type))
        cols.append(col)
    return pa.RecordBatch.from_arrays(cols, names=batch.schema.names)


def store(b: bd.Builder, t: Target, messages: list[Written], before: tuple[bd.Spec, Dataset] | None = None) -> None:
    """Lay out what the tasks wrote. Chunks that several tasks hold parts of, and those that existed
    before, are put together cell by cell; a cell given twice is an error."""
    pieces: dict[tuple[int, ...], list[tuple[Written, int, int, bytes]]] = {}
    for m in messages:
        for at, place, n, seen in m.pieces:
            pieces.setdefault(at, []).append((m, place, n, seen))
    most = np.max([m.most for m in messages], axis=0) if messages and t.rank else np.zeros(t.rank, np.int64)
    shape = tuple(int(x) for x in most) if t.shape is None else t.shape
    entries, filters, kind = {}, t.filters, t.type
    if before:
        spec, old = before
        shape = tuple(max(a, c) for a, c in zip(old.shape, shape, strict=True))
        if any(n is not None and s > n for s, n in zip(shape, old.max_shape, strict=True)):
            raise InvalidState(f"{shape} is beyond the largest shape {old.max_shape} of {old.path}")
        entries, filters = b.old.chunk_entries(old), spec.filters
    cells = int(np.prod(t.chunk, dtype=object)) if t.chunk else 1
    heaps = {m.part: _heap(b, m) for m in messages if m.heap}
    late = not t.chunked or bool(dt.string_offsets(kind))
    files = {m.part: open(m.part, "rb") for m in messages if m.pieces}  # noqa: SIM115
    try:
        base = row = 0
        if not t.chunked:
            row = (int(np.prod(shape[1:], dtype=object)) if shape else 1) * kind.size
            base = b.reserve(row * (shape[0] if shape else 1))
        for at, parts in sorted(pieces.items()):
            known = entries.get(at)
            if len(parts) == 1 and known is None and not late:
                m, place, n, _ = parts[0]
                files[m.part].seek(place)
                raw = files[m.part].read(n)
            else:
                data, seen = np.zeros((cells, kind.size), np.uint8), np.zeros(cells, bool)
                if before and before[1].fill:
                    data[:] = np.frombuffer(before[1].fill, np.uint8)
                if known is not None:
                    data = np.frombuffer(b.old.decode_chunk(before[1], known).tobytes(), np.uint8).reshape(cells, kind.size).copy()
                    seen |= _inside(at, t.chunk, before[1].shape)
                for m, place, n, bits in parts:
                    files[m.part].seek(place)
                    raw = files[m.part].read(n)
                    own = np.frombuffer(raw if late else t.filters.decode(raw, cells * kind.size), np.uint8).reshape(cells, kind.size).copy()
                    if m.part in heaps:
                        _resolve(own, kind, heaps[m.part])
                    mine = np.unpackbits(np.frombuffer(bits, np.uint8), count=cells).astype(bool) if bits else np.ones(cells, bool)
                    if (seen & mine).any():
                        raise InvalidState(f"a cell of chunk {at} is given twice")
                    data[mine], seen = own[mine], seen | mine
                raw = data.tobytes()
                if t.chunked:
                    raw = filters.encode(raw)
            if t.chunked:
                entries[at] = (b.put(raw), len(raw), 0)
            elif shape:
                start = at[0] * t.chunk[0]
                b.poke(base + start * row, raw[: (min(shape[0], start + t.chunk[0]) - start) * row])
            else:
                b.poke(base, raw)
        if not t.chunked:
            b.file.truncate(b.end)
    finally:
        for f in files.values():
            f.close()
    if before:
        spec = bd.Spec(spec.path, spec.type, shape, spec.max_shape, spec.chunk, spec.filters, spec.index, [*spec.attributes, *t.attributes], spec.fill)
        b.chunked(spec, entries, replace_=True)
    elif t.chunked:
        unlimited = t.max_shape or (shape if t.index in ("fixed", "single", "implicit") else (None, *shape[1:]) if t.index in ("", "extensible") else (None,) * t.rank)
        b.chunked(bd.Spec(t.dataset, kind, shape, unlimited, t.chunk, filters, t.index, t.attributes), entries)
    else:
        b.contiguous(bd.Spec(t.dataset, kind, shape, attributes=t.attributes), base)


def _inside(at: tuple[int, ...], chunk: tuple[int, ...], shape: tuple[int, ...]) -> np.ndarray:
    """Cells of a chunk that an array of this shape has."""
    made = np.ones(chunk, bool)
    for i, (a, k, n) in enumerate(zip(at, chunk, shape, strict=True)):
        made[(slice(None),) * i + (slice(max(0, min(k, n - a * k)), None),)] = False
    return made.reshape(-1)


def _heap(b: bd.Builder, m: Written) -> int:
    """Where a part's strings are now."""
    base = b.reserve(m.heap)
    b.file.seek(base)
    with open(f"{m.part}.heap", "rb") as f:
        shutil.copyfileobj(f, b.file, 1 << 20)
    return base


def _resolve(cells: np.ndarray, kind: dt.DType, base: int) -> None:
    for offset in dt.string_offsets(kind):
        own = np.ascontiguousarray(cells[:, offset : offset + 16]).view(bd.REF)[:, 0]
        own["at"][own["k"] > 0] += base
        cells[:, offset : offset + 16] = own.view(np.uint8).reshape(-1, 16)


def check_target(t: Target, append: bool) -> None:
    if append and os.path.exists(local(t.path)):
        c = open_container(t.path)
        c.file.close()
        if not t.extend and t.dataset in c.datasets:
            raise InvalidState(f"{t.dataset} exists; the option extend adds cells to it")


class ArrayWriter(DataSourceArrowWriter):
    """Tasks encode chunks into part files beside the container; the driver joins them."""

    def __init__(self, options: dict, schema: T.StructType, overwrite: bool):
        options, d = dict(options), None
        if options.get("extend") == "true" and not overwrite and os.path.exists(local(options["path"])):
            c = open_container(options["path"])
            d = c.datasets.get(options["dataset"].strip("/"))
            c.file.close()
            if d is not None:
                if d.layout.kind != "chunked":
                    raise InvalidState(f"{d.path} is not chunked and can't grow")
                options["chunk"] = ",".join(map(str, d.chunk))
        self.target, self.overwrite = target_of(options, schema), overwrite
        t = self.target
        check_target(t, not overwrite)
        if d is not None:
            if d.type.size != t.type.size or d.type.kind != t.type.kind:
                raise TypeMismatch(f"{t.type.kind} of {t.type.size} bytes for {t.dataset}")
            t.filters, t.type = d.filters, d.type
        self.folder = f"{local(t.path)}.parts-{uuid.uuid4().hex}"

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        part = Part(self.target, self.folder)
        for batch in iterator:
            part.add(batch)
        return part.close()

    def commit(self, messages: list[Written | None]) -> None:
        t = self.target
        done = [m for m in messages if m is not None]
        fresh = self.overwrite or not os.path.exists(local(t.path))
        path = f"{local(t.path)}.new-{uuid.uuid4().hex}" if fresh else local(t.path)
        b = bd.Builder(path, append=not fresh)
        try:
            before = b.spec_of(t.dataset) if not fresh and t.extend and b.old and t.dataset in b.old.datasets else None
            store(b, t, done, before)
            b.finish()
        except BaseException:
            b.abandon()
            if fresh and os.path.exists(path):
                os.remove(path)
            raise
        finally:
            shutil.rmtree(self.folder, ignore_errors=True)
        if fresh:
            os.replace(path, local(t.path))

    def abort(self, messages: list[Written | None]) -> None:
        shutil.rmtree(self.folder, ignore_errors=True)


# --- streams ----------------------------------------------------------------------------------------


class FrameStream(DataSourceStreamReader):
    """Rows of the first axis as they come; the offset is how many there are. Each trigger reads
    the superblock anew, so a writer may append meanwhile."""

    def __init__(self, options: dict, schema: T.StructType, how: dict):
        self.options, self.schema, self.how = dict(options), schema, how

    def _open(self) -> tuple[Container, Dataset]:
        error: Exception | None = None
        for _ in range(20):  # a superblock may be caught half-written
            try:
                c = open_container(self.options["path"], self.options.get("paired", "false") == "true")
                return c, c.dataset(self.options["dataset"])
            except ArrayError as e:
                error = e
        raise error

    def initialOffset(self) -> dict:  # noqa: N802
        return {"frames": int(self.options.get("start", 0))}

    def latestOffset(self) -> dict:  # noqa: N802
        c, d = self._open()
        c.file.close()
        return {"frames": d.shape[0] if d.shape else 0}

    def partitions(self, start: dict, end: dict) -> list[Piece]:
        c, d = self._open()
        low, high = (start["frames"], *(0,) * (d.rank - 1)), (end["frames"], *d.shape[1:])
        made = plan(c, d, low, high, int(self.options.get("target_bytes", TARGET_BYTES)), self.how["form"] == "frame")
        c.file.close()
        return made

    def read(self, piece: Piece) -> Iterator[pa.RecordBatch]:
        c, d = self._open()
        yield from read_piece(c, d, piece, Rows(c, d, self.schema, **self.how))

    def commit(self, end: dict) -> None:
        pass


class FrameSink(DataSourceStreamArrowWriter):
    """Each micro-batch appends its frames, ordered by the column ``seq``, behind those there are.

    The last batch's number is an attribute of the dataset, written with its frames; a batch that
    is given again is skipped.
    """

    BATCH = "last_batch"

    def __init__(self, options: dict, schema: T.StructType):
        self.options = dict(options)
        self.schema = schema
        self.folder = f"{local(self.options['path'])}.parts-{uuid.uuid4().hex}"

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        os.makedirs(self.folder, exist_ok=True)
        path = f"{self.folder}/{uuid.uuid4().hex}.arrow"
        writer = None
        for batch in iterator:
            if writer is None:
                writer = pa.ipc.new_file(path, batch.schema)
            writer.write_batch(batch)
        if writer is not None:
            writer.close()
        return Written(path if writer is not None else "", [], ())

    def commit(self, messages: list[Written | None], batchId: int) -> None:  # noqa: N803
        o = self.options
        fresh = not os.path.exists(local(o["path"]))
        b = bd.Builder(o["path"], append=not fresh)
        name = o["dataset"].strip("/")
        old = b.old.datasets.get(name) if b.old else None
        last = next((int(np.frombuffer(a.raw, dt.np_dtype(a.type))[0]) for a in (old.attributes if old else []) if a.name == self.BATCH), -1)
        tables = []
        for m in messages:
            if m is not None and m.part:
                with pa.ipc.open_file(m.part) as f:
                    tables.append(f.read_all())
        if batchId <= last or not tables:
            b.abandon()
            shutil.rmtree(self.folder, ignore_errors=True)
            return
        rows = pa.concat_tables(tables).sort_by("seq").drop_columns(["seq"])
        first = old.shape[0] if old else 0
        rows = rows.add_column(0, "d0", pa.array(np.arange(first, first + len(rows), dtype=np.int64)))
        fields = [T.StructField("d0", T.LongType()), *[f for f in self.schema.fields if f.name != "seq"]]
        inner = []
        value = rows.column("value").combine_chunks() if "value" in rows.column_names else None
        while value is not None and pa.types.is_list(value.type):
            inner.append(int(np.diff(np.asarray(value.offsets))[0]))
            value = value.flatten()
        chunk = ",".join(map(str, (1, *inner)))
        t = target_of(o | {"chunk": o.get("chunk", chunk), "max_shape": ",".join(["*", *map(str, inner)])}, T.StructType(fields))
        if old:
            t.chunk, t.filters, t.type = old.chunk, old.filters, old.type
        t.attributes = [*t.attributes, ms.number_attribute(self.BATCH, int(batchId))]
        try:
            part = Part(t, self.folder)
            for batch in rows.to_batches(max_chunksize=4096):
                part.add(batch)
            store(b, t, [part.close()], b.spec_of(name) if old else None)
            b.finish()
        except BaseException:
            b.abandon()
            raise
        finally:
            shutil.rmtree(self.folder, ignore_errors=True)

    def abort(self, messages: list[Written | None], batchId: int) -> None:  # noqa: N803
        shutil.rmtree(self.folder, ignore_errors=True)
