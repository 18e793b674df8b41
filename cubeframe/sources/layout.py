"""From arrays to rows and back: the long, frame and chunk forms."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import types as T

from cubeframe.codec import datatype as dt
from cubeframe.codec.container import Container, Dataset

#: Cells of an Arrow batch in the long form; bytes of its strings, or cells where references don't state lengths.
BATCH_CELLS, BATCH_BYTES, BATCH_UNKNOWN = 1 << 17, 4 << 20, 1000


def is_axis(name: str) -> bool:
    return name[:1] == "d" and name[1:].isdigit()


def schema_of(d: Dataset, form: str, u64: str = "decimal", enums: str = "name", flatten: bool = False, fields: tuple[str, ...] = ()) -> T.StructType:
    """long: d0, d1, ..., value; frame: d0 and an array of the other axes; chunk: chunk_coord,
    chunk_offset, chunk_shape, data. ``flatten`` gives compound members columns of their own."""
    kind = d.type
    value = dt.spark_type(kind, u64, enums)
    if fields and kind.kind == "compound":
        value = T.StructType([f for f in value.fields if f.name in fields])
    out = T.StructType()
    if form == "chunk":
        longs = T.ArrayType(T.LongType())
        return out.add("chunk_coord", longs).add("chunk_offset", longs).add("chunk_shape", longs).add("data", T.ArrayType(value))
    axes = range(d.rank if form == "long" else min(1, d.rank))
    for i in axes:
        out = out.add(f"d{i}", T.LongType())
    if form == "frame":
        for _ in range(max(0, d.rank - 1)):
            value = T.ArrayType(value)
    if flatten and kind.kind == "compound" and form == "long":
        for f in value.fields:
            out = out.add(f.name, f.dataType)
        return out
    return out.add("value", value)


class Rows:
    """Turns sub-boxes of a dataset into Arrow batches of one form."""

    def __init__(self, c: Container, d: Dataset, schema: T.StructType, form: str, u64: str, enums: str):
        self.c, self.d, self.form, self.u64, self.enums = c, d, form, u64, enums
        self.names = [f.name for f in schema.fields]
        self.schema = schema
        self.flat = form == "long" and d.type.kind == "compound" and [n for n in self.names if not is_axis(n)] != ["value"]

    def _values(self, x: np.ndarray, inner: int) -> pa.Array:
        """Cells of a box, flat; inner axes of an array type stay together."""
        if self.d.type.kind == "compound":
            keep = [f.name for f in self._value_fields()] or list(self.d.type.names)
            t = self.d.type
            cut = [i for i, n in enumerate(t.names) if n in keep]
            sub = dt.DType("compound", t.size, names=tuple(t.names[i] for i in cut), offsets=tuple(t.offsets[i] for i in cut), parts=tuple(t.parts[i] for i in cut))
            return dt.to_arrow(x.reshape(-1), sub, self.c.strings, self.u64, self.enums)
        return dt.to_arrow(x.reshape(-1), self.d.type, self.c.strings, self.u64, self.enums)

    def _value_fields(self) -> list[T.StructField]:
        by = {f.name: f.dataType for f in self.schema.fields}
        if not self.flat:
            kind = by["data" if self.form == "chunk" else "value"]
            while isinstance(kind, T.ArrayType):
                kind = kind.elementType
            return kind.fields if isinstance(kind, T.StructType) else []
        return [f for f in self.schema.fields if f.name in self.d.type.names]

    def _batch(self, columns: dict[str, pa.Array]) -> pa.RecordBatch:
        if self.flat:
            struct = columns.pop("value")
            columns |= {struct.type.field(i).name: struct.field(i) for i in range(struct.type.num_fields)}
        return pa.RecordBatch.from_arrays([columns[n] for n in self.names], names=self.names)

    def _cuts(self, x: np.ndarray, row: int) -> Iterator[tuple[int, int]]:
        """Runs of the first axis that make a batch each; ``row`` cells in each of its indices."""
        places, n, at = dt.string_offsets(self.d.type), len(x), 0
        stated = bool(places) and dt.reference_size(self.d.type) >= 8 + self.c.a
        step = max(1, (BATCH_UNKNOWN if places and not stated else BATCH_CELLS) // max(1, row))
        total = np.zeros(n, np.int64)
        if stated and n:
            raw = np.frombuffer(x.tobytes(), np.uint8).reshape(n, -1, self.d.type.size)
            total = np.cumsum(sum(np.ascontiguousarray(raw[..., o : o + 4]).view("<u4").sum(axis=(1, 2), dtype=np.int64) for o in places))
        while at < n:
            fits = int(np.searchsorted(total, (total[at - 1] if at else 0) + BATCH_BYTES, "right"))
            end = min(n, at + step, max(at + 1, fits))
            yield at, end
            at = end

    def emit(self, x: np.ndarray, offset: tuple[int, ...], coord: tuple[int, ...] = ()) -> Iterator[pa.RecordBatch]:
        """``x``: cells of a box that starts at ``offset``; axes beyond the rank belong to an array type."""
        rank = self.d.rank
        shape = x.shape[:rank]
        if self.form == "chunk":
            one = lambda v: pa.array([list(map(int, v))], pa.list_(pa.int64()))
            data = self._values(x, 0)
            lists = pa.ListArray.from_arrays(pa.array([0, len(data)], pa.int32()), data)
            yield self._batch({"chunk_coord": one(coord), "chunk_offset": one(offset), "chunk_shape": one(shape), "data": lists})
            return
        if rank == 0:
            yield self._batch({"value": self._values(x, 0)})
            return
        row = int(np.prod(shape[1:], dtype=np.int64)) if rank > 1 else 1
        for at, end in self._cuts(x, row):
            part = x[at:end]
            n = len(part)
            first = np.arange(offset[0] + at, offset[0] + at + n, dtype=np.int64)
            values = self._values(part, 0)
            if self.form == "frame":
                for size in reversed(shape[1:]):
                    values = pa.ListArray.from_arrays(pa.array(np.arange(0, len(values) + 1, size, dtype=np.int32)) if size else pa.array(np.zeros(n + 1, np.int32)), values)
                yield self._batch({"d0": pa.array(first), "value": values})
                continue
            columns = {}
            if "d0" in self.names:
                columns["d0"] = pa.array(np.repeat(first, row))
            left = row
            for i, size in enumerate(shape[1:], 1):
                left //= max(size, 1)
                if f"d{i}" in self.names:
                    own = np.arange(offset[i], offset[i] + size, dtype=np.int64)
                    columns[f"d{i}"] = pa.array(np.tile(np.repeat(own, left), n * row // max(1, size * left)))
            yield self._batch(columns | {"value": values})


# --- from rows ------------------------------------------------------------------------------


def cells_of(batch: pa.RecordBatch, kind: dt.DType, add_strings) -> tuple[np.ndarray, np.ndarray]:
    """(coordinates (n, rank), values) of a batch in the long or frame form; columns that are
    neither d* nor value make up a compound."""
    names = batch.schema.names
    axes = [n for n in sorted(names, key=lambda n: (len(n), n)) if is_axis(n)]
    rest = [n for n in names if n not in axes]
    if rest == ["value"]:
        value = batch.column(names.index("value"))
    else:
        value = pa.StructArray.from_arrays([batch.column(names.index(n)) for n in rest], names=rest)
    coords = [np.asarray(batch.column(names.index(a)).cast(pa.int64())) for a in axes]
    if any(batch.column(names.index(a)).null_count for a in axes):
        from cubeframe.errors import TypeMismatch

        raise TypeMismatch("a coordinate is null")
    depth = 0
    while pa.types.is_list(value.type) and not (kind.kind == "array" and _depth(value.type) <= len(kind.dims)):
        lengths = np.diff(np.asarray(value.offsets))
        start = np.asarray(value.offsets)
        value = value.flatten()
        coords = [np.repeat(c, lengths) for c in coords]
        coords.append(np.arange(len(value), dtype=np.int64) - np.repeat(start[:-1] - start[0], lengths))
        depth += 1
    made = dt.from_arrow(value, kind, add_strings)
    return np.stack(coords, axis=1) if coords else np.zeros((len(made), 0), np.int64), made


def _depth(t: pa.DataType) -> int:
    n = 0
    while pa.types.is_list(t):
        t, n = t.value_type, n + 1
    return n
