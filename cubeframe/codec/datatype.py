"""Element types: the datatype message, numpy dtypes, and Spark and Arrow types."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import types as T

from cubeframe.codec.cursor import Bytes, Cursor
from cubeframe.errors import InvalidData, TypeMismatch, UnsupportedFeature


@dataclass(frozen=True)
class DType:
    """kind: int uint float string vstring enum compound array opaque (also bitfields, references, times, sequences)."""

    kind: str
    size: int
    big: bool = False
    base: DType | None = None
    names: tuple[str, ...] = ()
    values: tuple[int, ...] = ()  # of enum members
    offsets: tuple[int, ...] = ()  # of compound members
    parts: tuple[DType, ...] = ()
    dims: tuple[int, ...] = ()
    pad: int = 0  # of strings: 0 ends at NUL, 1 filled with NUL, 2 filled with spaces
    utf8: bool = True

    @property
    def is_bool(self) -> bool:
        return self.kind == "enum" and sorted(zip(self.names, self.values)) == [("FALSE", 0), ("TRUE", 1)]

    @property
    def is_complex(self) -> bool:
        return self.kind == "compound" and self.names == ("r", "i") and all(p.kind == "float" for p in self.parts)


def uint(size: int) -> DType:
    return DType("uint", size)


def integer(size: int) -> DType:
    return DType("int", size)


def real(size: int) -> DType:
    return DType("float", size)


BOOL = DType("enum", 1, base=DType("uint", 1), names=("FALSE", "TRUE"), values=(0, 1))
VSTRING = DType("vstring", 16)
_NAMED = {f"{c}{8 * n}": DType(k, n) for k, c in (("int", "i"), ("uint", "u")) for n in (1, 2, 4, 8)} | {"f32": real(4), "f64": real(8), "bool": BOOL, "string": VSTRING}
_NAMED |= {f"complex{8 * n}": DType("compound", 2 * n, names=("r", "i"), offsets=(0, n), parts=(real(n), real(n))) for n in (4, 8)}


def named(name: str) -> DType:
    """By short name: i8 .. i64, u8 .. u64, f32, f64, bool, complex32, complex64, string, string:N, >f8-like with a leading ``>``."""
    if name.startswith("string:"):
        return DType("string", int(name[7:]), pad=1)
    big = name.startswith(">")
    if (found := _NAMED.get(name.lstrip("><"))) is None:
        raise TypeMismatch(f"no element type named {name}")
    return DType(found.kind, found.size, big=True) if big else found


def compound(members: list[tuple[str, DType]]) -> DType:
    """Members packed one after the other."""
    offsets, at = [], 0
    for _, part in members:
        offsets.append(at)
        at += part.size
    return DType("compound", at, names=tuple(n for n, _ in members), offsets=tuple(offsets), parts=tuple(p for _, p in members))


# --- message ------------------------------------------------------------------


def decode(c: Cursor) -> DType:
    start = c.at
    head = c.u8()
    kind, version = head & 15, head >> 4
    flags = c.take(3)
    size = c.u32()
    big = bool(flags[0] & 1)
    if kind == 0:
        offset, precision = c.u16(), c.u16()
        if offset or precision != 8 * size:
            return DType("opaque", size)
        return DType("int" if flags[0] & 8 else "uint", size, big)
    if kind == 1:
        c.take(12)
        if size not in (2, 4, 8) or flags[0] & 0x40:
            return DType("opaque", size)
        return DType("float", size, big)
    if kind == 3:
        return DType("string", size, pad=flags[0] & 15, utf8=flags[0] >> 4 == 1)
    if kind in (2, 4, 5, 7):
        if kind in (2, 4):
            c.take(2 if kind == 2 else 4)
        elif kind == 5:
            c.take(flags[0])
        return DType("opaque", size)
    if kind == 6:
        names, offsets, parts = [], [], []
        for _ in range(int.from_bytes(flags[:2], "little")):
            at = c.at
            names.append(c.text())
            if version < 3:
                c.align(8, at)
            offsets.append(c.uint(4) if version < 3 else c.uint(max(1, (size.bit_length() + 7) // 8)))
            dims: list[int] = []
            if version == 1:
                rank = c.u8()
                c.take(11)
                dims = [c.u32() for _ in range(4)][:rank]
            part = decode(c)
            parts.append(DType("array", part.size * int(np.prod(dims)), base=part, dims=tuple(dims)) if dims else part)
        return DType("compound", size, names=tuple(names), offsets=tuple(offsets), parts=tuple(parts))
    if kind == 8:
        base, names = decode(c), []
        n = int.from_bytes(flags[:2], "little")
        for _ in range(n):
            at = c.at
            names.append(c.text())
            if version < 3:
                c.align(8, at)
        raw = np.frombuffer(c.take(n * base.size), np_dtype(base))
        return DType("enum", size, base=base, names=tuple(names), values=tuple(int(v) for v in raw))
    if kind == 9:
        base = decode(c)
        if flags[0] & 15 == 1:
            return DType("vstring", size, utf8=flags[1] & 15 == 1)
        return DType("sequence", size, base=base)
    if kind == 10:
        rank = c.u8()
        if version < 3:
            c.take(3)
        dims = tuple(c.u32() for _ in range(rank))
        if version < 3:
            c.take(4 * rank)
        base = decode(c)
        return DType("array", size, base=base, dims=dims)
    raise UnsupportedFeature(f"datatype class {kind} at {start}")


def encode(t: DType) -> bytes:
    out = Bytes()

    def head(kind: int, version: int, f0: int = 0, f1: int = 0) -> None:
        out.uint(kind | version << 4, 1).uint(f0, 1).uint(f1, 1).uint(0, 1).uint(t.size, 4)

    if t.kind in ("int", "uint"):
        head(0, 1, t.big | (8 if t.kind == "int" else 0))
        out.uint(0, 2).uint(8 * t.size, 2)
    elif t.kind == "float":
        exponent, mantissa, bias = {2: (5, 10, 15), 4: (8, 23, 127), 8: (11, 52, 1023)}[t.size]
        head(1, 1, t.big | 0x20, 8 * t.size - 1)
        out.uint(0, 2).uint(8 * t.size, 2).uint(mantissa, 1).uint(exponent, 1).uint(0, 1).uint(mantissa, 1).uint(bias, 4)
    elif t.kind == "string":
        head(3, 1, t.pad | t.utf8 << 4)
    elif t.kind == "opaque":
        head(5, 1, 8)
        out += bytes(8)
    elif t.kind == "compound":
        head(6, 3, *len(t.names).to_bytes(2, "little"))
        width = max(1, (t.size.bit_length() + 7) // 8)
        for name, offset, part in zip(t.names, t.offsets, t.parts, strict=True):
            out += name.encode() + b"\0"
            out.uint(offset, width)
            out += encode(part)
    elif t.kind == "enum":
        head(8, 3, *len(t.names).to_bytes(2, "little"))
        out += encode(t.base)
        for name in t.names:
            out += name.encode() + b"\0"
        out += np.array(t.values).astype(np_dtype(t.base)).tobytes()
    elif t.kind == "vstring":
        head(9, 1, 1, t.utf8)
        out += encode(DType("string", 1, utf8=t.utf8))
    elif t.kind == "array":
        head(10, 3)
        out.uint(len(t.dims), 1)
        for d in t.dims:
            out.uint(d, 4)
        out += encode(t.base)
    else:
        raise UnsupportedFeature(f"writing of {t.kind}")
    return bytes(out)


def string_offsets(t: DType, at: int = 0) -> list[int]:
    """Places of variable-length references in an element."""
    if t.kind == "vstring":
        return [at]
    if t.kind == "compound":
        return [x for p, o in zip(t.parts, t.offsets, strict=True) for x in string_offsets(p, at + o)]
    if t.kind == "array":
        return [x for k in range(int(np.prod(t.dims))) for x in string_offsets(t.base, at + k * t.base.size)]
    return []


def reference_size(t: DType) -> int:
    """Bytes of the smallest variable-length reference in an element; 0 if there is none."""
    if t.kind == "vstring":
        return t.size
    parts = t.parts if t.kind == "compound" else (t.base,) if t.kind == "array" else ()
    return min(filter(None, map(reference_size, parts)), default=0)


# --- numpy ----------------------------------------------------------------------


def np_dtype(t: DType) -> np.dtype:
    order = ">" if t.big else "<"
    if t.kind in ("int", "uint", "float"):
        return np.dtype(f"{order}{ {'int': 'i', 'uint': 'u', 'float': 'f'}[t.kind]}{t.size}")
    if t.kind == "enum":
        return np_dtype(t.base)
    if t.kind == "compound":
        return np.dtype({"names": list(t.names), "formats": [np_dtype(p) for p in t.parts], "offsets": list(t.offsets), "itemsize": t.size})
    if t.kind == "array":
        return np.dtype((np_dtype(t.base), t.dims))
    return np.dtype(f"V{t.size}")


# --- Spark and Arrow ---------------------------------------------------------------


def spark_type(t: DType, u64: str = "decimal", enums: str = "name") -> T.DataType:
    """u64: decimal (lossless) or long. enums: name or code. Unsigned types widen; what has no
    Spark type is binary."""
    if t.kind == "int":
        return {1: T.ByteType(), 2: T.ShortType(), 4: T.IntegerType(), 8: T.LongType()}[t.size]
    if t.kind == "uint":
        return {1: T.ShortType(), 2: T.IntegerType(), 4: T.LongType(), 8: T.DecimalType(20, 0) if u64 == "decimal" else T.LongType()}[t.size]
    if t.kind == "float":
        return T.DoubleType() if t.size == 8 else T.FloatType()
    if t.kind in ("string", "vstring"):
        return T.StringType()
    if t.kind == "enum":
        return T.BooleanType() if t.is_bool else T.StringType() if enums == "name" else spark_type(t.base, u64)
    if t.kind == "compound":
        return T.StructType([T.StructField(n, spark_type(p, u64, enums)) for n, p in zip(t.names, t.parts, strict=True)])
    if t.kind == "array":
        made = spark_type(t.base, u64, enums)
        for _ in t.dims:
            made = T.ArrayType(made)
        return made
    return T.BinaryType()


def of_spark(s: T.DataType) -> DType:
    """The element type that a Spark type is stored as."""
    plain = {T.ByteType: "i8", T.ShortType: "i16", T.IntegerType: "i32", T.LongType: "i64", T.FloatType: "f32", T.DoubleType: "f64", T.BooleanType: "bool", T.StringType: "string", T.TimestampType: "i64", T.TimestampNTZType: "i64", T.DateType: "i32"}
    if name := plain.get(type(s)):
        return named(name)
    if isinstance(s, T.DecimalType) and s.scale == 0 and s.precision <= 20:
        return uint(8)
    if isinstance(s, T.StructType):
        return compound([(f.name, of_spark(f.dataType)) for f in s.fields])
    raise TypeMismatch(f"{s.simpleString()} has no element type")


def to_arrow(x: np.ndarray, t: DType, strings=None, u64: str = "decimal", enums: str = "name") -> pa.Array:
    """A flat numpy array of np_dtype(t) as Arrow; ``strings`` dereferences variable-length ones."""
    if t.kind in ("int", "uint", "float"):
        x = x.astype(x.dtype.newbyteorder("="), copy=False)
        if t.kind == "uint":
            if t.size == 8:
                if u64 == "decimal":
                    return pa.array(x, pa.uint64()).cast(pa.decimal128(20, 0))
                if len(x) and x.max() > np.iinfo(np.int64).max:
                    raise InvalidData("an unsigned value beyond 64-bit signed range; read with u64=decimal")
            return pa.array(x.astype({1: np.int16, 2: np.int32, 4: np.int64, 8: np.int64}[t.size]))
        return pa.array(np.ascontiguousarray(x.astype(np.float32) if t.kind == "float" and t.size == 2 else x))
    if t.kind == "enum":
        if t.is_bool:
            return pa.array(x != 0)
        if enums == "code":
            return to_arrow(x, t.base, u64=u64)
        known = dict(zip(t.values, t.names, strict=True))
        return pa.array([known.get(v, str(v)) for v in x.tolist()], pa.string())
    if t.kind == "string":
        return pa.array([_text(v, t.pad) for v in _cells(x, t.size)], pa.string())
    if t.kind == "vstring":
        if strings is None:
            raise InvalidData("variable-length strings need their container")
        return pa.array(strings(_cells(x, t.size)), pa.string())
    if t.kind == "compound":
        return pa.StructArray.from_arrays([to_arrow(x[n], p, strings, u64, enums) for n, p in zip(t.names, t.parts, strict=True)], names=list(t.names))
    if t.kind == "array":
        made = to_arrow(x.reshape(-1), t.base, strings, u64, enums)
        for d in reversed(t.dims):
            made = pa.ListArray.from_arrays(pa.array(np.arange(0, len(made) + 1, d, dtype=np.int32)), made)
        return made
    return pa.array(_cells(x, t.size), pa.binary())


def _cells(x: np.ndarray, size: int) -> list[bytes]:
    raw = x.tobytes()
    return [raw[i : i + size] for i in range(0, len(raw), size)]


def _text(raw: bytes, pad: int) -> str:
    text = raw.split(b"\0", 1)[0].decode("utf-8", "replace")
    return text.rstrip(" ") if pad == 2 else text


def from_arrow(a: pa.Array, t: DType, add_strings=None) -> np.ndarray:
    """A flat numpy array of np_dtype(t) from Arrow without nulls; narrowing that loses a value raises."""
    if isinstance(a, pa.ChunkedArray):
        a = a.combine_chunks()
    if a.null_count:
        raise TypeMismatch("a container has no nulls; give null_value or filter them")
    if t.kind in ("int", "uint", "float", "enum"):
        base = np_dtype(t)
        if t.kind == "enum" and pa.types.is_string(a.type):
            codes = dict(zip(t.names, t.values, strict=True))
            if unknown := {v for v in a.to_pylist()} - codes.keys():
                raise TypeMismatch(f"no enum member {sorted(unknown)[0]}")
            return np.array([codes[v] for v in a.to_pylist()], base)
        if pa.types.is_decimal(a.type):
            a = a.cast(pa.uint64() if base.kind == "u" else pa.int64())
        elif pa.types.is_timestamp(a.type):
            a = a.cast(pa.timestamp("us", a.type.tz)).cast(pa.int64())
        elif pa.types.is_date(a.type):
            a = a.cast(pa.date32()).cast(pa.int32())
        x = np.asarray(a.cast(pa.uint8()) if pa.types.is_boolean(a.type) else a)
        made = x.astype(base)
        if base.kind in "iu" and not np.array_equal(made, x):
            raise TypeMismatch(f"a value does not fit {base}")
        return made
    if t.kind == "string":
        out = np.zeros(len(a), f"S{t.size}")
        for i, v in enumerate(a.to_pylist()):
            raw = v.encode()
            if len(raw) > t.size:
                raise TypeMismatch(f"a string of {len(raw)} bytes does not fit {t.size}")
            out[i] = raw.ljust(t.size, b" ") if t.pad == 2 else raw
        return out.view(f"V{t.size}")
    if t.kind == "vstring":
        return np.frombuffer(add_strings([v.encode() for v in a.to_pylist()]), f"V{t.size}")
    if t.kind == "compound":
        out = np.zeros(len(a), np_dtype(t))
        for n, p in zip(t.names, t.parts, strict=True):
            out[n] = from_arrow(a.field(n), p, add_strings)
        return out
    if t.kind == "array":
        for d in t.dims:
            if len(a) and not (np.diff(a.offsets.to_numpy()) == d).all():
                raise TypeMismatch(f"lists of {d} are needed")
            a = a.flatten()
        return from_arrow(a, t.base, add_strings).reshape(-1, *t.dims).view(np.dtype(np_dtype(t.base))).reshape(-1, *t.dims)
    if t.kind == "opaque":
        return np.frombuffer(b"".join(v.ljust(t.size, b"\0") for v in a.to_pylist()), f"V{t.size}")
    raise UnsupportedFeature(f"writing of {t.kind}")
