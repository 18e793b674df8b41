"""Codec vectors, round trips over shapes and indices, and hand-made bytes of the old format."""

import itertools
import struct

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from cubeframe import errors, filters
from cubeframe.codec import builder as bd
from cubeframe.codec import checksum, container
from cubeframe.codec import datatype as dt
from cubeframe.codec import index as ix
from cubeframe.codec import messages as ms
from cubeframe.codec.cursor import Cursor


@pytest.mark.parametrize(("text", "seed", "want"), [(b"Hello", 0, 0xC7BC405B), (b"Hello", 1, 0xDC096650), (b"Four score and seven years", 0, 0x769E8A62), (b"Four score and seven years", 1, 0xF9F2FFCB), (b"a", 0, 0x58D68708)])
def test_lookup3(text, seed, want):
    assert checksum.lookup3(text, seed) == want


def build(path, array, kind, chunk, most=None, index="", text=""):
    b = bd.Builder(path)
    pipe = filters.pipeline(text, kind.size, int(np.prod(chunk)) * kind.size)
    entries = {}
    for at in itertools.product(*[range(-(-n // c)) for n, c in zip(array.shape, chunk)]):
        cell = np.zeros(chunk, array.dtype)
        part = array[tuple(slice(a * c, (a + 1) * c) for a, c in zip(at, chunk))]
        cell[tuple(slice(0, n) for n in part.shape)] = part
        raw = pipe.encode(cell.tobytes())
        entries[at] = (b.put(raw), len(raw), 0)
    b.chunked(bd.Spec("a/b/data", kind, array.shape, most, chunk, pipe, index, [ms.string_attribute("units", "K")]), entries)
    b.group("empty", [ms.number_attribute("n", 7)])
    b.finish()


@pytest.mark.parametrize("text", ["", "deflate:1", "shuffle,zstd:1,fletcher32"])
@pytest.mark.parametrize(
    ("shape", "chunk", "most", "index"),
    [
        ((7,), (3,), None, "fixed"), ((3000,), (1,), None, "fixed"), ((5000,), (1,), (None,), "extensible"), ((300, 2), (1, 2), (None, 2), ""),
        ((5, 40), (5, 1), (5, None), "extensible"), ((13, 17), (4, 5), (None, None), "btree2"), ((1500, 3), (1, 1), (None, None), "btree2"),
        ((6, 6), (6, 6), None, "single"), ((4, 6), (2, 3), None, "fixed"), ((10, 4), (4, 3), (20, 9), "fixed"), ((3, 4, 5), (2, 2, 2), (None, 4, 5), ""),
    ],
)
def test_indices(tmp_path, shape, chunk, most, index, text):
    x = np.random.default_rng(0).random(shape)
    path = str(tmp_path / "x.h5")
    build(path, x, dt.real(8), chunk, most, index, text)
    c = container.open_container(path)
    d = c.dataset("/a/b/data")
    assert (c.box(d, (0,) * x.ndim, shape) == x).all()
    assert set(c.groups) == {"", "a", "a/b", "empty"}
    start = tuple(n // 3 for n in shape)
    count = tuple(n - s for n, s in zip(shape, start))
    assert (c.box(d, start, count) == x[tuple(slice(s, None) for s in start)]).all()


def test_implicit_index(tmp_path):
    x = np.arange(35.0).reshape(5, 7)
    build(str(tmp_path / "x.h5"), x, dt.real(8), (2, 3), None, "implicit")
    c = container.open_container(str(tmp_path / "x.h5"))
    assert (c.box(c.dataset("a/b/data"), (0, 0), (5, 7)) == x).all()


@settings(max_examples=25, deadline=None)
@given(st.data())
def test_any_shape(tmp_path_factory, data):
    rank = data.draw(st.integers(1, 4))
    shape = tuple(data.draw(st.integers(1, 7)) for _ in range(rank))
    chunk = tuple(data.draw(st.integers(1, 9)) for _ in range(rank))
    name = data.draw(st.sampled_from(["i8", "u8", "i16", "u16", "i32", "u32", "i64", "u64", "f32", "f64", ">i32", ">f64"]))
    kind = dt.named(name)
    x = np.random.default_rng(1).integers(0, 100, shape).astype(dt.np_dtype(kind))
    path = str(tmp_path_factory.mktemp("p") / "x.h5")
    build(path, x, kind, chunk, None, "fixed", "shuffle,deflate:1")
    c = container.open_container(path)
    assert (c.box(c.dataset("a/b/data"), (0,) * rank, shape) == x).all()


def test_box_checks(tmp_path):
    build(str(tmp_path / "x.h5"), np.zeros((4, 5)), dt.real(8), (2, 2))
    c = container.open_container(str(tmp_path / "x.h5"))
    d = c.dataset("a/b/data")
    for start, count in (((0,), (1,)), ((0, 0), (5, 1)), ((3, 3), (1, 3)), ((-1, 0), (1, 1))):
        with pytest.raises(errors.OutOfBounds):
            c.box(d, start, count)
    with pytest.raises(errors.NotFound):
        c.dataset("nothing")


@pytest.mark.parametrize("kind", [*map(dt.named, ["i8", "u16", "i64", ">u32", "f32", ">f64", "bool", "complex32", "complex64", "string", "string:9"]), dt.compound([("a", dt.named("i32")), ("b", dt.named("f64")), ("c", dt.named("string"))]), dt.DType("array", 12, base=dt.integer(2), dims=(2, 3)), dt.DType("enum", 4, base=dt.integer(4), names=("x", "y"), values=(1, -5))])
def test_types(kind):
    raw = dt.encode(kind)
    c = Cursor(raw)
    assert dt.decode(c) == kind
    assert c.at == len(raw)
    for cut in range(len(raw)):
        with pytest.raises(errors.FormatError):
            dt.decode(Cursor(raw[:cut]))


def test_values(tmp_path):
    kind = dt.compound([("a", dt.named("i32")), ("s", dt.named("string:4")), ("z", dt.named("complex32")), ("e", dt.BOOL), ("r", dt.DType("array", 8, base=dt.integer(2), dims=(2, 2)))])
    rows = [{"a": i, "s": f"é{i}", "z": {"r": 0.5, "i": float(i)}, "e": i % 2 == 0, "r": [[1, 2], [3, i]]} for i in range(5)]
    x = dt.from_arrow(pa.array(rows), kind)
    assert dt.to_arrow(x, kind).to_pylist() == rows
    with pytest.raises(errors.TypeMismatch):
        dt.from_arrow(pa.array([300]), dt.integer(1))
    with pytest.raises(errors.TypeMismatch):
        dt.from_arrow(pa.array([1, None]), dt.integer(8))
    odd = np.array([np.nan, -0.0, np.inf]).view("<f8")
    assert dt.from_arrow(dt.to_arrow(odd, dt.real(8)), dt.real(8)).tobytes() == odd.tobytes()
    top = np.array([2**64 - 1, 0], "<u8")
    assert [int(v) for v in dt.to_arrow(top, dt.uint(8)).to_pylist()] == [2**64 - 1, 0]
    with pytest.raises(errors.InvalidData):
        dt.to_arrow(top, dt.uint(8), u64="long")


def test_append_keeps(tmp_path):
    path = str(tmp_path / "x.h5")
    build(path, np.arange(40.0).reshape(10, 4), dt.real(8), (1, 4), (None, 4), "", "deflate:6")
    before = open(path, "rb").read()
    b = bd.Builder(path, append=True)
    b.group("more", [ms.string_attribute("t", "x")])
    b.contiguous(bd.Spec("more/v", dt.integer(1), (3,)), b.put(b"\1\2\3"))
    b.finish()
    c = container.open_container(path)
    assert set(c.datasets) == {"a/b/data", "more/v"}
    assert {"empty", "more"} <= set(c.groups)
    assert c.group_attributes["empty"][0].name == "n"
    assert open(path, "rb").read()[48 : len(before)] == before[48:]
    b = bd.Builder(path, append=True)
    with pytest.raises(errors.InvalidState):
        b.contiguous(bd.Spec("more/v", dt.integer(1), (1,)), None)
    b.abandon()


def test_damage(tmp_path):
    path = tmp_path / "x.h5"
    build(str(path), np.random.default_rng(0).random(2000), dt.real(8), (500,), None, "fixed", "deflate:6,fletcher32")
    good = path.read_bytes()
    c = container.open_container(str(path))
    where = next(iter(c.chunk_entries(c.dataset("a/b/data")).values()))[0]
    path.write_bytes(good[: where + 9] + bytes([good[where + 9] ^ 255]) + good[where + 10 :])
    c = container.open_container(str(path))
    with pytest.raises(errors.FormatError):
        c.box(c.dataset("a/b/data"), (0,), (2000,))
    path.write_bytes(good[:30] + bytes([good[30] ^ 1]) + good[31:])
    with pytest.raises(errors.FormatError):
        container.open_container(str(path))
    path.write_bytes(b"nothing")
    with pytest.raises(errors.InvalidSignature):
        container.open_container(str(path))


def test_strings(tmp_path):
    """Many and large strings in many collections; references of either width."""
    texts = ["alice", "", "é" * 50_000, "b"] * 100 + ["x"] * 70_000
    b = bd.Builder(str(tmp_path / "x.h5"))
    body, refs = bd.heap_collections([t.encode() for t in texts])
    refs["at"] += b.put(body)
    b.contiguous(bd.Spec("names", dt.VSTRING, (len(texts),)), b.put(refs.tobytes()))
    short = np.zeros(4, np.dtype([("at", "<u8"), ("k", "<u4")]))
    short["at"], short["k"] = refs["at"][:4], refs["k"][:4]
    short["at"][1] = 2**64 - 1
    b.contiguous(bd.Spec("short", dt.DType("vstring", 12), (4,)), b.put(short.tobytes()))
    b.finish()
    c = container.open_container(str(tmp_path / "x.h5"))
    for name, want in (("names", texts), ("short", texts[:4])):
        d = c.dataset(name)
        cells = c.read_rows(d, 0, len(want))
        with pytest.raises(errors.OutOfBounds):
            c.box(d, (0,), (len(want) + 1,))
        assert dt.to_arrow(cells, d.type, c.strings).to_pylist() == want if name == "names" else [want[0], "", *want[2:]]


def test_paired_dialect(tmp_path):
    """An extensible array with direct blocks in pairs, and a tree whose records start with coordinates."""
    from cubeframe.codec.cursor import Bytes

    x = np.arange(200.0)
    b = bd.Builder(str(tmp_path / "x.h5"))
    where = [b.put(v.tobytes()) for v in x]
    header = b.reserve(72)
    index = Bytes(b"EAIB").uint(0, 2).address(header)
    for w in where[:4]:
        index.address(w)
    start = 0
    for n in (16, 16, 32, 32, 64, 64):
        block = Bytes(b"EADB").uint(0, 2).address(header).uint(start, 4)
        for k in range(n):
            block.address(where[4 + start + k] if 4 + start + k < len(x) else None)
        index.address(b.put(block.sealed()))
        start += n
    for _ in range(25):
        index.address(None)
    block = b.put(index.sealed())
    head = Bytes(b"EAHD").uint(0, 2)
    for v in (8, 32, 4, 16, 4, 10):
        head.uint(v, 1)
    for v in (0, 0, 6, 0, len(x), 228):
        head.size(v)
    b.poke(header, head.address(block).sealed())
    b._header(bd.Spec("ea", dt.real(8), (200,), (None,), (1,)), ms.Layout("chunked", header, chunk=(1,), index=ms.EXTENSIBLE, params=ix.EA_PARAMS), False)
    leaf = Bytes(b"BTLF").uint(0, 1).uint(10, 1)
    for k, w in enumerate(where[:9]):
        leaf.uint(k // 3, 8).uint(k % 3, 8).address(w)
    root = b.put(leaf.sealed())
    tree = Bytes(b"BTHD").uint(0, 1).uint(10, 1).uint(4096, 4).uint(24, 2).uint(0, 2).uint(100, 1).uint(40, 1).address(root).uint(9, 2).size(9)
    b._header(bd.Spec("bt", dt.real(8), (3, 3), (None, None), (1, 1)), ms.Layout("chunked", b.put(tree.sealed()), chunk=(1, 1), index=ms.BTREE2, params=(4096, 100, 40)), False)
    b.finish()
    c = container.open_container(str(tmp_path / "x.h5"), paired=True)
    assert (c.box(c.dataset("ea"), (0,), (200,)) == x).all()
    assert (c.box(c.dataset("bt"), (0, 0), (3, 3)) == x[:9].reshape(3, 3)).all()


def old_file() -> bytes:
    """A version 0 superblock, symbol tables two levels deep, version 1 headers, a contiguous and a
    tree-indexed dataset, made field by field."""
    out = bytearray(96)

    def put(data: bytes) -> int:
        out.extend(bytes(-len(out) % 8))
        out.extend(data)
        return len(out) - len(data)

    def header(*messages: tuple[int, bytes]) -> int:
        body = b"".join(struct.pack("<HHB3x", k, len(m) + -len(m) % 8, 0) + m + bytes(-len(m) % 8) for k, m in messages)
        return put(struct.pack("<BBHII4x", 1, 0, len(messages), 1, len(body)) + body)

    def group(members: list[tuple[str, int]]) -> int:
        names, heap = bytearray(8), []
        for name, _ in members:
            heap.append(len(names))
            names += name.encode() + b"\0" + bytes(-(len(name) + 1) % 8)
        data = put(bytes(names))
        local = put(b"HEAP" + struct.pack("<B3xQQQ", 0, len(names), 0, data))
        node = put(b"SNOD" + struct.pack("<BBH", 1, 0, len(members)) + b"".join(struct.pack("<QQII16x", at, a, 0, 0) for at, (_, a) in zip(heap, members)))
        tree = put(b"TREE" + struct.pack("<BBHQQ", 0, 0, 1, 2**64 - 1, 2**64 - 1) + struct.pack("<QQQ", 0, node, 8))
        return header((17, struct.pack("<QQ", tree, local)))

    space = lambda *n: struct.pack("<BBB5x", 1, len(n), 0) + struct.pack(f"<{len(n)}Q", *n)
    kind = dt.encode(dt.integer(4))
    flat = np.arange(12, dtype="<i4").reshape(3, 4)
    one = header((1, space(3, 4)), (3, kind), (8, struct.pack("<BBQQ", 3, 1, put(flat.tobytes()), 48)))
    chunks = []
    for i, j in itertools.product(range(2), range(2)):
        cell = np.zeros((2, 2), "<i4")
        part = flat[:, :3][2 * i : 2 * i + 2, 2 * j : 2 * j + 2]
        cell[: part.shape[0], : part.shape[1]] = part
        raw = filters.pipeline("deflate:6", 4).encode(cell.tobytes())
        chunks.append(((2 * i, 2 * j), put(raw), len(raw)))
    tree = put(b"TREE" + struct.pack("<BBHQQ", 1, 0, 4, 2**64 - 1, 2**64 - 1) + b"".join(struct.pack("<IIQQQQ", n, 0, *at, 0, a) for at, a, n in chunks) + struct.pack("<IIQQQ", 0, 0, 4, 4, 0))
    two = header((1, space(3, 3)), (3, kind), (11, struct.pack("<BB6xHHHHII", 1, 1, 1, 0, 1, 1, 6, 0)), (8, struct.pack("<BBBQIII", 3, 2, 3, tree, 2, 2, 4)))
    root = group([("data", one), ("sub", group([("chunked", two)]))])
    out[:96] = container.SIGNATURE + struct.pack("<BBBBBBBxHHIQQQQ", 0, 0, 0, 0, 0, 8, 8, 4, 16, 0, 0, 2**64 - 1, len(out), 2**64 - 1) + struct.pack("<QQII16x", 0, root, 0, 0)
    return bytes(out)


def test_old_format(tmp_path):
    path = tmp_path / "old.h5"
    for lead in (b"", bytes(512)):
        path.write_bytes(lead + old_file())
        c = container.open_container(str(path))
        assert set(c.datasets) == {"data", "sub/chunked"}
        want = np.arange(12).reshape(3, 4)
        assert (c.box(c.dataset("data"), (0, 0), (3, 4)) == want).all()
        assert (c.box(c.dataset("sub/chunked"), (0, 0), (3, 3)) == want[:, :3]).all()


def test_geometry():
    g = ix.Geometry(ix.EA_PARAMS)
    assert [n for _, n in g.direct_blocks()] == [16, 32, 32, 32, 64, 64]
    assert [n for _, n in ix.Geometry(ix.EA_PARAMS, paired=True).direct_blocks()] == [16, 16, 32, 32, 64, 64]


def test_fill_values(tmp_path):
    path = str(tmp_path / "fill.h5")
    b = bd.Builder(path)
    cell = np.arange(3, dtype="<i4").tobytes()
    b.chunked(bd.Spec("x", dt.integer(4), (7,), (None,), (3,), fill=np.int32(-5).tobytes()), {(1,): (b.put(cell), 12, 0)})
    b.contiguous(bd.Spec("none", dt.integer(4), (2,), fill=np.int32(9).tobytes()), None)
    b.contiguous(bd.Spec("zero", dt.integer(4), (2,)), None)
    b.finish()
    c = container.open_container(path)
    assert c.box(c.dataset("x"), (0,), (7,)).tolist() == [-5, -5, -5, 0, 1, 2, -5]
    assert c.read_rows(c.dataset("none"), 0, 2).tolist() == [9, 9]
    assert c.read_rows(c.dataset("zero"), 0, 2).tolist() == [0, 0]
    assert bd.Builder(path, append=True).spec_of("x")[0].fill == np.int32(-5).tobytes()
    for body in (b"\1\2\0\1\4\0\0\0abcd", b"\2\2\0\1\4\0\0\0abcd", b"\3\x23\4\0\0\0abcd"):
        assert ms.decode_fill(c.cursor(body)) == b"abcd"
    for body in (b"\1\2\0\0\0\0\0\0", b"\2\2\0\0", b"\2\2\0\1\0\0\0\0", b"\3\x03", b"\3\x13"):
        assert ms.decode_fill(c.cursor(body)) == b""
    with pytest.raises(errors.UnsupportedFeature):
        ms.decode_fill(c.cursor(b"\4\0"))
