"""Handles without Spark: the representative containers, mode and bounds errors, streams."""

import subprocess
import sys
import textwrap

import numpy as np
import pytest

from cubeframe import errors
from cubeframe.api import ArrayFile, StreamReader, StreamWriter
from cubeframe.codec.container import open_container


@pytest.fixture
def path(tmp_path):
    return str(tmp_path / "a.h5")


def test_empty(path):
    ArrayFile.create(path).close()
    with ArrayFile.open(path) as f:
        assert f.dataset_names() == [] and not f.is_writable
        with pytest.raises(errors.NotFound):
            f.dataset("x")


@pytest.mark.parametrize("kind", ["u8", "i8", "u16", "i16", "u32", "i32", "u64", "i64", "f32", "f64", ">f64"])
@pytest.mark.parametrize(("shape", "chunk", "filters"), [((2, 3), None, ""), ((8, 3), (1, 3), ""), ((100, 3), (1, 3), "deflate:6"), ((20, 4), (1, 4), "shuffle,deflate:6"), ((), None, ""), ((2, 3, 4), (2, 2, 3), "zstd:3")])
def test_round_trip(path, kind, shape, chunk, filters):
    want = np.arange(int(np.prod(shape))).reshape(shape) % 100
    with ArrayFile.create(path) as f:
        b = f.new_dataset(kind).shape(shape)
        if chunk:
            b = b.chunk(chunk).max_shape((None, *shape[1:])).filters(filters)
        d = b.create("data")
        d.write_raw(want)
        d.set_attr("units", "K")
        d.set_attr("scale", 1.5)
    with ArrayFile.open(path) as f:
        d = f.dataset("data")
        assert (d.read_raw() == want).all() and d.shape == shape and d.ndims == len(shape)
        assert (d.chunk_dims, d.is_chunked) == (chunk, bool(chunk))
        assert (d.attr("units"), d.attr("scale"), d.attr_names()) == ("K", 1.5, ["units", "scale"])
        assert d.total_elements == want.size and d.element_size == d.dtype.itemsize


def test_namespace(path):
    with ArrayFile.create(path) as f:
        f.set_attr("title", "Test File")
        f.set_attr("version", 42, "i32")
        f.new_dataset("i32").shape([3]).create("version").write_raw([1, 0, 0])
        det = f.create_group("detector")
        det.new_dataset("f32").shape([10]).create("temperature").write_raw(np.ones(10, "f4"))
        raw = det.create_group("raw")
        raw.new_dataset("u16").shape([4, 4]).create("image").write_raw(np.full((4, 4), 42))
        raw.write_strings("names", ["alice", "", "charlié"])
        f.create_group("empty")
        with pytest.raises(errors.InvalidState):
            f.create_group("detector")
        with pytest.raises(errors.NotFound):
            f.create_group("no/parent")
        with pytest.raises(errors.InvalidState):
            f.new_dataset("i8").shape([1]).create("version")
    with ArrayFile.open(path) as f:
        assert f.dataset_names() == ["detector/raw/image", "detector/raw/names", "detector/temperature", "version"]
        assert f.root_group().group_names() == ["detector", "empty"] and f.root_group().dataset_names() == ["version"]
        assert f.group("detector").group_names() == ["raw"] and f.group("detector/raw").name == "/detector/raw"
        assert f.dataset("/detector/raw/names").read_strings() == ["alice", "", "charlié"]
        assert (f.attr("title"), f.attr("version"), f.attr_names()) == ("Test File", 42, ["title", "version"])
        with pytest.raises(errors.NotFound):
            f.group("nothing")


@pytest.mark.parametrize(("chunk", "filters"), [(None, ""), ((2, 3), ""), ((2, 3), "deflate:6")])
def test_slices(path, chunk, filters):
    want = np.arange(20).reshape(4, 5)
    with ArrayFile.create(path) as f:
        b = f.new_dataset("i32").shape([4, 5])
        d = (b.chunk(chunk).filters(filters) if chunk else b).create("mat")
        d.write_raw(want)
        d.write_slice([1, 1], [2, 2], [10, 20, 30, 40])
        with pytest.raises(errors.OutOfBounds):
            d.write_slice([3, 3], [2, 2], [1, 2, 3, 4])
        with pytest.raises(errors.InvalidState):
            d.write_slice([0, 0], [2, 2], [1, 2, 3])
    want[1:3, 1:3] = [[10, 20], [30, 40]]
    with ArrayFile.open(path) as f:
        d = f.dataset("mat")
        assert (d.read_raw() == want).all()
        assert d.read_slice([1, 2], [2, 2]).tolist() == want[1:3, 2:4].tolist()
        assert d.read_slice([0, 0], [0, 5]).size == 0
        assert d.read_raw("f32").dtype == np.float32
        with pytest.raises(errors.TypeMismatch):
            d.read_raw("f64")
        if chunk:
            with pytest.raises(errors.InvalidState):
                d.memmap()
        else:
            assert (d.memmap() == want).all()
        with pytest.raises(errors.OutOfBounds):
            d.read_slice([1], [1])


def test_modes(path):
    with ArrayFile.create(path) as f:
        d = f.new_dataset("f64").shape([2]).create("x")
        for bad in ([1.0], ["a", "b"]):
            with pytest.raises((errors.ArrayError, ValueError)):
                d.write_raw(bad)
        with pytest.raises(errors.InvalidState):
            d.read_raw()
        with pytest.raises(errors.InvalidState):
            d.write_chunk(0, bytes(8))
        with pytest.raises(errors.InvalidState):
            f.new_dataset("f64").create("y")
        with pytest.raises(errors.InvalidState):
            f.new_dataset("f64").shape([2]).deflate(6).create("y")
        d.write_raw([1, 2])
    with ArrayFile.open(path) as f:
        for call in (lambda: f.new_dataset("i8").shape([1]).create("z"), lambda: f.dataset("x").write_raw([1, 2]), lambda: f.set_attr("a", 1)):
            with pytest.raises(errors.InvalidState):
                call()
    with pytest.raises(errors.NotFound):
        ArrayFile.open_rw(path + "x")


def test_places(path):
    ArrayFile.create(f"file://{path}").close()
    assert ArrayFile.open(f"file://{path}").dataset_names() == []
    with pytest.raises(errors.UnsupportedFeature):
        ArrayFile.create("s3://bucket/a.h5")


def test_chunks_grow_and_shrink(path):
    rows = np.arange(900 * 3).reshape(900, 3)
    with ArrayFile.create(path) as f:
        d = f.new_dataset("i32").shape([0, 3]).max_shape([None, 3]).chunk([1, 3]).deflate(6).create("s")
        d.write_chunks([(i, rows[i].astype("<i4").tobytes()) for i in range(600)])
        d.extend([600, 3])
        d.write_chunk((0, 0), np.zeros(3, "i4"))
        with pytest.raises(errors.InvalidState):
            d.write_chunk(0, b"1")
        with pytest.raises(errors.OutOfBounds):
            d.extend([5, 4])
        f.new_dataset("f64").shape([3, 4]).chunk([2, 3]).max_shape([9, 9]).create("fixed").write_raw(np.ones((3, 4)))
    with ArrayFile.open_rw(path) as f:  # a compressed dataset grows on reopening, and keeps its attributes
        d = f.dataset("s")
        d.set_attr("k", "v")
        for i in range(600, 900):
            d.write_chunk(i, rows[i].astype("i4"))
        d.extend([900, 3])
        f.dataset("fixed").extend([2, 9])
        f.new_dataset("f64").shape([2]).create("second").write_raw([4, 5])
    rows[0] = 0
    with ArrayFile.open(path) as f:
        assert (f.dataset("s").read_raw() == rows).all() and f.dataset("s").attr("k") == "v"
        assert f.dataset("fixed").read_raw().tolist() == [[1.0] * 4 + [0.0] * 5] * 2
        assert f.dataset("second").read_raw().tolist() == [4, 5]


def test_stream_between_processes(path):
    """A writer in another process; each refresh sees whole frames in order."""
    code = f"""
        import numpy as np, time
        from cubeframe.api import StreamWriter
        w = StreamWriter({path!r})
        w.create_streaming_dataset("detector", "u16", [4, 4])
        w.flush()
        print("go", flush=True)
        for i in range(120):
            w.append_frame("detector", np.full((4, 4), i))
            if i % 4 == 3:
                w.flush()
        w.close()
    """
    with subprocess.Popen([sys.executable, "-c", textwrap.dedent(code)], stdout=subprocess.PIPE, text=True, cwd=str(__import__("pathlib").Path(__file__).parent.parent)) as other:
        assert other.stdout.readline() == "go\n"
        seen, r = 0, StreamReader(path)
        while other.poll() is None or seen < 120:
            r.refresh()
            got = r.read_dataset("detector", seen)
            assert (got == np.arange(seen, seen + len(got))[:, None, None]).all()
            seen += len(got)
            assert seen % 4 == 0
    assert r.dataset_shape("detector") == (120, 4, 4) and r.dataset_names() == ["detector"]
    assert open_container(path).flags == 0
    w = StreamWriter(path)
    w.create_streaming_dataset("d", "i32", [2], "zstd:3")
    w.flush()
    assert open_container(path).flags == 5
    with pytest.raises(errors.InvalidState):
        w.append_frame("d", b"12")
    w.append_frame("d", np.array([1, 2]))
    w.close()
    assert StreamReader(path).read_dataset("d").tolist() == [[1, 2]]
