"""The data source, operators, catalogs and streams through Spark."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from cubeframe import errors, streaming
from cubeframe import functions as FN
from cubeframe import operators as O
from cubeframe.operators import catalog


@pytest.fixture
def long(spark):
    return spark.range(13 * 7).select((F.col("id").cast("int") / 7).cast("long").alias("d0"), (F.col("id") % 7).alias("d1"), (F.col("id") * 1.5).alias("value"))


def same(a, b):
    key = lambda r: tuple(map(str, r))
    return sorted(map(tuple, a.select(*b.columns).collect()), key=key) == sorted(map(tuple, b.collect()), key=key)


@pytest.mark.parametrize("how", [{}, {"chunk": [4, 3]}, {"chunk": [4, 3], "filters": "shuffle,deflate:6", "index": "fixed"}, {"chunk": [20, 20], "index": "single", "filters": "zstd"}, {"chunk": [2, 2], "index": "btree2", "max_shape": [None, None]}, {"chunk": [1, 7], "max_shape": [None, 7]}])
def test_round_trip(spark, tmp_path, long, how):
    path = str(tmp_path / "a.h5")
    O.write_array(long, path, "g/x", mode="overwrite", **how)
    assert same(O.read_array(spark, path, "g/x"), long)
    assert same(O.explode_frames(O.read_array(spark, path, "g/x", "frame"), 2), long)
    assert same(O.explode_chunks(O.read_array(spark, path, "g/x", "chunk"), 2), long)
    box = O.slab(O.read_array(spark, path, "g/x", target_bytes=100), [3, 2], [5, 4], [13, 7])
    assert same(box, long.where("d0 >= 3 AND d0 < 8 AND d1 >= 2 AND d1 < 6"))
    d = O.datasets(spark, path).first()
    assert (d.path, d.type, d.shape, d.is_chunked) == ("g/x", "f64", [13, 7], bool(how))


def test_boxes_prune(spark, tmp_path, long):
    path = str(tmp_path / "a.h5")
    O.write_array(long, path, "x", mode="overwrite", chunk=[1, 7])
    whole = O.read_array(spark, path, "x", target_bytes=1)
    assert whole.rdd.getNumPartitions() == 13
    assert O.slab(whole, [2, 0], [3, 7]).rdd.getNumPartitions() == 3
    # one DataFrame cut twice in a query: each cut has its own plan
    assert O.slab(whole, [0, 0], [1, 7]).union(O.slab(whole, [5, 0], [2, 7])).count() == 21
    assert whole.where("d0 < 2").union(whole.where("d0 > 10")).count() == 28
    pushed = O.read_array(spark, path, "x", target_bytes=1, pushdown=True)
    assert pushed.where("d0 IN (3, 4)").count() == 14
    with pytest.raises(errors.OutOfBounds):
        O.slab(whole, [0], [1])
    with pytest.raises(errors.OutOfBounds):
        O.slab(whole, [0, 5], [1, 3], [13, 7])
    with pytest.raises(errors.OutOfBounds):
        O.slab(whole, [0, 5], [1, 3])  # by the shape that the container states


def test_sparse_and_double_cells(spark, tmp_path, long):
    path = str(tmp_path / "a.h5")
    O.write_array(long.where("d1 <> 3"), path, "x", mode="overwrite", chunk=[5, 5], shape=[13, 7])
    assert O.read_array(spark, path, "x").where("d1 = 3").agg(F.sum("value"), F.count("*")).first()[:] == (0.0, 13)
    with pytest.raises(Exception, match="given twice"):
        O.write_array(long.union(long.limit(1)), path, "y", chunk=[5, 5], shape=[13, 7])
    with pytest.raises(Exception, match="nulls"):
        O.write_array(long.withColumn("value", F.when(F.col("d0") > 3, F.col("value"))), path, "y", shape=[13, 7])
    O.write_array(long.withColumn("value", F.when(F.col("d0") > 3, F.col("value"))), path, "y", shape=[13, 7], null_value="-1")
    assert O.read_array(spark, path, "y").where("value = -1").count() == 28
    with pytest.raises(Exception, match="exists"):
        O.write_array(long, path, "y", shape=[13, 7])
    # rows that were not dealt out by chunk meet at commit
    long.repartition(5).write.format("h5").option("path", path).option("dataset", "z").option("chunk", "5,5").option("filters", "lz4").mode("append").save()
    assert same(O.read_array(spark, path, "z"), long)


def test_grow(spark, tmp_path, long):
    path = str(tmp_path / "a.h5")
    O.write_array(long, path, "x", mode="overwrite", chunk=[4, 7], max_shape=[None, 7], filters="deflate:6", attributes={"units": "K"})
    more = long.withColumn("d0", F.col("d0") + 13)
    O.write_array(more, path, "x", extend=True)
    assert same(O.read_array(spark, path, "x"), long.union(more))
    assert O.attributes(spark, path).first().str_value == "K"
    with pytest.raises(Exception, match="given twice"):
        O.write_array(long, path, "x", extend=True)


def test_types(spark, tmp_path):
    path = str(tmp_path / "a.h5")
    rows = spark.range(20).select(F.col("id").alias("d0"), F.concat(F.lit("é"), F.col("id").cast("string")).alias("s"), (F.col("id") % 2 == 0).alias("b"), (F.col("id") / 4).cast("float").alias("f"))
    for how in ({}, {"chunk": [6], "filters": "zstd"}):
        O.write_array(rows, path, "r", mode="overwrite", **how)
        assert same(O.read_array(spark, path, "r", flatten=True), rows)
        assert O.read_array(spark, path, "r", fields="s,f").schema["value"].dataType.names == ["s", "f"]
    O.write_array(rows.select("d0", F.col("d0").alias("value")), path, "u", dtype="u64")
    assert O.read_array(spark, path, "u").schema["value"].dataType.simpleString() == "decimal(20,0)"
    with pytest.raises(Exception, match="does not fit"):
        O.write_array(rows.select("d0", (F.col("d0") + 250).alias("value")), path, "v", dtype="u8")
    O.write_array(spark.sql("SELECT 2.5D AS value"), path, "pi")
    assert [tuple(r) for r in O.read_array(spark, path, "pi").collect()] == [(2.5,)]
    empty = rows.where("false").select("d0", F.col("f").alias("value"))
    O.write_array(empty, path, "none", shape=[0])
    assert O.read_array(spark, path, "none").count() == 0


def test_array_algebra(spark, long):
    assert same(O.from_linear(O.linear_index(long, [13, 7]).drop("d0", "d1"), [13, 7]).select("d0", "d1", "value"), long)
    assert same(O.explode_chunks(O.to_chunks(long, [4, 3], [13, 7]), 2), long)
    assert same(O.explode_frames(O.to_frames(long, [13, 7]), 2), long)
    assert O.infer_shape(long).first().shape == [13, 7]
    grown = O.extend(long, [13, 7], [15, 9])
    assert grown.count() == 135
    assert grown.where("d0 >= 13 OR d1 >= 7").agg(F.sum("value")).first()[0] == 0
    assert O.extend(long, [13, 7], [2, 9]).count() == 18
    fixed = O.patch(long, long.where("d0 = 1").withColumn("value", F.lit(-1.0)))
    assert same(fixed, long.withColumn("value", F.when(F.col("d0") == 1, -1.0).otherwise(F.col("value"))))
    assert O.chunk_catalog(long, [4, 3]).agg(F.sum("cells"), F.count("*")).first()[:] == (91, 12)
    cube = spark.range(24).select("id", F.col("id").alias("linear"), F.col("id").alias("value"))
    cube = O.from_linear(cube, [2, 3, 4]).select("d0", "d1", "d2", "value")
    assert same(O.explode_frames(O.to_frames(cube, [2, 3, 4]), 3), cube)
    kept = O.last_write_wins(long.withColumn("k", F.col("d1") % 2), ["k"], "value")
    assert sorted((r.k, r.value) for r in kept.collect()) == [(0, 135.0), (1, 133.5)]


def test_namespace(spark, tmp_path, long):
    path = str(tmp_path / "a.h5")
    for name in ("sensors/accel/xyz", "sensors/temp", "top"):
        O.write_array(long, path, name, shape=[13, 7])
    assert {r.path for r in O.groups(spark, path).collect()} == {"/", "/sensors", "/sensors/accel"}
    assert [r.name for r in catalog.child_groups(spark, path, "/sensors").collect()] == ["accel"]
    assert [r.name for r in catalog.child_datasets(spark, path, "sensors").collect()] == ["temp"]
    assert [r.name for r in catalog.child_datasets(spark, path).collect()] == ["top"]
    O.register_tables(spark)
    assert spark.sql(f"SELECT count(*) FROM h5_datasets('{path}')").first()[0] == 3


def test_functions(spark):
    df = spark.createDataFrame([(bytearray(b"Hello"),), (None,), (bytearray(b""),)], "b binary")
    assert [r[0] for r in df.select(FN.jenkins_lookup3("b")).collect()] == [0xC7BC405B, None, 0xDEADBEEF]
    made = df.select("b", FN.encode_filters("b", "shuffle,deflate:6", 1).alias("e")).select("b", FN.decode_filters("e", F.coalesce(F.length("b"), F.lit(0)), "shuffle,deflate:6", 1).alias("d"))
    assert all(r.b == r.d for r in made.collect())


def test_streams(spark, tmp_path):
    path, source = str(tmp_path / "f.h5"), str(tmp_path / "in")
    for k in range(3):
        spark.range(k * 50, k * 50 + 50, 1, 2).select(F.col("id").alias("seq"), F.array(F.col("id"), F.col("id") * 2).alias("value")).write.mode("append").parquet(source)
        stream = spark.readStream.schema("seq long, value array<long>").parquet(source)
        streaming.append_frames(stream, path, "s", str(tmp_path / "ck")).awaitTermination()
        follow = streaming.read_frames(spark, path, "s").writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "ck2")).trigger(availableNow=True).start()
        follow.awaitTermination()
        got = spark.read.parquet(str(tmp_path / "out")).orderBy("d0").collect()
        assert [(r.d0, r.value) for r in got] == [(i, [i, 2 * i]) for i in range(50 * (k + 1))]
    assert np.prod(O.datasets(spark, path).first().shape) == 300


def _batches(texts, n, compound=False, step=500):
    import pyarrow as pa

    for at in range(0, n, step):
        d0 = pa.array(range(at, min(n, at + step)))
        own = pa.array([texts(i) for i in range(at, min(n, at + step))])
        yield pa.RecordBatch.from_arrays([d0, d0, own], names=["d0", "id", "name"]) if compound else pa.RecordBatch.from_arrays([d0, own], names=["d0", "value"])


@pytest.mark.parametrize("chunk", ["", "3000"])
def test_strings_are_streamed(tmp_path, chunk):
    """24 MB of texts, one of them of 6 MB, pass a writing and a reading task of far less; runs of rows are small, batches bounded by bytes."""
    import tracemalloc

    from pyspark.sql import types as T

    from cubeframe.sources import h5

    n = 9000
    texts = lambda i: f"{i} é" * (800_000 if i == 4321 else 1 if i % 7 == 0 else 300) if i % 11 else ""
    options = {"path": str(tmp_path / "a.h5"), "dataset": "x", "shape": str(n), **({"chunk": chunk} if chunk else {})}
    schema = T.StructType().add("d0", "long").add("value", "string")
    writer = h5.ArrayWriter(options, schema, True)
    tracemalloc.start()
    made = writer.write(_batches(texts, n // 3))
    assert tracemalloc.get_traced_memory()[1] < 6 << 20
    tracemalloc.stop()
    rest = [b.slice(0) for b in _batches(texts, n) if b.column(0)[0].as_py() >= n // 3]
    writer.commit([made, writer.write(iter(rest[1::2])), writer.write(iter(rest[::2]))])
    reader = h5.BoxReader(options | {"target_bytes": str(4 << 20)}, schema, {"form": "long", "u64": "decimal", "enums": "name"})
    pieces = reader.partitions()
    assert len(pieces) >= 3
    found = {}
    for piece in pieces:
        for batch in reader.read(piece):
            assert batch.num_rows == 1 or batch.nbytes < 5 << 20
            found |= dict(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True))
    assert found == {i: texts(i) for i in range(n)}


def test_compound_strings_are_bounded(tmp_path):
    """Chunks dealt to several tasks: a reader keeps few bytes of collections, and reads each of them few times over."""
    import tracemalloc

    from pyspark.sql import types as T

    from cubeframe.codec import container
    from cubeframe.sources import h5

    n, tasks = 60_000, 80
    texts = lambda i: f"{i % 9973} click" * (40 if i % 3 else 0)
    options = {"path": str(tmp_path / "a.h5"), "dataset": "x", "shape": str(n), "chunk": "100", "filters": "zstd:3"}
    schema = T.StructType().add("d0", "long").add("id", "long").add("name", "string")
    writer = h5.ArrayWriter(options, schema, True)
    batches = list(_batches(texts, n, True, 100))
    writer.commit([writer.write(iter(batches[k::tasks])) for k in range(tasks)])
    reader = h5.BoxReader(options, schema, {"form": "long", "u64": "decimal", "enums": "name"})
    read, own = [], container.File.read

    def counted(self, at, size):
        read.append(size)
        return own(self, at, size)

    container.File.read = counted
    try:
        tracemalloc.start()
        rows = 0
        for piece in reader.partitions():
            for batch in reader.read(piece):
                d0 = batch.column(0).to_pylist()
                assert batch.column(2).to_pylist() == [texts(i) for i in d0] and batch.column(1).to_pylist() == d0
                rows += len(d0)
        assert rows == n
        assert tracemalloc.get_traced_memory()[1] < 13 << 20
    finally:
        tracemalloc.stop()
        container.File.read = own
    assert sum(read) < 2 * (tmp_path / "a.h5").stat().st_size
