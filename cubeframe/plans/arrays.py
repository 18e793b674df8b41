"""Queries for every operator: arrays made from the tables, written to containers, read back, cut and changed."""

from __future__ import annotations

import os
import uuid
from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cubeframe import functions as FN
from cubeframe import operators as O
from cubeframe import streaming
from cubeframe.codec.container import local
from cubeframe.session import shared_dir
from cubeframe.sources import register

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

DIM = 64
LONG = "SELECT vec_id AS d0, CAST(i - 1 AS BIGINT) AS d1, embedding[i] AS value FROM embeddings, range(1, 65) t(i)"
EVENTS = "SELECT event_id AS d0, value FROM events"


def query(sql: str | None = None) -> Callable:
    def add(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def container(spark: SparkSession) -> str:
    folder = local(f"{shared_dir(register(spark))}/containers")
    os.makedirs(folder, exist_ok=True)
    return f"{folder}/{uuid.uuid4().hex}.h5"


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """emb/vectors: f32 [N, 64] in the long form."""
    own = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("d0"), F.posexplode("embedding").alias("d1", "value"))
    return own.select("d0", F.col("d1").cast("long").alias("d1"), "value")


def values(spark: SparkSession, sf_dir: str) -> DataFrame:
    """events/value: f64 [M]."""
    return table(spark, sf_dir, "events").select(F.col("event_id").alias("d0"), "value")


def stored(spark: SparkSession, df: DataFrame, dataset: str, form: str = "long", read: dict | None = None, **how: object) -> DataFrame:
    path = container(spark)
    O.write_array(df, path, dataset, mode="overwrite", **how)
    return O.read_array(spark, path, dataset, form, **(read or {}))


def chunked(spark: SparkSession, sf_dir: str, form: str = "long", filters: str = "", index: str = "", **how: object) -> DataFrame:
    options: dict = {"chunk": [128, 16], **({"filters": filters} if filters else {}), **({"index": index} if index else {}), **how}
    return stored(spark, vectors(spark, sf_dir), "emb/vectors", form, **options)


# --- sources and sinks --------------------------------------------------------------------


@query(LONG)
def scan_contiguous_long(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stored(spark, vectors(spark, sf_dir), "emb/vectors")


@query(EVENTS)
def sink_roundtrip_contiguous(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stored(spark, values(spark, sf_dir), "events/value")


@query(LONG)
def sink_roundtrip_chunked(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chunked(spark, sf_dir)


@query(LONG)
def scan_chunked_frame(spark: SparkSession, sf_dir: str) -> DataFrame:
    return O.explode_frames(chunked(spark, sf_dir, "frame"), 2)


@query(LONG)
def chunk_scatter_gather(spark: SparkSession, sf_dir: str) -> DataFrame:
    return O.explode_chunks(chunked(spark, sf_dir, "chunk"), 2)


@query(LONG)
def fixed_array_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chunked(spark, sf_dir, index="fixed", chunk=[100, 24])


@query(LONG)
def btree2_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chunked(spark, sf_dir, index="btree2", max_shape=[None, None], chunk=[10, 7])


@query(LONG)
def extensible_array_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chunked(spark, sf_dir, index="extensible", max_shape=[None, DIM], chunk=[1, 64])


@query("SELECT vec_id AS d0, CAST(i - 1 AS BIGINT) AS d1, embedding[i] AS value FROM embeddings, range(1, 65) t(i) UNION ALL SELECT vec_id + 1 + (SELECT max(vec_id) FROM embeddings), CAST(i - 1 AS BIGINT), embedding[i] FROM embeddings, range(1, 65) t(i) WHERE vec_id < 50")
def append_extend_chunked(spark: SparkSession, sf_dir: str) -> DataFrame:
    path, base = container(spark), vectors(spark, sf_dir)
    O.write_array(base, path, "emb/vectors", mode="overwrite", chunk=[128, 64], max_shape=[None, DIM], filters="shuffle,deflate:6")
    n = O.infer_shape(base).first()["shape"][0]
    O.write_array(base.where("d0 < 50").withColumn("d0", F.col("d0") + n), path, "emb/vectors", extend=True)
    return O.read_array(spark, path, "emb/vectors")


@query("SELECT 'first' AS name, event_id AS d0, value FROM events UNION ALL SELECT 'second', vec_id, CAST(label AS DOUBLE) FROM embeddings")
def append_dataset(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = container(spark)
    O.write_array(values(spark, sf_dir), path, "first", mode="overwrite")
    labels = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("d0"), F.col("label").alias("value"))
    O.write_array(labels, path, "second")
    both = [O.read_array(spark, path, n).select(F.lit(n).alias("name"), "d0", F.col("value").cast("double").alias("value")) for n in ("first", "second")]
    return both[0].unionByName(both[1])


@query("SELECT count(*) AS value FROM events")
def scalar_dataset(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stored(spark, table(spark, sf_dir, "events").agg(F.count("*").alias("value")), "n")


@query("SELECT doc_id AS d0, text AS value FROM documents")
def vlen_strings_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stored(spark, table(spark, sf_dir, "documents").select(F.col("doc_id").alias("d0"), F.col("text").alias("value")), "docs/text")


@query("SELECT event_id AS d0, epoch_us(ts) AS ts, user_id, value, event_type FROM events")
def compound_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "events").select(F.col("event_id").alias("d0"), F.unix_micros(F.col("ts").cast("timestamp")).alias("ts"), "user_id", "value", "event_type")
    return stored(spark, rows, "events/record", chunk=[1000], filters="zstd:3", read={"flatten": True})


@query("SELECT event_id AS d0, CAST(event_id % 256 AS SMALLINT) AS a, CAST(event_id % 65536 AS INTEGER) AS b, event_id AS c FROM events")
def cast_unsigned(spark: SparkSession, sf_dir: str) -> DataFrame:
    path, e = container(spark), table(spark, sf_dir, "events").select(F.col("event_id").alias("d0"))
    for name, kind, value in (("a", "u8", F.col("d0") % 256), ("b", "u16", F.col("d0") % 65536), ("c", "u64", F.col("d0"))):
        O.write_array(e.withColumn("value", value), path, name, dtype=kind)
    a, b, c = (O.read_array(spark, path, n, u64="long").withColumnRenamed("value", n) for n in "abc")
    return a.join(b, "d0").join(c, "d0")


@query("SELECT vec_id AS d0, label % 2 = 1 AS value FROM embeddings")
def bool_enum(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stored(spark, table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("d0"), (F.col("label") % 2 == 1).alias("value")), "odd")


@query("SELECT event_id AS d0, value AS r, -value AS i FROM events")
def complex_struct(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "events").select(F.col("event_id").alias("d0"), F.struct(F.col("value").alias("r"), (-F.col("value")).alias("i")).alias("value"))
    return stored(spark, rows, "z", dtype="complex64").select("d0", "value.r", "value.i")


# --- boxes and changes ------------------------------------------------------------------------


@query(f"SELECT * FROM ({EVENTS}) WHERE d0 >= 100 AND d0 < 350")
def hyperslab_read_1d(spark: SparkSession, sf_dir: str) -> DataFrame:
    return O.slab(stored(spark, values(spark, sf_dir), "events/value", chunk=[500]), [100], [250])


@query(f"SELECT * FROM ({LONG}) WHERE d0 BETWEEN 10 AND 19 AND d1 BETWEEN 5 AND 9")
def hyperslab_read_2d(spark: SparkSession, sf_dir: str) -> DataFrame:
    return O.slab(stored(spark, vectors(spark, sf_dir), "emb/vectors"), [10, 5], [10, 5])


@query(f"SELECT * FROM ({LONG}) WHERE d0 BETWEEN 100 AND 199 AND d1 BETWEEN 16 AND 31")
def hyperslab_chunk_pruning(spark: SparkSession, sf_dir: str) -> DataFrame:
    return O.slab(chunked(spark, sf_dir, filters="shuffle,deflate:6"), [100, 16], [100, 16])


@query(f"SELECT d0, d1, CASE WHEN d0 BETWEEN 20 AND 39 AND d1 BETWEEN 8 AND 11 THEN CAST(d0 + d1 AS FLOAT) ELSE value END AS value FROM ({LONG})")
def hyperslab_write_2d(spark: SparkSession, sf_dir: str) -> DataFrame:
    base = stored(spark, vectors(spark, sf_dir), "emb/vectors")
    update = O.slab(base, [20, 8], [20, 4]).select("d0", "d1", (F.col("d0") + F.col("d1")).cast("float").alias("value"))
    return stored(spark, O.patch(base, update), "emb/vectors")


@query(f"{LONG} UNION ALL SELECT CAST(r AS BIGINT), CAST(i - 1 AS BIGINT), CAST(0 AS FLOAT) FROM (SELECT unnest(range((SELECT max(vec_id) + 1 FROM embeddings), (SELECT max(vec_id) + 21 FROM embeddings))) AS r), range(1, 65) t(i)")
def extend_zero_fill(spark: SparkSession, sf_dir: str) -> DataFrame:
    base = vectors(spark, sf_dir)
    n = O.infer_shape(base).first()["shape"][0]
    return stored(spark, O.extend(base, [n, DIM], [n + 20, DIM]), "emb/vectors", chunk=[64, 64])


@query(f"SELECT max(d0) + 1 AS n0, max(d1) + 1 AS n1 FROM ({LONG})")
def infer_shape(spark: SparkSession, sf_dir: str) -> DataFrame:
    return O.infer_shape(vectors(spark, sf_dir)).select(F.col("shape")[0].alias("n0"), F.col("shape")[1].alias("n1"))


@query(f"SELECT d0, d1, d0 * 64 + d1 AS linear, value FROM ({LONG})")
def linear_index_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = table(spark, sf_dir, "embeddings").agg(F.max("vec_id")).first()[0] + 1
    flat = O.linear_index(vectors(spark, sf_dir), [n, DIM]).select("linear", "value")
    return O.from_linear(flat, [n, DIM]).select("d0", "d1", "linear", "value")


@query(f"SELECT d0, d1, d0 // 100 AS c0, d1 // 24 AS c1 FROM ({LONG})")
def chunk_coordinates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return O.chunk_coordinates(vectors(spark, sf_dir), [100, 24]).drop("value")


@query(f"SELECT d0 // 128 AS c0, d1 // 24 AS c1, count(*) AS cells FROM ({LONG}) GROUP BY ALL")
def chunk_catalog(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = container(spark)
    O.write_array(vectors(spark, sf_dir), path, "emb/vectors", mode="overwrite", chunk=[128, 24])
    own = O.chunks(spark, path, "emb/vectors")
    return own.select(F.col("chunk_coord")[0].alias("c0"), F.col("chunk_coord")[1].alias("c1"), "cells")


@query("SELECT user_id % 50 AS chunk, max(event_id) AS seq, arg_max(value, event_id) AS value FROM events GROUP BY 1")
def chunk_last_write_wins(spark: SparkSession, sf_dir: str) -> DataFrame:
    writes = table(spark, sf_dir, "events").select((F.col("user_id") % 50).alias("chunk"), F.col("event_id").alias("seq"), "value")
    return O.last_write_wins(writes, ["chunk"], "seq")


# --- namespace ----------------------------------------------------------------------------------


def _library(spark: SparkSession, sf_dir: str) -> str:
    path = container(spark)
    O.write_array(vectors(spark, sf_dir), path, "emb/vectors", mode="overwrite", chunk=[128, 16], attributes={"units": "none", "scale": 3})
    O.write_array(values(spark, sf_dir), path, "events/value", attributes={"units": "EUR"})
    O.write_array(table(spark, sf_dir, "region").select(F.col("r_regionkey").cast("long").alias("d0"), F.col("r_name").alias("value")), path, "geo/names/region")
    return path


@query("SELECT 'emb/vectors' AS path, 'f32' AS type, 2 AS rank, count(*) * 64 AS cells, true AS is_chunked FROM embeddings UNION ALL SELECT 'events/value', 'f64', 1, count(*), false FROM events UNION ALL SELECT 'geo/names/region', 'string', 1, count(*), false FROM region")
def dataset_catalog(spark: SparkSession, sf_dir: str) -> DataFrame:
    return O.datasets(spark, _library(spark, sf_dir)).select("path", "type", "rank", "cells", "is_chunked")


@query("SELECT 'vectors' AS name")
def group_child_datasets(spark: SparkSession, sf_dir: str) -> DataFrame:
    from cubeframe.operators.catalog import child_datasets

    return child_datasets(spark, _library(spark, sf_dir), "/emb")


@query("SELECT unnest(['emb', 'events', 'geo']) AS name")
def group_child_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    from cubeframe.operators.catalog import child_groups

    return child_groups(spark, _library(spark, sf_dir))


@query("SELECT '/emb/vectors' AS owner, 'units' AS name, 'none' AS str_value, CAST(NULL AS DOUBLE) AS num_value UNION ALL SELECT '/emb/vectors', 'scale', NULL, 3.0 UNION ALL SELECT '/events/value', 'units', 'EUR', NULL")
def attribute_catalog(spark: SparkSession, sf_dir: str) -> DataFrame:
    return O.attributes(spark, _library(spark, sf_dir)).drop("raw")


# --- filters ----------------------------------------------------------------------------------------


def _filtered(name: str, text: str, idents: str) -> None:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        """The cells, the filters that the container names, and whether no chunk is stored in its raw size."""
        path = container(spark)
        O.write_array(vectors(spark, sf_dir), path, "emb/vectors", mode="overwrite", chunk=[128, 16], filters=text)
        names = O.datasets(spark, path).first()["filters"]
        coded = O.chunks(spark, path, "emb/vectors").agg(F.bool_and(F.col("stored_bytes") != 128 * 16 * 4)).first()[0]
        return O.read_array(spark, path, "emb/vectors").select("d0", "d1", "value", F.lit(names).alias("filters"), F.lit(coded).alias("coded"))

    run.__name__ = f"filter_{name}_roundtrip"
    query(f"SELECT d0, d1, value, '{idents}' AS filters, true AS coded FROM ({LONG})")(run)


for _name, _text, _idents in (
    ("deflate", "deflate:6", "1"), ("shuffle_deflate", "shuffle,deflate:6", "2,1"), ("zstd", "zstd:3", "32015"), ("bzip2", "bzip2:9", "307"), ("lzf", "lzf", "32000"), ("lz4", "lz4", "32004"),
    ("bitshuffle", "bitshuffle", "32008"), ("blosc", "blosc:5", "32001"), ("blosclz", "blosc:0", "32001"), ("szip", "szip", "4"), ("checked", "shuffle,lz4,fletcher32", "2,32004,3"),
):
    _filtered(_name, _text, _idents)


def _eight(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select("event_id", F.lpad(F.col("event_id").cast("string"), 8, "0").alias("s"))


@query("SELECT event_id, concat(s[1], s[5], s[2], s[6], s[3], s[7], s[4], s[8]) AS shuffled FROM (SELECT event_id, lpad(CAST(event_id AS VARCHAR), 8, '0') AS s FROM events)")
def filter_shuffle_bytes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _eight(spark, sf_dir).select("event_id", FN.encode_filters(F.col("s").cast("binary"), "shuffle:4", 4).cast("string").alias("shuffled"))


@query("""SELECT event_id, CAST((CAST(4 * w1 + 3 * w2 + 2 * w3 + w4 - 1 AS BIGINT) % 65535 + 1) * 65536 + (w1 + w2 + w3 + w4 - 1) % 65535 + 1 AS BIGINT) AS checksum
FROM (SELECT event_id, 256 * ascii(s[1]) + ascii(s[2]) AS w1, 256 * ascii(s[3]) + ascii(s[4]) AS w2, 256 * ascii(s[5]) + ascii(s[6]) AS w3, 256 * ascii(s[7]) + ascii(s[8]) AS w4
  FROM (SELECT event_id, lpad(CAST(event_id AS VARCHAR), 8, '0') AS s FROM events))""")
def filter_fletcher32(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _eight(spark, sf_dir).select("event_id", FN.fletcher32(F.col("s").cast("binary")).alias("checksum"))


def _lookup3_sql() -> str:
    """The published hash of eight bytes, which are its last block: one column for each step of the final mixing."""
    word = lambda k: " + ".join(f"ascii(s[{k + i + 1}]) * {256**i}" for i in range(4))
    low, steps = 1 << 32, [f"SELECT event_id, ({0xDEADBEEF + 8} + {word(0)}) % {1 << 32} AS a, ({0xDEADBEEF + 8} + {word(4)}) % {1 << 32} AS b, CAST({0xDEADBEEF + 8} AS BIGINT) AS c FROM (SELECT event_id, lpad(CAST(event_id AS VARCHAR), 8, '0') AS s FROM events)"]
    for x, y, shift in (("c", "b", 14), ("a", "c", 11), ("b", "a", 25), ("c", "b", 16), ("a", "c", 4), ("b", "a", 14), ("c", "b", 24)):
        turned = f"({y} * {1 << shift} % {low} + {y} // {1 << 32 - shift})"
        kept = ", ".join(v for v in "abc" if v != x)
        steps.append(f"SELECT event_id, {kept}, (xor({x}, {y}) + {low} - {turned}) % {low} AS {x} FROM ({steps[-1]})")
    return f"SELECT event_id, c AS checksum FROM ({steps[-1]})"


@query(_lookup3_sql())
def checksum_lookup3(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _eight(spark, sf_dir).select("event_id", FN.jenkins_lookup3(F.col("s").cast("binary")).alias("checksum"))


def _lossy(spark: SparkSession, sf_dir: str, text: str) -> DataFrame:
    """The bits of each value as the filter leaves them, after a container."""
    made = stored(spark, values(spark, sf_dir), "events/value", chunk=[1000], filters=text)
    bits = F.pandas_udf(lambda x: pd.Series(x.to_numpy(np.float64).view(np.int64)), "long")
    return made.select(F.col("d0").alias("event_id"), bits("value").alias("bits"))


# 3 digits need 11 bits of the mantissa's 52; of the other 41 even places are cleared, odd ones set
@query(f"SELECT event_id, CASE WHEN value = 0 THEN bits WHEN event_id % 2 = 0 THEN bits - bits % {1 << 41} ELSE bits - bits % {1 << 41} + {(1 << 41) - 1} END AS bits FROM (SELECT event_id, value, CAST(CAST(value AS BIT) AS BIGINT) AS bits FROM events)")
def filter_bitgroom(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _lossy(spark, sf_dir, "bitgroom:3")


# m 2^e with m in [1/2, 1): the bits that 4 digits of this value need, the others rounded off
@query("""SELECT event_id, CASE WHEN value = 0 THEN bits ELSE (bits + (1::BIGINT << (51 - need))) // (1::BIGINT << (52 - need)) * (1::BIGINT << (52 - need)) END AS bits
FROM (SELECT *, CAST(greatest(abs(floor(e - log2(10) * lm) - floor((floor(e / log2(10) + lm) + 1 - 4) * log2(10))) - 1, 0) AS BIGINT) AS need
  FROM (SELECT *, log10(abs(value) / power(2, e)) AS lm FROM (SELECT event_id, value, bits, bits // 4503599627370496 % 2048 - 1022 AS e FROM (SELECT event_id, value, CAST(CAST(value AS BIT) AS BIGINT) AS bits FROM events))))""")
def filter_bitround(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _lossy(spark, sf_dir, "bitround:4")


# --- streams -----------------------------------------------------------------------------------------


def _streamed(spark: SparkSession, sf_dir: str) -> str:
    """events/value appended as frames by a stream over the table's file."""
    path = container(spark)
    source = f"{path}.source"
    table(spark, sf_dir, "events").select(F.col("event_id").alias("seq"), "value").write.parquet(source)
    frames = spark.readStream.schema("seq long, value double").parquet(source)
    streaming.append_frames(frames, path, "events/value", f"{path}.checkpoint", chunk="1000").awaitTermination()
    return path


@query(EVENTS)
def stream_append_frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    return O.read_array(spark, _streamed(spark, sf_dir), "events/value")


@query(EVENTS)
def stream_read_frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = _streamed(spark, sf_dir)
    follow = streaming.read_frames(spark, path, "events/value")
    out = f"{path}.followed"
    follow.writeStream.format("parquet").option("path", out).option("checkpointLocation", f"{path}.follower").trigger(availableNow=True).start().awaitTermination()
    return spark.read.parquet(out)


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vectors through a compressed container, a pruned box of them, and the mean per label."""
    box = O.slab(chunked(spark, sf_dir, filters="shuffle,deflate:6"), [0, 0], [200, 16])
    labels = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("d0"), "label")
    return box.join(labels, "d0").groupBy("label").agg(F.avg("value").alias("mean"), F.count("*").alias("cells")).orderBy("label")
