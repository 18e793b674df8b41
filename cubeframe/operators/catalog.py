"""What a container holds, as DataFrames. The rows come from metadata that the driver reads."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.functions import udtf

from cubeframe.codec import datatype as dt
from cubeframe.codec import messages as ms
from cubeframe.codec.container import Container, open_container

_INDEX = {ms.SINGLE: "single", ms.IMPLICIT: "implicit", ms.FIXED: "fixed", ms.EXTENSIBLE: "extensible", ms.BTREE2: "btree2", ms.BTREE1: "btree1"}
DATASETS = "path string, type string, element_size int, rank int, shape array<bigint>, max_shape array<bigint>, cells bigint, layout string, chunk array<bigint>, is_chunked boolean, index string, filters string"


def type_name(t: dt.DType) -> str:
    if t.kind in ("int", "uint", "float"):
        return f"{'>' if t.big else ''}{ {'int': 'i', 'uint': 'u', 'float': 'f'}[t.kind]}{8 * t.size}"
    if t.is_bool:
        return "bool"
    if t.is_complex:
        return f"complex{4 * t.size}"
    return {"string": f"string:{t.size}", "vstring": "string"}.get(t.kind, t.kind)


def _rows(c: Container) -> Iterator[tuple]:
    for path, d in sorted(c.datasets.items()):
        chunked = d.layout.kind == "chunked"
        yield (path, type_name(d.type), d.type.size, d.rank, list(d.shape), list(d.max_shape), d.size, d.layout.kind, list(d.chunk) if chunked else None, chunked, _INDEX.get(d.layout.index) if chunked else None, ",".join(str(f.ident) for f in d.filters.filters))


def _frame(spark: SparkSession, rows: list[tuple], schema: str) -> DataFrame:
    return spark.createDataFrame(rows, schema)


def datasets(spark: SparkSession, path: str) -> DataFrame:
    return _frame(spark, list(_rows(open_container(path))), DATASETS)


def groups(spark: SparkSession, path: str) -> DataFrame:
    """Absolute paths; empty groups too."""
    return _frame(spark, [(f"/{g}",) for g in sorted(open_container(path).groups)], "path string")


def links(spark: SparkSession, path: str) -> DataFrame:
    """Soft and external links, and objects that can't be read with the reason."""
    c = open_container(path)
    return _frame(spark, [*c.links, *((p, "unreadable", why) for p, why in c.skipped.items())], "path string, kind string, target string")


def attributes(spark: SparkSession, path: str) -> DataFrame:
    """Attributes of the root, of groups and of datasets: (owner, name, str_value, num_value, raw)."""
    c, rows = open_container(path), []
    owners = [(f"/{g}", a) for g, a in c.group_attributes.items()] + [(f"/{p}", d.attributes) for p, d in c.datasets.items()]
    for owner, own in owners:
        for a in own:
            text = number = None
            if a.type.kind in ("string", "vstring"):
                values = dt.to_arrow(np.frombuffer(a.raw, dt.np_dtype(a.type)), a.type, c.strings).to_pylist()
                text = values[0] if values else None
            elif a.type.kind in ("int", "uint", "float") and len(a.raw) >= a.type.size:
                number = float(np.frombuffer(a.raw[: a.type.size], dt.np_dtype(a.type))[0])
            rows.append((owner, a.name, text, number, bytearray(a.raw)))
    return _frame(spark, rows, "owner string, name string, str_value string, num_value double, raw binary")


def chunks(spark: SparkSession, path: str, dataset: str) -> DataFrame:
    """Stored chunks: (chunk_coord, address, stored_bytes, mask, cells inside the shape)."""
    c = open_container(path)
    d = c.dataset(dataset)
    rows = []
    for at, (address, n, mask) in sorted(c.chunk_entries(d).items()) if d.layout.kind == "chunked" else ():
        inside = int(np.prod([max(0, min(k, m - a * k)) for a, k, m in zip(at, d.chunk, d.shape, strict=True)], dtype=object))
        rows.append((list(at), address, n, mask, inside))
    return _frame(spark, rows, "chunk_coord array<bigint>, address bigint, stored_bytes bigint, mask bigint, cells bigint")


def child_datasets(spark: SparkSession, path: str, group: str = "/") -> DataFrame:
    """Names of the datasets right in a group."""
    prefix = group.strip("/")
    own = datasets(spark, path).select("path")
    own = own.where(F.col("path").startswith(f"{prefix}/")).select(F.substring("path", len(prefix) + 2, 1 << 20).alias("name")) if prefix else own.select(F.col("path").alias("name"))
    return own.where(~F.col("name").contains("/"))


def child_groups(spark: SparkSession, path: str, group: str = "/") -> DataFrame:
    """Names of the groups right in a group."""
    prefix = group.strip("/")
    own = groups(spark, path).select(F.substring("path", 2, 1 << 20).alias("path")).where("path != ''")
    own = own.where(F.col("path").startswith(f"{prefix}/")).select(F.substring("path", len(prefix) + 2, 1 << 20).alias("name")) if prefix else own.select(F.col("path").alias("name"))
    return own.select(F.substring_index("name", "/", 1).alias("name")).distinct()


@udtf(returnType=DATASETS)
class H5Datasets:
    """SQL: SELECT * FROM h5_datasets('/data/a.h5')."""

    def eval(self, path: str) -> Iterator[Row]:
        yield from _rows(open_container(path))


def register_tables(spark: SparkSession) -> None:
    spark.udtf.register("h5_datasets", H5Datasets)
