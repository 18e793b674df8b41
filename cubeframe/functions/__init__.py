"""Vectorised functions on binary columns: filters and checksums. Arrow batches, not rows."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

from cubeframe.codec import checksum
from cubeframe.filters import pipeline


def encode_filters(data: Column | str, text: str, element: int) -> Column:
    """Bytes through a pipeline such as ``shuffle,deflate:6``."""

    def run(x: pd.Series) -> pd.Series:
        return x.map(lambda v: None if v is None else pipeline(text, element, len(v)).encode(bytes(v)))

    return F.pandas_udf(run, "binary")(data)


def decode_filters(data: Column | str, size: Column | str, text: str, element: int) -> Column:
    """The inverse; ``size`` is the number of bytes before encoding."""

    def run(x: pd.Series, n: pd.Series) -> pd.Series:
        return pd.Series([None if v is None else pipeline(text, element, int(k)).decode(bytes(v), int(k)) for v, k in zip(x, n, strict=True)], dtype=object)

    return F.pandas_udf(run, "binary")(data, size)


def jenkins_lookup3(data: Column | str, seed: int = 0) -> Column:
    def run(x: pd.Series) -> pd.Series:
        return x.map(lambda v: None if v is None else checksum.lookup3(bytes(v), seed)).astype("Int64")

    return F.pandas_udf(run, "long")(data)


def fletcher32(data: Column | str) -> Column:
    def run(x: pd.Series) -> pd.Series:
        return x.map(lambda v: None if v is None else checksum.fletcher32(bytes(v))).astype("Int64")

    return F.pandas_udf(run, "long")(data)


def register(spark: SparkSession) -> None:
    """SQL functions jenkins_lookup3(binary) and fletcher32(binary)."""

    @F.pandas_udf("long")
    def lookup(x: pd.Series) -> pd.Series:
        return x.map(lambda v: None if v is None else checksum.lookup3(bytes(v))).astype("Int64")

    @F.pandas_udf("long")
    def fletcher(x: pd.Series) -> pd.Series:
        return x.map(lambda v: None if v is None else checksum.fletcher32(bytes(v))).astype("Int64")

    spark.udf.register("jenkins_lookup3", lookup)
    spark.udf.register("fletcher32", fletcher)
