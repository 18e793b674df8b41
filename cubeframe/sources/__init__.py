"""Spark data sources over containers."""

from __future__ import annotations

from pyspark.sql import SparkSession


def register(spark: SparkSession) -> SparkSession:
    """Make ``format("h5")`` known to a session."""
    from cubeframe.sources.h5 import H5DataSource

    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(H5DataSource)
    return spark
