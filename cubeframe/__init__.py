"""cubeframe: hierarchical array containers as Spark DataFrames."""

__version__ = "0.1.0"
