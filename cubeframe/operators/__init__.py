"""Array algebra on DataFrames and reading and writing of arrays."""

from cubeframe.operators.arrays import (
    axes_of,
    chunk_catalog,
    chunk_coordinates,
    explode_chunks,
    explode_frames,
    extend,
    from_linear,
    infer_shape,
    last_write_wins,
    linear_index,
    patch,
    read_array,
    slab,
    to_chunks,
    to_frames,
    write_array,
)
from cubeframe.operators.catalog import attributes, chunks, datasets, groups, links, register_tables

__all__ = [
    "attributes", "axes_of", "chunk_catalog", "chunk_coordinates", "chunks", "datasets", "explode_chunks", "explode_frames", "extend", "from_linear",
    "groups", "infer_shape", "last_write_wins", "linear_index", "links", "patch", "read_array", "register_tables", "slab", "to_chunks", "to_frames", "write_array",
]
