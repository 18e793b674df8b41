"""Arrays as DataFrames of cells (d0, d1, ..., value): boxes, patches, chunks, frames, extension.

All of it is plain column expressions, joins and aggregates, so Catalyst sees and optimises it.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cubeframe.codec.container import open_container
from cubeframe.errors import InvalidState, OutOfBounds
from cubeframe.sources import register


def axes_of(df: DataFrame) -> list[str]:
    return sorted((c for c in df.columns if c[:1] == "d" and c[1:].isdigit()), key=lambda c: int(c[1:]))


# --- boxes -------------------------------------------------------------------------------


def slab(df: DataFrame, starts: Sequence[int], counts: Sequence[int], shape: Sequence[int] | None = None) -> DataFrame:
    """Cells of the box [start, start + count) on each axis. Rank and bounds are checked at once:
    bounds by ``shape`` or, of an array that ``read_array`` gave, by its own; of such a one, only
    chunks that the box touches are read."""
    axes = axes_of(df)
    if len(starts) != len(axes) or len(counts) != len(axes):
        raise OutOfBounds(f"a box of rank {len(starts)} for axes {axes}")
    if any(s < 0 or n < 0 for s, n in zip(starts, counts, strict=True)):
        raise OutOfBounds("negative start or count")
    source = getattr(df, "_cubeframe_source", None)
    if shape is None and source:
        c = open_container(source[0], source[3].get("paired") in (True, "true"))
        shape = c.dataset(source[1]).shape
        c.file.close()
    if shape is not None and any(s + n > m for s, n, m in zip(starts, counts, shape, strict=True)):
        raise OutOfBounds(f"{tuple(starts)} + {tuple(counts)} beyond {tuple(shape)}")
    if source:
        path, dataset, form, options = source
        if "box" not in options:
            df = read_array(df.sparkSession, path, dataset, form, **options, box=",".join(f"{s}:{s + n}" for s, n in zip(starts, counts, strict=True)))
    for a, s, n in zip(axes, starts, counts, strict=True):
        df = df.where((F.col(a) >= F.lit(s)) & (F.col(a) < F.lit(s + n)))
    return df


def patch(base: DataFrame, update: DataFrame) -> DataFrame:
    """``base`` with the values of ``update`` where it has a cell; cells of ``update`` that ``base``
    lacks are ignored. An equality join on all axes; AQE broadcasts or splits it as sizes ask."""
    axes = axes_of(base)
    if axes_of(update) != axes:
        raise OutOfBounds(f"axes {axes_of(update)} for {axes}")
    new = update.select(*axes, F.col("value").alias("__new"), F.lit(True).alias("__hit"))
    value = F.when(F.col("__hit"), F.col("__new")).otherwise(F.col("value"))
    return base.join(new, axes, "left").select(*axes, value.alias("value"))


def grid(spark: SparkSession, shape: Sequence[int]) -> DataFrame:
    """All cells of a shape, by a range over the linear index."""
    n = int(np.prod(shape, dtype=object))
    return from_linear(spark.range(n).select(F.col("id").alias("linear")), shape).drop("linear")


def extend(df: DataFrame, old_shape: Sequence[int], new_shape: Sequence[int]) -> DataFrame:
    """The array at a new shape: cells beyond the old one are zero, cells beyond the new one go.
    Only the cells that are new are made; the old ones pass without a join."""
    axes = axes_of(df)
    for a, n in zip(axes, new_shape, strict=True):
        df = df.where(F.col(a) < n)
    zero = F.lit(0).cast(df.schema["value"].dataType)
    parts = df
    for i in range(len(axes)):
        # cells beyond the old extent on axis i, within it on the axes before
        low = [0] * len(axes)
        low[i] = min(old_shape[i], new_shape[i])
        size = [min(o, n) if k < i else n for k, (o, n) in enumerate(zip(old_shape, new_shape, strict=True))]
        size[i] = new_shape[i] - low[i]
        if min(size) > 0:
            block = grid(df.sparkSession, size)
            parts = parts.unionByName(block.select(*[(F.col(a) + lo).alias(a) for a, lo in zip(axes, low, strict=True)], zero.alias("value")))
    return parts


def infer_shape(df: DataFrame) -> DataFrame:
    """One row (shape): one more than the largest coordinate of each axis; zeros for an empty array."""
    return df.agg(F.array(*[F.coalesce(F.max(a) + 1, F.lit(0)).cast("long") for a in axes_of(df)]).alias("shape"))


# --- indices ---------------------------------------------------------------------------------


def strides(shape: Sequence[int]) -> list[int]:
    return [int(np.prod(shape[i + 1 :], dtype=object)) for i in range(len(shape))]


def linear_index(df: DataFrame, shape: Sequence[int], name: str = "linear") -> DataFrame:
    """Row-major number of each cell."""
    return df.withColumn(name, sum((F.col(a) * F.lit(s).cast("long") for a, s in zip(axes_of(df), strides(shape), strict=True)), F.lit(0).cast("long")))


def from_linear(df: DataFrame, shape: Sequence[int], name: str = "linear") -> DataFrame:
    """Coordinates of row-major numbers."""
    out = {}
    for i, (n, s) in enumerate(zip(shape, strides(shape), strict=True)):
        out[f"d{i}"] = F.expr(f"CAST({name} div {s} % {n} AS BIGINT)")
    return df.withColumns(out)


def chunk_coordinates(df: DataFrame, chunk: Sequence[int]) -> DataFrame:
    """c0, c1, ...: the chunk that each cell is in."""
    return df.withColumns({f"c{a[1:]}": F.expr(f"{a} div {k}") for a, k in zip(axes_of(df), chunk, strict=True)})


def chunk_catalog(df: DataFrame, chunk: Sequence[int]) -> DataFrame:
    """Cells that each chunk holds, fewer at the edges; partial counts before the shuffle."""
    keys = [f"c{a[1:]}" for a in axes_of(df)]
    return chunk_coordinates(df, chunk).groupBy(*keys).agg(F.count("*").alias("cells"))


def last_write_wins(df: DataFrame, keys: Sequence[str], order: Column | str) -> DataFrame:
    """Of several writes of a key the one with the largest ``order``, by a partial aggregate rather than a window."""
    rest = [c for c in df.columns if c not in keys]
    kept = df.groupBy(*keys).agg(F.max_by(F.struct(*rest), order if isinstance(order, Column) else F.col(order)).alias("__kept"))
    return kept.select(*keys, "__kept.*").select(*df.columns)


# --- forms ------------------------------------------------------------------------------------------


def to_frames(df: DataFrame, shape: Sequence[int]) -> DataFrame:
    """Long form to one row (d0, value array<...>) per leading index; cells that are missing are zero.
    A frame is one output row, so its cells meet in one task; frames don't meet each other."""
    axes, kind = axes_of(df), df.schema["value"].dataType
    inner = list(shape[1:])
    n = int(np.prod(inner, dtype=object))
    own = linear_index(df.select(*[F.col(a).alias(f"d{i}") for i, a in enumerate(axes[1:])], F.col(axes[0]).alias("__d0"), "value"), inner)
    frames = own.groupBy(F.col("__d0").alias("d0")).agg(F.map_from_entries(F.collect_list(F.struct(F.col("linear").cast("int"), "value"))).alias("m"))
    flat = F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda i: F.coalesce(F.element_at("m", i), F.lit(0).cast(kind)))
    for size in reversed(inner[1:]):
        flat = _nested(flat, size)
    return frames.select("d0", flat.alias("value"))


def _nested(flat: Column, size: int) -> Column:
    """An array cut into arrays of ``size``."""
    return F.transform(F.sequence(F.lit(0), (F.size(flat) / size).cast("int") - 1), lambda i: F.slice(flat, i * size + 1, size))


def explode_frames(df: DataFrame, rank: int) -> DataFrame:
    """Frames back to the long form, by posexplode."""
    for i in range(1, rank):
        axes = [f"d{k}" for k in range(i)]
        df = df.select(*axes, F.posexplode("value").alias(f"d{i}", "value")).withColumn(f"d{i}", F.col(f"d{i}").cast("long"))
    return df


def to_chunks(df: DataFrame, chunk: Sequence[int], shape: Sequence[int]) -> DataFrame:
    """Long form to one row per chunk: chunk_coord, chunk_offset, chunk_shape, data (row-major,
    clipped at the edges, zero where a cell is missing). A chunk's size is bounded by ``chunk``."""
    axes, kind = axes_of(df), df.schema["value"].dataType
    coords = [f"c{a[1:]}" for a in axes]
    sizes = [F.least(F.lit(k).cast("long"), F.lit(n).cast("long") - F.col(c) * k) for c, k, n in zip(coords, chunk, shape, strict=True)]
    local = F.lit(0).cast("long")
    for a, c, k, size in zip(axes, coords, chunk, sizes, strict=True):
        local = local * size + (F.col(a) - F.col(c) * k)
    own = chunk_coordinates(df, chunk).withColumn("__at", local.cast("int"))
    made = own.groupBy(*coords).agg(F.map_from_entries(F.collect_list(F.struct("__at", "value"))).alias("m"))
    n_cells = F.lit(1).cast("long")
    for size in sizes:
        n_cells = n_cells * size
    data = F.transform(F.sequence(F.lit(0), n_cells.cast("int") - 1), lambda i: F.coalesce(F.element_at("m", i), F.lit(0).cast(kind)))
    offsets = [(F.col(c) * k).alias(f"o{i}") for i, (c, k) in enumerate(zip(coords, chunk, strict=True))]
    return made.select(F.array(*coords).alias("chunk_coord"), F.array(*offsets).alias("chunk_offset"), F.array(*sizes).alias("chunk_shape"), data.alias("data"))


def explode_chunks(df: DataFrame, rank: int) -> DataFrame:
    """Chunk rows back to the long form: offset plus place within the (clipped) chunk."""
    cells = df.select("chunk_offset", "chunk_shape", F.posexplode("data").alias("__at", "value"))
    out, left = [], F.col("__at").cast("long")
    for i in range(rank - 1, -1, -1):
        size = F.col("chunk_shape")[i]
        out.append((F.col("chunk_offset")[i] + F.pmod(left, size)).cast("long").alias(f"d{i}"))
        left = F.floor(left / size).cast("long")
    return cells.select(*reversed(out), "value")


# --- containers -----------------------------------------------------------------------------------------


def read_array(spark: SparkSession, path: str, dataset: str, form: str = "long", **options: object) -> DataFrame:
    reader = register(spark).read.format("h5").option("path", path).option("dataset", dataset).option("form", form)
    for name, value in options.items():
        reader = reader.option(name, str(value).lower() if isinstance(value, bool) else value)
    df = reader.load()
    df._cubeframe_source = (path, dataset, form, options)  # a box of it is read anew, with its own plan
    return df


def write_array(df: DataFrame, path: str, dataset: str, *, mode: str = "append", shape: Sequence[int] | None = None, chunk: Sequence[int] | None = None, max_shape: Sequence[int | None] | None = None, attributes: dict[str, str | int | float] | None = None, **options: object) -> None:
    """Write cells as a dataset of a container.

    The shape is found by an aggregate if not given. Rows are dealt out by chunk (row blocks, if
    contiguous) and sorted in it, so each chunk is encoded by one task, which holds one at a time;
    encoding is parallel, the driver joins the encoded bytes. ``mode`` overwrite makes a new
    container, append adds the dataset to one (with ``extend=True``, cells to a dataset).
    """
    spark = register(df.sparkSession)
    axes = axes_of(df)
    nested = _list_depth(df)
    if shape is None and axes and not nested and not options.get("extend"):
        shape = list(infer_shape(df).first()["shape"])
    kind = df.select(*[c for c in df.columns if c not in axes])
    if axes and shape is not None or axes and chunk:
        block = 1 << (15 if any(_has_text(f.dataType) for f in kind.schema.fields) else 20)  # texts are longer than their cells
        size = chunk or [max(1, block // max(1, 8 * int(np.prod(shape[1:], dtype=object)))), *[max(1, n) for n in shape[1:]]]
        keys = [F.expr(f"{a} div {k}") for a, k in zip(axes, size)]
        n = int(spark.conf.get("spark.sql.shuffle.partitions"))
        df = df.repartition(n, *keys).sortWithinPartitions(*keys, *axes)
    writer = df.write.format("h5").option("path", path).option("dataset", dataset).mode(mode)
    if shape is not None and not options.get("extend"):
        writer = writer.option("shape", ",".join(map(str, shape)))
    if chunk is not None:
        writer = writer.option("chunk", ",".join(map(str, chunk)))
    if max_shape is not None:
        writer = writer.option("max_shape", ",".join("*" if m is None else str(m) for m in max_shape))
    for name, value in (attributes or {}).items():
        writer = writer.option(f"{'attr' if isinstance(value, str) else 'num'}.{name}", value)
    for name, value in options.items():
        writer = writer.option(name, str(value).lower() if isinstance(value, bool) else value)
    if not kind.columns:
        raise InvalidState("no values")
    writer.save()


def _has_text(kind: T.DataType) -> bool:
    if isinstance(kind, T.StructType):
        return any(_has_text(f.dataType) for f in kind.fields)
    return _has_text(kind.elementType) if isinstance(kind, T.ArrayType) else isinstance(kind, T.StringType)


def _list_depth(df: DataFrame) -> int:
    kind, n = (df.schema["value"].dataType if [c for c in df.columns if c not in axes_of(df)] == ["value"] else None), 0
    while kind is not None and kind.typeName() == "array":
        kind, n = kind.elementType, n + 1
    return n
