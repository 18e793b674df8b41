"""Approximate nearest neighbours by a hash-prefix forest.

Rows are dealt to blocks of bounded size by a hash of their id. A block holds one sorted array of
long hash strings per tree (signs of random projections). A query descends each tree to its
longest matching prefix, whose length differs from tree to tree, and then ascends all trees
together: at each length, from the longest down, tree after tree takes the rows under its prefix
of that length, until the rows taken are enough. Only those are scored, exactly; the nearest of
all blocks are merged.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from cubeframe.llm.common import materialize, table

#: Trees, and bits of a hash string.
TREES, BITS = 128, 32
#: Rows of a block, and queries that meet it in one task.
BLOCK, QUERIES = 16_384, 4_096
#: Ascend until the rows under a query's prefixes, counted per tree, are such a share of the block's and so many for each neighbour.
ENOUGH, EACH = 0.55, 72
SEED = 11


def planes(dim: int) -> np.ndarray:
    return np.random.default_rng(SEED).standard_normal((dim + 1, TREES * BITS)).astype(np.float32)


class Forest:
    """Sorted hash strings of one block. Vectors get a further coordinate that makes their norms
    equal, so that the direction closest to a query's has the largest inner product."""

    def __init__(self, vectors: np.ndarray, largest: float):
        self.n, self.planes = len(vectors), planes(vectors.shape[1])
        scaled = vectors / largest
        rest = np.sqrt(np.maximum(0.0, 1.0 - (scaled * scaled).sum(axis=1)))
        hashes = self._hash(np.column_stack([scaled, rest]))
        self.order = np.argsort(hashes, axis=1, kind="stable")
        self.sorted = np.take_along_axis(hashes, self.order, axis=1)

    def _hash(self, x: np.ndarray) -> np.ndarray:
        """(trees, vectors) hash strings, the first bit highest."""
        bits = (x.astype(np.float32) @ self.planes > 0).reshape(len(x), TREES, BITS)
        return np.packbits(bits, axis=2).view(">u4")[:, :, 0].T.astype(np.uint64)

    def descend(self, hashes: np.ndarray) -> np.ndarray:
        """(trees, queries) lengths of the longest prefix that a row of the block shares with each query."""
        depth = np.zeros(hashes.shape, np.int64)
        for t, (own, asked) in enumerate(zip(self.sorted, hashes, strict=True)):
            at = np.searchsorted(own, asked)
            for beside in (np.maximum(at - 1, 0), np.minimum(at, self.n - 1)):
                # the sorted neighbour on either side has the longest common prefix
                differ = own[beside] ^ asked
                depth[t] = np.maximum(depth[t], BITS - np.ceil(np.log2(differ.astype(np.float64) + 1)).astype(np.int64))
        return depth

    def candidates(self, queries: np.ndarray, enough: int) -> Iterator[np.ndarray]:
        """The rows taken for each query: at least ``enough`` of them, counted once a tree, or all."""
        hashes = self._hash(np.column_stack([queries / np.linalg.norm(queries, axis=1, keepdims=True), np.zeros(len(queries))]))
        depth = self.descend(hashes)
        low, high = np.zeros(hashes.shape, np.int64), np.zeros(hashes.shape, np.int64)
        open_ = np.arange(len(queries))
        for x in range(int(depth.max(initial=0)), -1, -1):
            if not len(open_):
                break
            drop = np.uint64(BITS - x)
            a, b = low[:, open_], high[:, open_]
            for t in range(TREES):
                reached = np.flatnonzero(depth[t, open_] >= x)
                prefix = hashes[t, open_[reached]] >> drop
                a[t, reached] = np.searchsorted(self.sorted[t], prefix << drop, side="left")
                b[t, reached] = np.searchsorted(self.sorted[t], (prefix + np.uint64(1)) << drop, side="left")
            before = high[:, open_] - low[:, open_]
            # trees ascend one after the other; those after the one that makes it enough stay where they are
            taken = np.cumsum(b - a - before, axis=0) + before.sum(axis=0)
            moves = np.vstack([np.ones(len(open_), bool), taken[:-1] < enough])
            low[:, open_], high[:, open_] = np.where(moves, a, low[:, open_]), np.where(moves, b, high[:, open_])
            open_ = open_[taken[-1] < enough]
        marks = np.zeros(self.n, bool)
        for runs in zip(low.T.tolist(), high.T.tolist(), strict=True):
            marks[:] = False
            for order, a, b in zip(self.order, *runs, strict=True):
                marks[order[a:b]] = True
            yield np.flatnonzero(marks)


def exact_scores(query: np.ndarray, vectors: np.ndarray) -> np.ndarray:
    """Inner products in double precision, each summed in the same order wherever it stands."""
    return np.add.reduce(np.ascontiguousarray(vectors) * query, axis=1)


def nearest(query_ids: np.ndarray, queries: np.ndarray, ids: np.ndarray, vectors: np.ndarray, k: int, largest: float) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(query's place, rows, scores) of each query's k best candidates in one block."""
    forest = Forest(vectors, largest)
    for q, own in enumerate(forest.candidates(queries, int(max(ENOUGH * len(ids), EACH * (k + 1))))):
        own = own[ids[own] != query_ids[q]]
        if len(own) < k:  # trees that took the same few rows: ascend until k others are sure, or all rows taken
            own = next(forest.candidates(queries[q : q + 1], TREES * (k + int((ids == query_ids[q]).sum()))))
            own = own[ids[own] != query_ids[q]]
        rough = vectors[own] @ queries[q]
        if len(own) > k:
            # products summed in another order differ from exact ones by far less than this
            bound = np.partition(rough, -k)[-k]
            own = own[rough >= bound - 1e-9 * (1 + abs(bound))]
        scores = exact_scores(queries[q], vectors[own])
        best = np.lexsort((ids[own], -scores))[:k]
        yield q, own[best], scores[best]


def search(rows: DataFrame, is_query, k: int, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(query_id, rank, vec_id, score): the k nearest found of each query row, rows of its own id excluded.

    Every row is indexed. Null ids and vectors that are null, zero, or have null or non-finite
    components take no part. Vectors of another length are searched among themselves. Repeated
    rows count once; different vectors of one id are rows, and queries, like any other. Equal
    scores go to the smaller id; equal vectors have equal scores. With fewer than k candidates all
    are returned; an empty table gives no rows. Blocks are bounded whatever vectors repeat;
    queries and blocks meet in pairs.
    """
    good = "v IS NOT NULL AND id IS NOT NULL AND forall(v, x -> x IS NOT NULL AND NOT isnan(x) AND abs(x) < double('Infinity')) AND exists(v, x -> x != 0)"
    spark = rows.sparkSession
    own = rows.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).cast("array<double>").alias("v")).where(good)
    own = materialize(own.distinct().withColumn("dim", F.size("v")).withColumn("row", F.monotonically_increasing_id()), "vectors")
    asks = is_query(F.col("id"))
    sizes = own.groupBy("dim").agg(F.count("*").alias("n"), F.sum(asks.cast("long")).alias("q"), F.max(F.expr("aggregate(v, 0D, (a, x) -> a + x * x)")).alias("m"))
    sizes = sizes.selectExpr("dim", f"CAST((n + {BLOCK - 1}) DIV {BLOCK} AS INT) AS blocks", f"CAST((q + {QUERIES - 1}) DIV {QUERIES} AS INT) AS parts", "sqrt(m) AS largest").where("parts > 0")
    own = own.join(materialize(sizes, "sizes"), "dim")
    block = F.expr("CAST(pmod(xxhash64(row), blocks) AS INT)")
    part = F.expr("CAST(pmod(xxhash64(row, 1), parts) AS INT)")
    columns = ("dim", "id", "v", "row", "largest")
    left = own.select(*columns, F.lit(False).alias("asks"), block.alias("block"), F.explode(F.expr("sequence(0, parts - 1)")).alias("part"))
    right = own.where(asks).select(*columns, F.lit(True).alias("asks"), F.explode(F.expr("sequence(0, blocks - 1)")).alias("block"), part.alias("part"))

    def solve(pdf: pd.DataFrame) -> pd.DataFrame:
        asks = pdf["asks"].to_numpy(bool)
        out = []
        if not asks.all() and asks.any():
            ids, vectors = pdf["id"].to_numpy(np.int64), np.stack(pdf["v"].to_numpy()).astype(np.float64)
            number = pdf["row"].to_numpy(np.int64)
            order = np.lexsort((number, ids))  # results don't depend on the order of arrival
            q, r = order[asks[order]], order[~asks[order]]
            for i, best, scores in nearest(ids[q], vectors[q], ids[r], vectors[r], k, float(pdf["largest"].iloc[0])):
                out.append(pd.DataFrame({"row": number[q[i]], "query_id": ids[q[i]], "vec_id": ids[r[best]], "score": scores}))
        return pd.concat(out) if out else pd.DataFrame({"row": [], "query_id": [], "vec_id": [], "score": []}).astype({"row": "int64", "query_id": "int64", "vec_id": "int64", "score": "float64"})

    found = left.unionByName(right).groupBy("dim", "block", "part").applyInPandas(solve, "row long, query_id long, vec_id long, score double")
    rank = F.row_number().over(Window.partitionBy("query_id", "row").orderBy(F.desc("score"), "vec_id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op4_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search(table(spark, sf_dir, "embeddings"), lambda i: i % 20 == 0, 20)


def brute_force(ids: np.ndarray, vectors: np.ndarray, k: int) -> Iterator[tuple[int, int, int, float]]:
    """Exact results for ids divisible by 20; for tests."""
    for q in np.flatnonzero(ids % 20 == 0):
        scores = exact_scores(vectors[q], vectors)
        rest = np.flatnonzero(ids != ids[q])
        best = rest[np.lexsort((ids[rest], -scores[rest]))[:k]]
        for rank, i in enumerate(best, 1):
            yield int(ids[q]), rank, int(ids[i]), float(scores[i])
