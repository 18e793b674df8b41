"""Repeated byte strings: every byte covered by a string of ``length`` bytes that starts twice.

Each window of ``length`` bytes is named after its minimizer, the substring of ``GRAM`` bytes
with the least hash (leftmost of equal ones). Equal windows have equal minimizers at equal
offsets, so only windows under one minimizer need comparing. Consecutive windows with the same
minimizer form a run of some 80 windows. A minimizer seen once repeats nothing. Runs of the same
bytes, told by BLAKE2b digests of 128 bits, repeat as a whole. The bytes of different runs under
one minimizer are fetched, and their windows sorted as suffixes: a merge sort whose comparisons
find the common extension by binary search over prefix polynomial hashes. The order is then
verified byte by byte; where a collision has spoilt it, the bytes are sorted.

Where more than ``GROUP`` different runs meet, they are cut into blocks of ``BLOCK`` windows,
which meet under the bytes that all windows of a block cover; blocks of which still more than
``GROUP`` meet differ in less than ``BLOCK`` bytes at either end, and are cut into windows,
grouped by their bytes. So no task holds a hot passage's surroundings, and no polynomial hash
ever decides whether strings are equal.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
import xxhash
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cubeframe.llm.common import materialize, settled, spread, table

LENGTH = 200
GRAM = 40
#: Different runs of one minimizer that a task sorts at once, and windows to a block of larger groups' runs.
GROUP, BLOCK = 512, 16
#: Bytes of text hashed at once; a longer document is taken alone.
CHUNK = 1 << 20
#: Odd base of the prefix hashes modulo 2^64.
BASE = 0x9E3779B97F4A7C15
_NO_ID = -(1 << 63)

np.seterr(over="ignore")


def _mix(x: np.ndarray) -> np.ndarray:
    """A bijective scramble of 64-bit values, in place."""
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


class PrefixHash:
    """Polynomial hashes of any substring of a buffer, from prefix sums."""

    _tables: dict[int, tuple[np.ndarray, np.ndarray]] = {}

    @classmethod
    def _powers(cls, base: int, n: int) -> tuple[np.ndarray, np.ndarray]:
        have = cls._tables.get(base)
        if have is None or len(have[0]) < n:
            size = max(n, CHUNK + 1024)
            made = []
            for b in (base, pow(base, -1, 1 << 64)):
                steps = np.full(size, b, np.uint64)
                steps[0] = 1
                made.append(np.cumprod(steps))
            have = (made[0], made[1])
            if size <= 4 * CHUNK:
                cls._tables[base] = have
        return have

    def __init__(self, data: np.ndarray, base: int):
        power, self.inverse = self._powers(base, len(data) + 1)
        self.prefix = np.zeros(len(data) + 1, np.uint64)
        np.cumsum((data.astype(np.uint64) + np.uint64(1)) * power[: len(data)], out=self.prefix[1:])

    def every(self, size: int) -> np.ndarray:
        """Of all substrings of one size."""
        n = len(self.prefix) - size
        return (self.prefix[size:] - self.prefix[:n]) * self.inverse[:n]

    def at(self, start: np.ndarray, size: np.ndarray | int) -> np.ndarray:
        return (self.prefix[start + size] - self.prefix[start]) * self.inverse[start]


def _window_least(x: np.ndarray, width: int) -> np.ndarray:
    """Minima of all windows, by doubling."""
    have = 1
    while have * 2 <= width:
        x = np.minimum(x[:-have], x[have:])
        have *= 2
    return np.minimum(x[: len(x) - (width - have)], x[width - have :]) if have < width else x


def runs_of(texts: list[bytes], length: int) -> tuple[np.ndarray, ...]:
    """Runs of windows of several texts: (text number, first window, windows, offset of the first
    window from the minimizer, minimizer hash)."""
    sizes = np.fromiter(map(len, texts), np.int64, len(texts))
    data = np.frombuffer(b"".join(texts), np.uint8)
    empty = (np.empty(0, np.int64),) * 4 + (np.empty(0, np.uint64),)
    if len(data) < length:
        return empty
    grams = _mix(PrefixHash(data, BASE).every(GRAM))
    ranked = grams >> np.uint64(32) << np.uint64(32) | np.arange(len(grams), dtype=np.uint64)
    least = (_window_least(ranked, length - GRAM + 1) & np.uint64(0xFFFFFFFF)).astype(np.int64)
    ends = np.cumsum(sizes)
    number = np.repeat(np.arange(len(texts)), sizes)[: len(least)]
    valid = np.arange(len(least)) + length <= ends[number]
    new = np.empty(len(least), bool)
    new[0] = True
    new[1:] = (least[1:] != least[:-1]) | (number[1:] != number[:-1]) | (valid[1:] != valid[:-1])
    starts = np.nonzero(new)[0]
    counts = np.diff(np.append(starts, len(least)))
    starts, counts = starts[valid[starts]], counts[valid[starts]]
    if not len(starts):
        return empty
    doc = number[starts]
    return doc, starts - (ends[doc] - sizes[doc]), counts, starts - least[starts], grams[least[starts]]


def _bytes(text: str | None) -> bytes:
    return (text or "").encode("utf-8", "surrogatepass")


def _digest(data: bytes) -> int:
    return xxhash.xxh64_intdigest(data) - (1 << 63)


def _signed(x: np.ndarray) -> np.ndarray:
    return x.view(np.int64)


def _runs(docs: DataFrame, length: int, named: bool) -> DataFrame:
    """(mh) of each run of each row; if ``named`` also doc_id, digest, at, n, off, and the digest (ra, rb) of its bytes."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            held, ids, room = [], [], 0
            for doc, text in zip(pdf["doc_id"], pdf["text"], strict=True):
                if len(data := _bytes(text)) < length:
                    continue
                if held and room + len(data) > CHUNK:
                    yield _frame(ids, held, length, named)
                    held, ids, room = [], [], 0
                held.append(data)
                ids.append(doc)
                room += len(data)
            if held:
                yield _frame(ids, held, length, named)

    return docs.mapInPandas(run, "mh long" + (", doc_id long, digest long, at long, n int, off int, ra long, rb long" if named else ""))


def _frame(ids: list[int], held: list[bytes], length: int, named: bool) -> pd.DataFrame:
    doc, at, n, off, mh = runs_of(held, length)
    if not named:
        return pd.DataFrame({"mh": _signed(mh)})
    digests = np.array([_digest(x) for x in held], np.int64)
    made = b"".join([hashlib.blake2b(held[d][a:b], digest_size=16).digest() for d, a, b in zip(doc.tolist(), at.tolist(), (at + n - 1 + length).tolist(), strict=True)])
    ra, rb = np.frombuffer(made, np.int64).reshape(-1, 2).T
    return pd.DataFrame({"mh": _signed(mh), "doc_id": np.array(ids, np.int64)[doc], "digest": digests[doc], "at": at, "n": n.astype(np.int32), "off": off.astype(np.int32), "ra": ra, "rb": rb})


def sort_windows(data: np.ndarray, start: np.ndarray, segment: np.ndarray, length: int) -> np.ndarray:
    """Order of windows by (segment, bytes): a merge sort of all segments at once.

    ``segment`` is non-decreasing. In each round, every element's place among the sibling block
    is found by binary search; a comparison takes the common extension of two windows, itself a
    binary search over prefix hashes, and then the next bytes.
    """
    hashes = PrefixHash(data, BASE)
    padded = np.append(data, np.zeros(1, np.uint8)).astype(np.int16)

    def below(i: np.ndarray, j: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(window i < window j, window i == window j)."""
        low, high = np.zeros(len(i), np.int64), np.full(len(i), length, np.int64)
        for _ in range(int(length).bit_length()):
            mid = (low + high + 1) >> 1
            same = hashes.at(i, mid) == hashes.at(j, mid)
            low, high = np.where(same, mid, low), np.where(same, high, mid - 1)
        equal = low == length
        return ~equal & (padded[np.minimum(i + low, len(data))] < padded[np.minimum(j + low, len(data))]), equal

    n = len(start)
    order = np.arange(n)
    first = np.searchsorted(segment, segment, side="left")
    last = np.searchsorted(segment, segment, side="right")
    place = np.arange(n) - first
    width, most = 1, int((last - first).max(initial=0))
    while width < most:
        block = place // width
        right = block & 1 == 1
        sibling = first + np.where(right, block - 1, block + 1) * width
        low = np.minimum(sibling, last)
        base, high = low.copy(), np.minimum(sibling + width, last)
        live = np.nonzero(low < high)[0]
        at = start[order]
        while len(live):
            mid = (low[live] + high[live]) >> 1
            less, equal = below(at[mid], at[live])
            up = less | (equal & right[live])  # equal ones of the left block stay before
            low[live[up]] = mid[up] + 1
            high[live[~up]] = mid[~up]
            live = live[low[live] < high[live]]
        own = first + block * width
        target = np.minimum(own, np.where(base < last, base, own)) + (np.arange(n) - own) + (low - base)
        merged = np.empty_like(order)
        merged[target] = order
        order = merged
        width *= 2
    return order


def _follows(view: np.ndarray, x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(whether windows x and y are equal, whether x comes first or is equal), byte by byte."""
    differ = view[x] != view[y]
    first = differ.argmax(axis=1)
    at = np.arange(len(x))
    equal = ~differ[at, first]
    return equal, equal | (view[x, first] < view[y, first])


def repeated_windows(strings: list[bytes], group: np.ndarray, offset: np.ndarray, length: int) -> list[np.ndarray]:
    """For each run (a string, its group, its first window's offset): which windows are equal to
    another run's of its group. Equal windows have equal offsets, so these make the segments."""
    sizes = np.fromiter(map(len, strings), np.int64, len(strings))
    raw = b"".join(strings)
    data = np.frombuffer(raw, np.uint8)
    counts = sizes - length + 1
    run = np.repeat(np.arange(len(strings)), counts)
    nth = np.arange(counts.sum()) - np.repeat(np.cumsum(counts) - counts, counts)
    start = (np.cumsum(sizes) - sizes)[run] + nth
    by = np.lexsort((offset[run] + nth, group[run]))
    g, o = group[run][by], (offset[run] + nth)[by]
    segment = np.concatenate([[0], np.cumsum((g[1:] != g[:-1]) | (o[1:] != o[:-1]))]) if len(by) else by
    view = np.lib.stride_tricks.sliding_window_view(data, length)
    places, sorted_ = start[by], sort_windows(data, start[by], segment, length)
    for _ in range(2):
        hit, sound = np.zeros(len(start), bool), True
        for at in range(0, len(sorted_) - 1, 20_000):
            x, y = sorted_[at : at + 20_000], sorted_[at + 1 : at + 20_001]
            x = x[: len(y)]
            near = np.nonzero(segment[x] == segment[y])[0]
            x, y = x[near], y[near]
            same, ordered = _follows(view, places[x], places[y])
            sound = sound and bool(ordered.all())
            hit[by[x[same]]] = hit[by[y[same]]] = True
        if sound:
            break
        # unequal windows with equal hashes: the bytes themselves are sorted
        sorted_ = np.array(sorted(range(len(by)), key=lambda i: (segment[i], raw[places[i] : places[i] + length])))
    return np.split(hit, np.cumsum(counts)[:-1])


def _ranges(hit: np.ndarray) -> list[tuple[int, int]]:
    edges = np.flatnonzero(np.diff(np.concatenate([[0], hit.view(np.int8), [0]])))
    return [(int(a), int(b)) for a, b in zip(edges[::2], edges[1::2])]


def _compare(length: int, keys: Sequence[str]):
    """mapInPandas over runs sorted by ``keys``, under which they meet: (kind, first, n) of their repeated windows."""

    def solve(rows: list[tuple]) -> pd.DataFrame:
        names: dict[tuple, int] = {}
        group = np.array([names.setdefault(r[0], len(names)) for r in rows])
        hits = repeated_windows([r[3] for r in rows], group, np.array([r[2] for r in rows]), length)
        out = [(r[1], r[4] + a, b - a) for r, hit in zip(rows, hits, strict=True) for a, b in _ranges(hit)]
        return pd.DataFrame(out, columns=["kind", "first", "n"]).astype({"kind": "int64", "first": "int32", "n": "int32"})

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: list[tuple] = []
        for pdf in batches:
            for row in zip(zip(*(pdf[c] for c in keys), strict=True), pdf["kind"], pdf["off"], pdf["data"], pdf["skip"], strict=True):
                if len(held) >= 2000 and row[0] != held[-1][0]:
                    yield solve(held)
                    held = []
                held.append(row)
        if held:
            yield solve(held)

    return run


def _sorted(rows: DataFrame, length: int, *keys: str) -> DataFrame:
    dealt = rows.select(*keys, "kind", "off", "data", "skip").repartition(*keys).sortWithinPartitions(*keys)
    return dealt.mapInPandas(_compare(length, keys), "kind long, first int, n int")


def compare_kinds(kinds: DataFrame, length: int) -> DataFrame:
    """(kind, first, n): windows of the different runs ``kinds`` (kind, mh, off, data) that are also in another of the same mh."""
    met = kinds.groupBy("mh").agg(F.count("*").alias("m")).where("m > 1")
    kinds = kinds.withColumn("skip", F.lit(0)).join(materialize(met, "groups"), "mh")
    small, large = kinds.where(F.col("m") <= GROUP), kinds.where(F.col("m") > GROUP)
    # a block holds the windows that start at BLOCK offsets; all of them cover its core
    n = f"(length(data) - {length - 1})"
    blocks = spread(large).withColumn("block", F.explode(F.expr(f"sequence(CAST(floor(off / {BLOCK}) AS INT), CAST(floor((off + {n} - 1) / {BLOCK}) AS INT))")))
    blocks = blocks.withColumn("low", F.expr(f"greatest(off, block * {BLOCK})")).withColumn("high", F.expr(f"least(off + {n}, block * {BLOCK} + {BLOCK})"))
    core = F.xxhash64(F.expr(f"substring(data, (block + 1) * {BLOCK} - off, {length - BLOCK + 1})"))
    blocks = blocks.select("mh", "block", core.alias("core"), "kind", F.col("low").alias("off"), F.expr(f"substring(data, low - off + 1, high - low + {length - 1})").alias("data"), F.expr("low - off").alias("skip"))
    blocks = materialize(blocks, "blocks")
    sizes = materialize(blocks.groupBy("mh", "block", "core").agg(F.count("*").alias("m")).where("m > 1"), "cores")
    blocks = blocks.join(sizes, ["mh", "block", "core"])
    windows = spread(blocks.where(F.col("m") > GROUP)).select("mh", "kind", "off", "data", "skip", F.explode(F.expr(f"sequence(0, length(data) - {length})")).alias("nth"))
    windows = windows.select("mh", F.expr("off + nth").alias("off"), F.expr(f"substring(data, nth + 1, {length})").alias("data"), "kind", F.expr("skip + nth").alias("first"))
    windows = materialize(windows, "windows")
    again = windows.groupBy("mh", "off", "data").agg(F.count("*").alias("m")).where("m > 1").drop("m")
    single = windows.join(again, ["mh", "off", "data"], "left_semi").select("kind", "first", F.lit(1).alias("n"))
    return _sorted(small, length, "mh").unionByName(_sorted(blocks.where(F.col("m") <= GROUP), length, "mh", "block", "core")).unionByName(single)


def find_repeats(docs: DataFrame, length: int) -> DataFrame:
    """(doc_id, digest, first, n): windows ``first`` .. ``first + n`` of a row's text occur elsewhere."""
    plain = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(_NO_ID)).alias("doc_id"), "text")
    seen = materialize(_runs(plain, length, False).groupBy("mh").agg(F.count("*").alias("times")).where("times > 1").select("mh"), "minimizers")
    again = materialize(_runs(plain, length, True).join(seen, "mh"), "runs")
    name = ("mh", "off", "n", "ra", "rb")
    kinds = again.groupBy(*name).agg(F.count("*").alias("times"), F.min(F.struct("doc_id", "digest", "at")).alias("one")).withColumn("kind", F.monotonically_increasing_id())
    kinds = materialize(kinds, "kinds")
    met = kinds.groupBy("mh").agg(F.count("*").alias("m")).where("m > 1")
    wanted = kinds.join(met, "mh").groupBy("one.doc_id", "one.digest").agg(F.collect_list(F.struct("kind", "mh", "off", "n", F.col("one.at").alias("at"))).alias("runs"))
    wanted = wanted.select("doc_id", "digest", *[F.col(f"runs.{c}").alias(f"{c}s") for c in ("kind", "mh", "off", "n", "at")])

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for packed, *asked in zip(*(pdf[c] for c in ("packed", "kinds", "mhs", "offs", "ns", "ats")), strict=True):
                data = zstandard.decompress(packed)
                for kind, mh, off, n, at in zip(*(x.tolist() for x in asked), strict=True):
                    out.append((kind, mh, off, data[at : at + n - 1 + length]))
                    if len(out) >= 20_000:
                        yield pd.DataFrame(out, columns=["kind", "mh", "off", "data"])
                        out = []
            yield pd.DataFrame(out, columns=["kind", "mh", "off", "data"])

    # repeated rows have one digest: any of them will do
    fetched = _packed(plain).join(wanted, ["doc_id", "digest"]).select("packed", "kinds", "mhs", "offs", "ns", "ats").mapInPandas(cut, "kind long, mh long, off int, data binary")
    fetched = materialize(fetched.dropDuplicates(["kind"]), "bytes")
    whole = kinds.where("times > 1").select("kind", F.lit(0).alias("first"), "n")
    parts = materialize(whole.unionByName(compare_kinds(fetched, length)), "parts")
    # only runs of which something repeats are named and joined with it
    named = kinds.join(parts.select("kind").distinct(), "kind", "left_semi").select(*name, "kind")
    named = again.join(named, list(name)).select("doc_id", "digest", "at", "kind")
    return named.join(parts, "kind").select("doc_id", "digest", (F.col("at") + F.col("first")).alias("first"), "n")


def _packed(plain: DataFrame) -> DataFrame:
    """(doc_id, digest, packed): texts compressed before they are shuffled."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        press = zstandard.ZstdCompressor(level=1)
        for pdf in batches:
            data = [_bytes(t) for t in pdf["text"]]
            yield pd.DataFrame({"doc_id": pdf["doc_id"], "digest": [_digest(x) for x in data], "packed": [press.compress(x) for x in data]})

    return plain.mapInPandas(run, "doc_id long, digest long, packed binary")


def remove_repeats(docs: DataFrame, length: int) -> DataFrame:
    """(doc_id, kept, n_bytes, n_removed, n_spans) per row; ``kept`` is what is left, as bytes.

    Matches never cross rows; all strings are judged on the input. Null and empty texts, and
    those shorter than ``length``, lose nothing unless they repeat in themselves, which needs
    more than ``length`` bytes. Repeated rows repeat each other and lose all windows, also those
    with null ids. An empty table gives no rows. Other columns are ignored.
    """
    plain = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(_NO_ID)).alias("doc_id"), "text")
    found = settled(docs.sparkSession, lambda: find_repeats(docs, length), "repeats").groupBy("doc_id", "digest").agg(F.collect_list("first").alias("firsts"), F.collect_list("n").alias("ns"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for doc, packed, firsts, ns in zip(pdf["doc_id"], pdf["packed"], pdf["firsts"], pdf["ns"], strict=True):
                data, spans, removed = zstandard.decompress(packed), 0, 0
                if firsts is not None:
                    change = np.zeros(len(data) + 1, np.int32)
                    a = np.asarray(firsts, np.int64)
                    np.add.at(change, a, 1)
                    np.add.at(change, a + np.asarray(ns, np.int64) - 1 + length, -1)
                    gone = np.cumsum(change[:-1]) > 0
                    removed = int(gone.sum())
                    spans = int(gone[0]) + int((gone[1:] & ~gone[:-1]).sum())
                    kept = np.frombuffer(data, np.uint8)[~gone].tobytes()
                else:
                    kept = data
                out.append((doc, kept, len(data), removed, spans))
            made = pd.DataFrame(out, columns=["doc_id", "kept", "n_bytes", "n_removed", "n_spans"])
            yield made

    joined = _packed(plain).join(found, ["doc_id", "digest"], "left").select("doc_id", "packed", "firsts", "ns")
    made = joined.mapInPandas(run, "doc_id long, kept binary, n_bytes long, n_removed long, n_spans long")
    return made.withColumn("doc_id", F.when(F.col("doc_id") == _NO_ID, None).otherwise(F.col("doc_id")))


def op8_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = remove_repeats(table(spark, sf_dir, "documents"), LENGTH)
    return made.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


def brute_force(texts: list[str | None], length: int) -> list[tuple[int, int, int, str]]:
    """(n_bytes, n_removed, n_spans, kept_sha256) by a dictionary of all windows; for tests."""
    seen: dict[bytes, int] = {}
    data = [_bytes(t) for t in texts]
    for x in data:
        for i in range(len(x) - length + 1):
            seen[x[i : i + length]] = seen.get(x[i : i + length], 0) + 1
    out = []
    for x in data:
        gone = np.zeros(len(x), bool)
        for i in range(len(x) - length + 1):
            if seen[x[i : i + length]] > 1:
                gone[i : i + length] = True
        spans = int(np.diff(np.concatenate([[0], gone.astype(int)])).clip(0).sum())
        out.append((len(x), int(gone.sum()), spans, hashlib.sha256(np.frombuffer(x, np.uint8)[~gone].tobytes()).hexdigest()))
    return out


#: Every window by its digest, in blocks of text so that cutting one doesn't walk a long text.
ORACLE = f"""WITH texts AS (SELECT row_number() OVER () AS r, doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
blocks AS (SELECT r, o, substr(h, 2 * o + 1, 2 * (256 + {LENGTH - 1})) AS part
  FROM (SELECT r, h, unnest(range(0, length(h) // 2 - {LENGTH - 1}, 256)) AS o FROM texts)),
windows AS (SELECT r, o + j AS i, md5_number(substr(part, 2 * j + 1, {2 * LENGTH})) AS key
  FROM (SELECT r, o, part, unnest(range(0, least(256, length(part) // 2 - {LENGTH - 1}))) AS j FROM blocks)),
again AS (SELECT r, i FROM windows WHERE key IN (SELECT key FROM windows GROUP BY key HAVING count(*) > 1)),
marked AS (SELECT r, i, sum(CASE WHEN i - before <= {LENGTH} THEN 0 ELSE 1 END) OVER (PARTITION BY r ORDER BY i) AS span
  FROM (SELECT r, i, lag(i) OVER (PARTITION BY r ORDER BY i) AS before FROM again)),
spans AS (SELECT r, min(i) AS a, max(i) + {LENGTH} AS b FROM marked GROUP BY r, span),
gaps AS (SELECT r, coalesce(lag(b) OVER (PARTITION BY r ORDER BY a), 0) AS start, a AS stop FROM spans
  UNION ALL SELECT r, max(b), NULL FROM spans GROUP BY r),
kept AS (SELECT g.r, string_agg(CASE WHEN stop IS NULL THEN substr(h, 2 * start + 1) ELSE substr(h, 2 * start + 1, 2 * (stop - start)) END, '' ORDER BY start) AS k FROM gaps g JOIN texts t ON t.r = g.r GROUP BY g.r),
sizes AS (SELECT r, CAST(sum(b - a) AS BIGINT) AS n_removed, count(*) AS n_spans FROM spans GROUP BY r)
SELECT doc_id, length(h) // 2 AS n_bytes, coalesce(n_removed, 0) AS n_removed, coalesce(n_spans, 0) AS n_spans, sha256(unhex(coalesce(k, h))) AS kept_sha256
FROM texts LEFT JOIN kept ON kept.r = texts.r LEFT JOIN sizes ON sizes.r = texts.r"""
