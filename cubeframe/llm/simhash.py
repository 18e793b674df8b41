"""SimHash near-duplicates through deletion-variant signatures.

A 64-bit fingerprint is cut into two 32-bit segments. If two fingerprints differ in at most two
bits, one segment differs in at most one. Each segment is indexed under its 32 one-wildcard
variants (one bit blanked), so an equality join on the variants finds every such pair, and the
distance is then verified. A variant shared by two fingerprints is a pair by itself, one shared
by up to ``PAIR_CAP`` is joined with itself. Fingerprints of larger buckets are indexed again
under all C(64, 2) two-wildcard variants: at most four fingerprints share one, all within two
bits of each other, so linking each to the smallest loses no link and emits no bucket's pairs.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from cubeframe.llm.common import connected, materialize, settled, spread, table

SEED = 42
PAIR_CAP = 8


def shingle_digests(text: str | None, width: int) -> np.ndarray:
    """XXH64 digests (n, 8 bytes, most significant first) of a text's word shingles, repeats kept."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()  # bytes: ASCII case and space only
    if not words:
        return np.empty((0, 8), np.uint8)
    joined = b" ".join(words)
    if len(words) <= width:
        made = xxhash.xxh64_digest(joined, SEED)
    else:
        ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1)
        starts = [0, *ends[: len(words) - width].tolist()]
        digest = xxhash.xxh64_digest
        made = b"".join([digest(joined[a:b], SEED) for a, b in zip(starts, (ends[width - 1 :] - 1).tolist(), strict=True)])
    return np.frombuffer(made, np.uint8).reshape(-1, 8)


def fingerprint(text: str | None, width: int) -> int:
    """The signed 64-bit SimHash; a bit is 1 if set in over half of the shingles, no words give 0."""
    return _majority(shingle_digests(text, width))


def _majority(digests: np.ndarray) -> int:
    if not len(digests):
        return 0
    ones = np.zeros(64, np.int64)
    for at in range(0, len(digests), 1 << 14):
        ones += np.unpackbits(digests[at : at + (1 << 14)], axis=1).sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(digests)).view(">i8")[0])


def with_fingerprints(docs: DataFrame, width: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, fp) of every row; null texts count as empty."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            yield pd.DataFrame({"id": pdf["id"], "fp": np.fromiter((fingerprint(t, width) for t in pdf["text"]), np.int64, len(pdf))})

    return docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")).mapInPandas(run, "id long, fp long")


def _buckets(fps: DataFrame) -> tuple[DataFrame, DataFrame]:
    """One-wildcard variants of ``fp`` that two or more share: (key, n, a, b) with the smallest and the largest, and (fp, key) of all."""
    key = "IF(w < 32, fp & 4294967295L & ~shiftleft(1L, w), shiftrightunsigned(fp, 32) & ~shiftleft(1L, w - 32)) | shiftleft(CAST(w AS LONG), 32)"
    variants = spread(fps.select("fp")).select("fp", F.explode(F.sequence(F.lit(0), F.lit(63))).alias("w")).select("fp", F.expr(key).alias("key"))
    return materialize(variants.groupBy("key").agg(F.count("*").alias("n"), F.min("fp").alias("a"), F.max("fp").alias("b")).where("n > 1"), "buckets"), variants


def links(fps: DataFrame) -> DataFrame:
    """Edges (a, b) between distinct fingerprints ``fp`` whose graph has the components of 'differ in <= 2 bits'."""
    buckets, variants = _buckets(fps)
    pairs = buckets.where("n = 2 AND bit_count(a ^ b) <= 2").select("a", "b")
    members = materialize(variants.join(buckets.where("n > 2").select("key", "n"), "key"), "members")
    few = members.where(F.col("n") <= PAIR_CAP).select("key", "fp")
    some = few.alias("x").join(few.alias("y"), F.expr("x.key = y.key AND x.fp < y.fp AND bit_count(x.fp ^ y.fp) <= 2")).select(F.col("x.fp").alias("a"), F.col("y.fp").alias("b"))
    hot = members.where(F.col("n") > PAIR_CAP).select("fp").distinct()
    wild = spread(hot).select("fp", F.explode(F.expr("flatten(transform(sequence(0, 62), i -> transform(sequence(i + 1, 63), j -> named_struct('i', i, 'j', j))))")).alias("p"))
    wild = wild.select("fp", F.expr("CAST(p.i * 64 + p.j AS INT)").alias("p"), F.expr("fp & ~(shiftleft(1L, p.i) | shiftleft(1L, p.j))").alias("rest"))
    stars = wild.groupBy("p", "rest").agg(F.min("fp").alias("a"), F.collect_set("fp").alias("all")).where(F.size("all") > 1).select("a", F.explode("all").alias("b")).where("a != b")
    return pairs.union(some).union(stars).distinct()


def near_duplicates(docs: DataFrame, width: int = 3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, fp, component) per row: component is the smallest id reachable over links of <= 2 bits.

    Null and empty texts have fingerprint 0 and link like any other; texts shorter than ``width``
    words are one shingle; repeated rows and equal texts share a fingerprint; a null id is kept
    and never becomes a component unless all ids of it are null. An empty table gives no rows.
    Other columns are ignored, whatever their names.
    """
    return settled(docs.sparkSession, lambda: _near_duplicates(docs, width, id_col, text_col), "components")


def _near_duplicates(docs: DataFrame, width: int, id_col: str, text_col: str) -> DataFrame:
    rows = materialize(with_fingerprints(docs, width, id_col, text_col), "fingerprints")
    fps = materialize(rows.groupBy("fp").agg(F.min("id").alias("low")), "distinct")
    roots = connected(links(fps.select("fp")))
    rooted = fps.join(roots, fps.fp == roots.node, "left").select("fp", "low", F.coalesce("root", "fp").alias("root"))
    rooted = materialize(rooted, "rooted")
    least = rooted.groupBy("root").agg(F.min("low").alias("component"))
    return rows.join(rooted.join(least, "root").select("fp", "component"), "fp").select("id", "fp", "component")


# --- Texts similar by the shingles they share, not just by a bit or two ---------------------
#
# Signatures of two bits find the nearest texts of a Jaccard similarity of 0.8, not all. What
# they miss is found exactly: similar texts share at least 0.8 of either's shingles, so with all
# shingles in one order, each of the two has a shared one among its first n - ceil(0.8 n) + 1,
# and an equality join on these finds every such pair, whatever the order. The order only
# decides how many others it finds, so common shingles come last.

#: Texts, about, that shingles are counted in to rank them, and common shingles known by rank: neither changes a result.
RANK_TEXTS, RANKED = 1 << 14, 1 << 18
#: Texts and shingles, about, of one block of a large bucket.
BLOCK, BLOCK_SHINGLES = 2048, 1 << 21
#: Rounds in which buckets of several blocks get one more hub before their open pairs are compared.
HUB_ROUNDS = 4
#: Shingles of a block counted at once.
WIDE = 4096

_LEAST = "CAST((4 * n + 4) DIV 5 AS INT)"
#: SQL: whether texts x and y of ``n`` shingles, at most ``most`` of them shared with any other, can be similar.
_CAN = "9 * least(x.most, y.most) >= 4 * (x.n + y.n)"


def shingle_set(text: str | None, width: int) -> np.ndarray:
    """The distinct 64-bit shingle hashes of a text, ascending."""
    return _distinct(shingle_digests(text, width))


def _distinct(digests: np.ndarray) -> np.ndarray:
    return np.unique(digests.view(">i8").ravel().astype(np.int64))


def rarest(shingles: np.ndarray, common: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """The first n - ceil(0.8 n) + 1 of ``shingles`` by (count, hash); those not in ``common`` (ascending) count 0."""
    seen = np.zeros(len(shingles), np.int64)
    if len(common):
        at = np.minimum(np.searchsorted(common, shingles), len(common) - 1)
        seen = np.where(common[at] == shingles, counts[at], 0)
    return shingles[np.argsort(seen, kind="stable")[: len(shingles) + (-4 * len(shingles)) // 5 + 1]]


def common_shingles(own: DataFrame, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Shingles of over two of about RANK_TEXTS texts, ascending, and their counts; at most RANKED, the most common."""

    def shingled(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            yield pd.DataFrame({"h": np.concatenate([np.empty(0, np.int64), *(shingle_set(t, width) for t in pdf["text"])])})

    step = max(1, own.count() // RANK_TEXTS)
    some = own.where(f"pmod(xxhash64(id), {step}) = 0").mapInPandas(shingled, "h long")
    rows = some.groupBy("h").agg(F.count("*").alias("n")).where("n > 2").orderBy(F.desc("n"), "h").limit(RANKED).toPandas().sort_values("h")
    return rows["h"].to_numpy(np.int64), rows["n"].to_numpy(np.int64)


def parity_bits(shingles: np.ndarray) -> bytes:
    """A bitmap of 2 bits a shingle or more, a power of two; a bit says whether an odd number of shingles fall on it.

    Two sets differ in at least as many shingles as their bitmaps in bits; halves fold by exclusive or.
    """
    size = max(64, 1 << int(2 * len(shingles) - 1).bit_length()) if len(shingles) else 64
    places = (shingles.view(np.uint64) & np.uint64(size - 1)).astype(np.int64)
    return np.packbits(np.bincount(places, minlength=size).astype(np.uint8) & 1).tobytes()


def _sets(own: DataFrame, ids: DataFrame, width: int) -> DataFrame:
    """(id, s): the shingle sets of the texts in ``own`` (id, text) whose id is in ``ids``."""

    def sets(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            yield pd.DataFrame({"id": pdf["id"], "s": [shingle_set(t, width) for t in pdf["text"]]})

    return materialize(own.join(ids.distinct(), "id", "left_semi").mapInPandas(sets, "id long, s array<long>"), "sets").dropDuplicates(["id"])


def similar_pairs(asked: DataFrame, own: DataFrame, width: int) -> DataFrame:
    """Of the pairs of ids ``asked`` (a, b) those whose texts in ``own`` (id, text) have a Jaccard similarity of 0.8, exactly."""
    asked = materialize(asked.distinct(), "candidates")
    held = _sets(own, asked.select(F.col("a").alias("id")).union(asked.select("b")), width)
    both = asked.join(held.withColumnsRenamed({"id": "a", "s": "sa"}), "a").join(held.withColumnsRenamed({"id": "b", "s": "sb"}), "b")
    both = both.where("5 * least(size(sa), size(sb)) >= 4 * greatest(size(sa), size(sb)) AND 9 * size(array_intersect(sa, sb)) >= 4 * (size(sa) + size(sb))")
    return materialize(both.select("a", "b"), "links")


def forest_of_similar(sets: list[np.ndarray], roots: np.ndarray, asks: np.ndarray) -> list[tuple[int, int]]:
    """Pairs (asking, any) of places whose sets have a Jaccard similarity of 0.8 and that join
    different roots: as many as it takes to join all roots that such pairs join.

    Shared shingles are counted by products of 0/1 matrices over WIDE shingles at a time; those of
    one text alone are left out.
    """
    n = np.fromiter(map(len, sets), np.int64, len(sets))
    _, token, times = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    renamed = np.cumsum(times > 1) - 1
    row, token = np.repeat(np.arange(len(sets)), n)[times[token] > 1], renamed[token[times[token] > 1]]
    order = np.argsort(token, kind="stable")
    row, token = row[order], token[order]
    who = np.flatnonzero(asks)
    shared = np.zeros((len(who), len(sets)), np.float32)  # whole numbers, exact below 2^24
    for low in range(0, int(token[-1]) + 1 if len(token) else 0, WIDE):
        a, b = np.searchsorted(token, [low, low + WIDE])
        held = np.zeros((len(sets), WIDE), np.float32)
        held[row[a:b], token[a:b] - low] = 1
        shared += held[who] @ held.T
    found, parent = [], {int(r): int(r) for r in roots}

    def find(x: int) -> int:
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for i, x in enumerate(who.tolist()):
        for y in np.flatnonzero(9 * shared[i].astype(np.int64) >= 4 * (n[x] + n)).tolist():
            a, b = find(int(roots[x])), find(int(roots[y]))
            if a != b:
                parent[a] = b
                found.append((x, y))
    return found


def possible_rows(bits: list[bytes], n: np.ndarray, roots: np.ndarray, asks: np.ndarray) -> np.ndarray:
    """Marks of the sets (by their parity bits and sizes) that may be similar to one of another root, either of them asking."""
    sizes = np.array([len(x) for x in bits])
    marks = np.zeros(len(bits), bool)
    for size in np.unique(sizes):
        # sets of a similarity of 0.8 have bitmaps alike in size, or one twice as large
        own = np.flatnonzero((sizes == size) | (sizes == 2 * size))
        packed = [np.frombuffer(bits[i], np.uint8) for i in own]
        packed = np.stack([x if len(x) == size else x[:size] ^ x[size:] for x in packed])
        who = np.flatnonzero(asks[own])
        differ = np.zeros((len(who), len(own)), np.float32)
        for low in range(0, size, WIDE // 8):
            held = np.unpackbits(packed[:, low : low + WIDE // 8], axis=1).astype(np.float32)
            ones = held.sum(axis=1)
            differ += ones[who, None] + ones[None, :] - 2 * (held[who] @ held.T)
        near = (9 * differ <= n[own][who, None] + n[own][None, :]) & (roots[own][who, None] != roots[own][None, :])
        marks[own[who[near.any(axis=1)]]] = True
        marks[own[near.any(axis=0)]] = True
    return marks


def _possible_in_block(pdf: pd.DataFrame) -> pd.DataFrame:
    """The rows (key, i, j, id) of one pair of blocks that are worth comparing."""
    pdf = pdf.drop_duplicates("id")
    marks = possible_rows(list(pdf["bits"]), pdf["n"].to_numpy(np.int64), pdf["root"].to_numpy(np.int64), pdf["asks"].to_numpy(bool))
    return pdf.loc[marks, ["key", "i", "j", "id"]]


def _compare_block(pdf: pd.DataFrame) -> pd.DataFrame:
    """Links within the rows (id, root, asks, s) of one pair of blocks."""
    pdf = pdf.drop_duplicates("id")
    ids = pdf["id"].to_numpy(np.int64)
    found = forest_of_similar(list(pdf["s"]), pdf["root"].to_numpy(np.int64), pdf["asks"].to_numpy(bool))
    return pd.DataFrame([(min(ids[x], ids[y]), max(ids[x], ids[y])) for x, y in found], columns=["a", "b"]).astype("int64")


def large_links(hot: DataFrame, links: DataFrame, own: DataFrame, bits: DataFrame, width: int) -> DataFrame:
    """``links`` and what is missing for the components of all similar pairs within the buckets of ``hot`` (key, id, n, most).

    Two texts of one component need no comparison. In a bucket of several the others than its
    largest are compared with all: a bucket is dealt into blocks, and two blocks meet in one
    task, which gives out links only, not pairs. There texts first meet as parity bits, and as
    shingle sets only if these allow a similarity of 0.8. Buckets of several blocks are before
    compared with one more hub, a few times, which mostly leaves few others.
    """
    for nth in range(HUB_ROUNDS + 1):
        roots = connected(links)
        rooted = materialize(hot.join(roots, hot.id == roots.node, "left").select("key", "id", "n", "most", F.coalesce("root", "id").alias("root")), "rooted")
        parts = rooted.groupBy("key", "root").agg(F.count("*").alias("c"), F.sum("n").alias("w"))
        open_ = parts.groupBy("key").agg(F.count("*").alias("k"), F.sum("c").alias("m"), F.sum("w").alias("w"), F.expr("max_by(root, struct(c, root))").alias("main")).where("k > 1")
        blocks = F.greatest(F.expr(f"(m + {BLOCK - 1}) DIV {BLOCK}"), F.expr(f"(w + {BLOCK_SHINGLES - 1}) DIV {BLOCK_SHINGLES}")).cast("int")
        open_ = materialize(open_.select("key", "main", blocks.alias("blocks")), "open")
        most = open_.agg(F.max("blocks")).first()[0]
        if most is None:
            return links
        rest = rooted.join(open_, "key").withColumn("asks", F.expr("root != main"))
        if most == 1 or nth == HUB_ROUNDS:
            break
        rest = materialize(rest.where("blocks > 1"), "rest")
        hubs = rest.where("asks").groupBy("key").agg(F.expr("min(struct(id, n, most, root))").alias("x"))
        asked = rest.alias("y").join(hubs, "key").where(f"x.root != y.root AND {_CAN}").select(F.least("x.id", "y.id").alias("a"), F.greatest("x.id", "y.id").alias("b"))
        found = similar_pairs(asked, own, width)
        if found.isEmpty():
            break
        links = links.union(found)
    rest = rest if most == 1 else rooted.join(open_, "key").withColumn("asks", F.expr("root != main"))
    rest = rest.withColumn("own", F.expr("CAST(pmod(xxhash64(id), blocks) AS INT)")).withColumn("other", F.explode(F.expr("sequence(0, blocks - 1)")))
    rest = rest.select("key", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "id", "n", "root", "asks")
    rest = materialize(rest, "blocks")
    possible = rest.join(bits, "id").groupBy("key", "i", "j").applyInPandas(_possible_in_block, "key long, i int, j int, id long")
    rest = materialize(rest.join(possible, ["key", "i", "j", "id"], "left_semi"), "possible")
    met = rest.join(_sets(own, rest.select("id"), width), "id").groupBy("key", "i", "j").applyInPandas(_compare_block, "a long, b long")
    return links.union(materialize(met.distinct(), "found"))


def signature_pairs(prints: DataFrame) -> DataFrame:
    """Pairs of ids (a, b) of ``prints`` (id, fp) that deletion-variant signatures propose: two bits apart, or under
    one variant with its smallest fingerprint; each id with the smallest of its own fingerprint."""
    least = materialize(prints.groupBy("fp").agg(F.min("id").alias("low"), F.count("*").alias("m")), "distinct")
    alike = prints.join(least.where("m > 1"), "fp").where("id != low").select(F.col("low").alias("a"), F.col("id").alias("b"))
    buckets, variants = _buckets(least)
    few = buckets.where("n = 2 AND bit_count(a ^ b) <= 2").select("a", "b")
    more = variants.join(buckets.where("n > 2").select("key", "a"), "key").where("a != fp AND bit_count(a ^ fp) <= 2").select("a", F.col("fp").alias("b"))
    near = few.union(more).distinct()
    near = near.join(least.select(F.col("fp").alias("a"), F.col("low").alias("x")), "a").join(least.select(F.col("fp").alias("b"), F.col("low").alias("y")), "b")
    return alike.union(near.select(F.least("x", "y"), F.greatest("x", "y")))


def similar_groups(docs: DataFrame, width: int = 5, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, component): components of the rows whose texts have a Jaccard similarity of 0.8 over shingles; component is the smallest id.

    Equal word sequences (ASCII case aside) are one text. Candidates come from deletion-variant
    signatures of the texts' SimHash, and from their rarest shingles, of which every similar pair
    shares one; texts under one are a bucket. In a bucket of up to PAIR_CAP all pairs are
    candidates, in a larger one each text with the smallest id, then all that this leaves in
    different components: the result is that of comparing all pairs. Comparison is exact, on
    64-bit hashes of shingles. Null and empty texts are one text. Rows with a null id are left
    out. An empty table gives no rows.
    """
    own = docs.where(F.col(id_col).isNotNull()).select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    common, counts = common_shingles(own, width)

    def marked(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for ident, text in zip(pdf["id"], pdf["text"], strict=True):
                joined = b" ".join((text or "").encode("utf-8", "surrogatepass").lower().split())
                digests = shingle_digests(text, width)
                shingles = _distinct(digests)
                out.append((ident, xxhash.xxh64_intdigest(joined, 1) - (1 << 63), xxhash.xxh64_intdigest(joined, 2) - (1 << 63), _majority(digests), len(shingles), rarest(shingles, common, counts), parity_bits(shingles)))
            yield pd.DataFrame(out, columns=["id", "h1", "h2", "fp", "n", "rare", "bits"])

    rows = materialize(own.mapInPandas(marked, "id long, h1 long, h2 long, fp long, n int, rare array<long>, bits binary"), "marked")
    # equal word sequences have equal marks: any row's will do
    prints = rows.groupBy("h1", "h2").agg(F.min("id").alias("id"), F.first("fp").alias("fp"), F.first("n").alias("n"), F.first("rare").alias("rare"), F.first("bits").alias("bits"))
    prints = materialize(prints, "prints")
    variants = prints.select("id", "n", F.explode("rare").alias("key"))
    buckets = materialize(variants.groupBy("key").agg(F.count("*").alias("m"), F.min("id").alias("low")).where("m > 1"), "shared")
    members = materialize(variants.join(buckets, "key"), "bucketed")
    # a rare shingle without a bucket is shared with no text
    texts = materialize(members.groupBy("id", "n").agg(F.expr(f"CAST({_LEAST} - 1 + count(*) AS INT)").alias("most")), "texts")
    members = materialize(members.join(texts, ["id", "n"]), "members")
    few, hot = members.where(F.col("m") <= PAIR_CAP), members.where(F.col("m") > PAIR_CAP)
    few = few.select("key", "id", "n", "most")
    some = few.alias("x").join(few.alias("y"), F.expr(f"x.key = y.key AND x.id < y.id AND {_CAN}")).select(F.col("x.id").alias("a"), F.col("y.id").alias("b"))
    stars = hot.where("id != low").select("id", "n", "most", "low").distinct().alias("y")
    stars = stars.join(texts.alias("x"), F.expr(f"x.id = y.low AND {_CAN}")).select(F.col("x.id").alias("a"), F.col("y.id").alias("b"))
    asked = some.union(stars).union(signature_pairs(prints.select("id", "fp")))
    links_ = large_links(hot.select("key", "id", "n", "most"), similar_pairs(asked, own, width), own, prints.select("id", "bits"), width)
    roots = connected(links_)
    rooted = prints.join(roots, prints.id == roots.node, "left").select("h1", "h2", F.coalesce("root", "id").alias("component"))
    return rows.select("id", "h1", "h2").join(rooted, ["h1", "h2"]).select("id", "component")


def keep_one(docs: DataFrame, width: int = 5) -> DataFrame:
    """The rows of ``docs`` but for all of each group of similar texts other than the smallest doc_id's.

    Rows with a null doc_id stay. Of repeated rows of one doc_id the first in the order of all columns stays.
    """
    groups = settled(docs.sparkSession, lambda: similar_groups(docs, width), "similar")
    if groups.count() != groups.select("id").distinct().count():
        null, known = docs.where("doc_id IS NULL"), docs.where("doc_id IS NOT NULL")
        order = F.row_number().over(Window.partitionBy("doc_id").orderBy(*[c for c in docs.columns if c != "doc_id"] or ["doc_id"]))
        docs = known.withColumn("__nth", order).where("__nth = 1").drop("__nth").unionByName(null)
    gone = groups.where("id != component").select(F.col("id").alias("doc_id")).distinct()
    return docs.join(gone.hint("merge"), "doc_id", "left_anti").select(*docs.columns)


def op5_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = near_duplicates(table(spark, sf_dir, "documents"), 3)
    return found.select(F.col("id").alias("doc_id"), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), F.col("component").alias("component_id"))
