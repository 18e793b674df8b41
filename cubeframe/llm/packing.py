"""Best-fit packing of tokenised documents into fixed-length sequences.

Only the histogram over lengths (at most ``capacity`` bins) reaches the driver. There the
configuration linear program (least number of sequences whose contents cover the histogram) is
solved approximately by multiplicative weights: each round prices the lengths, one table of an
unbounded knapsack by dynamic programming gives the sequence of largest price around each length,
and the lengths become cheaper as they are covered. The fractional solution is rounded: down, then
up as far as the histogram covers it. The program is solved again for what is left, a few times;
the last pieces are placed best-fit in decreasing length. Documents then take their places by
their rank among those of their length.
"""

from __future__ import annotations

import base64
import os
import zlib
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from cubeframe.llm.common import materialize, table

CAPACITY = 2048
END = 0
#: Times that the program is solved for what is left, rounds of multiplicative weights each time, and their step.
SOLVED, ROUNDS, STEP = 12, 4, 0.5
#: A length's first price is its share of the room to this power: long ones are placed first, short ones fill the last gaps.
EARLY = 1.1
#: About so many pieces share a rank window.
RANK_ROWS = 100_000
#: Up to here the letters, digits and spaces of both tokenizer libraries agree.
_PLAIN = "ɏ"
_LONG_WORD = 512


@lru_cache(maxsize=4)
def _tokenizers(path: str):
    """The tokenizer itself, and the same vocabulary and merges in a faster library if at hand."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    exact, fast, ranks = Tokenizer.from_file(path), None, f"{os.path.splitext(path)[0]}.tiktoken"
    if os.path.exists(ranks):
        import public_tokenizers
        import tiktoken

        merges = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(ranks, "rb"))}
        fast = tiktoken.Encoding("same", pat_str=public_tokenizers.PATTERN, mergeable_ranks=merges, special_tokens={})
    return exact, fast


def token_ids(text: str | None, path: str) -> np.ndarray:
    """Ids of the whole text and the END id, as unsigned 32-bit little-endian.

    Texts of letters that the faster library surely treats alike go there; others, such as those
    with a special token's string, rarer scripts or very long words, to the tokenizer itself.
    """
    text = text or ""
    exact, fast = _tokenizers(path)
    if fast is not None and "<|" not in text and (text.isascii() or max(text) <= _PLAIN) and (len(text) < _LONG_WORD or max(map(len, text.split()), default=len(text)) < _LONG_WORD and "  " * _LONG_WORD not in text):
        ids = fast.encode_to_numpy(text, disallowed_special=())
    else:
        ids = np.array(exact.encode(text, add_special_tokens=False).ids, np.uint32)
    return np.append(ids.astype("<u4"), np.uint32(END)).astype("<u4")


def pieces(docs: DataFrame, capacity: int, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32): one row unless longer than ``capacity``; then a
    first piece with the remainder and full ones after it."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for doc, text in zip(pdf["id"], pdf["text"], strict=True):
                ids = token_ids(text, path)
                cuts = [0, *range(len(ids) % capacity or capacity, len(ids) + 1, capacity)]
                out += [(doc, k, a, b - a, zlib.crc32(ids[a:b].tobytes())) for k, (a, b) in enumerate(zip(cuts, cuts[1:]))]
            made = pd.DataFrame(out, columns=["doc_id", "piece", "start", "length", "ids_crc32"])
            made["doc_id"] = made["doc_id"].astype("Int64")
            yield made

    return docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")).mapInPandas(run, "doc_id long, piece int, start long, length long, ids_crc32 long")


def knapsack(prices: np.ndarray, lengths: np.ndarray, capacity: int) -> list[Counter]:
    """For each of ``lengths`` (ascending) the contents (repeats allowed) of the largest summed price within ``capacity`` that hold it."""
    best, took = np.zeros(capacity + 1), np.full(capacity + 1, -1)
    n_fit = np.searchsorted(lengths, np.arange(capacity + 1), side="right")
    for c in range(1, capacity + 1):
        best[c] = best[c - 1]
        if n := n_fit[c]:
            values = best[c - lengths[:n]] + prices[:n]
            if values[k := int(values.argmax())] > best[c]:
                best[c], took[c] = values[k], k
    filled = np.maximum.accumulate(np.where(took >= 0, np.arange(capacity + 1), 0))  # the room that is really used
    contents = [Counter({x: 1}) for x in lengths.tolist()]
    room = filled[capacity - lengths]
    live = np.flatnonzero(room)
    while len(live):
        taken = lengths[took[room[live]]]
        for i, x in zip(live.tolist(), taken.tolist()):
            contents[i][x] += 1
        room[live] = filled[room[live] - taken]
        live = live[room[live] > 0]
    return contents


def configuration_lp(need: dict[int, int], capacity: int, rounds: int = ROUNDS, step: float = STEP) -> dict[tuple, float]:
    """A fractional cover: configuration ((length, times), ...) to how often it is used."""
    lengths = np.array(sorted(need))
    at = {x: i for i, x in enumerate(lengths.tolist())}
    covered, used = np.zeros(len(lengths)), Counter()
    for _ in range(rounds):
        # a price never falls below its share of the room, so that full sequences are preferred
        prices = (lengths / capacity) ** EARLY * np.exp(-step * (covered - covered.min())) + 1e-9 * lengths
        now = np.zeros(len(lengths))
        for found in knapsack(prices, lengths, capacity):
            times = min(need[x] / k for x, k in found.items())
            used[tuple(sorted(found.items(), reverse=True))] += times
            for x, k in found.items():
                now[at[x]] += times * k / need[x]
        covered += now / max(1.0, float(now.mean()))
    room = sum(n * x for x, n in need.items()) / capacity
    scale = room / sum(used.values())
    return {c: t * scale for c, t in used.items()}


def best_fit(need: dict[int, int], capacity: int) -> list[tuple[dict[int, int], int]]:
    """Best-fit decreasing on a histogram: (contents, how many sequences have them)."""
    open_at: dict[int, list[tuple[tuple, int]]] = {}
    for x in sorted(need, reverse=True):
        n = need[x]
        while n > 0:
            room = min((r for r, groups in open_at.items() if r >= x and groups), default=None)
            if room is None:
                each = min(capacity // x, n)
                contents, bins, room = ((x, each),), n // each, capacity - x * each
                open_at.setdefault(room, []).append((contents, bins))
                n -= bins * each
                continue
            contents, bins = open_at[room].pop()
            each = min(room // x, n)
            take = min(bins, n // each)
            if take < bins:
                open_at[room].append((contents, bins - take))
            open_at.setdefault(room - x * each, []).append(((*contents, (x, each)), take))
            n -= take * each
    return [(dict(c), k) for groups in open_at.values() for c, k in groups]


def rounded_lp(need: dict[int, int], capacity: int) -> list[tuple[dict[int, int], int]]:
    """Whole full sequences from the program's solution, the most used configurations first: rounded
    down, then up, both as far as ``need`` covers them. What they hold is taken out of ``need``."""
    ranked = sorted(configuration_lp(need, capacity).items(), key=lambda x: (-x[1], x[0]))
    ranked = [(c, t) for c, t in ranked if sum(x * k for x, k in c) == capacity]
    out = []
    for up in (0, 1):
        for contents, times in ranked:
            times = min([int(times) + up, *(need.get(x, 0) // k for x, k in contents)])
            if times > 0:
                out.append((dict(contents), times))
                for x, k in contents:
                    need[x] -= times * k
                    if not need[x]:
                        del need[x]
    return out


def plan(need: dict[int, int], capacity: int) -> list[tuple[dict[int, int], int]]:
    """Whole sequences for every piece: the rounded program, and best fit for the rest.

    If that takes more sequences than the tokens need, the last roundings are taken back one by
    one for as long as best fit does better without them.
    """
    rest = {x: n for x, n in need.items() if n > 0}
    bound = -(-sum(x * n for x, n in rest.items()) // capacity)
    taken, states = [], [dict(rest)]
    while rest and len(taken) < SOLVED:
        made = rounded_lp(rest, capacity)
        if not made:
            break
        taken.append(made)
        states.append(dict(rest))
    best: list[tuple[dict[int, int], int]] | None = None
    for upto in range(len(taken), -1, -1):
        tried = [x for made in taken[:upto] for x in made] + best_fit(states[upto], capacity)
        if best is None or sum(t for _, t in tried) < sum(t for _, t in best):
            best = tried
        if sum(t for _, t in best) == bound:
            break
    return best or []


def _slots(planned: list[tuple[dict[int, int], int]]) -> np.ndarray:
    """Rows (length, first rank, first sequence, times a sequence, offset), sorted by the first two."""
    ranks, rows, base = Counter(), [], 0
    for contents, times in planned:
        offset = 0
        for x, k in contents.items():
            rows.append((x, ranks[x], base, k, offset))
            ranks[x] += k * times
            offset += x * k
        base += times
    return np.array(sorted(rows), np.int64).reshape(-1, 5)


def pack(docs: DataFrame, capacity: int, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Pieces of every row with sequence_id and offset.

    Null and empty texts are one piece with the END id alone. Ties and repeated rows are pieces
    like any other and get places of their own; an empty table gives no rows. Other columns are
    ignored. The plan's size depends on ``capacity`` alone: at most 2 * SOLVED * ROUNDS
    configurations and three others for each length. Ranks are taken within (length, part of the ids), so a length that a
    third of all rows share is spread.
    """
    spark = docs.sparkSession
    made = materialize(pieces(docs, capacity, path, id_col, text_col), "pieces")
    need = {r.length: r["count"] for r in made.groupBy("length").count().collect()}  # at most ``capacity`` rows
    slots = _slots(plan(need, capacity))
    parts = 64 + sum(need.values()) // RANK_ROWS
    made = made.withColumn("part", F.pmod(F.xxhash64("doc_id", "piece"), F.lit(parts)))
    sizes = made.groupBy("length", "part").count()
    before = sizes.select("length", "part", (F.sum("count").over(Window.partitionBy("length").orderBy("part")) - F.col("count")).alias("before"))
    before = materialize(before, "before")
    within = F.row_number().over(Window.partitionBy("length", "part").orderBy("doc_id", "piece", "start", "ids_crc32")) - 1
    ranked = made.withColumn("within", within).join(before.hint("merge"), ["length", "part"]).withColumn("rank", F.col("before") + F.col("within"))
    keys = slots[:, 0] << 44 | slots[:, 1]

    def place(length: pd.Series, rank: pd.Series) -> pd.DataFrame:
        x, r = length.to_numpy(np.int64), rank.to_numpy(np.int64)
        row = slots[np.searchsorted(keys, x << 44 | r, side="right") - 1]
        nth = r - row[:, 1]
        return pd.DataFrame({"sequence_id": row[:, 2] + nth // row[:, 3], "offset": row[:, 4] + nth % row[:, 3] * x})

    placed = ranked.withColumn("at", F.pandas_udf(place, "sequence_id long, offset long")("length", "rank"))
    return placed.select("doc_id", "piece", "start", "length", "ids_crc32", F.col("at.sequence_id").alias("sequence_id"), F.col("at.offset").alias("offset"))


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def op2_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"), CAPACITY, tokenizer_path())
