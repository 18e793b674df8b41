"""Toxicity: a weighted lexicon learned from labels, matched by Aho-Corasick on folded text, normalised by length, with exception phrases."""

from __future__ import annotations

import math
import re
import unicodedata
from bisect import bisect_left, bisect_right
from collections.abc import Iterator, Sequence
from dataclasses import dataclass, field

import ahocorasick
import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cubeframe.llm import common
from cubeframe.llm.common import materialize, spread, table

#: For each Latin letter those of other scripts, and variants, that Unicode's list of
#: confusable characters has as looking like it. Compatibility forms (wide, mathematical, circled) are folded by NFKD.
LOOKALIKES = {
    "a": "аαɑᴀ", "b": "ьƅвʙᏏ", "c": "сϲᴄᲃⲥ", "d": "ԁɗᏧᴅ", "e": "еҽєεᴇ", "f": "ғƒꜰϝ", "g": "ɡցɢᶃ", "h": "һհнʜᏂ", "i": "іιıɩɪ", "j": "јϳʝᴊ", "k": "кκᴋⲕ", "l": "ӏʟǀ", "m": "мᴍⲙ",
    "n": "пոηɴ", "o": "оοσօᴏⲟ", "p": "рρᴘⲣ", "q": "ԛզգ", "r": "гᴦʀⲅ", "s": "ѕꜱƽʂ", "t": "тτᴛⲧ", "u": "υսᴜʋ", "v": "ѵνᴠ", "w": "ԝωѡᴡա", "x": "хχⲭ", "y": "уүγყʏ", "z": "ᴢʐⲍ",
}
HOMOGLYPHS = {other: letter for letter, others in LOOKALIKES.items() for other in others}
#: Digits and signs used for letters. Signs count only before a letter or a digit.
DIGITS = {"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "8": "b"}
SIGNS = {"@": "a", "$": "s", "!": "i"}
#: Phrases in which an insulting or violent word is harmless: hits inside them don't count. A parameter of ``learn``.
EXCEPTIONS = (
    "trash can", "trash bin", "garbage collection", "garbage collector", "garbage truck", "dumb terminal", "dumb waiter", "silly string", "silly season", "idiot proof", "idiot board", "fool proof", "fools gold",
    "april fool", "clown fish", "circus clown", "stupid me", "dead pool", "dead end", "dead line", "dead lock", "dead heat", "dead sea", "sore loser bracket", "kill switch", "kill process", "kill signal", "killer whale",
    "killer app", "killer heuristic", "pain killer", "weed killer", "crazy golf", "crazy paving", "crazy quilt", "mad hatter", "mad cow disease", "insane asylum", "lame duck", "bastard file", "bastard sword",
    "monster truck", "pig iron", "guinea pig", "rat race", "lab rat", "snake oil", "shut up shop", "suck up the dust", "scum line", "pond scum", "ugly duckling", "the good the bad and the ugly", "hate crime law",
)
#: Bound of the labelled rows that the lexicon and its calibration are fitted on.
FIT_ROWS = 20_000
#: Shares below PRECISION make no term.
PRECISION = 0.7
PREFIXES = (4, 5, 6)
THRESHOLD = 0.3

_SIGN = re.compile(r"[@$!](?=\w)")
_WORD = re.compile(r"[^\W_]+")


class _Fold(dict):
    """Character to folded text, filled as characters are met: accents off, homoglyphs and digits to letters."""

    def __missing__(self, code: int) -> str:
        char = chr(code).lower()
        base = "".join(c for c in unicodedata.normalize("NFKD", char) if not unicodedata.combining(c)) or (" " if char.isspace() else "")
        self[code] = made = "".join(HOMOGLYPHS.get(c, DIGITS.get(c, c)) for c in base)
        return made


_FOLDED = _Fold()


def fold(text: str | None) -> tuple[str, int]:
    """(words between single spaces, with one at either end; number of words)."""
    words = _WORD.findall(_SIGN.sub(lambda m: SIGNS[m[0]], text or "").translate(_FOLDED))
    return f" {' '.join(words)} " if words else " ", len(words)


@dataclass
class Lexicon:
    """``terms``: folded text with a leading space (and a trailing one for whole words) to weight."""

    terms: dict[str, float]
    exceptions: Sequence[str] = EXCEPTIONS
    bias: float = -4.0
    slope: float = 1.0
    _made: object = field(default=None, repr=False, compare=False)

    def __getstate__(self) -> dict:
        return self.__dict__ | {"_made": None}

    def automaton(self):
        if self._made is None:
            self._made = ahocorasick.Automaton()
            for term, weight in self.terms.items():
                self._made.add_word(term, (len(term), weight))
            for phrase in self.exceptions:
                if (key := fold(phrase)[0]) not in self.terms:
                    self._made.add_word(key, (len(key), None))
            if len(self._made):
                self._made.make_automaton()
        return self._made

    def density(self, text: str | None) -> float:
        """Summed weight of the words hit, once a word, normalised by length, on a log scale."""
        folded, n = fold(text)
        best: dict[int, float] = {}
        spans: list[tuple[int, int]] = []
        if len(self.automaton()):
            for end, (length, weight) in self.automaton().iter(folded):
                start = end - length + 1
                if weight is None:
                    spans.append((start, end))
                else:
                    best[start] = max(weight, best.get(start, 0.0))
        total = sum(w for at, w in sorted(best.items()) if not any(a <= at < b for a, b in spans))
        return math.log1p(100.0 * total / (n + 50.0))

    def score(self, density: float) -> float:
        return 1.0 / (1.0 + math.exp(-max(-50.0, min(50.0, self.bias + self.slope * density))))


def held_out(id_col: str = "doc_id"):
    return F.pmod(F.crc32(F.col(id_col).cast("string").cast("binary")), F.lit(4)) == 2


def _features(text: str | None) -> Iterator[tuple[str, str]]:
    """(term, its neighbouring words) of a text: whole words and word beginnings."""
    words = ["", *fold(text)[0].split(), ""]
    for before, word, after in zip(words, words[1:], words[2:]):
        if 3 <= len(word) <= 24:
            around = f"{before} {after}"
            yield f" {word} ", around
            for k in PREFIXES:
                if len(word) >= k:
                    yield f" {word[:k]}", f"{around} {word[k:]}"


def _hash(term: str) -> int:
    return xxhash.xxh64_intdigest(term) - (1 << 63)


def _counted(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """(term, t, c): how many toxic and other texts of a part have a term; a term may come in several rows."""
    seen: dict[int, list[int]] = {}

    def flush() -> pd.DataFrame:
        made = pd.DataFrame({"term": np.fromiter(seen, np.int64, len(seen)), "t": [x[0] for x in seen.values()], "c": [x[1] for x in seen.values()]})
        seen.clear()
        return made

    for pdf in batches:
        for text, y in zip(pdf["text"], pdf["toxic"], strict=True):
            for term in {_hash(term) for term, _ in _features(text)}:
                seen.setdefault(term, [0, 0])[0 if y else 1] += 1
            if len(seen) > 200_000:
                yield flush()
    yield flush()


def chosen(known: dict[str, tuple[int, int]], all_t: float, all_c: float) -> dict[str, float]:
    """Of terms and their (toxic, other) supports those that no better beginning or longer term stands for, with their weights."""
    ordered = sorted(known)

    def longer(name: str) -> list[str]:
        return ordered[bisect_right(ordered, name) : bisect_left(ordered, name + chr(0x10FFFF))]

    covered = {name: not name.endswith(" ") and any(known[x][0] >= 0.95 * known[name][0] for x in longer(name)) for name in ordered}
    terms = {}
    for name in ordered:
        stems = [s for k in (*PREFIXES, len(name)) if (s := name.rstrip()[: k + 1]) in known and s != name]
        # a longer one is the real term, or a kept beginning covers it
        if not covered[name] and all(covered[s] for s in stems):
            t, c = known[name]
            terms[name] = math.log((t + 0.5) / (all_t + 1)) - math.log((c + 0.5) / (all_c + 1))
    return terms


def learn(docs: DataFrame, labels: DataFrame, exceptions: Sequence[str] = EXCEPTIONS) -> Lexicon:
    """Fit the lexicon on at most FIT_ROWS labelled rows outside the held-out quarter.

    All terms of at least four toxic texts and a share of 0.3 are looked at. A term's support is
    the number of distinct neighbourhoods it stands in, so copies of a text count once. A term is
    kept if its share of toxic neighbourhoods is at least PRECISION and so far above the share of
    all that it is significant among as many candidates; FIT_ROWS is the only bound. Of a chain
    of beginnings with the same support the longest stays; longer ones below a kept one go.
    Without labelled rows of both classes the lexicon is empty and every score is the bias's.
    Rows with a null id, label or text take no part; of several labels of one id the larger counts.
    """
    before = len(common._WRITTEN)
    ids = labels.where("doc_id IS NOT NULL AND toxic IS NOT NULL").where(~held_out()).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    ids = ids.orderBy(F.xxhash64("doc_id"), "doc_id").limit(FIT_ROWS)
    # the broadcast side has at most FIT_ROWS rows of two numbers
    fit = docs.select("doc_id", "text").where("text IS NOT NULL").join(F.broadcast(ids), "doc_id")
    fit = materialize(spread(fit.groupBy(F.xxhash64("text").alias("h")).agg(F.first("text").alias("text"), F.max("toxic").alias("toxic"))), "labelled")

    counted = fit.mapInPandas(_counted, "term long, t long, c long").groupBy("term").agg(F.sum("t").alias("t"), F.sum("c").alias("c"))
    counted = materialize(counted, "terms")
    likely = counted.where("t >= 4 AND t >= 0.3 * (t + c)")
    maybe = frozenset(r.term for r in likely.select("term").collect())  # numbers; as many as FIT_ROWS texts have

    def neighbourhoods(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = {(h, xxhash.xxh32_intdigest(around) - (1 << 31), int(y)) for text, y in zip(pdf["text"], pdf["toxic"], strict=True) for term, around in _features(text) if (h := _hash(term)) in maybe}
            yield pd.DataFrame(list(rows), columns=["term", "around", "toxic"])

    parts = materialize(fit.mapInPandas(neighbourhoods, "term long, around int, toxic int").distinct(), "neighbourhoods")
    totals = counted.agg(F.sum("t"), F.sum("c"), F.count("*")).first()
    support = parts.groupBy("term").agg(F.sum("toxic").alias("t"), F.sum(1 - F.col("toxic")).alias("c"))
    if not totals[0] or not totals[1]:
        common.release(docs.sparkSession, before)
        return Lexicon({}, exceptions)
    all_t, all_c, n_terms = map(float, totals)
    base = all_t / (all_t + all_c)
    share = F.col("t") / (F.col("t") + F.col("c"))
    gain = F.col("t") * F.log(share / base) + F.when(F.col("c") > 0, F.col("c") * F.log((1 - share) / (1 - base))).otherwise(0.0)
    strong = support.where((share >= PRECISION) & (gain >= math.log(n_terms) + 4))
    counts = {r.term: (r.t, r.c) for r in strong.collect()}
    wanted = frozenset(counts)

    def names(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            found = {term for text in pdf["text"] for term, _ in _features(text) if _hash(term) in wanted}
            yield pd.DataFrame({"name": sorted(found)}, dtype=object)

    named = fit.mapInPandas(names, "name string").distinct().collect()
    known = {r.name: counts[h] for r in named if (h := _hash(r.name)) in counts}
    made = Lexicon(chosen(known, all_t, all_c), exceptions)

    def densities(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            yield pd.DataFrame({"x": [made.density(t) for t in pdf["text"]], "y": pdf["toxic"].astype("float64")})

    fitted = fit.mapInPandas(densities, "x double, y double").toPandas().sort_values(["x", "y"])  # at most FIT_ROWS rows
    made.bias, made.slope = _logistic(fitted["x"].to_numpy(), fitted["y"].to_numpy())
    common.release(docs.sparkSession, before)  # the lexicon rests on no table
    return made


def _logistic(x: np.ndarray, y: np.ndarray, ridge: float = 0.05) -> tuple[float, float]:
    """Bias and slope by Newton's method; the slope is held by a small ridge and never negative."""
    design, w = np.column_stack([np.ones_like(x), x]), np.array([-2.0, 1.0])
    for _ in range(100):
        p = 1 / (1 + np.exp(-np.clip(design @ w, -50, 50)))
        grad = design.T @ (p - y) + ridge * w
        hess = (design * (p * (1 - p))[:, None]).T @ design + ridge * np.eye(2)
        step = np.linalg.solve(hess, grad)
        step *= min(1.0, 2.0 / max(1e-9, float(np.abs(step).max())))
        w = w - step
        if np.abs(step).max() < 1e-9:
            break
    return float(w[0]), float(max(0.0, w[1]))


def rate(docs: DataFrame, lexicon: Lexicon, id_col: str = "doc_id", text_col: str = "text", keep: Sequence[str] = ()) -> DataFrame:
    """(id, score, predicted) and the columns in ``keep`` of every row, from the whole text alone.

    Null and empty texts have no hits and get the score of a clean text. No shuffle.
    """
    plain = docs.select(F.col(id_col).alias("__id"), F.col(text_col).alias("__text"), *[F.col(c) for c in keep])

    def run(texts: pd.Series) -> pd.Series:
        return pd.Series([lexicon.score(lexicon.density(t)) for t in texts], dtype="float64")

    scored = plain.select("__id", *keep, F.pandas_udf(run, "double")("__text").alias("score"))
    return scored.select(F.col("__id").alias("id"), *keep, "score", F.when(F.col("score") >= THRESHOLD, 1).otherwise(0).alias("predicted"))


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    scored = rate(docs, learn(docs, table(spark, sf_dir, "labels")))
    return scored.select(F.col("id").alias("doc_id"), held_out("id").alias("held_out"), "score", "predicted")


def clean(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of ``docs`` that are not rejected, with their columns.

    Null and empty texts have no hits and stay, unless most of the labelled texts are toxic.
    Repeated rows are judged alike and kept or go together; ids may be null. Without labels of
    both classes all rows stay; an empty table gives no rows.
    """
    lexicon = learn(docs, labels)

    def run(texts: pd.Series) -> pd.Series:
        return pd.Series([lexicon.score(lexicon.density(t)) < THRESHOLD for t in texts], dtype="bool")

    return docs.where(F.pandas_udf(run, "boolean")("text"))
