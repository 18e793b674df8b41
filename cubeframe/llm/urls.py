"""URL filter: host/path rules first, then a weighted vocabulary matched by Aho-Corasick."""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator, Sequence

import ahocorasick
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cubeframe.llm.common import table

# The default vocabulary, by language, ASCII as URLs mostly write it. Pass others to ``judge``.
#: One of these as a whole token rejects a URL: words that hardly stand in the address of another kind of page.
STRICT = (
    # names and words of any language
    "bdsm", "blowjob", "brazzers", "bukkake", "camgirl", "camgirls", "chaturbate", "creampie", "cumshot", "gangbang", "handjob", "hentai", "milf", "milfs",
    "porn", "pornhub", "porno", "pornos", "pornstar", "pornstars", "redtube", "sexcam", "sexcams", "upskirt", "xhamster", "xnxx", "xvideos", "xxx", "youporn",
    "crackz", "keygen", "keygens", "nulled", "serialz", "warez",
    # German
    "fotze", "ficken", "pornofilme", "sexfilme", "sexkontakte",
    # French
    "pornographique", "salope", "salopes", "partouze", "pornographie",
    # Spanish
    "follando", "pornografia", "pornogratis", "putas", "putitas",
)
#: Soft terms and their weights: 2 for words that mostly stand on such pages, 1 for those with other uses. Distinct hits count once each.
SOFT = {
    # English
    "adult": 1, "adults": 1, "babes": 1, "baccarat": 2, "bet": 1, "bets": 1, "betting": 2, "bikini": 1, "bingo": 1, "blackjack": 1, "bookmaker": 2, "boobs": 2,
    "casino": 2, "casinos": 2, "cialis": 2, "crack": 1, "cracked": 1, "dating": 1, "erotic": 2, "erotica": 2, "escort": 2, "escorts": 2, "fetish": 2, "gamble": 1,
    "gambling": 2, "hookup": 2, "horny": 2, "jackpot": 1, "levitra": 2, "lingerie": 1, "lottery": 1, "naked": 2, "nsfw": 2, "nude": 2, "nudes": 2, "orgasm": 2,
    "payday": 1, "pills": 1, "pirated": 2, "poker": 1, "replica": 1, "roulette": 1, "serials": 1, "sex": 2, "sexual": 1, "sexy": 1, "slots": 1, "sportsbook": 2,
    "steroids": 1, "stripper": 2, "strippers": 2, "swinger": 2, "swingers": 2, "topless": 2, "torrent": 1, "torrents": 1, "tramadol": 2, "viagra": 2, "webcam": 1, "webcams": 1,
    # German
    "erotik": 2, "erotisch": 2, "freispiele": 1, "gluecksspiel": 2, "huren": 2, "nackt": 2, "nutten": 2, "potenzmittel": 2, "spielautomaten": 2, "sportwetten": 2, "titten": 2, "wetten": 1,
    # French
    "cul": 1, "echangiste": 2, "erotique": 2, "nue": 1, "nues": 2, "rencontres": 1, "seins": 1, "sexe": 2, "sexuel": 1,
    # Spanish
    "apuestas": 2, "culos": 2, "desnuda": 2, "desnudas": 2, "desnudos": 1, "erotico": 2, "eroticos": 2, "maduras": 1, "ruleta": 1, "sexo": 2, "tetas": 2, "tragamonedas": 2,
}
#: Reject from so many distinct soft terms of at least this summed weight.
SOFT_TERMS, SOFT_WEIGHT = 2, 3
#: Rules of the registered query: (verdict, host, path prefix).
RULES = (("allow", "com", "/"), ("block", "example.com", "/en/"), ("allow", "www.example.com", "/en/"), ("block", "net", "/es/"), ("block", "net", "/fr/"))

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_FOLD = str.maketrans(_UPPER, _LOWER)
_TOKEN = frozenset(_LOWER + "0123456789")


def split_url(url: str | None) -> tuple[str, str]:
    """(host, path); both empty for a null or a URL without ``://``."""
    _, found, rest = (url or "").partition("://")
    if not found:
        return "", ""
    rest = rest[: min((i for c in "?#" if (i := rest.find(c)) >= 0), default=len(rest))]
    at = rest.find("/")
    host, path = (rest, "") if at < 0 else (rest[:at], rest[at:])
    return host.translate(_FOLD), path


class UrlFilter:
    """Rules by host suffix and the vocabulary's automaton; one instance serves many URLs."""

    def __init__(self, rules: Sequence[tuple[str, str, str]], strict: Sequence[str], soft: dict[str, int]):
        self.by_host: dict[str, list[tuple[str, str]]] = defaultdict(list)
        for verdict, host, path in rules:
            self.by_host[host].append((path, verdict))
        self.words = ahocorasick.Automaton()
        for term in strict:
            self.words.add_word(term, (term, 0))
        for term, weight in soft.items():
            self.words.add_word(term, (term, weight))
        self.words.make_automaton()

    def rule(self, host: str, path: str) -> tuple[str | None, str | None]:
        best: tuple[str, str] | None = None
        suffix = host
        while suffix:
            for start, verdict in self.by_host.get(suffix, ()):
                if path.startswith(start) and (best is None or len(suffix + start) > len(best[0])):
                    best = (suffix + start, verdict)
            suffix = suffix.partition(".")[2]
        return best or (None, None)

    def hits(self, url: str | None) -> tuple[int, int, int]:
        """(strict terms, soft terms, soft weight), each distinct and between token boundaries."""
        text = (url or "").translate(_FOLD)
        strict: set[str] = set()
        soft: dict[str, int] = {}
        for end, (term, weight) in self.words.iter(text):
            start = end - len(term) + 1
            if (start == 0 or text[start - 1] not in _TOKEN) and (end + 1 == len(text) or text[end + 1] not in _TOKEN):
                if weight:
                    soft[term] = weight
                else:
                    strict.add(term)
        return len(strict), len(soft), sum(soft.values())


def judge(pages: DataFrame, rules: Sequence[tuple[str, str, str]] = RULES, strict: Sequence[str] = STRICT, soft: dict[str, int] = SOFT, id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """One row per row of ``pages``: id, host, path, rule, verdict, strict_hits, soft_hits, soft_weight.

    The longest fitting rule decides, else the vocabulary. Null and empty URLs have empty host
    and path, no hits, and are allowed; repeated rows are judged alike and kept. A map without
    shuffle: no key can be hot. Other columns are ignored.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        made = UrlFilter(rules, strict, soft)
        for pdf in batches:
            out = []
            for url in pdf["url"]:
                host, path = split_url(url)
                rule, verdict = made.rule(host, path)
                n_strict, n_soft, weight = made.hits(url)
                own = "block" if n_strict or (n_soft >= SOFT_TERMS and weight >= SOFT_WEIGHT) else "allow"
                out.append((host, path, rule, verdict or own, n_strict, n_soft, weight))
            yield pd.concat([pdf[["id"]].reset_index(drop=True), pd.DataFrame(out, columns=["host", "path", "rule", "verdict", "strict_hits", "soft_hits", "soft_weight"])], axis=1)

    schema = "id long, host string, path string, rule string, verdict string, strict_hits long, soft_hits long, soft_weight long"
    return pages.select(F.col(id_col).cast("long").alias("id"), F.col(url_col).alias("url")).mapInPandas(run, schema)


def op3_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge(table(spark, sf_dir, "pages")).withColumnRenamed("id", "page_id")


def _oracle() -> str:
    hit = lambda term: f"CAST(regexp_matches(low, '(^|[^a-z0-9]){term}($|[^a-z0-9])') AS BIGINT)"
    ordered = sorted(RULES, key=lambda r: -len(r[1] + r[2]))
    fits = [(f"(host = '{host}' OR ends_with(host, '.{host}')) AND starts_with(path, '{path}')", host + path, verdict) for verdict, host, path in ordered]
    return f"""
WITH cut AS (
  SELECT page_id, coalesce(translate(url, '{_UPPER}', '{_LOWER}'), '') AS low,
         CASE WHEN instr(url, '://') > 0 THEN regexp_extract(substr(url, instr(url, '://') + 3), '^[^?#]*', 0) ELSE '' END AS rest
  FROM pages),
parts AS (
  SELECT page_id, low, translate(CASE WHEN instr(rest, '/') > 0 THEN substr(rest, 1, instr(rest, '/') - 1) ELSE rest END, '{_UPPER}', '{_LOWER}') AS host,
         CASE WHEN instr(rest, '/') > 0 THEN substr(rest, instr(rest, '/')) ELSE '' END AS path
  FROM cut),
hits AS (
  SELECT page_id, host, path, {" + ".join(map(hit, STRICT))} AS strict_hits,
         {" + ".join(map(hit, SOFT))} AS soft_hits,
         {" + ".join(f"{weight} * {hit(term)}" for term, weight in SOFT.items())} AS soft_weight,
         CASE {" ".join(f"WHEN {fit} THEN '{rule}'" for fit, rule, _ in fits)} END AS rule,
         CASE {" ".join(f"WHEN {fit} THEN '{verdict}'" for fit, _, verdict in fits)} END AS ruled
  FROM parts)
SELECT page_id, host, path, rule,
       coalesce(ruled, CASE WHEN strict_hits > 0 OR (soft_hits >= {SOFT_TERMS} AND soft_weight >= {SOFT_WEIGHT}) THEN 'block' ELSE 'allow' END) AS verdict,
       strict_hits, soft_hits, soft_weight
FROM hits"""


ORACLE = _oracle()
