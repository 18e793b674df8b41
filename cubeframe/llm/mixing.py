"""Mixing sources to target weights by hierarchical budgets, in DataFrame operations only.

A tree of levels (such as domain, language, source) carries weights. The token budget is
divided top-down: siblings share in proportion to their weights, none beyond what its subtree
holds in ``max_epochs`` epochs, and what one of them can't use goes to its siblings in
proportion to theirs. As a subtree gets less than its share only if all of it is used up, a
shortage reaches an ancestor's other children last. Each leaf then takes whole epochs and, of
the next, the prefix of a seeded order whose tokens fit.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from cubeframe.llm.common import materialize, table

LEVELS = ("domain", "language", "origin")
#: Weights of tree nodes by path; those not named have DEFAULT_WEIGHT.
WEIGHTS: Mapping[tuple[str, ...], int] = {("web",): 5, ("books",): 3, ("code",): 2, ("web", "en"): 6, ("books", "en"): 4, ("code", "en"): 8}
DEFAULT_WEIGHT = 2
MAX_EPOCHS = 3
SEED = "epoch-seed-1"
#: Hexadecimal digits of the order key that make a bucket of the running sum.
BUCKET_DIGITS = 3


def tokens(text: Column) -> Column:
    """Words between ASCII white space, as tokens."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def tree_columns(docs: DataFrame) -> DataFrame:
    """domain, language and origin of ``documents``: the domain follows from the source's number."""
    number = F.expr(r"coalesce(try_cast(regexp_extract(source, '([0-9]+)$', 1) AS INT), 0) % 3")
    return docs.withColumns({"domain": F.when(number == 0, "web").when(number == 1, "books").otherwise("code"), "language": F.coalesce("lang", F.lit("")), "origin": F.coalesce("source", F.lit(""))})


def _weight(levels: Sequence[str], weights: Mapping[tuple[str, ...], int]) -> Column:
    made = F.lit(DEFAULT_WEIGHT)
    for path, weight in sorted(weights.items()):
        if len(path) == len(levels):
            fits = F.lit(True)
            for level, name in zip(levels, path, strict=True):
                fits = fits & (F.col(level) == name)
            made = F.when(fits, weight).otherwise(made)
    return made.cast("long")


def budgets(leaves: DataFrame, levels: Sequence[str], weights: Mapping[tuple[str, ...], int], share: tuple[int, int], max_epochs: int) -> DataFrame:
    """(levels..., avail, budget) for leaves (levels..., avail): whole tokens, water-filled level by level.

    The budget is ``share`` (a fraction) of all tokens, at most what ``max_epochs`` epochs hold.
    Leaves are as few as there are sources; all steps are windows over them. Products stay in 64
    bits up to 10^15 tokens and sibling weights summing to 9,000.
    """
    held = leaves.withColumn("cap", F.col("avail") * max_epochs)
    total = leaves.agg(F.expr(f"coalesce(sum(avail), 0L) * {share[0]} div {share[1]}").alias("budget"))
    above = held.crossJoin(F.broadcast(total)) if not levels else None
    for depth in range(1, len(levels) + 1):
        own, parent = list(levels[:depth]), list(levels[: depth - 1])
        nodes = held.groupBy(*own).agg(F.sum("cap").alias("cap")).withColumn("w", _weight(own, weights))
        nodes = nodes.join(above, parent) if parent else nodes.crossJoin(F.broadcast(total))  # one row
        order = [(F.col("cap") / F.col("w")).asc(), F.col(own[-1]).asc()]
        w = Window.partitionBy(*(parent or [F.lit(0)])).orderBy(*order)
        before = F.coalesce(F.sum("cap").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
        nodes = nodes.withColumns({"left": F.greatest(F.lit(0), F.col("budget") - before), "ws": F.sum("w").over(w.rowsBetween(Window.currentRow, Window.unboundedFollowing))})
        full = F.expr("cap * ws <= left * w")  # its share of what is left is more than it holds
        first = Window.partitionBy(*(parent or [F.lit(0)])).orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
        nodes = nodes.withColumn("full", full)
        at = F.min(F.when(~F.col("full"), F.struct((F.col("cap") / F.col("w")).alias("r"), F.col(own[-1]).alias("n"), "left", "ws"))).over(first)
        nodes = nodes.withColumn("at", at).withColumn("budget", F.expr("CASE WHEN at IS NULL OR full THEN cap ELSE least(cap, at.left * w div at.ws) END"))
        above = nodes.select(*own, "budget")
    return leaves.join(above, list(levels))


def _key(epoch: Column, doc: Column) -> Column:
    return F.md5(F.concat_ws("|", F.lit(SEED), epoch.cast("string"), F.coalesce(doc.cast("string"), F.lit(""))))


def cuts(rows: DataFrame, levels: Sequence[str], weights: Mapping[tuple[str, ...], int], share: tuple[int, int], max_epochs: int) -> DataFrame:
    """(levels..., whole, cut) per leaf: epochs taken whole, and the last order key of the next epoch.

    ``rows`` has levels, doc_id and tokens. The running sum over a leaf is taken over buckets of
    the order key first; only the bucket in which the budget ends is sorted row by row.
    """
    leaves = materialize(rows.groupBy(*levels).agg(F.sum("tokens").alias("avail")), "leaves")
    given = budgets(leaves, levels, weights, share, max_epochs)
    given = given.withColumn("whole", F.expr("CASE WHEN avail > 0 THEN budget div avail ELSE 0L END")).withColumn("rest", F.expr("CASE WHEN avail > 0 THEN budget % avail ELSE 0L END"))
    given = materialize(given.select(*levels, "whole", "rest"), "budgets")
    keyed = rows.join(given, list(levels)).withColumn("key", _key(F.col("whole"), F.col("doc_id"))).withColumn("bucket", F.substring("key", 1, BUCKET_DIGITS))
    sums = keyed.groupBy(*levels, "bucket").agg(F.sum("tokens").alias("n"), F.first("rest").alias("rest"), F.max("key").alias("last"))
    run = Window.partitionBy(*levels).orderBy("bucket")
    sums = materialize(sums.withColumn("end", F.sum("n").over(run)), "buckets")
    inside = sums.where("end <= rest").groupBy(*levels).agg(F.max("last").alias("last"))
    edge = sums.where("end > rest AND end - n <= rest").select(*levels, "bucket", (F.col("end") - F.col("n")).alias("start"))
    # peers of one key (repeated rows) go in or stay out together
    upto = F.sum("tokens").over(Window.partitionBy(*levels, "bucket").orderBy("key"))
    partly = keyed.join(edge, [*levels, "bucket"]).withColumn("upto", upto).where("start + upto <= rest").groupBy(*levels).agg(F.max("key").alias("more"))
    made = given.join(inside, list(levels), "left").join(partly, list(levels), "left")
    return materialize(made.select(*levels, "whole", F.greatest("last", "more").alias("cut")), "cuts")


def mix(docs: DataFrame, levels: Sequence[str], weights: Mapping[tuple[str, ...], int], share: tuple[int, int], max_epochs: int, text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` taken, once for each epoch they are in, with all columns and ``epoch``, ``tokens``.

    ``docs`` has ``doc_id``, the text and the levels (no nulls in these; a null id is ordered as
    an empty one). Null and empty texts have no tokens and cost nothing; repeated rows of one id
    are taken or left together; ties in a leaf's order can only be such rows. An empty table
    gives no rows. Columns named ``whole``, ``cut``, ``epoch`` or ``tokens`` in ``docs`` are
    replaced. The join with the leaves' cuts is broadcast only where Spark sees them as small.
    """
    docs = docs.drop("whole", "cut", "epoch", "tokens").withColumn("tokens", tokens(F.col(text_col)))
    rows = materialize(docs.select("doc_id", *levels, "tokens"), "tokens")
    taken = docs.join(cuts(rows, levels, weights, share, max_epochs), list(levels))
    last = F.coalesce(_key(F.col("whole"), F.col("doc_id")) <= F.col("cut"), F.lit(False)) & (F.col("whole") < max_epochs)
    n = F.col("whole").cast("int") + last.cast("int")
    # at most max_epochs rows each
    return taken.withColumn("n", n).where("n > 0").withColumn("epoch", F.explode(F.sequence(F.lit(0), F.col("n") - 1))).drop("n", "whole", "cut")


def op10_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = tree_columns(table(spark, sf_dir, "documents").select("doc_id", "text", "lang", "source"))
    taken = mix(docs, LEVELS, WEIGHTS, (4, 5), MAX_EPOCHS)
    return taken.select("doc_id", *LEVELS, "epoch", "tokens")


def _oracle() -> str:
    def weight(depth: int) -> str:
        cases = "".join(f" WHEN {' AND '.join(f'''{c} = '{v}' ''' for c, v in zip(LEVELS, path))} THEN {w}" for path, w in sorted(WEIGHTS.items(), reverse=True) if len(path) == depth)
        return f"CASE{cases} ELSE {DEFAULT_WEIGHT} END" if cases else str(DEFAULT_WEIGHT)

    steps = []
    for depth in range(1, len(LEVELS) + 1):
        own, parent = LEVELS[:depth], LEVELS[: depth - 1]
        cols, by = ", ".join(own), f"PARTITION BY {', '.join(parent)}" if parent else ""
        source = f"JOIN b{depth - 1} USING ({', '.join(parent)})" if parent else "CROSS JOIN b0"
        steps.append(f"""
s{depth} AS (SELECT {cols}, cap, w, budget,
    greatest(0, budget - coalesce(sum(cap) OVER ({by} ORDER BY cap / w, {own[-1]} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) AS remaining,
    sum(w) OVER ({by} ORDER BY cap / w, {own[-1]} ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS ws
  FROM (SELECT {cols}, sum(avail) * {MAX_EPOCHS} AS cap, {weight(depth)} AS w FROM leaves GROUP BY {cols}) {source}),
f{depth} AS (SELECT *, cap * ws <= remaining * w AS is_full FROM s{depth}),
g{depth} AS (SELECT *, first_value(CASE WHEN NOT is_full THEN remaining END IGNORE NULLS) OVER ({by} ORDER BY cap / w, {own[-1]} ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS al,
    first_value(CASE WHEN NOT is_full THEN ws END IGNORE NULLS) OVER ({by} ORDER BY cap / w, {own[-1]} ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS aw FROM f{depth}),
b{depth} AS (SELECT {cols}, CAST(CASE WHEN al IS NULL OR is_full THEN cap ELSE least(cap, al * w // aw) END AS BIGINT) AS budget FROM g{depth})""")
    cols = ", ".join(LEVELS)
    key = lambda epoch: f"md5('{SEED}|' || CAST({epoch} AS VARCHAR) || '|' || coalesce(CAST(doc_id AS VARCHAR), ''))"
    return rf"""
WITH d AS (
  SELECT doc_id, CASE coalesce(try_cast(nullif(regexp_extract(source, '([0-9]+)$', 1), '') AS INT), 0) % 3 WHEN 0 THEN 'web' WHEN 1 THEN 'books' ELSE 'code' END AS domain,
         coalesce(lang, '') AS language, coalesce(source, '') AS origin,
         coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS tokens
  FROM documents),
leaves AS (SELECT {cols}, CAST(sum(tokens) AS BIGINT) AS avail FROM d GROUP BY {cols}),
b0 AS (SELECT CAST(coalesce(sum(avail), 0) * 4 // 5 AS BIGINT) AS budget FROM leaves),
{",".join(steps)},
shares AS (SELECT {cols}, CASE WHEN avail > 0 THEN budget // avail ELSE 0 END AS whole, CASE WHEN avail > 0 THEN budget % avail ELSE 0 END AS rest
  FROM leaves JOIN b{len(LEVELS)} USING ({cols})),
ordered AS (SELECT *, sum(tokens) OVER (PARTITION BY {cols} ORDER BY {key("whole")}) <= rest AS partly FROM d JOIN shares USING ({cols})),
n AS (SELECT *, whole + CASE WHEN partly AND whole < {MAX_EPOCHS} THEN 1 ELSE 0 END AS n FROM ordered)
SELECT doc_id, {cols}, CAST(unnest(range(0, CAST(n AS BIGINT))) AS INT) AS epoch, tokens FROM n WHERE n > 0"""


ORACLE = _oracle()
