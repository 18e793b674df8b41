"""The corpus pipeline: five stages over ``documents``, each one operator of ``cubeframe.llm``.

Each stage works on all rows that the one before kept and is written as Parquet before the next
reads it. All but the last return the columns of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cubeframe import session
from cubeframe.llm import mixing, packing, secrets, simhash, toxicity
from cubeframe.llm.common import materialize, table

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")
#: Share of the tokens that the mixture takes, each document once at most.
MIX_SHARE = (9, 10)


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Toxicity: documents that the lexicon scores as toxic go."""
    session.prepare(spark)
    return toxicity.clean(docs, table(spark, sf_dir, "labels")).select(*COLUMNS)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Near-duplicates: of each group of similar texts the smallest doc_id stays."""
    session.prepare(spark)
    return simhash.keep_one(docs).select(*COLUMNS)


def mask_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secret scans: confirmed secrets are masked in the text; every document stays."""
    session.prepare(spark)
    masked = secrets.redact(docs, secrets.train(secrets.labelled_findings(spark)))
    return masked.withColumn("n_chars", F.length("text").cast("long")).select(*COLUMNS)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Mixing: each leaf of the domain-language-source tree gives the prefix that its budget pays for."""
    session.prepare(spark)
    return mixing.mix(mixing.tree_columns(docs), mixing.LEVELS, mixing.WEIGHTS, MIX_SHARE, 1).select(*COLUMNS)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Best-fit packing: pieces of documents with their sequence and place in it."""
    session.prepare(spark)
    return packing.pack(docs, packing.CAPACITY, packing.tokenizer_path())


STAGES = [
    ("toxicity", drop_toxic),
    ("near_duplicates", drop_near_duplicates),
    ("secrets", mask_secrets),
    ("mixing", mix_sources),
    ("packing", pack_sequences),
]

#: Learned models and fingerprints have no SQL form; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each result but the last is written to the shared folder and reread."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
