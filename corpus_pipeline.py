"""The corpus pipeline: five stages over ``documents``, each one of the training-data operators.

Every stage takes (spark, docs, sf_dir) and works on all rows that its predecessor kept.  The result of a
stage is written as Parquet and read again as the next one's ``docs``.

Defined results: rows without a text go in the first stage, as do letterless ones; rows without an id stay, but come
last when one document of a group is chosen; of repeated rows one stays; an empty table passes through all stages;
extra columns stay as they are, but for those named like the last stage's outputs, which are replaced.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from meterlake.llm import decontamination, language_id, near_dups, pieces, secrets
from meterlake.llm.common import materialize, table, unused

#: A document stays if this share of its n-grams belongs to the language found for it.
LEAST_COVERAGE = 0.05


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents without a letter and those in none of the learned languages.

    Without a labelled document there is no language to be in, and only an empty table is left.
    """
    # the operator's own columns must not replace columns of the documents
    aside = {c: unused(c + "_", docs.columns) for c in docs.columns if c.lower() in ("lang_pred", "score", "coverage")}
    found = language_id.identify(docs.withColumnsRenamed(aside), language_id.fit(docs))
    kept = found.filter((F.col("lang_pred") != "und") & (F.col("coverage") >= LEAST_COVERAGE))
    return kept.select(*(F.col(aside.get(c, c)).alias(c) for c in docs.columns))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep one document of each group of near duplicates, by text: equal ids of different texts don't matter."""
    return near_dups.deduplicate(docs).select(*docs.columns)


def benchmark_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents that hold benchmark windows by the contract's rule; rows with equal id and text go together."""
    key = unused("_key", docs.columns)
    said = F.concat_ws(":", F.coalesce(F.col("doc_id").cast("string"), F.lit("-")), F.xxhash64("text"), F.crc32(F.col("text").cast("binary")))
    keyed = docs.withColumn(key, said)
    judged = decontamination.decontaminate(keyed, table(spark, sf_dir, "benchmark"), id_col=key)
    dirty = judged.filter("contaminated").select(F.col("doc_id").alias(key)).distinct()
    return keyed.join(dirty, key, "left_anti").select(*docs.columns)


def secret_scan(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replace secrets in the texts; every document stays.  A column ``n_chars`` follows the texts."""
    clean = secrets.redact(docs, secrets.fit(docs))
    if "n_chars" not in docs.columns:
        return clean
    return clean.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Add the SentencePiece ids of every text."""
    return pieces.encode(docs, public_tokenizers.path("piece_bpe_32k.model"))


STAGES = [
    ("language_id", language),
    ("near_duplicates", near_duplicates),
    ("decontamination", benchmark_passages),
    ("secret_scan", secret_scan),
    ("sentencepiece", encode),
]

#: Order MinHash, the trained network and the piece ids can't be said in SQL; tests hold the stages to brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    return apply(spark, table(spark, sf_dir, "documents"), sf_dir)


def apply(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All stages over any documents."""
    for i, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = materialize(docs, name)
    return docs
