"""A corpus pipeline: quality rules, language identification, near-duplicate removal, packing.

Each stage takes (spark, docs, sf_dir) and works on all that its predecessor
kept; run() applies them to the table `documents`, each stage's result being
written as Parquet and read again.  Every stage takes an empty table and gives
one; columns of any name pass through all but the last, which wants doc_id and
text alone.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tesserae.llm import langid, packing, quality, simhash, sparkops


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that pass the base rules and lie in their language's perplexity bands.

    Null and blank texts go, a null lang has a band of its own, repeated rows
    stay or go together, and a value at a bound is inside.
    """
    sparkops.ship(spark)
    return quality.keep_good(docs)


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents whose language is identified with a score of 0.5 or more.

    Texts that are null or have no letter go, whatever lang says; a null lang or
    doc_id isn't learned from but is judged; of languages that tie the first by name is taken.
    """
    sparkops.ship(spark)
    return langid.keep_identified(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, that of the smallest doc_id, of each group of near-duplicates.

    A null doc_id comes last, of one id's texts the one of the least hash stays,
    and of repeated rows any one; null and empty texts are one group.
    """
    sparkops.ship(spark)
    return simhash.dedupe(docs)


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The place of each document's pieces in sequences of at most 1024 tokens.

    A null or empty text is its end token alone, repeated rows are packed each,
    and pieces that fit alike go in the order in which they come.
    """
    sparkops.ship(spark)
    return packing.pack_documents(docs).withColumn("length", F.col("length").cast("long"))


STAGES = [("quality_rules", quality_rules), ("language_id", language_id), ("near_dedup", near_dedup), ("best_fit_packing", best_fit_packing)]

#: Perplexity models, tokenizers and packing can't be said in SQL; tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Applies all stages to `documents`; returns the last one's rows.

    Results between stages are tables in the shared folder that
    spark.checkpoint.dir names; each goes when the next one is written, and the
    last stays, as the rows returned are read from it.
    """
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    place = f"{sparkops.shared_folder(spark)}/corpus-{uuid.uuid4().hex}"
    before = None
    for k, (name, stage) in enumerate(STAGES):
        out = f"{place}/{k}-{name}"
        stage(spark, docs, sf_dir).write.parquet(out)
        docs = spark.read.parquet(out)
        if before:
            sparkops.remove(spark, before)
        before = out
    return docs
