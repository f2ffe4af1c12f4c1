"""A training-corpus pipeline over `documents`: each stage's rows are written as Parquet and read by the next.

    quality_rules   documents that fail the base rules or the quality model go
    language_id     documents in none of the learned languages, or without a letter, go; `lang` stays as it came, the
                    language found is op8_language_id's result
    near_dedup      of each group of near-duplicates (five-word shingles, similarity 0.8 or more) and copies one row stays,
                    that of the smallest doc_id, null ids last; rows are told apart, so a repeated id with another
                    text stays and a repeated row does not; rows without words stay
    mixing          sources are brought to tempered weights: the largest source once, no source over
                    mixing.REPEAT_LIMIT times; a row taken twice is two rows, none is left out
    bpe             ids of every text and the text they decode to, as digests

Every stage but the last returns the columns of `documents`. An empty table passes through as an empty table.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.llm import bpe, language, mixing, neardup, quality
from corpusloom.llm.tables import read
from corpusloom.session import cut


def packed(docs: DataFrame, *columns: str) -> DataFrame:
    """Whole rows as one struct beside the columns that a stage reads, so that no name of a stage meets one of the rows'."""
    return docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), *columns)


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    model = quality.fit_on(docs, read(spark, sf_dir, "labels"))
    return quality.quality(packed(docs, "text"), model).where("_q.kept").select("row.*")


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return language.identify(packed(docs, "text"), language.train_on(docs)).where("_l.accepted").select("row.*")


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return neardup.without_copies(docs, width=5, percent=80)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.realised(packed(docs, "doc_id", "source", "text"), repeat_limit=mixing.REPEAT_LIMIT).select("row.*")


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return bpe.digests(docs)


STAGES = [("quality_rules", quality_rules), ("language_id", language_id), ("near_dedup", near_dedup),
          ("mixing", mix_sources), ("bpe", encode)]

# Learned models and hashed sketches have no SQL; tests/llm compares the stages with plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    for _, stage in STAGES:
        docs = cut(stage(spark, docs, sf_dir))
    return docs
