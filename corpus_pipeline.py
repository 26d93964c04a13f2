"""The corpus pipeline: quality rules, line dedup, near duplicates, mixing, encoding.

run() applies STAGES to `documents`; each stage's result is written as Parquet to the shared
folder and read back. ORACLE_SQL is None: the quality verdict is a trained model.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from knnspark.llm import line_dedup, mixing, ngram_join, piece_codec, quality_rules
from knnspark.llm.common import table, written
from knnspark.llm.queries import coded_rows, piece_model_path


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules reject go."""
    model = quality_rules.train(docs, table(spark, sf_dir, "labels"))
    return quality_rules.apply(docs, model).where("kept").select(docs.columns)


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines found in 10 documents or more go from all of them; n_chars follows the text."""
    return line_dedup.apply(docs).withColumn("n_chars", F.length("text").cast("long")).select(docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near duplicates the document with the least id stays."""
    return ngram_join.representatives(docs)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them, in training order; those it takes no words of go."""
    return mixing.train_order(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Piece ids of each document, as digests."""
    return coded_rows(docs, piece_codec.read_model(piece_model_path()))


STAGES = [("quality rules", quality), ("line dedup", lines), ("n-gram join", near_duplicates), ("mixing", mix), ("piece codec", encode)]
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name.replace(" ", "_"))
    return STAGES[-1][1](spark, docs, sf_dir)
