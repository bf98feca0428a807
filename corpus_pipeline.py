"""Clean training sequences from the documents table, in five Spark stages.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; ``run`` writes
it as Parquet in the shared checkpoint folder and reads it again for the next.
All stages but the last return the columns of their input; the last returns the
pieces of every kept document with their places in the training sequences.

Definite results: a null text is empty; toxicity gives it the score of no n-grams;
line dedup keeps documents that had no word before; near-dedup links empty ones with
nothing and keeps one of identical rows of a doc_id; decontamination finds nothing
in them; packing gives them their end id.  Empty tables pass through every stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from typesift.llm import decontaminate, line_templates, near_dedup, packing, toxicity
from typesift.llm.session import materialize, table
from typesift.llm.tokens import vocabulary

#: The near-dedup stage's similarity; op3's is 85.
NEAR_PERCENT = 80


def civil(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without the documents that the toxicity classifier rejects."""
    return toxicity.reject(docs, toxicity.train(docs, table(spark, sf_dir, "labels")))


def fresh_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without lines whose template an earlier document has; documents left without a word go."""
    return line_templates.deduplicate(docs)


def distinct(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates (0.8 or more): the one with the smallest doc_id."""
    return near_dedup.deduplicate(docs, NEAR_PERCENT)


def uncontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without the documents that hold too much of the benchmark."""
    return decontaminate.decontaminate(docs, table(spark, sf_dir, "benchmark"))


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every kept document's pieces in sequences of at most 2048 tokens."""
    return packing.pack(docs, vocabulary("word_bpe_49k.json"))


STAGES = [("toxicity", civil), ("line_dedup", fresh_lines), ("near_dedup", distinct),
          ("decontamination", uncontaminated), ("packing", packed)]

#: The toxicity stage fits a classifier, which SQL can't express; tests hold run() against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = materialize(stage(spark, docs, sf_dir), name)
    return docs
