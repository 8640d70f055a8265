"""From raw documents to packed training sequences: five stages, each one operator, each written and reread."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from recfeat.llm import decontaminate, language_id, line_dedup, packing, simhash
from recfeat.llm.common import as_table, table
from recfeat.llm.queries import ENCODER, fold

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language can be told stay: those predicted ``und`` (null text, or no letter) go.

    The network learns from the labelled documents at hand, outside of fold 1 of 3. ``lang`` gets the
    prediction where it was null. Rows with equal id and different texts are judged one by one.
    """
    network = language_id.train(docs.where(fold("doc_id", 3) != 1))
    return language_id.annotate(docs, network).where("lang_pred <> 'und'").select(
        "doc_id", "text", F.coalesce("lang", "lang_pred").alias("lang"), "source", "n_chars"
    )


def drop_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines that an earlier document holds go; ``n_chars`` follows. Documents stay, even without a line left."""
    made = line_dedup.dedup_lines(docs.select(*COLUMNS))
    return made.withColumn("n_chars", F.length("text").cast("long")).select(*COLUMNS)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each near-duplicate group the document with the least id stays."""
    return simhash.keep_first(docs.select(*COLUMNS))


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold benchmark passages, by the rule of the operator, go."""
    return decontaminate.drop_contaminated(docs.select(*COLUMNS), table(spark, sf_dir, "benchmark"))


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All pieces of the documents and their places in sequences of 2048 tokens."""
    return packing.pack_documents(docs, ENCODER)


STAGES = [
    ("language_id", identify_language),
    ("line_dedup", drop_repeated_lines),
    ("simhash_near_dedup", drop_near_duplicates),
    ("benchmark_decontamination", drop_contaminated),
    ("best_fit_packing", pack_sequences),
]

#: SQL can express neither the trained network nor the tokenizer; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written to the shared folder and reread by the next."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = as_table(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
