"""From documents to a training mix: five stages, each on all that the one before kept."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from panelforge.llm import contamination, mixing, near_duplicates, repeats, toxicity
from panelforge.llm.base import table
from panelforge.session import durable


def not_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the model of the labels does not call toxic; labels held out from it are never seen."""
    model = toxicity.train(docs, table(spark, sf_dir, "labels").where(~toxicity.held_out()))
    return toxicity.scored(docs, model).where("predicted = 0").select(docs.columns)


def one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The smallest id of each group of near duplicates."""
    return near_duplicates.without_near_duplicates(docs)


def without_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts less the passages of 50 bytes and more that a smaller id has; a document stays, if need be empty."""
    got = repeats.without_repeats(docs, characters=True)
    changed = {"text": F.when(F.col("text").isNotNull(), F.col("kept"))}
    if "n_chars" in docs.columns:
        changed["n_chars"] = F.char_length(changed["text"]).cast(docs.schema["n_chars"].dataType)
    return got.withColumns(changed).select(docs.columns)


def not_in_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without ten words in a row of a benchmark item."""
    return contamination.clean(docs, table(spark, sf_dir, "benchmark"))


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the mix takes, with ``taken``, the words it takes of them, repeats counted."""
    return mixing.kept(docs)


STAGES = [
    ("toxicity", not_toxic),
    ("near_duplicates", one_of_each_group),
    ("repeats", without_passages),
    ("decontamination", not_in_benchmark),
    ("mixing", mixed),
]

#: SQL cannot express the stages that learn, link and parse; tests compare them with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = durable(docs)
    return docs
