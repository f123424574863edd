"""From raw documents to a training mixture, stage by stage."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from seedview.llm.common import bounded_batches, read_table, train_labels
from seedview.llm.decontam import without_leaks
from seedview.llm.mixing import mix_sources
from seedview.llm.pii import find_personal_data, redacted
from seedview.llm.simhash import without_near_duplicates
from seedview.llm.toxicity import fit_toxicity
from seedview.session import pin


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score below 0.5, unchanged. The model is learnt from the labelled ones among them."""
    bounded_batches(spark)
    model = fit_toxicity(docs, train_labels(read_table(spark, sf_dir, "labels"), "toxic", 5, 0))
    return docs.where(model.score(model.sums(F.col("text"))) < 0.5)


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates, the one with the smallest id, unchanged."""
    bounded_batches(spark)
    return without_near_duplicates(docs)


def drop_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a benchmark item, unchanged."""
    bounded_batches(spark)
    return without_leaks(docs, read_table(spark, sf_dir, "benchmark"))


def redact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with personal data replaced by its kind and n_chars counted anew where it was."""
    found = find_personal_data(docs, texts=True)
    columns = {name: F.col(f"row.`{name}`") for name in docs.columns}
    columns["text"] = redacted(columns["text"], F.col("spans"))
    if "n_chars" in columns:
        length = F.length(columns["text"]).cast(docs.schema["n_chars"].dataType)
        columns["n_chars"] = F.when(F.size("spans") > 0, length).otherwise(columns["n_chars"])
    return found.select(*(column.alias(name) for name, column in columns.items()))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The run's plan: one row per occurrence of a document, every document at least once."""
    return mix_sources(docs)


STAGES = [
    ("toxicity", drop_toxic),
    ("near_duplicates", drop_copies),
    ("decontamination", drop_leaks),
    ("personal_data", redact),
    ("mixing", mix),
]

#: Learnt models and near duplicates have no SQL; the stages are tested against brute force instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages in order; each reads what the one before wrote."""
    docs = read_table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = pin(stage(spark, docs, sf_dir), f"stage-{name}")
    return docs
