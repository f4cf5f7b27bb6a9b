"""A training corpus from raw documents, in five stages; each takes (spark, docs, sf_dir) and returns a DataFrame.

Stages keep the columns of documents, extra ones of any name included; the last adds shard and slot, which replace
columns of these names. Null texts are not toxic, have no near copies, hold no passage, have size 0 in the mix and get a
place; null ids are told apart by the hash of the text. Repeated rows are near copies of one another, so one
stays. Of ties for the least doc_id the least text, then the first row stays. Very long texts pass whole, one at a time.
An empty table passes through.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillstone.llm import decontamination, mixing, near_duplicates, sharding, toxicity
from quillstone.llm.shared import settle, table


def reject_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score as toxic go."""
    return toxicity.keep_clean(docs, table(spark, sf_dir, "labels"))


def keep_one_of_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near duplicates stays, that of least doc_id."""
    return near_duplicates.keep_one(docs)


def cut_benchmark_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages of benchmark items are cut out; documents that are mostly such passages go. n_chars follows the text."""
    cut = decontamination.decontaminate(docs, table(spark, sf_dir, "benchmark"))
    return cut.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else cut


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it."""
    return mixing.mixed_documents(docs, table(spark, sf_dir, "labels"))


def shard(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Adds shard and slot; every shard has the sources in the proportions of the whole."""
    return sharding.sharded_documents(docs)


STAGES = [
    ("toxicity", reject_toxic),
    ("near_duplicates", keep_one_of_near_copies),
    ("decontamination", cut_benchmark_passages),
    ("mixing", mix_sources),
    ("sharding", shard),
]

#: The learned toxicity scores and the near-duplicate classes have no SQL form. tests/llm tests each operator against brute force and each stage against its operator.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; what each returns is written and read again by the next."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = settle(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
