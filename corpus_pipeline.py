"""From ``documents`` to packed sequences in five stages.

Each stage works on all that its predecessor kept, written as Parquet in the
shared folder and read again; all but the last return the columns of documents.
A stage called by itself sends the package to the executors, as ``run`` does.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodegraph.llm import packing, pii, quality_classifier, quality_rules, simhash
from lodegraph.llm.common import columns, work_folder
from lodegraph.llm.queries import table, tokenizer
from lodegraph.ship import shipped

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


@shipped
def rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules keep."""
    return quality_rules.keep(docs, COLUMNS)


@shipped
def classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the compression classifier calls good. It is fitted on all
    labelled documents, as the rules leave few of the bad ones."""
    model = quality_classifier.fit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return quality_classifier.keep_good(columns(docs, *COLUMNS), model)


@shipped
def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each SimHash component, the one with the smallest id; rows
    that repeat an id, or have none, are documents of their own."""
    return simhash.one_of_each(spark, columns(docs, *COLUMNS))


@shipped
def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, personal data replaced by its kind in brackets."""
    out = pii.mask(columns(docs, *COLUMNS))
    return out.withColumn("n_chars", F.length("text").cast("long"))


@shipped
def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents in sequences of at most 2048 tokens."""
    return packing.pack(spark, docs, tokenizer("word_bpe_49k.json"), end_id=1, window=2048)


STAGES = [("rules", rules), ("classifier", classifier), ("near_duplicates", near_duplicates), ("personal_data", personal_data), ("packing", pack)]

#: SQL can't express the stages from the classifier on.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = work_folder(spark, "pipeline")
    docs = table(spark, sf_dir, "documents")
    for i, (name, stage) in enumerate(STAGES):
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{i}-{name}")
        docs = spark.read.parquet(f"{folder}/{i}-{name}")
    return docs
