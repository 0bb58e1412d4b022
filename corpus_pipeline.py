"""The corpus pipeline: five stages over documents, each written as Parquet and read again as the next one's input."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from dirlake.llm import bagminhash, mixing, packing, quality_qda, quality_rules
from dirlake.llm.common import documents, work_table

#: Rows of an Arrow batch while the pipeline runs: texts are long, and a batch is held by the JVM and by a Python worker.
BATCH_ROWS = 1000


def _short_batches(spark: SparkSession) -> None:
    """Fewer rows to a batch, unless the session has fewer still. It is set when a stage is asked for, since a stage runs after its function has returned."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(key)) <= BATCH_ROWS:
        spark.conf.set(key, str(BATCH_ROWS))


def classify(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier, fitted on the stage's own input, takes for good.

    Rows stay or go one by one: null and empty texts by the features of an empty text, ties at 0.5 stay, and all rows where labels of both classes are missing.
    """
    _short_batches(spark)
    return quality_qda.keep_good(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the quality rules, row by row; null and empty texts go, and so does anything under ten words."""
    _short_batches(spark)
    return quality_rules.keep_good(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each near-duplicate class, the first by id, null ids last. Repeated rows are one class; texts without words all stay."""
    _short_batches(spark)
    return bagminhash.keep_rows(docs)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them, in the order of the mix; texts without words are not taken, a null source is one of its own."""
    _short_batches(spark)
    return mixing.mixed_rows(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Where each part of each document stands in the packed sequences; repeated rows never share one, and texts without words have no place."""
    _short_batches(spark)
    return packing.pack(docs)


STAGES = [("quality classifier", classify), ("quality rules", rules), ("near-duplicates", near_duplicates), ("mixing", mix), ("packing", pack)]

#: Trained scores and hashed signatures decide which rows stay, so SQL cannot express the rows.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of `sf_dir`."""
    docs = documents(spark, sf_dir)
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = work_table(docs)
    return docs
