"""From raw documents to packed training sequences, in stages that each write a table.

Every stage takes ``(spark, docs, sf_dir)``; all but the last return the columns of documents, also others
that there may be. Null texts count as empty: the classifier scores them, no other stage finds anything
in them. Rows without doc_id are never taken for copies or leaks; rows that repeat an id stay or go
together. An empty table passes through as one.
"""

from __future__ import annotations

from functools import wraps

from pyspark.sql import DataFrame, SparkSession

from tidemark.llm.common import staged, table
from tidemark.llm.decontaminate import without_contaminated
from tidemark.llm.entries import tokenizer
from tidemark.llm.minhash import near_duplicates
from tidemark.llm.packing import pack
from tidemark.llm.quality import accepted, train_model
from tidemark.llm.secrets import mask_secrets

#: Documents that score less than this are rejected: those that the classifier holds for bad beyond doubt.
QUALITY_CUTOFF = 0.3
#: Bytes from which an Arrow batch is sent to Python. Spark's own bounds are 10,000 rows and 64 MB; batches so large stand
#: in the JVM, outside its heap, and again in each worker, and both keep the room from stage to stage.
BATCH_BYTES = 2 << 20
_BATCH_CONF = "spark.sql.execution.arrow.maxBytesPerBatch"


def in_small_batches(stage):
    """The stage, run in a session whose Arrow batches are small: a value that it sets itself stays.

    What a stage returns runs only when it is written, so the session keeps the setting.
    """

    @wraps(stage)
    def run(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        if spark.conf.get(_BATCH_CONF, None) is None:
            spark.conf.set(_BATCH_CONF, BATCH_BYTES)
        return stage(spark, docs, sf_dir)

    return run


@in_small_batches
def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier does not reject; it learns from all labels of the table."""
    model = train_model(docs, table(spark, sf_dir, "labels"))
    return accepted(docs, model, QUALITY_CUTOFF)


@in_small_batches
def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates: the one with the smallest doc_id."""
    gone = near_duplicates(docs).where("not kept").select("doc_id").distinct()
    return docs.join(gone, "doc_id", "left_anti").select(docs.columns)


@in_small_batches
def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item, as a copy or an edited one."""
    return without_contaminated(docs, table(spark, sf_dir, "benchmark"))


@in_small_batches
def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, secrets in their texts masked."""
    return mask_secrets(docs)


@in_small_batches
def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of training sequences."""
    return pack(docs, tokenizer("word_bpe_49k.json"))


STAGES = [("quality", quality), ("near_dedup", near_dedup), ("decontaminate", decontaminate), ("secrets", secrets), ("packing", packed)]

#: Classifiers, alignment and tokenizers are beyond SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; what each returns is written and read again as the next one's input."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = staged(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
