"""The corpus pipeline: toxicity, near-dedup, secret scan, mixing, packing, each stage on what the last one kept.

Defined results: extra columns of documents, whatever their names, pass through all stages but the last. Null and empty
texts are not toxic, hold no secrets and weigh nothing in mixing; they are near copies of each other, so one row of them
stays, and it packs into its end token. A row is a document of its own unless doc_id and text are both another row's;
rows without doc_id are never near copies. Ties go to the smaller doc_id, then to the smaller hash of the text. An empty
table gives an empty result.

Every stage sets `spark.sql.parquet.columnarReaderBatchSize` of the session to at most READ_ROWS, as Spark's Parquet reader
holds that many whole texts at once, by default 4,096: too many for an executor where texts are long.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from corvane.llm import mixing, packing, secrets, simhash, toxicity
from corvane.llm.common import shared_folder, ship, table

READ_ROWS = 16
_READ_CONF = "spark.sql.parquet.columnarReaderBatchSize"


def _few_at_once(spark: SparkSession) -> None:
    """Lets Spark read at most READ_ROWS rows of a Parquet file at once; reading starts after a stage has returned, so it stays set."""
    spark.conf.set(_READ_CONF, min(READ_ROWS, int(spark.conf.get(_READ_CONF))))


def toxicity_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops the documents that the toxicity field, fitted on the labelled ones, scores 0.5 or more."""
    _few_at_once(spark)
    ship(spark)
    return toxicity.drop_toxic(docs, table(spark, sf_dir, "labels"))


def near_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the document with the smallest doc_id of every SimHash component."""
    _few_at_once(spark)
    ship(spark)
    return simhash.keep_first(docs)


def secrets_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replaces secrets by a mark; no document goes."""
    _few_at_once(spark)
    ship(spark)
    return secrets.redact_secrets(docs)


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeats documents to the target weights of their sources and shuffles them."""
    _few_at_once(spark)
    return mixing.mix_rows(docs, mixing.TARGET)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Packs the mixed documents, in their order, into sequences of at most 2048 tokens."""
    _few_at_once(spark)
    ship(spark)
    return packing.pack(docs)


STAGES = [
    ("toxicity", toxicity_stage),
    ("simhash_near_dedup", near_dedup_stage),
    ("secret_scan", secrets_stage),
    ("mixing", mixing_stage),
    ("packing", packing_stage),
]

# Trained models, word hashes and token ids are beyond SQL; tests/llm compares every stage with a plain version of it.
ORACLE_SQL = None


def _delete(spark: SparkSession, path: str) -> None:
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages on documents; each but the last is written to the shared folder and read again.

    A stage's table is deleted once the next one is written; that of the last but one stays, as the result reads it.
    """
    docs, base, before = table(spark, sf_dir, "documents"), f"{shared_folder(spark)}/corpus-pipeline-{uuid.uuid4().hex}", None
    for i, (name, stage) in enumerate(STAGES[:-1]):
        path = f"{base}/{i}-{name}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
        if before:
            _delete(spark, before)
        before = path
    return STAGES[-1][1](spark, docs, sf_dir)
