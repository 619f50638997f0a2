"""The corpus pipeline: quality classifier, exact dedup, n-gram Jaccard join, decontamination, byte-level BPE.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame that is written as Parquet and reread as the next one's docs. All but
the last return the columns of ``documents``; documents that a stage rejects are gone. The last returns the encoded documents with
their decoded digest.

A doc_id names a document: where rows repeat one, a stage that rejects a row with it rejects all of them, and rows that no stage rejects all
stay, equal ones too. Rows without doc_id pass every filter. Null and empty texts are scored like others; of several one stays.
Empty tables give no rows. Columns beyond those of ``documents`` are dropped by ``run`` and passed on by a stage.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkloom.llm.byte_bpe import round_trip
from sparkloom.llm.common import Workspace
from sparkloom.llm.decontaminate import contaminated
from sparkloom.llm.exact_dedup import exact_dedup
from sparkloom.llm.parity_join import jaccard_components
from sparkloom.llm.quality_crf import quality


def _without(docs: DataFrame, gone: DataFrame) -> DataFrame:
    """The rows of ``docs`` whose doc_id is not in ``gone``."""
    own = docs.toDF(*[f"_{i}" for i in range(len(docs.columns))])  # by place, as names may differ only in case
    ids = gone.select(F.col("doc_id").alias("_gone")).distinct()
    return own.join(ids, own[f"_{docs.columns.index('doc_id')}"] == ids["_gone"], "left_anti").toDF(*docs.columns)


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier does not reject (score of 0.7 or more)."""
    judged = quality(spark, docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return _without(docs, judged.where("predicted = 0"))


def drop_exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts (A-Z lowered) the document with the largest doc_id."""
    return _without(docs, exact_dedup(spark, docs).where("NOT kept"))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies the document with the smallest doc_id."""
    return _without(docs, jaccard_components(spark, docs).where("component_id <> doc_id"))


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that contain no benchmark item."""
    return _without(docs, contaminated(spark, docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet")))


def encode_and_decode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 of every document that is left."""
    return round_trip(docs, public_tokenizers.path("byte_bpe_multi_50k.tiktoken"))


STAGES = [
    ("quality classifier", quality_classifier),
    ("exact dedup", drop_exact_copies),
    ("n-gram Jaccard join", drop_near_copies),
    ("benchmark decontamination", decontaminate),
    ("byte-level BPE", encode_and_decode),
]
#: The first stage is a trained model, which SQL cannot express; tests hold the pipeline against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    ws = Workspace(spark, "pipeline")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "lang", "source", F.col("n_chars"))
    for k, (_, stage) in enumerate(STAGES):
        docs = ws.write(stage(spark, docs, sf_dir), f"stage-{k}")
    return docs
