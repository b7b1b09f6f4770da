"""A training corpus from raw documents, in five stages.

Toxic documents go, one document of each near-duplicate group stays, contaminated documents go,
sources are mixed to target weights (a document can go, or come up to three times), and the rows
are dealt to shards.  Every stage but the last returns the columns of documents; the last adds
shard and slot.  `run` writes what a stage returns as Parquet beside the checkpoints and reads it
again as the next one's input; the copies of one run lie in one folder, pipeline-<id>, and are the
caller's to remove.

Defined results, stage by stage as the operators have them: rows with null or empty text are never
toxic, near-duplicate or contaminated, and have no words, so the mix leaves them out or takes them
up to three times like any row of their source; rows without doc_id pass every filter but toxicity
and are mixed and dealt like others; repeated rows of one doc_id and text leave one; rows that share
a doc_id but not the text are documents of their own; ties fall by doc_id, then by a hash of the
row; very long texts are read whole by every stage; an empty table gives an empty one; columns
beside those of documents are carried to the end, but for shard and slot, which are replaced.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from folio.llm._text import shared_folder
from folio.llm.decontaminate import drop_contaminated
from folio.llm.minhash import keep_one_of_each
from folio.llm.mixing import mix_rows
from folio.llm.sharding import shard_rows
from folio.llm.toxicity import drop_toxic


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return drop_toxic(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return keep_one_of_each(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return drop_contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mix_rows(docs)


def sharding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return shard_rows(docs, shards=24)


STAGES = [("toxicity", toxicity), ("near_dedup", near_dedup), ("decontamination", decontamination), ("mixing", mixing), ("sharding", sharding)]

#: A trained model and an iterated graph are not SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = f"{shared_folder(spark)}/pipeline-{uuid.uuid4().hex}"
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{name}")
        docs = spark.read.parquet(f"{folder}/{name}")
    return docs
