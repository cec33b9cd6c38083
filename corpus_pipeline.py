"""The corpus pipeline: documents go through five of the operators, each on all that the one before kept.

A stage is (name, function of (spark, docs, sf_dir)).  What it returns is written as Parquet and read again as
the docs of the next.  All but the last return the columns of documents:

1. quality: rejected documents go;
2. near_duplicates: one document of each group stays;
3. decontaminate: documents that hold a test item go;
4. secrets: secrets are replaced by a mark, and n_chars counted anew; every document stays;
5. tokens: (doc_id, tokens, n_tokens) of every document.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from graphloom.checkpoints import discard, shared_dir
from graphloom.llm import op01_decontaminate, op03_quality, op07_secrets, op09_bpe, op10_simhash_dedup

STAGES = [
    ("quality", op03_quality.stage),
    ("near_duplicates", op10_simhash_dedup.stage),
    ("decontaminate", op01_decontaminate.stage),
    ("secrets", op07_secrets.stage),
    ("tokens", op09_bpe.stage),
]

#: Trees, alignments and tokenizers are not expressible in SQL; tests/llm compares run() with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of the last stage, over the whole of documents; a stage's table goes once the next is written."""
    folder = f"{shared_dir(spark)}/graphloom/pipeline-{uuid.uuid4().hex}"
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (name, stage) in enumerate(STAGES):
        path = f"{folder}/{k}-{name}"
        stage(spark, docs, sf_dir).write.parquet(path)
        if k:
            discard(docs)
        docs = spark.read.parquet(path)
    return docs
