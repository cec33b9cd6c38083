"""Token counts by batch encoding in Arrow functions; only lengths come back.

A scan's batch is cut into runs of about ``BATCH_BYTES`` of text, whatever the number of rows.  The texts of a run
are encoded by one call of the library each ``bpe.CALL`` characters, a reserved mark between them, and their lengths
are the distances between the marks' ids.  (The library's own batch call starts threads and returns Python lists of
ids, of which only the lengths are wanted.)  A text longer than ``bpe.LONG`` is encoded in parts cut at safe
boundaries, and long runs of white space without the pattern, so very long texts of any kind are counted like others.
Nothing is shuffled: the scan's partitions are balanced by bytes already, and a row of two numbers is all that leaves
Python.

Defined results.  Null text: null.  Empty text: 0.  Rows that repeat are counted each.  Empty table: empty
result.  Other columns are not read, whatever their names.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.llm import bpe
from graphloom.llm import textbytes as tb

BATCH_BYTES = 1 << 20


def lengths(coder: bpe.Coder, texts: list[str | None]) -> np.ndarray:
    """Tokens of each text; no more than one call's ids are held at a time."""
    out = np.zeros(len(texts), np.int64)
    for (_, sizes), rows in bpe.calls(coder, texts):
        np.add.at(out, rows, sizes)
    return out


def token_counts(docs: DataFrame, rank_file: str = bpe.RANK_FILE) -> DataFrame:
    """(doc_id, n_tokens) of every row."""
    ranks = docs.sparkSession.sparkContext.broadcast(bpe.read_ranks(rank_file))

    def run(batches):
        coder = bpe.encoding(ranks.value)
        for batch in batches:
            texts, out = batch["text"], np.zeros(batch.num_rows, np.int64)
            for s in tb.text_slices(texts, lower=False, target=BATCH_BYTES):
                run = slice(s.first, s.first + len(s.offsets) - 1)
                out[run] = lengths(coder, texts[run].to_pylist())
            gone = texts.is_null().to_numpy(zero_copy_only=False)
            yield pa.RecordBatch.from_arrays([batch["doc_id"], pa.array(out, mask=gone)], names=["doc_id", "n_tokens"])

    kinds = f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, n_tokens long"
    return docs.select("doc_id", F.col("text").cast("string").alias("text")).mapInArrow(run, kinds)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts(spark.read.parquet(f"{sf_dir}/documents.parquet"))
