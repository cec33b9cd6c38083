"""Byte-level BPE encoding and decoding with the tiktoken library.

encode() gives token ids, decode() the bytes they stand for: any list of ids, also one cut inside a
character, decodes to raw bytes.  Many texts are encoded by one call of the library; texts longer than ``bpe.LONG``
in parts cut at safe boundaries, and long runs of white space, which the pattern's look-ahead can't match, as the one
piece that they are, so very long texts of any kind give the ids of whole texts.  Both are one scan without a
shuffle; batches that leave Python are of about ``BATCH_BYTES`` of text.

Defined results.  Null text: null ids; null ids: null bytes.  Empty text: no ids, and back.  Rows that repeat
are done each.  An id outside the vocabulary: an error that names it.  Empty table: empty result.  Other
columns are not read, whatever their names.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.llm import bpe
from graphloom.llm import textbytes as tb

BATCH_BYTES = 4 << 20


def _lists(flat: np.ndarray, counts: np.ndarray, gone: np.ndarray) -> pa.Array:
    offsets = np.concatenate([[0], np.cumsum(counts)]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets, mask=np.append(gone, False)), pa.array(flat.astype(np.int32)))


def _decoded(coder: bpe.Coder, ids: list[int]) -> bytes:
    try:
        return coder.decode_bytes(ids)
    except (KeyError, OverflowError) as e:
        raise ValueError(f"an id outside the vocabulary: {e}") from e


def encode(docs: DataFrame, rank_file: str = bpe.RANK_FILE, check: bool = False) -> DataFrame:
    """(doc_id, tokens, n_tokens), with check also whether decoding gives the text's bytes again (exact)."""
    ranks = docs.sparkSession.sparkContext.broadcast(bpe.read_ranks(rank_file))

    def run(batches):
        coder = bpe.encoding(ranks.value)
        for batch in batches:
            for s in tb.text_slices(batch["text"], lower=False, target=BATCH_BYTES):
                part = batch.slice(s.first, len(s.offsets) - 1)
                gone = part["text"].is_null().to_numpy(zero_copy_only=False)
                flat, counts = bpe.encode_many(coder, part["text"].to_pylist())
                columns = {"doc_id": part["doc_id"], "tokens": _lists(flat, counts, gone), "n_tokens": pa.array(counts.astype(np.int32), mask=gone)}
                if check:
                    ends, size = np.cumsum(counts), np.diff(s.offsets)
                    raw = [s.data[a : a + n].tobytes() for a, n in zip(s.offsets, size)]
                    same = [_decoded(coder, flat[b - n : b].tolist()) == r for b, n, r in zip(ends, counts, raw)]
                    columns["exact"] = pa.array(np.array(same, bool), mask=gone)
                yield pa.RecordBatch.from_arrays(list(columns.values()), names=list(columns))

    kinds = f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, tokens array<int>, n_tokens int" + ", exact boolean" * check
    return docs.select("doc_id", F.col("text").cast("string").alias("text")).mapInArrow(run, kinds)


def decode(encoded: DataFrame, rank_file: str = bpe.RANK_FILE) -> DataFrame:
    """(doc_id, raw): the bytes of each row's tokens."""
    ranks = encoded.sparkSession.sparkContext.broadcast(bpe.read_ranks(rank_file))

    def run(batches):
        coder = bpe.encoding(ranks.value)
        for batch in batches:
            raw = [None if x is None else _decoded(coder, x) for x in batch["tokens"].to_pylist()]
            yield pa.RecordBatch.from_arrays([batch["doc_id"], pa.array(raw, pa.binary())], names=["doc_id", "raw"])

    kinds = f"doc_id {encoded.schema['doc_id'].dataType.simpleString()}, raw binary"
    return encoded.select("doc_id", "tokens").mapInArrow(run, kinds)


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return encode(docs)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode(spark.read.parquet(f"{sf_dir}/documents.parquet"), check=True)
