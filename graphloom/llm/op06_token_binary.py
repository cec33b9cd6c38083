"""Token ids in binary: ids ranked by frequency, in a byte-aligned code with separate control bytes.

Ids are replaced by their rank among all of the table's tokens, the most frequent first (ties: the lesser id),
so that most take one byte.  A value takes 1 to 4 bytes, least byte first; a control byte holds the lengths,
less one, of four values in two bits each, the first in the lowest.  Controls and values are columns of their
own, so a decoder finds every value by a look-up in a table of 256 rows and a running sum, without a branch.
The query's result also holds the order, a row (rank, id, count) for each token that occurs, with null in the
documents' columns: order_of() reads it, and decode() needs nothing else.  Every row is decoded again as it is
coded, and exact says whether its ids came out.

Cost at scale: texts are encoded once; ids are kept in a table in the shared folder, of which the frequencies
(a row per id and task, 50,256 in the end) and the code are two scans.  Nothing else is shuffled.

Defined results.  Null text: null columns.  Empty text: no bytes and 0 tokens.  Rows that repeat are coded
each.  Null text: exact is null.  Empty table: empty result.  Other columns are not read, whatever their names.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.checkpoints import cut
from graphloom.llm import bpe
from graphloom.llm import textbytes as tb

BATCH_BYTES = 2 << 20

_LENGTHS = (np.arange(256)[:, None] >> np.arange(0, 8, 2) & 3) + 1
_KEEP = np.arange(4) < np.arange(5)[:, None]  # by length: which bytes of a value are written


def _binary(data: np.ndarray, sizes: np.ndarray, gone: np.ndarray | None = None) -> pa.Array:
    offsets = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)
    valid = None if gone is None or not gone.any() else pa.py_buffer(np.packbits(~gone, bitorder="little").tobytes())
    return pa.Array.from_buffers(pa.binary(), len(sizes), [valid, pa.py_buffer(offsets.tobytes()), pa.py_buffer(np.ascontiguousarray(data).tobytes())])


def pack(values: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(controls, bytes, controls of each row, bytes of each row) of uint32 values, ``counts`` to a row."""
    size = 1 + (values > 0xFF).astype(np.int64) + (values > 0xFFFF) + (values > 0xFFFFFF)
    row = np.repeat(np.arange(len(counts)), counts)
    first = np.concatenate([[0], np.cumsum(counts)[:-1]]) if len(counts) else np.zeros(0, np.int64)
    controls = -(-counts // 4)
    begin = np.concatenate([[0], np.cumsum(controls)[:-1]]) if len(counts) else np.zeros(0, np.int64)
    place = begin[row] * 4 + np.arange(len(values)) - first[row]
    two = np.zeros(int(controls.sum()) * 4, np.uint8)
    two[place] = size - 1
    two = two.reshape(-1, 4)
    raw = values.astype("<u4").view(np.uint8).reshape(-1, 4)[_KEEP[size]]
    return two[:, 0] | two[:, 1] << 2 | two[:, 2] << 4 | two[:, 3] << 6, raw, controls, np.bincount(row, size, len(counts)).astype(np.int64)


def unpack(control: np.ndarray, data: np.ndarray, n: int) -> np.ndarray:
    """The n values of one row, or of rows whose counts are multiples of four."""
    size = _LENGTHS[control].ravel()[:n]
    at = np.cumsum(size) - size
    padded = np.concatenate([data, np.zeros(4, np.uint8)])
    four = np.where(_KEEP[size], padded[at[:, None] + np.arange(4)], 0).astype(np.uint8)
    return np.ascontiguousarray(four).view("<u4").ravel()


def token_table(docs: DataFrame, rank_file: str = bpe.RANK_FILE) -> DataFrame:
    """(doc_id, ids): little-endian 4-byte ids, or of 2 bytes where the vocabulary allows."""
    ranks = docs.sparkSession.sparkContext.broadcast(bpe.read_ranks(rank_file))

    def run(batches):
        coder = bpe.encoding(ranks.value)
        kind = "<u2" if coder.n_vocab <= 1 << 16 else "<u4"
        for batch in batches:
            for s in tb.text_slices(batch["text"], lower=False, target=BATCH_BYTES):
                part = batch.slice(s.first, len(s.offsets) - 1)
                flat, counts = bpe.encode_many(coder, part["text"].to_pylist())
                gone = part["text"].is_null().to_numpy(zero_copy_only=False)
                ids = _binary(flat.astype(kind).view(np.uint8), counts * int(kind[2]), gone)
                width = pa.array(np.full(len(counts), int(kind[2])))
                yield pa.RecordBatch.from_arrays([part["doc_id"], ids, width], names=["doc_id", "ids", "width"])

    kinds = f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, ids binary, width long"
    return docs.select("doc_id", F.col("text").cast("string").alias("text")).mapInArrow(run, kinds)


def _ids(batch) -> np.ndarray:
    data, _ = tb.buffers(batch["ids"])
    return data.view(f"<u{batch['width'][0].as_py()}").astype(np.int64) if batch.num_rows else np.zeros(0, np.int64)


def counted(tokens: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """(ids, counts) in the order of their rank: the most frequent over all rows first, ids that don't occur left out."""
    def count(batches):
        total = np.zeros(0, np.int64)
        for batch in batches:
            got = np.bincount(_ids(batch), minlength=len(total))
            got[: len(total)] += total
            total = got
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int64()), pa.array(total[at], pa.int64())], names=["id", "c"])

    got = tokens.select("ids", "width").mapInArrow(count, "id long, c long").groupBy("id").agg(F.sum("c").alias("c")).toPandas()
    got = got.sort_values(["c", "id"], ascending=[False, True])
    return got["id"].to_numpy(np.int64), got["c"].to_numpy(np.int64)


def ranked(tokens: DataFrame) -> np.ndarray:
    return counted(tokens)[0]


def encode(tokens: DataFrame, order: np.ndarray, check: bool = False) -> DataFrame:
    """(doc_id, n_tokens, control, data), with check also whether decoding gives the ids again (exact)."""
    rank = np.zeros(int(order.max()) + 1 if len(order) else 1, np.uint32)
    rank[order] = np.arange(len(order), dtype=np.uint32)
    shared = tokens.sparkSession.sparkContext.broadcast((rank, order))

    def run(batches):
        for batch in batches:
            for s in tb.slices(*tb.buffers(batch["ids"]), target=BATCH_BYTES):
                part = batch.slice(s.first, len(s.offsets) - 1)
                gone = part["ids"].is_null().to_numpy(zero_copy_only=False)
                counts = np.diff(s.offsets) // (part["width"][0].as_py())
                ids = _ids(part)
                control, data, n_control, n_data = pack(shared.value[0][ids], counts)
                columns = {"doc_id": part["doc_id"], "n_tokens": pa.array(counts, mask=gone), "control": _binary(control, n_control, gone), "data": _binary(data, n_data, gone)}
                if check:
                    ends = np.cumsum(counts)
                    same = [np.array_equal(_decoded(n, c, d, shared.value[1]), ids[b - n : b]) for n, c, d, b in zip(counts, *_raw(columns["control"], columns["data"]), ends)]
                    columns["exact"] = pa.array(np.array(same, bool), mask=gone)
                yield pa.RecordBatch.from_arrays(list(columns.values()), names=list(columns))

    kinds = f"doc_id {tokens.schema['doc_id'].dataType.simpleString()}, n_tokens long, control binary, data binary" + ", exact boolean" * check
    return tokens.mapInArrow(run, kinds)


def _raw(*columns: pa.Array) -> list[list[np.ndarray]]:
    """The bytes of each row."""
    out = []
    for column in columns:
        data, offsets = tb.buffers(column)
        out.append([data[a:b] for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist())])
    return out


def _decoded(n: int, control: np.ndarray, data: np.ndarray, order: np.ndarray) -> np.ndarray:
    return order[unpack(control, data, n)]


def decode(coded: DataFrame, order: np.ndarray) -> DataFrame:
    """(doc_id, tokens): the ids again, given their order by rank."""
    shared = coded.sparkSession.sparkContext.broadcast(order)

    def run(batches):
        for batch in batches:
            rows = []
            for n, control, data in zip(batch["n_tokens"].to_pylist(), *_raw(batch["control"], batch["data"])):
                rows.append(None if n is None else _decoded(n, control, data, shared.value))
            yield pa.RecordBatch.from_arrays([batch["doc_id"], pa.array(rows, pa.list_(pa.int32()))], names=["doc_id", "tokens"])

    return coded.select("doc_id", "n_tokens", "control", "data").mapInArrow(run, f"doc_id {coded.schema['doc_id'].dataType.simpleString()}, tokens array<int>")


def with_order(coded: DataFrame, order: np.ndarray, counts: np.ndarray) -> DataFrame:
    """coded's rows and, with null in their columns, a row (rank, id, count) for each id."""
    table = pa.table({"rank": np.arange(len(order)), "id": order, "count": counts})
    return coded.unionByName(coded.sparkSession.createDataFrame(table, "rank long, id long, count long"), allowMissingColumns=True)


def order_of(result: DataFrame) -> np.ndarray:
    """The order in with_order()'s result."""
    got = result.where("rank IS NOT NULL").select("rank", "id").toPandas()
    return got.sort_values("rank")["id"].to_numpy(np.int64)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    tokens = cut(token_table(spark.read.parquet(f"{sf_dir}/documents.parquet")))
    order, counts = counted(tokens)
    return with_order(encode(tokens, order, check=True), order, counts)
