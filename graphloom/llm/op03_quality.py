"""Quality classifier: histogram gradient-boosted trees over statistics of a document's whole text.

The statistics are shares of kinds of bytes, lengths, repetition of words, word pairs and lines, and how many
of the words are in a lexicon of words that toxic documents use and others don't, learnt from the same labels.
A document is good if it was labelled quality 1 and toxic 0; one whose chance of that is under ``KEEP`` is
rejected.

Training uses a bounded sample: the ``SAMPLE`` labelled documents with the least hash of their doc_id (equal hashes by
the lesser doc_id), as far as their texts come to no more than ``SAMPLE_BYTES``.  It is done on the driver; scoring is
one scan without a shuffle, in numpy over Arrow buffers.

Defined results.  Null texts count as empty ones and are scored like them.  Rows that repeat are scored each; of a
labelled document with several texts the least is learnt from.  Labels that are null are left out; a document labelled
twice takes the worse label.  A score of just ``KEEP`` is kept.  Without labels of both kinds everything is kept with
score 1.  Very long texts are scored whole, in slices of their own.  Empty table: empty result.  Columns besides
doc_id and text are passed on by keep() as they are, whatever their names.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from graphloom.checkpoints import cut, discard
from graphloom.llm import textbytes as tb
from graphloom.llm import trees

SAMPLE, SAMPLE_BYTES, KEEP = 8000, 64 << 20, 0.5
LEAST_DOCS, LEAST_Z = 3, 4.0  # a lexicon word: in so many toxic documents, and so many deviations above its share

_KIND = np.full(256, 4, np.int8)  # 0 lower, 1 upper, 2 digit, 3 space, 4 sign, 5 newline, 6 full stop or comma, 7 not ASCII
for _k, _set in ((0, range(97, 123)), (1, range(65, 91)), (2, range(48, 58)), (3, (9, 13, 32)), (5, (10,)), (6, (44, 46)), (7, range(128, 256))):
    _KIND[[*_set]] = _k
FEATURES = 24


def _distinct(h: np.ndarray, row: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """(distinct values, most repeats of one value) of each row."""
    if not len(h):
        return np.zeros(n), np.zeros(n)
    key = np.sort(tb.row_keys(h, row))
    start = tb.firsts(key)
    own = (key[start] >> np.uint64(44)).astype(np.int64)
    first = np.flatnonzero(np.append(True, own[1:] != own[:-1]))
    most = np.zeros(n)
    most[own[first]] = np.maximum.reduceat(np.diff(np.append(start, len(key))), first)
    return np.bincount(own, minlength=n).astype(float), most


def _per_row(mask: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """How many of a row's bytes are set, by the places of those that are."""
    return np.diff(np.searchsorted(np.flatnonzero(mask), offsets))


def statistics(texts: pa.Array, lexicon: tb.Keys) -> np.ndarray:
    """rows x FEATURES."""
    out = np.zeros((len(texts), FEATURES))
    for s, plain in zip(tb.text_slices(texts), _same_rows(texts)):
        n = len(s.offsets) - 1
        kind = _KIND[plain.data]
        other = [_per_row(kind == k, plain.offsets) for k in range(1, 8)]
        kinds = np.stack([np.diff(plain.offsets) - sum(other), *other], axis=1).astype(float)
        size = np.maximum(np.diff(plain.offsets), 1)
        w = tb.words(s)
        count = np.diff(w.first).astype(float)
        some = np.maximum(count, 1)
        pairs, at = tb.ngrams(w, 2)
        words, top_word = _distinct(w.hash, w.row, n)
        two, top_pair = _distinct(pairs, w.row[at], n)
        ends = np.flatnonzero(s.data == 10) + 1
        ends = np.unique(np.concatenate([ends, s.offsets[1:]]))
        starts = np.concatenate([[0], ends[:-1]])[: len(ends)]
        full = ends > starts
        line_row = np.searchsorted(s.offsets, starts[full], side="right") - 1
        lines, top_line = _distinct(tb.span_hash(s.data, starts[full], ends[full]), line_row, n)
        n_lines = np.maximum(np.bincount(line_row, minlength=n), 1)
        bad = np.bincount(w.row[lexicon.find(w.hash)[0]], minlength=n)
        marks = lambda c: _per_row(plain.data == c, plain.offsets)
        long = np.bincount(w.row, (w.end - w.start) >= 12, n)
        x = [np.log1p(size), np.log1p(count), *(kinds / size[:, None]).T, kinds[:, 1] / np.maximum(kinds[:, :2].sum(axis=1), 1), kinds[:, 4] / some, marks(124) / some, marks(33) / some, words / some, top_word / some, two / np.maximum(count - 1, 1), top_pair / np.maximum(count - 1, 1), lines / n_lines, top_line / n_lines, long / some, np.log1p(bad), bad / some, kinds[:, 2] / some]
        out[s.first : s.first + n] = np.stack(x, axis=1)
    return out


def _same_rows(texts: pa.Array):
    """Slices of the texts as written, of the same rows as those of their lower-cased form."""
    data, offsets = tb.buffers(texts)
    for s in tb.text_slices(texts):
        a, b = s.first, s.first + len(s.offsets) - 1
        yield tb.Slice(a, data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a])


def lexicon_of(texts: pa.Array, toxic: np.ndarray) -> tb.Keys:
    hashes, rows = [], []
    for s in tb.text_slices(texts):
        w = tb.words(s)
        key = tb.row_keys(w.hash, w.row)
        order = np.argsort(key)
        at = order[tb.firsts(key[order])]  # each word of a document once
        hashes.append(w.hash[at])
        rows.append((w.row[at] + s.first).astype(np.int32))
    if not hashes or not toxic.any():
        return tb.Keys(np.zeros(0, np.uint64))
    h, r = np.concatenate(hashes), np.concatenate(rows)
    del hashes, rows
    if not len(h):
        return tb.Keys(h)
    by = np.argsort(h)
    h, r = h[by], r[by]
    start = np.flatnonzero(np.append(True, h[1:] != h[:-1]))
    docs, bad = np.diff(np.append(start, len(h))), np.add.reduceat(toxic[r].astype(np.int64), start)
    expected = docs * toxic.mean()
    return tb.Keys(h[start[(bad >= LEAST_DOCS) & (bad > docs / 2) & ((bad - expected) / np.sqrt(expected) >= LEAST_Z)]])


class Model:
    """The lexicon and the trees; without labels of both kinds, one that keeps everything."""

    def __init__(self, texts: pa.Array, quality: np.ndarray, toxic: np.ndarray):
        good = (quality == 1) & (toxic == 0)
        self.lexicon, self.trees = lexicon_of(texts, toxic == 1), None
        if good.all() or not good.any():
            return
        x, half = np.zeros((len(good), FEATURES)), np.arange(len(good)) % 2
        for k in (0, 1):  # the lexicon that a document is measured with in training comes from the others
            other = lexicon_of(texts.filter(pa.array(half != k)), (toxic == 1)[half != k])
            x[half == k] = statistics(texts.filter(pa.array(half == k)), other)
        self.trees = trees.boost(x, good.astype(float))

    def scores(self, texts: pa.Array) -> np.ndarray:
        if self.trees is None:
            return np.ones(len(texts))
        return trees.chance(self.trees.sums(statistics(texts, self.lexicon)))


def sample(docs: DataFrame, labels: DataFrame, rows: int = SAMPLE, size: int = SAMPLE_BYTES) -> pa.Table:
    """Up to ``rows`` labelled documents, by the least hashes of their doc_id, of no more than ``size`` bytes in all."""
    labels = labels.where("doc_id is not null and quality is not null and toxic is not null").groupBy(F.col("doc_id").alias("_id"))
    labels = labels.agg(F.min("quality").alias("_q"), F.max("toxic").alias("_t"))
    texts = docs.select(F.col("doc_id").alias("_id"), F.col("text").cast("string").alias("_text"))
    chosen = labels.orderBy(F.xxhash64("_id"), "_id").limit(rows)
    found = cut(texts.join(F.broadcast(chosen), "_id").groupBy("_id", "_q", "_t").agg(F.min("_text").alias("_text")))
    upto = F.sum(F.coalesce(F.octet_length("_text"), F.lit(0))).over(Window.orderBy(F.xxhash64("_id"), "_id"))  # of ``rows`` rows
    fit = found.select("_id", upto.alias("_upto")).where(F.col("_upto") <= size).select("_id")
    got = found.join(F.broadcast(fit), "_id", "left_semi").toArrow().sort_by("_id")
    discard(found)
    return got


def train(docs: DataFrame, labels: DataFrame, rows: int = SAMPLE) -> Model:
    got = sample(docs, labels, rows)
    model = Model(got["_text"].combine_chunks(), got["_q"].to_numpy(), got["_t"].to_numpy())
    del got
    pa.default_memory_pool().release_unused()  # the driver has other work to do
    return model


def keep(docs: DataFrame, model: Model, least: float = KEEP) -> DataFrame:
    """docs without the rejected rows."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        for batch in batches:
            yield batch.filter(pa.array(shared.value.scores(batch["text"]) >= least))

    return docs.mapInArrow(run, docs.schema)


def scored(docs: DataFrame, model: Model, least: float = KEEP) -> DataFrame:
    """(doc_id, score) of the rows that are kept."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        for batch in batches:
            score = shared.value.scores(batch["text"])
            yield pa.RecordBatch.from_arrays([batch["doc_id"], pa.array(score.round(6))], names=["doc_id", "score"]).filter(pa.array(score >= least))

    kinds = f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, score double"
    return docs.select("doc_id", F.col("text").cast("string").alias("text")).mapInArrow(run, kinds)


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return keep(docs, train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return scored(docs, train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))
