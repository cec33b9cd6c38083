"""Benchmark decontamination: rare n-gram seeds, then Smith-Waterman alignment of words.

A seed is a run of ``SEED`` words of a test item that is rare: the product of its words' rates in the whole
corpus is at most ``RATE``.  (Rates of single words, and not counts of the run itself, so that a passage
copied into thousands of documents keeps its seeds.)  Besides, every ``SEED``-th run of an item is a seed, however
common, so a copy whose rare words were changed is found by what stands between them: one that keeps any five words
in a row has a seed.  The seed of an item of fewer words than ``SEED`` is all of it.
Wherever a document has a seed, the words around it are aligned with the item: +2 for a match, -1 for a
mismatch, -1 for each word left out on either side.  The score is the best local alignment over twice the
item's words, 1 for a whole copy; ``SCORE`` or more is a leak, so copies with words changed, added or left out,
split over lines or broken by symbols are found as well.  A copy in which no seed is left whole is not found.
Before it is aligned, a stretch must hold as many of the item's words as the score needs; none that could reach it is
left out.

Cost at scale: two scans of the texts, no shuffle of them; what is shuffled is a row for each word of the
benchmark per task, then one for each leak.  The items are broadcast; of a benchmark beyond ``SHARD_BYTES``
each part of that size gets scans of its own, so that no task holds more.  Hits of seeds are merged to windows
``_HITS`` at a time, and wide windows are aligned in overlapping pieces, so memory doesn't grow with how often a
text repeats the words that items share.

Defined results.  Null or empty texts, and items without words, match nothing.  Rows that share a
doc_id, or items that share an item_id, give one row with the best score.  A null id stands as null.  Very long
texts are read whole, in slices of their own.  A score of just ``SCORE`` is a leak.  Empty tables give an empty result.  Other columns are not read, and clean() passes them on as they are.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.llm import textbytes as tb

SEED, RATE, SCORE = 3, 1e-8, 0.5
SHARD_BYTES = 64 << 20
MATCH, MISS, GAP = 2, -1, -1
_CELLS = 1 << 21  # window words aligned at a time
_HITS = 1 << 19  # hits merged at a time


class Items:
    """The words of a benchmark's items, one after the other."""

    def __init__(self, ids: list, texts: pa.Array):
        hashes, lengths = [], []
        for s in tb.text_slices(texts):
            w = tb.words(s)
            hashes.append(w.hash)
            lengths.append(np.diff(w.first))
        self.ids = ids
        self.words = np.concatenate(hashes) if hashes else np.zeros(0, np.uint64)
        self.length = np.concatenate(lengths) if lengths else np.zeros(0, np.int64)
        self.first = np.concatenate([[0], np.cumsum(self.length)]).astype(np.int64)
        self.seeds: list[Seeds] = []
        self.pairs = tb.Keys(_pair(np.repeat(np.arange(len(self.length)), self.length), self.words))

    def seed(self, vocabulary: np.ndarray, counts: np.ndarray, total: int, rate: float) -> Items:
        """Choose the seeds, given how often each word of the vocabulary stands in the corpus."""
        item = np.repeat(np.arange(len(self.length)), self.length)
        w = tb.Words(item, item, item, self.words, self.first)
        p = counts[np.searchsorted(vocabulary, self.words)] / max(total, 1) if len(self.words) else np.zeros(0)
        for k in range(1, SEED + 1):
            h, at = tb.ngrams(w, k)
            own = self.length[item[at]]
            use = own >= SEED if k == SEED else own == k
            h, at = h[use], at[use]
            if not len(at):
                continue
            odds = np.prod([p[at + j] for j in range(k)], axis=0)
            use = (odds <= rate) | ((at - self.first[item[at]]) % SEED == 0)
            self.seeds.append(Seeds(k, h[use], item[at[use]], at[use] - self.first[item[at[use]]]))
        return self

    def windows(self, w: tb.Words):
        """(row, item, first word, last word + 1) of the stretches that hold seeds of an item."""
        found = [np.zeros((4, 0), np.int64)]
        for s in self.seeds:
            h, at = tb.ngrams(w, s.words)
            hit, key = s.keys.find(h)
            n = s.of_key[key + 1] - s.of_key[key]
            ends = np.cumsum(n)
            a = 0
            while a < len(hit):
                b = max(a + 1, int(np.searchsorted(ends, (ends[a - 1] if a else 0) + _HITS, side="right")))
                k = np.repeat(s.of_key[key[a:b]] - ends[a:b] + n[a:b], n[a:b]) + np.arange(ends[a] - n[a], ends[b - 1])
                word, item = np.repeat(at[hit[a:b]], n[a:b]), s.item[k]
                size, row = self.length[item], w.row[word]
                lo = np.maximum(word - s.last[k] - size // 2, w.first[row])
                hi = np.minimum(word - s.first[k] + size + size // 2, w.first[row + 1])
                found.append(_merged(np.stack([row, item, lo, hi])))
                a = b
        row, item, lo, hi = _merged(np.concatenate(found, axis=1))
        # an alignment that scores anything spans at most three times the item's words
        step, reach = 5 * self.length[item], 3 * self.length[item]
        n = np.maximum(1, -(-(hi - lo - reach) // np.maximum(step, 1)))
        at = np.repeat(lo - step * (np.cumsum(n) - n), n) + np.repeat(step, n) * np.arange(n.sum())
        return np.repeat(row, n), np.repeat(item, n), at, np.minimum(np.repeat(hi, n), at + np.repeat(step + reach, n))


    def likely(self, w: tb.Words, item: np.ndarray, lo: np.ndarray, hi: np.ndarray, least: float) -> np.ndarray:
        """Whether so much of a window's words are the item's that an alignment may score ``least``."""
        n, out = hi - lo, np.zeros(len(item), np.int64)
        ends, a = np.cumsum(n), 0
        while a < len(item):
            b = max(a + 1, int(np.searchsorted(ends, (ends[a - 1] if a else 0) + _CELLS, side="right")))
            of = np.repeat(np.arange(a, b), n[a:b])
            word = np.repeat(lo[a:b] - ends[a:b] + n[a:b], n[a:b]) + np.arange(ends[a] - n[a], ends[b - 1])
            hit, _ = self.pairs.find(_pair(item[of], w.hash[word]))
            out[a:b] = np.bincount(of[hit] - a, minlength=b - a)
            a = b
        return out >= least * self.length[item] - 1e-9


def _pair(item: np.ndarray, word: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        return tb.mix(word + (item.astype(np.uint64) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15))


class Seeds:
    """Runs of so many words: for each, the items that hold it, with its first and last place in them."""

    def __init__(self, words: int, h: np.ndarray, item: np.ndarray, place: np.ndarray):
        self.words, self.keys = words, tb.Keys(h)
        key = np.searchsorted(self.keys.sorted, h)
        by = np.lexsort((place, item, key))
        key, item, place = key[by], item[by], place[by]
        start = np.flatnonzero(np.append(True, (key[1:] != key[:-1]) | (item[1:] != item[:-1])))
        self.item, self.first, self.last = item[start], place[start], place[np.append(start[1:], len(place)) - 1]
        self.of_key = np.searchsorted(key[start], np.arange(len(self.keys.sorted) + 1))


def _merged(windows: np.ndarray) -> np.ndarray:
    """Windows (row, item, lo, hi) in order, those of a row and item that overlap made one."""
    if not windows.shape[1]:
        return windows
    row, item, lo, hi = windows[:, np.lexsort((windows[2], windows[1], windows[0]))]
    new = np.append(True, (row[1:] != row[:-1]) | (item[1:] != item[:-1]))
    # the furthest end so far of the same row and item: groups are raised one above the other
    group = np.cumsum(new) - 1
    far = np.maximum.accumulate(hi + group * (int(hi.max()) + 1)) - group * (int(hi.max()) + 1)
    new[1:] |= lo[1:] > far[:-1]
    start = np.flatnonzero(new)
    return np.stack([row[start], item[start], lo[start], np.maximum.reduceat(hi, start)])


def align(items: list[np.ndarray], windows: list[np.ndarray]) -> np.ndarray:
    """The best local alignment's score for each (item, window); pairs of like size are done together."""
    out = np.zeros(len(items), np.int64)
    by = np.lexsort(([len(x) for x in items], [len(x) for x in windows]))
    a = 0
    while a < len(by):
        wide, b = 0, a
        while b < len(by) and (b == a or max(wide, len(windows[by[b]])) * (b - a + 1) <= _CELLS):
            wide = max(wide, len(windows[by[b]]))
            b += 1
        batch = by[a:b]
        tall = max(len(items[k]) for k in batch)
        x, y = np.zeros((len(batch), tall), np.uint64), np.zeros((len(batch), wide), np.uint64)
        in_x, in_y = np.zeros(x.shape, bool), np.zeros(y.shape, bool)
        for r, k in enumerate(batch):
            x[r, : len(items[k])], y[r, : len(windows[k])] = items[k], windows[k]
            in_x[r, : len(items[k])], in_y[r, : len(windows[k])] = True, True
        slope = np.arange(wide, dtype=np.int32) * -GAP
        h, best = np.zeros(y.shape, np.int32), np.zeros(len(batch), np.int32)
        for i in range(tall):
            s = np.where((y == x[:, i, None]) & in_y & in_x[:, i, None], MATCH, MISS).astype(np.int32)
            t = np.maximum(h + GAP, 0)
            t[:, 1:] = np.maximum(t[:, 1:], h[:, :-1] + s[:, 1:])
            t[:, 0] = np.maximum(t[:, 0], s[:, 0])
            h = np.maximum.accumulate(t + slope, axis=1) - slope  # runs of words left out of the item
            best = np.maximum(best, h.max(axis=1, initial=0))
        out[batch] = best
        a = b
    return out


def best_scores(texts: pa.Array, items: Items, least: float = 0.0) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, item, score) of every row and item that share a seed; pairs that can't reach ``least`` may be left out."""
    rows, which, scores = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], [np.zeros(0)]
    for s in tb.text_slices(texts):
        w = tb.words(s)
        row, item, lo, hi = items.windows(w)
        likely = items.likely(w, item, lo, hi, least)
        row, item, lo, hi = row[likely], item[likely], lo[likely], hi[likely]
        if not len(row):
            continue
        windows = [w.hash[a:b] for a, b in zip(lo.tolist(), hi.tolist())]
        got = align([items.words[items.first[k] : items.first[k + 1]] for k in item.tolist()], windows)
        by = np.lexsort((item, row))
        row, item, got = row[by], item[by], got[by]
        start = np.flatnonzero(np.append(True, (row[1:] != row[:-1]) | (item[1:] != item[:-1])))
        rows.append(row[start] + s.first)
        which.append(item[start])
        scores.append(np.maximum.reduceat(got, start) / (MATCH * items.length[item[start]]))
    return np.concatenate(rows), np.concatenate(which), np.concatenate(scores)


def _counter(vocabulary: np.ndarray):
    def count(batches):
        keys = tb.Keys(vocabulary)
        total, n = np.zeros(len(vocabulary), np.int64), 0
        for batch in batches:
            for s in tb.text_slices(batch["text"]):
                h = tb.words(s).hash
                total += np.bincount(keys.find(h)[1], minlength=len(vocabulary))
                n += len(h)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(np.append(at, -1)), pa.array(np.append(total[at], n))], names=["w", "c"])

    return count


def seeded(docs: DataFrame, benchmark: DataFrame, rate: float = RATE, shard_bytes: int = SHARD_BYTES) -> list:
    """The benchmark's parts, as broadcasts, each with its seeds chosen by the words' rates over all of docs."""
    bench = benchmark.select("item_id", F.col("text").cast("string").alias("text")).where("text is not null")
    shards = -(-(bench.agg(F.sum(F.octet_length("text"))).first()[0] or 0) // shard_bytes)
    out = []
    for k in range(shards):
        part = bench.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(shards)) == k).toArrow()
        items = Items(part["item_id"].to_pylist(), part["text"].combine_chunks())
        vocabulary = np.unique(items.words)
        counts, total = np.zeros(len(vocabulary)), 0
        got = docs.select(F.col("text").cast("string")).mapInArrow(_counter(vocabulary), "w long, c long").groupBy("w").agg(F.sum("c").alias("c"))
        for w, c in got.toPandas().itertuples(index=False):
            if w < 0:
                total = c
            else:
                counts[w] = c
        out.append(docs.sparkSession.sparkContext.broadcast(items.seed(vocabulary, counts, total, rate)))
    return out


def leaks(docs: DataFrame, benchmark: DataFrame, score: float = SCORE, rate: float = RATE, shard_bytes: int = SHARD_BYTES) -> DataFrame:
    """(doc_id, item_id, score): the documents that hold a test item, with the items."""
    kinds = f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, item_id {benchmark.schema['item_id'].dataType.simpleString()}, score double"

    def scan(part):
        def run(batches):
            items = part.value
            for batch in batches:
                row, item, got = best_scores(batch["text"], items, score)
                at = got >= score
                yield pa.RecordBatch.from_arrays([batch["doc_id"].take(pa.array(row[at])), pa.array([items.ids[k] for k in item[at]], kind), pa.array(got[at])], names=["doc_id", "item_id", "score"])

        return docs.select("doc_id", F.col("text").cast("string").alias("text")).mapInArrow(run, kinds)

    from pyspark.sql.pandas.types import to_arrow_type

    kind = to_arrow_type(benchmark.schema["item_id"].dataType)
    found = [scan(p) for p in seeded(docs, benchmark, rate, shard_bytes)]
    if not found:
        return docs.sparkSession.createDataFrame([], kinds)
    return reduce(DataFrame.union, found).groupBy("doc_id", "item_id").agg(F.round(F.max("score"), 4).alias("score"))


def clean(docs: DataFrame, benchmark: DataFrame, score: float = SCORE) -> DataFrame:
    """docs without the rows that hold a test item; the rest as they are."""
    def keep(part):
        def run(batches):
            for batch in batches:
                row, _, got = best_scores(batch["text"].cast(pa.string()), part.value, score)
                stay = np.ones(batch.num_rows, bool)
                stay[row[got >= score]] = False
                yield batch.filter(pa.array(stay))

        return run

    out = docs
    for part in seeded(docs, benchmark):
        out = out.mapInArrow(keep(part), docs.schema)
    return out


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return clean(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return leaks(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
