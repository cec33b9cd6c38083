"""Near duplicates by SimHash and the generalised pigeonhole principle.

Two documents are near duplicates when their 128-bit fingerprints differ in at most ``RADIUS`` bits and the
smaller of their counts of distinct words is at least ``RATIO`` of the larger.  Groups are the connected
components of that relation, and the least doc_id of each group stays.

The 128 bits are grouped into eight partitions, correlated bits together.  With thresholds t_1..t_8 that sum
to RADIUS - 8 + 1, two fingerprints within RADIUS are within t_i in at least one partition, so probing every
partition for values within t_i and verifying the whole fingerprint finds every pair: recall is 1.  Dynamic
programming picks the thresholds (-1: not probed) that make the fewest candidates, from the numbers of pairs
at each distance in each partition.  Those come from histograms of the partitions' values over all documents:
a Walsh-Hadamard transform gives the pairs at each XOR, hence at each distance.

Cost at scale: texts never leave the first scan.  After it a document is a row of 36 bytes, and equal fingerprints
are merged by an aggregation.  The rest are joined by (partition, value): the values of a partition are cut into
cells by their leading bits, a row goes to its own cell and, as a probe, to the lesser cells within the threshold,
and a task holds one cell.  The number of leading bits comes from the histograms and is such that a cell has about
``CELL`` rows, up to all 16, so a row is sent at most 8 x 69 times at thresholds of 2, however many rows there are.
Cells that are larger still, by skewed values, are salted: cut into chunks of which each pair is a task.  A task
verifies only pairs of rows of like length, returns a spanning forest of its near duplicates, never all pairs, and
passes over pairs that are joined already, so a group of thousands of copies costs as many edges as it has members.
The number of candidates, unlike that of rows sent, is a fixed share of all pairs (1.5 % of those of like length for
independent bits at radius 22, 0.2 % at radius 15, 0.01 % at radius 7), so verifying grows with the square of the
number of different fingerprints; a lesser radius is the remedy.

Very long texts are read in slices (simbits), and give a row like any other.

Defined results.  Null text: never grouped.  Text without words: grouped with equal texts only.  Null doc_id:
never grouped.  Rows that share a doc_id are one document: all stay or all go.  Empty table: empty result.
Other columns are neither read nor changed, whatever their names.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.checkpoints import cut, discard
from graphloom.llm import simbits
from graphloom.llm import textbytes as tb
from graphloom.llm.components import components

RADIUS, RATIO, PARTS, CELL, BROADCAST_IDS = 22, 0.8, 8, 1 << 20, 4_000_000
WIDTH = simbits.BITS // PARTS
HEAVY = 1 << 12  # pairs of two runs of equal values beyond which those already joined are passed over
_PAIRS = 1 << 21  # pairs handled at a time
SKETCH = "doc_id long, f1 long, f2 long, n int"
SENT = "task long, second boolean, rep long, f1 long, f2 long, n int"


def sketch_batches(batches):
    for batch in batches:
        fp, n = simbits.fingerprints(batch["text"])
        for s in tb.text_slices(batch["text"], lower=False) if (n == 0).any() else ():
            rows = np.flatnonzero((n[s.first : s.first + len(s.offsets) - 1] == 0) & (np.diff(s.offsets) > 0))
            h = tb.span_hash(s.data, s.offsets[rows], s.offsets[rows + 1])
            fp[rows + s.first] = np.stack([h, tb.mix(h + np.uint64(1))], axis=1)
        kept = pc.and_(pc.is_valid(batch["text"]), pc.is_valid(batch["doc_id"]))
        out = pa.RecordBatch.from_arrays([batch["doc_id"], pa.array(fp[:, 0].view(np.int64)), pa.array(fp[:, 1].view(np.int64)), pa.array(n.astype(np.int32))], names=["doc_id", "f1", "f2", "n"])
        yield out.filter(kept)


def sketches(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(sketch_batches, SKETCH)


def _fps(table) -> np.ndarray:
    return np.stack([np.asarray(table[c]).view(np.uint64) for c in ("f1", "f2")], axis=1)


def _bits(fp: np.ndarray) -> np.ndarray:
    return np.unpackbits(np.ascontiguousarray(fp).view(np.uint8).reshape(len(fp), 16), axis=1)


def parts(fp: np.ndarray, order: np.ndarray) -> np.ndarray:
    """rows x PARTS values of the partitions, whose bits ``order`` lists one partition after the other."""
    return np.ascontiguousarray(np.packbits(_bits(fp)[:, order], axis=1)).view(np.uint16)


def bit_counts(batches):
    """(i, j, documents with both bits), for i <= j; i = j = -1 counts documents."""
    both, n = np.zeros((simbits.BITS, simbits.BITS)), 0
    for b in batches:
        x = _bits(_fps(b)).astype(np.float32)
        both += x.T @ x
        n += len(x)
    i, j = np.triu_indices(simbits.BITS)
    yield pa.RecordBatch.from_arrays([pa.array(np.append(i, -1).astype(np.int32)), pa.array(np.append(j, -1).astype(np.int32)), pa.array(np.append(both[i, j], n).astype(np.int64))], names=["i", "j", "c"])


def group_bits(both: np.ndarray, n: int) -> np.ndarray:
    """Bits in the order of their partitions: each is grown from the bit least like the rest by the bit most correlated with it."""
    if n < 2:
        return np.arange(simbits.BITS)
    p = np.diag(both) / n
    sd = np.sqrt(np.maximum(p * (1 - p), 1e-12))
    like = np.abs((both / n - np.outer(p, p)) / np.outer(sd, sd)).round(9)
    np.fill_diagonal(like, 0)
    left, order = list(range(simbits.BITS)), []
    while left:
        sub = like[np.ix_(left, left)]
        own = [left.pop(int(np.argmax(sub.max(axis=1))))]
        while len(own) < WIDTH:
            own.append(left.pop(int(np.argmax(like[np.ix_(left, own)].mean(axis=1)))))
        order += own
    return np.array(order)


def value_counts(order: np.ndarray):
    def count(batches):
        total = np.zeros((PARTS, 1 << WIDTH), np.int64)
        for b in batches:
            v = parts(_fps(b), order)
            for p in range(PARTS):
                total[p] += np.bincount(v[:, p], minlength=1 << WIDTH)
        p, v = np.nonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(p.astype(np.int32)), pa.array(v.astype(np.int32)), pa.array(total[p, v])], names=["p", "v", "c"])

    return count


def pairs_within(counts: np.ndarray) -> np.ndarray:
    """PARTS x (WIDTH + 1): ordered pairs at each distance or less in each partition, by a Walsh-Hadamard transform."""
    x = counts.astype(np.float64)
    h = 1
    while h < x.shape[1]:
        y = x.reshape(len(x), -1, 2, h)
        x = np.stack([y[:, :, 0] + y[:, :, 1], y[:, :, 0] - y[:, :, 1]], axis=2).reshape(len(x), -1)
        h *= 2
    x = x**2
    h = 1
    while h < x.shape[1]:
        y = x.reshape(len(x), -1, 2, h)
        x = np.stack([y[:, :, 0] + y[:, :, 1], y[:, :, 0] - y[:, :, 1]], axis=2).reshape(len(x), -1)
        h *= 2
    at = np.bitwise_count(np.arange(x.shape[1], dtype=np.uint32))
    per = np.stack([np.bincount(at, weights=row, minlength=WIDTH + 1) for row in x / x.shape[1]])
    return np.cumsum(per, axis=1)


def allocate(within: np.ndarray, radius: int) -> list[int]:
    """Thresholds of -1 to WIDTH that sum to radius - PARTS + 1 and make the fewest candidates and probes."""
    probes = np.cumsum([_choose(WIDTH, d) for d in range(WIDTH + 1)])
    cost = np.hstack([np.zeros((len(within), 1)), within + probes * 256.0])  # column t + 1
    need = radius + 1  # sum of t + 1
    best, back = np.full(need + 1, np.inf), []
    best[0] = 0
    for p in range(len(within)):
        new, how = np.full(need + 1, np.inf), np.zeros(need + 1, int)
        for t in range(WIDTH + 2):
            for s in range(t, need + 1):
                if best[s - t] + cost[p, t] < new[s]:
                    new[s], how[s] = best[s - t] + cost[p, t], t
        best, back = new, [*back, how]
    out, s = [], need
    for how in reversed(back):
        out.append(int(how[s]) - 1)
        s -= how[s]
    return out[::-1]


def _choose(n: int, k: int) -> int:
    return reduce(lambda x, i: x * (n - i) // (i + 1), range(k), 1)


def band(n: np.ndarray) -> np.ndarray:
    """Counts within RATIO of each other are in the same band or in neighbouring ones."""
    return np.floor(np.log(n) / np.log(1 / RATIO) + 1e-9).astype(np.int64)


def _cross(lo_a, n_a, lo_b, n_b):
    """Index pairs of the crosses of runs a_i with runs b_i, about _PAIRS at a time."""
    size = n_a * n_b
    ends = np.cumsum(size)
    total = int(ends[-1]) if len(ends) else 0
    for a in range(0, total, _PAIRS):
        k = np.arange(a, min(a + _PAIRS, total))
        lo, hi = np.searchsorted(ends, k[0], side="right"), np.searchsorted(ends, k[-1], side="right") + 1
        run = np.repeat(np.arange(lo, hi), np.minimum(ends[lo:hi], k[-1] + 1) - np.maximum(ends[lo:hi] - size[lo:hi], k[0]))
        within = k - (ends[run] - size[run])
        yield lo_a[run] + within // n_b[run], lo_b[run] + within % n_b[run]


def _settle(label: np.ndarray, x: np.ndarray, y: np.ndarray) -> None:
    """Union by edges (x, y): label becomes the least index of each component."""
    while len(x):
        a, b = label[x], label[y]
        far = a != b
        x, y, a, b = x[far], y[far], a[far], b[far]
        np.minimum.at(label, np.maximum(a, b), np.minimum(a, b))
        while True:
            deeper = label[label]
            if np.array_equal(deeper, label):
                break
            label[:] = deeper


class Cells:
    """How rows are sent to tasks: partition p's values are in cells by their leading ``bits`` bits.

    A pair of rows whose values are within the threshold is met in the cell of the one with the lesser leading
    bits.  ``chunks[p][u]`` is the number of chunks that a cell's rows are cut into.
    """

    def __init__(self, counts: np.ndarray, order: np.ndarray, limits: list[int], cell: int):
        self.order, self.limits = order, limits
        for self.bits in range(WIDTH + 1):
            held = {p: self._held(counts[p], p) for p, t in enumerate(limits) if t >= 0}
            if all(h.sum() <= cell << self.bits for h in held.values()):
                break
        self.chunks = {p: np.maximum(1, -(-h // cell)) for p, h in held.items()}

    def masks(self, p: int) -> list[int]:
        return [m for m in range(1 << self.bits) if m.bit_count() <= self.limits[p]]

    def _held(self, counts: np.ndarray, p: int) -> np.ndarray:
        """Rows of each cell: its own and those that probe it."""
        own = counts.reshape(1 << self.bits, -1).sum(axis=1)
        u = np.arange(len(own))
        return sum(np.where((u ^ m) >= u, own[u ^ m], 0) for m in self.masks(p))

    def send(self, batches):
        """Rows of SENT: task holds partition, cell and two chunks; second says that the row is of the second of them."""
        for batch in batches:
            fp = _fps(batch)
            values, salt = parts(fp, self.order), tb.mix(np.asarray(batch["rep"]).view(np.uint64))
            for p, chunks in self.chunks.items():
                u = values[:, p].astype(np.int64) >> (WIDTH - self.bits)
                to, row = [], []
                for m in self.masks(p):
                    at = np.flatnonzero((u ^ m) <= u)
                    to.append(u[at] ^ m)
                    row.append(at)
                to, row = np.concatenate(to), np.concatenate(row)
                n = chunks[to]
                own = (salt[row] % n.astype(np.uint64)).astype(np.int64)
                to, row, own = np.repeat(to, n), np.repeat(row, n), np.repeat(own, n)
                other = np.arange(len(to)) - np.repeat(np.cumsum(n) - n, n)
                task = ((np.int64(p) << 16 | to) << 20 | np.minimum(own, other)) << 20 | np.maximum(own, other)
                for a in range(0, len(task), 1 << 16):
                    some = batch.select(["rep", "f1", "f2", "n"]).take(pa.array(row[a : a + (1 << 16)]))
                    head = [pa.array(task[a : a + (1 << 16)]), pa.array(own[a : a + (1 << 16)] > other[a : a + (1 << 16)])]
                    yield pa.RecordBatch.from_arrays([*head, *some.columns], names=["task", "second", "rep", "f1", "f2", "n"])

    def search(self, radius: int):
        def run(table: pa.Table) -> pa.Table:
            if table.num_rows < 2:
                return table.select(["rep", "rep"]).rename_columns(["a", "b"]).slice(0, 0)
            table = table.combine_chunks()
            task = table["task"][0].as_py()
            p, u, across = task >> 56, task >> 40 & 0xFFFF, task >> 20 & 0xFFFFF != task & 0xFFFFF
            ids, fp, n = np.asarray(table["rep"]), _fps(table), np.asarray(table["n"]).astype(np.int64)
            second = table["second"].to_numpy() if across else None
            label = near_forest(fp, n, parts(fp, self.order)[:, p].astype(np.int64), u, WIDTH - self.bits, self.limits[p], second, radius)
            at = np.flatnonzero(label != np.arange(len(label)))
            return pa.table({"a": pa.array(ids[at], pa.int64()), "b": pa.array(ids[label[at]], pa.int64())})

        return run


def near_forest(fp: np.ndarray, n: np.ndarray, value: np.ndarray, u: int, shift: int, limit: int, second: np.ndarray | None, radius: int) -> np.ndarray:
    """label[i]: a row joined to row i by near duplicates of which one has a value of cell u and the other of u or beyond.

    Only values within ``limit`` are compared; with second, only rows of the two sides.
    """
    bands = band(n)
    bands -= bands.min() - 1
    wide = int(bands.max()) + 2  # with an empty band at either end
    key = value * wide + bands
    by = np.argsort(key, kind="stable")
    fp, n, key = fp[by], n[by], key[by]
    second = None if second is None else second[by]
    lo, hi = np.searchsorted(key, [(u << shift) * wide, ((u + 1) << shift) * wide])  # the cell's own rows
    label = np.arange(len(key))
    if lo == hi:
        return label
    if len(key) * 64 < wide << WIDTH:
        first = lambda k: np.searchsorted(key, k)  # noqa: E731  # where a (value, band) begins
    else:
        table = np.concatenate([[0], np.cumsum(np.bincount(key, minlength=wide << WIDTH))])
        first = lambda k: table[k]

    def verify(x: np.ndarray, y: np.ndarray) -> None:
        new = label[x] != label[y]
        if second is not None:
            new &= second[x] != second[y]
        x, y = x[new], y[new]
        d = np.bitwise_count(fp[x, 0] ^ fp[y, 0])
        near = d <= radius
        x, y, d = x[near], y[near], d[near]
        d = d + np.bitwise_count(fp[x, 1] ^ fp[y, 1])
        near = (d <= radius) & (np.minimum(n[x], n[y]) >= RATIO * np.maximum(n[x], n[y]) - 1e-9)
        if near.any():
            _settle(label, x[near], y[near])

    def meet(lo_a, n_a, lo_b, n_b) -> None:
        """Verify the crosses of runs; of large ones without the pairs that are joined already."""
        large = n_a * n_b > HEAVY
        for x, y in _cross(lo_a[~large], n_a[~large], lo_b[~large], n_b[~large]):
            verify(x, y)
        for k in np.flatnonzero(large):
            a, b = np.arange(lo_a[k], lo_a[k] + n_a[k]), np.arange(lo_b[k], lo_b[k] + n_b[k])
            of, size = np.unique(np.concatenate([label[a], label[b]]), return_counts=True)
            if len(of) == 1:
                continue
            top = of[size.argmax()]
            a_in, b_in = label[a] == top, label[b] == top
            for left, right in ((a[a_in], b[~b_in]), (a[~a_in], b[b_in]), (a[~a_in], b[~b_in])):
                for i in range(0, len(left) and len(right), max(1, _PAIRS // max(1, len(left)))):
                    some = right[i : i + max(1, _PAIRS // max(1, len(left)))]
                    verify(np.repeat(left, len(some)), np.tile(some, len(left)))

    run = np.unique(key[lo:hi])
    begin = first(run)
    size, upto = first(run + 1) - begin, first(run + 2) - begin
    for k in range(4) if (size**2 > HEAVY).any() else ():  # large runs are first compared with a few of their own rows
        at = np.flatnonzero(size**2 > HEAVY)
        x = np.repeat(begin[at] + size[at] * k // 4, size[at])
        verify(x, np.repeat(begin[at] - np.cumsum(size[at]) + size[at], size[at]) + np.arange(size[at].sum()))
    # equal values: the rest of the own band and the next band
    large = size * upto > HEAVY
    meet(begin[large], size[large], begin[large], upto[large])
    row = np.arange(lo, hi)[np.repeat(~large, size)]
    meet(row, np.ones(len(row), np.int64), row + 1, np.repeat((begin + upto)[~large], size[~large]) - row - 1)
    v, b = run // wide, run % wide
    masks = np.arange(1, 1 << WIDTH)
    for mask in masks[np.bitwise_count(masks.astype(np.uint32)) <= limit]:
        to = v ^ mask
        start, end = first(to * wide + b - 1), first(to * wide + b + 2)
        ok = (end > start) & ((to >> shift > u) | ((to >> shift == u) & (to > v)))
        if ok.any():
            meet(begin[ok], size[ok], start[ok], (end - start)[ok])
    out = np.empty(len(by), np.int64)
    out[by] = by[label]
    return out


def plan(reps: DataFrame, radius: int, cell: int = CELL) -> Cells:
    """Bit order, thresholds and cells, from statistics over all rows; 8,257 and at most 524,288 numbers reach the driver."""
    both, total = np.zeros((simbits.BITS, simbits.BITS)), 0
    for i, j, c in reps.mapInArrow(bit_counts, "i int, j int, c long").groupBy("i", "j").agg(F.sum("c")).toPandas().itertuples(index=False):
        if i < 0:
            total = c
        else:
            both[i, j] = both[j, i] = c
    order = group_bits(both, total)
    counts = np.zeros((PARTS, 1 << WIDTH), np.int64)
    got = reps.mapInArrow(value_counts(order), "p int, v int, c long").groupBy("p", "v").agg(F.sum("c").alias("c")).toPandas()
    counts[got["p"].to_numpy(), got["v"].to_numpy()] = got["c"].to_numpy()
    return Cells(counts, order, allocate(pairs_within(counts), radius), cell)


def duplicates(docs: DataFrame, radius: int = RADIUS, cell: int = CELL) -> DataFrame:
    """(doc_id, duplicate_of, group_size): one row for each document that goes, with the one of its group that stays.

    Joins by a value that many rows share are of a large side with one row for each value, which adaptive
    execution splits where a value is hot; nothing is sorted or collected by group.
    """
    rows = cut(sketches(docs))
    reps = cut(rows.groupBy("f1", "f2", "n").agg(F.min("doc_id").alias("rep")))
    held = cut(rows.join(reps, ["f1", "f2", "n"]).select("doc_id", "rep").distinct())
    discard(rows)
    some = reps.where("n > 0").select("rep", "f1", "f2", "n")
    cells = plan(some, radius, cell)
    edges = some.mapInArrow(cells.send, SENT).groupBy("task").applyInArrow(cells.search(radius), "a long, b long")
    # the same doc_id under several fingerprints links their groups
    twice = held.groupBy("doc_id").agg(F.min("rep").alias("a"), F.max("rep").alias("b")).where("a <> b")
    links = held.join(twice.select("doc_id", "a"), "doc_id").select("a", F.col("rep").alias("b"))
    roots = components(edges.unionByName(links))
    found = held.join(roots, F.col("rep") == F.col("node"), "left")
    found = cut(found.select("doc_id", F.coalesce("root", "rep").alias("duplicate_of")).distinct())
    sizes = found.groupBy("duplicate_of").agg(F.count("*").alias("group_size"))
    out = cut(found.where("doc_id <> duplicate_of").join(sizes, "duplicate_of").select("doc_id", "duplicate_of", "group_size"))
    for table in (reps, held, roots, found):
        discard(table)
    return out


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """docs without the duplicates; every other row, and the columns, as they were.

    The ids that go are counted once written: up to ``BROADCAST_IDS`` of them are broadcast, so that no text is
    shuffled; more are joined by a shuffle that can spill.
    """
    gone = cut(duplicates(docs).select(F.col("doc_id").alias("_gone")))
    side = F.broadcast(gone) if gone.count() <= BROADCAST_IDS else gone
    return docs.join(side, docs["doc_id"] == gone["_gone"], "left_anti")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"))
