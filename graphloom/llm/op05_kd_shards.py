"""Sharding by a k-d tree over metadata, until leaves hold at most the target bytes.

A node is split along its widest dimension, each measured against the whole table's range, at the weighted
median: the least value up to which half of the node's bytes lie (the value before the last, if that would
leave one side empty).  Ties go to the left.  Dimensions are n_chars, doc_id and hashes of lang and source.

Cost at scale: one scan reads the texts for their size; from then on a document is a row of six numbers in a
table in the shared folder, which is never written again.  All nodes of a level are split at once.  Which node a
row is in follows from the tree so far, which is broadcast as flat arrays (a node has 24 bytes, and there are about
twice as many nodes as shards of the target size) and walked in numpy.  A level takes one scan for the nodes' ranges
and bytes and a few for their medians: histograms of ``BINS`` bins close in on the value, summed in each task before
they are shuffled.  What reaches the driver is a row for each node.  There is no other way for small tables.

Defined results.  A null, or a column that is missing, counts as -1 in its dimension; a doc_id that is no number
counts by its hash.  Null texts weigh 0 bytes, very long ones what they are, and a text beyond the target is a shard
of its own if its metadata tell it from others.  Rows alike in all dimensions can't be split, and their leaf may exceed
the target.  Rows that repeat weigh each and share a leaf.  Empty table: empty result.  Other columns are not read,
whatever their names.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from graphloom.checkpoints import cut

TARGET, BINS = 64 << 20, 4096
DIMS = ("d0", "d1", "d2", "d3")
_FLUSH = 1 << 20  # bins that a task holds before it passes them on


def points(docs: DataFrame) -> DataFrame:
    """(doc_id, d0..d3, w): a document's place and bytes."""
    have = set(docs.columns)

    def number(c: str):
        if c not in have:
            return F.lit(-1).cast("long")
        return F.coalesce(F.col(c).cast("long"), F.lit(-1)) if isinstance(docs.schema[c].dataType, T.NumericType) else hashed(c)

    def hashed(c: str):
        if c not in have:
            return F.lit(-1).cast("long")
        return F.when(F.col(c).isNull(), F.lit(-1)).otherwise(F.pmod(F.xxhash64(c), F.lit(1 << 20))).cast("long")

    weight = F.coalesce(F.octet_length("text"), F.lit(0)).cast("long")
    return docs.select("doc_id", number("n_chars").alias("d0"), number("doc_id").alias("d1"), hashed("lang").alias("d2"), hashed("source").alias("d3"), weight.alias("w"))


def widest(low: np.ndarray, high: np.ndarray, whole: np.ndarray) -> np.ndarray:
    """Of each node the dimension that is widest against the whole; the first of equals; -1 if all are points."""
    width = (high - low).astype(float) / np.maximum(whole, 1)
    return np.where((high > low).any(axis=1), width.argmax(axis=1), -1)


@dataclass
class Tree:
    """Flat arrays; a node without a dimension (-1) is a leaf, the children of another are ``left`` and the next."""

    dim: list[int] = field(default_factory=lambda: [-1])
    at: list[int] = field(default_factory=lambda: [0])
    left: list[int] = field(default_factory=lambda: [0])
    paths: list[str] = field(default_factory=lambda: ["r"])

    def split(self, node: int, dim: int, at: int) -> list[int]:
        self.dim[node], self.at[node], self.left[node] = dim, at, len(self.dim)
        for side in "01":
            self.dim.append(-1)
            self.at.append(0)
            self.left.append(0)
            self.paths.append(self.paths[node] + side)
        return [len(self.dim) - 2, len(self.dim) - 1]

    def arrays(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        return np.array(self.dim), np.array(self.at, np.int64), np.array(self.left)


def walk(tree: tuple, x: np.ndarray) -> np.ndarray:
    """The leaf of each row."""
    dim, at, left = tree
    node = np.zeros(len(x), np.int64)
    rows = np.arange(len(x))
    while len(rows):
        rows = rows[dim[node[rows]] >= 0]
        own = node[rows]
        node[rows] = left[own] + (x[rows, dim[own]] > at[own])
    return node


def _places(batch) -> np.ndarray:
    return np.stack([batch[d].to_numpy() for d in DIMS], axis=1)


def _open(shared, batch) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(index of the open node, place, bytes) of the rows that are in one."""
    tree, index = shared.value
    x = _places(batch)
    of = index[walk(tree, x)]
    at = np.flatnonzero(of >= 0)
    return of[at], x[at], batch["w"].to_numpy()[at]


class Scans:
    """What is asked of the points of open nodes, each by one scan with the tree broadcast."""

    def __init__(self, pts: DataFrame, tree: Tree, nodes: list[int]):
        self.pts, self.nodes = pts, nodes
        index = np.full(len(tree.dim), -1)
        index[nodes] = np.arange(len(nodes))
        self.shared = pts.sparkSession.sparkContext.broadcast((tree.arrays(), index))

    def ranges(self) -> list[tuple]:
        """(bytes, least of each dimension, greatest of each) of the open nodes; None for one without rows."""
        n, shared = len(self.nodes), self.shared

        def run(batches):
            w, some = np.zeros(n, np.int64), np.zeros(n, bool)
            low, high = np.full((n, len(DIMS)), np.iinfo(np.int64).max), np.full((n, len(DIMS)), np.iinfo(np.int64).min)
            for batch in batches:
                of, x, weight = _open(shared, batch)
                some[of] = True
                np.add.at(w, of, weight)
                np.minimum.at(low, of, x)
                np.maximum.at(high, of, x)
            at = np.flatnonzero(some)
            columns = [at, w[at], *low[at].T, *high[at].T]
            yield pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(c)) for c in columns], names=["k", "w", *(f"{n}_{d}" for n in ("min", "max") for d in DIMS)])

        kinds = ", ".join(f"{c} long" for c in ("k", "w", *(f"{n}_{d}" for n in ("min", "max") for d in DIMS)))
        each = self.pts.select(*DIMS, "w").mapInArrow(run, kinds)
        got = each.groupBy("k").agg(F.sum("w").alias("w"), *[f(f"{n}_{d}").alias(f"{n}_{d}") for n, f in (("min", F.min), ("max", F.max)) for d in DIMS])
        out: list = [None] * n
        for r in got.collect():
            out[r["k"]] = (r["w"], [r[f"min_{d}"] for d in DIMS], [r[f"max_{d}"] for d in DIMS])
        return out

    def medians(self, dims: list[int], low: list[int], high: list[int], weight: list[int]) -> list[int]:
        """The value to split each open node at, along its dimension with values from low to high."""
        n, shared, context = len(self.nodes), self.shared, self.pts.sparkSession.sparkContext
        dim, lo, hi, below = np.array(dims), list(low), list(high), [0] * len(low)
        half = [-(-w // 2) for w in weight]
        while any(a < b for a, b in zip(lo, hi)):
            step = [max(1, -(-(b - a + 1) // BINS)) for a, b in zip(lo, hi)]
            asked = context.broadcast((dim, np.array(lo), np.array(hi), np.array(step)))
            state = context.broadcast((np.array(lo) < np.array(hi)))

            def run(batches):
                dim, lo, hi, step = asked.value
                keys, sums, held = [], [], 0
                for batch in batches:
                    of, x, w = _open(shared, batch)
                    v = x[np.arange(len(of)), dim[of]]
                    at = np.flatnonzero((v >= lo[of]) & (v <= hi[of]) & state.value[of])
                    of, v, w = of[at], v[at], w[at]
                    key, inverse = np.unique(of * BINS + (v - lo[of]) // step[of], return_inverse=True)
                    total = np.zeros(len(key), np.int64)
                    np.add.at(total, inverse, w)
                    keys.append(key)
                    sums.append(total)
                    held += len(key)
                    if held > _FLUSH:
                        yield _summed(keys, sums)
                        keys, sums, held = [], [], 0
                yield _summed(keys, sums)

            each = self.pts.select(*DIMS, "w").mapInArrow(run, "key long, w long")
            hist = each.groupBy("key").agg(F.sum("w").alias("w")).select(F.floor(F.col("key") / BINS).cast("long").alias("k"), (F.col("key") % BINS).alias("bin"), "w")
            need = self.pts.sparkSession.createDataFrame([(k, half[k] - below[k]) for k in range(n)], "k long, need long")
            upto = hist.withColumn("upto", F.sum("w").over(Window.partitionBy("k").orderBy("bin")))  # at most BINS rows of a node
            hit = upto.join(F.broadcast(need), "k").where("upto >= need").groupBy("k").agg(F.min_by(F.struct("bin", (F.col("upto") - F.col("w")).alias("less")), "bin").alias("b"))
            for r in hit.select("k", "b.bin", "b.less").collect():
                k = r["k"]
                lo[k], hi[k], below[k] = lo[k] + r["bin"] * step[k], min(hi[k], lo[k] + (r["bin"] + 1) * step[k] - 1), below[k] + r["less"]
            asked.unpersist()
        last = [k for k in range(n) if lo[k] == high[k]]
        return self._before(dim, np.array(lo), last) if last else lo

    def _before(self, dim: np.ndarray, at: np.ndarray, last: list[int]) -> list[int]:
        """at, with those of ``last`` replaced by the greatest value below."""
        n, shared = len(at), self.shared

        def run(batches):
            best = np.full(n, np.iinfo(np.int64).min)
            for batch in batches:
                of, x, _ = _open(shared, batch)
                v = x[np.arange(len(of)), dim[of]]
                less = v < at[of]
                np.maximum.at(best, of[less], v[less])
            k = np.flatnonzero(best > np.iinfo(np.int64).min)
            yield pa.RecordBatch.from_arrays([pa.array(k), pa.array(best[k])], names=["k", "v"])

        got = self.pts.select(*DIMS, "w").mapInArrow(run, "k long, v long").groupBy("k").agg(F.max("v").alias("v")).collect()
        below = {r["k"]: r["v"] for r in got}
        return [below[k] if k in set(last) else int(a) for k, a in enumerate(at)]


def _summed(keys: list[np.ndarray], sums: list[np.ndarray]) -> pa.RecordBatch:
    key, inverse = np.unique(np.concatenate(keys) if keys else np.zeros(0, np.int64), return_inverse=True)
    total = np.zeros(len(key), np.int64)
    np.add.at(total, inverse, np.concatenate(sums) if sums else np.zeros(0, np.int64))
    return pa.RecordBatch.from_arrays([pa.array(key), pa.array(total)], names=["key", "w"])


def grow(pts: DataFrame, target: int) -> Tree:
    tree, nodes, whole = Tree(), [0], None
    while nodes:
        got = Scans(pts, tree, nodes).ranges()
        if got[0] is None:
            break
        if whole is None:
            whole = np.array([b - a for a, b in zip(*got[0][1:])])
        low, high = np.array([g[1] for g in got]), np.array([g[2] for g in got])
        dims = widest(low, high, whole)
        large = [k for k, g in enumerate(got) if g[0] > target and dims[k] >= 0]
        if not large:
            break
        dim = [int(dims[k]) for k in large]
        ends = [[int(e[k][d]) for k, d in zip(large, dim)] for e in (low, high)]
        at = Scans(pts, tree, [nodes[k] for k in large]).medians(dim, *ends, [got[k][0] for k in large])
        nodes = [c for k, d, a in zip(large, dim, at) for c in tree.split(nodes[k], d, int(a))]
    return tree


def shards(docs: DataFrame, target: int = TARGET) -> DataFrame:
    """(doc_id, shard, n_bytes): every document with the path of its leaf, r for the root, then 0 (left) or 1."""
    pts = cut(points(docs))
    tree = grow(pts, target)
    shared = docs.sparkSession.sparkContext.broadcast((tree.arrays(), tree.paths))

    def run(batches):
        arrays, paths = shared.value
        for batch in batches:
            leaf, inverse = np.unique(walk(arrays, _places(batch)), return_inverse=True)
            shard = pa.array([paths[k] for k in leaf], pa.string()).take(pa.array(inverse))
            yield pa.RecordBatch.from_arrays([batch["doc_id"], shard, batch["w"]], names=["doc_id", "shard", "n_bytes"])

    return pts.mapInArrow(run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, shard string, n_bytes long")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shards(spark.read.parquet(f"{sf_dir}/documents.parquet"))
