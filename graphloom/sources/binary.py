"""The binary graph format, version 1: fixed records and a string table, little-endian, tables aligned to 8 bytes.

Reading is a Python data source whose partitions are ranges of records; writing gives every row its place and lets
each task write its own into the one file that the format asks for, so the file system must be one that the driver and
all executors mount.
For data of any size, Parquet (CodeGraph.save) is the way.  A file begins with eight bytes of ``magic``.
"""

from __future__ import annotations

import mmap
import os
import struct
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from graphloom.checkpoints import cut, discard, scratch
from graphloom.operators.graph import CodeGraph, dense_ids, running_sum, without_dangling
from graphloom.schemas import EDGE_SOURCES, EDGE_TYPES, EDGES, EXTERNALS, KINDS, LANGUAGES, NODES, VISIBILITIES, ordinal

MAGIC, VERSION = b"GLOOMGR\0", 1
HEADER, NODE, EDGE, METRIC = 72, 96, 24, 24
_HEAD, _NODE, _METRIC = "<8sII7Q", "<QBBBBIQII12s12I4x", "<HIHHHHHBxI2x"
_EDGES = np.dtype([("source", "<u8"), ("target", "<u8"), ("type", "u1"), ("origin", "u1"), ("", "V6")])
#: Node records to a part when they are written, and records that are read to an Arrow batch.
CHUNK, BATCH = 1 << 16, 100_000
_FLAGS = (("is_comptime", 1), ("is_inline", 2), ("is_extern", 4), ("comptime_conditional", 8), ("is_mutable", 16), ("is_packed", 32))
_METRICS = ("complexity", "lines", "fan_in", "fan_out", "branches", "loops", "error_paths", "nesting_depth_max", "structural_hash")


class InvalidMagic(ValueError):
    pass


class UnsupportedVersion(ValueError):
    pass


class InvalidFormat(ValueError):
    pass


def align8(n: int) -> int:
    return n + 7 & ~7


def encode_meta(meta) -> bytes:
    if meta is None:
        return b""
    return bytes([1, sum(bit for name, bit in _FLAGS if meta[name])]) + (meta["calling_convention"] or "").encode()


def decode_meta(raw: bytes):
    """None for nothing or an unknown tag."""
    if len(raw) < 2 or raw[0] != 1:
        return None
    flags = {name: bool(raw[1] & bit) for name, bit in _FLAGS}
    return (flags["is_comptime"], flags["is_mutable"], flags["is_inline"], flags["is_extern"], flags["is_packed"], flags["comptime_conditional"], raw[2:].decode() or None)


def _meta(c: str) -> Column:
    """encode_meta as a column."""
    flags = reduce(Column.bitwiseOR, [F.when(F.col(f"{c}.{name}"), bit).otherwise(0) for name, bit in _FLAGS])
    blob = F.concat(F.lit(b"\1"), F.unhex(F.lpad(F.hex(flags), 2, "0")), F.coalesce(F.col(f"{c}.calling_convention"), F.lit("")).cast("binary"))
    return F.when(F.col(c).isNotNull(), blob)


def _string_table(numbered: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(s, at): each string once, in the order of first use; (_at, r0 ... r5): where and how long each node's strings are."""
    texts = [F.col(c).cast("binary") for c in ("name", "file_path", "signature", "doc")] + [F.col("external.version").cast("binary"), _meta("lang_meta")]
    each = F.array(*[F.struct(F.lit(j).alias("j"), t.alias("s")) for j, t in enumerate(texts)])
    uses = cut(numbered.select("_at", F.explode(each).alias("u")).select("_at", "u.*").where("length(s) > 0"))
    first = uses.groupBy("s").agg(F.min(F.col("_at") * len(texts) + F.col("j")).alias("first"))
    strings = cut(running_sum(first, ["first"], F.octet_length("s"), "at").select("s", "at"))
    met = uses.join(strings, "s").groupBy("_at").agg(*[F.max(F.when(F.col("j") == j, F.struct("at", F.octet_length("s").alias("n")))).alias(f"r{j}") for j in range(len(texts))])
    return strings, met


def _put(f, records: list[tuple[int, bytes]]) -> None:
    """Write (position, bytes), those that adjoin in one go."""
    at, run = None, []
    for p, raw in records:
        if at is None or p != end:
            if run:
                _whole(f, b"".join(run), at)
            at, run = p, []
        run.append(raw)
        end = p + len(raw)
    if run:
        _whole(f, b"".join(run), at)


def _whole(f, raw: bytes, at: int) -> None:
    view = memoryview(raw)
    while view:
        n = os.pwrite(f.fileno(), view, at)
        view, at = view[n:], at + n


def _spots(places: np.ndarray, raw: bytes, start: int, size: int) -> list[tuple[int, bytes]]:
    """Records of a size by runs of consecutive places."""
    breaks = [0, *(np.flatnonzero(np.diff(places) != 1) + 1).tolist(), len(places)]
    return [(start + int(places[a]) * size, raw[a * size : b * size]) for a, b in zip(breaks, breaks[1:]) if a < b]


def _written(df: DataFrame, path: str, records) -> None:
    """Write records(batch) of all batches at their positions, each task its own; a task that is run again writes the same."""
    def run(batches):
        for batch in batches:
            with open(path, "r+b") as f:
                _put(f, records(batch))
            yield pa.RecordBatch.from_pydict({"n": pa.array([batch.num_rows], pa.int64())})

    df.mapInArrow(run, "n long").agg(F.sum("n")).collect()


def _numbers(column, dtype) -> np.ndarray:
    """An error for what the field can't hold, and for a value that an enumeration doesn't have."""
    if column.null_count:
        raise InvalidFormat("a value that the format has no number for")
    return column.cast(pa.from_numpy_dtype(np.dtype(dtype))).to_numpy(zero_copy_only=False)


def save(spark: SparkSession, nodes: DataFrame, edges: DataFrame, path: str, magic: bytes = MAGIC) -> None:
    """Write the graph; ends and parents are ids, which become record numbers where they are dense, and stay as they are else.

    Every task writes its records at their places; the driver has the header only.
    """
    with scratch() as tables:
        numbered = tables.keep(cut(dense_ids(nodes, ["id"], "_at")))
        lines = tables.keep(cut(dense_ids(edges.select("edge_id", "source_id", "target_id", ordinal("edge_type", EDGE_TYPES).alias("t"), ordinal("source", EDGE_SOURCES).alias("o")), ["edge_id"], "_at").drop("edge_id")))
        strings, met = _string_table(numbered)
        n_nodes, n_edges = numbered.count(), lines.count()
        size = strings.agg(F.max(F.col("at") + F.octet_length("s"))).first()[0] or 0
        node_at = align8(HEADER)
        edge_at = align8(node_at + n_nodes * NODE)
        metric_at = align8(edge_at + n_edges * EDGE)
        string_at = align8(metric_at + n_nodes * METRIC)
        with open(path, "wb") as f:
            f.truncate(string_at + size)

        def of_edges(batch):
            out = np.zeros(batch.num_rows, _EDGES)
            for field, c in zip(("source", "target", "type", "origin"), ("source_id", "target_id", "t", "o")):
                out[field] = _numbers(batch[c], _EDGES[field])
            return _spots(batch["_at"].to_numpy(), out.tobytes(), edge_at, EDGE)

        def of_strings(batch):
            return list(zip((p + string_at for p in batch["at"].to_pylist()), batch["s"].to_pylist()))

        def of_nodes(batch):
            raw, metrics, places = bytearray(), [], batch["_at"].to_numpy()
            for r in batch.to_pylist():
                m, h = r["metrics"], r["content_hash"]
                flags = (h is not None) | (m is not None) << 1 | (r["parent_id"] is not None) << 2 | (r["line_start"] is not None) << 3 | (r["line_end"] is not None) << 4
                refs = [k for j in range(6) for k in ((r[f"r{j}"]["at"], r[f"r{j}"]["n"]) if r[f"r{j}"] else (0, 0))]
                raw += struct.pack(_NODE, r["id"], r["kind"], r["language"], r["visibility"], r["external"], flags, r["parent_id"] or 0, r["line_start"] or 0, r["line_end"] or 0, bytes(h or b""), *refs)[:NODE].ljust(NODE, b"\0")
                if m:
                    metrics.append((metric_at + r["_at"] * METRIC, struct.pack(_METRIC, *[m[c] or 0 for c in _METRICS]).ljust(METRIC, b"\0")))
            return _spots(places, bytes(raw), node_at, NODE) + metrics

        kinds = [ordinal(c, names).alias(c) for c, names in (("kind", KINDS), ("language", LANGUAGES), ("visibility", VISIBILITIES))]
        external = ordinal(F.coalesce("external.kind", F.lit("none")), EXTERNALS).alias("external")
        records = numbered.select("_at", "id", *kinds, external, "parent_id", "line_start", "line_end", "content_hash", "metrics").join(met, "_at", "left")
        # places are dense, so chunks of them are parts of a known size, and in order within
        _written(records.repartition(F.floor(F.col("_at") / CHUNK)).sortWithinPartitions("_at"), path, of_nodes)
        _written(strings.repartition(F.floor(F.col("at") / (CHUNK * 16))).sortWithinPartitions("at"), path, of_strings)
        _written(lines, path, of_edges)
        with open(path, "r+b") as f:
            f.write(struct.pack(_HEAD, magic, VERSION, 0, n_nodes, n_edges, node_at, edge_at, metric_at, string_at, size).ljust(HEADER, b"\0"))
    for table in (numbered, lines):
        discard(table)


@dataclass
class Header:
    nodes: int
    edges: int
    node_at: int
    edge_at: int
    metric_at: int
    string_at: int
    string_size: int


def header(path: str, magic: bytes = MAGIC) -> Header:
    with open(path, "rb") as f:
        raw = f.read(HEADER)
        size = f.seek(0, 2)
    if len(raw) < 8 or raw[:8] != magic:
        raise InvalidMagic(path)
    if len(raw) < HEADER:
        raise InvalidFormat("the header is cut off")
    _, version, _, *rest = struct.unpack(_HEAD, raw[: struct.calcsize(_HEAD)])
    if version != VERSION:
        raise UnsupportedVersion(str(version))
    h = Header(*rest)
    for at, n in ((h.node_at, h.nodes * NODE), (h.edge_at, h.edges * EDGE), (h.metric_at, h.nodes * METRIC), (h.string_at, h.string_size)):
        if at > size or n > size or at + n > size:
            raise InvalidFormat("a table reaches beyond the end of the file")
    return h


def _pick(names: tuple[str, ...], k: int) -> str:
    if k >= len(names):
        raise InvalidFormat(f"no value has the number {k}")
    return names[k]


class _Range(InputPartition):
    def __init__(self, first: int, count: int):
        self.first, self.count = first, count


class _Reader(DataSourceReader):
    def __init__(self, path: str, table: str, step: int, magic: bytes):
        self.path, self.table, self.step = path, table, step
        self.head = header(path, magic)

    def partitions(self):
        n = self.head.edges if self.table == "edges" else self.head.nodes
        return [_Range(a, min(self.step, n - a)) for a in range(0, n, self.step)] or [_Range(0, 0)]

    def read(self, part):
        if not part.count:
            return
        h = self.head
        with open(self.path, "rb") as f, mmap.mmap(f.fileno(), 0, access=mmap.ACCESS_READ) as m:
            if self.table == "edges":
                for k in range(part.first, part.first + part.count, BATCH):
                    n = min(BATCH, part.first + part.count - k)
                    e = np.frombuffer(m[h.edge_at + k * EDGE : h.edge_at + (k + n) * EDGE], _EDGES)
                    _pick(EDGE_TYPES, int(e["type"].max())), _pick(EDGE_SOURCES, int(e["origin"].max()))
                    named = lambda names, of: pa.DictionaryArray.from_arrays(pa.array(of.astype("i4")), list(names)).cast(pa.string())
                    yield pa.RecordBatch.from_arrays([pa.array(np.arange(k, k + n)), pa.array(e["source"].astype("i8")), pa.array(e["target"].astype("i8")), named(EDGE_TYPES, e["type"]), named(EDGE_SOURCES, e["origin"])], names=EDGES.names)
                return
            if self.table == "ids":
                for k in range(part.first, part.first + part.count, BATCH):
                    n = min(BATCH, part.first + part.count - k)
                    ids = np.frombuffer(m[h.node_at + k * NODE : h.node_at + (k + n) * NODE], np.dtype({"names": ["id"], "formats": ["<i8"], "itemsize": NODE}))
                    yield pa.RecordBatch.from_arrays([pa.array(ids["id"].copy())], names=["id"])
                return

            def string(at: int, n: int):
                if at + n > h.string_size:
                    raise InvalidFormat("a string reaches beyond the table")
                return m[h.string_at + at : h.string_at + at + n] if n else None

            for k in range(part.first, part.first + part.count):
                i, kind, language, visibility, external, flags, parent, a, b, digest, *refs = struct.unpack_from(_NODE, m[h.node_at + k * NODE : h.node_at + (k + 1) * NODE].ljust(struct.calcsize(_NODE), b"\0"), 0)
                name, path, signature, doc, version, meta = (string(refs[j], refs[j + 1]) for j in range(0, 12, 2))
                text = lambda s: None if s is None else s.decode("utf-8", "replace")
                metrics = None
                if flags & 2:
                    metrics = struct.unpack_from(_METRIC, m, h.metric_at + k * METRIC)
                yield (i, text(name) or "", _pick(KINDS, kind), _pick(LANGUAGES, language), text(path), a if flags & 8 else None, b if flags & 16 else None, parent if flags & 4 else None, _pick(VISIBILITIES, visibility),
                       text(doc), text(signature), digest if flags & 1 else None, metrics, decode_meta(meta) if meta else None, (_pick(EXTERNALS, external), text(version)))


class BinaryGraph(DataSource):
    """spark.read.format("codegraph_v1").option("table", "nodes", "edges" or "ids" (of nodes)).load(path)"""

    @classmethod
    def name(cls) -> str:
        return "codegraph_v1"

    def schema(self):
        return {"edges": EDGES, "ids": "id long"}.get(self.options.get("table", "nodes"), NODES)

    def reader(self, schema):
        return _Reader(self.options["path"], self.options.get("table", "nodes"), int(self.options.get("step", 100_000 if self.options.get("table", "nodes") == "nodes" else 10 * BATCH)), bytes.fromhex(self.options.get("magic", MAGIC.hex())))


def load(spark: SparkSession, path: str, magic: bytes = MAGIC) -> CodeGraph:
    """The graph in a file; edges with an end that is no node are left out."""
    header(path, magic)
    spark.dataSource.register(BinaryGraph)
    table = lambda name: spark.read.format("codegraph_v1").option("magic", magic.hex()).option("table", name).load(path)
    nodes, edges = table("nodes"), table("edges")
    return CodeGraph(nodes, without_dangling(edges, table("ids")).select(*[F.col(c) for c in EDGES.names]))


def append(spark: SparkSession, g: CodeGraph, path: str, remap: bool = True) -> None:
    """The file's graph and then g, written anew; without remap, g's parents and ends keep their numbers."""
    from graphloom.operators.graph import append as union

    old = load(spark, path)
    nodes, edges = union((old.nodes, old.edges), (g.nodes, g.edges), remap)
    save(spark, cut(nodes), cut(edges), path)
