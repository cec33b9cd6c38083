"""JSON lines: one object for each node, then for each edge, every key always there."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from graphloom.functions.text import hash_bytes, hash_text, json_string
from graphloom.operators.graph import CodeGraph, without_dangling
from graphloom.schemas import EDGE_SOURCES, EDGE_TYPES, KINDS, LANG_META, LANGUAGES, METRICS, NODES, VISIBILITIES


def _text(c: Column | str) -> Column:
    c = F.col(c) if isinstance(c, str) else c
    return F.coalesce(json_string(c), F.lit("null"))


def _number(c: Column | str) -> Column:
    return F.coalesce((F.col(c) if isinstance(c, str) else c).cast("string"), F.lit("null"))


def _object(pairs: list[tuple[str, Column]]) -> Column:
    out = []
    for k, (name, value) in enumerate(pairs):
        out += [F.lit(("," if k else "{") + f'"{name}":'), value]
    return F.concat(*out, F.lit("}"))


def node_lines(nodes: DataFrame) -> DataFrame:
    """(id, line)."""
    plain = lambda c: F.concat(F.lit('"'), F.col(c), F.lit('"'))
    meta, m, x = F.col("lang_meta"), F.col("metrics"), F.col("external")
    flags = [(f.name, F.coalesce(meta[f.name], F.lit(False)).cast("string")) for f in LANG_META if f.name != "calling_convention"]
    call = F.coalesce(F.concat(F.lit('"'), meta["calling_convention"], F.lit('"')), F.lit("null"))
    external = F.when(x["kind"] == "stdlib", F.lit('"stdlib"')).when(x["kind"] == "dependency", _object([("type", F.lit('"dependency"')), ("version", _text(x["version"]))])).otherwise("null")
    line = _object([
        ("_type", F.lit('"node"')), ("id", _number("id")), ("name", _text("name")), ("kind", plain("kind")), ("language", plain("language")), ("file_path", _text("file_path")), ("line_start", _number("line_start")), ("line_end", _number("line_end")),
        ("visibility", plain("visibility")), ("parent_id", _number("parent_id")), ("doc", _text("doc")), ("signature", _text("signature")), ("content_hash", F.coalesce(F.concat(F.lit('"'), hash_text("content_hash"), F.lit('"')), F.lit("null"))), ("external", external),
        ("lang_meta", F.when(meta.isNull(), F.lit("null")).otherwise(_object([("type", F.lit('"zig"')), *flags, ("calling_convention", call)]))), ("metrics", F.when(m.isNull(), F.lit("null")).otherwise(_object([(f.name, F.coalesce(m[f.name], F.lit(0)).cast("string")) for f in METRICS]))),
    ])
    return nodes.select("id", line.alias("line"))


def edge_lines(edges: DataFrame) -> DataFrame:
    """edges with line added."""
    q = lambda c: F.concat(F.lit('"'), F.col(c), F.lit('"'))
    return edges.withColumn("line", _object([("_type", F.lit('"edge"')), ("source_id", _number("source_id")), ("target_id", _number("target_id")), ("edge_type", q("edge_type")), ("source", q("source"))]))


def lines(g: CodeGraph) -> DataFrame:
    """(part, a, b, c, line) sorted: nodes by id, edges by type name, source and target."""
    n = node_lines(g.nodes).select(F.lit(0).alias("part"), F.lit("").alias("a"), F.col("id").alias("b"), F.lit(0).cast("long").alias("c"), "line")
    e = edge_lines(g.edges).select(F.lit(1).alias("part"), F.col("edge_type").alias("a"), F.col("source_id").alias("b"), F.col("target_id").alias("c"), "line")
    return n.unionByName(e).orderBy("part", "a", "b", "c")


def write_jsonl(g: CodeGraph, path: str) -> None:
    """A folder of text files whose names sort in the order of their lines."""
    lines(g).select("line").write.mode("overwrite").text(path)


_LINE = T.StructType([T.StructField("_type", T.StringType())] + [T.StructField(f.name, T.StringType()) for f in NODES] + [T.StructField(n, T.StringType()) for n in ("source_id", "target_id", "edge_type", "source", "_bad")])


def read_jsonl(spark: SparkSession, path: str) -> CodeGraph:
    """The graph of such files; a line that isn't JSON is an error.

    Nodes without name, kind, language or visibility, or of unknown ones, and edges of unknown types or with
    an end that is no node, are left out; other values of a wrong type count as null.
    """
    rows = spark.read.schema(_LINE).option("mode", "FAILFAST").json(path)
    meta = F.from_json("lang_meta", T.StructType([T.StructField("type", T.StringType()), *LANG_META]))
    x = F.from_json("external", "type string, version string")
    kind = F.when(F.col("external") == "stdlib", "stdlib").when(x["type"] == "dependency", "dependency").otherwise("none")
    nodes = rows.where("_type = 'node'").where(F.col("name").isNotNull() & F.col("kind").isin(*KINDS) & F.col("language").isin(*LANGUAGES) & F.col("visibility").isin(*VISIBILITIES))
    number = lambda c, t: F.expr(f"try_cast({c} as {t})")
    nodes = nodes.select(
        number("id", "long").alias("id"), "name", "kind", "language", "file_path", number("line_start", "int").alias("line_start"), number("line_end", "int").alias("line_end"), number("parent_id", "long").alias("parent_id"), "visibility", "doc", "signature",
        hash_bytes("content_hash").alias("content_hash"), F.from_json("metrics", METRICS).alias("metrics"), F.when(meta["type"] == "zig", F.struct(*[meta[f.name].alias(f.name) for f in LANG_META])).alias("lang_meta"), F.struct(kind.alias("kind"), F.when(kind == "dependency", x["version"]).alias("version")).alias("external"),
    )
    edges = rows.where("_type = 'edge'").where(F.col("edge_type").isin(*EDGE_TYPES) & F.col("source").isin(*EDGE_SOURCES))
    edges = edges.select(F.monotonically_increasing_id().alias("edge_id"), number("source_id", "long").alias("source_id"), number("target_id", "long").alias("target_id"), "edge_type", "source")
    return CodeGraph(nodes, without_dangling(edges, nodes))
