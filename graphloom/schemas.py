"""Fixed schemas of the property graph, and its enumerations in their stored order."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

KINDS = ("file", "module", "function", "type_def", "enum_def", "field", "constant", "test_def", "error_def", "import_decl", "union_def")
EDGE_TYPES = ("calls", "imports", "uses_type", "similar_to", "exports", "implements")
EDGE_SOURCES = ("tree_sitter", "lsp", "phantom", "workspace")
VISIBILITIES = ("public", "private")
LANGUAGES = ("zig", "rust")
EXTERNALS = ("none", "stdlib", "dependency")
TYPE_CONTAINERS = ("type_def", "enum_def", "union_def")
#: Limits that hold with parity=True only: hops to an ancestor, segments of a chain and of a path, bindings of a file
#: or caller, parameters of a function, bytes of a file.
MAX_HOPS, MAX_CHAIN, MAX_SEGMENTS, MAX_BINDINGS, MAX_PARAMS, MAX_FILE = 100, 8, 64, 32, 16, 10 << 20


def _struct(**fields: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(k, v) for k, v in fields.items()])


_I, _L, _S, _B = T.IntegerType(), T.LongType(), T.StringType(), T.BooleanType()
METRICS = _struct(complexity=_I, lines=_L, fan_in=_I, fan_out=_I, branches=_I, loops=_I, error_paths=_I, nesting_depth_max=_I, structural_hash=_L)
LANG_META = _struct(is_comptime=_B, is_mutable=_B, is_inline=_B, is_extern=_B, is_packed=_B, comptime_conditional=_B, calling_convention=_S)
EXTERNAL = _struct(kind=_S, version=_S)

NODES = T.StructType([
    T.StructField("id", _L, False), T.StructField("name", _S, False), T.StructField("kind", _S, False), T.StructField("language", _S, False),
    T.StructField("file_path", _S), T.StructField("line_start", _I), T.StructField("line_end", _I), T.StructField("parent_id", _L),
    T.StructField("visibility", _S, False), T.StructField("doc", _S), T.StructField("signature", _S), T.StructField("content_hash", T.BinaryType()),
    T.StructField("metrics", METRICS), T.StructField("lang_meta", LANG_META), T.StructField("external", EXTERNAL),
])
EDGES = T.StructType([T.StructField("edge_id", _L, False), T.StructField("source_id", _L, False), T.StructField("target_id", _L, False), T.StructField("edge_type", _S, False), T.StructField("source", _S, False)])
FILES = _struct(rel_path=_S, basename=_S, content=T.BinaryType(), content_hash=T.BinaryType(), language=_S)


def ordinal(column: Column | str, names: tuple[str, ...]) -> Column:
    """The stored number of an enumeration's value; null for a value it doesn't have."""
    c = F.col(column) if isinstance(column, str) else column
    return F.element_at(F.create_map(*[F.lit(x) for k, n in enumerate(names) for x in (n, k)]), c)


def full_nodes(df):
    """df with the node columns it lacks added as nulls (private, no external, zig), in the schema's order."""
    have = {f.name: f for f in df.schema}
    default = {"visibility": F.lit("private"), "language": F.lit("zig"), "external": F.struct(F.lit("none").alias("kind"), F.lit(None).cast("string").alias("version"))}
    return df.select(*[(F.col(f.name) if f.name in have else default.get(f.name, F.lit(None))).cast(f.dataType).alias(f.name) for f in NODES])
