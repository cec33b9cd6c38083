"""Extraction, name resolution, external symbols and rendering as queries, on source texts made of the supplier table.

What must come out follows from the rule by which the texts are made (sources_of_tables), so SQL can say it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.checkpoints import cut
from graphloom.functions import text as T
from graphloom.operators import graph as G
from graphloom.plans import sources_of_tables as S
from graphloom.plans.registry import query

_FILES = """
SELECT k, CAST(floor(k / 2) AS BIGINT) AS j, 'src/d' || (k % 5) || '/f' || k || '.zig' AS path,
  'src/d' || (CAST(floor(k / 2) AS BIGINT) % 5) || '/f' || CAST(floor(k / 2) AS BIGINT) || '.zig' AS far
FROM (SELECT CAST(s_suppkey AS BIGINT) AS k FROM supplier) s
"""
#: name below the file, kind, first and last line, visibility, doc, signature, flags, complexity
_DECLARED = [
    ("", "file", 1, 50, "public", "//! File @k of the suppliers.", None, "", None),
    (":std", "import_decl", 2, 2, "private", None, "std", "", None),
    (":dep@k", "import_decl", 3, 3, "private", None, "../d@m/f@j.zig", "", None),
    (":Far@k", "import_decl", 4, 4, "private", None, "../d@m/f@j.zig", "", None),
    (":Box@k", "type_def", 7, 19, "public", "/// A box of size @s.", None, "", None),
    (":Box@k.size", "field", 8, 8, "private", None, None, "", None),
    (":Box@k.next", "field", 9, 9, "private", None, None, "", None),
    (":Box@k.init", "function", 11, 13, "public", None, "pub fn init() Box@k", "", 1),
    (":Box@k.grow", "function", 15, 18, "public", None, "pub fn grow(self: *Box@k, by: u32) void", "", 3),
    (":Kind@k", "enum_def", 21, 21, "public", None, None, "", None),
    (":Kind@k.one", "field", 21, 21, "private", None, None, "", None),
    (":Kind@k.two", "field", 21, 21, "private", None, None, "", None),
    (":Value@k", "union_def", 22, 22, "public", None, None, "", None),
    (":Value@k.a", "field", 22, 22, "private", None, None, "", None),
    (":Value@k.b", "field", 22, 22, "private", None, None, "", None),
    (":Failure@k", "error_def", 23, 23, "private", None, "error{Broken}", "", None),
    (":limit@k", "constant", 24, 24, "private", None, None, "  [comptime]", None),
    (":tune@k", "function", 26, 29, "private", None, "inline fn tune@k(by: u32) void", "  [inline]", 1),
    (":run@k", "function", 31, 39, "public", None, "pub fn run@k() void", "", 1),
    (":kinds@k", "function", 41, 46, "private", None, "fn kinds@k(v: Value@k, far: Far@k) Kind@k", "", 2),
    (":run @k", "test_def", 48, 50, "private", None, None, "", None),
]
#: Of file k: calls and type uses by names below the file, those with @j in the file that k imports.
_CALLS = [(":Box@k.grow", ":tune@k"), (":tune@k", ":run@j"), (":run@k", ":Box@j.init"), (":run@k", ":Box@j.grow"), (":run@k", ":Box@k.init"), (":run@k", ":Box@k.grow"), (":run@k", ":tune@k"), (":run @k", ":run@k")]
_USES = [(":run@k", ":Box@j"), (":run@k", ":Box@k"), (":Box@k.init", ":Box@k"), (":Box@k.grow", ":Box@k"), (":kinds@k", ":Far@k"), (":kinds@k", ":Kind@k"), (":kinds@k", ":Value@k")]


def _values(rows: list[tuple]) -> str:
    def literal(x) -> str:
        if x is None or isinstance(x, int):
            return "NULL" if x is None else str(x)
        text = "'" + x.replace("'", "''") + "'"
        return text.replace("{", "' || chr(123) || '").replace("}", "' || chr(125) || '")  # braces stand for tables

    return "(VALUES " + ", ".join("(" + ", ".join(map(literal, r)) + ")" for r in rows) + ")"


def _put(column: str) -> str:
    out = column
    for mark, value in (("@k", "k"), ("@j", "j"), ("@m", "j % 5"), ("@s", "k % 50")):
        out = f"replace({out}, '{mark}', CAST({value} AS VARCHAR))"
    return out


def _linked(rows: list[tuple], kind: str) -> str:
    return f"SELECT DISTINCT path || {_put('a')} AS source, CASE WHEN contains(b, '@j') THEN far ELSE path END || {_put('b')} AS target, '{kind}' AS edge_type FROM f , {_values(rows)} v(a, b)"


TABLES = {
    "f": _FILES,
    "d": f"WITH f AS ({_FILES}) SELECT path, path || {_put('name')} AS label, kind, line_start, line_end, visibility, {_put('doc')} AS doc, {_put('signature')} AS signature, flags, complexity FROM f , {_values(_DECLARED)} v(name, kind, line_start, line_end, visibility, doc, signature, flags, complexity)",
    "l": f"WITH f AS ({_FILES}) {_linked(_CALLS, 'calls')} UNION ALL {_linked(_USES, 'uses_type')} UNION ALL SELECT path, far, 'imports' FROM f WHERE path <> far",
    "p": f"WITH f AS ({_FILES}) SELECT path AS source, 'std' AS target, 'imports' AS edge_type FROM f UNION ALL SELECT path || ':run' || k, 'std:ArrayList', 'uses_type' FROM f ",
}
_LABELS: dict[int, DataFrame] = {}


def zig(oracle: str):
    return query(oracle, TABLES)


def _labels(spark, d) -> DataFrame:
    """(id, label): a file's path, or a name below it or below the package that it is of."""
    g = S.graph(spark, d)
    if id(g) not in _LABELS:
        roots = g.nodes.where("kind = 'file' or parent_id is null").select(F.col("id").alias("root"), F.coalesce("file_path", "name").alias("at"))
        below = G.qualified_paths(g.nodes, roots.select(F.col("root").alias("id"))).join(roots, "root")
        own = roots.select(F.col("root").alias("id"), F.col("at").alias("label"))
        _LABELS[id(g)] = cut(own.unionByName(below.select("id", F.concat("at", F.lit(":"), "path").alias("label"))))
    return _LABELS[id(g)]


def _nodes(spark, d, external: bool = False) -> DataFrame:
    n = S.graph(spark, d).nodes.join(_labels(spark, d), "id")
    return n.where(T.internal() != F.lit(external))


def _edges(spark, d, source: str) -> DataFrame:
    of = lambda end: _labels(spark, d).select(F.col("id").alias(f"{end}_id"), F.col("label").alias(f"{end}_label"))
    e = S.graph(spark, d).edges.where(F.col("source") == source).join(of("source"), "source_id").join(of("target"), "target_id")
    return e.select(F.col("source_label").alias("source"), F.col("target_label").alias("target"), "edge_type")


# extraction


@zig("SELECT label, kind, line_start, line_end, visibility FROM d")
def zig_extract_fixture(spark, d):
    return _nodes(spark, d).select("label", "kind", "line_start", "line_end", "visibility")


@zig("SELECT kind, count(*) AS n FROM d GROUP BY kind")
def zig_nodes_by_kind(spark, d):
    return G.counts_by(_nodes(spark, d), "kind")


@zig("SELECT label, CASE WHEN contains(label, '.zig:') THEN regexp_replace(label, '[:.][^:.]*$', '') ELSE '' END AS parent FROM d")
def zig_parents(spark, d):
    up = _labels(spark, d).select(F.col("id").alias("parent_id"), F.col("label").alias("parent"))
    return _nodes(spark, d).join(up, "parent_id", "left").select("label", F.coalesce("parent", F.lit("")).alias("parent"))


@zig("SELECT label, doc FROM d WHERE doc IS NOT NULL")
def zig_doc_comments(spark, d):
    return _nodes(spark, d).where("doc is not null").select("label", "doc")


@zig("SELECT label, signature FROM d WHERE signature IS NOT NULL")
def zig_signatures(spark, d):
    return _nodes(spark, d).where("signature is not null").select("label", "signature")


@zig("SELECT label, flags FROM d WHERE flags <> ''")
def zig_flags(spark, d):
    n = _nodes(spark, d).select("label", T.flags_text("lang_meta").alias("flags"))
    return n.where("flags <> ''")


@zig("SELECT label, CAST(complexity AS INT) AS complexity, CAST(line_end - line_start + 1 AS BIGINT) AS lines FROM d WHERE complexity IS NOT NULL")
def zig_metrics(spark, d):
    return _nodes(spark, d).where("metrics is not null").select("label", "metrics.complexity", "metrics.lines")


# name resolution


@zig("SELECT source, target, edge_type FROM l WHERE edge_type = 'imports'")
def zig_imports(spark, d):
    return _edges(spark, d, "tree_sitter").where("edge_type = 'imports'")


@zig("SELECT source, target FROM l WHERE edge_type = 'calls' AND split_part(source, ':', 1) = split_part(target, ':', 1)")
def zig_calls_inside_files(spark, d):
    e = _edges(spark, d, "tree_sitter").where("edge_type = 'calls' and split_part(source, ':', 1) = split_part(target, ':', 1)")
    return e.select("source", "target")


@zig("SELECT source, target FROM l WHERE edge_type = 'calls' AND split_part(source, ':', 1) <> split_part(target, ':', 1)")
def zig_calls_across_files(spark, d):
    e = _edges(spark, d, "tree_sitter").where("edge_type = 'calls' and split_part(source, ':', 1) <> split_part(target, ':', 1)")
    return e.select("source", "target")


@zig("SELECT source, target FROM l WHERE edge_type = 'uses_type'")
def zig_type_uses(spark, d):
    return _edges(spark, d, "tree_sitter").where("edge_type = 'uses_type'").select("source", "target")


@zig("SELECT edge_type, 'tree_sitter' AS source, count(*) AS n FROM l GROUP BY edge_type UNION ALL SELECT edge_type, 'phantom', count(*) FROM p GROUP BY edge_type")
def zig_edges_by_type_and_source(spark, d):
    return S.graph(spark, d).edges.groupBy("edge_type", "source").agg(F.count("*").alias("n"))


@zig("SELECT * FROM (VALUES ('std', 'module'), ('std:ArrayList', 'type_def'), ('std:debug', 'module'), ('std:debug.print', 'module')) v(label, kind) WHERE EXISTS (SELECT 1 FROM f )")
def zig_external_symbols(spark, d):
    return _nodes(spark, d, True).select("label", "kind")


@zig("SELECT source, target, edge_type FROM p")
def zig_external_edges(spark, d):
    return _edges(spark, d, "phantom")


@zig("SELECT split_part(source, ':', 1) AS src_file, split_part(target, ':', 1) AS tgt_file, edge_type, count(*) AS n FROM l WHERE split_part(source, ':', 1) <> split_part(target, ':', 1) GROUP BY 1, 2, 3 UNION ALL SELECT split_part(source, ':', 1), '<ext>', edge_type, count(*) FROM p GROUP BY 1, 2, 3")
def zig_cross_file_summary(spark, d):
    g = S.graph(spark, d)
    return G.cross_summary(g.edges, G.owning(g.nodes), g.nodes)


# whole rendered texts

_STAMP = "2026-01-01T00:00:00Z"
#: q: a file with its rank by path (r) and that of the file it imports (jr); g: drawn edges, with the order of both ends.
_DRAWN = """
WITH q AS (
  SELECT a.*, b.r AS jr FROM (SELECT *, row_number() OVER (ORDER BY path) AS r FROM f ) a
  JOIN (SELECT k AS jk, row_number() OVER (ORDER BY path) AS r FROM f ) b ON a.j = b.jk
), g AS (
  SELECT 'calls' AS t, 'fn' AS p, 5 * r - 3 AS n, 4 AS o, 'fn' AS tp, 5 * r - 2 AS tn, 4 AS tr, '' AS path FROM q
  UNION SELECT 'calls', 'fn', 5 * r - 2, 4, 'fn', 5 * jr - 1, 4, '' FROM q
  UNION SELECT 'calls', 'fn', 5 * r - 1, 4, 'fn', unnest([5 * jr - 4, 5 * jr - 3, 5 * r - 4, 5 * r - 3, 5 * r - 2]), 4, '' FROM q
  UNION SELECT 'calls', 't', r, 8, 'fn', 5 * r - 1, 4, '' FROM q
  UNION SELECT 'imports', 'f', r, 3, 'f', jr, 3, '' FROM q WHERE j <> k
  UNION SELECT 'imports', 'f', r, 3, 'x', 1, 9, '' FROM q
  UNION SELECT 'uses_type', 'fn', unnest([5 * r - 4, 5 * r - 3, 5 * r - 1]), 4, 'st', r, 6, '' FROM q
  UNION SELECT 'uses_type', 'fn', 5 * r - 1, 4, 'st', jr, 6, '' FROM q
  UNION SELECT 'uses_type', 'fn', 5 * r - 1, 4, 'x', 1, 9, 'ArrayList' FROM q
  UNION SELECT 'uses_type', 'fn', 5 * r, 4, 'en', r, 1, '' FROM q
  UNION SELECT 'uses_type', 'fn', 5 * r, 4, 'un', r, 7, '' FROM q
), c AS (SELECT count(*) AS c FROM f )
"""


def _section(s: int, name: str, first: bool = False) -> str:
    blank = "" if first else f"SELECT {s}, 0, 0, 0, '' UNION ALL "
    return f"{blank}SELECT {s}, 1, 0, 0, '[{name}]'"


_LISTING = " UNION ALL ".join([
    "SELECT 0 AS s, 1 AS a, 0 AS b, 0 AS d, '# graphloom graph -- suppliers' AS line FROM c",
    "SELECT 0, 2, 0, 0, '# ' || c || ' files, ' || 3 * c || ' functions, ' || c || ' structs, ' || c || ' unions, ' || c || ' enums, ' || c || ' constants, ' || c || ' tests, 1 externals' FROM c",
    "SELECT 0, 3, 0, 0, '# languages: zig'",
    f"SELECT 0, 4, 0, 0, '# generated {_STAMP}'",
    "SELECT 0, 5, 0, 0, ''",
    _section(1, "files", True),
    "SELECT 2, r, 0, 0, 'f:' || r || ' ' || path || ' 50L' FROM q",
    _section(3, "structs"),
    "SELECT 4, r, 0, 0, 'st:' || r || ' Box' || k || ' f:' || r || ':7 pub' FROM q",
    "SELECT 4, r, 1, 0, '  .size .next' FROM q",
    "SELECT 4, r, 2, 0, '  fn init() fn grow()' FROM q",
    _section(5, "unions"),
    "SELECT 6, r, 0, 0, 'un:' || r || ' Value' || k || ' f:' || r || ':22 pub' FROM q",
    "SELECT 6, r, 1, 0, '  .a .b' FROM q",
    _section(7, "enums"),
    "SELECT 8, r, 0, 0, 'en:' || r || ' Kind' || k || ' f:' || r || ':21 pub' FROM q",
    _section(9, "functions"),
    "SELECT 10, r, 1, 0, 'fn:' || 5 * r - 2 || ' tune' || k || '() f:' || r || ':26' FROM q",
    "SELECT 10, r, 2, 0, 'fn:' || 5 * r - 1 || ' run' || k || '() f:' || r || ':31 pub' FROM q",
    "SELECT 10, r, 3, 0, 'fn:' || 5 * r || ' kinds' || k || '() f:' || r || ':41' FROM q",
    _section(11, "constants"),
    "SELECT 12, r, 0, 0, 'c:' || r || ' limit' || k || ' f:' || r || ':24' FROM q",
    _section(13, "errors"),
    "SELECT 14, r, 0, 0, 'err:' || r || ' Failure' || k || ' f:' || r || ':23' FROM q",
    _section(15, "tests"),
    "SELECT 16, r, 0, 0, 't:' || r || ' \"run ' || k || '\" f:' || r || ':48 3L' FROM q",
    _section(17, "externals"),
    "SELECT 18, 1, 0, 0, 'x:1 std (stdlib)' UNION ALL SELECT 18, 2, 0, 0, '  ArrayList' UNION ALL SELECT 18, 3, 0, 0, '  debug' UNION ALL SELECT 18, 4, 0, 0, '  debug.print'",
    _section(19, "edges"),
    "SELECT CASE t WHEN 'calls' THEN 20 WHEN 'imports' THEN 21 ELSE 22 END, o, n, 0, p || ':' || n || ' ' || t || ' ' || string_agg(tp || ':' || tn || CASE path WHEN '' THEN '' ELSE ':' || path END, ' ' ORDER BY tr, tn) FROM g GROUP BY t, o, p, n",
])


@zig(_DRAWN + f"SELECT row_number() OVER (ORDER BY s, a, b, d) AS line_no, line FROM ({_LISTING}) x")
def ctg_whole_text(spark, d):
    from graphloom.render.ctg import render_ctg

    return render_ctg(S.graph(spark, d), "suppliers", timestamp=_STAMP, tests=True, externals=True)


@zig(_DRAWN + "SELECT t AS edge_type, p || ':' || n || ' ' || t || ' ' || string_agg(tp || ':' || tn, ' ' ORDER BY tr, tn) AS line FROM g WHERE tp <> 'x' GROUP BY t, o, p, n")
def ctg_edges_section(spark, d):
    from graphloom.render import ctg, ids

    g = S.graph(spark, d)
    return ctg.edge_lines(ids.assign(g.nodes, tests=True), g.edges).select("edge_type", "line")


def _marked(s: int, name: str) -> str:
    return f"SELECT {s}, 0, 0, 0, '' UNION ALL SELECT {s}, 1, 0, 0, '    %% === {name} ==='"


def _drawn(rank: int, number: str, shape: str) -> str:
    return f"SELECT 12, r, 1, CAST({rank} AS BIGINT) * 4294967296 + {number}, '        ' || {shape} FROM q"


def _styled(s: int, style: str, ids: str) -> str:
    return f"SELECT 50, {s}, 0, 0, '    class ' || string_agg({ids}, ',' ORDER BY r) || ' {style}' FROM q HAVING count(*) > 0"


def _chart() -> str:
    from graphloom.render.mermaid import STYLES

    top = ["flowchart TB", "    %% === Class definitions ===", *(f"    classDef {s}" for s in STYLES)]
    return " UNION ALL ".join([
        "SELECT 0 AS s, CAST(1 AS BIGINT) AS a, CAST(0 AS BIGINT) AS b, CAST(0 AS BIGINT) AS d, '%% graphloom mermaid -- suppliers' AS line",
        "SELECT 0, 2, 0, 0, '%% ' || c || ' files, ' || 3 * c || ' functions, ' || c || ' structs, ' || c || ' enums, ' || c || ' constants, ' || c || ' tests, 1 externals' FROM c",
        f"SELECT 0, 3, 0, 0, '%% generated {_STAMP}' UNION ALL SELECT 0, 4, 0, 0, ''",
        *(f"SELECT 0, {5 + k}, 0, 0, '{x}'" for k, x in enumerate(top)),
        _marked(11, "File subgraphs"),
        "SELECT 12, r, 0, 0, '    subgraph f_' || r || '[\"' || path || '\"]' FROM q",
        _drawn(0, "r", "'c_' || r || '[/\"const: limit' || k || '\"/]'"),
        _drawn(1, "r", "'en_' || r || '{{\"enum: Kind' || k || '\"}}'"),
        _drawn(2, "r", "'err_' || r || '[/\"error: Failure' || k || '\"\\]'"),
        *(_drawn(4, f"5 * r - {4 - i}", f"'fn_' || 5 * r - {4 - i} || '[\"fn: {x}'") for i, x in enumerate(["Box' || k || '.init\"]", "Box' || k || '.grow\"]", "tune' || k || '\"]", "run' || k || '\"]", "kinds' || k || '\"]"])),
        _drawn(6, "r", "'st_' || r || '[[\"struct: Box' || k || '\"]]'"),
        _drawn(7, "r", "'un_' || r || '((\"union: Value' || k || '\"))'"),
        _drawn(8, "r", "'t_' || r || '([\"test: run ' || k || '\"])'"),
        "SELECT 12, r, 2, 0, '    end' FROM q",
        _marked(13, "Phantom subgraphs"),
        "SELECT 14, 1, 0, 0, '    subgraph x_std[\"std (stdlib)\"]' UNION ALL SELECT 14, 2, 0, 0, '        x_1_ArrayList[\"ext: ArrayList\"]'",
        "SELECT 14, 3, 0, 0, '        x_1_debug[\"ext: debug\"]' UNION ALL SELECT 14, 4, 0, 0, '        x_1_debug_print[\"ext: debug.print\"]' UNION ALL SELECT 14, 5, 0, 0, '    end'",
        _marked(15, "Ghost nodes"),
        _marked(16, "Edges"),
        "SELECT CASE t WHEN 'calls' THEN 20 WHEN 'imports' THEN 21 ELSE 22 END, o * 4294967296 + n, tr * 4294967296 + tn, 0, '    ' || p || '_' || n || CASE t WHEN 'imports' THEN ' -.-> ' ELSE ' --> ' END || tp || '_' || tn || CASE path WHEN '' THEN '' ELSE '_' || path END FROM g",
        _marked(40, "Class assignments"),
        _styled(1, "const_style", "'c_' || r"),
        _styled(2, "en_style", "'en_' || r"),
        _styled(3, "err_style", "'err_' || r"),
        _styled(4, "fn_style", "'fn_' || 5 * r - 4 || ',fn_' || 5 * r - 3 || ',fn_' || 5 * r - 2 || ',fn_' || 5 * r - 1 || ',fn_' || 5 * r"),
        "SELECT 50, 5, 0, 0, '    class x_1_ArrayList,x_1_debug,x_1_debug_print phantom_style'",
        _styled(6, "st_style", "'st_' || r"),
        _styled(7, "test_style", "'t_' || r"),
        _styled(8, "un_style", "'un_' || r"),
    ])


@zig(_DRAWN + f"SELECT row_number() OVER (ORDER BY s, a, b, d) AS line_no, line FROM ({_chart()}) x")
def mermaid_whole_text(spark, d):
    from graphloom.render.mermaid import render_mermaid

    return render_mermaid(S.graph(spark, d), "suppliers", timestamp=_STAMP, tests=True, externals=True)
