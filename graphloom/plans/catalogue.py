"""Operators as queries over the test tables, with SQL of the same meaning where SQL can say it.

Extraction from sources and name resolution are in ``extraction``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.functions import text as T
from graphloom.operators import graph as G
from graphloom.plans import adapters as A
from graphloom.plans import extraction
from graphloom.plans.registry import ORACLES, QUERIES, query

__all__ = ["ORACLES", "QUERIES", "extraction"]


def _table(spark, d, name) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


# counts


@query("SELECT kind, count(*) AS n FROM n GROUP BY kind")
def node_counts_by_kind(spark, d):
    return G.counts_by(A.nodes(spark, d), "kind")


@query("SELECT edge_type, count(*) AS n FROM e GROUP BY edge_type")
def edge_counts_by_type(spark, d):
    return G.counts_by(A.edges(spark, d), "edge_type")


@query("SELECT (SELECT count(*) FROM n ) AS nodes, (SELECT count(*) FROM e ) AS edges")
def graph_counts(spark, d):
    return A.nodes(spark, d).agg(F.count("*").alias("nodes")).crossJoin(A.edges(spark, d).agg(F.count("*").alias("edges")))


# edges as a set


@query("SELECT DISTINCT source_id, target_id, edge_type FROM r WHERE source_id <> target_id")
def dedup_edges(spark, d):
    return G.dedup_edges(A.raw_edges(spark, d), "ord").select(*G.KEY)


@query("SELECT source_id, target_id, edge_type, source, ord FROM (SELECT *, row_number() OVER (PARTITION BY source_id, target_id, edge_type ORDER BY ord) AS k FROM r WHERE source_id <> target_id) x WHERE k = 1")
def dedup_edges_first_source(spark, d):
    return G.dedup_edges(A.raw_edges(spark, d), "ord")


@query("SELECT source_id, edge_type FROM r WHERE source_id = target_id")
def self_loop_reject(spark, d):
    return G.self_loops(A.raw_edges(spark, d)).select("source_id", "edge_type")


@query("SELECT DISTINCT source_id, target_id, edge_type FROM r")
def edge_keys(spark, d):
    return G.edge_keys(A.raw_edges(spark, d))


@query("SELECT source_id, target_id, edge_type FROM e WHERE source_id IN (SELECT id FROM n WHERE visibility = 'public' OR kind = 'field') AND target_id IN (SELECT id FROM n WHERE visibility = 'public' OR kind = 'field')")
def semi_join_dangling(spark, d):
    return G.without_dangling(A.edges(spark, d), A.nodes(spark, d).where("visibility = 'public' or kind = 'field'")).select(*G.KEY)


# lookups: whole tables of keys, joined, never one id at a time


@query("SELECT id, name, kind FROM n WHERE id IN (SELECT target_id FROM e )")
def get_node(spark, d):
    return G.node(A.nodes(spark, d), A.edges(spark, d).select(F.col("target_id").alias("id"))).select("id", "name", "kind")


@query("SELECT id, parent_id, name FROM n WHERE parent_id IN (SELECT id FROM n WHERE kind = 'type_def')")
def children_of(spark, d):
    n = A.nodes(spark, d)
    return G.children(n, n.where("kind = 'type_def'")).select("id", "parent_id", "name")


@query("SELECT c.id, coalesce(p.id, -1) AS parent_id FROM n c LEFT JOIN n p ON c.parent_id = p.id")
def parent_of(spark, d):
    return G.parents(A.nodes(spark, d)).fillna(-1, ["parent_id"])


@query("SELECT source_id, target_id, edge_id FROM e WHERE source_id IN (SELECT id FROM n )")
def out_edges(spark, d):
    return G.out_edges(A.edges(spark, d), A.nodes(spark, d)).select("source_id", "target_id", "edge_id")


@query("SELECT source_id, target_id, edge_id FROM e WHERE target_id IN (SELECT id FROM n )")
def in_edges(spark, d):
    return G.in_edges(A.edges(spark, d), A.nodes(spark, d)).select("source_id", "target_id", "edge_id")


@query("SELECT source_id AS id, target_id AS neighbor, 0 AS leg, edge_id FROM e UNION ALL SELECT target_id, source_id, 1, edge_id FROM e")
def neighbors_both_bag(spark, d):
    return G.neighbors(A.edges(spark, d), A.nodes(spark, d), "both")


@query("SELECT source_id AS id, target_id AS neighbor FROM e")
def neighbors_out(spark, d):
    return G.neighbors(A.edges(spark, d), A.nodes(spark, d), "out").select("id", "neighbor")


@query("SELECT target_id AS id, source_id AS neighbor FROM e")
def neighbors_in(spark, d):
    return G.neighbors(A.edges(spark, d), A.nodes(spark, d), "in").select("id", "neighbor")


@query("SELECT n.id, count(CASE WHEN s = 0 THEN 1 END) AS out_degree, count(CASE WHEN s = 1 THEN 1 END) AS in_degree FROM n LEFT JOIN (SELECT source_id AS id, 0 AS s FROM e UNION ALL SELECT target_id, 1 FROM e ) x ON n.id = x.id GROUP BY n.id")
def degrees(spark, d):
    return G.degrees(A.nodes(spark, d), A.edges(spark, d))


@query("SELECT id, out_degree, CAST(coalesce(sum(out_degree) OVER (ORDER BY id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS \"offset\" FROM (SELECT n.id, count(e.source_id) AS out_degree FROM n LEFT JOIN e ON n.id = e.source_id GROUP BY n.id) x")
def degrees_csr(spark, d):
    return G.csr_offsets(G.degrees(A.nodes(spark, d), A.edges(spark, d))).select("id", "out_degree", "offset")


@query("SELECT source_id AS id, string_agg(CAST(edge_id AS VARCHAR), ',' ORDER BY edge_id) AS members FROM e GROUP BY source_id")
def adjacency_lists(spark, d):
    out = G.adjacency(A.nodes(spark, d), A.edges(spark, d))["out"]
    return out.select("id", F.array_join(F.transform("members", lambda x: x.cast("string")), ",").alias("members"))


@query("SELECT parent_id AS id, string_agg(CAST(id AS VARCHAR), ',' ORDER BY id) AS members FROM n WHERE parent_id IN (SELECT id FROM n ) GROUP BY parent_id")
def child_lists(spark, d):
    out = G.adjacency(A.nodes(spark, d), A.edges(spark, d))["children"]
    return out.select("id", F.array_join(F.transform("members", lambda x: x.cast("string")), ",").alias("members"))


_WANTED = """
SELECT c_custkey + 3000000000 AS source_id, CAST(c_custkey % 10 + 1 AS BIGINT) + 5000000000 AS target_id, 'calls' AS edge_type FROM {customer}
UNION ALL SELECT CAST(r_regionkey AS BIGINT) + 1000000000, CAST((r_regionkey + 1) % 5 AS BIGINT) + 1000000000, 'imports' FROM {region}
UNION ALL SELECT CAST(r_regionkey AS BIGINT) + 1000000000, CAST((r_regionkey + 1) % 5 AS BIGINT) + 1000000000, 'calls' FROM {region}
"""


@query(f"WITH w AS ({A.duck(_WANTED)}) SELECT w.*, EXISTS (SELECT 1 FROM e WHERE e.source_id = w.source_id AND e.target_id = w.target_id AND e.edge_type = w.edge_type) AS held FROM w")
def has_edge(spark, d):
    return G.held_edges(A.edges(spark, d), A.sql(spark, d, _WANTED))


@query("SELECT target_id AS id, string_agg(CAST(edge_id AS VARCHAR), ',' ORDER BY edge_id) AS members FROM e GROUP BY target_id")
def incoming_lists(spark, d):
    into = G.adjacency(A.nodes(spark, d), A.edges(spark, d))["into"]
    return into.select("id", F.array_join(F.transform("members", lambda x: x.cast("string")), ",").alias("members"))


# closure


@query("WITH RECURSIVE a AS (SELECT c.id, c.parent_id AS ancestor, 1 AS hops FROM n c WHERE parent_id IS NOT NULL UNION ALL SELECT a.id, p.parent_id, a.hops + 1 FROM a JOIN n p ON a.ancestor = p.id WHERE p.parent_id IS NOT NULL) SELECT id, ancestor, CAST(hops AS INT) AS hops FROM a")
def ancestor_closure(spark, d):
    return G.ancestors(A.nodes(spark, d)).select("id", "ancestor", F.col("hops").cast("int").alias("hops"))


@query("WITH RECURSIVE a AS (SELECT c.id, c.parent_id AS ancestor FROM n c WHERE parent_id IS NOT NULL UNION ALL SELECT a.id, p.parent_id FROM a JOIN n p ON a.ancestor = p.id WHERE p.parent_id IS NOT NULL) SELECT DISTINCT o_orderkey + 4000000000 AS id, CAST(s_nationkey AS BIGINT) + 2000000000 AS ancestor FROM orders JOIN lineitem ON o_orderkey = l_orderkey JOIN supplier ON l_suppkey = s_suppkey JOIN a ON a.id = o_orderkey + 4000000000 AND a.ancestor = CAST(s_nationkey AS BIGINT) + 2000000000")
def is_descendant_of(spark, d):
    pairs = A.sql(spark, d, "SELECT DISTINCT o_orderkey + 4000000000 AS id, CAST(s_nationkey AS BIGINT) + 2000000000 AS ancestor FROM {orders} JOIN {lineitem} ON o_orderkey = l_orderkey JOIN {supplier} ON l_suppkey = s_suppkey")
    return G.descendant_of(A.nodes(spark, d), pairs)


_OWNER = "WITH RECURSIVE w AS (SELECT id, id AS here, kind, parent_id FROM n UNION ALL SELECT w.id, p.id, p.kind, p.parent_id FROM w JOIN n p ON w.parent_id = p.id WHERE w.kind <> 'file'), o AS (SELECT id, max(CASE WHEN kind = 'file' THEN here END) AS owner FROM w GROUP BY id)"


@query(_OWNER + " SELECT id, coalesce(owner, -1) AS owner FROM o")
def owning_file(spark, d):
    return G.owning(A.nodes(spark, d)).fillna(-1, ["owner"])


_SUMMARY = _OWNER + ", f AS (SELECT o.id, o.owner, coalesce(n.name, '<ext>') AS f FROM o LEFT JOIN n ON o.owner = n.id), s AS (SELECT a.f AS src_file, b.f AS tgt_file, edge_type, count(*) AS n FROM e JOIN f a ON e.source_id = a.id JOIN f b ON e.target_id = b.id WHERE a.owner IS DISTINCT FROM b.owner GROUP BY 1, 2, 3)"


@query(_SUMMARY + " SELECT src_file, tgt_file, edge_type, n FROM s")
def cross_file_summary(spark, d):
    n = A.nodes(spark, d)
    parts = A.parts_of(spark, d)
    return G.cross_summary(A.edges(spark, d), G.owning(n), n, parts and 2 * parts)


@query(_SUMMARY + " SELECT src_file, tgt_file, string_agg(edge_type || '(' || n || ')', ',' ORDER BY CASE edge_type WHEN 'calls' THEN 0 WHEN 'imports' THEN 1 ELSE 2 END) AS edges FROM s GROUP BY 1, 2")
def cross_file_summary_text(spark, d):
    return G.cross_summary_text(cross_file_summary(spark, d))


@query("SELECT n.id, count(DISTINCT CASE WHEN e.target_id = n.id THEN e.source_id END) AS fan_in, count(DISTINCT CASE WHEN e.source_id = n.id THEN e.target_id END) AS fan_out FROM n LEFT JOIN (SELECT source_id, target_id, source_id AS k FROM e WHERE edge_type = 'calls' UNION ALL SELECT source_id, target_id, target_id FROM e WHERE edge_type = 'calls') e ON e.k = n.id WHERE kind IN ('function', 'constant') GROUP BY n.id")
def fan_in_out(spark, d):
    n = A.nodes(spark, d).where("kind in ('function', 'constant')")
    return G.degrees(n, A.edges(spark, d).where("edge_type = 'calls'")).select("id", F.col("in_degree").alias("fan_in"), F.col("out_degree").alias("fan_out"))


_DEPENDS = "SELECT CAST(floor(p_partkey / 2) AS BIGINT) AS \"on\", p_partkey AS id FROM part UNION ALL SELECT CAST(floor(p_partkey / 3) AS BIGINT), p_partkey FROM part"


@query("WITH RECURSIVE l AS (" + _DEPENDS + "), w AS (SELECT p_partkey AS id, 0 AS level FROM part UNION SELECT l.id, w.level + 1 FROM w JOIN l ON l.\"on\" = w.id WHERE l.id <> l.\"on\") SELECT id, CAST(max(level) AS INT) AS level FROM w GROUP BY id")
def topo_levels(spark, d):
    depends = A.sql(spark, d, _DEPENDS.replace('"on"', "`on`").replace("FROM part", "FROM {part}"))
    return G.topological_levels(_table(spark, d, "part").select(F.col("p_partkey").alias("id")), depends)


# phantoms

_HOSTS = "SELECT page_id AS ord, regexp_extract(url, '^https?://([^/?#]+)', 1) AS name, CASE WHEN page_id % 3 = 0 THEN 'type_def' ELSE 'function' END AS kind FROM pages"
_PREFIXES = f"WITH h AS ({_HOSTS}), p AS (SELECT ord, kind, string_split(name, '.') AS s FROM h WHERE name <> ''), x AS (SELECT ord, kind, s, unnest(range(1, len(s) + 1)) AS depth FROM p), y AS (SELECT array_to_string(s[1:depth], '.') AS qualified, s[depth] AS name, CAST(depth AS INT) AS depth, CASE WHEN depth = len(s) THEN kind ELSE 'module' END AS kind, CASE WHEN depth > 1 THEN array_to_string(s[1:depth - 1], '.') END AS parent, row_number() OVER (PARTITION BY array_to_string(s[1:depth], '.') ORDER BY ord, depth) AS k FROM x)"


def _hosts(spark, d) -> DataFrame:
    return G.phantoms(A.sql(spark, d, _HOSTS.replace("FROM pages", "FROM {pages}")).withColumn("external", F.lit("dependency")))


@query(_PREFIXES + " SELECT qualified, name, depth FROM y WHERE k = 1")
def phantom_prefixes(spark, d):
    return _hosts(spark, d).select("qualified", "name", "depth")


@query(_PREFIXES + " SELECT qualified, parent FROM y WHERE k = 1")
def phantom_parent_chain(spark, d):
    return _hosts(spark, d).select("qualified", "parent")


@query(_PREFIXES + " SELECT qualified, kind FROM y WHERE k = 1")
def phantom_kind_first(spark, d):
    return _hosts(spark, d).select("qualified", "kind")


@query("WITH RECURSIVE w AS (SELECT id AS root, id, CAST(NULL AS VARCHAR) AS path FROM n WHERE kind IN ('file', 'module') UNION ALL SELECT w.root, c.id, CASE WHEN w.path IS NULL THEN c.name ELSE w.path || '.' || c.name END FROM w JOIN n c ON c.parent_id = w.id) SELECT root, id, path FROM w WHERE path IS NOT NULL")
def qualified_paths(spark, d):
    n = A.nodes(spark, d)
    return G.qualified_paths(n, n.where("kind in ('file', 'module')"))


# text


@query("SELECT doc_id, CAST(CASE WHEN text = '' THEN 0 ELSE length(text) - length(replace(text, chr(10), '')) + CASE WHEN right(text, 1) = chr(10) THEN 0 ELSE 1 END END AS BIGINT) AS lines FROM documents")
def line_counts(spark, d):
    return _table(spark, d, "documents").select("doc_id", T.count_lines("text").alias("lines"))


@query(r"SELECT doc_id, CAST(1 + len(regexp_extract_all(text, '(^|[^A-Za-z0-9_])(if|for|while|switch|catch)\b')) AS INT) AS complexity FROM (SELECT doc_id, regexp_replace(text, '[^\x00-\x7f]', ' ', 'g') AS text FROM documents) x")
def complexity(spark, d):
    return _table(spark, d, "documents").select("doc_id", T.complexity("text").alias("complexity"))


@query("SELECT doc_id, CASE WHEN 2 > lines THEN text ELSE array_to_string(s[2:4], chr(10)) || CASE WHEN len(s) > 4 THEN chr(10) ELSE '' END END AS part FROM (SELECT doc_id, text, string_split(text, chr(10)) AS s, CASE WHEN text = '' THEN 0 ELSE length(text) - length(replace(text, chr(10), '')) + CASE WHEN right(text, 1) = chr(10) THEN 0 ELSE 1 END END AS lines FROM documents) x")
def line_slice(spark, d):
    return _table(spark, d, "documents").select("doc_id", T.line_range("text", 2, 4).alias("part"))


@query(r"""
WITH p AS (SELECT page_id, regexp_extract_all(replace(html, 'href="', '@import("'), '@import\("([^"]*)"', 1) AS paths FROM pages)
SELECT page_id, CAST(pos AS INT) AS pos, path FROM (SELECT page_id, unnest(paths) AS path, unnest(range(0, len(paths))) AS pos FROM p) x
""")
def extract_imports(spark, d):
    html = F.replace(F.col("html"), F.lit('href="'), F.lit('@import("'))
    return _table(spark, d, "pages").select("page_id", F.posexplode(T.import_paths(html)).alias("pos", "path"))


@query("SELECT p_partkey, CASE WHEN p_type IN ('std', 'builtin') THEN 'stdlib' WHEN right(p_type || CASE WHEN p_size % 2 = 0 THEN '.zig' ELSE '' END, 4) = '.zig' THEN 'project_file' ELSE 'unknown' END AS kind FROM part")
def classify_import(spark, d):
    return _table(spark, d, "part").select("p_partkey", T.import_kind(F.concat("p_type", F.when(F.col("p_size") % 2 == 0, ".zig").otherwise(""))).alias("kind"))


_URL_PATH = "regexp_extract(url, '^https?://[^/?#]+/([^?#]*)', 1)"


@query(f"SELECT page_id, CASE WHEN len(s) = 0 THEN NULL ELSE array_to_string(list_concat(s[1:len(s) - 1], ['up', 'x.zig']), '/') END AS path FROM (SELECT page_id, list_filter(string_split(CASE WHEN contains({_URL_PATH}, '/') THEN regexp_replace({_URL_PATH}, '/[^/]*$', '') ELSE '' END, '/'), lambda x: x <> '' AND x <> '.') AS s FROM pages) x")
def resolve_relative_path(spark, d):
    return _table(spark, d, "pages").select("page_id", T.resolve_import(F.expr(_URL_PATH), F.lit(".././up//./x.zig")).alias("path"))


@query(r"""
SELECT p_partkey, regexp_extract(p_name, '[^ ]+$') AS base, list_contains(string_split(p_name, ' '), 'red') AS has_part,
  regexp_extract(regexp_extract(p_name, '[^ ]+$') || CASE p_size % 3 WHEN 0 THEN '.x.zig' WHEN 1 THEN '.' ELSE '' END, '^.+(\.[^.]*)$', 1) AS ending
FROM part
""")
def path_parts(spark, d):
    p = F.replace(F.col("p_name"), F.lit(" "), F.lit("/"))
    named = F.concat(p, F.when(F.col("p_size") % 3 == 0, ".x.zig").when(F.col("p_size") % 3 == 1, ".").otherwise(""))
    return _table(spark, d, "part").select("p_partkey", T.basename(p).alias("base"), T.has_component(p, "red").alias("has_part"), T.extension(named).alias("ending"))


@query("SELECT p_partkey FROM part WHERE NOT list_contains(string_split(p_name, ' '), 'ring') AND p_name <> 'red widget'")
def exclude_paths(spark, d):
    p = F.replace(F.col("p_name"), F.lit(" "), F.lit("/"))
    return _table(spark, d, "part").where(~T.excluded(p, ["ring", "red/widget"])).select("p_partkey")


@query("SELECT id, name FROM n WHERE file_path LIKE 'A%'")
def scope_prefix(spark, d):
    return A.nodes(spark, d).where(T.in_scope("file_path", "A")).select("id", "name")


@query("SELECT doc_id, replace(replace(replace(text, '\"', '&quot;'), '<', '&lt;'), '>', '&gt;') AS escaped FROM documents")
def mermaid_escape(spark, d):
    return _table(spark, d, "documents").select("doc_id", T.flow_escape("text").alias("escaped"))


@query("SELECT id, CASE WHEN kind IN ('type_def', 'enum_def', 'union_def') OR (kind IN ('constant', 'import_decl') AND regexp_matches(name, '^[A-Z]')) THEN TRUE ELSE FALSE END AS is_type FROM n")
def type_reference(spark, d):
    return A.nodes(spark, d).select("id", T.type_reference(F.col("kind"), F.col("name")).alias("is_type"))


_SIGNATURE = "CASE p_size % 4 WHEN 0 THEN 'fn f() void' WHEN 1 THEN concat('pub fn g(a: u8) !*const mod.T', CAST(p_size AS STRING)) WHEN 2 THEN 'fn h() ?Foo' ELSE 'fn i(x: Y) Error!Bar ' END"


@query("SELECT p_partkey, CASE p_size % 4 WHEN 0 THEN 'void' WHEN 1 THEN 'mod,T' || p_size WHEN 2 THEN 'Foo' ELSE 'Bar' END AS type FROM part")
def return_types(spark, d):
    return _table(spark, d, "part").select("p_partkey", F.array_join(T.return_type(F.expr(_SIGNATURE)), ",").alias("type"))


@query(r"""
SELECT p_partkey, array_to_string(list_transform(regexp_extract_all('std.' || replace(p_name, ' ', '.') || '.. mystd.no (std.' || lower(p_brand) || ')std.x', '(^|[^A-Za-z0-9_])(std\.[A-Za-z0-9_.]+)', 2),
  lambda x: regexp_replace(x, '\.+$', '')), ',') AS chains FROM part
""")
def dotted_chains(spark, d):
    text = F.concat(F.lit("std."), F.replace(F.col("p_name"), F.lit(" "), F.lit(".")), F.lit(".. mystd.no (std."), F.lower("p_brand"), F.lit(")std.x"))
    return _table(spark, d, "part").select("p_partkey", F.array_join(T.dotted_chains(text), ",").alias("chains"))


@query(r"SELECT p_partkey, regexp_matches(p_name, '^red([^A-Za-z0-9_]|$)') AS starts FROM part")
def starts_with_keyword(spark, d):
    return _table(spark, d, "part").select("p_partkey", T.starts_with_keyword("p_name", "red").alias("starts"))


@query("SELECT doc_id, CAST(1 + length(head) - length(replace(head, chr(10), '')) AS BIGINT) AS line FROM (SELECT doc_id, left(text, CAST(floor(length(text) / 2) AS INT)) AS head FROM documents) x")
def line_of_offset(spark, d):
    return _table(spark, d, "documents").select("doc_id", T.line_of_offset("text", F.floor(F.length("text") / 2).cast("int")).alias("line"))


@query("SELECT page_id, contains(string_split(left(html, CAST(floor(length(html) / 2) AS INT)), chr(10))[-1], '//') AS inside FROM pages")
def in_line_comment(spark, d):
    before = F.substring(F.col("html"), F.lit(1), F.floor(F.length("html") / 2).cast("int"))
    return _table(spark, d, "pages").select("page_id", T.in_line_comment(before).alias("inside"))


@query("SELECT o_orderkey, CAST(floor((o_orderkey + 7) / 8) AS BIGINT) * 8 AS aligned FROM orders")
def align8(spark, d):
    return _table(spark, d, "orders").select("o_orderkey", T.align8(F.col("o_orderkey")).cast("long").alias("aligned"))


@query("SELECT o_orderkey, strftime(CAST(o_orderdate AS TIMESTAMP), '%Y-%m-%dT%H:%M:%SZ') AS stamp FROM orders")
def utc_stamp(spark, d):
    return _table(spark, d, "orders").select("o_orderkey", T.utc_stamp(F.col("o_orderdate").cast("timestamp")).alias("stamp"))


@query("SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN '' ELSE left(md5(text), 24) END AS hash FROM documents")
def hash_text_and_bytes(spark, d):
    text = F.when(F.col("doc_id") % 3 == 0, F.lit("no hash")).otherwise(F.substring(F.upper(F.md5("text")), 1, 24))
    return _table(spark, d, "documents").select("doc_id", F.coalesce(T.hash_text(T.hash_bytes(text)), F.lit("")).alias("hash"))


@query(r"""
SELECT p_partkey, '"' || replace(p_name, ' ', '\n') || '\\\"\u0001\t\r\u001f' || '"' AS json FROM part
""")
def json_strings(spark, d):
    text = F.concat(F.replace(F.col("p_name"), F.lit(" "), F.lit("\n")), F.lit('\\"\x01\t\r\x1f'))
    return _table(spark, d, "part").select("p_partkey", T.json_string(text).alias("json"))


@query("SELECT p_partkey, replace(p_name, ' ', '_') AS under FROM part")
def underscored(spark, d):
    return _table(spark, d, "part").select("p_partkey", T.underscored(F.replace(F.col("p_name"), F.lit(" "), F.lit("."))).alias("under"))


_FLAGS = (("is_comptime", 2), ("is_mutable", 3), ("is_inline", 4), ("is_extern", 5), ("is_packed", 6), ("comptime_conditional", 7))
_BITS = {"is_comptime": 1, "is_inline": 2, "is_extern": 4, "comptime_conditional": 8, "is_mutable": 16, "is_packed": 32}


@query(
    "SELECT p_partkey, "
    + " || ".join(f"CASE WHEN p_size % {k} = 0 THEN '  [{n.removeprefix('is_')}]' ELSE '' END" for n, k in _FLAGS)
    + " || CASE WHEN p_size % 8 = 0 THEN '  [callconv=C]' ELSE '' END AS flags, "
    + " + ".join(f"CASE WHEN p_size % {k} = 0 THEN {_BITS[n]} ELSE 0 END" for n, k in _FLAGS)
    + " AS bits FROM part"
)
def language_flags(spark, d):
    meta = F.struct(*[(F.col("p_size") % k == 0).alias(n) for n, k in _FLAGS], F.when(F.col("p_size") % 8 == 0, "C").alias("calling_convention"))
    p = _table(spark, d, "part").select("p_partkey", meta.alias("meta"))
    return p.select("p_partkey", T.flags_text("meta").alias("flags"), T.flags_bits("meta").alias("bits"))


# joins


_NORMAL = "SELECT p_partkey AS id, CASE WHEN p_size % 3 = 0 THEN 'x/' || p_name ELSE p_name END AS resolved, p_type || ' ' || CAST(p_size AS VARCHAR) AS raw FROM part"


@query("WITH f AS (SELECT p_name AS path, min(p_partkey) AS file_id FROM part GROUP BY p_name UNION ALL SELECT p_type || ' ' || CAST(p_size AS VARCHAR), min(p_partkey) FROM part GROUP BY 1), i AS (" + _NORMAL + ") SELECT i.id, coalesce(a.file_id, b.file_id) AS file_id FROM i LEFT JOIN f a ON i.resolved = a.path LEFT JOIN f b ON i.raw = b.path")
def import_join_fallback(spark, d):
    from graphloom.operators import resolve as R

    files = A.sql(spark, d, "SELECT p_name AS path, min(p_partkey) AS file_id FROM {part} GROUP BY p_name UNION ALL SELECT p_type || ' ' || CAST(p_size AS STRING), min(p_partkey) FROM {part} GROUP BY 1")
    return R.import_targets(A.sql(spark, d, _NORMAL.replace("FROM part", "FROM {part}").replace("VARCHAR", "STRING")), files).select("id", "file_id")


_LOOKED_UP = "SELECT c_custkey + 3000000000 AS caller, s_name AS name FROM {customer} JOIN {supplier} ON s_suppkey = c_custkey % 100"


@query(f"""
WITH RECURSIVE w AS (SELECT caller, name, caller AS scope, 0 AS hop FROM ({A.duck(_LOOKED_UP)}) x
  UNION ALL SELECT w.caller, w.name, p.parent_id, w.hop + 1 FROM w JOIN n p ON w.scope = p.id WHERE p.parent_id IS NOT NULL),
c AS (SELECT w.caller, w.name, w.hop, k.id AS found, row_number() OVER (PARTITION BY w.caller, w.name ORDER BY w.hop, k.id) AS rank
  FROM w JOIN n k ON k.parent_id = w.scope AND k.name = w.name WHERE k.kind IN ('field', 'constant'))
SELECT caller, name, found, CAST(hop AS INT) AS hops FROM c WHERE rank = 1
""")
def scoped_lookup_narrowest(spark, d):
    from graphloom.operators import resolve as R

    n = A.nodes(spark, d)
    return R.narrowest(A.sql(spark, d, _LOOKED_UP), n.where("kind in ('field', 'constant')"), G.ancestors(n))


@query("SELECT p_name AS name, min(p_partkey) AS id FROM part GROUP BY p_name, p_type, p_size HAVING count(*) = 1")
def unique_match_only(spark, d):
    from graphloom.operators import resolve as R

    return R.unique_only(_table(spark, d, "part").select(F.col("p_partkey").alias("id"), F.col("p_name").alias("name"), "p_type", "p_size"), ["name", "p_type", "p_size"], "id").select("name", "id")


@query("SELECT o_orderkey AS id, CASE WHEN o_orderstatus = 'F' THEN (CASE WHEN s.s_suppkey IS NOT NULL THEN 'supplier' END) WHEN c.c_custkey IS NOT NULL THEN 'customer' ELSE 'none' END AS branch FROM orders LEFT JOIN supplier s ON o_orderkey = s.s_suppkey LEFT JOIN customer c ON o_orderkey = c.c_custkey")
def cascade_first_match(spark, d):
    from graphloom.operators import resolve as R

    o = _table(spark, d, "orders").join(_table(spark, d, "supplier").select("s_suppkey"), F.col("o_orderkey") == F.col("s_suppkey"), "left").join(_table(spark, d, "customer").select("c_custkey"), F.col("o_orderkey") == F.col("c_custkey"), "left")
    branch = R.cascade([(F.col("o_orderstatus") == "F", F.when(F.col("s_suppkey").isNotNull(), "supplier")), (F.col("c_custkey").isNotNull(), F.lit("customer"))], F.lit("none"))
    return o.select(F.col("o_orderkey").alias("id"), branch.alias("branch"))


_RANGES = "SELECT n_nationkey AS id, n_regionkey AS file_id, n_nationkey * 30 AS line_start, n_nationkey * 30 + 200 AS line_end FROM nation"


@query("WITH f AS (" + _RANGES + "), p AS (SELECT c_custkey AS pid, c_nationkey % 5 AS file_id, c_custkey % 900 AS line FROM customer) SELECT pid, min(f.id) AS id FROM p JOIN f ON p.file_id = f.file_id AND p.line BETWEEN f.line_start AND f.line_end GROUP BY pid")
def interval_join_first(spark, d):
    from graphloom.operators import resolve as R

    points = _table(spark, d, "customer").select(F.col("c_custkey").alias("pid"), (F.col("c_nationkey") % 5).alias("file_id"), (F.col("c_custkey") % 900).alias("line"))
    return R.containing(points, A.sql(spark, d, _RANGES.replace("FROM nation", "FROM {nation}"))).select("pid", "id")


@query("SELECT doc_id AS path FROM documents WHERE doc_id % 10 = 0")
def anti_join_unchanged(spark, d):
    from graphloom.operators import resolve as R

    now = _table(spark, d, "documents").select(F.col("doc_id").alias("path"), F.md5("text").alias("content_hash"))
    before = _table(spark, d, "documents").select(F.col("doc_id").alias("path"), F.md5(F.concat("text", F.when(F.col("doc_id") % 10 == 0, " changed").otherwise(""))).alias("content_hash"))
    return R.changed_files(now, before).select("path")


# rendering

_IDS = "WITH f AS (SELECT id, 'f' AS prefix, row_number() OVER (ORDER BY file_path, id) AS num FROM n WHERE kind = 'file'), t AS (SELECT c.id, 'st' AS prefix, row_number() OVER (ORDER BY f.num, c.line_start, c.id) AS num, f.num AS file_num, c.line_start AS l FROM n c JOIN f ON c.parent_id = f.id), k AS (SELECT c.id, CASE c.kind WHEN 'function' THEN 'fn' ELSE 'c' END AS prefix, row_number() OVER (PARTITION BY c.kind ORDER BY t.num, c.line_start, c.id) AS num, t.file_num FROM n c JOIN t ON c.parent_id = t.id WHERE c.kind IN ('function', 'constant')), i AS (SELECT id, prefix, num, num AS file_num FROM f UNION ALL SELECT id, prefix, num, file_num FROM t UNION ALL SELECT id, prefix, num, file_num FROM k)"


def _assigned(spark, d, **options):
    from graphloom.render import ids

    return ids.assign(A.graph_nodes(spark, d), **options)


@query(_IDS + " SELECT id, prefix, num, file_num FROM i")
def render_ids_per_kind(spark, d):
    return _assigned(spark, d).ids.select("id", "prefix", "num", "file_num")


@query("SELECT target_id AS id, row_number() OVER (ORDER BY first) AS num FROM (SELECT target_id, min(edge_id) AS first FROM e WHERE edge_type = 'imports' AND source_id IN (SELECT id FROM n WHERE name LIKE 'A%' AND kind = 'file') AND target_id NOT IN (SELECT id FROM n WHERE name LIKE 'A%' AND kind = 'file') GROUP BY target_id) x")
def ghost_ids(spark, d):
    from graphloom.render import ids

    return ids.ghosts(_assigned(spark, d, scope="A", literal_scope=True), A.edges(spark, d)).select("id", "num")


_ORDER = "CASE prefix WHEN 'c' THEN 0 WHEN 'f' THEN 3 WHEN 'fn' THEN 4 ELSE 6 END"
_DRAWN = _IDS + f", g AS (SELECT e.edge_type, e.edge_id, a.prefix AS sp, a.num AS sn, b.prefix AS tp, b.num AS tn, {_ORDER.replace('prefix', 'a.prefix')} * 4294967296 + a.num AS s_ord, {_ORDER.replace('prefix', 'b.prefix')} * 4294967296 + b.num AS t_ord FROM e JOIN i a ON e.source_id = a.id JOIN i b ON e.target_id = b.id)"


@query(_DRAWN + " SELECT edge_type, s_ord, t_ord, edge_id FROM g")
def edge_render_order(spark, d):
    from graphloom.render import ids

    return ids.ends(_assigned(spark, d), A.edges(spark, d)).select("edge_type", "s_ord", "t_ord", "edge_id")


@query(_DRAWN + " SELECT edge_type, s_ord, sp || ':' || sn || ' ' || edge_type || ' ' || string_agg(tp || ':' || tn, ' ' ORDER BY t_ord, edge_id) AS line FROM g GROUP BY edge_type, s_ord, sp, sn")
def edge_group_lines(spark, d):
    from graphloom.render import ctg

    return ctg.edge_lines(_assigned(spark, d), A.edges(spark, d))


@query(_IDS + " SELECT 'f:' || i.num || ' ' || file_path || ' 0L' AS line FROM i JOIN n ON i.id = n.id WHERE prefix = 'f'")
def ctg_files_section(spark, d):
    from graphloom.render import ctg

    return ctg.files_section(_assigned(spark, d)).select("line")


@query(_IDS + " SELECT 'st:' || i.num || ' ' || name || ' f:' || file_num || ':' || line_start || CASE visibility WHEN 'public' THEN ' pub' ELSE '' END AS line FROM i JOIN n ON i.id = n.id WHERE prefix = 'st' UNION ALL SELECT '  ' || string_agg('fn ' || c.name || '()', ' ' ORDER BY c.line_start, c.id) FROM n c JOIN i ON c.parent_id = i.id WHERE i.prefix = 'st' AND c.kind = 'function' GROUP BY i.num")
def ctg_structs_section(spark, d):
    from graphloom.render import ctg

    return ctg.section(_assigned(spark, d), "st").select("line")


@query(_IDS + " SELECT 'c:' || i.num || ' ' || name || ' f:' || file_num || ':' || line_start || CASE visibility WHEN 'public' THEN ' pub' ELSE '' END AS line FROM i JOIN n ON i.id = n.id WHERE prefix = 'c'")
def ctg_constants_section(spark, d):
    from graphloom.render import ctg

    return ctg.section(_assigned(spark, d), "c").select("line")


@query("WITH m AS (SELECT id, row_number() OVER (ORDER BY id) AS num FROM n WHERE kind = 'module') SELECT 'x:' || num || ' ' || name || ' (dependency)' AS line FROM m JOIN n ON m.id = n.id UNION ALL SELECT '  ' || name FROM n WHERE parent_id IN (SELECT id FROM m )")
def ctg_externals_section(spark, d):
    from graphloom.render import ctg

    return ctg.externals_section(_assigned(spark, d, externals=True)).select("line")


@query(_DRAWN + " SELECT '    ' || sp || '_' || sn || CASE edge_type WHEN 'imports' THEN ' -.-> ' ELSE ' --> ' END || tp || '_' || tn AS line FROM g")
def mermaid_edges(spark, d):
    from graphloom.render import mermaid

    return mermaid.edge_rows(_assigned(spark, d), A.edges(spark, d)).select("line")


@query(_IDS + " SELECT CASE prefix WHEN 'fn' THEN 'fn_style' WHEN 'st' THEN 'st_style' ELSE 'const_style' END AS style, '    class ' || string_agg(prefix || '_' || num, ',' ORDER BY num) || CASE prefix WHEN 'fn' THEN ' fn_style' WHEN 'st' THEN ' st_style' ELSE ' const_style' END AS line FROM i WHERE prefix <> 'f' GROUP BY prefix")
def mermaid_classes(spark, d):
    from graphloom.render import mermaid

    return mermaid.class_rows(_assigned(spark, d))


# storage


@query("SELECT id, '{\"_type\":\"node\",\"id\":' || id || ',\"name\":\"' || name || '\",\"kind\":\"' || kind || '\",\"language\":\"zig\",\"file_path\":' || coalesce('\"' || file_path || '\"', 'null') || ',\"line_start\":' || coalesce(CAST(line_start AS VARCHAR), 'null') || ',\"line_end\":null,\"visibility\":\"' || visibility || '\",\"parent_id\":' || coalesce(CAST(parent_id AS VARCHAR), 'null') || ',\"doc\":null,\"signature\":null,\"content_hash\":null,\"external\":' || CASE external WHEN 'none' THEN 'null' ELSE '{\"type\":\"dependency\",\"version\":null}' END || ',\"lang_meta\":null,\"metrics\":null}' AS line FROM n")
def jsonl_nodes(spark, d):
    from graphloom.sources import jsonl

    return jsonl.node_lines(A.graph_nodes(spark, d))


@query("SELECT edge_id, '{\"_type\":\"edge\",\"source_id\":' || source_id || ',\"target_id\":' || target_id || ',\"edge_type\":\"' || edge_type || '\",\"source\":\"' || source || '\"}' AS line FROM e")
def jsonl_edges(spark, d):
    from graphloom.sources import jsonl

    return jsonl.edge_lines(A.edges(spark, d)).select("edge_id", "line")


@query("WITH m AS (SELECT max(id) + 1 AS k FROM n ) SELECT id, coalesce(parent_id, -1) AS parent_id, name FROM n UNION ALL SELECT n.id + k, coalesce(n.parent_id + k, -1), n.name FROM n , m")
def append_union_remap(spark, d):
    n, e = A.nodes(spark, d), A.edges(spark, d)
    return G.append((n, e), (n, e))[0].select("id", "parent_id", "name").fillna(-1, ["parent_id"])


@query()
def content_hash(spark, d):
    return _table(spark, d, "documents").select("doc_id", T.hash_text(T.content_hash("text")).alias("content_hash"))


@query("SELECT id, row_number() OVER (ORDER BY kind, name, id) - 1 AS num FROM n")
def dense_node_ids(spark, d):
    return G.dense_ids(A.nodes(spark, d), ["kind", "name", "id"], "num").select("id", "num")


@query("""
SELECT 'node' AS what, id, coalesce(parent_id, -1) AS other, concat_ws('|', name, kind, coalesce(file_path, '-'), coalesce(CAST(line_start AS VARCHAR), '-'), visibility, external) AS said FROM n
UNION ALL SELECT 'edge', source_id, target_id, edge_type || '|' || CASE edge_type WHEN 'imports' THEN 'phantom' ELSE 'tree_sitter' END FROM e
""")
def binary_roundtrip(spark, d):
    import uuid

    from graphloom.checkpoints import shared_dir
    from graphloom.sources import binary

    e = A.edges(spark, d).withColumn("source", F.when(F.col("edge_type") == "imports", "phantom").otherwise("tree_sitter"))
    path = f"{shared_dir(spark).removeprefix('file://')}/roundtrip-{uuid.uuid4().hex}.bin"
    binary.save(spark, A.graph_nodes(spark, d), e, path)
    g = binary.load(spark, path)
    said = F.concat_ws("|", "name", "kind", F.coalesce("file_path", F.lit("-")), F.coalesce(F.col("line_start").cast("string"), F.lit("-")), "visibility", F.col("external.kind"))
    nodes = g.nodes.select(F.lit("node").alias("what"), "id", F.coalesce("parent_id", F.lit(-1)).alias("other"), said.alias("said"))
    return nodes.unionAll(g.edges.select(F.lit("edge"), "source_id", "target_id", F.concat_ws("|", "edge_type", "source")))
