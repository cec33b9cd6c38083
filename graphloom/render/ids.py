"""Renderer ids: files by path, declarations by place, packages by id; ghosts by first edge."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graphloom.checkpoints import cut
from graphloom.functions.text import in_scope, internal
from graphloom.operators.graph import dense_ids, owning, parents, qualified_paths

PREFIX = {"type_def": "st", "union_def": "un", "enum_def": "en", "function": "fn", "constant": "c", "error_def": "err", "test_def": "t", "module": "m"}
WALKED = ("type_def", "union_def", "module")
RANK = {p: k for k, p in enumerate(("c", "en", "err", "f", "fn", "m", "st", "un", "t", "x"))}
SPAN = 1 << 32


def rank(prefix: Column | str) -> Column:
    c = F.col(prefix) if isinstance(prefix, str) else prefix
    return F.coalesce(F.element_at(F.create_map(*[F.lit(x) for p, k in RANK.items() for x in (p, k)]), c), F.lit(10)).cast("long")


@dataclass
class Ids:
    ids: DataFrame  # id, prefix, num, file_num, ord: of every node that has one
    packages: DataFrame  # id, num: roots of external packages
    symbols: DataFrame  # id, num, path: what lies below them
    scope: str | None
    externals: bool
    scoped: DataFrame  # the nodes, with scope_path: the path by which scope is judged

    @property
    def lookup(self) -> DataFrame:
        """(id, num, path) of roots and symbols; a root's path is its name."""
        roots = self.packages.join(self.scoped.select("id", "name"), "id").select("id", "num", F.col("name").alias("path"))
        return roots.unionByName(self.symbols)


def _numbered(df: DataFrame, by: list[str], group: str) -> DataFrame:
    """df with ``num`` from 1 in each group, without a window over a whole group."""
    n = cut(dense_ids(df, by, "_n"))
    least = n.groupBy(group).agg(F.min("_n").alias("_least"))
    return n.join(F.broadcast(least), group).withColumn("num", F.col("_n") - F.col("_least") + 1).drop("_n", "_least")


def assign(nodes: DataFrame, scope: str | None = None, tests: bool = False, externals: bool = False, literal_scope: bool = False) -> Ids:
    """Ids in depth-first order, level by level: a node's key is its parent's with its own line and id added.

    Scope is judged by the path of the file a node stands in; literal_scope judges by its own path only, which
    most declarations don't have.
    """
    if scope is None or literal_scope:
        scoped = nodes.withColumn("scope_path", F.col("file_path"))
    else:
        files = nodes.where("kind = 'file'").select(F.col("id").alias("owner"), F.col("file_path").alias("_fp"))
        of = owning(nodes).join(files, "owner", "left").select("id", "_fp")
        scoped = cut(nodes.join(of, "id", "left").withColumn("scope_path", F.coalesce("file_path", "_fp")).drop("_fp"))
    inside = in_scope("scope_path", scope)
    files = scoped.where((F.col("kind") == "file") & internal() & inside).select("id", F.coalesce("file_path", F.lit("")).alias("_path"))
    files = dense_ids(files, ["_path", "id"], "num", 1)
    level = cut(files.select("id", F.lit("f").alias("prefix"), F.col("num").alias("file_num"), F.array(F.struct(F.col("num").cast("long").alias("line"), "id")).alias("key"), "num"))
    found = [level.select("id", "prefix", "file_num", "key")]
    kids = scoped.where(inside & F.col("parent_id").isNotNull() & F.col("kind").isin(*[k for k in PREFIX if tests or k != "test_def"]))
    kids = kids.select("id", "parent_id", "kind", F.coalesce("line_start", F.lit(0)).cast("long").alias("line"))
    front = level.select(F.col("id").alias("parent_id"), "file_num", F.col("key").alias("_key"))
    names = F.create_map(*[F.lit(x) for k, p in PREFIX.items() for x in (k, p)])
    while True:
        level = cut(kids.join(front, "parent_id").select("id", "kind", F.element_at(names, F.col("kind")).alias("prefix"), "file_num", F.concat("_key", F.array(F.struct("line", "id"))).alias("key")))
        if level.isEmpty():
            break
        found.append(level.select("id", "prefix", "file_num", "key"))
        front = level.where(F.col("kind").isin(*WALKED)).select(F.col("id").alias("parent_id"), "file_num", F.col("key").alias("_key"))
    every = found[0]
    for more in found[1:]:
        every = every.unionByName(more)
    ids = _numbered(every, ["prefix", "key"], "prefix").select("id", "prefix", "num", "file_num")
    spark = nodes.sparkSession
    packages, symbols = spark.createDataFrame([], "id long, num long"), spark.createDataFrame([], "id long, num long, path string")
    if externals:
        outer = scoped.where(~internal())
        up = parents(scoped).join(scoped.select(F.col("id").alias("parent_id"), internal().alias("_in")), "parent_id", "left").select("id", F.coalesce("_in", F.lit(True)).alias("_root"))
        packages = cut(dense_ids(outer.join(up, "id").where("_root").select("id"), ["id"], "num", 1).select("id", "num"))
        below = scoped.where(inside)
        paths = qualified_paths(below.unionByName(scoped.join(packages.select("id"), "id", "left_semi")).dropDuplicates(["id"]), packages)
        symbols = cut(paths.join(packages.select(F.col("id").alias("root"), "num"), "root").select("id", "num", "path"))
        ids = ids.unionByName(packages.select("id", F.lit("x").alias("prefix"), "num", F.lit(None).cast("long").alias("file_num")))
    ids = cut(ids.withColumn("ord", rank("prefix") * SPAN + F.col("num")))
    return Ids(ids, packages, symbols, scope, externals, scoped)


def ghosts(a: Ids, edges: DataFrame) -> DataFrame:
    """(id, num): internal targets out of scope of edges from in scope, in the order of their first edge."""
    n = a.scoped.select("id", "kind", internal().alias("inner"), in_scope("scope_path", a.scope).alias("inside"))
    s = n.where("inside").join(a.ids.select("id"), "id", "left_semi").select(F.col("id").alias("source_id"))
    t = n.where("inner and not inside and kind not in ('field', 'import_decl')").select(F.col("id").alias("target_id"))
    first = edges.join(s, "source_id", "left_semi").join(t, "target_id", "left_semi").groupBy(F.col("target_id").alias("id")).agg(F.min("edge_id").alias("_first"))
    return dense_ids(first, ["_first"], "num", 1).select("id", "num")


def ends(a: Ids, edges: DataFrame, ghost: DataFrame | None = None) -> DataFrame:
    """Edges that can be drawn: edge_type, edge_id, source's and target's prefix, num and order, path for symbols, ghost number."""
    n = a.scoped.select("id", internal().alias("inner"), in_scope("scope_path", a.scope).alias("inside"))
    s = n.where("inside").join(a.ids.select("id", F.col("prefix").alias("s_prefix"), F.col("num").alias("s_num"), F.col("ord").alias("s_ord")), "id")
    s = s.select(F.col("id").alias("source_id"), F.col("inner").alias("s_inner"), "s_prefix", "s_num", "s_ord")
    t = n.join(a.ids.select("id", F.col("prefix").alias("t_prefix"), F.col("num").alias("t_num"), F.col("ord").alias("t_ord")), "id", "left")
    t = t.join(a.lookup.select("id", F.col("num").alias("x_num"), F.col("path").alias("x_path")), "id", "left")
    t = t.join(ghost.select("id", F.col("num").alias("g_num")), "id", "left") if ghost is not None else t.withColumn("g_num", F.lit(None).cast("long"))
    t = t.where("t_prefix is not null or not inner or g_num is not null").drop("inside").withColumnsRenamed({"id": "target_id", "inner": "t_inner"})
    e = edges.join(s, "source_id").join(t, "target_id")
    if not a.externals:
        e = e.where("s_inner and t_inner")
    order = F.when(F.col("g_num").isNotNull(), 10 * SPAN + F.col("g_num")).when(F.col("t_ord").isNotNull(), F.col("t_ord")).when(F.col("x_num").isNotNull(), RANK["x"] * SPAN + F.col("x_num")).otherwise(0)
    return e.withColumn("t_ord", order)


def grouped_targets(drawn: DataFrame, target: Column) -> DataFrame:
    """(edge_type, s_prefix, s_num, s_ord, targets): one row for a type and source, its targets in order."""
    one = F.struct("t_ord", "edge_id", target.alias("t"))
    return drawn.groupBy("edge_type", "s_prefix", "s_num", "s_ord").agg(F.array_join(F.transform(F.array_sort(F.collect_list(one)), lambda x: x["t"]), " ").alias("targets"))


def lines(parts: list[tuple[int, DataFrame]]) -> DataFrame:
    """(line_no, line) of the sections' lines; each part has (k: struct to sort by, line) and a section number."""
    spark, rows = parts[0][1].sparkSession, None
    for section, df in parts:
        one = df.select(F.lit(section).alias("s"), F.col("k1").cast("long").alias("k1"), F.col("k2").cast("string").alias("k2"), F.col("k3").cast("long").alias("k3"), "line")
        rows = one if rows is None else rows.unionByName(one)
    return dense_ids(rows, ["s", "k1", "k2", "k3"], "line_no", 1).select("line_no", "line")


def fixed(spark, text: list[str]) -> DataFrame:
    return spark.createDataFrame([(k, "", 0, t) for k, t in enumerate(text)], "k1 long, k2 string, k3 long, line string")


def text(rendered: DataFrame) -> str:
    return "".join(r["line"] + "\n" for r in rendered.orderBy("line_no").toLocalIterator())
