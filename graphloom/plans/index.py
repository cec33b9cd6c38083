"""From source files to a graph: extraction, name resolution by joins, external symbols, metrics.

Files are parsed in one Arrow pass.  Everything after it is relational: bindings, scopes and call chains are
tables, a chain is walked by as many rounds of joins as it has segments, and each branch of the cascade that a call
goes through is a left join of which the first that holds decides.  Limits on bindings, chains, paths and files hold
with parity only.
"""

from __future__ import annotations

import itertools
import logging
from dataclasses import dataclass
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from graphloom.checkpoints import cut, discard, scratch
from graphloom.functions import text as T
from graphloom.languages import by_name
from graphloom.logs import log
from graphloom.operators import resolve as R
from graphloom.operators.graph import CodeGraph, ancestors, dedup_edges, dense_ids, phantoms, running_sum, topological_levels
from graphloom.schemas import MAX_BINDINGS, MAX_CHAIN, MAX_FILE, MAX_HOPS, MAX_PARAMS, MAX_SEGMENTS, TYPE_CONTAINERS, full_nodes
from graphloom.sources.scan import scan_directory, sources_from

_NODE = "struct<local:int,parent:int,name:string,kind:string,line_start:int,line_end:int,public:boolean,doc:string,signature:string,is_comptime:boolean,is_mutable:boolean,is_inline:boolean,is_extern:boolean,is_packed:boolean,comptime_conditional:boolean,convention:string,chain:array<string>,complexity:int>"
_EVENT = "struct<caller:int,kind:string,ord:int,name:string,chain:array<string>,extra:int>"
_STD = "struct<alias:string,chain:array<string>,line:int>"
PARSED = f"rel_path string, language string, content_hash binary, nodes array<{_NODE}>, events array<{_EVENT}>, std array<{_STD}>, imports array<string>"
FILES_A_TASK = 500
FLAGS = ("is_comptime", "is_mutable", "is_inline", "is_extern", "is_packed", "comptime_conditional")


@dataclass
class IndexResult:
    files_indexed: int
    files_skipped: int
    files_errored: int


def spread(files: DataFrame, key: str = "rel_path") -> DataFrame:
    """files in parts of about FILES_A_TASK by key, however few parts or bytes their table has: parsing takes far longer than reading."""
    n = files.count()
    return files.repartition(max(1, min(n, max(files.sparkSession.sparkContext.defaultParallelism, -(-n // FILES_A_TASK)))), key)


def parse_files(files: DataFrame) -> DataFrame:
    """PARSED: a row for each file, with its declarations, events, imports and names of the standard library."""
    files = spread(files)
    spark, support = files.sparkSession, by_name()
    schema = spark.createDataFrame([], PARSED)
    from pyspark.sql.pandas.types import to_arrow_schema

    kinds = to_arrow_schema(schema.schema)

    def run(batches):
        for batch in batches:
            out = []
            for r in batch.to_pylist():
                p = support[r["language"]].parse((r["content"] or b"").decode("utf-8", "replace"), r["rel_path"])
                nodes = [dict(local=d.local, parent=d.parent, name=d.name, kind=d.kind, line_start=d.line_start, line_end=d.line_end, public=d.public, doc=d.doc, signature=d.signature, convention=d.convention, chain=d.chain, complexity=d.complexity, **{f: bool(d.flags.get(f)) for f in FLAGS}) for d in p.nodes]
                events = [dict(zip(("caller", "kind", "ord", "name", "chain", "extra"), e)) for e in p.events]
                out.append(dict(rel_path=r["rel_path"], language=r["language"], content_hash=r["content_hash"], nodes=nodes, events=events, std=[dict(alias=a, chain=c, line=n) for a, c, n in p.std_chains()], imports=r["imports"]))
            yield pa.RecordBatch.from_pylist(out, schema=kinds)

    text = F.decode("content", "UTF-8")
    imports = _by_language(lambda x: x.extract_imports(text)).alias("imports")
    return files.select("rel_path", "language", "content_hash", "content", imports).mapInArrow(run, PARSED)


def _by_language(of) -> Column:
    """of(language) for a row's language."""
    return reduce(lambda c, x: c.when(F.col("language") == x.name, of(x)), by_name().values(), F.when(F.lit(False), F.lit(None)))


def _resolved(importer: str, path: str, parity: bool) -> Column:
    limit = {"limit": MAX_SEGMENTS} if parity else {}
    return _by_language(lambda x: x.resolve_import_path(F.col(importer), F.col(path), **limit))


def _first(df: DataFrame, keys: list[str], order: str, cap: int | None) -> DataFrame:
    """First of each key, with a cap among so many first of its caller or file."""
    if cap:
        n = F.row_number().over(Window.partitionBy(keys[0]).orderBy(order))
        df = df.withColumn("_n", n).where(F.col("_n") <= cap).drop("_n")
    others = [c for c in df.columns if c not in keys]
    return df.groupBy(*keys).agg(F.min_by(F.struct(*others), order).alias("_x")).select(*keys, *[F.col(f"_x.{c}").alias(c) for c in others])


def file_order(parsed: DataFrame, parity: bool = False) -> DataFrame:
    """(rel_path, file_ord, base): files after those they import, then by path, and the first node id of each."""
    files = parsed.select(F.col("rel_path").alias("id"), F.size("nodes").alias("n"))
    imports = parsed.select("rel_path", "language", F.explode("imports").alias("raw"))
    imports = imports.select(F.col("rel_path").alias("id"), _resolved("rel_path", "raw", parity).alias("resolved"), "raw")
    known = files.select(F.col("id").alias("path"), F.col("id").alias("file_id"))
    depends = R.import_targets(imports, known).where("file_id is not null").select("id", F.col("file_id").alias("on"))
    levels = topological_levels(files, depends).select("id", F.coalesce("level", F.lit(1 << 30)).alias("level"))
    base = running_sum(files.join(levels, "id"), ["level", "id"], F.col("n"), "base")
    return cut(base.select(F.col("id").alias("rel_path"), F.col("base").alias("file_ord"), "base"))


class Resolver:
    """The tables that names are looked up in."""

    def __init__(self, nodes: DataFrame, raw: DataFrame, parity: bool = False):
        """nodes: id, file_id, parent_id, name, kind, language, signature, rel_path, chain; raw: caller, file_id, kind, ord, name, chain, extra."""
        self.limit = MAX_CHAIN if parity else 1 << 20
        short = F.slice("chain", 1, self.limit)
        self.n, self.raw = nodes.withColumn("chain", short), raw.withColumn("chain", short)
        self.bound, self.params = (MAX_BINDINGS, MAX_PARAMS) if parity else (None, None)
        self.container = F.col("kind").isin(*TYPE_CONTAINERS)
        self.up = cut(ancestors(nodes.select("id", "parent_id"), MAX_HOPS if parity else None))
        nodes = self.n
        self.files = nodes.where("kind = 'file'").select(F.col("rel_path").alias("path"), F.col("id").alias("file_id"))
        top = nodes.where("kind = 'import_decl'").withColumn("resolved", _resolved("rel_path", "signature", parity)).withColumn("raw", F.col("signature")).drop("file_id").withColumn("owner", F.col("parent_id"))
        targets = R.import_targets(top.select("id", "owner", "name", "chain", "resolved", "raw"), self.files).where("file_id is not null")
        self.imports = cut(targets.join(self.files.select(F.col("file_id").alias("owner")), "owner", "left_semi").select("id", "owner", "name", "chain", F.col("file_id").alias("target")))
        self.bindings = _first(self.imports.select(F.col("owner").alias("file_id"), "name", "target", F.col("chain").alias("prefix"), "id"), ["file_id", "name"], "id", self.bound).select("file_id", "name", "target", "prefix")
        self.kids = nodes.where("parent_id is not null").groupBy(F.col("parent_id").alias("scope"), "name").agg(F.min("id").alias("kid"))
        below = self.up.join(nodes.select("id", "name"), "id").groupBy(F.col("ancestor").alias("scope"), "name").agg(F.count("*").alias("c"), F.min("id").alias("lone"))
        self.lone = below.where("c = 1").select("scope", "name", "lone")
        self.types = nodes.where(self.container).groupBy(F.col("parent_id").alias("scope"), "name").agg(F.min("id").alias("type_id"))
        self.returns = cut(self._returns())

    def _returns(self) -> DataFrame:
        """(fn, scope): the type that a function returns, of its own scope or through an import of its file."""
        parts = T.return_type("signature")
        fns = self.n.where("kind = 'function'").select(F.col("id").alias("fn"), "file_id", "parent_id", parts.alias("p")).where("size(p) > 0")
        near = fns.where("size(p) = 1").join(self.types, (F.col("scope") == F.col("parent_id")) & (F.col("name") == F.col("p")[0])).select("fn", F.col("type_id").alias("scope"))
        first = self.imports.groupBy(F.col("owner").alias("o"), F.col("name").alias("m")).agg(F.min_by("target", "id").alias("t"))
        far = fns.where("size(p) > 1").join(first, (F.col("o") == F.col("file_id")) & (F.col("m") == F.col("p")[0])).join(self.types, (F.col("scope") == F.col("t")) & (F.col("name") == F.col("p")[1])).select("fn", F.col("type_id").alias("scope"))
        return near.unionByName(far)

    def scoped(self, wanted: DataFrame, members: DataFrame) -> DataFrame:
        """(caller, name, found): in the narrowest scope, else the only one of the caller's file."""
        wanted = wanted.select("caller", "file_id", "name").distinct()
        near = R.narrowest(wanted, members, self.up).select("caller", "name", F.col("found").alias("near"))
        only = R.unique_only(members, ["file_id", "name"], "id").withColumnRenamed("id", "only")
        both = wanted.join(near, ["caller", "name"], "left").join(only, ["file_id", "name"], "left")
        return both.select("caller", "name", F.coalesce("near", "only").alias("found")).where("found is not null")

    @property
    def functions(self) -> DataFrame:
        return self.n.where("kind = 'function'").select("id", "file_id", "parent_id", "name")

    @property
    def type_names(self) -> DataFrame:
        return self.n.where(T.type_reference(F.col("kind"), F.col("name"))).select("id", "file_id", "parent_id", "name")

    def walk(self, chains: DataFrame, strict: bool = False) -> tuple[DataFrame | None, DataFrame | None]:
        """Follow (sid, caller, scope, chain) segment by segment.

        Returns the edges met (caller, target, edge_type, sid), or with strict the last function of each whole
        chain (sid, fn), found among direct members only.
        """
        kinds = self.n.select(F.col("id").alias("got"), F.col("name").alias("g_name"), F.col("kind").alias("g_kind"), F.col("parent_id").alias("g_parent"))
        scope_kinds = self.n.select(F.col("id").alias("scope"), (self.container | (F.col("kind") == "file")).alias("open"))
        state = cut(chains.where("size(chain) > 0").select("sid", "caller", "scope", "chain", F.lit(None).cast("long").alias("fn")))
        edges, done = None, None
        for k in itertools.count():
            if state.isEmpty():
                break
            s = state.withColumn("name", F.col("chain")[k]).withColumn("last", F.size("chain") == k + 1)
            s = s.join(self.kids, ["scope", "name"], "left")
            if not strict:
                s = s.join(self.lone, ["scope", "name"], "left").withColumn("got", F.coalesce("kid", "lone"))
            else:
                s = s.withColumn("got", F.col("kid"))
            s = s.join(kinds, "got", "left").join(scope_kinds, "scope", "left").join(self.returns.select(F.col("fn").alias("got"), F.col("scope").alias("r_scope")), "got", "left")
            s = cut(s)
            is_type = F.col("g_kind").isin(*TYPE_CONTAINERS)
            is_fn = F.col("g_kind") == "function"
            stays = F.col("got").isNull() & (F.col("name") == "Self") & (F.lit(True) if strict else F.col("open"))
            if strict:
                following = F.when(stays, F.col("scope")).when(is_type, F.col("got")).otherwise(F.col("g_parent"))
                fn = F.when(is_fn, F.col("got")).otherwise(F.col("fn"))
            else:
                following = F.when(stays, F.col("scope")).when(is_fn & ~F.col("last"), F.col("r_scope")).when(is_type, F.col("got")).otherwise(F.col("g_parent"))
                fn = F.col("fn")
                alias = (F.col("g_kind") == "constant") & T.pascal("g_name")
                hit = s.where(is_fn | is_type | alias).select("caller", F.col("got").alias("target"), F.when(is_fn, "calls").otherwise("uses_type").alias("edge_type"), "sid")
                edges = hit if edges is None else edges.unionByName(hit)
            moved = s.withColumn("to", following).withColumn("fn2", fn)
            if strict:
                end = moved.where("last and (to is not null)").select("sid", F.col("fn2").alias("fn"))
                done = end if done is None else done.unionByName(end)
            state = cut(moved.where("not last and to is not null").select("sid", "caller", F.col("to").alias("scope"), "chain", F.col("fn2").alias("fn")))
        return edges, done

    def calls(self) -> DataFrame | None:
        """(caller, target, edge_type, sid) of all calls."""
        raw, b = self.raw, self.bindings
        ev = lambda kind: raw.where(F.col("kind") == kind)
        origin = lambda df, root: df.join(b.withColumnsRenamed({"name": "_r", "target": "o_target", "prefix": "o_prefix", "file_id": "_f"}), (F.col("_r") == root) & (F.col("_f") == F.col("file_id")), "left").drop("_r", "_f")

        # variables: to the file of the type that a call returns, else the imported file
        v = origin(_first(ev("var").select("caller", "name", "ord", "chain", "file_id"), ["caller", "name"], "ord", self.bound), F.col("chain")[0]).where("o_target is not null")
        v = cut(v.withColumn("sid", F.monotonically_increasing_id()))
        full = F.concat("o_prefix", F.slice("chain", F.lit(2), F.lit(self.limit)))
        _, ends = self.walk(v.select("sid", "caller", F.col("o_target").alias("scope"), full.alias("chain")), strict=True)
        if ends is not None:
            home = self.n.select(F.col("id").alias("scope"), F.col("file_id").alias("home"))
            to = ends.where("fn is not null").join(self.returns, "fn").join(home, "scope").groupBy("sid").agg(F.min("home").alias("home"))
            v = v.join(to, "sid", "left").withColumn("o_target", F.coalesce("home", "o_target"))
        variables = v.select("caller", F.col("name").alias("v_name"), F.col("o_target").alias("v_target"))
        local = _first(ev("local").select("caller", "name", "ord", F.col("chain")[0].alias("l_type")), ["caller", "name"], "ord", self.bound).select("caller", F.col("name").alias("l_name"), "l_type")
        p = origin(ev("param"), F.col("chain")[0]).where("o_target is not null").select("caller", "name", F.col("ord").cast("long").alias("ord"), F.col("o_target").alias("p_target"), F.slice(F.concat("o_prefix", F.slice("chain", F.lit(2), F.lit(self.limit))), 1, self.limit).alias("p_chain"))
        captured = ev("capture").select("caller", F.col("name").alias("to"), "ord", F.col("chain")[0].alias("name")).join(p.select("caller", "name", "p_target", "p_chain"), ["caller", "name"]).select("caller", F.col("to").alias("name"), (F.col("ord") + (1 << 30)).cast("long").alias("ord"), "p_target", "p_chain")
        params = _first(p.unionByName(captured), ["caller", "name"], "ord", self.params).select("caller", F.col("name").alias("p_name"), "p_target", "p_chain")
        ptypes = _first(ev("ptype").select("caller", "name", "ord", F.col("chain")[0].alias("t_type")), ["caller", "name"], "ord", None).select("caller", F.col("name").alias("t_name"), "t_type")

        c = ev("call").select("caller", "file_id", "chain", F.col("extra").alias("bare"), F.col("chain")[0].alias("root"), F.element_at("chain", -1).alias("leaf")).distinct().withColumn("sid", F.monotonically_increasing_id())
        c = origin(cut(c), F.col("root"))
        for table, key in ((variables, "v_name"), (local, "l_name"), (params, "p_name"), (ptypes, "t_name")):
            c = c.join(table.withColumnRenamed("caller", "_c"), (F.col("_c") == F.col("caller")) & (F.col(key) == F.col("root")), "left").drop("_c")
        c = cut(c)
        names = lambda column: c.select("caller", "file_id", F.col(column).alias("name")).where("name is not null")
        fns = self.scoped(names("leaf"), self.functions).withColumnsRenamed({"caller": "_c", "name": "_n", "found": "leaf_fn"})
        types = cut(self.scoped(names("root").unionByName(names("l_type")).unionByName(names("t_type")), self.type_names))
        of = lambda column, out: types.select(F.col("caller").alias("_c"), F.col("name").alias("_n"), F.col("found").alias(out))
        c = c.join(fns, (F.col("_c") == F.col("caller")) & (F.col("_n") == F.col("leaf")), "left").drop("_c", "_n")
        for column, out in (("root", "root_id"), ("l_type", "l_id"), ("t_type", "t_id")):
            c = c.join(of(column, out), (F.col("_c") == F.col("caller")) & (F.col("_n") == F.col(column)), "left").drop("_c", "_n")
        members = self.functions.groupBy(F.col("parent_id").alias("_s"), F.col("name").alias("_n")).agg(F.min("id").alias("l_fn"))
        c = c.join(members, (F.col("_s") == F.col("l_id")) & (F.col("_n") == F.col("leaf")), "left").drop("_s", "_n")
        nothing = F.lit(None)
        rest = F.slice("chain", F.lit(2), F.lit(self.limit))
        one = lambda fn=None, scope=None, chain=None: F.struct((fn if fn is not None else nothing).cast("long").alias("fn"), (scope if scope is not None else nothing).cast("long").alias("scope"), (chain if chain is not None else F.array().cast("array<string>")).alias("chain"))
        branch = R.cascade([
            ((F.size("chain") == 1) & F.col("leaf_fn").isNotNull(), one(F.col("leaf_fn"))),
            ((F.size("chain") == 1) & (F.col("bare") == 1) & F.col("o_target").isNotNull(), one(scope=F.col("o_target"), chain=F.col("o_prefix"))),
            (F.size("chain") == 1, one()),
            (F.col("o_target").isNotNull(), one(scope=F.col("o_target"), chain=T.chain_concat("o_prefix", rest, self.limit))),
            (F.col("v_target").isNotNull(), one(scope=F.col("v_target"), chain=rest)),
            (F.col("l_type").isNotNull(), one(F.col("l_fn"))),
            (F.col("p_target").isNotNull(), one(scope=F.col("p_target"), chain=T.chain_concat("p_chain", rest, self.limit))),
            ((F.col("root") == "self") | F.col("root_id").isNotNull() | F.col("t_id").isNotNull(), one(F.col("leaf_fn"))),
        ], one())
        decided = cut(c.select("sid", "caller", branch.alias("x")))
        plain = decided.where("x.fn is not null").select("caller", F.col("x.fn").alias("target"), F.lit("calls").alias("edge_type"), "sid")
        walked, _ = self.walk(decided.where("x.scope is not null").select("sid", "caller", F.col("x.scope").alias("scope"), F.col("x.chain").alias("chain")))
        return plain if walked is None else plain.unionByName(walked)

    def type_uses(self) -> DataFrame:
        """(caller, target, edge_type, sid): types that a function or test names, but for its own members."""
        idents = self.raw.where("kind = 'ident'").select("caller", "file_id", "name").distinct()
        near = self.scoped(idents, self.type_names)
        across = self.imports.select(F.col("owner").alias("file_id"), F.col("target").alias("scope"))
        every = self.n.where(self.container).select(F.col("parent_id").alias("scope"), "name", "id")
        far = R.unique_only(across.join(every, "scope"), ["file_id", "name"], "id").where(T.pascal("name")).withColumnRenamed("id", "far")
        hit = idents.join(near, ["caller", "name"], "left").join(far, ["file_id", "name"], "left").select("caller", F.coalesce("found", "far").alias("target")).where("target is not null")
        parent = self.n.select(F.col("id").alias("target"), "parent_id")
        return hit.join(parent, "target").where("not (parent_id <=> caller)").select("caller", "target", F.lit("uses_type").alias("edge_type"), F.lit(0).cast("long").alias("sid"))


def external_symbols(nodes: DataFrame, parsed: DataFrame, order: DataFrame, first_id: int) -> tuple[DataFrame, DataFrame]:
    """(nodes, edges) of the standard library's names: a node for each prefix, after all others; edges from files and functions."""
    std = nodes.where("kind = 'import_decl' and signature = 'std'").join(nodes.where("kind = 'file'").select(F.col("id").alias("parent_id")), "parent_id", "left_semi").select("file_id", "file_ord").distinct()
    uses = parsed.select("rel_path", F.posexplode("std").alias("pos", "s")).join(order, "rel_path").select(F.col("base").alias("file_id"), "file_ord", "pos", F.col("s.chain").alias("chain"), F.col("s.line").alias("line"))
    uses = cut(uses.withColumn("kind", F.when(T.pascal(F.element_at("chain", -1)), "type_def").otherwise("module")).withColumn("name", F.concat(F.lit("std."), F.array_join("chain", "."))))
    names = std.select(F.lit("std").alias("name"), F.lit("module").alias("kind"), F.struct("file_ord", F.lit(-1).alias("pos")).alias("ord")).unionByName(uses.select("name", "kind", F.struct("file_ord", "pos").alias("ord"))).withColumn("external", F.lit("stdlib"))
    found = phantoms(names)
    at = names.select(F.explode(F.transform(F.sequence(F.lit(1), F.size(F.split("name", r"\."))), lambda k: F.array_join(F.slice(F.split("name", r"\."), F.lit(1), k), "."))).alias("qualified"), "ord").groupBy("qualified").agg(F.min("ord").alias("ord"))
    numbered = cut(dense_ids(found.join(at, "qualified").select("*", F.col("ord.file_ord").alias("_a"), F.col("ord.pos").alias("_b")), ["_a", "_b", "depth"], "id", first_id))
    up = numbered.select(F.col("qualified").alias("parent"), F.col("id").alias("parent_id"))
    out = numbered.join(up, "parent", "left").select("id", "name", "kind", "parent_id", F.struct(F.lit("stdlib").alias("kind"), F.lit(None).cast("string").alias("version")).alias("external"), F.lit("public").alias("visibility"))
    ids = numbered.select(F.col("qualified").alias("name"), F.col("id").alias("target"))
    imports = std.select(F.col("file_id").alias("caller"), F.lit("std").alias("name")).join(ids, "name").select("caller", "target", F.lit("imports").alias("edge_type"), F.lit(0).cast("long").alias("sid"))
    ranges = nodes.where("kind = 'function'").select("id", "file_id", "line_start", "line_end")
    points = uses.where("kind = 'type_def'").withColumn("pid", F.monotonically_increasing_id())
    points = cut(points)
    inside = R.containing(points.select("pid", "file_id", "line"), ranges)
    types = points.join(inside, "pid").join(ids, "name").select(F.col("id").alias("caller"), "target", F.lit("uses_type").alias("edge_type"), F.col("pid").alias("sid"))
    return out, imports.unionByName(types)


def build(files: DataFrame, parity: bool = False) -> CodeGraph:
    """The graph of scanned files (scan_directory's rows)."""
    parsed = cut(parse_files(files.where("readable")))
    graph = graph_of(parsed, parity)
    discard(parsed)
    return graph


def graph_of(parsed: DataFrame, parity: bool = False) -> CodeGraph:
    """The graph of parsed files.

    With parity, a call or type use counts only if its target's file comes no later in the order of files, as
    when files are resolved one after the other.  Of the tables written on the way, nodes and edges stay.
    """
    with scratch() as tables:
        graph = _graph_of(parsed, parity)
        return CodeGraph(tables.keep(graph.nodes), tables.keep(graph.edges))


def _graph_of(parsed: DataFrame, parity: bool) -> CodeGraph:
    order = file_order(parsed, parity)
    each = parsed.join(order, "rel_path")
    flat = each.select("rel_path", "language", "content_hash", "file_ord", "base", F.explode("nodes").alias("d"))
    meta = F.struct(*[F.col(f"d.{f}").alias(f) for f in FLAGS], F.col("d.convention").alias("calling_convention"))
    is_file = F.col("d.kind") == "file"
    zero = lambda: F.lit(0)
    metrics = F.when(F.col("d.kind") == "function", F.struct(F.col("d.complexity").alias("complexity"), (F.col("d.line_end") - F.col("d.line_start") + 1).cast("long").alias("lines"), *[zero().alias(n) for n in ("fan_in", "fan_out", "branches", "loops", "error_paths", "nesting_depth_max")], zero().cast("long").alias("structural_hash")))
    nodes = flat.select(
        (F.col("base") + F.col("d.local")).alias("id"), (F.col("base") + F.col("d.parent")).alias("parent_id"), F.col("base").alias("file_id"), "file_ord", "rel_path", "language", F.col("d.name").alias("name"), F.col("d.kind").alias("kind"), F.col("d.line_start").alias("line_start"), F.col("d.line_end").alias("line_end"),
        F.when(F.col("d.public") | is_file, "public").otherwise("private").alias("visibility"), F.col("d.doc").alias("doc"), F.col("d.signature").alias("signature"), F.col("d.chain").alias("chain"), F.when(is_file, F.col("rel_path")).alias("file_path"), F.when(is_file, F.col("content_hash")).alias("content_hash"), metrics.alias("metrics"), F.when(~is_file, meta).alias("lang_meta"),
    )
    nodes = cut(nodes)
    raw = each.select("base", F.explode("events").alias("e")).select((F.col("base") + F.col("e.caller")).alias("caller"), F.col("base").alias("file_id"), "e.kind", "e.ord", "e.name", "e.chain", "e.extra")
    r = Resolver(nodes, cut(raw), parity)
    imports = r.imports.select(F.col("owner").alias("caller"), "target", F.lit("imports").alias("edge_type"), F.col("id").alias("sid"))
    uses = r.calls().withColumn("phase", F.lit(0)).unionByName(r.type_uses().withColumn("phase", F.lit(1)))
    if parity:
        ords = nodes.select("id", "file_ord")
        uses = uses.join(ords.select(F.col("id").alias("caller"), F.col("file_ord").alias("_s")), "caller").join(ords.select(F.col("id").alias("target"), F.col("file_ord").alias("_t")), "target").where("_t <= _s").drop("_s", "_t")
    first = (nodes.agg(F.max("id")).first()[0] or -1) + 1 if not nodes.isEmpty() else 0
    outer, outer_edges = nodes.limit(0), None
    for x in by_name().values():
        if x.external_symbols is None:
            continue
        own = F.col("language") == x.name
        more, edges = x.external_symbols(nodes.where(own), parsed.where(own), order, first)
        outer, outer_edges = outer.unionByName(more.withColumn("language", F.lit(x.name)), allowMissingColumns=True), edges if outer_edges is None else outer_edges.unionByName(edges)
        first = (more.agg(F.max("id")).first()[0] or first - 1) + 1
    every = uses.withColumn("source", F.lit("tree_sitter")).unionByName(imports.withColumns({"phase": F.lit(2), "source": F.lit("tree_sitter")}))
    if outer_edges is not None:
        every = every.unionByName(outer_edges.withColumns({"phase": F.lit(3), "source": F.lit("phantom")}))
    every = every.select(F.col("caller").alias("source_id"), F.col("target").alias("target_id"), "edge_type", "source", "phase", F.struct("phase", "sid").alias("ord"))
    kept = dedup_edges(every, "ord").drop("ord")
    edges = dense_ids(kept, ["phase", "source_id", "target_id", "edge_type"], "edge_id").select("edge_id", "source_id", "target_id", "edge_type", "source")
    return CodeGraph(cut(full_nodes(nodes).unionByName(full_nodes(outer))), cut(edges))


def index_directory(
    spark: SparkSession,
    root: str,
    exclude: tuple[str, ...] = (),
    previous: CodeGraph | None = None,
    parity: bool = False,
    logger: logging.Logger | None = None,
) -> tuple[CodeGraph, IndexResult]:
    """The graph of all source files below a folder.

    With a previous graph, files whose path and content hash it has count as skipped; the graph returned is
    that of the files as they are now.
    """
    files = cut(scan_directory(spark, root, exclude, MAX_FILE if parity else None))
    good = files.where("readable")
    total, bad = good.count(), files.where("not readable").count()
    skipped = 0
    if logger:
        log(logger, "info", "scanned", root=root, files=total, unreadable=bad)
    if previous is not None:
        before = previous.nodes.where("kind = 'file'").select(F.col("file_path").alias("path"), "content_hash")
        changed = R.changed_files(good.select(F.col("rel_path").alias("path"), "content_hash"), before).count()
        gone = before.join(good.select(F.col("rel_path").alias("path")), "path", "left_anti").count()
        skipped = total - changed
        if changed == 0 and gone == 0:
            return previous, IndexResult(0, skipped, bad)
    graph = build(good, parity)
    if logger:
        log(logger, "info", "indexed", nodes=graph.node_count(), edges=graph.edge_count(), skipped=skipped)
    return graph, IndexResult(total - skipped, skipped, bad)


def index_source(spark: SparkSession, text: str, path: str = "source.zig") -> CodeGraph:
    return build(sources_from(spark, {path: text}))


def index_texts(spark: SparkSession, texts: dict[str, str], parity: bool = False) -> CodeGraph:
    return build(sources_from(spark, texts), parity)
