"""The compact listing of a graph: header, sections of declarations, externals, grouped edges."""

from __future__ import annotations

from datetime import UTC, datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graphloom.checkpoints import cut
from graphloom.functions.text import in_scope, internal
from graphloom.operators.graph import CodeGraph
from graphloom.render.ids import Ids, assign, ends, fixed, grouped_targets, lines

TITLE = "graphloom graph"
SECTIONS = (("st", "structs"), ("un", "unions"), ("en", "enums"), ("fn", "functions"), ("c", "constants"), ("err", "errors"), ("t", "tests"))


def stats(a: Ids) -> dict[str, int]:
    """How many of each there are; functions are those of files and modules, not methods."""
    up = a.scoped.select(F.col("id").alias("parent_id"), F.col("kind").alias("_pk"))
    top = a.ids.join(a.scoped.select("id", "parent_id"), "id").join(up, "parent_id", "left")
    n = top.where("prefix <> 'fn' or _pk in ('file', 'module')").groupBy("prefix").count()
    return {r["prefix"]: r["count"] for r in n.collect()}


def languages(a: Ids) -> list[str]:
    return sorted(r[0] for r in a.scoped.where(internal() & in_scope("scope_path", a.scope)).select("language").distinct().collect())


def listed(a: Ids, prefix: str) -> DataFrame:
    """Declarations of a section with their number, file and place; of functions, those of files and modules."""
    rows = a.ids.where(F.col("prefix") == prefix).join(a.scoped, "id")
    if prefix == "fn":
        top = a.scoped.where("kind in ('file', 'module')").select(F.col("id").alias("parent_id"))
        rows = rows.join(top, "parent_id", "left_semi")
    return rows


def place() -> Column:
    return F.when(F.col("file_num").isNull(), F.lit("")).otherwise(F.concat(F.lit(" f:"), F.col("file_num").cast("string"), F.lit(":"), F.coalesce("line_start", F.lit(0)).cast("string")))


def head(prefix: str) -> Column:
    number = F.concat(F.lit(f"{prefix}:"), F.col("num").cast("string"), F.lit(" "))
    public = F.when(F.col("visibility") == "public", F.lit(" pub")).otherwise("")
    if prefix == "t":
        return F.concat(number, F.lit('"'), F.col("name"), F.lit('"'), place(), F.lit(" "), F.coalesce(F.col("line_end") - F.col("line_start") + 1, F.lit(0)).cast("string"), F.lit("L"))
    name = F.concat(F.col("name"), F.lit("()")) if prefix == "fn" else F.col("name")
    return F.concat(number, name, place()) if prefix == "err" else F.concat(number, name, place(), public)


def members(a: Ids, prefix: str) -> DataFrame:
    """Lines of fields and of methods below each struct or union that has them."""
    own = a.ids.where(F.col("prefix") == prefix).select(F.col("id").alias("parent_id"), "num")
    kids = a.scoped.where(in_scope("scope_path", a.scope) & F.col("kind").isin("field", "function")).join(own, "parent_id")
    one = F.struct(F.coalesce("line_start", F.lit(0)).alias("l"), "id", F.when(F.col("kind") == "field", F.concat(F.lit("."), F.col("name"))).otherwise(F.concat(F.lit("fn "), F.col("name"), F.lit("()"))).alias("t"))
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(one)), lambda x: x["t"]), " ")
    return kids.groupBy("num", F.when(F.col("kind") == "field", 1).otherwise(2).alias("k")).agg(joined.alias("t")).select(F.col("num").alias("k1"), F.lit("").alias("k2"), F.col("k").alias("k3"), F.concat(F.lit("  "), F.col("t")).alias("line"))


def files_section(a: Ids) -> DataFrame:
    rows = listed(a, "f")
    return rows.select(F.col("num").alias("k1"), F.lit("").alias("k2"), F.lit(0).alias("k3"), F.concat(F.lit("f:"), F.col("num").cast("string"), F.lit(" "), F.coalesce("file_path", "name"), F.lit(" "), F.coalesce("line_end", F.lit(0)).cast("string"), F.lit("L")).alias("line"))


def section(a: Ids, prefix: str) -> DataFrame:
    out = listed(a, prefix).select(F.col("num").alias("k1"), F.lit("").alias("k2"), F.lit(0).alias("k3"), head(prefix).alias("line"))
    return out.unionByName(members(a, prefix)) if prefix in ("st", "un") else out


def externals_section(a: Ids) -> DataFrame:
    kind = F.col("external.kind")
    label = F.when(kind == "stdlib", F.lit(" (stdlib)")).when(kind == "dependency", F.concat(F.lit(" (dependency)"), F.coalesce(F.concat(F.lit(" "), F.col("external.version")), F.lit("")))).otherwise("")
    roots = a.packages.join(a.scoped, "id").select(F.col("num").alias("k1"), F.lit("").alias("k2"), F.lit(0).alias("k3"), F.concat(F.lit("x:"), F.col("num").cast("string"), F.lit(" "), F.col("name"), label).alias("line"))
    return roots.unionByName(a.symbols.select(F.col("num").alias("k1"), F.col("path").alias("k2"), F.lit(1).alias("k3"), F.concat(F.lit("  "), F.col("path")).alias("line")))


def edge_lines(a: Ids, edges: DataFrame) -> DataFrame:
    """(edge_type, s_ord, line): one for a type and source."""
    target = F.when(F.col("t_prefix").isNotNull(), F.concat(F.col("t_prefix"), F.lit(":"), F.col("t_num").cast("string"))).when(F.col("x_num").isNotNull(), F.concat(F.lit("x:"), F.col("x_num").cast("string"), F.lit(":"), F.col("x_path"))).otherwise("x:?")
    g = grouped_targets(ends(a, edges), target)
    return g.select("edge_type", "s_ord", F.concat(F.col("s_prefix"), F.lit(":"), F.col("s_num").cast("string"), F.lit(" "), F.col("edge_type"), F.lit(" "), F.col("targets")).alias("line"))


def render_ctg(g: CodeGraph, project_name: str, snapshot_name: str | None = None, source_hash: bytes | None = None, scope: str | None = None, timestamp: str | None = None, tests: bool = False, externals: bool = False, literal_scope: bool = False) -> DataFrame:
    """(line_no, line) of the whole listing."""
    a = assign(g.nodes, scope, tests, externals, literal_scope)
    spark, n = g.nodes.sparkSession, stats(a)
    count = lambda p, name: f"{n.get(p, 0)} {name}"
    stamp = timestamp or datetime.now(UTC).strftime("%Y-%m-%dT%H:%M:%SZ")
    top = [f"# {TITLE} -- {project_name}", "# " + ", ".join(count(p, x) for p, x in (("f", "files"), ("fn", "functions"), ("st", "structs"), ("un", "unions"), ("en", "enums"), ("c", "constants"), ("t", "tests"), ("x", "externals"))), f"# languages: {', '.join(languages(a)) or 'none'}", f"# generated {stamp}"]
    if snapshot_name is not None:
        top.append(f"# snapshot: {snapshot_name} | source_hash: " + (source_hash or b"").decode("latin-1"))
    parts, k, written = [(0, fixed(spark, [*top, ""]))], 1, False
    for prefix, name, rows in [("f", "files", files_section(a)), *[(p, x, section(a, p)) for p, x in SECTIONS], ("x", "externals", externals_section(a) if externals else None)]:
        if n.get(prefix, 0) and rows is not None:
            parts += [(k, fixed(spark, ([""] if written else []) + [f"[{name}]"])), (k + 1, rows)]
            written, k = True, k + 2
    rows = cut(edge_lines(a, g.edges).select(F.col("s_ord").alias("k1"), F.col("edge_type").alias("k2"), F.lit(0).alias("k3"), "line"))
    if not rows.isEmpty():
        parts.append((k, fixed(spark, ([""] if written else []) + ["[edges]"])))
        # edges sort by type first: the type goes to the section number
        for t in sorted(r[0] for r in rows.select("k2").distinct().collect()):
            k += 1
            parts.append((k, rows.where(F.col("k2") == t)))
    return lines(parts)
