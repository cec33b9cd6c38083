"""Graph operators over a node and an edge table: lookups, neighbours, adjacency, closure, edge dedup, set operations."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce
from typing import Literal

from pyspark.sql import Column, DataFrame, Observation, Window
from pyspark.sql import functions as F

from graphloom.checkpoints import cut, discard

Direction = Literal["out", "in", "both"]
KEY = ("source_id", "target_id", "edge_type")


def running_sum(df: DataFrame, order: list, amount: Column | int, name: str, start: Column | int = 0) -> DataFrame:
    """df with ``name``: start and the sum of ``amount`` over all rows before, in a total order.

    Rows are written, then range-partitioned on the order and summed in each part: no task sees more than its part,
    and what df is made of is evaluated once.  The parts' sums, one row for each, are added up on the driver.
    """
    spark, once = df.sparkSession, cut(df)
    each = once.repartitionByRange(*order).withColumn("_part", F.spark_partition_id()).withColumn("_n", F.lit(amount).cast("long"))
    before = Window.partitionBy("_part").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    parts = cut(each.withColumn("_upto", F.coalesce(F.sum("_n").over(before), F.lit(0))))
    discard(once)
    rows, at = [], 0
    for r in parts.groupBy("_part").agg(F.sum("_n").alias("n")).orderBy("_part").collect():
        rows.append((r["_part"], at))
        at += r["n"]
    base = spark.createDataFrame(rows, "_part int, _base long")
    out = parts.join(F.broadcast(base), "_part").withColumn(name, F.col("_upto") + F.col("_base") + F.lit(start))
    return out.drop("_part", "_n", "_upto", "_base")


def dense_ids(df: DataFrame, order: list, name: str = "id", start: Column | int = 0) -> DataFrame:
    """Consecutive numbers in a total order; a row's place in its part comes from the sort and takes no window."""
    spark, once = df.sparkSession, cut(df)
    parts = once.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_part", F.spark_partition_id())
    parts = cut(parts.withColumn("_seq", F.monotonically_increasing_id()))
    discard(once)
    rows, at = [], 0
    for r in parts.groupBy("_part").agg(F.count("*").alias("n"), F.min("_seq").alias("lo")).orderBy("_part").collect():
        rows.append((r["_part"], at - r["lo"]))
        at += r["n"]
    base = spark.createDataFrame(rows, "_part int, _base long")
    out = parts.join(F.broadcast(base), "_part").withColumn(name, F.col("_seq") + F.col("_base") + F.lit(start))
    return out.drop("_part", "_seq", "_base")


def dedup_edges(edges: DataFrame, order: str = "edge_id", parts: int | None = None) -> DataFrame:
    """Without self-loops, and of equal (source, target, type) the first by ``order``, with all its columns.

    An aggregation and no window, so it combines before the shuffle.  With ``parts``, rows go to so many tasks as they
    are: for many edges with few repeats, where Spark would put as many into a task as fit 64 compressed MB.
    """
    edges = edges if parts is None else edges.where("source_id <> target_id").repartition(parts, *KEY)
    others = [c for c in edges.columns if c not in KEY]
    first = F.min_by(F.struct(*others), F.col(order)).alias("_first")
    return edges.where("source_id <> target_id").groupBy(*KEY).agg(first).select(*[F.col(c) if c in KEY else F.col(f"_first.{c}").alias(c) for c in edges.columns])


def self_loops(edges: DataFrame) -> DataFrame:
    return edges.where("source_id = target_id")


def edge_keys(edges: DataFrame) -> DataFrame:
    return edges.select(*KEY).distinct()


def held_edges(edges: DataFrame, wanted: DataFrame) -> DataFrame:
    """wanted (source_id, target_id, edge_type) with held: whether there is such an edge."""
    have = edge_keys(edges).withColumn("held", F.lit(True))
    return wanted.join(have, [*KEY], "left").select(*wanted.columns, F.coalesce("held", F.lit(False)).alias("held"))


def without_dangling(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Edges both of whose ends are nodes."""
    ids = nodes.select("id")
    one = edges.join(ids.withColumnRenamed("id", "source_id"), "source_id", "left_semi")
    return one.join(ids.withColumnRenamed("id", "target_id"), "target_id", "left_semi").select(*edges.columns)


def node(nodes: DataFrame, ids: DataFrame | int) -> DataFrame:
    return nodes.where(F.col("id") == ids) if isinstance(ids, int) else nodes.join(ids.select("id"), "id", "left_semi")


def _on(edges: DataFrame, column: str, ids: DataFrame | int) -> DataFrame:
    return edges.where(F.col(column) == ids) if isinstance(ids, int) else edges.join(ids.select(F.col("id").alias(column)), column, "left_semi").select(*edges.columns)


def out_edges(edges: DataFrame, ids: DataFrame | int) -> DataFrame:
    return _on(edges, "source_id", ids)


def in_edges(edges: DataFrame, ids: DataFrame | int) -> DataFrame:
    return _on(edges, "target_id", ids)


def children(nodes: DataFrame, ids: DataFrame | int) -> DataFrame:
    return nodes.where(F.col("parent_id") == ids) if isinstance(ids, int) else nodes.join(ids.select(F.col("id").alias("parent_id")), "parent_id", "left_semi").select(*nodes.columns)


def parents(nodes: DataFrame) -> DataFrame:
    """(id, parent_id), null where the parent isn't a node."""
    p = nodes.select(F.col("id").alias("_p"))
    return nodes.select("id", "parent_id").join(p, F.col("parent_id") == F.col("_p"), "left").select("id", F.col("_p").alias("parent_id"))


def neighbors(edges: DataFrame, ids: DataFrame | int, direction: Direction = "both") -> DataFrame:
    """(id, neighbor, leg, edge_id): a bag; an end met by two edges stands twice.  leg 0: out, 1: in."""
    out = out_edges(edges, ids).select(F.col("source_id").alias("id"), F.col("target_id").alias("neighbor"), F.lit(0).alias("leg"), "edge_id")
    into = in_edges(edges, ids).select(F.col("target_id").alias("id"), F.col("source_id").alias("neighbor"), F.lit(1).alias("leg"), "edge_id")
    return out if direction == "out" else into if direction == "in" else out.unionAll(into)


def adjacency(nodes: DataFrame, edges: DataFrame) -> dict[str, DataFrame]:
    """out, into and children: (id, members) with members in ascending order, for ends that are nodes."""
    ids = nodes.select("id")
    group = lambda df, key, value: df.join(ids.withColumnRenamed("id", key), key, "left_semi").groupBy(F.col(key).alias("id")).agg(F.array_sort(F.collect_list(value)).alias("members"))
    return {"out": group(edges, "source_id", "edge_id"), "into": group(edges, "target_id", "edge_id"), "children": group(nodes.where("parent_id is not null").select("parent_id", "id"), "parent_id", "id")}


def degrees(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(id, out_degree, in_degree) of every node, 0 included; both ends and the nodes meet in one aggregation and no join."""
    end = lambda at, o, i, node: F.struct(F.col(at).alias("id"), F.lit(o).alias("o"), F.lit(i).alias("i"), F.lit(node).alias("node"))
    ends = edges.select(F.explode(F.array(end("source_id", 1, 0, 0), end("target_id", 0, 1, 0))).alias("e")).unionAll(nodes.select(end("id", 0, 0, 1).alias("e"))).select("e.*")
    n = ends.groupBy("id").agg(F.sum("o").alias("out_degree"), F.sum("i").alias("in_degree"), F.max("node").alias("_node"))
    return n.where("_node = 1").select("id", "out_degree", "in_degree")


def csr_offsets(degrees: DataFrame, column: str = "out_degree") -> DataFrame:
    """degrees with ``offset``: the sum over all lesser ids."""
    return running_sum(degrees, ["id"], F.col(column), "offset")


def ancestors(nodes: DataFrame, max_hops: int | None = None) -> DataFrame:
    """(id, ancestor, hops) over the parent chain, by doubling: a chain of d hops takes log2(d) rounds.

    A node that is its own ancestor is an error; with max_hops, no more hops are taken.
    """
    step = nodes.where("parent_id is not null").select("id", F.col("parent_id").alias("ancestor"), F.lit(1).alias("hops"))
    step = cut(step.join(nodes.select(F.col("id").alias("ancestor")), "ancestor", "left_semi").select("id", "ancestor", "hops"))
    reach, far = step, step
    length = 1
    while max_hops is None or length < max_hops:
        onward = reach.select(F.col("id").alias("_m"), F.col("ancestor").alias("_a"), F.col("hops").alias("_h"))
        more = far.join(onward, F.col("ancestor") == F.col("_m")).select("id", F.col("_a").alias("ancestor"), (F.col("hops") + F.col("_h")).alias("hops"))
        more = cut(more if max_hops is None else more.where(F.col("hops") <= max_hops))
        length *= 2
        if more.isEmpty():
            break
        if max_hops is None and not more.where("id = ancestor").isEmpty():
            raise ValueError("a node is its own ancestor")
        reach = reach.unionAll(more)
        # the ends from which the next round goes on are exactly ``length`` hops up
        far = more.where(F.col("hops") == length)
    return reach


def owning(nodes: DataFrame, kind: str = "file", max_hops: int | None = None) -> DataFrame:
    """(id, owner): the nearest node of ``kind`` at or above each node, null if there is none; by pointer jumping.

    Without max_hops, as many as there are nodes, so nodes on a cycle have no owner.
    """
    at = cut(nodes.select("id", F.when(F.col("kind") == kind, F.col("id")).otherwise(F.col("parent_id")).alias("p"), (F.col("kind") == kind).alias("done")))
    hops, most = 1, max_hops or at.count()
    while hops < most:
        up = at.select(F.col("id").alias("_id"), F.col("p").alias("_p"), F.col("done").alias("_done"))
        after = at.join(up, (F.col("p") == F.col("_id")) & ~F.col("done"), "left")
        done = F.col("done") | F.coalesce("_done", F.lit(False))
        after = cut(after.select("id", F.when(F.col("done"), F.col("p")).otherwise(F.col("_p")).alias("p"), done.alias("done")))
        discard(at)
        at, hops = after, hops * 2
        if at.where("not done and p is not null").isEmpty():
            break
    return at.select("id", F.when(F.col("done"), F.col("p")).alias("owner"))


def descendant_of(nodes: DataFrame, pairs: DataFrame) -> DataFrame:
    """pairs (id, ancestor) that hold; a node is not its own descendant."""
    return pairs.join(ancestors(nodes).select("id", "ancestor"), ["id", "ancestor"], "left_semi")


def append(first: tuple[DataFrame, DataFrame], second: tuple[DataFrame, DataFrame], remap: bool = True) -> tuple[DataFrame, DataFrame]:
    """The union of two graphs; with remap, the second's ids, parents and ends move past the first's."""
    n = first[0].agg(F.max("id")).first()[0]
    e = first[1].agg(F.max("edge_id")).first()[0]
    n, e = (0 if n is None else n + 1), (0 if e is None else e + 1)
    moved = second[0].withColumn("id", F.col("id") + n)
    edges = second[1].withColumn("edge_id", F.col("edge_id") + e)
    if remap:
        moved = moved.withColumn("parent_id", F.col("parent_id") + n)
        edges = edges.withColumns({"source_id": F.col("source_id") + n, "target_id": F.col("target_id") + n})
    return first[0].unionByName(moved), first[1].unionByName(edges)


def counts_by(df: DataFrame, column: str) -> DataFrame:
    return df.groupBy(column).agg(F.count("*").alias("n"))


def cross_summary(edges: DataFrame, owners: DataFrame, names: DataFrame, parts: int | None = None) -> DataFrame:
    """(src_file, tgt_file, edge_type, n) of edges whose ends have different owners; no owner is ``<ext>``.

    With ``parts``, edges meet their ends' owners in so many tasks.
    """
    split = lambda df, key: df if parts is None else df.repartition(parts, key)
    of = owners.join(names.select(F.col("id").alias("owner"), F.coalesce("file_path", "name").alias("_f")), "owner", "left").select("id", "owner", F.coalesce("_f", F.lit("<ext>")).alias("f"))
    s = of.select(F.col("id").alias("source_id"), F.col("owner").alias("so"), F.col("f").alias("src_file"))
    t = of.select(F.col("id").alias("target_id"), F.col("owner").alias("to"), F.col("f").alias("tgt_file"))
    return split(split(edges, "source_id").join(s, "source_id"), "target_id").join(t, "target_id").where("not (so <=> to)").groupBy("src_file", "tgt_file", "edge_type").agg(F.count("*").alias("n"))


def cross_summary_text(summary: DataFrame) -> DataFrame:
    """(src_file, tgt_file, edges): one line for a pair, ``type(n)`` in the enumeration's order."""
    from graphloom.schemas import EDGE_TYPES, ordinal

    one = F.struct(ordinal("edge_type", EDGE_TYPES).alias("o"), F.concat(F.col("edge_type"), F.lit("("), F.col("n").cast("string"), F.lit(")")).alias("t"))
    return summary.groupBy("src_file", "tgt_file").agg(F.concat_ws(",", F.transform(F.array_sort(F.collect_list(one)), lambda x: x["t"])).alias("edges"))


def topological_levels(items: DataFrame, depends: DataFrame) -> DataFrame:
    """(id, level): 0 without dependencies, else one more than the highest of those; null on or behind a cycle.

    depends: (id, on).  Repeats and self-dependencies count for nothing.  Each round takes the items that are free,
    and lowers the count of open dependencies of those that depend on them; one table is written, of what is left, and
    how many are free is counted as it is written.
    """
    def written(df: DataFrame) -> tuple[DataFrame, int]:
        seen = Observation()
        table = cut(df.observe(seen, F.count_if(F.col("need") == 0).alias("free")))
        return table, seen.get.get("free") or 0

    ids = items.select("id").distinct()
    links = depends.where("id <> on").select("id", "on").distinct()
    links = cut(links.join(ids, "id", "left_semi").join(ids.withColumnRenamed("id", "on"), "on", "left_semi").select("id", "on"))
    need = links.groupBy("id").agg(F.count("*").alias("need"))
    left, free_now = written(ids.join(need, "id", "left").select("id", F.coalesce("need", F.lit(0)).alias("need")))
    tables = [left]
    while free_now:
        free = left.where("need = 0").select(F.col("id").alias("on"))
        met = links.join(free, "on").groupBy("id").agg(F.count("*").alias("met"))
        rest = left.where("need > 0").join(met, "id", "left")
        left, free_now = written(rest.select("id", (F.col("need") - F.coalesce("met", F.lit(0))).alias("need")))
        tables.append(left)
    done = [t.where("need = 0").select("id", F.lit(k).alias("level")) for k, t in enumerate(tables[:-1])]
    out = cut(reduce(DataFrame.unionAll, done, left.select("id", F.lit(None).cast("int").alias("level"))))
    for table in (links, *tables):
        discard(table)
    return out


def phantoms(names: DataFrame) -> DataFrame:
    """One row for each dotted prefix: (qualified, name, depth, kind, external, parent).

    names: (name, kind, external, ord).  The last segment takes the name's kind, those before it are modules;
    of several for one prefix, the first by (ord, depth) counts.
    """
    parts = names.select("kind", "external", "ord", F.filter(F.split("name", r"\."), lambda x: x != "").alias("p")).where("size(p) > 0")
    each = parts.select("kind", "external", "ord", "p", F.explode(F.sequence(F.lit(1), F.size("p"))).alias("d"))
    one = each.select(F.array_join(F.slice("p", F.lit(1), F.col("d")), ".").alias("qualified"), F.element_at("p", F.col("d")).alias("name"), F.col("d").alias("depth"), F.when(F.col("d") == F.size("p"), F.col("kind")).otherwise("module").alias("kind"), "external", F.array_join(F.slice("p", F.lit(1), F.col("d") - 1), ".").alias("parent"), "ord")
    first = one.groupBy("qualified").agg(F.min_by(F.struct("name", "depth", "kind", "external", "parent"), F.struct("ord", "depth")).alias("x"))
    return first.select("qualified", "x.name", "x.depth", "x.kind", "x.external", F.when(F.col("x.parent") != "", F.col("x.parent")).alias("parent"))


def qualified_paths(nodes: DataFrame, roots: DataFrame) -> DataFrame:
    """(root, id, path): dotted names of all below each root (id), without the root's own."""
    up = ancestors(nodes)
    under = up.join(roots.select(F.col("id").alias("ancestor")), "ancestor", "left_semi").select(F.col("ancestor").alias("root"), "id", F.col("hops").alias("span"))
    names = nodes.select(F.col("id").alias("ancestor"), "name")
    chain = up.unionAll(nodes.select("id", F.col("id").alias("ancestor"), F.lit(0).alias("hops"))).join(names, "ancestor")
    both = under.join(chain, "id").where("hops < span")
    steps = F.array_sort(F.collect_list(F.struct((-F.col("hops")).alias("k"), "name")))
    return both.groupBy("root", "id").agg(F.array_join(F.transform(steps, lambda x: x["name"]), ".").alias("path"))


@dataclass
class CodeGraph:
    """A node and an edge table, never changed in place."""

    nodes: DataFrame
    edges: DataFrame
    project_root: str = ""

    def freeze(self) -> CodeGraph:
        return CodeGraph(self.nodes.persist(), self.edges.persist(), self.project_root)

    def release(self) -> None:
        self.nodes.unpersist()
        self.edges.unpersist()

    def with_nodes(self, nodes: DataFrame) -> CodeGraph:
        return CodeGraph(append((self.nodes, self.edges), (nodes, self.edges.limit(0)))[0], self.edges, self.project_root)

    def with_edges(self, edges: DataFrame, dedup: bool = True) -> CodeGraph:
        both = append((self.nodes, self.edges), (self.nodes.limit(0), edges), remap=False)[1]
        return CodeGraph(self.nodes, dedup_edges(both) if dedup else both, self.project_root)

    def node(self, ids) -> DataFrame:
        return node(self.nodes, ids)

    def children(self, ids) -> DataFrame:
        return children(self.nodes, ids).orderBy("id")

    def parent(self, ids) -> DataFrame:
        return parents(self.nodes).where(F.col("id") == ids) if isinstance(ids, int) else parents(self.nodes).join(ids.select("id"), "id", "left_semi")

    def out_edges(self, ids) -> DataFrame:
        return out_edges(self.edges, ids).orderBy("edge_id")

    def in_edges(self, ids) -> DataFrame:
        return in_edges(self.edges, ids).orderBy("edge_id")

    def neighbors(self, ids, direction: Direction = "both") -> DataFrame:
        return neighbors(self.edges, ids, direction).orderBy("leg", "edge_id")

    def adjacency(self) -> dict[str, DataFrame]:
        return adjacency(self.nodes, self.edges)

    def node_count(self) -> int:
        return self.nodes.count()

    def edge_count(self) -> int:
        return self.edges.count()

    def find(self, name: str, kind: str | None = None, under: int | None = None) -> DataFrame:
        """The first node of a name (and kind), below a node if one is given."""
        found = self.nodes.where((F.col("name") == name) & (F.lit(True) if kind is None else F.col("kind") == kind))
        if under is not None:
            found = found.join(ancestors(self.nodes).where(F.col("ancestor") == under).select("id"), "id", "left_semi")
        return found.orderBy("id").limit(1)

    def has_edge(self, source: int, target: int, edge_type: str, origin: str | None = None) -> bool:
        edges = self.edges if origin is None else self.edges.where(F.col("source") == origin)
        wanted = edges.sparkSession.createDataFrame([(source, target, edge_type)], "source_id long, target_id long, edge_type string")
        return held_edges(edges, wanted).first()["held"]

    def save(self, path: str) -> int:
        """A new generation of the graph as Parquet, and its number; older ones stay, and so do graphs opened from them."""
        n = max(CodeGraph.generations(self.nodes.sparkSession, path), default=-1) + 1
        self.nodes.write.parquet(f"{path}/generation-{n:06d}/nodes")
        self.edges.write.parquet(f"{path}/generation-{n:06d}/edges")
        return n

    @staticmethod
    def generations(spark, path: str) -> list[int]:
        """The generations at a path that were written whole: edges are written last."""
        jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
        at = jvm.org.apache.hadoop.fs.Path(f"{path}/generation-*/edges/_SUCCESS")
        found = at.getFileSystem(conf).globStatus(at) or []
        return sorted(int(s.getPath().getParent().getParent().getName().rsplit("-", 1)[1]) for s in found)

    @staticmethod
    def prune(spark, path: str, keep: int = 1) -> None:
        """Delete all generations but the latest ``keep``; no graph opened from the others may be in use."""
        jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
        for n in CodeGraph.generations(spark, path)[: -keep or None]:
            at = jvm.org.apache.hadoop.fs.Path(f"{path}/generation-{n:06d}")
            at.getFileSystem(conf).delete(at, True)

    @staticmethod
    def open(spark, path: str, generation: int | None = None) -> CodeGraph:
        """The graph of a generation, of the latest unless one is given."""
        have = CodeGraph.generations(spark, path)
        if not have or generation not in (None, *have):
            raise FileNotFoundError(f"no such generation of a graph at {path}")
        at = f"{path}/generation-{have[-1] if generation is None else generation:06d}"
        return CodeGraph(spark.read.parquet(f"{at}/nodes"), spark.read.parquet(f"{at}/edges"))
