import random

import pytest
from pyspark.sql import functions as F

from graphloom.operators import graph as G
from graphloom.operators import resolve as R


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


@pytest.fixture(scope="module")
def tree(spark):
    return spark.createDataFrame([(0, "f", "file", None), (1, "A", "type_def", 0), (2, "b", "function", 1), (3, "c", "field", 2), (4, "x", "module", None), (5, "lost", "field", 99)], "id long, name string, kind string, parent_id long")


@pytest.fixture(scope="module")
def edges(spark):
    return spark.createDataFrame([(0, 0, 1, "calls", "tree_sitter"), (1, 0, 1, "calls", "lsp"), (2, 1, 1, "calls", "lsp"), (3, 1, 0, "uses_type", "lsp"), (4, 2, 77, "calls", "lsp"), (5, 0, 1, "imports", "phantom")], "edge_id long, source_id long, target_id long, edge_type string, source string")


def test_dedup_keeps_the_first_with_its_columns(edges):
    assert rows(G.dedup_edges(edges)) == [(0, 0, 1, "calls", "tree_sitter"), (3, 1, 0, "uses_type", "lsp"), (4, 2, 77, "calls", "lsp"), (5, 0, 1, "imports", "phantom")]
    assert rows(G.self_loops(edges)) == [(2, 1, 1, "calls", "lsp")]


def test_neighbours_are_a_bag(edges):
    assert rows(G.neighbors(edges, 0)) == [(0, 1, 0, 0), (0, 1, 0, 1), (0, 1, 0, 5), (0, 1, 1, 3)]
    assert len(rows(G.neighbors(edges, 0, "out"))) == 3 and len(rows(G.neighbors(edges, 0, "in"))) == 1


def test_adjacency_leaves_out_ends_that_are_no_nodes(tree, edges):
    a = G.adjacency(tree, edges)
    assert rows(a["out"]) == [(0, [0, 1, 5]), (1, [2, 3]), (2, [4])]
    assert rows(a["into"]) == [(0, [3]), (1, [0, 1, 2, 5])]
    assert rows(a["children"]) == [(0, [1]), (1, [2]), (2, [3])]
    assert rows(G.without_dangling(edges, tree))[-1][0] == 5 and len(rows(G.without_dangling(edges, tree))) == 5


def test_degrees_and_offsets(tree, edges):
    d = G.degrees(tree, edges)
    assert rows(d) == [(0, 3, 1), (1, 2, 4), (2, 1, 0), (3, 0, 0), (4, 0, 0), (5, 0, 0)]
    assert rows(G.csr_offsets(d).select("id", "offset")) == [(0, 0), (1, 3), (2, 5), (3, 6), (4, 6), (5, 6)]


def test_closure_and_owner(tree):
    assert rows(G.ancestors(tree)) == [(1, 0, 1), (2, 0, 2), (2, 1, 1), (3, 0, 3), (3, 1, 2), (3, 2, 1)]
    assert rows(G.owning(tree)) == [(0, 0), (1, 0), (2, 0), (3, 0), (4, None), (5, None)]
    assert rows(G.parents(tree))[-1] == (5, None)
    assert rows(G.ancestors(tree, max_hops=1)) == [(1, 0, 1), (2, 1, 1), (3, 2, 1)]


def test_closure_of_a_long_chain_stops_only_at_a_given_number_of_hops(spark):
    chain = spark.createDataFrame([(k, k - 1 if k else None, "file" if k == 0 else "field") for k in range(130)], "id long, parent_id long, kind string")
    got = rows(G.ancestors(chain, 100))
    assert len(got) == sum(min(k, 100) for k in range(130)) and max(r[2] for r in got) == 100
    got = rows(G.ancestors(chain))
    assert len(got) == 130 * 129 // 2 and max(r[2] for r in got) == 129
    assert {r[1] for r in rows(G.owning(chain))} == {0}


def test_a_cycle_of_parents_is_an_error(spark):
    loop = spark.createDataFrame([(0, 2, "field"), (1, 0, "field"), (2, 1, "field"), (3, None, "file")], "id long, parent_id long, kind string")
    with pytest.raises(ValueError, match="own ancestor"):
        G.ancestors(loop)
    assert rows(G.owning(loop)) == [(0, None), (1, None), (2, None), (3, 3)]


def test_running_sums(spark):
    values = spark.createDataFrame([(k * 7 % 11, k) for k in range(11)], "k long, n long")
    want, at = [], 5
    for k, n in sorted((k * 7 % 11, k) for k in range(11)):
        want.append((k, n, at))
        at += n
    assert rows(G.running_sum(values, ["k"], F.col("n"), "before", 5).select("k", "n", "before")) == sorted(want, key=repr)
    assert rows(G.running_sum(values.limit(0), ["k"], F.col("n"), "before")) == []


def test_held_edges(edges):
    wanted = edges.sparkSession.createDataFrame([(0, 1, "calls"), (0, 1, "imports"), (9, 9, "calls"), (0, 1, "calls")], "source_id long, target_id long, edge_type string")
    have = {r[:3] for r in rows(edges.select("source_id", "target_id", "edge_type"))}
    assert rows(G.held_edges(edges, wanted)) == sorted([(*w, w in have) for w in [(0, 1, "calls"), (0, 1, "imports"), (9, 9, "calls"), (0, 1, "calls")]], key=repr)


def test_levels_and_order(spark):
    items = spark.createDataFrame([(k, f"p{k}") for k in range(7)], "id long, path string")
    depends = spark.createDataFrame([(1, 0), (1, 0), (2, 1), (2, 0), (3, 3), (4, 5), (5, 4), (6, 5), (6, 0)], "id long, on long")
    assert rows(G.topological_levels(items, depends)) == [(0, 0), (1, 1), (2, 2), (3, 0), (4, None), (5, None), (6, None)]


def test_phantoms(spark):
    names = spark.createDataFrame([("std.mem.Allocator", "type_def", "stdlib", 1), ("std.mem", "function", "stdlib", 2), ("std", "function", "stdlib", 0)], "name string, kind string, external string, ord int")
    assert rows(G.phantoms(names)) == [("std", "std", 1, "function", "stdlib", None), ("std.mem", "mem", 2, "module", "stdlib", "std"), ("std.mem.Allocator", "Allocator", 3, "type_def", "stdlib", "std.mem")]


def test_append(tree, edges):
    n, e = G.append((tree, edges), (tree, edges))
    assert len(rows(n)) == 12 and (8, "b", "function", 7) in rows(n) and (6, 6, 7, "calls", "tree_sitter") in rows(e)
    n, e = G.append((tree, edges), (tree, edges), remap=False)
    assert (8, "b", "function", 1) in rows(n) and (6, 0, 1, "calls", "tree_sitter") in rows(e)


def test_dense_ids_do_not_depend_on_partitions(spark):
    values = list(range(500))
    random.Random(1).shuffle(values)
    for parts in (1, 7):
        df = spark.createDataFrame([(v,) for v in values], "v long").repartition(parts)
        assert rows(G.dense_ids(df, ["v"], "k", 5)) == sorted(((v, v + 5) for v in values), key=repr)
    assert rows(G.dense_ids(df.limit(0), ["v"], "k")) == []


def test_interval_join_takes_the_first_range(spark):
    rng = random.Random(2)
    ranges = [(k, rng.randint(0, 2), a := rng.randint(0, 400), a + rng.randint(0, 300)) for k in range(40)]
    points = [(k, rng.randint(0, 2), rng.randint(0, 700)) for k in range(200)]
    want = []
    for p, f, line in points:
        hit = [i for i, g, a, b in ranges if f == g and a <= line <= b]
        if hit:
            want.append((p, min(hit)))
    got = R.containing(spark.createDataFrame(points, "pid long, file_id long, line int"), spark.createDataFrame(ranges, "id long, file_id long, line_start int, line_end int"))
    assert rows(got) == sorted(want, key=repr)


def test_unique(spark):
    t = spark.createDataFrame([("a", 2), ("a", 1), ("b", 3)], "k string, v int")
    assert rows(R.unique_only(t, ["k"], "v")) == [("b", 3)]


def test_graph_object(spark, tree, edges, tmp_path):
    from graphloom.schemas import full_nodes

    g = G.CodeGraph(full_nodes(tree), edges).freeze()
    assert g.node_count() == 6 and g.edge_count() == 6
    assert [r["id"] for r in g.children(0).collect()] == [1] and g.parent(2).first()["parent_id"] == 1
    assert g.has_edge(0, 1, "calls") and not g.has_edge(0, 1, "calls", "workspace")
    assert g.find("b", "function", under=0).first()["id"] == 2 and g.find("x", under=0).isEmpty()
    assert g.with_edges(edges).edge_count() == 4
    assert [r["edge_id"] for r in g.out_edges(0).collect()] == [0, 1, 5]
    path = str(tmp_path / "g")
    assert g.save(path) == 0
    old = G.CodeGraph.open(spark, path)
    assert old.node_count() == 6 and G.CodeGraph(old.nodes.where("id < 3"), old.edges).save(path) == 1
    assert (old.node_count(), G.CodeGraph.open(spark, path).node_count(), G.CodeGraph.open(spark, path, 0).node_count()) == (6, 3, 6)
    G.CodeGraph.prune(spark, path)
    assert G.CodeGraph.generations(spark, path) == [1]
    with pytest.raises(FileNotFoundError):
        G.CodeGraph.open(spark, path, 0)
    g.release()
