"""That work is spread and that nothing large goes through the driver, however small the tables look to Spark."""

from graphloom import checkpoints
from graphloom.plans import index
from graphloom.sources.scan import sources_of


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_files_of_a_table_in_one_part_are_parsed_in_many(spark, monkeypatch):
    monkeypatch.setattr(index, "FILES_A_TASK", 5)
    texts = spark.createDataFrame([(f"d/f{k}.zig", f"pub fn f{k}() void {{}}\n") for k in range(60)], "rel_path string, content string").coalesce(1)
    parsed = index.parse_files(sources_of(texts))
    assert parsed.rdd.getNumPartitions() == 12 and parsed.count() == 60
    assert index.parse_files(sources_of(texts.limit(2))).rdd.getNumPartitions() == 2 and index.parse_files(sources_of(texts.limit(0))).count() == 0


def test_a_written_table_of_many_rows_is_not_broadcast(spark, monkeypatch):
    many = spark.range(1000).selectExpr("id", "'x' as t")
    assert "BroadcastHashJoin" in plan(spark.range(500_000).join(checkpoints.cut(many), "id"))
    monkeypatch.setattr(checkpoints, "BROADCAST_ROWS", 999)
    for kind in ("inner", "left", "left_semi"):
        assert "SortMergeJoin" in plan(spark.range(500_000).join(checkpoints.cut(many).select("id"), "id", kind))
    few = checkpoints.cut(many.limit(100))
    assert "BroadcastHashJoin" in plan(spark.range(500_000).join(few, "id"))
    nested = checkpoints.cut(many.limit(100).selectExpr("id", "array(named_struct('a', id)) as s"))
    assert "SortMergeJoin" in plan(spark.range(500_000).join(nested, "id"))


def test_a_binary_file_is_written_by_tasks_in_the_order_of_ids(spark, monkeypatch, tmp_path):
    from pyspark.sql.classic.dataframe import DataFrame

    from graphloom.schemas import full_nodes
    from graphloom.sources import binary

    def refused(*_, **__):
        raise AssertionError("rows on the driver")

    monkeypatch.setattr(DataFrame, "toLocalIterator", refused)
    monkeypatch.setattr(binary, "CHUNK", 7)
    nodes = full_nodes(spark.range(100).selectExpr("99 - id as id", "concat('n', (99 - id) % 40) as name", "'field' as kind", "'a.zig' as file_path")).repartition(5)
    edges = spark.range(100).selectExpr("500 - id as edge_id", "id as source_id", "99 - id as target_id", "'calls' as edge_type", "'lsp' as source").repartition(3)
    path = tmp_path / "g.bin"
    binary.save(spark, nodes, edges, str(path))
    h, raw = binary.header(str(path)), path.read_bytes()
    assert raw[h.string_at :].decode() == "n0a.zig" + "".join(f"n{k}" for k in range(1, 40))
    assert [int.from_bytes(raw[h.node_at + 96 * k :][:8], "little") for k in range(100)] == list(range(100))
    assert [int.from_bytes(raw[h.edge_at + 24 * k :][:8], "little") for k in range(100)] == list(range(99, -1, -1))
    g = binary.load(spark, str(path))
    assert sorted((r["id"], r["name"], r["file_path"]) for r in g.nodes.collect()) == [(k, f"n{k % 40}", "a.zig") for k in range(100)] and g.edge_count() == 100
    assert sorted(r["id"] for r in spark.read.format("codegraph_v1").option("table", "ids").load(str(path)).collect()) == list(range(100))


def test_degrees_take_no_join_and_edges_go_to_as_many_tasks_as_are_said(spark):
    from graphloom.operators import graph as G

    nodes = spark.createDataFrame([(0,), (1,), (7,)], "id long")
    edges = spark.createDataFrame([(0, 1, "calls", 2, "b"), (0, 1, "calls", 1, "a"), (1, 9, "calls", 3, "c"), (1, 1, "calls", 0, "d")], "source_id long, target_id long, edge_type string, edge_id long, source string")
    got = G.degrees(nodes, edges)
    assert "Join" not in plan(got) and sorted(map(tuple, got.collect())) == [(0, 2, 0), (1, 2, 3), (7, 0, 0)]
    one = G.dedup_edges(edges, parts=13)
    assert one.rdd.getNumPartitions() == 13 and sorted(r["source"] for r in one.collect()) == sorted(r["source"] for r in G.dedup_edges(edges).collect()) == ["a", "c"]


def test_large_tables_meet_in_parts_of_few_rows(spark, monkeypatch):
    from graphloom.plans import adapters as A

    d = "/root/testdata/sf0.001"
    want = sorted(map(tuple, A.edges(spark, d).collect()))
    assert A.parts_of(spark, d) is None
    monkeypatch.setattr(A, "ROWS_A_PART", 500)
    n = A.parts_of(spark, d)
    assert n == -(-spark.read.parquet(f"{d}/lineitem.parquet").count() // 500) and A.edges(spark, d).rdd.getNumPartitions() == 2 * n
    assert sorted(map(tuple, A.edges(spark, d).collect())) == want


def test_cross_summary_in_parts(spark):
    from graphloom.operators import graph as G

    nodes = spark.createDataFrame([(0, "a", "a"), (1, "b", "b")], "id long, name string, file_path string")
    owners = spark.createDataFrame([(0, 0), (1, 1), (2, 1), (3, None)], "id long, owner long")
    edges = spark.createDataFrame([(0, 1, "calls"), (0, 2, "calls"), (1, 2, "calls"), (2, 3, "uses_type")], "source_id long, target_id long, edge_type string")
    got = G.cross_summary(edges, owners, nodes, parts=7)
    assert sorted(map(tuple, got.collect())) == [("a", "b", "calls", 2), ("b", "<ext>", "uses_type", 1)] and ", 7), REPARTITION_BY_NUM" in plan(got)


def test_texts_of_a_table_in_one_part_are_made_in_many_tasks(spark, monkeypatch, tmp_path):
    from graphloom.plans import sources_of_tables as S

    monkeypatch.setattr(index, "FILES_A_TASK", 5)
    spark.range(60).selectExpr("id as s_suppkey", "'x' as s_name").coalesce(1).write.parquet(f"{tmp_path}/supplier.parquet")
    files = S.files(spark, str(tmp_path))
    assert files.rdd.getNumPartitions() == 12
    got = {r["rel_path"]: r["content"] for r in files.collect()}
    assert len(got) == 60 and "pub fn run7()" in got["src/d2/f7.zig"] and '"../d3/f3.zig"' in got["src/d2/f7.zig"]


def test_ids_of_a_style_are_joined_in_runs(spark, monkeypatch):
    from pyspark.sql import functions as F

    from graphloom.render import ids, mermaid

    nodes = spark.createDataFrame([(0, None, "a.zig", "file", "a.zig", 1)] + [(k, 0, f"f{k}", "function", None, k) for k in range(1, 30)], "id long, parent_id long, name string, kind string, file_path string, line_start int").withColumn("external", F.lit(None).cast("struct<kind:string,version:string>"))
    a = ids.assign(nodes)
    want = "    class " + ",".join(f"fn_{k}" for k in range(1, 30)) + " fn_style"
    for n in (4, 7, 8192):
        monkeypatch.setattr(mermaid, "IDS_A_RUN", n)
        assert [r["line"] for r in mermaid.class_rows(a).collect()] == [want]
    assert plan(mermaid.class_rows(a)).count("collect_list") > plan(a.ids.groupBy("prefix").agg(F.collect_list("num"))).count("collect_list")
