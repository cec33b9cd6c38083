import struct

import pytest

from graphloom.operators.graph import CodeGraph
from graphloom.render import ids
from graphloom.render.ctg import render_ctg
from graphloom.render.mermaid import render_mermaid
from graphloom.schemas import EDGES, full_nodes
from graphloom.sources import binary, jsonl

STAMP = "2026-02-14T10:30:00Z"
N = "id long, name string, kind string, file_path string, line_start int, line_end int, parent_id long, visibility string, external struct<kind:string,version:string>"


@pytest.fixture(scope="module")
def graph(spark):
    none, std = ("none", None), ("stdlib", None)
    a, b = "src/lib.zig", "src/main.zig"
    rows = [
        (0, a, "file", a, 1, 100, None, "public", none), (1, b, "file", b, 1, 50, None, "public", none), (2, "Tokenizer", "type_def", a, 5, 40, 0, "public", none), (3, "source", "field", a, 6, 6, 2, "private", none), (4, "next", "function", a, 10, 20, 2, "public", none),
        (5, "TokenKind", "enum_def", a, 45, 55, 0, "public", none), (6, "main", "function", b, 5, 20, 1, "public", none), (7, "helper", "function", b, 25, 35, 1, "private", none), (8, "MAX_SIZE", "constant", b, 2, 2, 1, "public", none), (9, "ParseError", "error_def", a, 60, 65, 0, "public", none),
        (10, 'main "works"', "test_def", b, 40, 48, 1, "private", none), (11, "std", "module", None, None, None, None, "public", std), (12, "Allocator", "type_def", None, None, None, 11, "public", std),
    ]
    edges = [(0, 1, 0, "imports", "tree_sitter"), (1, 6, 7, "calls", "tree_sitter"), (2, 6, 4, "calls", "tree_sitter"), (3, 6, 2, "uses_type", "tree_sitter"), (4, 7, 12, "uses_type", "phantom")]
    return CodeGraph(full_nodes(spark.createDataFrame(rows, N)), spark.createDataFrame(edges, EDGES))


LISTING = """# graphloom graph -- demo
# 2 files, 2 functions, 1 structs, 0 unions, 1 enums, 1 constants, 0 tests, 0 externals
# languages: zig
# generated 2026-02-14T10:30:00Z

[files]
f:1 src/lib.zig 100L
f:2 src/main.zig 50L

[structs]
st:1 Tokenizer f:1:5 pub
  .source
  fn next()

[enums]
en:1 TokenKind f:1:45 pub

[functions]
fn:2 main() f:2:5 pub
fn:3 helper() f:2:25

[constants]
c:1 MAX_SIZE f:2:2 pub

[errors]
err:1 ParseError f:1:60

[edges]
fn:2 calls fn:1 fn:3
f:2 imports f:1
fn:2 uses_type st:1
"""


def test_listing(graph):
    assert ids.text(render_ctg(graph, "demo", timestamp=STAMP)) == LISTING


def test_listing_with_everything(graph):
    got = ids.text(render_ctg(graph, "demo", timestamp=STAMP, snapshot_name="s", source_hash=b"abc", tests=True, externals=True)).split("\n")
    assert got[1].endswith("1 constants, 1 tests, 1 externals") and got[4] == "# snapshot: s | source_hash: abc"
    assert 't:1 "main "works"" f:2:40 9L' in got and got[got.index("x:1 std (stdlib)") + 1] == "  Allocator" and "fn:3 uses_type x:1:Allocator" in got


def test_listing_in_scope_and_of_nothing(spark, graph):
    got = ids.text(render_ctg(graph, "demo", timestamp=STAMP, scope="src/main"))
    assert "f:1 src/main.zig 50L" in got and "lib.zig" not in got and "fn:1 calls fn:2" in got
    empty = CodeGraph(graph.nodes.limit(0), graph.edges.limit(0))
    assert ids.text(render_ctg(empty, "x", timestamp=STAMP)).split("\n")[2] == "# languages: none"


def test_flowchart(graph):
    got = ids.text(render_mermaid(graph, "demo", timestamp=STAMP, tests=True, externals=True)).split("\n")
    for line in ("    fn_2 --> fn_1", "    fn_2 --> fn_3", "    f_2 -.-> f_1", "    fn_2 --> st_1", "    fn_3 --> x_1_Allocator", '        fn_1["fn: Tokenizer.next"]', '        t_1(["test: main &quot;works&quot;"])', '    subgraph x_std["std (stdlib)"]', "    class fn_1,fn_2,fn_3 fn_style", "    class x_1_Allocator phantom_style", '        err_1[/"error: ParseError"\\]'):
        assert line in got, line
    assert got[0] == "%% graphloom mermaid -- demo" and got.count("    end") == 3
    assert [got.index(f"    %% === {s} ===") for s in ("Class definitions", "File subgraphs", "Phantom subgraphs", "Ghost nodes", "Edges", "Class assignments")] == sorted(got.index(f"    %% === {s} ===") for s in ("Class definitions", "File subgraphs", "Phantom subgraphs", "Ghost nodes", "Edges", "Class assignments"))


def test_ghosts(graph):
    got = ids.text(render_mermaid(graph, "demo", timestamp=STAMP, scope="src/main")).split("\n")
    assert [x.strip() for x in got if x.startswith("    g_")] == ['g_1["file: src/lib.zig ..."]:::ghost_style', 'g_2["fn: next ..."]:::ghost_style', 'g_3["struct: Tokenizer ..."]:::ghost_style']
    assert "    fn_1 --> g_2" in got and "    f_1 -.-> g_1" in got and "    class g_1,g_2,g_3 ghost_style" in got


def test_rendering_does_not_depend_on_partitions(graph):
    many = CodeGraph(graph.nodes.repartition(5), graph.edges.repartition(5))
    assert ids.text(render_ctg(many, "demo", timestamp=STAMP)) == LISTING


@pytest.fixture(scope="module")
def rich(spark):
    from graphloom.plans.index import index_source

    return index_source(spark, 'const std = @import("std");\n/// "d"\\\npub extern "c" fn f(a: u8) void;\npub fn g() void { f(1); }\nconst e = error{A};\n// std.mem.X\nfn h(a: std.mem.X) void { g(); }\n', "a.zig")


def same(a, b):
    key = lambda g: (sorted(map(repr, g.nodes.collect())), sorted(repr(r[1:]) for r in g.edges.collect()))
    return key(a) == key(b)


def test_jsonl_round_trip(spark, rich, graph, tmp_path):
    import json

    for k, g in enumerate((rich, graph)):
        jsonl.write_jsonl(g, str(tmp_path / str(k)))
        assert same(jsonl.read_jsonl(spark, str(tmp_path / str(k))), g)
    lines = [json.loads(r["line"]) for r in jsonl.lines(rich).collect()]
    assert [x["_type"] for x in lines] == sorted((x["_type"] for x in lines), reverse=True) and list(lines[0])[:3] == ["_type", "id", "name"]


def test_jsonl_leaves_out_bad_rows_and_refuses_bad_json(spark, tmp_path):
    good = '{"_type":"node","id":0,"name":"a","kind":"file","language":"zig","visibility":"public","line_start":"x","content_hash":"zz","external":7}'
    lines = [good, good.replace('"file"', '"folder"').replace('"id":0', '"id":1'), '{"_type":"node","id":2}', '{"_type":"edge","source_id":0,"target_id":9,"edge_type":"calls","source":"lsp"}', '{"_type":"edge","source_id":0,"target_id":0,"edge_type":"calls","source":"lsp"}', '{"_type":"other"}']
    (tmp_path / "a.jsonl").write_text("\n".join(lines))
    g = jsonl.read_jsonl(spark, str(tmp_path / "a.jsonl"))
    (n,) = g.nodes.collect()
    assert (n["line_start"], n["content_hash"], n["external"]["kind"]) == (None, None, "none") and g.edge_count() == 1
    (tmp_path / "b.jsonl").write_text(good + "\n{not json")
    with pytest.raises(Exception):
        jsonl.read_jsonl(spark, str(tmp_path / "b.jsonl")).nodes.collect()


def test_binary_round_trip(spark, rich, graph, tmp_path):
    for k, g in enumerate((rich, graph)):
        path = str(tmp_path / f"{k}.bin")
        binary.save(spark, g.nodes, g.edges, path)
        assert same(binary.load(spark, path), g)
    head = binary.header(str(tmp_path / "1.bin"))
    assert (head.nodes, head.edges, head.node_at) == (13, 5, 72)
    binary.append(spark, graph, str(tmp_path / "1.bin"))
    both = binary.load(spark, str(tmp_path / "1.bin"))
    assert both.node_count() == 26 and both.has_edge(19, 20, "calls")


def test_binary_refuses_damage(spark, graph, tmp_path):
    path = tmp_path / "g.bin"
    binary.save(spark, graph.nodes, graph.edges, str(path))
    raw = path.read_bytes()
    for change, error in ((b"X" + raw[1:], binary.InvalidMagic), (raw[:40], binary.InvalidFormat), (raw[:8] + struct.pack("<I", 9) + raw[12:], binary.UnsupportedVersion), (raw[:-3], binary.InvalidFormat), (raw[:16] + struct.pack("<Q", 2**63) + raw[24:], binary.InvalidFormat)):
        path.write_bytes(change)
        with pytest.raises(error):
            binary.load(spark, str(path))
    for at, value in ((72 + 8, b"\xee"), (72 + 44, struct.pack("<I", 2**31))):
        path.write_bytes(raw[:at] + value + raw[at + len(value) :])
        with pytest.raises(Exception, match="InvalidFormat"):
            binary.load(spark, str(path)).nodes.collect()


def test_language_blob():
    assert binary.decode_meta(b"") is None and binary.decode_meta(b"\x07\x00") is None
    meta = dict(is_comptime=True, is_mutable=False, is_inline=True, is_extern=False, is_packed=True, comptime_conditional=False, calling_convention="c")
    assert binary.encode_meta(meta) == bytes([1, 1 | 2 | 32]) + b"c"
    assert binary.decode_meta(binary.encode_meta(meta)) == (True, False, True, False, True, False, "c")
