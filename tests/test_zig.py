import pytest

from graphloom.plans import index as I
from graphloom.sources.zig import Parser, dependencies

FILES = {
    "app/main.zig": '''//! Entry.
const std = @import("std");
const shop = @import("shop.zig");
const Cart = @import("lib/cart.zig").Cart;

/// Runs.
pub fn run(allocator: std.mem.Allocator) !void {
    var c = shop.open();
    defer c.close();
    const total = try c.sum(3);
    shop.report(total);
    std.debug.print("// not a comment {}", .{total});
}

fn viaParam(cart: *shop.Basket, n: u32) void {
    cart.add(n);
    _ = cart.items().first();
}

fn direct() void {
    var k = Cart.init();
    k.close();
}

fn unrelated(x: std.mem.Allocator) void {
    x.close();
    x.init();
}

test "runs" {
    direct();
    const Helper = struct {
        fn go() void {
            viaParam(null, 1);
        }
    };
    _ = Helper;
}
''',
    "app/shop.zig": '''const cart_mod = @import("lib/cart.zig");
pub const Basket = cart_mod.Cart;

pub fn open() cart_mod.Cart {
    return cart_mod.Cart.init();
}

pub fn report(n: usize) void {
    if (n == 0) return;
    for (0..n) |i| {
        while (i > 3) {}
    }
}
''',
    "app/lib/cart.zig": '''const shop = @import("../shop.zig");
/// A cart.
pub const Cart = struct {
    count: usize,
    const Self = @This();

    pub fn init() Self { return .{ .count = 0 }; }
    pub fn add(self: *Self, n: u32) void { self.count += n; self.check(); }
    pub fn sum(self: Self, n: usize) !usize { return self.count * n; }
    pub fn items(self: *Self) List { return .{}; }
    pub fn close(self: *Self) void { _ = self; }
    fn check(self: *Self) void { _ = self; }
};
pub const List = struct {
    pub fn first(self: List) u8 { _ = self; return 0; }
};
pub fn Generic(comptime T: type) type {
    return union(enum) { a: T, b: void, pub fn size(self: @This()) usize { _ = self; return other(); } };
}
fn other() usize { return 1; }
pub const Oops = error{ Bad, Worse };
pub const packed_thing = packed struct { x: u1 };
const limit: usize = 9;
pub var counter: u32 = 0;
const chosen = if (true) struct {} else struct {};
pub extern "c" fn outside(fd: c_int) isize;
''',
}


@pytest.fixture(scope="module")
def graph(spark):
    g = I.index_texts(spark, FILES)
    nodes = {r["id"]: r for r in g.nodes.collect()}
    edges = g.edges.collect()
    return nodes, edges


def name(nodes, i):
    return nodes[i]["name"]


def triples(graph):
    nodes, edges = graph
    return {(name(nodes, e["source_id"]), e["edge_type"], name(nodes, e["target_id"])) for e in edges}


@pytest.mark.parametrize("edge", [
    ("main.zig", "imports", "shop.zig"), ("main.zig", "imports", "cart.zig"), ("shop.zig", "imports", "cart.zig"), ("cart.zig", "imports", "shop.zig"), ("main.zig", "imports", "std"),
    ("run", "calls", "open"), ("run", "calls", "close"), ("run", "calls", "sum"), ("run", "calls", "report"), ("open", "calls", "init"), ("open", "uses_type", "Cart"), ("direct", "calls", "init"), ("runs", "calls", "direct"),
    ("add", "calls", "check"), ("go", "calls", "viaParam"), ("size", "calls", "other"), ("viaParam", "uses_type", "Basket"), ("run", "uses_type", "Allocator"), ("unrelated", "uses_type", "Allocator"), ("items", "uses_type", "List"),
])
def test_edges_that_must_be(graph, edge):
    assert edge in triples(graph)


@pytest.mark.parametrize("edge", [("unrelated", "calls", "close"), ("unrelated", "calls", "init"), ("runs", "calls", "viaParam"), ("main.zig", "imports", "main.zig"), ("Generic", "uses_type", "Generic"), ("run", "uses_type", "print")])
def test_edges_that_must_not_be(graph, edge):
    assert edge not in triples(graph)


def test_nodes(graph):
    nodes, edges = graph
    by = {(r["name"], r["kind"]): r for r in nodes.values()}
    assert by["Generic", "union_def"]["signature"] == "pub fn Generic(comptime T: type) type"
    assert by["Oops", "error_def"]["signature"] == "error{ Bad, Worse }"
    assert by["packed_thing", "type_def"]["lang_meta"]["is_packed"] and by["limit", "constant"]["lang_meta"]["is_comptime"]
    assert by["counter", "constant"]["lang_meta"]["is_mutable"] and by["chosen", "constant"]["lang_meta"]["comptime_conditional"]
    assert by["outside", "function"]["lang_meta"]["calling_convention"] == "c" and by["outside", "function"]["lang_meta"]["is_extern"]
    assert by["report", "function"]["metrics"]["complexity"] == 4 and by["report", "function"]["metrics"]["lines"] == 6
    assert by["run", "function"]["doc"] == "/// Runs." and by["main.zig", "file"]["doc"] == "//! Entry."
    assert ("Self", "constant") not in by and by["Helper", "type_def"]["parent_id"] == by["runs", "test_def"]["id"]
    assert by["Cart", "import_decl"]["signature"] == "lib/cart.zig"
    assert len({r["id"] for r in nodes.values()}) == len(nodes) == max(nodes) + 1
    assert all(r["file_path"] and len(r["content_hash"]) == 12 for r in nodes.values() if r["kind"] == "file")
    outer = {r["name"]: r for r in nodes.values() if r["external"]["kind"] == "stdlib"}
    assert set(outer) == {"std", "mem", "Allocator", "debug", "print"}
    assert outer["Allocator"]["kind"] == "type_def" and outer["mem"]["kind"] == "module" and outer["Allocator"]["parent_id"] == outer["mem"]["id"]


def test_edges_are_a_set_with_dense_ids(graph):
    _, edges = graph
    assert sorted(e["edge_id"] for e in edges) == list(range(len(edges)))
    keys = [(e["source_id"], e["target_id"], e["edge_type"]) for e in edges]
    assert len(set(keys)) == len(keys) and all(a != b for a, b, _ in keys)


def test_parity_keeps_edges_to_earlier_files_only(spark, graph):
    g = I.index_texts(spark, FILES, parity=True)
    nodes = {r["id"]: r for r in g.nodes.collect()}
    assert {(name(nodes, e["source_id"]), e["edge_type"], name(nodes, e["target_id"])) for e in g.edges.collect()} <= triples(graph)


@pytest.mark.parametrize("text", ["", "\n", "const", "fn (", "pub fn f( {", "}}}}", "const x = struct { fn g() void { if (", '"open', "test {", "é = 1;", "// only\n//! a\n", "comptime {", "error {", "const a = b.;", "a" * 5000])
def test_any_text_gives_a_file(text):
    p = Parser(text, "d/x.zig").parse()
    assert p.nodes[0].kind == "file" and p.nodes[0].name == "x.zig"
    assert all(n.parent is None or n.parent < n.local for n in p.nodes)


def test_private_reexports_and_aliases():
    p = Parser('const m = @import("m.zig");\nconst A = m.A;\npub const B = m.B;\nconst C = m.D;\n', "x.zig").parse()
    assert [n.name for n in p.nodes[1:]] == ["m", "B", "C"]


def test_comptime_types_move_up_and_blocks_make_no_node():
    p = Parser("comptime {\n const T = struct { a: u8 };\n _ = T;\n}\nconst z = 1;\n", "x.zig").parse()
    assert [(n.name, n.parent) for n in p.nodes[1:]] == [("T", 0), ("a", 1), ("z", 0)]


def test_build_manifest():
    assert dependencies('.{ .name = "x", .dependencies = .{ .abc = .{ .url = "u{", .hash = "h" }, .@"d-e" = .{} }, .paths = .{""} }') == ["abc", "d-e"]
    assert dependencies(".{}") == []


def test_empty_input(spark):
    g = I.index_texts(spark, {"a.zig": ""})
    assert g.nodes.count() == 1 and g.edges.count() == 0
