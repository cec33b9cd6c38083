import posixpath

import pytest
from pyspark.sql import functions as F

from graphloom.functions import text as T


def value(spark, expr, **columns):
    df = spark.createDataFrame([tuple(columns.values())], ", ".join(f"{k} {'binary' if isinstance(v, bytes) else 'string'}" for k, v in columns.items()))
    return df.select(expr.alias("x")).first()["x"]


@pytest.mark.parametrize("importer, path, want", [
    ("a/b.zig", "c.zig", "a/c.zig"), ("a/b.zig", "./c.zig", "a/c.zig"), ("main.zig", "u.zig", "u.zig"), ("a/b/c.zig", "../d.zig", "a/d.zig"), ("main.zig", "s/m.zig", "s/m.zig"),
    ("a/b/c/f.zig", "../../r.zig", "a/r.zig"), ("main.zig", "./u.zig", "u.zig"), ("f.zig", "../o.zig", None), ("a/f.zig", "", None), ("a/f.zig", "..", None), ("a/f.zig", "x//y/./z", "a/x/y/z"), ("f.zig", "/".join("a" * 65), "/".join("a" * 65)), ("f.zig", "/".join("a" * 64), "/".join("a" * 64)),
])
def test_resolve_import(spark, importer, path, want):
    assert value(spark, T.resolve_import("i", "p"), i=importer, p=path) == want
    assert value(spark, T.resolve_import("i", "p", 64), i=importer, p=path) == (want if want is None or want.count("/") < 64 else None)
    if want and ".." not in posixpath.normpath(posixpath.join(posixpath.dirname(importer), path)):
        assert want == posixpath.normpath(posixpath.join(posixpath.dirname(importer), path))


@pytest.mark.parametrize("text, lines", [("", 0), ("a", 1), ("a\n", 1), ("a\nb", 2), ("\n\n", 2)])
def test_count_lines(spark, text, lines):
    assert value(spark, T.count_lines("t"), t=text) == lines


@pytest.mark.parametrize("a, b, want", [(1, 1, "a\n"), (2, 3, "b\nc"), (2, 9, "b\nc"), (4, 5, "a\nb\nc"), (1, 2, "a\nb\n")])
def test_line_range(spark, a, b, want):
    assert value(spark, T.line_range("t", a, b), t="a\nb\nc") == want


def test_complexity(spark):
    assert value(spark, T.complexity("t"), t="if (x) for while_ _if switch{} // catch\n orelse 9if") == 5


def test_imports(spark):
    assert value(spark, T.import_paths("t"), t='@import("std") // @import("b.zig")\n@import ("no")') == ["std", "b.zig"]
    assert [value(spark, T.import_kind("p"), p=p) for p in ("std", "builtin", "a.zig", "x")] == ["stdlib", "stdlib", "project_file", "unknown"]


def test_paths_and_scope(spark):
    assert value(spark, T.basename("p"), p="a/b.zig") == "b.zig" and value(spark, T.extension("p"), p="a/b.c.zig") == ".zig" and value(spark, T.extension("p"), p=".zig") == ""
    assert value(spark, T.excluded("p", ["b"]), p="a/b/c") and not value(spark, T.excluded("p", ["b"]), p="a/bb") and value(spark, T.excluded("p", ["a/b"]), p="a/b")
    assert value(spark, T.in_scope("p", "src/"), p="src/x") and value(spark, T.in_scope("p", "src/"), p=None) is False
    assert value(spark, T.has_component("p", "x.zig"), p="a/x.zig")


def test_chains(spark):
    assert value(spark, T.dotted_chains("t"), t="std.mem.A. mystd.x x std.b") == ["std.mem.A", "std.b"]
    assert value(spark, T.return_type("s"), s="fn f(a: u8) !*const m.T") == ["m", "T"]
    assert len(value(spark, T.chain_concat(F.array_repeat("s", 6), F.array_repeat("s", 6), 8), s="x")) == 8
    assert len(value(spark, T.chain_concat(F.array_repeat("s", 6), F.array_repeat("s", 6)), s="x")) == 12
    assert value(spark, T.in_line_comment("s"), s="a // b\n c") is False and value(spark, T.in_line_comment("s"), s="a\n // c")


def test_hashes_and_escapes(spark):
    import json

    import xxhash

    want = xxhash.xxh3_64_intdigest(b"abc").to_bytes(8, "little") + (xxhash.xxh3_64_intdigest(b"abc", 1) & 0xFFFFFFFF).to_bytes(4, "little")
    assert bytes(value(spark, T.content_hash("b"), b=b"abc")) == want and value(spark, T.content_hash("t"), t=None) is None
    assert value(spark, T.hash_text("b"), b=want) == want.hex()
    assert bytes(value(spark, T.hash_bytes("t"), t=want.hex())) == want and value(spark, T.hash_bytes("t"), t="zz") is None
    odd = 'a"b\\c\n\r\t\x01\x1fé'
    got = value(spark, T.json_string("t"), t=odd)
    assert json.loads(got) == odd and "\\u001f" in got
    assert value(spark, T.flow_escape("t"), t='<a & "b">') == "&lt;a & &quot;b&quot;&gt;" and value(spark, T.underscored("t"), t="a.b") == "a_b"
    assert value(spark, T.align8(F.length("t")), t="x" * 9) == 16
    assert value(spark, T.utc_stamp(F.to_timestamp("t")), t="2026-02-14 10:30:00") == "2026-02-14T10:30:00Z"
    assert value(spark, T.line_of_offset("t", 4), t="a\nb\nc") == 3 and value(spark, T.starts_with_keyword("t", "if"), t="if(") and not value(spark, T.starts_with_keyword("t", "if"), t="iffy")
