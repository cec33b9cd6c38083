"""Source texts made of the supplier table by a fixed rule, so that extraction and name resolution can be checked by SQL.

Supplier k is the file src/d(k % 5)/f(k).zig.  From the second on, a file imports that of supplier k // 2, whose key
is less, so there are no cycles; j is that key, and each name ends with the key of its file.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.operators.graph import CodeGraph

TEXT = """//! File @k of the suppliers.
const std = @import("std");
const dep@k = @import("../d@m/f@j.zig");
const Far@k = @import("../d@m/f@j.zig").Box@j;

/// A box of size @s.
pub const Box@k = struct {
    size: u32 = @s,
    next: ?*Box@k,

    pub fn init() Box@k {
        return .{ .size = @s, .next = null };
    }

    pub fn grow(self: *Box@k, by: u32) void {
        if (self.size > by) tune@k(by);
        while (self.size < by) self.size += 1;
    }
};

pub const Kind@k = enum { one, two };
pub const Value@k = union(enum) { a: u32, b: f32 };
const Failure@k = error{Broken};
const limit@k: u32 = 10;

inline fn tune@k(by: u32) void {
    _ = by;
    dep@k.run@j();
}

pub fn run@k() void {
    const b = dep@k.Box@j.init();
    b.grow(2);
    const own = Box@k.init();
    own.grow(1);
    tune@k(limit@k);
    const list: std.ArrayList(u8) = undefined;
    std.debug.print("x", .{});
}

fn kinds@k(v: Value@k, far: Far@k) Kind@k {
    return switch (v) {
        .a => .one,
        .b => .two,
    };
}

test "run @k" {
    run@k();
}
"""
_GRAPHS: dict[tuple[str, str], CodeGraph] = {}


def files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(rel_path, content), written and hashed in many tasks however few parts the table has."""
    from graphloom.plans.index import spread

    k = F.col("s_suppkey").cast("long")
    j = F.floor(k / 2)
    text = F.lit(TEXT)
    for mark, value in (("@k", k), ("@m", j % 5), ("@j", j), ("@s", k % 50)):
        text = F.replace(text, F.lit(mark), value.cast("string"))
    path = F.concat(F.lit("src/d"), (k % 5).cast("string"), F.lit("/f"), k.cast("string"), F.lit(".zig"))
    keys = spread(spark.read.parquet(f"{sf_dir}/supplier.parquet").select("s_suppkey"), "s_suppkey")
    return keys.select(path.alias("rel_path"), text.alias("content"))


def graph(spark: SparkSession, sf_dir: str) -> CodeGraph:
    """The graph of files(), indexed once for a session and folder: the tables of the index are written anyway."""
    from graphloom.plans.index import build
    from graphloom.sources.scan import sources_of

    key = (spark.sparkContext.applicationId, sf_dir)
    if key not in _GRAPHS:
        _GRAPHS[key] = build(sources_of(files(spark, sf_dir)))
    return _GRAPHS[key]
