"""A second language, registered for the test alone."""

import os

import pytest
from pyspark.sql import functions as F

from graphloom import languages
from graphloom.checkpoints import shared_dir
from graphloom.plans.index import index_directory, index_texts
from graphloom.sources.scan import build_config
from graphloom.sources.zig import Decl


@pytest.fixture
def toy():
    class Parsed:
        """Lines: def NAME, use PATH, call NAME."""

        def __init__(self, text, path):
            lines = text.split("\n")
            self.nodes, self.events = [Decl(0, None, path.rsplit("/", 1)[-1], "file", 1, len(lines))], []
            caller = 0
            for n, line in enumerate(lines, 1):
                word, _, rest = line.partition(" ")
                if word == "def":
                    caller = len(self.nodes)
                    self.nodes.append(Decl(caller, 0, rest, "function", n, n, public=True, complexity=1))
                elif word == "use":
                    self.nodes.append(Decl(len(self.nodes), 0, rest.split(".")[0], "import_decl", n, n, signature=rest))
                elif word == "call":
                    self.events.append((caller, "call", len(self.events), rest, rest.split("."), 0))

        def std_chains(self):
            return []

    def outside(nodes, parsed, order, first_id):
        calls = parsed.select("rel_path", F.explode("events").alias("e")).where("e.name = 'print'").join(order, "rel_path")
        calls = calls.select((F.col("base") + F.col("e.caller")).alias("caller"))
        one = nodes.sparkSession.range(1).select(F.lit(first_id).cast("long").alias("id"), F.lit("print").alias("name"), F.lit("function").alias("kind"), F.lit(None).cast("long").alias("parent_id"), F.struct(F.lit("stdlib").alias("kind"), F.lit(None).cast("string").alias("version")).alias("external"), F.lit("public").alias("visibility"))
        return one, calls.select("caller", F.lit(first_id).cast("long").alias("target"), F.lit("calls").alias("edge_type"), F.lit(0).cast("long").alias("sid"))

    language = languages.LanguageSupport(
        "toy",
        (".toy",),
        ("out",),
        ("toy.deps",),
        parse=lambda source, path: Parsed(source, path),
        extract_imports=lambda content: F.regexp_extract_all(content, F.lit(r"(?m)^use (\S+)"), F.lit(1)),
        resolve_import_path=lambda importer, path, limit=None: F.concat(F.lit("lib/"), path),
        parse_build_config=lambda text: text.split(),
        external_symbols=outside,
    )
    languages.register(language)
    yield language
    languages.unregister(language)


def test_a_registered_language_is_indexed(spark, tmp_path, toy):
    for path, text in {"a.toy": "use b.toy\ndef main\ncall b.run\ncall helper\ncall print\ndef helper", "lib/b.toy": "def run", "out/c.toy": "def no", "z.zig": "fn f() void {}", "toy.deps": "one two"}.items():
        (tmp_path / path).parent.mkdir(exist_ok=True)
        (tmp_path / path).write_text(text)
    g, result = index_directory(spark, str(tmp_path))
    assert result.files_indexed == 3
    names = {r["id"]: r["name"] for r in g.nodes.collect()}
    kinds = {(r["name"], r["language"]) for r in g.nodes.collect()}
    assert {("main", "toy"), ("f", "zig"), ("print", "toy")} <= kinds
    edges = {(names[r["source_id"]], names[r["target_id"]], r["edge_type"]) for r in g.edges.collect()}
    assert edges == {("a.toy", "b.toy", "imports"), ("main", "helper", "calls"), ("main", "run", "calls"), ("main", "print", "calls")}
    assert build_config(spark, str(tmp_path)) == ["one", "two"]


def test_only_the_graph_stays_of_the_tables_written(spark):
    folder = f"{shared_dir(spark).removeprefix('file://')}/graphloom/{spark.sparkContext.applicationId}"
    before = set(os.listdir(folder)) if os.path.exists(folder) else set()
    g = index_texts(spark, {"a.zig": 'const b = @import("b.zig");\npub fn f() void {\n    b.g();\n}\n', "b.zig": "pub fn g() void {}\n"})
    assert len(set(os.listdir(folder)) - before) == 2
    assert (g.node_count(), g.edge_count()) == (5, 2)


def test_a_manifest_is_read(spark, tmp_path):
    assert build_config(spark, str(tmp_path)) == []
    (tmp_path / "build.zig.zon").write_text('.{ .dependencies = .{ .one = .{ .url = "x" }, .@"two-b" = .{} } }')
    assert build_config(spark, str(tmp_path)) == ["one", "two-b"]


def test_limits_hold_with_parity_only(spark):
    """40 imports, each called once, and a function of 20 parameters, each called on."""
    texts = {f"m{k:02}.zig": f"pub const T{k:02} = struct {{ pub fn go(self: T{k:02}) void {{ _ = self; }} }};\npub fn run{k:02}() void {{}}\n" for k in range(40)}
    imports = "".join(f'const m{k:02} = @import("m{k:02}.zig");\n' for k in range(40))
    calls = "".join(f"    m{k:02}.run{k:02}();\n" for k in range(40))
    params = ", ".join(f"p{k:02}: m{k:02}.T{k:02}" for k in range(20))
    texts["main.zig"] = f"{imports}fn all() void {{\n{calls}}}\nfn each({params}) void {{\n" + "".join(f"    p{k:02}.go();\n" for k in range(20)) + "}\n"

    def called(parity):
        g = index_texts(spark, texts, parity)
        ids = {r["id"]: r["name"] for r in g.nodes.where("kind = 'function'").collect()}
        calls = [(ids[r["source_id"]], ids[r["target_id"]]) for r in g.edges.where("edge_type = 'calls'").collect()]
        return sum(s == "all" for s, _ in calls), sum(s == "each" for s, _ in calls)

    assert called(False) == (40, 20) and called(True) == (32, 16)
