import pytest

from graphloom import cli, logs
from graphloom.languages import by_extension
from graphloom.plans.index import index_directory
from graphloom.sources.scan import read_text, scan_directory
from graphloom.streaming import incremental


@pytest.fixture
def project(tmp_path):
    root = tmp_path / "p"
    for path, text in {"a.zig": 'const b = @import("lib/b.zig");\npub fn f() void { b.g(); }\n', "lib/b.zig": "pub fn g() void {}\n", "zig-out/c.zig": "fn no() void {}", "skip/d.zig": "fn no() void {}", "notes.txt": "x", "empty.zig": ""}.items():
        (root / path).parent.mkdir(parents=True, exist_ok=True)
        (root / path).write_text(text)
    return root


def names(g):
    return sorted(r["file_path"] for r in g.nodes.where("kind = 'file'").collect())


def test_scan(spark, project):
    got = {r["rel_path"]: r for r in scan_directory(spark, str(project), ("skip",)).collect()}
    assert set(got) == {"a.zig", "lib/b.zig", "empty.zig"} and got["lib/b.zig"]["basename"] == "b.zig" and len(got["a.zig"]["content_hash"]) == 12
    assert set(r["rel_path"] for r in scan_directory(spark, str(project), ("lib/b.zig", "d.zig")).collect()) == {"a.zig", "empty.zig"}


def test_a_file_beyond_the_limit_is_an_error(spark, project, monkeypatch):
    from graphloom.plans import index

    monkeypatch.setattr(index, "MAX_FILE", 30)
    assert index_directory(spark, str(project), ("skip",))[1].files_errored == 0  # the limit is one of parity
    g, result = index_directory(spark, str(project), ("skip",), parity=True)
    assert (result.files_indexed, result.files_errored) == (2, 1) and names(g) == ["empty.zig", "lib/b.zig"]


def test_index_and_index_again(spark, project):
    g, result = index_directory(spark, str(project), ("skip",))
    assert (result.files_indexed, result.files_skipped) == (3, 0) and g.edges.where("edge_type = 'calls'").count() == 1
    same, result = index_directory(spark, str(project), ("skip",), previous=g)
    assert (result.files_indexed, result.files_skipped) == (0, 3) and same is g
    (project / "lib/b.zig").write_text("pub fn h() void {}\n")
    new, result = index_directory(spark, str(project), ("skip",), previous=g)
    assert (result.files_indexed, result.files_skipped) == (1, 2) and new.edges.where("edge_type = 'calls'").count() == 0


def test_incremental_state(spark, project, tmp_path):
    state = str(tmp_path / "state")
    g, result = incremental.index_incrementally(spark, str(project), state, ("skip",))
    assert result.files_indexed == 3 and names(g) == ["a.zig", "empty.zig", "lib/b.zig"]
    (project / "a.zig").unlink()
    (project / "lib/b.zig").write_text("pub fn g() void { k(); }\nfn k() void {}\n")
    g, result = incremental.index_incrementally(spark, str(project), state, ("skip",))
    assert (result.files_indexed, result.files_skipped) == (1, 1) and names(g) == ["empty.zig", "lib/b.zig"] and g.edges.where("edge_type = 'calls'").count() == 1


def test_stream(spark, project, tmp_path):
    state, check = str(tmp_path / "state"), str(tmp_path / "check")
    incremental.watch(spark, str(project), state, check).awaitTermination(120)
    assert incremental.parsed_state(spark, state).count() == 3
    (project / "new.zig").write_text("fn n() void {}\n")
    incremental.watch(spark, str(project), state, check).awaitTermination(120)
    assert {r["rel_path"] for r in incremental.parsed_state(spark, state).collect()} == {"a.zig", "lib/b.zig", "skip/d.zig", "new.zig"}


def test_read_text(spark, project):
    assert read_text(spark, str(project / "lib/b.zig")).first()["value"] == "pub fn g() void {}\n"


def test_command_line(spark, project, capsys):
    assert cli.main(["render-graph", str(project), "--exclude", "skip", "--name", "demo", "--timestamp", "T"]) == 0
    out = capsys.readouterr().out
    assert out.startswith("# graphloom graph -- demo\n# 3 files, 2 functions") and "fn:1 calls fn:2" in out
    assert cli.main(["parse-directory", str(project), "--exclude", "skip"]) == 0
    assert "a.zig -> lib/b.zig: calls(1),imports(1)" in capsys.readouterr().out
    assert cli.main(["render-graph", str(project), "--format", "mermaid"]) == 0 and "flowchart TB" in capsys.readouterr().out
    assert cli.main(["parse-file", str(project / "a.zig")]) == 0 and "function f" in capsys.readouterr().out
    assert cli.main(["dump-tokens", str(project / "a.zig")]) == 0 and "'@import'" in capsys.readouterr().out
    assert cli.main([]) == 0


def test_registry_and_logging(capsys):
    assert by_extension(".zig").name == "zig" and by_extension(".rs") is None
    log = logs.logger("t", "debug", logs.stderr("debug"))
    logs.log(log, "debug", "hello", n=1, ok=True)
    logs.log(log, "trace", "never")
    err = capsys.readouterr().err
    assert err.endswith("debug [t] hello n=1 ok=true\n") and "never" not in err
    assert [logs.by_verbosity(k) for k in (0, 1, 2, 9)] == ["warn", "info", "debug", "trace"]
