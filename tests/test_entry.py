import os
import shutil
import subprocess
import sys

import duckdb
import pytest

import __spark_entry__ as E
from graphloom.plans import catalogue

D = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
REPO = os.path.dirname(os.path.abspath(E.__file__))


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{D}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(set(catalogue.ORACLES) & {"dedup_edges_first_source", "neighbors_both_bag", "degrees_csr", "ancestor_closure", "owning_file", "cross_file_summary_text", "topo_levels", "phantom_kind_first", "qualified_paths", "complexity", "line_slice", "resolve_relative_path", "scoped_lookup_narrowest", "interval_join_first", "render_ids_per_kind", "edge_group_lines", "jsonl_nodes", "append_union_remap", "has_edge", "binary_roundtrip", "return_types", "language_flags", "json_strings", *(n for n in catalogue.ORACLES if n.startswith("zig_")), "ctg_whole_text", "mermaid_whole_text"}))
def test_query_equals_sql(spark, duck, name):
    got = catalogue.QUERIES[name](spark, D)
    columns = sorted(got.columns)
    want = duck.sql(catalogue.ORACLES[name])
    assert columns == sorted(want.columns)
    key = lambda rows: sorted(map(repr, rows))
    assert key(tuple(r) for r in got.select(*columns).collect()) == key(want.select(*[f'"{c}"' for c in columns]).fetchall())


def test_entry(spark):
    assert E.entry(spark).count() > 0
    assert set(E.oracle_sql()) <= set(E.queries())


def test_the_rest_works_without_the_optional_package(tmp_path):
    shutil.copytree(REPO, tmp_path / "r", ignore=shutil.ignore_patterns(".git", "__pycache__"))
    for p in ("graphloom/llm", "tests/llm"):
        shutil.rmtree(tmp_path / "r" / p, ignore_errors=True)
    if (tmp_path / "r/corpus_pipeline.py").exists():
        (tmp_path / "r/corpus_pipeline.py").unlink()
    code = (
        "import __spark_entry__ as e; from pyspark.sql import SparkSession; q = e.queries(); "
        "assert 'cross_file_summary' in q and not [n for n in q if n.startswith('op') or n == 'pipeline'] and set(e.oracle_sql()) <= set(q); "
        "s = SparkSession.builder.master('local[2]').config('spark.ui.enabled', 'false').getOrCreate(); "
        f"assert q['classify_import'](s, {D!r}).count() == s.read.parquet({D + '/part.parquet'!r}).count(); assert e.entry(s).count() > 0"
    )
    out = subprocess.run([sys.executable, "-B", "-c", code], cwd=tmp_path / "r", capture_output=True, text=True, timeout=120, env={**os.environ, "PYTHONPATH": str(tmp_path / "r")})
    assert out.returncode == 0, out.stderr


def test_nothing_else_imports_the_optional_package():
    for folder, _, files in os.walk(f"{REPO}/graphloom"):
        if not folder.startswith(f"{REPO}/graphloom/llm"):
            for f in files:
                if f.endswith(".py"):
                    with open(os.path.join(folder, f)) as source:
                        assert "graphloom.llm" not in source.read(), f
