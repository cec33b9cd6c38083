import numpy as np
import pytest
from pyspark.sql import functions as F

from graphloom.llm import op05_kd_shards as op
from tests.llm.helpers import docs, prose, rows


def brute(points, target, whole):
    """Leaves by the definition: {path: set of rows}."""
    out = {}

    def split(path, own):
        total = sum(points[i][1] for i in own)
        spans = [(max(points[i][0][d] for i in own) - min(points[i][0][d] for i in own)) / max(whole[d], 1) for d in range(4)]
        if total <= target or max(spans) == 0:
            out[path] = own
            return
        d = spans.index(max(spans))
        values = sorted({points[i][0][d] for i in own})
        at = next(v for v in values if 2 * sum(points[i][1] for i in own if points[i][0][d] <= v) >= total)
        if at == values[-1]:
            at = values[-2]
        split(path + "0", [i for i in own if points[i][0][d] <= at])
        split(path + "1", [i for i in own if points[i][0][d] > at])

    split("r", list(range(len(points))))
    return out


def table(spark):
    texts = [prose(k, 5 + k * 7 % 90) for k in range(80)]
    return docs(spark, [*texts, (5, texts[5]), (5, texts[5]), (None, "no id"), (200, None), (201, ""), (202, prose(9, 5000))])


@pytest.mark.parametrize("bins", [op.BINS, 3])
def test_equals_the_definition(spark, monkeypatch, bins):
    monkeypatch.setattr(op, "BINS", bins)
    t = table(spark)
    pts = [((r["d0"], r["d1"], r["d2"], r["d3"]), r["w"]) for r in op.points(t).collect()]
    ids = [r["doc_id"] for r in op.points(t).collect()]
    whole = [max(p[0][d] for p in pts) - min(p[0][d] for p in pts) for d in range(4)]
    want = sorted(((ids[i], path) for path, own in brute(pts, 9000, whole).items() for i in own), key=repr)
    got = op.shards(t, target=9000)
    assert rows(got.select("doc_id", "shard")) == want
    assert got.agg({"n_bytes": "sum"}).first()[0] == sum(p[1] for p in pts)


def test_leaves_hold_the_target_unless_rows_are_alike(spark):
    same = docs(spark, []).unionByName(docs(spark, [(1, "x" * 500)] * 10))
    same = same.withColumn("lang", same["node"]).withColumn("source", same["node"])
    assert {r["shard"] for r in op.shards(same, target=600).collect()} == {"r"}
    sizes = op.shards(table(spark), target=50_000).groupBy("shard").sum("n_bytes").collect()
    assert max(r[1] for r in sizes) <= 50_000


def test_empty_and_missing_columns(spark):
    assert op.shards(docs(spark, [])).count() == 0
    only = spark.createDataFrame([(k, "t" * 100) for k in range(20)], "doc_id long, text string")
    assert op.shards(only, target=500).select("shard").distinct().count() >= 4


def test_ids_that_are_no_numbers(spark):
    t = table(spark).withColumn("doc_id", F.concat(F.lit("id-"), "doc_id"))
    got = op.shards(t, target=3000)
    assert got.count() == t.count() and got.schema["doc_id"].dataType.simpleString() == "string"
    assert got.select("shard").distinct().count() > 4


def test_the_documents_of_the_tables_are_split_by_distributed_medians(spark):
    """All of sf0.01, with a target that it exceeds, against the definition on arrays."""
    t = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    got = op.points(t).toPandas()
    x, w = got[list(op.DIMS)].to_numpy(), got["w"].to_numpy()
    whole, want = x.max(axis=0) - x.min(axis=0), {}

    def split(path, own):
        d = int(op.widest(x[own].min(axis=0)[None], x[own].max(axis=0)[None], whole)[0])
        if w[own].sum() <= 200_000 or d < 0:
            want.update((int(got["doc_id"][i]), path) for i in own)
            return
        by = own[np.argsort(x[own, d], kind="stable")]
        v = x[by, d]
        at = v[np.searchsorted(np.cumsum(w[by]), -(-w[own].sum() // 2))]
        at = v[np.searchsorted(v, at) - 1] if at == v[-1] else at
        split(path + "0", own[x[own, d] <= at])
        split(path + "1", own[x[own, d] > at])

    split("r", np.arange(len(w)))
    assert len(set(want.values())) > 8
    assert {r["doc_id"]: r["shard"] for r in op.shards(t, target=200_000).collect()} == want


def test_widest_dimension():
    assert op.widest(np.array([[0, 0]]), np.array([[10, 10]]), np.array([100, 20])).tolist() == [1]
    assert op.widest(np.array([[1, 2]]), np.array([[1, 2]]), np.array([9, 9])).tolist() == [-1]
