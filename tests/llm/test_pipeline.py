import numpy as np
import pyarrow as pa
import pytest

import corpus_pipeline
from graphloom.llm import op01_decontaminate, op03_quality, op07_secrets, op10_simhash_dedup
from tests.llm.helpers import edited, prose
from tests.llm.test_op01 import align_slow, words
from tests.llm.test_op03 import corpus
from tests.llm.test_op04_op09 import ENC
from tests.llm.test_op10 import brute

COLUMNS = "doc_id long, text string, lang string, source string, n_chars long"
KEY = "9f86d081884c7d659a2feaa0c55ad015a3bf4f1b"


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    d = str(tmp_path_factory.mktemp("sf"))
    texts, q, x = corpus(160)
    items = [prose(7000 + k, 30) for k in range(3)]
    rows = [(k, t) for k, t in enumerate(texts)]
    rows += [(500 + k, t) for k, t in enumerate([texts[0], texts[0], edited(texts[3], 0.02), prose(81, 150) + " " + items[1] + " " + prose(82, 150), items[0], f'{prose(83, 90)} token = "{KEY}" {prose(84, 90)}', "", ""])]
    rows += [(None, prose(85, 100)), (600, None), (9, texts[9]), (700, prose(86, 20_000))]
    spark.createDataFrame([(i, t, "en", "src1", None if t is None else len(t)) for i, t in rows], COLUMNS).write.parquet(f"{d}/documents.parquet")
    spark.createDataFrame([(k, int(q[k]), int(x[k])) for k in range(160)], "doc_id long, quality int, toxic int").write.parquet(f"{d}/labels.parquet")
    spark.createDataFrame(list(enumerate(items)), "item_id long, text string").write.parquet(f"{d}/benchmark.parquet")
    return d, rows, items


def slow(spark, d, rows, items):
    docs = spark.read.parquet(f"{d}/documents.parquet")
    model = op03_quality.train(docs, spark.read.parquet(f"{d}/labels.parquet"))
    scores = [float(model.scores(pa.array([t], pa.string()))[0]) for _, t in rows]
    rows = [r for r, s in zip(rows, scores) if s >= op03_quality.KEEP]
    table = pa.RecordBatch.from_pydict({"doc_id": pa.array([i for i, _ in rows], pa.int64()), "text": pa.array([t for _, t in rows], pa.string())})
    (s,) = list(op10_simhash_dedup.sketch_batches([table]))
    ids, fp = s["doc_id"].to_pylist(), op10_simhash_dedup._fps({c: s[c].to_numpy() for c in ("f1", "f2")})
    by = np.argsort(ids, kind="stable")
    stays = brute(fp[by], s["n"].to_numpy()[by], [ids[k] for k in by])
    rows = [(i, t) for i, t in rows if i is None or t is None or stays[i] == i]
    leak = lambda t: any(2 * len(words(u)) * op01_decontaminate.SCORE <= align_slow(words(u), words(t or "")) for u in items)
    rows = [(i, t) for i, t in rows if t is None or not leak(t)]
    rows = [(i, None if t is None else t.replace(KEY, "[SECRET]")) for i, t in rows]
    return sorted(((i, None if t is None else ENC.encode_ordinary(t)) for i, t in rows), key=repr)


def test_pipeline_equals_brute_force(spark, folder):
    d, rows, items = folder
    got = corpus_pipeline.run(spark, d)
    assert got.columns == ["doc_id", "tokens", "n_tokens"]
    got = sorted(((r["doc_id"], r["tokens"]) for r in got.collect()), key=repr)
    assert got == slow(spark, d, rows, items)
    ids = [i for i, _ in got]
    assert None in ids and 600 in ids and 503 not in ids and 504 not in ids and 500 not in ids and ids.count(9) in (0, 2)


def test_stages_keep_the_columns_and_hold_on_nothing(spark, folder):
    d, *_ = folder
    docs = spark.read.parquet(f"{d}/documents.parquet")
    extra = docs.selectExpr("*", "1 as score", "'x' as rep", "2.0 as _gone", "true as text_")
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality", "near_duplicates", "decontaminate", "secrets", "tokens"]
    for name, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, extra, d).columns == extra.columns, name
        assert stage(spark, extra.limit(0), d).count() == 0, name
    assert corpus_pipeline.STAGES[-1][1](spark, extra.limit(0), d).count() == 0


def test_secrets_are_marked_and_counted(spark, folder):
    d, *_ = folder
    docs = spark.read.parquet(f"{d}/documents.parquet").where("doc_id = 505")
    (r,) = dict(corpus_pipeline.STAGES)["secrets"](spark, docs, d).collect()
    assert KEY not in r["text"] and "[SECRET]" in r["text"] and r["n_chars"] == len(r["text"])
    assert op07_secrets.MARK == b"[SECRET]"
