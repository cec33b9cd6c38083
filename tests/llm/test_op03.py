import math
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given as given_
from hypothesis import settings
from hypothesis import strategies as st

from graphloom.llm import op03_quality as op
from graphloom.llm import textbytes as tb
from graphloom.llm import trees
from tests.llm.helpers import docs, prose, rows


def corpus(n, start=0):
    texts, quality, toxic = [], [], []
    for k in range(start, start + n):
        t, q, x = prose(k, 40 + k % 60), 1, 0
        if k % 3 == 1:
            t, q = "!! ".join(t.upper().split()) if k % 2 else " | ".join(t.split()), 0
        if k % 5 == 2:
            w = t.split()
            w[k % len(w)] = ["scumword", "vileword"][k % 2]
            t, x = " ".join(w), 1
        texts.append(t)
        quality.append(q)
        toxic.append(x)
    return texts, np.array(quality), np.array(toxic)


def test_held_out_accuracy():
    texts, q, x = corpus(600)
    model = op.Model(pa.array(texts), q, x)
    texts, q, x = corpus(400, 10_000)
    good = (q == 1) & (x == 0)
    kept = model.scores(pa.array(texts)) >= op.KEEP
    assert (kept == good).mean() > 0.97 and kept[good].mean() > 0.97


def test_held_out_accuracy_on_the_tables(spark):
    d = "/root/testdata/sf0.01"
    got = op.sample(spark.read.parquet(f"{d}/documents.parquet"), spark.read.parquet(f"{d}/labels.parquet"))
    texts, q, x = got["_text"].combine_chunks(), got["_q"].to_numpy(), got["_t"].to_numpy()
    model = op.Model(texts[:300], q[:300], x[:300])
    good = (q[300:] == 1) & (x[300:] == 0)
    assert ((model.scores(texts[300:]) >= op.KEEP) == good).mean() > 0.85


def walk(flat, row):
    total = flat.base
    for at in flat.root:
        while flat.left[at] != at:
            at = flat.left[at] if row[flat.feature[at]] <= flat.cut[at] else flat.right[at]
        total += flat.value[at]
    return total


def test_flat_trees_predict_as_walking_them_does():
    rng = np.random.default_rng(0)
    x = rng.normal(size=(500, 5))
    y = (x[:, 0] * x[:, 1] > 0).astype(float)
    for model in (trees.boost(x, y, trees=15), trees.forest(x, y, trees=15)):
        assert np.allclose(model.sums(x[:50]), [walk(model, r) for r in x[:50]])
        assert ((model.sums(x) > (0.5 if model.base == 0 else 0)) == y).mean() > 0.85


def plain_statistics(text, bad_words):
    """The 24 statistics, a byte, a word and a line at a time."""
    raw, low = (text or "").encode(), (text or "").lower()
    size = max(len(raw), 1)
    kind = [0] * 8
    for c in raw:
        c = chr(c)
        k = 7 if c >= "\x80" else 0 if "a" <= c <= "z" else 1 if "A" <= c <= "Z" else 2 if "0" <= c <= "9" else 5 if c == "\n" else 3 if c in "\t\r " else 6 if c in ".," else 4
        kind[k] += 1
    w = re.findall(r"[0-9a-zéß]+", low)
    pairs = list(zip(w, w[1:]))
    lines = low.split("\n")
    lines = [x + "\n" for x in lines[:-1]] + [x for x in lines[-1:] if x]
    some, most = max(len(w), 1), lambda xs: max(Counter(xs).values(), default=0)
    bad = sum(x in bad_words for x in w)
    return [
        math.log1p(size), math.log1p(len(w)), *[k / size for k in kind], kind[1] / max(kind[0] + kind[1], 1), kind[4] / some, raw.count(b"|") / some, raw.count(b"!") / some, len(set(w)) / some, most(w) / some,
        len(set(pairs)) / max(len(w) - 1, 1), most(pairs) / max(len(w) - 1, 1), len(set(lines)) / max(len(lines), 1), most(lines) / max(len(lines), 1), sum(len(x.encode()) >= 12 for x in w) / some, math.log1p(bad), bad / some, kind[2] / some,
    ]


@settings(max_examples=200, deadline=None)
@given_(st.lists(st.none() | st.text(alphabet="abBZ09 .,|!\n\t-éßÉ", max_size=40) | st.just("averyverylongword " * 3), max_size=6))
def test_statistics_equal_plain_ones(texts):
    (s,) = tb.text_slices(pa.array(["b é0"]))
    got = op.statistics(pa.array(texts, pa.string()), tb.Keys(tb.words(s).hash))
    assert np.allclose(got, np.array([plain_statistics(t, {"b", "é0"}) for t in texts]).reshape(-1, op.FEATURES))


def test_the_lexicon_equals_a_plain_count():
    texts, q, x = corpus(300)
    own = [set(t.lower().split()) | set(re.findall(r"[0-9a-z]+", t.lower())) for t in texts]
    docs_with, toxic_with = Counter(w for o in own for w in o), Counter(w for o, b in zip(own, x) if b for w in o)
    want = {w for w, c in docs_with.items() if toxic_with[w] >= 3 and toxic_with[w] > c / 2 and (toxic_with[w] - c * x.mean()) / math.sqrt(c * x.mean()) >= 4 and w.isalnum()}
    (s,) = tb.text_slices(pa.array([" ".join(sorted(want))]))
    assert want and sorted(op.lexicon_of(pa.array(texts), x == 1).sorted) == sorted(tb.words(s).hash)


def test_a_tree_splits_where_trying_every_cut_does():
    rng = np.random.default_rng(2)
    for trial in range(20):
        x, y = rng.integers(0, 12, (60, 3)).astype(float), (rng.random(60) < 0.4).astype(float)
        got = trees.boost(x, y, trees=1, depth=1, rate=1.0)
        p = y.mean()
        g, h = y - p, np.full(60, p * (1 - p))
        score = lambda m: g[m].sum() ** 2 / (h[m].sum() + 1)
        gains = {(f, c): score(x[:, f] <= c) + score(x[:, f] > c) for f in range(3) for c in np.unique(x[:, f]) if min(h[x[:, f] <= c].sum(), h[x[:, f] > c].sum()) >= 2}
        if gains:
            f, c = got.feature[0], got.cut[0]
            assert np.isclose(gains[f, c], max(gains.values()))
            left = x[:, f] <= c
            assert np.isclose(got.value[got.left[0]], g[left].sum() / (h[left].sum() + 1)) and np.isclose(got.value[got.right[0]], g[~left].sum() / (h[~left].sum() + 1))


def test_the_sample_is_bounded_in_rows_and_bytes_and_by_document(spark):
    table = docs(spark, [*["x" * 100] * 30, *[(3, "y" * 100)] * 50, (40, "z" * 10_000)])
    given = labels(spark, [(k, 1, 0, "t") for k in range(30)] + [(40, 0, 0, "t")])
    whole = op.sample(table, given)
    assert whole.num_rows == 31 and {r["_text"][0] for r in whole.to_pylist() if r["_id"] == 3} == {"x"}
    assert op.sample(table, given, rows=7).num_rows == 7
    few = op.sample(table, given, size=1200)
    assert 0 < few.num_rows <= 12 and sum(len(t) for t in few["_text"].to_pylist()) <= 1200


def test_statistics_do_not_depend_on_neighbours():
    texts = [prose(1), "", "A|B !!\n12", "é É", None, prose(2, 3000)]
    none = tb.Keys(np.zeros(0, np.uint64))
    whole = op.statistics(pa.array(texts), none)
    for k, t in enumerate(texts):
        assert np.allclose(whole[k], op.statistics(pa.array([t], pa.string()), none)[0])


def labels(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, quality int, toxic int, text string")


def test_awkward_rows(spark):
    texts, q, x = corpus(200)
    table = docs(spark, [*texts, (7, texts[7]), (None, texts[0]), (900, None), (901, ""), (902, prose(5, 60_000))])
    model = op.train(table, labels(spark, [*[(k, int(q[k]), int(x[k]), "t") for k in range(200)], (3, None, 0, "t"), (None, 1, 0, "t"), (0, 1, 0, "t")]))
    got = rows(op.scored(table, model, 0.0))
    assert len(got) == 205 and all(0 <= s <= 1 for _, s in got)
    assert dict(got)[900] == dict(got)[901]
    kept = op.keep(table, model)
    assert kept.columns == table.columns
    assert rows(kept.select("doc_id")) == [r[:1] for r in rows(op.scored(table, model))]
    assert op.keep(table.limit(0), model).count() == 0


@pytest.mark.parametrize("given", [[], [(0, 1, 0, "t")], [(0, 0, 0, "t"), (1, 0, 1, "t")]])
def test_without_labels_of_both_kinds_everything_stays(spark, given):
    table = docs(spark, ["a b", "c", None])
    assert op.keep(table, op.train(table, labels(spark, given))).count() == 3


def test_a_document_labelled_twice_takes_the_worse_label(spark):
    got = op.sample(docs(spark, ["a"]), labels(spark, [(0, 1, 0, "t"), (0, 0, 1, "t")])).to_pylist()
    assert [(r["_q"], r["_t"]) for r in got] == [(0, 1)]


def test_labels_of_texts_without_words(spark):
    table = docs(spark, ["", "!!", None, "a b c d e f g h"])
    model = op.train(table, labels(spark, [(0, 0, 1, "t"), (1, 0, 1, "t"), (2, 0, 1, "t"), (3, 1, 0, "t")]))
    assert op.scored(table, model, 0.0).count() == 4
    assert len(op.lexicon_of(pa.array(["", "!!"]), np.array([True, True])).sorted) == 0
