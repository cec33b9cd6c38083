import re

import numpy as np
import pyarrow as pa
import pytest

from graphloom.llm import op01_decontaminate as op
from tests.llm.helpers import docs, edited, prose, rows


def bench(spark, items):
    return spark.createDataFrame([(k, t, "clash") for k, t in items], "item_id long, text string, doc_id string")


def align_slow(a, b):
    h = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    best = 0
    for i, x in enumerate(a, 1):
        for j, y in enumerate(b, 1):
            h[i][j] = max(0, h[i - 1][j - 1] + (2 if x == y else -1), h[i - 1][j] - 1, h[i][j - 1] - 1)
            best = max(best, h[i][j])
    return best


def words(t):
    return re.findall(r"[0-9a-z\u0080-\U0010ffff]+", t.lower())


def test_alignment_is_smith_watermans():
    rng = np.random.default_rng(1)
    items = [rng.integers(0, 6, rng.integers(1, 30)).astype(np.uint64) for _ in range(60)]
    windows = [rng.integers(0, 6, rng.integers(0, 50)).astype(np.uint64) for _ in range(60)]
    assert op.align(items, windows).tolist() == [align_slow(a.tolist(), b.tolist()) for a, b in zip(items, windows)]


def test_copies_are_found_and_the_rest_left_alone(spark):
    items = [(k, prose(1000 + k, 30 + k)) for k in range(6)]
    texts = [prose(k) for k in range(20)]
    texts[3] = prose(50, 40) + " " + items[2][1] + " " + prose(51, 40)
    texts[7] = prose(52, 2000) + "\n" + edited(items[4][1], 0.15).replace(" ", "###\n ") + " " + prose(53, 2000)
    texts[9] = items[0][1].upper()
    found = {(r["doc_id"], r["item_id"]): r["score"] for r in op.leaks(docs(spark, texts), bench(spark, items)).collect()}
    assert found.keys() == {(3, 2), (7, 4), (9, 0)}
    assert found[3, 2] == found[9, 0] == 1.0 and 0.5 <= found[7, 4] < 1
    kept = {r["doc_id"] for r in op.clean(docs(spark, texts), bench(spark, items)).collect()}
    assert kept == set(range(20)) - {3, 7, 9}


def test_scores_agree_with_brute_force(spark):
    """Every document against every item; op may miss only pairs without a seed, which score below the bound."""
    items = [(k, prose(2000 + k, 20)) for k in range(4)]
    texts = [prose(k, 40) + " " + edited(items[k % 4][1], 0.08 * (k % 7), k) + " " + prose(k + 99, 40) for k in range(14)]
    want = {}
    for i, t in enumerate(texts):
        for j, u in items:
            s = align_slow(words(u), words(t)) / (2 * len(words(u)))
            if s >= op.SCORE:
                want[i, j] = round(s, 4)
    got = {(r["doc_id"], r["item_id"]): r["score"] for r in op.leaks(docs(spark, texts), bench(spark, items)).collect()}
    assert got == want


def test_a_passage_in_most_documents_keeps_its_seeds(spark):
    item = prose(7, 25)
    texts = [prose(k, 30) + " " + item for k in range(300)] + [prose(9000)]
    assert op.leaks(docs(spark, texts), bench(spark, [(1, item)])).count() == 300


def test_awkward_rows(spark):
    item = prose(3, 20)
    table = docs(spark, [(1, None), (2, ""), (3, item), (3, item), (None, "x " + item), (4, "..."), (5, "two words"), (6, item + " " + "filler " * 50_000)])
    b = bench(spark, [(1, item), (1, item), (None, item), (2, None), (3, ""), (4, "two words")])
    got = rows(op.leaks(table, b).select("doc_id", "item_id", "score"))
    assert got == sorted([(d, i, 1.0) for d in (3, None, 6) for i in (1, None)] + [(5, 4, 1.0)], key=repr)
    kept = op.clean(table, b)
    assert kept.columns == table.columns and [r[0] for r in rows(kept.select("doc_id"))] == [1, 2, 4]


def test_short_items_match_by_all_of_their_words(spark):
    table = docs(spark, [(1, "see the two words here"), (2, "two other words"), (3, "one"), (4, "no ones"), (5, "the ONE, or so"), (6, "words two")])
    got = rows(op.leaks(table, bench(spark, [(1, "Two words!"), (2, "one")])).select("doc_id", "item_id", "score"))
    assert got == sorted([(1, 1, 1.0), (3, 2, 1.0), (5, 2, 1.0)], key=repr)


def test_a_copy_without_the_rare_words_is_found(spark):
    """18 common words and 3 rare ones, which the copy has changed."""
    common = "the of and to in is that it for was on with as his they at be this".split()
    item = [*common[:6], "zyx", *common[6:12], "wvu", *common[12:], "tsr"]
    copy = ["other" if len(x) == 3 and x in ("zyx", "wvu", "tsr") else x for x in item]
    rest = [" ".join(common[(k + 5 * j) % 18] for j in range(400)) for k in range(40)]
    table = docs(spark, [*rest, (900, prose(1) + " " + " ".join(copy) + " " + prose(2)), (901, "tsr zyx wvu " + prose(3))])
    got = {(r["doc_id"], r["item_id"]): r["score"] for r in op.leaks(table, bench(spark, [(1, " ".join(item))])).collect()}
    assert got == {(900, 1): round(align_slow(item, copy) / 42, 4)} and got[900, 1] > 0.75


def test_memory_does_not_grow_with_repeated_seeds():
    """50 items of two words in turn against a text of nothing else."""
    import tracemalloc

    items = op.Items(list(range(50)), pa.array(["a b " * (8 + k % 5) for k in range(50)]))
    items.seed(np.unique(items.words), np.full(2, 40_000.0), 80_000, op.RATE)
    tracemalloc.start()
    row, item, score = op.best_scores(pa.array(["a b " * 40_000, "b a"]), items)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert sorted(item[row == 0]) == list(range(50)) and (score[row == 0] == 1).all() and peak < 400e6


@pytest.mark.parametrize("hits", [1, 7, 1 << 19])
def test_windows_are_the_union_of_those_around_each_seed(monkeypatch, hits):
    monkeypatch.setattr(op, "_HITS", hits)
    rng = np.random.default_rng(4)
    for trial in range(30):
        texts = [" ".join(rng.choice(list("abcd"), rng.integers(0, 30))) for _ in range(4)]
        units = [" ".join(rng.choice(list("abcde"), rng.integers(0, 9))) for _ in range(3)]
        items = op.Items([0, 1, 2], pa.array(units))
        vocabulary = np.unique(items.words)
        items.seed(vocabulary, np.ones(len(vocabulary)), 100, 1.0)  # every run is a seed
        row, item, score = op.best_scores(pa.array(texts), items)
        got = {(int(r), int(i)): float(s) for r, i, s in zip(row, item, score)}
        for r, t in enumerate(texts):
            for i, u in enumerate(units):
                a, b = words(u), words(t)
                k = min(3, len(a))
                spans = []  # the stretch of the text around each run of words that both have
                for x in range(len(a) - k + 1) if k else ():
                    for y in range(len(b) - k + 1):
                        if a[x : x + k] == b[y : y + k]:
                            spans.append((max(0, y - x - len(a) // 2), y - x + len(a) + len(a) // 2))
                merged = []
                for lo, hi in sorted(spans):
                    if merged and lo <= merged[-1][1]:
                        merged[-1][1] = max(merged[-1][1], hi)
                    else:
                        merged.append([lo, hi])
                want = max((align_slow(a, b[lo:hi]) for lo, hi in merged), default=None)
                assert got.get((r, i)) == (None if want is None else want / (2 * len(a)))


def test_scripts_without_spaces_and_their_signs(spark):
    item = "水の中に住む魚は何ですか。答えを選びなさい"
    copy = "「水の中に住む鳥は何ですか、答えを選びなさい」"
    table = docs(spark, [(1, "前の文。" + copy + "次の文"), (2, "山に住む鳥と花の名前を覚える"), (3, item)])
    got = {r["doc_id"]: r["score"] for r in op.leaks(table, bench(spark, [(1, item)])).collect()}
    a, b = list("水の中に住む魚は何ですか答えを選びなさい"), list("水の中に住む鳥は何ですか答えを選びなさい")
    assert got == {1: round(align_slow(a, b) / (2 * len(a)), 4), 3: 1.0}


@pytest.mark.parametrize("texts, items", [([], [(1, "a b c d")]), (["a b c d"], []), ([], [])])
def test_empty_tables(spark, texts, items):
    assert op.leaks(docs(spark, texts), bench(spark, items)).count() == 0
    assert op.clean(docs(spark, texts), bench(spark, items)).count() == len(texts)


def test_a_benchmark_of_many_parts_gives_the_same(spark):
    items = [(k, prose(1000 + k, 30)) for k in range(8)]
    table = docs(spark, [prose(k, 50) + " " + items[k % 8][1] for k in range(24)])
    assert rows(op.leaks(table, bench(spark, items))) == rows(op.leaks(table, bench(spark, items), shard_bytes=400))
