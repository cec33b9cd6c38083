import itertools

import numpy as np
import pyarrow as pa
import pytest

from graphloom.llm import op10_simhash_dedup as op
from graphloom.llm import simbits
from graphloom.llm.components import components
from tests.llm.helpers import docs, edited, prose, rows


def brute(fp, n, ids, radius=op.RADIUS):
    """{id: least id of its group} by comparing every pair."""
    root = list(range(len(ids)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in itertools.combinations(range(len(ids)), 2):
        if np.bitwise_count(fp[a] ^ fp[b]).sum() <= radius and min(n[a], n[b]) >= op.RATIO * max(n[a], n[b]) - 1e-9:
            x, y = find(a), find(b)
            root[max(x, y)] = min(x, y)
    return {ids[k]: ids[find(k)] for k in range(len(ids))}


def random_prints(n, seed=0):
    """Fingerprints in clusters around each other, and unequal bits."""
    rng = np.random.default_rng(seed)
    centres = (rng.random((max(1, n // 8), 128)) < rng.uniform(0.2, 0.8, 128)).astype(np.uint8)
    bits = centres[rng.integers(0, len(centres), n)] ^ (rng.random((n, 128)) < rng.uniform(0, 0.2, (n, 1)))
    return np.packbits(bits, axis=1).view(np.uint64), rng.integers(80, 130, n)


def planned(fp, radius=op.RADIUS, cell=op.CELL):
    both = op._bits(fp).astype(float)
    order = op.group_bits(both.T @ both, len(fp))
    assert sorted(order) == list(range(128))
    counts = np.stack([np.bincount(v, minlength=1 << op.WIDTH) for v in op.parts(fp, order).T])
    limits = op.allocate(op.pairs_within(counts), radius)
    assert sum(limits) == radius - op.PARTS + 1
    return op.Cells(counts, order, limits, cell)


def joined(fp, n, cells, radius=op.RADIUS):
    """({row: least row of its group}, rows sent, rows of the largest task), by the tasks that rows are sent to."""
    reps = pa.RecordBatch.from_arrays([pa.array(np.arange(len(fp))), *(pa.array(fp[:, k].view(np.int64)) for k in (0, 1)), pa.array(n.astype(np.int32))], names=["rep", "f1", "f2", "n"])
    sent = pa.Table.from_batches(cells.send([reps]))
    sent = pa.Table.from_batches(cells.send([reps])).sort_by("task")
    label, cuts = np.arange(len(fp)), np.flatnonzero(np.diff(sent["task"].to_numpy(), prepend=-1, append=-1))
    for a, b in zip(cuts[:-1], cuts[1:]):
        edges = cells.search(radius)(sent.slice(a, b - a))
        assert edges.num_rows < b - a
        op._settle(label, edges["a"].to_numpy(), edges["b"].to_numpy())
    return {k: int(v) for k, v in enumerate(label)}, sent.num_rows, int(np.diff(cuts).max())


@pytest.mark.parametrize("cell", [op.CELL, 200, 60])
@pytest.mark.parametrize("heavy", [1, op.HEAVY])
@pytest.mark.parametrize("seed", range(3))
def test_probing_finds_every_pair(monkeypatch, seed, heavy, cell):
    monkeypatch.setattr(op, "HEAVY", heavy)
    fp, n = random_prints(220, seed)
    got, _, _ = joined(fp, n, planned(fp, cell=cell))
    want = brute(fp, n, list(range(len(fp))))
    assert got == want and len(set(want.values())) < len(fp)


@pytest.mark.parametrize("rows, cell, bits", [(500, 48, 7), (30, 1, op.WIDTH)])
def test_few_rows_take_the_path_of_any_number(rows, cell, bits):
    """Leading bits, at last all of them, and chunks of a hot group that holds a third, as a table of any size would have."""
    rng = np.random.default_rng(5)
    fp, n = random_prints(rows, 5)
    hot = np.unpackbits(fp[:1].view(np.uint8), axis=1) ^ (rng.random((rows // 3, 128)) < 0.03)
    fp[: rows // 3] = np.packbits(hot, axis=1).view(np.uint64)
    n[: rows // 3] = 100
    cells = planned(fp, cell=cell)
    if bits == op.WIDTH:
        cells.bits, cells.chunks = bits, {p: np.full(1 << bits, 2) for p in cells.chunks}
    assert cells.bits >= bits and max(c.max() for c in cells.chunks.values()) > 1
    got, _, largest = joined(fp, n, cells)
    assert got == brute(fp, n, list(range(len(fp)))) and largest < 200


def test_rows_sent_are_in_proportion_to_rows():
    """With as many leading bits as there are, twice the rows are sent twice, and a row no more than 8 x 69 times."""
    sent = []
    for k in (2000, 4000):
        fp = np.random.default_rng(8).integers(0, 1 << 63, (k, 2)).astype(np.uint64)
        cells = planned(fp, cell=64)
        cells.bits, cells.chunks = op.WIDTH, {p: np.ones(1 << op.WIDTH, np.int64) for p in cells.chunks}
        reps = pa.RecordBatch.from_arrays([pa.array(np.arange(k)), *(pa.array(fp[:, j].view(np.int64)) for j in (0, 1)), pa.array(np.full(k, 9, np.int32))], names=["rep", "f1", "f2", "n"])
        sent.append(sum(b.num_rows for b in cells.send([reps])))
    assert sent[0] <= 2000 * op.PARTS * 69 and abs(sent[1] / sent[0] - 2) < 0.05


def test_pair_counts_and_thresholds_are_the_best():
    fp, _ = random_prints(150, 9)
    v = op.parts(fp, np.arange(128))
    within = op.pairs_within(np.stack([np.bincount(c, minlength=1 << op.WIDTH) for c in v.T]))
    for p in range(op.PARTS):
        d = np.bitwise_count(v[:, p, None] ^ v[None, :, p])
        assert np.allclose(within[p], [(d <= t).sum() for t in range(op.WIDTH + 1)])
    probes = np.cumsum([op._choose(op.WIDTH, d) for d in range(op.WIDTH + 1)])
    cost = lambda ts: sum(0 if t < 0 else within[p][t] + probes[t] * 256.0 for p, t in enumerate(ts))
    small = 8  # few enough to try every allocation
    best = min((ts for ts in itertools.product(range(-1, 2), repeat=op.PARTS) if sum(ts) == small - op.PARTS + 1), key=cost)
    got = op.allocate(within, small)
    assert sum(got) == small - op.PARTS + 1 and cost(got) <= cost(best)


def test_correlated_bits_share_a_partition():
    rng = np.random.default_rng(3)
    base = rng.random((4000, 8)) < 0.5
    bits = np.repeat(base, 16, axis=1)[:, rng.permutation(128)] ^ (rng.random((4000, 128)) < 0.1)
    order = op.group_bits((bits.T.astype(float) @ bits), 4000)
    for k in range(8):
        own = bits[:, order[k * 16 : k * 16 + 16]].astype(float)
        assert np.corrcoef(own.T).__abs__().min() > 0.4


def want_of(spark, table):
    s = op.sketches(table).toPandas()
    fp = np.stack([s["f1"].to_numpy().view(np.uint64), s["f2"].to_numpy().view(np.uint64)], axis=1)
    order = s["doc_id"].argsort(kind="stable")
    ids = s["doc_id"].to_numpy()[order].tolist()
    return {(a, b) for a, b in brute(fp[order], s["n"].to_numpy()[order], ids).items() if a != b}


def test_groups_equal_brute_force_and_cells_do_not_matter(spark):
    texts = []
    for k in range(12):
        base = prose(k, 60 + 40 * (k % 4))
        texts += [base, base, edited(base, 0.02, k), edited(base, 0.06, k + 1), prose(500 + k, 90)]
    table = docs(spark, texts, first=100)
    got = {(r["doc_id"], r["duplicate_of"]) for r in op.duplicates(table).collect()}
    assert got == want_of(spark, table) and len(got) > 24
    assert {(r["doc_id"], r["duplicate_of"]) for r in op.duplicates(table, cell=60).collect()} == got
    near = {(105 * 0 + 100 + 5 * k + j, 100 + 5 * k) for k in range(12) for j in (1, 2)}
    assert near <= got


def test_recall_of_light_edits_and_no_clean_document_goes(spark):
    texts = [prose(k, 300) for k in range(40)]
    copies = [(1000 + k, edited(t, 0.01 + 0.04 * k / 40, k)) for k, t in enumerate(texts)]
    shared = prose(77, 60)
    clean = [(2000 + k, prose(3000 + k, 150) + " " + shared + " " + prose(4000 + k, 150)) for k in range(40)]
    got = {r["doc_id"]: r["duplicate_of"] for r in op.duplicates(docs(spark, [*texts, *copies, *clean])).collect()}
    assert sum(got.get(1000 + k) == k for k in range(40)) >= 38
    assert not [k for k in got if k < 1000 or k >= 2000]


def test_awkward_rows(spark):
    base = prose(1, 100)
    texts = [(1, base), (2, base), (2, base), (None, base), (4, None), (5, None), (6, ""), (7, ""), (8, "..."), (9, "!!!"), (10, "..."), (11, prose(2, 50_000)), (12, prose(2, 50_000)), (13, "one"), (14, "One!")]
    table = docs(spark, texts)
    got = {(r["doc_id"], r["duplicate_of"]): r["group_size"] for r in op.duplicates(table).collect()}
    assert got == {(2, 1): 2, (7, 6): 2, (10, 8): 2, (12, 11): 2, (14, 13): 2}
    kept = op.stage(spark, table, "")
    assert kept.columns == table.columns
    assert [r[0] for r in rows(kept.select("doc_id"))] == sorted([1, None, 4, 5, 6, 8, 9, 11, 13], key=lambda x: repr((x,)))


def test_one_doc_id_with_two_texts_links_their_groups(spark):
    a, b = prose(1), prose(2)
    got = {(r["doc_id"], r["duplicate_of"]) for r in op.duplicates(docs(spark, [(1, a), (2, a), (2, b), (3, b), (9, prose(5))])).collect()}
    assert got == {(2, 1), (3, 1)}


def test_empty_table(spark):
    assert op.duplicates(docs(spark, [])).count() == 0
    assert op.stage(spark, docs(spark, []), "").count() == 0
    assert op.duplicates(docs(spark, ["", None])).count() == 0


def test_fingerprints_do_not_depend_on_neighbours():
    texts = [prose(1), "", "a b a", None, prose(2, 30_000), "é"]
    fp, n = simbits.fingerprints(pa.array(texts))
    for k, t in enumerate(texts):
        f, m = simbits.fingerprints(pa.array([t], pa.string()))
        assert (f[0] == fp[k]).all() and m[0] == n[k]
    assert n[2] == 2


def test_components(spark):
    edges = [(1, 2), (2, 3), (3, 3), (10, 11), (11, 12), (12, 13), (13, 14), (20, 10), (None, 5), (2, 1)]
    got = rows(components(spark.createDataFrame(edges, "a long, b long")))
    assert got == sorted([(2, 1), (3, 1), (11, 10), (12, 10), (13, 10), (14, 10), (20, 10)], key=repr)
    assert rows(components(spark.createDataFrame([], "a long, b long"))) == []
    chain = [(k, k + 1) for k in range(200)]
    assert rows(components(spark.createDataFrame(chain, "a long, b long"))) == sorted([(k, 0) for k in range(1, 201)], key=repr)
