import base64

import numpy as np
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st

from graphloom.llm import bpe, op06_token_binary as op
from tests.llm.helpers import docs, prose, rows

ENC = tiktoken.Encoding("plain", pat_str=bpe.PATTERN, mergeable_ranks={base64.b64decode(a): int(b) for a, b in map(bytes.split, bpe.read_ranks().splitlines())}, special_tokens={})


def slow(values):
    control, data = bytearray(), bytearray()
    for a in range(0, len(values), 4):
        c = 0
        for k, v in enumerate(values[a : a + 4]):
            n = max(1, (v.bit_length() + 7) // 8)
            c |= (n - 1) << (2 * k)
            data += v.to_bytes(n, "little")
        control.append(c)
    return bytes(control), bytes(data)


@settings(max_examples=200, deadline=None)
@given(st.lists(st.lists(st.integers(0, 2**32 - 1) | st.integers(0, 300), max_size=13), max_size=6))
def test_the_code_is_the_defined_one_and_decodes(lists):
    flat = np.array([v for x in lists for v in x], np.uint32)
    control, data, n_control, n_data = op.pack(flat, np.array([len(x) for x in lists], np.int64))
    c, d = np.cumsum([0, *n_control]), np.cumsum([0, *n_data])
    for k, x in enumerate(lists):
        own_c, own_d = control[c[k] : c[k + 1]], data[d[k] : d[k + 1]]
        assert (own_c.tobytes(), own_d.tobytes()) == slow(x)
        assert op.unpack(own_c, own_d, len(x)).tolist() == x


def test_round_trip_and_order(spark):
    texts = [prose(k, 200) for k in range(10)] + ["", (3, "again again"), (3, "again again"), (None, "no id"), (77, None), (78, prose(5, 30_000))]
    table = docs(spark, texts)
    tokens = op.token_table(table)
    order = op.ranked(tokens)
    plain = [t[1] if isinstance(t, tuple) else t for t in texts]
    count = np.bincount([i for t in plain if t for i in ENC.encode_ordinary(t)])
    assert order.tolist() == sorted(np.flatnonzero(count), key=lambda i: (-count[i], i))
    coded = op.encode(tokens, order)
    got = sorted((None if r["tokens"] is None else ENC.decode(r["tokens"]) for r in op.decode(coded, order).collect()), key=repr)
    assert got == sorted(plain, key=repr)
    gone = [r for r in coded.collect() if r["doc_id"] == 77]
    assert [tuple(r) for r in gone] == [(77, None, None, None)]
    empty = [r for r in coded.collect() if r["doc_id"] == 10]
    assert (empty[0]["n_tokens"], bytes(empty[0]["control"]), bytes(empty[0]["data"])) == (0, b"", b"")


def test_empty_table(spark):
    tokens = op.token_table(docs(spark, []))
    order = op.ranked(tokens)
    assert len(order) == 0 and rows(op.encode(tokens, order)) == [] and rows(op.decode(op.encode(tokens, order), order)) == []


def test_a_table_of_nulls(spark):
    tokens = op.token_table(docs(spark, [(1, None), (2, None)]))
    assert [tuple(r)[1:] for r in op.encode(tokens, op.ranked(tokens)).collect()] == [(None, None, None)] * 2


def test_the_query_holds_what_decoding_needs(spark, tmp_path):
    texts = [prose(k, 200) for k in range(4)] + ["", (4, "again again"), (4, "again again"), (None, "no id"), (77, None)]
    docs(spark, texts).write.parquet(f"{tmp_path}/documents.parquet")
    op.query(spark, str(tmp_path)).write.parquet(f"{tmp_path}/out")
    result = spark.read.parquet(f"{tmp_path}/out")
    coded = result.where("rank IS NULL")
    plain = [t[1] if isinstance(t, tuple) else t for t in texts]
    got = [None if r["tokens"] is None else ENC.decode(r["tokens"]) for r in op.decode(coded, op.order_of(result)).collect()]
    assert sorted(got, key=repr) == sorted(plain, key=repr)
    assert sorted(((r["n_tokens"], r["exact"]) for r in coded.collect()), key=repr) == sorted(((None, None) if t is None else (len(ENC.encode_ordinary(t)), True) for t in plain), key=repr)
    count = np.bincount([i for t in plain if t for i in ENC.encode_ordinary(t)])
    order = sorted(np.flatnonzero(count).tolist(), key=lambda i: (-count[i], i))
    assert rows(result.where("rank IS NOT NULL").select("doc_id", "rank", "id", "count")) == sorted(((None, k, i, int(count[i])) for k, i in enumerate(order)), key=repr)


def test_rows_that_decode_to_other_ids_are_not_exact(spark):
    tokens = op.token_table(docs(spark, ["again again again", "other words"]))
    order = op.ranked(tokens)
    often = {r["doc_id"]: r["exact"] for r in op.encode(tokens, order[1:], check=True).collect()}
    assert often == {0: False, 1: True}


def test_an_empty_table_has_an_empty_result(spark, tmp_path):
    docs(spark, []).write.parquet(f"{tmp_path}/documents.parquet")
    assert op.query(spark, str(tmp_path)).collect() == []
