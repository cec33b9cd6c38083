import base64
import re

import numpy as np
import pytest
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st

from graphloom.llm import bpe, op04_token_counts, op06_token_binary, op09_bpe
from tests.llm.helpers import docs, prose

AWKWARD = ["", " ", "a", "a  b", " lead", "trail ", "\n\n x \n", "it's 12ab don't", "é à ü", "x  y　z", "日本 語", "🙂 ok 🙂", "<|endoftext|>", "  a  ", "a\x00b"]
TABLE = {base64.b64decode(a): int(b) for a, b in map(bytes.split, bpe.read_ranks().splitlines())}
ENC = tiktoken.Encoding("plain", pat_str=bpe.PATTERN, mergeable_ranks=TABLE, special_tokens={})
CODER = bpe.encoding(bpe.read_ranks())


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet=" ab1.'\n \u0085 éàŁ日🙂s\x1c", max_size=60), st.integers(4, 12))
def test_cutting_at_boundaries_changes_nothing(text, limit):
    assert "".join(p for p, _ in bpe.parts(text, limit)) == text
    assert bpe.encode(CODER, text, limit).tolist() == ENC.encode_ordinary(text)


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet=" \n\t\u3000\u2003\xa0\x1cab.é", max_size=40), st.integers(4, 12))
def test_runs_of_white_space_are_one_piece(text, limit):
    blanks = bpe._BLANKS
    bpe._BLANKS = re.compile(blanks.pattern.replace("4096", "2"))
    try:
        assert bpe.encode(CODER, text, limit).tolist() == ENC.encode_ordinary(text)
    finally:
        bpe._BLANKS = blanks


@settings(max_examples=100, deadline=None)
@given(st.lists(st.none() | st.text(alphabet=" ab\n🙂<|\uffff", max_size=12) | st.just(bpe.BETWEEN + "x"), max_size=8), st.integers(1, 30))
def test_many_in_a_call_are_as_one_by_one(texts, size):
    flat, counts = bpe.encode_many(CODER, texts)
    want = [ENC.encode_ordinary(t or "") for t in texts]
    assert flat.tolist() == [i for x in want for i in x] and counts.tolist() == [len(x) for x in want]
    got = np.zeros(len(texts), int)
    for (_, sizes), rows in bpe.calls(CODER, texts, size):
        np.add.at(got, rows, sizes)
    assert got.tolist() == counts.tolist()


def piece_rule(text):
    """The ids of a text of blanks and words, piece by piece as the pattern's rule for blanks says, without the pattern."""
    out = []
    for m in re.finditer(r"[ \n]+|[^ \n]+", text):
        run = m[0]
        if run[0] in " \n" and m.end() < len(text):
            out += ENC.encode_ordinary(run[:-1]) if len(run) < 1000 else CODER.whole(run[:-1]).tolist()
            if run[-1] == "\n":
                out += ENC.encode_ordinary("\n")
        elif run[0] in " \n":
            out += CODER.whole(run).tolist()
        else:
            out += ENC.encode_ordinary(" " * (m.start() > 0 and text[m.start() - 1] == " ") + run)
    return out


@pytest.mark.parametrize("text", [" " * 1_000_000, "\n" * 1_000_000, "a" + " \n" * 2_500_000 + "b", "a" + " " * 5_000_000 + "b c" + "\n" * 1_000_000 + "d", "x" * 5_000_000], ids=["spaces", "feeds", "mixed", "both", "letter"])
def test_very_long_runs(text):
    got = bpe.encode(CODER, text)
    assert got.tolist() == piece_rule(text)
    assert bpe.encode_many(CODER, ["before", text, None, "after"])[1].tolist() == [len(ENC.encode_ordinary("before")), len(got), 0, len(ENC.encode_ordinary("after"))]
    assert CODER.decode_bytes(got.tolist()) == text.encode()


def test_texts_of_twenty_megabytes(spark):
    texts = [" " * 20_000_000, "\n" * 20_000_000, "日本" * 3_400_000, (" " * 9 + "\n") * 2_000_000 + "end"]
    table = spark.range(4).selectExpr("id AS doc_id", "CASE id WHEN 0 THEN repeat(' ', 20000000) WHEN 1 THEN repeat('\n', 20000000) WHEN 2 THEN repeat('日本', 3400000) ELSE repeat('         \n', 2000000) || 'end' END AS text")
    want = {k: len(bpe.encode(CODER, t)) for k, t in enumerate(texts)}
    assert {r["doc_id"]: r["n_tokens"] for r in op04_token_counts.token_counts(table).collect()} == want
    assert {r["doc_id"]: (r["n_tokens"], r["exact"]) for r in op09_bpe.encode(table, check=True).drop("tokens").collect()} == {k: (n, True) for k, n in want.items()}
    sizes = op06_token_binary.token_table(table).selectExpr("doc_id", "length(ids) / width AS n")
    assert {r["doc_id"]: r["n"] for r in sizes.collect()} == want


def test_counts_and_round_trip(spark):
    long = prose(1, 40_000)
    texts = [*AWKWARD, prose(2), long, "x" * 200_000, (3, "again"), (3, "again"), (None, "no id"), (50, None)]
    table = docs(spark, texts)
    plain = [t[1] if isinstance(t, tuple) else t for t in texts]
    want = sorted((None if t is None else len(ENC.encode_ordinary(t)) for t in plain), key=repr)
    assert sorted((r["n_tokens"] for r in op04_token_counts.token_counts(table).collect()), key=repr) == want
    coded = op09_bpe.encode(table, check=True)
    got = coded.collect()
    assert sorted((r["n_tokens"] for r in got), key=repr) == want
    assert {r["exact"] for r in got} == {True, None}
    raw = [r["raw"] for r in op09_bpe.decode(coded).collect()]
    assert sorted((None if r is None else bytes(r).decode() for r in raw), key=repr) == sorted(plain, key=repr)


def test_ids_cut_inside_a_character_decode_to_raw_bytes(spark):
    ids = ENC.encode_ordinary("🙂")
    (r,) = op09_bpe.decode(spark.createDataFrame([(1, ids[:1], "clash")], "doc_id long, tokens array<int>, raw string")).collect()
    assert bytes(r["raw"]) == ENC.decode_bytes(ids[:1]) and "🙂".encode().startswith(bytes(r["raw"]))


def test_an_unknown_id_is_an_error(spark):
    with pytest.raises(Exception, match="outside the vocabulary"):
        op09_bpe.decode(spark.createDataFrame([(1, [999_999])], "doc_id long, tokens array<int>")).collect()


def test_empty_tables(spark):
    empty = docs(spark, [])
    assert op04_token_counts.token_counts(empty).count() == op09_bpe.encode(empty).count() == op09_bpe.decode(op09_bpe.encode(empty)).count() == 0


def test_boundaries_are_single_spaces():
    raw = np.frombuffer("ab cd  e é f".encode(), np.uint8)
    assert bpe.boundaries(raw).tolist() == [2, 8, 11]
