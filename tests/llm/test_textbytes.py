import re

import numpy as np
import pyarrow as pa
import pytest

from graphloom.llm import textbytes as tb


def split(texts):
    out = []
    for s in tb.text_slices(pa.array(texts)):
        w = tb.words(s)
        out += [[s.data[a:b].tobytes().decode() for a, b in zip(w.start[x:y], w.end[x:y])] for x, y in zip(w.first[:-1], w.first[1:])]
    return out


def test_words():
    texts = ["It's a-b", "", "été “ça” va… non—si", "東京タワー、高い。", "ไทย ok", "１２３，ＡＢＣ", "한국어 말", "x\u00a0y\u2003z", "µm ºC ½", "abc東d"]
    want = [["it", "s", "a", "b"], [], ["été", "ça", "va", "non", "si"], list("東京タワー高い"), [*"ไทย", "ok"], ["１２３", "ａｂｃ"], ["한국어", "말"], ["x", "y", "z"], ["µm", "ºc"], ["abc", "東", "d"]]
    assert split(texts) == want


@pytest.mark.parametrize("seed", range(4))
def test_hashes_of_long_texts_are_those_of_their_words(seed):
    rng = np.random.default_rng(seed)
    text = "".join(rng.choice(list("ab c"), tb.BLOCK * 2 + 777)) + " " + "x" * (tb.BLOCK + 5) + " é"
    found = [m[0] for m in re.finditer(r"[abcxé]+", text)]
    (s,) = tb.text_slices(pa.array([text]))
    got = tb.words(s).hash
    assert len(got) == len(found)
    for k in [*range(0, len(found), 5000), len(found) - 2, len(found) - 1]:
        (one,) = tb.text_slices(pa.array([found[k]]))
        assert tb.words(one).hash.tolist() == [got[k]]
