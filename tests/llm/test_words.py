import numpy as np
import pyarrow as pa
from hypothesis import given, settings
from hypothesis import strategies as st

from tests.llm.plain import LOWER, words
from tidewater.llm.words import Words, grams


@settings(max_examples=80, deadline=None)
@given(st.lists(st.one_of(st.none(), st.text(alphabet=" \t\n\x0b\x0c\r\x1cabAB\u00e9\u2003x", max_size=40)), max_size=8))
def test_words_are_those_of_the_pattern(texts):
    w = Words(pa.array(texts, pa.string()))
    h, low = w.hashes(), w.hashes(lower=True)
    seen = {}
    for i, t in enumerate(texts):
        own = range(w.first[i], w.first[i + 1])
        assert [w.data[w.starts[j] : w.ends[j]].tobytes().decode() for j in own] == words(t)
        for j, x in zip(own, words(t), strict=True):
            assert seen.setdefault(("h", x), h[j]) == h[j]
            assert seen.setdefault(("l", x.translate(LOWER)), low[j]) == low[j]
    for kind in "hl":
        values = [v for (k, _), v in seen.items() if k == kind]
        assert len(values) == len(set(values))


def test_long_words_and_sliced_arrays():
    a = pa.array(["skip", "x" * 70_000 + " y " + "X" * 70_000, "y"]).slice(1)
    h = Words(a).hashes(lower=True)
    assert h[0] == h[2] and h[1] == h[3] and h[0] != h[1]


def test_grams_tell_sequences_apart():
    h = np.random.default_rng(0).integers(0, 2**63, 400).astype(np.uint64)
    h[200:240] = h[20:60]
    for k in (1, 2, 3, 5, 8, 13, 20):
        g = grams(h, k)
        assert len(g) == 401 - k and (g[200 : 241 - k] == g[20 : 61 - k]).all() and len(np.unique(g)) == len(g) - (41 - k)
    assert len(grams(h[:3], 5)) == 0
