import numpy as np
import pyarrow as pa
from hypothesis import given, settings
from hypothesis import strategies as st

from foliospark.llm.textops import Words, blocks, utf8

from .helpers import words

TEXTS = st.lists(st.one_of(st.none(), st.text(alphabet="aB é.!\n 9ü", max_size=30)), max_size=8)


@settings(max_examples=150, deadline=None)
@given(TEXTS, st.integers(1, 4), st.integers(1, 40))
def test_words_and_ngrams_match_a_plain_loop(texts, n, limit):
    data, offsets, valid = utf8(pa.array(texts, pa.string()))
    assert valid.tolist() == [t is not None for t in texts]
    names, sequences = {}, {}
    for i, j in blocks(offsets, limit):
        w = Words(data, offsets, i, j)
        grams, bounds = w.ngrams(n)
        for r in range(i, j):
            plain = words(texts[r] or "")
            own = w.hashes[w.bounds[r - i] : w.bounds[r - i + 1]]
            assert len(own) == len(plain)
            for h, p in zip(own.tolist(), plain):
                assert names.setdefault(p, h) == h
            expected = [tuple(plain[k : k + n]) for k in range(len(plain) - n + 1)] or ([tuple(plain)] if plain else [])
            got = grams[bounds[r - i] : bounds[r - i + 1]].tolist()
            assert len(got) == len(expected)
            for h, p in zip(got, expected):
                assert sequences.setdefault(p, h) == h
    assert len(set(names.values())) == len(names) and len(set(sequences.values())) == len(sequences)


def test_blocks_cover_all_rows_and_keep_long_texts_whole():
    offsets = np.array([0, 5, 5, 500, 510, 511])
    assert list(blocks(offsets, 10)) == [(0, 2), (2, 3), (3, 4), (4, 5)]


def test_sliced_columns():
    data, offsets, _ = utf8(pa.array(["x", "alpha", None, "beta gamma"]).slice(1))
    assert [len(Words(data, offsets, r, r + 1).hashes) for r in range(3)] == [1, 0, 2]
