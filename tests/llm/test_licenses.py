import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from foliospark.llm import licenses as L

from .helpers import awkward, docs, prose, words


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(0, 30), max_size=40))
def test_increasing_is_longest(values):
    best = [1] * len(values)
    for i in range(len(values)):
        for j in range(i):
            if values[j] < values[i]:
                best[i] = max(best[i], best[j] + 1)
    kept = L.increasing(values)
    assert len(kept) == max(best, default=0)
    assert all(a < b and values[a] < values[b] for a, b in zip(kept, kept[1:]))


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(0, 6), max_size=14), st.lists(st.integers(0, 6), max_size=14))
def test_alignment_is_common_and_rising(a, b):
    pairs = L.patience(a, b)
    assert all(a[i] == b[j] for i, j in pairs)
    assert all(p < r and q < s for (p, q), (r, s) in zip(pairs, pairs[1:]))
    assert len(pairs) <= len(L.common_subsequence(a, b))
    if a == b:
        assert len(pairs) == len(a)


def damaged(text, share, seed):
    r = random.Random(seed)
    return " ".join(w if r.random() > share else r.choice(["zzz", "", "yyy " + w]) for w in text.split())


@pytest.mark.parametrize("name", sorted(L.TEMPLATES))
def test_found_anywhere_and_whole(spark, name):
    text = L.TEMPLATES[name]
    n = len(words(text))
    rows = [(1, text), (2, prose(1, 400) + " " + text + " " + prose(2, 300)), (3, text + "\n" + text), (4, prose(3, 20_000) + "\n# " + text.upper()), (5, damaged(text, 0.04, 7)), (6, prose(5, 50))]
    found = {(x.doc_id, x.license): x for x in L.scan(docs(spark, [(i, t, "en", "s") for i, t in rows])).collect()}
    for i in (1, 2, 3, 4):
        assert found[i, name].coverage == 1.0 and found[i, name].matched_words == n
    assert found[2, name].first_word == 400 and found[2, name].last_word == 399 + n
    most = longest(words(damaged(text, 0.04, 7)), words(text))
    assert ((5, name) in found) == (most >= 0.8 * n) and (n <= 12 or (5, name) in found)
    assert not any(i == 6 for i, _ in found)


def test_matches_brute_force_over_all_windows(spark):
    r = random.Random(9)
    template = "alpha beta gamma delta epsilon zeta eta theta iota kappa"
    rows = []
    for i in range(80):
        w = [x for x in template.split() if r.random() > 0.12]
        for _ in range(r.randint(0, 2)):
            w.insert(r.randrange(len(w) + 1), "noise")
        rows.append((i, " ".join(prose(i, 30).split() + w + prose(i + 500, 30).split())))
    got = {x.doc_id: x.matched_words for x in L.scan(docs(spark, [(i, t, "en", "s") for i, t in rows]), templates={"t": template}).collect()}
    want = {}
    for i, t in rows:
        best = max(len(L.common_subsequence(t.split()[a : a + 20], template.split())) for a in range(len(t.split())))
        if best >= 8:
            want[i] = best
    assert got == want


def longest(a, b):
    best = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i in range(len(a)):
        for j in range(len(b)):
            best[i + 1][j + 1] = best[i][j] + 1 if a[i] == b[j] else max(best[i][j + 1], best[i + 1][j])
    return best[-1][-1]


@settings(max_examples=300, deadline=None)
@given(st.lists(st.integers(0, 5), max_size=25), st.lists(st.integers(0, 5), min_size=1, max_size=12))
def test_bit_vectors_match_a_table(a, b):
    n = longest(a, b)
    pairs = L.common_subsequence(a, b)
    assert len(pairs) == n and all(a[i] == b[j] for i, j in pairs)
    assert all(p < r and q < s for (p, q), (r, s) in zip(pairs, pairs[1:]))
    most, first, last = L.most_covering(a, b)
    assert most == n
    if n:
        assert longest(a[first : last + 1], b) == n and longest(a[:last], b) < n and longest(a[first + 1 : last + 1], b) < n


def test_long_insertions_and_large_gaps_without_anchors(spark):
    template = [f"w{k}" for k in range(160)]
    filler = prose(3, 8000).split()
    twice = [f"r{k}" for k in range(70)] * 2
    rows = [
        (1, template[:80] + filler[:80] + template[80:]),
        (2, filler[:500] + [x for k, w in enumerate(template) for x in (w, *filler[k * 40 : k * 40 + 40])]),
        (3, template[:70] + filler[:5000] + template[90:]),
        (4, template[:60] + filler[:100] + template[100:]),
    ]
    got = {x.doc_id: x for x in L.scan(docs(spark, [(i, " ".join(w), "en", "s") for i, w in rows]), templates={"t": " ".join(template)}).collect()}
    assert {i: x.matched_words for i, x in got.items()} == {1: 160, 2: 160, 3: 140}
    assert (got[2].first_word, got[2].last_word) == (500, 500 + 159 * 41)
    noisy = " ".join(x for w in twice for x in (w, "noise"))
    assert [x.matched_words for x in L.scan(docs(spark, [(1, noisy, "en", "s")]), templates={"t": " ".join(twice)}).collect()] == [140]


def test_awkward_rows(spark):
    odd = awkward(spark).withColumnRenamed("lang", "license").withColumnRenamed("source", "coverage")
    assert L.scan(odd).count() == 0
    notice = docs(spark, [(None, "Released under the MIT License.", "en", "s")] * 2)
    assert [tuple(x)[:3] for x in L.scan(notice.withColumn("matched_words", F.lit(0))).collect()] == [(None, "MIT-notice", 1.0)] * 2
    assert L.scan(docs(spark, [])).count() == 0
    with pytest.raises(ValueError):
        L.scan(notice, templates={"empty": "..."})
