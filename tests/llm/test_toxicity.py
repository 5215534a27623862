"""The class-conditional models against their definition over dictionaries."""

from __future__ import annotations

import math
from collections import Counter, defaultdict

import numpy as np

from quire.llm import toxicity as T
from tests.llm.test_operators import docs, prose

WORDS = [b"abra", b"abracadabra", b"a", b"\xc3\xa9t\xc3\xa9", b"cadaver", b"abr", b"zebra", b"zebras", b"x" * 40]


def plain_shared(words, depth, discount):
    """Interpolated Kneser-Ney of the bytes of distinct words: {word: probability}."""
    line = lambda w: [((bytes(depth) + b" " + w + b" ")[i : i + depth + 1], (w + b" ")[i]) for i in range(len(w) + 1)]
    counts = [None] * (depth + 1)
    counts[depth] = Counter((c[-depth:], s) for w in words for c, s in line(w))
    for d in range(depth - 1, -1, -1):
        counts[d] = Counter((c[1:], s) for c, s in counts[d + 1])

    def p(context, s, d):
        if d == 0:
            total = sum(counts[0].values())
            return (counts[0][b"", s] + 1) / (total + 256)
        mine = {x: n for (c, x), n in counts[d].items() if c == context}
        total = sum(mine.values())
        if not total:
            return p(context[1:], s, d - 1)
        return max(mine.get(s, 0) - discount, 0) / total + discount * len(mine) / total * p(context[1:], s, d - 1)

    return {w: math.prod(p(c[-depth:], s, depth) for c, s in line(w)) for w in words}


def test_shared_orders_are_kneser_ney():
    for depth in (1, 3, 5):
        want = plain_shared(WORDS, depth, 0.75)
        got = T.shared(WORDS, depth, 0.75)
        assert np.allclose(np.log(got), [math.log(want[w]) for w in WORDS])


def test_parts_of_the_words_make_no_difference(monkeypatch):
    whole = T.shared(WORDS)
    monkeypatch.setattr(T, "LAID_OUT", 2)
    assert np.allclose(T.shared(WORDS), whole)


def test_ratios_are_those_of_the_definition():
    counts = np.array([[5, 0, 9, 1, 3, 0, 2, 0, 1], [0, 4, 8, 0, 2, 1, 0, 3, 0]], float)
    lower = plain_shared(WORDS, T.DEPTH, T.DISCOUNT)
    got = T.Ratio(*T.ratios(WORDS, counts))

    def p(c, w):
        mine = counts[c]
        n = mine[WORDS.index(w)] if w in WORDS else 0
        left = sum(min(x, T.WORD_DISCOUNT) for x in mine) / mine.sum()
        return max(n - T.WORD_DISCOUNT, 0) / mine.sum() + left * lower.get(w, 1e-9)

    for w in [*WORDS, b"unseen"]:
        assert math.isclose(got[w], math.log(p(1, w) / p(0, w)), rel_tol=1e-9, abs_tol=1e-9)


def test_features_of_long_short_and_empty_texts():
    ratio = T.Ratio([b"a", b"b"], np.array([3.0, -1.0]), 0.5)
    assert T.features(ratio, []) == (1.0, 0.0, 0.0, 0.0)
    assert T.features(ratio, [b"a"]) == (1.0, 3.0, 3.0, 1.0)
    long = [b"b"] * 99_997 + [b"a", b"c", b"a"]
    one, mean, root, top = T.features(ratio, long)
    assert math.isclose(mean, (-99_997 + 6.5) / 100_000) and math.isclose(root, mean * math.sqrt(100_000)) and math.isclose(top, 6.5 / 3)


def test_labels_that_disagree_repeat_or_miss(spark):
    rows = [(i, prose(i, 40) + (" blarg grumpf" if i % 3 == 0 else "")) for i in range(150)]
    marks = [(i, int(i % 3 == 0)) for i in range(150)] + [(0, 0), (1, None), (None, 1), (2, 7), (3, 1)]
    labels = spark.createDataFrame(marks, "doc_id long, toxic int")
    table = docs(spark, [*rows, (None, None), (0, "blarg grumpf blarg")])
    got = T.score(table, labels).collect()
    assert len(got) == 152 and defaultdict(int, {r.doc_id: r.predicted for r in got})[0] == 1
    assert sum(r.predicted == int(r.doc_id % 3 == 0) for r in got if r.doc_id) > 140
