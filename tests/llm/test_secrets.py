"""The field against enumeration, and what it finds of secrets that it hasn't seen."""

from __future__ import annotations

import hashlib
import itertools

import numpy as np
import pytest
from pyspark.sql import functions as F

from quire.llm import secrets as S
from tests.llm.test_operators import docs, prose, sample_texts


def brute_chain(e, t):
    """(log partition sum, posteriors, expected transitions) over all tag sequences."""
    total, p, pairs = 0.0, np.zeros_like(e), np.zeros((3, 3))
    for tags in itertools.product(range(3), repeat=len(e)):
        x = np.exp(sum(e[i, k] for i, k in enumerate(tags)) + sum(t[a, b] for a, b in zip(tags, tags[1:], strict=False)))
        total += x
        for i, k in enumerate(tags):
            p[i, k] += x
        for a, b in zip(tags, tags[1:], strict=False):
            pairs[a, b] += x
    return np.log(total), p / total, pairs / total


def test_posteriors_are_those_of_all_tag_sequences():
    rng = np.random.default_rng(2)
    lengths, t = [5, 1, 3, 4], rng.normal(size=(3, 3))
    e = rng.normal(size=(4, 5, 3)) * 3
    there = np.arange(5) < np.array(lengths)[:, None]
    z, p, pairs = S.posteriors(e, t, there)
    want = [brute_chain(e[k, :n], t) for k, n in enumerate(lengths)]
    assert np.isclose(z, sum(w[0] for w in want)) and np.allclose(pairs, sum(w[2] for w in want))
    for k, n in enumerate(lengths):
        assert np.allclose(p[k, :n], want[k][1]) and not p[k, n:].any()


def test_the_gradient_is_the_slope_of_the_likelihood():
    rng = np.random.default_rng(3)
    e, t, there = rng.normal(size=(2, 4, 3)), rng.normal(size=(3, 3)), np.array([[True] * 4, [True, True, False, False]])
    z, p, pairs = S.posteriors(e, t, there)
    for k, j, c in ((0, 0, 1), (0, 3, 2), (1, 1, 0), (1, 3, 0)):
        up = e.copy()
        up[k, j, c] += 1e-6
        assert abs((S.posteriors(up, t, there)[0] - z) / 1e-6 - p[k, j, c]) < 1e-4
    for a, b in itertools.product(range(3), repeat=2):
        up = t.copy()
        up[a, b] += 1e-6
        assert abs((S.posteriors(e, up, there)[0] - z) / 1e-6 - pairs[a, b]) < 1e-4


@pytest.fixture(scope="module")
def field():
    return S.learn(sample_texts())


def test_pruned_decoding_is_the_whole_path(field):
    tagger = S.Tagger(field)
    for i in range(60):
        tokens, _ = S.planted(prose(500 + i, 90).split(), hashlib.md5(str(i).encode()).digest())
        text = " ".join(tokens)
        assert list(tagger.tags(tokens, text)) == list(tagger.path(tagger.scores(tokens, text), False, False))


def test_inside_is_learnt_and_secrets_of_several_tokens_are_found(field):
    assert field.transitions[S.B, S.I] > field.transitions[S.O, S.I] + 1
    tagger = S.Tagger(field)
    right = there = false = 0
    for i in range(400):
        tokens, tags = S.planted(prose(2000 + i, 80).split(), hashlib.md5(f"unseen {i}".encode()).digest())
        text = " ".join(tokens)
        spans = tagger.added(text, S.base_spans(text))
        if tags.any():
            there += 1
            hit = np.flatnonzero(tags)
            begin = len(" ".join(tokens[: hit[0]])) + 1
            end = len(" ".join(tokens[: hit[-1] + 1]))
            right += any(begin <= a <= begin + 20 and end - 2 <= b <= end for _, a, b in spans)
            false += len(spans) > 1
        else:
            false += bool(spans)
    assert there > 150 and right >= 0.9 * there and false <= 0.05 * 400


def test_long_runs_and_odd_texts(field):
    tagger = S.Tagger(field)
    for text in ("", '"', '" " "', "-----BEGIN PRIVATE KEY-----", "a" * 300_000, "x " * 100_000, '"open ' * 5000):
        assert isinstance(tagger.added(text, S.base_spans(text)), list)


def test_spark_tells_texts_with_a_match(spark):
    texts = [*sample_texts(), "secret=ab", "API_KEY: abcdef", "AKIA" + "A" * 16, "AKIAx", "f" * 24, "ſecret=abcdef"]

    rows = docs(spark, list(enumerate(texts))).select("doc_id", F.rlike("text", F.lit(S.MATCHES)).alias("m")).collect()
    assert {r.doc_id: r.m for r in rows} == {i: bool(S.base_spans(t)) for i, t in enumerate(texts)}


def test_repeated_and_null_ids_and_the_bounds(spark):
    rows = [(i % 40, t) for i, t in enumerate(sample_texts())] + [(None, "secret=abcdef"), (0, None)]
    assert S.fit(docs(spark, rows)) is not None
    assert S.fit(docs(spark, rows), chars=0) is None
    assert S.fit(docs(spark, [(None, "secret=abcdef")])) is None
