"""Word-first backoff against its definition over dictionaries."""

from __future__ import annotations

import math
import random
from collections import Counter

import pytest

from quire.llm import language as L
from quire.llm.common import fold
from tests.llm.test_operators import docs

SCHEMA = "doc_id long, text string, lang string"
MADE = {"aa": ["kalo", "mira", "tesu", "bano", "É"], "bb": ["xith", "wrok", "plexu", "gnarth"], "cc": ["kalox", "wromi", "ñu"]}


def corpus():
    r = random.Random(3)
    return [(i, " ".join(r.choice(MADE[lang]) + r.choice(["", ".", "!", "2"]) for _ in range(1 + i % 30)), lang) for i in range(150) for lang in [sorted(MADE)[i % 3]]]


def plain(rows):
    """Scores of a text in each language, by the definition."""
    words = {lang: Counter() for lang in MADE}
    for _, text, lang in rows:
        words[lang].update("".join(c if c.isalpha() else " " for c in text.lower()).split())
    grams = [None] + [{lang: Counter() for lang in MADE} for _ in range(L.LONGEST)]
    for lang, c in words.items():
        for w, n in c.items():
            for k in range(1, L.LONGEST + 1):
                for i in range(len(w) + 3 - k):
                    grams[k][lang][f" {w} "[i : i + k]] += n

    def logs(counts, key):
        kinds = len(set().union(*counts.values()))
        row = [math.log((counts[x][key] + 0.5) / (sum(counts[x].values()) + 0.5 * kinds)) for x in sorted(MADE)]
        return [v - sum(row) / len(row) for v in row]

    def score(text):
        found = "".join(c if c.isalpha() else " " for c in text.lower()).split()
        total = [0.0] * len(MADE)
        for w in found:
            if any(words[x][w] for x in MADE):
                rows = [(1.0, logs(words, w))]
            else:
                rows = []
                for k in range(L.LONGEST, 0, -1):
                    known = [g for g in (f" {w} "[i : i + k] for i in range(len(w) + 3 - k)) if any(grams[k][x][g] for x in MADE)]
                    if known:
                        rows = [(L.UNSEEN / len(known), logs(grams[k], g)) for g in known]
                        break
            for weight, row in rows:
                total = [t + weight * v for t, v in zip(total, row, strict=True)]
        scaled = [math.exp(t / math.sqrt(max(1, len(found)))) for t in total]
        best = max(range(len(scaled)), key=lambda k: (scaled[k], -k))
        return (sorted(MADE)[best], scaled[best] / sum(scaled)) if found else ("und", 0.0)

    return score


def test_scores_are_those_of_the_definition(spark):
    rows = corpus()
    table = spark.createDataFrame(rows, SCHEMA)
    learnt = {r.doc_id for r in table.where(fold(table.doc_id, L.FOLDS) != 0).collect()}
    score = plain([r for r in rows if r[0] in learnt])
    asked = [*(t for _, t, _ in rows[::7]), "kalos xithu", "zzz", "ñandu É", "a", "MIRA-mira", "漢字", "x" * 50_000]
    got = {r.doc_id: r for r in L.identify(docs(spark, list(enumerate(asked))), L.fit(table)).collect()}
    for i, text in enumerate(asked):
        lang, p = score(text)
        assert abs(got[i].score - p) < 1e-9
        assert got[i].lang_pred == lang or p < 0.34


@pytest.mark.parametrize("text", ["½ ² ①", "12 345", "_ - !", "", " \n\t", "²³", "Ⅷ", "٣"])
def test_texts_without_letters_are_undetermined(spark, text):
    model = L.fit(spark.createDataFrame([(i, "kalo mira", "aa") for i in range(9)], SCHEMA))
    (got,) = L.identify(docs(spark, [(1, text)]), model).collect()
    assert (got.lang_pred, got.score) == ("und", 0.0)


def test_number_signs_part_words():
    assert L.letters_of("ab½cd x²y ⅷz 12 ok_no") == ["ab", "cd", "x", "y", "z", "ok", "no"]
