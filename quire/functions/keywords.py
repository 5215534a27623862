"""Keywords by RAKE and a YAKE-like score, after the published algorithms."""

from __future__ import annotations

import math
import re
from collections import Counter, defaultdict
from collections.abc import Iterator
from decimal import ROUND_HALF_UP, Decimal

import pandas as pd
from pyspark.sql import DataFrame

LEAST_LETTERS, MOST_WORDS, MOST, LEAST_TEXT_WORDS = 3, 3, 10, 10


#: As Spark's and DuckDB's expressions have them: white space of ASCII, and what is neither that nor a letter or a number.
BLANKS, MARKS = re.compile(r"[ \t\n\x0b\f\r]+"), re.compile(r"(?:(?![ \t\n\x0b\f\r])[\W_])+")


def _rounded(x: float, digits: int) -> float:
    """Half up by the shortest decimal, as SQL does."""
    return float(Decimal(repr(x)).quantize(Decimal(1).scaleb(-digits), ROUND_HALF_UP))


def _rake(text: str, stopwords: frozenset[str], most: int) -> list[tuple[str, float]]:
    """(phrase, score) of a text, the best first."""
    if len([w for w in BLANKS.split(text) if w]) < LEAST_TEXT_WORDS:
        return []
    found: list[list[str]] = [[]]
    for w in BLANKS.split(MARKS.sub(" | ", text.lower())):
        if w == "|" or w in stopwords:
            if found[-1]:
                found.append([])
        elif w:
            found[-1].append(w)
    degree: Counter = Counter()
    times: Counter = Counter()
    for p in found:
        times.update(p)
        for w in p:
            degree[w] += len(p)
    raw = {}
    for p in found:
        if 0 < len(p) <= MOST_WORDS and len(k := " ".join(p)) and k not in raw and len(k.encode()) >= LEAST_LETTERS:
            raw[k] = _rounded(math.fsum(degree[w] / times[w] for w in p), 9)
    if not raw:
        return []
    low, high = min(raw.values()), max(raw.values())
    span = high - low
    # Scores are rounded before they are ranked; what can't come among the best after that needs no rounding.
    least = sorted(raw.values(), reverse=True)[min(most, len(raw)) - 1] - 2e-6 * span
    scores = [(k, _rounded((v - low) / span, 6) if span > 0 else 1.0) for k, v in raw.items() if v >= least]
    return sorted(scores, key=lambda x: (-x[1], x[0]))[:most]


def rake(docs: DataFrame, stopwords: list[str], most: int = MOST, key: str = "doc_id") -> DataFrame:
    """(key, rank, keyword, score): a word's score is its degree over its frequency,
    a phrase's (a run of words between marks and stop words) the sum of its words'; phrases of up to three words, scores scaled
    to 0..1 within a text, ties by phrase. Texts under ten words have none. All of it is
    local to a text, so a text is done where it lies, without a shuffle."""
    stop = frozenset(stopwords)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in batches:
            found = [(k, r + 1, w, s) for k, t in zip(rows[key], rows["text"], strict=True) if t for r, (w, s) in enumerate(_rake(t, stop, most))]
            yield pd.DataFrame(found, columns=[key, "rank", "keyword", "score"]).astype({"rank": "int32", "score": float})

    return docs.select(key, "text").mapInPandas(run, docs.select(key).schema.add("rank", "integer").add("keyword", "string").add("score", "double"))


def _yake(text: str, stopwords: frozenset[str], most: int) -> list[tuple[str, float]]:
    """Word scores of position, case, frequency, context and spread, multiplied
    over candidate phrases; 1 / (1 + score), the most telling first."""
    sentences = [re.findall(r"[^\W_]+", s) for s in re.split(r"[.!?\n]+", text)]
    sentences = [s for s in sentences if s]
    if sum(map(len, sentences)) < LEAST_TEXT_WORDS:
        return []
    tf, upper, places, left, right = Counter(), Counter(), defaultdict(list), defaultdict(set), defaultdict(set)
    for k, s in enumerate(sentences):
        for i, w in enumerate(s):
            t = w.lower()
            tf[t] += 1
            upper[t] += w[0].isupper() and i > 0
            places[t].append(k)
            if i:
                left[t].add(s[i - 1].lower())
                right[s[i - 1].lower()].add(t)
    mean = sum(tf.values()) / len(tf)
    spread = (sum((n - mean) ** 2 for n in tf.values()) / len(tf)) ** 0.5
    most_tf = max(tf.values())

    def word(t: str) -> float:
        case = upper[t] / (1 + math.log(tf[t]))
        position = math.log(math.log(3 + sorted(places[t])[len(places[t]) // 2]))
        frequency = tf[t] / (mean + spread)
        related = 1 + (len(left[t]) + len(right[t])) / tf[t] * (tf[t] / most_tf)
        sentence = len(set(places[t])) / len(sentences)
        return related * position / (case + frequency / related + sentence / related + 1e-9)

    scores = {t: max(word(t), 1e-9) for t in tf}
    found: Counter = Counter()
    for s in sentences:
        for n in range(1, MOST_WORDS + 1):
            for i in range(len(s) - n + 1):
                g = [w.lower() for w in s[i : i + n]]
                if g[0] not in stopwords and g[-1] not in stopwords and all(len(w) > 1 for w in g):
                    found[" ".join(g)] += 1
    out = []
    for phrase, n in found.items():
        parts = [scores[w] for w in phrase.split()]
        out.append((phrase, 1 / (1 + math.prod(parts) / (n * (1 + sum(parts))))))
    return sorted(out, key=lambda x: (-x[1], x[0]))[:most]


def yake(docs: DataFrame, stopwords: list[str], most: int = MOST, key: str = "doc_id") -> DataFrame:
    """(key, rank, keyword, score), text by text in Arrow batches."""
    stop = frozenset(stopwords)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in batches:
            found = [(k, r + 1, w, s) for k, t in zip(rows[key], rows["text"], strict=True) for r, (w, s) in enumerate(_yake(t or "", stop, most))]
            yield pd.DataFrame(found, columns=[key, "rank", "keyword", "score"]).astype({"rank": "int32", "score": float})

    return docs.select(key, "text").mapInPandas(run, docs.select(key).schema.add("rank", "integer").add("keyword", "string").add("score", "double"))
