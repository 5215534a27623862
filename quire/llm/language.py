"""Language identification, word first.

A known word scores by its log frequency in each language. An unseen word falls
back to its character n-grams, of the greatest length of which any is known.
"""

from __future__ import annotations

import re
from collections import Counter

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StringType

from quire.llm.common import WordCache, counted, fold, kept_in_worker, sampled, sent_to_workers, table, texts, with_columns

FOLDS = 5
#: Bound on the texts of each language that a fit uses, chosen by a hash of the id.
SAMPLE = 1000
LONGEST = 5
#: Weight of an unseen word beside a known one.
UNSEEN = 0.5
NONE = "und"
#: A run of letters and of number signs that aren't digits.
LETTERS = re.compile(r"[^\W\d_]+")


def letters_of(text: str) -> list[str]:
    """Runs of letters."""
    out: list[str] = []
    for run in LETTERS.findall(text):
        if run.isalpha():
            out.append(run)
        else:
            out += "".join(c if c.isalpha() else " " for c in run).split()
    return out


class Model:
    """languages; log frequencies of words and n-grams in each, by key."""

    def __init__(self, languages: list[str], tables: list[tuple[list[str], np.ndarray]]):
        """tables: keys and a row of values for each, of words, and of n-grams of each length, 1 first."""
        self.languages = languages
        self.values = np.concatenate([v - v.mean(axis=1, keepdims=True) for _, v in tables])
        first = np.cumsum([0, *(len(keys) for keys, _ in tables)])
        self.words, *self.grams = [dict(zip(keys, range(n, n + len(keys)), strict=True)) for (keys, _), n in zip(tables, first, strict=False)]

    def of(self, tokens: list[str]) -> np.ndarray:
        """For each token between spaces: its words' scores less their mean over
        languages, and the number of its words."""
        rows: list[int] = []
        owners: list[int] = []
        shares: list[float] = []
        n = np.zeros(len(tokens))
        for k, token in enumerate(tokens):
            parts = [token] if token.isalpha() else letters_of(token)
            n[k] = len(parts)
            for word in parts:
                known = self.words.get(word)
                if known is not None:
                    rows.append(known)
                    owners.append(k)
                    shares.append(1.0)
                    continue
                padded = f" {word} "
                for length in range(LONGEST, 0, -1):
                    get = self.grams[length - 1].get
                    found = [r for i in range(len(padded) - length + 1) if (r := get(padded[i : i + length])) is not None]
                    if found:
                        rows += found
                        owners += [k] * len(found)
                        shares += [UNSEEN / len(found)] * len(found)
                        break
        out = np.zeros((len(tokens), len(self.languages) + 1))
        if rows:
            owner, share, values = np.array(owners), np.array(shares), self.values[np.array(rows)]
            for lang in range(len(self.languages)):
                out[:, lang] = np.bincount(owner, values[:, lang] * share, len(tokens))
        out[:, -1] = n
        return out


def tokens_of(text: str) -> list[str]:
    return text.lower().split()


def _logs(counts: DataFrame, key: str, languages: list[str]) -> tuple[list[str], np.ndarray]:
    """Smoothed log frequencies of each key in each language from (lang, key, n)."""
    rows = counts.groupBy(key).pivot("lang", languages).agg(F.sum("n")).orderBy(key).toPandas()
    n = rows[languages].fillna(0).to_numpy(float)
    return rows[key].tolist(), np.log((n + 0.5) / (n.sum(axis=0) + 0.5 * max(1, len(n))))


def fit(docs: DataFrame, sample: int = SAMPLE) -> tuple | None:
    """What a Model is made of: learns from at most ``sample`` texts of each non-null language outside the
    held-out fold; None if there are none. Null texts teach nothing. All words
    and n-grams of these texts are learned; they are counted in Spark, and come to the driver once each."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text"), F.col("lang").cast("string").alias("lang"))
    rows = rows.where((fold(F.col("doc_id"), FOLDS) != 0) & F.col("lang").isNotNull() & F.col("text").isNotNull())
    ids = sampled(rows.select("doc_id", "lang"), "lang", "doc_id", sample).distinct()
    languages = sorted(r.lang for r in ids.select("lang").distinct().collect())  # as many as the model has columns
    if not languages:
        return None
    # ``sample`` ids a language.
    chosen = rows.join(F.broadcast(ids), (rows.doc_id.eqNullSafe(ids.doc_id)) & (rows.lang == ids.lang), "left_semi")
    words = counted(chosen, "lang", lambda text: [w.encode() for w in letters_of(text.lower())])
    words = words.select("lang", F.col("word").cast("string").alias("word"), "n").cache()
    try:
        padded = F.concat(F.lit(" "), "word", F.lit(" "))
        grams = []
        for k in range(1, LONGEST + 1):
            pieces = F.transform(F.sequence(F.lit(1), F.char_length("word") + 3 - k), lambda i: F.substring(padded, i, F.lit(k)))  # noqa: B023
            each = words.where(F.char_length("word") + 3 - k >= 1).select("lang", F.explode(pieces).alias("gram"), "n").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
            grams.append(_logs(each, "gram", languages))
        return languages, [_logs(words, "word", languages), *grams]
    finally:
        words.unpersist()


def made(learnt: tuple | None) -> tuple[Model, WordCache] | None:
    if not learnt:
        return None
    model = Model(*learnt)
    return model, WordCache(model.of, len(model.languages) + 1)


def identify(docs: DataFrame, model: tuple | None) -> DataFrame:
    """The rows of ``docs`` with lang_pred and score (input columns of these names
    are replaced).

    A null text, one without letters, and any text without a model is 'und' of
    score 0. Ties go to the language that sorts first. Each row is judged on its
    own, so repeated rows and empty tables are nothing special.
    """
    sent = sent_to_workers(docs.sparkSession, model)

    def compute(batch: list[str]) -> list:
        known = kept_in_worker("language", sent, made)
        if not known:
            return [[NONE] * len(batch), [0.0] * len(batch)]
        sums, _ = known[1].sums([Counter(tokens_of(t)) for t in batch])
        n = sums[:, -1]
        # Normalised by the root of the number of words, so that long texts come near 1, but not at once.
        mean = sums[:, :-1] / np.sqrt(np.maximum(n, 1))[:, None]
        p = np.exp(mean - mean.max(axis=1, keepdims=True))
        p /= p.sum(axis=1, keepdims=True)
        best = p.argmax(axis=1)
        return [[known[0].languages[k] if m else NONE for k, m in zip(best, n, strict=True)], np.where(n > 0, p[np.arange(len(p)), best], 0.0)]

    return with_columns(docs, [("lang_pred", StringType()), ("score", DoubleType())], compute)


def op8_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    found = identify(texts(docs), fit(docs))
    return found.select("doc_id", (fold(F.col("doc_id"), FOLDS) == 0).alias("held_out"), "lang_pred", "score")
