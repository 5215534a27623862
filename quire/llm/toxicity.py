"""Toxicity by class-conditional Kneser-Ney models.

Toxic and ordinary texts have a model of words each: counts of the class less a discount, and
what the discount takes goes to lower orders that the classes share: an interpolated Kneser-Ney
model of the bytes of distinct words (each word counts once, each shorter context by the number of
longer ones it continues), so that rare expressions say little. A word's log-likelihood ratio
is that of the two; a text's features are the mean ratio of its words, the sum over the root of their number,
and the mean of the PEAKS greatest, weighed by a logistic fit on labelled texts that the models haven't seen.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType

from quire.llm.bytegrams import mask, positions, summed
from quire.llm.common import columns, counted, fold, fresh, kept_in_worker, sampled, sent_to_workers, table, texts, with_columns

#: Bytes of context in the shared model.
DEPTH = 5
#: Of continuation counts, and of a class's counts of a word.
DISCOUNT, WORD_DISCOUNT = 0.75, 2.0
PEAKS = 3
FOLDS = 5
#: Bound on the labelled texts of each class that a fit uses, models and
#: calibration together; chosen by a hash of the id.
SAMPLE = 2400
#: Of the sample, this share calibrates.
CALIBRATE = 4
def words_of(text: str) -> list[bytes]:
    return text.encode().lower().split()


#: Words whose bytes are laid out at a time.
LAID_OUT = 50_000


def _keys(words: list[bytes], depth: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(byte string of ``depth`` bytes and a symbol, its word) of each byte of the words, a part at a time."""
    for at in range(0, len(words), LAID_OUT):
        context, symbol, word = positions(words[at : at + LAID_OUT])
        yield ((context & mask(depth)) << np.uint64(8)) | symbol.astype(np.uint64), word + at


def shared(words: list[bytes], depth: int = DEPTH, discount: float = DISCOUNT) -> np.ndarray:
    """Probability of each of the distinct words by the model of their bytes, closing space included."""
    key, times = np.zeros(0, np.uint64), np.zeros(0)
    for k, _ in _keys(words, depth):
        found, n = np.unique(k, return_counts=True)
        key, times = summed(np.concatenate((key, found)), np.concatenate((times, n.astype(float))))
    longest, row = key, np.arange(len(key))
    orders: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []  # (discounted share, weight of the order below, row of each longest string)
    for d in range(depth, -1, -1):
        _, of = np.unique(key >> np.uint64(8), return_inverse=True)
        total, kinds = np.bincount(of, times)[of], np.bincount(of)[of]
        if d:
            orders.append((np.maximum(times - discount, 0) / total, discount * kinds / total, row))
            # In how many contexts one byte longer each string is.
            key, at = np.unique((((key >> np.uint64(8)) & mask(d - 1)) << np.uint64(8)) | (key & np.uint64(255)), return_inverse=True)
            row, times = at[row], np.bincount(at, minlength=len(key)).astype(float)
        else:
            orders.append(((times + 1) / (total + 256), np.zeros(len(key)), row))
    p = np.zeros(len(longest))
    for share, weight, row in reversed(orders):
        p = share[row] + weight[row] * p
    logs = np.log(p)
    out = np.zeros(len(words))
    for k, word in _keys(words, depth):
        out += np.bincount(word, logs[np.searchsorted(longest, k)], len(words))
    return np.exp(out)


class Ratio(dict):
    """log P(word | toxic) - log P(word | ordinary) of each known word; ``new`` for all others, of which
    the shared orders say the same in both classes."""

    def __init__(self, words: list[bytes], values: np.ndarray, new: float):
        super().__init__(zip(words, values.tolist(), strict=True))
        self.new = new

    def __missing__(self, word: bytes) -> float:
        return self.new


def ratios(words: list[bytes], counts: np.ndarray, discount: float = WORD_DISCOUNT) -> tuple[list[bytes], np.ndarray, float]:
    """What a Ratio is made of. counts: two rows, ordinary and toxic, with a column for each of the distinct words."""
    lower = shared(words)
    total = counts.sum(axis=1)
    left = np.minimum(counts, discount).sum(axis=1) / total
    logs = [np.log(np.maximum(n - discount, 0) / total[c] + left[c] * lower) for c, n in enumerate(counts)]
    return words, logs[1] - logs[0], float(np.log(left[1]) - np.log(left[0]))


def features(ratio: Ratio, words: list[bytes]) -> tuple[float, float, float, float]:
    """1, the mean ratio of a word, the sum over the root of the count, and the mean of the PEAKS greatest (0 where
    there are fewer words)."""
    n = len(words)
    if not n:
        return 1.0, 0.0, 0.0, 0.0
    values = np.fromiter(map(ratio.__getitem__, words), float, n)
    total = float(values.sum())
    top = np.partition(values, n - PEAKS)[n - PEAKS :] if n > PEAKS else values
    return 1.0, total / n, total / math.sqrt(n), float(top.sum()) / PEAKS


def logistic(x: np.ndarray, y: np.ndarray, weight: np.ndarray, ridge: float = 1e-3) -> np.ndarray:
    """Newton's method on weighted log loss."""
    b = np.zeros(x.shape[1])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ b, -500, 500)))
        g = x.T @ (weight * (p - y)) + ridge * b
        h = (x * (weight * np.maximum(p * (1 - p), 1e-6))[:, None]).T @ x + ridge * np.eye(len(b))
        step = np.linalg.solve(h, g)
        b -= step * min(1.0, 5.0 / max(1e-9, float(np.abs(step).max())))
        if np.abs(step).max() < 1e-6:
            break
    return b


def fit(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> tuple[tuple, np.ndarray] | None:
    """Learns from at most ``sample`` labelled texts of each class outside the held-out fold.

    Null labels and ids teach nothing. Of labels that disagree about an id, the
    toxic one holds; repeated rows of a document count once each. None if either
    class is missing.
    """
    marked = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").cast("int").alias("toxic")).where("doc_id IS NOT NULL AND toxic IN (0, 1)")
    marked = marked.where(fold(F.col("doc_id"), FOLDS) != 0).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    prior = {r.toxic: r.n for r in marked.groupBy("toxic").agg(F.count(F.lit(1)).alias("n")).collect()}  # two rows
    if len(prior) < 2:
        return None
    chosen = sampled(marked, "toxic", "doc_id", sample)  # two times ``sample`` ids at most
    part = texts(docs).join(F.broadcast(chosen), "doc_id").select("toxic", (F.pmod(F.xxhash64("doc_id", F.lit(11)), F.lit(CALIBRATE)) == 0).alias("calibrates"), "text")
    # The sample's distinct words come to the driver.
    found = counted(part.where("NOT calibrates"), "toxic", words_of).groupBy("word").pivot("toxic", [0, 1]).agg(F.sum("n")).orderBy("word").toPandas()
    counts = found[["0", "1"]].fillna(0).to_numpy(float).T
    if not counts.sum(axis=1).all():
        return None
    ratio = ratios([bytes(w) for w in found["word"]], counts)
    del found, counts
    tests = measured(part.where("calibrates").select("toxic", "text"), ratio).drop("text").toPandas()  # four numbers a text
    y = tests.toxic.to_numpy(float)
    if len(set(y)) < 2:
        return ratio, np.array([-1.0, 2.0, 0.0, 0.0])
    x = np.array(tests.features.tolist())
    share = prior[1] / (prior[0] + prior[1])
    weight = np.where(y == 1, share / y.mean(), (1 - share) / (1 - y.mean()))
    return ratio, logistic(x, y, weight)


def measured(docs: DataFrame, ratio: tuple) -> DataFrame:
    """The rows of ``docs`` with their features."""
    model = sent_to_workers(docs.sparkSession, ratio)

    def compute(batch: list[str]) -> list:
        known = kept_in_worker("ratio", model, lambda v: Ratio(*v))
        return [[features(known, words_of(t)) for t in batch]]

    return with_columns(docs, [("features", ArrayType(DoubleType()))], compute)


def score(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """The rows of ``docs`` with columns held_out, score and predicted (input
    columns of these names are replaced).

    Empty and null texts score by the fit's constant alone. Null ids count as
    ''. Without labels of both classes every score is 0. Each row is scored on
    its own, so repeated rows and empty tables are nothing special.
    """
    scored = _scored(docs.select(*columns(docs, "held_out", "predicted")), labels, sample, "score")
    return scored.withColumns({"held_out": fold(F.col("doc_id"), FOLDS) == 0, "predicted": (F.col("score") >= 0.5).cast("int")})


def _scored(docs: DataFrame, labels: DataFrame, sample: int, column: str) -> DataFrame:
    model = sent_to_workers(docs.sparkSession, fit(docs, labels, sample))

    def compute(batch: list[str]) -> list:
        found = kept_in_worker("toxicity", model, lambda v: v and (Ratio(*v[0]), v[1]))
        if not found:
            return [[0.0] * len(batch)]
        x = np.array([features(found[0], words_of(t)) for t in batch]).reshape(-1, 4) @ found[1]
        return [1 / (1 + np.exp(-np.clip(x, -500, 500)))]

    return with_columns(docs, [(column, DoubleType())], compute)


def clean(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """The rows of ``docs`` with a score below a half, all columns as they are."""
    (column,) = fresh(docs, "score")
    return _scored(docs, labels, sample, column).where(F.col(column) < 0.5).drop(column)


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = score(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "labels"))
    return scored.select("doc_id", "held_out", "score", "predicted")
