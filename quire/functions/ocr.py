"""Decisions and conversions around OCR that need no engine."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quire.functions import html as H
from quire.functions import text as T

# What counts as enough text, and the layout of word rows.
TOTAL, PER_PAGE, WORD, WORDS, RATIO = 64, 32.0, 4, 3, 0.3
WORD_LEVEL, FIELDS = 5, 12


def needs_ocr(text: Column, pages: Column) -> Column:
    """Whether the text that a document carries is too poor to do without OCR."""
    visible = T.replace_all(text, r"\s+", "")
    n = F.char_length(visible)
    alnum = F.char_length(T.replace_all(visible, r"[^\p{L}\p{N}]", ""))
    words = F.least(F.lit(WORDS), F.size(F.filter(T.words(text), lambda w: F.char_length(T.replace_all(w, r"[^\p{L}\p{N}]", "")) >= WORD)))
    p = F.greatest(pages, F.lit(1)).cast("double")
    each, each_alnum = n / p, alnum / p
    enough = (n >= TOTAL) & (each >= PER_PAGE) & (words >= WORDS)
    poor = ((alnum / n < RATIO) & (each_alnum < PER_PAGE)) | ((n < TOTAL) & (each < PER_PAGE))
    return F.when((n == 0) | (alnum == 0), True).when(enough, False).when(poor, True).otherwise((words == 0) & (each < PER_PAGE))


def any_page_needs_ocr(pages: DataFrame, key: str) -> DataFrame:
    """(key, fallback): one poor page turns the document."""
    return pages.groupBy(key).agg(F.bool_or(needs_ocr(F.col("text"), F.lit(1))).alias("fallback"))


def tsv_words(rows: DataFrame, key: str, column: str, least: float) -> DataFrame:
    """Word rows of tab-separated OCR output, of at least a confidence, with their line's id."""
    lines = rows.select(key, F.posexplode(T.lines(F.col(column))).alias("k", "line")).withColumn("f", F.split("line", "\t"))
    num = lambda i, kind="int": F.expr(f"try_cast(get(f, {i}) AS {kind})")
    kept = lines.where((F.size("f") >= FIELDS) & (num(0) == WORD_LEVEL) & (F.coalesce(num(10, "double"), F.lit(-1.0)) >= least) & (F.trim(F.col("f")[11]) != ""))
    parent = F.concat(F.lit("p"), F.col("f")[1], F.lit("_b"), F.col("f")[2], F.lit("_par"), F.col("f")[3], F.lit("_l"), F.col("f")[4])
    return kept.select(key, "k", F.trim(F.col("f")[11]).alias("text"), *[F.coalesce(num(i), F.lit(0)).alias(n) for i, n in ((6, "left_"), (7, "top_"), (8, "width"), (9, "height"))], num(10, "double").alias("confidence"), parent.alias("parent_id"))


def hocr_markdown(page: Column) -> Column:
    """Markdown of hOCR output: its paragraphs, lines and words are HTML elements."""
    return H.markdown(T.replace_all(page, r"(?is)<!DOCTYPE[^>]*>|<\?xml[^>]*>", ""))


def line_elements(words: DataFrame, key: str) -> DataFrame:
    """(key, parent_id, text, left_, top_, right_, bottom_, confidence): the lines of word rows, each with the box around
    its words and their mean confidence."""
    text = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("left_", "k", "text"))), lambda x: x["text"]), " ")
    return words.groupBy(key, "parent_id").agg(
        text.alias("text"),
        F.min("left_").alias("left_"),
        F.min("top_").alias("top_"),
        F.max(F.col("left_") + F.col("width")).alias("right_"),
        F.max(F.col("top_") + F.col("height")).alias("bottom_"),
        F.avg("confidence").alias("confidence"),
    )
