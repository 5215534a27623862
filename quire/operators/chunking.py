"""Chunks of texts, their offsets, and the pages they lie on."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Name, characters, overlap, dimensions.
PRESETS = (("fast", 512, 50, 384), ("balanced", 1024, 100, 768), ("quality", 2000, 200, 1024), ("multilingual", 1024, 100, 768))
SIZE, OVERLAP = 1000, 200
PAGE_MARK = "\n\n<!-- PAGE {page_num} -->\n\n"


def checked(size: int, overlap: int) -> tuple[int, int]:
    if size <= 0 or overlap < 0 or overlap >= size:
        raise ValueError(f"overlap {overlap} must be at least 0 and less than the size {size}")
    return size, overlap


def fixed(docs: DataFrame, size: int = SIZE, overlap: int = OVERLAP, key: str = "doc_id") -> DataFrame:
    """(key, chunk_index, chunk): windows of ``size`` characters, each ``overlap``
    back from the last's end; the last is what is left. Empty texts have none."""
    checked(size, overlap)
    n = F.char_length("text")
    starts = F.when(n > 0, F.sequence(F.lit(0), F.greatest(n - overlap - 1, F.lit(0)), F.lit(size - overlap)))
    return docs.select(key, F.posexplode(F.transform(starts, lambda s: F.substring(F.col("text"), s + 1, F.lit(size)))).alias("chunk_index", "chunk"))


def semantic(docs: DataFrame, size: int = SIZE, overlap: int = OVERLAP, key: str = "doc_id", markdown: bool = False) -> DataFrame:
    """(key, chunk_index, chunk): as much text as fits ``size`` characters, cut at the
    coarsest break there is: headings (markdown), paragraphs, lines, sentences, words.
    A chunk begins with whole pieces of the one before, of ``overlap`` characters at most."""
    checked(size, overlap)
    breaks = ([r"(?m)^(?=#{1,6} )"] if markdown else []) + [r"(?<=\n\n)", r"(?<=\n)", r"(?<=[.!?])\s+", r"\s+"]

    def pieces(text: str, level: int = 0) -> list[str]:
        if len(text) <= size - overlap or level == len(breaks):
            return [text[i : i + size - overlap] for i in range(0, len(text), size - overlap)]
        cuts = [0, *(m.end() for m in re.finditer(breaks[level], text) if 0 < m.end() < len(text)), len(text)]
        return [p for a, b in zip(cuts, cuts[1:], strict=False) for p in pieces(text[a:b], level + 1)]

    def chunks(text: str) -> list[str]:
        out: list[str] = []
        held: list[str] = []
        for p in pieces(text):
            if held and sum(map(len, held)) + len(p) > size:
                out.append("".join(held))
                while held and (sum(map(len, held)) > overlap or sum(map(len, held)) + len(p) > size):
                    held.pop(0)
            held.append(p)
        return [c.strip() for c in [*out, "".join(held)] if c.strip()]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in batches:
            found = [(k, i, c) for k, t in zip(rows[key], rows["text"], strict=True) if t for i, c in enumerate(chunks(t))]
            yield pd.DataFrame(found, columns=[key, "chunk_index", "chunk"]).astype({"chunk_index": "int32"})

    return docs.select(key, "text").mapInPandas(run, docs.select(key).schema.add("chunk_index", "integer").add("chunk", "string"))


def offsets(chunks: DataFrame, overlap: int = OVERLAP, key: str = "doc_id") -> DataFrame:
    """Adds byte_start, byte_end and total_chunks. Starts are derived: the end of
    the chunk before less the lesser of overlap and its bytes."""
    order = Window.partitionBy(key).orderBy("chunk_index")
    n = F.octet_length("chunk").cast("long")
    start = F.coalesce(F.sum(n - F.least(F.lit(overlap), n)).over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return chunks.select("*", start.alias("byte_start"), (start + n).alias("byte_end"), F.count(F.lit(1)).over(Window.partitionBy(key)).alias("total_chunks"))


def page_ranges(chunks: DataFrame, pages: DataFrame, key: str = "doc_id") -> DataFrame:
    """(key, chunk_index, first_page, last_page) of the pages [byte_start, byte_end)
    that each chunk overlaps, nulls if none. An equi-join by document whose
    condition is the overlap, so pairs stay within a document."""
    p = pages.select(F.col(key).alias("_key"), F.col("byte_start").alias("_start"), F.col("byte_end").alias("_end"), "page_number")
    both = chunks.join(p, (F.col(key) == F.col("_key")) & (F.col("byte_start") < F.col("_end")) & (F.col("byte_end") > F.col("_start")), "left")
    return both.groupBy(key, "chunk_index").agg(F.min("page_number").alias("first_page"), F.max("page_number").alias("last_page"))


def boundary_violations(pages: DataFrame, key: str = "doc_id") -> DataFrame:
    """(key, page_number, problem): ranges that are empty or begin before the last ends."""
    order = Window.partitionBy(key).orderBy("page_number")
    problem = F.when(F.col("byte_start") >= F.col("byte_end"), "empty").when(F.lag("byte_start").over(order) > F.col("byte_start"), "unsorted").when(F.lag("byte_end").over(order) > F.col("byte_start"), "overlapping")
    return pages.select(key, "page_number", problem.alias("problem")).where("problem IS NOT NULL")


def paged(text: Column, size: int) -> Column:
    """array<string>: the text in pages of ``size`` characters, one at least."""
    return F.transform(F.sequence(F.lit(0), F.greatest(F.char_length(text) - 1, F.lit(0)), F.lit(size)), lambda s: F.substring(text, s + 1, F.lit(size)))


def with_page_marks(pages: Column, mark: str = PAGE_MARK) -> Column:
    before, after = mark.split("{page_num}")
    return F.array_join(F.transform(pages, lambda p, i: F.concat(F.lit(before), (i + 1).cast("string"), F.lit(after), p)), "")


def normalized(vector: Column) -> Column:
    """Divided by its length, unless that is 0."""
    length = F.sqrt(F.aggregate(vector, F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double")))
    return F.transform(vector, lambda x: F.when(length > 0, x / length).otherwise(x.cast("double")))
