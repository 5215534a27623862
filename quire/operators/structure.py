"""List items, paragraphs, semantic elements and document trees of texts."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quire.functions import text as T
from quire.operators import ordering

# How list lines begin.
BULLET, NUMBERED, LETTERED = r"^[-*•]( |$)", r"^[0-9]{1,2}\. ", r"^\p{L}\. "
HEADING = r"^(#{1,6})\s+(.+)$"


def _hash31(text: Column) -> Column:
    """h = 31 h + byte over the UTF-8 bytes, modulo 2**64, big-endian. Spark's
    arithmetic raises on overflow, hence numpy, which wraps."""

    @F.pandas_udf("binary")
    def run(texts: pd.Series) -> pd.Series:
        longest = max((len(t.encode()) for t in texts if t is not None), default=0)
        powers = np.cumprod(np.concatenate((np.ones(1, np.uint64), np.full(longest, 31, np.uint64))))

        def one(t: str | None) -> bytes | None:
            if t is None:
                return None
            data = np.frombuffer(t.encode(), np.uint8).astype(np.uint64)
            return int((data * powers[: len(data)][::-1]).sum(dtype=np.uint64)).to_bytes(8, "big")

        return texts.map(one)

    return run(text)


def _u64(data: Column) -> Column:
    return F.conv(F.hex(data), 16, 10).cast("decimal(38,0)")


def _mixed(*parts: Column) -> Column:
    """((a * 65599 + b) * 65599 + c)..., modulo 2**64, as hex digits."""
    top = F.lit(str(1 << 64)).cast("decimal(38,0)")
    total = parts[0]
    for p in parts[1:]:
        total = ((total * F.lit(65599).cast("decimal(6,0)") + p) % top).cast("decimal(38,0)")
    return F.lower(F.conv(total.cast("string"), 10, 16))


def element_id(kind: Column, text: Column, page: Column) -> Column:
    """elem-<hex>: hashes of kind, text and page number (null: 1) mixed."""
    return F.concat(F.lit("elem-"), _mixed(*[_u64(_hash31(c)) for c in (kind, text, F.coalesce(page, F.lit(1)).cast("string"))]))


def node_id(kind: Column, text: Column, page: Column, index: Column) -> Column:
    """node-<hex>: as element ids, with page (null: 2**64 - 1) and index as numbers."""
    none = F.lit(str((1 << 64) - 1)).cast("decimal(38,0)")
    return F.concat(F.lit("node-"), _mixed(_u64(_hash31(kind)), _u64(_hash31(text)), F.coalesce(page.cast("decimal(38,0)"), none), index.cast("decimal(38,0)")))


def lines(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, k, line, byte_start, byte_end, kind, indent) of each line; kind is
    bullet, numbered, lettered, indented or null."""
    split = docs.select(key, F.posexplode(T.lines(F.col(text))).alias("k", "line"))
    n = F.octet_length("line").cast("long")
    start = F.coalesce(F.sum(n + 1).over(Window.partitionBy(key).orderBy("k").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    bare = T.replace_all(F.col("line"), r"^\s+", "")
    indent = F.floor((n - F.octet_length(bare)) / 2).cast("int")
    kind = F.when(bare.rlike(BULLET), "bullet").when(bare.rlike(NUMBERED), "numbered").when(bare.rlike(LETTERED) & (F.octet_length(F.substring_index(bare, ".", 1)) == 1), "lettered").when((indent >= 2) & (bare != ""), "indented")
    return split.select(key, "k", "line", start.alias("byte_start"), (start + n).alias("byte_end"), kind.alias("kind"), indent.alias("indent"))


def list_items(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    return lines(docs, key, text).where("kind IS NOT NULL")


def paragraphs(text: Column) -> Column:
    """Texts between empty lines, trimmed, without blank ones."""
    return F.filter(F.transform(F.split(text, "\n\n"), lambda p: T.replace_all(p, r"^\s+|\s+$", "")), lambda p: p != "")


def elements(docs: DataFrame, key: str = "doc_id", text: str = "text", page: Column | None = None) -> DataFrame:
    """(key, element_index, kind, text, page_number, element_id): list items, and
    the paragraphs of what lies between them, in reading order."""
    page = page if page is not None else F.lit(1)
    marked = lines(docs.withColumn("_page", page.cast("int")).select(key, text, "_page"), key, text)
    run = F.sum(F.when(F.col("kind").isNotNull(), 2).otherwise(0)).over(Window.partitionBy(key).orderBy("k")) - F.when(F.col("kind").isNotNull(), 1).otherwise(0)
    blocks = marked.withColumn("block", run).groupBy(key, "block").agg(F.max("kind").alias("kind"), F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("k", "line"))), lambda x: x["line"]), "\n").alias("body"))
    item = F.filter(F.array(T.replace_all(F.col("body"), r"^\s+|\s+$", "")), lambda x: x != "")
    parts = blocks.select(key, "block", F.when(F.col("kind").isNotNull(), "ListItem").otherwise("NarrativeText").alias("kind"), F.posexplode(F.when(F.col("kind").isNotNull(), item).otherwise(paragraphs(F.col("body")))).alias("part", "text"))
    index = (F.row_number().over(Window.partitionBy(key).orderBy("block", "part")) - 1).alias("element_index")
    found = parts.select(key, index, "kind", F.col("text").alias("body"))
    pages = docs.select(F.col(key).alias("_key"), page.cast("int").alias("page_number"))
    return found.join(pages, F.col(key) == F.col("_key")).select(key, "element_index", "kind", F.col("body").alias("text"), "page_number", element_id(F.col("kind"), F.col("body"), F.col("page_number")).alias("element_id"))


def headings(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, node_index, level, title) of ATX headings outside fenced code."""
    rows = docs.select(key, F.posexplode(T.lines(F.col(text))).alias("k", "line"))
    fences = F.sum(F.col("line").rlike("^```").cast("int")).over(Window.partitionBy(key).orderBy("k"))
    found = rows.withColumn("inside", fences % 2 == 1).where(~F.col("inside") & F.col("line").rlike(HEADING))
    index = F.row_number().over(Window.partitionBy(key).orderBy("k")) - 1
    return found.select(key, index.cast("int").alias("node_index"), F.char_length(F.regexp_extract("line", HEADING, 1)).alias("level"), F.trim(F.regexp_extract("line", HEADING, 2)).alias("title"))


def tree(nodes: DataFrame, key: str = "doc_id") -> DataFrame:
    """Adds parent_index: the last earlier node of a lower level, null for roots.
    Levels go from 1 to 6, so the last node of each is carried in six columns."""
    order = Window.partitionBy(key).orderBy("node_index").rowsBetween(Window.unboundedPreceding, -1)
    last = [F.last(F.when(F.col("level") == k, F.col("node_index")), ignorenulls=True).over(order) for k in range(1, 7)]
    carried = nodes.select("*", *[c.alias(f"_{k}") for k, c in enumerate(last, 1)])
    # A node closes all of its level or deeper, and the last of a lower level stays open.
    parent = F.greatest(*[F.when(F.col("level") > k, F.col(f"_{k}")) for k in range(1, 7)])
    return carried.withColumn("parent_index", parent).drop(*[f"_{k}" for k in range(1, 7)])


def document_nodes(pages: DataFrame, key: str = "doc_id") -> DataFrame:
    """(key, page_number, node_index, level, text, parent_index) of texts (key, page_number, text): ATX
    headings of levels 1 to 6, and the blocks between empty lines and headings as level 7. A node stands under the last
    heading of a lower level on its page; each page begins without open sections."""
    rows = pages.select(key, "page_number", F.posexplode(T.lines(F.col("text"))).alias("k", "line"))
    order = Window.partitionBy(key, "page_number").orderBy("k")
    marked = rows.withColumn("head", F.col("line").rlike(HEADING)).withColumn("blank", F.col("line").rlike(r"^\s*$"))
    new = F.col("head") | F.coalesce(F.lag("head").over(order), F.lit(True)) | F.coalesce(F.lag("blank").over(order), F.lit(True))
    blocks = marked.withColumn("new", new.cast("int")).withColumn("block", F.sum("new").over(order)).where("NOT blank")
    whole = blocks.groupBy(key, "page_number", "block").agg(F.bool_or("head").alias("head"), F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("k", "line"))), lambda x: x["line"]), "\n").alias("body"))
    level = F.when(F.col("head"), F.char_length(F.regexp_extract("body", HEADING, 1))).otherwise(7)
    index = F.row_number().over(Window.partitionBy(key).orderBy("page_number", "block")) - 1
    nodes = whole.select(key, "page_number", index.cast("int").alias("node_index"), level.alias("level"), F.when(F.col("head"), F.trim(F.regexp_extract("body", HEADING, 2))).otherwise(F.col("body")).alias("text"), F.struct(key, "page_number").alias("unit"))
    return tree(nodes, "unit").drop("unit")


def tree_faults(nodes: DataFrame, key: str = "doc_id") -> DataFrame:
    """(key, node_index): nodes whose parent isn't an earlier node of their document."""
    known = nodes.select(F.col(key).alias("_k"), F.col("node_index").alias("_i"))
    return nodes.where("parent_index IS NOT NULL").join(known, (F.col(key) == F.col("_k")) & (F.col("parent_index") == F.col("_i")) & (F.col("parent_index") < F.col("node_index")), "left_anti").select(key, "node_index")


def strip_marker(line: Column) -> Column:
    return T.replace_all(T.replace_all(line, r"^\s+", ""), r"^(?:[-*•] |[0-9]{1,2}\. |\p{L}\. )", "")


def with_page_breaks(page: Column, last: Column) -> Column:
    return F.when(page < last, F.concat(F.lit("--- PAGE BREAK (page "), page.cast("string"), F.lit(" → "), (page + 1).cast("string"), F.lit(") ---")))


def cells_as_text(cells: Column) -> Column:
    """Cells by tabs, rows by line ends."""
    return F.trim(F.array_join(F.transform(cells, lambda r: F.array_join(r, "\t")), "\n"))


def cells_as_markdown(cells: Column, rule: str = "------|", escape: bool = True) -> Column:
    """A pipe table as wide as its first row."""
    width = F.size(cells[0])
    cell = lambda c: F.concat(F.lit(" "), F.replace(c, F.lit("|"), F.lit("\\|")) if escape else F.trim(c), F.lit(" |"))
    row = lambda r: F.concat(F.lit("|"), F.array_join(F.transform(F.slice(r, 1, width), cell), ""), F.repeat(F.lit(" |"), F.greatest(width - F.size(r), F.lit(0))), F.lit("\n"))
    rest = F.array_join(F.transform(F.slice(cells, 2, F.greatest(F.size(cells) - 1, F.lit(0))), row), "")
    return F.when((F.size(cells) == 0) | (width == 0), "").otherwise(F.concat(row(cells[0]), F.lit("|"), F.repeat(F.lit(rule), width), F.lit("\n"), rest))


def rows_as_markdown(rows: DataFrame, columns: list[str], order: list[str]) -> DataFrame:
    """(line_number, line): a table's header, rule and rows; floats with two digits,
    nulls empty. One line per row, numbered in the order of some columns."""
    def shown(c: str) -> Column:
        kind = rows.schema[c].dataType.typeName()
        return F.coalesce(F.format_string("%.2f", F.col(c)) if kind in ("double", "float") else F.col(c).cast("string"), F.lit(""))

    body = rows.select(*order, F.concat(F.lit("| "), F.concat_ws(" | ", *[shown(c) for c in columns]), F.lit(" |")).alias("line"))
    numbered = ordering.positions(body, order).select((F.col("position") + 3).cast("int").alias("line_number"), "line")
    head = rows.sparkSession.createDataFrame([(1, "| " + " | ".join(columns) + " |"), (2, "|" + " --- |" * len(columns))], "line_number int, line string")
    return head.unionByName(numbered)


def parse_markdown_table(text: Column) -> Column:
    """array<array<string>>: the cells of a pipe table's lines, rules and empty cells left out."""
    table_lines = F.filter(F.transform(T.lines(text), lambda x: F.trim(x)), lambda x: F.startswith(x, F.lit("|")) & ~x.rlike(T.TABLE_RULE))
    return F.transform(table_lines, lambda x: F.filter(F.transform(F.split(x, r"\|"), lambda c: F.trim(c)), lambda c: c != ""))


def as_format(text: Column, kind: Column) -> Column:
    """The output format of a text: HTML escapes it inside pre, others leave it."""
    return F.when(kind == "html", F.concat(F.lit("<pre>"), T.escape_html(text), F.lit("</pre>"))).otherwise(text)


def page_elements(texts: DataFrame, tables: DataFrame, images: DataFrame, heads: DataFrame, key: str = "doc_id") -> DataFrame:
    """(key, page_number, element_index, kind, text) of paged documents: on each page
    headings, tables, images, then the text's elements, and a page break after each but the last.

    texts: (key, page_number, text); tables: (key, page_number, k, cells); images:
    (key, page_number, k, format, width, height); heads: (key, page_number, k, level, text).
    """
    cols = lambda step, k, kind, text: (key, "page_number", F.lit(step).alias("step"), k.cast("long").alias("k"), F.lit(kind).alias("kind") if isinstance(kind, str) else kind, text.alias("text"))
    titles = heads.where(F.col("level").rlike("^h[1-6]$")).select(*cols(0, F.col("k"), "Title", F.col("text")))
    grids = tables.select(*cols(1, F.col("k"), "Table", cells_as_text(F.col("cells"))))
    number = lambda c: F.coalesce(F.col(c), F.lit(0)).cast("string")
    shown = F.concat(F.lit("Image: "), "format", F.lit(" ("), number("width"), F.lit("x"), number("height"), F.lit(")"))
    pictures = images.select(*cols(2, F.col("k"), "Image", shown))
    paged = texts.withColumn("_unit", F.concat(F.col(key).cast("string"), F.lit(":"), F.col("page_number").cast("string")))
    body = elements(paged, "_unit").join(paged.select("_unit", F.col(key), F.col("page_number").alias("_p")), "_unit").select(key, F.col("_p").alias("page_number"), F.lit(3).alias("step"), F.col("element_index").cast("long").alias("k"), "kind", "text")
    last = F.max("page_number").over(Window.partitionBy(key))
    breaks = texts.select(key, "page_number", with_page_breaks(F.col("page_number"), last).alias("text")).where("text IS NOT NULL").select(*cols(4, F.lit(0), "PageBreak", F.col("text")))
    every = titles.unionByName(grids).unionByName(pictures).unionByName(body).unionByName(breaks)
    index = F.row_number().over(Window.partitionBy(key).orderBy("page_number", "step", "k")) - 1
    return every.select(key, "page_number", index.alias("element_index"), "kind", "text")
