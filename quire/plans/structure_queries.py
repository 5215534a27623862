"""Queries of lists, elements, trees and tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from quire.operators import structure as S
from quire.plans.base import Registry, table
from quire.plans.text_queries import sql_lines

R = Registry()
#: A list, paragraphs, headings and fenced code after each text.
LINES = ["", "", "- first", "* second", "  - nested item", "12. twelve", "123. no", "a. letter", "ab. no", "      far in", "plain", "", "", "last paragraph", "# Top", "## Sub", "```", "# code", "```", "#### Deep", "## Other", "# End"]
TAIL_SQL = " || chr(10) || ".join(f"'{x}'" for x in LINES)
DOCS = f"(SELECT doc_id, text || {TAIL_SQL} AS text FROM documents)"


def _docs(spark, d):
    return table(spark, d, "documents").select("doc_id", F.concat("text", F.lit("\n".join(LINES))).alias("text"))


MARKED = f"""a AS (SELECT doc_id, {sql_lines('text')} AS ls FROM {DOCS}), b AS (SELECT doc_id, unnest(ls) AS line, CAST(unnest(range(len(ls))) AS INT) AS k FROM a),
c AS (SELECT *, regexp_replace(line, '^\\s+', '') AS bare, CAST(coalesce(sum(strlen(line) + 1) OVER (PARTITION BY doc_id ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS byte_start FROM b),
m AS (SELECT *, byte_start + strlen(line) AS byte_end, CAST((strlen(line) - strlen(bare)) // 2 AS INT) AS indent,
  CASE WHEN regexp_matches(bare, '{S.BULLET}') THEN 'bullet' WHEN regexp_matches(bare, '{S.NUMBERED}') THEN 'numbered' WHEN regexp_matches(bare, '{S.LETTERED}') AND strlen(string_split(bare, '.')[1]) = 1 THEN 'lettered'
  WHEN (strlen(line) - strlen(bare)) // 2 >= 2 AND bare <> '' THEN 'indented' END AS kind FROM c)"""


@R.query("list_items", f"WITH {MARKED} SELECT doc_id, k, line, byte_start, byte_end, kind, indent FROM m WHERE kind IS NOT NULL")
def list_items(spark, d):
    return S.list_items(_docs(spark, d))


TRIM = "regexp_replace({x}, '^\\s+|\\s+$', '', 'g')"


@R.query("paragraphs", f"""WITH p AS (SELECT doc_id, list_filter(list_transform(string_split(text, chr(10) || chr(10)), lambda x: {TRIM.format(x='x')}), lambda x: x <> '') AS ps FROM {DOCS})
SELECT doc_id, CAST(unnest(range(len(ps))) AS INT) AS k, unnest(ps) AS paragraph FROM p""")
def paragraphs(spark, d):
    return _docs(spark, d).select("doc_id", F.posexplode(S.paragraphs(F.col("text"))).alias("k", "paragraph"))


BLOCKS = f"""{MARKED}, r AS (SELECT *, sum(CASE WHEN kind IS NOT NULL THEN 2 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY k) - CASE WHEN kind IS NOT NULL THEN 1 ELSE 0 END AS block FROM m),
g AS (SELECT doc_id, block, max(kind) AS kind, string_agg(line, chr(10) ORDER BY k) AS body FROM r GROUP BY doc_id, block),
ps AS (SELECT doc_id, block, CASE WHEN kind IS NOT NULL THEN 'ListItem' ELSE 'NarrativeText' END AS kind, CASE WHEN kind IS NOT NULL THEN [{TRIM.format(x='body')}] ELSE list_transform(string_split(body, chr(10) || chr(10)), lambda x: {TRIM.format(x='x')}) END AS parts FROM g),
u AS (SELECT doc_id, block, kind, unnest(parts) AS text, unnest(range(len(parts))) AS part FROM ps),
el AS (SELECT doc_id, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY block, part) - 1 AS INT) AS element_index, kind, text FROM u WHERE text <> '')"""
BIG = "18446744073709551616"


def hash31(e: str) -> str:
    digits = "list_transform(range(0, strlen({e})), lambda i: CAST('0x' || substr(hex(encode({e})), 2 * i + 1, 2) AS INT))".replace("{e}", e)
    return f"list_reduce(list_prepend(CAST(0 AS HUGEINT), list_transform({digits}, lambda x: CAST(x AS HUGEINT))), lambda a, b: (a * 31 + b) % {BIG})"


HEXED = "printf('%x%08x', CAST({h} // 4294967296 AS BIGINT), CAST({h} % 4294967296 AS BIGINT))"


@R.query("elements", f"WITH {BLOCKS} SELECT doc_id, element_index, kind, text FROM el")
def elements(spark, d):
    return S.elements(_docs(spark, d)).select("doc_id", "element_index", "kind", "text")


MIX = f"((({hash31('kind')} * 65599 + {hash31('text')}) % {BIG}) * 65599 + {hash31(chr(39) + '1' + chr(39))}) % {BIG}"


@R.query("element_ids", f"WITH {BLOCKS}, h AS (SELECT doc_id, element_index, {MIX} AS h FROM el) SELECT doc_id, element_index, 'elem-' || ltrim({HEXED.format(h='h')}, '0') AS element_id FROM h")
def element_ids(spark, d):
    return S.elements(_docs(spark, d)).select("doc_id", "element_index", "element_id")


HEADS = f"""{MARKED}, f AS (SELECT *, sum(CAST(starts_with(line, '```') AS INT)) OVER (PARTITION BY doc_id ORDER BY k) % 2 AS inside FROM m),
hd AS (SELECT doc_id, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY k) - 1 AS INT) AS node_index, CAST(length(regexp_extract(line, '{S.HEADING}', 1)) AS INT) AS level, trim(regexp_extract(line, '{S.HEADING}', 2)) AS title FROM f WHERE inside = 0 AND regexp_matches(line, '{S.HEADING}')),
tr AS (SELECT h.doc_id, h.node_index, h.level, h.title, (SELECT max(p.node_index) FROM hd p WHERE p.doc_id = h.doc_id AND p.node_index < h.node_index AND p.level < h.level) AS parent_index FROM hd h)"""


@R.query("headings", f"WITH {HEADS} SELECT * FROM hd")
def headings(spark, d):
    return S.headings(_docs(spark, d))


@R.query("tree_parents", f"WITH {HEADS} SELECT * FROM tr")
def tree_parents(spark, d):
    return S.tree(S.headings(_docs(spark, d)))


NODE = f"((({hash31(chr(39) + 'group' + chr(39))} * 65599 + {hash31('title')}) % {BIG}) * 65599 + 1) % {BIG}"


@R.query("node_ids", f"WITH {HEADS}, h AS (SELECT doc_id, node_index, (({NODE}) * 65599 + node_index) % {BIG} AS h FROM hd) SELECT doc_id, node_index, 'node-' || ltrim({HEXED.format(h='h')}, '0') AS node_id FROM h")
def node_ids(spark, d):
    return S.headings(_docs(spark, d)).select("doc_id", "node_index", S.node_id(F.lit("group"), F.col("title"), F.lit(1), F.col("node_index")).alias("node_id"))


@R.query("tree_faults", f"WITH {HEADS} SELECT doc_id, node_index FROM tr WHERE parent_index IS NOT NULL AND node_index = 3")
def tree_faults(spark, d):
    """The fourth node's parent is moved out of its document, and found."""
    t = S.tree(S.headings(_docs(spark, d)))
    return S.tree_faults(t.withColumn("parent_index", F.when((F.col("node_index") == 3) & F.col("parent_index").isNotNull(), 99).otherwise(F.col("parent_index"))))


@R.query("strip_list_markers", f"WITH {MARKED} SELECT doc_id, k, regexp_replace(bare, '^(?:[-*•] |[0-9]{{1,2}}\\. |\\p{{L}}\\. )', '') AS item FROM m WHERE kind IS NOT NULL")
def strip_list_markers(spark, d):
    return S.list_items(_docs(spark, d)).select("doc_id", "k", S.strip_marker(F.col("line")).alias("item"))


@R.query("page_breaks", "SELECT conv_id, turn, CASE WHEN turn < max(turn) OVER (PARTITION BY conv_id) THEN '--- PAGE BREAK (page ' || turn || ' → ' || (turn + 1) || ') ---' END AS page_break FROM conversations")
def page_breaks(spark, d):
    from pyspark.sql import Window

    last = F.max("turn").over(Window.partitionBy("conv_id"))
    return table(spark, d, "conversations").select("conv_id", "turn", S.with_page_breaks(F.col("turn"), last).alias("page_break"))


CELLS = "[['region', 'a|b'], [n_name, CAST(n_nationkey AS VARCHAR), 'extra'], [CAST(n_regionkey AS VARCHAR)]]"


@R.query("table_to_markdown", "SELECT n_nationkey, '| region | a\\|b |' || chr(10) || '|------|------|' || chr(10) || '| ' || n_name || ' | ' || n_nationkey || ' |' || chr(10) || '| ' || n_regionkey || ' | |' || chr(10) AS markdown, 'region' || chr(9) || 'a|b' || chr(10) || n_name || chr(9) || n_nationkey || chr(9) || 'extra' || chr(10) || n_regionkey AS plain FROM nation")
def table_to_markdown(spark, d):
    cells = F.array(F.array(F.lit("region"), F.lit("a|b")), F.array(F.col("n_name"), F.col("n_nationkey").cast("string"), F.lit("extra")), F.array(F.col("n_regionkey").cast("string")))
    return table(spark, d, "nation").select("n_nationkey", S.cells_as_markdown(cells).alias("markdown"), S.cells_as_text(cells).alias("plain"))


@R.query("rows_to_markdown", """SELECT 1 AS line_number, '| s_suppkey | s_name | s_acctbal |' AS line UNION ALL SELECT 2, '| --- | --- | --- |'
UNION ALL SELECT CAST(row_number() OVER (ORDER BY s_suppkey) + 2 AS INT), '| ' || s_suppkey || ' | ' || s_name || ' | ' || printf('%.2f', s_acctbal) || ' |' FROM supplier""")
def rows_to_markdown(spark, d):
    return S.rows_as_markdown(table(spark, d, "supplier"), ["s_suppkey", "s_name", "s_acctbal"], ["s_suppkey"])


@R.query("parse_markdown_table", "SELECT n_nationkey, unnest(range(2)) AS row, unnest(['a,b', n_name || ',' || n_nationkey]) AS cells FROM nation")
def parse_markdown_table(spark, d):
    text = F.concat(F.lit("intro\n| a | b |\n|---|:-:|\n| "), "n_name", F.lit(" |  | "), F.col("n_nationkey").cast("string"), F.lit(" |\nend"))
    rows = table(spark, d, "nation").select("n_nationkey", F.posexplode(S.parse_markdown_table(text)).alias("row", "c"))
    return rows.select("n_nationkey", F.col("row").cast("long").alias("row"), F.array_join("c", ",").alias("cells"))


@R.query("output_formats", "SELECT page_id, k AS format, CASE WHEN k = 'html' THEN '<pre>' || replace(replace(replace(replace(replace(html, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '\"', '&quot;'), '''', '&#39;') || '</pre>' ELSE html END AS content FROM pages, (SELECT unnest(['plain', 'markdown', 'html']) AS k)")
def output_formats(spark, d):
    rows = table(spark, d, "pages").select("page_id", "html", F.explode(F.array(*[F.lit(k) for k in ("plain", "markdown", "html")])).alias("format"))
    return rows.select("page_id", "format", S.as_format(F.col("html"), F.col("format")).alias("content"))


@R.query("page_elements", """WITH p AS (SELECT conv_id, CAST(turn + 1 AS INT) AS page_number, 'Said: ' || regexp_replace(text, '\\s+', ' ', 'g') AS text FROM conversations), m AS (SELECT *, max(page_number) OVER (PARTITION BY conv_id) AS last FROM p),
e AS (SELECT conv_id, page_number, 0 AS step, 'Title' AS kind, 'Turn ' || page_number AS text FROM p UNION ALL SELECT conv_id, page_number, 1, 'Table', 'a' || chr(9) || page_number || chr(10) || 'b' FROM p WHERE page_number = 2
  UNION ALL SELECT conv_id, page_number, 2, 'Image', 'Image: png (0x7)' FROM p WHERE page_number = 1 UNION ALL SELECT conv_id, page_number, 3, 'NarrativeText', regexp_replace(text, '^\\s+|\\s+$', '', 'g') FROM p
  UNION ALL SELECT conv_id, page_number, 4, 'PageBreak', '--- PAGE BREAK (page ' || page_number || ' → ' || (page_number + 1) || ') ---' FROM m WHERE page_number < last)
SELECT conv_id, page_number, CAST(row_number() OVER (PARTITION BY conv_id ORDER BY page_number, step) - 1 AS INT) AS element_index, kind, text FROM e""")
def page_elements(spark, d):
    """Turns, as one paragraph each, stand for pages."""
    said = F.concat(F.lit("Said: "), F.regexp_replace("text", r"\s+", " "))
    p = table(spark, d, "conversations").select("conv_id", (F.col("turn") + 1).cast("int").alias("page_number"), said.alias("text"))
    n = F.col("page_number").cast("string")
    heads = p.select("conv_id", "page_number", F.lit(0).alias("k"), F.lit("h2").alias("level"), F.concat(F.lit("Turn "), n).alias("text"))
    tables = p.where("page_number = 2").select("conv_id", "page_number", F.lit(0).alias("k"), F.array(F.array(F.lit("a"), n), F.array(F.lit("b"))).alias("cells"))
    images = p.where("page_number = 1").select("conv_id", "page_number", F.lit(0).alias("k"), F.lit("png").alias("format"), F.lit(None).cast("int").alias("width"), F.lit(7).alias("height"))
    return S.page_elements(p, tables, images, heads, "conv_id")


NODES = f"""p AS (SELECT doc_id, CAST(i + 1 AS INT) AS page_number, substring(text, CAST(i * 2000 + 1 AS INT), 2000) AS text FROM (SELECT doc_id, text, unnest(range(0, greatest(length(text) - 1, 0) // 2000 + 1)) AS i FROM {DOCS})),
l AS (SELECT doc_id, page_number, unnest(ls) AS line, unnest(range(len(ls))) AS k FROM (SELECT doc_id, page_number, {sql_lines('text')} AS ls FROM p)),
h AS (SELECT *, regexp_matches(line, '^(#{{1,6}})\\s+(.+)$') AS head, regexp_full_match(line, '\\s*') AS blank FROM l),
n AS (SELECT *, CASE WHEN head OR coalesce(lag(head) OVER w, true) OR coalesce(lag(blank) OVER w, true) THEN 1 ELSE 0 END AS new FROM h WINDOW w AS (PARTITION BY doc_id, page_number ORDER BY k)),
b AS (SELECT *, sum(new) OVER (PARTITION BY doc_id, page_number ORDER BY k) AS block FROM n),
g AS (SELECT doc_id, page_number, block, bool_or(head) AS head, string_agg(line, chr(10) ORDER BY k) AS body FROM b WHERE NOT blank GROUP BY ALL),
x AS (SELECT doc_id, page_number, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY page_number, block) - 1 AS INT) AS node_index, CAST(CASE WHEN head THEN length(regexp_extract(body, '^(#{{1,6}})', 1)) ELSE 7 END AS INT) AS level, CASE WHEN head THEN trim(regexp_extract(body, '^(#{{1,6}})\\s+(.+)$', 2)) ELSE body END AS text FROM g)"""


@R.query("document_nodes", f"WITH {NODES} SELECT x.doc_id, x.page_number, x.node_index, x.level, md5(x.text) AS digest, max(y.node_index) AS parent_index FROM x LEFT JOIN x y ON x.doc_id = y.doc_id AND x.page_number = y.page_number AND y.node_index < x.node_index AND y.level < x.level GROUP BY ALL")
def document_nodes(spark, d):
    """Sections and blocks of pages of 2,000 characters."""
    docs = _docs(spark, d).select("doc_id", "text")
    starts = F.sequence(F.lit(0), F.greatest(F.char_length("text") - 1, F.lit(0)), F.lit(2000))
    pages = docs.select("doc_id", F.posexplode(F.transform(starts, lambda s: F.substring("text", s + 1, F.lit(2000)))).alias("k", "text"))
    nodes = S.document_nodes(pages.select("doc_id", (F.col("k") + 1).alias("page_number"), "text"))
    return nodes.select("doc_id", "page_number", "node_index", "level", F.md5("text").alias("digest"), "parent_index")
