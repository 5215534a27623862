"""Queries of pages, formats, languages, keywords, OCR and geometry."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import functions as F

from quire.functions import html as H
from quire.functions import keywords, language, ocr
from quire.functions.reduction import STOPWORDS
from quire.operators import geometry as G
from quire.plans.base import Registry, table
from quire.plans.text_queries import sql_words, sub
from quire.sources import mime, structured

R = Registry()


def sql_bare(e: str) -> str:
    c = f"trim({sub(sub(e, r'(?s)<[^>]+>', ''), r'\s+', ' ')})"
    for a, b in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "''"), ("&amp;", "&")):
        c = f"replace({c}, '{a}', '{b}')"
    return c


_q = lambda p: p.replace("'", "''")


@R.query("html_title", f"SELECT page_id, nullif({sql_bare(f'''regexp_extract(html, '{H.TITLE}', 1)''')}, '') AS title, nullif(regexp_extract(html, '{_q(H.LANGUAGE)}', 1), '') AS lang FROM pages")
def html_title(spark, d):
    return table(spark, d, "pages").select("page_id", H.title(F.col("html")).alias("title"), H.language(F.col("html")).alias("lang"))


@R.query("html_headings", f"""WITH h AS (SELECT page_id, regexp_extract_all(html, '{H.HEADING}', 1) AS ls, regexp_extract_all(html, '{H.HEADING}', 2) AS ts FROM pages)
SELECT page_id, CAST(k AS INT) AS k, CAST(ls[k + 1] AS INT) AS level, {sql_bare('ts[k + 1]')} AS text FROM (SELECT *, unnest(range(len(ls))) AS k FROM h)""")
def html_headings(spark, d):
    return table(spark, d, "pages").select("page_id", F.posexplode(H.headings(F.col("html"))).alias("k", "h")).select("page_id", "k", "h.*")


LINKS = f"l AS (SELECT page_id, unnest(regexp_extract_all(html, '{_q(H.LINK)}', 1)) AS href, unnest(range(len(regexp_extract_all(html, '{_q(H.LINK)}', 1)))) AS k FROM pages)"


@R.query("html_links", f"WITH {LINKS} SELECT page_id, CAST(k AS INT) AS k, href FROM l")
def html_links(spark, d):
    return table(spark, d, "pages").select("page_id", F.posexplode(H.links(F.col("html"))).alias("k", "href"))


KIND = """CASE WHEN starts_with(href, '#') THEN 'anchor' WHEN starts_with(href, 'mailto:') THEN 'email' WHEN starts_with(href, 'tel:') THEN 'phone' WHEN regexp_matches(href, '^(?i)https?://') THEN 'external'
  WHEN regexp_matches(href, '^(/|\\.\\.?/|[A-Za-z0-9_-]+([./]|$))') AND NOT regexp_matches(href, '^[A-Za-z][A-Za-z0-9+.-]*:') THEN 'internal' ELSE 'other' END"""


@R.query("html_link_types", f"WITH {LINKS}, x AS (SELECT href FROM l UNION ALL SELECT unnest(['#top', 'mailto:a@b', 'tel:1', 'ftp://x', '../up', 'HTTP://Y', '?q'])) SELECT {KIND} AS link_type, count(*) AS n FROM x GROUP BY 1")
def html_link_types(spark, d):
    found = table(spark, d, "pages").select(F.explode(H.links(F.col("html"))).alias("href"))
    more = spark.createDataFrame([(x,) for x in ("#top", "mailto:a@b", "tel:1", "ftp://x", "../up", "HTTP://Y", "?q")], "href string")
    return found.unionByName(more).groupBy(H.link_type(F.col("href")).alias("link_type")).agg(F.count(F.lit(1)).alias("n"))


@R.query("html_images", f"SELECT page_id, CAST(len(regexp_extract_all(html, '{_q(H.IMAGE)}', 1)) AS INT) AS n_images FROM pages")
def html_images(spark, d):
    return table(spark, d, "pages").select("page_id", F.size(H.images(F.col("html"))).alias("n_images"))


@R.query("html_markdown")
def html_markdown(spark, d):
    return table(spark, d, "pages").select("page_id", H.markdown(F.col("html")).alias("markdown"))


PATHS = "(SELECT url || CASE CAST(page_id % 4 AS INT) WHEN 0 THEN '.HTML' WHEN 1 THEN '.pdf' WHEN 2 THEN '.unknown' ELSE '.tgz' END AS path, CASE WHEN page_id % 6 = 0 THEN 'image/x-new' WHEN page_id % 6 = 1 THEN 'text/none' END AS given, page_id FROM pages)"
EXT = "CASE lower(regexp_extract(path, '\\.([A-Za-z0-9]+)$', 1)) " + " ".join(f"WHEN '{e}' THEN '{m}'" for e, m in mime.BY_EXTENSION.items()) + " END"


@R.query("mime_of_path", f"SELECT page_id, {EXT} AS by_path, CASE WHEN given LIKE 'image/%' THEN given WHEN given IS NULL THEN {EXT} END AS resolved FROM {PATHS}")
def mime_of_path(spark, d):
    k = F.col("page_id")
    path = F.concat("url", F.when(k % 4 == 0, ".HTML").when(k % 4 == 1, ".pdf").when(k % 4 == 2, ".unknown").otherwise(".tgz"))
    given = F.when(k % 6 == 0, "image/x-new").when(k % 6 == 1, "text/none")
    return table(spark, d, "pages").select("page_id", mime.of_path(path).alias("by_path"), mime.resolved(given, path).alias("resolved"))


@R.query("mime_sniff", """SELECT 'p' || page_id AS id, CASE WHEN regexp_matches(regexp_replace(html, '^\\s+', ''), '^[\\[{]') AND json_valid(html) THEN 'application/json' WHEN starts_with(regexp_replace(html, '^\\s+', ''), '<') THEN 'application/xml' WHEN starts_with(html, '%PDF') THEN 'application/pdf' ELSE 'text/plain' END AS mime FROM pages
UNION ALL SELECT 'e' || event_id, CASE WHEN json_valid(props) THEN 'application/json' ELSE 'text/plain' END FROM events""")
def mime_sniff(spark, d):
    p = table(spark, d, "pages").select(F.concat(F.lit("p"), F.col("page_id").cast("string")).alias("id"), mime.of_text(F.col("html")).alias("mime"))
    return p.unionByName(table(spark, d, "events").select(F.concat(F.lit("e"), F.col("event_id").cast("string")).alias("id"), mime.of_text(F.col("props")).alias("mime")))


@R.query("mime_extensions", "SELECT mime, string_agg(extension, ' ' ORDER BY extension) AS extensions FROM (VALUES " + ", ".join(f"('{e}', '{m}')" for e, m in mime.BY_EXTENSION.items()) + ") AS t(extension, mime) GROUP BY mime")
def mime_extensions(spark, d):
    known = spark.createDataFrame(list(mime.BY_EXTENSION.items()), "extension string, mime string")
    return known.groupBy("mime").agg(F.array_join(F.sort_array(F.collect_list("extension")), " ").alias("extensions"))


MAGICS = [("jpeg", "FFD8FFE0"), ("png", "89504E470D0A"), ("gif", "474946383961"), ("bmp", "424D00"), ("svg", "3C737667"), ("tiff", "49492A00"), ("webp", "524946460000000057454250"), ("wmf", "D7CDC69A"), ("emf", "01000000" + "00" * 36 + "20454D46"), ("unknown", "0011")]


@R.query("image_formats", "SELECT CAST(k AS INT) AS k, fmt AS format FROM (VALUES " + ", ".join(f"({k}, '{n}')" for k, (n, _) in enumerate(MAGICS)) + ") AS t(k, fmt)")
def image_formats(spark, d):
    rows = spark.createDataFrame([(k, bytes.fromhex(h)) for k, (_, h) in enumerate(MAGICS)], "k int, data binary")
    return rows.select("k", mime.image_format(F.col("data")).alias("format"))


READERS = [("plain", "text/plain", 50, 1), ("rich", "text/plain", 60, 2), ("old", "text/html", 50, 3), ("new", "text/html", 50, 4), ("pictures", "image/*", 40, 5), ("png", "image/png", 50, 6), ("any text", "text/*", 10, 7)]


@R.query("reader_choice", "SELECT * FROM (VALUES ('text/plain', 1, 'rich'), ('text/plain', 2, 'plain'), ('text/plain', 3, 'any text'), ('text/html', 1, 'new'), ('text/html', 2, 'any text'), ('image/png', 1, 'png'), ('image/png', 2, 'pictures'), ('image/gif', 1, 'pictures')) AS t(mime, place, name)")
def reader_choice(spark, d):
    readers = spark.createDataFrame(READERS, "name string, mime string, priority int, seq int")
    return mime.chosen_readers(readers, spark.createDataFrame([(m,) for m in ("text/plain", "text/html", "image/png", "image/gif")], "mime string"))


@R.query("json_flatten", "SELECT event_id, key AS path, CAST(json_extract_string(props, '$.' || key) AS VARCHAR) AS value, FALSE AS is_text FROM (SELECT event_id, props, unnest(json_keys(props)) AS key FROM events)")
def json_flatten(spark, d):
    return structured.flatten(table(spark, d, "events"), "event_id", "props")


@R.query("json_schema", "SELECT count(*) AS n, CAST(count(*) FILTER (json_structure(props) = '{\"k\":\"UBIGINT\"}') AS BIGINT) AS n_alike FROM events")
def json_schema(spark, d):
    s = structured.schema_text(F.col("props"))
    return table(spark, d, "events").agg(F.count(F.lit(1)).alias("n"), F.count_if(s == "OBJECT<k: BIGINT>").alias("n_alike"))


LANG_WORDS = sql_words("lower(regexp_replace({e}, '[^\\p{{L}}\\s]', '', 'g'))")


def sql_hits(e: str) -> str:
    """list of (negative share, code), the least first."""
    ws = LANG_WORDS.format(e=e)
    each = ", ".join(f"{{'s': -len(list_filter({ws}, lambda w: list_contains([{', '.join(repr(x) for x in stop)}], w))) / CAST(greatest(len({ws}), 1) AS DOUBLE), 'k': '{language.CODES[lang]}'}}" for lang, stop in STOPWORDS.items())
    return f"list_sort([{each}])[1]"


@R.query("lang_detect_single", f"SELECT doc_id, CASE WHEN -b.s >= 0.05 THEN b.k END AS language, round(-b.s, 9) AS share FROM (SELECT doc_id, {sql_hits('text')} AS b FROM documents)")
def lang_detect_single(spark, d):
    found = table(spark, d, "documents").select("doc_id", language.detect(F.col("text"), 0.05).alias("f"))
    return found.select("doc_id", F.col("f.code").alias("language"), F.round("f.share", 9).alias("share"))


@R.query("lang_vs_label", f"SELECT lang, language, count(*) AS n FROM (SELECT lang, ({sql_hits('text')}).k AS language FROM documents) GROUP BY lang, language")
def lang_vs_label(spark, d):
    return table(spark, d, "documents").groupBy("lang", language.detect(F.col("text"), 0.0)["code"].alias("language")).agg(F.count(F.lit(1)).alias("n"))


@R.query("lang_detect_multiple", f"""WITH t AS (SELECT doc_id, substring(text, i * 200 + 1, 200) AS tile FROM (SELECT doc_id, text, unnest(range(0, greatest(length(text) - 1, 0) // 200 + 1)) AS i FROM documents WHERE trim(text) <> '')),
v AS (SELECT doc_id, CASE WHEN -b.s >= 0.1 THEN b.k END AS language FROM (SELECT doc_id, {sql_hits('tile')} AS b FROM t)), n AS (SELECT doc_id, language, count(*) AS votes FROM v WHERE language IS NOT NULL GROUP BY doc_id, language),
s AS (SELECT doc_id, CASE WHEN -b.s >= 0.1 THEN b.k END AS language, 0 AS votes FROM (SELECT doc_id, {sql_hits('text')} AS b FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM n) AND trim(text) <> '')),
u AS (SELECT * FROM n UNION ALL SELECT * FROM s WHERE language IS NOT NULL) SELECT doc_id, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY votes DESC, language) AS INT) AS place, language, votes FROM u""")
def lang_detect_multiple(spark, d):
    return language.multiple(table(spark, d, "documents"), 0.1)


STOP = "[" + ", ".join(f"'{w}'" for w in STOPWORDS["en"]) + "]"
PHRASES = f"""list_filter(list_transform(string_split(array_to_string(list_transform({sql_words("regexp_replace(lower(text), '[^\\p{L}\\p{N}\\s]+', ' | ', 'g')")}, lambda w: CASE WHEN w = '|' OR list_contains({STOP}, w) THEN '|' ELSE w END), ' '), '|'), lambda p: list_filter(regexp_split_to_array(trim(p), ' +'), lambda w: w <> '')), lambda p: len(p) > 0)"""


@R.query("keywords_rake", f"""WITH f AS (SELECT doc_id, unnest({PHRASES}) AS p FROM documents WHERE len({sql_words('text')}) >= 10), w AS (SELECT doc_id, unnest(p) AS w, len(p) AS n FROM f),
s AS (SELECT doc_id, w, sum(n) / CAST(count(*) AS DOUBLE) AS s FROM w GROUP BY doc_id, w), k AS (SELECT DISTINCT doc_id, p, array_to_string(p, ' ') AS keyword FROM f WHERE len(p) <= 3 AND strlen(array_to_string(p, ' ')) >= 3),
e AS (SELECT doc_id, keyword, unnest(p) AS w FROM k), r AS (SELECT doc_id, keyword, round(sum(s), 9) AS raw FROM e JOIN s USING (doc_id, w) GROUP BY doc_id, keyword),
z AS (SELECT *, min(raw) OVER (PARTITION BY doc_id) AS lo, max(raw) OVER (PARTITION BY doc_id) AS hi FROM r), q AS (SELECT doc_id, keyword, round(CASE WHEN hi > lo THEN (raw - lo) / (hi - lo) ELSE 1.0 END, 6) AS score FROM z)
SELECT doc_id, rank, keyword, score FROM (SELECT *, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY score DESC, keyword) AS INT) AS rank FROM q) WHERE rank <= 10""")
def keywords_rake(spark, d):
    return keywords.rake(table(spark, d, "documents"), STOPWORDS["en"])


@R.query("keywords_yake")
def keywords_yake(spark, d):
    return keywords.yake(table(spark, d, "documents"), STOPWORDS["en"])


def sql_needs(t: str, pages: str) -> str:
    n, a = f"length({sub(t, r'\s+', '')})", f"length({sub(sub(t, r'\s+', ''), r'[^\p{L}\p{N}]', '')})"
    w = f"least(3, len(list_filter({sql_words(t)}, lambda w: length({sub('w', r'[^\p{L}\p{N}]', '')}) >= 4)))"
    return f"""CASE WHEN {n} = 0 OR {a} = 0 THEN TRUE WHEN {n} >= 64 AND {n} / {pages} >= 32 AND {w} >= 3 THEN FALSE
      WHEN ({a} / CAST({n} AS DOUBLE) < 0.3 AND {a} / {pages} < 32) OR ({n} < 64 AND {n} / {pages} < 32) THEN TRUE ELSE {w} = 0 AND {n} / {pages} < 32 END"""


CUT = "text"


@R.query("ocr_fallback", f"SELECT doc_id, {sql_needs(CUT, 'CAST(1 + doc_id % 7 AS DOUBLE)')} AS fallback FROM documents")
def ocr_fallback(spark, d):
    return table(spark, d, "documents").select("doc_id", ocr.needs_ocr(F.col("text"), (1 + F.col("doc_id") % 7)).alias("fallback"))


@R.query("ocr_fallback_by_page", f"SELECT conv_id, bool_or({sql_needs('text', '1.0')}) AS fallback FROM conversations GROUP BY conv_id")
def ocr_fallback_by_page(spark, d):
    return ocr.any_page_needs_ocr(table(spark, d, "conversations"), "conv_id")


@R.query("ocr_tsv_words", """SELECT n_nationkey, CAST(k AS INT) AS k, n_name AS text, CAST(n_nationkey * 10 AS INT) AS left_, CAST(7 AS INT) AS top_, CAST(8 AS INT) AS width, CAST(9 AS INT) AS height, CAST(90 - n_nationkey AS DOUBLE) AS confidence, 'p1_b2_par3_l' || n_regionkey AS parent_id
FROM nation, (SELECT 1 AS k) WHERE 90 - n_nationkey >= 75""")
def ocr_tsv_words(spark, d):
    row = F.concat_ws("\t", F.lit("5"), F.lit("1"), F.lit("2"), F.lit("3"), F.col("n_regionkey").cast("string"), F.lit("0"), (F.col("n_nationkey") * 10).cast("string"), F.lit("7"), F.lit("8"), F.lit("9"), (90 - F.col("n_nationkey")).cast("string"), "n_name")
    text = F.concat(F.lit("level\tpage\n"), row, F.lit("\n4\t1\t2\t3\t4\t5\t6\t7\t8\t9\t99\tline\n5\tshort"))
    return ocr.tsv_words(table(spark, d, "nation").withColumn("tsv", text), "n_nationkey", "tsv", 75.0)


# Geometry: boxes made of part and line numbers.
BOXES = "b AS (SELECT p_partkey AS k, CAST(p_partkey % 17 AS DOUBLE) AS a_x0, CAST(p_partkey % 11 AS DOUBLE) AS a_y0, CAST(p_partkey % 17 + 4 AS DOUBLE) AS a_x1, CAST(p_partkey % 11 + 3 AS DOUBLE) AS a_y1, CAST(p_partkey % 13 AS DOUBLE) AS b_x0, CAST(p_partkey % 7 AS DOUBLE) AS b_y0, CAST(p_partkey % 13 + p_size % 6 AS DOUBLE) AS b_x1, CAST(p_partkey % 7 + 5 AS DOUBLE) AS b_y1 FROM part)"


def _boxes(spark, d):
    p, s = F.col("p_partkey"), F.col("p_size")
    f = lambda c, n: c.cast("double").alias(n)
    return table(spark, d, "part").select(p.alias("k"), f(p % 17, "a_x0"), f(p % 11, "a_y0"), f(p % 17 + 4, "a_x1"), f(p % 11 + 3, "a_y1"), f(p % 13, "b_x0"), f(p % 7, "b_y0"), f(p % 13 + s % 6, "b_x1"), f(p % 7 + 5, "b_y1"))


def _area(a: str, grow: str = "0") -> str:
    return f"(greatest({a}_x1 - {a}_x0 + 2 * {grow}, 0) * greatest({a}_y1 - {a}_y0 + 2 * {grow}, 0))"


def _shared(ga: str = "0", gb: str = "0") -> str:
    return f"(greatest(least(a_x1 + {ga}, b_x1 + {gb}) - greatest(a_x0 - {ga}, b_x0 - {gb}), 0) * greatest(least(a_y1 + {ga}, b_y1 + {gb}) - greatest(a_y0 - {ga}, b_y0 - {gb}), 0))"


def _iou(ga: str = "0", gb: str = "0") -> str:
    union = f"({_area('a', ga)} + {_area('b', gb)} - {_shared(ga, gb)})"
    return f"CASE WHEN {union} <= 0 THEN 0.0 ELSE {_shared(ga, gb)} / {union} END"


GROW = [f"(0.2 * greatest(least({p}_x1 - {p}_x0, {p}_y1 - {p}_y0), 0))" for p in "ab"]


@R.query("box_algebra", f"""WITH {BOXES} SELECT k, round({_iou()}, 9) AS iou, round({_iou(*GROW)}, 9) AS relaxed, round(CASE WHEN {_area('a')} <= 0 THEN 0.0 ELSE {_shared()} / {_area('a')} END, 9) AS share,
  abs((a_x0 + a_x1 - b_x0 - b_x1) / 2) * 5 + abs((a_y0 + a_y1 - b_y0 - b_y1) / 2) AS distance, b_x0 >= a_x0 AND b_x1 <= a_x1 AND b_y0 >= a_y0 AND b_y1 <= a_y1 AS contains,
  (least(a_x1, b_x1) - greatest(a_x0, b_x0) >= 0 AND least(a_y1, b_y1) - greatest(a_y0, b_y0) >= 0 AND (least(a_x1, b_x1) - greatest(a_x0, b_x0)) + (least(a_y1, b_y1) - greatest(a_y0, b_y0)) > 0) AS overlaps, least(a_x0, b_x0) AS x0, greatest(a_y1, b_y1) AS y1,
  (((a_x0 BETWEEN b_x0 - 1 AND b_x1 + 1) OR (a_x1 BETWEEN b_x0 - 1 AND b_x1 + 1)) AND ((a_y0 BETWEEN b_y0 - 1 AND b_y1 + 1) OR (a_y1 BETWEEN b_y0 - 1 AND b_y1 + 1))) OR (((b_x0 BETWEEN a_x0 - 1 AND a_x1 + 1) OR (b_x1 BETWEEN a_x0 - 1 AND a_x1 + 1)) AND ((b_y0 BETWEEN a_y0 - 1 AND a_y1 + 1) OR (b_y1 BETWEEN a_y0 - 1 AND a_y1 + 1))) AS neighbours FROM b""")
def box_algebra(spark, d):
    a, b = G.box("a"), G.box("b")
    m = G.merged(a, b)
    return _boxes(spark, d).select("k", F.round(G.iou(a, b), 9).alias("iou"), F.round(G.relaxed_iou(a, b, 0.2), 9).alias("relaxed"), F.round(G.share(a, b), 9).alias("share"), G.weighted_distance(a, b).alias("distance"), G.contains(a, b).alias("contains"), G.overlaps(a, b).alias("overlaps"), m[0].alias("x0"), m[3].alias("y1"), G.are_neighbours(a, b, 1, 1).alias("neighbours"))


@R.query("gap_clusters", """WITH s AS (SELECT l_returnflag, l_orderkey, l_linenumber, l_extendedprice, CASE WHEN l_extendedprice - lag(l_extendedprice) OVER (PARTITION BY l_returnflag ORDER BY l_extendedprice) > 1.5 THEN 1 ELSE 0 END AS s FROM lineitem)
SELECT l_returnflag, l_orderkey, l_linenumber, CAST(sum(s) OVER (PARTITION BY l_returnflag ORDER BY l_extendedprice) AS INT) AS cluster FROM s""")
def gap_clusters(spark, d):
    return G.gap_clusters(table(spark, d, "lineitem"), ["l_returnflag"], "l_extendedprice", 1.5).select("l_returnflag", "l_orderkey", "l_linenumber", "cluster")


EDGES = "e AS (SELECT CAST(l_suppkey AS BIGINT) AS page, CASE WHEN l_linenumber % 2 = 0 THEN 'h' ELSE 'v' END AS orientation, l_quantity * 6 AS place, l_linenumber * 3.0 AS low, l_linenumber * 3.0 + l_quantity * 4 AS high FROM lineitem)"
SNAPPED = """c AS (SELECT *, CASE WHEN place - lag(place) OVER (PARTITION BY page, orientation ORDER BY place) > 3 THEN 1 ELSE 0 END AS s FROM e), g AS (SELECT *, sum(s) OVER (PARTITION BY page, orientation ORDER BY place) AS g FROM c),
sn AS (SELECT page, orientation, avg(place) OVER (PARTITION BY page, orientation, g) AS place, low, high FROM g)"""


def _edges(spark, d):
    n = F.col("l_linenumber")
    return table(spark, d, "lineitem").select(F.col("l_suppkey").cast("long").alias("page"), F.when(n % 2 == 0, "h").otherwise("v").alias("orientation"), (F.col("l_quantity") * 6).alias("place"), (n * 3.0).alias("low"), (n * 3.0 + F.col("l_quantity") * 4).alias("high"))


@R.query("snap_edges", f"WITH {EDGES}, {SNAPPED} SELECT page, orientation, round(place, 6) AS place, low, high FROM sn")
def snap_edges(spark, d):
    return G.snap_edges(_edges(spark, d), "page").select("page", "orientation", F.round("place", 6).alias("place"), "low", "high")


MERGED = """m AS (SELECT *, max(high) OVER (PARTITION BY page, orientation, place ORDER BY low, high ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM e),
r AS (SELECT *, sum(CASE WHEN low > reach + 3 THEN 1 ELSE 0 END) OVER (PARTITION BY page, orientation, place ORDER BY low, high ROWS UNBOUNDED PRECEDING) AS run FROM m), mg AS (SELECT page, orientation, place, min(low) AS low, max(high) AS high FROM r GROUP BY page, orientation, place, run)"""


@R.query("merge_edges", f"WITH {EDGES}, {MERGED} SELECT page, orientation, place, low, high FROM mg")
def merge_edges(spark, d):
    return G.merge_edges(_edges(spark, d), "page")


@R.query("edge_crossings", f"WITH {EDGES}, {MERGED} SELECT v.page, v.place AS x, h.place AS y FROM mg v JOIN mg h ON v.page = h.page AND v.orientation = 'v' AND h.orientation = 'h' AND v.low <= h.place + 3 AND v.high >= h.place - 3 AND v.place BETWEEN h.low - 3 AND h.high + 3")
def edge_crossings(spark, d):
    return G.intersections(G.merge_edges(_edges(spark, d), "page"), "page").select("page", "x", "y")


@R.query("table_cells")
def table_cells(spark, d):
    return G.tables_of_cells(G.cells(G.intersections(G.merge_edges(_edges(spark, d), "page"), "page"), "page"), "page")


CHARS = "c AS (SELECT CAST(n_regionkey AS BIGINT) AS page, n_nationkey AS line, CAST(i * 5 + CASE WHEN i >= 4 THEN 10 ELSE 0 END AS DOUBLE) AS x, substring(n_name, CAST(i AS INT), 1) AS ch FROM (SELECT *, unnest(range(1, length(n_name) + 1)) AS i FROM nation))"


@R.query("words_of_characters", f"""WITH {CHARS}, f AS (SELECT *, regexp_matches(ch, '^\\s$') AS b FROM c), n AS (SELECT *, CASE WHEN lag(b) OVER w OR x - lag(x + 5) OVER w > 3 THEN 1 ELSE 0 END AS n FROM f WINDOW w AS (PARTITION BY page, line ORDER BY x)),
r AS (SELECT *, sum(n) OVER (PARTITION BY page, line ORDER BY x) AS wd FROM n), g AS (SELECT page, line, string_agg(ch, '' ORDER BY x) AS text, min(x) AS x0, max(x + 5) AS x1 FROM r WHERE NOT b GROUP BY page, line, wd)
SELECT page, line, CAST(row_number() OVER (PARTITION BY page, line ORDER BY x0) - 1 AS INT) AS word_index, text, x0, x1 FROM g""")
def words_of_characters(spark, d):
    n = table(spark, d, "nation")
    chars = n.select(F.col("n_regionkey").cast("long").alias("page"), F.col("n_nationkey").alias("line"), F.posexplode(F.split("n_name", "")).alias("i", "ch")).where("ch <> ''")
    i = F.col("i") + 1
    return G.words_of_characters(chars.select("page", "line", (i * 5 + F.when(i >= 4, 10).otherwise(0)).cast("double").alias("x"), F.lit(5.0).alias("width"), "ch"), "page")


@R.query("font_levels")
def font_levels(spark, d):
    rows = table(spark, d, "lineitem").select((F.col("l_orderkey") % 50).alias("doc"), (8 + (F.col("l_linenumber") % 7) * 2.5 + F.col("l_discount")).alias("size"))
    return G.font_levels(rows, "doc", "size")


@R.query("heading_levels", """WITH g AS (SELECT CAST(l_orderkey % 20 AS BIGINT) AS doc, l_linenumber * 2.0 AS centroid, count(*) AS members FROM lineitem GROUP BY 1, 2),
b AS (SELECT doc, arg_max(centroid, (members, -centroid)) AS body FROM g GROUP BY doc)
SELECT g.doc, centroid, members, CASE WHEN centroid > body AND row_number() OVER (PARTITION BY g.doc ORDER BY centroid DESC) <= 6 THEN CAST(row_number() OVER (PARTITION BY g.doc ORDER BY centroid DESC) AS INT) END AS level FROM g JOIN b ON g.doc = b.doc""")
def heading_levels(spark, d):
    """Levels of given clusters: the fullest is body, larger ones are headings."""
    from pyspark.sql import Window

    g = table(spark, d, "lineitem").groupBy((F.col("l_orderkey") % 20).alias("doc"), (F.col("l_linenumber") * 2.0).alias("centroid")).agg(F.count(F.lit(1)).alias("members"))
    body = g.groupBy("doc").agg(F.max_by("centroid", F.struct("members", -F.col("centroid"))).alias("body"))
    rank = F.row_number().over(Window.partitionBy("doc").orderBy(F.desc("centroid")))
    return g.join(body, "doc").withColumn("r", rank).select("doc", "centroid", "members", F.when((F.col("centroid") > F.col("body")) & (F.col("r") <= 6), F.col("r")).alias("level"))


def _dpi_side(pixels: str) -> str:
    return f"least(CASE WHEN w > 0 THEN round({pixels} / w) ELSE 300 END, CASE WHEN h > 0 THEN round({pixels} / h) ELSE 300 END)"


@R.query("smart_dpi", f"""SELECT k, CAST(greatest(72, least(300, {_dpi_side('26755.0')}, CASE WHEN greatest(round(w * 300), round(h * 300)) > 4096 THEN {_dpi_side('4096.0')} ELSE 300 END)) AS INT) AS dpi
FROM (SELECT p_partkey AS k, p_size * 40 / 72.0 AS w, p_retailprice / 72.0 AS h FROM part)""")
def smart_dpi(spark, d):
    return table(spark, d, "part").select(F.col("p_partkey").alias("k"), G.smart_dpi(F.col("p_size") * 40.0, F.col("p_retailprice"), 300, 4096).alias("dpi"))


SIDES = """s AS (SELECT k % 50 AS page, unnest([{'o': 'h', 'p': a_y0, 'l': a_x0, 'h': a_x1}, {'o': 'h', 'p': a_y1, 'l': a_x0, 'h': a_x1}, {'o': 'v', 'p': a_x0, 'l': a_y0, 'h': a_y1}, {'o': 'v', 'p': a_x1, 'l': a_y0, 'h': a_y1}]) AS e FROM b)"""


@R.query("box_edges", f"""WITH {BOXES}, {SIDES}, c AS (SELECT page, e.o AS orientation, e.p AS place, greatest(e.l, CASE WHEN e.o = 'h' THEN 2.0 ELSE 1.0 END) AS low, least(e.h, CASE WHEN e.o = 'h' THEN 15.0 ELSE 9.0 END) AS high FROM s WHERE e.h - e.l >= 4 AND e.p BETWEEN CASE WHEN e.o = 'h' THEN 1.0 ELSE 2.0 END AND CASE WHEN e.o = 'h' THEN 9.0 ELSE 15.0 END)
SELECT * FROM c WHERE low < high""")
def box_edges(spark, d):
    """Sides of boxes, the short ones left out, the others cut to a region."""
    sides = G.box_edges(_boxes(spark, d).withColumn("page", F.col("k") % 50), "page", "a")
    return G.clip_edges(G.filter_edges(sides, 4.0), 2.0, 1.0, 15.0, 9.0)


@R.query("edges_of_words", f"""WITH {BOXES}, s AS (SELECT k % 50 AS page, a_x0 * 5 AS x0, a_y0, a_y1 FROM b), g AS (SELECT *, CASE WHEN x0 - lag(x0) OVER (PARTITION BY page ORDER BY x0) > 3 THEN 1 ELSE 0 END AS s FROM s),
c AS (SELECT *, sum(s) OVER (PARTITION BY page ORDER BY x0) AS c FROM g) SELECT page, 'v' AS orientation, min(x0) AS place, min(a_y0) AS low, max(a_y1) AS high FROM c GROUP BY page, c HAVING count(*) >= 3""")
def edges_of_words(spark, d):
    words = _boxes(spark, d).select((F.col("k") % 50).alias("page"), (F.col("a_x0") * 5).alias("x0"), F.col("a_y0").alias("y0"), F.col("a_y1").alias("y1"))
    return G.edges_of_words(words, "page")


@R.query("nearest_centre", "SELECT p_partkey, CAST([10.0, 24.0, 40.0][list_position(list_transform([10.0, 24.0, 40.0], lambda c: abs(p_size - c)), list_min(list_transform([10.0, 24.0, 40.0], lambda c: abs(p_size - c))))] AS DOUBLE) AS centre FROM part")
def nearest_centre(spark, d):
    return G.nearest_centre(table(spark, d, "part"), "p_size", [10.0, 24.0, 40.0]).select("p_partkey", "centre")


MD_LINKS = r"\[([^\]]+)\]\(([^)]+)\)"


@R.query("markdown_links", f"""SELECT doc_id, unnest(regexp_extract_all(t, '{MD_LINKS}', 1)) AS label, unnest(regexp_extract_all(t, '{MD_LINKS}', 2)) AS target FROM (SELECT doc_id, text || ' [a ' || doc_id || '](http://x/' || doc_id || ') and [b](#c)' AS t FROM documents)""")
def markdown_links(spark, d):
    t = F.concat("text", F.lit(" [a "), F.col("doc_id").cast("string"), F.lit("](http://x/"), F.col("doc_id").cast("string"), F.lit(") and [b](#c)"))
    both = F.arrays_zip(F.regexp_extract_all(t, F.lit(MD_LINKS), F.lit(1)).alias("label"), F.regexp_extract_all(t, F.lit(MD_LINKS), F.lit(2)).alias("target"))
    return table(spark, d, "documents").select("doc_id", F.explode(both).alias("x")).select("doc_id", F.col("x.label").alias("label"), F.col("x.target").alias("target"))


@R.query("csv_delimiters", "SELECT n_nationkey, CASE n_nationkey % 4 WHEN 0 THEN ',' WHEN 1 THEN chr(9) WHEN 2 THEN '|' ELSE ';' END AS delimiter, 2 AS n_rows FROM nation")
def csv_delimiters(spark, d):
    from quire.sources.formats import csv_rows, delimiter_of

    @F.pandas_udf("struct<delimiter:string, n_rows:int>")
    def sniff(texts: pd.Series) -> pd.DataFrame:
        found = [delimiter_of(t) for t in texts]
        return pd.DataFrame({"delimiter": found, "n_rows": [len(csv_rows(t, x)) for t, x in zip(texts, found, strict=True)]}).astype({"n_rows": "int32"})

    sep = F.element_at(F.array(*[F.lit(x) for x in ",\t|;"]), (F.col("n_nationkey") % 4 + 1).cast("int"))
    text = F.concat(F.lit("name"), sep, F.lit("key\n"), "n_name", sep, F.col("n_nationkey").cast("string"), F.lit("\n"), sep, F.lit("\n"))
    return table(spark, d, "nation").select("n_nationkey", sniff(text).alias("s")).select("n_nationkey", "s.*")
