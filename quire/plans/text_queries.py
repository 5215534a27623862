"""Queries of text measures, cleaning and quality, with their oracle SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.functions import quality as Q
from quire.functions import text as T
from quire.plans.base import Registry, table

R = Registry()
#: Appended so that each pattern has something to find.
SUFFIX = " x  y  z ... ___ --- , 1 a1b2   Home > Home > Page 3 of 9 Back to top function f(a) { b } .cls { c }   e"
RULES = "\n| a | b |\n|---|:--|\n--- x ----\n\n\n  two  \n \n\tthree"


def _docs(spark, d) -> DataFrame:
    return table(spark, d, "documents").withColumn("derived", F.concat(F.coalesce("text", F.lit("")), F.lit(SUFFIX)))


DOCS = f"(SELECT *, coalesce(text, '') || '{SUFFIX}' AS derived FROM documents)"


def sub(e: str, pattern: str, to: str) -> str:
    return f"regexp_replace({e}, '{pattern}', '{to}', 'g')"


def size_of(e: str, pattern: str) -> str:
    return f"coalesce(list_sum(list_transform(regexp_extract_all({e}, '{pattern}'), lambda m: strlen(m))), 0)"


def sql_words(e: str) -> str:
    return f"list_filter(regexp_split_to_array({e}, '\\s+'), lambda w: w <> '')"


def sql_lines(e: str) -> str:
    body = sub(f"replace({e}, chr(13) || chr(10), chr(10))", r"\n$", "")
    return f"(CASE WHEN {e} = '' THEN [] ELSE string_split({body}, chr(10)) END)"


@R.query("text_metrics", f"""SELECT doc_id, CAST(len({sql_lines('text')}) AS BIGINT) AS n_lines, CAST(len({sql_words('text')}) AS BIGINT) AS n_words,
  CAST(strlen(text) AS BIGINT) AS n_bytes, CAST(length(text) AS BIGINT) AS n_characters FROM documents""")
def text_metrics(spark, d):
    t = F.col("text")
    return table(spark, d, "documents").select("doc_id", T.line_count(t).alias("n_lines"), T.word_count(t).alias("n_words"), F.octet_length(t).cast("long").alias("n_bytes"), F.char_length(t).cast("long").alias("n_characters"))


def _ocr(e: str) -> str:
    dashes = f"coalesce(list_sum(list_transform({sql_lines(e)}, lambda x: CASE WHEN regexp_matches(trim(x), '{T.TABLE_RULE}') THEN 0 ELSE {size_of('x', T.DASHES)} END)), 0)"
    return f"(CASE WHEN contains({e}, '  ') OR contains({e}, '...') THEN least(1.0, ({size_of(e, T.OCR_ARTEFACT)} + {dashes}) / CAST(strlen({e}) AS DOUBLE)) ELSE 0.0 END)"


def _script(e: str) -> str:
    total = " + ".join(size_of(e, p) for p in (T.JS_FUNCTION, T.CSS_RULE, T.SCRIPT_TAG, T.STYLE_TAG))
    return f"(CASE WHEN contains({e}, 'function') OR contains({e}, '<script') OR contains({e}, '<style') THEN least(1.0, ({total}) / CAST(strlen({e}) AS DOUBLE)) ELSE 0.0 END)"


def _nav(e: str) -> str:
    total = " + ".join(size_of(e, p) for p in (T.NAVIGATION, T.BREADCRUMB, T.PAGINATION))
    return f"(CASE WHEN {e} = '' THEN 0.0 ELSE least(1.0, ({total}) / CAST(strlen({e}) AS DOUBLE)) END)"


def _structure(e: str) -> str:
    n = f"len({sql_words(e)})"
    sentences = f"greatest(1, len(regexp_extract_all({e}, '{T.SENTENCE_BREAK}')))"
    paragraphs = f"(len(regexp_extract_all({e}, '\\n\\n')) + 1)"
    return f"""(CASE WHEN {n} = 0 THEN 0.0 ELSE least(1.0, CASE WHEN {n} / {sentences} BETWEEN 10 AND 30 THEN 0.3 ELSE 0.0 END
      + CASE WHEN {n} / {paragraphs} BETWEEN 50 AND 300 THEN 0.3 ELSE 0.0 END + CASE WHEN {paragraphs} > 1 THEN 0.2 ELSE 0.0 END
      + CASE WHEN regexp_matches({e}, '[.!?]') THEN 0.2 ELSE 0.0 END) END)"""


def sql_quality(e: str) -> str:
    return f"""(CASE WHEN trim({sub(e, r'\s+', ' ')}) = '' THEN 0.0 WHEN strlen({e}) < 10 THEN 0.1 ELSE greatest(0.0, least(1.0, 1.0 - {_ocr(e)} * 0.3 + {_structure(e)} * 0.2
      - CASE WHEN strlen({e}) > 1000 THEN {_script(e)} * 0.2 + {_nav(e)} * 0.1 ELSE 0.0 END)) END)"""


def _measure(name: str, measure, sql: str, source: str = "derived") -> None:
    frame = DOCS if source == "derived" else "(SELECT page_id AS doc_id, html AS derived FROM pages)"

    @R.query(name, f"SELECT doc_id, round(CAST({sql.replace('$E', 'derived')} AS DOUBLE), 9) AS value FROM {frame}")
    def run(spark, d):
        rows = _docs(spark, d) if source == "derived" else table(spark, d, "pages").select(F.col("page_id").alias("doc_id"), F.col("html").alias("derived"))
        return rows.select("doc_id", F.round(measure(F.col("derived")).cast("double"), 9).alias("value"))


_measure("quality_ocr_penalty", Q.ocr_penalty, _ocr("$E"))
_measure("quality_script_penalty", Q.script_penalty, _script("$E"))
_measure("quality_script_penalty_pages", Q.script_penalty, _script("$E"), "pages")
_measure("quality_navigation_penalty", Q.navigation_penalty, _nav("$E"))
_measure("quality_structure_bonus", Q.structure_bonus, _structure("$E"))
_measure("quality_score", Q.quality_score, sql_quality("$E"))
_measure("text_confidence", T.text_confidence, f"""CASE WHEN $E = '' THEN 0.0 ELSE greatest(0.0, least(1.0, length({sub('$E', r'[^\x21-\x7e\s]+', '')}) / CAST(strlen($E) AS DOUBLE)
  - (len(regexp_extract_all($E, '{T.REPLACEMENT}')) + len(regexp_extract_all($E, '{T.CONTROL}')) * 2) / CAST(strlen($E) AS DOUBLE)
  - CASE WHEN {size_of('$E', T.CYRILLIC_RUN)} > strlen($E) * 0.1 THEN 0.3 ELSE 0.0 END)) END""")


@R.query("quality_by_source", f"SELECT lang, source, count(*) AS n_docs, round(avg({sql_quality('derived')}), 9) AS mean_quality FROM {DOCS} GROUP BY lang, source")
def quality_by_source(spark, d):
    return _docs(spark, d).groupBy("lang", "source").agg(F.count(F.lit(1)).alias("n_docs"), F.round(F.avg(Q.quality_score(F.col("derived"))), 9).alias("mean_quality"))


@R.query("quality_with_metadata", f"""SELECT doc_id, round(least(1.0, {sql_quality('text')} + CASE WHEN strlen(text) < 10 OR trim({sub('text', r'\s+', ' ')}) = '' THEN 0.0 ELSE 0.1 * (2 + CAST(lang = 'en' AS INT)) / 5.0 END), 9) AS value FROM documents""")
def quality_with_metadata(spark, d):
    """The metadata bonus, with title and author, and keywords for English texts."""
    fields = F.when(F.col("lang") == "en", F.create_map(*[F.lit(x) for x in ("title", "", "author", "", "keywords", "")])).otherwise(F.create_map(*[F.lit(x) for x in ("title", "", "author", "")]))
    return table(spark, d, "documents").select("doc_id", F.round(Q.quality_score(F.col("text"), fields), 9).alias("value"))


def _clean(name: str, clean, sql: str, extra: str = "", frame: str = DOCS) -> None:
    source = "derived || '" + extra.replace("\n", "' || chr(10) || '").replace("\t", "' || chr(9) || '") + "'" if extra else "derived"

    @R.query(name, f"SELECT doc_id, {sql.replace('$E', f'({source})')} AS cleaned FROM {frame}")
    def run(spark, d):
        rows = _docs(spark, d) if frame == DOCS else table(spark, d, "pages").select(F.col("page_id").alias("doc_id"), F.col("html").alias("derived"))
        return rows.select("doc_id", clean(F.concat("derived", F.lit(extra)) if extra else F.col("derived")).alias("cleaned"))


PAGES = "(SELECT page_id AS doc_id, html AS derived FROM pages)"
_chain = lambda e, *ps: _chain(sub(e, ps[0], " "), *ps[1:]) if ps else e
_dash = lambda e: f"(CASE WHEN regexp_matches({e}, '{T.DASHES}') THEN array_to_string(list_transform({sql_lines(e)}, lambda x: CASE WHEN regexp_matches(trim(x), '{T.TABLE_RULE}') THEN x ELSE {sub('x', T.DASHES, '...')} END), chr(10)) ELSE {e} END)"
_ocr_clean = lambda e: _chain(sub(_dash(e), T.REPEATED_PUNCTUATION, "..."), T.ISOLATED_PUNCTUATION, T.MALFORMED_WORD, T.EXCESSIVE_SPACE)
_space = lambda e: sub(sub(e, T.BLANKS, " "), T.BLANK_LINES, r"\n\n").replace(r"'\n\n', 'g'", "chr(10) || chr(10), 'g'")
_scripts = lambda e: _chain(e, T.SCRIPT_TAG, T.STYLE_TAG, T.JS_FUNCTION, T.CSS_RULE)
_navigation = lambda e: _chain(e, T.NAVIGATION, T.BREADCRUMB, T.PAGINATION)
_clean("clean_scripts", T.clean_scripts, _scripts("$E"))
_clean("clean_scripts_pages", T.clean_scripts, _scripts("$E"), frame=PAGES)
_clean("clean_navigation", T.clean_navigation, _navigation("$E"))
_clean("clean_dashes_keep_tables", T.clean_dashes, _dash("$E"), RULES)
_clean("clean_ocr_artefacts", T.clean_ocr, _ocr_clean("$E"), RULES)
_clean("normalize_whitespace", T.normalize_whitespace, _space("$E"), RULES)
_clean("clean_extracted_text", T.clean_extracted, f"trim({_space(_navigation(_ocr_clean(_scripts('$E'))))})", RULES)
_clean("clean_repeated_punctuation", T.clean_repeated_punctuation, sub("$E", r"([!?.,])[!?.,]+", r"\1"), " a!!?? b.., c")
_clean("clean_same_punctuation", T.clean_same_punctuation, sub(sub(sub("$E", "!{2,}", "!"), r"\?{2,}", "?"), ",{2,}", ","), " a!!?? b,,, c")
_clean("normalize_spaces", T.normalize_spaces, f"""array_to_string(list_filter(list_transform(string_split($E, chr(10) || chr(10)), lambda p:
  array_to_string(list_filter(list_transform(regexp_split_to_array({sub('p', T.BLANKS, ' ')}, '\\n+'), lambda x: trim(x)), lambda x: x <> ''), chr(10))), lambda p: p <> ''), chr(10) || chr(10))""", RULES)
_clean("escape_html", T.escape_html, "replace(replace(replace(replace(replace($E, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '\"', '&quot;'), '''', '&#39;')", frame=PAGES)
_clean("strip_comments", T.strip_comments, sub("$E", T.HTML_COMMENT, ""), frame=PAGES)
_clean("html_text", T.strip_html, f"trim({sub(sub(sub(sub('$E', T.SCRIPT_TAG, ''), T.STYLE_TAG, ''), T.HTML_TAG, ' '), r'\s+', ' ')})", frame=PAGES)


@R.query("fix_mojibake", f"SELECT doc_id, {sub(sub(sub('(text || chr(1) || chr(65533) || chr(769) || chr(127))', T.CONTROL, ''), T.REPLACEMENT, ''), T.COMBINING, '')} AS cleaned FROM documents")
def fix_mojibake(spark, d):
    return table(spark, d, "documents").select("doc_id", T.fix_mojibake(F.concat("text", F.lit("\x01�́\x7f"))).alias("cleaned"))


@R.query("strip_control", f"SELECT doc_id, {sub('(text || chr(1) || chr(9) || chr(127))', r'[\x00-\x08\x0b\x0c\x0e-\x1f\x7f]', '')} AS cleaned FROM documents")
def strip_control(spark, d):
    return table(spark, d, "documents").select("doc_id", T.strip_control(F.concat("text", F.lit("\x01\t\x7f"))).alias("cleaned"))


@R.query("blank_pages", f"SELECT doc_id, length({sub('text', r'\s+', '')}) < 3 AS is_blank FROM documents")
def blank_pages(spark, d):
    return table(spark, d, "documents").select("doc_id", T.is_blank_page(F.col("text")).alias("is_blank"))


@R.query("utf8_boundaries", "SELECT doc_id, CAST(k AS INT) AS byte_offset, substr(h, CAST(2 * k + 1 AS INT), 1) IN ('8', '9', 'A', 'B') AS splits FROM (SELECT doc_id, hex(encode(text)) AS h, unnest(range(0, strlen(text) + 1, 37)) AS k FROM documents)")
def utf8_boundaries(spark, d):
    """Whether byte offsets, one in 37 throughout each text, fall inside a character."""
    offsets = F.sequence(F.lit(0), F.octet_length("text"), F.lit(37))
    rows = table(spark, d, "documents").select("doc_id", "text", F.explode(offsets).alias("byte_offset"))
    return rows.select("doc_id", "byte_offset", T.splits_character(F.col("text"), F.col("byte_offset")).alias("splits"))
