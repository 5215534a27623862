"""Queries of token reduction."""

from __future__ import annotations

from pyspark.sql import functions as F

from quire.functions import reduction as X
from quire.plans.base import Registry, table
from quire.plans.text_queries import sql_words, sub

R = Registry()
#: Words of the dictionaries, capitals, digits and marks, so that each rule has something to do.
SUFFIX = " The analysis of API data by car 42x!! book?? <!-- gone -->  see optimization IMPORTANT."
DOCS = f"(SELECT doc_id, lang, text || '{SUFFIX}' AS text FROM documents)"
SHORT = f"(SELECT doc_id, lang, text || '{SUFFIX}' AS text FROM documents)"


def _docs(spark, d):
    return table(spark, d, "documents").select("doc_id", "lang", F.concat("text", F.lit(SUFFIX)).alias("text"))


LIGHT = sub(sub(sub(sub("text", r"([!?.,])[!?.,]+", r"\1"), r"(?s)<!--.*?-->", ""), " {2,}", " "), r"\n{3,}", "@@").replace("'@@'", "chr(10) || chr(10)")
CORE = "lower(regexp_replace(w, '[^\\p{L}]', '', 'g'))"
STOP = "[" + ", ".join(f"'{w}'" for w in X.STOPWORDS["en"]) + "]"
KEEP = f"regexp_matches(w, '^[^a-z\\x{{80}}-\\x{{10ffff}}]{{2,}}$') OR regexp_matches(w, '[0-9]') OR strlen({CORE}) <= 1 OR NOT list_contains({STOP}, {CORE})"
MODERATE = f"array_to_string(list_filter({sql_words(LIGHT)}, lambda w: {KEEP}), ' ')"


@R.query("reduce_light", f"SELECT doc_id, {LIGHT} AS reduced FROM {DOCS}")
def reduce_light(spark, d):
    return _docs(spark, d).select("doc_id", X.light(F.col("text")).alias("reduced"))


@R.query("reduce_stopwords", f"SELECT doc_id, {MODERATE} AS reduced FROM {DOCS}")
def reduce_stopwords(spark, d):
    return _docs(spark, d).select("doc_id", X.moderate(F.col("text"), X.STOPWORDS["en"]).alias("reduced"))


@R.query("reduce_stats", f"""SELECT doc_id, round(1.0 - length(r) / CAST(length(text) AS DOUBLE), 9) AS character_reduction, round(1.0 - len({sql_words('r')}) / CAST(len({sql_words('text')}) AS DOUBLE), 9) AS token_reduction,
  length(text) AS original_characters, length(r) AS reduced_characters, CAST(len({sql_words('text')}) AS BIGINT) AS original_tokens, CAST(len({sql_words('r')}) AS BIGINT) AS reduced_tokens FROM (SELECT doc_id, text, {MODERATE} AS r FROM {DOCS})""")
def reduce_stats(spark, d):
    x = _docs(spark, d).withColumn("r", X.moderate(F.col("text"), X.STOPWORDS["en"]))
    first, second, *rest = X.statistics(F.col("text"), F.col("r"))
    return x.select("doc_id", F.round(first, 9).alias("character_reduction"), F.round(second, 9).alias("token_reduction"), *rest)


FORM = "((strlen(w) > 1 AND regexp_matches(w, '^\\p{Lu}+$')) OR regexp_matches(w, '\\p{N}') OR strlen(w) > 10 OR (length(regexp_replace(w, '[^\\p{Lu}]', '', 'g')) > 1 AND length(regexp_replace(w, '[^\\p{Lu}]', '', 'g')) < strlen(w)))"


@R.query("reduce_common_words", f"""WITH s AS (SELECT doc_id, text, {sql_words('text')} AS ws FROM {DOCS}), e AS (SELECT doc_id, unnest(ws) AS w, unnest(range(len(ws))) AS k FROM s),
f AS (SELECT *, {CORE} AS c FROM e), g AS (SELECT *, count(*) OVER (PARTITION BY doc_id, c) AS freq, count(*) OVER (PARTITION BY doc_id) AS total, avg(CASE WHEN c <> '' THEN length(c) END) OVER (PARTITION BY doc_id) AS mean FROM f),
h AS (SELECT *, c = '' OR {FORM} OR (freq <= 2 AND length(c) >= mean * 0.8) OR length(c) >= mean * 1.5 AS keep, c = '' OR length(c) >= 3 OR {FORM} AS spare FROM g),
r AS (SELECT doc_id, CASE WHEN count(*) FILTER (keep) < any_value(total) // 3 THEN coalesce(string_agg(w, ' ' ORDER BY k) FILTER (spare), '') ELSE coalesce(string_agg(w, ' ' ORDER BY k) FILTER (keep), '') END AS reduced, any_value(total) AS total FROM h GROUP BY doc_id)
SELECT s.doc_id, CASE WHEN coalesce(total, 0) < 4 THEN s.text ELSE reduced END AS reduced FROM s LEFT JOIN r USING (doc_id)""")
def reduce_common_words(spark, d):
    return X.remove_common_words(_docs(spark, d))


SENT = "list_filter(list_transform(regexp_split_to_array(text, '[.!?]'), lambda s: trim(regexp_replace(s, '^\\s+|\\s+$', '', 'g'))), lambda s: s <> '')"
CHARS = "regexp_extract_all(lower(sentence), '(?s).')"
ENTROPY = "(SELECT least(5.0, -sum(p * log2(p))) FROM (SELECT count(*) / CAST(sum(count(*)) OVER () AS DOUBLE) AS p FROM (SELECT unnest(" + CHARS + ") AS ch) GROUP BY ch))"
SCORED = f"""a AS (SELECT doc_id, text, {SENT} AS s FROM {SHORT}), b AS (SELECT doc_id, CAST(unnest(range(len(s))) AS INT) AS k, unnest(s) AS sentence, len(s) AS n FROM a),
c AS (SELECT *, {sql_words('sentence')} AS ws FROM b),
sc AS (SELECT doc_id, k, sentence, n, round(CASE WHEN k = 0 OR k = n - 1 THEN 0.3 ELSE 0.0 END + CASE WHEN len(ws) BETWEEN 3 AND 25 THEN 0.2 ELSE 0.0 END
  + len(list_filter(ws, lambda w: regexp_matches(w, '\\p{{N}}'))) / CAST(len(ws) AS DOUBLE) * 0.3 + len(list_filter(ws, lambda w: strlen(w) > 1 AND regexp_matches(w, '^\\p{{Lu}}+$'))) / CAST(len(ws) AS DOUBLE) * 0.25
  + len(list_filter(ws, lambda w: strlen(w) > 8)) / CAST(len(ws) AS DOUBLE) * 0.2 + len(regexp_extract_all(sentence, '[!-/:-@\\[-`{{-~]')) / CAST(strlen(sentence) AS DOUBLE) * 0.15
  + least(len(list_distinct(list_transform(ws, lambda w: {CORE}))), greatest(1, ceil(len(ws) * 0.6))) / CAST(len(ws) AS DOUBLE) * 0.15 + {ENTROPY} * 0.1, 6) AS score FROM c)"""


@R.query("sentence_scores", f"WITH {SCORED} SELECT doc_id, k, score FROM sc")
def sentence_scores(spark, d):
    return X.scored_sentences(_docs(spark, d)).select("doc_id", "k", "score")


@R.query("sentence_select", f"""WITH {SCORED}, r AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY score DESC, k) AS r FROM sc),
x AS (SELECT doc_id, string_agg(sentence, '. ' ORDER BY k) AS best FROM r WHERE n > 2 AND r <= ceil(n * 0.4) GROUP BY doc_id) SELECT a.doc_id, coalesce(best, a.text) AS selected FROM a LEFT JOIN x USING (doc_id)""")
def sentence_select(spark, d):
    return X.select_sentences(_docs(spark, d))


@R.query("char_entropy", f"SELECT doc_id, round({ENTROPY.replace('sentence', 'text')}, 6) AS entropy FROM {SHORT}")
def char_entropy(spark, d):
    return _docs(spark, d).select("doc_id", F.round(X.entropy(F.col("text")), 6).alias("entropy"))


BARE = "lower(regexp_replace(word, '[^\\p{L}\\p{N}]', '', 'g'))"
_tech = lambda w: f"(strlen({w}) > 6 AND (contains({w}, '_') OR length(regexp_replace({w}, '[^\\p{{Lu}}]', '', 'g')) > 1 OR regexp_matches({w}, '(tion|ment|ing)$')))"
WORDS = f"""a AS (SELECT doc_id, {sql_words('text')} AS ws FROM {SHORT}), b AS (SELECT doc_id, CAST(unnest(range(len(ws))) AS INT) AS k, unnest(ws) AS word, len(ws) AS n FROM a),
c AS (SELECT *, {BARE} AS c FROM b), e AS (SELECT *, count(*) OVER (PARTITION BY doc_id, c) AS freq, list(word) OVER (PARTITION BY doc_id ORDER BY k ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING) AS near FROM c),
ws AS (SELECT doc_id, k, word, n, c, round(coalesce(CASE c {' '.join(f"WHEN '{w}' THEN {v}" for w, v in X.IMPORTANT.items())} END, least(1.0, 0.3 + least(strlen(c) * 0.02, 0.2) + CASE WHEN regexp_matches(c, '\\p{{N}}') THEN 0.15 ELSE 0.0 END + CASE WHEN {_tech('c')} THEN 0.25 ELSE 0.0 END))
  + least(0.3, CASE WHEN k = 0 OR k = n - 1 THEN 0.1 ELSE 0.0 END + list_sum(list_transform(near, lambda w: CASE WHEN w = c THEN 0.0 WHEN {_tech('c')} AND {_tech('w')} THEN 0.05 WHEN regexp_matches(w, '^\\p{{Lu}}') THEN 0.02 ELSE 0.0 END)))
  + (ln(freq / CAST(n AS DOUBLE)) + 1) * 0.1, 6) AS importance FROM e)"""


@R.query("word_importance", f"WITH {WORDS} SELECT doc_id, k, importance FROM ws")
def word_importance(spark, d):
    return X.scored_words(_docs(spark, d)).select("doc_id", "k", "importance")


@R.query("semantic_filter", f"WITH {WORDS} SELECT doc_id, coalesce(string_agg(word, ' ' ORDER BY k) FILTER (importance >= 0.3), '') AS filtered FROM ws GROUP BY doc_id")
def semantic_filter(spark, d):
    return X.semantic_filter(_docs(spark, d))


HYPER = "CASE {b} " + " ".join(f"WHEN '{a}' THEN '{b}'" for a, b in X.HYPERNYMS.items()) + " ELSE {w} END"


@R.query("hypernyms", "SELECT doc_id, array_to_string(list_transform(" + sql_words("text") + ", lambda word: " + HYPER.replace("{b}", BARE).replace("{w}", "word") + f"), ' ') AS compressed FROM {DOCS}")
def hypernyms(spark, d):
    return _docs(spark, d).select("doc_id", X.hypernyms(F.col("text")).alias("compressed"))


@R.query("hypernyms_to_target", f"WITH {WORDS}, r AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY importance DESC, k) AS r FROM ws) SELECT doc_id, string_agg(CASE WHEN r > floor(0.5 * n) THEN {HYPER.replace('{b}', 'c').replace('{w}', 'word')} ELSE word END, ' ' ORDER BY k) AS compressed FROM r GROUP BY doc_id")
def hypernyms_to_target(spark, d):
    return X.hypernyms_to_target(_docs(spark, d), 0.5)


@R.query("cjk_tokens", f"""SELECT doc_id, array_to_string(flatten(list_transform({sql_words("(text || ' 数据分析 自然语言x ok')")}, lambda w: CASE WHEN regexp_matches(w, '[\\x{{4e00}}-\\x{{9fff}}]') THEN regexp_extract_all(w, '.{{1,2}}') ELSE [w] END)), '|') AS tokens FROM documents""")
def cjk_tokens(spark, d):
    return table(spark, d, "documents").select("doc_id", F.array_join(X.cjk_tokens(F.concat("text", F.lit(" 数据分析 自然语言x ok"))), "|").alias("tokens"))


@R.query("important_forms", f"SELECT doc_id, CAST(len(list_filter({sql_words('text')}, lambda w: {FORM})) AS INT) AS n_important FROM {DOCS}")
def important_forms(spark, d):
    from quire.functions.text import words

    return _docs(spark, d).select("doc_id", F.size(F.filter(words(F.col("text")), X.has_important_form)).alias("n_important"))


MD = ["# The Title of it", "- the item", "plain is the text of it", "```", "the code is here", "```", "| the | cell |", "more of the text"]
MD_SQL = " || chr(10) || ".join(f"'{x}'" for x in MD)
_line = f"CASE WHEN regexp_matches(x, '{X.MARKDOWN_LINE}') OR trim(x) = '' THEN x ELSE array_to_string(list_filter({sql_words('x')}, lambda w: {KEEP}), ' ') END"
_part = f"array_to_string(list_transform(string_split({LIGHT.replace('(text,', '(p,')}, chr(10)), lambda x: {_line}), chr(10))"


@R.query("reduce_markdown", f"SELECT doc_id, array_to_string(list_transform(string_split(text || chr(10) || {MD_SQL}, '```'), lambda p, i: CASE WHEN i % 2 = 0 THEN p ELSE {_part} END), '```') AS reduced FROM documents")
def reduce_markdown(spark, d):
    text = F.concat("text", F.lit("\n" + "\n".join(MD)))
    return table(spark, d, "documents").select("doc_id", X.moderate_markdown(text, X.STOPWORDS["en"]).alias("reduced"))


def _then(name: str, column: str, source: str) -> str:
    """The query of that name over a source of (doc_id, text) instead of the documents; '' where it gives no row."""
    return f"(SELECT d.doc_id, coalesce(x.{column}, '') AS text FROM documents d LEFT JOIN ({R.sql[name].replace(DOCS, source)}) x USING (doc_id))"


AGGRESSIVE = f"(SELECT doc_id, {MODERATE} AS text FROM (SELECT doc_id, {LIGHT} AS text FROM {DOCS}))"
for _name, _column in (("reduce_common_words", "reduced"), ("sentence_select", "selected"), ("semantic_filter", "filtered")):
    AGGRESSIVE = _then(_name, _column, AGGRESSIVE)
MAXIMUM = _then("hypernyms_to_target", "compressed", AGGRESSIVE)


@R.query("reduce_aggressive", f"SELECT doc_id, text AS reduced FROM {AGGRESSIVE}")
def reduce_aggressive(spark, d):
    return X.reduce_tokens(_docs(spark, d), "aggressive", X.STOPWORDS["en"])


@R.query("reduce_maximum", f"SELECT doc_id, text AS reduced FROM {MAXIMUM}")
def reduce_maximum(spark, d):
    return X.reduce_tokens(_docs(spark, d), "maximum", X.STOPWORDS["en"], 0.5)
