"""Queries of sources, the extraction plan and streams over the driver's tables."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from quire.functions import decoding, ocr
from quire.plans import extraction as X
from quire.plans.base import Registry, table
from quire.plans.text_queries import sql_quality, sql_words
from quire.sources import backends, formats
from quire.streaming import stream

R = Registry()


def _files(spark, d):
    """Documents as text files, pages as HTML, events' props as JSON, and two that can't be read."""
    docs = table(spark, d, "documents").select(F.concat(F.lit("doc/"), F.col("doc_id").cast("string"), F.lit(".txt")).alias("path"), F.col("text").cast("binary").alias("data"))
    events = table(spark, d, "events").select(F.concat(F.lit("event/"), F.col("event_id").cast("string"), F.lit(".json")).alias("path"), F.col("props").cast("binary").alias("data"))
    bad = spark.createDataFrame([("bad.json", b"{oops"), ("bad.pdf", b"%PDF")], "path string, data binary")
    return docs.unionByName(events).unionByName(bad)


@R.query("extract_files", f"""SELECT 'doc/' || doc_id || '.txt' AS path, 'text/plain' AS mime_type, md5(rtrim(text, chr(10))) AS digest, CAST(len({sql_words('text')}) AS VARCHAR) AS words, CAST(NULL AS VARCHAR) AS error, round({sql_quality("rtrim(text, chr(10))")}, 9) AS quality FROM documents
UNION ALL SELECT 'event/' || event_id || '.json', 'application/json', md5('{{' || chr(10) || '  "k": ' || json_extract_string(props, '$.k') || chr(10) || '}}'), NULL, NULL, NULL FROM events
UNION ALL VALUES ('bad.json', 'application/json', NULL, NULL, 'Parsing', NULL), ('bad.pdf', 'application/pdf', NULL, NULL, 'UnsupportedFormat', NULL)""")
def extract_files(spark, d):
    x = X.extract(_files(spark, d))
    quality = F.when(F.col("mime_type") == "text/plain", F.round("quality_score", 9))
    return x.select("path", "mime_type", F.md5(F.col("content").cast("binary")).alias("digest"), F.col("metadata")["word_count"].alias("words"), F.col("error.kind").alias("error"), quality.alias("quality"))


@R.query("extract_validated", f"SELECT CASE WHEN len({sql_words('text')}) >= 100 THEN 'ok' ELSE 'long enough' END AS outcome, count(*) AS n FROM documents GROUP BY 1")
def extract_validated(spark, d):
    p = X.builtin()
    p.validator("long enough".replace(" ", "_"), 10, "CAST(metadata['word_count'] AS INT) >= 100")
    docs = _files(spark, d).where("path LIKE 'doc/%'")
    return X.extract(docs, X.Config(quality=False), p).groupBy(F.coalesce(F.replace(F.col("error.message"), F.lit("_"), F.lit(" ")), F.lit("ok")).alias("outcome")).agg(F.count(F.lit(1)).alias("n"))


def _long_only(data: bytes) -> formats.Record:
    record = formats.plain(data)
    if int(record.metadata["word_count"]) < 100:
        raise formats.FormatError("short")
    return formats.Record(f"long: {record.content}", record.metadata, [])


@R.query("extract_fallback", f"""SELECT 'doc/' || doc_id || '.txt' AS path, md5(CASE WHEN long THEN 'long: ' || t ELSE t END) AS digest, CASE WHEN long THEN NULL ELSE 'long_only' END AS refused_by, CASE WHEN long THEN NULL ELSE 'FormatError: short' END AS reason
FROM (SELECT doc_id, rtrim(text, chr(10)) AS t, len({sql_words('text')}) >= 100 AS long FROM documents)""")
def extract_fallback(spark, d):
    """A first reader that refuses short texts; the next one answers for them."""
    p = X.builtin()
    p.reader("long_only", ["text/plain"], 90, _long_only)
    x = X.extract(_files(spark, d).where("path LIKE 'doc/%'"), X.Config(quality=False), p)
    return x.select("path", F.md5(F.col("content").cast("binary")).alias("digest"), F.get("warnings", F.lit(0))["source"].alias("refused_by"), F.get("warnings", F.lit(0))["message"].alias("reason"))


@R.query("windowed_stats", """SELECT time_bucket(INTERVAL 1 HOUR, ts) AS start, time_bucket(INTERVAL 1 HOUR, ts) + INTERVAL 1 HOUR AS "end", event_type, count(*) AS n, round(avg(value), 6) AS mean FROM events GROUP BY 1, 2, event_type""")
def windowed_stats(spark, d):
    x = stream.windowed_stats(table(spark, d, "events"))
    return x.select(F.col("start").cast("timestamp_ntz").alias("start"), F.col("end").cast("timestamp_ntz").alias("end"), "event_type", "n", "mean")


@R.query("session_counts", """WITH g AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) <= INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS s FROM events),
r AS (SELECT user_id, ts, sum(s) OVER (PARTITION BY user_id ORDER BY ts) AS k FROM g) SELECT user_id, min(ts) AS start, max(ts) + INTERVAL 30 MINUTE AS "end", count(*) AS n FROM r GROUP BY user_id, k""")
def session_counts(spark, d):
    x = stream.sessions(table(spark, d, "events"))
    return x.select("user_id", F.col("start").cast("timestamp_ntz").alias("start"), F.col("end").cast("timestamp_ntz").alias("end"), "n")


@R.query("stream_metrics", f"SELECT doc_id, CAST(len({sql_words('text')}) AS BIGINT) AS n_words, CAST(strlen(text) AS BIGINT) AS n_bytes, round({sql_quality('text')}, 9) AS quality_score FROM documents")
def stream_metrics(spark, d):
    """A stream over the documents' files, run to its end; the same rows as in batch."""
    schema = table(spark, d, "documents").schema
    rows = spark.readStream.schema(schema).parquet(f"{d}/documents.parquet*")
    out = f"{spark.conf.get('spark.sql.warehouse.dir')}/stream-{uuid.uuid4().hex}"
    query = stream.measured(rows).writeStream.format("parquet").option("path", f"{out}/rows").option("checkpointLocation", f"{out}/state").trigger(availableNow=True).start()
    query.awaitTermination()
    return spark.read.parquet(f"{out}/rows")


@R.query("decode_latin", "SELECT doc_id, text AS decoded FROM documents WHERE regexp_full_match(text, '(?s)[\\x20-\\x7e\\n\\xa1-\\xff]*') AND NOT regexp_full_match(text, '(?s)[\\x00-\\x7f]*')")
def decode_latin(spark, d):
    """Latin texts as ISO-8859-1 bytes, decoded by their label."""
    docs = table(spark, d, "documents").where(F.col("text").rlike(r"(?s)^[\x20-\x7e\n\xa1-\xff]*$") & ~F.col("text").rlike(r"(?s)^[\x00-\x7f]*$"))
    return docs.select("doc_id", decoding.safe_decode(F.encode("text", "iso-8859-1"), F.lit("iso-8859-1")).alias("decoded"))


SCATTERED = """WITH t AS (SELECT doc_id, text || ' 7 H e a d l i n e 5 H e 6 e n d 9' AS t FROM documents),
r AS (SELECT *, regexp_extract_all(t, '[A-Za-z][A-Za-z\\s]*') AS runs, regexp_split_to_array(t, '[A-Za-z][A-Za-z\\s]*') AS gaps FROM t WHERE regexp_full_match(t, '(?s)[\\x00-\\x7f]*')),
e AS (SELECT doc_id, k, gaps[k] AS gap, runs[k] AS run FROM (SELECT *, unnest(range(1, len(gaps) + 1)) AS k FROM r)),
l AS (SELECT *, list_filter(range(1, coalesce(length(run), 0) + 1), lambda i: run[i] > ' ') AS spots FROM e),
f AS (SELECT *, list_filter(range(1, len(spots) - 1), lambda k: length(run) - spots[k] + 1 >= 2 * (len(spots) - k + 1) - 1)[1] AS first FROM l),
j AS (SELECT doc_id, string_agg(gap || coalesce(CASE WHEN first IS NULL THEN run ELSE run[1:spots[first] - 1] || lower(array_to_string(list_transform(spots[first:], lambda i: run[i]), '')) || ' ' END, ''), '' ORDER BY k) AS collapsed FROM f GROUP BY doc_id)
SELECT * FROM j UNION ALL SELECT doc_id, t FROM t WHERE NOT regexp_full_match(t, '(?s)[\\x00-\\x7f]*')"""


@R.query("collapse_scattered", SCATTERED)
def collapse_scattered(spark, d):
    """Whole texts, with letters set apart appended; those that aren't ASCII stay as they are."""
    text = F.concat("text", F.lit(" 7 H e a d l i n e 5 H e 6 e n d 9"))
    return table(spark, d, "documents").select("doc_id", decoding.collapse_scattered(text).alias("collapsed"))


@R.query("image_headers", """SELECT doc_id, 'Image: PNG ' || (n_chars % 5000 + 1) || 'x' || (doc_id % 700 + 1) AS content, CAST(n_chars % 5000 + 1 AS VARCHAR) AS width, CAST(doc_id % 700 + 1 AS VARCHAR) AS height FROM documents""")
def image_headers(spark, d):
    """PNG headers of sizes from the documents' numbers, read without decoding."""
    four = lambda n: F.lpad(F.hex(n.cast("long")), 8, "0")
    data = F.unhex(F.concat(F.lit("89504E470D0A1A0A0000000D49484452"), four(F.col("n_chars") % 5000 + 1), four(F.col("doc_id") % 700 + 1), F.lit("0802000000")))
    files = table(spark, d, "documents").select(F.concat(F.lit("i/"), F.col("doc_id").cast("string"), F.lit(".png")).alias("path"), data.alias("data"))
    x = X.extract(files, X.Config(quality=False))
    number = F.regexp_extract("path", r"([0-9]+)\.png$", 1).cast("long")
    return x.select(number.alias("doc_id"), "content", F.col("metadata")["width"].alias("width"), F.col("metadata")["height"].alias("height"))


def _lengths(texts: list[str]) -> list[list[float]]:
    return [[float(len(t)), 1.0 + t.count("a"), 3.0] for t in texts]


@R.query("embed_texts", "SELECT doc_id, round(a / n, 9) AS a, round(b / n, 9) AS b, round(3 / n, 9) AS c FROM (SELECT *, sqrt(a * a + b * b + 9) AS n FROM (SELECT doc_id, CAST(length(text) AS DOUBLE) AS a, 1.0 + length(text) - length(replace(text, 'a', '')) AS b FROM documents))")
def embed_texts(spark, d):
    """Texts through an embedding backend, to unit length."""
    b = backends.Backends()
    b.add_embedding("lengths", 3, _lengths)
    x = backends.embedded(table(spark, d, "documents").select("doc_id", "text"), b, "lengths")
    return x.select("doc_id", *[F.round(F.col("embedding")[k], 9).alias(n) for k, n in enumerate("abc")])


def _backwards(data: bytes, language: str) -> str:
    if len(data) % 7 == 0:
        raise ValueError("seven")
    return f"{language}:{data.decode()[::-1]}"


@R.query("recognise", "SELECT doc_id, CASE WHEN strlen(text) % 7 <> 0 THEN md5('eng:' || reverse(text)) END AS digest, CASE WHEN strlen(text) % 7 = 0 THEN 'ValueError: seven' END AS error FROM documents")
def recognise(spark, d):
    """Images through an OCR backend, copies once; failures are values."""
    b = backends.Backends()
    b.add_ocr("backwards", ["eng"], _backwards)
    x = backends.recognised(table(spark, d, "documents").select("doc_id", F.col("text").cast("binary").alias("data")), b, "backwards", "eng")
    return x.select("doc_id", F.md5("text").alias("digest"), F.col("ocr_error").alias("error"))


@R.query("hocr_markdown", f"SELECT doc_id, array_to_string({sql_words('text')}, ' ') AS markdown FROM (SELECT doc_id, regexp_replace(text, '[^a-zA-Z\\s]', '', 'g') AS text FROM documents)")
def hocr_markdown(spark, d):
    """Letters of the texts as hOCR words."""
    words = F.split(F.regexp_replace("text", r"[^a-zA-Z\s]", ""), r"\s+")
    spans = F.array_join(F.transform(F.filter(words, lambda w: w != ""), lambda w: F.concat(F.lit("<span class='ocrx_word' title='bbox 0 0 1 1'>"), w, F.lit("</span>"))), " ")
    page = F.concat(F.lit("<?xml version='1.0'?><!DOCTYPE html><html><head><title></title></head><body><div class='ocr_page'><p class='ocr_par'><span class='ocr_line'>"), spans, F.lit("</span></p></div></body></html>"))
    return table(spark, d, "documents").select("doc_id", ocr.hocr_markdown(page).alias("markdown"))
