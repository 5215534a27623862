"""Queries of chunking, page mapping and vectors."""

from __future__ import annotations

from pyspark.sql import functions as F

from quire.operators import chunking as C
from quire.plans.base import Registry, table

R = Registry()
FIXED = """fixed AS (SELECT doc_id, CAST(i AS INT) AS chunk_index, substring(text, i * 800 + 1, 1000) AS chunk
  FROM (SELECT doc_id, text, unnest(range(0, greatest(length(text) - 201, 0) // 800 + 1)) AS i FROM documents WHERE length(text) > 0))"""
OFFSETS = """o AS (SELECT *, CAST(coalesce(sum(strlen(chunk) - least(200, strlen(chunk))) OVER (PARTITION BY doc_id ORDER BY chunk_index ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS byte_start FROM fixed),
offs AS (SELECT *, byte_start + strlen(chunk) AS byte_end, count(*) OVER (PARTITION BY doc_id) AS total_chunks FROM o)"""


@R.query("chunks_fixed", f"WITH {FIXED} SELECT * FROM fixed")
def chunks_fixed(spark, d):
    return C.fixed(table(spark, d, "documents"))


@R.query("chunk_offsets", f"WITH {FIXED}, {OFFSETS} SELECT doc_id, chunk_index, byte_start, byte_end, total_chunks FROM offs")
def chunk_offsets(spark, d):
    return C.offsets(C.fixed(table(spark, d, "documents"))).drop("chunk")


PAGES = """pages_ AS (SELECT doc_id, unnest(range(0, greatest(strlen(text), 1), 1500)) AS byte_start, strlen(text) AS n FROM documents),
pg AS (SELECT doc_id, byte_start, least(byte_start + 1500, n) AS byte_end, CAST(byte_start // 1500 + 1 AS INT) AS page_number FROM pages_)"""


def _pages(spark, d):
    n = F.octet_length("text").cast("long")
    rows = table(spark, d, "documents").select("doc_id", n.alias("n"), F.explode(F.sequence(F.lit(0).cast("long"), F.greatest(n - 1, F.lit(0)), F.lit(1500).cast("long"))).alias("byte_start"))
    return rows.select("doc_id", "byte_start", F.least(F.col("byte_start") + 1500, F.col("n")).alias("byte_end"), (F.floor(F.col("byte_start") / 1500) + 1).cast("int").alias("page_number"))


@R.query("chunk_page_range", f"WITH {FIXED}, {OFFSETS}, {PAGES} SELECT o.doc_id, o.chunk_index, min(page_number) AS first_page, max(page_number) AS last_page FROM offs o LEFT JOIN pg p ON o.doc_id = p.doc_id AND o.byte_start < p.byte_end AND o.byte_end > p.byte_start GROUP BY o.doc_id, o.chunk_index")
def chunk_page_range(spark, d):
    return C.page_ranges(C.offsets(C.fixed(table(spark, d, "documents"))), _pages(spark, d))


BAD = "bad AS (SELECT doc_id, page_number, CASE WHEN page_number % 5 = 0 THEN byte_start - 700 WHEN page_number % 7 = 0 THEN byte_end ELSE byte_start END AS byte_start, byte_end FROM pg)"


@R.query("boundary_violations", f"""WITH {PAGES}, {BAD}, w AS (SELECT *, lag(byte_start) OVER (PARTITION BY doc_id ORDER BY page_number) AS s, lag(byte_end) OVER (PARTITION BY doc_id ORDER BY page_number) AS e FROM bad)
SELECT doc_id, page_number, CASE WHEN byte_start >= byte_end THEN 'empty' WHEN s > byte_start THEN 'unsorted' ELSE 'overlapping' END AS problem FROM w WHERE byte_start >= byte_end OR s > byte_start OR e > byte_start""")
def boundary_violations(spark, d):
    """Page ranges, some moved so that there is something to find."""
    p = _pages(spark, d)
    start = F.when(F.col("page_number") % 5 == 0, F.col("byte_start") - 700).when(F.col("page_number") % 7 == 0, F.col("byte_end")).otherwise(F.col("byte_start"))
    return C.boundary_violations(p.withColumn("byte_start", start))


@R.query("page_marks", "SELECT doc_id, CAST(list_sum(list_transform(range(0, greatest(length(text) - 1, 0) // 2000 + 1), lambda i: length(chr(10) || chr(10) || '<!-- PAGE ' || (i + 1) || ' -->' || chr(10) || chr(10)))) + length(text) AS BIGINT) AS n_characters, md5(array_to_string(list_transform(range(0, greatest(length(text) - 1, 0) // 2000 + 1), lambda i: chr(10) || chr(10) || '<!-- PAGE ' || (i + 1) || ' -->' || chr(10) || chr(10) || substring(text, i * 2000 + 1, 2000)), '')) AS digest FROM documents")
def page_marks(spark, d):
    marked = C.with_page_marks(C.paged(F.col("text"), 2000))
    return table(spark, d, "documents").select("doc_id", marked.alias("m")).select("doc_id", F.char_length("m").cast("long").alias("n_characters"), F.md5("m").alias("digest"))


@R.query("chunks_semantic")
def chunks_semantic(spark, d):
    return C.semantic(table(spark, d, "documents"))


@R.query("presets", "SELECT * FROM (VALUES " + ", ".join(f"('{a}', {b}, {c}, {e})" for a, b, c, e in C.PRESETS) + ") AS t(name, size, overlap, dimensions)")
def presets(spark, d):
    return spark.createDataFrame(C.PRESETS, "name string, size int, overlap int, dimensions int")


NORMAL = """n AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS v, sqrt(list_sum(list_transform(embedding, lambda x: CAST(x AS DOUBLE) * CAST(x AS DOUBLE)))) AS n FROM embeddings),
u AS (SELECT vec_id, list_transform(v, lambda x: x / n) AS u FROM n)"""


@R.query("l2_normalize", f"WITH {NORMAL} SELECT vec_id, CAST(k AS INT) AS k, round(u[k + 1], 6) AS value FROM (SELECT vec_id, u, unnest(range(len(u))) AS k FROM u)")
def l2_normalize(spark, d):
    """All components of all vectors."""
    v = table(spark, d, "embeddings").select("vec_id", F.posexplode(C.normalized(F.col("embedding"))).alias("k", "value"))
    return v.select("vec_id", "k", F.round("value", 6).alias("value"))
