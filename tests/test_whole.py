"""Queries on whole texts and whole tables, against their oracle SQL without its cuts."""

from __future__ import annotations

import random

import duckdb
import pytest

from quire.plans import registry
from tests.test_queries import rows

QUERIES, SQL = registry.queries(), registry.oracle_sql()
#: What the SQL leaves out, and what stands there when nothing is left out.
CUTS = {"left(text, 400)": "text", " WHERE length(text) < 60": "", "left(text, 600)": "text", "left(text, 300)": "text", "left(text, 80)": "text", "left(text, 50)": "text"}
CUTS |= {"(CASE WHEN doc_id % 3 = 0 THEN left(text, CAST(doc_id % 90 AS INT)) ELSE text END)": "text", "(CASE WHEN doc_id % 5 = 0 THEN left(text, 2) ELSE text END)": "text"}
CUTS |= {" WHERE l_orderkey % 4 = 0": "", " WHERE event_id % 10 = 0": "", " AND doc_id % 2 = 0": ""}
PROSE = "Some words of a sentence that goes on. Data of the ANALYSIS, in 1999! "
LONG = f"{PROSE * 12}\n\n- an item behind the cut, {'long ' * 20}\n* another\n\n{PROSE * 3}\n\n# Far heading\ntext\n## Below it\n{PROSE * 9}\n    deep in\n"


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    d = str(tmp_path_factory.mktemp("whole"))
    docs = [(1, LONG, "en", "a", None), (2, LONG + LONG, "en", "b", None), (3, "short", "de", "a", None), (4, PROSE, "en", "b", None), (5, "", "en", "a", None), (7, "né à Orléans", "fr", "a", None), (8, "für alle", "de", "a", None), (90, f"{PROSE * 9}[far](#away) 数据分析", "en", "a", None)]
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long").coalesce(1).write.parquet(f"{d}/documents.parquet")
    lines = [(k, n, 1 + k % 2, float((k * 7 + n * 3) % 9 + 1)) for k in range(1, 9) for n in range(1, 5)]
    spark.createDataFrame(lines, "l_orderkey long, l_linenumber int, l_suppkey long, l_quantity double").coalesce(1).write.parquet(f"{d}/lineitem.parquet")
    spark.createDataFrame([(k, f'{{"k": {k % 5}}}') for k in range(1, 24)], "event_id long, props string").coalesce(1).write.parquet(f"{d}/events.parquet")
    return d


def whole(sql: str) -> str:
    for cut, instead in CUTS.items():
        sql = sql.replace(cut, instead)
    return sql


def agree(spark, folder, name, *tables):
    duck = duckdb.connect()
    for t in tables:
        duck.execute(f"CREATE VIEW {t} AS SELECT * FROM '{folder}/{t}.parquet/*.parquet'")
    got, want = QUERIES[name](spark, folder).toPandas(), duck.execute(whole(SQL[name])).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert rows(got) == rows(want)


@pytest.mark.parametrize("name", ["list_items", "paragraphs", "elements", "element_ids", "headings", "tree_parents", "node_ids", "tree_faults", "strip_list_markers"])
def test_structure_of_whole_texts(spark, folder, name):
    agree(spark, folder, name, "documents")


@pytest.mark.parametrize("name", ["sentence_scores", "sentence_select", "char_entropy", "word_importance", "semantic_filter", "hypernyms_to_target", "cjk_tokens", "reduce_markdown", "markdown_links", "ocr_fallback", "blank_pages"])
def test_measures_of_whole_texts(spark, folder, name):
    agree(spark, folder, name, "documents")


@pytest.mark.parametrize("name", ["reduce_aggressive", "reduce_maximum"])
def test_reduction_reaches_the_end_of_a_text(spark, tmp_path, name):
    text = PROSE * 12 + "The significant DATA2000 implementation."
    spark.createDataFrame([(1, text, "en")], "doc_id long, text string, lang string").write.parquet(f"{tmp_path}/documents.parquet")
    assert "DATA2000" in QUERIES[name](spark, str(tmp_path)).first().reduced


@pytest.mark.parametrize("name", ["snap_edges", "merge_edges", "edge_crossings", "extract_files", "decode_latin"])
def test_all_rows_of_a_table(spark, folder, name):
    agree(spark, folder, name, "documents", "lineitem", "events")


def test_table_cells_come_from_all_orders(spark, tmp_path):
    # Two lines each way, of short edges that merge; no order is divisible by four.
    lines = [(k, n, 1, float(k)) for k in (1, 2) for n in range(1, 8)]
    spark.createDataFrame(lines, "l_orderkey long, l_linenumber int, l_suppkey long, l_quantity double").write.parquet(f"{tmp_path}/lineitem.parquet")
    assert QUERIES["table_cells"](spark, str(tmp_path)).count() == 1


def test_extension_stats_of_null_keys_and_values(spark, tmp_path):
    events = [("a", 1, 2.0), ("a", 1, None), ("a", None, 3.0), (None, 2, 4.0), (None, None, 5.0), ("b", 7, None)]
    spark.createDataFrame(events, "event_type string, user_id long, value double").write.parquet(f"{tmp_path}/events.parquet")
    agree(spark, str(tmp_path), "extension_stats", "events")


def test_run_stats_of_null_keys_and_values_that_are_not_finite(spark, tmp_path):
    nan, inf = float("nan"), float("inf")
    events = [("a", k, 2.0 + k) for k in range(12)] + [("a", 0, nan), ("a", 1, inf), ("a", 2, -inf), ("a", None, 3.0), (None, 4, 4.0), (None, -4, 5.5), ("b", 7, None), ("b", 8, nan), ("c", 1, inf), ("c", 1, inf)]
    spark.createDataFrame(events, "event_type string, user_id long, value double").write.parquet(f"{tmp_path}/events.parquet")
    agree(spark, str(tmp_path), "run_stats", "events")


def test_run_stats_where_percentiles_end_in_halves(spark, tmp_path):
    r = random.Random(5)
    # Twice a prime number of rows each, by which no mean of five decimals ends in a half.
    events = [(f"tool{t}", k, 1 + round(r.expovariate(0.02), 5)) for t in range(40) for k in range(3 * 206)]
    spark.createDataFrame(events, "event_type string, user_id long, value double").write.parquet(f"{tmp_path}/events.parquet")
    agree(spark, str(tmp_path), "run_stats", "events")
