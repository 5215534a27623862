"""Columns of the input that are called like those that operators and stages make for themselves."""

from __future__ import annotations

import hashlib

import pytest

from quire.llm import chat, ctw, decontaminate, language, mixing, secrets, simhash, toxicity, warc
from tests.llm.test_operators import ITEM, prose

pipeline = pytest.importorskip("corpus_pipeline")
NAMES = "_k _u0 _bucket _cdf _parts _fp _root _other _bad_id _body _spans _score score spans predicted fp root component_id body h kind seg tokens n at key row value own c first part cell salt page digest header record features ratio matches all quire_bucket quire_parts quire_cdf quire_first quire_n quire_at quire_fp quire_own quire_root quire_row quire_other quire_bad_id quire_bad_hash quire_bad_bytes quire_body quire_spans quire_score quire_group quire_total quire_hash quire_place dotted.name".split()


@pytest.fixture(scope="module")
def rows(spark):
    made = [(i, prose(i % 20, 60) + (" blarg " if i % 3 == 0 else "") + (f" password={hashlib.md5(bytes([i])).hexdigest()}" if i % 4 == 0 else ""), "aa", f"src{i % 2}", 5) for i in range(60)]
    made += [(None, None, None, None, None), (None, ITEM, None, None, 1), (3, "again", "bb", None, 2)]
    extra = [(*r, *(f"{n}{k}" for n in NAMES)) for k, r in enumerate(made)]
    return spark.createDataFrame(extra, "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"`{n}` string" for n in NAMES))


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    d = str(tmp_path_factory.mktemp("clashes"))
    spark.createDataFrame([(i, int(i % 3 == 0)) for i in range(60)], "doc_id long, toxic int").write.parquet(f"{d}/labels.parquet")
    spark.createDataFrame([(1, ITEM)], "item_id long, text string").write.parquet(f"{d}/benchmark.parquet")
    return d


@pytest.mark.parametrize("stage", [name for name, _ in pipeline.STAGES])
def test_stages_keep_every_column(spark, rows, folder, stage):
    out = dict(pipeline.STAGES)[stage](spark, rows, folder)
    assert out.columns[: len(rows.columns)] == rows.columns
    mine = {r[NAMES[0]]: r for r in rows.collect()}
    got = out.collect()
    assert got
    for r in got:
        was = mine[r["_k"]]
        assert all(r[c] == was[c] for c in rows.columns if c not in ("text", "n_chars"))


@pytest.mark.parametrize("stage", [name for name, _ in pipeline.STAGES])
def test_stages_of_nothing(spark, rows, folder, stage):
    assert dict(pipeline.STAGES)[stage](spark, rows.where("false"), folder).count() == 0


def test_operators_bear_every_column(spark, rows, folder):
    labels, bench = spark.read.parquet(f"{folder}/labels.parquet"), spark.read.parquet(f"{folder}/benchmark.parquet")
    n = rows.count()
    assert decontaminate.contaminated(rows, bench).count() == 1
    assert simhash.near_duplicates(rows).count() == n
    assert ctw.score(rows, rows).count() == n
    for out in (toxicity.score(rows, labels), language.identify(rows, language.fit(rows)), secrets.scan(rows, None)):
        assert out.count() == n and set(NAMES) - {"score", "spans", "predicted"} <= set(out.columns)
    assert mixing.mix(rows, {}, other=1.0).columns[:-2] == rows.columns


def test_archive_and_chat_bear_every_column(spark, rows, tmp_path):
    archive = warc.Archive(str(tmp_path / "x"))
    warc.write(rows.withColumnsRenamed({"doc_id": "page_id", "text": "html", "lang": "url"}), archive)
    assert warc.read(spark, archive).where("verified").count() == rows.count()
    turns = chat.canonical_turns(chat.turn_records(rows.selectExpr("*", "doc_id AS conv_id", "0 AS turn", "lang AS role")))
    assert chat.format_chat(turns).count() == len({r.doc_id for r in rows.collect()})
