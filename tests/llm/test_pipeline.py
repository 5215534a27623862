"""The pipeline on a small corpus, and its stages against brute force."""

from __future__ import annotations

import hashlib

import pytest

from tests.llm.test_operators import ITEM, brute_components, brute_count, brute_fingerprint, prose

pipeline = pytest.importorskip("corpus_pipeline")
COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    d = str(tmp_path_factory.mktemp("corpus"))
    rows, labels = [], []
    for i in range(240):
        words = prose(i, 120).split()
        if i % 6 == 0:
            for k in range(0, 120, 9):
                words[k] = ("blarg", "snorfle", "grumpf")[k % 3]
        if i % 17 == 1:
            words[60:60] = ITEM.split()
        if i % 5 == 1:
            words[30] = "password=" + hashlib.md5(str(i).encode()).hexdigest()
        rows.append((i, " ".join(words), "en", f"src{i % 3}", None))
        labels.append((i, 1, int(i % 6 == 0)))
    rows += [(300 + i, rows[i * 7 + 2][1], "en", None, 3) for i in range(20)] + [(400, None, None, None, None), (401, "", None, "other", 0)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{d}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{d}/labels.parquet")
    spark.createDataFrame([(1, ITEM)], "item_id long, text string").write.parquet(f"{d}/benchmark.parquet")
    return d


def test_stages_do_their_work(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    kept = {}
    for name, stage in pipeline.STAGES:
        out = stage(spark, docs, folder)
        assert out.columns[:5] == COLUMNS
        rows = out.collect()
        before = docs.collect()
        if name == "toxicity":
            gone = {r.doc_id for r in before} - {r.doc_id for r in rows}
            toxic = {i for i in range(240) if i % 6 == 0} | {300 + i for i in range(20) if (i * 7 + 2) % 6 == 0}
            assert len(gone & toxic) >= 0.9 * len(toxic) and len(gone - toxic) <= 3
        if name == "simhash":
            fps = [brute_fingerprint(r.text) for r in before]
            assert {r.doc_id for r in rows} == set(brute_components([r.doc_id for r in before], fps))
        if name == "decontamination":
            assert {r.doc_id for r in before} - {r.doc_id for r in rows} == {r.doc_id for r in before if r.text and "train leaves" in r.text}
        if name == "secrets":
            assert {r.doc_id for r in rows} == {r.doc_id for r in before}
            assert not any("password=" in (r.text or "") for r in rows) and any("[SECRET]" in (r.text or "") for r in rows)
        if name == "mixing":
            n = {}
            for r in before:
                n[r.source if r.source in ("src0", "src1", "src2") else "*"] = n.get(r.source if r.source in ("src0", "src1", "src2") else "*", 0) + 1
            rate = {s: len(before) / len(n) / k for s, k in n.items()}
            assert len(rows) == sum(brute_count(r.doc_id, rate[r.source if r.source in n else "*"]) for r in before)
        kept[name] = len(rows)
        docs = spark.createDataFrame(rows, out.schema).select(*COLUMNS)
    assert kept["toxicity"] > kept["simhash"] > kept["decontamination"] == kept["secrets"]
    assert pipeline.run(spark, folder).count() == kept["mixing"]


def test_empty_and_extra_columns(spark, folder, tmp_path):
    docs = spark.read.parquet(f"{folder}/documents.parquet").selectExpr("*", "1 AS score", "'x' AS spans", "2 AS predicted")
    for name, stage in pipeline.STAGES:
        assert stage(spark, docs.where("false"), folder).count() == 0
        out = stage(spark, docs.limit(40), folder)
        assert out.columns[: len(docs.columns)] == docs.columns, name
        assert all(r.score == 1 and r.spans == "x" and r.predicted == 2 for r in out.collect())
