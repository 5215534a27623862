"""Readers on small inputs of each format, and the extraction plan around them."""

from __future__ import annotations

import gzip
import io
import json
import tarfile
import zipfile

import pytest
from pyspark.sql import functions as F

from quire.functions import decoding as D
from quire.functions import text as T
from quire.operators import chunking
from quire.plans import extraction as X
from quire.sources import formats as R
from quire.sources import mime, structured


def zipped(files: dict[str, str]) -> bytes:
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        for name, text in files.items():
            z.writestr(name, text)
    return out.getvalue()


def test_plain_and_markdown():
    r = R.plain(b"red green\nblue\n\nfour more words here\n")
    assert (r.metadata["line_count"], r.metadata["word_count"]) == ("4", "7")
    m = R.markdown(b"---\ntitle: T\ntags: [a, b]\n---\n# Head\n[x](http://u)\n```py\n# no\n```\n| a | b |\n|---|---|\n| 1 | 2 |\n")
    assert m.metadata["title"] == "T" and json.loads(m.metadata["headers"]) == ["Head"] and json.loads(m.metadata["code_blocks"]) == [["py", "# no\n"]]
    assert m.tables == [[["a", "b"], ["1", "2"]]]


@pytest.mark.parametrize(("text", "delimiter"), [("a,b\n1,2", ","), ("a\tb\n1\t2", "\t"), ("a|b|c\n1|2|3", "|"), ("a;b\n1;2\n", ";"), ("one\ntwo", ",")])
def test_delimiters(text, delimiter):
    assert R.delimiter_of(text) == delimiter


def test_csv_quotes_and_empty_rows():
    assert R.delimited(b'"say ""hello""",b\r\n,\r\nx,"a,b"').tables == [[['say "hello"', "b"], ["x", "a,b"]]]


def test_structured_values():
    j = R.structured(json.dumps({"title": "x", "a": {"name": "n", "k": [1, {"text": "t"}]}, "z": None, "b": " "}).encode(), "json")
    assert {k: v for k, v in j.metadata.items() if k != "field_count"} == {"title": "x", "a.name": "n", "a.k[1].text": "t"} and j.metadata["field_count"] == "4"
    assert list(structured.walk([1, "a"])) == [("item_0", "1", False), ("item_1", "a", False)]
    assert R.structured(b'title = "t"\n[a]\nb = 2', "toml").metadata["title"] == "t"
    assert structured.flat_yaml("a: 1\nb:\n  c: 'x'\n  d:\n    - 1\n    - two\ne: [p, q]") == {"a": 1, "b": {"c": "x", "d": [1, "two"]}, "e": ["p", "q"]}


def test_xml_and_vocabularies():
    x = R.xml(b'<a k="v"><b>one  two</b><b/></a>')
    assert x.content == "a[k]: v\nb: one two" and x.metadata == {"element_count": "3", "unique_elements": "a, b"}
    assert R.xml(b"<a><b>x</b></c>").metadata["element_count"] == "2"
    with pytest.raises(R.FormatError):
        R.xml(b"<a>" * 200)
    fb = R.vocabulary(b"<FictionBook><description><title-info><book-title>B</book-title><author><first-name>A</first-name><last-name>C</last-name></author></title-info></description><body><p>text</p></body></FictionBook>", "fictionbook")
    assert fb.metadata == {"title": "B", "authors": "A C"} and fb.content == "text"
    jats = R.vocabulary(b"<article><article-title>J</article-title><p>p</p><table><tr><td>1</td></tr></table></article>", "jats")
    assert jats.metadata["title"] == "J" and jats.tables == [[["1"]]]
    assert R.vocabulary(b'<opml><head><title>O</title></head><body><outline text="x"/></body></opml>', "opml").content == "x"


def test_html_and_mail():
    h = R.html(b"<html><head><title>T</title><script>x</script></head><body><h1>A</h1><p>b <b>c</b> <a href='/u'>d</a></p><table><tr><th>p</th><th>q</th></tr><tr><td>1</td><td>2</td></tr></table></body></html>")
    assert h.metadata["title"] == "T" and "# A" in h.content and "**c** [d](/u)" in h.content and h.tables == [[["p", "q"], ["1", "2"]]] and "x" not in h.content.split()
    m = R.mail(b"From: a@b\nTo: c@d\nSubject: S\nDate: Mon, 1 Jan 2024 00:00:00 +0000\nContent-Type: text/html\n\n<p>hi <i>you</i></p><script>no</script>")
    assert m.content.startswith("Subject: S\nFrom: a@b\nTo: c@d") and m.content.endswith("hi you")


def test_archives():
    z = R.archive(zipped({"a.txt": "alpha", "b.bin": "x"}), "zip")
    assert z.metadata["file_count"] == "2" and "alpha" in z.content and "=== b.bin" not in z.content
    out = io.BytesIO()
    with tarfile.open(fileobj=out, mode="w:gz") as t:
        i = tarfile.TarInfo("n.md")
        i.size = 3
        t.addfile(i, io.BytesIO(b"abc"))
    assert "abc" in R.archive(out.getvalue(), "gzip").content
    assert R.archive(gzip.compress(b"plain"), "gzip").content == "plain"
    with pytest.raises(R.FormatError):
        big = io.BytesIO()
        with zipfile.ZipFile(big, "w", zipfile.ZIP_DEFLATED) as bomb:
            bomb.writestr("x.txt", "0" * (5 << 20))
        R.archive(big.getvalue(), "zip")


def test_references_and_notebooks():
    b = R.bibtex(b"@article{k1,\n author = {B, X and A, Y},\n year = {2012}\n}\n@book{k2,\n author = {A, Y},\n year = 2020\n}\n")
    assert b.metadata["entry_count"] == "2" and b.metadata["authors"] == "A, Y, B, X" and (b.metadata["year_min"], b.metadata["year_max"]) == ("2012", "2020")
    c = R.citations(b"TY  - JOUR\nAU  - A\nTI  - T\nPY  - 2001\nDO  - 10.1/x\nER  - \n")
    assert c.metadata["citation_count"] == "1" and c.metadata["dois"] == "10.1/x" and c.metadata["years"] == "2001"
    n = R.notebook(json.dumps({"nbformat": 4, "metadata": {"kernelspec": {"name": "py"}}, "cells": [{"cell_type": "code", "id": "i", "source": ["1+", "1"], "outputs": [{"text": "2"}]}]}).encode())
    assert n.content == ":::: {#i .cell .code}\n```\n1+1\n```\n\n2\n::::" and n.metadata["kernel"] == "py"


def test_markup_grammars():
    t = R.latex(b"\\title{T}\\author{A}\\begin{document}\\section{S} a \\textbf{b} % c\n\\begin{tabular}{ll}x & y \\\\ 1 & 2\\end{tabular}\\end{document}")
    assert t.metadata == {"title": "T", "author": "A"} and "# S" in t.content and "a b" in t.content and t.tables == [[["x", "y"], ["1", "2"]]]
    assert R.rst(b"Title\n=====\n\n:Author: A\n\ntext ``code``\n").metadata == {"title": "Title", "author": "A"}
    o = R.org(b"#+TITLE: O\n* One\n[[u][link]]\n| a | b |\n|---+---|\n| 1 | 2 |\n")
    assert o.metadata == {"title": "O"} and "# One\nlink" in o.content and o.tables == [[["a", "b"], ["1", "2"]]]
    assert R.typst(b'#set document(title: "Y")\n= Head\n#table(columns: 2, [a], [b], [1], [2])').tables == [[["a", "b"], ["1", "2"]]]
    r = R.rtf(rb"{\rtf1{\fonttbl{\f0 Arial;}}{\info{\title T}{\creatim\yr2024\mo3\dy5}}Hi\par caf\'e9 \u8364?{\*\x no}\{\}}")
    assert r.content == "Hi\ncafé €{}" and r.metadata == {"title": "T", "created_at": "2024-03-05T00:00:00Z"}


def test_office_archives():
    w = 'xmlns:w="http://w"'
    d = R.ooxml(zipped({"word/document.xml": f"<w:document {w}><w:p><w:t>one</w:t></w:p><w:tbl><w:tr><w:tc><w:p><w:t>c</w:t></w:p></w:tc></w:tr></w:tbl></w:document>", "docProps/core.xml": "<c><title>T</title></c>"}), "word")
    assert d.content == "one\n\nc" and d.tables == [[["c"]]] and d.metadata == {"title": "T"}
    x = R.ooxml(zipped({"xl/sharedStrings.xml": "<s><si><t>head</t></si></s>", "xl/worksheets/sheet1.xml": '<w><row><c t="s"><v>0</v></c><c><v>2</v></c></row></w>'}), "xl")
    assert x.tables == [[["head", "2"]]]
    e = R.opened(zipped({"META-INF/container.xml": '<c><rootfile full-path="o/p.opf"/></c>', "o/p.opf": '<p><title>E</title><item id="1" href="c.html"/><itemref idref="1"/></p>', "o/c.html": "<h1>Ch</h1><p>x</p>"}), "epub")
    assert e.metadata == {"title": "E"} and e.content == "# Ch\n\nx"
    assert R.opened(zipped({"content.xml": "<c><h>H</h><p>p</p></c>"}), "odt").content == "# H\n\np"


def test_types_of_bytes(spark):
    rows = [(1, b"\x89PNG\r\n"), (2, zipped({"word/document.xml": ""})), (3, b'{"a": 1}'), (4, b" <x/>"), (5, b"text"), (6, b"\xff\xfe\xfa"), (7, gzip.compress(b"x"))]
    got = {r.k: r.m for r in spark.createDataFrame(rows, "k int, b binary").select("k", mime.of_bytes(F.col("b")).alias("m")).collect()}
    assert got == {1: "image/png", 2: mime.BY_EXTENSION["docx"], 3: "application/json", 4: "application/xml", 5: "text/plain", 6: None, 7: "application/gzip"}


def test_errors_are_rows(spark):
    files = spark.createDataFrame([("a.txt", b"fine text here"), ("b.json", b"{"), ("c.pdf", b"%PDF"), ("d.txt", None), ("e.txt", b"x" * 50)], "path string, data binary")
    got = {r.path: r for r in X.extract(files, X.Config(max_file_bytes=40)).collect()}
    assert {p: r.error and r.error.kind for p, r in got.items()} == {"a.txt": None, "b.json": "Parsing", "c.pdf": "UnsupportedFormat", "d.txt": "Io", "e.txt": "TooLarge"}
    assert got["a.txt"].quality_score > 0 and X.extract(files.where("false")).count() == 0


def test_order_of_processors_and_validators(spark):
    p = X.builtin()
    p.processor("mark", "late", 5, lambda df, c: df.withColumn("content", F.concat("content", F.lit("!"))))
    p.validator("no-x", 1, "content NOT LIKE '%x%'")
    files = spark.createDataFrame([("a.txt", b"<b>"), ("b.txt", b"x")], "path string, data binary")
    got = {r.path: r for r in X.extract(files, X.Config(output_format="html"), p).collect()}
    assert got["a.txt"].content == "<pre>&lt;b&gt;!</pre>" and got["b.txt"].error.message == "no-x"
    off = X.extract(files, X.Config(postprocess=False), p)
    assert "quality_score" not in off.columns
    only = X.Config(enabled=("mark",), disabled=("mark",))
    assert len(p.chosen(only)) == 1 and len(p.chosen(X.Config(disabled=("mark",)))) == 3
    with pytest.raises(ValueError, match="stage"):
        p.processor("z", "never", 1, lambda df, c: df)


def test_configuration_is_checked():
    assert X.Config.of({"chunk_size": 100, "chunk_overlap": 10, "enabled": ["a"]}).enabled == ("a",)
    for bad in ({"chunk_size": 10, "chunk_overlap": 10}, {"output_format": "x"}, {"reduction": "all"}, {"nothing": 1}, {"min_confidence": 2}):
        with pytest.raises(ValueError):
            X.Config.of(bad)


def test_files_are_read_and_chunked(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.txt").write_text("One sentence. " * 60)
    (tmp_path / "in" / "b.log").write_text("no")
    records = X.extract(X.read_files(spark, str(tmp_path), ["txt", "md"]))
    got = X.chunks(records, X.Config(chunk_size=200, chunk_overlap=40)).orderBy("chunk_index").collect()
    assert len(got) > 3 and all(len(c.chunk) <= 200 for c in got) and got[0].byte_start == 0 and got[-1].total_chunks == len(got)
    good, bad = X.split_errors(records)
    assert (good.count(), bad.count()) == (1, 0)
    with pytest.raises(ValueError):
        chunking.checked(10, 10)


def test_literals_of_cleaning(spark):
    row = spark.range(1).select(
        T.clean_repeated_punctuation(F.lit("So?!?! maybe.... no,,, done")).alias("a"),
        T.fix_mojibake(F.lit("a\0b\x02 c\x1ed")).alias("b"),
        T.line_count(F.lit("")).alias("c"),
    ).first()
    assert tuple(row) == ("So? maybe. no, done", "ab cd", 0)


def test_configuration_files_and_environment(tmp_path):
    (tmp_path / "a" / "b").mkdir(parents=True)
    (tmp_path / "quire.toml").write_text("chunk_size = 50\nlanguage = true\n")
    found = X.Config.discover(tmp_path / "a" / "b")
    assert found.chunk_size == 50 and found.language
    assert X.Config.discover(tmp_path, "none.toml") is None
    changed = found.with_environment({"QUIRE_QUALITY": "false", "QUIRE_CHUNK_SIZE": "70", "QUIRE_DISABLED": "a,b"})
    assert not changed.quality and changed.chunk_size == 70 and changed.disabled == ("a", "b")
    with pytest.raises(ValueError):
        X.Config.load(tmp_path / "quire.toml").with_environment({"QUIRE_OUTPUT_FORMAT": "x"})


def test_cache_extracts_once(spark, tmp_path):
    calls = str(tmp_path / "cache")
    files = spark.createDataFrame([("a.txt", b"one two"), ("b.txt", b"one two"), ("c.json", b"{")], "path string, data binary")
    first = {r.path: r for r in X.cached(files, calls).collect()}
    assert spark.read.parquet(calls).count() == 2
    again = {r.path: r for r in X.cached(files.union(spark.createDataFrame([("d.txt", b"three")], files.schema)), calls).collect()}
    assert spark.read.parquet(calls).count() == 3 and set(again) == {"a.txt", "b.txt", "c.json", "d.txt"}
    assert first["a.txt"].content == again["b.txt"].content == "one two" and again["c.json"].error.kind == "Parsing"


def test_decoding_and_scattered_letters():
    assert D.decode("é".encode()) == "é" and D.decode("naïve".encode("cp1252"), "cp1252") == "naïve"
    assert D.decode(b"\xff\xfea\x00") == "a" and D.decode(None) is None and D.decode(b"a\x00b", "no-such") == "ab"
    assert D.decode("plain text with caf\xe9".encode("latin-1")).startswith("plain text with caf")
    assert D.collapse("T e x t") == "text " and D.collapse("A B") == "A B" and D.collapse("normal words here") == "normal words here"
    assert D.collapse("é a b c") == "é a b c" and D.collapse(None) is None and D.collapse("see  A  B  C.") == "seeabc ."
