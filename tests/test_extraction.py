"""Readers' order and fallback, the cache's key, spreadsheets and broken markup."""

from __future__ import annotations

import io
import zipfile

import pytest
from pyspark.sql import functions as F

from quire.plans import extraction as X
from quire.sources import formats, mime

FILES = "path string, data binary"


def refuses(data):
    raise formats.FormatError("no")


def says(word):
    return lambda data: formats.Record(f"{word} {len(data)}")


def test_readers_are_asked_in_order_until_one_answers(spark):
    p = X.builtin()
    p.reader("first", ["text/plain"], 90, refuses)
    p.reader("second", ["text/plain", "text/csv"], 80, says("second"))
    p.reader("family", ["text/*", "image/*"], 99, says("family"))
    files = spark.createDataFrame([("a.txt", b"abc"), ("b.csv", b"1,2"), ("c.md", b"# x"), ("d.png", b"\x89PNG"), ("e.json", b"{"), ("f.zzz", b"\xff\x00")], FILES)
    got = {r.path: r for r in X.extract(files, X.Config(quality=False), p).collect()}
    assert got["a.txt"].content == "second 3" and [w.source for w in got["a.txt"].warnings] == ["first"] and got["a.txt"].error is None
    assert got["b.csv"].content == "second 3" and got["d.png"].content == "family 4" and got["c.md"].content == "# x"
    assert got["e.json"].error.kind == "Parsing" and got["f.zzz"].error.kind == "UnsupportedFormat"
    assert [n for n, _ in p.readers_of("text/plain")] == ["first", "second", "builtin:text/plain", "family"]
    assert p.remove("second") and not p.remove("second") and [n for n, _ in p.readers_of("text/csv")] == ["builtin:text/csv", "family"]


def test_order_is_that_of_the_relational_choice(spark):
    p = X.Plugins()
    made = [("plain", "text/plain", 50), ("rich", "text/plain", 60), ("new", "text/html", 50), ("pictures", "image/*", 40), ("png", "image/png", 50), ("any", "text/*", 70)]
    for name, kind, priority in made:
        p.reader(name, [kind], priority, refuses)
    rows = spark.createDataFrame([(*m, k) for k, m in enumerate(made)], "name string, mime string, priority int, seq int")
    types = ["text/plain", "text/html", "image/png", "image/gif", "audio/x"]
    chosen = mime.chosen_readers(rows, spark.createDataFrame([(t,) for t in types], "mime string")).collect()
    for t in types:
        assert [n for n, _ in p.readers_of(t)] == [r.name for r in sorted((r for r in chosen if r.mime == t), key=lambda r: r.place)]


def test_all_readers_refuse(spark):
    p = X.builtin()
    p.reader("first", ["application/json"], 90, refuses)
    (got,) = X.extract(spark.createDataFrame([("a.json", b"{oops")], FILES), X.Config(quality=False), p).collect()
    assert got.error.kind == "Parsing" and len(got.warnings) == 2 and got.content is None


def test_names_and_types_of_plugins():
    p = X.Plugins()
    for bad in ("", "a b"):
        with pytest.raises(ValueError):
            p.reader(bad, ["text/plain"], 1, refuses)
    with pytest.raises(ValueError):
        p.reader("x", [], 1, refuses)


def test_the_cache_tells_plugins_apart_and_tries_again(spark, tmp_path):
    cache, files = str(tmp_path / "cache"), spark.createDataFrame([("a.txt", b"abc"), ("b.json", b"{")], FILES)

    def shout(version):
        p = X.builtin()
        p.processor("shout", "late", 1, lambda df, config: df.withColumn("content", F.concat("content", F.lit(version))), version)
        return p

    config = X.Config(quality=False)
    content = lambda p: {r.path: r.content for r in X.cached(files, cache, config, p).collect()}
    assert content(None)["a.txt"] == "abc" and content(shout("1"))["a.txt"] == "abc1" and content(shout("2"))["a.txt"] == "abc2" and content(None)["a.txt"] == "abc"
    p = X.builtin()
    p.reader("lenient", ["application/json"], 10, says("lenient"))
    assert content(p)["b.json"] == "lenient 1"
    stats = X.cache_stats(spark, cache).first()
    assert stats.entries == 8 and stats.failed >= 3
    assert X.cache_stats(spark, str(tmp_path / "none")).count() == 0


def sheet(cells):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("xl/workbook.xml", '<workbook xmlns="m"><sheets><sheet name="Sums"/><sheet name="Other"/></sheets></workbook>')
        z.writestr("xl/worksheets/sheet1.xml", f'<worksheet xmlns="m"><sheetData>{cells}</sheetData></worksheet>')
    return out.getvalue()


def test_cells_stand_where_they_belong():
    data = sheet('<row r="1"><c r="A1"><v>1</v></c><c r="D1"><v>4</v></c><c><v>5</v></c></row><row r="2"><c r="B2"><v>2</v></c></row><row r="3"/>')
    record = formats.READERS["application/vnd.openxmlformats-officedocument.spreadsheetml.sheet"](data)
    assert record.tables == [[["1", "", "", "4", "5"], ["", "2"], []]]
    assert record.metadata["sheet_names"] == '["Sums", "Other"]' and record.content == "1 4 5\n2\n"
    assert [formats.column_of(x) for x in ("A1", "Z9", "AA10", "XFD1", "XFE1", "", "9")] == [1, 26, 27, 16384, 0, 0, 0]


def test_markup_behind_a_mismatched_tag_is_read():
    record = formats.xml(b'<r><a x="1">one</b><c>two &amp; 2</c></a><d>later</d><e k=\'v\'/></r>')
    assert record.content.splitlines() == ["a[x]: 1", "c: two & 2", "a: one", "d: later", "e[k]: v"]
    assert record.metadata["element_count"] == "5"
    good = formats.xml(b'<r><a x="1">one<b/>tail</a></r>')
    assert good.content == "a[x]: 1\na: one"
    with pytest.raises(formats.FormatError):
        formats.xml(b"no markup")
    with pytest.raises(formats.FormatError):
        formats.xml(b"<a>" * 200)
