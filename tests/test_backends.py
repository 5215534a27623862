"""Backends, image headers, scripts, trees of pages, OCR lines, sinks and streams."""

from __future__ import annotations

import json
import struct

import pytest
from pyspark.sql import functions as F

from quire.functions import language as L
from quire.functions import ocr
from quire.operators import structure as S
from quire.plans import extraction as X
from quire.sources import backends as B
from quire.sources import formats
from quire.streaming import stream


def test_backends_are_asked_once_and_checked(spark, tmp_path):
    log = tmp_path / "log"
    log.mkdir()

    def read(data, language):
        (log / f"{data.hex()}-{len(list(log.iterdir()))}").touch()
        if data == b"bad":
            raise RuntimeError("engine")
        return language + data.decode()

    b = B.Backends()
    b.add_ocr("fake", ["eng", "deu"], read)
    rows = spark.createDataFrame([(1, b"x"), (2, b"x"), (3, b"bad"), (4, None), (5, b"")], "n int, data binary").coalesce(1)
    got = {r.n: (r.text, r.ocr_error) for r in B.recognised(rows, b, "fake", "deu").collect()}
    assert got == {1: ("deux", None), 2: ("deux", None), 3: (None, "RuntimeError: engine"), 4: (None, None), 5: ("deu", None)}
    assert sum(f.name.startswith("78-") for f in log.iterdir()) == 1
    assert b.languages("fake") == ("deu", "eng") and b.supports("fake", "eng") and not b.supports("none", "eng") and b.names() == ["fake"]
    with pytest.raises(ValueError):
        B.recognised(rows, b, "fake", "fra")
    for bad in ((" ", ["eng"]), ("x", [])):
        with pytest.raises(ValueError):
            b.add_ocr(*bad, read)


def test_embeddings(spark):
    b = B.Backends()
    b.add_embedding("pair", 2, lambda texts: [[3.0 * len(t), 4.0 * len(t)] for t in texts])
    b.add_embedding("wrong", 3, lambda texts: [[1.0, 2.0] for _ in texts])
    rows = spark.createDataFrame([(1, "ab"), (2, None), (3, "")], "n int, text string")
    got = {r.n: r.embedding for r in B.embedded(rows, b, "pair", most=1).collect()}
    assert got[1] == pytest.approx([0.6, 0.8]) and got[2] is None and got[3] == [0.0, 0.0]
    assert {r.n: r.embedding for r in B.embedded(rows, b, "pair", unit=False).collect()}[1] == [6.0, 8.0]
    with pytest.raises(Exception, match="must give 3"):
        B.embedded(rows, b, "wrong").collect()
    with pytest.raises(ValueError):
        b.add_embedding("x", 0, None)


def tiff(order, entries):
    """A directory of (tag, type, count, inline bytes or data) behind an 8-byte header."""
    e = "<" if order == b"II" else ">"
    data, body = b"", struct.pack(e + "H", len(entries))
    at = 8 + 2 + 12 * len(entries) + 4
    for tag, kind, n, value in entries:
        if len(value) > 4:
            body += struct.pack(e + "HHII", tag, kind, n, at + len(data))
            data += value
        else:
            body += struct.pack(e + "HHI", tag, kind, n) + value.ljust(4, b"\0")
    return order + struct.pack(e + "HI", 42, 8) + body + b"\0" * 4 + data


def test_image_headers():
    size = lambda data: (r := formats.image(data).metadata)["format"] + f" {r['width']}x{r['height']}"
    assert size(b"\x89PNG\r\n\x1a\n\0\0\0\rIHDR" + struct.pack(">II", 640, 480)) == "PNG 640x480"
    assert size(b"GIF89a" + struct.pack("<HH", 3, 70)) == "GIF 3x70"
    assert size(b"BM" + b"\0" * 16 + struct.pack("<ii", 9, -8)) == "BMP 9x8"
    assert size(b"RIFF\0\0\0\0WEBPVP8X" + b"\0" * 8 + (99).to_bytes(3, "little") + (49).to_bytes(3, "little")) == "WEBP 100x50"
    assert size(b"RIFF\0\0\0\0WEBPVP8L" + b"\0" * 4 + b"\x2f" + struct.pack("<I", (29 << 14) | 19)) == "WEBP 20x30"
    assert size(b"RIFF\0\0\0\0WEBPVP8 " + b"\0" * 10 + struct.pack("<HH", 21, 22)) == "WEBP 21x22"
    assert size(b"P6\n# a comment\n12 34\n255\n") == "PNM 12x34"
    for order, e in ((b"II", "<"), (b"MM", ">")):
        block = tiff(order, [(0x0100, 3, 1, struct.pack(e + "H", 7)), (0x0101, 4, 1, struct.pack(e + "I", 5)), (0x010F, 2, 6, b"Maker\0"), (0x829A, 5, 1, struct.pack(e + "II", 1, 60))])
        record = formats.image(block)
        assert size(block) == "TIFF 7x5" and record.metadata["Make"] == "Maker" and record.metadata["ExposureTime"] == "1/60"
        exif = b"Exif\0\0" + block
        jpeg = b"\xff\xd8\xff\xe1" + struct.pack(">H", len(exif) + 2) + exif + b"\xff\xc0\0\x0b\x08" + struct.pack(">HH", 11, 22) + b"\0" * 6
        assert size(jpeg) == "JPEG 22x11" and formats.image(jpeg).metadata["Make"] == "Maker"
    for bad in (b"", b"\xff\xd8\xff", b"RIFF", b"II*\0\xff\xff\xff\xff", b"nothing"):
        with pytest.raises(formats.FormatError):
            formats.image(bad)


@pytest.mark.parametrize(("text", "code"), [("Это русский текст", "rus"), ("Ελληνικά γράμματα", "ell"), ("これは日本語のテキスト漢字", "jpn"), ("这是中文文本", "cmn"), ("한국어 문장", "kor"), ("שלום עולם", "heb"), ("नमस्ते दुनिया", "hin"), ("the cat is on the mat", "eng"), ("der Hund ist in dem Haus und", "deu"), ("12 !", None), ("µ ª", None)])
def test_scripts_tell_languages(spark, text, code):
    assert spark.range(1).select(L.detect(F.lit(text), 0.05)["code"].alias("c")).first().c == code


def test_codes_come_in_pairs():
    assert all(len(a) == 2 and len(b) == 3 for a, b in L.CODES.items()) and len(set(L.CODES.values())) == len(L.CODES) and set(L.SCRIPTS) <= set(L.CODES.values())


def test_sections_end_with_their_page(spark):
    text = "intro\n# One\nbody\nmore\n\n### Deep\nx\n## Two\ny"
    rows = spark.createDataFrame([(1, 1, text), (1, 2, "next page\n# Again\nz"), (2, 1, ""), (3, 1, None)], "doc_id int, page_number int, text string")
    got = [(r.doc_id, r.page_number, r.level, r.text, r.parent_index) for r in S.document_nodes(rows).orderBy("doc_id", "node_index").collect()]
    assert got == [(1, 1, 7, "intro", None), (1, 1, 1, "One", None), (1, 1, 7, "body\nmore", 1), (1, 1, 3, "Deep", 1), (1, 1, 7, "x", 3), (1, 1, 2, "Two", 1), (1, 1, 7, "y", 5), (1, 2, 7, "next page", None), (1, 2, 1, "Again", None), (1, 2, 7, "z", 8)]


def test_lines_of_recognised_words(spark):
    word = lambda k, left, text, conf: f"5\t1\t1\t1\t{k}\t1\t{left}\t10\t20\t8\t{conf}\t{text}"
    tsv = "\n".join(["level\tpage", word(1, 40, "world", 90), word(1, 5, "hello", 80), word(2, 7, "low", 10), word(2, 9, "next", 60)])
    words = ocr.tsv_words(spark.createDataFrame([(1, tsv)], "n int, tsv string"), "n", "tsv", 50.0)
    got = {r.text: (r.left_, r.right_, r.top_, r.bottom_, r.confidence) for r in ocr.line_elements(words, "n").collect()}
    assert got == {"hello world": (5, 60, 10, 18, 85.0), "next": (9, 29, 10, 18, 60.0)}


def test_sinks(spark, tmp_path):
    records = X.extract(spark.createDataFrame([("a.txt", b"one\ntwo"), ("b.json", b"{")], "path string, data binary"), X.Config(quality=False))
    for kind in X.SINKS:
        X.save(records, str(tmp_path / kind), kind)
    assert spark.read.parquet(str(tmp_path / "parquet")).count() == 2
    assert {json.loads(r.value)["path"] for r in spark.read.text(str(tmp_path / "json")).collect()} == {"a.txt", "b.json"}
    assert [json.loads(r.value) for r in spark.read.text(str(tmp_path / "text")).collect()] == [{"path": "a.txt", "content": "one\ntwo"}]
    with pytest.raises(ValueError):
        X.save(records, str(tmp_path / "x"), "xml")


def streamed(spark, tmp_path, batches, schema, transform):
    """The rows that a stream of one file a batch appends."""
    source, out = tmp_path / "in", tmp_path / "out"
    for k, rows in enumerate(batches):
        spark.createDataFrame(rows, schema).withColumn("ts", F.col("ts").cast("timestamp")).coalesce(1).write.mode("append").parquet(f"{source}/{k}")
    rows = spark.readStream.schema(spark.read.parquet(f"{source}/0").schema).option("maxFilesPerTrigger", 1).option("latestFirst", "false").parquet(f"{source}/*")
    query = transform(rows).writeStream.format("parquet").option("path", str(out)).option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start()
    assert query.awaitTermination(120)
    return spark.read.parquet(str(out)).collect()


def test_late_events_are_left_out_of_a_stream(spark, tmp_path):
    at = lambda h, m=0: f"2024-01-01 {h:02}:{m:02}:00"
    batches = [[(at(1, 5), "a", 1.0), (at(1, 50), "a", 3.0)], [(at(6), "a", 5.0)], [(at(6, 10), "b", 1.0)], [(at(1, 10), "a", 99.0), (at(5, 30), "a", 7.0)], [(at(23), "a", 0.0)]]
    got = streamed(spark, tmp_path, batches, "ts string, event_type string, value double", lambda e: stream.windowed_stats(e, late="2 hours"))
    found = {r.start.hour: (r.n, r.mean) for r in got if r.event_type == "a"}
    assert found[1] == (2, 2.0) and found[5] == (1, 7.0) and found[6] == (1, 5.0)


def test_sliding_windows(spark):
    events = spark.createDataFrame([("2024-01-01 01:20:00", "a", 2.0), ("2024-01-01 01:40:00", "a", 4.0)], "ts string, event_type string, value double")
    got = {(r.start.hour, r.start.minute): (r.n, r.mean) for r in stream.windowed_stats(events, "1 hour", "30 minutes").collect()}
    assert got == {(0, 30): (1, 2.0), (1, 0): (2, 3.0), (1, 30): (1, 4.0)}


def test_texts_seen_before_stay_out(spark, tmp_path):
    batches = [[("2024-01-01 01:00:00", 1, "x"), ("2024-01-01 01:00:01", 2, "y")], [("2024-01-01 02:00:00", 3, "x"), ("2024-01-01 02:00:00", 4, "z")]]
    got = streamed(spark, tmp_path, batches, "ts string, n int, text string", stream.first_seen)
    assert sorted(r.text for r in got) == ["x", "y", "z"]
