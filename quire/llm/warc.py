"""Content-addressed WARC archive.

Two Parquet tables in the shared folder: ``payloads`` holds each distinct
payload once under its SHA-256, ``headers`` the exact headers of every
record (those of WARC, and of HTTP where a payload follows) with the digest of its payload. Original records
come back, byte by byte, through a join of the two, and are parsed like those of any WARC file.
Equal payloads are told by SHA-256 and length; SHA-1, as WARC digests have it, is only carried along.
"""

from __future__ import annotations

import uuid
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.llm.common import dropped, shared_dir, table, written

CRLF = "\r\n"
#: Payloads of fewer bytes are stored and written like any other, but never revisited.
LEAST = 0
DATE = "2024-01-01T00:00:00Z"


@dataclass(frozen=True)
class Archive:
    """Where an archive's two tables are."""

    path: str

    @property
    def payloads(self) -> str:
        return f"{self.path}/payloads"

    @property
    def headers(self) -> str:
        return f"{self.path}/headers"


def base32(hex40: Column) -> Column:
    """Upper-case base32 of 40 hex digits: 5 of them are 4 digits to base 32."""
    part = lambda i: F.lpad(F.conv(F.substring(hex40, 5 * i + 1, 5), 16, 32), 4, "0")
    return F.translate(F.concat(*[part(i) for i in range(8)]), "0123456789ABCDEFGHIJKLMNOPQRSTUV", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567")


def _field(name: str, value: Column) -> Column:
    return F.concat(F.lit(f"{name}: "), value.cast("string"), F.lit(CRLF))


def record_uuid(page_id: Column) -> Column:
    """urn:uuid made of the id's md5; a null id counts as ''."""
    h = F.md5(F.coalesce(page_id.cast("string"), F.lit("")).cast("binary"))
    return F.concat(F.lit("<urn:uuid:"), *[x for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12)) for x in (F.substring(h, a, n), F.lit("-" if a < 21 else ">"))])


def write(pages: DataFrame, archive: Archive, least: int = LEAST, id_col: str = "page_id", url_col: str = "url", body_col: str = "html") -> None:
    """Writes a record for each row of ``pages``.

    Of the records with equal payloads of at least ``least`` bytes the one with the
    largest id is a response and the others revisit it; smaller ones are
    all responses. A null body is an empty payload, a null url an empty target
    without line breaks; ids are expected to be unique: of equal
    rows each is written, and each that has the largest id is a response. A null id
    is less than any other. An empty table gives an empty archive.

    Headers are made from digests only, which are computed once; payloads move once, each distinct one.
    """
    body = F.coalesce(F.col(body_col).cast("binary"), F.lit("").cast("binary"))
    page = F.col(id_col).cast("long").alias("page_id")
    rows = pages.select(page, F.regexp_replace(F.coalesce(F.col(url_col).cast("string"), F.lit("")), r"[\r\n]+", " ").alias("url"), F.sha2(body, 256).alias("digest"), base32(F.sha1(body)).alias("sha1"), F.octet_length(body).cast("long").alias("bytes"))
    rows = written(rows, "digests")
    first = rows.groupBy("digest", "bytes").agg(F.max("page_id").alias("first_id"))
    # A third of all rows can have one payload; the side with one row for each
    # payload lets Spark split such a partition of the join.
    joined = rows.join(first, ["digest", "bytes"], "left")
    response = (F.col("bytes") < least) | F.col("page_id").eqNullSafe(F.col("first_id"))
    kind = F.when(response, "response").otherwise("revisit")
    http = F.concat(F.lit(f"HTTP/1.1 200 OK{CRLF}"), _field("Content-Type", F.lit("text/html; charset=utf-8")), _field("Content-Length", F.col("bytes")), F.lit(CRLF))
    head = F.concat(
        F.lit(f"WARC/1.1{CRLF}"),
        _field("WARC-Type", kind),
        _field("WARC-Record-ID", record_uuid(F.col("page_id"))),
        _field("WARC-Date", F.lit(DATE)),
        _field("WARC-Target-URI", F.col("url")),
        _field("WARC-Payload-Digest", F.concat(F.lit("sha1:"), F.col("sha1"))),
        F.when(response, "").otherwise(F.concat(_field("WARC-Refers-To", record_uuid(F.col("first_id"))), _field("WARC-Refers-To-Page", F.coalesce(F.col("first_id").cast("string"), F.lit(""))), _field("WARC-Profile", F.lit("http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")))),
        F.when(F.col("page_id").isNull(), "").otherwise(_field("WARC-Page-ID", F.col("page_id").cast("string"))),
        _field("Content-Type", F.lit("application/http; msgtype=response")),
        _field("Content-Length", F.octet_length(http).cast("long") + F.when(response, F.col("bytes")).otherwise(0)),
        F.lit(CRLF),
        http,
    )
    made = joined.select("digest", response.alias("stored"), F.encode(head, "utf-8").alias("header"))
    made.write.mode("overwrite").option("compression", "zstd").parquet(archive.headers)
    dropped(rows)
    # Copies go before the shuffle; a common payload is one row from each task.
    payload = pages.select(F.sha2(body, 256).alias("digest"), body.alias("payload"))
    payload.groupBy("digest").agg(F.first("payload").alias("payload")).write.mode("overwrite").option("compression", "zstd").parquet(archive.payloads)


def parse_header(header: Column) -> Column:
    """map<string, string> of the named fields of a header block, of the first line with each name."""
    lines = F.filter(F.split(header, CRLF), lambda x: F.contains(x, F.lit(": ")))
    entries = F.transform(lines, lambda x: F.struct(F.substring_index(x, ": ", 1).alias("name"), F.regexp_replace(x, "(?s)^[^:]*: ", "").alias("value")))
    return F.map_from_entries(F.filter(entries, lambda x, i: F.array_position(F.transform(entries, lambda y: y["name"]), x["name"]) == i + 1))


def reconstruct(spark: SparkSession, archive: Archive) -> DataFrame:
    """(record,): the exact bytes of each record: headers, payload
    of a response, and the two line ends that close a record."""
    heads = spark.read.parquet(archive.headers)
    end = F.lit(CRLF * 2).cast("binary")
    bodies = spark.read.parquet(archive.payloads).select(F.col("digest").alias("own"), "payload")
    # Records without a payload, however many share one, stay out of the join.
    whole = heads.where("stored").join(bodies, F.col("digest") == F.col("own"), "left").select(F.concat("header", F.coalesce("payload", F.lit("").cast("binary")), end).alias("record"))
    return whole.unionByName(heads.where("NOT stored").select(F.concat("header", end).alias("record")))


def parse(records: DataFrame) -> DataFrame:
    """(page_id, url, record_type, record_id, refers_id, refers_to, digest, bytes, sha1, sound) of records (record binary). bytes and
    sha1 are those of the payload in the record, null for a revisit; sound says that the record has the length
    that its header says and, with a payload, the digest and the length in its HTTP header."""
    # One character a byte, so that places in the text are places in the bytes.
    latin = F.decode("record", "iso-8859-1")
    split = records.select("record", (F.locate(CRLF * 2, latin) + 3).alias("head")).select("record", "head", (F.call_function("locate", F.lit(CRLF * 2), latin, F.col("head") + 1) + 3).alias("http"))
    text = lambda a, b: F.decode(F.substring("record", a, b), "utf-8")
    size = F.octet_length("record")
    read = split.select(
        parse_header(text(F.lit(1), F.col("head"))).alias("h"),
        parse_header(text(F.col("head") + 1, F.col("http") - F.col("head"))).alias("p"),
        F.substring("record", F.col("http") + 1, size - F.col("http") - 4).alias("payload"),
        (size - F.col("head") - 4).cast("long").alias("block"),
    )
    field = lambda name: F.col("h")[name]
    stored = field("WARC-Type") == "response"
    facts = read.select("h", "p", "block", F.when(stored, F.octet_length("payload").cast("long")).alias("bytes"), F.when(stored, base32(F.sha1("payload"))).alias("sha1"))
    digest = F.substring_index(field("WARC-Payload-Digest"), "sha1:", -1)
    right = ~stored | ((F.col("sha1") == digest) & (F.col("p")["Content-Length"].cast("long") == F.col("bytes")))
    return facts.select(
        field("WARC-Page-ID").cast("long").alias("page_id"),
        field("WARC-Target-URI").alias("url"),
        field("WARC-Type").alias("record_type"),
        field("WARC-Record-ID").alias("record_id"),
        field("WARC-Refers-To").alias("refers_id"),
        F.nullif(field("WARC-Refers-To-Page"), F.lit("")).cast("long").alias("refers_to"),
        digest.alias("digest"),
        "bytes",
        "sha1",
        F.coalesce((field("Content-Length").cast("long") == F.col("block")) & right, F.lit(False)).alias("sound"),
    )


def read(spark: SparkSession, archive: Archive) -> DataFrame:
    """(page_id, url, record_type, payload_bytes, payload_digest, refers_to,
    verified) of each reconstructed record. Bytes and digest are those of the payload in the record, a
    revisit's those in the record that it refers to; verified says
    that the lengths and the SHA-1 in the headers are theirs."""
    records = written(parse(reconstruct(spark, archive)), "records")
    # Of equal rows each is a response; one of these stands for them.
    responses = records.where("record_type = 'response'").groupBy(F.col("record_id").alias("to_id")).agg(F.min("bytes").alias("to_bytes"), F.min("sha1").alias("to_sha1"))
    # A third of all records can refer to one; the side with a row for each lets Spark split such a partition.
    both = records.join(responses, F.col("refers_id") == F.col("to_id"), "left")
    return both.select(
        "page_id",
        "url",
        "record_type",
        F.coalesce("bytes", "to_bytes").alias("payload_bytes"),
        F.coalesce("sha1", "to_sha1").alias("payload_digest"),
        "refers_to",
        (F.col("sound") & F.coalesce(F.coalesce("sha1", "to_sha1") == F.col("digest"), F.lit(False))).alias("verified"),
    )


def op9_warc_archive(spark: SparkSession, sf_dir: str) -> DataFrame:
    archive = Archive(f"{shared_dir(spark)}/quire-warc-{uuid.uuid4().hex}")
    write(table(spark, sf_dir, "pages"), archive)
    return read(spark, archive).where(F.assert_true(F.col("verified"), "a stored payload fails its digest").isNull()).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def oracle() -> str:
    """DuckDB SQL of op9_warc_archive."""
    digits = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
    part = lambda i: " || ".join(f"substr('{digits}', CAST((CAST('0x' || substr(h, {5 * i + 1}, 5) AS BIGINT) >> {s}) & 31 AS INT) + 1, 1)" for s in (15, 10, 5, 0))
    return f"""
WITH p AS (SELECT page_id, coalesce(html, '') AS html, max(page_id) OVER (PARTITION BY coalesce(html, '')) AS first_id FROM pages),
x AS (SELECT *, sha1(html) AS h FROM p)
SELECT page_id, CAST(strlen(html) AS BIGINT) AS payload_bytes, {' || '.join(map(part, range(8)))} AS payload_digest,
  CASE WHEN page_id = first_id OR strlen(html) < {LEAST} THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN page_id = first_id OR strlen(html) < {LEAST} THEN NULL ELSE first_id END AS refers_to
FROM x"""
