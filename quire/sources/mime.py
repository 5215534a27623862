"""MIME types by extension and by content, and which reader takes which."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Extensions by MIME type.
TYPES = {
    "text/plain": "txt",
    "text/markdown": "md markdown",
    "application/pdf": "pdf",
    "text/html": "html htm",
    "application/vnd.openxmlformats-officedocument.spreadsheetml.sheet": "xlsx",
    "application/vnd.ms-excel": "xls",
    "application/vnd.ms-excel.sheet.macroEnabled.12": "xlsm",
    "application/vnd.ms-excel.sheet.binary.macroEnabled.12": "xlsb",
    "application/vnd.ms-excel.addin.macroEnabled.12": "xlam",
    "application/vnd.ms-excel.template.macroEnabled.12": "xla",
    "application/vnd.oasis.opendocument.spreadsheet": "ods",
    "application/vnd.openxmlformats-officedocument.presentationml.presentation": "pptx",
    "application/vnd.openxmlformats-officedocument.presentationml.slideshow": "ppsx",
    "application/vnd.ms-powerpoint.presentation.macroEnabled.12": "pptm",
    "application/vnd.ms-powerpoint": "ppt",
    "application/vnd.openxmlformats-officedocument.wordprocessingml.document": "docx",
    "application/msword": "doc",
    "application/vnd.oasis.opendocument.text": "odt",
    "image/bmp": "bmp",
    "image/gif": "gif",
    "image/jpeg": "jpg jpeg",
    "image/png": "png",
    "image/tiff": "tiff tif",
    "image/webp": "webp",
    "image/jp2": "jp2 j2k j2c",
    "image/jpx": "jpx",
    "image/jpm": "jpm",
    "image/mj2": "mj2",
    "image/x-jbig2": "jbig2 jb2",
    "image/x-portable-anymap": "pnm",
    "image/x-portable-bitmap": "pbm",
    "image/x-portable-graymap": "pgm",
    "image/x-portable-pixmap": "ppm",
    "text/csv": "csv",
    "text/tab-separated-values": "tsv",
    "application/json": "json",
    "application/x-yaml": "yaml yml",
    "application/toml": "toml",
    "application/xml": "xml",
    "image/svg+xml": "svg",
    "message/rfc822": "eml",
    "application/vnd.ms-outlook": "msg",
    "application/zip": "zip",
    "application/x-tar": "tar",
    "application/gzip": "gz tgz",
    "application/x-7z-compressed": "7z",
    "text/x-rst": "rst",
    "text/x-org": "org",
    "application/epub+zip": "epub",
    "application/rtf": "rtf",
    "application/x-bibtex": "bib",
    "application/x-research-info-systems": "ris",
    "application/x-pubmed": "nbib",
    "application/x-endnote+xml": "enw",
    "application/x-fictionbook+xml": "fb2",
    "application/xml+opml": "opml",
    "application/docbook+xml": "dbk docbook",
    "application/x-jats+xml": "jats",
    "application/x-ipynb+json": "ipynb",
    "application/x-latex": "tex latex",
    "application/x-typst": "typst typ",
    "text/x-djot": "djot",
    "text/x-commonmark": "commonmark",
}
BY_EXTENSION = {e: m for m, es in TYPES.items() for e in es.split()}
#: Magic numbers as hex digits, in order.
MAGIC = (("FFD8FF", "jpeg"), ("89504E47", "png"), ("474946", "gif"), ("424D", "bmp"), ("3C737667", "svg"), ("3C3F786D6C", "svg"), ("49492A00", "tiff"), ("4D4D002A", "tiff"))


def of_path(path: Column) -> Column:
    """By lower-case extension; null if it isn't known."""
    extension = F.lower(F.regexp_extract(path, r"\.([A-Za-z0-9]+)$", 1))
    return F.create_map(*[F.lit(x) for kv in BY_EXTENSION.items() for x in kv])[extension]


def is_supported(mime: Column) -> Column:
    return F.lower(mime).isin(*[m.lower() for m in TYPES], "text/xml") | F.startswith(F.lower(mime), F.lit("image/"))


def resolved(explicit: Column, path: Column) -> Column:
    """The given type if it is supported, else the path's."""
    return F.when(explicit.isNotNull() & is_supported(explicit), explicit).when(explicit.isNull(), of_path(path))


def of_text(text: Column) -> Column:
    """What text content looks like: JSON that parses, markup, PDF, or plain text."""
    t = F.regexp_replace(text, r"^\s+", "")
    json = t.rlike(r"^[\[{]") & F.try_parse_json(text).isNotNull()
    return F.when(json, "application/json").when(F.startswith(t, F.lit("<")), "application/xml").when(F.startswith(t, F.lit("%PDF")), "application/pdf").otherwise("text/plain")


def of_bytes(data: Column) -> Column:
    """Images by magic number, office archives by their marker files, else by text; null if it isn't text."""
    image = image_format(data)
    latin = F.decode(data, "iso-8859-1")
    office = F.when(F.contains(latin, F.lit("word/document.xml")), BY_EXTENSION["docx"]).when(F.contains(latin, F.lit("xl/workbook.xml")), BY_EXTENSION["xlsx"]).when(F.contains(latin, F.lit("ppt/presentation.xml")), BY_EXTENSION["pptx"]).otherwise("application/zip")
    head = F.hex(F.substring(data, 1, 4))
    return F.when(head == "504B0304", office).when(F.hex(F.substring(data, 1, 2)) == "1F8B", "application/gzip").when(~image.isin("unknown", "svg"), F.concat(F.lit("image/"), image)).when(F.is_valid_utf8(data), of_text(F.try_validate_utf8(data)))


def image_format(data: Column) -> Column:
    head = F.hex(F.substring(data, 1, 44))
    out = F.when(F.lit(False), "")
    for magic, name in MAGIC:
        out = out.when(F.startswith(head, F.lit(magic)), name)
    return out.when(F.startswith(head, F.lit("52494646")) & (F.substring(head, 17, 8) == "57454250"), "webp").when(F.startswith(head, F.lit("D7CDC69A")), "wmf").when(F.startswith(head, F.lit("01000000")) & (F.substring(head, 81, 8) == "20454D46"), "emf").otherwise("unknown")


def chosen_readers(readers: DataFrame, types: DataFrame) -> DataFrame:
    """(mime, place, name) of the readers (name, mime, priority) for each type: exact
    ones by priority, then those of its ``prefix/*``, each name once. Of
    readers of one type and priority the last registered (``seq``) holds."""
    latest = readers.withColumn("_r", F.row_number().over(Window.partitionBy("mime", "priority").orderBy(F.desc("seq")))).where("_r = 1")
    keyed = types.select(F.col("mime").alias("wanted"), F.explode(F.array(F.struct(F.lit(0).alias("step"), F.col("mime").alias("key")), F.struct(F.lit(1).alias("step"), F.concat(F.substring_index("mime", "/", 1), F.lit("/*")).alias("key")))).alias("k")).select("wanted", "k.*")
    both = keyed.join(F.broadcast(latest), F.col("key") == F.col("mime")).select("wanted", "step", "priority", "name")
    once = both.withColumn("_n", F.row_number().over(Window.partitionBy("wanted", "name").orderBy("step", F.desc("priority")))).where("_n = 1")
    return once.select(F.col("wanted").alias("mime"), F.row_number().over(Window.partitionBy("wanted").orderBy("step", F.desc("priority"), "name")).alias("place"), "name")
