"""The staged extraction plan: files in, one record per document out.

read -> type -> extract -> processors (early, middle, late) -> validators ->
elements and output format. Every step is a DataFrame -> DataFrame transform;
an error is a value of its row, and rows keep their ordinal.
"""

from __future__ import annotations

import json
import tomllib
from collections.abc import Callable, Iterator, Mapping, Sequence
from dataclasses import dataclass, field, replace
from pathlib import Path

import pandas as pd
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.functions import keywords, quality, reduction
from quire.functions import language as L
from quire.functions import text as T
from quire.operators import chunking
from quire.sources import formats, mime
from quire.sources.structured import flat_yaml

RECORD = "ordinal long, path string, mime_type string, content string, metadata map<string,string>, tables array<array<array<string>>>, error struct<kind:string,message:string>, warnings array<struct<source:string,message:string>>"
STAGES = ("early", "middle", "late")
FORMATS = ("plain", "markdown", "djot", "html", "structured")


@dataclass(frozen=True)
class Config:
    """What an extraction does. ``checked`` raises before any plan is made."""

    quality: bool = True
    language: bool = False
    min_confidence: float = 0.05
    chunk_size: int | None = None
    chunk_overlap: int = 0
    keywords: int = 0
    reduction: str = "off"
    output_format: str = "plain"
    postprocess: bool = True
    enabled: tuple[str, ...] | None = None
    disabled: tuple[str, ...] | None = None
    max_file_bytes: int = 100 << 20

    def checked(self) -> Config:
        if self.output_format not in FORMATS:
            raise ValueError(f"output_format {self.output_format!r} is none of {FORMATS}")
        if self.reduction not in ("off", "light", "moderate"):
            raise ValueError(f"reduction {self.reduction!r} is none of off, light, moderate")
        if not 0 <= self.min_confidence <= 1:
            raise ValueError("min_confidence must be from 0 to 1")
        if self.chunk_size is not None:
            chunking.checked(self.chunk_size, self.chunk_overlap)
        if self.keywords < 0 or self.max_file_bytes <= 0:
            raise ValueError("keywords and max_file_bytes can't be negative")
        return self

    @classmethod
    def of(cls, options: dict) -> Config:
        """From a mapping, such as a parsed TOML or JSON file; unknown keys raise."""
        unknown = set(options) - set(cls.__dataclass_fields__)
        if unknown:
            raise ValueError(f"unknown options {sorted(unknown)}")
        return replace(cls(), **{k: tuple(v) if isinstance(v, list) else v for k, v in options.items()}).checked()


    @classmethod
    def load(cls, path: str | Path) -> Config:
        """From a TOML, JSON or YAML file, by its extension."""
        text, kind = Path(path).read_text(), Path(path).suffix.lower()
        readers = {".toml": tomllib.loads, ".json": json.loads, ".yaml": flat_yaml, ".yml": flat_yaml}
        if kind not in readers:
            raise ValueError(f"no configuration reader of {kind!r}")
        return cls.of(readers[kind](text))

    @classmethod
    def discover(cls, start: str | Path, name: str = "quire.toml") -> Config | None:
        """The nearest file of that name in a folder or those above it."""
        folder = Path(start).resolve()
        found = next((f / name for f in (folder, *folder.parents) if (f / name).is_file()), None)
        return cls.load(found) if found else None

    def with_environment(self, environ: Mapping[str, str], prefix: str = "QUIRE_") -> Config:
        """Overridden by QUIRE_<OPTION> variables, read as the option's type."""
        new = {}
        for name, f in self.__dataclass_fields__.items():
            if (raw := environ.get(prefix + name.upper())) is not None:
                kind = str(f.type)
                new[name] = raw.lower() in ("1", "true", "yes") if kind == "bool" else float(raw) if kind == "float" else int(raw) if kind.startswith("int") else tuple(raw.split(",")) if kind.startswith("tuple") else raw
        return replace(self, **new).checked()


Transform = Callable[[DataFrame, Config], DataFrame]


#: Bytes of a file to a record; what it raises sends the file to the next reader.
Reader = Callable[[bytes], formats.Record]


@dataclass
class Plugins:
    """Readers, processors and validators by name, on the driver. A reader takes some types, or all of a
    family (text/*), and goes by its priority, greater first; a processor has a stage and
    a priority; a validator is a condition that every row without an error must meet. A version tells
    results of one plugin apart, in the cache too."""

    processors: dict[str, tuple[str, int, Transform]] = field(default_factory=dict)
    validators: dict[str, tuple[int, str]] = field(default_factory=dict)
    readers: dict[str, tuple[tuple[str, ...], int, Reader]] = field(default_factory=dict)
    versions: dict[str, str] = field(default_factory=dict)

    @staticmethod
    def _named(name: str) -> str:
        if not name or any(c.isspace() for c in name):
            raise ValueError(f"a plugin's name can't be empty or hold white space: {name!r}")
        return name

    def processor(self, name: str, stage: str, priority: int, transform: Transform, version: str = "1") -> None:
        if stage not in STAGES:
            raise ValueError(f"stage {stage!r} is none of {STAGES}")
        self.processors[self._named(name)] = (stage, priority, transform)
        self.versions[name] = version

    def validator(self, name: str, priority: int, condition: str, version: str = "1") -> None:
        self.validators[self._named(name)] = (priority, condition)
        self.versions[name] = version

    def reader(self, name: str, types: Sequence[str], priority: int, read: Reader, version: str = "1") -> None:
        if not types:
            raise ValueError(f"reader {name!r} takes no type")
        self.readers[self._named(name)] = (tuple(types), priority, read)
        self.versions[name] = version

    def remove(self, name: str) -> bool:
        """Whether there was a plugin of that name."""
        self.versions.pop(name, None)
        return any([kind.pop(name, None) is not None for kind in (self.readers, self.processors, self.validators)])

    def readers_of(self, mime_type: str | None) -> list[tuple[str, Reader]]:
        """(name, reader) for a type: those that name it by priority, then those of its family."""
        if not mime_type:
            return []
        family = mime_type.partition("/")[0] + "/*"
        found = [(step, -priority, name, read) for step, key in enumerate((mime_type, family)) for name, (types, priority, read) in self.readers.items() if key in types]
        return [(name, read) for _, _, name, read in {x[2]: x for x in sorted(found, key=lambda x: x[:3], reverse=True)}.values()][::-1]

    def signature(self) -> str:
        """What a result depends on, of these plugins."""
        rows = [("reader", n, t, p) for n, (t, p, _) in self.readers.items()] + [("processor", n, s, p) for n, (s, p, _) in self.processors.items()] + [("validator", n, c, p) for n, (p, c) in self.validators.items()]
        return repr(sorted((*map(str, r), self.versions.get(r[1], "")) for r in rows))

    def chosen(self, config: Config) -> list[Transform]:
        """In order of stage, then priority, then name; enabled names outrank disabled ones."""
        def wanted(name: str) -> bool:
            if config.enabled is not None:
                return name in config.enabled
            return config.disabled is None or name not in config.disabled

        rows = sorted((STAGES.index(s), -p, n, t) for n, (s, p, t) in self.processors.items() if wanted(n))
        return [t for *_, t in rows]


def _quality(df: DataFrame, config: Config) -> DataFrame:
    return df.withColumn("quality_score", quality.quality_score(F.coalesce("content", F.lit("")), F.col("metadata"))) if config.quality else df


def _language(df: DataFrame, config: Config) -> DataFrame:
    return df.withColumn("language", L.detect(F.coalesce("content", F.lit("")), config.min_confidence)["code"]) if config.language else df


def _reduction(df: DataFrame, config: Config) -> DataFrame:
    if config.reduction == "off":
        return df
    c = F.coalesce("content", F.lit(""))
    return df.withColumn("reduced", reduction.light(c) if config.reduction == "light" else reduction.moderate(c, reduction.STOPWORDS["en"]))


#: Of the built-in readers; a plugin of more is asked first, one of less where these fail.
PRIORITY = 50


def builtin() -> Plugins:
    p = Plugins()
    p.processor("quality", "early", 30, _quality)
    p.processor("language", "early", 20, _language)
    p.processor("reduction", "middle", 10, _reduction)
    for mime_type, read in formats.READERS.items():
        p.reader(f"builtin:{mime_type}", [mime_type], PRIORITY, read)
    return p


def read_files(spark: SparkSession, path: str, extensions: Sequence[str] | None = None) -> DataFrame:
    """(path, data): all files below a folder, of some extensions if given."""
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", "true")
    if extensions:
        reader = reader.option("pathGlobFilter", "*.{" + ",".join(extensions) + "}")
    return reader.load(path).select("path", F.col("content").alias("data"))


#: Records handed back at a time.
RECORDS = 64


def extract(files: DataFrame, config: Config | None = None, plugins: Plugins | None = None) -> DataFrame:
    """One record for each row (path, data binary, mime_type string if known).

    The readers of a file's type are asked in their order until one answers; what the others
    said is in its warnings. A file that is too large, of unknown type, or refused by all its readers has an
    error, no content, and ordinal, path and type like any other. The ordinal
    follows the path.
    """
    config, plugins = (config or Config()).checked(), plugins or builtin()
    given = F.col("mime_type") if "mime_type" in files.columns else F.lit(None).cast("string")
    typed = files.select(F.xxhash64("path").alias("ordinal"), "path", F.coalesce(mime.resolved(given, F.col("path")), F.when(given.isNull(), mime.of_bytes(F.col("data")))).alias("mime_type"), "data", F.coalesce(F.length("data"), F.lit(0)).alias("bytes"))
    limit = config.max_file_bytes
    # Only what reads goes to the workers.
    readers = Plugins(readers=dict(plugins.readers))

    def one(r) -> tuple:  # noqa: ANN001
        found = error = None
        warnings: list[dict] = []
        asked = readers.readers_of(r.mime_type)
        if r.bytes > limit:
            error = ("TooLarge", f"{r.bytes} bytes, more than {limit}")
        elif r.data is None:
            error = ("Io", "no content")
        elif not asked:
            error = ("UnsupportedFormat", f"no reader of {r.mime_type}")
        else:
            data = bytes(r.data)
            for name, read in asked:
                try:
                    found = read(data)
                    break
                except Exception as e:  # noqa: BLE001  a reader's failure is its row's
                    error = ("Parsing", f"{type(e).__name__}: {e}"[:500])
                    warnings.append({"source": name, "message": error[1]})
            if found:
                error = None
            elif len(asked) == 1:
                warnings = []
        content, meta, tables = (found.content, found.metadata, found.tables) if found else (None, {}, None)
        return r.ordinal, r.path, r.mime_type, content, dict(meta), tables, error and dict(zip(("kind", "message"), error, strict=True)), warnings

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = [f.split()[0] for f in ("ordinal", "path", "mime_type", "content", "metadata", "tables", "error", "warnings")]
        for rows in batches:
            # Spark bounds a batch's bytes; contents can be larger than files, so records go out a few at a time.
            for at in range(0, len(rows), RECORDS):
                yield pd.DataFrame([one(r) for r in rows.iloc[at : at + RECORDS].itertuples(index=False)], columns=names)

    records = typed.mapInPandas(run, RECORD)
    return postprocess(records, config, plugins)


def postprocess(records: DataFrame, config: Config, plugins: Plugins) -> DataFrame:
    """Processors if asked for; validators always, before the output format; a
    condition that fails makes the row's error."""
    df = records
    if config.postprocess:
        for transform in plugins.chosen(config):
            df = transform(df, config)
    failed = F.lit(None).cast("string")
    for name, (_, condition) in sorted(plugins.validators.items(), key=lambda kv: (kv[1][0], kv[0]), reverse=False):
        failed = F.coalesce(failed, F.when(~F.coalesce(F.expr(condition), F.lit(False)), F.lit(name)))
    if plugins.validators:
        df = df.withColumn("error", F.when(F.col("error").isNull() & failed.isNotNull(), F.struct(F.lit("Validation").alias("kind"), failed.alias("message"))).otherwise(F.col("error")))
    shown = F.concat(F.lit("<pre>"), T.escape_html(F.col("content")), F.lit("</pre>")) if config.output_format == "html" else F.col("content")
    return df.withColumn("content", shown).withColumn("output_format", F.lit(config.output_format))


def chunks(records: DataFrame, config: Config) -> DataFrame:
    """(ordinal, chunk_index, chunk, byte_start, byte_end, total_chunks) of the contents."""
    docs = records.where("content IS NOT NULL").select("ordinal", F.col("content").alias("text"))
    return chunking.offsets(chunking.semantic(docs, config.chunk_size or chunking.SIZE, config.chunk_overlap, "ordinal"), config.chunk_overlap, "ordinal")


def record_keywords(records: DataFrame, config: Config) -> DataFrame:
    return keywords.rake(records.where("content IS NOT NULL").select("ordinal", F.col("content").alias("text")), reduction.STOPWORDS["en"], config.keywords, "ordinal")


def split_errors(records: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(good, bad): the batch contract's two sides."""
    return records.where("error IS NULL"), records.where("error IS NOT NULL")


def cached(files: DataFrame, cache: str, config: Config | None = None, plugins: Plugins | None = None) -> DataFrame:
    """extract() through a content-addressed Parquet cache: files whose bytes, type, configuration and plugins
    were seen before are read from it, others are extracted
    once each and added. Bytes that all readers refused are so again, but files that couldn't be read are tried
    again. Rows come back with their own paths."""
    spark, config, plugins = files.sparkSession, (config or Config()).checked(), plugins or builtin()
    given = F.col("mime_type") if "mime_type" in files.columns else F.lit(None).cast("string")
    parts = (F.sha2(F.coalesce("data", F.lit("").cast("binary")), 256), F.coalesce(given, mime.of_path(F.col("path")), F.lit("")), F.lit(repr(config)), F.lit(plugins.signature()))
    keyed = files.withColumn("key", F.sha2(F.concat_ws("|", *parts), 256))
    # The extension may matter to the reader, so one path stands for each key.
    known = _cache_rows(spark, cache)
    new = keyed if known is None else keyed.join(known.where("error IS NULL OR error.kind <> 'Io'").select("key"), "key", "left_anti")
    once = new.groupBy("key").agg(F.min_by(F.struct(*files.columns), F.col("path")).alias("f")).select("key", "f.*")
    done = extract(once, config, plugins).join(once.select("key", "path"), "path").drop("ordinal", "path")
    done.write.mode("append").parquet(cache)
    rows = spark.read.parquet(cache)
    # Of the rows of a key, writers' or tries', one that has no error.
    best = rows.groupBy("key").agg(F.min_by(F.struct(*[c for c in rows.columns if c != "key"]), F.col("error").isNotNull()).alias("r")).select("key", "r.*")
    return keyed.select("key", "path", F.xxhash64("path").alias("ordinal")).join(best, "key").drop("key")


def cache_stats(spark: SparkSession, cache: str) -> DataFrame:
    """(entries, failed, characters) of a cache; no row if there is none."""
    rows = _cache_rows(spark, cache)
    if rows is None:
        return spark.createDataFrame([], "entries long, failed long, characters long")
    return rows.agg(F.count_distinct("key").alias("entries"), F.count_if(F.col("error").isNotNull()).alias("failed"), F.coalesce(F.sum(F.char_length("content")), F.lit(0)).cast("long").alias("characters"))


def _cache_rows(spark: SparkSession, cache: str) -> DataFrame | None:
    try:
        return spark.read.parquet(cache)
    except AnalysisException:
        return None  # nothing cached yet


SINKS = ("parquet", "json", "text")


def save(records: DataFrame, path: str, kind: str = "parquet") -> None:
    """Writes records: as Parquet, as a JSON object a line, or as the contents alone with their paths as
    JSON strings would be, one a line."""
    if kind not in SINKS:
        raise ValueError(f"sink {kind!r} is none of {SINKS}")
    if kind == "text":
        one = F.to_json(F.struct("path", "content"))
        records.where("content IS NOT NULL").select(one.alias("value")).write.mode("overwrite").text(path)
    else:
        records.write.mode("overwrite").format(kind).save(path)
