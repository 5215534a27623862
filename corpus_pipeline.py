"""The corpus pipeline: stages over documents, each calling one operator of quire.llm."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from quire.llm import decontaminate, mixing, secrets, simhash, toxicity
from quire.llm.common import dropped, fresh, table, written


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the class-conditional models call toxic go. Null and empty texts score by the fit's
    constant; rows are judged one by one, repeated rows and null ids too; without labels all stay."""
    return toxicity.clean(docs, table(spark, sf_dir, "labels"))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each component of near copies the document of the least id stays; of rows of equal ids, or of
    null ids alone, that of the least text. Null and empty texts are copies of each other."""
    return simhash.keep_one(docs)


def drop_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows whose text shares a passage with the benchmark go, told by id and text, so that
    clean rows of null and repeated ids stay. Null and empty texts stay; an empty table on either side
    takes nothing away."""
    return decontaminate.decontaminate(docs, table(spark, sf_dir, "benchmark"), least=decontaminate.SHORTEST)


def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All rows stay; secrets in their texts are replaced by a mark, and n_chars counted anew where that was
    known. Null and empty texts stay as they are; without a secret to learn from only patterns are used."""
    (spans,) = fresh(docs, "spans")
    return secrets.redact(secrets.scan(docs, secrets.fit(docs), spans), spans=spans).drop(spans)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents are repeated by Poisson counts towards the sources' target weights, and shuffled; columns copy and
    shuffle_key come in. Rows of a null source count as of no listed one; null ids draw as one id; no row
    depends on its text."""
    return mixing.mix(docs)


STAGES = [
    ("toxicity", drop_toxic),
    ("simhash", drop_near_duplicates),
    ("decontamination", drop_benchmark),
    ("secrets", redact_secrets),
    ("mixing", mix_sources),
]
#: SQL can't express the first, second and fourth stage; tests hold the pipeline against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each but the last written as Parquet to the shared folder and read again."""
    docs, last = table(spark, sf_dir, "documents"), None
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name)
        dropped(last)
        last = docs
    return STAGES[-1][1](spark, docs, sf_dir)
