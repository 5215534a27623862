"""Registering queries next to their oracle SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]


class Registry:
    def __init__(self) -> None:
        self.queries: dict[str, Query] = {}
        self.sql: dict[str, str] = {}

    def query(self, name: str, sql: str | None = None) -> Callable[[Query], Query]:
        def add(f: Query) -> Query:
            self.queries[name] = f
            if sql:
                self.sql[name] = sql
            return f

        return add


#: Tables whose rows are costly to work on, and bytes that are worth a task.
TEXTS, TASK_BYTES = ("documents", "pages", "conversations"), 16 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table; small tables of texts, which come in few partitions, are dealt
    out to all cores first. Large ones are read as they lie."""
    rows = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    cores = spark.sparkContext.defaultParallelism
    # The planner's own figure, from the files' listing that the read has made.
    size = int(str(rows._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    if name in TEXTS and size < cores * TASK_BYTES:
        return rows.repartition(cores)
    return rows
