"""Exact top-k inner products by a Voronoi kNN join.

Pivots part data and queries into cells of least angle. Each query is first solved in
its own cell; its k-th score there bounds what it still needs: an inner product of at least that
much takes a norm, and an angle to the query that the triangle inequality of angles
compares with the angles to the pivot of the query's group. From these follow three numbers for each
group, and a data vector is sent to those groups only that may need it. What is sent is solved
by matrix products in blocks, and merged.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quire.llm.common import table, written

K = 10
SCALE = 1024
EVERY = 100
#: Pivots, chosen among distinct vectors by a hash: a bound on the summaries.
PIVOTS = 48
#: Data vectors, and queries, of one block. There are no more groups of queries than blocks of them.
BLOCK, ASKED = 20_000, 4096
#: Angles are compared with this much to spare.
SLACK = 1e-6


def integers(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", scale: int = SCALE) -> DataFrame:
    """(vec_id, x array<long>): floor(scale * component), components as doubles.
    Null vectors, and those with a null or non-finite component, are left out, as
    are rows of a null id. Repeated rows stay."""
    v = F.col("v")
    sound = v.isNotNull() & ~F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    rows = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).cast("array<double>").alias("v")).where(sound & F.col("vec_id").isNotNull())
    return rows.select("vec_id", F.transform("v", lambda x: F.floor(x * F.lit(float(scale))).cast("long")).alias("x"))


def _matrix(x: pd.Series, kind: type = float) -> np.ndarray:
    return np.array(x.tolist(), kind).reshape(len(x), -1)


def _angles(x: np.ndarray, pivots: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(norm, angle to each pivot of norm 1); a zero vector is at right angles to all."""
    norm = np.sqrt((x**2).sum(axis=1))
    return norm, np.arccos(np.clip(x @ pivots.T / np.maximum(norm, 1e-300)[:, None], -1, 1))


def _best(ids: np.ndarray, x: pd.Series, asked: pd.DataFrame, k: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(query, data rows, scores) of the k greatest of this block, in order."""
    data, queries = _matrix(x), _matrix(asked["q"])
    # Doubles hold these integers exactly, else they're multiplied as such.
    exact = float(np.abs(data).max(initial=0) * np.abs(queries).max(initial=0) * data.shape[1]) < 2**53
    if not exact:
        data, queries = _matrix(x, np.int64), _matrix(asked["q"], np.int64)
    names = asked["query_id"].to_numpy()
    for at in range(0, len(names), 256):
        scores = (data @ queries[at : at + 256].T).astype(np.int64)
        for q, score in zip(names[at : at + 256], scores.T, strict=True):
            own = np.flatnonzero(ids != q)
            if len(own) > k:
                # All that reach the k-th score, so that ties are settled by id.
                least = np.partition(score[own], len(own) - k)[len(own) - k]
                own = own[score[own] >= least]
            own = own[np.lexsort((ids[own], -score[own]))][:k]
            yield q, own, score[own]


def _solved(posed: DataFrame, sent: DataFrame, keys: list[str], k: int) -> DataFrame:
    """(query_id, rank, vec_id, score) of the k best rows of ``sent`` for each query, both dealt by ``keys``."""

    def solve(asked: pd.DataFrame, rows: pd.DataFrame) -> pd.DataFrame:
        out: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        if len(asked) and len(rows):
            ids = rows["vec_id"].to_numpy()
            out = [(np.full(len(at), q), ids[at], score) for q, at, score in _best(ids, rows["x"], asked, k)]
        columns = [np.concatenate(c) for c in zip(*out, strict=True)] if out else [np.zeros(0, np.int64)] * 3
        return pd.DataFrame(dict(zip(("query_id", "vec_id", "score"), columns, strict=True)))

    found = posed.groupBy(*keys).cogroup(sent.groupBy(*keys)).applyInPandas(solve, "query_id long, vec_id long, score long")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def _dealt(rows: DataFrame, sizes: DataFrame, key: str, most: int, name: str, salt: Column) -> DataFrame:
    """``rows`` with a part number ``name`` for each ``most`` of a key, from sizes (key, n) of a row a cell."""
    parts = sizes.select(key, F.ceil(F.col("n") / most).cast("int").alias("parts"))
    return rows.join(F.broadcast(parts), key).withColumn(name, F.pmod(salt, F.col("parts")).cast("int")).drop("parts")


def _spread(rows: DataFrame, sizes: DataFrame, key: str, most: int, name: str) -> DataFrame:
    """``rows`` once for each part that _dealt makes of their key."""
    parts = sizes.select(key, F.ceil(F.col("n") / most).cast("int").alias("parts"))
    return rows.join(F.broadcast(parts), key).withColumn(name, F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).drop("parts")


class Plan:
    """The join's two sides, dealt: ``posed`` and ``sent``, by ``keys``."""

    def __init__(self, data: DataFrame, queries: DataFrame, k: int, pivots: int, block: int, asked: int):
        self.keys = ["part", "cell", "salt"]
        shape = data.agg(F.max(F.size("x")).alias("width"), F.sqrt(F.max(F.aggregate("x", F.lit(0.0), lambda a, c: a + c.cast("double") * c.cast("double")))).alias("norm")).first()
        wide = queries.agg(F.max(F.size("x")).alias("width"), F.approx_count_distinct("vec_id").alias("n")).first()
        self.empty = shape.width is None or wide.width is None
        if self.empty:
            return
        width, longest = max(1, shape.width, wide.width), float(shape.norm)
        filled = lambda x: F.concat(x, F.array_repeat(F.lit(0).cast("long"), F.lit(width) - F.size(x)))
        data = data.select("vec_id", F.when(F.size("x") < width, filled(F.col("x"))).otherwise(F.col("x")).alias("x"))
        queries = queries.groupBy("vec_id").agg(F.min("x").alias("x")).select("vec_id", F.when(F.size("x") < width, filled(F.col("x"))).otherwise(F.col("x")).alias("x"))
        # Of equal vectors one is enough for a pivot; ``pivots`` rows come to the driver.
        chosen = data.where(F.exists("x", lambda c: c != 0)).groupBy("x").agg(F.min("vec_id").alias("vec_id")).orderBy(F.xxhash64("vec_id"), "vec_id", "x").limit(pivots).toPandas()
        centres = _matrix(chosen["x"]) if len(chosen) else np.eye(1, width)
        centres /= np.sqrt((centres**2).sum(axis=1))[:, None]
        groups = max(1, min(len(centres), -(-wide.n // asked)))

        def assign(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for rows in batches:
                if len(rows):
                    norm, angle = _angles(_matrix(rows["x"]), centres)
                    part = angle[:, :groups].argmin(axis=1)
                    yield rows.assign(cell=angle.argmin(axis=1).astype(np.int32), part=part.astype(np.int32), norm=norm, angle=angle[np.arange(len(rows)), part])

        schema = "vec_id long, x array<long>, cell int, part int, norm double, angle double"
        data = written(data.mapInPandas(assign, schema), "vectors")
        queries = written(queries.mapInPandas(assign, schema), "queries")
        posed = queries.select("cell", F.col("vec_id").alias("query_id"), F.col("x").alias("q"), "part", "norm", "angle")

        # Each query in its own cell: at most ``pivots`` sizes.
        own = data.groupBy("cell").agg(F.count(F.lit(1)).alias("n")).join(queries.select("cell").distinct(), "cell")
        near = _dealt(data.select("cell", "vec_id", "x"), own, "cell", block, "salt", F.xxhash64("vec_id"))
        first = _solved(_spread(posed.select("cell", "query_id", "q"), own, "cell", block, "salt"), near, ["cell", "salt"], k)
        bound = written(first.where(F.col("rank") == k).select(F.col("query_id").alias("bounded"), F.col("score").alias("least")), "bounds")
        posed = posed.join(bound, F.col("query_id") == F.col("bounded"), "left").drop("bounded", "cell")

        # What a group's queries can need: vectors of an angle up to ``reach`` to its pivot, and of a norm from ``short`` on.
        some = (F.col("least") > 0) & (F.col("norm") > 0)
        reach = F.when(some, F.col("angle") + F.acos(F.least(F.lit(1.0), F.col("least") / (F.col("norm") * longest)))).otherwise(math.pi)
        short = F.when(some, F.col("least") / F.col("norm")).otherwise(0.0)
        needs = posed.groupBy("part").agg(F.max(reach).alias("reach"), F.min(short).alias("short"), F.count(F.lit(1)).alias("n"))
        limits = {r.part: (r.reach + SLACK, r.short * (1 - SLACK)) for r in needs.collect()}  # ``groups`` rows at most

        def route(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for rows in batches:
                if len(rows):
                    norm, angle = _angles(_matrix(rows["x"]), centres[:groups])
                    for g, (far, low) in limits.items():
                        kept = rows[(angle[:, g] <= far) & (norm >= low)]
                        if len(kept):
                            yield kept.assign(part=np.int32(g))

        #: (part, vec_id, x): a row for each vector and group that may need it.
        self.routed = data.select("vec_id", "x").mapInPandas(route, "vec_id long, x array<long>, part int")
        self.present = data
        sizes = written(self.routed.groupBy("part").agg(F.count(F.lit(1)).alias("n")), "sizes")
        # A group's queries in parts of ``asked``, its data in blocks; each part meets each block.
        asks = needs.select("part", "n")
        sent = _dealt(self.routed, sizes, "part", block, "salt", F.xxhash64("vec_id"))
        self.sent = _spread(sent, asks, "part", asked, "cell").select(*self.keys, "vec_id", "x")
        asking = _dealt(posed.select("part", "query_id", "q"), asks, "part", asked, "cell", F.xxhash64("query_id"))
        self.posed = _spread(asking, sizes, "part", block, "salt").select(*self.keys, "query_id", "q")


def top_k(data: DataFrame, queries: DataFrame, k: int = K, pivots: int = PIVOTS, block: int = BLOCK, asked: int = ASKED) -> DataFrame:
    """(query_id, rank int, vec_id, score long): the k data rows of the greatest
    inner products with each query, other ids than its own, ties to the smaller id.

    data and queries: (vec_id, x array<long>); shorter vectors count as filled up with zeros. Fewer than k rows
    give all. Repeated data rows are candidates one by one; of queries with one id
    that of the least vector is asked. Empty tables give no rows.
    """
    plan = Plan(data, queries, k, pivots, block, asked)
    if plan.empty:
        return data.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    return _solved(plan.posed, plan.sent, plan.keys, k)


def op6_voronoi_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = integers(table(spark, sf_dir, "embeddings"))
    return top_k(vectors, vectors.where(F.col("vec_id") % EVERY == 0))


def oracle() -> str:
    """DuckDB SQL of op6_voronoi_top_k."""
    return f"""
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(floor({SCALE} * CAST(x AS DOUBLE)) AS BIGINT)) AS x FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.vec_id AS query_id, d.vec_id, CAST(list_sum(list_transform(list_zip(q.x, d.x), lambda p: p[1] * p[2])) AS BIGINT) AS score
  FROM v q JOIN v d ON q.vec_id % {EVERY} = 0 AND q.vec_id <> d.vec_id)
SELECT query_id, CAST(rank AS INT) AS rank, vec_id, score FROM (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s) WHERE rank <= {K}"""
