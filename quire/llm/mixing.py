"""Mixing sources to target weights by Poisson replication.

Each document gets a Poisson count by inverting the distribution at a uniform
number hashed from seed and id; it is exploded by that count, and all copies
are shuffled by a hash of (seed, id, copy). Column expressions only.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quire.llm.common import columns, fresh, quoted, table, written

#: A rate above this is split into a sum of equal Poisson draws, so that exp()
#: stays far from underflow and TERMS terms reach probability 1 in doubles.
STEP = 8.0
TERMS = 64
#: Draws that one row makes, and so the blocks that a much repeated document is dealt in.
BLOCK = 256
#: Production target: the twenty crawl sources share the epoch evenly.
WEIGHTS = {f"src{i}": 0.05 for i in range(20)}
OTHER = 0.05
SEED = 17


def _uniform(key: Column) -> Column:
    """52 bits of md5 as a number in [0, 1)."""
    return F.conv(F.substring(F.md5(key.cast("binary")), 1, 13), 16, 10).cast("long").cast("double") / F.lit(float(1 << 52))


def _weight(bucket: Column, weights: Mapping[str, float], other: float) -> Column:
    listed = F.create_map(*[F.lit(x) for kv in weights.items() for x in (kv[0], float(kv[1]))])[bucket] if weights else F.lit(None).cast("double")
    return F.coalesce(listed, F.lit(float(other)))


def rates(docs: DataFrame, weights: Mapping[str, float], other: float, total: int | None, source_col: str) -> DataFrame:
    """(bucket, rate, parts, cdf): one row for each weighted source that occurs, at most len(weights) + 1:
    number of draws and the cumulative probabilities of one draw."""
    n = docs.select(_bucket(weights, source_col).alias("bucket")).groupBy("bucket").agg(F.count(F.lit(1)).alias("n")).withColumn("w", _weight(F.col("bucket"), weights, other))
    both = n.agg(F.sum("w").alias("sw"), F.sum(F.when(F.col("w") > 0, F.col("n"))).alias("sn"), F.collect_list(F.struct("bucket", "n", "w")).alias("all"))
    size = F.lit(float(total)) if total is not None else F.col("sn").cast("double")
    rate = both.select(size.alias("total"), "sw", F.inline("all")).where(F.col("w") > 0).select("bucket", (F.col("total") * F.col("w") / F.col("sw") / F.col("n")).alias("rate"))
    rate = rate.withColumn("parts", F.greatest(F.lit(1), F.ceil(F.col("rate") / STEP)).cast("int")).withColumn("step", F.col("rate") / F.col("parts"))
    start = F.struct(F.exp(-F.col("step")).alias("p"), F.exp(-F.col("step")).alias("c"), F.array(F.exp(-F.col("step"))).alias("cdf"))
    grow = lambda acc, k: F.struct((acc["p"] * F.col("step") / k).alias("p"), (acc["c"] + acc["p"] * F.col("step") / k).alias("c"), F.array_append(acc["cdf"], acc["c"] + acc["p"] * F.col("step") / k).alias("cdf"))
    return rate.select("bucket", "rate", "parts", F.aggregate(F.transform(F.sequence(F.lit(1), F.lit(TERMS)), lambda k: k.cast("double")), start, grow, lambda acc: acc["cdf"]).alias("cdf"))


def _bucket(weights: Mapping[str, float], source_col: str) -> Column:
    """The source itself if it has a weight, else '*' (null too)."""
    return F.when(F.col(source_col).isin(*weights), F.col(source_col)).otherwise(F.lit("*")) if weights else F.lit("*")


def _draw(cdf: Column, key: Column, seed: int, j: Column) -> Column:
    u = _uniform(F.concat(key, F.lit(f":{seed}:"), j.cast("string")))
    return F.size(F.filter(cdf, lambda c: c <= u))


def mix(docs: DataFrame, weights: Mapping[str, float] = WEIGHTS, other: float = OTHER, total: int | None = None, seed: int = SEED, id_col: str = "doc_id", source_col: str = "source", block: int = BLOCK) -> DataFrame:
    """All columns of ``docs`` plus copy (int, from 0) and shuffle_key (long).

    The expected number of rows is ``total`` (None: as many as the input rows of
    weighted sources), shared among the sources that occur in proportion to
    their weights. Sources without a weight, null included, form one bucket of
    weight ``other``; a weight of 0 leaves a source out. Equal rows (same id)
    draw equal counts. A null id is hashed as ''. An input column named copy or
    shuffle_key is replaced; others keep their names and values, whatever they are called. An empty input
    gives an empty output.

    The rate table has at most len(weights) + 1 rows, so it is broadcast; the
    only full shuffle is the global one, on a hash no key can make skewed. Documents that need more than
    ``block`` draws are dealt out first, ``block`` draws to a task's row, so that no row explodes alone.
    """
    kept = columns(docs, "copy", "shuffle_key")
    key = F.coalesce(F.col(quoted(id_col)).cast("string"), F.lit(""))
    rate = rates(docs, weights, other, total, source_col)
    bucket, parts, cdf, first, n, at = fresh(docs, "bucket", "parts", "cdf", "first", "n", "at")
    named = rate.select(F.col("bucket").alias(bucket), F.col("parts").alias(parts), F.col("cdf").alias(cdf))
    rated = docs.select(*kept, _bucket(weights, source_col).alias(bucket)).join(F.broadcast(named), bucket)
    # The uniform number is computed once, and not for each term.
    rated = rated.withColumn(first, _uniform(F.concat(key, F.lit(f":{seed}:0"))))
    once = F.size(F.filter(F.col(cdf), lambda c: c <= F.col(first)))
    more = F.aggregate(F.sequence(F.lit(1), F.col(parts) - 1), F.lit(0), lambda s, j: s + _draw(F.col(cdf), key, seed, j))
    light = rated.where(F.col(parts) <= block).withColumn(n, once + F.when(F.col(parts) > 1, more).otherwise(0)).where(F.col(n) > 0)
    copies = light.select(*kept, F.explode(F.sequence(F.lit(0), F.col(n) - 1)).alias("copy"))
    heavy = [r.bucket for r in rate.where(F.col("parts") > block).select("bucket").collect()]  # len(weights) + 1 rows at most
    if heavy:
        row, piece = fresh(docs, "row", "piece")
        long = written(rated.where(F.col(bucket).isin(*heavy)).withColumn(row, F.monotonically_increasing_id()), "repeated")
        pieces = long.select(row, key.alias(first), parts, bucket, F.explode(F.sequence(F.lit(0), F.floor((F.col(parts) - 1) / block).cast("int"))).alias(piece)).repartition(row, piece).join(F.broadcast(named.drop(parts)), bucket)
        span = F.sequence(F.col(piece) * block, F.least((F.col(piece) + 1) * block, F.col(parts)) - 1)
        counted = written(pieces.select(row, piece, F.aggregate(span, F.lit(0), lambda s, j: s + _draw(F.col(cdf), F.col(first), seed, j)).alias(n)), "draws")
        upto = F.sum(n).over(Window.partitionBy(row).orderBy(piece))
        placed = counted.select(row, F.col(n), (upto - F.col(n)).cast("int").alias(at)).where(F.col(n) > 0).withColumnRenamed(row, piece)
        many = placed.join(long, F.col(piece) == F.col(row)).select(*kept, F.explode(F.sequence(F.col(at), F.col(at) + F.col(n).cast("int") - 1)).alias("copy"))
        copies = copies.unionByName(many)
    shuffle_key = F.conv(F.substring(F.md5(F.concat(key, F.lit(f":{seed}:copy:"), F.col("copy").cast("string")).cast("binary")), 1, 15), 16, 10).cast("long")
    return copies.withColumn("shuffle_key", shuffle_key).repartition("shuffle_key").sortWithinPartitions("shuffle_key")


def op2_poisson_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(table(spark, sf_dir, "documents"))


def oracle(columns: str = "doc_id, text, lang, source, n_chars", docs: str = "documents") -> str:
    """DuckDB SQL of mix() with the production parameters."""
    listed = ", ".join(f"('{k}', CAST({v} AS DOUBLE))" for k, v in WEIGHTS.items())
    uniform = f"CAST(CAST('0x' || substr(md5(CAST(b.doc_id AS VARCHAR) || ':{SEED}:' || CAST(j AS VARCHAR)), 1, 13) AS BIGINT) AS DOUBLE) / {float(1 << 52)}"
    return f"""
WITH RECURSIVE w(source, weight) AS (VALUES {listed}),
b AS (SELECT d.*, coalesce(w.source, '*') AS bucket, coalesce(w.weight, {OTHER}) AS weight FROM {docs} d LEFT JOIN w ON w.source = d.source),
n AS (SELECT bucket, any_value(weight) AS weight, count(*) AS n FROM b GROUP BY bucket),
r0 AS (SELECT bucket, (SELECT sum(n) FROM n) * weight / (SELECT sum(weight) FROM n) / n AS rate FROM n),
r AS (SELECT bucket, greatest(1, CAST(ceil(rate / {STEP}) AS INT)) AS parts, rate / greatest(1, CAST(ceil(rate / {STEP}) AS INT)) AS step FROM r0),
cdf AS (SELECT bucket, step, 0 AS k, exp(-step) AS p, exp(-step) AS c FROM r
  UNION ALL SELECT bucket, step, k + 1, p * step / (k + 1), c + p * step / (k + 1) FROM cdf WHERE k < {TERMS}),
lists AS (SELECT bucket, list(c ORDER BY k) AS cs FROM cdf GROUP BY bucket),
draws AS (SELECT b.doc_id, b.bucket, unnest(range(0, parts)) AS j FROM (SELECT DISTINCT doc_id, bucket FROM b) b JOIN r USING (bucket)),
counts AS (SELECT b.doc_id, b.bucket, sum(len(list_filter(l.cs, lambda c: c <= {uniform}))) AS k FROM draws b JOIN lists l USING (bucket) GROUP BY b.doc_id, b.bucket),
x AS (SELECT b.*, unnest(range(0, CAST(k AS BIGINT))) AS copy FROM b JOIN counts USING (doc_id, bucket))
SELECT {columns}, CAST(copy AS INT) AS copy,
  CAST('0x' || substr(md5(CAST(doc_id AS VARCHAR) || ':{SEED}:copy:' || CAST(copy AS VARCHAR)), 1, 15) AS BIGINT) AS shuffle_key
FROM x"""
