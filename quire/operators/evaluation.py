"""Evaluation analytics: bags of words, group statistics, rankings, agreement."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quire.operators import ordering


def tokens(text: Column) -> Column:
    """Lower-case words of letters, digits and dots."""
    bare = F.transform(F.split(F.lower(text), r"\s+"), lambda w: F.regexp_replace(w, r"[^\p{L}\p{N}.]", ""))
    return F.filter(bare, lambda w: w != "")


def numeric(bag: Column) -> Column:
    return F.filter(bag, lambda w: w.rlike("[0-9]"))


def bag_f1(pairs: DataFrame, left: str, right: str, key: str, name: str) -> DataFrame:
    """(key, name): F1 of two bags of tokens per key, by the sum of the lesser
    counts; 1 if both are empty, 0 if one is. Two aggregations, no pairing of tokens."""
    long = pairs.select(key, F.explode(F.col(left)).alias("t"), F.lit(1).alias("l"), F.lit(0).alias("r")).unionByName(pairs.select(key, F.explode(F.col(right)).alias("t"), F.lit(0).alias("l"), F.lit(1).alias("r")))
    shared = long.groupBy(key, "t").agg(F.sum("l").alias("l"), F.sum("r").alias("r")).groupBy(key).agg(F.sum(F.least("l", "r")).alias("both"))
    sizes = pairs.select(key, F.size(left).alias("nl"), F.size(right).alias("nr"))
    score = F.when((F.col("nl") == 0) & (F.col("nr") == 0), 1.0).when(F.coalesce("both", F.lit(0)) == 0, 0.0).otherwise(2.0 * F.col("both") / (F.col("nl") + F.col("nr")))
    return sizes.join(shared, key, "left").select(key, score.alias(name))


def finite(x: Column) -> Column:
    """Null for what isn't a finite number."""
    return F.when(~F.isnan(x) & (F.abs(x) != float("inf")), x)


def group_stats(rows: DataFrame, group: list[str], value: str, only_finite: bool = True) -> DataFrame:
    """Count, mean, sample variance and deviation (0 for one row), extremes, R-7 percentiles;
    of finite values, unless NaN and infinities are to count as in SQL."""
    v = finite(F.col(value)) if only_finite else F.col(value)
    plain = rows.groupBy(*group).agg(
        F.count(v).alias("n"),
        F.avg(v).alias("mean"),
        F.coalesce(F.var_samp(v), F.lit(0.0)).alias("variance"),
        F.coalesce(F.stddev_samp(v), F.lit(0.0)).alias("std_dev"),
        F.min(v).alias("least"),
        F.max(v).alias("most"),
    )
    found = ordering.percentiles(rows, group, v, [0.5, 0.95, 0.99])
    named = found.select(*[F.col(g).alias(f"_of_{g}") for g in group], F.col("p0").alias("median"), F.col("p1").alias("p95"), F.col("p2").alias("p99"))
    return plain.join(named, [F.col(g).eqNullSafe(F.col(f"_of_{g}")) for g in group], "left").drop(*[f"_of_{g}" for g in group])


def ranked(groups: DataFrame, name: str, value: str, ascending: bool = True) -> DataFrame:
    """Rank by value, ties by name, and the value relative to the best. Groups are few: one row each."""
    order = Window.orderBy(F.col(value).asc() if ascending else F.col(value).desc(), name)
    best = F.first(value).over(order)
    return groups.select(name, F.col(value).alias("value"), F.row_number().over(order).alias("rank"), F.when(best > 0, F.col(value) / best).otherwise(1.0).alias("relative"))


def deltas(groups: DataFrame, name: str, value: str, others: list[str]) -> DataFrame:
    """Differences, absolute and in percent, from the group of the least value."""
    base = groups.orderBy(value, name).limit(1).select(F.col(name).alias("base_name"), *[F.col(c).alias(f"base_{c}") for c in (value, *others)])
    # One row against the few groups.
    both = groups.join(F.broadcast(base), F.col(name) != F.col("base_name"))
    out = []
    for c in (value, *others):
        d = F.col(c) - F.col(f"base_{c}")
        out += [d.alias(f"{c}_delta"), F.when(F.col(f"base_{c}") > 0, d / F.col(f"base_{c}") * 100).otherwise(0.0).alias(f"{c}_percent")]
    return both.select(name, "base_name", *out)


def consensus(rows: DataFrame, item: str, success: str) -> DataFrame:
    """Share of items of which every row succeeds, with the counts."""
    each = rows.groupBy(item).agg(F.bool_and(success).alias("all_ok"))
    return each.agg(F.count(F.lit(1)).alias("n_items"), F.count_if("all_ok").alias("n_agreed"), F.avg(F.col("all_ok").cast("double")).alias("consensus_rate"))


def shard(rows: DataFrame, order: str, shards: int) -> DataFrame:
    """Numbers the distinct values of a column in their order, and deals them round."""
    placed = ordering.positions(rows.select(order).distinct(), [order])
    return placed.select(order, "position", F.pmod("position", F.lit(shards)).alias("shard"))


def perfect(rows: DataFrame, group: str, success: str) -> DataFrame:
    """(group, n) of the groups of more than one row, all of which succeed."""
    each = rows.groupBy(group).agg(F.count(F.lit(1)).alias("n"), F.bool_and(success).alias("all_ok"))
    return each.where("all_ok AND n > 1").select(group, "n")
