"""Positions in a total order, and order statistics, without a group in one task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quire.functions.text import let

#: Ranges of the first column that rows are sorted in apart, and values that are looked at to place each bound.
RANGES, LOOKED_AT = 256, 16
#: Rows that are worth a range of their own.
ROWS = 200_000
#: Ranges of a group's values, about.
STEPS = 64


def bounds(rows: DataFrame, column: str, ranges: int | None = None) -> list:
    """Values, in order, that part the rows into ranges of about one size; at most RANGES - 1, from a
    sample by hash of LOOKED_AT times as many values."""
    values = rows.select(F.col(column).alias("v")).where("v IS NOT NULL")
    if ranges is None:
        ranges = min(RANGES, values.count() // ROWS + 1)
    if ranges < 2:
        return []
    kinds = values.agg(F.approx_count_distinct("v").alias("n")).first().n
    share = min(1.0, ranges * LOOKED_AT / max(1, kinds))
    seen = values.where(F.pmod(F.xxhash64("v"), F.lit(1 << 20)) < int(share * (1 << 20)) + 1).groupBy("v").agg(F.count(F.lit(1)).alias("n"))
    found = sorted((r.v, r.n) for r in seen.orderBy(F.xxhash64("v")).limit(4 * ranges * LOOKED_AT).collect())
    out, passed, total = [], 0, sum(n for _, n in found)
    for v, n in found:
        passed += n
        if passed * ranges >= total * (len(out) + 1) and len(out) < ranges - 1:
            out.append(v)
    return out


def positions(rows: DataFrame, order: list[str], name: str = "position", ranges: int | None = None) -> DataFrame:
    """``rows`` with their place, from 0, in the order of some columns (nulls first); ties
    take places in any order. Rows are sorted within ranges of the first column."""
    cuts = bounds(rows, order[0], ranges)
    place = F.size(F.filter(F.array(*map(F.lit, cuts)), lambda b: b < F.col(order[0]))) if cuts else F.lit(0)
    ranged = rows.withColumn("_range", F.coalesce(F.when(F.col(order[0]).isNotNull(), place), F.lit(-1)))
    sizes = ranged.groupBy("_range").agg(F.count(F.lit(1)).alias("_n"))
    # RANGES + 1 rows at most.
    before = sizes.select(F.col("_range").alias("_at"), F.coalesce(F.sum("_n").over(Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_before"))
    within = ranged.withColumn("_k", F.row_number().over(Window.partitionBy("_range").orderBy(*order)))
    return within.join(F.broadcast(before), F.col("_range") == F.col("_at")).select(*rows.columns, (F.col("_before") + F.col("_k") - 1).alias(name))


def fused(a: Column, b: Column, c: Column) -> Column:
    """a * b + c of doubles, rounded once: the errors of the product (Dekker) and of the sum (Knuth) are added
    last. Where they aren't finite, a * b + c as it stands."""

    def halves(x, body):
        return let(134217729.0 * x, lambda t: let(t - (t - x), lambda high: body(high, x - high)))

    def added(p, error):
        return let(p + c, lambda s: let(s - p, lambda z: let(s + ((p - (s - z)) + (c - z) + error), lambda exact: F.when(F.isnan(exact), s).otherwise(exact))))

    return let(a * b, lambda p: halves(a, lambda ah, al: halves(b, lambda bh, bl: added(p, ((ah * bh - p) + ah * bl + al * bh) + al * bl))))


def percentiles(rows: DataFrame, group: list[str], value: Column, shares: list[float]) -> DataFrame:
    """(group..., p0, p1...): the exact percentiles of each group's values that aren't null, by linear
    interpolation between neighbours (R-7), in the steps of DuckDB's, so that halves are rounded alike.
    Values are counted first, and sorted within about STEPS ranges of each group. Bounds come from a sample by hash,
    LOOKED_AT values each: ranges are computed twice, and a sketch differs from itself when its parts are merged
    in another order. Groups of fewer values are one range."""
    keys = [f"_g{k}" for k in range(len(group))]
    others = [f"_h{k}" for k in range(len(group))]
    renamed = dict(zip(keys, others, strict=True))
    same = [F.col(k).eqNullSafe(F.col(h)) for k, h in renamed.items()]
    counted = rows.select(*[F.col(g).alias(k) for g, k in zip(group, keys, strict=True)], value.alias("_v")).where("_v IS NOT NULL").groupBy(*keys, "_v").agg(F.count(F.lit(1)).alias("_n"))
    totals = counted.groupBy(*keys).agg(F.sum("_n").alias("_total"), F.count(F.lit(1)).alias("_kinds")).withColumnsRenamed(renamed)
    sized = counted.join(totals, same).drop(*others)
    seen = F.pmod(F.xxhash64("_v"), F.lit(1 << 40)).cast("double") * F.col("_kinds") < float(STEPS * LOOKED_AT << 40)
    looked_at = sized.where((F.col("_kinds") > STEPS * LOOKED_AT) & seen).groupBy(*keys).agg(F.sort_array(F.collect_list("_v")).alias("_seen"))
    cuts = looked_at.select(*keys, F.filter("_seen", lambda _, k: k % LOOKED_AT == LOOKED_AT - 1).alias("_bounds")).withColumnsRenamed(renamed)
    below = F.size(F.filter("_bounds", lambda b: b < F.col("_v")))
    ranged = sized.join(cuts, same, "left").withColumn("_range", F.when(F.col("_bounds").isNotNull(), below).otherwise(0)).drop("_bounds", "_kinds", *others)
    upto = ranged.withColumn("_in", F.sum("_n").over(Window.partitionBy(*keys, "_range").orderBy("_v").rowsBetween(Window.unboundedPreceding, 0)))
    sizes = ranged.groupBy(*keys, "_range").agg(F.sum("_n").alias("_s"))
    before = sizes.select(*[F.col(k).alias(h) for k, h in zip(keys, others, strict=True)], F.col("_range").alias("_r"), F.coalesce(F.sum("_s").over(Window.partitionBy(*keys).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_before"))
    placed = upto.join(before, [*same, F.col("_range") == F.col("_r")]).withColumn("_upto", F.col("_before") + F.col("_in"))
    place = lambda p: (F.col("_total") - 1) * F.lit(p)
    at = lambda index: F.min(F.when(F.col("_upto") > index, F.col("_v")))
    found = placed.groupBy(*keys).agg(*[x for k, p in enumerate(shares) for x in (at(F.floor(place(p))).alias(f"_lo{k}"), at(F.ceil(place(p))).alias(f"_hi{k}"), F.max(place(p) - F.floor(place(p))).alias(f"_part{k}"))])
    weighed = lambda low, high, part: F.when(part == 0, low).otherwise(fused(low, 1 - part, high * part))
    between = [weighed(F.col(f"_lo{k}").cast("double"), F.col(f"_hi{k}").cast("double"), F.col(f"_part{k}")).alias(f"p{k}") for k in range(len(shares))]
    return found.select(*[F.col(k).alias(g) for g, k in zip(group, keys, strict=True)], *between)
