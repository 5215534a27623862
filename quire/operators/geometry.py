"""Boxes, edges, clusters and tables on pages, and image arithmetic."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Tolerances, weights, resolutions.
X_WEIGHT, Y_WEIGHT = 5.0, 1.0
TOLERANCE = 3.0
POINTS, LEAST_DPI, MEMORY_MB = 72.0, 72, 2048.0
FONT_GROUPS, FONT_ROUNDS, FONT_CONVERGED, FONT_SAME = 6, 100, 0.01, 0.05

Box = tuple[Column, Column, Column, Column]


def box(prefix: str) -> Box:
    """Columns prefix_x0, _y0, _x1 and _y1."""
    return tuple(F.col(f"{prefix}_{c}") for c in ("x0", "y0", "x1", "y1"))


def area(a: Box) -> Column:
    return F.greatest(a[2] - a[0], F.lit(0.0)) * F.greatest(a[3] - a[1], F.lit(0.0))


def shared_area(a: Box, b: Box) -> Column:
    return F.greatest(F.least(a[2], b[2]) - F.greatest(a[0], b[0]), F.lit(0.0)) * F.greatest(F.least(a[3], b[3]) - F.greatest(a[1], b[1]), F.lit(0.0))


def iou(a: Box, b: Box) -> Column:
    union = area(a) + area(b) - shared_area(a, b)
    return F.when(union <= 0, 0.0).otherwise(shared_area(a, b) / union)


def share(a: Box, b: Box) -> Column:
    return F.when(area(a) <= 0, 0.0).otherwise(shared_area(a, b) / area(a))


def weighted_distance(a: Box, b: Box) -> Column:
    """Between centres, the horizontal part counting five times."""
    return F.abs((a[0] + a[2] - b[0] - b[2]) / 2) * X_WEIGHT + F.abs((a[1] + a[3] - b[1] - b[3]) / 2) * Y_WEIGHT


def contains(a: Box, b: Box) -> Column:
    return (b[0] >= a[0]) & (b[2] <= a[2]) & (b[1] >= a[1]) & (b[3] <= a[3])


def grown(a: Box, by: float) -> Box:
    e = F.greatest(F.least(a[2] - a[0], a[3] - a[1]), F.lit(0.0)) * by
    return a[0] - e, a[1] - e, a[2] + e, a[3] + e


def relaxed_iou(a: Box, b: Box, by: float) -> Column:
    return iou(grown(a, by), grown(b, by))


def merged(a: Box, b: Box) -> Box:
    return F.least(a[0], b[0]), F.least(a[1], b[1]), F.greatest(a[2], b[2]), F.greatest(a[3], b[3])


def overlaps(a: Box, b: Box) -> Column:
    """Boxes share more than a point; touching sides count."""
    w, h = F.least(a[2], b[2]) - F.greatest(a[0], b[0]), F.least(a[3], b[3]) - F.greatest(a[1], b[1])
    return (w >= 0) & (h >= 0) & (w + h > 0)


def are_neighbours(a: Box, b: Box, x: float, y: float) -> Column:
    def near(p: Box, q: Box) -> Column:
        return (p[0].between(q[0] - x, q[2] + x) | p[2].between(q[0] - x, q[2] + x)) & (p[1].between(q[1] - y, q[3] + y) | p[3].between(q[1] - y, q[3] + y))

    return near(a, b) | near(b, a)


def gap_clusters(rows: DataFrame, group: list[str], value: str, tolerance: float, name: str = "cluster") -> DataFrame:
    """Numbers clusters of sorted values: a gap over the tolerance starts one, and
    with tolerance 0 each row is one."""
    order = Window.partitionBy(*group).orderBy(value)
    if tolerance == 0:
        return rows.withColumn(name, F.row_number().over(order) - 1)
    starts = F.when(F.col(value) - F.lag(value).over(order) > tolerance, 1).otherwise(0)
    return rows.withColumn("_s", starts).withColumn(name, F.sum("_s").over(order.rangeBetween(Window.unboundedPreceding, Window.currentRow)).cast("int")).drop("_s")


def snap_edges(edges: DataFrame, page: str, tolerance: float = TOLERANCE) -> DataFrame:
    """Edges (orientation h or v, place, low, high), with ``place`` the mean of its cluster."""
    clustered = gap_clusters(edges, [page, "orientation"], "place", tolerance)
    mean = F.avg("place").over(Window.partitionBy(page, "orientation", "cluster"))
    return clustered.withColumn("place", mean).drop("cluster")


def merge_edges(edges: DataFrame, page: str, tolerance: float = TOLERANCE) -> DataFrame:
    """Edges on one line that overlap or nearly meet become one."""
    order = Window.partitionBy(page, "orientation", "place").orderBy("low", "high")
    reach = F.max("high").over(order.rowsBetween(Window.unboundedPreceding, -1))
    starts = edges.withColumn("_new", F.when(F.col("low") > reach + tolerance, 1).otherwise(0))
    runs = starts.withColumn("_run", F.sum("_new").over(order.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    return runs.groupBy(page, "orientation", "place", "_run").agg(F.min("low").alias("low"), F.max("high").alias("high")).drop("_run")


def intersections(edges: DataFrame, page: str, tolerance: float = TOLERANCE) -> DataFrame:
    """(page, x, y) where a vertical meets a horizontal edge of the same page."""
    v = edges.where("orientation = 'v'").select(page, F.col("place").alias("x"), F.col("low").alias("top"), F.col("high").alias("bottom"))
    h = edges.where("orientation = 'h'").select(F.col(page).alias("_page"), F.col("place").alias("y"), F.col("low").alias("left"), F.col("high").alias("right"))
    meet = (F.col(page) == F.col("_page")) & (F.col("top") <= F.col("y") + tolerance) & (F.col("bottom") >= F.col("y") - tolerance) & F.col("x").between(F.col("left") - tolerance, F.col("right") + tolerance)
    return v.join(h, meet).select(page, "x", "y", "top", "bottom", "left", "right")


def cells(points: DataFrame, page: str) -> DataFrame:
    """(page, x0, y0, x1, y1): for each crossing the nearest rectangle down and to
    the right whose sides lie on single edges. Crossings of one page are few."""

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        at = {(r.x, r.y): r for r in rows.itertuples()}
        xs, ys = sorted({p[0] for p in at}), sorted({p[1] for p in at})
        out = []
        for x, y in sorted(at):
            p = at[x, y]
            found = None
            for y1 in (b for b in ys if b > y and (x, b) in at and p.bottom >= b):
                for x1 in (b for b in xs if b > x and (b, y) in at and p.right >= b):
                    q = at.get((x1, y1))
                    if q and at[x1, y].bottom >= y1 and at[x, y1].right >= x1:
                        found = (x, y, x1, y1)
                        break
                if found:
                    break
            if found:
                out.append((rows[page].iloc[0], *found))
        return pd.DataFrame(out, columns=[page, "x0", "y0", "x1", "y1"])

    schema = points.select(page).schema.add("x0", "double").add("y0", "double").add("x1", "double").add("y1", "double")
    return points.groupBy(page).applyInPandas(run, schema)


def tables_of_cells(found: DataFrame, page: str) -> DataFrame:
    """Adds table_index: cells that share a corner, directly or through others, are
    one table; tables go by their first cell from top and left."""

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["y0", "x0"]).reset_index(drop=True)
        label = list(range(len(rows)))

        def find(k: int) -> int:
            while label[k] != k:
                label[k] = label[label[k]]
                k = label[k]
            return k

        corner: dict[tuple[float, float], int] = {}
        for k, r in enumerate(rows.itertuples()):
            for c in ((r.x0, r.y0), (r.x0, r.y1), (r.x1, r.y0), (r.x1, r.y1)):
                a, b = find(k), find(corner.setdefault(c, k))
                label[max(a, b)] = min(a, b)
        roots = [find(k) for k in range(len(rows))]
        number = {r: i for i, r in enumerate(sorted(set(roots)))}
        return rows.assign(table_index=np.array([number[r] for r in roots], np.int32))

    return found.groupBy(page).applyInPandas(run, found.select("*").schema.add("table_index", "integer"))


def words_of_characters(chars: DataFrame, page: str, gap: float = TOLERANCE) -> DataFrame:
    """(page, line, word_index, text, x0, x1) of characters (line, x, width, ch): a
    blank, or a gap wider than ``gap``, ends a word."""
    order = Window.partitionBy(page, "line").orderBy("x")
    blank = F.col("ch").rlike(r"^\s$")
    new = F.when(F.lag(blank).over(order) | (F.col("x") - F.lag(F.col("x") + F.col("width")).over(order) > gap), 1).otherwise(0)
    runs = chars.withColumn("_b", blank).withColumn("_n", new).withColumn("_w", F.sum("_n").over(order.rowsBetween(Window.unboundedPreceding, Window.currentRow))).where("NOT _b")
    words = runs.groupBy(page, "line", "_w").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("x", "ch"))), lambda s: s["ch"]), "").alias("text"), F.min("x").alias("x0"), F.max(F.col("x") + F.col("width")).alias("x1"))
    return words.select(page, "line", (F.row_number().over(Window.partitionBy(page, "line").orderBy("x0")) - 1).alias("word_index"), "text", "x0", "x1")


def font_levels(blocks: DataFrame, key: str, size: str, groups: int = FONT_GROUPS) -> DataFrame:
    """(key, centroid, members, level): font sizes of a document by 1-D k-means,
    seeded from its distinct sizes; the fullest cluster is body text, larger ones
    are headings 1 to 6. Sizes are counted first, so a group has few rows."""
    counted = blocks.where(F.col(size).isNotNull() & ~F.isnan(size) & (F.abs(size) != float("inf"))).groupBy(key, size).agg(F.count(F.lit(1)).alias("n"))

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        x, n = rows[size].to_numpy(float), rows["n"].to_numpy()
        k = int(min(groups, n.sum()))
        seeds: list[float] = []
        for v in np.sort(x)[::-1]:
            if not seeds or abs(seeds[-1] - v) >= FONT_SAME:
                seeds.append(float(v))
        if len(seeds) >= k:
            centres = np.array(seeds[:: len(seeds) // k][:k])
        else:
            spread = [seeds[0] - i / (k - 1) * (seeds[0] - seeds[-1]) for i in range(len(seeds), k)]
            centres = np.array(sorted(seeds + spread, reverse=True))
        for _ in range(FONT_ROUNDS):
            near = np.abs(x[:, None] - centres).argmin(1)
            mass = np.bincount(near, n, k)
            new = np.where(mass > 0, np.bincount(near, n * x, k) / np.maximum(mass, 1), centres)
            done = (np.abs(new - centres) < FONT_CONVERGED).all()
            centres = new
            if done:
                break
        mass = np.bincount(np.abs(x[:, None] - centres).argmin(1), n, k)
        full = [(float(c), int(m)) for c, m in sorted(zip(centres, mass, strict=True), reverse=True) if m > 0]
        body = max(full, key=lambda cm: (cm[1], -cm[0]))[0]
        larger = [c for c, _ in full if c > body][:6]
        return pd.DataFrame([(rows[key].iloc[0], c, m, larger.index(c) + 1 if c in larger and len(full) > 1 else None) for c, m in full], columns=[key, "centroid", "members", "level"]).astype({"level": "Int32"})

    return counted.groupBy(key).applyInPandas(run, blocks.select(key).schema.add("centroid", "double").add("members", "long").add("level", "integer"))


def smart_dpi(width: Column, height: Column, target: int, most_pixels: int, memory_mb: float = MEMORY_MB) -> Column:
    """The target resolution, less if memory or the largest side ask for it, 72 at least. Sizes in points."""
    side = round((memory_mb * 1024 * 1024 / 3.0) ** 0.5)
    w, h = width / POINTS, height / POINTS
    by = lambda pixels: F.least(*[F.when(x > 0, F.round(pixels / x)).otherwise(F.lit(float(target))) for x in (w, h)])
    large = F.greatest(F.round(w * target), F.round(h * target)) > most_pixels
    return F.greatest(F.lit(LEAST_DPI), F.least(F.lit(target), by(float(side)).cast("int"), F.when(large, by(float(most_pixels)).cast("int")).otherwise(target)))


def box_edges(boxes: DataFrame, page: str, prefix: str) -> DataFrame:
    """The four sides of each box as edges (orientation, place, low, high)."""
    x0, y0, x1, y1 = box(prefix)
    side = lambda o, p, a, b: F.struct(F.lit(o).alias("orientation"), p.alias("place"), a.alias("low"), b.alias("high"))
    return boxes.select(page, F.explode(F.array(side("h", y0, x0, x1), side("h", y1, x0, x1), side("v", x0, y0, y1), side("v", x1, y0, y1))).alias("e")).select(page, "e.*")


def filter_edges(edges: DataFrame, least: float, orientation: str | None = None) -> DataFrame:
    kept = edges.where(F.col("high") - F.col("low") >= least)
    return kept.where(F.col("orientation") == orientation) if orientation else kept


def clip_edges(edges: DataFrame, x0: float, y0: float, x1: float, y1: float) -> DataFrame:
    """Edges cut to a region; those outside go."""
    across = F.when(F.col("orientation") == "h", F.struct(F.lit(y0).alias("a"), F.lit(y1).alias("b"), F.lit(x0).alias("c"), F.lit(x1).alias("d"))).otherwise(F.struct(F.lit(x0).alias("a"), F.lit(x1).alias("b"), F.lit(y0).alias("c"), F.lit(y1).alias("d")))
    cut = edges.withColumn("_r", across).where(F.col("place").between(F.col("_r.a"), F.col("_r.b")))
    return cut.withColumn("low", F.greatest("low", F.col("_r.c"))).withColumn("high", F.least("high", F.col("_r.d"))).where("low < high").drop("_r")


def edges_of_words(words: DataFrame, page: str, least: int = 3, tolerance: float = TOLERANCE) -> DataFrame:
    """Vertical edges where the left sides (x0) of at least ``least`` words line up."""
    clustered = gap_clusters(words, [page], "x0", tolerance)
    return clustered.groupBy(page, "cluster").agg(F.count(F.lit(1)).alias("n"), F.min("x0").alias("place"), F.min("y0").alias("low"), F.max("y1").alias("high")).where(F.col("n") >= least).select(page, F.lit("v").alias("orientation"), "place", "low", "high")


def nearest_centre(blocks: DataFrame, size: str, centres: list[float]) -> DataFrame:
    """Adds centre: the nearest of a given list, the first of equally near ones."""
    near = F.array_min(F.array(*[F.struct(F.abs(F.col(size) - c).alias("d"), F.lit(i).alias("i"), F.lit(float(c)).alias("c")) for i, c in enumerate(centres)]))
    return blocks.withColumn("centre", near["c"])
