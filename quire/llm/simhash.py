"""SimHash near-duplicates, found in BK-trees.

Documents get a 64-bit fingerprint; distinct ones are dealt into shards such
that any two within the radius meet in one at least. Each shard is a BK-tree,
its children keyed by their Hamming distance to the parent; a query follows only
edges within the radius. Each shard sends one edge per linked fingerprint, and
the edges are contracted into components.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import accumulate, combinations

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import LongType

from quire.llm.common import columns, dropped, fresh, quoted, table, texts, with_columns, written

RADIUS = 4
SHINGLE = 4
SEED = 42
#: Mean size of a shard that isn't exceeded by choice of the shards' bits.
SHARD = 256
#: A shard of more fingerprints is dealt anew, by more bits that its members share.
DEEP = 32_768
#: A shard of more fingerprints is dealt into parts of about so many, and each
#: two parts meet in a task of their own.
PART = 4096
#: Fingerprints that a task takes up at a time, and tree visits in flight.
TAKEN, VISITS = 200_000, 1 << 21


def fingerprint(text: str, size: int = SHINGLE) -> int:
    """Bit by bit the majority of the hashes of all word shingles, repeats
    included; words are runs between ASCII white space, A-Z in lower case. Fewer
    words than a shingle's are one shingle, no words give 0."""
    words = text.encode().lower().split()
    if not words:
        return 0
    line = b" ".join(words)
    ends = list(accumulate(len(w) + 1 for w in words))
    spans = list(zip([0, *ends], ends[size - 1 :], strict=False)) or [(0, len(line) + 1)]
    ones = np.zeros(64, np.int64)
    for at in range(0, len(spans), 1 << 16):
        h = np.fromiter((xxhash.xxh64_intdigest(line[a : b - 1], SEED) for a, b in spans[at : at + (1 << 16)]), np.uint64)
        ones += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(ones * 2 > len(spans), bitorder="little").view(np.int64)[0])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, fp) of each row; fp as a signed long. Null and empty texts have fp 0; repeated rows, and rows of
    null ids, have one each; an empty table has none."""
    rows = texts(docs, id_col, text_col)
    return with_columns(rows, [("fp", LongType())], lambda batch: [[fingerprint(t) for t in batch]]).select("doc_id", "fp")


def shard_masks(n: int, radius: int = RADIUS, shard: int = SHARD) -> list[int]:
    """Bits that the members of a shard share, for each family of shards.

    Of radius + s blocks of bits, two fingerprints within the radius share s at
    least. More shared blocks make more families of smaller shards; the result
    is the same, so their number follows the number of fingerprints.
    """
    for s in range(1, 5):
        blocks = radius + s
        if n / 2 ** (64 * s / blocks) <= shard or s == 4:
            break
    cuts = [round(64 * k / blocks) for k in range(blocks + 1)]
    parts = [((1 << b) - 1) ^ ((1 << a) - 1) for a, b in zip(cuts, cuts[1:], strict=False)]
    return [sum(c) for c in combinations(parts, s)]


def deeper_masks(mask: int, radius: int = RADIUS) -> list[int]:
    """Bits that the members of each shard within a shard of ``mask`` share: of radius + 2 blocks of the bits
    outside the mask two at least are alike in fingerprints within the radius."""
    outside = [b for b in range(64) if not mask >> b & 1]
    cuts = [round(len(outside) * k / (radius + 2)) for k in range(radius + 3)]
    blocks = [sum(1 << b for b in outside[a:z]) for a, z in zip(cuts, cuts[1:], strict=False)]
    return [mask | x | y for x, y in combinations(blocks, 2)]


def _signed(mask: int) -> int:
    return mask - (1 << 64) if mask >> 63 else mask


class Forest:
    """One BK-tree for each run of equal ``cell``; a node is an index of ``fp``."""

    def __init__(self, cell: np.ndarray, fp: np.ndarray):
        self.fp = fp
        self.cells, first = np.unique(cell, return_index=True)
        self.roots = first
        parent, key = np.full(len(fp), -1), np.zeros(len(fp), np.int64)
        # Level by level, for all trees at once: the first of each group is its
        # node, the others go by their distance to it.
        items, group = np.arange(len(fp)), cell
        while len(items):
            order = np.argsort(group, kind="stable")
            items, group = items[order], group[order]
            start = np.concatenate(([True], group[1:] != group[:-1]))
            node = items[start][np.cumsum(start) - 1]
            items, node = items[~start], node[~start]
            group = node * 65 + np.bitwise_count(fp[items] ^ fp[node])
            parent[items], key[items] = node, group
        children = np.flatnonzero(parent >= 0)
        children = children[np.argsort(key[children], kind="stable")]
        self.children, self.keys = children, key[children]

    def near(self, cell: np.ndarray, fp: np.ndarray, radius: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Pairs (query, node) within the radius, a part at a time."""
        if not len(self.fp) or not len(fp):
            return
        at = np.minimum(np.searchsorted(self.cells, cell), len(self.cells) - 1)
        query = np.flatnonzero(self.cells[at] == cell)
        stack = [(query, self.roots[at[query]])]
        while stack:
            q, node = stack.pop()
            if len(q) > VISITS:
                half = len(q) // 2
                stack += [(q[half:], node[half:]), (q[:half], node[:half])]
                continue
            d = np.bitwise_count(fp[q] ^ self.fp[node]).astype(np.int64)
            hit = d <= radius
            if hit.any():
                yield q[hit], node[hit]
            low = np.searchsorted(self.keys, node * 65 + np.maximum(d - radius, 0))
            n = np.searchsorted(self.keys, node * 65 + np.minimum(d + radius, 64), "right") - low
            if n.any():
                steps = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
                stack.append((np.repeat(q, n), self.children[np.repeat(low, n) + steps]))


def joined(label: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Labels (each the least index of its class) after uniting a[k] with b[k]."""
    a, b = label[a], label[b]
    apart = a != b
    a, b = a[apart], b[apart]
    while len(a):
        low, high = np.minimum(a, b), np.maximum(a, b)
        to = np.arange(len(label))
        np.minimum.at(to, high, low)
        while (to[to] != to).any():
            to = to[to]
        label = to[label]
        a, b = to[a], to[b]
        apart = a != b
        a, b = a[apart], b[apart]
    return label


def shard_edges(cell: np.ndarray, fp: np.ndarray, in_tree: np.ndarray, asks: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """(fp, root) for each fingerprint that is linked within its cell."""
    tree, query = np.flatnonzero(in_tree), np.flatnonzero(asks)
    bits = fp.view(np.uint64)
    forest = Forest(cell[tree], bits[tree])
    label = np.arange(len(fp))
    for q, node in forest.near(cell[query], bits[query], radius):
        label = joined(label, query[q], tree[node])
    linked = np.flatnonzero(label != np.arange(len(fp)))
    return fp[linked], fp[label[linked]]


def edges(nodes: DataFrame, n: int, radius: int = RADIUS, shard: int = SHARD, part: int = PART, deep: int = DEEP) -> DataFrame:
    """(a, b): edges that connect what links of distinct fingerprints connect, at
    most one for each fingerprint, family and part. ``nodes`` has fp, ``n`` rows."""
    masks = shard_masks(n, radius, shard)
    families = F.array(*[F.struct(F.lit(k).alias("family"), F.col("fp").bitwiseAND(F.lit(_signed(m))).alias("bits")) for k, m in enumerate(masks)])
    dealt = nodes.select("fp", F.inline(families))
    # Shards of one member have no links; the table of the others tells whether any is too large.
    sizes = written(dealt.groupBy("family", "bits").agg(F.count(F.lit(1)).alias("n")).where("n > 1"), "shards")
    sized = dealt.join(sizes, ["family", "bits"])
    if not sizes.where(F.col("n") > deep).isEmpty():
        finer = [deeper_masks(m, radius) for m in masks]
        again = F.array(*[F.array(*[F.struct(F.lit((k + 1) * 1000 + i).alias("family"), F.lit(_signed(m)).alias("mask")) for i, m in enumerate(ms)]) for k, ms in enumerate(finer)])
        large = sized.where(F.col("n") > deep).select("fp", F.inline(F.get(again, F.col("family")))).select("fp", "family", F.col("fp").bitwiseAND(F.col("mask")).alias("bits"))
        more = large.groupBy("family", "bits").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
        sized = sized.where(F.col("n") <= deep).select("fp", "family", "bits", "n").unionByName(large.join(more, ["family", "bits"]).select("fp", "family", "bits", "n"))
    parts = F.ceil(F.col("n") / part).cast("int")
    own = F.pmod(F.xxhash64("fp", F.lit(3)), parts).cast("int")
    others = F.transform(F.sequence(F.lit(0), F.col("parts") - 1), lambda k: F.struct(F.least(k, F.col("own")).alias("i"), F.greatest(k, F.col("own")).alias("j"), (F.col("own") <= k).alias("in_tree"), (F.col("own") >= k).alias("asks")))
    cells = sized.select("fp", "family", "bits", parts.alias("parts"), own.alias("own")).select("fp", "family", "bits", F.inline(others))
    cells = cells.select(F.xxhash64("family", "bits", "i", "j").alias("cell"), "fp", "in_tree", "asks").repartition("cell").sortWithinPartitions("cell")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: list[pd.DataFrame] = []
        size = 0

        def link(rows: pd.DataFrame) -> pd.DataFrame:
            a, b = shard_edges(rows["cell"].to_numpy(), rows["fp"].to_numpy(), rows["in_tree"].to_numpy(bool), rows["asks"].to_numpy(bool), radius)
            return pd.DataFrame({"a": a, "b": b})

        for batch in batches:
            held.append(batch)
            size += len(batch)
            if size >= TAKEN:
                rows = pd.concat(held, ignore_index=True)
                # The last cell may go on in the next batch.
                done = int(np.searchsorted(rows["cell"].to_numpy(), rows["cell"].iloc[-1]))
                held, size = [rows.iloc[done:]], len(rows) - done
                if done:
                    yield link(rows.iloc[:done].reset_index(drop=True))
        if held:
            yield link(pd.concat(held, ignore_index=True))

    return cells.mapInPandas(run, "a long, b long").distinct()


def components(found: DataFrame) -> DataFrame | None:
    """(fp, root) for each end of an edge, root the same throughout a component;
    None without edges.

    Each vertex hooks onto the neighbour of the least hash in its round, itself
    included, and edges are drawn anew between what was hooked onto; that leaves a
    fraction of the vertices, whatever the shape. A common centre is dealt with
    by partial aggregates and joins whose one side is unique.
    """
    found = written(found, "edges")
    labels: DataFrame | None = None
    turn = 0
    while not found.isEmpty():
        turn += 1
        rank = lambda c: F.struct(F.xxhash64(c, F.lit(turn)), c)  # noqa: B023, E731
        both = found.select("a", "b").union(found.select("b", "a"))
        hooks = both.groupBy(F.col("a").alias("v")).agg(F.min_by("b", rank(F.col("b"))).alias("m"))
        hooks = written(hooks.select("v", F.when(rank(F.col("m")) < rank(F.col("v")), F.col("m")).otherwise(F.col("v")).alias("to")), "hooks")
        old, done = labels, found
        if labels is None:
            labels = hooks.select(F.col("v").alias("fp"), F.col("to").alias("root"))
        else:
            labels = written(labels.join(hooks, F.col("root") == F.col("v"), "left").select("fp", F.coalesce("to", "root").alias("root")), "labels")
        moved = found.join(hooks, F.col("a") == F.col("v")).select(F.col("to").alias("a"), "b").join(hooks, F.col("b") == F.col("v")).select("a", F.col("to").alias("b")).where("a <> b")
        found = written(moved.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "edges")
        # What the next round doesn't read any more goes; the first labels are the first hooks.
        dropped(done, old, hooks if old is not None else None)
    return labels


def near_duplicates(docs: DataFrame, radius: int = RADIUS, id_col: str = "doc_id", text_col: str = "text", shard: int = SHARD, part: int = PART, deep: int = DEEP) -> DataFrame:
    """(doc_id, fp, component_id, root) for each row of ``docs``; component_id is the
    least id reachable over fingerprints within ``radius`` bits, its own included,
    root a fingerprint of the component that stands for it.

    Texts without words have fingerprint 0 and are linked like any other. A null
    id is never the least unless a component has no other; repeated rows stay. An
    empty table gives no rows.
    """
    fps = written(fingerprints(docs, id_col, text_col), "fingerprints")
    nodes = written(fps.groupBy("fp").agg(F.min("doc_id").alias("rep")), "nodes")
    labels = components(edges(nodes.select("fp"), nodes.count(), radius, shard, part, deep))
    if labels is None:
        least = nodes.select("fp", F.col("rep").alias("component_id"), F.col("fp").alias("root"))
    else:
        rooted = nodes.join(labels, "fp").select("fp", "root", "rep")
        class_of = rooted.groupBy("root").agg(F.min("rep").alias("least"))
        linked = rooted.join(class_of, "root").select("fp", "root", "least")
        least = nodes.join(linked, "fp", "left").select("fp", F.when(F.col("root").isNull(), F.col("rep")).otherwise(F.col("least")).alias("component_id"), F.coalesce("root", "fp").alias("root"))
    # Copies of one text are many rows of one key; the unique side lets Spark split them.
    return fps.join(least, "fp").select("doc_id", "fp", "component_id", "root")


def keep_one(docs: DataFrame, radius: int = RADIUS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs``, all columns: of each component the row of the least id.

    Of repeated rows of an id, and of rows of null ids where a component has no
    other, one stays, that of the least text. An empty table stays empty.
    """
    found = written(near_duplicates(docs, radius, id_col, text_col), "components")
    ids = found.agg(F.count(F.lit(1)).alias("n"), F.count("doc_id").alias("named"))
    repeated = found.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n")).where("n > 1").limit(1)
    counts = ids.first()
    if counts.n == counts.named and repeated.isEmpty():
        (other,) = fresh(docs, "other")
        others = found.where("doc_id <> component_id").select(F.col("doc_id").alias(other))
        return docs.join(others, F.col(quoted(id_col)).cast("long") == F.col(other), "left_anti")
    # Ids don't tell rows apart, so each row gets its fingerprint.
    fp, own, root, row = fresh(docs, "fp", "own", "root", "row")
    roots = found.groupBy(F.col("fp").alias(own)).agg(F.first("root").alias(root))
    body = docs if text_col == "text" else docs.withColumn("text", F.col(quoted(text_col)))
    marked = with_columns(body, [(fp, LongType())], lambda batch: [[fingerprint(t) for t in batch]]).join(roots, F.col(fp) == F.col(own))
    order = F.struct(F.col(quoted(id_col)).isNull(), F.col(quoted(id_col)), F.coalesce(F.col(quoted(text_col)), F.lit("")))
    return marked.groupBy(root).agg(F.min_by(F.struct(*columns(docs)), order).alias(row)).select(f"{row}.*")


def hex16(fp: Column) -> Column:
    return F.lpad(F.lower(F.hex(fp)), 16, "0")


def op3_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", hex16(F.col("fp")).alias("fingerprint"), "component_id")
