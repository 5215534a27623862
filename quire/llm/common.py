"""Helpers shared by the training-data operators."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
from collections import Counter
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import BinaryType, DataType, LongType, StructField, StructType


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


_LOCAL: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir`` of
    the session. Where that is unset, a temporary one if driver and executors
    are one process (tests); on a cluster an error."""
    context = spark.sparkContext
    found = context.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not context.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        app = context.applicationId
        if app not in _LOCAL:
            _LOCAL[app] = tempfile.mkdtemp(prefix="quire-shared-")
            atexit.register(shutil.rmtree, _LOCAL[app], ignore_errors=True)
        found = _LOCAL[app]
    return found.rstrip("/")


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` as a Parquet table in the shared folder, read back. Cuts lineage,
    and a lost executor costs a re-read, not a recomputation."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/quire-{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def dropped(*tables: DataFrame | None) -> None:
    """Deletes tables that ``written`` gave, once nothing reads them any more."""
    for t in tables:
        if t is not None:
            spark = t.sparkSession
            for folder in {f.rsplit("/", 1)[0] for f in t.inputFiles()}:
                path = spark._jvm.org.apache.hadoop.fs.Path(folder)
                path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def columns(df: DataFrame, *without: str) -> list[Column]:
    """The columns of ``df`` but those of the given names (in any letter case), whatever characters are in theirs."""
    gone = {w.lower() for w in without}
    return [F.col(quoted(c)) for c in df.columns if c.lower() not in gone]


def quoted(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"


def fresh(df: DataFrame, *names: str) -> list[str]:
    """Names like the given ones that no column of ``df`` has, in any letter case."""
    taken = {c.lower() for c in df.columns}
    out = []
    for n in names:
        new, k = f"quire_{n}", 0
        while new.lower() in taken:
            new, k = f"quire_{n}_{k}", k + 1
        taken.add(new.lower())
        out.append(new)
    return out


def fold(id_col: Column, parts: int) -> Column:
    """crc32 of the id's decimal text, modulo ``parts``; a null id counts as ''."""
    return F.crc32(F.coalesce(id_col.cast("string"), F.lit("")).cast("binary")) % parts


def texts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, text) only, null text as ''; other columns can't clash."""
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))


#: Texts are taken up in Python in parts of at most so many rows and bytes (Spark
#: hands them over in batches that are bounded by its own settings).
BATCH_ROWS, BATCH_BYTES = 256, 8 << 20


def parts(batch: pa.RecordBatch, text: int, rows: int = BATCH_ROWS, size: int = BATCH_BYTES) -> Iterator[pa.RecordBatch]:
    """Slices of a batch with at most ``rows`` rows and, unless one row has more, ``size``
    bytes in its column number ``text``."""
    ends = np.cumsum(pc.fill_null(pc.binary_length(batch.column(text)), 0).to_numpy(zero_copy_only=False).astype(np.int64))
    at = 0
    while at < len(ends):
        before = ends[at - 1] if at else 0
        n = max(1, min(rows, int(np.searchsorted(ends, before + size, "right")) - at))
        yield batch.slice(at, n)
        at += n


def sampled(rows: DataFrame, group: str, key: str, most: int, seed: int = 5) -> DataFrame:
    """At most ``most`` rows of each value of ``group`` (of few values), those of
    the least hash of ``key``; columns stay, null groups go.

    A first cut by a hash threshold from the group's count leaves little more
    than wanted, so the exact cut ranks few rows however large the group.
    """
    g, total, hashed, place = fresh(rows, "group", "total", "hash", "place")
    n = rows.where(F.col(group).isNotNull()).groupBy(F.col(group).alias(g)).agg(F.count(F.lit(1)).alias(total))
    u = F.pmod(F.xxhash64(F.col(key), F.lit(seed)), F.lit(1 << 40)).alias(hashed)
    kept = rows.select("*", u).join(F.broadcast(n), F.col(group) == F.col(g))
    # Twice the wanted share, and 64 rows, so that next to never fewer pass than there should be.
    kept = kept.where(F.col(hashed) < F.lit(float(1 << 40)) * (2.0 * most + 64) / F.col(total))
    order = Window.partitionBy(group).orderBy(hashed, key)
    return kept.withColumn(place, F.row_number().over(order)).where(F.col(place) <= most).select(*columns(rows))


def with_columns(docs: DataFrame, fields: list[tuple[str, DataType]], compute) -> DataFrame:
    """``docs`` with columns of the given names and types, made by ``compute`` from
    texts (null: ''), a part of a batch at a time, as a list of value lists. Input columns of these names
    are replaced; the others pass through Python untouched, nulls and large numbers too."""
    names = [n for n, _ in fields]
    kept = docs.select(*columns(docs, *names))
    out = StructType([*kept.schema.fields, *[StructField(n, t) for n, t in fields]])
    kinds = [to_arrow_type(f.dataType) for f in out.fields[len(kept.columns) :]]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for b in parts(batch, batch.num_columns - 1):
                made = compute(b.column(b.num_columns - 1).to_pylist())
                arrays = [*b.columns[:-1], *(pa.array(v, k) for v, k in zip(made, kinds, strict=True))]
                yield pa.RecordBatch.from_arrays(arrays, names=out.names)

    # By number, as mapInArrow can't take names with a dot; the schema names them again.
    numbered = [c.alias(f"c{k}") for k, c in enumerate(columns(docs, *names))]
    return docs.select(*numbered, F.coalesce(F.col("text"), F.lit("")).alias("body")).mapInArrow(run, out)


#: Distinct words that a task counts before it hands them on.
HELD = 250_000


def counted(rows: DataFrame, group: str, words_of: Callable[[str], list[bytes]]) -> DataFrame:
    """(group, word binary, n long): how often the texts of each group of ``rows`` have each word."""
    kind = rows.schema[group].dataType
    schema = StructType([StructField(group, kind), StructField("word", BinaryType()), StructField("n", LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict = {}

        def hand_on() -> Iterator[pa.RecordBatch]:
            for g, words in held.items():
                if words:
                    yield pa.record_batch([pa.array([g] * len(words), to_arrow_type(kind)), pa.array(list(words), pa.binary()), pa.array(list(words.values()), pa.int64())], names=schema.names)
            held.clear()

        for batch in batches:
            for b in parts(batch, 1):
                for g, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                    held.setdefault(g, Counter()).update(words_of(text))
                if sum(map(len, held.values())) >= HELD:
                    yield from hand_on()
        yield from hand_on()

    return rows.select(group, F.coalesce("text", F.lit("")).alias("text")).mapInArrow(run, schema).groupBy(group, "word").agg(F.sum("n").alias("n"))


class WordCache:
    """Rows of numbers for words: evaluated once, kept while there is room."""

    def __init__(self, evaluate, width: int, limit: int = 200_000):
        self.evaluate, self.width, self.limit = evaluate, width, limit
        self.place: dict = {}
        self.rows = np.zeros((0, width))
        self.used = 0

    def learn(self, words) -> None:
        """Makes sure that all of ``words``, a set, have rows."""
        new = [w for w in words if w not in self.place]
        if self.used + len(new) > self.limit:
            self.place, self.used, new = {}, 0, list(words)
        if not new:
            return
        if self.used + len(new) > len(self.rows):
            grown = np.zeros((max(self.used + len(new), min(2 * len(self.rows), self.limit)), self.width))
            grown[: self.used] = self.rows[: self.used]
            self.rows = grown
        self.rows[self.used : self.used + len(new)] = np.asarray(self.evaluate(new), float).reshape(len(new), self.width)
        self.place.update(zip(new, range(self.used, self.used + len(new)), strict=True))
        self.used += len(new)

    def sums(self, counts: list[Counter]) -> tuple[np.ndarray, np.ndarray]:
        """For each counter of words: the sum of its words' rows, and of its counts."""
        out, total = np.zeros((len(counts), self.width)), np.zeros(len(counts))
        start = 0
        while start < len(counts):
            # As many texts together as have room for their words; one at least.
            words: set = set()
            end = start
            while end < len(counts) and (end == start or len(words) + len(counts[end]) <= self.limit):
                words.update(counts[end])
                end += 1
            self.learn(words)
            get = self.place.__getitem__
            for k in range(start, end):
                c = counts[k]
                if c:
                    n = np.fromiter(c.values(), float, len(c))
                    out[k] = n @ self.rows[np.fromiter(map(get, c), np.int64, len(c))]
                    total[k] = n.sum()
            start = end
        return out, total


_KEPT: dict = {}


def kept_in_worker(name: str, model, make):
    """make(model's value), once per Python worker instead of once per task.
    ``model`` is a (key, broadcast) pair, the key unlike that of any other model."""
    key, sent = model
    found = _KEPT.get(name)
    if not found or found[0] != key:
        found = _KEPT[name] = (key, make(sent.value))
    return found[1]


def sent_to_workers(spark: SparkSession, value):
    """A (key, broadcast) pair for kept_in_worker."""
    return uuid.uuid4().hex, spark.sparkContext.broadcast(value)
