"""Language-model scores by context-tree weighting.

A text is its words, each closed by a space, and an end; bytes are predicted
bit by bit from the DEPTH bytes before them, which reach no farther than TAIL bytes over the
word's opening space. Each context of each depth, and each node of the
byte's binary tree there, keeps a Krichevsky-Trofimov estimate, and weighting mixes those of
all depths by how well they coded the corpus. Every context that the corpus has is in the
tree, which is computed in shards: all contexts that end in the same two bytes are a subtree of
one task. What the first bytes of a word cost follows from them and the tail before (the word's head), what
the others cost from the word alone, so both are looked up like counts.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.llm.bytegrams import find, mask, summed
from quire.llm.common import dropped, fold, kept_in_worker, parts, sent_to_workers, table, written

DEPTH, TAIL = 5, 2
#: Bytes of a word (its closing space is one) whose contexts reach its opening space.
HEAD_BYTES = DEPTH - 1
FOLDS, HELD = 7, 2
#: Words, and heads, with one in so many tokens are known to every task; the others
#: are joined. There are at most so many of each.
HEAD = 1 << 20
#: Distinct words that a task counts before it hands them on, and heads.
HELD_WORDS, HELD_HEADS = 250_000, 1_000_000
#: Distinct words and heads that are scored together.
CHUNK = 200_000
#: Byte strings whose subtrees are laid out at a time (a subtree of three bytes stays whole).
LAID_OUT = 50_000
#: Bytes of text that a task takes up at a time.
TAKEN = 2 << 20
#: No word holds a line end, so this is the end token's spelling.
END = b"\n"
LOG10 = math.log10
#: Shards are contexts that end in the same so many bytes.
SHARD = 2


def words_of(text: bytes) -> list[bytes]:
    return text.lower().split()


def heads_of(texts: list[list[bytes]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(head, text, bytes of each text): for each token of each text TAIL bytes of running text before its opening space (0 before
    the text), and its first HEAD_BYTES bytes (0 behind its end), as one integer, the oldest byte highest."""
    before = bytes(TAIL) + b" "
    codes = [before + b" ".join(w) + b" " + END if w else before + END for w in texts]
    line = np.frombuffer(b"".join(codes) + bytes(HEAD_BYTES), np.uint8)
    starts = np.flatnonzero(line == 32) + 1
    head = np.zeros(len(starts), np.uint64)
    for k in range(TAIL):
        head = (head << np.uint64(8)) | line[starts - 1 - TAIL + k].astype(np.uint64)
    live = np.ones(len(starts), bool)
    for k in range(HEAD_BYTES):
        byte = line[starts + k]
        head = (head << np.uint64(8)) | np.where(live, byte, 0).astype(np.uint64)
        live &= (byte != 32) & (byte != END[0])
    n = np.fromiter(map(len, texts), np.int64, len(texts)) + 1
    return head, np.repeat(np.arange(len(texts)), n), np.fromiter(map(len, codes), np.int64, len(codes)) - len(before)


def head_keys(head: np.ndarray) -> pa.Array:
    """Heads as keys beside words: a space and 8 bytes; no word begins with a space."""
    data = np.full((len(head), 9), 32, np.uint8)
    data[:, 1:] = head.astype(">u8").view(np.uint8).reshape(-1, 8)
    return pa.Array.from_buffers(pa.binary(), len(head), [None, pa.py_buffer((np.arange(len(head) + 1) * 9).astype(np.int32).tobytes()), pa.py_buffer(data.tobytes())])


def spelt(keys: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """(gram, key): the byte strings that spell what the keys stand for, heads or the bytes of words behind their
    heads, as integers with the symbol lowest and DEPTH older bytes above; and the number of their key."""
    gap = bytes(DEPTH)
    codes, starts = [], np.zeros(len(keys), np.int64)
    for k, key in enumerate(keys):
        if key[:1] == b" ":
            codes.append(gap + key[9 - TAIL - HEAD_BYTES : 9 - HEAD_BYTES] + b" " + key[9 - HEAD_BYTES :].rstrip(b"\0"))
            starts[k] = DEPTH + TAIL + 1
        else:
            codes.append(gap + b" " + key + (b"" if key == END else b" "))
            starts[k] = min(DEPTH + 1 + HEAD_BYTES, len(codes[-1]))
    ends = np.cumsum(np.fromiter(map(len, codes), np.int64, len(codes)))
    text = np.frombuffer(b"".join(codes), np.uint8)
    starts[1:] += ends[:-1]
    n = ends - starts
    owner = np.repeat(np.arange(len(keys)), n)
    at = np.arange(n.sum()) + np.repeat(starts - (np.cumsum(n) - n), n)
    gram = text[at].astype(np.uint64)
    for d in range(1, DEPTH + 1):
        gram |= text[at - d].astype(np.uint64) << np.uint64(8 * d)
    return gram, owner


def _stirling(x: np.ndarray) -> np.ndarray:
    """Log gamma by Stirling's series for x + 8, less the factors in between; x >= 0.5."""
    product = np.ones_like(x)
    for k in range(8):
        product *= x + k
    y = x + 8
    return (y - 0.5) * np.log(y) - y + 0.5 * np.log(2 * np.pi) + 1 / (12 * y) - 1 / (360 * y**3) - np.log(product)


#: Log gamma of k + 1/2 and k + 1 for small counts.
SMALL = np.arange(4096.0)
HALVES, WHOLES = _stirling(SMALL + 0.5), _stirling(SMALL + 1.0)


def _log_gamma(n: np.ndarray, small: np.ndarray, shift: float) -> np.ndarray:
    out = small[np.minimum(n, len(small) - 1).astype(np.int64)]
    large = n >= len(small)
    if large.any():
        out[large] = _stirling(n[large] + shift)
    return out


def _kt(zeros: np.ndarray, ones: np.ndarray) -> np.ndarray:
    """Log of the sequential KT estimate of all bits of a node; counts are whole numbers."""
    return _log_gamma(zeros, HALVES, 0.5) + _log_gamma(ones, HALVES, 0.5) - _log_gamma(zeros + ones, WHOLES, 1.0) - math.log(math.pi)


class Nodes:
    """Binary nodes of one depth: bits seen there, the estimate's weight against what the depths below
    say, and the log of the weighted probability of these bits."""

    def __init__(self, zeros: np.ndarray, ones: np.ndarray, split: np.ndarray | None):
        """split: the sum of the children's logs; None at the greatest depth."""
        self.zeros, self.ones = zeros, ones
        own = _kt(zeros, ones)
        self.one = (ones + 0.5) / (zeros + ones + 1.0)
        if split is None:
            self.weight, self.below = np.ones(len(own)), own
        else:
            self.weight = 1 / (1 + np.exp(np.clip(split - own, -700, 700)))
            self.below = np.logaddexp(own, split) + math.log(0.5)


class Level(Nodes):
    """Nodes of a depth up to SHARD, by sorted key (context, node from 0 at the root of the byte's tree to 254)."""

    def __init__(self, key: np.ndarray, zeros: np.ndarray, ones: np.ndarray, split: np.ndarray):
        super().__init__(zeros, ones, split)
        self.key = key


def parents(depth: int, key: np.ndarray, zeros: np.ndarray, ones: np.ndarray, below: np.ndarray) -> tuple[np.ndarray, ...]:
    """What a Level of ``depth`` is made of, from nodes one deeper."""
    own, at = np.unique(((key >> np.uint64(8)) & mask(depth)) << np.uint64(8) | (key & np.uint64(255)), return_inverse=True)
    return own, *(np.bincount(at, v, len(own)) for v in (zeros, ones, below))


class Subtree:
    """The depths from DEPTH up to SHARD + 1 over some distinct byte strings: all that share
    their context's newest SHARD + 1 bytes. Strings of n = 0 have nodes without counts, which
    change nothing and predict an even chance."""

    def __init__(self, gram: np.ndarray, n: np.ndarray):
        self.order = np.argsort(gram)
        keys, times = gram[self.order], n[self.order].astype(float)
        self.depths: list[tuple[np.ndarray | None, list[np.ndarray], list[Nodes]]] = []
        child: tuple[list[np.ndarray], list[Nodes]] | None = None
        for d in range(DEPTH, SHARD, -1):
            up = None
            if d < DEPTH:
                keys, up = np.unique(((keys >> np.uint64(8)) & mask(d)) << np.uint64(8) | (keys & np.uint64(255)), return_inverse=True)
                times = np.bincount(up, times, len(keys))
            places, nodes, firsts = [], [], []
            for level in range(8):
                # Keys are sorted, so a node's are neighbours: those equal but for the symbol's last bits.
                prefix = keys >> np.uint64(8 - level)
                first = np.flatnonzero(np.concatenate(([True], prefix[1:] != prefix[:-1])))
                place = np.zeros(len(keys), np.int64)
                place[first[1:]] = 1
                place = np.cumsum(place)
                total = np.add.reduceat(times, first)
                ones = np.add.reduceat(times * ((keys >> np.uint64(7 - level)) & np.uint64(1)).astype(float), first)
                split = None
                if child:
                    split = np.bincount(place[up[child[0][level]]], child[1][level].below, len(first))
                places.append(place)
                nodes.append(Nodes(total - ones, ones, split))
                firsts.append(first)
            child = firsts, nodes
            self.depths.append((up, places, nodes))
        #: (key, zeros, ones, below) of the nodes of depth SHARD + 1.
        key = [((keys[f] >> np.uint64(8)) << np.uint64(8)) | (np.uint64((1 << lv) - 1) + ((keys[f] & np.uint64(255)) >> np.uint64(8 - lv))) for lv, f in enumerate(firsts)]
        self.top = tuple(np.concatenate(x) for x in (key, [v.zeros for v in nodes], [v.ones for v in nodes], [v.below for v in nodes]))

    def predicted(self, gram: np.ndarray, upper: list[Level]) -> np.ndarray:
        """Log10 probability of each string's symbol in its context; upper: the
        levels from 0 to SHARD, which hold all nodes of these strings."""
        g = gram[self.order]
        out = np.zeros(len(g))
        for level in range(8):
            node = np.uint64((1 << level) - 1) + ((g & np.uint64(255)) >> np.uint64(8 - level))
            one, left = np.zeros(len(g)), np.ones(len(g))
            for d, v in enumerate(upper):
                at, there = find(v.key, (((g >> np.uint64(8)) & mask(d)) << np.uint64(8)) | node)
                one += left * np.where(there, v.weight[at] * v.one[at], 0.0)
                left *= np.where(there, 1 - v.weight[at], 1.0)
            # From the deepest on, where each string's ancestors are.
            ancestor, steps = np.arange(len(g)), []
            for up, places, nodes in self.depths:
                ancestor = ancestor if up is None else up[ancestor]
                at = places[level][ancestor]
                steps.append((nodes[level].weight[at], nodes[level].one[at]))
            for weight, estimate in reversed(steps):
                one += left * weight * estimate
                left *= 1 - weight
            bit = (g >> np.uint64(7 - level)) & np.uint64(1)
            out += np.log10(np.where(bit == 1, one, 1 - one))
        value = np.zeros(len(g))
        value[self.order] = out
        return value


def subtrees(gram: np.ndarray) -> list[slice]:
    """Slices of byte strings sorted as by ``in_shards``, of about LAID_OUT each, none with a part of the strings of
    one context of SHARD + 1 bytes."""
    newest = (gram >> np.uint64(8)) & mask(SHARD + 1)
    starts = np.concatenate((np.flatnonzero(np.concatenate(([True], newest[1:] != newest[:-1]))), [len(gram)]))
    out, at = [], 0
    while at < len(gram):
        end = int(starts[max(np.searchsorted(starts, at + LAID_OUT, "right") - 1, np.searchsorted(starts, at, "right"))])
        out.append(slice(at, end))
        at = end
    return out


def shards(gram: np.ndarray, n: np.ndarray) -> Level:
    """The level of SHARD over whole shards."""
    tops = [Subtree(gram[s], n[s]).top for s in subtrees(gram)]
    return Level(*parents(SHARD, *(np.concatenate(x) for x in zip(*tops, strict=True))))


def above(level: Level) -> list[Level]:
    """The levels from 0 on down to the given one of SHARD - 1."""
    levels = [level]
    for d in range(SHARD - 2, -1, -1):
        v = levels[0]
        levels.insert(0, Level(*parents(d, v.key, v.zeros, v.ones, v.below)))
    return levels


def in_shards(grams: DataFrame) -> DataFrame:
    """(gram, n) dealt by the newest SHARD bytes of the context, sorted by these, then the third."""
    newest = F.shiftright("gram", 8)
    shard, third = newest.bitwiseAND((1 << (8 * SHARD)) - 1), newest.bitwiseAND(0xFFFFFF)
    return grams.select("gram", "n").repartition(shard).sortWithinPartitions(shard, third, "gram")


def _whole_shards(batches: Iterator[pd.DataFrame], work: Callable[[np.ndarray, np.ndarray], pd.DataFrame]) -> Iterator[pd.DataFrame]:
    held: list[pd.DataFrame] = []
    size = 0
    for batch in batches:
        held.append(batch)
        size += len(batch)
        if size >= 4 * LAID_OUT:
            rows = pd.concat(held, ignore_index=True)
            shard = (rows["gram"].to_numpy().view(np.uint64) >> np.uint64(8)) & mask(SHARD)
            # The last shard may go on in the next batch.
            done = int(np.flatnonzero(shard != shard[-1]).max(initial=-1)) + 1
            held, size = [rows.iloc[done:]], len(rows) - done
            if done:
                yield work(rows["gram"].to_numpy().view(np.uint64)[:done], rows["n"].to_numpy()[:done])
    if size:
        rows = pd.concat(held, ignore_index=True)
        yield work(rows["gram"].to_numpy().view(np.uint64), rows["n"].to_numpy())


def code_lengths(grams: DataFrame) -> DataFrame:
    """(gram, value): log10 probability of each byte string's symbol in its context, by the
    tree of all. ``grams`` has (gram, n), distinct; those of n = 0 are only asked for."""

    def rise(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        def work(gram: np.ndarray, n: np.ndarray) -> pd.DataFrame:
            v = shards(gram, n)
            # Other shards have children of the same nodes, so these are sums yet.
            key, zeros, ones, split = parents(SHARD - 1, v.key, v.zeros, v.ones, v.below)
            return pd.DataFrame({"node": key.astype(np.int64), "zeros": zeros, "ones": ones, "split": split})

        return _whole_shards(batches, work)

    tops = in_shards(grams).mapInPandas(rise, "node long, zeros double, ones double, split double")
    # Contexts of SHARD - 1 bytes and the 255 nodes of each: 65,280 rows at most.
    rows = tops.groupBy("node").agg(F.sum("zeros").alias("zeros"), F.sum("ones").alias("ones"), F.sum("split").alias("split")).orderBy("node").toPandas()
    top = above(Level(rows["node"].to_numpy(np.uint64), *(rows[c].to_numpy(float) for c in ("zeros", "ones", "split"))))
    sent = sent_to_workers(grams.sparkSession, top)

    def fall(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        upper = kept_in_worker("ctw-top", sent, lambda v: v)

        def work(gram: np.ndarray, n: np.ndarray) -> pd.DataFrame:
            known = [*upper, shards(gram, n)]
            value = [Subtree(gram[s], n[s]).predicted(gram[s], known) for s in subtrees(gram)]
            return pd.DataFrame({"gram": gram.view(np.int64), "value": np.concatenate(value)})

        return _whole_shards(batches, work)

    return in_shards(grams).mapInPandas(fall, "gram long, value double")


def counts(rows: DataFrame) -> DataFrame:
    """(key binary, n long): how often the texts that teach have each word and each head of all texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words: Counter = Counter()
        found: list[tuple[np.ndarray, np.ndarray]] = []
        held = 0

        def hand_on(all_: bool) -> Iterator[pa.RecordBatch]:
            nonlocal words, found, held
            if words and (all_ or len(words) >= HELD_WORDS):
                yield pa.record_batch([pa.array(list(words), pa.binary()), pa.array(list(words.values()), pa.int64())], names=["key", "n"])
                words = Counter()
            if held and (all_ or held >= HELD_HEADS):
                heads, n = summed(np.concatenate([h for h, _ in found]), np.concatenate([c for _, c in found]))
                found, held = [(heads, n)], len(heads)
                if all_ or held >= HELD_HEADS // 2:
                    found, held = [], 0
                    yield pa.record_batch([head_keys(heads), pa.array(n)], names=["key", "n"])

        for part in taken(batches):
            split = [words_of(t) for t in part.column("text").to_pylist()]
            learns = part.column("learns").to_numpy()
            for w, teaches in zip(split, learns.tolist(), strict=True):
                if teaches:
                    words.update(w)
                    words[END] += 1
                else:
                    for k in (*w, END):
                        if k not in words:
                            words[k] = 0
            head, owner, _ = heads_of(split)
            found.append(summed(head, learns[owner].astype(np.int64)))
            held += len(found[-1][0])
            yield from hand_on(False)
        yield from hand_on(True)

    return rows.select("text", "learns").mapInArrow(run, "key binary, n long").groupBy("key").agg(F.sum("n").alias("n"))


def taken(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """Batches, cut and joined to about TAKEN bytes of text."""
    held: list[pa.RecordBatch] = []
    size = 0
    for batch in batches:
        for b in parts(batch, batch.schema.get_field_index("text"), 1 << 30, TAKEN):
            held.append(b)
            size += b.nbytes
            if size >= TAKEN:
                yield pa.Table.from_batches(held)
                held, size = [], 0
    if held:
        yield pa.Table.from_batches(held)


def lexicon(keys: DataFrame, kinds: int, chunk: int = CHUNK) -> DataFrame:
    """(key, n, value) of a table (key, n) of ``kinds`` rows: value is the log10 probability of the head, or
    of the word's bytes behind its head.

    Keys are dealt into chunks of about ``chunk``; each asks once for each of its byte strings."""
    chunks = max(1, -(-kinds // chunk))
    dealt = keys.withColumn("chunk", F.pmod(F.xxhash64("key"), F.lit(chunks)).cast("int"))

    def ask(rows: pd.DataFrame) -> pd.DataFrame:
        gram, owner = spelt(rows["key"].tolist())
        found, n = summed(gram, rows["n"].to_numpy()[owner])
        return pd.DataFrame({"chunk": rows["chunk"].iloc[0], "gram": found.view(np.int64), "n": n})

    asked = written(dealt.groupBy("chunk").applyInPandas(ask, "chunk int, gram long, n long"), "asked")
    grams = written(asked.groupBy("gram").agg(F.sum("n").alias("n")), "grams")
    values = written(code_lengths(grams), "values")

    def answer(rows: pd.DataFrame, known: pd.DataFrame) -> pd.DataFrame:
        own = known["gram"].to_numpy().view(np.uint64)
        order = np.argsort(own)
        gram, owner = spelt(rows["key"].tolist())
        value = known["value"].to_numpy()[order][np.searchsorted(own[order], gram)] if len(gram) else np.zeros(0)
        return pd.DataFrame({"key": rows["key"], "n": rows["n"], "value": np.bincount(owner, value, len(rows))})

    told = asked.select("chunk", "gram").join(values, "gram")
    found = written(dealt.groupBy("chunk").cogroup(told.groupBy("chunk")).applyInPandas(answer, "key binary, n long, value double"), "lexicon")
    dropped(asked, grams, values)
    return found


def scored(rows: DataFrame, head: int = HEAD) -> DataFrame:
    """As score(), for rows (doc_id, text binary, learns, asks): those that teach the
    model, and those that are to be scored."""
    spark = rows.sparkSession
    keys = written(counts(rows), "counts")
    known = lexicon(keys, keys.count())
    dropped(keys)
    is_head = F.substring("key", 1, 1) == F.lit(b" ")
    size = known.where(~is_head).agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.count(F.when(F.col("n") > 0, 1)).alias("v")).first()
    tokens, kinds = int(size.n), int(size.v)
    # Each holds a share of 1 / head of all tokens or more, so there are no more than head of either sort.
    often = F.col("n") >= F.lit(max(1.0, tokens / head))
    common = known.where(often).toPandas()
    first = common["key"].map(lambda k: k[:1] == b" ").to_numpy(bool)
    words, heads = common[~first], common[first]
    named = np.array([int.from_bytes(k[1:], "big") for k in heads["key"]], np.uint64)
    order = np.argsort(named)
    sent = sent_to_workers(
        spark,
        (
            dict(zip(map(bytes, words["key"]), range(len(words)), strict=True)),
            np.append(np.log10(words["n"].to_numpy(float) + 1), 0.0),
            np.append(words["value"].to_numpy(float), 0.0),
            named[order],
            heads["value"].to_numpy(float)[order],
        ),
    )
    floor = float(np.log10(tokens + kinds + 1.0))
    schema = "row long, key binary, times long, doc_id long, n_bytes long, n_known long, base double, score double"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place, logs, values, common_heads, head_values = kept_in_worker("ctw", sent, lambda v: v)
        get = place.get
        for part in taken(batches):
            split = [words_of(t) for t in part.column("text").to_pylist()]
            n = len(split)
            head, owner, n_bytes = heads_of(split)
            kinds, of = np.unique(head, return_inverse=True)
            at, there = find(common_heads, kinds)
            value = np.where(there, head_values[at], 0.0) if len(head_values) else np.zeros(len(kinds))
            missed = ~there[of]
            pairs, times_of = np.unique(owner[missed] * len(kinds) + of[missed], return_counts=True)
            tokens_of = np.bincount(owner, minlength=n)
            words = [x for w in split for x in (*w, END)]
            found = np.array([get(x, -1) for x in words], np.int64)
            old = found >= 0
            # Place -1 is the last, 0.
            base, n_known = np.bincount(owner, logs[found], n), np.bincount(owner, old, n).astype(np.int64)
            score = np.bincount(owner, value[of] + values[found], n)
            lone = np.flatnonzero(~old)
            rare = [words[k] for k in lone.tolist()]
            row = part.column("row").to_numpy()
            # What belongs to a text stands in a row of its own, with its tokens as times; its key is in no table,
            # and in no other row.
            apart = [b"  %d" % r for r in row.tolist()]
            texts, n_lone = np.arange(n), len(rare) + len(pairs)
            at = np.concatenate((texts, owner[lone], pairs // max(1, len(kinds))))
            own = [part.column("doc_id").combine_chunks(), *map(pa.array, (n_bytes, n_known, base, score))]
            own = [pa.concat_arrays([v, pa.nulls(n_lone, v.type)]) for v in own]
            keys = pa.concat_arrays([pa.array(apart + rare, pa.binary()), head_keys(kinds[pairs % max(1, len(kinds))])])
            yield pa.record_batch([pa.array(row[at]), keys, pa.array(np.concatenate((tokens_of, np.ones(len(rare), np.int64), times_of))), *own], names=[f.split()[0] for f in schema.split(", ")])

    asked = rows.where("asks").select(F.monotonically_increasing_id().alias("row"), "doc_id", "text").mapInArrow(run, schema)
    # Of the keys that aren't common no one is in more than a small share of all rows. Hashes come first, as
    # many keys are alike in the bytes that sorting looks at first.
    rest = known.where(~often).select(F.col("key").alias("own"), F.when(~is_head, F.col("n")).alias("c"), "value")
    both = asked.join(rest, (F.xxhash64("key") == F.xxhash64("own")) & (F.col("key") == F.col("own")), "left")
    more = lambda joined: F.coalesce(F.sum(joined), F.lit(0))
    each = both.groupBy("row").agg(
        F.max("doc_id").alias("doc_id"),
        F.max(F.when(F.col("n_bytes").isNotNull(), F.col("times"))).alias("n_tokens"),
        F.max("n_bytes").alias("n_bytes"),
        (F.max("n_known") + more(F.when(F.col("c") > 0, F.col("times")))).alias("n_known"),
        (F.max("base") + more(F.col("times") * F.log10(F.col("c") + 1))).alias("base"),
        (F.max("score") + more(F.col("times") * F.col("value"))).alias("score"),
    )
    return each.select(
        "doc_id",
        "n_tokens",
        "n_known",
        F.lit(tokens).cast("long").alias("train_tokens"),
        (F.col("base") - F.col("n_tokens") * F.lit(floor)).alias("base_score"),
        "score",
        (-F.col("score") * F.lit(math.log2(10)) / F.col("n_bytes")).alias("bits_per_byte"),
    )


def _rows(docs: DataFrame, id_col: str, text_col: str, learns, asks) -> DataFrame:
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).cast("binary").alias("text"), learns.alias("learns"), asks.alias("asks"))


def score(docs: DataFrame, learn: DataFrame, id_col: str = "doc_id", text_col: str = "text", head: int = HEAD) -> DataFrame:
    """(doc_id, n_tokens, n_known, train_tokens, base_score, score, bits_per_byte) for
    each row of ``docs``, by a model of the texts of ``learn``.

    Null and empty texts are the end token alone. Repeated rows, and rows of null ids, are scored one by
    one, and teach one by one. An empty table gives no rows; with nothing to
    learn from, bytes are even and no token is known. base_score sums
    log10((c + 1) / (N + V + 1)) over tokens; bits_per_byte is the code length by the tree.
    """
    teach = _rows(learn, id_col, text_col, F.lit(True), F.lit(False))
    return scored(teach.unionByName(_rows(docs, id_col, text_col, F.lit(False), F.lit(True))), head)


def op5_context_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    held = fold(F.col("doc_id"), FOLDS) == HELD
    found = scored(_rows(table(spark, sf_dir, "documents"), "doc_id", "text", ~held, F.lit(True)))
    return found.select("doc_id", held.alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score", "bits_per_byte")
