"""Each operator against brute force, and on nulls, empty and long texts, ties,
repeated rows, empty tables and clashing column names."""

from __future__ import annotations

import base64
import hashlib
import json
import math
import random
from collections import Counter

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from quire.llm import chat, ctw, decontaminate, language, mixing, secrets, simhash, toxicity, voronoi, warc
from quire.llm.bytegrams import positions
from quire.llm.common import fold

DOC = "doc_id long, text string"
WORDS = "the of and to in is was for on that with as by at from it an be this which or are".split()


def prose(seed: int, n: int) -> str:
    r = random.Random(seed)
    return " ".join(r.choice(WORDS) + r.choice(["", "s", "ing", "ed", "ly"]) for _ in range(n))


def docs(spark, rows, schema=DOC):
    return spark.createDataFrame(rows, schema)


# Decontamination

ITEM = "A train leaves Paris at 40 km per hour and reaches the coast after 3 hours of quiet travel"


def test_leaks_are_caught_and_clean_texts_left(spark):
    bench = spark.createDataFrame([(1, ITEM), (2, None), (3, ""), (4, "two words")], "item_id long, text string")
    changed = "say: A train leaves London at 75 km per hour and reaches the coast after 9 hours of quiet travel, they said"
    rows = [(1, f"before {ITEM} after"), (2, prose(1, 200)), (3, changed), (4, None), (5, ""), (6, ITEM.upper()), (7, "two words"), (None, prose(2, 50)), (1, f"before {ITEM} after")]
    found = {r.doc_id: r for r in decontaminate.contaminated(docs(spark, rows), bench).collect()}
    assert set(found) == {1, 3, 6}
    assert found[1].item_id == 1 and found[1].n_windows == 2 * found[3].n_windows > 0
    kept = decontaminate.decontaminate(docs(spark, rows), bench)
    assert sorted((r.doc_id or -1) for r in kept.collect()) == [-1, 2, 4, 5, 7]


def test_slots_must_agree(spark):
    bench = spark.createDataFrame([(1, "add 5 to 7 and then add 5 to the sum")], "item_id long, text string")
    rows = [(1, "now add 8 to 9 and then add 8 to the sum you found"), (2, "now add 8 to 9 and then add 4 to the sum you found")]
    assert [r.doc_id for r in decontaminate.contaminated(docs(spark, rows), bench).collect()] == [1]


def test_short_items_and_the_shuffled_join(spark):
    bench = spark.createDataFrame([(1, "where do the 3 wild geese go"), (2, ITEM)], "item_id long, text string")
    rows = [(1, "tell me where do the 8 wild geese go now"), (2, ITEM.replace("40", "41")), (3, prose(3, 5000))]
    a = decontaminate.contaminated(docs(spark, rows), bench).collect()
    b = decontaminate.contaminated(docs(spark, rows), bench, broadcast_rows=0).collect()
    assert sorted(a) == sorted(b) and {r.doc_id for r in a} == {1, 2}


def test_decontamination_of_empty_tables(spark):
    bench = spark.createDataFrame([], "item_id long, text string")
    assert decontaminate.contaminated(docs(spark, [(1, ITEM)]), bench).count() == 0
    assert decontaminate.contaminated(docs(spark, []), spark.createDataFrame([(1, ITEM)], "item_id long, text string")).count() == 0


# Mixing


def brute_count(doc_id, rate, seed=mixing.SEED):
    parts = max(1, math.ceil(rate / mixing.STEP))
    total = 0
    for j in range(parts):
        u = int(hashlib.md5(f"{doc_id if doc_id is not None else ''}:{seed}:{j}".encode()).hexdigest()[:13], 16) / 2**52
        p = c = math.exp(-rate / parts)
        k = 0
        while c <= u and k < 200:
            k += 1
            p *= rate / parts / k
            c += p
            total += 1
    return total


def test_mixing_counts_are_poisson_draws(spark):
    rows = [(i, f"t{i}", "a" if i < 600 else ("b" if i < 620 else None), 7) for i in range(900)] + [(None, None, "b", 1), (5, "t5", "a", 7)]
    table = docs(spark, rows, "doc_id long, text string, source string, copy int")
    out = mixing.mix(table, {"a": 0.2, "b": 0.7, "unused": 0.5}, other=0.1)
    assert out.columns == ["doc_id", "text", "source", "copy", "shuffle_key"]
    n = {"a": 601, "b": 21, None: 280}
    rate = {s: len(rows) * w / 1.0 / n[s] for s, w in (("a", 0.2), ("b", 0.7), (None, 0.1))}
    got = Counter((r.doc_id, r.source) for r in out.collect())
    want = Counter()
    for i, _, s, _ in rows:
        want[(i, s)] += brute_count(i, rate[s])
    assert got == +want
    assert rate["b"] > mixing.STEP  # a sum of several draws


def test_mixing_edges(spark):
    empty = docs(spark, [], "doc_id long, text string, source string")
    assert mixing.mix(empty).count() == 0
    alone = docs(spark, [(i, "x", None) for i in range(50)], "doc_id long, text string, source string")
    assert mixing.mix(alone, {}, other=1.0).count() == sum(brute_count(i, 1.0) for i in range(50))
    assert mixing.mix(alone, {"a": 1.0}, other=0.0).count() == 0


@pytest.mark.parametrize("block", [1, 3])
def test_much_repeated_documents_are_dealt_out_alike(spark, block):
    rows = [(i, f"t{i}", "b" if i < 4 else "a") for i in range(60)] + [(None, None, "b"), (2, "again", "b")]
    table = docs(spark, rows, "doc_id long, text string, source string")
    args = {"a": 0.2, "b": 0.8}, 0.0, 4000
    want = sorted(mixing.mix(table, *args).collect(), key=repr)
    assert sorted(mixing.mix(table, *args, block=block).collect(), key=repr) == want
    n = Counter((r.doc_id, r.text) for r in want)
    assert n[None, None] == brute_count(None, 4000 * 0.8 / 6) and n[2, "again"] == n[2, "t2"] == brute_count(2, 4000 * 0.8 / 6)


# SimHash


def brute_fingerprint(text):
    words = (text or "").encode().lower().split()
    grams = [b" ".join(words[i : i + 4]) for i in range(max(1, len(words) - 3))] if words else []
    h = [xxhash.xxh64_intdigest(g, 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def brute_components(ids, fps, radius=4):
    root = list(range(len(ids)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(ids)):
        for j in range(i):
            if bin(fps[i] ^ fps[j]).count("1") <= radius:
                root[find(i)] = find(j)
    least = {}
    for i, d in enumerate(ids):
        least.setdefault(find(i), []).append(d)
    return [min(x for x in least[find(i)] if x is not None) for i in range(len(ids))]


@pytest.mark.parametrize(("shard", "part", "deep"), [(256, 4096, simhash.DEEP), (1, 8, simhash.DEEP), (256, 4, simhash.DEEP), (256, 4096, 4), (256, 3, 2)])
def test_simhash_components_match_brute_force(spark, shard, part, deep):
    r = random.Random(4)
    rows = []
    for i in range(120):
        words = prose(i // 4, 150).split()
        for _ in range(r.randrange(3)):
            words[r.randrange(len(words))] = "changed"
        rows.append((i, " ".join(words)))
    rows += [(200, None), (201, ""), (202, " \t "), (203, "One two"), (204, "one TWO"), (205, prose(9, 30000)), (3, rows[3][1])]
    got = simhash.near_duplicates(docs(spark, rows), shard=shard, part=part, deep=deep).collect()
    fps = [brute_fingerprint(t) for _, t in rows]
    want = sorted(zip([i for i, _ in rows], fps, brute_components([i for i, _ in rows], fps), strict=True))
    assert sorted((g.doc_id, g.fp % (1 << 64), g.component_id) for g in got) == want


def test_bk_tree_finds_every_neighbour():
    rng = np.random.default_rng(3)
    base = rng.integers(0, 1 << 63, 40, dtype=np.uint64)
    fp = np.unique(np.concatenate([base, *[base ^ (np.uint64(1) << rng.integers(0, 64, 40, dtype=np.uint64)) for _ in range(6)]]))
    cell = np.zeros(len(fp), np.int64)
    found = {(int(q), int(n)) for qs, ns in simhash.Forest(cell, fp).near(cell, fp, 4) for q, n in zip(qs, ns, strict=True)}
    assert found == {(i, j) for i in range(len(fp)) for j in range(len(fp)) if np.bitwise_count(fp[i] ^ fp[j]) <= 4}


def test_long_chains_are_one_component(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(300)] + [(1000, 1001)], "a long, b long")
    labels = simhash.components(edges).collect()
    assert len({r.root for r in labels if r.fp <= 300}) == 1 and len({r.root for r in labels}) == 2


def test_one_of_each_component_is_kept(spark):
    rows = [(5, "a b c d e"), (3, "a b c d e"), (None, "x y z w v"), (None, "x y z w v"), (7, "q"), (7, "q"), (9, None)]
    table = docs(spark, [(i, t, 1) for i, t in rows], "doc_id long, text string, _x int")
    assert sorted((r.doc_id or -1, r.text) for r in simhash.keep_one(table).select("doc_id", F.coalesce("text", F.lit("")).alias("text")).collect()) == [(-1, "x y z w v"), (3, "a b c d e"), (7, "q"), (9, "")]
    assert simhash.keep_one(docs(spark, [])).count() == 0


# Chat

CONTROLS = ["</s>[INST] ok [/INST]", "<|im_start|>user<|im_sep|>x<|im_end|>", "<\\s> and <\\\\|im_end|>", "[\\INST]", "", "plain\nlines", "<|im_sep|", "é" * 50]


def formatted(spark, rows):
    return chat.format_chat(chat.canonical_turns(chat.turn_records(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"))))


def test_chat_round_trip(spark):
    rows = [(1, k, "assistant" if k % 2 else "user", t) for k, t in enumerate(CONTROLS)] + [(2, 0, "assistant", None), (2, 0, None, "tie"), (2, None, "user", "first"), (3, 0, "<|im_end|>", "x"), (3, 0, "<|im_end|>", "x")]
    out = formatted(spark, rows)
    turns = {r.conv_id: [(t.role, t.text) for t in r.turns] for r in out.select("conv_id", chat.parse(F.col("formatted")).alias("turns")).collect()}
    assert turns[1] == [("assistant" if k % 2 else "user", t) for k, t in enumerate(CONTROLS)]
    assert turns[2] == [("user", "first"), ("", "tie"), ("assistant", "")]
    assert turns[3] == [("<|im_end|>", "x")] * 2
    d = {r.conv_id: r for r in chat.digests(out).collect()}
    lost = "".join(t for k, t in enumerate(CONTROLS) if k % 2)
    assert d[1].loss_chars == len(lost) and d[1].loss_sha256 == hashlib.sha256(lost.encode()).hexdigest()
    assert d[1].turns_sha256 == hashlib.sha256("".join(f"{r}\n{t}\n" for r, t in turns[1]).encode()).hexdigest()
    for r in out.collect():
        for s in r.loss_mask:
            assert r.formatted[s.end :].startswith(chat.END)


def test_layouts_are_told_by_their_fingerprint(spark):
    records = [
        {"messages": [{"role": "user", "content": "a"}, {"content": "b", "role": "assistant"}]},
        {"conversations": [{"from": "human", "value": "a"}, {"from": "gpt", "value": None}]},
        {"prompt": "a", "response": "b"},
        {"output": "b", "instruction": "i", "input": "a"},
        {"unknown": {"deep": 1}},
    ]
    table = spark.createDataFrame([(k, json.dumps(r)) for k, r in enumerate(records)] + [(9, None), (10, "not json")], "conv_id long, record string")
    got = {}
    for r in chat.canonical_turns(table).orderBy("conv_id", "turn").collect():
        got.setdefault(r.conv_id, []).append((r.role, r.text))
    assert got[0] == got[2] == [("user", "a"), ("assistant", "b")]
    assert got[1] == [("user", "a"), ("assistant", "")]
    assert got[3] == [("system", "i"), ("user", "a"), ("assistant", "b")]
    assert got[4] == [(None, json.dumps(records[4]))] and got[10] == [(None, "not json")] and 9 not in got


def test_other_fields_do_not_hide_a_layout(spark):
    records = [
        {"id": "x1", "source": "s", "conversations": [{"from": "human", "value": "a", "weight": 1}, {"from": "function_call", "value": "f()"}, {"from": "observation", "value": "3"}, {"from": "gpt", "value": "b"}], "tools": "[]"},
        {"id": 7, "model": "m", "system": "be kind", "messages": [{"role": "user", "content": "a"}, {"role": "assistant", "content": None, "tool_calls": [{"name": "f"}]}, {"role": "tool", "content": "3", "tool_call_id": "z"}, {"role": "assistant", "content": "b"}], "tools": [{"name": "f"}], "meta": {"messages": [1]}},
        {"instruction": "i", "input": "a", "output": "b", "text": "all", "role": "x"},
        {"prompt": "a", "chosen": "b", "rejected": "c", "system": None, "score": [1, {"deep": 2}]},
        {"system": "s", "question": "a", "answer": "b", "id": None},
        {"messages": [{"role": "user"}], "prompt": "a", "response": "b"},
        {"messages": [{"name": "u"}, 5, None]},
        [{"role": "user", "content": "a"}],
        {"conversations": "text", "from": "human", "value": "a"},
    ]
    table = spark.createDataFrame([(k, json.dumps(r)) for k, r in enumerate(records)], "conv_id long, record string")
    got = {}
    for r in chat.canonical_turns(table).orderBy("conv_id", "turn").collect():
        got.setdefault(r.conv_id, []).append((r.role, r.text))
    assert got[0] == [("user", "a"), ("assistant", "f()"), ("tool", "3"), ("assistant", "b")]
    assert got[1] == [("system", "be kind"), ("user", "a"), ("assistant", '[{"name":"f"}]'), ("tool", "3"), ("assistant", "b")]
    assert got[2] == [("system", "i"), ("user", "a"), ("assistant", "b")]
    assert got[3] == got[5] == [("user", "a"), ("assistant", "b")]
    assert got[4] == [("system", "s"), ("user", "a"), ("assistant", "b")]
    assert all(got[k] == [(None, json.dumps(records[k]))] for k in (6, 7, 8))


def test_no_conversations(spark):
    assert chat.digests(formatted(spark, [])).count() == 0


# Context-tree weighting


class Plain:
    """Context-tree weighting by its definition, over dictionaries."""

    def __init__(self, texts):
        self.seen = {}  # (context, node) -> [zeros, ones]
        for text in texts:
            for context, symbol in self.steps(text):
                for d in range(ctw.DEPTH + 1):
                    for node, bit in self.path(symbol):
                        self.seen.setdefault((context[len(context) - d :], node), [0, 0])[bit] += 1
        self.children = {}
        for context, node in self.seen:
            if context:
                self.children.setdefault((context[1:], node), set()).add(context)

    @staticmethod
    def steps(text):
        """(context, symbol) of each byte of a text; contexts go on for TAIL bytes behind the word's opening space."""
        line = bytes(ctw.DEPTH) + b" " + b"".join(w + b" " for w in text.lower().split()) + ctw.END
        out, opening = [], ctw.DEPTH
        for i in range(ctw.DEPTH + 1, len(line)):
            first = max(i - ctw.DEPTH, opening - ctw.TAIL)
            out.append((line[first:i].rjust(ctw.DEPTH, b"\0"), line[i]))
            if line[i] == 32:
                opening = i
        return out

    @staticmethod
    def path(symbol):
        return [((1 << lv) - 1 + (symbol >> (8 - lv)), symbol >> (7 - lv) & 1) for lv in range(8)]

    def weighted(self, context, node, more):
        """Log of the weighted probability at a context once ``more`` bits were added to some."""
        zeros, ones = (a + b for a, b in zip(self.seen.get((context, node), (0, 0)), more.get(context, (0, 0)), strict=True))
        own = math.lgamma(zeros + 0.5) + math.lgamma(ones + 0.5) - math.lgamma(zeros + ones + 1) - math.log(math.pi)
        if len(context) == ctw.DEPTH:
            return own
        below = self.children.get((context, node), set()) | {c for c in more if c[1:] == context and len(c) == len(context) + 1}
        split = sum(self.weighted(c, node, more) for c in sorted(below))
        top = max(own, split)
        return top + math.log(0.5 * math.exp(own - top) + 0.5 * math.exp(split - top))

    def log10(self, text):
        total = 0.0
        for context, symbol in self.steps(text):
            for node, bit in self.path(symbol):
                more = {context[len(context) - d :]: (1 - bit, bit) for d in range(ctw.DEPTH + 1)}
                total += self.weighted(b"", node, more) - self.weighted(b"", node, {})
        return total / math.log(10)


def test_texts_cost_what_plain_context_tree_weighting_says(spark):
    learn = ["ab ba ab", "Ab abracadabra a b", "é ébé ab", "", "ab " * 4500]
    asked = [*learn[:4], "abracadabras zz", "zz", "a ü ab ab", "b"]
    plain = Plain([t.encode() for t in learn])
    table = docs(spark, list(enumerate(asked)))
    for head in (ctw.HEAD, 3, 1):
        got = {r.doc_id: r for r in ctw.score(table, docs(spark, list(enumerate(learn))), head=head).collect()}
        for i, t in enumerate(asked):
            want = plain.log10(t.encode())
            assert abs(got[i].score - want) < 1e-6, t
            assert abs(got[i].bits_per_byte + want * math.log2(10) / len(plain.steps(t.encode()))) < 1e-6


def test_chunks_of_any_size_cost_the_same(spark):
    keys = Counter(w for t in ("ab ba abracadabra é", "b") for w in t.encode().split())
    keys.update(bytes(k) for k in ctw.head_keys(ctw.heads_of([b"ab ba abracadabra".split(), []])[0]).to_pylist())
    table = spark.createDataFrame([(bytearray(k), n) for k, n in keys.items()], "key binary, n long")
    one, many = ({bytes(r.key): (r.n, round(r.value, 9)) for r in ctw.lexicon(table, len(keys), chunk).collect()} for chunk in (100, 2))
    assert one == many and set(one) == set(keys)


def test_the_model_is_a_distribution():
    """All symbols behind one context, over subtrees laid out one by one."""
    rng = np.random.default_rng(4)
    text = bytes(rng.choice(list(b"abc "), 4000).tolist()) + b" "
    words = ctw.words_of(text)
    keys = Counter([*words, *ctw.head_keys(ctw.heads_of([words])[0]).to_pylist()])
    gram, owner = ctw.spelt(list(keys))
    known, at = np.unique(gram, return_inverse=True)
    n = np.bincount(at, np.array(list(keys.values()), float)[owner])
    context = known[n.argmax()] >> np.uint64(8)
    every = np.union1d(known, (context << np.uint64(8)) | np.arange(256, dtype=np.uint64))
    times = np.zeros(len(every))
    times[np.searchsorted(every, known)] = n
    order = np.lexsort((every, every >> np.uint64(8) & np.uint64(0xFFFFFF), every >> np.uint64(8) & np.uint64(0xFFFF)))
    every, times = every[order], times[order]
    level = ctw.shards(every, times)
    upper = [*ctw.above(ctw.Level(*ctw.parents(ctw.SHARD - 1, level.key, level.zeros, level.ones, level.below))), level]
    value = np.concatenate([ctw.Subtree(every[s], times[s]).predicted(every[s], upper) for s in ctw.subtrees(every)])
    assert abs((10.0 ** value[every >> np.uint64(8) == context]).sum() - 1) < 1e-9


def test_scores_and_base_of_texts(spark):
    rows = [(i, prose(i, 60 + i)) for i in range(60)] + [(100, None), (101, ""), (None, "the of"), (5, prose(5, 65)), (102, prose(7, 20000)), (103, "zzqq unheard")]
    table = spark.createDataFrame([(i, t, 0.5) for i, t in rows], "doc_id long, text string, score double")
    learn = table.where(fold(F.col("doc_id"), 7) != 2)
    got = sorted(ctw.score(table, learn, head=8).drop("score", "bits_per_byte").collect(), key=str)
    counts, n = Counter(), 0
    for i, t in rows:
        import zlib

        if zlib.crc32(str("" if i is None else i).encode()) % 7 != 2:
            w = (t or "").lower().encode().split()
            counts.update([*w, b"\n"])
    n, v = sum(counts.values()), len(counts)
    want = []
    for i, t in rows:
        w = [*(t or "").lower().encode().split(), b"\n"]
        want.append((i, len(w), sum(counts[x] > 0 for x in w), n, sum(math.log10((counts[x] + 1) / (n + v + 1)) for x in w)))
    for g, x in zip(got, sorted(want, key=lambda x: f"Row(doc_id={x[0]}, n_tokens={x[1]}"), strict=True):
        assert tuple(g)[:4] == x[:4] and abs(g.base_score - x[4]) < 1e-6 * abs(x[4])
    scores = {r.doc_id: r.score for r in ctw.score(table, learn).collect()}
    assert scores[103] < scores[101] < 0


def test_scores_without_a_corpus(spark):
    table = docs(spark, [(1, "ab"), (2, None)])
    got = {r.doc_id: r for r in ctw.score(table, table.where("false")).collect()}
    assert got[1].n_known == 0 and abs(got[2].score + 8 * math.log10(2)) < 1e-5
    assert ctw.score(docs(spark, []), docs(spark, [])).count() == 0


def test_byte_positions():
    context, symbol, word = positions([b"ab", b"c"])
    assert [hex(int(c)) for c in context] == ["0x20", "0x2061", "0x206162", "0x20", "0x2063"]
    assert bytes(symbol) == b"ab c " and list(word) == [0, 0, 0, 1, 1]


# Top-k


@pytest.mark.parametrize(("pivots", "block", "asked"), [(8, 20_000, 256), (1, 7, 3), (200, 50, 1)])
def test_top_k_matches_brute_force(spark, pivots, block, asked):
    rng = np.random.default_rng(1)
    x = rng.normal(size=(160, 6)).round(2)
    x[100:130] = x[3]
    rows = [(i, [float(c) for c in v]) for i, v in enumerate(x)] + [(500, None), (501, [float("nan")] * 6), (502, [1.0, None, 1.0, 1.0, 1.0, 1.0]), (None, [1.0] * 6), (7, [float(c) for c in x[7]])]
    vectors = voronoi.integers(spark.createDataFrame(rows, "vec_id long, embedding array<double>"))
    got = voronoi.top_k(vectors, vectors.where("vec_id % 20 = 0"), 5, pivots, block, asked).collect()
    ints = np.floor(x * 1024).astype(int)
    want = []
    for q in range(0, 160, 20):
        s = ints @ ints[q]
        order = sorted((-s[i], i) for i in range(160) if i != q)[:5]
        want += [(q, k + 1, i, -int(v)) for k, (v, i) in enumerate(order)]
    assert sorted(tuple(r) for r in got) == sorted(want)


def test_top_k_edges(spark):
    vectors = voronoi.integers(spark.createDataFrame([(0, [1.0]), (1, [0.5])], "vec_id long, embedding array<double>"))
    assert [tuple(r) for r in voronoi.top_k(vectors, vectors.where("vec_id = 0")).collect()] == [(0, 1, 1, 1024 * 512)]
    none = vectors.where("false")
    assert voronoi.top_k(none, none).count() == 0 and voronoi.top_k(vectors, none).count() == 0


# Toxicity and languages


def test_toxic_words_decide(spark):
    bad = ["blarg", "snorfle", "grumpf"]
    r = random.Random(2)
    rows, marks = [], []
    for i in range(400):
        words = prose(i, 80).split()
        if i % 4 == 0:
            for _ in range(6):
                words[r.randrange(80)] = r.choice(bad)
        rows.append((i, " ".join(words), 0.0))
        marks.append((i, int(i % 4 == 0)))
    rows += [(900, None, 0.0), (901, "", 0.0), (None, "blarg " * 20, 0.0), (902, prose(1, 20000), 0.0), (0, rows[0][1], 0.0)]
    labels = spark.createDataFrame([*marks, (None, 1), (5000, None), (3, 0)], "doc_id long, toxic int")
    got = toxicity.score(spark.createDataFrame(rows, "doc_id long, text string, score double"), labels).collect()
    assert len(got) == len(rows) and all(0 <= g.score <= 1 for g in got)
    held = [g for g in got if g.held_out and g.doc_id is not None and g.doc_id < 400]
    assert sum(g.predicted == int(g.doc_id % 4 == 0) for g in held) >= 0.95 * len(held)
    by = {g.doc_id: g.predicted for g in got}
    assert by[900] == by[901] == by[902] == 0 and by[None] == 1


def test_toxicity_without_labels(spark):
    none = spark.createDataFrame([], "doc_id long, toxic int")
    assert [r.score for r in toxicity.score(docs(spark, [(1, "x")]), none).collect()] == [0.0]
    assert toxicity.score(docs(spark, []), none).count() == 0


def test_languages_by_words_then_grams(spark):
    made = {"aa": ["kalo", "mira", "tesu", "bano"], "bb": ["xith", "wrok", "plexu", "gnarth"]}
    r = random.Random(3)
    rows = [(i, " ".join(r.choice(made[lang]) for _ in range(30)), lang) for i in range(120) for lang in [("aa", "bb")[i % 2]]]
    rows += [(500, "gnarthi plexus", None), (501, None, "aa"), (502, "12 !!", "bb"), (503, "", None), (504, "漢字", None), (None, "kalo", "aa"), (2, rows[2][1], "aa")]
    table = spark.createDataFrame([(*x, "q") for x in rows], "doc_id long, text string, lang string, lang_pred string")
    got = {}
    for g in language.identify(table, language.fit(table)).collect():
        got[g.doc_id] = g
        assert 0 <= g.score <= 1
    assert all(got[i].lang_pred == ("aa", "bb")[i % 2] for i in range(120))
    assert got[500].lang_pred == "bb" and got[None].lang_pred == "aa"
    assert {got[i].lang_pred for i in (501, 502, 503)} == {"und"} and got[504].lang_pred in made
    empty = table.where("false")
    assert language.fit(empty) is None and language.identify(table, None).where("lang_pred <> 'und'").count() == 0


# Archive


def test_archive_round_trip(spark, tmp_path):
    pages = [(1, "http://a", "<p>é</p>"), (2, "http://b\nx", "<p>é</p>"), (3, None, None), (4, "u", ""), (5, "v", "z" * 100_000), (None, "w", "<p>é</p>"), (None, "w", "<p>é</p>")]
    archive = warc.Archive(str(tmp_path / "a"))
    warc.write(spark.createDataFrame([(*p, 1) for p in pages], "page_id long, url string, html string, digest int"), archive)
    got = sorted(((r.page_id or 0, r.record_type, r.refers_to, r.payload_bytes, r.payload_digest) for r in warc.read(spark, archive).collect()), key=str)
    sha = lambda t: base64.b32encode(hashlib.sha1((t or "").encode()).digest()).decode()
    rep = {"<p>é</p>": 2, "": 4, "z" * 100_000: 5}
    want = [(i or 0, "response" if rep[t or ""] == i else "revisit", None if rep[t or ""] == i else rep[t or ""], len((t or "").encode()), sha(t)) for i, _, t in pages]
    assert got == sorted(want, key=str)
    assert warc.read(spark, archive).where("NOT verified").count() == 0
    assert spark.read.parquet(archive.payloads).count() == 3
    seen = []
    for r in warc.reconstruct(spark, archive).collect():
        head, _, rest = bytes(r.record).partition(b"\r\n\r\n")
        http, _, body = rest.partition(b"\r\n\r\n")
        named = [int(line[14:]) for line in head.split(b"\r\n") if line.startswith(b"WARC-Page-ID: ")]
        payload = next(t or "" for i, _, t in pages if i == (named[0] if named else None)).encode()
        assert body == (payload if b"WARC-Type: response" in head else b"") + b"\r\n\r\n"
        assert f"Content-Length: {len(rest) - 4}".encode() in head and head.startswith(b"WARC/1.1\r\n")
        assert b"Content-Type: application/http" in head and http.startswith(b"HTTP/1.1 200 OK\r\n") and f"Content-Length: {len(payload)}".encode() in http
        seen += named
    assert sorted(seen) == [1, 2, 3, 4, 5]


def test_records_that_were_changed_are_told(spark, tmp_path):
    archive = warc.Archive(str(tmp_path / "c"))
    warc.write(spark.createDataFrame([(1, "u", "same"), (2, "v", "same"), (3, "ü\r\n", "WARC-Type: x\r\n\r\nHTTP")], "page_id long, url string, html string"), archive)
    records = warc.reconstruct(spark, archive)
    assert all(r.sound for r in warc.parse(records).collect())
    for old, new in ((b"same", b"sama"), (b"same", b"samee"), (b"Content-Length: 4", b"Content-Length: 5")):
        broken = spark.createDataFrame([(bytearray(bytes(r.record).replace(old, new)),) for r in records.collect()], "record binary")
        assert sorted((r.page_id, r.sound) for r in warc.parse(broken).collect() if r.page_id != 1) == [(2, False), (3, True)]


def test_empty_archive_and_the_least_size(spark, tmp_path):
    schema = "page_id long, url string, html string"
    warc.write(spark.createDataFrame([], schema), warc.Archive(str(tmp_path / "e")))
    assert warc.read(spark, warc.Archive(str(tmp_path / "e"))).count() == 0
    warc.write(spark.createDataFrame([(1, "u", "ab"), (2, "u", "ab")], schema), warc.Archive(str(tmp_path / "l")), least=3)
    assert {r.record_type for r in warc.read(spark, warc.Archive(str(tmp_path / "l"))).collect()} == {"response"}


# Secrets


def brute_base(text):
    import re

    out = [("assign", m.start(), m.end()) for m in re.finditer(r"""([Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", text) if len(m[2]) >= 6]
    out += [("access", m.start(), m.end()) for m in re.finditer(r"AKIA[A-Z0-9]+", text) if len(m[0]) >= 20]
    out += [("hex", m.start(), m.end()) for m in re.finditer(r"[0-9a-f]+", text) if len(m[0]) >= 24]
    return sorted(out, key=lambda s: (s[1], ("assign", "access", "hex").index(s[0])))


TRICKY = ["password: token: abcdef", 'API_KEY="abc.def=1"', "AKIAAKIA" + "A1" * 9, "secret=ab token=cdefgh", "ſecret=abcdef", "toKen=abcdef", "é " * 9 + "apikey : 'x/y+z=_'", "a" * 23 + " " + "0f" * 12, "secret = ="]


def test_base_spans_match_the_plain_patterns():
    r = random.Random(8)
    for text in [*TRICKY, *("".join(r.choice("secret=tokn:AKI0fab \"'_") for _ in range(400)) for _ in range(40)), " ".join(TRICKY)]:
        assert secrets.base_spans(text) == brute_base(text)


def brute_path(field, e):
    best = None
    import itertools

    for tags in itertools.product(range(3), repeat=len(e)):
        s = sum(e[i][t] for i, t in enumerate(tags)) + sum(field.transitions[a][b] for a, b in zip(tags, tags[1:], strict=False))
        if best is None or s > best[0]:
            best = (s, tags)
    return best[1]


def test_viterbi_finds_the_best_path():
    rng = np.random.default_rng(5)
    field = secrets.Field({}, rng.normal(size=(3, 3)))
    tagger = secrets.Tagger(field)
    for _ in range(20):
        e = rng.normal(size=(6, 3))
        assert tuple(tagger.path(e, False, False)) == brute_path(field, e)


def sample_texts():
    out = []
    for i in range(150):
        words = prose(i, 60).split()
        if i % 3 == 0:
            h = hashlib.md5(str(i).encode()).hexdigest()
            words[20] = (f"password={h[:20]}", f'token = "{h}"', f"AKIA{h[:16].upper()}")[i // 3 % 3]
        out.append(" ".join(words))
    return out


def test_the_field_adds_secrets_of_other_forms(spark):
    texts = sample_texts()
    unknown = prose(77, 20) + " q8ZkP2mVx91LsT0rYb7Qw " + prose(78, 20)
    rows = [(i, t, 1) for i, t in enumerate(texts)] + [(900, unknown, 1), (901, None, 1), (902, "", 1), (903, prose(5, 20000), 1), (None, "secret=abcdefgh", 1)]
    table = spark.createDataFrame(rows, "doc_id long, text string, spans int")
    got = {r.doc_id: r for r in secrets.scan(table, secrets.fit(table.where("doc_id < 800"))).collect()}
    for i, t, _ in rows:
        base = [(s.kind, s.start, s.end) for s in got[i].spans if s.kind != "crf"]
        assert base == brute_base(t or "")
    assert [unknown[s.start : s.end] for s in got[900].spans] == ["q8ZkP2mVx91LsT0rYb7Qw"]
    assert not got[901].spans and not got[902].spans and not got[903].spans
    plain = secrets.scan(docs(spark, [(1, "nothing here")]), None).collect()
    assert plain[0].spans == [] and secrets.fit(docs(spark, [(1, "nothing"), (2, None)])) is None
    assert secrets.scan(docs(spark, []), None).count() == 0


def test_redaction(spark):
    text = "é password=abcdef012345678901234567890123 and AKIA" + "B2" * 8 + " end"
    table = spark.createDataFrame([(1, text, len(text)), (2, None, None), (3, "clean", 5)], "doc_id long, text string, n_chars long")
    got = {r.doc_id: r for r in secrets.redact(secrets.scan(table, None)).collect()}
    assert got[1].text == "é [SECRET] and [SECRET] end" and got[1].n_chars == len(got[1].text)
    assert got[2].text is None and got[2].n_chars is None and got[3].text == "clean"


def test_large_numbers_beside_nulls_stay_whole(spark):
    big = (1 << 62) + 1
    table = spark.createDataFrame([(big, "some text", None), (None, "other text", big), (big + 2, None, 3)], "doc_id long, text string, n_chars long")
    want = sorted([(big, None), (None, big), (big + 2, 3)], key=str)
    none = spark.createDataFrame([], "doc_id long, toxic int")
    for out in (toxicity.score(table, none), secrets.scan(table, None), language.identify(table, None), simhash.keep_one(table)):
        assert sorted(((r.doc_id, r.n_chars) for r in out.collect()), key=str) == want


# Decontamination, where typing or the reading of a text might hide a copy

BOILING = "What is the boiling point of water at sea level"


def test_what_stands_before_an_item_hides_no_copy(spark):
    bench = spark.createDataFrame([(1, BOILING), (2, "Alice buys 5 apples and then gives 5 away to friends"), (3, "It rained. Alice ran home with 3 wet dogs")], "item_id long, text string")
    rows = [(1, f"Question: {BOILING}"), (2, f"so, {BOILING.lower()}"), (3, "Later. Bob buys 7 apples and then gives 7 away to friends"), (4, "It rained. Carol ran home with 4 wet dogs"), (5, "Bob buys 7 apples and then gives 8 away to friends")]
    for limit in (decontaminate.BROADCAST_ROWS, 0):
        found = decontaminate.contaminated(docs(spark, rows), bench, broadcast_rows=limit).collect()
        assert {(r.doc_id, r.item_id, r.n_windows) for r in found} == {(1, 1, 1), (2, 1, 1), (3, 2, 1), (4, 3, 1)}


def test_windows_of_few_words_match_as_they_stand(spark):
    item = "Compute 12 + 7 * 3 - 45 / 9"
    long = "Paris 1 2 3 Rome 4 5 6 Oslo 7 8 9 10"
    bench = spark.createDataFrame([(1, item), (2, long)], "item_id long, text string")
    rows = [(1, f"First. {item} now"), (2, "First. Compute 13 + 7 * 3 - 45 / 9 now"), (3, f"the list: {long} more"), (4, long.replace("8", "88").replace("Rome", "Bonn"))]
    for limit in (decontaminate.BROADCAST_ROWS, 0):
        found = decontaminate.contaminated(docs(spark, rows), bench, broadcast_rows=limit).collect()
        assert {(r.doc_id, r.item_id, r.n_windows, r.n_other) for r in found} == {(1, 1, 1, 0), (3, 2, 2, 0)}


def test_both_joins_tell_rows_of_one_id_apart(spark):
    bench = spark.createDataFrame([(1, ITEM), (2, " ".join(WORDS[:14]))], "item_id long, text string")
    changed = f"They said, {ITEM.replace('40', '75')}"
    rows = [(1, changed), (1, "A 5 b 6 c 7 in 8 days"), (None, changed), (None, "A 1 b 2"), (2, " ".join(WORDS[:14])), (2, "and 9 c 7"), (2, " ".join(WORDS[:14])), (None, None)]
    a, b = (decontaminate.contaminated(docs(spark, rows), bench, broadcast_rows=n).collect() for n in (decontaminate.BROADCAST_ROWS, 0))
    assert sorted(a, key=repr) == sorted(b, key=repr)
    found = {r.doc_id: (r.item_id, r.n_windows > 0) for r in a}
    assert found == {1: (1, True), None: (1, True), 2: (2, True)} and next(r.n_windows for r in a if r.doc_id == 2) == 6
