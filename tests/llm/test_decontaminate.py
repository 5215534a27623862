"""Decontamination: every item is found, slots of any length agree, clean rows stay."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from quire.llm import decontaminate as D
from tests.llm.test_operators import DOC, ITEM, docs, prose

BENCH = "item_id long, text string"


def found(spark, rows, items, **more):
    return {r.doc_id: r for r in D.contaminated(docs(spark, rows), spark.createDataFrame(items, BENCH), **more).collect()}


def test_an_exact_copy_of_every_item_is_found(spark):
    r = random.Random(6)
    pieces = ["12", "3.5", "Paris", "Maria Lopez", "km", "seven", "the", "of", "adds", "É", "x2", "NASA", "and"]
    items = [(i, " ".join(r.choice(pieces) for _ in range(1 + i % 30))) for i in range(60)]
    rows = [(i, f"{prose(i, 40)}. {t}; {prose(i + 99, 700 * (i % 3))}") for i, t in items] + [(1000 + i, t.upper()) for i, t in items]
    for limit in (D.BROADCAST_ROWS, 0):
        got = found(spark, rows, items, least=1, broadcast_rows=limit)
        assert set(got) == {i for i, _ in rows}


def test_short_items_are_whole_words_and_only_asked_for(spark):
    items = [(1, "forty two"), (2, "Is it?"), (3, "...")]
    rows = [(1, "say forty two times"), (2, "say forty twos"), (3, "it is"), (4, "So IS IT here"), (5, "...")]
    assert set(found(spark, rows, items)) == set()
    assert {k: v.item_id for k, v in found(spark, rows, items, least=1).items()} == {1: 1, 4: 2}


def test_names_of_other_lengths_and_numbers_in_words(spark):
    items = [(1, "Tom bought seven apples in Rome and gave Tom three of them")]
    rows = [
        (1, "yes, Maria Lopez bought 12 apples in New York City and gave Maria Lopez 40 of them away"),
        (2, "yes, Maria Lopez bought 12 apples in New York City and gave Maria 40 of them away"),
        (3, "yes, maria bought 12 apples in York and gave maria 40 of them away"),
    ]
    got = found(spark, rows, items)
    assert set(got) == {1} and got[1].n_windows == 1


def test_runs_of_names_and_numbers_need_no_stack(spark):
    rows = [(1, "Ab Cd " * 30_000), (2, "1." * 60_000 + "1"), (3, "1 Ab " * 30_000), (4, "A" * 200_000)]
    assert found(spark, rows, [(1, ITEM)]) == {}


def test_segments_lose_no_window(spark):
    rows = [(i, f"{prose(i, n)} {ITEM.replace('40', str(i + 100))} {prose(i + 1, 30)}") for i, n in enumerate([*range(D.SEGMENT - 25, D.SEGMENT + 8), 2 * D.SEGMENT - 9])]
    for limit in (D.BROADCAST_ROWS, 0):
        got = found(spark, rows, [(1, ITEM)], broadcast_rows=limit)
        assert len(got) == len(rows) and {r.n_windows for r in got.values()} == {8}


def test_clean_rows_of_null_and_repeated_ids_stay(spark):
    rows = [(None, ITEM), (None, "clean words only here"), (None, None), (7, f"x {ITEM}"), (7, "other text"), (8, "")]
    table = docs(spark, rows).withColumns({"quire_bad_id": F.lit(1), "Quire_Bad_Hash": F.lit("h"), "tokens": F.lit(2), "kind": F.lit(3), "h": F.lit(4)})
    kept = D.decontaminate(table, spark.createDataFrame([(1, ITEM), (None, ITEM)], BENCH))
    assert kept.columns == table.columns
    assert sorted([(r.doc_id, r.text) for r in kept.collect()], key=repr) == sorted([(None, "clean words only here"), (None, None), (7, "other text"), (8, "")], key=repr)


@pytest.mark.parametrize("limit", [D.BROADCAST_ROWS, 0])
def test_templates_match_brute_force(spark, limit):
    """All windows of all readings compared one by one."""
    r = random.Random(9)
    pieces = ["12", "7", "Paris", "Rome", "km", "two", "the", "of", "adds", "then", "it"]
    make = lambda n: " ".join(r.choice(pieces) for _ in range(n)).replace("Paris Rome", "Paris, Rome")
    items = [(i, make(r.randrange(5, 16))) for i in range(12)]
    rows = [(i, make(30) + " " + r.choice(items)[1].replace("12", "70")) for i in range(40)] + [(0, items[3][1])]

    def read(df, key):
        return [(x[key], x.kind, x.tokens) for x in D.readings(df, key).collect()]

    bare = lambda w: tuple(t[:2] if t[0] == "\x01" else t for t in w)
    places = lambda w: tuple(w.index(t) + 1 if t[0] == "\x01" else 0 for t in w)
    known = {}
    for item, kind, t in read(spark.createDataFrame(items, BENCH), "item_id"):
        size = min(6, len(t))
        for i in range(len(t) - size + 1):
            w = t[i : i + size]
            if kind == D.PLAIN or 2 * sum(x[0] != "\x01" for x in w) >= size:
                at = known.setdefault((kind, bare(w)), {})
                at[places(w)] = min(item, at.get(places(w), item))
    sizes = {(k, len(t)) for k, t in known}
    want = {}
    for doc, kind, t in read(docs(spark, rows, DOC), "doc_id"):
        for k, size in sizes:
            for i in range(len(t) - size + 1):
                w = t[i : i + size]
                if k == kind and (kind, bare(w)) in known:
                    item = known[kind, bare(w)].get(places(w))
                    x = want.setdefault(doc, {"items": set(), (0, True): 0, (1, True): 0, (0, False): 0})
                    x[kind, item is not None] += 1
                    x["items"] |= {item} - {None}
    want = {(d, min(x["items"]), max(x[0, True], x[1, True]), x[0, False]) for d, x in want.items() if x["items"]}
    got = D.contaminated(docs(spark, rows), spark.createDataFrame(items, BENCH), size=6, broadcast_rows=limit)
    assert {tuple(g) for g in got.collect()} == want and len(want) > 20
