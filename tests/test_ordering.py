"""Positions and percentiles by ranges against a plain sort."""

from __future__ import annotations

import random
from fractions import Fraction

import numpy as np
import pytest
from pyspark.sql import functions as F

from quire.operators import evaluation as V
from quire.operators import ordering as O


@pytest.mark.parametrize("ranges", [None, 2, 7, 40])
def test_positions_are_those_of_a_sort(spark, ranges):
    r = random.Random(1)
    rows = [(r.choice(["https://a", "https://b", "ftp", "z"]) + str(r.randrange(90)), k) for k in range(400)] + [("https://a1", -k) for k in range(300)] + [(None, 7), (None, 8)]
    got = O.positions(spark.createDataFrame(rows, "url string, k int"), ["url", "k"], ranges=ranges).collect()
    want = sorted(rows, key=lambda x: (x[0] is not None, x[0] or "", x[1]))
    assert [(x.url, x.k) for x in sorted(got, key=lambda x: x.position)] == want
    assert sorted(x.position for x in got) == list(range(len(rows)))


def test_positions_of_nothing(spark):
    empty = spark.createDataFrame([], "url string")
    assert O.positions(empty, ["url"]).count() == 0 and V.shard(empty, "url", 4).count() == 0


def test_percentiles_are_those_of_numpy(spark):
    r = random.Random(2)
    groups = {"many": [r.gauss(0, 1) for _ in range(1500)], "few values": [float(r.randrange(3)) for _ in range(500)], "one": [4.0], "two": [1.0, 2.0], None: [float(k) for k in range(101)]}
    rows = [(g, v) for g, vs in groups.items() for v in vs] + [("many", None), ("none", None), ("none", float("nan"))]
    table = spark.createDataFrame(rows, "g string, v double")
    shares = [0.0, 0.25, 0.5, 0.95, 1.0]
    got = {x.g: [x[f"p{k}"] for k in range(len(shares))] for x in O.percentiles(table, ["g"], V.finite(F.col("v")), shares).collect()}
    assert set(got) == set(groups)
    for g, vs in groups.items():
        assert np.allclose(got[g], np.percentile(vs, [100 * s for s in shares]))
    stats = {x.g: x for x in V.group_stats(table, ["g"], "v").collect()}
    assert stats["none"].n == 0 and stats["none"].median is None and stats[None].median == 50 and stats["one"].variance == 0


def test_perfect_groups(spark):
    rows = spark.createDataFrame([("a", True), ("a", True), ("b", True), ("c", True), ("c", False), (None, True), (None, True)], "g string, ok boolean")
    assert {(x.g, x.n) for x in V.perfect(rows, "g", "ok").collect()} == {("a", 2), (None, 2)}


def test_fused_rounds_once(spark):
    r = random.Random(4)
    rows = [(r.uniform(-9, 9) * 10 ** r.randrange(6), r.random(), r.uniform(-9, 9) * 10 ** r.randrange(6)) for _ in range(500)]
    got = spark.createDataFrame(rows, "a double, b double, c double").select("a", "b", "c", O.fused(F.col("a"), F.col("b"), F.col("c")).alias("x")).collect()
    assert all(x.x == float(Fraction(x.a) * Fraction(x.b) + Fraction(x.c)) for x in got)
    beyond = spark.createDataFrame([(2.0, 0.5, float("inf")), (1e308, 0.5, 1.0)], "a double, b double, c double").select(O.fused(F.col("a"), F.col("b"), F.col("c")).alias("x")).collect()
    assert [x.x for x in beyond] == [float("inf"), 5e307]
