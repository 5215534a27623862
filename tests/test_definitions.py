"""Queries that SQL can't state, on small tables, against plain versions of their definitions."""

from __future__ import annotations

import itertools
import math
import random
import re
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pytest

from quire.functions import html as H
from quire.functions.keywords import LEAST_TEXT_WORDS, MOST, MOST_WORDS, yake
from quire.functions.reduction import STOPWORDS
from quire.operators import chunking as C
from quire.operators import geometry as G
from quire.plans import registry

QUERIES = registry.queries()


def texts(seed=1, n=25):
    r = random.Random(seed)
    words = "the data of analysis model Training quality in 1999 system NASA deep network and for tokens implementation_x running best".split()
    out = []
    for k in range(n):
        parts = [" ".join(r.choice(words) for _ in range(r.randrange(1, 14))).capitalize() + r.choice([". ", "! ", "? ", "\n", "\n\n"]) for _ in range(r.randrange(0, 40))]
        out.append((k, "".join(parts)))
    return [*out, (100, ""), (101, "x" * 5000), (102, " \n\n "), (103, "a" * 900 + " " + "b" * 900)]


@pytest.mark.parametrize(("size", "overlap"), [(1000, 200), (120, 30), (50, 0)])
def test_semantic_chunks(spark, size, overlap):
    """Chunks are the pieces of the coarsest breaks that fit, filled greedily, with whole pieces of overlap."""
    rows = texts()
    got = defaultdict(list)
    for r in C.semantic(spark.createDataFrame(rows, "doc_id long, text string"), size, overlap).orderBy("doc_id", "chunk_index").collect():
        got[r.doc_id].append(r.chunk)
        assert r.chunk_index == len(got[r.doc_id]) - 1

    def cut(text, patterns):
        if len(text) <= size - overlap:
            return [text]
        if not patterns:
            return [text[i : i + size - overlap] for i in range(0, len(text), size - overlap)]
        parts, start = [], 0
        for i in range(1, len(text)):
            if any(m.end() == i for m in re.finditer(patterns[0], text)):
                parts.append(text[start:i])
                start = i
        return [p for x in [*parts, text[start:]] for p in cut(x, patterns[1:])]

    for k, text in rows:
        if not text or len(text) > 1500:
            continue
        pieces = cut(text, [r"(?<=\n\n)", r"(?<=\n)", r"(?<=[.!?])\s+", r"\s+"])
        want, first, at = [], 0, 0
        while at < len(pieces):
            end = at
            while end < len(pieces) and (end == first or sum(map(len, pieces[first : end + 1])) <= size):
                end += 1
            want.append("".join(pieces[first:end]))
            at = end
            while first < end and at < len(pieces) and (sum(map(len, pieces[first:end])) > overlap or sum(map(len, pieces[first : end + 1])) > size):
                first += 1
        assert got[k] == [w.strip() for w in want if w.strip()], k
        assert all(len(c) <= size for c in got[k])


def test_yake_scores(spark):
    rows = texts(2)
    stop = STOPWORDS["en"]
    got = defaultdict(list)
    for r in yake(spark.createDataFrame(rows, "doc_id long, text string"), stop).orderBy("doc_id", "rank").collect():
        got[r.doc_id].append((r.keyword, r.score))

    for k, text in rows:
        sentences = [x for x in ([w for w in re.split(r"[\W_]+", s) if w] for s in re.split(r"[.!?\n]", text)) if x]
        flat = [(n, i, w) for n, s in enumerate(sentences) for i, w in enumerate(s)]
        if len(flat) < LEAST_TEXT_WORDS:
            assert not got[k]
            continue
        tf = Counter(w.lower() for _, _, w in flat)
        mean, spread = np.mean(list(tf.values())), np.std(list(tf.values()))

        def score(t):
            here = [(n, i, w) for n, i, w in flat if w.lower() == t]  # noqa: B023
            case = sum(w[0].isupper() and i > 0 for _, i, w in here) / (1 + math.log(tf[t]))  # noqa: B023
            lines = sorted(n for n, _, _ in here)
            position = math.log(math.log(3 + lines[len(lines) // 2]))
            left = {sentences[n][i - 1].lower() for n, i, _ in here if i}  # noqa: B023
            right = {sentences[n][i + 1].lower() for n, i, _ in here if i + 1 < len(sentences[n])}  # noqa: B023
            related = 1 + (len(left) + len(right)) / max(tf.values())  # noqa: B023
            return max(related * position / (case + tf[t] / (mean + spread) / related + len(set(lines)) / len(sentences) / related + 1e-9), 1e-9)  # noqa: B023

        found = Counter()
        for s in sentences:
            low = [w.lower() for w in s]
            for n in range(1, MOST_WORDS + 1):
                for g in zip(*(low[i:] for i in range(n)), strict=False):
                    if g[0] not in stop and g[-1] not in stop and min(map(len, g)) > 1:
                        found[g] += 1
        scored = sorted(((" ".join(g), 1 / (1 + math.prod(map(score, g)) / (n * (1 + sum(map(score, g)))))) for g, n in found.items()), key=lambda x: (-x[1], x[0]))[:MOST]
        assert [w for w, _ in got[k]] == [w for w, _ in scored] or np.allclose([s for _, s in got[k]], [s for _, s in scored])
        assert np.allclose([s for _, s in got[k]], [s for _, s in scored])


def test_cells_and_tables_of_crossings(spark):
    """A cell is the nearest rectangle down and to the right of which all sides are covered by one edge each."""
    r = random.Random(5)
    rows = []
    for page in range(6):
        for _ in range(9):
            a, b = sorted(r.sample(range(0, 60, 10), 2))
            rows.append((page, r.choice("hv"), float(r.randrange(0, 60, 10)), float(a), float(b)))
    rows = list({(p, o, at): (p, o, at, lo, hi) for p, o, at, lo, hi in rows}.values())
    edges = spark.createDataFrame(rows, "page int, orientation string, place double, low double, high double")
    points = G.intersections(edges, "page", 0.0)
    got = {tuple(x) for x in G.cells(points, "page").collect()}
    want = set()
    for page in range(6):
        v = {at: (lo, hi) for p, o, at, lo, hi in rows if p == page and o == "v"}
        h = {at: (lo, hi) for p, o, at, lo, hi in rows if p == page and o == "h"}
        on = lambda x, y: x in v and y in h and v[x][0] <= y <= v[x][1] and h[y][0] <= x <= h[y][1]  # noqa: B023, E731
        for x, y in itertools.product(v, h):
            fits = [(y1, x1) for x1, y1 in itertools.product(v, h) if x1 > x and y1 > y and all(on(a, b) for a in (x, x1) for b in (y, y1))]
            if fits:
                y1, x1 = min(fits)
                want.add((page, x, y, x1, y1))
    assert got == want and want
    tables = G.tables_of_cells(G.cells(points, "page"), "page").collect()
    for a, b in itertools.combinations(tables, 2):
        corners = lambda c: {(x, y) for x in (c.x0, c.x1) for y in (c.y0, c.y1)}
        if a.page == b.page and corners(a) & corners(b):
            assert a.table_index == b.table_index
    for page in {t.page for t in tables}:
        first = [t.table_index for t in sorted((t for t in tables if t.page == page), key=lambda t: (t.y0, t.x0))]
        assert list(dict.fromkeys(first)) == list(range(len(set(first))))


def test_font_levels_are_settled_clusters(spark):
    """Each size belongs to its nearest centroid, each centroid is its members' mean, the fullest is body text."""
    r = random.Random(6)
    sizes = [(d, round(r.choice([9.0, 9.2, 12.0, 18.5, 24.0, 24.4, 31.0]) + 0.1 * (d % 2), 2)) for d in range(4) for _ in range(60)] + [(9, 11.0), (9, float("nan")), (9, None)]
    got = defaultdict(list)
    for x in G.font_levels(spark.createDataFrame(sizes, "doc int, size double"), "doc", "size").collect():
        got[x.doc].append(x)
    for d in range(4):
        mine = [s for k, s in sizes if k == d]
        centres = [x for x in got[d] if x.members]
        of = defaultdict(list)
        for s in mine:
            of[min(centres, key=lambda c: abs(c.centroid - s)).centroid].append(s)
        for c in centres:
            assert c.members == len(of[c.centroid]) and abs(np.mean(of[c.centroid]) - c.centroid) < 0.05
        body = max(centres, key=lambda c: (c.members, -c.centroid))
        heads = sorted((c for c in centres if c.centroid > body.centroid), key=lambda c: -c.centroid)
        assert [c.level for c in heads] == [f"h{k}" for k in range(1, len(heads) + 1)][:6] or [c.level for c in heads] == list(range(1, len(heads) + 1))[:6]
    assert len([x for x in got[9] if x.members]) == 1


def test_markdown_of_pages():
    page = """<html><head><title>gone</title><style>p{}</style></head><body><h2>Top  <b>bold</b></h2><p>one &amp; <a href="/x">two</a><br>three</p>
<ul><li>a</li><li>b<ol><li>c</li><li>d</li></ol></li></ul><table><tr><th>h</th><th>i</th></tr><tr><td>1</td><td></td></tr></table><script>no()</script><img src="s.png" alt="p"><code>x</code> <em>y</em></body></html>"""
    assert H.to_markdown(page) == "## Top **bold**\n\none & [two](/x)\nthree\n\n- a\n- b\n\n  1. c\n  2. d\n\n| h | i |\n| --- | --- |\n| 1 | |\n\n![p](s.png)`x` *y*"
    assert H.to_markdown(None) is None and H.to_markdown("") == "" and H.to_markdown("<p>") == "" and H.to_markdown("plain") == "plain"


def test_pages_of_the_query_keep_their_words(spark, tmp_path):
    pages = [(k, "u", f"<h1>t{k}</h1><p>word{k} <i>it</i></p><script>var gone{k};</script>" + "<div>" * k) for k in range(20)] + [(90, "u", None)]
    spark.createDataFrame(pages, "page_id long, url string, html string").write.parquet(f"{tmp_path}/pages.parquet")
    got = {r.page_id: r.markdown for r in QUERIES["html_markdown"](spark, str(tmp_path)).collect()}
    assert got[90] is None and all(got[k] == f"# t{k}\n\nword{k} *it*" for k in range(20))
