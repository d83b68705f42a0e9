"""Ranked lexical search against its definition and against SQL."""

import math
import re
from collections import Counter

import numpy as np
import oracle
from cases import EDGE
from hypothesis import given, settings
from hypothesis import strategies as st
from showgrid.llm import maxsketch as M

ITEM = "item_id long, text string, term string, no long"


def terms(text):
    return ["".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in w) for w in re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", text or "")]


def expected(docs, items, top=50):
    """Every document scored for every item."""
    bags = [(d, Counter(terms(t)), len(terms(t))) for d, t in docs]
    n_docs, total = sum(n > 0 for _, _, n in bags), sum(n for _, _, n in bags)
    df = Counter(w for _, bag, _ in bags for w in bag)
    weight = {w: math.floor(1000 * math.log((2 * n_docs + 2) / (2 * k + 1))) for w, k in df.items()}
    wanted = {}
    for i, t in items:
        wanted.setdefault(i, set()).update(terms(t))
    out = []
    for i, words in wanted.items():
        found = []
        for d, bag, n in bags:
            score = sum(weight[w] * (10**9 * bag[w] // (1000 * bag[w] + 20 * (50 + 50 * n * n_docs // total))) for w in words if w in bag)
            if score > 0:
                found.append((-score, d is None, d or 0, d))
        out += [(i, k + 1, f[3], -f[0]) for k, f in enumerate(sorted(found, key=lambda f: f[:3])[:top])]
    return sorted(out, key=repr)


def got(df):
    return sorted(map(tuple, df.select("item_id", "rank", "doc_id", "score").collect()), key=repr)


def test_whole_table_against_sql(spark):
    folder = "/root/testdata/sf0.01"
    assert oracle.compare(M.op12(spark, folder), folder, M.SQL) is None


def test_small_sketch_and_many_passes(spark, small, small_rows):
    """A sketch of three cells bounds badly and changes nothing; nor do passes of 7 items."""
    items = spark.read.parquet("/root/testdata/sf0.001/benchmark.parquet")
    rows = [tuple(r) for r in items.select("item_id", "text").collect()]
    want = expected(small_rows, rows, 5)
    assert got(M.ranked(small, items, 5)) == want
    assert got(M.ranked(small, items, 5, width=3, items_per_pass=len(rows) // 3 + 1)) == want


def test_edge_rows(spark, edge, empty):
    """Nulls, empty and very long texts, ties, repeated rows and ids, no documents, no items."""
    docs = [(d, t) for d, t, _ in EDGE]
    more = edge.unionByName(edge.where("doc_id in (4, 7, 16)")).unionByName(edge.where("doc_id = 6").selectExpr("null as doc_id", *[c for c in edge.columns if c != "doc_id"]))
    docs += [(d, t) for d, t, _ in EDGE if d in (4, 7, 16)] + [(None, EDGE[5][1])]
    items = [(1, "One TWO two"), (2, None), (3, ""), (None, "CAFÉ café naïve ▁mark"), (4, "a shared passage"), (4, "W1 w2"), (5, "nothing-like-this"), (6, EDGE[6][1])]
    frame = spark.createDataFrame([(i, t, None, None) for i, t in items], ITEM)
    assert got(M.ranked(more, frame)) == expected(docs, items)
    assert got(M.ranked(more, frame, top=2)) == expected(docs, items, 2)
    assert got(M.ranked(empty, frame)) == [] and got(M.ranked(more, frame.limit(0))) == []


@settings(max_examples=60, deadline=None)
@given(st.data())
def test_bounds_hold_and_spare_work(data):
    rng = np.random.default_rng(data.draw(st.integers(0, 10**6)))
    rows, size, n_items, top = 300, 40, 5, 3
    length = rng.integers(0, 9, rows)
    at = np.concatenate([[0], np.cumsum(length)])
    term = np.concatenate([rng.choice(size, k, replace=False) for k in length]).astype(np.int64)
    tf, n = rng.integers(1, 5, len(term)), length * 3 + 1
    members = [(i, int(t)) for i in range(n_items) for t in rng.choice(size, 4, replace=False)]
    s = M.Searcher(members, n_items, rng.integers(0, 3000, size), rows, int(n.sum()), data.draw(st.sampled_from([2, 16, 256])))
    row = np.repeat(np.arange(rows), length)
    impact = M.impacts(tf, s.weights[term], n[row], s.with_terms, s.length)
    exact = np.zeros((rows, n_items), np.int64)
    for i in range(n_items):
        np.add.at(exact[:, i], row, np.where(s.holds[i, term], impact, 0))
    assert (s.sketch(row, term, impact, rows) @ s.lookup >= exact).all()
    best = M.Best(n_items, top)
    for lo in range(0, rows, 100):
        a, b = at[lo], at[lo + 100]
        s.search(np.arange(lo, lo + 100), n[lo : lo + 100], at[lo : lo + 101] - a, term[a:b], tf[a:b], best)
    for i in range(n_items):
        want = sorted((-x, d) for d, x in enumerate(exact[:, i].tolist()) if x > 0)[:top]
        assert [(-x, d) for x, d in zip(best.score[best.item == i].tolist(), best.doc[best.item == i].tolist())] == want
    assert s.width < 256 or s.scored < rows * n_items
