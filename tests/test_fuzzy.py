"""Fuzzy titles against the distances of all pairs."""

import random

from showgrid.operators.fuzzy import fuzzy_titles


def edit_distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def nearest(wanted, films):
    out = {}
    for t in wanted:
        if t is None or len(t) < 6:
            continue
        near = [(edit_distance(t, r), -v, i, u) for r, u, _, v, i in films if r is not None and u is not None]
        near = [x for x in near if x[0] <= (2 if len(t) >= 12 else 1)]
        if near:
            out[t] = (min(near)[0], min(near)[3])
    return out


def test_fuzzy_titles_against_all_pairs(spark):
    rng = random.Random(3)
    make = lambda: "".join(rng.choice("aab ") for _ in range(rng.randint(3, 16)))
    films = [(make(), f"u{i}", 2000 + i % 9, rng.randint(-1, 3), i) for i in range(250)] + [(None, "n", None, 1, 900), ("no url at all", None, None, 1, 901), ("", "e", None, 1, 902)]
    wanted = [make() for _ in range(200)] + [None, "", "aaaaaaaaaaaaaaaa", "no url at alx"] * 2
    left = spark.createDataFrame([(w,) for w in wanted], "t string").repartition(5)
    right = spark.createDataFrame(films, "t string, film_url string, hit_year int, viewers int, id long").repartition(4)
    rows = fuzzy_titles(left, right).collect()
    got = {r.t: (r.distance, r.film_url) for r in rows}
    want = nearest(wanted, films)
    assert len(got) == len(rows)
    assert got == want
    assert len(got) > 20
    assert fuzzy_titles(left.limit(0), right).count() == 0 and fuzzy_titles(left, right.limit(0)).count() == 0
