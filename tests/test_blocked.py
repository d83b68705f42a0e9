"""Block products of all users and films against plain loops."""

import math
import random

from pyspark.sql import functions as F

from showgrid.operators import blocked as B
from showgrid.operators import features as X

CATEGORY = {d: B.CATEGORIES[d % 4] for d in range(40)}


def tables(spark, users=70, films=9):
    rnd = random.Random(5)
    entry = lambda n: {d: float(rnd.randint(1, 9)) for d in rnd.sample(range(40), n)}
    profile = {u: entry(rnd.randint(1, 30)) for u in range(users)} | {900: {}}
    vectors = {f: entry(rnd.randint(1, 25)) for f in range(films)} | {500: {}}
    p = spark.createDataFrame([(u, d, v) for u, e in profile.items() for d, v in e.items()], "user_id long, dim long, v double")
    v = spark.createDataFrame([(f, d, CATEGORY[d], w) for f, e in vectors.items() for d, w in e.items()], "film_id long, dim long, category string, w double")
    wanted = spark.createDataFrame([(f,) for f in vectors], "film_id long")
    return profile, vectors, p, v, wanted, spark.createDataFrame([(u,) for u in profile], "user_id long")


def cosine(a, b):
    dot = sum(x * b.get(d, 0.0) for d, x in a.items())
    return dot / math.sqrt(sum(x * x for x in a.values()) * sum(x * x for x in b.values())) if dot else 0.0


def test_all_pairs_in_small_blocks(spark, monkeypatch):
    profile, vectors, p, v, wanted, users = tables(spark)
    out = B.multiplied(B.user_lists(p, users), B.film_lists(v, wanted), B.pair_rows, B.SCORES, block=(40, 4))
    got = {(r.user_id, r.film_id): r.x for r in out.collect()}
    assert len(got) == len(profile) * len(vectors)
    assert all(abs(x - cosine(profile[u], vectors[f])) < 1e-12 for (u, f), x in got.items())


def test_scores_of_all_users_move_no_pairs(spark):
    _, _, p, v, wanted, users = tables(spark)
    plan = X.cosine_scores(p, v, wanted=wanted, users=users)._jdf.queryExecution().executedPlan().toString()
    assert "FlatMapCoGroupsInArrow" in plan and "Aggregate" not in plan


def test_ends_and_reports(spark):
    profile, vectors, p, v, wanted, users = tables(spark)
    factors = wanted.withColumn("factor", F.lit(1.0))
    ends = {}
    for r in B.best_and_worst(p, v, wanted, factors, 3, users).collect():
        ends.setdefault(r.user_id, set()).add(r.film_id)
    score = {u: {f: min(100, math.floor(cosine(a, b) * 100 + 0.5)) for f, b in vectors.items()} for u, a in profile.items()}
    for u, s in score.items():
        assert ends[u] == set(sorted(s, key=lambda f: (-s[f], f))[:3]) | set(sorted(s, key=lambda f: (s[f], f))[:3])
    want, strong = {}, {}
    for u, a in profile.items():
        for b in vectors.values():
            parts = {}
            both = sorted(((-a[d] * w, d) for d, w in b.items() if d in a))
            for x, d in both:
                parts[CATEGORY[d]] = parts.get(CATEGORY[d], 0.0) - x
            for c, x in parts.items():
                n, t = want.get((u, c), (0, 0.0))
                want[u, c] = n + 1, t + math.floor(round(x / sum(parts.values()) * 100, 6) + 0.5) / 100
            for x, d in both[:5]:
                n, t = strong.get((u, CATEGORY[d]), (0, 0.0))
                strong[u, CATEGORY[d]] = n + 1, t - x
    for function, expected in ((B.category_shares, want), (B.strongest(5), strong)):
        got = {(r.user_id, r.category): (r.n, r.x) for r in B.category_report(p, v, wanted, function).collect()}
        assert got.keys() == expected.keys()
        assert all(got[k][0] == n and abs(got[k][1] - x) < 1e-9 for k, (n, x) in expected.items())


def test_comparison_needs_only_shared_dimensions(spark):
    rows = [(1, "runtime:short", "runtime", 0.5), (1, "genre:a", "genre", 1.0), (2, "runtime:long", "runtime", 0.5), (2, "genre:b", "genre", 1.0), (3, "genre:c", "genre", 1.0), (3, "runtime:epic", "runtime", 0.5)]
    v = spark.createDataFrame(rows, "film_id long, dim string, category string, w double")
    watched = spark.createDataFrame([(7, 1, 5.0), (7, 3, 5.0)], "user_id long, film_id long, rating double")
    small = X.shared_with(v, 1, 2)
    assert {r.dim for r in small.collect()} == {"runtime:short", "runtime:long", "runtime:epic", "genre:a", "genre:b"}
    whole, part = ({(r.user_id, r.dim): (r.a, r.b, r.share_a, r.kind) for r in X.compare_items(X.user_profile(watched, x), v, 1, 2).collect()} for x in (v, small))
    assert whole == part == {(7, "runtime:short"): (0.125, None, 0.2, "only_a"), (7, "genre:a"): (0.5, None, 0.8, "only_a")}


def test_learned_scores_in_blocks(spark):
    from showgrid.operators import scorers as S
    _, _, _, v, wanted, _ = tables(spark)
    rated = spark.createDataFrame([(1, 0, 5.0), (1, 1, 2.0), (1, 2, 3.0), (2, 3, 4.0), (2, 4, 1.0), (3, 5, 4.0)], "user_id long, film_id long, rating double")
    weights = S.trained(v, rated)
    films = wanted.where("film_id < 500")  # the one without entries has no score
    pairs = rated.select("user_id").distinct().crossJoin(films)
    slow = {(r.user_id, r.film_id): r.raw for r in S.ltr_scores(weights, v, pairs).collect()}
    fast = {(r.user_id, r.film_id): r.raw for r in S.all_ltr_scores(weights, v, rated, films).collect()}
    assert slow.keys() == fast.keys() and all(abs(fast[k] - x) < 1e-12 for k, x in slow.items())
    assert {r.weight for r in weights.where("user_id = 3").collect()} == {0.01}  # no pair, nothing learned
    shares = S.all_ltr_shares(weights, v, rated, films)
    assert shares.count() == 3 * v.select("film_id", "category").distinct().count()
    assert all(abs(r.t - 1) < 1e-12 for r in shares.groupBy("user_id", "film_id").agg(F.sum("share").alias("t")).collect())


def test_universe_and_missing_pairs_move_no_pairs(spark):
    from showgrid.operators import recommend as R
    watched = spark.createDataFrame([(1, 10), (1, 11), (2, 12), (2, 30)], "user_id long, film_id long")
    screened = spark.createDataFrame([(10,), (12,), (13,), (13,)], "film_id long")
    missing = R.missing_scores(watched, screened, watched)
    assert sorted(map(tuple, missing.collect())) == [(1, 12), (1, 13), (2, 10), (2, 13)]
    every = R.universe(watched, screened)
    assert sorted(map(tuple, every.collect())) == sorted([(u, f, True) for u in (1, 2) for f in (10, 12, 13)] + [(1, 11, False), (2, 30, False)])
    for out in (missing, every):
        assert not out._jdf.queryExecution().optimizedPlan().toString().startswith(("Join", "Aggregate"))


def test_hubs_of_all_users(spark):
    from showgrid.operators import graph as G
    watched = spark.createDataFrame([(1, 10), (1, 11), (1, 14), (2, 12)], "user_id long, film_id long")
    screened = spark.createDataFrame([(10,), (12,), (13,)], "film_id long")
    links = spark.createDataFrame([(f, a, 1) for f, a in ((10, "x"), (12, "x"), (13, "x"), (11, "x"), (14, "x"), (10, "y"), (11, "y"))], "film_id long, attr string, links long")
    both = G.user_films(watched, screened)
    sizes = both.groupBy("user_id").agg(F.count(F.lit(1)).alias("films"))
    want = G.hub_links(both.join(links, "film_id"), sizes, 0.15)
    got = G.user_hubs(watched, screened, links, 0.15)
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect())) == [(1, "x", 5)]


def test_ucb_of_all_users_in_blocks_equals_pairs(spark, monkeypatch):
    """Also users without a rating, films that nobody rated, and histories of unlike length."""
    from test_recommend import WATCHED, film, films, seen
    from showgrid.operators import scorers as S
    monkeypatch.setattr(S, "UCB_BLOCK", (3, 4))
    catalogue = films(spark, *[film(i, directors=[1 + i % 3], genres=[f"g{i % 2}"] if i % 4 else [], rating=3.0 if i % 5 else None) for i in range(1, 14)])
    rows = [seen(u, 1 + (u * 5 + k) % 13, 1.0 + (u + k) % 9 / 2) for u in range(1, 8) for k in range(u)] + [seen(8, 2, None), seen(8, 3, None)]
    w, wanted = spark.createDataFrame(rows, WATCHED), spark.createDataFrame([(i,) for i in range(3, 14)], "film_id long")
    out = S.all_ucb_scores(catalogue, w, wanted)
    assert "FlatMapCoGroupsInArrow" in out._jdf.queryExecution().optimizedPlan().toString()
    pairs = w.select("user_id").distinct().crossJoin(wanted)
    named = S.ucb_scores(catalogue, w.withColumn("user_id", F.concat(F.lit("1#"), "user_id")), pairs.withColumn("user_id", F.concat(F.lit("1#"), "user_id")))
    slow = {(int(r.user_id[2:]), r.film_id): r for r in named.collect()}
    fast = {(r.user_id, r.film_id): r for r in out.collect()}
    assert slow.keys() == fast.keys() and len(fast) == 88 and fast[8, 3].raw == 50
    assert all(abs(fast[k][c] - r[c]) < 1e-9 for k, r in slow.items() for c in ("predicted", "uncertainty", "raw"))
