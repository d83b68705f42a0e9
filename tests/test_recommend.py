"""Scenario, invariant and brute-force tests of the recommenders."""

import math
from types import SimpleNamespace

import pytest
from pyspark.sql import functions as F

from showgrid import lookups
from showgrid.operators import evaluate as EV
from showgrid.operators import features as X
from showgrid.operators import graph as G
from showgrid.operators import scorers as S
from showgrid.plans.recommendations import holdout_evaluation

PEOPLE = "array<struct<id:long,name:string>>"
FILM = (f"id long, title string, genres array<string>, director string, directors {PEOPLE}, cinematographers {PEOPLE}, composers {PEOPLE}, writers {PEOPLE}, top_cast {PEOPLE}, keywords {PEOPLE}, "
        f"production_companies {PEOPLE}, country array<string>, primary_language array<string>, spoken_languages array<string>, year int, runtime_minutes int, rating double, tmdb_rating double, "
        "viewers long, collection_id long, tmdb_id long, tmdb_recommendations array<long>")
NAMES = [f.split()[0] for f in FILM.split(", ")]
WATCHED = "user_id long, film_id long, short_url string, rating double, liked boolean, watched_date date, rewatch_count int"
AS_OF = "2026-01-01 00:00:00"


def film(id_, **kw):
    row = {n: [] for n in ("genres", "directors", "cinematographers", "composers", "writers", "top_cast", "keywords", "production_companies", "country", "primary_language", "spoken_languages", "tmdb_recommendations")}
    row.update(id=id_, title=f"T{id_}", director=None, year=None, runtime_minutes=None, rating=None, tmdb_rating=None, viewers=None, collection_id=None, tmdb_id=None)
    row.update({k: [(i, str(i)) for i in v] if k in ("directors", "cinematographers", "composers", "writers", "top_cast", "keywords", "production_companies") and v and isinstance(v[0], int) else v for k, v in kw.items()})
    return tuple(row[n] for n in NAMES)


def films(spark, *rows):
    return spark.createDataFrame(list(rows), FILM)


def seen(user, film_id, rating=None, liked=False, date=None, rewatch=0, url="u"):
    return (user, film_id, url, rating, liked, date, rewatch)


def scores(spark, catalogue, watched, screened, **kw):
    w = spark.createDataFrame(watched, WATCHED)
    s = spark.createDataFrame([(i,) for i in screened], "film_id long")
    return {(r.user_id, r.film_id): r.score for r in G.score_all_users(catalogue, s, w, AS_OF, **kw).collect()}


def test_vector_rules(spark):
    v = X.film_vectors(films(spark, film(1, genres=["Drama", "drama"], directors=[7, 8], top_cast=[1, 2, 1], keywords=list(range(10, 22)), rating=4.0, tmdb_rating=6.0, year=1955, runtime_minutes=90, collection_id=3,
                                              primary_language=["English"], spoken_languages=["english", "French"]), film(2, director="Ana RUIZ")))
    got = {(r.film_id, r.dim): r.w for r in v.collect()}
    assert got[1, "genre:drama"] == pytest.approx(0.10 / 3)
    assert got[1, "director:7"] == pytest.approx(0.07)
    assert got[1, "cast:1"] == pytest.approx(0.14 / 6) and got[1, "cast:2"] == pytest.approx(0.14 * 2 / 6)
    assert got[1, "keyword:19"] == pytest.approx(0.02) and (1, "keyword:20") not in got
    assert got[1, "rating"] == pytest.approx(0.06 * 0.7) and got[1, "decade:pre-1960"] == 0.08 and got[1, "runtime:medium"] == 0.04
    assert got[1, "lang:english"] == pytest.approx(0.03) and got[1, "collection:3"] == 0.04
    assert got[2, "director:ana ruiz"] == pytest.approx(0.14) and got[2, "decade:unknown"] == 0.08
    cov = {r.film_id: r.coverage for r in X.feature_coverage(v).collect()}
    assert cov[2] == pytest.approx(0.14 / 0.96) and cov[1] <= 1


def test_content_scorer_prefers_shared_director(spark):
    catalogue = films(spark, film(1, directors=[5], genres=["Drama"]), film(2, directors=[5], genres=["Drama"]), film(3, directors=[6], genres=["Drama"]), film(4))
    w = spark.createDataFrame([seen(1, 1, 5.0)], WATCHED)
    pairs = spark.createDataFrame([(1, 2), (1, 3), (1, 4)], "user_id long, film_id long")
    raw = {r.film_id: r.raw for r in S.content_scorer(catalogue, w, pairs).collect()}
    assert raw[2] > raw[3] > raw[4] >= 0


def dense_pagerank(catalogue_rows, watched, iterations, fraction=0.30):
    """Plain dictionary version for one user over ``(film, [(attr, category, w)])``."""
    adj = {}
    def add(a, b, w):
        adj.setdefault(a, []).append((b, w)); adj.setdefault(b, []).append((a, w))
    for f, links in catalogue_rows.items():
        adj.setdefault(f, [])
        for attr, _, w in links:
            add(f, attr, w)
    category = {a: c for links in catalogue_rows.values() for a, c, _ in links}
    for a, c in category.items():
        if c in lookups.PRUNABLE_CATEGORIES and len(adj[a]) > max(3, int(len(catalogue_rows) * fraction)):
            for f, _ in list(adj[a]):
                adj[f] = [(n, w) for n, w in adj[f] if n != a]
            adj[a] = []
    total = sum(watched.values())
    restart = {f: w / total for f, w in watched.items()}
    alpha = 0.10 + 0.15 * math.exp(-len(watched) / 200)
    p = dict(restart)
    for _ in range(iterations):
        nxt = {f: alpha * r for f, r in restart.items()}
        for n, mass in p.items():
            out = sum(w for _, w in adj[n])
            for m, w in adj[n]:
                nxt[m] = nxt.get(m, 0) + (1 - alpha) * mass * w / out
        p = nxt
    return p


def test_pagerank_matches_plain_loops(spark):
    rows = [film(i, genres=["Drama"] if i % 2 else ["Noir", "Drama"], directors=[100 + i % 3], top_cast=[200 + i % 4, 300 + i % 5], keywords=[400 + i % 3], country=["ES"], year=1990 + i, primary_language=["es"]) for i in range(1, 13)]
    catalogue = films(spark, *rows)
    edges = {}
    for r in G.film_attribute_edges(catalogue).collect():
        edges.setdefault(r.film_id, []).append((r.attr, r.category, r.w))
    watched = spark.createDataFrame([seen(1, 1, 5.0), seen(1, 2, 4.0), seen(1, 3, 2.0), seen(2, 4, 3.5), seen(2, 5, 5.0), seen(2, 7, 4.0)], WATCHED)
    screened = spark.createDataFrame([(i,) for i in range(6, 13)], "film_id long")
    seeds = G.seed_weights(watched, AS_OF)
    ranking = G.rank_all_users(catalogue, screened, watched, AS_OF)
    rank = G.film_ranks(ranking)
    alone = G.rank_all_users(catalogue, screened, watched, AS_OF, candidates=G.user_candidates(watched, screened), lanes=1)
    assert sorted(map(repr, rank.withColumn("raw", F.round("raw", 12)).collect())) == sorted(map(repr, G.film_ranks(alone).withColumn("raw", F.round("raw", 12)).collect()))
    for user, own in ((1, {1, 2, 3}), (2, {4, 5, 7})):
        weights = {r.film_id: r.weight for r in seeds.where(F.col("user_id") == user).collect()}
        universe = {f: edges[f] for f in own | set(range(6, 13))}
        alpha_count = {f: w for f, w in weights.items() if w > 0}
        p = dense_pagerank_with_alpha(universe, alpha_count, len(own))
        got = {r.film_id: (r.raw, r.watched) for r in rank.where(F.col("user_id") == user).collect()}
        assert set(got) == set(range(6, 13))
        for f in got:
            assert got[f] == (pytest.approx(p.get(f, 0.0), abs=1e-12), f in own)


def dense_pagerank_with_alpha(universe, weights, n_watched):
    pad = {("pad", i): 0.0 for i in range(n_watched - len(weights))}
    return dense_pagerank({**universe, **{k: [] for k in pad}}, {**weights, **pad}, 25, fraction=0.30 * len(universe) / (len(universe) + len(pad)))


def test_hubs_in_slots_change_nothing(spark, monkeypatch):
    """A node with more edges than a slot holds is dealt over several; no task meets all its edges."""
    catalogue = films(spark, *[film(i, directors=[5 + i % 2], genres=["x"], country=["ES"]) for i in range(1, 25)])
    watched, screened = spark.createDataFrame([seen(u, u + k, 4.0 + k / 2) for u in (1, 2, 3) for k in (0, 1)], WATCHED), spark.createDataFrame([(i,) for i in range(4, 25)], "film_id long")
    ranks = lambda: sorted(map(repr, G.film_ranks(G.rank_all_users(catalogue, screened, watched, AS_OF, 6, lanes=2)).withColumn("raw", F.round("raw", 12)).collect()))
    whole = ranks()
    monkeypatch.setattr(G, "SLOT_EDGES", 3)
    assert ranks() == whole
    edges, slots = G.slotted(G.build_graph(catalogue, screened).edges.select(F.col("attr").alias("src"), F.col("film_id").alias("dst"), "w"))
    assert edges.groupBy("src", "slot").count().agg(F.max("count")).first()[0] < 24 and slots.agg(F.max("slots")).first()[0] == 8


def test_graph_scenarios(spark):
    base = [film(1, directors=[5]), film(2, directors=[5]), film(3, directors=[6]), film(4, directors=[6]), film(5, directors=[7], year=1971)]
    catalogue = films(spark, *base)
    got = scores(spark, catalogue, [seen(1, 1, 5.0), seen(2, 1, 2.0), seen(3, 1, 5.0), seen(3, 3, 3.0), seen(4, 3, None, liked=True), seen(4, 1, 3.0)], [2, 4, 5])
    assert got[1, 2] == 95 and got[1, 2] > got[1, 4]
    assert got[2, 2] == got[2, 4] == got[2, 5] == 0
    assert got[3, 2] > got[3, 4]
    assert got[4, 4] > got[4, 2]
    assert all(5 <= v <= 95 for (u, f), v in got.items() if u != 2)


def test_incremental_equals_full(spark):
    catalogue = films(spark, *[film(i, directors=[i % 3 + 1], genres=[f"g{i % 2}"]) for i in range(1, 9)])
    watched = [seen(1, 1, 5.0), seen(1, 2, 4.0), seen(2, 3, 4.5)]
    full = scores(spark, catalogue, watched, [4, 5, 6, 7, 8])
    done = spark.createDataFrame([(1, 4), (1, 5), (2, 8)], "user_id long, film_id long")
    part = scores(spark, catalogue, watched, [4, 5, 6, 7, 8], stored=done)
    assert set(part) == set(full) - {(1, 4), (1, 5), (2, 8)} and all(full[k] == v for k, v in part.items())


def test_similar_watched_and_breakdown(spark):
    catalogue = films(spark, *[film(i, directors=[50 + i // 2], top_cast=[70 + i // 3], genres=["x"]) for i in range(2, 40)])
    watched = spark.createDataFrame([seen(1, i, 4.0) for i in range(2, 40, 2)], WATCHED)
    screened = spark.createDataFrame([(3,), (9,)], "film_id long")
    rank = G.rank_all_users(catalogue, screened, watched, AS_OF)
    best = {(r.film_id, r.position): r.similar_id for r in G.similar_watched(rank).collect()}
    assert best[3, 1] in (2, 4) and {best[9, 1], best[9, 2]} == {8, 10}
    shares = G.graph_breakdown(rank).collect()
    assert all(sum(r.by_category.values()) == pytest.approx(1) for r in shares)
    rows = G.score_all_users(catalogue, screened, watched, AS_OF, explain=True).collect()
    assert {(r.film_id, s.position): s.similar_id for r in rows for s in r.similar} == best
    assert all(s.attr_category in ("director", "cast") and s.attr_name.startswith(s.attr_category) for r in rows for s in r.similar)


def test_preference_pairs(spark):
    data = [(1, i, [1.0, 2.5, 4.0, 5.0][i % 4]) for i in range(40)] + [(2, i, [1.0, 5.0, 3.0][i % 3]) for i in range(300)]
    rated = spark.createDataFrame(data, "user_id long, film_id long, rating double")
    rating = {(u, f): r for u, f, r in data}
    pairs = [tuple(r) for r in S.preference_pairs(rated, limit=3000).collect()]
    one = [p for p in pairs if p[0] == 1]
    assert len(one) == len(set(one)) == 600
    two = [p for p in pairs if p[0] == 2]
    assert len(two) == len(set(two)) == 3000
    assert all(rating[u, a] > rating[u, b] for u, a, b in pairs)


def test_ltr_orders_training_pairs(spark):
    catalogue = films(spark, *[film(i, directors=[1 + i % 2], genres=[f"g{i % 5}"]) for i in range(1, 31)])
    rated = spark.createDataFrame([(1, i, 5.0 if i % 2 else 2.0) for i in range(1, 31)], "user_id long, film_id long, rating double")
    vectors = X.film_vectors(catalogue)
    weights = S.pairwise_ltr(vectors, rated)
    raw = {r.film_id: r.raw for r in S.ltr_scores(weights, vectors, rated.select("user_id", "film_id")).collect()}
    assert min(raw[i] for i in raw if i % 2) > max(raw[i] for i in raw if i % 2 == 0)


def test_ucb_against_loops(spark):
    catalogue = films(spark, *[film(i, directors=[1 + i % 3], genres=[f"g{i % 2}"], rating=3.0) for i in range(1, 9)])
    vec = {}
    for r in X.film_vectors(catalogue).collect():
        vec.setdefault(r.film_id, {})[r.dim] = r.w
    def sim(a, b):
        dot = sum(w * vec[b].get(d, 0) for d, w in vec[a].items())
        return dot / math.sqrt(sum(w * w for w in vec[a].values())) / math.sqrt(sum(w * w for w in vec[b].values()))
    w = spark.createDataFrame([seen(1, 1, 5.0), seen(1, 2, 2.0), seen(1, 3, None)], WATCHED)
    pairs = spark.createDataFrame([(1, i) for i in range(4, 9)] + [(9, 4)], "user_id long, film_id long")
    got = {(r.user_id, r.film_id): r.raw for r in S.ucb_scores(catalogue, w, pairs).collect()}
    for f in range(4, 9):
        s = [(sim(f, 1), 5.0), (sim(f, 2), 2.0)]
        t = sum(x for x, _ in s)
        want = (sum(x * r for x, r in s) / t + 0.8 / math.sqrt(1 + t * t / (sum(x * x for x, _ in s) + 1e-10)) - 1) / 5 * 100
        assert got[1, f] == pytest.approx(want)
    assert got[9, 4] == 50


def test_metrics(spark):
    df = spark.createDataFrame([(1, 10, 0.9, 5.0), (1, 11, 0.8, 4.0), (1, 12, 0.1, 1.0), (2, 10, 0.1, 5.0), (2, 11, 0.9, 1.0)], "user_id long, film_id long, raw double, rating double")
    got = {r.user_id: r for r in EV.ranking_metrics(df, ["user_id"]).collect()}
    assert got[1].spearman == 1.0 and got[1].p5 == pytest.approx(2 / 3) and got[2].spearman == 0.0


def test_holdout_is_disjoint_and_sized(spark):
    rated = spark.createDataFrame([(u, f, 3.0) for u in (1, 2) for f in range(10 * u + 3)], "user_id long, film_id long, rating double")
    got = {(r.split, r.user_id): (r.n, r.t) for r in EV.holdout_split(rated, 3).groupBy("split", "user_id").agg(F.count("*").alias("n"), F.count_if("is_test").alias("t")).collect()}
    assert got == {(s, u): (10 * u + 3, 10 * u + 3 - int((10 * u + 3) * 0.8)) for s in (1, 2, 3) for u in (1, 2)}


def test_holdout_evaluation_has_a_row_of_every_scorer(spark):
    catalogue = films(spark, *[film(i, directors=[1 + i % 2], genres=[f"g{i % 3}"], country=["ES"], year=1990 + i, rating=3.0) for i in range(1, 21)])
    watched = spark.createDataFrame([seen(1, i, 5.0 if i % 2 else 2.0) for i in range(1, 21)], WATCHED)
    got = {r.scorer: r for r in holdout_evaluation(SimpleNamespace(films=catalogue, watched=watched)).collect()}
    assert set(got) == {"content", "tfidf", "pagerank", "ltr", "ucb"} and all(r.cases == 5 for r in got.values())
    assert got["ltr"].spearman > 0.5


def test_walks_in_tasks_equal_joins(spark, monkeypatch):
    """Ranks, scores, shares and similar films of tasks that hold the graph against the joins that deal it; no pair of user and film is shuffled by the walks."""
    from showgrid.operators import walks
    monkeypatch.setattr(walks, "LANES", 2)
    monkeypatch.setattr(walks, "USERS", 3)
    monkeypatch.setattr(walks, "HUB", 4)
    catalogue = films(spark, *[film(i, genres=["Drama"] if i % 3 else ["Noir", "Drama"], directors=[100 + i % 5], top_cast=[200 + i % 7, 300 + i % 8], keywords=[400 + i % 6], country=["ES"], year=1950 + 3 * i,
                                    tmdb_id=900 + i, tmdb_recommendations=[901 + i, 905 + i]) for i in range(1, 31)] + [film(31)])
    rows = [seen(u, 1 + (u * 7 + 3 * k) % 30, [5.0, 4.0, 2.0, None][k % 4], liked=k % 2 == 0) for u in range(1, 8) for k in range(u)] + [seen(8, 2, 1.0)]
    watched, screened = spark.createDataFrame(rows, WATCHED), spark.createDataFrame([(i,) for i in range(10, 32)], "film_id long")
    stored = spark.createDataFrame([(1, 12), (3, 31), (3, 10), (9, 10), (2, 99)], "user_id long, film_id long")

    def results():
        ranking = G.rank_all_users(catalogue, screened, watched, AS_OF)
        near = lambda rows: {tuple(v for v in r if not isinstance(v, float)): [v for v in r if isinstance(v, float)] for r in rows}
        return type(ranking).__name__, [near(rows.collect()) for rows in (
            G.film_ranks(ranking), G.category_shares(ranking), G.similar_watched(ranking), G.score_all_users(catalogue, screened, watched, AS_OF, stored=stored).select("user_id", "film_id", "score"))]

    kind, fast = results()
    monkeypatch.setattr(walks, "MOST_LINKS", 0)
    other, slow = results()
    assert (kind, other) == ("Walks", "Ranking")
    for a, b in zip(fast, slow):
        assert a.keys() == b.keys() and a and all(v == pytest.approx(b[k], abs=1e-12) for k, v in a.items())


def test_graphs_of_candidates_in_tasks_equal_joins(spark, monkeypatch):
    """Hold-out scores: each user's graph holds the films watched and the candidates; text ids of users, a candidate unknown to the catalogue, a user without training rows."""
    from showgrid.operators import walks
    catalogue = films(spark, *[film(i, genres=["Drama"] if i % 3 else ["Noir", "Drama"], directors=[100 + i % 5], keywords=[400 + i % 6], country=["ES"], year=1950 + 3 * i,
                                    tmdb_id=900 + i, tmdb_recommendations=[901 + i, 905 + i]) for i in range(1, 21)] + [film(21)])
    rows = [(f"1#{r[0]}", *r[1:]) for r in (seen(u, 1 + (u * 7 + 3 * k) % 20, [5.0, 4.0, 2.0, None][k % 4]) for u in range(1, 7) for k in range(u + 2))] + [("1#9", 2, "u", 1.0, False, None, 0)]
    watched = spark.createDataFrame(rows, WATCHED.replace("user_id long", "user_id string"))
    pairs = spark.createDataFrame([(f"1#{u}", f) for u in (1, 2, 3, 4, 5, 6, 9, 10) for f in range(u, u + 13)] + [("1#1", 77)], "user_id string, film_id long")
    fast = {(r.user_id, r.film_id): r.raw for r in S.pagerank_scorer(catalogue, watched, pairs, AS_OF).collect()}
    monkeypatch.setattr(walks, "MOST_LINKS", 0)
    slow = {(r.user_id, r.film_id): r.raw for r in S.pagerank_scorer(catalogue, watched, pairs, AS_OF).collect()}
    assert fast.keys() == slow.keys() and fast and all(v == pytest.approx(slow[k], abs=1e-12) for k, v in fast.items())


def test_holdout_split_is_one_sort_and_one_join(spark):
    """The split against a plain loop over hashes; positions are not looked up a second time for the sizes."""
    import hashlib
    rated = spark.createDataFrame([(u, f, 3.0) for u in (1, 2, 3) for f in range(5 * u)], "user_id long, film_id long, rating double")
    out = EV.holdout_split(rated, 2)
    want = set()
    for s in (1, 2):
        for u in (1, 2, 3):
            order = sorted(range(5 * u), key=lambda f: (hashlib.md5(f"{s}|{u}|{f}".encode()).hexdigest(), f))
            want |= {(s, u, f, i + 1 > int(5 * u * 0.8)) for i, f in enumerate(order)}
    assert {(r.split, r.user_id, r.film_id, r.is_test) for r in out.collect()} == want
    assert out._jdf.queryExecution().optimizedPlan().toString().count("Join Inner") == 3  # two of them add the offsets of partitions
