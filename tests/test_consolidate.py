"""Merging, upserts, incremental ingest and archive on small listings."""

import datetime as dt
import random

from pyspark.sql import functions as F

from showgrid.operators import consolidate as C
from showgrid.operators import matching as J
from showgrid.sources import readers as R
from showgrid.sources.writers import VersionedTable
from showgrid.util import global_rank, rank_within

ENTRY = "seq long, theater string, title string, theater_film_link string, director string, year int, film_url string, timestamp string, location string, url_tickets string, url_info string, version string"


def entry(seq, title, ts, link="", director=None, year=None, url=None, place="A", tickets="", info="", version=None):
    return (seq, place, title, link, director, year, url, ts, place, tickets, info, version)


def rows(df, *cols):
    return sorted((tuple(r) for r in df.select(*cols).collect()), key=repr)


def test_dates_cell_shapes(spark):
    cells = ['[{"timestamp": "2026-01-01 10:00", "location": "A", "url": "t"}]', "[{'timestamp': '2026-01-01 10:00', 'location': None, 'special': 'event'}]",
             "['2026-01-01 10:00', '2026-01-02 11:00']", "bad {2026-01-03 12:00} x", "", None, "nothing", "[{'timestamp': '2026-01-01 10:00', 'location': 'it None'}]"]
    df = spark.createDataFrame([(i, c) for i, c in enumerate(cells)], "i int, c string").select("i", R.parse_dates_cell(F.col("c")).alias("d"))
    got = {r.i: [(s.timestamp, s.location, s.url_tickets, s.special) for s in r.d] for r in df.collect()}
    assert got[0] == [("2026-01-01 10:00", "A", "t", None)]
    assert got[1] == [("2026-01-01 10:00", None, "", "event")]
    assert [g[0] for g in got[2]] == ["2026-01-01 10:00", "2026-01-02 11:00"]
    assert [g[0] for g in got[3]] == ["2026-01-03 12:00"]
    assert got[4] == got[5] == got[6] == []
    assert got[7] == [("2026-01-01 10:00", "it None", "", None)]


def test_merge_by_link_first_wins_and_ignores_order(spark):
    data = [entry(1, "Uno", "2026-01-01 10:00", "x/1", "Ana"), entry(2, "Uno bis", "2026-01-01 10:00", "x/1", version="VOSE"), entry(3, "Uno", "2026-01-02 10:00", "x/1"),
            entry(4, "Dos", "2026-01-01 10:00", ""), entry(5, "Dos", "2026-01-01 10:00", " ")]
    results = []
    for _ in range(3):
        random.shuffle(data)
        m = C.merge_by_link(spark.createDataFrame(data, ENTRY).repartition(3), ["title", "director"], ["timestamp", "location", "version"])
        results.append((rows(m.films, "film_key", "title", "director"), rows(m.sessions, "film_key", "timestamp", "version")))
    assert results[0] == results[1] == results[2]
    films, sessions = results[0]
    assert ("x/1", "Uno", "Ana") in films and len(films) == 3
    assert ("x/1", "2026-01-01 10:00", None) in sessions and len(sessions) == 4


def test_identity_keeps_null_apart_from_empty(spark):
    df = spark.createDataFrame([entry(1, "T", "2026-01-01 10:00", director=None), entry(2, "T", "2026-01-01 10:00", director=""), entry(3, "T", "2026-01-01 10:00", director=None)], ENTRY)
    m = C.merge_by_identity(df, ["title", "director", "year"], ["title"], ["timestamp", "location"])
    assert m.films.count() == 2


def test_url_or_title_links_chains(spark):
    df = spark.createDataFrame([entry(1, "A", "2026-01-01 10:00", url="u1"), entry(2, "A", "2026-01-01 11:00", url="u2"), entry(3, "B", "2026-01-01 12:00", url="u2"),
                                entry(4, "C", "2026-01-01 13:00"), entry(5, None, "2026-01-01 14:00"), entry(6, "C", "2026-01-01 15:00", url="u9")], ENTRY)
    got = {r.seq: r.film_key.seq for r in C.merge_by_url_or_title(df).collect()}
    assert got == {1: 1, 2: 1, 3: 1, 4: 4, 5: 5, 6: 4}


def test_regroup_takes_first_non_empty(spark):
    df = spark.createDataFrame([entry(1, "Vidas", "2026-01-01 10:00"), entry(2, "Crash!", "2026-01-01 10:00", director="Paul", year=2004), entry(3, "Crash!", "2026-01-02 10:00", director="Otro")], ENTRY)
    table = spark.createDataFrame([("Vidas", None, "Vidas cruzadas", "Crash", "", ""), ("Crash!", "Paul", "Crash", "Crash", "Paul Haggis", "event"), ("Crash!", "Otro", "Crash", "Crash", "", "")],
                                  "title string, director string, std_title string, title_en string, std_director string, std_special string")
    m = C.regroup_by_canonical_title(df, table)
    assert rows(m.films, "film_key", "title_raw", "title", "director", "year", "special") == [("Crash", "Vidas", "Vidas cruzadas", "Paul Haggis", 2004, "event")]
    assert m.sessions.count() == 2


STORED = "film_id long, showtime timestamp_ntz, location string, seq long, url_tickets string, url_info string, version string, special string"


def test_known_sessions(spark):
    import datetime as dt

    stored = spark.createDataFrame([(1, dt.datetime(2026, 1, 1, 10), "A", 1, "t1", "i1", None, None), (1, dt.datetime(2026, 1, 1, 12), "A", 2, "", "i2", None, None),
                                    (1, dt.datetime(2025, 1, 1, 12), "A", 3, "old", "", None, None)], STORED)
    scraped = [entry(1, "a", "2026-01-01 10:00", tickets="t1", info="new"), entry(2, "a", "2026-01-01 11:00", tickets="t1"), entry(3, "b", "2026-01-01 12:00", info="i2"),
               entry(4, "b", "2026-01-01 12:00", info="i1"), entry(5, "c", "2026-01-01 12:00"), entry(6, "d", "2025-01-01 12:00", tickets="old")]
    df = spark.createDataFrame(scraped, ENTRY)
    kept = C.drop_known_sessions(df, stored, "2026-01-01", "2026-01-31")
    assert [r.seq for r in kept.orderBy("seq").collect()] == [2, 4, 5, 6]
    assert C.drop_known_sessions(df, stored.limit(0), "2026-01-01", "2026-01-31").count() == 6


FILM = "id long, short_url string, title string, director string, year int, updated_at timestamp_ntz"


def test_upsert_films_is_null_preserving_and_repeatable(spark):
    stored = spark.createDataFrame([(1, "b/1", "Uno", "Ana", 1999, None), (2, None, "Dos", None, None, None), (3, None, "Dos", None, None, None)], FILM)
    new = spark.createDataFrame([(1, "b/1", None, "Eva", None), (2, "b/1", "Uno!", None, None), (3, "b/9", "Nueve", None, 2000), (4, None, "dos ", None, None), (5, None, "Tres", None, None)],
                                "seq long, short_url string, title string, director string, year int")
    once = C.upsert_films(stored, new, "2026-01-01 00:00:00")
    assert rows(once, "id", "short_url", "title", "director", "year") == sorted([
        (1, "b/1", "Uno!", "Eva", 1999), (2, None, "dos ", None, None), (3, None, "Dos", None, None), (None, "b/9", "Nueve", None, 2000), (None, None, "Tres", None, None)], key=repr)
    numbered = once.withColumn("id", F.coalesce("id", F.xxhash64("short_url", "title")))
    twice = C.upsert_films(numbered, new, "2026-01-02 00:00:00")
    assert twice.count() == once.count()
    assert C.upsert_films(stored, new, "2026-01-01 00:00:00", fallback_key=False).count() == 6


def test_archive(spark):
    flat = "title string, director string, year int, short_url string, timestamp string, location string, seq long"
    live = spark.createDataFrame([("A", "x", 1, "b/1", "2026-01-05 10:00", "P", 1), ("A", "x", 1, "b/1", "2026-02-05 10:00", "P", 2), ("B", None, None, None, "2026-01-06 10:00", "P", 3),
                                  ("C", None, 2, "b/3", "someday", "P", 4), ("D ", "Y", 5, "b/4", "2026-01-07 10:00", "P", 5)], flat)
    history = spark.createDataFrame([("A", "x", 1, "b/1", "2026-01-05 10:00", "P", 9), ("d", "y", 5, None, "2020-01-01 10:00", "P", 8)], flat)
    out = C.archive_partition(live, history, "2026-01-01", "2026-01-31")
    assert rows(out.live, "seq") == [(2,), (4,)]
    assert rows(out.history, "seq", "timestamp") == [(3, "2026-01-06 10:00"), (5, "2026-01-07 10:00"), (8, "2020-01-01 10:00"), (9, "2026-01-05 10:00")]
    c = out.counters.first().asDict()
    assert c == {"sessions_archived": 3, "sessions_kept": 1, "films_fully_moved": 2, "films_partially_moved": 1, "films_untouched": 1, "live_films_after": 2, "history_films_after": 3}


def test_session_rows_do_not_depend_on_length(spark):
    start = dt.datetime(2026, 1, 1)
    data = [(1, start + dt.timedelta(hours=i), f"V{i % 2}", i, "", f"i{i}" if i > 2 else "", None, None) for i in range(500)] + [(2, start, "B", 1, "", "i", None, None), (4, start, "Unknown", 1, "", "", None, None)]
    films = spark.createDataFrame([(1, "Uno"), (2, "Dos"), (3, ""), (4, "Tres")], "id long, title string")
    got = C.nest_sessions(films, spark.createDataFrame(data, STORED))
    assert {(r.theater, r.theater_link) for r in got.where("id = 1").collect()} == {("V0, V1", "i3")}
    assert [r.position for r in got.where("id = 1").orderBy("showtime").collect()] == list(range(1, 501))
    assert [(r.id, r.theater, r.theater_link, r.position) for r in got.where("id > 1").orderBy("id").collect()] == [(2, "B", "i", 1), (4, "Unknown", "", 1)]


def test_long_chain_of_links(spark):
    rows = [(i, f"t{(i + 1) // 2}", f"u{i // 2}") for i in range(130)]
    spark.sparkContext.setLogLevel("ERROR")
    out = C.merge_by_url_or_title(spark.createDataFrame(rows, "seq long, title string, film_url string"))
    assert out.select("film_key").distinct().count() == 1


def test_snapshot_holds_all_users(spark):
    from showgrid.operators.feedback import user_snapshot

    prefs = spark.createDataFrame([(1, "en", True, False), (2, None, None, None)], "user_id long, lang string, watchlist_active boolean, watched_active boolean")
    lists = spark.createDataFrame([(1, "b/1"), (1, "b/1"), (3, "b/2")], "user_id long, short_url string")
    none = spark.createDataFrame([], "user_id long, film_id long, score int")
    got = {(r.user_id, r.kind, r.item, r.lang) for r in user_snapshot(prefs, lists, lists.limit(0), none).collect()}
    assert got == {(1, "watched", "b/1", "en"), (2, None, None, "es"), (3, "watched", "b/2", "es")}


def test_ranks_match_windows(spark):
    df = spark.range(5000).select((F.col("id") % 7).alias("g"), (F.col("id") % 11).alias("v"), "id").withColumn("g", F.when(F.col("id") % 3 == 0, F.lit(0)).otherwise(F.col("g")))
    got = rank_within(df, ["g"], [F.col("v").desc(), F.col("id")], partitions=6)
    from pyspark.sql import Window as W
    check = got.withColumn("w", F.row_number().over(W.partitionBy("g").orderBy(F.col("v").desc(), "id")))
    assert check.where("rank <> w").count() == 0 and got.count() == 5000
    whole = global_rank(df, [F.col("v"), F.col("id")], partitions=5)
    assert whole.agg(F.min("rank"), F.max("rank"), F.countDistinct("rank")).first() == (1, 5000, 5000)


def test_match_cascade_order(spark):
    films = spark.createDataFrame([(1, "Uno", "u/1"), (2, "Dos", "u/2"), (3, "Dos", "u/3"), (4, "Cuatro", None)], "id long, title string, film_url string")
    import datetime as dt
    stored = spark.createDataFrame([(1, dt.datetime(2026, 1, 1), "A", 5, "", "i/1", None, None), (2, dt.datetime(2026, 1, 1), "A", 1, "", "i/1", None, None), (4, dt.datetime(2026, 1, 1), "A", 1, "", "i/4", None, None)], STORED)
    entries = spark.createDataFrame([("a", ["", "i/1"], "Dos", "Uno", None, None), ("b", ["i/4"], "Dos", "Uno", None, None), ("c", [], None, "Uno", None, None), ("d", [], None, "Nada", None, None),
                                     ("e", ["i/1"], None, "Uno", None, "event"), ("f", ["i/1"], None, "Uno", "u/x", None)],
                                    "entry_id string, links array<string>, title_en string, title string, film_url string, special string")
    got = {r.entry_id: (r.matched_url, r.strategy) for r in J.match_cascade(entries, films, stored).collect()}
    assert got == {"a": ("u/2", "link"), "b": ("u/3", "title_en"), "c": ("u/1", "title"), "d": (None, None), "e": (None, None), "f": (None, None)}


def test_versioned_table(spark, tmp_path):
    table = VersionedTable(spark, str(tmp_path / "t"))
    assert table.read("a long").count() == 0
    table.write(spark.range(3).toDF("a"), tag="b0")
    table.write(spark.range(9).toDF("a"), tag="b0")
    assert table.read().count() == 3
    table.write(table.read().unionByName(spark.range(2).toDF("a")), tag="b1")
    assert table.read().count() == 5
