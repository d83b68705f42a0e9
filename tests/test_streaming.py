"""Queue state rules, lease timers, and streams fed in several files against one batch."""

import datetime as dt

import pandas as pd
from pyspark.sql import functions as F

from showgrid.operators import consolidate as C
from showgrid.operators import extract as E
from showgrid.operators import serving as V
from showgrid.plans.streams import listing_day
from showgrid.sources.writers import BucketedTable, VersionedTable
from showgrid.streaming import jobs as J

T0 = pd.Timestamp("2026-01-01 10:00:00")


def at(minutes):
    return T0 + pd.Timedelta(minutes=minutes)


def test_transitions():
    assert J.next_state(None, 0, None, "request", at(0)) == ("pending", 0, None)
    assert J.next_state("pending", 0, None, "take", at(1)) == ("processing", 0, at(1))
    assert J.next_state("processing", 3, at(1), "fail", at(2)) == ("pending", 4, None)
    assert J.next_state("processing", 4, at(1), "fail", at(2)) == ("failed", 5, None)
    assert J.next_state("processing", 0, at(1), "ok", at(7)) is None
    assert J.next_state("processing", 0, at(1), "take", at(7)) == ("processing", 0, at(7))
    assert J.next_state("pending", 5, None, "take", at(1)) is None
    assert J.next_state("failed", 5, None, "request", at(1)) == ("failed", 5, None)


def test_transitions_in_microseconds():
    minute = 60_000_000
    assert J.next_state("processing", 0, minute, "ok", 7 * minute, J.LEASE_US) is None
    assert J.next_state("processing", 0, minute, "take", 7 * minute, J.LEASE_US) == ("processing", 0, 7 * minute)
    assert J.in_order([3.0, float("nan"), 1.0, 1.0, 1.0], [1, 2, 9, 4, None], ["ok", "ok", "take", None, "fail"]) == [(1, None), (1, "take"), (1, "fail"), (3, "ok")]
    assert J.QueueEntry.due_ms(minute) == 6 * 60_000 + 1


EVENT = "short_url string, event_id long, at timestamp, action string"


def drain_queue(spark, folder, batches, **options):
    """Transitions after each file, the stream started anew on the same checkpoint for every file."""
    src, table = folder / "in", VersionedTable(spark, str(folder / "t"))

    def write(batch, batch_id):
        table.write(table.read(J.CHANGE).unionByName(batch), tag=str(batch_id))

    for rows in batches:
        spark.createDataFrame([(u, e, a.to_pydatetime(), x) for u, e, a, x in rows], EVENT).coalesce(1).write.mode("append").parquet(str(src))
        stream = J.queue_stream_state(spark.readStream.schema(EVENT).parquet(str(src)), **options)
        J.start_queue(stream, write, str(folder / "cp")).awaitTermination()
        yield [(r.short_url, r.status, r.retry_count, r.cause) for r in table.read().orderBy("at", "short_url").collect()]


def test_stream_state_with_lease(spark, tmp_path):
    now = pd.Timestamp.now("UTC").tz_localize(None).floor("s")
    batches = [[("b", 5, at(3), "ok"), ("a", 2, at(1), "take"), ("b", 3, at(1), "request"), ("a", 1, at(0), "request"), ("b", 4, at(2), "take")],
               [("c", 6, now, "request"), ("c", 7, now, "take"), ("a", 8, at(9), "take"), ("a", 9, at(10), "fail")], [("c", 10, now, "ok"), ("d", 11, at(0), "ok")]]
    one, two, three = drain_queue(spark, tmp_path, batches)
    assert one == [("a", "pending", 0, "request"), ("a", "processing", 0, "take"), ("b", "pending", 0, "request"), ("b", "processing", 0, "take"), ("b", "done", 0, "ok"),
                   ("a", "pending", 0, "lease expired")]
    assert sorted(two) == sorted(one + [("a", "processing", 0, "take"), ("a", "pending", 1, "fail"), ("c", "pending", 0, "request"), ("c", "processing", 0, "take")])
    assert sorted(three) == sorted(two + [("c", "done", 0, "ok")])  # a lease that still runs is no timer yet, and the state outlives the restart


def test_stream_state_forgets(spark, tmp_path):
    again = [[("a", 1, at(0), "request")], [("a", 2, at(1), "request")]]
    assert [len(r) for r in drain_queue(spark, tmp_path / "kept", again)] == [1, 1]
    assert [len(r) for r in drain_queue(spark, tmp_path / "short", again, keep_days=2e-8)] == [1, 2]


SESSION = J.SCREENING_SCHEMA + ", seen_at timestamp"


def test_ingest_stream_in_files_equals_batch(spark, tmp_path):
    start = dt.datetime(2026, 1, 1, 10)
    rows = [(f % 3, start + dt.timedelta(hours=f % 10), f"V{f % 2}", f, f"t{f % 10}" if f % 4 else "", f"i{f % 7}", None, None, start) for f in range(60)]
    src, table = str(tmp_path / "in"), VersionedTable(spark, str(tmp_path / "t"))
    for part in range(3):
        spark.createDataFrame(rows[part * 20:(part + 1) * 20], SESSION).coalesce(1).write.mode("append").parquet(src)
        stream = spark.readStream.schema(SESSION).parquet(src)
        J.stream_ingest_sessions(stream, table, str(tmp_path / "cp"), "2026-01-01", "2026-01-31").awaitTermination()
    want = spark.createDataFrame([], J.SCREENING_SCHEMA)
    for part in range(3):  # the batch operators, one batch after the other
        batch = spark.createDataFrame(rows[part * 20:(part + 1) * 20], SESSION).drop("seen_at").withColumn("timestamp", F.date_format("showtime", "yyyy-MM-dd HH:mm"))
        new = C.drop_known_sessions(batch, want, "2026-01-01", "2026-01-31").select(*want.columns)
        want = spark.createDataFrame(C.upsert_screenings(want, new).select(*want.columns).collect(), J.SCREENING_SCHEMA)
    assert sorted(map(repr, table.read().select(*want.columns).collect())) == sorted(map(repr, want.collect()))


def test_changed_listing_replaces_the_stored_one(spark, tmp_path):
    when = dt.datetime(2026, 1, 5, 20)
    src, table = str(tmp_path / "in"), VersionedTable(spark, str(tmp_path / "t"))
    for ticket, version in (("old", None), ("new", "VOSE")):
        spark.createDataFrame([(1, when, "A", 1, ticket, "", version, None, when)], SESSION).coalesce(1).write.mode("append").parquet(src)
        J.stream_ingest_sessions(spark.readStream.schema(SESSION).parquet(src), table, str(tmp_path / "cp"), "2026-01-01", "2026-01-31").awaitTermination()
    assert [(r.url_tickets, r.version) for r in table.read().collect()] == [("new", "VOSE")]


def test_coverage_and_cliff_in_files_equal_batch(spark, tmp_path):
    """After each file, with days that come late and a batch that comes again, the stream equals the batch job."""
    start = dt.datetime(2026, 1, 1, 10)
    rows = [(start + dt.timedelta(hours=5 * i), f"V{i % 3}", "event" if i % 4 == 0 else None) for i in range(90)] + [(start + dt.timedelta(days=30 + i), "V1", None) for i in range(3)]
    schema = "showtime timestamp, location string, special string"
    src = str(tmp_path / "in")
    daily, cliffs = BucketedTable(spark, str(tmp_path / "d"), ["location"], J.DAILY, 4), BucketedTable(spark, str(tmp_path / "c"), ["location"], J.CLIFF, 4)
    for part in range(3):
        spark.createDataFrame(rows[part::3] if part else rows[::3][::-1], schema).coalesce(1).write.mode("append").parquet(src)
        J.stream_venue_coverage(spark.readStream.schema(schema).parquet(src), daily, str(tmp_path / "cp"), cliffs).awaitTermination()
        so_far = spark.createDataFrame([r for k in range(part + 1) for r in rows[k::3]], schema)
        got = {(r.location, r.sessions, str(r.last_day), r.special) for r in J.coverage_from_daily(daily.read()).collect()}
        assert got == {(r.location, r.n, str(r.d), r.s) for r in so_far.groupBy("location").agg(F.count("*").alias("n"), F.to_date(F.max("showtime")).alias("d"), F.count("special").alias("s")).collect()}
        assert sorted(map(repr, cliffs.read().collect())) == sorted(map(repr, V.publication_cliff(so_far).withColumn("gap_days", F.col("gap_days").cast("int")).collect()))


def test_bucketed_table_rewrites_touched_buckets_only(spark, tmp_path):
    table = BucketedTable(spark, str(tmp_path / "t"), ["k"], "k long, v long", 8)
    add = lambda stored, new: stored.join(new.select("k"), "k", "left_anti").unionByName(new)
    table.merge(spark.range(50).select(F.col("id").alias("k"), F.lit(0).cast("long").alias("v")), add)
    files = lambda: {f: f.stat().st_mtime_ns for f in (tmp_path / "t").glob("bucket=*/*.parquet")}
    before = files()
    touched = table.merge(spark.createDataFrame([(7, 1)], "k long, v long"), add)
    assert len(touched) == 1 and {f for f in before if f in files()} == {f for f in before if f.parent.name != f"bucket={touched[0]}"}
    assert {(r.k, r.v) for r in table.read().collect()} == {(k, int(k == 7)) for k in range(50)}
    assert table.merge(table.read().limit(0), add) == []


PAGE = "page_id long, url string, html string, seen_at timestamp"


def test_page_stream_in_files_equals_batch(spark, tmp_path):
    """Pages in four files, with a page that comes again in another file, one that comes late, pages without listing and null ones."""
    item, when = '<li class="s">([^<]*)</li>', lambda m: (T0 + pd.Timedelta(minutes=m)).to_pydatetime()
    page = lambda i, m, items: (i, f"https://v{i % 2}.org/{i}", None if items is None else "<p>x</p>" + "".join(f'<li class="s">{x}</li>' for x in items), when(m))
    a, b = page(1, 0, ["09:00", "Domingo 07/03", "20:30", "VOSE 22:00", "agotado"]), page(2, 5, ["Lunes 08/03", "18:15", "Martes 09/03", "18:15", "18:15"])
    files = [[a, page(3, 1, []), page(4, 1, None)], [a, b], [page(5, 300, ["Jueves 11/03", "12:00"])], [page(6, 2, ["Jueves 11/03", "10:00"]), b]]
    src, table = str(tmp_path / "in"), BucketedTable(spark, str(tmp_path / "t"), ["film_id", "location"], J.SCREENING_SCHEMA, 4)
    for rows in files:
        spark.createDataFrame(rows, PAGE).coalesce(1).write.mode("append").parquet(src)
        J.stream_page_sessions(spark.readStream.schema(PAGE).parquet(src), table, str(tmp_path / "cp"), item, listing_day, "2001-01-01", "2001-12-31", "10 hours").awaitTermination()
    batch = J.page_sessions(spark.createDataFrame([r for rows in files for r in rows], PAGE), item, listing_day).dropDuplicates(J.SCREENING_KEYS)
    want = {(r.film_id, str(r.showtime), r.location, r.version) for r in batch.collect()}
    assert {(r.film_id, str(r.showtime), r.location, r.version) for r in table.read().collect()} == want and len(want) == 6 and table.read().count() == 6


def test_carried_in_row_needs_no_shuffle(spark):
    rows = spark.createDataFrame([(1, ["a", "H1", "b", "c", "H2", "d"]), (2, ["x"]), (3, []), (4, None), (5, ["H1", "H2"])], "i long, t array<string>")
    out = rows.select("i", F.explode(E.carried_in_row(F.col("t"), lambda x: x.startswith("H"))).alias("x")).select("i", "x.*")
    assert "Exchange" not in out._jdf.queryExecution().executedPlan().toString() and "Window" not in out._jdf.queryExecution().executedPlan().toString()
    assert sorted(map(tuple, out.collect()), key=lambda r: r[:2]) == [(1, 0, "a", None), (1, 1, "H1", "H1"), (1, 2, "b", "H1"), (1, 3, "c", "H1"), (1, 4, "H2", "H2"), (1, 5, "d", "H2"),
                                           (2, 0, "x", None), (5, 0, "H1", "H1"), (5, 1, "H2", "H2")]


def test_feedback_and_films_as_streams(spark, tmp_path):
    """Films before and after their feedback match; feedback whose film never comes leaves with null once the watermark has passed."""
    at = lambda h: (T0 + pd.Timedelta(hours=h)).to_pydatetime()
    seen = [[(1, "a", at(0)), (2, "b", at(1))], [(3, "c", at(2)), (4, None, at(2))], [(5, "a", at(60))], [(6, "x", at(200))]]
    stored = [[(10, "a", at(-2))], [(20, "b", at(3))], [(30, "z", at(61))], [(40, "y", at(201))]]
    left, right, table = str(tmp_path / "l"), str(tmp_path / "r"), VersionedTable(spark, str(tmp_path / "t"))
    schema = "user_id long, short_url string, film_id long"
    for l, r in zip(seen, stored):
        spark.createDataFrame(l, "user_id long, short_url string, at timestamp").coalesce(1).write.mode("append").parquet(left)
        spark.createDataFrame(r, "id long, short_url string, stored_at timestamp").coalesce(1).write.mode("append").parquet(right)
        joined = J.match_feedback(spark.readStream.schema("user_id long, short_url string, at timestamp").parquet(left), spark.readStream.schema("id long, short_url string, stored_at timestamp").parquet(right))
        J.start(joined, lambda b, i: table.write(table.read(schema).unionByName(b), tag=str(i)), str(tmp_path / "cp")).awaitTermination()
    assert {(r.user_id, r.film_id) for r in table.read().collect()} == {(1, 10), (2, 20), (3, None), (4, None), (5, None)}


def test_page_stream_of_part_files(spark, tmp_path):
    """A table may be a folder of part files; page ids may be further apart than the watermark."""
    from showgrid.plans.bind import Tables
    from showgrid.plans.streams import stream_page_sessions
    folder = str(tmp_path)
    for i in (0, 1_000_000):
        pages = spark.range(i, i + 3).selectExpr("id as page_id", "concat('https://v', id, '.example/x') as url", "'<p></p>' as html")
        pages.coalesce(1).write.mode("append").parquet(f"{folder}/pages.parquet")
    got = stream_page_sessions(Tables(spark, folder))
    assert got.groupBy("film_id").count().where("count = 4").count() == 6
