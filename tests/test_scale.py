"""Work is dealt over tasks and read or written once, whatever the size of the input."""

from pyspark.sql import functions as F
from pyspark.sql.readwriter import DataFrameWriter

import __spark_entry__ as entry
from showgrid.operators import graph as G
from showgrid.operators import matching as J
from showgrid.operators.consolidate import drop_known_sessions, upsert_screenings
from showgrid.plans.bind import Tables
from showgrid.plans.ingest import documents
from showgrid.sources.writers import SLICES, BucketedTable, write_export
from showgrid.streaming.jobs import SCREENING_KEYS, SCREENING_SCHEMA

FOLDER = "/root/testdata/sf0.001"


def plan(df) -> str:
    """The executed plan from the last step down to the scans."""
    return df._jdf.queryExecution().executedPlan().toString()


def test_links_are_opened_and_added_up_where_films_are_dealt(spark):
    text = plan(G.film_attribute_edges(Tables(spark, FOLDER).films))
    assert text.count("Exchange") == 1
    assert text.rindex("HashAggregate") < text.index("Generate") < text.index("Exchange hashpartitioning(id")


def test_links_of_repeated_films_are_one_row(spark):
    films = Tables(spark, FOLDER).films.where("id = 4")
    once = {(r.attr, r.category): (r.w, r.links) for r in G.film_attribute_edges(films).collect()}
    twice = {(r.attr, r.category): (r.w, r.links) for r in G.film_attribute_edges(films.union(films)).collect()}
    assert twice == {k: (2 * w, 2 * n) for k, (w, n) in once.items()}


def test_metadata_documents_are_built_in_many_tasks(spark):
    t = Tables(spark, FOLDER)
    made = documents(t)
    assert t.films.rdd.getNumPartitions() == 1 and made.rdd.getNumPartitions() == int(spark.conf.get("spark.sql.shuffle.partitions"))
    assert made.count() == t.films.count()


def test_export_is_written_in_one_pass_a_file(spark, monkeypatch):
    paths, write = [], DataFrameWriter.csv
    monkeypatch.setattr(DataFrameWriter, "csv", lambda self, path, *a, **k: (paths.append(path), write(self, path, *a, **k))[1])
    assert entry.queries()["read_user_export"](spark, FOLDER).count() > 0
    assert len(paths) == 4


def test_export_folders(spark, tmp_path):
    rows = spark.createDataFrame([("1", "a"), ("2", "b"), ("2", "c"), (None, "d")], "folder string, uri string")
    write_export({"watched.csv": rows, "likes/films.csv": rows.where("uri = 'b'"), "diary.csv": rows.where("false")}, str(tmp_path / "x"))
    read = lambda p: {r.uri for r in spark.read.option("header", True).csv(str(tmp_path / "x" / p)).collect()}
    assert read("1/watched.csv") == {"a"} and read("2/watched.csv") == {"b", "c"} and read("2/likes/films.csv") == {"b"}
    assert not (tmp_path / "x/1/likes").exists() and read("empty/diary.csv") == set()


def test_entries_are_not_shuffled_by_their_id(spark):
    entries = spark.createDataFrame([("a", "T", "1990", "X"), ("b", "T", None, None), ("c", "T", None, None), ("d", None, "1990", "X"), ("e", "T", "1991", "X, Y")], "entry_id string, title string, year string, director string")
    films = spark.createDataFrame([(1, "u1", "T", 1990, 5, "Z"), (2, "u2", "t", 1980, 9, "Y")], "id long, film_url string, title string, year int, viewers long, director string")
    found = J.search_cascade(entries, films)
    assert "hashpartitioning(entry_id" not in plan(found)
    assert {(r.entry_id, r.matched_url, r.strategy, r.year) for r in found.collect()} == {
        ("a", "u1", "title + year", 1990), ("b", "u2", "title only", 1980), ("c", "u2", "title only", 1980), ("d", None, None, 1990), ("e", "u2", "title + director", 1991)}


def test_first_batch_of_sessions_meets_no_table(spark, tmp_path):
    table = BucketedTable(spark, str(tmp_path / "t"), SCREENING_KEYS[::2], SCREENING_SCHEMA)
    batch = Tables(spark, FOLDER).screenings.select(*[c.split()[0] for c in SCREENING_SCHEMA.split(", ")])
    new = drop_known_sessions(batch.withColumn("timestamp", F.date_format("showtime", "yyyy-MM-dd HH:mm")), table.read(), "1990-01-01", "2010-12-31").select(*batch.columns)
    assert "LeftAnti" not in plan(new)
    assert plan(upsert_screenings(batch.limit(5), batch)).count("Exchange hashpartitioning(film_id") == 1
    table.merge(new, upsert_screenings)
    assert table.read().count() == batch.select(*SCREENING_KEYS).distinct().count()
    assert all(len(list(b.glob("*.parquet"))) <= SLICES for b in (tmp_path / "t").glob("bucket=*"))


def test_directors_of_showtimes_are_cleaned_once(spark):
    """The optimized plan names the clean-up of the text a single time, and the title case stays as it was."""
    from showgrid.sources.readers import showtime_api_sessions

    doc = '{"d":{"Cinemas":[{"Id":35,"Dates":[{"FilterDate":"/Date(1772323200000)/","Movies":[%s]}]}]}}'
    movie = '{"Key":"m%d","Title":" T ","Director":%s,"Formats":[{"Language":"VOSE","Showtimes":[{"CinemaId":35,"Time":"10:30","VistaCinemaId":"v","ShowtimeId":"1"}]}]}'
    names = ['"ANA  O\'NEIL"', '"Ana  lópez "', '"  "', "null"]
    docs = spark.createDataFrame([(doc % ",".join(movie % (i, n) for i, n in enumerate(names)),)], "document string")
    sessions = showtime_api_sessions(docs)
    assert sessions._jdf.queryExecution().optimizedPlan().toString().count("regexp_replace") == 1
    assert [r["director"] for r in sessions.orderBy("film_key").collect()] == ["Ana O'Neil", "Ana lópez", None, None]


def test_scraped_rows_stay_where_they_are_read(spark, tmp_path):
    """The offsets of the files go to the rows, whatever the planner thinks of their size; rows keep the order of files."""
    from showgrid.sources.readers import read_scraped_csv

    head = "theater,title,theater_film_link,dates,director,year,special,title_en,film_url\n"
    for name, n in (("b", 3), ("a", 2)):
        (tmp_path / f"{name}.csv").write_text(head + "".join(f"Main,{name}{i},,,,,,,\n" for i in range(n)))
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        rows = read_scraped_csv(spark, str(tmp_path))
        assert "SortMergeJoin" not in rows._jdf.queryExecution().executedPlan().toString()
        assert [tuple(r) for r in rows.select("title", "seq").orderBy("seq").collect()] == [("a0", 0), ("a1", 1), ("b0", 2), ("b1", 3), ("b2", 4)]
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
