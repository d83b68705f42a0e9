"""Registered queries for sources, consolidation, matching, upserts, audits and the queue."""

from __future__ import annotations

import tempfile

from pyspark.sql import functions as F

from showgrid import lookups
from showgrid.functions import metadata as M
from showgrid.operators import consolidate as C
from showgrid.operators import exports as E
from showgrid.operators import feedback as B
from showgrid.operators import matching as J
from showgrid.operators import quality as A
from showgrid.operators import queue as Q
from showgrid.operators import serving as V
from showgrid.plans.bind import AS_OF, QUEUE_NOW, Tables
from showgrid.plans.registry import query
from showgrid.sources import readers as R
from showgrid.sources import writers as Wr
from showgrid.util import cut_lineage

FMT = "yyyy-MM-dd HH:mm"
SESSION_COLUMNS = ["timestamp", "location", "url_tickets", "url_info", "version", "special"]


# --- sources ----------------------------------------------------------------------------------------

@query("read_store", """
select id, title, year from F where year >= 1990 and rating is not null and title ilike '%RED%'
""")
def read_store(t: Tables):
    return R.read_store(t.films, [("year", "gte", 1990), ("rating", "is_null", False), ("title", "ilike", "%RED%")], ["id", "title", "year"])


def cells(t: Tables):
    """One serialized ``dates`` cell per order line, in four encodings."""
    first = F.date_format("l_shipdate", FMT)
    second = F.date_format(F.expr("l_shipdate + interval 25 hours"), FMT)
    place = F.concat(F.lit("Room "), F.col("l_suppkey").cast("string"))
    as_json = F.concat(F.lit('[{"timestamp": "'), first, F.lit('", "location": "'), place, F.lit('", "url_tickets": "t/1", "special": null}, {"timestamp": "'), second, F.lit('", "url": "t/2"}]'))
    as_repr = F.concat(F.lit("[{'timestamp': '"), first, F.lit("', 'location': '"), place, F.lit("', 'url_tickets': 't/1', 'special': None}, {'timestamp': '"), second, F.lit("', 'url': 't/2', 'version': None}]"))
    as_list = F.concat(F.lit("['"), first, F.lit("', '"), second, F.lit("']"))
    as_noise = F.concat(F.lit("desde "), first, F.lit(" y "), second, F.lit(" (sala)"))
    kind = F.col("l_orderkey") % 5
    cell = F.when(kind == 0, as_json).when(kind == 1, as_repr).when(kind == 2, as_list).when(kind == 3, as_noise).otherwise(F.lit("sin fechas"))
    return t.raw("lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", cell.alias("cell"))


CELL_SQL = """
with x as (select l_orderkey, l_linenumber, l_partkey, l_suppkey, l_orderkey % 5 as k,
  strftime(l_shipdate, '%Y-%m-%d %H:%M') as a, strftime(l_shipdate + interval 25 hours, '%Y-%m-%d %H:%M') as b from lineitem)
"""


@query("parse_dates_cell", CELL_SQL + """
select l_orderkey, l_linenumber, l_partkey, l_suppkey, 0 as pos, a as "timestamp", case when k < 2 then concat('Room ', l_suppkey) end as location, case when k < 2 then 't/1' else '' end as url_tickets from x where k < 4
union all
select l_orderkey, l_linenumber, l_partkey, l_suppkey, 1, b, null, case when k < 2 then 't/2' else '' end from x where k < 4
""")
def parse_dates_cell(t):
    parsed = cells(t).withColumn("d", R.parse_dates_cell(F.col("cell")))
    return parsed.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", F.posexplode_outer("d").alias("pos", "s")).where("pos is not null").select(
        "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "pos", "s.timestamp", "s.location", "s.url_tickets")


@query("flatten_sessions", CELL_SQL + """
select l_orderkey, l_linenumber, l_partkey, l_suppkey, a as "timestamp", case when k < 2 then concat('Room ', l_suppkey) else 'Main' end as location, concat('i/', l_partkey) as url_info, case when l_linenumber = 1 then 'event' end as special from x where k < 4
union all
select l_orderkey, l_linenumber, l_partkey, l_suppkey, b, 'Main', concat('i/', l_partkey), case when l_linenumber = 1 then 'event' end from x where k < 4
""")
def flatten_sessions(t):
    nested = cells(t).select(
        "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", F.lit("Main").alias("theater"), F.concat(F.lit("i/"), F.col("l_partkey").cast("string")).alias("theater_film_link"),
        F.when(F.col("l_linenumber") == 1, F.lit("event")).otherwise(F.lit(" ")).alias("special"), R.parse_dates_cell(F.col("cell")).alias("dates"))
    return C.flatten_sessions(nested).select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "timestamp", "location", "url_info", "special")


@query("read_catalog_json", f"""
select film_id as id, count(*) as sessions, strftime(min(showtime), '%Y-%m-%d %H:%M') as first_session from S where showtime >= timestamp '{AS_OF}' group by film_id
""")
def read_catalog_json(t):
    """Write the nested catalogue of upcoming films as JSON lines and read it back."""
    sessions = C.nest_sessions(t.films.select("id", "title"), V.upcoming_sessions(t.screenings_from(AS_OF), AS_OF))
    entry = F.struct("position", F.date_format("showtime", FMT).alias("timestamp"), "location", "url_tickets")
    dates = sessions.groupBy(F.col("id").alias("film_id")).agg(F.array_sort(F.collect_list(entry)).alias("dates"))  # the document of the edge is nested
    rows = t.films.join(dates, F.col("id") == F.col("film_id")).select(
        "title", "director", "year", F.col("id").cast("string").alias("short_url"), "film_url", "rating", "genres",
        F.transform("dates", lambda d: F.struct(d["timestamp"].alias("timestamp"), d["location"].alias("location"), d["url_tickets"].alias("url_tickets"))).alias("dates"))
    path = scratch(t, "catalog")
    Wr.write_catalog(rows, path)
    back = R.read_catalog_json(t.spark, path)
    return back.select(F.col("short_url").cast("long").alias("id"), F.size("dates").cast("long").alias("sessions"), F.element_at("dates", 1)["timestamp"].alias("first_session"))


@query("read_scraped_csv", """
select l_orderkey, l_partkey, l_suppkey, l_linenumber, case when l_orderkey % 5 < 4 then 2 else 0 end as sessions, case when l_orderkey % 3 = 0 then null else 1900 + l_partkey % 100 end as year from lineitem
""")
def read_scraped_csv(t):
    raw = cells(t)
    title = F.concat_ws("/", F.lit('quote " and, comma'), "l_orderkey", "l_partkey", "l_suppkey", "l_linenumber")
    rows = raw.select(F.lit("Main").alias("theater"), title.alias("title"), F.lit("").alias("theater_film_link"), F.col("cell").alias("dates"),
                      F.lit(None).cast("string").alias("director"), F.when(F.col("l_orderkey") % 3 != 0, F.concat((1900 + F.col("l_partkey") % 100).cast("string"), F.lit(".0"))).alias("year"),
                      F.lit(None).cast("string").alias("special"), F.lit(None).cast("string").alias("title_en"), F.lit(None).cast("string").alias("film_url"))
    path = scratch(t, "scraped")
    Wr.write_catalog(rows, path, "csv")
    parts = F.split("title", "/")
    ids = [F.element_at(parts, i + 2).cast("long").alias(n) for i, n in enumerate(["l_orderkey", "l_partkey", "l_suppkey", "l_linenumber"])]
    return R.read_scraped_csv(t.spark, path).select(*ids, F.size("dates").alias("sessions"), "year")


@query("write_catalog", """
select 'parquet' as format, x as genre, count(*) as films from F, unnest(genres) as t(x) group by x
union all select 'csv', x, count(*) from F, unnest(genres) as t(x) group by x
""")
def write_catalog(t):
    """Write films with their genre lists as parquet and CSV, read both back and count."""
    films, out = t.films.select("id", "title", "genres"), None
    for fmt in ("parquet", "csv"):
        path = scratch(t, f"films-{fmt}")
        Wr.write_catalog(films, path, fmt)
        if fmt == "parquet":
            back = t.spark.read.parquet(path)
        else:
            back = t.spark.read.schema("id long, title string, genres string").option("header", True).option("escape", '"').csv(path).withColumn(
                "genres", F.from_json("genres", "array<string>"))
        part = back.select(F.explode("genres").alias("genre")).groupBy("genre").agg(F.count(F.lit(1)).alias("films")).withColumn("format", F.lit(fmt))
        out = part if out is None else out.unionByName(part)
    return out


def scratch(t: Tables, name: str) -> str:
    """A fresh path in the cluster's shared folder, or in a local one when running locally."""
    import uuid

    base = t.spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not t.spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder shared by all executors")
        base = tempfile.mkdtemp(prefix="showgrid-")
    return f"{base}/{name}-{uuid.uuid4().hex}"


@query("read_showtime_api", """
select concat('m', l_partkey) as film_key, case l_suppkey % 3 when 0 then 'Yelmo Ideal' when 1 then 'Yelmo Islazul' end as location,
 concat(strftime(l_shipdate, '%Y-%m-%d'), ' ', lpad(cast(10 + l_linenumber as varchar), 2, '0'), ':30') as "timestamp",
 concat('https://tickets.example/?cinemaVistaId=v', l_suppkey, '&showtimeVistaId=', l_orderkey) as url_tickets, concat('Brand ', l_suppkey, ' O''Neil') as director, 'VOSE' as language
from lineitem where l_suppkey % 3 < 2
""")
def read_showtime_api(t):
    """One document per order line: a known or unknown cinema, one good showtime and one of another cinema."""
    line = t.raw("lineitem").withColumn("c", F.expr("case l_suppkey % 3 when 0 then 35 when 1 then 48 else 999 end"))
    show = lambda cinema: F.struct(cinema.alias("CinemaId"), F.concat((10 + F.col("l_linenumber")).cast("string"), F.lit(":30")).alias("Time"),
                                   F.concat(F.lit("v"), F.col("l_suppkey").cast("string")).alias("VistaCinemaId"), F.col("l_orderkey").cast("string").alias("ShowtimeId"))
    formats = F.array(F.struct(F.lit("VOSE").alias("Language"), F.array(show(F.col("c")), show(F.lit(1))).alias("Showtimes")))
    movies = F.array(F.struct(F.concat(F.lit("m"), F.col("l_partkey").cast("string")).alias("Key"), F.lit(" T ").alias("Title"),
                              F.concat(F.lit("BRAND  "), F.col("l_suppkey").cast("string"), F.lit(" O'NEIL")).alias("Director"), formats.alias("Formats")))
    millis = F.unix_millis(F.col("l_shipdate").cast("timestamp")).cast("string")
    dates = F.array(F.struct(F.concat(F.lit("/Date("), millis, F.lit(")/")).alias("FilterDate"), movies.alias("Movies")))
    document = F.to_json(F.struct(F.struct(F.array(F.struct(F.col("c").alias("Id"), dates.alias("Dates"))).alias("Cinemas")).alias("d")))
    return R.showtime_api_sessions(line.select(document.alias("document"))).select("film_key", "location", "timestamp", "url_tickets", "director", "language")


@query("read_user_export", """
select cast(user_id as varchar) as user_id, short_url, rating, liked, strftime(watched_date, '%Y-%m-%d') as watched_date, rewatch_count from W
""")
def read_user_export(t):
    """Write every user's feedback as export CSVs and read the exports back."""
    root = scratch(t, "export")
    w = cut_lineage(t.watched.select(F.pmod("user_id", F.lit(8)).cast("string").alias("folder"), "user_id", F.col("short_url"), "rating", "liked", "watched_date", "rewatch_count"))
    uri = F.concat_ws("@", F.col("user_id").cast("string"), "short_url")
    day = F.col("watched_date").cast("string").alias("Date")
    name, year = F.lit('A "quoted", name').alias("Name"), F.lit("1999").alias("Year")
    base = w.select("folder", day, name, year, uri.alias("uri"), "rating", "liked", "rewatch_count")
    parts = {
        "watched.csv": base.select("folder", "Date", "Name", "Year", "uri"),
        "ratings.csv": base.where("rating is not null").select("folder", "Date", "Name", "Year", "uri", F.col("rating").alias("Rating")),
        "likes/films.csv": base.where("liked").select("folder", "Date", "Name", "Year", "uri"),
        "diary.csv": base.where("rewatch_count > 0").select("folder", "Date", "Name", "Year", "uri", F.lit("").alias("Rating"), F.explode(F.sequence(F.lit(1), "rewatch_count")).alias("k")).withColumn("Rewatch", F.lit("Yes")).drop("k"),
    }
    Wr.write_export(parts, root)
    feedback = R.feedback_from_export(R.read_user_export(t.spark, root))
    pair = F.split("short_url", "@")
    return feedback.select(pair[0].alias("user_id"), pair[1].alias("short_url"), "rating", "liked", F.col("watched_date").cast("string").alias("watched_date"), "rewatch_count")


@query("full_replace_partition", """
with fresh as (select user_id, short_url, 5.0 as rating from L)
select user_id, short_url, rating from W where user_id not in (select user_id from fresh)
union all select user_id, short_url, rating from fresh
""")
def full_replace_partition(t):
    """Store all users, replace those with a watchlist, and read everything back."""
    path = scratch(t, "user_rows")
    Wr.write_user_buckets(t.watched.select("user_id", "short_url", "rating"), path)
    Wr.replace_stored_users(t.spark, path, t.watchlist.select("user_id", "short_url", F.lit(5.0).alias("rating")))
    return t.spark.read.parquet(path).select("user_id", "short_url", "rating")


@query("sources_by_period", """
with v as (select case p_partkey % 2 when 0 then 'weekly' else 'monthly' end as period, p_partkey as id from part)
select concat('src', id) as source_key from v where period = 'weekly'
""")
def sources_by_period(t):
    table = t.raw("part").selectExpr("concat('src', p_partkey) as source_key", "case p_partkey % 2 when 0 then 'weekly' else 'monthly' end as update_period")
    return R.sources_by_period(table, "weekly")


# --- nested data --------------------------------------------------------------------------------------

@query("nest_sessions", """
with v as (select film_id, location, min((showtime, seq)) as first from S where coalesce(location, '') not in ('', 'Unknown') group by film_id, location),
p as (select film_id, string_agg(location, ', ' order by first, location) as theater from v group by film_id),
k as (select film_id, min_by(url_info, (showtime, seq, location)) as link from S where url_info <> '' group by film_id)
select id, row_number() over (partition by id order by showtime, seq, location) as position, strftime(showtime, '%Y-%m-%d %H:%M') as showtime, location,
 md5(coalesce(theater, 'Unknown')) as theater, coalesce(link, '') as theater_link
from F join S on S.film_id = id left join p on p.film_id = id left join k on k.film_id = id where coalesce(title, '') <> ''
""")
def nest_sessions(t):
    return C.nest_sessions(t.films.select("id", "title"), t.screenings).select(
        "id", "position", F.date_format("showtime", FMT).alias("showtime"), "location", F.md5("theater").alias("theater"), "theater_link")


def documents(t: Tables):
    """A metadata document per film: movies, and series for every fifth film."""
    f = t.dealt_films
    tv = F.col("id") % 5 == 0
    s = lambda **kw: F.struct(*[v.alias(k) for k, v in kw.items()])
    none = F.lit(None)
    crew = F.concat(
        F.transform("directors", lambda x: s(id=x["id"], name=x["name"], job=F.lit("Director"))),
        F.transform("cinematographers", lambda x: s(id=x["id"], name=x["name"], job=F.lit("Director of Photography"))),
        F.transform("directors", lambda x: s(id=x["id"] + 50, name=x["name"], job=F.lit("Series Director"))),
        F.transform("composers", lambda x: s(id=x["id"], name=x["name"], job=F.lit("Original Music Composer"))),
        F.transform("writers", lambda x: s(id=x["id"], name=x["name"], job=F.lit("Screenplay"))),
        F.transform("writers", lambda x: s(id=x["id"] + 7, name=x["name"], job=F.lit("Gaffer"))))
    code = F.expr("case id % 4 when 0 then 'en' when 1 then 'fr' when 2 then 'tr' else 'qq' end")
    translations = F.array(
        s(iso_639_1=F.lit("fr"), iso_3166_1=F.lit("FR"), data=s(title=F.lit("Le film"), name=none.cast("string"))),
        s(iso_639_1=F.lit("es"), iso_3166_1=F.lit("MX"), data=s(title=F.concat(F.lit("MX "), F.col("title")), name=none.cast("string"))),
        s(iso_639_1=F.lit("es"), iso_3166_1=F.lit("ES"), data=s(title=F.coalesce("title_es", F.lit("")), name=none.cast("string"))),
        s(iso_639_1=F.lit("en"), iso_3166_1=F.lit("US"), data=s(title=F.lit(""), name=F.when(~tv | (F.col("id") % 10 == 0), F.coalesce("title_en", F.lit(""))))))
    doc = s(
        id=F.col("id") + 900000, title=F.when(~tv, F.col("title")), name=F.when(tv, F.col("title")),
        original_title=F.when(~tv, F.col("title_original")), original_name=F.when(tv, F.col("title_original")), original_language=code,
        genres=F.concat(F.transform("genres", lambda g: s(id=F.lit(1), name=g)), F.array(s(id=F.lit(2), name=F.lit("")))),
        production_countries=F.when(F.col("id") % 15 == 0, F.expr("cast(array() as array<struct<iso_3166_1:string,name:string>>)")).otherwise(F.transform("country", lambda c: s(iso_3166_1=F.lit("XX"), name=c))),
        origin_country=F.array(F.lit("XX")),
        spoken_languages=F.array(s(english_name=F.lit("French"), iso_639_1=F.lit("fr"), name=F.lit("Français")), s(english_name=F.lit(""), iso_639_1=F.lit("it"), name=F.lit("Italiano"))),
        translations=s(translations=translations), runtime=F.coalesce("runtime_minutes", F.lit(0)),
        number_of_episodes=F.when(F.col("id") % 10 == 0, F.lit(8)), episode_run_time=F.array(F.lit(0), F.lit(45), F.coalesce("runtime_minutes", F.lit(50))),
        vote_average=F.col("tmdb_rating"), vote_count=F.col("tmdb_votes"), overview=F.coalesce("overview", F.lit("")), tagline=F.lit(""),
        belongs_to_collection=F.when(F.col("collection_id").isNotNull(), s(id=F.col("collection_id"), name=F.lit("Set"))),
        credits=s(crew=crew, cast=F.col("top_cast")), created_by=F.when(tv & (F.col("id") % 3 == 0), F.col("directors")),
        keywords=F.when(tv, s(keywords=none.cast("array<struct<id:bigint,name:string>>"), results=F.col("keywords"))).otherwise(s(keywords=F.col("keywords"), results=none.cast("array<struct<id:bigint,name:string>>"))),
        production_companies=F.col("production_companies"),
        recommendations=s(results=F.transform("tmdb_recommendations", lambda x: s(id=x))), poster_path=F.col("poster_path"))
    return f.select("id", F.when(tv, F.lit("tv")).otherwise(F.lit("movie")).alias("kind"), F.to_json(doc).alias("document"))


def joined_names(c):
    return F.array_join(F.transform(c, lambda x: F.concat_ws(":", x["id"].cast("string"), x["name"])), "|")


NAMES = "array_to_string([concat_ws(':', x.id, x.name) for x in {}], '|')"


@query("normalize_metadata_doc", """
select id, id + 900000 as tmdb_id, array_to_string(genres, '|') as genres,
 case when id % 15 = 0 then 'XX' when false then '' else array_to_string(country, '|') end as country,
 case when tmdb_rating > 0 then tmdb_rating end as tmdb_rating, case when tmdb_votes > 0 then tmdb_votes end as tmdb_votes,
 collection_id, case when collection_id is not null then 'Set' end as collection_name, overview, poster_path,
 array_to_string(tmdb_recommendations, '|') as tmdb_recommendations,
 array_to_string([concat_ws(':', x.id, x.name) for x in keywords], '|') as keywords,
 array_to_string([concat_ws(':', x.id, x.name) for x in production_companies], '|') as companies
from (select *, id % 5 = 0 as tv from F) where not tv
union all
select id, id + 900000, array_to_string(genres, '|'), case when id % 15 = 0 then 'XX' else array_to_string(country, '|') end,
 case when tmdb_rating > 0 then tmdb_rating end, case when tmdb_votes > 0 then tmdb_votes end,
 collection_id, case when collection_id is not null then 'Set' end, overview, poster_path, array_to_string(tmdb_recommendations, '|'),
 array_to_string([concat_ws(':', x.id, x.name) for x in keywords], '|'), array_to_string([concat_ws(':', x.id, x.name) for x in production_companies], '|')
from F where id % 5 = 0
""")
def normalize_metadata_doc(t):
    return M.normalize_documents(documents(t)).select(
        "id", "tmdb_id", F.array_join("genres", "|").alias("genres"), F.array_join("country", "|").alias("country"), "tmdb_rating", "tmdb_votes",
        "collection_id", "collection_name", "overview", "poster_path", F.array_join("tmdb_recommendations", "|").alias("tmdb_recommendations"),
        joined_names("keywords").alias("keywords"), joined_names("production_companies").alias("companies"))


@query("tv_runtime_estimate", """
select id, cast(case when id % 5 <> 0 then case when runtime_minutes > 0 then runtime_minutes end
 when id % 10 = 0 then 8 * floor((45 + coalesce(runtime_minutes, 50)) / 2) else 45 end as integer) as runtime_minutes from F
""")
def tv_runtime_estimate(t):
    return M.normalize_documents(documents(t)).select("id", "runtime_minutes")


@query("pick_languages", """
select id, case id % 4 when 0 then 'English' when 1 then 'French' when 2 then 'Turkish' else 'qq' end as primary_language, 'French|Italiano' as spoken_languages from F
""")
def pick_languages(t):
    return M.normalize_documents(documents(t)).select("id", F.array_join("primary_language", "|").alias("primary_language"), F.array_join("spoken_languages", "|").alias("spoken_languages"))


@query("top_n_credits", f"""
select id, {NAMES.format('directors[1:2]')} as directors, {NAMES.format('cinematographers[1:2]')} as cinematographers, {NAMES.format('composers[1:2]')} as composers,
 {NAMES.format('(case when writers[1].id = writers[2].id then writers[1:1] else writers[1:2] end)')} as writers, {NAMES.format('[y for y in top_cast[1:5] if y.id <> 0]')} as top_cast
from F where id % 5 <> 0
""")
def top_n_credits(t):
    return M.normalize_documents(documents(t).where("kind = 'movie'")).select("id", *[joined_names(c).alias(c) for c in ("directors", "cinematographers", "composers", "writers", "top_cast")])


@query("prioritized_credits", """
select id, array_to_string([concat_ws(':', x.id, x.name) for x in (case when id % 3 = 0 and len(directors) > 0 then directors[1:2] else list_concat([struct_pack(id := y.id + 50, name := y.name) for y in directors], directors)[1:2] end)], '|') as directors
from F where id % 5 = 0
""")
def prioritized_credits(t):
    return M.normalize_documents(documents(t).where("kind = 'tv'")).select("id", joined_names("directors").alias("directors"))


@query("pick_translations", """
select id, case when title_en is not null and (id % 5 <> 0 or id % 10 = 0) then title_en when id % 4 = 0 then title_original when title <> coalesce(title_original, '') then title end as title_en,
 coalesce(title_es, concat('MX ', title)) as title_es, title_original from F
""")
def pick_translations(t):
    return M.normalize_documents(documents(t)).select("id", "title_en", "title_es", "title_original")


@query("union_languages", """
select id, array_to_string(list_sort(list_distinct([lower(l) for l in list_concat(primary_language, spoken_languages)])), '|') as languages from F
""")
def union_languages(t):
    return t.films.select("id", F.array_join(F.array_sort(M.union_languages(F.col("primary_language"), F.col("spoken_languages"))), "|").alias("languages"))


# --- incremental ingest and merge ---------------------------------------------------------------------

@query("drop_known_sessions", """
with st as (select * from S where cast(showtime as date) between date '1997-01-01' and date '2001-06-30' and version is not null),
kt as (select distinct url_tickets, strftime(showtime, '%Y-%m-%d %H:%M') as m from st where url_tickets <> ''),
ki as (select distinct url_info from st where url_tickets = '' and url_info <> '')
select s.seq, s.film_ref, s.location from SC s
where case when s.url_tickets <> '' then not exists (select 1 from kt where kt.url_tickets = s.url_tickets and kt.m = s."timestamp")
 when s.url_info <> '' then s.url_info not in (select url_info from ki) else true end
""")
def drop_known_sessions(t):
    stored = t.screenings.where("version is not null")
    return C.drop_known_sessions(t.scraped, stored, "1997-01-01", "2001-06-30").select("seq", "film_ref", "location")


@query("merge_by_link", """
with k as (select *, coalesce(nullif(trim(theater_film_link), ''), concat_ws(':', 'row', seq, theater, "timestamp")) as g from SC),
fm as (select g, min(seq) as first_seq, min_by(base_title, seq) as t from k group by g),
ss as (select g, count(*) as n from (select distinct g, "timestamp", location from k) group by g)
select fm.g as film_key, first_seq, t as base_title, n as sessions from fm join ss on ss.g = fm.g
""")
def merge_by_link(t):
    merged = C.merge_by_link(t.scraped, ["base_title", "title"], ["timestamp", "location", "url_tickets", "url_info", "version"])
    counts = merged.sessions.groupBy("film_key").agg(F.count(F.lit(1)).alias("sessions"))
    return merged.films.join(counts, "film_key").select("film_key", "first_seq", "base_title", "sessions")


@query("merge_by_identity", """
with a as (select base_title, director, year, min(seq) as first_seq, count(distinct concat_ws('#', "timestamp", location, url_tickets, url_info, coalesce(version, '-'))) as sessions from SC group by all),
b as (select lower(title) as k, director, min(seq) as first_seq, count(distinct concat_ws('#', "timestamp", location)) as sessions from SC group by all)
select 'title_director_year' as variant, base_title as title, director, first_seq, sessions from a
union all select 'lower_title_director', k, director, first_seq, sessions from b
""")
def merge_by_identity(t):
    columns = ["timestamp", "location", "url_tickets", "url_info", "version"]
    def run(variant, keys, title, session_key=None, lower=()):
        m = C.merge_by_identity(t.scraped, keys, [title, "director"], columns, session_key, lower)
        n = m.sessions.groupBy("film_key").agg(F.count(F.lit(1)).alias("sessions"))
        shown = F.lower(title) if lower else F.col(title)
        return m.films.join(n, "film_key").select(F.lit(variant).alias("variant"), shown.alias("title"), "director", "first_seq", "sessions")
    return run("title_director_year", ["base_title", "director", "year"], "base_title").unionByName(
        run("lower_title_director", ["title", "director"], "title", ["timestamp", "location"], ("title",)))


@query("merge_by_url_or_title", """
with recursive tu as materialized (select title, film_url, min(base_title) as b, min(seq) as q, count(*) as n from SC group by title, film_url),
e as materialized (select distinct x.title as x, y.title as y from tu x join tu y on x.film_url = y.film_url union select title, title from tu),
r as (select x, y from e union select r.x, e.y from r join e on e.x = r.y),
c as (select x, min(y) as g from r group by x)
select min(b) as title, min(q) as film_key, cast(sum(n) as bigint) as entries from tu join c on c.x = tu.title group by g
""")
def merge_by_url_or_title(t):
    linked = C.merge_by_url_or_title(t.scraped)
    return linked.groupBy("film_key").agg(F.min("base_title").alias("title"), F.count(F.lit(1)).alias("entries")).withColumn("film_key", F.col("film_key.seq"))


@query("regroup_by_canonical_title", """
with x as (select seq, base_title as en, case when seq % 5 <> 0 then director end as director, year, "timestamp", location from SC)
select en as title_en, min_by(director, seq) filter (director is not null) as director, min_by(year, seq) filter (year is not null) as year,
 count(distinct concat_ws('#', "timestamp", location)) as sessions from x group by en
""")
def regroup_by_canonical_title(t):
    table = t.scraped.select("title", "director", "base_title").distinct().select(
        "title", "director", F.col("base_title").alias("std_title"), F.col("base_title").alias("title_en"), F.col("director").alias("std_director"), F.lit("").alias("std_special"))
    m = C.regroup_by_canonical_title(t.scraped, table)
    n = m.sessions.groupBy("film_key").agg(F.count(F.lit(1)).alias("sessions"))
    return m.films.join(n, "film_key").select(F.col("film_key").alias("title_en"), "director", "year", "sessions")


INCOMING_SQL = """
inc as (select ((l_orderkey * 10 + l_linenumber) * 1000000 + l_suppkey) * 100 + cast(round(l_discount * 100) as bigint) as seq, l_partkey, case when l_partkey % 13 <> 0 then concat(case when l_partkey % 17 = 0 then 'n/' else 'b/' end, l_partkey) end as short_url, p_name as title,
  case l_linenumber when 2 then concat('D', l_suppkey) when 5 then director end as director, case l_linenumber when 3 then 2000 + l_suppkey % 20 when 5 then year end as year,
  case when l_linenumber = 4 then l_discount end as rating from lineitem join part on p_partkey = l_partkey join F on F.id = l_partkey),
kinc as (select *, coalesce('k:' || short_url, 't:' || lower(trim(title)) || '|' || coalesce('=' || lower(trim(director)), '-') || '|' || coalesce(cast(year as varchar), '-')) as key from inc),
one as (select key, max_by(short_url, seq) filter (short_url is not null) as short_url, max_by(title, seq) filter (title is not null) as title, max_by(director, seq) filter (director is not null) as director, max_by(year, seq) filter (year is not null) as year,
  max_by(rating, seq) filter (rating is not null) as rating from kinc group by key)
"""


def incoming_films(t: Tables):
    """A row per order line: known keys, new keys and rows without key, of which every fifth line names a stored film in full."""
    line, part = t.raw("lineitem"), t.raw("part")
    stored = t.films.select(F.col("id").alias("_id"), "director", "year")
    return line.join(part, line.l_partkey == part.p_partkey).join(stored, F.col("l_partkey") == F.col("_id")).selectExpr(
        "l_partkey", "((l_orderkey * 10 + l_linenumber) * 1000000 + l_suppkey) * 100 + cast(round(l_discount * 100) as bigint) as seq", "case when l_partkey % 13 <> 0 then concat(case when l_partkey % 17 = 0 then 'n/' else 'b/' end, l_partkey) end as short_url", "p_name as title",
        "case l_linenumber when 2 then concat('D', l_suppkey) when 5 then director end as director", "cast(case l_linenumber when 3 then 2000 + l_suppkey % 20 when 5 then year end as int) as year",
        "case when l_linenumber = 4 then l_discount end as rating")


@query("upsert_films", f"""
with {INCOMING_SQL},
k as (select *, coalesce('k:' || short_url, 't:' || lower(trim(title)) || '|' || coalesce('=' || lower(trim(director)), '-') || '|' || coalesce(cast(year as varchar), '-')) as key from F),
st as (select *, case when short_url is null and row_number() over (partition by key order by id) > 1 then concat('old', id) else key end as own from k)
select f.id, coalesce(one.short_url, f.short_url) as short_url, coalesce(one.title, f.title) as title, coalesce(one.director, f.director) as director, coalesce(one.year, f.year) as year,
 coalesce(one.rating, f.rating) as rating, one.key is not null as touched from st f full join one on one.key = f.own
""")
def upsert_films(t):
    stored = t.films.select("id", "short_url", "title", "director", "year", "rating")
    out = C.upsert_films(stored, incoming_films(t), "2001-09-01 00:00:00")
    return out.withColumn("touched", F.col("updated_at").isNotNull()).drop("updated_at")


@query("null_preserving_row", f"""
with {INCOMING_SQL} select l_partkey, max_by(short_url, seq) filter (short_url is not null) as short_url, max_by(title, seq) as title, max_by(director, seq) filter (director is not null) as director,
 max_by(year, seq) filter (year is not null) as year, max_by(rating, seq) filter (rating is not null) as rating from inc group by l_partkey
""")
def null_preserving_row(t):
    return C.last_known_values(incoming_films(t), ["l_partkey"], "seq")


@query("upsert_screenings", """
with k as (select film_id, date_trunc('month', showtime) as showtime, location, seq, url_tickets, version, special from S),
old as (select * from k where seq % 2 = 0 qualify row_number() over (partition by film_id, showtime, location order by seq) = 1),
inc as (select * from k where seq % 2 = 1 qualify row_number() over (partition by film_id, showtime, location order by seq) = 1)
select coalesce(i.film_id, o.film_id) as film_id, strftime(coalesce(i.showtime, o.showtime), '%Y-%m-%d') as month, coalesce(i.location, o.location) as location, coalesce(i.seq, o.seq) as seq,
 case when i.seq is not null then i.version else o.version end as version
from old o full join inc i on i.film_id = o.film_id and i.showtime = o.showtime and i.location = o.location
""")
def upsert_screenings(t):
    monthly = t.screenings.withColumn("showtime", F.date_trunc("month", "showtime").cast("timestamp_ntz"))
    stored = V.dedup_first(monthly.where("seq % 2 = 0"), ["film_id", "showtime", "location"], ["seq"])
    return C.upsert_screenings(stored, monthly.where("seq % 2 = 1")).select(
        "film_id", F.date_format("showtime", "yyyy-MM-dd").alias("month"), "location", "seq", "version")


@query("assign_film_ids", """
with fresh as (select distinct l_orderkey from lineitem where concat('b/', l_orderkey) not in (select short_url from F where short_url is not null))
select concat('b/', l_orderkey) as short_url, row_number() over (order by concat('b/', l_orderkey)) + (select max(id) from F) as id from fresh
""")
def assign_film_ids(t):
    keys = t.raw("lineitem").select(F.concat(F.lit("b/"), F.col("l_orderkey").cast("string")).alias("short_url"))
    return C.assign_film_ids(keys, t.films)


@query("resolve_film_ids", """
select user_id, short_url, case when raw_film_id % 4 = 0 then film_id else film_id end as film_id from W
""")
def resolve_film_ids(t):
    waiting = t.watched.select("user_id", "short_url", F.when(F.col("raw_film_id") % 4 == 0, F.col("film_id")).alias("film_id"))
    return C.resolve_film_ids(waiting, t.films).select("user_id", "short_url", "film_id")


@query("archive_partition", """
with a as (select seq, base_title as title, director, year, case when film_ref % 3 <> 0 and not (seq % 2 = 1 and film_ref % 5 = 0) then concat('b/', film_ref) end as short_url,
   case when seq % 29 = 0 then 'someday' else "timestamp" end as "timestamp", location from SC),
k as (select *, concat('t:', lower(trim(title)), '|', coalesce(lower(trim(director)), ''), '|', coalesce(cast(year as varchar), '')) as tup from a),
x as (select *, coalesce('u:' || short_url, tup) as own, "timestamp" between '1995-01-01' and '1998-12-31 24' as old from k),
lv as (select * from x where seq % 2 = 0), hs as (select * from x where seq % 2 = 1),
mv as (select *, case when own not in (select own from hs) and tup in (select own from hs) then tup else own end as film_key from lv where old),
pf as (select own, count(*) filter (old) as m, count(*) filter (not old) as k from lv group by own),
al as (select own as film_key, "timestamp", location from hs union select film_key, "timestamp", location from mv)
select cast(sum(m) as bigint) as sessions_archived, cast(sum(case when m > 0 then k end) as bigint) as sessions_kept, count(*) filter (m > 0 and k = 0) as films_fully_moved,
 count(*) filter (m > 0 and k > 0) as films_partially_moved, count(*) filter (m = 0) as films_untouched, count(*) filter (k > 0) as live_films_after,
 (select count(distinct film_key) from al) as history_films_after, (select count(*) from al) as history_sessions, (select count(*) from lv) - (select count(*) from mv) as live_sessions from pf
""")
def archive_partition(t):
    """Films with and without url, urls that only the live side has, and times that nobody can read."""
    url = F.expr("case when film_ref % 3 <> 0 and not (seq % 2 = 1 and film_ref % 5 = 0) then concat('b/', film_ref) end")
    flat = t.scraped.select("seq", F.col("base_title").alias("title"), "director", "year", url.alias("short_url"),
                            F.expr("case when seq % 29 = 0 then 'someday' else timestamp end").alias("timestamp"), "location")
    out = C.archive_partition(flat.where("seq % 2 = 0"), flat.where("seq % 2 = 1"), "1995-01-01", "1998-12-31")
    return out.counters.crossJoin(F.broadcast(out.history.agg(F.count(F.lit(1)).alias("history_sessions")))).crossJoin(
        F.broadcast(out.live.agg(F.count(F.lit(1)).alias("live_sessions"))))


# --- matching and enrichment joins ----------------------------------------------------------------------

def match_entries(t: Tables):
    s = t.scraped
    links = F.array(F.when(F.col("seq") % 2 == 0, F.lit("")).otherwise(F.col("url_info")), F.when(F.col("seq") % 3 == 0, F.concat(F.lit("x/"), F.col("film_ref").cast("string"))).otherwise(F.col("url_info")))
    return s.select(F.concat_ws("/", F.col("seq").cast("string"), F.col("film_ref").cast("string"), "location").alias("entry_id"), links.alias("links"),
                    F.when(F.col("seq") % 7 == 0, F.col("base_title")).alias("title_en"), "title", "film_url", "special", "director", "year")


MATCH_SQL = """
lc as (select url_info, min_by(film_url, seq) as u from S join F on id = film_id where url_info <> '' and film_url is not null group by url_info),
tc as (select title, max_by(film_url, id) as u from F where film_url is not null group by title),
e as (select concat_ws('/', seq, film_ref, location) as entry_id, case when seq % 2 = 0 then '' else url_info end as l1, case when seq % 3 = 0 then concat('x/', film_ref) else url_info end as l2,
  case when seq % 7 = 0 then base_title end as title_en, title, film_url, special from SC),
j as (select e.*, a.u as u1, b.u as u2, c.u as u3, d.u as u4 from e left join lc a on a.url_info = e.l1 and e.l1 <> '' left join lc b on b.url_info = e.l2 and e.l2 <> ''
  left join tc c on c.title = e.title_en left join tc d on d.title = e.title),
m as (select entry_id, case when film_url is null and special is null then coalesce(u1, u2, u3, u4) end as matched_url,
  case when film_url is null and special is null then case when u1 is not null or u2 is not null then 'link' when u3 is not null then 'title_en' when u4 is not null then 'title' end end as strategy from j)
"""


@query("match_cascade", f"with {MATCH_SQL} select * from m")
def match_cascade(t):
    return J.match_cascade(match_entries(t), t.films, t.screenings).select("entry_id", "matched_url", "strategy")


@query("match_report", f"""
with {MATCH_SQL}, r as (select case when matched_url is null then 'unmatched' else strategy end as strategy, count(*) as n from m group by 1)
select * from r union all select 'total', cast(sum(n) as bigint) from r
""")
def match_report(t):
    return J.match_report(J.match_cascade(match_entries(t), t.films, t.screenings))


@query("search_cascade", """
with e as (select concat_ws('/', seq, film_ref, location) as entry_id, base_title as t, case when seq % 4 = 0 then null else year end as y, case when seq % 5 = 0 then null else director end as d from SC),
c as (select lower(title) as t, cast(year as varchar) as y, year, director, film_url, coalesce(viewers, -1) as v, id from F where film_url is not null),
iy as (select t, y, max_by(film_url, (v, -id)) as u from c where y is not null group by t, y),
idr as (select t, director, max_by(film_url, (v, -id)) as u, max_by(year, (v, -id)) filter (true) as yy, max((v, -id)) as k from c where director is not null group by t, director),
it as (select t, max_by(film_url, (v, -id)) as u, max((v, -id)) as k from c group by t)
select entry_id, coalesce(iy.u, idr.u, it.u) as matched_url,
 case when iy.u is not null then 'title + year' when idr.u is not null then 'title + director' when it.u is not null then 'title only' end as strategy,
 coalesce(e.y, (select year from F h where h.film_url = coalesce(idr.u, it.u))) as year
from e left join iy on iy.t = e.t and iy.y = cast(e.y as varchar) left join idr on idr.t = e.t and idr.director = e.d left join it on it.t = e.t
""")
def search_cascade(t):
    entries = t.scraped.select(F.concat_ws("/", F.col("seq").cast("string"), F.col("film_ref").cast("string"), "location").alias("entry_id"),
                               F.col("base_title").alias("title"), F.col("year").cast("string").alias("year"), "director")
    return J.search_cascade(entries, t.films).select("entry_id", "matched_url", "strategy", "year")


@query("search_cascade_fuzzy", """
with e as (select concat_ws('/', seq, film_ref, location) as entry_id, case seq % 4 when 0 then base_title when 1 then concat(left(base_title, 2), substring(base_title, 4)) when 2 then concat(left(base_title, 4), 'x', substring(base_title, 6)) else concat(base_title, ' zq') end as t from SC),
c as (select lower(title) as r, max_by(film_url, (coalesce(viewers, -1), -id)) as u, max((coalesce(viewers, -1), -id)) as k from F where film_url is not null group by 1),
d as (select distinct t from e where t not in (select r from c)),
h as (select t, levenshtein(t, r) as far, u, k from d join c on abs(length(t) - length(r)) <= 2 where length(t) >= 6 and levenshtein(t, r) <= case when length(t) >= 12 then 2 else 1 end),
b as (select t, arg_max(u, (-far, k)) as u from h group by t)
select entry_id, coalesce(c.u, b.u) as matched_url, case when c.u is not null then 'title only' when b.u is not null then 'fuzzy title' end as strategy from e left join c on c.r = e.t left join b on b.t = e.t
""")
def search_cascade_fuzzy(t):
    """Listings whose titles lost a letter, hold a wrong one, or have two more characters."""
    title, left = F.col("base_title"), lambda n: F.substring("base_title", 1, n)
    bent = F.when(F.col("seq") % 4 == 0, title).when(F.col("seq") % 4 == 1, F.concat(left(2), F.substring(title, 4, 10_000))).when(
        F.col("seq") % 4 == 2, F.concat(left(4), F.lit("x"), F.substring(title, 6, 10_000))).otherwise(F.concat(title, F.lit(" zq")))
    entries = t.scraped.select(F.concat_ws("/", F.col("seq").cast("string"), F.col("film_ref").cast("string"), "location").alias("entry_id"), bent.alias("title"),
                               F.lit(None).cast("string").alias("year"), F.lit(None).cast("string").alias("director"))
    return J.search_cascade(entries, t.films, fuzzy=True).select("entry_id", "matched_url", "strategy")


@query("prefill_metadata", """
select x.seq, x.location, x.film_url, coalesce(x.year, f.year) as year, coalesce(x.director, f.director) as director, f.rating
from SC x left join F f on f.film_url = x.film_url
""")
def prefill_metadata(t):
    incoming = t.scraped.select("seq", "location", "film_url", "year", "director").withColumn("rating", F.lit(None).cast("double"))
    return J.prefill_metadata(incoming, t.films, ["year", "director", "rating"])


@query("authoritative_merge", """
select x.seq, x.location, coalesce(nullif(f.year, 0), x.year) as year, coalesce(f.directors[1].name, x.director) as director, case when len(f.genres) > 0 then array_to_string(f.genres, '|') else 'file' end as genres
from SC x left join F f on f.film_url = x.film_url and f.id % 4 <> 0
""")
def authoritative_merge(t):
    file_rows = t.scraped.select("seq", "location", "film_url", "year", "director", F.array(F.lit("file")).alias("genres"),
                                 F.expr("cast(array() as array<struct<id:bigint,name:string>>)").alias("directors"))
    fresh = t.films.where("film_url is not null and id % 4 <> 0").select("film_url", "year", "genres", "directors")
    return J.authoritative_merge(file_rows, fresh, "film_url", ["year", "genres", "directors"]).select(
        "seq", "location", "year", "director", F.array_join("genres", "|").alias("genres"))


@query("detail_override", """
with d as (select concat('i/', p_partkey) as url_info, case when p_partkey % 3 = 0 then concat('tk/', p_partkey) else '' end as url_tickets, case when p_partkey % 2 = 0 then p_brand end as director, '' as year from part)
select x.seq, x.location, x.url_info, coalesce(nullif(d.url_tickets, ''), x.url_tickets) as url_tickets, coalesce(d.director, x.director) as director, cast(x.year as varchar) as year from SC x left join d on d.url_info = x.url_info
""")
def detail_override(t):
    detail = t.raw("part").selectExpr("concat('i/', p_partkey) as url_info", "case when p_partkey % 3 = 0 then concat('tk/', p_partkey) else '' end as url_tickets",
                                      "case when p_partkey % 2 = 0 then p_brand end as director", "'' as year")
    return J.detail_override(t.scraped.select("seq", "location", "url_info", "url_tickets", "director", "year"), detail)


@query("session_url_lookup", """
with u as (select film_id, strftime(showtime, '%d/%m %H:%M') as slot, concat('ev/', max(seq)) as url from S where version = 'VOSE' group by all)
select S.seq, S.film_id, S.location, coalesce(u.url, S.url_tickets) as url_tickets from S left join u on u.film_id = S.film_id and u.slot = strftime(showtime, '%d/%m %H:%M')
""")
def session_url_lookup(t):
    urls = t.screenings.where("version = 'VOSE'").groupBy("film_id", F.date_format("showtime", "dd/MM HH:mm").alias("slot")).agg(
        F.concat(F.lit("ev/"), F.max("seq").cast("string")).alias("url"))
    return J.session_url_lookup(t.screenings, urls).select("seq", "film_id", "location", "url_tickets")


@query("category_gate", """
with c as (select doc_id, case when doc_id % 5 = 0 then null when lang = 'es' then ' Cine ' else lang end as category, case when doc_id % 7 = 0 then '(sesión AGOTADA)' else text end as note from documents)
select doc_id from c where (category is null or lower(trim(category)) = 'cine') and note not like '%AGOTADA%'
""")
def category_gate(t):
    cards = t.documents.select("doc_id", F.expr("case when doc_id % 5 = 0 then null when lang = 'es' then ' Cine ' else lang end").alias("category"),
                               F.expr("case when doc_id % 7 = 0 then '(sesión AGOTADA)' else text end").alias("note"))
    return J.category_gate(cards, "cine").select("doc_id")


@query("version_counterpart", """
with x as (select seq, film_id, location, version = 'VOSE' is true as o, version = 'dubbed' is true as d, coalesce(version = 'VOSE', false) as orig, coalesce(version = 'dubbed', false) as dub from S where showtime >= timestamp '2001-09-01'),
h as (select film_id, bool_or(orig) as has from x group by film_id)
select p as policy, seq, x.film_id, location, case p when 'any' then case when not orig and has then 'dubbed' end when 'marked' then case when dub and has then 'dubbed' end
 else case when orig then 'VOSE' when dub and has then 'dubbed' end end as version
from x join h on h.film_id = x.film_id cross join (values ('any'), ('marked'), ('tagged')) as pol(p)
""")
def version_counterpart(t):
    s = V.upcoming_sessions(t.screenings_from(AS_OF), AS_OF).select("seq", "film_id", "location", F.col("version").eqNullSafe("VOSE").alias("is_original"), F.col("version").eqNullSafe("dubbed").alias("is_dubbed"))
    parts = [J.version_counterpart(s, p).select(F.lit(p).alias("policy"), "seq", "film_id", "location", "version") for p in ("any", "marked", "tagged")]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


@query("label_map_join", """
with ss as (select seq, film_id, case l % 4 when 0 then 'Cine Embajadores' when 1 then 'Cine Embajadores Río' when 2 then 'Cines Embajadores' else 'Elsewhere' end as raw from (select *, cast(right(location, 3) as integer) as l from S))
select seq, film_id, 'Embajadores Glorieta' as location from ss where raw in ('Cine Embajadores', 'Cines Embajadores')
union all select seq, film_id, 'Embajadores Ercilla' from ss where raw in ('Cine Embajadores Río', 'Cines Embajadores')
union all select seq, film_id, case seq % 3 when 2 then null else 'dubbed' end from ss
""")
def label_map_join(t):
    raw = t.screenings.select("seq", "film_id", F.expr("case cast(right(location, 3) as int) % 4 when 0 then 'Cine Embajadores' when 1 then 'Cine Embajadores Río' when 2 then 'Cines Embajadores' else 'Elsewhere' end").alias("location"))
    labels = t.spark.createDataFrame(list(lookups.LOCATION_LABELS.items()), "location string, value string").unionByName(
        lookups.legacy_chains(t.spark).select(F.col("chain").alias("location"), F.col("location").alias("value")))
    places = J.label_map_join(raw, labels, "location", "value", drop_unmapped=True)
    versions = t.spark.createDataFrame(list(lookups.VERSION_LABELS.items()), "version string, value string")
    told = t.screenings.select("seq", "film_id", F.expr("case seq % 3 when 0 then 'DIGITAL' when 1 then '3D DIGITAL' else 'OTHER' end").alias("version"))
    return places.unionByName(J.label_map_join(told, versions, "version", "value", drop_unmapped=False).withColumnRenamed("version", "location"))


@query("dim_name_lookup", """
with s as (select id, top_cast[1].id as attr, (id + 1) as similar_id from F where len(top_cast) > 0),
n as (select a.id as attr, max_by(a.name, (fid, p)) as name from (select id as fid, unnest(top_cast) as a, generate_subscripts(top_cast, 1) as p from F) group by 1)
select s.id, s.similar_id, f.title, n.name, concat('https://www.themoviedb.org/person/', s.attr) as value_url from s join n on n.attr = s.attr join F f on f.id = s.similar_id
""")
def dim_name_lookup(t):
    similar = t.films.where("size(top_cast) > 0").select("id", F.lit("cast").alias("category"), F.element_at("top_cast", 1)["id"].cast("string").alias("attr"), (F.col("id") + 1).alias("similar_id"))
    return J.dim_name_lookup(similar, t.films).select("id", "similar_id", "title", "name", "value_url")


@query("translate_labels", """
with v as (select id, unnest(['genre', 'director', 'keyword', 'country']) as category,
  unnest([case id % 3 when 0 then ' Drama' when 1 then 'SCIENCE FICTION' else 'space opera' end, 'van der drama', case when id % 2 = 0 then 'science fiction' else 'new york city' end, 'germany']) as value from F),
l as (select unnest(['es', 'en']) as language)
select id, category, value, language, case when category = 'director' then value when language = 'en' or category = 'keyword' and value = 'science fiction' then
   case lower(value) when ' drama' then ' Drama' when 'science fiction' then case when category = 'genre' then 'SCIENCE FICTION' else 'Science Fiction' end when 'space opera' then 'Space Opera' when 'germany' then 'Germany' else 'New York City' end
 when category = 'keyword' then 'Nueva York' when category = 'country' then 'Alemania'
 when lower(trim(value)) = 'drama' then 'Drama' when lower(value) = 'science fiction' then 'Ciencia Ficción' else 'Space Opera' end as translated from v, l
""")
def translate_labels(t):
    rows = [("genre", "es", a, b) for a, b in lookups.GENRES_ES.items()] + [("keyword", "es", "new york city", "Nueva York"), ("country", "es", "germany", "Alemania")]
    labels = t.spark.createDataFrame(rows, "category string, language string, label string, translation string")
    values = t.films.select("id", F.explode(F.array(
        F.struct(F.lit("genre").alias("category"), F.expr("case id % 3 when 0 then ' Drama' when 1 then 'SCIENCE FICTION' else 'space opera' end").alias("value")),
        F.struct(F.lit("director").alias("category"), F.lit("van der drama").alias("value")),
        F.struct(F.lit("keyword").alias("category"), F.expr("case when id % 2 = 0 then 'science fiction' else 'new york city' end").alias("value")),
        F.struct(F.lit("country").alias("category"), F.lit("germany").alias("value")))).alias("v")).select("id", "v.*")
    parts = [J.translate_labels(values, labels, lang).withColumn("language", F.lit(lang)) for lang in ("es", "en")]
    return parts[0].unionByName(parts[1])


# --- feedback -------------------------------------------------------------------------------------------

@query("feedback_summary", """
select user_id, count(*) as watched, count(coalesce(rating, case when liked then 4.0 end)) as rated, round(avg(coalesce(rating, case when liked then 4.0 end)), 6) as mean_rating, count(*) filter (coalesce(rating, case when liked then 4.0 end) >= 5) as five_star from W group by user_id
""")
def feedback_summary(t):
    return B.feedback_summary(t.watched, liked_as=4.0).withColumn("mean_rating", F.round("mean_rating", 6))


@query("rewatch_counts", """
select cast(o_custkey as varchar) as user_id, concat('b/', l_partkey) as uri, count(*) as rewatch_count from orders join lineitem on l_orderkey = o_orderkey where l_returnflag = 'A' group by all
""")
def rewatch_counts(t):
    o, l = t.raw("orders"), t.raw("lineitem")
    diary = o.join(l, o.o_orderkey == l.l_orderkey).selectExpr("cast(o_custkey as string) as user_id", "concat('b/', l_partkey) as uri", "case l_returnflag when 'A' then ' Yes ' when 'R' then 'No' end as Rewatch")
    return B.rewatch_counts(diary).withColumn("rewatch_count", F.col("rewatch_count").cast("long"))


@query("enrichment_progress", """
with a as (select requested_by, count(*) as active from Q where status in ('pending', 'processing') and retry_count < 5 group by 1)
select cast(w.user_id as varchar) as user_id, count(*) as total, count(film_id) as processed, coalesce(max(active), 0) as active, coalesce(max(active), 0) = 0 as done from W w left join a on a.requested_by = cast(w.user_id as varchar) group by w.user_id
""")
def enrichment_progress(t):
    return B.enrichment_progress(t.watched, t.queue)


@query("user_snapshot", """
with p as (select c_custkey as user_id, case when c_custkey % 2 = 0 then 'en' end as lang, c_custkey % 3 = 0 as wa from customer where c_custkey % 5 <> 0),
x as (select user_id, 'watched' as kind, short_url as item from W union select user_id, 'watchlist', short_url from L
 union select user_id, 'scores', concat_ws(':', raw_film_id, cast(floor(rating * 20) as integer)) from W where rating is not null)
select coalesce(x.user_id, p.user_id) as user_id, kind, item, coalesce(lang, 'es') as lang, coalesce(wa, false) as watchlist_active from x full join p on p.user_id = x.user_id
""")
def user_snapshot(t):
    prefs = t.raw("customer").where("c_custkey % 5 <> 0").selectExpr("c_custkey as user_id", "case when c_custkey % 2 = 0 then 'en' end as lang", "c_custkey % 3 = 0 as watchlist_active", "false as watched_active")
    scores = t.watched.where("rating is not null").select("user_id", F.col("raw_film_id").alias("film_id"), F.floor(F.col("rating") * 20).cast("int").alias("score"))
    return B.user_snapshot(prefs, t.watched, t.watchlist, scores).select("user_id", "kind", "item", "lang", "watchlist_active")


# --- audits ---------------------------------------------------------------------------------------------

@query("integrity_audit", """
with ss as (select film_id, date_trunc('month', showtime) as m, location from S),
dup as (select film_id, m, location from ss group by all having count(*) > 1),
e as (select seq, case when seq % 31 = 0 then concat(base_title, ' + ', base_title) when seq % 37 = 0 then concat(base_title, ' by ', director) when seq % 41 = 0 then concat(base_title, '...') when seq % 43 = 0 then 'CafÃ© society' else base_title end as title, director, year, "timestamp" from SC)
select 'duplicate_session' as rule, cast(film_id as varchar) as key, concat_ws('|', strftime(m, '%Y-%m-%d %H:%M'), location) as detail from dup
union all select 'no_metadata', cast(id as varchar), title from F where rating is null and tmdb_id is null and viewers is null
union all select 'out_of_range', cast(seq as varchar), "timestamp" from e where left("timestamp", 10) < '1995-03-01' or left("timestamp", 10) > '2001-10-31'
union all select 'no_director_no_year', cast(seq as varchar), title from e where director is null and year is null
union all select 'joined_titles', cast(seq as varchar), title from e where title like '%+%'
union all select 'director_in_title', cast(seq as varchar), title from e where contains(lower(title), lower(director))
union all select 'truncated_title', cast(seq as varchar), title from e where title like '%...'
union all select 'mojibake', cast(seq as varchar), title from e where title like '%Ã%'
""")
def integrity_audit(t):
    monthly = t.screenings.withColumn("showtime", F.date_trunc("month", "showtime").cast("timestamp_ntz"))
    title = F.expr("case when seq % 31 = 0 then concat(base_title, ' + ', base_title) when seq % 37 = 0 then concat_ws('', base_title, ' by ', director) when seq % 41 = 0 then concat(base_title, '...') when seq % 43 = 0 then 'CafÃ© society' else base_title end")
    entries = t.scraped.select("seq", title.alias("title"), "director", "year", "timestamp")
    return A.integrity_audit(t.films, monthly, entries, "1995-03-01", "2001-10-31")


@query("needs_enrichment", f"""
with act as (select distinct film_id from S where showtime >= timestamp '{AS_OF}')
select 'all_missing' as variant, id from F where film_url is not null and not (rating is not null or collection_id is not null or overview is not null)
union all select 'poster', id from F where film_url is not null and poster_path is null and year >= 2000 and id in (select film_id from act)
union all select 'any_crew', id from F where film_url is not null and not (len(cinematographers) > 0 and len(composers) > 0)
union all select 'backfill', id from F where film_url is not null and id in (select film_id from act)
""")
def needs_enrichment(t):
    f = t.films
    variants = {
        "all_missing": A.needs_enrichment(f, ["rating", "collection_id", "overview"]),
        "poster": A.needs_enrichment(f, ["poster_path"], recent_years=1, this_year=2001, screenings=t.screenings_from(AS_OF), as_of=AS_OF),
        "any_crew": A.needs_enrichment(f, ["cinematographers", "composers"], any_missing=True),
        "backfill": A.needs_enrichment(f, ["rating"], backfill=True, screenings=t.screenings_from(AS_OF), as_of=AS_OF),
    }
    out = None
    for name, df in variants.items():
        part = df.select(F.lit(name).alias("variant"), "id")
        out = part if out is None else out.unionByName(part)
    return out


@query("special_session_rules", """
with e as (select seq, location, case seq % 9 when 0 then concat('Ciclo de ', base_title) when 1 then 'Sesión de cortometrajes IV' when 2 then concat(base_title, ' #', seq) when 3 then concat(director, ', ida y vuelta') when 4 then concat(base_title, ' + ', base_title) else base_title end as title,
 case when seq % 9 = 5 then 'VV.AA.' else director end as director, year from SC)
select seq, location, case when seq % 9 in (0) then 'conference' when seq % 9 = 1 then 'shorts' when title like '%#%' then 'event' when director = 'VV.AA.' then 'compilation' when seq % 9 = 3 and director is not null then 'conference'
 when title like '% + %' then 'shorts' when director is null and year is null then 'event' end as suggested_special,
 case when seq % 9 in (0) then 'prefix' when seq % 9 = 1 then 'shorts' when seq % 9 = 2 or (seq % 9 = 3 and director is not null and false) or (seq % 9 <> 5 and title like '%#%' and title not like 'Brand#%') then 'numbered'
 when title like '%#%' then 'numbered' when director = 'VV.AA.' then 'various_authors' when seq % 9 = 3 and director is not null then 'director_is_subject' when title like '% + %' then 'joined_titles' when director is null and year is null then 'no_director_no_year' end as rule from e
""")
def special_session_rules(t):
    title = F.expr("case seq % 9 when 0 then concat('Ciclo de ', base_title) when 1 then 'Sesión de cortometrajes IV' when 2 then concat(base_title, ' #', seq) when 3 then concat_ws('', director, ', ida y vuelta') when 4 then concat(base_title, ' + ', base_title) else base_title end")
    entries = t.scraped.select("seq", "location", title.alias("title"), F.expr("case when seq % 9 = 5 then 'VV.AA.' else director end").alias("director"), "year")
    return A.special_session_rules(entries).select("seq", "location", "suggested_special", "rule")


# --- queue ----------------------------------------------------------------------------------------------

QCOLS = ["id", "short_url", "status", "retry_count"]


@query("queue_enqueue", """
with ask as (select distinct short_url from W where user_id = 7 and short_url not in (select short_url from F where short_url is not null) union select concat('b/', event_id * 3) from events where concat('b/', event_id * 3) not in (select short_url from F where short_url is not null))
select q.id, coalesce(q.short_url, ask.short_url) as short_url, case when ask.short_url is not null then case when coalesce(retry_count, 0) >= 5 then 'failed' else 'pending' end
  when q.requested_by = '7' and q.status = 'pending' and retry_count >= 5 then 'failed' else q.status end as status, coalesce(retry_count, 0) as retry_count
from Q q full join ask on ask.short_url = q.short_url
""")
def queue_enqueue(t):
    urls = t.watched.where("user_id = 7").select("short_url").unionByName(t.raw("events").selectExpr("concat('b/', event_id * 3) as short_url"))
    return Q.queue_enqueue(t.queue, urls, t.films, "7", QUEUE_NOW).select(*QCOLS)


@query("queue_take_batch", f"""
with h as (select *, status = 'processing' and locked_at < timestamp '{QUEUE_NOW}' - interval 5 minutes as stale from Q),
g as (select id, short_url, retry_count, created_at, case when stale then 'pending' else status end as status from h),
b as (select id from g where status = 'pending' and retry_count < 5 and (select count(*) from Q where status = 'processing' and locked_at > timestamp '{QUEUE_NOW}' - interval 5 minutes) < 500 order by created_at, id limit 100)
select id, short_url, case when id in (select id from b) then 'processing' else status end as status, retry_count, id in (select id from b) as taken from g
""")
def queue_take_batch(t):
    out = Q.queue_take_batch(t.queue, QUEUE_NOW, size=100)
    return out.queue.select(*QCOLS, (F.coalesce(F.col("locked_at") == F.lit(QUEUE_NOW).cast("timestamp_ntz"), F.lit(False))).alias("taken"))


@query("queue_settle", """
select id, short_url, case when status <> 'processing' then status when id % 3 = 0 then 'done' when retry_count + 1 >= 5 then 'failed' else 'pending' end as status,
 case when status = 'processing' and id % 3 <> 0 then retry_count + 1 else retry_count end as retry_count from Q
""")
def queue_settle(t):
    outcomes = t.queue.where("status = 'processing'").select("id", (F.col("id") % 3 == 0).alias("ok"))
    return Q.queue_settle(t.queue, outcomes, QUEUE_NOW).select(*QCOLS)


@query("queue_retry_override", """
with o as (select concat('b/', p_partkey * 10) as short_url, concat('u/', p_partkey) as u from part)
select q.id, q.short_url, case when o.u is not null then 'pending' else status end as status, case when o.u is not null then 0 else retry_count end as retry_count, o.u as override_url, null as error from Q q left join o on o.short_url = q.short_url
union all select null, o.short_url, null, null, o.u, 'no queue entry' from o where short_url not in (select short_url from Q)
""")
def queue_retry_override(t):
    overrides = t.raw("part").selectExpr("concat('b/', p_partkey * 10) as short_url", "concat('u/', p_partkey) as override_url")
    out = Q.queue_retry_override(t.queue, overrides)
    return out.queue.select(*QCOLS, "override_url").unionByName(out.taken, allowMissingColumns=True)


@query("queue_metrics", """
select status, count(*) as n, status in ('pending', 'processing') as waiting from Q group by status
""")
def queue_metrics(t):
    return Q.queue_metrics(t.queue)


@query("queue_poll_windows", """
select strftime(time_bucket(interval 3 minutes, created_at, timestamp '1970-01-01'), '%Y-%m-%d %H:%M') as window_start, status, count(*) as n from Q group by all
""")
def queue_poll_windows(t):
    return Q.queue_poll_windows(t.queue).withColumn("window_start", F.date_format("window_start", FMT))


# --- exports --------------------------------------------------------------------------------------------

@query("event_feed", f"""
with x as (select F.*, S.seq, S.showtime, S.location, S.url_tickets, S.version from S join F on id = film_id where showtime >= timestamp '{AS_OF}' order by title, film_id, showtime, location, seq limit 200)
select id as film_id, seq, md5(concat('{{"@type":"ScreeningEvent","name":"', title, '","startDate":"', strftime(showtime, '%Y-%m-%dT%H:%M'), '","location":{{"@type":"MovieTheater","name":"', location, '"}},"workPresented":{{"@type":"Movie","name":"', title, '"',
 case when director is not null then concat(',"director":{{"@type":"Person","name":"', director, '"}}') else '' end, case when year is not null then concat(',"dateCreated":"', year, '"') else '' end,
 case when runtime_minutes > 0 then concat(',"duration":"PT', runtime_minutes, 'M"') else '' end, '}}', case when url_tickets <> '' then concat(',"offers":{{"@type":"Offer","url":"', url_tickets, '"}}') else '' end,
 case when version = 'VOSE' then ',"subtitleLanguage":"es"' else '' end, '}}')) as event from x
""")
def event_feed(t):
    return E.event_feed(t.films, t.screenings_from(AS_OF), AS_OF).withColumn("event", F.md5("event"))


@query("venue_directory", """
with a as (select s_name as location, concat('Street ', s_suppkey) as street from supplier where s_suppkey % 3 <> 0)
select v.location, street from (select distinct location from S) v left join a on a.location = v.location
""")
def venue_directory(t):
    addresses = t.raw("supplier").where("s_suppkey % 3 <> 0").selectExpr("s_name as location", "concat('Street ', s_suppkey) as street")
    return E.venue_directory(t.screenings, addresses)


@query("daily_listing_text", f"""
with up as (select *, cast(showtime as date) as day from S where showtime >= timestamp '{AS_OF}'), d as (select distinct day from up order by day limit 14),
ln as (select up.day, row_number() over (partition by up.day order by strftime(showtime, '%H:%M'), title, coalesce(director, ''), coalesce(cast(year as varchar), ''), location, coalesce(url_tickets, ''), seq, up.film_id) as position,
 concat_ws(' · ', strftime(showtime, '%H:%M'), location, concat(title, case when director is not null then concat(' — ', director) else '' end, case when year is not null then concat(' (', year, ')') else '' end)) as line from up join d on d.day = up.day join F on id = film_id)
select strftime(day, '%Y-%m-%d') as day, position, md5(line) as line,
 concat(['lunes','martes','miércoles','jueves','viernes','sábado','domingo'][isodow(day)], ' ', day(day), ' de ', ['enero','febrero','marzo','abril','mayo','junio','julio','agosto','septiembre','octubre','noviembre','diciembre'][month(day)], ' de ', year(day)) as label
from ln
""")
def daily_listing_text(t):
    return E.daily_listing_text(t.films, t.screenings_from(AS_OF), AS_OF).select(F.col("day").cast("string").alias("day"), "position", F.md5("line").alias("line"), "label")
