"""Registered streaming queries: each drains the given table as a stream and returns what it stored."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from showgrid import lookups
from showgrid.plans.bind import Dialect, Tables, queue_columns, screenings_columns
from showgrid.plans.ingest import scratch
from showgrid.plans.registry import query
from showgrid.sources.readers import stream_pages, table_pattern
from showgrid.sources.writers import BucketedTable, VersionedTable
from showgrid.streaming import jobs as J


def stream_of(t: Tables, name: str) -> DataFrame:
    return t.spark.readStream.schema(t.raw(name).schema).parquet(table_pattern(t.folder, f"{name}.parquet"))


def screening_stream(t: Tables) -> DataFrame:
    lines = stream_of(t, "lineitem")
    venues = t.raw("supplier")
    joined = lines.join(venues, lines.l_suppkey == venues.s_suppkey)
    return joined.selectExpr(*screenings_columns(Dialect(spark=True)), "cast(l_shipdate as timestamp) as seen_at")


@query("stream_ingest_sessions", """
select film_id, location, count(*) as sessions, max(seq) as last_seq from S group by all
""")
def stream_ingest_sessions(t):
    table = BucketedTable(t.spark, scratch(t, "sessions"), J.SCREENING_KEYS[::2], J.SCREENING_SCHEMA)
    J.stream_ingest_sessions(screening_stream(t), table, scratch(t, "cp"), "1990-01-01", "2010-12-31").awaitTermination()
    return table.read().groupBy("film_id", "location").agg(F.count(F.lit(1)).alias("sessions"), F.max("seq").alias("last_seq"))


@query("stream_queue_metrics", """
select strftime(time_bucket(interval 3 minutes, created_at, timestamp '1970-01-01'), '%Y-%m-%d %H:%M') as window_start, status, count(*) as n from Q group by all
""")
def stream_queue_metrics(t):
    queue = stream_of(t, "events").selectExpr(*queue_columns(Dialect(spark=True))).withColumn("created_at", F.col("created_at").cast("timestamp"))
    table = BucketedTable(t.spark, scratch(t, "metrics"), ["window_start"], J.METRICS)
    J.stream_queue_metrics(queue, table, scratch(t, "cp"), watermark="1 day").awaitTermination()
    return table.read().withColumn("window_start", F.date_format("window_start", "yyyy-MM-dd HH:mm"))


@query("stream_venue_coverage", """
select location, count(*) as sessions, strftime(cast(max(showtime) as date), '%Y-%m-%d') as last_day, count(special) as special from S group by location
""")
def stream_venue_coverage(t):
    table = BucketedTable(t.spark, scratch(t, "daily"), ["location"], J.DAILY)
    J.stream_venue_coverage(screening_stream(t), table, scratch(t, "cp")).awaitTermination()
    return J.coverage_from_daily(table.read()).withColumn("last_day", F.col("last_day").cast("string"))


@query("stream_publication_cliff", """
with daily as (select location, cast(showtime as date) as day, count(*) as n from S group by all),
b as (select *, sum(n) over (partition by location order by day rows between unbounded preceding and 1 preceding) / nullif(date_diff('day', min(day) over (partition by location), day), 0) as base from daily),
c as (select *, min(case when n < 0.5 * base then day end) over (partition by location) as cliff from b)
select location, strftime(any_value(cliff), '%Y-%m-%d') as cliff_day, strftime(coalesce(any_value(cliff) - 1, max(day)), '%Y-%m-%d') as last_full_day,
 cast(date_diff('day', min(day), coalesce(any_value(cliff) - 1, max(day))) + 1 - count(*) filter (cliff is null or day < cliff) as integer) as gap_days from c group by location
""")
def stream_publication_cliff(t):
    daily, cliffs = BucketedTable(t.spark, scratch(t, "daily"), ["location"], J.DAILY), BucketedTable(t.spark, scratch(t, "cliffs"), ["location"], J.CLIFF)
    J.stream_venue_coverage(screening_stream(t), daily, scratch(t, "cp"), cliffs).awaitTermination()
    return cliffs.read().select("location", F.col("cliff_day").cast("string").alias("cliff_day"), F.col("last_full_day").cast("string").alias("last_full_day"), "gap_days")


ITEM = '<li class="s">([^<]*)</li>'


def listing_day(item):
    """Date headed by an item like ``Domingo 07/03``."""
    return F.when(item.rlike(r"^[A-Z][a-z]+ \d\d/\d\d$"), F.to_date(F.concat(F.lit("2001-"), F.substring(item, -2, 2), F.lit("-"), F.substring(F.regexp_extract(item, r"(\d\d)/", 1), 1, 2)), "yyyy-MM-dd"))


@query("stream_page_sessions", """
with k as (select page_id as p, regexp_extract(url, '^[a-z]+://([^/?#]+)', 1) as location from pages), x as (select * from k, unnest([0, 1, 2, 3]) as t(i))
select p as film_id, location, strftime(make_date(2001, cast(case when i < 2 then p % 9 + 1 else p % 9 + 2 end as int), cast(p % 27 + 1 as int)), '%Y-%m-%d') || ' ' || lpad(cast((p + 5 * i) % 24 as varchar), 2, '0') || ':30' as showtime,
 case when i = 1 then 'VOSE' end as version from x
""")
def stream_page_sessions(t):
    """Every page gets a listing of two days with two times each, made from its id; the stream starts at the pages."""
    pages = stream_pages(t.spark, t.folder, name="pages.parquet")
    p = F.col("page_id")
    two = lambda c: F.lpad(c.cast("string"), 2, "0")
    day = lambda month: F.concat(F.lit('<li class="s">Domingo '), two(p % 27 + 1), F.lit("/"), two(month), F.lit("</li>"))
    time = lambda i, mark: F.concat(F.lit(f'<li class="s">{mark}'), two((p + 5 * i) % 24), F.lit(":30</li>"))
    listing = F.concat(F.lit('<li class="s">12:00</li>'), day(p % 9 + 1), time(0, ""), time(1, "VOSE "), F.lit('<li class="s">agotado</li>'), day(p % 9 + 2), time(2, ""), time(3, ""))
    pages = pages.withColumn("html", F.concat("html", listing)).withColumn("seen_at", F.current_timestamp())
    table = BucketedTable(t.spark, scratch(t, "page-sessions"), J.SCREENING_KEYS[::2], J.SCREENING_SCHEMA)
    J.stream_page_sessions(pages, table, scratch(t, "cp"), ITEM, listing_day, "2001-01-01", "2001-12-31").awaitTermination()
    return table.read().select("film_id", "location", F.date_format("showtime", "yyyy-MM-dd HH:mm").alias("showtime"), "version")


@query("stream_resolve_ids", """
select user_id, short_url, film_id from W
""")
def stream_resolve_ids(t):
    table = BucketedTable(t.spark, scratch(t, "feedback"), ["short_url"], "user_id long, short_url string, film_id long")
    table.merge(t.watched.select("user_id", "short_url", F.lit(None).cast("long").alias("film_id")), lambda stored, new: stored.unionByName(new))
    films = stream_of(t, "part").selectExpr("p_partkey as id", "case when p_partkey % 13 <> 0 then concat('b/', p_partkey) end as short_url")
    J.stream_resolve_ids(films, table, scratch(t, "cp")).awaitTermination()
    return table.read().select("user_id", "short_url", "film_id")


@query("queue_stream_state", f"""
with recursive e as materialized (select concat('u/', user_id) as k, cast(ts as timestamp) as tm, row_number() over (partition by user_id order by ts, event_id, a) as n, a
 from (select *, case event_type when 'signup' then 'request' when 'view' then 'request' when 'click' then 'take' when 'purchase' then 'ok' else 'fail' end as a from events) where ts is not null),
s as (select k, 0::bigint as n, null::varchar as status, 0 as retries, null::timestamp as locked, null::timestamp as tm, null::varchar as cause from (select distinct k from e)
 union all select k, n, case when not ok then status when a = 'take' then 'processing' when a = 'ok' then 'done' when a = 'request' then case when retries >= {lookups.MAX_RETRIES} then 'failed' else 'pending' end
   when retries + 1 >= {lookups.MAX_RETRIES} then 'failed' else 'pending' end,
  case when ok and a = 'fail' then retries + 1 else retries end, case when not ok then locked when a = 'take' then tm end, tm, case when ok then a end
 from (select *, coalesce(case a when 'request' then coalesce(now_status, 'done') in ('done', 'failed') when 'take' then now_status = 'pending' and retries < {lookups.MAX_RETRIES} else now_status = 'processing' end, false) as ok
  from (select s.k, e.n, e.tm, e.a, s.status, s.retries, s.locked, case when s.status = 'processing' and e.tm - s.locked > interval {lookups.LEASE_MINUTES} minutes then 'pending' else s.status end as now_status
   from s join e on e.k = s.k and e.n = s.n + 1))),
z as (select k, max_by(status, n) as status, max_by(retries, n) as retries, max(tm) filter (cause = 'take') as locked from s group by k)
select k as short_url, strftime(tm, '%Y-%m-%d %H:%M:%S.%f') as "at", status, retries as retry_count, cause from s where cause is not null
union all select k, strftime(locked + interval {lookups.LEASE_MINUTES} minutes, '%Y-%m-%d %H:%M:%S.%f'), 'pending', retries, 'lease expired' from z where status = 'processing'
""")
def queue_stream_state(t):
    """Every event moves the queue entry of its user: signup requests, click takes, purchase and error settle; leases still open at the end run out by their timers."""
    events = stream_of(t, "events").selectExpr(
        "concat('u/', user_id) as short_url", "event_id", "cast(ts as timestamp) as at",
        "case event_type when 'signup' then 'request' when 'view' then 'request' when 'click' then 'take' when 'purchase' then 'ok' else 'fail' end as action")
    table = VersionedTable(t.spark, scratch(t, "transitions"))

    def write(batch, batch_id):
        table.write(table.read(J.CHANGE).unionByName(batch), tag=f"batch{batch_id}")

    J.start_queue(J.queue_stream_state(events), write, scratch(t, "cp")).awaitTermination()
    return table.read().withColumn("at", F.date_format("at", "yyyy-MM-dd HH:mm:ss.SSSSSS"))
