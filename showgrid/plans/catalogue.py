"""Registered catalogue queries: filters, joins, facets, statistics, order and pages."""

from __future__ import annotations

from pyspark.sql import functions as F

from showgrid import lookups
from showgrid.operators import serving as V
from showgrid.plans.bind import AS_OF, Tables
from showgrid.plans.registry import query

T = f"timestamp '{AS_OF}'"
FMT = "yyyy-MM-dd HH:mm"


def stamp(c):
    return F.date_format(c, FMT)


@query("whats_on", f"""
with u as (select film_id, count(*) as sessions, min(showtime) as nxt from S where showtime >= {T} group by film_id)
select id, title, rating, sessions, strftime(nxt, '%Y-%m-%d %H:%M') as next_showtime
from F join u on id = film_id order by rating desc nulls last, case when rating is null then title end, id limit 30
""")
def whats_on(t: Tables):
    per_film = V.upcoming_sessions(t.screenings_from(AS_OF), AS_OF).groupBy("film_id").agg(
        F.count(F.lit(1)).alias("sessions"), F.min("showtime").alias("next"))
    joined = t.films.join(per_film, F.col("id") == F.col("film_id"))
    return V.catalogue_page(joined, 30).select("id", "title", "rating", "sessions", stamp("next").alias("next_showtime"))


@query("date_range_sessions", """
select film_id, seq, location, strftime(showtime, '%Y-%m-%d %H:%M') as showtime from S
where cast(showtime as date) between date '2001-06-01' and date '2001-06-30'
""")
def date_range(t):
    return V.date_range_sessions(t.screenings, "2001-06-01", "2001-06-30").select(
        "film_id", "seq", "location", stamp("showtime").alias("showtime"))


@query("upcoming_sessions", f"""
select 'instant' as granularity, film_id, count(*) as sessions from S where showtime >= timestamp '2001-09-01 15:00:00' group by film_id
union all
select 'day', film_id, count(*) from S where showtime >= date_trunc('day', timestamp '2001-09-01 15:00:00') group by film_id
""")
def upcoming(t):
    def counts(g):
        return V.upcoming_sessions(t.screenings_from("2001-09-01 00:00:00"), "2001-09-01 15:00:00", g).groupBy("film_id").agg(
            F.count(F.lit(1)).alias("sessions")).withColumn("granularity", F.lit(g))
    return counts("instant").unionByName(counts("day"))


@query("session_filters", f"""
with up as (select * from S where showtime >= {T}),
orig as (select distinct film_id from up where coalesce(version, '') <> 'dubbed'),
fl as (select id, len(list_filter(primary_language, lambda l: l in ('es', 'Spanish'))) > 0 as spanish from F)
select up.film_id, up.seq, up.location, orig.film_id is not null as has_original_version
from up join fl on fl.id = up.film_id left join orig on orig.film_id = up.film_id
where isodow(showtime) in (5, 6, 7) and (spanish or coalesce(version, '') <> 'dubbed')
""")
def session_filters(t):
    up = V.upcoming_sessions(t.screenings_from(AS_OF), AS_OF)
    return V.session_filters(t.films, up, version="original", weekdays=[4, 5, 6]).select(
        "film_id", "seq", "location", "has_original_version")


@query("session_filters_dubbed", f"""
with up as (select * from S where showtime >= {T}),
fl as (select id, len(list_filter(primary_language, lambda l: l in ('es', 'Spanish'))) > 0 as spanish from F)
select up.film_id, up.seq from up join fl on fl.id = up.film_id
where location in (select s_name from supplier where s_nationkey < 12)
  and (spanish or version = 'dubbed') and cast(showtime as date) = date '2001-09-20'
""")
def session_filters_dubbed(t):
    # venue choices of a page are a table here, so they are a semi join rather than a literal list
    venues = t.raw("supplier").where("s_nationkey < 12").select(F.col("s_name").alias("location"))
    up = V.upcoming_sessions(t.screenings_from(AS_OF), AS_OF).join(venues, "location", "left_semi")
    return V.session_filters(t.films, up, day="2001-09-20", version="dubbed").select("film_id", "seq")


@query("film_filters", f"""
with a as (select distinct film_id from S where showtime >= {T}),
sp as (select distinct film_id from S where showtime >= {T} and special is not null)
select id, title from F where id in (select film_id from a) and id in (select film_id from sp)
  and list_has_any(genres, ['ECONOMY', 'SMALL', 'PROMO', 'G0', 'G4'])
  and list_has_any(country, ['Country0', 'Country1', 'Country2', 'Country3', 'UK'])
  and (year between 1960 and 1969 or year between 1990 and 1999 or year between 2000 and 2009)
  and (runtime_minutes between 60 and 89 or runtime_minutes between 120 and 179)
  and (lower(strip_accents(title)) like '%ol%' or lower(strip_accents(coalesce(title_en, ''))) like '%ol%' or lower(strip_accents(coalesce(director, ''))) like '%ol%')
""")
def film_filters(t):
    up = V.upcoming_sessions(t.screenings_from(AS_OF), AS_OF)
    chosen = V.film_filters(
        t.films, search="ÓL", genres=["ECONOMY", "SMALL", "PROMO", "G0", "G4"],
        countries=["Country0", "Country1", "Country2", "Country3", "UK"],
        decades=[(1960, 1969), (1990, 1999), (2000, 2009)], runtimes=[1, 3])
    return V.special_only(chosen.join(up, chosen.id == up.film_id, "left_semi"), up).select("id", "title")


@query("title_search", """
select id, title from F where lower(title) like '%gizmo%' order by id limit 20
""")
def title_search(t):
    return V.title_search(t.films, "Gizmo").select("id", "title")


@query("films_with_screenings", f"""
select id, title, seq, location from F join S on id = film_id where showtime >= {T}
""")
def films_with_screenings(t):
    return V.films_with_screenings(t.films, t.screenings_from(AS_OF), AS_OF).select("id", "title", "seq", "location")


@query("films_overview", """
select id, title, year, count(film_id) as screening_count,
  strftime(min(showtime), '%Y-%m-%d %H:%M') as first_screening, strftime(max(showtime), '%Y-%m-%d %H:%M') as last_screening
from F left join S on film_id = id group by id, title, year
""")
def films_overview(t):
    return V.films_overview(t.films, t.screenings).select(
        "id", "title", "year", "screening_count", stamp("first_screening").alias("first_screening"),
        stamp("last_screening").alias("last_screening"))


@query("watchlist_semi_join", """
select f.id, f.short_url from F f where f.short_url in (select short_url from L where user_id = 7)
""")
def watchlist_semi_join(t):
    return V.watchlist_semi_join(t.films, t.watchlist, 7).select("id", "short_url")


@query("unwatched_anti_join", """
select f.id from F f where f.short_url is null
  or not exists (select 1 from W w where w.user_id = 7 and w.short_url = f.short_url)
""")
def unwatched_anti_join(t):
    return V.unwatched_anti_join(t.films, t.watched, 7).select("id")


@query("facet_values", f"""
with a as (select * from F where id in (select film_id from S where showtime >= {T}))
select 'genres' as facet, v as value, count(*) as films from (select id, unnest(list_distinct(genres)) as v from a) group by v
union all
select 'country', v, count(*) from (select id, unnest(list_distinct(country)) as v from a) group by v
union all
select 'primary_language', v, count(*) from (select id, unnest(list_distinct(primary_language)) as v from a) group by v
""")
def facet_values(t):
    parts = [V.facet_values(t.films, t.screenings_from(AS_OF), f, AS_OF).withColumn("facet", F.lit(f))
             for f in ("genres", "country", "primary_language")]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


@query("facet_decades", f"""
with d as (select distinct year // 10 * 10 as d from F where year is not null and id in (select film_id from S where showtime >= {T}))
select distinct case when d < 1920 then '< 20s' else concat(d, 's') end as label,
  case when d < 1920 then 0 else d end as "start", case when d < 1920 then 1919 else d + 9 end as "end" from d
""")
def facet_decades(t):
    return V.facet_decades(t.films, t.screenings_from(AS_OF), AS_OF)


@query("headline_stats", """
select count(distinct film_id) as films, count(distinct case when coalesce(location, 'Unknown') <> 'Unknown' then location end) as venues
from S join F on id = film_id
""")
def headline_stats(t):
    return V.headline_stats(t.films, t.screenings)


@query("year_bounds", f"""
select min(year) as min_year, max(year) as max_year from F where id in (select film_id from S where showtime >= {T})
""")
def year_bounds(t):
    return V.year_bounds(t.films, t.screenings_from(AS_OF), AS_OF)


@query("last_chance", """
select 'instant' as mode, film_id from S where showtime >= timestamp '2001-10-25 15:00:00' group by film_id
having max(showtime) <= timestamp '2001-10-28 15:00:00'
union all
select 'calendar', film_id from S where showtime >= timestamp '2001-10-25 00:00:00' group by film_id
having max(showtime) <= timestamp '2001-10-28 23:59:59'
""")
def last_chance(t):
    now = "2001-10-25 15:00:00"
    parts = [V.last_chance(t.screenings_from("2001-10-25 00:00:00"), now, m).select(F.lit(m).alias("mode"), "film_id") for m in ("instant", "calendar")]
    return parts[0].unionByName(parts[1])


@query("venue_coverage", """
with c as (select location, count(*) as sessions, cast(max(showtime) as date) as d, count(special) as special from S group by location)
select location, sessions, strftime(d, '%Y-%m-%d') as last_day, special from c
union all
select null, cast(sum(sessions) as bigint), strftime(max(d), '%Y-%m-%d'), cast(sum(special) as bigint) from c
""")
def venue_coverage(t):
    return V.coverage_with_total(V.venue_coverage(t.screenings)).withColumn("last_day", F.col("last_day").cast("string"))


@query("publication_cliff", """
with n as (select location, cast(showtime as date) as day, count(*) as n from S group by all),
sp as (select location, min(day) as a, max(day) as b from n group by location),
cal as (select location, cast(unnest(generate_series(a, b, interval 1 day)) as date) as day from sp),
f as (select cal.location, cal.day, coalesce(n.n, 0) as n from cal left join n on n.location = cal.location and n.day = cal.day),
m as (select *, avg(n) over (partition by location order by day rows between unbounded preceding and 1 preceding) as base from f),
c as (select location, min(case when n > 0 and n < 0.5 * base then day end) as cliff, max(day) as last from m group by location)
select c.location, strftime(cliff, '%Y-%m-%d') as cliff_day, strftime(coalesce(cliff - interval 1 day, last), '%Y-%m-%d') as last_full_day,
  count(*) filter (f.n = 0 and f.day <= coalesce(cliff - interval 1 day, last)) as gap_days
from c join f on f.location = c.location group by c.location, cliff, last
""")
def publication_cliff(t):
    return V.publication_cliff(t.screenings).withColumn("cliff_day", F.col("cliff_day").cast("string")).withColumn(
        "last_full_day", F.col("last_full_day").cast("string"))


@query("daily_film_counts", """
with strip as (select cast(unnest(generate_series(date '2001-10-29', date '2001-11-04', interval 1 day)) as date) as day),
grid as (select cast(unnest(generate_series(date '2001-10-29', date '2001-12-09', interval 1 day)) as date) as day),
c as (select cast(showtime as date) as day, count(distinct film_id) as films from S group by 1)
select 'strip' as view, strftime(strip.day, '%Y-%m-%d') as day, coalesce(films, 0) as films from strip left join c on c.day = strip.day
union all
select 'grid', strftime(grid.day, '%Y-%m-%d'), coalesce(films, 0) from grid left join c on c.day = grid.day
""")
def daily_film_counts(t):
    strip = V.daily_film_counts(t.screenings, "2001-10-29", 7).withColumn("view", F.lit("strip"))
    grid = V.month_grid(t.screenings, "2001-11-04").withColumn("view", F.lit("grid"))
    return strip.unionByName(grid).withColumn("day", F.col("day").cast("string"))


@query("url_references", f"""
with long as (select film_id, showtime, location, url_tickets as url from S where showtime >= {T}
  union all select film_id, showtime, location, url_info from S where showtime >= {T}),
r as (select distinct url, title, showtime, location from long join F on id = film_id where coalesce(url, '') <> '')
select url, count(*) as "references", strftime(min(showtime), '%Y-%m-%d %H:%M') as first_showtime from r group by url
""")
def url_references(t):
    return V.url_references(t.films, t.screenings_from(AS_OF), AS_OF).withColumn("first_showtime", stamp("first_showtime"))


@query("broken_urls", f"""
with long as (select film_id, showtime, location, url_tickets as url from S where showtime >= {T}
  union all select film_id, showtime, location, url_info from S where showtime >= {T}),
r as (select distinct url, title, showtime, location from long join F on id = film_id where coalesce(url, '') <> ''),
c as (select url, count(*) as n from r group by url),
st as (select distinct concat('i/', p_partkey) as url, case when p_size % 5 = 0 then 404 else 200 end as status from part)
select c.url, n as "references", status from c join st on st.url = c.url where status <> 200
""")
def broken_urls(t):
    status = t.raw("part").selectExpr("concat('i/', p_partkey) as url", "case when p_size % 5 = 0 then 404 else 200 end as status")
    return V.broken_urls(V.url_references(t.films, t.screenings_from(AS_OF), AS_OF), status).select("url", "references", "status")


@query("location_summary", """
with g as (select s_name as location, concat('Group ', s_nationkey) as venue_group from supplier where s_nationkey < 20),
x as (select film_id, count(distinct S.location) as n, count(distinct case when venue_group is not null then S.location end) as k,
  min(venue_group) as a, max(venue_group) as b, min(S.location) as place, min(showtime) as f, max(showtime) as l
  from S left join g on g.location = S.location group by film_id)
select film_id, case when k = n and a = b then a when n = 1 then place else concat(n, ' venues') end as label,
  strftime(f, '%Y-%m-%d') as from_day, strftime(l, '%Y-%m-%d') as to_day from x
""")
def location_summary(t):
    groups = t.raw("supplier").where("s_nationkey < 20").selectExpr("s_name as location", "concat('Group ', s_nationkey) as venue_group")
    return V.location_summary(t.screenings, groups).withColumn("from_day", F.col("from_day").cast("string")).withColumn(
        "to_day", F.col("to_day").cast("string"))


PLACE = "case cast(right(location, 3) as int) % 5 when 0 then 'Princesa' when 1 then 'Golem' when 2 then 'Cinesa Xanadu' when 3 then 'Yelmo Ideal' else location end"


@query("sessions_by_venue_day", f"""
with v as (select *, {PLACE} as place from S where showtime >= {T}),
o as (select *, case place when 'Princesa' then 5 when 'Golem' then 4 when 'Cinesa Xanadu' then 10 when 'Yelmo Ideal' then 11 else 999 end as vo from v)
select 'venue' as mode, seq, film_id, vo as venue_order, row_number() over (order by vo, place, cast(showtime as date), showtime, film_id, seq) as position from o
union all select 'day', seq, film_id, vo, row_number() over (order by cast(showtime as date), showtime, vo, place, film_id, seq) from o
""")
def sessions_by_venue_day(t):
    """Both listings over venues of which most have a place in the display order."""
    named = V.upcoming_sessions(t.screenings_from(AS_OF), AS_OF).withColumn("location", F.expr(PLACE))
    parts = [V.sessions_by_venue_day(named, mode).select(F.lit(mode).alias("mode"), "seq", "film_id", "venue_order", "position") for mode in ("venue", "day")]
    return parts[0].unionByName(parts[1])


@query("next_session", f"""
select film_id, strftime(showtime, '%Y-%m-%d %H:%M') as next_showtime, location as next_location, n - 1 as rest from (
 select *, row_number() over (partition by film_id order by showtime, location, seq) as r, count(*) over (partition by film_id) as n
 from S where showtime >= {T}) where r = 1
""")
def next_session(t):
    return V.next_session(t.screenings_from(AS_OF), AS_OF).withColumn("next_showtime", stamp("next_showtime"))


@query("first_days_per_venue", f"""
select seq, film_id, location from (select *, dense_rank() over (partition by location order by cast(showtime as date)) as r
 from S where showtime >= {T}) where r <= 3
""")
def first_days_per_venue(t):
    return V.first_days_per_venue(t.screenings_from(AS_OF), AS_OF).select("seq", "film_id", "location")


@query("rank_catalog", """
select id, 'rating' as by, row_number() over (order by rating desc nulls last, case when rating is null then title end, id) as rank from F
union all
select id, 'viewers', row_number() over (order by coalesce(viewers, -1) desc, rating desc nulls last, case when rating is null then title end, id) from F
""")
def rank_catalog(t):
    films = t.films.select("id", "title", "rating", "viewers")
    parts = [V.rank_catalog(films, by=b).select("id", F.lit(b).alias("by"), "rank") for b in ("rating", "viewers")]
    return parts[0].unionByName(parts[1])


@query("paginate", """
with r as (select id, title, row_number() over (order by rating desc nulls last, case when rating is null then title end, id) as rank from F)
select id, title, rank, greatest((select count(*) from F) - 80, 0) as remaining from r where rank <= 80
""")
def paginate(t):
    ranked = V.rank_catalog(t.films.select("id", "title", "rating", "viewers"))
    return V.paginate(ranked, page=2, columns=4).select("id", "title", "rank", "remaining")


@query("complement_selection", """
select distinct s_name as location from supplier where s_name not in ('Supplier#000000001', 'Supplier#000000005')
""")
def complement_selection(t):
    return V.complement_selection(t.raw("supplier").selectExpr("s_name as location"), ["Supplier#000000001", "Supplier#000000005"])


@query("candidate_universe", f"""
with u as (select distinct film_id from S where showtime >= {T}),
x as (select user_id, film_id, false as s from W where film_id is not null
 union all select user_id, u.film_id, true from (select distinct user_id from W where film_id is not null) cross join u)
select user_id, film_id, bool_or(s) as is_screened from x group by all
""")
def candidate_universe(t):
    from showgrid.operators.recommend import universe

    watched = t.watched.where("film_id is not null").select("user_id", "film_id")
    screened = V.upcoming_sessions(t.screenings_from(AS_OF), AS_OF).select("film_id").distinct()
    return universe(watched, screened)


@query("dedup_first", """
select location, film_id, first_seq, last_seq from (select location, film_id, min(seq) as first_seq, max(seq) as last_seq from S group by all)
""")
def dedup_first(t):
    s = t.screenings.select("location", "film_id", "seq", "version")
    a = V.dedup_first(s, ["location", "film_id"], ["seq"]).select("location", "film_id", F.col("seq").alias("first_seq"))
    b = V.dedup_last(s, ["location", "film_id"], ["seq"]).select("location", "film_id", F.col("seq").alias("last_seq"))
    return a.join(b, ["location", "film_id"])


@query("venue_groups_lookup", """
with v as (select s_name, s_suppkey % 5 as k from supplier)
select s_name, case k when 0 then 'Princesa' when 1 then 'Golem' when 2 then 'Cinesa Xanadu' when 3 then 'Yelmo Ideal' else 'Nowhere' end as location,
  case k when 0 then 'Renoir' when 2 then 'Cinesa' when 3 then 'Yelmo' end as venue_group,
  case k when 0 then 5 when 1 then 4 when 2 then 10 when 3 then 11 else 999 end as venue_order from v
""")
def venue_groups_lookup(t):
    venues = t.raw("supplier").selectExpr(
        "s_name", "case s_suppkey % 5 when 0 then 'Princesa' when 1 then 'Golem' when 2 then 'Cinesa Xanadu' "
        "when 3 then 'Yelmo Ideal' else 'Nowhere' end as location")
    return venues.join(lookups.venue_groups(t.spark), "location", "left").withColumn("venue_order", V.venue_order(F.col("location")))
