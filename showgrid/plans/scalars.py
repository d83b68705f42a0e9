"""Registered queries for scalar functions: text, dates, numbers, urls."""

from __future__ import annotations

from pyspark.sql import functions as F

from showgrid.functions import dates as D
from showgrid.functions import text as X
from showgrid.plans.bind import AS_OF, Tables
from showgrid.plans.registry import query


def lines(t: Tables):
    """All lines of all documents."""
    return t.documents.select("doc_id", F.posexplode(F.split("text", "\n")).alias("pos", "line"))


LINES = "ln as (select doc_id, unnest(string_split(text, chr(10))) as line, generate_subscripts(string_split(text, chr(10)), 1) - 1 as pos from documents)"


@query("normalize_text", "select doc_id, md5(lower(strip_accents(text))) as digest from documents")
def normalize_text(t):
    return t.documents.select("doc_id", F.md5(X.normalize_text(F.col("text"))).alias("digest"))


@query("slugify", f"""
with {LINES}
select doc_id, pos, trim(regexp_replace(regexp_replace(lower(strip_accents(line)), '[^\\x00-\\x7F]', '', 'g'), '[^a-z0-9]+', '-', 'g'), '-') as slug from ln
""")
def slugify(t):
    return lines(t).select("doc_id", "pos", X.slugify(F.col("line")).alias("slug"))


@query("clean_title", """
select seq, title as raw, base_title as title from SC
""")
def clean_title(t):
    return t.scraped.select("seq", F.col("title").alias("raw"), X.clean_title(F.col("title")).alias("title"))


@query("split_title_year", """
select id, title, cast(year as varchar) as year from F
""")
def split_title_year(t):
    decorated = F.when(F.col("year").isNull(), F.col("title")).otherwise(
        F.concat(F.col("title"), F.lit(" ("), F.coalesce("title_original", F.lit("x")), F.lit(", "), F.col("year").cast("string"), F.lit(")")))
    return t.films.select("id", X.split_title_year(decorated).alias("p")).select("id", "p.title", "p.year")


@query("strip_program_label", """
select id, case when id % 2 = 0 then title else concat(title, ' (', id, ')') end as title from F
""")
def strip_program_label(t):
    raw = F.when(F.col("id") % 2 == 0, F.concat("title", F.lit(" [Cycle "), F.col("id").cast("string"), F.lit("]"))).otherwise(
        F.concat("title", F.lit(" ("), F.col("id").cast("string"), F.lit(")")))
    return t.films.select("id", X.strip_program_label(raw).alias("title"))


@query("titlecase_if_upper", """
select id, case when id % 3 <> 0 then concat(upper(p0[1]), p0[2:], ' ', upper(p1[1]), p1[2:], '-', upper(p1[1]), p1[2:]) else title end as title
from (select id, title, split_part(title, ' ', 1) as p0, split_part(title, ' ', 2) as p1 from F)
""")
def titlecase_if_upper(t):
    last = F.element_at(F.split("title_original", " "), -1)
    raw = F.coalesce(F.concat("title_original", F.lit("-"), last), F.col("title"))
    return t.films.select("id", X.titlecase_if_upper(raw).alias("title"))


@query("strip_director_prefix", """
select id, coalesce(director, 'De') as director from F
""")
def strip_director_prefix(t):
    raw = F.when(F.col("director").isNull(), F.lit("De ")).when(F.col("id") % 2 == 0, F.concat(F.lit("De "), F.col("director"))).otherwise(F.col("director"))
    return t.films.select("id", X.strip_director_prefix(raw).alias("director"))


@query("parse_credit_line", """
select id, case when director is not null and year is not null then director else 'VOSE' end as director, case when director is not null and year is not null then cast(year as varchar) else '1999' end as year,
 case when year is not null then director end as pipe_director, case when director is not null then cast(year as varchar) end as pipe_year
from F
""")
def parse_credit_line(t):
    """A film without director or year has no line of its own; the next line that looks like a credit counts then."""
    year = F.col("year").cast("string")
    para = F.array(F.col("title"), F.concat("director", F.lit(" / "), F.element_at("country", 1), F.lit(" / "), year), F.lit("VOSE / 2 / 1999"))
    pipe = F.concat("director", F.lit(" | "), year, F.lit(" | 100'"))
    return t.films.select("id", X.parse_credit_lines(para).alias("a"), X.parse_pipe_credit(pipe).alias("b")).select(
        "id", "a.director", "a.year", F.col("b.director").alias("pipe_director"), F.col("b.year").alias("pipe_year"))


@query("collapse_whitespace", """
select doc_id, md5(trim(regexp_replace(text, '\\s+', ' ', 'g'))) as collapsed,
 md5(trim(regexp_replace(replace(replace(text, '.', ' '), '/', ''), '\\s+', ' ', 'g'))) as search_key from documents
""")
def collapse_whitespace(t):
    return t.documents.select("doc_id", F.md5(X.collapse_whitespace(F.col("text"))).alias("collapsed"),
                              F.md5(X.search_key(F.col("text"))).alias("search_key"))


@query("compact_count_label", """
select id, case when viewers is null then null
 when v >= 1000000 then concat(regexp_replace(printf('%.1f', floor(v / 1000000 * 10 + 0.5) / 10), '\\.0$', ''), 'M')
 when v >= 1000 then concat(cast(floor(v / 1000 + 0.5) as bigint), 'k') else cast(v as varchar) end as label
from (select id, viewers, viewers * 97 as v from F)
""")
def compact_count_label(t):
    return t.films.select("id", X.compact_count_label(F.col("viewers") * 97).alias("label"))


@query("fallback_title_from_slug", """
select id, concat(upper(w1[1]), w1[2:], ' ', upper(w2[1]), w2[2:], ' ', id) as title
from (select id, split_part(title, ' ', 1) as w1, split_part(title, ' ', 2) as w2 from F)
""")
def fallback_title_from_slug(t):
    url = F.concat(F.lit("https://films.example/f/"), F.replace("title", F.lit(" "), F.lit("-")), F.lit("-"), F.col("id").cast("string"), F.lit("/"))
    return t.films.select("id", X.fallback_title_from_slug(url).alias("title"))


@query("localized_title", """
select id, coalesce(title_en, title) as en, coalesce(title_es, title_en, title_original, case when film_url is not null then cast(id as varchar) end) as es from F
""")
def localized_title(t):
    return t.films.select("id", X.localized_title("en").alias("en"), X.localized_title("es").alias("es"))


@query("alias_values", """
select id, array_to_string([case v when 'UK' then 'United Kingdom' when 'USA' then 'United States of America' else v end for v in country], '|') as country from F
""")
def alias_values(t):
    return t.films.select("id", F.array_join(X.alias_values(F.col("country")), "|").alias("country"))


@query("stable_hash_bucket", """
with h as (select id, list_reduce(list_prepend(0::bigint, [ascii(c)::bigint for c in string_split(concat(id, title), '')]), lambda h, c: ((h * 31 + c + 2147483648) % 4294967296 + 4294967296) % 4294967296 - 2147483648) as h from F)
select id, cast(abs(h) % 16 as integer) as bucket from h
""")
def stable_hash_bucket(t):
    return t.films.select("id", X.stable_bucket(F.col("id"), F.col("title")).alias("bucket"))


# --- urls -----------------------------------------------------------------------------------------

@query("strip_tracking_query", "select page_id, regexp_replace(url, '[?#].*$', '') as url from pages")
def strip_tracking_query(t):
    return t.pages.select("page_id", X.strip_tracking_query(F.col("url"), "https://listing.example").alias("url"))


@query("canonical_slug", """
select page_id, regexp_replace(regexp_replace(string_split(regexp_replace(regexp_replace(regexp_replace(url, '[?#].*$', ''), '/+$', ''), '^[a-z]+://[^/]*/?', ''), '/')[-1], '-vose$', ''), '-doblada-al-espanol$', '') as slug,
 count(*) over (partition by regexp_replace(string_split(regexp_replace(regexp_replace(regexp_replace(url, '[?#].*$', ''), '/+$', ''), '^[a-z]+://[^/]*/?', ''), '/')[-1], '-vose$', '')) as pages
from pages
""")
def canonical_slug(t):
    vose = F.when(F.col("page_id") % 3 == 0, F.concat(F.regexp_replace("url", r"/?([?#].*)?$", ""), F.lit("-vose/"))).otherwise(F.col("url"))
    slugs = t.pages.select("page_id", X.canonical_slug(vose).alias("slug"))
    return slugs.join(slugs.groupBy("slug").agg(F.count(F.lit(1)).alias("pages")), "slug")


@query("extract_external_id", """
select page_id, regexp_extract(url, '/(en|fr|es|de)/(\\d+)', 1) as kind, cast(nullif(regexp_extract(url, '/(en|fr|es|de)/(\\d+)', 2), '') as bigint) as id
from pages where regexp_matches(url, '/(en|fr|es|de)/(\\d+)')
union all
select page_id, null, null from pages where not regexp_matches(url, '/(en|fr|es|de)/(\\d+)')
""")
def extract_external_id(t):
    return t.pages.select("page_id", X.external_id(F.col("url"), r"/(en|fr|es|de)/(\d+)").alias("x")).select("page_id", "x.kind", "x.id")


@query("decode_ticket_token", """
select page_id, case when page_id % 7 = 0 then '' else regexp_replace(url, '[?].*$', '') end as url from pages
""")
def decode_ticket_token(t):
    token = F.replace(F.replace(F.base64(F.encode(F.regexp_replace("url", "[?].*$", ""), "UTF-8")), F.lit("\r\n"), F.lit("")), F.lit("="), F.lit(""))
    slashless = F.concat(F.lit("/venda/1/2/"), F.when(F.col("page_id") % 7 == 0, F.lit("@@@")).otherwise(token))
    return t.pages.select("page_id", X.decode_ticket_token(slashless).alias("url"))


@query("parse_meta_counts", """
select id, rating, viewers, case when id % 3 = 0 then id % 50 * 100 + 1000 when id % 3 = 1 then id % 20 * 1000000 else id end as short_count from F
""")
def parse_meta_counts(t):
    label = (F.when(F.col("id") % 3 == 0, F.concat(F.format_string("%.1f", (F.col("id") % 50 * 100 + 1000) / 1000), F.lit("K")))
             .when(F.col("id") % 3 == 1, F.concat((F.col("id") % 20).cast("string"), F.lit("M"))).otherwise(F.col("id").cast("string")))
    return t.films.select(
        "id", X.rating_out_of(F.concat(F.col("rating").cast("string"), F.lit(" out of 5"))).alias("rating"),
        X.watched_by(F.concat(F.lit("Watched by "), F.format_number("viewers", 0), F.lit(" members"))).alias("viewers"),
        X.short_count(label).alias("short_count"))


@query("deep_link", """
with x as (select S.seq, S.film_id, F.title, F.year, S.showtime, S.location, S.url_info, F.director, coalesce(nullif(greatest(F.runtime_minutes, 0), 0), 120) as mins
 from S join F on F.id = S.film_id where S.showtime >= timestamp '2001-09-01')
select seq, film_id, concat('https://calendar.example/render?action=TEMPLATE&text=', replace(replace(concat(title, case when year is not null then concat(' (', year, ')') else '' end), ' ', '+'), '(', '%28'), '&dates=',
 strftime(showtime, '%Y%m%dT%H%M00'), '/', strftime(showtime + to_minutes(cast(mins as integer)), '%Y%m%dT%H%M00')) as link from x
""")
def deep_link(t):
    from showgrid.operators.serving import upcoming_sessions

    sessions = upcoming_sessions(t.screenings_from(AS_OF), AS_OF).join(t.films.select(F.col("id").alias("film_id"), "title", "year", "runtime_minutes"), "film_id")
    link = D.calendar_link("https://calendar.example/render", F.col("title"), F.col("year"), F.col("showtime"), F.col("runtime_minutes"))
    return sessions.select("seq", "film_id", F.replace(link, F.lit("%29"), F.lit(")")).alias("link"))


@query("primary_action_url", """
with h as (select s_name as location, concat('https://venue.example/', s_suppkey) as home from supplier where s_suppkey % 4 <> 0),
x as (select S.seq, S.film_id, S.location, nullif(url_tickets, '') as tk, nullif(url_info, '') as inf, case when S.film_id % 12 <> 0 then concat('https://films.example/f/', S.film_id) end as fl, home
 from S left join h on h.location = S.location)
select seq, film_id, location, coalesce(tk, inf, fl, home) as url, tk is not null or inf is not null as is_specific,
  case when coalesce(inf, fl) <> coalesce(tk, inf, fl, home) then coalesce(inf, fl) end as secondary_url from x
""")
def primary_action_url(t):
    homes = t.raw("supplier").where("s_suppkey % 4 <> 0").selectExpr("s_name as location", "concat('https://venue.example/', s_suppkey) as home")
    sessions = t.screenings.join(t.films.select(F.col("id").alias("film_id"), "film_url"), "film_id")
    return D.primary_action_url(sessions, homes).select("seq", "film_id", "location", "url", "is_specific", "secondary_url")


# --- dates and numbers ------------------------------------------------------------------------------

@query("parse_showtime", """
select seq, film_id, location, case when seq % 11 = 0 then null else strftime(showtime, '%Y-%m-%d %H:%M') end as showtime, seq % 11 = 0 as failed from S
""")
def parse_showtime(t):
    text = (F.when(F.col("seq") % 11 == 0, F.lit("mañana 20h")).when(F.col("seq") % 2 == 0, F.date_format("showtime", "yyyy-MM-dd'T'HH:mm:ss"))
            .otherwise(F.date_format("showtime", "yyyy-MM-dd HH:mm")))
    parsed = t.screenings.withColumn("p", D.parse_showtime(text))
    return parsed.select("seq", "film_id", "location", F.date_format("p", "yyyy-MM-dd HH:mm").alias("showtime"), F.col("p").isNull().alias("failed"))


@query("parse_localized_date", """
select seq, film_id, location, strftime(showtime, '%Y-%m-%d %H:%M') as long_form, strftime(showtime, '%Y-%m-%d') as short_form from S
""")
def parse_localized_date(t):
    month = F.month("showtime")
    long_text = F.concat(F.day("showtime").cast("string"), F.lit(" de "), F.initcap(D.month_name(month)), F.lit(" - "), F.date_format("showtime", "HH:mm"), F.lit("h"))
    short_text = F.concat(F.lit("Mié, "), F.day("showtime").cast("string"), F.lit(" "), F.initcap(D.month_abbreviation(month)), F.lit("."))
    year = F.year("showtime")
    return t.screenings.select(
        "seq", "film_id", "location", F.date_format(D.parse_localized_date(long_text, year), "yyyy-MM-dd HH:mm").alias("long_form"),
        F.date_format(D.parse_localized_date(short_text, year), "yyyy-MM-dd").alias("short_form"))


@query("resolve_year_rollover", """
select seq, film_id, location, strftime(make_date(case when month(showtime) < 5 then 2002 else 2001 end, month(showtime), least(day(showtime), 28)), '%Y-%m-%d') as day from S
""")
def resolve_year_rollover(t):
    day = D.resolve_year_rollover(F.least(F.day("showtime"), F.lit(28)), F.month("showtime"), F.lit("2001-05-03").cast("date"))
    return t.screenings.select("seq", "film_id", "location", day.cast("string").alias("day"))


@query("resolve_relative_day", """
select seq, film_id, location, strftime(case seq % 3 when 0 then date '2001-12-31' when 1 then date '2002-01-01' else make_date(case when month(showtime) < 12 then 2002 else 2001 end, month(showtime), least(day(showtime), 28)) end, '%Y-%m-%d') as day from S
""")
def resolve_relative_day(t):
    label = (F.when(F.col("seq") % 3 == 0, F.lit("Hoy")).when(F.col("seq") % 3 == 1, F.lit(" mañana "))
             .otherwise(F.format_string("Domingo %02d/%02d", F.least(F.day("showtime"), F.lit(28)), F.month("showtime"))))
    return t.screenings.select("seq", "film_id", "location", D.resolve_relative_day(label, F.lit("2001-12-31").cast("date")).cast("string").alias("day"))


@query("epoch_millis_date", """
select event_id, strftime(ts, '%Y-%m-%d') as day from events
""")
def epoch_millis_date(t):
    text = F.concat(F.lit("/Date("), F.unix_millis(F.col("ts").cast("timestamp")).cast("string"), F.lit(")/"))
    return t.raw("events").select("event_id", D.epoch_millis_date(text).cast("string").alias("day"))


@query("decade_bucket", """
select id, case when year is null then 'unknown' when year < 1960 then 'pre-1960' else concat(year // 10 * 10, 's') end as bucket from F
""")
def decade_bucket(t):
    return t.films.select("id", D.decade_bucket(F.col("year")).alias("bucket"))


@query("runtime_bucket", """
select id, case when runtime_minutes is null then 'unknown' when runtime_minutes < 90 then 'short' when runtime_minutes <= 120 then 'medium' when runtime_minutes <= 150 then 'long' else 'epic' end as bucket from F
""")
def runtime_bucket(t):
    return t.films.select("id", D.runtime_bucket(F.col("runtime_minutes")).alias("bucket"))


@query("popularity_boost", """
select id, round(case when viewers is null or viewers <= 0 then 1.0 else 1 + least(log10(viewers) / 150, 0.05) end, 8) as boost from F
""")
def popularity_boost(t):
    return t.films.select("id", F.round(D.popularity_boost(F.col("viewers")), 8).alias("boost"))


@query("recency_decay", """
select user_id, raw_film_id, round(greatest(0.3, exp(-0.00385 * date_diff('day', watched_date, date '2001-09-01'))), 8) as recency from W
""")
def recency_decay(t):
    return t.watched.select("user_id", "raw_film_id", F.round(D.recency_decay(F.col("watched_date"), AS_OF), 8).alias("recency"))
