"""Registered queries for extraction from pages, lines and tokens."""

from __future__ import annotations

from pyspark.sql import functions as F

from showgrid.functions.dates import resolve_relative_day
from showgrid.operators import extract as E
from showgrid.plans.bind import Tables
from showgrid.plans.registry import query
from showgrid.sources.readers import read_pages

HREF = r"""<a\b[^>]*?\bhref\s*=\s*["'']([^"'']*)["'']"""


@query("read_pages", "select page_id, md5(html) as digest, length(html) as n from pages")
def read_pages_query(t: Tables):
    return read_pages(t.spark, f"{t.folder}/pages.parquet").select("page_id", F.md5("html").alias("digest"), F.length("html").alias("n"))


@query("extract_links", f"""
with h as (select page_id, regexp_extract(url, '^([a-z]+://[^/?#]+)', 1) as root, unnest(regexp_extract_all(html, '{HREF}', 1)) as h, generate_subscripts(regexp_extract_all(html, '{HREF}', 1), 1) as i from pages),
c as (select page_id, i, regexp_replace(h, '#.*$', '') as h, root from h),
a as (select page_id, i, case when regexp_matches(h, '^[a-z]+:') then h when h like '/%' then concat(root, h) else concat(root, '/', h) end as link from c where h <> '' and not regexp_matches(h, '/the/*$')),
f as (select page_id, link, min(i) as i from a group by all)
select page_id, link, row_number() over (partition by page_id order by i) - 1 as pos from f
""".replace("f as (select page_id, link", "fl as (select page_id, link").replace("from f\n", "from fl\n"))
def extract_links(t):
    return E.extract_links(t.pages, skip_index="/the").select("page_id", "link", "pos")


@query("extract_fields", r"""
with x as (select page_id, trim(regexp_replace(regexp_extract(html, '<h1>(.*?)</h1>', 1, 's'), '\s+', ' ', 'g')) as title,
 trim(regexp_replace(regexp_extract(html, '<div class="ad">(.*?)</div>', 1, 's'), '\s+', ' ', 'g')) as ad, regexp_extract(html, '<li><a href="[^"]*">[^<]*</a></li><li><a href="[^"]*">([^<]*)</a></li>', 1) as second from pages)
select page_id, replace(replace(replace(replace(title, '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&amp;', '&') as title, nullif(ad, '') as ad from x where title <> '' or ad <> ''
""")
def extract_fields(t):
    rules = [{"field": "title", "tag": "h1"}, {"field": "ad", "tag": "div", "css_class": "ad"}]
    return E.fields_wide(E.extract_fields(t.pages, rules), ["title", "ad"])


@query("extract_label_fields", r"""
select page_id, regexp_extract(html, '<ul><li><a href="[^"]*">([^<]*)</a></li>', 1) as first_item, regexp_extract(html, '<ul><li><a href="[^"]*">[^<]*</a></li><li><a href="[^"]*">([^<]*)</a></li>', 1) as after_home from pages where html like '%<ul><li>%'
""")
def extract_label_fields(t):
    """Label rule: the item after the one that says Home, which is put in front of each page's list."""
    pages = t.pages.withColumn("html", F.regexp_replace("html", "<ul><li><a href=\"[^\"]*\">([^<]*)</a></li>", "<ul><li>$1</li><li>Home: </li>"))
    rules = [{"field": "first_item", "tag": "li"}, {"field": "after_home", "tag": "li", "label": "Home"}]
    return E.fields_wide(E.extract_fields(pages, rules), ["first_item", "after_home"])


@query("last_page_number", """
select regexp_extract(url, '^[a-z]+://([^/?#]+)', 1) as site, greatest(1, max(case when page_id % 3 <> 0 then page_id % 9 end)) as last_page from pages group by 1
""")
def last_page_number(t):
    link = F.when(F.col("page_id") % 3 != 0, F.concat(F.lit('<a href="?pagina='), (F.col("page_id") % 9).cast("string"), F.lit('">x</a><a href="?pagina=0">'))).otherwise(F.lit(""))
    out = E.last_page_number(t.pages.withColumn("html", F.concat("html", link)))
    return out.withColumn("last_page", F.greatest(F.lit(1), "last_page"))


@query("first_present_source", """
select page_id, coalesce(nullif(trim(case when page_id % 3 = 0 then '' else regexp_extract(html, '<title>(.*?)</title>', 1) end), ''), nullif(trim(regexp_extract(html, '<li><a href="[^"]*">([^<]*)</a>', 1)), ''), url) as source from pages
""")
def first_present_source(t):
    c = t.pages.select(
        "page_id", F.when(F.col("page_id") % 3 == 0, F.lit("")).otherwise(F.regexp_extract("html", "<title>(.*?)</title>", 1)).alias("a"),
        F.regexp_extract("html", '<li><a href="[^"]*">([^<]*)</a>', 1).alias("b"), F.col("url").alias("c"))
    return c.select("page_id", E.first_present("a", "b", "c").alias("source"))


@query("carry_forward_headers", """
with ln as (select doc_id, unnest(string_split(text, chr(10))) as line, generate_subscripts(string_split(text, chr(10)), 1) - 1 as pos from documents)
select doc_id, pos, md5(last_value(case when length(line) < 60 then line end ignore nulls) over (partition by doc_id order by pos rows between unbounded preceding and current row)) as header from ln
""")
def carry_forward_headers(t):
    lines = E.carried_in_row(F.split("text", "\n"), lambda x: F.length(x) < 60)
    return t.documents.select("doc_id", F.explode(lines).alias("x")).select("doc_id", F.col("x.pos").alias("pos"), F.md5("x.header").alias("header"))


@query("extract_sessions", """
with t as (select film_id, seq, location, case when seq % 3 = 0 then make_date(case when month(showtime) < 2 then 2002 else 2001 end, month(showtime), least(day(showtime), 28)) end as head, seq % 5 as k, showtime from S),
c as (select *, last_value(head ignore nulls) over (partition by film_id order by seq, location rows between unbounded preceding and current row) as d from t)
select film_id, seq, location, concat(strftime(d, '%Y-%m-%d'), ' ', strftime(showtime, '%H:%M')) as showtime from c where head is null and k <> 4 and d is not null
""")
def extract_sessions(t):
    """Tokens of a film page: day headers, times with or without a version mark, and sold-out notes."""
    label = F.format_string("Domingo %02d/%02d", F.least(F.day("showtime"), F.lit(28)), F.month("showtime"))
    time = F.date_format("showtime", "HH:mm")
    text = (F.when(F.col("seq") % 3 == 0, label).when(F.col("seq") % 5 == 4, F.lit("agotado")).when(F.col("seq") % 5 == 1, F.concat(F.lit("VOSE "), time))
            .when(F.col("seq") % 5 == 2, F.replace(time, F.lit(":"), F.lit("."))).otherwise(time))
    tokens = t.screenings.select("film_id", "seq", "location", F.struct("seq", "location").alias("ord"), text.alias("text"))
    day = F.when(F.col("text").startswith("Domingo"), resolve_relative_day(F.col("text"), F.lit("2001-02-01").cast("date")))
    carried = E.carry_forward_headers(tokens, "film_id", "ord", {"day": day}).where(~F.col("text").startswith("Domingo"))
    return E.extract_sessions(carried, "text", "day").select("film_id", "seq", "location", F.date_format("showtime", "yyyy-MM-dd HH:mm").alias("showtime"))
