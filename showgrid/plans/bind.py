"""Binding of the given tables to the data model.

Each view is written once as a list of SQL expressions and rendered for Spark or for the checking
engine; the only differences between the two dialects are the small helpers in :class:`Dialect`.
All operators run on these views exactly as they would on real catalogue tables.
"""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import DataFrame, SparkSession

from showgrid.util import dealt

AS_OF = "2001-09-01 00:00:00"


class Dialect:
    """Rendering helpers: integer division, arrays of (id, name) and string arrays without nulls."""

    def __init__(self, spark: bool):
        self.spark = spark

    def div(self, a: str, b: str) -> str:
        return f"({a} div {b})" if self.spark else f"({a} // {b})"

    def people(self, *pairs: tuple[str, str]) -> str:
        if self.spark:
            items = ", ".join(f"named_struct('id', cast({i} as bigint), 'name', cast({n} as string))" for i, n in pairs)
            return f"filter(array({items}), x -> x.id is not null)"
        items = ", ".join(f"{{'id': cast({i} as bigint), 'name': cast({n} as varchar)}}" for i, n in pairs)
        return f"[x for x in [{items}] if x.id is not null]"

    def strings(self, *values: str) -> str:
        items = ", ".join(f"cast({v} as string)" for v in values)
        if self.spark:
            return f"filter(array({items}), x -> x is not null)"
        return f"[x for x in [{items}] if x is not null]"

    def longs(self, *values: str) -> str:
        items = ", ".join(f"cast({v} as bigint)" for v in values)
        return f"array({items})" if self.spark else f"[{items}]"

    def word(self, i: int) -> str:
        return f"split(p_name, ' ')[{i}]" if self.spark else f"string_split(p_name, ' ')[{i + 1}]"

    def brand(self) -> str:
        return "cast(substring(p_brand, 7) as bigint)"

    def last_char(self, c: str) -> str:
        return f"right({c}, 1)"

    def hours(self, ts: str, n: str) -> str:
        if self.spark:
            return f"({ts} + make_dt_interval(0, {n}, 0, 0))"
        return f"({ts} + to_hours(cast({n} as integer)))"

    def minutes(self, ts: str, n: str) -> str:
        if self.spark:
            return f"({ts} + make_dt_interval(0, 0, {n}, 0))"
        return f"({ts} + to_minutes(cast({n} as integer)))"

    def json_int(self, c: str, key: str) -> str:
        if self.spark:
            return f"cast(get_json_object({c}, '$.{key}') as bigint)"
        return f"cast(json_extract_string({c}, '$.{key}') as bigint)"

    def ntz(self, c: str) -> str:
        return f"cast({c} as timestamp_ntz)" if self.spark else f"cast({c} as timestamp)"

    def fmt(self, c: str) -> str:
        return f"date_format({c}, 'yyyy-MM-dd HH:mm')" if self.spark else f"strftime({c}, '%Y-%m-%d %H:%M')"


def films_columns(d: Dialect) -> list[str]:
    i, n = "p_partkey", d.brand()
    kw = lambda w: f"ascii({w}) * 10000 + ascii({d.last_char(w)}) * 100 + length({w})"
    w0, w1 = d.word(0), d.word(1)
    return [
        f"{i} as id", "p_name as title",
        f"case when {i} % 3 <> 0 then upper(p_name) end as title_original",
        f"case when {i} % 4 <> 0 then concat(p_name, ' ', {i}) end as title_en",
        f"case when {i} % 6 <> 0 then concat('El ', p_name) end as title_es",
        f"case when {i} % 17 <> 0 then p_brand end as director",
        "{} as directors".format(d.people((f"case when {i} % 17 <> 0 then {n} end", "p_brand"),
                                          (f"case when {i} % 6 = 0 then {n} % 25 + 26 end", "concat('Co-', p_brand)"))),
        "{} as cinematographers".format(d.people((f"case when {i} % 2 = 0 then 200000 + {d.div(i, '9')} end", f"concat('Photo ', {d.div(i, '9')})"))),
        "{} as composers".format(d.people((f"case when {i} % 3 = 0 then 300000 + {d.div(i, '11')} end", f"concat('Music ', {d.div(i, '11')})"))),
        "{} as writers".format(d.people((f"400000 + {d.div(i, '4')}", f"concat('Pen ', {d.div(i, '4')})"),
                                        (f"400000 + {d.div(f'({i} + 1)', '4')}", f"concat('Pen ', {d.div(f'({i} + 1)', '4')})"))),
        "{} as top_cast".format(d.people((f"100000 + {d.div(i, '6')}", f"concat('Cast ', {d.div(i, '6')})"),
                                         (f"100000 + {d.div(f'({i} * 7919 % 1000003)', '600')}", f"concat('Cast ', {d.div(f'({i} * 7919 % 1000003)', '600')})"),
                                         (f"case when {i} % 2 = 1 then 100000 + {d.div(i, '8')} end", f"concat('Cast ', {d.div(i, '8')})"))),
        "{} as keywords".format(d.people((kw(w0), w0), (kw(w1), w1),
                                         (f"case when {i} % 2 = 0 then 5000000 + {d.div(i, '15')} end", f"concat('niche ', {d.div(i, '15')})"),
                                         (f"case when {i} % 10 = 0 then 4999999 end", "'Sequel'"))),
        "{} as production_companies".format(d.people((f"600000 + {i} % 50", f"concat('Company ', {i} % 50)"),
                                                     (f"case when {i} % 3 = 0 then 600000 + {i} % 35 end", f"concat('Company ', {i} % 35)"))),
        "{} as genres".format(d.strings("p_type", f"case when {i} % 4 = 0 then concat('G', {i} % 9) end")),
        "{} as country".format(d.strings(f"concat('Country', {n} % 7)", f"case when {i} % 5 = 0 then 'UK' end")),
        "{} as primary_language".format(d.strings(f"case {n} % 5 when 0 then 'Spanish' when 1 then 'English' when 2 then 'French' when 3 then 'Japanese' end")),
        "{} as spoken_languages".format(d.strings(f"case {n} % 5 when 0 then 'spanish' when 1 then 'English' when 2 then 'French' end",
                                                  f"case when {i} % 3 = 0 then 'English' end")),
        f"cast(case when {i} % 19 <> 0 then 1930 + {i} % 95 end as int) as year",
        f"cast(case when {i} % 23 <> 0 then 30 + p_size * 3 end as int) as runtime_minutes",
        f"case when {i} % 11 <> 0 then floor(p_retailprice % 500) / 100.0e0 end as rating",
        f"case when {i} % 7 <> 0 then round({i} * 37 % 100 / 10.0e0, 1) end as tmdb_rating",
        f"cast({i} * 53 % 5000 as int) as tmdb_votes",
        f"cast(case when {i} % 29 <> 0 then {i} * 37 % 100000 end as bigint) as viewers",
        f"case when {i} % 5 = 0 then {d.div(i, '20')} + 1 end as collection_id",
        f"case when {i} % 10 <> 9 then 900000 + {i} end as tmdb_id",
        "{} as tmdb_recommendations".format(d.longs(f"900001 + {i}", f"900007 + {i}", f"899990 + {i}", f"900000 + {i}")),
        f"case when {i} % 13 <> 0 then concat('b/', {i}) end as short_url",
        f"case when {i} % 12 <> 0 then concat('https://films.example/f/', {i}) end as film_url",
        f"case when {i} % 8 <> 0 then concat('/p', {i}, '.jpg') end as poster_path",
        f"case when {i} % 9 <> 0 then concat('About ', p_name) end as overview",
    ]


def screenings_columns(d: Dialect) -> list[str]:
    return [
        "l_orderkey * 10 + l_linenumber as seq", "l_partkey as film_id",
        "{} as showtime".format(d.hours(d.ntz("l_shipdate"), "10 + 2 * l_linenumber")),
        "s_name as location",
        "case l_returnflag when 'R' then 'dubbed' when 'A' then 'VOSE' end as version",
        "case when l_linestatus = 'O' and l_linenumber = 1 then 'event' end as special",
        "case when l_linenumber % 3 = 0 then '' else concat('t/', l_orderkey, '/', l_linenumber) end as url_tickets",
        "case when l_linenumber % 6 = 0 then '' else concat('i/', l_partkey) end as url_info",
    ]


def watched_columns() -> list[str]:
    return [
        "user_id", "film_id as raw_film_id", "concat('b/', film_id) as short_url",
        "case when film_id % 13 <> 0 then film_id end as film_id",
        "rating", "liked", "watched_date", "rewatch_count",
    ]


def scraped_columns(d: Dialect) -> list[str]:
    """One scraped film entry with one session per row, as a day-by-day listing run delivers them."""
    return [
        "s.seq as seq", "s.location as theater",
        "case when s.version = 'VOSE' then concat(f.title, ' (VOSE)') when s.seq % 7 = 1 then concat('Verdi Club: ', f.title) else f.title end as title",
        "f.title as base_title", "f.id as film_ref",
        "case when f.id % 9 = 0 then '' else concat('i/', f.id) end as theater_film_link",
        "case when s.seq % 5 = 0 then null else f.director end as director",
        "case when s.seq % 4 = 0 then null else f.year end as year",
        "case when s.seq % 3 <> 0 then f.film_url end as film_url",
        "s.special as special",
        "{} as timestamp".format(d.fmt("s.showtime")),
        "s.location as location", "s.url_tickets as url_tickets", "s.url_info as url_info", "s.version as version",
    ]


def queue_columns(d: Dialect) -> list[str]:
    return [
        "event_id as id", "concat('b/', event_id) as short_url",
        "case event_type when 'view' then 'pending' when 'click' then 'pending' when 'purchase' then 'done' when 'error' then 'failed' else 'processing' end as status",
        "cast(user_id as string) as requested_by", "{} as created_at".format(d.ntz("ts")),
        "case when event_type in ('purchase', 'error') then {} end as processed_at".format(d.minutes(d.ntz("ts"), "2")),
        "case when event_type not in ('purchase', 'error', 'view', 'click') then {} end as locked_at".format(d.minutes(d.ntz("ts"), "1")),
        "cast({} % 7 as int) as retry_count".format(d.json_int("props", "k")),
        "cast(null as string) as override_url",
    ]


QUEUE_NOW = "2024-01-30 23:58:00"


def watched_sql() -> str:
    """Feedback per (user, film): the last order line decides the rating, counts decide rewatches."""
    return """
      select o_custkey as user_id, l_partkey as film_id,
             case when max_by(ascii(l_returnflag), o_orderkey * 10 + l_linenumber + l_quantity / 1000) <> ascii('N')
                  then greatest(0.5e0, round(max_by(l_quantity, o_orderkey * 10 + l_linenumber + l_quantity / 1000) / 10 * 2) / 2) end as rating,
             max(case when l_returnflag = 'A' then 1 else 0 end) = 1 as liked,
             cast(max(o_orderdate) as date) as watched_date,
             cast(count(*) - 1 as int) as rewatch_count
      from orders join lineitem on l_orderkey = o_orderkey
      group by o_custkey, l_partkey"""


def duck_views() -> dict[str, str]:
    d = Dialect(spark=False)
    return {
        "F": f"select {', '.join(films_columns(d))} from part",
        "S": f"select {', '.join(screenings_columns(d))} from lineitem join supplier on l_suppkey = s_suppkey",
        "W": f"select {', '.join(watched_columns())} from ({watched_sql()})",
        "L": "select distinct user_id, concat('b/', event_id % (select count(*) from part)) as short_url from events where event_type = 'view'",
        "Q": f"select {', '.join(queue_columns(d))} from events",
        "SC": f"select {', '.join(scraped_columns(d))} from S s join F f on s.film_id = f.id",
    }


DUCK_DEPENDENCIES = {"SC": ["S", "F"]}


class Tables:
    """Views over one data folder for one session. Nothing is read until a view is used."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder
        self._d = Dialect(spark=True)

    def raw(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/{name}.parquet")

    @cached_property
    def films(self) -> DataFrame:
        return self.raw("part").selectExpr(*films_columns(self._d))

    @cached_property
    def dealt_films(self) -> DataFrame:
        """The films for work that makes much of each: their narrow rows are dealt over all tasks before their columns are built."""
        return dealt(self.raw("part")).selectExpr(*films_columns(self._d))

    @cached_property
    def screenings(self) -> DataFrame:
        return self._screenings(self.raw("lineitem"))

    def _screenings(self, lines: DataFrame) -> DataFrame:
        venues = self.raw("supplier")
        return lines.join(venues, lines.l_suppkey == venues.s_suppkey).selectExpr(*screenings_columns(self._d))

    def screenings_from(self, as_of: str) -> DataFrame:
        """Screenings that can start at or after ``as_of``, with a bound on the stored day column.

        A session starts 12 to 24 hours after its stored day, so the bound loses nothing, and unlike a
        bound on the computed start time it reaches the scan and its row-group statistics. The exact
        predicate is still applied by the operators.
        """
        bound = f"l_shipdate >= timestamp_ntz '{as_of}' - interval 1 day"
        return self._screenings(self.raw("lineitem").where(bound))

    @cached_property
    def watched(self) -> DataFrame:
        per_film = self.spark.sql(watched_sql().replace("from orders join lineitem", "from {orders} join {lineitem}"),
                                  orders=self.raw("orders"), lineitem=self.raw("lineitem"))
        return per_film.selectExpr(*watched_columns())

    @cached_property
    def watchlist(self) -> DataFrame:
        return self.spark.sql(
            "select distinct user_id, concat('b/', event_id % (select count(*) from {part})) as short_url "
            "from {events} where event_type = 'view'", part=self.raw("part"), events=self.raw("events"))

    @cached_property
    def queue(self) -> DataFrame:
        return self.raw("events").selectExpr(*queue_columns(self._d))

    @cached_property
    def scraped(self) -> DataFrame:
        s, f = self.screenings.alias("s"), self.films.alias("f")
        from pyspark.sql import functions as F
        return s.join(f, F.col("s.film_id") == F.col("f.id")).selectExpr(*scraped_columns(self._d))

    @cached_property
    def pages(self) -> DataFrame:
        return self.raw("pages")

    @cached_property
    def documents(self) -> DataFrame:
        return self.raw("documents")
