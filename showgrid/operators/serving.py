"""Catalogue queries: what is on, under which filters, in which order."""

from __future__ import annotations

from datetime import date, timedelta
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from showgrid import lookups
from showgrid.functions.text import fold_contains
from showgrid.util import first_by, global_rank, rank_within


def as_time(as_of: str) -> Column:
    return F.lit(as_of).cast("timestamp_ntz")


# --- session predicates -----------------------------------------------------------------------

def date_range_sessions(sessions: DataFrame, start: str, end: str) -> DataFrame:
    """Sessions whose day lies in the inclusive range; the bounds stay sargable for the scan."""
    return sessions.where(
        (F.col("showtime") >= as_time(start)) & (F.col("showtime") < as_time(end) + F.expr("interval 1 day"))
    )


def upcoming_sessions(sessions: DataFrame, as_of: str, granularity: str = "instant") -> DataFrame:
    """Sessions from ``as_of`` on; ``day`` counts the whole current day."""
    if granularity not in ("instant", "day"):
        raise ValueError("granularity is 'instant' or 'day'")
    since = as_time(as_of)
    if granularity == "day":
        since = F.date_trunc("day", since).cast("timestamp_ntz")
    return sessions.where(F.col("showtime") >= since)


def is_spanish(languages: Column) -> Column:
    return F.arrays_overlap(languages, F.array(*[F.lit(v) for v in lookups.SPANISH_LANGUAGE_VALUES]))


def session_filters(films: DataFrame, upcoming: DataFrame, venues: list[str] | None = None, day: str | None = None,
                    version: str = "original", weekdays: list[int] | None = None) -> DataFrame:
    """Upcoming sessions under the venue, day, weekday (0 = Monday) and version filters.

    The version rule does not apply to Spanish-language films. ``has_original_version`` looks at all
    upcoming sessions of the film, before any filter.
    """
    if version not in ("original", "dubbed"):
        raise ValueError("version is 'original' or 'dubbed'")
    dubbed = F.col("version").eqNullSafe("dubbed")
    original = upcoming.where(~dubbed).select("film_id").distinct().withColumn("has_original_version", F.lit(True))
    kept = upcoming
    if venues is not None:
        kept = kept.where(F.col("location").isin(venues))
    if day is not None:
        kept = date_range_sessions(kept, day, day)
    if weekdays:
        kept = kept.where(F.weekday("showtime").isin(weekdays))
    languages = films.select(F.col("id").alias("film_id"), is_spanish(F.col("primary_language")).alias("_spanish"))
    wanted = ~dubbed if version == "original" else dubbed
    return (
        kept.join(languages, "film_id").where(F.col("_spanish") | wanted).drop("_spanish")
        .join(original, "film_id", "left")
        .withColumn("has_original_version", F.coalesce("has_original_version", F.lit(False)))
    )


def _any_of(column: str, chosen: list[str] | None) -> Column | None:
    return None if chosen is None else F.arrays_overlap(F.col(column), F.array(*[F.lit(v) for v in chosen]))


def film_filters(films: DataFrame, search: str | None = None, genres: list[str] | None = None,
                 countries: list[str] | None = None, languages: list[str] | None = None,
                 decades: list[tuple[int, int]] | None = None, runtimes: list[int] | None = None) -> DataFrame:
    """Film-level filters joined by AND; alternatives inside one filter by OR.

    ``None`` means "all selected", which is no filter. A film without a year or runtime fails an
    active decade or runtime filter. ``runtimes`` are positions in the runtime chip list.
    """
    conditions = [_any_of("genres", genres), _any_of("country", countries), _any_of("primary_language", languages)]
    if search:
        conditions.append(reduce(lambda a, b: a | b, [
            F.coalesce(fold_contains(F.col(c), search), F.lit(False)) for c in ("title", "title_en", "director")]))
    if decades:
        conditions.append(reduce(lambda a, b: a | b, [F.col("year").between(a, b) for a, b in decades])
                          & (F.col("year") != 0))
    if runtimes:
        minutes = F.col("runtime_minutes")
        chips = [lookups.RUNTIME_CHIPS[i] for i in runtimes]
        conditions.append((minutes > 0) & reduce(lambda a, b: a | b, [
            (minutes >= low) if high is None else minutes.between(low, high) for _, low, high in chips]))
    for condition in conditions:
        if condition is not None:
            films = films.where(condition)
    return films


def special_only(films: DataFrame, sessions: DataFrame) -> DataFrame:
    return films.join(sessions.where(F.col("special").isNotNull()), films.id == sessions.film_id, "left_semi")


def title_search(films: DataFrame, text: str, limit: int = 20) -> DataFrame:
    """Case-insensitive substring search, first ``limit`` ids."""
    return films.where(F.lower("title").contains(text.lower())).orderBy("id").limit(limit)


# --- joins ------------------------------------------------------------------------------------

def films_with_screenings(films: DataFrame, screenings: DataFrame, as_of: str) -> DataFrame:
    return films.join(upcoming_sessions(screenings, as_of, "day"), F.col("id") == F.col("film_id"))


def films_overview(films: DataFrame, screenings: DataFrame) -> DataFrame:
    """Screening count, first and last showtime of every film, zero included.

    Screenings are reduced per film before the join, so the join never sees single sessions.
    """
    per_film = screenings.groupBy("film_id").agg(
        F.count(F.lit(1)).alias("screening_count"), F.min("showtime").alias("first_screening"),
        F.max("showtime").alias("last_screening"))
    return (
        films.join(per_film, films.id == per_film.film_id, "left").drop("film_id")
        .withColumn("screening_count", F.coalesce("screening_count", F.lit(0)))
    )


def watchlist_semi_join(films: DataFrame, watchlist: DataFrame, user) -> DataFrame:
    return films.join(watchlist.where(F.col("user_id") == user).select("short_url"), "short_url", "left_semi")


def unwatched_anti_join(films: DataFrame, watched: DataFrame, user) -> DataFrame:
    """Films the user has not watched; films without a short url are kept."""
    return films.join(watched.where(F.col("user_id") == user).select("short_url"), "short_url", "left_anti")


# --- facets and statistics ---------------------------------------------------------------------

def active_films(films: DataFrame, screenings: DataFrame, as_of: str) -> DataFrame:
    upcoming = upcoming_sessions(screenings, as_of)
    return films.join(upcoming, films.id == upcoming.film_id, "left_semi")


def facet_values(films: DataFrame, screenings: DataFrame, field: str, as_of: str) -> DataFrame:
    """Distinct values of an array field over films with an upcoming session, with film counts."""
    values = active_films(films, screenings, as_of).select("id", F.explode(F.array_distinct(field)).alias("value"))
    return values.groupBy("value").agg(F.count(F.lit(1)).alias("films"))


def facet_decades(films: DataFrame, screenings: DataFrame, as_of: str) -> DataFrame:
    start = (F.floor(F.col("year") / 10) * 10).cast("int")
    early = F.col("start") < 1920
    return (
        active_films(films, screenings, as_of).where(F.col("year").isNotNull())
        .select(start.alias("start")).distinct()
        .select(F.when(early, F.lit("< 20s")).otherwise(F.concat(F.col("start").cast("string"), F.lit("s"))).alias("label"),
                F.when(early, 0).otherwise(F.col("start")).alias("start"),
                F.when(early, 1919).otherwise(F.col("start") + 9).alias("end"))
        .distinct()
    )


def headline_stats(films: DataFrame, screenings: DataFrame) -> DataFrame:
    """Number of films with a session and of known venues."""
    seen = films.select(F.col("id").alias("film_id")).join(screenings, "film_id")
    known = F.when(F.coalesce(F.col("location"), F.lit("Unknown")) != "Unknown", F.col("location"))
    return seen.agg(F.countDistinct("film_id").alias("films"), F.countDistinct(known).alias("venues"))


def year_bounds(films: DataFrame, screenings: DataFrame, as_of: str) -> DataFrame:
    return active_films(films, screenings, as_of).agg(F.min("year").alias("min_year"), F.max("year").alias("max_year"))


def last_chance(screenings: DataFrame, as_of: str, mode: str = "instant", days: int = 3) -> DataFrame:
    """Films whose latest upcoming session lies within ``days``; ``calendar`` mode extends to the day's end."""
    now = as_time(as_of)
    if mode == "instant":
        since, until = now, now + F.expr(f"interval {days} days")
    elif mode == "calendar":
        since = F.date_trunc("day", now).cast("timestamp_ntz")
        until = since + F.expr(f"interval {days + 1} days") - F.expr("interval 1 second")
    else:
        raise ValueError("mode is 'instant' or 'calendar'")
    latest = screenings.where(F.col("showtime") >= since).groupBy("film_id").agg(F.max("showtime").alias("last_session"))
    return latest.where(F.col("last_session") <= until)


def venue_coverage(screenings: DataFrame) -> DataFrame:
    """Sessions, last day and special sessions per venue, plus the grand total as location null."""
    return screenings.groupBy(F.coalesce("location", F.lit("Unknown")).alias("location")).agg(
        F.count("showtime").alias("sessions"), F.to_date(F.max("showtime")).alias("last_day"),
        F.count_if(F.coalesce(F.col("special"), F.lit("")) != "").alias("special"))


def coverage_with_total(coverage: DataFrame) -> DataFrame:
    total = coverage.agg(
        F.lit(None).cast("string").alias("location"), F.sum("sessions").alias("sessions"),
        F.max("last_day").alias("last_day"), F.sum("special").alias("special"))
    return coverage.unionByName(total)


def publication_cliff(screenings: DataFrame, ratio: float = 0.5) -> DataFrame:
    """Last fully published day per venue and the days without sessions up to it.

    The cliff is the first day whose count drops below ``ratio`` times the mean of the days before.
    Sessions are reduced to one row per venue and day first; the windows run over these daily rows,
    whose number per venue is bounded by the calendar, and all share one shuffle.
    """
    return cliff_of_daily(screenings.groupBy("location", F.to_date("showtime").alias("day")).agg(F.count(F.lit(1)).alias("n")), ratio)


def cliff_of_daily(daily: DataFrame, ratio: float = 0.5) -> DataFrame:
    """The same from rows (location, day, n), of all venues or some."""
    from pyspark.sql import Window as W

    venue = W.partitionBy("location")
    before = F.sum("n").over(venue.orderBy("day").rowsBetween(W.unboundedPreceding, -1))
    # days without sessions add nothing to the sum but count in the mean, so no calendar has to be filled in
    baseline = before / F.nullif(F.date_diff("day", F.min("day").over(venue)), F.lit(0))
    marked = daily.withColumn("_drop", F.when(F.col("n") < ratio * baseline, F.col("day")))
    cliff = marked.withColumn("cliff_day", F.min("_drop").over(venue))
    full = F.coalesce(F.date_sub("cliff_day", 1), F.max("day"))
    return (
        cliff.groupBy("location", "cliff_day")
        .agg(full.alias("last_full_day"), F.min("day").alias("_first"),
             F.count_if(F.col("cliff_day").isNull() | (F.col("day") < F.col("cliff_day"))).alias("_listed"))
        .select("location", "cliff_day", "last_full_day",
                (F.date_diff("last_full_day", "_first") + 1 - F.col("_listed")).alias("gap_days"))
    )


def daily_film_counts(screenings: DataFrame, start: str, days: int) -> DataFrame:
    """Distinct films per day over a fixed calendar strip, zero days included."""
    first = date.fromisoformat(start[:10])
    strip = screenings.sparkSession.range(1).select(F.explode(F.sequence(F.lit(first), F.lit(first + timedelta(days=days - 1)))).alias("day"))
    # plain literals, so that both bounds reach the scan
    edge = lambda d: F.lit(f"{d} 00:00:00").cast("timestamp_ntz")
    inside = screenings.where((F.col("showtime") >= edge(first)) & (F.col("showtime") < edge(first + timedelta(days=days))))
    counts = inside.groupBy(F.to_date("showtime").alias("day")).agg(F.countDistinct("film_id").alias("films"))
    return strip.join(counts, "day", "left").withColumn("films", F.coalesce("films", F.lit(0)))


def month_grid(screenings: DataFrame, month_day: str) -> DataFrame:
    """42 cells from the Monday on or before the first of the month."""
    first = date.fromisoformat(month_day).replace(day=1)
    return daily_film_counts(screenings, str(first - timedelta(days=first.weekday())), 42)


def url_references(films: DataFrame, screenings: DataFrame, start: str, end: str | None = None) -> DataFrame:
    """Every distinct ticket or info url with the number of distinct sessions that use it."""
    chosen = screenings.where(F.col("showtime") >= as_time(start))
    if end is not None:
        chosen = chosen.where(F.col("showtime") < as_time(end) + F.expr("interval 1 day"))
    long = (
        chosen.unpivot(["film_id", "showtime", "location"], ["url_tickets", "url_info"], "field", "url")
        .where(F.coalesce(F.col("url"), F.lit("")) != "")
    )
    titles = films.select(F.col("id").alias("film_id"), "title")
    refs = long.join(titles, "film_id").select("url", "title", "showtime", "location").distinct()
    return refs.groupBy("url").agg(F.count(F.lit(1)).alias("references"), F.min("showtime").alias("first_showtime"))


def broken_urls(references: DataFrame, status: DataFrame) -> DataFrame:
    """References whose probed status is known and not 200."""
    return references.join(status.where(F.col("status") != 200), "url")


def location_summary(screenings: DataFrame, groups: DataFrame) -> DataFrame:
    """One label per film: the group when all venues belong to it, the venue when single, else "n venues"."""
    known = screenings.where(F.coalesce(F.col("location"), F.lit("Unknown")) != "Unknown")
    per_venue = known.groupBy("film_id", "location").agg(F.min("showtime").alias("a"), F.max("showtime").alias("b"))
    labelled = per_venue.join(groups, "location", "left")
    summary = labelled.groupBy("film_id").agg(
        F.count(F.lit(1)).alias("venues"), F.count("venue_group").alias("_grouped"),
        F.min("venue_group").alias("_g1"), F.max("venue_group").alias("_g2"), F.min("location").alias("_place"),
        F.to_date(F.min("a")).alias("from_day"), F.to_date(F.max("b")).alias("to_day"))
    label = (F.when((F.col("_grouped") == F.col("venues")) & (F.col("_g1") == F.col("_g2")), F.col("_g1"))
             .when(F.col("venues") == 1, F.col("_place"))
             .otherwise(F.concat(F.col("venues").cast("string"), F.lit(" venues"))))
    return summary.select("film_id", label.alias("label"), "from_day", "to_day")


# --- order and pages ----------------------------------------------------------------------------

def venue_order(location: Column) -> Column:
    """Display position of a venue: first matching rule of the fixed list, 999 otherwise."""
    low = F.lower(location)
    rules = [F.when(low.rlike(p), n) for p, n in lookups.VENUE_ORDER]
    return F.coalesce(*rules, F.lit(999))


def sessions_by_venue_day(sessions: DataFrame, mode: str = "venue") -> DataFrame:
    """Sessions with their place in the venue > day > time (or day > time) listing."""
    order = venue_order(F.col("location"))
    name = F.collate(F.col("location"), "es_AI")
    keys = [order.asc(), name.asc(), F.col("location").asc()] if mode == "venue" else []
    keys += [F.to_date("showtime").asc(), F.col("showtime").asc(), order.asc(), F.col("location").asc(),
             F.col("film_id").asc(), F.col("seq").asc()]
    return global_rank(sessions.withColumn("venue_order", order), keys, "position")


def next_session(screenings: DataFrame, as_of: str) -> DataFrame:
    """Earliest upcoming session per film and the number of the others."""
    upcoming = upcoming_sessions(screenings, as_of)
    best = F.min(F.struct("showtime", "location", "seq"))
    return upcoming.groupBy("film_id").agg(best.alias("b"), (F.count(F.lit(1)) - 1).alias("rest")).select(
        "film_id", F.col("b.showtime").alias("next_showtime"), F.col("b.location").alias("next_location"), "rest")


def first_days_per_venue(screenings: DataFrame, as_of: str, days: int = 3) -> DataFrame:
    """Sessions of the first ``days`` listed days of each venue.

    The day ranking runs over distinct venue-days, not over sessions.
    """
    from pyspark.sql import Window as W

    upcoming = upcoming_sessions(screenings, as_of).withColumn("day", F.to_date("showtime"))
    ranked = (
        upcoming.select("location", "day").distinct()
        .withColumn("_r", F.row_number().over(W.partitionBy("location").orderBy("day")))
        .where(F.col("_r") <= days).drop("_r")
    )
    return upcoming.join(ranked, ["location", "day"], "left_semi")


def catalogue_order(by: str) -> list[Column]:
    lead = {"rating": [], "viewers": [F.coalesce(F.col("viewers"), F.lit(-1)).desc()],
            "affinity": [F.coalesce(F.col("score"), F.lit(-1)).desc()]}[by]
    unrated = F.when(F.col("rating").isNull(), F.collate(F.col("title"), "es_AI"))
    return lead + [F.col("rating").desc_nulls_last(), unrated.asc_nulls_first(), F.col("id").asc()]


def rank_catalog(films: DataFrame, scores: DataFrame | None = None, by: str = "rating") -> DataFrame:
    """Catalogue position by affinity, viewers or rating; ties end at the id."""
    if by == "affinity":
        films = films.join(scores.select(F.col("film_id").alias("id"), "score"), "id", "left")
    return global_rank(films, catalogue_order(by), "rank")


def catalogue_page(films: DataFrame, limit: int, by: str = "rating") -> DataFrame:
    """The first page needs no global sort: a top-k per task, merged."""
    return films.orderBy(*catalogue_order(by)).limit(limit)


def paginate(ranked: DataFrame, page: int, columns: int, rows_per_page: int = 10) -> DataFrame:
    """Cumulative page of a ranked listing with the number of remaining films."""
    size = max(1, columns) * rows_per_page
    total = ranked.agg(F.count(F.lit(1)).alias("_total"))
    return (
        ranked.where(F.col("rank") <= page * size).crossJoin(F.broadcast(total))
        .withColumn("remaining", F.greatest(F.col("_total") - page * size, F.lit(0))).drop("_total")
    )


def top_bottom_n(scores: DataFrame, n: int = 10, bottom: bool = False) -> DataFrame:
    """Best or worst ``n`` films of each user; scores are rescaled so that the user's best is 100."""
    from pyspark.sql import Window as W

    best = scores.groupBy("user_id").agg(F.max("score").alias("_max"))
    order = [F.col("score").asc() if bottom else F.col("score").desc(), F.col("film_id").asc()]
    # row_number() <= n is cut to n rows per user and task before the shuffle
    cut = scores.withColumn("position", F.row_number().over(W.partitionBy("user_id").orderBy(*order)))
    cut = cut.where(F.col("position") <= n)
    scaled = F.when(F.col("_max") > 0, F.floor(F.col("score") * 100 / F.col("_max") + 0.5)).otherwise(F.lit(0))
    return cut.join(best, "user_id").withColumn("normalized_score", scaled.cast("int")).drop("_max")


# --- set operations -----------------------------------------------------------------------------

def complement_selection(all_values: DataFrame, excluded: list[str]) -> DataFrame:
    """All values but the excluded ones; the single word ``all`` excludes everything."""
    if excluded == ["all"]:
        return all_values.where(F.lit(False))
    return all_values.where(~F.col(all_values.columns[0]).isin(excluded)).distinct()


def candidate_universe(watched_films: DataFrame, screened_films: DataFrame) -> DataFrame:
    """Watched and screened films per user; a screened film wins over its watched copy."""
    both = watched_films.withColumn("is_screened", F.lit(False)).unionByName(
        screened_films.withColumn("is_screened", F.lit(True)))
    return both.groupBy("user_id", "film_id").agg(F.max("is_screened").alias("is_screened"))


def topk_difference(a: DataFrame, b: DataFrame, k: int = 10) -> DataFrame:
    """Per user, films in only one of two top-``k`` lists."""
    from pyspark.sql import Window as W

    order = W.partitionBy("user_id").orderBy(F.col("score").desc(), F.col("film_id"))
    def top(s):
        return s.withColumn("_r", F.row_number().over(order)).where(F.col("_r") <= k).select("user_id", "film_id")
    ta, tb = top(a), top(b)
    return (
        ta.join(tb, ["user_id", "film_id"], "left_anti").withColumn("side", F.lit("a"))
        .unionByName(tb.join(ta, ["user_id", "film_id"], "left_anti").withColumn("side", F.lit("b")))
    )


def dedup_first(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    return first_by(keys, order, df)


def dedup_last(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    return first_by(keys, order, df, last=True)
