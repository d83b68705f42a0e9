"""Derived exports: event feed, venue directory and daily listing lines."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from showgrid import lookups
from showgrid.operators.serving import upcoming_sessions
from showgrid.util import blank_to_null, rank_within


def event_feed(films: DataFrame, screenings: DataFrame, as_of: str, limit: int = 200) -> DataFrame:
    """Structured events of the first ``limit`` future sessions in catalogue order; missing parts are left out.

    The cut comes before the documents are built: a top-k over narrow columns.
    """
    f = films.select(F.col("id").alias("film_id"), "title", "director", "year", "runtime_minutes")
    first = upcoming_sessions(screenings, as_of, "day").join(f, "film_id").orderBy("title", "film_id", "showtime", "location", "seq").limit(limit)
    text = lambda v: F.lit(v)
    movie = F.struct(text("Movie").alias("@type"), F.col("title").alias("name"),
                     F.when(blank_to_null("director").isNotNull(), F.struct(text("Person").alias("@type"), F.col("director").alias("name"))).alias("director"),
                     F.col("year").cast("string").alias("dateCreated"),
                     F.when(F.col("runtime_minutes") > 0, F.concat(F.lit("PT"), F.col("runtime_minutes").cast("string"), F.lit("M"))).alias("duration"))
    event = F.struct(text("ScreeningEvent").alias("@type"), F.col("title").alias("name"),
                     F.date_format("showtime", "yyyy-MM-dd'T'HH:mm").alias("startDate"),
                     F.struct(text("MovieTheater").alias("@type"), F.col("location").alias("name")).alias("location"),
                     movie.alias("workPresented"),
                     F.when(blank_to_null("url_tickets").isNotNull(), F.struct(text("Offer").alias("@type"), F.col("url_tickets").alias("url"))).alias("offers"),
                     F.when(F.upper("version").contains("VOSE"), text("es")).alias("subtitleLanguage"))
    return first.select("film_id", "seq", F.to_json(event).alias("event"))


def venue_directory(screenings: DataFrame, addresses: DataFrame) -> DataFrame:
    venues = screenings.where(blank_to_null("location").isNotNull()).select("location").distinct()
    return venues.join(addresses, "location", "left")


def spanish_day_label(day: Column) -> Column:
    """``lunes 29 de octubre de 2001``."""
    names = F.array(*[F.lit(d) for d in lookups.SPANISH_WEEKDAYS])
    months = F.array(*[F.lit(m) for m in lookups.SPANISH_MONTHS])
    return F.concat(F.element_at(names, F.weekday(day) + 1), F.lit(" "), F.day(day).cast("string"), F.lit(" de "),
                    F.element_at(months, F.month(day)), F.lit(" de "), F.year(day).cast("string"))


def daily_listing_lines(films: DataFrame, screenings: DataFrame, as_of: str, days: int = 14) -> DataFrame:
    """Sessions of the first ``days`` listed days with their text line. The day cut runs over distinct days."""
    upcoming = upcoming_sessions(screenings, as_of, "day").withColumn("day", F.to_date("showtime"))
    first_days = upcoming.select("day").distinct().orderBy("day").limit(days)
    f = films.select(F.col("id").alias("film_id"), "title", "director", "year")
    chosen = upcoming.join(F.broadcast(first_days), "day").join(f, "film_id").withColumn("time", F.date_format("showtime", "HH:mm"))
    label = F.concat(F.col("title"), F.coalesce(F.concat(F.lit(" — "), blank_to_null("director")), F.lit("")),
                     F.coalesce(F.concat(F.lit(" ("), F.col("year").cast("string"), F.lit(")")), F.lit("")))
    return chosen.withColumn("line", F.concat_ws(" · ", "time", "location", label))


def daily_listing_text(films: DataFrame, screenings: DataFrame, as_of: str, days: int = 14) -> DataFrame:
    """(day, label, position, line): the lines of each day by time, title, director, year and venue.

    One row per line whatever the length of a day; positions come from a range sort. Whoever writes a page joins the lines of a day.
    """
    order = [F.col("time"), F.col("title"), F.coalesce("director", F.lit("")), F.coalesce(F.col("year").cast("string"), F.lit("")), F.col("location"),
             F.coalesce("url_tickets", F.lit("")), F.col("seq"), F.col("film_id")]
    lines = daily_listing_lines(films, screenings, as_of, days)
    return rank_within(lines, ["day"], order, "position").select("day", spanish_day_label(F.col("day")).alias("label"), "position", "line")
