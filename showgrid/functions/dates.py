"""Dates, numbers, buckets and links as column expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from showgrid import lookups
from showgrid.util import blank_to_null


def parse_showtime(c: Column) -> Column:
    """``YYYY-MM-DD HH:MM`` or ISO text to a local timestamp; anything else is null."""
    text = F.trim(c)
    ok = F.rlike(text, F.lit(r"^\d{4}-\d{2}-\d{2}[ T]\d{2}:\d{2}(:\d{2})?"))
    return F.when(ok, F.replace(F.substring(text, 1, 16), F.lit("T"), F.lit(" ")).try_cast("timestamp_ntz"))


def month_name(month: Column) -> Column:
    return F.element_at(F.array(*[F.lit(m) for m in lookups.SPANISH_MONTHS]), month)


def month_abbreviation(month: Column) -> Column:
    return F.element_at(F.array(*[F.lit(m) for m in lookups.SPANISH_MONTH_ABBREVIATIONS]), month)


def month_number(name: Column) -> Column:
    """Month of a Spanish name or abbreviation, null when unknown."""
    pairs = [(m, i) for names in (lookups.SPANISH_MONTHS, lookups.SPANISH_MONTH_ABBREVIATIONS) for i, m in enumerate(names, 1)]
    table = F.create_map(*[F.lit(x) for pair in pairs for x in pair])
    return F.try_element_at(table, F.regexp_replace(F.lower(F.trim(name)), r"\.$", ""))


LONG_DATE = r"(?i)^\s*(\d{1,2})\s+de\s+(\p{L}+)\s*-\s*(\d{1,2}):(\d{2})h?"
SHORT_DATE = r"^[^,]*,\s*(\d{1,2})\s+(\p{L}+\.?)\s*$"


def parse_localized_date(c: Column, year: Column) -> Column:
    """``3 de Febrero - 17:00h`` or ``Mié, 11 Feb`` in the given year; impossible dates are null."""
    def number(pattern, group):
        return F.nullif(F.regexp_extract(c, pattern, group), F.lit("")).try_cast("int")

    long_ = F.try_make_timestamp_ntz(year, month_number(F.regexp_extract(c, LONG_DATE, 2)), number(LONG_DATE, 1),
                                     number(LONG_DATE, 3), number(LONG_DATE, 4), F.lit(0))
    short = F.try_make_timestamp_ntz(year, month_number(F.regexp_extract(c, SHORT_DATE, 2)), number(SHORT_DATE, 1),
                                     F.lit(0), F.lit(0), F.lit(0))
    return F.coalesce(long_, short)


def resolve_year_rollover(day: Column, month: Column, reference: Column) -> Column:
    """Date of a day and month without year: a month before the reference month is next year."""
    year = F.when(month < F.month(reference), F.year(reference) + 1).otherwise(F.year(reference))
    return F.to_date(F.try_make_timestamp_ntz(year, month, day, F.lit(0), F.lit(0), F.lit(0)))


def resolve_relative_day(label: Column, reference: Column) -> Column:
    """``Hoy``, ``Mañana`` or ``Name DD/MM``."""
    low = F.lower(F.trim(label))
    day = F.nullif(F.regexp_extract(label, r"(\d{2})/(\d{2})", 1), F.lit("")).try_cast("int")
    month = F.nullif(F.regexp_extract(label, r"(\d{2})/(\d{2})", 2), F.lit("")).try_cast("int")
    return (F.when(low == "hoy", reference).when(low == "mañana", F.date_add(reference, 1))
            .otherwise(resolve_year_rollover(day, month, reference)))


def epoch_millis_date(c: Column) -> Column:
    """Date of ``/Date(ms)/`` in UTC, independent of the session time zone."""
    millis = F.nullif(F.regexp_extract(c, r"/Date\((-?\d+)\)/", 1), F.lit("")).try_cast("long")
    return F.date_from_unix_date(F.floor(millis / 86400000).cast("int"))


def decade_bucket(year: Column) -> Column:
    return (F.when(year.isNull(), F.lit("unknown")).when(year < 1960, F.lit("pre-1960"))
            .otherwise(F.concat((F.floor(year / 10) * 10).cast("string"), F.lit("s"))))


def runtime_bucket(minutes: Column) -> Column:
    return (F.when(minutes.isNull(), F.lit("unknown")).when(minutes < 90, F.lit("short"))
            .when(minutes <= 120, F.lit("medium")).when(minutes <= 150, F.lit("long")).otherwise(F.lit("epic")))


def popularity_boost(viewers: Column) -> Column:
    return F.when(viewers > 0, 1 + F.least(F.log10(viewers) / 150, F.lit(0.05))).otherwise(F.lit(1.0))


def recency_decay(watched: Column, as_of: str) -> Column:
    """Decay over days since watching, never below 0.3; an unknown date does not decay."""
    seconds = F.unix_seconds(F.lit(as_of).cast("timestamp_ntz").cast("timestamp")) - F.unix_seconds(watched.cast("timestamp"))
    return F.coalesce(F.greatest(F.lit(0.3), F.exp(F.lit(-0.00385) * seconds / 86400)), F.lit(1.0))


# --- links ------------------------------------------------------------------------------------------

def calendar_link(base: str, title: Column, year: Column, start: Column, minutes: Column) -> Column:
    """Calendar event link; the event ends after the runtime, or after two hours when it is unknown."""
    length = F.when(minutes > 0, minutes).otherwise(F.lit(120))
    label = F.concat(title, F.coalesce(F.concat(F.lit(" ("), year.cast("string"), F.lit(")")), F.lit("")))
    form = "yyyyMMdd'T'HHmm'00'"
    end = start + F.make_dt_interval(F.lit(0), F.lit(0), length, F.lit(0))
    return F.concat(F.lit(f"{base}?action=TEMPLATE&text="), F.url_encode(label), F.lit("&dates="),
                    F.date_format(start, form), F.lit("/"), F.date_format(end, form))


def ticket_link(base: str, venue_code: Column, session_code: Column) -> Column:
    return F.concat(F.lit(f"{base}?cinemaVistaId="), venue_code.cast("string"), F.lit("&showtimeVistaId="), session_code.cast("string"))


def primary_action_url(sessions: DataFrame, homes: DataFrame) -> DataFrame:
    """Best link of a session: tickets, info, film page, venue home. The info link is a second one if distinct."""
    tickets, info = blank_to_null("url_tickets"), blank_to_null("url_info")
    page = blank_to_null("film_url")
    detail = F.coalesce(info, page)
    url = F.coalesce(tickets, info, page, F.col("home"))
    return (
        sessions.join(homes, "location", "left")
        .withColumn("url", url)
        .withColumn("is_specific", tickets.isNotNull() | info.isNotNull())
        .withColumn("secondary_url", F.when(detail != F.col("url"), detail))
    )
