"""Audits and enrichment selection."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from showgrid import lookups
from showgrid.operators.serving import upcoming_sessions
from showgrid.util import blank_to_null


def special_session_rules(entries: DataFrame) -> DataFrame:
    """Suggested special-session keyword and the rule that fired, first match wins."""
    title, director = F.col("title"), blank_to_null("director")
    no_credit = director.isNull() & F.col("year").isNull()
    same = F.lower(F.substring_index(title, ",", 1)) == F.lower(director)
    ladder = [(F.rlike(title, F.lit(p)), kind, rule) for kind, rule, p in lookups.SPECIAL_TITLE_RULES] + [
        (F.rlike(director, F.lit(lookups.VARIOUS_AUTHORS_PATTERN)), "compilation", "various_authors"),
        (same, "conference", "director_is_subject"),
        (F.contains(title, F.lit(" + ")), "shorts", "joined_titles"),
        (no_credit, "event", "no_director_no_year"),
    ]
    def pick(i):
        out = None
        for row in ladder:
            out = F.when(row[0], F.lit(row[i])) if out is None else out.when(row[0], F.lit(row[i]))
        return out
    return entries.withColumn("suggested_special", pick(1)).withColumn("rule", pick(2))


def integrity_audit(films: DataFrame, screenings: DataFrame, entries: DataFrame, start: str, end: str) -> DataFrame:
    """One row per violation: ``rule``, ``key``, ``detail``.

    The entry rules share one pass over the entries: each row yields the array of rules it breaks.
    """
    showtime = F.date_format("showtime", "yyyy-MM-dd HH:mm")
    duplicates = (
        screenings.groupBy("film_id", "showtime", "location").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
        .select(F.lit("duplicate_session").alias("rule"), F.col("film_id").cast("string").alias("key"), F.concat_ws("|", showtime, F.col("location")).alias("detail"))
    )
    no_metadata = films.where(F.col("rating").isNull() & F.col("tmdb_id").isNull() & F.col("viewers").isNull()).select(
        F.lit("no_metadata").alias("rule"), F.col("id").cast("string").alias("key"), F.col("title").alias("detail"))
    day = F.substring("timestamp", 1, 10)
    director = blank_to_null("director")
    checks = [
        ("out_of_range", (day < start) | (day > end), F.col("timestamp")),
        ("no_director_no_year", director.isNull() & F.col("year").isNull(), F.col("title")),
        ("joined_titles", F.contains("title", F.lit("+")), F.col("title")),
        ("director_in_title", F.contains(F.lower("title"), F.lower(director)), F.col("title")),
        ("truncated_title", F.rlike("title", F.lit(r"(\.\.\.|…|[-,:(])$")), F.col("title")),
        ("mojibake", F.rlike("title", F.lit("Ã.|Â.|�")), F.col("title")),
    ]
    found = F.array_compact(F.array(*[F.when(cond, F.struct(F.lit(rule).alias("rule"), detail.alias("detail"))) for rule, cond, detail in checks]))
    entry_rules = entries.select(F.col("seq").cast("string").alias("key"), F.explode(found).alias("v")).select("v.rule", "key", "v.detail")
    return duplicates.unionByName(no_metadata).unionByName(entry_rules)


def has_value(df: DataFrame, column: str) -> Column:
    kind = df.schema[column].dataType.simpleString()
    c = F.col(column)
    if kind.startswith("array"):
        return F.coalesce(F.size(c) > 0, F.lit(False))
    return c.isNotNull() & (c != "") if kind == "string" else c.isNotNull()


def needs_enrichment(films: DataFrame, fields: list[str], url: str = "film_url", backfill: bool = False, any_missing: bool = False,
                     recent_years: int = 0, this_year: int = 0, screenings: DataFrame | None = None, as_of: str | None = None) -> DataFrame:
    """Films with an external url and no value in any of ``fields`` (or, with ``any_missing``, in some of them).

    ``backfill`` selects regardless of values. ``recent_years`` keeps films of the last years; ``screenings`` with
    ``as_of`` keeps films with an upcoming session.
    """
    chosen = films.where(blank_to_null(url).isNotNull())
    if not backfill:
        present = [has_value(films, f) for f in fields]
        chosen = chosen.where(~reduce(lambda a, b: a & b if any_missing else a | b, present))
    if recent_years:
        chosen = chosen.where(F.col("year") >= this_year - recent_years)
    if screenings is not None:
        active = upcoming_sessions(screenings, as_of).select("film_id")
        chosen = chosen.join(active, chosen.id == active.film_id, "left_semi")
    return chosen
