"""Metadata documents (nested JSON) to film columns, without leaving the JVM."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from showgrid import lookups

PERSON = "struct<id:long,name:string>"
DOCUMENT_SCHEMA = f"""
id long, title string, name string, original_title string, original_name string, original_language string,
genres array<{PERSON}>, production_countries array<struct<iso_3166_1:string,name:string>>, origin_country array<string>,
spoken_languages array<struct<english_name:string,iso_639_1:string,name:string>>,
translations struct<translations:array<struct<iso_639_1:string,iso_3166_1:string,data:struct<title:string,name:string>>>>,
runtime int, number_of_episodes int, episode_run_time array<int>, vote_average double, vote_count int,
overview string, tagline string, belongs_to_collection {PERSON},
credits struct<crew:array<struct<id:long,name:string,job:string>>,cast:array<{PERSON}>>,
created_by array<{PERSON}>, keywords struct<keywords:array<{PERSON}>,results:array<{PERSON}>>,
production_companies array<{PERSON}>, recommendations struct<results:array<struct<id:long>>>, poster_path string
"""


def _list(c: Column, ddl: str) -> Column:
    return F.coalesce(c, F.expr(f"cast(array() as {ddl})"))


def _text(c: Column) -> Column:
    return F.nullif(c, F.lit(""))


def _identified(c: Column) -> Column:
    """Entries with both id and name, as (id, name)."""
    kept = F.filter(_list(c, f"array<{PERSON}>"), lambda x: (x["id"] != 0) & (x["name"] != ""))
    return F.transform(kept, lambda x: F.struct(x["id"].alias("id"), x["name"].alias("name")))


def _names(c: Column) -> Column:
    return F.transform(F.filter(c, lambda x: x["name"] != ""), lambda x: x["name"])


def top_n_credits(crew: Column, jobs: list[str], n: int, distinct: bool = False) -> Column:
    """First ``n`` crew members with one of ``jobs`` in source order, optionally distinct by id."""
    crew = _list(crew, f"array<struct<id:long,name:string,job:string>>")
    chosen = F.filter(crew, lambda x: x["job"].isin(jobs) & (x["id"] != 0) & (x["name"] != ""))
    if distinct:
        every = chosen
        chosen = F.filter(every, lambda x, i: ~F.exists(F.slice(every, F.lit(1), i), lambda y: y["id"] == x["id"]))
    return F.transform(F.slice(chosen, 1, n), lambda x: F.struct(x["id"].alias("id"), x["name"].alias("name")))


def prioritized_credits(creators: Column, crew: Column, priority: dict[str, int], n: int = 2) -> Column:
    """The creators, or without any the crew ordered by job priority and source position."""
    first = F.slice(_identified(creators), 1, n)
    table = F.create_map(*[F.lit(x) for pair in priority.items() for x in pair])
    crew = F.filter(_list(crew, "array<struct<id:long,name:string,job:string>>"),
                    lambda x: x["job"].isin(list(priority)) & (x["id"] != 0) & (x["name"] != ""))
    ranked = F.array_sort(F.transform(crew, lambda x, i: F.struct(
        F.element_at(table, x["job"]).alias("p"), i.alias("i"), x["id"].alias("id"), x["name"].alias("name"))))
    backup = F.transform(F.slice(ranked, 1, n), lambda x: F.struct(x["id"].alias("id"), x["name"].alias("name")))
    return F.when(F.size(first) > 0, first).otherwise(backup)


def tv_runtime_estimate(episodes: Column, runtimes: Column) -> Column:
    """Episodes times the truncated mean episode length; without a count, the first valid length."""
    valid = F.filter(_list(runtimes, "array<int>"), lambda x: x > 0)
    mean = F.floor(F.aggregate(valid, F.lit(0).cast("long"), lambda a, x: a + x) / F.nullif(F.size(valid), F.lit(0)))
    total = F.when((episodes > 0) & (mean > 0), episodes * mean)
    return F.coalesce(total, F.try_element_at(valid, F.lit(1))).cast("int")


def pick_languages(code: Column, spoken: Column) -> Column:
    """(primary, spoken) language names; the primary falls back from the spoken list to the code table."""
    spoken = _list(spoken, "array<struct<english_name:string,iso_639_1:string,name:string>>")
    named = F.filter(F.transform(spoken, lambda x: F.struct(
        x["iso_639_1"].alias("code"), F.coalesce(_text(x["english_name"]), _text(x["name"])).alias("name"))),
        lambda x: x["name"].isNotNull())
    table = F.create_map(*[F.lit(x) for pair in lookups.LANGUAGE_NAMES.items() for x in pair])
    match = F.try_element_at(F.filter(named, lambda x: x["code"] == code), F.lit(1))["name"]
    primary = F.coalesce(match, F.when(code != "", F.coalesce(F.try_element_at(table, code), code)))
    return F.struct(F.array_compact(F.array(primary)).alias("primary"),
                    F.transform(named, lambda x: x["name"]).alias("spoken"))


def pick_translations(translations: Column, code: Column, original: Column, main: Column) -> Column:
    """(en, es) titles. Spanish prefers the country ES; English falls back to the original or main title."""
    titled = F.filter(F.transform(
        _list(translations, "array<struct<iso_639_1:string,iso_3166_1:string,data:struct<title:string,name:string>>>"),
        lambda x: F.struct(x["iso_639_1"].alias("lang"), x["iso_3166_1"].alias("country"),
                           F.coalesce(_text(x["data"]["title"]), _text(x["data"]["name"])).alias("title"))),
        lambda x: x["title"].isNotNull())

    def first(pred):
        return F.try_element_at(F.filter(titled, pred), F.lit(1))["title"]

    fallback = F.when(code == "en", original).when((main != "") & ~main.eqNullSafe(original), main)
    return F.struct(F.coalesce(first(lambda x: x["lang"] == "en"), fallback).alias("en"),
                    F.coalesce(first(lambda x: (x["lang"] == "es") & (x["country"] == "ES")),
                               first(lambda x: x["lang"] == "es")).alias("es"))


def union_languages(primary: Column, spoken: Column) -> Column:
    """Distinct lower-cased languages of both lists."""
    empty = F.expr("cast(array() as array<string>)")
    return F.array_distinct(F.transform(F.concat(F.coalesce(primary, empty), F.coalesce(spoken, empty)), F.lower))


def normalize_documents(df: DataFrame, document: str = "document", kind: str = "kind") -> DataFrame:
    """One film row per metadata document; ``kind`` is ``movie`` or ``tv``. Other columns are kept."""
    kept = [c for c in df.columns if c not in (document, kind)]
    parsed = df.select(*kept, F.col(kind).alias("_kind"), F.from_json(document, DOCUMENT_SCHEMA).alias("d"))
    movie = F.col("_kind") == "movie"
    d = lambda path: F.col(f"d.{path}")
    crew = d("credits.crew")
    countries = _names(_list(d("production_countries"), "array<struct<iso_3166_1:string,name:string>>"))
    keywords = _identified(d("keywords.keywords"))
    original = F.when(movie, _text(d("original_title"))).otherwise(_text(d("original_name")))
    languages = pick_languages(F.coalesce(d("original_language"), F.lit("")), d("spoken_languages"))
    titles = pick_translations(d("translations.translations"), d("original_language"), original,
                               F.coalesce(_text(d("title")), _text(d("name"))))
    wide = parsed.withColumn("_l", languages).withColumn("_t", titles)
    return wide.select(
        *kept,
        d("id").alias("tmdb_id"),
        _names(_list(d("genres"), f"array<{PERSON}>")).alias("genres"),
        F.when(movie | (F.size(countries) > 0), countries).otherwise(_list(d("origin_country"), "array<string>")).alias("country"),
        F.col("_l.primary").alias("primary_language"), F.col("_l.spoken").alias("spoken_languages"),
        F.when(movie, F.when(d("runtime") > 0, d("runtime")))
        .otherwise(tv_runtime_estimate(d("number_of_episodes"), d("episode_run_time"))).alias("runtime_minutes"),
        F.when(movie, top_n_credits(crew, ["Director"], 2))
        .otherwise(prioritized_credits(d("created_by"), crew, lookups.DIRECTOR_PRIORITY)).alias("directors"),
        top_n_credits(crew, ["Director of Photography"], 2).alias("cinematographers"),
        top_n_credits(crew, ["Original Music Composer"], 2).alias("composers"),
        top_n_credits(crew, lookups.WRITER_JOBS, 3, distinct=True).alias("writers"),
        F.slice(_identified(d("credits.cast")), 1, 5).alias("top_cast"),
        F.when(F.size(keywords) > 0, keywords).otherwise(_identified(d("keywords.results"))).alias("keywords"),
        F.when(d("vote_average") > 0, F.round(d("vote_average"), 2)).alias("tmdb_rating"),
        F.when(d("vote_count") > 0, d("vote_count")).alias("tmdb_votes"),
        _identified(d("production_companies")).alias("production_companies"),
        d("belongs_to_collection.name").alias("collection_name"), d("belongs_to_collection.id").alias("collection_id"),
        F.array_compact(F.transform(F.slice(_list(d("recommendations.results"), "array<struct<id:long>>"), 1, 10),
                                    lambda x: x["id"])).alias("tmdb_recommendations"),
        _text(d("overview")).alias("overview"), _text(d("tagline")).alias("tagline"), original.alias("title_original"),
        F.col("_t.en").alias("title_en"), F.col("_t.es").alias("title_es"), _text(d("poster_path")).alias("poster_path"),
    )
