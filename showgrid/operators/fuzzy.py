"""Best title within a few edits, found by shared rare grams and never by comparing all titles."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from showgrid.operators.features import salted

#: Length of grams, shortest title that may differ by one edit, and by two.
Q, ONE_EDIT, TWO_EDITS = 2, 6, 12


def allowed_edits(t: Column) -> Column:
    return F.when(F.length(t) >= TWO_EDITS, 2).when(F.length(t) >= ONE_EDIT, 1).otherwise(0)


def gram_tokens(t: Column) -> Column:
    """Grams of a title, each with its number among equal ones, so that a title is a set of tokens."""
    grams = F.array_sort(F.transform(F.sequence(F.lit(1), F.length(t) - Q + 1), lambda i: F.substring(t, i, F.lit(Q))))
    return F.transform(grams, lambda g, i: F.concat(g, F.lit("#"), (i + 1 - F.array_position(grams, g)).cast("string")))


def prefixes(titles: DataFrame, frequency: DataFrame, edits: Column) -> DataFrame:
    """(t, token): the ``Q * edits + 1`` rarest tokens of each title."""
    tokens = titles.select("t", F.explode(gram_tokens(F.col("t"))).alias("token")).join(frequency, "token", "left")
    ordered = tokens.groupBy("t").agg(F.array_sort(F.collect_list(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "token"))).alias("x"))
    return ordered.select("t", F.explode(F.slice("x", F.lit(1), Q * edits + 1)).alias("x")).select("t", "x.token")


def fuzzy_titles(wanted: DataFrame, catalogue: DataFrame) -> DataFrame:
    """(t, distance, film_url, hit_year): for each distinct title ``t`` its nearest catalogue title within the allowed edits.

    ``catalogue`` has ``t, film_url, hit_year, viewers, id``. Titles of 6 characters or more may differ by one edit, of 12 or more by two; shorter and null ones match nothing
    here. The nearest title wins, then the most viewed film, then the smallest id. An edit changes at most ``Q`` tokens, so two titles
    within ``d`` edits share one of their ``Q * d + 1`` rarest tokens: only those are joined, frequent tokens salted, lengths compared before
    distances. Pairs are reduced to the best one before the shuffle and never stored.
    """
    long_enough = F.length("t") >= ONE_EDIT
    names = catalogue.where(F.col("film_url").isNotNull() & (F.length("t") >= ONE_EDIT - 1)).groupBy("t").agg(
        F.min(F.struct((-F.col("viewers")).alias("v"), "id", "film_url", "hit_year")).alias("film"))
    frequency = names.select(F.explode(gram_tokens(F.col("t"))).alias("token")).groupBy("token").agg(F.count(F.lit(1)).alias("n"))
    left = prefixes(wanted.where(long_enough).select("t").distinct(), frequency, allowed_edits(F.col("t")))
    right = prefixes(names.select("t"), frequency, F.lit(2)).withColumnRenamed("t", "r")
    many, few = salted(left, right, "token", "t")
    distance = F.levenshtein("t", "r", 2)
    near = many.join(few, ["token", "_salt"]).where(F.abs(F.length("t") - F.length("r")) <= allowed_edits(F.col("t"))).withColumn("distance", distance)
    near = near.where((F.col("distance") >= 0) & (F.col("distance") <= allowed_edits(F.col("t"))))
    found = near.select("t", "r", "distance").join(names.withColumnRenamed("t", "r"), "r")
    best = found.groupBy("t").agg(F.min(F.struct("distance", "film")).alias("b"))
    return best.select("t", "b.distance", "b.film.film_url", "b.film.hit_year")
