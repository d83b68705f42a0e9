"""Per-user statistics and snapshots."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from showgrid import lookups


def feedback_summary(watched: DataFrame, liked_as: float | None = None) -> DataFrame:
    """Watched, rated, mean rating and five-star films per user; an unrated like may count as a rating."""
    rating = F.col("rating")
    if liked_as is not None:
        rating = F.coalesce(rating, F.when(F.col("liked"), F.lit(liked_as)))
    return watched.groupBy("user_id").agg(
        F.count(F.lit(1)).alias("watched"), F.count(rating).alias("rated"), F.avg(rating).alias("mean_rating"),
        F.count_if(rating >= 5).alias("five_star"))


def rewatch_counts(diary: DataFrame) -> DataFrame:
    return diary.where(F.lower(F.trim("Rewatch")) == "yes").groupBy("user_id", "uri").agg(
        F.count(F.lit(1)).cast("int").alias("rewatch_count"))


def enrichment_progress(watched: DataFrame, queue: DataFrame) -> DataFrame:
    """Total and resolved films per user; done when no active queue entry of the user is left."""
    totals = watched.groupBy(F.col("user_id").cast("string").alias("user_id")).agg(
        F.count(F.lit(1)).alias("total"), F.count("film_id").alias("processed"))
    active = queue.where(F.col("status").isin("pending", "processing") & (F.col("retry_count") < lookups.MAX_RETRIES)).groupBy(
        F.col("requested_by").alias("user_id")).agg(F.count(F.lit(1)).alias("active"))
    return totals.join(active, "user_id", "left").withColumn("active", F.coalesce("active", F.lit(0))).withColumn("done", F.col("active") == 0)


def user_snapshot(preferences: DataFrame, watched: DataFrame, watchlist: DataFrame, scores: DataFrame) -> DataFrame:
    """Everything a page needs per user, one row per user, kind and item, with the user's preferences or their defaults.

    The grain never depends on the length of a list. A user with preferences and empty lists has one row without kind.
    """
    def listed(df, kind, item):
        return df.select("user_id", F.lit(kind).alias("kind"), item.alias("item")).distinct()

    lists = listed(watched, "watched", F.col("short_url")).unionByName(listed(watchlist, "watchlist", F.col("short_url"))).unionByName(
        listed(scores, "scores", F.concat_ws(":", F.col("film_id").cast("string"), F.col("score").cast("string"))))
    return (
        lists.join(preferences, "user_id", "full")
        .withColumn("lang", F.coalesce("lang", F.lit("es")))
        .withColumn("watchlist_active", F.coalesce("watchlist_active", F.lit(False)))
        .withColumn("watched_active", F.coalesce("watched_active", F.lit(False)))
    )
