"""Enrichment queue as snapshot transitions: each step maps the queue table to the next one."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from showgrid import lookups

NULL_TIME = "cast(null as timestamp_ntz)"


def _now(now: str) -> Column:
    return F.lit(now).cast("timestamp_ntz")


class Batch(NamedTuple):
    taken: DataFrame
    queue: DataFrame


def queue_enqueue(queue: DataFrame, urls: DataFrame, films: DataFrame, user: str, now: str) -> DataFrame:
    """Upsert the user's urls without a known film as pending; retry counts stay and exhausted entries fail."""
    known = films.where("short_url is not null").select("short_url")
    asked = urls.select("short_url").where("short_url is not null").distinct().join(known, "short_url", "left_anti").withColumn("_asked", F.lit(True))
    merged = queue.join(asked, "short_url", "full")
    asked_now = F.coalesce(F.col("_asked"), F.lit(False))
    retries = F.coalesce("retry_count", F.lit(0))
    requested = F.when(asked_now, F.lit(user)).otherwise(F.col("requested_by"))
    status = F.when(asked_now, F.lit("pending")).otherwise(F.col("status"))
    exhausted = (requested == user) & (status == "pending") & (retries >= lookups.MAX_RETRIES)
    return merged.select(
        "id", "short_url", F.when(exhausted, F.lit("failed")).otherwise(status).alias("status"), requested.alias("requested_by"),
        F.coalesce("created_at", _now(now)).alias("created_at"),
        F.when(exhausted, _now(now)).when(asked_now, F.expr(NULL_TIME)).otherwise(F.col("processed_at")).alias("processed_at"),
        F.when(asked_now, F.expr(NULL_TIME)).otherwise(F.col("locked_at")).alias("locked_at"),
        retries.alias("retry_count"), "override_url")


def expire_leases(queue: DataFrame, now: str) -> DataFrame:
    stale = (F.col("status") == "processing") & (F.col("locked_at") < _now(now) - F.expr(f"interval {lookups.LEASE_MINUTES} minutes"))
    return queue.withColumn("_stale", F.coalesce(stale, F.lit(False))).withColumn(
        "status", F.when(F.col("_stale"), F.lit("pending")).otherwise(F.col("status"))).withColumn(
        "locked_at", F.when(F.col("_stale"), F.expr(NULL_TIME)).otherwise(F.col("locked_at"))).drop("_stale")


def queue_take_batch(queue: DataFrame, now: str, size: int = lookups.BATCH_SIZE, max_workers: int = lookups.MAX_WORKERS) -> Batch:
    """Expire leases, then lease the oldest ``size`` pending entries unless enough are being processed.

    The batch is a top-k, so no task sorts the whole queue; it is bounded by ``size`` and broadcast back.
    """
    healed = expire_leases(queue, now)
    active = healed.where((F.col("status") == "processing") & (F.col("locked_at") > _now(now) - F.expr(f"interval {lookups.LEASE_MINUTES} minutes"))).agg(
        F.count(F.lit(1)).alias("_active"))
    oldest = healed.where((F.col("status") == "pending") & (F.col("retry_count") < lookups.MAX_RETRIES)).orderBy("created_at", "id").limit(size).select("id")
    batch = oldest.crossJoin(F.broadcast(active)).where(F.col("_active") < max_workers * size).select("id", F.lit(True).alias("_taken"))
    moved = healed.join(F.broadcast(batch), "id", "left").withColumn(
        "status", F.when(F.col("_taken"), F.lit("processing")).otherwise(F.col("status"))).withColumn(
        "locked_at", F.when(F.col("_taken"), _now(now)).otherwise(F.col("locked_at")))
    return Batch(moved.where("_taken").drop("_taken"), moved.drop("_taken"))


def queue_settle(queue: DataFrame, outcomes: DataFrame, now: str) -> DataFrame:
    """Apply outcomes (``id, ok``): done, or one more retry and back to pending until the retries are used up."""
    retries = F.col("retry_count") + 1
    failed = F.col("ok") == F.lit(False)
    exhausted = failed & (retries >= lookups.MAX_RETRIES)
    settled = queue.join(outcomes, "id", "left")
    return settled.select(
        "id", "short_url",
        F.when(F.col("ok"), F.lit("done")).when(exhausted, F.lit("failed")).when(failed, F.lit("pending")).otherwise(F.col("status")).alias("status"),
        "requested_by", "created_at",
        F.when(F.col("ok") | exhausted, _now(now)).when(failed, F.expr(NULL_TIME)).otherwise(F.col("processed_at")).alias("processed_at"),
        F.when(failed, F.expr(NULL_TIME)).otherwise(F.col("locked_at")).alias("locked_at"),
        F.when(failed, retries).otherwise(F.col("retry_count")).alias("retry_count"), "override_url")


def queue_retry_override(queue: DataFrame, overrides: DataFrame) -> Batch:
    """Reset entries that get an override url; overrides without an entry are returned as errors."""
    o = overrides.select("short_url", F.col("override_url").alias("_o"))
    hit = F.col("_o").isNotNull()
    reset = queue.join(o, "short_url", "left").select(
        "id", "short_url", F.when(hit, F.lit("pending")).otherwise(F.col("status")).alias("status"), "requested_by", "created_at",
        F.when(hit, F.expr(NULL_TIME)).otherwise(F.col("processed_at")).alias("processed_at"),
        F.when(hit, F.expr(NULL_TIME)).otherwise(F.col("locked_at")).alias("locked_at"),
        F.when(hit, F.lit(0)).otherwise(F.col("retry_count")).alias("retry_count"), F.coalesce("_o", "override_url").alias("override_url"))
    errors = overrides.join(queue.select("short_url"), "short_url", "left_anti").withColumn("error", F.lit("no queue entry"))
    return Batch(errors, reset)


def queue_metrics(queue: DataFrame) -> DataFrame:
    """Entries per status, with a flag whether work is waiting."""
    return queue.groupBy("status").agg(F.count(F.lit(1)).alias("n")).withColumn("waiting", F.col("status").isin("pending", "processing"))


def queue_poll_windows(queue: DataFrame, minutes: int = 3) -> DataFrame:
    """Entries per poll window and status; the same plan runs on a stream with a watermark."""
    return queue.groupBy(F.window("created_at", f"{minutes} minutes").alias("w"), "status").agg(F.count(F.lit(1)).alias("n")).select(
        F.col("w.start").alias("window_start"), "status", "n")
