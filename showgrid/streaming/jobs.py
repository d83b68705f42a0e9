"""Structured Streaming jobs over the same operators as the batch side.

Every job writes through ``foreachBatch`` into a :class:`BucketedTable`, of which a batch rewrites the buckets it touches, or into a
:class:`VersionedTable`, whose versions are named by the batch id. A batch repeated after a failure counts once in both. Jobs take a trigger, so tests and backfills can use
``availableNow`` and production a processing-time interval.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from showgrid import lookups
from showgrid.operators.consolidate import drop_known_sessions, resolve_film_ids, upsert_screenings
from showgrid.operators.extract import carried_in_row, extract_sessions
from showgrid.operators.serving import cliff_of_daily
from showgrid.sources.writers import BucketedTable, VersionedTable
from showgrid.util import cut_lineage

AVAILABLE_NOW = {"availableNow": True}


def start(stream: DataFrame, write: Callable[[DataFrame, int], None], checkpoint: str, mode: str = "append", trigger: dict | None = None) -> StreamingQuery:
    return stream.writeStream.outputMode(mode).option("checkpointLocation", checkpoint).foreachBatch(write).trigger(**(trigger or AVAILABLE_NOW)).start()


SCREENING_SCHEMA = "film_id long, showtime timestamp_ntz, location string, seq long, url_tickets string, url_info string, version string, special string"


SCREENING_KEYS = ["film_id", "showtime", "location"]


def stream_ingest_sessions(sessions: DataFrame, table: VersionedTable | BucketedTable, checkpoint: str, start_day: str, end_day: str,
                           trigger: dict | None = None) -> StreamingQuery:
    """New and changed sessions to the stored table: sessions whose urls are known go, the rest is upserted.

    A session listed again with another ticket url or version replaces the stored row. Inside a batch the first row of a
    key by ``seq`` counts, as in the batch job; the table holds the earlier batches, so the stream needs no state. Of a bucketed table a batch reads the
    url columns of the range and rewrites only the buckets of its new sessions.
    """
    def write(batch: DataFrame, batch_id: int) -> None:
        bucketed = isinstance(table, BucketedTable)
        stored = table.read() if bucketed else table.read(SCREENING_SCHEMA)
        shaped = batch.withColumn("timestamp", F.date_format("showtime", "yyyy-MM-dd HH:mm"))
        new = drop_known_sessions(shaped, stored, start_day, end_day).select(*stored.columns)
        if bucketed:
            table.merge(new, upsert_screenings)
        else:
            table.write(upsert_screenings(stored, new), tag=f"batch{batch_id}")

    return start(sessions, write, checkpoint, trigger=trigger)


def page_sessions(pages: DataFrame, item: str, day: Callable[[Column], Column]) -> DataFrame:
    """(film_id, showtime, location, seq, urls, version, special, seen_at) of the listings of pages, row by row, on streams and batches alike.

    ``pages`` has ``page_id, url, html, seen_at``; group 1 of the pattern ``item`` is the text of a list item; ``day`` gives the date that an item heads, or null. Items
    that start with a time are sessions of the day above them. The place of an item is part of its ticket url, so sessions of a page differ.
    """
    tokens = F.regexp_extract_all("html", F.lit(item), F.lit(1))
    listed = pages.select("page_id", "url", "seen_at", F.explode(carried_in_row(tokens, lambda x: day(x).isNotNull())).alias("t"))
    rows = extract_sessions(listed.select("*", F.col("t.token").alias("text"), day(F.col("t.header")).alias("day")), "text", "day")
    return rows.select(F.col("page_id").alias("film_id"), "showtime", F.regexp_extract("url", "^[a-z]+://([^/?#]+)", 1).alias("location"), F.col("t.pos").cast("long").alias("seq"),
                       F.concat("url", F.lit("#"), F.col("t.pos").cast("string")).alias("url_tickets"), F.col("url").alias("url_info"),
                       F.when(F.upper("text").startswith("VOSE"), "VOSE").alias("version"), F.lit(None).cast("string").alias("special"), "seen_at")


def stream_page_sessions(pages: DataFrame, table: BucketedTable, checkpoint: str, item: str, day: Callable[[Column], Column], start_day: str, end_day: str,
                         watermark: str = "1 day", trigger: dict | None = None) -> StreamingQuery:
    """From a stream of pages to stored sessions: rules, repeated sessions dropped while the watermark keeps them, then the upsert.

    A session that comes again within ``watermark`` of ``seen_at``, from another page or file, is dropped by keyed state, which is freed afterwards; one that
    comes later still meets the stored row.
    """
    found = page_sessions(pages, item, day).withWatermark("seen_at", watermark).dropDuplicatesWithinWatermark(SCREENING_KEYS)
    return stream_ingest_sessions(found, table, checkpoint, start_day, end_day, trigger)


def upsert_changes(changes: DataFrame, keys: list[str], schema: str, table: VersionedTable | BucketedTable, checkpoint: str, trigger: dict | None = None) -> StreamingQuery:
    """Keep the latest row per key of an update-mode aggregation."""
    def latest(stored: DataFrame, batch: DataFrame) -> DataFrame:
        return stored.join(batch.select(*keys).distinct(), keys, "left_anti").unionByName(batch.select(*stored.columns))

    def write(batch: DataFrame, batch_id: int) -> None:
        if isinstance(table, BucketedTable):
            table.merge(batch, latest)
        else:
            table.write(latest(table.read(schema), batch), tag=f"batch{batch_id}")

    return start(changes, write, checkpoint, mode="update", trigger=trigger)


def stream_queue_metrics(queue: DataFrame, table: VersionedTable | BucketedTable, checkpoint: str, minutes: int = 3, watermark: str = "1 day", trigger: dict | None = None) -> StreamingQuery:
    """Entries per poll window and status, maintained incrementally; ``created_at`` is the event time."""
    counts = queue.withWatermark("created_at", watermark).groupBy(F.window("created_at", f"{minutes} minutes").alias("w"), "status").agg(
        F.count(F.lit(1)).alias("n")).select(F.col("w.start").alias("window_start"), "status", "n")
    return upsert_changes(counts, ["window_start", "status"], METRICS, table, checkpoint, trigger)


METRICS = "window_start timestamp, status string, n long"
#: Counts of a venue and day, the batch that changed them last, and what they were before it.
DAILY = "location string, day date, sessions long, special long, batch long, sessions_before long, special_before long"
CLIFF = "location string, cliff_day date, last_full_day date, gap_days int"


def stream_venue_coverage(sessions: DataFrame, daily: BucketedTable, checkpoint: str, cliffs: BucketedTable | None = None, trigger: dict | None = None) -> StreamingQuery:
    """Sessions per venue and day, and the publication cliff of each venue, kept up to date.

    The counts are a table by venue (``DAILY``, keyed by location) and not state of the stream, so days may come as late as they like and nothing waits for a watermark. A
    batch is one row a venue and day before it meets the table. A batch that comes again after a failure is recognised by its number and starts from
    the counts before it. The cliffs (``CLIFF``) are worked out anew for the venues of the batch only, from their daily rows.
    """
    def add(batch_id: int):
        def combine(stored: DataFrame, new: DataFrame) -> DataFrame:
            old = stored.select("location", "day", "sessions", "special", "batch", "sessions_before", "special_before")
            n = new.select("location", "day", F.col("sessions").alias("_n"), F.col("special").alias("_s"))
            again = F.col("batch") == batch_id
            base = lambda c: F.coalesce(F.when(again, F.col(f"{c}_before")).otherwise(F.col(c)), F.lit(0))
            both = old.join(n, (old.location.eqNullSafe(n.location)) & (old.day.eqNullSafe(n.day)), "full")
            hit = F.col("_n").isNotNull()
            return both.select(
                F.coalesce(old.location, n.location).alias("location"), F.coalesce(old.day, n.day).alias("day"),
                F.when(hit, base("sessions") + F.col("_n")).otherwise(F.col("sessions")).alias("sessions"), F.when(hit, base("special") + F.col("_s")).otherwise(F.col("special")).alias("special"),
                F.when(hit, F.lit(batch_id)).otherwise(F.col("batch")).cast("long").alias("batch"),
                F.when(hit, base("sessions")).otherwise(F.col("sessions_before")).alias("sessions_before"), F.when(hit, base("special")).otherwise(F.col("special_before")).alias("special_before"))
        return combine

    def write(batch: DataFrame, batch_id: int) -> None:
        counts = cut_lineage(batch.groupBy("location", F.to_date("showtime").alias("day")).agg(
            F.count(F.lit(1)).alias("sessions"), F.count_if(F.coalesce("special", F.lit("")) != "").alias("special")))
        touched = daily.merge(counts, add(batch_id))
        if cliffs is not None and touched:
            venues = counts.select("location").distinct()
            rows = daily.stored().where(F.col("bucket").isin(touched)).join(venues, "location", "left_semi")
            fresh = cliff_of_daily(rows.select("location", "day", F.col("sessions").alias("n"))).withColumn("gap_days", F.col("gap_days").cast("int"))
            cliffs.merge(fresh, lambda stored, new: stored.join(new.select("location"), "location", "left_anti").unionByName(new))

    return start(sessions, write, checkpoint, trigger=trigger)


def coverage_from_daily(daily: DataFrame) -> DataFrame:
    return daily.groupBy("location").agg(F.sum("sessions").alias("sessions"), F.max("day").alias("last_day"), F.sum("special").alias("special"))


def stream_resolve_ids(films: DataFrame, waiting: VersionedTable | BucketedTable, checkpoint: str, trigger: dict | None = None) -> StreamingQuery:
    """Each batch of newly stored films fills the film ids of waiting feedback rows; of a table bucketed by ``short_url`` only the buckets of the new films are touched."""
    def write(batch: DataFrame, batch_id: int) -> None:
        new = batch.select("id", "short_url").where("short_url is not null").distinct()
        if isinstance(waiting, BucketedTable):
            waiting.merge(new, resolve_film_ids)
        else:
            waiting.write(resolve_film_ids(waiting.read(), new), tag=f"batch{batch_id}")

    return start(films, write, checkpoint, trigger=trigger)


def match_feedback(feedback: DataFrame, films: DataFrame, wait: str = "1 day", watermark: str = "1 hour") -> DataFrame:
    """(user_id, short_url, film_id) where both sides are streams: a feedback row waits for its film, and leaves with null when none came.

    ``feedback`` has ``user_id, short_url, at``; ``films`` has ``id, short_url, stored_at``. A film may be stored up to ``wait`` before or after the
    feedback; both watermarks and that bound free the state of both sides. A null url matches nothing.
    """
    f = films.select("id", F.col("short_url").alias("_url"), "stored_at").withWatermark("stored_at", watermark)
    near = F.expr(f"short_url = _url and stored_at >= at - interval {wait} and stored_at <= at + interval {wait}")
    return feedback.withWatermark("at", watermark).join(f, near, "left_outer").select("user_id", "short_url", F.col("id").alias("film_id"))


# --- queue as keyed state -----------------------------------------------------------------------------------

STATE = "status string, retry_count int, locked_us long"
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
CHANGE = "short_url string, at timestamp, status string, retry_count int, cause string"


LEASE, LEASE_US = pd.Timedelta(minutes=lookups.LEASE_MINUTES), lookups.LEASE_MINUTES * 60_000_000


def next_state(status: str | None, retries: int, locked_at, action: str, at, lease=LEASE):
    """One queue transition: (status, retries, locked_at), or None when the action does not apply.

    A lease older than the limit counts as expired before any action is looked at. Times and ``lease`` may be microseconds.
    """
    if status == "processing" and locked_at is not None and at - locked_at > lease:
        status, locked_at = "pending", None
    if action == "request":
        if status is None or status in ("done", "failed"):
            return ("failed" if retries >= lookups.MAX_RETRIES else "pending"), retries, None
    elif action == "take" and status == "pending" and retries < lookups.MAX_RETRIES:
        return "processing", retries, at
    elif action == "ok" and status == "processing":
        return "done", retries, None
    elif action == "fail" and status == "processing":
        retries += 1
        return ("failed" if retries >= lookups.MAX_RETRIES else "pending"), retries, None
    return None


def in_order(us: list, ids: list, actions: list) -> list[tuple]:
    """(us, action) of the events with a time, by time, id and action; missing ids and actions come last."""
    gone = lambda v: v is None or v != v
    rows = [(int(u), gone(i), 0 if gone(i) else i, gone(a), "" if gone(a) else a) for u, i, a in zip(us, ids, actions) if not gone(u)]
    return [(r[0], None if r[3] else r[4]) for r in sorted(rows)]


class QueueEntry(StatefulProcessor):
    """The entry of one url: three values with a time to live, and a timer for its lease."""

    columns = ["short_url", "us", "status", "retry_count", "cause"]

    def __init__(self, keep_ms: int | None):
        self.keep_ms = keep_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.entry = handle.getValueState("entry", STATE, ttlDurationMs=self.keep_ms)

    def load(self):
        status, retries, locked = self.entry.get() if self.entry.exists() else (None, 0, None)
        return status, retries, None if locked is None or pd.isna(locked) else int(locked)

    @staticmethod
    def due_ms(locked: int) -> int:
        """First millisecond after the lease."""
        return (locked + LEASE_US) // 1000 + 1

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        status, retries, locked = self.load()
        held, us, ids, actions, out = locked, [], [], [], []
        for r in rows:
            us += r["us"].tolist()
            ids += r["event_id"].tolist()
            actions += r["action"].tolist()
        for at, action in in_order(us, ids, actions):
            moved = next_state(status, retries, locked, action, at, LEASE_US)
            if moved is not None:
                status, retries, locked = moved
                out.append((key[0], at, status, retries, action))
        if out:
            self.entry.update((status, retries, locked))
            if held is not None:
                self.handle.deleteTimer(self.due_ms(held))
            if status == "processing":
                self.handle.registerTimer(self.due_ms(locked))
            yield pd.DataFrame(out, columns=self.columns)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        status, retries, locked = self.load()
        if status == "processing" and self.due_ms(locked) <= expiredTimerInfo.getExpiryTimeInMs():
            self.entry.update(("pending", retries, None))
            yield pd.DataFrame([(key[0], locked + LEASE_US, "pending", retries, "lease expired")], columns=self.columns)


def queue_stream_state(events: DataFrame, keep_days: float | None = 365) -> DataFrame:
    """Queue transitions as keyed state, with a lease timer an entry that fires without new events.

    ``events`` has ``short_url, event_id, at, action``. Events of a key in one micro-batch are taken in order of time, then id; an event without time moves
    nothing. Timers run by the clock: a lease that is over at the end of a micro-batch returns the entry to pending, dated to the end of the lease. An entry
    that nothing moved for ``keep_days`` is forgotten, its retries too. Start it by ``start_queue``, which sets what the stream needs.
    """
    keyed = events.select("short_url", "event_id", F.unix_micros("at").alias("us"), "action").groupBy("short_url")
    keep_ms = None if keep_days is None else int(keep_days * 86_400_000)
    moved = keyed.transformWithStateInPandas(QueueEntry(keep_ms), "short_url string, us long, status string, retry_count int, cause string", "Append", "ProcessingTime")
    return moved.select("short_url", F.timestamp_micros("us").alias("at"), "status", "retry_count", "cause")


def start_queue(transitions: DataFrame, write: Callable[[DataFrame, int], None], checkpoint: str, trigger: dict | None = None) -> StreamingQuery:
    """Starts ``queue_stream_state`` on the RocksDB store, which keeps states on disk. The session's own settings are the same afterwards.

    A stream that goes on gets micro-batches without data, in which timers fire; one that drains what is there must not, since timers by the clock would always ask for one more.
    """
    conf = transitions.sparkSession.conf
    drains = "availableNow" in (trigger or AVAILABLE_NOW)
    wanted = {"spark.sql.streaming.stateStore.providerClass": ROCKSDB, "spark.sql.streaming.noDataMicroBatches.enabled": str(not drains).lower()}
    before = {k: conf.get(k) for k in wanted}
    for k, v in wanted.items():
        conf.set(k, v)
    try:
        return start(transitions, write, checkpoint, trigger=trigger)
    finally:
        for k, v in before.items():
            conf.set(k, v)
