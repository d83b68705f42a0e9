"""Consolidation of scraped entries: flatten, nest, merge, upsert and archive.

The working shape is flat: one row per session with the scalars of its film entry and a ``seq`` that
fixes the input order. First-wins and last-wins are aggregates over that order.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from showgrid.functions.dates import parse_showtime
from showgrid.util import blank_to_null, cut_lineage, first_by, global_rank, rank_within


class Listing(NamedTuple):
    """Films and their sessions under a common ``film_key``."""

    films: DataFrame
    sessions: DataFrame


def flatten_sessions(nested: DataFrame) -> DataFrame:
    """Film entries with ``dates`` arrays to one row per session.

    The entry's theater, link and special fill what a session lacks; sessions without time are dropped.
    """
    rest = [c for c in nested.columns if c not in ("dates", "special")]
    special = F.col("special") if "special" in nested.columns else F.lit(None).cast("string")
    # the outer form keeps the optimizer from evaluating the array a second time in a size filter
    one = nested.select(*rest, special.alias("_special"), F.posexplode_outer("dates").alias("pos", "d"))
    return one.select(
        *rest, "pos", F.col("d.timestamp").alias("timestamp"),
        F.coalesce(F.col("d.location"), F.col("theater"), F.lit("Unknown")).alias("location"),
        F.coalesce(F.col("d.url_tickets"), F.lit("")).alias("url_tickets"),
        F.coalesce(F.col("d.url_info"), F.col("theater_film_link"), F.lit("")).alias("url_info"),
        F.nullif(F.col("d.version"), F.lit("")).alias("version"),
        F.coalesce(blank_to_null("d.special"), blank_to_null("_special")).alias("special"),
    ).where(F.coalesce(F.col("timestamp"), F.lit("")) != "")


def nest_sessions(films: DataFrame, screenings: DataFrame) -> DataFrame:
    """One row per film and session: the film's columns, its location label and first info link, ``position`` and the session.

    The grain never depends on the number of sessions. Positions come from a range sort, label and link from plain
    aggregates: the venues of a film in the order of their first session, and the first link that is not empty.
    Whoever needs nested documents gathers the rows of a film at the edge.
    """
    order = ["showtime", "seq", "location"]
    sessions = screenings.select("film_id", *order, "url_tickets", "url_info", "version", "special")
    ranked = rank_within(sessions, ["film_id"], [F.col(c) for c in order], "position")
    venues = sessions.where(~F.coalesce("location", F.lit("")).isin("", "Unknown")).groupBy("film_id", "location").agg(F.min(F.struct("showtime", "seq")).alias("first"))
    labels = venues.groupBy("film_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("first", "location"))), lambda x: x["location"]), ", ").alias("theater"))
    links = sessions.where("url_info <> ''").groupBy("film_id").agg(F.min_by("url_info", F.struct(*order)).alias("theater_link"))
    named = films.where(F.coalesce(F.col("title"), F.lit("")) != "").join(labels, F.col("id") == labels.film_id, "left").drop("film_id")
    named = named.join(links, F.col("id") == links.film_id, "left").drop("film_id")
    return (named.join(ranked, F.col("id") == ranked.film_id).drop("film_id")
            .withColumn("theater", F.coalesce("theater", F.lit("Unknown"))).withColumn("theater_link", F.coalesce("theater_link", F.lit(""))))


def merge_entries(entries: DataFrame, film_key: Column, session_key: list[str], scalars: list[str], session_columns: list[str],
                  order: str = "seq", non_empty: list[str] = ()) -> Listing:
    """Group entries by ``film_key``; the first entry's scalars win, sessions are distinct first-wins.

    Scalars listed in ``non_empty`` take the first non-empty value instead of the first value.
    """
    keyed = entries.withColumn("film_key", film_key)
    picks = [F.min_by(c, F.when(blank_to_null(F.col(c).cast("string")).isNotNull(), F.col(order)) if c in non_empty else F.col(order)).alias(c)
             for c in scalars]
    films = keyed.groupBy("film_key").agg(*picks, F.min(order).alias("first_seq"))
    wanted = ["film_key", *session_key, order, *[c for c in session_columns if c not in session_key and c != order]]
    sessions = first_by(["film_key", *session_key], [order], keyed.select(*dict.fromkeys(wanted)))
    return Listing(films, sessions)


def identity(*columns: str, lower: tuple[str, ...] = ()) -> Column:
    """Null-safe key over several columns; a null is different from an empty text."""
    parts = [F.lower(F.col(c).cast("string")) if c in lower else F.col(c).cast("string") for c in columns]
    return F.to_json(F.struct(*[F.coalesce(F.concat(F.lit("="), p), F.lit("-")).alias(f"k{i}") for i, p in enumerate(parts)]))


def merge_by_link(entries: DataFrame, scalars: list[str], session_columns: list[str]) -> Listing:
    """Entries with the same film link are one film; entries without a link never merge."""
    key = F.coalesce(blank_to_null("theater_film_link"),
                     F.concat_ws(":", F.lit("row"), F.col("seq").cast("string"), F.col("theater"), F.col("timestamp")))
    return merge_entries(entries, key, ["timestamp", "location"], scalars, session_columns)


def merge_by_identity(entries: DataFrame, keys: list[str], scalars: list[str], session_columns: list[str],
                      session_key: list[str] | None = None, lower: tuple[str, ...] = ()) -> Listing:
    """Entries with equal identity columns are one film; by default whole sessions are compared."""
    return merge_entries(entries, identity(*keys, lower=lower), session_key or session_columns, scalars, session_columns)


def merge_by_url_or_title(entries: DataFrame) -> DataFrame:
    """Add ``film_key``, the first (seq, title, url) among entries linked by equal url or equal title.

    Works on distinct (title, url) pairs: a hot title or url is one row per distinct partner. Chains
    merge transitively; the original order-dependent rule stops at the first hit, which differs only
    when one url carries several titles that also occur with other urls. A round takes the first label of equal titles and urls and then
    the label of that label, so rounds grow with the logarithm of a chain; the loop ends when nothing changes.
    """
    pairs = entries.groupBy("title", "film_url").agg(F.min("seq").alias("seq"))
    labels = cut_lineage(pairs.select("title", "film_url", F.struct("seq", "title", "film_url").alias("label"))
                         .where(F.col("title").isNotNull() | F.col("film_url").isNotNull()))
    while True:
        by_title = labels.where("title is not null").groupBy("title").agg(F.min("label").alias("t"))
        by_url = labels.where("film_url is not null").groupBy("film_url").agg(F.min("label").alias("u"))
        near = cut_lineage(
            labels.join(by_title, "title", "left").join(by_url, "film_url", "left")
            .select("title", "film_url", F.least("label", "t", "u").alias("new"), "label"))
        changed = near.where("new < label").limit(1).count()
        jump = near.select(F.col("title").alias("_t"), F.col("film_url").alias("_u"), F.col("new").alias("_far"))
        labels = cut_lineage(
            near.join(jump, F.col("new.title").eqNullSafe(F.col("_t")) & F.col("new.film_url").eqNullSafe(F.col("_u")))
            .select("title", "film_url", F.least("new", "_far").alias("label")))
        if not changed:
            break
    found = labels.select(F.col("title").alias("_t"), F.col("film_url").alias("_u"), F.col("label").alias("film_key"))
    linked = entries.join(found, entries.title.eqNullSafe(F.col("_t")) & entries.film_url.eqNullSafe(F.col("_u")), "left")
    return linked.drop("_t", "_u").withColumn("film_key", F.coalesce("film_key", F.struct("seq", "title", "film_url")))


def regroup_by_canonical_title(entries: DataFrame, standardized: DataFrame) -> Listing:
    """Group by canonical title from a standardization table keyed by (title, director).

    Titles missing from the table keep themselves; each film gets the first non-empty title, director,
    year and special of its group.
    """
    table = standardized.select(F.col("title").alias("_t"), F.coalesce("director", F.lit("")).alias("_d"),
                                "std_title", "title_en", "std_director", "std_special")
    joined = entries.join(table, (entries.title == F.col("_t")) & (F.coalesce(entries.director, F.lit("")) == F.col("_d")), "left")
    ready = joined.select(
        "seq", F.col("title").alias("title_raw"), F.coalesce("std_title", "title").alias("title"),
        F.coalesce("title_en", "title").alias("title_en"), F.coalesce(blank_to_null("std_director"), blank_to_null("director")).alias("director"),
        "year", blank_to_null("std_special").alias("special"), "timestamp", "location", "url_tickets",
        F.coalesce(blank_to_null("url_info"), F.col("theater_film_link"), F.lit("")).alias("url_info"), "version")
    scalars = ["title_raw", "title", "director", "year", "special"]
    return merge_entries(ready, F.col("title_en"), ["timestamp", "location"], scalars,
                         ["url_tickets", "url_info", "version"], non_empty=scalars)


# --- incremental ingest -----------------------------------------------------------------------------

def drop_known_sessions(scraped: DataFrame, stored: DataFrame, start: str, end: str) -> DataFrame:
    """Sessions not yet stored in the date range.

    With a ticket url the key is (url, minute), because some venues reuse one url for all sessions;
    with only an info url the key is that url among stored rows without ticket; with neither the session
    is kept. One anti join serves both rules.
    """
    since, until = F.lit(start).cast("timestamp_ntz"), F.lit(end).cast("timestamp_ntz") + F.expr("interval 1 day")
    inside = stored.where((F.col("showtime") >= since) & (F.col("showtime") < until))
    has_ticket = F.coalesce(F.col("url_tickets"), F.lit("")) != ""
    has_info = F.coalesce(F.col("url_info"), F.lit("")) != ""

    def keyed(df, minute):
        key = F.when(has_ticket, F.struct(F.lit("t").alias("kind"), F.col("url_tickets").alias("url"), minute.alias("minute"))).when(
            has_info, F.struct(F.lit("i").alias("kind"), F.col("url_info").alias("url"), F.lit("").alias("minute")))
        return df.withColumn("_key", key)

    known = keyed(inside, F.date_format("showtime", "yyyy-MM-dd HH:mm")).where("_key is not null").select("_key.*").distinct()
    fresh = keyed(scraped, F.substring("timestamp", 1, 16))
    match = (fresh._key.kind == known.kind) & (fresh._key.url == known.url) & (fresh._key.minute == known.minute)
    return fresh.join(known, match, "left_anti").drop("_key")


def last_known_values(incoming: DataFrame, key: list[str], order: str) -> DataFrame:
    """One row per key holding the last non-null value of every column."""
    rest = [c for c in incoming.columns if c not in key and c != order]
    return incoming.groupBy(*key).agg(*[F.max_by(c, F.when(F.col(c).isNotNull(), F.col(order))).alias(c) for c in rest])


def upsert_films(stored: DataFrame, incoming: DataFrame, now: str, key: str = "short_url", order: str = "seq",
                 fallback_key: bool = True) -> DataFrame:
    """Null-preserving upsert: a known value is never erased by a missing one.

    Rows without a key are inserted. With ``fallback_key`` a row without a key updates the stored row without
    a key that has the same lower-case title, director and year, so that repeating the upsert changes nothing.
    """
    columns = [c for c in stored.columns if c not in ("updated_at", "id")]
    plain = F.to_json(F.struct(F.lower(F.trim("title")).alias("t"), F.lower(F.trim("director")).alias("d"), F.col("year").alias("y")))
    alternative = F.concat(F.lit("t:"), plain)

    def keyed(df, unique):
        no_key = alternative if fallback_key else F.concat(F.lit("n:"), unique)
        return df.withColumn("_key", F.coalesce(F.concat(F.lit("k:"), F.col(key)), no_key))

    fresh = keyed(incoming, F.concat(F.lit("new"), F.col(order).cast("string")))
    fresh = last_known_values(fresh.select("_key", order, *columns), ["_key"], order)
    old = keyed(stored, F.concat(F.lit("old"), F.col("id").cast("string")))
    if fallback_key:
        # several stored rows may share a fallback key; only the oldest takes the update
        first = old.where(F.col(key).isNull()).groupBy("_key").agg(F.min("id").alias("_first"))
        old = old.join(first, "_key", "left").withColumn(
            "_key", F.when(F.col("_first").isNull() | (F.col("_first") == F.col("id")), F.col("_key"))
            .otherwise(F.concat(F.lit("n:old"), F.col("id").cast("string")))).drop("_first")
    o, n = old.alias("o"), fresh.withColumn("_new", F.lit(True)).alias("n")
    merged = o.join(n, F.col("o._key") == F.col("n._key"), "full")
    touched = F.when(F.col("n._new"), F.lit(now).cast("timestamp_ntz"))
    return merged.select(
        F.col("o.id").alias("id"), *[F.coalesce(F.col(f"n.{c}"), F.col(f"o.{c}")).alias(c) for c in columns],
        F.coalesce(touched, F.col("o.updated_at") if "updated_at" in stored.columns else F.lit(None).cast("timestamp_ntz")).alias("updated_at"))


def upsert_screenings(stored: DataFrame, incoming: DataFrame) -> DataFrame:
    """First row wins inside the batch; a batch row then replaces every column of the stored row.

    Both rules are one aggregate: rows of the batch come before the stored one, which is the only one of its key.
    """
    keys = ["film_id", "showtime", "location"]
    columns = [c for c in stored.columns if c not in keys]
    rest = [c for c in columns if c != "seq"]
    both = incoming.select(*keys, *columns).withColumn("_gen", F.lit(0)).unionByName(stored.select(*keys, *columns).withColumn("_gen", F.lit(1)))
    return both.groupBy(*keys).agg(F.min(F.struct("_gen", "seq", *rest)).alias("_row")).select(*keys, *[f"_row.{c}" for c in columns])


def assign_film_ids(new_keys: DataFrame, stored: DataFrame, key: str = "short_url") -> DataFrame:
    """Ids above the largest stored id for keys that are new, in key order."""
    fresh = new_keys.select(key).where(F.col(key).isNotNull()).distinct().join(stored.select(key), key, "left_anti")
    top = stored.agg(F.coalesce(F.max("id"), F.lit(0)).alias("_top"))
    ranked = global_rank(fresh, [F.col(key)], "_n")
    return ranked.crossJoin(F.broadcast(top)).select(key, (F.col("_n") + F.col("_top")).alias("id"))


def resolve_film_ids(feedback: DataFrame, films: DataFrame) -> DataFrame:
    """Fill missing film ids by short url; known ids stay."""
    ids = films.where("short_url is not null").select("short_url", F.col("id").alias("_id"))
    return feedback.join(ids, "short_url", "left").withColumn("film_id", F.coalesce("film_id", "_id")).drop("_id")


# --- archive ----------------------------------------------------------------------------------------

class Archive(NamedTuple):
    live: DataFrame
    history: DataFrame
    counters: DataFrame


def _tuple_key() -> Column:
    return F.to_json(F.struct(F.lower(F.trim("title")).alias("t"), F.coalesce(F.lower(F.trim("director")), F.lit("")).alias("d"),
                              F.coalesce(F.col("year").cast("string"), F.lit("")).alias("y")))


def archive_partition(live: DataFrame, history: DataFrame, start: str, end: str) -> Archive:
    """Move sessions of a day range from the live listing to the history.

    Inputs are flat sessions with ``title, director, year, short_url, timestamp, location, seq``. A film is
    known to the history by its short url, else by (title, director, year) among history films without url.
    Sessions with unreadable times stay live. History sessions are distinct per film, time and venue, and
    the history copy wins.
    """
    url, tup = F.concat(F.lit("u:"), F.col("short_url")), F.concat(F.lit("t:"), _tuple_key())
    own = F.coalesce(F.when(F.col("short_url") != "", url), tup)
    day = F.to_date(parse_showtime(F.col("timestamp")))
    flagged = live.withColumn("_own", own).withColumn("_tuple", tup).withColumn(
        "_old", F.coalesce(day.between(F.lit(start).cast("date"), F.lit(end).cast("date")), F.lit(False)))
    past = history.withColumn("film_key", own)
    known = past.select("film_key").distinct()
    moving = flagged.where("_old")
    targets = (
        moving.select("_own", "_tuple").distinct()
        .join(known.select(F.col("film_key").alias("_own"), F.lit(True).alias("_direct")), "_own", "left")
        .join(known.select(F.col("film_key").alias("_tuple"), F.lit(True).alias("_indirect")), "_tuple", "left")
        .select("_own", "_tuple", F.when(F.col("_direct").isNull() & F.col("_indirect"), F.col("_tuple")).otherwise(F.col("_own")).alias("film_key"))
    )
    moved = moving.join(targets, ["_own", "_tuple"]).drop("_own", "_tuple", "_old")
    both = past.withColumn("_gen", F.lit(0)).unionByName(moved.withColumn("_gen", F.lit(1)), allowMissingColumns=True)
    new_history = first_by(["film_key", "timestamp", "location"], ["_gen", "seq"], both).drop("_gen")
    rest = flagged.where("not _old")
    per_film = flagged.groupBy("_own").agg(F.count_if("_old").alias("moved"), F.count_if(~F.col("_old")).alias("kept"))
    counters = per_film.agg(
        F.sum("moved").alias("sessions_archived"),
        F.coalesce(F.sum(F.when(F.col("moved") > 0, F.col("kept"))), F.lit(0)).alias("sessions_kept"),
        F.count_if((F.col("moved") > 0) & (F.col("kept") == 0)).alias("films_fully_moved"),
        F.count_if((F.col("moved") > 0) & (F.col("kept") > 0)).alias("films_partially_moved"),
        F.count_if(F.col("moved") == 0).alias("films_untouched"),
        F.count_if(F.col("kept") > 0).alias("live_films_after"))
    total = new_history.agg(F.countDistinct("film_key").alias("history_films_after"))
    return Archive(rest.drop("_own", "_tuple", "_old"), new_history, counters.crossJoin(F.broadcast(total)))
