"""Sources: scraped CSV, nested catalogue JSON, store tables, user exports, API documents, pages."""

from __future__ import annotations

from functools import reduce

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from showgrid import lookups, schemas
from showgrid.functions.dates import epoch_millis_date, ticket_link
from showgrid.functions.text import collapse_whitespace, titlecase_if_upper
from showgrid.util import blank_to_null, lookup

EMPTY_SESSIONS = "cast(array() as array<struct<timestamp:string,location:string,url_tickets:string,url_info:string,version:string,special:string>>)"
TIMESTAMP_TEXT = r"(\d{4}-\d{2}-\d{2} \d{2}:\d{2})"


def parse_dates_cell(c: Column) -> Column:
    """Serialized sessions to an array of session structs.

    Accepts JSON objects, Python literals, plain time lists, and as a last resort any embedded times.
    """
    text = F.trim(c)
    plain = F.regexp_replace(text, r"(: |, |\[)None(?=[,}\]])", "$1null")
    plain = F.regexp_replace(F.regexp_replace(plain, r"(: |, |\[)True(?=[,}\]])", "$1true"), r"(: |, |\[)False(?=[,}\]])", "$1false")

    def bare(ts):
        return F.struct(ts.alias("timestamp"), F.lit(None).cast("string").alias("location"), F.lit("").alias("url_tickets"),
                        F.lit(None).cast("string").alias("url_info"), F.lit(None).cast("string").alias("version"),
                        F.lit(None).cast("string").alias("special"))

    objects = F.transform(F.from_json(plain, f"array<{schemas.SESSION}>"), lambda x: F.struct(
        x["timestamp"].alias("timestamp"), x["location"].alias("location"),
        F.coalesce(x["url_tickets"], x["url"], F.lit("")).alias("url_tickets"), x["url_info"].alias("url_info"),
        F.nullif(x["version"], F.lit("")).alias("version"), F.nullif(x["special"], F.lit("")).alias("special")))
    strings = F.transform(F.from_json(plain, "array<string>"), bare)
    salvage = F.transform(F.regexp_extract_all(text, F.lit(TIMESTAMP_TEXT), F.lit(1)), bare)
    return (F.when(F.coalesce(text, F.lit("")) == "", F.expr(EMPTY_SESSIONS))
            .when(F.rlike(text, F.lit(r"^\[\s*\{")), F.coalesce(objects, salvage))
            .when(F.rlike(text, F.lit(r"^\[\s*[\"']")), F.coalesce(strings, salvage))
            .otherwise(salvage))


def read_scraped_csv(spark: SparkSession, path: str) -> DataFrame:
    """Scraped or matched CSV; ``seq`` is the order of files and rows, ``dates`` is parsed."""
    raw = spark.read.schema(schemas.SCRAPED_CSV).option("header", True).option("multiLine", True).option(
        "quote", '"').option("escape", '"').csv(path)
    # the rows of a file are numbered in a row; files are put in order of their paths, whatever the packing of the scan
    rows = raw.withColumn("_file", F.col("_metadata.file_path")).withColumn("_row", F.monotonically_increasing_id())
    files = rows.groupBy("_file").agg(F.min("_row").alias("_first"), F.count(F.lit(1)).alias("_n"))
    before = F.coalesce(F.sum("_n").over(W.orderBy("_file").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    files = F.broadcast(files.select("_file", "_first", before.alias("_before")))  # one row per file; its size is judged by that of the files otherwise, and all rows shuffled
    placed = rows.join(files, "_file").withColumn("seq", F.col("_before") + F.col("_row") - F.col("_first")).drop("_file", "_row", "_first", "_before")
    return (
        placed.withColumn("dates", parse_dates_cell(F.col("dates")))
        .withColumn("year", F.col("year").try_cast("double").cast("int"))
    )


def read_catalog_json(spark: SparkSession, path: str, multi_line: bool = False) -> DataFrame:
    """Nested catalogue; a missing path is an empty catalogue. Large archives should be JSON lines."""
    try:
        return spark.read.schema(schemas.CATALOG_JSON).option("multiLine", multi_line).json(path)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], schemas.CATALOG_JSON)


def store_predicate(column: str, op: str, value) -> Column:
    c = F.col(column)
    ops = {
        "eq": lambda: c == value, "neq": lambda: c != value, "gte": lambda: c >= value, "lte": lambda: c <= value,
        "gt": lambda: c > value, "lt": lambda: c < value, "in": lambda: c.isin(list(value)),
        "is_null": lambda: c.isNull() if value else c.isNotNull(), "ilike": lambda: c.ilike(value),
    }
    if op not in ops:
        raise ValueError(f"unknown predicate {op}")
    return ops[op]()


def read_store(table: DataFrame, filters: list[tuple] = (), columns: list[str] | None = None) -> DataFrame:
    """Column and predicate selection on a stored table; both reach the scan, paging is not needed."""
    if filters:
        table = table.where(reduce(lambda a, b: a & b, [store_predicate(*f) for f in filters]))
    return table.select(*columns) if columns else table


def read_user_export(spark: SparkSession, folder: str) -> dict[str, DataFrame]:
    """The five CSVs of one or many unpacked exports below ``folder/<user_id>/``.

    ``user_id`` is the folder name. ``likes/films.csv`` is matched by its whole path, so that a
    top-level ``films.csv`` is not taken for it.
    """
    files = {"watched": "watched.csv", "ratings": "ratings.csv", "watchlist": "watchlist.csv", "likes": "likes/films.csv", "diary": "diary.csv"}
    out = {}
    for name, file in files.items():
        schema = schemas.USER_EXPORT[name]
        try:
            raw = spark.read.schema(schema).option("header", True).option("escape", '"').option("enforceSchema", True).csv(f"{folder}/*/{file}")
        except AnalysisException as e:
            if e.getCondition() != "PATH_NOT_FOUND":
                raise
            raw = spark.createDataFrame([], schema)
        user = F.regexp_extract(F.col("_metadata.file_path"), r"/([^/]+)/" + file.replace(".", r"\.") + "(/|$)", 1)
        known = raw.withColumn("user_id", user) if raw.inputFiles() else raw.withColumn("user_id", F.lit(None).cast("string"))
        out[name] = known.withColumn("uri", blank_to_null("uri")).where("uri is not null")
    if not out["watched"].inputFiles():
        raise FileNotFoundError(f"no watched.csv below {folder}")
    return out


def feedback_from_export(export: dict[str, DataFrame]) -> DataFrame:
    """One feedback row per user and film: date, valid rating, like and rewatches; later rows win."""
    from showgrid.operators.feedback import rewatch_counts

    key = ["user_id", "uri"]
    watched = export["watched"].groupBy(*key).agg(F.max(blank_to_null("Date")).try_cast("date").alias("watched_date"))
    rating = F.col("Rating").try_cast("double")
    ratings = export["ratings"].where(rating > 0).groupBy(*key).agg(F.max_by(rating, "Date").alias("rating"))
    likes = export["likes"].select(*key).distinct().withColumn("liked", F.lit(True))
    return (
        watched.join(ratings, key, "left").join(likes, key, "left").join(rewatch_counts(export["diary"]), key, "left")
        .select("user_id", F.col("uri").alias("short_url"), "rating", F.coalesce("liked", F.lit(False)).alias("liked"),
                "watched_date", F.coalesce("rewatch_count", F.lit(0)).alias("rewatch_count"))
    )


def showtime_api_sessions(documents: DataFrame, cinemas: dict[int, str] | None = None, column: str = "document",
                          link_base: str = "https://tickets.example/", info_base: str = "https://listing.example/") -> DataFrame:
    """Cinema > date > movie > format > showtime documents to session rows.

    Unknown cinemas and showtimes that name another cinema are dropped.
    """
    cinemas = lookups.API_CINEMAS if cinemas is None else cinemas
    known = lookup(documents.sparkSession, list(cinemas.items()), "cinema_id int, location string")
    rows = (
        documents.select(F.from_json(column, schemas.SHOWTIME_API).alias("j")).select(F.explode("j.d.Cinemas").alias("c"))
        .join(known, F.col("c.Id") == F.col("cinema_id"))
        .select("cinema_id", "location", F.explode("c.Dates").alias("dt"))
        .select("cinema_id", "location", epoch_millis_date(F.col("dt.FilterDate")).alias("day"), F.explode("dt.Movies").alias("m"))
        .select("cinema_id", "location", "day", "m", F.explode("m.Formats").alias("f"))
        .select("cinema_id", "location", "day", "m", "f.Language", F.explode("f.Showtimes").alias("st"))
        .where((F.col("st.CinemaId") == F.col("cinema_id")) & F.col("day").isNotNull())
    )
    # a column of its own: the title case names it more than once, and each time would clean the text again
    rows = rows.withColumn("director", blank_to_null(collapse_whitespace(F.col("m.Director"))))
    director = titlecase_if_upper(F.col("director"))
    return rows.select(
        F.col("m.Key").alias("film_key"), F.trim("m.Title").alias("title"), director.alias("director"), "location",
        F.concat_ws(" ", F.col("day").cast("string"), F.col("st.Time")).alias("timestamp"),
        ticket_link(link_base, F.col("st.VistaCinemaId"), F.col("st.ShowtimeId")).alias("url_tickets"),
        F.concat(F.lit(info_base), F.col("m.Key")).alias("url_info"), F.col("Language").alias("language"))


def read_pages(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(schemas.PAGES).parquet(path)


def table_pattern(folder: str, name: str) -> str:
    """Path of one table as a pattern, which a stream accepts for a single file and for a folder of part files alike."""
    return f"{folder}/{{{name}}}"


def stream_pages(spark: SparkSession, path: str, files_per_trigger: int = 100, name: str | None = None) -> DataFrame:
    """Pages as they arrive in a folder; with ``name`` only in the file or folder of that name in it."""
    return spark.readStream.schema(schemas.PAGES).option("maxFilesPerTrigger", files_per_trigger).parquet(table_pattern(path, name) if name else path)


def sources_by_period(sources: DataFrame, period: str) -> DataFrame:
    if period not in ("weekly", "monthly"):
        raise ValueError(f"unknown period {period}")
    return sources.where(F.col("update_period") == period).select("source_key")
