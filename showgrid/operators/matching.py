"""Identity matching and enrichment joins."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from showgrid import lookups
from showgrid.functions.text import search_key, slugify
from showgrid.operators.fuzzy import fuzzy_titles
from showgrid.util import blank_to_null, first_by


def link_cache(films: DataFrame, screenings: DataFrame) -> DataFrame:
    """Info url to film url; the earliest session decides."""
    urls = films.where("film_url is not null").select(F.col("id").alias("film_id"), "film_url")
    used = screenings.where(F.coalesce(F.col("url_info"), F.lit("")) != "").groupBy("url_info", "film_id").agg(F.min("seq").alias("seq"))
    return used.join(urls, "film_id").groupBy("url_info").agg(F.min(F.struct("seq", "film_url")).alias("b")).select("url_info", "b.film_url")


def title_cache(films: DataFrame) -> DataFrame:
    """Title to film url; the last film wins."""
    known = films.where("film_url is not null and title is not null and title <> ''")
    return known.groupBy("title").agg(F.max_by("film_url", "id").alias("film_url"))


def match_cascade(entries: DataFrame, films: DataFrame, screenings: DataFrame, skip_existing: bool = True,
                  skip_special: bool = True) -> DataFrame:
    """Add ``matched_url`` and ``strategy``: info links in order, then English title, then title.

    ``entries`` has a unique ``entry_id``, ``links`` (array, in order), ``title_en``, ``title``, ``film_url`` and
    ``special``. All candidate keys go through one equi-join with the caches; the smallest priority wins.
    """
    todo = entries
    if skip_existing:
        todo = todo.where(blank_to_null("film_url").isNull())
    if skip_special:
        todo = todo.where(blank_to_null("special").isNull())
    links = F.transform(F.filter("links", lambda x: x != ""), lambda x, i: F.struct(
        i.cast("int").alias("priority"), F.lit("link").alias("strategy"), x.alias("key")))
    def one(c, priority, strategy):
        return F.array(F.struct(F.lit(priority).alias("priority"), F.lit(strategy).alias("strategy"), F.col(c).alias("key")))
    candidates = todo.select("entry_id", F.explode(F.concat(
        links, one("title_en", 1_000_000, "title_en"), one("title", 1_000_001, "title"))).alias("c")).select("entry_id", "c.*").where("key is not null")
    cache = link_cache(films, screenings).select(F.lit("link").alias("kind"), F.col("url_info").alias("key"), "film_url").unionByName(
        title_cache(films).select(F.lit("title").alias("kind"), F.col("title").alias("key"), "film_url"))
    kind = F.when(F.col("strategy") == "link", F.lit("link")).otherwise(F.lit("title"))
    hits = candidates.withColumn("kind", kind).join(cache, ["kind", "key"]).groupBy("entry_id").agg(
        F.min(F.struct("priority", "strategy", "film_url")).alias("b"))
    best = hits.select("entry_id", F.col("b.film_url").alias("matched_url"), F.col("b.strategy").alias("strategy"))
    return entries.join(best, "entry_id", "left")


def search_cascade(entries: DataFrame, catalogue: DataFrame, fuzzy: bool = False) -> DataFrame:
    """Local search: title with year, title with each director, title alone; the first strategy with a hit wins.

    Within a strategy the most viewed film wins, then the smallest id. A missing year is filled from the hit. With ``fuzzy`` entries
    without a hit get the nearest title within the edits that ``fuzzy_titles`` allows.
    """
    def director_keys(c: Column) -> Column:
        return F.split(c, r"\s*,\s*")

    base = catalogue.where("film_url is not null").select(
        "id", "film_url", F.col("year").alias("hit_year"), F.coalesce("viewers", F.lit(-1)).alias("viewers"),
        search_key(F.lower("title")).alias("t"), "director")
    none = F.lit(None).cast("string")

    def indexed(df, kind, detail):
        return df.select(F.lit(kind).alias("kind"), "t", detail.alias("detail"), "film_url", "hit_year", "viewers", "id")

    by_director = base.where("director is not null").withColumn("_d", F.explode(director_keys(F.col("director"))))
    index = indexed(base.where("hit_year is not null"), "year", F.col("hit_year").cast("string")).unionByName(
        indexed(by_director, "director", slugify(F.col("_d"), "spaces"))).unionByName(indexed(base, "title", F.lit("")))
    index = index.groupBy("kind", "t", "detail").agg(
        F.max(F.struct("viewers", (-F.col("id")).alias("n"), "film_url", "hit_year")).alias("b")).select("kind", "t", "detail", "b.film_url", "b.hit_year")

    year = F.col("year").try_cast("double").cast("int")
    wanted = entries.select("*", search_key(F.lower("title")).alias("_t"), year.cast("string").alias("_y"), blank_to_null("director").alias("_d"))
    # what is found depends on title, year and directors only: each such question is asked once, and its answer is joined to all its entries
    asked = wanted.where("_t is not null").select(F.col("_t").alias("t"), F.col("_y").alias("y"), F.col("_d").alias("d")).distinct()
    def part(df, priority, kind, detail):
        return df.select("t", "y", "d", priority.alias("priority"), F.lit(kind).alias("kind"), detail.alias("detail"))
    directors = asked.where("d is not null").select("*", F.posexplode(director_keys(F.col("d"))).alias("p", "one"))
    candidates = part(asked.where("y is not null"), F.lit(0), "year", F.col("y")).unionByName(
        part(directors, F.col("p") + 1, "director", slugify(F.col("one"), "spaces"))).unionByName(part(asked, F.lit(1_000_000), "title", F.lit("")))
    hits = candidates.join(index, ["kind", "t", "detail"]).groupBy("t", "y", "d").agg(
        F.min(F.struct("priority", "kind", "film_url", "hit_year")).alias("b"))
    best = hits.select("t", "y", "d", F.col("b.film_url").alias("matched_url"), F.concat(F.lit("title + "), F.col("b.kind")).alias("strategy"), F.col("b.hit_year").alias("hit_year"))
    best = best.withColumn("strategy", F.when(F.col("strategy") == "title + title", F.lit("title only")).otherwise(F.col("strategy")))
    if fuzzy:  # a title that is found by itself is found with every year and director, so open titles have no answer at all
        open_titles = asked.select("t").distinct().join(best.select("t"), "t", "left_anti")
        nearest = fuzzy_titles(open_titles, base).select("t", F.col("film_url").alias("_url"), F.col("hit_year").alias("_year"))
        near = asked.join(nearest, "t").select("t", "y", "d", F.col("_url").alias("matched_url"), F.lit("fuzzy title").alias("strategy"), F.col("_year").alias("hit_year"))
        best = best.unionByName(near)
    same = (F.col("_t") == F.col("t")) & F.col("_y").eqNullSafe(F.col("y")) & F.col("_d").eqNullSafe(F.col("d"))
    rest = [c for c in entries.columns if c not in ("entry_id", "year")]
    return wanted.join(best, same, "left").select("entry_id", *rest, F.coalesce(year, "hit_year").alias("year"), "matched_url", "strategy").select(
        "entry_id", *[c for c in entries.columns if c != "entry_id"], "matched_url", "strategy")


def match_report(matched: DataFrame) -> DataFrame:
    """Entries per strategy; entries without a match are ``unmatched``, and one row holds the total."""
    per = matched.groupBy(F.when(F.col("matched_url").isNull(), F.lit("unmatched")).otherwise(F.col("strategy")).alias("strategy")).agg(
        F.count(F.lit(1)).alias("n"))
    return per.unionByName(per.agg(F.lit("total").alias("strategy"), F.sum("n").alias("n")))


def _is_missing(column: str, kind: str) -> Column:
    c = F.col(column)
    if kind.startswith("array"):
        return c.isNull() | (F.size(c) == 0)
    if kind == "string":
        return c.isNull() | (c == "")
    return c.isNull()


def prefer(left: str, right: str, kind: str, falsy_zero: bool = False) -> Column:
    """Left value unless it is missing (null, empty text, empty list, optionally zero), else the right one."""
    missing = _is_missing(left, kind)
    if falsy_zero and kind in ("int", "bigint", "double", "float"):
        missing = missing | (F.col(left) == 0)
    return F.when(~missing, F.col(left)).otherwise(F.col(right))


def fill_from(base: DataFrame, other: DataFrame, key: str, fields: list[str], other_wins: bool) -> DataFrame:
    """Left join on ``key`` combining ``fields``: missing values are filled, or replaced when ``other_wins``."""
    right = other.where(F.col(key).isNotNull()).select(F.col(key), *[F.col(f).alias(f"_o_{f}") for f in fields])
    # rows without key have no partner: kept out of the join, they do not meet in one task
    none = base.where(F.col(key).isNull())
    for f in right.columns:
        if f != key:
            none = none.withColumn(f, F.lit(None).cast(right.schema[f].dataType))
    joined = base.where(F.col(key).isNotNull()).join(right, key, "left").unionByName(none)
    kinds = {f.name: f.dataType.simpleString() for f in base.schema}
    out = []
    for c in base.columns:
        if c in fields:
            pair = (f"_o_{c}", c) if other_wins else (c, f"_o_{c}")
            out.append(prefer(*pair, kinds[c], falsy_zero=True).alias(c))
        else:
            out.append(F.col(c))
    return joined.select(*out)


def prefill_metadata(incoming: DataFrame, stored: DataFrame, fields: list[str], key: str = "film_url") -> DataFrame:
    """Copy stored metadata into incoming rows where the incoming value is missing."""
    unique = first_by([key], ["id"], stored.where(F.col(key).isNotNull()).select(key, "id", *fields), last=True)
    return fill_from(incoming, unique, key, fields, other_wins=False)


def authoritative_merge(file_rows: DataFrame, fresh: DataFrame, key: str, fields: list[str]) -> DataFrame:
    """Fresh metadata wins where present, else the file value; the display director is the first credited name."""
    merged = fill_from(file_rows, fresh, key, fields, other_wins=True)
    lead = F.try_element_at(F.col("directors"), F.lit(1))["name"]
    return merged.withColumn("director", F.coalesce(blank_to_null(lead), F.col("director")))


def detail_override(listing: DataFrame, detail: DataFrame, key: str = "url_info") -> DataFrame:
    """Ticket url, director and year of the detail page replace listing values when not empty."""
    d = detail.select(key, *[blank_to_null(c).alias(f"_{c}") for c in ("url_tickets", "director", "year")])
    joined = listing.join(d, key, "left")
    for c in ("url_tickets", "director", "year"):
        joined = joined.withColumn(c, F.coalesce(F.col(f"_{c}"), F.col(c).cast("string"))).drop(f"_{c}")
    return joined


def session_url_lookup(sessions: DataFrame, urls: DataFrame) -> DataFrame:
    """A session-specific ticket url found under (film, ``DD/MM HH:MM``) replaces the generic one."""
    keyed = sessions.withColumn("slot", F.date_format("showtime", "dd/MM HH:mm"))
    found = urls.select("film_id", "slot", F.col("url").alias("_url"))
    return keyed.join(found, ["film_id", "slot"], "left").withColumn("url_tickets", F.coalesce(blank_to_null("_url"), "url_tickets")).drop("_url", "slot")


def category_gate(cards: DataFrame, wanted: str) -> DataFrame:
    """Cards of the wanted category or without one, minus sold-out notes."""
    category = F.lower(F.trim("category"))
    return cards.where((category.isNull() | (category == wanted)) & ~F.lower("note").contains("agotada"))


# --- versions and labels ------------------------------------------------------------------------------

def version_counterpart(sessions: DataFrame, policy: str = "any") -> DataFrame:
    """Tag sessions by comparing with the other sessions of the same film.

    ``is_original`` and ``is_dubbed`` describe what the page says. ``any``: a session that is not original is
    dubbed when the film also runs in original version. ``marked``: only sessions marked as dubbed are. ``tagged``:
    as ``marked``, and original sessions are tagged VOSE. The film flags are a partial aggregate joined back.
    """
    flags = sessions.groupBy("film_id").agg(F.max("is_original").alias("_has_original"))
    rows = sessions.join(flags, "film_id")
    dubbed = {"any": ~F.col("is_original"), "marked": F.col("is_dubbed"), "tagged": F.col("is_dubbed")}[policy] & F.col("_has_original")
    version = F.when(dubbed, F.lit("dubbed"))
    if policy == "tagged":
        version = F.when(F.col("is_original"), F.lit("VOSE")).when(dubbed, F.lit("dubbed"))
    return rows.withColumn("version", version).drop("_has_original")


def label_map_join(df: DataFrame, labels: DataFrame, on: str, value: str, drop_unmapped: bool) -> DataFrame:
    """Raw labels to canonical values; one label may map to several values. ``labels`` is a fixed lookup."""
    return df.join(F.broadcast(labels), on, "inner" if drop_unmapped else "left").withColumn(on, F.col(value)).drop(value)


def attribute_names(films: DataFrame) -> DataFrame:
    """(category, attr_id) to name over all credit columns; the last film wins."""
    columns = {"director": "directors", "cinematographer": "cinematographers", "composer": "composers", "writer": "writers",
               "cast": "top_cast", "keyword": "keywords", "company": "production_companies"}
    every = None
    for category, column in columns.items():
        part = films.select("id", F.posexplode(column).alias("p", "a")).select(
            F.lit(category).alias("category"), F.col("a.id").alias("attr_id"), F.col("a.name").alias("name"), "id", "p")
        every = part if every is None else every.unionByName(part)
    named = every.where("attr_id <> 0")
    return named.groupBy("category", "attr_id").agg(F.max_by("name", F.struct("id", "p")).alias("name"))


def dim_name_lookup(similar: DataFrame, films: DataFrame) -> DataFrame:
    """Resolve similar-film rows (``similar_id, category, attr``) to titles, urls and attribute names.

    Rows whose film title or attribute name is unknown are dropped.
    """
    names = attribute_names(films).select("category", F.col("attr_id").cast("string").alias("attr"), "name")
    titles = films.where("title <> ''").select(F.col("id").alias("similar_id"), "title", "title_en", "film_url")
    person = F.col("category").isin(lookups.PERSON_CATEGORIES)
    return (
        similar.join(names.where("name <> ''"), ["category", "attr"]).join(titles, "similar_id")
        .withColumn("value_url", F.when(person, F.concat(F.lit("https://www.themoviedb.org/person/"), F.col("attr"))))
    )


def title_words(c: Column) -> Column:
    """Upper-case the first letter of every blank-separated word, leaving the rest."""
    words = F.split(c, " ")
    return F.array_join(F.transform(words, lambda w: F.concat(F.upper(F.substring(w, 1, 1)), F.substring(w, F.lit(2), F.length(w)))), " ")


def translate_labels(df: DataFrame, labels: DataFrame, language: str, column: str = "value", category: str = "category") -> DataFrame:
    """Label in the user's language by category and lower-case text; proper names stay, unknown labels are title-cased.

    ``labels`` has category, language, label and translation, so a word may read differently as genre, keyword or country.
    """
    table = labels.where(F.col("language") == language).select(F.col("category").alias("_c"), F.col("label").alias("_l"), F.col("translation").alias("_t"))
    joined = df.join(table, (F.lower(F.trim(column)) == F.col("_l")) & (F.col(category) == F.col("_c")), "left").drop("_c")
    return joined.withColumn("translated", F.when(F.col(category).isin(lookups.PROPER_NAME_CATEGORIES), F.col(column))
                             .otherwise(title_words(F.coalesce("_t", column)))).drop("_l", "_t")
