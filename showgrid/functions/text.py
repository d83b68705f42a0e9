"""Text functions as column expressions; the vectorised functions are :func:`strip_accents` and :func:`ascii_fold`."""

from __future__ import annotations

import re
import unicodedata

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from showgrid import lookups
from showgrid.util import blank_to_null


#: Values that are decomposed at a time, so that a worker holds a batch as Arrow buffers and only so many as strings.
SLICE = 64
MARKS = re.compile("[\u0300-\u036f]+")


def without_marks(v: str | None) -> str | None:
    return v if v is None or v.isascii() else MARKS.sub("", unicodedata.normalize("NFD", v))


@F.arrow_udf(StringType())
def strip_accents(values: pa.Array) -> pa.Array:
    """Canonical decomposition without combining marks; Spark has no built-in for it."""
    parts = [pa.array([without_marks(v) for v in values.slice(i, SLICE).to_pylist()], pa.string()) for i in range(0, len(values), SLICE)]
    return pa.concat_arrays(parts) if parts else pa.array([], pa.string())


@F.pandas_udf(StringType())
def ascii_fold(values: pd.Series) -> pd.Series:
    """Compatibility decomposition reduced to ASCII."""
    return values.map(lambda v: None if v is None else unicodedata.normalize("NFKD", v).encode("ascii", "ignore").decode())


def normalize_text(c: Column) -> Column:
    """Lower case without accents."""
    return F.lower(strip_accents(c))


def fold_contains(c: Column, text: str) -> Column:
    """Accent- and case-insensitive containment inside the JVM, through a collation."""
    return F.contains(F.collate(c, "UNICODE_CI_AI"), F.collate(F.lit(text), "UNICODE_CI_AI"))


def slugify(c: Column, style: str = "runs") -> Column:
    """``runs``: each run of other characters becomes one dash. ``spaces``: only spaces become dashes."""
    low = F.lower(ascii_fold(c))
    if style == "spaces":
        return F.replace(low, F.lit(" "), F.lit("-"))
    return F.btrim(F.regexp_replace(low, "[^a-z0-9]+", "-"), F.lit("-"))


def clean_title(c: Column, prefixes: list[str] | None = None, suffixes: list[str] | None = None) -> Column:
    """Drop version suffixes, then the first known programme prefix, else the variable prefix."""
    prefixes = lookups.TITLE_PREFIXES if prefixes is None else prefixes
    for pattern in lookups.VERSION_SUFFIX_PATTERNS if suffixes is None else suffixes:
        c = F.regexp_replace(c, pattern, "")
    cut = [F.when(F.startswith(c, F.lit(p)), F.substring(c, F.lit(len(p) + 1), F.length(c))) for p in prefixes]
    return F.trim(F.coalesce(*cut, F.regexp_replace(c, lookups.TITLE_PREFIX_PATTERN, "")))


def split_title_year(c: Column) -> Column:
    """``Title (Original, 1966)`` to a (title, year) struct."""
    year = F.nullif(F.regexp_extract(c, r"\(.*?(\d{4})\)", 1), F.lit(""))
    title = F.trim(F.regexp_replace(c, r"\s*\([^)]*\)\s*$", ""))
    return F.struct(title.alias("title"), year.alias("year"))


def strip_program_label(c: Column) -> Column:
    return F.when(F.contains(c, F.lit(" [")), F.trim(F.substring_index(c, " [", 1))).otherwise(c)


def titlecase_if_upper(c: Column) -> Column:
    """Title case for all-capital text, also after apostrophes, hyphens and digits."""
    parts = F.regexp_extract_all(F.lower(c), F.lit(r"(\p{L}+|[^\p{L}]+)"), F.lit(1))
    titled = F.array_join(F.transform(parts, lambda p: F.concat(F.upper(F.substring(p, 1, 1)), F.substring(p, F.lit(2), F.length(p)))), "")
    return F.when((c == F.upper(c)) & F.rlike(c, F.lit(r"\p{L}")), titled).otherwise(c)


def strip_director_prefix(c: Column) -> Column:
    return blank_to_null(F.regexp_replace(F.trim(c), "(?i)^de ", ""))


SLASH_CREDIT = r"^(.+?)\s*/\s*.+?\s*/\s*(\d{4})\s*$"


def parse_credit_lines(lines: Column) -> Column:
    """(director, year) of the first ``Name / Country / YYYY`` line of an array of lines."""
    hit = F.try_element_at(F.filter(lines, lambda p: F.rlike(p, F.lit(SLASH_CREDIT))), F.lit(1))
    return F.struct(F.trim(F.regexp_extract(hit, SLASH_CREDIT, 1)).alias("director"),
                    F.regexp_extract(hit, SLASH_CREDIT, 2).alias("year"))


def parse_pipe_credit(c: Column) -> Column:
    """(director, year) of ``Name | Year | Duration``; a year that is not all digits is dropped."""
    parts = F.split(c, r"\|")
    year = F.trim(F.try_element_at(parts, F.lit(2)))
    return F.struct(blank_to_null(F.try_element_at(parts, F.lit(1))).alias("director"),
                    F.when(F.rlike(year, F.lit(r"^\d+$")), year).alias("year"))


def collapse_whitespace(c: Column) -> Column:
    return F.trim(F.regexp_replace(c, r"\s+", " "))


def search_key(c: Column) -> Column:
    """Dots become spaces, slashes vanish, runs of blanks shrink."""
    return collapse_whitespace(F.replace(F.replace(c, F.lit("."), F.lit(" ")), F.lit("/"), F.lit("")))


def compact_count_label(c: Column) -> Column:
    """1.2M, 34k or the plain number."""
    millions = F.regexp_replace(F.format_string("%.1f", F.round(c / 1000000, 1)), r"\.0$", "")
    thousands = F.floor(c / 1000 + 0.5).cast("string")
    return (F.when(c >= 1000000, F.concat(millions, F.lit("M")))
            .when(c >= 1000, F.concat(thousands, F.lit("k"))).otherwise(c.cast("string")))


def fallback_title_from_slug(url: Column) -> Column:
    tail = F.element_at(F.split(F.regexp_replace(url, "/+$", ""), "/"), -1)
    words = F.split(F.replace(tail, F.lit("-"), F.lit(" ")), " ")
    return F.array_join(F.transform(words, lambda w: F.concat(F.upper(F.substring(w, 1, 1)), F.substring(w, F.lit(2), F.length(w)))), " ")


def localized_title(language: str) -> Column:
    """Title in the display language with the other titles as fallback."""
    if language == "en":
        return F.coalesce(blank_to_null("title_en"), F.col("title"))
    return F.coalesce(blank_to_null("title_es"), blank_to_null("title_en"), blank_to_null("title_original"),
                      fallback_title_from_slug(F.col("film_url")))


def alias_values(c: Column, aliases: dict[str, str] | None = None) -> Column:
    aliases = lookups.COUNTRY_ALIASES if aliases is None else aliases
    table = F.create_map(*[F.lit(x) for pair in aliases.items() for x in pair])
    return F.transform(c, lambda v: F.coalesce(F.try_element_at(table, v), v))


def stable_bucket(id_: Column, title: Column, buckets: int = 16) -> Column:
    """31-based rolling hash of id and title as a signed 32-bit number; its absolute value picks the bucket."""
    codes = F.transform(F.split(F.concat(id_.cast("string"), title), ""), lambda ch: F.ascii(ch).cast("long"))
    folded = F.aggregate(codes, F.lit(0).cast("long"), lambda h, ch: (h * 31 + ch).bitwiseAND(0xFFFFFFFF))
    signed = F.when(folded >= 1 << 31, folded - (1 << 32)).otherwise(folded)
    return (F.abs(signed) % buckets).cast("int")


# --- urls ---------------------------------------------------------------------------------------

def strip_tracking_query(url: Column, base: str = "") -> Column:
    clean = F.regexp_replace(url, r"[?#].*$", "")
    return F.when(F.rlike(clean, F.lit("^[a-z]+://")), clean).otherwise(F.concat(F.lit(base), clean))


def canonical_slug(url: Column) -> Column:
    """Last path segment without the version suffix."""
    path = F.regexp_replace(F.regexp_replace(url, r"[?#].*$", ""), "/+$", "")
    tail = F.element_at(F.split(F.regexp_replace(path, r"^[a-z]+://[^/]*/?", ""), "/"), -1)
    return F.regexp_replace(F.regexp_replace(tail, "-vose$", ""), "-doblada-al-espanol$", "")


def external_id(url: Column, pattern: str = r"/(movie|tv)/(\d+)") -> Column:
    """(kind, id) from a typed url, null parts when it does not match."""
    kind, number = F.regexp_extract(url, pattern, 1), F.regexp_extract(url, pattern, 2)
    return F.struct(F.nullif(kind, F.lit("")).alias("kind"), F.nullif(number, F.lit("")).cast("long").alias("id"))


def decode_ticket_token(path: Column) -> Column:
    """Base64 of the last path segment; anything undecodable gives the empty string."""
    parts = F.split(F.regexp_replace(path, "/+$", ""), "/")
    raw = F.element_at(parts, -1)
    padded = F.concat(raw, F.repeat(F.lit("="), F.pmod(F.lit(0) - F.length(raw), F.lit(4))))
    text = F.try_validate_utf8(F.try_to_binary(padded, F.lit("base64")).cast("string"))
    return F.when(F.size(parts) >= 4, F.coalesce(text, F.lit(""))).otherwise(F.lit(""))


def rating_out_of(c: Column) -> Column:
    return F.nullif(F.regexp_extract(c, r"([\d.]+)\s+out of", 1), F.lit("")).try_cast("double")


def watched_by(c: Column) -> Column:
    digits = F.replace(F.regexp_extract(F.replace(c, F.lit(" "), F.lit(" ")), r"Watched by ([\d,]+)", 1), F.lit(","), F.lit(""))
    return digits.try_cast("long")


def short_count(c: Column) -> Column:
    """``1.5K`` and ``2M`` to whole numbers."""
    body = F.regexp_replace(c, "[KM]$", "").try_cast("double")
    factor = F.when(F.endswith(c, F.lit("K")), 1000).when(F.endswith(c, F.lit("M")), 1000000).otherwise(1)
    return F.floor(body * factor).cast("long")
