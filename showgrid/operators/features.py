"""Sparse film vectors in long form and content scoring of all users at once."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from showgrid import lookups
from showgrid.functions.dates import decade_bucket, popularity_boost, runtime_bucket
from showgrid.functions.metadata import union_languages
from showgrid.operators import blocked

ROWS_PER_SALT = 20_000


def steady(c: str) -> Column:
    """Sort value of a sum: ten digits, so that the order in which tasks add up does not decide ties."""
    return F.round(c, 10)


def film_vectors(films: DataFrame, weights: dict[str, float] | None = None) -> DataFrame:
    """(film_id, dim, category, w): eleven weighted feature groups.

    All groups of a film are built inside its row and exploded once, so there is no shuffle. A dimension
    named twice is set, not added: equal weights collapse, and for the billing-weighted cast the last one stays.
    """
    weights = weights or lookups.VECTOR_WEIGHTS
    caps = lookups.VECTOR_CAPS

    def even(prefix: str, names: Column, total: float, divisor: Column) -> Column:
        dims = F.array_distinct(F.transform(names, lambda x: F.concat(F.lit(prefix + ":"), x)))
        return F.transform(dims, lambda x: F.struct(x.alias("dim"), (F.lit(total) / divisor).alias("w")))

    def one(dim: Column, w: Column, when: Column) -> Column:
        return F.when(when, F.array(F.struct(dim.alias("dim"), w.cast("double").alias("w"))))

    def ids(c: Column) -> Column:
        return F.transform(c, lambda x: x["id"].cast("string"))

    lowered = lambda c: F.transform(F.col(c), F.lower)
    cast = F.slice("top_cast", 1, caps["cast"])
    n = F.size(cast)
    billed = F.transform(cast, lambda x, i: F.struct(
        F.concat(F.lit("cast:"), x["id"].cast("string")).alias("dim"), (F.lit(weights["cast"]) * ((n - i) / (n * (n + 1) / 2))).alias("w")))
    billed = F.filter(billed, lambda x, i: ~F.exists(F.slice(billed, i + 2, F.lit(caps["cast"])), lambda y: y["dim"] == x["dim"]))
    languages = union_languages(F.col("primary_language"), F.col("spoken_languages"))
    keywords, companies = F.slice("keywords", 1, caps["keyword"]), F.slice("production_companies", 1, caps["company"])
    stars = F.array_compact(F.array(F.col("rating") / 5, F.col("tmdb_rating") / 10))
    mean = F.aggregate(stars, F.lit(0.0), lambda a, x: a + x) / F.size(stars)
    groups = [
        even("genre", lowered("genres"), weights["genre"], F.greatest(F.size("genres"), F.lit(lookups.MIN_GENRE_DIVISOR))),
        F.when(F.size("directors") > 0, even("director", ids(F.col("directors")), weights["director"], F.size("directors")))
        .when(F.col("director") != "", even("director", F.array(F.lower("director")), weights["director"], F.lit(1))),
        F.when(n > 0, billed),
        even("keyword", ids(keywords), weights["keyword"], F.size(keywords)),
        even("company", ids(companies), weights["company"], F.size(companies)),
        even("country", lowered("country"), weights["country"], F.size("country")),
        even("lang", languages, weights["language"], F.size(languages)),
        one(F.concat(F.lit("decade:"), decade_bucket(F.col("year"))), F.lit(weights["decade"]), F.lit(True)),
        one(F.concat(F.lit("runtime:"), runtime_bucket(F.col("runtime_minutes"))), F.lit(weights["runtime"]), F.lit(True)),
        one(F.lit("rating"), mean * weights["rating"], F.size(stars) > 0),
        one(F.concat(F.lit("collection:"), F.col("collection_id").cast("string")), F.lit(weights["collection"]), F.col("collection_id").isNotNull()),
    ]
    empty = F.expr("cast(array() as array<struct<dim:string,w:double>>)")
    every = F.concat(*[F.coalesce(g, empty) for g in groups])
    return films.select(F.col("id").alias("film_id"), F.explode(every).alias("v")).select(
        "film_id", "v.dim", F.substring_index("v.dim", ":", 1).alias("category"), "v.w")


def feature_coverage(vectors: DataFrame, weights: dict[str, float] | None = None) -> DataFrame:
    """Share of the weight budget (collection excepted) backed by known values, at most 1."""
    budget = 1.0 - (weights or lookups.VECTOR_WEIGHTS)["collection"]
    known = F.sum(F.when(~F.endswith("dim", F.lit(":unknown")), F.col("w")).otherwise(0.0))
    return vectors.groupBy("film_id").agg(F.least(known / budget, F.lit(1.0)).alias("coverage"))


def user_profile(watched: DataFrame, vectors: DataFrame) -> DataFrame:
    """(user_id, dim, v): rating-weighted mean vector of the watched films; unrated films weigh 3 of 5.

    ``watched`` has ``user_id, film_id, rating``; only films with a vector count. Every film has exactly one runtime dimension, so the weights of
    those dimensions sum to the total of the user. A film travels to its user as one row with its vector, in flat arrays; the vector is opened behind the one
    shuffle, so what moves grows with the feedback and not with its features. Sums and totals use the same placing by user.
    """
    whole = vectors.groupBy("film_id").agg(F.collect_list(F.struct("dim", "w", (F.col("category") == "runtime").alias("timed"))).alias("_e"))  # a film's own features
    weighed = watched.select("user_id", "film_id", (F.coalesce("rating", F.lit(3.0)) / 5).alias("weight"))
    flat = whole.select("film_id", *[F.col(f"_e.{c}").alias(c) for c in ("dim", "w", "timed")])
    opened = weighed.join(flat, "film_id").select("user_id", "weight", "dim", "w", "timed").repartition("user_id").select("user_id", "weight", F.explode(F.arrays_zip("dim", "w", "timed")).alias("_e"))
    sums = opened.groupBy("user_id", "_e.dim").agg(F.sum(F.col("_e.w") * F.col("weight")).alias("s"), F.sum(F.when(F.col("_e.timed"), F.col("weight")).otherwise(0.0)).alias("n"))
    total = F.sum("n").over(W.partitionBy("user_id"))  # a user has at most all dimensions of the catalogue
    return sums.withColumn("total", total).select("user_id", "dim", F.when(F.col("total") > 0, F.col("s") / F.col("total")).otherwise(F.col("s")).alias("v"))


def unit(vectors: DataFrame, key: str, value: str) -> DataFrame:
    """Vectors scaled to length one; zero vectors are dropped."""
    norms = vectors.groupBy(key).agg(F.sqrt(F.sum(F.col(value) * F.col(value))).alias("_norm")).where("_norm > 0")
    return vectors.join(norms, key).withColumn(value, F.col(value) / F.col("_norm")).drop("_norm")


def salted(many: DataFrame, few: DataFrame, key: str, spread: str) -> tuple[DataFrame, DataFrame]:
    """Split join keys by their frequency: a key with n rows in ``many`` gets one salt per ``ROWS_PER_SALT`` of them.

    Rows of ``many`` take a salt from ``spread``, rows of ``few`` are copied to the salts of their key; most keys have one.
    """
    salts = many.groupBy(key).agg(F.ceil(F.count(F.lit(1)) / ROWS_PER_SALT).cast("int").alias("_salts"))
    left = many.join(salts, key).withColumn("_salt", F.pmod(F.xxhash64(spread), F.col("_salts")).cast("int")).drop("_salts")
    right = few.join(salts, key).withColumn("_salt", F.explode(F.sequence(F.lit(0), F.col("_salts") - 1))).drop("_salts")
    return left, right


def matching_features(profile: DataFrame, vectors: DataFrame) -> DataFrame:
    """(user_id, film_id, dim, category, contribution) of shared dimensions.

    Dimensions such as a decade are shared by very many users and films, so frequent ones are salted.
    """
    left, right = salted(profile, vectors, "dim", "user_id")
    return left.join(right, ["dim", "_salt"]).select("user_id", "film_id", "dim", "category", (F.col("v") * F.col("w")).alias("contribution"))


def cosine_scores(profile: DataFrame, vectors: DataFrame, pairs: DataFrame | None = None, wanted: DataFrame | None = None, factors: DataFrame | None = None,
                  users: DataFrame | None = None) -> DataFrame:
    """(user_id, film_id, sim) for all ``users`` (default: those with a profile) and all ``wanted`` films (default: those of ``vectors``), or only for ``pairs``.

    All pairs are multiplied in blocks (then ``vectors`` and ``profile`` are numbered, see :mod:`showgrid.operators.blocked`), times the film's factor if
    ``factors`` are given. Of ``pairs``, those without overlap are added as zeros before the one aggregation.
    """
    if pairs is None:
        return blocked.all_cosines(profile, vectors, vectors if wanted is None else wanted, factors, users).withColumnRenamed("x", "sim")
    p, f = unit(profile, "user_id", "v"), unit(vectors, "film_id", "w")
    required = pairs.select("user_id", "film_id").distinct()
    hits = required.join(f, "film_id").join(p, ["user_id", "dim"]).select("user_id", "film_id", (F.col("v") * F.col("w")).alias("x"))
    return hits.unionByName(required.withColumn("x", F.lit(0.0))).groupBy("user_id", "film_id").agg(F.sum("x").alias("sim"))


def film_factors(films: DataFrame, vectors: DataFrame) -> DataFrame:
    """Popularity boost, coverage and their combined factor per film."""
    return feature_coverage(vectors).join(films.select(F.col("id").alias("film_id"), popularity_boost(F.col("viewers")).alias("boost")), "film_id").withColumn(
        "factor", F.col("boost") * F.sqrt("coverage"))


def content_score(sims: DataFrame, factors: DataFrame | None = None) -> DataFrame:
    """0..100 match score: similarity times popularity boost times root of coverage. Without ``factors`` they are in ``sim`` already."""
    raw = F.col("sim") if factors is None else F.col("sim") * F.col("factor")
    return (sims if factors is None else sims.join(factors.select("film_id", "factor"), "film_id")).select(
        "user_id", "film_id", (raw * 100).alias("raw"), F.least(F.lit(100), F.floor(raw * 100 + 0.5)).cast("int").alias("score"))


def content_breakdown(profile: DataFrame, vectors: DataFrame, wanted: DataFrame | None = None) -> DataFrame:
    """(user_id, film_id, category, share): category shares of the dot product of every user and ``wanted`` film, rounded to 2 digits.

    Pairs are multiplied in blocks; ``vectors`` and ``profile`` are numbered, see :mod:`showgrid.operators.blocked`."""
    return blocked.all_shares(profile, vectors, vectors if wanted is None else wanted)


def top_features(profile: DataFrame, vectors: DataFrame, n: int = 10) -> DataFrame:
    """The ``n`` strongest shared features of every user and film."""
    order = W.partitionBy("user_id", "film_id").orderBy(steady("contribution").desc(), F.col("dim"))
    found = matching_features(profile, vectors).where("contribution > 0")
    return found.withColumn("position", F.row_number().over(order)).where(F.col("position") <= n)


def idf_weights(vectors: DataFrame, variant: str = "plain") -> DataFrame:
    """(dim, idf). ``plain``: ln(N/(1+df)), may be negative. ``penalty``: min(1, ln(N/df)) without dims of every film."""
    total = vectors.agg(F.countDistinct("film_id").alias("_n"))
    df = vectors.groupBy("dim").agg(F.count(F.lit(1)).alias("df")).crossJoin(F.broadcast(total))
    if variant == "plain":
        return df.select("dim", F.ln(F.col("_n") / (1 + F.col("df"))).alias("idf"))
    if variant == "penalty":
        return df.where(F.col("df") < F.col("_n")).select("dim", F.least(F.lit(1.0), F.ln(F.col("_n") / F.col("df"))).alias("idf"))
    raise ValueError("variant is 'plain' or 'penalty'")


def apply_idf(vectors: DataFrame, idf: DataFrame, variant: str = "plain", value: str = "w") -> DataFrame:
    """``plain``: unknown dims keep their weight. ``penalty``: unknown dims go, and only four categories are scaled."""
    if variant == "plain":
        return vectors.join(idf, "dim", "left").withColumn(value, F.col(value) * F.coalesce("idf", F.lit(1.0))).drop("idf")
    category = F.col("category") if "category" in vectors.columns else F.substring_index("dim", ":", 1)
    scaled = category.isin(lookups.IDF_PENALTY_CATEGORIES)
    return vectors.join(idf, "dim").withColumn(value, F.when(scaled, F.col(value) * F.col("idf")).otherwise(F.col(value))).drop("idf")


def profile_report(profile: DataFrame, n: int = 30, per_category: int = 5, names: DataFrame | None = None) -> DataFrame:
    """Per user: top profile dims, category shares and the top dims of each category.

    With ``names`` (dim, name) the profile is numbered in the order of the names; numbers are ranked and only reported ones get their names.
    """
    category = F.substring_index("dim", ":", 1)
    if names is not None:  # names of a category begin alike, so its numbers lie side by side
        ends = names.groupBy(F.substring_index("name", ":", 1).alias("category")).agg(F.max("dim").alias("last")).orderBy("last").collect()  # a row a category
        category = F.coalesce(*[F.when(F.col("dim") <= e["last"], F.lit(e["category"])) for e in ends]) if ends else F.lit(None).cast("string")
    p = profile.withColumn("category", category)
    top = p.withColumn("position", F.row_number().over(W.partitionBy("user_id").orderBy(steady("v").desc(), F.col("dim")))).where(F.col("position") <= n)
    best = p.withColumn("position", F.row_number().over(W.partitionBy("user_id", "category").orderBy(steady("v").desc(), F.col("dim")))).where(F.col("position") <= per_category)
    cats = p.groupBy("user_id", "category").agg(F.sum("v").alias("v"))
    totals = cats.groupBy("user_id").agg(F.sum("v").alias("_t"))
    shares = cats.join(totals, "user_id").select("user_id", F.lit("share").alias("part"), "category", F.lit(None).cast("string").alias("dim"),
                                                 F.when(F.col("_t") > 0, F.col("v") / F.col("_t")).otherwise(0.0).alias("v"), F.lit(None).cast("int").alias("position"))
    cols = ["user_id", "part", "category", "dim", "v", "position"]
    found = top.withColumn("part", F.lit("top")).select(*cols).unionByName(best.withColumn("part", F.lit("category_top")).select(*cols))
    if names is not None:
        found = found.join(names, "dim").withColumn("dim", F.col("name"))
    return found.select(*cols).unionByName(shares.select(*cols))


def shared_with(vectors: DataFrame, *items: int) -> DataFrame:
    """The part of ``vectors`` that a profile needs to be compared with ``items``: their dimensions, and the runtime, from which totals come."""
    dims = vectors.where(F.col("film_id").isin(*items)).select("dim").distinct()  # features of a few films
    runtime = vectors.where(F.col("category") == "runtime")
    others = vectors.where(F.col("category") != "runtime").join(F.broadcast(dims), "dim", "left_semi")
    return runtime.unionByName(others.select(*runtime.columns))


def compare_items(profile: DataFrame, vectors: DataFrame, a: int, b: int) -> DataFrame:
    """Two films side by side for every user: contribution and share per shared or unique feature.

    The features of two films are a few rows, so each profile entry meets both at once, and totals stay where the profile lies.
    """
    def of(film, name):
        return F.max(F.when(F.col("film_id") == film, F.col("w"))).alias(name)

    both = vectors.where(F.col("film_id").isin(a, b)).groupBy("dim").agg(of(a, "_a"), of(b, "_b"))
    hits = profile.join(F.broadcast(both), "dim")
    for name in ("a", "b"):
        x = F.col("v") * F.col(f"_{name}")
        hits = hits.withColumn(name, F.when(x > 0, x))
    hits = hits.where("a is not null or b is not null")
    for name in ("a", "b"):
        hits = hits.withColumn(f"share_{name}", F.col(name) / F.sum(name).over(W.partitionBy("user_id")))  # at most the features of two films a user
    kind = F.when(F.col("a").isNull(), F.lit("only_b")).when(F.col("b").isNull(), F.lit("only_a")).otherwise(F.lit("shared"))
    return hits.select("user_id", "dim", "a", "share_a", "b", "share_b", kind.alias("kind"))
