"""Secret scans: fixed patterns, and character Markov models that tell random strings from ordinary identifiers.

Two bigram models are counted from labelled samples: strings known to be random and words of the texts themselves. A string
is scored by the mean log-likelihood ratio of its character steps. SQL functions only.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from showgrid.llm.common import documents, word_array
from showgrid.llm.queries import query
from showgrid.llm.spans import apart_from, count_kind, find_spans, let, replace_spans, span_list, spans_if

BASE = ["assign", "access", "hex"]
ADDED = ["random"]
ASSIGN = r"(?i:(password|passwd|secret|token|api_?key))[\"']?\x20*+[:=]\x20*+[\"']?([A-Za-z0-9+/_.=-]++)"
ACCESS = r"AKIA[A-Z0-9]{14,}+"
HEX = r"(?<![0-9a-f])[0-9a-f]{16,}+"
#: Strings that may be random: every whole run of 20 characters or more. It is entered at its start only and never given back, so a scan is linear.
RANDOM = r"(?<![A-Za-z0-9+/_=-])[A-Za-z0-9+/_=-]{20,}+"
ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_=-"
SIZE = len(ALPHABET) + 1
#: Mean log-likelihood ratio of a step, in nats, from which a string counts as random.
RANDOM_FROM = 0.5


def step_codes(s: Column) -> Column:
    """Number of each character step of a string, cut into characters once; characters outside the alphabet share one code."""
    code = F.transform(F.regexp_extract_all(s, F.lit("(?s)."), F.lit(0)), lambda c: F.call_function("instr", F.lit(ALPHABET), c).cast("int"))
    return F.when(F.length(s) > 1, let(code, lambda k: F.zip_with(F.slice(k, F.lit(1), F.size(k) - 1), F.slice(k, F.lit(2), F.size(k)), lambda a, b: a * SIZE + b))).otherwise(
        F.array().cast("array<int>"))


def train(docs: DataFrame) -> list[float]:
    """Log-likelihood ratio, random against ordinary, of every character step; ``SIZE * SIZE`` numbers.

    Both classes are counted over all documents. Random strings, known to be so, are digests of the document ids in hexadecimal, base64 and base 36; ordinary ones are the distinct
    words of all texts, each once, in one of the shapes of identifiers, paths and constants that its hash picks. Words are made distinct before they are counted, and steps are summed before
    the shuffle. Counts are smoothed by one, so an empty table gives ratios of 0. A character that repeats itself (rules, padding)
    never speaks for chance: its ratio is at most 0. Only the counts, at most ``SIZE * SIZE`` a class, reach the driver.
    """
    ids = docs.select("doc_id").where("doc_id is not null").distinct()
    digest = F.sha2(F.concat(F.lit("random:"), F.col("doc_id").cast("string")), 512)
    random = ids.select(F.explode(F.array(F.rtrim(F.base64(F.unhex(digest)), F.lit("=")), F.substring(digest, 1, 40),
                                          F.upper(F.conv(F.substring(digest, 1, 15), 16, 36)))).alias("s"), F.lit(1).alias("random"))
    plain = F.array_distinct(F.transform(word_array(F.col("text")), lambda w: F.regexp_replace(w, "[^A-Za-z]", "")))
    words = docs.select(F.explode(plain).alias("w")).where("length(w) > 2").distinct().withColumn("h", F.xxhash64("w"))
    number = F.pmod("h", F.lit(1000))
    low, high, title, digits = F.lower("w"), F.upper("w"), F.concat(F.upper(F.substring("w", 1, 1)), F.lower(F.substring("w", 2, 1 << 30))), number.cast("string")
    forms = [F.col("w"), F.concat("w", F.lit("_"), low), F.concat(low, F.lit("-"), digits), F.concat(low, F.lit("-"), low), F.concat(low, F.lit("/"), low),
             F.concat(low, title), F.concat(high, F.lit("_"), high), F.concat(digits, F.lit("-"), digits, F.lit("/"), digits, F.lit("/"), low)]
    shape = F.pmod(F.shiftright("h", 20), F.lit(len(forms)))
    picked = forms[0]
    for i, form in enumerate(forms[1:], 1):
        picked = F.when(shape == i, form).otherwise(picked)
    ordinary = words.select(picked.alias("s"), F.lit(0).alias("random"))
    counts = (random.union(ordinary).select("random", F.explode(step_codes(F.col("s"))).alias("step")).groupBy("random", "step").count().collect())
    table = [[1.0] * (SIZE * SIZE), [1.0] * (SIZE * SIZE)]
    for r in counts:
        table[r["random"]][r["step"]] += r["count"]
    rows = [[sum(t[i * SIZE : (i + 1) * SIZE]) for i in range(SIZE)] for t in table]
    ratios = [math.log(table[1][k] / rows[1][k // SIZE]) - math.log(table[0][k] / rows[0][k // SIZE]) for k in range(SIZE * SIZE)]
    return [min(x, 0.0) if k % (SIZE + 1) == 0 else x for k, x in enumerate(ratios)]


def likelihood_ratio(s: Column, model: list[float]) -> Column:
    """Mean ratio of the steps of a string; 0 for strings of one character."""
    ratios = F.from_json(F.lit("[" + ",".join(f"{x:.6f}" for x in model) + "]"), "array<double>")
    steps = step_codes(s)
    total = F.aggregate(steps, F.lit(0.0), lambda a, k: a + F.element_at(ratios, k + 1))
    return F.when(F.length(s) > 1, total / (F.length(s) - 1)).otherwise(0.0)


def secret_spans(docs: DataFrame, model: list[float], text: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """``keep`` columns with ``whole`` (the text, null as empty) and ``spans``: array of struct<kind, start, end, text>.

    Base kinds stay whatever the models say; ``random`` is added for strings from ``RANDOM_FROM`` on that no base span
    overlaps. A document is one row throughout, so repeated rows and ties need no care. Empty and null texts have no spans; very long texts and runs take time
    in proportion; an empty table gives no rows. Other columns are left out.
    """
    t = F.col("whole")
    key = t.rlike("(?i)passw|secret|token|api_?key")
    out = docs.select(*keep, F.coalesce(F.col(text), F.lit("")).alias("whole")).select(
        "*",
        spans_if(key, F.filter(find_spans(t, ASSIGN, "assign"), lambda s: F.length(F.regexp_extract(s["text"], ASSIGN, 2)) >= 12)).alias("assign"),
        spans_if(t.contains("AKIA"), find_spans(t, ACCESS, "access")).alias("access"),
        find_spans(t, HEX, "hex").alias("hex"),
        find_spans(t, RANDOM, "random").alias("random"))
    out = out.select(*keep, "whole", "random", F.concat("assign", "access", "hex").alias("base"))
    extra = F.filter(apart_from(F.col("random"), F.col("base")), lambda s: likelihood_ratio(s["text"], model) >= RANDOM_FROM)
    return out.select(*keep, "whole", F.concat("base", F.when(F.size("random") > 0, extra).otherwise(F.col("random"))).alias("spans"))


def redact(docs: DataFrame, model: list[float]) -> DataFrame:
    """Documents with every secret replaced by ``[SECRET]``; the columns and clean texts stay as they are.

    Null and empty texts stay so, repeated rows give repeated rows, very long texts are searched whole, an empty table stays empty, and columns of any name are kept.
    """
    found = secret_spans(docs.select(F.struct(*docs.columns).alias("row"), "text"), model, keep=("row",))
    some = F.size("spans") > 0
    found = found.select("row", "spans", F.when(some, replace_spans(F.col("whole"), F.col("spans"), "SECRET")).otherwise(F.col("row").getField("text")).alias("new"))
    changed = {"text": F.col("new")}
    if "n_chars" in docs.columns:
        changed["n_chars"] = F.when(some, F.length("new").cast("long")).otherwise(F.col("row").getField("n_chars"))
    return found.select(*[changed.get(c, F.col("row").getField(c)).alias(c) for c in docs.columns])


@query("op10_secrets")
def op10(spark, folder):
    docs = documents(spark, folder).select("doc_id", "text")
    found = secret_spans(docs, train(docs))
    base = F.filter("spans", lambda s: s["kind"].isin(BASE))
    return found.select("doc_id", *[count_kind(F.col("spans"), k).alias(f"n_{k}") for k in BASE],
                        F.sha2(span_list(base, BASE), 256).alias("base_sha256"), span_list(F.col("spans"), BASE + ADDED).alias("spans"))
