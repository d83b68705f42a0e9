"""Mixing sources to target weights, in DataFrame operations only.

Every document gets a hash-random key. Keys are uniform, so equal-width ranges of the key are a range partition of a
source that needs no sampling; a source gets ranges in proportion to its rows. The sizes of the ranges are summed up to
prefix sums, rows are sorted inside their range, and the running size is cut at the exact budget of the source. A
budget above the size of the source takes whole epochs first.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from showgrid.llm.common import documents, word_array, word_count
from showgrid.llm.queries import query

WEIGHTS = (3, 1, 2)


def source_targets(sizes: DataFrame, share: float = 1.5, most: float = 2.0) -> DataFrame:
    """(source, rows, source_size, target) for every source of ``sizes(source, size)``.

    Sources in code point order, null last, weigh ``WEIGHTS`` in turn and share ``share`` times all sizes. A target
    stops at ``most`` times the size of its source; what is above goes to the others by weight. Sorted by
    the ratio of limit to weight, the sources that stop are a prefix, so the level of the rest is a ratio of running sums. The table
    has one row per source. Without rows the result is empty.
    """
    per = sizes.groupBy("source").agg(F.count(F.lit(1)).alias("rows"), F.sum("size").alias("source_size"))
    order = W.orderBy(F.col("source").asc_nulls_last())
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in WEIGHTS]), (F.pmod(F.row_number().over(order) - 1, F.lit(len(WEIGHTS))) + 1).cast("int"))
    everything = W.partitionBy()
    per = (per.withColumn("weight", weight).withColumn("cap", F.col("source_size") * F.lit(most))
           .withColumn("goal", F.sum("source_size").over(everything) * F.lit(share)))
    by_ratio = W.orderBy(F.col("cap") / F.col("weight"), F.col("source").asc_nulls_last())
    prior = by_ratio.rowsBetween(W.unboundedPreceding, -1)
    rest = by_ratio.rowsBetween(0, W.unboundedFollowing)
    level = (F.col("goal") - F.coalesce(F.sum("cap").over(prior), F.lit(0.0))) / F.sum("weight").over(rest)
    per = per.withColumn("level", level).withColumn("stops", F.col("level") * F.col("weight") > F.col("cap"))
    per = per.withColumn("level", F.max(F.when(~F.col("stops"), F.col("level"))).over(everything))
    # levels fall from the first source that does not stop: the highest is that of all of them
    target = F.when(F.col("stops"), F.col("cap")).otherwise(F.least(F.col("level") * F.col("weight"), F.col("cap")))
    return per.select("source", "rows", "source_size", target.cast("double").alias("target"))


def mix(docs: DataFrame, seed: str = "mix", share: float = 1.5, most: float = 2.0, ranges_per_task: int = 8,
        with_row: bool = False) -> DataFrame:
    """doc_id, source, size, source_size, target, taken; ``with_row`` also the whole input row as the struct ``row``.

    ``size`` is the number of words, 0 for null and empty texts. The words taken from a source sum to its target,
    rounded down; no document gives more than ``ceil(most)`` times its size. Equal rows share a key; the
    order among them is free, and the rows of the result are the same for any order. Other columns are left out, whatever their names.
    """
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    row = [F.struct(*docs.columns).alias("row")] if with_row else []
    base = docs.select("doc_id", "source", word_count(F.col("text")).alias("size"), *row)
    targets = source_targets(base.select("source", "size"), share, most)
    ranges = F.greatest(F.lit(1), F.ceil(F.col("rows") / F.sum("rows").over(W.partitionBy()) * parts * ranges_per_task)).cast("long")
    targets = targets.withColumn("ranges", ranges).withColumn("budget", F.floor("target").cast("long"))
    key = F.md5(F.concat(F.lit(seed + ":"), F.coalesce(F.col("doc_id").cast("string"), F.lit("null"))).cast("binary"))
    unit = F.conv(F.substring("key", 1, 12), 16, 10).cast("double") / F.lit(float(16**12))
    rows = (base.withColumn("key", key).join(targets.withColumnRenamed("source", "_source"), F.col("source").eqNullSafe(F.col("_source"))).drop("_source")
            .withColumn("range", F.floor(unit * F.col("ranges")).cast("long")))
    sums = rows.groupBy("source", "range").agg(F.sum("size").alias("range_size"))
    before = F.coalesce(F.sum("range_size").over(W.partitionBy("source").orderBy("range").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    sums = sums.select(F.col("source").alias("_source"), F.col("range").alias("_range"), before.alias("_before"))
    inside = W.partitionBy("source", "range").orderBy("key", "doc_id", "size").rowsBetween(W.unboundedPreceding, -1)
    rows = rows.withColumn("_inside", F.coalesce(F.sum("size").over(inside), F.lit(0)))
    rows = rows.join(sums, F.col("source").eqNullSafe(F.col("_source")) & (F.col("range") == F.col("_range")))
    epochs = F.when(F.col("source_size") > 0, F.floor(F.col("budget") / F.col("source_size"))).otherwise(0).cast("long")
    left = F.col("budget") - F.col("_epochs") * F.col("source_size") - F.col("_before") - F.col("_inside")
    taken = F.col("_epochs") * F.col("size") + F.greatest(F.lit(0).cast("long"), F.least("size", left))
    return (rows.withColumn("_epochs", epochs).withColumn("taken", taken.cast("long"))
            .select("doc_id", "source", "size", "source_size", "target", "taken", *(["row"] if with_row else [])))


def mixed_documents(docs: DataFrame) -> DataFrame:
    """The documents of the mix, once per epoch; the document at the cut keeps only the words that are taken.

    A whole text stays as it is. A cut text is its first words joined by one space, with its new ``n_chars``. Texts without
    words carry nothing and are left out. The columns are those of ``docs``.
    """
    plan = mix(docs, with_row=True)
    whole = F.when(F.col("size") > 0, F.floor(F.col("taken") / F.col("size"))).otherwise(0).cast("int")
    over = (F.col("taken") - whole * F.col("size")).cast("int")
    copies = F.concat(F.array_repeat(F.col("size").cast("int"), whole), F.when(over > 0, F.array(over)).otherwise(F.array().cast("array<int>")))
    out = plan.withColumn("keep", F.explode(copies))
    same, text = F.col("keep") == F.col("size"), F.col("row").getField("text")
    out = out.withColumn("text", F.when(same, text).otherwise(F.array_join(F.slice(word_array(text), 1, F.col("keep")), " ")))
    changed = {"text": F.col("text")}
    if "n_chars" in docs.columns:
        changed["n_chars"] = F.when(same, F.col("row").getField("n_chars")).otherwise(F.length("text").cast("long"))
    return out.select(*[changed.get(c, F.col("row").getField(c)).alias(c) for c in docs.columns])


SQL = r"""
with d as (select doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::bigint as size,
                  md5('mix:' || coalesce(doc_id::varchar, 'null')) as key from documents),
per as (select source, sum(size)::bigint as source_size from d group by source),
w as (select *, [3.0, 1.0, 2.0][((row_number() over (order by source nulls last) - 1) % 3 + 1)::int]::double as weight,
             source_size * 2.0::double as cap, sum(source_size) over () * 1.5::double as goal from per),
l as (select *, (goal - coalesce(sum(cap) over (order by cap / weight, source nulls last rows between unbounded preceding and 1 preceding), 0.0))
              / sum(weight) over (order by cap / weight, source nulls last rows between current row and unbounded following) as level from w),
s as (select *, level * weight > cap as stops from l),
t as (select source, source_size, case when stops then cap else least(max(level) filter (not stops) over () * weight, cap) end::double as target from s),
r as (select d.doc_id, d.size, t.source_size, t.target, floor(t.target)::bigint as budget,
             coalesce(sum(d.size) over (partition by d.source order by d.key, d.doc_id, d.size rows between unbounded preceding and 1 preceding), 0)::bigint as before
      from d join t on d.source is not distinct from t.source),
e as (select *, case when source_size > 0 then budget // source_size else 0 end as epochs from r)
select doc_id, size, source_size, target, (epochs * size + greatest(0, least(size, budget - epochs * source_size - before)))::bigint as taken from e
"""


@query("op9_mixing", SQL)
def op9(spark, folder):
    return mix(documents(spark, folder)).select("doc_id", "size", "source_size", "target", "taken")
