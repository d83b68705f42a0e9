"""Dealing the members of hash buckets into blocks, so that no task gets a whole hot bucket and no pair is emitted.

Rows that share a bucket key are candidates of each other. A bucket of up to ``block`` rows is one block. A larger one is cut into
parts by a hash of the row, and every two parts, and every part with itself, meet in a block of their own. A block names its parts;
a row in the block of two parts is compared with the other part only.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from showgrid.llm.common import cut_lineage


def bucket_blocks(members: DataFrame, id_col: str, block: int, weight: int) -> DataFrame:
    """(id, bucket, part_a, part_b, part) for all rows of buckets with two rows or more.

    ``members`` has ``id``, ``bucket`` and ``weight``; parts are made for ``block`` rows or ``weight`` units of weight,
    whichever are more. Buckets with one row are gone after the first count, which is a partial aggregate.
    """
    counts = (members.groupBy("bucket").agg(F.count(F.lit(1)).alias("n"), F.sum("weight").alias("w")).where("n >= 2")
              .select(F.col("bucket").alias("_bucket"), F.greatest(F.ceil(F.col("n") / block), F.ceil(F.col("w") / weight)).cast("int").alias("parts")))
    counts = cut_lineage(counts)  # a table of its own: the join may then split a hot bucket
    placed = members.select(id_col, "bucket").join(counts, F.col("bucket") == F.col("_bucket")).drop("_bucket")
    part = F.pmod(F.xxhash64(id_col, "bucket"), F.col("parts")).cast("int")
    placed = placed.withColumn("part", part).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    return placed.select(id_col, "bucket", F.least("part", "other").alias("part_a"), F.greatest("part", "other").alias("part_b"), "part")
