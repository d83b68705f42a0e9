"""Building blocks that keep the operators safe on skewed keys and on lost executors."""

from __future__ import annotations

import tempfile
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W


def lookup(spark: SparkSession, rows: Sequence[tuple], schema: str) -> DataFrame:
    """A fixed in-code table. Its size is bounded by the source file, so it is broadcast."""
    return F.broadcast(spark.createDataFrame(list(rows), schema))


def blank_to_null(c: Column | str) -> Column:
    """Trimmed text, with the empty string as null."""
    c = F.col(c) if isinstance(c, str) else c
    return F.nullif(F.trim(c), F.lit(""))


def cut_lineage(df: DataFrame) -> DataFrame:
    """Reliable checkpoint in the shared folder named by ``spark.checkpoint.dir``.

    Only a local session without that setting gets a folder of its own; a cluster without it is an
    error, because a machine-local folder would not survive the loss of an executor.
    """
    spark = df.sparkSession
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if not folder:
            if not sc.master.startswith("local"):
                raise RuntimeError("set spark.checkpoint.dir to a folder shared by all executors")
            folder = tempfile.mkdtemp(prefix="showgrid-checkpoint-")
        sc.setCheckpointDir(folder)
    return df.checkpoint(eager=True)


def dealt(df: DataFrame, *keys: str) -> DataFrame:
    """Rows dealt over ``spark.sql.shuffle.partitions`` tasks, by ``keys`` where given.

    For rows of few bytes that grow much in what follows: a scan cuts a table by its bytes and would give all of them to one or two
    tasks. The number is explicit, so the adaptive planner doesn't merge the small partitions again.
    """
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), *keys)


def first_by(keys: Sequence[str], order: Sequence[str], df: DataFrame, last: bool = False) -> DataFrame:
    """First (or last) row per key as a partial aggregate: no per-key sort and no window.

    A hot key costs one row per map task in the shuffle, whatever its share of the input. Every
    column is an order column or a payload, so equal orders still give one definite row.
    """
    rest = [c for c in df.columns if c not in keys and c not in order]
    pick = F.max if last else F.min
    comparable = [c for c in rest if not df.schema[c].dataType.simpleString().startswith("map")]
    if len(comparable) == len(rest):
        best = df.groupBy(*keys).agg(pick(F.struct(*order, *rest)).alias("_best"))
    else:
        by = F.max_by if last else F.min_by
        best = df.groupBy(*keys).agg(by(F.struct(*order, *rest), F.struct(*order)).alias("_best"))
    return best.select(*keys, "_best.*").select(*df.columns)


def global_rank(df: DataFrame, order: Sequence[Column], name: str = "rank", partitions: int | None = None) -> DataFrame:
    """1-based position in a total order, computed without moving all rows to one task.

    Rows are range-partitioned by the full order (which must end in a unique column, so a frequent
    leading value is still split), numbered inside each partition, and shifted by the row counts of
    the partitions before. The counts table has one row per partition, hence the broadcast. The
    sorted rows are checkpointed so that counting and numbering see the same partitions.
    """
    n = partitions or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    placed = cut_lineage(
        df.repartitionByRange(n, *order)
        .sortWithinPartitions(*order)
        .withColumn("_mid", F.monotonically_increasing_id())
    )
    pid = F.shiftright("_mid", 33)
    counts = placed.groupBy(pid.alias("_pid")).agg(F.count(F.lit(1)).alias("_n"))
    before = F.coalesce(
        F.sum("_n").over(W.orderBy("_pid").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)
    )
    offsets = counts.select("_pid", before.alias("_off"))
    return (
        placed.withColumn("_pid", pid)
        .join(F.broadcast(offsets), "_pid")
        .withColumn(name, F.col("_off") + (F.col("_mid").bitwiseAND((1 << 33) - 1)) + 1)
        .drop("_pid", "_off", "_mid")
    )


def rank_within(df: DataFrame, group: Sequence[str], order: Sequence[Column], name: str = "rank",
                partitions: int | None = None) -> DataFrame:
    """Position inside each group without a per-group window, for groups that may be very large.

    The global position minus the first position of the group; the first positions are a
    partial aggregate, so a group holding a third of the rows is still spread over many tasks.
    """
    ranked = global_rank(df, [F.col(g) for g in group] + list(order), "_pos", partitions)
    starts = ranked.groupBy(*group).agg(F.min("_pos").alias("_start"))
    return (
        ranked.join(starts, list(group))
        .withColumn(name, F.col("_pos") - F.col("_start") + 1)
        .drop("_pos", "_start")
    )
