"""Sinks: versioned tables with an atomic pointer, catalogue files and per-user replacement."""

from __future__ import annotations

import time

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from showgrid.util import cut_lineage


def write_catalog(df: DataFrame, path: str, fmt: str = "json") -> None:
    """Write to a new path; readers never see a half-written one because ``_SUCCESS`` comes last."""
    if fmt == "csv":
        nested = [f.name for f in df.schema if f.dataType.typeName() in ("array", "struct", "map")]
        for name in nested:
            df = df.withColumn(name, F.to_json(name))
        df.write.mode("errorifexists").option("header", True).option("escape", '"').csv(path)
    else:
        df.write.mode("errorifexists").format(fmt).save(path)


def write_export(files: dict[str, DataFrame], root: str) -> None:
    """Files of many exports as ``root/<folder>/<file>``: each frame has a column ``folder`` and is written in one pass, whatever the number of folders.

    Rows without a folder belong to no export. A file without rows is left out, but for one header where no folder has the file.
    """
    for file, df in files.items():
        spark, staged = df.sparkSession, f"{root}.staged/{file}"
        df = df.where("folder is not null")
        df.write.option("header", True).option("escape", '"').partitionBy("folder").csv(staged)
        jvm, fs = _fs(spark, staged)
        path = jvm.org.apache.hadoop.fs.Path
        made = [p.getPath() for p in fs.listStatus(path(staged)) if p.getPath().getName().startswith("folder=")]
        for part in made:
            target = path(f"{root}/{part.getName().removeprefix('folder=')}/{file}")
            fs.mkdirs(target.getParent())
            if not fs.rename(part, target):
                raise OSError(f"could not place {target}")
        if not made:
            df.drop("folder").write.option("header", True).option("escape", '"').csv(f"{root}/empty/{file}")


def _fs(spark: SparkSession, path: str):
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    return jvm, p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


class VersionedTable:
    """``root/v=N`` parquet folders plus a pointer file.

    A job reads the current version and writes the next one, so it never overwrites what it reads; a
    repeated job after a failure writes a fresh folder and only a finished one becomes current.
    """

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    def current(self) -> str | None:
        jvm, fs = _fs(self.spark, self.root)
        pointer = jvm.org.apache.hadoop.fs.Path(f"{self.root}/current.txt")
        if not fs.exists(pointer):
            return None
        return self.spark.read.text(f"{self.root}/current.txt").head()[0]

    def read(self, schema: str | None = None) -> DataFrame:
        folder = self.current()
        if folder is None:
            if schema is None:
                raise FileNotFoundError(self.root)
            return self.spark.createDataFrame([], schema)
        return self.spark.read.parquet(f"{self.root}/{folder}")

    def write(self, df: DataFrame, tag: str | None = None, partition_by: list[str] = ()) -> str:
        """Write a new version and switch to it. The same ``tag`` twice is one version (idempotent batches)."""
        folder = f"v={tag if tag is not None else time.time_ns()}"
        if self.current() == folder:
            return folder
        df.write.mode("overwrite").partitionBy(*partition_by).parquet(f"{self.root}/{folder}")
        jvm, fs = _fs(self.spark, self.root)
        path = jvm.org.apache.hadoop.fs.Path
        fresh = path(f"{self.root}/current.tmp")
        out = fs.create(fresh, True)
        out.write(bytearray(folder.encode()))
        out.close()
        overwrite = jvm.org.apache.hadoop.fs.Options.Rename.OVERWRITE
        options = self.spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 1)
        options[0] = overwrite
        context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(fs.getUri(), self.spark.sparkContext._jsc.hadoopConfiguration())
        context.rename(fresh, path(f"{self.root}/current.txt"), options)
        return folder


#: Parts of a bucket that are written by different tasks, and so its files.
SLICES = 8


class BucketedTable:
    """Rows dealt by a hash of their key into ``bucket=N`` folders; a merge reads and rewrites only the buckets that its new rows fall into.

    The new content of those buckets is checkpointed before they are overwritten. ``combine`` must give the same rows when
    a batch comes again after a failure; a batch then costs in proportion to the buckets it touches, not to the history. Readers may see a merge half done.
    """

    def __init__(self, spark: SparkSession, root: str, keys: list[str], schema: str, buckets: int = 64):
        self.spark, self.root, self.keys, self.schema, self.buckets = spark, root.rstrip("/"), keys, schema, buckets

    def dealt(self, df: DataFrame) -> DataFrame:
        return df.withColumn("bucket", F.pmod(F.xxhash64(*self.keys), F.lit(self.buckets)).cast("int"))

    def stored(self) -> DataFrame:
        jvm, fs = _fs(self.spark, self.root)
        if not fs.exists(jvm.org.apache.hadoop.fs.Path(self.root)):
            return self.spark.createDataFrame([], self.schema + ", bucket int").where("false")  # the planner sees that it is empty and joins nothing with it
        return self.spark.read.schema(self.schema + ", bucket int").parquet(self.root)

    def read(self) -> DataFrame:
        return self.stored().drop("bucket")

    def merge(self, fresh: DataFrame, combine) -> list[int]:
        """Stores ``combine(stored rows of the touched buckets, fresh)`` in place of these rows; returns the buckets."""
        fresh = cut_lineage(fresh)
        touched = sorted(r["bucket"] for r in self.dealt(fresh).select("bucket").distinct().collect())  # ``buckets`` numbers at most
        if touched:
            stored = self.stored().where(F.col("bucket").isin(touched)).drop("bucket")
            rows = self.dealt(cut_lineage(combine(stored, fresh)))
            part = F.pmod(F.shiftright(F.xxhash64(*self.keys), 32), F.lit(SLICES))
            rows.repartition("bucket", part).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("bucket").parquet(self.root)
        return touched


def replace_users(stored: DataFrame, fresh: DataFrame, key: str = "user_id") -> DataFrame:
    """Delete-then-insert of whole users: rows of users in ``fresh`` are replaced."""
    return stored.join(fresh.select(key).distinct(), key, "left_anti").unionByName(fresh, allowMissingColumns=True)


def user_bucket(key: str, buckets: int):
    return F.pmod(F.xxhash64(key), F.lit(buckets)).cast("int")


def write_user_buckets(df: DataFrame, path: str, buckets: int = 256, key: str = "user_id") -> None:
    """Write rows partitioned by a hash of the user; only the buckets of users in ``df`` are overwritten."""
    bucketed = df.withColumn("user_bucket", user_bucket(key, buckets))
    # one task a bucket keeps the files few; a bucket is cut further by user where it is large
    bucketed.repartition("user_bucket", key).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("user_bucket").parquet(path)


def replace_stored_users(spark, path: str, fresh: DataFrame, buckets: int = 256, key: str = "user_id") -> None:
    """Replace the stored rows of the users in ``fresh`` and keep all others; only touched buckets are read and written.

    The new content of the buckets is checkpointed before they are overwritten, so a failed write can be repeated.
    """
    touched = fresh.select(user_bucket(key, buckets).alias("user_bucket")).distinct()
    stored = spark.read.parquet(path).join(touched, "user_bucket", "left_semi").drop("user_bucket")
    write_user_buckets(cut_lineage(replace_users(stored, fresh)), path, buckets, key)
