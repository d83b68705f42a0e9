"""Small helpers shared by the training-data operators."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from showgrid.util import cut_lineage  # noqa: F401  (re-exported for the operators)

#: Word separators: space and tab to carriage return. A word is a maximal run of other characters.
SPACE = r"\x20\x09-\x0D"
WORD = rf"[^{SPACE}]+"


def documents(spark: SparkSession, folder: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/documents.parquet")


def word_array(text: Column) -> Column:
    """Words of a text; a null text has none."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), f"[{SPACE}]+"), lambda w: w != "")


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def mix64(h: np.ndarray) -> np.ndarray:
    """Bijective finalizer on uint64: spreads every input bit over all output bits."""
    h = h.copy()
    h ^= h >> np.uint64(33)
    h *= np.uint64(0xFF51AFD7ED558CCD)
    h ^= h >> np.uint64(33)
    h *= np.uint64(0xC4CEB9FE1A85EC53)
    h ^= h >> np.uint64(33)
    return h


def gram_hashes(tokens: np.ndarray, n: int) -> np.ndarray:
    """64-bit hashes of all runs of ``n`` consecutive 64-bit token hashes."""
    count = len(tokens) - n + 1
    if count <= 0:
        return np.zeros(0, np.uint64)
    out = np.zeros(count, np.uint64)
    for i in range(n):
        out = mix64(out * np.uint64(0x9E3779B97F4A7C15) + tokens[i : i + count] + np.uint64(i + 1))
    return out


def list_rows(column: pa.ListArray) -> Iterator[np.ndarray]:
    """Rows of a list column as numpy views, without a copy per row; a null row is empty."""
    flat = column.values.to_numpy(zero_copy_only=False)
    ends = column.offsets.to_numpy()
    for i in range(len(column)):
        yield flat[ends[i] : ends[i + 1]]


def sorted_groups(batches: Iterable[pa.RecordBatch], keys: list[str]) -> Iterator[pa.Table]:
    """Tables that hold whole groups, from batches sorted by ``keys``.

    The rows of the last group of a batch wait for the next batch, so memory is one batch and one group.
    """
    wait: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        last = [batch.column(k)[batch.num_rows - 1].as_py() for k in keys]
        same = np.ones(batch.num_rows, bool)
        for k, v in zip(keys, last):
            same &= batch.column(k).to_numpy(zero_copy_only=False) == v
        cut = batch.num_rows - int(same.sum())
        if cut:
            yield pa.Table.from_batches([*wait, batch.slice(0, cut)])
            wait = []
        wait.append(batch.slice(cut))
    if wait:
        yield pa.Table.from_batches(wait)


def group_bounds(table: pa.Table, keys: list[str]) -> np.ndarray:
    """Start of each group and the number of rows, for a table sorted by ``keys``."""
    n = table.num_rows
    new = np.zeros(n, bool)
    new[:1] = True
    for k in keys:
        v = table.column(k).to_numpy()
        new[1:] |= v[1:] != v[:-1]
    return np.append(np.flatnonzero(new), n)


def shared_folder(spark: SparkSession, name: str) -> str:
    """A new folder for written tables below ``spark.checkpoint.dir``; only a local session without that setting gets one of its own."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder shared by all executors")
        base = tempfile.mkdtemp(prefix="showgrid-tables-")
    return f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def remove(spark: SparkSession, path: str) -> None:
    """Takes away a written table that is no longer needed, in whatever store the path names."""
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)
