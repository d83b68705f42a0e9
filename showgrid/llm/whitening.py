"""Embedding whitening: principal components of all vectors by FEAST, and every vector on them with unit variance.

Spark adds up sums and centred products over all vectors; the matrix that comes out grows with the dimension only. Its spectrum is cut into
intervals by inertia counts, and each interval is a task of its own.
"""

from __future__ import annotations

from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from showgrid.llm import feast
from showgrid.llm.common import cut_lineage
from showgrid.llm.queries import query

SCALE, SHIFT, COMPONENTS = 64, 1_000_000, 32
#: Entries are kept within whole numbers of 48 bits, so that no sum of a batch leaves 64.
FARTHEST = 2.0**48
#: Components below this share of the largest variance are rounding errors of no variance at all.
LEAST = 1e-12
ROWS = "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double"


def usable(vectors: DataFrame) -> DataFrame:
    """(vec_id, embedding array<double>) of rows whose vector is not null and holds no null and no non-finite entry."""
    e = F.transform("embedding", lambda x: x.cast("double"))
    bad = F.exists("embedding", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return vectors.where(F.col("embedding").isNotNull() & ~F.coalesce(bad, F.lit(False))).select(F.col("vec_id").cast("long").alias("vec_id"), e.alias("embedding"))


def matrix(column: pa.ListArray) -> np.ndarray:
    """Rows of equal length as whole numbers: floor(64 c) + 1000000; what is beyond ``FARTHEST`` counts as that."""
    return np.clip(np.floor(SCALE * column.flatten().to_numpy().reshape(len(column), -1)), -FARTHEST, FARTHEST).astype(np.int64) + SHIFT


def added(vectors: DataFrame, of_batch, width: int) -> np.ndarray:
    """Sum over all batches of an array of ``width`` numbers; one row a number and task is shuffled."""

    def run(batches):
        total = None
        for b in batches:
            part = of_batch(b)
            total = part if total is None else total + part
        if total is not None:
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(width)), pa.array(total.ravel())], names=["i", "x"])

    rows = vectors.mapInArrow(run, "i long, x double").groupBy("i").agg(F.sum("x").alias("x")).collect()
    out = np.zeros(width)
    for r in rows:
        out[r["i"]] = r["x"]
    return out


def sums(vectors: DataFrame, dim: int) -> tuple[int, np.ndarray]:
    """Number of vectors and exact sum of each dimension."""

    def run(batches):
        total = [0] * (dim + 1)
        for b in batches:
            total = [a + int(c) for a, c in zip(total, np.append(matrix(b.column("embedding")).sum(axis=0), b.num_rows))]
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(dim + 1)), pa.array([Decimal(c) for c in total], pa.decimal128(28, 0))], names=["i", "x"])

    rows = vectors.select("embedding").mapInArrow(run, "i long, x decimal(28,0)").groupBy("i").agg(F.sum("x").alias("x")).collect()
    got = {r["i"]: int(r["x"]) for r in rows}
    return got.get(dim, 0), np.array([got.get(i, 0) for i in range(dim)], object)


def parted(n: int, total: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Whole part of the mean and the rest of the sum."""
    middle = total // n
    return middle.astype(np.int64), (total - n * middle).astype(np.int64)


def covariance(vectors: DataFrame, n: int, total: np.ndarray) -> np.ndarray:
    """Covariance with divisor n. Vectors are centred on the whole part of the mean before they are multiplied, so the products are whole
    numbers and their sums exact below 2**53, in any order; the fractions of the mean are taken off at the end."""
    dim, (middle, rest) = len(total), parted(n, total)

    def products(b):
        y = (matrix(b.column("embedding")) - middle).astype(float)
        return y.T @ y

    return (added(vectors.select("embedding"), products, dim * dim).reshape(dim, dim) - np.outer(rest, rest.astype(float)) / n) / n


def components(spark: SparkSession, v: np.ndarray, wanted: int) -> tuple[np.ndarray, np.ndarray]:
    """The largest eigenvalues of ``v``, falling, and unit eigenvectors as columns, largest entry positive. Each interval of the spectrum is a task."""
    dim = len(v)
    parts = feast.intervals(v, min(wanted, dim))
    if not parts:
        return np.zeros(0), np.zeros((dim, 0))
    shared = spark.sparkContext.broadcast(v)

    def run(batches):
        for b in batches:
            for low, high, count in zip(*(b.column(i).to_pylist() for i in range(3))):
                e, u = feast.eigenpairs(shared.value, low, high, count)
                yield pa.RecordBatch.from_arrays([pa.array(e), pa.array(list(u.T), pa.list_(pa.float64()))], names=["e", "u"])

    rows = spark.createDataFrame(parts, "low double, high double, count long").repartition(len(parts)).mapInArrow(run, "e double, u array<double>").collect()
    rows = sorted(rows, key=lambda r: -r["e"])  # as many as the matrix has columns at most
    if len(rows) != sum(p[2] for p in parts) or len(rows) < min(wanted, dim):
        raise ArithmeticError("an eigenvalue is missed")
    rows = [r for r in rows if r["e"] > LEAST * rows[0]["e"]][:wanted]
    e, u = np.array([r["e"] for r in rows]), np.array([r["u"] for r in rows]).reshape(len(rows), dim).T
    return e, u * np.sign(u[np.abs(u).argmax(axis=0), np.arange(u.shape[1])])


def whitened(vectors: DataFrame, wanted: int = COMPONENTS) -> DataFrame:
    """One row for each usable vector and component, see ``ROWS``; vectors that are not usable are left out.

    Repeated rows count as often as they stand. Vectors of different lengths share no dimensions: each length is fitted apart. A component without variance
    (equal vectors, fewer vectors than dimensions) can't have unit variance and is left out, so a table of equal vectors and an empty table
    give no rows. ``deviation`` is null where it does not fit into a long. Entries beyond ``FARTHEST / 64`` count as that. Other columns play no part.
    """
    spark, ok = vectors.sparkSession, usable(vectors)
    ok = cut_lineage(ok.withColumn("dim", F.size("embedding")))
    lengths = sorted(r["dim"] for r in ok.select("dim").distinct().collect() if r["dim"])  # a row for each length
    parts = [whitened_of_length(spark, ok.where(F.col("dim") == d).select("vec_id", "embedding"), d, wanted) for d in lengths]
    out = parts[0] if parts else spark.createDataFrame([], ROWS)
    for p in parts[1:]:
        out = out.union(p)
    return out


def whitened_of_length(spark: SparkSession, vectors: DataFrame, dim: int, wanted: int) -> DataFrame:
    n, total = sums(vectors, dim)
    v = covariance(vectors, n, total)
    e, u = components(spark, v, wanted)
    k = len(e)
    if not k:
        return spark.createDataFrame([], ROWS)
    project, trace = u / np.sqrt(e), float(np.trace(v))
    middle, rest = parted(n, total)

    def scores(b):
        y = matrix(b.column("embedding")) - middle
        return y, (y - rest / n) @ project

    def products(b):
        _, z = scores(b)
        return np.append(z.T @ z, z.sum(axis=0))

    found = added(vectors.select("embedding"), products, k * k + k)
    mean = found[k * k :] / n
    error = float(np.abs(found[: k * k].reshape(k, k) / n - np.outer(mean, mean) - np.eye(k)).max())

    def run(batches):
        for b in batches:
            y, z = scores(b)
            away = n * y - rest
            fits = (np.square(n * y.astype(float) - rest).sum(axis=1) < 9.2e18) & (np.abs(y).max(axis=1) < 2.0**62 / n)
            deviation = pa.array(np.square(away).sum(axis=1), mask=~fits)
            row, comp = np.repeat(np.arange(len(y)), k), np.tile(np.arange(k), len(y))
            yield pa.RecordBatch.from_arrays(
                [b.column("vec_id").take(pa.array(row)), pa.array((comp + 1).astype(np.int32)), pa.array(np.full(len(row), n)), deviation.take(pa.array(row)),
                 pa.array(z.ravel()), pa.array((e / trace)[comp]), pa.array(np.full(len(row), error))],
                names=["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"])

    return vectors.mapInArrow(run, ROWS)


@query("op13_whitening")
def op13(spark, folder):
    return whitened(spark.read.parquet(f"{folder}/embeddings.parquet"))
