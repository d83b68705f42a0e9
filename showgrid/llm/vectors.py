"""Near-duplicate embeddings by p-stable hashing.

A unit vector is projected on random Gaussian directions; a shifted projection, cut into steps of ``WIDTH``, is a hash that near
vectors share. ``DIRECTIONS`` of them make the key of one table, and there are as many tables as the target recall needs at
the threshold. Vectors that share a bucket in a table are compared by exact cosine.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from showgrid.llm.buckets import bucket_blocks
from showgrid.llm.common import cut_lineage, group_bounds, mix64, sorted_groups
from showgrid.llm.components import connected_components
from showgrid.llm.queries import query

THRESHOLD, RECALL = 0.93, 0.99
WIDTH, DIRECTIONS, SEED = 2.0, 16, 7
BLOCK = 512
BLOCK_KEYS = ["bucket", "part_a", "part_b"]


def collision(distance: float, width: float = WIDTH) -> float:
    """Chance that two points at a Euclidean distance share the step of one projection."""
    r = width / distance
    upper = 0.5 * math.erfc(r / math.sqrt(2))
    return 1 - 2 * upper - 2 / (math.sqrt(2 * math.pi) * r) * (1 - math.exp(-r * r / 2))


def tables_needed(threshold: float = THRESHOLD, recall: float = RECALL) -> int:
    """Tables after which a pair exactly at the threshold was in one bucket with the chance ``recall``."""
    same = collision(math.sqrt(max(2 - 2 * threshold, 1e-12))) ** DIRECTIONS
    return max(1, math.ceil(math.log(1 - recall) / math.log(1 - same)))


def projections(dim: int, tables: int) -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng([SEED, dim])
    return rng.standard_normal((dim, tables * DIRECTIONS)), rng.uniform(0, WIDTH, tables * DIRECTIONS)


def bucket_keys(unit: np.ndarray, labels: np.ndarray, tables: int) -> np.ndarray:
    """One 64-bit key per row and table; it holds table, label and dimension as well."""
    a, b = projections(unit.shape[1], tables)
    steps = np.floor((unit @ a + b) / WIDTH).astype(np.int64).view(np.uint64).reshape(len(unit), tables, DIRECTIONS)
    key = mix64(labels.astype(np.int64).view(np.uint64)[:, None] * np.uint64(1_000_003) + np.arange(tables, dtype=np.uint64)[None, :] * np.uint64(65_537) + np.uint64(unit.shape[1]))
    for i in range(DIRECTIONS):
        key = mix64(key * np.uint64(0x9E3779B97F4A7C15) + steps[:, :, i])
    return key.view(np.int64)


def is_usable() -> Column:
    """Label, id and vector not null, no component null or not finite, not all zero."""
    bad = F.exists("embedding", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return (F.col("label").isNotNull() & F.col("vec_id").isNotNull() & F.col("embedding").isNotNull() & (F.size("embedding") > 0) & ~bad
            & F.exists("embedding", lambda x: x != 0))


def usable(vectors: DataFrame) -> DataFrame:
    return vectors.where(is_usable())


def hashed(classes: DataFrame, tables: int) -> DataFrame:
    """(id, copies, k1, k2, unit array<double>, keys array<long>) of distinct vectors."""
    keep = ["id", "copies", "k1", "k2"]

    def run(batches):
        for b in batches:
            labels = b.column("label").to_numpy()
            column = b.column("embedding")
            flat, ends = column.values.to_numpy(zero_copy_only=False).astype(float), column.offsets.to_numpy()
            sizes = np.diff(ends)
            for dim in np.unique(sizes):  # vectors of other dimensions never share a key
                rows = np.flatnonzero(sizes == dim)
                x = flat[ends[rows][:, None] + np.arange(dim)[None, :]]
                x = x / np.abs(x).max(axis=1, keepdims=True)
                x /= np.linalg.norm(x, axis=1, keepdims=True)
                keys = bucket_keys(x, labels[rows], tables)
                at = np.arange(len(rows) + 1)
                yield pa.RecordBatch.from_arrays(
                    [*[b.column(c).take(pa.array(rows)) for c in keep], pa.ListArray.from_arrays(pa.array(at * dim, pa.int32()), pa.array(x.ravel())),
                     pa.ListArray.from_arrays(pa.array(at * tables, pa.int32()), pa.array(keys.ravel()))], names=[*keep, "unit", "keys"])

    return classes.select(*keep, "label", "embedding").mapInArrow(run, "id long, copies long, k1 long, k2 long, unit array<double>, keys array<long>")


def block_links(table: pa.Table, threshold: float) -> list[tuple[np.ndarray, np.ndarray]]:
    """Linked pairs of ids, each at the first table in which the two share a bucket."""
    bounds = group_bounds(table, BLOCK_KEYS)
    ids, copies = table.column("id").to_numpy(), table.column("copies").to_numpy()
    part, part_a, part_b, bucket = (table.column(c).to_numpy() for c in ("part", "part_a", "part_b", "bucket"))
    keys = table.column("keys").combine_chunks()
    key_flat, key_at = keys.values.to_numpy(), keys.offsets.to_numpy()
    unit = table.column("unit").combine_chunks()
    unit_flat, unit_at = unit.values.to_numpy(), unit.offsets.to_numpy()
    out = []
    for lo, hi in zip(bounds[:-1], bounds[1:]):
        if hi - lo < 2:
            continue
        k = key_flat[key_at[lo] : key_at[hi]].reshape(hi - lo, -1)
        x = unit_flat[unit_at[lo] : unit_at[hi]].reshape(hi - lo, -1)
        if part_a[lo] == part_b[lo]:
            i, j = np.nonzero(np.triu(x @ x.T >= threshold, 1))
        else:
            a, b = np.flatnonzero(part[lo:hi] == part_a[lo]), np.flatnonzero(part[lo:hi] == part_b[lo])
            if not len(a) or not len(b):
                continue
            i, j = np.nonzero(x[a] @ x[b].T >= threshold)
            i, j = a[i], b[j]
        if not len(i):
            continue
        first = np.ones(len(i), bool)
        for s in range(0, len(i), 8192):  # the key of this bucket has to be the first that the two share
            same = k[i[s : s + 8192]] == k[j[s : s + 8192]]
            first[s : s + 8192] = k[i[s : s + 8192], same.argmax(axis=1)] == bucket[lo]
        i, j = i[first] + lo, j[first] + lo
        if len(i):
            out.append((ids[i], ids[j], copies[i], copies[j]))
    return out


def forest(a: np.ndarray, b: np.ndarray) -> list[tuple[int, int]]:
    """Edges to the smallest id of each component of the pairs of one block; one per member instead of one per pair."""
    root: dict[int, int] = {}

    def find(x):
        while root.setdefault(x, x) != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    for x, y in zip(a.tolist(), b.tolist()):
        x, y = find(x), find(y)
        if x != y:
            root[max(x, y)] = min(x, y)
    return [(x, find(x)) for x in root if find(x) != x]


def link_rows(found: list[tuple]) -> pa.RecordBatch:
    """Rows (id, other, links): forest edges with links 0, and per id its number of links with other null."""
    ids, others, links = [], [], []
    for a, b, copies_a, copies_b in found:
        both, n = np.concatenate([a, b]), np.concatenate([copies_b, copies_a])
        name, at = np.unique(both, return_inverse=True)
        count = np.bincount(at, weights=n).astype(np.int64)
        tree = forest(a, b)
        ids += name.tolist() + [x for x, _ in tree]
        others += [None] * len(name) + [y for _, y in tree]
        links += count.tolist() + [0] * len(tree)
    return pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(others, pa.int64()), pa.array(links, pa.int64())], names=["id", "other", "links"])


LINKS = "id long, other long, links long"


def near_vectors(vectors: DataFrame, threshold: float = THRESHOLD, recall: float = RECALL) -> DataFrame:
    """vec_id, n_links, component_id, kept for every row of ``vectors(vec_id, embedding, label)``.

    Equal vectors with one label are one class, found by a grouping, so a hot vector is one row from there on. Vectors that
    are not usable, and all without links, are their own component. Repeated ids are counted as rows and share their
    component. Within a bucket pairs are counted where they are compared and never emitted. Of pairs at the threshold, ``recall`` are expected
    to be found, of nearer ones more; no pair below it links.
    """
    tables = tables_needed(threshold, recall)
    keyed = [F.xxhash64("label", "embedding").alias("k1"), F.xxhash64("embedding", "label", F.lit(SEED)).alias("k2")]
    ok = usable(vectors)
    good = ok.select("vec_id", "label", "embedding", *keyed)
    classes = good.groupBy("label", "embedding", "k1", "k2").agg(F.min("vec_id").alias("id"), F.count(F.lit(1)).alias("copies"))
    rows = cut_lineage(hashed(classes, tables))
    members = rows.select("id", F.explode("keys").alias("bucket"), F.lit(1).alias("weight"))
    blocks = bucket_blocks(members, "id", BLOCK, 1 << 40)
    n = int(vectors.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = blocks.join(rows.select("id", "copies", "unit", "keys"), "id").repartition(n, *BLOCK_KEYS).sortWithinPartitions(*BLOCK_KEYS)

    def verify(batches):
        for table in sorted_groups(batches, BLOCK_KEYS):
            found = block_links(table, threshold)
            if found:
                yield link_rows(found)

    links = cut_lineage(dealt.mapInArrow(verify, LINKS))
    parts = connected_components(links.where("other is not null"), "id", "other")
    counts = links.where("other is null").groupBy("id").agg(F.sum("links").alias("links"))
    of_class = cut_lineage(
        rows.select("id", "copies", "k1", "k2").join(counts, "id", "left").join(parts, "id", "left")
        .select("k1", "k2", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"), F.coalesce("component", "id").alias("component_id")))
    linked = good.select("vec_id", "k1", "k2").join(of_class, ["k1", "k2"]).select("vec_id", "n_links", "component_id")
    rest = vectors.where(~F.coalesce(is_usable(), F.lit(False))).select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return linked.union(rest).withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(False)))


@query("op3_vectors")
def op3(spark, folder):
    return near_vectors(spark.read.parquet(f"{folder}/embeddings.parquet"))
