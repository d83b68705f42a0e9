"""N-gram Jaccard join by MinHash banding.

The words of a text give a set of hashed n-grams. MinHash values are grouped into bands; documents that agree on all rows of a
band meet in its bucket, and every pair that meets is verified on the full sets. The numbers of bands and rows follow from
the similarity and the recall that are asked for.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from showgrid.llm.buckets import bucket_blocks
from showgrid.llm.common import cut_lineage, documents, gram_hashes, group_bounds, list_rows, mix64, sorted_groups, word_array
from showgrid.llm.components import connected_components
from showgrid.llm.queries import query
from showgrid.llm.vectors import BLOCK_KEYS, LINKS, link_rows

WORDS, THRESHOLD, RECALL = 5, 0.8, 0.99
#: A similarity of unrelated texts, and the part of such pairs that may meet in a bucket.
FAR, FAR_SHARE = 0.4, 0.05
#: Documents and n-grams of a part of a bucket.
BLOCK, BLOCK_GRAMS = 256, 400_000
SEED = 11


def bands_and_rows(threshold: float = THRESHOLD, recall: float = RECALL) -> tuple[int, int]:
    """Fewest hash values with which a pair at the threshold meets with the chance ``recall`` and few far pairs do."""
    best = None
    for rows in range(2, 33):
        bands = math.ceil(math.log(1 - recall) / math.log(1 - threshold**rows))
        if 1 - (1 - FAR**rows) ** bands <= FAR_SHARE and (best is None or bands * rows < best[0] * best[1]):
            best = bands, rows
    return best or (math.ceil(math.log(1 - recall) / math.log(1 - threshold**32)), 32)


def gram_set(words: np.ndarray, n: int = WORDS) -> np.ndarray:
    """Sorted distinct hashes of the n-grams of hashed words; a shorter text that has words is one gram."""
    if len(words) == 0:
        return np.zeros(0, np.uint64)
    return np.unique(gram_hashes(words, n if len(words) >= n else len(words)))


def seeds(count: int) -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng(SEED)
    return rng.integers(1, 2**63, count, dtype=np.uint64) * np.uint64(2) + np.uint64(1), rng.integers(0, 2**63, count, dtype=np.uint64)


def band_keys(grams: np.ndarray, bands: int, rows: int, mult: np.ndarray, add: np.ndarray) -> np.ndarray:
    """Key of each band: hashes of the minima of ``rows`` random functions on the set, upper halves of a product."""
    low = np.full(bands * rows, np.iinfo(np.uint32).max, np.uint32)
    for s in range(0, len(grams), 4096):
        values = (grams[None, s : s + 4096] * mult[:, None] + add[:, None]) >> np.uint64(32)
        low = np.minimum(low, values.min(axis=1).astype(np.uint32))
    low = low.astype(np.uint64).reshape(bands, rows)
    key = mix64(np.arange(bands, dtype=np.uint64) + np.uint64(77))
    for i in range(rows):
        key = mix64(key * np.uint64(0x9E3779B97F4A7C15) + low[:, i])
    return key.view(np.int64)


def hashed_words(docs: DataFrame) -> DataFrame:
    """(doc_id, words array<long>): 64-bit hashes of the words."""
    return docs.select("doc_id", F.transform(word_array(F.col("text")), lambda w: F.xxhash64(w)).alias("words"))


def signatures(docs: DataFrame, bands: int, rows: int, n: int = WORDS) -> DataFrame:
    """(doc_id, s1, s2, grams, keys): two digests of the n-gram set, its size, and the band keys."""

    def run(batches):
        mult, add = seeds(bands * rows)
        for b in batches:
            out = []
            for w in list_rows(b.column("words")):
                g = gram_set(w.view(np.uint64), n)
                both = (int(mix64(g).sum(dtype=np.uint64)), int(mix64(g ^ np.uint64(0x5BD1E9955BD1E995)).sum(dtype=np.uint64)))
                out.append((*both, len(g), band_keys(g, bands, rows, mult, add) if len(g) else np.zeros(bands, np.int64)))
            at = pa.array(np.arange(len(out) + 1) * bands, pa.int32())
            keys = np.concatenate([o[3] for o in out]) if out else np.zeros(0, np.int64)
            digest = [pa.array(np.array([o[i] for o in out], np.uint64).view(np.int64)) for i in (0, 1)]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), *digest, pa.array([o[2] for o in out], pa.int32()), pa.ListArray.from_arrays(at, pa.array(keys))],
                                             names=["doc_id", "s1", "s2", "grams", "keys"])

    return hashed_words(docs).mapInArrow(run, "doc_id long, s1 long, s2 long, grams int, keys array<long>")


def meeting(batches):
    """Rows (id and block keys) of documents that meet another one here first: in no band before do the two agree."""
    for table in sorted_groups(batches, BLOCK_KEYS):
        bounds = group_bounds(table, BLOCK_KEYS)
        part, part_a, part_b, bucket = (table.column(c).to_numpy() for c in ("part", "part_a", "part_b", "bucket"))
        keys = table.column("keys").combine_chunks()
        flat, at = keys.values.to_numpy(), keys.offsets.to_numpy()
        take = []
        for lo, hi in zip(bounds[:-1], bounds[1:]):
            if hi - lo < 2:
                continue
            k = flat[at[lo] : at[hi]].reshape(hi - lo, -1)
            one = part_a[lo] == part_b[lo]
            a = np.arange(hi - lo) if one else np.flatnonzero(part[lo:hi] == part_a[lo])
            b = a if one else np.flatnonzero(part[lo:hi] == part_b[lo])
            if not len(a) or not len(b):
                continue
            band = int(np.flatnonzero(k[0] == bucket[lo])[0])
            earlier = np.zeros((len(a), len(b)), bool)
            for t in range(band):
                earlier |= k[a, t][:, None] == k[b, t][None, :]
            new = ~earlier
            if one:
                np.fill_diagonal(new, False)
            hit = np.zeros(hi - lo, bool)
            hit[a[new.any(axis=1)]] = True
            hit[b[new.any(axis=0)]] = True
            take.append(np.flatnonzero(hit) + lo)
        if take:
            yield from table.select(["id", *BLOCK_KEYS, "part", "keys"]).take(pa.array(np.concatenate(take))).to_batches()


def block_links(table: pa.Table, threshold: float) -> list[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """Pairs of one table of blocks that meet here first and whose sets are similar enough."""
    bounds = group_bounds(table, BLOCK_KEYS)
    ids, copies = table.column("id").to_numpy(), table.column("copies").to_numpy()
    part, part_a, part_b, bucket = (table.column(c).to_numpy() for c in ("part", "part_a", "part_b", "bucket"))
    keys = table.column("keys").combine_chunks()
    flat, at = keys.values.to_numpy(), keys.offsets.to_numpy()
    grams = table.column("set").combine_chunks()
    g_flat, g_at = grams.values.to_numpy(), grams.offsets.to_numpy()
    out = []
    for lo, hi in zip(bounds[:-1], bounds[1:]):
        if hi - lo < 2:
            continue
        one = part_a[lo] == part_b[lo]
        a = np.arange(hi - lo) if one else np.flatnonzero(part[lo:hi] == part_a[lo])
        b = a if one else np.flatnonzero(part[lo:hi] == part_b[lo])
        if not len(a) or not len(b):
            continue
        size = np.diff(g_at[lo : hi + 1])
        if hi - lo == 2:
            both = np.array([[0, len(np.intersect1d(g_flat[g_at[lo] : g_at[lo + 1]], g_flat[g_at[lo + 1] : g_at[hi]], assume_unique=True))]])
            a, b = (np.array([0]), np.array([0, 1])) if one else (a, b)
            both = both if one else both[:, 1:]
        else:
            both = overlaps(g_flat[g_at[lo] : g_at[hi]], size, a, b)
        total = size[a][:, None] + size[b][None, :] - both
        near = (both >= threshold * total - 1e-9) & (total > 0)
        if one:
            near &= a[:, None] < b[None, :]
        i, j = np.nonzero(near)
        i, j = a[i], b[j]
        if not len(i):
            continue
        k = flat[at[lo] : at[hi]].reshape(hi - lo, -1)
        first = np.ones(len(i), bool)
        for s in range(0, len(i), 8192):
            same = k[i[s : s + 8192]] == k[j[s : s + 8192]]
            first[s : s + 8192] = k[i[s : s + 8192], same.argmax(axis=1)] == bucket[lo]
        i, j = i[first] + lo, j[first] + lo
        if len(i):
            out.append((ids[i], ids[j], copies[i], copies[j]))
    return out


def overlaps(grams: np.ndarray, size: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Sizes of the intersections of the sets of rows ``a`` with those of rows ``b``.

    Grams are numbered, and incidence matrices of some thousand grams at a time are multiplied, so memory does not follow the size
    of the sets. Grams of a single set add nothing and are left out.
    """
    name, number, count = np.unique(grams, return_inverse=True, return_counts=True)
    row = np.repeat(np.arange(len(size)), size)
    shared = count[number] > 1
    row, number = row[shared], number[shared]
    _, number = np.unique(number, return_inverse=True)
    order = np.argsort(number, kind="stable")
    row, number = row[order], number[order]
    both = np.zeros((len(size), len(size)) if a is b else (len(a), len(b)), np.float32)
    place_a, place_b = np.full(len(size), -1), np.full(len(size), -1)
    place_a[a], place_b[b] = np.arange(len(a)), np.arange(len(b))
    width = 4096
    ends = np.searchsorted(number, np.arange(0, (number[-1] if len(number) else 0) + width + 1, width))
    for k, (lo, hi) in enumerate(zip(ends[:-1], ends[1:])):
        r, c = row[lo:hi], number[lo:hi] - k * width
        left = np.zeros((len(a), width), np.float32)
        ok = place_a[r] >= 0
        left[place_a[r[ok]], c[ok]] = 1
        if a is b:
            both += left @ left.T
        else:
            right = np.zeros((len(b), width), np.float32)
            ok = place_b[r] >= 0
            right[place_b[r[ok]], c[ok]] = 1
            both += left @ right.T
    return both.astype(np.int64)


def gram_sets(docs: DataFrame, n: int = WORDS) -> DataFrame:
    """(id, set array<long>): the full n-gram set of every document of ``docs``."""

    def run(batches):
        for b in batches:
            for part in (b.slice(i, 512) for i in range(0, b.num_rows, 512)):
                sets = [gram_set(w.view(np.uint64), n).view(np.int64) for w in list_rows(part.column("words"))]
                at = np.concatenate([[0], np.cumsum([len(s) for s in sets])]).astype(np.int32)
                flat = np.concatenate(sets) if sets else np.zeros(0, np.int64)
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.ListArray.from_arrays(pa.array(at), pa.array(flat))], names=["id", "set"])

    return hashed_words(docs).mapInArrow(run, "id long, set array<long>")


def jaccard_join(docs: DataFrame, threshold: float = THRESHOLD, recall: float = RECALL, n: int = WORDS) -> DataFrame:
    """doc_id, class_id, n_links, component_id, kept for every row of ``docs(doc_id, text)``.

    Texts with equal n-gram sets are one class, named by its smallest doc_id and found by a partial aggregate. ``n_links`` counts
    the other documents at ``threshold`` or above, those of the class included. Texts without words and null ids link with nothing. Pairs are
    counted inside a block and never emitted; a block gives one edge per member for the components.
    """
    spark = docs.sparkSession
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    bands, rows = bands_and_rows(threshold, recall)
    prints = cut_lineage(signatures(docs, bands, rows, n))
    classes = (prints.where("grams > 0 and doc_id is not null").groupBy("s1", "s2", "grams")
               .agg(F.min("doc_id").alias("id"), F.count(F.lit(1)).alias("copies")))
    classes = cut_lineage(classes)
    heads = (prints.withColumnRenamed("doc_id", "id").where("grams > 0")
             .join(classes, ["id", "s1", "s2", "grams"]).dropDuplicates(["id", "s1", "s2"]).select("id", "copies", "grams", "keys"))
    heads = cut_lineage(heads)
    members = heads.select("id", F.explode("keys").alias("bucket"), F.col("grams").alias("weight"))
    blocks = bucket_blocks(members, "id", BLOCK, BLOCK_GRAMS)
    dealt = blocks.join(heads.select("id", "keys"), "id").repartition(tasks, *BLOCK_KEYS).sortWithinPartitions(*BLOCK_KEYS)
    meet = cut_lineage(dealt.mapInArrow(meeting, "id long, bucket long, part_a int, part_b int, part int, keys array<long>"))
    wanted = meet.select("id").distinct().join(heads.select("id", "copies"), "id")
    sets = gram_sets(docs.select("doc_id", "text").where("doc_id is not null").join(wanted.select(F.col("id").alias("doc_id")), "doc_id", "left_semi"), n).dropDuplicates(["id"])
    with_sets = meet.join(sets.join(wanted, "id"), "id").repartition(tasks, *BLOCK_KEYS).sortWithinPartitions(*BLOCK_KEYS)

    def verify(batches):
        for table in sorted_groups(batches, BLOCK_KEYS):
            found = block_links(table, threshold)
            if found:
                yield link_rows(found)

    links = cut_lineage(with_sets.mapInArrow(verify, LINKS))
    parts = connected_components(links.where("other is not null"), "id", "other")
    counts = links.where("other is null").groupBy("id").agg(F.sum("links").alias("links"))
    of_class = cut_lineage(
        classes.join(counts, "id", "left").join(parts, "id", "left")
        .select("s1", "s2", "grams", F.col("id").alias("class_id"), (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"),
                F.coalesce("component", "id").alias("component_id")))
    known = (F.col("grams") > 0) & F.col("doc_id").isNotNull()
    linked = prints.where(known).select("doc_id", "s1", "s2", "grams").join(of_class, ["s1", "s2", "grams"]).select("doc_id", "class_id", "n_links", "component_id")
    rest = prints.where(~known).select("doc_id", F.col("doc_id").alias("class_id"), F.lit(0).cast("long").alias("n_links"), F.col("doc_id").alias("component_id"))
    return linked.union(rest).withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))


def one_of_each(docs: DataFrame, **options) -> DataFrame:
    """The documents that ``jaccard_join`` keeps, one of each group, with all columns.

    Rows that share a doc_id are one document and stay or go together; rows without one stay.
    """
    keep = jaccard_join(docs, **options).where("kept").select(F.col("doc_id").alias("kept_id")).distinct()
    return docs.join(keep, docs["doc_id"].eqNullSafe(keep["kept_id"]), "left_semi")


@query("op4_ngram_join")
def op4(spark, folder):
    return jaccard_join(documents(spark, folder).select("doc_id", "text"))
