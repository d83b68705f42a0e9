"""Near documents by SpotSigs: sets of signatures, dealt by set length and compared through pruned Jaccard.

Sets whose sizes differ too much never meet: a set stands in the band of its length and visits the next one. Inside a band only the
rarest signatures of a set, as many as a partner cannot miss, make it a candidate. How frequent a signature is comes from a fixed number of
counters over all documents; they only set the order, so a coarse count costs time and never a link.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from showgrid.llm.buckets import bucket_blocks
from showgrid.llm.common import cut_lineage, documents, group_bounds, sorted_groups
from showgrid.llm.ngrams import overlaps
from showgrid.llm.queries import query
from showgrid.llm.spotsigs import digest, edited_fingerprints, signature_sets

COUNTERS = 1 << 16  # counters of signatures: bounded, whatever the corpus
BANDS = 1 << 16  # numbers kept for bands in a bucket key
BLOCK, BLOCK_SIGS = 256, 400_000
BLOCK_KEYS = ["bucket", "part_a", "part_b"]
MORE = 4  # signatures beyond the needed ones, by which sets that meet others by chance are told
SMALL_ROWS = 500_000  # narrow tables up to this many rows are sent to all tasks, longer ones are joined by a shuffle


def prints_and_counts(docs: DataFrame) -> DataFrame:
    """(doc_id, d1, d2, n, counts): two halves of the digest and the size of every set; a row of counters more from every task."""

    def run(batches):
        seen = np.zeros(COUNTERS, np.int64)
        for b in batches:
            sets = signature_sets(b.column("text").to_pylist())
            if not sets:
                continue
            seen += np.bincount(np.concatenate(sets) & np.uint32(COUNTERS - 1), minlength=COUNTERS)
            halves = np.array([digest(s) for s in sets], np.int64)
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(halves[:, 0]), pa.array(halves[:, 1]), pa.array([len(s) for s in sets], pa.int32()),
                                              pa.nulls(len(sets), pa.list_(pa.int32()))], names=["doc_id", "d1", "d2", "n", "counts"])
        if seen.any():
            seen = np.minimum(seen, 2**31 - 1)
            none = pa.nulls(1, pa.int64())
            yield pa.RecordBatch.from_arrays([none, none, none, pa.nulls(1, pa.int32()), pa.array([seen], pa.list_(pa.int32()))],
                                             names=["doc_id", "d1", "d2", "n", "counts"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, d1 long, d2 long, n int, counts array<int>")


def levels(prints: DataFrame) -> np.ndarray:
    """Power of two of every counter. ``COUNTERS`` rows reach the driver, whatever the number of documents."""
    total = prints.where("counts is not null").select(F.posexplode("counts").alias("at", "c")).groupBy("at").agg(F.sum("c").alias("c")).toArrow()
    out = np.zeros(COUNTERS, np.uint8)
    out[total.column("at").to_numpy()] = np.log2(total.column("c").to_numpy() + 1.0)
    return out


def ordered_sets(docs: DataFrame, level: np.ndarray) -> DataFrame:
    """(doc_id, d1, d2, n, sigs array<int>) of the documents with signatures, the rarest signatures first."""

    def run(batches):
        for b in batches:
            for part in (b.slice(i, 512) for i in range(0, b.num_rows, 512)):
                ids, halves, sets = [], [], []
                for doc, s in zip(part.column("doc_id").to_pylist(), signature_sets(part.column("text").to_pylist())):
                    if len(s):
                        ids.append(doc)
                        halves.append(digest(s))
                        sets.append(s[np.argsort(level[s & np.uint32(COUNTERS - 1)], kind="stable")])
                if ids:
                    d = np.array(halves, np.int64)
                    at = np.concatenate([[0], np.cumsum([len(s) for s in sets])]).astype(np.int32)
                    yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(d[:, 0]), pa.array(d[:, 1]), pa.array(np.diff(at)),
                                                      pa.ListArray.from_arrays(pa.array(at), pa.array(np.concatenate(sets).view(np.int32)))],
                                                     names=["doc_id", "d1", "d2", "n", "sigs"])

    return docs.where("doc_id is not null").select("doc_id", "text").mapInArrow(run, "doc_id long, d1 long, d2 long, n int, sigs array<int>")


def needed(n: Column, threshold: float) -> Column:
    """Signatures of a set of ``n`` of which a partner holds at least one."""
    return (n - F.ceil(n * F.lit(threshold) - 1e-9) + 1).cast("int")


def by_size(df: DataFrame) -> DataFrame:
    """The table with a broadcast hint where its counted rows are few; any other is left to the planner."""
    return F.broadcast(df) if df.count() <= SMALL_ROWS else df


def band_of(n: Column, threshold: float) -> Column:
    """Partners are in the same band of set length or in neighbouring ones."""
    return F.floor(F.log(n.cast("double")) / F.lit(-float(np.log(threshold))) + 1e-9).cast("int")


def block_counts(table: pa.Table, threshold: float) -> list[tuple[np.ndarray, np.ndarray]]:
    """(ids, partners) of the pairs that meet first in the blocks of ``table`` and are near enough."""
    bounds = group_bounds(table, BLOCK_KEYS)
    ids, copies, home, need = (table.column(c).to_numpy(zero_copy_only=False) for c in ("cid", "copies", "home", "need"))
    part, part_a, part_b, bucket = (table.column(c).to_numpy() for c in ("part", *BLOCK_KEYS[1:], "bucket"))
    sets = table.column("sigs").combine_chunks()
    flat, at = sets.values.to_numpy().view(np.uint32), sets.offsets.to_numpy()
    out = []
    for lo, hi in zip(bounds[:-1], bounds[1:]):
        one = part_a[lo] == part_b[lo]
        a = np.arange(hi - lo) if one else np.flatnonzero(part[lo:hi] == part_a[lo])
        b = a if one else np.flatnonzero(part[lo:hi] == part_b[lo])
        if hi - lo < 2 or not len(a) or not len(b):
            continue
        size, sigs = np.diff(at[lo : hi + 1]), flat[at[lo] : at[hi]]
        long, short = np.maximum(size[a][:, None], size[b][None, :]), np.minimum(size[a][:, None], size[b][None, :])
        near = (short >= threshold * long - 1e-9) & (home[lo:hi][a][:, None] | home[lo:hi][b][None, :])
        if one:
            near &= a[:, None] < b[None, :]
        if not near.any():
            continue
        both = overlaps(sigs, size, a, b)
        near &= both >= threshold * (long + short - both) - 1e-9
        if not near.any():
            continue
        # a pair counts at the smallest signature that makes both candidates
        place = np.arange(len(sigs)) - np.repeat(at[lo:hi] - at[lo], size)
        before = (place < np.repeat(need[lo:hi], size)) & (sigs < np.uint32(bucket[lo] // BANDS))
        if before.any():
            row = np.repeat(np.arange(hi - lo), size)[before]
            near &= overlaps(sigs[before], np.bincount(row, minlength=hi - lo), a, b) == 0
        i, j = np.nonzero(near)
        i, j = a[i] + lo, b[j] + lo
        out.append((np.concatenate([ids[i], ids[j]]), np.concatenate([copies[j], copies[i]])))
    return out


def near_documents(docs: DataFrame, threshold: float = 0.8, block: int = BLOCK) -> DataFrame:
    """(doc_id, d1, d2, class_id, n_near) for every row with an id and at least one signature.

    Equal sets are one class, named by its smallest doc_id; ``n_near`` counts the other rows whose sets have a Jaccard similarity of ``threshold``
    or more, those of the class included, repeated rows too. ``d1`` and ``d2`` are the digest of the set, for rows that share a doc_id. Null and empty
    texts, texts without words and null ids give no row and link with nothing; an empty table has no rows. Very long texts only make large sets.

    Sets that share too few of their rarest signatures with any other are left out first. Signatures that make the same sets meet in a band are one bucket. Pairs are compared inside blocks and counted, never emitted.
    """
    tasks = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    prints = cut_lineage(prints_and_counts(docs))
    sets = ordered_sets(docs, levels(prints))
    known = prints.where("n > 0 and doc_id is not null").select("doc_id", "d1", "d2")
    classes = cut_lineage(known.groupBy("d1", "d2").agg(F.min("doc_id").alias("doc_id"), F.count(F.lit(1)).alias("copies")).withColumn("cid", F.monotonically_increasing_id()))
    key = ["doc_id", "d1", "d2"]
    need, more = needed(F.col("n"), threshold), F.least(F.col("n"), needed(F.col("n"), threshold) + MORE)
    rare = sets.select(*key, "n", F.slice("sigs", F.lit(1), more).alias("rare"))
    heads = cut_lineage(rare.join(classes, key).dropDuplicates(key).select("cid", "n", "rare"))
    members = heads.select("cid", "n", F.posexplode("rare").alias("place", "sig"))
    shared = cut_lineage(members.groupBy("sig").agg(F.count(F.lit(1)).alias("c")).where("c > 1").select("sig"))
    found = members.join(by_size(shared), "sig")
    # a set with a near partner shares all of its rarest signatures but need - 1
    likely = cut_lineage(found.groupBy("cid", "n").agg(F.count(F.lit(1)).alias("c")).where(F.col("c") > more - need).select("cid"))
    likely = by_size(likely)
    band = band_of(F.col("n"), threshold)
    stands = found.where(F.col("place") < need).join(likely, "cid").select("cid", "n", "sig", F.explode(F.array(
        F.struct(band.alias("band"), F.lit(True).alias("home")), F.struct((band + 1).alias("band"), F.lit(False).alias("home")))).alias("at"))
    stands = stands.select("cid", "n", (F.pmod(F.col("sig").cast("long"), F.lit(1 << 32)) * BANDS + F.col("at.band")).alias("bucket"), "at.home")
    kinds = stands.groupBy("bucket").agg(F.count(F.lit(1)).alias("c"), F.max("home").alias("homes"), F.bit_xor(F.xxhash64("cid")).alias("x"),
                                         F.bit_xor(F.xxhash64("cid", F.lit(7))).alias("y")).where("c > 1 and homes")
    first = kinds.groupBy(F.pmod("bucket", F.lit(BANDS)), "c", "x", "y").agg(F.min("bucket").alias("bucket")).select("bucket")
    chosen = cut_lineage(stands.join(first, "bucket").select("cid", "bucket", "home", F.col("n").alias("weight")))
    blocks = bucket_blocks(chosen, "cid", block, BLOCK_SIGS)
    meeting = by_size(cut_lineage(chosen.select("cid").distinct().join(classes, "cid")))
    full = sets.join(meeting, key).dropDuplicates(key).select("cid", "copies", "n", "sigs", band.alias("band"), need.alias("need"))
    dealt = blocks.join(full, "cid").withColumn("home", F.pmod("bucket", F.lit(BANDS)) == F.col("band")).drop("band", "n")
    dealt = dealt.repartition(tasks, *BLOCK_KEYS).sortWithinPartitions(*BLOCK_KEYS)

    def verify(batches):
        for table in sorted_groups(batches, BLOCK_KEYS):
            found = block_counts(table, threshold)
            if found:
                name, at = np.unique(np.concatenate([f[0] for f in found]), return_inverse=True)
                links = np.bincount(at, weights=np.concatenate([f[1] for f in found])).astype(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(name), pa.array(links)], names=["cid", "links"])

    links = dealt.mapInArrow(verify, "cid long, links long").groupBy("cid").agg(F.sum("links").alias("links"))
    named = classes.join(links, "cid", "left").select("d1", "d2", F.col("doc_id").alias("class_id"), (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_near"))
    return known.join(named, ["d1", "d2"]).select("doc_id", "d1", "d2", "class_id", "n_near")


@query("op8_spotsigs")
def op8(spark, folder):
    """Fingerprints and likenesses of all documents, with the class and the number of near documents at a similarity of 0.8."""
    docs = documents(spark, folder)
    return edited_fingerprints(docs, near_documents(docs))
