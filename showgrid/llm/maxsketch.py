"""Ranked lexical search by hashed max-sketches.

A term's impact on a document depends on both alone, so a score is a sum of impacts. The impacts of a document are folded into ``WIDTH``
cells by a hash of the term, each cell keeping its largest. The cells that the terms of an item fall into add up to a bound above the item's score; one
matrix product gives the bounds of many documents and items. Documents are scored exactly by falling bound until the bound is below the
score of the last place.
"""

from __future__ import annotations

import math
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from showgrid.llm.common import cut_lineage, documents, mix64
from showgrid.llm.queries import query
from showgrid.util import global_rank

TERM = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Bytes of UTF-8: separators become a space, A-Z lower case; bytes from 0x80 on belong to characters that are parts of terms.
FOLD = bytes(b if chr(b).isalnum() and b < 128 or b >= 128 else 32 for b in range(256)).lower()
TOP, WIDTH = 50, 1024
#: Items of a pass over the documents, documents bounded at a time, documents scored per item between two looks at the threshold, bytes of text at a time.
ITEMS, ROWS, STEP, CHUNK = 1024, 1024, 64, 1 << 21
MATCHES = "doc_id long, n long, terms array<int>, tf array<int>"
LAST = np.iinfo(np.int64).max


def item_terms(items: DataFrame) -> DataFrame:
    """(item_id, term), each once; rows that share an id, null included, are one item."""
    found = F.regexp_extract_all(F.translate("text", UPPER, LOWER), F.lit(TERM), F.lit(0))
    return items.select("item_id", F.explode(found).alias("term")).distinct()


def term_matches(docs: DataFrame, vocabulary: list[str]) -> DataFrame:
    """(doc_id, n, terms, tf) of every row: number of all terms, and the numbers and counts of those of the vocabulary."""
    number = docs.sparkSession.sparkContext.broadcast({t.encode(): i for i, t in enumerate(vocabulary)})
    size = max(len(vocabulary), 1)

    def counted(texts):
        codes, lengths = [], []
        get = number.value.get
        for t in texts:
            words = t.translate(FOLD).split() if t else []
            lengths.append(len(words))
            codes.extend(map(get, words, repeat(-1)))
        codes = np.array(codes, np.int64)
        row = np.repeat(np.arange(len(texts)), lengths)
        key, tf = np.unique((row * size + codes)[codes >= 0], return_counts=True)
        at = np.searchsorted(key // size, np.arange(len(texts) + 1)).astype(np.int32)
        lists = [pa.ListArray.from_arrays(pa.array(at), pa.array(v.astype(np.int32))) for v in (key % size, tf)]
        return [pa.array(np.array(lengths, np.int64)), *lists]

    def run(batches):
        for b in batches:
            texts = b.column(1).cast(pa.binary()).to_pylist()
            at, have = 0, 0
            for i, t in enumerate(texts):
                have += len(t or b"")
                if have >= CHUNK or i == len(texts) - 1:
                    yield pa.RecordBatch.from_arrays([b.column(0).slice(at, i + 1 - at), *counted(texts[at : i + 1])], names=["doc_id", "n", "terms", "tf"])
                    at, have = i + 1, 0

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, MATCHES)


def term_weights(matches: DataFrame, size: int) -> tuple[np.ndarray, int, int]:
    """Weight of each term of the vocabulary, documents with terms, and terms of all documents."""

    def count(batches):
        total = np.zeros(size, np.int64)
        for b in batches:
            total += np.bincount(b.column(0).flatten().to_numpy(), minlength=size)
        seen = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(seen), pa.array(total[seen])], names=["term", "df"])

    with_terms, length = matches.agg(F.count_if(F.col("n") > 0), F.coalesce(F.sum("n"), F.lit(0))).first()
    df = np.zeros(size, np.int64)
    for r in matches.select("terms").mapInArrow(count, "term long, df long").groupBy("term").agg(F.sum("df").alias("df")).collect():  # a row a term of the pass
        df[r["term"]] = r["df"]
    weights = [math.floor(1000 * math.log((2 * with_terms + 2) / (2 * int(d) + 1))) for d in df]
    return np.array(weights, np.int64), with_terms, length


def impacts(tf: np.ndarray, weight: np.ndarray, n: np.ndarray, with_terms: int, length: int) -> np.ndarray:
    m = 50 + (50 * n * with_terms) // max(length, 1)
    return weight * ((1_000_000_000 * tf) // (1000 * tf + 20 * m))


def cells(size: int, width: int) -> np.ndarray:
    return (mix64(np.arange(1, size + 1, dtype=np.uint64)) % np.uint64(width)).astype(np.int64)


class Best:
    """The ``top`` highest scores of each item, equal ones by ascending document, and the score of the last place (0 while there is room)."""

    def __init__(self, items: int, top: int):
        self.items, self.top = items, top
        self.item, self.score, self.doc = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)
        self.least = np.zeros(items, np.int64)

    def add(self, item, score, doc) -> None:
        some = score > 0
        item, score, doc = (np.concatenate([a, b[some]]) for a, b in ((self.item, item), (self.score, score), (self.doc, doc)))
        order = np.lexsort((doc, -score, item))
        item, score, doc = item[order], score[order], doc[order]
        begin = np.searchsorted(item, np.arange(self.items + 1))
        place = np.arange(len(item)) - begin[item]
        kept = place < self.top
        last = place == self.top - 1
        self.least[item[last]] = score[last]
        self.item, self.score, self.doc = item[kept], score[kept], doc[kept]


class Searcher:
    """Bounds and exact scores of a run of documents for the items of a pass."""

    def __init__(self, members: list[tuple[int, int]], items: int, weights: np.ndarray, with_terms: int, length: int, width: int):
        self.weights, self.with_terms, self.length, self.width = weights, with_terms, length, width
        self.cell = cells(len(weights), width)
        self.holds = np.zeros((items, len(weights)), bool)
        item, term = np.array(members, np.int64).reshape(-1, 2).T
        self.holds[item, term] = True
        self.lookup = np.zeros((width, items))
        np.add.at(self.lookup, (self.cell[term], item), 1.0)
        self.scored = 0

    def sketch(self, row: np.ndarray, term: np.ndarray, impact: np.ndarray, rows: int) -> np.ndarray:
        out = np.zeros((rows, self.width))
        np.maximum.at(out, (row, self.cell[term]), impact.astype(float))  # whole numbers below 2**53: exact
        return out

    def search(self, doc, n, at, term, tf, best: Best) -> None:
        rows = len(doc)
        size = np.diff(at)
        row = np.repeat(np.arange(rows), size)
        impact = impacts(tf, self.weights[term], n[row], self.with_terms, self.length)
        bound = self.sketch(row, term, impact, rows) @ self.lookup
        r, q = np.nonzero((bound > 0) & (bound >= best.least[None, :]))
        b = bound[r, q]
        order = np.lexsort((r, -b, q))
        r, q, b = r[order], q[order], b[order]
        begin = np.searchsorted(q, np.arange(best.items + 1))
        turn = (np.arange(len(q)) - begin[q]) // STEP
        for k in range(int(turn.max(initial=-1)) + 1):
            now = np.flatnonzero((turn == k) & (b >= best.least[q]))
            if not len(now):
                break  # bounds fall from turn to turn, so no item has a document left
            self.scored += len(now)
            best.add(q[now], self.exact(r[now], q[now], at, size, term, impact), doc[r[now]])

    def exact(self, r, q, at, size, term, impact) -> np.ndarray:
        out = np.zeros(len(r), np.int64)
        for lo in range(0, len(r), 4096):
            a, c, k = at[r[lo : lo + 4096]], size[r[lo : lo + 4096]], q[lo : lo + 4096]
            ends = np.cumsum(c)
            entry = np.arange(ends[-1]) + np.repeat(a - (ends - c), c)
            value = np.where(self.holds[np.repeat(k, c), term[entry]], impact[entry], 0)
            out[lo : lo + 4096] = np.add.reduceat(np.append(value, 0), np.minimum(ends - c, len(value))) * (c > 0)
        return out


def ranked(docs: DataFrame, items: DataFrame, top: int = TOP, width: int = WIDTH, items_per_pass: int = ITEMS) -> DataFrame:
    """(item_id, rank, doc_id, score): the ``top`` documents with the highest score above 0 for each item.

    Null and empty texts have no terms: such documents only fail to match, such items get no rows. Rows of ``docs`` that share a doc_id are documents of their
    own, a null doc_id comes after all others among equal scores. Very long texts are whole rows. Rows of ``items`` that share an id are one item. Other columns
    play no part. Items are taken ``items_per_pass`` at a time, so vocabulary and matrices of a pass are bounded whatever the number of
    items; each pass reads the texts once, and a task hands on ``top`` rows an item at most.
    """
    numbered = cut_lineage(with_numbers(item_terms(items)))
    passes = numbered.agg(F.max("no")).first()[0]
    parts = [ranked_pass(docs, numbered.where((F.col("no") >= lo) & (F.col("no") < lo + items_per_pass)), lo, min(items_per_pass, passes - lo + 1), top, width)
             for lo in range(1, (passes or 0) + 1, items_per_pass)]
    if not parts:
        return docs.sparkSession.createDataFrame([], f"item_id {items.schema['item_id'].dataType.simpleString()}, rank int, doc_id long, score long")
    out = parts[0]
    for p in parts[1:]:
        out = out.union(p)
    order = [F.col("score").desc(), F.col("doc_id").asc_nulls_last()]
    # first within a slice of the tasks, then over all: no task meets the rows of all tasks
    near = out.withColumn("_r", F.row_number().over(W.partitionBy("no", "slice").orderBy(*order))).where(F.col("_r") <= top)
    best = near.withColumn("rank", F.row_number().over(W.partitionBy("no").orderBy(*order))).where(F.col("rank") <= top)
    names = F.broadcast(numbered.select("no", "item_id").distinct()) if (passes or 0) <= items_per_pass else numbered.select("no", "item_id").distinct()
    return best.join(names, "no").select("item_id", "rank", "doc_id", "score")


def with_numbers(terms: DataFrame) -> DataFrame:
    """(no, item_id, term), items numbered from 1."""
    ids = global_rank(terms.select("item_id").distinct(), [F.col("item_id").asc_nulls_last()], "no").withColumnRenamed("item_id", "_id")
    return terms.join(ids, F.col("item_id").eqNullSafe(F.col("_id"))).select("no", "item_id", "term")


def ranked_pass(docs: DataFrame, numbered: DataFrame, first: int, count: int, top: int, width: int) -> DataFrame:
    """(no, slice, doc_id, score): the best of every task for the items from ``first`` on."""
    members = numbered.select("no", "term").collect()  # the terms of ``items_per_pass`` items
    vocabulary = sorted({r["term"] for r in members})
    place = {t: i for i, t in enumerate(vocabulary)}
    matches = cut_lineage(term_matches(docs, vocabulary))
    weights, with_terms, length = term_weights(matches, max(len(vocabulary), 1))
    pairs = [(r["no"] - first, place[r["term"]]) for r in members]
    shared = docs.sparkSession.sparkContext.broadcast((pairs, weights))

    def run(batches):
        pairs, weights = shared.value
        searcher, best = Searcher(pairs, count, weights, with_terms, length, width), Best(count, top)
        for b in batches:
            for lo in range(0, b.num_rows, ROWS):
                s = b.slice(lo, ROWS)
                doc = s.column(0).fill_null(LAST).to_numpy(zero_copy_only=False)
                terms, tf = s.column(2), s.column(3)
                at = terms.offsets.to_numpy().astype(np.int64)
                searcher.search(doc, s.column(1).to_numpy(), at - at[0], terms.flatten().to_numpy().astype(np.int64), tf.flatten().to_numpy().astype(np.int64), best)
        yield pa.RecordBatch.from_arrays(
            [pa.array(best.item + first), pa.array(best.doc, mask=best.doc == LAST), pa.array(best.score)], names=["no", "doc_id", "score"])

    rows = matches.mapInArrow(run, "no long, doc_id long, score long")
    return rows.select("no", F.pmod(F.spark_partition_id(), F.lit(64)).alias("slice"), "doc_id", "score")


SQL = rf"""
with d as (select row_number() over () as r, doc_id, regexp_extract_all(translate(text, '{UPPER}', '{LOWER}'), '{TERM}') as t from documents),
s as (select cast(count(*) filter (len(t) > 0) as bigint) as n_docs, cast(sum(len(t)) as bigint) as total from d),
i as (select distinct item_id, unnest(regexp_extract_all(translate(text, '{UPPER}', '{LOWER}'), '{TERM}')) as term from benchmark),
tf as (select r, term, count(*) as tf from (select r, unnest(t) as term from d) where term in (select term from i) group by all),
w as (select term, cast(floor(1000 * ln((2e0 * any_value(n_docs) + 2) / (2 * count(*) + 1))) as bigint) as w from tf, s group by term),
m as (select r, doc_id, 100 - 50 + (50 * len(t) * n_docs) // total as m from d, s where len(t) > 0),
p as (select tf.r, m.doc_id, tf.term, w * ((1000000000 * tf) // (1000 * tf + 20 * m)) as x from tf join w using (term) join m using (r)),
x as (select item_id, p.r, p.doc_id, cast(sum(x) as bigint) as score from p join i using (term) group by all having sum(x) > 0)
select item_id, cast(row_number() over (partition by item_id order by score desc, doc_id, r) as integer) as rank, doc_id, score from x qualify rank <= {TOP}
"""


@query("op12_lexical", SQL)
def op12(spark: SparkSession, folder: str):
    return ranked(documents(spark, folder).select("doc_id", "text"), spark.read.parquet(f"{folder}/benchmark.parquet"))
