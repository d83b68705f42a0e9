"""Repeated word spans by De Bruijn compaction.

A window of ``K`` words is an edge between the nodes of its first and last ``K - 1`` words. Edges in a row that share an anchor are
one compacted path. Where the anchor stands only in this path, in all groups of documents, the path has no branch, and it
is joined as one edge under the hash of its content. Paths whose anchor also stands in other paths branch somewhere; they are opened,
and their edges are joined one by one. The coordinates of the sources, document and place, then give the spans to remove.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from showgrid.llm.common import documents, mix64
from showgrid.llm.queries import query
from showgrid.llm.windows import (
    LAST, Runs, Shape, anchor_answers, by_anchor, chunk_runs, chunks, cover, find, group_number, group_runs, grouped, text_rows)

K, ANCHOR = 13, 5


def open_anchors(runs: Runs, answers: pa.Table) -> np.ndarray:
    """Sorted anchors whose runs have to be opened, here or because of another group."""
    order, bounds, contents = by_anchor(runs)
    mine = runs.anchor[order[bounds[:-1]]][contents > 1]
    told = answers.column("anchor").to_numpy().view(np.uint64)[answers.column("open").to_numpy(zero_copy_only=False)]
    return np.union1d(mine, told)


def edges_of(texts: list[bytes], shape: Shape, opened: np.ndarray):
    """(chunk start, sizes, runs, two hashes per window, windows of opened runs) chunk by chunk."""
    for lo, hi in chunks([len(t) for t in texts]):
        tokens, sizes = shape.tokens(texts[lo:hi])
        runs, kept = chunk_runs(tokens, sizes, shape.k, shape.m, keep=True)
        if kept is None:
            yield lo, sizes, runs, None
            continue
        window, hashes, first, last = kept
        is_open = find(opened, runs.anchor)[0]
        at = ranges(first[is_open], last[is_open])
        second = mix64(window[at] ^ np.repeat(runs.anchor[is_open], (last - first)[is_open]))
        yield lo, sizes, runs, (window[at], second, np.repeat(runs.doc[is_open], (last - first)[is_open]), at, is_open, first, last)


def ranges(start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """All numbers of the ranges [start, end), one range after the other."""
    size = end - start
    if not len(size):
        return np.zeros(0, np.int64)
    return np.repeat(start - np.concatenate([[0], np.cumsum(size)[:-1]]), size) + np.arange(size.sum())


def first_places(e1: np.ndarray, e2: np.ndarray, place: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(edge hashes, smallest place) of the distinct edges, sorted by hash."""
    order = np.lexsort((place, e2, e1))
    a, b = e1[order], e2[order]
    new = np.concatenate([[True], (a[1:] != a[:-1]) | (b[1:] != b[:-1])]) if len(a) else np.zeros(0, bool)
    return a[new], b[new], place[order][new]


def remove_repeated_spans(docs: DataFrame, k: int = K, m: int = ANCHOR) -> DataFrame:
    """doc_id, n_words, n_removed and kept (binary, the kept words joined by one space) for every row of ``docs(doc_id, text)``.

    A word goes if a window of ``k`` words that covers it also starts in a document with a smaller doc_id. A null doc_id comes after all others;
    rows with one doc_id are one document in this. Null and empty texts have no words. Equal documents tell of an anchor once per
    group, so large groups of copies cost no more than one; the rows of no key grow beyond the number of groups.
    """
    shape = Shape(True, k, m)
    dealt, groups = grouped(docs.select("doc_id", "text"))
    answers = anchor_answers(dealt, groups, shape)

    def tell_edges(texts_table: pa.Table, told: pa.Table) -> pa.Table:
        place, texts = text_rows(texts_table)
        opened = open_anchors(group_runs(texts, shape), told)
        shared = np.sort(told.column("anchor").to_numpy().view(np.uint64))
        found = []
        for lo, _, runs, kept in edges_of(texts, shape, opened):
            if kept is not None:
                w, w2, doc, at, is_open, first, last = kept
                anchor = np.repeat(runs.anchor[is_open], (last - first)[is_open])
                other = find(shared, anchor)[0]  # edges of anchors that only this group has are settled here
                found.append(first_places(w[other], w2[other], place[doc[other] + lo]))
        e = first_places(*(np.concatenate([f[i] for f in found]) if found else np.zeros(0, np.uint64) for i in range(3)))
        return pa.table({"e1": e[0].view(np.int64), "e2": e[1].view(np.int64), "doc": e[2].astype(np.int64)})

    told = dealt.groupBy("g").cogroup(answers.groupBy("g")).applyInArrow(tell_edges, "e1 long, e2 long, doc long")
    first = F.min("doc").over(W.partitionBy("e1", "e2"))
    edges = told.select("e1", "e2", "doc", first.alias("first")).where("first < doc")
    both = answers.select("g", "anchor", F.lit(None).cast("long").alias("e2"), "first", "open").union(
        edges.select(group_number(F.col("doc"), groups), "e1", "e2", "first", F.lit(None).cast("boolean")))

    def settle(texts_table: pa.Table, told: pa.Table) -> pa.Table:
        place, texts = text_rows(texts_table)
        is_edge = told.column("e2").is_valid()
        paths, edge_rows = told.filter(pa.compute.invert(is_edge)), told.filter(is_edge)
        all_runs = group_runs(texts, shape)
        opened = open_anchors(all_runs, paths)
        order, bounds, _ = by_anchor(all_runs)
        anchors, local = all_runs.anchor[order[bounds[:-1]]], place[all_runs.doc[order[bounds[:-1]]]]
        known = paths.column("anchor").to_numpy().view(np.uint64)
        o = np.argsort(known)
        hit, at = find(known[o], anchors)
        if len(known):
            local = np.where(hit, np.minimum(local, paths.column("first").to_numpy()[o][at]), local)
        far = [edge_rows.column(c).to_numpy() for c in ("anchor", "e2", "first")]
        own = [(w, w2, place[doc + lo]) for lo, _, _, kept in edges_of(texts, shape, opened) if kept is not None for w, w2, doc, *_ in (kept,)]
        e1 = np.concatenate([far[0].view(np.uint64), *[x[0] for x in own]])
        e2 = np.concatenate([far[1].view(np.uint64), *[x[1] for x in own]])
        e1, e2, first_doc = first_places(e1, e2, np.concatenate([far[2], *[x[2] for x in own]]))
        words, gone, keep = np.zeros(len(texts), np.int64), np.zeros(len(texts), np.int64), [b""] * len(texts)
        for lo, sizes, runs, kept in edges_of(texts, shape, opened):
            words[lo : lo + len(sizes)] = sizes
            marked = np.zeros(max(int(sizes.sum()) - shape.k + 1, 0), bool)
            if kept is not None:
                w, w2, doc, at, is_open, start, end = kept
                closed = ~is_open
                _, i = find(anchors, runs.anchor[closed])
                later = place[runs.doc[closed] + lo] > local[i]
                marked[ranges(start[closed][later], end[closed][later])] = True
                marked[at] = first_doc[pair_index(e1, e2, w, w2)] < place[doc + lo] if len(at) else False
            covered = cover(marked, shape.k) if len(marked) else np.zeros(int(sizes.sum()), bool)
            ends = np.cumsum(sizes)
            for d, (a, b) in enumerate(zip((ends - sizes).tolist(), ends.tolist())):
                c = covered[a:b]
                gone[lo + d] = int(c.sum())
                parts = texts[lo + d].split()
                keep[lo + d] = b" ".join([x for x, y in zip(parts, c.tolist()) if not y] if gone[lo + d] else parts)
        return pa.table({"doc_id": pa.array(place, mask=place == LAST), "n_words": words, "n_removed": gone, "kept": pa.array(keep, pa.binary())})

    return dealt.groupBy("g").cogroup(both.groupBy("g")).applyInArrow(settle, "doc_id long, n_words long, n_removed long, kept binary")


def pair_index(a: np.ndarray, b: np.ndarray, x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Index of each pair (x, y), all of which are in the pairs (a, b) sorted by a, then b."""
    at = np.searchsorted(a, x)
    while True:  # first hashes that are equal by chance: step on to the second
        wrong = np.flatnonzero(b[at] != y)
        if not len(wrong):
            return at
        at[wrong] += 1


@query("op5_debruijn")
def op5(spark, folder):
    return remove_repeated_spans(documents(spark, folder)).select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))
