"""Runs of equal-anchor windows: the shared ground of the two operators that remove repeated spans.

A text is a sequence of tokens, a window is ``K`` of them in a row. Among the hashes of the shorter grams inside a window the
smallest is its anchor. Equal windows have equal anchors, and neighbouring windows mostly share theirs, so a text falls into
runs of windows with one anchor. An anchor that stands in one place only, or always in the same run, settles all windows of its
runs at once; only runs whose anchor also stands elsewhere in another run have to be opened.

Documents are dealt into groups by a hash of their id. A group tells of each of its anchors once, whatever the number of documents
that hold it, so no anchor is hot in a shuffle.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from showgrid.llm.common import mix64

#: Bytes of text that a group should hold, and tokens that are hashed at a time.
GROUP_BYTES, CHUNK = 16 << 20, 1 << 17
#: Place of a null doc_id: after all others.
LAST = (1 << 63) - 1
BASE = 0x9E3779B97F4A7C15
BASE_INVERSE = pow(BASE, -1, 1 << 64)
_power: dict[int, np.ndarray] = {}


def powers(base: int, n: int) -> np.ndarray:
    """base**0 .. base**(n-1) modulo 2**64."""
    have = _power.get(base)
    if have is None or len(have) < n:
        size = 1 << max(n - 1, 1).bit_length()
        have = np.ones(size, np.uint64)
        done, step = 1, base
        while done < size:
            more = min(done, size - done)
            have[done : done + more] = have[:more] * np.uint64(step)
            done, step = done + more, step * step % (1 << 64)
        _power[base] = have
    return have[:n]


def byte_codes() -> np.ndarray:
    return np.random.default_rng(20).integers(0, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


CODES = byte_codes()
SPACES = np.zeros(256, bool)
SPACES[[32, 9, 10, 11, 12, 13]] = True


class Prefix:
    """Prefix sums of token * base**place, from which the hash of any stretch follows."""

    def __init__(self, tokens: np.ndarray):
        n = len(tokens)
        self.sum = np.zeros(n + 1, np.uint64)
        np.cumsum(tokens * powers(BASE, n), dtype=np.uint64, out=self.sum[1:])
        self.back = powers(BASE_INVERSE, n + 1)

    def all(self, k: int) -> np.ndarray:
        """Hashes of all stretches of ``k`` tokens."""
        n = len(self.sum) - k
        return mix64((self.sum[k:] - self.sum[:-k]) * self.back[:n])

    def of(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return mix64((self.sum[end] - self.sum[start]) * self.back[start] + (end - start).astype(np.uint64))


def sliding_min(v: np.ndarray, w: int) -> np.ndarray:
    """Minimum of every ``w`` neighbours, from running minima of blocks in both directions."""
    n = len(v)
    x = np.concatenate([v, np.full(-n % w, np.iinfo(np.uint64).max, np.uint64)]).reshape(-1, w)
    left = np.minimum.accumulate(x, axis=1).ravel()
    right = np.minimum.accumulate(x[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(right[: n - w + 1], left[w - 1 : n])


def sliding_max(v: np.ndarray, w: int) -> np.ndarray:
    return ~sliding_min(~v, w)


@dataclass
class Runs:
    """Runs of a chunk or a group, in the order of documents and places."""

    anchor: np.ndarray
    content: np.ndarray  # hash of all windows of the run
    doc: np.ndarray  # number of the document in the group
    start: np.ndarray  # first window, counted in tokens from the start of the document
    end: np.ndarray  # after the last window
    several: np.ndarray  # whether the anchor stands in the run more than once


def bytes_of(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """(tokens, number of tokens of each text) with bytes as tokens."""
    raw = np.frombuffer(b"".join(texts), np.uint8)
    return CODES[raw], np.array([len(t) for t in texts], np.int64)


def words_of(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """(tokens, number of tokens of each text) with words as tokens."""
    raw = np.frombuffer(b" ".join(texts) + b" ", np.uint8)
    space = SPACES[raw]
    inside = np.diff(np.concatenate([[True], space]).astype(np.int8))
    start = np.flatnonzero(inside == -1)
    end = np.flatnonzero(inside == 1)
    tokens = Prefix(CODES[raw]).of(start, end)
    edges = np.cumsum([0] + [len(t) + 1 for t in texts])
    at = np.searchsorted(start, edges)
    return tokens, np.diff(at)


def chunk_runs(tokens: np.ndarray, sizes: np.ndarray, k: int, m: int, keep: bool = False):
    """Runs of the documents of one chunk, their numbers counted from 0; with ``keep`` also the window hashes."""
    ends = np.cumsum(sizes)
    starts = ends - sizes
    n = len(tokens) - k + 1
    if n <= 0 or not (sizes >= k).any():
        z = np.zeros(0, np.int64)
        return Runs(z.view(np.uint64), z.view(np.uint64), z, z, z, z.astype(bool)), None
    hashes = Prefix(tokens)
    grams = hashes.all(m)
    width = k - m + 1
    low = sliding_min(grams, width)
    window = hashes.all(k)
    inside = np.zeros(len(tokens) + 1, np.int32)
    long = sizes >= k
    np.add.at(inside, starts[long], 1)
    np.add.at(inside, ends[long] - k + 1, -1)
    inside = np.cumsum(inside[:n]) > 0  # windows within one document
    turn = np.ones(n, bool)
    turn[1:] = (low[1:] != low[:-1]) | (inside[1:] != inside[:-1])
    turn[starts[long]] = True
    first = np.flatnonzero(turn)
    last = np.append(first[1:], n)
    ok = inside[first]
    first, last = first[ok], last[ok]
    mixed = mix64(window ^ np.uint64(0x5851F42D4C957F2D))
    total = np.zeros(n + 1, np.uint64)
    np.cumsum(mixed, dtype=np.uint64, out=total[1:])
    placed = np.zeros(n + 1, np.uint64)
    np.cumsum(mixed * np.arange(n, dtype=np.uint64), dtype=np.uint64, out=placed[1:])
    one = total[last] - total[first]
    two = placed[last] - placed[first] - one * first.astype(np.uint64)
    content = mix64(one + mix64(two + (last - first).astype(np.uint64)))
    # An anchor is a gram that is the smallest of a window that holds it. Anchors and runs have the same order, and neighbouring
    # runs have different ones, so the n-th stretch of equal anchors belongs to the n-th run.
    pad = np.zeros(width - 1, np.uint64)
    top = sliding_max(np.concatenate([pad, np.where(inside, low, np.uint64(0)), pad]), width)
    at = np.flatnonzero((grams == top) & (top > 0))
    value, owner = grams[at], np.searchsorted(ends, at, side="right")
    fresh = np.flatnonzero(np.concatenate([[True], (value[1:] != value[:-1]) | (owner[1:] != owner[:-1])]))
    several = np.diff(np.append(fresh, len(at))) > 1
    doc = np.searchsorted(ends, first, side="right")
    runs = Runs(low[first], content, doc, first - starts[doc], last - starts[doc], several)
    return runs, ((window, hashes, first, last) if keep else None)


def chunks(sizes: list[int]):
    """Ranges of documents with ``CHUNK`` bytes or one document."""
    lo, total = 0, 0
    for i, s in enumerate(sizes):
        if i > lo and total + s > CHUNK:
            yield lo, i
            lo, total = i, 0
        total += s
    if lo < len(sizes):
        yield lo, len(sizes)


@dataclass(frozen=True)
class Shape:
    """What a window is: its tokens and the length of windows and of anchor grams."""

    words: bool
    k: int
    m: int

    def tokens(self, texts: list[bytes]):
        return words_of(texts) if self.words else bytes_of(texts)


def text_rows(table: pa.Table) -> tuple[np.ndarray, list[bytes]]:
    """(doc_ids, texts) of a group, by doc_id, null last, then by text; null texts are empty."""
    table = table.select(["doc_id", "text"]).combine_chunks()
    ids = table.column("doc_id").fill_null(LAST)
    table = table.set_column(0, "doc_id", ids).sort_by([("doc_id", "ascending"), ("text", "ascending")])
    texts = [(t.as_py() or "").encode("utf-8", "replace") for t in table.column("text")]
    return table.column("doc_id").to_numpy(), texts


def group_runs(texts: list[bytes], shape: Shape) -> Runs:
    """Runs of all documents of a group; only the runs are kept, not the hashes of the tokens."""
    parts = []
    for lo, hi in chunks([len(t) for t in texts]):
        r, _ = chunk_runs(*shape.tokens(texts[lo:hi]), shape.k, shape.m)
        parts.append(Runs(r.anchor, r.content, r.doc + lo, r.start, r.end, r.several))
    if not parts:
        z = np.zeros(0, np.int64)
        return Runs(z.view(np.uint64), z.view(np.uint64), z, z, z, z.astype(bool))
    return Runs(*(np.concatenate([getattr(p, f) for p in parts]) for f in ("anchor", "content", "doc", "start", "end", "several")))


def by_anchor(runs: Runs) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(order, bounds, contents): runs sorted by anchor, then place; where each anchor begins; its number of different runs.

    An anchor that stands in one run more than once counts as one run more, since the run may repeat a window itself.
    """
    n = len(runs.anchor)
    order = np.argsort(runs.anchor, kind="stable")
    a = runs.anchor[order]
    new = np.flatnonzero(np.concatenate([[True], a[1:] != a[:-1]])) if n else np.zeros(0, np.int64)
    bounds = np.append(new, n)
    contents = np.ones(len(new), np.int64)
    count = np.diff(bounds)
    more = np.flatnonzero(np.repeat(count > 1, count))  # an anchor that stands alone has one run
    if len(more):
        owner, c = np.repeat(np.arange(len(new)), count)[more], runs.content[order[more]]
        both = np.lexsort((c, owner))
        owner, c = owner[both], c[both]
        fresh = np.concatenate([[True], (owner[1:] != owner[:-1]) | (c[1:] != c[:-1])])
        contents += np.bincount(owner[fresh], minlength=len(new)) - (count > 1)
    extra = np.maximum.reduceat(runs.several[order], new) if n else np.zeros(0, bool)
    return order, bounds, contents + extra


def grouped(docs: DataFrame, group_bytes: int = GROUP_BYTES) -> tuple[DataFrame, int]:
    """(g, doc_id, text) dealt by group, and the number of groups: four a task at least, and of bounded size."""
    tasks = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    groups = max(4 * tasks, -(-size // group_bytes))
    return docs.select(group_number(F.col("doc_id"), groups).alias("g"), "doc_id", "text").repartition(tasks, "g"), groups


def group_number(doc_id, groups: int):
    return F.pmod(F.xxhash64(F.coalesce(doc_id, F.lit(LAST))), F.lit(groups))


def anchor_answers(dealt: DataFrame, groups: int, shape: Shape) -> DataFrame:
    """What groups have to know about anchors that others hold too: (g, anchor, first, open, total).

    ``first`` is the smallest doc_id that holds the anchor anywhere, ``open`` whether it stands in different runs, ``total`` the number of runs.
    Groups that hold the first document of an anchor with one run need no answer.
    """

    def tell(table: pa.Table) -> pa.Table:
        place, texts = text_rows(table)
        runs = group_runs(texts, shape)
        order, bounds, contents = by_anchor(runs)
        head = order[bounds[:-1]]
        return pa.table({"anchor": runs.anchor[head].view(np.int64), "content": runs.content[head].view(np.int64),
                         "contents": contents.astype(np.int32), "doc": place[runs.doc[head]]})

    told = dealt.groupBy("g").applyInArrow(tell, "anchor long, content long, contents int, doc long")
    same = W.partitionBy("anchor")
    seen = told.select("anchor", "doc", F.count(F.lit(1)).over(same).alias("n"), F.min("doc").over(same).alias("first"),
                       ((F.min("content").over(same) != F.max("content").over(same)) | (F.max("contents").over(same) > 1)).alias("open"),
                       F.sum("contents").over(same).alias("total"))
    return seen.where("n > 1 and (open or doc > first)").select(group_number(F.col("doc"), groups).alias("g"), "anchor", "first", "open", "total")


def find(values: np.ndarray, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(whether found, index) of ``wanted`` in sorted ``values``."""
    if not len(values):
        return np.zeros(len(wanted), bool), np.zeros(len(wanted), np.int64)
    at = np.minimum(np.searchsorted(values, wanted), len(values) - 1)
    return values[at] == wanted, at


def cover(marked: np.ndarray, k: int) -> np.ndarray:
    """Tokens covered by the windows that are marked; one token row is ``k - 1`` longer than the windows."""
    n = len(marked) + k - 1
    step = np.zeros(n + 1, np.int32)
    turn = np.diff(np.concatenate([[0], marked.astype(np.int8), [0]]))
    np.add.at(step, np.flatnonzero(turn == 1), 1)
    np.add.at(step, np.flatnonzero(turn == -1) + k - 1, -1)
    return np.cumsum(step[:n]) > 0
