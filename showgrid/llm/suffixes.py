"""Repeated byte spans by suffix arrays.

Every text is a sequence of bytes; a string of ``K`` bytes that also starts earlier is removed. Runs of strings with one
anchor (see ``windows``) are settled as wholes where the anchor always stands in the same run. The other runs go, gathered by
anchor over all documents, into suffix arrays: strings that are equal are neighbours there, and all but the earliest are removed. The arrays are
built by linear grouping.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from showgrid.llm.common import documents, mix64, sorted_groups
from showgrid.llm.queries import query
from showgrid.llm.windows import (
    CODES, LAST, Prefix, Runs, Shape, anchor_answers, by_anchor, cover, find, group_number, group_runs, grouped, text_rows)

K, ANCHOR = 100, 40
#: Bytes that a suffix array should hold, and runs of one anchor that go into one task.
ARRAY_BYTES, PART = 1 << 16, 256


def suffix_array(text: bytes) -> list[int]:
    """Starts of the suffixes in order, by linear grouping.

    Suffixes are grouped by their Lyndon prefix, at first by one byte. Groups are taken in descending order; each suffix of a
    group finds the nearest earlier suffix of a lower group, its previous smaller one, over the pointers found so far. The suffixes
    pointed at have their prefix extended by that of the group, so they move up inside their own group, those pointed at more often further.
    At the end a group that holds suffixes of equal Lyndon prefix is put out in the order in which the suffixes behind are.
    """
    n = len(text) + 1
    symbol = np.zeros(n, np.int64)
    symbol[:-1] = np.frombuffer(text, np.uint8).astype(np.int64) + 1
    order = np.argsort(symbol, kind="stable")
    sorted_symbol = symbol[order]
    begin = np.flatnonzero(np.concatenate([[True], sorted_symbol[1:] != sorted_symbol[:-1]]))
    count = np.diff(np.append(begin, n))
    sizes, groups, places = np.zeros(n + 1, np.int64), np.empty(n, np.int64), np.empty(n, np.int64)
    sizes[begin], groups[order], places[order] = count, np.repeat(begin, count), np.arange(n)
    # a group is named by the place where it begins, so names have the order of the groups
    slots, size, group, place, before = order.tolist(), sizes.tolist(), groups.tolist(), places.tolist(), [-1] * n
    end = n - 1
    while end > 0:
        name = group[slots[end]]
        members = slots[name : end + 1]
        end = name - 1
        members.sort()
        pointed: dict[int, int] = {}
        for i in members:
            j = i - 1
            while j >= 0 and group[j] >= name:
                j = before[j]
            before[i] = j
            if j >= 0:
                pointed[j] = pointed.get(j, 0) + 1
        by_count: dict[int, list[int]] = {}
        for j, c in pointed.items():
            by_count.setdefault(c, []).append(j)
        for c in sorted(by_count, reverse=True):
            level = by_count[c]
            for j in level:  # to the end of the own group, which gets shorter
                g = group[j]
                size[g] -= 1
                to, at = g + size[g], place[j]
                other = slots[to]
                slots[at], place[other], slots[to], place[j] = other, at, j, to
            for j, g in zip(level, [group[j] + size[group[j]] for j in level]):
                group[j] = g
                size[g] += 1
    out, front, done = [-1] * n, list(range(n + 1)), bytearray(n)
    out[0], done[n - 1] = n - 1, 1
    for i in range(n):
        j = out[i] - 1
        while j >= 0 and not done[j]:
            g = group[j]
            out[front[g]] = j
            front[g] += 1
            done[j] = 1
            j = before[j]
    return out[1:]


def later_copies(text: bytes, valid: np.ndarray, k: int) -> np.ndarray:
    """Marks the starts of strings of ``k`` bytes that also start earlier in ``text``, among the ``valid`` starts."""
    order = np.array(suffix_array(text), np.int64)
    order = order[valid[order]]
    out = np.zeros(len(text), bool)
    if len(order) < 2:
        return out
    view = np.lib.stride_tricks.sliding_window_view(np.frombuffer(text, np.uint8), k)
    same = np.concatenate([np.ones(0, bool)] + [(view[order[s + 1 : s + 4097]] == view[order[s : s + 4096]][: len(order[s + 1 : s + 4097])]).all(axis=1) for s in range(0, len(order) - 1, 4096)])
    first = np.flatnonzero(np.concatenate([[True], ~same]))
    least = np.minimum.reduceat(order, first)
    out[order] = order != np.repeat(least, np.diff(np.append(first, len(order))))
    return out


def stretches(marked: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(starts, ends) of the stretches of marks."""
    step = np.diff(np.concatenate([[0], marked.astype(np.int8), [0]]))
    return np.flatnonzero(step == 1), np.flatnonzero(step == -1)


def shared_parts(shared: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(run, first, last shared string) of the runs, which end at ``ends``, that hold a shared string."""
    at = np.flatnonzero(shared)
    owner = np.searchsorted(ends, at, side="right")
    turn = np.flatnonzero(owner[1:] != owner[:-1])
    first, last = np.concatenate([[0], turn + 1])[: len(at)], np.append(turn, len(at) - 1)[: len(at)]
    return owner[first], at[first], at[last]


def opened_runs(runs: Runs, told: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(indices of runs to open, whether each is the first of its anchor and content here, number of runs of its anchor anywhere)."""
    order, bounds, contents = by_anchor(runs)
    anchors = runs.anchor[order[bounds[:-1]]]
    total = contents.copy()
    known = told.column("anchor").to_numpy().view(np.uint64)
    o = np.argsort(known)
    hit, at = find(known[o], anchors)
    is_open = contents > 1
    if len(known):
        is_open = is_open | (hit & told.column("open").to_numpy(zero_copy_only=False)[o][at])
        total = np.where(hit, told.column("total").to_numpy()[o][at], total)
    index = np.empty(len(order), np.int64)
    index[order] = np.repeat(np.arange(len(anchors)), np.diff(bounds))
    which = np.flatnonzero(is_open[index])
    a, c = runs.anchor[which], runs.content[which]
    both = np.lexsort((which, c, a))
    fresh = np.concatenate([[True], (a[both][1:] != a[both][:-1]) | (c[both][1:] != c[both][:-1])]) if len(which) else np.zeros(0, bool)
    first = np.zeros(len(which), bool)
    first[both[fresh]] = True
    return which, first, total[index[which]]


RUN_SCHEMA = "anchor long, part int, parts int, content long, doc long, seq long, body binary"
MARK_SCHEMA = "anchor long, content long, doc long, seq long, lo int, hi int, h1 long, h2 long"


def marks_of(table: pa.Table, k: int) -> pa.Table:
    """Marks for whole groups of runs, sorted by anchor and part.

    ``h1`` is null in a row that marks the strings lo to hi of a run as later copies. Runs of an anchor with several
    parts also give, one by one, the strings that are not marked here, to be compared with the other parts.
    """
    # parts of one anchor that happen to be here together are compared at once, in the order of documents and places
    table = table.sort_by([(c, "ascending") for c in ("anchor", "doc", "seq")]).combine_chunks()
    anchor, parts, content, doc, seq = (table.column(c).to_numpy() for c in ("anchor", "parts", "content", "doc", "seq"))
    bodies = [b.as_py() for b in table.column("body")]
    size = np.array([len(b) for b in bodies], np.int64)
    out: dict[str, list[np.ndarray]] = {c.split()[0]: [] for c in MARK_SCHEMA.split(", ")}

    def put(rows, lo, hi, h1=None, h2=None):
        for c, v in (("anchor", anchor[rows]), ("content", content[rows]), ("doc", doc[rows]), ("seq", seq[rows]), ("lo", lo.astype(np.int32)), ("hi", hi.astype(np.int32))):
            out[c].append(pa.array(v))
        for c, v in (("h1", h1), ("h2", h2)):
            out[c].append(pa.nulls(len(rows), pa.int64()) if v is None else pa.array(v.view(np.int64)))

    new = np.ones(len(bodies), bool)  # a content that came before is a copy as a whole
    order = np.lexsort((np.arange(len(bodies)), content, anchor))
    same = (anchor[order][1:] == anchor[order][:-1]) & (content[order][1:] == content[order][:-1])
    new[order[1:][same]] = False
    copies = np.flatnonzero(~new)
    put(copies, np.zeros(len(copies), np.int64), size[copies] - k + 1)

    rows = np.flatnonzero(new)
    text = b"".join(bodies[i] for i in rows)
    ends = np.cumsum(size[rows])
    starts = ends - size[rows]
    valid = np.zeros(len(text), bool)
    for a, b in zip(starts.tolist(), ends.tolist()):
        valid[a : b - k + 1] = True
    hashes = Prefix(CODES[np.frombuffer(text, np.uint8)]).all(k) if len(text) >= k else np.zeros(0, np.uint64)
    at = np.flatnonzero(valid)
    _, number, count = np.unique(hashes[at], return_inverse=True, return_counts=True)
    shared = np.zeros(len(text), bool)
    shared[at] = count[number] > 1  # a string whose hash stands alone has no copy here
    marked = np.zeros(len(text), bool)
    # Of a run only the part between its first and last shared string can matter. A part that came before, byte for byte, is a
    # copy as a whole, like a run that came before; what is left and still shares a string goes into the arrays.
    row, low, high = shared_parts(shared, ends)
    seen: set[bytes] = set()
    for a, b in zip(low.tolist(), (high + k).tolist()):
        part = text[a:b]
        if part in seen:
            marked[a : b - k + 1] = True
        else:
            seen.add(part)
    left = ~marked[at]
    count = np.bincount(number[left], minlength=len(count))
    shared[at] = left & (count[number] > 1)
    row, low, high = shared_parts(shared, ends)
    span, held = [], 0
    for n, (r, a, b) in enumerate(zip(row.tolist(), low.tolist(), (high + k).tolist())):
        span.append((a, b))
        held += b - a
        if n + 1 == len(row) or held >= ARRAY_BYTES and anchor[rows[row[n + 1]]] != anchor[rows[r]]:
            piece = b"".join(text[a:b] for a, b in span)
            ok = np.concatenate([np.append(shared[a : b - k + 1], np.zeros(k - 1, bool)) for a, b in span])
            hit, p = later_copies(piece, ok, k), 0
            for a, b in span:
                marked[a:b] |= hit[p : p + b - a]
                p += b - a
            span, held = [], 0
    lo, hi = stretches(marked)
    owner = np.searchsorted(ends, lo, side="right")
    put(rows[owner], lo - starts[owner], hi - starts[owner])
    single = np.flatnonzero(valid & ~marked & np.repeat(parts[rows] > 1, size[rows]))
    owner = np.searchsorted(ends, single, side="right")
    put(rows[owner], single - starts[owner], single - starts[owner] + 1, hashes[single], mix64(hashes[single] ^ anchor[rows[owner]].view(np.uint64)))
    return pa.table({c: pa.concat_arrays(v) for c, v in out.items()})


def remove_repeated_bytes(docs: DataFrame, k: int = K, m: int = ANCHOR) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans and kept (binary) for every row of ``docs(doc_id, text)``.

    A byte goes if a string of ``k`` bytes that covers it also starts earlier: in a document with a smaller doc_id, or before in the same
    one. A null doc_id comes after all others; rows that share a doc_id count as one document, in the order of their texts, and
    no string crosses from one to the next. Null and empty texts have no bytes. A group of documents sends each run of an anchor
    once, and an anchor with many runs is split into parts that are compared by string, so no task gets all of a hot anchor.
    """
    shape = Shape(False, k, m)
    tasks = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt, groups = grouped(docs.select("doc_id", "text"))
    answers = anchor_answers(dealt, groups, shape)

    def tell_runs(texts_table: pa.Table, told: pa.Table) -> pa.Table:
        place, texts = text_rows(texts_table)
        runs = group_runs(texts, shape)
        which, first, total = opened_runs(runs, told)
        which, parts = which[first], -(-total[first] // PART)
        part = (mix64(runs.content[which]) % np.maximum(parts, 1).astype(np.uint64)).astype(np.int32)
        body = [texts[d][a : b - 1 + k] for d, a, b in zip(runs.doc[which].tolist(), runs.start[which].tolist(), runs.end[which].tolist())]
        return pa.table({"anchor": runs.anchor[which].view(np.int64), "part": part, "parts": parts.astype(np.int32), "content": runs.content[which].view(np.int64),
                         "doc": place[runs.doc[which]], "seq": which.astype(np.int64), "body": pa.array(body, pa.binary())})

    told = dealt.groupBy("g").cogroup(answers.groupBy("g")).applyInArrow(tell_runs, RUN_SCHEMA)
    gathered = told.repartition(tasks, "anchor", "part").sortWithinPartitions("anchor", "part")

    def mark(batches):
        for table in sorted_groups(batches, ["anchor", "part"]):
            yield from marks_of(table, k).to_batches()

    marks = gathered.mapInArrow(mark, MARK_SCHEMA)
    # strings of split anchors meet the other parts; a mark stands alone under a key of its own and passes
    order = F.struct("doc", "seq", "lo")
    least = F.min(order).over(W.partitionBy(F.coalesce("h1", F.xxhash64("anchor", "content", "doc", "lo")), F.coalesce("h2", F.xxhash64("doc", "seq", "hi"))))
    marks = marks.withColumn("least", least).where(F.col("h1").isNull() | (order > F.col("least")))
    none = F.lit(None)
    both = answers.select("g", "anchor", "first", "open", none.cast("long").alias("seq"), none.cast("int").alias("lo"), none.cast("int").alias("hi"), "total").union(
        marks.select(group_number(F.col("doc"), groups), "anchor", none.cast("long"), none.cast("boolean"), "seq", "lo", "hi", none.cast("long")))

    def settle(texts_table: pa.Table, told: pa.Table) -> pa.Table:
        place, texts = text_rows(texts_table)
        is_mark = told.column("seq").is_valid()
        paths, found = told.filter(pa.compute.invert(is_mark)), told.filter(is_mark)
        runs = group_runs(texts, shape)
        which, first, _ = opened_runs(runs, paths)
        is_open = np.zeros(len(runs.anchor), bool)
        is_open[which] = True
        order, bounds, _ = by_anchor(runs)
        head = order[bounds[:-1]]
        gone = np.ones(len(runs.anchor), bool)  # closed runs: all but the first here go, and that too if another group has an earlier one
        known = paths.column("anchor").to_numpy().view(np.uint64)
        o = np.argsort(known)
        hit, at = find(known[o], runs.anchor[head])
        earlier = (hit & (paths.column("first").to_numpy()[o][at] < place[runs.doc[head]])) if len(known) else hit
        gone[head] = earlier
        gone[which] = ~first  # open runs: copies of a run that came before here go; the first ones have marks
        windows = np.array([max(len(t) - k + 1, 0) for t in texts], np.int64)
        base = np.cumsum(windows) - windows
        step = np.zeros(int(windows.sum()) + 1, np.int8)  # up where a stretch of marks begins, down behind it; no string is marked twice
        begin = base[runs.doc] + runs.start
        np.add.at(step, begin[gone], 1)
        np.add.at(step, begin[gone] + (runs.end - runs.start)[gone], -1)
        run = found.column("seq").to_numpy()
        np.add.at(step, begin[run] + found.column("lo").to_numpy(), 1)
        np.add.at(step, begin[run] + found.column("hi").to_numpy(), -1)
        marked = np.cumsum(step, dtype=np.int8) > 0
        n_removed, n_spans, kept = [], [], []
        for t, b, n in zip(texts, base.tolist(), windows.tolist()):
            m_ = marked[b : b + n]
            if m_.any():
                c = cover(m_, k)
                n_removed.append(int(c.sum()))
                n_spans.append(len(stretches(c)[0]))
                kept.append(np.frombuffer(t, np.uint8)[~c].tobytes())
            else:
                n_removed.append(0)
                n_spans.append(0)
                kept.append(t)
        return pa.table({"doc_id": pa.array(place, mask=place == LAST), "n_bytes": np.array([len(t) for t in texts], np.int64),
                         "n_removed": pa.array(n_removed, pa.int64()), "n_spans": pa.array(n_spans, pa.int64()), "kept": pa.array(kept, pa.binary())})

    return dealt.groupBy("g").cogroup(both.groupBy("g")).applyInArrow(settle, "doc_id long, n_bytes long, n_removed long, n_spans long, kept binary")


@query("op7_suffixes")
def op7(spark, folder):
    return remove_repeated_bytes(documents(spark, folder)).select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))
