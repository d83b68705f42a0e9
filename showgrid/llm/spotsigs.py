"""Document fingerprints by SpotSigs: chains of content words that follow common words.

Each occurrence of a common word, the anchor, gives one signature: the anchor and the next ``CHAIN`` content words. The
fingerprint of a text is the set of its signatures. Texts are near when the Jaccard similarity of their sets is high;
sets whose lengths differ too much are never compared.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from functools import lru_cache
from typing import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


CHAIN = 3
# Common words of English, French, Spanish and German that serve as anchors.
ANCHORS = frozenset(
    "the a an of and to in is was for on that it with as be at by this from are or but not have had has he she they we you his her their its were which "
    "le la les de des du un une et en dans que qui pour par sur est pas au aux avec ce se plus ne ou son sa ses il elle "
    "el los las del y un una por con para es al lo como no su sus se más o pero "
    "der die das den dem des ein eine einer einem einen und zu im ist mit von auf für nicht sich auch es an als".split())
NEAR = ["d1", "d2", "class_id", "n_near"]
#: Characters of texts whose signatures are found together.
TOGETHER = 1 << 18
#: Bytes of texts that a task deals at a time, and how hard those of a range are compressed.
PACK_BYTES, LEVEL = 1 << 22, 6


#: Step of CRC-32 by the last byte, its inner value after a space, and the anchors by their bytes, 8 at most, with their values.
ONE_SHIFT = np.array([zlib.crc32(bytes([i ^ 255])) ^ 0xFF000000 for i in range(256)], np.uint32)
AFTER_SPACE = zlib.crc32(b" ") ^ 0xFFFFFFFF
ANCHOR_BYTES, ANCHOR_CRC = (np.array(x) for x in zip(*sorted((np.uint64(int.from_bytes(a.encode(), "little")), np.uint32(zlib.crc32(a.encode()))) for a in ANCHORS)))


def shift_tables() -> tuple[np.ndarray, list[np.ndarray]]:
    """What so many bytes more do to a CRC-32, by the value of each of its four bytes: for 0 to ``SHORT`` - 1 bytes, and for ``SHORT`` times powers of two."""
    now = np.arange(256, dtype=np.uint32)[None, :] << np.arange(0, 32, 8, dtype=np.uint32)[:, None]
    short = []
    for _ in range(SHORT):
        short.append(now)
        now = (now >> np.uint32(8)) ^ ONE_SHIFT[now & np.uint32(255)]
    long = [now]
    while len(long) < 26:
        long.append(shifted(long[-1].ravel(), long[-1]).reshape(4, 256))
    return np.stack(short), long


def shifted(crc: np.ndarray, table: np.ndarray, at: np.ndarray | None = None) -> np.ndarray:
    """The values under one table, or each under its own of many."""
    at = np.int64(0) if at is None else at * 1024
    flat = table.ravel()
    byte = lambda i: ((crc >> np.uint32(8 * i)) & np.uint32(255)).astype(np.int64) + (at + 256 * i)
    return flat[byte(0)] ^ flat[byte(1)] ^ flat[byte(2)] ^ flat[byte(3)]


SHORT = 64  # bytes up to which a length has a table of its own
SHORT_SHIFTS, LONG_SHIFTS = shift_tables()


def joined(crc: np.ndarray, more: np.ndarray, size: np.ndarray) -> np.ndarray:
    """CRC-32 of texts followed by others, from the values of both and the bytes of the others."""
    out = shifted(crc, SHORT_SHIFTS, size % SHORT)
    rest = size // SHORT
    for k, table in enumerate(LONG_SHIFTS):
        if not rest.any():
            break
        some = np.flatnonzero(rest & 1)
        out[some] = shifted(out[some], table)
        rest = rest >> 1
    return out ^ more


@lru_cache(1)
def in_words() -> np.ndarray:
    """Whether each code point is part of a word, as ``\\w`` has it."""
    return np.fromiter((chr(i).isalnum() or i == 95 for i in range(0x110000)), bool, 0x110000)


def words_of(texts: list[str]) -> tuple[np.ndarray, ...]:
    """Text, CRC-32 and bytes of a space and the word, and number of the anchor or -1, for all words of lower-case texts: maximal runs of ``\\w``."""
    whole = "\n".join(texts)
    raw = whole.encode("utf-8", "replace")
    data = np.frombuffer(raw, np.uint8)
    firsts = np.concatenate([[0], np.cumsum([len(t) + 1 for t in texts])[:-1]]).astype(np.int64)
    if len(raw) == len(whole):
        inside = in_words()[:256][data]
    else:
        points = np.frombuffer(whole.encode("utf-32-le", "replace"), np.uint32)
        sizes = 1 + (points > 0x7F) + (points > 0x7FF) + (points > 0xFFFF)
        inside = np.repeat(in_words()[points], sizes)
        firsts = np.concatenate([[0], np.cumsum(sizes)])[firsts]
    edges = np.flatnonzero(np.diff(np.concatenate([[False], inside, [False]])))
    start, size = edges[::2], edges[1::2] - edges[::2]
    crc, short, left = np.full(len(start), AFTER_SPACE, np.uint32), np.zeros(len(start), np.uint64), np.flatnonzero(size <= SHORT)
    for j in range(SHORT):
        left = left[size[left] > j]
        if not len(left):
            break
        byte, now = data[start[left] + j], crc[left]
        crc[left] = (now >> np.uint32(8)) ^ ONE_SHIFT[(now ^ byte) & np.uint32(255)]
        if j < 8:
            short[left] |= byte.astype(np.uint64) << np.uint64(8 * j)
    crc ^= np.uint32(0xFFFFFFFF)
    for i in np.flatnonzero(size > SHORT).tolist():
        crc[i] = zlib.crc32(raw[start[i] : start[i] + size[i]], zlib.crc32(b" "))
    place = np.minimum(np.searchsorted(ANCHOR_BYTES, short), len(ANCHOR_BYTES) - 1)
    anchor = np.where((size <= 8) & (ANCHOR_BYTES[place] == short), place, -1)
    return np.searchsorted(firsts, start, side="right") - 1, crc, size + 1, anchor


def some_sets(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """Sorted signatures of all texts, one text after another, and where each begins."""
    text, crc, size, anchor = words_of([(t or "").lower() for t in texts])
    n, common = len(texts), anchor >= 0
    counts, anchors = np.bincount(text, minlength=n), np.bincount(text[common], minlength=n)
    plain = ((anchors == 0) | (anchors == counts))[text]
    is_content = plain | ~common
    content = np.flatnonzero(is_content)
    before = np.concatenate([[0], np.cumsum(is_content)])  # content words before each word
    last = before[np.cumsum(counts)]  # those up to the end of each text
    starts = np.flatnonzero(plain | common)
    at, end = before[starts], last[text[starts]]
    sigs = np.where(plain[starts], np.uint32(0), ANCHOR_CRC[anchor[starts]])
    for j in range(CHAIN):
        some = np.flatnonzero(at + j < end)
        word = content[at[some] + j]
        sigs[some] = joined(sigs[some], crc[word], size[word])
    keys = np.sort(text[starts].astype(np.uint64) << np.uint64(32) | sigs)
    keys = keys[np.diff(keys, prepend=keys[:1] ^ np.uint64(1)) != 0]
    return keys.astype(np.uint32), np.concatenate([[0], np.cumsum(np.bincount((keys >> np.uint64(32)).astype(np.int64), minlength=n))])


def signature_sets(texts: list[str | None]) -> list[np.ndarray]:
    """32-bit hashes of the signatures of each whole text, sorted, without repeats.

    A text without anchors, or without other words, has a chain at each word instead, so that short texts differ too; only a text without words has none.
    Texts are taken together up to ``TOGETHER`` characters: the CRC-32 of a chain is put together from those of its words.
    """
    out, run, chars = [], [], 0
    for i, t in enumerate(texts):
        run.append(t)
        chars += len(t or "")
        if chars >= TOGETHER or i == len(texts) - 1:
            flat, at = some_sets(run)
            out += [flat[a:b] for a, b in zip(at[:-1].tolist(), at[1:].tolist())]
            run, chars = [], 0
    return out


def signatures(text: str | None) -> frozenset[int]:
    """The signatures of one text as a plain set."""
    return frozenset(signature_sets([text])[0].tolist())


def fingerprint(ordered: np.ndarray) -> str:
    """Number of signatures and their sorted hashes; equal sets give equal strings."""
    return f"{len(ordered)}:" + ordered.astype(">u4").tobytes().hex()


def digest(ordered: np.ndarray) -> tuple[int, int]:
    """Two 64-bit halves of a digest of a sorted set; equal sets give equal digests."""
    return struct.unpack("<qq", hashlib.blake2b(ordered.astype("<u4").tobytes(), digest_size=16).digest())


def jaccard(a: frozenset[int], b: frozenset[int], least: float = 0.0) -> float:
    """Jaccard similarity; 1 for two empty sets, 0 without comparing where the lengths cannot reach ``least``."""
    small, large = sorted((len(a), len(b)))
    if not large:
        return 1.0
    if not small or small < least * large:
        return 0.0
    both = len(a & b)
    return both / (small + large - both)


def likenesses(a: list[np.ndarray], b: list[np.ndarray]) -> np.ndarray:
    """Jaccard similarity of each two sorted sets, 1 for two empty ones."""
    sizes = [np.fromiter(map(len, x), np.int64, len(x)) for x in (a, b)]
    keys = np.sort(np.concatenate([np.repeat(np.arange(len(n), dtype=np.uint64) << np.uint64(32), n) | np.concatenate([*x, np.zeros(0, np.uint32)]) for x, n in zip((a, b), sizes)]))
    both = np.bincount((keys[1:][keys[1:] == keys[:-1]] >> np.uint64(32)).astype(np.int64), minlength=len(a))
    every = sizes[0] + sizes[1] - both
    return np.where(every == 0, 1.0, both / np.maximum(every, 1))


def packed(base: DataFrame, numbers, goes_to: dict) -> DataFrame:
    """(range, guest, doc_ids, lengths, data): the texts of a range that a task met side by side, compressed together."""

    def run(batches):
        for b in batches:
            ids, texts, run, size = b.column("doc_id"), b.column("text"), {}, 0
            ranges = numbers(ids)
            for i, (where, doc, text) in enumerate(zip(ranges.tolist(), ids.to_pylist(), texts)):
                raw = text.as_py().encode("utf-8", "replace")
                run.setdefault((where, 0), []).append((doc, raw))
                if doc in goes_to:
                    run.setdefault((goes_to[doc], 1), []).append((doc, raw))
                size += len(raw)
                if size >= PACK_BYTES or i == b.num_rows - 1:
                    yield pack(run)
                    run, size = {}, 0

    return base.mapInArrow(run, "range long, guest int, doc_ids array<long>, lengths array<long>, data binary")


def pack(groups: dict) -> pa.RecordBatch:
    level = zstandard.ZstdCompressor(level=LEVEL)
    cells = [([d for d, _ in g], [len(x) for _, x in g], level.compress(b"".join(x for _, x in g))) for g in groups.values()]
    kinds = [pa.list_(pa.int64()), pa.list_(pa.int64()), pa.binary()]
    keys = [pa.array([k[0] for k in groups], pa.int64()), pa.array([k[1] for k in groups], pa.int32())]
    return pa.RecordBatch.from_arrays([*keys, *[pa.array([c[i] for c in cells], k) for i, k in enumerate(kinds)]], names=["range", "guest", "doc_ids", "lengths", "data"])


def unpacked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows again, of which those of ``near`` have no text."""
    names = ["range", "guest", "doc_id", "text", *NEAR]
    open_ = zstandard.ZstdDecompressor()
    for b in batches:
        for i in range(b.num_rows):
            where, guest, docs, lengths, data, *note = (b.column(c)[i].as_py() for c in ("range", "guest", "doc_ids", "lengths", "data", *NEAR))
            n = len(docs)
            if data is None:
                text = pa.nulls(n, pa.string())
            else:
                at = np.concatenate([[0], np.cumsum(lengths)]).astype(np.int64)
                text = pa.LargeStringArray.from_buffers(n, pa.py_buffer(at), pa.py_buffer(open_.decompress(data))).cast(pa.string())
            yield pa.RecordBatch.from_arrays([pa.array(np.full(n, where, np.int64)), pa.array(np.full(n, guest, np.int32)), pa.array(docs, pa.int64()), text,
                                              *[pa.array([x] * n, pa.int64()) for x in note]], names=names)


def edited_fingerprints(docs: DataFrame, near: DataFrame | None = None, ranges_per_task: int = 4) -> DataFrame:
    """Fingerprints of every text and of its edited text, with class_id and n_near of ``near``.

    Documents are dealt into ranges of doc_id between approximate quantiles, so the next document is in the same range; the
    first document of the next range, one per range, is sent along. The texts are shuffled once, compressed. Null ids come
    after all others, equal ids are ordered by text. An empty table has no rows. Rows of ``near_documents`` travel along by range, without the
    texts being shuffled again; a row that has none there, or no ``near`` given, is a class of its own without near ones.
    """
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    base = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    n = max(2, parts * ranges_per_task)
    cuts = sorted({int(x) for x in base.select("doc_id").where("doc_id is not null").approxQuantile("doc_id", [i / n for i in range(1, n)], 0.25 / n)})
    splits = np.array(cuts, np.int64)

    def range_numbers(ids: pa.Array) -> np.ndarray:
        known = ids.fill_null(0).to_numpy(zero_copy_only=False)
        return np.where(ids.is_valid().to_numpy(zero_copy_only=False), np.searchsorted(splits, known, side="right"), -1)

    @F.arrow_udf("long")
    def range_of(ids: pa.Array) -> pa.Array:
        return pa.array(range_numbers(ids), pa.int64())

    # one row per range: the largest id of each, which the range above needs as well
    heads = sorted(base.select("doc_id").withColumn("range", range_of("doc_id")).groupBy("range").agg(F.max("doc_id").alias("head")).collect(), key=lambda r: r["range"])
    goes_to = {r["head"]: heads[(i + 1) % len(heads)]["range"] for i, r in enumerate(heads)}

    placed = packed(base, range_numbers, goes_to).select("*", *[F.lit(None).cast("long").alias(c) for c in NEAR])
    if near is not None:  # rows without text, before those with
        told = near.where("class_id <> doc_id or n_near > 0").select("doc_id", *NEAR).distinct()
        none = [F.lit(None).cast(t).alias(c) for c, t in (("lengths", "array<long>"), ("data", "binary"))]
        placed = placed.union(told.select(range_of("doc_id").alias("range"), F.lit(0).alias("guest"), F.array("doc_id").alias("doc_ids"), *none, *NEAR))
    placed = placed.repartition(parts, "range").mapInArrow(unpacked, "range long, guest int, doc_id long, text string, " + ", ".join(f"{c} long" for c in NEAR))
    placed = placed.sortWithinPartitions("range", "guest", F.col("doc_id").desc_nulls_last(), "text")

    def run(batches):
        hold, first = None, None  # the row that waits for its next one; whether a guest of this range was met
        about, notes = None, {}  # the id that rows without text told of, and what they told by digest
        for b in batches:
            for small in (b.slice(i, 128) for i in range(0, b.num_rows, 128)):
                rows, texts = [], small.column("text").to_pylist()
                sets = signature_sets(texts)
                for sigs, where, is_guest, doc, text, *note in zip(sets, *(small.column(c).to_pylist() for c in ("range", "guest", "doc_id")), texts, *(small.column(c).to_pylist() for c in NEAR)):
                    if text is None:
                        if about != doc:
                            about, notes = doc, {}
                        notes[tuple(note[:2])] = note[2:]
                        continue
                    if is_guest and first == where:
                        continue
                    if hold is not None and hold[0] == where:
                        rows.append((*hold[1:], text, sigs))
                    told = notes.get(digest(sigs), (doc, 0)) if about == doc else (doc, 0)
                    hold = None if is_guest else (where, doc, told, text, sigs)
                    first = where if is_guest else None
                yield output(rows)

    return placed.mapInArrow(run, "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double, class_id long, n_near long")


def output(rows: list[tuple]) -> pa.RecordBatch:
    docs, told, texts, sets, after, after_sets = zip(*rows) if rows else [()] * 6
    edited = [text[: len(text) - len(text) // 2] + more[: len(text) // 2] for text, more in zip(texts, after)]
    edited_sets = signature_sets(edited)
    columns = {
        "doc_id": pa.array(docs, pa.int64()), "n_chars": pa.array(map(len, texts), pa.int64()),
        "edited_sha256": pa.array([hashlib.sha256(e.encode("utf-8", "replace")).hexdigest() for e in edited], pa.string()),
        "fingerprint": pa.array(map(fingerprint, sets), pa.string()), "edited_fingerprint": pa.array(map(fingerprint, edited_sets), pa.string()),
        "near_edited": pa.array(likenesses(sets, edited_sets)), "near_next": pa.array(likenesses(sets, after_sets)),
        "class_id": pa.array([t[0] for t in told], pa.int64()), "n_near": pa.array([t[1] for t in told], pa.int64())}
    return pa.RecordBatch.from_arrays(list(columns.values()), names=list(columns))
