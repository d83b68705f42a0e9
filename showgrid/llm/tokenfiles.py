"""Token ids of documents in files of rANS blocks (see ``rans``), in ascending order of the documents.

A folder holds ``table`` (id, count: the shared frequency table) and ``blocks``: Parquet files whose rows are blocks with the number of the
part they are in, the place of their first id in the part, the ids of their documents, the lengths, and the coded bytes. Spark commits the
files, so a lost executor leaves no half ones, and blocks are decoded apart from each other.
"""

from __future__ import annotations

import json
import re
import zlib
from array import array
from functools import lru_cache
from operator import itemgetter

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W
from tokenizers import Tokenizer

from showgrid.llm import rans
from showgrid.llm.common import documents, list_rows, remove, shared_folder
from showgrid.llm.queries import query

MODEL = public_tokenizers.path("byte_bpe_50k.json")
END = 2
#: A block is closed by the document that brings it to so many ids.
BLOCK_IDS = 1 << 18
#: Characters of texts that are put together at a time, characters of new pieces that the library gets at once, and pieces and ids of the
#: cache of a task, which forgets half of them beyond; parts that it keeps, and the characters of the longest of those.
CHUNK_CHARS, TOGETHER, CACHE_PIECES, CACHE_IDS = 1 << 21, 1 << 15, 3 << 19, 1 << 23
CACHE_PARTS, LONG_PART = 3 << 17, 64
BLOCKS = "part int, first long, n_ids long, doc_ids array<long>, lengths array<long>, data binary"
def byte_names() -> dict[int, str]:
    """The character by which a byte-level model names each byte: the visible ones by themselves, the others by those from U+0100 on."""
    seen = [*range(33, 127), *range(161, 173), *range(174, 256)]
    return {b: chr(b) for b in seen} | {b: chr(256 + i) for i, b in enumerate(b for b in range(256) if b not in seen)}


#: A space with white space beside it; a space between two other characters.
SECOND = itemgetter(1)
NEAR_SPACE, LONE_SPACE = re.compile(r" (?:\s|(?<=\s ))"), re.compile(r" (?<=\S )(?=\S)")
#: Pieces of a space, ASCII and Latin-1 letters, without white space at the other ends, and how a byte-level tokenizer cuts them into parts. Beyond these characters
#: the library alone says what a letter is.
LATIN = "A-Za-zÀ-ÖØ-öø-ÿ"
SIMPLE = re.compile(r" [!-~À-ÖØ-öø-ÿ]+(?:[ \n\t]+[!-~À-ÖØ-öø-ÿ]+)*")
PART = re.compile(rf"'s|'t|'re|'ve|'m|'ll|'d| ?[{LATIN}]+| ?[0-9]+| ?[^\s{LATIN}0-9]+|\s+(?!\S)|\s+")
BYTE_NAMES = byte_names()


class Pieces(dict):
    """Number of each piece of text; a new piece gets the next number and waits for its ids."""

    def __init__(self, owner: "TextEncoder", prefix: str):
        super().__init__()
        self.owner, self.prefix = owner, prefix

    def __missing__(self, piece: str) -> int:
        number = self[piece] = self.owner.count
        self.owner.count += 1
        self.owner.waiting.append(self.prefix + piece)
        return number


def is_byte_level(library: Tokenizer) -> bool:
    """Whether texts are only cut by the usual pattern and named by bytes before the model gets them."""
    told = json.loads(library.to_str())
    before = told["pre_tokenizer"] or {}
    return (before.get("type") == "ByteLevel" and before.get("use_regex", True) and not before["add_prefix_space"] and told["normalizer"] is None
            and told["model"]["type"] == "BPE" and all(t["special"] for t in told["added_tokens"]))


class TextEncoder:
    """Ids of whole texts by the tokenizers library, which is asked once for each distinct piece while the cache lasts.

    The tokenizer never merges across a space that stands between two characters other than white space: a piece of its own begins there. So a
    text may be cut at such spaces, and the ids of the parts one after another are those of the text. Text that spells a special token is ordinary text.
    """

    def __init__(self, model: str, end: int):
        self.library = Tokenizer.from_file(model)
        self.library.encode_special_tokens = True
        self.parts, self.simple = {}, SIMPLE.fullmatch if is_byte_level(self.library) else lambda piece: None
        self.first, self.later = Pieces(self, ""), Pieces(self, " ")
        self.count, self.waiting = 1, []  # piece 0 is the end id
        self.flat, self.starts, self.sizes, self.uses = np.array([end], np.uint32), np.zeros(1, np.int64), np.ones(1, np.int64), np.zeros(1, np.int64)

    def forget(self) -> None:
        """Drops the pieces used least, so that at most half of the cache stays."""
        least = max(2, int(np.partition(self.uses, len(self.uses) // 2)[len(self.uses) // 2]) + 1)
        keep = self.uses >= least
        keep[0] = True
        if self.sizes[keep].sum() > CACHE_IDS // 2:
            keep[1:] = False
        number = np.cumsum(keep) - 1
        for pieces in (self.first, self.later):
            kept = [(p, int(number[n])) for p, n in pieces.items() if keep[n]]
            pieces.clear()
            pieces.update(kept)
        sizes = self.sizes[keep]
        ends = np.cumsum(sizes)
        self.flat = self.flat[np.arange(ends[-1]) + np.repeat(self.starts[keep] - (ends - sizes), sizes)]
        self.starts, self.sizes, self.uses, self.count = ends - sizes, sizes, np.zeros(len(sizes), np.int64), len(sizes)

    def learn(self) -> None:
        """Finds the ids of new pieces: of simple ones by their parts, of others from the library. Those that begin with a space and have none after it or at the end are taken many at a time, as parts of one text."""
        waiting, self.waiting = self.waiting, []
        starts, sizes, flat, have = np.zeros(len(waiting), np.int64), np.zeros(len(waiting), np.int64), [self.flat], len(self.flat)
        simple = np.fromiter((self.simple(p) is not None for p in waiting), bool, len(waiting))
        rest = np.flatnonzero(~simple).tolist()
        joined = [i for i in rest if (p := waiting[i])[:1] == " " and len(p) > 1 and not p[1].isspace() and not p[-1].isspace()]
        for i in sorted(set(rest).difference(joined)):
            flat.append(np.array(self.library.encode(waiting[i], add_special_tokens=False).ids, np.uint32))
            starts[i], sizes[i] = have, len(flat[-1])
            have += len(flat[-1])
        for run, ids, upto in (*self.by_parts(waiting, np.flatnonzero(simple)), *self.by_library(waiting, np.array(joined, np.int64))):
            flat.append(ids)
            sizes[run] = np.diff(upto, prepend=0)
            starts[run] = have + upto - sizes[run]
            have += len(ids)
        self.starts, self.sizes = np.concatenate([self.starts, starts]), np.concatenate([self.sizes, sizes])
        self.uses = np.concatenate([self.uses, np.zeros(len(sizes), np.int64)])
        self.flat = np.concatenate(flat)

    def by_parts(self, waiting: list[str], run: np.ndarray):
        """(run, ids, number of ids up to the end of each) of simple pieces. The library's model is asked for new parts, without its passes over the text that come before."""
        if len(self.parts) > CACHE_PARTS:
            self.parts.clear()
        if len(run):
            pieces = [waiting[i] for i in run.tolist()]
            parts = PART.findall("".join(pieces))
            new, tokenize = list(set(parts).difference(self.parts)), self.library.model.tokenize
            names = "\0".join(new).encode().decode("latin-1").translate(BYTE_NAMES).split(BYTE_NAMES[0])
            known = self.parts
            known.update(zip(new, [array("I", [t.id for t in tokenize(n)]).tobytes() for n in names]))
            cells = [known[p] for p in parts]
            for p in new:
                if len(p) > LONG_PART:
                    del known[p]
            ends = np.cumsum(np.fromiter(map(len, parts), np.int64, len(parts)))
            upto = np.cumsum(np.fromiter(map(len, cells), np.int64, len(cells)) // 4)
            yield run, np.frombuffer(b"".join(cells), np.uint32), upto[np.searchsorted(ends, np.cumsum(list(map(len, pieces))))]

    def by_library(self, waiting: list[str], joined: np.ndarray):
        """The same of other pieces, about ``TOGETHER`` characters at a time."""
        ends = np.cumsum([len(waiting[i]) for i in joined.tolist()])
        for run in np.split(joined, np.flatnonzero(np.diff(ends // TOGETHER)) + 1) if len(joined) else []:
            pieces = [waiting[i] for i in run.tolist()]
            found = self.library.encode("".join(pieces), add_special_tokens=False)
            last = np.fromiter(map(SECOND, found.offsets), np.int64, len(found.ids)) - 1  # a leading space may have been taken off the offsets, never the end
            yield run, np.array(found.ids, np.uint32), np.searchsorted(last, np.cumsum(list(map(len, pieces))))

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """All ids of the texts, each closed by the end id, and the number of ids of each."""
        if self.count > CACHE_PIECES or len(self.flat) > CACHE_IDS:
            self.forget()
        codes, ends = [], []
        first, later = self.first.__getitem__, self.later.__getitem__
        for t in texts:
            parts = LONE_SPACE.split(t) if NEAR_SPACE.search(t) else t.split(" ")
            codes.append(first(parts[0]))
            codes.extend(map(later, parts[1:]))
            codes.append(0)
            ends.append(len(codes))
        self.learn()
        codes = np.array(codes, np.int64)
        self.uses += np.bincount(codes, minlength=self.count)
        sizes = self.sizes[codes]
        total = np.cumsum(sizes)
        where = np.arange(total[-1] if len(total) else 0) + np.repeat(self.starts[codes] - (total - sizes), sizes)
        upto = total[np.array(ends, np.int64) - 1] if ends else np.zeros(0, np.int64)
        return self.flat[where], np.diff(upto, prepend=0)


@lru_cache(2)
def text_encoder(model: str, end: int) -> TextEncoder:
    return TextEncoder(model, end)


def chunks(texts: list[str], chars: int):
    """Runs of texts of about ``chars`` characters, a longer text alone."""
    run, size = [], 0
    for t in texts:
        run.append(t)
        size += len(t)
        if size >= chars:
            yield run
            run, size = [], 0
    if run:
        yield run


def encoded(docs: DataFrame, model: str = MODEL, end: int = END, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """(doc_id, n, ids) of every row; ``ids`` are the bytes of 16-bit ids where the vocabulary allows it, else of 32-bit ones."""
    kind = id_type(model, end)

    def run(batches):
        encoder = text_encoder(model, end)
        for b in batches:
            at = 0
            for texts in chunks([t or "" for t in b.column(1).to_pylist()], CHUNK_CHARS):
                ids, n = encoder.encode(texts)
                ends = np.concatenate([[0], np.cumsum(n)]) * kind.itemsize
                data = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(texts), [None, pa.py_buffer(ends), pa.py_buffer(ids.astype(kind))]).cast(pa.binary())
                yield pa.RecordBatch.from_arrays([b.column(0).slice(at, len(texts)), pa.array(n), data], names=["doc_id", "n", "ids"])
                at += len(texts)

    return docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text")).mapInArrow(run, "doc_id long, n long, ids binary")


def id_type(model: str, end: int) -> np.dtype:
    return np.dtype("<u2" if max(Tokenizer.from_file(model).get_vocab_size(with_added_tokens=True), end + 1) <= 1 << 16 else "<u4")


def id_counts(tokens: DataFrame, kind: np.dtype) -> DataFrame:
    """(id, count) over all rows; one row for each id and task is shuffled."""

    def run(batches):
        total = np.zeros(0, np.int64)
        for b in batches:
            ids = np.frombuffer(b"".join(b.column(0).to_pylist()), kind)
            n = np.bincount(ids, minlength=len(total))
            n[: len(total)] += total
            total = n
        seen = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(seen), pa.array(total[seen])], names=["id", "n"])

    return tokens.select("ids").mapInArrow(run, "id long, n long").groupBy("id").agg(F.sum("n").alias("count"))


def frequency_table(counts: DataFrame) -> rans.Table:
    """The table on the driver; it has a row for each id of the vocabulary at most."""
    rows = counts.collect()
    return rans.Table(np.array([r["id"] for r in rows], np.int64), np.array([r["count"] for r in rows], np.int64))


def write_tokens(docs: DataFrame, folder: str, model: str = MODEL, end: int = END, text: str = "text", doc_id: str = "doc_id", block_ids: int = BLOCK_IDS) -> None:
    """Writes the ids of all rows of ``docs`` below ``folder``, in ascending order of ``doc_id``.

    A null text is empty; every document is closed by ``end``, so an empty one has one id. A document is never split over blocks, and one
    longer than a block has a block of its own. Null ids come first. Rows that share an id follow each other by length and content; equal rows are interchangeable, and
    a number dealt before the sort lets many of them be split over parts. Other columns are left out; an empty table gives a folder without blocks.
    """
    spark, kind = docs.sparkSession, id_type(model, end)
    numbered = encoded(docs, model, end, text, doc_id).withColumn("tie", F.xxhash64("ids")).withColumn("row", F.monotonically_increasing_id())
    numbered.write.option("compression", "zstd").parquet(f"{folder}/unsorted")
    tokens = spark.read.parquet(f"{folder}/unsorted")
    id_counts(tokens, kind).write.parquet(f"{folder}/table")
    table = frequency_table(spark.read.parquet(f"{folder}/table"))
    order = [F.col("doc_id").asc_nulls_first(), F.col("n"), F.col("tie"), F.col("row")]
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))

    def block(docs_of, sizes, data, part, first):
        ids = np.frombuffer(b"".join(data), kind).astype(np.int64)
        return pa.RecordBatch.from_arrays(
            [pa.array([part], pa.int32()), pa.array([first]), pa.array([len(ids)]), pa.array([docs_of], pa.list_(pa.int64())), pa.array([sizes], pa.list_(pa.int64())),
             pa.array([rans.encode(ids, table)], pa.binary())], names=["part", "first", "n_ids", "doc_ids", "lengths", "data"])

    def run(batches):
        part, first, have = TaskContext.get().partitionId(), 0, 0
        docs_of, sizes, data = [], [], []
        for b in batches:
            for d, n, x in zip(*(b.column(i).to_pylist() for i in range(3))):
                docs_of.append(d)
                sizes.append(n)
                data.append(x)
                have += n
                if have >= block_ids:
                    yield block(docs_of, sizes, data, part, first)
                    first, have = first + have, 0
                    docs_of, sizes, data = [], [], []
        if docs_of:
            yield block(docs_of, sizes, data, part, first)

    sorted_rows = tokens.repartitionByRange(parts, *order).sortWithinPartitions(*order)
    sorted_rows.select("doc_id", "n", "ids").mapInArrow(run, BLOCKS).write.option("compression", "uncompressed").parquet(f"{folder}/blocks")
    remove(spark, f"{folder}/unsorted")


def part_starts(blocks: DataFrame) -> DataFrame:
    """(part, part_start): ids before each part; one row for each written part."""
    sums = blocks.groupBy("part").agg(F.sum("n_ids").alias("n"))
    before = F.sum("n").over(W.orderBy("part").rowsBetween(W.unboundedPreceding, -1))
    return sums.select("part", F.coalesce(before, F.lit(0)).alias("part_start"))


def read_tokens(spark: SparkSession, folder: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids array<int>) of every written document; a damaged block is an error."""
    return read_rows(spark, folder, "ids array<int>", lambda ids, ends: pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(ids.astype(np.int32))))


def read_digests(spark: SparkSession, folder: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32): CRC-32 of the ids as little-endian unsigned 32-bit integers."""

    def crc(ids, ends):
        data = memoryview(ids.astype("<u4").tobytes())
        return pa.array([zlib.crc32(data[4 * a : 4 * b]) for a, b in zip(ends[:-1], ends[1:])], pa.int64())

    return read_rows(spark, folder, "ids_crc32 long", crc)


def read_rows(spark: SparkSession, folder: str, column: str, make) -> DataFrame:
    table = frequency_table(spark.read.parquet(f"{folder}/table"))
    blocks = spark.read.schema(BLOCKS).parquet(f"{folder}/blocks")

    def run(batches):
        for b in batches:
            for i, (docs_of, sizes) in enumerate(zip(list_rows(b.column("doc_ids")), list_rows(b.column("lengths")))):
                ids = rans.decode(b.column("data")[i].as_buffer(), table)
                ends = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int64)
                part, first = b.column("part")[i].as_py(), b.column("first")[i].as_py()
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(len(sizes), part, np.int32)), b.column("doc_ids")[i].values, pa.array(first + ends[:-1]), pa.array(np.asarray(sizes, np.int64)), make(ids, ends)],
                    names=["part", "doc_id", "at", "n_tokens", column.split()[0]])

    rows = blocks.mapInArrow(run, f"part int, doc_id long, at long, n_tokens long, {column}")
    placed = rows.join(F.broadcast(part_starts(blocks)), "part")
    return placed.select("doc_id", (F.col("part_start") + F.col("at")).alias("start"), "n_tokens", column.split()[0])


def read_span(spark: SparkSession, folder: str, begin: int, end: int) -> DataFrame:
    """(position, id) of the ids from ``begin`` to ``end`` of the whole sequence: only blocks and segments that hold some are decoded."""
    table = frequency_table(spark.read.parquet(f"{folder}/table"))
    blocks = spark.read.schema(BLOCKS).parquet(f"{folder}/blocks")
    start = F.col("part_start") + F.col("first")
    wanted = blocks.select("part", "first", "n_ids", "data").join(F.broadcast(part_starts(blocks)), "part").where((start < end) & (start + F.col("n_ids") > begin))

    def run(batches):
        for b in batches:
            for at, data in zip(b.column("at").to_pylist(), b.column("data")):
                ids = rans.decode(data.as_buffer(), table, begin - at, end - at)
                yield pa.RecordBatch.from_arrays([pa.array(max(at, begin) + np.arange(len(ids))), pa.array(ids)], names=["position", "id"])

    return wanted.select(start.alias("at"), "data").mapInArrow(run, "position long, id long")


@query("op11_token_files")
def op11(spark, folder):
    target = shared_folder(spark, "token-files")
    write_tokens(documents(spark, folder), target)
    return read_digests(spark, target)
