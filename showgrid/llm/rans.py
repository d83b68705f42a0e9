"""Static range asymmetric numeral system (rANS): byte blocks of token ids under one shared frequency table.

A block is cut into segments, a segment into lanes that take turns token by token. Every lane has a state of its own, so numpy
steps all lanes of all segments at once. The states at the start of a segment and its place among the words are the checkpoint
from which it is decoded without the others. A checksum closes the block.

Block, little-endian: magic, table checksum, lanes, segments, steps (u32 each), tokens, words (u64 each); first word of each segment (u64); start
states by segment and lane (u64); words (u32); CRC-32 of all bytes before (u32).
"""

from __future__ import annotations

import struct
import zlib

import numpy as np

MAGIC = 0x31534E52  # "RNS1"
HEAD = struct.Struct("<5I2Q")
#: Lanes of a segment, and steps after which a segment ends.
LANES, STEPS = 256, 128
LOW = np.uint64(1 << 31)  # states stay in [LOW, LOW << 32)
BITS = 18


class Table:
    """Frequencies of all ids that occur, scaled to ``2**bits`` with at least 1 each."""

    def __init__(self, ids: np.ndarray, counts: np.ndarray, bits: int = BITS):
        order = np.argsort(ids)
        self.ids, counts = np.asarray(ids)[order].astype(np.int64), np.asarray(counts)[order].astype(np.int64)
        k = len(self.ids)
        self.bits = bits = max(bits, (max(k, 1) - 1).bit_length() + 2)
        if bits > 31:
            raise ValueError("too many different ids")
        spare = (1 << bits) - k
        share = counts / max(int(counts.sum()), 1) * spare
        freq = 1 + np.floor(share).astype(np.int64)
        left = (1 << bits) - int(freq.sum()) if k else 0
        most = np.lexsort((self.ids, -(share - np.floor(share))))[: left % max(k, 1)]
        freq[most] += 1
        if k:  # what rounding of doubles may leave over
            freq[int(np.argmax(freq))] += (1 << bits) - int(freq.sum())
        self.freq = freq.astype(np.uint64)
        self.start = (np.cumsum(freq) - freq).astype(np.uint64)
        self.slot = np.repeat(np.arange(k, dtype=np.int32), freq)
        self.pad = int(np.argmax(freq)) if k else 0
        self.place = np.full(int(self.ids.max(initial=-1)) + 1, -1, np.int32)
        self.place[self.ids] = np.arange(k)
        self.checksum = zlib.crc32(np.concatenate([self.ids, freq, [bits]]).astype("<i8").tobytes())

    def symbols(self, ids: np.ndarray) -> np.ndarray:
        if len(ids) and int(ids.max()) >= len(self.place) or len(at := self.place[ids]) and int(at.min()) < 0:
            raise ValueError("an id is not in the table")
        return at


def encode(ids: np.ndarray, table: Table, lanes: int = LANES, steps: int = STEPS) -> bytes:
    """One block. Short ones get fewer lanes, so that their states don't outweigh them."""
    n = len(ids)
    while lanes > 1 and n < lanes * steps // 4:
        lanes //= 2
    segments = max(1, -(-n // (lanes * steps)))
    steps = -(-n // (lanes * segments))
    sym = np.full(segments * steps * lanes, table.pad, np.int32)
    sym[:n] = table.symbols(ids)
    sym = np.ascontiguousarray(sym.reshape(segments, steps, lanes).transpose(1, 0, 2)).reshape(steps, segments * lanes)
    bits, half, room = np.uint64(table.bits), np.uint64(32), np.uint64(63 - table.bits)
    x = np.full(segments * lanes, LOW)
    out_words, out_lane = [], []
    for t in range(steps - 1, -1, -1):
        f = table.freq[sym[t]]
        full = np.flatnonzero(x >= f << room)  # these states give off a word first
        out = x[full]
        out_words.append(out.astype(np.uint32))
        out_lane.append(full)
        x[full] = out >> half
        q = x // f
        x += q * ((np.uint64(1) << bits) - f) + table.start[sym[t]]
    words = np.concatenate(out_words[::-1]) if steps else np.zeros(0, np.uint32)
    segment = np.concatenate(out_lane[::-1]) // lanes if steps else np.zeros(0, np.int64)
    words = words[np.argsort(segment, kind="stable")]
    size = np.bincount(segment, minlength=segments)
    first = np.cumsum(size) - size
    body = b"".join([HEAD.pack(MAGIC, table.checksum, lanes, segments, steps, n, len(words)), first.astype("<u8").tobytes(),
                     x.astype("<u8").tobytes(), words.astype("<u4").tobytes()])
    return body + struct.pack("<I", zlib.crc32(body))


def decode(block: bytes, table: Table, begin: int = 0, end: int | None = None) -> np.ndarray:
    """Ids ``begin`` to ``end`` of a block; only the segments that hold them are decoded, side by side from their checkpoints."""
    block = memoryview(block)
    if len(block) < HEAD.size + 4 or zlib.crc32(block[:-4]) != struct.unpack("<I", block[-4:])[0]:
        raise ValueError("block is damaged: checksum differs")
    magic, checksum, lanes, segments, steps, n, n_words = HEAD.unpack_from(block)
    if magic != MAGIC:
        raise ValueError("not a block of token ids")
    if checksum != table.checksum:
        raise ValueError("block was written with another frequency table")
    end = n if end is None else min(end, n)
    begin = max(0, begin)
    if begin >= end:
        return np.zeros(0, np.int64)
    size = steps * lanes
    lo, hi = begin // size, -(-end // size)
    at = HEAD.size
    pos = np.frombuffer(block, "<u8", segments, at)[lo:hi].astype(np.int64)
    at += 8 * segments
    x = np.frombuffer(block, "<u8", segments * lanes, at).reshape(segments, lanes)[lo:hi].astype(np.uint64)
    words = np.frombuffer(block, "<u4", n_words, at + 8 * segments * lanes).astype(np.uint64)
    x = x.ravel()
    out = np.empty((steps, len(x)), np.int32)
    bits, half, mask = np.uint64(table.bits), np.uint64(32), np.uint64((1 << table.bits) - 1)
    for t in range(steps):
        slot = x & mask
        s = out[t] = table.slot[slot.view(np.int64)]
        x = table.freq[s] * (x >> bits) + slot - table.start[s]
        low = np.flatnonzero(x < LOW)
        seg = low // lanes
        count = np.bincount(seg, minlength=hi - lo)
        word = np.arange(len(low)) + (pos - np.cumsum(count) + count)[seg]
        x[low] = (x[low] << half) | words[word]
        pos += count
    ids = table.ids[out.reshape(steps, hi - lo, lanes).transpose(1, 0, 2).ravel()]
    return ids[begin - lo * size : end - lo * size]
