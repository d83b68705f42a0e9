"""SentencePiece encoding and decoding with the pieces and scores of a model file.

An Aho-Corasick automaton over the pieces reads a text once. At each position its output links give all pieces that end
there, longest first, and each relaxes the best score of its end: a single-pass Viterbi. A character without a piece costs
``UNKNOWN_COST`` below the lowest score and is written as its bytes, if the model has byte pieces.
"""

from __future__ import annotations

import hashlib
import os
from array import array

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from showgrid.llm.common import documents
from showgrid.llm.queries import query

MODEL = os.environ.get("SHOWGRID_PIECES", "/opt/tokenizers/piece_bpe_32k.model")
SPACE = "▁"
UNKNOWN_COST = 10.0
#: Segments up to this length are remembered, and so many of them in a worker before it starts anew.
REMEMBER_CHARS, REMEMBER = 48, 200_000
NORMAL, UNKNOWN, USER, BYTE = 1, 2, 4, 6


class Pieces:
    """The automaton of one model file. Control pieces never match text."""

    def __init__(self, model_file: str):
        import ahocorasick
        from sentencepiece import sentencepiece_model_pb2 as pb

        proto = pb.ModelProto()
        with open(model_file, "rb") as f:
            proto.ParseFromString(f.read())
        spec = proto.normalizer_spec
        if spec.precompiled_charsmap or not spec.escape_whitespaces:
            raise ValueError("only models with identity normalization are supported")
        self.prefix, self.squeeze = spec.add_dummy_prefix, spec.remove_extra_whitespaces
        self.text = [p.piece for p in proto.pieces]
        self.kind = [p.type for p in proto.pieces]
        scores = [p.score for p in proto.pieces if p.type == NORMAL]
        self.unknown_score = (min(scores) if scores else 0.0) - UNKNOWN_COST
        self.unknown_id = next((i for i, k in enumerate(self.kind) if k == UNKNOWN), 0)
        self.bytes = {int(p.piece[3:5], 16): i for i, p in enumerate(proto.pieces) if p.type == BYTE}
        self.byte_of = {i: b for b, i in self.bytes.items()}
        #: UTF-8 bytes of every id; control pieces are empty.
        self.raw = [bytes([self.byte_of[i]]) if k == BYTE else p.replace(SPACE, " ").encode() if k in (NORMAL, USER) else " ⁇ ".encode() if k == UNKNOWN else b""
                    for i, (p, k) in enumerate(zip(self.text, self.kind))]
        self.automaton = ahocorasick.Automaton()
        best = max(scores) if scores else 0.0
        for i, p in enumerate(proto.pieces):
            if p.type in (NORMAL, USER) and p.piece:
                self.automaton.add_word(p.piece, (len(p.piece), p.score if p.type == NORMAL else best * len(p.piece) - 0.1, i))
        self.automaton.make_automaton()
        #: No piece has a space mark after another character: the best path of a text is that of its words, one by one.
        self.by_word = not any(SPACE in p.piece.lstrip(SPACE) for p in proto.pieces if p.type in (NORMAL, USER))
        self.seen: dict[str, array] = {}

    def viterbi(self, s: str) -> array:
        """Ids of the best path; of equal paths the one whose last piece is longest, at every position."""
        n = len(s)
        score, start, piece = [0.0] * (n + 1), [0] * (n + 1), [-1] * (n + 1)
        alone = bytearray(n + 1)  # 1 where a piece of one character ends
        unknown, unknown_id, done = self.unknown_score, self.unknown_id, 0
        for last, (length, value, i) in self.automaton.iter(s):
            while done < last:  # no more pieces end at these positions
                done += 1
                if not alone[done] and (piece[done] < 0 or score[done - 1] + unknown > score[done]):
                    score[done], start[done], piece[done] = score[done - 1] + unknown, done - 1, unknown_id
            end = last + 1
            if length == 1:
                alone[end] = 1
            total = score[end - length] + value
            if piece[end] < 0 or total > score[end]:
                score[end], start[end], piece[end] = total, end - length, i
        while done < n:
            done += 1
            if not alone[done] and (piece[done] < 0 or score[done - 1] + unknown > score[done]):
                score[done], start[done], piece[done] = score[done - 1] + unknown, done - 1, unknown_id
        path = array("i")
        while n:
            if piece[n] == self.unknown_id and self.bytes:
                path.extend(self.bytes[b] for b in reversed(s[start[n] : n].encode("utf-8", "replace")))
            elif not (piece[n] == self.unknown_id and path and path[-1] == self.unknown_id):
                path.append(piece[n])
            n = start[n]
        path.reverse()
        return path

    def word(self, s: str) -> array:
        """Ids of a word behind one space mark, remembered if it is short."""
        found = self.viterbi(SPACE + s)
        if len(s) <= REMEMBER_CHARS:
            if len(self.seen) >= REMEMBER:
                self.seen.clear()
            self.seen[s] = found
        return found

    def normalize(self, text: str) -> str:
        if self.squeeze:
            text = " ".join(x for x in text.split(" ") if x)
        return SPACE + text.replace(" ", SPACE) if self.prefix and text else text.replace(" ", SPACE)

    def encode(self, text: str | None, out: array) -> None:
        """Append the ids of a text to ``out``; nothing for an empty or null text."""
        s = self.normalize(text or "")
        if not self.by_word:
            out.extend(self.viterbi(s))
            return
        parts = s.split(SPACE)
        if parts[0]:
            out.extend(self.viterbi(parts[0]))
        seen, add, marks = self.seen.get, out.extend, SPACE
        for p in parts[1:]:
            if not p:
                marks += SPACE
            elif marks is SPACE:
                found = seen(p)
                add(self.word(p) if found is None else found)
            else:
                add(self.viterbi(marks + p))
                marks = SPACE
        if len(parts) > 1 and not parts[-1]:  # spaces at the end
            add(self.viterbi(marks[1:]))

    def decode(self, ids) -> str:
        """Text of the ids: pieces and bytes joined, marks as spaces, without the one that encoding puts in front."""
        raw = self.raw
        text = b"".join([raw[i] for i in ids]).decode("utf-8", "replace")
        return text[1:] if self.prefix and text.startswith(" ") else text


_loaded: dict[str, Pieces] = {}


def pieces(model_file: str) -> Pieces:
    if model_file not in _loaded:
        _loaded[model_file] = Pieces(model_file)
    return _loaded[model_file]


def encode(docs: DataFrame, model_file: str = MODEL, text: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """``keep`` columns with ``ids`` (array of int). Null and empty texts have an empty array; equal texts equal ids.

    Rows are independent and nothing is shuffled; other columns are left out.
    """
    rows = docs.select(*keep, F.col(text).alias("_text"))
    schema = docs.select(*keep, F.array().cast("array<int>").alias("ids")).schema

    def run(batches):
        model = pieces(model_file)
        for b in batches:
            for part in (b.slice(i, 256) for i in range(0, b.num_rows, 256)):
                flat, ends = array("i"), [0]
                for t in part.column("_text"):
                    model.encode(t.as_py(), flat)
                    ends.append(len(flat))
                ids = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.frombuffer(flat, np.int32) if flat else np.zeros(0, np.int32)))
                yield pa.RecordBatch.from_arrays([*[part.column(c) for c in keep], ids], names=[*keep, "ids"])

    return rows.mapInArrow(run, schema)


def decode(encoded: DataFrame, model_file: str = MODEL) -> DataFrame:
    """``encoded`` with ``decoded``, the text of ``ids``; the text of no or null ids is empty."""
    names = encoded.columns
    schema = encoded.select("*", F.lit("").alias("decoded")).schema

    def run(batches):
        model = pieces(model_file)
        for b in batches:
            for part in (b.slice(i, 256) for i in range(0, b.num_rows, 256)):
                text = [model.decode(x.as_py() or ()) for x in part.column("ids")]
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(text, pa.string())], names=[*names, "decoded"])

    return encoded.mapInArrow(run, schema)


def encode_decode(docs: DataFrame, model_file: str = MODEL) -> DataFrame:
    """doc_id, n_ids, ids, decoded_sha256 and ``round_trip``: the decoded text is the text. A null text is as an empty one.

    The round trip is exact for every text without the mark U+2581 itself, which decodes to a space.
    """
    schema = "doc_id long, n_ids long, ids array<int>, decoded_sha256 string, round_trip boolean"

    def run(batches):
        model = pieces(model_file)
        for b in batches:
            for part in (b.slice(i, 256) for i in range(0, b.num_rows, 256)):
                flat, ends, digest, same = array("i"), [0], [], []
                for t in part.column("text"):
                    t = t.as_py() or ""
                    model.encode(t, flat)
                    back = model.decode(flat[ends[-1] :])
                    ends.append(len(flat))
                    digest.append(hashlib.sha256(back.encode("utf-8", "replace")).hexdigest())
                    same.append(back == t)
                ids = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.frombuffer(flat, np.int32) if flat else np.zeros(0, np.int32)))
                count = pa.array(np.diff(np.array(ends, np.int64)))
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), count, ids, pa.array(digest, pa.string()), pa.array(same, pa.bool_())],
                                                 names=["doc_id", "n_ids", "ids", "decoded_sha256", "round_trip"])

    return docs.select("doc_id", "text").mapInArrow(run, schema)


@query("op2_pieces")
def op2(spark, folder):
    return encode_decode(documents(spark, folder))
