"""Token files: blocks, whole tables against the library, edge rows."""

import zlib
from functools import lru_cache

import numpy as np
import pytest
from cases import EDGE
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from showgrid.llm import rans, tokenfiles
from tokenizers import Tokenizer


@lru_cache
def library():
    t = Tokenizer.from_file(tokenfiles.MODEL)
    t.encode_special_tokens = True
    return t


def expected(rows):
    """Straight from the library, whole texts one by one."""
    t, start, out = library(), 0, []
    for d, text in sorted(rows, key=lambda r: (r[0] is not None, r[0], len(r[1] or ""))):
        ids = t.encode(text or "", add_special_tokens=False).ids + [2]
        out.append((d, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    return out


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(0, 60000), max_size=400), st.sampled_from([1, 2, 256]), st.sampled_from([1, 3, 128]))
def test_block_round_trip(ids, lanes, steps):
    ids = np.array(ids, np.int64)
    table = rans.Table(*np.unique(ids, return_counts=True))
    block = rans.encode(ids, table, lanes, steps)
    assert (rans.decode(block, table) == ids).all()
    a, b = len(ids) // 3, len(ids) // 3 * 2 + 1
    assert (rans.decode(block, table, a, b) == ids[a:b]).all()


def test_long_block_is_small_and_guarded():
    rng = np.random.default_rng(1)
    ids = np.minimum(rng.zipf(1.3, 300_001), 50_000)
    names, counts = np.unique(ids, return_counts=True)
    table = rans.Table(names, counts)
    assert int(table.freq.sum()) == 1 << table.bits and table.freq.min() >= 1
    block = rans.encode(ids, table)
    entropy = -(counts * np.log2(counts / len(ids))).sum() / 8
    assert (rans.decode(block, table) == ids).all() and len(block) < 1.1 * entropy
    assert (rans.decode(block, table, 123_456, 200_000) == ids[123_456:200_000]).all()
    broken = bytearray(block)
    broken[len(block) // 2] ^= 1
    with pytest.raises(ValueError, match="checksum"):
        rans.decode(bytes(broken), table)
    with pytest.raises(ValueError, match="another frequency table"):
        rans.decode(block, rans.Table(names, counts[::-1]))
    with pytest.raises(ValueError, match="not in the table"):
        rans.encode(np.array([60_000]), table)
    assert (rans.decode(rans.encode(np.full(5000, 7), one := rans.Table(np.array([7]), np.array([5000]))), one) == 7).all()


@settings(max_examples=150, deadline=None)
@given(st.text(st.sampled_from("ab' .,$#é\n\t 　\x1c é1.,'st<|endoftext|>😀"), max_size=60))
def test_cut_texts_have_the_ids_of_whole_texts(text):
    ids, n = tokenfiles.text_encoder(tokenfiles.MODEL, 2).encode([text, text])
    want = library().encode(text, add_special_tokens=False).ids + [2]
    assert ids.tolist() == want * 2 and n.tolist() == [len(want)] * 2


@settings(max_examples=150, deadline=None)
@given(st.lists(st.text(st.sampled_from("ab'sdtrevmlL 09.,!-_éÿß×ª\n\n\t\r\x85\xa0\0日"), min_size=1, max_size=9), max_size=12))
def test_parts_of_new_pieces_have_the_ids_of_whole_texts(words):
    text = " ".join(["a", *words])
    ids, _ = tokenfiles.TextEncoder.encode(parts_encoder(), [text])
    assert ids.tolist() == library().encode(text, add_special_tokens=False).ids + [2]


@lru_cache
def parts_encoder():
    return tokenfiles.TextEncoder(tokenfiles.MODEL, 2)


def test_ordinary_words_spare_the_library_its_passes(monkeypatch):
    """New pieces of ordinary words are looked up by their parts; the library's passes get the rest only. A small store of parts changes nothing."""
    monkeypatch.setattr(tokenfiles, "CACHE_PARTS", 50)
    encoder, passed = tokenfiles.TextEncoder(tokenfiles.MODEL, 2), []
    real = encoder.library

    class Watched:
        model = real.model

        def encode(self, text, **more):
            passed.append(text)
            return real.encode(text, **more)

    encoder.library = Watched()
    texts = ["x " + " ".join(f"word{k}{i}.\nNext'll été{i}," for i in range(300)) + " " + "y" * 5000 + " 日本" for k in range(3)]
    for t in texts:
        ids, _ = encoder.encode([t])
        assert ids.tolist() == library().encode(t, add_special_tokens=False).ids + [2]
    assert sum(map(len, passed)) < 20 and max(map(len, encoder.parts)) <= tokenfiles.LONG_PART


def test_full_cache_changes_nothing(monkeypatch, small_rows):
    monkeypatch.setattr(tokenfiles, "CACHE_PIECES", 300)
    monkeypatch.setattr(tokenfiles, "TOGETHER", 500)
    encoder = tokenfiles.TextEncoder(tokenfiles.MODEL, 2)
    for _, t in small_rows[:60] + [(i, t) for i, t, _ in EDGE]:
        ids, n = encoder.encode([t or ""])
        assert ids.tolist() == library().encode(t or "", add_special_tokens=False).ids + [2] and n.tolist() == [len(ids)]


def test_whole_table_against_the_library(spark):
    folder = "/root/testdata/sf0.01"
    rows = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "text").collect()]
    got = sorted(map(tuple, tokenfiles.op11(spark, folder).collect()), key=lambda r: r[1])
    assert got == expected(rows)


def test_edge_rows(spark, edge, empty, tmp_path):
    """Nulls, empty and very long texts, repeated ids and rows, a null id, an empty table."""
    more = edge.where("doc_id in (4, 7)").unionByName(edge.where("doc_id = 12").withColumn("doc_id", F.lit(None).cast("long"))).unionByName(
        edge.where("doc_id = 5").withColumn("doc_id", F.lit(4).cast("long")))
    rows = [(d, t) for d, t, _ in EDGE] + [(4, EDGE[3][1]), (7, EDGE[6][1]), (None, EDGE[11][1]), (4, EDGE[4][1])]
    folder = str(tmp_path / "edge")
    tokenfiles.write_tokens(edge.unionByName(more), folder, block_ids=64)
    assert sorted(map(tuple, tokenfiles.read_digests(spark, folder).collect()), key=lambda r: r[1]) == expected(rows)
    t = library()
    for r in tokenfiles.read_tokens(spark, folder).where("doc_id is not null").collect():
        text = dict(rows)[r["doc_id"]] or ""
        assert r["ids"][-1] == 2 and t.decode(r["ids"][:-1]) == text
    every = [i for r in sorted(tokenfiles.read_tokens(spark, folder).collect(), key=lambda r: r["start"]) for i in r["ids"]]
    span = sorted(map(tuple, tokenfiles.read_span(spark, folder, 1000, 5000).collect()))
    assert span == list(enumerate(every))[1000:5000]
    tokenfiles.write_tokens(empty, folder + "0")
    assert tokenfiles.read_digests(spark, folder + "0").count() == 0
