"""Repeated word and byte spans, and the structures below them."""

import random

import brute
import numpy as np
import pytest
from cases import EDGE
from pyspark.sql import functions as F
from showgrid.llm import debruijn, suffixes, windows


def test_suffix_array_by_sorting():
    rng = random.Random(3)
    for n in range(600):
        s = bytes(rng.choice(b"ab" if n % 2 else b"abcd\x00\xff") for _ in range(rng.randint(0, 60)))
        assert suffixes.suffix_array(s) == sorted(range(len(s)), key=lambda i: s[i:])
    assert suffixes.suffix_array(b"a" * 5000) == list(range(4999, -1, -1))


def test_runs_cover_all_windows():
    rng = random.Random(4)
    texts = [bytes(rng.choice(b"abc") for _ in range(rng.randint(0, 90))) for _ in range(40)] + [b"x" * 50]
    tokens, sizes = windows.bytes_of(texts)
    runs, _ = windows.chunk_runs(tokens, sizes, 12, 5)
    seen = [np.zeros(max(len(t) - 11, 0), int) for t in texts]
    for d, a, b, v, several in zip(runs.doc, runs.start, runs.end, runs.anchor, runs.several):
        seen[d][a:b] += 1
        span = texts[d][a : b + 11]
        grams = windows.Prefix(windows.CODES[np.frombuffer(span, np.uint8)]).all(5)
        assert grams.min() == v and several == ((grams == v).sum() > 1)
    assert all((s == 1).all() for s in seen)


def word_rows(docs, **shape):
    out = debruijn.remove_repeated_spans(docs, **shape).select("doc_id", "n_words", "n_removed", F.sha2("kept", 256)).collect()
    return {r[0]: tuple(r)[1:] for r in out}


def byte_rows(docs, **shape):
    out = suffixes.remove_repeated_bytes(docs, **shape).select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256)).collect()
    return {r[0]: tuple(r)[1:] for r in out}


def test_word_spans(edge, empty, small, small_rows):
    assert word_rows(edge) == brute.word_spans([(i, t) for i, t, _ in EDGE])
    assert word_rows(small) == brute.word_spans(small_rows)
    assert word_rows(empty) == {}


def test_byte_spans(edge, empty, small, small_rows):
    assert byte_rows(edge) == brute.byte_spans([(i, t) for i, t, _ in EDGE])
    assert byte_rows(small) == brute.byte_spans(small_rows)
    assert byte_rows(empty) == {}


@pytest.fixture(scope="module")
def tangled(spark):
    """Texts over few words, so that spans branch, overlap and repeat within a text."""
    rng = random.Random(5)
    phrase = [" ".join(rng.choice(["ab", "c", "de"]) for _ in range(9)) for _ in range(12)]
    rows = [(i, " ".join(rng.choice(phrase) for _ in range(rng.randint(0, 8)))) for i in range(150)]
    return spark.createDataFrame(rows, "doc_id long, text string").repartition(7), rows


def test_tangled_spans(tangled, monkeypatch):
    docs, rows = tangled
    assert word_rows(docs, k=6, m=3) == brute.word_spans(rows, 6)
    assert byte_rows(docs, k=20, m=8) == brute.byte_spans(rows, 20)
    monkeypatch.setattr(suffixes, "PART", 2)  # every anchor with three runs or more is split
    assert byte_rows(docs, k=20, m=8) == brute.byte_spans(rows, 20)


def test_rows_that_share_an_id(spark):
    text = " ".join(str(i) for i in range(60))
    docs = spark.createDataFrame([(1, text), (1, text), (None, text), (None, "q " + text)], "doc_id long, text string")
    words = sorted((r["doc_id"] is None, r["n_removed"]) for r in debruijn.remove_repeated_spans(docs).collect())
    assert words == [(False, 0), (False, 0), (True, 60), (True, 60)]
    spans = sorted((r["doc_id"] is None, r["n_removed"]) for r in suffixes.remove_repeated_bytes(docs).collect())
    assert spans == [(False, 0), (False, len(text)), (True, len(text)), (True, len(text))]
