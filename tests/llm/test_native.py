"""Personal data, secrets and mixing."""

import itertools
import random
import string
import time

import brute
import oracle
import pytest
from cases import EDGE, FOLDER
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from showgrid.llm import mixing, pii, secrets, spans
from showgrid.llm.spans import span_list


def base_of(found, kinds):
    kept = F.filter("spans", lambda s: s["kind"].isin(kinds))
    return {r["doc_id"]: r["base"] for r in found.select("doc_id", span_list(kept, kinds).alias("base")).collect()}


def test_pii_base_spans(edge, small, small_rows):
    assert base_of(pii.pii_spans(edge), pii.BASE) == {i: brute.pii(t) for i, t, _ in EDGE}
    assert base_of(pii.pii_spans(small), pii.BASE) == {i: brute.pii(t) for i, t in small_rows}


def test_pii_adds_checked_spans(spark):
    docs = spark.createDataFrame([(1, "bank account GB82 WEST 1234 5698 7654 32 here", 0), (2, "GB83 WEST 1234 5698 7654 32", 0), (3, "social security 123-45-6789", 0),
                                  (4, "part 123-45-6789", 0)], "doc_id long, text string, spans int")
    found = {r["doc_id"]: [(s["kind"], s["score"]) for s in r["spans"]] for r in pii.pii_spans(docs).collect()}
    assert found[1] == [("iban", 1.0)] and not found[2] and not found[4]
    assert found[3][0][0] == "idnum" and found[3][0][1] == pytest.approx(0.6)


def test_iban_before_capital_words_and_numbers(spark):
    de, gb = "DE89370400440532013000", "GB82 WEST 1234 5698 7654 32"
    rows = {1: (f"IBAN {de} BIC COBADEFFXXX", [de]), 2: (f"{gb} CARD 4111", [gb]), 3: (f"REF AB12 {gb} AND {de} END", [gb, de]), 4: (f"{gb}", [gb]),
            5: ("GB83 WEST 1234 5698 7654 32 CARD 4111", []), 6: (f"{de}X", [])}
    docs = spark.createDataFrame([(i, t) for i, (t, _) in rows.items()], "doc_id long, text string")
    for r in pii.pii_spans(docs).collect():
        found = [s for s in r["spans"] if s["kind"] == "iban"]
        assert [s["text"] for s in found] == rows[r["doc_id"]][1] and all(r["whole"][s["start"]:s["end"]] == s["text"] for s in found)


def test_pii_long_runs(spark):
    """Linear patterns: long runs of one kind neither overflow the stack nor take long."""
    texts = ["a" * 60000, "1" * 60000, "a@" + "b." * 30000 + "c", "1." * 30000, "+1" + "-" * 60000, "4" * 60000 + "@", "a@b." * 5000]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert base_of(pii.pii_spans(docs), pii.BASE) == {i: brute.pii(t) for i, t in enumerate(texts)}


def test_many_matches_and_long_runs_take_time_in_proportion(spark):
    """200,000 mail addresses in one text, 60,000 short secrets in one text, and a run of a million random characters."""
    dice = random.Random(3)
    many = " ".join(f"a{i}@b{i % 7}.org" for i in range(200_000))
    keys = " ".join(f"{dice.getrandbits(80):020x}" for _ in range(60_000))
    run = "".join(dice.choice("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/") for _ in range(1_000_000))
    docs = spark.createDataFrame([(1, many), (2, keys), (3, "see " + run + " end")], "doc_id long, text string").repartition(3)
    began = time.time()
    found = {r["doc_id"]: r["n"] for r in pii.pii_spans(docs).select("doc_id", F.size("spans").alias("n")).collect()}
    assert found[1] == 200_000
    model = [0.6] * secrets.SIZE**2
    got = {r["doc_id"]: r for r in secrets.secret_spans(docs, model).select("doc_id", F.size("spans").alias("n")).collect()}
    assert got[2]["n"] == 60_000 and got[3]["n"] == 1
    texts = {r["doc_id"]: r["text"] for r in secrets.redact(docs, model).collect()}
    assert texts[2] == " ".join(["[SECRET]"] * 60_000) and texts[3] == "see [SECRET] end"
    assert time.time() - began < 120


@settings(max_examples=20, deadline=None, suppress_health_check=list(HealthCheck))
@given(st.lists(st.tuples(st.integers(0, 700), st.integers(1, 40)), max_size=600), st.lists(st.tuples(st.integers(0, 700), st.integers(1, 40)), max_size=20))
def test_span_arithmetic(spark, some, others):
    """Running sums over several blocks, parts of a text, replaced and separate spans against plain loops."""
    text = "".join(chr(0x1F600 + i % 50) if i % 3 else chr(97 + i % 26) for i in range(760))
    rows = lambda spans: [("k", a, a + n, text[a : a + n]) for a, n in spans]
    frame = spark.createDataFrame([(text, rows(some), rows(others))], f"t string, s array<{spans.SPAN}>, o array<{spans.SPAN}>")
    r = frame.select(spans.running(F.transform("s", lambda x: x["start"]), 0, lambda a, x: a + x).alias("sums"), spans.replace_spans(F.col("t"), F.col("s"), "X").alias("new"),
                     spans.apart_from(F.col("s"), F.col("o")).alias("free"),
                     F.transform("s", lambda x: spans.part(spans.chunks(F.col("t")), x["start"], x["end"])).alias("parts")).first()
    assert r["sums"] == list(itertools.accumulate(a for a, _ in some)) and r["parts"] == [text[a : a + n] for a, n in some]
    at, out = 0, []
    for a, b in sorted((a, a + n) for a, n in some):
        if a >= at:
            out += [text[at:a], "[X]"]
        at = max(at, b)
    assert r["new"] == "".join(out) + text[at:]
    assert sorted((x["start"], x["end"]) for x in r["free"]) == sorted((a, a + n) for a, n in some if not any(c < a + n and c + m > a for c, m in others))


def test_secret_base_spans(edge, small, small_rows):
    model = secrets.train(small)
    assert base_of(secrets.secret_spans(edge, model), secrets.BASE) == {i: brute.secrets(t) for i, t, _ in EDGE}
    assert base_of(secrets.secret_spans(small, model), secrets.BASE) == {i: brute.secrets(t) for i, t in small_rows}


def test_models_tell_random_strings(spark, small):
    model = secrets.train(small)
    rows = [(1, "key Zk3vQ9xT7LmB2wRfY8pJ here"), (2, "the thingstedoning2therandlyonedesh word"), (3, None)]
    found = {r["doc_id"]: [s["kind"] for s in r["spans"]] for r in secrets.secret_spans(spark.createDataFrame(rows, "doc_id long, text string"), model).collect()}
    assert found == {1: ["random"], 2: [], 3: []}
    assert secrets.train(small.limit(0)) == [0.0] * secrets.SIZE**2

@pytest.mark.parametrize("alphabet", [string.ascii_letters + string.digits + "+/", string.ascii_letters])
def test_random_strings_of_any_length(spark, small, alphabet):
    model, dice = secrets.train(small), random.Random(7)
    keys = {n: "".join(dice.choices(alphabet, k=n)) for n in (40, 200, 201, 300, 5000)}
    docs = spark.createDataFrame([(n, f"the key {k} ends here") for n, k in keys.items()], "doc_id long, text string")
    found = {r["doc_id"]: [(s["kind"], s["text"]) for s in r["spans"]] for r in secrets.secret_spans(docs, model).collect()}
    assert found == {n: [("random", k)] for n, k in keys.items()}
    assert {r["text"] for r in secrets.redact(docs, model).collect()} == {"the key [SECRET] ends here"}


def test_long_ordinary_runs_are_kept(spark, small):
    texts = ["-" * 60, "_" * 300, "=" * 5000, "z" * 300, "the/people/from/other/places", "THE_PEOPLE_FROM_OTHER_PLACES", "the-people-from-other-places", "2024-01-02-2024-01-02/report"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert {r["doc_id"]: r["text"] for r in secrets.redact(docs, secrets.train(small)).collect()} == dict(enumerate(texts))


def test_redaction(edge, small):  # row 11 is one long hexadecimal run
    got = {r["doc_id"]: r for r in secrets.redact(edge, secrets.train(small)).collect()}
    assert got[13]["text"] == "😀 [SECRET]' [SECRET] [SECRET] token: short" and got[13]["n_chars"] == len(got[13]["text"])
    assert all(got[i]["text"] == t for i, t, _ in EDGE if i not in (11, 13)) and len(got) == len(EDGE)
    assert secrets.redact(edge, [0.0] * secrets.SIZE**2).columns == edge.columns


def test_mixing_sql(spark):
    assert oracle.compare(mixing.op9(spark, FOLDER), FOLDER, mixing.SQL) is None


def test_mixing_budgets(edge, empty):
    assert mixing.mix(empty).count() == 0 and mixing.mixed_documents(empty).count() == 0
    rows = mixing.mix(edge.union(edge)).collect()  # repeated rows and null sources
    assert len(rows) == 2 * len(EDGE)
    by = {}
    for r in rows:
        assert 0 <= r["taken"] <= 2 * r["size"]
        by.setdefault(r["source"], []).append(r)
    for rs in by.values():
        assert sum(r["size"] for r in rs) == rs[0]["source_size"]
        assert sum(r["taken"] for r in rs) == int(rs[0]["target"] + 1e-9) or rs[0]["target"] == 0
    total = sum(r["size"] for r in rows)
    assert sum(rs[0]["target"] for rs in by.values()) == pytest.approx(1.5 * total)
    again = sorted((r["doc_id"], r["taken"]) for r in mixing.mix(edge.union(edge).repartition(3)).collect())
    assert again == sorted((r["doc_id"], r["taken"]) for r in rows)


def test_mixed_documents_carry_the_words(small):
    out = mixing.mixed_documents(small)
    assert out.columns == small.columns
    words = out.agg(F.sum(mixing.word_count(F.col("text")))).first()[0]
    assert words == mixing.mix(small).agg(F.sum("taken")).first()[0]
