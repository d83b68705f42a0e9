"""Quality, pieces and fingerprints."""

from array import array

import brute
import pytest
import sentencepiece
from cases import EDGE
from pyspark.sql import functions as F
from sentencepiece import sentencepiece_model_pb2 as pb
from showgrid.llm import pieces, quality, spotnear, spotsigs


@pytest.fixture(scope="module")
def labelled(spark):
    folder = "/root/testdata/sf0.01"
    return spark.read.parquet(f"{folder}/documents.parquet"), quality.read_labels(spark, folder)


def test_quality_on_held_out_labels(labelled, edge, empty):
    docs, labels = labelled
    model = quality.fit(docs, labels)
    rows = quality.classify(docs.select("doc_id", "text"), model).join(labels, "doc_id").where(quality.held_out(F.col("doc_id"))).collect()
    assert sum(r["predicted"] == r["quality"] for r in rows) / len(rows) > 0.95
    got = {r["doc_id"]: r for r in quality.classify(edge, model).collect()}
    assert len(got) == len(EDGE) and all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.5) for r in got.values())
    assert got[2]["score"] == got[3]["score"] and got[4]["score"] == got[5]["score"]
    assert quality.classify(empty, model).count() == 0


def test_quality_without_usable_labels(labelled, edge):
    docs, labels = labelled
    for some in (labels.limit(0), labels.where("quality = 1")):
        model = quality.fit(docs, some)
        assert len({r["score"] for r in quality.classify(edge, model).collect()}) == 1


@pytest.fixture(scope="module")
def unigram(tmp_path_factory):
    """The model as a unigram model whose scores are exact in single precision, for the library to agree with."""
    proto = pb.ModelProto()
    with open(pieces.MODEL, "rb") as f:
        proto.ParseFromString(f.read())
    proto.trainer_spec.model_type = 1
    for p in proto.pieces:
        p.score = max(p.score, -40000.0)
    path = str(tmp_path_factory.mktemp("model") / "unigram.model")
    with open(path, "wb") as f:
        f.write(proto.SerializeToString())
    return path


def test_pieces_agree_with_the_library(unigram, small_rows):
    library, own = sentencepiece.SentencePieceProcessor(model_file=unigram), pieces.Pieces(unigram)
    for _, t in small_rows + [(i, t) for i, t, _ in EDGE if i not in (7, 8, 10, 16)]:
        t = (t or "")[:400]
        ids = array("i")
        own.encode(t, ids)
        assert list(ids) == library.encode(t) and own.decode(ids) == library.decode(list(ids)) == t


def brute_path(model, text):
    """Best score by trying all pieces at all positions."""
    s, table = model.normalize(text), {}
    for i, (p, k) in enumerate(zip(model.text, model.kind)):
        if k == pieces.NORMAL:
            table[p] = i
    score = {i: x for x, i in ((v[1], v[2]) for v in model.automaton.values())}
    best = [0.0] + [None] * len(s)
    for e in range(1, len(s) + 1):
        options = [best[b] + score[table[s[b:e]]] for b in range(max(0, e - 20), e) if s[b:e] in table]
        if s[e - 1] not in table:
            options.append(best[e - 1] + model.unknown_score)
        best[e] = max(options)
    return best[-1]


def test_pieces_best_score():
    model = pieces.pieces(pieces.MODEL)
    score = {i: x for _, x, i in model.automaton.values()}
    for t in ("the best   path of\na text", "é😀 ñandú  ", "aaaa bbbb"):
        ids = array("i")
        model.encode(t, ids)
        unknown = sum(len(x.encode()) for x in t if x not in model.text and x != " ")
        assert sum(score.get(i, 0.0) for i in ids) + len([x for x in t if x not in model.text and x != " "]) * model.unknown_score == brute_path(model, t)
        assert sum(i in model.byte_of for i in ids) == unknown


def test_pieces_round_trip(edge, empty, small):
    for docs in (edge, small):
        for r in pieces.encode_decode(docs).join(docs.select("doc_id", "text"), "doc_id").collect():
            assert r["round_trip"] == ("▁" not in (r["text"] or "")) and r["n_ids"] == len(r["ids"])
            assert not r["round_trip"] or r["decoded_sha256"] == brute.sha(r["text"] or "")
    back = pieces.decode(pieces.encode(edge, keep=("doc_id", "score")))
    assert back.columns == ["doc_id", "score", "ids", "decoded"]
    assert {r["doc_id"]: r["decoded"] for r in back.collect()} == {i: (t or "").replace("▁", " ") for i, t, _ in EDGE}
    assert pieces.encode_decode(empty).count() == 0


def edited_rows(rows):
    ordered = sorted(rows, key=lambda r: -r[0])
    out = {}
    for n, (i, t) in enumerate(ordered):
        t, after = t or "", ordered[(n + 1) % len(ordered)][1] or ""
        half = len(t) // 2
        edited = t[: len(t) - half] + after[:half]
        a, b, c = (brute.spot_signatures(x, spotsigs.ANCHORS) for x in (t, edited, after))
        out[i] = (len(t), brute.sha(edited), brute.spot_print(a), brute.spot_print(b), brute.likeness(a, b), brute.likeness(a, c), i, 0)
    return out


def test_edited_fingerprints(edge, empty, small, small_rows):
    for docs, rows in ((edge, [(i, t) for i, t, _ in EDGE]), (small, small_rows), (edge.where("doc_id = 7"), [(7, EDGE[6][1])])):
        got = spotsigs.edited_fingerprints(docs).collect()
        assert {r[0]: tuple(r)[1:] for r in got} == edited_rows(rows) and len(got) == len(rows)
    assert spotsigs.edited_fingerprints(empty).count() == 0
    assert spotsigs.edited_fingerprints(edge.union(edge)).count() == 2 * len(EDGE)


def test_equal_texts_have_equal_fingerprints():
    one, two = "The cat of a house", "xyz"
    assert spotsigs.signatures(one) == spotsigs.signatures(one) and spotsigs.signatures(two) and not spotsigs.signatures(None)
    assert spotsigs.jaccard(frozenset(), frozenset()) == 1.0 and spotsigs.jaccard(frozenset([1]), frozenset()) == 0.0


def near_rows(rows, threshold):
    """doc_id -> (class_id, n_near) by comparing all pairs of plain sets of signatures."""
    sets = [(i, brute.spot_signatures(t or "", spotsigs.ANCHORS)) for i, t in rows]
    out = {}
    for i, s in sets:
        alike = [j for j, o in sets if s and len(s & o) >= threshold * len(s | o) - 1e-9]
        out[i] = (min((j for j, o in sets if o == s), default=i) if s else i, max(0, len(alike) - 1))
    return out


@pytest.mark.parametrize("threshold, block", [(0.8, 256), (0.5, 256), (0.5, 3)])
def test_near_documents_by_brute_force(small, small_rows, edge, threshold, block):
    for docs, rows in ((small, small_rows), (edge, [(i, t) for i, t, _ in EDGE])):
        got = {r["doc_id"]: (r["class_id"], r["n_near"]) for r in spotnear.near_documents(docs, threshold, block).collect()}
        want = near_rows(rows, threshold)
        assert {i: got.get(i, (i, 0)) for i in want} == want


def test_near_documents_of_hot_groups(spark):
    """Hundreds of variants of one text, exact copies and texts of half the length among them."""
    words = [f"word{i}" for i in range(60)]
    rows = []
    for i in range(240):
        w = words[: 60 if i % 3 else 30] + ([f"own{i}"] if i % 5 else [])
        w[i % 25] = f"other{i % 40}"
        rows.append((i, " ".join(f"the {x}" for x in w)))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r["doc_id"]: (r["class_id"], r["n_near"]) for r in spotnear.near_documents(docs, 0.8, 16).collect()}
    want = near_rows(rows, 0.8)
    assert got == want and max(n for _, n in want.values()) > 30


def test_edited_fingerprints_with_near_documents(edge, empty, small, small_rows):
    got = spotsigs.edited_fingerprints(small, spotnear.near_documents(small)).collect()
    assert {r["doc_id"]: (r["class_id"], r["n_near"]) for r in got} == near_rows(small_rows, 0.8) and len(got) == len(small_rows)
    twice = edge.union(edge)
    got = spotsigs.edited_fingerprints(twice, spotnear.near_documents(twice)).collect()
    want = near_rows([(i, t) for i, t, _ in EDGE], 0.8)
    assert len(got) == 2 * len(EDGE)
    assert all(r["class_id"] == want[r["doc_id"]][0] for r in got)
    assert all(r["n_near"] == (2 * want[r["doc_id"]][1] + 1 if brute.spot_signatures(dict((i, t or "") for i, t, _ in EDGE)[r["doc_id"]], spotsigs.ANCHORS) else 0) for r in got)
    assert spotsigs.edited_fingerprints(empty, spotnear.near_documents(empty)).count() == 0


def test_signatures_of_many_texts_at_once(small_rows):
    """Odd characters, words of many bytes, texts without words or anchors; together as one by one."""
    texts = [None, "", "the", "of the", " \n", "é" * 70 + " the " + "z" * 5000 + " of", "für ΣΑΣ Σ, İstanbul más ẞ① the ²x_1 日本語 café of 😀 𝒜 b",
             "which\x00their einer a"] + [t for _, t, _ in EDGE] + [t for _, t in small_rows[:100]]
    want = [brute.spot_print(brute.spot_signatures(t or "", spotsigs.ANCHORS)) for t in texts]
    assert [spotsigs.fingerprint(s) for s in spotsigs.signature_sets(texts)] == want
    assert [spotsigs.fingerprint(spotsigs.signature_sets([t])[0]) for t in texts] == want and spotsigs.signature_sets([]) == []


def test_texts_travel_compressed(spark):
    """What is shuffled of texts in order of their ids is well below their size."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    ranges = lambda ids: ids.to_numpy(zero_copy_only=False) // 500
    sent = spotsigs.packed(docs, ranges, {499: 1})
    raw, size = docs.agg(F.sum(F.octet_length("text"))).first()[0], sent.agg(F.sum(F.octet_length("data"))).first()[0]
    assert size < 0.5 * raw
    back = sent.select("*", *[F.lit(None).cast("long").alias(c) for c in spotsigs.NEAR]).mapInArrow(
        spotsigs.unpacked, "range long, guest int, doc_id long, text string, d1 long, d2 long, class_id long, n_near long")
    assert {(r["doc_id"], r["text"], r["range"], r["guest"]) for r in back.collect()} == {
        (r["doc_id"], r["text"], w, g) for r in docs.collect() for w, g in [(r["doc_id"] // 500, 0)] + [(1, 1)] * (r["doc_id"] == 499)}
