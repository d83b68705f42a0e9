"""The pipeline, stage by stage against plain versions of the rules."""

import brute
import corpus_pipeline as cp
from cases import FOLDER
from showgrid.llm import mixing, quality, secrets
from pyspark.sql import functions as F


def test_stages(spark, small):
    columns = small.columns
    docs, rows = small, {r["doc_id"]: r for r in small.collect()}
    assert [n for n, _ in cp.STAGES] == ["quality", "near_duplicates", "secrets", "mixing", "pieces"]

    docs = cp.good_documents(spark, docs, FOLDER).cache()
    model = quality.fit(small, quality.read_labels(spark, FOLDER))
    tools = quality.Compressors(model.good, model.bad)
    kept = {r["doc_id"] for r in docs.collect()}
    assert kept == {i for i, r in rows.items() if tools.feature(r["text"]) * model.slope + model.shift >= 0} and docs.columns == columns

    _, parts = brute.gram_links([(i, rows[i]["text"]) for i in kept])
    docs = cp.one_per_group(spark, docs, FOLDER).cache()
    kept = {r["doc_id"] for r in docs.collect()}
    assert kept == {i for i in parts if parts[i] == i} and docs.columns == columns

    before = {r["doc_id"]: r["text"] for r in docs.collect()}
    docs = cp.without_secrets(spark, docs, FOLDER).cache()
    after = {r["doc_id"]: r for r in docs.collect()}
    assert set(after) == kept and docs.columns == columns
    for i, r in after.items():
        if brute.secrets(before[i]):
            assert "[SECRET]" in r["text"] and not brute.secrets(r["text"]) and r["n_chars"] == len(r["text"])
        elif r["text"] != before[i]:
            assert "[SECRET]" in r["text"]

    plan = mixing.mix(docs).collect()
    docs = cp.mixed_sources(spark, docs, FOLDER).cache()
    got = {r["doc_id"]: r["n"] for r in docs.groupBy("doc_id").agg(F.sum(mixing.word_count(F.col("text"))).alias("n")).collect()}
    assert got == {r["doc_id"]: r["taken"] for r in plan if r["taken"]} and docs.columns == columns

    out = cp.encoded_pieces(spark, docs, FOLDER).collect()
    assert len(out) == docs.count() and all(r["round_trip"] for r in out)


def test_edge_table_passes_all_stages(spark, edge, empty):
    for docs in (edge, empty):
        for name, stage in cp.STAGES[1:]:
            docs = stage(spark, docs, FOLDER).cache()
            docs.count()
    assert cp.good_documents(spark, empty, FOLDER).count() == 0


def test_run_is_the_stages(spark):
    out = cp.run(spark, FOLDER)
    assert out.columns == ["doc_id", "n_ids", "ids", "decoded_sha256", "round_trip"] and out.count() > 100
