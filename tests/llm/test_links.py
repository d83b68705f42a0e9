"""Near-duplicate vectors, the n-gram join and the components."""

import brute
import numpy as np
import pytest
from cases import EDGE
from showgrid.llm import buckets, ngrams, vectors
from showgrid.llm.components import connected_components


def test_components_by_union(spark):
    rng = np.random.default_rng(1)
    edges = [(int(a), int(b)) for a, b in rng.integers(0, 400, (300, 2))] + [(i, i + 1) for i in range(1000, 1120)] + [(5000, i) for i in range(5001, 5100)] + [(7, None)]
    got = {r["id"]: r["component"] for r in connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    real = [(a, b) for a, b in edges if b is not None and a != b]
    assert got == brute.components({x for p in real for x in p}, real)


def vector_table(spark):
    rng = np.random.default_rng(2)
    rows, centres = [], rng.standard_normal((6, 24))
    for i in range(260):
        x = centres[i % 6] + rng.standard_normal(24) * (0.17 if i < 200 else 2.0)
        rows.append((i, [float(v) for v in x.astype(np.float32)], i % 2 if i % 6 else None if i % 5 == 0 else 0))
    rows += [(300 + i, rows[3][1], 1) for i in range(40)] + [(400, [2 * v for v in rows[3][1]], 1)]
    rows += [(500, None, 1), (501, [0.0] * 24, 1), (502, [float("nan")] * 24, 1), (503, [None] + [1.0] * 23, 1), (504, [float("inf")] * 24, 1), (505, [], 1), (506, [1.0, 2.0], 1)]
    return spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int"), rows


def test_vectors_by_brute_force(spark, monkeypatch):
    table, rows = vector_table(spark)
    links, parts = brute.vector_links(rows)
    for block in (512, 8):  # the small one splits buckets
        monkeypatch.setattr(vectors, "BLOCK", block)
        got = vectors.near_vectors(table).collect()
        assert len(got) == len(rows)
        found, want = sum(r["n_links"] for r in got), sum(links.values())
        assert all(r["n_links"] <= links[r["vec_id"]] for r in got)  # none below the threshold
        assert found >= 0.98 * want
        assert all(r["component_id"] == parts[r["vec_id"]] and r["kept"] == (r["vec_id"] == parts[r["vec_id"]]) for r in got)
    assert vectors.near_vectors(table.limit(0)).count() == 0


def test_tables_for_recall():
    assert vectors.collision(1e-6) > 0.999 and vectors.collision(0.3) > vectors.collision(1.4)
    assert vectors.tables_needed(0.93, 0.99) > vectors.tables_needed(0.99, 0.99)
    bands, rows = ngrams.bands_and_rows()
    assert 1 - (1 - 0.8**rows) ** bands >= 0.99 and 1 - (1 - 0.4**rows) ** bands <= 0.05


def near_copies(spark):
    rng = np.random.default_rng(3)
    base = [f"word{int(x)}" for x in rng.integers(0, 5000, 300)]
    rows = []
    for i in range(60):  # a large group of near copies, all different
        w = list(base)
        for p in rng.integers(0, 300, i % 7):
            w[p] = f"edit{i}x{p}"
        rows.append((i, " ".join(w)))
    rows += [(100 + i, rows[5][1]) for i in range(30)] + [(200 + i, " ".join(f"u{int(x)}" for x in rng.integers(0, 5000, 80))) for i in range(50)]
    return spark.createDataFrame(rows, "doc_id long, text string").repartition(6), rows


@pytest.mark.parametrize("block", [256, 4])
def test_join_by_brute_force(spark, monkeypatch, block):
    docs, rows = near_copies(spark)
    monkeypatch.setattr(ngrams, "BLOCK", block)
    links, parts = brute.gram_links(rows)
    got = {r["doc_id"]: r for r in ngrams.jaccard_join(docs).collect()}
    assert len(got) == len(rows)
    found, want = sum(r["n_links"] for r in got.values()), sum(links.values())
    assert all(r["n_links"] <= links[i] for i, r in got.items()) and found >= 0.98 * want
    assert {i: r["component_id"] for i, r in got.items()} == parts


def test_join_edge_cases(edge, empty):
    links, parts = brute.gram_links([(i, t) for i, t, _ in EDGE])
    got = {r["doc_id"]: r for r in ngrams.jaccard_join(edge).collect()}
    assert {i: (r["n_links"], r["component_id"]) for i, r in got.items()} == {i: (links[i], parts[i]) for i, _, _ in EDGE}
    kept = ngrams.one_of_each(edge)
    assert kept.columns == edge.columns and {r["doc_id"] for r in kept.collect()} == {i for i in parts if parts[i] == i}
    assert ngrams.jaccard_join(empty).count() == 0 and ngrams.one_of_each(empty).count() == 0


def test_blocks_hold_every_pair(spark):
    members = spark.createDataFrame([(i, i % 3 if i < 90 else 7 + i, 1) for i in range(100)], "id long, bucket long, weight int")
    rows = buckets.bucket_blocks(members, "id", 10, 10**9).collect()
    met = set()
    blocks = {}
    for r in rows:
        blocks.setdefault((r["bucket"], r["part_a"], r["part_b"]), []).append(r)
    for (_, a, b), rs in blocks.items():
        for x in rs:
            for y in rs:
                if x["id"] < y["id"] and (a == b or x["part"] != y["part"]):
                    assert (x["id"], y["id"]) not in met
                    met.add((x["id"], y["id"]))
    assert met == {(i, j) for i in range(90) for j in range(i + 1, 90) if i % 3 == j % 3}
