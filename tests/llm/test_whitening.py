"""Whitening against a dense eigensolver and its own definition."""

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from showgrid.llm import feast
from showgrid.llm import whitening as H

SCHEMA = "vec_id long, embedding array<float>, label int, n long, i long, dim string, x string"


def frame(spark, rows):
    return spark.createDataFrame([(i, v, None, None, None, None, None) for i, v in rows], SCHEMA)


def expected(rows):
    """Eigenvalues of the covariance, exact deviations and the data."""
    x = np.array([[int(np.floor(64 * float(np.float32(c)))) + 1_000_000 for c in v] for _, v in rows])
    n, s = len(x), x.sum(axis=0)
    away = [[n * int(a) - int(b) for a, b in zip(r, s)] for r in x]
    y = x - s / n
    v = y.T @ y / n
    return n, [sum(a * a for a in r) for r in away], y, np.linalg.eigh(v)[0][::-1], v


def check(got, rows, wanted=32):
    n, deviation, y, values, v = expected(rows)
    k = min(wanted, int((values > 1e-12 * values[0]).sum()))
    assert len(got) == n * k and {r["n"] for r in got} == {n}
    by = {}
    for r in got:
        by.setdefault(r["component"], {}).setdefault(r["vec_id"], []).append(r)
    assert sorted(by) == list(range(1, k + 1))
    error = {r["identity_error"] for r in got}
    assert len(error) == 1 and max(error) < 1e-8
    ids = [i for i, _ in rows]
    for c, of_vec in by.items():
        assert all(abs(r["explained"] - values[c - 1] / np.trace(v)) < 1e-9 * r["explained"] for rs in of_vec.values() for r in rs)
        assert all(of_vec[i][0]["deviation"] == d for i, d in zip(ids, deviation))
        z = np.array([of_vec[i][0]["whitened"] for i in ids])
        u = v @ (y.T @ z)  # V (sum of y z) is along the eigenvector
        u /= np.linalg.norm(u)
        assert np.abs(v @ u - values[c - 1] * u).max() < 1e-6 * values[0]
        assert np.abs(np.abs(y @ u / np.sqrt(values[c - 1])) - np.abs(z)).max() < 1e-6
    return by


@pytest.mark.parametrize("sf", ["sf0.001", "sf0.01"])
def test_whole_table(spark, sf):
    rows = [(r["vec_id"], r["embedding"]) for r in spark.read.parquet(f"/root/testdata/{sf}/embeddings.parquet").collect()]
    rows = [(i, v) for i, v in rows if v is not None and all(c is not None and np.isfinite(c) for c in v)]
    check(H.op13(spark, f"/root/testdata/{sf}").collect(), rows)


def test_edge_rows(spark):
    """Null vectors and entries, not finite ones, a null id, repeated rows, equal variances, two lengths, no vectors, equal vectors."""
    rng = np.random.default_rng(3)
    good = [(i, rng.normal(0, 1, 5).astype(np.float32).tolist()) for i in range(40)] + [(None, [1.0, 2.0, 3.0, 4.0, 5.0])]
    bad = [(100, None), (101, [1.0, None, 0.0, 0.0, 0.0]), (102, [float("nan")] * 5), (103, [float("inf"), 0.0, 0.0, 0.0, 0.0]), (104, [])]
    check(H.whitened(frame(spark, good + bad)).collect(), good)
    twice = good + [good[0]] * 3
    got = H.whitened(frame(spark, twice + bad)).collect()
    assert len(got) == len(twice) * 5 and len([r for r in got if r["vec_id"] == 0]) == 20
    other = [(i, rng.normal(0, 1, 3).astype(np.float32).tolist()) for i in range(200, 220)]
    got = H.whitened(frame(spark, good + other)).collect()
    check([r for r in got if r["vec_id"] is None or r["vec_id"] < 200], good)
    check([r for r in got if r["vec_id"] is not None and r["vec_id"] >= 200], other)
    cross = [(i, (np.eye(4)[i % 4] * (-1) ** (i // 4)).tolist()) for i in range(8)]  # four equal eigenvalues
    got = H.whitened(frame(spark, cross)).collect()
    assert len(got) == 32 and {round(r["explained"], 12) for r in got} == {0.25} and got[0]["identity_error"] < 1e-9
    assert H.whitened(frame(spark, [])).count() == 0 and H.whitened(frame(spark, bad)).count() == 0
    assert H.whitened(frame(spark, [good[0]] * 3)).count() == 0
    flat = [(i, [float(i), 2.0 * i, 0.0]) for i in range(9)]  # one component has all the variance
    got = H.whitened(frame(spark, flat)).collect()
    assert len(got) == 9 and abs(got[0]["explained"] - 1) < 1e-9
    huge = [(0, [1e30, 0.0]), (1, [-1e30, 1.0]), (2, [0.0, 5.0])]
    assert all((r["deviation"] is None) == (r["vec_id"] < 2) for r in H.whitened(frame(spark, huge)).collect())


@settings(max_examples=60, deadline=None)
@given(st.integers(1, 40), st.integers(0, 10**6), st.sampled_from(["normal", "clusters", "falling", "diagonal", "rank"]), st.integers(1, 40))
def test_intervals_miss_nothing(n, seed, kind, wanted):
    rng = np.random.default_rng(seed)
    q, _ = np.linalg.qr(rng.standard_normal((n, n)))
    values = {"normal": rng.normal(0, 1, n) ** 2, "clusters": rng.integers(1, 4, n).astype(float), "falling": 2.0 ** -np.arange(n),
              "diagonal": np.arange(n, 0, -1).astype(float), "rank": np.where(np.arange(n) < 3, 1.0 + np.arange(n), 0.0)}[kind]
    v = np.diag(values) if kind == "diagonal" else q @ np.diag(values) @ q.T
    v = (v + v.T) / 2
    want = np.linalg.eigvalsh(v)[::-1]
    shifts = np.linspace(want[-1] - 1, want[0] + 1, 50) + 1e-7
    assert (feast.Inertia(v).below(shifts) == [(want < s).sum() for s in shifts]).all()
    parts = feast.intervals(v, min(wanted, n))
    pairs = [feast.eigenpairs(v, *p) for p in parts]
    got = np.sort(np.concatenate([e for e, _ in pairs]))[::-1]
    assert len(got) >= min(wanted, n) and np.abs(got - want[: len(got)]).max() < 1e-11 * max(1, want[0])
    u = np.concatenate([x for _, x in pairs], axis=1)
    assert np.abs(u.T @ u - np.eye(u.shape[1])).max() < 1e-4
