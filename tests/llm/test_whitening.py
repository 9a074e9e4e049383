"""Whitening against a dense eigensolver."""

import math

import numpy as np
import pytest

from spanloom.llm import whitening as wh
from tests.conftest import SF


def test_inertia_counts():
    rng = np.random.default_rng(4)
    for n in (1, 2, 5, 30):
        for _ in range(20):
            q, _ = np.linalg.qr(rng.standard_normal((n, n)))
            e = rng.choice([-3.0, -1e-3, 2e-3, 1.0, 7.0], n)
            a = q @ np.diag(e) @ q.T
            assert wh.negative_pivots((a + a.T) / 2) == (e < 0).sum()
    assert wh.negative_pivots(np.array([[0.0, 1.0], [1.0, 0.0]])) == 1
    assert wh.negative_pivots(np.zeros((3, 3))) == 0


@pytest.mark.parametrize("e", [[5, 4, 3, 2, 1, 0.5, 0.1, 0.01, 1e-3, 0], [3, 3, 3, 1, 1, 1e-5, 1e-5, 1e-6, 0, 0], [1, 1 - 1e-9, 1 - 2e-9, 0.5, 0.5 - 1e-12, 0.1, 0, 0, 0, 0], [7], [2, 2], [1e8, 1, 1e-3, 1e-3, 1e-4]])
def test_components_of_given_spectra(e):
    e = np.array(e, "f8")
    q, _ = np.linalg.qr(np.random.default_rng(5).standard_normal((len(e), len(e))))
    v = q @ np.diag(e) @ q.T
    values, vectors = wh.leading_components((v + v.T) / 2)
    want = [x for x in e[:8] if x > 16 * len(e) * 3e-16 * e.max() * len(e)]
    assert len(values) == len(want)
    assert np.allclose(values, want, rtol=1e-6, atol=1e-13 * e.max())
    assert np.abs(vectors.T @ vectors - np.eye(len(values))).max() < 1e-10
    assert np.linalg.norm(v @ vectors - vectors * values, axis=0).max() < 1e-12 * e.max()


def brute(rows):
    x = np.floor(1024 * np.array([r[1] for r in rows], "f8")) + 100000
    y = x - x.mean(axis=0)
    cov = y.T @ y / len(x)
    e, q = np.linalg.eigh(cov)
    e, q = e[::-1][:8], q[:, ::-1][:, :8]
    s = [sum(int(c) for c in col) for col in x.T]
    dev = [sum((len(x) * int(a) - b) ** 2 for a, b in zip(r, s, strict=True)) for r in x]
    return e / np.trace(cov), y @ q / np.sqrt(e), dev


def test_equals_a_dense_solver(spark):
    df = spark.read.parquet(f"{SF}/embeddings.parquet")
    rows = [(r["vec_id"], r["embedding"]) for r in df.collect()]
    share, white, dev = brute(rows)
    got = wh.whitened(df.repartition(7)).collect()
    assert len(got) == 8 * len(rows)
    place = {r[0]: i for i, r in enumerate(rows)}
    w = np.zeros((len(rows), 8))
    for r in got:
        w[place[r["vec_id"]], r["component"] - 1] = r["whitened"]
        assert r["n"] == len(rows) and int(r["deviation"]) == dev[place[r["vec_id"]]]
        assert abs(r["explained"] - share[r["component"] - 1]) < 1e-9 and r["identity_error"] < 1e-9
    signs = np.sign((w * white).sum(axis=0))
    assert np.abs(w - white * signs).max() < 1e-6


def test_rows_that_take_no_part(spark):
    rng = np.random.default_rng(6)
    rows = [(i % 50, rng.standard_normal(3).tolist(), "x") for i in range(60)] + [(None, [0.1, 0.2, 0.3], "x")]
    bad = [(70, None, "x"), (71, [], "x"), (72, [1.0, None, 2.0], "x"), (73, [math.nan, 0.0, 0.0], "x"), (74, [math.inf, 0.0, 0.0], "x"), (75, [1.0], "x"), (76, [1e300, 0.0, 0.0], "x")]
    df = spark.createDataFrame(rows + bad, "vec_id long, embedding array<double>, v string")
    got = wh.whitened(df).collect()
    _, _, dev = brute(rows)
    assert len(got) == 3 * len(rows) and {r["n"] for r in got} == {len(rows)}
    assert sorted(int(r["deviation"]) for r in got if r["component"] == 1) == sorted(dev)
    assert sum(r["vec_id"] is None for r in got) == 3
    for few in (df.limit(0), df.where("vec_id = 75"), df.where("vec_id in (1, 75) and embedding[0] is not null").limit(1)):
        assert wh.whitened(few).count() == 0
    same = spark.createDataFrame([(1, [1.0, 1.0]), (2, [2.0, 2.0]), (3, [5.0, 5.0])], "vec_id long, embedding array<double>")
    assert {(r["component"], round(r["explained"], 9)) for r in wh.whitened(same).collect()} == {(1, 1.0)}
    large = spark.createDataFrame([(i, [1e12 * (-1) ** i, float(i)]) for i in range(3000)], "vec_id long, embedding array<double>")
    got = wh.whitened(large, components=1).collect()
    assert all(r["deviation"] is not None and int(r["deviation"]) > 2**64 for r in got) and got[0]["identity_error"] < 1e-9
