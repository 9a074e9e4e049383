"""Nearest neighbours against brute force."""

import math

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
from pyspark.sql import functions as F

from spanloom.llm import neighbours as nn
from tests.conftest import SF


def brute(rows, k, asks):
    ids = np.array([r[0] for r in rows])
    x = np.array([r[1] for r in rows], "f8")
    norms = np.sqrt((x * x).sum(axis=1))
    out = {}
    for i in np.flatnonzero(asks(ids)):
        score = (x @ x[i]) / (norms * norms[i])
        order = [j for j in np.lexsort((ids, -np.round(score, 12))) if ids[j] != ids[i]][:k]
        out[ids[i]] = [(int(ids[j]), score[j]) for j in order]
    return out


def found(df):
    out = {}
    for r in df.orderBy("query_id", "rank").collect():
        assert r["rank"] == len(out.setdefault(r["query_id"], [])) + 1
        out[r["query_id"]].append((r["vec_id"], r["score"]))
    return out


def test_recall_and_scores(spark):
    df = spark.read.parquet(f"{SF}/embeddings.parquet")
    want = brute([(r["vec_id"], r["embedding"]) for r in df.collect()], 5, lambda i: i % 50 == 0)
    got = found(nn.nearest(df, F.col("vec_id") % 50 == 0))
    assert set(got) == set(want)
    hits = sum(len({v for v, _ in got[q]} & {v for v, _ in want[q]}) for q in want)
    assert hits >= 0.9 * sum(map(len, want.values()))
    score = {q: dict(f) for q, f in want.items()}
    assert all(abs(s - score[q][v]) < 1e-12 for q in got for v, s in got[q] if v in score[q])


def test_ties_copies_and_bad_vectors(spark):
    rows = [(i, [1.0, 2.0, 3.0, 4.0], "x") for i in range(0, 400)]
    rows += [(1000 + i, [1.0, 2.0, 3.0, 4.0 + i / 100], "x") for i in range(1, 30)]
    rows += [(2000, None, "x"), (2001, [0.0] * 4, "x"), (2002, [1.0, None, 1.0, 1.0], "x"), (2003, [math.nan, 1.0, 1.0, 1.0], "x"), (2004, [math.inf, 1.0, 1.0, 1.0], "x"), (2005, [1.0], "x"), (None, [1.0] * 4, "x"), (50, [1.0, 2.0, 3.0, 4.0], "x")]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, v string")
    got = found(nn.nearest(df.where("vec_id != 50 or vec_id is null"), F.col("vec_id") % 50 == 0))
    assert [v for v, _ in got[0]] == [1, 2, 3, 4, 5] and [v for v, _ in got[350]] == [0, 1, 2, 3, 4]
    assert set(got) == {0, 100, 150, 200, 250, 300, 350}
    assert all(abs(s - 1) < 1e-12 for f in got.values() for _, s in f)
    few = found(nn.nearest(df.where("vec_id in (0, 1001, 1002)"), F.col("vec_id") % 50 == 0))
    assert [v for v, _ in few[0]] == [1001, 1002]
    assert nn.nearest(df.limit(0), F.col("vec_id") % 50 == 0).count() == 0


def test_huge_and_tiny_components(spark):
    rows = [(0, [1e200, 0.0]), (1, [1e200, 1e199]), (2, [0.0, 1e-200]), (3, [-1.0, 0.0])]
    got = found(nn.nearest(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), F.col("vec_id") == 0))
    assert [v for v, _ in got[0]] == [1, 2, 3] and abs(got[0][0][1] - 1 / math.sqrt(1.01)) < 1e-12


def test_scan_keeps_the_nearest():
    rng = np.random.default_rng(3)
    x = rng.standard_normal((3000, 64)) @ nn.rotation(64)
    kept = numbers = 0
    for _ in range(40):
        q = rng.standard_normal(64)
        which, rows, away, read = nn.adaptive_scan(q[None], nn.column_blocks(x), 6)
        assert not which.any() and (np.diff(away) >= 0).all() and np.allclose(away, ((x[rows] - q) ** 2).sum(axis=1))
        kept += len(set(rows.tolist()) & set(np.argsort(((x - q) ** 2).sum(axis=1))[:6].tolist()))
        numbers += read
    assert kept >= 0.97 * 240
    assert numbers < 0.9 * 40 * x.size  # many are abandoned early, even among directions that all look alike


def test_scan_of_several_queries_equals_one_by_one():
    rng = np.random.default_rng(9)
    x, q = rng.standard_normal((700, 20)), rng.standard_normal((5, 20))
    for bounds in (None, np.array([np.inf, 1e-9, 12.0, 50.0, np.inf])):
        which, rows, away, _ = nn.adaptive_scan(q, nn.column_blocks(x), 4, bounds, epsilon=100.0)
        for i in range(5):
            d = ((x - q[i]) ** 2).sum(axis=1)
            want = [r for r in np.argsort(d)[:4] if bounds is None or d[r] <= bounds[i] * (1 + 1e-9)]
            assert rows[which == i].tolist() == want and np.allclose(away[which == i], d[want])


def test_recall_with_many_lists(spark, tmp_path):
    rng = np.random.default_rng(5)
    n = 50_000
    x = rng.standard_normal((n, 64)) + rng.standard_normal((10, 64))[rng.integers(0, 10, n)] * 0.5
    pq.write_table(pa.table({"vec_id": np.arange(n), "embedding": pa.FixedSizeListArray.from_arrays(x.ravel(), 64).cast(pa.list_(pa.float64()))}), tmp_path / "x.parquet")
    near = nn.nearest(spark.read.parquet(str(tmp_path / "x.parquet")), F.col("vec_id") % 500 == 0)
    got, probed = found(near), near.select("probes", "columns_read").distinct().collect()
    assert len(probed) == 1 and nn.PROBES <= probed[0]["probes"] <= 391
    print(probed)
    assert probed[0]["columns_read"] < 0.5  # more than half of the columns of probed vectors are never read
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    near = unit[::500] @ unit.T
    near[np.arange(len(near)), np.arange(0, n, 500)] = -1
    want = np.argsort(-near, axis=1)[:, :5]
    hits = sum(len({v for v, _ in got[500 * i]} & set(row.tolist())) for i, row in enumerate(want))
    print("recall", hits / want.size)
    assert hits >= 0.95 * want.size
