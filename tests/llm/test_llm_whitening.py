"""Embedding whitening against a plain solver."""

import math

import numpy as np
import pytest

from meterlake.llm import queries, whitening

SF = "/root/testdata/sf0.001"


def slow(rows):
    """{id: [(deviation, components up to sign)]} by exact sums and one solver in double precision."""
    kept = [(i, [math.floor(256 * float(c)) for c in v]) for i, v in rows if v and all(c is not None and math.isfinite(c) for c in v)]
    listed = sorted({tuple(x) for _, x in kept})
    n, sums = len(listed), [sum(c) for c in zip(*listed, strict=True)]
    x = np.array(listed, float)
    v = np.cov(x.T, bias=True)
    e, c = np.linalg.eigh(v)
    e, c = e[::-1][:4], c[:, ::-1][:, :4]
    out = []
    for i, own in kept:
        off = [n * a - s for a, s in zip(own, sums, strict=True)]
        out.append((i, sum(o * o for o in off), (np.array(off) / n) @ c / np.sqrt(e), e / np.trace(v)))
    return n, out


def held(rows, expected, n):
    got = {}
    for r in rows:
        got.setdefault((r["vec_id"], r["deviation"]), []).append(r)
        assert r["n"] == n and abs(r["identity_error"]) < 1e-9
    for i, deviation, w, share in expected:
        own = sorted(got[i, deviation], key=lambda r: r["component"])
        assert {r["component"] for r in own} == {1, 2, 3, 4}
        for r in own:
            k = r["component"] - 1
            assert abs(abs(r["whitened"]) - abs(w[k])) < 1e-9 and abs(r["explained"] / share[k] - 1) < 1e-9
    assert len(rows) == 4 * len(expected)


def test_whole_table(spark):
    rows = queries.op11_embedding_whitening(spark, SF).collect()
    table = [(r["vec_id"], r["embedding"]) for r in spark.read.parquet(f"{SF}/embeddings.parquet").collect()]
    n, expected = slow(table)
    held(rows, expected, n)
    by = {}
    for r in rows:
        by.setdefault(r["component"], []).append(r["whitened"])
    # whitened copies count once in the fit, and this table has few: variances are near one
    assert all(abs(np.var(v) - 1) < 0.05 for v in by.values())


def test_odd_rows(spark):
    rng = np.random.default_rng(5)
    rows = [(i, rng.normal(size=6).round(3).tolist()) for i in range(60)]
    rows += [(3, rows[3][1]), (None, rows[4][1]), (70, None), (71, []), (72, [1.0, None, 0.0, 0.0, 0.0, 0.0]), (73, [float("nan")] * 6), (74, [float("inf")] * 6)]
    df = spark.createDataFrame([(i, v, "x", 1) for i, v in rows], "vec_id long, embedding array<double>, n string, component int").repartition(3)
    n, expected = slow(rows)
    assert n == 60
    got = whitening.whiten(df, whitening.fit(df)).collect()
    held([r for r in got if r["vec_id"] not in (3, None)], [e for e in expected if e[0] not in (3, None)], n)
    assert sum(r["vec_id"] == 3 for r in got) == 8 and sum(r["vec_id"] is None for r in got) == 4


def test_little_variance(spark):
    kinds = "vec_id long, embedding array<float>"
    for rows in ([], [(1, None)], [(1, [1.0, 2.0]), (2, [1.0, 2.0])]):
        df = spark.createDataFrame(rows, kinds)
        assert whitening.whiten(df, whitening.fit(df)).collect() == []
    df = spark.createDataFrame([(1, [1.0, 2.0, 0.0]), (2, [2.0, 4.0, 0.0]), (3, [1.0, 2.0, 0.0])], kinds)
    got = whitening.whiten(df, whitening.fit(df)).collect()
    assert sorted((r["vec_id"], r["component"], round(abs(r["whitened"]), 9), r["explained"]) for r in got) == [(1, 1, 1.0, 1.0), (2, 1, 1.0, 1.0), (3, 1, 1.0, 1.0)]
    with pytest.raises(Exception, match="several lengths"):
        whitening.fit(spark.createDataFrame([(1, [1.0]), (2, [1.0, 2.0])], kinds))


def test_partitions_do_not_matter(spark):
    df = spark.read.parquet(f"{SF}/embeddings.parquet")
    one, many = whitening.fit(df.coalesce(1)), whitening.fit(df.repartition(13))
    assert one.values.tolist() == many.values.tolist() and one.vectors.tolist() == many.vectors.tolist()


@pytest.mark.parametrize("gap", [0.0, 1e-12, 1e-9, 1e-5, 1e-2])
def test_clusters(gap):
    """Eigenvalues that float32 can't tell apart: vectors are right to double precision as far as the matrix itself tells."""
    rng = np.random.default_rng(1)
    n = 24
    q, _ = np.linalg.qr(rng.normal(size=(n, n)))
    q = q.astype(np.longdouble)
    for _ in range(3):  # orthogonal in the wider type
        q = q + q @ (np.eye(n, dtype=np.longdouble) - q.T @ q) / 2
    e = np.sort(np.append(1 + gap * np.arange(4), rng.uniform(2, 9, n - 4)).astype(np.longdouble))[::-1]
    a = (q * e) @ q.T
    values, x = whitening.refined((a + a.T) / 2)
    assert float(np.abs(values - e).max()) < 1e-16
    assert float(np.abs(x.T @ x - np.eye(n)).max()) < 1e-16
    assert float(np.abs(a @ x - x * values).max()) < 1e-16
    if gap >= 1e-9:
        assert float(np.abs(np.abs((q * x).sum(axis=0)) - 1).max()) < 1e-15
