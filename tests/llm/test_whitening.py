"""Whitening against a plain numpy version, and its edge cases."""

import numpy as np
import pytest

from touchline.llm.whitening import digest, whiten

SCHEMA = "vec_id long, embedding array<double>, label int, id string, x int, component int, n string"


def frame(spark, tmp_path, vectors, name="e"):
    path = str(tmp_path / name)
    spark.createDataFrame([(i, v, 1, "a", 2, 3, "b") for i, v in vectors], SCHEMA).repartition(3).write.parquet(path)
    return spark.read.parquet(path)


def plain(e, most=16):
    """(n, deviations, whitened, explained) of the rows of ``e``."""
    x = np.floor(64 * e).astype(np.int64) + 1_000_000
    fit = np.unique(x, axis=0)
    n, sums = len(fit), fit.sum(0)
    centred = fit - sums / n
    v = centred.T @ centred / n
    values, vectors = np.linalg.eigh(v)
    order = np.argsort(-values)[:most]
    return n, ((n * x - sums) ** 2).sum(1), (x - sums / n) @ vectors[:, order] / np.sqrt(values[order]), values[order] / np.trace(v)


@pytest.mark.parametrize("dim", [3, 16, 21])
def test_against_numpy(spark, tmp_path, dim):
    rng = np.random.default_rng(dim)
    e = rng.normal(size=(300, dim)) * np.linspace(3, 0.5, dim)
    e[100:200] = e[7]  # a third of all rows are copies
    rows = digest(whiten(frame(spark, tmp_path, [(i, v.tolist()) for i, v in enumerate(e)]))).collect()
    most = min(16, dim)
    assert len(rows) == len(e) * most
    n, deviation, whitened, explained = plain(e)
    assert n == 200
    got = np.zeros((len(e), most))
    for r in rows:
        got[r["vec_id"], r["component"] - 1] = r["whitened"]
        assert r["n"] == n and r["deviation"] == deviation[r["vec_id"]]
        assert r["explained"] == pytest.approx(explained[r["component"] - 1], rel=1e-8) and r["identity_error"] <= 1e-9
    for k in range(most):
        a, b = got[:, k], whitened[:, k]
        assert min(np.abs(a - b).max(), np.abs(a + b).max()) < 1e-7


def test_any_tile_gives_the_same(spark, tmp_path):
    e = np.random.default_rng(1).normal(size=(60, 11))
    docs = frame(spark, tmp_path, [(i, v.tolist()) for i, v in enumerate(e)])
    a, b = (sorted((r["vec_id"], r["component"], abs(r["whitened"])) for r in whiten(docs, tile=t).collect()) for t in (4, 11))
    assert [x[:2] for x in a] == [x[:2] for x in b] and np.allclose([x[2] for x in a], [x[2] for x in b])


def test_edges(spark, tmp_path):
    nan, inf = float("nan"), float("inf")
    rows = [(1, None), (2, [1.0, None]), (3, [1.0, nan]), (4, [inf, 0.0]), (5, [])]
    good = [(6, [0.0, 1.0]), (None, [0.0, 1.0]), (7, [2.0, 1.0]), (7, [2.0, 1.0]), (8, [1.0, 1.0])]
    other = [(9, [1.0, 2.0, 3.0])]
    out = whiten(frame(spark, tmp_path, rows + good + other)).collect()
    assert out[0].__fields__ == ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"]
    two = [r for r in out if r["vec_id"] != 9]
    assert sorted(str(r["vec_id"]) for r in two) == sorted(str(i) for i, _ in good for _ in range(2))
    assert {r["n"] for r in two} == {3}
    flat = [r for r in two if r["component"] == 2]  # the second dimension is constant
    assert all(r["whitened"] == 0 and r["explained"] == 0 for r in flat) and all(r["explained"] == 1 for r in two if r["component"] == 1)
    alone = [r for r in out if r["vec_id"] == 9]  # of its own length, without variance
    assert len(alone) == 3 and all(r["n"] == 1 and r["deviation"] == 0 and r["whitened"] == r["explained"] == r["identity_error"] == 0 for r in alone)
    assert whiten(frame(spark, tmp_path, [], "none")).count() == 0


def test_very_large_entries(spark, tmp_path):
    e = [(1, [1e300, 1.0]), (2, [-1e300, 2.0]), (3, [1e9, 3.0]), (4, [1e9, 4.0])]
    out = whiten(frame(spark, tmp_path, e)).collect()
    assert len(out) == 8 and all(np.isfinite(r["whitened"]) for r in out)
    most = 1 << 60
    x = [most + 1_000_000, -most + 1_000_000, 64 * 10**9 + 1_000_000, 64 * 10**9 + 1_000_000]
    y = [64 * i + 1_000_000 for i in range(1, 5)]
    want = {i + 1: (4 * x[i] - sum(x)) ** 2 + (4 * y[i] - sum(y)) ** 2 for i in range(4)}
    assert {r["vec_id"]: int(r["deviation"]) for r in out} == want
    assert {r["deviation"] for r in digest(whiten(frame(spark, tmp_path, e, "again"))).collect()} == {None}  # beyond a long
