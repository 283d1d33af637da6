"""Hard negatives against a full search, and their edge cases."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from touchline.llm.hard_negatives import Lists, kmeans, mine, nearest

SCHEMA = "vec_id long, embedding array<double>, label int, row string, asks int, cell string, score string"
COLUMNS = ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]


def frame(spark, tmp_path, rows, name="e"):
    path = str(tmp_path / name)
    spark.createDataFrame([(i, v, label, "r", 1, "c", "s") for i, v, label in rows], SCHEMA).repartition(4).write.parquet(path)
    return spark.read.parquet(path)


def plain(rows, every, positives=5, negatives=10):
    rows = [(i, np.floor(256 * np.array(v)).astype(np.int64), label) for i, v, label in rows if v is not None and label is not None and None not in v and len(v) and np.isfinite(v).all()]
    order = lambda found: sorted(found, key=lambda x: (-x[0], x[1] is None, x[1] or 0))
    out = []
    for a, (i, x, label) in enumerate(rows):
        if i is None or i % every:
            continue
        scored = [(int(x @ y), j, other) for b, (j, y, other) in enumerate(rows) if b != a and len(y) == len(x)]
        for score, j, _ in order(s for s in scored if s[2] == label)[:positives]:
            window = order(s for s in scored if s[2] != label and 30 * score <= 100 * s[0] <= 90 * score)
            out += [(i, j, rank, s[1], score, s[0]) for rank, s in enumerate(window[:negatives], 1)]
    return sorted(out, key=repr)


def mined(df, every, **how):
    return sorted((tuple(r[c] for c in COLUMNS) for r in mine(df, F.col("vec_id") % every == 0, **how).collect()), key=repr)


def cloud(n, dim, seed, spread=1.0):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(9, dim))
    return [(i, (centres[rng.integers(9)] + spread * rng.normal(size=dim) / 3).tolist(), int(rng.integers(4))) for i in range(n)]


@pytest.mark.parametrize(("dim", "first", "spread"), [(8, 1, 0.2), (8, 4, 1.0), (5, 2, 0.05)])
def test_against_full_search(spark, tmp_path, dim, first, spread):
    rows = cloud(900, dim, dim + first, spread)
    rows += [(1000 + i, rows[3][1], i % 4) for i in range(300)]  # many copies of one vector, of all labels
    want = plain(rows, 20)
    assert want and mined(frame(spark, tmp_path, rows), 20, lists=24, fewest_rows=16, first=first) == want


def test_many_blocks(spark, tmp_path):
    rows = cloud(500, 6, 2)
    assert mined(frame(spark, tmp_path, rows), 25, lists=2, fewest_rows=1, block_bytes=8 * 6 * 40) == plain(rows, 25)


def test_edges(spark, tmp_path):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 0.0], 1), (0, [1.0, 0.0], 1), (1, [1.0, 0.5], 1), (1, [1.0, 0.5], 1), (2, [0.8, 0.0], 2), (2, [0.8, 0.0], 2), (None, [0.8, 0.1], 2), (None, [0.9, 0.0], 1)]
    rows += [(3, None, 1), (4, [1.0, None], 2), (5, [nan, 1.0], 2), (6, [inf, 1.0], 1), (7, [], 1), (8, [0.5, 0.5], None), (20, [1.0, 2.0, 3.0], 1), (40, [-1.0, -1.0], 3)]
    got = mined(frame(spark, tmp_path, rows), 20)
    assert got == plain(rows, 20) and got
    assert mined(frame(spark, tmp_path, [], "none"), 20) == []


def test_large_components(spark, tmp_path):
    rows = [(0, [60_000.0, 1.5], 1), (1, [61_000.0, 2.5], 1), (2, [40_000.0, 0.0], 2), (3, [1e200, 0.0], 2), (4, [50_000.5, 7.25], 2)]
    got = mined(frame(spark, tmp_path, rows), 20)
    want = [r for r in plain([r for r in rows if r[0] != 3], 20)]
    assert [r[:4] for r in got if r[3] != 3] == [r[:4] for r in want] and [r[4:] for r in got if r[3] != 3] == [r[4:] for r in want]


def test_bounds_hold():
    x = np.random.default_rng(4).normal(size=(400, 7))
    centroids = kmeans(x, 12)
    own, far = nearest(x, centroids)
    radii = np.array([far[own == c].max(initial=0) for c in range(len(centroids))])
    least, most = Lists(centroids, radii).bounds(x[:50])
    scores = x[:50] @ x.T
    assert (scores <= most[:, own]).all() and (scores >= least[:, own]).all()


def test_label_expression(spark, tmp_path):
    rows = cloud(300, 6, 3)
    shifted = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 4).otherwise(F.col("label"))
    want = plain([(i, v, (label + 1) % 4 if i % 7 == 0 else label) for i, v, label in rows], 20)
    assert mined(frame(spark, tmp_path, rows), 20, label=shifted) == want
