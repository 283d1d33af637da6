"""Lines of one template: classes as by brute force, links fewer than lines, whatever the blocks."""

import random
from itertools import combinations

import numpy as np
import pytest


def _points(x):
    return np.frombuffer(x.encode("utf-32-le"), np.uint32)


def _classes(lines, edits=2):
    """The first line of each line's class, from all pairs."""
    from touchline.llm.line_dedup import near

    pairs = list(combinations(range(len(lines)), 2))
    label = list(range(len(lines)))
    for (i, j), hit in zip(pairs, near([(_points(lines[i]), _points(lines[j])) for i, j in pairs], edits), strict=True):
        if hit and label[i] != label[j]:
            low, high = sorted((label[i], label[j]))
            label = [low if x == high else x for x in label]
    return label


def _template(n, seed):
    r = random.Random(seed)
    numbers = r.sample(range(10**6), n)
    return [f"Item number {k:06d} is sold out in the shop" + ("s" if k % 5 == 0 else "") for k in numbers]


@pytest.mark.parametrize("block", [64, 200, 4096])
def test_template_lines(spark, tmp_path, block):
    from touchline.llm.line_dedup import dedup_lines

    lines = _template(500, block)
    random.Random(1).shuffle(lines)
    label = _classes(lines)
    assert 20 < len(set(label)) < 480
    rows = [(d, "\n".join(lines[d * 5 : d * 5 + 5])) for d in range(100)]
    want = {d: "\n".join(lines[i] for i in range(d * 5, d * 5 + 5) if label[i] == i) for d in range(100)}
    path = str(tmp_path / "d")
    spark.createDataFrame(rows, "doc_id long, text string").repartition(3).write.parquet(path)
    assert {r["doc_id"]: r["text"] for r in dedup_lines(spark.read.parquet(path), block=block).collect()} == want


def test_links_are_fewer_than_lines():
    from touchline.llm.line_dedup import forest

    lines = _template(3000, 7)
    found = forest(np.full(len(lines), 3), [_points(x) for x in lines], 2)
    assert 0 < len(found) < len(lines)
    root = list(range(len(lines)))

    def top(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, j in found:
        assert top(i) != top(j)  # no circle
        root[max(top(i), top(j))] = min(top(i), top(j))
    label = _classes(lines[:400])
    for i, j in combinations(range(400), 2):
        if label[i] == label[j]:
            assert top(i) == top(j)
    assert forest(np.full(1, 3), [_points("one line alone")], 2) == []


def test_sides_of_two_blocks_only_meet_each_other():
    from touchline.llm.line_dedup import SIDE, forest

    points = [_points(x) for x in ("a line of the first block", "a line of the first blocs", "a line of the first blick")]
    note = np.array([1 << SIDE | 3, 1 << SIDE | 3, 2 << SIDE | 3])
    assert sorted(forest(note, points, 2)) == [(0, 2), (1, 2)]
