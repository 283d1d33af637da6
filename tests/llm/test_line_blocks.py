"""Posts of a key with many lines meet in blocks: the same pairs as in one comparison."""

from itertools import combinations


def test_blocks_lose_and_add_no_pair(spark):
    from touchline.llm import line_dedup

    # a hot key, a small one, a repeated row, lines that only probe (2), and one whose characters differ too much
    rows = [(1, 100 + i, 3) for i in range(60)] + [(1, 7, 2), (1, 8, 2), (1, 9, 4 << 2 | 7 << 11 | 3), (1, 100, 3), (2, 1, 1), (2, 2, 2), (3, 5, 3)]
    posted = spark.createDataFrame(rows, "key long, line long, note int")
    want = set(combinations(range(100, 160), 2)) | {(p, 100 + i) for p in (7, 8) for i in range(60)} | {(1, 2)}
    for block in (4, 25, 1000):
        got = [(r["a"], r["b"]) for r in line_dedup._met(posted, 2, block).collect()]
        assert len(got) == len(set(got)) and set(got) == want
    assert line_dedup._met(posted.limit(0), 2, 4).count() == 0
