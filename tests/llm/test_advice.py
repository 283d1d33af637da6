"""Cases that a review found missing: each failed before the operator did the whole job."""

import numpy as np
import pytest


@pytest.mark.parametrize("dim,rank", [(64, 8), (96, 4)])
def test_embeddings_of_low_rank(spark, tmp_path, dim, rank):
    """Vectors that fill fewer dimensions than they have, and vectors of other lengths: every link is found."""
    from touchline.llm.embedding_dups import near_duplicates

    rng = np.random.default_rng(rank)
    flat = rng.normal(size=(900, rank))
    flat[600:] = flat[:300] + 0.3 * rng.normal(size=(300, rank))
    x = (flat @ np.linalg.qr(rng.normal(size=(dim, rank)))[0].T).astype(np.float32)
    other = rng.normal(size=(20, 5)).astype(np.float32)
    one = np.array([[1.0], [2.0], [-3.0]], np.float32)
    groups = [x, np.concatenate([other, other + np.float32(0.01)]), one]
    rows, want = [], {}
    for g in groups:
        u = g.astype(float) / np.linalg.norm(g.astype(float), axis=1)[:, None]
        hit = u @ u.T >= 0.93
        np.fill_diagonal(hit, False)
        want |= {len(rows) + i: int(n) for i, n in enumerate(hit.sum(1))}
        rows += [(len(rows) + i, v.tolist(), 1) for i, v in enumerate(g)]
    path = str(tmp_path / "v")
    spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").repartition(3).write.parquet(path)
    got = {r["vec_id"]: r["n_links"] for r in near_duplicates(spark.read.parquet(path), vectors_per_cell=8, block=64).collect()}
    assert got == want and sum(want.values()) > 300


def test_packing_of_added_tokens(spark):
    """Ids are those of the JSON file's tokenizer with its default settings."""
    import public_tokenizers
    from tokenizers import Tokenizer

    from touchline.llm.packing import pack

    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    texts = ["a page <|endoftext|> next", "<|endoftext|><|endoftext|>", "x\n  <|endoftext|>\n<|endoftext", "none"]
    want = {i: [*t.encode(x, add_special_tokens=False).ids, 0] for i, x in enumerate(texts)}
    got = {r["doc_id"]: r["ids"] for r in pack(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    assert got == want and want[0] == [64, 2443, 220, 50256, 1306, 0]


def test_quality_cut_withstands_noise():
    """Junk among the trusted positives doesn't let the junk in."""
    from touchline.llm import quality_model as q

    rng = np.random.default_rng(3)
    good, bad = rng.normal(0.2, 0.05, (4000, q.N_FEATURES)), rng.normal(0.6, 0.1, (2000, q.N_FEATURES))
    trusted = np.concatenate([good[:1000], bad[:10]])
    negative = np.concatenate([bad[10:300], good[1000:1003]])
    for more in ([], [negative]):
        model = q.fit(trusted, np.concatenate([good[1000:3000], bad[300:800]]), *more)
        assert (model.score(good[3000:]) >= q.THRESHOLD).mean() > 0.95 and (model.score(bad[800:]) >= q.THRESHOLD).mean() < 0.02


def test_quality_with_all_rows_labelled(spark):
    from touchline.llm import quality_model as q

    docs = spark.createDataFrame([(i, "The house stood, quiet and old, near a river." if i % 3 else "BUY | NOW | !!! BUY BUY $$$ %%% ###") for i in range(300)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i % 3 > 0), 0) for i in range(300)], "doc_id long, quality int, toxic int")
    got = {r["doc_id"]: r["predicted"] for r in q.score(docs, q.train(docs, labels)).collect()}
    assert got == {i: int(i % 3 > 0) for i in range(300)}


@pytest.mark.parametrize("long_list", [128, 4096])
def test_large_group_of_near_copies(spark, tmp_path, long_list):
    """Different near copies of one text, more than a post list holds, some linked only through others, and a common passage."""
    import random

    from touchline.llm.near_dups import near_duplicates

    rng = random.Random(12)
    base = [f"w{rng.randrange(10**6)}" for _ in range(70)]
    passage = [f"p{i}" for i in range(40)]
    texts = []
    for i in range(900):
        t = list(base)
        for k in rng.sample(range(70), rng.choice([1, 2, 2, 3])):
            t[k] = f"x{rng.randrange(10**6)}"
        texts.append(" ".join(t))
    texts += [" ".join(passage + [f"y{rng.randrange(10**6)}" for _ in range(rng.choice([4, 6, 60]))]) for _ in range(400)]
    path = str(tmp_path / "g")
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3).write.parquet(path)
    sets = [{tuple(w[i : i + 3]) for i in range(len(w) - 2)} for w in map(str.split, texts)]
    up = list(range(len(sets)))

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for a in range(len(sets)):
        for b in range(a):
            if find(a) != find(b):
                both = len(sets[a] & sets[b])
                if 100 * both >= 85 * (len(sets[a]) + len(sets[b]) - both):
                    x, y = sorted((find(a), find(b)))
                    up[y] = x
    got = {r["doc_id"]: r["component_id"] for r in near_duplicates(spark.read.parquet(path), shingle=3, percent=85, long_list=long_list).collect()}
    assert got == {i: find(i) for i in range(len(sets))}


def test_pivots_bound_a_list():
    """A list of many near copies leaves one edge for each row, in time that grows with the rows."""
    from touchline.llm.near_dups import pivot_edges

    rng = np.random.default_rng(5)
    sketch = np.repeat(rng.integers(0, 256, (1, 64), dtype=np.uint8), 20_000, axis=0)
    for i in range(len(sketch)):
        sketch[i, rng.choice(64, 6, replace=False)] = rng.integers(0, 256, 6, dtype=np.uint8)
    assert len(pivot_edges(sketch, 64, 43)) == len(sketch) - 1


def test_rows_of_a_shuffled_input_are_numbered_once(spark, tmp_path):
    from pyspark.sql import functions as F

    from touchline.llm.near_dups import drop_near_duplicates
    from touchline.llm.store import fixed

    path = str(tmp_path / "s")
    spark.range(200).select(F.col("id").alias("doc_id"), F.concat_ws(" ", *(F.concat(F.lit(w), (F.col("id") % 100).cast("string")) for w in "abcdefgh")).alias("text")).write.parquet(path)
    read = spark.read.parquet(path)
    assert fixed(read.filter("doc_id >= 0").select("doc_id", "text")).inputFiles() == read.inputFiles()
    mixed = read.repartition(7, F.rand())
    assert set(fixed(mixed).inputFiles()).isdisjoint(read.inputFiles())
    assert sorted(r[0] for r in drop_near_duplicates(mixed).select("doc_id").collect()) == list(range(100))
