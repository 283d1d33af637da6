"""Budgets worked out by Spark against the plain tree, and prefixes of a leaf that holds most rows."""

import random

import pytest


def test_budgets_are_those_of_the_plain_tree(spark):
    from touchline.llm import mixing

    rng = random.Random(3)
    names = [(d, x, s) for d in ("a", "b", None) for x in ("en", "de", None) for s in ("x", "y", "z", None)]
    tokens = {k: rng.randrange(1, 1000) for k in names}
    text = lambda v: "\x1e" if v is None else v
    stats = spark.createDataFrame([("\x1f".join(map(text, k)), *k, n) for k, n in tokens.items()], "_leaf string, domain string, lang string, source string, tokens long")
    for weights in (mixing.Weights(), mixing.Weights(domain={"a": 5, "b": 0.0}, lang={"en": 3}, source={"x": 0.1, "y": 0.0}), mixing.Weights(domain={"a": 0.0, "b": 0.0}, other=0.0)):
        for share in (0.1, 0.8, 2.5):
            want = mixing.leaf_budgets(sorted(tokens.items(), key=str), weights, share * sum(tokens.values()), 2)
            got = {r["_leaf"]: r["budget"] for r in mixing.budgets(stats, weights, share, 2).collect()}
            assert got == pytest.approx({"\x1f".join(map(text, k)): b for k, b in want.items()})


def test_prefix_of_a_dominant_leaf_is_the_longest_that_fits(spark):
    from touchline.llm import mixing

    docs = spark.range(3000).selectExpr("id AS doc_id", "repeat('w ', int(id % 7)) AS text", "'en' AS lang", "if(id % 50 = 0, 'src1', 'src0') AS source")
    rows = mixing.mix_ids(docs, share=0.5, max_epochs=1).collect()
    big = [r for r in rows if r["source"] == "src0"]
    total = {i: sum(k % 7 for k in range(3000) if (k % 50 == 0) == (i == 1)) for i in (0, 1)}
    budget = mixing.leaf_budgets([((f"domain{i}", "en", f"src{i}"), total[i]) for i in (0, 1)], mixing.Weights(), 0.5 * sum(total.values()), 1)["domain0", "en", "src0"]
    assert budget - 6 <= sum(r["n_tokens"] for r in big) <= budget
    assert len({r["doc_id"] for r in big}) == len(big)
