"""Column functions: scores, metrics, probabilities, grids and names."""

import math

import pytest
from pyspark.sql import functions as F

from touchline.functions import grid, names, probs, scores


def one(spark, **columns):
    return spark.range(1).select(*(c.alias(n) for n, c in columns.items())).first()


@pytest.mark.parametrize("home,away,want", [(2, 1, "H"), (0, 3, "A"), (1, 1, "D"), (0, 0, "D"), (None, 1, None), (1, None, None), (None, None, None), (10, 9, "H")])
def test_outcome(spark, home, away, want):
    assert one(spark, x=scores.outcome(F.lit(home).cast("int"), F.lit(away).cast("int")))["x"] == want


@pytest.mark.parametrize("text,want", [("2:1", (2, 1)), ("2-1", (2, 1)), (" 0:0 ", (0, 0)), ("3 : 2", (3, 2)), ("", (None, None)), ("abc", (None, None)), ("2:", (None, None)), (None, (None, None)), ("1:2:3", (None, None))])
def test_parse_score(spark, text, want):
    h, a = scores.parse_score(F.lit(text).cast("string"))
    assert tuple(one(spark, h=h, a=a)) == want


def bundle(spark, score, home, away, p):
    out = scores.metrics(F.lit(score).cast("string"), F.lit(home).cast("int"), F.lit(away).cast("int"), tuple(F.lit(x).cast("double") for x in p))
    return one(spark, **out, points=scores.points(F.lit(score).cast("string"), F.lit(home).cast("int"), F.lit(away).cast("int")), label=scores.label(F.lit(score).cast("string"), F.lit(home).cast("int"), F.lit(away).cast("int")))


def test_metrics(spark):
    r = bundle(spark, "2:1", 2, 1, (0.55, 0.25, 0.20))
    assert r["is_exact_hit"] and r["is_tendency_hit"] and r["score_error_abs"] == 0 and r["points"] == 4 and r["label"] == "exact"
    r = bundle(spark, "2:1", 1, 1, (0.55, 0.25, 0.20))
    assert not r["is_tendency_hit"] and r["points"] == 0 and r["label"] == "wrong"
    assert r["brier_score_1x2"] == pytest.approx((0.55**2 + 0.75**2 + 0.2**2) / 3, abs=1e-6)
    r = bundle(spark, "3:1", 2, 0, (0.5, 0.3, 0.2))
    assert r["label"] == "goal_diff" and r["points"] == 2 and r["goal_diff_error"] == 0 and r["score_error_abs"] == 2
    third = 1 / 3
    r = bundle(spark, "1:1", 0, 0, (third, third, third))
    assert r["brier_score_1x2"] == pytest.approx(2 / 9, abs=1e-6) and r["log_loss_1x2"] == pytest.approx(math.log(3), abs=1e-6)
    assert bundle(spark, "1:0", 1, 0, (1, 0, 0))["brier_score_1x2"] == 0 == bundle(spark, "1:0", 1, 0, (1, 0, 0))["log_loss_1x2"]
    assert bundle(spark, "1:0", 0, 1, (1, 0, 0))["brier_score_1x2"] == pytest.approx(2 / 3, abs=1e-6)
    r = bundle(spark, "1:0", 1, 0, (1.2, 0, 0))
    assert r["brier_score_1x2"] is None and r["log_loss_1x2"] is None
    r = bundle(spark, "2:0", None, None, (0.5, 0.3, 0.2))
    assert r["predicted_1x2"] == "H" and r["is_exact_hit"] is None and r["brier_score_1x2"] is None
    r = bundle(spark, "2-1", 2, 1, (0.5, 0.3, 0.2))
    assert r["points"] == 0 and r["is_exact_hit"]  # points take 'h:a' only, metrics take both


def test_probabilities(spark):
    d = spark.range(500).select(*((F.rand(seed) * (1 + seed % 3)).alias(n) for seed, n in enumerate("abc")))
    p = tuple(F.col(x) for x in "abc")
    out = d.select(*(x.alias(f"i{i}") for i, x in enumerate(probs.to_hundred(p))), *(x.alias(f"n{i}") for i, x in enumerate(probs.normalise(p))), *(x.alias(f"c{i}") for i, x in enumerate(probs.capped(p)))).collect()
    for r in out:
        assert r["i0"] + r["i1"] + r["i2"] == 100 and all(r[f"i{i}"] >= 0 for i in range(3))
        assert r["n0"] + r["n1"] + r["n2"] == pytest.approx(1) and r["c0"] + r["c1"] + r["c2"] == pytest.approx(1)
    r = one(spark, **{f"x{i}": x for i, x in enumerate(probs.capped((F.lit(0.9), F.lit(0.05), F.lit(0.05))))})
    assert r["x0"] == pytest.approx(0.79, abs=0.03)
    r = one(spark, **{f"x{i}": x for i, x in enumerate(probs.split_home(F.lit(1.4)))})
    assert tuple(r) == (1.0, 0.0, 0.0)


def test_grid(spark):
    h, a = F.lit(1.7), F.lit(0.9)
    cells = grid.cells(h, a)
    shifted = grid.low_score_shift(cells, h, a)
    r = one(spark, cells=cells, shifted=shifted, best=grid.best(cells)[0], **{f"o{i}": x for i, x in enumerate(grid.outcomes(shifted))})
    want = [math.exp(-1.7) * 1.7**i / math.factorial(i) * math.exp(-0.9) * 0.9**j / math.factorial(j) for i in range(7) for j in range(7)]
    assert r["cells"] == pytest.approx(want) and sum(r["shifted"]) == pytest.approx(1) and r["best"] == "1:0"
    assert r["o0"] + r["o1"] + r["o2"] == pytest.approx(1) and r["shifted"][0] < r["cells"][0]


def test_names(spark):
    n = lambda x: names.normal(F.lit(x))
    r = one(spark, a=n("  FC Köln/Süd-West "), b=n("Fußball Ñuñoa É."), c=names.without(n("FC Porto"), names.STOPWORDS_MATCH), d=names.without(n("FC"), names.STOPWORDS_MATCH), e=names.jaccard(F.lit("a b c"), F.lit("b c d")), f=names.prefix(F.lit("a b c"), F.lit("a b d e")), g=names.similarity(F.lit("inter milan"), F.lit("inter")), h=names.similarity(F.lit("x"), F.lit("x")), i=names.aliases(F.lit("FC St Pauli 1910")), j=names.trivial_difference(F.lit("a b"), F.lit("b a")))
    assert r["a"] == "fc koeln sued west" and r["b"] == "fussball nunoa e" and r["c"] == "porto" and r["d"] == "fc"
    assert r["e"] == 0.5 and r["f"] == 0.5 and r["g"] == pytest.approx(max(0.85 / 2, 0.9 * 5 / 11, 0.75 / 2), abs=1e-4) and r["h"] == 1.0 and r["j"]
    assert "st pauli" in r["i"]


def test_low_score_model_pinned(spark):
    """Rates 1.3 + d + 0.5 (fh - 0.5) and 1.0 - 0.7 d + 0.4 (fa - 0.5), worked out without Spark."""
    import math

    from pyspark.sql import functions as F

    from touchline.operators import models

    rows = [(80.0, 55.0, "WWDLW", "LLDLW"), (50.0, 50.0, "", ""), (None, 40.0, "WWW", "LLL")]
    d = spark.createDataFrame([(i, *r, 50) for i, r in enumerate(rows)], "match_id long, home_strength double, away_strength double, home_form string, away_form string, win_probability int")
    d = d.withColumns({c: F.lit(None).cast("double") for c in ("home_odds", "draw_odds", "away_odds")})
    share = lambda f: (3 * f.count("W") + f.count("D")) / (3 * len(f)) if f else 0.5
    for r in models.evaluate(d, {"dc": models.SERVER["dc"]}).collect():
        h, a, fh, fa = rows[r["match_id"]]
        diff = 0 if h is None else (h - a) / 100
        lh, la = max(0.3, 1.3 + diff + 0.5 * (share(fh) - 0.5)), max(0.3, 1.0 - 0.7 * diff + 0.4 * (share(fa) - 0.5))
        cell = {(i, j): math.exp(-lh - la) * lh**i * la**j / math.factorial(i) / math.factorial(j) for i in range(7) for j in range(7)}
        for k, t in {(0, 0): 1 - lh * la * 0.13, (1, 0): 1 + la * 0.13, (0, 1): 1 + lh * 0.13, (1, 1): 0.87}.items():
            cell[k] *= t
        total = sum(cell.values())
        assert abs(r["m_dc"]["prob_home"] - sum(p for (i, j), p in cell.items() if i > j) / total) < 1e-9
        assert abs(r["m_dc"]["prob_away"] - sum(p for (i, j), p in cell.items() if i < j) / total) < 1e-9
        best = max(cell, key=cell.get)
        assert r["m_dc"]["score"] == f"{best[0]}:{best[1]}"
