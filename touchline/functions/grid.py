"""Score grids: 49 cells of goals 0 to 6 for either side, as an array of probabilities by 7 * home + away."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .probs import Triple

GOALS = 7


def poisson(k: int, rate: Column) -> Column:
    factorial = 1.0
    for i in range(2, k + 1):
        factorial *= i
    return F.exp(-rate) * F.pow(rate, F.lit(float(k))) / F.lit(factorial)


def cells(home: Column, away: Column) -> Column:
    """Products of the marginals; each marginal is computed once."""
    h, a = F.array(*(poisson(k, home) for k in range(GOALS))), F.array(*(poisson(k, away) for k in range(GOALS)))
    return F.flatten(F.transform(h, lambda x: F.transform(a, lambda y: x * y)))


def low_score_shift(grid: Column, home: Column, away: Column, rho: float = 0.13) -> Column:
    """Adjust 0:0, 1:0, 0:1 and 1:1 for dependence and normalise.  With this positive rho draws get rarer."""
    factor = lambda i: (
        F.when(i == 0, 1 - home * away * rho).when(i == GOALS, 1 + away * rho).when(i == 1, 1 + home * rho).when(i == GOALS + 1, F.lit(1 - rho)).otherwise(1.0)
    )
    moved = F.transform(grid, lambda p, i: F.greatest(p * factor(i), F.lit(0.0)))
    # bound in a struct, as a lambda would sum anew for each cell
    summed = F.struct(moved.alias("cells"), F.aggregate(moved, F.lit(0.0), lambda s, p: s + p).alias("total"))
    return F.transform(F.array(summed), lambda s: F.transform(s["cells"], lambda p: p / s["total"]))[0]


def outcomes(grid: Column) -> Triple:
    """Home, draw and away mass of a grid."""
    indexed = F.transform(grid, lambda p, i: F.struct(p.alias("p"), F.floor(i / GOALS).alias("h"), (i % GOALS).alias("a")))
    mass = lambda keep: F.aggregate(F.filter(indexed, keep), F.lit(0.0), lambda s, c: s + c["p"])
    return mass(lambda c: c["h"] > c["a"]), mass(lambda c: c["h"] == c["a"]), mass(lambda c: c["h"] < c["a"])


def best(grid: Column) -> tuple[Column, Column]:
    """The likeliest score as 'h:a' and its probability; of equals the first cell."""
    top = F.array_max(F.transform(grid, lambda p, i: F.struct(p.alias("p"), (-i).alias("neg"))))
    i = -top["neg"]
    return F.concat_ws(":", F.floor(i / GOALS).cast("string"), (i % GOALS).cast("string")), top["p"]


def winner_by_threshold(p: Triple) -> Column:
    return F.when(p[0] >= 0.45, "home").when(p[2] >= 0.32, "away").otherwise("draw")


def winner_by_largest(p: Triple) -> Column:
    return F.when((p[0] >= p[1]) & (p[0] >= p[2]), "home").when((p[2] >= p[0]) & (p[2] >= p[1]), "away").otherwise("draw")
