"""Probability arithmetic on columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

Triple = tuple[Column, Column, Column]


def clamp(x: Column, low: float, high: float) -> Column:
    """x within its bounds; null stays null (greatest and least alone would skip it)."""
    return F.when(x.isNotNull(), F.greatest(F.lit(low), F.least(F.lit(high), x)))


def normalise(p: Triple) -> Triple:
    """Shares of the sum; thirds where the sum isn't positive."""
    total = p[0] + p[1] + p[2]
    return tuple(F.when(total > 0, x / total).otherwise(F.lit(1.0) / 3) for x in p)  # type: ignore[return-value]


def _held(p: Triple, low: float = 0.08, high: float = 0.70) -> Triple:
    return tuple(clamp(x, low, high) for x in p)  # type: ignore[return-value]


#: The steps of capping, one after the other; the result may pass the cap again.
CAPPING = (normalise, _held, normalise, _held, normalise)


def capped(p: Triple) -> Triple:
    """All steps of capping in one expression; for a few rows or constants."""
    for step in CAPPING:
        p = step(p)
    return p


def let(value: Column, use) -> Column:
    """``use(value)`` with the value worked out once: written out, an expression that uses a value three times holds it three times."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


SIDES = ("home", "draw", "away")


def three(p: Triple) -> Column:
    return F.struct(*(x.alias(s) for x, s in zip(p, SIDES, strict=True)))


def steps(p: Column, *each) -> Column:
    """A struct of home, draw and away put through steps from three columns to three, each bound to the one before.

    The expression grows by the step, not by its power, so that filters on what follows from it can be moved through it.
    """
    bound = lambda step: lambda v: three(step(tuple(v[s] for s in SIDES)))
    for step in each:
        p = let(p, bound(step))
    return p


def split_home(p: Column) -> Triple:
    """A home win probability alone: the rest goes to draw and away as 0.481 to 0.519."""
    p = clamp(p, 0.0, 1.0)
    return p, (1 - p) * 0.481, (1 - p) * 0.519


def to_hundred(p: Triple) -> Triple:
    """Integers that sum to 100 by largest remainders; of equal remainders the first gets the unit."""
    p_total = p[0] + p[1] + p[2]
    v = [x / p_total * 100.0 for x in p]
    whole = [F.floor(x).cast("int") for x in v]
    part = [x - w for x, w in zip(v, whole, strict=True)]
    left = F.lit(100) - whole[0] - whole[1] - whole[2]
    out = []
    for i in range(3):
        before = sum((((part[j] > part[i]) if j > i else (part[j] >= part[i])).cast("int") for j in range(3) if j != i), F.lit(0))
        out.append(F.when(p_total > 0, whole[i] + (before < left).cast("int")).otherwise(F.lit((34, 33, 33)[i])))
    return tuple(out)  # type: ignore[return-value]


def fair(odds: Triple) -> tuple[Triple, Column]:
    """Probabilities freed of the bookmaker's margin and that margin's sum; null unless all odds are above 1."""
    ok = (odds[0] > 1.0) & (odds[1] > 1.0) & (odds[2] > 1.0)
    total = 1.0 / odds[0] + 1.0 / odds[1] + 1.0 / odds[2]
    return tuple(F.when(ok, 1.0 / x / total) for x in odds), F.when(ok, total)  # type: ignore[return-value]


def expected_value(p: Column, odds: Column) -> Column:
    return F.when(odds > 1.0, F.bround(p * odds - 1.0, 6))
