"""Score grids as plain columns: 49 cells of goals 0 to 6 for either side, from the two marginals alone.

A grid is the product of two columns of seven probabilities, with four cells moved where low scores
depend.  Outcomes and the likeliest score follow from sums and maxima of the marginals, so that all stays
in plain, compiled expressions; only ``likeliest`` spells the grid out, for the few places that list scores.
"""

from __future__ import annotations

from math import factorial

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .grid import GOALS, poisson
from .probs import Triple


def tau(rho: float) -> dict[tuple[int, int], str]:
    """Factors of the four low scores, over the rates _h and _a.  With a positive rho draws get rarer."""
    return {(0, 0): f"(1 - _h * _a * {rho}d)", (1, 0): f"(1 + _a * {rho}d)", (0, 1): f"(1 + _h * {rho}d)", (1, 1): f"{1 - rho}d"}


def with_grid(df: DataFrame, home: Column, away: Column, rho: float = 0.0) -> DataFrame:
    """``df`` with the grid's columns: _h0 to _h6 and _a0 to _a6, the low scores' cells _l00 to _l11, the masses
    of the outcomes _m0 to _m2, _mass, what all cells are divided by, and _top and _cell, the largest cell and its place.

    Each is a column of its own, so that no expression is worked out twice.  They are given as SQL texts, a call
    for each step, as building them column by column took longer than small tables need to be read.
    """
    def add(frame: DataFrame, columns: dict[str, str]) -> DataFrame:
        kept = [f"`{c}`" for c in frame.columns if c not in columns]
        return frame.selectExpr(*kept, *(f"{text} as {name}" for name, text in columns.items()))

    beyond = range(2, GOALS)
    df = add(df.withColumns({"_h": home, "_a": away}), {f"_{s}{k}": f"exp(-_{s}) * power(_{s}, {k}d) / {factorial(k)}d" for s in "ha" for k in range(GOALS)})
    low = {(i, j): f"_h{i} * _a{j}" for i in (0, 1) for j in (0, 1)}
    if rho:
        low = {k: f"greatest({low[k]} * {t}, 0d)" for k, t in tau(rho).items()}
    # fewer goals than k, for either side
    fewer = {f"_{s}_{k}": " + ".join(f"_{s}{j}" for j in range(k)) for s in "ha" for k in beyond}
    df = add(df, {f"_l{i}{j}": c for (i, j), c in low.items()} | fewer)
    more = lambda s, other: " + ".join(["0d", *(f"_{s}{k} * _{other}_{k}" for k in beyond)])
    level = " + ".join(["_l00 + _l11", *(f"_h{k} * _a{k}" for k in beyond)])
    df = add(df, {"_m0": f"_l10 + ({more('h', 'a')})", "_m1": level, "_m2": f"_l01 + ({more('a', 'h')})"} | {f"_{s}{n}_top": _top(s, n) for s, n in (("h", 2), ("a", 0), ("a", 2))})
    df = add(df, {"_mass": "_m0 + _m1 + _m2" if rho else "1d"} | {f"_{s}{n}_at": _at(s, n) for s, n in (("h", 2), ("a", 0), ("a", 2))})
    # beyond the low scores the largest cell lies where both marginals are largest
    cells = [(f"_l{i}{j}", f"{i * GOALS + j}") for i in (0, 1) for j in (0, 1)]
    cells += [(f"_h{i} * _a2_top", f"{i * GOALS} + _a2_at") for i in (0, 1)]
    cells += [("_h2_top * _a0_top", f"_h2_at * {GOALS} + _a0_at")]
    df = add(df, {f"_c{n}": p for n, (p, _) in enumerate(cells)})
    df = add(df, {"_top": f"greatest({', '.join(f'_c{n}' for n in range(len(cells)))})"})
    # all cells of an equal probability, the first in the order of home, then away goals
    return add(df, {"_cell": "least(" + ", ".join(f"case when _c{n} = _top then {at} end" for n, (_, at) in enumerate(cells)) + ")"})


def _top(side: str, start: int) -> str:
    """The largest probability of a side from so many goals on."""
    return "greatest(" + ", ".join(f"_{side}{k}" for k in range(start, GOALS)) + ")"


def _at(side: str, start: int) -> str:
    """The first number of goals that has it."""
    return "case " + " ".join(f"when _{side}{k} = _{side}{start}_top then {k}" for k in range(start, GOALS - 1)) + f" else {GOALS - 1} end"


def _cell(i: int, j: int) -> Column:
    return F.col(f"_l{i}{j}") if max(i, j) < 2 else F.col(f"_h{i}") * F.col(f"_a{j}")


def outcomes() -> Triple:
    """Home, draw and away mass of a grid added by ``with_grid``."""
    return tuple(F.col(f"_m{i}") / F.col("_mass") for i in range(3))  # type: ignore[return-value]


def best() -> tuple[Column, Column]:
    """The likeliest score as 'h:a' and its probability; of equals the first in the order of home, then away goals."""
    return F.concat_ws(":", F.floor(F.col("_cell") / GOALS).cast("string"), (F.col("_cell") % GOALS).cast("string")), F.col("_top") / F.col("_mass")


def likeliest(n: int) -> Column:
    """The ``n`` likeliest scores as array<struct<neg, at, p, score>>, in order."""
    all_cells = [F.struct((-_cell(i, j) / F.col("_mass")).alias("neg"), F.lit(i * GOALS + j).alias("at"), (_cell(i, j) / F.col("_mass")).alias("p"), F.lit(f"{i}:{j}").alias("score")) for i in range(GOALS) for j in range(GOALS)]
    return F.slice(F.array_sort(F.array(*all_cells)), 1, n)


#: Goals looked at for either side, and the cap of a win's probability.
WIN_GOALS, WIN_CAP = 5, 0.90


def with_win_probability(df: DataFrame, home: Column, away: Column, name: str = "win_probability") -> DataFrame:
    """``df`` with the probability that the first side scores more, both up to five goals, at most 0.9.

    The second side's probabilities are summed up as they go, so there are five products and no grid.
    """
    df = df.withColumns({"_wh": home, "_wa": away}).withColumns({f"_w{k}": poisson(k, F.col("_wa")) for k in range(WIN_GOALS)})
    fewer = {f"_w_{k}": sum((F.col(f"_w{j}") for j in range(1, k)), F.col("_w0")) for k in range(1, WIN_GOALS + 1)}
    df = df.withColumns(fewer)
    total = sum((poisson(k, F.col("_wh")) * F.col(f"_w_{k}") for k in range(1, WIN_GOALS + 1)), F.lit(0.0))
    return df.withColumn(name, F.when(F.col("_wh").isNotNull() & F.col("_wa").isNotNull(), F.least(F.lit(WIN_CAP), total))).drop("_wh", "_wa", *(f"_w{k}" for k in range(WIN_GOALS)), *fewer)
