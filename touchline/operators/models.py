"""Forecast models as column expressions, by name.

A model adds a struct column m_<name> of winner, score, confidence and probabilities to featured
matches.  Steps that are used more than once are columns of their own, so that no expression repeats a
whole grid.  ``SERVER`` and ``CLIENT`` are two sets of rules that differ on purpose.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import grid as g
from ..functions import marginals as mg
from ..functions.probs import Triple, clamp, normalise, split_home
from ..session import compiled
from .features import form_share

Model = Callable[[DataFrame], DataFrame]


def _inputs(featured: DataFrame) -> DataFrame:
    compiled(featured.sparkSession)
    h, a = F.col("home_strength"), F.col("away_strength")
    return featured.withColumns({"_d": F.coalesce((h - a) / 100, F.lit(0.0)), "_fh": form_share(F.col("home_form")), "_fa": form_share(F.col("away_form"))})


def _three(name: str) -> Triple:
    return tuple(F.col(f"{name}{i}") for i in range(3))  # type: ignore[return-value]


def _keep(df: DataFrame, name: str, p: Triple) -> DataFrame:
    return df.withColumns({f"{name}{i}": x for i, x in enumerate(p)})


def _out(winner: Column, score: Column, confidence: Column, p: Triple, digits: int | None = None) -> Column:
    kept = p if digits is None else tuple(F.bround(x, digits) for x in p)
    return F.struct(winner.alias("winner"), score.alias("score"), confidence.cast("int").alias("confidence"), *(x.alias(n) for x, n in zip(kept, ("prob_home", "prob_draw", "prob_away"), strict=True)))


def _tip(home: Column, away: Column) -> Column:
    goals = lambda x: F.greatest(F.bround(x), F.lit(0.0)).cast("int").cast("string")
    return F.concat_ws(":", goals(home), goals(away))


def _rate(base: float, slope: float, lift: float, diff: Column, form: Column) -> Column:
    return F.greatest(F.lit(0.3), F.lit(base) + F.lit(slope) * diff + F.lit(lift) * (form - 0.5))


def _poisson_rates() -> tuple[Column, Column]:
    d = F.col("_d")
    return _rate(1.4, 1.2, 0.6, d, F.col("_fh")), _rate(1.1, -0.8, 0.4, d, F.col("_fa"))


def _dixon_coles_rates() -> tuple[Column, Column]:
    d = F.col("_d")
    return _rate(1.3, 1.0, 0.5, d, F.col("_fh")), _rate(1.0, -0.7, 0.4, d, F.col("_fa"))


#: Rates and dependence of low scores of the grid models.
GRIDS: dict[str, tuple[Callable[[], tuple[Column, Column]], float]] = {"poisson": (_poisson_rates, 0.0), "dc": (_dixon_coles_rates, 0.13)}


def _grid_model(df: DataFrame, name: str) -> DataFrame:
    rates, rho = GRIDS[name]
    df = mg.with_grid(df, *rates(), rho)
    score, top = mg.best()
    df = _keep(df, "_p", mg.outcomes()).withColumns({"_score": score, "_share": top})
    return df.withColumn(f"m_{name}", _out(g.winner_by_threshold(_three("_p")), F.col("_score"), F.floor(F.least(F.lit(85.0), 250 * F.col("_share"))), _three("_p")))


def poisson(df: DataFrame) -> DataFrame:
    return _grid_model(df, "poisson")


def dixon_coles(df: DataFrame) -> DataFrame:
    return _grid_model(df, "dc")


def elo(df: DataFrame) -> DataFrame:
    d, p = F.col("_d"), F.col("_p")
    df = df.withColumn("_p", 1 / (1 + F.pow(F.lit(10.0), -(4 * d + 0.1))))
    confidence = F.least(F.lit(99.0), F.floor(45 + 90 * F.abs(p - 0.5)))
    return df.withColumn("m_elo", _out(F.when(p > 0.58, "home").when(p < 0.38, "away").otherwise("draw"), _tip(1 + 1.8 * d, 0.9 - 0.9 * d), confidence, split_home(p)))


def market(df: DataFrame) -> DataFrame:
    d, home, draw, away = (F.col(c) for c in ("_d", "home_odds", "draw_odds", "away_odds"))
    full = F.coalesce((draw > 1.0) & (away > 1.0), F.lit(False))
    df = df.withColumns({"_one": F.least(F.lit(0.90), 1 / home / 1.07), "_total": 1 / home + 1 / draw + 1 / away})
    one, total = F.col("_one"), F.col("_total")
    df = _keep(df, "_q", (F.when(full, 1 / home / total).otherwise(one), F.when(full, 1 / draw / total).otherwise((1 - one) * 0.49), F.when(full, 1 / away / total).otherwise((1 - one) * 0.51)))
    df = _keep(df, "_q", tuple(clamp(y, 0.04, 0.92) for y in normalise(_three("_q"))))  # type: ignore[arg-type]
    df = _keep(df, "_q", normalise(_three("_q"))).withColumn("_alone", clamp(0.47 + 0.4 * d, 0.12, 0.88))
    p, alone = _three("_q"), F.col("_alone")
    base = F.floor(F.least(F.lit(90.0), 40 + 60 * F.greatest(*p)))
    stated = F.coalesce((draw != 0) & (away != 0), F.lit(False))
    score = _tip(0.9 + 1.2 * d, 0.8 - 0.6 * d)
    quoted = _out(g.winner_by_largest(p), score, F.when(stated, base).otherwise(F.greatest(F.lit(35), base - 15)), p, 4)
    plain = _out(F.when(alone > 0.55, "home").when(alone < 0.40, "away").otherwise("draw"), score, F.lit(20), split_home(alone))
    return df.withColumn("m_market", F.when(F.coalesce(home > 1.0, F.lit(False)), quoted).otherwise(plain))


def ensemble(df: DataFrame) -> DataFrame:
    """Weighted by what odds there are; without strengths it is the Dixon-Coles result."""
    for needed, model in (("m_dc", dixon_coles), ("m_poisson", poisson), ("m_market", market)):
        if needed not in df.columns:
            df = model(df)
    above = lambda c: F.coalesce(F.col(c) > 1.0, F.lit(False))
    some = above("home_odds")
    full = some & above("draw_odds") & above("away_odds")
    part = lambda m, n: F.col(f"m_{m}.{n}")
    mixed = lambda n: (
        F.when(full, 0.6 * part("dc", n) + 0.3 * part("market", n) + 0.1 * part("poisson", n))
        .when(some, 0.7 * part("dc", n) + 0.2 * part("market", n) + 0.1 * part("poisson", n))
        .otherwise(0.8 * part("dc", n) + 0.2 * part("poisson", n))
    )
    df = _keep(df, "_e", tuple(mixed(n) for n in ("prob_home", "prob_draw", "prob_away")))  # type: ignore[arg-type]
    df = _keep(df, "_e", normalise(_three("_e")))
    p = _three("_e")
    confidence = F.least(F.lit(95), F.floor(50 + 90 * F.abs(F.greatest(*p) - F.lit(1.0) / 3)) + F.when(full, 5).when(some, 2).otherwise(0))
    known = F.col("home_strength").isNotNull() & F.col("away_strength").isNotNull()
    return df.withColumn("m_ensemble", F.when(known, _out(g.winner_by_largest(p), part("dc", "score"), confidence, p, 4)).otherwise(F.col("m_dc")))


def _client(winner: Column, score: Column, other: Column, confidence: Column, scores: Column | None = None) -> Column:
    """What the dashboard shows of a model: the risk goes by the confidence before it is rounded."""
    shown = clamp(F.floor(confidence + 0.5), 1, 99).cast("int")
    risk = F.when(confidence >= 65, "low").when(confidence >= 45, "medium").otherwise("high")
    listed = F.lit(None).cast("string") if scores is None else scores
    return F.struct(winner.alias("winner"), score.alias("score"), other.alias("other_score"), shown.alias("confidence"), risk.alias("risk_level"), listed.alias("likeliest"))


def _half_up(home: Column, away: Column) -> Column:
    goals = lambda x: F.greatest(F.floor(x + 0.5), F.lit(0)).cast("int").cast("string")
    return F.concat_ws(":", goals(home), goals(away))


def client_grid(name: str) -> Model:
    """A grid model whose winner is the largest outcome; its five likeliest scores in ten-thousandths."""
    rates, rho = GRIDS[name]

    def run(df: DataFrame) -> DataFrame:
        df = _keep(mg.with_grid(df, *rates(), rho), "_p", mg.outcomes()).withColumn("_five", mg.likeliest(5))
        five = F.col("_five")
        listed = F.array_join(F.transform(five, lambda x: F.concat_ws("=", x["score"], F.round(x["p"] * 10000).cast("int").cast("string"))), "|")
        return df.withColumn(f"m_{name}", _client(g.winner_by_largest(_three("_p")), five[0]["score"], five[1]["score"], F.least(F.lit(85.0), 250 * five[0]["p"]), listed))

    return run


def client_elo(df: DataFrame) -> DataFrame:
    d, p = F.col("_d"), F.col("_p")
    df = df.withColumn("_p", 1 / (1 + F.pow(F.lit(10.0), -(4 * d + 0.1))))
    home, away = 1 + 1.8 * d, 0.9 - 0.9 * d
    winner = F.when(p > 0.58, "home").when(p < 0.38, "away").otherwise("draw")
    return df.withColumn("m_elo", _client(winner, _half_up(home, away), _half_up(F.greatest(F.lit(1.0), home), F.greatest(F.lit(0.0), away - 1)), 45 + 90 * F.abs(p - 0.5)))


def _by_home(p: Column) -> Column:
    return F.when(p > 0.55, "home").when(p < 0.40, "away").otherwise("draw")


def client_market(df: DataFrame) -> DataFrame:
    """The dashboard's rule: one quote (2.0 where none) times 0.9."""
    df = df.withColumn("_p", clamp(1 / F.coalesce("home_odds", F.lit(2.0)) * 0.9, 0.08, 0.92))
    p, d = F.col("_p"), F.col("_d")
    home, away = 0.9 + 1.2 * d, 0.8 - 0.6 * d
    return df.withColumn("m_market", _client(_by_home(p), _half_up(home, away), _half_up(home, away + 1), 40 + 45 * p))


def client_ensemble(df: DataFrame) -> DataFrame:
    d, form = F.col("_d"), F.col("_fh") - F.col("_fa")
    raw = (F.col("win_probability") / 100) * 0.6 + (0.5 + d * 0.25 + form * 0.15)
    df = df.withColumn("_p", clamp(raw / 1.6, 0.05, 0.95))
    p = F.col("_p")
    home, away = 1.2 + d * 1.5 + form * 0.5, 0.7 - d * 0.8 + (1 - form) * 0.3
    return df.withColumn("m_ensemble", _client(_by_home(p), _half_up(home, away), _half_up(F.greatest(F.lit(0.0), home - 1), away), 50 + 80 * F.abs(p - 0.5)))


SERVER: dict[str, Model] = {"poisson": poisson, "dc": dixon_coles, "elo": elo, "market": market, "ensemble": ensemble}
CLIENT: dict[str, Model] = {"poisson": client_grid("poisson"), "dc": client_grid("dc"), "elo": client_elo, "market": client_market, "ensemble": client_ensemble}
#: Votes of each model in the client's consensus.
VOTES = {"ensemble": 3, "poisson": 2, "elo": 2, "dc": 2, "market": 1}


#: The ensemble is left out of a back-test unless asked for, and the primary model stands for it in reports.
ENSEMBLE_ENABLED, PRIMARY = False, "dc"


def registry(ensemble_enabled: bool = ENSEMBLE_ENABLED, known: dict[str, Model] = SERVER) -> dict[str, Model]:
    """The models that a back-test runs."""
    return {k: m for k, m in known.items() if ensemble_enabled or k != "ensemble"}


_ODDS, _STRENGTHS = ("home_odds", "draw_odds", "away_odds"), ("home_strength", "away_strength")
#: What each model reads that can be out of its range.
READS = {"poisson": _STRENGTHS, "dc": _STRENGTHS, "elo": _STRENGTHS, "market": (*_STRENGTHS, *_ODDS), "ensemble": (*_STRENGTHS, *_ODDS)}
RESULT = "struct<winner: string, score: string, confidence: int, prob_home: double, prob_draw: double, prob_away: double>"


def _fine(c: str) -> Column:
    """Unknown, or a finite number; odds also above 0, as models divide by them."""
    x = F.col(c).cast("double")
    ok = ~F.isnan(x) & (F.abs(x) < float("inf"))
    return F.coalesce(ok & (x > 0) if c in _ODDS else ok, F.col(c).isNull())


def evaluate_isolated(featured: DataFrame, models: dict[str, Model] = SERVER, reads: dict[str, tuple[str, ...]] = READS, result: str = RESULT) -> DataFrame:
    """Like ``evaluate``, with a column e_<name> that says why a model gives nothing; the other models run all the same.

    A model that can't be planned, as a column is missing or of another kind, is null in all rows.  A row in which a
    model's inputs are out of range is null for that model, which is then worked out as if they were unknown, so
    that a division by a zero price doesn't end the job.
    """
    df = _inputs(featured)
    for name, model in models.items():
        checked = [c for c in reads.get(name, ()) if c in featured.columns]
        bad = F.array_compact(F.array(*(F.when(~_fine(c), F.lit(c)) for c in checked))) if checked else F.array().cast("array<string>")
        marked = df.withColumn("_bad", bad)
        ok = F.size("_bad") == 0
        masked = marked.withColumns({f"_own_{c}": F.col(c) for c in checked} | {c: F.when(ok, F.col(c)) for c in checked})
        try:
            out = model(masked)
            found = out.schema[f"m_{name}"].dataType
            said = F.when(~ok, F.concat(F.lit("bad input: "), F.array_join("_bad", ", ")))
            out = out.withColumns({f"m_{name}": F.when(ok, F.col(f"m_{name}")).otherwise(F.lit(None).cast(found)), f"e_{name}": said, **{c: F.col(f"_own_{c}") for c in checked}})
        except Exception as error:  # noqa: BLE001  whatever a model raises, the others run
            reason = f"{type(error).__name__}: {str(error).splitlines()[0] if str(error) else ''}"[:200]
            out = df.withColumns({f"m_{name}": F.lit(None).cast(result), f"e_{name}": F.lit(reason)})
        df = out.drop("_bad", *(f"_own_{c}" for c in checked))
    return df.select(*featured.columns, *(f"m_{name}" for name in models), *(f"e_{name}" for name in models))


def long_form_isolated(featured: DataFrame, models: dict[str, Model] = SERVER) -> DataFrame:
    """One row for each match and model with its result, or nulls and the reason in ``failed``."""
    entries = F.array(*(F.struct(F.lit(name).alias("model_key"), F.col(f"m_{name}").alias("m"), F.col(f"e_{name}").alias("failed")) for name in models))
    kept = featured.columns
    return evaluate_isolated(featured, models).select(*kept, F.explode(entries).alias("e")).select(*kept, "e.model_key", "e.m.*", "e.failed")


def main_models(rows: DataFrame) -> DataFrame:
    """Rows of models without the agent's (``is_ai_agent``)."""
    return rows.filter(~F.coalesce("is_ai_agent", F.lit(False)))


def agent_result(rows: DataFrame) -> DataFrame:
    """The agent's rows."""
    return rows.filter("is_ai_agent")


def evaluate(featured: DataFrame, models: dict[str, Model] = SERVER) -> DataFrame:
    """Each model's struct as a column m_<name> beside the columns of ``featured``."""
    df = _inputs(featured)
    for model in models.values():
        df = model(df)
    return df.select(*featured.columns, *(f"m_{name}" for name in models))


def long_form(featured: DataFrame, models: dict[str, Model] = SERVER) -> DataFrame:
    """One row for each match and model."""
    entries = F.array(*(F.struct(F.lit(name).alias("model_key"), F.col(f"m_{name}").alias("m")) for name in models))
    kept = featured.columns
    return evaluate(featured, models).select(*kept, F.explode(entries).alias("e")).select(*kept, "e.model_key", "e.m.*")
