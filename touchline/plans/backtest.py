"""The back-test: features, models, points and metrics in one lazy plan."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import scores
from ..operators import models
from ..operators.features import with_features


def backtest(matches: DataFrame, registry: dict[str, models.Model] = models.SERVER, version: str = "1.0") -> DataFrame:
    """One row for each finished match and model, with points, label and metrics."""
    finished = with_features(matches).filter(F.col("home_goals").isNotNull() & F.col("away_goals").isNotNull())
    rows = models.long_form(finished, registry)
    # columns of their own: written into the measures, a text would be parsed some sixty times for each row
    tipped = {f"_{n}_{s}": c for n, separator in (("tip", ":"), ("any", "[:-]")) for s, c in zip(("home", "away"), scores.parse_score(F.col("score"), separator), strict=True)}
    rows = rows.withColumns(tipped)
    tip, any_of = ((F.col(f"_{n}_home"), F.col(f"_{n}_away")) for n in ("tip", "any"))
    home, away = F.col("home_goals"), F.col("away_goals")
    p = (F.col("prob_home"), F.col("prob_draw"), F.col("prob_away"))
    return rows.select(
        "match_id", "model_key", F.lit(version).alias("model_version"), "competition_code", F.col("kickoff_at").cast("timestamp").alias("kickoff_at"),
        F.col("score").alias("predicted_score"), F.col("winner").alias("predicted_winner"), F.col("confidence").alias("confidence_score"),
        *p, "home_goals", "away_goals",
        F.concat_ws(":", home.cast("string"), away.cast("string")).alias("actual_score"),
        scores.points_of(tip, home, away).alias("points"),
        scores.label_of(tip, home, away).alias("outcome_label"),
        *(c.alias(n) for n, c in scores.metrics_of(any_of, home, away, p).items()),
    )
