"""Scores, points and forecast metrics on columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .probs import Triple

Pair = tuple[Column, Column]


def parse_score(text: Column, separator: str = "[:-]") -> tuple[Column, Column]:
    """Goals of 'h:a' (or 'h-a'); null where the text isn't two whole numbers."""
    trimmed = F.trim(text)
    ok = trimmed.rlike(rf"^\s*[0-9]+\s*{separator}\s*[0-9]+\s*$")
    parts = F.split(trimmed, separator)
    return tuple(F.when(ok, F.trim(F.get(parts, F.lit(i))).try_cast("int")) for i in (0, 1))  # type: ignore[return-value]


def outcome(home: Column, away: Column) -> Column:
    """H, D or A; null if a side is missing."""
    return F.when(home > away, "H").when(home < away, "A").when(home == away, "D")


def points(score: Column, home: Column, away: Column) -> Column:
    """4 for the exact score, 2 for the tendency, else 0; only 'h:a' is accepted."""
    return points_of(parse_score(score, ":"), home, away)


def points_of(goals: Pair, home: Column, away: Column) -> Column:
    """``points`` of goals already taken from the text."""
    h, a = goals
    return F.when((h == home) & (a == away), 4).when(outcome(h, a) == outcome(home, away), 2).otherwise(0)


def label(score: Column, home: Column, away: Column) -> Column:
    return label_of(parse_score(score, ":"), home, away)


def label_of(goals: Pair, home: Column, away: Column) -> Column:
    """``label`` of goals already taken from the text."""
    h, a = goals
    return (
        F.when(h.isNull() | a.isNull() | home.isNull() | away.isNull(), F.lit(None))
        .when((h == home) & (a == away), "exact")
        .when((outcome(h, a) == outcome(home, away)) & (h - a == home - away), "goal_diff")
        .when(outcome(h, a) == outcome(home, away), "tendency")
        .otherwise("wrong")
    )


def metrics(score: Column, home: Column, away: Column, p: Triple) -> dict[str, Column]:
    """The eight measures of one forecast; null where prediction, result or probabilities are missing."""
    return metrics_of(parse_score(score), home, away, p)


def metrics_of(goals: Pair, home: Column, away: Column, p: Triple) -> dict[str, Column]:
    """``metrics`` of goals already taken from the text."""
    h, a = goals
    both = h.isNotNull() & a.isNotNull() & home.isNotNull() & away.isNotNull()
    actual = outcome(home, away)
    total = p[0] + p[1] + p[2]
    valid = (total > 0) & actual.isNotNull()
    for x in p:
        valid = valid & (x >= 0) & (x <= 1)
    shares = [x / total for x in p]
    hit = [(actual == c).cast("double") for c in "HDA"]
    brier = sum(((s - y) * (s - y) for s, y in zip(shares, hit, strict=True)), F.lit(0.0)) / 3
    chosen = sum((s * y for s, y in zip(shares, hit, strict=True)), F.lit(0.0))
    return {
        "predicted_1x2": outcome(h, a),
        "actual_1x2": actual,
        "is_exact_hit": F.when(both, (h == home) & (a == away)),
        "is_tendency_hit": F.when(both, outcome(h, a) == actual),
        "score_error_abs": F.when(both, F.abs(h - home) + F.abs(a - away)).cast("int"),
        "goal_diff_error": F.when(both, F.abs((h - a) - (home - away))).cast("int"),
        "brier_score_1x2": F.when(valid, F.bround(brier, 6)),
        "log_loss_1x2": F.when(valid, F.bround(-F.ln(F.greatest(chosen, F.lit(1e-9))), 6)),
    }
