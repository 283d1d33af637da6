"""What the dashboard derives from models and forecasts: the agent's opinion, badges and number formats."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import models
from .features import form_share

# The agent's defaults, its deductions and the least confidence.
NO_TIP, INJECTED_CONFIDENCE, CAUTIOUS, USUAL, LEAST = "–", 50, 15, 8, 20
AGREE, VOTES = 0.25, 3


def risk_level(confidence: Column) -> Column:
    return F.when(confidence >= 65, "low").when(confidence >= 45, "medium").otherwise("high")


def agent(featured: DataFrame, risks: DataFrame, injected: DataFrame | None = None) -> DataFrame:
    """The agent's row for each match: an injected one where there is one, else the ensemble's, more careful.

    ``risks``: match_id, risk_level, risk_tags (array); ``injected``: match_id, winner, score, other_score,
    confidence (0 and null count as 50).  ``stance`` says which of the agent's five texts applies, ``tag`` what it names.
    """
    all_models = models.evaluate(featured.join(risks.select("match_id", F.col("risk_level").alias("_level"), F.col("risk_tags").alias("_tags")), "match_id", "left"), models.CLIENT)
    winners = F.array(*(F.col(f"m_{m}.winner") for m in models.CLIENT))
    named = lambda k: F.size(F.filter(winners, lambda w: w == k))
    votes = F.greatest(*(named(k) for k in ("home", "draw", "away")))
    gap = F.coalesce((F.col("home_strength") - F.col("away_strength")) / 100, F.lit(0.0))
    form = form_share(F.col("home_form")) - form_share(F.col("away_form"))
    tagged = F.coalesce(F.size("_tags") > 0, F.lit(False))
    steps = all_models.withColumns({
        "_agree": (F.abs(gap) > AGREE) | (F.abs(form) > AGREE),
        "_cautious": tagged | F.coalesce(F.col("_level") == "high", F.lit(False)),
        "_strong": votes >= VOTES,
    })
    agree, cautious, strong, e = F.col("_agree"), F.col("_cautious"), F.col("_strong"), F.col("m_ensemble")
    stance = F.when(cautious & ~agree, "warns").when(cautious & strong, "agrees_with_warning").when(~agree, "unclear").when(strong, "confirms_consensus").otherwise("confirms")
    lowered = F.greatest(F.lit(LEAST), e["confidence"] - F.when(cautious, CAUTIOUS).otherwise(USUAL))
    shown = F.least(F.lit(99), F.greatest(F.lit(1), lowered)).cast("int")
    tag = F.when(stance.isin("warns", "agrees_with_warning"), F.coalesce(F.get("_tags", F.lit(0)), F.lit("Risikofaktor")))
    own = steps.select("match_id", e["winner"].alias("winner"), e["score"].alias("score"), e["other_score"].alias("other_score"), shown.alias("confidence"), risk_level(lowered).alias("risk_level"), stance.alias("stance"), tag.alias("tag"), F.lit(False).alias("is_injected"))
    if injected is None:
        return own
    sure = F.coalesce(F.nullif(F.col("confidence"), F.lit(0)), F.lit(INJECTED_CONFIDENCE)).cast("int")
    given = injected.select("match_id", F.struct("winner", "score", F.coalesce("other_score", F.lit(NO_TIP)).alias("other_score"), sure.alias("confidence"), risk_level(sure).alias("risk_level"), F.lit(None).cast("string").alias("stance"), F.lit(None).cast("string").alias("tag"), F.lit(True).alias("is_injected")).alias("i"))
    parts = ("winner", "score", "other_score", "confidence", "risk_level", "stance", "tag", "is_injected")
    there = F.col("i").isNotNull()
    return own.join(given, "match_id", "left").select("match_id", *(F.when(there, F.col(f"i.{c}")).otherwise(F.col(c)).alias(c) for c in parts))


def badge(forecasts: DataFrame) -> DataFrame:
    """Forecasts with the badge and class of the predicted outcome's probability (per cent)."""
    p = F.when(F.col("predicted_winner") == "home", F.col("win_pct")).when(F.col("predicted_winner") == "away", F.col("away_pct")).otherwise(F.col("draw_pct"))
    kind = F.when(p >= 80, "strong").when(p >= 70, "solid").when(p >= 60, "watch").otherwise("risky")
    return forecasts.withColumns({"badge": kind, "prob_class": F.when(p >= 75, "high").when(p >= 60, "mid").otherwise("low")})


def short_name(team: Column) -> Column:
    """The last word of a name."""
    return F.element_at(F.split(team, " "), -1)


def csv_lines(results: DataFrame) -> DataFrame:
    """One unquoted line of eight values for each result; unknown versions and competitions are empty."""
    columns = ("match_id", "model_key", "model_version", "predicted_score", "actual_score", "points", "confidence_score", "competition_code")
    return results.select(F.concat_ws(",", *(F.coalesce(F.col(c).cast("string"), F.lit("")) for c in columns)).alias("line"))


# What the dashboard shows where a column is missing or null.
DEFAULTS = {"competition_code": "", "competition_name": "", "league_abbr": "", "flag": "🌍", "home_team": "Heim", "away_team": "Auswärts", "confidence_score": 0, "predicted_winner": "draw", "is_strong_tip": False, "risk_level": "low", "analysis_text": "", "ai_reason": ""}
DRAW = "Unentschieden"
_LISTS = ("form_home", "form_away", "risk_tags")
_SIDES = ("home", "draw", "away")
_MARKET = {
    "odds": {s: f"market_{s}{'_win' if s == 'home' else ''}_odds" for s in _SIDES}, "probs": {s: f"market_{s}_prob_fair" for s in _SIDES},
    "edge": {s: f"edge_{s}" for s in _SIDES}, "ev": {s: f"ev_{s}" for s in _SIDES}, "value": {s: f"value_{s}" for s in _SIDES},
}


def view_model(rows: DataFrame) -> DataFrame:
    """Prediction rows as the dashboard reads them: defaults filled in, the leading outcome, and a nested ``market``.

    Columns that ``rows`` doesn't have count as null.  ``market`` holds has_odds and has_model (all three sides known), the
    provider, number of bookmakers, margin, times, and a struct for each of odds, probs, edge, ev and value.
    """
    def col(name: str, kind: str, *others: str) -> Column:
        have = [F.col(n) for n in (name, *others) if n in rows.columns]
        return F.coalesce(*have).cast(kind) if have else F.lit(None).cast(kind)

    kinds = {"confidence_score": "int", "is_strong_tip": "boolean"}
    fill = {n: F.coalesce(col(n, kinds.get(n, "string")), F.lit(d)).alias(n) for n, d in DEFAULTS.items()}
    lists = {n: F.coalesce(col(n, "array<string>"), F.array().cast("array<string>")).alias(n) for n in _LISTS}
    share = {s: F.coalesce(col(n, "int"), F.lit(0)).alias(n) for s, n in zip(_SIDES, ("win_probability", "draw_probability", "away_probability"), strict=True)}
    winner = col("predicted_winner", "string")
    lead = lambda h, a, d: F.when(winner == "home", h).when(winner == "away", a).otherwise(d)
    whole = lambda part: F.lit(True) if not _MARKET[part] else _all(*(col(n, "double").isNotNull() for n in _MARKET[part].values()))
    side = lambda part: F.struct(*((F.coalesce(col(n, "boolean"), F.lit(False)) if part == "value" else col(n, "double")).alias(s) for s, n in _MARKET[part].items())).alias(part)
    market = F.struct(
        whole("odds").alias("has_odds"), whole("probs").alias("has_model"), col("market_odds_provider", "string").alias("provider"),
        col("market_bookmaker_count", "int", "market_odds_bookmaker_count").alias("bookmaker_count"), col("market_overround", "double").alias("overround"),
        col("market_odds_fetched_at", "timestamp").alias("fetched_at"), col("market_last_update_ts", "timestamp", "market_odds_updated_at").alias("updated_at"),
        *map(side, _MARKET),
    )
    return rows.select(
        col("match_id", "string", "id").alias("id"), col("kickoff_at", "timestamp").alias("kickoff_at"),
        *fill.values(), col("home_strength", "int").alias("home_strength"), col("away_strength", "int").alias("away_strength"), *lists.values(), *share.values(),
        lead(share["home"], share["away"], share["draw"]).alias("lead_prob"), lead(fill["home_team"], fill["away_team"], F.lit(DRAW)).alias("lead_label"), market.alias("market"),
    )


def _all(*conditions: Column) -> Column:
    out = F.lit(True)
    for c in conditions:
        out = out & c
    return out


# Number formats of the drawer; an unknown number is a dash.
DASH = "–"


def percent(share: Column) -> Column:
    """A share as whole per cent, halves rounded up."""
    return F.when(share.isNull(), DASH).otherwise(F.concat(F.floor(share.cast("double") * 100 + 0.5).cast("string"), F.lit("%")))


def signed_percent(share: Column, digits: int = 1) -> Column:
    """A share as a percentage with its sign; 0 has a plus."""
    x = share.cast("double") * 100
    return F.when(share.isNull(), DASH).otherwise(F.concat(F.when(x >= 0, "+").otherwise(""), F.format_string(f"%.{digits}f%%", x)))


def signed(number: Column, digits: int = 2) -> Column:
    """A number with its sign; 0 has a plus."""
    x = number.cast("double")
    return F.when(number.isNull(), DASH).otherwise(F.concat(F.when(x >= 0, "+").otherwise(""), F.format_string(f"%.{digits}f", x)))


# Weekdays from Sunday on, and what stands for an unknown day.
WEEKDAYS = ("Sonntag", "Montag", "Dienstag", "Mittwoch", "Donnerstag", "Freitag", "Samstag")
NO_DAY, NO_WEEKDAY = "unknown", "?"


def day_key(at: Column) -> Column:
    """The day as a text that sorts."""
    return F.coalesce(F.date_format(at, "yyyy-MM-dd"), F.lit(NO_DAY))


def weekday(at: Column) -> Column:
    return F.coalesce(F.get(F.array(*map(F.lit, WEEKDAYS)), F.dayofweek(at) - 1), F.lit(NO_WEEKDAY))


def is_today(at: Column, now: str) -> Column:
    """Whether a time lies on the day of ``now``."""
    return F.coalesce(F.to_date(at) == F.to_date(F.lit(now).cast("timestamp_ntz")), F.lit(False))
