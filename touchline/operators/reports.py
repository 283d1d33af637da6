"""Rankings, summaries, history and dashboard figures over back-test results."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def _n(c: Column) -> Column:
    return F.count(F.when(c, 1))


def _rate(part: Column, whole: Column, digits: int = 1) -> Column:
    return F.round(100.0 * part / F.when(whole != 0, whole), digits)


def model_rankings(results: DataFrame, by_version: bool = True) -> DataFrame:
    """Points, hits and rates for each model; without ``by_version`` versions of a model are merged."""
    keys = ["model_key", "model_version"] if by_version else ["model_key"]
    p = F.col("points")
    return (
        results.groupBy(*keys).agg(
            F.count("*").alias("matches_evaluated"),
            F.sum("points").alias("total_points"),
            F.round(F.sum("points") / F.count("*"), 2).alias("avg_points"),
            _n(p == 4).alias("exact_hits"), _rate(_n(p == 4), F.count("*")).alias("exact_rate"),
            _n(p == 2).alias("tendency_hits"), _rate(_n(p == 2), F.count("*")).alias("tendency_rate"),
            _n(p == 0).alias("wrong_predictions"), _rate(_n(p.isin(2, 4)), F.count("*")).alias("score_accuracy"),
        )
        .orderBy(F.desc_nulls_first("avg_points"), *keys)
    )


#: What models are called.
MODEL_NAMES = {"ensemble": "Ensemble", "poisson": "Poisson", "elo": "Elo", "dc": "Dixon–Coles", "market": "Markt"}


def named_rankings(results: DataFrame) -> DataFrame:
    """The ranking with versions merged and each model's name, its key where it has none."""
    name = F.try_element_at(F.create_map(*(F.lit(x) for kv in MODEL_NAMES.items() for x in kv)), F.col("model_key"))
    return model_rankings(results, by_version=False).withColumn("model_name", F.coalesce(name, "model_key"))


def eval_summary(results: DataFrame) -> DataFrame:
    """Fifteen measures for each model over results with an outcome; rates leave out null flags."""
    exact, tendency, actual = F.col("is_exact_hit"), F.col("is_tendency_hit"), F.col("actual_1x2")
    return (
        results.filter(actual.isNotNull()).groupBy("model_key", "model_version").agg(
            F.count("*").alias("matches_evaluated"),
            F.round(F.avg("points"), 3).alias("avg_kicktipp_points"),
            _n(F.col("points") == 4).alias("exact_score_hits"),
            _n(F.col("points") == 2).alias("tendency_hits_kicktipp"),
            _n(exact).alias("exact_hits"), _n(tendency).alias("tendency_hits"),
            _rate(_n(tendency), F.count(tendency)).alias("tendency_hit_rate_pct"),
            _rate(_n(exact), F.count(exact)).alias("exact_hit_rate_pct"),
            F.round(F.avg("score_error_abs"), 3).alias("avg_score_error"),
            F.round(F.avg("goal_diff_error"), 3).alias("avg_goal_diff_error"),
            F.round(F.avg("brier_score_1x2"), 4).alias("avg_brier_score"),
            F.round(F.avg("log_loss_1x2"), 4).alias("avg_log_loss"),
            _n(actual == "H").alias("actual_home_wins"), _n(actual == "D").alias("actual_draws"), _n(actual == "A").alias("actual_away_wins"),
        )
        .orderBy(F.desc_nulls_first("avg_kicktipp_points"), "model_key")
    )


def history(results: DataFrame, model_key: str = "ensemble") -> DataFrame:
    """One model's results, newest first, with the day of the match."""
    kept = ["match_id", "model_key", "competition_code", "kickoff_at", "predicted_score", "actual_score", "points", "outcome_label", "confidence_score"]
    return results.filter((F.col("model_key") == model_key) & F.col("outcome_label").isNotNull()).select(*kept, F.to_date("kickoff_at").alias("match_date")).orderBy(F.desc("kickoff_at"), "match_id")


#: Columns of the history view.
HISTORY = ("match_id", "home_team", "away_team", "flag", "league_abbr", "competition_code", "season", "kickoff_at", "predicted_score", "predicted_winner", "confidence_score", "actual_score", "actual_winner", "actual_home_goals", "actual_away_goals", "points", "outcome_label", "model_version", "created_at")


def history_view(results: DataFrame, model_key: str = "ensemble") -> DataFrame:
    """All columns of the history of one model's finished matches; unordered, for pages by key (see sources.pages).

    The display columns that ``results`` doesn't have are null.
    """
    goals = {"actual_home_goals": "home_goals", "actual_away_goals": "away_goals"}
    winner = F.when(F.col("home_goals") > F.col("away_goals"), "home").when(F.col("home_goals") < F.col("away_goals"), "away").when(F.col("home_goals") == F.col("away_goals"), "draw")

    def col(name: str) -> Column:
        if name in results.columns:
            return F.col(name)
        if name == "actual_winner":
            return winner.alias(name)
        return F.col(goals[name]).alias(name) if name in goals else F.lit(None).cast("string").alias(name)

    return results.filter((F.col("model_key") == model_key) & F.col("actual_score").isNotNull() & F.col("kickoff_at").isNotNull()).select(*map(col, HISTORY))


def history_days(results: DataFrame, model_key: str = "ensemble") -> DataFrame:
    """Counts of outcomes and the hit rate for each day."""
    label = F.col("outcome_label")
    return history(results, model_key).groupBy("match_date").agg(
        F.count("*").alias("match_count"), *(_n(label == k).alias(f"{k}_count") for k in ("exact", "goal_diff", "tendency", "wrong")), _rate(_n(label != "wrong"), F.count("*")).alias("hit_rate")
    )


def day_navigation(days: DataFrame) -> DataFrame:
    """The match days before and after each; one row for each day, so one window is small."""
    w = Window.orderBy("match_date")
    return days.select("match_date", F.lag("match_date").over(w).alias("previous_day"), F.lead("match_date").over(w).alias("next_day"))


def kpis(results: DataFrame) -> DataFrame:
    label = F.col("outcome_label")
    n = F.count("*")
    percent = lambda c: F.coalesce(F.floor(100.0 * _n(c) / F.when(n != 0, n) + 0.5), F.lit(0)).cast("long")
    return results.agg(n.alias("n"), *(_n(label == k).alias(k) for k in ("exact", "goal_diff", "tendency", "wrong")), percent(label != "wrong").alias("hit_rate"), percent(label == "exact").alias("exact_rate"))


def forecast_kpis(forecasts: DataFrame) -> DataFrame:
    return forecasts.agg(F.count("*").alias("total"), _n(F.col("is_strong_tip")).alias("strong"), F.coalesce(F.floor(F.avg("confidence_score") + 0.5), F.lit(0)).cast("long").alias("mean_confidence"), _n(F.col("risk_level") == "high").alias("risky"))


def league_chips(matches: DataFrame) -> DataFrame:
    return matches.groupBy("competition_code").agg(F.count("*").alias("n_matches"), F.min("kickoff_at").cast("timestamp").alias("first_kickoff"))


def by_day(matches: DataFrame) -> DataFrame:
    return matches.groupBy(F.date_format("kickoff_at", "yyyy-MM-dd").alias("day")).agg(F.count("*").alias("n_matches"), F.sum(F.col("home_goals") + F.col("away_goals")).alias("goals"))


def search(rows: DataFrame, text: str, columns: list[str], code: str | None = None, code_column: str = "competition_code") -> DataFrame:
    """Rows of a code (all where none is given) in which a column contains the text, whatever its case."""
    if code not in (None, "ALL"):
        rows = rows.filter(F.col(code_column) == code)
    if text:
        found = F.lit(False)
        for c in columns:
            found = found | F.coalesce(F.lower(c).contains(text.lower()), F.lit(False))
        rows = rows.filter(found)
    return rows


def season(matches: DataFrame) -> DataFrame:
    """The commonest year of kickoff; of equally common ones the smallest."""
    years = matches.groupBy(F.year("kickoff_at").alias("season")).agg(F.count("*").alias("n_matches"))
    return years.orderBy(F.desc("n_matches"), "season").limit(1)


def model_summary(results: DataFrame) -> DataFrame:
    """Each model's averages over the results that have a value."""
    share = lambda c: F.round(100 * F.avg(F.col(c).cast("int")), 1)
    return results.groupBy("model_key").agg(F.count("*").alias("n"), F.round(F.avg("points"), 2).alias("avg_points"), share("is_tendency_hit").alias("tendency_pct"), share("is_exact_hit").alias("exact_pct"), F.round(F.avg("score_error_abs"), 2).alias("avg_error"), F.round(F.avg("brier_score_1x2"), 4).alias("avg_brier"))


def weighted_consensus(results: DataFrame, votes: dict[str, int]) -> DataFrame:
    """Each match's score with most votes, its share and band; of equals the one of the first model."""
    weight = F.create_map(*(F.lit(x) for kv in votes.items() for x in kv))
    order = F.create_map(*(F.lit(x) for i, k in enumerate(votes) for x in (k, i)))
    w = F.coalesce(F.try_element_at(weight, F.col("model_key")), F.lit(1))
    tally = results.groupBy("match_id", "predicted_score").agg(F.sum(w).alias("w"), F.min(F.coalesce(F.try_element_at(order, F.col("model_key")), F.lit(99))).alias("first"), F.count("*").alias("n_models"))
    top = tally.groupBy("match_id").agg(F.sum("w").alias("total"), F.max(F.struct("w", (-F.col("first")).alias("neg"), "predicted_score", "n_models")).alias("t"))
    share = F.round(F.col("t.w") / F.col("total"), 6)
    return top.select("match_id", F.col("t.predicted_score").alias("score"), F.col("t.n_models").alias("n_models"), share.alias("share"), F.when(share >= 0.55, "strong").when(share >= 0.35, "moderate").otherwise("weak").alias("band"))


def supported_consensus(results: DataFrame, votes: dict[str, int]) -> DataFrame:
    """Each match's consensus with its weight, the weight of all models, and the models behind it in the order of ``votes``.

    Of scores of equal weight the one counts that the first model names; models that ``votes`` doesn't name weigh 1
    and come last, by name.
    """
    weight = F.create_map(*(F.lit(x) for kv in votes.items() for x in kv))
    place = F.create_map(*(F.lit(x) for i, k in enumerate(votes) for x in (k, i)))
    at = F.coalesce(F.try_element_at(place, F.col("model_key")), F.lit(len(votes)))
    each = F.array_sort(F.collect_list(F.struct(at.alias("at"), F.col("model_key").alias("model"))))  # the models of one match
    tally = results.groupBy("match_id", "predicted_score").agg(F.sum(F.coalesce(F.try_element_at(weight, F.col("model_key")), F.lit(1))).alias("w"), each.alias("models"))
    first = F.col("models")[0]
    top = tally.groupBy("match_id").agg(F.sum("w").alias("total_weight"), F.min(F.struct((-F.col("w")).alias("less"), first["at"].alias("at"), first["model"].alias("first"), "predicted_score", "w", "models")).alias("t"))
    share = F.round(F.col("t.w") / F.col("total_weight"), 6)
    return top.select(
        "match_id", F.col("t.predicted_score").alias("consensus_score"), F.col("t.w").alias("weight_sum"), "total_weight",
        F.transform("t.models", lambda m: m["model"]).alias("models_supporting"), F.when(share >= 0.55, "strong").when(share >= 0.35, "moderate").otherwise("weak").alias("confidence"),
    )


def majority_vote(results: DataFrame) -> DataFrame:
    """The winner most models name, if three or more do strong."""
    n = results.groupBy("match_id", "predicted_winner").agg(F.count("*").alias("n"))
    rank = F.when(F.col("predicted_winner") == "home", 3).when(F.col("predicted_winner") == "draw", 2).otherwise(1)
    top = n.groupBy("match_id").agg(F.max(F.struct("n", rank.alias("rank"), "predicted_winner")).alias("t"))
    return top.select("match_id", F.col("t.predicted_winner").alias("winner"), F.col("t.n").alias("n_models"), (F.col("t.n") >= 3).alias("is_strong"))
