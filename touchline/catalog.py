"""All registered queries of the match-analytics part, by name."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import oracle_jobs, oracles
from .functions import names
from .operators import calibration, client, competitions, detect, features, forecast, merge, models, odds, reports, resolve, scans
from .plans.backtest import backtest
from .sources.relations import relation, table

FLAGSHIP = "backtest"
Query = Callable[[SparkSession, str], DataFrame]


def _results(spark: SparkSession, sf: str) -> DataFrame:
    return backtest(relation(spark, sf, "matches"))


def _on_results(f: Callable[[DataFrame], DataFrame]) -> Query:
    return lambda spark, sf: f(_results(spark, sf))


def _on(name: str, f: Callable[[DataFrame], DataFrame]) -> Query:
    return lambda spark, sf: f(relation(spark, sf, name))


def _featured(spark: SparkSession, sf: str, name: str = "matches") -> DataFrame:
    return features.with_features(relation(spark, sf, name))


def _model(name: str) -> Query:
    def run(spark: SparkSession, sf: str) -> DataFrame:
        m = models.evaluate(_featured(spark, sf), {name: models.SERVER[name]}).select("match_id", f"m_{name}.*")
        return m.select("match_id", "winner", "score", "confidence", *(F.round(c, 6).alias(c) for c in ("prob_home", "prob_draw", "prob_away")))

    return run


def _client(name: str) -> Query:
    def run(spark: SparkSession, sf: str) -> DataFrame:
        return models.evaluate(_featured(spark, sf), {name: models.CLIENT[name]}).select("match_id", f"m_{name}.*")

    return run


def _dixon_coles(spark: SparkSession, sf: str) -> DataFrame:
    """Back-test rows of the one model that calibration looks at."""
    return _probabilities(backtest(relation(spark, sf, "matches"), {"dc": models.SERVER["dc"]}))


def _backtest(spark: SparkSession, sf: str) -> DataFrame:
    kept = ["match_id", "model_key", "log_loss_1x2", "predicted_score", "predicted_winner", "confidence_score", "points", "outcome_label", "predicted_1x2", "actual_1x2", "is_exact_hit", "is_tendency_hit", "score_error_abs", "goal_diff_error"]
    # whole hundredths: decimal ties of the sixth digit round differently in other engines
    return _results(spark, sf).select(*kept, F.floor((F.col("brier_score_1x2") + 3.7e-7) * 100).cast("long").alias("brier_percent"))


def _probabilities(results: DataFrame) -> DataFrame:
    """Dixon-Coles rows with probabilities of four digits."""
    return results.filter("model_key = 'dc'").withColumns({c: F.round(c, 4) for c in ("prob_home", "prob_draw", "prob_away")})


def _consensus(spark: SparkSession, sf: str) -> DataFrame:
    c = odds.consensus(relation(spark, sf, "odds_snapshots"))
    return c.select("match_id", *(F.round(f"median_{s}_odds", 6).alias(f"median_{s}_odds") for s in ("home", "draw", "away")), "bookmaker_count")


def _changed(spark: SparkSession, sf: str) -> DataFrame:
    o = table(spark, sf, "orders")
    old = o.select(F.col("o_orderkey").alias("match_id"), F.col("o_orderstatus").alias("status"), F.col("o_orderpriority").alias("code"))
    new = old.withColumns({"status": F.expr("CASE WHEN code LIKE '1%' THEN 'X' ELSE status END"), "code": F.expr("CASE WHEN status = 'P' THEN NULL ELSE code END")})
    return merge.changed(old, new, ["match_id"], ["status", "code"])


def _upsert(spark: SparkSession, sf: str) -> DataFrame:
    """Every order is in the old table, the new one or, where its status is open to change, in both."""
    o = table(spark, sf, "orders").select(F.col("o_orderkey").alias("k"), F.col("o_orderstatus").alias("status"), F.col("o_totalprice").alias("price"))
    return merge.upsert(o.filter("status <> 'F'"), o.filter("status <> 'O'").select("k", F.lit("N").alias("status"), (F.col("price") + 1).alias("price")), ["k"], preserve=["price"])


def _absent(spark: SparkSession, sf: str) -> DataFrame:
    """Customers without a pending order among all orders."""
    old = table(spark, sf, "orders").select(F.col("o_custkey").alias("k"), F.col("o_orderstatus").alias("status"))
    return merge.insert_absent(old, table(spark, sf, "customer").select(F.col("c_custkey").alias("k"), F.lit("P").alias("status"), F.col("c_name").alias("name")), ["k", "status"])


def _semi(spark: SparkSession, sf: str) -> DataFrame:
    dirty = table(spark, sf, "lineitem").filter("l_returnflag = 'R'").select(F.col("l_orderkey").alias("o_orderkey"))
    return table(spark, sf, "orders").select("o_orderkey", "o_custkey").join(dirty, "o_orderkey", "left_semi")


def _anti(spark: SparkSession, sf: str) -> DataFrame:
    known = table(spark, sf, "nation").filter("n_regionkey <> 1").select(F.col("n_nationkey").alias("c_nationkey"))
    return table(spark, sf, "customer").select("c_custkey", "c_nationkey").join(known, "c_nationkey", "left_anti").select("c_custkey", "c_nationkey")


def _event_match(spark: SparkSession, sf: str) -> DataFrame:
    m = relation(spark, sf, "matches").withColumn("kickoff_at", F.col("kickoff_at").cast("timestamp"))
    sides = {f"{s}_names": F.array(F.col(f"{s}_team_id").cast("string")) for s in ("home", "away")}
    m = m.withColumns(sides | {"league": F.col("competition_code")})
    at = F.expr("CASE WHEN match_id % 13 = 0 THEN NULL ELSE kickoff_at + make_interval(0, 0, 0, 0, 0, int(match_id % 300), 0) END")
    e = m.select((F.col("match_id") + 1000000).alias("event_id"), "league", at.alias("kickoff_at"), "home_names", "away_names")
    return odds.match_events(m.select("match_id", "league", "kickoff_at", "home_names", "away_names"), e)


def _forecast(spark: SparkSession, sf: str) -> DataFrame:
    return forecast.forecast(_featured(spark, sf)).withColumn("risk_tags", F.array_join("risk_tags", ","))


def _candidates(spark: SparkSession, sf: str) -> DataFrame:
    return resolve.candidates(relation(spark, sf, "raw_names"), relation(spark, sf, "teams"))


def _aliases(spark: SparkSession, sf: str) -> DataFrame:
    return relation(spark, sf, "teams").select("team_id", F.explode(names.aliases(F.col("canonical_name"))).alias("alias"))


def _alias_candidates(spark: SparkSession, sf: str) -> DataFrame:
    """Events scored against generated aliases too."""
    return resolve.candidates(_scoped_events(spark, sf), relation(spark, sf, "teams"), aliases=_known_aliases(spark, sf))


def _scoped_events(spark: SparkSession, sf: str) -> DataFrame:
    """Raw names with the source and competition that they were seen in."""
    return relation(spark, sf, "raw_names").withColumns({"source_system": F.lit("odds_api"), "competition_code": F.concat(F.lit("c"), (F.col("event_id") % 2).cast("string"))})


def _known_aliases(spark: SparkSession, sf: str) -> DataFrame:
    """Generated aliases; every third team's hold for one competition only."""
    code = F.when(F.col("team_id") % 3 == 0, F.concat(F.lit("c"), (F.col("team_id") % 2).cast("string")))
    return _aliases(spark, sf).select("team_id", "alias", F.lit(None).cast("string").alias("source_system"), code.alias("competition_code"))


def _decided(spark: SparkSession, sf: str) -> DataFrame:
    """A decision for every event, by aliases and canonical names."""
    events = _scoped_events(spark, sf)
    return resolve.decided(events, relation(spark, sf, "teams"), aliases=_known_aliases(spark, sf))


def _decisions(spark: SparkSession, sf: str) -> DataFrame:
    return _decided(spark, sf).select("event_id", "team_id", "score", "margin", "decision")


def _effects(spark: SparkSession, sf: str) -> DataFrame:
    return resolve.effects(_decisions(spark, sf), relation(spark, sf, "raw_names"))


AS_OF = "2024-01-15 12:00:00"


def _competition_candidates(spark: SparkSession, sf: str) -> DataFrame:
    return competitions.candidates(relation(spark, sf, "competition_events"), relation(spark, sf, "competitions"))


def _competition_decisions(spark: SparkSession, sf: str) -> DataFrame:
    return competitions.decide(relation(spark, sf, "competition_events"), _competition_candidates(spark, sf))


def _competition_map(spark: SparkSession, sf: str) -> DataFrame:
    """Every mapping of the old table, half of which is of codes that events resolve anew."""
    events = relation(spark, sf, "competition_events")
    old = table(spark, sf, "customer").select(F.lit("odds_api").alias("source_system"), F.concat(F.lit("x"), F.col("c_custkey").cast("string")).alias("external_code"), F.lit("OLD").alias("competition_code"), F.col("c_name").alias("external_name"), F.lit(False).alias("is_active"))
    return competitions.mappings(old, events, _competition_decisions(spark, sf))


def _competition_notes(spark: SparkSession, sf: str) -> DataFrame:
    events = relation(spark, sf, "competition_events").withColumns({"status": F.lit("new"), "context": F.when(F.col("event_id") % 2 == 0, F.create_map(F.lit("seen"), F.lit("1")))})
    noted = competitions.with_note(events, _competition_decisions(spark, sf), AS_OF)
    said = F.get_json_object(F.try_element_at("context", F.lit("auto_resolve_decision")), "$.decision")
    return noted.select("event_id", "status", F.size("context").alias("n_keys"), said.alias("decision"))


def _detected(spark: SparkSession, sf: str) -> DataFrame:
    return detect.stored(detect.best_events(relation(spark, sf, "named_matches"), relation(spark, sf, "api_events"), relation(spark, sf, "team_aliases")))


def _detected_events(spark: SparkSession, sf: str) -> DataFrame:
    out = detect.alias_events(_detected(spark, sf), relation(spark, sf, "team_aliases"))
    return out.select("competition_code", "raw_name", "raw_normalized", "side", "status", F.get_json_object("context", "$.match_id").cast("long").alias("match_id"))


def _extracted(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    """Snapshots and unmatched matches; one bookmaker corrects a price, the other's last price isn't always valid."""
    known = relation(spark, sf, "team_aliases")
    price = lambda name, p: F.struct(name.alias("name"), p.cast("double").alias("price"))
    home, away, draw, n = F.col("home_team"), F.col("away_team"), F.lit("Draw"), F.col("event_id")
    book = lambda key, *outcomes: F.struct(F.lit(key).alias("key"), F.upper(F.lit(key)).alias("title"), F.lit("t").alias("last_update"), F.array(F.struct(F.lit("h2h").alias("key"), F.array(*outcomes).alias("outcomes"))).alias("markets"))
    books = F.array(
        book("b1", price(home, F.lit(9.9)), price(draw, F.lit(3.0)), price(away, 2 + n % 7), price(home, 1.5 + n % 10)),
        book("b2", price(home, 1.25 + n % 4), price(draw, F.lit(3.5)), price(away, F.lit(2.5)), price(away, F.when(n % 3 == 0, 1.0).otherwise(2.75))),
    )
    sides = lambda p: {f"{s}_names": F.col(f"{p}{s}_set") for s in detect.SIDES}
    m = detect.known_forms(relation(spark, sf, "named_matches"), known, "f_", names.STOPWORDS_MATCH).withColumns(sides("f_") | {"league": F.col("sport_key")})
    e = relation(spark, sf, "api_events").withColumn("competition_code", F.expr("substring(sport_key, 7)"))
    e = detect.known_forms(e, known, "f_", names.STOPWORDS_MATCH).withColumns(sides("f_") | {"league": F.col("sport_key"), "bookmakers": books})
    cast = lambda df: df.withColumn("kickoff_at", F.col("kickoff_at").cast("timestamp"))
    return odds.extract(cast(m), cast(e), AS_OF)


def _unmatched_events(spark: SparkSession, sf: str) -> DataFrame:
    out = detect.unmatched_alias_events(_extracted(spark, sf)[1], relation(spark, sf, "api_events"), relation(spark, sf, "team_aliases"))
    return out.select("competition_code", "raw_name", "raw_normalized", "side", "status", F.get_json_object("context", "$.db_home_team").alias("db_home_team"))


def _forecasts(spark: SparkSession, sf: str) -> DataFrame:
    return forecast.forecast(_featured(spark, sf))


def _agent(spark: SparkSession, sf: str) -> DataFrame:
    """Every eleventh match has an opinion from outside."""
    given = relation(spark, sf, "matches").filter("match_id % 11 = 0").select("match_id", F.lit("home").alias("winner"), F.lit("2:1").alias("score"), F.lit(None).cast("string").alias("other_score"), (F.col("match_id") % 100).alias("confidence"))
    return client.agent(_featured(spark, sf), _forecasts(spark, sf), given)


def _mapping(spark: SparkSession, sf: str) -> DataFrame:
    """Codes of odds feeds for the competitions of matches but one; of two of a code the later."""
    codes = relation(spark, sf, "matches").select("competition_code").distinct().filter("competition_code <> 'error'")
    rows = codes.select("competition_code", F.inline(F.array(*(F.struct(F.lit(t).alias("tag"), F.lit(on).alias("is_active"), F.lit(at).alias("updated_at")) for t, on, at in (("old", True, 1), ("new", True, 2), ("off", False, 3))))))
    return scans.active_map(rows.select("competition_code", F.lit("odds_api").alias("source_system"), F.concat_ws("_", "tag", "competition_code").alias("external_code"), "is_active", "updated_at"), "odds_api")


def _window(spark: SparkSession, sf: str) -> DataFrame:
    m = scans.upcoming(relation(spark, sf, "matches"), AS_OF, 7, back_hours=2)
    return scans.mapped(m, _mapping(spark, sf)).select("match_id", "competition_code", "external_code", "kickoff_at")


def _dirty_window(spark: SparkSession, sf: str) -> DataFrame:
    dirty = table(spark, sf, "events").filter("event_type = 'view'").select(F.col("event_id").alias("match_id"))
    return scans.upcoming(relation(spark, sf, "matches"), AS_OF, 3, dirty=dirty).select("match_id", "kickoff_at")


def _pending(spark: SparkSession, sf: str) -> DataFrame:
    e = table(spark, sf, "orders").select(F.col("o_orderkey").alias("event_id"), F.when(F.col("o_orderstatus") == "O", "new").otherwise("resolved").alias("status"), F.col("o_orderdate").alias("created_at"))
    return scans.pending(e, 200)


def _enriched(spark: SparkSession, sf: str) -> DataFrame:
    extra = table(spark, sf, "orders").filter("o_orderstatus <> 'F'").select(F.col("o_orderkey").alias("match_id"), F.col("o_orderpriority").alias("level"), F.when(F.col("o_orderstatus") == "O", 70).alias("home_strength"))
    return scans.enriched(relation(spark, sf, "matches_multi"), extra, "match_id", {"level": "none", "home_strength": 50}).select("match_id", "level", "home_strength")


def _strengths(spark: SparkSession, sf: str) -> DataFrame:
    m = relation(spark, sf, "matches").withColumn("away_team_id", F.when(F.col("match_id") % 17 != 0, F.col("away_team_id")))
    table_rows = resolve.standings_strength(relation(spark, sf, "standings")).filter("strength >= 50")
    return scans.with_strengths(m, table_rows, scans.recent_form(m)).select("match_id", "home_strength", "away_strength", "form_home", "form_away")


def _seasons(spark: SparkSession, sf: str) -> DataFrame:
    """Form over the year before and the year itself, shown for the latter."""
    m = relation(spark, sf, "matches_multi")
    of = lambda year: m.filter(F.year("kickoff_at") == F.lit(year))
    both = scans.seasons(of(1997), of(1996))
    return features.with_features(both).filter("is_current").select("match_id", "home_form", "away_form", "home_crosses_year")


def _season_names(spark: SparkSession, sf: str) -> DataFrame:
    y = F.year("o_orderdate").cast("string")
    written = F.when(F.col("o_orderkey") % 4 == 0, F.concat(y, F.lit("/"), F.substring(y, 3, 2))).when(F.col("o_orderkey") % 4 == 1, y).when(F.col("o_orderkey") % 4 == 2, F.concat(F.lit(" "), F.substring(y, 3, 2), F.lit("/x"))).otherwise(F.concat(F.lit("S"), y))
    year = scans.season_year(written)
    return table(spark, sf, "orders").select("o_orderkey", year.alias("season_year"), scans.previous_year(year).alias("previous_year"))


def _merged_results(spark: SparkSession, sf: str) -> DataFrame:
    r = _results(spark, sf).select("match_id", "model_key", "points")
    local = r.filter("model_key = 'elo' OR match_id % 2 = 0").withColumn("points", F.col("points") + 10)
    return scans.not_yet_there(r, local, ["match_id", "model_key"])


def queries() -> dict[str, Query]:
    from . import catalog_jobs

    return catalog_jobs.queries() | {
        "backtest": _backtest,
        "model_rankings": _on_results(reports.model_rankings),
        "model_rankings_merged": _on_results(lambda r: reports.model_rankings(r, by_version=False)),
        "eval_summary": _on_results(reports.eval_summary),
        "history": _on_results(reports.history),
        "history_days": _on_results(reports.history_days),
        "kpi_strip": _on_results(lambda r: reports.kpis(r.filter("model_key = 'ensemble'"))),
        "weighted_consensus": _on_results(lambda r: reports.weighted_consensus(r, models.VOTES)),
        "majority_vote": _on_results(reports.majority_vote),
        "team_strength": lambda s, d: _featured(s, d).select("match_id", "home_strength", "away_strength", "home_venue", "away_venue", F.col("home_n_prior").cast("long").alias("home_n_prior"), F.col("away_n_prior").cast("long").alias("away_n_prior")),
        "team_form_last5": lambda s, d: _featured(s, d).select("match_id", "home_form", "away_form"),
        "cross_season_flag": lambda s, d: _featured(s, d, "matches_multi").select("match_id", "home_crosses_year", "away_crosses_year"),
        "feature_coverage": lambda s, d: features.coverage(_featured(s, d)),
        **{f"model_{m}": _model(m) for m in models.SERVER},
        **{f"client_{m}": _client(m) for m in models.CLIENT},
        "reliability_curve": lambda s, d: calibration.reliability(_dixon_coles(s, d)),
        "temperature_fit": lambda s, d: calibration.fit_temperatures(_dixon_coles(s, d)),
        "forecast": _forecast,
        "forecast_kpis": lambda s, d: reports.forecast_kpis(forecast.forecast(_featured(s, d))),
        "devig_market": _on("matches", odds.devig),
        "odds_consensus": _consensus,
        "refresh_changed_only": _changed,
        "upsert_merge": _upsert,
        "insert_if_absent": _absent,
        "dirty_semi_join": _semi,
        "unresolved_anti_join": _anti,
        "event_time_match": _event_match,
        "standings_strength": _on("standings", resolve.standings_strength),
        "name_normalise": lambda s, d: table(s, d, "part").select("p_partkey", names.normal(F.col("p_name")).alias("normal")),
        "name_candidates": _candidates,
        "alias_candidates": _alias_candidates,
        "alias_generate": _aliases,
        "resolver_decisions": _decisions,
        "resolver_effects": _effects,
        "competition_aliases": _on("competitions", competitions.aliases),
        "competition_candidates": _competition_candidates,
        "competition_decisions": lambda s, d: _competition_decisions(s, d).select("event_id", "competition_code", "confidence", "margin", "decision"),
        "competition_map": _competition_map,
        "competition_notes": _competition_notes,
        "decision_counts": lambda s, d: _competition_decisions(s, d).groupBy("decision").agg(F.count("*").alias("n")),
        "detected_candidates": lambda s, d: _detected(s, d).select("match_id", "event_id", "api_home", "api_away", "score", "dedup_key"),
        "detected_alias_events": _detected_events,
        "odds_extract": lambda s, d: _extracted(s, d)[0].select("match_id", "bookmaker_key", "bookmaker_name", "home_odds", "draw_odds", "away_odds"),
        "odds_unmatched": lambda s, d: _extracted(s, d)[1].select("match_id", "competition_code", "home_team", "away_team"),
        "odds_unmatched_alias_events": _unmatched_events,
        "agent_opinion": _agent,
        "forecast_badges": lambda s, d: client.badge(_forecasts(s, d)).select("match_id", "badge", "prob_class"),
        "strong_tips": lambda s, d: _forecasts(s, d).filter("is_strong_tip").select("match_id", "predicted_winner", "win_pct").orderBy(F.desc("win_pct"), "match_id"),
        "high_risk": lambda s, d: _forecasts(s, d).filter("risk_level = 'high'").select("match_id", "confidence_score"),
        "upcoming_mapped": _window,
        "upcoming_dirty": _dirty_window,
        "not_past": _on("matches", lambda m: scans.not_past(m, AS_OF).select("match_id", "kickoff_at")),
        "unmapped_competitions": lambda s, d: scans.unresolved(relation(s, d, "matches"), _mapping(s, d)),
        "pending_events": _pending,
        "enriched_matches": _enriched,
        "recent_form": _on("matches", scans.recent_form),
        "match_strengths": _strengths,
        "teams_by_competition": _on("matches", scans.teams_by_competition),
        "season_features": _seasons,
        "season_names": _season_names,
        "model_summary": _on_results(reports.model_summary),
        "results_csv": _on_results(client.csv_lines),
        "results_merged": _merged_results,
        "short_names": lambda s, d: table(s, d, "part").select("p_partkey", client.short_name(F.col("p_name")).alias("short_name")),
        "league_chips": _on("matches", reports.league_chips),
        "matches_by_day": _on("matches", reports.by_day),
        "search_filter": lambda s, d: reports.search(table(s, d, "part"), "AN", ["p_name", "p_type"]).select("p_partkey", "p_name"),
        "season_mode": _on("matches_multi", reports.season),
        "last_wins": lambda s, d: merge.last_wins(table(s, d, "orders").select("o_custkey", "o_orderkey", "o_totalprice"), ["o_custkey"], "o_orderkey"),
        "day_navigation": lambda s, d: reports.day_navigation(table(s, d, "events").select(F.to_date("ts").alias("match_date")).distinct()),
        "json_flatten": lambda s, d: table(s, d, "events").select("event_id", F.from_json("props", "k long")["k"].alias("k")),
    }


def oracle_sql() -> dict[str, str]:
    from . import catalog_jobs

    return oracles.sql() | oracle_jobs.sql() | catalog_jobs.oracle_sql()
