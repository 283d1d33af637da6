"""Queries of the jobs around the models: run log, patches, aliases, calibration, landed payloads, streams, pages, lookups."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import catalog, oracle_jobs, oracles
from .functions import marginals, names
from .operators import calibration, client, features, forecast, merge, models, odds, reports, resolve, scans
from .plans.backtest import backtest
from .plans.runlog import RunLog
from .session import scratch
from .sources import landed, lookup, pages
from .sources import relations as r
from .sources.relations import relation, table
from .streaming import snapshots

Query = Callable[[SparkSession, str], DataFrame]
AT = "2024-02-01 00:00:00"


def _run_log(spark: SparkSession, sf: str) -> DataFrame:
    """A back-test and a job that fails, both under the log; their rows are counted as they are written."""
    log = RunLog(spark, scratch(spark, "runs"), version="1.0", commit="c0ffee", branch="main")
    log.release("first")
    log.release("again")
    with log.run("backtest", {"source": "matches"}) as run:
        run.counted(catalog._results(spark, sf), points=F.sum("points")).write.format("noop").mode("overwrite").save()
    try:
        with log.run("broken") as run:
            run.counted(table(spark, sf, "events").select(F.raise_error(F.lit("no such feed")))).write.format("noop").mode("overwrite").save()
    except Exception:  # noqa: BLE001  the log has it
        pass
    figure = lambda k: F.try_element_at("metadata", F.lit(k)).cast("long")
    versions = log.releases().select("system_version", "notes")
    over = F.col("finished_at") >= F.col("started_at")
    return log.runs().join(versions, "system_version").select("job_name", "system_version", "notes", "status", figure("n_rows").alias("n_rows"), figure("points").alias("points"), over.alias("is_over"), F.try_element_at("metadata", F.lit("error")).contains("no such feed").alias("says_why"))


def _matches_by_year(spark: SparkSession, sf: str) -> DataFrame:
    return relation(spark, sf, "matches_multi").select("match_id", "kickoff_at", "competition_code", "home_goals", "away_goals", F.lit("2000-01-01").cast("timestamp_ntz").alias("updated_at"), F.year("kickoff_at").alias("season"))


def _patched(spark: SparkSession, sf: str) -> DataFrame:
    """A table by season in which the matches of pending orders of three seasons get a code and a goal; two patches name one match."""
    path = scratch(spark, "by-season")
    _matches_by_year(spark, sf).write.partitionBy("season").parquet(path)
    o = table(spark, sf, "orders").filter("o_orderstatus = 'P' AND year(o_orderdate) BETWEEN 1996 AND 1998")
    first = o.select(F.col("o_orderkey").alias("match_id"), F.year("o_orderdate").alias("season"), F.lit("patched").alias("competition_code"), F.lit(9).cast("long").alias("home_goals"), F.lit(1).alias("nth"))
    again = first.filter("match_id % 2 = 0").select("match_id", "season", F.lit(None).cast("string").alias("competition_code"), F.lit(None).cast("long").alias("home_goals"), F.lit(2).alias("nth"))
    unknown = first.select(-F.col("match_id") - 1, "season", "competition_code", "home_goals", "nth")
    merge.patch_partitions(spark, path, first.union(again).union(unknown), ["match_id"], ["competition_code", "home_goals"], AT, "season", order="nth")
    return spark.read.parquet(path).select("match_id", "competition_code", "home_goals", "away_goals", "updated_at", "season")


def _decision_log(spark: SparkSession, sf: str) -> DataFrame:
    rows = resolve.reasoning(catalog._scoped_events(spark, sf), catalog._decided(spark, sf))
    said = F.from_json("reasoning", "raw_name_normalized string, top_candidate struct<canonical_name:string, matched_via:string, reason_bits:array<string>>, second_candidate struct<canonical_name:string>, score_margin double, all_candidates array<struct<team_id:long>>, decision_basis string")
    out = rows.withColumn("r", said)
    top = F.col("r.top_candidate")
    return out.select("event_id", "suggested_team_id", "decision", "confidence", F.col("r.raw_name_normalized").alias("raw_name_normalized"), top["canonical_name"].alias("top_name"), top["matched_via"].alias("matched_via"), F.array_join(top["reason_bits"], "|").alias("reason_bits"), F.col("r.second_candidate.canonical_name").alias("second_name"), F.col("r.score_margin").alias("margin"), F.coalesce(F.size("r.all_candidates"), F.lit(0)).cast("long").alias("n_candidates"), F.col("r.decision_basis").alias("decision_basis"))


def _stored_aliases(spark: SparkSession, sf: str) -> DataFrame:
    """Aliases as a seed left them: 'FC' names open to all, with an empty or a null source, and those of one competition."""
    t = relation(spark, sf, "teams")
    name = F.concat(F.lit("FC "), F.col("canonical_name"))
    base = lambda tag, source, code: t.select(F.concat(F.lit(tag), F.col("team_id").cast("string")).alias("id"), "team_id", source.alias("source_system"), code.alias("competition_code"), name.alias("alias_name"), names.normal(name).alias("alias_normalized"), F.lit("approved").alias("status"), F.lit("seed").alias("decision_source"), F.lit(1.0).alias("confidence"), F.lit("seeded").alias("explanation"), F.when(F.col("team_id") % 3 > 0, F.col("team_id") % 5).cast("long").alias("usage_count"), F.lit(None).cast("timestamp_ntz").alias("last_seen_at"), F.lit("2000-01-01").cast("timestamp_ntz").alias("updated_at"))
    none = F.lit(None).cast("string")
    return base("a", F.when(F.col("team_id") % 2 == 0, F.lit("")), none).unionByName(base("b", F.lit("odds_api"), F.lit("c0"))).unionByName(base("c", none, F.lit("")).filter("team_id % 4 = 0"))


def _alias_upsert(spark: SparkSession, sf: str) -> DataFrame:
    rows = resolve.new_aliases(catalog._scoped_events(spark, sf), catalog._decided(spark, sf))
    return resolve.upsert_aliases(_stored_aliases(spark, sf), rows, AT)


def _seasons_of_models(spark: SparkSession, sf: str) -> DataFrame:
    results = backtest(relation(spark, sf, "matches_multi"), {"dc": models.SERVER["dc"]})
    return catalog._probabilities(results).withColumn("season", F.year("kickoff_at"))


def _walk_forward(spark: SparkSession, sf: str) -> DataFrame:
    return calibration.walk_forward(_seasons_of_models(spark, sf))


def _calibrated(spark: SparkSession, sf: str) -> DataFrame:
    results = _seasons_of_models(spark, sf).select("match_id", "season", "prob_home", "prob_draw", "prob_away", "actual_1x2")
    out = calibration.apply_calibration(results, calibration.walk_forward(results))
    return out.select("match_id", "season", "cal_home", "cal_draw", "cal_away", "calibration")


def _land_odds(spark: SparkSession, sf: str) -> str:
    """The events of the odds service as its answers, one in each line: a list for each sport and part of its events.

    Every sport also has an answer that is cut off, one that is an error message, and an empty one.
    """
    price = lambda name, p: F.struct(name.alias("name"), p.cast("double").alias("price"))
    home, away, n = F.col("home_team"), F.col("away_team"), F.col("event_id")
    book = lambda key, *outcomes: F.struct(F.lit(key).alias("key"), F.upper(F.lit(key)).alias("title"), F.lit("t").alias("last_update"), F.array(F.struct(F.lit("h2h").alias("key"), F.array(*outcomes).alias("outcomes"))).alias("markets"))
    books = F.array(
        book("b1", price(home, F.lit(9.9)), price(F.lit("Draw"), F.lit(3.0)), price(away, 2 + n % 7), price(home, 1.5 + n % 10)),
        book("b2", price(home, 1.25 + n % 4), price(F.lit("Draw"), F.lit(3.5)), price(away, F.when(n % 3 == 0, 1.0).otherwise(2.75))),
    )
    event = F.to_json(F.struct(n.cast("string").alias("id"), "sport_key", F.date_format("kickoff_at", "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("commence_time"), "home_team", "away_team", books.alias("bookmakers")))
    part = F.floor(n / 500)  # a service's answers are bounded; so are these
    lists = relation(spark, sf, "api_events").select("sport_key", part.alias("part"), event.alias("event")).groupBy("sport_key", "part").agg(F.concat(F.lit("["), F.array_join(F.collect_list("event"), ","), F.lit("]")).alias("value"))
    odd = lists.groupBy("sport_key").agg(F.min_by("value", "part").alias("value"))
    broken = odd.select(F.explode(F.array(F.expr("left(value, length(value) - 20)"), F.lit('{"message": "rate limit"}'), F.lit(""))).alias("value"))
    path = scratch(spark, "landed")
    lists.select("value").unionByName(broken).write.text(f"{path}/odds")
    listed = relation(spark, sf, "api_events").select("sport_key").distinct().select(F.to_json(F.struct(F.col("sport_key").alias("key"), F.when(F.col("sport_key") == "sport_error", F.lit(False)).when(F.col("sport_key") == "sport_view", F.lit(True)).alias("active"))).alias("value"))
    listed.select(F.concat(F.lit("["), "value", F.lit("]")).alias("value")).write.text(f"{path}/sports")
    return path


def _landed_odds(spark: SparkSession, sf: str) -> DataFrame:
    path = _land_odds(spark, sf)
    events, _ = landed.odds_events(spark, f"{path}/odds", whole_files=False)
    known, _ = landed.sports(spark, f"{path}/sports", whole_files=False)
    active = events.join(known.select(F.col("key").alias("sport_key")), "sport_key", "left_semi")
    out = odds.flatten(active.select("id", "sport_key", "home_team", "away_team", "bookmakers"))
    return out.select(F.col("id").cast("long").alias("event_id"), "sport_key", "bookmaker_key", "home_odds", "draw_odds", "away_odds")


def _landed_rejects(spark: SparkSession, sf: str) -> DataFrame:
    events, rejects = landed.odds_events(spark, f"{_land_odds(spark, sf)}/odds", whole_files=False)
    return rejects.groupBy("reason").agg(F.count("*").alias("n")).unionByName(events.select(F.lit("read").alias("reason"), F.lit(1).alias("n")).groupBy("reason").agg(F.sum("n").alias("n")))


def _recent_payloads(spark: SparkSession, sf: str) -> DataFrame:
    """Each team's last fifteen matches as one answer, some without a score; the last five with one are read back."""
    m = relation(spark, sf, "matches")
    sides = m.withColumn("team_id", F.explode(F.array("home_team_id", "away_team_id")))
    last = odds.newest_first(sides, ["team_id"], "kickoff_at", landed.LEAST_ASKED)
    goals = F.when(F.col("match_id") % 9 > 0, F.struct(F.struct(F.col("home_goals").alias("home"), F.col("away_goals").alias("away")).alias("fullTime")))
    one = F.struct(F.col("match_id").alias("id"), F.date_format("kickoff_at", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'").alias("utcDate"), F.lit("FINISHED").alias("status"), F.struct(F.col("home_team_id").alias("id")).alias("homeTeam"), F.struct(F.col("away_team_id").alias("id")).alias("awayTeam"), goals.alias("score"))
    path = scratch(spark, "teams")
    last.groupBy("team_id").agg(F.collect_list(one).alias("matches")).select(F.to_json(F.struct("team_id", "matches")).alias("value")).write.text(path)
    found, _ = landed.recent_team_matches(spark, path, whole_files=False)
    return found.select("team_id", "match_id", F.col("rank").cast("int").alias("rank"), "home_goals", "away_goals")


def _snapshot_stream(spark: SparkSession, sf: str) -> DataFrame:
    """All snapshots as a stream of several batches; a match's bookmakers come in different ones."""
    path = scratch(spark, "stream")
    s = relation(spark, sf, "odds_snapshots").withColumn("snapshot_ts", F.col("snapshot_ts").cast("timestamp")).withColumns({"match_id": F.col("match_id").cast("long"), "seq": F.col("seq").cast("int")})
    s.select("match_id", "bookmaker_id", "snapshot_ts", "seq", "home_odds", "draw_odds", "away_odds").repartition(4, "bookmaker_id").write.parquet(f"{path}/in")
    q = snapshots.refresh_consensus(snapshots.read(spark, f"{path}/in", files_per_batch=1), f"{path}/log", f"{path}/consensus", f"{path}/checkpoint", buckets=4)
    q.awaitTermination()
    out = snapshots.consensus_table(spark, f"{path}/consensus")
    return out.select("match_id", *(F.round(f"median_{x}_odds", 6).alias(f"median_{x}_odds") for x in ("home", "draw", "away")), "bookmaker_count")


def _alias_stream(spark: SparkSession, sf: str) -> DataFrame:
    """Every name that the service uses, time and again, as a stream of alias events: each key is kept once."""
    e = relation(spark, sf, "api_events")
    sides = F.inline(F.array(*(F.struct(F.col(f"{x}_team").alias("raw_name"), F.lit(x).alias("home_or_away")) for x in ("home", "away"))))
    rows = e.select("event_id", F.expr("substring(sport_key, 7)").alias("competition_code"), sides)
    rows = rows.select(F.lit("odds_api").alias("source_system"), "competition_code", "raw_name", names.normal(F.col("raw_name")).alias("raw_name_normalized"), "home_or_away", F.to_json(F.struct("event_id")).alias("context"), F.lit("new").alias("status"))
    path = scratch(spark, "events")
    rows.repartition(3, "context").write.parquet(f"{path}/in")
    snapshots.collect_events(snapshots.read(spark, f"{path}/in", 1, snapshots.ALIAS_EVENTS), f"{path}/table", f"{path}/checkpoint", buckets=4).awaitTermination()
    return snapshots.alias_events(spark, f"{path}/table").select(*snapshots.EVENT_KEY, "status")


NEWEST = pages.Order(("kickoff_at", "match_id"), (True, False))


def _paged(spark: SparkSession, sf: str, rows: DataFrame | None = None) -> pages.Pages:
    path = scratch(spark, "pages")
    rows = relation(spark, sf, "matches") if rows is None else rows
    pages.write(rows.select("match_id", "kickoff_at", "competition_code", "home_goals", "away_goals"), path, NEWEST, file_rows=400)
    return pages.Pages(spark, path, NEWEST)


def _third_page(spark: SparkSession, sf: str) -> DataFrame:
    """The third page of fifty of all matches, newest first."""
    p = _paged(spark, sf)
    key = None
    for _ in range(2):
        key = p.key(p.page(50, key))
    return p.page(50, key)


def _filtered_page(spark: SparkSession, sf: str) -> DataFrame:
    """The second page of fifty of one competition's matches."""
    p = _paged(spark, sf)
    mine = F.col("competition_code") == "view"
    return p.page(50, p.key(p.page(50, where=mine)), mine)


def _view_rows(spark: SparkSession, sf: str) -> DataFrame:
    """Forecasts with their matches under the names of the prediction view; some columns of it aren't there."""
    featured = catalog._featured(spark, sf)
    f = forecast.forecast(featured)
    renamed = {"win_pct": "win_probability", "draw_pct": "draw_probability", "away_pct": "away_probability", "overround": "market_overround"} | {f"fair_{s}": f"market_{s}_prob_fair" for s in ("home", "draw", "away")}
    m = featured.select("match_id", "kickoff_at", F.nullif(F.col("competition_code"), F.lit("error")).alias("competition_code"), F.col("bookmaker_count").alias("market_bookmaker_count"), F.col("home_odds").alias("market_home_win_odds"), F.col("draw_odds").alias("market_draw_odds"), F.col("away_odds").alias("market_away_odds"))
    named = relation(spark, sf, "named_matches").select("match_id", "home_team", F.when(F.col("match_id") % 6 > 0, F.col("away_team")).alias("away_team"))
    return f.withColumnsRenamed(renamed).join(m, "match_id").join(named, "match_id")


def _view_model(spark: SparkSession, sf: str) -> DataFrame:
    v = client.view_model(_view_rows(spark, sf))
    flat = {"has_odds": "market.has_odds", "has_model": "market.has_model", "bookmaker_count": "market.bookmaker_count", "overround": "market.overround", "odds_away": "market.odds.away", "fair_home": "market.probs.home", "edge_draw": "market.edge.draw", "ev_home": "market.ev.home", "value_home": "market.value.home"}
    percent = client.percent(F.col("lead_prob") / 100)
    return v.select(F.col("id").cast("long").alias("id"), "competition_code", "flag", "home_team", "away_team", "lead_prob", "lead_label", percent.alias("lead_text"), "risk_level", F.array_join("risk_tags", ",").alias("risk_tags"), F.size("form_home").cast("long").alias("n_form_home"), "ai_reason", *(F.col(c).alias(n) for n, c in flat.items()))


def _supported(spark: SparkSession, sf: str) -> DataFrame:
    out = reports.supported_consensus(catalog._results(spark, sf), models.VOTES)
    return out.withColumn("models_supporting", F.array_join("models_supporting", ","))


_BAD = "case when match_id % 13 = 0 then 0D when match_id % 13 = 1 then -1D else home_odds end"


def _isolated(spark: SparkSession, sf: str) -> DataFrame:
    """Some matches have prices of 0 or less, and one model can't be planned at all."""
    featured = catalog._featured(spark, sf).withColumn("home_odds", F.expr(_BAD))

    def unplannable(df: DataFrame) -> DataFrame:
        return df.withColumn("m_experimental", F.col("no_such_column"))

    rows = models.long_form_isolated(featured, models.registry(ensemble_enabled=True) | {"experimental": unplannable})
    failed = F.when(F.col("failed").startswith("AnalysisException"), "can't be planned").otherwise(F.col("failed"))
    return rows.select("match_id", "model_key", "winner", "score", "confidence", failed.alias("failed"))


def _bucketed(spark: SparkSession, sf: str) -> DataFrame:
    """Two tables bucketed by match and joined bucket by bucket."""
    path = scratch(spark, "buckets")
    m, o = relation(spark, sf, "matches_multi"), relation(spark, sf, "odds_snapshots")
    n = lookup.buckets_for(max(m.count(), o.count()))  # as many on both sides
    left = lookup.write(m.select(F.col("match_id").cast("long").alias("match_id"), "competition_code", "home_goals"), "match_id", f"{path}/m", n)
    right = lookup.write(o.select(F.col("match_id").cast("long").alias("match_id"), "bookmaker_id", "home_odds"), "match_id", f"{path}/o", n)
    joined = lookup.table(spark, left).join(lookup.table(spark, right), "match_id")
    return joined.groupBy("match_id", "competition_code").agg(F.countDistinct("bookmaker_id").alias("n_bookmakers"), F.round(F.max("home_odds"), 6).alias("best_home_odds"))


def _league_lookup(spark: SparkSession, sf: str) -> DataFrame:
    name = lookup.write(relation(spark, sf, "matches").select("match_id", "competition_code", "home_goals", "away_goals"), "competition_code", f"{scratch(spark, 'buckets')}/m")
    return lookup.for_league(spark, name, "click")


def _win_probability(spark: SparkSession, sf: str) -> DataFrame:
    f = catalog._featured(spark, sf)
    out = marginals.with_win_probability(f, F.greatest(F.lit(0.3), F.col("home_strength") / 40), F.greatest(F.lit(0.3), F.col("away_strength") / 40))
    known = F.col("home_strength").isNotNull() & F.col("away_strength").isNotNull()
    return out.select("match_id", F.when(known, F.round("win_probability", 9)).alias("win_probability"))


def _models_and_agent(spark: SparkSession, sf: str) -> DataFrame:
    """Each match's models and the agent in one table, split again: how many models name each winner, and the agent's."""
    featured = catalog._featured(spark, sf)
    main = models.long_form(featured, models.CLIENT).select("match_id", "model_key", "winner", F.lit(False).alias("is_ai_agent"))
    agent = client.agent(featured, forecast.forecast(featured)).select("match_id", F.lit("agent").alias("model_key"), "winner", F.lit(True).alias("is_ai_agent"))
    rows = main.unionByName(agent)
    counts = models.main_models(rows).groupBy("match_id").agg(F.count("*").alias("n_models"), *(F.count(F.when(F.col("winner") == w, 1)).alias(f"n_{w}") for w in ("home", "draw", "away")))
    return counts.join(models.agent_result(rows).select("match_id", F.col("winner").alias("agent_winner")), "match_id")


def _mappings(spark: SparkSession, sf: str) -> DataFrame:
    """Every source's mappings of all codes, from events; of one code the last."""
    e = relation(spark, sf, "competition_events").select("source_system", F.expr("substring(external_code, 1, 9)").alias("external_code"), F.upper("external_name").alias("competition_code"), (F.col("event_id") % 2 == 0).alias("is_active"), F.col("event_id").alias("updated_at"))
    return lookup.external_mappings(e, "odds_api")


def _unresolved_list(spark: SparkSession, sf: str) -> DataFrame:
    shown = relation(spark, sf, "matches").withColumns({"competition_name": F.initcap("competition_code"), "country": F.when(F.col("match_id") % 2 == 0, "Here").otherwise("There")})
    return scans.unresolved_list(shown, catalog._mapping(spark, sf).filter("competition_code <> 'click'"))


def _undated(spark: SparkSession, sf: str) -> DataFrame:
    """Some matches have no kickoff: all of their teams' matches are their history."""
    m = relation(spark, sf, "matches").withColumn("kickoff_at", F.when(F.col("match_id") % 11 > 0, F.col("kickoff_at")))
    return features.with_features(m, undated=True).select("match_id", "home_strength", "away_strength", "home_venue", "away_venue", "home_form", "away_form", F.col("home_n_prior").cast("long").alias("home_n_prior"))


def _text_factors(spark: SparkSession, sf: str) -> DataFrame:
    """Forecasts with texts on injuries, load and motivation."""
    f = catalog._featured(spark, sf).withColumns({n: F.expr(q) for n, q in oracles.TEXTS.items()})
    return forecast.forecast(f).select("match_id", "win_pct", "draw_pct", "away_pct", "confidence_score", "risk_level", F.array_join("risk_tags", ",").alias("risk_tags"))


def _land_matches(spark: SparkSession, sf: str) -> DataFrame:
    """Matches as the fixtures service answers, one in each line: some are to come, some lack a name, a date or a score."""
    m = relation(spark, sf, "named_matches").join(relation(spark, sf, "matches").select("match_id", "home_team_id", "away_team_id", "home_goals", "away_goals"), "match_id")
    k = F.col("match_id")
    side = lambda s: F.struct(F.col(f"{s}_team_id").alias("id"), F.when(k % 6 == 0, "").when(k % 35 > 0, F.col(f"{s}_team")).alias("name"), F.when(k % 35 > 0, F.concat(F.lit("s "), f"{s}_team")).alias("shortName"))
    goals = F.when(k % 9 > 0, F.struct(F.struct(F.col("home_goals").alias("home"), F.col("away_goals").alias("away")).alias("fullTime")))
    date = F.when(k % 50 == 0, "soon").otherwise(F.date_format("kickoff_at", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'"))
    row = F.struct(k.alias("id"), date.alias("utcDate"), F.when(k % 4 == 0, "TIMED").otherwise("FINISHED").alias("status"), F.struct(F.col("competition_code").alias("code")).alias("competition"), side("home").alias("homeTeam"), side("away").alias("awayTeam"), goals.alias("score"))
    path = scratch(spark, "fixtures")
    m.select(F.to_json(row).alias("value")).write.text(path)
    return landed.matches(spark, path)


def _landed_results(spark: SparkSession, sf: str) -> DataFrame:
    """Finished matches with what is stored of every third."""
    m = relation(spark, sf, "matches").filter("match_id % 3 = 0")
    stored = m.select(F.concat(F.lit("football_data_"), F.col("match_id").cast("string")).alias("external_id"), F.when(F.col("match_id") % 2 == 0, "Own name").otherwise("").alias("home_team"), F.lit(None).cast("string").alias("away_team"), F.lit("f").alias("flag"), F.lit("L").alias("league_abbr"), F.lit(None).cast("string").alias("competition_code"), F.col("home_odds").alias("market_home_win_odds"), F.col("draw_odds").alias("market_draw_odds"), F.col("away_odds").alias("market_away_odds"))
    out = landed.results(_land_matches(spark, sf), stored, "2024")
    return out.withColumn("has_kickoff", F.col("kickoff_at").isNotNull()).drop("kickoff_at", "draw_odds", "away_odds")


def _seeded(spark: SparkSession, sf: str) -> DataFrame:
    """Generated aliases that the table doesn't have for their team and scope."""
    new = catalog._aliases(spark, sf).select("team_id", F.col("alias").alias("alias_normalized"), F.lit(None).cast("string").alias("source_system"), F.lit("").alias("competition_code"))
    return merge.insert_absent(_stored_aliases(spark, sf), new, resolve.ALIAS_KEY, resolve.ALIAS_SCOPE)


def _changed_lists(spark: SparkSession, sf: str) -> DataFrame:
    """Orders whose list of flags was stored before a third of their lines came; a missing list is an empty one."""
    o, lines = table(spark, sf, "orders").select(F.col("o_orderkey").alias("k"), F.col("o_orderstatus").alias("status")), table(spark, sf, "lineitem")
    flags = lambda some: lines.filter(some).groupBy(F.col("l_orderkey").alias("k")).agg(F.array_sort(F.collect_set("l_returnflag")).alias("flags"))
    old = o.join(flags("l_shipdate < timestamp '1998-01-01 00:00:00'"), "k", "left")
    new = o.join(flags("true"), "k", "left").withColumn("flags", F.coalesce("flags", F.array().cast("array<string>")))
    return merge.changed(old, new, ["k"], ["status", "flags"], lists=["flags"]).withColumn("flags", F.array_join("flags", ","))


def _violations(spark: SparkSession, sf: str) -> DataFrame:
    """Results of which some were spoilt on the way."""
    k = F.col("match_id") % 10
    spoilt = {"points": F.when(k == 0, 3).otherwise(F.col("points")), "outcome_label": F.when(k == 1, "lucky").when(k != 2, F.col("outcome_label")), "predicted_1x2": F.when(k == 3, "X").otherwise(F.col("predicted_1x2")), "actual_1x2": F.when(k == 4, "").otherwise(F.col("actual_1x2"))}
    return merge.violations(catalog._results(spark, sf).withColumns(spoilt))


def queries() -> dict[str, Query]:
    return {
        "landed_coming": lambda s, d: landed.coming(_land_matches(s, d)).select("external_id", "competition_code", "home_team", "away_team", "home_team_id", "away_team_id"),
        "landed_results": _landed_results,
        "seeded_aliases": _seeded,
        "changed_lists": _changed_lists,
        "result_violations": _violations,
        "team_decision_counts": lambda s, d: resolve.decision_counts(catalog._decided(s, d)),
        "model_rankings_named": lambda s, d: reports.named_rankings(catalog._results(s, d)).select("model_key", "model_name", "matches_evaluated", "total_points", "avg_points"),
        "day_labels": lambda s, d: relation(s, d, "matches").withColumn("kickoff_at", F.when(F.col("match_id") % 20 > 0, F.col("kickoff_at"))).select("match_id", client.day_key(F.col("kickoff_at")).alias("day"), client.weekday(F.col("kickoff_at")).alias("weekday"), client.is_today(F.col("kickoff_at"), catalog.AS_OF).alias("is_today")),
        "matches_between": lambda s, d: relation(s, d, "matches").filter(scans.between("kickoff_at", "2024-01-05 00:00:00", "2024-01-07 00:00:00")).select("match_id", "kickoff_at"),
        "undated_features": _undated,
        "forecast_text_factors": _text_factors,
        "run_log": _run_log,
        "patched_matches": _patched,
        "decision_log": _decision_log,
        "alias_upsert": _alias_upsert,
        "walk_forward_calibration": _walk_forward,
        "calibrated_results": _calibrated,
        "landed_odds": _landed_odds,
        "landed_rejects": _landed_rejects,
        "sports_asked": lambda s, d: landed.by_sport(relation(s, d, "named_matches")),
        "recent_team_payloads": _recent_payloads,
        "snapshot_stream": _snapshot_stream,
        "alias_event_stream": _alias_stream,
        "history_page": _third_page,
        "history_page_filtered": _filtered_page,
        "history_view": lambda s, d: reports.history_view(catalog._results(s, d)).drop("created_at"),
        "history_one_day": lambda s, d: pages.one_day(relation(s, d, "matches").withColumn("match_date", F.to_date("kickoff_at")), "2024-01-10").select("match_id", "kickoff_at"),
        "history_newest_days": lambda s, d: pages.newest_days(relation(s, d, "matches_multi").groupBy(F.to_date("kickoff_at").alias("match_date")).agg(F.count("*").alias("match_count"))),
        "live_window": lambda s, d: pages.live_window(relation(s, d, "matches"), catalog.AS_OF).select("match_id", "kickoff_at"),
        "results_newest": lambda s, d: pages.newest_results(catalog._dixon_coles(s, d), "dc", "click").select("match_id", "model_key", "competition_code", "points"),
        "view_model": _view_model,
        "supported_consensus": _supported,
        "isolated_models": _isolated,
        "models_and_agent": _models_and_agent,
        "bucketed_join": _bucketed,
        "league_lookup": _league_lookup,
        "external_mappings": _mappings,
        "unresolved_list": _unresolved_list,
        "win_probability": _win_probability,
        "odds_window_closed": lambda s, d: scans.upcoming(relation(s, d, "matches").withColumn("kickoff_at", F.date_trunc("day", "kickoff_at").cast("timestamp_ntz")), "2024-01-15 00:00:00", 3, back_hours=24, closed=True).select("match_id", "kickoff_at"),
    }


def oracle_sql() -> dict[str, str]:
    w = oracles._with
    res, feats, resolver, matches = w(*oracles.results()), w(*oracles.features()), w(*oracles.resolver()), w(("m", r.MATCHES))
    multi = w(*oracles.results(f"select *, cast(null as double) as home_odds, cast(null as double) as draw_odds, cast(null as double) as away_odds, 0 as bookmaker_count from ({r.MATCHES_MULTI})"))
    grid = [
        ("dcr", "select match_id, cast(year(kickoff_at) as int) as season, actual_1x2, round(prob_home,4) as ph, round(prob_draw,4) as pd, round(prob_away,4) as pa from results where model_key='dc'"),
        ("cls", "select season, 'H' as class, ph as p, actual_1x2='H' as hit from dcr union all select season, 'D', pd, actual_1x2='D' from dcr union all select season, 'A', pa, actual_1x2='A' from dcr"),
        ("gq", "select season, class, round(0.5e0+2*i/50,3) as t, p, hit from cls, range(51) r(i)"),
        ("gl", "select season, class, t, count(*) as n, sum(case when hit then -ln(least(greatest(q,1e-7),1-1e-7)) else -ln(1-least(greatest(q,1e-7),1-1e-7)) end) as s from (select *, case when t=1e0 then p else exp(ln(least(greatest(p,1e-7),1-1e-7))/t) end as q from gq) group by 1, 2, 3"),
        ("gr", "select season, class, t, coalesce(sum(n) over v, 0) as n, sum(s) over v as s from gl window v as (partition by class, t order by season rows between unbounded preceding and 1 preceding)"),
        ("gb", "select season, class, n, case when n < 200 then 1e0 else t end as t from gr qualify row_number() over (partition by season, class order by round(s/nullif(n,0),9), t) = 1"),
        ("cal", """select season, t_home, t_draw, t_away, cast(case when n < 200 then 0 else n end as bigint) as n_samples, case when n < 200 then 'identity' else 'auto' end as version, n < 200 or (t_home=1 and t_draw=1 and t_away=1) as is_identity
            from (select season, max(t) filter (class='H') as t_home, max(t) filter (class='D') as t_draw, max(t) filter (class='A') as t_away, max(n) as n from gb group by 1)"""),
    ]
    chain = ",\n" + ",\n".join(f"{n} as ({q})" for n, q in grid) + "\n"
    heat = lambda p, t: f"case when {t}=1e0 then {p} else exp(ln(least(greatest({p},1e-7),1-1e-7))/{t}) end"
    measure = {
        "jaccard": "len(list_intersect(rw, fw)) / len(list_distinct(list_concat(rw, fw)))",
        "substring": "case when contains(raw, form) or contains(form, raw) then least(length(raw), length(form)) / greatest(length(raw), length(form)) else 0 end",
        "prefix": "coalesce(list_min(list_filter(range(1, least(len(rs), len(fs)) + 1), lambda i: rs[i] <> fs[i])) - 1, least(len(rs), len(fs))) / greatest(len(rs), len(fs))",
    }
    bits = ", ".join(f"case when {q} > 0 then kind || '_{n}=' || printf('%.3f', cast({q} as double)) end" for n, q in measure.items())
    why = f""", hows as (select event_id, team_id, alias, raw, form, case when alias is null then 'canon' else 'alias' end as kind from all_scored where score >= 0.45e0 qualify row_number() over (partition by event_id, team_id order by score desc, (alias is null)::int, alias, raw, form) = 1),
      lists as (select *, {oracle_jobs._WORDS.format('raw')} as rw, {oracle_jobs._WORDS.format('form')} as fw, string_split(raw,' ') as rs, string_split(form,' ') as fs from hows),
      why as (select event_id, team_id, case when alias is null then 'canonical' else 'alias' end as matched_via,
        array_to_string(list_concat(case when raw = form then [case when alias is null then 'exact_canonical' else 'exact_alias' end] else list_filter([{bits}], lambda x: x is not null) end, [case when alias is null then 'via_canonical' else 'via_alias=' || alias end]), '|') as reason_bits from lists)"""
    normal = oracles._NORMAL
    api = [("api", r.API_EVENTS)]
    forecasts = w(*oracles.features(), *oracles.forecasts())
    agent = w(*oracles.features(), *oracles.models(), *((f"c_{k}", q) for k, q in oracles.clients().items()), *oracles.forecasts())
    plain = f"select * replace (case when match_id % 13 <= 1 then null else home_odds end as home_odds) from ({r.MATCHES})"
    snaps = oracles.sql()["odds_consensus"]
    newest = "select match_id, kickoff_at, competition_code, home_goals, away_goals from m"
    undated = [(n, q.replace("b.k < a.k", "(a.k is null or b.k < a.k)").replace("order by b.k desc", "order by b.k desc nulls last")) for n, q in oracles.features(f"select * replace (case when match_id % 11 > 0 then kickoff_at end as kickoff_at) from ({r.MATCHES})")]
    landed_rows = w(("n", r.NAMED_MATCHES), ("m", r.MATCHES))
    shown = lambda side: f"case when n.match_id % 35 = 0 then null when n.match_id % 6 = 0 then 's ' || {side}_team else {side}_team end"
    return {
        "landed_coming": landed_rows + f"select cast(n.match_id as varchar) as external_id, n.competition_code, {shown('home')} as home_team, {shown('away')} as away_team, home_team_id, away_team_id from n join m using (match_id) where n.match_id % 4 = 0 and n.match_id % 50 <> 0 and n.match_id % 35 <> 0",
        "landed_results": landed_rows + f"""select 'football_data_' || n.match_id as external_id, home_team_id, away_team_id, cast(home_goals as int) as home_goals, cast(away_goals as int) as away_goals, case when n.match_id % 6 = 0 then 'Own name' else coalesce({shown('home')}, '?') end as home_team, coalesce({shown('away')}, '?') as away_team,
            case when n.match_id % 3 = 0 then 'f' else '' end as flag, case when n.match_id % 3 = 0 then 'L' else n.competition_code end as league_abbr, n.competition_code, case when n.match_id % 3 = 0 then home_odds end as home_odds, '2024' as season, n.match_id % 50 <> 0 as has_kickoff from n join m using (match_id) where n.match_id % 9 > 0""",
        "seeded_aliases": resolver + f"select team_id, alias as alias_normalized, cast(null as varchar) as source_system, '' as competition_code from alias_list a where not exists (select 1 from teams t where t.team_id = a.team_id and {normal.format("'FC ' || t.canonical_name")} = a.alias)",
        "changed_lists": w(("a", "select l_orderkey as k, list_sort(list(distinct l_returnflag)) as f from lineitem where l_shipdate < timestamp '1998-01-01 00:00:00' group by 1"), ("b", "select l_orderkey as k, list_sort(list(distinct l_returnflag)) as f from lineitem group by 1")) + "select o_orderkey as k, o_orderstatus as status, array_to_string(coalesce(b.f, []), ',') as flags from orders left join a on a.k = o_orderkey left join b on b.k = o_orderkey where coalesce(a.f, []) <> coalesce(b.f, [])",
        "result_violations": res + "select count(*) filter (match_id % 10 = 0) as bad_points, count(*) filter (match_id % 10 = 1) as bad_label, count(*) filter (match_id % 10 = 3) as bad_predicted, count(*) filter (match_id % 10 = 4) as bad_actual from results",
        "team_decision_counts": resolver + "select v.decision, count(d.event_id) as n from (values ('approve'), ('approve_provisional'), ('no_match'), ('reject')) v(decision) left join decided d on d.decision = v.decision group by 1",
        "model_rankings_named": res + "select model_key, case model_key when 'dc' then 'Dixon–Coles' when 'market' then 'Markt' else upper(model_key[1]) || model_key[2:] end as model_name, count(*) as matches_evaluated, cast(sum(points) as bigint) as total_points, round(sum(points)/count(*), 2) as avg_points from results group by 1, 2",
        "day_labels": matches + "select match_id, case when match_id % 20 > 0 then strftime(kickoff_at, '%Y-%m-%d') else 'unknown' end as day, case when match_id % 20 > 0 then (['Sonntag','Montag','Dienstag','Mittwoch','Donnerstag','Freitag','Samstag'])[dayofweek(kickoff_at) + 1] else '?' end as weekday, match_id % 20 > 0 and cast(kickoff_at as date) = date '2024-01-15' as is_today from m",
        "matches_between": matches + "select match_id, kickoff_at from m where kickoff_at >= timestamp '2024-01-05 00:00:00' and kickoff_at < timestamp '2024-01-07 00:00:00'",
        "undated_features": w(*undated) + "select match_id, home_strength, away_strength, home_venue, away_venue, home_form, away_form, home_n_prior from feats",
        "forecast_text_factors": w(*oracles.features(), *oracles.texts()) + "select match_id, win_pct, draw_pct, away_pct, confidence_score, risk_level, risk_tags from forecast",
        "run_log": res + "select 'backtest' as job_name, '1.0' as system_version, 'first' as notes, 'success' as status, count(*) as n_rows, cast(sum(points) as bigint) as points, true as is_over, cast(null as boolean) as says_why from results union all select 'broken', '1.0', 'first', 'failed', null, null, true, true",
        "patched_matches": w(("m", r.MATCHES_MULTI), ("o", "select o_orderkey from orders where o_orderstatus = 'P' and year(o_orderdate) between 1996 and 1998")) + f"""select match_id, case when o_orderkey is null then competition_code when match_id % 2 = 0 then null else 'patched' end as competition_code,
            case when o_orderkey is null then home_goals when match_id % 2 = 0 then null else 9 end as home_goals, away_goals, case when o_orderkey is null then timestamp '2000-01-01 00:00:00' else timestamp '{AT}' end as updated_at, cast(year(kickoff_at) as int) as season from m left join o on o_orderkey = match_id""",
        "decision_log": resolver + why + f""" select e.event_id, d.team_id as suggested_team_id, decision, d.score as confidence, {normal.format('raw_name')} as raw_name_normalized, d.canonical_name as top_name, matched_via, reason_bits, s.canonical_name as second_name,
            case when n_candidates > 0 then d.margin end as margin, n_candidates, case when n_candidates = 0 then 'no_candidates' end as decision_basis from events_raw e join decided d using (event_id) left join why on why.event_id = e.event_id and why.team_id = d.team_id left join best_two s on s.event_id = e.event_id and s.rank = 2""",
        "alias_upsert": resolver + why + f""", rows as (select e.event_id, d.team_id, case when decision = 'approve_provisional' then 'odds_api' end as source_system, case when decision = 'approve_provisional' then 'c' || (e.event_id % 2) end as competition_code, raw_name as alias_name, {normal.format('raw_name')} as alias_normalized,
              case decision when 'approve' then 'approved' else 'provisional' end as status, d.score as confidence, 'auto_resolve matched ''' || raw_name || ''' → ''' || canonical_name || ''' mit score=' || printf('%.4f', d.score) || ' via=' || matched_via as explanation
              from events_raw e join decided d using (event_id) join why on why.event_id = e.event_id and why.team_id = d.team_id where decision <> 'no_match'),
            fresh as (select *, count(*) over k as n from rows window k as (partition by team_id, coalesce(source_system, ''), coalesce(competition_code, ''), alias_normalized) qualify row_number() over (partition by team_id, coalesce(source_system, ''), coalesce(competition_code, ''), alias_normalized order by event_id desc) = 1),
            seed as (select tag || team_id as id, team_id, src as source_system, code as competition_code, 'FC ' || canonical_name as alias_name, {normal.format("'FC ' || canonical_name")} as alias_normalized, case when team_id % 3 > 0 then team_id % 5 end as usage_count
              from (select 'a' as tag, team_id, canonical_name, case when team_id % 2 = 0 then '' end as src, cast(null as varchar) as code from teams union all select 'b', team_id, canonical_name, 'odds_api', 'c0' from teams union all select 'c', team_id, canonical_name, null, '' from teams where team_id % 4 = 0)),
            marked as (select *, id = min(id) over (partition by team_id, coalesce(source_system, ''), coalesce(competition_code, ''), alias_normalized) as takes from seed)
            select s.id, coalesce(s.team_id, f.team_id) as team_id, case when s.team_id is null then f.source_system else s.source_system end as source_system, case when s.team_id is null then f.competition_code else s.competition_code end as competition_code,
              case when f.n is null then s.alias_name else f.alias_name end as alias_name, coalesce(s.alias_normalized, f.alias_normalized) as alias_normalized, case when f.n is null then 'approved' else f.status end as status, case when f.n is null then 'seed' else 'ai_agent' end as decision_source,
              case when f.n is null then 1e0 else f.confidence end as confidence, case when f.n is null then 'seeded' else f.explanation end as explanation, case when f.n is null then s.usage_count else coalesce(s.usage_count, 0) + f.n end as usage_count,
              case when f.n is not null then timestamp '{AT}' end as last_seen_at, case when f.n is null then timestamp '2000-01-01 00:00:00' else timestamp '{AT}' end as updated_at
            from marked s full outer join fresh f on s.takes and s.team_id = f.team_id and coalesce(s.source_system, '') = coalesce(f.source_system, '') and coalesce(s.competition_code, '') = coalesce(f.competition_code, '') and s.alias_normalized = f.alias_normalized""",
        "walk_forward_calibration": multi.rstrip() + chain + "select * from cal",
        "calibrated_results": multi.rstrip() + chain + f""", q as (select match_id, d.season, version, is_identity, ph, pd, pa, {heat('ph', 't_home')} as q1, {heat('pd', 't_draw')} as q2, {heat('pa', 't_away')} as q3 from dcr d join cal using (season)),
            s as (select *, round_even(q1/(q1+q2+q3),4) as r1, round_even(q2/(q1+q2+q3),4) as r2, round_even(q3/(q1+q2+q3),4) as r3 from q), z as (select *, round_even(1-(r1+r2+r3),4) as rest from s)
            select match_id, season, case when is_identity then ph else round_even(r1 + case when r1>=r2 and r1>=r3 then rest else 0 end,4) end as cal_home, case when is_identity then pd else round_even(r2 + case when not (r1>=r2 and r1>=r3) and r2>=r3 then rest else 0 end,4) end as cal_draw,
              case when is_identity then pa else round_even(r3 + case when not (r1>=r2 and r1>=r3) and r2<r3 then rest else 0 end,4) end as cal_away, version as calibration from z""",
        "landed_odds": w(*api) + """select event_id, sport_key, 'b1' as bookmaker_key, cast(1.5e0 + event_id % 10 as double) as home_odds, 3e0 as draw_odds, cast(2 + event_id % 7 as double) as away_odds from api where sport_key <> 'sport_error'
            union all select event_id, sport_key, 'b2', cast(1.25e0 + event_id % 4 as double), 3.5e0, 2.75e0 from api where event_id % 3 <> 0 and sport_key <> 'sport_error'""",
        "landed_rejects": w(*api) + "select reason, (select count(distinct sport_key) from api) as n from (values ('no JSON'), ('another shape'), ('empty')) v(reason) union all select 'read', count(*) from api",
        "sports_asked": w(("n", r.NAMED_MATCHES)) + "select sport_key, count(*) as n_matches, count(distinct competition_code) as n_competitions from n group by 1",
        "recent_team_payloads": matches + ", s as (select *, unnest([home_team_id, away_team_id]) as team_id from m), l as (select * from s qualify row_number() over (partition by team_id order by kickoff_at desc) <= 15) select team_id, match_id, cast(row_number() over (partition by team_id order by kickoff_at desc, match_id desc) as int) as rank, cast(home_goals as int) as home_goals, cast(away_goals as int) as away_goals from l where match_id % 9 > 0 qualify rank <= 5",
        "snapshot_stream": snaps,
        "alias_event_stream": w(*api) + f"select distinct 'odds_api' as source_system, substring(sport_key, 7) as competition_code, {normal.format('n')} as raw_name_normalized, side as home_or_away, 'new' as status from (select sport_key, home_team as n, 'home' as side from api union all select sport_key, away_team, 'away' from api)",
        "history_page": matches + newest + " order by kickoff_at desc, match_id limit 50 offset 100",
        "history_page_filtered": matches + newest + " where competition_code = 'view' order by kickoff_at desc, match_id limit 50 offset 50",
        "history_view": res + """select match_id, cast(null as varchar) as home_team, cast(null as varchar) as away_team, cast(null as varchar) as flag, cast(null as varchar) as league_abbr, competition_code, cast(null as varchar) as season, kickoff_at, predicted_score, predicted_winner, confidence_score, actual_score,
            case when home_goals > away_goals then 'home' when home_goals < away_goals then 'away' else 'draw' end as actual_winner, home_goals as actual_home_goals, away_goals as actual_away_goals, points, outcome_label, model_version from results where model_key = 'ensemble'""",
        "history_one_day": matches + "select match_id, kickoff_at from m where cast(kickoff_at as date) = date '2024-01-10' order by kickoff_at, match_id limit 50",
        "history_newest_days": w(("m", r.MATCHES_MULTI)) + "select cast(kickoff_at as date) as match_date, count(*) as match_count from m group by 1 order by 1 desc limit 365",
        "live_window": matches + "select match_id, kickoff_at from m where kickoff_at >= timestamp '2024-01-15 00:00:00' and kickoff_at < timestamp '2024-01-17 00:00:00' order by kickoff_at, match_id limit 500",
        "results_newest": res + "select match_id, model_key, competition_code, points from results where model_key = 'dc' and competition_code = 'click' order by kickoff_at desc, match_id limit 2000",
        "view_model": forecasts + f""", nm as ({r.NAMED_MATCHES}) select f.match_id as id, case when m.competition_code = 'error' then '' else m.competition_code end as competition_code, '🌍' as flag, home_team, case when f.match_id % 6 > 0 then away_team else 'Auswärts' end as away_team,
            case predicted_winner when 'home' then win_pct when 'away' then away_pct else draw_pct end as lead_prob, case predicted_winner when 'home' then home_team when 'away' then case when f.match_id % 6 > 0 then away_team else 'Auswärts' end else 'Unentschieden' end as lead_label,
            case predicted_winner when 'home' then win_pct when 'away' then away_pct else draw_pct end || '%' as lead_text, risk_level, risk_tags, 0 as n_form_home, '' as ai_reason,
            home_odds is not null and draw_odds is not null and away_odds is not null as has_odds, fair_home is not null as has_model, cast(bookmaker_count as int) as bookmaker_count, overround, away_odds as odds_away, fair_home, edge_draw, ev_home, value_home
            from forecast f join matches m using (match_id) join nm using (match_id)""",
        "supported_consensus": res + """, o as (select *, case model_key when 'ensemble' then 0 when 'poisson' then 1 when 'elo' then 2 when 'dc' then 3 else 4 end as nth, case model_key when 'ensemble' then 3 when 'market' then 1 else 2 end as w from results),
            t as (select match_id, predicted_score, sum(w) as w, min(nth) as nth, string_agg(model_key, ',' order by nth) as ms, sum(sum(w)) over (partition by match_id) as total from o group by 1, 2)
            select match_id, predicted_score as consensus_score, cast(w as bigint) as weight_sum, cast(total as bigint) as total_weight, ms as models_supporting, case when round(w/total,6)>=0.55e0 then 'strong' when round(w/total,6)>=0.35e0 then 'moderate' else 'weak' end as confidence from t qualify row_number() over (partition by match_id order by w desc, nth) = 1""",
        "isolated_models": w(*oracles.features(plain), *oracles.models()) + ", rows as (" + " union all ".join(f"select match_id, '{k}' as model_key, winner, score, confidence from m_{k}" for k in ("poisson", "dc", "elo", "market", "ensemble")) + """)
            select match_id, model_key, case when bad then null else winner end as winner, case when bad then null else score end as score, case when bad then null else confidence end as confidence, case when bad then 'bad input: home_odds' end as failed from (select *, model_key in ('market', 'ensemble') and match_id % 13 <= 1 as bad from rows)
            union all select match_id, 'experimental', null, null, null, 'can''t be planned' from matches""",
        "models_and_agent": agent + ", rows as (" + " union all ".join(f"select match_id, winner from c_{k}" for k in oracles.clients()) + ") select rows.match_id, count(*) as n_models, count(*) filter (rows.winner='home') as n_home, count(*) filter (rows.winner='draw') as n_draw, count(*) filter (rows.winner='away') as n_away, any_value(e.winner) as agent_winner from rows join c_ensemble e using (match_id) group by 1",
        "bucketed_join": w(("m", r.MATCHES_MULTI), ("o", r.ODDS_SNAPSHOTS)) + "select match_id, competition_code, count(distinct bookmaker_id) as n_bookmakers, round(max(home_odds), 6) as best_home_odds from m join o using (match_id) group by 1, 2",
        "league_lookup": matches + "select match_id, competition_code, home_goals, away_goals from m where competition_code = 'click'",
        "external_mappings": w(("e", r.COMPETITION_EVENTS)) + "select substring(external_code, 1, 9) as external_code, upper(external_name) as competition_code, event_id % 2 = 0 as is_active from e qualify row_number() over (partition by substring(external_code, 1, 9) order by event_id desc) = 1",
        "unresolved_list": matches + "select distinct competition_code, upper(competition_code[1]) || competition_code[2:] as competition_name, case when match_id % 2 = 0 then 'Here' else 'There' end as country from m where competition_code in ('error', 'click')",
        "win_probability": feats + """, t as (select match_id, greatest(0.3e0, home_strength/40) as lh, greatest(0.3e0, away_strength/40) as la from feats where home_strength is not null and away_strength is not null),
            p as (select match_id, least(0.9e0, sum(exp(-lh)*pow(lh,h)/factorial(cast(h as int))*exp(-la)*pow(la,a)/factorial(cast(a as int)))) as p from t, range(6) x(h), range(6) y(a) where a < h group by 1)
            select match_id, round(p, 9) as win_probability from feats left join p using (match_id)""",
        "odds_window_closed": matches + "select match_id, date_trunc('day', kickoff_at) as kickoff_at from m where date_trunc('day', kickoff_at) between timestamp '2024-01-14 00:00:00' and timestamp '2024-01-18 00:00:00'",
    }
