"""Relational operators: features, merge, odds, events, resolution, JSON and streaming."""

import json

from pyspark.sql import functions as F

from touchline.operators import features, forecast, merge, models, odds, resolve
from touchline.plans.backtest import backtest
from touchline.sources import landed
from touchline.streaming import snapshots

SCHEMA = "match_id long, kickoff_at timestamp, competition_code string, home_team_id long, away_team_id long, home_goals int, away_goals int, home_odds double, draw_odds double, away_odds double, bookmaker_count int"


def matches(spark, n=60):
    rows = [(i, f"2024-01-{1 + i // 3:02d} 1{i % 2}:00:00", "X", 1 + i % 4, 1 + (i + 1 + i // 7) % 4 if (i + 1 + i // 7) % 4 != i % 4 else 5, i % 4, i % 3, 1.5 + i % 5, 3.2, 2.0 + i % 3, i % 9) for i in range(n)]
    return spark.createDataFrame([(r[0], None, *r[2:]) for r in rows], SCHEMA).drop("kickoff_at").join(spark.createDataFrame([(r[0], r[1]) for r in rows], "match_id long, k string"), "match_id").withColumn("kickoff_at", F.to_timestamp("k")).drop("k")


def test_features_dont_leak(spark):
    m = matches(spark)
    at = m.filter("match_id = 40").first()["kickoff_at"]
    want = features.with_features(m).filter("match_id = 40").first()
    changed = m.withColumn("home_goals", F.when((F.col("kickoff_at") >= F.lit(at)), F.col("home_goals") + 5).otherwise(F.col("home_goals")))
    got = features.with_features(changed).filter("match_id = 40").first()
    for c in ("home_strength", "away_strength", "home_form", "away_form", "home_n_prior", "win_probability"):
        assert got[c] == want[c]
    assert len(want["home_form"]) == 5 and 0 <= want["home_strength"] <= 100


def test_unplayed_matches_have_features_but_are_no_history(spark):
    m = matches(spark).withColumn("home_goals", F.when(F.col("match_id") == 30, F.lit(None)).otherwise(F.col("home_goals")))
    f = {r["match_id"]: r for r in features.with_features(m).collect()}
    assert f[30]["home_n_prior"] > 0 and max(r["home_n_prior"] for r in f.values()) < 60
    assert f[0]["home_strength"] is None and f[0]["home_form"] == "" and f[0]["win_probability"] == 50


def test_backtest_and_forecast(spark):
    m = matches(spark)
    r = backtest(m)
    assert r.count() == 60 * len(models.SERVER) and merge.violations(r).first().asDict() == {"bad_points": 0, "bad_label": 0, "bad_predicted": 0, "bad_actual": 0}
    f = forecast.forecast(features.with_features(m)).collect()
    assert len(f) == 60 and all(x["win_pct"] + x["draw_pct"] + x["away_pct"] == 100 for x in f)
    assert all(x["top_value"] is None or x[f"value_{x['top_value']}"] for x in f)


def test_merge(spark):
    old = spark.createDataFrame([(1, "a", "x"), (2, "b", "x"), (None, "n", "x")], "k int, v string, made string")
    new = spark.createDataFrame([(2, "B", "y"), (3, "c", "y"), (None, "N", "y")], "k int, v string, made string")
    up = merge.upsert(old, new, ["k"], preserve=["made"])
    want = {(1, "a", "x"), (2, "B", "x"), (3, "c", "y"), (None, "N", "x")}
    assert {tuple(r) for r in up.collect()} == want
    assert {tuple(r) for r in merge.upsert(up, new, ["k"], preserve=["made"]).collect()} == want
    assert [tuple(r) for r in merge.insert_absent(old, new, ["k"]).collect()] == [(3, "c", "y")]
    assert {tuple(r) for r in merge.changed(old, new, ["k"], ["v"]).collect()} == {(2, "B")}


def test_odds(spark):
    event = {"id": "e1", "sport_key": "s", "home_team": "A", "away_team": "B", "bookmakers": [
        {"key": "b1", "title": "B1", "last_update": "t", "markets": [{"key": "h2h", "outcomes": [{"name": "A", "price": 2.0}, {"name": "Draw", "price": 3.0}, {"name": "B", "price": 4.0}, {"name": "A", "price": 2.2}]}]},
        {"key": "b2", "title": "B2", "last_update": "t", "markets": [{"key": "h2h", "outcomes": [{"name": "A", "price": 1.0}, {"name": "Draw", "price": 3.0}, {"name": "B", "price": 4.0}]}]}]}
    e = spark.createDataFrame([(json.dumps(event),)], "j string").select(F.from_json("j", odds.EVENT_SCHEMA).alias("e")).select("e.*")
    assert [(r["bookmaker_key"], r["home_odds"], r["draw_odds"], r["away_odds"]) for r in odds.flatten(e).collect()] == [("b1", 2.2, 3.0, 4.0)]


def test_events_match_once(spark):
    at = lambda t: F.to_timestamp(F.lit(t))
    m = spark.range(1).select(F.lit(1).alias("match_id"), F.lit("L").alias("league"), at("2024-01-01 12:00:00").alias("kickoff_at"), F.array(F.lit("a"), F.lit("aa")).alias("home_names"), F.array(F.lit("b")).alias("away_names"))
    rows = [(3, "2024-01-01 14:59:00"), (2, "2024-01-01 15:01:00"), (5, None)]
    e = spark.createDataFrame(rows, "event_id int, t string").select("event_id", F.lit("L").alias("league"), F.to_timestamp("t").alias("kickoff_at"), F.array(F.lit("aa")).alias("home_names"), F.array(F.lit("b"), F.lit("c")).alias("away_names"))
    assert [tuple(r) for r in odds.match_events(m, e).collect()] == [(1, 3)]


def test_resolve(spark):
    events = spark.createDataFrame([(1, "FC Alpha Town"), (2, "Alpha"), (3, "Zzz")], "event_id int, raw_name string")
    teams = spark.createDataFrame([(10, "Alpha Town"), (11, "Beta City"), (12, "Alpha United")], "team_id int, canonical_name string")
    found = resolve.candidates(events, teams)
    d = {r["event_id"]: r["decision"] for r in resolve.decide(found).collect()}
    assert d == {1: "approve"}  # half the words are too little
    every = {r["event_id"]: (r["decision"], r["score"]) for r in resolve.decide(found, events).collect()}
    assert every == {1: ("approve", 0.98), 2: ("no_match", 0.0), 3: ("no_match", 0.0)}
    e = {r["event_id"]: (r["alias_scope"], r["status"]) for r in resolve.effects(resolve.decide(found), events).collect()}
    assert e == {1: ("global", "resolved"), 2: (None, "ignored"), 3: (None, "ignored")}


def test_landed(spark, tmp_path):
    rows = [{"id": 1, "utcDate": "2024-01-01T12:00:00Z", "status": "TIMED", "competition": {"code": "C"}, "homeTeam": {"id": 1, "name": "", "shortName": "S"}, "awayTeam": {"id": 2, "name": "B"}}, {"id": 2, "utcDate": "x", "status": "FINISHED", "homeTeam": {"id": 1}, "awayTeam": {"id": 2}, "score": {"fullTime": {"home": 1, "away": 0}}}]
    (tmp_path / "m.json").write_text("\n".join(map(json.dumps, rows)))
    m = landed.matches(spark, str(tmp_path / "m.json"))
    assert landed.coming(m).first()["home_team"] == "S" and landed.finished(m).first()["home_goals"] == 1
    table = lambda n: [{"position": n, "points": 3, "team": {"id": 7, "name": "T"}}]
    (tmp_path / "s.json").write_text(json.dumps({"competition": {"code": "C"}, "standings": [{"type": "HOME", "table": table(9)}, {"type": "TOTAL", "table": table(1)}]}))
    assert landed.standings(spark, str(tmp_path / "s.json")).first()["position"] == 1


def test_snapshot_stream(spark, tmp_path):
    d = spark.range(20).select((F.col("id") % 5).alias("match_id"), (F.col("id") % 3).alias("bookmaker_id"), F.timestamp_seconds(F.col("id")).alias("snapshot_ts"), F.lit(1).alias("seq"), (F.lit(1.5) + F.col("id")).alias("home_odds"), F.lit(3.0).alias("draw_odds"), F.lit(4.0).alias("away_odds"))
    d.write.parquet(str(tmp_path / "in"))
    q = snapshots.refresh_consensus(snapshots.read(spark, str(tmp_path / "in")), str(tmp_path / "log"), str(tmp_path / "out"), str(tmp_path / "ck"))
    q.awaitTermination(120)
    got = snapshots.consensus_table(spark, str(tmp_path / "out"))
    assert {tuple(r) for r in got.collect()} == {tuple(r) for r in odds.consensus(d).collect()}
