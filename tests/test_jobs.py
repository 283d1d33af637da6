"""The jobs around the models: run log, patches, aliases, calibration, landed payloads, streams, pages, lookups."""

import json
import math
import os
import random
from datetime import datetime, timezone

import pytest
from pyspark.sql import functions as F

from touchline.functions import marginals
from touchline.operators import calibration, client, merge, models, reports, resolve, scans
from touchline.plans.runlog import RunLog, iso_utc
from touchline.sources import landed, lookup, pages
from touchline.streaming import snapshots

AT = "2024-02-01 00:00:00"


def test_run_log(spark, tmp_path):
    log = RunLog(spark, str(tmp_path / "log"), version="7", commit="abc")
    assert log.runs().count() == log.releases().count() == 0  # nothing logged yet
    with log.run("job", {"a": "1"}) as run:
        for i in (3, 4):  # two outputs of a job add up
            run.counted(spark.range(i), total=F.sum("id")).write.mode("overwrite").parquet(str(tmp_path / f"o{i}"))
    with pytest.raises(ZeroDivisionError), log.run("bad"):
        1 / 0  # noqa: B018
    log.start("open")
    by = {r["job_name"]: r for r in log.runs().collect()}
    assert by["job"]["status"] == "success" and by["job"]["metadata"] == {"a": "1", "n_rows": "7", "total": "9"} and by["job"]["system_version"] == "7"
    assert by["bad"]["status"] == "failed" and by["bad"]["metadata"]["error"].startswith("ZeroDivisionError")
    assert by["open"]["status"] == "running" and by["open"]["finished_at"] is None
    log.finish("")
    log.release("first")
    RunLog(spark, str(tmp_path / "log"), version="7").release("second")
    assert [(r["system_version"], r["notes"]) for r in log.releases().collect()] == [("7", "first")]


def test_run_log_never_raises(spark, tmp_path):
    (tmp_path / "file").write_text("in the way")
    log = RunLog(spark, str(tmp_path / "file"))
    with log.run("job") as run:
        assert run.counted(spark.range(5)).collect()
    assert log.runs().count() == 0


def test_iso_utc():
    assert iso_utc(datetime(2024, 1, 2, 3, 4)) == "2024-01-02T03:04:00+00:00" == iso_utc(datetime(2024, 1, 2, 3, 4, tzinfo=timezone.utc))


def test_patch_rewrites_touched_partitions_only(spark, tmp_path):
    path = str(tmp_path / "t")
    rows = [(k, k % 3, "old", None) for k in range(30)] + [(None, 1, "null key", None)]
    spark.createDataFrame(rows, "k int, part int, v string, updated_at timestamp_ntz").write.partitionBy("part").parquet(path)
    files = lambda p: {f for f in os.listdir(f"{path}/part={p}") if f.endswith(".parquet")}
    before = {p: files(p) for p in range(3)}
    changes = spark.createDataFrame([(4, 1, "new", 1), (4, 1, None, 2), (None, 1, "x", 1), (5, 1, "not there", 1), (99, 0, "no such key", 1)], "k int, part int, v string, nth int")
    assert merge.patch_partitions(spark, path, changes, ["k"], ["v"], AT, "part", order="nth") == [1]
    after = {p: files(p) for p in range(3)}
    assert after[0] == before[0] and after[2] == before[2] and after[1].isdisjoint(before[1])
    got = {r["k"]: (r["v"], r["updated_at"] is not None) for r in spark.read.parquet(path).collect()}
    assert len(got) == 31 and got[4] == (None, True) and got[None] == ("x", True) and got[7] == ("old", False) and got[5] == ("old", False)
    assert merge.patch_partitions(spark, path, changes.filter("part = 0"), ["k"], ["v"], AT, "part") == []


def test_upsert_takes_the_last(spark):
    old = spark.createDataFrame([(1, "a", 1)], "k int, v string, nth int")
    new = spark.createDataFrame([(1, "b", 5), (1, "c", 9), (1, "d", 7)], "k int, v string, nth int")
    assert [tuple(r) for r in merge.upsert(old, new, ["k"], order="nth").collect()] == [(1, "c", 9)]


ALIASES = "id string, team_id int, source_system string, competition_code string, alias_name string, alias_normalized string, status string, decision_source string, confidence double, explanation string, usage_count long, last_seen_at timestamp_ntz, updated_at timestamp_ntz"


def test_alias_upsert_counts(spark):
    old = spark.createDataFrame([
        ("a", 1, "", None, "X", "x", "approved", "seed", 1.0, None, None, None, None),
        ("b", 1, None, "", "X", "x", "approved", "seed", 1.0, None, 4, None, None),
        ("c", 1, "s", "c1", "X", "x", "approved", "seed", 1.0, None, 4, None, None),
        ("d", 2, None, None, "Y", "y", "approved", "seed", 1.0, None, 2, None, None),
    ], ALIASES)
    row = "event_id int, team_id int, source_system string, competition_code string, alias_name string, alias_normalized string, status string, decision_source string, confidence double, explanation string"
    new = spark.createDataFrame([(i, 1, None, None, f"X{i}", "x", "approved", "ai_agent", 0.9, "e") for i in (1, 3, 2)] + [(4, 3, "s", "c1", "Z", "z", "provisional", "ai_agent", 0.8, "e")], row)
    got = {r["id"]: r for r in resolve.upsert_aliases(old, new, AT).collect()}
    assert len(got) == 5
    assert (got["a"]["alias_name"], got["a"]["usage_count"], got["a"]["source_system"], got["a"]["decision_source"]) == ("X3", 3, "", "ai_agent")  # null counts as 0; the last event's name
    assert (got["b"]["usage_count"], got["b"]["last_seen_at"]) == (4, None) and got["c"]["usage_count"] == 4 and got["d"]["alias_name"] == "Y"
    assert (got[None]["team_id"], got[None]["usage_count"], got[None]["status"], str(got[None]["last_seen_at"])) == (3, 1, "provisional", AT)


def test_decisions_of_all_events(spark):
    events = spark.createDataFrame([(1, "FC Alpha Town", "s", "c1"), (2, "Alfa", "s", "c1"), (3, "Zzz", "s", "c1"), (4, "Alfa", "s", "c2")], "event_id int, raw_name string, source_system string, competition_code string")
    teams = spark.createDataFrame([(10, "Alpha Town"), (11, "Beta City")], "team_id int, canonical_name string")
    known = spark.createDataFrame([(11, "Alfa", None, "c1")], "team_id int, alias string, source_system string, competition_code string")
    found = resolve.candidates(events, teams, aliases=known, explain=True)
    decided = resolve.decide(found, events)
    d = {r["event_id"]: (r["decision"], r["team_id"], r["score"]) for r in decided.collect()}
    assert d == {1: ("approve", 10, 0.98), 2: ("approve", 11, 1.0), 3: ("no_match", None, 0.0), 4: ("no_match", None, 0.0)}
    log = {r["event_id"]: json.loads(r["reasoning"]) for r in resolve.reasoning(events, decided).collect()}
    assert log[2]["top_candidate"]["reason_bits"] == ["exact_alias", "via_alias=Alfa"] and log[2]["top_candidate"]["matched_via"] == "alias"
    assert log[1]["top_candidate"]["reason_bits"] == ["exact_canonical", "via_canonical"] and log[1]["thresholds"] == {"approve": 0.95, "approve_provisional": 0.78, "min_candidate_score": 0.45}
    assert log[3] == {"raw_name": "Zzz", "raw_name_normalized": "zzz", "decision_basis": "no_candidates"}
    said = {r["event_id"]: r["explanation"] for r in resolve.new_aliases(events, decided).collect()}
    assert said[2] == "auto_resolve matched 'Alfa' → 'Beta City' mit score=1.0000 via=alias" and set(said) == {1, 2}
    odd = spark.createDataFrame([("approve",), ("no_match",), ("what",)], "d string").select(resolve.status(F.col("d")).alias("s"))
    assert [r["s"] for r in odd.collect()] == ["resolved", "ignored", "rejected"]


def plain_fit(rows):
    if len(rows) < 200:
        return 1.0
    best, at = math.inf, 1.0
    for i in range(51):
        t = 0.5 + 2.0 * i / 50
        loss = 0.0
        for p, y in rows:
            q = p if t == 1.0 else math.exp(math.log(max(1e-7, min(1 - 1e-7, p))) / t)
            q = max(1e-7, min(1 - 1e-7, q))
            loss -= math.log(q if y else 1 - q)
        if loss / len(rows) < best - 1e-12:
            best, at = loss / len(rows), t
    return round(at, 3)


def test_walk_forward(spark):
    rng = random.Random(8)
    rows = []
    for season, n in ((2020, 150), (2021, 120), (2022, 0), (2023, 90), (None, 5)):
        for _ in range(n):
            a, b, c = (rng.random() ** 2 for _ in range(3))
            s = a + b + c
            rows.append((len(rows), season, a / s, b / s, c / s, rng.choices("HDA", (a + 0.5, b + 0.5, c + 0.5))[0]))
    rows += [(-1, 2022, None, 0.5, 0.5, "H"), (-2, 2023, 0.2, 0.3, 0.5, None)]
    df = spark.createDataFrame(rows, "match_id int, season int, prob_home double, prob_draw double, prob_away double, actual_1x2 string")
    fits = {r["season"]: r for r in calibration.walk_forward(df).collect()}
    assert set(fits) == {None, 2020, 2021, 2022, 2023}
    order = [None, 2020, 2021, 2022, 2023]
    for i, season in enumerate(order):
        before = [r for r in rows if r[1] in order[:i] and r[2] is not None and r[5]]
        want = [plain_fit([(r[2 + k], r[5] == c) for r in before]) for k, c in enumerate("HDA")]
        f = fits[season]
        assert [f["t_home"], f["t_draw"], f["t_away"]] == want and f["n_samples"] == (len(before) if len(before) >= 200 else 0)
    assert fits[2021]["version"] == "identity" and fits[2023]["version"] == "auto" and not fits[2023]["is_identity"]
    out = {r["match_id"]: r for r in calibration.apply_calibration(df, calibration.walk_forward(df)).collect()}
    assert len(out) == len(rows) and out[-1]["cal_home"] is out[-1]["cal_draw"] is None
    for r in rows:
        if r[2] is None:
            continue
        got = [out[r[0]][f"cal_{k}"] for k in ("home", "draw", "away")]
        if r[1] in (None, 2020, 2021):
            assert got == list(r[2:5])
        else:
            assert abs(sum(got) - 1) < 1e-9
            t = [fits[r[1]][f"t_{k}"] for k in ("home", "draw", "away")]
            q = [p ** (1 / x) for p, x in zip(r[2:5], t)]
            assert all(abs(g - x / sum(q)) < 2.1e-4 for g, x in zip(got, q))
    none = spark.createDataFrame([], calibration.walk_forward(df).schema)
    assert {r["calibration"] for r in calibration.apply_calibration(df, none).collect()} == {"identity"}
    assert spark.range(1).select(calibration.identity().alias("i")).first()["i"].asDict() == calibration.IDENTITY


def test_landed_payloads(spark, tmp_path):
    event = {"id": "1", "sport_key": "s", "commence_time": "2024-01-01T10:00:00Z", "home_team": "A", "away_team": "B", "bookmakers": [{"key": "b", "title": "B", "markets": [{"key": "h2h", "outcomes": [{"name": "A", "price": 2.5}, {"name": "B", "price": "what"}]}]}]}
    answers = {"good": json.dumps([event, {"id": None}, {"id": "2", "commence_time": "soon", "extra": 1}], indent=2), "cut": json.dumps([event])[:-30], "limit": '{"message": "429"}', "nothing": " \n", "none": "[]"}
    for name, text in answers.items():
        (tmp_path / f"{name}.json").write_text(text)
    events, rejects = landed.odds_events(spark, str(tmp_path / "*.json"))
    got = {r["id"]: r for r in events.collect()}
    assert set(got) == {"1", "2"} and got["2"]["commence_at"] is None and str(got["1"]["commence_at"]) == "2024-01-01 10:00:00" and got["1"]["source_file"].endswith("good.json")
    assert [o["price"] for o in got["1"]["bookmakers"][0]["markets"][0]["outcomes"]] == [2.5, None]
    assert {r["source_file"].rsplit("/", 1)[1]: r["reason"] for r in rejects.collect()} == {"cut.json": "no JSON", "limit.json": "another shape", "nothing.json": "empty"}
    (tmp_path / "sports.txt").write_text('[{"key": "a", "active": true}, {"key": "b"}, {"key": "c", "active": false}]\n[{"key": "a"}]\n')
    sports, none = landed.sports(spark, str(tmp_path / "sports.txt"), whole_files=False)
    assert sorted(r["key"] for r in sports.collect()) == ["a", "b"] and none.count() == 0


def test_recent_team_matches(spark, tmp_path):
    match = lambda i, score, status="FINISHED": {"id": i, "utcDate": f"2024-01-{i:02d}T12:00:00Z", "status": status, "homeTeam": {"id": 1}, "awayTeam": {"id": 2}, "score": score and {"fullTime": {"home": score[0], "away": score[1]}}}
    team = {"team_id": 1, "matches": [match(i, None if i % 2 else (i, 0), "TIMED" if i == 20 else "FINISHED") for i in range(1, 21)] + [match(18, (18, 0))]}
    (tmp_path / "t.json").write_text(json.dumps(team, indent=1))
    (tmp_path / "u.json").write_text('{"team_id": 2, "matches": [')
    (tmp_path / "v.json").write_text('{"team_id": 3}')
    found, rejects = landed.recent_team_matches(spark, str(tmp_path / "*.json"))
    assert [(r["match_id"], r["rank"]) for r in found.orderBy("rank").collect()] == [(18, 1), (16, 2), (14, 3), (12, 4), (10, 5)]
    assert [r["reason"] for r in rejects.collect()] == ["no JSON"]


def test_streams_write_once(spark, tmp_path):
    rows = spark.range(40).select((F.col("id") % 7).alias("match_id"), (F.col("id") % 3).alias("bookmaker_id"), F.timestamp_seconds(F.col("id")).alias("snapshot_ts"), F.lit(1).alias("seq"), (F.lit(1.5) + F.col("id")).alias("home_odds"), F.lit(3.0).alias("draw_odds"), F.lit(4.0).alias("away_odds"))
    log, table = str(tmp_path / "log"), str(tmp_path / "table")
    for number, part in ((0, "snapshot_ts < timestamp '1970-01-01 00:00:20'"), (1, "match_id = 3"), (1, "match_id <> 9 and snapshot_ts >= timestamp '1970-01-01 00:00:20'"), (1, "match_id <> 9 and snapshot_ts >= timestamp '1970-01-01 00:00:20'")):  # the second batch is tried three times
        snapshots.refresh(snapshots.consensus(snapshots.append_snapshots(rows.filter(part), log, number, 3)), table, ["match_id"], 3)
    want = {tuple(r) for r in snapshots.consensus(rows).collect()}
    assert {tuple(r) for r in snapshots.consensus_table(spark, table).collect()} == want
    assert spark.read.parquet(log).count() == 40
    snapshots.refresh(snapshots.consensus(snapshots.append_snapshots(rows.limit(0), log, 2, 3)), table, ["match_id"], 3)  # an empty batch
    assert snapshots.consensus_table(spark, table).count() == 7


def test_alias_events_once(spark, tmp_path):
    rows = [("s", None, "A", "a", "home", str(i), "new") for i in range(3)] + [("s", "c", "A", "a", "home", "x", "new")]
    df = spark.createDataFrame(rows, snapshots.ALIAS_EVENTS)
    table = str(tmp_path / "events")
    for number in (0, 0, 1):
        snapshots.append_events(df, table, number, 2)
    snapshots.append_events(spark.createDataFrame([("s", "c", "B", "b", "away", "y", "new")], snapshots.ALIAS_EVENTS).union(df), table, 2, 2)
    got = sorted((r["competition_code"] or "", r["raw_name"], r["context"]) for r in snapshots.alias_events(spark, table).collect())
    assert got == [("", "A", "2"), ("c", "A", "x"), ("c", "B", "y")]


def test_pages_are_the_whole_order(spark, tmp_path):
    rng = random.Random(2)
    rows = [(i, rng.choice([None, *range(12)]), rng.choice("xy")) for i in range(300)]
    df = spark.createDataFrame(rows, "match_id int, at int, code string").repartition(4)
    order = pages.Order(("at", "match_id"), (True, False))
    pages.write(df, str(tmp_path / "p"), order, file_rows=40)
    p = pages.Pages(spark, str(tmp_path / "p"), order)
    want = sorted(rows, key=lambda r: (r[1] is None, -(r[1] or 0), r[0]))
    assert len(p.files()) >= 6
    got, key = [], None
    for _ in range(99):
        page = p.page(37, key)
        if (key := p.key(page)) is None:
            break
        got += [tuple(r) for r in page.collect()]
    assert got == want
    assert len(p.files((want[250][1], want[250][0]))) <= 3  # files before the key aren't read
    mine = F.col("code") == "x"
    first = p.page(20, where=mine)
    assert [tuple(r) for r in first.collect()] + [tuple(r) for r in p.page(20, p.key(first), mine).collect()] == [r for r in want if r[2] == "x"][:40]
    pages.write(df.limit(0), str(tmp_path / "none"), order)
    assert pages.Pages(spark, str(tmp_path / "none"), order).page(5).count() == 0


def test_view_model(spark):
    v = client.view_model(spark.createDataFrame([(1, None, None, 60, "home", 1.5, 3.0, None, None)], "match_id int, home_team string, away_team string, win_probability int, predicted_winner string, market_home_win_odds double, market_draw_odds double, market_away_odds double, form_home array<string>")).first()
    assert (v["id"], v["home_team"], v["away_team"], v["lead_prob"], v["lead_label"], v["flag"], v["risk_level"], v["form_home"], v["risk_tags"]) == ("1", "Heim", "Auswärts", 60, "Heim", "🌍", "low", [], [])
    m = v["market"]
    assert not m["has_odds"] and not m["has_model"] and m["odds"].asDict() == {"home": 1.5, "draw": 3.0, "away": None} and m["value"].asDict() == {"home": False, "draw": False, "away": False} and m["provider"] is None
    empty = client.view_model(spark.createDataFrame([(None,)], "home_team string")).first()
    assert (empty["lead_prob"], empty["lead_label"], empty["predicted_winner"], empty["kickoff_at"]) == (0, "Unentschieden", "draw", None)


def test_number_formats(spark):
    rows = spark.createDataFrame([(0.125,), (-0.031,), (None,), (0.0,)], "x double")
    got = rows.select(client.percent(F.col("x")).alias("p"), client.signed_percent(F.col("x")).alias("s"), client.signed(F.col("x")).alias("n")).collect()
    assert [tuple(r) for r in got] == [("13%", "+12.5%", "+0.13"), ("-3%", "-3.1%", "-0.03"), ("–", "–", "–"), ("0%", "+0.0%", "+0.00")]


def featured(spark, rows):
    schema = "match_id int, home_strength double, away_strength double, home_form string, away_form string, home_odds double, draw_odds double, away_odds double"
    return spark.createDataFrame(rows, schema)


def test_a_failing_model_doesn_t_stop_the_others(spark):
    f = featured(spark, [(1, 60.0, 40.0, "WWD", "LLL", 2.0, 3.0, 4.0), (2, 60.0, 40.0, "", "", 0.0, 3.0, 4.0), (3, float("nan"), 40.0, "", "", 2.0, -1.0, 0.0), (4, None, None, "", "", None, None, None)])

    def broken(df):
        raise RuntimeError("no weights")

    out = models.long_form_isolated(f, {"broken": broken, **models.SERVER}).collect()
    by = {(r["match_id"], r["model_key"]): r for r in out}
    assert len(out) == 24 and all(by[i, "broken"]["failed"] == "RuntimeError: no weights" and by[i, "broken"]["winner"] is None for i in range(1, 5))
    assert by[2, "market"]["failed"] == by[2, "ensemble"]["failed"] == "bad input: home_odds" and by[2, "market"]["score"] is None and by[2, "dc"]["winner"] == "home"
    assert by[3, "market"]["failed"] == "bad input: home_strength, draw_odds, away_odds" and by[3, "poisson"]["failed"] == "bad input: home_strength"
    assert all(by[i, m]["failed"] is None and by[i, m]["winner"] for i in (1, 4) for m in models.SERVER)
    whole = {(r["match_id"], r["model_key"]): (r["winner"], r["score"], r["confidence"], r["prob_home"]) for r in models.long_form(f.filter("match_id in (1, 4)")).collect()}
    assert whole == {k: (by[k]["winner"], by[k]["score"], by[k]["confidence"], by[k]["prob_home"]) for k in whole}
    missing = models.evaluate_isolated(f.drop("home_odds")).first()
    assert missing["m_market"] is None and "home_odds" in missing["e_market"] and missing["m_dc"]["winner"] == "home"
    assert list(models.registry()) == ["poisson", "dc", "elo", "market"] and list(models.registry(True)) == list(models.SERVER) and models.PRIMARY == "dc"


def test_supported_consensus(spark):
    rows = spark.createDataFrame([(1, "poisson", "2:1"), (1, "elo", "2:1"), (1, "ensemble", "1:0"), (1, "market", "1:0"), (2, "new", "0:0"), (2, "market", "1:1")], "match_id int, model_key string, predicted_score string")
    got = {r["match_id"]: r for r in reports.supported_consensus(rows, models.VOTES).collect()}
    assert (got[1]["consensus_score"], got[1]["weight_sum"], got[1]["total_weight"], got[1]["models_supporting"], got[1]["confidence"]) == ("1:0", 4, 8, ["ensemble", "market"], "moderate")
    assert (got[2]["consensus_score"], got[2]["models_supporting"]) == ("1:1", ["market"])


def test_buckets_join_without_a_shuffle(spark, tmp_path):
    a = lookup.write(spark.range(500).select((F.col("id") % 50).alias("match_id"), F.col("id").alias("x")), "match_id", str(tmp_path / "a"), buckets=4)
    b = lookup.write(spark.range(50).select(F.col("id").alias("match_id"), (F.col("id") * 2).alias("y")), "match_id", str(tmp_path / "b"), buckets=4)
    joined = lookup.table(spark, a).join(lookup.table(spark, b).hint("merge"), "match_id").groupBy("match_id").agg(F.count("*").alias("n"), F.max("y").alias("y"))
    plan = joined._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan
    assert {(r["match_id"], r["n"], r["y"]) for r in joined.collect()} == {(i, 10, 2 * i) for i in range(50)}
    one = lookup.for_match(spark, a, 7)
    assert "SelectedBucketsCount: 1 out of 4" in one._jdf.queryExecution().executedPlan().treeString() or one.count() == 10
    assert len([f for f in os.listdir(tmp_path / "a") if f.endswith(".parquet")]) <= 4


def test_win_probability(spark):
    rows = [(1.4, 1.1), (0.3, 4.0), (9.0, 0.3), (None, 1.0)]
    got = marginals.with_win_probability(spark.createDataFrame(rows, "a double, b double"), F.col("a"), F.col("b")).collect()
    pois = lambda k, x: math.exp(-x) * x**k / math.factorial(k)
    for r, (a, b) in zip(got, rows):
        want = None if a is None else min(0.9, sum(pois(i, a) * pois(j, b) for i in range(6) for j in range(i)))
        assert r["win_probability"] == (want if want is None else pytest.approx(want, abs=1e-12))
    assert got[0].__fields__ == ["a", "b", "win_probability"]


def test_windows_closed_or_open(spark):
    rows = spark.createDataFrame([(1, "2024-01-01 00:00:00"), (2, "2024-01-03 00:00:00")], "match_id int, t string").select("match_id", F.col("t").cast("timestamp_ntz").alias("kickoff_at"))
    ids = lambda closed: [r["match_id"] for r in scans.upcoming(rows, "2024-01-01 00:00:00", 2, closed=closed).collect()]
    assert ids(False) == [1] and ids(True) == [1, 2]


def test_a_forecast_can_be_filtered(spark):
    from touchline import catalog
    from touchline.operators.forecast import forecast

    f = forecast(catalog._featured(spark, "/root/testdata/sf0.001")) if os.path.isdir("/root/testdata/sf0.001") else pytest.skip("no test data")
    rows = f.select("match_id", "risk_level", "win_pct", "confidence_score").collect()
    want = {r["match_id"] for r in rows if r["risk_level"] == "medium" and r["win_pct"] > 40 and r["confidence_score"] > 20}
    got = {r["match_id"] for r in f.filter("risk_level = 'medium' and win_pct > 40 and confidence_score > 20").select("match_id").collect()}
    assert got == want


def plain_normal(text):
    import re
    import unicodedata

    x = (text or "").strip().lower()
    for a, b in (("ä", "ae"), ("ö", "oe"), ("ü", "ue"), ("ß", "ss")):
        x = x.replace(a, b)
    x = "".join(c for c in unicodedata.normalize("NFKD", x) if not unicodedata.combining(c))
    return re.sub(r"\s+", " ", re.sub(r"[^a-z0-9\s]", "", re.sub("[/-]", " ", x))).strip()


def test_names_are_decomposed(spark):
    from touchline.functions import names

    texts = ["ﬁrst ﬂoor", "Ｆｕｌｌ　Ｗｉｄｔｈ １２", "½ time", "№ 5 ™", "Ångström-Ünïon", "ǆ Ǆ", "𝐁old 𝑖t", "Łódź Ø", "a/b-c", "x² ³", "Ĳssel ŉ", "'quote' \\ back", "ﬃ ﬀ", None, ""]
    got = spark.createDataFrame([(t,) for t in texts], "t string").select(names.normal(F.col("t")).alias("n")).collect()
    assert [r["n"] for r in got] == [plain_normal(t) for t in texts]


def test_matches_without_a_kickoff(spark):
    from touchline.operators.features import with_features

    at = lambda d: f"2024-01-{d:02d} 12:00:00"
    rows = [(1, at(1), 1, 2, 1, 0), (2, at(2), 2, 1, 2, 2), (3, None, 1, 2, 0, 3), (4, at(4), 1, 2, 4, 0), (5, None, 1, 9, None, None)]
    m = spark.createDataFrame(rows, "match_id int, t string, home_team_id int, away_team_id int, home_goals int, away_goals int").withColumn("kickoff_at", F.to_timestamp("t"))
    by = {r["match_id"]: r for r in with_features(m, undated=True).collect()}
    assert by[3]["home_form"] == by[5]["home_form"] == "WDWL" and by[3]["home_n_prior"] == 4 and by[5]["away_n_prior"] == 0 and by[5]["away_form"] == ""
    assert by[4]["home_form"] == "DW" and not by[3]["home_crosses_year"]
    assert {r["match_id"]: r["home_form"] for r in with_features(m).collect()}[3] == ""
