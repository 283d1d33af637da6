"""Steps that must not grow with copies of their rows: names are compared once, bands are looked up, nothing is sent whole."""

from pyspark.sql import functions as F

from touchline.functions import names
from touchline.operators import resolve
from touchline.sources import lookup, pages
from touchline.streaming import snapshots


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_names_are_compared_once_and_not_broadcast(spark):
    events = spark.createDataFrame([(i, n, s) for i, (n, s) in enumerate([("FC Alpha Town", "x"), ("FC Alpha Town", None), ("Beta", "x")] * 40)], "event_id long, raw_name string, source_system string")
    teams = spark.createDataFrame([(1, "Alpha Town"), (2, "Alpha City"), (3, "Beta")], "team_id long, canonical_name string")
    known = spark.createDataFrame([(2, "alpha town", "x", None)], "team_id long, alias string, source_system string, competition_code string")
    e = events.select("event_id", F.lit("alpha town").alias("raw"))
    met = resolve.scored(e, teams.select("team_id", names.normal(F.col("canonical_name")).alias("form")), 0.98, resolve.TEAM_WEIGHTS, 0.45)
    assert "SortMergeJoin [piece" in plan(met)
    rows = {(r["event_id"] % 3, r["rank"]): (r["team_id"], r["score"]) for r in resolve.candidates(events, teams, aliases=known).collect()}
    assert resolve.candidates(events, teams, aliases=known).count() == 40 * len(rows)
    assert rows[0, 1] == (2, 1.0) and rows[1, 1] == (1, 0.98) and rows[2, 1] == (3, 0.98)
    decided = resolve.decided(events, teams, aliases=known)
    assert sorted((r["event_id"] % 3, r["team_id"]) for r in decided.filter("event_id < 3").collect()) == [(0, 2), (1, 1), (2, 3)] and decided.count() == 120


def test_plain_names_skip_the_class_of_ligatures(spark):
    assert "octet_length" in plan(spark.range(1).select(names.normal(F.col("id").cast("string"))))
    assert spark.sql("select 'ﬁve ½ Ångström' as t").select(names.normal(F.col("t"))).first()[0] == "five 12 angstroem"


def test_bands_are_looked_up_not_paired(spark):
    import random

    from touchline.operators import odds

    rng, width = random.Random(3), 180 * 60_000_000
    asked = [(i, rng.choice("ab"), rng.randrange(5) * width + rng.choice((0, 1, width - 1, rng.randrange(width)))) for i in range(60)] + [(60, "a", None)]
    given = [(i, rng.choice("ab"), rng.randrange(5) * width + rng.choice((0, 1, width - 1, rng.randrange(width)))) for i in range(40)] + [(-1, "b", None)]
    a, g = spark.createDataFrame(asked, "id long, k string, at long"), spark.createDataFrame(given, "event_id long, k string, at long")
    found = odds.first_in_band(a, g, ["k"], "id")
    hits = {i: [e for e, l, u in given if l == k and (u is None or t is not None and abs(t - u) <= width)] for i, k, t in asked}
    assert {r["id"]: r["event_id"] for r in found.collect()} == {i: min(x) for i, x in hits.items() if x}


def test_kinds_of_names_are_compared_once(spark):
    from touchline.operators import detect

    m = spark.createDataFrame([(i, "s", "c", "2024-01-01 12:00:00", "North Kings 1", "East City 2") for i in range(30)], "match_id long, sport_key string, competition_code string, kickoff_at string, home_team string, away_team string")
    e = spark.createDataFrame([(9, "s", "2024-01-01 14:59:00", "North Kings 1", "East City 2"), (8, "s", "2024-01-01 15:01:00", "North Kings 1", "East City 2"), (7, "s", None, "The North Kings 1 Rovers", "East City 2")], "event_id long, sport_key string, kickoff_at string, home_team string, away_team string")
    known = spark.createDataFrame([], "alias_normalized string, canonical_normalized string, source_system string, competition_code string")
    rows = detect.best_events(m, e, known).collect()
    assert sorted((r["match_id"], r["event_id"], r["score"]) for r in rows) == [(i, 9, 1.0) for i in range(30)]
    forms = detect.known_forms(m, known, "f_")
    assert forms.count() == 30 and forms.select("f_home", "f_away").distinct().count() == 1


def test_buckets_grow_with_rows(spark, tmp_path, monkeypatch):
    assert [lookup.buckets_for(n) for n in (0, 600_000, 16_000_001, 36_000_000)] == [16, 16, 32, 64]
    monkeypatch.setattr(lookup, "BUCKET_ROWS", 10)
    name = lookup.write(spark.range(400).select(F.col("id").alias("match_id")), "match_id", str(tmp_path / "b"))
    assert "64 out of 64" in plan(lookup.table(spark, name).groupBy("match_id").count()) and lookup.table(spark, name).count() == 400


def test_pages_have_a_bounded_number_of_files(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(pages, "MOST_FILES", 6, raising=False)
    order = pages.Order(("at", "id"), (True, False))
    pages.write(spark.range(900).select("id", (F.col("id") % 50).alias("at")), str(tmp_path), order, file_rows=10)
    p = pages.Pages(spark, str(tmp_path), order)
    assert 2 <= len(p.files()) <= 6
    first = p.page(30)
    assert [r["id"] for r in first.union(p.page(30, p.key(first))).collect()] == sorted(range(900), key=lambda i: (-(i % 50), i))[:60]


def test_a_task_of_a_batch_writes_a_bounded_part(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(snapshots, "TASK_ROWS", 50, raising=False)
    rows = spark.range(1200).selectExpr("id % 300 match_id", "id % 4 bookmaker_id", "timestamp'2024-01-01' snapshot_ts", "cast(id as int) seq", "1.5d home_odds", "cast(id as double) draw_odds", "3d away_odds").coalesce(1)
    log, table = str(tmp_path / "log"), str(tmp_path / "table")
    snapshots.refresh(snapshots.consensus(snapshots.append_snapshots(rows, log, 0, 2)), table, ["match_id"], 2, 1200)
    sizes = spark.read.parquet(f"{log}/batch=0").groupBy(F.input_file_name()).count()
    assert sizes.agg(F.max("count"), F.sum("count")).first()[0] < 400 and sizes.agg(F.sum("count")).first()[0] == 1200
    assert {tuple(r) for r in snapshots.consensus_table(spark, table).collect()} == {tuple(r) for r in snapshots.consensus(rows).collect()}


def test_alias_events_are_dealt_before_they_are_sorted(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(snapshots, "TASK_ROWS", 50, raising=False)
    df = spark.range(500).selectExpr("'s' source_system", "'c' competition_code", "'n' raw_name", "concat('n', id % 3) raw_name_normalized", "'home' home_or_away", "concat('x', 1000 + id) context", "'new' status").coalesce(1)
    seen = []
    monkeypatch.setattr(snapshots.merge, "latest", lambda d, *a, real=snapshots.merge.latest: seen.append(d.rdd.getNumPartitions()) or real(d, *a))
    snapshots.append_events(df, str(tmp_path / "t"), 0, 2)
    assert seen == [10]
    assert sorted(r["context"] for r in snapshots.alias_events(spark, str(tmp_path / "t")).collect()) == ["x1497", "x1498", "x1499"]


def test_normal_forms_are_found_before_events_are_read(spark):
    from touchline.operators import competitions

    events = spark.createDataFrame([(i, f"FC Alpha {i % 2}", "soccer_epl", "England Premier-League") for i in range(40)], "event_id long, raw_name string, external_code string, external_name string")
    teams = spark.createDataFrame([(1, "Alpha 1"), (2, "Beta")], "team_id long, canonical_name string")
    decided = resolve.decided(events.select("event_id", "raw_name"), teams)
    assert "octet_length" not in plan(decided) and decided.filter("decision = 'approve'").count() == 20
    known = spark.createDataFrame([("PREMIER_LEAGUE", "Premier League", "EPL", "England")], "competition_code string, competition_name string, league_abbr string, country string")
    found = competitions.candidates(events, known)
    assert plan(found).count("octet_length") <= 4 and found.filter("competition_code = 'PREMIER_LEAGUE' and rank = 1").count() == 40


def test_a_backtest_parses_a_score_once_and_sorts_teams_once(spark):
    from touchline.plans.backtest import backtest
    from touchline.session import HUGE_METHOD

    rows = [(i, "c", f"2024-01-{i % 28 + 1:02d} 12:00:00", i % 4 + 1, (i + 1) % 4 + 1, i % 3, i % 2, 2.0, 3.0, 3.5) for i in range(40)]
    m = spark.createDataFrame(rows, "match_id long, competition_code string, kickoff_at string, home_team_id long, away_team_id long, home_goals long, away_goals long, home_odds double, draw_odds double, away_odds double")
    spark.conf.set("spark.sql.codegen.hugeMethodLimit", "65535")
    said = plan(backtest(m))
    assert said.count("RLIKE") <= 8 and said.count("hashpartitioning(team_id") == 1 and "Scan ExistingRDD" in said
    assert spark.conf.get("spark.sql.codegen.hugeMethodLimit") == HUGE_METHOD


def test_rows_are_not_moved_to_their_names(spark):
    from touchline.operators import detect, odds

    m = spark.createDataFrame([(i, "c", f"FC North {i % 3}", None if i % 5 == 0 else "East SV") for i in range(60)], "match_id long, competition_code string, home_team string, away_team string")
    known = spark.createDataFrame([("north 1", "kings 1", None, "c"), ("north 2", "kings 2", "other", None)], "alias_normalized string, canonical_normalized string, source_system string, competition_code string")
    forms = detect.known_forms(m, known, "f_")
    said = plan(forms)
    assert said.count("BroadcastHashJoin") == 2 and "SortMergeJoin" not in said and "octet_length" not in said
    rows = forms.collect()
    assert len(rows) == 60 and all(r["f_home_set"] == {0: ["north 0"], 1: ["kings 1", "north 1"], 2: ["north 2"]}[r["match_id"] % 3] for r in rows)
    assert all((r["f_away"], r["f_away_set"]) == (("", []) if r["match_id"] % 5 == 0 else ("east", ["east"])) for r in rows)
    at = spark.createDataFrame([(1, "a", 5)], "id long, k string, at long")
    assert plan(odds.first_in_band(at, at.withColumnRenamed("id", "event_id"), ["k"], "id")).count("Sort [slot#") == 2


def test_filtered_pages_read_a_bounded_number_of_files(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(pages, "MOST_FILES", 6, raising=False)
    order = pages.Order(("at", "id"), (True, False))
    pages.write(spark.range(900).select("id", (F.col("id") % 50).alias("at")), str(tmp_path), order, file_rows=10)
    p, mine = pages.Pages(spark, str(tmp_path), order), F.col("id") % 45 == 7
    want = sorted(range(7, 900, 45), key=lambda i: (-(i % 50), i))
    first = p.page(8, where=mine)
    second = p.page(8, p.key(first), mine)
    last = p.page(8, p.key(second), mine)
    assert [[r["id"] for r in x.collect()] for x in (first, second, last)] == [want[:8], want[8:16], want[16:]]
    assert len(first.inputFiles()) <= 6 and len(last.inputFiles()) <= 6
