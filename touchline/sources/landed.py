"""Readers of JSON payloads that a landing job has stored."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators.odds import EVENT_SCHEMA

MATCH_SCHEMA = """id long, utcDate string, status string, competition struct<code:string, name:string>,
  homeTeam struct<id:long, name:string, shortName:string>, awayTeam struct<id:long, name:string, shortName:string>,
  score struct<fullTime:struct<home:int, away:int>>"""
STANDINGS_SCHEMA = """competition struct<code:string>,
  standings array<struct<type:string, table:array<struct<position:int, points:int, team:struct<id:long, name:string>>>>>"""


SPORT_SCHEMA = "key string, `group` string, title string, description string, active boolean, has_outrights boolean"


def matches(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(MATCH_SCHEMA).json(path)


def payloads(spark: SparkSession, path: str, schema: str, whole_files: bool = True) -> tuple[DataFrame, DataFrame]:
    """(parsed, rejects) of stored answers, one in each file or, without ``whole_files``, one in each line.

    The schema is an array or a struct.  ``parsed`` has source_file and a column ``payload`` of it; fields of another kind are null in it.  An answer
    that is no JSON, is empty, or isn't of the schema's shape at all (an error message where a list is due), is a
    row of ``rejects`` with its text, so that nothing is lost without a trace.  A row holds one answer, whose
    size the service bounds.
    """
    text = spark.read.text(path, wholetext=whole_files).select(F.col("_metadata.file_path").alias("source_file"), F.col("value").alias("text"))
    is_list = schema.lstrip().lower().startswith("array")
    fits = F.col("text").rlike(r"^\s*\[" if is_list else r"^\s*\{")
    # a broken answer parses to a null (list) or to the corrupt column (object)
    kind = schema if is_list else f"{schema.rstrip()[:-1]}, _broken: string>"
    read = text.withColumn("payload", F.when(fits, F.from_json("text", kind, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_broken"})))
    bad = F.col("payload").isNull() if is_list else F.col("payload").isNull() | F.col("payload._broken").isNotNull()
    bad = F.coalesce(bad, F.lit(True))
    reason = F.when(F.col("text").rlike(r"^\s*$"), "empty").when(~fits, "another shape").otherwise("no JSON")
    return read.filter(~bad).select("source_file", "payload"), read.filter(bad).select("source_file", "text", reason.alias("reason"))


def odds_events(spark: SparkSession, path: str, whole_files: bool = True) -> tuple[DataFrame, DataFrame]:
    """(events, rejects) of stored odds answers: a row for each event with an id, with commence_at as a timestamp."""
    parsed, rejects = payloads(spark, path, f"array<struct<{_colons(EVENT_SCHEMA)}>>", whole_files)
    rows = parsed.select("source_file", F.inline("payload"))
    return rows.filter(F.col("id").isNotNull()).withColumn("commence_at", F.try_to_timestamp("commence_time")), rejects


def sports(spark: SparkSession, path: str, whole_files: bool = True) -> tuple[DataFrame, DataFrame]:
    """(sports, rejects) of stored lists of sports; a sport that doesn't say whether it is active is."""
    parsed, rejects = payloads(spark, path, f"array<struct<{_colons(SPORT_SCHEMA)}>>", whole_files)
    rows = parsed.select(F.inline("payload")).filter(F.coalesce("active", F.lit(True)) & F.col("key").isNotNull())
    return rows.groupBy("key").agg(*(F.max(c).alias(c) for c in ("group", "title"))), rejects


def by_sport(rows: DataFrame, sport: str = "sport_key") -> DataFrame:
    """How many matches and competitions are asked for of each sport."""
    return rows.groupBy(sport).agg(F.count("*").alias("n_matches"), F.countDistinct("competition_code").alias("n_competitions"))


#: A form of n matches asks for this many times n, and at least for LEAST_ASKED, as some have no score.
ASKED_TIMES, LEAST_ASKED = 3, 15


def recent_team_matches(spark: SparkSession, path: str, limit: int = 5, whole_files: bool = True) -> tuple[DataFrame, DataFrame]:
    """(matches, rejects) of stored answers on one team each: team_id and its last ``limit`` finished matches with a score, newest first.

    Of each team the answers' first max(3 * limit, 15) matches are looked at, by time; ``rank`` is 1 for the newest.
    """
    parsed, rejects = payloads(spark, path, f"struct<team_id: long, matches: array<struct<{_colons(MATCH_SCHEMA)}>>>", whole_files)
    rows = parsed.select(F.col("payload.team_id").alias("team_id"), F.inline("payload.matches")).filter("status = 'FINISHED'")
    rows = rows.select("team_id", F.col("id").alias("match_id"), F.try_to_timestamp("utcDate").alias("kickoff_at"), F.col("homeTeam.id").alias("home_team_id"), F.col("awayTeam.id").alias("away_team_id"), F.col("score.fullTime.home").alias("home_goals"), F.col("score.fullTime.away").alias("away_goals"))
    rows = rows.dropDuplicates(["team_id", "match_id"])
    order = Window.partitionBy("team_id").orderBy(F.desc_nulls_last("kickoff_at"), F.desc("match_id"))
    asked = rows.withColumn("at", F.row_number().over(order)).filter(F.col("at") <= max(ASKED_TIMES * limit, LEAST_ASKED))
    scored = asked.filter("home_goals IS NOT NULL AND away_goals IS NOT NULL").withColumn("rank", F.row_number().over(order))
    return scored.filter(F.col("rank") <= limit).drop("at"), rejects


def _colons(schema: str) -> str:
    """A schema's columns written as the fields of a struct."""
    out, depth = [], 0
    for part in schema.split(","):
        out.append(part.strip() if depth else part.strip().replace(" ", ": ", 1))
        depth += part.count("<") - part.count(">")
    return ", ".join(out)


def _name(team: str) -> Column:
    return F.coalesce(F.nullif(F.col(f"{team}.name"), F.lit("")), F.col(f"{team}.shortName"))


def coming(landed: DataFrame) -> DataFrame:
    """Scheduled matches with an id, a date and both names."""
    out = landed.filter(F.col("status").isin("TIMED", "SCHEDULED")).select(F.col("id").cast("string").alias("external_id"), F.try_to_timestamp("utcDate").alias("kickoff_at"), F.col("competition.code").alias("competition_code"), _name("homeTeam").alias("home_team"), _name("awayTeam").alias("away_team"), F.col("homeTeam.id").alias("home_team_id"), F.col("awayTeam.id").alias("away_team_id"))
    return out.dropna(subset=["external_id", "kickoff_at", "home_team", "away_team"])


def finished(landed: DataFrame) -> DataFrame:
    """Finished matches with a full-time score."""
    goals = F.col("score.fullTime")
    return landed.filter((F.col("status") == "FINISHED") & goals["home"].isNotNull() & goals["away"].isNotNull()).select(F.col("id").cast("string").alias("external_id"), F.try_to_timestamp("utcDate").alias("kickoff_at"), F.col("competition.code").alias("competition_code"), F.col("homeTeam.id").alias("home_team_id"), F.col("awayTeam.id").alias("away_team_id"), goals["home"].alias("home_goals"), goals["away"].alias("away_goals"))


#: Display columns and odds of the stored matches that a result takes where it finds them.
ENRICHMENT = ("home_team", "away_team", "flag", "league_abbr", "competition_code", "market_home_win_odds", "market_draw_odds", "market_away_odds")


def results(landed: DataFrame, enrichment: DataFrame, season: str, code: str | None = None) -> DataFrame:
    """Landed matches with a full-time score as the back-test reads them, whatever their status.

    ``enrichment`` (external_id and ENRICHMENT) gives names, flag, league and odds; where it doesn't, the answer's own
    name or short name counts, and '?' where there is none.  ``code`` stands for a missing competition.
    """
    goals, own = F.col("score.fullTime"), F.coalesce(F.col("competition.code"), F.lit(code))
    rows = landed.filter(goals["home"].isNotNull() & goals["away"].isNotNull()).select(
        F.concat(F.lit("football_data_"), F.col("id").cast("string")).alias("external_id"), F.col("homeTeam.id").alias("home_team_id"), F.col("awayTeam.id").alias("away_team_id"),
        F.try_to_timestamp("utcDate").alias("kickoff_at"), goals["home"].alias("home_goals"), goals["away"].alias("away_goals"), own.alias("_code"), _name("homeTeam").alias("_home"), _name("awayTeam").alias("_away"),
    )
    e = enrichment.select("external_id", *(F.col(c).alias(f"_e_{c}") for c in ENRICHMENT))
    said = lambda c: F.nullif(F.col(f"_e_{c}"), F.lit(""))
    shown = {
        "home_team": F.coalesce(said("home_team"), F.nullif(F.col("_home"), F.lit("")), F.lit("?")), "away_team": F.coalesce(said("away_team"), F.nullif(F.col("_away"), F.lit("")), F.lit("?")),
        "flag": F.coalesce("_e_flag", F.lit("")), "league_abbr": F.coalesce("_e_league_abbr", "_code"), "competition_code": F.coalesce("_e_competition_code", "_code"),
        "home_odds": F.col("_e_market_home_win_odds"), "draw_odds": F.col("_e_market_draw_odds"), "away_odds": F.col("_e_market_away_odds"), "season": F.lit(season),
    }
    kept = [c for c in rows.columns if not c.startswith("_")]
    return rows.join(e, "external_id", "left").select(*kept, *(c.alias(n) for n, c in shown.items()))


def standings(spark: SparkSession, path: str) -> DataFrame:
    """The table of each competition: its TOTAL block, or else its first."""
    blocks = spark.read.schema(STANDINGS_SCHEMA).option("multiLine", True).json(path).select(F.col("competition.code").alias("comp_id"), F.posexplode("standings").alias("at", "block"))
    w = Window.partitionBy("comp_id").orderBy((F.col("block.type") != "TOTAL").cast("int"), "at")
    best = blocks.withColumn("n", F.row_number().over(w)).filter("n = 1")
    return best.select("comp_id", F.inline("block.table")).select("comp_id", F.col("team.id").alias("team_id"), F.col("position"), F.col("points"))


def fresh_or(spark: SparkSession, loaders: list) -> DataFrame:
    """The first loader that gives rows: cache, live source, stale cache, sample."""
    for load in loaders:
        found = load()
        if found is not None and not found.isEmpty():
            return found
    raise ValueError("no source has rows")
