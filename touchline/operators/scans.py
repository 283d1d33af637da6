"""Selections over time and keys that feed the jobs: windows, mapped matches, pending events, seasons, recent form."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

FORM, NO_STRENGTH = 5, 50


def between(at: str, start: str, end: str, open_ended: bool = False) -> Column:
    """``at`` in [start, end); with ``open_ended`` an unknown time passes too."""
    inside = (F.col(at) >= F.lit(start).cast("timestamp_ntz")) & (F.col(at) < F.lit(end).cast("timestamp_ntz"))
    return F.coalesce(inside, F.lit(open_ended))


def upcoming(rows: DataFrame, as_of: str, days: int, back_hours: int = 0, at: str = "kickoff_at", dirty: DataFrame | None = None, key: str = "match_id", closed: bool = False) -> DataFrame:
    """Rows from ``back_hours`` before to ``days`` after the given time, only those in ``dirty`` if there is one.

    ``closed`` takes the last moment in, as the look-ahead for odds does; that for predictions leaves it out.
    """
    now = F.lit(as_of).cast("timestamp_ntz")
    low, high = now - F.make_dt_interval(hours=F.lit(back_hours)), now + F.make_dt_interval(days=F.lit(days))
    out = rows.filter((F.col(at) >= low) & ((F.col(at) <= high) if closed else (F.col(at) < high)))
    return out if dirty is None else out.join(dirty.select(key), key, "left_semi")


def not_past(rows: DataFrame, as_of: str, at: str = "kickoff_at") -> DataFrame:
    """Rows later than the given time or of unknown time."""
    return rows.filter(F.col(at).isNull() | (F.col(at) > F.lit(as_of).cast("timestamp_ntz")))


def active_map(mappings: DataFrame, source: str) -> DataFrame:
    """(competition_code, external_code): the active mapping of a source; of several of a code the last one's."""
    mine = mappings.filter((F.col("source_system") == source) & F.col("is_active"))
    return mine.groupBy("competition_code").agg(F.max_by("external_code", "updated_at").alias("external_code"))


def mapped(rows: DataFrame, mapping: DataFrame) -> DataFrame:
    """Rows whose competition has an external code, with it."""
    return rows.join(mapping, "competition_code")


def unresolved(rows: DataFrame, mapping: DataFrame) -> DataFrame:
    """Competitions of rows that have no external code, and how many rows each has."""
    return rows.join(mapping, "competition_code", "left_anti").groupBy("competition_code").agg(F.count("*").alias("n_matches"))


def unresolved_list(rows: DataFrame, mapping: DataFrame, columns: tuple[str, ...] = ("competition_code", "competition_name", "country")) -> DataFrame:
    """The distinct competitions of rows without an external code, by all their columns, to warn of."""
    return rows.join(mapping, "competition_code", "left_anti").select(*columns).distinct()


def pending(events: DataFrame, n: int, status: str = "new") -> DataFrame:
    """The ``n`` oldest events of a status; the batch size is what this selection is for."""
    return events.filter(F.col("status") == status).orderBy("created_at", "event_id").limit(n)


def enriched(rows: DataFrame, extra: DataFrame, key: str, defaults: dict[str, object]) -> DataFrame:
    """Rows with the columns of ``extra`` where it has the key; a null or missing value takes its default."""
    e = extra.dropDuplicates([key]).select(key, *defaults)
    out = rows.join(e, key, "left")
    return out.withColumns({c: F.coalesce(c, F.lit(d)) for c, d in defaults.items() if d is not None})


def recent_form(matches: DataFrame, n: int = FORM) -> DataFrame:
    """(team_id, form, strength) from each team's last ``n`` matches with a score, newest first.

    The strength is the share of points won, 0 to 100.
    """
    sign = lambda a, b: F.when(F.col(a) > F.col(b), "W").when(F.col(a) == F.col(b), "D").otherwise("L")
    played = matches.filter("home_goals IS NOT NULL AND away_goals IS NOT NULL")
    sides = F.array(F.struct(F.col("home_team_id").alias("team_id"), sign("home_goals", "away_goals").alias("sign")), F.struct(F.col("away_team_id").alias("team_id"), sign("away_goals", "home_goals").alias("sign")))
    long = played.select("match_id", "kickoff_at", F.inline(sides))
    w = Window.partitionBy("team_id").orderBy(F.desc_nulls_last("kickoff_at"), "match_id")
    last = long.withColumn("nth", F.row_number().over(w)).filter(F.col("nth") <= n)
    points = F.sum(F.when(F.col("sign") == "W", 3).when(F.col("sign") == "D", 1).otherwise(0))
    form = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("nth", "sign"))), lambda x: x["sign"]), "")
    return last.groupBy("team_id").agg(form.alias("form"), F.bround(points / (F.count("*") * 3) * 100).cast("int").alias("strength"))


def with_strengths(matches: DataFrame, strengths: DataFrame, forms: DataFrame) -> DataFrame:
    """Both sides' strength (from the table, else from recent matches, else 50) and form; unknown teams 50 and none."""
    teams = forms.select("team_id", "form", F.col("strength").alias("by_form")).join(strengths.select("team_id", "strength"), "team_id", "full_outer")
    teams = teams.select("team_id", F.coalesce("strength", "by_form").alias("strength"), "form")
    for side in ("home", "away"):
        t = teams.select(F.col("team_id").alias(f"{side}_team_id"), F.col("strength").alias(f"{side}_strength"), F.col("form").alias(f"form_{side}"))
        matches = matches.join(t, f"{side}_team_id", "left").withColumns({f"{side}_strength": F.coalesce(f"{side}_strength", F.lit(NO_STRENGTH)), f"form_{side}": F.coalesce(f"form_{side}", F.lit(""))})
    return matches


def teams_by_competition(matches: DataFrame) -> DataFrame:
    """Team ids seen in each competition."""
    return matches.select("competition_code", F.explode(F.array("home_team_id", "away_team_id")).alias("team_id")).filter("team_id IS NOT NULL").distinct()


def season_year(text: Column) -> Column:
    """The first year of a season written 2024/25, 2024 or 24/25; null if there is none."""
    part = F.trim(F.split(text, "/")[0])
    year = F.when(F.length(part) == 2, F.concat(F.lit("20"), part)).otherwise(part)
    return F.when(year.rlike("^[0-9]+$"), year)


def previous_year(year: Column) -> Column:
    return F.when(year.rlike("^[0-9]+$"), (year.cast("long") - 1).cast("string"))


def seasons(current: DataFrame, previous: DataFrame) -> DataFrame:
    """Both seasons' matches with ``is_current``; a match of both counts as current.  Features see all, reports those."""
    earlier = previous.join(current.select("match_id"), "match_id", "left_anti")
    return current.withColumn("is_current", F.lit(True)).unionByName(earlier.withColumn("is_current", F.lit(False)))


def not_yet_there(persisted: DataFrame, local: DataFrame, keys: list[str]) -> DataFrame:
    """Local rows and those persisted ones that aren't among them."""
    return local.unionByName(persisted.join(local.select(*keys).distinct(), keys, "left_anti"))
