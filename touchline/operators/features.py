"""Features of a match from each team's strictly earlier matches.

A team's matches are numbered in kickoff order, running sums give its state after each, and a match takes
the state of the largest number among the strictly earlier ones: a running maximum, so nothing at the
same kickoff leaks in and no array grows with the history.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.probs import clamp

LAST, LAST_VENUE, LAST_FORM = 10, 6, 5


def team_rows(matches: DataFrame) -> DataFrame:
    """Two rows for each match, one for each team; has_result tells whether it is history."""
    def side(team: str, own: str, other: str, home: bool) -> DataFrame:
        return matches.select("match_id", F.col("kickoff_at").cast("timestamp").alias("kickoff_at"), F.col(team).alias("team_id"), F.lit(home).alias("is_home"), F.col(own).alias("gf"), F.col(other).alias("ga"))

    rows = side("home_team_id", "home_goals", "away_goals", True).unionByName(side("away_team_id", "away_goals", "home_goals", False))
    # id 0 counts as missing
    return rows.filter(F.col("team_id") != 0).withColumns({
        "micros": F.unix_micros("kickoff_at"),
        "has_result": F.col("gf").isNotNull() & F.col("ga").isNotNull() & F.col("kickoff_at").isNotNull(),
        "symbol": F.when(F.col("gf") > F.col("ga"), "W").when(F.col("gf") == F.col("ga"), "D").when(F.col("gf") < F.col("ga"), "L"),
    })


def strength(n: Column, pts: Column, gd: Column) -> Column:
    """0 to 100 from points and goal difference of the last matches; null below three."""
    goals = clamp(gd / n, -3.0, 3.0)
    raw = 0.7 * (pts / n) / 3 + 0.3 * (goals + 3) / 6
    return F.when(n >= 3, clamp(F.bround(100 * raw, 1), 0.0, 100.0))


def form_share(form: Column, empty: float | None = 0.5) -> Column:
    """Points share of a string of W, D and L."""
    n = F.length(form)
    won, drawn = n - F.length(F.replace(form, F.lit("W"), F.lit(""))), n - F.length(F.replace(form, F.lit("D"), F.lit("")))
    return F.when(F.coalesce(n, F.lit(0)) == 0, F.lit(empty)).otherwise((3 * won + drawn) / (3 * n))


def _whole_history(rows: DataFrame) -> DataFrame:
    """The state of matches without a kickoff: all their teams' matches with a result count, their own too, those without a kickoff as the oldest."""
    played = F.col("gf").isNotNull() & F.col("ga").isNotNull()
    pts = F.when(F.col("symbol") == "W", 3).when(F.col("symbol") == "D", 1).otherwise(0)
    newest = [F.desc_nulls_last("kickoff_at"), "match_id"]
    nth = lambda *keys: F.row_number().over(Window.partitionBy(*keys).orderBy(*newest))
    done = rows.filter(played).select("team_id", "is_home", "symbol", pts.alias("pts"), (F.col("gf") - F.col("ga")).cast("long").alias("gd"), nth("team_id").alias("nth"), nth("team_id", "is_home").alias("nth_venue"))
    last = lambda c, n, at="nth": F.sum(F.when(F.col(at) <= n, c))
    signs = F.array_sort(F.collect_list(F.when(F.col("nth") <= LAST_FORM, F.struct("nth", "symbol"))))
    state = done.groupBy("team_id").agg(
        F.count("*").cast("int").alias("n_prior"), last(F.lit(1), LAST).alias("n"), last(F.col("pts"), LAST).alias("s_pts"), last(F.col("gd"), LAST).alias("s_gd"), F.array_join(F.transform(signs, lambda x: x["symbol"]), "").alias("form"),
    )
    at_venue = done.groupBy("team_id", "is_home").agg(F.count("*").cast("int").alias("n_prior_venue"), *(last(c, LAST_VENUE, "nth_venue").alias(n) for c, n in ((F.lit(1), "v_n"), (F.col("pts"), "v_pts"), (F.col("gd"), "v_gd"))))
    asked = rows.filter("kickoff_at IS NULL").select("match_id", "team_id", "is_home", "kickoff_at")
    found = asked.join(state, "team_id", "left").join(at_venue, ["team_id", "is_home"], "left")
    return found.withColumns({"n_prior": F.coalesce("n_prior", F.lit(0)), "n_prior_venue": F.coalesce("n_prior_venue", F.lit(0)), "oldest": F.lit(None).cast("timestamp")})


def team_state(matches: DataFrame, undated: bool = False) -> DataFrame:
    """(match_id, is_home) with the team's prior strength, venue strength, blend, form and counts.

    A match without a kickoff has no earlier matches; with ``undated`` the whole history of its teams counts.
    """
    rows = team_rows(matches)
    pts = F.when(F.col("symbol") == "W", 3).when(F.col("symbol") == "D", 1).otherwise(0)
    gd = (F.col("gf") - F.col("ga")).cast("long")
    # matches without a result are parts of their own, so that they don't count among the last ones; all windows lie within a team's rows, dealt out once
    team = Window.partitionBy("team_id", "has_result").orderBy("kickoff_at", F.desc("match_id"))
    venue = Window.partitionBy("team_id", "is_home", "has_result").orderBy("kickoff_at", F.desc("match_id"))
    back = lambda w, n: w.rowsBetween(1 - n, 0)
    state = F.struct(
        F.row_number().over(team).alias("n_prior"),
        F.count("*").over(back(team, LAST)).alias("n"),
        F.sum("pts").over(back(team, LAST)).alias("s_pts"),
        F.sum("gd").over(back(team, LAST)).alias("s_gd"),
        F.min("kickoff_at").over(back(team, LAST)).alias("oldest"),
        F.reverse(F.array_join(F.collect_list("symbol").over(back(team, LAST_FORM)), "")).alias("form"),
    )
    at_venue = F.struct(
        F.row_number().over(venue).alias("n_prior_venue"),
        F.count("*").over(back(venue, LAST_VENUE)).alias("v_n"),
        F.sum("pts").over(back(venue, LAST_VENUE)).alias("v_pts"),
        F.sum("gd").over(back(venue, LAST_VENUE)).alias("v_gd"),
    )
    earlier = lambda *keys: Window.partitionBy(*keys).orderBy("micros").rangeBetween(Window.unboundedPreceding, -1)
    dealt = rows.withColumns({"pts": pts, "gd": gd}).repartition("team_id").withColumns({"after": state, "after_venue": at_venue})
    # the last state is the one of the largest number, which leads the struct
    last = lambda c, *keys: F.max(F.when(F.col("has_result"), F.col(c))).over(earlier(*keys))
    asked = dealt.select("match_id", "team_id", "is_home", "kickoff_at", last("after", "team_id").alias("s"), last("after_venue", "team_id", "is_home").alias("v"))
    found = asked.select("match_id", "team_id", "is_home", "kickoff_at", "s.*", "v.*").withColumns({c: F.coalesce(c, F.lit(0)) for c in ("n_prior", "n_prior_venue")})
    if undated:
        whole = _whole_history(rows)
        found = found.filter("kickoff_at IS NOT NULL").select(*whole.columns).unionByName(whole)
    general, special = strength(F.col("n"), F.col("s_pts"), F.col("s_gd")), strength(F.col("v_n"), F.col("v_pts"), F.col("v_gd"))
    return found.select(
        "match_id", "is_home", "n_prior", "n_prior_venue",
        general.alias("general"), special.alias("venue"),
        F.when(special.isNull(), general).otherwise(F.bround(0.6 * general + 0.4 * special, 1)).alias("strength"),
        F.coalesce("form", F.lit("")).alias("form"),
        F.coalesce(F.year("oldest") < F.year("kickoff_at"), F.lit(False)).alias("crosses_year"),
    )


def with_features(matches: DataFrame, undated: bool = False) -> DataFrame:
    """``matches`` with home_ and away_ strength, form and counts of earlier matches, and win_probability."""
    state = team_state(matches, undated)
    columns = ("n_prior", "n_prior_venue", "strength", "venue", "form", "crosses_year")

    # both sides in one row: the states are worked out once, and matches are joined once
    of = lambda name, home: [F.max(F.when(F.col("is_home") == home, F.col(c))).alias(f"{name}_{c}") for c in columns]
    both = state.groupBy("match_id").agg(*of("home", True), *of("away", False))
    out = matches.join(both.hint("merge"), "match_id", "left")  # sent whole, the few files of matches would bound the models' tasks
    gap = F.col("home_strength") - F.col("away_strength")
    return out.withColumn("win_probability", F.coalesce(clamp(F.bround(50 + 0.6 * gap), 5.0, 95.0), F.lit(50.0)).cast("int"))


def coverage(featured: DataFrame) -> DataFrame:
    """How many matches have which features."""
    n = lambda c: F.count(F.when(c, 1))
    both = F.col("home_strength").isNotNull() & F.col("away_strength").isNotNull()
    return featured.agg(
        F.count("*").alias("n_matches"),
        n(both).alias("with_strength"),
        n((F.col("home_form") != "") & (F.col("away_form") != "")).alias("with_form"),
        n(~both).alias("fallback"),
        n(F.col("home_venue").isNotNull() & F.col("away_venue").isNotNull()).alias("with_venue"),
        n(F.col("home_crosses_year") | F.col("away_crosses_year")).alias("cross_season"),
    )
