"""Detection of unknown team names: best-matching events, what is worth storing, and alias events."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import names
from ..session import stored as _stored
from .odds import BAND_MINUTES, first_in_band
from .resolve import in_scope

SOURCE = "odds_api"
LEAST, MOST = 0.35, 0.95
SIDES = ("home", "away")
FIRST_EVENTS = 20


def team_form(text: Column, stopwords: tuple[str, ...] = names.STOPWORDS_DETECT) -> Column:
    return names.without(names.normal(text), stopwords)


def known_forms(rows: DataFrame, aliases: DataFrame, prefix: str, stopwords: tuple[str, ...] = names.STOPWORDS_DETECT) -> DataFrame:
    """``rows`` with {prefix}{side} (normal form) and {prefix}{side}_set (with the canonical forms of aliases in scope).

    ``aliases``: alias_normalized, canonical_normalized, source_system, competition_code (null: everywhere).  Forms
    are found once for each name and competition and written: by the size of what is written Spark knows that a few
    names needn't be met by moving every row to its name, where all rows of a name land in one task.
    """
    named = rows.select(F.explode(F.array(*(f"{s}_team" for s in SIDES))).alias("name"), F.col("competition_code").alias("at_code")).distinct()
    known = aliases.select(F.col("alias_normalized").alias("form"), "canonical_normalized", F.col("source_system").alias("of_source"), F.col("competition_code").alias("of_code"))
    met = named.withColumn("form", team_form(F.col("name"), stopwords)).join(known, "form", "left")
    usable = in_scope(F.col("of_source"), F.lit(SOURCE)) & in_scope(F.col("of_code"), F.col("at_code"))
    both = F.array_union(F.collect_set("form"), F.collect_set(F.when(usable, F.col("canonical_normalized"))))
    sets = _stored(met.groupBy("name", "at_code").agg(F.first("form").alias("form"), F.array_sort(F.filter(both, lambda f: f != "")).alias("set")), "forms")
    for s in SIDES:
        mine = sets.select(F.col("name").alias("_name"), F.col("at_code").alias("_code"), F.col("form").alias(f"{prefix}{s}"), F.col("set").alias(f"{prefix}{s}_set"))
        rows = rows.join(mine, F.col(f"{s}_team").eqNullSafe(F.col("_name")) & F.col("competition_code").eqNullSafe(F.col("_code")), "left").drop("_name", "_code")
    return rows


#: Kinds of events that are tried first for a kind of match; the others only where none of these is surely in the band.
FIRST_KINDS = 64


def _kinds_in_reach(spots: DataFrame, pairs: DataFrame, there: DataFrame) -> DataFrame:
    """(mk, slot, ek, score, step): kinds of events that a kind of match is like and that have events in its range or the next."""
    step = F.explode(F.array(F.lit(-1), F.lit(0), F.lit(1))).alias("step")
    met = spots.join(pairs, "mk").select("mk", "slot", "ek", "score", step)
    return met.withColumn("at_slot", F.col("slot") + F.col("step")).join(there.withColumnRenamed("slot", "at_slot"), ["ek", "at_slot"]).drop("at_slot")


def _alike(m: DataFrame, e: DataFrame, group: list[str]) -> DataFrame:
    """(mk, ek, score) for kinds of matches and events with a similarity above 0: the mean of the sides', each of which is found once."""
    def names_of(df: DataFrame, p: str, key: str) -> DataFrame:
        x = F.explode(F.array(*(F.struct(F.col(f"{s}_k").alias(key), F.col(f"{p}{s}").alias(f"{p}form"), F.col(f"{p}{s}_set").alias(f"{p}set")) for s in SIDES)))
        one = df.select(*group, x.alias("x")).select(*group, "x.*").dropDuplicates([key])
        tag = lambda mark, keys: F.transform(keys, lambda k: F.concat(F.lit(mark), k))
        met = F.concat(tag("=", F.col(f"{p}set")), tag(":", F.flatten(F.transform(F.col(f"{p}set"), names.tokens))))
        return one.withColumn("meet", F.explode(F.array_distinct(met)))

    met = names_of(m, "db_", "m_k").join(names_of(e, "api_", "e_k").hint("merge"), [*group, "meet"]).dropDuplicates(["m_k", "e_k"])
    likest = F.array_max(F.transform(F.col("api_set"), lambda c: names.jaccard(F.col("db_form"), c)))
    score = F.when(F.arrays_overlap("db_set", "api_set"), 1.0).otherwise(F.coalesce(likest, F.lit(0.0)))
    sides = met.select("m_k", "e_k", score.alias("score")).filter("score > 0")
    kinds = lambda df, k: df.select(k, *(f"{s}_k" for s in SIDES)).distinct()
    mine, theirs = kinds(m, "mk"), kinds(e, "ek")
    by_side = [mine.select("mk", F.col(f"{s}_k").alias("m_k")).join(sides, "m_k").join(theirs.select("ek", F.col(f"{s}_k").alias("e_k")), "e_k").select("mk", "ek", "score") for s in SIDES]
    return by_side[0].unionByName(by_side[1]).groupBy("mk", "ek").agg(F.bround(F.sum("score") / 2, 4).alias("score")).filter("score > 0")


def best_events(matches: DataFrame, events: DataFrame, aliases: DataFrame, minutes: int = BAND_MINUTES) -> DataFrame:
    """Each match's event with the largest mean name similarity within the band, the first of equals; none where all are 0.

    ``matches``: match_id, sport_key, competition_code, kickoff_at, home_team, away_team; ``events``: event_id,
    sport_key, kickoff_at (null: unknown, passes), home_team, away_team.  Rows of equal names are one kind; kinds
    meet by a shared word or form of a side, without which the similarity is 0, and are compared once.  A kind's event
    in a match's own range of the band's width is surely within the band, so no worse kind is looked up there.
    """
    width = minutes * 60_000_000
    slot = lambda c: F.floor(c / F.lit(width)).cast("long")
    group = ["sport_key", "competition_code"]
    matches, events = (df.withColumn("kickoff_at", F.col("kickoff_at").cast("timestamp")) for df in (matches, events))
    codes = matches.select(*group).distinct()
    named = lambda df, p: df.withColumns({f"{s}_k": F.md5(F.to_json(F.struct(*group, f"{p}{s}", f"{p}{s}_set"))) for s in SIDES})
    key = F.md5(F.concat(*(f"{s}_k" for s in SIDES)))
    e = named(known_forms(events.join(codes, "sport_key"), aliases, "api_"), "api_").withColumns({"ek": key, "at": F.unix_micros("kickoff_at")})
    m = named(known_forms(matches, aliases, "db_"), "db_").withColumns({"mk": key, "at": F.unix_micros("kickoff_at")})
    m, e = _stored(m, "matches"), _stored(e, "events")  # one plan of all steps takes minutes to make
    pairs = _alike(m, e, group)
    pairs = _stored(pairs.withColumn("nth", F.row_number().over(Window.partitionBy("mk").orderBy(F.desc("score"), "ek"))), "kinds")

    points = m.select("mk", "at").distinct()
    timed, untimed = e.filter("at IS NOT NULL").select("ek", "at", "event_id"), e.filter("at IS NULL").groupBy("ek").agg(F.min("event_id").alias("event_id"))
    choice = F.struct("score", (-F.col("event_id")).alias("less"))
    always = pairs.join(untimed, "ek").groupBy("mk").agg(F.max(choice).alias("best"))
    there, spots = timed.select("ek", slot(F.col("at")).alias("slot")).distinct(), points.filter("at IS NOT NULL").select("mk", slot(F.col("at")).alias("slot")).distinct()
    near = _kinds_in_reach(spots, pairs.filter(F.col("nth") <= FIRST_KINDS), there)
    sure = near.filter("step = 0").select("mk", "slot").distinct()
    far = _kinds_in_reach(spots.join(sure, ["mk", "slot"], "left_anti"), pairs.filter(F.col("nth") > FIRST_KINDS), there)
    reach = near.unionByName(far)
    least = reach.groupBy("mk", "slot").agg(F.max(F.when(F.col("step") == 0, F.col("score"))).alias("least"))
    tried = reach.join(least, ["mk", "slot"]).filter(F.coalesce(F.col("score") >= F.col("least"), F.lit(True))).select("mk", "slot", "ek", "score").distinct()
    asked = points.withColumn("slot", slot(F.col("at"))).join(tried, ["mk", "slot"]).select("mk", "ek", "at", "score")
    asked = _stored(asked, "asked")
    found = first_in_band(asked, timed, ["ek"], "mk", minutes).select("mk", "at", choice.alias("best"))
    best = found.unionByName(points.join(always, "mk").select("mk", "at", "best")).groupBy("mk", "at").agg(F.max("best").alias("best"))
    best = best.select(F.col("mk").alias("_mk"), F.col("at").alias("_at"), (-F.col("best.less")).alias("event_id"), "best.score")
    chosen = m.join(best.hint("merge"), (F.col("mk") == F.col("_mk")) & F.col("at").eqNullSafe(F.col("_at")))
    given = e.select("event_id", "competition_code", F.col("home_team").alias("api_home_team"), F.col("away_team").alias("api_away_team"), "api_home", "api_away", F.col("kickoff_at").alias("api_at"))
    out = chosen.join(given.hint("merge"), ["event_id", "competition_code"])
    return out.select(*matches.columns, "db_home", "db_away", *given.columns[:1], *given.columns[2:], "score")


def worth_storing() -> Column:
    """Names known on both sides that differ by more than spelling, alike but not sure."""
    same = (F.col("db_home") == F.col("api_home")) & (F.col("db_away") == F.col("api_away"))
    cosmetic = names.trivial_difference(F.col("db_home"), F.col("api_home")) & names.trivial_difference(F.col("db_away"), F.col("api_away"))
    return (F.col("api_home") != "") & (F.col("api_away") != "") & ~same & ~cosmetic & (F.col("score") >= LEAST) & (F.col("score") < MOST)


def stored(best: DataFrame) -> DataFrame:
    """Candidates worth storing, each with its key."""
    key = names.dedup_key(*(F.col(c) for c in ("match_id", "home_team", "away_team", "api_home_team", "api_away_team")))
    return best.filter(worth_storing()).withColumn("dedup_key", key)


def _unknown(rows: DataFrame, aliases: DataFrame, stopwords: tuple[str, ...] = names.STOPWORDS_DETECT) -> DataFrame:
    """One row for each unknown name of a side and competition; of several the last in ``order``."""
    sides = F.explode(F.array(*(F.struct(F.lit(s).alias("side"), F.col(f"api_{s}_team").alias("raw_name"), team_form(F.col(f"api_{s}_team"), stopwords).alias("raw_normalized")) for s in SIDES)))
    long = rows.withColumn("x", sides).select(*rows.columns, "x.*").filter("raw_normalized <> ''")
    new = long.join(aliases.select(F.col("alias_normalized").alias("raw_normalized")).distinct(), "raw_normalized", "left_anti")
    last = F.max_by(F.struct("raw_name", "context"), F.col("order"))
    out = new.groupBy("competition_code", "raw_normalized", "side").agg(last.alias("l"))
    return out.select(F.lit(SOURCE).alias("source_system"), "competition_code", "l.raw_name", "raw_normalized", "side", "l.context", F.lit("new").alias("status"))


def alias_events(candidates: DataFrame, aliases: DataFrame) -> DataFrame:
    """Alias events of stored candidates, by kickoff and match."""
    context = F.to_json(F.struct("match_id", F.col("home_team").alias("db_home_team"), F.col("away_team").alias("db_away_team"), "api_home_team", "api_away_team", F.col("api_at").alias("api_commence_time"), F.col("score").alias("candidate_score"), "sport_key"))
    return _unknown(candidates.withColumns({"context": context, "order": F.struct("kickoff_at", "match_id")}), aliases)


def unmatched_alias_events(unmatched: DataFrame, events: DataFrame, aliases: DataFrame, first: int = FIRST_EVENTS) -> DataFrame:
    """Alias events for the first events of each sport in which a match found no event.

    A name's row comes from its competition's last unmatched match, so matches aren't paired with events.
    """
    last = unmatched.groupBy("sport_key", "competition_code").agg(F.max_by(F.struct("home_team", "away_team", "kickoff_at", "match_id"), F.struct("kickoff_at", "match_id")).alias("m"))
    # Spark limits the ranks of a key before it shuffles
    w = Window.partitionBy("sport_key").orderBy("event_id")
    firsts = events.withColumn("nth", F.row_number().over(w)).filter(F.col("nth") <= first)
    rows = last.join(firsts, "sport_key").select("sport_key", "competition_code", F.col("m.home_team").alias("db_home_team"), F.col("m.away_team").alias("db_away_team"), F.col("home_team").alias("api_home_team"), F.col("away_team").alias("api_away_team"), F.col("kickoff_at").alias("api_commence_time"), F.col("event_id").alias("order"))
    context = F.to_json(F.struct(F.col("competition_code").alias("match_competition_code"), "db_home_team", "db_away_team", "api_home_team", "api_away_team", "api_commence_time", "sport_key"))
    return _unknown(rows.withColumn("context", context), aliases, names.STOPWORDS_MATCH)
