"""Bookmaker odds: flattening, consensus, de-vigging and matching of events."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.probs import fair

LEAST_ODDS = 1.01
BAND_MINUTES = 180

EVENT_SCHEMA = """id string, sport_key string, commence_time string, home_team string, away_team string,
  bookmakers array<struct<key:string, title:string, last_update:string,
    markets:array<struct<key:string, outcomes:array<struct<name:string, price:double>>>>>>"""


def valid(odds: Column) -> Column:
    return F.coalesce(odds.try_cast("double") > LEAST_ODDS, F.lit(False))


def flatten(events: DataFrame) -> DataFrame:
    """One row for each event and bookmaker whose last head-to-head prices of all three sides are valid odds."""
    o = F.col("outcome")
    name = F.trim(o["name"])
    side = F.when(name == F.col("home_team"), "home").when(name == F.col("away_team"), "away").when(F.lower(name) == "draw", "draw")
    rows = (
        events.select("id", "sport_key", "home_team", "away_team", F.explode("bookmakers").alias("b"))
        .select("id", "sport_key", "home_team", "away_team", F.col("b.key").alias("bookmaker_key"), F.col("b.title").alias("bookmaker_name"), F.col("b.last_update").alias("last_update"), F.posexplode("b.markets").alias("m_at", "m"))
        .filter(F.col("m.key") == "h2h")
        .select("*", F.posexplode("m.outcomes").alias("o_at", "outcome"))
        .withColumn("side", side).filter(F.col("side").isNotNull() & o["price"].isNotNull())
    )
    last = lambda s: F.max_by(F.when(F.col("side") == s, o["price"]), F.when(F.col("side") == s, F.struct("m_at", "o_at")))
    wide = rows.groupBy("id", "sport_key", "home_team", "away_team", "bookmaker_key", "bookmaker_name", "last_update").agg(*(last(s).alias(f"{s}_odds") for s in ("home", "draw", "away")))
    return wide.filter(valid(F.col("home_odds")) & valid(F.col("draw_odds")) & valid(F.col("away_odds")))


def extract(matches: DataFrame, events: DataFrame, at: str, minutes: int = BAND_MINUTES) -> tuple[DataFrame, DataFrame]:
    """(snapshots of matched events, matches without an event).

    ``matches`` as for ``match_events``; ``events`` also with id, sport_key, home_team, away_team and bookmakers.
    """
    met = match_events(matches, events, minutes)
    prices = flatten(events.select(F.col("event_id").alias("id"), "sport_key", "home_team", "away_team", "bookmakers"))
    rows = met.join(prices, met["event_id"] == prices["id"]).select("match_id", "bookmaker_key", "bookmaker_name", F.lit("1x2").alias("market_type"), F.lit("ft").alias("period"), F.lit(at).cast("timestamp_ntz").alias("snapshot_ts"), "last_update", "home_odds", "draw_odds", "away_odds")
    return rows, matches.join(met, "match_id", "left_anti")


def latest(snapshots: DataFrame) -> DataFrame:
    """The last snapshot of each match and bookmaker; by time, then sequence."""
    o = ("home_odds", "draw_odds", "away_odds")
    return snapshots.groupBy("match_id", "bookmaker_id").agg(F.max_by(F.struct(*o), F.struct("snapshot_ts", "seq", *o)).alias("s")).select("match_id", "bookmaker_id", "s.*")


def consensus(snapshots: DataFrame) -> DataFrame:
    """Median odds over the bookmakers' latest snapshots and how many bookmakers there are."""
    return latest(snapshots).groupBy("match_id").agg(*(F.median(f"{s}_odds").alias(f"median_{s}_odds") for s in ("home", "draw", "away")), F.countDistinct("bookmaker_id").alias("bookmaker_count"))


def devig(matches: DataFrame) -> DataFrame:
    """Fair probabilities and margin, six digits."""
    p, margin = fair((F.col("home_odds"), F.col("draw_odds"), F.col("away_odds")))
    return matches.select("match_id", *(F.bround(x, 6).alias(f"fair_{s}") for s, x in zip(("home", "draw", "away"), p, strict=True)), F.bround(margin, 6).alias("overround"))


def close(a: Column, b: Column, minutes: int = BAND_MINUTES) -> Column:
    """Kickoffs within a band; an unknown right side passes."""
    return b.isNull() | (F.abs(F.unix_micros(a) - F.unix_micros(b)) <= minutes * 60_000_000)


def first_in_band(asked: DataFrame, given: DataFrame, keys: list[str], asked_id: str, minutes: int = BAND_MINUTES) -> DataFrame:
    """(the columns of ``asked``, event_id): the smallest event_id of the same keys within the band, where there is one.

    ``asked``: keys, asked_id, at (micros or null); ``given``: keys, at (micros or null: always within), event_id.  A
    band covers the whole range of its width that it starts from, the end of the one before and the start of the one
    after; smallest ids up to and from each point of a range are running ones, so rows are sorted, never paired.
    Numbers come before the keys in what is sorted: times differ where keys, which are texts, are mostly alike.
    """
    width = minutes * 60_000_000
    slot = lambda c: F.floor(c / F.lit(width)).cast("long")
    events = given.groupBy(*keys, "at").agg(F.min("event_id").alias("event_id"))
    at = F.col("at")
    timed = events.filter("at IS NOT NULL").select(*keys, slot(at).alias("slot"), "at", F.lit(None).cast("int").alias("part"), F.lit(None).cast("long").alias("from"), "event_id")
    points = asked.filter("at IS NOT NULL").select(*keys, at).distinct()
    ends = F.array(*(F.struct((slot(at) + d).cast("long").alias("slot"), (at + d * F.lit(width)).cast("long").alias("at"), F.lit(d).alias("part")) for d in (-1, 0, 1)))
    looks = points.select(*keys, at.alias("from"), F.explode(ends).alias("e")).select(*keys, "e.slot", "e.at", "e.part", "from", F.lit(None).cast("long").alias("event_id"))
    range_of = Window.partitionBy("slot", *keys)
    up_to = range_of.orderBy("at").rangeBetween(Window.unboundedPreceding, 0)
    whole = range_of.orderBy("at").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)  # shares the order of the one before
    on = range_of.orderBy(F.desc("at")).rangeBetween(Window.unboundedPreceding, 0)
    least = lambda w: F.min("event_id").over(w)
    both = timed.unionByName(looks).withColumns({"_to": least(up_to), "_on": least(on), "_all": least(whole)})
    seen = both.filter("part IS NOT NULL").withColumn("event_id", F.when(F.col("part") == 1, F.col("_to")).when(F.col("part") == -1, F.col("_on")).otherwise(F.col("_all")))
    found = seen.groupBy(F.col("from").alias("at"), *keys).agg(F.min("event_id").alias("_in"))
    always = events.filter("at IS NULL").select(*keys, F.col("event_id").alias("_any"))
    null_safe = lambda left, right: left.join(right.hint("merge"), ["at", *keys], "left")
    out = null_safe(asked, found).join(always, keys, "left")
    return out.withColumn("event_id", F.least("_in", "_any")).filter("event_id IS NOT NULL").select(asked_id, *(c for c in asked.columns if c != asked_id), "event_id")


def match_events(matches: DataFrame, events: DataFrame, minutes: int = BAND_MINUTES) -> DataFrame:
    """Each match's first event, in the events' order, that shares its league and a name of either side, within the band.

    Both sides are candidate arrays (home_names, away_names).  Rows meet by league and a pair of names; the first
    event within the band is looked up, not sought among all that meet.
    """
    at = F.unix_micros("kickoff_at").alias("at")
    pairs = lambda df, key: df.select(key, "league", at, F.explode(F.array_distinct("home_names")).alias("home"), "away_names").select(key, "league", "at", "home", F.explode(F.array_distinct("away_names")).alias("away"))
    found = first_in_band(pairs(matches, "match_id"), pairs(events, "event_id"), ["league", "home", "away"], "match_id", minutes)
    return found.groupBy("match_id").agg(F.min("event_id").alias("event_id"))


def newest_first(rows: DataFrame, keys: list[str], order: str, n: int) -> DataFrame:
    """The ``n`` newest rows of each key."""
    w = Window.partitionBy(*keys).orderBy(F.desc(order))
    return rows.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= n)
