"""Resolution of raw names to teams: candidates, decisions and their effects."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import names
from ..session import stored
from . import merge

LEAST_SCORE, KEEP = 0.45, 5
ALIAS_WEIGHTS, TEAM_WEIGHTS, COMPETITION_WEIGHTS = (0.85, 0.90, 0.75), (0.80, 0.88, 0.70), (0.85, 0.92, 0.75)


def in_scope(alias_value: Column, event_value: Column) -> Column:
    """A null in the alias applies everywhere."""
    return alias_value.isNull() | (alias_value == event_value)


def meeting(form: Column, event: bool) -> Column:
    """Keys by which names meet that can be alike: a shared word, or, where one may hold the other, the shorter's
    first three letters among the longer's runs of three."""
    words = F.transform(F.filter(F.split(form, " "), lambda w: w != ""), lambda w: F.concat(F.lit("="), w))
    runs = lambda n: F.transform(F.sequence(F.lit(1), F.greatest(F.length(form) - (n - 1), F.lit(1))), lambda i: F.substring(form, i, F.lit(n)))
    # names of less than three letters can only lie in names of four at most, if they are to be alike
    grams = F.concat(runs(3), F.when(F.length(form) <= 4, F.concat(runs(1), runs(2))).otherwise(F.array().cast("array<string>")))
    lead = F.array(F.substring(form, 1, 3))
    marked = lambda mark, keys: F.transform(keys, lambda k: F.concat(F.lit(mark), k))
    return F.when(form == "", F.array().cast("array<string>")).otherwise(F.array_distinct(F.concat(words, marked("<", lead if event else grams), marked(">", grams if event else lead))))


def scored(events: DataFrame, known: DataFrame, exact: float, weights: tuple[float, float, float], least: float) -> DataFrame:
    """(event_id, scope columns of both, team_id, score) for events (raw) and known names (form) that are alike.

    Two forms are compared once, however many rows bear them.
    """
    raws, forms = events.select("raw").distinct(), known.select("form").distinct()
    # sizes are guessed before names are taken apart, so neither side may be sent whole to every task
    met = raws.withColumn("piece", F.explode(meeting(F.col("raw"), True))).join(forms.withColumn("piece", F.explode(meeting(F.col("form"), False))).hint("merge"), "piece")
    ratio = F.least(F.length("raw"), F.length("form")) / F.greatest(F.length("raw"), F.length("form"))
    pairs = met.filter(F.col("piece").startswith("=") | (ratio * weights[1] >= least)).select("raw", "form").distinct()
    alike = pairs.withColumn("score", names.similarity(F.col("raw"), F.col("form"), exact, weights)).filter(F.col("score") >= least)
    return events.join(alike.join(known.hint("merge"), "form").hint("merge"), "raw")


def reasons(raw: Column, form: Column, kind: str, exact: str, via: Column) -> Column:
    """What a score rests on, as texts: an exact match or each measure above 0, and by which name."""
    parts = (("jaccard", names.jaccard), ("substring", names.substring), ("prefix", names.prefix))
    said = F.array_compact(F.array(*(F.when(f(raw, form) > 0, F.concat(F.lit(f"{kind}_{n}="), F.format_string("%.3f", f(raw, form).cast("double")))) for n, f in parts)))
    return F.concat(F.when(raw == form, F.array(F.lit(exact))).otherwise(said), F.array(via))


NAME = ("raw_name", "event_source_system", "event_competition_code")


def _named(events: DataFrame, stopwords: tuple[str, ...]) -> tuple[DataFrame, DataFrame]:
    """Events with what their candidates depend on (the name and its scope), and the first event of each with the normal form.

    Normal forms are written: Spark would leave out the grouping where only the forms are asked for, and work them out for every event.
    """
    scope = ((F.col(c) if c in events.columns else F.lit(None).cast("string")).alias(f"event_{c}") for c in ("source_system", "competition_code"))
    named = events.select("event_id", "raw_name", *scope)
    first = named.groupBy(*NAME).agg(F.min("event_id").alias("event_id"))
    return named, stored(first.withColumn("raw", names.without(names.normal(F.col("raw_name")), stopwords)), "raw-names")


def _of_every_event(rows: DataFrame, first: DataFrame, named: DataFrame) -> DataFrame:
    """``rows`` of the first event of each name and scope, repeated for all events of that name and scope."""
    known = rows.withColumnRenamed("event_id", "first_id").join(first.select(F.col("event_id").alias("first_id"), *(F.col(c).alias(f"of_{c}") for c in NAME)).hint("merge"), "first_id")
    same = reduce(lambda a, b: a & b, (F.col(c).eqNullSafe(F.col(f"of_{c}")) for c in NAME))
    return named.join(known.hint("merge"), same).select("event_id", *(c for c in rows.columns if c != "event_id"))


def candidates(events: DataFrame, teams: DataFrame, stopwords: tuple[str, ...] = names.STOPWORDS_RESOLVE, weights: tuple[float, float, float] = TEAM_WEIGHTS, exact: float = 0.98, least: float = LEAST_SCORE, keep: int = KEEP, aliases: DataFrame | None = None, explain: bool = False) -> DataFrame:
    """The best teams of each event by name similarity: (event_id, team_id, canonical_name, score, rank).

    ``aliases`` (team_id, alias, source_system, competition_code) are scored too, those whose scope is the
    event's or open; a team has its best score, by an alias where its canonical name is no better.  No pair that
    can reach ``least`` is left out.  ``explain`` adds matched_via and reason_bits.
    """
    named, first = _named(events, stopwords)
    return _of_every_event(_of_names(first, teams, stopwords, weights, exact, least, keep, aliases, explain), first, named)


def decided(events: DataFrame, teams: DataFrame, stopwords: tuple[str, ...] = names.STOPWORDS_RESOLVE, aliases: DataFrame | None = None, **limits: tuple[float, float]) -> DataFrame:
    """``decide`` for every event by its explained ``candidates``, made once for each name and scope."""
    named, first = _named(events, stopwords)
    found = _of_names(first, teams, stopwords, TEAM_WEIGHTS, 0.98, LEAST_SCORE, KEEP, aliases, True)
    return _of_every_event(decide(found, first, **limits), first, named)


def _of_names(e: DataFrame, teams: DataFrame, stopwords: tuple[str, ...], weights: tuple[float, float, float], exact: float, least: float, keep: int, aliases: DataFrame | None, explain: bool) -> DataFrame:
    """The candidates of events that stand for their name and scope."""
    form = lambda c: names.without(names.normal(F.col(c)), stopwords)
    scope = ("source_system", "competition_code")
    kept = ["event_id", "team_id", "score", "via", "alias", "raw", "form"]  # via: 0 by an alias, 1 by the canonical name
    teams = stored(teams.select("team_id", "canonical_name", form("canonical_name").alias("form")), "team-names")
    by_name = scored(e, teams.select("team_id", "form"), exact, weights, least)
    found = by_name.withColumns({"via": F.lit(1), "alias": F.lit(None).cast("string")}).select(*kept)
    if aliases is not None:
        known = stored(aliases.select("team_id", "alias", form("alias").alias("form"), *scope), "alias-names")
        by_alias = scored(e, known, 1.0, ALIAS_WEIGHTS, least)
        for c in scope:
            by_alias = by_alias.filter(in_scope(F.col(c), F.col(f"event_{c}")))
        found = found.unionByName(by_alias.withColumn("via", F.lit(0)).select(*kept))
    if explain:  # of equal scores an alias counts before the canonical name, and the first alias
        best = found.groupBy("event_id", "team_id").agg(F.min(F.struct((-F.col("score")).alias("less"), "via", "alias", "raw", "form")).alias("how")).withColumn("score", -F.col("how.less"))
    else:
        best = found.groupBy("event_id", "team_id").agg(F.max("score").alias("score"))
    best = best.join(teams.select("team_id", "canonical_name"), "team_id")
    w = Window.partitionBy("event_id").orderBy(F.desc("score"), "canonical_name", "team_id")
    top = best.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= keep)
    if not explain:
        return top.select("event_id", "team_id", "canonical_name", "score", "rank")
    raw, name, alias = F.col("how.raw"), F.col("how.form"), F.col("how.alias")
    bits = F.when(F.col("how.via") == 0, reasons(raw, name, "alias", "exact_alias", F.concat(F.lit("via_alias="), F.coalesce(alias, F.lit(""))))).otherwise(reasons(raw, name, "canon", "exact_canonical", F.lit("via_canonical")))
    return top.select("event_id", "team_id", "canonical_name", "score", "rank", F.when(F.col("how.via") == 0, "alias").otherwise("canonical").alias("matched_via"), bits.alias("reason_bits"))


APPROVE, PROVISIONAL = (0.95, 0.08), (0.78, 0.05)


def decide(found: DataFrame, events: DataFrame | None = None, approve: tuple[float, float] = APPROVE, provisional: tuple[float, float] = PROVISIONAL) -> DataFrame:
    """approve, approve_provisional or no_match for each event from the best score and its lead over the next.

    With ``events`` each of them has a decision; one without candidates is no_match with score 0.  ``candidates``
    lists what the decision rests on.
    """
    listed = F.array_sort(F.collect_list(F.struct("rank", *(c for c in found.columns if c not in ("rank", "event_id")))))  # at most KEEP for each event
    out = found.groupBy("event_id").agg(listed.alias("candidates"))
    out = out if events is None else events.select("event_id").join(out.hint("merge"), "event_id", "left")  # lists shrink when shuffled, not in memory
    top, second = F.get("candidates", F.lit(0)), F.get("candidates", F.lit(1))
    score = F.coalesce(top["score"], F.lit(0.0))
    out = out.withColumns({"team_id": top["team_id"], "canonical_name": top["canonical_name"], "score": score, "margin": F.bround(score - F.coalesce(second["score"], F.lit(0.0)), 4)})
    passes = lambda limits: (F.col("score") >= limits[0]) & (F.col("margin") >= limits[1])
    return out.withColumn("decision", F.when(passes(approve), "approve").when(passes(provisional), "approve_provisional").otherwise("no_match"))


def reasoning(events: DataFrame, decisions: DataFrame, approve: float = APPROVE[0], provisional: float = PROVISIONAL[0], least: float = LEAST_SCORE) -> DataFrame:
    """Rows for the decision log: event_id, suggested_team_id, decision, confidence and the reasoning as JSON text.

    Decisions need candidates with matched_via and reason_bits (``candidates(..., explain=True)``).
    """
    top, second = F.get("candidates", F.lit(0)), F.get("candidates", F.lit(1))
    named = lambda c: F.when(c.isNotNull(), F.struct(c["team_id"].alias("team_id"), c["canonical_name"].alias("canonical_name"), c["score"].alias("score"), c["matched_via"].alias("matched_via"), c["reason_bits"].alias("reason_bits")))
    some = F.size(F.coalesce("candidates", F.array())) > 0
    limits = F.struct(F.lit(approve).alias("approve"), F.lit(provisional).alias("approve_provisional"), F.lit(least).alias("min_candidate_score"))
    said = F.struct(
        "raw_name", names.normal(F.col("raw_name")).alias("raw_name_normalized"), named(top).alias("top_candidate"), named(second).alias("second_candidate"),
        F.when(some, F.col("margin")).alias("score_margin"), F.when(some, limits).alias("thresholds"),
        F.when(some, F.transform("candidates", named)).alias("all_candidates"), F.when(~some, "no_candidates").alias("decision_basis"),
    )
    rows = events.select("event_id", "raw_name").join(decisions.hint("merge"), "event_id")
    return rows.select("event_id", F.col("team_id").alias("suggested_team_id"), "decision", F.col("score").alias("confidence"), F.to_json(said).alias("reasoning"))


#: What a run counts, in this order.
KINDS = ("approve", "approve_provisional", "no_match", "reject")


def decision_counts(decisions: DataFrame) -> DataFrame:
    """How often each kind of decision was made, those that never were too."""
    counts = [F.count(F.when(F.col("decision") == k, 1)) for k in KINDS]
    return decisions.agg(F.array(*(F.struct(F.lit(k).alias("decision"), n.alias("n")) for k, n in zip(KINDS, counts, strict=True))).alias("c")).select(F.inline("c"))


def status(decision: Column) -> Column:
    """An event's next status; a decision of no known kind rejects it."""
    return F.when(decision.isin("approve", "approve_provisional"), "resolved").when(decision == "no_match", "ignored").otherwise("rejected")


def effects(decisions: DataFrame, events: DataFrame) -> DataFrame:
    """What a decision does: a global or scoped alias and the event's next status; an event without a decision is ignored."""
    out = events.join(decisions.select("event_id", "team_id", "decision").hint("merge"), "event_id", "left").withColumn("decision", F.coalesce("decision", F.lit("no_match")))
    scope = F.when(F.col("decision") == "approve_provisional", "scoped").when(F.col("decision") == "approve", "global")
    return out.select(
        "event_id", "decision", F.when(scope.isNotNull(), F.col("team_id")).alias("team_id"),
        names.normal(F.col("raw_name")).alias("alias_normalized"), scope.alias("alias_scope"), status(F.col("decision")).alias("status"),
    )


def new_aliases(events: DataFrame, decisions: DataFrame) -> DataFrame:
    """An alias row for each approved event, named by its event: open to all for approve, in the event's scope for approve_provisional."""
    scope = lambda c: (F.when(F.col("decision") == "approve_provisional", F.col(c)) if c in events.columns else F.lit(None).cast("string")).alias(c)
    rows = events.join(decisions.filter(F.col("decision").isin("approve", "approve_provisional")).select("event_id", "team_id", "canonical_name", "score", "decision", "candidates").hint("merge"), "event_id")
    via = F.get("candidates", F.lit(0))["matched_via"]
    said = F.concat(F.lit("auto_resolve matched '"), "raw_name", F.lit("' → '"), "canonical_name", F.lit("' mit score="), F.format_string("%.4f", F.col("score").cast("double")), F.lit(" via="), via)
    return rows.select(
        "event_id", "team_id", scope("source_system"), scope("competition_code"), F.col("raw_name").alias("alias_name"), names.normal(F.col("raw_name")).alias("alias_normalized"),
        F.when(F.col("decision") == "approve", "approved").otherwise("provisional").alias("status"), F.lit("ai_agent").alias("decision_source"), F.col("score").alias("confidence"), said.alias("explanation"),
    )


ALIAS_KEY, ALIAS_SCOPE = ("team_id", "source_system", "competition_code", "alias_normalized"), ("source_system", "competition_code")


def upsert_aliases(old: DataFrame, rows: DataFrame, at: str) -> DataFrame:
    """The alias table after the rows of ``new_aliases``: one row for each team, scope and normal form, with how often it was used."""
    return merge.upsert_counted(old, rows, ALIAS_KEY, ALIAS_SCOPE, "event_id", at)


def standings_strength(standings: DataFrame) -> DataFrame:
    """Strength of a team from its place and points in its table."""
    w = Window.partitionBy("comp_id")
    low, high = F.min("position").over(w), F.max("position").over(w)
    rank = F.when(high > low, (high - F.col("position")) / (high - low)).otherwise(0.5)
    raw = 35 + 55 * rank + F.least(F.col("points") / 10, F.lit(10.0))
    return standings.select("comp_id", "team_id", F.greatest(F.lit(0.0), F.least(F.lit(100.0), F.bround(raw))).cast("int").alias("strength"))
