"""Resolution of providers' competition codes: aliases, candidates, decisions and their effects."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import names
from ..session import stored
from . import merge, resolve

LEAST_SCORE, KEEP = 0.45, 5
APPROVE, PROVISIONAL = (0.95, 0.08), (0.80, 0.05)
CODE_SCORE, ABBR_SCORE = 0.99, 0.90


def signs_to_blanks(text: Column) -> Column:
    """A normal form in which every other sign parts words."""
    return names.normal(text, underscore=True, signs=" ")


def competition_name(text: Column) -> Column:
    """The normal form without the words that many competitions share; empty if nothing else is there."""
    return without_common(signs_to_blanks(text))


def without_common(form: Column) -> Column:
    return F.array_join(F.filter(F.split(form, " "), lambda w: ~w.isin(*names.STOPWORDS_COMPETITION)), " ")


def aliases(competitions: DataFrame, special: dict[str, list[str]] | None = None) -> DataFrame:
    """(competition_code, form): each competition's name, code, abbreviation, both with its country, and listed ones."""
    listed = names.SPECIAL_COMPETITIONS if special is None else special
    blank = lambda c: F.coalesce(F.col(c), F.lit(""))
    known = F.array(blank("competition_name"), blank("competition_code"), blank("league_abbr"), F.concat_ws(" ", blank("country"), blank("competition_name")), F.concat_ws(" ", blank("country"), blank("league_abbr")))
    if listed:
        table = F.create_map(*(x for k, v in listed.items() for x in (F.lit(k), F.array(*map(F.lit, v)))))
        known = F.concat(known, F.coalesce(F.try_element_at(table, F.col("competition_code")), F.array().cast("array<string>")))
    return competitions.select("competition_code", F.explode(known).alias("a")).select("competition_code", competition_name(F.col("a")).alias("form")).filter("form <> ''").distinct()


def candidates(events: DataFrame, competitions: DataFrame, least: float = LEAST_SCORE, keep: int = KEEP) -> DataFrame:
    """The best competitions of each event (event_id, external_code, external_name): (event_id, competition_code, score, matched_via, rank).

    Both values of an event are scored against every alias.  Names meet by the keys of ``resolve.meeting``,
    which lose no pair that reaches ``least``; equal codes and abbreviations meet by themselves.  Normal forms are found and scored
    once for each text, however many events bear it.
    """
    values = events.select("event_id", F.inline(F.array(*(F.struct(F.col(c).alias("v"), F.lit(via).alias("of")) for c, via in (("external_name", 1), ("external_code", 2))))))
    # by a count, as Spark leaves out a grouping whose keys alone are asked for
    texts = values.filter("v IS NOT NULL").groupBy("v").agg(F.count("*").alias("n")).select("v", "n", signs_to_blanks(F.col("v")).alias("form"))
    texts = stored(texts.filter("form <> ''").withColumn("raw", without_common(F.col("form"))), "texts")
    by_alias = resolve.scored(texts.filter("raw <> ''").select("v", "raw"), stored(aliases(competitions), "aliases"), 1.0, resolve.COMPETITION_WEIGHTS, least).select("v", "competition_code", "score", F.lit(0).alias("via"))
    alike = lambda theirs, score, via: texts.select("v", "form").join(competitions.select("competition_code", signs_to_blanks(F.col(theirs)).alias("form")), "form").select("v", "competition_code", F.lit(score).alias("score"), F.lit(via).alias("via"))
    known = by_alias.unionByName(alike("league_abbr", ABBR_SCORE, 1)).unionByName(alike("competition_code", CODE_SCORE, 2))
    # an alias counts for either value of an event, an abbreviation for its name and a code for its code
    found = values.join(known.hint("merge"), "v").filter((F.col("via") == 0) | (F.col("via") == F.col("of")))
    best_of = lambda via: F.max(F.when(F.col("via") == via, F.col("score")))
    best = found.groupBy("event_id", "competition_code").agg(F.max("score").alias("score"), best_of(0).alias("alias"), best_of(1).alias("abbr"), best_of(2).alias("code"))
    # the code always names the way, the abbreviation only where it betters the score
    via = F.when(F.col("code").isNotNull(), "competition_code").when(F.col("abbr").isNotNull() & (F.coalesce("alias", F.lit(0.0)) < ABBR_SCORE), "league_abbr").otherwise("alias")
    w = Window.partitionBy("event_id").orderBy(F.desc("score"), "competition_code")
    ranked = best.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= keep)
    return ranked.select("event_id", "competition_code", "score", via.alias("matched_via"), "rank")


def decide(events: DataFrame, found: DataFrame, approve: tuple[float, float] = APPROVE, provisional: tuple[float, float] = PROVISIONAL) -> DataFrame:
    """Each event's decision with the confidence, the lead over the second and the candidates it rests on."""
    listed = F.array_sort(F.collect_list(F.struct("rank", "competition_code", "score", "matched_via")))
    per_event = found.groupBy("event_id").agg(listed.alias("candidates"))
    out = events.select("event_id").join(per_event, "event_id", "left")
    top, second = F.get("candidates", F.lit(0)), F.get("candidates", F.lit(1))
    score = F.coalesce(top["score"], F.lit(0.0))
    out = out.withColumns({"competition_code": top["competition_code"], "confidence": score, "margin": F.bround(score - F.coalesce(second["score"], F.lit(0.0)), 4)})
    passes = lambda limits: (F.col("confidence") >= limits[0]) & (F.col("margin") >= limits[1])
    return out.withColumn("decision", F.when(passes(approve), "approve").when(passes(provisional), "approve_provisional").otherwise("no_match"))


def status(decision: Column) -> Column:
    """An event's next status; a decision of no known kind rejects it."""
    return F.when(decision.isin("approve", "approve_provisional"), "resolved").when(decision == "no_match", "ignored").otherwise("rejected")


def with_note(events: DataFrame, decisions: DataFrame, at: str) -> DataFrame:
    """Events with their next status and the decision noted in ``context``, a map of JSON texts that keeps its other keys."""
    key = "auto_resolve_decision"
    reasoning = F.struct("competition_code", F.col("margin").alias("score_margin"), "candidates")
    note = F.to_json(F.struct("decision", "confidence", reasoning.alias("reasoning"), F.lit(at).alias("processed_at")))
    noted = decisions.select("event_id", "decision", note.alias("note"))
    others = F.map_filter(F.coalesce("context", F.create_map().cast("map<string,string>")), lambda k, _: k != key)
    out = events.join(noted, "event_id", "left")
    known = F.col("decision").isNotNull()
    changed = {"context": F.when(known, F.map_concat(others, F.create_map(F.lit(key), F.col("note")))).otherwise(F.col("context")), "status": F.when(known, status(F.col("decision"))).otherwise(F.col("status"))}
    return out.withColumns(changed).select(*events.columns)


def mappings(old: DataFrame, events: DataFrame, decisions: DataFrame) -> DataFrame:
    """The map of external codes with those of approved events set; of several events of a code the last wins."""
    rows = events.join(decisions.filter("decision <> 'no_match'").select("event_id", "competition_code"), "event_id")
    new = rows.groupBy("source_system", "external_code").agg(F.max_by(F.struct("competition_code", "external_name"), "event_id").alias("m"))
    new = new.select("source_system", "external_code", "m.competition_code", "m.external_name", F.lit(True).alias("is_active"))
    return merge.upsert(old, new, ["source_system", "external_code"])
