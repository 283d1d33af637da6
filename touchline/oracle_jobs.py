"""DuckDB SQL for the queries of jobs: competitions, detection, extraction, windows, seasons, the agent."""

from __future__ import annotations

from . import oracles
from .functions import names
from .sources import relations as r

_with = oracles._with
_AT = "timestamp '2024-01-15 12:00:00'"
_WORDS = "list_distinct(list_filter(string_split({0},' '), lambda w: w <> ''))"


def competitions() -> list[tuple[str, str]]:
    """Every event's values with every alias."""
    clean = lambda x: f"trim(regexp_replace(regexp_replace(lower(trim(coalesce({x},''))),'[^a-z0-9]',' ','g'),'\\s+',' ','g'))"
    stop = ", ".join(f"'{w}'" for w in names.STOPWORDS_COMPETITION)
    form = lambda x: f"array_to_string(list_filter(string_split({clean(x)},' '), lambda w: w not in ({stop})),' ')"
    listed = ", ".join(f"('{k}', '{a}')" for k, v in names.SPECIAL_COMPETITIONS.items() for a in v)
    return [
        ("comps", r.COMPETITIONS), ("ev", r.COMPETITION_EVENTS),
        ("given", f"select competition_code, unnest([competition_name, competition_code, league_abbr, country||' '||competition_name, country||' '||league_abbr]) as a from comps union all select competition_code, a from comps join (values {listed}) v(k, a) on k = competition_code"),
        ("forms", f"select distinct competition_code, {form('a')} as form from given where {form('a')} <> ''"),
        ("raws", f"select distinct event_id, raw from (select event_id, {form('external_code')} as raw from ev union all select event_id, {form('external_name')} from ev) where raw <> ''"),
        ("lists", f"select *, {_WORDS.format('raw')} as rw, {_WORDS.format('form')} as fw, string_split(raw,' ') as rs, string_split(form,' ') as fs from raws cross join forms"),
        ("sims", """select event_id, competition_code, max(case when raw = form then 1e0 else round_even(greatest(
              0.85e0 * len(list_intersect(rw, fw)) / len(list_distinct(list_concat(rw, fw))),
              0.92e0 * case when contains(raw, form) or contains(form, raw) then least(length(raw), length(form)) / greatest(length(raw), length(form)) else 0 end,
              0.75e0 * coalesce(list_min(list_filter(range(1, least(len(rs), len(fs)) + 1), lambda i: rs[i] <> fs[i])) - 1, least(len(rs), len(fs))) / greatest(len(rs), len(fs))), 4) end) as alias from lists group by 1, 2"""),
        ("pairs", f"""select e.event_id, c.competition_code, coalesce(s.alias, 0e0) as alias, {clean('external_code')} = {clean('c.competition_code')} and {clean('external_code')} <> '' as code, {clean('external_name')} = {clean('league_abbr')} and {clean('external_name')} <> '' as abbr
            from ev e cross join comps c left join sims s on s.event_id = e.event_id and s.competition_code = c.competition_code"""),
        ("scores", "select event_id, competition_code, greatest(alias, case when code then 0.99e0 else 0e0 end, case when abbr then 0.90e0 else 0e0 end) as score, case when code then 'competition_code' when abbr and alias < 0.90e0 then 'league_abbr' else 'alias' end as matched_via from pairs"),
        ("found", "select *, cast(row_number() over (partition by event_id order by score desc, competition_code) as int) as rank from scores where score >= 0.45e0 qualify rank <= 5"),
        ("tops", "select event_id, competition_code, score, round_even(score - coalesce(lead(score) over (partition by event_id order by rank), 0e0), 4) as margin, rank from found"),
        ("decided", """select e.event_id, t.competition_code, coalesce(score, 0e0) as confidence, coalesce(margin, 0e0) as margin,
            case when score >= 0.95e0 and margin >= 0.08e0 then 'approve' when score >= 0.80e0 and margin >= 0.05e0 then 'approve_provisional' else 'no_match' end as decision from ev e left join tops t on t.event_id = e.event_id and t.rank = 1"""),
    ]


def _forms(stopwords: tuple[str, ...]) -> list[tuple[str, str]]:
    stop = ", ".join(f"'{w}'" for w in stopwords)
    form = lambda x: f"array_to_string(list_filter(string_split(lower({x}),' '), lambda w: w not in ({stop})),' ')"
    side = lambda s: f"list_distinct(list_concat([{s}], coalesce((select list(canonical_normalized) from al where alias_normalized = {s} and coalesce(source_system, 'odds_api') = 'odds_api' and coalesce(al.competition_code, x.competition_code) = x.competition_code), [])))"
    sets = lambda q: f"select *, {side('h')} as hs, {side('a')} as aws from ({q}) x"
    return [
        ("nm", r.NAMED_MATCHES), ("api", r.API_EVENTS), ("al", r.TEAM_ALIASES),
        ("m", sets(f"select *, {form('home_team')} as h, {form('away_team')} as a from nm")),
        ("e", sets(f"select *, substring(sport_key, 7) as competition_code, {form('home_team')} as h, {form('away_team')} as a from api")),
    ]


def detection() -> list[tuple[str, str]]:
    jaccard = lambda a, b: f"len(list_intersect({_WORDS.format(a)}, {_WORDS.format(b)})) / len(list_distinct(list_concat({_WORDS.format(a)}, {_WORDS.format(b)})))"
    side = lambda f, s: f"case when len(list_intersect(m.{s}, e.{s})) > 0 then 1e0 else list_max(list_transform(e.{s}, lambda c: len(list_intersect(string_split(m.{f},' '), string_split(c,' '))) / len(list_distinct(list_concat(string_split(m.{f},' '), string_split(c,' ')))))) end"
    trivial = lambda a, b: f"({a} = {b} or list_sort({_WORDS.format(a)}) = list_sort({_WORDS.format(b)}) or {jaccard(a, b)} >= 0.9e0 or ((contains({a}, {b}) or contains({b}, {a})) and {jaccard(a, b)} >= 0.7e0))"
    return [
        *_forms(names.STOPWORDS_DETECT),
        ("scored", f"""select m.match_id, e.event_id, m.competition_code, m.kickoff_at, m.home_team, m.away_team, m.h, m.a, e.h as api_home, e.a as api_away, e.home_team as api_home_team, e.away_team as api_away_team, round_even(({side('h', 'hs')} + {side('a', 'aws')}) / 2, 4) as score
            from m join e on m.sport_key = e.sport_key and (e.kickoff_at is null or abs(epoch_us(m.kickoff_at) - epoch_us(e.kickoff_at)) <= 10800000000)"""),
        ("best", "select * from scored qualify row_number() over (partition by match_id order by score desc, event_id) = 1"),
        ("stored", f"select * from best where not (h = api_home and a = api_away) and not ({trivial('h', 'api_home')} and {trivial('a', 'api_away')}) and score >= 0.35e0 and score < 0.95e0"),
    ]


def extraction() -> list[tuple[str, str]]:
    return [
        *_forms(names.STOPWORDS_MATCH),
        ("met", """select m.match_id, min(e.event_id) as event_id from m join e on m.sport_key = e.sport_key and len(list_intersect(m.hs, e.hs)) > 0 and len(list_intersect(m.aws, e.aws)) > 0
            and (e.kickoff_at is null or abs(epoch_us(m.kickoff_at) - epoch_us(e.kickoff_at)) <= 10800000000) group by 1"""),
        ("unmet", "select * from m where match_id not in (select match_id from met)"),
    ]


_LONG = """select match_id, kickoff_at as k, home_team_id as team, case when home_goals > away_goals then 'W' when home_goals = away_goals then 'D' else 'L' end as s from mm
  union all select match_id, kickoff_at, away_team_id, case when away_goals > home_goals then 'W' when home_goals = away_goals then 'D' else 'L' end from mm"""
_FORM = """select team as team_id, string_agg(s, '' order by n) as form, cast(round_even(sum(case s when 'W' then 3 when 'D' then 1 else 0 end) / (count(*) * 3) * 100, 0) as int) as strength
  from (select *, row_number() over (partition by team order by k desc, match_id) as n from long) where n <= 5 group by 1"""


def sql() -> dict[str, str]:
    comp, det, ext = _with(*competitions()), _with(*detection()), _with(*extraction())
    matches = _with(("m", r.MATCHES))
    results = _with(*oracles.results())
    feats = oracles.features()
    agent = _with(*feats, *oracles.models(), *((f"c_{k}", q) for k, q in oracles.clients().items()), *oracles.forecasts())
    year = "case when part is not null and regexp_matches(part, '^[0-9]+$') then part end"
    return {
        "competition_aliases": comp + "select * from forms",
        "competition_candidates": comp + "select event_id, competition_code, score, matched_via, rank from found",
        "competition_decisions": comp + "select * from decided",
        "competition_map": comp + """, new as (select external_code, competition_code, external_name from ev join decided using (event_id) where decision <> 'no_match' qualify row_number() over (partition by external_code order by event_id desc) = 1), old as (select 'x' || c_custkey as external_code, c_name from customer)
            select 'odds_api' as source_system, coalesce(n.external_code, o.external_code) as external_code, case when n.external_code is not null then n.competition_code else 'OLD' end as competition_code, case when n.external_code is not null then n.external_name else c_name end as external_name, n.external_code is not null as is_active from old o full outer join new n on o.external_code = n.external_code""",
        "competition_notes": comp + "select event_id, case decision when 'no_match' then 'ignored' else 'resolved' end as status, cast(case when event_id % 2 = 0 then 2 else 1 end as int) as n_keys, decision from decided",
        "decision_counts": comp + "select decision, count(*) as n from decided group by 1",
        "detected_candidates": det + "select match_id, event_id, api_home, api_away, score, sha256(concat_ws('||', match_id, home_team, away_team, api_home_team, api_away_team)) as dedup_key from stored",
        "detected_alias_events": det + """, sides as (select competition_code, api_home_team as raw_name, api_home as raw_normalized, 'home' as side, kickoff_at, match_id from stored union all select competition_code, api_away_team, api_away, 'away', kickoff_at, match_id from stored)
            select competition_code, raw_name, raw_normalized, side, 'new' as status, match_id from sides where raw_normalized not in (select alias_normalized from al) qualify row_number() over (partition by competition_code, raw_normalized, side order by kickoff_at desc, match_id desc) = 1""",
        "odds_extract": ext + """select match_id, 'b1' as bookmaker_key, 'B1' as bookmaker_name, cast(1.5e0 + event_id % 10 as double) as home_odds, 3e0 as draw_odds, cast(2 + event_id % 7 as double) as away_odds from met
            union all select match_id, 'b2', 'B2', cast(1.25e0 + event_id % 4 as double), 3.5e0, 2.75e0 from met where event_id % 3 <> 0""",
        "odds_unmatched": ext + "select match_id, competition_code, home_team, away_team from unmet",
        "odds_unmatched_alias_events": ext + """, firsts as (select * from e qualify row_number() over (partition by sport_key order by event_id) <= 20),
            names as (select competition_code, event_id, 'home' as side, home_team as raw_name, h as raw_normalized from firsts union all select competition_code, event_id, 'away', away_team, a from firsts),
            lastm as (select competition_code, home_team as db_home_team from unmet qualify row_number() over (partition by competition_code order by kickoff_at desc, match_id desc) = 1)
            select competition_code, raw_name, raw_normalized, side, 'new' as status, db_home_team from names join lastm using (competition_code) where raw_normalized not in (select alias_normalized from al) qualify row_number() over (partition by competition_code, raw_normalized, side order by event_id desc) = 1""",
        "agent_opinion": agent + """, votes as (select match_id, max(n) as votes from (select match_id, winner, count(*) as n from (select match_id, winner from c_poisson union all select match_id, winner from c_dc union all select match_id, winner from c_elo union all select match_id, winner from c_market union all select match_id, winner from c_ensemble) group by 1, 2) group by 1),
            own as (select e.match_id, e.winner, e.score, e.other_score, e.confidence, votes, abs(b.d) > 0.25e0 or abs(b.fh - b.fa) > 0.25e0 as agree, f.risk_tags <> '' or f.risk_level = 'high' as cautious, f.risk_tags from c_ensemble e join base b using (match_id) join votes using (match_id) join forecast f using (match_id)),
            said as (select *, greatest(20, confidence - case when cautious then 15 else 8 end) as c, case when cautious and not agree then 'warns' when cautious and votes >= 3 then 'agrees_with_warning' when not agree then 'unclear' when votes >= 3 then 'confirms_consensus' else 'confirms' end as stance from own),
            shown as (select match_id, match_id % 11 = 0 as i, winner, score, other_score, case when match_id % 11 <> 0 then c when match_id % 100 = 0 then 50 else match_id % 100 end as c, stance, risk_tags from said)
            select match_id, case when i then 'home' else winner end as winner, case when i then '2:1' else score end as score, case when i then '–' else other_score end as other_score, cast(c as int) as confidence, case when c >= 65 then 'low' when c >= 45 then 'medium' else 'high' end as risk_level,
              case when not i then stance end as stance, case when not i and stance in ('warns', 'agrees_with_warning') then coalesce(nullif(split_part(risk_tags, ',', 1), ''), 'Risikofaktor') end as tag, i as is_injected from shown""",
        "forecast_badges": _with(*feats, *oracles.forecasts()) + "select match_id, case when p >= 80 then 'strong' when p >= 70 then 'solid' when p >= 60 then 'watch' else 'risky' end as badge, case when p >= 75 then 'high' when p >= 60 then 'mid' else 'low' end as prob_class from (select match_id, case predicted_winner when 'home' then win_pct when 'away' then away_pct else draw_pct end as p from forecast)",
        "strong_tips": _with(*feats, *oracles.forecasts()) + "select match_id, predicted_winner, win_pct from forecast where is_strong_tip",
        "high_risk": _with(*feats, *oracles.forecasts()) + "select match_id, confidence_score from forecast where risk_level = 'high'",
        "upcoming_mapped": matches + f"select match_id, competition_code, 'new_' || competition_code as external_code, kickoff_at from m where competition_code <> 'error' and kickoff_at >= {_AT} - interval 2 hours and kickoff_at < {_AT} + interval 7 days",
        "upcoming_dirty": matches + f"select match_id, kickoff_at from m where kickoff_at >= {_AT} and kickoff_at < {_AT} + interval 3 days and match_id in (select event_id from events where event_type = 'view')",
        "not_past": matches + f"select match_id, kickoff_at from m where kickoff_at is null or kickoff_at > {_AT}",
        "unmapped_competitions": matches + "select competition_code, count(*) as n_matches from m where competition_code = 'error' group by 1",
        "pending_events": "select o_orderkey as event_id, 'new' as status, o_orderdate as created_at from orders where o_orderstatus = 'O' order by o_orderdate, o_orderkey limit 200",
        "enriched_matches": "select o_orderkey as match_id, case when o_orderstatus <> 'F' then coalesce(o_orderpriority, 'none') else 'none' end as level, cast(case when o_orderstatus = 'O' then 70 else 50 end as int) as home_strength from orders",
        "recent_form": _with(("mm", r.MATCHES), ("long", _LONG)) + _FORM,
        "match_strengths": _with(("m0", r.MATCHES), ("mm", "select * replace (case when match_id % 17 <> 0 then away_team_id end as away_team_id) from m0"), ("long", _LONG), ("f", _FORM), ("st", oracles.sql()["standings_strength"]), ("s", "select team_id, strength from st where strength >= 50"))
        + "select match_id, coalesce(sh.strength, fh.strength, 50) as home_strength, coalesce(sa.strength, fa.strength, 50) as away_strength, coalesce(fh.form, '') as form_home, coalesce(fa.form, '') as form_away from mm left join s sh on sh.team_id = home_team_id left join s sa on sa.team_id = away_team_id left join f fh on fh.team_id = home_team_id left join f fa on fa.team_id = away_team_id",
        "teams_by_competition": matches + "select competition_code, home_team_id as team_id from m union select competition_code, away_team_id from m",
        "season_features": _with(*oracles.features(f"select * from ({r.MATCHES_MULTI}) where year(kickoff_at) in (1996, 1997)")) + "select match_id, home_form, away_form, home_crosses_year from feats where year(kickoff_at) = 1997",
        "season_names": f"select o_orderkey, {year} as season_year, cast(cast({year} as bigint) - 1 as varchar) as previous_year from (select o_orderkey, case o_orderkey % 4 when 3 then 'S' || year(o_orderdate) when 2 then '20' || substring(cast(year(o_orderdate) as varchar), 3, 2) else cast(year(o_orderdate) as varchar) end as part from orders)",
        "model_summary": results + "select model_key, count(*) as n, round(avg(points), 2) as avg_points, round(100 * avg(is_tendency_hit::int), 1) as tendency_pct, round(100 * avg(is_exact_hit::int), 1) as exact_pct, round(avg(score_error_abs), 2) as avg_error, round(avg(brier_score_1x2), 4) as avg_brier from results group by 1",
        "results_csv": results + "select concat(match_id, ',', model_key, ',', coalesce(model_version, ''), ',', predicted_score, ',', actual_score, ',', points, ',', confidence_score, ',', coalesce(competition_code, '')) as line from results",
        "results_merged": results + "select match_id, model_key, points + case when model_key = 'elo' or match_id % 2 = 0 then 10 else 0 end as points from results",
        "short_names": "select p_partkey, string_split(p_name, ' ')[-1] as short_name from part",
    }
