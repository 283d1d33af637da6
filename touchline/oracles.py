"""DuckDB SQL for the match-analytics queries, written apart from the Spark plans."""

from __future__ import annotations

from .functions import names
from .sources import relations as r


def _with(*parts: tuple[str, str]) -> str:
    # chains of long expressions (fc...) are held, or they would be put into one another
    return "with " + ",\n".join(f"{n} as {'materialized ' * n.startswith('fc')}({q})" for n, q in parts) + "\n"


def features(matches: str = r.MATCHES) -> list[tuple[str, str]]:
    strength = lambda n, p, g: f"case when {n} >= 3 then greatest(0e0, least(100e0, round_even(100*(0.7e0*({p}/{n})/3 + 0.3e0*(greatest(-3e0, least(3e0, {g}/{n}))+3)/6), 1))) end"
    pts = "case when gf>ga then 3 when gf=ga then 1 else 0 end"
    return [
        ("matches", matches),
        ("long", "select match_id, kickoff_at as k, home_team_id as team, true as is_home, home_goals as gf, away_goals as ga from matches union all select match_id, kickoff_at, away_team_id, false, away_goals, home_goals from matches"),
        ("prior", "select a.match_id, a.is_home, a.k as ak, b.k as bk, b.gf, b.ga, b.is_home as b_home, row_number() over (partition by a.match_id, a.is_home order by b.k desc, b.match_id) as rn, row_number() over (partition by a.match_id, a.is_home, b.is_home order by b.k desc, b.match_id) as rv from long a join long b on a.team = b.team and b.k < a.k"),
        ("sums", f"""select match_id, is_home, count(*) as n_prior, count(*) filter (b_home = is_home) as n_prior_venue,
            count(*) filter (rn<=10) as n, sum({pts}) filter (rn<=10) as p, sum(gf-ga) filter (rn<=10) as g,
            count(*) filter (rv<=6 and b_home=is_home) as vn, sum({pts}) filter (rv<=6 and b_home=is_home) as vp, sum(gf-ga) filter (rv<=6 and b_home=is_home) as vg,
            string_agg(case when gf>ga then 'W' when gf=ga then 'D' else 'L' end, '' order by rn) filter (rn<=5) as form,
            year(min(bk) filter (rn<=10)) < year(min(ak)) as crosses_year from prior group by 1, 2"""),
        ("state", f"select *, {strength('n', 'p', 'g')} as general, {strength('vn', 'vp', 'vg')} as venue from sums"),
        ("blend", "select *, case when venue is null then general else round_even(0.6e0*general + 0.4e0*venue, 1) end as strength from state"),
        ("feats", """select m.*, h.strength as home_strength, a.strength as away_strength, h.venue as home_venue, a.venue as away_venue,
            coalesce(h.form,'') as home_form, coalesce(a.form,'') as away_form, coalesce(h.n_prior,0) as home_n_prior, coalesce(a.n_prior,0) as away_n_prior,
            coalesce(h.crosses_year,false) as home_crosses_year, coalesce(a.crosses_year,false) as away_crosses_year
            from matches m left join blend h on h.match_id=m.match_id and h.is_home left join blend a on a.match_id=m.match_id and not a.is_home"""),
    ]


_SHARE = "case when length({0})=0 then 0.5e0 else (3*(length({0})-length(replace({0},'W','')))+(length({0})-length(replace({0},'D',''))))/(3*length({0})) end"
_TIP = "cast(cast(greatest(0, round_even({0},0)) as int) as varchar) || ':' || cast(cast(greatest(0, round_even({1},0)) as int) as varchar)"
_LARGEST = "case when {0}>={1} and {0}>={2} then 'home' when {2}>={0} and {2}>={1} then 'away' else 'draw' end"


def models() -> list[tuple[str, str]]:
    base = f"select *, coalesce((home_strength-away_strength)/100, 0e0) as d, {_SHARE.format('home_form')} as fh, {_SHARE.format('away_form')} as fa from feats"

    def grid(name: str, lh: str, la: str, shift: bool) -> list[tuple[str, str]]:
        tau = "case when h=0 and a=0 then 1-lh*la*0.13e0 when h=1 and a=0 then 1+la*0.13e0 when h=0 and a=1 then 1+lh*0.13e0 when h=1 and a=1 then 1-0.13e0 else 1e0 end" if shift else "1e0"
        p = "q / sum(q) over (partition by match_id)" if shift else "q"
        return [
            (f"{name}_rate", f"select match_id, greatest(0.3e0, {lh}) as lh, greatest(0.3e0, {la}) as la from base"),
            (f"{name}_cell", f"select match_id, h, a, greatest(0e0, (exp(-lh)*pow(lh,h)/factorial(cast(h as int)))*(exp(-la)*pow(la,a)/factorial(cast(a as int)))*({tau})) as q from {name}_rate, range(7) t(h), range(7) u(a)"),
            (f"{name}_p", f"select match_id, h, a, {p} as p from {name}_cell"),
            (f"{name}_best", f"select match_id, cast(h as varchar)||':'||cast(a as varchar) as score, p as top from {name}_p qualify row_number() over (partition by match_id order by p desc, h, a) = 1"),
            (f"{name}_sum", f"select match_id, sum(p) filter (h>a) as ph, sum(p) filter (h=a) as pd, sum(p) filter (h<a) as pa from {name}_p group by 1"),
            (f"m_{name}", f"select match_id, case when ph>=0.45e0 then 'home' when pa>=0.32e0 then 'away' else 'draw' end as winner, score, cast(floor(least(85e0, 250*top)) as int) as confidence, ph, pd, pa from {name}_best join {name}_sum using (match_id)"),
        ]

    clamp3 = "greatest(0.04e0, least(0.92e0, {0}))"
    return [
        ("base", base),
        *grid("poisson", "1.4e0+1.2e0*d+0.6e0*(fh-0.5e0)", "1.1e0-0.8e0*d+0.4e0*(fa-0.5e0)", False),
        *grid("dc", "1.3e0+1.0e0*d+0.5e0*(fh-0.5e0)", "1.0e0-0.7e0*d+0.4e0*(fa-0.5e0)", True),
        ("elo_p", "select match_id, d, 1/(1+pow(10e0, -(4*d+0.1e0))) as p from base"),
        ("m_elo", f"select match_id, case when p>0.58e0 then 'home' when p<0.38e0 then 'away' else 'draw' end as winner, {_TIP.format('1+1.8e0*d', '0.9e0-0.9e0*d')} as score, cast(least(99, floor(45+90*abs(p-0.5e0))) as int) as confidence, p as ph, (1-p)*0.481e0 as pd, (1-p)*0.519e0 as pa from elo_p"),
        ("mk1", "select match_id, d, home_odds o, draw_odds od, away_odds oa, coalesce(draw_odds>1 and away_odds>1, false) as full3, least(0.90e0, 1/home_odds/1.07e0) as one, 1/home_odds+1/draw_odds+1/away_odds as t from base"),
        ("mk2", "select *, case when full3 then 1/o/t else one end as a1, case when full3 then 1/od/t else (1-one)*0.49e0 end as a2, case when full3 then 1/oa/t else (1-one)*0.51e0 end as a3 from mk1"),
        ("mk3", f"select *, {clamp3.format('a1/(a1+a2+a3)')} as b1, {clamp3.format('a2/(a1+a2+a3)')} as b2, {clamp3.format('a3/(a1+a2+a3)')} as b3 from mk2"),
        ("mk4", "select *, b1/(b1+b2+b3) as c1, b2/(b1+b2+b3) as c2, b3/(b1+b2+b3) as c3, greatest(0.12e0, least(0.88e0, 0.47e0+0.4e0*d)) as alone from mk3"),
        ("m_market", f"""select match_id, case when coalesce(o>1,false) then {_LARGEST.format('c1', 'c2', 'c3')} when alone>0.55e0 then 'home' when alone<0.40e0 then 'away' else 'draw' end as winner,
            {_TIP.format('0.9e0+1.2e0*d', '0.8e0-0.6e0*d')} as score,
            cast(case when not coalesce(o>1,false) then 20 when od is not null and oa is not null then floor(least(90e0, 40+60*greatest(c1,c2,c3))) else greatest(35, floor(least(90e0, 40+60*greatest(c1,c2,c3)))-15) end as int) as confidence,
            case when coalesce(o>1,false) then round_even(c1,4) else alone end as ph, case when coalesce(o>1,false) then round_even(c2,4) else (1-alone)*0.481e0 end as pd, case when coalesce(o>1,false) then round_even(c3,4) else (1-alone)*0.519e0 end as pa from mk4"""),
        ("en1", """select b.match_id, home_strength is not null and away_strength is not null as known, dc.winner as dw, dc.score, dc.confidence as dconf, dc.ph as d1, dc.pd as d2, dc.pa as d3,
            p.ph as p1, p.pd as p2, p.pa as p3, m.ph as m1, m.pd as m2, m.pa as m3,
            coalesce(home_odds>1,false) as one_side, coalesce(home_odds>1 and draw_odds>1 and away_odds>1, false) as full3
            from base b join m_dc dc using (match_id) join m_poisson p on p.match_id=b.match_id join m_market m on m.match_id=b.match_id"""),
        ("en2", "select *, " + ", ".join(f"case when full3 then 0.6e0*d{i}+0.3e0*m{i}+0.1e0*p{i} when one_side then 0.7e0*d{i}+0.2e0*m{i}+0.1e0*p{i} else 0.8e0*d{i}+0.2e0*p{i} end as x{i}" for i in (1, 2, 3)) + " from en1"),
        ("en3", "select *, " + ", ".join(f"x{i}/(x1+x2+x3) as y{i}" for i in (1, 2, 3)) + " from en2"),
        ("m_ensemble", f"""select match_id, case when not known then dw else {_LARGEST.format('y1', 'y2', 'y3')} end as winner, score,
            case when not known then dconf else cast(least(95, floor(50+90*abs(greatest(y1,y2,y3)-1e0/3)) + case when full3 then 5 when one_side then 2 else 0 end) as int) end as confidence,
            case when known then round_even(y1,4) else d1 end as ph, case when known then round_even(y2,4) else d2 end as pd, case when known then round_even(y3,4) else d3 end as pa from en3"""),
    ]


_HALF_UP = "cast(cast(greatest(0, floor({0}+0.5e0)) as int) as varchar) || ':' || cast(cast(greatest(0, floor({1}+0.5e0)) as int) as varchar)"


def clients() -> dict[str, str]:
    """The dashboard's models over base and the grids' cells."""
    risk = "case when c>=65 then 'low' when c>=45 then 'medium' else 'high' end as risk_level"
    shown = f"cast(greatest(1, least(99, floor(c+0.5e0))) as int) as confidence, {risk}"
    by_home = "case when p>0.55e0 then 'home' when p<0.40e0 then 'away' else 'draw' end"
    plain = lambda winner, h, a, h2, a2, c, p: f"select match_id, {winner} as winner, {_HALF_UP.format(h, a)} as score, {_HALF_UP.format(h2, a2)} as other_score, {shown}, cast(null as varchar) as likeliest from (select *, {c} as c from (select *, {p} as p from base))"

    def grid(name: str) -> str:
        return f"""select match_id, {_LARGEST.format('ph', 'pd', 'pa')} as winner, score, other_score, {shown}, likeliest from (
            select match_id, max(s) filter (rn=1) as score, max(s) filter (rn=2) as other_score, least(85e0, 250*max(p)) as c,
              string_agg(s || '=' || cast(cast(round(p*10000) as int) as varchar), '|' order by rn) filter (rn<=5) as likeliest
            from (select match_id, p, cast(h as varchar)||':'||cast(a as varchar) as s, row_number() over (partition by match_id order by p desc, h, a) as rn from {name}_p) group by 1
          ) join {name}_sum using (match_id)"""

    return {
        "poisson": grid("poisson"), "dc": grid("dc"),
        "elo": plain("case when p>0.58e0 then 'home' when p<0.38e0 then 'away' else 'draw' end", "1+1.8e0*d", "0.9e0-0.9e0*d", "greatest(1e0, 1+1.8e0*d)", "greatest(0e0, 0.9e0-0.9e0*d-1)", "45+90*abs(p-0.5e0)", "1/(1+pow(10e0, -(4*d+0.1e0)))"),
        "market": plain(by_home, "0.9e0+1.2e0*d", "0.8e0-0.6e0*d", "0.9e0+1.2e0*d", "0.8e0-0.6e0*d+1", "40+45*p", "least(0.92e0, greatest(0.08e0, 1/coalesce(home_odds, 2e0)*0.9e0))"),
        "ensemble": plain(by_home, "1.2e0+1.5e0*d+0.5e0*(fh-fa)", "0.7e0-0.8e0*d+0.3e0*(1-(fh-fa))", "greatest(0e0, 1.2e0+1.5e0*d+0.5e0*(fh-fa)-1)", "0.7e0-0.8e0*d+0.3e0*(1-(fh-fa))", "50+80*abs(p-0.5e0)",
            "least(0.95e0, greatest(0.05e0, ((case when home_strength is null or away_strength is null then 50 else greatest(5e0, least(95e0, round_even(50+0.6e0*(home_strength-away_strength),0))) end)/100*0.6e0 + (0.5e0+0.25e0*d+0.15e0*(fh-fa)))/1.6e0))"),
    }


def results(matches: str = r.MATCHES) -> list[tuple[str, str]]:
    sgn = lambda a, b: f"case when {a}>{b} then 'H' when {a}<{b} then 'A' when {a}={b} then 'D' end"
    return [
        *features(matches), *models(),
        ("long_results", " union all ".join(f"select '{k}' as model_key, * from m_{k}" for k in ("poisson", "dc", "elo", "market", "ensemble"))),
        ("parsed", f"""select l.*, m.competition_code, m.kickoff_at, m.home_goals as hg, m.away_goals as ag, cast(split_part(score,':',1) as int) as sh, cast(split_part(score,':',2) as int) as sa, ph+pd+pa as tp, {sgn('m.home_goals', 'm.away_goals')} as actual_1x2 from long_results l join matches m using (match_id)"""),
        ("results", f"""select match_id, model_key, '1.0' as model_version, competition_code, cast(kickoff_at as timestamp) as kickoff_at, score as predicted_score, winner as predicted_winner, confidence as confidence_score, ph as prob_home, pd as prob_draw, pa as prob_away, hg as home_goals, ag as away_goals,
            cast(hg as varchar)||':'||cast(ag as varchar) as actual_score,
            case when sh=hg and sa=ag then 4 when {sgn('sh', 'sa')} = actual_1x2 then 2 else 0 end as points,
            case when sh=hg and sa=ag then 'exact' when {sgn('sh', 'sa')} = actual_1x2 and sh-sa=hg-ag then 'goal_diff' when {sgn('sh', 'sa')} = actual_1x2 then 'tendency' else 'wrong' end as outcome_label,
            {sgn('sh', 'sa')} as predicted_1x2, actual_1x2, sh=hg and sa=ag as is_exact_hit, {sgn('sh', 'sa')} = actual_1x2 as is_tendency_hit,
            cast(abs(sh-hg)+abs(sa-ag) as int) as score_error_abs, cast(abs((sh-sa)-(hg-ag)) as int) as goal_diff_error,
            round_even((pow(ph/tp-(actual_1x2='H')::int,2)+pow(pd/tp-(actual_1x2='D')::int,2)+pow(pa/tp-(actual_1x2='A')::int,2))/3, 6) as brier_score_1x2,
            round_even(-ln(greatest(case actual_1x2 when 'H' then ph/tp when 'D' then pd/tp else pa/tp end, 1e-9)), 6) as log_loss_1x2 from parsed"""),
    ]


_NORMAL = r"trim(regexp_replace(regexp_replace(replace(replace(lower(trim({0})),'-',' '),'/',' '),'[^a-z0-9\s]','','g'),'\s+',' ','g'))"


def resolver() -> list[tuple[str, str]]:
    """Every event with every name: nothing is left out by how names meet."""
    stop = ", ".join(f"'{w}'" for w in names.STOPWORDS_RESOLVE)
    bare = lambda x: f"case when array_to_string(list_filter(string_split({x},' '), lambda w: w not in ({stop})),' ') = '' then {x} else array_to_string(list_filter(string_split({x},' '), lambda w: w not in ({stop})),' ') end"
    pre, suf = "|".join(names.PREFIXES), "|".join(names.SUFFIXES)
    prefix = lambda x: f"trim(regexp_replace({x}, '^(({pre})\\s+)+', ''))"
    suffix = lambda x: f"trim(regexp_replace({x}, '(\\s+({suf}))+$', ''))"
    years = lambda x: f"trim(regexp_replace(regexp_replace({x}, '\\b(18|19|20)[0-9]{{2}}\\b', ' ', 'g'), '\\s+', ' ', 'g'))"
    affix = lambda x: suffix(prefix(x))

    def scored(known: str, exact: str, weights: tuple[float, float, float], where: str, alias: str = "cast(null as varchar)") -> str:
        words = "list_distinct(list_filter(string_split({0},' '), lambda w: w <> ''))"
        return f"""select event_id, team_id, case when raw = form then {exact} else round_even(greatest(
              {weights[0]}e0 * len(list_intersect(rw, fw)) / len(list_distinct(list_concat(rw, fw))),
              {weights[1]}e0 * case when contains(raw, form) or contains(form, raw) then least(length(raw), length(form)) / greatest(length(raw), length(form)) else 0 end,
              {weights[2]}e0 * coalesce(list_min(list_filter(range(1, least(len(rs), len(fs)) + 1), lambda i: rs[i] <> fs[i])) - 1, least(len(rs), len(fs))) / greatest(len(rs), len(fs))), 4) end as score, {alias} as alias, raw, form
            from (select *, {words.format('raw')} as rw, {words.format('form')} as fw, string_split(raw,' ') as rs, string_split(form,' ') as fs from raws cross join {known} where raw <> '' and form <> '' {where})"""

    ranked = lambda q: f"select event_id, team_id, canonical_name, score, cast(row_number() over (partition by event_id order by score desc, canonical_name, team_id) as int) as rank from (select event_id, team_id, max(score) as score from ({q}) where score >= 0.45e0 group by 1, 2) join teams using (team_id) qualify rank <= 5"
    by_team = scored("team_forms", "0.98e0", (0.80, 0.88, 0.70), "")
    return [
        ("teams", r.TEAMS), ("events_raw", r.RAW_NAMES),
        ("team_norm", f"select team_id, canonical_name, {_NORMAL.format('canonical_name')} as n from teams"),
        ("team_forms", f"select team_id, {bare('n')} as form from team_norm"),
        ("raws", f"select event_id, 'c' || (event_id % 2) as code, {bare('n')} as raw from (select event_id, {_NORMAL.format('raw_name')} as n from events_raw)"),
        ("bare_names", f"select team_id, n, {years('n')} as b, string_split(n,' ') as ws from team_norm"),
        ("derived", f"""select team_id, unnest([n, b, {prefix('n')}, {suffix('n')}, {affix('n')}, {prefix('b')}, {affix('b')},
            case when len(ws)>=2 then array_to_string(ws[-2:],' ') end, case when len(ws)>=3 then array_to_string(ws[-3:],' ') end]) as a from bare_names"""),
        ("alias_list", f"select distinct team_id, alias from (select team_id, {affix(years('a'))} as alias from derived where a is not null) where length(alias) >= 3"),
        ("alias_forms", f"select team_id, case when team_id % 3 = 0 then 'c' || (team_id % 2) end as scope, alias, {bare('n')} as form from (select team_id, alias, {_NORMAL.format('alias')} as n from alias_list)"),
        ("found", ranked(by_team)),
        ("all_scored", by_team + " union all " + scored("alias_forms", "1e0", (0.85, 0.90, 0.75), "and (scope is null or scope = code)", "alias")),
        ("found_by_alias", ranked("select * from all_scored")),
        ("best_two", "select event_id, team_id, canonical_name, score, round_even(score - coalesce(lead(score) over (partition by event_id order by rank), 0), 4) as margin, rank, count(*) over (partition by event_id) as n from found_by_alias"),
        ("decided", """select event_id, team_id, canonical_name, coalesce(score, 0e0) as score, coalesce(margin, 0e0) as margin, coalesce(n, 0) as n_candidates,
            case when score>=0.95e0 and margin>=0.08e0 then 'approve' when score>=0.78e0 and margin>=0.05e0 then 'approve_provisional' else 'no_match' end as decision
            from events_raw left join (select * from best_two where rank = 1) using (event_id)"""),
    ]


#: Made-up texts of a match's injuries, load and motivation, valid in both engines.
TEXTS = {
    "injuries_home": "case match_id % 5 when 0 then 'A, B' when 1 then ' None ' when 2 then '' when 3 then 'X,, Y ,Z' end",
    "injuries_away": "case match_id % 3 when 0 then 'K' when 1 then '-' else 'Q, R' end",
    "load_home": "case match_id % 4 when 0 then 'high' when 1 then 'medium' when 2 then 'strange' end",
    "load_away": "case match_id % 7 when 0 then 'high' when 1 then 'low' end",
    "motivation_home": "case match_id % 6 when 0 then 'Kampf um den Titel' when 1 then 'ABSTIEG droht' when 2 then '' when 3 then 'Mittelfeld' end",
    "motivation_away": "case match_id % 5 when 0 then 'Cup Final' when 1 then '' end",
}


def texts() -> list[tuple[str, str]]:
    """The forecast's steps with the factors and tags of the text columns."""
    words = "titel|meister|scudetto|treble|ungeschlagen|abstieg|relegation|champions league|championship|cup final|finale|klassenerhalt"
    named = lambda c: f"case when lower(trim(coalesce({c},''))) in ('','none','keine','-') then 0 else len(list_filter(string_split(lower(trim({c})), ','), lambda x: trim(x) <> '')) end"
    wants = lambda c: f"case when regexp_matches(lower(coalesce({c},'')), '{words}') then 0.65e0 else 0.5e0 end"
    worn = lambda c: f"case {c} when 'medium' then 0.03e0 when 'high' then 0.07e0 else 0e0 end"
    steps = dict(forecasts())
    steps["fc1"] = steps["fc1"].replace("from feats", "from (select *, " + ", ".join(f"{q} as {n}" for n, q in TEXTS.items()) + " from feats)")
    steps["fc2"] = f"""select *, case when ih <> 0 or ia <> 0 then greatest(0e0, least(1e0, 0.5e0+(ia-ih)*0.06e0)) end as f_injuries,
        case when coalesce(motivation_home,'') <> '' or coalesce(motivation_away,'') <> '' then greatest(0e0, least(1e0, ({wants('motivation_home')}+1-{wants('motivation_away')})/2)) end as f_motivation,
        case when load_home is not null or load_away is not null then greatest(0e0, least(1e0, 0.5e0+{worn('load_away')}-{worn('load_home')})) end as f_load
        from (select *, {named('injuries_home')} as ih, {named('injuries_away')} as ia from ({steps['fc2']}))"""
    more = (("injuries", "0.12e0"), ("motivation", "0.10e0"), ("load", "0.08e0"))
    steps["fc3"] = steps["fc3"].replace("as n_known", "".join(f" + (f_{k} is not null)::int" for k, _ in more) + " as n_known")
    steps["fc3"] = steps["fc3"].replace("+0.08e0*0.52e0", "+0.08e0*0.52e0" + "".join(f"+coalesce({v}*f_{k},0)" for k, v in more)).replace("+ 0.08e0 +", "+ 0.08e0 " + " ".join(f"+ case when f_{k} is not null then {v} else 0 end" for k, v in more) + " +")
    told = ("load_home = 'high' then 'Hohe Spielplan-Belastung Heim'", "load_away = 'high' then 'Hohe Spielplan-Belastung Auswärts'", "ih >= 2 then 'Mehrere Ausfälle Heim'", "ia >= 2 then 'Mehrere Ausfälle Auswärts'")
    steps["fc17"] = steps["fc17"].replace("'Wenig Datenbasis' end,", "'Wenig Datenbasis' end, " + " ".join(f"case when {t} end," for t in told))
    return list(steps.items())


def forecasts() -> list[tuple[str, str]]:
    odds = "case when home_odds<=1.10e0 then 0.90e0 when home_odds<=1.25e0 then 0.80e0 when home_odds<=1.50e0 then 0.65e0 when home_odds<=2e0 then 0.50e0 when home_odds<=2.5e0 then 0.35e0 when home_odds is not null then 0.20e0 end"
    share = lambda c: f"case when {c} <> '' then {_SHARE.format(c)} end"
    three = lambda f, src: f"select * exclude (p1, p2, p3), {', '.join(f.format(f'p{i}') + f' as p{i}' for i in (1, 2, 3))} from {src}"
    normal, held = "{0}/(p1+p2+p3)", "greatest(0.08e0, least(0.70e0, {0}))"
    before = lambda i: " + ".join(f"(r{j} {'>' if j > i else '>='} r{i})::int" for j in (1, 2, 3) if j != i)
    edge = lambda n: f"round_even({n}_pct/100e0 - fair_{'home' if n == 'win' else n}, 6)"
    value = lambda s: f"coalesce(coalesce(bookmaker_count,0)>=5 and confidence_score>=35 and edge_{s} between 0.03e0 and 0.25e0 and ev_{s} between 0.05e0 and 0.50e0, false)"
    return [
        ("fc1", f"select *, case when home_strength is not null then greatest(0e0, least(1e0, home_strength/100)) end as hs, case when away_strength is not null then greatest(0e0, least(1e0, away_strength/100)) end as aws, {share('home_form')} as sh, {share('away_form')} as sa, {odds} as f_market from feats"),
        ("fc2", "select *, hs/(hs+aws+1e-9) as f_strength, case when sa is not null then (sh+0.5e0)/(sh+sa+1) else sh end as f_form from fc1"),
        ("fc3", """select *, (f_strength is not null)::int + (f_form is not null)::int + 1 + (f_market is not null)::int as n_known,
            (coalesce(0.36e0*f_strength,0)+coalesce(0.22e0*f_form,0)+0.08e0*0.52e0+coalesce(0.04e0*f_market,0)) / (case when f_strength is not null then 0.36e0 else 0 end + case when f_form is not null then 0.22e0 else 0 end + 0.08e0 + case when f_market is not null then 0.04e0 else 0 end) as x from fc2"""),
        ("fc4", "select *, greatest(0.05e0, least(0.90e0, x - case when aws > hs or hs is null then coalesce(greatest(aws - hs, 0e0)*0.25e0, 0) else 0 end)) as home from fc3"),
        ("fc5", "select *, greatest(0.08e0, 0.27e0*exp(-3.5e0*abs(home-0.5e0))) as draw from fc4"),
        ("fc6", "select *, greatest(0.05e0, 1-home-draw) as away, coalesce(home_odds>1 and draw_odds>1 and away_odds>1, false) as ok, 1/home_odds+1/draw_odds+1/away_odds as t from fc5"),
        ("fc7", "select *, case when ok then round_even(1/home_odds/t,6) end as fair_home, case when ok then round_even(1/draw_odds/t,6) end as fair_draw, case when ok then round_even(1/away_odds/t,6) end as fair_away, case when ok then round_even(t,6) end as overround, home+draw+away as mass from fc6"),
        ("fc8", "select *, " + ", ".join(f"case when ok then 0.75e0*({s}/mass)+0.25e0*fair_{s} else {s}/mass end as p{i}" for i, s in ((1, "home"), (2, "draw"), (3, "away"))) + " from fc7"),
        ("fc9", three(normal, "fc8")), ("fc10", three(held, "fc9")), ("fc11", three(normal, "fc10")), ("fc12", three(held, "fc11")), ("fc13", three(normal, "fc12")),
        ("fc14", "select *, " + ", ".join(f"p{i}/(p1+p2+p3)*100e0 as v{i}" for i in (1, 2, 3)) + " from fc13"),
        ("fc15", "select *, " + ", ".join(f"v{i}-floor(v{i}) as r{i}" for i in (1, 2, 3)) + ", 100-floor(v1)-floor(v2)-floor(v3) as rest from fc14"),
        ("fc16", "select *, " + ", ".join(f"cast(floor(v{i}) + ({before(i)} < rest)::int as int) as {n}_pct" for i, n in ((1, "win"), (2, "draw"), (3, "away"))) + " from fc15"),
        ("fc17", """select *, case when win_pct>=away_pct and win_pct>=draw_pct then 'home' when away_pct>=win_pct and away_pct>=draw_pct then 'away' else 'draw' end as predicted_winner, greatest(win_pct, draw_pct, away_pct) as top,
            list_filter([case when n_known<=2 then 'Wenig Datenbasis' end, case when abs(sh-sa)<0.15e0 then 'Ausgeglichene Form' end, case when abs(hs-aws)<0.10e0 then 'Ausgeglichene Stärke' end,
              case when abs(win_pct/100e0-fair_home)>0.18e0 then 'Starke Abweichung zum Markt Heim' end, case when abs(away_pct/100e0-fair_away)>0.18e0 then 'Starke Abweichung zum Markt Auswärts' end], lambda t: t is not null) as tags from fc16"""),
        ("fc18", f"""select *, top>=70 as is_strong_tip, case when len(tags)>=3 or n_known<=1 then 'high' when len(tags)>=1 then 'medium' else 'low' end as risk_level, array_to_string(tags, ',') as risk_tags,
            cast(floor(greatest(0e0, least(1e0, n_known/7*0.5e0 + abs(top-50)/50*0.4e0 - len(tags)*0.05e0))*100) as int) as confidence_score,
            {edge('win')} as edge_home, {edge('draw')} as edge_draw, {edge('away')} as edge_away,
            case when home_odds>1 then round_even(win_pct/100e0*home_odds-1,6) end as ev_home, case when draw_odds>1 then round_even(draw_pct/100e0*draw_odds-1,6) end as ev_draw, case when away_odds>1 then round_even(away_pct/100e0*away_odds-1,6) end as ev_away from fc17"""),
        ("fc19", f"select *, {value('home')} as value_home, {value('draw')} as value_draw, {value('away')} as value_away from fc18"),
        ("forecast", """select match_id, win_pct, draw_pct, away_pct, confidence_score, predicted_winner, is_strong_tip, risk_level, risk_tags, fair_home, fair_draw, fair_away, overround, edge_home, edge_draw, edge_away, ev_home, ev_draw, ev_away, value_home, value_draw, value_away,
            case when value_home and (not value_draw or ev_home>=ev_draw) and (not value_away or ev_home>=ev_away) then 'home' when value_draw and (not value_away or ev_draw>=ev_away) then 'draw' when value_away then 'away' end as top_value from fc19"""),
    ]


_RANKING = """count(*) as matches_evaluated, cast(sum(points) as bigint) as total_points, round(sum(points)/count(*), 2) as avg_points,
  count(*) filter (points=4) as exact_hits, round(100e0*count(*) filter (points=4)/count(*), 1) as exact_rate,
  count(*) filter (points=2) as tendency_hits, round(100e0*count(*) filter (points=2)/count(*), 1) as tendency_rate,
  count(*) filter (points=0) as wrong_predictions, round(100e0*count(*) filter (points in (2,4))/count(*), 1) as score_accuracy"""


def sql() -> dict[str, str]:
    res, feats = _with(*results()), _with(*features())
    mod = _with(*features(), *models())
    hist = "select match_id, model_key, competition_code, kickoff_at, predicted_score, actual_score, points, outcome_label, confidence_score, cast(kickoff_at as date) as match_date from results where model_key='ensemble'"
    rounded = lambda m: f"select match_id, winner, score, confidence, round(ph,6) as prob_home, round(pd,6) as prob_draw, round(pa,6) as prob_away from m_{m}"
    classes = "select 'H' as class, round(prob_home,4) as p, actual_1x2='H' as hit from results where model_key='dc' union all select 'D', round(prob_draw,4), actual_1x2='D' from results where model_key='dc' union all select 'A', round(prob_away,4), actual_1x2='A' from results where model_key='dc'"
    out = {
        "model_rankings": res + f"select model_key, model_version, {_RANKING} from results group by 1, 2",
        "model_rankings_merged": res + f"select model_key, {_RANKING} from results group by 1",
        "eval_summary": res + """select model_key, model_version, count(*) as matches_evaluated, round(avg(points),3) as avg_kicktipp_points, count(*) filter (points=4) as exact_score_hits, count(*) filter (points=2) as tendency_hits_kicktipp,
            count(*) filter (is_exact_hit) as exact_hits, count(*) filter (is_tendency_hit) as tendency_hits, round(100e0*count(*) filter (is_tendency_hit)/count(is_tendency_hit),1) as tendency_hit_rate_pct, round(100e0*count(*) filter (is_exact_hit)/count(is_exact_hit),1) as exact_hit_rate_pct,
            round(avg(score_error_abs),3) as avg_score_error, round(avg(goal_diff_error),3) as avg_goal_diff_error, round(avg(brier_score_1x2),4) as avg_brier_score, round(avg(log_loss_1x2),4) as avg_log_loss,
            count(*) filter (actual_1x2='H') as actual_home_wins, count(*) filter (actual_1x2='D') as actual_draws, count(*) filter (actual_1x2='A') as actual_away_wins from results group by 1, 2""",
        "backtest": res + "select match_id, model_key, predicted_score, predicted_winner, confidence_score, points, outcome_label, predicted_1x2, actual_1x2, is_exact_hit, is_tendency_hit, score_error_abs, goal_diff_error, cast(floor((brier_score_1x2 + 3.7e-7) * 100) as bigint) as brier_percent, log_loss_1x2 from results",
        "history": res + hist,
        "history_days": res + f"select match_date, count(*) as match_count, count(*) filter (outcome_label='exact') as exact_count, count(*) filter (outcome_label='goal_diff') as goal_diff_count, count(*) filter (outcome_label='tendency') as tendency_count, count(*) filter (outcome_label='wrong') as wrong_count, round(100e0*count(*) filter (outcome_label<>'wrong')/count(*),1) as hit_rate from ({hist}) group by 1",
        "kpi_strip": res + "select count(*) as n, count(*) filter (outcome_label='exact') as exact, count(*) filter (outcome_label='goal_diff') as goal_diff, count(*) filter (outcome_label='tendency') as tendency, count(*) filter (outcome_label='wrong') as wrong, cast(floor(100e0*count(*) filter (outcome_label<>'wrong')/count(*)+0.5e0) as bigint) as hit_rate, cast(floor(100e0*count(*) filter (outcome_label='exact')/count(*)+0.5e0) as bigint) as exact_rate from results where model_key='ensemble'",
        "weighted_consensus": res + """, v as (select match_id, predicted_score, sum(case model_key when 'ensemble' then 3 when 'market' then 1 else 2 end) as w, min(case model_key when 'ensemble' then 0 when 'poisson' then 1 when 'elo' then 2 when 'dc' then 3 else 4 end) as f, count(*) as n_models from results group by 1, 2)
            select match_id, predicted_score as score, n_models, round(w/sum_w,6) as share, case when round(w/sum_w,6)>=0.55e0 then 'strong' when round(w/sum_w,6)>=0.35e0 then 'moderate' else 'weak' end as band from (select *, sum(w) over (partition by match_id) as sum_w from v) qualify row_number() over (partition by match_id order by w desc, f) = 1""",
        "majority_vote": res + """, v as (select match_id, predicted_winner as winner, count(*) as n_models from results group by 1, 2) select match_id, winner, n_models, n_models>=3 as is_strong from v qualify row_number() over (partition by match_id order by n_models desc, case winner when 'home' then 0 when 'draw' then 1 else 2 end) = 1""",
        "team_strength": feats + "select match_id, home_strength, away_strength, home_venue, away_venue, home_n_prior, away_n_prior from feats",
        "team_form_last5": feats + "select match_id, home_form, away_form from feats",
        "cross_season_flag": _with(*features(r.MATCHES_MULTI)) + "select match_id, home_crosses_year, away_crosses_year from feats",
        "feature_coverage": feats + "select count(*) as n_matches, count(*) filter (home_strength is not null and away_strength is not null) as with_strength, count(*) filter (home_form<>'' and away_form<>'') as with_form, count(*) filter (home_strength is null or away_strength is null) as fallback, count(*) filter (home_venue is not null and away_venue is not null) as with_venue, count(*) filter (home_crosses_year or away_crosses_year) as cross_season from feats",
        **{f"model_{m}": mod + rounded(m) for m in ("poisson", "dc", "elo", "market", "ensemble")},
        **{f"client_{m}": mod + q for m, q in clients().items()},
        "reliability_curve": res + f", c as ({classes}) select class, cast(least(floor(p*10),9) as int) as bucket, round((least(floor(p*10),9)+0.5e0)/10,3) as mid, count(*) as n, round(avg(p),4) as mean_p, round(avg(hit::int),4) as hit_rate, round(avg(hit::int)-avg(p),4) as gap from c group by 1, 2, 3",
        "temperature_fit": res + f""", c as ({classes}), g as (select class, i, round(0.5e0+2*i/50,3) as t, p, hit from c, range(51) r(i)),
            q as (select class, t, case when t=1e0 then p else exp(ln(least(greatest(p,1e-7),1-1e-7))/t) end as q, hit from g),
            l as (select class, t, count(*) as n, round(avg(case when hit then -ln(least(greatest(q,1e-7),1-1e-7)) else -ln(1-least(greatest(q,1e-7),1-1e-7)) end),9) as loss from q group by 1, 2)
            select class, n as n_samples, case when n<200 then 1e0 else t end as temperature, round(loss,6) as loss from l qualify row_number() over (partition by class order by loss, t) = 1""",
        "forecast": _with(*features(), *forecasts()) + "select * from forecast",
        "forecast_kpis": _with(*features(), *forecasts()) + "select count(*) as total, count(*) filter (is_strong_tip) as strong, cast(floor(avg(confidence_score)+0.5e0) as bigint) as mean_confidence, count(*) filter (risk_level='high') as risky from forecast",
        "name_candidates": _with(*resolver()) + "select * from found",
        "alias_candidates": _with(*resolver()) + "select * from found_by_alias",
        "alias_generate": _with(*resolver()) + "select team_id, alias from alias_list",
        "resolver_decisions": _with(*resolver()) + "select event_id, team_id, score, margin, decision from decided",
        "resolver_effects": _with(*resolver()) + f"""select e.event_id, coalesce(decision,'no_match') as decision, case when decision<>'no_match' then team_id end as team_id, {_NORMAL.format('raw_name')} as alias_normalized,
            case decision when 'approve_provisional' then 'scoped' when 'approve' then 'global' end as alias_scope, case when coalesce(decision,'no_match')='no_match' then 'ignored' else 'resolved' end as status from events_raw e left join decided using (event_id)""",
        "devig_market": _with(("matches", r.MATCHES)) + "select match_id, " + ", ".join(f"case when home_odds>1 and draw_odds>1 and away_odds>1 then round_even({x}, 6) end as {n}" for n, x in (("fair_home", "1/home_odds/(1/home_odds+1/draw_odds+1/away_odds)"), ("fair_draw", "1/draw_odds/(1/home_odds+1/draw_odds+1/away_odds)"), ("fair_away", "1/away_odds/(1/home_odds+1/draw_odds+1/away_odds)"), ("overround", "1/home_odds+1/draw_odds+1/away_odds"))) + " from matches",
        "odds_consensus": _with(("snaps", r.ODDS_SNAPSHOTS), ("last", "select * from snaps qualify row_number() over (partition by match_id, bookmaker_id order by snapshot_ts desc, seq desc, home_odds desc, draw_odds desc, away_odds desc) = 1")) + "select match_id, round(median(home_odds),6) as median_home_odds, round(median(draw_odds),6) as median_draw_odds, round(median(away_odds),6) as median_away_odds, count(distinct bookmaker_id) as bookmaker_count from last group by 1",
        "refresh_changed_only": _with(("a", "select o_orderkey as match_id, o_orderstatus as status, o_orderpriority as code from orders"), ("b", "select o_orderkey as match_id, case when o_orderpriority like '1%' then 'X' else o_orderstatus end as status, case when o_orderstatus = 'P' then null else o_orderpriority end as code from orders")) + "select b.* from a join b using (match_id) where a.status is distinct from b.status or a.code is distinct from b.code",
        "upsert_merge": _with(("a", "select o_orderkey as k, o_orderstatus as status, o_totalprice as price from orders where o_orderstatus <> 'F'"), ("b", "select o_orderkey as k, 'N' as status, o_totalprice+1 as price from orders where o_orderstatus <> 'O'")) + "select coalesce(a.k,b.k) as k, case when b.k is null then a.status else b.status end as status, case when a.k is null then b.price else a.price end as price from a full outer join b on a.k=b.k",
        "insert_if_absent": "select c_custkey as k, 'P' as status, c_name as name from customer where not exists (select 1 from orders where o_custkey = c_custkey and o_orderstatus = 'P')",
        "dirty_semi_join": "select o_orderkey, o_custkey from orders where exists (select 1 from lineitem where l_orderkey=o_orderkey and l_returnflag='R')",
        "unresolved_anti_join": "select c_custkey, c_nationkey from customer where not exists (select 1 from nation where n_nationkey=c_nationkey and n_regionkey<>1)",
        "event_time_match": _with(("matches", r.MATCHES), ("e", "select match_id+1000000 as event_id, competition_code, home_team_id, away_team_id, case when match_id % 13 = 0 then null else kickoff_at + to_minutes(cast(match_id % 300 as bigint)) end as at from matches")) + "select m.match_id, min(e.event_id) as event_id from matches m join e on e.competition_code=m.competition_code and (e.home_team_id=m.home_team_id) and (e.away_team_id=m.away_team_id) and (e.at is null or abs(epoch_us(e.at)-epoch_us(m.kickoff_at)) <= 10800000000) group by 1",
        "standings_strength": _with(("s", r.STANDINGS)) + "select comp_id, team_id, cast(greatest(0, least(100, round_even(35+55*case when hi>lo then (hi-position)/(hi-lo) else 0.5e0 end + least(points/10, 10), 0))) as int) as strength from (select *, min(position) over (partition by comp_id) as lo, max(position) over (partition by comp_id) as hi from s)",
        "name_normalise": "select p_partkey, trim(regexp_replace(regexp_replace(replace(replace(lower(trim(p_name)),'-',' '),'/',' '),'[^a-z0-9\\s]','','g'),'\\s+',' ','g')) as normal from part",
        "league_chips": _with(("matches", r.MATCHES)) + "select competition_code, count(*) as n_matches, cast(min(kickoff_at) as timestamp) as first_kickoff from matches group by 1",
        "matches_by_day": _with(("matches", r.MATCHES)) + "select strftime(kickoff_at,'%Y-%m-%d') as day, count(*) as n_matches, cast(sum(home_goals+away_goals) as bigint) as goals from matches group by 1",
        "search_filter": "select p_partkey, p_name from part where contains(lower(p_name),'an') or contains(lower(p_type),'an')",
        "season_mode": _with(("matches", r.MATCHES_MULTI)) + "select cast(year(kickoff_at) as int) as season, count(*) as n_matches from matches group by 1 order by 2 desc, 1 limit 1",
        "last_wins": "select o_custkey, o_orderkey, o_totalprice, min(o_orderkey) over (partition by o_custkey) as first_o_orderkey from orders qualify row_number() over (partition by o_custkey order by o_orderkey desc) = 1",
        "day_navigation": _with(("d", "select distinct cast(ts as date) as match_date from events")) + "select match_date, lag(match_date) over (order by match_date) as previous_day, lead(match_date) over (order by match_date) as next_day from d",
        "json_flatten": "select event_id, cast(json_extract_string(props,'$.k') as bigint) as k from events",
    }
    return out
