"""Match data derived from the star-schema tables; the SQL is valid in Spark and in DuckDB."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

MATCHES = """select event_id as match_id, ts as kickoff_at, event_type as competition_code,
  user_id % 20 + 1 as home_team_id,
  (user_id % 20 + 1 + cast(floor(value) as bigint) % 19) % 20 + 1 as away_team_id,
  cast(floor(value*100) as bigint) % 5 as home_goals,
  cast(floor(value*10)  as bigint) % 4 as away_goals,
  case when event_id % 7  = 0 then null else 1.05e0 + (event_id*37 % 400)/100e0 end as home_odds,
  case when event_id % 5  = 0 then null else 2.5e0  + (event_id*53 % 200)/100e0 end as draw_odds,
  case when event_id % 11 = 0 then null else 1.05e0 + (event_id*71 % 600)/100e0 end as away_odds,
  event_id % 12 as bookmaker_count
from events"""

MATCHES_MULTI = """select o_orderkey as match_id, o_orderdate as kickoff_at, o_orderpriority as competition_code,
  o_custkey % 20 + 1 as home_team_id,
  (o_custkey % 20 + 1 + cast(floor(o_totalprice) as bigint) % 19) % 20 + 1 as away_team_id,
  cast(floor(o_totalprice*100) as bigint) % 5 as home_goals,
  cast(floor(o_totalprice*10)  as bigint) % 4 as away_goals
from orders"""

ODDS_SNAPSHOTS = """select l_orderkey as match_id, l_suppkey % 12 as bookmaker_id, l_shipdate as snapshot_ts,
  l_linenumber as seq, 1.05e0 + l_quantity/10e0 as home_odds,
  2.5e0 + l_discount*10e0 as draw_odds, 1.05e0 + l_tax*20e0 as away_odds
from lineitem"""

STANDINGS = """select c_nationkey as comp_id, c_custkey as team_id,
  cast(row_number() over (partition by c_nationkey order by c_acctbal desc, c_custkey) as int) as position,
  cast(greatest(floor(c_acctbal/100e0),0) as bigint) as points
from customer"""

TEAMS = """select min(p_partkey) as team_id, p_name as canonical_name from part group by p_name"""

RAW_NAMES = """select p_partkey as event_id,
  case when p_partkey % 3 = 0 then concat('FC ', p_name)
       when p_partkey % 3 = 1 then concat(p_name, ' 1909')
       else split_part(p_name, ' ', 1) end as raw_name
from part"""

COMPETITIONS = """select case n_nationkey when 1 then 'PREMIER_LEAGUE' when 2 then 'SERIE_A' when 3 then 'LIGUE_1' else n_name end as competition_code,
  concat('Region ', cast(n_regionkey as string), ' League ', cast(n_nationkey as string)) as competition_name,
  concat('N', cast(n_nationkey as string)) as league_abbr, concat('Land ', cast(n_regionkey as string)) as country
from nation"""

COMPETITION_EVENTS = """select c_custkey as event_id, 'odds_api' as source_system,
  case when c_custkey % 4 = 0 then concat('nation_', cast(c_nationkey as string)) when c_custkey % 4 = 1 then concat('soccer_', lower(c_mktsegment), '_region_', cast(c_nationkey as string)) else concat('x', cast(c_custkey as string)) end as external_code,
  case when c_custkey % 6 = 0 then concat('N', cast(c_nationkey as string)) when c_custkey % 6 = 1 then 'England Premier-League' when c_custkey % 6 = 2 then null when c_custkey % 6 = 3 then concat('Region Cup ', cast(c_nationkey as string)) else c_mktsegment end as external_name
from customer"""

_TEAM = "concat(case {0} % 4 when 0 then 'North Kings ' when 1 then 'South United ' when 2 then 'East City ' else 'West ' end, cast({0} as string))"

NAMED_MATCHES = f"""select match_id, competition_code, concat('sport_', competition_code) as sport_key, kickoff_at,
  {_TEAM.format('home_team_id')} as home_team, {_TEAM.format('away_team_id')} as away_team from ({MATCHES}) as m"""

_VARIANT = "case match_id % 4 when 0 then {0} when 1 then concat({0}, ' SV') when 2 then replace({0}, 'Kings', 'Town') else concat('The ', {0}, ' Rovers') end"

API_EVENTS = f"""select match_id + 1000000 as event_id, sport_key, case when match_id % 997 = 0 then null else kickoff_at end as kickoff_at,
  {_VARIANT.format('home_team')} as home_team, {_VARIANT.format('away_team')} as away_team from ({NAMED_MATCHES}) as n"""

TEAM_ALIASES = """select concat('north town ', cast(n_nationkey as string)) as alias_normalized, concat('north kings ', cast(n_nationkey as string)) as canonical_normalized,
  case when n_nationkey % 5 = 0 then 'other' end as source_system, case when n_nationkey % 3 = 0 then 'click' end as competition_code
from nation"""

_FROM = {"matches": (MATCHES, "events"), "matches_multi": (MATCHES_MULTI, "orders"), "odds_snapshots": (ODDS_SNAPSHOTS, "lineitem"), "standings": (STANDINGS, "customer"), "teams": (TEAMS, "part"), "raw_names": (RAW_NAMES, "part"),
    "competitions": (COMPETITIONS, "nation"), "competition_events": (COMPETITION_EVENTS, "customer"), "named_matches": (NAMED_MATCHES, "events"), "api_events": (API_EVENTS, "events"), "team_aliases": (TEAM_ALIASES, "nation")}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def relation(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A derived relation by name."""
    sql, base = _FROM[name]
    return spark.sql(sql.replace(f"from {base}", f"from {{{base}}}"), **{base: table(spark, sf_dir, base)})
