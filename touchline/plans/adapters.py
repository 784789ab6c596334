"""Views that turn the given tables into contests, a bet ledger and model rates.

The same SQL text runs on Spark and in the SQL check; only the JSON access differs.
"""

from __future__ import annotations

import functools

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import configure

SPARK_K = "CAST(get_json_object(props, '$.k') AS BIGINT)"
CHECK_K = "CAST(json_extract_string(props, '$.k') AS BIGINT)"

CONTESTS = """
SELECT event_id AS match_id, event_type AS league,
 concat('S', CAST(1 + CAST(floor((extract(day FROM ts) - 1) / 10) AS INT) AS STRING)) AS season,
 ts AS match_date,
 concat(event_type, '-', CAST(user_id % 20 AS STRING)) AS home_team,
 concat(event_type, '-', CAST((user_id % 20 + 1 + event_id % 19) % 20 AS STRING)) AS away_team,
 CAST(floor(value) AS BIGINT) % 5 AS home_goals, event_id % 4 AS away_goals,
 CASE WHEN event_id % 37 = 0 THEN NULL ELSE {K} % 12 END AS home_corners,
 CASE WHEN event_id % 37 = 0 THEN NULL ELSE event_id % 11 END AS away_corners,
 (event_id * 7) % 6 AS home_cards, (event_id * 3) % 5 AS away_cards,
 {K} AS home_shots, event_id % 17 AS away_shots,
 CASE WHEN event_id % 50 = 0 THEN NULL ELSE concat('R', CAST(event_id % 25 AS STRING)) END AS referee,
 CASE WHEN event_id % 10 = 0 THEN 'SCHEDULED' ELSE 'FT' END AS status
FROM events
"""

LEDGER = """
SELECT o.o_orderkey AS bet_id, o.o_orderkey % 997 AS match_id, c.c_mktsegment AS league, o.o_orderpriority AS market,
 CASE o.o_orderkey % 7 WHEN 0 THEN 'home_win' WHEN 1 THEN 'draw' WHEN 2 THEN 'away_win' WHEN 3 THEN 'over_2_5'
   WHEN 4 THEN 'btts_yes' WHEN 5 THEN 'corn_o75' ELSE 'unknown_mkt' END AS market_key,
 ((o.o_orderkey * 7919) % 1001) / CAST(1000 AS DOUBLE) AS probability,
 CASE o.o_orderstatus WHEN 'F' THEN 'WON' WHEN 'O' THEN 'LOST' ELSE 'VOID' END AS outcome,
 1.0E0 + (CAST(floor(o.o_totalprice) AS BIGINT) % 500) / CAST(100 AS DOUBLE) AS odds,
 concat('TIER_', substring('ABCD', CAST(1 + o.o_orderkey % 4 AS INT), 1)) AS tier,
 concat('v', CAST(o.o_custkey % 3 AS STRING)) AS model_version,
 CAST(10 AS DOUBLE) AS stake, o.o_orderdate AS ts
FROM orders o JOIN customer c ON o.o_custkey = c.c_custkey
"""

RATES = """
SELECT event_id AS match_id, event_type AS league,
 CAST(2 + event_id % 33 AS DOUBLE) / 10 AS home_xg, CAST(2 + (event_id * 5) % 33 AS DOUBLE) / 10 AS away_xg,
 CAST(30 + event_id % 40 AS DOUBLE) / 10 AS mu_home_corners, CAST(25 + (event_id * 3) % 40 AS DOUBLE) / 10 AS mu_away_corners,
 CAST(20 + event_id % 45 AS DOUBLE) / 10 AS mu_cards
FROM events
"""

TEAM = """
SELECT match_id, league, season, match_date, home_team AS team, away_team AS opponent, 1 AS is_home,
 home_goals AS goals_for, away_goals AS goals_against, home_corners AS corners_for, away_corners AS corners_against,
 home_cards AS cards_for, away_cards AS cards_against, home_shots AS shots_for, away_shots AS shots_against,
 CASE WHEN home_goals > away_goals THEN 3 WHEN home_goals = away_goals THEN 1 ELSE 0 END AS points FROM contests
UNION ALL
SELECT match_id, league, season, match_date, away_team, home_team, 0,
 away_goals, home_goals, away_corners, home_corners, away_cards, home_cards, away_shots, home_shots,
 CASE WHEN away_goals > home_goals THEN 3 WHEN home_goals = away_goals THEN 1 ELSE 0 END FROM contests
"""

CHECK_VIEWS = {
    "contests": CONTESTS.replace("{K}", CHECK_K),
    "ledger": LEDGER,
    "rates": RATES,
    "team": TEAM,
}


def check_sql(body: str) -> str:
    """Prefix a SQL text with the views it names."""
    needed = [v for v in ("contests", "ledger", "rates", "team") if v in body]
    if "team" in needed and "contests" not in needed:
        needed.insert(0, "contests")
    ctes = ", ".join(f"{v} AS ({CHECK_VIEWS[v].strip()})" for v in needed)
    body = body.strip()
    if not ctes:
        return body
    if body.upper().startswith("WITH RECURSIVE "):
        return f"WITH RECURSIVE {ctes}, {body[15:]}"
    if body.upper().startswith("WITH "):
        return f"WITH {ctes}, {body[5:]}"
    return f"WITH {ctes} {body}"


class Tables:
    """The given tables and the adapter views over one scale-factor folder."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark = configure(spark)
        self.sf_dir = sf_dir

    def __call__(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")

    def _sql(self, text: str, **frames: DataFrame) -> DataFrame:
        # spark.sql with frames as arguments leaves no temp view behind
        for name in frames:
            text = text.replace(f"FROM {name}", f"FROM {{{name}}}").replace(f"JOIN {name}", f"JOIN {{{name}}}")
        return self.spark.sql(text, **frames)

    @functools.cached_property
    def contests(self) -> DataFrame:
        df = self._sql(CONTESTS.replace("{K}", SPARK_K), events=self("events"))
        return df.withColumn("match_date", F.col("match_date").cast("timestamp"))

    @functools.cached_property
    def ledger(self) -> DataFrame:
        df = self._sql(LEDGER, orders=self("orders"), customer=self("customer"))
        return df.withColumn("ts", F.col("ts").cast("timestamp"))

    @functools.cached_property
    def rates(self) -> DataFrame:
        return self._sql(RATES, events=self("events"))

    @functools.cached_property
    def team(self) -> DataFrame:
        from ..operators.features import team_rows

        return team_rows(self.contests)
