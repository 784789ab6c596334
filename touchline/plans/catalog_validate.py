"""Queries over projections, filters, expectations and guards."""

import datetime as dt

from pyspark.sql import functions as F

from ..functions import scalars as x
from ..operators import features as ft
from ..operators import validate as v
from .registry import micros, query, r6, rounded

AS_OF = dt.datetime(2024, 1, 20, tzinfo=dt.UTC)
NOW = dt.datetime(2024, 1, 17, 12, 30, tzinfo=dt.UTC)


@query("p01_drop_matching", "SELECT o_orderkey, o_custkey, o_orderstatus, o_totalprice FROM orders")
def _(t):
    wide = t("orders").withColumns({"B365H": F.col("o_totalprice"), "AvgA": F.col("o_totalprice")})
    return v.drop_matching(wide, v.BOOKMAKER_COLUMNS + "|date$|priority$")


@query(
    "p02_conform",
    """SELECT match_id, league, season, home_team, away_team, CAST(home_goals AS INT) AS home_goals, CAST(away_goals AS INT) AS away_goals,
 CAST(home_corners AS DOUBLE) AS home_corners, CAST(away_corners AS DOUBLE) AS away_corners, coalesce(referee, '-') AS referee,
 CAST(NULL AS DOUBLE) AS attendance, epoch_us(match_date) AS date_us FROM contests""",
)
def _(t):
    raw = t.contests.withColumnsRenamed({"match_date": "Date", "home_goals": "FTHG", "away_goals": "FTAG", "home_corners": "HC"})
    out = v.conform(raw, v.CANONICAL, {"match_date": ["Date"], "home_goals": ["HG", "FTHG"], "away_goals": ["FTAG"], "home_corners": ["HC"]})
    return out.withColumns({"date_us": micros("match_date"), "referee": F.coalesce("referee", F.lit("-"))}).drop("match_date")


@query(
    "p03_parse_dates",
    """SELECT event_id, epoch_us(date_trunc('day', ts)) AS day_us FROM events WHERE event_id % 5 <> 4""",
)
def _(t):
    day = F.date_format
    kind = F.col("event_id") % 5
    text = (
        F.when(kind == 0, day("ts", "dd/MM/yyyy"))
        .when(kind == 1, day("ts", "dd/MM/yy"))
        .when(kind == 2, day("ts", "yyyy-MM-dd"))
        .when(kind == 3, day(F.date_trunc("DAY", "ts"), "yyyy-MM-dd HH:mm:ss"))
        .otherwise("32/13/20")
    )
    out = v.parse_dates(t("events").select("event_id", text.alias("day")), "day")
    return out.select("event_id", micros("day").alias("day_us"))


@query(
    "p04_coerce",
    """SELECT event_id, value, TRY_CAST(CASE WHEN event_id % 3 = 0 THEN 'n/a' ELSE CAST(event_id AS VARCHAR) END AS DOUBLE) AS extra
FROM events WHERE event_id % 7 <> 0""",
)
def _(t):
    raw = t("events").select(
        "event_id",
        F.when(F.col("event_id") % 7 == 0, "abandoned").otherwise(F.col("value").cast("string")).alias("value"),
        F.when(F.col("event_id") % 3 == 0, "n/a").otherwise(F.col("event_id").cast("string")).alias("extra"),
    )
    return v.coerce(raw, ["value", "extra"], required=["value"])


@query(
    "p05_sum_skip_null",
    """SELECT match_id, CAST(CASE WHEN y IS NULL AND r IS NULL THEN NULL ELSE coalesce(y, 0) + coalesce(r, 0) END AS DOUBLE) AS cards
FROM (SELECT match_id, CASE WHEN match_id % 3 = 0 THEN NULL ELSE home_cards END AS y, CASE WHEN match_id % 5 = 0 THEN NULL ELSE away_cards END AS r FROM contests)""",
)
def _(t):
    raw = t.contests.select(
        "match_id",
        F.when(F.col("match_id") % 3 != 0, F.col("home_cards")).alias("yellow"),
        F.when(F.col("match_id") % 5 != 0, F.col("away_cards")).alias("red"),
    )
    return raw.select("match_id", x.sum_skip_null("yellow", "red").cast("double").alias("cards"))


@query(
    "p06_safe_ratio",
    """SELECT match_id, round(home_goals / nullif(home_shots, 0), 6) AS accuracy,
 round(home_shots / nullif(home_shots + away_shots, 0), 6) AS pressure FROM contests""",
)
def _(t):
    both = F.col("home_shots") + F.col("away_shots")
    return t.contests.select(
        "match_id",
        r6(x.safe_ratio("home_goals", "home_shots")).alias("accuracy"),
        r6(x.safe_ratio(F.col("home_shots"), both)).alias("pressure"),
    )


@query(
    "p07_sanitize",
    """SELECT match_id, upper(home_team) AS home_team, away_up AS away_team, match_id % 11 <> 0 AS clean
FROM (SELECT *, CASE WHEN match_id % 11 = 0 THEN upper(away_team) || ';' ELSE upper(away_team) END AS away_up FROM contests)""",
)
def _(t):
    dirty = t.contests.select(
        "match_id",
        F.concat(F.lit("  "), "home_team", F.lit("\x07 ")).alias("home_team"),
        F.when(F.col("match_id") % 11 == 0, F.concat("away_team", F.lit(";"))).otherwise(F.col("away_team")).alias("away_team"),
    )
    good, bad = v.sanitize(dirty)
    return good.withColumn("clean", F.lit(True)).unionByName(bad.withColumn("clean", F.lit(False)))


@query("p08_drop_future", "SELECT match_id FROM contests WHERE match_date <= TIMESTAMP '2024-01-20 00:00:00'")
def _(t):
    return v.drop_future(t.contests, AS_OF).select("match_id")


@query(
    "p09_finished_only",
    "SELECT match_id FROM contests WHERE status IN ('FT', 'AET', 'FINISHED') AND match_date < TIMESTAMP '2024-01-20 00:00:00'",
)
def _(t):
    return v.finished_only(t.contests, AS_OF).select("match_id")


def _range_sql(name, low, high, finished=False):
    end = f"AND match_date < TIMESTAMP '{high}'" if high else ""
    keep = "" if finished else "AND status NOT IN ('FT', 'AET', 'FINISHED')"
    return f"SELECT '{name}' AS span, match_id FROM contests WHERE match_date >= TIMESTAMP '{low}' {end} {keep}"


# Wednesday 17 January 2024, 12:30 UTC; New York is five hours behind.
SPANS = {
    ("yesterday", "UTC"): ("2024-01-16", "2024-01-17", True),
    ("today", "UTC"): ("2024-01-17", "2024-01-18", False),
    ("tomorrow", "UTC"): ("2024-01-18", "2024-01-19", False),
    ("weekend", "UTC"): ("2024-01-19", "2024-01-22", False),
    ("week", "UTC"): ("2024-01-17", "2024-01-20", False),
    ("month", "UTC"): ("2024-01-17", "2024-02-16", False),
    ("all", "UTC"): ("2024-01-15", None, False),
    ("monday", "UTC"): ("2024-01-22", "2024-01-23", False),
    ("wednesday", "UTC"): ("2024-01-17", "2024-01-18", False),
    ("today", "America/New_York"): ("2024-01-17 05:00:00", "2024-01-18 05:00:00", False),
}


@query(
    "p10_date_filter",
    " UNION ALL ".join(
        _range_sql(f"{n} {tz}", *(b if not b or len(b) > 10 else b + " 00:00:00" for b in bounds[:2]), bounds[2])
        for (n, tz), bounds in SPANS.items()
    ),
)
def _(t):
    out = None
    for name, tz in SPANS:
        part = v.date_filter(t.contests, name, NOW, tz).select(F.lit(f"{name} {tz}").alias("span"), "match_id")
        out = part if out is None else out.unionByName(part)
    return out


@query(
    "p11_expectations",
    """WITH o AS (SELECT * FROM orders), d AS (SELECT o_custkey, o_orderdate FROM orders GROUP BY 1, 2 HAVING count(*) > 1)
SELECT 'price_not_negative' AS rule, count(*) FILTER (o_totalprice < 1000) AS violations, coalesce(min(CAST(o_orderkey AS VARCHAR)) FILTER (o_totalprice < 1000), '-') AS sample FROM o
UNION ALL SELECT 'status_known', count(*) FILTER (o_orderstatus NOT IN ('F', 'O')), coalesce(min(CAST(o_orderkey AS VARCHAR)) FILTER (o_orderstatus NOT IN ('F', 'O')), '-') FROM o
UNION ALL SELECT 'priority_not_empty', count(*) FILTER (length(trim(o_orderpriority)) = 0), coalesce(min(CAST(o_orderkey AS VARCHAR)) FILTER (length(trim(o_orderpriority)) = 0), '-') FROM o
UNION ALL SELECT 'settled_has_price', count(*) FILTER (o_orderstatus = 'F' AND o_totalprice IS NULL), coalesce(min(CAST(o_orderkey AS VARCHAR)) FILTER (o_orderstatus = 'F' AND o_totalprice IS NULL), '-') FROM o
UNION ALL SELECT 'unique_key', count(*), coalesce(min(CAST(o_custkey AS VARCHAR) || '|' || CAST(epoch_us(o_orderdate) AS VARCHAR)), '-') FROM d""",
)
def _(t):
    rules = {
        "price_not_negative": F.col("o_totalprice") >= 1000,
        "status_known": F.col("o_orderstatus").isin("F", "O"),
        "priority_not_empty": F.length(F.trim("o_orderpriority")) > 0,
        "settled_has_price": (F.col("o_orderstatus") != "F") | F.col("o_totalprice").isNotNull(),
    }
    rows = t("orders").withColumn("day_us", micros(F.col("o_orderdate").cast("timestamp")))
    out = v.expect(rows, rules, unique=["o_custkey", "day_us"], sample="o_orderkey")
    return out.withColumn("sample", F.coalesce("sample", F.lit("-")))


HASHED = """SELECT match_id, league, match_date, home_team, away_team,
 CASE WHEN match_id % 4 = 0 THEN 'bad-' || CAST(match_id AS VARCHAR) ELSE substring(md5(CAST(match_id AS VARCHAR)), 1, 16) END AS match_hash FROM contests"""


@query(
    "p12_repair_key",
    f"""WITH h AS ({HASHED}) SELECT match_id, CASE WHEN regexp_full_match(match_hash, '[a-fA-F0-9]{{16}}') THEN match_hash
 ELSE substring(md5(league || strftime(match_date, '%Y%m%d') || upper(home_team) || upper(away_team)), 1, 16) END AS match_hash FROM h""",
)
def _(t):
    bad = F.concat(F.lit("bad-"), F.col("match_id").cast("string"))
    good = F.substring(F.md5(F.col("match_id").cast("string")), 1, 16)
    raw = t.contests.withColumn("match_hash", F.when(F.col("match_id") % 4 == 0, bad).otherwise(good))
    return v.repair_key(raw, date="match_date").select("match_id", "match_hash")


LEDGER_TEXT = [
    ("prediction_id", "concat('P', bet_id)"),
    ("match_hash", "concat('M', match_id)"),
    ("league", "league"),
    ("kickoff_date", "'2024-01-01'"),
    ("market", "market_key"),
    ("probability", "CAST(bet_id % 100 AS {S})"),
    ("outcome", "outcome"),
    ("resolved_at", "'2024-02-01'"),
]


@query(
    "p13_repair_shift",
    "SELECT "
    + ", ".join(f"{e.replace('{S}', 'VARCHAR')} AS {n}" for n, e in LEDGER_TEXT)
    + " FROM ledger",
)
def _(t):
    text = {n: F.expr(e.replace("{S}", "STRING")) for n, e in LEDGER_TEXT}
    rows = t.ledger.select("bet_id", *[c.alias(n) for n, c in text.items()])
    # rows written one column off: each column holds its right neighbour's value
    broken = F.col("bet_id") % 6 == 0
    held = {
        "prediction_id": "match_hash",
        "match_hash": "league",
        "league": "kickoff_date",
        "kickoff_date": "market",
        "market": "probability",
        "probability": "outcome",
        "outcome": "resolved_at",
        "resolved_at": "prediction_id",
    }
    wrong = {column: F.when(broken, F.col(value)).otherwise(F.col(column)) for column, value in held.items()}
    return v.repair_shift(rows.withColumns(wrong)).drop("bet_id")


@query(
    "p15_training_guards",
    """SELECT count(*) AS rows, count(DISTINCT league) AS leagues, round(least(count(home_goals) / count(*), count(home_corners) / count(*)), 6) AS worst_coverage,
 round((count(*) FILTER (home_goals IS NULL) + count(*) FILTER (home_corners IS NULL)) / (count(*) * 2.0), 6) AS bad_ratio,
 count(*) >= 1000 AS rows_ok, count(DISTINCT league) <= 1 AS single_league_ok,
 least(count(home_goals) / count(*), count(home_corners) / count(*)) >= 0.98 AS coverage_ok,
 (count(*) FILTER (home_goals IS NULL) + count(*) FILTER (home_corners IS NULL)) / (count(*) * 2.0) <= 0.01 AS cells_ok FROM contests""",
)
def _(t):
    out = v.training_guards(t.contests, ["home_goals", "home_corners"])
    return rounded(out, "worst_coverage", "bad_ratio")


@query(
    "p16_prediction_integrity",
    """SELECT bet_id, coalesce(CASE WHEN probability IS NULL THEN 'MISSING_PROBABILITY' WHEN probability < 0 OR probability > 1 THEN 'OUT_OF_RANGE'
 WHEN probability > 0.99 THEN 'OVERCONFIDENT' WHEN bet_id % 13 = 0 THEN 'MISSING_MODEL_VERSION' WHEN bet_id % 17 = 0 THEN 'MISSING_DATA_HASH' END, 'OK') AS violation
FROM (SELECT bet_id, CASE WHEN bet_id % 19 = 0 THEN NULL WHEN bet_id % 23 = 0 THEN probability + 1.5 ELSE probability END AS probability FROM ledger)""",
)
def _(t):
    p = F.when(F.col("bet_id") % 19 == 0, F.lit(None)).when(F.col("bet_id") % 23 == 0, F.col("probability") + 1.5)
    rows = t.ledger.select("bet_id", p.otherwise(F.col("probability")).alias("probability"), "model_version")
    full = F.create_map(F.lit("model_version"), "model_version", F.lit("data_hash"), F.lit("d"))
    drop = F.map_filter(
        full,
        lambda k, _: ~((k == "model_version") & (F.col("bet_id") % 13 == 0)) & ~((k == "data_hash") & (F.col("bet_id") % 17 == 0)),
    )
    out = v.prediction_integrity(rows.withColumn("details", drop), ["model_version", "data_hash"])
    return out.select("bet_id", F.coalesce("violation", F.lit("OK")).alias("violation"))


@query(
    "p17_leak_violations",
    """WITH q AS (SELECT match_date, max(match_date) OVER w AS src, avg(goals_for) OVER w AS g, count(*) OVER w AS n,
  coalesce(date_diff('day', lag(match_date) OVER o, match_date), 7) AS rest, list(CAST(points AS DOUBLE)) OVER (PARTITION BY team
   ORDER BY match_date, match_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS l
  FROM team WINDOW w AS (PARTITION BY team ORDER BY match_date, match_id ROWS BETWEEN 5 PRECEDING AND 1 PRECEDING), o AS (PARTITION BY team ORDER BY match_date, match_id)),
f AS (SELECT *, CASE WHEN l IS NULL OR len(l) = 0 THEN 1.5 ELSE list_reduce(l, lambda a, x: a * 0.9 + x * 0.1) END AS form FROM q)
SELECT 'max_source_date5_before_match' AS rule, count(*) FILTER (src >= match_date) AS violations FROM f
UNION ALL SELECT 'debut_has_no_history', count(*) FILTER (n = 0 AND g IS NOT NULL) FROM f
UNION ALL SELECT 'rest_not_negative', count(*) FILTER (rest < 0) FROM f
UNION ALL SELECT 'form_in_range', count(*) FILTER (form NOT BETWEEN 0 AND 3) FROM f""",
)
def _(t):
    parts = [ft.rolling_source_date(5), ft.rolling_mean(["goals_for"], 5), ft.rest_days(), ft.rolling_density(5)]
    out = ft.form(ft.add_features(t.team, parts))
    debut = F.col("games5") == 0
    return v.leak_violations(out, "match_date", ["max_source_date5"], debut, ["goals_for_avg5"])


@query(
    "p18_select_features",
    """SELECT match_id, is_home, round(avg(goals_for) OVER (PARTITION BY team ORDER BY match_date, match_id ROWS BETWEEN 5 PRECEDING AND 1 PRECEDING), 6) AS goals_for_avg5,
 CAST(least(coalesce(floor((epoch_us(match_date) - epoch_us(lag(match_date) OVER (PARTITION BY team ORDER BY match_date, match_id))) / 86400000000), 7), 21) AS BIGINT) AS rest_days FROM team""",
)
def _(t):
    out = ft.add_features(t.team, [ft.rolling_mean(["goals_for"], 5), ft.rest_days(), ft.rolling_source_date(5)])
    out = v.select_features(out, ["match_id", "is_home"])
    return rounded(out, "goals_for_avg5")


@query(
    "p19_allowed_markets",
    """SELECT bet_id, market_key FROM ledger WHERE (market_key LIKE '%over%' OR market_key LIKE '%btts%' OR market_key LIKE '%win%')
 AND market_key NOT IN (SELECT market_key FROM ledger GROUP BY market_key HAVING avg(probability) > 0.5)""",
)
def _(t):
    status = t.ledger.groupBy("market_key").agg(F.when(F.avg("probability") > 0.5, "FROZEN").otherwise("ACTIVE").alias("status"))
    return v.allowed_markets(t.ledger, ["over", "btts", "win"], status, "market_key").select("bet_id", "market_key")


# ---- scalar functions -----------------------------------------------------------------------------------


@query(
    "x01_fingerprint",
    """SELECT match_id, substring(sha256(league || '|' || season || '|' || strftime(match_date, '%Y-%m-%d') || '|' || home_team || '|' || away_team), 1, 16) AS match_hash,
 substring(md5(league || strftime(match_date, '%Y%m%d') || home_team || away_team), 1, 16) AS short_hash FROM contests""",
)
def _(t):
    return t.contests.select(
        "match_id",
        x.fingerprint("league", "season", "match_date", "home_team", "away_team").alias("match_hash"),
        x.short_fingerprint("league", "match_date", "home_team", "away_team").alias("short_hash"),
    )


@query(
    "x02_season",
    """WITH q AS (SELECT o_orderkey, o_orderdate, year(o_orderdate) AS y, month(o_orderdate) AS m FROM orders)
SELECT o_orderkey, CASE o_orderkey % 3
  WHEN 0 THEN CASE WHEN y % 100 < 99 AND y >= 2010 AND y <= 2030 THEN CAST(y AS VARCHAR) || '-' || lpad(CAST((y + 1) % 100 AS VARCHAR), 2, '0')
     ELSE CAST(y - CASE WHEN m >= 7 THEN 0 ELSE 1 END AS VARCHAR) || '-' || lpad(CAST((y - CASE WHEN m >= 7 THEN 0 ELSE 1 END + 1) % 100 AS VARCHAR), 2, '0') END
  WHEN 1 THEN CAST(y AS VARCHAR) || '-' || lpad(CAST((y + 1) % 100 AS VARCHAR), 2, '0')
  ELSE CAST(y - CASE WHEN m >= 7 THEN 0 ELSE 1 END AS VARCHAR) || '-' || lpad(CAST((y - CASE WHEN m >= 7 THEN 0 ELSE 1 END + 1) % 100 AS VARCHAR), 2, '0') END AS season,
 CAST(y - CASE WHEN m >= 6 THEN 0 ELSE 1 END AS INT) AS start6, CAST(y - CASE WHEN m >= 8 THEN 0 ELSE 1 END AS INT) AS start8 FROM q""",
)
def _(t):
    y = F.year("o_orderdate")
    short = F.concat(F.lit("E0_"), F.lpad((y % 100).cast("string"), 2, "0"), F.lpad(((y + 1) % 100).cast("string"), 2, "0"))
    full = F.concat(F.lit("season_"), y.cast("string"), F.lit("_"), (y + 1).cast("string"))
    kind = F.col("o_orderkey") % 3
    stem = F.when(kind == 0, short).when(kind == 1, full).otherwise("results")
    return t("orders").select(
        "o_orderkey",
        x.season_from_file(stem, "o_orderdate").alias("season"),
        x.season_start("o_orderdate", 6).alias("start6"),
        x.season_start("o_orderdate", 8).alias("start8"),
    )


@query(
    "x03_join_name",
    """SELECT event_id, upper(event_type) || ' MUNCHEN ' || CAST(user_id AS VARCHAR) AS name FROM events""",
)
def _(t):
    raw = F.concat(F.lit(" FC "), "event_type", F.lit("  München Sv "), F.col("user_id").cast("string"), F.lit(" "))
    return t("events").select("event_id", x.join_name(raw).alias("name"))


@query(
    "x05_dates",
    """SELECT match_id, strftime(match_date - INTERVAL 5 HOUR, '%Y-%m-%d %H') AS local_hour,
 CAST(floor((epoch_us(TIMESTAMP '2024-02-01 00:00:00') - epoch_us(match_date)) / 86400000000) AS BIGINT) AS days_left,
 strftime(date_trunc('day', match_date), '%Y-%m-%d') AS day FROM contests""",
)
def _(t):
    return t.contests.select(
        "match_id",
        F.date_format(F.from_utc_timestamp("match_date", "America/New_York"), "yyyy-MM-dd HH").alias("local_hour"),
        x.day_difference(F.lit(dt.datetime(2024, 2, 1, tzinfo=dt.UTC)), "match_date").alias("days_left"),
        F.date_format(F.date_trunc("DAY", "match_date"), "yyyy-MM-dd").alias("day"),
    )


@query(
    "x06_math",
    """SELECT bet_id, round(0.5 + 0.8 * (probability - 0.5), 6) AS dampened, round(1.0 / 3 + 0.8 * (probability - 1.0 / 3), 6) AS dampened3,
 round(greatest(least(probability, 0.92), 0.05), 6) AS clamped,
 round(ln(greatest(least(probability, 0.99), 0.01) / (1 - greatest(least(probability, 0.99), 0.01))), 6) AS logit,
 round(exp(-odds) * odds * odds * odds / 6, 6) AS poisson3 FROM ledger""",
)
def _(t):
    p = F.col("probability")
    out = t.ledger.select(
        "bet_id",
        x.dampen(p).alias("dampened"),
        x.dampen(p, 0.80, 1 / 3).alias("dampened3"),
        x.clamp(p, 0.05, 0.92).alias("clamped"),
        x.logit(p).alias("logit"),
        F.element_at(x.poisson_pmf(F.col("odds"), 5), 4).alias("poisson3"),
    )
    return rounded(out, "dampened", "dampened3", "clamped", "logit", "poisson3")


@query(
    "x07_nested",
    """WITH g AS (SELECT match_id, home_xg, away_xg, h, a, exp(-home_xg) * pow(home_xg, h) / factorial(CAST(h AS INT)) * exp(-away_xg) * pow(away_xg, a) / factorial(CAST(a AS INT)) AS p
  FROM rates, range(0, 5) th(h), range(0, 5) ta(a)),
r AS (SELECT *, row_number() OVER (PARTITION BY match_id ORDER BY round(p, 12) DESC, h, a) AS rn FROM g)
SELECT match_id, max(CASE WHEN rn = 1 THEN round(p, 6) END) AS best_p, CAST(match_id % 100 AS DOUBLE) AS possession,
 CAST(count(*) FILTER (rn <= 3) AS BIGINT) AS listed FROM r GROUP BY match_id""",
)
def _(t):
    pmfs = t.rates.select("match_id", x.poisson_pmf(F.col("home_xg"), 4).alias("h"), x.poisson_pmf(F.col("away_xg"), 4).alias("a"))
    stats = F.array(
        F.struct(F.lit("Corner Kicks").alias("type"), F.lit("4").alias("value")),
        F.struct(
            F.lit("Ball Possession").alias("type"),
            F.concat((F.col("match_id") % 100).cast("string"), F.lit("%")).alias("value"),
        ),
    )
    return pmfs.withColumn("top", x.top_scorelines(F.col("h"), F.col("a"), 3)).select(
        "match_id",
        r6(F.get("top", F.lit(0))["p"]).alias("best_p"),
        x.statistic(stats, "Ball Possession").alias("possession"),
        F.size("top").cast("long").alias("listed"),
    )


@query(
    "x08_json",
    """SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k, 'none' AS absent, '{"k":' || json_extract_string(props, '$.k') || '}' AS payload FROM events""",
)
def _(t):
    decoded = F.from_json("props", "k long, note string")
    return t("events").select("event_id", decoded.alias("d")).select(
        "event_id",
        F.col("d.k"),
        F.coalesce("d.note", F.lit("none")).alias("absent"),
        F.to_json(F.struct("d.k")).alias("payload"),
    )


ALERTS = """SELECT bet_id, CASE bet_id % 4 WHEN 0 THEN 'CALIBRATION_DRIFT: ECE ' || CAST(bet_id % 50 AS {S}) || '.5 (Baseline 0.04)'
 WHEN 1 THEN 'HIT_RATE_DRIFT: ' || CAST(bet_id % 9 AS {S}) || ' (baseline -2.25)' WHEN 2 THEN 'GLOBAL_WATCH: 3 leagues' ELSE 'no colon here' END AS alert FROM ledger"""


@query(
    "x09_alert_fields",
    """SELECT bet_id, CASE bet_id % 4 WHEN 0 THEN 'calibration_drift' WHEN 1 THEN 'hit_rate_drift' WHEN 2 THEN 'global_watch' ELSE 'no colon here' END AS type,
 CASE bet_id % 4 WHEN 0 THEN 'ece' WHEN 1 THEN 'hit_rate' WHEN 2 THEN 'global_status' ELSE '' END AS metric,
 CASE bet_id % 4 WHEN 0 THEN bet_id % 50 + 0.5e0 WHEN 1 THEN CAST(bet_id % 9 AS DOUBLE) WHEN 2 THEN 3.0e0 END AS value,
 CASE bet_id % 4 WHEN 0 THEN 0.04e0 WHEN 1 THEN -2.25e0 END AS threshold FROM ledger""",
)
def _(t):
    alerts = t._sql(ALERTS.replace("{S}", "STRING"), ledger=t.ledger)
    return alerts.select("bet_id", F.inline(F.array(x.alert_fields("alert")))).drop("details")


@query(
    "x10_season_year",
    "SELECT o_orderkey, CAST(CASE WHEN o_orderkey % 4 = 3 THEN -1 ELSE year(o_orderdate) END AS INT) AS season_year FROM orders",
)
def _(t):
    y = F.year("o_orderdate").cast("string")
    kind = F.col("o_orderkey") % 4
    text = F.when(kind == 0, F.concat(y, F.lit("/25"))).when(kind == 1, F.concat(y, F.lit("-25"))).when(kind == 2, y).otherwise("unknown")
    return t("orders").select("o_orderkey", F.coalesce(x.season_year(text), F.lit(-1)).alias("season_year"))


@query(
    "x11_drift_status",
    """SELECT bet_id, CASE bet_id % 6 WHEN 0 THEN 'GO' WHEN 1 THEN 'GO' WHEN 2 THEN 'WATCH' WHEN 3 THEN 'WATCH' ELSE 'STOP' END AS status FROM ledger""",
)
def _(t):
    words = F.array(*[F.lit(w) for w in ("ok", "Active", "warn", "INSUFFICIENT_DATA", "frozen", "??")])
    return t.ledger.select("bet_id", x.drift_status(F.get(words, (F.col("bet_id") % 6).cast("int"))).alias("status"))


@query(
    "x13_multiclass_brier",
    """WITH q AS (SELECT match_id, probability AS h, (1 - probability) / 2 AS d, (1 - probability) / 2 AS a, CASE bet_id % 3 WHEN 0 THEN 'H' WHEN 1 THEN 'D' ELSE 'A' END AS actual, bet_id FROM ledger)
SELECT bet_id, round((pow(h - CAST(actual = 'H' AS INT), 2) + pow(d - CAST(actual = 'D' AS INT), 2) + pow(a - CAST(actual = 'A' AS INT), 2)) / 3, 9) AS brier,
 CASE WHEN h > d AND h > a THEN 'H' WHEN a > d AND a > h THEN 'A' ELSE 'D' END AS pick FROM q""",
)
def _(t):
    rest = (1 - F.col("probability")) / 2
    kind = F.col("bet_id") % 3
    rows = t.ledger.select(
        "bet_id",
        F.col("probability").alias("h"),
        rest.alias("d"),
        rest.alias("a"),
        F.when(kind == 0, "H").when(kind == 1, "D").otherwise("A").alias("actual"),
    )
    return rows.select("bet_id", F.round(x.multiclass_brier("h", "d", "a", "actual"), 9).alias("brier"), x.outcome_of("h", "d", "a").alias("pick"))


@query(
    "x14_row_hash",
    """SELECT match_id, md5('{"home_corners":' || coalesce(CAST(home_corners AS VARCHAR), 'null') || ',"league":"' || league || '","match_id":' || match_id || ',"referee":' || coalesce('"' || referee || '"', 'null') || '}') AS snapshot FROM contests""",
)
def _(t):
    return t.contests.select("match_id", x.row_hash("match_id", "league", "home_corners", "referee").alias("snapshot"))


@query(
    "x15_first_number",
    "SELECT match_id, CAST(coalesce(home_corners, away_shots) AS DOUBLE) AS value FROM contests",
)
def _(t):
    text = F.coalesce(F.col("home_corners").cast("string"), F.lit("n/a"))
    return t.contests.withColumn("text", text).select("match_id", x.first_number("text", "away_shots").alias("value"))
