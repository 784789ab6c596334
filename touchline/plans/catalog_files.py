"""Queries over file sources, sinks and streams. Each writes files from the given tables and reads them back."""

import datetime as dt

from pyspark.sql import functions as F

from ..operators import metrics as g
from ..sources import files as io
from ..streaming import streams as ss
from .catalog_joins import MARKETS
from .catalog_metrics import S
from .registry import micros, query, r6, rounded
from .scratch import fresh

MICROS = "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX"


def raw_results(t, base):
    """Result CSVs in ``base/<league>/``: two headers, one folder without a required column."""
    c = t.contests.select(
        "league",
        F.date_format("match_date", "dd/MM/yyyy").alias("Date"),
        F.col("home_team").alias("HomeTeam"),
        F.col("away_team").alias("AwayTeam"),
        F.col("home_goals").alias("FTHG"),
        F.col("away_goals").alias("FTAG"),
        F.col("home_corners").alias("HC"),
        F.col("match_id").alias("id"),
    )
    plain = c.filter("league IN ('click', 'view')").withColumn("Div", F.when(F.col("league") == "click", "E0").otherwise("D1"))
    odds = c.filter("league NOT IN ('click', 'view', 'signup')").withColumn("B365H", F.lit(1.5)).drop("HC")
    broken = c.filter("league = 'signup'").drop("FTHG")
    for part in (plain, odds, broken):
        (part.withColumn("dir", F.col("league")).drop("league").write.mode("append").option("header", True).partitionBy("dir").csv(base))


@query(
    "io01_read_results",
    """SELECT match_id AS id, home_team AS HomeTeam, CAST(home_goals AS VARCHAR) AS FTHG, CASE WHEN league IN ('click', 'view') THEN coalesce(CAST(home_corners AS VARCHAR), '-') ELSE '-' END AS HC, league AS folder
FROM contests WHERE league <> 'signup'""",
)
def _(t):
    base = fresh(t.spark, "results")
    raw_results(t, base)
    rows, _ = io.read_results(t.spark, base)
    return rows.select(
        F.col("id").cast("long").alias("id"),
        "HomeTeam",
        "FTHG",
        F.coalesce("HC", F.lit("-")).alias("HC"),
        F.regexp_replace("league_dir", "^dir=", "").alias("folder"),
    )


@query(
    "x12_detect_league",
    "SELECT match_id AS id, CASE league WHEN 'click' THEN 'PL' WHEN 'view' THEN 'BL1' ELSE '-' END AS league FROM contests WHERE league <> 'signup'",
)
def _(t):
    base = fresh(t.spark, "results")
    raw_results(t, base)
    rows, _ = io.read_results(t.spark, base)
    out = io.detect_league(rows)
    return out.select(F.col("id").cast("long").alias("id"), F.coalesce("league", F.lit("-")).alias("league"))


@query(
    "io02_read_processed",
    """SELECT match_id, CASE WHEN league = 'click' THEN 'known' ELSE league END AS competition, '2024' AS season FROM contests""",
)
def _(t):
    # one folder per league, renamed by reading each under a <league>_<season>.csv glob
    base = fresh(t.spark, "processed")
    rows = t.contests.select(
        "match_id",
        F.when(F.col("league") == "click", "known").alias("competition"),
        F.when(F.col("match_id") % 2 == 0, "2024").otherwise("FT").alias("season"),
        F.concat("league", F.lit("_2024.csv")).alias("file"),
    )
    rows.write.partitionBy("file").option("header", True).csv(base)
    out = read_by_folder(t, base)
    return out.select(F.col("match_id").cast("long").alias("match_id"), "competition", "season")


def read_by_folder(t, base):
    """Spark writes folders, so the folder name plays the file name here."""
    rows, _ = io.read_csv_groups(t.spark, [f"{base}/*/*.csv"])
    rows = rows.withColumn("source_file", F.regexp_replace("league_dir", "^file=", "")).drop("file")
    return io.fill_from_name(rows)


@query("io04_read_events", "SELECT event_id AS match_id, event_type, round(value, 6) AS confidence, epoch_us(ts) AS ts_us FROM events")
def _(t):
    path = fresh(t.spark, "events")
    event_log(t).write.partitionBy("day").option("timestampFormat", MICROS).json(path)
    out = io.read_events(t.spark, path)
    return out.select(F.col("match_id").cast("long").alias("match_id"), F.col("metadata.kind").alias("event_type"), r6("confidence").alias("confidence"), micros("timestamp").alias("ts_us"))


def event_log(t):
    kind = F.when(F.col("event_id") % 9 == 0, "model_fallback").when(F.col("event_id") % 4 == 0, "gate_rejected").otherwise("prediction_generated")
    return t("events").select(
        F.col("ts").cast("timestamp").alias("timestamp"),
        kind.alias("event_type"),
        F.lit("PL").alias("league"),
        F.col("event_id").cast("string").alias("match_id"),
        F.lit("v1").alias("model_version"),
        F.col("value").alias("confidence"),
        F.create_map(F.lit("kind"), F.col("event_type")).alias("metadata"),
        F.date_format("ts", "yyyy-MM-dd").alias("day"),
    )


@query("io05_read_membership", "SELECT DISTINCT league, season, home_team AS team FROM contests")
def _(t):
    path = fresh(t.spark, "membership")
    teams = t.contests.select("league", "season", "home_team").distinct()
    seasons = teams.groupBy("league", "season").agg(F.sort_array(F.collect_list("home_team")).alias("teams"))
    leagues = seasons.groupBy("league").agg(F.map_from_entries(F.collect_list(F.struct("season", "teams"))).alias("s"))
    whole = leagues.agg(F.to_json(F.map_from_entries(F.collect_list(F.struct("league", "s")))).alias("value"))
    whole.coalesce(1).write.text(path)
    return io.read_membership(t.spark, path)


@query(
    "io07_parse_shadow_log",
    """WITH q AS (SELECT match_id, league, bet_id, ((bet_id * 7919) % 997) / 1000 AS h FROM ledger), r AS (SELECT *, row_number() OVER (PARTITION BY match_id, league ORDER BY bet_id DESC) AS rn FROM q),
l AS (SELECT * FROM r WHERE rn = 1) SELECT CAST(match_id AS VARCHAR) AS match_id, league, m AS market, round(CASE m WHEN 'home_win' THEN h WHEN 'draw' THEN 0.25 WHEN 'away_win' THEN 0.125 WHEN 'over_2_5' THEN 0.5 ELSE 0.75 END, 6) AS probability
FROM l, (VALUES ('home_win'), ('draw'), ('away_win'), ('over_2_5'), ('btts_yes')) v(m)""",
)
def _(t):
    path = fresh(t.spark, "shadow")
    h = ((F.col("bet_id") * 7919) % 997) / 1000
    line = F.format_string(
        "2024-01-01 INFO [RL-SHADOW] match_id=%d context=%s:x weights={'a': 1} home=%.3f draw=0.25 away=0.125 over_2_5=0.5 btts_yes=0.75 applied=False",
        "match_id",
        F.lower("league"),
        h,
    )
    # range-sorted files, so that file and line order is bet order
    t.ledger.orderBy("bet_id").select(line.alias("value")).write.text(path)
    out = io.read_shadow_log(t.spark, path)
    return rounded(out.select("match_id", "league", "market", "probability"), "probability")


@query("io08_write_partitions", "SELECT match_id, league, season FROM contests")
def _(t):
    path = fresh(t.spark, "matches")
    rows = t.contests.select("match_id", "league", "season")
    io.write_partitions(rows.withColumn("match_id", -F.col("match_id")), path, ["league", "season"])
    io.write_partitions(rows, path, ["league", "season"])
    return t.spark.read.parquet(path).select("match_id", "league", "season")


MANIFEST_COLUMNS = (
    "away_cards away_corners away_goals away_shots away_team home_cards home_corners home_goals home_shots home_team "
    "league match_date match_id referee season status"
).split()


@query(
    "io11_freeze_manifest",
    """SELECT count(*) AS rows, CAST(16 AS INT) AS columns, epoch_us(min(match_date)) AS first_us, epoch_us(max(match_date)) AS last_us, count(DISTINCT league) AS leagues, count(DISTINCT season) AS seasons,
 count(*) FILTER (home_corners IS NULL) + count(*) FILTER (away_corners IS NULL) + count(*) FILTER (referee IS NULL) AS nulls,
 sha256(CAST(sum(CAST(CAST('0x' || substring(md5(concat_ws('|', """
    + ", ".join(f"coalesce(CAST({'epoch_us(match_date)' if c == 'match_date' else c} AS VARCHAR), '~')" for c in MANIFEST_COLUMNS)
    + """)), 1, 15) AS BIGINT) AS HUGEINT)) AS VARCHAR)) AS content_hash FROM contests""",
)
def _(t):
    out = io.freeze_manifest(t.contests)
    span = [micros("first").alias("first_us"), micros("last").alias("last_us")]
    return out.select("rows", "columns", *span, "leagues", "seasons", "nulls", "content_hash")


@query(
    "io12_coverage",
    """WITH c AS (SELECT league, count(*) AS matches, count(DISTINCT season) AS seasons, epoch_us(min(match_date)) AS first_us, avg(CAST(home_corners IS NULL AS INT)) AS a, avg(CAST(referee IS NULL AS INT)) AS b FROM contests GROUP BY 1)
SELECT league, matches, seasons, first_us, 'home_corners' AS "column", round(a, 4) AS null_rate FROM c UNION ALL SELECT league, matches, seasons, first_us, 'referee', round(b, 4) FROM c""",
)
def _(t):
    out = io.coverage(t.contests, "league", ["home_corners", "referee"])
    return out.withColumn("first_us", micros("first")).drop("first", "last")


@query(
    "io13_log_predictions",
    "SELECT CAST(match_id AS VARCHAR) AS match_id, league, market_key AS market, probability, strftime(ts, '%Y-%m') AS day FROM ledger",
)
def _(t):
    path = fresh(t.spark, "log")
    rows = t.ledger.select(
        F.col("match_id").alias("match_hash"), "league", F.col("market_key").alias("market"), F.col("probability").alias("predicted_probability"), "ts"
    )
    day = F.date_format("ts", "yyyy-MM")
    io.log_predictions(rows.filter("match_hash % 2 = 0"), path, day, "2024-01-01")
    io.log_predictions(rows.filter("match_hash % 2 = 1"), path, day, "2024-01-02")
    out = t.spark.read.parquet(path)
    return out.select("match_id", "league", "market", "probability", F.col("day").cast("string").alias("day"))


# ---- streams --------------------------------------------------------------------------------------------


def logged(t):
    path = fresh(t.spark, "events")
    event_log(t).repartition(4).drop("day").write.option("timestampFormat", MICROS).json(path)
    return path


@query(
    "t01_stream_events",
    "SELECT event_id AS match_id, epoch_us(ts) AS ts_us FROM events",
)
def _(t):
    out, mark = fresh(t.spark, "out"), fresh(t.spark, "mark")
    rows = ss.stream_events(t.spark, logged(t), late="60 days")
    ss.run_available(rows.writeStream.format("parquet").option("path", out), mark)
    return t.spark.read.parquet(out).select(F.col("match_id").cast("long").alias("match_id"), micros("timestamp").alias("ts_us"))


KIND = "CASE WHEN event_id % 9 = 0 THEN 'f' WHEN event_id % 4 = 0 THEN 'g' ELSE 'p' END"


@query(
    "t02_stream_metrics",
    f"""SELECT strftime(ts, '%Y-%m-%d') AS day, count(*) AS events, count(*) FILTER ({KIND} = 'p') AS predictions, round(avg(value) FILTER ({KIND} = 'p'), 6) AS avg_confidence, round(avg(CAST({KIND} = 'f' AS INT)), 6) AS fallback_rate FROM events GROUP BY 1""",
)
def _(t):
    out, mark = fresh(t.spark, "out"), fresh(t.spark, "mark")
    metrics = ss.stream_metrics(ss.stream_events(t.spark, logged(t), late="60 days", files_per_batch=1))
    ss.run_available(ss.to_partitions(metrics, out, F.date_format("start", "yyyy-MM-dd"), "day"), mark)
    got = t.spark.read.parquet(out).select(F.col("day").cast("string").alias("day"), "events", "predictions", "avg_confidence", "fallback_rate")
    return rounded(got, "avg_confidence", "fallback_rate")


@query(
    "t03_stream_suppress",
    """WITH RECURSIVE a AS (SELECT user_id, epoch_us(ts) AS t FROM events), s AS (SELECT user_id, min(t) AS t FROM a GROUP BY 1
 UNION ALL SELECT user_id, t FROM (SELECT s.user_id, min(a.t) AS t FROM s JOIN a ON s.user_id = a.user_id AND a.t >= s.t + 86400000000 GROUP BY s.user_id, s.t) x)
SELECT CAST(user_id AS VARCHAR) AS key, t AS sent_us FROM s""",
)
def _(t):
    out, mark, source = fresh(t.spark, "out"), fresh(t.spark, "mark"), fresh(t.spark, "alerts")
    rows = t("events").select(F.col("user_id").cast("string").alias("key"), F.col("ts").cast("timestamp").alias("ts"))
    # files in time order, as alerts arrive
    rows.repartitionByRange(4, "ts").write.parquet(source)
    stream = t.spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 100).parquet(source)
    ss.run_available(ss.stream_suppress(stream, "key", "ts").writeStream.outputMode("append").format("parquet").option("path", out), mark)
    return t.spark.read.parquet(out).select("key", F.col("at").alias("sent_us"))


@query(
    "t04_stream_market_drift",
    f"""WITH RECURSIVE {S}, e AS (SELECT *, epoch_us(ts) AS us FROM s WHERE market IS NOT NULL AND ts IS NOT NULL AND probability IS NOT NULL),
r AS (SELECT market, us, bet_id, count(*) OVER a AS n, avg(probability) OVER w AS mc, avg(hit) OVER w AS hr, count(*) FILTER (tier = 'TIER_A') OVER w AS na,
  count(*) FILTER (tier = 'TIER_B') OVER w AS nb, avg(hit) FILTER (tier = 'TIER_A') OVER w AS ha, avg(hit) FILTER (tier = 'TIER_B') OVER w AS hb FROM e
  WINDOW a AS (PARTITION BY market ORDER BY us, bet_id ROWS UNBOUNDED PRECEDING), w AS (PARTITION BY market ORDER BY us, bet_id ROWS BETWEEN 299 PRECEDING AND CURRENT ROW)),
b AS (SELECT *, n >= 100 AND (round(mc - hr, 9) > 0.04 OR (n >= 300 AND na >= 20 AND nb >= 20 AND ha < hb)) AS bad FROM r),
f AS (SELECT market, us, bet_id, n FROM b WHERE bad),
c AS (SELECT market, min(us) AS us FROM f GROUP BY 1 UNION ALL SELECT market, us FROM (SELECT c.market, min(f.us) AS us FROM c JOIN f ON c.market = f.market AND f.us >= c.us + 86400000000 GROUP BY c.market, c.us) x),
g AS (SELECT c.market, c.us, min(f.n) AS n FROM c JOIN f ON c.market = f.market AND c.us = f.us GROUP BY 1, 2),
h AS (SELECT b.*, g.us AS started, g.n AS first_n FROM b ASOF LEFT JOIN g ON b.market = g.market AND b.us >= g.us)
SELECT market, us AS "at", bet_id AS id, least(n, 1000) AS n, round(mc, 12) AS mean_conf, round(hr, 12) AS hit_rate,
 CASE WHEN us < started + 86400000000 AND n >= first_n THEN 'STOP' WHEN n < 100 THEN 'WATCH' ELSE 'GO' END AS status
FROM h WHERE us < (SELECT (max(us) // 1000 - 3600000) * 1000 FROM e)""",
)
def _(t):
    out, mark, source = fresh(t.spark, "out"), fresh(t.spark, "mark"), fresh(t.spark, "bets")
    bets = g.settled(t.ledger).select("market", "ts", F.col("bet_id").alias("id"), F.col("probability").alias("conf"), "hit", "tier")
    bets.write.parquet(source)
    stream = t.spark.readStream.schema(bets.schema).option("maxFilesPerTrigger", 1000).parquet(source)
    with ss.state_store(t.spark):
        verdicts = ss.stream_market_drift(stream, "1 hour").writeStream.outputMode("append").format("parquet").option("path", out)
        ss.run_available(verdicts, mark)
    # Means of up to 300 prices of a few digits have ties at the sixth digit, not at the twelfth.
    return t.spark.read.parquet(out).withColumns({c: F.round(c, 12) for c in ("mean_conf", "hit_rate")})


@query("t05_stream_append", "SELECT o_custkey, count(*) AS copies FROM (SELECT DISTINCT o_custkey FROM orders) GROUP BY 1")
def _(t):
    sink, mark, source = fresh(t.spark, "sink"), fresh(t.spark, "mark"), fresh(t.spark, "rows")
    rows = t("orders").select("o_custkey", "o_orderkey")
    rows.repartition(4).write.parquet(source)
    stream = t.spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).parquet(source)
    ss.run_available(ss.stream_append(stream, sink, ["o_custkey"], [F.col("o_orderkey")], F.col("o_custkey") % 16), mark)
    return t.spark.read.parquet(sink).groupBy("o_custkey").agg(F.count(F.lit(1)).alias("copies"))


@query(
    "t06_stream_resolve",
    """WITH p AS (SELECT DISTINCT match_id, market_key FROM ledger WHERE probability BETWEEN 0 AND 1),
r AS (SELECT *, match_date - to_hours(match_id % 40) AS kickoff, CASE WHEN match_id % 7 = 0 THEN match_date + INTERVAL 10 DAY WHEN match_id % 11 = 0 THEN match_date - INTERVAL 30 HOUR ELSE match_date END AS played FROM contests),
j AS (SELECT p.match_id, p.market_key, r.* EXCLUDE (match_id) FROM p JOIN r ON p.match_id = r.match_id AND played BETWEEN kickoff - INTERVAL 24 HOUR AND kickoff + INTERVAL 72 HOUR)
SELECT match_id, market_key AS market, CASE WHEN played < kickoff THEN 'TIME_TRAVEL' ELSE coalesce(CASE CASE market_key WHEN 'home_win' THEN home_goals > away_goals WHEN 'draw' THEN home_goals = away_goals
  WHEN 'away_win' THEN away_goals > home_goals WHEN 'over_2_5' THEN home_goals + away_goals > 2.5 WHEN 'btts_yes' THEN home_goals > 0 AND away_goals > 0 WHEN 'corn_o75' THEN home_corners + away_corners > 7.5 END WHEN true THEN 'WON' WHEN false THEN 'LOST' END, 'VOID') END AS state
FROM j""",
)
def _(t):
    out, mark = fresh(t.spark, "outcomes"), fresh(t.spark, "mark")
    made = t.contests.select("match_id", F.expr("match_date - make_interval(0, 0, 0, 0, CAST(match_id % 40 AS INT))").alias("kickoff"))
    preds = t.ledger.select("bet_id", "match_id", F.col("market_key").alias("market"), "probability").join(made, "match_id", "left")
    # Results come ten days late (beyond the wait), early (before the prediction) or in time, those of odd matches in a later batch.
    played = F.expr("CASE WHEN match_id % 7 = 0 THEN match_date + INTERVAL 10 DAY WHEN match_id % 11 = 0 THEN match_date - INTERVAL 30 HOUR ELSE match_date END")
    known = t.contests.withColumn("match_date", played)

    def streamed(parts, name):
        """A trigger takes a part; each part is many files, as one would put the joins before it into one task."""
        folder, files = fresh(t.spark, name), int(t.spark.conf.get("spark.sql.shuffle.partitions"))
        for rows in parts:
            rows.repartition(files).write.mode("append").parquet(folder)
        return t.spark.readStream.schema(parts[0].schema).option("maxFilesPerTrigger", files).parquet(folder)

    predictions = streamed([preds.filter(F.col("bet_id") % 3 == i) for i in range(3)], "preds")
    results = streamed([known.filter(F.col("match_id") % 2 == i) for i in range(2)], "results")
    settled = ss.stream_resolve(predictions, results, MARKETS, key="match_id", late_hours=24 * 60)
    ss.run_available(settled.writeStream.outputMode("append").format("parquet").option("path", out), mark)
    return t.spark.read.parquet(out).filter("state <> 'UNMATCHED'").select("match_id", "market", "state")


NOW = dt.datetime(2024, 1, 15, 12, tzinfo=dt.UTC)


@query(
    "t07_ingest_fixtures",
    """WITH f AS (SELECT league, CASE match_id % 3 WHEN 0 THEN TIMESTAMP '2024-01-15 08:00:00' WHEN 1 THEN TIMESTAMP '2024-01-15 11:00:00' ELSE TIMESTAMP '2024-01-13 00:00:00' END AS fetched, CASE WHEN match_id % 10 = 0 THEN NULL ELSE match_date END AS k,
  upper(CASE WHEN match_id % 17 = 0 THEN '' ELSE home_team END) AS h, upper(away_team) AS a FROM contests)
SELECT substring(md5(league || strftime(k, '%Y%m%d') || h || a), 1, 16) AS match_id, league, min(epoch_us(k)) AS date_us, h AS home_team, a AS away_team, CAST(2023 AS INT) AS season FROM f
WHERE fetched = TIMESTAMP '2024-01-15 11:00:00' AND k >= TIMESTAMP '2024-01-15 12:00:00' AND h <> '' GROUP BY strftime(k, '%Y%m%d'), league, h, a""",
)
def _(t):
    kind = F.col("match_id") % 3
    at = lambda d, h: F.lit(dt.datetime(2024, 1, d, h, tzinfo=dt.UTC))
    raw = t.contests.select(
        "league",
        F.when(kind == 0, at(15, 8)).when(kind == 1, at(15, 11)).otherwise(at(13, 0)).alias("fetched_at"),
        F.when(F.col("match_id") % 10 > 0, F.date_format("match_date", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS")).otherwise("soon").alias("kickoff"),
        F.when(F.col("match_id") % 17 > 0, F.concat(F.lit(" "), "home_team")).otherwise(" ").alias("home_team"),
        "away_team",
        F.lit(None).cast("int").alias("season"),
    )
    out = ss.ingest_fixtures(raw, NOW)
    return out.select("match_id", "league", micros("date_utc").alias("date_us"), "home_team", "away_team", "season")


@query(
    "t08_reject_late",
    """SELECT c.match_id FROM contests c LEFT JOIN (SELECT match_id, min(CASE WHEN match_id % 7 = 0 THEN ts + INTERVAL 30 YEAR ELSE ts END) AS t FROM ledger GROUP BY 1) p ON c.match_id = p.match_id WHERE p.t IS NULL OR c.match_date >= p.t""",
)
def _(t):
    preds = t.ledger.select("match_id", F.expr("CASE WHEN match_id % 7 = 0 THEN ts + INTERVAL 30 YEAR ELSE ts END").alias("made"))
    return ss.reject_late(t.contests, preds, "match_id", "match_date", "made").select("match_id")
