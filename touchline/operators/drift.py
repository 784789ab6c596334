"""Drift states, alerts and monitoring checks in batch form."""

from __future__ import annotations

import datetime as dt
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import alert_fields, drift_status
from .metrics import bin_of, ece
from .ordered import Feature, Rolling, point_in_time, top_per_key

# Baselines and limits.
BASELINES = {"hit_rate": 0.75, "ece": 0.044, "mean_conf": 0.559}
HIT_RATE_STOP, ECE_STOP, CONFIDENCE_STOP = -0.05, 0.03, 0.05
MARKET_MIN, MARKET_WINDOW, MARKET_DRIFT, TIER_MIN = 100, 300, 0.04, 20
VOLUME_FACTOR = 1.5
REFIT_EVERY, REFIT_ECE = 500, 0.03
Z_LIMIT, FLAGGED_SHARE = 3.0, 0.05
SHADOW_TOLERANCE = 0.005


def drift_state(settled: DataFrame, baselines: dict[str, float] = BASELINES) -> DataFrame:
    """Hit rate, ECE (c), mean confidence, alerts and state, per league and overall.

    Rows shrink to ten bins per league; the overall row re-adds those bins.
    """
    p = F.greatest(F.least(F.col("probability"), F.lit(1.0)), F.lit(0.0))
    bins = settled.groupBy("league", bin_of(F.col("probability"), "c").alias("_bin")).agg(
        F.count(F.lit(1)).alias("n"), F.sum(p).alias("p"), F.sum("hit").alias("y")
    )
    overall = bins.groupBy("_bin").agg(F.sum("n").alias("n"), F.sum("p").alias("p"), F.sum("y").alias("y"))
    both = bins.unionByName(overall.withColumn("league", F.lit("GLOBAL")))
    out = both.groupBy("league").agg(
        F.sum("n").alias("n"),
        (F.sum("y") / F.sum("n")).alias("hit_rate"),
        (F.sum(F.abs(F.col("p") - F.col("y"))) / F.sum("n")).alias("ece"),
        (F.sum("p") / F.sum("n")).alias("mean_conf"),
    )
    b = baselines
    alerts = F.array_compact(
        F.array(
            F.when(
                F.col("hit_rate") < b["hit_rate"] + HIT_RATE_STOP,
                F.format_string(f"HIT_RATE_DRIFT: %.2f (Baseline {b['hit_rate']})", "hit_rate"),
            ),
            F.when(F.col("ece") > b["ece"] + ECE_STOP, F.format_string(f"CALIBRATION_DRIFT: %.3f (Baseline {b['ece']})", "ece")),
            F.when(
                F.col("mean_conf") > b["mean_conf"] + CONFIDENCE_STOP,
                F.format_string(f"CONFIDENCE_INFLATION: %.2f (Baseline {b['mean_conf']})", "mean_conf"),
            ),
        )
    )
    return out.withColumn("alerts", alerts).withColumn("status", F.when(F.size("alerts") > 0, "STOP").otherwise("GO"))


def market_drift(bets: DataFrame, order: list[Column], spread: Column, key: str = "market") -> DataFrame:
    """WATCH under 100 bets; STOP on overconfidence or tier inversion in the last 300; else GO."""
    totals = bets.groupBy(key).agg(F.count(F.lit(1)).alias("n"))
    last = top_per_key(bets, [key], order, MARKET_WINDOW, spread)
    tier = lambda t: F.avg(F.when(F.col("tier") == t, F.col("hit")))
    count = lambda t: F.count_if(F.col("tier") == t)
    recent = last.groupBy(key).agg(
        F.avg("probability").alias("mean_conf"),
        F.avg("hit").alias("hit_rate"),
        F.count(F.lit(1)).alias("_recent"),
        count("TIER_A").alias("_na"),
        count("TIER_B").alias("_nb"),
        tier("TIER_A").alias("_a"),
        tier("TIER_B").alias("_b"),
    )
    out = recent.join(totals, key)
    inverted = (F.col("_recent") >= MARKET_WINDOW) & (F.col("_na") >= TIER_MIN) & (F.col("_nb") >= TIER_MIN) & (F.col("_a") < F.col("_b"))
    drifting = F.col("mean_conf") - F.col("hit_rate") > MARKET_DRIFT
    status = F.when(F.col("n") < MARKET_MIN, "WATCH").when(drifting | F.coalesce(inverted, F.lit(False)), "STOP").otherwise("GO")
    reason = F.when(status == "STOP", F.when(drifting, "overconfidence_drift").otherwise("tier_inversion")).otherwise("")
    return out.withColumns({"status": status, "reason": reason}).select(key, "n", "mean_conf", "hit_rate", "status", "reason")


def feature_drift(df: DataFrame, baselines: DataFrame, features: list[str], keep: list[str]) -> DataFrame:
    """Per row: features beyond three standard deviations, their share, and OK / WARNING / CRITICAL (D3).

    The baselines, one entry per feature, become one scalar struct, so the rows are neither unpivoted nor shuffled.
    """
    stat = F.struct("mean", "std")
    one = baselines.agg(F.struct(*[F.max(F.when(F.col("feature") == f, stat)).alias(f) for f in features]).alias("b")).scalar()
    df = df.withColumn("_base", one)
    marks = {}
    for f in features:
        mean, std, x = F.col(f"_base.{f}.mean"), F.col(f"_base.{f}.std"), F.col(f).cast("double")
        far = F.when(std == 0, F.abs(x - mean) > 1e-5).otherwise(F.abs(x - mean) > Z_LIMIT * std)
        # null: no baseline or no value, so the feature is not checked
        marks[f"_off_{f}"] = F.when(mean.isNotNull() & x.isNotNull(), F.coalesce(far, F.lit(False)))
    out = df.withColumns(marks)
    total = lambda cond: reduce(lambda a, b: a + b, [cond(F.col(m)).cast("int") for m in marks])
    out = out.withColumns({"_n": total(lambda m: m.isNotNull()), "flagged_count": total(lambda m: F.coalesce(m, F.lit(False)))})
    names = F.array_compact(F.array(*[F.when(F.col(f"_off_{f}"), f) for f in features]))
    flagged = F.when(F.col("flagged_count") > 0, names).otherwise(F.array().cast("array<string>"))
    share = F.col("flagged_count") / F.nullif(F.col("_n"), F.lit(0))
    out = out.withColumns({"flagged": flagged, "flagged_share": share})
    status = (
        F.when(F.col("_n") == 0, "NO_FEATURES")
        .when(F.col("flagged_share") > FLAGGED_SHARE, "CRITICAL")
        .when(F.col("flagged_count") > 0, "WARNING")
        .otherwise("OK")
    )
    return out.withColumn("status", status).select(*keep, "flagged", "flagged_share", "status")


def shadow_compare(live: DataFrame, shadow: DataFrame) -> DataFrame:
    """ECE of live and shadow probabilities on common predictions and what to do with the shadow.

    ``live``: match_id, league, market, probability, hit. ``shadow``: match_id, league, market, probability.
    """
    keys = ["match_id", "league", "market"]
    both = live.join(shadow.select(*keys, F.col("probability").alias("_shadow")), keys)
    runs = F.array(
        F.struct(F.lit("live").alias("run"), F.col("probability").alias("p")), F.struct(F.lit("shadow").alias("run"), F.col("_shadow").alias("p"))
    )
    scored = ece(both.select("league", "market", "hit", F.inline(runs)), ["league", "market", "run"], "a", p="p")
    pick = lambda run: F.max(F.when(F.col("run") == run, F.col("ece")))
    out = scored.groupBy("league", "market").agg(pick("live").alias("live_ece"), pick("shadow").alias("shadow_ece"))
    x, y = F.col("live_ece"), F.col("shadow_ece")
    verdict = F.when(y < x - SHADOW_TOLERANCE, "PROMOTE").when(F.abs(y - x) <= SHADOW_TOLERANCE, "HOLD").otherwise("REVERT")
    return out.withColumns({"delta": x - y, "verdict": verdict})


def shadow_code(rows: DataFrame) -> DataFrame:
    """2 if any bucket reverts, else 0 if any promotes, else 1."""
    any_ = lambda v: F.coalesce(F.some(F.col("verdict") == v), F.lit(False))
    return rows.agg(F.when(any_("REVERT"), 2).when(any_("PROMOTE"), 0).otherwise(1).alias("code"))


def volume_check(df: DataFrame, day: Column) -> DataFrame:
    """Days above 1.5 times the 95th percentile of the other days' counts.

    A day is one row after the count, so the percentile is over a calendar.
    """
    days = df.groupBy(day.alias("day")).agg(F.count(F.lit(1)).alias("picks"))
    p95 = days.agg(F.expr("percentile(picks, 0.95)").alias("p")).scalar()
    out = days.withColumn("limit", F.floor(p95 * VOLUME_FACTOR))
    return out.withColumn("status", F.when(F.col("picks") > F.col("limit"), "WATCH").otherwise("GO"))


def refit_due(bets: DataFrame, measured: DataFrame, key: str = "market", every: int = REFIT_EVERY) -> DataFrame:
    """Markets whose bet count just reached a multiple of ``every`` while badly calibrated."""
    counts = bets.groupBy(key).agg(F.count(F.lit(1)).alias("bets"))
    out = counts.join(measured.select(key, "ece"), key)
    due = (F.col("bets") > 0) & (F.col("bets") % every == 0) & (F.col("ece") > REFIT_ECE)
    return out.withColumn("refit", due)


def alert_rows(alerts: DataFrame, detected_at: dt.datetime) -> DataFrame:
    """Typed alert rows with a deterministic event id (D8). ``alerts``: league, market, status, alerts array."""
    one = alerts.select("league", "market", drift_status("status").alias("status"), F.posexplode("alerts").alias("ordinal", "alert"))
    one = one.select("*", alert_fields("alert").alias("_f"))
    kind = F.col("_f.type")
    severity = F.when((F.col("status") == "STOP") & ~kind.endswith("watch"), "CRITICAL").otherwise("WARNING")
    payload = F.to_json(F.struct("alert", F.col("_f.details").alias("details"), "ordinal", "status"))
    out = one.select(
        kind.alias("type"),
        F.coalesce("league", F.lit("")).alias("league"),
        F.coalesce("market", F.lit("")).alias("market"),
        severity.alias("severity"),
        F.col("_f.metric").alias("metric"),
        F.col("_f.value").alias("value"),
        F.col("_f.threshold").alias("threshold"),
        F.lit(detected_at.isoformat()).alias("detected_at"),
        payload.alias("payload_json"),
    )
    return out.withColumn("event_id", F.sha2(F.concat_ws("|", "type", "league", "market", "detected_at", "payload_json"), 256))


def stop_transitions(history: DataFrame, subject: list[str], order: list[str], **kw) -> DataFrame:
    """Rows where a subject turns to STOP from anything else or from nothing."""
    before = Feature(rolling={"previous_status": Rolling(1, F.max("status"))})
    out = point_in_time(history, subject, order, [before], **kw)
    return out.filter((F.col("status") == "STOP") & ~F.col("previous_status").eqNullSafe(F.lit("STOP")))
