"""Projections, filters, table expectations and guards."""

from __future__ import annotations

import datetime as dt
import re
from functools import reduce
from zoneinfo import ZoneInfo

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.scalars import parse_day_first, short_fingerprint, strip_control, valid_key

# Fixed values.
FINISHED = ["FT", "AET", "FINISHED"]
BOOKMAKER_COLUMNS = r"^(B365|BW|BS|BF|GB|IW|LB|PS|SB|SJ|SO|SY|VC|WH|Max|Avg|Bb|P[HDA]|1XB)"
ID_COLUMNS = ("team_id", "home_team", "away_team")
OUTCOMES = ["WON", "LOST", "VOID"]
CANONICAL = T.StructType(
    [
        T.StructField("match_id", T.LongType()),
        T.StructField("league", T.StringType()),
        T.StructField("season", T.StringType()),
        T.StructField("match_date", T.TimestampType()),
        T.StructField("home_team", T.StringType()),
        T.StructField("away_team", T.StringType()),
        T.StructField("home_goals", T.IntegerType()),
        T.StructField("away_goals", T.IntegerType()),
        T.StructField("home_corners", T.DoubleType()),
        T.StructField("away_corners", T.DoubleType()),
        T.StructField("referee", T.StringType()),
        T.StructField("attendance", T.DoubleType()),
    ]
)


def drop_matching(df: DataFrame, pattern: str = BOOKMAKER_COLUMNS) -> DataFrame:
    """Drop columns whose name matches; the scan never reads them."""
    return df.select(*[c for c in df.columns if not re.search(pattern, c)])


def conform(df: DataFrame, schema: T.StructType, alternatives: dict[str, list[str]] | None = None) -> DataFrame:
    """Rename the first alternative name present, add absent columns as typed nulls, slice to the schema."""
    alternatives = alternatives or {}
    out = []
    for f in schema.fields:
        name = next((n for n in (f.name, *alternatives.get(f.name, [])) if n in df.columns), None)
        value = F.lit(None) if name is None else F.col(name)
        out.append(value.try_cast(f.dataType).alias(f.name) if name else value.cast(f.dataType).alias(f.name))
    return df.select(*out)


def parse_dates(df: DataFrame, column: str) -> DataFrame:
    """Day-first dates; rows that do not parse are dropped."""
    return df.withColumn(column, parse_day_first(column)).filter(F.col(column).isNotNull())


def coerce(df: DataFrame, columns: list[str], required: list[str] | None = None) -> DataFrame:
    """Text to numbers, null where it is none; rows without a required number go."""
    out = df.withColumns({c: F.col(c).try_cast("double") for c in columns})
    return out.dropna(subset=required) if required else out


def split_invalid(df: DataFrame, valid: Column) -> tuple[DataFrame, DataFrame]:
    """(good, bad) rows; null counts as bad (IO3)."""
    ok = F.coalesce(valid, F.lit(False))
    return df.filter(ok), df.filter(~ok)


def sanitize(df: DataFrame, identifiers: tuple[str, ...] = ID_COLUMNS) -> tuple[DataFrame, DataFrame]:
    """Strip control characters, trim, upper-case identifiers; ids with other characters are violations."""
    text = [f.name for f in df.schema.fields if isinstance(f.dataType, T.StringType)]
    present = [c for c in identifiers if c in df.columns]
    clean = df.withColumns({c: F.upper(strip_control(c)) if c in present else strip_control(c) for c in text})
    bad = [~F.col(c).rlike(r"(?U)^[\w\s\-\.']+$") | F.col(c).isNull() for c in present]
    wrong = reduce(lambda a, b: a | b, bad) if bad else F.lit(False)
    return clean.filter(~wrong), clean.filter(wrong)


def drop_future(df: DataFrame, as_of: dt.datetime, time: str = "match_date") -> DataFrame:
    """Rows up to ``as_of``."""
    return df.filter(F.col(time) <= F.lit(as_of))


def finished_only(df: DataFrame, as_of: dt.datetime, time: str = "match_date") -> DataFrame:
    """Finished matches before ``as_of``."""
    return df.filter(F.col("status").isin(FINISHED) & (F.col(time) < F.lit(as_of)))


def date_range(name: str, now: dt.datetime, tz: str = "UTC") -> tuple[dt.datetime, dt.datetime | None, bool]:
    """UTC start, end (None: open) and whether finished matches stay, for a named calendar range."""
    local = now.astimezone(ZoneInfo(tz))
    today = local.replace(hour=0, minute=0, second=0, microsecond=0)
    weekday = local.weekday()
    days = ["monday", "tuesday", "wednesday", "thursday", "friday", "saturday", "sunday"]

    def day(offset: int) -> dt.datetime:
        return dt.datetime.combine(today.date() + dt.timedelta(days=offset), dt.time(), tzinfo=ZoneInfo(tz))

    if name == "yesterday":
        bounds = day(-1), day(0)
    elif name == "tomorrow":
        bounds = day(1), day(2)
    elif name == "weekend":
        saturday = -1 if weekday == 6 else 5 - weekday
        bounds = day(saturday - 1), day(saturday + 2)
    elif name == "week":
        bounds = (day(0), day(5 - weekday)) if weekday <= 4 else (day(7 - weekday), day(12 - weekday))
    elif name == "month":
        bounds = day(0), day(30)
    elif name == "all":
        bounds = day(-2), None
    elif name in days:
        ahead = (days.index(name) - weekday) % 7
        bounds = day(ahead), day(ahead + 1)
    else:
        bounds = day(0), day(1)
    start, end = (b.astimezone(dt.UTC) if b else None for b in bounds)
    return start, end, name == "yesterday"


def date_filter(df: DataFrame, name: str, now: dt.datetime, tz: str = "UTC", time: str = "match_date") -> DataFrame:
    """Calendar range in the user's time zone as two UTC bounds, which reach the scan (P10)."""
    start, end, keep_finished = date_range(name, now, tz)
    keep = F.col(time) >= F.lit(start)
    if end is not None:
        keep &= F.col(time) < F.lit(end)
    if not keep_finished:
        keep &= ~F.upper("status").isin(FINISHED)
    return df.filter(keep)


def expect(df: DataFrame, rules: dict[str, Column], unique: list[str] | None = None, sample: str | None = None) -> DataFrame:
    """Violations per rule, one pass for all rules; a key's duplicates are counted separately.

    Returns (rule, violations, sample); the sample is the smallest offending value of the ``sample`` column.
    """
    flags = {n: ~F.coalesce(ok, F.lit(False)) for n, ok in rules.items()}
    key = F.col(sample) if sample else F.lit(None)
    aggs = []
    for n, bad in flags.items():
        aggs += [F.count_if(bad).alias(f"n_{n}"), F.min(F.when(bad, key.cast("string"))).alias(f"s_{n}")]
    one = df.agg(*aggs)
    rows = F.array(*[F.struct(F.lit(n).alias("rule"), F.col(f"n_{n}").alias("violations"), F.col(f"s_{n}").alias("sample")) for n in rules])
    out = one.select(F.inline(rows))
    if unique:
        copies = df.groupBy(*unique).agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > 1)
        text = F.concat_ws("|", *[F.col(c).cast("string") for c in unique])
        out = out.unionByName(
            copies.agg(
                F.lit("unique_key").alias("rule"), F.count(F.lit(1)).alias("violations"), F.min(text).alias("sample")
            )
        )
    return out


def repair_key(df: DataFrame, key: str = "match_hash", date: str = "prediction_date") -> DataFrame:
    """Keep well-formed keys, rebuild others from the natural key, null where a part is missing."""
    rebuilt = short_fingerprint("league", date, F.upper(F.trim("home_team")), F.upper(F.trim("away_team")))
    return df.withColumn(key, F.when(valid_key(key), F.col(key)).otherwise(rebuilt))


# Where a shifted row holds each column.
SHIFTED_TO_RIGHT = {
    "prediction_id": "resolved_at",
    "match_hash": "prediction_id",
    "league": "match_hash",
    "kickoff_date": "league",
    "market": "kickoff_date",
    "probability": "market",
    "outcome": "probability",
    "resolved_at": "outcome",
}


def repair_shift(df: DataFrame) -> DataFrame:
    """Undo the one-column rotation of rows whose probability holds an outcome and whose market is a number."""
    shifted = F.col("probability").cast("string").isin(OUTCOMES) & F.col("market").cast("string").try_cast("double").isNotNull()
    flagged = df.withColumn("_shifted", F.coalesce(shifted, F.lit(False)))
    fixed = {to: F.when(F.col("_shifted"), F.col(source).cast("string")).otherwise(F.col(to).cast("string")) for to, source in SHIFTED_TO_RIGHT.items()}
    return flagged.withColumns(fixed).drop("_shifted")


def training_guards(
    df: DataFrame, features: list[str], min_rows: int = 1000, min_coverage: float = 0.98, max_bad_ratio: float = 0.01
) -> DataFrame:
    """Minimum rows, one league, worst column coverage, share of NaN or infinite cells: one pass, four verdicts."""

    def bad(c: str) -> Column:
        x = F.col(c).cast("double")
        return x.isNull() | F.isnan(x) | (F.abs(x) == F.lit(float("inf")))

    total = F.count(F.lit(1))
    one = df.agg(
        total.alias("rows"),
        F.count_distinct("league").alias("leagues"),
        F.least(*[F.count(c) / total for c in features], F.lit(1.0)).alias("worst_coverage"),
        (reduce(lambda a, b: a + b, [F.count_if(bad(c)) for c in features]) / (total * len(features))).alias("bad_ratio"),
    )
    return one.withColumns(
        {
            "rows_ok": F.col("rows") >= min_rows,
            "single_league_ok": F.col("leagues") <= 1,
            "coverage_ok": F.col("worst_coverage") >= min_coverage,
            "cells_ok": F.col("bad_ratio") <= max_bad_ratio,
        }
    )


def prediction_integrity(df: DataFrame, provenance: list[str], details: str = "details", max_p: float = 0.99) -> DataFrame:
    """First violated rule per prediction, null if sound."""
    p = F.col("probability")
    reason = (
        F.when(p.isNull() | F.isnan(p), "MISSING_PROBABILITY")
        .when((p < 0) | (p > 1), "OUT_OF_RANGE")
        .when(p > max_p, "OVERCONFIDENT")
    )
    for key in provenance:
        reason = reason.when(~F.coalesce(F.map_contains_key(details, F.lit(key)), F.lit(False)), f"MISSING_{key.upper()}")
    return df.withColumn("violation", reason)


def leak_violations(
    df: DataFrame, time: str, sources: list[str], debut: Column, rolling: list[str], rest: str = "rest_days", form: str = "form"
) -> DataFrame:
    """Counts of rows that break point-in-time order or feature ranges."""
    rules = {f"{s}_before_match": F.col(s).isNull() | (F.col(s) < F.col(time)) for s in sources}
    if rolling:
        rules["debut_has_no_history"] = ~debut | reduce(lambda a, b: a & b, [F.col(c).isNull() for c in rolling])
    rules["rest_not_negative"] = F.col(rest) >= 0
    rules["form_in_range"] = F.col(form).between(0, 3)
    return expect(df, rules).drop("sample")


# Name parts that mark targets, odds and leakage, and those that allow a name again.
EXCLUDED_NAMES = r"(^|_)(id|hash|target|odds|result|outcome|status|referee)(_|$)|max_source_date"
LEAKY_NAMES = r"(goals|score|corners|cards|shots|points|fouls)"
SAFE_NAMES = r"(avg|rolling|form|rest|season|delta|h2h|dominance|streak)"


def select_features(df: DataFrame, keep: list[str]) -> DataFrame:
    """Numeric columns that are neither ids, targets, odds nor same-match statistics."""
    numeric = [f.name for f in df.schema.fields if isinstance(f.dataType, T.NumericType) and f.name not in keep]
    chosen = [
        n
        for n in numeric
        if not re.search(EXCLUDED_NAMES, n) and (not re.search(LEAKY_NAMES, n) or re.search(SAFE_NAMES, n))
    ]
    return df.select(*keep, *chosen)


def allowed_markets(df: DataFrame, tokens: list[str], status: DataFrame | None = None, market: str = "market") -> DataFrame:
    """Markets whose name contains an allowed token and which no status row switches off."""
    out = df.filter(F.col(market).rlike("|".join(re.escape(t) for t in tokens)))
    if status is not None:
        off = status.filter(F.col("status") != "ACTIVE").select(market)
        out = out.join(off, market, "left_anti")
    return out
