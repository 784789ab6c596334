"""File sources and sinks: result CSVs with changing headers, JSON dimensions and logs, partitioned writes."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators.ordered import first_per_key
from ..operators.validate import conform

# Fixed values.
REQUIRED = ["HomeTeam", "AwayTeam", "FTHG", "FTAG", "Date"]
DIVISIONS = {"E0": "PL", "D1": "BL1", "F1": "FL1", "I1": "SA", "SP1": "PD"}
EVENT_SCHEMA = T.StructType(
    [
        T.StructField("timestamp", T.TimestampType()),
        T.StructField("event_type", T.StringType()),
        T.StructField("league", T.StringType()),
        T.StructField("match_id", T.StringType()),
        T.StructField("model_version", T.StringType()),
        T.StructField("confidence", T.DoubleType()),
        T.StructField("metadata", T.MapType(T.StringType(), T.StringType())),
    ]
)
PREDICTION_LOG = T.StructType(
    [
        T.StructField("match_id", T.StringType()),
        T.StructField("league", T.StringType()),
        T.StructField("date", T.StringType()),
        T.StructField("home_team", T.StringType()),
        T.StructField("away_team", T.StringType()),
        T.StructField("market", T.StringType()),
        T.StructField("probability", T.DoubleType()),
        T.StructField("model_version", T.StringType()),
        T.StructField("timestamp", T.StringType()),
    ]
)
LOG_ALTERNATIVES = {"match_id": ["match_hash"], "probability": ["predicted_probability"], "date": ["kickoff_date"]}
SHADOW_FIELDS = {"home": "home_win", "draw": "draw", "away": "away_win", "over_2_5": "over_2_5", "btts_yes": "btts_yes"}


def _names(header: str) -> list[str]:
    """Trimmed, unique column names of a header line."""
    out: list[str] = []
    for i, raw in enumerate(header.replace("\ufeff", "").rstrip("\r").split(",")):
        name = raw.strip().strip('"').strip() or f"blank_{i}"
        out.append(name if name.lower() not in {o.lower() for o in out} else f"{name}_{i}")
    return out


def csv_headers(spark: SparkSession, paths: list[str]) -> DataFrame:
    """One row per file: its header line and whether all its bytes are UTF-8."""
    lines = spark.read.text(paths).select("value", F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("start"))
    lines = lines.withColumn("row", F.monotonically_increasing_id())
    return lines.groupBy("path").agg(
        F.min_by("value", F.struct("start", "row")).alias("header"),
        F.every(F.is_valid_utf8("value")).alias("utf8"),
    )


def read_csv_groups(spark: SparkSession, paths: list[str], required: list[str] | None = None) -> tuple[DataFrame | None, DataFrame]:
    """(rows, skipped files) of CSV files with differing headers (IO1).

    Files are grouped by header and encoding, each group is one native CSV scan of all-text columns, and the
    groups are united by name. Only the list of files, not their rows, comes to the driver.
    """
    groups: dict[tuple[str, bool], list[str]] = {}
    skipped: list[tuple[str, str]] = []
    for row in csv_headers(spark, paths).collect():
        names = _names(row["header"] or "")
        missing = [c for c in required or [] if c not in names]
        if missing:
            skipped.append((row["path"], "missing " + ", ".join(missing)))
        else:
            groups.setdefault((row["header"], row["utf8"]), []).append(row["path"])
    parts = []
    for (header, utf8), files in sorted(groups.items()):
        schema = T.StructType([T.StructField(n, T.StringType()) for n in _names(header)])
        reader = spark.read.schema(schema).option("header", True).option("enforceSchema", True)
        reader = reader.option("encoding", "UTF-8" if utf8 else "ISO-8859-1")
        part = reader.csv(sorted(files))
        path = F.col("_metadata.file_path")
        parts.append(
            part.select(
                "*",
                F.element_at(F.split(path, "/"), -1).alias("source_file"),
                F.element_at(F.split(path, "/"), -2).alias("league_dir"),
                F.struct(path, F.col("_metadata.file_block_start"), F.monotonically_increasing_id()).alias("file_order"),
            )
        )
    rows = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts) if parts else None
    return rows, spark.createDataFrame(skipped, "path string, reason string")


def read_results(spark: SparkSession, base: str) -> tuple[DataFrame | None, DataFrame]:
    """Raw result files ``base/<league>/*.csv`` and the files left out (IO1)."""
    return read_csv_groups(spark, [f"{base}/*/*.csv"], REQUIRED)


def detect_league(df: DataFrame) -> DataFrame:
    """League of each file: first division code in it, else file-name prefix, else directory."""
    codes = F.create_map(*[F.lit(v) for kv in DIVISIONS.items() for v in kv])
    if "Div" in df.columns:
        first = df.filter(F.col("Div").isNotNull()).groupBy("source_file", "league_dir").agg(
            F.min_by(F.trim("Div"), "file_order").alias("_div")
        )
        df = df.join(first, ["source_file", "league_dir"], "left")
    else:
        df = df.withColumn("_div", F.lit(None).cast("string"))
    stem = F.upper("source_file")
    prefix = None
    for code, league in DIVISIONS.items():
        hit = stem.startswith(code)
        prefix = F.when(hit, league) if prefix is None else prefix.when(hit, league)
    folder = F.when(F.upper("league_dir").isin(*DIVISIONS.values()), F.upper("league_dir"))
    return df.withColumn("league", F.coalesce(F.try_element_at(codes, F.col("_div")), prefix, folder)).drop("_div")


def read_processed(spark: SparkSession, folder: str, league: str | None = None) -> DataFrame:
    """``<league>_<season>.csv`` files; a column empty or not numeric throughout its file is filled from the name (IO2)."""
    rows, _ = read_csv_groups(spark, [f"{folder}/{league or '*'}_*.csv"])
    if rows is None:
        raise ValueError(f"no files in {folder}")
    return fill_from_name(rows)


def fill_from_name(rows: DataFrame) -> DataFrame:
    """Competition and season from ``source_file`` where the file's own column is of no use (IO2)."""
    for name in ("competition", "season"):
        if name not in rows.columns:
            rows = rows.withColumn(name, F.lit(None).cast("string"))
    stem = F.regexp_replace("source_file", r"\.csv$", "")
    rows = rows.withColumns({"_league": F.split(stem, "_")[0], "_season": F.split(stem, "_")[1]})
    rows = rows.filter(F.col("_season").isNotNull())
    per_file = rows.groupBy("source_file").agg(
        (F.count("competition") == 0).alias("_no_league"),
        F.every(F.col("season").try_cast("double").isNotNull()).alias("_numeric"),
    )
    rows = rows.join(per_file, "source_file")
    digits = F.col("_season").rlike("^[0-9]+$")
    return rows.withColumns(
        {
            "competition": F.when(F.col("_no_league"), F.col("_league")).otherwise(F.col("competition")),
            "season": F.when(~F.col("_numeric") & digits, F.col("_season")).otherwise(F.col("season")),
        }
    ).drop("_league", "_season", "_no_league", "_numeric", "file_order")


def read_events(spark: SparkSession, path: str) -> DataFrame:
    """Daily JSON-lines event log (IO4)."""
    return spark.read.schema(EVENT_SCHEMA).json(path)


def read_membership(spark: SparkSession, path: str) -> DataFrame:
    """league, season, team from nested JSON league -> season -> [team] (IO5)."""
    nested = F.from_json("value", "map<string, map<string, array<string>>>")
    out = spark.read.text(path, wholetext=True).select(F.explode(nested).alias("league", "_s"))
    out = out.select("league", F.explode("_s").alias("season", "_t"))
    return out.select("league", "season", F.explode("_t").alias("team"))


def parse_shadow_log(lines: DataFrame) -> DataFrame:
    """Market rows of ``[RL-SHADOW]`` log lines, the last line per key wins (IO7). ``lines``: value, line_order."""
    text = F.col("value")
    number = r"(\d+(?:\.\d+)?)"
    fields = {n: F.regexp_extract(text, rf"\s{n}={number}(?:\s|$)", 1).try_cast("double") for n in SHADOW_FIELDS}
    out = lines.filter(text.contains("[RL-SHADOW]")).select(
        F.regexp_extract(text, r"match_id=(\S+)", 1).alias("match_id"),
        F.upper(F.split(F.regexp_extract(text, r"context=(\S+)", 1), ":")[0]).alias("league"),
        "line_order",
        F.inline(F.array(*[F.struct(F.lit(m).alias("market"), fields[n].alias("probability")) for n, m in SHADOW_FIELDS.items()])),
    )
    out = out.filter((F.col("match_id") != "") & F.col("probability").isNotNull())
    return first_per_key(out, ["match_id", "league", "market"], [F.col("line_order")], descending=True)


def read_shadow_log(spark: SparkSession, path: str) -> DataFrame:
    lines = spark.read.text(path).select(
        "value", F.struct(F.col("_metadata.file_path"), F.col("_metadata.file_block_start"), F.monotonically_increasing_id()).alias("line_order")
    )
    return parse_shadow_log(lines).drop("line_order")


def write_partitions(df: DataFrame, path: str, keys: list[str], fmt: str = "parquet", max_rows: int = 5_000_000) -> None:
    """One folder per key, replacing only the keys present (IO8).

    The rebalance hint gathers a key's rows into few files and lets AQE split a hot key.
    """
    (
        df.hint("rebalance", *keys)
        .write.mode("overwrite")
        .option("partitionOverwriteMode", "dynamic")
        .option("maxRecordsPerFile", max_rows)
        .partitionBy(*keys)
        .format(fmt)
        .save(path)
    )


def log_predictions(df: DataFrame, path: str, day: Column, now: str) -> None:
    """Append predictions to a log of nine fixed columns, partitioned by day (IO13)."""
    if "timestamp" not in df.columns:
        df = df.withColumn("timestamp", F.lit(now))
    rows = conform(df.withColumn("_day", day), T.StructType([*PREDICTION_LOG.fields, T.StructField("_day", T.StringType())]), LOG_ALTERNATIVES)
    rows.withColumnRenamed("_day", "day").write.mode("append").partitionBy("day").parquet(path)


def freeze_manifest(df: DataFrame, time: str = "match_date") -> DataFrame:
    """Content digest that ignores row order, rows, columns, date span, leagues, seasons, nulls: one pass (IO11).

    A row's digest is the first 15 hex digits of the md5 of its cells (by column name, ``|`` between them, ``~`` for
    null, times as microseconds); the sum over rows is hashed again.
    """
    nulls = reduce(lambda a, b: a + b, [F.count_if(F.col(c).isNull()) for c in df.columns])
    times = {f.name for f in df.schema.fields if isinstance(f.dataType, T.TimestampType)}
    cell = lambda c: F.coalesce((F.unix_micros(c) if c in times else F.col(c)).cast("string"), F.lit("~"))
    row = F.md5(F.concat_ws("|", *map(cell, sorted(df.columns))))
    digest = F.sum(F.conv(F.substring(row, 1, 15), 16, 10).cast("decimal(38,0)"))
    return df.agg(
        F.count(F.lit(1)).alias("rows"),
        F.lit(len(df.columns)).alias("columns"),
        F.min(time).alias("first"),
        F.max(time).alias("last"),
        F.count_distinct("league").alias("leagues"),
        F.count_distinct("season").alias("seasons"),
        nulls.alias("nulls"),
        F.sha2(digest.cast("string"), 256).alias("content_hash"),
    )


def coverage(df: DataFrame, by: str, columns: list[str], time: str = "match_date") -> DataFrame:
    """Rows, seasons, date span and null rate of each column per group (IO12)."""
    wide = df.groupBy(by).agg(
        F.count(F.lit(1)).alias("matches"),
        F.count_distinct("season").alias("seasons"),
        F.min(time).alias("first"),
        F.max(time).alias("last"),
        *[F.round(F.avg(F.col(c).isNull().cast("double")), 4).alias(f"_{c}") for c in columns],
    )
    rates = F.array(*[F.struct(F.lit(c).alias("column"), F.col(f"_{c}").alias("null_rate")) for c in columns])
    return wide.select(by, "matches", "seasons", "first", "last", F.inline(rates))
