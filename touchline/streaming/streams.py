"""Incremental and stateful behaviours as Structured Streaming jobs.

Sinks are parquet folders written in ``foreachBatch``. Every batch function can be replayed: it only adds keys
that are not there, or replaces whole partitions or numbered versions.
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Callable, Iterator
from contextlib import contextmanager

import numpy as np
import pandas as pd
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter, StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from ..functions.scalars import season_start, short_fingerprint
from ..operators import drift as d
from ..operators import joins as j
from ..operators import labels as lab
from ..operators import validate as v
from ..operators.ordered import first_per_key
from ..sources.files import EVENT_SCHEMA

# Fixed values.
COOLDOWN_HOURS = 24
KEPT_BETS = 1000
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def stream_events(spark: SparkSession, path: str, late: str = "1 day", files_per_batch: int = 100) -> DataFrame:
    """The JSON-lines event log as a stream with a watermark."""
    reader = spark.readStream.schema(EVENT_SCHEMA).option("maxFilesPerTrigger", files_per_batch)
    return reader.json(path).withWatermark("timestamp", late)


def stream_metrics(events: DataFrame, time: str = "timestamp", size: str = "1 day", slide: str | None = None) -> DataFrame:
    """Tumbling (or sliding) predictions, mean confidence and fallback share (T2, twin of G20)."""
    kind = F.col("event_type")
    span = F.window(time, size, slide) if slide else F.window(time, size)
    out = events.groupBy(span.alias("w")).agg(
        F.count(F.lit(1)).alias("events"),
        F.count_if(kind == "prediction_generated").alias("predictions"),
        F.avg(F.when(kind == "prediction_generated", F.col("confidence"))).alias("avg_confidence"),
        F.avg((kind == "model_fallback").cast("double")).alias("fallback_rate"),
    )
    return out.select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), "events", "predictions", "avg_confidence", "fallback_rate")


def stream_sessions(events: DataFrame, entity: str, gap: str, time: str = "timestamp") -> DataFrame:
    """Activity sessions per entity, closed by a gap."""
    out = events.groupBy(F.session_window(time, gap).alias("w"), entity).agg(F.count(F.lit(1)).alias("events"))
    return out.select(entity, F.col("w.start").alias("start"), F.col("w.end").alias("end"), "events")


def run_available(writer: DataStreamWriter, checkpoint: str) -> StreamingQuery:
    """Process what is there, then stop."""
    query = writer.option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    return query


def to_partitions(df: DataFrame, path: str, key: Column, name: str = "part") -> DataStreamWriter:
    """Update-mode rows into a folder, the newest version of a key's partition replacing the old one."""

    def write(batch: DataFrame, _: int) -> None:
        rows = batch.withColumn(name, key)
        rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(name).parquet(path)

    return df.writeStream.outputMode("update").foreachBatch(write)


def alert_hash(message: str, context: str) -> Column:
    """Key of an alert: message and its context JSON."""
    return F.substring(F.md5(F.concat(F.col(message), F.lit(":"), F.col(context))), 1, 12)


def stream_suppress(alerts: DataFrame, key: str, time: str, hours: int = COOLDOWN_HOURS, late: str = "7 days") -> DataFrame:
    """First alert per key, then the next one no sooner than ``hours`` after the last that was *sent*.

    ``dropDuplicatesWithinWatermark`` would also drop an alert after the cooldown while the watermark lags, so a
    per-key state of one timestamp is kept, until the watermark has passed its cooldown: whatever comes then would be
    sent anyway. Alerts without a time are not sent; those
    later than ``late`` are dropped by Spark and counted in the progress.
    """
    wait = hours * 3_600_000_000

    def run(group: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        last = state.get[0] if state.exists else None
        times = np.sort(np.concatenate([b["at"].to_numpy() for b in batches]))
        sent = []
        place = 0 if last is None else int(np.searchsorted(times, last + wait))
        while place < len(times):
            last = int(times[place])
            sent.append(last)
            place = int(np.searchsorted(times, last + wait))
        expiry = (last + wait) // 1000 + 1
        if expiry > state.getCurrentWatermarkMs():
            state.update((last,))
            state.setTimeoutTimestamp(expiry)
        elif state.exists:
            state.remove()
        yield pd.DataFrame({"key": [group[0]] * len(sent), "at": pd.Series(sent, dtype="int64")})

    timed = alerts.filter(F.col(time).isNotNull()).select(F.col(key).alias("key"), F.col(time).alias("_time"))
    keyed = timed.withWatermark("_time", late).withColumn("at", F.unix_micros("_time"))
    return keyed.groupBy("key").applyInPandasWithState(
        run, "key string, at long", "last long", "append", GroupStateTimeout.EventTimeTimeout
    )


#: A bet in the state of a market; the tier is 1 and 2 for TIERS, else 0.
BET = np.dtype([("at", "<i8"), ("id", "<i8"), ("conf", "<f8"), ("hit", "<i8"), ("tier", "<i1")])
TIERS = ("TIER_A", "TIER_B")
#: Bets judged together.
JUDGED = 50_000


class MarketState(StatefulProcessor):
    """Bets not yet behind the watermark, the last judged ones, and the end of the cooldown of a market (T4).

    One event-time timer stands at the earliest waiting bet. When the watermark passes it, all bets behind the
    watermark are judged in the order (time, id), so a verdict does not depend on which batch brought a bet. Waiting bets
    are kept a batch to an entry, as an entry each would cost more than judging them.
    """

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getMapState("waiting", "n long", "bets binary")
        self.entries = handle.getValueState("entries", "n long")
        self.recent = handle.getValueState("recent", "bets binary")
        self.seen = handle.getValueState("seen", "n long")
        self.stop_until = handle.getValueState("stop_until", "at long")
        self.alarm = handle.getValueState("alarm", "at long")

    def wake_at(self, micros: int) -> None:
        """Move the timer to ``micros`` where that is earlier than its present time."""
        when = micros // 1000
        if self.alarm.exists():
            if self.alarm.get()[0] <= when:
                return
            self.handle.deleteTimer(self.alarm.get()[0])
        self.handle.registerTimer(when)
        self.alarm.update((when,))

    def wait(self, parts: Iterator[np.ndarray]) -> None:
        entries = self.entries.get()[0] if self.entries.exists() else 0
        for bets in parts:
            self.waiting.updateValue((entries,), (bets.tobytes(),))
            entries += 1
            self.wake_at(int(bets["at"].min()))
        self.entries.update((entries,))

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        def packed(batch: pd.DataFrame) -> np.ndarray:
            bets = np.zeros(len(batch), BET)
            for c in ("at", "id", "conf", "hit"):
                bets[c] = batch[c].to_numpy()
            for code, tier in enumerate(TIERS, 1):
                bets["tier"][(batch["tier"] == tier).to_numpy()] = code
            return bets

        self.wait(packed(batch) for batch in rows if len(batch))
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        self.alarm.clear()
        entries = sorted((int(n[0]), bytes(packed[0])) for n, packed in self.waiting.iterator())
        bets = np.concatenate([np.frombuffer(packed, BET) for _, packed in entries])
        del entries
        bets = bets[np.lexsort((bets["id"], bets["at"]))]
        ready = int(bets["at"].searchsorted(timerValues.getCurrentWatermarkInMs() * 1000, side="left"))
        self.waiting.clear()
        self.entries.clear()
        self.wait(bets[i : i + JUDGED] for i in range(ready, len(bets), JUDGED))
        for i in range(0, ready, JUDGED):
            yield self.judge(key[0], bets[i : min(ready, i + JUDGED)])

    def judge(self, market: str, new: np.ndarray) -> pd.DataFrame:
        """A verdict per bet over the window that ends with it."""
        old = np.frombuffer(bytes(self.recent.get()[0]), BET) if self.recent.exists() else new[:0]
        seen = self.seen.get()[0] if self.seen.exists() else 0
        both = np.concatenate([old, new])
        window = d.MARKET_WINDOW

        def total(values: np.ndarray) -> np.ndarray:
            """Sums over the window of every new bet, in the same order of addition whatever came before."""
            padded = np.concatenate([np.zeros(window - 1), values])
            return np.lib.stride_tricks.sliding_window_view(padded, window)[len(old) :].sum(axis=1)

        def count(flags: np.ndarray) -> np.ndarray:
            """The same for whole numbers."""
            upto = np.concatenate([np.zeros(window, np.int64), np.cumsum(flags, dtype=np.int64)])
            return (upto[window:] - upto[:-window])[len(old) :]

        n = seen + 1 + np.arange(len(new))
        size = np.minimum(n, window)
        mean_conf, hit_rate = total(both["conf"]) / size, count(both["hit"]) / size
        in_tier = [both["tier"] == code for code in (1, 2)]
        (na, ha), (nb, hb) = [(count(rows), count(rows * both["hit"])) for rows in in_tier]
        inverted = (n >= window) & (na >= d.TIER_MIN) & (nb >= d.TIER_MIN) & (ha * nb < hb * na)
        drifting = np.round(mean_conf - hit_rate, 9) > d.MARKET_DRIFT
        judged = n >= d.MARKET_MIN
        at = new["at"]
        status = np.where(judged, "GO", "WATCH").astype(object)
        stop_until = self.stop_until.get()[0] if self.stop_until.exists() else None
        place = 0
        if stop_until is not None:
            place = int(np.searchsorted(at, stop_until))
            status[:place] = "STOP"
        alarms = np.flatnonzero(judged & (drifting | inverted))
        while (k := int(np.searchsorted(alarms, place))) < len(alarms):
            start = int(alarms[k])
            stop_until = int(at[start]) + COOLDOWN_HOURS * 3_600_000_000
            place = int(np.searchsorted(at, stop_until))
            status[start:place] = "STOP"
            self.stop_until.update((stop_until,))
        self.seen.update((int(n[-1]),))
        self.recent.update((both[-window:].tobytes(),))
        columns = {"at": at, "id": new["id"], "n": np.minimum(n, KEPT_BETS), "mean_conf": mean_conf, "hit_rate": hit_rate}
        return pd.DataFrame({"market": market, **columns, "status": status})

    def close(self) -> None:
        pass


@contextmanager
def state_store(spark: SparkSession, provider: str = ROCKSDB) -> Iterator[None]:
    """The state store for queries started inside; the session's own setting comes back afterwards."""
    name = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(name, None)
    spark.conf.set(name, provider)
    try:
        yield
    finally:
        spark.conf.unset(name) if before is None else spark.conf.set(name, before)


def stream_market_drift(bets: DataFrame, late: str = "1 hour") -> DataFrame:
    """Drift verdict after every bet of a market in the order of event time, with a 24-hour stop (T4).

    ``bets``: market, ts, id, conf, hit (0 or 1), tier. A bet is judged once the watermark has passed it, over the
    last 300 bets before and with it; any cut into batches gives the same rows, as long as no bet is later than
    ``late``. Such bets are dropped by Spark and counted in the progress. Rows that lack anything but the tier are
    not judged. A task holds a market's bets of one trigger and those waiting, so bound the trigger by
    ``maxFilesPerTrigger``. Append mode; start the query inside ``state_store``.
    """
    whole = bets.dropna(subset=["market", "ts", "id", "conf", "hit"]).withWatermark("ts", late)
    rows = whole.select("market", "ts", F.unix_micros("ts").alias("at"), "id", "conf", F.col("hit").cast("long").alias("hit"), "tier")
    return rows.groupBy("market").transformWithStateInPandas(
        statefulProcessor=MarketState(),
        outputStructType="market string, at long, id long, n long, mean_conf double, hit_rate double, status string",
        outputMode="Append",
        timeMode="EventTime",
    )


def read_or_none(spark: SparkSession, path: str) -> DataFrame | None:
    try:
        return spark.read.parquet(path)
    except AnalysisException:
        return None


def append_batch(batch: DataFrame, sink: str, key: list[str], order: list[Column], part: Column | None = None) -> None:
    """Add rows whose key the sink lacks, one copy each.

    ``part`` (a function of the key, such as the day of a match) cuts the sink into folders; only those that the batch
    touches are read. Their names pass the driver, a row per folder touched.
    """
    new = first_per_key(batch, key, order)
    existing = read_or_none(batch.sparkSession, sink)
    if part is None:
        if existing is not None:
            new = j.unseen(new, existing, key)
        new.write.mode("append").parquet(sink)
        return
    # The letter keeps folder names text, whatever they look like.
    new = new.withColumn("folder", F.concat(F.lit("f"), F.coalesce(part.cast("string"), F.lit(""))))
    if existing is not None:
        touched = [r.folder for r in new.select("folder").distinct().collect()]
        new = j.unseen(new, existing.filter(F.col("folder").isin(touched)), key)
    new.write.mode("append").partitionBy("folder").parquet(sink)


def stream_append(results: DataFrame, sink: str, key: list[str], order: list[Column], part: Column | None = None) -> DataStreamWriter:
    """Exactly-once append across batches and replays (T5). With ``part`` a batch reads only the folders it adds to."""
    return results.writeStream.foreachBatch(lambda batch, _: append_batch(batch, sink, key, order, part))


def stream_resolve(
    preds: DataFrame,
    results: DataFrame,
    registry: lab.MarketRegistry,
    *,
    key: str = "match_hash",
    market: str = "market",
    probability: str = "probability",
    pred_time: str = "kickoff",
    result_time: str = "match_date",
    wait_hours: int = 72,
    back_hours: int = 24,
    late_hours: int = 24,
    natural_date: str | None = None,
) -> DataFrame:
    """Settle a prediction stream against a result stream; both wait for each other in the state of a join.

    A result settles a prediction if it is dated from ``back_hours`` before (TIME_TRAVEL then) to ``wait_hours`` after
    it. Unmatched predictions leave the state as UNMATCHED once the watermark has passed that span; the watermark is
    that of the slower stream, so a lagging result stream loses nothing. States, columns and key repair
    (``natural_date``) are those of ``labels.resolve``; ``labels.outcome_rows`` picks what to persist.

    A (key, market) and the result of a key count once, the first to arrive. The watermarks wait for the whole span of
    the join (or ``late_hours``, if longer), so copies that outlive the state of the first cannot settle a second time.
    Rows that are invalid, or without a time, are left out, as no outcome is written for them.
    """
    span = f"{max(late_hours, wait_hours + back_hours)} hours"
    p = F.col(probability)
    rows = preds if natural_date is None else v.repair_key(preds, key, natural_date)
    ok_key = F.col(key).isNotNull() if natural_date is None else v.valid_key(key)
    rows = rows.filter(p.between(0, 1) & ~F.isnan(p) & ok_key & F.col(pred_time).isNotNull())
    whole = F.struct(*[F.col(c) for c in preds.columns]).alias("_pred")
    left = rows.select(F.col(key).alias("_key"), lab.canonical_market(market).alias("_market"), F.col(market).alias("_name"), F.col(pred_time).alias("_at"), whole)
    left = left.withWatermark("_at", span).dropDuplicatesWithinWatermark(["_key", "_name"])
    facts = [F.col(c) for c in lab.needs(registry)]
    known = results.filter(F.col(key).isNotNull() & F.col(result_time).isNotNull())
    right = known.select(F.col(key).alias("_result_key"), F.col(result_time).alias("_result_time"), *facts)
    right = right.withWatermark("_result_time", span).dropDuplicatesWithinWatermark(["_result_key"])
    near = F.expr(f"_key = _result_key AND _result_time >= _at - INTERVAL {back_hours} HOURS AND _result_time <= _at + INTERVAL {wait_hours} HOURS")
    joined = left.join(right, near, "left_outer").withColumn("_label", registry.lookup(F.col("_market")))
    state = (
        F.when(F.col("_result_time").isNull(), "UNMATCHED")
        .when(F.col("_result_time") < F.col("_at"), "TIME_TRAVEL")
        .when(F.col("_label").isNull(), "VOID")
        .when(F.col("_label") == 1.0, "WON")
        .otherwise("LOST")
    )
    return joined.select("_pred.*", state.alias("state"), F.col("_result_time").alias("result_time"))


def ingest_fixtures(df: DataFrame, now: dt.datetime, max_age_hours: int = 24) -> DataFrame:
    """Upcoming fixtures of the newest usable snapshot per league, malformed and past ones dropped.

    ``df``: league, fetched_at, kickoff (text), home_team, away_team, season (nullable). The same call works on a
    stream up to the duplicate removal, which there is ``dropDuplicates``.
    """
    cutoff = now - dt.timedelta(hours=max_age_hours)
    fresh = df.filter(F.col("fetched_at").between(F.lit(cutoff), F.lit(now)))
    if not df.isStreaming:
        newest = fresh.groupBy("league").agg(F.max("fetched_at").alias("fetched_at"))
        fresh = fresh.join(newest, ["league", "fetched_at"], "left_semi")
    rows = fresh.withColumn("date_utc", F.try_to_timestamp("kickoff"))
    named = (F.length(F.trim("home_team")) > 0) & (F.length(F.trim("away_team")) > 0)
    rows = rows.filter(F.col("date_utc").isNotNull() & (F.col("date_utc") >= F.lit(now)) & named)
    names = {c: F.upper(F.trim(c)) for c in ("home_team", "away_team")}
    rows = rows.withColumns({**names, "season": F.coalesce(F.col("season"), season_start("date_utc", 8))})
    rows = rows.withColumn("match_id", short_fingerprint("league", "date_utc", "home_team", "away_team"))
    out = rows.select("match_id", "league", "season", "date_utc", "home_team", "away_team", F.lit("SCHEDULED").alias("status"))
    if df.isStreaming:
        return out.dropDuplicates(["match_id"])
    return first_per_key(out, ["match_id"], [F.col("date_utc"), F.col("home_team")])


def reject_late(results: DataFrame, preds: DataFrame, key: str, result_time: str, pred_time: str, name: str = "late") -> DataFrame:
    """Drop results dated before the first prediction of their match, counting them in an observation.

    Rows behind the watermark of T1 are dropped by Spark and counted in the query progress.
    """
    first = preds.groupBy(key).agg(F.min(pred_time).alias("_first"))
    joined = results.join(first, key, "left")
    late = F.coalesce(F.col(result_time) < F.col("_first"), F.lit(False))
    seen = joined.observe(name, F.count_if(late).alias("late"), F.count(F.lit(1)).alias("rows"))
    return seen.filter(~late).select(*results.columns)
