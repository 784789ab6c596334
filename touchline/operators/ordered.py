"""Per-key ordered computations that stay spread out when one key is hot.

A plain ``Window.partitionBy(key)`` sends every row of a key to one task. ``point_in_time`` first counts rows
per key (one narrow, map-side combined pass). Keys of at most ``chunk_rows`` rows use the plain window. Larger
keys, of which there can be at most N / chunk_rows, are cut along their order into chunks; windows then run
per (key, chunk), and what a chunk needs from earlier ones travels separately:

* a *rolling* frame of w rows needs at most w earlier rows, copied in as a halo;
* a *running* aggregate needs one pre-aggregated prefix per chunk.

Chunk bounds fall between time buckets, so ties are never separated. Only the rows of hot keys are
checkpointed, so that halo and prefix do not replay the plan before them.
"""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from ..session import cut_lineage

CHUNK_ROWS = 2_000_000
BROADCAST_KEYS = 1_000_000


@dataclass(frozen=True)
class Running:
    """Aggregate over all earlier rows of the key; ``how`` in sum, count, max, min."""

    how: str
    value: Column
    include_current: bool = False


@dataclass(frozen=True)
class Rolling:
    """Aggregate expression over the ``width`` rows before the current one."""

    width: int
    value: Column
    include_current: bool = False


@dataclass
class Feature:
    """Window expressions plus the projection that turns them into output columns."""

    rolling: dict[str, Rolling] = field(default_factory=dict)
    running: dict[str, Running] = field(default_factory=dict)
    finish: dict[str, Column] = field(default_factory=dict)


_AGG = {"sum": F.sum, "count": F.count, "max": F.max, "min": F.min}


def _merge(how: str, prefix: Column, current: Column) -> Column:
    if how == "count":
        return F.coalesce(prefix, F.lit(0)) + F.coalesce(current, F.lit(0))
    if how == "sum":
        return F.when(
            prefix.isNotNull() | current.isNotNull(), F.coalesce(prefix, F.lit(0)) + F.coalesce(current, F.lit(0))
        )
    # greatest/least reject structs, so compare by hand
    better = prefix > current if how == "max" else prefix < current
    return F.when(current.isNull() | better, prefix).otherwise(current)


def default_bucket(df: DataFrame, order: str) -> Column:
    """Order-preserving coarse bucket of the leading order column."""
    kind = df.schema[order].dataType
    if isinstance(kind, (T.TimestampType, T.TimestampNTZType)):
        return F.date_trunc("HOUR", F.col(order))
    if isinstance(kind, T.DateType):
        return F.col(order)
    if isinstance(kind, (T.DoubleType, T.FloatType)):
        return F.floor(F.col(order) * 1000)
    raise TypeError(f"pass bucket= for an order column of type {kind.simpleString()}")


def point_in_time(
    df: DataFrame,
    keys: list[str],
    order: list[str],
    features: list[Feature],
    *,
    bucket: Column | None = None,
    chunk_rows: int = CHUNK_ROWS,
    split_hot_keys: bool = True,
) -> DataFrame:
    """Add the features' columns to ``df``. ``order`` must be a total order inside a key; keys are not null."""
    rolling = {k: v for f in features for k, v in f.rolling.items()}
    running = {k: v for f in features for k, v in f.running.items()}
    finish = {k: v for f in features for k, v in f.finish.items()}
    temp = [n for n in (*rolling, *running) if n.startswith("_")]

    plain = Window.partitionBy(*keys).orderBy(*order)
    hot = hot_keys(df, keys, chunk_rows) if split_hot_keys else None
    if hot is None:
        out = _windows(df, plain, rolling, running)
    else:
        cold = _windows(df.join(hot, keys, "left_anti").select(*df.columns), plain, rolling, running)
        hot_rows = cut_lineage(df.join(hot, keys, "left_semi").select(*df.columns))
        bucket = default_bucket(df, order[0]) if bucket is None else bucket
        out = cold.unionByName(_chunked(hot_rows, keys, order, rolling, running, bucket, chunk_rows))
    out = out.withColumns(finish) if finish else out
    return out.drop(*temp)


def hot_keys(df: DataFrame, keys: list[str], rows: int) -> DataFrame | None:
    """Keys with more than ``rows`` rows, or None. Broadcast only when their counted number is small."""
    counts = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n")).filter(F.col("_n") > rows).select(*keys)
    return None if counts.isEmpty() else counted(counts)


def counted(df: DataFrame) -> DataFrame:
    """``df``, materialised and counted: to be broadcast if its rows are few."""
    kept = cut_lineage(df)
    return F.broadcast(kept) if kept.count() <= BROADCAST_KEYS else kept


def _windows(df, spec, rolling, running):
    cols = {}
    for name, r in rolling.items():
        end = 0 if r.include_current else -1
        start = 1 - r.width if r.include_current else -r.width
        cols[name] = r.value.over(spec.rowsBetween(start, end))
    for name, r in running.items():
        end = 0 if r.include_current else -1
        cols[name] = _AGG[r.how](r.value).over(spec.rowsBetween(Window.unboundedPreceding, end))
    return df.withColumns(cols) if cols else df


def with_chunks(df: DataFrame, keys: list[str], bucket: Column, chunk_rows: int) -> DataFrame:
    """Add ``_chunk``, the piece of the key's order a row falls in."""
    df = df.withColumn("_bucket", bucket)
    before = Window.partitionBy(*keys).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    bounds = (
        df.groupBy(*keys, "_bucket")
        .agg(F.count(F.lit(1)).alias("_n"))
        .withColumn("_chunk", F.floor(F.coalesce(F.sum("_n").over(before), F.lit(0)) / chunk_rows))
        .drop("_n")
    )
    return df.join(bounds, [*keys, "_bucket"]).drop("_bucket")


def _chunked(df, keys, order, rolling, running, bucket, chunk_rows):
    columns = df.columns
    rows = with_chunks(df, keys, bucket, chunk_rows)
    by_chunk = Window.partitionBy(*keys).orderBy("_chunk")

    parts = rows.withColumn("_halo", F.lit(False))
    widest = max((r.width for r in rolling.values()), default=0)
    if widest:
        backwards = Window.partitionBy(*keys, "_chunk").orderBy(*[F.col(c).desc() for c in order])
        rest = [c for c in columns if c not in keys and c not in order]
        tails = (
            rows.withColumn("_r", F.row_number().over(backwards))
            .filter(F.col("_r") <= widest)
            .groupBy(*keys, "_chunk")
            .agg(F.sort_array(F.collect_list(F.struct(*order, *rest))).alias("_tail"))
        )
        # every earlier chunk holds at least one row, so `widest` chunks hold enough
        joined = F.flatten(F.collect_list("_tail").over(by_chunk.rowsBetween(-widest, -1)))
        halo = (
            tails.withColumn("_all", joined)
            .withColumn("_row", F.explode(F.expr(f"IF(size(_all) <= {widest}, _all, slice(_all, -{widest}, {widest}))")))
            .select(*keys, *[F.col(f"_row.{c}").alias(c) for c in (*order, *rest)], "_chunk", F.lit(True).alias("_halo"))
        )
        parts = parts.unionByName(halo)

    spec = Window.partitionBy(*keys, "_chunk").orderBy(*order)
    own = {n: Running(r.how, F.when(~F.col("_halo"), r.value), r.include_current) for n, r in running.items()}
    out = _windows(parts, spec, rolling, own).filter(~F.col("_halo")).drop("_halo")

    if running:
        totals = rows.groupBy(*keys, "_chunk").agg(*[_AGG[r.how](r.value).alias(n) for n, r in running.items()])
        earlier = by_chunk.rowsBetween(Window.unboundedPreceding, -1)
        prefix = totals.select(
            *keys,
            "_chunk",
            *[_AGG["sum" if r.how == "count" else r.how](n).over(earlier).alias(f"_p{n}") for n, r in running.items()],
        )
        out = out.join(prefix, [*keys, "_chunk"], "left")
        out = out.withColumns({n: _merge(r.how, F.col(f"_p{n}"), F.col(n)) for n, r in running.items()})
    new = [n for n in (*rolling, *running) if n not in columns]
    return out.select(*columns, *new)


def sequence(df: DataFrame, keys: list[str], order: list[str], name: str = "seq", **kw) -> DataFrame:
    """1-based position of each row in its key's order."""
    counted = Feature(running={name: Running("count", F.lit(1))}, finish={name: F.col(name) + 1})
    return point_in_time(df, keys, order, [counted], **kw)


def as_of(
    left: DataFrame,
    right: DataFrame,
    keys: list[str],
    time: str,
    payload: list[str],
    *,
    right_tie: list[str],
    strict: bool = False,
    default_first: bool = False,
    **kw,
) -> DataFrame:
    """Last right row at or before (``strict``: before) each left row, as union and running max.

    No range join: one shuffle of left plus right on the key, with hot keys chunked.
    ``default_first`` fills rows that have no earlier match with the key's first right row.
    """
    snapshot = F.struct(F.col(time).alias("_t"), *right_tie, *[c for c in payload if c not in right_tie])
    probe_side = 0 if strict else 1
    probes = left.withColumn("_side", F.lit(probe_side))
    history = right.select(*keys, time, F.lit(1 - probe_side).alias("_side"), snapshot.alias("_snap"))
    # probes carry no snapshot, so their order among themselves does not matter
    last = Feature(running={"last_": Running("max", F.col("_snap"))})
    both = probes.unionByName(history, allowMissingColumns=True)
    out = point_in_time(both, keys, [time, "_side"], [last], **kw).filter(F.col("_side") == probe_side)
    if default_first:
        first = right.groupBy(*keys).agg(F.min(snapshot).alias("_first"))
        out = out.join(first, keys, "left").withColumn("last_", F.coalesce("last_", "_first"))
    return out.select(*left.columns, *[F.col(f"last_.{c}").alias(c) for c in payload])


def top_per_key(
    df: DataFrame, keys: list[str], order: list[Column], n: int, spread: Column, salts: int = 64, rank: str | None = None
) -> DataFrame:
    """First ``n`` rows per key in two steps, so a hot key is cut down in ``salts`` tasks before it meets."""
    salted = df.withColumn("_salt", F.pmod(F.xxhash64(spread), F.lit(salts)))
    part = Window.partitionBy(*keys, "_salt").orderBy(*order)
    whole = Window.partitionBy(*keys).orderBy(*order)
    name = rank or "_rank"
    out = (
        salted.withColumn("_r", F.row_number().over(part))
        .filter(F.col("_r") <= n)
        .drop("_r", "_salt")
        .withColumn(name, F.row_number().over(whole))
        .filter(F.col(name) <= n)
    )
    return out if rank else out.drop("_rank")


def first_per_key(df: DataFrame, keys: list[str], order: list[Column], descending: bool = False) -> DataFrame:
    """One row per key by the smallest (or largest) order struct; a combinable aggregate, so copies never gather."""
    rest = [c for c in df.columns if c not in keys]
    pick = F.max_by if descending else F.min_by
    picked = df.groupBy(*keys).agg(pick(F.struct(*rest), F.struct(*order)).alias("_row"))
    return picked.select(*[F.col(c) if c in keys else F.col(f"_row.{c}").alias(c) for c in df.columns])


def all_of(conditions: list[Column]) -> Column:
    return reduce(lambda a, b: a & b, conditions)
