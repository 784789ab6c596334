"""League tables as of a moment, and the same for every fixture."""

from __future__ import annotations

import datetime as dt
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..session import cut_lineage
from .ordered import CHUNK_ROWS, Feature, Rolling, Running, all_of, hot_keys, point_in_time, top_per_key, with_chunks

# Thresholds of the bands.
FORM_WINDOW, MIN_FORM = 5, 3
STRONG, MILD = 0.60, 0.20
TOP_PLACES, BOTTOM_PLACES = 4, 3

SCOPE = ["league", "season"]


def momentum_band(divergence: Column, recent: Column) -> Column:
    """Band of recent minus season points per game; the divergence is not rounded."""
    return (
        F.when(recent < MIN_FORM, "INSUFFICIENT_DATA")
        .when(divergence >= STRONG, "STRONG_POSITIVE")
        .when(divergence >= MILD, "MILD_POSITIVE")
        .when(divergence <= -STRONG, "STRONG_NEGATIVE")
        .when(divergence <= -MILD, "MILD_NEGATIVE")
        .otherwise("STABLE")
    )


def status_band(rank: Column, size: Column) -> Column:
    """TOP four, LOW three, else MID; TOP wins in tiny leagues."""
    return F.when(rank <= TOP_PLACES, "TOP").when(rank >= size - BOTTOM_PLACES + 1, "LOW").otherwise("MID")


def _derived(c: Callable[[str], Column]) -> dict[str, Column]:
    """Points per game and bands; ``c`` gives the column of a table by its name."""
    season, recent = c("points") / c("played"), c("recent_points") / c("recent_n")
    return {
        "season_ppg": F.round(season, 2),
        "recent_ppg": F.round(recent, 2),
        "divergence": F.round(recent - season, 2),
        "momentum_band": momentum_band(recent - season, c("recent_n")),
        "status_band": status_band(c("rank"), c("league_size")),
    }


def _finish(table: DataFrame, scope: list[str]) -> DataFrame:
    """Points per game, bands and ranks. A league's table has one row per side, so these windows stay small."""
    place = Window.partitionBy(*scope).orderBy(F.col("points").desc(), F.col("gd").desc(), F.col("gs").desc(), "team")
    size = F.count(F.lit(1)).over(Window.partitionBy(*scope))
    out = table.withColumns({"rank": F.row_number().over(place), "league_size": size})
    return out.withColumns(_derived(F.col)).drop("recent_points", "recent_n")


def standings(team: DataFrame, as_of: dt.datetime, league: str | None = None, season: str | None = None) -> DataFrame:
    """Tables of all (or one) league and season before ``as_of``."""
    rows = team.filter(F.col("match_date") < F.lit(as_of))
    if league is not None:
        rows = rows.filter(F.col("league") == league)
    if season is not None:
        rows = rows.filter(F.col("season") == season)
    keys = [*SCOPE, "team"]
    total = rows.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("played"),
        F.sum("points").alias("points"),
        F.sum(F.col("goals_for") - F.col("goals_against")).alias("gd"),
        F.sum("goals_for").alias("gs"),
    )
    newest = [F.col("match_date").desc(), F.col("match_id").desc()]
    last = top_per_key(rows.select(*keys, "match_date", "match_id", "points"), keys, newest, FORM_WINDOW, F.col("match_id"))
    recent = last.groupBy(*keys).agg(F.sum("points").alias("recent_points"), F.count(F.lit(1)).alias("recent_n"))
    return _finish(total.join(recent, keys), SCOPE)


STATE = ["points", "gd", "gs", "played", "recent_points", "recent_n"]


class _Table:
    """A league's table, carried through its matches; only the sides that played since the last kickoff change."""

    def __init__(self):
        self.number: dict[str, int] = {}
        # The first row stands for sides without a match.
        self.state, self.rank = np.full((1, len(STATE)), np.nan), np.full(1, np.nan)
        # What the places go by, least first: name, goals, difference, points (missing ones last), and who has not played.
        self.places = np.ones((5, 1))
        self.size, self.ranked = 0, True

    def add(self, names: list[str]) -> None:
        """Make room for sides that were not seen before."""
        known = len(self.number) + 1
        self.number.update((n, known + i) for i, n in enumerate(names))
        self.state = np.vstack([self.state, np.full((len(names), len(STATE)), np.nan)])
        self.rank = np.r_[self.rank, np.full(len(names), np.nan)]
        self.places = np.hstack([self.places, np.ones((5, len(names)))])
        for place, name in enumerate(sorted(self.number)):
            self.places[0, self.number[name]] = place

    def play(self, side: np.ndarray, facts: np.ndarray) -> None:
        """Rows of states in the order of the matches, so a side's last one counts."""
        self.state[side] = facts
        self.places[1:4, side] = -np.nan_to_num(facts[:, [2, 1, 0]], nan=-np.inf).T
        self.places[4, side] = 0
        self.ranked = False

    def ranks(self) -> np.ndarray:
        if not self.ranked:
            self.size = self.places.shape[1] - np.count_nonzero(self.places[4])
            self.rank[np.lexsort(self.places)[: self.size]] = np.arange(1, self.size + 1)
            self.ranked = True
        return self.rank

    def answer(self, rows: pd.DataFrame) -> pd.DataFrame:
        """Table rows of both sides of the fixtures among ``rows``, the next ones of the scope in the order of time."""
        played = rows["team"].notna().to_numpy()
        changes, fixtures = rows[played], rows[~played]
        teams = changes["team"].to_numpy(dtype=object)
        self.add(list(dict.fromkeys(n for n in teams if n not in self.number)))
        side = np.array([self.number[n] for n in teams], dtype="int64")
        facts = changes[STATE].to_numpy(dtype="float64")
        asked = np.array([[self.number.get(n, 0) for n in fixtures[c]] for c in ("home_team", "away_team")], dtype="int64").reshape(2, -1)
        out = np.full((2, len(fixtures), len(STATE) + 2), np.nan)
        _, first = np.unique(fixtures["us"].to_numpy(), return_index=True)
        # A kickoff's fixtures stand before the matches played at that time.
        until = np.cumsum(played)[~played][first]
        done = 0
        for now, begin, end in zip(until, first, [*first[1:], len(fixtures)]):
            if now > done:
                self.play(side[done:now], facts[done:now])
                done = now
            rank = self.ranks()
            for which in (0, 1):
                at = asked[which, begin:end]
                out[which, begin:end, :-2] = self.state[at]
                out[which, begin:end, -2] = rank[at]
                out[which, begin:end, -1] = self.size
        if done < len(side):
            self.play(side[done:], facts[done:])
        result = fixtures[[*SCOPE, "us", "home_team", "away_team"]].reset_index(drop=True)
        numbers = {f"{name}_{c}": out[which, :, k] for which, name in enumerate(("home", "away")) for k, c in enumerate([*STATE, "rank", "league_size"])}
        return result.assign(**numbers)


def _fold(batches: Iterator[pd.DataFrame], group: list[str]) -> Iterator[pd.DataFrame]:
    """Table rows of both sides of every fixture, for rows sorted by scope (or stretch of its time), time, and fixtures first.

    A task holds a batch and the table of the scope it is in, however many rows the scope has.
    """
    scope, table = None, _Table()
    for batch in batches:
        if not len(batch):
            continue
        keys = batch[group]
        starts = np.flatnonzero((keys != keys.shift()).any(axis=1).to_numpy())
        for begin, end in zip(starts, [*starts[1:], len(batch)]):
            key = tuple(keys.iloc[begin])
            if key != scope:
                scope, table = key, _Table()
            yield table.answer(batch.iloc[begin:end])


def _stretches(rows: DataFrame, chunk_rows: int, bucket: Column) -> DataFrame:
    """Cut scopes along time; the latest row per side goes on into the following stretches, up to the one of its next match."""
    cut = cut_lineage(with_chunks(rows, SCOPE, bucket, chunk_rows))
    changes = cut.filter(F.col("team").isNotNull())
    whole = F.struct(*rows.columns)
    last = changes.groupBy(*SCOPE, "team", "_chunk").agg(F.max_by(whole, F.struct("us", "match_id")).alias("_row"))
    end = cut.groupBy(*SCOPE).agg(F.max("_chunk").alias("_end"))
    following = F.lead("_chunk").over(Window.partitionBy(*SCOPE, "team").orderBy("_chunk"))  # a row per stretch
    spans = last.withColumn("_next", following).join(end, SCOPE)
    upto = F.coalesce("_next", "_end")
    later = F.when(upto > F.col("_chunk"), F.sequence(F.col("_chunk") + 1, upto))
    carried = spans.select("_row", F.explode(later).alias("_chunk")).select("_row.*", "_chunk")
    return cut.select(*rows.columns, "_chunk").unionByName(carried)


def with_standings(fixtures: DataFrame, team: DataFrame, columns: list[str], **kw) -> DataFrame:
    """Both sides' table rows as the league stood before each fixture.

    Cumulative states come from one running window per side. The states and the fixtures of a league and season meet
    in one task, sorted by time, which carries the table through the kickoffs batch by batch; no row is made per side and
    kickoff, and no scope is held whole. Scopes beyond ``chunk_rows`` rows are cut along time, and each stretch begins with the latest state of every side. Fixtures
    without a time or scope, and sides without an earlier match, have null columns.
    """
    keys = [*SCOPE, "team"]
    order = ["match_date", "match_id"]
    here = lambda how, v: Running(how, v, include_current=True)
    last = lambda v: Rolling(FORM_WINDOW, v, include_current=True)
    state = Feature(
        running={
            "_played": here("count", F.lit(1)),
            "_points": here("sum", F.col("points")),
            "_gd": here("sum", F.col("goals_for") - F.col("goals_against")),
            "_gs": here("sum", F.col("goals_for")),
        },
        rolling={"_recent_points": last(F.sum("points")), "_recent_n": last(F.count(F.lit(1)))},
        finish={f"s_{c}": F.col(f"_{c}") for c in STATE},
    )
    us = F.unix_micros(F.col("match_date").cast("timestamp"))
    placed = all_of([F.col(c).isNotNull() for c in (*SCOPE, "match_date")])
    played = team.filter(placed & F.col("team").isNotNull())
    chunk_rows = kw.get("chunk_rows", CHUNK_ROWS)
    # One count for both: where no scope is large, no side is.
    counted = played.select(*SCOPE).unionByName(fixtures.filter(placed).select(*SCOPE))
    split = kw.get("split_hot_keys", True) and hot_keys(counted, SCOPE, chunk_rows) is not None
    states = point_in_time(played, keys, order, [state], **{**kw, "split_hot_keys": split})
    states = states.select(*keys, us.alias("us"), "match_id", *[F.col(f"s_{c}").cast("long").alias(c) for c in STATE])
    pairs = fixtures.filter(placed).select(*SCOPE, us.alias("us"), "home_team", "away_team").distinct()
    rows = states.unionByName(pairs, allowMissingColumns=True)
    if split:
        hour = F.floor(F.col("us") / 3_600_000_000)
        rows = _stretches(rows, chunk_rows, hour if kw.get("bucket") is None else F.col("us"))
    fields = {f"{side}_{c}": "long" for side in ("home", "away") for c in [*STATE, "rank", "league_size"]}
    kinds = {**{c: rows.schema[c].dataType.simpleString() for c in SCOPE}, "us": "long", "home_team": "string", "away_team": "string", **fields}
    group = [*SCOPE, *(["_chunk"] if split else [])]
    # Rows of one side and match are told apart by their count, so the last of them counts.
    in_order = rows.repartition(*group).sortWithinPartitions(
        *group, "us", F.col("team").isNotNull(), F.col("match_id").asc_nulls_last(), "played"
    )
    folded = in_order.select(*group, "us", "team", *STATE, "home_team", "away_team").mapInPandas(
        lambda batches: _fold(batches, group), ", ".join(f"{n} {k}" for n, k in kinds.items())
    )
    meet = [*SCOPE, "us", "home_team", "away_team"]
    right = folded.select(*[F.col(c).alias(f"_k_{c}") for c in meet], *[F.col(c).alias(f"_t_{c}") for c in fields])
    both = all_of([(us if c == "us" else F.col(c)).eqNullSafe(F.col(f"_k_{c}")) for c in meet])
    out = fixtures.join(right, both, "left")

    def at(side: str, name: str) -> Column:
        c = lambda n: F.col(f"_t_{side}_{n}")
        known = {**_derived(c), "rank": c("rank").cast("int")}
        return F.when(c("rank").isNotNull(), known[name] if name in known else c(name)).alias(f"{side}_{name}")

    return out.select(*[fixtures[c] for c in fixtures.columns], *[at(side, c) for side in ("home", "away") for c in columns])
