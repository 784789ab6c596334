"""Point-in-time features of a side: rolling, season-to-date, streak, form and context columns.

Each ``Feature`` builder only names window expressions; ``add_features`` runs any number of them in one
window pass, so the team key is shuffled once however many features are asked for.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .ordered import Feature, Rolling, Running, point_in_time, sequence

TEAM_KEY = ["team"]
TEAM_ORDER = ["match_date", "match_id"]

# Defaults for sides without history.
FORM_START = 1.5
REST_DEFAULT, REST_CAP = 7, 21
HOME_DEFAULT, AWAY_DEFAULT = 1.5, 1.0
H2H_DEFAULTS = {
    "avg_goals": 2.5,
    "over_2_5_rate": 0.53,
    "btts_rate": 0.54,
    "cards_over_2_5_rate": 0.77,
    "corners_under_11_5_rate": 0.72,
    "avg_cards": 4.0,
    "avg_corners": 10.0,
}
PRIORS = {"form": 1.0, "corners": 4.5, "cards": 2.2, "goals": 1.35, "rest": 7.0}

METRICS = ("goals", "corners", "cards", "shots")


def team_rows(contests: DataFrame, metrics: tuple[str, ...] = METRICS, extra: tuple[str, ...] = ()) -> DataFrame:
    """One contest becomes two rows, one per side, without a shuffle."""

    def side(own: str, other: str, is_home: int) -> Column:
        columns = [
            F.col(f"{own}_team").alias("team"),
            F.col(f"{other}_team").alias("opponent"),
            F.lit(is_home).alias("is_home"),
        ]
        for m in metrics:
            columns += [F.col(f"{own}_{m}").alias(f"{m}_for"), F.col(f"{other}_{m}").alias(f"{m}_against")]
        own_g, other_g = F.col(f"{own}_goals"), F.col(f"{other}_goals")
        points = F.when(own_g > other_g, 3).when(own_g == other_g, 1).when(own_g < other_g, 0)
        return F.struct(*columns, points.alias("points"))

    sides = F.array(side("home", "away", 1), side("away", "home", 0))
    return contests.select("match_id", "league", "season", "match_date", *extra, F.inline(sides))


def add_features(df: DataFrame, features: list[Feature], keys=None, order=None, **kw) -> DataFrame:
    return point_in_time(df, keys or TEAM_KEY, order or TEAM_ORDER, features, **kw)


def rolling_mean(columns: list[str], width: int) -> Feature:
    """Mean of the previous ``width`` matches, nulls skipped, null on debut."""
    return Feature(rolling={f"{c}_avg{width}": Rolling(width, F.avg(c)) for c in columns})


def rolling_density(width: int, time: str = "match_date") -> Feature:
    """Games in the frame, share of the frame filled, day span and games per day."""
    n, lo, hi = f"_n{width}", f"_lo{width}", f"_hi{width}"
    span = F.floor((F.unix_micros(hi) - F.unix_micros(lo)) / 86_400_000_000)
    return Feature(
        rolling={
            n: Rolling(width, F.count(F.lit(1))),
            lo: Rolling(width, F.min(time)),
            hi: Rolling(width, F.max(time)),
        },
        finish={
            f"games{width}": F.col(n),
            f"confidence{width}": F.col(n) / width,
            f"span_days{width}": span,
            f"density{width}": F.col(n) / (span + 1),
        },
    )


def rolling_source_date(width: int, time: str = "match_date") -> Feature:
    """Latest date that entered the frame, for leak audits."""
    return Feature(rolling={f"max_source_date{width}": Rolling(width, F.max(time))})


def rest_days(time: str = "match_date") -> Feature:
    """Whole days since the previous match; default first, then the cap."""
    days = F.floor((F.unix_micros(time) - F.unix_micros("_prev_date")) / 86_400_000_000)
    return Feature(
        rolling={"_prev_date": Rolling(1, F.max(time))},
        finish={"rest_days": F.least(F.coalesce(days, F.lit(REST_DEFAULT)), F.lit(REST_CAP))},
    )


def clean_sheets(width: int = 5) -> Feature:
    """Share of the frame without conceding, 0 on debut."""
    rate = F.avg((F.col("goals_against") == 0).cast("double"))
    return Feature(
        rolling={"_clean": Rolling(width, rate)},
        finish={"clean_sheet_rate": F.coalesce("_clean", F.lit(0.0))},
    )


def dominance(metric: str, width: int = 5) -> Feature:
    """Own share of a metric in the frame; 0.5 where it is undefined."""
    own, other = f"_{metric}_f{width}", f"_{metric}_a{width}"
    total = F.col(own) + F.col(other)
    return Feature(
        rolling={
            own: Rolling(width, F.sum(f"{metric}_for")),
            other: Rolling(width, F.sum(f"{metric}_against")),
        },
        finish={f"{metric}_dominance": F.coalesce(F.try_divide(F.col(own), total), F.lit(0.5))},
    )


def pressure(width: int = 5, corner_weight: float = 0.7) -> Feature:
    """Shot differential plus weighted corner differential; corners alone without shots."""
    parts = {f"_pr_{m}_{s}": Rolling(width, F.avg(f"{m}_{s}")) for m in ("shots", "corners") for s in ("for", "against")}
    shots = F.col("_pr_shots_for") - F.col("_pr_shots_against")
    corners = F.col("_pr_corners_for") - F.col("_pr_corners_against")
    return Feature(rolling=parts, finish={"pressure_index": F.coalesce(shots + corner_weight * corners, corners)})


def home_advantage() -> Feature:
    """Mean goals in earlier home matches minus mean in earlier away matches, with defaults."""
    running = {}
    for place, flag in (("h", 1), ("a", 0)):
        goals = F.when(F.col("is_home") == flag, F.col("goals_for"))
        running[f"_ha_s{place}"] = Running("sum", goals)
        running[f"_ha_n{place}"] = Running("count", goals)
    home = F.coalesce(F.try_divide(F.col("_ha_sh"), F.col("_ha_nh")), F.lit(HOME_DEFAULT))
    away = F.coalesce(F.try_divide(F.col("_ha_sa"), F.col("_ha_na")), F.lit(AWAY_DEFAULT))
    return Feature(running=running, finish={"home_advantage": home - away})


def season_goal_difference(df: DataFrame, **kw) -> DataFrame:
    """Goal difference in the season before the match."""
    total = Running("sum", F.col("goals_for") - F.col("goals_against"))
    feature = Feature(running={"_gd": total}, finish={"season_goal_diff": F.coalesce("_gd", F.lit(0))})
    return add_features(df, [feature], keys=["team", "season"], **kw)


def season_blend(df: DataFrame, columns: list[str], k: int = 5, **kw) -> DataFrame:
    """Season-to-date mean shrunk to the side's previous present season, else to the overall mean.

    The overall mean is a scalar subquery, not a cross join; previous seasons come from one row per
    (team, season).
    """
    running = {f"_s_{c}": Running("sum", F.col(c)) for c in columns}
    running |= {f"_n_{c}": Running("count", F.col(c)) for c in columns}
    # the helper drops names with a leading underscore only at the end, so finish here
    keep = {f"{c}_sum": F.col(f"_s_{c}") for c in columns} | {f"{c}_n": F.col(f"_n_{c}") for c in columns}
    feature = Feature(running=running, finish=keep)
    out = add_features(df, [feature], keys=["team", "season"], **kw)
    means = df.groupBy("team", "season").agg(*[F.avg(c).alias(f"{c}_mean") for c in columns])
    by_team = Window.partitionBy("team").orderBy("season")
    previous = means.select(
        "team", "season", *[F.lag(f"{c}_mean").over(by_team).alias(f"{c}_prev") for c in columns]
    )
    out = out.join(previous, ["team", "season"], "left")
    overall = {c: df.agg(F.avg(c).alias("m")).scalar() for c in columns}
    result = {}
    for c in columns:
        prev = F.coalesce(F.col(f"{c}_prev"), overall[c])
        seen = F.coalesce(F.col(f"{c}_sum"), F.lit(0))
        result[f"{c}_season"] = F.when(F.col(f"{c}_n") == 0, prev).otherwise((seen + prev * k) / (F.col(f"{c}_n") + k))
    temp = [f"{c}_{s}" for c in columns for s in ("sum", "n", "prev")]
    return out.withColumns(result).drop(*temp)


def _form_blocks(decay: float) -> tuple[int, int]:
    """Matches per block, and how many earlier blocks still weigh."""
    if not 0 < decay < 1:
        raise ValueError("decay must lie between 0 and 1")
    block = max(1, min(256, int(math.log(1e-12) / math.log(decay))))
    return block, math.ceil(math.log(1e-18) / (block * math.log(decay)))


def form(df: DataFrame, decay: float = 0.9, **kw) -> DataFrame:
    """Exponentially weighted points before the match, seeded with the first result.

    The recurrence y = decay*y + (1-decay)*x is a weighted sum, so it is computed per block of matches as a running
    sum with weights decay**-position, plus the state carried in from the blocks before. Blocks are short enough for
    decay**-position to stay below 1e12, and blocks are carried until what is older weighs less than 1e-18.
    """
    block, blocks = _form_blocks(decay)
    gain = 1.0 - decay
    x = F.when(F.col("seq_") == 1, F.col("points")).otherwise(F.col("points") * gain)
    rows = sequence(df, TEAM_KEY, TEAM_ORDER, "seq_", **kw)
    rows = rows.withColumns({"_block": F.floor((F.col("seq_") - 1) / block), "_pos": (F.col("seq_") - 1) % block})
    rows = rows.withColumn("_x", x * F.pow(F.lit(decay), -F.col("_pos")))

    state = rows.groupBy("team", "_block").agg((F.sum("_x") * F.pow(F.lit(decay), F.lit(block - 1))).alias("_part"))
    ahead = F.explode(F.sequence(F.lit(1), F.lit(blocks)))
    carried = (
        state.select("team", "_part", "_block", ahead.alias("_d"))
        .groupBy("team", (F.col("_block") + F.col("_d")).alias("_block"))
        .agg(F.sum(F.col("_part") * F.pow(F.lit(decay**block), F.col("_d") - 1)).alias("_carry"))
    )
    inside = Window.partitionBy("team", "_block").orderBy("seq_").rowsBetween(Window.unboundedPreceding, -1)
    own = F.coalesce(F.sum("_x").over(inside), F.lit(0.0)) * F.pow(F.lit(decay), F.col("_pos") - 1)
    before = F.coalesce(F.col("_carry"), F.lit(0.0)) * F.pow(F.lit(decay), F.col("_pos"))
    out = rows.withColumn("_own", own).join(carried, ["team", "_block"], "left")
    value = F.when(F.col("seq_") == 1, F.lit(FORM_START)).otherwise(F.col("_own") + before)
    return out.withColumn("form", value).select(*df.columns, "form")


def streaks(df: DataFrame, **kw) -> DataFrame:
    """Wins, and matches unbeaten, in a row before the match: rows since the last break."""
    rows = sequence(df, TEAM_KEY, TEAM_ORDER, "seq_", **kw)
    breaks = {
        "_last_nowin": Running("max", F.when(F.col("points") < 3, F.col("seq_"))),
        "_last_loss": Running("max", F.when(F.col("points") < 1, F.col("seq_"))),
    }
    finish = {
        "win_streak": F.col("seq_") - 1 - F.coalesce("_last_nowin", F.lit(0)),
        "unbeaten_streak": F.col("seq_") - 1 - F.coalesce("_last_loss", F.lit(0)),
    }
    return add_features(rows, [Feature(running=breaks, finish=finish)], **kw).drop("seq_")


def side_history(df: DataFrame, columns: list[str], *, decay: float = 0.9, days: int = 7, k: int = 5, time: str = "match_date") -> DataFrame:
    """Season blends of ``columns``, season goal difference, form, streaks and congestion together.

    Equal to ``season_blend``, ``season_goal_difference``, ``form``, ``streaks`` and ``congestion``, but every window here
    partitions by the side or finer, so the rows are shuffled once and only sorted anew: by time, by season, by block of
    the form sum. Frames over a whole earlier season or block are range frames on its number and are added up once per
    season or block. A side's rows meet in one task: for sides that ``hot_keys`` does not name, others need the operators.
    """
    block, blocks = _form_blocks(decay)
    past = (Window.unboundedPreceding, -1)
    by_time = Window.partitionBy(*TEAM_KEY).orderBy(*TEAM_ORDER)
    rows = df.withColumn("_seq", F.row_number().over(by_time).cast("long"))
    rows = rows.withColumns(
        {
            "_nowin": F.max(F.when(F.col("points") < 3, F.col("_seq"))).over(by_time.rowsBetween(*past)),
            "_loss": F.max(F.when(F.col("points") < 1, F.col("_seq"))).over(by_time.rowsBetween(*past)),
            "_at": F.unix_micros(time),
            "_block": F.floor((F.col("_seq") - 1) / block),
            "_pos": (F.col("_seq") - 1) % block,
        }
    )
    # Strictly between ``days`` ago and now: two running counts, as a frame with both ends would be counted anew per row.
    until = lambda end: F.count(F.lit(1)).over(Window.partitionBy(*TEAM_KEY).orderBy("_at").rangeBetween(past[0], end))
    earlier, gone = until(-1), until(-days * 86_400_000_000)
    gain = F.when(F.col("_seq") == 1, F.col("points")).otherwise(F.col("points") * (1.0 - decay))
    near = F.when(F.col("_at").isNull(), earlier).otherwise(earlier - gone)  # rows without a time count each other
    rows = rows.withColumns({"congestion": near, "_x": gain * F.pow(F.lit(decay), -F.col("_pos"))})

    inside = Window.partitionBy(*TEAM_KEY, "_block").orderBy(*TEAM_ORDER).rowsBetween(*past)
    by_block = Window.partitionBy(*TEAM_KEY).orderBy("_block")
    carried = F.lit(0.0)
    for d in range(1, blocks + 1):
        carried += F.coalesce(F.sum("_x").over(by_block.rangeBetween(-d, -d)), F.lit(0.0)) * decay ** (block * d - 1)
    rows = rows.withColumns({"_own": F.coalesce(F.sum("_x").over(inside), F.lit(0.0)), "_carry": carried})

    season = Window.partitionBy(*TEAM_KEY, "season").orderBy(*TEAM_ORDER).rowsBetween(*past)
    rows = rows.withColumn("_season", F.dense_rank().over(Window.partitionBy(*TEAM_KEY).orderBy("season")))
    before = Window.partitionBy(*TEAM_KEY).orderBy("_season").rangeBetween(-1, -1)
    sums = {"_gd": F.sum(F.col("goals_for") - F.col("goals_against")).over(season)}
    for c in columns:
        sums |= {f"_s_{c}": F.sum(c).over(season), f"_n_{c}": F.count(c).over(season), f"_p_{c}": F.avg(c).over(before)}
    rows = rows.withColumns(sums)

    weight = lambda n: F.pow(F.lit(decay), F.col("_pos") - n)
    out = {
        "season_goal_diff": F.coalesce("_gd", F.lit(0)),
        "form": F.when(F.col("_seq") == 1, F.lit(FORM_START)).otherwise(F.col("_own") * weight(1) + F.col("_carry") * weight(0)),
        "win_streak": F.col("_seq") - 1 - F.coalesce("_nowin", F.lit(0)),
        "unbeaten_streak": F.col("_seq") - 1 - F.coalesce("_loss", F.lit(0)),
        "congestion": F.col("congestion"),
    }
    for c in columns:
        prev = F.coalesce(F.col(f"_p_{c}"), df.agg(F.avg(c).alias("m")).scalar())
        seen = (F.coalesce(F.col(f"_s_{c}"), F.lit(0)) + prev * k) / (F.col(f"_n_{c}") + k)
        out[f"{c}_season"] = F.when(F.col(f"_n_{c}") == 0, prev).otherwise(seen)
    return rows.select(*df.columns, *[value.alias(name) for name, value in out.items()])


def missing_flags(df: DataFrame, columns: list[str]) -> DataFrame:
    """0/1 marker per rolling column, always emitted so the schema does not depend on the data."""
    return df.withColumns({f"{c}_missing": F.col(c).isNull().cast("int") for c in columns})


def with_opponent(df: DataFrame, columns: list[str]) -> DataFrame:
    """Bring the other side's columns next to each row (J4): two rows per match, one shuffle on the match."""
    both = Window.partitionBy("match_id")

    def other(c: str) -> Column:
        home = F.max(F.when(F.col("is_home") == 1, F.col(c))).over(both)
        away = F.max(F.when(F.col("is_home") == 0, F.col(c))).over(both)
        return F.when(F.col("is_home") == 1, away).otherwise(home)

    return df.withColumns({f"opp_{c}": other(c) for c in columns})


def schedule_strength(df: DataFrame, scored: str, conceded: str) -> DataFrame:
    """Attack against what the opponent concedes, and defence against what it scores."""
    out = with_opponent(df, [scored, conceded])
    return out.withColumns(
        {
            "sos_attack": F.col(scored) - F.col(f"opp_{conceded}"),
            "sos_defence": F.col(f"opp_{scored}") - F.col(conceded),
        }
    )


def reassemble(matches: DataFrame, team: DataFrame, columns: list[str], key: str = "match_id", unique: bool = False) -> DataFrame:
    """Home and away feature columns back on the match row: one aggregate of two structs, one join.

    Of several rows for one side of a match the largest by ``columns``, in their order, stands. ``unique``: there is one at
    most, so columns need not be compared together, and those that nobody reads are neither made nor shuffled.
    """
    flags = (("home", 1), ("away", 0))
    largest = lambda value, flag: F.max(F.when(F.col("is_home") == flag, value))
    if unique:
        wide = team.groupBy(key).agg(*[largest(F.col(c), flag).alias(f"{side}_{c}") for side, flag in flags for c in columns])
    else:
        wide = team.groupBy(key).agg(*[largest(F.struct(*columns), flag).alias(f"_{side}") for side, flag in flags])
        wide = wide.select(key, *[F.col(f"_{side}.{c}").alias(f"{side}_{c}") for side, _ in flags for c in columns])
    return matches.join(wide, key, "left")


def deltas(df: DataFrame, names: list[str]) -> DataFrame:
    """Home minus away, and its size."""
    cols = {f"delta_{n}": F.col(f"home_{n}") - F.col(f"away_{n}") for n in names}
    return df.withColumns(cols).withColumns({f"abs_delta_{n}": F.abs(F.col(f"delta_{n}")) for n in names})


def head_to_head(df: DataFrame, strict: bool = False, as_of_safe: bool = False, **kw) -> DataFrame:
    """History of the unordered pair before the match.

    Kept from the original: the first meeting enters the rates as a miss, so a rate is hits / (prior + 1),
    0 at the first of several meetings; pairs that meet once get the defaults everywhere. ``strict`` divides
    by the prior count instead. Averages fall back to dataset means, which look ahead; ``as_of_safe`` uses
    the fixed defaults.
    """
    def total(metric: str) -> Column:
        return F.coalesce(f"home_{metric}", F.lit(0)) + F.coalesce(f"away_{metric}", F.lit(0))

    goals, cards, corners = total("goals"), total("cards"), total("corners")
    hits = {
        "over_2_5_rate": goals > 2.5,
        "btts_rate": (F.col("home_goals") > 0) & (F.col("away_goals") > 0),
        "cards_over_2_5_rate": cards > 2.5,
        "corners_under_11_5_rate": corners < 11.5,
    }
    pair = F.array_join(F.array_sort(F.array("home_team", "away_team")), "__vs__")
    rows = df.withColumn("pair", pair)
    running = {"_n": Running("count", F.lit(1))}
    for name, value in (("goals", goals), ("cards", cards), ("corners", corners)):
        running[f"_s_{name}"] = Running("sum", value)
    for name, hit in hits.items():
        running[f"_h_{name}"] = Running("sum", F.coalesce(hit, F.lit(False)).cast("int"))
    keep = {n[1:]: F.col(n) for n in running}
    out = add_features(rows, [Feature(running=running, finish=keep)], keys=["pair"], **kw)
    out = out.join(rows.groupBy("pair").agg(F.count(F.lit(1)).alias("meetings")), "pair")

    repeated = F.col("meetings") > 1
    cols = {"h2h_count": F.col("n")}
    for name in ("goals", "cards", "corners"):
        fallback = F.lit(H2H_DEFAULTS[f"avg_{name}"])
        if name != "goals" and not as_of_safe:
            fallback = df.agg((F.avg(f"home_{name}") + F.avg(f"away_{name}")).alias("m")).scalar()
        cols[f"h2h_avg_{name}"] = F.coalesce(F.try_divide(F.col(f"s_{name}"), F.col("n")), fallback)
    for name in hits:
        hit_sum = F.coalesce(F.col(f"h_{name}"), F.lit(0))
        default = F.lit(H2H_DEFAULTS[name])
        if strict:
            cols[f"h2h_{name}"] = F.coalesce(F.try_divide(hit_sum, F.col("n")), default)
        else:
            cols[f"h2h_{name}"] = F.when(repeated, hit_sum / (F.col("n") + 1)).otherwise(default)
    return out.withColumns(cols).select(*df.columns, "pair", *cols)


def referee_rate(df: DataFrame, width: int = 10, **kw) -> DataFrame:
    """Mean match cards over the referee's previous matches; blanks share one group, which the hot-key
    split keeps spread out; no history takes the overall mean (W15)."""
    name = F.coalesce(F.nullif(F.trim("referee"), F.lit("")), F.lit("UNKNOWN"))
    rows = df.withColumns({"referee_key": name, "_cards": F.col("home_cards") + F.col("away_cards")})
    rate = Feature(rolling={"rate_": Rolling(width, F.avg("_cards"))})
    out = add_features(rows, [rate], keys=["referee_key"], **kw)
    overall = df.agg(F.avg(F.col("home_cards") + F.col("away_cards")).alias("m")).scalar()
    return out.withColumn("referee_card_rate", F.coalesce(F.col("rate_"), overall)).drop("rate_", "_cards")


def congestion(df: DataFrame, days: int = 7, time: str = "match_date", **kw) -> DataFrame:
    """Matches of the side strictly inside the last ``days`` days.

    Each match enters at its time and leaves ``days`` later; the running balance at a probe is the count.
    Order at one instant: leave, probe, enter.
    """
    window = F.expr(f"INTERVAL {days} DAYS")
    steps = F.array(
        F.struct((F.col(time) + window).alias("_at"), F.lit(0).alias("_kind"), F.lit(-1).alias("_step")),
        F.struct(F.col(time).alias("_at"), F.lit(1).alias("_kind"), F.lit(0).alias("_step")),
        F.struct(F.col(time).alias("_at"), F.lit(2).alias("_kind"), F.lit(1).alias("_step")),
    )
    moves = df.select("*", F.inline(steps))
    balance = Feature(running={"congestion": Running("sum", F.col("_step"))})
    out = point_in_time(moves, TEAM_KEY, ["_at", "_kind", "match_id"], [balance], **kw)
    out = out.filter(F.col("_kind") == 1).drop("_at", "_kind", "_step")
    return out.withColumn("congestion", F.coalesce("congestion", F.lit(0)))


def context(df: DataFrame, time: str = "match_date") -> DataFrame:
    """Weekday (Monday 0), weekend flag, season progress and its phase."""
    progress = F.pmod(F.month(time) - 8, F.lit(12)) / 12
    phase = F.when(F.col("season_progress") <= 0.33, "early").when(F.col("season_progress") <= 0.66, "mid").otherwise("late")
    out = df.withColumns({"day_of_week": F.weekday(time), "season_progress": progress})
    return out.withColumns({"is_weekend": (F.col("day_of_week") >= 5).cast("int"), "season_phase": phase})


def impute_priors(df: DataFrame, columns: list[str]) -> DataFrame:
    """Fill nulls with the prior of the column's family; the first family in this order wins."""

    def prior(name: str) -> float:
        if "form" in name:
            return PRIORS["form"]
        if "corner" in name:
            return PRIORS["corners"]
        if "card" in name:
            return PRIORS["cards"]
        if "xg" in name or "goals" in name:
            return PRIORS["goals"]
        return PRIORS["rest"] if "rest" in name else PRIORS["goals"]

    return df.fillna({c: prior(c) for c in columns})


def days_since_meeting(df: DataFrame, time: str = "match_date", pair: str | None = None, **kw) -> DataFrame:
    """Days since the pair last met, null for a first meeting.

    ``pair``: the column ``head_to_head`` has put the pair in; its shuffle then serves here too.
    """
    if pair is None:
        df, pair = df.withColumn("pair", F.array_join(F.array_sort(F.array("home_team", "away_team")), "__vs__")), "pair"
    last = Feature(rolling={"_last": Rolling(1, F.max(time))}, finish={
        "days_since_h2h": F.floor((F.unix_micros(time) - F.unix_micros("_last")) / 86_400_000_000)
    })
    return add_features(df, [last], keys=[pair], **kw)
