"""Market labels, training targets and settlement."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import valid_key
from .ordered import all_of, first_per_key
from .validate import repair_key

Market = tuple[Callable[[], Column], tuple[str, ...]]

# Lines of the markets.
TEAM_CORNER_LINES = [2.5, 3.5, 4.5, 5.5, 6.5]
GOALS, CORNERS, CARDS = ("home_goals", "away_goals"), ("home_corners", "away_corners"), ("home_cards", "away_cards")


def _total(pair: tuple[str, str]) -> Column:
    return F.col(pair[0]) + F.col(pair[1])


def _line_name(line: float) -> str:
    return str(line).replace(".", "_")


@dataclass
class MarketRegistry:
    """Market name to (predicate, columns it needs); users add their own."""

    markets: dict[str, Market]

    def with_market(self, name: str, predicate: Callable[[], Column], needs: tuple[str, ...]) -> MarketRegistry:
        return MarketRegistry({**self.markets, name: (predicate, needs)})

    def label(self, name: str) -> Column:
        """1.0 / 0.0, null where a needed column is null."""
        predicate, needs = self.markets[name]
        return F.when(all_of([F.col(c).isNotNull() for c in needs]), predicate().cast("double"))

    def lookup(self, market: Column) -> Column:
        """Label of the market named in a column: one branch runs per row, no 43-fold unpivot."""
        chain = None
        for name in self.markets:
            branch = market == name
            chain = F.when(branch, self.label(name)) if chain is None else chain.when(branch, self.label(name))
        return chain


def default_markets() -> MarketRegistry:
    h, a = (lambda pair: F.col(pair[0])), (lambda pair: F.col(pair[1]))
    m: dict[str, Market] = {
        "home_win": (lambda: h(GOALS) > a(GOALS), GOALS),
        "draw": (lambda: h(GOALS) == a(GOALS), GOALS),
        "away_win": (lambda: a(GOALS) > h(GOALS), GOALS),
        "goals_over_2_5": (lambda: _total(GOALS) > 2.5, GOALS),
        "goals_under_2_5": (lambda: _total(GOALS) <= 2.5, GOALS),
        "home_goals_under_1_5": (lambda: h(GOALS) < 1.5, GOALS),
        "away_goals_under_1_5": (lambda: a(GOALS) < 1.5, GOALS),
        "btts_yes": (lambda: (h(GOALS) > 0) & (a(GOALS) > 0), GOALS),
        "btts_no": (lambda: ~((h(GOALS) > 0) & (a(GOALS) > 0)), GOALS),
        "corners_under_11_5": (lambda: _total(CORNERS) <= 11.5, CORNERS),
        "corners_over_9_5": (lambda: _total(CORNERS) > 9.5, CORNERS),
        "corners_over_7_5": (lambda: _total(CORNERS) > 7.5, CORNERS),
        "corners_home_win": (lambda: h(CORNERS) > a(CORNERS), CORNERS),
        "corners_draw": (lambda: h(CORNERS) == a(CORNERS), CORNERS),
        "corners_away_win": (lambda: a(CORNERS) > h(CORNERS), CORNERS),
        "home_cards_over_1_5": (lambda: h(CARDS) > 1.5, CARDS),
        "away_cards_over_1_5": (lambda: a(CARDS) > 1.5, CARDS),
        "cards_under_4_5": (lambda: _total(CARDS) < 4.5, CARDS),
        "cards_under_5_5": (lambda: _total(CARDS) <= 5.5, CARDS),
        "cards_over_2_5": (lambda: _total(CARDS) > 2.5, CARDS),
        "cards_over_3_5": (lambda: _total(CARDS) > 3.5, CARDS),
        "home_dc": (lambda: h(GOALS) >= a(GOALS), GOALS),
        "away_dc": (lambda: a(GOALS) >= h(GOALS), GOALS),
    }
    for side in ("home", "away"):
        for line in TEAM_CORNER_LINES:
            column = f"{side}_corners"
            m[f"{column}_under_{_line_name(line)}"] = (lambda c=column, x=line: F.col(c) < x, CORNERS)
            m[f"{column}_over_{_line_name(line)}"] = (lambda c=column, x=line: F.col(c) > x, CORNERS)
    return MarketRegistry(m)


def market_aliases() -> dict[str, str]:
    """Prediction market name to label name; anything else passes through."""
    # Fixed values.
    fixed = {
        "HOME_WIN": "home_win",
        "AWAY_WIN": "away_win",
        "HOME_TG_U1.5": "home_goals_under_1_5",
        "AWAY_TG_U1.5": "away_goals_under_1_5",
        "home_under_1_5": "home_goals_under_1_5",
        "away_under_1_5": "away_goals_under_1_5",
        "over_2_5": "goals_over_2_5",
        "under_2_5": "goals_under_2_5",
        "CORNERS_U11.5": "corners_under_11_5",
        "corners_u11.5": "corners_under_11_5",
        "corn_u11": "corners_under_11_5",
        "corn_o75": "corners_over_7_5",
        "cards_u4.5": "cards_under_4_5",
        "card_u45": "cards_under_4_5",
        "CARDS_U4.5": "cards_under_4_5",
        "cards_o2.5": "cards_over_2_5",
        "HOME_DC": "home_dc",
        "AWAY_DC": "away_dc",
    }
    for side in ("home", "away"):
        for line in TEAM_CORNER_LINES:
            short = str(line).replace(".", "")
            fixed[f"corn_{side}_u{short}"] = f"{side}_corners_under_{_line_name(line)}"
            fixed[f"corn_{side}_o{short}"] = f"{side}_corners_over_{_line_name(line)}"
    return fixed


def canonical_market(market: str | Column) -> Column:
    """Label name of a prediction market (J15); a literal map, so no join."""
    column = F.col(market) if isinstance(market, str) else market
    pairs = F.create_map(*[F.lit(v) for kv in market_aliases().items() for v in kv])
    return F.coalesce(F.try_element_at(pairs, column), column)


def label_matrix(df: DataFrame, registry: MarketRegistry, names: list[str] | None = None) -> DataFrame:
    """One label column per market (L1)."""
    return df.withColumns({n: registry.label(n) for n in names or registry.markets})


def label_incremental(master: DataFrame, labeled: DataFrame, registry: MarketRegistry, key: str = "match_id") -> DataFrame:
    """Labels for unseen matches; for seen ones only label columns the table lacks are filled in (L2)."""
    names = list(registry.markets)
    old = [n for n in names if n in labeled.columns]
    new = [n for n in names if n not in labeled.columns]
    fresh = label_matrix(master.join(labeled.select(key), key, "left_anti"), registry).select(key, *names)
    if new:
        filled = label_matrix(master.join(labeled.select(key), key, "left_semi"), registry, new).select(key, *new)
        seen = labeled.select(key, *old).join(filled, key, "left").select(key, *names)
    else:
        seen = labeled.select(key, *names)
    return seen.unionByName(fresh)


def double_chance_targets(df: DataFrame) -> DataFrame:
    """1X, X2 and 12 targets, null for matches not played (L3)."""
    h, a = F.col("home_goals"), F.col("away_goals")
    played = h.isNotNull() & a.isNotNull()
    return df.withColumns(
        {
            "target_1x": F.when(played, (h >= a).cast("int")),
            "target_x2": F.when(played, (a >= h).cast("int")),
            "target_12": F.when(played, (h != a).cast("int")),
        }
    )


def training_targets(df: DataFrame, cap: int = 6) -> DataFrame:
    """Capped goals, totals, outcome code 0 away / 1 draw / 2 home, season year (L4)."""
    h, a = F.col("home_goals"), F.col("away_goals")
    return df.withColumns(
        {
            "home_goals_capped": F.least(h, F.lit(cap)),
            "away_goals_capped": F.least(a, F.lit(cap)),
            "capped": (h > cap).cast("int") + (a > cap).cast("int"),
            "total_corners": F.col("home_corners") + F.col("away_corners"),
            "total_cards": F.col("home_cards") + F.col("away_cards"),
            "outcome_code": F.when(h < a, 0).when(h == a, 1).when(h > a, 2),
            "season_year": F.substring("season", 1, 4).try_cast("int"),
        }
    )


def _facts(results: DataFrame, key: str | list[str], first: list[str], columns: list[str]) -> DataFrame:
    """One result row per key, the first by ``first`` and then by its facts: copies must not double what they settle."""
    keys = [key] if isinstance(key, str) else key
    rest = [c for c in dict.fromkeys([*first, *columns]) if c not in keys]
    return first_per_key(results.filter(all_of([F.col(k).isNotNull() for k in keys])).select(*keys, *rest), keys, [F.col(c) for c in rest])


def needs(registry: MarketRegistry) -> list[str]:
    """Result columns that the markets read."""
    return sorted({c for _, cols in registry.markets.values() for c in cols})


def resolve(
    preds: DataFrame,
    results: DataFrame,
    registry: MarketRegistry,
    *,
    seen: DataFrame | None = None,
    key: str = "match_hash",
    order: list[str],
    pred_time: str = "kickoff",
    result_time: str = "match_date",
    market: str = "market",
    probability: str = "probability",
    natural_date: str | None = None,
) -> DataFrame:
    """Every prediction with its state (L5): INVALID_PROBABILITY, INVALID_KEY, DUPLICATE, UNMATCHED,
    TIME_TRAVEL, WON, LOST or VOID, checked in this order.

    With ``natural_date`` keys must be 16 hex digits; others are rebuilt from league, that date and both sides (P12) and
    are invalid if a part is missing. Without it any key but null is valid. A (key, market) counts once, the first in
    ``order``; the first is found by a combinable minimum, not by gathering the copies. Of several result rows of a key
    the first in ``result_time`` settles. Invalid rows go around the joins, so null keys meet nowhere. The label is
    computed once per row, for the one market asked for.
    """
    p = F.col(probability)
    ok_p = F.coalesce(p.between(0, 1) & ~F.isnan(p), F.lit(False))
    ok_key = F.col(key).isNotNull()
    rows = preds
    if natural_date is not None:
        rows = repair_key(preds, key, natural_date)
        ok_key = valid_key(key)
    nothing = F.lit(None).cast(results.schema[result_time].dataType)
    invalid = rows.filter(~(ok_p & ok_key)).withColumns(
        {"state": F.when(~ok_p, "INVALID_PROBABILITY").otherwise("INVALID_KEY"), "result_time": nothing}
    )
    valid = rows.filter(ok_p & ok_key).withColumn("_market", canonical_market(market))
    first = valid.groupBy(key, market).agg(F.min(F.struct(*order)).alias("_first"))
    if seen is not None:
        first = first.join(seen.select(key, market).distinct().withColumn("_seen", F.lit(True)), [key, market], "left")
    else:
        first = first.withColumn("_seen", F.lit(None).cast("boolean"))
    facts = _facts(results, key, [result_time], needs(registry)).withColumnsRenamed({result_time: "_result_time"})
    out = valid.join(first, [key, market], "left").join(facts.withColumn("_found", F.lit(True)), key, "left")
    out = out.withColumn("_label", registry.lookup(F.col("_market")))
    duplicate = F.coalesce(F.col("_seen"), F.lit(False)) | (F.struct(*order) != F.col("_first"))
    state = (
        F.when(duplicate, "DUPLICATE")
        .when(F.col("_found").isNull(), "UNMATCHED")
        .when(F.col("_result_time") < F.col(pred_time), "TIME_TRAVEL")
        .when(F.col("_label").isNull(), "VOID")
        .when(F.col("_label") == 1.0, "WON")
        .otherwise("LOST")
    )
    settled = out.select(*preds.columns, state.alias("state"), F.col("_result_time").alias("result_time"))
    return settled.unionByName(invalid)


def outcome_rows(resolved: DataFrame) -> DataFrame:
    """The rows to persist: unmatched, rejected and duplicate ones are not written."""
    return resolved.filter(F.col("state").isin("WON", "LOST", "VOID")).withColumnRenamed("state", "outcome")


def backfill_void(outcomes: DataFrame, results: DataFrame, registry: MarketRegistry, key: str = "match_id", market: str = "market") -> DataFrame:
    """Resolve again only the VOID rows; the rest skips the join."""
    void = outcomes.filter(F.col("outcome") == "VOID").withColumn("_market", canonical_market(market))
    redone = void.join(_facts(results, key, [], needs(registry)), key, "left").withColumn("_label", registry.lookup(F.col("_market")))
    redone = redone.withColumn("outcome", F.when(F.col("_label").isNull(), "VOID").when(F.col("_label") == 1.0, "WON").otherwise("LOST"))
    return outcomes.filter(F.col("outcome") != "VOID").unionByName(redone.select(*outcomes.columns))


def evaluate(preds: DataFrame, results: DataFrame, registry: MarketRegistry, key: str = "match_id", market: str = "market") -> DataFrame:
    """Signed and absolute error of predictions whose market is a label column."""
    joined = preds.filter(F.col(market).isin(*registry.markets)).join(_facts(results, key, [], needs(registry)), key)
    out = joined.withColumn("actual", registry.lookup(F.col(market))).filter(F.col("actual").isNotNull())
    out = out.withColumn("error", F.col("probability") - F.col("actual"))
    return out.withColumn("abs_error", F.abs("error")).select(*preds.columns, "actual", "error", "abs_error")


def leg_result(market: str = "market") -> Column:
    """WIN, LOSS or PENDING of one leg; market substrings are tried in this order."""
    m = F.col(market)
    zero = lambda c: F.coalesce(F.col(c), F.lit(0))
    goals = zero("home_goals") + zero("away_goals")
    corners = zero("home_corners") + zero("away_corners")
    cards = zero("home_cards") + zero("away_cards")
    # The slips' market names and lines.
    rules = [
        ("HOME_TG_U1.5", zero("home_goals") <= 1),
        ("AWAY_TG_U1.5", zero("away_goals") <= 1),
        ("CORNERS_U11.5", corners <= 11),
        ("CORNERS_O9.5", corners >= 10),
        ("CARDS_U5.5", cards <= 5),
        ("BTTS", (zero("home_goals") > 0) & (zero("away_goals") > 0)),
        ("O2.5", goals >= 3),
        ("U2.5", goals <= 2),
    ]
    result = F.when(F.col("status").isNull() | ~F.col("status").isin("FINISHED", "FT"), "PENDING")
    for token, won in rules:
        result = result.when(m.contains(token), F.when(won, "WIN").otherwise("LOSS"))
    return result.otherwise("PENDING")


def settle_slips(legs: DataFrame, results: DataFrame, on: list[str], slip: str = "slip_id", first: list[str] | None = None) -> DataFrame:
    """WIN if every leg wins, LOSS if one loses, else PENDING.

    Of several results of a key the first by ``first`` counts, by default the earliest match if results have a date.
    """
    first = [c for c in ("match_date",) if c in results.columns] if first is None else first
    facts = _facts(results, on, first, ["status", *GOALS, *CORNERS, *CARDS])
    marked = legs.join(facts, on, "left").withColumn("leg", leg_result())
    won, lost = F.col("leg") == "WIN", F.col("leg") == "LOSS"
    out = marked.groupBy(slip).agg(
        F.count(F.lit(1)).alias("legs"),
        F.count_if(won).alias("legs_won"),
        F.when(F.every(won), "WIN").when(F.some(lost), "LOSS").otherwise("PENDING").alias("result"),
    )
    return out


def parse_market(market: str | Column) -> Column:
    """Kind, side, direction and line of a market name such as ``corn_home_o45``."""
    m = F.lower(F.col(market) if isinstance(market, str) else market)
    kind = (
        F.when(m.isin("home_win", "away_win", "draw"), "result")
        .when(m.contains("double_chance"), "double_chance")
        .when(m.contains("corn"), "corners")
        .when(m.contains("card"), "cards")
        .when(m.contains("btts"), "btts")
        .otherwise("goals")
    )
    side = F.when(m.contains("home"), "home").when(m.contains("away"), "away").otherwise("total")
    spelled = F.regexp_extract(m, r"(over|under)_(\d+)_(\d+)", 1)
    spelled_line = F.concat(F.regexp_extract(m, r"(over|under)_(\d+)_(\d+)", 2), F.lit("."), F.regexp_extract(m, r"(over|under)_(\d+)_(\d+)", 3))
    short = F.regexp_extract(m, r"_([ou])(\d+(?:\.\d+)?)$", 1)
    digits = F.regexp_extract(m, r"_([ou])(\d+(?:\.\d+)?)$", 2)
    direction = F.when(spelled != "", spelled).when(short == "o", "over").when(short == "u", "under")
    line = (
        F.when(spelled != "", spelled_line.try_cast("double"))
        .when(digits == "11", F.lit(11.5))
        .when(digits.contains("."), digits.try_cast("double"))
        .when(digits != "", digits.try_cast("double") / 10)
    )
    return F.struct(kind.alias("kind"), side.alias("side"), direction.alias("direction"), line.alias("line"))


