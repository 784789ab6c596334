"""Join, set and keyed-write operators."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import join_name, similarity
from .names import best_team, weighted_candidates
from .ordered import Feature, Rolling, as_of, first_per_key, point_in_time


def join_labels(preds: DataFrame, labels: DataFrame, on: str | list[str]) -> DataFrame:
    """Inner equi-join."""
    return preds.join(labels, on, "inner")


def join_many_to_one(left: DataFrame, right: DataFrame, on: list[str], order: list[Column], how: str = "inner") -> DataFrame:
    """Join against one row per key of the right side, the first by ``order``."""
    return left.join(first_per_key(right, on, order), on, how)


def duplicate_keys(df: DataFrame, on: list[str]) -> DataFrame:
    return df.groupBy(*on).agg(F.count(F.lit(1)).alias("copies")).filter(F.col("copies") > 1)


def enrich_left(df: DataFrame, extra: DataFrame, on: list[str], columns: list[str], order: list[Column]) -> DataFrame:
    """Left join of the available columns, last copy per key wins."""
    present = [c for c in columns if c in extra.columns]
    last = first_per_key(extra, on, order, descending=True)
    return df.join(last.select(*on, *present), on, "left")


def enrich_missing(df: DataFrame, stats: DataFrame) -> DataFrame:
    """Fill corners and cards of rows without total corners, by day and folded names.

    Cards default to 0, corners stay null. ``stats``: day, home, away, home_corners, away_corners, home_cards, away_cards.
    """

    def keyed(frame: DataFrame, day: Column, home: str, away: str) -> DataFrame:
        return frame.withColumns({"_day": day, "_home": join_name(home), "_away": join_name(away)})

    left = keyed(df, F.date_format("match_date", "yyyy-MM-dd"), "home_team", "away_team")
    right = keyed(stats, F.col("day"), "home", "away").filter(
        F.col("home_corners").isNotNull() | F.col("away_corners").isNotNull()
    )
    keys = ["_day", "_home", "_away"]
    values = ["home_corners", "away_corners", "home_cards", "away_cards"]
    right = right.groupBy(*keys).agg(F.max(F.struct(*values)).alias("_new"))
    out = left.join(right, keys, "left")
    fill = F.col("total_corners").isNull() & F.col("_new").isNotNull()
    new = {}
    for c in values:
        value = F.col(f"_new.{c}")
        new[c] = F.when(fill, value if "corners" in c else F.coalesce(value, F.lit(0))).otherwise(F.col(c))
    total = F.col("_new.home_corners") + F.col("_new.away_corners")
    new["total_corners"] = F.when(fill, total).otherwise(F.col("total_corners"))
    new["enriched"] = fill
    return out.withColumns(new).drop(*keys, "_new")


def in_universe(results: DataFrame, preds: DataFrame, key: str, time: str) -> DataFrame:
    """Results that were predicted, with the first prediction date."""
    return results.join(preds.groupBy(key).agg(F.min(time).alias("first_prediction")), key)


def temporal_violations(results: DataFrame, preds: DataFrame, key: str, result_time: str, pred_time: str) -> DataFrame:
    """Results dated before the first prediction of the match (J8): one combinable minimum, then a filter."""
    return in_universe(results, preds, key, pred_time).filter(F.col(result_time) < F.col("first_prediction"))


def unseen(new: DataFrame, seen: DataFrame, key: str | list[str]) -> DataFrame:
    """Rows whose key is not there yet."""
    keys = [key] if isinstance(key, str) else key
    return new.join(seen.select(*keys), keys, "left_anti")


def join_with_fallback(preds: DataFrame, results: DataFrame, key: str, natural: list[str], values: list[str], global_fallback: bool = False) -> DataFrame:
    """By id, else by (day, home, away) lower-cased.

    Of several results with one id, or one natural key, the smallest counts. The fallback is taken row by row; ``global_fallback`` keeps the original rule: only if no id matches at all.
    """
    by_id = results.groupBy(key).agg(F.min(F.struct(*values)).alias("_i"))
    by_id = by_id.select(key, *[F.col(f"_i.{v}").alias(f"_i_{v}") for v in values], F.lit(True).alias("_by_id"))
    fold = lambda df: df.withColumns({f"_n_{c}": F.lower(F.trim(F.col(c).cast("string"))) for c in natural})
    folded = [f"_n_{c}" for c in natural]
    one = fold(results).groupBy(*folded).agg(F.min(F.struct(key, *values)).alias("_n"))
    out = fold(preds).join(by_id, key, "left").join(one, folded, "left")
    use_id = F.col("_by_id").isNotNull()
    if global_fallback:
        hits = preds.join(results.select(key), key, "left_semi").agg((F.count(F.lit(1)) > 0).alias("any")).scalar()
        use_id = use_id | hits
    picked = {v: F.when(use_id, F.col(f"_i_{v}")).otherwise(F.col(f"_n.{v}")) for v in values}
    via = F.when(F.col("_by_id").isNotNull(), "id").when(~use_id & F.col("_n").isNotNull(), "teams")
    return out.withColumns({**picked, "matched_by": via}).filter(F.col("matched_by").isNotNull()).select(*preds.columns, *values, "matched_by")


def last_n_before(
    probes: DataFrame, history: DataFrame, keys: list[str], time: str, tie: str, value: str, n: int, min_rows: int, default: float, name: str, **kw
) -> DataFrame:
    """Mean of the last ``n`` history values strictly before each probe, a default below ``min_rows``.

    History rows carry their own trailing mean; the probe takes it from the last one before it.
    """
    trailing = Feature(
        rolling={
            "tail_mean": Rolling(n, F.avg(value), include_current=True),
            "tail_n": Rolling(n, F.count(F.lit(1)), include_current=True),
        }
    )
    marked = point_in_time(history.select(*keys, time, tie, value), keys, [time, tie], [trailing], **kw)
    out = as_of(probes, marked, keys, time, ["tail_mean", "tail_n"], right_tie=[tie], strict=True, **kw)
    mean = F.when(F.coalesce("tail_n", F.lit(0)) >= min_rows, F.col("tail_mean")).otherwise(F.lit(default))
    return out.withColumn(name, mean).drop("tail_mean", "tail_n")


def attach_odds(fixtures: DataFrame, odds: DataFrame, defaults: dict[str, float], home: str = "home_team", away: str = "away_team") -> DataFrame:
    """Odds map of a fixture: exact key, else the first key that contains the home side, else defaults (IO6).

    ``odds``: fixture string ``HOME vs AWAY``, markets map. The containment lookup is an equi-join: the pieces
    of each odds key as long as a home name are its candidates.
    """
    keyed = fixtures.withColumn("_key", F.concat(F.col(home), F.lit(" vs "), F.col(away)))
    exact = odds.select(F.col("fixture").alias("_key"), F.col("markets").alias("_exact"))
    names = fixtures.select(F.col(home).alias("_home")).distinct()
    lengths = names.select(F.length("_home").alias("_len")).distinct()
    sized = odds.withColumn("_len", F.explode(F.sequence(F.lit(1), F.length("fixture")))).join(lengths, "_len")
    start = F.explode(F.sequence(F.lit(1), F.length("fixture") - F.col("_len") + 1)).alias("_at")
    pieces = sized.select("fixture", "markets", "_len", start).select(
        "fixture", "markets", F.expr("substring(fixture, _at, _len)").alias("_home")
    )
    partial = (
        pieces.join(names, "_home")
        .groupBy("_home")
        .agg(F.min_by("markets", "fixture").alias("_partial"), F.min("fixture").alias("_partial_key"))
    )
    fallback = F.create_map(*[F.lit(v) for kv in defaults.items() for v in kv])
    out = keyed.join(exact, "_key", "left").join(partial.withColumnRenamed("_home", home), home, "left")
    source = F.when(F.col("_exact").isNotNull(), "exact").when(F.col("_partial").isNotNull(), "home").otherwise("default")
    out = out.withColumns({"markets": F.coalesce("_exact", "_partial", fallback), "odds_source": source})
    return out.select(*fixtures.columns, "markets", "odds_source")


def append_new(existing: DataFrame, incoming: DataFrame, key: list[str], order: list[Column]) -> DataFrame:
    """Rows to append: unseen keys, one copy each (IO9)."""
    return unseen(first_per_key(incoming, key, order), existing, key)


def upsert(existing: DataFrame, incoming: DataFrame, key: list[str], order: list[Column]) -> DataFrame:
    """Keyed merge, incoming wins, newest of its copies first; ``change`` tells what happened to the row (IO10)."""
    newest = first_per_key(incoming, key, order)
    columns = existing.columns
    old = existing.select(*key, F.struct(*[c for c in columns if c not in key]).alias("_old"))
    new = newest.select(*key, F.struct(*[c for c in columns if c not in key]).alias("_new"))
    out = old.join(new, key, "full_outer")
    change = F.when(F.col("_old").isNull(), "inserted").when(F.col("_new").isNull(), "kept").otherwise("updated")
    row = F.coalesce("_new", "_old")
    rest = [row[c].alias(c) for c in columns if c not in key]
    return out.select(*key, *rest, change.alias("change"))


# ---- sets -----------------------------------------------------------------------------------------------


def union_all(frames: list[DataFrame]) -> DataFrame:
    """Union by name, absent columns null."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)


def common_keys(a: DataFrame, b: DataFrame, key: list[str]) -> DataFrame:
    """Keys on both sides."""
    return a.select(*key).intersect(b.select(*key))


def key_diff(before: DataFrame, after: DataFrame, key: list[str]) -> DataFrame:
    """Keys lost and gained (S3)."""
    x, y = before.select(*key), after.select(*key)
    return x.subtract(y).withColumn("side", F.lit("lost")).unionByName(y.subtract(x).withColumn("side", F.lit("gained")))


def team_counts(df: DataFrame) -> DataFrame:
    """Matches per side over both columns."""
    both = df.select("league", F.explode(F.array("home_team", "away_team")).alias("team"))
    return both.groupBy("league", "team").agg(F.count(F.lit(1)).alias("matches"))


def supersede(primary: DataFrame, fallback: DataFrame, keys: list[str]) -> DataFrame:
    """A (league, season) comes from the primary source or, if absent there, from the fallback."""
    return primary.unionByName(fallback.join(primary.select(*keys).distinct(), keys, "left_anti"))


def overlap(a: DataFrame, b: DataFrame, key: list[str]) -> DataFrame:
    """Distinct ids on each side and on both, one shuffle."""
    sides = a.select(*key, F.lit(1).alias("_s")).unionByName(b.select(*key, F.lit(2).alias("_s")))
    per = sides.groupBy(*key).agg(F.bit_or("_s").alias("_in"))
    return per.agg(
        F.count_if(F.col("_in").bitwiseAND(1) == 1).alias("in_a"),
        F.count_if(F.col("_in").bitwiseAND(2) == 2).alias("in_b"),
        F.count_if(F.col("_in") == 3).alias("in_both"),
    )


# ---- entity resolution ----------------------------------------------------------------------------------

CUTOFF = 85.0


def fuzzy_candidates(names: DataFrame, canonical: DataFrame, scope: list[str], cutoff: float = CUTOFF) -> DataFrame:
    """Pairs with similarity >= cutoff, without comparing every pair.

    An edit distance of at most k leaves one of k + 1 pieces of the canonical name intact, at most k places
    off. Pieces and substrings of the same length meet in an equi-join; the distance is checked after.
    """
    slack = 1 - cutoff / 100
    pieces = (
        canonical.select(*scope, "team").distinct()
        .withColumn("_len", F.length("team"))
        .withColumn("_k", F.floor(F.col("_len") * (slack / (1 - slack)) + 1e-9).cast("int"))
        .withColumn("_i", F.explode(F.sequence(F.lit(0), F.col("_k"))))
        .withColumn("_from", F.floor(F.col("_i") * F.col("_len") / (F.col("_k") + 1)).cast("int"))
        .withColumn("_to", F.floor((F.col("_i") + 1) * F.col("_len") / (F.col("_k") + 1)).cast("int"))
        .withColumn("_piece", F.expr("substring(team, _from + 1, _to - _from)"))
    )
    sizes = pieces.select(F.length("_piece").alias("_size")).distinct()
    grams = (
        names.select(*scope, "name").distinct()
        .withColumn("_size", F.explode(F.sequence(F.lit(1), F.length("name"))))
        .join(sizes, "_size")
        .withColumn("_at", F.explode(F.sequence(F.lit(0), F.length("name") - F.col("_size"))))
        .withColumn("_piece", F.expr("substring(name, _at + 1, _size)"))
    )
    near = (F.abs(F.col("_at") - F.col("_from")) <= F.col("_k")) & (F.abs(F.length("name") - F.col("_len")) <= F.col("_k"))
    pairs = grams.join(pieces, [*scope, "_piece"]).filter(near).select(*scope, "name", "team").distinct()
    score = similarity("name", "team")
    return pairs.withColumn("score", score).filter(F.col("score") >= cutoff - 1e-9)


def resolve_names(names: DataFrame, membership: DataFrame, aliases: DataFrame, weighted: bool = False) -> DataFrame:
    """Canonical name of each distinct (league, season, name).

    Stages: this season's list, its aliases, other seasons, fuzzy in the league's list, the same over all
    leagues, else the name itself. ``membership``: league, season, team. ``aliases``: league, alias, team and, if
    they hold for one season only, season (null: any); aliases of other seasons come after other seasons' lists.
    The similarity is edit distance over the longer length; ties go to the smallest name. With ``weighted`` names
    that no edit reaches are scored by weighted words (``names.weighted_candidates``) in the league's list of the
    season, and at the very end over all leagues.
    """
    keys = ["league", "season", "name"]
    asked = names.select("league", "season", F.upper(F.trim("name")).alias("name")).distinct()
    members = membership.select("league", "season", F.upper("team").alias("team")).distinct()
    bound = F.col("season") if "season" in aliases.columns else F.lit(None).cast("string")
    dated = aliases.select("league", bound.alias("season"), F.upper("alias").alias("name"), F.upper("team").alias("team"))
    alias = dated.drop("season")

    def stage(frame: DataFrame, on: list[str], label: str) -> DataFrame:
        return frame.groupBy(*on).agg(F.min("team").alias(label))

    exact = members.withColumn("name", F.col("team"))
    in_season = stage(exact, ["league", "season", "name"], "s1")
    by_alias = stage(dated.filter("season IS NULL").drop("season"), ["league", "name"], "s2")
    of_season = stage(dated.filter("season IS NOT NULL"), keys, "s2a")
    of_other = stage(dated.filter("season IS NOT NULL"), ["league", "name"], "s3a")
    other = stage(exact, ["league", "name"], "s3")
    anywhere = stage(exact.unionByName(alias.withColumn("season", F.lit(None).cast("string"))), ["name"], "s5")
    out = (
        asked.join(in_season, keys, "left").join(by_alias, ["league", "name"], "left").join(other, ["league", "name"], "left")
    )
    if "season" in aliases.columns:
        out = out.join(of_season, keys, "left").join(of_other, ["league", "name"], "left")
        out = out.withColumns({"s2": F.coalesce("s2a", "s2"), "s3": F.coalesce("s3", "s3a")})
    open_names = out.filter(F.coalesce("s1", "s2", "s3").isNull()).select("league", "season", "name")
    local = fuzzy_candidates(open_names, members, ["league", "season"])
    top = local.groupBy(*keys).agg(F.max("score").alias("score"))
    local = local.join(top, [*keys, "score"]).groupBy(*keys).agg(F.min("team").alias("s4"))
    wide = fuzzy_candidates(open_names, members, [])
    top = wide.groupBy("name").agg(F.max("score").alias("score"))
    wide = wide.join(top, ["name", "score"]).groupBy("name").agg(F.min("team").alias("s6"))
    out = out.join(local, keys, "left").join(anywhere, "name", "left").join(wide, "name", "left")
    out = out.withColumns({"s4w": F.lit(None).cast("string"), "s7": F.lit(None).cast("string")})
    if weighted:
        by_words = weighted_candidates(open_names, members, ["league", "season"])
        by_all_words = weighted_candidates(open_names, members, [])
        out = out.drop("s4w", "s7").join(best_team(by_words, keys, "s4w"), keys, "left").join(best_team(by_all_words, ["name"], "s7"), "name", "left")
        nothing = F.coalesce("s1", "s2", "s3", "s4", "s4w", "s5", "s6").isNull()
        out = out.withColumn("s7", F.when(nothing, F.col("s7")))
    via = (
        F.when(F.col("s1").isNotNull(), "season")
        .when(F.col("s2").isNotNull(), "alias")
        .when(F.col("s3").isNotNull(), "other season")
        .when(F.col("s4").isNotNull(), "fuzzy")
        .when(F.col("s4w").isNotNull(), "words")
        .when(F.col("s5").isNotNull(), "other league")
        .when(F.col("s6").isNotNull(), "fuzzy other league")
        .when(F.col("s7").isNotNull(), "words other league")
        .otherwise("unresolved")
    )
    return out.select(*keys, F.coalesce("s1", "s2", "s3", "s4", "s4w", "s5", "s6", "s7", "name").alias("team"), via.alias("via"))
