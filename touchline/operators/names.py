"""Word-weighted name scores: word order, abbreviations and common words do not keep a name from its team."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

# A shortened word counts nine tenths of the whole one; shorter beginnings than three letters count nothing.
SHORTENED = 0.9
LEAST_LETTERS = 3
CUTOFF = 85.0


def words(name: Column | str) -> Column:
    """Distinct upper-case words: letters and digits of any script, cut at all else."""
    parts = F.split(F.upper(F.col(name) if isinstance(name, str) else name), r"[^\p{L}\p{N}]+")
    return F.array_distinct(F.filter(parts, lambda w: w != ""))


def _likeness(a: Column, b: Column) -> Column:
    begins = (F.least(F.length(a), F.length(b)) >= LEAST_LETTERS) & (a.startswith(b) | b.startswith(a))
    return F.when(a == b, 1.0).when(begins, SHORTENED).otherwise(0.0)


def _best(word: Column, others: str) -> Column:
    return F.coalesce(F.array_max(F.transform(others, lambda o: _likeness(word, o["word"]))), F.lit(0.0))


def _sum(column: Column) -> Column:
    return F.aggregate(column, F.lit(0.0), lambda a, x: a + x)


def weighted_score(asked: str, team: str) -> Column:
    """Share of the weight of a team's words that the asked words meet, 0 to 100.

    Both columns are arrays of (word, weight). Asked words that meet nothing add their weight to the whole.
    """
    met = _sum(F.transform(team, lambda t: t["weight"] * _best(t["word"], asked)))
    whole = _sum(F.transform(team, lambda t: t["weight"]))
    strange = _sum(F.transform(asked, lambda q: F.when(_best(q["word"], team) == 0, q["weight"]).otherwise(0.0)))
    return F.round(100 * met / (whole + strange), 9)


def weighted_candidates(names: DataFrame, canonical: DataFrame, scope: list[str], cutoff: float = CUTOFF) -> DataFrame:
    """(scope, name, team, score) of all pairs that score at least ``cutoff``, without comparing every pair.

    ``names``: scope and name; ``canonical``: scope and team. A word weighs ln(1 + teams / teams that have it), both
    within the scope; a word that no team has weighs as one that a single team has. A pair at the cutoff leaves at
    most 1 - cutoff of the team's weight unmet, so it meets one of the team's heaviest words that together weigh more
    than that (the rarest word, for most teams). Only those are indexed, by their beginnings, and met in two
    equi-joins: asked word with beginnings, beginnings of the asked word with whole words. Common words join nothing.
    Nulls and names without words have no candidates.
    """
    if not 0 < cutoff <= 100:
        raise ValueError("the cutoff lies above 0 and at most at 100")
    teams = canonical.select(*scope, "team").dropna().distinct().withColumn("_word", F.explode(words("team")))
    size = teams.select(*scope, "team").distinct().groupBy(*scope).agg(F.count(F.lit(1)).alias("_teams"))
    shared = teams.groupBy(*scope, "_word").agg(F.count(F.lit(1)).alias("_having"))
    weight = F.log1p(F.col("_teams") / F.coalesce("_having", F.lit(1)))

    def weighed(rows: DataFrame, how: str) -> DataFrame:
        sized = rows.join(size, scope) if scope else rows.withColumn("_teams", size.scalar())
        return sized.join(shared, [*scope, "_word"], how).withColumn("_weight", weight).drop("_teams", "_having")

    def gathered(rows: DataFrame, name: str, to: str) -> DataFrame:
        entry = F.struct(F.col("_word").alias("word"), F.col("_weight").alias("weight"))
        return rows.groupBy(*scope, name).agg(F.array_sort(F.collect_list(entry)).alias(to))

    team_words = weighed(teams, "inner")
    asked = names.select(*scope, "name").dropna().distinct().withColumn("_word", F.explode(words("name")))
    asked_words = weighed(asked, "left")

    # The words of one team, heaviest first: a handful of rows per key.
    heavier = Window.partitionBy(*scope, "team").orderBy(F.col("_weight").desc(), "_word")
    before = F.coalesce(F.sum("_weight").over(heavier.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    whole = F.sum("_weight").over(Window.partitionBy(*scope, "team"))
    # A hair more is indexed than rounding needs.
    index = team_words.withColumns({"_before": before, "_whole": whole}).filter(F.col("_before") <= F.col("_whole") * (1 - cutoff / 100) + 1e-6)
    index = index.select(*scope, "team", F.col("_word").alias("_key"))

    def beginnings(word: str, least: Column) -> Column:
        """All beginnings of a word from ``least`` letters up to the whole word."""
        return F.transform(F.sequence(F.least(least, F.length(word)), F.length(word)), lambda n: F.substring(word, F.lit(1), n))

    short = F.lit(LEAST_LETTERS)
    keyed = index.withColumn("_word", F.explode(beginnings("_key", short)))
    probes = asked.withColumn("_key", F.explode(beginnings("_word", short)))
    met = asked.join(keyed, [*scope, "_word"]).select(*scope, "name", "team")
    met = met.union(probes.drop("_word").join(index, [*scope, "_key"]).select(*scope, "name", "team")).distinct()
    pairs = met.join(gathered(asked_words, "name", "_asked"), [*scope, "name"]).join(gathered(team_words, "team", "_team"), [*scope, "team"])
    scored = pairs.withColumn("score", weighted_score("_asked", "_team"))
    return scored.filter(F.col("score") >= cutoff).select(*scope, "name", "team", "score")


def best_team(candidates: DataFrame, keys: list[str], label: str) -> DataFrame:
    """The highest score per key, ties to the smallest team, by a combinable minimum."""
    return candidates.groupBy(*keys).agg(F.min_by("team", F.struct(-F.col("score"), "team")).alias(label))
