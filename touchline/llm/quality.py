"""Quality rules as weak supervision.

Each rule votes that a document is good or bad, or abstains. Expectation-maximisation over the counts of vote patterns
estimates, for good and for bad documents, how often each rule votes how; a document's posterior probability of being
good replaces the verdict "all rules must pass". A rule that often fires on documents the others like loses its say.

Everything on the rows is DataFrame functions. Texts are read once into a narrow checkpointed table of counts. There are
at most 3^rules vote patterns, whatever the number of documents; only their counts go to the driver.
"""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import cut_lineage
from .common import WORD_JAVA, let, table, words

# The base rule.
FEWEST_WORDS, MOST_REPEATED_PERCENT = 50, 50

#: Kept from this posterior on.
KEEP_FROM = 0.5
ROUNDS = 200
#: Rules that hardly ever vote bad on a good document, and how often they may.
PRECISE = ("repeats", "symbols", "shouting", "capitals", "twin_lines")
MOST_FALSE_ALARMS = 0.002


Row = Callable[[str], Column]


def _vote(value: Column, good: Column, bad: Column) -> Column:
    return F.when(value.isNull(), None).when(bad, 0).when(good, 1).cast("int")


def rules(n: Row = F.col) -> dict[str, Column]:
    """Votes on the fields of ``counted``: 1 good, 0 bad, null no opinion."""
    share = lambda part, whole: F.when(n(whole) > 0, n(part) / n(whole))
    repeated, symbols = share("n_repeat_words", "n_words"), share("n_symbols", "n_words")
    shouts, capitals = share("n_shouts", "n_words"), share("n_capitals", "word_chars")
    size, twice, ends = share("word_chars", "n_words"), share("n_dup_lines", "n_lines"), share("n_ends", "n_words")
    return {
        "repeats": _vote(repeated, repeated < 0.05, repeated > 0.4),
        "symbols": _vote(symbols, symbols < 0.01, symbols > 0.1),
        "shouting": _vote(shouts, shouts < 0.02, shouts > 0.2),
        "capitals": _vote(capitals, capitals < 0.1, capitals > 0.3),
        "word_size": _vote(size, size.between(3, 10), ~size.between(2, 14)),
        "twin_lines": _vote(twice, twice < 0.05, (twice > 0.3) & (n("n_dup_lines") >= 3)),
        "sentences": _vote(ends, ends.between(0.02, 0.4), ends < 0.004),
        "length": _vote(n("n_words"), n("n_words") >= 100, n("n_words") < FEWEST_WORDS),
    }


def _repeated_words(windows: Column) -> Column:
    """Words covered by three-word windows that occur more than once; ``windows`` holds a hash per start."""

    def positions(order: Column) -> Column:
        same = lambda s, i: (F.get(order, i)["h"] == s["h"])
        twice = F.filter(order, lambda s, i: F.coalesce(same(s, i - 1), F.lit(False)) | F.coalesce(same(s, i + 1), F.lit(False)))
        return F.array_sort(F.transform(twice, lambda s: s["i"]))

    def covered(at: Column) -> Column:
        steps = F.transform(at, lambda p, i: F.least(F.lit(3), F.coalesce(F.get(at, i + 1) - p, F.lit(3))))
        return F.aggregate(steps, F.lit(0), lambda a, b: a + b)

    order = F.array_sort(F.transform(windows, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    return F.when(F.size(F.array_distinct(windows)) < F.size(windows), let(let(order, positions), covered)).otherwise(F.lit(0))


def counted(text: Column) -> Column:
    """Struct of counts over the whole text; a null text has no words. Parts are bound, so each is worked out once."""

    def of(t: Column, w: Column, lines: Column) -> Column:
        # The last two words begin no window.
        windows = F.slice(F.transform(w, lambda x, i: F.xxhash64(x, F.get(w, i + 1), F.get(w, i + 2))), 1, F.greatest(F.lit(0), F.size(w) - 2))
        without = lambda pattern: F.length(t) - F.length(F.regexp_replace(t, pattern, ""))
        n = {
            "n_words": F.size(w),
            "word_chars": F.length(F.array_join(w, "")),
            "n_symbols": without(r"[#*$%&|<>]+"),
            "n_dup_lines": F.size(lines) - F.size(F.array_distinct(lines)),
            "n_repeat_words": let(windows, _repeated_words),
            "n_lines": F.size(lines),
            "n_shouts": F.length(t) - F.length(F.replace(t, F.lit("!"), F.lit(""))),
            "n_capitals": without(r"[A-Z]+"),
            "n_ends": without(r"[.!?]+"),
        }
        return F.struct(*[c.cast("long").alias(k) for k, c in n.items()])

    lines = lambda t: F.filter(F.split(t, "\n", -1), lambda x: x.rlike(WORD_JAVA))
    return let(F.coalesce(text, F.lit("")), lambda t: let(words(t), lambda w: let(lines(t), lambda s: of(t, w, s))))


def counts(docs: DataFrame, *, keep: list[str], text: str = "text") -> DataFrame:
    """``keep`` columns and the fields of ``counted``."""
    return docs.select(*keep, counted(F.col(text)).alias("_n")).select(*keep, "_n.*")


def base_failed(n: Row = F.col) -> Column:
    return (n("n_words") < FEWEST_WORDS) | (100 * n("n_repeat_words") > MOST_REPEATED_PERCENT * n("n_words"))


class Model:
    """Share of good documents, and per rule and class the chance of each vote."""

    def __init__(self, names: list[str], good: float, bad_vote: dict[str, tuple[float, float]]):
        self.names, self.good, self.bad_vote = names, good, bad_vote  # bad_vote: (in good documents, in bad ones)

    def log_odds(self, votes) -> float:
        total = math.log(self.good / (1 - self.good))
        for name, vote in zip(self.names, votes):
            if vote is not None:
                g, b = self.bad_vote[name]
                total += math.log((1 - g) / (1 - b)) if vote else math.log(g / b)
        return total

    def posterior(self, votes: dict[str, Column]) -> Column:
        total = F.lit(math.log(self.good / (1 - self.good)))
        for name in self.names:
            g, b = self.bad_vote[name]
            weight = F.when(votes[name] == 1, math.log((1 - g) / (1 - b))).when(votes[name] == 0, math.log(g / b))
            total = total + F.coalesce(weight, F.lit(0.0))
        return 1 / (1 + F.exp(-total))


def fit(patterns: list[tuple[tuple, int]], names: list[str], rounds: int = ROUNDS) -> Model:
    """EM over vote patterns with their counts.

    Beta priors say what rules are for, and decide on tables without bad documents: a tenth of documents is bad (as if 10
    of 100 were), a rule speaks up on some bad ones (as if 2 of 8). Bad documents are bad in different ways, so most
    rules have nothing against a given one; a rule in ``PRECISE`` is therefore held to few false alarms, and what is
    learnt is how much it misses. The others may turn out to be as often wrong as right, and then have no say.
    """
    most = {n: MOST_FALSE_ALARMS if n in PRECISE else 0.5 for n in names}
    model = Model(names, 0.9, {n: (min(most[n], 0.1), 0.25) for n in names})
    for _ in range(rounds):
        good, weights = 90.0, 100.0
        hits = {n: [most[n], 10.0, 2.0, 8.0] for n in names}
        for votes, count in patterns:
            p = 1 / (1 + math.exp(-max(-700.0, min(700.0, model.log_odds(votes)))))
            good, weights = good + p * count, weights + count
            for n, v in zip(names, votes):
                if v is not None:
                    h = hits[n]
                    h[1] += p * count
                    h[3] += (1 - p) * count
                    if v == 0:
                        h[0] += p * count
                        h[2] += (1 - p) * count
        rates = {n: (min(h[0] / h[1], most[n]), h[2] / h[3]) for n, h in hits.items()}
        # A rule never speaks for the other side.
        fresh = Model(names, good / weights, {n: (g, min(max(b, g), 0.99)) for n, (g, b) in rates.items()})
        moved = max([abs(fresh.good - model.good), *(abs(x - y) for n in names for x, y in zip(fresh.bad_vote[n], model.bad_vote[n]))])
        model = fresh
        if moved < 1e-9:
            break
    return model


def learn(rows: DataFrame) -> Model:
    """Model for a table with the columns of ``counts``; an empty table gives the priors."""
    votes = rules()
    names = list(votes)
    patterns = rows.groupBy(*[v.alias(n) for n, v in votes.items()]).count().collect()  # at most 3^rules rows
    return fit([(tuple(r[:-1]), r[-1]) for r in sorted(patterns, key=str)], names)


def kept(model: Model, n: Row = F.col, keep_from: float = KEEP_FROM) -> Column:
    return ~base_failed(n) & (model.posterior(rules(n)) >= keep_from)


def keep_good(docs: DataFrame, *, text: str = "text") -> DataFrame:
    """The documents kept, with their columns. Texts are read twice, to learn and to judge; nothing is shuffled."""
    model = learn(counts(docs, keep=[], text=text))
    return docs.filter(let(counted(F.col(text)), lambda n: kept(model, lambda field: n[field])))


def op3_weak_supervision(spark, sf_dir: str) -> DataFrame:
    rows = cut_lineage(counts(table(spark, sf_dir, "documents"), keep=["doc_id"]))
    model = learn(rows)
    shown = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
    return rows.select(
        "doc_id", *shown, base_failed().alias("base_failed"), kept(model).alias("kept"), model.posterior(rules()).alias("p_good")
    )
