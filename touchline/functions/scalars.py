"""Column functions: keys, seasons, names, dates, probabilities, JSON and text parsing."""

from __future__ import annotations

import unicodedata

from pyspark.sql import Column
from pyspark.sql import functions as F

# ---- keys -----------------------------------------------------------------------------------------------


def fingerprint(league, season, date, home, away) -> Column:
    """sha256 prefix of the natural key joined by a pipe."""
    day = F.date_format(date, "yyyy-MM-dd")
    return F.substring(F.sha2(F.concat_ws("|", league, season, day, home, away), 256), 1, 16)


def short_fingerprint(league, date, home, away) -> Column:
    """md5 prefix of league, day and both sides, the form of regenerated keys."""
    return F.substring(F.md5(F.concat(league, F.date_format(date, "yyyyMMdd"), home, away)), 1, 16)


def valid_key(key) -> Column:
    return F.coalesce(F.col(key).rlike("^[a-fA-F0-9]{16}$"), F.lit(False))


def row_hash(*columns: str) -> Column:
    """md5 of the sorted-key JSON of a row, nulls kept, for replay audits."""
    return F.md5(F.to_json(F.struct(*sorted(columns)), {"ignoreNullFields": "false"}))


# ---- seasons and dates ----------------------------------------------------------------------------------


def season_start(date, cutoff_month: int = 7) -> Column:
    """Start year of the season a date falls in; sources differ in the cutoff month."""
    return F.year(date) - F.when(F.month(date) >= cutoff_month, 0).otherwise(1)


def season_label(date, cutoff_month: int = 7) -> Column:
    start = season_start(date, cutoff_month)
    return F.concat(start.cast("string"), F.lit("-"), F.lpad(((start + 1) % 100).cast("string"), 2, "0"))


def season_from_file(stem, date, cutoff_month: int = 7) -> Column:
    """Season from a file stem such as ``E0_2425`` or ``2019_2020``, else from the date."""
    stem = F.col(stem) if isinstance(stem, str) else stem
    short = r"(\d{2})(\d{2})(?:_|$)"
    first = F.regexp_extract(stem, short, 1).try_cast("int") + 2000
    second = F.regexp_extract(stem, short, 2).try_cast("int") + 2000
    full = r"(\d{4})[_\-]\d{2}(\d{2})"
    return (
        F.when(
            first.between(2010, 2030) & (second == first + 1),
            F.concat(first.cast("string"), F.lit("-"), F.regexp_extract(stem, short, 2)),
        )
        .when(stem.rlike(full), F.concat(F.regexp_extract(stem, full, 1), F.lit("-"), F.regexp_extract(stem, full, 2)))
        .otherwise(season_label(date, cutoff_month))
    )


def season_year(text) -> Column:
    """2024 from ``2024/25``, ``2024-25`` or ``2024``."""
    return F.split(text, "[/-]").getItem(0).try_cast("int")


def parse_day_first(text) -> Column:
    """Day-first date, else ISO; null where nothing fits."""
    return F.coalesce(
        F.try_to_timestamp(text, F.lit("dd/MM/yyyy")),
        F.try_to_timestamp(text, F.lit("dd/MM/yy")),
        F.try_to_timestamp(text, F.lit("yyyy-MM-dd")),
        F.try_to_timestamp(text, F.lit("yyyy-MM-dd HH:mm:ss")),
    )


def day_difference(later, earlier) -> Column:
    return F.floor((F.unix_micros(later) - F.unix_micros(earlier)) / 86_400_000_000)


# ---- numbers --------------------------------------------------------------------------------------------


def clamp(value: Column, low: float, high: float) -> Column:
    return F.greatest(F.least(value, F.lit(high)), F.lit(low))


def dampen(p: Column, alpha: float = 0.80, towards: float = 0.5) -> Column:
    """Shrink a probability towards its even share."""
    return F.lit(towards) + F.lit(alpha) * (p - F.lit(towards))


def logit(p: Column, eps: float = 0.01) -> Column:
    q = clamp(p, eps, 1 - eps)
    return F.log(q / (1 - q))


def poisson_pmf(rate: Column, size: int) -> Column:
    """Array of P(0..size) by the recurrence p(k) = p(k-1) * rate / k."""
    start = F.exp(-rate)
    return F.aggregate(
        F.sequence(F.lit(1), F.lit(size)),
        F.array(start),
        lambda acc, k: F.concat(acc, F.array(F.element_at(acc, -1) * rate / k)),
    )


def negative_binomial_pmf(n: Column, p: Column, size: int) -> Column:
    """Array of P(0..size) by the recurrence p(k) = p(k-1) * (k-1+n)/k * (1-p)."""
    return F.aggregate(
        F.sequence(F.lit(1), F.lit(size)),
        F.array(F.pow(p, n)),
        lambda acc, k: F.concat(acc, F.array(F.element_at(acc, -1) * (k - 1 + n) / k * (1 - p))),
    )


def array_sum(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda a, x: a + x)


def sum_skip_null(*columns: str) -> Column:
    """Sum that is null only if every part is null (P5)."""
    total = sum((F.coalesce(F.col(c), F.lit(0)) for c in columns[1:]), F.coalesce(F.col(columns[0]), F.lit(0)))
    return F.when(F.coalesce(*[F.col(c) for c in columns]).isNotNull(), total)


def safe_ratio(top, bottom) -> Column:
    """Ratio that is null on a zero denominator."""
    top = F.col(top) if isinstance(top, str) else top
    bottom = F.col(bottom) if isinstance(bottom, str) else bottom
    return top / F.nullif(bottom, F.lit(0))


def first_number(*columns: str) -> Column:
    """First column that is a number, text converted."""
    return F.coalesce(*[F.col(c).cast("string").try_cast("double") for c in columns])


# ---- names ----------------------------------------------------------------------------------------------

# Club tokens dropped from join keys.
CLUB_TOKENS = "FC|AFC|CF|SC|SV|TSV|FSV|AC|AS|SS|US|CD|UD|RCD|RC|SD|CA|CE"


def _latin_folds() -> tuple[dict[str, str], dict[str, str]]:
    """Accented Latin letters whose compatibility decomposition is ASCII, by rule from the Unicode data."""
    single, longer = {}, {}
    for code in (*range(0x00A0, 0x0250), *range(0x1E00, 0x1F00)):
        plain = unicodedata.normalize("NFKD", chr(code)).encode("ascii", "ignore").decode("ascii")
        if plain:
            (single if len(plain) == 1 else longer)[chr(code)] = plain
    return single, longer


def join_name(name) -> Column:
    """Fold accents, upper-case, drop club tokens and squeeze spaces."""
    single, longer = _latin_folds()
    text = F.col(name) if isinstance(name, str) else name
    text = F.translate(F.coalesce(text, F.lit("")), "".join(single), "".join(single.values()))
    for char, plain in longer.items():
        text = F.replace(text, F.lit(char), F.lit(plain))
    text = F.upper(F.regexp_replace(text, r"[^\x00-\x7F]", ""))
    text = F.regexp_replace(F.trim(text), r"\s+", " ")
    text = F.regexp_replace(text, rf"\b(?:{CLUB_TOKENS})\b", " ")
    return F.trim(F.regexp_replace(text, r"\s+", " "))


def strip_control(text) -> Column:
    return F.trim(F.regexp_replace(text, r"[\x00-\x1F\x7F]", ""))


def similarity(a, b) -> Column:
    """100 * (1 - edit distance / longer length)."""
    return 100.0 * (1 - F.levenshtein(a, b) / F.greatest(F.length(a), F.length(b)))


# ---- states, alerts and JSON ----------------------------------------------------------------------------


# Status words and alert types in use.
STATUS_WORDS = {
    "GO": ["GO", "OK", "ACTIVE"],
    "WATCH": ["WATCH", "WARN", "CAUTION", "INSUFFICIENT_DATA"],
    "STOP": ["STOP", "FAIL", "CRITICAL", "FROZEN"],
}
ALERT_METRICS = {
    "calibration_drift": "ece",
    "hit_rate_drift": "hit_rate",
    "confidence_inflation": "mean_conf",
    "global_stop": "global_status",
    "global_watch": "global_status",
}


def drift_status(status) -> Column:
    """GO / WATCH / STOP from the wordings in use; unknown is STOP (X11)."""
    word = F.upper(status)
    return F.when(word.isin(STATUS_WORDS["GO"]), "GO").when(word.isin(STATUS_WORDS["WATCH"]), "WATCH").otherwise("STOP")


def alert_fields(text) -> Column:
    """Type, metric, value and threshold out of ``TYPE: 0.081 (Baseline 0.05)``; one bare number is the value."""
    text = F.col(text) if isinstance(text, str) else text
    kind = F.lower(F.trim(F.substring_index(text, ":", 1)))
    kind = F.when(kind == "", "unknown").otherwise(kind)
    rest = F.trim(F.regexp_replace(text, "^[^:]*:", ""))
    details = F.when(rest == "", F.trim(text)).otherwise(rest)
    pair = r"(?i)([-+]?\d*\.?\d+)\s*\(Baseline\s*([-+]?\d*\.?\d+)\)"
    value = F.regexp_extract(details, pair, 1).try_cast("double")
    only = F.regexp_extract(details, r"[-+]?\d*\.?\d+", 0).try_cast("double")
    names = F.create_map(*[F.lit(x) for kv in ALERT_METRICS.items() for x in kv])
    return F.struct(
        kind.alias("type"),
        F.coalesce(F.try_element_at(names, kind), F.lit("")).alias("metric"),
        F.coalesce(value, only).alias("value"),
        F.regexp_extract(details, pair, 2).try_cast("double").alias("threshold"),
        details.alias("details"),
    )


def statistic(stats: Column, kind: str) -> Column:
    """Value of one entry of a ``statistics`` array of (type, value), percent sign dropped."""
    hit = F.get(F.filter(stats, lambda s: s["type"] == kind), F.lit(0))
    return F.regexp_replace(hit["value"], "%", "").try_cast("double")


def top_scorelines(home_pmf: Column, away_pmf: Column, n: int) -> Column:
    """The ``n`` likeliest scores as an array of (p, h, a) structs."""
    size = F.size(home_pmf)
    cells = F.flatten(
        F.transform(
            F.sequence(F.lit(0), size - 1),
            lambda h: F.transform(
                F.sequence(F.lit(0), F.size(away_pmf) - 1),
                lambda a: F.struct(
                    (F.get(home_pmf, h) * F.get(away_pmf, a)).alias("p"), (-h).alias("mh"), (-a).alias("ma")
                ),
            ),
        )
    )
    best = F.slice(F.sort_array(cells, asc=False), 1, n)
    return F.transform(best, lambda c: F.struct(c["p"].alias("p"), (-c["mh"]).alias("h"), (-c["ma"]).alias("a")))


def outcome_of(home, draw, away) -> Column:
    """Likeliest of the three outcomes; a tie for the top is a draw."""
    home, draw, away = (F.col(c) if isinstance(c, str) else c for c in (home, draw, away))
    return F.when((home > draw) & (home > away), "H").when((away > draw) & (away > home), "A").otherwise("D")


def multiclass_brier(home, draw, away, actual) -> Column:
    """Sum of squared errors over the three outcomes, divided by three."""
    parts = [F.pow(F.col(c) - (F.col(actual) == code).cast("double"), F.lit(2)) for c, code in ((home, "H"), (draw, "D"), (away, "A"))]
    return (parts[0] + parts[1] + parts[2]) / 3
