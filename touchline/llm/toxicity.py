"""Severity of toxic language by cumulative-link ordinal regression.

Grades 0 to 3 share one weight per feature; ordered thresholds turn the score into P(grade <= k) = sigmoid(threshold_k -
score). Features are sparse: words of the text, and how words begin (an insult takes many endings), if the vocabulary
holds them, by 1 + log2 of how often they occur.

The labels only say toxic or not. A toxic text is graded by how many different telling words it holds (whole words met
almost only in toxic texts): one or none, two or three, more. How words begin does not count towards grades.

Fitting uses a bounded sample of labelled rows (``TRAIN_ROWS`` expected, drawn by a hash of the id); the vocabulary is
what that sample says about words in at least ``LEAST_TEXTS`` of its texts, however many have evidence: a share of toxic
texts ``EVIDENCE`` standard errors off the sample's. Scoring is a scan and a narrow map over whole texts.
"""

from __future__ import annotations

import re
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import cut_lineage
from .common import table, text_last

#: Labelled rows the model is fitted on, texts of them a word must occur in, standard errors its share must be off.
TRAIN_ROWS, LEAST_TEXTS, EVIDENCE = 20_000, 3, 2.0
#: Lengths of word beginnings that are features.
BEGINNINGS = (4, 5, 6)
GRADES = 4
#: A word is telling if at least this share of the texts that hold it are toxic.
TELLING = 0.8
#: Penalties on the weights; the first drives those of words without evidence to zero.
L1, L2, STEPS = 2e-3, 1e-4, 300
#: Thresholds are at least this far apart.
LEAST_GAP = 1e-3
TOXIC_FROM = 0.5

_LETTERS = re.compile(r"[^\W\d_]+")


def text_words(text: str | None) -> list[str]:
    return _LETTERS.findall((text or "").lower())


def text_features(words: list[str]) -> list[str]:
    """Words, and beginnings marked by a hyphen."""
    return words + [f"{w[:k]}-" for k in BEGINNINGS for w in words if len(w) > k]


def _bags(batches):
    for batch in batches:
        texts = [Counter(text_features(text_words(t.as_py()))) for t in batch.column("text")]
        words = pa.array([list(c) for c in texts], pa.list_(pa.string()))
        times = pa.array([list(c.values()) for c in texts], pa.list_(pa.int32()))
        yield pa.RecordBatch.from_arrays([batch.column("toxic"), words, times], names=["toxic", "words", "times"])


def sample(docs: DataFrame, labels: DataFrame, *, doc_id: str = "doc_id", text: str = "text", label: str = "toxic", rows: int = TRAIN_ROWS) -> DataFrame:
    """``toxic, words, times`` for about ``rows`` labelled texts, whatever the number of labels.

    Of labels that contradict each other for one id the toxic one holds.
    """
    known = labels.filter(F.col(label).isNotNull() & F.col(doc_id).isNotNull()).groupBy(F.col(doc_id).alias("_id")).agg(F.max(label).cast("int").alias("toxic"))
    n = known.count()
    drawn = known.filter(F.xxhash64("_id").cast("double") / 2.0**64 + 0.5 < rows / max(1, n))
    # The drawn ids are bounded by the sample size.
    met = docs.select(F.col(doc_id).alias("_id"), F.col(text).alias("text")).join(F.broadcast(drawn), "_id")
    return met.select("toxic", "text").mapInArrow(_bags, "toxic int, words array<string>, times array<int>")


class Ordinal:
    """Weights by feature and ordered thresholds."""

    def __init__(self, weights: dict[str, float], thresholds: np.ndarray):
        self.weights, self.thresholds = weights, thresholds
        self.begins = {k: {w[:-1] for w in weights if len(w) == k + 1 and w[-1] == "-"} for k in BEGINNINGS}

    def score(self, words: list[str]) -> float:
        met = list(filter(self.weights.__contains__, words))
        for k, begins in self.begins.items():
            if begins:
                met += [f"{b}-" for w in words if (b := w[:k]) in begins and len(w) > k]
        return sum(self.weights[w] * (1 + np.log2(n)) for w, n in Counter(met).items())

    def chances(self, scores: np.ndarray) -> np.ndarray:
        """Scores x grades."""
        upto = 1 / (1 + np.exp(-(self.thresholds[None, :] - scores[:, None])))
        return np.diff(np.concatenate((np.zeros((len(scores), 1)), upto, np.ones((len(scores), 1))), axis=1), axis=1)


def grades(toxic: np.ndarray, owner: np.ndarray, column: np.ndarray, telling: np.ndarray) -> np.ndarray:
    """Grade of each text: 0 if not toxic, else by its different telling words (rows of ``owner, column`` are distinct)."""
    held = np.bincount(owner, weights=telling[column], minlength=len(toxic))
    return np.where(toxic > 0, np.select([held <= 1, held <= 3], [1, 2], 3), 0)


def fit(toxic: np.ndarray, owner: np.ndarray, column: np.ndarray, value: np.ndarray, telling: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Weights and thresholds by proximal gradient with momentum on the mean log loss.

    Sparse input: text ``owner[i]`` has feature ``column[i]`` with ``value[i]``. ``telling`` flags the features that are telling words.
    """
    n, m = len(toxic), len(telling)
    if not m or not toxic.any():
        return np.zeros(m), np.array([5.0, 6.0, 7.0])
    y = grades(toxic, owner, column, telling)
    w, ahead, momentum = np.zeros(m), np.zeros(m), 1.0
    edges = np.array([2.0, 3.0, 4.0])
    low, high = y - 1, y
    step = 4.0 / max(1e-9, float(np.bincount(owner, weights=value * value, minlength=n).mean()))
    for _ in range(STEPS):
        t = np.concatenate(([-np.inf], edges, [np.inf]))
        score = np.bincount(owner, weights=value * ahead[column], minlength=n)
        upper, lower = (1 / (1 + np.exp(-np.clip(t[k + 1] - score, -60, 60))) for k in (high, low))
        upper, lower = np.where(high == GRADES - 1, 1.0, upper), np.where(low < 0, 0.0, lower)
        chance = np.maximum(upper - lower, 1e-12)
        slope_upper, slope_lower = upper * (1 - upper) / chance, lower * (1 - lower) / chance
        by_weight = np.bincount(column, weights=value * (slope_upper - slope_lower)[owner], minlength=m) / n + L2 * ahead
        # Thresholds take half a scoring step (gradient over squared gradients), one unit at most, and stay in order.
        by_edge, squares = np.zeros(GRADES + 1), np.full(GRADES + 1, 1e-9)
        for at, slope in ((high + 1, -slope_upper), (low + 1, slope_lower)):
            np.add.at(by_edge, at, slope / n)
            np.add.at(squares, at, slope * slope / n)
        edges = np.clip(edges - np.clip(0.5 * (by_edge / squares)[1:GRADES], -1, 1), -60, 60)
        edges = np.maximum.accumulate(edges - LEAST_GAP * np.arange(3)) + LEAST_GAP * np.arange(3)
        fresh = ahead - step * by_weight
        fresh = np.sign(fresh) * np.maximum(np.abs(fresh) - step * L1, 0)
        after = (1 + (1 + 4 * momentum * momentum) ** 0.5) / 2
        ahead = fresh + (momentum - 1) / after * (fresh - w)
        w, momentum = fresh, after
    return w, edges


def learn(docs: DataFrame, labels: DataFrame, **options) -> Ordinal:
    """The vocabulary comes from Spark; the driver gets the sample's texts as numbers of features with evidence."""
    bags = cut_lineage(sample(docs, labels, **options).withColumn("row", F.monotonically_increasing_id()))
    base = bags.agg(F.coalesce(F.avg("toxic"), F.lit(0.0))).first()[0]
    holds = bags.select("toxic", F.explode("words").alias("word")).groupBy("word").agg(F.count("*").alias("n"), F.avg("toxic").alias("share"))
    known = (F.col("n") >= LEAST_TEXTS) & (F.abs(F.col("share") - base) * F.sqrt("n") > EVIDENCE * (base * (1 - base)) ** 0.5)
    vocabulary = holds.filter(known).orderBy("word").collect()
    index = {r["word"]: i for i, r in enumerate(vocabulary)}

    def numbered(batches):
        for batch in batches:
            columns, values = [], []
            for words, times in zip(batch.column("words").to_pylist(), batch.column("times").to_pylist()):
                met = [(index[w], 1 + np.log2(n)) for w, n in zip(words, times) if w in index]
                columns.append([c for c, _ in met])
                values.append([float(v) for _, v in met])
            yield pa.RecordBatch.from_arrays(
                [batch.column("row"), batch.column("toxic"), pa.array(columns, pa.list_(pa.int32())), pa.array(values, pa.list_(pa.float32()))],
                names=["row", "toxic", "columns", "values"],
            )

    found = bags.mapInArrow(numbered, "row long, toxic int, columns array<int>, values array<float>").toArrow().combine_chunks()
    found = found.sort_by("row")  # reruns add in one order
    lists = found.column("columns").combine_chunks()
    sizes = np.asarray(lists.value_lengths().fill_null(0)) if len(lists) else np.zeros(0, np.int64)
    flat = lambda c: np.asarray(found.column(c).combine_chunks().flatten())
    telling = np.array([r["share"] >= TELLING and not r["word"].endswith("-") for r in vocabulary], float)
    weights, thresholds = fit(np.asarray(found.column("toxic")), np.repeat(np.arange(len(sizes)), sizes), flat("columns"), flat("values").astype(float), telling)
    return Ordinal({r["word"]: float(x) for r, x in zip(vocabulary, weights) if x}, thresholds)


def severity(docs: DataFrame, model: Ordinal, *, text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """``keep`` columns (default: all but the text), ``p_0`` to ``p_3``, ``expected_severity``, ``severity``, ``toxic``.

    ``severity`` is the largest grade reached with a chance of one half. Null and empty texts have no words and get what
    the thresholds alone say. Rows are scored one by one: repeated rows alike, an empty table gives none, long texts are
    read whole. Existing columns of these names are replaced.
    """
    made = [*(f"p_{k}" for k in range(GRADES)), "expected_severity", "severity", "toxic"]
    keep = [c for c in (docs.columns if keep is None else keep) if c != text and c not in made]
    kinds = ["double"] * (GRADES + 1) + ["int", "boolean"]
    picked, schema = text_last(docs, keep, text, dict(zip(made, kinds)))

    def run(batches):
        for batch in batches:
            *rest, texts = batch.columns
            p = model.chances(np.array([model.score(text_words(t.as_py())) for t in texts], float))
            over = 1 - np.cumsum(p, axis=1)[:, :-1]
            grade = (over >= TOXIC_FROM).sum(axis=1).astype(np.int32)
            new = [*(pa.array(p[:, k]) for k in range(GRADES)), pa.array(p @ np.arange(GRADES)), pa.array(grade), pa.array(grade > 0)]
            yield pa.RecordBatch.from_arrays([*rest, *new], names=[*batch.schema.names[:-1], *made])

    return picked.mapInArrow(run, schema)


def op6_ordinal_toxicity(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = learn(docs, table(spark, sf_dir, "labels"))
    return severity(docs, model, keep=["doc_id"])
