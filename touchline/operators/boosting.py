"""Boosted trees for counts: Poisson deviance with a log link on binned features.

Features are cut at quantiles into at most ``BINS`` bins once; the binned table (a byte per feature and row, an Arrow batch
to a record, so that passes over it cost Spark little) is checkpointed. A level of a tree is one job: each task adds up gradients and Hessians of its rows by (node, feature, bin),
Spark sums them, and the driver, which sees as many numbers as there are nodes, features and bins, picks the splits.
Leaves get the Newton step. Margins are carried in the table and written anew every ``KEEP`` rounds, without the
latest tree, which may still be halved: walking through many trees at every level would cost several times what the sums
do. The margins before are deleted then. No row and no margin passes the driver.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import cut_lineage, release, small_batches

BINS, KEEP = 64, 1
#: Ridge on leaf values, largest step of a leaf before shrinking, least gain of a split.
RIDGE, MOST_STEP, LEAST_GAIN = 1.0, 0.7, 1e-6
CUT_ERROR = 0.001


@dataclass
class Tree:
    """Nodes as lists: feature (-1 at a leaf), last bin that goes left, left child (the right one follows), leaf value."""

    feature: list[int] = field(default_factory=lambda: [-1])
    upto: list[int] = field(default_factory=lambda: [0])
    left: list[int] = field(default_factory=lambda: [0])
    value: list[float] = field(default_factory=lambda: [0.0])

    def split(self, node: int, feature: int, upto: int, values: tuple[float, float]) -> None:
        self.feature[node], self.upto[node], self.left[node] = feature, upto, len(self.feature)
        for v in values:
            self.feature.append(-1)
            self.upto.append(0)
            self.left.append(0)
            self.value.append(v)

    def nodes(self, bins: np.ndarray) -> np.ndarray:
        """Leaf of each row of bins."""
        feature, upto, left = (np.array(c) for c in (self.feature, self.upto, self.left))
        at, rows = np.zeros(len(bins), np.int64), np.arange(len(bins))
        # A leaf's way leads to itself.
        leaf = feature < 0
        feature, upto, left = np.where(leaf, 0, feature), np.where(leaf, 255, upto), np.where(leaf, np.arange(len(leaf)), left)
        for _ in range(self.depth()):
            at = left[at] + (bins[rows, feature[at]] > upto[at])
        return at

    def depth(self) -> int:
        """Splits on the longest way; children stand behind their node."""
        deep = [0] * len(self.feature)
        for node, f in enumerate(self.feature):
            if f >= 0:
                deep[self.left[node]] = deep[self.left[node] + 1] = deep[node] + 1
        return max(deep)

    def add_to(self, margins: np.ndarray, bins: np.ndarray) -> np.ndarray:
        return margins + np.array(self.value)[self.nodes(bins)]


@dataclass
class BoostedCounts:
    features: list[str]
    cuts: list[np.ndarray]
    base: float
    trees: list[Tree] = field(default_factory=list)
    #: Mean deviance on the training rows before each tree and after the last.
    deviance: list[float] = field(default_factory=list)

    def bins(self, columns: list) -> np.ndarray:
        """Bin 0 is for missing values, bin i + 1 for values from the i-th cut on."""
        out = np.zeros((len(columns[0]) if columns else 0, len(columns)), np.uint8)
        for j, c in enumerate(columns):
            x = c.to_numpy(zero_copy_only=False).astype(float)
            out[:, j] = np.where(np.isnan(x), 0, np.searchsorted(self.cuts[j], x, "right") + 1)
        return out

    def predict(self, df: DataFrame, name: str = "predicted") -> DataFrame:
        """``df`` with the mean count, in Arrow batches."""
        names = [f"_f{j}" for j in range(len(self.features))]
        rows = df.drop(name).select("*", *[F.col(c).cast("double").alias(n) for c, n in zip(self.features, names)])
        schema = df.drop(name).withColumn(name, F.lit(0.0)).schema

        def run(batches):
            for batch in batches:
                found = self.bins(batch.columns[-len(names) :])
                margins = np.full(batch.num_rows, self.base)
                for tree in self.trees:
                    margins = tree.add_to(margins, found)
                yield pa.RecordBatch.from_arrays([*batch.columns[: -len(names)], pa.array(np.exp(margins))], names=schema.names)

        return rows.mapInArrow(run, schema)


BLOCK = "y binary, margin binary, bins binary"


def _packed(y: np.ndarray, margins: np.ndarray, bins: np.ndarray) -> pa.RecordBatch:
    """Rows as one record of ``BLOCK``."""
    return pa.RecordBatch.from_arrays([pa.array([c.tobytes()], pa.binary()) for c in (y, margins, bins)], names=["y", "margin", "bins"])


def _unpacked(batches, width: int):
    """Targets, margins and bins of each record."""
    for batch in batches:
        for y, margins, bins in zip(*batch.columns):
            yield (np.frombuffer(c.as_buffer(), float) for c in (y, margins)), np.frombuffer(bins.as_buffer(), np.uint8).reshape(-1, width)


def _histogram(tree: Tree, active: list[int], waiting: list[Tree], width: int):
    """Sums by (node, feature, bin) as ``slot, g, h``; the slot -1 holds the deviance and the rows."""
    place = np.full(len(tree.feature), -1)
    place[active] = np.arange(len(active))

    def run(batches):
        size = len(active) * width * 256
        g, h, deviance, rows = np.zeros(size), np.zeros(size), 0.0, 0.0
        for (y, margins), bins in _unpacked(batches, width):
            for t in waiting:
                margins = t.add_to(margins, bins)
            mean, node = np.exp(margins), place[tree.nodes(bins)]
            deviance += 2 * float((np.where(y > 0, y * (np.log(np.maximum(y, 1e-300)) - margins), 0) - (y - mean)).sum())
            rows += len(y)
            held = node >= 0
            slots = ((node[held, None] * width + np.arange(width)) * 256 + bins[held]).ravel()
            g += np.bincount(slots, np.repeat((mean - y)[held], width), size)
            h += np.bincount(slots, np.repeat(mean[held], width), size)
        some = np.flatnonzero(h)
        columns = [np.r_[-1, some], np.r_[deviance, g[some]], np.r_[rows, h[some]]]
        yield pa.RecordBatch.from_arrays([pa.array(columns[0], pa.int64()), *(pa.array(c) for c in columns[1:])], names=["slot", "g", "h"])

    return run


def best_split(g: np.ndarray, h: np.ndarray) -> tuple[float, int, int, tuple[float, float], tuple[float, float]]:
    """``gain, feature, last bin on the left, (G, H) left, (G, H) right`` of one node's sums (features x bins)."""
    left_g, left_h = np.cumsum(g, axis=1), np.cumsum(h, axis=1)
    all_g, all_h = left_g[:, -1:], left_h[:, -1:]
    right_g, right_h = all_g - left_g, all_h - left_h
    gain = left_g**2 / (left_h + RIDGE) + right_g**2 / (right_h + RIDGE) - all_g**2 / (all_h + RIDGE)
    gain = np.where((left_h > 1e-9) & (right_h > 1e-9), gain, -np.inf)
    j, b = np.unravel_index(np.argmax(gain), gain.shape)
    return float(gain[j, b]), int(j), int(b), (left_g[j, b], left_h[j, b]), (right_g[j, b], right_h[j, b])


def fit_poisson_trees(df: DataFrame, features: list[str], target: str, *, rounds: int = 500, depth: int = 5, step: float = 0.05, floor: float = 0.05) -> BoostedCounts:
    """Trees on all rows with a target; missing features have a bin of their own.

    Boosting ends early when no split gains anything. Newton steps, shrunk by ``step``, lower the deviance at every round;
    a tree that would not is halved.
    """
    known = df.filter(F.col(target).isNotNull()).select(F.col(target).cast("double").alias("y"), *[F.col(c).cast("double").alias(f"f{j}") for j, c in enumerate(features)])
    mean = known.agg(F.avg("y")).first()[0]
    if mean is None:
        raise ValueError("no rows to fit on")
    names = [f"f{j}" for j in range(len(features))]
    quantiles = known.approxQuantile(names, [i / BINS for i in range(1, BINS)], CUT_ERROR)
    model = BoostedCounts(features, [np.unique(np.array(q, float)) for q in quantiles], float(np.log(max(mean, floor))))
    width = len(features)

    def binned(batches):
        for batch in batches:
            if batch.num_rows:
                yield _packed(np.asarray(batch.column(0), float), np.full(batch.num_rows, model.base), model.bins(batch.columns[1:]))

    small_batches(df.sparkSession)
    rows = cut_lineage(known.mapInArrow(binned, BLOCK))
    waiting: list[Tree] = []

    def sums(tree: Tree, active: list[int]):
        out = np.zeros((2, len(active) * width * 256))
        head = (0.0, 0.0)
        found = rows.mapInArrow(_histogram(tree, active, waiting, width), "slot long, g double, h double")
        for slot, g, h in found.groupBy("slot").agg(F.sum("g"), F.sum("h")).collect():
            if slot < 0:
                head = (g, h)
            else:
                out[:, slot] = g, h
        return head, out.reshape(2, len(active), width, 256)

    for _ in range(rounds):
        tree, active = Tree(), [0]
        for level in range(depth):
            (deviance, n), (g, h) = sums(tree, active)
            if not level:
                if model.deviance and deviance / n > model.deviance[-1] + 1e-12 and model.trees:
                    model.trees[-1].value = [v / 2 for v in model.trees[-1].value]
                    (deviance, n), (g, h) = sums(tree, active)
                model.deviance.append(deviance / n)
            grown = []
            for i, node in enumerate(active):
                gain, j, b, *sides = best_split(g[i], h[i])
                if gain > LEAST_GAIN:
                    values = tuple(float(np.clip(-a / (c + RIDGE), -MOST_STEP, MOST_STEP)) * step for a, c in sides)
                    grown += [len(tree.feature), len(tree.feature) + 1]
                    tree.split(node, j, b, values)
            active = grown
            if not active:
                break
        if len(tree.feature) == 1:
            break
        model.trees.append(tree)
        waiting.append(tree)
        if len(waiting) > KEEP:
            # The latest tree may still be halved, so it waits on.
            ready, waiting = waiting[:-1], waiting[-1:]

            def advance(batches, ready=ready):
                for (y, margins), bins in _unpacked(batches, width):
                    for t in ready:
                        margins = t.add_to(margins, bins)
                    yield _packed(y, margins, bins)

            before, rows = rows, cut_lineage(rows.mapInArrow(advance, rows.schema))
            release(before)
    (deviance, n), _ = sums(Tree(), [0])
    model.deviance.append(deviance / n)
    return model
