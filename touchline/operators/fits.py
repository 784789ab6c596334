"""Many small fits at once: every market or every refit of a schedule is a row, one Spark job per Newton step for all.

Only parameters pass the driver (one row per market, or a few numbers per refit), never rows, scores or knots.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import cut_lineage

TOLERANCE, MOST_STEPS = 1e-10, 60
#: Blocks up to which pooling goes on by market instead of by range of scores.
POOL_ROWS = 200_000
#: Cells of the rows x refits table a task holds at once.
CELLS = 2_000_000


# ---- one line per market ----------------------------------------------------------------------------------


def logistic_lines(counts: DataFrame, by: str, penalty: float = 0.0) -> DataFrame:
    """``by, intercept, slope`` of a logistic fit per market; ``counts`` holds ``by, x, n, pos``, a row per different x.

    Newton steps for all markets together: each is one grouped sum of the scores joined with a row per market. The
    penalty is half the squared slope times ``penalty``. Markets of one class have no row; with a single x and no penalty
    the slope stays 0.
    """
    start = counts.groupBy(by).agg(F.sum("n").alias("_n"), F.sum("pos").alias("_pos")).filter((F.col("_pos") > 0) & (F.col("_pos") < F.col("_n")))
    state = cut_lineage(start.select(by, F.log(F.col("_pos") / (F.col("_n") - F.col("_pos"))).alias("intercept"), F.lit(0.0).alias("slope")))
    x, a, b = F.col("x"), F.col("intercept"), F.col("slope")
    for _ in range(MOST_STEPS):
        p = 1 / (1 + F.exp(-(a + b * x)))
        met = counts.join(state, by).withColumns({"_r": F.col("pos") - F.col("n") * p, "_v": F.col("n") * p * (1 - p)})
        sums = {"g0": F.col("_r"), "g1": F.col("_r") * x, "h0": F.col("_v"), "h1": F.col("_v") * x, "h2": F.col("_v") * x * x}
        sums = met.groupBy(by, "intercept", "slope").agg(*[F.sum(v).alias(k) for k, v in sums.items()])
        sums = sums.withColumns({"g1": F.col("g1") - penalty * b, "h2": F.col("h2") + penalty})
        det = F.col("h0") * F.col("h2") - F.col("h1") * F.col("h1")
        solid = det > 1e-12 * F.col("h0") * F.col("h2")
        step_a = F.when(solid, (F.col("h2") * F.col("g0") - F.col("h1") * F.col("g1")) / det).otherwise(F.coalesce(F.try_divide("g0", "h0"), F.lit(0.0)))
        step_b = F.when(solid, (F.col("h0") * F.col("g1") - F.col("h1") * F.col("g0")) / det).otherwise(0.0)
        state = cut_lineage(sums.select(by, (a + step_a).alias("intercept"), (b + step_b).alias("slope"), F.greatest(F.abs(step_a), F.abs(step_b)).alias("_moved")))
        moved = state.agg(F.max("_moved")).first()[0]
        state = state.drop("_moved")
        if moved is None or moved < TOLERANCE:
            break
    return state


# ---- monotone steps ---------------------------------------------------------------------------------------


def _pool(tables):
    """Pools neighbours whose means do not rise; rows come sorted by key and score, a key's run may span batches."""
    key, stack, names = None, [], None

    def out():
        lo, hi, n, pos = zip(*stack) if stack else ((), (), (), ())
        return pa.RecordBatch.from_arrays([pa.array([key] * len(stack), kind), *(pa.array(c, pa.float64()) for c in (lo, hi, n, pos))], names=names)

    for batch in tables:
        names, kind = batch.schema.names, batch.schema.field(0).type
        for k, lo, hi, n, pos in zip(*(c.to_pylist() for c in batch.columns)):
            if k != key:
                if stack:
                    yield out()
                key, stack = k, []
            while stack and stack[-1][3] * n >= pos * stack[-1][2]:
                first, _, m, p = stack.pop()
                lo, n, pos = first, n + m, pos + p
            stack.append((lo, hi, n, pos))
    if stack:
        yield out()


def _pool_whole(rows: pa.Table) -> pa.Table:
    rows = rows.sort_by("lo").combine_chunks()
    pooled = list(_pool(rows.to_batches()))
    return pa.Table.from_batches(pooled, schema=pooled[0].schema) if pooled else rows


def isotonic_levels(counts: DataFrame, by: str) -> DataFrame:
    """``by, lo, hi, n, pos``: the levels of the isotonic fit per market; ``counts`` holds ``by, x, n, pos``.

    Pooling is the same in any order, so violators are pooled inside ranges of scores first, all markets in one range
    shuffle; ranges are cut anew from what is left, as long as that shrinks. Then a market's remaining levels meet. They
    are its step function, far fewer than its scores.
    """
    doubles = [F.col(c).cast("double").alias(n) for c, n in (("x", "lo"), ("x", "hi"), ("n", "n"), ("pos", "pos"))]
    blocks = cut_lineage(counts.select(by, *doubles))
    schema, left = blocks.schema, blocks.count()
    while left > POOL_ROWS:
        blocks = cut_lineage(blocks.repartitionByRange(by, "lo").sortWithinPartitions(by, "lo").mapInArrow(_pool, schema))
        before, left = left, blocks.count()
        if left > 0.9 * before:
            break
    return blocks.groupBy(by).applyInArrow(_pool_whole, schema)


def knots(levels: DataFrame, by: str) -> DataFrame:
    """``by, x, y``: both ends of each level, once where they are one."""
    y = F.col("pos") / F.col("n")
    ends = F.array(*[F.struct(F.col(c).alias("x"), y.alias("y")) for c in ("lo", "hi")])
    return levels.select(by, F.inline(F.when(F.col("lo") == F.col("hi"), F.slice(ends, 1, 1)).otherwise(ends)))


# ---- refits over a growing past -----------------------------------------------------------------------------


def _sums(centre: np.ndarray, theta: np.ndarray):
    """Scores and information of every refit over the rows before it, as ``slot, value``."""
    targets, refits, width = theta.shape
    i, j = np.triu_indices(width)

    def run(batches):
        total = np.zeros((targets, refits, width + len(i)))
        for batch in batches:
            columns = [np.asarray(c, float) for c in batch.columns]
            at, goals, x = columns[0], columns[1 : 1 + targets], np.column_stack(columns[1 + targets :])
            design = np.column_stack([np.ones(len(at)), x - centre])
            for a in range(0, len(at), step := max(1, CELLS // refits)):
                rows = slice(a, a + step)
                part, seen = design[rows], at[rows, None] < np.arange(refits)
                for t in range(targets):
                    mean = np.exp(np.clip(part @ theta[t].T, -30, 30)) * seen
                    total[t, :, :width] += (goals[t][rows, None] * seen - mean).T @ part
                    total[t, :, width:] += mean.T @ (part[:, i] * part[:, j])
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(total.size)), pa.array(total.ravel())], names=["slot", "value"])

    return run


def poisson_refits(rows: DataFrame, at: str, refits: int, features: list[str], targets: list[str], reg: float, floor: float) -> np.ndarray:
    """Coefficients (targets x refits x 1 + features) on the raw features; refit b is fitted on all rows with ``at`` < b.

    Log link, features standardised by the rows of the refit, missing ones 0 before that, L2 penalty ``reg`` on the
    standardised coefficients relative to the sum of the target. One job gives moments of all refits (sums per ``at``, then
    running sums over refits), and one job per Newton step gives gradients and Hessians of all refits and targets. A refit
    without a single count predicts ``floor``.
    """
    known = rows
    for c in targets:
        known = known.filter(F.col(c).isNotNull())
    clean = {c: F.when(F.isnan(F.col(c).cast("double")) | (F.abs(F.col(c).cast("double")) == float("inf")), 0.0).otherwise(F.col(c).cast("double")) for c in features}
    known = cut_lineage(known.select(F.col(at).cast("double").alias("_at"), *[F.col(c).cast("double") for c in targets], *[v.alias(c) for c, v in clean.items()]))
    centre = np.array([v or 0.0 for v in known.agg(*[F.avg(c) for c in features]).first()])
    parts = [F.count(F.lit(1)), *[F.sum(c) for c in targets]]
    for c, g in zip(features, centre):
        parts += [F.count(c), F.sum(F.col(c) - float(g)), F.sum((F.col(c) - float(g)) ** 2)]
    moments = np.zeros((refits, len(parts)))
    for at_, *values in known.groupBy("_at").agg(*[p.alias(f"m{i}") for i, p in enumerate(parts)]).collect():
        if at_ + 1 < refits:
            moments[int(at_) + 1] += [v or 0.0 for v in values]
    moments = np.cumsum(moments, axis=0)
    count, goals, rest = moments[:, 0], moments[:, 1 : 1 + len(targets)], moments[:, 1 + len(targets) :].reshape(refits, -1, 3)
    filled = np.maximum(rest[:, :, 0], 1)
    mean = rest[:, :, 1] / filled
    spread = np.sqrt(np.maximum(rest[:, :, 2] / filled - mean**2, 0))
    spread[spread < 1e-12] = 1.0

    width = len(features) + 1
    scale = np.zeros((refits, width, width))  # raw coefficients of standardised ones
    scale[:, 0, 0] = 1
    scale[:, 0, 1:] = -mean / spread
    scale[:, range(1, width), range(1, width)] = 1 / spread
    live = (goals > 0).T  # targets x refits
    z = np.zeros((len(targets), refits, width))
    z[:, :, 0] = np.where(live, np.log(np.where(live, goals.T, 1) / np.maximum(count, 1)), np.log(floor))
    penalty = reg * goals.T[:, :, None] * np.r_[0, np.ones(width - 1)]
    upper = np.triu_indices(width)
    filled_in = known.select("_at", *targets, *[F.coalesce(c, F.lit(0.0)).alias(c) for c in features])
    for _ in range(MOST_STEPS):
        raw = np.einsum("bij,tbj->tbi", scale, z)
        found = np.zeros(len(targets) * refits * (width + len(upper[0])))
        for slot, value in filled_in.mapInArrow(_sums(centre, raw), "slot long, value double").groupBy("slot").agg(F.sum("value")).collect():
            found[slot] = value
        found = found.reshape(len(targets), refits, -1)
        square = np.zeros((len(targets), refits, width, width))
        square[:, :, upper[0], upper[1]] = square[:, :, upper[1], upper[0]] = found[:, :, width:]
        gradient = np.einsum("bji,tbj->tbi", scale, found[:, :, :width]) - penalty * z
        hessian = np.einsum("bji,tbjk,bkl->tbil", scale, square, scale) + penalty[..., None] * np.eye(width)
        hessian[~live] = np.eye(width)
        # A feature that never changes has no information of its own.
        hessian += 1e-12 * np.eye(width)
        step = np.where(live[..., None], np.linalg.solve(hessian, gradient[..., None])[..., 0], 0.0)
        z += step
        if np.abs(step).max() < TOLERANCE:
            break
    raw = np.einsum("bij,tbj->tbi", scale, z)
    raw[:, :, 0] -= raw[:, :, 1:] @ centre
    return raw
