"""Document fingerprints from a text's most improbable byte windows, kept in chained Bloom filters.

Every window of 32 bytes is a feature. Its entropy falls into one of 1001 bins; how rare a bin is among all windows of all
documents ranks the feature. In each run of 32 neighbouring features the rarest one (the first of equals) scores a point,
and features with 8 points or more enter the fingerprint: 5 bits of a filter of 2048 bits each. A filter takes 160
features, then the next one of the chain begins. Two filters are as alike as the bits they share, beyond what chance
shares, out of the most they could share; two chains as the mean of each filter's best match. This is the similarity
digest of Roussev (2010), with half its window, as texts are short, and ranks
counted here instead of a fixed table. A text shorter than a window is one feature.

Ranks: one pass, a thousand counts per task. Fingerprints: a narrow map; a text longer than a piece is gone through piece by
piece, so memory does not grow with it. Neighbouring documents meet by one shuffle of the texts into ranges of ids; each
range ends with a copy of the next range's first document, so no document waits for another task.
"""

from __future__ import annotations

import base64
import hashlib

import numpy as np
import pyarrow as pa
from pyspark.ml.feature import Bucketizer
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import spare, table

# The digest's parameters.
WIDTH, POINTS, BITS, PROBES, FULL = 32, 8, 2048, 5, 160
BINS, WEAK, CHANCE_MARGIN = 1000, 100, 0.3
#: Bytes worked on together, and ranges of ids for each shuffle partition.
PIECE, RANGES = 1 << 20, 8

_FIXED = 1 << 20
_LOG = np.array([0, *(round(k * np.log2(k) * _FIXED) for k in range(1, WIDTH + 1))], np.int64)
_MOST = int(_LOG[WIDTH])
_NEVER = 1 << 30


def entropies(raw: np.ndarray) -> np.ndarray:
    """Entropy bin (0 to 1000) of each window of ``WIDTH`` bytes.

    The sum of c * log2(c) over a window's byte counts changes by one byte's count on each side as the window moves; both
    counts come from the pairs of equal bytes less than a window apart, found as k-th neighbours among the sorted positions
    of a byte, for k = 1, 2, ... while there are any. Whole numbers, so no rounding adds up.
    """
    n = len(raw)
    if n < WIDTH:
        return np.zeros(0, np.int64)
    order = np.argsort(raw, kind="stable")
    wide = n + 2 * WIDTH
    kind = np.int32 if 256 * wide < 1 << 31 else np.int64
    keys = raw[order].astype(kind) * kind(wide) + order.astype(kind)
    # Equal bytes behind and ahead of each byte that a window ending or beginning with it holds.
    left, right = np.zeros(n, np.int8), np.zeros(n, np.int8)
    near = keys[1:] - keys[:-1] < WIDTH
    right[:-1] += near
    left[1:] += near
    at = np.flatnonzero(near).astype(kind)
    for k in range(2, WIDTH):
        at = at[: np.searchsorted(at, n - k)]
        at = at[keys[at + kind(k)] - keys[at] < WIDTH]
        if not len(at):
            break
        right[at] += 1
        left[at + kind(k)] += 1
    ahead, behind = np.empty(n, np.int8), np.empty(n, np.int8)
    ahead[order], behind[order] = right, left
    step, first = np.diff(_LOG), _LOG[np.bincount(raw[:WIDTH], minlength=256)].sum()
    held = np.empty(n - WIDTH + 1, np.int64)
    held[0] = first
    np.cumsum(step[behind[WIDTH:]] - step[ahead[: n - WIDTH]], out=held[1:])
    held[1:] += first
    return (_MOST - held) * BINS // _MOST


def _rarest(keys: np.ndarray) -> np.ndarray:
    """Minimum of each run of ``WIDTH`` keys, the runs that reach over the ends included."""
    count = len(keys) + WIDTH - 1
    never = np.int64(_NEVER) << 32
    blocks = -(-(count + WIDTH) // WIDTH)
    padded = np.full(blocks * WIDTH, never, np.int64)
    padded[WIDTH - 1 : WIDTH - 1 + len(keys)] = keys
    padded = padded.reshape(blocks, WIDTH)
    upto = np.minimum.accumulate(padded, axis=1).ravel()
    onwards = np.minimum.accumulate(padded[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(onwards[:count], upto[WIDTH - 1 : WIDTH - 1 + count])


def _chosen(ranks: np.ndarray) -> np.ndarray:
    """Positions with enough points, in order; a rank of _NEVER is no feature."""
    best = _rarest((ranks.astype(np.int64) << 32) | np.arange(len(ranks)))
    best = best[(best >> 32) < _NEVER] & 0xFFFFFFFF
    return np.flatnonzero(np.bincount(best, minlength=1) >= POINTS) if len(best) else np.zeros(0, np.int64)


def _hashes(raw: np.ndarray, at: np.ndarray) -> np.ndarray:
    """64-bit hash of the windows that begin at ``at``."""
    words = raw[at[:, None] + np.arange(WIDTH)].view("<u8")
    out = np.full(len(at), 0x9E3779B97F4A7C15, np.uint64)
    for j in range(words.shape[1]):
        out = (out ^ words[:, j]) * np.uint64(0xBF58476D1CE4E5B9)
        out = (out ^ (out >> np.uint64(29))) * np.uint64(0x94D049BB133111EB)
        out ^= out >> np.uint64(32)
    return out


def _pieces(raw: np.ndarray):
    """A long text's features piece by piece: its bytes with all windows that can decide on them, and which are its own."""
    features = len(raw) - WIDTH + 1
    for start in range(0, features, PIECE):
        end = min(features, start + PIECE)
        low, high = max(0, start - WIDTH + 1), min(features, end + WIDTH - 1)
        yield raw[low : high + WIDTH - 1], start - low, end - low


def _together(texts: list[bytes]):
    """Short texts in runs of about a piece, zeros between them: bytes, where each begins, its features (one if shorter
    than a window, none if empty)."""
    i = 0
    while i < len(texts):
        j, size = i, 0
        while j < len(texts) and (j == i or size + len(texts[j]) <= PIECE):
            size += len(texts[j]) + WIDTH
            j += 1
        sizes = np.array([len(t) for t in texts[i:j]], np.int64)
        begins = np.concatenate(([0], np.cumsum(sizes + WIDTH)[:-1]))
        raw = np.frombuffer(b"".join(t + bytes(WIDTH) for t in texts[i:j]), np.uint8)
        yield raw, begins, np.where(sizes >= WIDTH, sizes - WIDTH + 1, np.minimum(sizes, 1))
        i = j


def _own(begins: np.ndarray, counts: np.ndarray, length: int) -> np.ndarray:
    """Which windows are features: those from each begin on, as many as counted."""
    change = np.zeros(length + 1, np.int8)
    np.add.at(change, begins[counts > 0], 1)
    np.add.at(change, (begins + counts)[counts > 0], -1)
    return np.cumsum(change[:length], dtype=np.int8) > 0


def _split(texts: list[bytes]) -> tuple[list[int], list[int]]:
    short = [i for i, t in enumerate(texts) if len(t) <= PIECE]
    return short, [i for i, t in enumerate(texts) if len(t) > PIECE]


def bin_counts(texts: list[bytes]) -> np.ndarray:
    """Features in each entropy bin."""
    total = np.zeros(BINS + 1, np.int64)
    short, long = _split(texts)
    for raw, begins, counts in _together([texts[i] for i in short]):
        found = entropies(raw)
        total += np.bincount(found[_own(begins, counts, len(found))], minlength=BINS + 1)
    for i in long:
        for raw, first, last in _pieces(np.frombuffer(texts[i], np.uint8)):
            total += np.bincount(entropies(raw)[first:last], minlength=BINS + 1)
    return total


def features(texts: list[bytes], ranks: np.ndarray) -> list[np.ndarray]:
    """Hashes of each text's chosen features, each once, in the order of the text."""
    out: list[np.ndarray] = [np.zeros(0, np.uint64)] * len(texts)
    once = lambda h: h[np.sort(np.unique(h, return_index=True)[1])]
    short, long = _split(texts)
    at = 0
    for raw, begins, counts in _together([texts[i] for i in short]):
        bins = entropies(raw)
        # A gap of WIDTH zeros lies between two texts' features, so a run of WIDTH touches one text alone.
        chosen = _chosen(np.where(_own(begins, counts, len(bins)), ranks[bins], _NEVER))
        found, bounds = _hashes(raw, chosen), np.searchsorted(chosen, np.append(begins, len(raw)))
        for k in range(len(begins)):
            out[short[at + k]] = once(found[bounds[k] : bounds[k + 1]])
        at += len(begins)
    for i in long:
        found = []
        for raw, first, last in _pieces(np.frombuffer(texts[i], np.uint8)):
            chosen = _chosen(ranks[entropies(raw)])
            found.append(_hashes(raw, chosen[(chosen >= first) & (chosen < last)]))
        out[i] = once(np.concatenate(found))
    return out


class Chain:
    """A fingerprint: the filters' bits, features in each, bits set in each."""

    def __init__(self, bits: np.ndarray, held: int):
        self.bits = bits.reshape(-1, BITS // 64)
        self.held = np.minimum(FULL, held - FULL * np.arange(len(self.bits)))
        self.total = np.bitwise_count(self.bits).sum(axis=1, dtype=np.int64)

    @classmethod
    def of(cls, hashes: np.ndarray) -> Chain:
        filters = -(-len(hashes) // FULL)
        flags = np.zeros(filters * BITS, bool)
        base = np.arange(len(hashes)) // FULL * BITS
        for j in range(PROBES):
            flags[base + ((hashes >> np.uint64(11 * j)) & np.uint64(BITS - 1)).astype(np.int64)] = True
        return cls(np.packbits(flags).view("<u8"), len(hashes))

    def __str__(self) -> str:
        return f"{int(self.held.sum())}:{base64.b64encode(self.bits.tobytes()).decode()}"

    @classmethod
    def parse(cls, written: str) -> Chain:
        held, _, bits = written.partition(":")
        return cls(np.frombuffer(base64.b64decode(bits), "<u8"), int(held))

    def matches(self, other: Chain) -> np.ndarray:
        """Best likeness of each own filter among the other's."""
        best = np.zeros(len(self.bits))
        empty = 1 - 1 / BITS
        for i in range(len(self.bits)):
            common = np.bitwise_count(self.bits[i] & other.bits).sum(axis=1, dtype=np.int64)
            most = np.minimum(self.total[i], other.total)
            a, b = PROBES * self.held[i], PROBES * other.held
            chance = BITS * (1 - empty**a - empty**b + empty ** (a + b))
            least = chance + CHANCE_MARGIN * (most - chance)
            score = np.where(most > least, (common - least) / np.where(most > least, most - least, 1), common >= most)
            best[i] = np.clip(score, 0, 1).max()
        return best

    def like(self, other: Chain) -> float:
        """0 to 1. The chain with fewer filters is looked for in the other; chains of one length in both directions. Two
        empty chains are alike, an empty and another one are not."""
        if not len(self.bits) or not len(other.bits):
            return float(len(self.bits) == len(other.bits))
        if len(self.bits) == len(other.bits):
            return float((self.matches(other).mean() + other.matches(self).mean()) / 2)
        a, b = (self, other) if len(self.bits) < len(other.bits) else (other, self)
        return float(a.matches(b).mean())


def likeness(a: str, b: str) -> float:
    """Likeness of two written fingerprints."""
    return Chain.parse(a).like(Chain.parse(b))


def rarity(docs: DataFrame, text: str = "text") -> np.ndarray:
    """Rank of each entropy bin, from the features of all documents: the fewer there are, the lower. Bins under WEAK (runs
    of few different bytes) come behind all others."""

    def run(batches):
        total = np.zeros(BINS + 1, np.int64)
        for batch in batches:
            total += bin_counts([(t.as_py() or "").encode() for t in batch.column(0)])
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(BINS + 1)), pa.array(total)], names=["bin", "n"])

    counts = np.zeros(BINS + 1, np.int64)
    found = docs.select(F.col(text).cast("string").alias("text")).mapInArrow(run, "bin long, n long")
    for at, n in found.groupBy("bin").agg(F.sum("n")).collect():
        counts[at] = n
    return ranks_of(counts)


def ranks_of(counts: np.ndarray) -> np.ndarray:
    order = np.lexsort((np.arange(BINS + 1), counts, np.arange(BINS + 1) < WEAK))
    ranks = np.empty(BINS + 1, np.int64)
    ranks[order] = np.arange(BINS + 1)
    return ranks


def fingerprint(docs: DataFrame, ranks: np.ndarray, *, text: str = "text", name: str = "fingerprint") -> DataFrame:
    """``docs`` with the fingerprint of each whole text in the column ``name`` (a column called so is replaced).

    A null text counts as an empty one, whose fingerprint holds no feature. Equal texts have equal fingerprints.
    """
    rest, read = docs.drop(name), spare("_text", docs)
    schema = rest.withColumn(name, F.lit("")).schema

    def run(batches):
        for batch in batches:
            made = [str(Chain.of(h)) for h in features([(t.as_py() or "").encode() for t in batch.column(batch.num_columns - 1)], ranks)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(made, pa.string())], names=schema.names)

    return docs.select(*rest.columns, F.col(text).cast("string").alias(read)).mapInArrow(run, schema)


def in_ranges(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``at, guard, doc_id, text`` by descending id, a range's rows together and behind them, as ``guard``, the first row of
    the next range (after the last: of the first). Null ids come last, equal ids by text."""
    spark = docs.sparkSession
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text"))
    wide, double = RANGES * int(spark.conf.get("spark.sql.shuffle.partitions")), F.col("doc_id").cast("double")
    probabilities = [i / wide for i in range(1, wide)]
    cuts = sorted(set(rows.select(double.alias("x")).approxQuantile("x", probabilities, 0.2 / wide))) if wide > 1 else []
    rows = rows.withColumn("x", double)
    if cuts:
        ranges = Bucketizer(splits=[-np.inf, *cuts, np.inf], inputCol="x", outputCol="at_", handleInvalid="keep")
        rows = ranges.transform(rows).withColumn("at", F.when(F.col("x").isNull(), wide).otherwise(wide - 1 - F.col("at_")).cast("int"))
    else:
        rows = rows.withColumn("at", F.when(F.col("x").isNull(), wide).otherwise(0).cast("int"))
    rows = rows.select("at", "doc_id", "text")
    # A row per range, so their number is bounded by the parameter.
    firsts = rows.groupBy("at").agg(F.max("doc_id").alias("first_id"))
    before = F.coalesce(F.lag("at").over(Window.orderBy("at")), F.max("at").over(Window.orderBy("at").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)))
    firsts = firsts.withColumn("goes_to", before).withColumnRenamed("at", "of")
    met = rows.join(F.broadcast(firsts), (F.col("at") == F.col("of")) & F.col("doc_id").eqNullSafe(F.col("first_id")))
    guards = met.groupBy("goes_to", "first_id").agg(F.min("text").alias("text"))
    guards = guards.select(F.col("goes_to").alias("at"), F.lit(True).alias("guard"), F.col("first_id").alias("doc_id"), "text")
    every = rows.select("at", F.lit(False).alias("guard"), "doc_id", "text").unionByName(guards)
    return every.repartition("at").sortWithinPartitions("at", "guard", F.desc_nulls_last("doc_id"), "text")


def edited(text: str, following: str) -> str:
    """``text`` with its last third replaced by the beginning of ``following``."""
    third = len(text) // 3
    return text[: len(text) - third] + following[:third]


def compared(docs: DataFrame, ranks: np.ndarray, *, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next``, a row per document.

    The next document is the one of the next smaller id, after the last one the first. Null texts count as empty; an empty
    text's edited text is empty as well, and two empty fingerprints have a likeness of 1. Null ids come after all others,
    rows of one id by their texts; repeated rows are documents of their own. A single document is its own next one, an
    empty table gives an empty one. Other columns are not looked at.
    """
    names = ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]
    kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64()]

    def run(batches):
        last = None  # the row that still waits for the next one: id, guard, text, chain
        for batch in batches:
            if not batch.num_rows:
                continue
            ids, guards, texts = (batch.column(c).to_pylist() for c in ("doc_id", "guard", "text"))
            if last is not None:
                ids, guards, texts = [last[0], *ids], [last[1], *guards], [last[2], *texts]
            changed = [edited(t, u) if not g else "" for t, u, g in zip(texts, texts[1:], guards)]
            made = [Chain.of(h) for h in features([t.encode() for t in [*texts[1 if last else 0 :], *changed]], ranks)]
            own = ([last[3]] if last else []) + made[: len(made) - len(changed)]
            others = made[len(made) - len(changed) :]
            rows = [
                (ids[i], len(texts[i]), hashlib.sha256(changed[i].encode()).hexdigest(), str(own[i]), str(others[i]), own[i].like(others[i]), own[i].like(own[i + 1]))
                for i in range(len(changed))
                if not guards[i]
            ]
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], kind) for k, kind in enumerate(kinds)], names=names)
            last = (ids[-1], guards[-1], texts[-1], own[-1])

    kind = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
    return in_ranges(docs, doc_id, text).select("doc_id", "guard", "text").mapInArrow(run, kind)


def op12_rare_feature_digest(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return compared(docs, rarity(docs))
