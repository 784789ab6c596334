"""Importance resampling of documents towards a target distribution.

A text's features are its runs of one to ``n`` words, hashed into buckets. A bucket's gain is the log ratio of its smoothed
share among the target's features and among those of all documents; a document's weight is the sum of its features' gains.
With Gumbel noise on the weights the highest scores are a sample without replacement.

1. bucket counts of all documents and of the target: each task sums an array of counts and hands on one row per bucket;
2. the gains (an array as long as there are buckets, a parameter) travel with the function that scores the texts: a batch's
   features are one array of buckets, looked up and summed by document. The narrow result is checkpointed;
3. the cutoff: a quantile sketch gives a bracket of scores, exact counts of the rows above and inside validate it, or it is
   widened until they do. Only the bracket is sorted to find the last score drawn;
4. the drawn rows, and only these, are numbered by a range shuffle.
"""

from __future__ import annotations

import hashlib
import math
import re
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import cut_lineage
from .common import binaries, matches, ranked, table

BUCKETS, LONGEST_RUN, FEWEST_WORDS, PERCENT, SEED = 10_000, 1, 20, 10, 2024
#: Rank error of the first bracket as a share of the rows; it doubles until the bracket holds the cutoff.
SKETCH_ERROR = 0.002
#: Features whose buckets a task remembers at once.
HELD = 500_000
# A-Z are lowered first; all bytes beyond ASCII belong to words.
_WORD = re.compile(rb"[0-9a-z\x80-\xff]+")


class _Buckets(dict):
    """Bucket of a feature's bytes, worked out on first sight."""

    def __init__(self, buckets: int):
        super().__init__()
        self.buckets = buckets

    def __missing__(self, feature: bytes) -> int:
        if len(self) >= HELD:
            self.clear()
        bucket = self[feature] = zlib.crc32(feature) % self.buckets
        return bucket


def hashed(raw: bytes, longest: int, known: _Buckets):
    """Arrays of the buckets of a text's features, a piece of the text at a time, and the words in each piece."""
    carried: list[bytes] = []
    for words in matches(_WORD, raw.lower()):
        found = [np.fromiter(map(known.__getitem__, words), np.int64, len(words))]
        both = carried + words
        for k in range(2, longest + 1):
            # Runs that end in this piece.
            ends = range(max(len(carried) + 1, k), len(both) + 1)
            found.append(np.fromiter((known[b" ".join(both[i - k : i])] for i in ends), np.int64))
        carried = both[len(both) - longest + 1 :] if longest > 1 else []
        yield np.concatenate(found), len(words)


def bucket_counts(texts: DataFrame, text: str = "text", *, longest: int = LONGEST_RUN, buckets: int = BUCKETS) -> np.ndarray:
    """Features per bucket over all texts; equal to ``buckets`` numbers, whatever the table's size."""

    def run(batches):
        total, known = np.zeros(buckets, np.int64), _Buckets(buckets)
        for batch in batches:
            for raw in binaries(batch.column(0)):
                for found, _ in hashed(raw, longest, known):
                    total += np.bincount(found, minlength=buckets)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], names=["bucket", "n"])

    rows = texts.select(F.col(text).cast("string").alias("text")).mapInArrow(run, "bucket long, n long")
    out = np.zeros(buckets, np.int64)
    for bucket, n in rows.groupBy("bucket").agg(F.sum("n").alias("n")).collect():
        out[bucket] = n
    return out


def gains(source: np.ndarray, target: np.ndarray) -> np.ndarray:
    """floor(1000 * ln) of the ratio of smoothed shares, by bucket."""
    held, wanted, size = int(source.sum()), int(target.sum()), len(source)
    ratio = lambda s, t: float(t + 1) * float(held + size) / (float(s + 1) * float(wanted + size))
    return np.array([math.floor(1000 * math.log(ratio(int(s), int(t)))) for s, t in zip(source, target)], np.int64)


def noise(key: str, seed: int = SEED) -> int:
    """floor(1000 * a Gumbel variate) that a hash of the key fixes."""
    h = int(hashlib.sha256(f"{seed}:{key}".encode()).hexdigest()[:8], 16)
    return math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))


def scores(docs: DataFrame, gain: np.ndarray, *, doc_id: str = "doc_id", text: str = "text", longest: int = LONGEST_RUN, seed: int = SEED) -> DataFrame:
    """``doc_id, n_words, n_features, weight, score``, a row per document."""

    def run(batches):
        known = _Buckets(len(gain))
        for batch in batches:
            n_words, n_features, weights, notes = [], [], [], []
            for key, raw in zip(batch.column(0).to_pylist(), binaries(batch.column(1))):
                words = features = weight = 0
                for found, n in hashed(raw, longest, known):
                    words, features, weight = words + n, features + len(found), weight + int(gain[found].sum())
                n_words.append(words)
                n_features.append(features)
                weights.append(weight)
                notes.append(weight + noise("" if key is None else str(key), seed))
            columns = [batch.column(0), *(pa.array(x, pa.int64()) for x in (n_words, n_features, weights, notes))]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "n_words", "n_features", "weight", "score"])

    picked = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
    return picked.mapInArrow(run, "doc_id long, n_words long, n_features long, weight long, score long")


ORDER = ("score", "doc_id", "n_features")


def _order() -> list:
    return [F.desc("score"), F.asc_nulls_last("doc_id"), F.desc("n_features")]


def cutoff(rows: DataFrame, draw: int, *, error: float = SKETCH_ERROR) -> tuple[int, int | None, int]:
    """``score, doc_id, n_features`` of the row at place ``draw`` by score, then id.

    The sketch only proposes: what lies above and inside the bracket is counted exactly.
    """
    n = rows.count()
    if not 0 < draw <= n:
        raise ValueError("nothing to draw, or more than there is")
    share = 1 - draw / n
    while True:
        low, high = max(0.0, share - error), min(1.0, share + error)
        bottom, top = rows.approxQuantile("score", [low, high], error / 2)
        bottom, top = -math.inf if low == 0 else bottom, math.inf if high == 1 else top
        above, inside = rows.agg(F.count_if(F.col("score") > top), F.count_if(F.col("score").between(bottom, top))).first()
        if above < draw <= above + inside:
            break
        error *= 2
    bracket = ranked(rows.filter(F.col("score").between(bottom, top)), _order(), "place")
    return tuple(bracket.filter(F.col("place") == draw - above).select(*ORDER).first())


def resample(
    docs: DataFrame,
    target: DataFrame,
    *,
    doc_id: str = "doc_id",
    text: str = "text",
    target_text: str = "text",
    longest: int = LONGEST_RUN,
    buckets: int = BUCKETS,
    fewest: int = FEWEST_WORDS,
    percent: int = PERCENT,
    seed: int = SEED,
    error: float = SKETCH_ERROR,
) -> DataFrame:
    """Every document's ``doc_id, n_features, weight, score, rank``; rank is null for those not drawn.

    Of the N documents with at least ``fewest`` words floor(percent * N / 100) are drawn, highest scores first, ties to the
    smaller id. A null, empty or blank text has no feature, weight 0 and is never drawn. A null id counts as an empty one
    in the hash and comes last of its ties. Repeated rows are documents of their own with one score; where the cutoff
    falls between them, as many are drawn as are due. Empty documents give an empty table; an empty target has share
    1 / buckets in each bucket. Other columns are not looked at.
    """
    gain = gains(bucket_counts(docs, text, longest=longest, buckets=buckets), bucket_counts(target, target_text, longest=longest, buckets=buckets))
    rows = cut_lineage(scores(docs, gain, doc_id=doc_id, text=text, longest=longest, seed=seed))
    able = rows.filter(F.col("n_words") >= fewest)
    draw = percent * able.count() // 100
    out = ["doc_id", "n_features", "weight", "score"]
    if not draw:
        return rows.select(*out, F.lit(None).cast("long").alias("rank"))
    score, last, features = cutoff(able, draw, error=error)
    id_up_to = F.lit(True) if last is None else F.coalesce(F.col("doc_id") < last, F.lit(False))
    same_id = F.col("doc_id").eqNullSafe(F.lit(last))
    in_time = (F.col("score") > score) | ((F.col("score") == score) & (id_up_to | (same_id & (F.col("n_features") >= features))))
    in_time = (F.col("n_words") >= fewest) & in_time
    # Equal rows at the cutoff may be one too many.
    drawn = ranked(rows.filter(in_time), _order(), "rank").withColumn("rank", F.when(F.col("rank") <= draw, F.col("rank")))
    return drawn.select(*out, "rank").unionByName(rows.filter(~in_time).select(*out, F.lit(None).cast("long").alias("rank")))


def op11_importance_resampling(spark, sf_dir: str) -> DataFrame:
    return resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


_SQL_WORDS = r"regexp_extract_all(translate({0}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
#: crc32 is had from its definition: eight steps for each of 256 bytes, then one lookup per byte of a word.
OP11_SQL = f"""
WITH crc AS (SELECT list_transform(range(256), lambda i: list_reduce(list_prepend(i::BIGINT, range(8)), lambda c, k: CASE WHEN c % 2 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END)) AS steps),
d AS (SELECT doc_id, {_SQL_WORDS.format("coalesce(text, '')")} AS w FROM documents),
b AS (SELECT {_SQL_WORDS.format("coalesce(text, '')")} AS w FROM benchmark),
dw AS (SELECT doc_id, unnest(w) AS word FROM d), bw AS (SELECT unnest(w) AS word FROM b),
named AS (SELECT DISTINCT word FROM (SELECT word FROM dw UNION ALL SELECT word FROM bw)),
hexed AS (SELECT word, hex(encode(word)) AS h FROM named),
hashed AS (SELECT word, xor(list_reduce(list_prepend(4294967295, list_transform(range(0, length(h), 2), lambda i: ('0x' || substr(h, i::INT + 1, 2))::BIGINT)),
  lambda c, x: xor(c >> 8, steps[(xor(c, x) & 255) + 1])), 4294967295) % 10000 AS bucket FROM hexed, crc),
s AS (SELECT bucket, count(*) AS n FROM dw JOIN hashed USING (word) GROUP BY 1), t AS (SELECT bucket, count(*) AS n FROM bw JOIN hashed USING (word) GROUP BY 1),
gain AS (SELECT k AS bucket, CAST(floor(1000 * ln((coalesce(t.n, 0) + 1)::DOUBLE * ((SELECT coalesce(sum(n), 0) FROM s) + 10000)::DOUBLE
  / ((coalesce(s.n, 0) + 1)::DOUBLE * ((SELECT coalesce(sum(n), 0) FROM t) + 10000)::DOUBLE))) AS BIGINT) AS g
  FROM range(10000) r(k) LEFT JOIN s ON s.bucket = k LEFT JOIN t ON t.bucket = k),
weighed AS (SELECT doc_id, CAST(sum(g) AS BIGINT) AS weight FROM dw JOIN hashed USING (word) JOIN gain USING (bucket) GROUP BY 1),
scored AS (SELECT doc_id, CAST(len(w) AS BIGINT) AS n_features, coalesce(weight, 0) AS weight,
  coalesce(weight, 0) + CAST(floor(-1000 * ln(-ln((('0x' || substr(sha256('2024:' || doc_id), 1, 8))::BIGINT + 0.5::DOUBLE) / 4294967296))) AS BIGINT) AS score FROM d LEFT JOIN weighed USING (doc_id)),
placed AS (SELECT *, row_number() OVER (PARTITION BY n_features >= 20 ORDER BY score DESC, doc_id) AS place, count(*) OVER (PARTITION BY n_features >= 20) AS n FROM scored)
SELECT doc_id, n_features, weight, score, CASE WHEN n_features >= 20 AND place <= n * 10 // 100 THEN place END AS rank FROM placed
"""
