"""Time-varying curriculum: documents of several sources in training order, in the proportions a schedule asks for.

A source's weight changes linearly over the training time t in [0, 1]. The integral of its weight gives its share of all
words and, scaled to its target, its cumulative demand. Documents of a source follow each other in hash order; the
place of a copy in that sequence is put through the inverse of the demand and becomes its training position. Copies are
range-sorted by position.

Scale: sizes are taken in one pass into a narrow checkpointed table. The running sum of a source goes over hash buckets
first (a partially aggregated table) and then inside each bucket, so a source with a third of all rows is spread over
as many tasks as any other rows. Source totals are one row per source; sources are assumed to be far fewer than rows
(one ordered window over them).
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import cut_lineage
from .common import SEPARATORS, spare, table

#: Weights of the sources in code point order, repeating; each goes linearly from its first to its last value.
WEIGHTS = (1.0, 2.0, 3.0)
RAMPS = ((1.5, 0.5), (1.0, 1.0), (0.5, 1.5))
MOST_COPIES = 3
#: Rows of a hash bucket inside which one task sorts, on average.
BUCKET_ROWS = 4_000

_IS_SEPARATOR = np.zeros(256, dtype=bool)
_IS_SEPARATOR[[ord(c) for c in SEPARATORS]] = True


def _word_counts(batches):
    """Words per text: word starts are bytes other than separators that follow one; separators are single bytes."""
    for batch in batches:
        text = batch.column(batch.num_columns - 1).cast(pa.large_string())
        text = text.fill_null("")
        offsets = np.frombuffer(text.buffers()[1], dtype=np.int64)[text.offset : text.offset + len(text) + 1]
        data = text.buffers()[2]
        raw = np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, np.uint8)
        counts = np.zeros(len(text), dtype=np.int64)
        for i in range(len(text)):
            gap = _IS_SEPARATOR[raw[offsets[i] : offsets[i + 1]]]
            if len(gap):
                counts[i] = int(not gap[0]) + int(np.count_nonzero(gap[:-1] & ~gap[1:]))
        columns = [batch.column(i) for i in range(batch.num_columns - 1)]
        names = batch.schema.names[:-1]
        yield pa.RecordBatch.from_arrays([*columns, pa.array(counts)], names=[*names, "size"])


def sizes(docs: DataFrame, keep: list[str], text: str = "text") -> DataFrame:
    """``keep`` columns and ``size``, the number of words of the whole text (null: 0)."""
    picked = docs.select(*keep, F.col(text).alias("_text"))
    schema = picked.drop("_text").withColumn("size", F.lit(0).cast("long")).schema
    return picked.mapInArrow(_word_counts, schema)


def targets(totals: DataFrame, weights=WEIGHTS, ramps=RAMPS, most=MOST_COPIES) -> DataFrame:
    """Adds ``target`` and the ramp to one row per source with ``source`` and ``source_size``.

    A source's ``weight`` is the integral of its schedule over the training time: its weight times the mean of its ramp's
    ends. A target stops at ``most`` times its source; the excess is reshared by weight. The fixed point is
    target = min(most * size, level * weight): with sources ordered by most * size / weight, the level follows from
    the running sums of the capped ones.
    """
    k = (F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1) % len(weights)
    pick = lambda values: F.array(*[F.lit(float(v)) for v in values])[k.cast("int")]
    out = totals.withColumns({"_from": pick([r[0] for r in ramps]), "_to": pick([r[1] for r in ramps])})
    out = out.withColumn("weight", pick(weights) * (F.col("_from") + F.col("_to")) / 2)
    cap = most * F.col("source_size")
    out = out.withColumns({"_cap": cap, "_full_at": cap / F.col("weight")})
    everything = Window.partitionBy()
    up_to = Window.orderBy("_full_at", F.col("source").asc_nulls_last()).rowsBetween(Window.unboundedPreceding, -1)
    out = out.withColumns(
        {
            "_all": F.sum("source_size").over(everything),
            "_capped": F.coalesce(F.sum("_cap").over(up_to), F.lit(0)),
            "_open": F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(up_to), F.lit(0.0)),
        }
    )
    # The level is the first one at which the next source would not be full.
    at = (F.col("_all") - F.col("_capped")) / F.col("_open")
    out = out.withColumn("_at", F.when(at < F.col("_full_at"), at))
    level = F.min(F.when(F.col("_at").isNotNull(), F.struct(F.col("_full_at"), F.col("_at")))).over(everything)["_at"]
    target = F.when(level.isNull(), F.col("_cap").cast("double")).otherwise(
        F.least(F.col("_cap").cast("double"), level * F.col("weight"))
    )
    return out.select("source", "source_size", "weight", "_from", "_to", target.alias("target"))


def _time_of(done: Column, start: Column, end: Column) -> Column:
    """t in [0, 1] at which the integral of a linear weight reaches the share ``done`` of its whole.

    start * t + (end - start) * t^2 / 2 = done * (start + end) / 2, solved in the form that is stable for equal ends.
    """
    goal = done * (start + end) / 2
    return F.least(F.lit(1.0), 2 * goal / (start + F.sqrt(F.greatest(F.lit(0.0), start * start + 2 * (end - start) * goal))))


def mix(
    docs: DataFrame,
    *,
    doc_id: str = "doc_id",
    text: str = "text",
    source: str = "source",
    weights=WEIGHTS,
    ramps=RAMPS,
    most: int = MOST_COPIES,
) -> DataFrame:
    """One row per document: ``doc_id, source, key, size, source_size, target, copies, taken, passes``.

    ``passes`` holds the training position in [0, 1] of each copy. A document is taken in whole: once per full pass over
    its source, and once more if more than half of it lies before the end of the last, partial pass. The partial pass
    goes over the documents above the source's mean size first and lets the others make up what those missed, so a
    source misses its target by about half a mean document. No document is taken more than ``most`` times. ``key`` is a
    hash of id and text that names the row; repeated rows (same id and text) share it, each gets its own copies, and
    reruns agree. Null text: size 0. Null source: a source of its own, last. A source without words has target 0.
    """
    keyed = docs.select(
        F.col(doc_id).alias("doc_id"),
        F.col(source).alias("source"),
        F.xxhash64(F.col(doc_id).cast("string"), F.col(text)).alias("key"),
        F.col(text).alias("text"),
    )
    rows = cut_lineage(sizes(keyed, ["doc_id", "source", "key"]))
    per_source = rows.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("_n"))
    plan = targets(per_source.drop("_n"), weights, ramps, most)
    plan = plan.join(per_source.select(F.col("source").alias("_s"), "_n"), F.col("source").eqNullSafe(F.col("_s"))).drop("_s")
    whole = F.coalesce(F.floor(F.try_divide(F.col("target"), F.col("source_size"))), F.lit(0))
    plan = plan.withColumn("_full", F.least(whole, F.lit(most)))
    plan = plan.withColumn("_rest", F.col("target") - F.col("_full") * F.col("source_size"))
    plan = cut_lineage(plan)
    t = plan.withColumnRenamed("source", "_t")
    rows = rows.join(t, F.col("source").eqNullSafe(F.col("_t"))).drop("_t")
    rows = rows.withColumn("_large", F.col("size") * F.col("_n") > F.col("source_size"))

    # Running sizes in hash order: over buckets, then inside each. Buckets are ranges of the hash, so the order does not
    # depend on their number.
    n = plan.agg(F.sum("_n")).first()[0] or 0
    buckets = max(1, math.ceil(n / BUCKET_ROWS))
    place = F.col("key").cast("double") / 2.0**64 + 0.5
    rows = rows.withColumn("_bucket", F.least(F.floor(place * buckets), F.lit(buckets - 1)).cast("int"))
    part = ["source", "_large"]
    sums = rows.groupBy(*part, "_bucket").agg(F.sum("size").alias("_in"))
    before = Window.partitionBy(*part).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.withColumns(
        {"_before": F.coalesce(F.sum("_in").over(before), F.lit(0)), "_part_size": F.sum("_in").over(Window.partitionBy(*part))}
    )
    inside = Window.partitionBy(*part, "_bucket").orderBy("key", "doc_id", "size").rowsBetween(Window.unboundedPreceding, -1)
    out = rows.withColumn("_own", F.coalesce(F.sum("size").over(inside), F.lit(0)))
    s = sums.select(F.col("source").alias("_s"), F.col("_large").alias("_l"), F.col("_bucket").alias("_b"), "_before", "_part_size")
    out = out.join(s, F.col("source").eqNullSafe(F.col("_s")) & (F.col("_large") == F.col("_l")) & (F.col("_bucket") == F.col("_b")))
    out = cut_lineage(out.withColumn("_middle", F.col("_before") + F.col("_own") + F.col("size") / 2).drop("_s", "_l", "_b"))

    share = F.coalesce(F.try_divide(F.col("_rest") * F.col("_part_size"), F.col("source_size")), F.lit(0.0))
    by_large = out.filter("_large").groupBy("source").agg(F.sum(F.when(F.col("_middle") < share, F.col("size"))).alias("_by_large"))
    by_large = by_large.withColumnRenamed("source", "_s")
    out = out.join(by_large, F.col("source").eqNullSafe(F.col("_s")), "left").drop("_s")
    left = F.greatest(F.lit(0.0), F.col("_rest") - F.coalesce(F.col("_by_large"), F.lit(0)))
    out = out.withColumn("_end", F.when(F.col("_large"), share).otherwise(left))
    more = (F.col("_middle") < F.col("_end")) & (F.col("_full") < most)
    out = out.withColumn("copies", (F.col("_full") + more.cast("int")).cast("int"))

    def place_of(p: Column) -> Column:
        """Words of the source that come before the middle of the p-th copy."""
        last = F.try_divide(F.col("_rest") * F.col("_middle"), F.col("_end"))
        in_full = F.try_divide(F.col("source_size") * F.col("_middle"), F.col("_part_size"))
        return p * F.col("source_size") + F.when(p < F.col("_full"), in_full).otherwise(last)

    passes = F.when(
        F.col("copies") > 0,
        F.transform(
            F.sequence(F.lit(0), F.col("copies") - 1),
            lambda p: _time_of(F.least(F.lit(1.0), F.try_divide(place_of(p), F.col("target"))), F.col("_from"), F.col("_to")),
        ),
    ).otherwise(F.array().cast("array<double>"))
    return out.select(
        "doc_id",
        "source",
        "key",
        "size",
        "source_size",
        "target",
        "copies",
        (F.col("copies") * F.col("size")).alias("taken"),
        passes.alias("passes"),
    )


def in_training_order(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", source: str = "source", **options):
    """The documents, each repeated as often as the mix takes it, range-sorted by training position.

    Columns are those of ``docs``. Copies meet their document through id, source and text hash; of repeated rows one
    carries all copies.
    """
    names = docs.columns
    mixed = mix(docs, doc_id=doc_id, text=text, source=source, **options)
    row, key, id_, of, at = (spare(n, docs) for n in ("_row", "_key", "_id", "_of", "_at"))
    plan = mixed.select(
        F.col("key").alias(key), F.col("doc_id").alias(id_), F.col("source").alias(of), F.explode("passes").alias(at)
    )
    keyed = docs.withColumn(row, F.xxhash64(F.col(doc_id).cast("string"), F.col(text)))
    repeated = mixed.groupBy("key", "doc_id", "source").count().filter("count > 1")
    if not repeated.isEmpty():
        keyed = keyed.dropDuplicates([row, doc_id, source])
    same = (F.col(row) == F.col(key)) & F.col(doc_id).eqNullSafe(F.col(id_)) & F.col(source).eqNullSafe(F.col(of))
    placed = keyed.join(plan, same)
    return placed.repartitionByRange(at, row).sortWithinPartitions(at, row).select(*names)


def op5_curriculum_mix(spark, sf_dir: str) -> DataFrame:
    out = mix(table(spark, sf_dir, "documents"))
    out = out.select("doc_id", "size", "source_size", "target", F.col("taken").cast("long").alias("taken"), "key", F.col("passes").alias("positions"))
    first = F.get("positions", F.lit(0))
    ordered = out.withColumn("first_position", first).repartitionByRange("first_position", "key").sortWithinPartitions("first_position", "key")
    return ordered.drop("key")
