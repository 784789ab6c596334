"""Helpers the operators of this subpackage share."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..session import ARROW_BYTES, cut_lineage, release, small_batches  # noqa: F401

# A word is a run of code points other than these six ASCII separators.
SEPARATORS = " \t\n\x0b\x0c\r"
WORD = re.compile(r"[^ \t\n\x0b\x0c\r]+")
WORD_JAVA = r"[^\x20\x09-\x0D]+"
GAP_JAVA = r"[\x20\x09-\x0D]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
ASCII_LOWER = {ord(a): b for a, b in zip(UPPER, LOWER)}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    small_batches(spark)
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def ascii_lower(c: Column) -> Column:
    return F.translate(c, UPPER, LOWER)


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` with ``value`` bound to a lambda variable, so that it is computed once per row."""
    return F.transform(F.array(value), body)[0]


def words(c: Column) -> Column:
    """Words of a text; null and blank texts have none."""
    return F.array_remove(F.split(F.coalesce(c, F.lit("")), GAP_JAVA, -1), "")


def matches(pattern: re.Pattern, raw: bytes, size: int = 1 << 20):
    """Lists of the matches of a run ``[...]+`` of bytes, about ``size`` bytes of the text at a time; none is cut."""
    at = 0
    while at < len(raw):
        end = min(len(raw), at + size)
        if rest := pattern.match(raw, end):
            end = rest.end()
        yield pattern.findall(raw, at, end)
        at = end


def binaries(column):
    """The UTF-8 bytes of an Arrow column of strings, a null as none."""
    import pyarrow as pa

    return (x.as_py() or b"" for x in column.cast(pa.binary()))


#: Rows of a partition of a settled table.
SETTLED_ROWS = 250_000


def settle(df: DataFrame, rows: int = SETTLED_ROWS) -> DataFrame:
    """Checkpoint, in as many partitions as its rows need: what a large table was cut down to does not keep the partitions
    of the large one, nor do the stages and shuffles that read it."""
    df = cut_lineage(df)
    return df.coalesce(-(-df.count() // rows) or 1)


def ranked(df: DataFrame, order: list[Column], name: str) -> DataFrame:
    """``name``: position from 1 in the order of all rows. A range shuffle; the rows before a partition are a sum over
    one row per partition. Rows that are equal in ``order`` follow each other in any order."""
    spark, at = df.sparkSession, spare("_at", df)
    sorted_ = df.repartitionByRange(*order).sortWithinPartitions(*order)
    sorted_ = cut_lineage(sorted_.withColumn(at, F.monotonically_increasing_id()))
    part, before, seen = F.shiftright(at, 33), [], 0
    for p, n in sorted(sorted_.groupBy(part.alias("p")).count().collect()):
        before.append((p, seen))
        seen += n
    offsets = spark.createDataFrame(before, "_part long, _before long")
    placed = sorted_.withColumn("_part", part).join(F.broadcast(offsets), "_part", "left")
    place = F.col(at).bitwiseAND(F.lit((1 << 33) - 1)) + F.col("_before") + 1
    return placed.withColumn(name, place).select(*df.columns, name)


def spare(name: str, *frames: DataFrame) -> str:
    """``name``, made longer until no column of the frames is called so."""
    taken = {c.lower() for f in frames for c in f.columns}
    while name.lower() in taken:
        name += "_"
    return name


def text_last(docs: DataFrame, keep: list[str], text: str, made: dict[str, str]) -> tuple[DataFrame, StructType]:
    """``keep`` columns with the text behind them, and the schema with the new columns in the text's place."""
    name = spare("_text", docs)
    picked = docs.select(*keep, F.col(text).alias(name))
    return picked, picked.drop(name).withColumns({c: F.lit(None).cast(kind) for c, kind in made.items()}).schema


def least_reachable(links: DataFrame) -> DataFrame:
    """Smallest id that links reach: ``(id, component)`` for each id that has a link.

    ``links`` has two long columns ``a`` and ``b``. Alternates large-star and small-star steps (Kiveris et al. 2014);
    minima are combined on the map side and each step is a join with one row per id, which Spark can split for a hub.
    The number of rounds is logarithmic; each is checkpointed, so a lost executor costs one round at most, and the round
    before is deleted.
    """
    edges = links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).filter("a > b").distinct()
    edges = settle(edges)
    # Steps never make more rows than edges and their ends.
    parts = edges.rdd.getNumPartitions()
    before = None
    while True:
        both = edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).coalesce(parts)
        low = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        met = both.filter("b > a").join(low, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        met = met.filter("a > b").coalesce(parts).distinct().coalesce(parts)
        low = met.groupBy("a").agg(F.min("b").alias("m"))
        hung = met.join(low, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).filter("a > b")
        after = cut_lineage(hung.union(low.select("a", F.col("m").alias("b"))).coalesce(parts).distinct().coalesce(parts))
        release(edges)
        edges = after
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if now == before:
            break
        before = now
    roots = edges.select(F.col("b").alias("id")).distinct().withColumn("component", F.col("id"))
    return edges.select(F.col("a").alias("id"), F.col("b").alias("component")).union(roots)
